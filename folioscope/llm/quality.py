"""Quality classifier: random Fourier features over document statistics, ridge scores from summed
normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, as_bytes, bounded, fold, pieces, released, stored

_CODES = np.arange(256)
_CLASSES = np.stack([
    (_CODES >= 65) & (_CODES <= 90), (_CODES >= 97) & (_CODES <= 122), (_CODES >= 48) & (_CODES <= 57), _CODES >= 128,
    np.isin(_CODES, list(b".,;:?'\"()-")), np.isin(_CODES, list(b"#*$%&<>=~^@\\_{}[]")), _CODES == ord("|"), _CODES == ord("!"), _CODES == 10, _CODES == 32,
]).astype(np.float64)
STATS = 22
#: Bytes of text that a worker turns into Python objects at once.
PIECE = 8 << 20


def statistics(text: bytes) -> np.ndarray:
    """STATS numbers about a whole text; all 0 for an empty one."""
    out = np.zeros(STATS)
    words = text.split()
    if not words:
        return out
    n, size = len(words), max(1, len(text))
    share = _CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    low = text.translate(LOWER).split()
    counts = Counter(low)
    pairs = Counter(zip(low, low[1:], low[2:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = Counter(w[-1] for w in words)
    letters = share[0] + share[1] + share[3]
    out[:10] = share
    out[10:] = (
        np.log1p(n), lengths.mean(), lengths.std(), len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
        1 - len(pairs) / max(1, sum(pairs.values())), share[0] / max(letters, 1e-9),
        1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)),
        sum(v for k, v in ends.items() if k in b"#*$%&!|<>") / n, sum(b"|" in x for x in lines) / len(lines),
    )
    return out


@dataclass(frozen=True)
class Fit:
    """width: random features; ridge: its penalty for each row; bins: of the score, for calibration. fan:
    matrices that one task, or the driver at the end, adds up. labelled_rows: ids of labelled rows that
    are broadcast at most."""

    width: int = 192
    ridge: float = 1e-4
    bandwidth: float = 1.0
    seed: int = 7
    bins: int = 2000
    clip: float = 6.0
    fan: int = 32
    labelled_rows: int = 1_000_000


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]
    clip: float

    def lift(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -self.clip, self.clip)
        z = np.cos(x @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.lift(stats) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        raw = self.raw(stats)
        level = np.interp(raw, *self.knots)
        return np.clip(0.98 * level + 0.02 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in order of x: block centres and their levels."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def stats_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, stats array<double>) for every row."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for b in pieces(batch, text_col, PIECE):
                rows = [statistics(x).tolist() for x in as_bytes(b, text_col)]
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(rows, pa.list_(pa.float64()))], names=[id_col, "stats"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array(batch.column(column).to_pylist(), np.float64).reshape(-1, STATS)


def fit(rows: DataFrame, how: Fit = Fit()) -> Model:  # noqa: B008
    """A model from all rows (stats, label 0/1, part 0/1), whose number is not limited.

    Each partition sums its normal equations, tasks add up `fan` of those at a time, level by level, and
    the driver the last `fan` matrices of width² for each part. The two parts score each other for the isotonic fit, which sees
    sums by bin of the score; the final weights come from both. Without rows, or with one label only,
    every score is the same."""
    n = STATS
    first = rows.agg(*[F.avg(F.col("stats")[i]) for i in range(n)], *[F.stddev_pop(F.col("stats")[i]) for i in range(n)]).first()
    mean = np.array([x or 0.0 for x in first[:n]])
    scale = np.array([x if x and x > 1e-9 else 1.0 for x in first[n:]])
    rng = np.random.default_rng(how.seed)
    d = how.width + 1
    model = Model(mean, scale, rng.standard_normal((n, how.width)) / (how.bandwidth * np.sqrt(n)), rng.uniform(0, 2 * np.pi, how.width), np.zeros(d), (np.array([0.0, 1.0]), np.array([0.0, 1.0])), how.clip)

    kind = pa.schema([("part", pa.int32()), ("grp", pa.int32()), ("sums", pa.binary())])

    def sums(batches):
        from pyspark import TaskContext

        total, seen = {p: np.zeros((d, d + 1)) for p in (0, 1)}, False
        for b in batches:
            z, y, part = model.lift(matrix(b, "stats")), b.column("label").to_numpy(zero_copy_only=False), b.column("part").to_numpy(zero_copy_only=False)
            seen = seen or len(z) > 0
            for p in (0, 1):
                at = part == p
                total[p] += z[at].T @ np.hstack([z[at], y[at, None]])
        if seen:
            yield pa.RecordBatch.from_pydict({"part": [0, 1], "grp": [TaskContext.get().partitionId()] * 2, "sums": [total[p].tobytes() for p in (0, 1)]}, schema=kind)

    def added(t):
        total = np.zeros(d * (d + 1))
        for x in t.column("sums"):
            total += np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"part": [t.column("part")[0].as_py()], "grp": [t.column("grp")[0].as_py()], "sums": [total.tobytes()]}, schema=kind)

    both = {p: np.zeros((d, d + 1)) for p in (0, 1)}
    picked = rows.select("stats", F.col("label").cast("double").alias("label"), F.col("part").cast("int").alias("part"))
    level = stored(picked.mapInArrow(sums, "part int, grp int, sums binary"))
    groups = (level.agg(F.max("grp")).first()[0] or 0) + 1
    while groups > how.fan:  # a task adds `fan` matrices at most
        old, groups = level, -(-groups // how.fan)
        level = stored(old.withColumn("grp", F.floor(F.col("grp") / how.fan).cast("int")).groupBy("part", "grp").applyInArrow(added, "part int, grp int, sums binary"))
        released(old)
    for r in level.collect():
        both[r.part] += np.frombuffer(bytes(r.sums)).reshape(d, d + 1)
    released(level)

    def solve(a: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a[:, :d] + (how.ridge * a[-1, d - 1] + 1e-9) * np.eye(d), a[:, d])

    other = {p: solve(both[1 - p]) for p in (0, 1)}
    model.weights = solve(both[0] + both[1])

    def binned(batches):
        for b in batches:
            x, part = matrix(b, "stats"), b.column("part").to_numpy(zero_copy_only=False)
            raw = np.where(part == 0, model.raw(x, other[0]), model.raw(x, other[1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.clip(raw, -1, 2) * how.bins).astype(np.int64)), b.column("label")], names=["bin", "label"])

    bins = picked.mapInArrow(binned, "bin long, label double").groupBy("bin").agg(F.sum("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    x, y, w = (np.array([float(r[i]) for r in bins]) for i in range(3))
    model.knots = isotonic(x / how.bins, y / np.maximum(w, 1), w)
    return model


def known_rows(labels: DataFrame, label_col: str, held: tuple[int, int], id_col: str) -> DataFrame:
    """_id, label and part (0 or 1) of the labelled rows whose crc32(id) mod held[0] is not held[1]."""
    k, r = held
    known = labels.filter(F.col(label_col).isNotNull() & (fold(id_col, k) != r))
    return known.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"), F.when(fold(id_col, k) == (r + 1) % k, 0).otherwise(1).alias("part"))


def trained(stats: DataFrame, labels: DataFrame, label_col: str, held: tuple[int, int], id_col: str = "doc_id", how: Fit = Fit()) -> Model:  # noqa: B008
    """Fit to the labelled rows outside the held-out fold. Only statistics move to meet the labels, never
    texts; labels of up to labelled_rows rows are broadcast instead."""
    known = known_rows(labels, label_col, held, id_col)
    rows = stored(stats.select(F.col(id_col).alias("_id"), "stats").join(bounded(known, how.labelled_rows), "_id").select("stats", "label", "part"))
    model = fit(rows, how)
    released(rows)
    return model


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text", how: Fit = Fit()) -> DataFrame:  # noqa: B008
    """id_col, held_out, score, predicted for every row of docs. Null texts are empty; an empty text is
    scored from statistics that are all 0; a long text is read whole. A null id is never held out or
    learned from. A score of exactly 0.5 predicts 1. Rows repeat as in docs, and count as often in the
    fit; an empty table gives an empty one; other columns are not read."""
    stats = stored(stats_of(docs, id_col, text_col))
    model = trained(stats, labels, label_col, held, id_col, how)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(model.score(matrix(b, "stats")))], names=[id_col, "score"])

    out = stats.mapInArrow(run, schema)
    return out.select(id_col, F.coalesce(fold(id_col, held[0]) == held[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, how: Fit = Fit()) -> DataFrame:  # noqa: B008
    """The rows of docs whose score is `least` or more, unchanged; texts are not shuffled.

    If the labelled ids are few enough to be broadcast, statistics of those rows alone are taken for the
    fit, and each text is read once more for its score. Nulls, empty and long texts, repeated rows: as in
    scored(). An empty table gives an empty one."""
    known = known_rows(labels, label_col, held, id_col).select("_id").distinct()
    few = known.limit(how.labelled_rows + 1).count() <= how.labelled_rows
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    stats = stored(stats_of(plain.join(F.broadcast(known), "_id", "left_semi") if few else plain, "_id", "_text"))
    model = trained(stats.withColumnRenamed("_id", id_col), labels, label_col, held, id_col, how)
    released(stats)

    def run(batches):
        for batch in batches:
            for b in pieces(batch, text_col, PIECE):
                good = model.score(np.array([statistics(x) for x in as_bytes(b, text_col)])) >= least
                yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
