"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from array import array
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, fold, pieces, released, stored

#: bytes.translate table: signs that are no letters or digits become spaces.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
# Frequent function words, by which the language of a text is told.
TONGUES = {
    "en": "the of and to in is that was for with it as be by on",
    "de": "der die das und ist nicht mit von den ein zu auf dem sich im",
    "fr": "le la les des et est que dans pour une du un sur qui avec",
    "es": "el los las que de una por con del es en un se no lo",
}
#: Word prefixes (bytes) that get buckets of their own beside the whole word's.
PREFIXES = (4, 5, 6)
VIEWS = 1 + len(PREFIXES)
#: Bins of a logit's unit, and the logit beyond which all share a bin: rows to the driver are bounded.
BINS, FAR = 256, 32


@dataclass(frozen=True)
class Fit:
    """The classifier learns from a sample: at most about `positives` and `negatives` labelled rows,
    of `chars` code points together, chosen by a hash of their ids. Texts in it are whole."""

    positives: int = 4000
    negatives: int = 6000
    chars: int = 36_000_000
    buckets: int = 1 << 15
    width: int = 12
    filters: int = 5
    sizes: tuple[int, ...] = (1, 2, 3)
    epochs: int = 5
    batch: int = 48
    rate: float = 0.08
    seed: int = 3
    #: Part of the sample that the net doesn't learn from. Languages with fewer positives (or others)
    #: among all labelled rows that it didn't learn from share one threshold.
    holdback: int = 5
    least: int = 12


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(PLAIN).split()


def ids_of(word: bytes, buckets: int) -> list[int]:
    return [crc32(word) % buckets, *(buckets * (i + 1) + crc32(word[:n]) % buckets for i, n in enumerate(PREFIXES))]


class Net:
    def __init__(self, how: Fit):
        rng = np.random.default_rng(how.seed)
        self.how, self.taps = how, sum(how.sizes)
        self.embed = (rng.standard_normal((VIEWS * how.buckets, how.width)) * 0.1).astype(np.float32)
        self.conv = (rng.standard_normal((self.taps, how.width, how.filters)) * 0.3).astype(np.float32)
        self.bias = np.zeros(len(how.sizes) * how.filters, np.float32)
        self.out = (rng.standard_normal(len(how.sizes) * how.filters) * 0.3).astype(np.float32)
        self.base = np.float32(0)

    def taps_of(self, e: np.ndarray) -> np.ndarray:
        """Contribution of a token to every tap of every filter: (tokens, taps * filters)."""
        return e @ self.conv.transpose(1, 0, 2).reshape(self.how.width, -1)

    def responses(self, taps: np.ndarray) -> np.ndarray:
        """Filter responses at each token from tap contributions; those at the padding that ends a text
        reach into the next one and are not to be used."""
        n, f, at, out = len(taps), self.how.filters, 0, []
        for size in self.how.sizes:
            r = taps[:, at * f : (at + 1) * f].copy()
            for j in range(1, size):
                r[: n - j] += taps[j:, (at + j) * f : (at + j + 1) * f]
            out.append(r)
            at += size
        return np.hstack(out) + self.bias

    def train(self, table: np.ndarray, docs: list[np.ndarray], labels: np.ndarray) -> None:
        """table: bucket numbers (words, VIEWS); docs: the words of each text, by their row. Adagrad on the logistic loss; max pooling sends the
        gradient to one token for each text and filter."""
        h, rng = self.how, np.random.default_rng(self.how.seed + 1)
        pad, f = max(h.sizes) - 1, h.filters
        square = {k: np.full(getattr(self, k).shape, 1e-3, np.float32) for k in ("embed", "conv", "bias", "out")}
        base_sq, weight = 1e-3, np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        tap_of, size_of = [], []
        at = 0
        for size in h.sizes:
            tap_of += [at] * f
            size_of += [size] * f
            at += size
        tap_of, size_of, col = np.array(tap_of), np.array(size_of), np.arange(len(tap_of)) % f
        for _ in range(h.epochs):
            order = rng.permutation(len(docs))
            for s in range(0, len(order), h.batch):
                pick = order[s : s + h.batch]
                ids = np.concatenate([x for i in pick for x in (table[docs[i]], np.full((pad, VIEWS), -1, np.int32))])
                starts = np.cumsum([0, *(len(docs[i]) + pad for i in pick)])[:-1]
                e = np.zeros((len(ids), h.width), np.float32)
                real = ids[:, 0] >= 0
                for v in range(VIEWS):
                    e[real] += self.embed[ids[real, v]]
                r = self.responses(self.taps_of(e))
                r[~real] = self.bias  # padding sees nothing of the text that follows
                top = np.maximum.reduceat(r, starts)
                owner = np.repeat(np.arange(len(pick)), np.diff([*starts, len(ids)]))
                hit_t, hit_f = np.nonzero(r == top[owner])
                _, first = np.unique(owner[hit_t] * r.shape[1] + hit_f, return_index=True)
                hit_t, hit_f = hit_t[first], hit_f[first]
                pool = np.maximum(top, 0)
                z = pool @ self.out + self.base
                g = ((1 / (1 + np.exp(-z)) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
                grad_out, grad_base = pool.T @ g, g.sum()
                gh = g[owner[hit_t]] * self.out[hit_f] * (top[owner[hit_t], hit_f] > 0)
                grad_bias = np.bincount(hit_f, gh, len(self.bias)).astype(np.float32)
                grad_conv, rows, grads = np.zeros_like(self.conv), [], []
                for j in range(max(h.sizes)):
                    use = (size_of[hit_f] > j) & (gh != 0) & real[hit_t]
                    t, k, gj = hit_t[use] + j, hit_f[use], gh[use]
                    np.add.at(grad_conv, (tap_of[k] + j, slice(None), col[k]), gj[:, None] * e[t])
                    de = gj[:, None] * self.conv[tap_of[k] + j, :, col[k]]
                    keep = ids[t, 0] >= 0
                    for v in range(VIEWS):
                        rows.append(ids[t[keep], v])
                        grads.append(de[keep])
                for name, grad in (("conv", grad_conv), ("bias", grad_bias), ("out", grad_out)):
                    square[name] += grad * grad
                    getattr(self, name)[...] -= h.rate * grad / np.sqrt(square[name])
                base_sq += grad_base**2
                self.base -= np.float32(h.rate * grad_base / np.sqrt(base_sq))
                if rows:
                    where, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                    total = np.zeros((len(where), h.width), np.float32)
                    np.add.at(total, inverse, np.concatenate(grads))
                    square["embed"][where] += total * total
                    self.embed[where] -= h.rate * total / np.sqrt(square["embed"][where])


class Scorer:
    """Scores texts; keeps tap contributions of up to `most` words, which is what a forward pass over
    a word's embedding comes to."""

    def __init__(self, net: Net, cuts: dict[str, float], scale: float, most: int = 150_000):
        self.net, self.cuts, self.scale, self.most = net, cuts, scale, most
        self.tongue = {w.encode(): [i for i, ws in enumerate(TONGUES.values()) if w in ws.split()] for ws in TONGUES.values() for w in ws.split()}
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.rows = [np.zeros((1 << 12, self.net.how.filters), np.float32) for _ in range(self.net.taps)]
        self.told = np.zeros((1 << 12, len(TONGUES)), np.int32)

    def learn(self, new: list[bytes]) -> None:
        """Row 0 of the tables is padding."""
        if len(self.index) + len(new) > self.most:
            self.reset()
        at, b, f = len(self.index) + 1, self.net.how.buckets, self.net.how.filters
        while at + len(new) > len(self.told):
            self.rows = [np.vstack([x, np.zeros_like(x)]) for x in self.rows]
            self.told = np.vstack([self.told, np.zeros_like(self.told)])
        for s in range(0, len(new), 8192):
            part = new[s : s + 8192]
            taps = self.net.taps_of(self.net.embed[np.array([ids_of(w, b) for w in part])].sum(1))
            for i, x in enumerate(self.rows):
                x[at + s : at + s + len(part)] = taps[:, i * f : (i + 1) * f]
        self.index.update(zip(new, range(at, at + len(new)), strict=True))
        for w in self.tongue.keys() & set(new):
            self.told[self.index[w], self.tongue[w]] = 1

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """Net.responses for words by their rows."""
        at, n, out = 0, len(ids), []
        for size in self.net.how.sizes:
            r = self.rows[at].take(ids, 0)
            for j in range(1, size):
                r[: n - j] += self.rows[at + j].take(ids[j:], 0)
            out.append(r)
            at += size
        return np.hstack(out) + self.net.bias

    def logits(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        """Raw scores and languages ("" where no function word tells)."""
        z, said, pad = np.zeros(len(texts)), [""] * len(texts), [0] * (max(self.net.how.sizes) - 1)
        group: list[list[int]] = []
        members: list[int] = []

        def flush() -> None:
            if not members:
                return
            ids = np.fromiter(chain.from_iterable(group), np.int32)
            starts = np.cumsum([0, *map(len, group)])[:-1]
            r = self.responses(ids)
            r[ids == 0] = self.net.bias  # padding sees nothing of the text that follows
            top = np.maximum.reduceat(r, starts)
            hits = np.add.reduceat(self.told[ids], starts)
            for i, t, h in zip(members, np.maximum(top, 0) @ self.net.out + self.net.base, hits, strict=True):
                z[i], said[i] = t, list(TONGUES)[int(h.argmax())] if h.max() > 0 else ""
            group.clear()
            members.clear()

        size = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            new = list(set(words).difference(self.index))
            if len(new) > self.most // 2:
                flush()
                z[i], said[i] = self.long(words)
                continue
            if new:
                if len(self.index) + len(new) > self.most:
                    flush()
                    size = 0
                    new = list(set(words))
                self.learn(new)
            group.append([*map(self.index.__getitem__, words), *pad])
            members.append(i)
            size += len(words)
            if size > 1 << 16:
                flush()
                size = 0
        flush()
        return z, said

    def long(self, words: list[bytes]) -> tuple[float, str]:
        """A text with more distinct words than the cache: the same maxima, piece by piece."""
        step, keep = self.most // 2, max(self.net.how.sizes) - 1
        top, hits = None, np.zeros(len(TONGUES))
        for s in range(0, len(words), step):
            part = words[s : s + step + keep]
            self.reset()
            self.learn(list(set(part)))
            last = s + step >= len(words)
            ids = np.array([*map(self.index.__getitem__, part), *([0] * keep if last else [])])
            r = self.responses(ids)
            r = (r if last else r[:step]).max(0)
            top = r if top is None else np.maximum(top, r)
            hits += self.told[ids[:step]].sum(0)
        return float(np.maximum(top, 0) @ self.net.out + self.net.base), list(TONGUES)[int(hits.argmax())] if hits.max() > 0 else ""

    def scores(self, z: str, said: str) -> Column:
        """Scores from the columns of logits; a language's cut stands at 0.5."""
        cut = F.lit(self.cuts[""])
        for name in self.cuts.keys() - {""}:
            cut = F.when(F.col(said) == name, self.cuts[name]).otherwise(cut)
        return 1 / (1 + F.exp(-F.greatest(F.least(self.scale * (F.col(z) - cut), F.lit(40.0)), F.lit(-40.0))))


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1; the middle of the gap that it lies in."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + max(1, y.sum()))
    k = int(f1.argmax())
    return float((z[order[k]] + z[order[k + 1]]) / 2) if k + 1 < len(z) else float(z[order[k]] - 1)


def binned_threshold(rows: list) -> float:
    """threshold, from counts by label and bin."""
    bins: dict[int, list] = {}
    for r in rows:
        b = bins.setdefault(r.bin, [0, 0, r.low, r.high])
        b[:] = b[0] + r.n * (r.label == 1), b[1] + r.n, min(b[2], r.low), max(b[3], r.high)
    b = [bins[k] for k in sorted(bins, reverse=True)]
    hits, seen = np.cumsum([x[0] for x in b]), np.cumsum([x[1] for x in b])
    k = int((2 * hits / (seen + max(1, hits[-1]))).argmax())
    return float((b[k][2] + b[k + 1][3]) / 2) if k + 1 < len(b) else float(b[k][2] - 1)


def labelled(labels: DataFrame, label_col: str, held: tuple[int, int], id_col: str) -> DataFrame:
    """_id and _label outside the held-out fold, once for each id."""
    return labels.filter(F.col(label_col).isNotNull() & (fold(id_col, held[0]) != held[1])).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))


def calibrated(scorer: Scorer, raw: DataFrame, known: DataFrame, learnt: DataFrame, how: Fit) -> Scorer:
    """The scorer with cuts and scale of all labelled rows that the net didn't learn from; as it is, if
    those have one label only. raw: _id, _z, _said of every row; known: _id, _label; learnt: _id."""
    bin_ = F.floor(F.greatest(F.least("_z", F.lit(float(FAR))), F.lit(float(-FAR))) * BINS)
    rows = raw.join(known.join(F.broadcast(learnt), "_id", "left_anti"), "_id")
    rows = rows.groupBy("_said", F.when(F.col("_label") == 1, 1).otherwise(0).alias("label"), bin_.alias("bin"))
    # Whole millionths add up to the same sum in any order.
    rows = rows.agg(F.count("*").alias("n"), F.min("_z").alias("low"), F.max("_z").alias("high"), F.sum(F.round(F.col("_z") * 1e6).cast("long")).alias("micros")).collect()
    n = lambda rs, label: sum(r.n for r in rs if r.label == label)
    if not n(rows, 1) or not n(rows, 0):
        return scorer
    cuts = {"": binned_threshold(rows)}
    for name in TONGUES:
        at = [r for r in rows if r._said == name]
        if min(n(at, 1), n(at, 0)) >= how.least:
            cuts[name] = binned_threshold(at)
    mean = [sum(r.micros for r in rows if r.label == k) / n(rows, k) / 1e6 for k in (0, 1)]
    return Scorer(scorer.net, cuts, float(6 / max(mean[1] - mean[0], 1e-3)))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, held: tuple[int, int], id_col: str, text_col: str, how: Fit) -> list:
    """The labelled rows (id, text, label) to learn from. The ids chosen, whose number is bounded, are
    broadcast to the documents, so texts don't move to meet labels."""
    known = labelled(labels, label_col, held, id_col)
    counts = {r._label: r.n for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    u = F.shiftrightunsigned(F.xxhash64(F.lit(how.seed), F.col("_id")), 11) / float(1 << 53)
    rate = F.when(F.col("_label") == 1, how.positives / max(1, counts.get(1, 0))).otherwise(how.negatives / max(1, counts.get(0, 0)))
    picked = known.filter(u < rate).withColumn("_u", u / F.least(rate, F.lit(1.0)))
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), F.col(id_col) == F.col("_id")).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col("_label").alias("label"), "_u")
    rows = stored(rows)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    out = rows.filter(F.col("_u") < how.chars / max(1, total)).select("id", "text", "label").collect()
    released(rows)
    return out


def train(rows: list, how: Fit = Fit()) -> tuple[Scorer, list]:  # noqa: B008
    """A scorer from rows (id, text, label), its cuts those of the part held back, and the ids that its
    net learnt from. The order of rows doesn't matter. With rows of one label only, or none, no id is
    learnt from and every text gets the same score of under 0.5 (over, if all are 1)."""
    rows = sorted(rows, key=lambda r: (str(r[0]), r[1]))
    net = Net(how)
    y = np.array([r[2] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Scorer(net, {"": -1e6 if len(y) and y[0] == 1 else 1e6}, 1.0), []
    index: dict[bytes, int] = {}
    buckets = array("i")
    docs = []
    for r in rows:
        words = words_of(r[1]) or [b""]
        for w in words:
            if w not in index:
                index[w] = len(index)
                buckets.extend(ids_of(w, how.buckets))
        docs.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
    index.clear()
    table = np.frombuffer(buckets, np.int32).reshape(-1, VIEWS)
    apart = np.array([crc32(str(r[0]).encode() + b"#") % how.holdback == 0 for r in rows])
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(rows), bool)
    learn = np.flatnonzero(~apart)
    net.train(table, [docs[i] for i in learn], y[learn])
    check = np.flatnonzero(apart) if apart.any() else learn
    scorer = Scorer(net, {"": 0.0}, 1.0)
    z, said = scorer.logits([rows[i][1] for i in check])
    yc, said = y[check], np.array(said)
    cuts = {"": threshold(z, yc)}
    for name in TONGUES:
        at = said == name
        if yc[at].sum() >= how.least and (1 - yc[at]).sum() >= how.least:
            cuts[name] = threshold(z[at], yc[at])
    gap = z[yc == 1].mean() - z[yc == 0].mean()
    return Scorer(net, cuts, float(6 / max(gap, 1e-3))), [rows[i][0] for i in learn]


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text", how: Fit = Fit()) -> DataFrame:  # noqa: B008
    """id_col, held_out, score, predicted for every row of docs, whole texts.

    The threshold of the language that a text's function words tell stands at score 0.5; it is set on
    all labelled rows outside the held-out fold that the net didn't learn from. Null texts
    are empty, and an empty text gets what the bias gives. A null id is not held out. Rows repeat as in
    docs; other columns are not read."""
    spark = docs.sparkSession
    scorer, learnt = train(sample(docs, labels, label_col, held, id_col, text_col, how), how)
    shared = spark.sparkContext.broadcast((scorer.net, scorer.cuts, scorer.scale))  # 6 MB, fixed by Fit
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("_z", T.DoubleType()), T.StructField("_said", T.StringType())])

    def run(batches):
        s = Scorer(*shared.value)
        for batch in batches:
            for b in pieces(batch, text_col, 8 << 20):
                z, said = s.logits(as_text(b, text_col))
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(z, pa.float64()), pa.array(said, pa.string())], names=["_id", "_z", "_said"])

    raw = docs.select(id_col, text_col).mapInArrow(run, schema)
    if learnt:
        raw = stored(raw)
        ids = spark.createDataFrame([(x,) for x in set(learnt)], T.StructType([T.StructField("_id", kind)]))
        scorer = calibrated(scorer, raw, labelled(labels, label_col, held, id_col), ids, how)
    out = raw.select(F.col("_id").alias(id_col), scorer.scores("_z", "_said").alias("score"))
    return out.select(id_col, F.coalesce(fold(id_col, held[0]) == held[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
