"""Benchmark decontamination: an FM-index for each shard of training text, searched backwards."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bounded, pieces, stored

#: bytes.translate table: A-Z to lower case, ASCII signs that are no letters or digits to spaces.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SPANS = "array<struct<start:long,end:long>>"


@dataclass(frozen=True)
class Search:
    """window: words of a test phrase. block_bytes: benchmark text that is held at once; a larger
    benchmark is searched in as many blocks, one after the other. shard_bytes: text of an index.
    sample: every so many suffix positions are kept. few_rows: rows with hits of earlier blocks that
    are broadcast at most."""

    window: int = 13
    block_bytes: int = 8 << 20
    shard_bytes: int = 6 << 20
    sample: int = 8
    few_rows: int = 50_000


class Phrases:
    """The distinct windows of a block of the benchmark, as places in one sequence of word numbers: a
    window is where it ends and how long it is, so overlapping windows share their words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        get = self.vocabulary.setdefault
        parts = [np.fromiter((get(w, len(self.vocabulary) + 1) for w in text.translate(FOLDED).split()), np.int32) for _, text in items]
        self.base = len(self.vocabulary) + 1
        sizes = np.array(list(map(len, parts)), np.int64)
        self.flat = np.concatenate([np.zeros(0, np.int32), *parts])
        begin, owner = np.cumsum(sizes) - sizes, np.array([number[i] for i, _ in items], np.int64)
        del parts
        rungs = {1: self.flat.astype(np.int64)}  # numbers of the 1, 2, 4 ... words from each place

        def codes(length: int, at: np.ndarray) -> np.ndarray:
            """A number for the `length` words from each place, the same for the same words."""
            out, step = None, 1
            while step <= length:
                if step not in rungs:
                    half = rungs[step // 2]
                    rungs[step] = np.unique(half[: -step // 2] * (int(half.max()) + 1) + half[step // 2 :], return_inverse=True)[1]
                if length & step:
                    here = rungs[step][at]
                    out = here if out is None else np.unique(out * (int(rungs[step].max()) + 1) + here, return_inverse=True)[1]
                    at = at + step
                step *= 2
            return out

        ends, lengths, lists = [], [], []
        for length in np.unique(np.minimum(sizes, window)):
            if not length:
                continue
            mine = np.flatnonzero(np.minimum(sizes, window) == length)
            n = sizes[mine] - length + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[mine], n)
            _, first, which = np.unique(codes(int(length), at), return_index=True, return_inverse=True)
            pair = np.unique((which + sum(map(len, ends))) * len(self.items) + np.repeat(owner[mine], n))
            ends.append((at[first] + length).astype(np.int32))
            lengths.append(np.full(len(first), length, np.int32))
            lists.append(pair)
        empty = np.zeros(0, np.int32)
        self.ends, self.lengths = np.concatenate([empty, *ends]), np.concatenate([empty, *lengths])
        pair = np.concatenate([np.zeros(0, np.int64), *lists])
        which, self.owner_list = np.divmod(pair, max(1, len(self.items)))
        self.owner_list = self.owner_list.astype(np.int32)
        self.owner_at = np.searchsorted(which, np.arange(len(self.ends) + 1)).astype(np.int32)
        linked = np.ones(max(0, len(self.flat) - 1), bool)
        linked[begin[(begin > 0) & (begin < len(self.flat))] - 1] = False
        code = self.flat[:-1].astype(np.int64) * self.base + self.flat[1:]
        self.pairs = np.unique(code[linked])
        self.single = np.unique(self.flat[self.ends[self.lengths == 1] - 1])
        self.least = int(self.lengths.min()) if len(self.ends) else 0
        self.width = int(self.lengths.max()) if len(self.ends) else 0

    def __len__(self) -> int:
        return len(self.ends)


def live(ids: np.ndarray, p: Phrases) -> np.ndarray:
    """The positions whose words can be part of a phrase: runs of word pairs that the benchmark has, as
    long as the shortest phrase at least. Nothing else of the shard can match, so only they are
    indexed."""
    if not len(ids) or not len(p):
        return np.zeros(len(ids), bool)
    code = ids[:-1].astype(np.int64) * p.base + ids[1:]
    at = np.searchsorted(p.pairs, code)
    linked = np.zeros(len(ids) + 1, bool)  # linked[i]: words i-1 and i are a pair
    if len(p.pairs):
        linked[1:-1] = (p.pairs[np.minimum(at, len(p.pairs) - 1)] == code) & (ids[:-1] > 0) & (ids[1:] > 0)
    starts = np.flatnonzero(~linked[:-1])
    run = np.diff([*starts, len(ids)])
    keep = np.repeat(run >= max(2, p.least), run)
    return keep | np.isin(ids, p.single) if len(p.single) else keep


def suffix_array(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling. Separators (`ends`) differ from each other, in text order, so
    no comparison goes past one, and the rounds are the logarithm of the longest run."""
    n = len(s)
    rank = np.where(ends, np.cumsum(ends) - 1, s + int(ends.sum()))
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) > 0]))
        rank, step = fresh, step * 2
        if rank.max() == n - 1 or step >= n:
            return order


class Wavelet:
    """Wavelet matrix of a sequence of numbers; ranks for many places at once."""

    def __init__(self, s: np.ndarray, high: int):
        self.levels = max(1, int(high).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] stands before place i[k]."""
        low = np.zeros_like(i)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((c >> level) & 1) == 1
            a, b = self.ones[k][i], self.ones[k][low]
            i, low = np.where(one, self.zeros[k] + a, i - a), np.where(one, self.zeros[k] + b, low - b)
        return i - low


class Index:
    """FM-index of s, whose separators are 0 where `ends`; s ends with one."""

    def __init__(self, s: np.ndarray, ends: np.ndarray, high: int, sample: int):
        order = suffix_array(s, ends)
        self.last = s[order - 1]  # order 0 wraps to the final separator
        self.tree = Wavelet(self.last, high)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=high + 1))])
        after = np.concatenate([[True], ends[:-1]])
        kept = after[order] | (order % sample == 0)
        self.place = np.where(kept, order, -1)

    def ranges(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases, last word first: their rows from lo up to hi."""
        lo, hi = np.zeros(len(p), np.int64), np.full(len(p), len(self.last), np.int64)
        for j in range(1, p.width + 1):
            on = np.flatnonzero((p.lengths >= j) & (lo < hi))
            if not len(on):
                break
            c = p.flat[p.ends[on] - j].astype(np.int64)
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[on], hi[on]]))
            lo[on], hi[on] = self.before[c] + both[: len(on)], self.before[c] + both[len(on) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to the nearest sampled one."""
        out, steps, on = np.full(len(rows), -1, np.int64), 0, np.arange(len(rows))
        while len(on):
            at = self.place[rows]
            done = at >= 0
            out[on[done]] = at[done] + steps
            on, rows = on[~done], rows[~done]
            c = self.last[rows]
            rows, steps = self.before[c] + self.tree.rank(c, rows), steps + 1
        return out


def search(texts: list[bytes], p: Phrases, how: Search) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """Of each text of a shard: its number of words, the merged spans of words that phrases cover, and
    the items whose phrases occur."""
    get, ids, sizes = p.vocabulary.get, [], []
    for t in texts:
        w = t.translate(FOLDED).split()
        sizes.append(len(w))
        ids.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
        ids.append(np.zeros(1, np.int32))
    spans: list[list[dict]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    at = np.flatnonzero(live(flat, p))
    if not len(at):
        return sizes, spans, items
    # The live words, with a separator after each run.
    last = np.concatenate([np.diff(at) > 1, [True]])
    room = np.arange(len(at)) + np.concatenate([[0], np.cumsum(last)[:-1]])
    s = np.zeros(len(at) + int(last.sum()), np.int64)
    s[room] = flat[at]
    ends = np.ones(len(s), bool)
    ends[room] = False
    where = np.full(len(s), -1, np.int64)
    where[room] = at
    index = Index(s, ends, p.base - 1, how.sample)
    lo, hi = index.ranges(p)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return sizes, spans, items
    starts = np.cumsum([0, *(n + 1 for n in sizes)])
    cover = np.zeros(len(s) + 1, np.int64)
    pairs = []
    counts = (hi - lo)[found]
    for part in np.array_split(found, max(1, int(counts.sum()) // 500_000)):
        n = (hi - lo)[part]
        which = np.repeat(part, n)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[part], n)
        place = index.locate(rows)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + p.lengths[which], -1)
        doc = np.searchsorted(starts, where[place], "right") - 1
        pairs.append(np.unique(doc * len(p) + which))
    for code in np.unique(np.concatenate(pairs)):
        doc, w = divmod(int(code), len(p))
        items[doc].append(w)  # type: ignore[arg-type]
    for doc, ws in enumerate(items):
        if ws:
            owners = np.unique(np.concatenate([p.owner_list[p.owner_at[w] : p.owner_at[w + 1]] for w in ws]))
            items[doc] = [p.items[o] for o in owners]
    hit = np.sort(where[np.flatnonzero((np.cumsum(cover)[:-1] > 0) & ~ends)])
    cut = np.flatnonzero(np.diff(hit) > 1) + 1
    for run in np.split(hit, cut):
        doc = int(np.searchsorted(starts, run[0], "right") - 1)
        spans[doc].append({"start": int(run[0] - starts[doc]), "end": int(run[-1] - starts[doc]) + 1})
    return sizes, spans, items


def merged(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted([*a, *b], key=lambda x: x["start"]):
        if out and x["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], x["end"])}
        else:
            out.append(dict(x))
    return out


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, how: Search):
    """The benchmark's phrases, block by block, and whether a block is the last; each is bounded by about
    block_bytes, but for an item that is larger by itself."""
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-size // how.block_bytes) or 1
    for k in range(int(n)):
        rows = benchmark.filter(F.col(text_col).isNotNull())
        if n > 1:
            rows = rows.filter(F.pmod(F.xxhash64(item_col), F.lit(n)) == k)
        yield Phrases([(r[0], r[1].encode()) for r in rows.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), text_col).collect()], how.window), k == n - 1


def marked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", how: Search = Search()) -> DataFrame:  # noqa: B008
    """docs with n_words, spans (of words, to remove) and items (ids as strings, sorted), in place of
    columns of these names. Texts stay where they are: each shard, a piece of a partition, gets an
    FM-index of its own.

    A null or empty text has no words; benchmark items without words have no phrases; equal items are
    listed once, also when their texts differ; rows repeat as in docs; a very long text is a shard by
    itself. Without a benchmark nothing is marked; an empty table gives an empty one. Of each block but
    the last only the hits are written, by a key of the text; they meet the documents in the last pass."""
    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "spans", "items")]
    added = T.StructType([T.StructField("n_words", T.LongType()), *T.StructType.fromDDL(f"spans {SPANS}"), T.StructField("items", T.ArrayType(T.StringType()))])
    inner = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = {f.name: f"c{i}" for i, f in enumerate(kept)}
    plain = docs.select(*[F.col(k).alias(v) for k, v in names.items()])
    text = names[text_col]
    keyed = plain.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)})
    earlier: DataFrame | None = None
    blocks = phrase_blocks(benchmark, item_col, item_text, how)
    for phrases, last in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(phrases)

        def found(b: pa.RecordBatch, shared=shared) -> tuple:
            return search(as_bytes(b, text), shared.value, how)

        if not last:

            def hit(batches, found=found):
                for b in (x for batch in batches for x in pieces(batch, text, how.shard_bytes)):
                    _, spans, items = found(b)
                    at = np.flatnonzero(list(map(len, spans)))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), pa.array([spans[i] for i in at], inner), pa.array([items[i] for i in at], pa.list_(pa.string()))], names=["k1", "k2", "s", "i"])

            rows = stored(keyed.select("k1", "k2", text).mapInArrow(hit, f"k1 long, k2 long, s {SPANS}, i array<string>").dropDuplicates(["k1", "k2"]))
            earlier = rows if earlier is None else earlier.union(rows)
            continue
        if earlier is not None:
            before = stored(earlier.groupBy("k1", "k2").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("i")).alias("i")))
            plain = keyed.join(bounded(before, how.few_rows), ["k1", "k2"], "left").drop("k1", "k2")

        def run(batches, found=found, old=earlier is not None):
            for b in (x for batch in batches for x in pieces(batch, text, how.shard_bytes)):
                sizes, spans, items = found(b)
                if old:
                    spans = [merged(x or [], y) for x, y in zip(b.column("s").to_pylist(), spans, strict=True)]
                    items = [sorted({*(x or ()), *y}) for x, y in zip(b.column("i").to_pylist(), items, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(v) for v in names.values()), pa.array(sizes, pa.int64()), pa.array(spans, inner), pa.array(items, pa.list_(pa.string()))], names=[*names.values(), *added.names])

        out = plain.mapInArrow(run, T.StructType([*(T.StructField(names[f.name], f.dataType) for f in kept), *added]))
    return out.select(*[F.col(v).alias(k) for k, v in names.items()], *added.names)


def hits() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(share: int = 20) -> Column:
    """At least one word in `share` is hit."""
    return (hits() > 0) & (share * hits() >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The rows of docs that are not contaminated, unchanged."""
    return marked(docs, benchmark, text_col, **names).filter(~contaminated()).select(*docs.columns)
