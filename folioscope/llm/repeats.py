"""Suffix-array dedup by prefix-free parsing: dictionary and parse, put in corpus order.

Every byte covered by a string of `length` bytes that also starts elsewhere goes. The steps:

1. Rolling hashes of GRAM bytes trigger phrases: of the places where a string of `length` bytes can have
   a trigger, the one with the least hash (the leftmost of equals) is its own. Which one that is depends
   on the string alone. A phrase goes from a trigger to the end of the next one, and which one is next
   is told by the text up to there, so no phrase is a proper prefix of another. One pass over the texts
   writes the parse: for each trigger its hash, its place, and the starts of the strings it belongs to.
2. Triggers whose gram occurs once in the corpus can't be of a repeated string. The others are entries;
   equal ones (same text before and after, as far as their strings reach) are one, with a count. Entries
   that occur twice are repeated in whole, so only grams with an entry that occurs once remain open.
3. Corpus order of what is open, bucket by bucket of the trigger's gram: the distinct phrases are sorted,
   which gives the dictionary's order and ranks; texts from a trigger on are sequences of those ranks,
   the parse, and doubling puts its suffixes in order; the texts before triggers, read backwards, give
   the order of the phrases' own suffixes. Neighbours' common lengths in both orders tell which strings,
   a phrase suffix of x bytes and length - x bytes of the parse from there, stand next to an equal one.
   A bucket that is too large for a task is split by halves of the range of x, whose strings have more
   text in common to be dealt by, and those again, until each part fits or is one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, stored

U = np.uint64
_A = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


@dataclass(frozen=True)
class Repeat:
    """length: bytes of a string that counts. gram: bytes of a trigger. piece: text hashed at once; a
    longer text comes in parts. hot: entries of a bucket that one task orders together; larger buckets
    are split. most: entries of many buckets that are put in order at once."""

    length: int = 200
    gram: int = 64
    piece: int = 2 << 20
    hot: int = 2048
    most: int = 40_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * _A[4]
    h = (h ^ (h >> U(29))) * _A[5]
    return h ^ (h >> U(32))


def ladder(b: np.ndarray, top: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4, ... top bytes from each place, by doubling."""
    out = [(b.astype(np.uint64) + U(1)) * _A[0]]
    size = 1
    while size < top:
        h = out[-1]
        out.append(mixed(h[:-size] * _A[1] + (h[size:] ^ _A[2])) if len(h) > size else h[:0])
        size *= 2
    return out


def span_hash(rungs: list[np.ndarray], at: np.ndarray, size: np.ndarray, seed: U) -> np.ndarray:
    """A hash of the `size` bytes from each place `at`: of two overlapping rungs and the size."""
    out = np.zeros(len(at), np.uint64)
    k = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
    k = np.minimum(k, len(rungs) - 1)
    for rung in np.unique(k):
        m = np.flatnonzero(k == rung)
        h, step = rungs[rung], 1 << int(rung)
        x = h[at[m]] * _A[3] + seed
        pos, end = at[m] + step, at[m] + size[m] - step
        while True:  # sizes of over two of the largest rungs take more steps
            go = pos < end
            if not go.any():
                break
            x[go] = mixed(x[go] * _A[6] + h[pos[go]])
            pos = pos + step
        x = mixed(x * _A[7] + h[np.maximum(end, at[m])])
        out[m] = mixed(x + size[m].astype(np.uint64) * _A[5])
    return np.where(size > 0, out, seed)


def least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each `width` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    rest = width - size
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


@dataclass
class Anchors:
    """Entries of a buffer: anchor place a, starts i0..i1 (all in the buffer), document, gram hash,
    and the hash of the whole entry, bytes i0 to i1 + length."""

    doc: np.ndarray
    a: np.ndarray
    i0: np.ndarray
    i1: np.ndarray
    gram: np.ndarray
    whole: np.ndarray


def anchors(buffer: np.ndarray, starts: np.ndarray, how: Repeat) -> Anchors | None:
    """starts: where the documents of the buffer begin, and its length last."""
    n, w = len(buffer), how.length - how.gram + 1
    if n < how.length:
        return None
    rungs = ladder(buffer, how.gram)
    h = rungs[-1]
    key = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    spot = (least(key, w) & U(0xFFFFFFFF)).astype(np.int64)  # the anchor of each start
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(spot)]
    good = np.arange(len(spot)) + how.length <= starts[doc + 1]
    at = np.flatnonzero(good)
    if not len(at):
        return None
    a = spot[at]
    new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(at) > 1)])
    first = np.flatnonzero(new)
    end = np.concatenate([first[1:], [len(at)]]) - 1
    i0, i1, a = at[first], at[end], a[first]
    size = i1 - i0 + how.length
    offset = (a - i0).astype(np.uint64) * _A[6]
    return Anchors(doc[i0], a, i0, i1, h[a], mixed(span_hash(rungs, i0, size, _A[3]) + offset))


def buffers(batch: pa.RecordBatch, column: str, how: Repeat):
    """Pieces of the texts that are long enough: (row numbers, offsets in the texts, bytes as one array,
    where each part begins and the end). A text of over `piece` bytes comes in parts that overlap by
    length - 1 bytes, so that each of its strings is in one."""
    values = batch.column(column).cast(pa.binary())
    parts: list[tuple[int, int, np.ndarray]] = []
    total = 0

    def whole():
        return np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), np.cumsum([0, *(len(p[2]) for p in parts)])

    for row, v in enumerate(values):
        x = v.as_buffer()
        if x is None or x.size < how.length:
            continue
        text = np.frombuffer(x, np.uint8)
        for at in range(0, len(text) - how.length + 1, how.piece):
            part = text[at : at + how.piece + how.length - 1]
            if parts and total + len(part) > how.piece:
                yield whole()
                parts, total = [], 0
            parts.append((row, at, part))
            total += len(part)
    if parts:
        yield whole()


ENTRY = "gram long, whole long, k1 long, k2 long, a int, before int, after int"


def parse(docs: DataFrame, how: Repeat) -> DataFrame:
    """The parse: a row for each trigger, with its gram, a hash of its whole entry, the text's key, its
    place a in the text, and its starts from a - before to a - after."""

    def run(batches):
        for b in batches:
            k1, k2 = (b.column(k).to_numpy() for k in ("k1", "k2"))
            for rows, offsets, data, starts in buffers(b, "text", how):
                if (f := anchors(data, starts, how)) is None:
                    continue
                row, a = rows[f.doc], f.a - starts[f.doc] + offsets[f.doc]
                columns = [f.gram.view(np.int64), f.whole.view(np.int64), k1[row], k2[row], a.astype(np.int32), (f.a - f.i0).astype(np.int32), (f.a - f.i1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in ENTRY.split(", ")])

    return docs.select("k1", "k2", "text").mapInArrow(run, ENTRY)


PART = "gram long, whole long, n long, size long, after int, before int, phrase binary, follow binary"


def contexts(docs: DataFrame, wanted: DataFrame, how: Repeat) -> DataFrame:
    """PART of each wanted entry: its bytes before the trigger and from there. wanted has one entry of
    each kind; they meet their text by its key. Copies of a text may give a row more than once."""
    # Written first, so that the join may split the copies of a text over tasks.
    by_text = stored(wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "whole", "n", "size", "a", "before", "after")).alias("list")))

    def run(batches):
        seen = None
        for b in batches:
            texts, lists = b.column("text").cast(pa.binary()), b.column("list")
            keys = list(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True))
            for row, key in enumerate(keys):
                if key == seen:  # copies come one after the other
                    continue
                seen, text = key, memoryview(texts[row].as_buffer())
                for at in range(0, len(lists[row]), 4096):
                    w = pa.RecordBatch.from_struct_array(lists[row].values.slice(at, 4096))
                    a, before, after = (w.column(c).to_pylist() for c in ("a", "before", "after"))
                    phrase = pa.array([bytes(text[x - y : x]) for x, y in zip(a, before, strict=True)], pa.binary())
                    follow = pa.array([bytes(text[x : x - z + how.length]) for x, z in zip(a, after, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(w.column(c) for c in ("gram", "whole", "n", "size", "after", "before")), phrase, follow], names=["gram", "whole", "n", "size", "after", "before", "phrase", "follow"])

    return docs.join(by_text, ["k1", "k2"]).select("k1", "k2", "text", "list").mapInArrow(run, PART)


def common(rows: list[bytes]) -> np.ndarray:
    """Length of the common start of each row and the one before it; 0 for the first."""
    width, step = max(map(len, rows), default=0) + 1, 8192
    out = [np.zeros(min(1, len(rows)), np.int64)]
    for s in range(0, len(rows) - 1, step):
        part = rows[s : s + step + 1]
        m = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in part), np.uint8).reshape(len(part), width)
        size, differ = np.array(list(map(len, part))), m[1:] != m[:-1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        out.append(np.minimum(first, np.minimum(size[1:], size[:-1])))
    return np.concatenate(out)


class Least:
    """Minima of any ranges of an array, from those of 1, 2, 4 ... neighbours."""

    def __init__(self, a: np.ndarray):
        self.rungs = [a]
        while 2 << (len(self.rungs) - 1) <= len(a):
            step, last = 1 << (len(self.rungs) - 1), self.rungs[-1]
            self.rungs.append(np.minimum(last[:-step], last[step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of a[low..high], both included, low <= high."""
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(low), np.int64)
        for rung in np.unique(k):
            m = np.flatnonzero(k == rung)
            out[m] = np.minimum(self.rungs[rung][low[m]], self.rungs[rung][high[m] - (1 << int(rung)) + 1])
        return out


def phrases(rows: list[bytes], gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of texts that begin with a trigger: row, first and last byte (not included) of each.
    Within `length` bytes a later place is a trigger if its hash is less than all before."""
    size = np.array(list(map(len, rows)), np.int64)
    data = np.frombuffer(b"".join(rows), np.uint8)
    begin = np.cumsum(size) - size
    h = (ladder(data, gram)[-1] >> U(32)).astype(np.uint32)
    width = int(size.max()) - gram + 1
    at = begin[:, None] + np.arange(width)
    value = np.where(np.arange(width) <= (size - gram)[:, None], h[np.minimum(at, len(h) - 1)], np.uint32(0xFFFFFFFF))
    least_so_far = np.minimum.accumulate(value, axis=1)
    trigger = np.ones(value.shape, bool)
    trigger[:, 1:] = value[:, 1:] < least_so_far[:, :-1]
    row, first = np.nonzero(trigger)
    last = np.append(first[1:], 0) + gram
    ends = np.append(row[1:] != row[:-1], True)
    last[ends] = size[row[ends]]
    return row, first, last


def parse_order(rows: list[bytes], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each text in the order of the parse's suffixes, and the common length of each in order with
    the one before it: as many equal phrases, and what the dictionary's order says of the next two."""
    row, first, last = phrases(rows, gram)
    words = [rows[r][s:e] for r, s, e in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)]
    dictionary = sorted(set(words))
    number = {w: i for i, w in enumerate(dictionary)}
    ranks = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    shared = Least(common(dictionary))
    begin = np.searchsorted(row, np.arange(len(rows)))
    count = np.diff(np.append(begin, len(row)))
    # Doubling: order by 1, 2, 4 ... phrases; a suffix that has ended comes first.
    order, step = ranks, 1
    left = count[row] - (np.arange(len(row)) - begin[row])
    while step < count.max():
        next_ = np.zeros(len(order), np.int64)
        more = np.flatnonzero(left > step)
        next_[more] = order[more + step] + 1
        order = np.unique(order * (int(order.max()) + 2) + next_, return_inverse=True)[1]
        step *= 2
    place = np.argsort(order[begin], kind="stable")
    rank = np.empty(len(rows), np.int64)
    rank[place] = np.arange(len(rows))
    out = np.zeros(len(rows), np.int64)
    size = np.array(list(map(len, rows)), np.int64)
    a, b, depth, on = place[:-1], place[1:], 0, np.arange(len(rows) - 1)
    while len(on):
        ended = np.minimum(count[a[on]], count[b[on]]) <= depth
        out[on[ended] + 1] = np.minimum(size[a[on[ended]]], size[b[on[ended]]])
        on = on[~ended]
        x, y = begin[a[on]] + depth, begin[b[on]] + depth
        differ = ranks[x] != ranks[y]
        low, high = np.minimum(ranks[x], ranks[y])[differ], np.maximum(ranks[x], ranks[y])[differ]
        out[on[differ] + 1] = first[x[differ]] + shared.of(low + 1, high)
        on, depth = on[~differ], depth + 1
    return rank, out


def suffix_order(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for phrases that end at a trigger, read backwards: the order of their suffixes."""
    back = [p[::-1] for p in rows]
    order = sorted(range(len(back)), key=back.__getitem__)
    rank = np.empty(len(back), np.int64)
    rank[order] = np.arange(len(back))
    return rank, common([back[i] for i in order])


def resolved(bucket: np.ndarray, phrase: list[bytes], follow: list[bytes], low: np.ndarray, high: np.ndarray, n: np.ndarray, how: Repeat) -> list[list[tuple[int, int]]]:
    """For each entry the runs (x from, x to), within low..high, of phrase suffix lengths at which its
    string repeats in its bucket: strings with suffix length x are equal if and only if no neighbours
    between them have less than x in common in the order of phrase suffixes and none less than
    length - x in the order of the parse."""
    p_rank, p_common = suffix_order(phrase)
    f_rank, f_common = parse_order(follow, how.gram)
    size = len(phrase) + 1
    hit = np.zeros((len(phrase), int(high.max()) + 2), bool)
    for x in range(int(low.min()), int(high.max()) + 1):
        on = np.flatnonzero((low <= x) & (x <= high))
        if not len(on):
            continue
        same_p, same_f = np.cumsum(p_common < x)[p_rank[on]], np.cumsum(f_common < how.length - x)[f_rank[on]]
        _, which = np.unique((bucket[on] * size + same_p) * size + same_f, return_inverse=True)
        hit[on, x] = np.bincount(which, n[on])[which] > 1
    edge = np.diff(hit.astype(np.int8), axis=1, prepend=0)
    out: list[list[tuple[int, int]]] = [[] for _ in phrase]
    rows, starts = np.nonzero(edge == 1)
    _, ends = np.nonzero(edge == -1)
    for r, s, e in zip(rows.tolist(), starts.tolist(), (ends - 1).tolist(), strict=True):
        out[r].append((s, e))
    return out


RUNS = "gram long, whole long, runs array<struct<x0:int,x1:int>>"
_RUNS = pa.schema([("gram", pa.int64()), ("whole", pa.int64()), ("runs", pa.list_(pa.struct([("x0", pa.int32()), ("x1", pa.int32())])))])


def ordered(parts: DataFrame, how: Repeat) -> DataFrame:
    """Runs of the entries that occur once, from the order of their buckets (column `key`), of which a
    task takes one after the other and puts as many in order at once as make `most` entries."""
    names = ["key", "lo", "hi", "gram", "whole", "n", "after", "before", "phrase", "follow"]

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        key, lo, hi, gram, whole, n, after, before, phrase, follow = (list(c) for c in zip(*rows, strict=True))
        bucket = np.unique(np.array(key), return_inverse=True)[1]
        runs = resolved(bucket, phrase, follow, np.maximum(lo, after), np.minimum(hi, before), np.array(n), how)
        keep = [i for i, r in enumerate(runs) if r and n[i] == 1]
        return pa.RecordBatch.from_pydict({"gram": [gram[i] for i in keep], "whole": [whole[i] for i in keep], "runs": [[{"x0": a, "x1": b} for a, b in runs[i]] for i in keep]}, schema=_RUNS)

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, seen = None, set()
        for b in (batch.slice(i, 4096) for batch in batches for i in range(0, batch.num_rows, 4096)):
            for r in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if r[0] != key:
                    key, seen = r[0], set()
                    if len(rows) >= how.most:
                        yield solve(rows)
                        rows = []
                if (r[3], r[4]) not in seen:
                    seen.add((r[3], r[4]))
                    rows.append(r)
        if rows:
            yield solve(rows)

    return parts.select(*names).repartition("key").sortWithinPartitions("key").mapInArrow(run, RUNS)


def halves(rows: DataFrame, how: Repeat) -> DataFrame:
    """Rows of PART with lo, hi, once for each half of that range that they have starts in, and new keys:
    hashes of what all strings of the half have in common, lo bytes before the trigger and length - hi
    from there. When lo is hi that is the whole string."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(F.col("lo").alias("l"), mid.alias("h")), F.struct((mid + 1).alias("l"), F.col("hi").alias("h")))
    rows = rows.drop("key", "key2").withColumn("half", F.explode(parts)).withColumns({"lo": F.col("half.l"), "hi": F.col("half.h")}).drop("half")
    rows = rows.filter("lo <= hi and after <= hi and before >= lo")
    core = [F.col("lo"), F.col("hi"), F.substring("phrase", F.length("phrase") - F.col("lo") + 1, F.col("lo")), F.substring("follow", F.lit(1), how.length - F.col("hi"))]
    return rows.withColumns({"key": F.xxhash64(*core), "key2": F.xxhash64(F.lit(5), *core[::-1])})


def decided(parts: DataFrame, how: Repeat) -> DataFrame:
    """RUNS of the open entries; an entry whose bucket was split may have several rows."""
    rows = parts.withColumns({"key": F.col("gram"), "lo": F.lit(0), "hi": F.lit(how.length - how.gram)})
    out = [ordered(rows.filter(F.col("size") <= how.hot), how)]
    rows = rows.filter(F.col("size") > how.hot)
    if rows.isEmpty():
        return out[0]
    rows = rows.dropDuplicates(["gram", "whole"])
    while True:
        rows = stored(halves(rows.drop("size"), how))
        sizes = stored(rows.groupBy("key", "key2").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1 and least = 1").drop("least"))
        rows = stored(rows.join(sizes, ["key", "key2"]))
        one = rows.filter("lo = hi and n = 1").select("gram", "whole", F.array(F.struct(F.col("lo").alias("x0"), F.col("hi").alias("x1"))).alias("runs"))
        out += [one, ordered(rows.filter((F.col("size") <= how.hot) & (F.col("lo") < F.col("hi"))), how)]
        rows = rows.filter((F.col("size") > how.hot) & (F.col("lo") < F.col("hi")))
        if rows.isEmpty():
            break
    result = out[0]
    for x in out[1:]:
        result = result.union(x)
    return result


def removed(docs: DataFrame, text_col: str = "text", how: Repeat = Repeat()) -> DataFrame:  # noqa: B008
    """docs with k1, k2 (a key of the text) and cuts array<struct<s, e>>: bytes of the UTF-8 text that a
    repeated string covers, in pieces that may overlap, null where there are none. docs needs its text
    in a column of its own name `text`; see repeats()."""
    keyed = docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    plain = keyed.filter(F.octet_length("text") >= how.length).select("k1", "k2", "text")
    places = stored(parse(plain, how))
    # Counts are written before the joins by gram, so that a frequent gram's rows may be split over tasks.
    grams = stored(places.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
    found = stored(places.join(grams, "gram"))
    released(places, grams)
    kinds = stored(found.groupBy("gram", "whole").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("k1", "k2", "a", "before", "after")]))
    buckets = stored(kinds.groupBy("gram").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1 and least = 1").select("gram", "size"))
    parts = stored(contexts(plain, stored(kinds.join(buckets, "gram")), how))
    every = kinds.filter("n > 1").select("gram", "whole", F.lit(None).cast("array<struct<x0:int,x1:int>>").alias("runs"))
    verdict = every.union(decided(parts, how))
    runs = F.coalesce("runs", F.array(F.struct(F.col("after").alias("x0"), F.col("before").alias("x1"))))
    cut = found.join(verdict, ["gram", "whole"]).select("k1", "k2", "a", F.explode(runs).alias("x")).select("k1", "k2", (F.col("a") - F.col("x.x1")).alias("s"), (F.col("a") - F.col("x.x0") + how.length).alias("e"))
    cuts = stored(cut.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("cuts")))
    released(found, kinds, parts)
    return keyed.join(cuts, ["k1", "k2"], "left")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Repeat = Repeat()) -> DataFrame:  # noqa: B008
    """One row for every row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, and kept, the
    bytes that stay.

    Strings are judged on the input. A null text is empty; texts of under `length` bytes have nothing to
    remove; copies of a longer text lose every byte, and so do repeated rows of one. A very long text is
    read in parts that overlap. Nothing ties: all places of a repeated string go. Rows repeat as in docs,
    an empty table gives an empty one; other columns aren't read. Hashes decide which texts and entries
    are equal: 64 bits each for the gram and the entry, 128 for the text and for a string by itself."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for text, cuts in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("cuts").to_pylist(), strict=True):
                left, at, spans = [], 0, 0
                gone = 0
                for c in sorted(cuts or (), key=lambda c: (c["s"], c["e"])):
                    s, e = c["s"], c["e"]
                    if s > at or not spans:
                        left.append(text[at:s])
                        spans, gone, at = spans + 1, gone + e - s, e
                    elif e > at:
                        gone, at = gone + e - at, e
                kept = b"".join([*left, text[at:]])
                out.append((len(text), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=schema.names)

    return removed(base, how=how).select("id", "text", "cuts").mapInArrow(run, schema)
