"""SimHash near-duplicate detection: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, as_bytes, pieces, stored
from .graph import components

BITS = 64
#: Shingles hashed at once, so that one very long text needs no more memory than this.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all word shingles, as a signed 64-bit integer.
    No words: 0. Fewer words than `shingle`: the one shingle is the whole sequence."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, beside: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, beside..., fp long) for every row. Null and blank texts have fingerprint 0. No shuffle;
    a worker holds a piece of a batch at a time, and hashes a long text in chunks."""
    names = [id_col, *beside]
    out = T.StructType([*(docs.schema[c] for c in names), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for b in pieces(batch, text_col, 8 << 20):
                fp = pa.array([fingerprint(x, shingle) for x in as_bytes(b, text_col)], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), fp], names=[*names, "fp"])

    return docs.select(*names, text_col).mapInArrow(run, out)


def blocks(free: list[int], m: int) -> list[list[int]]:
    """The bit positions in m runs of nearly equal length."""
    return [[int(x) for x in part] for part in np.array_split(np.array(free), m) if len(part)]


def masks(free: list[int], m: int, k: int) -> list[tuple[int, list[int]]]:
    """For every choice of all but k of m blocks: the mask of its bits, and the bits left free.
    Two values that differ in at most k of the free bits agree under one of the masks at least."""
    parts = blocks(free, m)
    out = []
    for chosen in combinations(range(len(parts)), max(0, len(parts) - k)):
        bits = {b for i in chosen for b in parts[i]}
        mask = sum(1 << b for b in bits)
        out.append((mask - (1 << BITS) if mask >> (BITS - 1) else mask, [b for b in free if b not in bits]))
    return out


def links(values: DataFrame, k: int = 3, m: int = 6, hot: int = 256) -> DataFrame:
    """(a, b), a < b: every pair of distinct `fp` of values with at most k differing bits.

    Pairs come from buckets, the values that agree under a mask. A bucket of over `hot` values is
    not paired: its values are split again by the pigeonhole principle over the bits that are still
    free, with masks of their own, until buckets are small or so few bits are free (ten) that this
    bounds them. So the work stays in proportion to the values, and no link is lost. Each level is one
    plan for all buckets; its masks, whose number m and k bound, are a table of a few thousand rows."""
    spark = values.sparkSession
    vals = values.select("fp", F.lit(0).cast("long").alias("prior"), F.lit(0).alias("branch"))
    found, frees = None, [list(range(BITS))]
    while True:
        rows, after = [], []
        for branch, free in enumerate(frees):
            for mask, left in masks(free, m, k):
                rows.append((branch, mask, len(after)))
                after.append(left)
        if len(frees) == 1:
            masked = vals.select("fp", "prior", F.inline(F.array(*[F.struct(F.lit(mask).cast("long").alias("mask"), F.lit(n).alias("next")) for _, mask, n in rows])))
        else:
            masked = vals.join(F.broadcast(spark.createDataFrame(rows, "branch int, mask long, next int")), "branch")
        # Hash clashes of a key only add candidates.
        keys = masked.select(F.xxhash64("prior", "next", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "next")
        many = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        last = max(map(len, after)) <= 10
        cold = keys.join(many if last else many.filter(F.col("n") <= hot), "key").select("key", "fp")
        a, b = cold.select("key", F.col("fp").alias("a")), cold.select("key", F.col("fp").alias("b"))
        pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= k)).select("a", "b")
        found = pairs if found is None else found.union(pairs)
        if last or many.filter(F.col("n") > hot).isEmpty():
            return found.distinct()
        vals = stored(keys.join(many.filter(F.col("n") > hot), "key").select("fp", F.col("key").alias("prior"), F.col("next").alias("branch")))
        frees, m = after, k + 3  # each level leaves about half of the bits free


def rooted(nodes: DataFrame, k: int, hot: int) -> DataFrame:
    """nodes (distinct fp and more) with root: the smallest fingerprint of the component."""
    roots = components(links(nodes, k, hot=hot))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, k: int = 3, hot: int = 256) -> DataFrame:
    """One row for every row of docs: id_col, fp (long), component_id.

    Two documents are linked when their fingerprints differ in at most k of 64 bits; component_id is
    the smallest id that links reach, the document's own included (null only where every id of the
    component is null). Copies share a fingerprint and are one node, so their number adds no pairs.
    Null and blank texts have fingerprint 0 and are linked like any other. Repeated rows keep their
    own output rows; rows with one id and different texts are documents of their own. Ties can't be: an
    id stands for itself. Very long texts are read whole. Other columns of docs are not read. An empty
    table gives an empty one."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    nodes = rooted(prints.groupBy("fp").agg(F.min(id_col).alias("least")), k, hot)
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, k: int = 3, hot: int = 256) -> DataFrame:
    """docs with one row of each component, unchanged: the one with the smallest id (null after all
    others), and of several with that id the one with the smallest hash of the whole row.

    Components pick rows, not ids: a row is known by its id and a 128-bit hash of all its columns, so
    rows that share an id but not a text are judged each by its own component, and of rows that are
    equal in every column one stays. Texts move once, to meet the chosen keys; only texts of chosen rows
    that are there several times are grouped."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    every = [F.col(c) for c in plain.columns]
    id_, text = names[id_col], names[text_col]
    # A hash passes over nulls, so where they are is hashed too; maps have no hash of their own.
    parts = [F.to_json(F.struct(c)) if "map<" in plain.schema[c].dataType.simpleString() else F.col(c) for c in plain.columns]
    parts = [*[F.col(c).isNull() for c in plain.columns], *parts]
    keyed = plain.withColumns({"_k1": F.xxhash64(*parts), "_k2": F.xxhash64(F.lit(29), *parts[::-1])})
    prints = stored(fingerprints(keyed, id_, text, shingle, ("_k1", "_k2")))
    rows = stored(prints.groupBy("fp", id_, "_k1", "_k2").agg(F.count("*").alias("n")))
    key = F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col("_k1").alias("a"), F.col("_k2").alias("b"), F.col("n"))
    nodes = rooted(rows.groupBy("fp").agg(F.min(key).alias("key")), k, hot)
    chosen = stored(nodes.groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.a").alias("_k1"), F.col("key.b").alias("_k2"), "key.n"))
    one = keyed.join(chosen.filter("n = 1").select("_k1", "_k2"), ["_k1", "_k2"], "left_semi").select(*every)
    many = chosen.filter("n > 1").select("_k1", "_k2")
    if not many.isEmpty():
        first = keyed.join(many, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.first(F.struct(*every)).alias("row"))
        one = one.union(first.select(*[F.col(f"row.{c}") for c in plain.columns]))
    return one.toDF(*docs.columns)
