"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

BINS = 4096


@dataclass(frozen=True)
class Mix:
    """cycle: weights of the sources by code point (null last), repeating. share: words to take, as a
    part of all words. cap: times that a source or document is taken at most. short, long: relative
    copies of documents of under `floor` words and of the rest. joined_rows: per-source parameters are
    broadcast up to so many rows, and shuffled to the documents beyond."""

    cycle: tuple[int, ...] = (1, 2, 3)
    share: float = 1.0
    cap: int = 3
    floor: int = 50
    short: int = 1
    long: int = 2
    seed: int = 17
    joined_rows: int = 20_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, how: Mix, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs and, under names of our own: the source as a key that is never null, size, tier, and a
    uniform number in (0, 1) that depends on seed, id and text alone."""
    sign = F.md5(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    u = (F.conv(F.substring(sign, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    size = word_count(text_col)
    return docs.withColumns({"_key": F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")), "_size": size, "_u": u}).withColumn("_tier", F.when(F.col("_size") < how.floor, how.short).otherwise(how.long))


def numbered(keys: DataFrame, by: list) -> DataFrame:
    """keys with _at: the place of each in order, from 0. Ranges of the order are numbered each by itself,
    and start where the counts of the ranges before end; only those counts reach the driver."""
    ranges = stored(keys.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before, total = {}, 0
    for r in ranges.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        before[r["_range"]], total = total, total + r.n
    starts = keys.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_range int, _start long")
    inner = F.row_number().over(W.partitionBy("_range").orderBy(*by)) - 1
    return ranges.withColumn("_inner", inner).join(F.broadcast(starts), "_range").withColumn("_at", F.col("_start") + F.col("_inner")).drop("_range", "_start", "_inner")


def targets(strata: DataFrame, how: Mix) -> DataFrame:
    """(_key, _source_size, _target): weight times a common level, but cap times the size at most.
    Raising the level by what the capped sources can't take, until none is above, ends at the level
    where the targets add up to the share. Only sums of the source table reach the driver."""
    sources = strata.groupBy("_key").agg(F.sum("_words").alias("_source_size"))
    cycle = F.array(*[F.lit(x) for x in how.cycle])
    sources = numbered(sources, [F.col("_key") == "", F.col("_key")])
    sources = stored(sources.select("_key", "_source_size", F.element_at(cycle, (F.col("_at") % len(how.cycle) + 1).cast("int")).alias("_w")))
    most = F.col("_source_size") * how.cap
    total, weight = sources.agg(F.sum("_source_size"), F.sum("_w")).first()
    budget = how.share * (total or 0)
    rest, left = budget, weight or 0
    while left:
        capped = F.col("_w") * F.lit(float(rest)) >= most * F.lit(float(left))
        taken, loose = sources.agg(F.sum(F.when(capped, most)), F.sum(F.when(~capped, F.col("_w")))).first()
        if budget - (taken or 0) == rest and (loose or 0) == left:
            break
        rest, left = budget - (taken or 0), loose or 0
    level = rest / left if left else 0.0
    capped = F.lit(True) if not left else F.col("_w") * F.lit(float(rest)) >= most * F.lit(float(left))
    return sources.select("_key", "_source_size", F.when(capped, most.cast("double")).otherwise(F.col("_w") * F.lit(level)).alias("_target"))


def copies(strata: DataFrame, goals: DataFrame, how: Mix) -> DataFrame:
    """For each source and tier: whole copies that each document gets for certain, and the inclusion
    probability of one more. Expected copies are in proportion to the tier's weight, cap at most, and
    add up to the source's target. _rest: the words still to take by sampling."""
    by = W.partitionBy("_key").orderBy(F.desc("_tier"))
    before = F.coalesce(F.sum("_words").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * how.cap
    after = F.sum(F.col("_words") * F.col("_tier")).over(by.rowsBetween(0, W.unboundedFollowing))
    mu = F.when(after > 0, (F.col("_target") - before) / after)
    out = strata.join(goals, "_key").withColumns({"_mu": mu, "_fits": F.coalesce(mu * F.col("_tier") <= how.cap, F.lit(False))})
    level = F.max_by(F.when(F.col("_fits"), F.col("_mu")), F.when(F.col("_fits"), F.col("_tier"))).over(W.partitionBy("_key"))
    mean = F.least(F.lit(float(how.cap)), F.coalesce(level * F.col("_tier"), F.lit(float(how.cap))))
    mean = F.greatest(F.lit(0.0), F.when(F.abs(mean - F.round(mean)) < 1e-9, F.round(mean)).otherwise(mean))
    out = out.withColumn("_mean", mean).withColumns({"_whole": F.floor("_mean").cast("long"), "_pi": F.col("_mean") - F.floor("_mean")})
    return out.select("_key", "_tier", "_source_size", "_target", "_whole", "_pi", F.sum(F.col("_words") * F.col("_pi")).over(W.partitionBy("_key")).alias("_rest"))


def ranked(rows: DataFrame) -> DataFrame:
    """_v in (0, 1): the Pareto rank, u's odds divided by the odds of inclusion, on a scale x/(1+x)."""
    q = (F.col("_u") / (1 - F.col("_u"))) * ((1 - F.col("_pi")) / F.col("_pi"))
    return rows.withColumn("_v", F.when(F.col("_pi") > 0, q / (1 + q)))


def cutoffs(rows: DataFrame) -> DataFrame:
    """(_key, _cut): documents of a source with _v up to _cut are sampled. Those are the first in rank
    whose words come nearest to _rest. Sums by bin of the rank lead to the bin where a source's budget
    ends, sums by its sub-bins to the sub-bin, and only what is in there is looked at in order; equal
    ranks are one entry. So no task sees more of a hot source than a bin's sums."""
    rows = rows.filter("_v is not null").select("_key", "_size", "_v", "_rest")
    by = W.partitionBy("_key").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)

    def ends(part: DataFrame, at, floor: str) -> DataFrame:
        sums = part.withColumn("_bin", at).groupBy("_key", "_rest", "_bin").agg(F.sum("_size").alias("_words"), F.first(floor).alias("_floor"))
        run = sums.withColumn("_upto", F.sum("_words").over(by) + F.col("_floor"))
        last = run.filter(F.col("_upto") - F.col("_words") / 2 <= F.col("_rest")).groupBy("_key").agg(F.max("_bin").alias("_last"))
        first = run.filter(F.col("_upto") > F.col("_rest")).groupBy("_key").agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("_words")).alias("_floor"))).alias("_x"))
        return sums.select("_key").distinct().join(last, "_key", "left").join(first, "_key", "left").select("_key", "_last", F.col("_x._bin").alias("_open"), F.col("_x._floor").alias("_base"))

    one = stored(ends(rows.withColumn("_zero", F.lit(0.0)), F.floor(F.col("_v") * BINS).cast("double"), "_zero"))
    inner = rows.withColumn("_b", F.floor(F.col("_v") * BINS).cast("double")).join(one.filter("_open is not null").select("_key", F.col("_open").alias("_b"), "_base"), ["_key", "_b"])
    two = stored(ends(inner, F.floor(F.col("_v") * (BINS * BINS)).cast("double"), "_base"))
    last = inner.drop("_base", "_b").withColumn("_b", F.floor(F.col("_v") * (BINS * BINS)).cast("double")).join(two.filter("_open is not null").select("_key", F.col("_open").alias("_b"), "_base"), ["_key", "_b"])
    three = ends(last, F.col("_v"), "_base")
    cut = F.when(F.col("one._open").isNull(), F.lit(1.0)).otherwise(F.coalesce(F.col("three._last"), F.col("two._open") / float(BINS * BINS), F.col("one._open") / float(BINS)))
    return one.alias("one").join(two.alias("two"), "_key", "left").join(three.alias("three"), "_key", "left").select("_key", cut.alias("_cut"))


def planned(rows: DataFrame, how: Mix) -> DataFrame:
    """Everything that a document needs to know, for each source and tier."""
    strata = stored(rows.groupBy("_key", "_tier").agg(F.sum("_size").alias("_words")))
    params = stored(copies(strata, targets(strata, how), how))
    cut = cutoffs(ranked(joined(rows, params, how)))
    return stored(params.join(cut, "_key", "left"))


def joined(rows: DataFrame, params: DataFrame, how: Mix) -> DataFrame:
    small = params.limit(how.joined_rows + 1).count() <= how.joined_rows
    return rows.join(F.broadcast(params) if small else params, ["_key", "_tier"])


def drawn(rows: DataFrame, params: DataFrame, how: Mix) -> DataFrame:
    """rows with _copies: whole copies, and one more for those in the sample."""
    extra = F.coalesce(F.col("_v") <= F.col("_cut"), F.lit(False)).cast("long")
    return ranked(joined(rows, params, how)).withColumn("_copies", F.when(F.col("_size") > 0, F.col("_whole") + extra).otherwise(F.lit(0)))


def mix_sizes(docs: DataFrame, how: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:  # noqa: B008
    """One row for every row of docs: id_col, size, source_size, target, taken (words, with repeats).

    A null or blank text has size 0 and is never taken. A null source is a source. Equal rows share
    their fate, ranks that tie are taken or left together, and the same input gives the same draw. Long
    texts are counted whole. An empty table gives an empty one; other columns are not read."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    rows = stored(measured(plain, how, "id", "text", "source").select("id", "_key", "_size", "_tier", "_u"))
    out = drawn(rows, planned(rows, how), how)
    return out.select(F.col("id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame, how: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:  # noqa: B008
    """The documents that the mix takes, with all their columns, `copies`, and the words `taken`;
    columns of docs with these two names are replaced. Nulls, ties, repeated rows: as in mix_sizes()."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = measured(docs.toDF(*names.values()), how, names[id_col], names[text_col], names[source_col])
    small = stored(rows.select("_key", "_size", "_tier", "_u"))
    out = drawn(rows, planned(small, how), how).filter("_copies > 0")
    kept = [F.col(v).alias(k) for k, v in names.items() if k not in ("copies", "taken")]
    return out.select(*kept, F.col("_copies").alias("copies"), (F.col("_size") * F.col("_copies")).alias("taken"))
