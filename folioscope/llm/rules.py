"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base figures and rule statistics are columns over the whole text. Cutoffs of the rules come from
labelled holdouts: the strictest level of a fixed ladder, for each stratum, up to which exact binomial
tests show that all rules together reject at most a given share of the good documents."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded, stored

#: Bits of a window's packed number that hold its position; longer texts compare all windows as words.
POSITION = 24
#: rule -> its loosest and its strictest cutoff.
RULES = {"symbols": (0.5, 0.02), "dup_lines": (0.9, 0.2), "repeats": (0.9, 0.2), "long_words": (40.0, 7.0), "pipes": (0.5, 0.02)}


@dataclass(frozen=True)
class Risk:
    """alpha: share of the good documents of a stratum, of those that pass the base rules, that all
    cutoffs together may reject; delta: chance that this fails in any stratum. steps: strictness levels;
    at each, every rule's cutoff goes by the same ratio from its loosest to its strictest. joined_rows,
    labelled_rows: strata, and ids of good documents, that are broadcast at most."""

    alpha: float = 0.02
    delta: float = 0.05
    steps: int = 20
    stratum: str = "lang"
    joined_rows: int = 10_000
    labelled_rows: int = 1_000_000

    def ladder(self, rule: str) -> list[float]:
        loose, strict = RULES[rule]
        return [round(loose * (strict / loose) ** (j / (self.steps - 1)), 9) for j in range(self.steps)]

    def least(self, strata: int) -> float:
        """Good documents that a stratum needs, if none is rejected, to pass as one of `strata` tests."""
        return math.log(max(1, strata) / self.delta) / -math.log1p(-self.alpha)


def figures(docs: DataFrame, id_col: str, text_col: str, stratum: str | None) -> DataFrame:
    """id_col, _stratum, the base figures, and a statistic for each of RULES (larger is worse)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(F.col(id_col).alias("_id"), (F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")).alias("_stratum"), text.alias("_text"))
    w = F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    two = one.select("_id", "_stratum", w.alias("_w"), lines.alias("_lines"), F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count("_text", F.lit("[|]")).alias("_pipes"))
    n = F.size("_w")
    at = lambda i: F.get("_w", i.cast("int"))
    # 40 bits of hash above the position: sorted as plain longs, equal windows are neighbours.
    packed = F.transform("_w", lambda x, i: F.shiftleft(F.xxhash64(x, at(i + 1), at(i + 2)), POSITION).bitwiseOR(i.cast("long")))
    order = F.when(n < 1 << POSITION, F.sort_array(F.slice(packed, F.lit(1), F.greatest(n - 2, F.lit(0)))))
    three = two.select("*", n.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.size("_lines").alias("_n_lines"), order.alias("_order")).drop("_lines")
    head = lambda x: F.shiftright(x, POSITION)
    beside = F.filter("_order", lambda x, i: F.coalesce(head(x) == head(F.get("_order", i - 1)), F.lit(False)) | F.coalesce(head(x) == head(F.get("_order", i + 1)), F.lit(False)))
    spots = F.transform(beside, lambda x: x.bitwiseAND(F.lit((1 << POSITION) - 1)))
    spots = F.when(F.col("_order").isNull(), F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 3, F.lit(0)).cast("int")), lambda i: i.cast("long"))).otherwise(spots)
    four = three.withColumn("_spots", spots).drop("_order")
    # Only windows whose hash has a neighbour are compared as words.
    full = F.sort_array(F.transform("_spots", lambda p: F.struct(F.concat_ws(" ", at(p), at(p + 1), at(p + 2)).alias("t"), p.alias("p"))))
    five = four.withColumn("_full", F.when(F.size("_spots") > 0, full)).drop("_spots")
    same = F.filter("_full", lambda x, i: F.coalesce(x["t"] == F.get("_full", i - 1)["t"], F.lit(False)) | F.coalesce(x["t"] == F.get("_full", i + 1)["t"], F.lit(False)))
    six = five.withColumn("_dups", F.when(F.col("_full").isNotNull(), F.sort_array(F.transform(same, lambda x: x["p"])))).drop("_full", "_w")
    cover = F.transform("_dups", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_dups", i + 1) - p, F.lit(3).cast("long"))))
    seven = six.withColumn("n_repeat_words", F.coalesce(F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return seven.select(
        "_id", "_stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols"), share("n_dup_lines", "_n_lines").alias("dup_lines"), share("n_repeat_words", "n_words").alias("repeats"),
        share("word_chars", "n_words").alias("long_words"), share("_pipes", "n_words").alias("pipes"),
    )


def lgamma(x: Column) -> Column:
    """Stirling's series, eight steps up; good to 1e-9 for x > 0."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - reduce(lambda a, b: a + b, [F.log(x + i) for i in range(8)])


#: Terms of a tail that are summed one by one.
TERMS = 20_000


def log_tail(k: Column, n: Column, p: float) -> Column:
    """Log of P(Binomial(n, p) <= k), for k <= n p: exact, the terms below k fall off from there. Past
    TERMS of them, whose ratio keeps falling, a geometric sum stands for the rest, which is never less."""
    top = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    ratio = lambda i: (k - i) / (n - k + i + 1) * ((1 - p) / p)
    step = lambda a, i: F.struct((a["term"] * ratio(i)).alias("term"), (a["total"] + a["term"]).alias("total"))
    last = F.least(k, F.lit(float(TERMS)))
    return top + F.log(F.aggregate(F.sequence(F.lit(0), last.cast("int")), start, step, lambda a: a["total"] + a["term"] / (1 - F.greatest(ratio(last + 1), F.lit(0.0)))))


def reached(how: Risk) -> Column:
    """The first level at which any rule rejects the document; `steps` if none does."""
    level = lambda r: F.size(F.filter(F.array(*[F.lit(x) for x in how.ladder(r)]), lambda c: F.col(r) <= c))
    return F.least(*[level(r) for r in RULES])


def certified(good: DataFrame, how: Risk) -> tuple[DataFrame, int | None]:
    """(_stratum, level) for each stratum with enough good documents for a test of its own, and the level
    of the pooled stratum of all, for the others; no level (null, None) where none is certified.

    good: _stratum and _step (see reached) of labelled good documents that pass the base rules. Levels
    are tested from the loosest on, each for all rules together, up to the first that fails; so the
    chance of an error isn't divided by levels or rules, only by the strata that could pass at all."""
    at = lambda: [F.count("*").alias("n"), *[F.count_if(F.col("_step") <= j).alias(f"k{j}") for j in range(how.steps)]]
    alone = good.groupBy("_stratum").agg(*at()).withColumn("pooled", F.lit(False))
    pooled = good.agg(*at()).select(F.lit("").alias("_stratum"), "n", *[f"k{j}" for j in range(how.steps)], F.lit(True).alias("pooled"))
    counts = stored(alone.union(pooled))
    tests = counts.filter(F.col("n") >= how.least(1)).count()
    rows = counts.filter(F.col("n") >= how.least(tests)).select("_stratum", "pooled", F.col("n").cast("double").alias("n"), F.posexplode(F.array(*[F.col(f"k{j}").cast("double") for j in range(how.steps)])).alias("j", "k"))
    good_enough = F.when(F.col("k") <= F.col("n") * how.alpha, log_tail(F.col("k"), F.col("n"), how.alpha) <= math.log(how.delta / max(1, tests))).otherwise(F.lit(False))
    levels = rows.groupBy("_stratum", "pooled").agg((F.coalesce(F.min(F.when(~good_enough, F.col("j"))), F.lit(how.steps)) - 1).alias("level"))
    levels = stored(levels.withColumn("level", F.when(F.col("level") >= 0, F.col("level"))))
    fallback = levels.filter("pooled").first()
    return levels.filter("not pooled").select("_stratum", "level"), fallback and fallback.level


def judged(docs: DataFrame, labels: DataFrame, how: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:  # noqa: B008
    """One row for every row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, level (the strictness that holds for its stratum; null: none).

    kept: the base rules pass, and no rule's cutoff at that level is exceeded. Of the good documents of
    a stratum that pass the base rules at most alpha are rejected, with the certainty of Risk. A stratum
    with too few labelled good documents for a test of its own goes by the level of all strata pooled,
    whose guarantee is for all documents together; a null stratum is one of its own. With too few
    labels in all, the base rules decide alone.

    A null or empty text has no words and fails the base rule. Texts are read whole, whatever their
    length. A statistic that equals its cutoff passes. Rows repeat as in docs, also in the counts; ids
    that repeat in labels count once, as good if any of their rows says so. A null id has no label.
    Without rows there is no output."""
    stats = stored(figures(docs, id_col, text_col, how.stratum if how.stratum in docs.columns else None).withColumn("_step", reached(how)).drop(*RULES))
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("_id")).distinct()
    alone, pooled = certified(stats.filter("not base_failed").join(bounded(good, how.labelled_rows), "_id", "left_semi").select("_stratum", "_step"), how)
    alone = bounded(alone.withColumn("_own", F.lit(True)), how.joined_rows)
    out = stats.join(alone, "_stratum", "left").withColumn("level", F.when(F.col("_own"), F.col("level")).otherwise(F.lit(pooled).cast("int")))
    beyond = F.coalesce(F.col("_step") <= F.col("level"), F.lit(False))
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"), "level")
