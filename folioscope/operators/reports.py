"""Report logs: latest row per book, summaries, resumable work, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bar, col, elapsed, percent

UNKNOWN = "?"


def keyed(rows: DataFrame) -> DataFrame:
    """Missing parts of the book key, and a missing status, become '?'."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in ("source", "book_id", "status") if c in rows.columns})


def latest(rows: DataFrame, keys: list[str], order: list[str], prefer: Column | None = None) -> DataFrame:
    """The last row of each key in the order of `order`, whose columns must not tie within a key. One
    aggregate with sums by task before the shuffle, so that a key with many rows is no hot spot.

    prefer: rows for which it holds come before all others, however old."""
    rank = F.struct(*([F.coalesce(prefer, F.lit(False))] if prefer is not None else []), *order)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])


def latest_per_book(rows: DataFrame, order: list[str] | None = None, prefer_ok: bool = False) -> DataFrame:
    """The newest row of each (source, book_id) in a log. A later `skipped` row hides an `ok` one, as in
    the log's own reading; prefer_ok keeps the newest `ok` row where there is one."""
    rows = keyed(rows)
    return latest(rows, ["source", "book_id"], order or ["file", "line_no"], F.col("status") == "ok" if prefer_ok else None)


def output_mb(profile: str) -> Column:
    return F.coalesce(F.try_element_at("outputs", F.lit(profile))["mb"], F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """To some digits, half up. Nine digits first: a sum's last bits, which depend on the order of its
    rows, then don't tip a half."""
    return F.round(F.round(x, 9), digits)


def metrics(rows: DataFrame) -> list[Column]:
    """The figures of a summary. Minutes are of all rows, pages and megabytes of the `ok` ones; the
    mean takes skipped and failed books too."""
    ok = F.col("status") == "ok"
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.coalesce(c, F.lit(0)))), F.lit(0))
    pages, mb = total(F.col("n_pages")), total(F.col("pdf_mb").cast("double"))
    minutes = F.coalesce(F.sum(F.coalesce(F.col("minutes"), F.lit(0.0))), F.lit(0.0))
    archival = total(output_mb("archival")) if "outputs" in rows.columns else total(F.lit(0.0))
    ratio = lambda a, b: a / F.nullif(b.cast("double"), F.lit(0.0))
    return [
        F.count("*").alias("books"), F.count_if(ok).alias("produced"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "error").alias("errors"),
        pages.cast("long").alias("pages"), rounded(mb, 1).alias("pdf_mb"), rounded(archival, 1).alias("archival_mb"), rounded(ratio(mb, pages), 3).alias("mb_per_page"),
        total(F.col("ocr_chars")).cast("long").alias("ocr_chars"), rounded(minutes, 1).alias("minutes"), rounded(ratio(pages, minutes), 1).alias("pages_per_min"), rounded(ratio(minutes, F.count("*")), 2).alias("mean_minutes_per_book"),
    ]


def summarize(rows: DataFrame) -> DataFrame:
    """One row of figures; zeros, and null ratios, for no rows."""
    return rows.agg(*metrics(rows))


def summarize_by_source(rows: DataFrame) -> DataFrame:
    return keyed(rows).groupBy("source").agg(*metrics(rows))


def with_total(rows: DataFrame, name: str = "TOTAL") -> DataFrame:
    """Figures by source, and of all of them, from one pass (rollup)."""
    out = keyed(rows).rollup("source").agg(F.grouping("source").alias("_all"), *metrics(rows))
    return out.withColumn("source", F.when(F.col("_all") == 1, F.lit(name)).otherwise(F.col("source"))).filter((F.col("_all") == 0) | (F.col("books") > 0)).drop("_all")


def tally(rows: DataFrame, by: str = "status", missing: str = "error") -> DataFrame:
    """Rows by status. A run counts a missing one as an error, a summary as '?'."""
    return rows.groupBy(F.coalesce(F.col(by), F.lit(missing)).alias(by)).agg(F.count("*").alias("n"))


def as_map(counts: DataFrame, key: str = "status", value: str = "n") -> DataFrame:
    """One row with a map of the counts."""
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("by_status"))


def merged_totals(*parts: DataFrame) -> DataFrame:
    """Counts of several runs or sources, added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy("status").agg(F.sum("n").alias("n"))


def already_done(log: DataFrame, key: str = "book_id", done: tuple[str, ...] = ("published", "skipped")) -> DataFrame:
    """Keys with such a status anywhere in the log, not only in their latest row."""
    return log.filter(F.col("status").isin(*done)).select(key).distinct()


def remaining(work: DataFrame, done: DataFrame, key: str = "book_id", limit: int | None = None, force: bool = False) -> DataFrame:
    """The work that isn't done. The limit comes first, in key order, so that it counts done work too;
    force takes all."""
    picked = work.orderBy(key).limit(limit) if limit else work
    return picked if force else picked.join(done.select(key), key, "left_anti")


def not_produced(work: DataFrame, listing: DataFrame, path: Column) -> DataFrame:
    """The books whose main PDF isn't in a listing of files (path)."""
    return work.withColumn("_path", path).join(listing.select(F.col("path").alias("_path")), "_path", "left_anti").drop("_path")


def published(log: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Status counts of the newest row of each book in an import log."""
    return tally(latest_per_book(log, order), missing=UNKNOWN)


def progress_table(sources: DataFrame, summary: DataFrame, totals: DataFrame) -> DataFrame:
    """A row for every configured source, with or without reports: figures, per cent, bar, and the
    minutes to go at the mean pace."""
    out = sources.select("source").join(totals.select("source", "total"), "source", "left").join(summary, "source", "left")
    books = F.coalesce(F.col("books"), F.lit(0))
    left = F.greatest(F.coalesce("total", F.lit(0)) - books, F.lit(0))
    return out.select("source", "total", books.alias("books"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("produced", "skipped", "errors", "pages")], F.round(percent(books, "total"), 1).alias("pct"), bar(books, "total").alias("bar"), F.when(left > 0, F.round(left * F.col("mean_minutes_per_book"), 1)).alias("eta_minutes"))


def eta(minutes: str | Column) -> Column:
    """Hours from 90 minutes on."""
    m = col(minutes)
    return F.when(m >= 90, F.format_string("~ETA %.1f h", m / 60)).otherwise(F.format_string("~ETA %.0f min", m.cast("double")))


def active(beats: DataFrame, now: float | Column, ttl: float = 3600.0) -> DataFrame:
    """Workers whose heartbeat is `ttl` seconds old at most, the longest at work first."""
    at = F.lit(now) if not isinstance(now, Column) else now
    started = F.coalesce("started_at", F.lit(0.0))
    return beats.filter(at - F.coalesce("updated_at", F.lit(0.0)) <= ttl).withColumn("elapsed", at - started).withColumn("elapsed_text", elapsed(at - started)).orderBy(started, *[c for c in ("source", "book_id") if c in beats.columns])


def size_stats(files: DataFrame, source: str = "source", book: str = "book_id", size: str = "size") -> DataFrame:
    """Books, pages and bytes of each source, from a listing of pages."""
    return files.groupBy(source).agg(F.count_distinct(book).alias("n_books"), F.count("*").alias("n_pages"), F.sum(size).alias("total_bytes"))


def totals_of_nested(books: DataFrame) -> DataFrame:
    """n_pages and total_bytes of each book from its nested pages."""
    return books.withColumns({"n_pages": F.size("pages").cast("long"), "total_bytes": F.aggregate("pages", F.lit(0).cast("long"), lambda a, p: a + p["size"])})


def first_of_order(rows: DataFrame, keys: list[str], order: list[str | Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    by = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= n).drop("_n")
