"""Catalog matching: two-key lookup with stubs, match reports, enrichment, draft rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bib import coerce_year, faculty_name, split_authors
from ..functions.ids import derive_isbn, deslug, directory_token, guess_title, is_valid_isbn, normalize_id
from ..functions.text import clean, first_true
from ..sources.state import written

# Fields of a record, and the columns of a catalog that they come from by default.
FIELDS = ("title", "subtitle", "authors", "year", "publisher", "isbn", "faculty", "language", "catalog")
COLUMNS = {"directory": "directory_id", "title": "title", "authors": "authors", "year": "year", "publisher": "publisher", "isbn": "isbn", "faculty": "faculty", "language": "language"}
RECORD = "struct<book_id:string,title:string,subtitle:string,authors:array<string>,year:int,publisher:string,isbn:string,faculty:string,language:string,catalog:string,matched:boolean>"
#: Rows of a catalog that are broadcast to the books at most; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: The sheet's columns, in order.
DRAFT = {"directory_id": "directory_id", "faculty": "fakulta", "n_pages": "počet_strán", "isbn": "ISBN", "title": "názov", "subtitle": "podnázov", "authors": "autori", "year": "rok_vydania", "publisher": "vydavateľ", "place": "miesto_vydania", "edition": "vydanie", "language": "jazyk", "catalog": "cieľový_katalog", "notes": "poznámka", "source_meta": "zdroj_metadat"}


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def records(sheet: DataFrame, columns: Mapping[str, str] | None = None, order: str | None = None) -> DataFrame:
    """(row_no, rec) of a catalog's rows. `columns` maps fields to headers; an unknown field is an
    error, an absent header gives null. Rows without directory, title and ISBN go.

    order: the column that tells which row comes first; without it rows are numbered as they are read."""
    columns = dict(columns or COLUMNS)
    if unknown := set(columns) - {*FIELDS, "directory"}:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    cell = lambda f: clean(F.col(f"`{columns[f]}`")) if columns.get(f) in sheet.columns else F.lit(None).cast("string")
    rows = sheet.select((F.col(order) if order else F.monotonically_increasing_id()).alias("row_no"), *[cell(f).alias(f) for f in (*FIELDS, "directory")])
    rows = rows.filter(F.coalesce("directory", "title", "isbn").isNotNull())
    rec = F.struct(
        F.coalesce("directory", "isbn", "title").alias("book_id"), F.coalesce(F.col("title"), deslug("directory"), F.col("isbn"), F.lit("Untitled")).alias("title"), F.col("subtitle"),
        F.coalesce(split_authors("authors"), F.array().cast("array<string>")).alias("authors"), coerce_year("year").alias("year"), F.col("publisher"), F.col("isbn"), F.col("faculty"), F.col("language"), F.col("catalog"), F.lit(True).alias("matched"),
    )
    return rows.select("row_no", rec.cast(RECORD).alias("rec"))


def index(recs: DataFrame, key: Column, name: str) -> DataFrame:
    """The first record of each key: a hash index of the catalog. Rows without a key aren't in it."""
    return recs.select(normalize_id(key).alias(name), "row_no", "rec").filter(F.col(name).isNotNull()).groupBy(name).agg(F.min_by("rec", "row_no").alias(f"{name}_rec"))


def lookup(books: DataFrame, recs: DataFrame, key_field: str = "isbn", faculty: str | None = None) -> DataFrame:
    """books with rec: by the key field and the id in the directory's name first, then by the name, else
    a stub. A record is taken whole, and its book_id becomes the book's."""
    out = books.withColumns({"_by_key": normalize_id(directory_token("book_id")), "_by_dir": normalize_id("book_id")})
    if key_field in FIELDS:
        out = out.join(small(index(recs, F.col("rec")[key_field].cast("string"), "_by_key")), "_by_key", "left")
    else:
        out = out.withColumn("_by_key_rec", F.lit(None).cast(RECORD))
    out = out.join(small(index(recs, F.col("rec.book_id"), "_by_dir")), "_by_dir", "left")
    # Plain columns first: each is worked out once, and the record picks from them field by field.
    out = out.withColumn("_hit", F.coalesce("_by_key_rec", "_by_dir_rec"))
    missed = F.col("_hit").isNull()
    out = out.withColumn("_name", F.when(missed, deslug("book_id")))
    hit = {f: F.col("_hit")[f] for f in ("title", *FIELDS[1:])}
    hit["title"] = F.when(missed, F.col("_name")).otherwise(hit["title"])  # a stub is named for its directory
    hit["authors"] = F.when(missed, F.array().cast("array<string>")).otherwise(hit["authors"])
    if faculty:
        hit["faculty"] = F.coalesce(hit["faculty"], F.when(missed, F.col(faculty)))
    rec = F.struct(F.col("book_id").alias("book_id"), *[v.alias(f) for f, v in hit.items()], (~missed).alias("matched"))
    return out.withColumn("rec", rec.cast(RECORD)).select(*books.columns, "rec")


def attach(books: DataFrame, recs: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """lookup, with the faculty that the record, the configuration or the source gives."""
    out = lookup(books, recs)
    return out.withColumn("rec", F.col("rec").withField("faculty", faculty_name(F.col("rec.faculty"), F.col("source"), names)))


def match_report(looked: DataFrame, rows: int | Column, order: list[str], sample: int = 20) -> DataFrame:
    """books, matched, missed, rows of the catalog, and the first misses in order."""
    miss = ~F.col("rec.matched")
    counts = looked.agg(F.count("*").alias("books"), F.count_if(F.col("rec.matched")).alias("matched"), F.count_if(miss).alias("missed"))
    first = looked.filter(miss).orderBy(*order).limit(sample).select(F.struct(*order, "book_id").alias("_x")).agg(F.transform(F.sort_array(F.collect_list("_x")), lambda x: x["book_id"]).alias("miss_sample"))
    return counts.crossJoin(first).withColumn("catalog_rows", F.lit(rows) if isinstance(rows, int) else rows)


def validate(looked: DataFrame) -> DataFrame:
    """Matches by source, and of all sources together."""
    out = looked.rollup("source").agg(F.grouping("source").alias("_all"), F.count("*").alias("books"), F.count_if(F.col("rec.matched")).alias("matched"), F.count_if(~F.col("rec.matched")).alias("missed"))
    return out.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "books", "matched", "missed")


FOUND = "struct<title:string,subtitle:string,authors:array<string>,year:int,publisher:string,place:string,edition:string,language:string,_source:string>"


def enrich(books: DataFrame, providers: list[tuple[str, Callable[[DataFrame], DataFrame] | DataFrame]], isbn: str = "isbn") -> DataFrame:
    """books with `found` (struct) and `outcome`: the first provider that has a title wins, whole.

    A provider is a table (isbn, found), or a function from the ISBNs not yet found to such a table,
    which then may ask a network. Each is asked once for each distinct valid ISBN that those before it
    missed: its answers are written down before they are used. A provider's row with found null and
    transient true leaves the outcome open."""
    todo = written(books.select(F.col(isbn).alias("_isbn")).filter(is_valid_isbn("_isbn")).distinct())
    got: DataFrame | None = None
    for _, provider in providers:
        table = provider(todo.withColumnRenamed("_isbn", "isbn")) if callable(provider) else provider
        flag = F.col("transient") if "transient" in table.columns else F.lit(False)
        rows = table.select(F.col("isbn").alias("_isbn"), F.col("found").cast(FOUND).alias("found"), F.coalesce(flag, F.lit(False)).alias("_transient"))
        rows = rows.withColumn("found", F.when(F.col("found.title") != "", F.col("found"))).filter("found is not null or _transient")
        hits = written(rows.join(todo, "_isbn", "left_semi"))
        got = hits if got is None else got.unionByName(hits)
        todo = written(todo.join(hits.filter("found is not null").select("_isbn"), "_isbn", "left_anti"))
    best = got.groupBy("_isbn").agg(F.max_by("found", F.col("found").isNotNull()).alias("found"), F.bool_or("_transient").alias("_transient")) if got is not None else None
    if best is None:
        return books.withColumns({"found": F.lit(None).cast(FOUND), "outcome": F.lit("miss")})
    out = books.join(best, books[isbn] == best["_isbn"], "left").drop("_isbn")
    outcome = F.when(F.col("found").isNotNull(), "hit").when(~F.coalesce(is_valid_isbn(isbn), F.lit(False)), "invalid").when(F.coalesce("_transient", F.lit(False)), "transient").otherwise("miss")
    return out.withColumn("outcome", outcome).drop("_transient")


def draft_rows(books: DataFrame, found: str | None = None) -> DataFrame:
    """Sheet rows for books (book_id, faculty, n_pages): what the name tells, and what enrichment found,
    field by field where it has something."""
    seed = {"directory_id": F.col("book_id"), "faculty": F.col("faculty"), "n_pages": F.col("n_pages"), "isbn": derive_isbn("book_id"), "title": guess_title("book_id")}
    if found:
        get = lambda f: F.col(f"{found}.{f}")
        seed["title"] = first_true(get("title"), seed["title"])
        seed |= {f: get(f) for f in ("subtitle", "publisher", "place", "edition", "language")}
        seed |= {"authors": F.array_join(get("authors"), "; "), "year": F.when(get("year") != 0, get("year").cast("string")), "source_meta": F.coalesce(get("_source"), F.lit(""))}
    return books.select(*[(seed[k] if k == "n_pages" else F.coalesce(seed.get(k, F.lit("")), F.lit(""))).alias(v) for k, v in DRAFT.items()])


def draft_fill(prefilled: tuple[str, ...] = ("directory_id", "faculty", "n_pages", "isbn", "title", "source_meta")) -> dict[str, Column]:
    """The cell colour of each sheet column: green where enrichment filled it, grey where we did, yellow
    where the librarian is asked."""
    auto = F.col(f"`{DRAFT['source_meta']}`") != ""
    enriched = ("title", "subtitle", "authors", "year", "publisher", "place", "edition", "language")
    out = {}
    for k, v in DRAFT.items():
        full = F.coalesce(F.col(f"`{v}`").cast("string"), F.lit("")) != ""
        plain = F.lit("grey" if k in prefilled else "yellow")
        out[v] = F.when(auto & full, "green").otherwise(plain) if k in enriched else plain
    return out
