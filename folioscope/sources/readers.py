"""Scans: report logs, manifests, heartbeats, page listings, catalogs, configuration."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from . import schemas


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files with file and line_no. Blank lines and lines that aren't JSON objects
    are dropped; an empty object is a row. A file is one row until it is split, so keep logs sharded;
    its lines are split at \\n only."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    good = lines.filter(F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull())
    return good.select("file", "line_no", F.from_json("line", schema).alias("r")).select("file", "line_no", "r.*")


def reports(spark: SparkSession, folder: str, prefix: str = "batch_report") -> DataFrame:
    """All logs of a folder whose name starts with the prefix; no rows if there are none."""
    return log_or_none(spark, f"{folder}/{prefix}*.jsonl", schemas.REPORT)


def publish_log(spark: SparkSession, path: str) -> DataFrame:
    """The import log; an absent one has no rows."""
    return log_or_none(spark, path, schemas.PUBLISH)


def log_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return json_log(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], f"file string, line_no int, {schema}")


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file matches, on whatever file system the path names."""
    try:
        spark.read.format("binaryFile").load(pattern)
    except AnalysisException:
        return False
    return True


def json_documents(spark: SparkSession, folder: str, glob: str, schema: str) -> DataFrame:
    """One row for each JSON file below a folder, with its path; malformed ones are dropped."""
    # Spark needs the raw record to tell a malformed file from an empty object.
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.input_file_name().alias("path"), "value")
    good = rows.filter(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    return good.select("path", F.from_json("value", schema).alias("d")).select("path", "d.*")


def manifests(spark: SparkSession, output: str, source: str | None = None) -> DataFrame:
    folder = f"{output}/{source}" if source else output
    return json_documents(spark, folder, "*.entry.json", schemas.MANIFEST).orderBy("path")


def heartbeats(spark: SparkSession, output: str) -> DataFrame:
    return json_documents(spark, f"{output}/.progress", "*.json", schemas.HEARTBEAT)


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, size) of the files below a folder. Contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("size"))


def page_scans(spark: SparkSession, root: str, source: str, pages_dir: str = "stream_pages_tif", skip: tuple[str, ...] = ("lost+found",)) -> DataFrame:
    """(source, book_id, path, size) of TIFF pages under root/<book>/: those in the pages folder if the
    book has any there, else those right in the book's folder. Folders named @... and `skip` are left
    out. A book without pages can't be seen in a listing of files."""
    base = root.rstrip("/")
    rest = F.regexp_extract("path", r"^(?:[a-z]+:/*)?" + _escaped(base) + r"/(.+)$", 1)
    rows = listing(spark, base, "*.[tT][iI][fF]*").withColumn("_rest", rest)
    rows = rows.filter(F.lower("path").rlike(r"\.tiff?$")).withColumns({"book_id": F.split("_rest", "/")[0], "_depth": F.size(F.split("_rest", "/"))})
    rows = rows.filter(~F.col("book_id").startswith("@") & ~F.col("book_id").isin(*skip))
    nested = (F.col("_depth") == 3) & (F.split("_rest", "/")[1] == pages_dir)
    rows = rows.withColumn("_nested", nested).filter(nested | (F.col("_depth") == 2))
    books = rows.groupBy("book_id").agg(F.max("_nested").alias("_has"))
    return rows.join(books, "book_id").filter(F.col("_nested") == F.col("_has")).select(F.lit(source).alias("source"), "book_id", "path", "size")


def _escaped(path: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in path.lstrip("/")) if not path.startswith("/") else "/*" + _escaped(path[1:])


def books(pages: DataFrame) -> DataFrame:
    """Nested rows: (source, book_id, pages array<struct<path, size>>), pages in order."""
    return pages.groupBy("source", "book_id").agg(F.array_sort(F.collect_list(F.struct("path", "size"))).alias("pages"))


def produced(spark: SparkSession, output: str, source: str, profile: str = "distribution") -> DataFrame:
    """(book_id, path) of the PDFs made for a source; the same layout as functions.text.pdf_path."""
    rows = listing(spark, f"{output}/{source}", "*.pdf").withColumn("_name", basename("path"))
    ident = F.regexp_extract("_name", f"^{source}_(.*?)(?:\\.{profile})?\\.pdf$", 1)
    return rows.withColumn("book_id", ident).filter("book_id <> ''").select("book_id", "path").orderBy("path")


def catalog_sheet(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A catalog as text columns: CSV and Parquet by Spark, workbooks by pandas where an engine for
    them is installed. An absent file gives an empty sheet, so that every book gets a stub."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, dtype=object).astype("string"))
    if not exists(spark, path):
        return spark.createDataFrame([], "directory_id string, title string, authors string, year string, publisher string, isbn string, faculty string, language string")
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def config(path: str | Path) -> dict:
    """A TOML file with paths made absolute against its folder's parent."""
    path = Path(path)
    data = tomllib.loads(path.read_text(encoding="utf-8"))
    root = path.resolve().parent.parent

    def fixed(x):
        if isinstance(x, dict):
            return {k: str(root / v) if k in ("root", "output_dir", "cache_dir", "path") and isinstance(v, str) and not v.startswith("/") and "://" not in v else fixed(v) for k, v in x.items()}
        return x

    return fixed(data)


def source_keys(cfg: Mapping) -> list[str]:
    return list(cfg.get("orchestration", {}).get("sources") or cfg.get("source", {}).get("paths", {}))


def webdav_pages(spark: SparkSession, book_ids: list[str], source: str, lister: Callable[[str], list[tuple[str, int | None]]]) -> DataFrame:
    """Pages over a network: `lister` gives (path, size) of a book and runs on executors, one book to a
    task row. A missing size is 0."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(source, b, p, int(n or 0)) for b in pdf["book_id"] if not b.startswith("@") for p, n in sorted(lister(b))]
            yield pd.DataFrame(rows, columns=["source", "book_id", "path", "size"])

    books_ = spark.createDataFrame([(b,) for b in sorted(book_ids)], "book_id string")
    return books_.repartition(max(1, min(len(book_ids), 200))).mapInPandas(run, schemas.PAGE)


SOURCES = {"filesystem": page_scans, "webdav": webdav_pages}


def build_source(spark: SparkSession, source_config: Mapping, key: str, **seams) -> DataFrame:
    """The pages of a configured source; ValueError for an unknown type."""
    kind = source_config.get("type", "filesystem")
    if kind not in SOURCES:
        raise ValueError(f"unknown source type {kind!r}; known: {', '.join(SOURCES)}")
    path = source_config.get("paths", {}).get(key, key)
    if kind == "webdav":
        return webdav_pages(spark, seams["book_ids"], key, seams["lister"])
    root = f"{source_config['root'].rstrip('/')}/{path}"
    if not exists(spark, root):
        raise FileNotFoundError(root)
    return page_scans(spark, root, key, source_config.get("pages_dir", "stream_pages_tif"))
