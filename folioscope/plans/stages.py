"""Plans of stages: DataFrame to DataFrame steps, seams for outside tools, composite jobs."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bib
from ..functions.covers import profiles
from ..functions.ids import derive_isbn
from ..functions.text import pdf_path
from ..operators import catalog as cat
from ..operators import reports
from ..sources import readers, sinks
from ..sources.schemas import MANIFEST, REPORT
from ..sources.state import written

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stage:
    """A named step. pure: an expression; else a seam, whose `tool` works on one book's record."""

    name: str
    run: Step | None = None
    tool: Callable[[dict], dict] | None = None


@dataclass
class Plan:
    stages: list[Stage]
    on_step: Callable[[int, int, str], None] | None = None
    names: list[str] = field(init=False)

    def __post_init__(self):
        self.names = [s.name for s in self.stages]

    def apply(self, books: DataFrame) -> DataFrame:
        """The pure stages as one DataFrame plan."""
        for i, s in enumerate(self.stages):
            if self.on_step:
                self.on_step(i, len(self.stages), s.name)
            if s.run:
                books = books.transform(s.run)
        return books

    def process(self, books: DataFrame) -> DataFrame:
        """A report row for each book, by the tools of its stages; a failure is the book's row."""
        tools = [(s.name, s.tool) for s in self.stages if s.tool]
        names = [x.split()[0] for x in REPORT.replace("map<string,struct<path:string,mb:double,image_format:string,pdfa:string,linearize:boolean>>", "map").split(", ")]

        def one(record: dict) -> dict:
            row, began = dict.fromkeys(names) | {k: record[k] for k in ("source", "book_id")} | {"status": "ok"}, time.time()
            try:
                for _, tool in tools:
                    record = record | (tool(record) or {})
                row |= {k: v for k, v in record.items() if k in names and (k == "outputs" or not isinstance(v, dict))}
            except Exception as e:  # noqa: BLE001 - one book's failure is its row
                row |= {"status": "error", "error": str(e)[:500]}
            return row | {"minutes": round((time.time() - began) / 60, 2)}

        def run(batches):
            for pdf in batches:
                out = pd.DataFrame([one(r) for r in pdf.to_dict("records")], columns=names)
                yield out.astype(dict.fromkeys(("n_frames", "n_pages", "ocr_chars"), "Int64"))

        return books.mapInPandas(run, REPORT)


def build_plan(config: Mapping, catalog: DataFrame | None = None, tools: Mapping[str, Callable[[dict], dict]] | None = None) -> Plan:
    """The stages that a configuration asks for, in order. Tools that aren't given are left out of
    `process`; their place in the plan stays."""
    tools = tools or {}
    on = lambda block, default: config.get(block, {}).get("enabled", default)
    seam = lambda name: Stage(name, tool=tools.get(name))
    out = [seam("download")]
    if catalog is not None and on("metadata", False):
        names = config["metadata"].get("faculty_names")
        out.append(Stage("metadata", lambda df: cat.attach(df, catalog, names)))
    out.append(seam("scantailor"))
    if on("docres", False):
        out.append(seam("docres"))
    if config.get("ocr", {}).get("language", "auto") == "auto":
        out.append(seam("language"))
    profiles(config)  # unknown profiles are an error before anything runs
    out += [seam("ocr"), seam("render"), seam("enrich")]
    if on("cover", False):
        out.append(seam("cover"))
    if on("finalize", True):
        out.append(seam("finalize"))
    out.append(seam("pdfa"))
    if on("catalog", False) and config["catalog"].get("catalog"):
        c = config["catalog"]
        out.append(Stage("manifest", lambda df: with_manifest(df, c["catalog"], c.get("relation", "open-access"), c.get("entry_config"), c.get("default_language", "slk"), c.get("author_name_order", "given_first"))))
    return Plan(out)


def with_manifest(books: DataFrame, catalog: str, relation: str = "open-access", entry_config: Mapping[str, str] | None = None, language: str = "slk", order: str = "given_first", root: str = "out") -> DataFrame:
    """books (source, book_id, rec, and pdf, ocr_language, page_count, cover where there) with the entry."""
    has = lambda c, kind="string": F.col(c) if c in books.columns else F.lit(None).cast(kind)
    r = lambda f: F.col(f"rec.{f}")
    slug = F.concat_ws("_", "source", "book_id")
    m = bib.manifest(source="source", book_id="book_id", title=r("title"), authors=r("authors"), pdf=F.coalesce(has("pdf"), pdf_path(F.lit(root), "source", slug, F.lit("distribution"))), catalog=r("catalog"), default_catalog=catalog, isbn=r("isbn"), year=r("year"), publisher=r("publisher"), language=r("language"), ocr_language=has("ocr_language"), faculty=r("faculty"), page_count=has("page_count", "long"), matched=r("matched"), cover=has("cover"), relation=relation, config=entry_config, default_language=language, order=order)
    return books.withColumn("manifest", m)


def run_sources(books: DataFrame, plan: Plan, produced: DataFrame, root: str, log: str | None = None, limit: int | None = None) -> DataFrame:
    """Report rows for the books of all sources at once: those whose main PDF is there are `skipped`.

    The limit takes the first books of each source. Tools run once: the rows returned are those of this
    run, written down, whatever else the log holds."""
    picked = reports.first_of_order(books, ["source"], ["book_id"], limit) if limit else books
    path = pdf_path(F.lit(root), "source", F.concat_ws("_", "source", "book_id"), F.lit("distribution"))
    todo = reports.not_produced(picked, produced, path)
    names = [f.name for f in plan.process(todo).schema.fields]
    done = picked.join(todo.select("source", "book_id"), ["source", "book_id"], "left_anti").select(*[F.col(c) if c in ("source", "book_id") else (F.lit("skipped") if c == "status" else F.lit(None)).alias(c) for c in names])
    rows = written(plan.process(todo).unionByName(done))
    if log:
        sinks.append_log(rows, log)
    return rows


def stats(spark: SparkSession, folder: str, source: str | list[str] | None = None) -> DataFrame:
    """The newest rows of all logs, of one source, some or all, as figures with a total."""
    rows = reports.latest_per_book(readers.reports(spark, folder))
    if source:
        rows = rows.filter(F.col("source").isin(*([source] if isinstance(source, str) else source)))
    return reports.with_total(rows)


def build_catalog(books: DataFrame, providers: list | None = None) -> DataFrame:
    """Draft sheet rows for the books of all sources."""
    if not providers:
        return cat.draft_rows(books)
    found = cat.enrich(books.withColumn("isbn", derive_isbn("book_id")), providers)
    return cat.draft_rows(found, "found")


def publish_plan(spark: SparkSession, books: DataFrame, recs: DataFrame, log: DataFrame, catalog: str, limit: int | None = None, force: bool = False, sidecars: DataFrame | None = None, root: str = "out", **entry) -> DataFrame:
    """What an import has to send: (source, book_id, catalog, payload, pdf, cover). The limit comes before
    the books that are done go; a side file wins over an entry built anew, for which `entry` are
    with_manifest's options. Files that an entry names are below root/source."""
    todo = reports.remaining(books, reports.already_done(log), "book_id", limit, force)
    built = with_manifest(cat.lookup(todo, recs), catalog, root=root, **entry)
    if sidecars is not None:
        kinds = T.StructType.fromDDL(MANIFEST)
        shaped = lambda at: F.struct(*[F.col(f"{at}{f.name}").cast(f.dataType).alias(f.name) for f in kinds])
        side = sidecars.select("source", "book_id", shaped("").alias("_side"))
        side = side.groupBy("source", "book_id").agg(F.max_by("_side", F.to_json("_side")).alias("_side"))
        built = built.join(side, ["source", "book_id"], "left").withColumn("manifest", F.coalesce("_side", shaped("manifest.")))
    beside = lambda f: F.concat(F.lit(f"{root}/"), "source", F.lit("/"), f"manifest.{f}").alias(f)  # noqa: E731 - null where none
    return built.select("source", "book_id", F.col("manifest.catalog").alias("catalog"), bib.entry_payload(F.col("manifest")).alias("payload"), F.col("pdf") if "pdf" in built.columns else beside("pdf"), beside("cover"))


def conformance(validator: Callable[[str], bool] | None) -> Callable[[dict], dict]:
    """A tool that checks a book's PDF: true, false, or null where no validator is installed."""
    return lambda record: {"conforms": None if validator is None else bool(validator(record["pdf"]))}
