"""Commands over a configuration: list, run, catalogs, statistics, manifests, import."""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bib
from .operators import catalog as cat
from .operators import drawing, reports
from .plans import stages
from .sources import readers, sinks
from .sources.state import written
from .streaming import logs


class Job:
    """What commands share: the configuration, the books of its sources, the catalog, the output."""

    def __init__(self, spark: SparkSession, config: dict, tools: dict | None = None, transport=None):
        self.spark, self.config, self.tools, self.transport = spark, config, tools or {}, transport
        self.out = config.get("output", {}).get("output_dir", "out")

    def pages(self, source: str | None) -> DataFrame:
        """Pages of one source or all; a source that can't be listed is left out of all."""
        found: DataFrame | None = None
        for key in [source] if source else readers.source_keys(self.config):
            try:
                one = readers.build_source(self.spark, self.config["source"], key)
            except FileNotFoundError:
                if source:
                    raise
                continue
            found = one if found is None else found.unionByName(one)
        return found if found is not None else self.spark.createDataFrame([], readers.schemas.PAGE)

    def books(self, source: str | None, limit: int | None = None) -> DataFrame:
        books = self.pages(source).groupBy("source", "book_id").agg(F.count("*").alias("n_pages"))
        return reports.first_of_order(books, ["source"], ["book_id"], limit) if limit else books

    def catalog(self) -> DataFrame:
        m = self.config.get("metadata", {})
        return cat.records(readers.catalog_sheet(self.spark, m.get("path", "none")), m.get("columns"))

    def produced(self) -> DataFrame:
        try:
            return readers.listing(self.spark, self.out, "*.pdf")
        except Exception:  # noqa: BLE001 - nothing was made yet
            return self.spark.createDataFrame([], "path string, size long")

    def list(self, a) -> int:
        for r in self.books(a.source, a.limit).orderBy("source", "book_id").toLocalIterator():
            print(f"{r.source}\t{r.book_id}\t{r.n_pages}")
        return 0

    def run(self, a) -> int:
        books = self.books(a.source, getattr(a, "limit", None))
        if getattr(a, "book_id", None):
            books = books.filter(F.col("book_id") == a.book_id)
        plan = stages.build_plan(self.config, self.catalog() if self.config.get("metadata", {}).get("enabled") else None, self.tools)
        rows = stages.run_sources(plan.apply(books), plan, self.produced(), self.out, a.log_file)
        counts = {r.status: r.n for r in reports.tally(rows).collect()}
        print(json.dumps(counts))
        return int("error" in counts)

    def build_catalog(self, a) -> int:
        names = self.config.get("metadata", {}).get("faculty_names", {})
        books = self.books(a.source).withColumn("faculty", bib.faculty_name(F.lit(None).cast("string"), F.col("source"), names))
        stages.build_catalog(books).coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)
        return 0

    def validate_catalog(self, a) -> int:
        cat.validate(cat.lookup(self.books(a.source), self.catalog())).orderBy("source").show(200, False)
        return 0

    def preview_cover(self, a) -> int:
        book = cat.attach(self.books(a.source).filter(F.col("book_id") == a.book_id), self.catalog())
        spec = book.select(F.col("rec.title").alias("title"), F.col("rec.subtitle").alias("subtitle"), F.col("rec.authors").alias("authors"), bib.footer("rec.publisher", "rec.year").alias("footer"), bib.faculty_key("rec.faculty").alias("faculty_key"))
        row = drawing.covers(spec, a.template).select("cover").first()
        with open(a.out, "wb") as f:
            f.write(bytes(row.cover))
        return 0

    def stats(self, a) -> int:
        rows = reports.latest_per_book(readers.reports(self.spark, self.out))
        if a.source:
            rows = rows.filter(F.col("source") == a.source)
        if rows.isEmpty():
            print("no reports", file=sys.stderr)
            return 1
        if a.export:
            print(sinks.export_report(rows, a.export, a.out or sinks.default_path(self.out, a.export, a.source)))
        elif a.json:
            print(sinks.summary_json(rows).first().value)
        else:
            reports.with_total(rows).orderBy("source").show(200, False)
        return 0

    def monitor(self, a) -> int:
        show = lambda df, n: df.orderBy("source").show(200, False)
        # A folder of its own: the figures are of the whole log, and monitors of other logs keep theirs.
        checkpoint = f"{self.spark.conf.get('spark.checkpoint.dir', None) or self.out + '/.monitor'}/monitor/{uuid.uuid4().hex}"
        logs.monitor(logs.log_stream(self.spark, a.log), checkpoint, show, a.once, f"{a.interval} seconds").awaitTermination()
        return 0

    def entry(self) -> dict:
        """with_manifest's options."""
        c = self.config.get("catalog", {})
        return {"relation": c.get("relation", "open-access"), "entry_config": c.get("entry_config"), "language": c.get("default_language", "slk"), "order": c.get("author_name_order", "given_first")}

    def manifests(self, a) -> DataFrame:
        books = self.books(a.source, getattr(a, "limit", None))
        names = self.config.get("metadata", {}).get("faculty_names")
        return stages.with_manifest(cat.attach(books, self.catalog(), names), self.config["catalog"]["catalog"], root=self.out, **self.entry())

    def export_manifests(self, a) -> int:
        rows = written(self.manifests(a))
        sinks.write_manifests(rows, f"{self.out}/manifests")
        print(sinks.write_sidecars(rows, self.out).count())
        return 0

    def connected(self):
        """The transport that was given, else one to the configured address with the key of the
        environment variable that the configuration names."""
        c = self.config["catalog"]
        return self.transport or sinks.http_transport(c.get("base_url", ""), os.environ.get(c.get("api_key_env", "CATALOG_API_KEY"), ""), c.get("relation", "open-access"))

    def publish(self, a) -> int:
        """Side files of entries are sent as they are, but for a single book, whose entry is built anew.
        Only this run's rows are counted."""
        if not self.config.get("catalog", {}).get("enabled"):
            return 0
        books, alone = self.books(a.source), getattr(a, "book_id", None)
        if alone:
            books = books.filter(F.col("book_id") == alone)
        log = readers.publish_log(self.spark, f"{self.out}/publish/{{*.json,*/*.json}}")
        side = readers.manifests(self.spark, self.out) if not alone and readers.exists(self.spark, f"{self.out}/*/*.entry.json") else None
        work = stages.publish_plan(self.spark, books, self.catalog(), log, self.config["catalog"]["catalog"], getattr(a, "limit", None), getattr(a, "force", False) or bool(alone), side, self.out, **self.entry())
        if a.dry_run:
            rows = sinks.publish(work, lambda *x: {}, dry=True)
        else:
            transport = self.connected()
            known = self.spark.createDataFrame(sinks.catalogs(transport), "id string, url_name string, title string")
            run = f"{self.out}/publish/{uuid.uuid4().hex}"
            sinks.append_log(sinks.publish(sinks.resolve_catalog(work, known), transport), run)
            rows = self.spark.read.schema(sinks.PUBLISH).json(run)
        counts = {r.status: r.n for r in reports.tally(rows).collect()}
        print(json.dumps(counts))
        return int("error" in counts)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscope")
    p.add_argument("--config", required=True)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, method: str, *args: str, **options) -> None:
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a, **({"nargs": "?"} if name in ("build-catalog", "validate-catalog", "stats", "export-manifests", "publish-catalog") else {}))
        for o, kind in options.items():
            s.add_argument("--" + o.replace("_", "-"), **({"action": "store_true"} if kind is bool else {"type": type(kind) if kind is not None else str, "default": kind}))
        s.set_defaults(method=method, **({"source": None} if "source" not in args else {}))

    number = {"limit": 0}
    command("list", "list", "source", **number)
    command("run-book", "run", "source", "book_id", log_file=None)
    command("run-source", "run", "source", log_file=None, **number)
    command("run-corpus", "run", log_file=None, **number)
    command("build-catalog", "build_catalog", "source", out="catalog_draft")
    command("validate-catalog", "validate_catalog", "source")
    command("preview-cover", "preview_cover", "source", "book_id", template="plain", out="cover.svg")
    command("stats", "stats", "source", json=bool, export=None, out=None)
    command("monitor", "monitor", "log", interval=5, once=bool)
    command("export-manifests", "export_manifests", "source", **number)
    command("publish-book", "publish", "source", "book_id", dry_run=bool)
    command("publish-catalog", "publish", "source", force=bool, dry_run=bool, **number)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **seams) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("folioscope").getOrCreate()
    return getattr(Job(spark, readers.config(args.config), **seams), args.method)(args)


if __name__ == "__main__":
    sys.exit(main())
