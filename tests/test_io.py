"""Sources, sinks, plans and streams on real files."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import catalog, reports
from folioscope.plans import stages
from folioscope.sources import readers, sinks
from folioscope.sources.schemas import HEARTBEAT, PUBLISH, REPORT
from folioscope.streaming import logs

LINES = ['{"source":"fad","book_id":"b1","status":"error","minutes":1.5}', "", "not json", '{"source":"fad","book_id":"b1","status":"ok","n_pages":100,"pdf_mb":10,"minutes":3,"title":"T<1>"}', "{}"]


@pytest.fixture
def out(tmp_path):
    (tmp_path / "batch_report_1.jsonl").write_text("\n".join(LINES), encoding="utf-8")
    (tmp_path / "batch_report_2.jsonl").write_text('{"source":"mtf","book_id":"b9","status":"ok","n_pages":50,"pdf_mb":5,"minutes":2}\n')
    return tmp_path


def test_logs(spark, out):
    rows = readers.reports(spark, str(out))
    assert sorted(r.line_no for r in rows.filter(F.col("file").contains("_1")).collect()) == [0, 3, 4]
    figures = {r.source: (r.books, r.pages) for r in stages.stats(spark, str(out)).collect()}
    assert figures == {"fad": (1, 100), "mtf": (1, 50), "?": (1, 0), "TOTAL": (3, 150)}
    assert [r.source for r in stages.stats(spark, str(out), "mtf").orderBy("source").collect()] == ["TOTAL", "mtf"]
    assert readers.publish_log(spark, str(out / "none.jsonl")).count() == 0


def test_exports(spark, out):
    rows = reports.latest_per_book(readers.reports(spark, str(out)))
    sinks.export_report(rows, "csv", str(out / "csv"))
    (part,) = (out / "csv").glob("part-*")
    head, first, *_ = part.read_text().splitlines()
    assert head == ",".join(sinks.CSV_FIELDS) and first.startswith("?,?,?")
    data = json.loads(open(sinks.export_report(rows, "json", str(out / "s.json"))).read())
    assert data["overall"]["pages"] == 150 and data["by_source"]["mtf"]["books"] == 1
    page = open(sinks.export_report(rows, "html", sinks.default_path(str(out), "html"), totals=spark.createDataFrame([("fad", 2)], "source string, total long"), publish={"published": 3})).read()
    assert "width:50%" in page and "TOTAL" in page and "3 published" in page and "http" not in page
    with pytest.raises(ValueError, match="unknown format"):
        sinks.export_report(rows, "pdf", "x")


def test_page_listing(spark, tmp_path):
    for p in ("b1/stream_pages_tif/p2.tif", "b1/stream_pages_tif/p1.TIFF", "b1/cover.tif", "b2/x.tif", "b2/y.jpg", "@Recycle/z.tif", "lost+found/q.tif"):
        f = tmp_path / "fad" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"0123456789")
    pages = readers.build_source(spark, {"root": str(tmp_path), "paths": {"f": "fad"}}, "f")
    books = {r.book_id: [p.path.rsplit("/", 1)[1] for p in r.pages] for r in readers.books(pages).collect()}
    assert books == {"b1": ["p1.TIFF", "p2.tif"], "b2": ["x.tif"]}
    r = reports.size_stats(pages).first()
    assert (r.n_books, r.n_pages, r.total_bytes) == (2, 3, 30)
    assert {(t.book_id, t.n_pages, t.total_bytes) for t in reports.totals_of_nested(readers.books(pages)).collect()} == {("b1", 2, 20), ("b2", 1, 10)}
    with pytest.raises(ValueError, match="unknown source type"):
        readers.build_source(spark, {"type": "x"}, "f")
    with pytest.raises(FileNotFoundError):
        readers.build_source(spark, {"root": str(tmp_path)}, "none")
    dav = readers.build_source(spark, {"type": "webdav"}, "k", book_ids=["b", "@x"], lister=lambda b: [("p2", None), ("p1", 3)])
    assert [(r.path, r.size) for r in dav.orderBy("path").collect()] == [("p1", 3), ("p2", 0)]


def test_manifests_and_produced(spark, tmp_path):
    place = tmp_path / "fad"
    place.mkdir()
    (place / "fad_b1.entry.json").write_text('{"source": "fad", "book_id": "b1",\n "title": "T"}')
    (place / "fad_b2.entry.json").write_text("{broken")
    (place / "fad_b1.distribution.pdf").write_bytes(b"x")
    (place / "fad_.pdf").write_bytes(b"x")
    assert [(r.book_id, r.title) for r in readers.manifests(spark, str(tmp_path)).collect()] == [("b1", "T")]
    assert [r.book_id for r in readers.produced(spark, str(tmp_path), "fad").collect()] == ["b1"]


def test_config(tmp_path):
    (tmp_path / "configs").mkdir()
    f = tmp_path / "configs" / "p.toml"
    f.write_text('[source]\nroot = "scans"\n[source.paths]\nfad = "x"\nmtf = "y"\n')
    cfg = readers.config(f)
    assert cfg["source"]["root"] == str(tmp_path / "scans") and readers.source_keys(cfg) == ["fad", "mtf"]


def test_publish(spark):
    work = spark.createDataFrame([("fad", b, "main", '{"title":"T"}', f"{b}.pdf") for b in ("new", "there", "bad", "lost")], "source string, book_id string, catalog string, payload string, pdf string")

    def transport(method, path, body, kind):
        from folioscope.sources.sinks import EntryError

        if body == b"there.pdf":
            raise EntryError("exists", 409)
        if body == b"bad.pdf":
            raise OSError("x" * 900)
        return {} if body == b"lost.pdf" else {"id": "e1"}

    got = {r.book_id: r for r in sinks.publish(work, transport, read=lambda p: p.encode()).collect()}
    assert (got["new"].status, got["new"].entry_id) == ("published", "e1") and got["there"].status == "skipped"
    assert got["bad"].status == "error" and len(got["bad"].error) == 500
    assert {r.status for r in sinks.publish(work, transport, dry=True).collect()} == {"dry-run"}
    with pytest.raises(ValueError, match="API key"):
        sinks.http_transport("http://x", "")


def test_publish_plan(spark):
    books = spark.createDataFrame([("fad", f"b{i}") for i in range(4)], "source string, book_id string")
    recs = catalog.records(spark.createDataFrame([("b2", "Two")], "directory_id string, title string"))
    log_ = spark.createDataFrame([("b0", "published")], "book_id string, status string")
    got = {r.book_id: json.loads(r.payload)["title"] for r in stages.publish_plan(spark, books, recs, log_, "main", limit=3).collect()}
    assert got == {"b1": "b1", "b2": "Two"}


def test_plan_order_and_run(spark, tmp_path):
    full = stages.build_plan({"metadata": {"enabled": True}, "cover": {"enabled": True}, "docres": {"enabled": True}, "catalog": {"enabled": True, "catalog": "main"}}, catalog=catalog.records(spark.createDataFrame([], "directory_id string, title string")))
    assert full.names == ["download", "metadata", "scantailor", "docres", "language", "ocr", "render", "enrich", "cover", "finalize", "pdfa", "manifest"]
    assert stages.build_plan({"ocr": {"language": "slk"}, "finalize": {"enabled": False}}).names == ["download", "scantailor", "ocr", "render", "enrich", "pdfa"]
    seen = []
    full.on_step = lambda i, n, name: seen.append((i, n, name))
    books = spark.createDataFrame([("fad", "b1"), ("fad", "b2"), ("fad", "b3")], "source string, book_id string")
    assert {r.manifest.title for r in full.apply(books).collect()} == {"b1", "b2", "b3"} and seen[0] == (0, 12, "download")

    def ocr(r):
        if r["book_id"] == "b2":
            raise RuntimeError("no text " * 100)
        return {"n_pages": 7, "language": "sk"}

    plan = stages.build_plan({}, tools={"ocr": ocr})
    made = spark.createDataFrame([("out/fad/fad_b1.distribution.pdf",)], "path string")
    got = {r.book_id: r for r in stages.run_sources(books, plan, made, "out", log=str(tmp_path / "log")).collect()}
    assert [got[b].status for b in ("b1", "b2", "b3")] == ["skipped", "error", "ok"] and got["b3"].n_pages == 7 and len(got["b2"].error) == 500
    assert stages.run_sources(books, plan, made, "out", limit=1).count() == 1


def test_streams(spark, tmp_path):
    folder, shown = str(tmp_path / "log"), []
    for i, status in enumerate(("error", "ok")):
        sinks.append_log(spark.createDataFrame([("fad", "b1", status, 10 * i)], "source string, book_id string, status string, n_pages long"), folder)
        q = logs.monitor(logs.log_stream(spark, folder), str(tmp_path / "cp"), lambda df, n: shown.append({r.source: (r.books, r.produced, r.pages) for r in df.collect()}))
        assert q.awaitTermination(90)
    assert shown[-1]["TOTAL"] == (1, 1, 10) and shown[0]["TOTAL"] == (1, 0, 0)


def test_heartbeats(spark, tmp_path):
    folder, seen = str(tmp_path), []
    sinks.beat(folder, "fad", "b1", "ocr", 1, 5, started=10.0, now=100.0)
    sinks.beat(folder, "fad", "b1", "render", 2, 5, started=10.0, now=200.0)
    sinks.beat(folder, "mtf", "b2", "ocr", 0, 5, started=0.0, now=50.0)
    got = [(r.book_id, r.step, r.step_index, r.elapsed) for r in logs.active_workers(readers.heartbeats(spark, folder), 220.0, 100.0).collect()]
    assert got == [("b1", "render", 3, 210.0)]
    q = logs.state_of_workers(logs.heartbeat_stream(spark, folder), str(tmp_path / "cp"), lambda df, n: seen.append([r.book_id for r in df.collect()]), lambda: 220.0, 100.0)
    assert q.awaitTermination(90) and seen[-1] == ["b1"]
    assert sinks.clear_beats(folder, "fad", "b1") == 2 and sinks.clear_beats(folder) == 1
    plan = stages.build_plan({})
    assert logs.step_events(plan, spark.createDataFrame([("fad", "b")], "source string, book_id string"), 1.0).count() == len(plan.names)


def test_stage_copies(spark):
    pages = spark.createDataFrame([("/a/p1.tif", 10), ("/a/p2.tif", 10)], "path string, size long")
    there = spark.createDataFrame([("/c/p1.tif", 10), ("/c/p2.tif", 9)], "path string, size long")
    assert [r.path for r in sinks.staged(pages, there).collect()] == ["/a/p2.tif"]
    for ddl in (REPORT, PUBLISH, HEARTBEAT):
        assert spark.createDataFrame([], ddl).count() == 0


def test_saved_stats(spark, tmp_path):
    path = str(tmp_path / "stats")
    assert sinks.load_stats(spark, path, "source string, n_books long") is None
    sinks.save_stats(spark.createDataFrame([("fad", 2)], "source string, n_books long"), path)
    assert sinks.load_stats(spark, path, "source string, n_books long").first().n_books == 2 and sinks.free_gb(path) > 0
    assert stages.conformance(None)({"pdf": "x"}) == {"conforms": None} and stages.conformance(lambda p: p == "x")({"pdf": "x"})["conforms"]
