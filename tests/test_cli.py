"""Every command over a small corpus on disk, and drawn covers."""

import json

import pytest

from folioscope import cli
from folioscope.operators import drawing


@pytest.fixture
def corpus(tmp_path):
    for p in ("fad/FA_8022712343/stream_pages_tif/p1.tif", "fad/FA_KNIHA/p1.tif", "mtf/MTF_KNIHA_DVA/p1.tif"):
        f = tmp_path / "scans" / p
        f.parent.mkdir(parents=True)
        f.write_bytes(b"x" * 10)
    (tmp_path / "catalog.csv").write_text("directory_id,title,authors,year,isbn\nFA_KNIHA,Kniha prvá,Ján Novák,1999,\n", encoding="utf-8")
    (tmp_path / "out").mkdir()
    (tmp_path / "configs").mkdir()
    cfg = tmp_path / "configs" / "c.toml"
    cfg.write_text('[source]\nroot = "scans"\n[source.paths]\nfad = "fad"\nmtf = "mtf"\ngone = "gone"\n[output]\noutput_dir = "out"\n[metadata]\nenabled = true\npath = "catalog.csv"\n[catalog]\nenabled = true\ncatalog = "main"\n')
    return tmp_path, str(cfg)


def test_commands(spark, corpus, capsys):
    root, cfg = corpus
    run = lambda *a, **k: cli.main(["--config", cfg, *a], spark, **k)
    assert run("list", "fad", "--limit", "1") == 0 and capsys.readouterr().out == "fad\tFA_8022712343\t1\n"
    tools = {"ocr": lambda r: {"n_pages": int(r["n_pages"])}}
    assert run("run-corpus", "--log-file", str(root / "log"), tools=tools) == 0 and json.loads(capsys.readouterr().out) == {"ok": 3}
    assert run("run-book", "fad", "FA_KNIHA", tools={"ocr": lambda r: 1 / 0}) == 1 and json.loads(capsys.readouterr().out) == {"error": 1}
    assert run("stats") == 1
    (root / "out" / "batch_report.jsonl").write_text('{"source":"fad","book_id":"b","status":"ok","n_pages":3,"minutes":1}')
    assert run("stats", "--json") == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["overall"]["pages"] == 3
    assert run("stats", "fad", "--export", "html") == 0 and (root / "out" / "stats_fad.html").exists()
    assert run("validate-catalog") == 0 and "TOTAL" in capsys.readouterr().out
    assert run("build-catalog", "fad", "--out", str(root / "draft")) == 0 and "8022712343" in next((root / "draft").glob("part-*")).read_text()
    assert run("preview-cover", "fad", "FA_KNIHA", "--out", str(root / "c.svg")) == 0 and "Kniha" in (root / "c.svg").read_text()
    assert run("export-manifests", "fad") == 0 and any((root / "out" / "manifests").rglob("part-*"))
    assert run("publish-catalog", "fad", "--dry-run") == 0 and '"dry-run": 2' in capsys.readouterr().out
    assert run("monitor", str(root / "log"), "--once") == 0 and "TOTAL" in capsys.readouterr().out


def test_drawing():
    assert drawing.wrapped("a bb ccc dddd", 5, 1, lambda t, s: len(t)) == ["a bb", "ccc", "dddd"]
    size, lines = drawing.fitted("some title words", 100, 60, measure=lambda t, s: len(t) * s / 2)
    assert size == 24 and lines == ["some", "title", "words"] or len(lines) * size * 1.2 <= 60
    with pytest.raises(ValueError, match="unknown template"):
        drawing.template("x")


@pytest.fixture
def server():
    """A small catalog over HTTP: it lists two catalogs on two pages, knows one entry and keeps what it gets."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    got = []

    class Answers(BaseHTTPRequestHandler):
        def say(self, said, code=200):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(said if isinstance(said, bytes) else json.dumps(said).encode())

        def do_GET(self):
            page = int(self.path[-1])
            self.say({"items": [{"id": f"id{page}", "url_name": ("other", "main")[page - 1], "title": "T"}], "metadata": {"pages": 2}})

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            got.append((self.path, self.headers["Content-Type"], self.headers["Authorization"], body))
            if b"8022712343" in body and self.path.endswith("entries"):
                return self.say(b"<html>no JSON</html>", 409)
            self.say({"response": {"id": "e7"}})

        def log_message(self, *a):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", got
    httpd.shutdown()


def test_import_over_http(spark, corpus, server, capsys, monkeypatch):
    (root, cfg), (url, got) = corpus, server
    with open(cfg, "a") as f:
        f.write(f'base_url = "{url}/api"\napi_key_env = "KEY_FOR_TEST"\nrelation = "borrow"\n')
    run = lambda *a: cli.main(["--config", cfg, *a], spark)
    with pytest.raises(ValueError, match="API key"):
        run("publish-catalog", "fad")
    monkeypatch.setenv("KEY_FOR_TEST", "secret")
    assert run("export-manifests", "fad") == 0 and capsys.readouterr().out == "2\n"
    side = root / "out" / "fad" / "fad_FA_KNIHA.entry.json"
    entry = json.loads(side.read_text(encoding="utf-8"))
    assert entry["title"] == "Kniha prvá" and entry["summary"] is None and "á" in side.read_text(encoding="utf-8")
    side.write_text(json.dumps(entry | {"title": "Changed by hand", "cover": "c.png"}), encoding="utf-8")
    (root / "out" / "fad" / "c.png").write_bytes(b"picture")
    (root / "out" / "fad" / entry["pdf"]).write_bytes(b"%PDF text")
    assert run("publish-catalog", "fad") == 0 and json.loads(capsys.readouterr().out) == {"published": 1, "skipped": 1}
    made = next(json.loads(b) for p, _, _, b in got if p == "/api/catalogs/id2/entries" and b"Changed by hand" in b)
    assert made["image"] == "data:image/png;base64,cGljdHVyZQ=="
    path, kind, key, body = next(g for g in got if g[0].endswith("/e7"))
    assert path == "/api/catalogs/id2/entries/e7" and key == "Bearer secret" and body.endswith(f"--{kind.split('boundary=')[1]}--\r\n".encode())
    assert b'name="metadata"' in body and b'{"relation": "borrow"}' in body and b'name="content"; filename="e7.pdf"' in body and b"\r\n\r\n%PDF text\r\n" in body
    # All is done: nothing is sent, and old rows of the log aren't counted.
    sent = len(got)
    assert run("publish-catalog", "fad") == 0 and json.loads(capsys.readouterr().out) == {} and len(got) == sent
    # One book is always sent, from an entry built anew; a PDF that isn't there is an error.
    (root / "out" / "fad" / entry["pdf"]).unlink()
    assert run("publish-book", "fad", "FA_KNIHA") == 1 and json.loads(capsys.readouterr().out) == {"error": 1}
    assert b"Changed by hand" not in got[-1][3]


def test_status_counts_in_exports(spark):
    from folioscope.sources import sinks

    rows = spark.createDataFrame([("a", "1", "ok"), ("a", "2", "error"), ("b", "3", None)], "source string, book_id string, status string")
    rows = rows.selectExpr("*", *[f"cast(null as {t}) {c}" for c, t in (("n_pages", "bigint"), ("pdf_mb", "double"), ("ocr_chars", "bigint"), ("minutes", "double"))])
    said = json.loads(sinks.summary_json(rows).first().value)
    assert said["overall"]["by_status"] == {"?": 1, "error": 1, "ok": 1} and said["overall"]["books"] == 3
    assert {s: v["by_status"] for s, v in said["by_source"].items()} == {"a": {"error": 1, "ok": 1}, "b": {"?": 1}}
    assert json.loads(sinks.summary_json(rows.limit(0)).first().value)["overall"]["by_status"] == {}


def test_log_rows_are_this_runs(spark, tmp_path):
    """Tools run once for a book, and old rows of the log aren't returned."""
    from folioscope.plans import stages

    calls = tmp_path / "calls"
    calls.mkdir()

    def ocr(r):
        import uuid

        (calls / uuid.uuid4().hex).write_text(r["book_id"])
        return {"n_pages": 1}

    books = spark.createDataFrame([("fad", "b1"), ("fad", "b2")], "source string, book_id string")
    plan = stages.build_plan({}, tools={"ocr": ocr})
    none = spark.createDataFrame([], "path string, size long")
    for n in (1, 2):
        rows = stages.run_sources(books, plan, none, "out", log=str(tmp_path / "log"))
        assert rows.count() == 2 and {r.status for r in rows.collect()} == {"ok"} and len(list(calls.iterdir())) == 2 * n
    assert spark.read.json(str(tmp_path / "log")).count() == 4
