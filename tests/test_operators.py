"""Reports, catalog matching, structure, images."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import catalog, images, providers, reports, structure

LOG = "file string, line_no int, source string, book_id string, status string, n_pages bigint, pdf_mb double, ocr_chars bigint, minutes double, outputs map<string,struct<mb:double>>"


def log(spark):
    return spark.createDataFrame(
        [("a", 0, "fad", "b1", "error", None, None, None, 1.5, None), ("a", 1, "fad", "b1", "ok", 100, 10.0, 50, 3.0, {"archival": (7.5,)}), ("b", 0, "fad", "b2", "ok", 50, 5.0, 10, 2.0, None), ("b", 1, "mtf", "b1", "error", None, None, None, 1.5, None), ("b", 2, None, None, None, None, None, None, None, None)],
        LOG,
    )


def test_latest_in_any_order(spark):
    rows = log(spark)
    want = sorted(map(str, reports.latest_per_book(rows).collect()))
    assert sorted(map(str, reports.latest_per_book(rows.orderBy(F.rand(3)).repartition(5)).collect())) == want
    assert {(r.source, r.book_id): r.status for r in reports.latest_per_book(rows).collect()} == {("fad", "b1"): "ok", ("fad", "b2"): "ok", ("mtf", "b1"): "error", ("?", "?"): "?"}


def test_later_skip_hides_ok_unless_preferred(spark):
    rows = log(spark).unionByName(spark.createDataFrame([("c", 0, "fad", "b1", "skipped")], "file string, line_no int, source string, book_id string, status string"), allowMissingColumns=True)
    status = lambda df: {r.book_id: r.status for r in df.collect() if r.source == "fad"}
    assert status(reports.latest_per_book(rows))["b1"] == "skipped" and status(reports.latest_per_book(rows, prefer_ok=True))["b1"] == "ok"


def test_summary(spark):
    rows = reports.latest_per_book(log(spark))
    s = reports.summarize(rows).first()
    assert (s.books, s.produced, s.errors, s.pages, s.pdf_mb, s.archival_mb, s.minutes) == (4, 2, 1, 150, 15.0, 7.5, 6.5)
    assert (s.mb_per_page, s.pages_per_min, s.mean_minutes_per_book) == (0.1, 23.1, 1.63)
    none = reports.summarize(rows.limit(0)).first()
    assert none.books == 0 and none.mb_per_page is None and none.pages_per_min is None
    by = {r.source: r.pages for r in reports.with_total(rows).collect()}
    assert by == {"fad": 150, "mtf": 0, "?": 0, "TOTAL": 150}
    assert reports.as_map(reports.tally(rows, missing="?")).first().by_status == {"?": 1, "error": 1, "ok": 2}
    assert reports.with_total(rows.limit(0)).count() == 0


def test_resume(spark):
    work = spark.createDataFrame([(f"b{i}",) for i in range(5)], "book_id string")
    done = reports.already_done(spark.createDataFrame([("b0", "published"), ("b0", "error"), ("b1", "skipped"), ("b2", "error")], "book_id string, status string"))
    ids = lambda df: sorted(r.book_id for r in df.collect())
    assert ids(reports.remaining(work, done)) == ["b2", "b3", "b4"]
    assert ids(reports.remaining(work, done, limit=2)) == [] and ids(reports.remaining(work, done, limit=2, force=True)) == ["b0", "b1"]


def test_progress_and_workers(spark):
    sources = spark.createDataFrame([("fad",), ("svf",)], "source string")
    totals = spark.createDataFrame([("fad", 4)], "source string, total long")
    got = {r.source: r for r in reports.progress_table(sources, reports.summarize_by_source(reports.latest_per_book(log(spark))), totals).collect()}
    assert got["fad"].pct == 50.0 and got["fad"].eta_minutes == 5.0 and got["svf"].books == 0 and got["svf"].eta_minutes is None
    beats = spark.createDataFrame([("a", "1", 100.0, 900.0), ("a", "2", 50.0, 950.0), ("a", "3", 0.0, 399.0)], "source string, book_id string, started_at double, updated_at double")
    assert [(r.book_id, r.elapsed_text) for r in reports.active(beats, 1000.0, 600.0).collect()] == [("2", "15m50s"), ("1", "15m00s")]


def sheet(spark):
    return spark.createDataFrame(
        [("FA_dir one", "First", "Novák Ján; Malá Eva", "vyd. 2009", None), (None, "By isbn", None, None, "80-7095-020-X"), ("FA_dir.one", "Second", None, None, None), (" ", None, None, None, None), ("FA_NO_TITLE", None, None, None, None)],
        "directory_id string, title string, authors string, year string, isbn string",
    ).coalesce(1)


def test_lookup(spark):
    recs = catalog.records(sheet(spark))
    assert recs.count() == 4
    books = spark.createDataFrame([("CVI_OPACID_FA_807095020_X", "fad"), ("fa-DIR-one", "fad"), ("MTF_UNKNOWN_BOOK", "mtf"), ("FA_NO_TITLE", "fad")], "book_id string, source string")
    got = {r.book_id: r.rec for r in catalog.attach(books, recs, {"mtf": "Materials"}).collect()}
    assert got["CVI_OPACID_FA_807095020_X"].title == "By isbn" and got["CVI_OPACID_FA_807095020_X"].book_id == "CVI_OPACID_FA_807095020_X"
    assert got["fa-DIR-one"].title == "First" and got["fa-DIR-one"].authors == ["Novák Ján", "Malá Eva"] and got["fa-DIR-one"].year == 2009
    assert got["MTF_UNKNOWN_BOOK"].title == "Unknown Book" and not got["MTF_UNKNOWN_BOOK"].matched and got["MTF_UNKNOWN_BOOK"].faculty == "Materials"
    assert got["FA_NO_TITLE"].title == "No Title" and got["FA_NO_TITLE"].faculty == "FAD"
    looked = catalog.lookup(books, recs)
    r = catalog.match_report(looked, 4, ["source"]).first()
    assert (r.books, r.matched, r.missed, r.miss_sample) == (4, 3, 1, ["MTF_UNKNOWN_BOOK"])
    assert {r.source: (r.books, r.missed) for r in catalog.validate(looked).collect()} == {"fad": (3, 0), "mtf": (1, 1), "TOTAL": (4, 1)}
    with pytest.raises(ValueError, match="unknown fields"):
        catalog.records(sheet(spark), {"nothing": "x"})


def test_enrichment(spark):
    books = spark.createDataFrame([("FA_0415128269", "FAD", 3), ("FA_080442957X", "FAD", 4), ("FA_1234567890", "FAD", 5), ("FA_KNIHA", "FAD", 6)], "book_id string, faculty string, n_pages int")
    from folioscope.functions.ids import derive_isbn

    feed = "<rss><item><title>Stavby &amp; domy</title><pubDate>09</pubDate><description><![CDATA[<a href='x'>Novák, Ján</a> ; J070<br>Bratislava : Alfa, 1998<br>2. preprac. vyd. x]]></description></item></rss>"
    one = spark.createDataFrame([("0415128269", feed)], "isbn string, raw string").select("isbn", providers.from_feed("raw").alias("found"))
    asked = []

    def two(todo):
        asked.extend(r.isbn for r in todo.collect())
        raw = '{"ISBN:080442957X": {"title": "Two", "authors": [{"name": "A B"}], "publishers": [{"name": "P"}, {"name": "Q"}], "publish_date": "May 1985"}}'
        return todo.select("isbn", providers.from_open_library(F.lit(raw), "isbn").alias("found"))

    rows = catalog.enrich(books.withColumn("isbn", derive_isbn("book_id")), [("stu_opac", one), ("openlibrary", two)])
    got = {r.book_id: r for r in rows.collect()}
    assert set(asked) == {"080442957X"}
    f = got["FA_0415128269"].found
    assert (f.title, f.authors, f.year, f.place, f.publisher, f.edition) == ("Stavby & domy", ["Novák, Ján"], 1998, "Bratislava", "Alfa", "2. preprac. vyd. x")
    g = got["FA_080442957X"].found
    assert (g.title, g.publisher, g.year) == ("Two", "P; Q", 1985)
    assert [got[k].outcome for k in ("FA_0415128269", "FA_080442957X", "FA_1234567890", "FA_KNIHA")] == ["hit", "hit", "invalid", "invalid"]
    draft = {r["directory_id"]: r for r in catalog.draft_rows(rows, "found").collect()}
    assert draft["FA_0415128269"]["názov"] == "Stavby & domy" and draft["FA_0415128269"]["zdroj_metadat"] and draft["FA_KNIHA"]["názov"] == "Kniha"
    assert list(draft["FA_KNIHA"].asDict()) == list(catalog.DRAFT.values())
    volumes = '{"items": [{"volumeInfo": {"title": "V", "language": "ger", "publishedDate": "2001-02"}}]}'
    v = spark.range(1).select(providers.from_volumes(F.lit(volumes)).alias("f"), providers.from_volumes(F.lit('{"items": []}')).alias("n"), providers.from_feed(F.lit("<rss></rss>")).alias("e")).first()
    assert (v.f.language, v.f.year, v.n, v.e) == ("de", 2001, None, None)


BOX = "book string, page int, line_no int, text string, size double, y0 int, y1 int"


def lines(spark, special):
    body = [("b", 0, i, "plain words of the body text", 30.0, 500, 520) for i in range(12)]
    return spark.createDataFrame(body + [("b", p, 100 + i, t, s, 500, 520) for i, (p, t, s) in enumerate(special)], BOX)


def titles(df):
    return [(r.page, r.title) for r in structure.headings(df, ["book"]).orderBy("position").collect()]


def test_headings(spark):
    special = [(0, "VZŤAH TVORBY", 44.0), (0, "A PROSTREDIA", 45.0), (1, "Aja: PI", 44.0), (1, "ÚVOD", 44.0), (1, "|___|", 44.0), (2, "Section", 40.0), (2, "Larger", 44.0), (2, "Other Part", 49.0), (2, "Third", 80.0), (3, "One two three four", 40.0), (3, "Five six seven", 40.0), (4, "Prílohy SIETÍ -", 50.0), (5, "Small", 31.0), (5, "Table 7", 50.0)]
    want = [(0, "VZŤAH TVORBY A PROSTREDIA"), (1, "ÚVOD"), (2, "Section Larger"), (2, "Other Part"), (4, "Prílohy SIETÍ")]
    df = lines(spark, special)
    assert titles(df) == want and titles(df.orderBy(F.rand(1)).repartition(4)) == want
    assert titles(df.filter("size > 30 or line_no < 5")) == []  # too few body lines


def test_page_offset(spark):
    dims = spark.createDataFrame([("b", i, 700, 1000) for i in range(9)], "book string, page int, w int, h int")
    number = lambda p, t, y, n=0: ("b", p, n, t, 10.0, y, y + 10)
    rows = [number(2, "5", 980), number(3, "6", 20), number(4, "7", 985), number(5, "9", 985), number(6, "10", 985), number(7, "11", 985), number(8, "99", 500)]
    for order in itertools.islice(itertools.permutations(rows), 0, 5000, 1700):
        got = structure.page_offset(spark.createDataFrame(list(order), BOX), dims, ["book"]).collect()
        assert [(r.page_offset, r.hits) for r in got] == [(3, 3)]  # a tie: the first vote wins
    assert structure.page_offset(spark.createDataFrame(rows[:2], BOX), dims, ["book"]).count() == 0


def test_text_and_samples(spark):
    dims = spark.createDataFrame([("b", p) for p in range(3)], "book string, page int")
    got = structure.plain_text(spark.createDataFrame([("b", 2, 1, "z"), ("b", 0, 2, "y"), ("b", 0, 1, "x\U0001f600")], "book string, page int, line_no int, text string"), dims, ["book"]).first()
    assert got.text == "x\U0001f600\ny\f\fz" and got.ocr_chars == 7
    for n in (1, 2, 5, 8, 30):
        pages = list(range(n))
        mid, step = n // 2, max(n // 4, 1)
        rows = spark.createDataFrame([("b", p) for p in pages], "book string, page int").repartition(3)
        assert sorted(r.page for r in structure.middle_sample(rows, ["book"], ["page"]).collect()) == pages[mid::step][:3]


HOCR = """<?xml version="1.0"?><html><body><div class='ocr_page' title='image "x"; bbox 0 0 700 1000'>
<span class='ocr_line' title='bbox 1 2 3 4; x_size 30.5'><span class='ocrx_word'>Ahoj</span> skip <span class='ocrx_word'>sv&eacute;t</span></span>
<span class='ocr_line' title='bbox 1 2 3 4'><span class='ocrx_word'>no size</span></span></div>
<div class='ocr_page' title='none'><span class='ocr_header' title='bbox 5 6 7 8; x_size 40'><span class='ocrx_word'>H</span></span></div></body></html>"""


def test_hocr(spark):
    docs = structure.hocr(spark.createDataFrame([("b", HOCR), ("e", None)], "book string, markup string"), ["book"])
    got = [(r.page, r.line_no, r.text, r.size, r.x0, r.y1) for r in structure.hocr_lines(docs, ["book"]).orderBy("line_no").collect()]
    assert got == [(0, 0, "Ahoj svét", 30.5, 1, 4), (1, 1, "H", 40.0, 5, 8)]
    assert [(r.page, r.w, r.h) for r in structure.hocr_dims(docs, ["book"]).orderBy("page").collect()] == [(0, 700, 1000), (1, 0, 0)]


def test_language(spark):
    rows = [("en", i, "the cat of the house is in the garden and it was " * 5) for i in range(4)] + [("short", 0, "the of")]
    got = {r.b: r.language for r in structure.detect_language(spark.createDataFrame(rows, "b string, page int, text string"), ["b"], ["page"]).collect()}
    assert got == {"en": "en", "short": "sk"}


def spread():
    img = np.full((800, 1200, 3), 20, np.uint8)
    img[96:704, 96:1104] = 235
    for y in range(130, 670, 24):
        img[y : y + 8, 130:560] = img[y : y + 8, 640:1070] = 30
    return img


def test_images(spark):
    lay = images.analyze_spread(spread())
    assert 560 <= lay["gutter_x"] <= 640 and 0.5 < lay["paper_ratio"] < 0.8
    assert images.analyze_spread(spread()[:, :600])["gutter_x"] is None
    left, right = images.split_pages(spread(), lay)
    assert abs(left.shape[1] - right.shape[1]) < 120
    assert not images.is_color(spread()) and images.is_color(np.tile(np.array([200, 20, 20], np.uint8), (50, 50, 1)))
    yellow = np.full((64, 64, 3), (180, 220, 230), np.uint8)
    yellow[:40] -= 4
    assert (images.whiten(yellow)[40:] >= 254).all() and (images.whiten(yellow[:40]) == yellow[:40]).all() and images.skew(spread()) == 0.0
    frames = spark.createDataFrame([("b", 0, bytearray(spread().tobytes()), 800, 1200), ("b", 1, bytearray(b"x"), 800, 1200)], "book string, page int, data binary, height int, width int")
    got = {r.page: r for r in images.layouts(frames, ["book", "page"]).collect()}
    assert got[0].is_spread and not got[0].skipped and got[1].skipped and got[1].x0 is None


def test_deskew():
    page = np.full((400, 600, 3), 240, np.uint8)
    for y in range(40, 360, 20):
        page[y : y + 6, 60:540] = 20
    y, x = np.mgrid[0:400, 0:600]
    leaning = page[np.clip(np.rint(y - (x - 300) * np.tan(np.radians(2.0))).astype(int), 0, 399), x]
    assert images.skew(leaning) == pytest.approx(2.0, abs=0.3)
    upright, angle = images.deskew(leaning)
    assert angle == pytest.approx(2.0, abs=0.3) and abs(images.skew(upright)) <= 0.3 and upright.shape == page.shape


def test_unreadable_books(spark):
    ok = spark.createDataFrame([("a", False), ("a", True)], "book string, skipped boolean")
    assert structure.require_readable(ok, ["book"]).first().n_frames == 1
    with pytest.raises(Exception, match="no readable frame"):
        structure.require_readable(spark.createDataFrame([("b", True)], "book string, skipped boolean"), ["book"]).collect()


def test_markup_references(spark):
    """References without a semicolon are decoded or stay as written; scripts have none either way."""
    pages = spark.createDataFrame([(1, "<h1>a&amp b&amp;</h1><p>\ue000&#xE000;&#xD800;&eacute; &copy <script>x&y&amp;z&lt</script>"), (2, None)], "page_id long, html string")
    for lenient, want in ((True, ["a& b&", "\ue000\ue000\ufffd\xe9 \xa9 x&y&amp;z&lt"]), (False, ["a&amp b&", "\ue000\ue000\ufffd\xe9 &copy x&y&amp;z&lt"])):
        assert [r.text for r in structure.markup_lines(pages, lenient=lenient).orderBy("line_no").collect()] == want
