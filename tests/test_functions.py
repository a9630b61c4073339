"""Columns: ids, bibliography, texts, covers."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import bib, covers, ids, text


def values(spark, rows, *cols):
    """The columns over rows of one text column v, as a list of tuples."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [tuple(r)[0] if len(cols) == 1 else tuple(r) for r in df.orderBy("i").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()]


def test_ids(spark):
    rows = ["CVI_OPACID_FA_807095020_X", "AB_", "978-80-227", "CVI_OPACID_x", None]
    assert values(spark, rows, ids.directory_token("v")) == ["807095020_X", "AB_", "978-80-227", "x", None]
    assert values(spark, ["a-b 1_ž", "978 80"], ids.normalize_id("v")) == ["AB1", "97880"]


def test_titles(spark):
    rows = ["FA_MODERNA_ARCHITEKTURA", "o'neil 2nd", "FAD_kniha (2)", "FA_ŽIVOT", "__", "plain name"]
    assert values(spark, rows, ids.deslug("v")) == ["Moderna Architektura", "o'neil 2nd", "kniha  2", "Život", "", "plain name"]
    assert values(spark, ["O'NEIL 2ND AB-CD"], text.title_case("v")) == ["O'Neil 2Nd Ab-Cd"]
    assert values(spark, ["FA_807095020_X", "MTF_KNIHA", "9788022712345"], ids.guess_title("v")) == ["", "Kniha", ""]


def test_isbn(spark):
    rows = ["9788022712345", "FA_807095020_x", "807095020X", "12345", "FA_80709502"]
    assert values(spark, rows, ids.derive_isbn("v")) == ["9788022712345", "807095020X", "807095020X", "", ""]
    rows = ["0415128269", "0-415-12826-9", "080442957X", "0415128260", "9780306406157", "9780306406158", "X234567890", "", None]
    assert values(spark, rows, ids.is_valid_isbn("v")) == [True, True, True, False, True, False, False, False, False]


def test_bibliography(spark):
    rows = ["Novák Ján; Malá Eva", "A B / C D & E F", "Ján Novák a Eva Malá", "Anna a ja", ";;"]
    assert values(spark, rows, bib.split_authors("v")) == [["Novák Ján", "Malá Eva"], ["A B", "C D", "E F"], ["Ján Novák", "Eva Malá"], ["Anna a ja"], []]
    assert values(spark, ["vyd. 2009", "12345", "99", None], bib.coerce_year("v")) == [2009, 1234, None, None]
    assert values(spark, [" ENG ", "slo", "fra", None], bib.map_language("v")) == ["en", "sk", None, None]
    assert values(spark, ["sk", "en", "de", "xx"], bib.ocr_languages("v")) == ["slk+eng", "eng+slk", "deu+slk+eng", "slk+eng"]
    assert values(spark, [" SK ", "", None], bib.resolve_language("v", F.lit("eng+slk"))) == ["sk", "eng", "eng"]
    assert values(spark, [None], bib.resolve_language("v", F.lit(None).cast("string"))) == ["slk"]
    a = bib.split_author("v")
    assert values(spark, ["Ján  Peter Novák", "Novák, Ján", "Platón", " ", None], a["name"], a["surname"]) == [("Ján Peter", "Novák"), ("Ján", "Novák"), ("", "Platón"), ("", ""), ("", "")]
    s = bib.split_author("v", "surname_first")
    assert values(spark, ["Novák Ján Peter"], s["name"], s["surname"]) == [("Ján Peter", "Novák")]


@pytest.mark.parametrize(("name", "key"), [("fei", "fei"), ("STU-FIIT", "fiit"), ("Fakulta elektrotechniky a informatiky STU", "fei"), ("Fakulta informatiky", "fiit"), ("Stavebná fakulta", "svf"), ("Fakulta architektúry a dizajnu", "fad"), ("Fakulta chemickej a potravinárskej", "fchpt"), ("", "stu"), (None, "stu"), ("STU", "stu")])
def test_faculty(spark, name, key):
    assert values(spark, [name], bib.faculty_key("v")) == [key]


def test_manifest(spark):
    null = F.lit(None).cast("string")
    m = bib.manifest(source=F.lit("fad"), book_id="v", title=F.lit("T"), authors=F.array(F.lit("Ján Novák")), pdf=F.lit("/o/x.pdf"), default_catalog="main", isbn=F.lit(" 1 "), year=F.lit(0), publisher=F.lit(""), language=null, ocr_language=null, faculty=null, page_count=F.lit(3), matched=F.lit(True), cover=null, config={"a": "b"})
    row = values(spark, ["b1"], m)[0]
    assert (row.slug, row.catalog, row.published_at, row.identifiers, row.pdf, row.cover) == ("fad_b1", "main", None, {"isbn": "1"}, "x.pdf", None)
    assert values(spark, ["b1"], bib.entry_payload(m)) == ['{"title":"T","language_code":"slk","authors":[{"name":"Ján","surname":"Novák"}],"identifiers":{"isbn":"1"},"config":{"a":"b"}}']


def test_formats(spark):
    df = spark.createDataFrame([(12.9, 1, 2), (185.0, 5, 0), (7620.0, 3, 2)], "s double, done int, total int")
    rows = df.select(text.elapsed("s").alias("e"), text.bar("done", "total", 4).alias("b"), text.percent("done", "total").alias("p")).collect()
    assert [r.e for r in rows] == ["12s", "3m05s", "2h07m"]
    assert [r.b for r in rows] == ["[██░░]  50%", "—", "[████] 100%"] and [r.p for r in rows] == [50.0, 0.0, 100.0]
    assert values(spark, ["xiv", "MCMXC", "abc"], text.roman_value("v")) == [14, 1990, None]
    pages = spark.range(6).select(F.col("id").cast("int").alias("p"), F.lit(-2).alias("o"))
    assert [r[0] for r in pages.select(text.page_label("p", "o")).collect()] == ["i", "ii", "iii", "1", "2", "3"]
    assert values(spark, ["<a & 'b'>"], text.escape_html("v")) == ["&lt;a &amp; &#x27;b&#x27;&gt;"]
    assert values(spark, [" x\n", " ", "NaN", None], text.clean("v")) == ["x", None, None, None]
    assert values(spark, ["s"], text.pdf_path(F.lit("o"), "v", F.lit("s_b"), F.lit("archival")), text.pdf_path(F.lit("o"), "v", F.lit("s_b"), F.lit("archival"), "split")) == [("o/s/s_b.archival.pdf", "o/archival/s/s_b.pdf")]


def test_covers(spark):
    c = covers.from_hex("v")
    assert values(spark, ["#8e0733"], c["r"], c["g"], c["b"]) == [(142, 7, 51)]
    ink = covers.accent_ink(covers.constant((214, 178, 0)))
    assert values(spark, ["x"], ink["r"], ink["g"], ink["b"]) == [(175, 146, 0)]
    over = covers.palette("v", {"fei": {"accent": "#010203"}})["accent"]
    assert values(spark, ["fei", "fad"], over["r"], over["b"]) == [(1, 3), (0, 70)]
    df = spark.createDataFrame([(100, 90), (100, 79), (None, None)], "w int, h int")
    assert [r[0] for r in df.select(covers.cover_source("w", "h")).collect()] == ["opac", "generated", "generated"]


def test_profiles():
    first, second = covers.profiles({})
    assert first.arguments() == ["--mrc-image-format", "jpeg", "--mask-compression", "jbig2", "--denoise-mask", "fast", "--bg-downsample", "3", "--hq-pages", "1,2,3,4,-4,-3,-2,-1"]
    assert second.arguments()[:4] == ["--mrc-image-format", "jpeg2000", "-J", "pillow"] and second.pdfa == "2b"
    (only,) = covers.profiles({"render": {"outputs": ["archival"], "archival": {"pdfa": "2u", "nothing": 1, "downsample": None}}})
    assert only.pdfa == "2u"
    with pytest.raises(ValueError, match="unknown profile"):
        covers.profiles({"render": {"outputs": ["x"]}})


def test_pdf_metadata(spark):
    args = bib.metadata_arguments("v", F.array(F.lit("A"), F.lit("B")), F.lit(None).cast("string"), "x")
    assert values(spark, ["T", None], args) == [["--metadata-creatortool", "x", "--metadata-title", "T", "--metadata-author", "A; B"], ["--metadata-creatortool", "x", "--metadata-author", "A; B"]]
