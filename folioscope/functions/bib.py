"""Bibliographic columns: authors, years, languages, faculties, catalog entries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, basename, clean, col, first_true, squeeze, strip

# Language codes, OCR codes, faculties and the parts of names that tell them.
LANGUAGES = {"slo": "sk", "slk": "sk", "sk": "sk", "cze": "cs", "ces": "cs", "cs": "cs", "eng": "en", "en": "en", "ger": "de", "deu": "de", "de": "de", "rus": "ru", "ru": "ru"}
OCR_CODES = {"sk": "slk", "cs": "ces", "en": "eng", "de": "deu", "ru": "rus"}
FACULTIES = ("fei", "fiit", "fchpt", "mtf", "sjf", "svf", "fad")
FACULTY_PARTS = (("elektrotech", "fei"), ("architekt", "fad"), ("dizajn", "fad"), ("informatik", "fiit"), ("chemic", "fchpt"), ("chemick", "fchpt"), ("potravin", "fchpt"), ("materiál", "mtf"), ("materialov", "mtf"), ("strojníc", "sjf"), ("strojnic", "sjf"), ("stavebn", "svf"))
AUTHOR_GAPS = r"\s*[;/]\s*|\s+&\s+|\s+a\s+(?=[A-ZČŠŽ])"


def lookup(table: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def split_authors(c: C) -> Column:
    """Names between semicolons, slashes, ampersands, or `a` before a capital."""
    return F.filter(F.transform(F.split(col(c), AUTHOR_GAPS), strip), lambda x: x != "")


def coerce_year(c: C) -> Column:
    """The first four digits in a row, anywhere."""
    return F.nullif(F.regexp_extract(col(c).cast("string"), r"\d{4}", 0), F.lit("")).try_cast("int")


def map_language(c: C) -> Column:
    """The two-letter code of a supported language, or null."""
    return lookup(LANGUAGES, F.lower(strip(c)))


def resolve_language(meta: C, ocr: C, default: str = "slk") -> Column:
    """The catalog's language, else the first OCR language, else the default."""
    first = F.lower(strip(F.split(col(ocr), r"\+")[0]))
    return F.coalesce(F.when(col(meta) != "", F.lower(strip(meta))), F.nullif(first, F.lit("")), F.lit(default))


def ocr_languages(iso: C) -> Column:
    """OCR languages for a detected one: itself, and the collection's usual second ones."""
    main = F.coalesce(lookup(OCR_CODES, col(iso)), F.lit("slk"))
    return F.when(main == "eng", F.lit("eng+slk")).when(main == "slk", F.lit("slk+eng")).otherwise(F.concat(main, F.lit("+slk+eng")))


def split_author(c: C, order: str = "given_first") -> Column:
    """struct<name, surname>. A comma parts surname and given name; else `order` tells which end the
    surname is at. One word is a surname."""
    name = squeeze(F.coalesce(col(c), F.lit("")))
    parts = F.split(name, " ")
    n = F.size(parts)
    both = lambda given, surname: F.struct(given.alias("name"), surname.alias("surname"))
    spaced = both(F.array_join(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), " "), parts[0]) if order == "surname_first" else both(F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), " "), F.element_at(parts, -1))
    comma = both(strip(F.regexp_replace(name, "^[^,]*,", "")), strip(F.split(name, ",")[0]))
    return F.when(F.contains(name, F.lit(",")), comma).when(n == 1, both(F.lit(""), parts[0])).otherwise(spaced)


def author_line(authors: C) -> Column:
    return F.array_join(col(authors), ", ")


def footer(publisher: C, year: C) -> Column:
    """Publisher and year, whichever there are."""
    return F.concat_ws(" · ", F.nullif(col(publisher), F.lit("")), F.when(col(year) != 0, col(year).cast("string")))


def metadata_arguments(title: C, authors: C, language: C, creator: str = "folioscope") -> Column:
    """Arguments that give a PDF its title, authors and language, as far as there are any."""
    pair = lambda flag, value: F.when(F.coalesce(value, F.lit("")) != "", F.array(F.lit(flag), value)).otherwise(F.array().cast("array<string>"))
    names = F.array_join(F.coalesce(col(authors), F.array().cast("array<string>")), "; ")
    return F.concat(F.array(F.lit("--metadata-creatortool"), F.lit(creator)), pair("--metadata-title", col(title)), pair("--metadata-author", names), pair("--metadata-language", col(language)))


def faculty_key(c: C) -> Column:
    """A faculty's short name: as a word of the text, else by parts of names in order; `stu` if none."""
    text = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    tokens = F.split(F.regexp_replace(text, "[-_]", " "), r"\s+")
    out = F
    for key in FACULTIES:
        out = out.when(F.array_contains(tokens, key), F.lit(key))
    for part, key in FACULTY_PARTS:
        out = out.when(F.contains(text, F.lit(part)), F.lit(key))
    return out.otherwise(F.lit("stu"))


def faculty_name(record: C, source: C, names: Mapping[str, str] | None = None) -> Column:
    """The record's faculty, else the name configured for the source, else the source in capitals."""
    named = lookup(names, col(source)) if names else F.lit(None).cast("string")
    return first_true(col(record), F.coalesce(named, F.upper(col(source))))


def manifest(*, source: C, book_id: C, title: C, authors: C, pdf: C, catalog: C | None = None, default_catalog: str = "", isbn: C, year: C, publisher: C, language: C, ocr_language: C, faculty: C, page_count: C, matched: C, cover: C, relation: str = "open-access", config: Mapping[str, str] | None = None, default_language: str = "slk", order: str = "given_first") -> Column:
    """A catalog entry as a struct: identifiers only with an ISBN, the year as a partial date, file
    names without folders; the record's own catalog wins over the default."""
    target = first_true(col(catalog), F.lit(default_catalog)) if catalog is not None else F.lit(default_catalog)
    number = clean(isbn)
    return F.struct(
        col(source).alias("source"), col(book_id).alias("book_id"), F.concat(col(source), F.lit("_"), col(book_id)).alias("slug"), col(faculty).alias("faculty"),
        col(page_count).alias("page_count"), col(matched).alias("matched"), target.alias("catalog"), col(title).alias("title"),
        resolve_language(language, ocr_language, default_language).alias("language_code"),
        F.transform(F.filter(col(authors), lambda a: strip(a) != ""), lambda a: split_author(a, order)).alias("authors"),
        col(publisher).alias("publisher"), F.when(col(year) != 0, col(year).cast("string")).alias("published_at"), F.lit(None).cast("string").alias("summary"),
        F.when(number.isNotNull(), F.create_map(F.lit("isbn"), number)).otherwise(F.from_json(F.lit("{}"), "map<string,string>")).alias("identifiers"),
        F.from_json(F.lit(__import__("json").dumps(dict(config or {}))), "map<string,string>").alias("config"),
        F.lit(relation).alias("relation"), basename(pdf).alias("pdf"), basename(cover).alias("cover"),
    )


def entry_payload(m: Column, image: Column | None = None) -> Column:
    """The JSON of a new catalog entry: only fields with something in them."""
    some = lambda f: F.when(F.size(m[f]) > 0, m[f]).alias(f)
    text = lambda f: F.nullif(m[f], F.lit("")).alias(f)
    fields = [m["title"].alias("title"), m["language_code"].alias("language_code"), some("authors"), some("identifiers"), text("publisher"), text("published_at"), text("summary"), some("config")]
    return F.to_json(F.struct(*fields, *([image.alias("image")] if image is not None else [])))
