"""String and number columns: trimming, title case, formats, page labels, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = str | Column


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: C) -> Column:
    """Without white space at both ends, of any script."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clean(c: C) -> Column:
    """Trimmed text; null when nothing, or a number that isn't one, is left."""
    t = strip(col(c).cast("string"))
    return F.when((t != "") & (t != "NaN"), t)


def squeeze(c: C) -> Column:
    """Trimmed, with single spaces for runs of white space."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def words(c: C) -> Column:
    """The words between white space; none for a blank text."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def title_case(c: C) -> Column:
    """Each run of letters starts with a capital and goes on in small letters, also after an apostrophe
    or digit."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")


def is_upper(c: C) -> Column:
    """Has cased letters and no small ones."""
    return (col(c) == F.upper(col(c))) & (col(c) != F.lower(col(c)))


def elapsed(seconds: C) -> Column:
    """12s, 3m05s, 2h07m."""
    s = F.floor(col(seconds)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.floor(s / 60)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"), two(s % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), two(minutes % 60), F.lit("m")))
    )


def bar(done: C, total: C, width: int = 18) -> Column:
    """A text bar with the per cent done; a dash without a total."""
    share = F.least(col(done) / col(total), F.lit(1.0))
    full = F.bround(share * width).cast("int")
    drawn = F.concat(F.lit("["), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), width - full), F.lit("] "), F.lpad(F.bround(share * 100).cast("int").cast("string"), 3, " "), F.lit("%"))
    return F.when(F.coalesce(col(total), F.lit(0)) > 0, drawn).otherwise(F.lit("—"))


def percent(done: C, total: C) -> Column:
    """Per cent done, 100 at most, 0 without a total."""
    return F.when(F.coalesce(col(total), F.lit(0)) > 0, F.least(100.0 * col(done) / col(total), F.lit(100.0))).otherwise(F.lit(0.0))


def escape_html(c: C) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, col(c))


def roman(number: C) -> Column:
    """Small roman numerals of 1 to 3999."""
    n = col(number).cast("int")
    # The numerals of each digit.
    digits = [("", "m", "mm", "mmm"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")]
    return F.concat(*[F.element_at(F.array(*map(F.lit, d)), F.least(F.floor(n / p) % 10, F.lit(len(d) - 1)).cast("int") + 1) for d, p in zip(digits, (1000, 100, 10, 1), strict=True)])


def roman_value(c: C) -> Column:
    """The number of a roman numeral; null for other text."""
    values = F.create_map(*[x for k, v in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in (F.lit(k), F.lit(v))])
    each = F.transform(F.regexp_extract_all(F.lower(col(c)), F.lit("(.)"), F.lit(1)), lambda s: values[s])
    signed = F.transform(each, lambda v, i: F.when(v < F.coalesce(F.get(each, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(col(c).rlike("(?i)^[ivxlcdm]+$"), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def page_label(page: C, offset: C) -> Column:
    """Roman labels up to the first page whose printed number is 1 or more, printed numbers from there."""
    start = F.greatest(F.lit(0), 1 - col(offset))
    return F.when(col(offset).isNull(), (col(page) + 1).cast("string")).when(col(page) < start, roman(col(page) + 1)).otherwise((col(page) + col(offset)).cast("string"))


def basename(c: C) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def book_dir(root: C, source: C, layout: str = "flat") -> Column:
    """Where a book's side files lie: by source, below the main profile in the split layout."""
    return F.concat_ws("/", col(root), F.lit("distribution"), col(source)) if layout == "split" else F.concat_ws("/", col(root), col(source))


def pdf_path(root: C, source: C, slug: C, profile: C, layout: str = "flat") -> Column:
    """Where the PDF of a profile lies; the one function that listing, manifests and import use."""
    if layout == "split":
        return F.concat(F.concat_ws("/", col(root), col(profile), col(source), col(slug)), F.lit(".pdf"))
    return F.concat(book_dir(root, source), F.lit("/"), col(slug), F.lit("."), col(profile), F.lit(".pdf"))


def first_true(*cs: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
