"""Book ids: comparison keys, tokens, titles from slugs, and ISBNs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col, is_upper, strip, title_case

#: Fixed value: an optional collection mark, an optional faculty mark, and the rest.
DIRECTORY = r"(?s)^(?:CVI_OPACID_)?(?:[A-Z]{2,4}_)?(.+)$"


def normalize_id(c: C) -> Column:
    """Letters A-Z and digits only, in capitals."""
    return F.upper(F.regexp_replace(col(c).cast("string"), "[^0-9A-Za-z]", ""))


def directory_token(c: C) -> Column:
    """The id or slug in a directory's name; a name that is a mark only stays whole."""
    return F.coalesce(F.nullif(F.regexp_extract(col(c), DIRECTORY, 1), F.lit("")), col(c))


def deslug(c: C) -> Column:
    """A readable title from a directory's name: title case for slugs and capitals."""
    token = directory_token(c)
    plain = strip(F.regexp_replace(token, "[_)(]+", " "))
    return F.when(is_upper(plain) | F.contains(token, F.lit("_")), title_case(plain)).otherwise(F.coalesce(F.nullif(plain, F.lit("")), col(c)))


def derive_isbn(c: C) -> Column:
    """The ISBN that a directory is named by, or ''."""
    token = directory_token(c)
    return F.when(token.rlike(r"^(\d{13}|\d{9}[\dXx])$"), F.upper(token)).when(token.rlike(r"^\d{9}_[Xx]$"), F.upper(F.replace(token, F.lit("_"), F.lit("")))).otherwise(F.lit(""))


def guess_title(c: C) -> Column:
    """'' for directories named by a number, else the readable title."""
    return F.when(directory_token(c).rlike("^[0-9_Xx]+$"), F.lit("")).otherwise(deslug(c))


def normalize_isbn(c: C) -> Column:
    return F.upper(F.regexp_replace(col(c).cast("string"), "[^0-9Xx]", ""))


def is_valid_isbn(c: C) -> Column:
    """The checksum of an ISBN-10 (weights 10 to 1, mod 11) or ISBN-13 (weights 1 and 3, mod 10)."""
    s = normalize_isbn(c)
    signs = F.transform(F.regexp_extract_all(s, F.lit("(.)"), F.lit(1)), lambda x: F.when(x == "X", 10).otherwise(x.try_cast("int")))
    total = lambda weight: F.aggregate(F.transform(signs, lambda d, i: d * weight(i)), F.lit(0), lambda a, d: a + d)
    ten = total(lambda i: 10 - i) % 11 == 0
    thirteen = total(lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0
    return F.when(s.rlike(r"^\d{9}[\dX]$"), ten).when(s.rlike(r"^\d{13}$"), thirteen).otherwise(F.lit(False))
