"""Covers as SVG: wrapped and fitted text, a template registry, an Arrow UDF that gives the file."""

from __future__ import annotations

from collections.abc import Callable
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.covers import ACCENTS, INK, MUTED, PAGE

WIDTH, HEIGHT = 600, 850
#: A measure gives the width of a text at a size, in pixels.
Measure = Callable[[str, float], float]


def by_letters(text: str, size: float) -> float:
    """About the width of a plain sans-serif type; narrow and wide letters count apart."""
    return size * sum(0.28 if c in "il.,:;'|! " else 0.85 if c in "mwMW@" else 0.66 if c.isupper() else 0.53 for c in text)


def wrapped(text: str, width: float, size: float, measure: Measure = by_letters) -> list[str]:
    """Lines that take as many words as fit; a word that is too wide is a line by itself."""
    lines: list[str] = []
    for word in text.split():
        if lines and measure(f"{lines[-1]} {word}", size) <= width:
            lines[-1] += f" {word}"
        else:
            lines.append(word)
    return lines


def fitted(text: str, width: float, height: float, largest: int = 64, smallest: int = 18, leading: float = 1.2, measure: Measure = by_letters) -> tuple[int, list[str]]:
    """The largest size at which the wrapped text fits the box, and its lines; the smallest if none."""
    for size in range(largest, smallest - 1, -2):
        lines = wrapped(text, width, size, measure)
        if len(lines) * size * leading <= height and all(measure(x, size) <= width for x in lines):
            return size, lines
    return smallest, wrapped(text, width, smallest, measure)


def plain_cover(r: dict, accent: tuple[int, int, int]) -> str:
    """Authors, title, subtitle and footer on a light page, with a line in the faculty's colour."""
    rgb = lambda c: "rgb({},{},{})".format(*c)
    parts, y = [f'<rect width="{WIDTH}" height="{HEIGHT}" fill="{rgb(PAGE)}"/>', f'<rect x="50" y="150" width="90" height="6" fill="{rgb(accent)}"/>'], 220.0

    def put(text: str | None, box: float, largest: int, colour) -> None:
        nonlocal y
        if text:
            size, lines = fitted(text, WIDTH - 100, box, largest)
            for line in lines:
                y += size * 1.2
                parts.append(f'<text x="50" y="{y:.0f}" font-family="sans-serif" font-size="{size}" fill="{rgb(colour)}">{escape(line)}</text>')
            y += 20

    put(", ".join(x for x in (r.get("authors") if r.get("authors") is not None else []) if x), 70, 26, MUTED)
    put(r.get("title"), 320, 60, INK)
    put(r.get("subtitle"), 90, 30, MUTED)
    y = HEIGHT - 90
    put(r.get("footer"), 50, 20, MUTED)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}">{"".join(parts)}</svg>'


TEMPLATES: dict[str, Callable[[dict, tuple[int, int, int]], str]] = {"plain": plain_cover}


def template(name: str):
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name!r}; known: {', '.join(TEMPLATES)}")
    return TEMPLATES[name]


def covers(books: DataFrame, name: str = "plain") -> DataFrame:
    """books (title, subtitle, authors, footer, faculty_key) with `cover`, an SVG file."""
    draw = template(name)
    fields = ("title", "subtitle", "authors", "footer", "faculty_key")

    @F.pandas_udf("binary")
    def drawn(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([draw(r, ACCENTS.get(r["faculty_key"], ACCENTS["stu"])).encode() for r in rows.to_dict("records")])

    return books.withColumn("cover", drawn(F.struct(*fields)))


def first_existing(candidates: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Of candidates (keys, rank, path) the one of least rank whose file is in a listing."""
    return candidates.join(there.select("path"), "path", "left_semi").groupBy(*keys).agg(F.min_by("path", "rank").alias("path"))
