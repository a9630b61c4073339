"""Colours of covers, where a cover comes from, and output profiles."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bib import faculty_key
from .text import C, col

# Page, ink and secondary ink, and the accent of each faculty.
PAGE, INK, MUTED = (247, 246, 242), (28, 28, 30), (118, 116, 112)
ACCENTS = {"stu": (142, 7, 51), "fad": (0, 150, 70), "fei": (19, 76, 149), "fiit": (29, 124, 170), "fchpt": (214, 178, 0), "mtf": (178, 22, 30), "sjf": (142, 7, 51), "svf": (196, 108, 26)}


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


def constant(c: tuple[int, int, int]) -> Column:
    return rgb(*map(F.lit, c))


def from_hex(c: C) -> Column:
    """#rrggbb as a struct."""
    h = F.regexp_replace(col(c), "^#+", "")
    return rgb(*[F.conv(F.substring(h, at, 2), 16, 10) for at in (1, 3, 5)])


def shade(color: Column, factor: float) -> Column:
    """Lighter (factor over 1) or darker, each part between 0 and 255."""
    part = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(color[x] * F.lit(factor)).cast("int")))
    return rgb(part("r"), part("g"), part("b"))


def luminance(color: Column) -> Column:
    """With a weight of 0.4126 for blue, as the reference has it."""
    return 0.2126 * color["r"] + 0.7152 * color["g"] + 0.4126 * color["b"]


def accent_ink(color: Column, steps: int = 32) -> Column:
    """The accent, darkened by 0.82 until it can be read on a light page."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), color, lambda a, _: F.when(luminance(a) > 150, shade(a, 0.82)).otherwise(a))


def palette(faculty: C, overrides: Mapping[str, Mapping[str, str]] | None = None) -> Column:
    """struct<bg, accent, text, muted> of a faculty."""
    key = faculty_key(faculty)
    base = {"bg": dict.fromkeys(ACCENTS, PAGE), "accent": ACCENTS, "text": dict.fromkeys(ACCENTS, INK), "muted": dict.fromkeys(ACCENTS, MUTED)}

    def part(name: str) -> Column:
        out = constant(base[name]["stu"])
        for k, v in base[name].items():
            over = (overrides or {}).get(k, {}).get(name)
            out = F.when(key == k, from_hex(F.lit(over)) if over else constant(v)).otherwise(out)
        return out.alias(name)

    return F.struct(*map(part, base))


def cover_source(width: C, height: C, mode: str = "opac_then_generated", least: int = 80) -> Column:
    """opac where both sides of the found cover are large enough, else generated if the mode has it."""
    found = F.coalesce((col(width) >= least) & (col(height) >= least), F.lit(False)) & F.lit(mode.startswith("opac"))
    return F.when(found, "opac").otherwise(F.lit("generated" if "generated" in mode else "none"))


def pdf_outputs(books: DataFrame, keys: list[str], artifacts: str = "artifacts") -> DataFrame:
    """(keys, profile, path) of the PDFs that a book's artifacts (a map) name, one for each pdf_<profile>;
    where there is none of those, a single `pdf` is the profile `default`."""
    made = F.map_filter(artifacts, lambda k, _: k.startswith("pdf_"))
    single = F.map_filter(artifacts, lambda k, _: k == "pdf")
    rows = books.select(*keys, F.explode(F.when(F.size(made) > 0, made).otherwise(single)).alias("_k", "path"))
    return rows.select(*keys, F.when(F.col("_k") == "pdf", "default").otherwise(F.regexp_replace("_k", "^pdf_", "")).alias("profile"), "path")


@dataclass(frozen=True)
class Profile:
    """How the pages of a book become one PDF."""

    name: str
    image_format: str = "jpeg"
    bg_downsample: int | None = None
    fg_downsample: int | None = None
    downsample: int | None = None
    mask_compression: str = "jbig2"
    denoise_mask: str = "fast"
    jpeg2000_encoder: str = "pillow"
    hq_pages: str | None = "1,2,3,4,-4,-3,-2,-1"
    bg_compression_flags: str | None = None
    fg_compression_flags: str | None = None
    linearize: bool = True
    pdfa: str | None = None

    def arguments(self) -> list[str]:
        """Command-line arguments of the encoder, without files and resolution."""
        pairs = [("--mrc-image-format", self.image_format), ("-J", self.jpeg2000_encoder if self.image_format == "jpeg2000" else None), ("--mask-compression", self.mask_compression), ("--denoise-mask", self.denoise_mask)]
        pairs += [("--" + k.replace("_", "-"), getattr(self, k)) for k in ("downsample", "bg_downsample", "fg_downsample")] + [("--hq-pages", self.hq_pages or None)]
        joined = [f"--{k.replace('_', '-')}={v}" for k in ("bg_compression_flags", "fg_compression_flags") if (v := getattr(self, k))]
        return [str(x) for k, v in pairs if v is not None for x in (k, v)] + joined

    def with_overrides(self, overrides: Mapping[str, object]) -> Profile:
        known = {f.name for f in fields(self)} - {"name"}
        return replace(self, **{k: v for k, v in overrides.items() if k in known and v is not None})


PROFILES = {p.name: p for p in (Profile("distribution", bg_downsample=3), Profile("archival", "jpeg2000", bg_downsample=2, linearize=False, pdfa="2b"))}


def profiles(config: Mapping) -> list[Profile]:
    """The profiles that [render] asks for, with its overrides; ValueError for an unknown name."""
    render = config.get("render", {})
    out = []
    for name in render.get("outputs") or PROFILES:
        if name not in PROFILES:
            raise ValueError(f"unknown profile {name!r}; known: {', '.join(PROFILES)}")
        out.append(PROFILES[name].with_overrides(render.get(name, {})))
    return out
