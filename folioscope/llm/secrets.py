"""Secret scans: strong patterns by themselves, weak parts only beside what completes them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, pieces

# The strong kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as all runs of [0-9a-f]+ without those of under 24
#: A text without any of these, in lower case, has no assignment.
NAMES = ("passw", "secret", "token", "api")
# Weak parts: a secret is 40 base64 signs of mixed kinds; an endpoint is an address with a scheme or cloud host; an owner names an account.
SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"(?:https?|s3|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}", re.A)
OWNER = re.compile(r"(?:client_id|user_?name|account_id|user|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})", re.I | re.A)
KINDS = ("assign", "access", "hex", "secret", "endpoint", "owner")
#: weak kind -> the kinds that complete it, one of which must co-occur.
COMPLETE = {"secret": ("access", "owner"), "endpoint": ("access", "assign"), "owner": ("assign",)}
#: Bytes of text that a worker turns into Python objects at once.
PIECE = 8 << 20
BREAK = re.compile(r"\n[\x20\t]*\n")


@dataclass(frozen=True)
class Linking:
    """scope: blocks between blank lines; reach: code points between two parts at most."""

    reach: int = 256


def strong(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    out = []
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def weak(text: str) -> list[tuple[int, int, str]]:
    mixed = lambda x: re.search("[a-z]", x) and re.search("[A-Z]", x) and re.search("[0-9]", x)
    out = [(m.start(), m.end(), "secret") for m in SECRET.finditer(text) if mixed(m[0])]
    if "://" in text:
        out += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    return out + [(m.start(), m.end(), "owner") for m in OWNER.finditer(text)]


Span = tuple[int, int, str]


def near(spans: list[Span], against: list[Span], reach: int) -> list[tuple[Span, Span]]:
    """Interval join: the spans that have one of `against` within reach, each with the one that goes
    furthest of those that start early enough (the first of equals). `against` is sorted by start."""
    starts = [a[0] for a in against]
    best = list(accumulate(against, lambda x, y: y if y[1] > x[1] else x))
    return [(s, best[i - 1]) for s in spans if (i := bisect_right(starts, s[1] + reach)) and best[i - 1][1] + reach >= s[0]]


def linked(text: str, how: Linking = Linking()) -> tuple[list[Span], list[tuple[Span, Span]]]:  # noqa: B008
    """All spans (start, end, kind) in code points, by start, then kind; and links: each weak span with
    the part that completes it. Weak parts that lie within a strong span of theirs, or have nothing to
    complete them in their scope and reach, are left out."""
    found, links = strong(text), []
    if any(k != "hex" for *_, k in found) or "://" in text:
        parts = sorted(weak(text) + found)
        edges = [m.end() for m in BREAK.finditer(text)]
        scopes: dict[int, dict[str, list]] = {}
        for p in parts:
            scopes.setdefault(bisect_right(edges, p[0]), {}).setdefault(p[2], []).append(p)
        taken = sorted(found)
        cover, upto = [t[0] for t in taken], list(accumulate((t[1] for t in taken), max))
        inside = lambda p: (i := bisect_left(cover, p[1])) and upto[i - 1] > p[0]
        for parts_of in scopes.values():
            for kind, needs in COMPLETE.items():
                if kind in parts_of:
                    against = sorted(x for n in needs for x in parts_of.get(n, []))
                    if kind == "secret":  # an owner counts only beside an endpoint, which has the third part
                        against = sorted([*parts_of.get("access", []), *(o for o, _ in near(parts_of.get("owner", []), parts_of.get("endpoint", []), how.reach))])
                    links += [x for x in near(parts_of[kind], against, how.reach) if not inside(x[0])]
    by = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return sorted([*found, *(x for x, _ in links)], key=by), sorted(links, key=lambda x: by(x[0]))


def scan(text: str, how: Linking = Linking()) -> list[Span]:  # noqa: B008
    return linked(text, how)[0]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Linking = Linking()) -> DataFrame:  # noqa: B008
    """id_col, spans array<struct<start, end, kind>> of every row, in code points, and links
    array<struct<part, completes>>: each weak span and the one that it is reported for.

    The parts of a credential lie in one text, so the interval join runs where the text is, without a
    shuffle. Null and empty texts have no spans; a long text is read whole, by itself; of parts that go
    equally far the first is linked; rows repeat as in docs, and an empty table gives an empty one;
    other columns are not read."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
    link = T.StructType([T.StructField("part", span), T.StructField("completes", span)])
    schema = T.StructType([docs.schema[id_col], T.StructField("spans", T.ArrayType(span)), T.StructField("links", T.ArrayType(link))])
    inner = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    pair = pa.struct([("part", inner), ("completes", inner)])
    row = lambda x: {"start": x[0], "end": x[1], "kind": x[2]}

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch, text_col, PIECE)):
            found = [linked(x, how) for x in as_text(b, text_col)]
            spans = pa.array([[row(x) for x in s] for s, _ in found], pa.list_(inner))
            links = pa.array([[{"part": row(x), "completes": row(y)} for x, y in ls] for _, ls in found], pa.list_(pair))
            yield pa.RecordBatch.from_arrays([b.column(id_col), spans, links], names=[id_col, "spans", "links"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", how: Linking = Linking(), mark: str = "[{}]") -> DataFrame:  # noqa: B008
    """docs with every span of its text replaced by its kind in brackets; overlapping spans become one,
    named for the first. Texts without spans, null and empty ones included, stay as they are; long ones
    are read whole; rows repeat as in docs, and an empty table gives an empty one."""

    def cut(text: str) -> str:
        out, at = [], 0
        for s, e, k in scan(text, how):
            if e > at:
                if s >= at:
                    out += [text[at:s], mark.format(k)]
                at = e
        return "".join([*out, text[at:]])

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch, text_col, PIECE)):
            i = b.schema.get_field_index(text_col)
            new = pa.array([None if x is None else cut(x) for x in b.column(i).to_pylist()], b.schema.field(i).type)
            yield b.set_column(i, b.schema.field(i), new)

    return docs.mapInArrow(run, docs.schema)


def _named(s):
    return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))


def joined(kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans, comma-joined."""
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, _named), ",")


def joined_links():
    """part>completes of the links, comma-joined."""
    return F.array_join(F.transform("links", lambda x: F.concat_ws(">", _named(x["part"]), _named(x["completes"]))), ",")
