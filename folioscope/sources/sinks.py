"""Sinks: logs, exports, manifests, heartbeats, imports."""

from __future__ import annotations

import base64
import json
import mimetypes
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, percent
from ..operators.reports import UNKNOWN, as_map, keyed, summarize, summarize_by_source, tally
from .schemas import PUBLISH

#: The columns of the CSV export, in order.
CSV_FIELDS = ("source", "book_id", "status", "title", "catalog_matched", "language", "n_frames", "n_pages", "pdf_mb", "ocr_chars", "minutes", "pdf", "cover", "manifest", "error")
#: Keys by which a record of an entry may be named.
IDENTIFIERS = ("isbn", "google", "doi")


def append_log(rows: DataFrame, folder: str) -> None:
    """Adds part files of JSON lines. Each append makes new files, so that a stream over the folder
    gets every row."""
    rows.write.mode("append").option("ignoreNullFields", True).json(folder)


def csv_rows(rows: DataFrame) -> DataFrame:
    """The fixed columns, absent ones null, in the order of source and book."""
    picked = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in CSV_FIELDS])
    return picked.orderBy(F.coalesce("source", F.lit("")), F.coalesce("book_id", F.lit("")))


def write_csv(rows: DataFrame, path: str) -> str:
    csv_rows(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def summary_json(rows: DataFrame) -> DataFrame:
    """One row with the summary as JSON: overall, and by source, each with its count of every status."""
    whole = summarize(rows).crossJoin(as_map(tally(rows, missing=UNKNOWN))).select(F.struct("*").alias("overall"))
    said = keyed(rows).groupBy("source", "status").agg(F.count("*").alias("n")).groupBy("source")
    said = said.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    each = summarize_by_source(rows).join(said, "source", "left").select("source", F.struct("*").dropFields("source").alias("s"))
    # Maps have no order, so the entries are compared by their source alone.
    before = lambda a, b: F.when(a["source"] < b["source"], -1).when(a["source"] > b["source"], 1).otherwise(0)
    by = each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "s")), before)).alias("by_source"))
    return whole.crossJoin(by).select(F.to_json(F.struct("overall", "by_source"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(rows: DataFrame, path: str) -> str:
    text = json.dumps(json.loads(summary_json(rows).first().value), ensure_ascii=False, indent=2)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
    return path


def html_rows(rows: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Table rows of the HTML report, one for each source."""
    from ..functions.text import escape_html

    out = summarize_by_source(rows)
    out = out.join(totals.select("source", "total"), "source", "left") if totals is not None else out.withColumn("total", F.lit(None).cast("long"))
    label = F.when(F.col("total") > 0, F.concat_ws("/", col("books").cast("string"), col("total").cast("string"))).otherwise(col("books").cast("string"))
    drawn = F.format_string('<div class="bar"><div style="width:%.0f%%"></div><span>%s</span></div>', percent("books", "total"), label)
    cells = [escape_html("source"), drawn, *[F.col(c).cast("string") for c in ("produced", "skipped", "errors", "pages")], F.format_string("%.0f", "pdf_mb"), F.format_string("%.0f", "minutes"), F.coalesce(F.format_string("%.0f", F.col("pages_per_min")), F.lit("—"))]
    return out.orderBy("source").select(F.concat(F.lit("<tr><td>"), F.array_join(F.array(*cells), "</td><td>"), F.lit("</td></tr>")).alias("row"))


def write_html(rows: DataFrame, path: str, totals: DataFrame | None = None, publish: Mapping[str, int] | None = None, title: str = "Results") -> str:
    """A page that needs nothing else. Only a row for each source reaches the driver."""
    import html

    s = summarize(rows).first()
    head = f"books {s.books} &middot; output {s.pdf_mb / 1000:.1f} GB &middot; {s.pages:,} pages" + (f" &middot; {s.mb_per_page:.2f} MB/page" if s.mb_per_page else "")
    body = "\n".join(r.row for r in html_rows(rows, totals).collect())
    last = "".join(f"<td>{x}</td>" for x in ("TOTAL", s.books, s.produced, s.skipped, s.errors, s.pages, f"{s.pdf_mb:.0f}", f"{s.minutes:.0f}", f"{s.pages_per_min:.0f}" if s.pages_per_min else "—"))
    names = "".join(f"<th>{x}</th>" for x in ("source", "progress", "ok", "skipped", "error", "pages", "MB", "min", "pages/min"))
    said = f"<p>Catalog import: {', '.join(f'{n} {html.escape(k)}' for k, n in sorted(publish.items()))}</p>" if publish else ""
    style = "body{font-family:sans-serif}td,th{padding:4px 8px;text-align:right}.bar{background:#ddd;position:relative;width:140px}.bar div{background:#8bc;height:1.2em}.bar span{position:absolute;left:4px;top:0}"
    text = f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1><p>{head}</p>{said}<table><tr>{names}</tr>\n{body}\n<tr>{last}</tr></table></body></html>"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
    return path


EXPORTS = {"csv": write_csv, "json": write_json, "html": write_html}


def export_report(rows: DataFrame, fmt: str, path: str, **more) -> str:
    if fmt not in EXPORTS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(EXPORTS)}")
    return EXPORTS[fmt](rows, path, **(more if fmt == "html" else {}))


def default_path(folder: str, fmt: str, source: str | None = None) -> str:
    return f"{folder}/stats{f'_{source}' if source else ''}.{fmt}"


def write_manifests(rows: DataFrame, folder: str, manifest: str = "manifest") -> None:
    """Side files, as JSON lines below a folder for each source."""
    rows.select(F.col(f"{manifest}.source").alias("source"), F.to_json(manifest).alias("value")).write.mode("append").partitionBy("source").text(folder)


def write_sidecars(rows: DataFrame, folder: str, manifest: str = "manifest") -> DataFrame:
    """One file <folder>/<source>/<slug>.entry.json for each row's entry, which `readers.manifests` reads;
    returns (path). The folder is one that all executors have mounted. A file is moved into place whole,
    so a task that runs again leaves the same files; of rows with one slug the last written stays."""
    cells = rows.select(F.col(f"{manifest}.source").alias("source"), F.col(f"{manifest}.slug").alias("slug"), F.to_json(manifest, {"ignoreNullFields": "false"}).alias("value"))

    def run(batches):
        for batch in batches:
            paths = []
            for source, slug, value in zip(batch["source"], batch["slug"], batch["value"], strict=True):
                path = Path(folder) / source / f"{slug}.entry.json"
                path.parent.mkdir(parents=True, exist_ok=True)
                draft = path.with_name(f".{uuid.uuid4().hex}.tmp")
                draft.write_text(json.dumps(json.loads(value), ensure_ascii=False, indent=2), encoding="utf-8")
                draft.replace(path)
                paths.append(str(path))
            yield pd.DataFrame({"path": paths})

    return cells.mapInPandas(run, "path string")


def beat(folder: str, source: str, book_id: str, step: str, index: int, steps: int, started: float, now: float | None = None, pid: int = 0) -> str:
    """One heartbeat as a new file, which a stream sees; the newest of a book counts."""
    at = time.time() if now is None else now
    row = {"source": source, "book_id": book_id, "slug": f"{source}_{book_id}", "pid": pid, "step": step, "step_index": index + 1, "n_steps": steps, "started_at": started, "updated_at": at}
    place = Path(folder) / ".progress"
    place.mkdir(parents=True, exist_ok=True)
    name = place / f"{source}_{book_id}.{uuid.uuid4().hex}.json"
    draft = name.with_suffix(".tmp")
    draft.write_text(json.dumps(row, ensure_ascii=False), encoding="utf-8")
    draft.replace(name)
    return str(name)


def clear_beats(folder: str, source: str | None = None, book_id: str | None = None) -> int:
    """Drops the heartbeats of a book, of a source, or all."""
    mark = f"{source}_{book_id}." if book_id else f"{source}_" if source else ""
    gone = [p for p in (Path(folder) / ".progress").glob("*.json") if p.name.startswith(mark)]
    for p in gone:
        p.unlink()
    return len(gone)


class EntryError(Exception):
    """The catalog refused an entry; `status` is that of the answer."""

    def __init__(self, message: str, status: int = 0):
        super().__init__(message)
        self.status = status


def multipart(fields: Mapping[str, str], name: str, filename: str, data: bytes, kind: str) -> tuple[bytes, str]:
    """Body and content type of a form with one file. The boundary occurs nowhere in the parts."""
    parts = [(f'name="{k}"', "text/plain; charset=utf-8", v.encode()) for k, v in fields.items()]
    parts.append((f'name="{name}"; filename="{filename}"', kind, data))
    mark = uuid.uuid4().hex
    while any(mark.encode() in body for _, _, body in parts):
        mark = uuid.uuid4().hex
    out = [f"--{mark}\r\nContent-Disposition: form-data; {head}\r\nContent-Type: {k}\r\n\r\n".encode() + body + b"\r\n" for head, k, body in parts]
    return b"".join(out) + f"--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}"


def data_uri(path: str, read: Callable[[str], bytes]) -> str | None:
    """A cover as a data URI; None if there is no such file."""
    try:
        data = read(path)
    except FileNotFoundError:
        return None
    return f"data:{mimetypes.guess_type(path)[0] or 'image/jpeg'};base64,{base64.b64encode(data).decode()}"


def parsed(raw: bytes) -> dict:
    """An answer's JSON object; empty if it is none."""
    try:
        said = json.loads(raw)
    except ValueError:
        return {}
    return said if isinstance(said, dict) else {}


def http_transport(base: str, key: str, relation: str = "open-access", timeout: float = 60.0) -> Callable[[str, str, bytes, str], dict]:
    """A transport to a catalog's REST interface. A PDF goes as a form with its relation."""
    if not key:
        raise ValueError("an API key is needed")
    if not base:
        raise ValueError("the catalog's address is needed")

    def send(method: str, path: str, body: bytes, kind: str) -> dict:
        if kind == "application/pdf":
            body, kind = multipart({"metadata": json.dumps({"relation": relation})}, "content", f"{path.rsplit('/', 1)[-1]}.pdf", body, kind)
        headers = {"Accept": "application/json", "Authorization": f"Bearer {key}"} | ({"Content-Type": kind} if body else {})
        request = urllib.request.Request(f"{base.rstrip('/')}/{path.lstrip('/')}", body or None, headers, method=method)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
                return parsed(answer.read())
        except urllib.error.HTTPError as e:
            said = parsed(e.read())
            raise EntryError(next((said[k] for k in ("title", "detail", "message") if said.get(k)), str(e)), e.code) from e

    return send


def catalogs(transport: Callable[[str, str, bytes, str], dict]) -> list[tuple[str, str, str]]:
    """(id, url_name, title) of every catalog, page by page."""
    out, page, pages = [], 1, 1
    while page <= pages:
        said = transport("GET", f"/catalogs?limit=100&page={page}", b"", "")
        out += [(str(c["id"]), c.get("url_name"), c.get("title")) for c in said.get("items") or []]
        page, pages = page + 1, int((said.get("metadata") or {}).get("pages") or 1)
    return out


def publish(work: DataFrame, transport: Callable[[str, str, bytes, str], dict], read: Callable[[str], bytes] | None = None, dry: bool = False) -> DataFrame:
    """A log row for each entry of work (source, book_id, catalog, payload JSON, pdf path; where there:
    cover path, whose picture goes into the payload, and catalog_id, which a null means wasn't found).
    The answer 409 means that the entry is there: skipped. Any other failure is an error row, and the
    rest goes on."""
    more = [c for c in ("cover", "catalog_id") if c in work.columns]
    load = read or (lambda p: Path(p).read_bytes())

    def one(r: dict) -> dict:
        out = dict.fromkeys(x.split()[0] for x in PUBLISH.split(", ")) | {k: r[k] for k in ("source", "book_id", "catalog")}
        if dry:
            return out | {"status": "dry-run"}
        try:
            place = r.get("catalog_id", r["catalog"])
            if not place:
                raise EntryError(f"catalog {r['catalog']!r} not found")
            payload = json.loads(r["payload"])
            image = data_uri(r["cover"], load) if r.get("cover") else None
            body = json.dumps(payload | ({"image": image} if image else {}), ensure_ascii=False)
            entry = transport("POST", f"/catalogs/{place}/entries", body.encode(), "application/json")
            ident = entry.get("id") or (entry.get("response") or {}).get("id")
            if not ident:
                raise EntryError("the answer has no id")
            got = transport("POST", f"/catalogs/{place}/entries/{ident}", load(r["pdf"]), "application/pdf")
            return out | {"status": "published", "entry_id": ident, "acquisition_id": got.get("id") or (got.get("response") or {}).get("id")}
        except EntryError as e:
            return out | ({"status": "skipped", "detail": str(e)[:500]} if e.status == 409 else {"status": "error", "error": str(e)[:500]})
        except Exception as e:  # noqa: BLE001 - one book's failure is its row
            return out | {"status": "error", "error": str(e)[:500]}

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(r) for r in pdf.to_dict("records")], columns=[x.split()[0] for x in PUBLISH.split(", ")])

    return work.select("source", "book_id", "catalog", "payload", "pdf", *more).mapInPandas(run, PUBLISH)


def resolve_catalog(work: DataFrame, catalogs: DataFrame) -> DataFrame:
    """work with catalog_id: a UUID is itself, else the catalog of that url_name, else of that title."""
    name = F.col("catalog")
    by = lambda c: catalogs.groupBy(F.col(c).alias("catalog")).agg(F.min("id").alias(f"_{c}"))
    out = work.join(by("url_name"), "catalog", "left").join(by("title"), "catalog", "left")
    uuid_ = F.when(name.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), name)
    return out.withColumn("catalog_id", F.coalesce(uuid_, "_url_name", "_title")).drop("_url_name", "_title")


def staged(pages: DataFrame, there: DataFrame) -> DataFrame:
    """The pages that a copy still lacks: no file of that name and size."""
    name = F.element_at(F.split("path", "/"), -1)
    return pages.withColumn("_name", name).join(there.select(name.alias("_name"), "size"), ["_name", "size"], "left_anti").drop("_name")


def save_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def load_stats(spark, path: str, schema: str) -> DataFrame | None:
    """What save_stats wrote, or None if nothing was."""
    from .readers import exists

    return spark.read.schema(schema).json(path) if exists(spark, path) else None


def free_gb(folder: str) -> float:
    """Gigabytes free on a folder's disk."""
    import shutil

    return shutil.disk_usage(folder).free / 1e9
