"""Schemas of logs, manifests, heartbeats and listings."""

from __future__ import annotations

OUTPUT = "struct<path:string,mb:double,image_format:string,pdfa:string,linearize:boolean>"
REPORT = f"source string, book_id string, status string, pdf string, pdf_mb double, outputs map<string,{OUTPUT}>, n_frames bigint, n_pages bigint, skipped_frames array<string>, language string, ocr_chars bigint, title string, catalog_matched boolean, cover string, manifest string, error string, minutes double"
PUBLISH = "source string, book_id string, catalog string, status string, detail string, entry_id string, acquisition_id string, error string"
MANIFEST = "source string, book_id string, slug string, faculty string, page_count bigint, matched boolean, catalog string, title string, language_code string, authors array<struct<name:string,surname:string>>, publisher string, published_at string, summary string, identifiers map<string,string>, config map<string,string>, relation string, pdf string, cover string"
HEARTBEAT = "source string, book_id string, slug string, pid bigint, step string, step_index bigint, n_steps bigint, started_at double, updated_at double"
PAGE = "source string, book_id string, path string, size bigint"
