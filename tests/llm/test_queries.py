"""Every registered query of this subpackage, as registered, against plain versions."""

from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest

import __spark_entry__ as entry

from .conftest import SF, table
from .test_corpus import check_mix, plain_components, plain_hits, plain_print, plain_repeats
from .test_texts import plain_base, plain_figures, tokenizer


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark, "documents").collect()


def ran(spark, name, columns):
    df = entry.queries()[name](spark, SF)
    assert dict(df.dtypes) | columns == dict(df.dtypes)
    return df.collect()


def test_op2(spark, rows):
    got = ran(spark, "op2_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_op3(spark, rows):
    from folioscope.llm import tokens

    direct = tokens.load(tokenizer())
    want = {r.doc_id: (len((r.text or "").encode()), len(direct.encode(r.text or "", add_special_tokens=False).ids)) for r in rows}
    got = ran(spark, "op3_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_op4(spark, rows):
    source = {r.doc_id: r.source for r in rows}
    got = ran(spark, "op4_source_mixing", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})
    check_mix([(source[r.doc_id], r) for r in got])


def test_op5(spark, rows):
    got = ran(spark, "op5_secret_scans", {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"})
    want = {}
    for r in rows:
        base = plain_base(r.text or "")
        n = Counter(k for _, k, _ in base)
        said = ",".join(f"{k}:{s}:{e}" for s, k, e in base)
        want[r.doc_id] = (n["assign"], n["access"], n["hex"], sha256(said.encode()).hexdigest(), said)
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got} == {k: v[:4] for k, v in want.items()}
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if x.split(":")[0] in ("assign", "access", "hex")] == [x for x in want[r.doc_id][4].split(",") if x]
        assert len(r.links.split(",") if r.links else []) == sum(x.split(":")[0] in ("secret", "endpoint", "owner") for x in spans)


def test_op6(spark, rows):
    got = ran(spark, "op6_suffix_array_dedup", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    want = dict(zip((r.doc_id for r in rows), plain_repeats([(r.text or "").encode() for r in rows])))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_op7(spark, rows):
    got = ran(spark, "op7_quality_classifier", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_op8(spark, rows):
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    got = ran(spark, "op8_benchmark_decontamination", {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"})
    want = {}
    for r in rows:
        n, hit, seen = plain_hits(r.text, items)
        want[r.doc_id] = (n, hit, len(seen), sha256(",".join(seen).encode()).hexdigest(), bool(hit and 20 * hit >= n))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want


def test_op9(spark, rows):
    got = ran(spark, "op9_quality_rules", {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"})
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r.doc_id, *plain_figures(r.text)) for r in rows)


def test_op10(spark, rows):
    got = ran(spark, "op10_simhash_near_dedup", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    want = plain_components([(r.doc_id, plain_print(r.text)) for r in rows])
    assert Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == want and all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in got)
