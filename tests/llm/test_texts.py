"""Chat formatting, token counts, secret scans, quality rules: exact against plain versions."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import chat, rules, secrets, tokens
from folioscope.llm.rules import Risk

from .conftest import SF, table


@given(st.text(), st.text())
@settings(max_examples=200, deadline=None)
def test_template_reads_back(role, text):
    t = chat.Template()
    whole = "".join(s["text"] for s in t.segments(role, text) + t.segments("user", "x"))
    assert t.parsed(whole) == [(role, text), ("user", "x")]


def test_template_order():
    t = chat.Template()
    state, ok = "start", []
    for role in ("system", "user", "assistant", "assistant", "user"):
        state, good = t.step(state, role)
        ok.append(good)
    assert ok == [True, True, True, False, True]


def test_chat_digests(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, "user", None), (3, 0, None, "x"), (3, 0, None, "a"), (None, 0, "user", "q"), (None, 1, "assistant", "r")]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, segments int").repartition(3))).collect()}
    assert set(got) == {1, 2, 3, None}
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[1].loss_chars == len(said) and got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].valid and not got[2].valid and got[2].error_turn is None and got[3].error_turn == 0
    assert got[3].turns_sha256 == hashlib.sha256(b"\na\n\nx\n").hexdigest()
    assert got[None].valid and got[2].loss_chars == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(none)).count() == 0


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_counts(spark, odd, none):
    path = tokenizer()
    direct = tokens.load(path)
    n = lambda t: len(direct.encode(t or "", add_special_tokens=False).ids)
    more = ["a\x1cb c", "<|endoftext|>x y", "don't I'LL", "ΑΣ Σ", "İstanbul ǅ", "x" * 5000, "１２ ² ½", "́ e ́", "한국어 中文"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(more, 100)), "doc_id long, text string")).union(table(spark, "documents").select("doc_id", "text"))
    want = Counter((r.doc_id, len((r.text or "").encode()), n(r.text)) for r in docs.collect())
    got = tokens.count_tokens(docs, path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert tokens.count_tokens(none, path).count() == 0


def test_token_cache_is_bounded():
    cache = tokens.Lengths(tokens.pack({"the": 1}), tokenizer(), most=50)
    words = [f"w{i}" for i in range(200)]
    direct = tokens.load(tokenizer())
    assert cache.counts([" ".join(words), "the w1"]) == [len(direct.encode(t, add_special_tokens=False).ids) for t in (" ".join(words), "the w1")]
    assert len(cache.known) <= 51


def plain_base(text):
    """The contract's patterns, one after the other."""
    out = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apikey", ":", "=", " ", "'", '"', "abcdef12", "a", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n\n", "ſecret", "é", "https://h.example/x", "user: bob", "x/Y9" * 10]), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    got = [(s, k, e) for s, e, k in secrets.scan(text) if k in ("assign", "access", "hex")]
    assert got == plain_base(text)


def test_weak_parts_need_company():
    secret, access = "aB3/" * 10, "AKIA" + "Z" * 16
    kinds = lambda t: [k for *_, k in secrets.scan(t)]
    assert kinds(f"x {secret} y") == []
    assert kinds(f"{access} and {secret}") == ["access", "secret"]
    assert kinds(f"{access}\n\n{secret}") == ["access"]  # another scope
    assert kinds(f"{access}{' .' * 200}{secret}") == ["access"]  # out of reach
    assert kinds(f"https://db.example/x password=hunter22 user=bob") == ["endpoint", "assign", "owner"]
    assert kinds("https://db.example/x is nice") == []


def test_find_and_redact(spark, odd, none):
    access = "AKIA" + "Q" * 16
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(50, f"é {access} token = 'abcdef'"), (51, "token=deadbeefdeadbeefdeadbeef")], "doc_id long, text string"))
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    assert [(s.start, s.end, s.kind) for s in got[50]] == [(2, 22, "access"), (23, 38, "assign")]
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[50] == "é [access] [assign]'" and clean[51] == "[assign]" and clean[0] is None and clean[1] == ""
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == odd.count()
    assert secrets.find_secrets(none).count() == 0 and secrets.redact(none).count() == 0


def plain_figures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if n[x] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def check_figures(spark, docs, labels):
    got = rules.judged(docs, labels).collect()
    want = Counter((r.doc_id, *plain_figures(r.text)) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_rule_figures(spark, odd, none):
    labels = table(spark, "labels")
    check_figures(spark, table(spark, "documents"), labels)
    check_figures(spark, odd, labels)
    more = [(1, "a b c a b c d\nx\n\n x\nx"), (2, "a a a a a"), (3, "a b a b a b"), (4, "#|<>\x0b$ %& *")]
    check_figures(spark, spark.createDataFrame(more, "doc_id long, text string"), labels)
    assert rules.judged(none, labels).count() == 0


def test_binomial_tail(spark):
    from math import comb, exp

    from pyspark.sql import functions as F

    rows = [(float(k), float(n)) for n in (1, 9, 300, 2000) for k in (0, 1, n // 100)]
    df = spark.createDataFrame(rows, "k double, n double").filter("k <= n * 0.01")
    for r in df.select("k", "n", rules.log_tail(F.col("k"), F.col("n"), 0.01).alias("t")).collect():
        exact = sum(comb(int(r.n), i) * 0.01**i * 0.99 ** (r.n - i) for i in range(int(r.k) + 1))
        assert exp(r.t) == pytest.approx(exact, rel=1e-6)


def test_binomial_tail_is_never_less(spark, monkeypatch):
    """With few terms summed one by one, the rest is bounded from above."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(90.0, 10_000.0), (60.0, 10_000.0)], "k double, n double")
    tail = lambda: [r[0] for r in df.select(rules.log_tail(F.col("k"), F.col("n"), 0.01)).collect()]
    exact = tail()
    monkeypatch.setattr(rules, "TERMS", 5)
    assert all(e <= t < e + 0.5 for e, t in zip(exact, tail()))


def plain_tail(k, n, p):
    from math import exp, lgamma, log

    return sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(k + 1))


def plain_levels(good, how):
    """good: [(stratum, step)] -> the level of each stratum that is tested alone, and the pooled one."""
    from math import log

    by = {None: [s for _, s in good]}
    for stratum, step in good:
        by.setdefault(stratum, []).append(step)
    least = lambda m: log(m / how.delta) / -log(1 - how.alpha)
    m = max(1, sum(len(v) >= least(1) for v in by.values()))
    out = {}
    for stratum, steps in by.items():
        if len(steps) >= least(m):
            level = None
            for j in range(how.steps):
                k = sum(s <= j for s in steps)
                if k > len(steps) * how.alpha or plain_tail(k, len(steps), how.alpha) > how.delta / m:
                    break
                level = j
            out[stratum] = level
    return out


def plain_step(text, how):
    n, chars, symbols, dups, repeats, _ = plain_figures(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    share = lambda a, b: a / b if b else 0.0
    stats = {"symbols": share(symbols, chars), "dup_lines": share(dups, lines), "repeats": share(repeats, n), "long_words": share(chars, n), "pipes": share((text or "").count("|"), n)}
    return next((j for j in range(how.steps) if any(stats[r] > how.ladder(r)[j] for r in stats)), how.steps)


def test_verdict(spark):
    """kept against a plain version, on tables where cutoffs are certified and reject documents."""
    at = "/root/testdata/sf0.01"
    docs, labels, how = table(spark, "documents", at), table(spark, "labels", at), Risk()
    rows = docs.select("doc_id", "lang", "text").collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    step, failed = {r.doc_id: plain_step(r.text, how) for r in rows}, {r.doc_id: plain_figures(r.text)[-1] for r in rows}
    levels = plain_levels([(r.lang or "", step[r.doc_id]) for r in rows if r.doc_id in good and not failed[r.doc_id]], how)
    want = {}
    for r in rows:
        level = levels[r.lang or ""] if (r.lang or "") in levels else levels.get(None)
        want[r.doc_id] = (not failed[r.doc_id] and not (level is not None and step[r.doc_id] <= level), level)
    assert {r.doc_id: (r.kept, r.level) for r in rules.judged(docs, labels).collect()} == want
    assert any(not kept and not failed[i] for i, (kept, _) in want.items())


def test_levels(spark):
    """A stratum with enough labels has its own level, a small one that of all, a null one is a stratum."""
    how = Risk(alpha=0.05)
    good = [("en", 3 if i % 40 == 0 else 20) for i in range(4000)] + [("xx", 5)] * 20 + [("", 20)] * 500
    alone, pooled = rules.certified(spark.createDataFrame(good, "_stratum string, _step int"), how)
    got = {r._stratum: r.level for r in alone.collect()}
    want = plain_levels(good, how)
    assert got == {k: v for k, v in want.items() if k is not None} and pooled == want[None]
    assert "xx" not in got and got["en"] == 19 and got[""] == 19
    none, pooled = rules.certified(spark.createDataFrame(good[:20], "_stratum string, _step int"), how)
    assert none.count() == 0 and pooled is None


def test_false_rejection_is_controlled():
    """Of many draws, at most a part delta certifies a level that rejects more than alpha."""
    import random

    rng, how, wrong = random.Random(8), Risk(), 0
    beyond = [0.004, 0.01, 0.019, 0.0205, 0.03] + [0.04] * (how.steps - 5)  # true rejection by level
    for _ in range(400):
        n = rng.choice([200, 400, 900])
        draws = [rng.random() for _ in range(n)]
        steps = [next((j for j, b in enumerate(beyond) if u < b), how.steps) for u in draws]
        level = plain_levels([("en", s) for s in steps], how).get("en")
        wrong += level is not None and beyond[level] > how.alpha
    assert wrong / 400 <= how.delta


def test_long_message():
    """20 MB of signs that have to be escaped, read back within a few copies of the text."""
    import tracemalloc

    t, text = chat.Template(), "a<b\\#c: " * 2_500_000
    whole = "".join(s["text"] for s in t.segments("assistant", text))
    tracemalloc.start()
    assert t.parsed(whole) == [("assistant", text)]
    assert tracemalloc.get_traced_memory()[1] < 5 * len(whole)
    tracemalloc.stop()


def test_links():
    secret, access = "aB3/" * 10, "AKIA" + "Z" * 16
    spans, links = secrets.linked(f"{access} and {secret} at https://db.example/x")
    assert [k for *_, k in spans] == ["access", "secret", "endpoint"]
    assert [(a[2], b[2]) for a, b in links] == [("secret", "access"), ("endpoint", "access")]
