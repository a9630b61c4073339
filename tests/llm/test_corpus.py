"""Near-dedup, repeats, decontamination, mixing, classifiers and the pipeline against plain versions."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
import xxhash

from folioscope.llm import decontaminate, graph, mixing, quality, repeats, simhash, toxicity

from .conftest import SF, table


def plain_print(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """prints: [(id, fingerprint)] -> smallest id reachable of each."""
    distinct = sorted({f for _, f in prints})
    up = {f: f for f in distinct}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= 3:
            up[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return Counter((i, f, least.get(root(f))) for i, f in prints)


def check_components(docs, **how):
    prints = [(r.doc_id, plain_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(docs, shingle=3, **how).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == plain_components(prints)


def test_near_duplicates(spark, odd, none):
    check_components(table(spark, "documents"))
    check_components(odd.filter("doc_id is null or doc_id not in (5, 6, 7)"))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(odd, shingle=3).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 3, 4, 5, 8, 10] and sum(r.doc_id is None for r in kept) == 1
    assert simhash.one_of_each(odd, shingle=3).columns == odd.columns and simhash.one_of_each(none, shingle=3).count() == 0


def test_one_of_each_picks_rows(spark):
    """Ids that repeat with other texts, rows that repeat, rows without an id, nulls in other places."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(30)]
    rows = [(3, texts[0], "x", None), (5, texts[0], "x", None), (5, texts[1], "x", None), (None, texts[2], None, None), (None, texts[0], "y", None), (7, None, "z", None), (6, "", "z", None)]
    rows += [(rng.randrange(8), rng.choice(texts), rng.choice("xy"), {"k": "v"}) for _ in range(120)]
    rows += rows[:40] + [(9, "one of a kind here", None, None), (9, "one of a kind here", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, m map<string,string>").repartition(4)
    prints = [plain_print(r[1]) for r in rows]
    root = {f: g for f, g in zip(prints, (c for _, c in sorted_components(prints)))}
    best = {}
    for r, f in zip(rows, prints):
        best.setdefault(root[f], set()).add((r[0] is None, r[0] or 0))
    got = simhash.one_of_each(docs, shingle=3).collect()
    assert len(got) == len(best) and all(any((r.doc_id, r.text, r.fp) == x[:3] for x in rows) for r in got)
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == Counter(min(v) for v in best.values())
    assert {root[plain_print(r.text)] for r in got} == set(best)
    assert sorted(map(str, simhash.one_of_each(docs.repartition(2), shingle=3).collect())) == sorted(map(str, got))


def sorted_components(prints):
    """(fingerprint, component) of each, in the order given."""
    up = {f: f for f in prints}
    for _ in up:
        for a, b in combinations(up, 2):
            if (a ^ b).bit_count() <= 3:
                up[a] = up[b] = min(up[a], up[b])
    return [(f, up[f]) for f in prints]


@pytest.mark.parametrize("hot", [2, 256])
def test_links_lose_nothing(spark, hot):
    """Clusters of values a few bits apart, with buckets that are split again and again."""
    rng, values = random.Random(1), set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(25):
            v = base
            for _ in range(rng.randint(0, 3)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), m=4, hot=hot).collect()}
    want = {(a, b) for a, b in combinations(sorted(signed), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_components(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(170)} | {(i, i + 1) for i in range(400, 460)}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    want = {n: n for e in edges for n in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def plain_repeats(texts, size=200):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_repeats(spark, odd, none):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefé ") for _ in range(n))
    base = word(2500)
    texts = [None, "", "a" * 199, "a" * 200, "a" * 900, "ab" * 400, "\0" * 260, "\0" * 230 + "x", base, base[:700] + "Ω" + base[400:900], base[50:249], base[50:251], word(3000), "q" + base]
    texts += [word(rng.randrange(60)) + base[(i := rng.randrange(2000)) : i + rng.choice([150, 199, 200, 230, 320])] + word(rng.randrange(250)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = dict(enumerate(plain_repeats([(t or "").encode() for t in texts])))
    for how in (repeats.Repeat(), repeats.Repeat(hot=0, piece=500, gram=16), repeats.Repeat(hot=6, most=10, gram=32)):
        rows = repeats.repeats(docs, how=how).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
        assert all(sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    got = {r.doc_id: r for r in repeats.repeats(odd).collect()}
    assert got[5].n_removed == got[5].n_bytes and got[0].n_bytes == 0 and got[None].n_removed == 0
    assert repeats.repeats(odd).count() == odd.count() and repeats.repeats(none).count() == 0


def plain_hits(text, items, k=13):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    w, hit, seen = split(text), set(), set()
    for ident, item in items:
        iw = split(item)
        m = min(k, len(iw))
        for win in {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if iw else ():
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) == win:
                    hit |= set(range(i, i + m))
                    seen.add(str(ident))
    return len(w), len(hit), sorted(seen)


def test_decontamination(spark, odd, none):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "x1", "Éa", "qu", "ab", "the"])
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(rng.choice([3, 12, 13, 14, 40]))) for i in range(25)] + [(30, None), (31, "!!"), (32, "x1"), (32, "x1"), (33, line(13)), (33, line(20))]
    docs = [(i, line(rng.randrange(60)) + "-" + (rng.choice(items)[1] or "").upper() + ". " + line(rng.randrange(30))) for i in range(60)] + [(90, None), (91, ""), (92, "THE"), (93, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = {i: plain_hits(t, items) for i, t in docs}
    for how in (decontaminate.Search(), decontaminate.Search(block_bytes=400, shard_bytes=2000, sample=3)):
        got = decontaminate.marked(df, bench, how=how).select("doc_id", "n_words", decontaminate.hits().alias("n"), "items", "spans").collect()
        assert {r.doc_id: (r.n_words, r.n, r["items"]) for r in got} == want
        assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.marked(odd, bench.filter("false")).count() == odd.count()
    assert decontaminate.marked(none, bench).count() == 0


def check_mix(rows, weights=(1, 2, 3)):
    by = defaultdict(list)
    for source, r in rows:
        by[source].append(r)
    total = {s: sum(r["size"] for r in v) for s, v in by.items()}
    order = sorted([s for s in by if s is not None]) + [s for s in by if s is None]
    w, capped, goal = {s: weights[i % 3] for i, s in enumerate(order)}, set(), sum(total.values())
    while len(capped) < len(order):
        level = (goal - sum(3 * total[s] for s in capped)) / sum(w[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and level * w[s] > 3 * total[s]}
        if not new:
            break
        capped |= new
    for s, v in by.items():
        target = 3 * total[s] if s in capped else level * w[s]
        assert all(r.target == pytest.approx(target, abs=1e-6) and r.source_size == total[s] for r in v)
        assert all(0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in v)
        assert abs(sum(r.taken for r in v) - target) <= max([r["size"] for r in v], default=0)


def test_mixing(spark, odd, none):
    docs = table(spark, "documents")
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = mixing.mix_sizes(docs).collect()
    check_mix([(source[r.doc_id], r) for r in rows])
    assert sorted(mixing.mix_sizes(docs.repartition(7)).collect()) == sorted(rows)
    few = spark.createDataFrame([(i, "w " * (i % 30), None if i % 11 == 0 else "big" if i % 3 else f"s{i % 4}") for i in range(3000)], "doc_id long, text string, source string")
    source = {r.doc_id: r.source for r in few.collect()}
    check_mix([(source[r.doc_id], r) for r in mixing.mix_sizes(few).collect()])
    taken = mixing.mix(odd)
    assert taken.columns == [c for c in odd.columns if c not in ("copies", "taken")] + ["copies", "taken"]
    assert all(r.copies in (1, 2, 3) and r.text.strip() for r in taken.collect())
    assert mixing.mix_sizes(none).count() == 0 and mixing.mix(none).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5]), np.ones(6))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == pytest.approx(2.5 / 3)


def test_normal_equations(spark):
    """The sums of many small partitions, added level by level, against numpy in one piece."""
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((400, quality.STATS)), rng.integers(0, 2, 400)
    rows = spark.createDataFrame([(a.tolist(), float(b), int(i % 2)) for i, (a, b) in enumerate(zip(x, y))], "stats array<double>, label double, part int").repartition(13)
    how = quality.Fit(width=16, fan=3)
    model = quality.fit(rows, how)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0))
    z = model.lift(x)
    want = np.linalg.solve(z.T @ z + (how.ridge * len(x) + 1e-9) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-8)
    few = quality.fit(rows.filter("false"), how)
    assert few.score(x).shape == (400,) and np.isfinite(few.score(x)).all()


def held_out(rows, labels, k, r):
    known = {x.doc_id: x[1] for x in labels}
    assert all(x.held_out == (x.doc_id is not None and crc32(str(x.doc_id).encode()) % k == r) for x in rows)
    return [(known[x.doc_id], x.predicted, x.score) for x in rows if x.held_out and x.doc_id in known]


def test_quality(spark, odd, none):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "labels", "/root/testdata/sf0.01")
    rows = quality.scored(docs, labels).collect()
    pairs = held_out(rows, labels.select("doc_id", "quality").collect(), 3, 1)
    assert sum(a == b for a, b, _ in pairs) / len(pairs) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    got = quality.scored(odd, labels.limit(0)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(none, labels).count() == 0 and quality.accepted(odd, labels).columns == odd.columns


def test_toxicity(spark, odd, none):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    rows = toxicity.scored(docs, labels, how=toxicity.Fit(epochs=4)).collect()
    pairs = held_out(rows, labels.select("doc_id", "toxic").collect(), 5, 0)
    assert sum(a == b for a, b, _ in pairs) / len(pairs) > 0.95
    assert sum(b for a, b, _ in pairs if a) / sum(a for a, _, _ in pairs) > 0.7
    got = toxicity.scored(odd, labels.limit(0)).collect()
    assert len(got) == odd.count() and all(0 <= r.score < 0.5 for r in got)
    assert toxicity.scored(none, labels).count() == 0


def test_toxicity_thresholds_count_every_labelled_row(spark):
    """The net learns from a few rows; the cuts still are the best for all other labelled rows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.filter("lang = 'de'")
    rows = toxicity.scored(docs, labels, how=toxicity.Fit(positives=60, negatives=90, epochs=2)).filter("not held_out").join(labels, "doc_id").collect()
    f1 = lambda cut: 2 * sum(r.toxic for r in rows if r.score >= cut) / (sum(r.score >= cut for r in rows) + sum(r.toxic for r in rows))
    best = max(f1(r.score) for r in rows if r.toxic)
    assert f1(0.5) > best - 0.02


def test_toxicity_pieces_agree():
    """A text with more words than the cache holds gets the score of one pass."""
    net = toxicity.Net(toxicity.Fit())
    text = " ".join(f"word{i}" for i in range(300))
    whole, small = (toxicity.Scorer(net, {"": 0.0}, 1.0, most=m) for m in (10_000, 40))
    assert small.logits([text, "a", ""])[0] == pytest.approx(whole.logits([text, "a", ""])[0], abs=1e-4)


def test_toxicity_gradients():
    """One step's change of every parameter against finite differences of the loss."""
    how = toxicity.Fit(buckets=8, width=3, filters=2, epochs=1, batch=4, rate=1e-3)
    table_, docs = np.arange(20, dtype=np.int32).reshape(5, 4) % 8, [np.array([0, 1, 2, 3]), np.array([4, 1]), np.array([2]), np.array([3, 0, 4])]
    y = np.array([1.0, 0, 0, 1])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def loss(net):
        z = []
        for d in docs:
            e = np.vstack([net.embed[table_[d]].sum(1), np.zeros((2, 3))])
            z.append(np.maximum(net.responses(net.taps_of(e)).max(0), 0) @ net.out + net.base)
        z = np.array(z, np.float64)
        return float((weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y)).mean())

    def fresh():
        net = toxicity.Net(how)
        for k in ("embed", "conv", "bias", "out"):
            setattr(net, k, getattr(net, k).astype(np.float64))
        net.embed *= 5
        net.bias += 0.05  # away from the bend at 0
        return net

    for name in ("embed", "conv", "bias", "out"):
        before, after = fresh(), fresh()
        after.train(table_, docs, y)
        moved, rng = getattr(after, name) - getattr(before, name), np.random.default_rng(1)
        flat = np.flatnonzero(moved.ravel())
        for i in rng.choice(flat, min(6, len(flat)), replace=False):
            at, eps = np.unravel_index(i, moved.shape), 1e-6
            up, down = fresh(), fresh()
            getattr(up, name)[at] += eps
            getattr(down, name)[at] -= eps
            slope = (loss(up) - loss(down)) / (2 * eps)
            # Adagrad's first step: rate * g / sqrt(1e-3 + g * g), against the slope.
            assert moved[at] == pytest.approx(-how.rate * slope / np.sqrt(1e-3 + slope * slope), rel=0.02, abs=1e-7)


def test_toxicity_texts_are_apart():
    """A text's score is its own, whatever texts come before or after."""
    net = toxicity.Net(toxicity.Fit())
    texts = ["one two three", "", "four", "five six seven eight", "nine"]
    alone = [toxicity.Scorer(net, {"": 0.0}, 1.0).logits([t])[0][0] for t in texts]
    for order in (texts, texts[::-1]):
        got = toxicity.Scorer(net, {"": 0.0}, 1.0).logits(order)[0]
        assert dict(zip(order, got)) == pytest.approx(dict(zip(texts, alone)), abs=1e-5)


def test_thresholds_by_language():
    """A language's cut stands at 0.5; one without enough labels goes by the pooled cut."""
    from pyspark.sql import Row

    bins = lambda said, label, zs: [Row(_said=said, label=label, bin=int(z * 256), n=1, low=z, high=z, micros=int(z * 1e6)) for z in zs]
    low, high = np.linspace(0, 1, 20).tolist(), np.linspace(3, 4, 20).tolist()
    cut = toxicity.binned_threshold(bins("en", 0, low) + bins("en", 1, high))
    assert cut == pytest.approx(2.0) and toxicity.threshold(np.array(low + high), np.array([0.0] * 20 + [1.0] * 20)) == pytest.approx(2.0)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = table(spark, "documents")
    seen = [docs.collect()]
    for _, stage in p.STAGES:
        docs = stage(spark, spark.createDataFrame(seen[-1], docs.schema), SF)
        seen.append(docs.collect())
    start, good, single, clean, safe, mixed = seen
    scores = {r.doc_id: r.predicted for r in quality.scored(table(spark, "documents"), table(spark, "labels")).collect()}
    assert {r.doc_id for r in good} == {r.doc_id for r in start if scores[r.doc_id]}
    want = {c for (_, _, c) in plain_components([(r.doc_id, plain_print(r.text)) for r in good])}
    assert {r.doc_id for r in single} == want and len(single) == len(want)
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    judged = {r.doc_id: plain_hits(r.text, items) for r in single}
    assert {r.doc_id for r in clean} == {i for i, (n, h, _) in judged.items() if not (h and 20 * h >= n)}
    before = {r.doc_id: r for r in clean}
    assert len(safe) == len(clean) and all((r.text == before[r.doc_id].text) or secretive(before[r.doc_id].text) for r in safe)
    assert not any(secretive(r.text) for r in safe)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in safe} and all(r.copies in (1, 2, 3) for r in mixed)


def secretive(text):
    from .test_texts import plain_base

    return bool(plain_base(text))


def test_pipeline_whole(spark, odd, tmp_path):
    """run() is its stages one after the other; odd and empty tables go through."""
    import corpus_pipeline as p

    docs = table(spark, "documents")
    for _, stage in p.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema if stage is not p.mixture else None) if stage is not p.mixture else stage(spark, docs, SF)
    assert sorted(map(str, p.run(spark, SF).collect())) == sorted(map(str, docs.collect()))
    benchmark, labels = table(spark, "benchmark"), table(spark, "labels")
    for name, rows in (("odd", odd.drop("copies", "taken")), ("none", odd.drop("copies", "taken").filter("false"))):
        at = tmp_path / name
        rows.write.parquet(f"{at}/documents.parquet")
        benchmark.write.parquet(f"{at}/benchmark.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        got = p.run(spark, str(at)).collect()
        assert len(got) <= rows.count() and all(r.copies in (1, 2, 3) for r in got)
