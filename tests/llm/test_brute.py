"""Operators that SQL can't express, held against plain loops over whole results."""

import math
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("maskwright.llm")

from maskwright.llm import decontamination, quality_classifier, quality_rules, substring_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"


def walked(trees, x):
    """The score of one row of features, node by node."""
    total = trees.bias
    for root in trees.roots.tolist():
        i = root
        while trees.left[i] != i:
            i = int(trees.left[i] if x[trees.feature[i]] <= trees.threshold[i] else trees.right[i])
        total += trees.value[i]
    return 1 / (1 + math.exp(-total))


def test_verdicts_node_by_node(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality_rules.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {}
    for i, t in texts.items():
        base, x = quality_rules.document_stats(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        want[i] = (failed, round(walked(trees, x), 9), not failed and walked(trees, x) >= 0.5)
    got = {r["doc_id"]: (r["base_failed"], round(r["score"], 9), r["kept"]) for r in quality_rules.judge(docs, trees).collect()}
    assert got == want
    assert {r["doc_id"] for r in quality_rules.stage(spark, docs, SF).collect()} == {i for i, x in want.items() if x[2]}


def test_the_first_split_against_every_split():
    rng = np.random.default_rng(12)
    x, y = rng.random((200, 3)).round(2), (rng.random(200) < 0.5).astype(float)
    y[x[:, 1] > 0.7] = 1
    for signs in ((0, 0, 0), (0, -1, 0)):
        t = quality_rules.fit_trees(x, y, np.array(signs), n_trees=1, depth=1, bins=1000)
        p = (y.sum() + 0.5) / (len(y) + 1)
        g, h = p - y, np.full(len(y), p * (1 - p))
        value = lambda rows: -g[rows].sum() / (h[rows].sum() + 1)  # noqa: E731, B023
        gain = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1) / 2  # noqa: E731, B023
        best = max((gain(x[:, f] <= c) + gain(x[:, f] > c), f, c) for f in range(3) for c in np.unique(x[:, f]) if 5 <= (x[:, f] <= c).sum() <= 195 and signs[f] * (value(x[:, f] > c) - value(x[:, f] <= c)) >= 0)
        f, cut = int(t.feature[0]), t.threshold[0]
        mine = gain(x[:, f] <= cut) + gain(x[:, f] > cut)
        assert mine == pytest.approx(best[0], rel=1e-9) and f == best[1]
        assert t.value[t.left[0]] == pytest.approx(0.15 * value(x[:, f] <= cut)) and (f != 1 or signs[1] == 0)


def test_pooled_inputs_word_by_word(spark):
    q = quality_classifier
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    vectors, buckets = q.word_vectors(docs), q.Buckets()
    for text in [r["text"] for r in docs.collect()][:12] + ["", None, "one", "a b a b " * 20_000]:
        words = (text or "").encode().split()[:]
        both = [divmod(buckets[w], q.BUCKETS) for w in words]
        want = np.zeros(q.INPUTS)
        if len(words) < 3000:
            for i, (word, shape) in enumerate(both):
                want[: q.WIDTH] += vectors[word].astype(float) + vectors[shape]
                want[q.WIDTH : 2 * q.WIDTH] += q.INDEX[shape]
                if i + 1 < len(both):
                    want[2 * q.WIDTH : 3 * q.WIDTH] += q.INDEX[word] * q.INDEX[both[i + 1][0]]
            if words:
                want[:-1] /= len(words)
                want[-1] = math.log1p(len(words))
            assert np.allclose(q.pooled(text, vectors, buckets), want, atol=1e-4)
    long = q.pooled("a b a b " * 20_000, vectors, buckets)
    assert np.allclose(long[: 2 * q.WIDTH], q.pooled("a b", vectors, buckets)[: 2 * q.WIDTH], atol=5e-3)


def test_network_and_temperature():
    q, rng = quality_classifier, np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(float)
    net = q.fit(x, y)
    row = x[7]
    hidden = [math.tanh(sum((row[i] - net.mean[i]) / net.scale[i] * net.w1[i, j] for i in range(6)) + net.b1[j]) for j in range(net.w1.shape[1])]
    margin = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2
    assert net.margin(x[7:8])[0] == pytest.approx(margin) and net.score(x[7:8])[0] == pytest.approx(1 / (1 + math.exp(-margin / net.temperature)))
    assert ((net.score(x) >= 0.5) == (y > 0)).mean() > 0.75
    cal = np.random.default_rng(7).permutation(len(x))[:80]
    loss = lambda t: -sum(math.log(1 / (1 + math.exp(-(1 if y[i] else -1) * net.margin(x[i : i + 1])[0] / t))) for i in cal)
    assert all(loss(net.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.25, 8, 60))


def plain_chunks(words, reach=substring_dedup.REACH):
    """(start, stop) of the chunks of a text's words, place by place."""
    import zlib

    g = [zlib.crc32(w) * 0x9E3779B1 & 0xFFFFFFFF for w in words]
    h = [sum(g[i - k] << (8 * k) for k in range(4) if i >= k) & 0xFFFFFFFF for i in range(len(g))]
    out, at = [], 0
    for i in range(len(h)):
        before, after = h[max(0, i - reach) : i], h[i + 1 : i + 1 + reach]
        if (all(h[i] < x for x in before) and all(h[i] <= x for x in after)) or i + 1 - at == 16 * reach or i + 1 == len(h):
            out.append((at, i + 1))
            at = i + 1
    return out


def test_all_repeated_spans(spark):
    rng = np.random.default_rng(21)
    text = lambda n: [f"u{i}" for i in rng.integers(0, 10**6, n)]
    shared = [text(n) for n in (20, 40, 60, 90)]
    docs = []
    for i in range(60):
        body = text(int(rng.integers(0, 30)))
        for s in rng.permutation(4)[: rng.integers(0, 3)]:
            body += shared[s][: rng.integers(15, 91)] + text(int(rng.integers(0, 20)))
        docs.append((int(rng.integers(0, 50)), " ".join(body)))
    docs += [(90, "Same same " * 120), (91, ""), (92, None), (None, " ".join(shared[3])), docs[0]]
    rows = [(i, (t or "").lower().encode().split()) for i, t in docs]
    found = [(k, a, b, b" ".join(w[a:b])) for k, (_, w) in enumerate(rows) for a, b in plain_chunks(w)]
    copies = Counter(c for *_, c in found)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    rank = {k: n for n, k in enumerate(order)}
    first = {}
    for k, a, _, c in found:
        first[c] = min(first.get(c, (10**9, 0)), (rank[k], a))
    want = []
    for k, (i, _) in enumerate(rows):
        run = []
        for kk, a, b, c in [x for x in found if x[0] == k] + [(k, 10**9, 0, None)]:
            if c is not None and copies[c] > 1 and (not run or run[-1][1] == a):
                run.append((a, b, c))
                continue
            if run and run[-1][1] - run[0][0] >= substring_dedup.MIN_WORDS:
                want.append((i, run[0][0], run[-1][1] - run[0][0], min(copies[x] for *_, x in run), all(first[x] == (rank[k], p) for p, _, x in run)))
            run = [(a, b, c)] if c is not None and copies[c] > 1 else []
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["start_word"], r["n_words"], r["n_copies"], r["is_first"]) for r in substring_dedup.repeated_spans(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 40


def edited(rng, words, share):
    """words with about a share of them substituted, dropped or put in, at the ends as well as within."""
    out = list(words)
    for _ in range(max(1, int(len(words) * share))):
        i = int(rng.choice([0, len(out) - 1, rng.integers(0, len(out))]))
        kind = rng.integers(0, 3)
        if kind == 0:
            out[i] = f"sub{rng.integers(0, 99)}"
        elif kind == 1 and len(out) > 8:
            del out[i]
        else:
            out.insert(i, f"ins{rng.integers(0, 99)}")
    return out


def test_leaks_against_every_window(spark):
    """Every window of an item's size, of every document, by exact similarity: all documents and items that reach it are found."""
    rng = np.random.default_rng(31)
    items = [(i, [f"w{x}" for x in (rng.integers(0, 40, n) if i % 3 == 0 else rng.integers(0, 4000, n))]) for i, n in enumerate([12, 20, 30, 45, 60, 80] * 12)]
    docs = []
    for i, w in items:
        for share in (0.02, 0.04, 0.06):
            docs.append((len(docs), [f"p{x}" for x in rng.integers(0, 4000, int(rng.integers(0, 25)))] + edited(rng, w, share) + [f"q{x}" for x in rng.integers(0, 4000, int(rng.integers(0, 25)))]))
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for d, w in docs:
        i, item = items[d // 3]
        b = shingles(item)
        for at in range(max(1, len(w) - len(item) + 1)):
            a = shingles(w[at : at + len(item)])
            both = sum((a & b).values())
            s = both / max(1, sum(a.values()) + sum(b.values()) - both)
            if s >= 0.8 and s > want.get((d, i), 0):
                want[d, i] = s
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.matches(df, bench).collect()}
    missed = {k for k in want if k not in got}
    assert len(want) > 50 and not missed, (len(want), missed)
    assert all(got[k] == pytest.approx(s, abs=1e-6) for k, s in want.items())
