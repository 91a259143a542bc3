"""Hard negatives, periodic runs and toxicity against brute force."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from cascadia.llm import hard_negatives, periodic_runs, toxicity
from cascadia.llm.common import table
from cascadia.llm.queries import ORACLE_SQL, QUERIES
from compare import difference, duck
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"


def brute_negatives(rows):
    """The contract of hard negatives by all products, for unique ids."""
    fine = {}
    for i, v, y in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[2])):
        if all(x is not None and np.isfinite(x) for x in v) and i not in fine:
            fine[i] = ([int(np.floor(256 * float(np.float32(x)))) for x in v], (y + 1) % 10 if i % 7 == 0 else y)
    out = []
    for a, (va, ya) in fine.items():
        if a % 50:
            continue
        score = {i: sum(p * q for p, q in zip(va, v)) for i, (v, _) in fine.items() if i != a}  # zip: a shorter vector has zeros at its end
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if fine[i][1] == ya][:5]:
            inside = [i for i in order if fine[i][1] != ya and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(inside[:3])]
    return sorted(out)


def negatives(df):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("shard, leaf", [(4096, 16), (64, 4)])
def test_hard_negatives(spark, monkeypatch, shard, leaf):
    """Clusters, equal vectors with many ids and labels, ties, and rows that take no part; many small shards give the same."""
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 8))
    rows = []
    for i in range(700):
        v = centre[i % 12] + rng.normal(size=8) * 0.2
        if i % 3 == 0:
            v = np.full(8, 0.25)
        elif i % 5 == 0:
            v = np.round(v)
        elif i % 11 == 0:
            v = v * 40
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 4))))
    rows += [(1000, None, 1), (1050, [1.0] * 8, None), (None, [1.0] * 8, 1), (1100, [1.0, None] * 4, 1), (1150, [float("nan")] * 8, 1), (1200, [float("inf")] + [0.0] * 7, 1), (1250, [0.0] * 8, 2), (1300, [1.0, 2.0], 3), (1301, [1.0, 2.0, 0.0], 3), (1350, [], 1), (-50, [0.5] * 8, 0)]
    df = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], "vec_id long, embedding array<float>, label int, cell string, q int, score int").repartition(5)
    want = brute_negatives(rows)
    assert negatives(df) == want and len(want) > 100
    assert negatives(df.union(df)) == want
    assert negatives(df.where("false")) == []


def test_hard_negatives_of_large_numbers(spark):
    """Scores beyond what doubles hold exactly."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (rng.integers(1, 1 << 17, 40) + rng.random(40)).astype(np.float32)], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_negatives(rows)
    assert want and max(r[4] for r in want) > 2**53
    assert negatives(df) == want


def test_cover_tree_covers_and_leaves_out():
    """Every row lies within its node's reach on each level, and distant leaves aren't searched."""
    rng = np.random.default_rng(5)
    g = np.concatenate([rng.normal(size=(200, 6)) * 5 + c for c in rng.normal(size=(5, 6)) * 400]).astype(np.int64)
    sphere = hard_negatives.Sphere(float(np.sqrt((g * g).sum(1).max())))
    tree = hard_negatives.CoverTree(np.arange(len(g)), np.zeros(len(g), np.int64), g, sphere)
    x = sphere.rows(g.astype(float))
    node = np.empty(len(g), np.int64)
    for k, rows in enumerate(tree.leaves):
        node[rows] = k
    for centres, reach, parent in reversed(tree.levels):
        assert (hard_negatives.angles((x * centres[node]).sum(1)) <= reach[node] + 1e-9).all()
        node = parent[node]
    assert len(tree.levels) > 3 and sorted(np.concatenate(tree.leaves)) == list(range(len(g)))


def test_hard_negatives_equal_their_sql(spark):
    assert difference(QUERIES["op11_hard_negatives"](spark, SF), duck(SF), ORACLE_SQL["op11_hard_negatives"]) == ""


def brute_runs(w, least=12):
    """All runs by the definition: for each period, stretches that agree with themselves shifted by it."""
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            if i > s and size >= max(least, 2 * q) and not any(w[s : s + size - d] == w[s + d : s + size] for d in range(1, q)):
                found.append((s, size, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_words(doc_id, text, plant=True):
    w = re.findall(SPACE, text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    return w


def brute_row(doc_id, text):
    w = repeated_words(doc_id, text)
    runs = brute_runs(w)
    drop = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_lyndon_arrays_and_runs_of_small_rows():
    rng = np.random.default_rng(6)
    for t in range(400):
        n, k = int(rng.integers(1, 30)), int(rng.integers(1, 4))
        x = rng.integers(t % 2, k + 1, n)
        got = periodic_runs.lyndon_array(x).tolist()
        for i in range(n):
            sizes = [m for m in range(1, n - i + 1) if 0 not in x[i : i + m] and all(x[i : i + m].tolist() < x[i + d : i + m].tolist() for d in range(1, m))]
            assert got[i] == max(sizes, default=0)
        if t % 2:
            assert list(zip(*(v.tolist() for v in periodic_runs.runs_of(x, 4)), strict=True)) == brute_runs(x.tolist(), 4)


def test_periodic_runs(spark):
    """All documents of the smallest table, and odd ones: each column of the query against brute force."""
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op12_periodic_runs"](spark, SF).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want
    assert sum(v[0] > 0 for v in want.values()) > 10


def test_periodic_runs_of_odd_texts(spark):
    rng = np.random.default_rng(7)
    texts = [None, "", " \n\t ", "one", "a " * 11, "a " * 12, "a\tb\n" * 6, "a b " * 5 + "a", "x y z " * 4 + "q " + "x y z " * 4, "  é " * 20, " ".join(rng.choice(["a", "b"], 400)), " ".join(rng.choice(["a", "b", "c"], 300)), "w " * 30_000 + "end", ("p q r s t u v " * 9 + "- ") * 40, "a b a b a b a b a b a b c d c d c d c d c d c d"]
    rows = [(None if k == 3 else k // 2, t, 1, "x", [1]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, runs string, row array<int>").repartition(3)
    got = collections.Counter((r.doc_id, r.n_runs, tuple(tuple(x) for x in r.runs), r.collapsed, r.start, r.length) for r in periodic_runs.find_runs(df).collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        w = re.findall(SPACE, t or "")
        runs = [(0, 30_000, 1)] if len(w) > 9_999 else brute_runs(w)
        drop = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]))[:2] if runs else (None, None)
        want[(i, len(runs), tuple(runs), " ".join(x for k, x in enumerate(w) if k not in drop), *best)] += 1
    assert got == want
    assert periodic_runs.find_runs(df.where("false")).count() == 0


def test_extensions_see_what_plain_comparison_sees():
    rng = np.random.default_rng(8)
    x = np.concatenate([np.tile(rng.integers(1, 3, 9), 8), rng.integers(1, 3, 60)])
    ext = periodic_runs.Extensions(x)
    i, j = (a.ravel() for a in np.triu_indices(len(x), 1))
    for p, q, f, b in zip(i, j, ext.forward(i, j), ext.backward(i, j), strict=True):
        assert f == next((k for k in range(len(x) - q) if x[p + k] != x[q + k]), len(x) - q)
        assert b == next((k for k in range(p) if x[p - 1 - k] != x[q - 1 - k]), p)


def test_features_are_those_of_the_words():
    import pyarrow as pa

    texts = ["One two, three FOUR! one two", None, "", "..", "sixteenletters-word éàü"]
    got = list(toxicity.features(pa.array(texts, pa.string())))
    row = np.concatenate([i + r for i, _, r, _ in got])
    counts = np.bincount(row, minlength=len(texts))
    for k, t in enumerate(texts):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
        assert counts[k] == sum(max(0, len(w) - max(g, default=0)) for g in toxicity.GRAMS) + sum(len(x) > s for x in w for s in toxicity.STEMS)
    one = np.concatenate([f[r == 0] for i, _, r, f in got if i == 0])
    # "one", "two" and "one two" occur twice; all else once.
    assert len(one) - len(np.unique(one)) == 3


def test_ftrl_is_the_plain_recurrence():
    """Weights equal a loop over single coordinates."""
    rng = np.random.default_rng(9)
    docs = [np.unique(rng.integers(0, 12, 6)) for _ in range(60)]
    y = np.array([float(3 in d) for d in docs])
    a, b, l1, l2 = 0.5, 1.0, 2.5, 0.2
    z, n = np.zeros(13), np.zeros(13)

    def weight(i):
        t = 0 if i == 12 else l1
        return 0.0 if abs(z[i]) <= t else -(z[i] - np.sign(z[i]) * t) / ((b + np.sqrt(n[i])) / a + l2)

    for _ in range(3):
        for d, label in zip(docs, y, strict=True):
            at = [*d, 12]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in at:
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / a * w[i]
                n[i] += g * g
    got, bias = toxicity.ftrl(docs, y, 12, 3, a, b, l1, l2)
    assert np.allclose(got, [weight(i) for i in range(12)]) and np.isclose(bias, weight(12))
    assert got[3] > 0.5 and (got == 0).any()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    got = [r for r in QUERIES["op13_toxicity"](spark, sf).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    out = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out]
    hit, caught = sum(p and y for p, y in out), sum(y for _, y in out)
    assert sum(p == y for p, y in out) / len(out) > 0.97
    assert hit / caught > 0.8 and hit / max(1, sum(p for p, _ in out)) > 0.97


def test_toxicity_of_odd_rows(spark):
    good, bad = "a plain remark on the weather of the day ", "you rotten scoundrel of a remark "
    rows = [(i, (bad if i % 3 == 0 else good) + f"n{i}") for i in range(300)] + [(None, bad), (1, good), (500, None), (501, ""), (502, "!?"), (503, bad * 3000), (504, bad)]
    docs = spark.createDataFrame([(*r, "en", 1.0, 2) for r in rows], "doc_id long, text string, lang string, score double, y int").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), "x") for i in range(300)] + [(None, 1, 1, "x"), (9000, 1, 0, "x"), (7, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    score = collections.defaultdict(list)
    for r in got:
        score[r.doc_id].append((r.score, r.predicted))
    assert len(score[1]) == 2 and score[None][0][1] == score[503][0][1] == score[504][0][1] == 1
    assert score[500] == score[501] == score[502] and score[500][0][1] == 0
    assert all(score[i][0][1] == (i % 3 == 0) for i in range(2, 300))
    none = toxicity.toxicity(docs, labels.where("false")).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert toxicity.toxicity(docs, labels.where("toxic = 0")).agg(F.max("score")).first()[0] < 0.05
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
