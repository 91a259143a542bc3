"""Rows that share a doc_id: one copy of what they repeat stays."""

from __future__ import annotations

import collections
import itertools

import numpy as np
from cascadia.llm import common, jaccard_join, suffix_dedup

NAMES = "doc_id long, text string, id_ long, place_ string"


def brute(rows, length=100):
    """(doc_id, n_bytes, n_removed, kept) of rows in this order."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        out.append((i, len(raw), int(gone.sum()), bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


def passages():
    rng = np.random.default_rng(11)
    a, b, c = ("".join(rng.choice(list("abcdefgh "), n)) for n in (600, 300, 150))
    return [(1, a), (1, a), (2, b), (2, a[:200] + b), (2, "short"), (3, c), (3, c), (3, c), (-4, c + a[500:]), (5, None), (5, None), (5, ""), (9, b + b)]


def test_places_are_unique_and_in_order(spark):
    rng = np.random.default_rng(12)
    rows = [(int(i), f"t{k}", k, "x") for k, i in enumerate(rng.choice([-(1 << 62), -7, 0, 3, 5, 5, 5, 5, (1 << 62) + 1], 300))] + [(None, "a", 1, "x"), (None, "a", 2, "x")]
    df = spark.createDataFrame(rows, NAMES).repartition(7)
    out, place = common.placed(df)
    got = out.collect()
    assert sorted(r.id_ for r in got) == sorted(r[2] for r in rows) and [c for c in out.columns if c != place] == df.columns
    known = sorted((r[place], r.doc_id) for r in got if r.doc_id is not None)
    assert len({p for p, _ in known}) == len(known) == 300
    assert [d for _, d in known] == sorted(d for _, d in known)
    assert all(r[place] is None for r in got if r.doc_id is None)
    same, name = common.placed(df.where("doc_id = 3").limit(1))
    assert name == "doc_id" and same.columns == df.columns


def test_suffix_dedup_of_repeated_rows(spark):
    rows = passages()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], NAMES).repartition(4)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df).collect())
    groups = [list(g) for _, g in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0])]
    orders = [collections.Counter(brute([r for g in order for r in g])) for order in itertools.product(*(set(itertools.permutations(g)) for g in groups))]
    assert got in orders
    assert all(removed <= size for _, size, removed, _ in got)
    left = collections.Counter((r.doc_id, r.text) for r in suffix_dedup.remove_repeats(df).collect())
    assert left[(1, rows[0][1])] + left[(1, rows[0][1][:500])] == 1 and left[(5, None)] == 2 and sum(left.values()) == len(rows)


def test_keep_first_of_repeated_rows(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    near = words[0] + " end"
    rows = [(1, words[0]), (1, words[0]), (1, words[1]), (2, near), (2, words[2]), (3, words[2]), (4, ""), (4, ""), (4, None), (6, near), (6, words[0]), (8, words[3]), (8, words[3] + " more"), (None, words[0]), (None, words[0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], NAMES).repartition(4)
    got = collections.Counter((r.doc_id, r.text) for r in jaccard_join.keep_first(df).collect())
    last = [k for k in got if k[0] == 8]
    assert len(last) == 1 and got.pop(last[0]) == 1
    assert got == collections.Counter({(1, words[0]): 1, (1, words[1]): 1, (2, words[2]): 1, (4, ""): 1, (4, None): 1, (None, words[0]): 2})


def test_filters_of_wide_vectors():
    """At any width a vector exceeds some dozens of filters, and near pairs share one."""
    from cascadia.llm.vector_dedup import ProductCode

    rng = np.random.default_rng(13)
    for dim in (64, 384, 768, 1536):
        code = ProductCode(dim)
        a = rng.normal(size=(200, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=(200, dim))
        b -= (a * b).sum(1, keepdims=True) * a
        b = 0.9005 * a + np.sqrt(1 - 0.9005**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        (ra, ca), (rb, cb) = code.decode(a), code.decode(b)
        assert len(ra) / 200 < 60
        shared = {r for r, c in set(zip(ra, ca, strict=True)) & set(zip(rb, cb, strict=True))}
        assert len(shared) >= 0.95 * 200
