"""The text operators against brute force, on the smallest tables and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import json
import re
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.setrecursionlimit(10_000)
import corpus_pipeline  # noqa: E402
from cascadia.llm import decontaminate as dec  # noqa: E402
from cascadia.llm import html_text, jaccard_join, language, license_scan, pieces, quality, sharding, suffix_dedup, vector_dedup  # noqa: E402
from cascadia.llm.common import components, table  # noqa: E402
from cascadia.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from compare import difference, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 400
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "Two words"), (5, "two WORDS"), (6, "Ünï cödé ▁ 日本 😀 \x00 end"), (7, LONG), (8, LONG), (9, LONG + "tail of another kind"),
    (10, "x" * 5000), (11, "x" * 150 + "y" * 120), (12, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (13, "Released under the MIT License."), (14, "?!"),
]


def odd(spark):
    """Odd texts with extra columns whose names operators might use themselves."""
    rows = [(i, t, "en" if i % 2 else None, "s", None if t is None else len(t), 1, 2, "p", [1]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, comp long, path string, spans array<int>").repartition(3)


def small(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module", params=["small", "odd", "empty"])
def docs(request, spark):
    return {"small": small, "odd": odd, "empty": lambda s: odd(s).where("false")}[request.param](spark)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    links.append((a, b))
    return {i: len(s) for i, s in sets.items()}, roots(ids, links)


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_jaccard_join(docs):
    size, root = brute_components(texts_of(docs))
    got = jaccard_join.jaccard_join(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (size[i], root[i]) for i in size}


def test_jaccard_join_chain_of_near_copies(spark):
    """A long group whose ends don't link with each other, through one very common passage."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(120):
        if i % 3 == 0:
            words[int(rng.integers(60))] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, "a very common passage of some words that many texts share " + " ".join(f"u{i}x{k}" for k in range(12))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, root = brute_components(dict(rows))
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(df).collect()} == root


@pytest.mark.parametrize("block, cold", [(8, 4), (4096, 3), (16, 6)])
def test_jaccard_join_of_hot_lists(spark, monkeypatch, block, cold):
    """Near copies of one text with words from a short list changed, and other texts around one passage.

    Blocks of any size and any measure of hot tokens give the same links; with the
    last one, long lists of tokens that aren't hot are compared too.
    """
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "COLD", cold)
    monkeypatch.setattr(jaccard_join, "SMALL", 12)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(250):
        w = list(base)
        for j in rng.choice(80, rng.integers(0, 7), replace=False):
            w[j] = f"v{rng.integers(6)}"
        texts[2 * i] = " ".join(w)
    for i in range(250):
        own = [f"u{i}x{j}" for j in range(rng.integers(5, 45))]
        texts[2 * i + 1] = " ".join(own[: len(own) // 2] + base[20:70] + own[len(own) // 2 :])
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(df).collect()}
    assert got == brute_components(texts)[1]
    assert len(set(got.values())) > 50


def test_jaccard_join_of_repeated_and_null_ids(spark):
    t = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    df = spark.createDataFrame([(1, t[0]), (1, t[0]), (1, t[1]), (2, t[1] + " end"), (None, t[1]), (None, t[2]), (None, None), (7, "")], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_join(df).select(F.coalesce("doc_id", F.lit(-1)), "n_shingles", F.coalesce("component_id", F.lit(-1))).collect())
    assert got == sorted([(1, 26, 1), (1, 26, 1), (1, 26, 1), (2, 27, 1), (-1, 26, 1), (-1, 26, -1), (-1, 0, -1), (7, 0, 7)])


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(7, 7), (100, 99), (None, 3)], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}


def brute_spans(texts, length=100):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, kept)
    return out


def test_suffix_dedup(docs):
    want = brute_spans(texts_of(docs))
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
    assert all(r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest() for r in got)


def common_passages(n=120):
    """Texts with one common passage among bytes of their own, some of these alike, and repeated bytes."""
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefgh "), 260))
    ends = ["".join(rng.choice(list("xyz "), 70)) for _ in range(n)]
    texts = {i: ends[rng.integers(n)] + passage + ends[rng.integers(n)] for i in range(n)}
    texts |= {n: "ab" * 400, n + 1: "z" * 300 + passage[:150] + "ab" * 200, n + 2: passage * 3, n + 3: texts[5]}
    return texts


def test_suffix_dedup_of_hot_minimizers(spark, monkeypatch):
    texts = common_passages()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute_spans(texts)
    steps = []
    dealt = suffix_dedup.dealt_again
    monkeypatch.setattr(suffix_dedup, "dealt_again", lambda d, f, n, step: steps.append(step) or dealt(d, f, n, step))
    for hot, many, flush in ((2000, 16, 1 << 18), (200, 1, 500), (1 << 20, 2, 300)):
        for name, x in (("HOT", hot), ("MANY", many), ("FLUSH", flush)):
            monkeypatch.setattr(suffix_dedup, name, x)
        got = suffix_dedup.suffix_dedup(df).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
    assert steps == [9, 1, 9, 1]


def test_blocks_of_equal_strings_have_equal_keys():
    texts = [t.encode() for t in common_passages(20).values()]
    for step in suffix_dedup.STEPS:
        key, _, row, start, count = suffix_dedup.blocks(texts, step, 100)
        keys = {}
        for k, r, s, n in zip(key, row, start, count, strict=True):
            for j in range(s, s + n):
                keys.setdefault(texts[r][j : j + 100], set()).add(int(k))
        assert all(len(k) == 1 for k in keys.values())
        assert count.sum() == sum(len(t) - 99 for t in texts) and (count.max() <= step)
        if step == 1:
            assert len({k for x in keys.values() for k in x}) == len(keys)


def test_suffix_dedup_of_long_and_cut_texts(spark):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcd "), 700_000))
    rows = [(1, base), (2, base[300_000:300_500] + "é" + base[600_000:600_099]), (3, base[100:] + base[:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == {1: (0, 0), 2: (500, 1), 3: (len(base) + 50, 1)}
    left = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df).collect()}
    assert left[2] == "é" + base[600_000:600_099] and left[3] == ""


def test_rows_without_an_id(spark):
    """They stay as they are, and documents in one batch with them lose their repeats all the same."""
    a, b = "".join(chr(97 + i * i % 23) for i in range(150)), " ".join(f"word{i}" for i in range(40))
    rows = [(None, b), (1, a + "!"), (2, "?" + a), (3, b), (None, a), (4, b), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = suffix_dedup.suffix_dedup(df).collect()
    want = brute_spans({i: t for i, t in rows if i is not None})
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got if r.doc_id is not None} == want
    lone = sorted(t or "" for i, t in rows if i is None)
    assert sorted(bytes(r.kept).decode() for r in got if r.doc_id is None) == lone
    left = suffix_dedup.remove_repeats(df).collect()
    assert sorted(r.text or "" for r in left if r.doc_id is None) == lone and len(left) == len(rows)
    kept = jaccard_join.keep_first(df).collect()
    assert sorted(r.text or "" for r in kept if r.doc_id is None) == lone
    assert {r.doc_id for r in kept} == {1, 2, 3, None}


def test_remove_repeats_with_clashing_names(spark):
    docs = odd(spark)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[8].text == "" and got[7].text and got[7].spans == [1] and got[1].text is None and len(got) == len(ODD)
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns and 8 not in {r.doc_id for r in kept.collect()}


def test_run_index():
    text = b"banana_bandana_banana"
    left = len(text) - np.arange(len(text))
    index = suffix_dedup.RunIndex(np.frombuffer(text, np.uint8), left)
    sa = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8), left)
    assert [text[i:] for i in sa] == sorted(text[i:] for i in range(len(text)))
    near, match = index.matching_statistics(len(text))
    order = {int(p): k for k, p in enumerate(sa)}
    for i in range(len(text)):
        k = order[i]
        if k:
            assert near[i] == sa[k - 1]
            n = 0
            while i + n < len(text) and sa[k - 1] + n < len(text) and text[i + n] == text[sa[k - 1] + n]:
                n += 1
            assert match[i] == n
    assert len(index.symbols) < len(text)


def brute_hits(texts, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = {}
    for i, t in texts.items():
        w, ids = word(t), set()
        hit = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    ids |= windows[g]
                    hit[k : k + n] = [1] * n
        out[i] = (len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [1 << 23, 900])
def test_decontamination(docs, spark, monkeypatch, block):
    monkeypatch.setattr(dec, "BLOCK", block)
    bench = table(spark, SF, "benchmark").select("item_id", "text").union(spark.createDataFrame([(900, "TWO words"), (901, None), (902, "five six seven eight nine ten eleven twelve thirteen fourteen one two"), (902, "kappa"), (903, "")], "item_id long, text string"))
    want = brute_hits(texts_of(docs), [tuple(r) for r in bench.collect()])
    got = dec.contamination(docs, bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == want
    assert {r.doc_id for r in dec.decontaminate(docs, bench).collect()} == {i for i, x in want.items() if not x[1]}


@pytest.mark.parametrize("expand", [1, 3, 7])
def test_places_of_windows_in_parts(monkeypatch, expand):
    """Windows with many places in a shard and in the items give the same matches however many are held at once."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abc"), 30)) for _ in range(6)]
    known = dec.Suffixes(["x", "y", "z"], [texts[0], texts[1] + " " + texts[0], "a b"], 4)
    words, row = [], []
    for i, t in enumerate([*texts, texts[0] + " " + texts[0]]):
        for _, _, buf, off in dec.K.text_chunks(dec.pa.array([t])):
            h, _ = dec.K.word_hashes(buf, off, dec.K.ALNUM)
            words.append(h)
            row.append(np.full(len(h), i))
    words, row = np.concatenate(words), np.concatenate(row)
    want = sorted(zip(*dec.search(words, row, known), strict=True))
    monkeypatch.setattr(dec, "EXPAND", expand)
    assert len(want) > 50 and sorted(zip(*dec.search(words, row, known), strict=True)) == want


def test_decontamination_of_repeated_and_null_ids(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"w{i} " * 12) for i in range(4)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "w1 " * 12), (1, "clean"), (None, "w2 " * 11)], "doc_id long, text string")
    want = sorted([(1, 12, 12, 1), (1, 1, 0, 0), (-1, 11, 11, 1)])
    for block in (8 << 20, 40):
        monkeypatch.setattr(dec, "BLOCK", block)
        assert sorted(tuple(r) for r in dec.contamination(docs, bench).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_hit", "n_items").collect()) == want


def test_suffix_array_of_words():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 3, 60)
    row = np.repeat([0, 1, 2], 20)
    end = np.searchsorted(row, row, "right")
    got = dec.suffix_array(codes, end, 10)
    assert [list(codes[p : min(end[p], p + 10)]) for p in got] == sorted(list(codes[p : min(end[p], p + 10)]) for p in range(60))


def test_longest_match(spark):
    d = spark.createDataFrame([(1, "zero a b c d e f g h i j k l other")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "start a b c d e f g h i j k l stop")], "item_id long, text string")
    (m,) = dec.contamination(d, b).first().matches
    assert (m.item_id, m.doc_word, m.item_word, m.n_words) == ("5", 1, 1, 12)


def brute_pieces(v, text):
    """Best sum of scores by plain dynamic programming over the whole text."""
    if not text:
        return 0.0
    table_ = {p: s for i, (p, s) in enumerate(zip(v.pieces, v.scores, strict=True)) if p and i not in set(v.byte_ids)}
    low = min(table_.values()) - pieces.UNKNOWN
    raw = (" " + text).encode()
    best = [float("-inf")] * (len(raw) + 1)
    best[0] = 0.0
    for i in range(len(raw)):
        if best[i] == float("-inf") or (raw[i] & 0xC0) == 0x80:
            continue
        size = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        single = raw[i : i + size] in table_
        for j in range(i + 1, min(len(raw), i + 48) + 1):
            if (s := table_.get(raw[i:j])) is not None:
                best[j] = max(best[j], best[i] + s)
        if not single:
            best[i + size] = max(best[i + size], best[i] + low)
    return best[-1]


def test_pieces_are_the_best_and_come_back():
    v = pieces.Vocabulary.load()
    e = pieces.Encoder(v)
    rng = np.random.default_rng(2)
    texts = ["hello world", "  two  spaces \n\nand\tmore ", "日本語 😀 é", "", None] + ["".join(rng.choice(list("ab eé日😀\n.the "), int(rng.integers(1, 40)))) for _ in range(60)]
    ids, at = e.encode(texts)
    bytes_ = set(v.byte_ids.tolist())
    for t, lo, hi, back in zip(texts, at[:-1], at[1:], e.decode(ids, at), strict=True):
        assert back == (t or "").encode()
        own = [int(i) for i in ids[lo:hi]]
        fallback = sum((v.pieces[i][0] & 0xC0) != 0x80 for i in own if i in bytes_)
        assert sum(v.scores[i] for i in own if i not in bytes_) + fallback * e.unknown == pytest.approx(brute_pieces(v, t))


def test_expected_counts_against_all_segmentations():
    base = pieces.Vocabulary.load()
    at = {p: i for i, p in enumerate(base.pieces) if i not in set(base.byte_ids)}
    coder = pieces.Encoder(base.__class__(base.pieces, -np.arange(len(base.pieces)) / 5000 - 1, base.byte_ids, base.trie, base.cuts))
    word = b" there"
    ways = []
    for m in range(1 << (len(word) - 1)):
        ends = [0, *(k + 1 for k in range(len(word) - 1) if m >> k & 1), len(word)]
        parts = [word[a:b] for a, b in zip(ends, ends[1:])]
        if all(p in at for p in parts):
            ways.append(parts)
    weight = np.exp([sum(coder.v.scores[at[p]] for p in w) for w in ways])
    want = np.zeros(len(base.pieces))
    for w, x in zip(ways, weight / weight.sum(), strict=True):
        for p in w:
            want[at[p]] += 3 * x
    got, likely = coder.expected([word], np.array([3]))
    assert len(ways) > 3 and np.allclose(got * pieces.QUANTUM, want, atol=1e-5)
    assert likely / 1024 == pytest.approx(3 * np.log(weight.sum()), abs=1e-2)


def test_long_words_go_the_same_way(monkeypatch):
    """Words of any length are segmented alike, alone or in step, and their expected counts agree."""
    coder = pieces.Encoder(pieces.Vocabulary.load())
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghinrstéß日😀"), n)).encode() for n in (3, 40, 300, 700)] + [b" " + b"the" * 90, "▁".encode(), b"x" * 500]
    counts = np.array([1, 2, 3, 1, 5, 1, 2])
    ids, at = coder.segment(words)
    out, likely = coder.expected(words, counts)
    monkeypatch.setattr(pieces, "LONG", 1)
    ids2, at2 = coder.segment(words)
    out2, likely2 = coder.expected(words, counts)
    assert (ids == ids2).all() and (at == at2).all()
    assert np.abs(out - out2).max() <= 2000 and abs(likely - likely2) <= 1e-9 * abs(likely) + len(words)


def test_improbable_short_words_are_counted(spark):
    """Words whose probability is below what a double holds, as of null characters, which have no piece."""
    rows = [(i, f"some words of a common text {i}") for i in range(40)] + [(90, "\x00" * 31), (91, "\x00" * 30 + " words")]
    out = {r.doc_id: r for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == len(rows) and all(r.round_trip for r in out.values())
    assert out[90].n_byte_tokens == 31 and out[91].n_byte_tokens == 30
    coder = pieces.Encoder(pieces.Vocabulary.load())
    coder.v.scores = np.full(len(coder.v.pieces), -30.0)
    coder.unknown = -40.0
    words, counts = [b" " + b"\x00" * 31, b" the", b" \x01" + b"\x00" * 30], np.array([3, 2, 1])
    got, likely = coder.expected(words, counts)
    alone = np.zeros(len(got), np.int64)
    assert abs(likely - sum(coder._expected_alone(w, int(n), alone) for w, n in zip(words, counts, strict=True))) <= len(words)
    assert np.abs(got - alone).max() <= 1


def test_piece_scores_are_log_probabilities(spark):
    text = "The international community has considered the government responsibility"
    df = spark.createDataFrame([(i, f"{text} {i}") for i in range(50)] + [(99, None)], "doc_id long, text string").repartition(4)
    v = pieces.estimated(df, pieces.Vocabulary.load())
    plain = v.trie.value[v.trie.value >= 0]
    assert np.exp(v.scores[plain]).sum() == pytest.approx(1) and (v.scores[plain] < 0).all()
    again = pieces.estimated(df.repartition(2), pieces.Vocabulary.load())
    assert (again.scores == v.scores).all()
    row = pieces.encode(df).where("doc_id = 7").first()
    # Eight words and a number; the ranks of the merge model cut the words into 29 pieces.
    assert row.round_trip and row.n_tokens <= 12


def test_encode_and_decode(docs, spark):
    out = pieces.encode(docs)
    texts = texts_of(docs)
    rows = out.collect()
    assert all(r.round_trip for r in rows) and len(rows) == len(texts)
    assert {r.doc_id: r.text for r in pieces.decode(out).collect()} == {i: t or "" for i, t in texts.items()}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op6_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_quality_of_odd_rows(docs, spark):
    labels = table(spark, SF, "labels").select("doc_id", "quality")
    got = quality.quality(docs, labels.union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.score for r in quality.quality(docs, labels.where("false")).collect()} <= {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() - sum(r.predicted == 0 for r in quality.quality(docs, labels).collect())


def test_trees_walk_as_trained():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.train_trees(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97

    def walk(t, row):
        at = 0
        while model.child[t][at] != at:
            at = model.child[t][at] + (row[model.feature[t][at]] > model.threshold[t][at])
        return model.value[t][at]

    assert model.raw(x[:5]) == pytest.approx([model.base + sum(walk(t, r) for t in range(len(model.feature))) for r in x[:5]])


def test_language_gradients():
    net = language.Network(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, on = language.pad([b"abc", b"d", b"efghi"])
    y = np.array([0, 1, 2])
    _, g = net.gradients(x, on, y)
    for k, p in net.p.items():
        f, i = p.reshape(-1), int(np.abs(g[k]).argmax())
        old = f[i]
        f[i] = old + 1e-3
        up = net.gradients(x, on, y)[0]
        f[i] = old - 1e-3
        down = net.gradients(x, on, y)[0]
        f[i] = old
        assert (up - down) / 2e-3 == pytest.approx(g[k].reshape(-1)[i], abs=2e-4)


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op7_language_id(spark, sf).join(table(spark, sf, "documents").where("length(text) > 100").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def test_language_of_short_texts(spark):
    """The first words of held-out documents, cut to some dozens of characters."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("lang is not null and length(text) > 200").select("doc_id", "text", "lang")
    short = docs.where(language.held_out()).select((F.col("doc_id") * 5 + 10**9).alias("doc_id"), F.substring("text", 1, 60).alias("text"), F.lit(None).cast("string").alias("lang"), F.col("lang").alias("true"))
    short = short.where("length(regexp_replace(text, '[^a-zA-Z]', '')) > 30")
    got = language.languages(docs.union(short.drop("true"))).join(short.select("doc_id", "true"), "doc_id").collect()
    assert len(got) > 60 and np.mean([r.lang_pred == r["true"] for r in got]) > 0.9


def test_language_windows_cover_each_byte_once():
    net = language.Network(["a", "b"], hidden=4)
    data = np.random.default_rng(1).integers(32, 127, 1000).astype(np.uint8)
    sums, row = language.Labeller(net).rows(data, np.array([0, 0, 5, 700, 1000]))
    (y,) = net.positions(data[None, :5], np.ones((1, 5), bool))
    assert row.tolist() == [1] + [2] * 7 + [3] * 3
    # Row 1 starts at 0: its one window reads bytes 0 to 5 only.
    assert sums[0] == pytest.approx(y.sum((0, 1)), abs=1e-3)


def test_language_labels_in_less_time_than_it_learns():
    """Labelling needs no states kept for gradients: the same log-probabilities, in less CPU time."""
    net, r = language.Network(["a", "b", "c"]), np.random.default_rng(5)
    exact = language.Network(["a", "b", "c"])
    exact.p = {k: v.astype(np.float64) * 3 for k, v in exact.p.items()}
    x, on = r.integers(0, 256, (1500, 128)).astype(np.uint8), np.arange(128) < np.sort(r.integers(1, 400, 1500))[:, None]
    for model, slack in ((exact, 1e-9), (net, 1e-4)):
        plain, quick = model.positions(x, on, True)[0], model.positions(x, on)[0]
        assert quick.shape == plain.shape and np.abs((quick - plain)[on.T]).max() < slack
    huge = language.Network(["a", "b"])
    huge.p = {k: v * 1e4 for k, v in huge.p.items()}
    assert np.isfinite(huge.positions(x[:20], on[:20])[0]).all()

    def least(keep):
        took = []
        for _ in range(4):
            start = time.process_time()
            net.positions(x, on, keep)
            took.append(time.process_time() - start)
        return min(took)

    assert least(False) < 0.75 * least(True)


def test_language_of_odd_rows(spark):
    got = {r.doc_id: r for r in language.languages(odd(spark)).collect()}
    assert len(got) == len(ODD) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 14))
    assert language.languages(odd(spark).where("false")).count() == 0


def brute_links(vectors, least=0.9):
    ok = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(i, j) for i in ok for j in ok if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= least]
    n = collections.Counter(x for p in links for x in p)
    return {i: n[i] for i, _ in vectors}, roots([i for i, _ in vectors], links)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        center = rng.normal(size=32)
        rows += [(100 * c + k, (center + 0.12 * rng.normal(size=32)).astype(np.float32).tolist()) for k in range(12)]
    rows += [(9000 + k, rows[0][1]) for k in range(5)] + [(9100, None), (9101, []), (9102, [0.0] * 32), (9103, [float("nan")] + [1.0] * 31), (9104, [None] + [1.0] * 31), (9105, [1.0, 2.0]), (9106, [2.0, 4.0]), (9107, [float("inf")] * 32)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n long, comp string").repartition(3)
    n, root = brute_links([(i, [None if x is None else float(np.float32(x)) for x in v] if v else v) for i, v in rows])
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df).collect()}
    assert set(got) == set(n)
    assert all(got[i].n_links <= n[i] for i in n) and sum(r.n_links for r in got.values()) >= 0.9 * sum(n.values())
    assert np.mean([got[i].component_id == root[i] for i in n]) > 0.98
    assert all(got[i].n_links == 0 and got[i].kept for i in (9100, 9101, 9102, 9103, 9104, 9107)) and got[9106].component_id == 9105
    assert vector_dedup.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("many", [40, 4000])
def test_recall_of_vectors_right_at_the_bound(spark, many):
    """Pairs at a cosine just over 0.9, among few and many other vectors; links and components agree."""
    rng = np.random.default_rng(many)
    rows, pairs = [], 300
    for k in range(pairs):
        a = rng.normal(size=48)
        a /= np.linalg.norm(a)
        b = rng.normal(size=48)
        b -= (b @ a) * a
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.9005 * a + np.sqrt(1 - 0.9005**2) * b / np.linalg.norm(b)).tolist())]
    rows += [(10_000 + k, rng.normal(size=48).tolist()) for k in range(many)]
    got = {r.vec_id: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert np.mean([got[2 * k + 1].n_links == 1 for k in range(pairs)]) >= 0.95
    members = collections.Counter(r.component_id for r in got.values())
    assert all((r.n_links > 0) == (members[r.component_id] > 1) for r in got.values())


def test_vectors_of_the_given_table(spark):
    """Every vector of the smallest table beside copies with noise, against brute force."""
    base = [(r.vec_id, list(r.embedding)) for r in table(spark, "/root/testdata/sf0.001", "embeddings").collect() if r.embedding]
    rng = np.random.default_rng(8)
    size = np.std(np.array(base[0][1]))
    rows = base + [(10**6 + 10 * i + j, (np.array(v) + rng.normal(size=len(v)) * size * 0.3).tolist()) for i, v in base[:150] for j in range(2)]
    n, root = brute_links(rows)
    got = {r.vec_id: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(n.values()) > 200 and all(got[i].n_links <= n[i] for i in n)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n.values())
    assert np.mean([got[i].component_id == root[i] for i in n]) > 0.95


def test_vectors_of_a_split_filter(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SIDE", 16)
    rng = np.random.default_rng(6)
    center = rng.normal(size=16)
    rows = [(k, (center + 0.02 * rng.normal(size=16)).tolist()) for k in range(90)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.n_links for r in got} == {89} and {r.component_id for r in got} == {0}


def page(n, body):
    return (n, f"http://Host.example:80/{n}", f"<html><body><nav><a href=/>menu</a></nav>{body}<aside>side</aside><footer>foot</footer></body></html>")


def test_html(spark):
    text = "Some words &amp; more of the story, told at length. "
    rows = [page(n, f'<div class="c{n}"><h1>T{n}</h1><p>{text * 3}<p>last<br>line &lt;b&gt;</p><div class="comments"><p>reader says</p></div><form>f</form></div>') for n in range(4)]
    rows += [(10, None, None), (11, "nonsense", ""), (12, "http://Host.example/x", "bare <b>te</b>xt"), (13, "http://h2/", "<p>unclosed <script>var a='<p>no</p>'</script> tail<!-- no -->")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, host int, path string")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    body = " ".join((text.replace("&amp;", "&") * 3).split())
    for n in range(4):
        assert got[n].text == f"T{n} {body} last line <b>" and got[n].path == "html>body>div.c#"
    assert (got[10].text, got[11].text, got[12].text, got[13].text) == ("", "", "bare text", "unclosed tail")
    assert html_text.main_text(df.where("false")).count() == 0


def test_html_on_pages(spark):
    got = html_text.op2_html_extraction(spark, SF).collect()
    assert len(got) == table(spark, SF, "pages").count() and all(r.n_chars == len(r.text) and "track(" not in r.text for r in got)


def test_licenses_of_real_notices(spark):
    lines = [("MIT", "The MIT License (MIT)"), ("MIT", "// SPDX-License-Identifier: MIT"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("GPL", "GNU GENERAL PUBLIC LICENSE"), ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), (None, "A driving license is needed here."), (None, "permission was not given by the office")]
    files = spark.createDataFrame([(f"d{i}/f", f"first line\n{t}\nlast line") for i, (_, t) in enumerate(lines)], "path string, text string")
    templates = spark.createDataFrame(license_scan.TEMPLATES, "license string, line string")
    got = {r.path: r.own_license for r in license_scan.scan(files, templates).collect()}
    assert got == {f"d{i}/f": k for i, (k, _) in enumerate(lines)}


def _wrapped(text, mark, width=60):
    out, line = [], mark
    for word in text.split():
        if len(line) + len(word) > width:
            out.append(line)
            line = mark
        line += " " + word
    return "\n".join([*out, line])


def test_licenses_of_headers_and_files(spark):
    """Texts over several lines: without a heading, in comments, before code, as whole files."""
    code = "\n".join(f"def f{i}(x):\n\n    return x * {i}" for i in range(200))
    mit = "\n\n".join(_wrapped(t, "") for t in (license_scan._MIT_GRANT, license_scan._MIT_NOTICE, license_scan._MIT_WARRANTY))
    cc = "# This work is licensed under a Creative Commons\n# Attribution 4.0 International License."
    apache = next(t for k, t in license_scan.TEMPLATES if k == "Apache-2.0" and len(t) > 300)
    bsd = "\n".join(_wrapped(t, " *") for t in (license_scan._BSD_OPENING, license_scan._BSD_TWO, license_scan._BSD_THIRD, license_scan._BSD_WARRANTY))
    want = {
        "a/LICENSE": ("MIT", "Copyright (c) 2020 Jane Doe\n\n" + mit),
        "b/f.py": ("CC-BY-4.0", f"{cc}\n#\n{code}"),
        "c/f.js": ("Apache-2.0", f"/*\n{_wrapped(apache, ' *')}\n *\n */\n{code}"),
        "d/LICENSE": ("BSD-3-Clause", f"/*\n * Copyright (c) 2019, Some Company\n * All rights reserved.\n *\n{bsd}\n */"),
        "e/COPYING": ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007"),
        "f/f.py": (None, f"# The permission of users is read here,\n# and copyright lines are counted.\n\n{code}"),
        "g/long": ("MIT", "no word of it\n" * 20000 + "\n" + mit),
        "h/f.py": ("proprietary", f"All rights reserved.\n\n{code}"),
    }
    files = spark.createDataFrame([(k, t) for k, (_, t) in want.items()], "path string, text string")
    got = license_scan.scan(files.union(spark.createDataFrame([("a/f", "x"), ("c/g", "x"), ("g/x", "x")], files.schema)), spark.createDataFrame(license_scan.TEMPLATES, "license string, line string")).collect()
    assert {r.path: r.own_license for r in got if r.path in want} == {k: v for k, (v, _) in want.items()}
    assert {r.path: r.license for r in got if r.path not in want} == {"a/f": "MIT", "c/g": None, "g/x": None}


def test_licenses_without_ids(spark):
    docs = spark.createDataFrame([(None, "Released under the MIT License.", "en", "s"), (None, "text", "en", "s"), (5, None, None, None)], "doc_id long, text string, lang string, source string")
    templates = spark.createDataFrame(license_scan.TEMPLATES, "license string, line string")
    got = license_scan.scan(license_scan.document_paths(docs).select("path", "text"), templates).collect()
    assert sorted((r.license or "", r.origin) for r in got) == [("", "none"), ("MIT", "inherited"), ("MIT", "own")]


def test_licenses_of_odd_rows(spark):
    files = spark.createDataFrame([("a/LICENSE", "Released under the MIT License."), ("a/b/f", "code"), ("a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/d/g", None), ("h", ""), (None, "x"), ("q/z", "long text " * 50 + "\nLicensed under CC BY-NC 4.0.")], "path string, text string")
    templates = spark.createDataFrame(license_scan.TEMPLATES, "license string, line string")
    got = {r.path: (r.license, r.origin, r.from_dir) for r in license_scan.scan(files, templates).collect()}
    assert got == {"a/LICENSE": ("MIT", "own", None), "a/b/f": ("MIT", "inherited", "a"), "a/b/c/LICENSE": ("Apache-2.0", "own", None), "a/b/c/d/g": ("Apache-2.0", "inherited", "a/b/c"), "h": (None, "none", None), None: (None, "none", None), "q/z": ("CC-BY-NC-4.0", "own", None)}
    assert license_scan.scan(files.where("false"), templates).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), duck(SF), ORACLE_SQL[name]) == ""


def test_sharding_versions(spark, tmp_path):
    docs = odd(spark)
    root = f"file://{tmp_path}/t"
    shards = sharding.shard_documents(docs, root, arrivals=5)
    assert shards.read(docs).count() == len(ODD) and shards.versions()[0] == 1
    with pytest.raises(Exception, match="(?i)exist"):
        shards._commit(shards.versions()[-1] - 1, [])
    before = shards.versions()[-1]
    shards.append(docs, F.lit(0))
    assert shards.versions()[-1] == before + 1 and shards.read(docs).count() == 2 * len(ODD)
    assert all(shards.read(docs, v).count() == len(ODD) for v in range(1, before + 1))  # superseded runs stay readable
    assert all(json.loads(x) for x in open(f"{tmp_path}/t/manifest/v{before:08d}.json"))
    none = sharding.shard_documents(docs.where("false"), f"file://{tmp_path}/e")
    assert none.read(docs).count() == 0
    shards.expire()
    assert shards.versions() == [before + 1] and shards.read(docs).count() == 2 * len(ODD)


def test_sharding_of_two_writers_and_clashing_names(spark, tmp_path, monkeypatch):
    """A writer that loses the race for a version takes the next one; a merge whose runs are gone is given up."""
    monkeypatch.setattr(sharding, "FAN", 2)
    docs = spark.createDataFrame([(i, f"text {i}", i, i) for i in range(6)], "doc_id long, text string, arrival long, run_first long")
    one, two = (sharding.ShardTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    commit, lost = one._commit, []

    def late(base, runs):
        if not lost:
            lost.append(two.append(docs, F.lit(0)))
        return commit(base, runs)

    monkeypatch.setattr(one, "_commit", late)
    one.append(docs, F.col("doc_id"))
    got = one.read(docs)
    assert got.columns == ["doc_id", "text", "arrival", "run_first", "run_first_", "run_level", "run_rows", "run_bytes"]
    assert sorted((r.doc_id, r.arrival) for r in got.collect()) == sorted(2 * [(i, i) for i in range(6)]) and len(one.versions()) == 2
    gone = {r["run"] for r in one.runs().limit(2).collect()}
    two.compact()
    assert one._change(gone, [{"run": "x", "path": f"file://{tmp_path}/x", "first": 0, "level": 1, "rows": 0, "bytes": 0}]) is None
    assert two.read(docs).count() == 12


def test_pipeline_stages(spark):
    """Each stage on what its predecessor kept, against brute force."""
    docs = table(spark, SF, "documents")
    labels, bench = table(spark, SF, "labels"), [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = corpus_pipeline.saved(stage(spark, docs, SF), "test")
        after = {r.doc_id: r for r in out.collect()}
        if k == 0:
            bad = {r.doc_id for r in quality.quality(docs, labels).where("predicted = 0").collect()}
            assert bad and set(after) == set(before) - bad
        if k == 1:
            _, root = brute_components({i: r.text for i, r in before.items()})
            assert set(after) == {i for i, r in root.items() if i == r}
        if k == 2:
            want = brute_spans({i: r.text for i, r in before.items()})
            assert {i: r.text for i, r in after.items()} == {i: x[3].decode(errors="ignore") for i, x in want.items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        if k == 3:
            hits = brute_hits({i: r.text for i, r in before.items()}, bench)
            assert set(after) == {i for i, x in hits.items() if not x[1]}
        if k < 4:
            assert out.columns == docs.columns and all(after[i] == before[i] for i in after if k != 2)
        else:
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
