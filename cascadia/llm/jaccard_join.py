"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Tokens are the distinct word shingles of a document, ordered from rare to
frequent. Two sets with Jaccard similarity t or more share at least l tokens of
their l-prefixes, the first ``n - ceil(t n) + l`` tokens, for every l. A
document whose prefix holds frequent tokens takes a longer prefix and in return
a candidate must share more of it: with s the summed frequency in the l-prefix,
at most s / l documents can share l of its tokens, and the l with the least
estimated cost is taken. Before verification a pair must share l tokens of the
shorter prefixes and as many of the whole prefixes as its sizes call for.

Exact copies have one set, so they are one node. A group of thousands of near
copies is never expanded into all pairs. Tokens of COLD documents or more are
hot. Lists of other tokens give their pairs at once; hot ones first link their
members to a pivot. What then is left are pairs of different components. A set
whose prefix reaches a hot token has all its other tokens before it. So two such
sets without a shared token of the other kind share at most the hot tokens of
either, and the first that they share stands among the first hot ones of both:
behind it, each still needs as many as their sizes call for. Only such pairs
leave a hot list, and must then share l tokens of the shorter prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, dropped, repeated_ids, saved, small_batches, table, unused

U64 = np.uint64
#: Tokens of 2**COLD documents or more are hot.
COLD = 4
#: Lists of other tokens with more nodes (where the table of frequent tokens is
#: full) go through pivots too.
SMALL = 32
#: Nodes of one block of a long list.
BLOCK = 4096
#: Entries of long lists that one group of blocks holds, about.
GROUP = 1 << 17
#: A bound on the table of frequent tokens that is broadcast (9 bytes each).
#: It shapes the order of tokens only; every order gives the same links.
MOST_FREQUENT = 1 << 20
FREQUENT = 4
LEVELS = 4
FLUSH = 1 << 20
#: Tokens of one token range, about; a quarter of them or so are in prefixes.
RANGE = 3 << 20
FP_BITS = 26


def _ids(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_node(tokens: np.ndarray) -> np.uint64:
    """Digest of a token set; equal sets are one node."""
    with np.errstate(over="ignore"):
        x = K.mix(tokens + U64(0x5851F42D4C957F2D))
        return K.mix(np.array([x.sum(dtype=U64) ^ K.mix(np.bitwise_xor.reduce(tokens)[None])[0] * U64(3)], dtype=U64) + U64(len(tokens)))[0]


def document_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, node, text_hash): the size and digest of each document's shingle set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, nodes = b.column(0), [], []
            for _, _, buf, off in K.text_chunks(b.column(1)):
                for s in K.shingle_sets(buf, off, k):
                    sizes.append(len(s))
                    nodes.append(int(_ids(np.array([set_node(s)]))[0]) if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), b.column(2)], names=["doc_id", "n_shingles", "node", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, n_shingles long, node long, text_hash long")


def _blobs(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Token ranges by their high bits: ids of the ranges present and their bounds in sorted ``tokens``."""
    r = (tokens >> U64(64 - bits)).astype(np.int64)
    ids, first = np.unique(r, return_index=True)
    return ids, np.append(first, len(tokens))


def frequent_tokens(docs: DataFrame, k: int, bits: int, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent token prefixes (sorted) and the logarithms of their counts over all documents.

    A token counts by its first ``bits + 26`` bits. Counting is distributed:
    tasks send sorted runs of a token range as gaps, one task merges a range.
    """
    shift = U64(64 - bits - FP_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            t = np.sort(np.concatenate(held))
            ids, at = _blobs(t, bits)
            blobs = []
            for i in range(len(ids)):
                low = ((t[at[i] : at[i + 1]] >> shift) & U64((1 << FP_BITS) - 1)).astype(np.int64)
                gap = np.diff(low, prepend=0)
                wide = gap.max(initial=0) > 65535
                blobs.append((b"4" if wide else b"2") + gap.astype(np.uint32 if wide else np.uint16).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(blobs, pa.binary())], names=["r", "blob"])

        for b in batches:
            for _, _, buf, off in K.text_chunks(b.column(0)):
                s = K.shingle_sets(buf, off, k)
                held.extend(x for x in s if len(x))
                n += sum(map(len, s))
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def merge(key: tuple, batch: pa.Table) -> pa.Table:
        got = []
        for x in batch.column("blob").to_pylist():
            got.append(np.cumsum(np.frombuffer(x, np.uint32 if x[:1] == b"4" else np.uint16, offset=1), dtype=np.int64).astype(np.uint32))
        v = np.sort(np.concatenate(got))
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        n = np.diff(np.append(first, len(v)))
        keep = n >= FREQUENT
        fp = (int(key[0].as_py()) << FP_BITS) + v[first][keep].astype(np.int64)
        return pa.table({"fp": pa.array(fp), "n": pa.array(n[keep])})

    runs = docs.select("text").mapInArrow(count, "r long, blob binary")
    found = saved(runs.groupBy("r").applyInArrow(merge, "fp long, n long").withColumn("log", F.floor(F.log2("n")).cast("int")), "frequent")
    least, total = None, 0
    for log, n in sorted(((r["log"], r["n"]) for r in found.groupBy("log").agg(F.count("*").alias("n")).collect()), reverse=True):
        total += n
        if total > most:
            break
        least = log
    if least is None:
        return np.zeros(0, U64), np.zeros(0, np.uint8)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column(0)), np.asarray(b.column(1)).astype(np.uint8)) for b in batches]
        if got:
            fp, log = (np.concatenate(x) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([fp.tobytes()]), pa.array([log.tobytes()])], names=["fp", "log"])

    top = found.where(F.col("log") >= least).select("fp", "log").mapInArrow(pack, "fp binary, log binary").collect()
    fps, logs = (np.concatenate([np.frombuffer(r[i], t) for r in top]) for i, t in ((0, U64), (1, np.uint8)))
    order = np.argsort(fps)
    return fps[order], logs[order]


def choose_level(freq: np.ndarray, n: int, most: int, weight: float = 4.0) -> int:
    """The l whose l-prefix costs least; ``freq`` are estimated frequencies in token order, ``most`` is n - ceil(t n)."""
    total = np.cumsum(freq[: most + LEVELS])[most:]
    ell = np.arange(1, len(total) + 1)
    return int(np.argmin((most + ell) + weight * (total - (most + ell)) / ell)) + 1


def postings(docs: DataFrame, k: int, percent: int, bits: int, fps: np.ndarray, logs: np.ndarray) -> DataFrame:
    """Blobs of (token, document, level, place among the hot tokens) by token range."""
    shift = U64(64 - bits - FP_BITS)
    known = docs.sparkSession.sparkContext.broadcast((fps, logs))
    kinds = (U64, np.uint16, np.uint8, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, logs = known.value
        rows: list[list[np.ndarray]] = [[], [], [], []]
        own_rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(x) for x in rows]
            order = np.argsort(cols[0])
            cols = [x[order] for x in cols]
            own = [np.array(x, t) for x, t in zip(zip(*own_rows, strict=True), (U64, np.uint32, np.uint8, np.uint32), strict=True)]
            ids, at = _blobs(cols[0], bits)
            blobs: list[list] = [[] for _ in range(8)]
            for i in range(len(ids)):
                t, d, lev, hot = (x[at[i] : at[i + 1]] for x in cols)
                here, idx = np.unique(d, return_inverse=True)
                for c, x in zip(blobs, (t, idx.astype(kinds[1]), lev, hot, *(x[here] for x in own)), strict=True):
                    c.append(x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c, pa.binary()) for c in blobs)], names=["r", "tok", "doc", "lev", "hot", "node", "size", "ell", "cold"])

        for b in batches:
            for _, _, buf, off in K.text_chunks(b.column(0)):
                sets = [s for s in K.shingle_sets(buf, off, k) if len(s)]
                if not sets:
                    continue
                allt = np.concatenate(sets)
                rank = np.zeros(len(allt), np.uint8)
                if len(fps):
                    f = allt >> shift
                    p = np.minimum(np.searchsorted(fps, f), len(fps) - 1)
                    rank = np.where(fps[p] == f, logs[p], 0).astype(np.uint8)
                at = 0
                for s in sets:
                    n = len(s)
                    r = rank[at : at + n]
                    at += n
                    order = np.argsort(r, kind="stable")
                    most = n - -(-percent * n // 100)
                    ell = choose_level(2.0 ** r[order[: most + LEVELS]].astype(float), n, most)
                    take = order[: most + ell]
                    place = np.arange(1, len(take) + 1)
                    cold = int(np.searchsorted(r[take], COLD))
                    for c, x in zip(rows, (s[take], np.full(len(take), len(own_rows), np.uint16), np.maximum(1, place - most).astype(np.uint8), np.clip(place - cold, 0, 255).astype(np.uint8)), strict=True):
                        c.append(x)
                    own_rows.append((set_node(s), n, ell, cold))
                    held += len(take)
                    if held >= FLUSH or len(own_rows) >= 60_000:
                        yield flush()
                        rows, own_rows, held = [[], [], [], []], [], 0
        if held:
            yield flush()

    names = ("tok", "doc", "lev", "hot", "node", "size", "ell", "cold")
    return docs.select("text").mapInArrow(run, "r long, " + ", ".join(f"{n} binary" for n in names))


def _size_ok(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _bound(na: np.ndarray, nb: np.ndarray, la: np.ndarray, lb: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens of the prefixes two similar sets share at least.

    Behind the prefix that ends first in the order, at most the rest of its own
    set is shared; all that is shared before stands in both prefixes.
    """
    na, nb, la, lb = (x.astype(np.int64) for x in (na, nb, la, lb))
    both = -(-percent * (na + nb) // (100 + percent))
    rest = [-(-percent * n // 100) - k for n, k in ((na, la), (nb, lb))]
    return both - np.maximum(*rest)


def _cold_bound(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens that aren't hot must be shared by the prefixes of two similar sets.

    If both prefixes reach hot tokens, all shared tokens are hot ones or these.
    """
    bound = _bound(c["size"][i], c["size"][j], c["ell"][i], c["ell"][j], percent)
    hot = c["size"] - c["cold"]
    both = -(-percent * (c["size"][i] + c["size"][j]) // (100 + percent))
    return np.where((c["hots"][i] > 0) & (c["hots"][j] > 0), both - np.minimum(hot[i], hot[j]), bound)


def bucket_rows(blobs: DataFrame, percent: int) -> DataFrame:
    """Rows of three kinds from each token range.

    ``pair``: a and b share c prefix tokens of short lists that aren't hot, ``low``
    of them within the prefixes of their smaller l; a link needs ``need`` and
    ``bound`` of them at least;
    ``star``: b and the pivot a of a long list, with c shared tokens;
    ``post``: a long list's entry (token c, node a, its level ``low`` and place
    ``hot`` among the node's hot tokens, 0 if it isn't one, and the node's size, l
    and ``cold``, the number of its other prefix tokens).
    """
    kinds = {"tok": U64, "doc": np.uint16, "lev": np.uint8, "hot": np.uint8}
    own_kinds = {"node": U64, "size": np.uint32, "ell": np.uint8, "cold": np.uint32}
    names = ("kind", "a", "b", "c", "low", "need", "bound", "size", "ell", "cold", "hot")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        held: dict[str, list[np.ndarray]] = {n: [] for n in ("tok", "lev", "hot", *own_kinds)}
        for x in t.to_pylist():
            own = {n: np.frombuffer(x[n], k) for n, k in own_kinds.items()}
            row = {n: np.frombuffer(x[n], k) for n, k in kinds.items()}
            for n in held:
                held[n].append(row[n] if n in row else own[n][row["doc"]])
        c = {n: np.concatenate(held.pop(n)) for n in list(held)}
        # Only lists of two entries or more can link anything.
        order = np.argsort(c["tok"])
        s = c["tok"][order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        some = same.copy()
        some[:-1] |= same[1:]
        c = {n: x[order[some]] for n, x in c.items()}
        order = np.lexsort((c["node"], c["tok"]))
        c = {n: x[order] for n, x in c.items()}
        new = np.ones(len(order), bool)
        new[1:] = (c["tok"][1:] != c["tok"][:-1]) | (c["node"][1:] != c["node"][:-1])
        c = {n: x[new] if n in ("tok", "node") else x[new].astype(np.int64) for n, x in c.items()}
        c["hots"] = c["size"] - -(-percent * c["size"] // 100) + c["ell"] - c["cold"]
        tok, node = c["tok"], _ids(c["node"])
        first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1]))) if len(tok) else np.zeros(0, int)
        length = np.diff(np.append(first, len(tok)))
        of = np.repeat(np.arange(len(first)), length)
        m = length[of] if len(tok) else length
        out, got = [], []
        short = np.flatnonzero((m > 1) & (m <= SMALL) & (c["hot"] == 0))
        for gap in range(1, SMALL):
            i = short[short + gap < len(tok)]
            i = i[of[i] == of[i + gap]]
            j = i + gap
            ok = _size_ok(c["size"][i], c["size"][j], percent)
            i, j = i[ok], j[ok]
            low = np.minimum(c["ell"][i], c["ell"][j])
            got.append((node[i], node[j], (c["lev"][i] <= low) & (c["lev"][j] <= low), low - np.minimum(c["hots"][i], c["hots"][j]), _cold_bound(c, i, j, percent)))
        if sum(len(x[0]) for x in got):
            p = pd.DataFrame(dict(zip(("a", "b", "low", "need", "bound"), (np.concatenate(x).astype(np.int64) for x in zip(*got, strict=True)), strict=True)))
            out.append(p.groupby(["a", "b"], as_index=False).agg(c=("low", "size"), low=("low", "sum"), need=("need", "first"), bound=("bound", "first")).assign(kind="pair"))
        long = np.flatnonzero((m > 1) & ((m > SMALL) | (c["hot"] > 0)))
        if len(long):
            band = np.floor(np.log(c["size"][long]) / np.log(100 / percent)).astype(np.int64)
            # The pivot has the fewest tokens of its own, so it is near the text that the others come from.
            q = pd.DataFrame({"t": tok[long], "band": band, "cold": c["cold"][long], "b": node[long]}).sort_values(["cold", "b"])
            q["a"] = q.groupby(["t", "band"])["b"].transform("first")
            out.append(q[q["a"] != q["b"]].groupby(["a", "b"]).size().reset_index(name="c").assign(kind="star"))
            out.append(pd.DataFrame({"kind": "post", "a": node[long], "c": _ids(tok[long]), "low": c["lev"][long]} | {n: c[n][long] for n in ("size", "ell", "cold", "hot")}))
        kind = {n: pa.string() if n == "kind" else pa.int64() for n in names}
        return pa.concat_tables([pa.table({n: pa.array(d[n], kind[n]) if n in d else pa.nulls(len(d), kind[n]) for n in names}) for d in out] or [pa.table({n: pa.array([], kind[n]) for n in names})])

    return blobs.groupBy("r").applyInArrow(run, "kind string, " + ", ".join(f"{n} long" for n in names[1:]))


def _block_pairs(of: np.ndarray, probe: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of probe rows i and stored rows j of equal ``of`` (sorted), some millions at a time."""
    i, j = np.flatnonzero(probe), np.flatnonzero(~probe)
    lo, hi = np.searchsorted(of[j], of[i], "left"), np.searchsorted(of[j], of[i], "right")
    n = np.cumsum(hi - lo)
    at = 0
    while at < len(i):
        end = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + most, "right")))
        count = (hi - lo)[at:end]
        k = np.repeat(np.arange(at, end), count)
        yield i[k], j[lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)]
        at = end


def long_list_pairs(post: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may be similar, from long lists.

    ``post``: rows of kind ``post`` with token, node and comp. The nodes of a
    list's main component are stored in blocks; the others are stored and compared
    with all, so that a component's own pairs are never formed. Rows: a, b, hot,
    c, low, need and bound; with ``hot`` the pair has no need of other tokens, else
    c, low, need and bound are as those of ``bucket_rows``.
    """
    size_of = post.groupBy("token", "comp").agg(F.count("*").alias("n"))
    main = size_of.groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    main = main.where("n > most").select("token", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("lots"))
    at = post.join(main, "token").withColumn("x", F.xxhash64("node", F.lit(1)))
    probe = F.struct(F.lit(True).alias("probe"), F.sequence(F.lit(0), F.col("blocks") - 1).alias("s"), F.array(F.pmod("x", "lots").cast("int")).alias("q"))
    store = F.struct(F.lit(False).alias("probe"), F.array(F.pmod("x", "blocks").cast("int")).alias("s"), F.sequence(F.lit(0), F.col("lots") - 1).alias("q"))
    at = at.select("*", F.explode(F.when(F.col("comp") == F.col("main"), F.array(store)).otherwise(F.array(store, probe))).alias("as"))
    at = at.select("*", F.explode("as.s").alias("s")).select("*", F.explode("as.q").alias("q"))
    groups = max(64, int(post.count() // GROUP))
    at = at.select("token", "node", "comp", "main", "size", "low", "ell", "cold", "hot", "s", "q", F.col("as.probe").alias("probe"), F.pmod(F.xxhash64("token", "s", "q"), F.lit(groups)).alias("g"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        c = {n: t.column(n).to_numpy() for n in t.column_names if n != "probe"}
        probe = t.column("probe").to_numpy().astype(bool)
        order = np.lexsort((c["q"], c["s"], c["token"]))
        c, probe = {n: x[order] for n, x in c.items()}, probe[order]
        c["hots"] = c["size"] - -(-percent * c["size"] // 100) + c["ell"] - c["cold"]
        new = np.ones(len(probe), bool)
        new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["s"][1:] != c["s"][:-1]) | (c["q"][1:] != c["q"][:-1])
        of = np.cumsum(new)
        spare = c["size"] - c["cold"] - c["hot"] + 1  # hot tokens from this one on
        held = []
        for i, j in _block_pairs(of, probe):
            ok = (c["comp"][i] != c["comp"][j]) & ((c["comp"][j] == c["main"][j]) | (c["node"][i] < c["node"][j])) & _size_ok(c["size"][i], c["size"][j], percent)
            i, j = i[ok], j[ok]
            both = -(-percent * (c["size"][i] + c["size"][j]) // (100 + percent))
            hot = c["hot"][i] > 0
            ok = ~hot | (np.minimum(spare[i], spare[j]) >= both)
            i, j, hot = i[ok], j[ok], hot[ok]
            low = np.minimum(c["ell"][i], c["ell"][j])
            held.append(pd.DataFrame({"a": np.minimum(c["node"][i], c["node"][j]), "b": np.maximum(c["node"][i], c["node"][j]), "hot": hot, "c": 1, "low": ((c["low"][i] <= low) & (c["low"][j] <= low)).astype(np.int64), "need": low - np.minimum(c["hots"][i], c["hots"][j]), "bound": _cold_bound(c, i, j, percent)}))
            held = [pd.concat(held).groupby(["a", "b", "hot", "need", "bound"], as_index=False).sum()]
        names = {"a": pa.int64(), "b": pa.int64(), "hot": pa.bool_(), "c": pa.int64(), "low": pa.int64(), "need": pa.int64(), "bound": pa.int64()}
        return pa.table({n: pa.array(held[0][n] if held else [], k) for n, k in names.items()})

    return at.groupBy("g").applyInArrow(run, "a long, b long, hot boolean, c long, low long, need long, bound long")


def linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets are similar enough, with the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}

        def tokens(node: int, text: str) -> np.ndarray:
            if node not in last:
                if len(last) >= 64:
                    last.clear()
                (_, _, buf, off) = next(iter(K.text_chunks(pa.array([text]))))
                last[node] = K.shingle_sets(buf, off, k)[0]
            return last[node]

        for b in batches:
            keep, sim = [], []
            for x, y, s, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                p, q = tokens(x, s), tokens(y, t)
                both = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - both
                if 100 * both >= percent * union:
                    keep.append((x, y))
                    sim.append(both / union)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.int64()), pa.array([y for _, y in keep], pa.int64()), pa.array(sim, pa.float64())], names=["a", "b", "jaccard"])

    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long, jaccard double")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Link documents whose k-word shingle sets have 100 * |A and B| >= percent * |A or B|.

    Returns one row per row of ``docs``: doc_id, n_shingles (size of its set)
    and component_id (the smallest doc_id reachable by links, itself included).

    A null or empty text, or one without words, has an empty set and links with
    nothing. A text of fewer than k words is one shingle. Texts are taken whole.
    Repeated rows and equal texts link with each other, also rows of one doc_id
    with different texts, each by its own text. A null doc_id is no smallest one:
    such a row has the component_id of the rows that it links with, or null.
    An empty table gives no rows; other columns are ignored.
    """
    of = grouped(docs, k, percent)
    smallest = of.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return of.join(smallest, "comp", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_hash, n_shingles, comp (the same for all that are linked, null without words)."""
    spark = docs.sparkSession
    small_batches(spark)
    sets = saved(document_sets(docs, k), "sets")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    bits = min(20, max(4, int(np.ceil(np.log2(max(1, total / RANGE))))))
    fps, logs = frequent_tokens(docs, k, bits)
    rows = saved(bucket_rows(postings(docs, k, percent, bits, fps, logs), percent), "buckets")
    pairs = rows.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("c").alias("c"), F.sum("low").alias("low"), F.max("need").alias("need"), F.max("bound").alias("bound"))
    pairs = saved(pairs, "pairs")
    star = rows.where("kind = 'star'").groupBy("a", "b").agg(F.sum("c").alias("c"))
    post = rows.where("kind = 'post'").select(F.col("c").alias("token"), F.col("a").alias("node"), "low", "size", "ell", "cold", "hot")
    enough = "low >= need and c >= bound"

    # One text for each node that any pair may need.
    wanted = pairs.where(f"{enough}").select(F.explode(F.array("a", "b")).alias("node")).union(post.select("node")).distinct()
    heads = sets.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("head")).join(wanted, "node")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = hashed.join(heads, hashed["doc_id"].eqNullSafe(heads["head.doc_id"]) & (hashed["text_hash"] == heads["head.text_hash"])).groupBy("node").agg(F.first("text").alias("text"))
    texts = saved(texts, "texts")

    # First the likeliest partner of each node, then all pairs between components.
    first = pairs.where(enough).select("a", "b", "c").union(star)
    best = first.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
    links = saved(linked(best, texts, k, percent), "links")
    comp = components(links)
    post = saved(post.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "post")
    dropped(rows)
    across = saved(long_list_pairs(post, percent), "across")
    cold = pairs.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    cold = cold.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "c", "low", "need", "bound")
    cold = cold.unionByName(across.where("not hot").drop("hot")).groupBy("a", "b").agg(F.sum("c").alias("c"), F.sum("low").alias("low"), F.max("need").alias("need"), F.max("bound").alias("bound")).where(enough)
    # Of pairs by hot tokens the prefixes are compared.
    hot = across.where("hot").select("a", "b").distinct()
    prefix = post.where("hot > 0").groupBy("node").agg(F.first("size").alias("n"), F.first("ell").alias("l"), F.collect_list(F.struct("token", "low")).alias("t"))
    for i in "ab":
        hot = hot.join(prefix.select(F.col("node").alias(i), F.col("n").alias(f"n{i}"), F.col("l").alias(f"l{i}"), F.col("t").alias(f"t{i}")), i)
    low = F.least("la", "lb")
    ends = [F.transform(F.filter(F.col(f"t{i}"), lambda x: x["low"] <= F.least("la", "lb")), lambda x: x["token"]) for i in "ab"]
    rests = [F.ceil(percent * F.col(f"n{i}") / 100) - F.col(f"l{i}") for i in "ab"]
    bound = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent)) - F.greatest(*rests)
    hot = hot.where((F.size(F.array_intersect(*ends)) >= low) & (F.size(F.array_intersect("ta.token", "tb.token")) >= bound))
    rest = cold.select("a", "b").union(hot.select("a", "b")).distinct()
    more = saved(linked(rest, texts, k, percent), "links")
    dropped(texts, pairs, post, across)
    # Components of components: few edges are left.
    of_a, of_b = (comp.select(F.col("node").alias(i), F.col("comp").alias(f"c{i}")) for i in "ab")
    edges = more.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(edges)
    nodes = comp.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp, "node", "left_anti").withColumn("comp", F.col("node")))
    comp = nodes.join(over.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))

    return sets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id, all its columns.

    Documents without words are linked with nothing and stay. Of equal rows (doc_id and text)
    one stays, and of different texts of one doc_id that are linked one does. Rows where
    doc_id is null can't be told apart, so they all stay.
    """
    of = grouped(docs, k, percent).where("doc_id is not null")
    heads = of.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "text_hash")).alias("head")).select("head.doc_id", "head.text_hash")
    heads = heads.union(of.where("comp is null").select("doc_id", "text_hash"))
    again = repeated_ids(docs)
    known, names = docs.where("doc_id is not null"), docs.columns
    mark = unused("text_hash", names)
    kept = known.withColumn(mark, F.xxhash64("text")).join(heads.withColumnRenamed("text_hash", mark), ["doc_id", mark], "left_semi").select(names)
    if again is not None:
        shared = kept.join(again, "doc_id", "left_semi").select(names).dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, "doc_id", "left_anti").select(names).union(shared)
    return kept.union(docs.where("doc_id is null"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents: five words, similarity 0.75."""
    return jaccard_join(table(spark, sf_dir, "documents"))
