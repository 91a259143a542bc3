"""Communities of many weighted graphs at once, by local moves, refinement and contraction over edge tables.

A move takes a node to a neighbouring community. In each round every node proposes its best
one, every community takes the best proposal that it is part of, and moves that both their
communities take are made. Moves of one round so share no community; their gains
in modularity add up exactly, and the best of all is always among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import connected

#: Gains of modularity count from here on; digits that count in comparisons.
LEAST_GAIN, DIGITS = 1e-9, 12


def symmetric(edges: DataFrame) -> DataFrame:
    """(g, u, v, w) in both directions, parallel edges summed; loops stand once with twice their weight. Edges without a weight above 0 are left out."""
    e = edges.where("w > 0").select("g", "u", "v", "w")
    return e.union(e.select("g", F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("g", "u", "v").agg(F.sum("w").alias("w"))


def _moves(e: DataFrame, state: DataFrame, totals: DataFrame) -> DataFrame:
    """(g, u, was, c): moves of one round. ``state`` has g, u, c, k, within (no move leaves it) and free (whether it may move)."""
    sums = state.groupBy("g", "c").agg(F.sum("k").alias("kc"))
    near = e.where("u <> v").join(state.select("g", F.col("u").alias("v"), F.col("c").alias("to"), F.col("within").alias("near")), ["g", "v"]).join(state.select("g", "u", "within"), ["g", "u"]).where("near = within")
    to = near.groupBy("g", "u", "to").agg(F.sum("w").alias("w"))
    own = state.join(to, ["g", "u"], "left").groupBy("g", "u", "c", "k", "free").agg(F.coalesce(F.sum(F.when(F.col("to") == F.col("c"), F.col("w"))), F.lit(0.0)).alias("stay")).where("free")
    x = own.join(to, ["g", "u"]).where("to <> c").join(totals, "g").join(sums.withColumnRenamed("kc", "ka"), ["g", "c"]).join(sums.select("g", F.col("c").alias("to"), F.col("kc").alias("kb")), ["g", "to"])
    gain = F.round(2 * (F.col("w") - F.col("stay")) / F.col("total") - 2 * F.col("k") * (F.col("kb") - F.col("ka") + F.col("k")) / F.col("total") ** 2, DIGITS)
    best = x.select("g", "u", "c", "to", gain.alias("gain")).where(F.col("gain") > LEAST_GAIN).groupBy("g", "u", "c").agg(F.max(F.struct("gain", (-F.col("to")).alias("less"))).alias("best"))
    move = F.struct(F.col("best.gain").alias("gain"), (-F.col("u")).alias("less"), F.col("c").alias("was"), (-F.col("best.less")).alias("to"))
    moves = best.select("g", move.alias("m"))
    taken = moves.select("g", F.explode(F.array("m.was", "m.to")).alias("c"), "m").groupBy("g", "c").agg(F.max("m").alias("m"))
    return taken.groupBy("g", "m").agg(F.count("*").alias("both")).where("both = 2").select("g", (-F.col("m.less")).alias("u"), F.col("m.to").alias("to"))


def _settled(e: DataFrame, state: DataFrame, totals: DataFrame, saved, merge_only: bool, most_rounds: int = 10_000) -> tuple[DataFrame, bool]:
    """``state`` after rounds of moves until none gains, and whether any was made. ``merge_only``: only nodes that are still alone move, and their target stays."""
    moved = False
    for _ in range(most_rounds):
        moves = saved(_moves(e, state, totals))
        if moves.isEmpty():
            return state, moved
        moved = True
        new = state.join(moves, ["g", "u"], "left")
        free = F.col("free")
        if merge_only:
            joined = moves.select("g", F.col("to").alias("c")).distinct().withColumn("hit", F.lit(True))
            new = new.join(joined, ["g", "c"], "left")
            free = F.col("free") & F.col("to").isNull() & F.col("hit").isNull()
        state = saved(new.select("g", "u", F.coalesce("to", "c").alias("c"), "k", "within", free.alias("free")))
    raise RuntimeError("the communities did not settle")


def _named(state: DataFrame) -> DataFrame:
    """Communities named by their smallest node: (g, u, c)."""
    least = state.groupBy("g", "c").agg(F.min("u").alias("name"))
    return state.join(least, ["g", "c"]).select("g", "u", F.col("name").alias("c"))


def leiden(edges: DataFrame, saved, most_levels: int = 50) -> DataFrame:
    """Communities of each graph g of a table of edges (g, u, v, w): g, node, community (its smallest node).

    Nodes move to neighbouring communities while modularity gains; communities are refined into parts that
    are connected, grown from single nodes within them; parts become the nodes of the next, smaller graph, which starts
    from the communities found. It ends when nothing moves. A community whose nodes hang together no more
    is split, which loses no modularity. Nodes of positive edges are returned; u and v are long.
    """
    base = saved(symmetric(edges))
    e = base
    totals = saved(base.groupBy("g").agg(F.sum("w").alias("total")))
    of = saved(base.select("g", F.col("u").alias("node")).distinct().withColumn("u", F.col("node")))  # the node of each level
    known = of.select("g", "u", F.col("u").alias("c"))
    for _ in range(most_levels):
        strength = e.groupBy("g", "u").agg(F.sum("w").alias("k"))
        state = saved(known.join(strength, ["g", "u"]).select("g", "u", "c", "k", F.lit(0).cast("long").alias("within"), F.lit(True).alias("free")))
        state, moved = _settled(e, state, totals, saved, False)
        found = saved(_named(state))
        if not moved:
            break
        alone = saved(found.join(strength, ["g", "u"]).select("g", "u", F.col("u").alias("c"), "k", F.col("c").alias("within"), F.lit(True).alias("free")))
        parts, merged = _settled(e, alone, totals, saved, True)
        part = saved(_named(parts).withColumnRenamed("c", "p"))
        if not merged:
            known = found
            of = saved(of)
            break
        of = saved(of.join(part, ["g", "u"]).select("g", "node", F.col("p").alias("u")))
        known = saved(found.join(part, ["g", "u"]).groupBy("g", F.col("p").alias("u")).agg(F.min("c").alias("c")))
        a, b = part.select("g", "u", F.col("p").alias("a")), part.select("g", F.col("u").alias("v"), F.col("p").alias("b"))
        e = saved(e.join(a, ["g", "u"]).join(b, ["g", "v"]).groupBy("g", F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")))
    known = found
    at = saved(of.join(known, ["g", "u"]).select("g", "node", "c"))
    return hanging_together(base, at, saved)


def hanging_together(e: DataFrame, at: DataFrame, saved) -> DataFrame:
    """Communities (g, node, c) split into connected ones: g, node, community (its smallest node)."""
    inner = e.where("u <> v").join(at.select("g", F.col("node").alias("u"), F.col("c").alias("a")), ["g", "u"]).join(at.select("g", F.col("node").alias("v"), F.col("c").alias("b")), ["g", "v"]).where("a = b")
    # Nodes of all graphs in one, as (g, node); g first, so that the smallest is that of the smallest node.
    comp = connected(inner.select(F.struct("g", F.col("u").alias("n")).alias("u"), F.struct("g", F.col("v").alias("n")).alias("v")), saved)
    x = at.join(comp.select(F.col("node.g").alias("g"), F.col("node.n").alias("node"), F.col("comp.n").alias("least")), ["g", "node"], "left")
    return x.select("g", "node", F.coalesce("least", "node").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Modularity of a partition (g, node, community) of each graph: g, communities, modularity."""
    e = symmetric(edges)
    at = communities.select("g", F.col("node").alias("u"), F.col("community").alias("a"))
    both = e.join(at, ["g", "u"]).join(at.select("g", F.col("u").alias("v"), F.col("a").alias("b")), ["g", "v"])
    per = both.groupBy("g", "a").agg(F.sum("w").alias("k"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))), F.lit(0.0)).alias("inside"))
    total = per.groupBy("g").agg(F.sum("k").alias("total"))
    return per.join(total, "g").groupBy("g").agg(F.count("*").alias("communities"), F.sum(F.col("inside") / F.col("total") - (F.col("k") / F.col("total")) ** 2).alias("modularity"))
