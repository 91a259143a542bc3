"""Grid-risk inputs as projections of the order tables.

An order is a split, a line item one of its components; customers and suppliers
place load and supply on 25 nodes (nations); events are dispatch by carrier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = 25
#: Inertia constants in seconds by carrier (event type).
INERTIA = {"click": 5.9, "view": 4.2, "purchase": 3.7, "signup": 0.0, "error": 0.0}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of splits with load, imbalance and rotational energy."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
    key = Window.partitionBy("l_orderkey")
    h = F.when(F.col("l_returnflag") == "A", 4.2).when(F.col("l_returnflag") == "R", 5.9).otherwise(0.0)
    parts = li.select("*", (F.row_number().over(key.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")) - 1).alias("component_number"), (F.col("l_extendedprice") / F.sum("l_extendedprice").over(key)).alias("load_share"))
    return parts.join(o, parts.l_orderkey == o.o_orderkey).select(
        ((F.col("o_custkey") % 8).cast("double") / 10.0).alias("co2l"),
        F.col("o_orderdate").alias("time_stamp"),
        F.col("o_orderkey").alias("split_number"),
        "component_number",
        (F.col("o_orderkey") % 50).cast("int").alias("init_failure_0"),
        (F.col("o_custkey") % 50).cast("int").alias("init_failure_1"),
        (1 + F.col("o_orderkey") % 3).cast("int").alias("trigger_weighting"),
        F.lit(3).alias("snapshot_weighting"),
        F.col("l_extendedprice").alias("load"),
        "load_share",
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("power_imbalance"),
        (F.col("l_quantity") * h).alias("rot_energy_gen"),
        (F.col("l_suppkey") % NODES).cast("int").alias("node_idx"),
    )


def member_nodes(c: DataFrame) -> DataFrame:
    """Components with the nodes that belong to them: up to three each."""
    n = [F.col("node_idx"), (F.col("node_idx") + F.col("component_number") + 1) % NODES, (F.col("split_number") + F.col("component_number")) % NODES]
    return c.withColumn("members", F.array_distinct(F.array(*(x.cast("int") for x in n))))


def study_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-hourly snapshots: the days of orders, each with the hours that its orders fall into."""
    return read(spark, sf_dir, "orders").select((F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=((F.col("o_orderkey") % 8) * 3).cast("int"))).alias("snapshot")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 edges of the ring with chords over the nations, in order of their ends."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("i"))
    pairs = n.select("i", F.explode(F.array(F.pmod(F.col("i") + 1, F.lit(NODES)), F.pmod(F.col("i") + 5, F.lit(NODES)))).alias("j")).select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"))
    idx = (F.row_number().over(Window.orderBy("u", "v")) - 1).alias("edge_idx")  # one row for each edge of one grid
    return pairs.select("u", "v", idx).select("edge_idx", "u", "v", (1 + (F.col("edge_idx") * 7 % 13) / 10).alias("weight"), (400.0 + 50 * (F.col("edge_idx") % 9)).alias("s_nom"), F.element_at(F.array(*map(F.lit, (1.0, 2.0, 0.57894737, 1.28947368, 3.0))), (F.col("edge_idx") % 5 + 1).cast("int")).alias("num_parallel"))


def edges_with_pendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's edges and five more, 50 to 54, to pendant nodes 25 to 29: these are its bridges."""
    more = spark.range(5).select((50 + F.col("id")).cast("int").alias("edge_idx"), (5 * F.col("id")).cast("int").alias("u"), (25 + F.col("id")).cast("int").alias("v"), F.lit(1.0).alias("weight"), F.lit(400.0).alias("s_nom"), F.lit(1.0).alias("num_parallel"))
    return edges(spark, sf_dir).unionByName(more)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario and time of all splits with the weight of their snapshots."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    has = read(spark, sf_dir, "lineitem").select("l_orderkey")
    return o.join(has, o.o_orderkey == has.l_orderkey, "left_semi").select(((F.col("o_custkey") % 8).cast("double") / 10.0).alias("co2l"), F.col("o_orderdate").alias("time_stamp"), F.lit(3).alias("snapshot_weighting")).distinct()


def generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power by snapshot (3 h), bus and carrier, with sign and nominal power."""
    e = read(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    snap = F.window("ts", "3 hours").start.cast("timestamp_ntz")
    g = e.groupBy(snap.alias("snapshot"), (F.col("user_id") % NODES).cast("int").alias("bus"), F.col("event_type").alias("carrier")).agg(F.sum("value").alias("p"))
    nom = F.max("p").over(Window.partitionBy("bus", "carrier")) * 1.2
    return g.select("*", nom.alias("p_nom"), F.when(F.col("carrier") == "error", -1).otherwise(1).alias("sign"), F.lit(3).alias("w"))


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly load of each node."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == F.col("c_custkey")).groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("snapshot"), F.col("c_nationkey").alias("bus")).agg(F.sum("o_totalprice").alias("p"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly supply of each node."""
    li, s, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier"), read(spark, sf_dir, "orders")
    j = li.select("l_orderkey", "l_suppkey", "l_extendedprice").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("snapshot"), F.col("s_nationkey").alias("bus")).agg(F.sum("l_extendedprice").alias("p"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between supplier and customer nations."""
    li, s, o, c = (read(spark, sf_dir, x) for x in ("lineitem", "supplier", "orders", "customer"))
    j = li.select("l_orderkey", "l_suppkey", "l_extendedprice").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("s_nationkey").alias("bus0"), F.col("c_nationkey").alias("bus1")).agg(F.sum("l_extendedprice").alias("p0")).withColumn("p1", -F.col("p0"))


def dated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between supplier and customer nations by scenario and month, with the distance of their places in rows of five."""
    li, s, o, c = (read(spark, sf_dir, x) for x in ("lineitem", "supplier", "orders", "customer"))
    j = li.select("l_orderkey", "l_suppkey", "l_extendedprice").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    sums = j.groupBy(((F.col("o_custkey") % 8).cast("double") / 10.0).alias("co2l"), month.alias("snapshot"), F.col("s_nationkey").alias("bus0"), F.col("c_nationkey").alias("bus1")).agg(F.sum("l_extendedprice").alias("p0"))
    far = F.pow(F.col("bus0") % 5 - F.col("bus1") % 5, F.lit(2)) + F.pow(F.floor(F.col("bus0") / 5) - F.floor(F.col("bus1") / 5), F.lit(2))
    return sums.withColumn("length", F.sqrt(far))


def injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly balance of each node, supply less load, less the mean over nodes."""
    both = supply(spark, sf_dir).unionByName(loads(spark, sf_dir).withColumn("p", -F.col("p"))).groupBy("snapshot", "bus").agg(F.sum("p").alias("p"))
    spine = both.select("snapshot").distinct().join(F.broadcast(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("bus"))))
    full = spine.join(both, ["snapshot", "bus"], "left").fillna(0.0, ["p"])
    return full.select("snapshot", F.col("bus").alias("node_idx"), (F.col("p") - F.avg("p").over(Window.partitionBy("snapshot"))).alias("p0"))


def ternary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of classes -1, 0, 1 with labels and weights."""
    e = read(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: F.when(x > 0.15, 1).when(x < -0.15, -1).otherwise(0))
    return e.select("vec_id", "label", (1 + F.col("vec_id") % 4).cast("int").alias("w"), v.alias("v"), "embedding")


def loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC and DC loading of lines by snapshot and seed."""
    li = read(spark, sf_dir, "lineitem")
    dc = F.col("l_extendedprice") / 100000.0
    return li.select(F.col("l_suppkey").alias("line"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("snapshot"), F.col("l_linenumber").alias("seed"), dc.alias("dc"), F.sqrt(dc * dc + F.col("l_tax") * F.col("l_tax")).alias("ac"))


_H = "CASE l_returnflag WHEN 'A' THEN 4.2e0 WHEN 'R' THEN 5.9e0 ELSE 0e0 END"
#: The projections as SQL, for the other engine.
SQL = {
    "comp": f"""SELECT cast(o_custkey % 8 AS DOUBLE)/10e0 AS co2l, o_orderdate AS time_stamp, o_orderkey AS split_number,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) - 1 AS component_number,
  (o_orderkey % 50)::INT AS init_failure_0, (o_custkey % 50)::INT AS init_failure_1, (1 + o_orderkey % 3)::INT AS trigger_weighting, 3 AS snapshot_weighting,
  l_extendedprice AS load, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS load_share,
  l_extendedprice*(l_discount-0.05e0) AS power_imbalance, l_quantity*{_H} AS rot_energy_gen, (l_suppkey % 25)::INT AS node_idx
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "edge": """SELECT row_number() OVER (ORDER BY u, v) - 1 AS edge_idx, u, v FROM (
  SELECT least(n_nationkey, (n_nationkey + d) % 25) AS u, greatest(n_nationkey, (n_nationkey + d) % 25) AS v FROM nation, (VALUES (1), (5)) t(d))""",
    "gen": """SELECT *, max(p) OVER (PARTITION BY bus, carrier) * 1.2e0 AS p_nom, CASE WHEN carrier = 'error' THEN -1 ELSE 1 END AS sign, 3 AS w FROM (
  SELECT time_bucket(INTERVAL 3 HOUR, ts) AS snapshot, (user_id % 25)::INT AS bus, event_type AS carrier, sum(value) AS p FROM events GROUP BY 1, 2, 3)""",
    "loads": "SELECT date_trunc('month', o_orderdate) AS snapshot, c_nationkey AS bus, sum(o_totalprice) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "supply": "SELECT date_trunc('month', o_orderdate) AS snapshot, s_nationkey AS bus, sum(l_extendedprice) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "links": "SELECT s_nationkey AS bus0, c_nationkey AS bus1, sum(l_extendedprice) AS p0, -sum(l_extendedprice) AS p1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "dlinks": """SELECT *, sqrt(power(bus0 % 5 - bus1 % 5, 2) + power(floor(bus0/5e0) - floor(bus1/5e0), 2)) AS length FROM (
  SELECT cast(o_custkey % 8 AS DOUBLE)/10e0 AS co2l, date_trunc('month', o_orderdate)::TIMESTAMP AS snapshot, s_nationkey AS bus0, c_nationkey AS bus1, sum(l_extendedprice) AS p0
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)""",
    "inj": """SELECT snapshot, bus AS node_idx, p - avg(p) OVER (PARTITION BY snapshot) AS p0 FROM (
  SELECT s.snapshot, n_nationkey AS bus, coalesce(sum(b.p), 0) AS p FROM (SELECT DISTINCT snapshot FROM (SELECT snapshot FROM supply UNION SELECT snapshot FROM loads)) s CROSS JOIN nation
  LEFT JOIN (SELECT * FROM supply UNION ALL SELECT snapshot, bus, -p FROM loads) b ON b.snapshot = s.snapshot AND b.bus = n_nationkey GROUP BY 1, 2)""",
    "tern": "SELECT vec_id, label, (1 + vec_id % 4)::INT AS w, list_transform(embedding, lambda x: CASE WHEN x > 0.15 THEN 1 WHEN x < -0.15 THEN -1 ELSE 0 END) AS v, embedding FROM embeddings",
    "loading": "SELECT l_suppkey AS line, date_trunc('month', l_shipdate) AS snapshot, l_linenumber AS seed, l_extendedprice/100000e0 AS dc, sqrt(power(l_extendedprice/100000e0, 2) + l_tax*l_tax) AS ac FROM lineitem",
}
_NEEDS = {"inj": ("supply", "loads")}


def with_sql(names: str, body: str) -> str:
    """``body`` behind the projections it names, as common table expressions."""
    want: list[str] = []
    for n in names.split():
        want += [x for x in (*_NEEDS.get(n, ()), n) if x not in want]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in want) + " " + body
