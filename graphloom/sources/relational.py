"""Views of relational tables as graphs, histories, snapshots and search entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.graph import Graph
from graphloom.plans.tables import shards, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def part_file() -> Column:
    return F.concat_ws("", "p_type", F.lit("/"), "p_brand", F.lit("/"), "p_name", F.lit("#"), F.col("p_partkey").cast("string"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions contain nations, which contain suppliers and customers; orders and parts hang below."""

    def t(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    def nodes(name: str, prefix: str, id_: str, kind: str, label: Column, file: Column, package: Column) -> DataFrame:
        return t(name).select(
            key(prefix, id_).alias("id"), F.lit(kind).alias("type"), label.alias("name"), file.alias("file"), package.alias("package")
        )

    none = F.lit(None).cast("string")
    all_nodes = [
        nodes("region", "region", "r_regionkey", "Workspace", F.col("r_name"), none, none),
        nodes("nation", "nation", "n_nationkey", "Package", F.col("n_name"), none, key("region", "n_regionkey")),
        nodes("supplier", "supplier", "s_suppkey", "Service", F.col("s_name"), none, key("nation", "s_nationkey")),
        nodes("customer", "customer", "c_custkey", "Controller", F.col("c_name"), none, key("nation", "c_nationkey")),
        nodes("orders", "orders", "o_orderkey", "Route", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), none, none),
        nodes("part", "part", "p_partkey", "Function", F.col("p_name"), part_file(), F.col("p_brand")),
    ]

    def edges(df: DataFrame, kind: str, src: Column, dst: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))

    line = t("lineitem")
    n = shards(line)

    def pairs(a: str, b: str) -> DataFrame:
        """Distinct keys of line items: as numbers, which are a third of the edges' texts."""
        return spread(line.select(a, b), n, a, b).distinct()

    tree = [
        edges(t("nation"), "CONTAINS", key("region", "n_regionkey"), key("nation", "n_nationkey")),
        edges(t("supplier"), "CONTAINS", key("nation", "s_nationkey"), key("supplier", "s_suppkey")),
        edges(t("customer"), "CONTAINS", key("nation", "c_nationkey"), key("customer", "c_custkey")),
        edges(t("orders"), "MOUNTS", key("customer", "o_custkey"), key("orders", "o_orderkey")),
    ]

    def all_edges(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
        handled = edges(orders, "HANDLES", key("orders", "l_orderkey"), key("part", "l_partkey"))
        provided = edges(suppliers, "PROVIDES", key("supplier", "l_suppkey"), key("part", "l_partkey"))
        return reduce(DataFrame.unionByName, [*tree, handled, provided])

    unique = all_edges(pairs("l_orderkey", "l_partkey"), pairs("l_suppkey", "l_partkey"))
    return Graph(reduce(DataFrame.unionByName, all_nodes), unique, all_edges(line, line))


NODES_SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Workspace' AS type, r_name AS name, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS package FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Package', n_name, NULL, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Service', s_name, NULL, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'Controller', c_name, NULL, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'orders:' || o_orderkey, 'Route', 'order ' || o_orderkey, NULL, NULL FROM orders
  UNION ALL SELECT 'part:' || p_partkey, 'Function', p_name, p_type || '/' || p_brand || '/' || p_name || '#' || p_partkey, p_brand FROM part)
"""
EDGES_SQL = """
edges AS (
  SELECT 'CONTAINS' AS type, 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'CONTAINS', 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'CONTAINS', 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'MOUNTS', 'customer:' || o_custkey, 'orders:' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'HANDLES', 'orders:' || l_orderkey, 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'PROVIDES', 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem)
"""


def order_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Each order CALLS the same customer's next order by date and key: a DAG of chains."""
    orders = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    linked = orders.select("o_orderkey", F.lead("o_orderkey").over(w).alias("next"))
    none = F.lit(None).cast("string")
    nodes = orders.select(
        key("orders", "o_orderkey").alias("id"), F.lit("Function").alias("type"), F.col("o_orderpriority").alias("name"), none.alias("file"), none.alias("package")
    )
    return Graph(nodes, linked.where("next IS NOT NULL").select(F.lit("CALLS").alias("type"), key("orders", "o_orderkey").alias("src"), key("orders", "next").alias("dst")))


def event_cycle(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types, joined where one follows the other for some user."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = events.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    none = F.lit(None).cast("string")
    nodes = events.select(F.col("event_type").alias("id")).distinct().select("id", F.lit("Function").alias("type"), F.col("id").alias("name"), none.alias("file"), none.alias("package"))
    return Graph(nodes, pairs.where("dst IS NOT NULL").distinct().select(F.lit("CALLS").alias("type"), "src", "dst"))


def turn_forest(spark: SparkSession, sf_dir: str) -> Graph:
    """Each turn IMPORTS the next of its conversation."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    id_ = F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    t = turns.select(id_.alias("id"), F.lead(id_).over(w).alias("next"), "role", F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("package"))
    nodes = t.select("id", F.lit("Module").alias("type"), F.col("role").alias("name"), F.lit(None).cast("string").alias("file"), "package")
    return Graph(nodes, t.where("next IS NOT NULL").select(F.lit("IMPORTS").alias("type"), F.col("id").alias("src"), F.col("next").alias("dst")))


TURNS_SQL = """
turns AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY conv_id, turn),
turn_nodes AS (SELECT 'turn:' || conv_id || ':' || lpad(CAST(turn AS VARCHAR), 4, '0') AS id, conv_id, turn, role,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM turns)
"""


def history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as commits (by customer), their parts as changed files."""
    commits = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderdate").alias("authored_at"),
        F.col("o_custkey").cast("string").alias("author"), F.col("o_orderpriority").alias("subject"),
    )
    files = table(spark, sf_dir, "part").select("p_partkey", part_file().alias("file"))
    line = table(spark, sf_dir, "lineitem")
    # by part alone, so that the join with parts needs no other shuffle
    line = spread(line.select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber"), shards(line), "l_partkey")
    sums = line.groupBy("l_orderkey", "l_partkey").agg(
        F.sum("l_quantity").cast("long").alias("additions"), F.sum("l_linenumber").cast("long").alias("deletions")
    )
    changes = sums.join(files, sums["l_partkey"] == files["p_partkey"]).select(
        F.col("l_orderkey").cast("string").alias("hash"), "file", "additions", "deletions"
    )
    return commits, changes


HISTORY_SQL = """
commits AS (SELECT CAST(o_orderkey AS VARCHAR) AS hash, o_orderdate AS authored_at, CAST(o_custkey AS VARCHAR) AS author,
  o_orderpriority AS subject FROM orders),
changes AS (SELECT CAST(l_orderkey AS VARCHAR) AS hash, p_type || '/' || p_brand || '/' || p_name || '#' || p_partkey AS file,
  CAST(sum(l_quantity) AS BIGINT) AS additions, CAST(sum(l_linenumber) AS BIGINT) AS deletions
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_type, p_brand, p_name, p_partkey)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as they were sold before 1998, and since: id, type, name, file, package, metadata."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", (F.year("l_shipdate") >= 1998).alias("late"))
    parts = table(spark, sf_dir, "part")

    def side(late: bool) -> DataFrame:
        sold = lines.where(F.col("late") == late).groupBy("l_partkey").agg(F.max("l_quantity").cast("long").alias("most"))
        return sold.join(parts, sold["l_partkey"] == parts["p_partkey"]).select(
            key("part", "p_partkey").alias("id"), F.lit("Function").alias("type"), F.col("p_name").alias("name"),
            part_file().alias("file"), F.col("p_brand").alias("package"), F.col("most").cast("string").alias("metadata"),
        )

    return side(False), side(True)


SNAPSHOTS_SQL = """
sold AS (SELECT l_partkey, year(l_shipdate) >= 1998 AS late, CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) AS most FROM lineitem GROUP BY 1, 2),
side AS (SELECT late, 'part:' || p_partkey AS id, 'Function' AS type, p_name AS name,
  p_type || '/' || p_brand || '/' || p_name || '#' || p_partkey AS file, p_brand AS package, most AS metadata
  FROM sold JOIN part ON l_partkey = p_partkey),
base AS (SELECT * FROM side WHERE NOT late), head AS (SELECT * FROM side WHERE late)
"""
