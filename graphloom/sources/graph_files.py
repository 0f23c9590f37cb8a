"""Graphs in files: JSON documents in, tables and drawings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph

DOCUMENT = (
    "version string, nodes array<struct<id:string,type:string,name:string,file:string,package:string,metadata:string>>,"
    "edges array<struct<id:string,type:string,`from`:string,`to`:string,metadata:string>>,"
    "diagnostics array<struct<id:string,code:string,severity:string,message:string,nodeId:string,edgeId:string>>"
)


def load_json(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """The graph and the diagnostics of one or more JSON documents."""
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    nodes = doc.selectExpr("inline(nodes)")
    edges = doc.selectExpr("inline(edges)").select("type", F.col("from").alias("src"), F.col("to").alias("dst"), "metadata")
    return Graph(nodes, edges), doc.selectExpr("inline(diagnostics)")


def save_tables(graph: Graph, folder: str) -> None:
    """Parquet, partitioned by kind, so that a scan of one kind reads nothing else."""
    graph.nodes.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")


def load_tables(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


def _dot(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def _xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def drawing(graph: Graph, form: str) -> DataFrame:
    """(part, line): the body of a dot, mermaid or graphml document, a row per node and edge."""
    n, e = graph.nodes, graph.edges
    if form == "dot":
        a = F.concat(F.lit("  "), _dot(F.col("id")), F.lit(" [label="), _dot(F.concat_ws("\\n", "type", "name")), F.lit("];"))
        b = F.concat(F.lit("  "), _dot(F.col("src")), F.lit(" -> "), _dot(F.col("dst")), F.lit(" [label="), _dot(F.col("type")), F.lit("];"))
    elif form == "mermaid":
        tidy = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
        a = F.concat(F.lit("  "), tidy(F.col("id")), F.lit('["'), F.replace(F.col("name"), F.lit('"'), F.lit("'")), F.lit('"]'))
        b = F.concat(F.lit("  "), tidy(F.col("src")), F.lit(" -->|"), F.col("type"), F.lit("| "), tidy(F.col("dst")))
    elif form == "graphml":
        a = F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"/>'))
        b = F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"/>'))
    else:
        raise ValueError(f"no form {form}")
    return n.select(F.lit("node").alias("part"), a.alias("line")).union(e.select(F.lit("edge").alias("part"), b.alias("line")))


def summary_line(graph: Graph) -> DataFrame:
    """(what, line): counts of kinds and relations as text."""

    def line(df: DataFrame, what: str) -> DataFrame:
        c = df.groupBy("type").agg(F.count("*").alias("n"))
        text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "type", F.col("n").cast("string")))), ", ")
        return c.agg(text.alias("line")).select(F.lit(what).alias("what"), "line")

    return line(graph.nodes, "nodes").union(line(graph.edges, "edges"))
