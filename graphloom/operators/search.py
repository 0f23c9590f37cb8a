"""Concept search: entries, postings, vocabulary, additive scores, calibrated confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import bigrams, half_up, normal_text, tokens
from graphloom.graph import Graph

#: Architecture layers by kind of node; every other kind is of the language.
LAYERS = {
    "application-boundary": ("Route", "Controller", "Operation", "Middleware", "Guard"),
    "application-service": ("Service", "Provider", "Factory"),
    "persistence": ("Repository", "DatabaseTable", "Model", "Resource"),
    "configuration": ("Configuration", "EnvironmentVariable", "BuildTarget", "Script", "Task"),
    "architecture": ("Package", "Workspace", "Application", "Framework", "Dependency"),
}
#: Weights by kind of node in its importance; every other kind weighs 1.
WEIGHTS = {5: ("Workspace", "Application"), 4: ("Package", "Module", "Controller", "Route", "Service"), 3: ("Provider", "Repository", "Configuration", "EnvironmentVariable")}


def by_kind(table: dict, default) -> Column:
    chain = None
    for value, types in table.items():
        hit = F.col("type").isin(*types)
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain.otherwise(F.lit(default))


def entries(graph: Graph) -> DataFrame:
    """(id, name, type, file, package, words, layer, importance, usage) of every node.

    Importance is the kind's weight, log2(degree + 1) and log2(inbound + 1); both
    ends of an edge are counted in one scan.
    """
    return _entries(graph)


def _entries(graph: Graph, *more: Column) -> DataFrame:
    """``entries`` with more columns, which may use ``degree`` and ``inbound``."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("into"))))
    d = graph.edges.select(ends.alias("e")).groupBy("e.id").agg(F.count("*").alias("degree"), F.sum("e.into").alias("inbound"))
    n = graph.nodes.select("id", "name", "type", "file", "package").join(d, "id", "left")
    usage, inbound = F.coalesce("degree", F.lit(0)), F.coalesce("inbound", F.lit(0))
    importance = half_up(by_kind(WEIGHTS, 1) + F.log2(usage + 1) + F.log2(inbound + 1), 3)
    return n.select(
        "id", "name", "type", "file", "package", tokens(F.concat_ws(" ", "name", "type")).alias("words"),
        by_kind(LAYERS, "language").alias("layer"), importance.alias("importance"), usage.alias("usage"), *more,
    )


def postings(entries_: DataFrame, id_column: str = "id", words: str = "words") -> DataFrame:
    """(term, id): the inverted index, in long form and without caps; the words of an entry are distinct already."""
    return entries_.select(F.explode_outer(words).alias("term"), F.col(id_column).alias("id")).where("term IS NOT NULL")


def vocabulary(posts: DataFrame, k: int | None = None) -> DataFrame:
    """(term, frequency): in how many entries a term is; the k most frequent, if asked."""
    v = posts.groupBy("term").agg(F.count("*").alias("frequency"))
    return v if k is None else v.orderBy(F.desc("frequency"), "term").limit(k)


def search(entries_: DataFrame, phrase: str, k: int = 40) -> DataFrame:
    """Ranked candidates with one column per reason, the score, and a confidence that knows the runner-up."""
    said, words = normal_text(F.lit(phrase)), tokens(F.lit(phrase))
    name = normal_text(F.col("name"))
    met = F.size(F.array_intersect("words", words))
    asked = F.size(words)
    e = entries_.where(F.arrays_overlap("words", words) | (F.col("id") == phrase) | F.contains(name, said))
    reasons = {
        "exact_id": F.when(F.col("id") == phrase, 1000.0).otherwise(0.0),
        "exact_name": F.when(name == said, 500.0).otherwise(0.0),
        "all_words": F.when(met == asked, 260.0).otherwise(0.0),
        "phrase": F.when(F.contains(name, said), 180.0).otherwise(0.0),
        "words_met": 55.0 * met,
        "similarity": 140.0 * met / F.size(F.array_union("words", words)),
        "importance_points": F.col("importance"),
        "usage_points": F.least(F.lit(60.0), 10.0 * F.log2(F.col("usage") + 1)),
        "missing": -120.0 * (asked - met),
    }
    scored = e.select("id", "type", *[v.alias(n) for n, v in reasons.items()])
    total = sum((F.col(n) for n in reasons), F.lit(0.0))
    top = scored.withColumn("score", half_up(total, 3)).where(F.col("score") > 0).orderBy(F.desc("score"), "type", "id").limit(k)
    w = Window.orderBy(F.desc("score"), "type", "id")
    best, second = F.max("score").over(Window.partitionBy()), F.nth_value("score", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = F.col("score") - F.coalesce(F.when(F.row_number().over(w) == 1, second), best)
    raw = F.least(F.lit(0.99), F.col("score") / 900)
    cap = F.when(F.row_number().over(w) > 1, 0.84).when(gap < 45, 0.72).when(gap < 90, 0.86).otherwise(0.99)
    return top.select("id", "type", "score", half_up(F.least(raw, cap), 3).alias("confidence"), F.row_number().over(w).cast("long").alias("rank"))


def feature_buckets(entries_: DataFrame, k: int = 240) -> DataFrame:
    """(feature, members, score): nodes by their first three words, the k most owned features."""
    f = entries_.select("id", F.array_join(F.slice("words", 1, 3), "-").alias("feature"), (F.col("importance") + F.col("usage")).alias("s"))
    g = f.groupBy("feature").agg(F.count("*").alias("members"), half_up(F.sum("s"), 1).alias("score"))
    return g.orderBy(F.desc("members"), "feature").limit(k)


def related_by_terms(posts: DataFrame) -> DataFrame:
    """(a, b, shared): entries that share a term or more, over all terms; a term of n entries makes n * (n - 1) / 2 pairs."""
    pairs = posts.select("term", F.col("id").alias("a")).join(posts.select("term", F.col("id").alias("b")), "term").where(F.col("a") < F.col("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def intents(entries_: DataFrame) -> DataFrame:
    """(intent, n): words and adjacent pairs of words over all entries."""
    both = F.concat("words", bigrams(F.col("words")))
    return entries_.select(F.explode(both).alias("intent")).groupBy("intent").agg(F.count("*").alias("n"))


def ownership_scores(graph: Graph) -> DataFrame:
    """(id, score): kind weight, 4 a edge in and 3 a edge out up to 60, and the importance."""
    into, ends = F.coalesce("inbound", F.lit(0)), F.coalesce("degree", F.lit(0))
    e = _entries(graph, F.least(F.lit(60), 4 * into + 3 * (ends - into)).alias("points"))
    points = F.col("points")
    return e.select("id", "type", half_up(points + F.col("importance"), 3).alias("score"))
