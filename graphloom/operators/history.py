"""Change history: per-file figures, ownership, hotspots, co-change, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import commit_category, half_up
from graphloom.plans.tables import kept, shards, spread

DAY = 86_400.0


def normalise(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per commit and file: rows of one file are added up, negatives count 0; commits need a hash and a date.

    One shuffle by commit serves the sums, the join with commits, and what else goes by commit.
    """
    named = commits.where(F.col("hash").isNotNull() & F.col("authored_at").isNotNull())
    sums = spread(changes.select("hash", "file", "additions", "deletions"), shards(changes), "hash").groupBy("hash", "file").agg(
        F.sum(F.greatest("additions", F.lit(0))).cast("long").alias("additions"), F.sum(F.greatest("deletions", F.lit(0))).cast("long").alias("deletions")
    )
    return sums.join(named, "hash").withColumn("category", commit_category(F.coalesce("subject", F.lit(""))))


def file_history(rows: DataFrame) -> DataFrame:
    """(file, commits, additions, deletions, churn, contributors, first_commit, last_commit, hotspot, churn_score, stability, class)."""
    seconds = F.unix_seconds(F.col("authored_at").cast("timestamp"))
    # by file alone, which serves the count of authors too; the figures themselves are one pass
    per_file = spread(rows.select("hash", "file", "author", "authored_at", "additions", "deletions"), shards(rows), "file").groupBy("file").agg(
        F.count("*").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.countDistinct("author").alias("contributors"), F.min_by("hash", F.struct("authored_at", "hash")).alias("first_commit"),
        F.max_by("hash", F.struct("authored_at", "hash")).alias("last_commit"), F.max(seconds).alias("last"), F.min(seconds).alias("first"),
    ).withColumn("churn", F.col("additions") + F.col("deletions"))
    top = per_file.agg(
        F.greatest(F.max("commits"), F.lit(1)).alias("max_commits"), F.greatest(F.max("churn"), F.lit(1)).alias("max_churn"),
        F.max("last").alias("latest"), F.greatest((F.max("last") - F.min("first")) / DAY, F.lit(1.0)).alias("window"),
    )
    p = per_file.crossJoin(F.broadcast(top))
    recency = F.greatest(F.lit(0.0), 1 - (F.col("latest") - F.col("last")) / DAY / F.col("window")) * 10
    score = F.col("commits") / F.col("max_commits") * 45 + F.col("churn") / F.col("max_churn") * 35 + F.least("contributors", F.lit(5)) / 5 * 10 + recency
    p = p.withColumn("hotspot", half_up(score, 3))
    return p.select(
        "file", "commits", "additions", "deletions", "churn", "contributors", "first_commit", "last_commit", "hotspot",
        half_up(F.col("churn") / F.col("max_churn") * 100, 3).alias("churn_score"),
        half_up(F.greatest(F.lit(0.0), 100 - F.col("hotspot")), 3).alias("stability"),
        F.when(F.col("hotspot") >= 70, "hotspot").when(F.col("hotspot") >= 40, "watch").otherwise("stable").alias("class"),
    )


def ownership(rows: DataFrame) -> DataFrame:
    """(file, owner, confidence, contributors, bus_factor): the author of most commits, then churn, then name;
    the bus factor is the least number of authors that made half of the commits."""
    each = rows.groupBy("file", "author").agg(F.count("*").alias("n"), F.sum(F.col("additions") + F.col("deletions")).alias("churn"))
    w = Window.partitionBy("file").orderBy(F.desc("n"), F.desc("churn"), "author")
    whole = Window.partitionBy("file")
    ranked = each.select(
        "file", "author", "n", F.row_number().over(w).alias("rank"),
        F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"), F.sum("n").over(whole).alias("total"),
    )
    return ranked.groupBy("file").agg(
        F.min_by("author", "rank").alias("owner"),
        half_up(F.min_by("n", "rank") / F.max("total") * 100, 3).alias("confidence"),
        F.count("*").alias("contributors"),
        F.min(F.when(F.col("so_far") / F.col("total") >= 0.5, F.col("rank"))).cast("long").alias("bus_factor"),
    )


def hotspots(rows: DataFrame, k: int = 200) -> DataFrame:
    return file_history(rows).orderBy(F.desc("hotspot"), F.desc("commits"), "file").limit(k).select("file", "hotspot", "commits", "class")


def co_changes(rows: DataFrame, max_files: int = 80, k: int = 5000) -> DataFrame:
    """(a, b, n, score, last_commit): files changed together, the k most frequent pairs.

    Commits of more than ``max_files`` files say nothing of pairs and are left out; the cap bounds the self join.
    A commit's files are kept as one row. All pairs are counted; the last commit is then sought for the k pairs alone.
    """
    size = F.count("*").over(Window.partitionBy("hash"))
    use = rows.select("hash", "file", "authored_at").withColumn("size_", size).where(F.col("size_") <= max_files)
    use = kept(use.groupBy("hash").agg(F.collect_list(F.struct("file", "authored_at")).alias("files")))
    every = use.select("hash", "files", F.explode("files").alias("x")).select("hash", "x", F.explode("files").alias("y")).where("x.file < y.file")
    every = every.select("hash", "x.authored_at", F.col("x.file").alias("a"), F.col("y.file").alias("b"))
    counts = spread(every.select("a", "b"), shards(rows), "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))
    # equal counts have equal scores, so the first k are known before the scores
    top = kept(counts.orderBy(F.desc("n"), "a", "b").limit(k))
    last = every.join(top, ["a", "b"]).groupBy("a", "b", "n").agg(F.max_by("hash", F.struct("authored_at", "hash")).alias("last_commit"))
    most = F.broadcast(top.agg(F.max("n").alias("most")))
    scored = last.crossJoin(most).select("a", "b", "n", half_up(F.col("n") / F.col("most") * 100, 3).alias("score"), "last_commit")
    return scored.orderBy(F.desc("n"), F.desc("score"), "a", "b").limit(k)


def category_ratios(rows: DataFrame) -> DataFrame:
    kinds = ("bugfix", "refactor", "feature", "other")
    return rows.groupBy("file").agg(*[half_up(F.avg((F.col("category") == k).cast("double")), 3).alias(k) for k in kinds])


def drift(rows: DataFrame) -> DataFrame:
    """(feature, year, commits, files_touched, files_introduced, churn): features are the first path segment."""
    feature, year = F.lower(F.element_at(F.split("file", "/"), 1)).alias("feature"), F.year("authored_at").alias("year")
    # a file's years, of which the first is the year that it came in
    years = spread(rows.select("file", year, (F.col("additions") + F.col("deletions")).alias("churn")), shards(rows), "file").groupBy("file", "year").agg(F.sum("churn").alias("churn"))
    new = F.col("year") == F.min("year").over(Window.partitionBy("file"))
    files = years.select("file", feature, "year", "churn", new.alias("new")).groupBy("feature", "year").agg(
        F.count("file").alias("files_touched"), F.sum(F.col("new").cast("long")).alias("files_introduced"), F.sum("churn").alias("churn")
    )
    commits = rows.select(feature, year, "hash").distinct().groupBy("feature", "year").agg(F.count("*").alias("commits"))
    figures = ("commits", "files_touched", "files_introduced", "churn")
    return commits.unionByName(files, allowMissingColumns=True).groupBy("feature", "year").agg(*[F.sum(c).alias(c) for c in figures])


def trends(rows: DataFrame) -> DataFrame:
    """(feature, first_files, last_files, trend): increasing where the last year touched over 1.5 times the first year's files."""
    d = drift(rows).groupBy("feature").agg(F.min_by("files_touched", "year").alias("first_files"), F.max_by("files_touched", "year").alias("last_files"))
    up = F.col("last_files") > F.greatest("first_files", F.lit(1)) * 1.5
    return d.withColumn("trend", F.when(up, "increasing").otherwise("flat"))


def parse_log(lines: DataFrame, mark: str = "commit:") -> tuple[DataFrame, DataFrame]:
    """Commits and changes from (file_name, line_no, line) of ``git log --numstat`` with ``mark`` before
    hash, date, author and subject, parted by the unit separator. A rename ``a/{b => c}/d`` becomes ``a/c/d``."""
    head = F.col("line").startswith(mark)
    n = F.sum(head.cast("int")).over(Window.partitionBy("file_name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("n_", n).where(F.col("n_") > 0)
    f = F.split(F.substring(F.col("line"), len(mark) + 1, 1 << 30), "\x1f")
    commits = rows.where(head).select("file_name", "n_", F.get(f, 0).alias("hash"), F.to_timestamp(F.get(f, 1)).alias("authored_at"), F.get(f, 2).alias("author"), F.get(f, 3).alias("subject"))
    p = F.split("line", "\t")
    path = F.regexp_replace(F.get(p, 2), r"\{[^{}]* => ([^{}]*)\}", "$1")
    path = F.regexp_replace(F.regexp_replace(path, "^.* => ", ""), "/+", "/")
    stats = rows.where(~head & F.col("line").rlike("^[0-9-]+\t[0-9-]+\t."))
    changes = stats.select("file_name", "n_", path.alias("file"), *[F.coalesce(F.get(p, i).try_cast("long"), F.lit(0)).alias(c) for i, c in enumerate(("additions", "deletions"))])
    changes = changes.join(commits.select("file_name", "n_", "hash"), ["file_name", "n_"]).select("hash", "file", "additions", "deletions")
    return commits.select("hash", "authored_at", "author", "subject"), changes
