"""Approximate nearest neighbours from randomly rotated one-bit codes.

Vectors are assigned to the nearest of about sqrt(n) centroids; the residual's
direction is rotated by one random orthogonal matrix and kept as its signs, packed
64 to a word, with two scalars: the residual's length and the inner product of the
direction with its code. A query's rotated residual is cut into ``PLANES`` bit
planes, so its inner product with a code is a sum of bit counts of words; from it
the distance is estimated without bias, and its error is bounded by
``epsilon * sqrt((1 - ip^2) / ip^2 / (d - 1))`` with high probability, plus what
the planes round off. A query takes exact distances of its most promising codes
first; the k-th of them is the bar that a code's lower bound must pass for its
vector to be reranked.

Queries are the rows that ``queries`` selects (all by default); every row is
indexed. How many cells a query probes is measured, not assumed: for a bounded
sample of queries (``tune_queries``) the exact neighbours are found over all
vectors, and the least number of cells that holds ``target`` of them is used.
Where vectors cluster that is a few cells; where they have no structure it is most
of them, and the search is then a scan of all codes for each query, in blocks.

Cells are packed into parts of bounded size; a query goes to each part that has
one of its cells. A row of the index travels once (more often only where a part has
more queries than a block), so a task holds one block of codes and one of queries
whatever the skew. Only the centroids are shared, and their number is bounded by
``max_cells``; they are fitted on at most ``train_rows`` vectors.

Defined results
  * rows with a null id, a null vector, a null or non-finite element, or another
    length than the commonest are left out, as queries and as answers.
  * repeated ids count once (the least vector stays); a row is no neighbour of itself.
  * equal distances are ordered by neighbour id; fewer than k others give fewer rows.
  * an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import drop_table, materialize

#: Bits of a coordinate of a query.
PLANES = 6


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def nearest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> np.ndarray:
    return np.concatenate([squared(x[i : i + block], c).argmin(1) for i in range(0, len(x), block)] or [np.zeros(0, int)])


def pack(x: np.ndarray, center: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs packed into words, residual lengths and <direction, code> of vectors around their centroids."""
    r = x - center
    length = np.sqrt((r * r).sum(1))
    o = (r / np.maximum(length, 1e-20)[:, None]) @ p
    return words_of(o >= 0), length, np.abs(o).sum(1) / np.sqrt(x.shape[1])


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def inner_products(codes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """<query, code> for each query and code (signs / sqrt(d)) from bit counts, and a bound of the rounding per query."""
    d = q.shape[1]
    low = q.min(axis=1, keepdims=True)
    unit = np.maximum((q.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-20)
    level = np.round((q - low) / unit).astype(np.uint8)
    lost = np.abs(q - low - unit * level).sum(1)
    total = np.zeros((len(q), len(codes)), np.float32)
    ones = np.bitwise_count(codes).sum(axis=1).astype(np.float32)
    for j in range(PLANES):
        plane = words_of((level >> j) & 1 == 1)
        for w in range(codes.shape[1]):
            total += np.bitwise_count(plane[:, w, None] & codes[None, :, w]) * np.float32(1 << j)
    held = low * ones[None] + unit * total
    return (2 * held - q.sum(axis=1, keepdims=True)) / math.sqrt(d), lost / math.sqrt(d)


def search_block(x, cells, code, length, ip, queries, reach, centers, p, k, epsilon):
    """Per query of a block: the vectors to rerank (query index, vector index)."""
    d = x.shape[1]
    dist = np.full((len(queries), len(x)), np.inf, np.float32)  # lower bounds of squared distances
    guess = np.full((len(queries), len(x)), np.inf, np.float32)
    ip = np.maximum(ip, 1e-6)
    error = epsilon * np.sqrt(np.maximum(1 - ip**2, 0) / ip**2 / max(d - 1, 1))
    for c in np.unique(cells):
        rows = np.flatnonzero(cells == c)
        to_center = squared(queries, centers[c : c + 1])[:, 0]
        asks = np.flatnonzero(to_center <= reach)
        if not len(asks):
            continue
        inner, lost = inner_products(code[rows], (queries[asks] - centers[c]) @ p)
        size = length[rows]
        est = to_center[asks][:, None] + (size**2)[None] - 2 * size[None] * inner / ip[rows][None]
        slack = 2 * size[None] * (np.sqrt(to_center[asks])[:, None] * error[rows][None] + lost[:, None] / ip[rows][None])
        at = np.ix_(asks, rows)
        guess[at] = est
        dist[at] = est - slack
    first = min(len(x), 3 * k + 2)
    top = np.argpartition(guess, first - 1, axis=1)[:, :first]
    exact = ((x[top] - queries[:, None]) ** 2).sum(2)
    exact[~np.isfinite(np.take_along_axis(guess, top, 1))] = np.inf
    # one more than k, as the query itself may be among them
    bar = np.partition(exact, min(k, first - 1), axis=1)[:, min(k, first - 1)]
    if first == len(x):
        bar[:] = np.inf
    bar += 1e-5 * (bar + (queries * queries).sum(1)) + 1e-6  # what rounding may add
    more = dist <= bar[:, None]
    more &= np.isfinite(guess)
    return np.nonzero(more)


def knn(embeddings: DataFrame, k: int = 10, target: float = 0.97, epsilon: float = 2.4, seed: int = 7,
        part_rows: int = 4096, query_rows: int = 8192, tune_queries: int = 200, train_rows: int = 20_000,
        max_cells: int = 16_384, queries: Column | None = None) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the k nearest others, among all vectors, of every vector that ``queries`` selects."""
    spark = embeddings.sparkSession
    kind = dict(embeddings.select("vec_id").dtypes)["vec_id"]
    v = F.col("embedding").cast("array<float>")
    usable = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    )
    good = embeddings.where(usable).select("vec_id", v.alias("x"))
    common = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out_schema = f"vec_id {kind}, neighbour_id {kind}, rank int, distance double"
    if common is None:
        return spark.createDataFrame([], out_schema)
    d = common[0]
    base = materialize(good.where(F.size("x") == d).groupBy("vec_id").agg(F.min("x").alias("x")), "vectors")
    asking = base if queries is None else base.where(queries)
    n = base.count()
    by_chance = F.xxhash64("vec_id"), "vec_id"
    x0, q0 = (
        np.array(df.orderBy(*by_chance).limit(rows).select("x").toPandas()["x"].tolist(), np.float32).reshape(-1, d)
        for df, rows in ((base, train_rows), (asking, tune_queries))
    )
    cells = max(1, min(int(math.sqrt(n)), max_cells, len(x0)))
    centers = kmeans(x0, cells, seed)
    p = rotation(d, seed)
    probes = tune(base, q0, centers, k, target) if cells > 1 and len(q0) else 1
    # neighbouring cells go to one part: order them along the first principal direction of the centroids
    axis = np.linalg.svd(centers - centers.mean(0), full_matrices=False)[2][0] if cells > 1 else np.zeros(d)
    order = np.argsort(centers @ axis, kind="stable")
    parts = max(1, -(-n // part_rows))
    part_of = np.empty(cells, np.int64)
    part_of[order] = np.arange(cells) * parts // cells
    model = spark.sparkContext.broadcast((centers, p, part_of))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, rot, part = model.value
        for f in frames:
            if len(f):
                x = np.stack(f["x"].tolist()).astype(np.float32)
                cell = nearest(x, c)
                code, length, ip = pack(x, c[cell], rot)
                yield pd.DataFrame(
                    {"vec_id": f["vec_id"], "cell": cell, "part": part[cell], "code": [r.tobytes() for r in code],
                     "length": length, "ip": ip, "x": [r.tobytes() for r in x]}
                )

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, _, part = model.value
        for f in frames:
            for at in range(0, len(f), 2048):
                g = f.iloc[at : at + 2048]
                x = np.stack(g["x"].tolist()).astype(np.float32)
                far = squared(x, c)
                reach = np.partition(far, probes - 1, axis=1)[:, probes - 1]
                reach = reach * (1 + 1e-5) + 1e-5 * (x * x).sum(1) + 1e-6  # what rounding may add
                goes = [np.unique(part[row <= r]).tolist() for row, r in zip(far, reach)]
                yield pd.DataFrame({"vec_id": g["vec_id"], "reach": reach, "parts": goes, "x": [r.tobytes() for r in x]})

    index = base.mapInPandas(place, f"vec_id {kind}, cell int, part int, code binary, length float, ip float, x binary")
    index = materialize(index, "index")
    asks = asking.mapInPandas(route, f"vec_id {kind}, reach float, parts array<int>, x binary").withColumn("part", F.explode("parts"))
    asks = materialize(asks.drop("parts"), "asks")
    # a crowded part is cut into slices of bounded size, and its queries into blocks
    rows = index.groupBy("part").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("slices"))
    blocks = asks.groupBy("part").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
    sides = materialize(rows.join(blocks, "part"), "sides")

    def spread(df: DataFrame, own: str, many: str, other: str, others: str) -> DataFrame:
        placed = df.join(sides, "part").withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(many)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("slices", "blocks")

    data, asks_ = spread(index, "slice", "slices", "block", "blocks"), spread(asks, "block", "blocks", "slice", "slices")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c, rot, _ = model.value
        names = ["vec_id", "neighbour_id", "distance"]
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": left["vec_id"][:0], "neighbour_id": left["vec_id"][:0], "distance": np.zeros(0)})
        left, right = left.sort_values("vec_id"), right.sort_values("vec_id")
        ids, x = left["vec_id"].to_numpy(), np.frombuffer(b"".join(left["x"]), np.float32).reshape(-1, d)
        code = np.frombuffer(b"".join(left["code"]), np.uint64).reshape(len(left), -1)
        cell, length, ip = (left[name].to_numpy() for name in ("cell", "length", "ip"))
        got = []
        for at in range(0, len(right), 256):
            part = right.iloc[at : at + 256]
            who, q = part["vec_id"].to_numpy(), np.frombuffer(b"".join(part["x"]), np.float32).reshape(-1, d)
            qi, xi = search_block(x, cell, code, length, ip, q, part["reach"].to_numpy(), c, rot, k, epsilon)
            other = who[qi] != ids[xi]
            qi, xi = qi[other], xi[other]
            gap = np.sqrt(((x[xi].astype(np.float64) - q[qi]) ** 2).sum(1))
            rank = np.lexsort((ids[xi], gap, qi))
            qi, xi, gap = qi[rank], xi[rank], gap[rank]
            begin = np.searchsorted(qi, qi, side="left")
            keep = np.arange(len(qi)) - begin < k
            got.append(pd.DataFrame({"vec_id": who[qi[keep]], "neighbour_id": ids[xi[keep]], "distance": gap[keep]}))
        return pd.concat(got)[names]

    found = (
        data.groupBy("part", "slice", "block")
        .cogroup(asks_.groupBy("part", "slice", "block"))
        .applyInPandas(meet, f"vec_id {kind}, neighbour_id {kind}, distance double")
    )
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
    best = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "neighbour_id", "rank", "distance"), "best")
    for table in (base, index, asks, sides):
        drop_table(table)
    return best


def tune(base: DataFrame, queries: np.ndarray, centers: np.ndarray, k: int, target: float) -> int:
    """The least number of probed cells that holds ``target`` of the sample's exact neighbours over all vectors."""
    shared = base.sparkSession.sparkContext.broadcast((queries, centers))

    def nearest_here(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, c = shared.value
        best = np.full((len(q), k + 1), np.inf)
        cell = np.zeros((len(q), k + 1), np.int64)
        for f in frames:
            for at in range(0, len(f), 4096):
                x = np.stack(f["x"].iloc[at : at + 4096].tolist()).astype(np.float32)
                far = np.concatenate([best, squared(q, x)], axis=1)
                where = np.concatenate([cell, np.tile(nearest(x, c), (len(q), 1))], axis=1)
                top = np.argpartition(far, k, axis=1)[:, : k + 1]
                best, cell = np.take_along_axis(far, top, 1), np.take_along_axis(where, top, 1)
        i, j = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"q": i, "distance": best[i, j], "cell": cell[i, j]})

    rows = base.select("x").mapInPandas(nearest_here, "q int, distance double, cell int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "cell"))
    top = rows.withColumn("r", rank).where((F.col("r") > 1) & (F.col("r") <= k + 1)).select("q", "cell").toPandas()
    if not len(top):
        return len(centers)
    far = squared(queries, centers)
    place = np.empty_like(far, dtype=np.int64)
    np.put_along_axis(place, np.argsort(far, axis=1, kind="stable"), np.arange(len(centers))[None].repeat(len(queries), 0), 1)
    needed = np.sort(place[top["q"], top["cell"]] + 1)
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)))])
