"""Self join of documents on the Jaccard similarity of their word n-gram sets.

A document is the set of its lower-case word n-grams. Two documents of
similarity >= t share at least ``o = ceil(t * size)`` grams of either, so in any
order of all grams their prefixes of ``size - o + 1`` grams meet. The order puts
rare grams first and the frequent class (held by at least the share ``frequent``
of the documents, counted over all of them) last, by count. Of the rare ones those
of at least the share ``COMMON`` come last, by count: a passage that many unlike
documents share then mostly lies behind their prefixes, and a pair that shares
little else doesn't meet, whatever the number of such documents. A prefix of rare
grams alone is indexed gram by gram. Where it reaches the frequent class it is
extended to ``size - o + k`` grams, so that two such documents share k prefix
grams: either a rare one, or k frequent ones; hence frequent grams are indexed
as combinations of k = 2, and common phrases alone bring nobody together.

The index travels packed (a row is an array of keys, not a key; a document stands in
it once with the number of its keys) and is sorted in numpy per shard. Rare grams of a
few documents are counted pair by pair; longer lists, of which groups of copies produce
hundreds of equal ones, are merged, and stay one row until their members are asked for. A
pair is a candidate only if the prefix grams it shares (those counted, and at
most those that either side has in long lists) can make up the overlap that its
sizes demand. Each long list is first verified against one leader, and each document
against the earlier one it shares most counted grams with; then the candidates that this
leaves in different groups. Lists whose members the verified pairs already connect are done. In the others every pair from
different groups is a candidate, unless the triangle inequality of the Jaccard
distance through the leader, or the number of prefix grams the two share, excludes
it: rare ones are counted by their lists, frequent ones by the documents' ranks of
them, so that this number is exact. Candidates meet at their leader or at the
longest list they share, in parts of bounded size, to which a gram set travels once.

Verification is exact, on the full sets; of the last candidates, mostly unlike ones, an
upper bound by the leading 16 bits of the hashes is taken first. The groups are the connected components
that all pairs would give. No candidate is dropped that could be similar enough.

Defined results
  * null or empty text, and texts without a word, are in no group; a text of
    fewer than n words is one gram.
  * every row's text is compared by itself; rows of one id are linked with each
    other, so they stay or go together; a null id is in no group and stays.
  * ids are whole numbers; other types are refused.
  * of a group the least id stays. An empty table gives an empty table; texts are
    read whole; other columns are carried by ``keep_one`` and otherwise ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BASE, drop_table, fresh, give_back, materialize, mix, rolling, small, text_chunks, word_hashes
from graphloom.llm.components import components

#: Index rows of a shard, about; and of one packed row group before it is sent on.
SHARD_ROWS, FLUSH_ROWS = 800_000, 800_000
#: Documents of a rare gram up to which its pairs are counted one by one.
FEW = 8
#: Share of the documents from which a rare gram stands behind the other rare ones; it orders grams and drops none.
COMMON = 0.0005
#: Documents that meet a hub, or each other, in one part; gram sets that a task gets, about.
SLICE_DOCS, PART_DOCS, TASK_SETS = 256, 1024, 4000


def gram_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, end to end and ascending in each text, and their numbers."""
    h, words = word_hashes([t or "" for t in texts])
    owner = np.repeat(np.arange(len(texts)), words)
    if len(h) >= n:
        grams = rolling(h, n)
        whole = owner[: len(grams)] == owner[n - 1 :]
        grams, of = grams[whole], owner[: len(grams)][whole]
    else:
        grams, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    brief = np.flatnonzero((words > 0) & (words < n))
    if len(brief):
        ends = np.cumsum(words)
        extra = [rolling(h[ends[d] - words[d] : ends[d]], int(words[d]))[0] for d in brief]
        grams, of = np.concatenate([grams, np.array(extra, np.uint64)]), np.concatenate([of, brief])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], np.bincount(of[new], minlength=len(texts))


def frequent_grams(docs: DataFrame, n: int, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the grams that have a rank, and their ranks by count, and the number of grams of all documents.

    Ranks are above 0 in the frequent class and below 0 for the common ones of the rare
    grams. At most ``mean set size / share`` grams can be frequent, and as many by
    ``COMMON`` common, whatever the number of documents; that bounds what is collected and shared.
    """
    least = min(share, COMMON)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, docs_held = [], 0
        for f in frames:
            texts = f["text"].tolist()
            for a, b in text_chunks(texts):
                grams, sizes = gram_sets(texts[a:b], n)
                held.append(grams)
                docs_held += int((sizes > 0).sum())
                if sum(map(len, held)) >= 4_000_000:
                    yield tally(held, docs_held)
                    docs_held = 0
        if held:
            yield tally(held, docs_held)
        f = texts = grams = sizes = None
        give_back()

    def tally(held: list[np.ndarray], docs_held: int) -> pd.DataFrame:
        grams = np.concatenate(held)
        held.clear()
        grams.sort()
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
        kinds, times = grams[first], np.diff(np.append(first, len(grams)))
        # a gram that is frequent overall is so in some chunk; its few uses elsewhere may go uncounted,
        # which moves its place in the order, not the result
        often = times >= max(2, least * docs_held)
        head = pd.DataFrame({"gram": [None], "n": [len(grams)], "docs": [docs_held]})
        body = pd.DataFrame({"gram": kinds[often].view(np.int64), "n": times[often], "docs": 0})
        return pd.concat([head, body]).astype({"gram": "Int64"})

    counts = materialize(docs.select("text").mapInPandas(count, "gram long, n long, docs long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    total = counts.where(F.col("gram").isNull()).first()
    if total is None:
        drop_table(counts)
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    bar = max(3, least * total["docs"])
    often = counts.where(F.col("gram").isNotNull() & (F.col("n") >= bar)).select("gram", "n").toPandas()
    drop_table(counts)
    grams = often["gram"].to_numpy(np.int64).view(np.uint64)
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, often["n"].to_numpy()))] = np.arange(len(grams))
    rank -= int((often["n"] < max(3, share * total["docs"])).sum())
    rank[rank >= 0] += 1
    order = np.argsort(grams)
    return grams[order], rank[order], int(total["n"])


def prefix_keys(grams: np.ndarray, sizes: np.ndarray, often: np.ndarray, rank: np.ndarray, t: float, k: int = 2):
    """Index keys of each document of a chunk, (key, document), and the ranks of its frequent prefix grams, end to end, and their numbers.

    The last bit of a key tells a rare gram (0) from what stands for frequent ones (1).
    """
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.zeros(len(grams), np.int64)
    lowest = int(rank.min(initial=0))
    if len(often):
        at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
        place = np.where(often[at] == grams, rank[at], 0)
    # rare first, by hash, the common ones of them behind, by count; then frequent, by count
    order = np.lexsort((grams, np.where(place < 0, place - lowest, -1), np.maximum(place, 0), of))
    grams, place = grams[order], np.maximum(place[order], 0)
    begin = np.cumsum(sizes) - sizes
    pos = np.arange(len(grams)) - begin[of]
    rare = np.bincount(of, place == 0, len(sizes)).astype(np.int64)
    least = np.ceil(t * sizes - 1e-9).astype(np.int64)
    extended = rare < sizes - least + 1
    length = np.where(extended, np.minimum(sizes, sizes - least + k), sizes - least + 1)
    use = pos < length[of]
    single = use & (place == 0)
    many = use & (place > 0)
    alone = many & (least[of] < k)  # sets so small that sharing one frequent gram can do
    one = np.uint64(1)
    keys, docs = [grams[single] & ~one, grams[alone] | one], [of[single], of[alone]]
    common = np.bincount(of[many], minlength=len(sizes))
    for d in np.flatnonzero(common >= k):
        mine = slice(begin[d], begin[d] + sizes[d])
        g = np.sort(grams[mine][many[mine]])
        i, j = np.triu_indices(len(g), 1)
        keys.append(mix(g[i] * np.uint64(BASE) + g[j]) | one)
        docs.append(np.full(len(i), d))
    return np.concatenate(keys), np.concatenate(docs), place[many].astype(np.int32), common


FOUND = "kind int, list long, a long, b long, n int, size_a int, size_b int, common_a int, common_b int, ranks array<int>, docs array<long>"


def to_planes(x: np.ndarray) -> bytes:
    """Whole numbers with all their lowest bytes first, then the next ones: the high bytes, mostly alike, compress away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def collisions(docs: DataFrame, n: int, t: float, often: np.ndarray, rank: np.ndarray, total: int) -> DataFrame:
    """What the index brings together, as FOUND rows of four kinds.

    0: the ``docs`` of a list of documents that share a key, other than a rare gram of
    at most FEW documents, and how many rare grams have this list; 1: a pair (a, b) and
    how many such rare grams the two share in this shard; 2: a document ``a`` of lists of
    kind 0 and how many of rare grams it is in; 3: the ``ranks`` of its frequent prefix grams.
    """
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * (1 - t) / SHARD_ROWS))
    shared = spark.sparkContext.broadcast((often, rank))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, rank = shared.value
        held, rows = [], 0
        for f in frames:
            texts, ids = f["text"].tolist(), f["doc_id"].to_numpy(np.int64)
            for a, b in text_chunks(texts):
                grams, sizes = gram_sets(texts[a:b], n)
                key, d, ranks, common = prefix_keys(grams, sizes, often, rank, t)
                some = common > 0
                held.append((key, ids[a:b][d], sizes[d].astype(np.uint32), common[d].astype(np.uint32), ranks, ids[a:b][some], common[some]))
                rows += len(key)
                if rows >= FLUSH_ROWS:
                    yield packed(held)
                    held, rows = [], 0
        if rows:
            yield packed(held)
        held = f = texts = key = d = grams = ranks = None
        give_back()

    def packed(held) -> pd.DataFrame:
        key, doc, size, common, ranks, holder, held_ranks = (np.concatenate(x) for x in zip(*held))
        shard = (key >> np.uint64(32)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        out = {"shard": [], "keys": [], "times": [], "docs": [], "sizes": [], "common": [], "ranks": [], "holders": [], "held": []}
        home = mix(holder.view(np.uint64)) % np.uint64(shards)
        each = np.repeat(home, held_ranks)
        for s in range(shards):
            if cuts[s] == cuts[s + 1] and not (home == s).any():
                continue
            mine = order[cuts[s] : cuts[s + 1]]
            ids, first, at = np.unique(doc[mine], return_index=True, return_inverse=True)
            out["shard"].append(s)
            out["keys"].append(key[mine][np.argsort(at, kind="stable")].astype(np.uint32).tobytes())
            out["times"].append(to_planes(np.bincount(at, minlength=len(ids)).astype(np.uint32)))
            out["docs"].append(to_planes(np.diff(ids, prepend=ids[:1] * 0)))
            out["sizes"].append(to_planes(size[mine][first]))
            out["common"].append(to_planes(common[mine][first]))
            out["ranks"].append(ranks[each == s].tobytes())
            out["holders"].append(holder[home == s].tobytes())
            out["held"].append(held_ranks[home == s].tobytes())
        return pd.DataFrame(out)

    def gather(f: pd.DataFrame) -> pd.DataFrame:
        give_back()  # what the shard before took
        # 32 bits beside the shard: a chance meeting is one more candidate, and fails verification
        key = np.concatenate([np.frombuffer(b, np.uint32) for b in f["keys"]])
        times = np.concatenate([from_planes(b, np.uint32) for b in f["times"]])
        doc = np.repeat(np.concatenate([np.cumsum(from_planes(b, np.int64)) for b in f["docs"]]), times)
        size, common = (np.repeat(np.concatenate([from_planes(b, np.uint32) for b in f[c]]), times) for c in ("sizes", "common"))
        order = np.lexsort((doc, key))
        key, doc, size, common = key[order], doc[order], size[order], common[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc, size, common = key[new], doc[new], size[new], common[new]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.append(begin, len(key)))
        begin, length = begin[length > 1], length[length > 1]
        rare = (key[begin] & 1) == 0
        few = rare & (length <= FEW)
        columns = ["kind", "list", "a", "b", "n", "size_a", "size_b", "common_a", "common_b"]
        out = []
        x, y = [], []
        for m in range(2, FEW + 1):
            where = begin[few & (length == m)]
            for i in range(m):
                for j in range(i + 1, m):
                    x.append(where + i)
                    y.append(where + j)
        x, y = np.concatenate(x), np.concatenate(y)
        # sets of too unlike sizes can't be similar, whatever they share
        alike = np.minimum(size[x], size[y]) >= (t - 1e-9) * np.maximum(size[x], size[y])
        x, y = x[alike], y[alike]
        if len(x):
            order = np.lexsort((doc[y], doc[x]))
            x, y = x[order], y[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[x][1:] != doc[x][:-1]) | (doc[y][1:] != doc[y][:-1])]))
            times = np.diff(np.append(first, len(x)))
            x, y = x[first], y[first]
            out.append(
                pd.DataFrame(
                    {"kind": 1, "a": doc[x], "b": doc[y], "n": times, "size_a": size[x], "size_b": size[y], "common_a": common[x], "common_b": common[y]}
                )
            )
        begin, length, rare = begin[~few], length[~few], rare[~few]
        if len(begin):
            keep = np.repeat(begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            doc, size, common = doc[keep], size[keep], common[keep]
            ids, once, which = np.unique(doc, return_index=True, return_inverse=True)
            times = np.bincount(which, np.repeat(rare, length), len(ids)).astype(np.int64)
            out.append(pd.DataFrame({"kind": 2, "a": ids, "n": times, "size_a": size[once], "common_a": common[once]}))
            begin = np.cumsum(length) - length
            sign = np.add.reduceat(mix(doc.view(np.uint64) + np.uint64(BASE)), begin) + length.astype(np.uint64)
            _, once, what = np.unique(sign, return_index=True, return_inverse=True)
            times = np.bincount(what, rare, len(once)).astype(np.int64)  # rare keys with this list
            members = [doc[i : i + m] for i, m in zip(begin[once], length[once])]
            out.append(pd.DataFrame({"kind": 0, "list": sign[once].view(np.int64), "n": times, "docs": members}))
        holder = np.frombuffer(b"".join(f["holders"]), np.int64)
        if len(holder):
            ranks = np.split(np.frombuffer(b"".join(f["ranks"]), np.int32), np.cumsum(np.frombuffer(b"".join(f["held"]), np.int64))[:-1])
            out.append(pd.DataFrame({"kind": 3, "a": holder, "ranks": ranks}))
        if not out:
            return pd.DataFrame({c: pd.Series([], dtype="Int64") for c in [*columns, "ranks", "docs"]})
        whole = [o.reindex(columns=columns).astype("Int64").assign(**{c: o[c] if c in o else pd.Series([None] * len(o), dtype=object) for c in ("ranks", "docs")}) for o in out]
        return pd.concat(whole)

    rows = docs.mapInPandas(index, "shard int, keys binary, times binary, docs binary, sizes binary, common binary, ranks binary, holders binary, held binary")
    return rows.groupBy("shard").applyInPandas(gather, FOUND)


def possible(t: float, shared, size_a, size_b):
    """Whether two sets whose prefixes share at most ``shared`` grams can be similar enough.

    Grams they share beyond the prefix that ends first lie behind it in its set, and
    a prefix leaves fewer than ``ceil(t * size)`` grams behind.
    """
    needed = t / (1 + t) * (size_a + size_b) - F.greatest(F.ceil(t * size_a - 1e-9), F.ceil(t * size_b - 1e-9)) + 1
    alike = F.least(size_a, size_b) >= (t - 1e-9) * F.greatest(size_a, size_b)
    return alike & (shared >= needed - 1e-6)


#: Bytes of a hash that tell the grams of a pair of documents apart; bytes for an upper bound of what the two share.
EXACT, BOUND = 5, 2


def to_bytes(grams: np.ndarray, width: int = EXACT) -> bytes:
    """Ascending hashes, by their leading bytes: the steps between them, in planes, whose high bytes compress away."""
    steps = np.diff(grams >> np.uint64(64 - 8 * width), prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_bytes(b: bytes, width: int = EXACT) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def verify(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(hub, other, jaccard) of pairs (hub, other, part): exact, on the whole sets."""
    return compare(docs, pairs, n, EXACT)


def compare(docs: DataFrame, pairs: DataFrame, n: int, width: int) -> DataFrame:
    """(hub, other, jaccard) of pairs (hub, other, part), on so many bytes of the hashes: with BOUND, never less than the exact one.

    The pairs of a part meet in one task, to which each gram set of theirs travels once.
    """
    spark = docs.sparkSession
    ends = pairs.select(F.col("hub").alias("doc"), "part").union(pairs.select("other", "part"))
    places = materialize(ends.groupBy("doc").agg(F.collect_set("part").alias("parts")), "places")
    weight = places.agg(F.sum(F.size("parts"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(weight / TASK_SETS))
    rows = docs.join(small(places), docs["doc_id"] == places["doc"]).select("doc", "text", "parts")

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, ids, parts = f["text"].tolist(), f["doc"].tolist(), f["parts"].tolist()
            for a, b in text_chunks(texts):
                grams, sizes = gram_sets(texts[a:b], n)
                ends = np.cumsum(sizes)
                packed = [(k, to_bytes(grams[end - size : end], width)) for k, end, size in zip(range(a, b), ends, sizes)]
                rows = [(p % tasks, p, ids[k], x) for k, x in packed for p in parts[k]]
                yield pd.DataFrame(rows, columns=["task", "part", "doc", "grams"])
        f = texts = grams = packed = rows = None
        give_back()

    def meet(sets: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        give_back()
        out = [pd.DataFrame({"hub": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "jaccard": np.zeros(0)})]
        places = dict(zip(sets["part"].unique(), [g for _, g in sets.groupby("part", sort=False)]))
        for part, mine in pairs.groupby("part", sort=False):
            held = {d: from_bytes(x, width) for d, x in zip(places[part]["doc"], places[part]["grams"])}
            for hub, others in mine.groupby("hub", sort=False)["other"]:
                x, rest = held[hub], [held[o] for o in others]
                for k in range(0, len(rest), 256):
                    every = np.concatenate(rest[k : k + 256])
                    size = np.array([len(r) for r in rest[k : k + 256]])
                    at = np.minimum(np.searchsorted(x, every), len(x) - 1)
                    both = np.minimum(np.add.reduceat((x[at] == every).astype(np.int64), np.cumsum(size) - size), len(x))
                    out.append(pd.DataFrame({"hub": hub, "other": others.iloc[k : k + 256], "jaccard": both / (len(x) + size - both)}))
        return pd.concat(out)

    sets = rows.mapInPandas(send, "task int, part long, doc long, grams binary")
    asked = pairs.select("hub", "other", "part", F.pmod("part", F.lit(tasks)).cast("int").alias("task"))
    return sets.groupBy("task").cogroup(asked.groupBy("task")).applyInPandas(meet, "hub long, other long, jaccard double")


def keyed(documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one key a text, and which keys stand for rows of a repeated id: (doc_id, key); None if no id repeats."""
    kind = dict(documents.select("doc_id").dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"doc_id must be a whole number, not {kind}")
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = materialize(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        drop_table(again)
        return docs, None
    marked = docs.join(small(again.withColumn("again", F.lit(True))), "doc_id", "left")
    key = F.when(F.col("again"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    keys = materialize(marked.where("again").select("doc_id", key.alias("key")).distinct(), "keys")
    return marked.select(key.alias("doc_id"), "text"), keys


def near_duplicates(documents: DataFrame, n: int = 5, threshold: float = 0.36, frequent: float = 0.01) -> DataFrame:
    """(doc_id, group_id, group_size) of every document with a near copy; group_id is the one that stays."""
    t = threshold
    docs, keys = keyed(documents)
    often, rank, total = frequent_grams(docs, n, frequent)
    found = materialize(collisions(docs, n, t, often, rank, total), "found")
    heavy = materialize(
        found.where("kind = 2").groupBy(F.col("a").alias("doc")).agg(F.sum("n").alias("heavy"), F.first("size_a").alias("size"), F.first("common_a").alias("common")), "heavy"
    )
    pairs = found.where("kind = 1").groupBy("a", "b").agg(
        F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("size_a", "size_b", "common_a", "common_b")]
    )
    # grams in long lists and frequent ones weren't counted pair by pair: at most all of either side's are shared
    for side in ("a", "b"):
        pairs = pairs.join(heavy.select(F.col("doc").alias(side), F.col("heavy").alias(f"heavy_{side}")), side, "left")
    unseen = F.least(*[F.coalesce(f"heavy_{x}", F.lit(0)) + F.col(f"common_{x}") for x in ("a", "b")])
    pairs = pairs.where(possible(t, F.col("n") + unseen, F.col("size_a"), F.col("size_b")))
    pairs = pairs.select(F.col("a").alias("hub"), F.col("b").alias("other"), "n", F.lit(False).alias("star"))

    # a list stays one row; its members are only taken apart for what is asked of each
    lists = found.where("kind = 0").groupBy("list").agg(F.sum("n").alias("keys"), F.first("docs").alias("docs"))
    leader = F.array_min(F.transform("docs", lambda d: F.struct(F.xxhash64(d).alias("h"), d.alias("doc"))))["doc"]
    lists = materialize(lists.withColumn("leader", leader), "lists")
    about = heavy.select("doc", "size", "common", (F.col("heavy") + F.col("common")).alias("unseen"))
    stars = lists.select("leader", F.explode("docs").alias("doc")).where(F.col("doc") != F.col("leader")).distinct().join(about, "doc")
    stars = (
        stars.join(about.select(F.col("doc").alias("leader"), F.col("size").alias("lead_size"), F.col("unseen").alias("lead_unseen")), "leader")
        .where(possible(t, F.least("unseen", "lead_unseen"), F.col("size"), F.col("lead_size")))
        .select("leader", "doc", F.lit(0), F.lit(True))
    )
    ends = F.least("hub", "other").alias("x"), F.greatest("hub", "other").alias("y")
    first = pairs.union(stars).groupBy(*ends).agg(F.min(F.struct("hub", "other")).alias("p"), F.max("n").alias("n"), F.max("star").alias("star"))
    first = materialize(first.select("p.hub", "p.other", "n", "star"), "first")

    def measured(asked: DataFrame) -> DataFrame:
        # the others of a hub come to it, in slices of bounded size
        slices = asked.groupBy("hub").agg(F.ceil(F.count("*") / SLICE_DOCS).alias("slices"))
        part = F.xxhash64("hub", F.pmod(F.xxhash64("other"), F.col("slices")))
        asked = materialize(asked.join(slices, "hub").select("hub", "other", part.alias("part")), "asked")
        out = materialize(verify(docs, asked, n), "verified")
        drop_table(asked)
        return out

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.col("jaccard") >= t - 1e-12).select(F.col("hub").alias("a"), F.col("other").alias("b"))

    # leaders with their lists, and each document with the earlier one it shares most with; then pairs that this leaves apart
    best = first.groupBy(ends[1]).agg(F.max(F.struct("n", -F.least("hub", "other"), "hub", "other")).alias("p")).select("p.hub", "p.other")
    pick = materialize(best.union(first.where("star").select("hub", "other")).distinct(), "pick")
    tried = measured(pick)
    joined = materialize(components(linked(tried)), "joined")
    apart = first.where("not star")
    for side in ("hub", "other"):
        apart = apart.join(small(joined.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))), side, "left")
    apart = apart.where(F.coalesce("of_hub", "hub") != F.coalesce("of_other", "other")).select("hub", "other")
    apart = materialize(apart.join(tried.select("hub", "other"), ["hub", "other"], "left_anti"), "apart")
    rest = measured(apart)
    verified = tried.union(rest)
    known = materialize(components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(linked(rest))), "known")

    gaps = verified.select(F.least("hub", "other").alias("x"), F.greatest("hub", "other").alias("y"), (1 - F.col("jaccard")).alias("gap"))
    placed = F.coalesce("component", "doc")
    within = lists.select("list", F.explode("docs").alias("doc")).join(known.withColumnRenamed("node", "doc"), "doc", "left")
    split = within.groupBy("list").agg(F.min(placed).alias("lo"), F.max(placed).alias("hi")).where("lo != hi").select("list")
    left = (
        lists.join(split, "list")
        .select("list", "keys", "leader", F.size("docs").alias("length"), F.explode("docs").alias("doc"))
        .join(about.join(known.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", placed), "doc")
        .withColumn("x", F.least("leader", "doc"))
        .withColumn("y", F.greatest("leader", "doc"))
        .join(gaps, ["x", "y"], "left")
        .drop("x", "y")
    )
    left = materialize(left, "left")
    x, y = left.alias("x"), left.alias("y")
    crossing = (
        x.join(y, (F.col("x.list") == F.col("y.list")) & (F.col("x.doc") < F.col("y.doc")))
        .where(
            (F.col("x.component") != F.col("y.component"))
            & (F.col("x.doc") != F.col("x.leader"))
            & (F.col("y.doc") != F.col("x.leader"))
            & possible(t, F.least("x.unseen", "y.unseen"), F.col("x.size"), F.col("y.size"))
            & (F.coalesce(F.abs(F.col("x.gap") - F.col("y.gap")), F.lit(0.0)) <= 1 - t + 1e-9)
        )
        .groupBy(F.col("x.doc").alias("hub"), F.col("y.doc").alias("other"))
        .agg(F.sum("x.keys").alias("n"), F.first("x.size").alias("size_a"), F.first("y.size").alias("size_b"), F.first(F.least("x.common", "y.common")).alias("common"), F.max(F.struct("x.length", "x.list"))["list"].alias("list"))
        # all long lists that the two share are open, so their keys are counted; pairs that also share counted
        # grams, or are a leader and its member in some list, were settled above
        .where(possible(t, F.col("n") + F.col("common"), F.col("size_a"), F.col("size_b")))
    )
    crossing = materialize(crossing, "crossing")
    ranks = found.where("kind = 3").select(F.col("a").alias("doc"), "ranks").dropDuplicates(["doc"])
    known_ranks = crossing
    for side in ("hub", "other"):
        known_ranks = known_ranks.join(ranks.select(F.col("doc").alias(side), F.col("ranks").alias(f"ranks_{side}")), side, "left")
    common = F.coalesce(F.size(F.array_intersect("ranks_hub", "ranks_other")), F.lit(0))
    exact = possible(t, F.col("n") + F.greatest(common, F.lit(0)), F.col("size_a"), F.col("size_b"))
    last = materialize(known_ranks.where(exact).select("hub", "other", "list"), "last")
    # the pairs of a list meet there, its documents dealt into buckets
    held = last.select("list", F.col("hub").alias("doc")).union(last.select("list", "other")).distinct()
    buckets = held.groupBy("list").agg(F.ceil(F.count("*") / PART_DOCS).alias("buckets"))
    deal = [F.pmod(F.xxhash64(c), F.col("buckets")) for c in ("hub", "other")]
    part = F.xxhash64("list", F.least(*deal), F.greatest(*deal))
    asked_more = materialize(last.join(buckets, "list").select("hub", "other", part.alias("part")), "asked")
    hopeful = compare(docs, asked_more, n, BOUND).where(F.col("jaccard") >= t - 1e-12).select("hub", "other")
    hopeful = materialize(hopeful.join(asked_more, ["hub", "other"]), "hopeful")
    more = verify(docs, hopeful, n).where(F.col("jaccard") >= t - 1e-12).select("hub", "other")

    links = known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    every = components(links if keys is None else links.union(keys.select("doc_id", "key")))
    if keys is not None:
        every = every.join(keys.select(F.col("key").alias("node")), "node", "left_anti")
    sizes = every.groupBy("component").agg(F.count("*").alias("group_size"), F.min("node").alias("group_id")).where("group_size > 1")
    result = materialize(every.join(sizes, "component").select(F.col("node").alias("doc_id"), "group_id", "group_size"), "groups")
    for table in (found, heavy, lists, first, pick, tried, joined, apart, rest, known, left, crossing, last, asked_more, hopeful):
        drop_table(table)
    return result


def keep_one(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """``documents`` without the members of a group that don't stay; columns as they were."""
    name = fresh(documents, "gone")
    gone = groups.where(F.col("doc_id") != F.col("group_id")).select(F.col("doc_id").alias(name))
    return documents.join(small(gone), documents["doc_id"] == F.col(name), "left_anti")
