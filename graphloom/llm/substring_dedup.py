"""Substring dedup: passages that repeat across documents, found by MinHash banding.

Two passes. The first finds verbatim passages, the second edited paragraphs.

Verbatim passages begin and end in the middle of lines, so the paragraphs that
are compared are all runs of ``words`` (50) consecutive words, at every word of
every text. A paragraph's MinHash is the least hash of its word ``shingle``-grams;
one band of one row is enough, for verbatim paragraphs agree in it always. Adjacent
paragraphs mostly have their MinHash at the same place, so a text has about 23
times fewer band entries than words, and travels as those entries, each with the
32-bit fingerprints of its paragraphs.

Colliding paragraphs are verified: within a band, equal fingerprints stand for
equal word sequences (Jaccard 1, edit distance 0; 96 bits in all). That relation
is an equivalence, so classes are found by sorting, without pairs: the cost of a
passage that thousands of documents share is linear. A word is removed where it
lies in a paragraph that a document of smaller id has too, or in a line near one
of a document of smaller id, from the first to the last gram that both have (what
was put before or after stays); clusters are the connected components of
documents through both, named by their least id.

Paragraphs that meet an equal one of a smaller id in the same chunk of rows are
settled there, and only the first of them is sent on; a hot passage thus costs a
shard one entry per chunk, not one per document.

Edited paragraphs are lines of ``words`` words or more. ``choose_bands`` gives the
bands of ``ROWS`` MinHashes over their ``gram``-grams that meet at ``similarity``
with probability ``recall``; lines that meet are verified by the exact Jaccard of
their grams. Equal lines stand for each other. Every line is held against the
first of its band; the bands that this doesn't settle are then taken whole, a line
against all earlier ones at once by the grams it shares. A line that has too few of
its grams in others of its band, or loses all it shares already and is of the one
cluster, can change nothing and is left out.

Defined results
  * words are parted by ASCII white space; case and punctuation count.
  * null and empty texts, and texts of fewer than ``words`` words, lose nothing.
  * the document of the least id keeps a passage; a repeat within one document,
    or between rows of one id, is left alone; a null id takes no part. Ids are
    whole numbers; other types are refused.
  * an empty table gives an empty table; texts are read whole; ``cut`` returns
    the columns it got, in order, with ``n_chars`` renewed where it is present.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import (
    BASE, VISIBLE, VISIBLE_BYTES, fresh, give_back, long_rolling, materialize, mix, powers, rolling, small, text_chunks, word_hashes,
)
from graphloom.llm.components import components

#: MinHashes of a band of edited paragraphs.
ROWS = 2
LINE = np.dtype([("band", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u4")])
#: Paragraphs of a shard, and of one packed group before it is sent on.
SHARD_PARAGRAPHS, FLUSH_PARAGRAPHS = 3_000_000, 1_000_000
#: Lines of open bands of a task, about; shared grams looked at together.
TASK_LINES, BLOCK = 8_000, 2_000_000


def choose_bands(similarity: float, recall: float, rows: int = 1) -> int:
    """The least number of bands of ``rows`` MinHashes that finds pairs of a similarity with a probability."""
    hit = similarity**rows
    return 1 if hit >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """``best`` (np.minimum, np.maximum) over every run of n, by doubling."""
    out, size = x, 1
    while size * 2 <= n:
        out = best(out[: len(out) - size], out[size:])
        size *= 2
    return best(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1]) if size < n else out


def paragraphs(texts: list[str | None], words: int, shingle: int):
    """Of all texts: (text, first word, MinHash, fingerprint) of every paragraph, in order."""
    h, counts = word_hashes([t or "" for t in texts], VISIBLE_BYTES, lower=False)
    none = np.zeros(0, np.int64)
    if len(h) < words:
        return none, none, none.astype(np.uint64), none.astype(np.uint32)
    low = sliding(rolling(h, shingle), words - shingle + 1, np.minimum)
    print_ = (long_rolling(h, words) >> np.uint64(32)).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), counts)
    whole = owner[: len(low)] == owner[words - 1 :]
    begin = np.cumsum(counts) - counts
    at = np.flatnonzero(whole)
    of = owner[at]
    return of, at - begin[of], low[at], print_[at]


def lines(texts: list[str | None], words: int, gram: int):
    """Of the lines of ``words`` words or more: (text, first word, words, fingerprint), their grams end to end, and where each line's begin."""
    parts = [(t or "").split("\n") for t in texts]
    h, counts = word_hashes([line for p in parts for line in p], VISIBLE_BYTES, lower=False)
    of = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    start = np.cumsum(counts) - counts
    head = start[np.searchsorted(of, np.arange(len(texts)))]
    big = np.flatnonzero(counts >= words)
    n, length = counts[big], counts[big] - gram + 1
    first = np.cumsum(length) - length
    at = np.repeat(start[big] - first, length) + np.arange(length.sum())
    power, inverse = powers(len(h))
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power, out=prefix[1:])
    print_ = mix((prefix[start[big] + n] - prefix[start[big]]) * inverse[start[big]] + n.astype(np.uint64))
    return of[big], start[big] - head[of[big]], n, print_, rolling(h, gram)[at], first


def bands_of(grams: np.ndarray, first: np.ndarray, bands: int) -> np.ndarray:
    """(bands, lines): the keys of every line's bands."""
    seeds = np.random.default_rng(1).integers(1, 1 << 63, (bands * ROWS, 2), dtype=np.uint64)
    out = np.zeros((bands, len(first)), np.uint64)
    for k, (salt, odd) in enumerate(seeds):
        least = np.minimum.reduceat((grams ^ salt) * (odd | np.uint64(1)), first)
        out[k // ROWS] = mix(out[k // ROWS] * np.uint64(BASE) + least + np.uint64(k))
    return out


def earliest(r: np.ndarray) -> np.ndarray:
    """Of equal lines in a band, those of the least document: the others lose their words verbatim."""
    r = r[np.lexsort((r["at"], r["doc"], r["print"], r["band"]))]
    new = np.ones(len(r), bool)
    new[1:] = (r["band"][1:] != r["band"][:-1]) | (r["print"][1:] != r["print"][:-1])
    least = r["doc"][np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))]
    return r[r["doc"] == least]


MEMBER = "struct<doc: bigint, at: bigint, n: bigint, print: bigint>"


def edited(docs: DataFrame, shards: int, words: int, gram: int, similarity: float, recall: float) -> DataFrame:
    """(doc_id, keeper, begin, n): the ``n`` words that lines of Jaccard ``similarity`` or more share with a line of an earlier document."""
    bands = choose_bands(similarity, recall, ROWS)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, ids = f["text"].tolist(), f["doc_id"].to_numpy(np.int64)
            for a, b in text_chunks(texts):
                of, at, n, print_, grams, first = lines(texts[a:b], words, gram)
                if not len(of):
                    continue
                r = np.zeros(bands * len(of), LINE)
                r["band"] = bands_of(grams, first, bands).ravel()
                for k, v in (("print", print_), ("doc", ids[a:b][of]), ("at", at), ("n", n)):
                    r[k] = np.tile(v, bands)
                r = earliest(r)
                shard = (r["band"] >> np.uint64(20)) % np.uint64(shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pd.DataFrame({"shard": some, "rows": [r[order[cuts[s] : cuts[s + 1]]].tobytes() for s in some]})
        f = texts = grams = r = order = None
        give_back()

    def gather(f: pd.DataFrame) -> pd.DataFrame:
        r = earliest(np.concatenate([np.frombuffer(b, LINE) for b in f["rows"]]))
        r = r[np.lexsort((r["at"], r["print"], r["doc"], r["band"]))]
        cuts = np.append(np.flatnonzero(np.append(True, r["band"][1:] != r["band"][:-1])), len(r))
        met = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if r["doc"][a] != r["doc"][b - 1]]
        fields = [r["doc"].tolist(), r["at"].tolist(), r["n"].tolist(), r["print"].view(np.int64).tolist()]
        names = ("doc", "at", "n", "print")
        members = [[dict(zip(names, m)) for m in zip(*(x[a:b] for x in fields))] for a, b in met]
        return pd.DataFrame({"band": r["band"].view(np.int64)[[a for a, _ in met]], "members": pd.Series(members, dtype=object)})

    found = docs.mapInPandas(index, "shard int, rows binary").groupBy("shard").applyInPandas(gather, f"band bigint, members array<{MEMBER}>")
    buckets = materialize(found.dropDuplicates(["members"]), "bands")
    each = buckets.select("band", F.explode("members").alias("m"))

    def gram_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            for a, b in text_chunks(texts):
                *_, print_, grams, first = lines(texts[a:b], words, gram)
                runs = np.split(grams, first[1:]) if len(first) else []
                yield pd.DataFrame({"print": print_.view(np.int64), "grams": [g.tobytes() for g in runs]})

    holders = docs.join(each.select(F.col("m.doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = holders.mapInPandas(gram_sets, "print bigint, grams binary")
    sets = materialize(sets.join(each.select("m.print").distinct(), "print", "left_semi").dropDuplicates(["print"]), "grams")

    def verify(pairs: DataFrame) -> DataFrame:
        """(doc_id, keeper, begin, n, at, of): what is removed of the line at ``at`` of ``of`` words."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for p, q, x, y in zip(f["p"], f["q"], f["x"], f["y"]):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    first, second = np.unique(x), np.unique(y)
                    both = np.intersect1d(first, second, assume_unique=True)
                    if len(both) >= similarity * (len(first) + len(second) - len(both)):
                        at = np.flatnonzero(np.isin(y, both))
                        out.append((p, q, at[0], at[-1] + gram - at[0]))
                yield pd.DataFrame(out, columns=["p", "q", "skip", "n"])

        pairs = pairs.where("a.doc < b.doc").distinct().select("a", "b", F.col("a.print").alias("p"), F.col("b.print").alias("q"))
        x, y = (sets.select(F.col("print").alias(k), F.col("grams").alias(v)) for k, v in (("p", "x"), ("q", "y")))
        near = pairs.select("p", "q").distinct().join(x, "p").join(y, "q").mapInPandas(run, "p bigint, q bigint, skip bigint, n bigint")
        hits = pairs.join(near, ["p", "q"])
        columns = {"doc_id": F.col("b.doc"), "keeper": F.col("a.doc"), "begin": F.col("b.at") + F.col("skip"), "n": F.col("n"), "at": F.col("b.at"), "of": F.col("b.n")}
        return materialize(hits.select(*[v.alias(k) for k, v in columns.items()]).distinct(), "near")

    star = verify(buckets.select(F.element_at("members", 1).alias("a"), F.explode("members").alias("b")))
    label = components(star.select(F.col("doc_id").alias("a"), F.col("keeper").alias("b")).distinct())
    # of every line the longest run of words that the first of a band takes
    taken = star.groupBy(F.col("doc_id").alias("doc"), "at", F.col("of").alias("n")).agg(F.max(F.struct("n", "begin")).alias("t"))
    taken = taken.select("doc", "at", "n", (F.col("t.begin") - F.col("at")).alias("lo"), (F.col("t.begin") - F.col("at") + F.col("t.n")).alias("hi"))
    known = each.select("band", "m.*").join(label.withColumnRenamed("node", "doc"), "doc", "left").join(taken, ["doc", "at", "n"], "left")
    known = known.withColumn("component", F.coalesce("component", "doc")).na.fill(0, ["lo", "hi"])
    known = materialize(known, "known")
    open_ = known.groupBy("band").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("doc").alias("least"), F.max(F.struct((F.col("hi") - F.col("lo") < F.col("n")).alias("left"), "doc")).alias("last")
    )
    open_ = open_.where((F.col("c0") != F.col("c1")) | (F.col("last")["left"] & (F.col("last")["doc"] > F.col("least")))).select("band")
    left = materialize(known.join(open_, "band", "left_semi"), "left")
    tasks = max(shards, math.ceil(left.count() / TASK_LINES))
    rows = left.join(sets, "print").withColumn("task", F.pmod(F.xxhash64("band"), F.lit(tasks)))
    run = lambda f: settle(f, gram, similarity)
    rest = rows.groupBy("task").applyInPandas(run, "doc_id long, keeper long, begin long, n long")
    return star.select("doc_id", "keeper", "begin", "n").union(rest).distinct()


def settle(f: pd.DataFrame, gram: int, similarity: float) -> pd.DataFrame:
    """(doc_id, keeper, begin, n) of the lines of whole bands: all that the near lines of earlier documents take of each, and a keeper of every cluster among them.

    A line that has fewer than ``similarity`` of its grams in other lines of its band is near none
    of them. Of those left, one whose shared grams lie in what is taken already, [lo, hi), in a band
    of one cluster, is settled. The others are held against all earlier lines at once, by their shared grams.
    """
    give_back()
    f = f.sort_values(["band", "doc", "at", "print"], kind="stable")
    doc, at, cluster, lo, hi = (f[c].to_numpy(np.int64) for c in ("doc", "at", "component", "lo", "hi"))
    band = np.unique(f["band"].to_numpy(), return_inverse=True)[1]
    sets = [np.frombuffer(b, np.uint64) for b in f["grams"]]
    length = np.array([len(x) for x in sets], np.int64)
    line, grams = np.repeat(np.arange(len(sets)), length), np.concatenate(sets)
    pos = np.arange(len(line)) - np.repeat(np.cumsum(length) - length, length)
    # a gram of a band, its lines in order, each with the gram's first and last place
    order = np.lexsort((pos, line, grams, band[line]))
    line, grams, pos = line[order], grams[order], pos[order]
    term = np.cumsum(np.append(True, (grams[1:] != grams[:-1]) | (band[line[1:]] != band[line[:-1]]))[: len(line)])
    head = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (line[1:] != line[:-1]))[: len(line)])
    first, last = pos[head], pos[np.append(head[1:], len(line)) - 1]
    line, term = line[head], term[head]
    size = np.bincount(line, minlength=len(sets))
    while True:
        many = np.bincount(term)[term] > 1
        alive = np.bincount(line[many], minlength=len(sets)) >= similarity * size - 1e-9
        keep = many & alive[line]
        if keep.all():
            break
        line, term, first, last = line[keep], term[keep], first[keep], last[keep]
    none = np.zeros(0, np.int64)
    out = [(none, none, none, none)]
    if len(line):
        begin = np.maximum.accumulate(np.where(np.append(True, term[1:] != term[:-1]), np.arange(len(line)), 0))
        met = np.flatnonzero(np.arange(len(line)) > begin)  # some earlier line has the gram
        a, b = np.full(len(sets), 1 << 40), np.full(len(sets), -1)
        np.minimum.at(a, line[met], first[met])
        np.maximum.at(b, line[met], last[met] + gram)
        used = np.unique(line)
        c0, c1 = np.full(band.max() + 1, np.iinfo(np.int64).max), np.full(band.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(c0, band[used], cluster[used])
        np.maximum.at(c1, band[used], cluster[used])
        unsettled = (b >= 0) & ((c0 != c1)[band] | (a < lo) | (b > hi))
        mine = met[np.argsort(line[met], kind="stable")]
        cuts = np.searchsorted(line[mine], np.arange(len(sets) + 1))
        start = np.searchsorted(band, band)
        for y in np.flatnonzero(unsettled):
            s, entries = start[y], mine[cuts[y] : cuts[y + 1]]
            both, low, high = np.zeros(y - s, np.int64), np.full(y - s, 1 << 40), np.full(y - s, -1)
            before = entries - begin[entries]
            for part in np.split(entries, np.flatnonzero(np.diff(np.cumsum(before) // BLOCK)) + 1):
                n = part - begin[part]
                x = line[np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(n.sum())] - s
                both += np.bincount(x, minlength=y - s)
                np.minimum.at(low, x, np.repeat(first[part], n))
                np.maximum.at(high, x, np.repeat(last[part] + gram, n))
            near = np.flatnonzero((both > 0) & (doc[s:y] < doc[y]) & (both >= similarity * (size[s:y] + size[y] - both)))
            if len(near):
                near = near[np.lexsort((-high[near], low[near]))]
                reach = np.maximum.accumulate(high[near])
                wider = np.append(True, high[near][1:] > reach[:-1])  # not within an earlier one
                wider[np.unique(cluster[s:y][near], return_index=True)[1]] = True
                near = near[wider]
                out.append((np.full(len(near), doc[y]), doc[s:y][near], at[y] + low[near], high[near] - low[near]))
    return pd.DataFrame(dict(zip(("doc_id", "keeper", "begin", "n"), (np.concatenate(x) for x in zip(*out)))))


def packed(held: list, shards: int) -> pd.DataFrame:
    """A row for each shard of some texts' paragraphs; takes them out of ``held``, and keeps no copy longer than needed."""
    columns = [list(x) for x in zip(*held)]
    held.clear()
    fp, low, at, doc = (np.concatenate(columns.pop()) for _ in range(4))
    # settle what meets an equal paragraph of a smaller id right here
    order = np.lexsort((doc, fp, low))
    first = np.ones(len(order), bool)
    first[1:] = (low[order][1:] != low[order][:-1]) | (fp[order][1:] != fp[order][:-1])
    leader = doc[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    over = leader < doc[order]
    settled = order[over]
    dup = np.zeros(len(doc), bool)
    dup[settled] = True
    keeper = np.empty(len(doc), np.int64)
    keeper[order] = leader
    del order, first, leader, over, settled
    # runs of adjacent paragraphs with one MinHash; a run that is settled throughout stays behind
    run = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (dup[1:] != dup[:-1])])
    begin = np.flatnonzero(run)
    length = np.diff(np.append(begin, len(doc)))
    # of each run its first paragraph says the rest
    low, doc, at, dup, keeper = (x[begin] for x in (low, doc, at, dup, keeper))
    shard = (low >> np.uint64(20)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    out: dict[str, list] = {"shard": [], "runs": [], "prints": [], "settled": []}
    kind = np.dtype([("low", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u4")])
    done = np.dtype([("doc", "<i8"), ("keeper", "<i8"), ("at", "<u4"), ("n", "<u4")])
    for s in np.flatnonzero(np.diff(cuts)):
        mine = order[cuts[s] : cuts[s + 1]]
        sent, kept = mine[~dup[mine]], mine[dup[mine]]
        r = np.zeros(len(sent), kind)
        r["low"], r["doc"], r["at"], r["n"] = low[sent], doc[sent], at[sent], length[sent]
        q = np.zeros(len(kept), done)
        q["doc"], q["keeper"], q["at"], q["n"] = doc[kept], keeper[kept], at[kept], length[kept]
        span = np.repeat(begin[sent], length[sent]) + np.arange(length[sent].sum())
        span -= np.repeat(np.cumsum(length[sent]) - length[sent], length[sent])
        out["shard"].append(int(s))
        out["runs"].append(r.tobytes())
        out["prints"].append(fp[span].tobytes())
        out["settled"].append(q.tobytes())
    return pd.DataFrame(out)


def repeats(
    documents: DataFrame, words: int = 50, shingle: int = 8, gram: int = 5, similarity: float = 0.5, recall: float = 0.99
) -> DataFrame:
    """(doc_id, begin, end, cluster_id): the runs of words [begin, end) that a document of smaller id has too, verbatim or edited."""
    spark = documents.sparkSession
    kind = dict(documents.select("doc_id").dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"doc_id must be a whole number, not {kind}")
    docs = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * words - 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    total = docs.select(F.sum(F.length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / 6 / SHARD_PARAGRAPHS))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()  # what the stage before took
        held, rows = [], 0
        for f in frames:
            texts, ids = f["text"].tolist(), f["doc_id"].to_numpy(np.int64)
            for a, b in text_chunks(texts):
                of, at, low, fp = paragraphs(texts[a:b], words, shingle)
                held.append((ids[a:b][of], at.astype(np.uint32), low, fp))
                rows += len(of)
                if rows >= FLUSH_PARAGRAPHS:
                    of = at = low = fp = None
                    yield packed(held, shards)
                    rows = 0
                    give_back()
        f = texts = of = at = low = fp = None
        if rows:
            yield packed(held, shards)
        give_back()

    def gather(f: pd.DataFrame) -> pd.DataFrame:
        kind = np.dtype([("low", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u4")])
        done = np.dtype([("doc", "<i8"), ("keeper", "<i8"), ("at", "<u4"), ("n", "<u4")])
        give_back()  # what the shard before took
        q = np.concatenate([np.frombuffer(b, done) for b in f["settled"]])
        r = np.concatenate([np.frombuffer(b, kind) for b in f["runs"]])
        fp = np.concatenate([np.frombuffer(b, np.uint32) for b in f["prints"]])
        length = r["n"].astype(np.int64)
        # only bands met twice can hold equal paragraphs
        order = np.argsort(r["low"], kind="stable")
        band = r["low"][order]
        same = np.zeros(len(r), bool)
        twin = band[1:] == band[:-1]
        same[order[1:][twin]] = True
        same[order[:-1][twin]] = True
        each = np.repeat(same, length)
        fp, r, length = fp[each], r[same], length[same]
        low, doc = np.repeat(r["low"], length), np.repeat(r["doc"], length)
        offset = np.arange(len(fp)) - np.repeat(np.cumsum(length) - length, length)
        at = np.repeat(r["at"].astype(np.int64), length) + offset
        order = np.lexsort((doc, fp, low))
        l, p, d = low[order], fp[order], doc[order]
        first = np.ones(len(order), bool)
        first[1:] = (l[1:] != l[:-1]) | (p[1:] != p[:-1])
        leader = d[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else d
        over = leader < d
        hit_doc, hit_at, hit_keep = d[over], at[order][over], leader[over]
        order = np.lexsort((hit_at, hit_doc))
        hit_doc, hit_at, hit_keep = hit_doc[order], hit_at[order], hit_keep[order]
        new = np.ones(len(order), bool)
        new[1:] = (hit_doc[1:] != hit_doc[:-1]) | (hit_at[1:] > hit_at[:-1] + 1) | (hit_keep[1:] != hit_keep[:-1])
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(order)))
        return pd.DataFrame(
            {
                "doc_id": np.concatenate([hit_doc[begin], q["doc"]]),
                "keeper": np.concatenate([hit_keep[begin], q["keeper"]]),
                "begin": np.concatenate([hit_at[begin], q["at"].astype(np.int64)]),
                "n": np.concatenate([n, q["n"].astype(np.int64)]),
            }
        )

    rows = docs.mapInPandas(index, "shard int, runs binary, prints binary, settled binary")
    found = rows.groupBy("shard").applyInPandas(gather, "doc_id long, keeper long, begin long, n long")
    near = edited(docs, shards, words, gram, similarity, recall).withColumn("n", F.col("n") - (words - 1))
    found = materialize(found.unionByName(near), "repeats")

    # overlapping and adjoining runs of a document become one span
    by_begin = Window.partitionBy("doc_id").orderBy("begin", "end")
    before = F.max("end").over(by_begin.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.select("doc_id", "begin", (F.col("begin") + F.col("n") + (words - 1)).alias("end"))
    spans = (
        runs.withColumn("opens", F.when(F.col("begin") <= before, 0).otherwise(1))
        .withColumn("span", F.sum("opens").over(by_begin.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "span")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    )
    clusters = components(found.select(F.col("doc_id").alias("a"), F.col("keeper").alias("b")).distinct())
    named = spans.join(clusters.withColumnRenamed("node", "doc_id"), "doc_id")
    return named.select("doc_id", "begin", "end", F.col("component").alias("cluster_id"))


def cut(documents: DataFrame, removals: DataFrame) -> DataFrame:
    """``documents`` without the removed words; the same columns in the same order."""
    name, spans = fresh(documents, "gone"), fresh(documents, "spans")
    per_doc = removals.groupBy(F.col("doc_id").alias(name)).agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias(spans))
    joined = documents.join(small(materialize(per_doc, "cuts")), documents["doc_id"] == F.col(name), "left").drop(name)

    def shorten(cuts, text):
        places = [m.span() for m in VISIBLE.finditer(text)]
        out, last = [], 0
        for s in cuts:
            if s["begin"] < len(places):
                out.append(text[last : places[s["begin"]][0]])
                last = places[min(s["end"], len(places)) - 1][1]
        out.append(text[last:])
        return "".join(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.copy()
            f["text"] = [None if t is None else shorten(s, t) for s, t in zip(f[spans], f["text"])]
            yield f.drop(columns=[spans])

    hit = joined.where(F.col(spans).isNotNull())
    rest = joined.where(F.col(spans).isNull()).drop(spans)
    changed = hit.mapInPandas(run, documents.schema)
    if "n_chars" in documents.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return rest.unionByName(changed)
