"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of 32 words at every 16th word, of documents and of benchmark
items) are TF-IDF vectors over hashed words, all of them counted. A randomised
decomposition finds their leading latent directions in one distributed pass: each
passage is added, with random signs, to two rows of a sparse sketch of the whole
passage-term matrix; the sketches of tasks are added up as a tree of bounded
fan-in, by slices, and the singular vectors of the small sum, on the driver, span
the latent space. Everything shared or collected has the size of the hashed
vocabulary times the rows of the sketch, whatever the number of passages. Passages
and items are projected, scaled by the singular values and compared by cosine, all
against all, as matrix products; the bar falls with the length of items shorter
than a passage. Candidates are then settled on the words themselves: the longest
common subsequence of the item with the stretch of the document around the
candidate, and the answer (the item's last words).

A document is contaminated by an item if the common subsequence holds at least
``min_lcs`` of the item's words and at least half of its answer, or
``without_answer`` of the words whatever the answer.

Defined results
  * words are lower-case runs of letters, digits and non-ASCII characters.
  * null and empty texts match nothing; items with null id or text, or without a
    word, are left out. Some words of an item of fewer than ``verbatim_words`` words
    stand anywhere by chance: such an item counts where all its words stand in a row.
  * repeated item ids are compared text by text and reported once, by the best;
    rows of one document id are reported once, by the best; null document ids are
    left out. Ids are whole numbers; other types are refused.
  * a pair is reported once, with its best stretch; equal ones go to the first.
  * empty documents or an empty benchmark give an empty table; texts are read
    whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BASE, fresh, give_back, materialize, mix, rolling, small, text_chunks, word_hashes

#: Hashed vocabulary, slices in which its sums are added up, words of half a passage.
TERMS, SLICES, HALF = 1 << 15, 64, 16
#: Partial sums that one task adds up, and rows of the sketch beyond the rank.
FAN, MORE_ROWS = 16, 32
#: Benchmark items compared at a time; a larger benchmark takes several passes.
ITEMS = 20_000


def halves(h: np.ndarray, counts: np.ndarray):
    """Half passages of all texts: first word of each (among all), its text, and whether the next follows on."""
    n = -(-counts // HALF)
    of = np.repeat(np.arange(len(counts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(np.cumsum(counts) - counts, n) + k * HALF
    return begin, of, k, k + 1 < np.repeat(n, n)


def term_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(49)).astype(np.int64)


def entries(h: np.ndarray, counts: np.ndarray):
    """The distinct terms of each half passage, in rows of HALF padded with TERMS, with what ``halves`` says of them."""
    begin, of, k, follows = halves(h, counts)
    half = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
    place = np.full((len(begin), HALF), TERMS, np.int32)
    place[half, np.arange(len(h)) - begin[half]] = term_of(h)
    place.sort(axis=1)
    again = np.zeros(place.shape, bool)
    np.equal(place[:, 1:], place[:, :-1], out=again[:, 1:])
    place[again] = TERMS
    return place, of, k, follows


def half_sums(padded: np.ndarray, place: np.ndarray, block: int = 1024) -> np.ndarray:
    """Sums of the terms' rows over each half passage: term by term over blocks that stay in the cache."""
    out = np.empty((len(place), padded.shape[1]), padded.dtype)
    by_term = np.ascontiguousarray(place.T)
    for at in range(0, len(place), block):
        part = by_term[:, at : at + block]
        total = padded[part[0]]
        for k in range(1, HALF):
            total += padded[part[k]]
        out[at : at + block] = total
    return out


@dataclass
class Space:
    """term -> latent coordinates, weighted by idf and scaled by the singular values; a last row of zeros pads."""

    basis: np.ndarray

    def project(self, h: np.ndarray, counts: np.ndarray):
        """(first word in its text, text, unit latent vector) of every passage."""
        if not len(h):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros((0, self.basis.shape[1]), np.float32)
        place, of, k, follows = entries(h, counts)
        z = half_sums(self.basis, place)
        # a last half alone is a passage only where it is the whole text
        use = np.flatnonzero(follows | (k == 0))
        more = follows[use]
        both = z[use]
        both[more] += z[use[more] + 1]
        both /= np.maximum(np.sqrt((both * both).sum(1)), 1e-9)[:, None]
        return k[use] * HALF, of[use], both


def _summed(docs: DataFrame, rows: int, kind: type, add) -> np.ndarray:
    """rows x TERMS: what ``add(total, ids, hashes, counts)`` adds up over all texts, task by task, then as a tree."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()  # what the stage before took
        total = np.zeros((TERMS, rows), kind)
        for f in frames:
            texts, ids = f["text"].tolist(), f["doc_id"].to_numpy(np.int64)
            for a, b in text_chunks(texts):
                h, counts = word_hashes(texts[a:b])
                if len(h):
                    add(total, ids[a:b], h, counts)
        yield pd.DataFrame({"slice": range(SLICES), "data": [p.tobytes() for p in np.split(total, SLICES)]})

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(TERMS // SLICES * rows, np.float64)
        for b in f["data"]:
            total += np.frombuffer(b, kind)
        return pd.DataFrame({"slice": f["slice"][:1], "part": f["part"][:1] // FAN, "data": [total.astype(kind).tobytes()]})

    parts = docs.select("doc_id", "text").mapInPandas(run, "slice int, data binary").withColumn("part", F.spark_partition_id())
    left = docs.rdd.getNumPartitions()
    while True:
        parts = parts.groupBy("slice", F.floor(F.col("part") / FAN)).applyInPandas(merge, "slice int, part int, data binary")
        left = -(-left // FAN)
        if left <= 1:
            break
    got = parts.toPandas()
    if not len(got):
        return np.zeros((TERMS, rows))
    return np.concatenate([np.frombuffer(b, kind) for b in got.sort_values("slice")["data"]]).reshape(TERMS, rows).astype(np.float64)


def learn(docs: DataFrame, rank: int = 80) -> Space:
    """Document frequencies, then the randomised decomposition, each one pass over all of ``docs`` (doc_id, text).

    A term counts once in a half passage, and passages have unit length, or a few
    stuttering texts would take the leading directions.
    """

    def count(total, ids, h, counts):
        place = entries(h, counts)[0]
        total[:, 0] += np.bincount(place.ravel(), minlength=TERMS + 1)[:TERMS]
        total[0, 1] += len(place)

    df, n = _summed(docs, 2, np.float64, count).T
    n = max(n[0], 1.0)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32)
    width = rank + MORE_ROWS
    shared = docs.sparkSession.sparkContext.broadcast(np.append(idf, np.float32(0)))

    def sketch(total, ids, h, counts):
        place, of, k, _ = entries(h, counts)
        weight = shared.value[place]
        # passages without overlap: pairs of halves, of unit length
        first = np.flatnonzero(k % 2 == 0)
        size = np.sqrt(np.add.reduceat((weight**2).sum(1), first))
        passage = np.cumsum(k % 2 == 0) - 1
        weight /= np.maximum(size, np.float32(1e-9))[passage][:, None]
        half, column = np.nonzero(place < TERMS)
        term, weight = place[half, column].astype(np.int64) * width, weight[half, column]
        # two rows and two signs, drawn for each passage of each document
        dice = mix(ids[of[first]].astype(np.uint64) * np.uint64(BASE) + k[first].astype(np.uint64) + np.uint64(1))
        flat = total.reshape(-1)
        for shift in (0, 24):
            row = ((dice >> np.uint64(shift)) % np.uint64(width)).astype(np.int64)
            sign = 1 - 2 * (dice >> np.uint64(60 + shift // 24) & np.uint64(1)).astype(np.float32)
            np.add.at(flat, term + row[passage[half]], weight * sign[passage[half]])

    return Space(_basis(_summed(docs, width, np.float32, sketch), idf, rank))


def _basis(sketch: np.ndarray, idf: np.ndarray, rank: int) -> np.ndarray:
    """The leading directions of the sketch (terms x rows), each divided by its singular value."""
    u, s, _ = np.linalg.svd(sketch, full_matrices=False)
    ok = (s > max(s[0], 1e-12) * 1e-4) & (np.arange(len(s)) < rank)
    if not ok.any():
        return np.zeros((TERMS + 1, 1), np.float32)
    basis = (u[:, ok] / s[ok] * s[0] * idf[:, None]).astype(np.float32)
    return np.concatenate([basis, np.zeros((1, basis.shape[1]), np.float32)])


class Item:
    """A benchmark item ready for the bit-parallel longest common subsequence."""

    def __init__(self, h: np.ndarray, answer_words: int):
        self.n = len(h)
        self.masks: dict[int, int] = {}
        for k, w in enumerate(h.tolist()):
            self.masks[w] = self.masks.get(w, 0) | 1 << k
        self.full = (1 << self.n) - 1
        self.answer = h[-answer_words:].tolist()

    def common(self, words: list[int]) -> int:
        v = self.full
        for w in words:
            m = self.masks.get(w)
            if m is not None:
                u = v & m
                v = ((v + u) | (v - u)) & self.full
        return self.n - v.bit_count()

    def common_all(self, where: tuple, known: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, share: float) -> np.ndarray:
        """``common`` of every stretch [lo, hi) of ``h``, together; 0 where too few words of the item are there for ``share`` of it.

        ``known`` holds the words of all items, and ``where`` what ``uses`` says of them.
        """
        place, order, starts = where
        out = np.zeros(len(lo), np.int64)
        own = np.searchsorted(known, np.array(list(self.masks), np.uint64))
        hits = np.sort(np.concatenate([order[starts[w] : starts[w + 1]] for w in own.tolist()]))
        # a subsequence is no longer than the stretch has words of the item
        first, last = np.searchsorted(hits, lo), np.searchsorted(hits, hi)
        rest = np.flatnonzero((last - first) / self.n >= share)
        if self.n > 64 or not len(rest):
            for x in rest.tolist():
                out[x] = self.common(h[hits[first[x] : last[x]]].tolist())
            return out
        masks = np.zeros(len(known) + 1, np.uint64)
        masks[own] = np.array(list(self.masks.values()), np.uint64)
        bits = np.append(masks[place[hits]], np.uint64(0))
        # nor than the places in the item that these words have
        there = np.bitwise_or.reduceat(bits, np.stack([first[rest], last[rest]], 1).ravel())[::2]
        rest = rest[(first[rest] < last[rest]) & (np.bitwise_count(there) / self.n >= share)]
        rest = rest[np.argsort(first[rest] - last[rest], kind="stable")]  # the longest first
        first, last = first[rest], last[rest]
        v = np.full(len(rest), self.full, np.uint64)
        longest = int(last[0] - first[0]) if len(rest) else 0
        for k, active in enumerate(np.searchsorted(first - last, -np.arange(longest)).tolist()):
            w = v[:active]
            u = w & bits[first[:active] + k]
            v[:active] = (w + u) | (w - u)
        out[rest] = self.n - np.bitwise_count(v & np.uint64(self.full)).astype(np.int64)
        return out

    def answered(self, words: list[int]) -> float:
        rows = [0] * (len(self.answer) + 1)
        for w in words:
            if w in self.masks:
                last = 0
                for k, a in enumerate(self.answer):
                    keep = rows[k + 1]
                    rows[k + 1] = last + 1 if a == w else max(keep, rows[k])
                    last = keep
        return rows[-1] / len(self.answer)


def uses(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The place in ``known`` of each word of ``h`` (behind it for others), the words by that place, and where each place's begin."""
    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
    place[known[place] != h] = len(known)
    order = np.argsort(place, kind="stable").astype(np.int32)
    return place, order, np.searchsorted(place[order], np.arange(len(known) + 1)).tolist()


def settled_once(item: np.ndarray, passage: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates (item, passage) in any order, those to settle: of adjoining passages every other one, for its stretch holds the next. ``of``: each passage's text."""
    key = np.sort(item * np.int64(len(of)) + passage)
    item, passage = np.divmod(key[np.append(True, key[1:] != key[:-1])[: len(key)]], max(1, len(of)))
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (passage[1:] != passage[:-1] + 1) | (of[passage[1:]] != of[passage[:-1]])
    order = np.arange(len(item))
    use = (order - np.maximum.accumulate(np.where(new, order, 0))) % 2 == 0
    return item[use], passage[use]


def contaminated(documents: DataFrame, benchmark: DataFrame, min_cosine: float = 0.45, min_lcs: float = 0.6,
                 without_answer: float = 0.8, answer_words: int = 5, verbatim_words: int = 8, rank: int = 80,
                 space: Space | None = None) -> DataFrame:
    """(doc_id, item_id, lcs_ratio, answer_ratio, word): contaminated documents, by which item, where."""
    spark = documents.sparkSession
    for df, name in ((documents, "doc_id"), (benchmark, "item_id")):
        kind = dict(df.select(name).dtypes)[name]
        if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
            raise ValueError(f"{name} must be a whole number, not {kind}")
    docs = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    schema = "doc_id long, item_id long, lcs_ratio double, answer_ratio double, word long"
    known = benchmark.where(F.col("item_id").isNotNull() & (F.length("text") > 0))
    known = known.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    # the benchmark is read block by block, so that one block of it is on the driver at a time
    blocks = max(1, -(-known.count() // ITEMS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for k in range(blocks):
        rows = sorted(map(tuple, known.where(block == k).collect()))
        h, counts = word_hashes([t for _, t in rows])
        ends = np.cumsum(counts)
        items = [(i, h[e - c : e]) for (i, _), c, e in zip(rows, counts, ends) if c]
        if not items:
            continue
        space = space or learn(docs, rank)
        sizes = np.array([len(w) for _, w in items])
        _, of, z = space.project(np.concatenate([w for _, w in items]), sizes)
        bar = (min_cosine * np.sqrt(np.minimum(sizes, 2 * HALF) / (2 * HALF))).astype(np.float32)
        bar[sizes < verbatim_words] = 2
        short = [j for j, size in enumerate(sizes) if size < verbatim_words]
        runs = {n: {int(rolling(items[j][1], n)[0]): j for j in short if sizes[j] == n} for n in {int(sizes[j]) for j in short}}
        same: dict[int, list[int]] = {}
        for j in short:
            same.setdefault(runs[int(sizes[j])][int(rolling(items[j][1], int(sizes[j]))[0])], []).append(j)
        shared = spark.sparkContext.broadcast((space, [i for i, _ in items], [w for _, w in items], of, z, bar[of], runs, same))
        part = docs.mapInPandas(_search(shared, min_lcs, without_answer, answer_words), schema)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.max_by(F.struct("lcs_ratio", "answer_ratio", "word"), F.struct("lcs_ratio", "answer_ratio", -F.col("word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _search(shared, min_lcs: float, without_answer: float, answer_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, ids, words, item_of, goal, bar, runs, same = shared.value
        items: dict[int, Item] = {}
        goal = np.ascontiguousarray(goal.T)
        known = np.unique(np.concatenate(words))
        for f in frames:
            texts, doc_ids = f["text"].tolist(), f["doc_id"].to_numpy()
            out = []
            for a, b in text_chunks(texts):
                h, counts = word_hashes(texts[a:b])
                at, of, z = space.project(h, counts)
                begin = np.cumsum(counts) - counts
                for n, said in runs.items():
                    grams = rolling(h, n)
                    for p in np.flatnonzero(np.isin(grams, np.array(list(said), np.uint64))).tolist():
                        d = int(np.searchsorted(begin, p, side="right")) - 1
                        while counts[d] == 0:
                            d -= 1
                        if p + n <= begin[d] + counts[d]:
                            out += [(int(doc_ids[a + d]), ids[j], 1.0, 1.0, p - int(begin[d])) for j in same[said[int(grams[p])]]]
                step = max(1, 4_000_000 // goal.shape[1])
                found = [np.zeros((2, 0), np.int64)]
                for p in range(0, len(z), step):
                    i, j = np.divmod(np.flatnonzero(z[p : p + step] @ goal >= bar), len(bar))
                    found.append(np.stack([item_of[j], p + i]))
                item_at, spot = settled_once(*np.concatenate(found, 1), of)
                if not len(spot):
                    continue
                where = uses(known, h)
                cuts = np.append(np.flatnonzero(np.append(True, item_at[1:] != item_at[:-1])), len(spot))
                for first, last in zip(cuts[:-1], cuts[1:]):
                    k = int(item_at[first])
                    item = items.get(k)
                    if item is None:
                        item = items[k] = Item(words[k], answer_words)
                    d, w = of[spot[first:last]], at[spot[first:last]]
                    lo, hi = begin[d] + np.maximum(0, w - item.n), begin[d] + np.minimum(counts[d], w + 2 * HALF + item.n)
                    common = item.common_all(where, known, h, lo, hi, min_lcs)
                    for x in np.flatnonzero(common / item.n >= min_lcs).tolist():
                        lcs = int(common[x]) / item.n
                        answer = item.answered(h[lo[x] : hi[x]].tolist())
                        if answer >= 0.5 or lcs >= without_answer:
                            out.append((int(doc_ids[a + d[x]]), ids[k], lcs, answer, int(w[x])))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "lcs_ratio", "answer_ratio", "word"])
        f = texts = h = at = z = where = found = None
        give_back()

    return run


def drop_contaminated(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """``documents`` without the contaminated ones; columns as they were."""
    name = fresh(documents, "gone")
    gone = materialize(pairs.select(F.col("doc_id").alias(name)).distinct(), "gone")
    return documents.join(small(gone), documents["doc_id"] == F.col(name), "left_anti")
