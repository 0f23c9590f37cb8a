"""Toxic spans by a linear-chain conditional random field.

Labels are per document, so token labels are drawn from them first: a word is
taken as toxic where the labelled toxic documents hold it far more often than
the clean ones (log odds over the training sample), and marked inside toxic
documents only. The two-state field (clean, toxic) has weights for the word, its
prefix, its neighbours and the step between states; full-batch gradient ascent
on the exact conditional likelihood fits it on a bounded sample of labelled rows
(``max_rows``, a documented parameter; the rest of the operator covers all rows).

Tagging runs forward-backward over every sentence of every whole text. A
sentence ends at a line break or at ``. ! ?`` and may have any length: chains are
cut into segments, whose transfer matrices give each segment its exact incoming
messages, so that all segments of a batch advance together, one vector step per
position. Offending tokens have a marginal of at least 0.5; a document's score is
the sum of their marginals (the expected number of toxic tokens among them, so that
length alone makes nothing toxic), ``peak`` is its highest marginal, ``toxic`` says
whether the score reaches the one that erred least on the training rows, and
spans are maximal runs of offending tokens as character offsets [start, end).

Defined results
  * null or empty text, or one without a word -> score 0, peak 0, no spans, not toxic.
  * null or missing labels, and labels of unknown documents, are ignored; a
    document labelled twice counts as toxic if any label says so; labels of one
    kind only give a field that tags nothing.
  * repeated rows are scored one by one and kept; very long texts are read whole.
  * an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import give_back, text_chunks

#: A word, or the end of a sentence.
TOKEN = re.compile(r"\w+|[.!?\n]+")
ENDS = frozenset(".!?\n")
PREFIX = 5
#: Words of a segment of a chain, and characters of texts that are tagged at a time.
SEGMENT, BATCH_CHARS = 128, 3_000_000


@dataclass
class Field:
    """word -> row of ``weights``: as itself, as left neighbour, as right neighbour."""

    words: dict[str, int] = field(default_factory=dict)
    prefixes: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 3)))
    bias: float = -6.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    enough: float = 1.5


class Rows(dict):
    """word -> feature row, learned words first, then their prefix; 0 for the rest."""

    def __init__(self, model: Field):
        super().__init__(model.words)
        self.prefixes = model.prefixes
    def __missing__(self, word: str) -> int:
        low = word.lower()
        if low != word:
            value = self[low]
        elif word[0] in ENDS:
            value = -1
        else:
            value = self.prefixes.get(word[:PREFIX], 0) if len(word) >= PREFIX else 0
        if len(self) < 600_000:
            self[word] = value
        return value


def transfers(emit: np.ndarray, begin: np.ndarray, length: np.ndarray, opens: np.ndarray, step: np.ndarray) -> np.ndarray:
    """(segments, 2, 2): log weight of all paths through a segment, from the state before it to its last one.

    A segment that ``opens`` its chain has no state before it: both rows are alike.
    """
    order = np.argsort(-length, kind="stable")
    b, n = begin[order], length[order]
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    out = np.zeros((len(begin), 2, 2))
    for t, m in enumerate(live):
        if t == 0:
            out[:] = np.where(opens[order][:, None, None], 0.0, step[None])
        else:
            x = out[:m]
            out[:m] = np.logaddexp(x[:, :, :1] + step[0], x[:, :, 1:] + step[1])
        out[:m, :, 1] += emit[b[:m] + t][:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def marginals(emit: np.ndarray, begin: np.ndarray, length: np.ndarray, step: np.ndarray):
    """Posterior of the toxic state for each token, with the forward and backward log odds.

    ``emit`` is the log-odds of state 1 over state 0; chains are emit[begin:begin+length].
    Long chains are cut into segments; segments advance together, longest first, so
    those still running are a prefix.
    """
    pieces = np.maximum(1, -(-length // SEGMENT))
    chain = np.repeat(np.arange(len(length)), pieces)
    k = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    b, n = begin[chain] + k * SEGMENT, np.minimum(SEGMENT, length[chain] - k * SEGMENT)
    enter, leave = np.zeros(len(b)), np.zeros(len(b))  # log odds before the first token, and after the last
    many = np.flatnonzero(pieces[chain] > 1)
    if len(many):
        through = transfers(emit, b[many], n[many], k[many] == 0, step)
        place = np.full(len(b), -1, np.int64)
        place[many] = np.arange(len(many))
        first = (np.cumsum(pieces) - pieces)[pieces > 1]
        count = pieces[pieces > 1]
        # messages from segment to segment, all chains that still have one at once
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        alpha = through[place[first], 0]
        for j in range(1, int(count[0])):
            m = int(np.searchsorted(-count, -j, side="left"))
            alpha = alpha[:m] - alpha[:m].max(axis=1, keepdims=True)
            enter[first[:m] + j] = alpha[:, 1] - alpha[:, 0]
            x = through[place[first[:m] + j]]
            alpha = np.logaddexp(alpha[:, :1] + x[:, 0], alpha[:, 1:] + x[:, 1])
        beta = np.zeros((len(first), 2))
        for j in range(int(count[0]) - 1, 0, -1):
            m = int(np.searchsorted(-count, -j, side="left"))
            x = through[place[first[:m] + j]] + beta[:m, None, :]
            beta[:m] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            beta[:m] -= beta[:m].max(axis=1, keepdims=True)
            leave[first[:m] + j - 1] = beta[:m, 1] - beta[:m, 0]
    order = np.argsort(-n, kind="stable")
    b, n, enter, leave, later = b[order], n[order], enter[order], leave[order], k[order] > 0
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    fwd, back = np.empty(len(emit)), np.zeros(len(emit))
    for t, m in enumerate(live):
        at = b[:m] + t
        x = fwd[at - 1] if t else enter[:m]
        fwd[at] = emit[at]
        moved = np.logaddexp(step[0, 1], x + step[1, 1]) - np.logaddexp(step[0, 0], x + step[1, 0])
        fwd[at] += moved if t else np.where(later[:m], moved, 0.0)
    back[b + n - 1] = leave
    for t in range(len(live) - 2, -1, -1):
        at = b[: live[t + 1]] + t
        x = back[at + 1] + emit[at + 1]
        back[at] = np.logaddexp(step[1, 0], x + step[1, 1]) - np.logaddexp(step[0, 0], x + step[0, 1])
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-(fwd + back))), fwd, back


def pair_sums(emit, fwd, back, begin, weight, step) -> np.ndarray:
    """Expected number of each step between states."""
    inner = np.ones(len(emit), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    x, y = fwd[at - 1], back[at] + emit[at]
    logs = np.stack([np.full(len(at), step[0, 0]), y + step[0, 1], x + step[1, 0], x + y + step[1, 1]])
    logs -= logs.max(axis=0)
    p = np.exp(logs)
    return (p / p.sum(axis=0) * weight[at]).sum(axis=1).reshape(2, 2)


def neighbours(rows: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows to the left and to the right inside each chain, 0 beyond its ends."""
    left, right = np.zeros_like(rows), np.zeros_like(rows)
    left[1:], right[:-1] = rows[:-1], rows[1:]
    left[begin] = 0
    right[begin[1:] - 1] = 0
    return left, right


def token_labels(texts: list[list[str]], toxic: np.ndarray, odds: float, min_docs: int) -> set[str]:
    """Words (and 5-letter prefixes, marked ``^``) that toxic documents hold far more often."""
    hot, cold = Counter(), Counter()
    for tokens, bad in zip(texts, toxic):
        kinds = {t.lower() for t in tokens if t[0] not in ENDS}
        kinds |= {"^" + k[:PREFIX] for k in kinds if len(k) >= PREFIX}
        (hot if bad else cold).update(kinds)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    return {
        w
        for w, c in hot.items()
        if c >= max(min_docs, 0.01 * n1) and np.log((c + 0.5) / (n1 + 1)) - np.log((cold[w] + 0.5) / (n0 + 1)) >= odds
    }


def fit(
    texts: list[str], toxic: list[bool], odds: float = 3.0, min_docs: int = 5, rounds: int = 150, l2: float = 0.02
) -> Field:
    """Fit the field on some labelled texts, on the driver.

    Copies and near copies of a text count once, or the words of one much-copied
    toxic text would all pass for toxic. Chains that read alike (most hold no learned
    word, and differ by length alone) are run once and weighted by their number,
    which leaves the likelihood exact.
    """
    kept, tokens, seen = [], [], set()
    for k, t in enumerate(texts):
        doc = TOKEN.findall(t or "")
        triples = {xxhash.xxh64_intdigest(f"{a} {b} {c}") for a, b, c in zip(doc, doc[1:], doc[2:])}
        sketch = sorted(triples)[:6]
        if not seen.intersection(sketch):
            kept.append(k)
            tokens.append(doc)
        seen.update(sketch)
    texts, bad = [texts[k] or "" for k in kept], np.array([bool(toxic[k]) for k in kept], bool)
    if not len(texts) or bad.all() or not bad.any():
        return Field(bias=-20.0)
    lexicon = token_labels(tokens, bad, odds, min_docs)
    names = sorted(w for w in lexicon if w[0] != "^")
    stems = sorted(w[1:] for w in lexicon if w[0] == "^")
    model = Field({w: k + 1 for k, w in enumerate(names)}, {p: len(names) + 1 + k for k, p in enumerate(stems)})
    size = 1 + len(names) + len(stems)
    lookup = Rows(model)
    kinds: Counter = Counter()
    for doc, is_bad in zip(tokens, bad):
        chain: list[int] = []
        for r in [*map(lookup.__getitem__, doc), -1]:
            if r >= 0:
                chain.append(r)
            if chain and r < 0:
                kinds[(bool(is_bad), bytes(np.array(chain, np.int32))) if any(chain) else (False, len(chain))] += 1
                chain = []
    parts = [(np.zeros(c, np.int64) if isinstance(c, int) else np.frombuffer(c, np.int32).astype(np.int64), b) for b, c in kinds]
    count = np.array(list(kinds.values()), float)
    length = np.array([len(p) for p, _ in parts], np.int64)
    begin = np.cumsum(length) - length
    rows = np.concatenate([p for p, _ in parts])
    gold = (rows > 0) & np.repeat([b for _, b in parts], length)
    weight = np.repeat(count, length)
    left, right = neighbours(rows, begin)
    inner = np.ones(len(rows), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    g = gold.astype(int)
    gold_steps = np.bincount(g[at - 1] * 2 + g[at], weight[at], minlength=4).reshape(2, 2)
    weights, bias, step = np.zeros((size, 3)), -4.0, np.zeros((2, 2))
    moments = [[np.zeros_like(weights), np.zeros_like(weights)], [0.0, 0.0], [np.zeros((2, 2)), np.zeros((2, 2))]]
    for k in range(1, rounds + 1):
        emit = weights[rows, 0] + bias + weights[left, 1] + weights[right, 2]
        post, fwd, back = marginals(emit, begin, length, step)
        miss = (gold - post) * weight
        grad_w = np.stack([np.bincount(f, miss, size) for f in (rows, left, right)], axis=1) - l2 * weights
        grad_w[0] = 0
        grad_s = gold_steps - pair_sums(emit, fwd, back, begin, weight, step) - l2 * step
        for i, grad in enumerate((grad_w, miss.sum() - l2 * bias, grad_s)):
            m, v = moments[i]
            moments[i] = [0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2]
            move = 0.2 * (moments[i][0] / (1 - 0.9**k)) / (np.sqrt(moments[i][1] / (1 - 0.99**k)) + 1e-8)
            if i == 0:
                weights = weights + move
            elif i == 1:
                bias = bias + move
            else:
                step = step + move
    model.weights, model.bias, model.step = weights, float(bias), step
    # the score from which a document is toxic: the one that errs least on the training rows
    score = np.concatenate([tag(texts[k : k + 500], model, lookup)[0] for k in range(0, len(texts), 500)])
    errors = {t: int(((score >= t) != bad).sum()) for t in (0.5, 1.5, 2.5, 3.5)}
    model.enough = min(errors, key=lambda t: (errors[t], t))
    return model


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Field:
    """Fit on at most ``max_rows`` labelled documents: those with the smallest id hash."""
    y = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    rows = sorted(map(tuple, texts.join(F.broadcast(y), "doc_id").collect()))  # at most max_rows ids
    return fit([r[1] for r in rows], [r[2] == 1 for r in rows])


def tag(texts: list[str | None], model: Field, lookup: Rows):
    """(score, highest marginal, spans) of each text."""
    n = len(texts)
    score, top = np.zeros(n), np.zeros(n)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    rows = [np.fromiter(map(lookup.__getitem__, TOKEN.findall(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
    every = np.concatenate(rows or [np.zeros(0, np.int32)]).astype(np.int64)
    keep = every >= 0
    if not keep.any():
        return score, top, spans
    docs = np.repeat(np.arange(n), [len(r) for r in rows])
    place = np.concatenate([np.arange(len(r)) for r in rows])
    chain = np.cumsum(~keep)[keep]
    every, docs, place = every[keep], docs[keep], place[keep]
    begin = np.flatnonzero((np.diff(chain, prepend=-1) != 0) | (np.diff(docs, prepend=-1) != 0))
    length = np.diff(np.append(begin, len(every)))
    left, right = neighbours(every, begin)
    w = model.weights
    post, _, _ = marginals(w[every, 0] + model.bias + w[left, 1] + w[right, 2], begin, length, model.step)
    hot = post >= 0.5
    score = np.bincount(docs[hot], post[hot], n)
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    top[docs[first]] = np.maximum.reduceat(post, first)
    for d in np.unique(docs[hot]):
        flags = set(place[hot & (docs == d)].tolist())
        run: tuple[int, int] | None = None
        for k, m in enumerate(TOKEN.finditer(texts[d])):
            if k in flags:
                run = (run[0], m.end()) if run else m.span()
            elif run:
                spans[d].append(run)
                run = None
        if run:
            spans[d].append(run)
    return score, top, spans


def score(documents: DataFrame, model: Field, min_score: float | None = None) -> DataFrame:
    """(doc_id, toxicity, peak, spans, toxic) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.select("doc_id").dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        lookup = Rows(m)
        for frame in frames:
            every = [t if isinstance(t, str) else None for t in frame["text"].tolist()]
            for a, b in text_chunks(every, BATCH_CHARS):
                part = frame.iloc[a:b]
                total, top, spans = tag(every[a:b], m, lookup)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "toxicity": np.round(total, 6),
                        "peak": np.round(top, 6),
                        "spans": [[{"start": int(a), "end": int(b)} for a, b in s] for s in spans],
                        "toxic": total >= (m.enough if min_score is None else min_score),
                    }
                )

    return documents.select("doc_id", "text").mapInPandas(
        run,
        f"doc_id {kind}, toxicity double, peak double, spans array<struct<start:int,end:int>>, toxic boolean",
    )


def drop_toxic(documents: DataFrame, model: Field, min_score: float | None = None) -> DataFrame:
    """The rows of ``documents`` that aren't toxic, with all their columns, in one pass and without a join.

    Rows are judged one by one, so null ids and rows that share an id need no rule.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return keep_clean(batches, place, shared.value, min_score)

    return documents.mapInArrow(run, documents.schema)


def keep_clean(batches: Iterator[pa.RecordBatch], place: int, m: Field, min_score: float | None) -> Iterator[pa.RecordBatch]:
    """The rows whose text, in column ``place``, isn't toxic; the worker gives its memory back to the stage that follows."""
    give_back()
    lookup = Rows(m)
    for batch in batches:
        texts = batch.column(place).to_pylist()
        toxic = np.zeros(len(texts), bool)
        for a, b in text_chunks(texts, BATCH_CHARS):
            score, _, _ = tag(texts[a:b], m, lookup)
            toxic[a:b] = score >= (m.enough if min_score is None else min_score)
        yield batch.filter(pa.array(~toxic))
    batch = texts = lookup = None
    give_back()
