"""Language identification by prediction by partial matching.

Training counts, per language, which byte followed which context of up to
``order`` bytes in a bounded sample of labelled texts. The statistics are then
frozen: a byte's code length in its longest known context is
``-log2(count / (total + distinct))``; a byte unseen there costs an escape,
``-log2(distinct / (total + distinct))``, and is coded in the next shorter
context, down to a uniform code over 256 bytes (method C, without exclusion).
A text goes to the language that codes all its bytes in the fewest bits.

Frozen statistics make a byte's cost a function of its context alone, so the
trees of all languages are laid out as one table (context node x byte class),
exact and independent of the number of texts; scoring is two array reads a byte.
Bytes that training never saw share one class: they cost the same everywhere.

Defined results
  * null text -> null language and null bits; empty text -> 0 bits, null language.
  * equal code lengths go to the language that sorts first.
  * texts are coded whole; repeated rows are answered one by one and kept.
  * an empty table gives an empty table; training rows with null label, null or
    empty text are ignored; without any labelled text the model is refused.
  * columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass
class Model:
    langs: list[str]
    order: int
    classes: np.ndarray  # byte -> class, 0 for bytes never seen
    node: np.ndarray  # the last `order` classes, packed -> node
    cost: np.ndarray  # node x class x language, bits

    def bits(self, texts: list[str | None]) -> np.ndarray:
        """Code lengths, texts x languages, of the UTF-8 bytes of each text."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        lengths = np.array([len(b) for b in raw], np.int64)
        out = np.zeros((len(raw), len(self.langs)))
        if not lengths.sum():
            return out
        n = int(self.classes.max()) + 1
        sym = self.classes[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(lengths)
        begins = ends - lengths
        since = np.arange(len(sym), dtype=np.int64) - np.repeat(begins, lengths)
        # n stands for "before the text", as a class of its own that only contexts have
        key = np.zeros(len(sym), np.int64)
        for k in range(self.order, 0, -1):
            back = np.full(len(sym), n, np.int64)
            back[k:] = sym[:-k]
            back[since < k] = n
            key = key * (n + 1) + back
        row = self.node[key].astype(np.int64) * n + sym
        flat = self.cost.reshape(-1, len(self.langs))
        filled = lengths > 0
        for lang in range(len(self.langs)):
            out[filled, lang] = np.add.reduceat(flat[row, lang].astype(np.float64), begins[filled])
        return out


def fit(labelled: dict[str, list[str]], order: int = 3) -> Model:
    """The model of some texts by language."""
    langs = sorted(labelled)
    if not langs:
        raise ValueError("there is no labelled text to learn languages from")
    raw = {lang: [t.encode("utf-8", "replace") for t in labelled[lang] if t] for lang in langs}
    seen = np.zeros(256, bool)
    for texts in raw.values():
        seen[np.frombuffer(b"".join(texts), np.uint8)] = True
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, seen.sum() + 1)
    n = int(seen.sum()) + 1
    # contexts are packed classes, the latest byte least significant; n is "before the text"
    tables: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
    by_order: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
    for lang in langs:
        for k in range(order + 1):
            keys = []
            for b in raw[lang]:
                s = classes[np.frombuffer(b, np.uint8)]
                s = np.concatenate([np.full(order, n, np.int64), s])
                key = np.zeros(len(s) - order, np.int64)
                for back in range(k, 0, -1):
                    key = key * (n + 1) + s[order - back : len(s) - back]
                keys.append(key * (n + 1) + s[order:])
            uniq, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            by_order[k].append((uniq // (n + 1), uniq % (n + 1), count))
    del tables
    base = 8.0  # bits of one byte of 256
    shorter = np.full((1, n, len(langs)), base)
    node_of: np.ndarray | None = None  # packed shorter context -> row of `shorter`
    for k in range(order + 1):
        contexts = np.unique(np.concatenate([c for c, _, _ in by_order[k]]))
        # the row of each context in the next shorter table, reached by forgetting its oldest byte
        parent = np.zeros(len(contexts), np.int64) if node_of is None else node_of[contexts % ((n + 1) ** (k - 1))]
        cost = shorter[parent].copy()
        for lang, (ctx, sym, count) in enumerate(by_order[k]):
            at = np.searchsorted(contexts, ctx)
            total = np.bincount(at, count, len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            known = total > 0
            escape = np.zeros(len(contexts))
            escape[known] = -np.log2(kinds[known] / (total[known] + kinds[known]))
            cost[:, :, lang] += escape[:, None]
            cost[at, sym, lang] = -np.log2(count / (total[at] + kinds[at]))
        # every packed context of this order: its own row, or that of its longest known suffix
        size = (n + 1) ** k
        nodes = np.zeros(size, np.int32) if node_of is None else np.tile(node_of, n + 1)
        stacked = np.concatenate([shorter, cost]) if k else cost
        nodes[contexts] = np.arange(len(contexts)) + (len(shorter) if k else 0)
        node_of, shorter = nodes, stacked
    return Model(langs, order, classes, node_of, shorter.astype(np.float32))


def train(documents: DataFrame, order: int = 3, texts_per_language: int = 400) -> Model:
    """Learn from at most ``texts_per_language`` labelled rows of each language.

    The bound is the only sample: the rows with the smallest id hash, so the
    choice doesn't depend on partitioning. Ids alone pass the window (its group
    limit prunes before the shuffle); the texts then come by a semi join.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = known.select("doc_id", "lang").withColumn("n_", rank).where(F.col("n_") <= texts_per_language)
    picked = picked.select("doc_id").distinct()  # at most texts_per_language ids a language
    rows = known.join(F.broadcast(picked), "doc_id", "left_semi").select("lang", "text").collect()
    by: dict[str, list[str]] = {}
    for lang, text in sorted(rows):
        by.setdefault(lang, []).append(text)
    return fit(by, order)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, bits, bits_per_byte, margin_bits) of every row; margin: bits to the runner-up."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.select("doc_id").dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in frames:
            texts = [None if t is None or t is pd.NA or t != t else t for t in frame["text"].tolist()]
            size = np.array([0 if t is None else len(t.encode("utf-8", "replace")) for t in texts])
            bits = np.zeros((len(texts), len(m.langs)))
            at = 0
            while at < len(texts):  # a few MB at a time
                end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), 4_000_000)))
                bits[at:end] = m.bits(texts[at:end])
                at = end
            best = bits.argmin(axis=1) if len(texts) else np.zeros(0, int)
            low = bits[np.arange(len(texts)), best]
            second = np.partition(bits, 1, axis=1)[:, 1] if len(m.langs) > 1 else low
            some = size > 0
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "lang_pred": [m.langs[b] if s else None for b, s in zip(best, some)],
                    "bits": [None if t is None else v for t, v in zip(texts, np.round(low, 3))],
                    "bits_per_byte": [v / s if s else None for v, s in zip(low, size)],
                    "margin_bits": [v if s else None for v, s in zip(np.round(second - low, 3), some)],
                }
            )

    return documents.select("doc_id", "text").mapInPandas(
        run, f"doc_id {kind}, lang_pred string, bits double, bits_per_byte double, margin_bits double"
    )
