"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

A vocabulary file of ranks (base64 token, rank) gives the merge table: a token
of several bytes is the merge of the two tokens that its own bytes contract to
under lower ranks. Encoding hands the distinct pieces of a batch to DuckDB as
token-position rows; a recursive query joins neighbouring rows with the merge
table and contracts, in each word, the leftmost pair of the lowest rank, until
no pair of the word is in the table. Decoding joins tokens with the vocabulary
and puts their bytes end to end in order; texts are cut from them.

A merged token has a higher rank than its parts, so a contraction makes no new
pair of its own rank: the lowest pair is contracted again and again, leftmost
first, until it is gone. Words of many bytes therefore take all of its uses in
one round (``ENCODE_LONG``; of overlapping ones every other, from the left) and
keep only each row's latest state: as many rounds as distinct merges, and rows
as bytes, whatever the word's length.

Texts are whole; pieces repeat heavily, so a partition's distinct pieces are
contracted once and texts are put together from them. There is no shuffle; the merge table (the vocabulary's
size) is all that is shared, and what a worker remembers is bounded.

Defined results
  * null text -> null tokens, null count, null decoded text; empty text -> no tokens.
  * decoding null tokens gives null; a null or unknown token id is an error.
  * repeated rows are kept; an empty table gives an empty table; very long texts
    and words are whole; columns other than those named are ignored, whatever
    their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import regex
from pyspark.sql import DataFrame

from graphloom.llm.common import REMEMBERED, give_back
from graphloom.llm.segments import SegmentCoder

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes from which a word takes all uses of its lowest pair in one round.
LONG = 64
#: Texts of about so many characters make one batch; words, bytes of words, and tokens of one query.
BATCH_CHARS, QUERY_WORDS, QUERY_BYTES, QUERY_TOKENS = 2_500_000, 40_000, 1_000_000, 500_000
#: Pieces, and characters of pieces, that a worker remembers before it starts anew.
KNOWN, KNOWN_BYTES = 300_000, 10_000_000

ENCODE = """
WITH RECURSIVE s(round, w, p, t) AS (
  SELECT 0, w, g + w, t FROM start_rows
  UNION ALL
  (WITH best AS (
     SELECT a.w, min((m.merged::BIGINT << 36) + a.p) AS k
     FROM s a JOIN s b ON b.p = a.p + 1 JOIN merges m ON m.pair = (a.t::BIGINT << 31) + b.t GROUP BY a.w),
   cut AS (SELECT w, k & 68719476735 AS place, (k >> 36)::INTEGER AS merged FROM best)
   SELECT s.round + 1, s.w, s.p - (s.p > place)::BIGINT, CASE WHEN s.p = place THEN merged ELSE s.t END
   FROM s JOIN cut ON s.w = cut.w WHERE s.p <> place + 1)),
last AS (SELECT w, max(round) AS round FROM s GROUP BY w)
SELECT s.w, s.t FROM s JOIN last USING (w, round) ORDER BY s.w, s.p
"""

ENCODE_LONG = """
WITH RECURSIVE s(g, w, after, t, round) USING KEY (g) AS (
  SELECT g, w, CASE WHEN lead(w) OVER (ORDER BY g) = w THEN g + 1 END, t, 0 FROM start_rows
  UNION
  (WITH live AS (SELECT * FROM s WHERE t >= 0),
   near AS (
     SELECT a.g, a.w, b.g AS h, b.after, m.merged, a.t = b.t AS twins
     FROM live a JOIN live b ON a.after = b.g JOIN merges m ON m.pair = (a.t::BIGINT << 31) + b.t),
   least AS (SELECT w, min(merged) AS merged FROM near GROUP BY w),
   hit AS (SELECT near.* FROM near JOIN least USING (w, merged)),
   opens AS (SELECT *, lag(h) OVER (ORDER BY g) IS DISTINCT FROM g AS first FROM hit WHERE twins),
   runs AS (SELECT *, sum(first::INTEGER) OVER (ORDER BY g) AS run FROM opens),
   used AS (
     SELECT g, h, after, merged FROM hit WHERE NOT twins
     UNION ALL
     SELECT g, h, after, merged FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY g) AS n FROM runs) WHERE n % 2 = 1),
   change AS (SELECT g, after, merged FROM used UNION ALL SELECT h, NULL, -1 FROM used)
   SELECT live.g, live.w, CASE WHEN c.g IS NULL THEN live.after ELSE c.after END, coalesce(c.merged, live.t), live.round + 1
   FROM live JOIN least USING (w) LEFT JOIN change c ON live.g = c.g))
SELECT w, t FROM s WHERE t >= 0 ORDER BY g
"""

DECODE = """
SELECT bytes FROM token_rows JOIN vocabulary ON t = id ORDER BY p
"""


@dataclass
class Vocabulary:
    tokens: list[bytes]
    byte_ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    merged: np.ndarray


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    parts = [token[i : i + 1] for i in range(len(token))]
    limit = ranks[token]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], limit)) < limit]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def load(path: str = VOCABULARY) -> Vocabulary:
    """Read a rank file; ids are ranks, and the ids of merged tokens order the merges."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
    rows = []
    for token, rank in ranks.items():
        tokens[rank] = token
        if len(token) > 1:
            parts = _parts(token, ranks)
            if len(parts) == 2:
                rows.append((ranks[parts[0]], ranks[parts[1]], rank))
    m = np.array(rows, np.int32).reshape(-1, 3)
    return Vocabulary(tokens, np.array([ranks[bytes([b])] for b in range(256)], np.int32), m[:, 0], m[:, 1], m[:, 2])


class Bpe:
    """A worker's DuckDB session over the merge table and the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "120MB"})
        pairs = (vocabulary.left.astype(np.int64) << 31) + vocabulary.right
        self.db.register("merges_", pa.table({"pair": pairs, "merged": vocabulary.merged}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_")
        self.width = np.array([len(t) for t in vocabulary.tokens], np.int64)
        self.db.register("vocabulary_", pa.table({"id": np.arange(len(self.width), dtype=np.int32), "bytes": pa.array(vocabulary.tokens, pa.binary())}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_")
        self.db.unregister("merges_")
        self.db.unregister("vocabulary_")
        self.split = regex.compile(PATTERN).findall
        self.pieces: dict[str, bytes] = {}
        self.size = 0
        self.coder = SegmentCoder(self.encode_segments)

    def contract(self, words: list[bytes], query: str) -> list[bytes]:
        """Token ids (32-bit) of some words, by the recursive query."""
        length = np.array([len(w) for w in words], np.int64)
        flat = self.v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rows = pa.table(
            {"w": np.repeat(np.arange(len(words), dtype=np.int32), length), "g": np.arange(len(flat), dtype=np.int64), "t": flat}
        )
        self.db.register("start_rows", rows)
        got = self.db.execute(query).fetchnumpy()
        self.db.unregister("start_rows")
        cuts = (4 * np.searchsorted(np.asarray(got["w"]), np.arange(len(words) + 1))).tolist()
        ids = np.asarray(got["t"], np.int32).tobytes()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def contract_all(self, words: list[bytes]) -> Iterator[bytes]:
        """The same for any words, in order, in queries of bounded size."""
        kind = [len(w) > LONG for w in words]
        at = size = 0
        for k in range(len(words) + 1):
            if k > at and (k == len(words) or kind[k] != kind[at] or k - at == QUERY_WORDS or size + len(words[k]) > QUERY_BYTES):
                yield from self.contract(words[at:k], ENCODE_LONG if kind[at] else ENCODE)
                at, size = k, 0
            if k < len(words):
                size += len(words[k])

    def encode_segments(self, plain: list[str], others: list[str]) -> Iterator[bytes]:
        if len(self.pieces) > KNOWN or self.size > KNOWN_BYTES:
            self.pieces.clear()
            self.size = 0
        # plain segments begin with their only space, so they can be split as one text
        flat = self.split("".join(plain))
        starts = [k for k, p in enumerate(flat) if p[0] == " "]
        rest = [self.split(s) for s in others]
        every = {*flat}.union(*rest)
        new = list(every - self.pieces.keys())
        new.sort(key=len)
        self.size += sum(map(len, new))
        self.pieces.update(zip(new, self.contract_all([p.encode() for p in new])))
        for a, b in zip(starts, [*starts[1:], len(flat)]):
            yield self.pieces[flat[a]] if b == a + 1 else b"".join(map(self.pieces.__getitem__, flat[a:b]))
        for s in rest:
            yield b"".join(map(self.pieces.__getitem__, s))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of token ids that lie end to end, in queries of bounded size."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.v.tokens)):
            raise ValueError("a token id is not in the vocabulary")
        texts, ends = [""] * len(counts), np.cumsum(counts)
        a = 0
        while a < len(counts):
            first = int(ends[a] - counts[a])
            b = max(a + 1, int(np.searchsorted(ends, first + QUERY_TOKENS, side="right")))
            token = ids[first : ends[b - 1]]
            self.db.register("token_rows", pa.table({"p": np.arange(len(token), dtype=np.int64), "t": token}))
            flat = b"".join(map(laid_out, self.db.sql(DECODE).to_arrow_table().column(0).chunks))
            self.db.unregister("token_rows")
            cuts = np.append(0, np.cumsum(self.width[token]))[np.append(0, ends[a:b] - first)].tolist()
            texts[a:b] = [flat[i:j].decode("utf-8", "replace") for i, j in zip(cuts, cuts[1:])]
            a = b
        return texts


def laid_out(column: pa.Array) -> memoryview:
    """The bytes of a binary column, end to end."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0, 0]
    return memoryview(data or b"")[ends[0] : ends[-1]]


_sessions: dict[bytes, Bpe] = {}
REMEMBERED.append(_sessions)


def session(vocabulary: Vocabulary) -> Bpe:
    """This worker's session for a vocabulary; it outlives a task, and so do the pieces it has seen."""
    key = hashlib.blake2b(b"".join(vocabulary.tokens) + vocabulary.merged.tobytes()).digest()
    if key not in _sessions:
        _sessions.clear()
        _sessions[key] = Bpe(vocabulary)
    return _sessions[key]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, n in enumerate(pa.compute.utf8_length(texts).to_pylist()):
        size += n or 0
        if size >= BATCH_CHARS:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _lists(ids: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(null, False)), pa.array(ids, pa.int32()))


def encode(documents: DataFrame, vocabulary: Vocabulary | None = None, check: bool = False) -> DataFrame:
    """(doc_id, n_tokens, tokens) of every row; with ``check`` also ``round_trip``: decoding gave the text back."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary or load())
    slim = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = session(shared.value)
        for batch in batches:
            column = batch.column(1).cast(pa.string())
            for a, b in _chunks(column):
                texts = column.slice(a, b - a).to_pylist()
                null = np.array([t is None for t in texts], bool)
                full = [t or "" for t in texts]
                ids, counts = bpe.coder.encode_texts(full)
                columns = {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_tokens": pa.array(counts, pa.int64(), mask=null),
                    "tokens": _lists(ids, counts, null),
                }
                if check:
                    same = [x == y for x, y in zip(bpe.decode(ids, counts), full)]
                    columns["round_trip"] = pa.array(same, pa.bool_(), mask=null)
                yield pa.RecordBatch.from_pydict(columns)
        batch = column = texts = full = ids = columns = None
        give_back(_sessions)

    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, tokens array<int>" + ", round_trip boolean" * check)


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, text) of rows with ``doc_id`` and ``tokens``."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary or load())
    slim = encoded.select("doc_id", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = session(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column(1)
                null = np.array(lists.is_null())
                if lists.flatten().null_count:
                    raise ValueError("a token id is null")
                counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                texts = bpe.decode(np.asarray(lists.flatten(), np.int32), counts)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column(0), "text": pa.array([None if n else t for t, n in zip(texts, null)], pa.string())}
                )

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, text string")
