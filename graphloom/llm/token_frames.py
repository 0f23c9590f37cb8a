"""Token ids as seekable zstandard files: one independent frame per document.

A shard is a complete file. Frame 0 is its directory (the documents' ids, in
order); frame k holds the token ids of document k, little-endian, two bytes each
where the vocabulary fits them, else four. Every frame has a content checksum,
and the file ends in a skippable frame with the seek table: per frame the
compressed and the decompressed size and a 32-bit XXH64 checksum, then the
number of frames, a descriptor byte and the seekable magic number. A reader
takes the tail, the directory and the frames of the documents it wants, and
decompresses nothing else.

Encoding needs no shuffle; a task closes a shard when it reaches ``shard_bytes``,
so memory is bounded whatever a partition holds. Shards are returned as rows
(``write_shards`` stores them as files, renamed into place when complete, so a
task that runs twice leaves one file).

Defined results
  * null text -> an empty frame with a null count in the directory; empty text ->
    an empty frame with count 0; null ids are kept as null.
  * repeated rows and repeated ids keep a frame each; readers get all of them.
  * very long texts are one frame; a shard may exceed its size by that frame.
  * an empty table gives no shards; columns other than ``doc_id`` and ``text``
    are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import os
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphloom.llm.bpe import PATTERN, VOCABULARY

SKIPPABLE, SEEKABLE, HAS_CHECKSUM = 0x184D2A5E, 0x8F92EAB1, 0x80
SCHEMA = "shard string, n_docs long, n_tokens long, n_bytes long, doc_ids array<bigint>, data binary"


def sealed(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[bytes, bytes]:
    """A frame and its line of the seek table."""
    frame = packer.compress(raw)
    return frame, struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)


def build_shard(ids: list[int | None], counts: list[int | None], payloads: list[bytes], width: int, level: int = 3) -> bytes:
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    head = json.dumps({"width": width, "doc_ids": ids, "n_tokens": counts}).encode()
    frames, lines = zip(*(sealed(raw, packer) for raw in [head, *payloads]))
    table = b"".join(lines) + struct.pack("<IBI", len(frames), HAS_CHECKSUM, SEEKABLE)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


class ShardReader:
    """Random access through ``read_at(offset, size)``; ``frames_read`` counts the frames decompressed."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        self.frames_read = 0
        n, flags, magic = struct.unpack("<IBI", read_at(size - 9, 9))
        if magic != SEEKABLE or not flags & HAS_CHECKSUM:
            raise ValueError("not a seekable file with checksums")
        table = read_at(size - 9 - 12 * n, 12 * n)
        self.lines = np.frombuffer(table, "<u4").reshape(n, 3)
        self.begin = np.concatenate([[0], np.cumsum(self.lines[:, 0], dtype=np.int64)])
        self.head = json.loads(self.frame(0))
        self.doc_ids = self.head["doc_ids"]

    @classmethod
    def of_bytes(cls, data: bytes) -> ShardReader:
        return cls(lambda at, size: data[at : at + size], len(data))

    @classmethod
    def of_file(cls, path: str) -> ShardReader:
        def read_at(at: int, size: int) -> bytes:
            with open(path, "rb") as f:
                f.seek(at)
                return f.read(size)

        return cls(read_at, os.path.getsize(path))

    def frame(self, k: int) -> bytes:
        packed, size, checksum = map(int, self.lines[k])
        raw = zstandard.ZstdDecompressor().decompress(self.read_at(int(self.begin[k]), packed), max_output_size=size)
        self.frames_read += 1
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def tokens(self, k: int) -> np.ndarray | None:
        """Token ids of document k of the shard; null where its text was."""
        if self.head["n_tokens"][k] is None:
            return None
        return np.frombuffer(self.frame(k + 1), "<u2" if self.head["width"] == 2 else "<u4")

    def read(self, wanted: Iterable[int]) -> list[tuple[int, np.ndarray | None]]:
        want = set(wanted)
        return [(d, self.tokens(k)) for k, d in enumerate(self.doc_ids) if d in want]


def tokenizer(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_shards(documents: DataFrame, vocabulary: str = VOCABULARY, shard_bytes: int = 4_000_000, level: int = 3) -> DataFrame:
    """One row per shard: its name, sizes, document ids and the file itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = tokenizer(vocabulary)
        width = 2 if coding.n_vocab <= 1 << 16 else 4
        task = TaskContext.get().partitionId()
        serial = 0
        ids: list = []
        counts: list = []
        payloads: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal serial, held
            data = build_shard(ids, counts, payloads, width, level)
            row = {
                "shard": [f"part-{task:06d}-{serial:05d}"],
                "n_docs": [len(ids)],
                "n_tokens": [sum(c or 0 for c in counts)],
                "n_bytes": [len(data)],
                "doc_ids": pa.array([list(ids)], pa.list_(pa.int64())),
                "data": pa.array([data], pa.binary()),
            }
            serial, held = serial + 1, 0
            ids.clear(), counts.clear(), payloads.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for d, t in zip(doc_ids, texts):
                tokens = coding.encode_ordinary(t or "")
                ids.append(d)
                counts.append(None if t is None else len(tokens))
                payloads.append(np.array(tokens, "<u2" if width == 2 else "<u4").tobytes())
                held += len(payloads[-1])
                if held >= 2 * shard_bytes:  # token ids pack to about a half
                    yield close()
        if ids:
            yield close()

    slim = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, SCHEMA)


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Store each shard as ``folder/<shard>.zst`` on a path all executors share; (shard, path, n_docs, n_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for row in batch.to_pylist():
                path = os.path.join(folder, row["shard"] + ".zst")
                part = f"{path}.{TaskContext.get().taskAttemptId()}.part"
                with open(part, "wb") as f:
                    f.write(row["data"])
                os.replace(part, path)
                yield pa.RecordBatch.from_pylist(
                    [{"shard": row["shard"], "path": path, "n_docs": row["n_docs"], "n_bytes": row["n_bytes"]}]
                )

    return shards.mapInArrow(run, "shard string, path string, n_docs long, n_bytes long")
