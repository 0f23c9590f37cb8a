"""Shared helpers: tables in the cluster's shared folder, and vectorised word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset on
    a single machine (tests, a laptop) a temporary folder is chosen and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        try:
            spark.conf.set("spark.checkpoint.dir", root)
        except Exception:  # static in this session: keep it beside the session
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with a copy that every executor can read, so the loss of
    an executor never forces the plan before it to run again.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table written by ``materialize`` that nothing will read again."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target.getParent(), True)


#: What operators remember in a worker beyond a task; a worker serves the tasks of all operators in turn.
REMEMBERED: list[dict] = []


def give_back(but: dict | None = None) -> None:
    """Return freed memory to the system: a worker that waits for its next task otherwise keeps its last peak.

    What other operators remember goes too, all of REMEMBERED save ``but``.
    """
    for kept in REMEMBERED:
        if kept is not but:
            kept.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

#: Bytes of words: letters, digits, underscore, and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"]] = True
WORD_BYTES[128:] = True
#: Bytes of words parted by ASCII white space alone; VISIBLE finds the same words in a text.
VISIBLE_BYTES = np.ones(256, bool)
VISIBLE_BYTES[[*b" \t\n\r\v\f"]] = False
VISIBLE = re.compile(r"[^ \t\n\r\v\f]+")
#: Characters hashed at a time.
CHUNK_CHARS = 1_000_000


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, kept per worker."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = []
        for b in (BASE, BASE_INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str], table: np.ndarray = WORD_BYTES, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, end to end, and how many each text has.

    A polynomial hash from prefix sums over the texts' bytes: no Python object a word.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = table[data]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        turn = np.concatenate([[0], turn])
    begin, end = turn[::2], turn[1::2]
    power, inverse = powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=prefix[1:])
    h = mix((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    edges = np.cumsum([len(r) + 1 for r in raw])
    return h, np.diff(np.searchsorted(begin, edges), prepend=0)


def text_chunks(texts: list[str | None], chars: int = CHUNK_CHARS):
    """Ranges of consecutive texts of about ``chars`` characters together."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's), vectorised."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every run of ``n`` words; empty if there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + h[k : len(h) - n + 1 + k]
    return mix(out)


def long_rolling(h: np.ndarray, n: int) -> np.ndarray:
    """The same idea for long runs, from prefix sums: its cost doesn't depend on ``n``."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    power, inverse = powers(len(h))
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power, out=prefix[1:])
    return mix((prefix[n:] - prefix[:-n]) * inverse[: len(h) - n + 1])


def need(df: DataFrame, *columns: str) -> None:
    """Raise a clear error where a required column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of the small side up to which a join broadcasts it; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows were measured to be small; else as it is.

    ``df`` is evaluated for its size, so it should be a written table or cheap.
    """
    width = F.lit(0)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            width += F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif kind == "array":
            width += F.greatest(F.size(field.name), F.lit(0)) * 24 + 16
        else:
            width += 8
    size = df.agg(F.sum((width + 16).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
