"""Shared pieces of the training-data operators: tables, checkpoints, words, hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every shingle operator: runs of non-ASCII characters, digits and ASCII letters, A-Z lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Delimiters, as a regular expression of one or more.
GAP_PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a shingle, and the similarity from which two texts are near duplicates.
SHINGLE, SIMILAR = 5, 0.8

#: Byte table: A-Z to a-z, ASCII delimiters to a space, all else (digits, letters, bytes of longer characters) kept.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def release() -> None:
    """Gives memory that is free back to the system: Python workers stay for later tasks of any stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if _libc is None:
        globals()["_libc"] = ctypes.CDLL(None)
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_libc = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. Where the session names none, one is made only in local mode, whose
    executors are the driver; on a cluster that would be a folder of one machine, so it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="talliq-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on any of Spark's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Partitions for each of a shuffle's to which chunks are dealt: chunks are few and large, so that a partition of several
#: would be long; small ones are put together again at run time.
SPREAD = 4


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """(chunk, n_bytes, body): the rows of docs packed in the order of their partitions, about `size` bytes of text each,
    compressed and checkpointed. A row belongs to a chunk by its place, not by its id, so no id makes a chunk large."""

    def packed(batches):
        part, k, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if texts and held + len(t) > size:
                    yield _chunk((part << 32) + k, ids, texts)
                    k, ids, texts, held = k + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield _chunk((part << 32) + k, ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    return checkpointed(rows.mapInArrow(packed, "chunk long, n_bytes long, body binary"))


def _chunk(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    import zstandard

    there = np.array([i is not None for i in ids], np.uint8)
    raw = [len(ids).to_bytes(8, "little"), there.tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), *texts]
    body = zstandard.compress(b"".join(raw), 3)
    return pa.record_batch({"chunk": pa.array([number], pa.int64()), "n_bytes": pa.array([sum(map(len, texts))], pa.int64()), "body": pa.array([body], pa.binary())})


def unpacked(body: bytes) -> tuple[list[int | None], list[bytes]]:
    """Ids and texts of a chunk."""
    import zstandard

    raw = zstandard.decompress(body)
    n = int.from_bytes(raw[:8], "little")
    there, ids, sizes = np.frombuffer(raw, np.uint8, n, 8), np.frombuffer(raw, np.int64, n, 8 + n), np.frombuffer(raw, np.int64, n, 8 + 9 * n)
    ends = (np.cumsum(sizes) + 8 + 17 * n).tolist()
    texts = [raw[a:b] for a, b in zip([8 + 17 * n, *ends[:-1]], ends, strict=True)]
    return [i if x else None for i, x in zip(ids.tolist(), there.tolist(), strict=True)], texts


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes, which small numbers and differences make short."""
    import zstandard

    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        parts += [a.dtype.str[1:].encode(), len(a).to_bytes(8, "little"), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    return zstandard.compress(b"".join(parts), 3)


def expand(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.decompress(blob), 1, []
    for _ in range(raw[0]):
        kind, n = np.dtype(raw[at : at + 2].decode()), int.from_bytes(raw[at + 2 : at + 10], "little")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 10).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 10 + n * kind.itemsize
    return out


def cells_for(packed: DataFrame, size: int) -> int:
    """Cells to deal to: one for each `size` bytes of text, and at least two for each partition of a shuffle."""
    whole = packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(2 * partitions(packed.sparkSession), -(-whole // size))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class WordHashes:
    """64-bit hashes of words, remembered up to a bound so that memory stays flat whatever the vocabulary."""

    def __init__(self, most: int = 100_000):
        import xxhash

        self.most, self.known, self.digest = most, {}, xxhash.xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = np.empty(len(words), np.uint64)
        try:
            out[:] = [known[w] for w in words]
        except KeyError:
            digest = self.digest
            for w in set(words):
                if w not in known:
                    known[w] = digest(w)
            out[:] = [known[w] for w in words]
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < size:
        size = n
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k]
    return np.unique(mixed(total + np.uint64(size)))
