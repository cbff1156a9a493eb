"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Rows are taken in chunks of some megabytes of text, in the order in which they come. A chunk's texts are split into
pre-tokens once; the chunk keeps, for each row and position, the number of the word that stands there, and sends its
distinct words to the cells that own them. A cell encodes each distinct word once for all chunks and sends the ids back;
joined by chunk, positions and ids give every row's ids in order. Decoding joins ids with the token-byte table, whose size
is that of the vocabulary file. What is shuffled is a number for each pre-token, and one entry for each word and chunk; a
frequent word costs one entry in a chunk however often it stands there, and no id of a row makes a chunk large.

There are cells for each CELL bytes of text, so a cell holds a bounded number of words, and a message for each chunk and
cell; at hundreds of terabytes both sizes should be raised with the executors' memory, which they fill a few times over.

Null text is empty; an empty text has no tokens and the digests of the empty string. A very long text is a chunk of its
own, split in pieces. Repeated rows, rows that share an id and rows without one each get a result; an empty table gives an
empty one. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import expand, squeeze

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of text whose words a cell owns; characters from which a text is split in pieces.
CELL, LONG = 16 << 20, 1 << 20


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}


_made: dict = {}


def _once(name: str, key, make):
    """One value of a kind for each Python worker."""
    if _made.get(name, (None,))[0] != key:
        _made[name] = (key, make())
    return _made[name][1]


def _splitter(pattern: str):
    import regex

    return _once("pattern", pattern, lambda: regex.compile(pattern))


def _encoder(lines: bytes, pattern: str):
    import tiktoken

    return _once("encoder", (hash(lines), pattern), lambda: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(lines), special_tokens={}))


def _token_bytes(lines: bytes) -> list[bytes]:
    """The token-byte table by id."""

    def table():
        ranks = load_ranks(lines)
        out = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            out[rank] = piece
        return out

    return _once("bytes", hash(lines), table)


class _Numbers(dict):
    """Numbers of words in the order in which they came."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Chunk:
    """Rows with the words at their positions."""

    def __init__(self):
        self.ids, self.places, self.numbers, self.size = [], [], _Numbers(), 0

    def add(self, doc_id: int | None, text: str, split) -> None:
        if len(text) < LONG:
            numbers = np.array(list(map(self.numbers.__getitem__, split.findall(text))), np.uint32)
        else:
            found, parts = split.finditer(text), []
            while part := [self.numbers[m[0]] for m in islice(found, 100_000)]:
                parts.append(np.array(part, np.uint32))
            numbers = np.concatenate(parts)
        self.ids.append(doc_id)
        self.places.append(numbers)
        self.size += len(text)

    def rows(self, place: int, cells: int) -> pa.RecordBatch:
        """Words by cell, and under -1 the rows: words are numbered anew in the order of cells. A chunk's number follows
        from its place and what is in it, so that one that comes out differently in a retry is another chunk."""
        from zlib import crc32

        import xxhash

        words = [w.encode() for w in self.numbers]
        cell = np.fromiter((crc32(w) % cells for w in words), np.int64, len(words))
        order = np.argsort(cell, kind="stable")
        there = np.array([i is not None for i in self.ids], np.uint8)
        flat = np.concatenate(self.places) if self.places else np.zeros(0, np.uint32)
        # positions hold small numbers for frequent words, which compresses them; `at` leads from those to the cells' order
        frequent = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank, at = np.empty(len(words), np.uint32), np.empty(len(words), np.uint32)
        rank[frequent] = np.arange(len(words), dtype=np.uint32)
        at[rank[order]] = np.arange(len(words), dtype=np.uint32)
        body = squeeze(there, np.array([i or 0 for i in self.ids], np.int64), np.array(list(map(len, self.places)), np.int64), at, rank[flat])
        chunk = xxhash.xxh3_64_intdigest(body + place.to_bytes(8, "little")) >> 1
        numbers, blobs = [-1], [body]
        cuts = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0])[: len(order)]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)][: len(cuts)], strict=True):
            part = [words[k] for k in order[a:b].tolist()]
            numbers.append(int(cell[order[a]]))
            blobs.append(squeeze(np.array(list(map(len, part)), np.uint32), np.frombuffer(b"".join(part), np.uint8)))
        return pa.record_batch({"cell": pa.array(numbers, pa.int64()), "chunk": pa.array([chunk] * len(numbers), pa.int64()), "body": pa.array(blobs, pa.binary())})


class Words:
    """A chunk's words: ids, their decimal text, and what the token-byte table gives for them."""

    def __init__(self, blobs: list[bytes], table: list[bytes]):
        self.ids, self.sizes = [], np.zeros(0, np.int64)
        sizes = []
        for blob in blobs:
            size, flat = expand(blob)
            sizes.append(size.astype(np.int64))
            ids, at = flat.tolist(), 0
            for n in size.tolist():
                self.ids.append(ids[at : at + n])
                at += n
        if sizes:
            self.sizes = np.concatenate(sizes)
        self.decimal = [" ".join(map(str, ids)) for ids in self.ids]
        self.bytes = [b"".join([table[i] for i in ids]) for ids in self.ids]


_SPLIT = "cell long, chunk long, body binary"


def encode(docs: DataFrame, finish, schema: str, *, id_col="doc_id", text_col="text", ranks_path=None, pattern=None, chunk: int = common.CHUNK, cell: int = CELL) -> DataFrame:
    """Encodes all documents and gives each one's words to finish(doc_id, word numbers, Words), whose dict is a row of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    pattern = pattern or default_pattern()
    with open(ranks_path or default_ranks(), "rb") as f:  # the tokenizer's file is the driver's; workers get its bytes
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(2 * common.partitions(spark), -(-whole // cell))
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def split(batches):
        of, part, k, held = _splitter(pattern), TaskContext.get().partitionId(), 0, _Chunk()
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if held.ids and held.size + len(text) > chunk:
                    yield held.rows((part << 32) + k, n)
                    k, held = k + 1, _Chunk()
                held.add(i, text, of)
        if held.ids:
            yield held.rows((part << 32) + k, n)
        held = None
        common.release()

    def encoded(key, got):
        one, known, out = _encoder(shared.value, pattern)._encode_single_piece, {}, []
        for blob in got.column("body"):
            sizes, raw = expand(blob.as_py())
            raw, at, ids, counts = raw.tobytes(), 0, [], []
            for size in sizes.tolist():
                word = raw[at : at + size]
                at += size
                got_ids = known.get(word)
                if got_ids is None:
                    got_ids = known[word] = one(word)
                ids += got_ids
                counts.append(len(got_ids))
            out.append(squeeze(np.array(counts, np.uint32), np.array(ids, np.uint32)))
        return pa.table({"cell": got.column("cell"), "chunk": got.column("chunk"), "body": pa.array(out, pa.binary())})

    def reassembled(key, got, answers):
        got = got.filter(pa.compute.less(got.column("cell"), 0))
        if not len(got):
            return fields.empty_table()
        there, ids, counts, at, places = expand(got.column("body")[0].as_py())
        places = at[places]
        words = Words([b for _, b in sorted(zip(answers.column("cell").to_pylist(), answers.column("body").to_pylist(), strict=True))], _token_bytes(shared.value))
        if len(words.ids) != len(at):
            raise RuntimeError("rows came in another order when a task was run again; checkpoint them first")
        ends = np.cumsum(counts)
        out = [
            finish(i if x else None, places[b - n : b], words)
            for i, x, n, b in zip(ids.tolist(), there.tolist(), counts.tolist(), ends.tolist(), strict=True)
        ]
        del words, places
        common.release()
        return pa.Table.from_pylist(out, fields)

    def sent(batches):
        for batch in batches:
            yield batch.filter(pa.compute.greater_equal(batch.column("cell"), 0))

    # one exchange by chunk serves both: words go on to their cells from it, and positions wait in it for the ids
    pieces = rows.mapInArrow(split, _SPLIT).repartition(common.SPREAD * common.partitions(spark), "chunk")
    ids = pieces.mapInArrow(sent, _SPLIT).groupBy("cell").applyInArrow(encoded, _SPLIT)
    return pieces.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(reassembled, schema)


def _digests(doc_id, places, words):
    numbers, decimal, raw = places.tolist(), words.decimal, words.bytes
    return {
        "doc_id": doc_id,
        "n_tokens": int(words.sizes[places].sum()),
        "ids_sha256": hashlib.sha256(" ".join([decimal[k] for k in numbers]).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(b"".join([raw[k] for k in numbers])).hexdigest(),
    }


def _ids(doc_id, places, words):
    return {"doc_id": doc_id, "ids": [i for k in places.tolist() for i in words.ids[k]]}


def encode_ids(docs: DataFrame, **options) -> DataFrame:
    """One row (doc_id, ids) for each row of docs."""
    return encode(docs, _ids, "doc_id long, ids array<int>", **options)


def encode_digests(docs: DataFrame, **options) -> DataFrame:
    """One row (doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs."""
    return encode(docs, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", **options)


def decode(encoded: DataFrame, *, ids_col="ids", ranks_path=None) -> DataFrame:
    """Adds `bytes`, the decoded bytes of each row's ids: ids with their positions join the token-byte table, which is as
    large as the vocabulary and so is broadcast. Null or no ids give empty bytes, an unknown id raises."""
    spark = encoded.sparkSession
    with open(ranks_path or default_ranks(), "rb") as f:
        ranks = load_ranks(f.read())
    arrow = pa.table({"_id": pa.array(list(ranks.values()), pa.int32()), "_piece": pa.array([p.hex() for p in ranks], pa.string())})
    table = spark.createDataFrame(arrow)
    keyed = common.checkpointed(encoded.withColumn("_row", F.monotonically_increasing_id()))
    placed = keyed.select("_row", F.posexplode(ids_col).alias("_at", "_id")).join(F.broadcast(table), "_id", "left")
    piece = F.when(F.col("_piece").isNull(), F.raise_error(F.lit("an unknown id"))).otherwise(F.col("_piece"))
    whole = placed.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", piece.alias("_piece")))).alias("_all"))
    whole = whole.select("_row", F.unhex(F.array_join(F.col("_all._piece"), "")).alias("bytes"))
    return keyed.join(whole, "_row", "left").withColumn("bytes", F.coalesce("bytes", F.lit(b""))).drop("_row")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(common.table(spark, sf_dir, "documents"))
