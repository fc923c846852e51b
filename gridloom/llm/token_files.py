"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A shard file holds the ids of consecutive documents (2 bytes an id where the
vocabulary allows, else 4) and two Elias-Fano sequences: where each document's
ids end, and the document ids.  Both are ascending, so each takes about
2 + log2(span / n) bits an entry, and ``select`` finds an entry from a sampled
directory of the high bits; no table of 64-bit offsets is kept.

Layout, little-endian: magic ``GLIDS001``; header of six u64 (documents, ids,
bytes an id, documents without an id, first document id as i64, end token);
the boundaries; the document ids; the id array.

Defined cases: a null text is empty and holds the end id alone; a very long text
makes a shard of its own length; rows without a doc_id come first; repeated
doc_ids stay as documents of their own, ordered by a hash of the text, then by
text; an empty table gives no file and an empty result.  Only the id and text
columns are read, so other columns can't clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.arrow import arrow_schema, make_dir, map_rows, text_or_empty, to_batch, write_file
from gridloom.llm.bpe import library_rows
from gridloom.plans.durable import fresh_path, materialize

MAGIC = b"GLIDS001"
HEADER = struct.Struct("<QQQQqQ")
#: Ones between two samples of the select directory.
SAMPLE = 256
#: A shard is closed once it has this many ids; a longer document makes a longer shard.
SHARD_IDS = 4_000_000


@dataclass
class EliasFano:
    """An ascending sequence of non-negative integers."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) + 1 if n else 0), np.uint8)
        unary[ones] = 1
        high = np.packbits(unary, bitorder="little")
        return cls(n, low_bits, low, high, ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b = struct.unpack_from("<QQQQ", data, at)
        at += 32
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        m = -(-n // SAMPLE)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", m, at + a + b)), at + a + b + 4 * m

    def block(self, k: int) -> np.ndarray:
        """Entries ``k * SAMPLE`` to the next sample."""
        first, m = k * SAMPLE, min(SAMPLE, self.n - k * SAMPLE)
        at = int(self.samples[k])
        stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[at // 8 : -(-stop // 8)], bitorder="little")
        ones = np.flatnonzero(bits[at % 8 :])[:m] + at
        out = (ones - np.arange(first, first + m)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            a, b = first * self.low_bits, (first + m) * self.low_bits
            low = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a].reshape(m, self.low_bits)
            out |= (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def select(self, i: int) -> int:
        """The entry of rank ``i``, from one block of the directory."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.block(i // SAMPLE)[i % SAMPLE])

    def __iter__(self) -> Iterator[int]:
        for k in range(len(self.samples)):
            yield from self.block(k).tolist()


class ShardBuffer:
    """A shard's documents as they come: ids in the narrowest width so far, one copy of them."""

    def __init__(self, end_id: int):
        self.end_id, self.width, self.keys, self.lengths, self.flat, self.n_ids = end_id, 2, [], [], bytearray(), 0

    def add(self, key: int | None, ids: bytes) -> None:
        """A document's little-endian 32-bit ids with its end id."""
        new = np.frombuffer(ids, "<u4")
        if self.width == 2 and len(new) and new.max() > 65535:
            self.width, self.flat = 4, bytearray(np.frombuffer(self.flat, "<u2").astype("<u4"))
        self.flat += new.astype(f"<u{self.width}").data
        self.keys.append(key)
        self.lengths.append(len(new))
        self.n_ids += len(new)

    def parts(self) -> list:
        """The file, in parts to write one after another."""
        known = np.array([k for k in self.keys if k is not None], np.int64)
        first = int(known[0]) if len(known) else 0
        ends = EliasFano.of(np.cumsum(self.lengths))
        docs = EliasFano.of((known - first).view(np.uint64))
        head = MAGIC + HEADER.pack(len(self.keys), self.n_ids, self.width, len(self.keys) - len(known), first, self.end_id)
        return [head, ends.to_bytes(), docs.to_bytes(), self.flat]


class Shard:
    """A shard file's documents by rank."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        if self.data[:8] != MAGIC:
            raise ValueError("not a token-id shard")
        self.n, self.n_ids, self.width, self.n_null, self.first, self.end_id = HEADER.unpack_from(self.data, 8)
        self.ends, at = EliasFano.read(self.data, 8 + HEADER.size)
        self.docs, at = EliasFano.read(self.data, at)
        self.ids = np.frombuffer(self.data, f"<u{self.width}", self.n_ids, at)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.first + self.docs.select(i - self.n_null)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``doc_id, start, ids`` in order."""
        docs, start = iter(self.docs), 0
        for i, end in enumerate(self.ends):
            yield (None if i < self.n_null else self.first + next(docs)), start, self.ids[start:end]
            start = end


def write(df: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode, order by id and write shards; the manifest ``file, part, seq, n_docs, n_ids`` has a row for each.

    Texts are dealt by ranges of ids and sorted within them, so part order is
    id order.  A task holds one shard's ids.  File names are new for each
    attempt; the manifest names those of the attempts that ended.
    """
    make_dir(folder)
    ranged = df.select(F.col(id_col).cast("bigint").alias("k"), text_or_empty(text_col).alias("t")).withColumn("h", F.xxhash64("t")).withColumn("row", F.monotonically_increasing_id())
    # Documents without an id, or with one id, spread by their texts, and equal ones by their rows.
    ranged = ranged.repartitionByRange("k", "h", "row").sortWithinPartitions("k", "h", "t").select("k", "t")
    schema = "file string, part int, seq int, n_docs bigint, n_ids bigint"

    target = arrow_schema(schema)

    def run(batches):
        import uuid

        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        end, shard = struct.pack("<I", end_id), ShardBuffer(end_id)

        def close() -> pa.RecordBatch:
            name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            write_file(f"{folder}/{name}", *shard.parts())
            return to_batch([(name, part, seq, len(shard.keys), shard.n_ids)], target)

        for key, ids in library_rows(vocabulary)(batches):
            shard.add(key, ids + end)
            if shard.n_ids >= shard_ids:
                yield close()
                shard, seq = ShardBuffer(end_id), seq + 1
        if shard.keys:
            yield close()

    return materialize(ranged.mapInArrow(run, schema), "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of ``manifest``.

    Starts come from sums over parts (one row a part), then over a part's
    shards; no sum runs over documents.
    """
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.select("part", before("n", Window.orderBy("part")).alias("part_start"))
    placed = manifest.join(parts, "part").select("file", (F.col("part_start") + before("n_ids", Window.partitionBy("part").orderBy("seq"))).alias("base"))

    def fn(path, content):
        for key, start, ids in Shard(content):
            yield path.rsplit("/", 1)[-1], key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    found = map_rows(files, fn, "file string, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(placed, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the files, then read them back."""
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "token-ids")
    manifest = write(df, folder, vocabulary, id_col, text_col)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read(spark, folder, manifest)
