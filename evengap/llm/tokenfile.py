"""Token ids in files of patched frame-of-reference blocks.

Documents are sorted by id over the whole table and encoded; neighbours form segments of about 65,536 ids, one row each
in Parquet files. A segment holds blocks of 128 ids: the block's minimum is taken off, the rest is packed at the width
that fits a percentile of the block, what does not fit keeps its low bits there and its high bits in an exception list,
and an index has the start of every block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evengap.llm.common import text_or_empty
from evengap.llm.wordids import encoder, slices

BLOCK = 128
MAGIC = b"PFR1"


def bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0).astype(np.int64)


def encode_ids(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """Magic; ids, blocks, exceptions; then block starts, minima, widths, exception counts, packed bits, exceptions."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.concatenate([ids, np.repeat(ids[-1:], blocks * BLOCK - n)]).astype(np.uint32).reshape(blocks, BLOCK)
    least = full.min(axis=1, initial=2**32 - 1)
    rest = full - least[:, None]
    rank = min(BLOCK, max(1, int(np.ceil(percentile * BLOCK)))) - 1
    width = bits(np.partition(rest, rank, axis=1)[:, rank])
    high = (rest.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
    where, position = np.nonzero(high)
    size = width * BLOCK // 8
    begin = np.cumsum(size) - size
    packed = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            kind = "<u2" if w <= 16 else "<u4"
            low = (rest[rows].astype(np.uint64) & np.uint64((1 << int(w)) - 1)).astype(kind)
            one = np.unpackbits(low.view(np.uint8).reshape(len(rows), BLOCK, -1), axis=2, bitorder="little")
            one = np.packbits(one[:, :, :w].reshape(len(rows), -1), axis=1, bitorder="little")
            packed[begin[rows][:, None] + np.arange(w * BLOCK // 8)] = one
    return b"".join([MAGIC, np.array([n, blocks, len(where)], "<u4").tobytes(), begin.astype("<u4").tobytes(),
                     least.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(),
                     np.bincount(where, minlength=blocks).astype(np.uint8).tobytes(), packed.tobytes(),
                     position.astype(np.uint8).tobytes(), high[where, position].astype("<u4").tobytes()])


def decode_ids(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, blocks, odd = np.frombuffer(data, "<u4", 3, 4).tolist()
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    begin, least, width, count = take("<u4", blocks), take("<u4", blocks), take("u1", blocks), take("u1", blocks)
    packed = take("u1", int(width.astype(np.int64).sum()) * BLOCK // 8)
    position, high = take("u1", odd), take("<u4", odd)
    rest = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            wide = 16 if w <= 16 else 32
            raw = packed[begin[rows].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
            one = np.zeros((len(rows), BLOCK, wide), np.uint8)
            one[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            one = np.packbits(one.reshape(len(rows), -1), axis=1, bitorder="little")
            rest[rows] = one.view("<u2" if wide == 16 else "<u4").reshape(len(rows), BLOCK)
    where = np.repeat(np.arange(blocks), count)
    rest[where, position] |= (high.astype(np.uint64) << width[where].astype(np.uint64)).astype(np.uint32)
    return (rest + least[:, None]).reshape(-1)[:n]


def write_ids(docs: DataFrame, path: str, tokenizer: str, *, id: str = "doc_id", text: str = "text", end: int = 2,
              spaced: bool = False, percentile: float = 0.9, segment: int = 65_536) -> None:
    """Write the ids of all documents, each with `end` behind it, in ascending order of id (nulls first, then a hash of the text).

    A null text counts as empty; repeated ids and rows are kept as documents of their own; an empty table writes no
    segment. A document is never cut, so a segment is longer only where one document is.
    """
    kind = docs.schema[id].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])

    def segments(batches):
        encode, part, first = encoder(tokenizer, spaced), TaskContext.get().partitionId(), 0
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts], 2_000_000):
                ids, counts = encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(counts), end).astype(np.uint32)
                counts = counts + 1
                ends = np.cumsum(counts)
                for c, d in slices(counts.tolist(), segment):
                    some = ids[ends[c] - counts[c]:ends[d - 1]]
                    own = names.slice(a + c, d - c)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(some)], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, d - c], pa.int32()), own),
                        pa.array([counts[c:d].tolist()], pa.list_(pa.int64())),
                        pa.array([encode_ids(some, percentile)], pa.binary())], names=schema.names)
                    first += len(some)

    # the driver samples the columns that rows are ranged by, so a hash stands for the text there
    (docs.select(F.col(id).alias("doc_id"), text_or_empty(text).alias("text"), F.xxhash64(text_or_empty(text)).alias("h"))
     .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
     .mapInArrow(segments, schema).write.parquet(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary)."""
    segments = spark.read.parquet(path)
    # one row for each task that wrote, so no more than the partitions of that write
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    kind = segments.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode_ids(batch.column(3)[i].as_py()).astype("<u4")
                counts = batch.column(2)[i].values.to_numpy()
                ends = np.cumsum(counts)
                at = np.concatenate([[0], 4 * ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1)[i].values, pa.array(batch.column(0)[i].as_py() + ends - counts),
                    pa.array(counts),
                    pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(ids)]),
                ], names=schema.names)

    return (segments.join(F.broadcast(bases), "part")
            .select((F.col("base") + F.col("first")).alias("first"), "doc_ids", "lengths", "payload")
            .mapInArrow(documents, schema))
