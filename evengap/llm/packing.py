"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths, none crosses documents.

A piece fills a sequence of its own length alone, so nothing is padded, and sequences of one length form a bucket. Each
document is decomposed by itself: one pass without a shuffle, whatever the sizes or the number of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evengap.llm.common import text_or_empty
from evengap.llm.wordids import encoder, slices


def decompose(n: int, most: int) -> list[int]:
    """n as pieces of length `most`, then falling powers of two."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", most: int = 1024, end: int = 0,
         spaced: bool = True) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, ids (unsigned 32-bit little-endian), sequence_id, offset.

    tokenizer: a file of the tokenizers library; end: the id behind each document; most: a power of two. A null text
    counts as empty and gives one piece, the end id. Rows are independent: null or repeated ids and repeated rows are
    each packed by themselves, other columns are ignored, and an empty table gives none. A sequence is one piece, so
    offset is 0, `length` names the bucket, and sequence ids are unique, though not dense.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("most must be a power of two")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id].dataType)] + [
        T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()),
                                         ("doc_tokens", T.LongType()), ("ids", T.BinaryType()))])

    def pieces(batches):
        encode = encoder(tokenizer, spaced)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts], 2_000_000):
                ids, counts = encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(counts), end).astype("<u4")
                counts = counts + 1
                lengths = [decompose(int(n), most) for n in counts]
                length = np.array([x for one in lengths for x in one], np.int64)
                row = np.repeat(np.arange(b - a), [len(x) for x in lengths])
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(counts) - counts)[row]
                for c, d in slices((4 * length).tolist(), 16_000_000):
                    at = np.concatenate([[0], 4 * (ends[c:d] - ends[c] + length[c])]).astype(np.int32)
                    data = ids[ends[c] - length[c]:ends[d - 1]].tobytes()
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(row[c:d] + a)), pa.array(start[c:d]), pa.array(length[c:d]),
                        pa.array(counts[row[c:d]]),
                        pa.Array.from_buffers(pa.binary(), d - c, [None, pa.py_buffer(at), pa.py_buffer(data)]),
                    ], names=schema.names)

    return (docs.select(F.col(id), text_or_empty(text)).mapInArrow(pieces, schema)
            .withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces with one folder for each length."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
