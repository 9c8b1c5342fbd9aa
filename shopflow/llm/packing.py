"""Packing by power-of-two decomposition.

A document is its token ids and an end id. It is cut into pieces whose lengths
are powers of two: as many of ``longest`` as fit, then the binary digits of the
rest, largest first. Every piece is a sequence of its own: equal lengths share a
bucket, no sequence crosses documents, and none needs padding. Documents are cut
where they are read, without a shuffle; buckets are folders of the written table.

Defined results: null and empty texts are the end id alone, one piece of length
one. Repeated rows and ids are packed each. Sequence ids are unique in a result.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.store import bounded_batches, tidied
from shopflow.llm.tokens import encode, encoder

LONGEST = 2048
END_ID = 1
#: Ids gathered before a task hands on a batch.
BATCH_IDS = 1 << 20


def decompose(n: int, longest: int = LONGEST) -> np.ndarray:
    """Lengths of the pieces of n ids, in order."""
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rest = n % longest
    digits = [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]
    return np.array([longest] * (n // longest) + digits, np.int64)


def _pack_rows(vocabulary: str | None, longest: int, end_id: int):
    def run(batches):
        enc = encoder(vocabulary)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows, held = [], 0
            for i, text in enumerate(batch.column(1)):
                ids = np.concatenate((encode(enc, text.as_py() or ""), end)).astype("<u4")
                lengths = decompose(len(ids), longest)
                starts = np.cumsum(lengths) - lengths
                for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
                    rows.append((i, s, n, ids[s:s + n].tobytes(), len(ids)))
                held += len(ids)
                if held >= BATCH_IDS:
                    yield _batch(batch, rows)
                    rows, held = [], 0
            if rows:
                yield _batch(batch, rows)
    return run


def _batch(batch, rows):
    i, start, length, ids, total = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(i, pa.int64())), pa.array(start, pa.int64()),
         pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
        ["id", "start", "length", "ids", "doc_tokens"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         vocabulary: str | None = None, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """A row per piece: id_col, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (0: a piece is its whole sequence)."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(tidied(_pack_rows(vocabulary, longest, end_id)),
                    f"id {dict(docs.dtypes)[id_col]}, start long, length long, ids binary, "
                    "doc_tokens long") \
        .select(F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens",
                F.monotonically_increasing_id().alias("sequence_id"),
                F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences in one folder per length (as many as there are powers of two)."""
    packed.write.partitionBy("length").parquet(path)
