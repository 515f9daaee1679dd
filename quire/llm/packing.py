"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are the binary digits of n: as many
whole sequences of the longest length as fit, then the remaining powers of two in falling
order.  Each piece is a sequence of its own in the bucket of its length, so no sequence
crosses documents, offsets are 0 and nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import documents, stash
from quire.llm.wordbpe import END_ID, word_bpe

LONGEST = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths of the pieces of n ids, longest first; longest is a power of two."""
    out = [longest] * (n // longest)
    bit = longest >> 1
    while bit:
        if n & bit:
            out.append(bit)
        bit >>= 1
    return out


def _cut(vocabulary: str | None, longest: int, with_ids: bool):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in batches:
            ids, starts, lengths, crcs, totals, raw = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = memoryview(bpe.encode(text) + end)
                at, total = 0, len(data) // 4
                for size in binary_lengths(total, longest):
                    piece = data[4 * at : 4 * (at + size)]
                    ids.append(doc_id)
                    starts.append(at)
                    lengths.append(size)
                    crcs.append(zlib.crc32(piece))
                    totals.append(total)
                    if with_ids:
                        raw.append(np.frombuffer(piece, "<i4"))
                    at += size
            columns = [pa.array(x, pa.int64()) for x in (ids, starts, lengths, crcs, totals)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(raw, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, longest: int = LONGEST, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    with_ids adds the ids themselves.  Pieces are laid out by (length, doc_id, start), so
    the sequences of a bucket are neighbours; sequence_id grows in that order.  An empty
    or null text is its end id alone: one piece of length 1.  Repeated rows give repeated
    pieces in sequences of their own.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = stash(documents(docs).mapInArrow(_cut(vocabulary, longest, with_ids), schema))
    laid = pieces.repartitionByRange(F.col("length").desc(), "doc_id", "start").sortWithinPartitions(F.col("length").desc(), "doc_id", "start")
    return laid.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
