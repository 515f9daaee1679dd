"""Token ids in directly addressable codes (DAC).

An id is cut into 8-bit chunks, lowest first.  Level k holds the k-th chunk of every id
that has one, a continuation bitmap tells which ids go on to level k+1, and a rank
directory (ones before every 512 bits) turns a position on level k into its position on
level k+1.  So the i-th id is found with one look per level, without decoding a block.

A code file is: magic, number of ids, number of levels; per level the number of chunks,
the chunks, the bitmap and the rank directory.  A shard adds the ids of its documents and
where each ends.  Shards are rows of a Parquet table in ascending doc_id order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import documents, parts_for, stash, text_bytes
from quire.llm.wordbpe import END_ID, word_bpe

MAGIC = b"QDAC1\0\0\0"
_STEP = 512
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def dac_encode(ids: np.ndarray) -> bytes:
    """The code file of a vector of unsigned 32-bit ids."""
    rest, levels = np.ascontiguousarray(ids, np.uint32), []
    while True:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bitmap) // (_STEP // 8)) * (_STEP // 8), np.uint8)
        padded[: len(bitmap)] = bitmap
        ones = _ONES[padded].reshape(-1, _STEP // 8).sum(1, dtype=np.uint64)
        ranks = (np.cumsum(ones) - ones).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<QQ", len(ids), len(levels)) + b"".join(levels)


class DacReader:
    """Random and bulk access to a code file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a DAC file")
        self.n, levels = struct.unpack_from("<QQ", data, 8)
        at, self.levels = 24, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            bits, steps = -(-n // 8), -(-n // _STEP)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, bits, at + n)
            ranks = np.frombuffer(data, "<u8", steps, at + n + bits)
            at += n + bits + 8 * steps
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                break
            start = i // _STEP * (_STEP // 8)
            before = int(_ONES[bitmap[start:byte]].sum()) + int(_ONES[bitmap[byte] & ((1 << bit) - 1)])
            i, shift = int(ranks[i // _STEP]) + before, shift + 8
        return value

    def all(self) -> np.ndarray:
        out: np.ndarray | None = None
        for chunks, bitmap, _ in reversed(self.levels):
            value = chunks.astype("<u4")
            if out is not None:
                value[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(8)
            out = value
        return out


SHARD = "shard long, n_docs long, n_tokens long, doc_ids binary, doc_ends binary, codes binary"
ROWS = "shard long, doc_id long, in_shard long, n_tokens long, ids_crc32 long"


def _shard(number: int, ids: list[int], parts: list[bytes]) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(parts), "<u4")
    ends = np.cumsum([len(p) // 4 for p in parts]).astype("<i8")
    row = [number, len(ids), len(flat), np.array(ids, "<i8").tobytes(), ends.tobytes(), dac_encode(flat)]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 3
    names = ["shard", "n_docs", "n_tokens", "doc_ids", "doc_ends", "codes"]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


def _encode_shards(vocabulary: str | None, shard_tokens: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, ids, parts, held = word_bpe(vocabulary), [], [], 0
        number = TaskContext.get().partitionId() << 32  # ranges are numbered in doc_id order
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                parts.append(bpe.encode(text) + end)
                held += len(parts[-1]) // 4
                if held >= shard_tokens:
                    yield _shard(number, ids, parts)
                    ids, parts, held, number = [], [], 0, number + 1
        if ids:
            yield _shard(number, ids, parts)

    return run


def _decode_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, ends = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_ends"], "<i8")
            flat = memoryview(DacReader(row["codes"]).all().tobytes())
            starts = np.append(0, ends[:-1]).astype(np.int64)
            crc = [zlib.crc32(flat[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), row["shard"])), pa.array(ids), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                ["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"],
            )


def write_token_files(docs: DataFrame, vocabulary: str | None = None, shard_tokens: int = 2_000_000, part_bytes: int = 16 << 20) -> DataFrame:
    """Encodes every document, end id appended, into DAC shards in ascending doc_id order.

    Returns the written table (one row per shard), read back from the shared folder.  The
    empty text is its end id alone.  Rows that repeat a doc_id are neighbours in the files.
    """
    rows = documents(docs)
    n = parts_for(text_bytes(rows), part_bytes)
    ordered = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stash(ordered.mapInArrow(_encode_shards(vocabulary, shard_tokens), SHARD))


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, in file order.

    start counts the ids of all documents before it.  The running sum has two levels: over the
    ranges of doc_ids (one row per writing task), and inside each range over its shards.
    """
    rows = shards.mapInArrow(_decode_shards, ROWS)
    sizes = shards.select("shard", F.shiftright("shard", 32).alias("range"), "n_tokens")
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("range").agg(F.sum("n_tokens").alias("n_tokens"))
    ranges = ranges.select("range", earlier(Window.orderBy("range")).alias("range_before"))
    inside = sizes.select("shard", "range", earlier(Window.partitionBy("range").orderBy("shard")).alias("shard_before"))
    offsets = inside.join(ranges, "range").select("shard", (F.col("range_before") + F.col("shard_before")).alias("before"))
    return rows.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")
