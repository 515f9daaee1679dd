"""Chunks of documents and the buckets they consult.

Finding what many documents share takes three passes over the text.  Documents are dealt
out into chunks by a hash of their id, as compressed blobs; a chunk asks every bucket of a
hash space with one blob of what it holds there and gets one blob of bits back, in the same
order.  So the shuffles carry a few bytes per anchor and never a row per anchor, a value
that a third of all documents hold reaches a bucket once per chunk, and each chunk and each
bucket fits into one task whatever the size of the whole.  With many buckets a sender speaks for
several chunks: it works on them one by one and sends what they have for a bucket in one frame.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import documents, parts_for, text_bytes

_HELD = 32 << 20
#: Buckets up to which every sender sends to every bucket, and up to which a sender is one chunk.
FAN, ALONE = 8192, 256
#: Chunks that a sender speaks for at most; it holds what they send.
TOGETHER = 4
_GROUPS = 1 << 31
BLOBS = "chunk long, bucket long, kind int, blob binary"
_BLOB = [("chunk", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())]


def squeeze(*arrays: np.ndarray | bytes) -> bytes:
    """Byte strings and arrays as one compressed blob; unsqueeze gives their bytes back."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = struct.pack(f"<{len(raw) + 1}Q", len(raw), *map(len, raw))
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *raw]))


def unsqueeze(blob: bytes) -> list[memoryview]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    (n,) = struct.unpack_from("<Q", data)
    at, out = 8 * (n + 1), []
    for size in struct.unpack_from(f"<{n}Q", data, 8):
        out.append(data[at : at + size])
        at += size
    return out


def blob_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, _BLOB, strict=True)], names=[n for n, _ in _BLOB])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = []
        for (sender, chunk), docs in held.items():
            ids, texts = [i for i, _ in docs], [t for _, t in docs]
            rows.append((sender, chunk, 0, squeeze(np.array(ids, "<i8"), np.array([len(t) for t in texts], "<i8"), b"".join(texts))))
        held.clear()
        return blob_table(rows).combine_chunks().to_batches()[0]

    for batch in batches:
        for sender, chunk, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data = text.encode()
            held.setdefault((sender, chunk), []).append((doc_id, data))
            size += len(data) + 64
            if size > _HELD:
                yield flush()
                size = 0
    if held:
        yield flush()


def chunk_size(spark: SparkSession) -> int:
    """Text bytes per chunk such that a task's arrays fit beside an executor's heap: 1/400 of
    it, 4 MB at least and 256 MB at most.  Larger executors mean fewer and larger blobs."""
    named = spark.conf.get("spark.executor.memory", "1g").lower()
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", named).groups()
    return min(256 << 20, max(4 << 20, int(number) * {"k": 1 << 10, "": 1 << 20, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[unit] // 400))


def speaks_for(buckets: int) -> int:
    """How many chunks a sender speaks for: a frame for a bucket should not get tiny as buckets get many."""
    return min(TOGETHER, -(-buckets // ALONE))


def chunked(docs: DataFrame, chunk_bytes: int, bucket_bytes: int, together: int | None = None) -> tuple[DataFrame, int]:
    """The documents as blobs, partitioned by sender, and the number of buckets.

    Of a row, `chunk` is the sender and `bucket` the chunk among its `together` ones.
    """
    rows = documents(docs)
    total = text_bytes(rows)
    chunks, buckets = parts_for(total, chunk_bytes), parts_for(total, bucket_bytes, 6)
    senders = -(-chunks // (together or speaks_for(buckets)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(chunks))
    dealt = rows.select(F.pmod(place, F.lit(senders)).alias("chunk"), place.alias("bucket"), "doc_id", "text")
    return dealt.mapInArrow(_gather, BLOBS).repartition(max(senders, 6), "chunk"), buckets


class Texts:
    """The documents of a chunk in ascending doc_id order."""

    def __init__(self, blobs: list[bytes]):
        docs = []
        for blob in blobs:
            ids, sizes, data = unsqueeze(blob)
            at = 0
            for doc_id, size in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(sizes, "<i8").tolist(), strict=True):
                docs.append((doc_id, bytes(data[at : at + size])))
                at += size
        docs.sort()
        self.ids = np.array([i for i, _ in docs], np.int64)
        self.texts = [t for _, t in docs]


def _spoken_for(table: pa.Table) -> Iterator[tuple[int, Texts]]:
    """The chunks of a sender, one after the other."""
    blobs: dict[int, list[bytes]] = {}
    for chunk, blob in zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True):
        blobs.setdefault(chunk, []).append(blob)
    for chunk in sorted(blobs):
        yield chunk, Texts(blobs.pop(chunk))


Sent = list[tuple[int, bytes]]


def _frames(sender: int, kind: int, sent: Iterator[tuple[int, Sent]]) -> pa.Table:
    """What the chunks of a sender have for each bucket, as one compressed frame a bucket."""
    held: dict[int, Sent] = {}
    for chunk, pairs in sent:
        for bucket, blob in pairs:
            held.setdefault(bucket, []).append((chunk, blob))
    pack = zstandard.ZstdCompressor(level=1).compress
    return blob_table([(sender, bucket, kind, pack(frame(held.pop(bucket)))) for bucket in sorted(held)])


def ask(chunks: DataFrame, question: Callable[[Texts], Sent]) -> DataFrame:
    """question: the (bucket, blob) pairs of a chunk."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _frames(key[0].as_py(), 1, ((chunk, question(texts)) for chunk, texts in _spoken_for(table)))

    return chunks.groupBy("chunk").applyInArrow(run, BLOBS)


# Blobs of many chunks for one bucket, or of one sender for many buckets, travel in frames.


def frame(items: list[tuple[int, bytes]]) -> bytes:
    ids, blobs = [i for i, _ in items], [b for _, b in items]
    head = np.array([len(items), *ids, *map(len, blobs)], "<i8").tobytes()
    return b"".join([head, *blobs])


def unframe(data: bytes) -> Iterator[tuple[int, bytes]]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ids, sizes = np.frombuffer(data, "<i8", 2 * n, 8).reshape(2, n).tolist()
    at = 8 * (2 * n + 1)
    for i, size in zip(ids, sizes, strict=True):
        yield i, data[at : at + size]
        at += size


def fan_out(buckets: int, fan: int = FAN) -> int:
    """To how many places a sender sends at most: all buckets while they are few, else the square root of
    their number, if that is more."""
    return min(buckets, max(fan, math.isqrt(buckets - 1) + 1))


def _by_range(width: int):
    """Frames a sender's blobs by ranges of `width` buckets; a sender's rows are neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            framed = [
                (chunk, place, kind, frame([(bucket, blob) for _, bucket, _, blob in mine]))
                for (chunk, place, kind), mine in groupby(rows, lambda r: (r[0], r[1] // width, r[2]))
            ]
            yield from blob_table(framed).to_batches()

    return run


def _relay(outer: str, inner: str):
    """Turns the frames of one relay inside out: from frames by `outer`, items by the other, to the reverse."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        relay, turned = key[0].as_py() * _GROUPS + key[1].as_py() if len(key) > 1 else key[0].as_py(), {}
        for place, kind, data in zip(*(table.column(c).to_pylist() for c in (outer, "kind", "blob")), strict=True):
            for other, blob in unframe(data):
                turned.setdefault((other, kind), []).append((place, blob))
        if inner == "bucket":
            return blob_table([(relay, other, kind, frame(items)) for (other, kind), items in turned.items()])
        return blob_table([(other, relay // _GROUPS, kind, frame(items)) for (other, kind), items in turned.items()])

    return run


def answer(asked: DataFrame, buckets: int, reply: Callable[[list[bytes]], list[bytes]], kind: int, fan: int = FAN) -> DataFrame:
    """reply: one blob for each blob of a chunk that reached a bucket, in the order given.

    While there are no more buckets than a sender may send to, its frames go there and back
    directly, so that what is sent is written once.  With more, a sender sends a frame of frames to
    each range of buckets; relays, each of a range and a group of senders, turn those by sender into
    those by bucket, and back.  So there are about twice (senders x square root of buckets) rows
    instead of senders x buckets, but everything is written twice.
    """
    places = fan_out(buckets, fan)
    relayed = places < buckets

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        came, blobs = table.column("chunk").to_pylist(), table.column("blob").to_pylist()
        items = [(r, s, f) for r, data in zip(came, blobs, strict=True) for s, f in (unframe(data) if relayed else [(r, data)])]
        del table, blobs
        items.sort(key=lambda i: i[1])
        senders, asked_here = [(r, s) for r, s, _ in items], [list(unframe(unpack(f))) for _, _, f in items]
        del items
        replies, bucket = iter(reply([b for sent in asked_here for _, b in sent])), key[0].as_py()
        said = [(r, s, pack(frame([(c, next(replies)) for c, _ in sent]))) for (r, s), sent in zip(senders, asked_here, strict=True)]
        if not relayed:
            return blob_table([(s, bucket, kind, f) for _, s, f in said])
        back: dict[int, Sent] = {}
        for r, s, f in said:
            back.setdefault(r, []).append((s, f))
        return blob_table([(r, bucket, kind, frame(got)) for r, got in back.items()])

    if not relayed:
        return asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, BLOBS)
    ranged = asked.mapInArrow(_by_range(-(-buckets // places)), BLOBS).withColumn("part", F.floor(F.col("chunk") / F.lit(places)).cast("long"))
    out = ranged.groupBy("bucket", "part").applyInArrow(_relay("chunk", "bucket"), BLOBS)
    answered = out.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, BLOBS)
    return answered.groupBy("chunk").applyInArrow(_relay("bucket", "chunk"), BLOBS)


def hear(
    chunks: DataFrame, replies: DataFrame, then: Callable[[Texts, dict[int, dict[int, bytes]]], Sent | pa.Table], schema: str, framed: bool = False
) -> DataFrame:
    """then: a chunk's texts and its replies by kind and bucket; it gives a table of schema, or with
    BLOBS the pairs of the second question.  framed: replies came by relays."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, got: pa.Table) -> pa.Table:
        unpack, by = zstandard.ZstdDecompressor().decompress, {}
        for kind, bucket, data in zip(*(got.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
            for b, f in unframe(data) if framed else [(bucket, data)]:
                for chunk, blob in unframe(unpack(f)):
                    by.setdefault(chunk, {1: {}, 2: {}})[kind][b] = blob
        del got
        said = ((chunk, then(texts, by.pop(chunk, {1: {}, 2: {}}))) for chunk, texts in _spoken_for(table))
        return _frames(key[0].as_py(), 2, said) if schema == BLOBS else pa.concat_tables([rows for _, rows in said])

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


# --- the first question: which anchor hashes do other chunks hold, and how many documents? ---


def split_by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, low 32 bits) of 64-bit keys: sorted entries, bucket bounds, inverse."""
    place = (keys >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)
    entries, inverse = np.unique(place, return_inverse=True)
    bounds = np.searchsorted(entries, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    return entries, bounds, inverse


def entry_blobs(entries: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes]]:
    """Per bucket: the low halves of its entries and the log2 of each one's count here."""
    scale = np.frexp(counts)[1].astype(np.uint8)
    return [
        (b, entries[lo:hi].astype("<u4").tobytes() + scale[lo:hi].tobytes())
        for b, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        if hi > lo
    ]


def reply_shared(hot: int) -> Callable[[list[bytes]], list[bytes]]:
    """Two bits per entry: held by more than one chunk; counted about `hot` times or more by all chunks."""

    def run(blobs: list[bytes]) -> list[bytes]:
        sizes = np.array([len(b) // 5 for b in blobs])
        entries = np.concatenate([np.frombuffer(b, "<u4", n) for b, n in zip(blobs, sizes, strict=True)])
        scale = np.concatenate([np.frombuffer(b, np.uint8, n, 4 * n) for b, n in zip(blobs, sizes, strict=True)])
        order = np.argsort(entries, kind="stable")
        new = np.append(True, entries[order][1:] != entries[order][:-1])
        first = np.flatnonzero(new)
        held = np.diff(np.append(first, len(order)))
        count = np.add.reduceat(np.int64(1) << (scale[order].astype(np.int64) - 1), first)
        group = np.cumsum(new) - 1
        shared, many = np.empty(len(order), bool), np.empty(len(order), bool)
        shared[order], many[order] = (held > 1)[group], (count >= hot)[group]
        out, at = [], 0
        for n in sizes:
            out.append(np.packbits(np.concatenate([shared[at : at + n], many[at : at + n]])).tobytes())
            at += n
        return out

    return run


def heard_bits(replies: dict[int, bytes], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of every entry of a chunk."""
    shared, many = np.zeros(bounds[-1], bool), np.zeros(bounds[-1], bool)
    for bucket, blob in replies.items():
        lo, hi = bounds[bucket], bounds[bucket + 1]
        bits = np.unpackbits(np.frombuffer(blob, np.uint8), count=2 * (hi - lo)).astype(bool)
        shared[lo:hi], many[lo:hi] = bits[: hi - lo], bits[hi - lo :]
    return shared, many


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (sizes[0] of them), starts[1], ..."""
    if not len(sizes):
        return np.empty(0, np.int64)
    base = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    return base + np.arange(int(sizes.sum()))
