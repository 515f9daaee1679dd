"""Substring dedup over words with difference-cover anchors.

Anchors stand at the word positions p with p mod PERIOD in COVER.  For any two positions
some shift below PERIOD takes both onto anchors, so two equal windows of WINDOW words
share an aligned anchor of WINDOW - PERIOD + 1 words.  Anchors are hashed first; where a
hash occurs twice, the match is extended to all windows around the anchor, and those are
compared by 128-bit digests of their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quire.llm.anchors import _TABLE, mix64
from quire.llm.chunks import (
    BLOBS, FAN, Sent, Texts, answer, ask, chunk_size, chunked, entry_blobs, fan_out, hear, heard_bits,
    reply_shared, split_by_bucket,
)

WINDOW = 35
# A perfect difference set; every difference modulo the period occurs once.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)

_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        m = min(have, n - have)
        out[have : have + m] = out[:m] * np.uint64(pow(base, have, 1 << 64))
        have += m
    return out


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end] by prefix sums of a polynomial."""
    out = np.empty(len(starts), np.uint64)
    buf, at = np.frombuffer(data, np.uint8), 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        part = buf[base : int(ends[stop - 1])]
        up = _powers(_BASE, len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * up[:-1], out=sums[1:])
        down = _powers(pow(_BASE, -1, 1 << 64), len(part) + 1)
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def run_hashes(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each position."""
    total = np.zeros(len(at), np.uint64)
    for step in range(length):
        total = total * np.uint64(_BASE) + words[at + step]
    return mix64(total)


class _Chunk:
    """The words of a chunk's documents and their anchors; every pass finds the same ones."""

    def __init__(self, texts: Texts, buckets: int, window: int, period: int, cover: tuple[int, ...]):
        split = [t.split() for t in texts.texts]  # bytes: ASCII white space only
        self.ids, self.count = texts.ids, np.array([len(w) for w in split], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.data = b"\n".join([b" ".join(w) for w in split if w])
        size = np.fromiter((len(w) for ws in split for w in ws), np.int64, int(self.count.sum()))
        del split
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        place = np.arange(len(size)) - np.repeat(self.first, self.count)
        left = np.repeat(self.count, self.count) - place
        self.fits = left >= window  # a window starts here
        anchor = window - period + 1
        self.anchor = np.flatnonzero(np.isin(place % period, cover) & (left >= anchor))
        self.place = place
        words = word_hashes(self.data, self.start, self.end)
        self.entries, self.bounds, self.entry = split_by_bucket(run_hashes(words, self.anchor, anchor), buckets)
        self.held = np.bincount(self.entry, minlength=len(self.entries))

    def windows(self, replies: dict[int, bytes], window: int, period: int, buckets: int):
        """Candidate windows: starts, number of each among the distinct ones, bucket order and bounds, digests, counts."""
        shared, _ = heard_bits(replies, self.bounds)
        hit = self.anchor[(shared | (self.held > 1))[self.entry]]
        # extend: windows that reach over the anchor, back to the start of its document
        n = len(self.start)
        begin = hit - np.minimum(self.place[hit], period - 1)
        reach = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(hit + 1, minlength=n + 1)[: n + 1]
        starts = np.flatnonzero((np.cumsum(reach)[:n] > 0) & self.fits)
        digest, data, number = xxhash.xxh3_128_digest, self.data, {}
        spans = zip(self.start[starts].tolist(), self.end[starts + window - 1].tolist(), strict=True)
        of = np.array([number.setdefault(digest(data[s:e]), len(number)) for s, e in spans], np.int64)
        flat = np.frombuffer(b"".join(number), "<u8").reshape(-1, 2)
        where = (flat[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(buckets + 1))
        return starts, of, order, bounds, flat, np.bincount(of, minlength=len(flat))


def _second_question(buckets: int, window: int, period: int, cover: tuple[int, ...]):
    def run(texts: Texts, replies: dict[int, dict[int, bytes]]) -> Sent:
        c = _Chunk(texts, buckets, window, period, cover)
        _, _, order, bounds, flat, _ = c.windows(replies[1], window, period, buckets)
        cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        return [(b, flat[order[lo:hi]].tobytes()) for b, (lo, hi) in enumerate(cuts) if hi > lo]

    return run


def _reply_digests(blobs: list[bytes]) -> list[bytes]:
    """A bit per digest: does another chunk hold it?"""
    sizes = [len(b) // 16 for b in blobs]
    flat = np.frombuffer(b"".join(blobs), "<u8").reshape(-1, 2)
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    twin = (flat[order][1:] == flat[order][:-1]).all(1)
    held = np.zeros(len(flat), bool)
    held[order[1:][twin]] = held[order[:-1][twin]] = True
    cuts = np.cumsum([0, *sizes])
    return [np.packbits(held[lo:hi]).tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _cut(buckets: int, window: int, period: int, cover: tuple[int, ...], with_text: bool):
    def run(texts: Texts, replies: dict[int, dict[int, bytes]]) -> pa.Table:
        c = _Chunk(texts, buckets, window, period, cover)
        starts, of, order, bounds, flat, times = c.windows(replies[1], window, period, buckets)
        again = times > 1
        for b, blob in replies[2].items():
            mine = order[bounds[b] : bounds[b + 1]]
            again[mine] |= np.unpackbits(np.frombuffer(blob, np.uint8), count=len(mine)).astype(bool)
        dup, n = starts[again[of]], len(c.start)
        reach = np.bincount(dup, minlength=n + 1)[: n + 1] - np.bincount(dup + window, minlength=n + 1)[: n + 1]
        gone, rows = np.cumsum(reach)[:n] > 0, []
        for doc_id, first, count in zip(c.ids.tolist(), c.first.tolist(), c.count.tolist(), strict=True):
            cut = gone[first : first + count]
            if not count:
                kept = b""
            elif cut.any():
                stay = np.flatnonzero(~cut) + first
                kept = b" ".join([c.data[s:e] for s, e in zip(c.start[stay].tolist(), c.end[stay].tolist(), strict=True)])
            else:
                kept = c.data[c.start[first] : c.end[first + count - 1]]
            rows.append((doc_id, count, int(cut.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=names)

    return run


def passage_dedup(
    docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER,
    chunk_bytes: int | None = None, with_text: bool = False, fan: int = FAN,
    together: int | None = None,
) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    Every word covered by a window of `window` words whose sequence also starts anywhere
    else, in the same document or another, goes; all copies go.  Windows are judged on the
    input.  Null, empty and blank texts have no words.  Repeated rows are copies of each other.
    """
    chunk_bytes = chunk_bytes or chunk_size(docs.sparkSession)
    chunks, buckets = chunked(docs, chunk_bytes, chunk_bytes * 3 // 2, together)

    def first(texts: Texts) -> list[tuple[int, bytes]]:
        c = _Chunk(texts, buckets, window, period, cover)
        return entry_blobs(c.entries, c.bounds, c.held)

    framed = fan_out(buckets, fan) < buckets
    one = answer(ask(chunks, first), buckets, reply_shared(1 << 60), 1, fan)
    asked = hear(chunks, one, _second_question(buckets, window, period, cover), BLOBS, framed)
    two = answer(asked, buckets, _reply_digests, 2, fan)
    done = hear(chunks, one.union(two), _cut(buckets, window, period, cover, with_text), RESULT, framed)
    return done if with_text else done.drop("kept_text")
