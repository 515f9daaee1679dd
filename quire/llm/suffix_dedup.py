"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in an earlier document.

A shared window has the same smallest k-gram at the same place in both documents, so only
windows at anchors whose k-gram other documents hold too can be shared (first question).
Those windows' text, once per chunk, goes to the bucket of its k-gram (second question).
A bucket is a small suffix array: windows are put in order by deep-shallow sorting, a
multikey quicksort on 8-byte characters down to a shallow depth and, for the groups that
still agree there, blind tries.  A run of equal windows yields its smallest doc_id.
K-grams with so many blocks that these alone would fill a bucket are sent window by window, to
the bucket of the window, so that none of them gathers in one bucket.  That takes some thirteen
times the bytes, so the bound grows with the buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.anchors import anchor_runs, mix64
from quire.llm.chunks import (
    BLOBS, FAN, Sent, Texts, answer, ask, chunk_size, chunked, entry_blobs, expand, fan_out, frame, hear, heard_bits,
    reply_shared, split_by_bucket, unframe,
)

WINDOW = 50
#: Shorter k-grams make fewer anchors, but are shared by chance more and more as the text grows.
GRAM = 20
#: The least and the usual bound on the blocks that a k-gram sends as blocks: one for so many bytes of a bucket.
HOT, HOT_EACH = 4096, 256
SHALLOW = 2


def hot_for(bucket_bytes: int) -> int:
    """From how many blocks on a k-gram is sent window by window."""
    return max(HOT, bucket_bytes // HOT_EACH)


# --- deep-shallow sorting ---


class BlindTrie:
    """Orders strings of one length that agree on a long prefix, looking at whole strings once each.

    Inner nodes hold a depth and children by the byte there; what lies between is not
    stored.  A search walks blindly to a leaf, compares once, and branches where they differ.
    """

    __slots__ = ("root", "leaves")

    def __init__(self) -> None:
        self.root: list | int | None = None
        self.leaves: list[tuple[bytes, list[int]]] = []

    def add(self, string: bytes, item: int) -> None:
        if self.root is None:
            self.root = 0
            self.leaves.append((string, [item]))
            return
        node = self.root
        while not isinstance(node, int):
            kids = node[1]
            node = kids[string[node[0]]] if string[node[0]] in kids else next(iter(kids.values()))
        other, items = self.leaves[node]
        if other == string:
            items.append(item)
            return
        # the first difference is where the exclusive or of the strings, as numbers, begins
        apart = int.from_bytes(string) ^ int.from_bytes(other)
        lo = len(string) - (apart.bit_length() + 7) // 8
        depth, parent, node = lo, None, self.root
        while not isinstance(node, int) and node[0] < depth:
            parent, node = node, node[1][string[node[0]]]
        self.leaves.append((string, [item]))
        leaf = len(self.leaves) - 1
        if not isinstance(node, int) and node[0] == depth:
            node[1][string[depth]] = leaf
            return
        fork = [depth, {other[depth]: node, string[depth]: leaf}]
        if parent is None:
            self.root = fork
        else:
            parent[1][string[parent[0]]] = fork

    def runs(self) -> list[list[int]]:
        """Items of equal strings together, in string order."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, int):
                out.append(self.leaves[node][1])
            elif node is not None:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def multikey_quicksort(key_at: Callable[[np.ndarray, int], np.ndarray], n: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Items 0..n-1 in the order of their first `shallow` characters: (order, where runs of equal items begin).

    key_at(items, depth) gives characters; they travel with their items and are read again only one
    character deeper.  All segments are split side by side: each chooses the median of three as its
    pivot and is parted into smaller, equal and larger characters; the equal part goes deeper.
    """
    order, fresh = np.arange(n), np.ones(n, bool)
    key_of = key_at(order, 0) if n else np.empty(0, np.uint64)
    lo, size, depth = np.zeros(1, np.int64), np.full(1, n, np.int64), np.zeros(1, np.int64)
    fresh[1:] = False
    while True:
        live = (size > 1) & (depth < shallow)
        lo, size, depth = lo[live], size[live], depth[live]
        if not len(lo):
            return order, fresh
        first = np.cumsum(size) - size
        at = expand(lo, size)
        items, key = order[at], key_of[at]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        less, same = key < pivot, key == pivot
        n_less, n_same = np.cumsum(less), np.cumsum(same)
        less_before, same_before = n_less[first] - less[first], n_same[first] - same[first]
        less_here, same_here = n_less[first + size - 1] - less_before, n_same[first + size - 1] - same_before
        mid, high = lo + less_here, lo + less_here + same_here
        place = np.arange(len(at)) - n_less - n_same + np.repeat(high - first + less_before + same_before, size)
        np.copyto(place, n_less + np.repeat(lo - less_before - 1, size), where=less)
        np.copyto(place, n_same + np.repeat(mid - same_before - 1, size), where=same)
        order[place], key_of[place] = items, key
        larger = size - less_here - same_here
        fresh[mid], fresh[high[larger > 0]] = True, True
        for deeper in range(1, shallow):
            down = (depth + 1 == deeper) & (same_here > 1)
            if down.any():
                there = expand(mid[down], same_here[down])
                key_of[there] = key_at(order[there], deeper)
        lo, size, depth = np.concatenate([lo, mid, high]), np.concatenate([less_here, same_here, larger]), np.concatenate([depth, depth + 1, depth])


def equal_runs(text: bytes, starts: np.ndarray, window: int = WINDOW, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of text at starts in the order of their first `window` bytes.

    Returns (order, run): starts[order] is sorted, run numbers rise where windows differ.  A
    multikey quicksort on 8-byte characters goes down to `shallow` of them; every group that still
    agrees there is ordered by a blind trie.
    """
    words = np.ndarray((len(text),), ">u8", text + bytes(8), strides=(1,))
    order, fresh = multikey_quicksort(lambda items, depth: words[starts[items] + 8 * depth].astype(np.uint64), len(starts), shallow)
    if not len(order):
        return order, np.empty(0, np.int64)
    first = np.flatnonzero(fresh)
    size, done = np.diff(np.append(first, len(order))), 8 * shallow
    many = size > 1
    # groups lie one after the other in these lists; what the tries say of them is written back at once
    place = expand(first[many], size[many])
    held, begins, settled, lengths, at = order[place].tolist(), starts[order[place]].tolist(), [], [], 0
    for n in size[many].tolist():
        trie = BlindTrie()
        for item, s in zip(held[at : at + n], begins[at : at + n], strict=True):
            trie.add(text[s + done : s + window], item)
        for same in trie.runs():
            settled += same
            lengths.append(len(same))
        at += n
    order[place] = settled
    lengths = np.array(lengths, np.int64)
    fresh[place] = False
    fresh[place[np.cumsum(lengths) - lengths]] = True
    return order, np.cumsum(fresh) - 1


# --- a chunk's side ---


class _Chunk:
    """Anchors of a chunk; every pass computes the same ones again."""

    def __init__(self, texts: Texts, buckets: int, window: int, gram: int):
        self.ids, self.data = texts.ids, b"".join(texts.texts)
        self.sizes = np.array([len(t) for t in texts.texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        at, self.lo, self.hi, hashes = anchor_runs(np.frombuffer(self.data, np.uint8), self.ends, window, gram)
        self.off = at - self.lo
        self.doc = np.searchsorted(self.ends, self.lo, side="right")
        keys = mix64(hashes ^ np.uint64(0x9E3779B97F4A7C15))
        self.entries, self.bounds, self.entry = split_by_bucket(keys, buckets)
        order = np.lexsort((self.doc, self.entry))
        entry, doc = self.entry[order], self.doc[order]
        new = np.append(True, (entry[1:] != entry[:-1]) | (doc[1:] != doc[:-1])) if len(order) else np.empty(0, bool)
        self.docs_here = np.bincount(entry[new], minlength=len(self.entries))
        self.blocks_here = np.bincount(self.entry, minlength=len(self.entries))
        self.place = keys


@dataclass
class _Plan:
    """What a chunk sends in its second question, and where it came from."""

    anchor: np.ndarray  # anchors whose k-gram another document holds
    lead: np.ndarray  # of each: the first anchor here with the same block of text (index into anchor)
    plain: np.ndarray  # leads sent as blocks (index into anchor)
    hot: np.ndarray  # leads sent window by window
    windows: list[bytes]  # their distinct windows
    window_doc: np.ndarray  # first document here with that window
    window_of: np.ndarray  # window number at every window of every hot lead


def _plan(c: _Chunk, replies: dict[int, bytes], window: int) -> _Plan:
    shared, many = heard_bits(replies, c.bounds)
    anchor = np.flatnonzero((shared | (c.docs_here > 1))[c.entry])
    data, first = c.data, {}
    spans = zip(c.lo[anchor].tolist(), (c.hi[anchor] + window).tolist(), strict=True)
    lead = np.array([first.setdefault(data[s:e], i) for i, (s, e) in enumerate(spans)], np.int64)
    leads = np.fromiter(first.values(), np.int64, len(first))
    is_hot = many[c.entry[anchor[leads]]] if len(leads) else np.empty(0, bool)
    hot, number, docs, of = leads[is_hot], {}, [], []
    for lo, hi, doc in zip(c.lo[anchor[hot]].tolist(), c.hi[anchor[hot]].tolist(), c.doc[anchor[hot]].tolist(), strict=True):
        for s in range(lo, hi + 1):
            n = number.setdefault(data[s : s + window], len(number))
            if n == len(docs):
                docs.append(doc)
            of.append(n)
    return _Plan(anchor, lead, leads[~is_hot], hot, list(number), np.array(docs, np.int64), np.array(of, np.int64))


def _sent(c: _Chunk, p: _Plan, buckets: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each block and of each hot window."""
    block = (c.place[p.anchor[p.plain]] % np.uint64(buckets)).astype(np.int64)
    single = np.array([xxhash.xxh64_intdigest(w, 7) % buckets for w in p.windows], np.int64)
    return block, single


def _second_question(buckets: int, window: int, gram: int):
    def run(texts: Texts, replies: dict[int, dict[int, bytes]]) -> Sent:
        c = _Chunk(texts, buckets, window, gram)
        p = _plan(c, replies[1], window)
        block, single = _sent(c, p, buckets, window)
        a = p.anchor[p.plain]
        docs = np.concatenate([c.ids[c.doc[a]], c.ids[p.window_doc]]) if len(p.windows) else c.ids[c.doc[a]]
        sizes = np.concatenate([c.hi[a] + window - c.lo[a], np.full(len(p.windows), window)])
        spans = list(zip(c.lo[a].tolist(), (c.hi[a] + window).tolist(), strict=True))
        offs = np.concatenate([c.off[a], np.full(len(p.windows), 255)])
        where = np.concatenate([block, single])
        order = np.argsort(where, kind="stable")
        bounds, rows, plain = np.searchsorted(where[order], np.arange(buckets + 1)), [], len(a)
        for b in range(buckets):
            mine = order[bounds[b] : bounds[b + 1]]
            if len(mine):
                text = b"".join([c.data[slice(*spans[i])] if i < plain else p.windows[i - plain] for i in mine.tolist()])
                rows.append((b, frame([(0, docs[mine].astype("<i8").tobytes()), (1, sizes[mine].astype("<u4").tobytes()), (2, offs[mine].astype(np.uint8).tobytes()), (3, text)])))
        return rows

    return run


# --- a bucket's side ---


def _reply_windows(window: int, gram: int):
    """A bit per window of each block: does an earlier document have it?"""

    def run(blobs: list[bytes]) -> list[bytes]:
        docs, sizes, offs, texts, parts = [], [], [], [], []
        for blob in blobs:
            d, s, o, t = (part for _, part in unframe(blob))
            docs.append(np.frombuffer(d, "<i8"))
            sizes.append(np.frombuffer(s, "<u4").astype(np.int64))
            offs.append(np.frombuffer(o, np.uint8))
            texts.append(t)
            parts.append(len(docs[-1]))
        doc, size, off, text = np.concatenate(docs), np.concatenate(sizes), np.concatenate(offs), b"".join(texts)
        at = np.cumsum(size) - size
        number: dict[bytes, int] = {}
        kind = np.array([number.setdefault(text[s : s + n], len(number)) for s, n in zip(at.tolist(), size.tolist(), strict=True)], np.int64)
        low = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(low, kind, doc)
        first = np.zeros(len(number), np.int64)
        first[kind[::-1]] = np.arange(len(kind))[::-1]  # an occurrence of each distinct block
        # only k-grams with several different blocks leave anything to sort out
        grams: dict[bytes, int] = {}
        gram_of = np.array([
            -1 if off[i] == 255 else grams.setdefault(text[at[i] + off[i] : at[i] + off[i] + gram], len(grams)) for i in first.tolist()
        ], np.int64)
        several = np.bincount(gram_of[gram_of >= 0], minlength=len(grams)) > 1
        look = np.flatnonzero((gram_of >= 0) & several[gram_of]) if len(grams) else np.empty(0, np.int64)
        wins = size[first] - window + 1
        begin = np.cumsum(wins) - wins
        earlier = np.zeros(int(wins.sum()), bool)
        starts = expand(at[first[look]], wins[look])
        owner = np.repeat(look, wins[look])
        order, run_no = equal_runs(text, starts, window)
        if len(order):
            least = np.minimum.reduceat(low[owner[order]], np.flatnonzero(np.append(True, run_no[1:] != run_no[:-1])))
            hit = least[run_no] < low[owner[order]]
            slot = expand(begin[look], wins[look])
            earlier[slot[order[hit]]] = True
        n = size - window + 1
        bits = earlier[expand(begin[kind], n)] | np.repeat(doc > low[kind], n)
        out, i, b = [], 0, 0
        for k in parts:
            e = b + int(n[i : i + k].sum())
            out.append(np.packbits(bits[b:e]).tobytes())
            i, b = i + k, e
        return out

    return run


# --- the end: spans out of the chunk's texts ---

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, source_sha256 string, kept_text string"


def _cut(buckets: int, window: int, gram: int, with_text: bool):
    def run(texts: Texts, replies: dict[int, dict[int, bytes]]) -> pa.Table:
        c = _Chunk(texts, buckets, window, gram)
        p = _plan(c, replies[1], window)
        block, single = _sent(c, p, buckets, window)
        a = p.anchor[p.plain]
        n = np.concatenate([c.hi[a] - c.lo[a] + 1, np.ones(len(p.windows), np.int64)])
        where = np.concatenate([block, single])
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(buckets + 1))
        begin, said = np.cumsum(n) - n, np.zeros(int(n.sum()), bool)
        for b, blob in replies[2].items():
            mine = order[bounds[b] : bounds[b + 1]]
            said[expand(begin[mine], n[mine])] = np.unpackbits(np.frombuffer(blob, np.uint8), count=int(n[mine].sum())).astype(bool)
        # bits of every lead, plain or hot, at bit_at[lead]
        wide = c.hi[p.anchor] - c.lo[p.anchor] + 1
        bit_at = np.zeros(len(p.anchor), np.int64)
        bit_at[p.plain] = begin[: len(a)]
        flat = said
        if len(p.hot):
            own = np.repeat(c.doc[p.anchor[p.hot]], wide[p.hot])
            hot_bits = said[begin[len(a) :]][p.window_of] | (own > p.window_doc[p.window_of])
            bit_at[p.hot] = len(said) + np.cumsum(wide[p.hot]) - wide[p.hot]
            flat = np.concatenate([said, hot_bits])
        later = c.ids[c.doc[p.anchor]] > c.ids[c.doc[p.anchor[p.lead]]]
        dup = flat[expand(bit_at[p.lead], wide)] | np.repeat(later, wide)
        starts = expand(c.lo[p.anchor], wide)[dup]
        depth = np.zeros(len(c.data) + 1, np.int32)
        depth[: len(c.data)] = np.bincount(starts, minlength=len(c.data))[: len(c.data)]
        depth -= np.bincount(starts + window, minlength=len(c.data) + 1)[: len(c.data) + 1].astype(np.int32)
        gone = np.cumsum(depth)[:-1] > 0
        buf, rows = np.frombuffer(c.data, np.uint8), []
        for doc_id, size, end in zip(c.ids.tolist(), c.sizes.tolist(), c.ends.tolist(), strict=True):
            cut = gone[end - size : end]
            if cut.any():
                kept = buf[end - size : end][~cut].tobytes()
                spans = int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(cut[0])
            else:
                kept, spans = c.data[end - size : end], 0
            source = hashlib.sha256(c.data[end - size : end]).hexdigest() if with_text else None
            rows.append((doc_id, size, size - len(kept), spans, hashlib.sha256(kept).hexdigest(), source, kept.decode(errors="ignore") if with_text else None))
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "source_sha256", "kept_text"]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=names)

    return run


def suffix_dedup(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int | None = None, chunk_bytes: int | None = None, with_text: bool = False,
    fan: int = FAN, together: int | None = None,
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text).

    Every byte covered by a `window`-byte string that also starts in a document with a
    smaller doc_id goes; strings are judged on the input and never cross documents.  Rows
    that repeat a doc_id count as one document in this respect: they keep what only they
    share.  kept_text drops the bytes of characters that a cut has split; null and empty
    texts give zeros.
    """
    if not gram <= window <= gram + 254:
        raise ValueError("a window is at least a gram and at most 254 bytes longer")
    chunk_bytes = chunk_bytes or chunk_size(docs.sparkSession)
    bucket_bytes = chunk_bytes * 3 // 2
    chunks, buckets = chunked(docs, chunk_bytes, bucket_bytes, together)

    def first(texts: Texts) -> list[tuple[int, bytes]]:
        c = _Chunk(texts, buckets, window, gram)
        return entry_blobs(c.entries, c.bounds, c.blocks_here)

    framed = fan_out(buckets, fan) < buckets
    one = answer(ask(chunks, first), buckets, reply_shared(hot or hot_for(bucket_bytes)), 1, fan)
    asked = hear(chunks, one, _second_question(buckets, window, gram), BLOBS, framed)
    two = answer(asked, buckets, _reply_windows(window, gram), 2, fan)
    done = hear(chunks, one.union(two), _cut(buckets, window, gram, with_text), RESULT, framed)
    return done if with_text else done.drop("source_sha256", "kept_text")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs, all columns, with text reduced to what no earlier document has; n_chars follows.

    Rows without doc_id are left out; a null text becomes the empty text.
    """
    # one row a key, dealt by the keys of the join: the texts travel once
    kept = suffix_dedup(docs, with_text=True).select("doc_id", "source_sha256", "kept_text").dropDuplicates(["doc_id", "source_sha256"])
    # the text comes out of the operator; of the documents only the other columns travel
    source = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    others = [docs[f"`{c}`"] for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), source.alias("source_sha256"), F.struct(*others).alias("row"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return rows.join(kept, ["doc_id", "source_sha256"]).select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
