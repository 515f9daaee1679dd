"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints that differ in at most `bits` bits agree on all bits of at least
`blocks - bits` of `blocks` blocks.  Each choice of so many blocks is a mask; a masked bit
pattern is a root of the index and all fingerprints below it share that pattern.  Below a
root the fingerprints are sorted by Gray rank; neighbours differ in few bits, so runs of
them factor out the bits they share into nodes of (mask, pattern).  A pair of nodes is cut
off as a whole as soon as the differences accumulated from the root down exceed `bits`.

Only distinct fingerprints enter.  A root emits the edges of a spanning forest, never its
pairs; a root with more than TILE members is dealt out as pairs of sub-groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, documents, join_groups, parts_for, stash

WORDS = 4
BITS = 4
SEED = 42
TILE = 1 << 16
_LEAF, _FAN, _SLICE = 16, 8, 1 << 13
_BROADCAST_ROOTS = 50_000


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of so many words, repeats included; fewer words: of them all."""
    parts = text.encode().lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([h(joined[s:e], seed) for s, e in spans], np.uint64)


def fingerprint(text: str) -> int:
    """Bit b is 1 if set in over half of the shingle hashes; no word: 0."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[8 * byte : 8 * byte + 8] += np.unpackbits(np.ascontiguousarray(part[:, byte])[:, None], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        more = range(2, batch.num_columns)
        columns = [batch.column(0), pa.array(found.view(np.int64)), *map(batch.column, more)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *(batch.schema.names[i] for i in more)])


def block_count(n: int, bits: int = BITS) -> int:
    """Blocks such that a root of n evenly spread fingerprints holds about 16 of them."""
    blocks = bits + 2
    while blocks < 2 * bits + 2 and n > 16 * 2 ** (64 * (blocks - bits) // blocks):
        blocks += 1
    return blocks


def root_masks(blocks: int, bits: int = BITS) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(part[i] for i in kept) for kept in combinations(range(blocks), blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def join_components(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each node's smallest known peer, pointing at itself for roots) after linking a-b."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(labels, np.maximum(la, lb), low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def _children(first: np.ndarray, stop: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (x, y) of a child of a and a child of b, x <= y, and the number of the pair they come from."""
    wide, high = stop[a] - first[a], stop[b] - first[b]
    size = wide * high
    pair = np.repeat(np.arange(len(a)), size)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    x, y = first[a][pair] + k // high[pair], first[b][pair] + k % high[pair]
    ok = x <= y
    return x[ok], y[ok], pair[ok]


class GrayIndex:
    """Nodes of (mask, pattern) over fingerprints in Gray order, for many roots side by side.

    codes: the fingerprints of each root in Gray order, root after root; first: where each root
    begins.  Level 0 holds runs of up to _LEAF codes and every further level runs of up to _FAN
    nodes, none of them across roots, until each root is one node.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray | None = None):
        self.codes = codes
        root = np.zeros(1, np.int64) if first is None else first
        bounds, width = np.append(root, len(codes)), _LEAF
        pattern, mask = codes, np.full(len(codes), ~np.uint64(0))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # pattern, mask, first and stop below
        while True:
            nodes = -(-np.diff(bounds) // width)
            below = np.repeat(bounds[:-1] - width * (np.cumsum(nodes) - nodes), nodes) + width * np.arange(int(nodes.sum()))
            stop = np.minimum(below + width, np.repeat(bounds[1:], nodes))
            lead = np.repeat(pattern[below], stop - below)
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ lead), below)
            self.levels.append((pattern[below] & shared, shared, below, stop))
            pattern, mask = self.levels[-1][:2]
            bounds, width = np.append(0, np.cumsum(nodes)), _FAN
            if (nodes == 1).all():
                break
        # the codes below every node are neighbours: from node_first[level] on
        self.spans = [self.levels[0][2]]
        for level in self.levels[1:]:
            self.spans.append(self.spans[-1][level[2]])

    def forest(self, bits: int) -> np.ndarray:
        """labels of the components under links of at most `bits` differing bits, root by root."""
        n = len(self.codes)
        labels = np.arange(n)
        top = np.arange(len(self.levels[-1][0]))
        todo = [(len(self.levels) - 1, top, top, np.zeros(len(top), np.uint64), np.zeros(len(top), np.int64))]
        while todo:
            level, a, b, known, diff = todo.pop()
            if len(a) > _SLICE:
                half = len(a) // 2
                todo.append((level, a[half:], b[half:], known[half:], diff[half:]))
                todo.append((level, a[:half], b[:half], known[:half], diff[:half]))
                continue
            pattern, mask, first, stop = self.levels[level]
            both = mask[a] & mask[b]
            diff = diff + np.bitwise_count((pattern[a] ^ pattern[b]) & both & ~known)
            keep = diff <= bits
            # pairs whose members are all in one component already can add nothing
            low, high = np.minimum.reduceat(labels, self.spans[level]), np.maximum.reduceat(labels, self.spans[level])
            keep &= ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b, known, diff = a[keep], b[keep], both[keep], diff[keep]
            if not len(a):
                continue
            x, y, pair = _children(first, stop, a, b)
            if level:
                todo.append((level - 1, x, y, known[pair], diff[pair]))
                continue
            near = (x < y) & (np.bitwise_count(self.codes[x] ^ self.codes[y]) <= bits)
            labels = join_components(labels, x[near], y[near])
        return labels


def _link_roots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]) for b in batches if b.num_rows]
        if not got:
            return
        root, part, fp, node = np.concatenate(got, axis=1)
        codes = fp.view(np.uint64)
        order = np.lexsort((node, gray_rank(codes), part, root))
        root, part, codes, node = root[order], part[order], codes[order], node[order]
        first = np.flatnonzero(np.append(True, (root[1:] != root[:-1]) | (part[1:] != part[:-1])))
        labels = GrayIndex(codes, first).forest(bits)
        kids = np.flatnonzero(labels != np.arange(len(codes)))
        a, b = node[kids], node[labels[kids]]
        apart = a != b
        a, b = a[apart], b[apart]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

    return run


def near_links(distinct: DataFrame, n: int, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """Edges (u > v, node ids) that connect what links of at most `bits` differing bits connect.

    distinct: fp long, node long, one row per fingerprint; n: its row count.
    """
    masks = root_masks(block_count(n, bits), bits)
    roots = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)])
    keyed = distinct.select(F.explode(roots).alias("root"), "fp", "node")
    hot = keyed.groupBy("root").count().where(F.col("count") > tile)
    hot = stash(hot.select("root", F.ceil(F.col("count") / F.lit(tile)).cast("int").alias("parts")))
    if hot.count() <= _BROADCAST_ROOTS:
        hot = F.broadcast(hot)
    mine = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.least(mine, other).cast("long") * F.lit(1 << 31) + F.greatest(mine, other),
    )
    dealt = keyed.join(hot, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.select("root", F.explode(pairs).alias("part"), "fp", "node")
    spread = dealt.repartition(parts_for(n * len(masks), 250_000, 6), "root", "part")
    return spread.mapInArrow(_link_roots(bits), "u long, v long").distinct()


def components(edges: DataFrame, least_hot: int = 100_000) -> DataFrame:
    """(node, component): alternating large-star and small-star contraction until nothing moves.

    component is the smallest node reachable.  Nodes without an edge are not returned.  A node of
    very many edges meets its minimum by a broadcast of bounded size (see join_groups).
    """
    edges, before = stash(edges.distinct()), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stash(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        star = join_groups(both, low, "u", "n", least_hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(star.distinct())
        least = stash(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = join_groups(large, least, "u", "n", least_hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        for done in (edges, low, large, least):
            discard(done)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def _marked(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp, more) of every row, written once."""
    rows = documents(docs)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*more).schema.fields]
    return stash(rows.select("doc_id", "text", *more).mapInArrow(_fingerprints, ", ".join(["doc_id long", "fp long", *kinds])))


def _named(marks: DataFrame, bits: int, tile: int) -> DataFrame:
    """(fp, docs, component, component_id) of every fingerprint: component is the smallest fingerprint
    reachable, component_id the smallest doc_id of the component's rows."""
    distinct = stash(marks.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("docs")))
    nodes = distinct.select("fp", F.col("fp").alias("node"))
    found = components(near_links(nodes, distinct.count(), bits, tile)).withColumnRenamed("node", "fp")
    placed = stash(distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    lowest = stash(placed.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n")))
    return stash(join_groups(placed, lowest, "component", "n").select("fp", "docs", "component", "component_id"))


def near_groups(docs: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most `bits` differing
    bits, the document itself included.  Texts without a word (null and empty ones too)
    have fingerprint 0 and link like any other.  Repeated rows are returned each time; texts
    that share a doc_id are linked by their fingerprints alone.
    """
    marks = _marked(docs)
    found = join_groups(marks, _named(marks, bits, tile), "fp", "docs")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """One row of docs, all columns, per group of near copies: one with the smallest doc_id.

    Of several rows with that doc_id in a group, the one whose text has the smallest SHA-256
    digest stays, and one of equal rows.  Rows without doc_id are left out.
    """
    marks = _marked(docs, F.sha2("text", 256).alias("digest"))
    grouped = join_groups(marks, _named(marks, bits, tile), "fp", "docs").where("doc_id = component_id")
    stay = grouped.groupBy("component", "doc_id").agg(F.min("digest").alias("stay_digest")).select(F.col("doc_id").alias("stay_id"), "stay_digest")
    # the rows travel once: the join's key is also the key by which equal rows become one
    id_, digest = docs["doc_id"].cast("long"), F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    packed = docs.select(id_.alias("row_id"), digest.alias("row_digest"), F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    kept = packed.join(stay, (F.col("row_id") == F.col("stay_id")) & (F.col("row_digest") == F.col("stay_digest")), "left_semi")
    one = kept.groupBy("row_id", "row_digest").agg(F.first("row").alias("row"))
    return one.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
