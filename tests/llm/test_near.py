import re

import numpy as np
import pyarrow as pa
import xxhash

from quire.llm import simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    codes = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4)
    labels = simhash.join_components(np.arange(len(rows)), a, b)
    low = {}
    for (i, _), k in zip(rows, labels):
        low[k] = min(i, low.get(k, i))
    return sorted((i, f"{int(c):016x}", low[k]) for (i, _), c, k in zip(rows, codes, labels))


def as_rows(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_groups(awkward, rows):
    assert as_rows(simhash.near_groups(awkward)) == brute_groups(rows)


def test_empty(nothing):
    assert simhash.near_groups(nothing).count() == 0


def test_small_roots_go_through_the_index(monkeypatch):
    seen = []

    class Watched(simhash.GrayIndex):
        def __init__(self, codes, first=None):
            seen.extend(codes.tolist())
            super().__init__(codes, first)

    monkeypatch.setattr(simhash, "GrayIndex", Watched)
    rng = np.random.default_rng(4)
    sizes = [1, 2, 3, 16, 17, 300]
    root = np.repeat(np.arange(len(sizes)), sizes)
    fp = rng.integers(0, 64, len(root)) * 7919
    columns = [root, np.zeros_like(root), fp, np.arange(len(root))]
    list(simhash._link_roots(4)(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["root", "part", "fp", "node"])])))
    assert sorted(seen) == sorted(fp.tolist())


def test_index_over_many_roots_at_once():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 5, 1, 40, 700, 2, 16, 17])
    codes = [np.unique(rng.integers(0, 1 << 12, 3 * n, dtype=np.uint64))[:n] for n in sizes]
    codes = [c[np.argsort(simhash.gray_rank(c))] for c in codes]
    first = np.cumsum([0, *map(len, codes)])[:-1]
    got = simhash.GrayIndex(np.concatenate(codes), first).forest(2)
    for c, at in zip(codes, first):
        a, b = np.nonzero(np.bitwise_count(c[:, None] ^ c[None, :]) <= 2)
        assert (got[at : at + len(c)] - at == simhash.join_components(np.arange(len(c)), a, b)).all()


def test_hot_group_in_tiles(spark):
    rows = [(i, f"w{i % 7} " + "alpha beta gamma delta " * 50 + f"x{i % 300}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(simhash.near_groups(df, tile=64)) == brute_groups(rows)


def test_index_finds_every_link():
    rng = np.random.default_rng(1)
    for n in (1, 2, 17, 40, 900, 4000):
        base = rng.integers(0, 2**63, max(1, n // 40), dtype=np.uint64)
        codes = base[rng.integers(0, len(base), n)]
        for _ in range(3):
            codes = codes ^ np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        codes = np.unique(codes)
        codes = codes[np.argsort(simhash.gray_rank(codes))]
        a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4)
        assert (simhash.GrayIndex(codes).forest(4) == simhash.join_components(np.arange(len(codes)), a, b)).all()


def test_roots_cover_every_pair_within_the_bound():
    rng = np.random.default_rng(2)
    for blocks in (6, 7, 8, 10):
        masks = [np.uint64(m) for m in simhash.root_masks(blocks)]
        for _ in range(200):
            flips = rng.choice(64, 4, replace=False)
            differ = np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
            assert any(differ & m == 0 for m in masks)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 499)], "u long, v long")
    for hot in (100_000, 2):
        got = {r.node: r.component for r in simhash.components(edges, hot).collect()}
        assert all(got[i] == 0 for i in range(1, 201)) and got[500] == 499


def test_filter_keeps_one_row_a_group(awkward):
    kept = simhash.drop_near_copies(awkward)
    assert kept.schema == awkward.schema
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 2, 3, 4, 5, 6, 7} - set(ids) == {2, 3, 4, 6, 7} and len(ids) == len(set(ids))


def test_filter_decides_on_rows(spark):
    far = [" ".join(f"{w}{i}" for i in range(80)) for w in ("red", "blue", "green")]
    rows = [(5, far[0]), (9, far[0]), (5, far[1]), (7, far[2]), (7, far[2]), (None, "x"), (4, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash.drop_near_copies(df).collect()), key=str)
    assert got == sorted([(5, far[0]), (5, far[1]), (7, far[2]), (3, "")], key=str)
