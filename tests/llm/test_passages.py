import hashlib
import inspect
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from quire.llm import chunks, passage_dedup, suffix_dedup
from quire.llm.anchors import anchor_runs


def brute_bytes(rows, window=50):
    low = {}
    for i, t in rows:
        b = t.encode()
        for s in range(len(b) - window + 1):
            low[b[s : s + window]] = min(i, low.get(b[s : s + window], i))
    out = []
    for i, t in rows:
        b = t.encode()
        cut = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            if low[b[s : s + window]] < i:
                cut[s : s + window] = True
        kept = bytes(x for x, c in zip(b, cut) if not c)
        spans = int((cut[1:] & ~cut[:-1]).sum()) + int(cut[:1].sum())
        out.append((i, len(b), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(rows, window=35):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows]
    seen = Counter(tuple(w[s : s + window]) for _, w in split for s in range(len(w) - window + 1))
    out = []
    for i, w in split:
        cut = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                cut[s : s + window] = True
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        out.append((i, len(w), int(cut.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def tangled(n=150, seed=3):
    random.seed(seed)
    letters = ["a", "bb ", "é", "the ", "of\t", "  "]
    passages = ["".join(random.choice(letters) for _ in range(random.randint(40, 160))) for _ in range(10)]
    parts = lambda: [random.choice(passages), "".join(random.choice(letters) for _ in range(random.randint(0, 80))), random.choice(passages)[10:90], "a" * random.randint(0, 120)]
    return [(i * 7 % n, "".join(random.choice(parts()) for _ in range(random.randint(0, 6)))) for i in range(n)]


def byte_rows(df):
    return sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect())


def word_rows(df):
    return sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in df.collect())


@pytest.mark.parametrize("hot", [3, 4096])
def test_suffix_dedup(spark, hot):
    rows = tangled()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert byte_rows(suffix_dedup.suffix_dedup(df, hot=hot, chunk_bytes=8000)) == brute_bytes(rows)


def test_suffix_dedup_awkward(awkward, rows, nothing):
    assert byte_rows(suffix_dedup.suffix_dedup(awkward, chunk_bytes=50_000)) == brute_bytes(rows)
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_relays_change_no_result(spark):
    rows = tangled(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert byte_rows(suffix_dedup.suffix_dedup(df, chunk_bytes=500, fan=3)) == brute_bytes(rows)
    assert word_rows(passage_dedup.passage_dedup(df, chunk_bytes=500, fan=3)) == brute_words(rows)


def test_senders_of_several_chunks_change_no_result(spark):
    rows = tangled(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for fan in (3, 256):
        assert byte_rows(suffix_dedup.suffix_dedup(df, hot=5, chunk_bytes=500, fan=fan, together=4)) == brute_bytes(rows)
        assert word_rows(passage_dedup.passage_dedup(df, chunk_bytes=500, fan=fan, together=4)) == brute_words(rows)


def test_what_is_sent_is_written_once_at_6_gb(spark):
    # 10 GB of text, executors of 1,800 MB: no relay writes it a second time, and frames hold several chunks
    each = (1800 << 20) // 400
    buckets = chunks.parts_for(10 * 10**9, each * 3 // 2)
    assert chunks.fan_out(buckets) == buckets and chunks.speaks_for(buckets) == 4 and chunks.speaks_for(256) == 1
    rows = tangled(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, n = chunks.chunked(df, 500, 750, together=4)
    sent = chunks.ask(dealt, lambda texts: [(b, b"x" * len(texts.ids)) for b in range(n)]).collect()
    total = sum(len(t.encode()) for _, t in rows)
    assert len(sent) <= n * -(-chunks.parts_for(total, 500) // 4)
    unpack = zstandard.ZstdDecompressor().decompress
    assert sum(len(b) for r in sent for _, b in chunks.unframe(unpack(r.blob))) == n * len(rows)


def test_many_buckets_add_no_shuffle(spark):
    df = spark.createDataFrame(tangled(60), "doc_id long, text string")
    total = chunks.text_bytes(df)
    assert chunks.parts_for(total, 45) > 256
    for run in (suffix_dedup.suffix_dedup, passage_dedup.passage_dedup):
        few, many = (run(df, chunk_bytes=n)._jdf.queryExecution().executedPlan().toString().count("Exchange") for n in (total, 30))
        assert few == many


class _Docs:
    def __init__(self, rows):
        self.ids, self.texts = np.array([i for i, _ in rows], np.int64), [t.encode() for _, t in rows]


def second_question(parts, gram, hot, buckets=4):
    """Bytes that chunks send in op5's second question, and how many windows go one by one."""
    held = [suffix_dedup._Chunk(p, buckets, 50, gram) for p in parts]
    asked = [dict(chunks.entry_blobs(c.entries, c.bounds, getattr(c, "blocks_here", c.docs_here))) for c in held]
    told = [{} for _ in parts]
    for b in range(buckets):
        mine = [i for i, a in enumerate(asked) if b in a]
        for i, blob in zip(mine, chunks.reply_shared(hot)([asked[i][b] for i in mine])):
            told[i][b] = blob
    sent = sum(len(blob) for p, t in zip(parts, told) for _, blob in suffix_dedup._second_question(buckets, 50, gram)(p, {1: t, 2: {}}))
    return sent, sum(len(suffix_dedup._plan(c, t, 50).windows) for c, t in zip(held, told))


def test_a_common_passage_is_sent_as_blocks():
    # in 5,000 documents, two a chunk, as a passage of 6 GB may be: it fills no bucket of the check's executors
    assert inspect.signature(suffix_dedup.suffix_dedup).parameters["hot"].default is None
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    passage = " ".join(word() for _ in range(40))
    parts = [_Docs([(2 * n + k, f"{word()} {word()} {passage} {word()}") for k in (0, 1)]) for n in range(2500)]
    hot = suffix_dedup.hot_for((1800 << 20) // 400 * 3 // 2)
    few, none = second_question(parts, suffix_dedup.GRAM, hot)
    many, single = second_question(parts, suffix_dedup.GRAM, 4096)
    assert none == 0 and single > 0 and few < many / 5
    # a bound there is, whatever the buckets: it grows with them and does not vanish
    assert suffix_dedup.hot_for(1 << 20) == 4096 and suffix_dedup.hot_for(1 << 30) == 1 << 22


def test_grams_common_by_chance_are_not_sent():
    # words of few syllables: two in a row recur by chance, 50 bytes do not
    random.seed(9)
    words = ["".join(random.choice(["the", "on", "tion", "er", "ou", "ea", "ed"]) for _ in range(random.randint(1, 4))) for _ in range(200)]
    parts = [_Docs([(100 * n + k, " ".join(random.choice(words) for _ in range(200))) for k in range(100)]) for n in range(8)]
    sent, _ = second_question(parts, suffix_dedup.GRAM, 4096)
    assert sent < second_question(parts, 16, 4096)[0] / 2


def test_a_chunk_sends_to_few_places():
    assert [chunks.fan_out(n, 256) for n in (1, 6, 256, 257, 65_536, 65_537, 10**6)] == [1, 6, 256, 256, 256, 257, 1000]
    items = [(5, b"ab"), (-1, b""), (7, b"c" * 9)]
    assert list(chunks.unframe(chunks.frame(items))) == items and list(chunks.unframe(chunks.frame([]))) == []


def test_windows_out_of_range_are_refused(nothing):
    for window, gram in ((300, 16), (10, 16)):
        with pytest.raises(ValueError):
            suffix_dedup.suffix_dedup(nothing, window, gram)


def test_cut_repeats(awkward):
    got = suffix_dedup.cut_repeats(awkward)
    assert got.columns == awkward.columns
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[6] == "" and text[12] == "a b c d e" and text[1] == "" and len(text[5]) > 9000
    assert sum(r.doc_id == 9 for r in got.collect()) == 2


def test_passage_dedup(spark):
    rows = tangled(seed=4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert word_rows(passage_dedup.passage_dedup(df, chunk_bytes=8000)) == brute_words(rows)


def test_passage_dedup_awkward(awkward, rows, nothing):
    assert word_rows(passage_dedup.passage_dedup(awkward, chunk_bytes=50_000)) == brute_words(rows)
    assert passage_dedup.passage_dedup(nothing).count() == 0


def test_cover_meets_every_shift():
    v, cover = passage_dedup.PERIOD, passage_dedup.COVER
    assert all(any((i + d) % v in cover and (j + d) % v in cover for d in range(v)) for i in range(v) for j in range(v))


def test_deep_shallow_order():
    random.seed(8)
    text = bytes(random.choice(b"ab") for _ in range(3000)) * 2
    starts = np.array([random.randrange(len(text) - 50) for _ in range(4000)])
    order, run = suffix_dedup.equal_runs(text, starts)
    windows = [text[s : s + 50] for s in starts[order]]
    assert windows == sorted(windows)
    assert all((windows[i] == windows[i + 1]) == (run[i] == run[i + 1]) for i in range(len(windows) - 1))


def test_order_uses_no_library_sort_and_tries_settle_every_group(monkeypatch):
    random.seed(10)
    text = bytes(random.choice(b"abc") for _ in range(2000)) * 2
    starts = np.arange(0, len(text) - 50, 4)
    held = []

    class Watched(suffix_dedup.BlindTrie):
        def runs(self):
            found = super().runs()
            held.append(sum(map(len, found)))
            return found

    def refuse(*_, **__):
        raise AssertionError("library sort")

    monkeypatch.setattr(suffix_dedup, "BlindTrie", Watched)
    for name in ("lexsort", "argsort", "sort", "unique"):
        monkeypatch.setattr(np, name, refuse)
    order, run = suffix_dedup.equal_runs(text, starts)
    windows = [text[s : s + 50] for s in starts[order].tolist()]
    assert windows == sorted(windows) and 2 in held


def test_equal_windows_share_their_anchor():
    random.seed(9)
    core = bytes(random.choice(b"abcd") for _ in range(50))
    found = set()
    for _ in range(50):
        left, right = (bytes(random.choice(b"abcd") for _ in range(random.randint(0, 90))) for _ in range(2))
        buf = np.frombuffer(left + core + right, np.uint8)
        at, lo, hi, _ = anchor_runs(buf, np.array([len(buf)]), 50, 16)
        assert (np.diff(lo) > 0).all() and (hi - lo + 1).sum() == len(buf) - 49
        k = np.searchsorted(lo, len(left), side="right") - 1
        found.add(int(at[k]) - len(left))
    assert len(found) == 1
