import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from quire.llm import sentencepiece_scan as S

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def by_chunks(text, size):
    p, t = S.pieces(), S.marked(text)
    chunks = []
    for c in range(max(1, -(-len(t) // size))):
        lo, hi = c * size, min(len(t), (c + 1) * size)
        left = max(0, lo - p.longest)
        chunks.append(S.Chunk(p, t[left : hi + p.longest], lo - left, hi - left))
    states = S.scan([c.transfer() for c in chunks])
    ids = b"".join(c.backtrace(a, b) for c, a, b in zip(chunks, states, states[1:]))
    return np.frombuffer(ids, "<u4").tolist()


def test_scan_equals_library():
    random.seed(2)
    for _ in range(25):
        letters = random.choice(["ab ", "the ofinato ", "  x", "thnderingo", "é漢 a\n0", "aa▁ ", " "])
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 90)))
        for size in (5, 20, 200):
            assert by_chunks(text, size) == LIBRARY.encode(text)


def test_runs_of_matrices_give_the_states_of_the_whole_scan():
    rng = np.random.default_rng(5)
    for _ in range(40):
        # one state at a boundary lies on the best path, as in texts
        wide = [1, *rng.integers(1, 6, 11), 1]
        path = [int(rng.integers(0, w)) for w in wide]
        ms = [np.where(rng.random((a, b)) < 0.3, -np.inf, rng.integers(-9, -1, (a, b)).astype(float)) for a, b in zip(wide, wide[1:])]
        for m, a, b in zip(ms, path, path[1:]):
            m[a, b] = 0.0
        assert S.scan(ms) == path
        runs = [ms[i : i + 4] for i in range(0, 12, 4)]
        ends = S.scan([S.product(r) for r in runs])
        states = [path[0]]
        for r, a, b in zip(runs, ends, ends[1:]):
            states += S.scan(r, a, b)[1:]
        assert states == path


def test_documents(awkward, rows, nothing):
    for chunk, run in ((1 << 15, 256), (700, 256), (700, 3)):
        ids = {}
        for r in sorted(S.encode_pieces(awkward, chunk=chunk, run=run).collect(), key=lambda r: r.chunk):
            ids.setdefault(r.doc_id, []).append(r)
        for doc_id, text in rows:
            mine = ids[doc_id][:: 2 if doc_id == 9 else 1]
            flat = np.frombuffer(b"".join(r.ids for r in mine), "<u4")
            assert flat.tolist() == LIBRARY.encode(text)
            assert S.decode(flat, S.pieces()) == text
    assert S.encode_pieces(nothing).count() == 0
    sizes = {}
    for r in S.encode_pieces(awkward, chunk=700, summary=True).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.decoded_bytes
    assert all(sizes[i] == len(t.encode()) * (2 if i == 9 else 1) for i, t in rows)


def test_decoding_gives_the_texts_back(spark, awkward, rows, nothing):
    texts = dict(rows)
    for chunk in (1 << 15, 700):
        got = S.encode_pieces(awkward, chunk=chunk, summary=True).collect()
        ends = sorted((r.doc_id, r.decoded_sha256) for r in got if r.chunk + 1 == r.chunks)
        assert ends == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
        once = awkward.where("doc_id <> 9")
        parts = {}
        for r in sorted(S.decode_pieces(S.encode_pieces(once, chunk=chunk)).collect(), key=lambda r: r.chunk):
            parts[r.doc_id] = parts.get(r.doc_id, "") + r.text
        assert parts == {i: t for i, t in texts.items() if i != 9}
    assert S.decode_pieces(S.encode_pieces(nothing)).count() == 0


def test_a_character_on_both_sides_of_a_border(spark):
    text = "a \U00012345 b"
    ids = np.array(LIBRARY.encode(text), "<u4")
    for cut in range(len(ids) + 1):
        halves = [(1, 1, 2, ids[cut:].tobytes()), (1, 0, 2, ids[:cut].tobytes())]
        df = spark.createDataFrame(halves, "doc_id long, chunk long, chunks long, ids binary").coalesce(1)
        got = sorted(S.decode_pieces(df).collect(), key=lambda r: r.chunk)
        assert "".join(r.text for r in got) == text and got[1].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
