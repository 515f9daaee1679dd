import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import exact_dedup, packing, token_codes
from quire.llm.wordbpe import word_bpe


def whole_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text, add_special_tokens=False).ids, 1]


def kept_once(rows):
    """What exact_groups returns: of equal texts the largest doc_id, once."""
    want = []
    for n, (i, t) in enumerate(rows):
        same = [j for j, u in rows if u == t]
        want.append((i, max(same), len(same), i == max(same) and (i, t) not in rows[:n], hashlib.sha256(t.encode()).hexdigest()))
    return sorted(want)


def test_exact_groups(awkward, rows):
    got = exact_dedup.exact_groups(awkward, salts=3).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == kept_once(rows)


def test_rows_equal_throughout_are_kept_once(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 4)
    rows = sorted([(7, "C")] * 9 + [(5, "C")] * 2 + [(7, "D"), (8, "E"), (8, "E"), (3, "")])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for digest in (exact_dedup.sha256, lambda c: F.lit("one digest")):
        got = exact_dedup.exact_groups(df, digest=digest).select("doc_id", "keep_id", "group_size", "kept").collect()
        assert sorted(map(tuple, got)) == sorted(w[:4] for w in kept_once(rows))


def test_equal_digests_alone_merge_nothing(awkward, rows):
    first_digit = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    for hot in (100_000, 2):
        got = exact_dedup.exact_groups(awkward, salts=3, digest=first_digit, least_hot=hot).collect()
        want = sorted((i, max(j for j, u in rows if u == t), sum(u == t for _, u in rows)) for i, t in rows)
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == want


def test_hot_groups_meet_their_winner_by_broadcast(awkward):
    plain = exact_dedup.exact_groups(awkward)
    hot = exact_dedup.exact_groups(awkward, least_hot=2)
    assert sorted(map(tuple, hot.collect())) == sorted(map(tuple, plain.collect()))


def test_exact_filter_keeps_one_row_a_text(awkward):
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.schema == awkward.schema
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7, 8, 9, 11, 12, 13]
    assert {r.doc_id: r.keep_id for r in kept.collect()}[6] == "k"


def test_exact_filter_decides_on_rows(spark):
    df = spark.createDataFrame([(5, "A"), (9, "A"), (5, "B"), (7, "C"), (7, "C"), (8, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.drop_exact_copies(df).collect())) == sorted([(5, "B"), (7, "C"), (9, "A"), (8, None)], key=lambda r: r[0])


def test_exact_empty(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_word_bpe_equals_library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    bpe = word_bpe()
    for text in ("", "İstanbul Σ ΑΣ é <|endoftext|>x a\x1cb 　z 漢字 don't I'M 3½ ²a ſ \x00 \u0085b Ǆ ŉ", "x y ÇĞŞ ǅ 'Sam'RE", "á é"):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_word_bpe_equals_library_on_control_characters():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for c in (*map(chr, range(33)), *map(chr, range(127, 161)), "\xad"):
        for text in (c, f"a{c}b", f"a {c}{c} b{c}", f"漢{c} x{c}"):
            assert np.frombuffer(word_bpe().encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="does not cut words"):
        word_bpe(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files(awkward, rows):
    for shard_tokens in (500, 1):
        shards = token_codes.write_token_files(awkward, shard_tokens=shard_tokens, part_bytes=20_000)
        got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_codes.read_token_files(shards).collect())
        at = 0
        for (doc_id, text), (d, start, n, crc) in zip(rows, got, strict=True):
            ids = whole_ids(text)
            assert (d, start, n, crc) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += n


def test_token_files_empty(nothing):
    assert token_codes.read_token_files(token_codes.write_token_files(nothing)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_dac_random_access(ids):
    reader = token_codes.DacReader(token_codes.dac_encode(np.array(ids, np.uint32)))
    assert reader.all().tolist() == ids
    assert [reader[i] for i in range(0, len(ids), 7)] == ids[::7]


@given(st.integers(0, 10**6))
def test_binary_lengths(n):
    parts = packing.binary_lengths(n)
    assert sum(parts) == n and parts == sorted(parts, reverse=True)
    assert all(p & (p - 1) == 0 and p <= packing.LONGEST for p in parts)


def test_pack(awkward, rows):
    got = packing.pack(awkward, with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    lengths = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    for doc_id, text in rows:
        ids = whole_ids(text)
        mine = sorted((r.start, r.length, list(r.ids), r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == doc_id)
        times = sum(i == doc_id for i, _ in rows)
        assert [m[0] for m in mine[::times]] == np.cumsum([0, *packing.binary_lengths(len(ids))])[:-1].tolist()
        assert [x for m in mine[::times] for x in m[2]] == ids
        assert all(m[3] == zlib.crc32(np.array(m[2], "<u4").tobytes()) and m[4] == len(ids) for m in mine)


def test_pack_empty(nothing):
    assert packing.pack(nothing).count() == 0
