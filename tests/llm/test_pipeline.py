import hashlib

import corpus_pipeline
from quire.llm import crf_quality, exact_dedup, packing, simhash, suffix_dedup
from quire.llm.common import stash
from test_near import brute_groups
from test_passages import brute_bytes

SF = "/root/testdata/sf0.001"


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, ids that repeat with equal and with other texts, columns whose names clash."""
    far = [" ".join(f"{w}{i}" for i in range(90)) for w in ("red", "blue", "green", "grey")]
    long = " ".join(f"long{i % 977}" for i in range(20_000))
    rows = [
        (5, far[0], "a"), (9, far[0], "b"), (5, far[1], None), (7, far[2], "c"), (7, far[2], "c"), (None, far[3], "d"), (4, None, "e"), (3, "", None),
        (8, long, "f"), (8, long + " end", "g"), (10, far[3] + " " + far[0], "h"), (11, far[3][:300], None), (12, far[3], "i"),
    ]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, row string, fp int, digest string, n_chars long")
    exact = stash(corpus_pipeline.exact(spark, docs, SF))
    want = {}
    for i, t, *_ in rows:
        if i is not None:
            want[t or ""] = max(i, want.get(t or "", i))
    assert sorted((r.text or "", r.doc_id) for r in exact.collect()) == sorted(want.items())
    near = stash(corpus_pipeline.near(spark, exact, SF))
    groups = brute_groups(sorted((r.doc_id, r.text or "") for r in exact.collect()))
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, _, c in groups})
    repeats = stash(corpus_pipeline.repeats(spark, near, SF))
    source = [(r.doc_id, r.text or "") for r in near.collect()]
    cut = brute_bytes(source)
    assert sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in repeats.collect()) == sorted((c[0], c[4]) for c in cut)
    assert all(df.columns == docs.columns for df in (exact, near, repeats))
    packed = corpus_pipeline.packing(spark, repeats, SF).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert len(packed) == len(source)
    empty = docs.limit(0)
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stash(stage(spark, docs, SF))
        assert after.columns == names, name
        if name != "repeats":
            assert after.count() <= docs.count()
        docs = after
    assert docs.groupBy("text").count().where("count > 1 and text <> ''").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    total = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(total) == docs.count() and all(r["sum(length)"] == r["max(doc_tokens)"] for r in total)


def test_run_equals_the_operators_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in crf_quality.quality_scores(docs, labels).collect() if r.predicted}
    rest = docs.where(docs.doc_id.isin(sorted(good)))
    kept = {r.doc_id for r in exact_dedup.exact_groups(rest).collect() if r.kept}
    rest = docs.where(docs.doc_id.isin(sorted(kept)))
    first = {r.doc_id for r in simhash.near_groups(rest).collect() if r.doc_id == r.component_id}
    rest = docs.where(docs.doc_id.isin(sorted(first)))
    texts = suffix_dedup.suffix_dedup(rest, with_text=True).selectExpr("doc_id", "kept_text as text")
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(packing.pack(texts))
