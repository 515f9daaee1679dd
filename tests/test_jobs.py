import json

import pytest
from pyspark.sql import functions as F

from quire.__main__ import main
from quire.plans import jobs


@pytest.fixture
def place(tmp_path):
    source, run = tmp_path / "in", str(tmp_path / "run")
    source.mkdir()
    (source / "one.md").write_text("# One\n\nOk text of Badr Wells, near Badr Wells text.\n")
    (source / "two.txt").write_text("Plain text of the second book.\n")
    return source, run


def _translator():
    # a closure, since tasks cannot import this module
    def run(frames):
        for f in frames:
            f["out_text"] = f.pop("text").str.replace("text", "matn keh")
            yield f

    return run


worker = _translator()


def test_a_run_from_files_to_books(spark, place, capsys):
    source, run = place
    (source / "three.xyz").write_text("?")
    first = jobs.convert(spark, str(source), run)
    assert (first["documents"], first["rebuilt"], first["chunks"], len(first["skipped"])) == (2, 2, 2, 1)
    (source / "four.md").write_text("# Four\n\nA text.\n")
    again = jobs.convert(spark, str(source), run)
    assert (again["documents"], again["rebuilt"], again["chunks"]) == (3, 1, 3)
    assert {r.domain for r in jobs.domain(spark, run).collect()} == {"general"}
    assert [r.source for r in jobs.mine(spark, run).collect()] == ["Badr", "Badr Wells"]
    assert jobs.translate(spark, run, worker) == 3 and jobs.translate(spark, run, worker) == 0
    done = jobs.check(spark, run, fix=True)
    assert done["chunks"] == 3 and done["errors"] == 0 and done["fixes"] == {"ke": 4}
    # the repairs are in the book, and a second pass has nothing to repair
    made = jobs.build(spark, run)
    assert made["books"] == 3 and not made["errors"]
    texts = [r.text for r in spark.read.parquet(f"{run}/books").collect()]
    assert all("matn ke" in t and "keh" not in t for t in texts)
    assert jobs.check(spark, run, fix=True)["fixes"] == {}
    assert main(["manifest", run]) == 0 and json.loads(capsys.readouterr().out.strip().split("\n")[-1]) == {"rows": 3}


def test_another_source_is_a_drift(spark, place, capsys):
    source, run = place
    jobs.convert(spark, str(source), run)
    jobs.translate(spark, run, worker)
    (source / "two.txt").write_text("Plain text of the second book, longer now.\n")
    with pytest.raises(jobs.Drift, match="two.txt"):
        jobs.convert(spark, str(source), run)
    assert main(["convert", str(source), run]) == 2 and "two.txt" in capsys.readouterr().out
    assert jobs.convert(spark, str(source), run, force=True)["documents"] == 2
    # what was translated from the old text is neither merged nor taken for done
    found = jobs.build(spark, run)
    assert found["books"] == 1 and [f["reason"] for f in found["first"]] == ["source changed"]
    assert jobs.translate(spark, run, worker) == 1
    assert jobs.build(spark, run)["books"] == 2
    # another chunk size is no drift
    assert jobs.convert(spark, str(source), run, target=100)["rebuilt"] == 2


def test_images_must_be_the_sources(spark, place):
    source, run = place
    (source / "one.md").write_text("# One\n\n![a](x.png) text\n")
    jobs.convert(spark, str(source), run)

    def spoil(frames):
        for f in frames:
            f["out_text"] = f.pop("text").str.replace("x.png", "z.png")
            yield f

    jobs.translate(spark, run, spoil)
    found = jobs.build(spark, run)
    assert found["books"] == 1 and {f["reason"] for f in found["first"]} == {"image missing x.png", "image extra z.png"}


def test_honorifics_come_from_the_glossary(spark, place):
    source, run = place
    jobs.convert(spark, str(source), run)
    jobs.translate(spark, run, lambda frames: (f.assign(out_text="Umar ne kaha ke yeh matn hai aur phir woh chala gaya.").drop(columns="text") for f in frames))
    plain = jobs.check(spark, run)["warnings"]
    terms = [{"source": "Umar", "aliases": [], "target": "Umar", "category": "companion", "honorific": "ra", "frequency": 1}]
    with open(f"{run}/glossary.json", "w") as f:
        json.dump({"terms": terms, "honorifics": [{"id": "ra", "target": "(Radiallahu Anhu)"}]}, f)
    assert jobs.check(spark, run)["warnings"] == plain + 2
    assert "| Umar |" in jobs.prompts(spark, run).first().prompt
    assert "W_HONORIFIC" in jobs.prompts(spark, run, "retry").first().prompt
    assert "Badr Wells" in jobs.prompts(spark, run, "glossary").first().prompt


def test_settings_are_kept(spark, place):
    source, run = place
    jobs.convert(spark, str(source), run)
    first = jobs.settings(spark, run).orderBy("doc_id").collect()
    book = F.struct(F.lit("Kitab").alias("title"), F.lit("").alias("subtitle"), F.lit("").alias("author"), F.lit("Ali").alias("translator"), F.lit("").alias("publisher"))
    jobs.configure(spark, run, jobs.settings(spark, run).select("doc_id", F.lit("general").alias("domain"), book.alias("book")))
    (source / "four.md").write_text("# Four\n\nA text.\n")
    jobs.convert(spark, str(source), run)
    now = {r.doc_id: r for r in jobs.settings(spark, run).collect()}
    assert len(now) == 3 and all(now[r.doc_id].domain == "general" and now[r.doc_id].created == r.created and now[r.doc_id].book.title == "Kitab" for r in first)
    jobs.translate(spark, run, worker)
    jobs.build(spark, run)
    assert sum('title: "Kitab"' in r.text and "**Tarjuma:** Ali" in r.text for r in spark.read.parquet(f"{run}/books").collect()) == 2


def test_commands(spark, place, tmp_path, capsys):
    source, run = place
    last = lambda: json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert main(["convert", str(source), run]) == 0 and last()["documents"] == 2
    terms = [{"source": "Badr", "aliases": ["Badr Wells"], "target": "Badr", "category": "place", "honorific": ""}, {"source": "x", "aliases": [], "target": "", "category": "odd", "honorific": "h"}]
    (tmp_path / "g.json").write_text(json.dumps({"terms": terms, "honorifics": []}))
    g = ["--glossary", str(tmp_path / "g.json")]
    assert main(["seed", run, *g]) == 0 and last()["rows"] == 1
    assert main(["validate", run, *g, "--strict"]) == 1 and last()["rows"] == 3
    assert main(["list", run, *g, "--category", "place"]) == 0 and last()["rows"] == 1
    assert main(["count", run, *g]) == 0 and last()["rows"] == 2
    (tmp_path / "n.json").write_text(json.dumps([{"source": "Uhud", "aliases": [], "target": "Uhud", "category": "place"}, {"source": "badr", "aliases": [], "target": "y"}]))
    assert main(["add", run, *g, "--from-json", str(tmp_path / "n.json")]) == 1 and last()["added"] == 1
    assert main(["context", run]) == 0 and last()["rows"] == 2
    assert main(["prompt", run, *g]) == 0 and last()["rows"] == 2
    assert main(["lint", run]) == 1 and last()["errors"] == 2
    assert main(["build", run]) == 1 and last()["books"] == 0
    assert main(["nonsense"]) == 2 and main(["doctor"]) == 0
