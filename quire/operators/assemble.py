"""Merging outputs into books, image parity, front matter, templates and prompts."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as T
from quire.functions.python import per_text
from quire.operators import lint


def ordered_outputs(listed: DataFrame, outputs: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, text, problem) in manifest order; problem names what is wrong with an output."""
    joined = listed.select("doc_id", "chunk_no").join(outputs.select("doc_id", "chunk_no", F.col("out_text").alias("text")), ["doc_id", "chunk_no"], "left")
    return joined.withColumn("problem", F.when(F.col("text").isNull(), "missing").when(T.is_blank("text"), "blank"))


def merge(chunks: DataFrame, key: str = "doc_id", no: str = "chunk_no") -> DataFrame:
    """(key, text): the chunks of a document in order, outer newlines off, blank ones dropped, a blank line between."""
    kept = chunks.select(key, no, T.replace("text", r"\A\n+|\n+\z").alias("text")).where(~T.is_blank("text"))
    listed = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(no, "text"))).alias("parts"))
    return listed.select(key, F.concat(F.array_join(F.col("parts.text"), "\n\n"), F.lit("\n")).alias("text"))


class _Images(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.sources: list[str] = []
        self.bad: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "img":
            self.sources += [v for k, v in attrs if k == "src" and v]
            self.bad += [k for k, _ in attrs if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_:.\-]*", k)]

    handle_startendtag = handle_starttag


def image_tags(text: str) -> tuple[list[str], list[str]]:
    """(sources, names of malformed attributes) of the img tags of a text."""
    parser = _Images()
    parser.feed(text)
    parser.close()
    return parser.sources, parser.bad


def html_images(c: Column | str) -> Column:
    """struct<sources, bad attribute names> of the img tags of a text."""

    tags = lambda text: dict(zip(("sources", "bad"), image_tags(text), strict=True))
    return per_text(lambda: tags, "sources array<string>, bad array<string>", c, null="")


def image_parity(pairs: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, problem, item, n): images of src and out that differ, and attributes only out spoils."""
    marked = pairs.withColumns({"si": html_images("src"), "oi": html_images("out")})
    every = lambda c, i: F.concat(T.find_all(F.col(c), P.IMAGE, 1), F.col(f"{i}.sources"))
    src, out = every("src", "si"), every("out", "oi")
    tag = lambda word, bag: F.transform(bag, lambda m: F.struct(F.lit(word).alias("problem"), m["item"].alias("item"), m["n"].alias("n")))
    found = F.concat(
        tag("missing", lint.bag_minus(src, out)), tag("extra", lint.bag_minus(out, src)),
        tag("attribute", lint.bag_minus(F.col("oi.bad"), F.col("si.bad"))),
    )
    return marked.select("doc_id", "chunk_no", F.inline(found))


def front_matter(meta: DataFrame, subtitle: str = "Roman Urdu Tarjuma", lang: str = "ur-Latn") -> DataFrame:
    """meta (doc_id, title, subtitle, author, translator, publisher, cover_image, date) with front_matter:
    a YAML block and, where a person or publisher is named, a visible section."""
    field = lambda name, c: F.when(~T.is_blank(c), F.concat(F.lit(f"{name}: "), T.yaml_string(c)))
    named = [F.col(c) for c in ("author", "translator", "publisher")]
    shown = [
        F.when(~T.is_blank(c), F.concat(F.lit(word), c, F.lit("  "))) for word, c in zip(("**Taleef:** ", "**Tarjuma:** ", ""), named, strict=True)
    ]
    anyone = F.coalesce(*[F.when(~T.is_blank(c), c) for c in named]).isNotNull()
    section = F.when(anyone, F.concat(F.concat_ws("\n", F.lit("::: {.front-matter}"), *shown, F.lit(":::")), F.lit("\n")))
    block = F.concat_ws(
        "\n", F.lit("---"), field("title", F.col("title")), field("subtitle", F.coalesce("subtitle", F.lit(subtitle))),
        field("author", F.col("author")), field("translator", F.col("translator")), field("publisher", F.col("publisher")),
        field("cover-image", F.col("cover_image")), F.lit(f"lang: {lang}"), field("date", F.coalesce("date", F.date_format(F.current_date(), "yyyy"))),
        F.lit("---"), F.lit(""), section,
    )
    return meta.withColumn("front_matter", block)


def book(merged: DataFrame, meta: DataFrame) -> DataFrame:
    """(doc_id, text): front matter and body."""
    return front_matter(meta).join(merged, "doc_id").select("doc_id", F.concat("front_matter", F.lit("\n"), "text").alias("text"))


# --- templates ---

_IF = re.compile(r"<!--\s*IF:([A-Z_]+)\s*-->(.*?)<!--\s*ENDIF:\1\s*-->\n?", re.S)
_NAME = re.compile(r"\{([A-Z_]+)\}")


def render(template: str, values: Mapping[str, Column]) -> Column:
    """The template as one expression: IF blocks whose value is blank go, {NAME}s are filled in,
    runs of blank lines shrink.  The template is constant, so it is taken apart once here."""

    def fill(text: str) -> list[Column]:
        parts, at = [], 0
        for m in _NAME.finditer(text):
            if m[1] in values:
                parts += [F.lit(text[at : m.start()]), F.coalesce(values[m[1]], F.lit(""))]
                at = m.end()
        return [*parts, F.lit(text[at:])]

    pieces, at = [], 0
    for m in _IF.finditer(template):
        pieces += fill(template[at : m.start()])
        value = values.get(m[1])
        if value is not None:
            body = F.concat(*fill(m[2].strip("\n") + "\n"))
            pieces.append(F.when(T.is_blank(F.coalesce(value, F.lit(""))), "").otherwise(body))
        at = m.end()
    pieces += fill(template[at:])
    return F.concat(T.replace(T.replace(F.concat(*pieces), r"\n{3,}", "\n\n"), r"\A\n+|\n+\z"), F.lit("\n"))


def unresolved(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(T.find_all(c, r"\{([A-Z_]{3,})\}", 1)))


def format_findings(found: Column) -> Column:
    """A findings array as bullet lines; '' without any."""
    word = lambda f: F.when(f["severity"] == "error", "ERROR").otherwise("warning")
    shown = lambda f: F.when(F.size(f["detail"]) > 0, F.concat(F.lit(" ["), F.array_join(f["detail"], "; "), F.lit("]"))).otherwise("")
    one = lambda f: F.concat(F.lit("- "), word(f), F.lit(" "), f["code"], F.lit(": "), f["test"], F.lit(" ("), f["n"].cast("string"), F.lit(")"), shown(f))
    listed = lambda fs: F.concat(F.lit("Linter findings:\n"), F.array_join(F.transform(fs, one), "\n"))
    return T.let(F.array_sort(found), lambda fs: F.when(F.size(fs) > 0, listed(fs)).otherwise(""))


def format_review(score: Column, summary: Column, issues: Column) -> Column:
    head = F.concat(F.lit("Reviewer score: "), F.coalesce(score.cast("string"), F.lit("?")), F.lit("/5. "), F.coalesce(summary, F.lit("")))
    one = lambda i: F.concat(F.lit("- "), F.coalesce(i["type"], F.lit("issue")), F.lit(': "'), F.coalesce(i["quote"], F.lit("")), F.lit('" -> '), F.coalesce(i["suggestion"], F.lit("")))
    return F.array_join(F.concat(F.array(T.strip(head)), F.transform(issues, one)), "\n")


def term_table(chosen: DataFrame) -> DataFrame:
    """chosen (doc_id, chunk_no, position, source, aliases, target, honorific_text, note, category) as
    one Markdown table per chunk."""
    cell = T.table_cell
    note = F.coalesce(F.nullif("note", F.lit("")), "category")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cell("source"), cell(F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ", ")), cell("target"), cell("honorific_text"), cell(note)), F.lit(" |"))
    rows = chosen.groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("r"))
    head = F.lit("| English | Aliases | Roman Urdu | Honorific | Note |\n|---|---|---|---|---|\n")
    return rows.select("doc_id", "chunk_no", F.concat(head, F.array_join(F.col("r.line"), "\n")).alias("term_table"))


def candidate_list(candidates: DataFrame, most: int = 400) -> str:
    """The first `most` candidates (source, frequency, contexts) as JSON: a bounded report for a prompt."""
    rows = candidates.orderBy(F.desc("frequency"), "source").limit(most).collect()
    return json.dumps([r.asDict() for r in rows], ensure_ascii=False, indent=1)


#: Templates of the prompts; a run may bring its own.
TEMPLATES = {
    "translate": (
        "Translate chunk {CHUNK_ID} ({DOMAIN}) into Roman Urdu by the style guide {STYLE_GUIDE_PATH}.\n"
        "<!-- IF:TERM_TABLE -->\nUse these terms:\n\n{TERM_TABLE}\n<!-- ENDIF:TERM_TABLE -->\n"
        "<!-- IF:NEIGHBOR_CONTEXT -->\n{NEIGHBOR_CONTEXT}\n<!-- ENDIF:NEIGHBOR_CONTEXT -->\n"
        "<!-- IF:CUSTOM_INSTRUCTIONS -->\n{CUSTOM_INSTRUCTIONS}\n<!-- ENDIF:CUSTOM_INSTRUCTIONS -->\n"
        "<!-- IF:RETRY_FEEDBACK -->\nThe last attempt was refused:\n{RETRY_FEEDBACK}\n<!-- ENDIF:RETRY_FEEDBACK -->\n"
        "Write only the translation to {OUTPUT_PATH}.\n"
    ),
    "review": "Review {OUTPUT_PATH} against chunk {CHUNK_ID} ({DOMAIN}, {STYLE_GUIDE_PATH}).\n<!-- IF:TERM_TABLE -->\n{TERM_TABLE}\n<!-- ENDIF:TERM_TABLE -->\nWrite score, summary and issues as JSON to {REVIEW_PATH}.\n",
    "glossary": "Choose glossary terms of the book in {OUT_DIR} ({DOMAIN}) from these candidates:\n<!-- IF:CANDIDATES -->\n{CANDIDATES}\n<!-- ENDIF:CANDIDATES -->\nAnswer with a JSON array of terms.\n",
}
TEMPLATES["retry"] = TEMPLATES["translate"]
RETRY = "The previous output failed validation. Re-translate the whole chunk carefully."


def prompts(
    chunks: DataFrame, template: str, kind: str = "translate", tables: DataFrame | None = None, context: DataFrame | None = None,
    feedback: DataFrame | None = None, domain: str = "islamic", instructions: str = "", run_dir: str = ".", style_guide: str = "style-guide.md",
    candidates: str = "",
) -> DataFrame:
    """(doc_id, chunk_no, prompt) from chunks and what is known about them: term_table, neighbour prompt, feedback.
    candidates: for the glossary prompt (see candidate_list)."""
    key = ["doc_id", "chunk_no"]
    if kind not in ("translate", "retry", "review", "glossary"):
        raise ValueError(f"unknown prompt kind {kind!r}")
    parts = (("term_table", tables), ("prompt", context), ("feedback", feedback))
    df = chunks.select(*key)
    for name, part in parts:
        df = df.join(part.select(*key, F.col(name).alias(f"p_{name}")), key, "left") if part is not None else df.withColumn(f"p_{name}", F.lit(""))
    text = lambda name: F.coalesce(f"p_{name}", F.lit(""))
    retry = F.when(T.is_blank(text("feedback")), RETRY).otherwise(text("feedback")) if kind == "retry" else F.lit("")
    name = T.chunk_id("chunk_no")
    values = {
        "OUT_DIR": F.lit(run_dir), "CHUNK_ID": name, "DOMAIN": F.lit("islamic" if domain in ("", "auto") else domain),
        "STYLE_GUIDE_PATH": F.lit(style_guide), "TERM_TABLE": text("term_table"), "NEIGHBOR_CONTEXT": text("prompt"),
        "CUSTOM_INSTRUCTIONS": F.lit(instructions), "RETRY_FEEDBACK": retry, "CANDIDATES": F.lit(candidates),
        "OUTPUT_PATH": F.concat(F.lit(f"{run_dir}/work/output_"), name, F.lit(".md")),
        "REVIEW_PATH": F.concat(F.lit(f"{run_dir}/work/review_"), name, F.lit(".json")),
    }
    return df.select(*key, render(template, values).alias("prompt"))
