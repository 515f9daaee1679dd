"""Checks of (source, output) pairs: structure, citations, commentary, language, spelling,
honorifics, script and length.

Input: pairs (doc_id, chunk_no, src, out).  A check that fails is one finding (severity, code,
test, n, detail): n is the whole number of items, detail shows them, in some checks only the
first ones.  The prose of both sides and its features are columns of their own, worked out
once; the checks are projections over them, and their findings one array per pair.  So
linting is one pass over the pairs without a shuffle.  Roll-ups come after.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as T

FINDING = "struct<severity:string,code:string,test:string,n:bigint,detail:array<string>>"
KEY = ["doc_id", "chunk_no"]
#: The checks that lint can be asked for.
CHECKS = ("commentary", "structure", "citations", "untranslated", "spelling", "honorifics", "script", "length")


def finding(severity: str, code: str, test: str, n: Column, detail: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(test).alias("test"), n.cast("long").alias("n"), detail.alias("detail")).cast(FINDING)


def _if(condition: Column, found: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(found)).otherwise(F.array().cast(f"array<{FINDING}>"))


def _items(severity: str, code: str, test: str, items: Column, most: int | None = None) -> Column:
    """One finding for all items, if there are any; detail has the first `most`."""
    return T.let(items, lambda xs: _if(F.size(xs) > 0, finding(severity, code, test, F.size(xs), F.slice(xs, 1, most) if most else xs)))


def _text(*parts: Column) -> Column:
    return F.concat(*[p.cast("string") for p in parts])


def prose(text: Column) -> Column:
    """struct<kept, fences>: lines outside fenced code, and the number of fence lines.

    A text cut at its fence lines is outside and inside code in turn; of the outside parts
    the line ends next to a fence go.
    """

    def outside(parts: Column) -> Column:
        def own(part: Column, i: Column) -> Column:
            ls = T.lines(part)
            return T.let(ls, lambda x: F.slice(x, F.when(i == 0, 1).otherwise(2), F.greatest(F.lit(0), F.size(x) - F.when(i == 0, 0).otherwise(1) - F.when(i == F.size(parts) - 1, 0).otherwise(1))))

        kept = F.flatten(F.filter(F.transform(parts, lambda p, i: F.when(i % 2 == 0, own(p, i))), lambda x: x.isNotNull()))
        return F.struct(kept.alias("kept"), (F.size(parts) - 1).cast("long").alias("fences"))

    return T.let(F.split(text, P.FENCE_LINE, -1), outside)


def prose_lines(text: Column) -> tuple[Column, Column]:
    found = prose(text)
    return found["kept"], found["fences"]


def features(text: Column, lines: Column | None = None) -> Column:
    """The structure of a text: heading levels, line counts, links, images, footnotes, Arabic characters.
    lines: its prose, if that is at hand."""

    def of(found: Column) -> Column:
        kept = found["kept"]
        joined = F.array_join(kept, "\n")
        number = lambda pattern: F.size(F.filter(kept, lambda x: x.rlike(pattern))).cast("long")
        heads = F.filter(kept, lambda x: x.rlike(P.HEADING))
        return F.struct(
            F.transform(heads, lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})", 1))).alias("headings"),
            number(P.LIST_ITEM).alias("list_items"),
            number(P.QUOTE).alias("blockquotes"),
            number(P.TABLE).alias("table_rows"),
            found["fences"].alias("fences"),
            T.find_all(joined, P.IMAGE, 1).alias("images"),
            T.find_all(joined, P.LINK, 1).alias("links"),
            F.array_distinct(T.find_all(joined, P.FOOTNOTE)).alias("footnotes"),
            T.count(text, f"[{P.ARABIC}]").alias("arabic_chars"),
        )

    return T.let(prose(text), of) if lines is None else of(lines)


def bag_minus(a: Column, b: Column) -> Column:
    """Multiset difference of two arrays, sorted: (item, how many more of it a has)."""
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    more = F.transform(F.array_sort(F.array_distinct(a)), lambda x: F.struct(x.alias("item"), (times(a, x) - times(b, x)).cast("long").alias("n")))
    return F.filter(more, lambda m: m["n"] > 0)


def set_minus(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(F.array_distinct(a), b))


def bag_difference(left: DataFrame, right: DataFrame, key: Sequence[str], item: str) -> DataFrame:
    """The same over rows, for bags of any size: (key, item, missing, extra) where counts differ."""
    on = [*key, item]
    a = left.groupBy(*on).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, on, "full").withColumn("d", F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))
    return both.where("d <> 0").select(*on, F.greatest("d", F.lit(0)).alias("missing"), F.greatest(-F.col("d"), F.lit(0)).alias("extra"))


def check_structure(a: Column, b: Column) -> Column:
    """At most nine findings from the features of both sides."""
    sides = lambda x, y: F.array(_text(F.lit("source "), x), _text(F.lit("output "), y))
    levels = lambda f: F.array_join(f["headings"].cast("array<string>"), ",")
    found = [_if(a["headings"] != b["headings"], finding("error", "E_STRUCTURE", "headings", F.lit(1), sides(levels(a), levels(b))))]
    for name in ("list_items", "blockquotes", "table_rows", "fences"):
        found.append(_if(a[name] != b[name], finding("error", "E_STRUCTURE", name, F.abs(b[name] - a[name]), sides(a[name], b[name]))))
    for name in ("images", "links"):
        each = lambda word, bag: F.flatten(F.transform(bag, lambda m: F.array_repeat(_text(F.lit(f"{word} "), m["item"]), m["n"].cast("int"))))
        differ = F.array_sort(a[name]) != F.array_sort(b[name])
        items = F.concat(each("missing", bag_minus(a[name], b[name])), each("extra", bag_minus(b[name], a[name])))
        found.append(F.when(F.coalesce(differ, F.lit(False)), _items("error", "E_STRUCTURE", name, items)).otherwise(F.array().cast(f"array<{FINDING}>")))
    tagged = lambda word, xs: F.transform(xs, lambda x: _text(F.lit(f"{word} "), x))
    notes = F.concat(tagged("missing", set_minus(a["footnotes"], b["footnotes"])), tagged("extra", set_minus(b["footnotes"], a["footnotes"])))
    found.append(_items("error", "E_STRUCTURE", "footnotes", notes))
    n, m = a["arabic_chars"], b["arabic_chars"]
    found.append(_if((n > 0) & ~((m * 10 >= n * 9) & (m * 10 <= n * 11)), finding("error", "E_STRUCTURE", "arabic_chars", F.abs(m - n), sides(n, m))))
    return F.concat(*found)


def missing_numbers(src: Column, out: Column, whole: bool = False) -> Column:
    """Verse and hadith numbers of the source that the output lacks; whole: as whole numbers only."""
    refs = F.array_sort(F.array_distinct(T.find_all(src, P.NUMBER_REF)))
    present = lambda r: F.array_contains(T.find_all(out, P.NUMBER_REF), r) if whole else out.contains(r)
    return F.filter(refs, lambda r: ~present(r))


def missing_references(src: Column, out: Column) -> Column:
    """Named references "(Name: 1, 2)" that the output has neither as they are nor by last name and numbers."""

    def lacks(low: Column, ref: Column) -> Column:
        names = F.filter(T.find_all(F.regexp_extract(ref, r"^\(([^:]*):", 1), "[A-Za-z']+"), lambda w: F.length(w) > 2)
        name = F.lower(F.try_element_at(names, F.lit(-1)))
        numbers = T.find_all(F.regexp_extract(ref, r":(.*)\)$", 1), r"\d+")
        near = F.forall(numbers, lambda n: F.regexp_like(low, F.concat(F.lit(r"\Q"), name, F.lit(r"\E[^()\n]{0,40}?(?<!\d)"), n, F.lit(r"(?!\d)"))))
        return ~(low.contains(F.lower(T.squash(ref))) | F.coalesce(near, F.lit(False)))

    refs = T.find_all(src, P.NAMED_REF)
    missing = T.let(F.lower(T.squash(out)), lambda low: F.filter(refs, lambda r: lacks(low, r)))
    # most texts name none, and then the output needs no look
    return F.when(src.rlike(P.NAMED_REF), F.array_sort(F.array_distinct(F.transform(missing, T.squash)))).otherwise(F.array().cast("array<string>"))


def check_citations(src: Column, out: Column) -> Column:
    return F.concat(
        _items("error", "E_CITATION", "numbers", missing_numbers(src, out)),
        _items("error", "E_CITATION", "references", missing_references(src, out)),
    )


def check_commentary(src: Column, out: Column) -> Column:
    s, o = F.ltrim(src, F.lit(P.SPACES)), F.ltrim(out, F.lit(P.SPACES))
    note = "[translator's note"
    opening = lambda first: _if(first.rlike(P.COMMENTARY), finding("error", "E_COMMENTARY", "opening", F.lit(1), F.array(F.substring(first, 1, 120))))
    nothing = F.array().cast("array<string>")
    return F.concat(
        T.let(F.regexp_extract(o, r"\A([^\n]*)", 1), opening),
        _if(o.startswith("```") & ~s.startswith("```"), finding("error", "E_COMMENTARY", "code fence", F.lit(1), nothing)),
        _if(F.lower(out).contains(note) & ~F.lower(src).contains(note), finding("error", "E_COMMENTARY", "note", F.lit(1), nothing)),
    )


def check_untranslated(lines: Column) -> Column:
    """lines: the output's prose.  detail has the first ten."""
    english = F.transform(F.filter(lines, T.looks_untranslated), lambda x: F.substring(T.strip(x), 1, 160))
    return _items("error", "E_UNTRANSLATED", "untranslated", english, 10)


def latin_text(lines: Column) -> Column:
    """The lines without Arabic letters, joined."""
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(f"[{P.ARABIC}]")), "\n")


def missing_prophet_honorifics(lines: Column) -> Column:
    """Mentions of the Prophet without the phrase in the 40 characters after them, which are what is
    returned; "Muhammad bin ..." is another man.  lines: the output's prose."""
    son = r"(?i:bin|ibne|ibn-e|ibn|b\.)"
    mention = rf"\b(?:Rasoolullah|Nabi|Huzoor|(?<!\b{son}\s{{0,9}})Muhammad(?!\s+{son}(?!\w)))\b(?=([\s\S]{{0,40}}))"
    after = T.find_all(latin_text(lines), mention, 1)
    return F.filter(after, lambda a: ~a.rlike(f"(?i){P.PROPHET_HONORIFIC}"))


def missing_term_honorifics(lines: Column, target: str, forms: Sequence[str]) -> Column:
    """The 30 characters after each mention of a target, outside citations, that have no form of its honorific."""
    wanted = "|".join(rf"\Q{f.strip('() ').lower()}\E" for f in forms)
    # citations are matched too, so that nothing inside one is; the line end keeps what follows from being empty
    either = rf"{P.CITATION}|{P.whole_word(target.lower(), '')}(?=([\s\S]{{1,30}}))"
    after = T.find_all(F.concat(F.lower(latin_text(lines)), F.lit("\n")), either, 1)
    return F.filter(after, lambda a: (a != "") & ~a.rlike(wanted))


def check_honorifics(lines: Column, expected: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The Prophet's names, then each target of expected (target, forms of its honorific); detail has the
    first five and three."""
    found = [_items("warning", "W_HONORIFIC", "prophet", missing_prophet_honorifics(lines), 5)]
    for target, forms in expected:
        if target and any(f.strip("() ") for f in forms):
            found.append(_items("warning", "W_HONORIFIC", f"term {target}", missing_term_honorifics(lines, target, forms), 3))
    return F.concat(*found)


def check_spelling(matches: Column) -> Column:
    """matches: (canonical, variant, n) of spellings that rules reject (see rewrite.spelling_matches)."""
    total = F.aggregate(matches, F.lit(0).cast("long"), lambda a, m: a + m["n"])
    shown = F.transform(F.array_sort(matches), lambda m: _text(m["canonical"], F.lit(" <- "), m["variant"], F.lit(" x "), m["n"]))
    return _if(F.size(matches) > 0, finding("warning", "W_SPELLING", "spelling", total, shown))


def arabic_words(text: Column) -> Column:
    return F.array_distinct(T.find_all(text, f"[{P.ARABIC}]+"))


def check_script(src: Column, out: Column) -> Column:
    """detail has the first ten words."""
    return _items("warning", "W_URDU_SCRIPT", "script", set_minus(arabic_words(out), arabic_words(src)), 10)


def length_ratio(src: Column, out: Column) -> Column:
    s = F.length(T.strip(src))
    return F.when(s > 0, F.length(T.strip(out)) / s).otherwise(0.0)


def length_outside(src: Column, out: Column) -> Column:
    s, r = F.length(T.strip(src)), length_ratio(src, out)
    return (s > 0) & F.when(s < 200, (r < 0.5) | (r > 4.0)).otherwise((r < 0.9) | (r > 2.3))


def check_length(src: Column, out: Column) -> Column:
    shown = F.array(T.written(T.rounded(length_ratio(src, out))))
    return _if(length_outside(src, out), finding("warning", "W_LENGTH", "length", F.lit(1), shown))


def lint(pairs: DataFrame, expected: Sequence[tuple[str, Sequence[str]]] = (), spelling: Column | None = None, checks: Sequence[str] = CHECKS) -> DataFrame:
    """Per pair: ratio and findings; an empty or missing output has only that finding.

    spelling: the matches for W_SPELLING (see rewrite.spelling_matches).  checks: which ones to run.
    A column fixes of pairs (canonical form, times) is kept for the roll-up.
    """
    src, out = F.coalesce("src", F.lit("")), F.coalesce("out", F.lit(""))
    kept = ["fixes"] if "fixes" in pairs.columns else []
    # each step names what the next ones use more than once
    both = pairs.select(*KEY, *kept, src.alias("src"), out.alias("out"), (F.col("src").isNull() | T.is_blank(out)).alias("empty"), *([spelling.alias("spelled")] if spelling is not None else []))
    both = both.select("*", prose(F.col("src")).alias("src_prose"), prose(F.col("out")).alias("out_prose"))
    both = both.select("*", features(F.col("src"), F.col("src_prose")).alias("a"), features(F.col("out"), F.col("out_prose")).alias("b"))
    s, o, lines = F.col("src"), F.col("out"), F.col("out_prose.kept")
    parts = {
        "commentary": lambda: check_commentary(s, o), "structure": lambda: check_structure(F.col("a"), F.col("b")), "citations": lambda: check_citations(s, o),
        "untranslated": lambda: check_untranslated(lines), "spelling": lambda: check_spelling(F.col("spelled")),
        "honorifics": lambda: check_honorifics(lines, expected), "script": lambda: check_script(s, o), "length": lambda: check_length(s, o),
    }
    wanted = [parts[c]() for c in CHECKS if c in checks and (c != "spelling" or spelling is not None)]
    nothing = F.array(finding("error", "E_EMPTY", "empty", F.lit(1), F.array(F.lit("output is empty or missing"))))
    return both.select(
        *KEY, *kept, F.when(F.col("empty"), 0.0).otherwise(T.rounded(length_ratio(s, o))).alias("ratio"),
        F.when(F.col("empty"), nothing).otherwise(F.concat(*wanted)).alias("findings"),
    )


def findings(linted: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, severity, code, test, n, detail)."""
    # an outer generator has no filter to push below it, so nothing is linted twice
    return linted.select(*KEY, F.inline_outer("findings")).where("code is not null")


def _number(severity: str) -> Column:
    return F.size(F.filter("findings", lambda f: f["severity"] == severity)).cast("long")


def per_chunk(linted: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, errors, warnings, ratio)."""
    return linted.select(*KEY, _number("error").alias("errors"), _number("warning").alias("warnings"), "ratio")


def fix_totals(linted: DataFrame) -> DataFrame:
    """(doc_id, fixes): how often each canonical form was put in; a row per rule at most meets in a map."""
    each = linted.select("doc_id", F.explode("fixes").alias("k", "n")).groupBy("doc_id", "k").agg(F.sum("n").alias("n"))
    return each.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("fixes"))


def summary(linted: DataFrame, strict: bool = False) -> DataFrame:
    """Per document: chunks, errors, warnings, chunks_with_errors, failed (warnings too if strict), and the
    totals of fixes where linted has them."""
    per = per_chunk(linted).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"),
        F.array_sort(F.collect_list(F.when(F.col("errors") > 0, F.col("chunk_no")))).alias("chunks_with_errors"),
    )
    per = per.withColumn("failed", (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0)))
    return per.join(fix_totals(linted), "doc_id", "left") if "fixes" in linted.columns else per
