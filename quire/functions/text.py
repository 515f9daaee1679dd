"""Text expressions.  Each takes and gives a Column and stays inside generated code or
built-in higher-order functions, so filters and projections around it are free to move."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import patterns as P


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def replace(c: Column | str, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(_c(c), F.lit(pattern), F.lit(by))


def count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(_c(c), F.lit(pattern)).cast("long")


def find_all(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rounded(c: Column | str, places: int = 3) -> Column:
    """A number to so many decimals as SQL rounds it, its product with a power of ten to the next whole
    number.  F.round takes the number as it is written: 323 / 80 is 4.037 here, 4.038 there."""
    power = F.lit(10.0**places)
    return F.round(_c(c) * power, 0) / power


def written(c: Column | str, places: int = 3) -> Column:
    """A rounded number without exponent, with one decimal at least."""
    return replace(_c(c).cast(f"decimal(20,{places})").cast("string"), r"(\.\d+?)0+\z", "$1")


def strip(c: Column | str) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.btrim(_c(c), F.lit(P.SPACES))


def is_blank(c: Column | str) -> Column:
    return ~_c(c).rlike(P.NON_SPACE)


def squash(c: Column | str) -> Column:
    """White-space runs as one space, none at the ends."""
    return strip(replace(c, f"{P.SPACE}+", " "))


def lines(c: Column | str) -> Column:
    return F.split(_c(c), "\n", -1)


def sentences(c: Column | str) -> Column:
    return F.split(_c(c), r"(?<=[.!?])\s+|\n+", -1)


def tokens(c: Column | str) -> Column:
    """Words with inner apostrophes and hyphens; punctuation as tokens of its own."""
    return find_all(c, r"[A-Za-z][A-Za-z'’\-]*|[.!?,;:()\[\]\"“”]")


def word_count(c: Column | str) -> Column:
    """At least one, so that it can divide."""
    return F.greatest(F.lit(1).cast("long"), count(c, P.COUNTED_WORD))


def clean_markdown(c: Column | str) -> Column:
    """Conversion leftovers out of Markdown: back arrows, byte order marks, div and attribute
    syntax, link anchors, hard breaks and runs of blank lines; ends in one newline."""
    c = replace(_c(c), "↩︎?|﻿")
    c = replace(replace(c, " ", " "), r"\r\n?", "\n")
    c = replace(c, r"(?dm)^:::+.*$")
    c = replace(c, r"(?dm)^\s*</?div[^>]*>\s*$")
    c = replace(c, r"\(#calibre_link-\d+\)")
    c = replace(c, r"\[\*\*([^*]+)\*\*\]", "**$1**")
    bare = lambda line: F.when(line.rlike(r"^\s*```"), line).otherwise(replace(line, r"[ \t]*\{[#.][^}\n]*\}"))
    c = F.array_join(F.transform(lines(c), bare), "\n")
    c = replace(c, r"(?dm)[ \t]*\\$")
    c = replace(c, r"\[\]\([^)]*\)")
    c = replace(c, r"\n{3,}", "\n\n")
    return F.concat(replace(c, r"\A\n+|\n+\z"), F.lit("\n"))


def dehyphenate(c: Column | str) -> Column:
    """Words that a line break split at a hyphen, whole again."""
    return replace(c, r"(\p{L})-\n(\p{Ll})", "$1$2")


def typical_width(lengths: Column | str) -> Column:
    """The nine-tenths longest of the lengths, at least 40; 80 if there are none."""

    def pick(xs: Column) -> Column:
        at = F.least(F.size(xs) - 1, F.floor(F.size(xs) * F.lit(0.9)).cast("int")) + 1
        return F.when(F.size(xs) > 0, F.greatest(F.lit(40), F.try_element_at(xs, at))).otherwise(80).cast("long")

    return let(F.array_sort(_c(lengths)), pick)


def is_arabic_line(c: Column | str) -> Column:
    """Six tenths of the letters or more are Arabic."""
    letters = count(c, r"\p{L}")
    return (letters > 0) & (count(c, rf"[\p{{L}}&&[{P.ARABIC}]]") * 10 >= letters * 6)


def is_heading_candidate(c: Column | str) -> Column:
    def titled(words: Column) -> Column:
        n, capital = F.size(words), F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        return (n <= 12) & (n >= 2) & (capital >= F.greatest(F.lit(1), F.floor(n * F.lit(0.8))))

    def shouted(words: Column) -> Column:
        return F.size(words) <= 12

    def judge(s: Column) -> Column:
        words = F.filter(F.split(s, f"{P.SPACE}+", -1), lambda w: w != "")
        shape = F.length(s).between(3, 80) & ~s.endswith(",") & s.rlike(r"\p{Lu}") & ~s.rlike(P.SENTENCE_END)
        alone = s.rlike(r"^\p{Nd}") & ~s.rlike(P.SPACE)
        kind = F.when(~s.rlike(r"\p{Ll}"), let(words, shouted)).otherwise(let(words, titled))
        return F.when(shape & ~alone, kind).otherwise(False)

    return let(strip(c), judge)


def is_word_heading(c: Column | str) -> Column:
    return strip(c).rlike(r"^[A-Z][A-Za-z'’-]{2,29}\z")


def line_kind(c: Column | str) -> Column:
    """fence, heading, list, quote, table, image, blank or text."""
    c = _c(c)
    kinds = (("fence", P.FENCE), ("heading", P.HEADING), ("list", P.LIST_ITEM), ("quote", P.QUOTE), ("table", P.TABLE), ("image", r"^\s*!\["))
    out = F.when(is_blank(c), "blank")
    for name, pattern in kinds:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise("text")


def is_skippable(c: Column | str) -> Column:
    """Lines that say nothing about the language of the prose around them."""
    return is_blank(c) | _c(c).rlike(P.URL) | _c(c).rlike(f"[{P.ARABIC}]") | let(strip(c), lambda s: s.rlike(rf"\A{P.CITATION}\z") | s.rlike(r"\A(!\[|\|)"))


def is_arabic_only(c: Column | str) -> Column:
    return _c(c).rlike(rf"""^[\s{P.ARABIC}()\[\]{{}}«»"'.,;:!?\-–—*]+\z""")


def line_words(c: Column | str) -> Column:
    """Lower-case words of a line, code and link targets left out, without outer apostrophes."""
    plain = replace(replace(c, P.INLINE_CODE, " "), r"\]\([^)]*\)", "]")
    return F.filter(F.transform(find_all(F.lower(plain), r"[a-z']+"), lambda w: F.btrim(w, F.lit("'"))), lambda w: w != "")


def looks_untranslated(c: Column | str) -> Column:
    """Eight words or more, three tenths of them English function words, in a line of prose."""
    english = lambda words: F.size(F.filter(words, lambda w: w.isin(*P.ENGLISH))) * 10 >= F.size(words) * 3
    # short lines, the common case, need no closer look
    wordy = _c(c).rlike(r"(?:[A-Za-z']+[^A-Za-z']+){7}[A-Za-z']")
    return F.when(wordy & let(line_words(c), lambda words: (F.size(words) >= 8) & english(words)), ~is_skippable(c)).otherwise(False)


def match_case(found: Column | str, canonical: Column | str) -> Column:
    """canonical in the case pattern of found: all capitals, an initial capital, or as it is."""
    f, k = _c(found), _c(canonical)
    letters = f.rlike(r"\p{L}")
    shout = (F.length(f) > 1) & letters & (F.upper(f) == f) & ~f.rlike(r"[^\p{L}]")
    return F.when(shout, F.upper(k)).when(f.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(k, 1, 1)), F.substring(k, 2, 1 << 20))).otherwise(k)


def yaml_string(c: Column | str) -> Column:
    q = F.replace(F.replace(_c(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), q, F.lit('"'))


def table_cell(c: Column | str) -> Column:
    return F.replace(F.replace(F.coalesce(_c(c), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def slug(c: Column | str) -> Column:
    s = replace(replace(c, r"[^A-Za-z0-9._-]+", "-"), r"\A-+|-+\z")
    return F.when(s == "", "book").otherwise(s)


def chunk_number(name: Column | str) -> Column:
    """The number in chunkNNNN.md; null for other names."""
    return F.try_to_number(F.nullif(F.regexp_extract(_c(name), r"^chunk(\d+)\.md\z", 1), F.lit("")), F.lit("999999999999")).cast("long")


def chunk_id(number: Column | str) -> Column:
    n = _c(number).cast("string")
    return F.concat(F.lit("chunk"), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n))


def first_title(text: Column | str, stem: Column | str) -> Column:
    """The first top heading, else the file stem with spaces for _ and -."""
    found = F.nullif(strip(F.regexp_extract(_c(text), r"(?dm)^# +(.+)$", 1)), F.lit(""))
    return F.coalesce(found, F.translate(_c(stem), "_-", "  "))
