"""Span-protected rewriting: spelling fixes and right-to-left markup.

Which matches may change depends on offsets (code, addresses, Arabic runs and citations are
protected) and on earlier matches (edits must not overlap), so a text is rewritten by one
Arrow function that holds the compiled rules.
"""

from __future__ import annotations

import json
import re
import warnings
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.python import per_text
from quire.functions.spelling import SHIPPED_RULES

_ARABIC = "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
_PROTECTED = [
    re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S),
    re.compile(r"`[^`\n]+`"),
    re.compile(r"(?:https?://|www\.)\S+"),
    re.compile(f"[{_ARABIC}][{_ARABIC}\\s]*"),
    re.compile(r"[(\[][^()\[\]\n]*?:\s*[^()\[\]\n]*?\d[^()\[\]\n]*[)\]]"),
]

# The rules that hold where a rule file cannot be read.
DEFAULT_RULES = (
    {"canonical": "ke", "reject": ["keh", "kay"], "safe_fix": True},
    {"canonical": "mein", "reject": ["mei", "mn"], "safe_fix": True},
    {"canonical": "nahi", "reject": ["nahin", "nahee", "nai", "nhi"], "safe_fix": True},
    {"canonical": "yeh", "reject": ["ye"], "safe_fix": True},
    {"canonical": "woh", "reject": ["wo", "vo", "voh"], "safe_fix": True},
    {"canonical": "Tauheed", "reject": ["Tawheed", "Tavheed", "Tauhid", "Tawhid"], "safe_fix": True},
    {"canonical": "Ta'ala", "reject": ["Ta'aala", "Taala", "Ta'alaa", "Ta'aalaa"], "safe_fix": True},
    {"canonical": "Sallallahu Alaihi Wasallam", "safe_fix": True, "regex": r"(?i)sall?all?ahu\s+ala[iy]h[ei]\s+wa\s*sall?am|\(\s*(?:SAW|SAWS|PBUH|S\.A\.W\.?)\s*\)"},
    {"canonical": "Radiallahu Anhu", "safe_fix": True, "regex": r"(?i)ra[dz]i?y?all?ahu\s+anhu\b"},
    {"canonical": "Rahimahullah", "reject": ["Rahimullah", "rahmatullah alaih"], "safe_fix": False},
)


@dataclass(frozen=True)
class Rule:
    canonical: str
    pattern: re.Pattern
    safe: bool


def _whole_words(variants: Iterable[str]) -> str:
    """Any of the variants as whole words, in any case; a longer one before one it begins with."""
    return "(?i)(?<![\\w'])(?:" + "|".join(re.escape(v) for v in sorted(variants, key=lambda v: -len(v))) + ")(?![\\w'])"


def compile_rules(rules: Sequence[dict] | None = None) -> list[Rule]:
    """The rules that have something to look for: an expression of their own, or rejected variants."""
    named = [(r, [v for v in r.get("reject", ()) or () if v]) for r in (DEFAULT_RULES if rules is None else rules) if r.get("canonical")]
    return [Rule(r["canonical"], re.compile(r.get("regex") or _whole_words(words)), bool(r.get("safe_fix"))) for r, words in named if r.get("regex") or words]


def load_rules(path: str | None = None) -> list[Rule]:
    """Rules of a JSON file, the shipped ones without a path; with a warning the default ones if the file
    is missing or unreadable."""
    if path is None:
        return compile_rules(SHIPPED_RULES)
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
        return compile_rules(found if isinstance(found, list) else found["rules"])
    except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
        warnings.warn(f"spelling rules of {path} are unreadable ({e}); the default rules hold", stacklevel=2)
        return compile_rules()


def protected_spans(text: str) -> list[tuple[int, int]]:
    return sorted(m.span() for p in _PROTECTED for m in p.finditer(text))


def _matches(text: str, rules: Sequence[Rule]) -> Iterator[tuple[int, int, int]]:
    """(start, end, rule number) of matches that begin outside protected spans and are not canonical already."""
    shield = bytearray(len(text) + 1)
    for s, e in protected_spans(text):
        shield[s:e] = b"\1" * (e - s)
    for k, rule in enumerate(rules):
        for m in rule.pattern.finditer(text):
            if m.end() > m.start() and not shield[m.start()] and m[0].lower() != rule.canonical.lower():
                yield m.start(), m.end(), k


#: How a replacement is written, by the shape of what it replaces; other shapes take the canonical form.
_SHAPES = ((re.compile(r"[^\W\d_]{2,}"), str.isupper, str.upper), (re.compile(r".+", re.S), lambda w: w[0].isupper(), lambda w: w[0].upper() + w[1:]))


def _as_found(found: str, canonical: str) -> str:
    return next((write(canonical) for shape, holds, write in _SHAPES if shape.fullmatch(found) and holds(found)), canonical)


def fix_text(text: str, rules: Sequence[Rule]) -> tuple[str, dict[str, int]]:
    """The text with safe rules applied, and how often each canonical form was put in.

    Of overlapping matches the one that begins first wins, then the earlier rule.  A match
    in parentheses keeps them.
    """
    safe = [r for r in rules if r.safe]
    out, counts, at = [], {}, 0
    for s, e, k in sorted(_matches(text, safe), key=lambda m: (m[0], m[2])):
        if s < at:
            continue
        found, canonical = text[s:e], safe[k].canonical
        wrapped = found[0] == "(" and found[-1] == ")"
        out += [text[at:s], f"({canonical})" if wrapped else _as_found(found, canonical)]
        counts[canonical] = counts.get(canonical, 0) + 1
        at = e
    return "".join([*out, text[at:]]), counts


def spelling_hits(text: str, rules: Sequence[Rule]) -> list[tuple[str, str, int]]:
    """(canonical, variant as found, times)."""
    seen = Counter((rules[k].canonical, text[s:e]) for s, e, k in _matches(text, rules))
    return [(c, v, n) for (c, v), n in seen.items()]


def apply_fixes(c: Column | str, rules: Sequence[Rule]) -> Column:
    """struct<text, fixes map>."""

    def fix(t: str) -> dict:
        text, counts = fix_text(t, rules)
        return {"text": text, "fixes": list(counts.items())}

    return per_text(lambda: fix, "text string, fixes map<string,int>", c, null="")


def spelling_matches(c: Column | str, rules: Sequence[Rule]) -> Column:
    """array<struct<canonical, variant, n>> of the spellings that the rules reject, for lint."""

    hits = lambda t: [{"canonical": k, "variant": v, "n": n} for k, v, n in spelling_hits(t, rules)]
    return per_text(lambda: hits, "array<struct<canonical:string,variant:string,n:bigint>>", c, null="")


# --- right-to-left markup ---

_DIGITS = "٠-٩۰-۹"
_RUN = re.compile(f"[{_ARABIC}](?:[{_ARABIC}{_DIGITS}\\s]*[{_ARABIC}{_DIGITS}])?")
_LINE = re.compile(f"[\\s{_ARABIC}{_DIGITS}()\\[\\]{{}}«»\"'.,;:!?\\-–—*]+")
_ANY = re.compile(f"[{_ARABIC}]")
_MARKED = re.compile(r"\[[^\]]*\]\{\.arabic[^}]*\}")
OPEN_BLOCK, CLOSE_BLOCK = '::: {.arabic-block dir="rtl" lang="ar"}', ":::"
SPAN = ']{.arabic dir="rtl" lang="ar"}'


def wrap_arabic_text(text: str) -> str:
    """Lines of Arabic alone in fenced divs, runs inside other lines in spans; code and marked text as they are."""
    out: list[str] = []
    state = "prose"  # or code, div, block

    def leave() -> str:
        if state == "block":
            out.append(CLOSE_BLOCK)
        return "prose"

    for line in text.split("\n"):
        bare = line.strip()
        if state == "div":
            out.append(line)
            state = "prose" if bare == CLOSE_BLOCK else "div"
        elif re.match(r"\s*(```|~~~)", line):
            now = "prose" if state == "code" else "code"
            leave()
            out.append(line)
            state = now
        elif state == "code":
            out.append(line)
        elif line.lstrip().startswith("::: {.arabic-block"):
            leave()
            out.append(line)
            state = "div"
        elif _ANY.search(line) and _LINE.fullmatch(line) and not re.match(r"\s*([-*+]|\d+[.)])\s+", line) and not bare.startswith(":::"):
            if state != "block":
                out.append(OPEN_BLOCK)
            out.append(bare)
            state = "block"
        else:
            state = leave()
            out.append(line if _MARKED.search(line) else _RUN.sub(lambda m: f"[{m[0]}{SPAN}", line))
    leave()
    return "\n".join(out)


def wrap_arabic(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    # texts without Arabic never leave the JVM's hands changed
    return F.when(c.rlike(f"[{_ARABIC}]"), per_text(lambda: wrap_arabic_text, "string", c)).otherwise(c)
