"""Regular expressions shared by the operators, in the dialect of java.util.regex.

Word characters are spelled out as Unicode classes: `\\w` means different things in
different engines.
"""

from __future__ import annotations

# Character classes, markers and word lists of the data contract.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_SPACE = r"[^\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
WORD_CHAR = r"\p{L}\p{N}_'"
SENTENCE_END = r"[.!?:;\"”’)\]۔؟]\d{0,2}" + SPACE + r"*\z"
FENCE = r"^\s*(```|~~~)"
FENCE_LINE = r"(?md)^[^\S\n]*(?:```|~~~)[^\n]*"
HEADING = r"^(#{1,6})\s+\S"
LIST_ITEM = r"^\s*([-*+]|\d+[.)])\s+\S"
QUOTE = r"^\s*>"
TABLE = r"^\s*\|"
IMAGE = r"(?<!\\)!\[[^\]]*\]\(\s*([^)\s]+)[^)]*\)"
LINK = r"(?<!!)(?<!\\)\[[^\]]*\]\(\s*([^)\s]+)[^)]*\)"
FOOTNOTE = r"\[\^[^\]\s]+\]"
URL = r"(https?://|www\.)\S+"
INLINE_CODE = r"`[^`\n]+`"
CITATION = r"[(\[][^()\[\]\n]*?:\s*[^()\[\]\n]*?\d[^()\[\]\n]*[)\]]"
NUMBER_REF = r"\b\d+[:/]\d+\b"
NAMED_REF = r"\([A-Za-z][A-Za-z\s\-'.]*:\s*\d+[\d,\s]*\)"
COMMENTARY = r"(?i)^(Here\b|Sure\b|Translation\b|Below\b|Note:|Okay\b|Certainly\b|Of course\b)"
COUNTED_WORD = r"[A-Za-z\x{0600}-\x{06FF}']+"
PROPHET = r"\b(Rasoolullah|Nabi|Huzoor|Muhammad)\b"
PROPHET_HONORIFIC = r"sallallahu\s+alaihi\s+wasallam"

ENGLISH = tuple(
    """
    and of with from which their there would should because about between
    through without these those been have has will they them into than when
    what where whom also only very this that were are not but his her its our
    your who how why some any each other more most such upon after before
    while during then was for by at as it if can could all one two many must
    may might shall does did done being over under again never always every
    both either neither whether however therefore thus hence among against
    toward towards within until since although though unless whereas said
    says made make makes people person things thing way ways know knows knew
    known seen come came went gone got give gave given take took taken here
    """.split()
)

STOP = frozenset(
    """
    a an the and or but if then else of in on at to for from by with without about into onto over under
    between among through during before after above below up down out off again further once here there
    when where why how all any both each few more most other some such no nor not only own same so than
    too very can will just should now this that these those is are was were be been being have has had
    having do does did doing would could may might must shall i you he she it we they me him her us them
    my your his its our their mine yours hers ours theirs what which who whom whose am as also because
    until while unless although though since however therefore thus hence moreover whereas yet
    chapter section part book page volume introduction conclusion preface foreword contents notes index
    appendix figure table example note first second third one two three four five six seven eight nine ten
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july
    august september october november december god lord
    """.split()
)
CONNECTORS = frozenset("al al- ibn bin bint abu abd of ul ud ad as an ar el de the and &".split())
SUBJECT_WORDS = ("allah", "god", "prophet", "messenger", "lord", "creator", "almighty", "prophets")
CATEGORIES = (
    "aqeedah", "fiqh_ibadah", "names_of_allah", "prophet", "companion", "scholar", "book", "surah",
    "place", "phrase", "person", "organization", "concept", "title", "other",
)
GENERAL_CATEGORIES = ("place", "book", "phrase")
STRONG_TERMS = (
    "Allah", "Qur'an", "Quran", "hadith", "Prophet Muhammad", "Sunnah", "Tawhid", "Tawheed", "Shirk",
    "Sahabah", "Companions of the Prophet", "Messenger of Allah", "peace be upon him",
)


def whole_word(surface: str, flags: str = "(?iu)") -> str:
    """Matches a surface form as a whole word, in any case; the surface is quoted."""
    quoted = r"\Q" + surface.replace(r"\E", r"\E\\E\Q") + r"\E"
    return f"{flags}(?<![{WORD_CHAR}]){quoted}(?![{WORD_CHAR}])"
