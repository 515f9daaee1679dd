"""Small inline relations: the dictionary of the registered queries, and Markdown pairs that
the supplied tables have no text of."""

from __future__ import annotations

TERMS = [
    (0, "the", ["of"], "da", "concept", "h1", "m", False, None, 40),
    (1, "que", ["de la"], "kay", "place", "", None, None, "conjunction", 30),
    (2, "re", [], "ray", "person", "h2", "f", False, None, 20),
    (3, "tion", [], "shan", "book", "", None, None, "suffix | rare", 10),
    (4, "Is and", [], "hai aur", "phrase", "h3", None, True, None, 5),
    (5, "der", ["die", "und"], "dar", "concept", "", None, None, None, 25),
    (6, "ou éré", [], "ya", "phrase", "hx", None, None, None, 0),
    (7, "The", ["teh"], "tha", "odd", "", None, None, None, 3),
]
HONORIFICS = [("h1", "(AA)", "(BB)", "(CC)"), ("h2", "(DD)", "(EE)", None), ("h3", "(FF)", None, "(GG)")]

PAIRS = [
    (1, 1, "# One\n\n- a\n- b\n\n![i](x.png) and [l](u)", "# Aik\n\n- a\n\n![i](x.png) aur [l](u)"),
    (1, 2, "> q\n\n| a | b |\n\n```\ncode # no\n```\nSee 2:255 and 3/17 [^1]", "> q\n\n| a | b |\n\n```\ncode # no\n```\nDekho 2:255 [^1]"),
    (2, 1, "## Two\n### Three\n\n1. x\n2. y", "## Do\n## Teen\n\n1. x\n2. y"),
    (2, 2, "[a](u) [b](v) [c](u)", "[a](u) [b](w)"),
    (2, 3, "Plain 1:1 text", ""),
    (3, 1, "متن here قلم", "متن yahan کتاب"),
    (3, 2, "some words", "Here is the translation of some words"),
    (3, 3, "~~~\n# x\n~~~\n# Real", "~~~\n# x\n~~~\n# Asli"),
    (4, 1, "The Prophet said so to the people", "Nabi ne kaha. Nabi Sallallahu Alaihi Wasallam ne kaha, aur Muhammad bin Qasim aaye. Muhammad ne [Nabi: 3] Huzoor"),
    (4, 2, "a line", "this is one of the many things that they have made with their people\n| these are the ones that have been made by them all\nsee http://x.y this is one of the many that they have made"),
    (4, 3, "See (Sahih Bukhari: 12, 13) and (Muslim: 4) [^a] [^b]", "Dekho (Sahih Bukhari, Hadees 12 aur 13) [^a] [^c]"),
    (4, 4, "قل هو الله احد text", "قل text"),
    (4, 5, "![a](p.png)![b](p.png) \\![c](q.png) [x](u)[y](u) \\[z](w)", "![a](p.png) [x](u) [y](v)\n```\n[k](hidden)\n"),
    (4, 6, "```\nlet x\n```", "```\nlet x\n```\n[Translator's Note: done]"),
    (4, 7, "Sure of it", "```\nHere is all of it, said in some other words than those of the text itself\n```"),
    (4, 8, "two words", " \n\t"),
    (4, 9, "قل هو (قل) ١٢", "قل هو (قل) ١٢"),
]
MESSY = [
    (1, "﻿# Title {#id .cls}\r\n\r\n\r\n\r\nA b\\\n:::: {.box}\ntext↩︎ [**bold**] [](#x)\n<div class=\"x\">\nend (#calibre_link-12)\n"),
    (2, "\n\nplain\ntext {.k}\n\n\n\n\nlast\n\n"),
    (3, ""),
]
MARKDOWN = [
    (1, "# H\n\npara\nmore\n\n- a\n\n  b\n- c\n\n> q\n> r\n| t |\n![i](x)\n```\ncode\n\n# no\n```\n1. x"),
    (2, "~~~\n# a\n```\n- b\n~~~\ntext\n## Two\n- x\n\n\n- y\n  z\nend\n```\nopen"),
    (3, ""), (4, "\n\n"), (5, "1) one\n2) two\n\npara - x\n* star\n| a |\n| b |\n> c"),
]
NAMES = [(1, "chunk0001.md"), (2, "chunk12345.md"), (3, "output_chunk0001.md"), (4, "chunk.md"), (5, "chunk7.md")]
REVIEWS = [
    (1, 1, 5, None), (1, 2, 3, "style"), (1, 3, 2, "style"), (1, 3, 2, "terms"), (1, 4, 4, "terms"),
    (2, 1, 1, "missing"), (2, 2, 5, None), (2, 3, 4, "style"),
]


def sql_values(rows: list[tuple], names: str) -> str:
    """The rows as a VALUES list named t(names)."""

    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, int):
            return str(v)
        if isinstance(v, list):
            return f"CAST([{', '.join(map(lit, v))}] AS VARCHAR[])"
        return "'" + str(v).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"
