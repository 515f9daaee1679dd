"""Recurring name candidates: capitalised phrases with frequency and contexts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P

_TOKEN = re.compile(r"[A-Za-z][A-Za-z'’\-]*|[.!?,;:()\[\]\"“”]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_CAPITAL = re.compile(r"[A-Z][A-Za-z'’\-]*")
_CODE_OR_URL = re.compile(r"```.*?```|https?://\S+", re.S)
_HEADING_MARK = re.compile(r"^#{1,6}\s+", re.M)
#: A phrase over one letter per token: a name, then up to five tokens more that end in a name.
_PHRASE = re.compile("N(?:[Nj]{0,4}N)?")
#: Phrases that a task holds before it hands them on.
_HELD = 200_000
#: Groups of tasks.
_PARTS = 1024


def token_kinds(tokens: list[str]) -> str:
    """One letter per token: N a name (capitalised, no stop word), j a connector before a capitalised word, . any other."""
    capital = [bool(_CAPITAL.fullmatch(t)) for t in tokens]
    low = [t.lower() for t in tokens]
    return "".join(
        "N" if up and t not in P.STOP else "j" if t in P.CONNECTORS and ahead else "."
        for t, up, ahead in zip(low, capital, [*capital[1:], False][: len(tokens)], strict=True)
    )


def phrases_in(sentence: str) -> list[tuple[str, bool]]:
    """(phrase, opens the sentence): names with the connectors between them, up to six words; the first
    word of a longer phrase counts on its own too."""
    tokens = _TOKEN.findall(sentence)
    out = []
    for m in _PHRASE.finditer(token_kinds(tokens)):
        words = tokens[m.start() : m.end()]
        out += [(" ".join(words), m.start() == 0)] + [(words[0], m.start() == 0)] * (len(words) > 1)
    return out


def context_of(phrase: str, sentence: str) -> str:
    """160 characters around the phrase's first place in its sentence; the sentence's beginning if its words are apart."""
    s = sentence.strip()
    at = s.find(phrase)
    return re.sub(r"\s+", " ", s if at < 0 else s[max(0, at - 60) : at + len(phrase) + 60])[:160]


_PLACE = "struct<doc_id:bigint,sentence_no:bigint,nth:bigint,context:string>"
_PART = f"part int, phrase string, frequency long, inner_uses long, places array<{_PLACE}>"
_ARROW = pa.schema([
    ("part", pa.int32()), ("phrase", pa.string()), ("frequency", pa.int64()), ("inner_uses", pa.int64()),
    ("places", pa.list_(pa.struct([("doc_id", pa.int64()), ("sentence_no", pa.int64()), ("nth", pa.int64()), ("context", pa.string())]))),
])


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and the two first places of each phrase, combined over the rows of a task."""
    held: dict[str, list] = {}
    part = TaskContext.get().partitionId() % _PARTS

    def flush() -> pa.RecordBatch:
        rows = [(part, p, n, inner, [dict(zip(("doc_id", "sentence_no", "nth", "context"), x, strict=True)) for x in places]) for p, (n, inner, places) in held.items()]
        held.clear()
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            plain = _HEADING_MARK.sub("", _CODE_OR_URL.sub(" ", text or ""))
            for no, sentence in enumerate(_SENTENCE.split(plain)):
                for nth, (phrase, first) in enumerate(phrases_in(sentence)):
                    entry = held.setdefault(phrase, [0, 0, []])
                    entry[0] += 1
                    entry[1] += not first
                    if len(entry[2]) < 2 or (doc_id, no, nth) < entry[2][-1][:3]:
                        entry[2] = sorted([*entry[2], (doc_id, no, nth, context_of(phrase, sentence))])[:2]
        if len(held) > _HELD:
            yield flush()
    if held:
        yield flush()


def phrase_counts(docs: DataFrame) -> DataFrame:
    """(phrase, frequency, inner_uses, places): every phrase once, with its two first places.

    Texts are read once.  Tasks combine their rows, groups of tasks combine theirs, and then the
    groups meet, so no list holds more than two places of each of a thousandth of the tasks.
    """
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_mine, _PART)
    sums = [F.sum("frequency").alias("frequency"), F.sum("inner_uses").alias("inner_uses")]
    first = F.slice(F.array_sort(F.flatten(F.collect_list("places"))), 1, 2).alias("places")
    return parts.groupBy("phrase", "part").agg(*sums, first).groupBy("phrase").agg(*sums, first)


def candidates(docs: DataFrame, known: DataFrame | None = None, least: int = 2, most: int = 400, triggers: Iterable[str] = ()) -> DataFrame:
    """(source, frequency, contexts): up to `most` phrases by falling frequency, then by phrase.

    Left out: rarer than `least`, single words seen only where a sentence opens, stop and connector
    words, the subject words of honorifics and their triggers, and surfaces in known (key).  contexts
    are of the first two places by (doc_id, sentence, place in it).
    """
    low = F.lower("phrase")
    dull = sorted(P.STOP | P.CONNECTORS)
    all_dull = F.forall(F.split(low, " "), lambda w: w.isin(dull))
    single = ~F.col("phrase").contains(" ")
    covered = sorted({*P.SUBJECT_WORDS, *(t.lower() for t in triggers)})
    good = phrase_counts(docs).where((F.col("frequency") >= least) & ~(single & (F.col("inner_uses") == 0)) & ~all_dull & ~low.isin(covered))
    if known is not None:
        # a glossary's keys: no hint, the planner broadcasts them if they are small
        good = good.join(known.select("key").distinct(), low == F.col("key"), "left_anti")
    best = good.orderBy(F.desc("frequency"), "phrase").limit(most)
    return best.select(F.col("phrase").alias("source"), "frequency", F.col("places.context").alias("contexts"))
