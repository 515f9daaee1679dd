"""Dictionary matching, term statistics, domain decision and glossary maintenance.

A dictionary is a relation (term_id, source, aliases, target, category, honorific, ...).
Matching never joins documents with terms.  A text is read once: surfaces that are one word
are counted by its words, whatever their number, and the others by one automaton.  So a
document yields its hits in place, without a shuffle and at a cost that does not grow with
the dictionary.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as T
from quire.functions.python import per_text

TERM_SCHEMA = (
    "term_id int, source string, aliases array<string>, target string, category string, honorific string, "
    "gender string, plural boolean, note string, frequency long"
)
Surface = tuple[int, str]


def surfaces(terms: DataFrame) -> DataFrame:
    """(term_id, surface): the source and the aliases of every term, blank ones left out."""
    every = F.concat(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>")))
    return terms.select("term_id", F.explode(F.array_distinct(every)).alias("surface")).where(~T.is_blank("surface"))


def surface_list(terms: DataFrame) -> list[Surface]:
    """The dictionary on the driver: it is an input of the plan, as a rule file is, not data."""
    return [(r.term_id, r.surface) for r in surfaces(terms).orderBy("term_id", "surface").collect()]


def count_surface(text: Column | str, surface: str) -> Column:
    """Non-overlapping whole-word matches in any case; a blank surface has none."""
    return T.count(text, P.whole_word(surface)) if surface.strip() else F.lit(0).cast("long")


class _Fold(dict):
    """Characters to the ones that stand for them in any case: the rule of whole_word's expressions,
    character by character, so that lengths stay and no place in a word matters."""

    def __missing__(self, code: int) -> int:
        up = chr(code).upper()
        low = (up if len(up) == 1 else chr(code)).lower()
        self[code] = out = ord(low[0])
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


class Matcher:
    """Counts of the surfaces of a dictionary in a text: whole words, any case, matches of one surface not overlapping."""

    def __init__(self, wanted: Sequence[Surface]):
        import ahocorasick

        self.wanted, self.words, self.others = wanted, {}, {}
        for i, (_, s) in enumerate(wanted):
            key = fold(s)
            # a surface of word characters alone is a whole run of them or nothing
            kind = self.words if re.fullmatch(r"[\w']+", key) else self.others
            if s.strip():
                kind.setdefault(key, []).append(i)
        self.find = ahocorasick.Automaton()
        for key in self.others:
            self.find.add_word(key, key)
        if self.others:
            self.find.make_automaton()

    def counts(self, text: str) -> list[tuple[int, int]]:
        """(place in the dictionary, times) of the surfaces that occur, in dictionary order."""
        low = fold(text)
        seen = Counter(re.findall(r"[\w']+", low)) if self.words else Counter()
        found = [(i, seen[key]) for key in (self.words if len(self.words) < len(seen) else seen) if key in self.words and seen[key] for i in self.words[key]]
        if self.others:
            edge, last, times = re.compile(r"[\w']").match, {}, Counter()
            for end, key in self.find.iter(low):
                start = end - len(key) + 1
                if start >= last.get(key, 0) and not (start and edge(low[start - 1])) and not edge(low[end + 1 : end + 2]):
                    last[key] = end + 1
                    times[key] += 1
            found += [(i, n) for key, n in times.items() for i in self.others[key]]
        return sorted(found)


def surface_hits(docs: DataFrame, wanted: Sequence[Surface], text: str = "text") -> DataFrame:
    """docs with hits: array of (term_id, surface, n) for the surfaces that occur, in dictionary order."""
    kind = "array<struct<term_id:int,surface:string,n:bigint>>"
    if not wanted:
        return docs.withColumn("hits", F.array().cast(kind))

    def match():
        matcher = Matcher(wanted)
        return lambda t: [{"term_id": wanted[i][0], "surface": wanted[i][1], "n": n} for i, n in matcher.counts(t)]

    return docs.withColumn("hits", per_text(match, kind, text, null=""))


def term_hits(docs: DataFrame, wanted: Sequence[Surface], key: str = "doc_id") -> DataFrame:
    """(key, term_id, surface, n): one row per surface that occurs in a document."""
    # an outer generator has no filter to push below it, so the texts are matched once
    return surface_hits(docs.select(key, "text"), wanted).select(key, F.inline_outer("hits")).where("n is not null")


def documents_with_terms(docs: DataFrame, wanted: Sequence[Surface]) -> DataFrame:
    """Documents in which any surface occurs (a semi-join in one pass)."""
    any_of = F.lit(False)
    for _, s in wanted:
        any_of = any_of | F.col("text").rlike(P.whole_word(s))
    return docs.where(any_of)


def term_frequency(docs: DataFrame, wanted: Sequence[Surface]) -> DataFrame:
    """(term_id, frequency) over all documents; aliases that overlap count each for itself."""
    return term_hits(docs, wanted).groupBy("term_id").agg(F.sum("n").alias("frequency"))


def domain_stats(docs: DataFrame, wanted: Sequence[Surface], strong: Sequence[str] = P.STRONG_TERMS) -> DataFrame:
    """Per document: word_count, distinct_terms, total_hits, hits and strong hits per 1000 words, top surfaces."""
    known = {s.lower() for _, s in wanted}
    all_of = [*wanted, *[(-1 - i, s) for i, s in enumerate(strong) if s.lower() not in known]]
    low_strong = [s.lower() for s in strong]
    found = surface_hits(docs.select("doc_id", "text"), all_of)
    total = lambda hits: F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + h["n"])
    strong_hits = F.filter("hits", lambda h: F.lower(h["surface"]).isin(low_strong))
    per = lambda n: T.rounded(F.col(n) * 1000 / F.col("word_count"))
    ranked = F.array_sort(F.transform("hits", lambda h, i: F.struct((-h["n"]).alias("neg"), i.alias("i"), h["surface"].alias("surface"))))
    base = found.select(
        "doc_id",
        T.word_count("text").alias("word_count"),
        F.size(F.array_distinct(F.transform("hits", lambda h: F.lower(h["surface"])))).cast("long").alias("distinct_terms"),
        total(F.col("hits")).alias("total_hits"),
        total(strong_hits).alias("strong_term_hits"),
        F.transform(F.slice(ranked, 1, 15), lambda r: F.struct(r["surface"].alias("surface"), (-r["neg"]).alias("n"))).alias("top_terms"),
    )
    return base.withColumns({"hits_per_1000_words": per("total_hits"), "strong_hits_per_1000_words": per("strong_term_hits")})


def decide_domain(
    stats: DataFrame, least_terms: int = 8, least_density: float = 3.0, least_strong: float = 1.5, override: str | None = None
) -> DataFrame:
    """stats with domain and confidence; override names the domain and keeps the found one as auto_domain."""
    d, dens, strong = F.col("distinct_terms"), F.col("hits_per_1000_words"), F.col("strong_hits_per_1000_words")
    special = ((d >= least_terms) & (dens >= least_density)) | (strong >= least_strong)
    near = (
        (F.abs(d - least_terms) <= F.lit(max(1.0, 0.2 * least_terms)))
        | (F.abs(dens - least_density) <= F.lit(0.2 * least_density))
        | (F.abs(strong - least_strong) <= F.lit(0.2 * least_strong))
    )
    sure = ((d >= 1.5 * least_terms) & (dens >= 1.5 * least_density)) | (strong >= 2 * least_strong)
    clear = (d == 0) & (strong == 0)
    confidence = F.when(special & sure, "high").when(~special & clear, "high").when(near, "low").otherwise("medium")
    domain = F.when(special, "islamic").otherwise("general")
    if override:
        return stats.withColumns({"domain": F.lit(override), "confidence": F.lit("override"), "auto_domain": domain})
    return stats.withColumns({"domain": domain, "confidence": confidence})


def top_terms(docs: DataFrame, wanted: Sequence[Surface], k: int = 15) -> DataFrame:
    """(doc_id, rank, surface, n): the k most frequent surfaces of each document, ties in dictionary order."""
    hits = surface_hits(docs.select("doc_id", "text"), wanted)
    order = F.array_sort(F.transform("hits", lambda h, i: F.struct((-h["n"]).alias("neg"), i.alias("i"), h["surface"].alias("surface"))))
    return hits.select("doc_id", F.posexplode_outer(F.slice(order, 1, k)).alias("pos", "top")).where("pos is not null").select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("rank"), "top.surface", (-F.col("top.neg")).alias("n")
    )


def select_terms(chunks: DataFrame, terms: DataFrame, top_n: int = 25, most: int = 60) -> DataFrame:
    """(doc_id, chunk_no, position, term_id): terms that occur in the chunk, then the globally
    most frequent; the first of equal sources stays; at most `most`."""
    spark = chunks.sparkSession
    rows = terms.orderBy("term_id").collect()
    wanted = [(r.term_id, s) for r in rows for s in dict.fromkeys([r.source, *(r.aliases or [])]) if s and s.strip()]
    ranked = sorted(rows, key=lambda r: -(r.frequency or 0))[:top_n]
    overall = [r.term_id for r in ranked if (r.frequency or 0) > 0]
    key = F.create_map(*[x for r in rows for x in (F.lit(r.term_id), F.lit(r.source.lower()))]) if rows else F.create_map()
    if not rows:
        return spark.createDataFrame([], "doc_id long, chunk_no int, position long, term_id int")
    local = F.array_distinct(F.transform("hits", lambda h: h["term_id"]))
    every = F.concat(local, F.array(*[F.lit(t) for t in overall]).cast("array<int>"))
    # the first of equal sources, in linear time: the smallest (source, place) of each run of the sorted array
    placed = F.array_sort(F.transform(every, lambda t, i: F.struct(key[t].alias("k"), i.alias("i"), t.alias("t"))))
    leads = lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x["k"] != F.get(xs, i - 1)["k"]))
    in_turn = lambda xs: F.array_sort(F.transform(xs, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))
    first = T.let(T.let(placed, leads), in_turn)
    found = surface_hits(chunks.select("doc_id", "chunk_no", "text"), wanted).select(
        "doc_id", "chunk_no", F.posexplode_outer(F.slice(first, 1, most)).alias("pos", "x")
    ).where("pos is not null")
    return found.select("doc_id", "chunk_no", (F.col("pos") + 1).cast("long").alias("position"), F.col("x.t").alias("term_id"))


# --- glossary maintenance: relations of terms, never of text ---


def seed(docs: DataFrame, terms: DataFrame, domain: str | None = None) -> DataFrame:
    """Terms that occur in the documents, with their frequency; the general domain takes places, books and phrases only."""
    usable = terms.where(F.col("category").isin(*P.GENERAL_CATEGORIES)) if domain == "general" else terms
    found = term_frequency(docs, surface_list(usable)).withColumnRenamed("frequency", "found")
    return usable.drop("frequency").join(found, "term_id").withColumnRenamed("found", "frequency")


def recount(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """Every term with its frequency over all chunks, zero included."""
    found = term_frequency(chunks, surface_list(terms)).withColumnRenamed("frequency", "found")
    return terms.drop("frequency").join(found, "term_id", "left").withColumn("frequency", F.coalesce("found", F.lit(0).cast("long"))).drop("found")


def surface_index(terms: DataFrame) -> DataFrame:
    """(key, term_id): the term that a lower-cased surface stands for; the last one wins."""
    return surfaces(terms).groupBy(F.lower(T.strip("surface")).alias("key")).agg(F.max("term_id").alias("term_id"))


def surface_collisions(terms: DataFrame) -> DataFrame:
    """(key, n_terms): surfaces that more than one term claims."""
    return surfaces(terms).groupBy(F.lower(T.strip("surface")).alias("key")).agg(F.countDistinct("term_id").alias("n_terms")).where("n_terms > 1")


def validate(terms: DataFrame, honorifics: DataFrame, strict: bool = True) -> DataFrame:
    """(term_id, problem): missing fields, unknown honorifics, unknown categories (strict), claimed surfaces."""
    missing = terms.select("term_id", F.explode(F.array_compact(F.array(*[
        F.when(F.coalesce(T.is_blank(c), F.lit(True)), F.lit(f"empty {c}")) for c in ("source", "target")
    ], *[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in ("category", "honorific")]))).alias("problem"))
    named = terms.where(F.coalesce("honorific", F.lit("")) != "").join(
        honorifics.select(F.col("id").alias("honorific")), "honorific", "left_anti"
    )
    out = missing.union(named.select("term_id", F.concat(F.lit("unknown honorific "), "honorific")))
    if strict:
        odd = terms.where(F.col("category").isNotNull() & ~F.col("category").isin(*P.CATEGORIES))
        out = out.union(odd.select("term_id", F.concat(F.lit("unknown category "), "category")))
    keyed = surfaces(terms).withColumn("key", F.lower(T.strip("surface")))
    first = Window.partitionBy("key").orderBy("term_id")
    claimed = keyed.withColumn("owner", F.first("term_id").over(first)).where("owner <> term_id")
    return out.union(claimed.select("term_id", F.concat(F.lit("surface already used: "), "key")).distinct())


def add_terms(terms: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(glossary with the accepted new terms, rejected new terms with the surface that collides).

    new holds a position column `term_id` continuing that of terms; a term is refused if one
    of its surfaces is taken by the glossary or by a new term accepted before it.  The batch
    is small and its order matters, so the decision is a fold over its rows on the driver.
    """
    spark = terms.sparkSession
    taken = {r.key for r in surface_index(terms).collect()}
    accepted, refused = [], []
    for row in new.orderBy("term_id").collect():
        keys = [s.strip().lower() for s in [row.source or "", *(row.aliases or [])] if s and s.strip()]
        clash = next((k for k in keys if k in taken), None)
        if clash is not None or not keys or not (row.target or "").strip():
            refused.append((row.term_id, clash or "empty source or target"))
        else:
            taken.update(keys)
            accepted.append(row.term_id)
    chosen = new.where(F.col("term_id").isin(accepted)) if accepted else new.limit(0)
    return terms.unionByName(chosen, allowMissingColumns=True), spark.createDataFrame(refused, "term_id int, reason string")


def by_category(terms: DataFrame, category: str | None = None) -> DataFrame:
    return terms.where(F.col("category") == category) if category else terms


def resolve_honorifics(terms: DataFrame, honorifics: DataFrame) -> DataFrame:
    """terms with honorific_text: the plural form before the female before the plain one, '' for none."""
    h = honorifics.select(F.col("id").alias("honorific"), F.col("target").alias("h_plain"), F.col("female_target").alias("h_female"), F.col("plural_target").alias("h_plural"))
    text = F.coalesce(F.when(F.col("plural"), F.col("h_plural")), F.when(F.col("gender") == "f", F.col("h_female")), F.col("h_plain"), F.lit(""))
    return terms.join(h, "honorific", "left").withColumn("honorific_text", text).drop("h_plain", "h_female", "h_plural")


def row_of(term, term_id: int) -> tuple:
    """A term as a row of TERM_SCHEMA, trimmed, with the defaults of a new one."""
    trim = lambda v: v.strip() if isinstance(v, str) else v
    aliases = [x for x in map(trim, term.aliases or []) if x]
    return (term_id, trim(term.source), aliases, trim(term.target), term.category or "other", term.honorific or "", term.gender, term.plural, term.note, term.frequency or 0)


def load_terms(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, TERM_SCHEMA)
