"""Query expansion: phrase dictionaries, abbreviations and name mentions.

Expansion only ever feeds bag-of-words scorers (BM25, TF-IDF), so the
order of the added words is irrelevant; their multiplicity is not (an
added word that repeats a question word doubles its BM25 weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tok_clean_plural

# --- fixed values: phrase -> added words, offline expansion -------------
OFFLINE_PHRASES = {
    "how many": ["COUNT", "GROUP BY"],
    "average": ["AVG", "GROUP BY"],
    "total": ["SUM", "GROUP BY"],
    "maximum": ["MAX"],
    "minimum": ["MIN"],
    "more than": ["HAVING", "COUNT", "greater than"],
    "less than": ["HAVING", "COUNT", "fewer than"],
    "each": ["GROUP BY", "per"],
    "per": ["GROUP BY"],
    "between": ["BETWEEN", "range"],
    "top": ["ORDER BY", "LIMIT", "DESC"],
    "bottom": ["ORDER BY", "LIMIT", "ASC"],
    "ranked": ["ORDER BY", "RANK"],
    "excluding": ["WHERE", "NOT IN", "filter"],
    "without": ["WHERE", "NOT IN", "exclude"],
    "join": ["JOIN", "INNER JOIN", "LEFT JOIN"],
    "list": ["SELECT"],
    "show": ["SELECT"],
    "find": ["SELECT", "WHERE"],
    "count": ["COUNT", "GROUP BY"],
    "sum": ["SUM"],
    "name": ["_name", "name"],
    "id": ["_id", "id"],
    "date": ["date", "timestamp", "created_at"],
}

# --- fixed values: phrase -> added words, full-pipeline expansion --------
SQL_PHRASES = {
    "how many": ["COUNT", "GROUP", "BY"],
    "number of": ["COUNT", "GROUP", "BY"],
    "more than": ["HAVING", "COUNT"],
    "greater than": ["HAVING", "COUNT"],
    "at least": ["HAVING", "COUNT"],
    "average": ["AVG", "GROUP", "BY"],
    "mean": ["AVG", "GROUP", "BY"],
    "total": ["SUM", "GROUP", "BY"],
    "sum": ["SUM", "GROUP", "BY"],
    "rank": ["ORDER", "BY", "DESC", "LIMIT"],
    "top": ["ORDER", "BY", "DESC", "LIMIT"],
    "highest": ["ORDER", "BY", "DESC", "LIMIT"],
    "each": ["GROUP", "BY"],
    "per": ["GROUP", "BY"],
    "by": ["GROUP", "BY"],
    "exclude": ["WHERE", "NOT"],
    "not": ["WHERE", "NOT"],
    "except": ["WHERE", "NOT"],
}

# --- fixed values: name-part abbreviations and their meanings ------------
ABBREVIATIONS = {
    "FCLT": "facilities, buildings, rooms, spaces, and locations",
    "SIS": "Student Information System, academic records, courses, and department enrollments",
    "TIP": "textbook details, reading materials, course reserve lists, and enrolled student counts",
    "HR": "human resources, employees, jobs, and organizational hierarchies",
    "ZPM": "facilities room loading, space utilization, and architecture",
    "FAC": "facilities, physical buildings, and room parameters",
    "ORG": "organizational structure, units, and departments",
    "DLC": "Departments, Labs, and Centers (DLC)",
    "IAP": "Independent Activities Period (January term) course offerings",
    "GP": "Grade Point averages and grading basis details",
    "ACAD": "academic timelines, terms, and semesters",
    "DEPT": "departments and schools within the university",
    "HIST": "historical tracking and temporal archive records",
    "SMRY": "summary and aggregated metrics across subjects, courses, and enrollment",
    "CIS": "course catalog, course information, subjects offered, and degree details",
    "MATRL": "materials, reserve materials, and textbook detail records",
    "CATALOG": "course catalog entries, subjects offered by term and academic year",
    "LIBRARY": "library course reserves, subjects offered with library materials, and enrolled student counts",
}

# --- fixed values: words ignored when matching abbreviation meanings -----
EXPANSION_STOP_WORDS = [
    "and", "of", "for", "the", "in", "to", "with", "within", "related",
    "queries", "concerning", "stores", "records", "about", "each",
    "what", "from", "their", "only", "than", "more", "less", "at",
    "least", "have", "offered", "by", "that", "this", "table", "useful", "academic",
]
GENERIC_TRIGGER_WORDS = [
    "course", "courses", "subject", "subjects", "academic", "university",
    "record", "records", "system", "details", "summary", "metrics", "views",
    "timeline", "timelines", "tracking", "archive", "school", "schools",
    "term", "terms", "date", "dates", "time", "times",
]
# --- end of fixed values -------------------------------------------------


def _phrase_array(phrases: dict[str, list[str]]) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("p"), F.array(*[F.lit(w) for w in ws]).alias("w"))
                     for p, ws in phrases.items()])


def phrase_extras(question_lower: Column, phrases: dict[str, list[str]]) -> Column:
    """Set of words added because their phrase occurs in the question."""
    hit = F.filter(_phrase_array(phrases), lambda e: F.instr(question_lower, e["p"]) > 0)
    return F.array_distinct(F.flatten(F.transform(hit, lambda e: e["w"])))


def abbrev_extras(question: Column, abbrevs: dict[str, str] = ABBREVIATIONS) -> Column:
    """Abbreviation expansion: when the abbreviation itself is a question
    word, or a non-generic meaning word (longer than 3, not a stop word)
    is, add the abbreviation and its meaning words in upper case."""
    stop = F.array(*[F.lit(w) for w in EXPANSION_STOP_WORDS])
    generic = F.array(*[F.lit(w) for w in GENERIC_TRIGGER_WORDS])
    qwords = tok_clean_plural(question)
    q_trig = F.array_except(F.array_except(qwords, stop), generic)
    out = []
    for ab, meaning in abbrevs.items():
        words = sorted({w for w in meaning.replace(",", "").replace(".", "").lower().split()
                        if w not in EXPANSION_STOP_WORDS and len(w) > 3})
        trig = [w for w in words if w not in GENERIC_TRIGGER_WORDS]
        fire = F.array_contains(qwords, ab.lower())
        if trig:
            fire = fire | F.arrays_overlap(q_trig, F.array(*[F.lit(w) for w in trig]))
        added = F.array(F.lit(ab), *[F.lit(w.upper()) for w in words])
        out.append(F.when(fire, added).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.array(*out)))


def expand_offline(queries: DataFrame, mentions: DataFrame | None = None,
                   corpus: DataFrame | None = None) -> DataFrame:
    """question + offline phrase words + mentioned item names, as
    (query_id, question, expanded)."""
    ql = F.lower("question")
    q = queries.withColumn("_x", phrase_extras(ql, OFFLINE_PHRASES))
    if mentions is not None and corpus is not None:
        names = (mentions.join(corpus.select("item_id", "name"), "item_id")
                 .groupBy("query_id").agg(F.collect_set("name").alias("_n")))
        q = q.join(names, "query_id", "left").withColumn(
            "_x", F.array_union("_x", F.coalesce("_n", F.array().cast("array<string>")))).drop("_n")
    return q.select("query_id", "question",
                    F.concat_ws(" ", F.col("question"), F.array_join("_x", " ")).alias("expanded"))


def expand_full(queries: DataFrame, mentions: DataFrame | None = None,
                corpus: DataFrame | None = None, supplied: str | None = None) -> DataFrame:
    """question + SQL phrase words + abbreviation words + mentioned names
    (+ an optional supplied expansion text column)."""
    ql = F.lower("question")
    x = F.array_union(phrase_extras(ql, SQL_PHRASES), abbrev_extras(F.col("question")))
    q = queries.withColumn("_x", x)
    if mentions is not None and corpus is not None:
        names = (mentions.join(corpus.select("item_id", "name"), "item_id")
                 .groupBy("query_id").agg(F.collect_set("name").alias("_n")))
        q = q.join(names, "query_id", "left").withColumn(
            "_x", F.array_union("_x", F.coalesce("_n", F.array().cast("array<string>")))).drop("_n")
    parts = [F.col("question"), F.array_join("_x", " ")]
    parts.append(F.coalesce(F.col(supplied), F.lit("")) if supplied else F.lit(""))
    return q.select("query_id", "question", F.concat_ws(" ", *parts).alias("expanded"))
