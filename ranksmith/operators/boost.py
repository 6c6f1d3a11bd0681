"""Score adjustments on candidate pools: mentions, rerank, pins, rules,
graph propagation and fusion.

Every operator takes and returns long-format candidate rows
``(query_id, item_id, score, ...)``; pools are already cut to a bounded
size per query (top-k) before any of these run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ws_set
from .containment import contains_pairs
from .search import first_free
from .util import broadcast_if_small, stored, topk


# names share their first parts (language, source): each joins through one gram,
# the rarest of all it has, so the questions are indexed at every position
NAME_TIERS = ((8, 1), (4, 1), (1, 1))
CLASS_ITEMS, CLASS_BYTES = 4_000_000, 96 << 20  # of (item, class of its keys) rows that are sent to every task
PART_ROWS = 2_000_000  # (question, class of items) rows that are sent to every task, within a bound of bytes


def mention_pairs(queries: DataFrame, corpus: DataFrame, raw: bool = True, clean: bool = True,
                  singular: bool = False) -> DataFrame:
    """(query_id, item_id) where the lower-cased question contains the
    item name (``raw``), the name with ``_`` read as a space (``clean``),
    or that clean form without trailing ``s`` (``singular``).  Runs as the
    gram-indexed containment join, not as a query x corpus theta join."""
    base = F.lower(F.col("name"))
    forms = []
    if raw:
        forms.append((0, base))
    if clean:
        forms.append((1, F.regexp_replace(base, "_", " ")))
    if singular:
        forms.append((2, F.regexp_replace(F.regexp_replace(base, "_", " "), "s+$", "")))
    needles = None
    for tag, expr in forms:
        n = corpus.select((F.col("item_id") * 4 + tag).alias("nid"), expr.alias("ntext"))
        needles = n if needles is None else needles.unionByName(n)
    hay = queries.select("query_id", F.lower(F.col("question")).alias("qtext"))
    pairs = contains_pairs(hay, "query_id", "qtext", needles, "nid", "ntext", NAME_TIERS)
    return pairs.select("query_id", F.floor(F.col("nid") / 4).cast("long").alias("item_id")).distinct()


def candidate_union(pairs: DataFrame, mentions: DataFrame, forced_score: float = 2.0,
                    score: str = "score") -> DataFrame:
    """Mentioned items join the pool with their score set to ``forced_score``."""
    keys = ["query_id", "item_id"] + (["ordinal"] if "ordinal" in pairs.columns and "ordinal" in mentions.columns else [])
    m = mentions.select(*keys, F.lit(True).alias("_m"))
    j = pairs.join(m, keys, "full")
    return j.withColumn(score, F.when(F.col("_m"), F.lit(forced_score)).otherwise(F.col(score))).drop("_m")


def lexical_rerank(cands: DataFrame, queries: DataFrame, corpus: DataFrame, k: int,
                   mention_bonus: float = 0.2, per_word: float = 0.01, max_words: int = 5) -> DataFrame:
    """score + 0.2 when the question mentions the name (``_`` as space)
    + 0.01 x min(5, shared whitespace words of question and text); top k.

    Item text is joined only onto pool rows, so word sets of long documents
    are built for candidates only."""
    q = queries.select("query_id", F.lower("question").alias("ql"), ws_set("question").alias("qw"))
    d = corpus.select("item_id", "ordinal", "name", "text")
    # the pool (questions x k) is broadcast behind a checked bound, so the
    # corpus streams through a hash lookup instead of being shuffled
    j = d.join(broadcast_if_small(cands.join(q, "query_id")), "item_id")
    hit = F.instr(F.col("ql"), F.regexp_replace(F.lower("name"), "_", " ")) > 0
    overlap = F.size(F.array_intersect(F.col("qw"), ws_set("text")))
    j = j.withColumn("score", F.col("score") + F.when(hit, mention_bonus).otherwise(0.0)
                     + F.least(overlap, F.lit(max_words)) * per_word)
    return topk(j.select("query_id", "item_id", "ordinal", "score"), "query_id", "score", "ordinal", k)


def pin_to_front(ranked_: DataFrame, forced: DataFrame, corpus: DataFrame, k: int,
                 bonus: float = 1.0, absent_score: float = 1.0) -> DataFrame:
    """Forced items first, in forced order, at (their score or
    ``absent_score``) + ``bonus``; then the remaining ranked items in rank
    order; cut to k.  ``forced`` = (query_id, item_id, fpos)."""
    r = ranked_.select("query_id", "item_id", "score", F.col("rank").alias("_r"))
    f = forced.select("query_id", "item_id", "fpos")
    j = r.join(f, ["query_id", "item_id"], "full")
    j = j.withColumn("score", F.when(F.col("fpos").isNotNull(),
                                     F.coalesce(F.col("score"), F.lit(absent_score)) + bonus)
                     .otherwise(F.col("score")))
    key = F.when(F.col("fpos").isNotNull(), F.col("fpos")).otherwise(F.lit(10**9) + F.col("_r"))
    j = j.withColumn("_key", key.cast("long"))
    w = Window.partitionBy("query_id").orderBy("_key", "item_id")
    out = j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select("query_id", "item_id", "score", "rank")


@dataclass
class Rule:
    """A boost / pin rule: fires when some phrase of ``any_of`` (and of
    ``any_of_2`` when given) occurs in the lower-cased question and no
    phrase of ``none_of`` does.  ``target`` is an item name (``match``
    "exact") or a name prefix ("prefix")."""
    rule_id: str
    any_of: list[str]
    target: str
    delta: float = 0.0
    match: str = "exact"
    any_of_2: list[str] = field(default_factory=list)
    none_of: list[str] = field(default_factory=list)


def _arr(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def fired_rules(queries: DataFrame, rules: list[Rule]) -> DataFrame:
    """(query_id, rule_pos, rule_id, target, match, delta) for every rule
    that fires.  The rule list is a small constant: it is attached to each
    question row as a literal array and exploded (linear in the questions,
    no join)."""
    if not rules:
        return queries.select("query_id", F.lit(0).alias("rule_pos"), F.lit("").alias("rule_id"),
                              F.lit("").alias("target"), F.lit("exact").alias("match"),
                              F.lit(0.0).alias("delta")).limit(0)
    arr = F.array(*[F.struct(F.lit(i).alias("rule_pos"), F.lit(r.rule_id).alias("rule_id"),
                             _arr(r.any_of).alias("a1"), _arr(r.any_of_2).alias("a2"),
                             _arr(r.none_of).alias("nn"), F.lit(r.target).alias("target"),
                             F.lit(r.match).alias("match"), F.lit(float(r.delta)).alias("delta"))
                    for i, r in enumerate(rules)])
    q = queries.select("query_id", F.lower("question").alias("ql"), F.explode(arr).alias("r"))
    has = lambda a: F.exists(a, lambda p: F.instr(F.col("ql"), p) > 0)
    fires = has(F.col("r.a1")) & ((F.size("r.a2") == 0) | has(F.col("r.a2"))) & ~has(F.col("r.nn"))
    return q.filter(fires).select("query_id", "r.rule_pos", "r.rule_id", "r.target", "r.match", "r.delta")


def rule_targets(fired: DataFrame, corpus: DataFrame, rules: list[Rule]) -> DataFrame:
    """Resolve fired rules to items: exact name, or name prefix.  Prefix
    targets join on the item's prefix of the same length (an equi join per
    distinct prefix length, never a ``startswith`` theta join)."""
    items = corpus.select("item_id", "ordinal", "name")
    ex = fired.filter(F.col("match") == "exact").join(items.withColumnRenamed("name", "target"), "target")
    out = ex
    lengths = sorted({len(r.target) for r in rules if r.match == "prefix"})
    for L in lengths:
        pre = items.select("item_id", "ordinal", F.substring("name", 1, L).alias("target"))
        px = fired.filter((F.col("match") == "prefix") & (F.length("target") == L)).join(pre, "target")
        out = out.unionByName(px)
    return out


def rule_boost(queries: DataFrame, corpus: DataFrame, rules: list[Rule]) -> DataFrame:
    """(query_id, item_id, boost): deltas of fired rules add up; rows that
    share a rule id (an OR of conjunctions) count once, at their max."""
    t = rule_targets(fired_rules(queries, rules), corpus, rules)
    per_rule = t.groupBy("query_id", "item_id", "rule_id").agg(F.max("delta").alias("d"))
    return per_rule.groupBy("query_id", "item_id").agg(F.sum("d").alias("boost"))


def rule_pins(queries: DataFrame, corpus: DataFrame, rules: list[Rule],
              mentions: DataFrame | None = None) -> DataFrame:
    """Ordered forced list per query: mentioned items first (by ordinal),
    then rule targets in rule order; duplicates keep their first place.
    (query_id, item_id, fpos)."""
    parts = []
    if mentions is not None:
        m = mentions.join(corpus.select("item_id", "ordinal"), "item_id")
        parts.append(m.select("query_id", "item_id", F.lit(0).alias("g"), F.col("ordinal").alias("o")))
    if rules:
        t = rule_targets(fired_rules(queries, rules), corpus, rules)
        parts.append(t.select("query_id", "item_id", (F.col("rule_pos") + 1).alias("g"),
                              F.col("ordinal").alias("o")))
    if not parts:
        return queries.select("query_id", F.lit(0).cast("long").alias("item_id"),
                              F.lit(0).cast("long").alias("fpos")).limit(0)
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    first = u.groupBy("query_id", "item_id").agg(F.min(F.struct("g", "o")).alias("k"))
    w = Window.partitionBy("query_id").orderBy("k")
    return first.select("query_id", "item_id", F.row_number().over(w).cast("long").alias("fpos"))


def key_classes(item_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, _class), (_class, key): items with the same set of join keys
    form a class, named by its smallest item."""
    sets = stored(item_keys.groupBy("item_id").agg(F.sort_array(F.collect_set("key")).alias("_keys")), "key-sets")
    named = sets.groupBy("_keys").agg(F.min("item_id").alias("_class"))
    of = broadcast_if_small(sets.join(named, "_keys").select("item_id", "_class"), CLASS_ITEMS, CLASS_BYTES)
    return of, named.select("_class", F.explode("_keys").alias("key"))


def push_hubs(scores: DataFrame, item_keys: DataFrame, threshold: float = 1.0, factor: float = 0.4,
              score: str = "score", classes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, key, lift): what every item above ``threshold`` gives to
    the members of its join keys, the best per (question, key).  Pairs meet
    classes of items first (``key_classes``), so none is repeated per key."""
    of, keys = classes or key_classes(item_keys)
    src = scores.filter(F.col(score) > threshold).join(of, "item_id").groupBy("query_id", "_class").agg(F.max(score).alias("_best"))
    return src.join(keys, "_class").groupBy("query_id", "key").agg((F.max("_best") * factor).alias("lift"))


def graph_propagate(scores: DataFrame, item_keys: DataFrame, threshold: float = 1.0,
                    factor: float = 0.4, score: str = "score", classes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One hop of score propagation over shared join keys: every item whose
    score is above ``threshold`` lifts each scored neighbour to at least
    ``factor`` x its score (from pre-propagation scores).

    Neighbours are items sharing a key; the push goes through the key as a
    hub, never through materialised item pairs: per (question, key) the
    best pushing score, then per (question, class of receiving items) the best
    over its keys, which the scored rows look up.  An
    item's own push never exceeds its score, so it changes nothing for
    itself.  ``item_keys`` = (item_id, key, ordinal); ``classes``: their
    ``key_classes``.  Unscored members of
    the hubs are the business of ``propagated_fill``."""
    of, keys = classes = classes or key_classes(item_keys)
    hub = push_hubs(scores, item_keys, threshold, factor, score, classes)
    lifts = broadcast_if_small(keys.join(hub, "key").groupBy("query_id", "_class").agg(F.max("lift").alias("_lift")))
    out = scores.join(of, "item_id", "left").join(lifts, ["query_id", "_class"], "left")
    lifted = F.greatest(F.col(score), F.coalesce(F.col("_lift"), F.col(score)))
    return out.withColumn(score, lifted).select(*scores.columns)


def propagated_fill(scores: DataFrame, item_keys: DataFrame, base: DataFrame, k: int,
                    threshold: float = 1.0, factor: float = 0.4, score: str = "score") -> DataFrame:
    """(query_id, item_id, ordinal, score) of unscored hub members, enough
    for an exact top-``k``: per (question, hub) the k lowest-ordinal ones,
    each at the larger of the question's base and its best lift."""
    hub = push_hubs(scores, item_keys, threshold, factor, score)
    free = first_free(hub.select("query_id", "key"), item_keys.select("key", "item_id", "ordinal"), scores, k, ["key"])
    # a member's best lift may come from another of its hubs
    own = (free.select("query_id", "item_id", "ordinal").distinct().join(item_keys.select("item_id", "key"), "item_id")
           .join(hub, ["query_id", "key"]).groupBy("query_id", "item_id", "ordinal").agg(F.max("lift").alias("_lift")))
    return own.join(base, "query_id", "left").select(
        "query_id", "item_id", "ordinal", F.greatest("_lift", F.coalesce("base", F.lit(0.0))).alias(score))


def heuristic_fusion(cands: DataFrame, logit: str = "logit", score: str = "score",
                     weight: float = 1.5) -> DataFrame:
    """candidate score + 1.5 x sigmoid(pair logit)."""
    return cands.withColumn("fused", F.col(score) + weight / (1 + F.exp(-F.col(logit))))


def name_part(name: str = "name") -> Column:
    """The second part of a name, null where there is none."""
    return F.when(F.size(F.split(name, "_")) > 1, F.split(F.lower(name), "_").getItem(1))


def part_questions(queries: DataFrame, classes: DataFrame) -> DataFrame:
    """(query_id, cls) where a word of the question is a name part of the class
    ``cls`` (an array of parts) or a singular / plural form of one."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.transform(
        F.split(F.lower("question"), "[ \\t\\n\\r\\f]+"),
        lambda w: F.regexp_replace(w, "^[?,.()_:]+|[?,.()_:]+$", "")), lambda w: w != ""))).alias("w"))
    p2 = F.col("p2")
    forms = F.array(p2, F.concat(p2, F.lit("s")),
                    F.when(p2.endswith("s"), p2.substr(F.lit(1), F.length(p2) - 1)))
    told = classes.select("cls", F.explode("cls").alias("p2")) \
        .select("cls", F.explode(F.filter(forms, lambda x: x.isNotNull())).alias("w")).distinct()
    return words.join(told, "w").select("query_id", "cls").distinct()


def name_boost(queries: DataFrame, corpus: DataFrame, mentions: DataFrame,
               exact: float = 2.0, part: float = 1.5) -> DataFrame:
    """(query_id, item_id, name_boost): ``exact`` when the question
    mentions the name; else ``part`` when the name's second part (longer
    than three characters) or its singular / plural form is a question
    word (words stripped of ``?,.()_:``).  The part test is an equi join
    of question words with name parts, not a scan of names per question.

    A part such as a source name may belong to a good share of all items, so
    questions meet classes of items (equal parts) first; the pairs are made
    last, once each, and are neither shuffled nor stored."""
    m = mentions.select("query_id", "item_id").distinct()
    items = (corpus.select("item_id", name_part().alias("p2"))
             .filter(F.length("p2") > 3).groupBy("item_id").agg(F.array_sort(F.collect_set("p2")).alias("cls")))
    told = part_questions(queries, items.select("cls").distinct())
    named = m.alias("m").join(items.alias("i"), F.col("m.item_id").eqNullSafe(F.col("i.item_id"))).groupBy(
        F.col("query_id").alias("_q"), F.col("cls").alias("_c")).agg(F.collect_set(F.struct("m.item_id")).alias("named"))
    told = told.join(named, F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("cls") == F.col("_c")), "left") \
        .select("query_id", "cls", "named")
    pb = items.join(broadcast_if_small(told, PART_ROWS), "cls").filter(
        ~F.coalesce(F.array_contains("named", F.struct("item_id")), F.lit(False)))
    return m.select("query_id", "item_id", F.lit(exact).alias("name_boost")).unionByName(
        pb.select("query_id", "item_id", F.lit(part).alias("name_boost")))


def force_include(top: DataFrame, scored: DataFrame, forced: DataFrame) -> DataFrame:
    """Append forced items that missed the cut (with their score), without
    duplicates: rows of ``top`` plus forced rows of ``scored`` not in it."""
    extra = scored.join(forced.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi") \
        .join(top.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    return top.select("query_id", "item_id", "score").unionByName(extra.select("query_id", "item_id", "score"))


def pair_scorer(cands: DataFrame, queries: DataFrame, corpus: DataFrame, model=None) -> DataFrame:
    """Pair logits for candidate rows.  ``model`` is a function
    pandas.DataFrame(question, text, name) -> array of logits, applied per
    Arrow batch with ``mapInPandas`` to candidate pairs only; without a
    model the model-free lexical logit is computed JVM-side."""
    from .features import pair_logit
    from ..functions.text import ws_set
    pool = broadcast_if_small(cands.select("query_id", "item_id").join(queries.select("query_id", "question"),
                                                                       "query_id"))
    if model is None:
        # the words of a text are cut once, not for every question that has it in its pool
        asked = broadcast_if_small(cands.select("item_id").distinct())
        d = corpus.join(asked, "item_id", "left_semi").select("item_id", "name", ws_set("text").alias("words"))
        return d.join(pool, "item_id").select("query_id", "item_id", pair_logit(
            F.lower("question"), F.col("name"), ws_set("question"), F.col("words")).alias("logit"))
    j = corpus.select("item_id", "name", "text").join(pool, "item_id")

    def run(batches):
        import numpy as np
        for pdf in batches:
            logit = np.nan_to_num(np.asarray(model(pdf), dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
            yield pdf[["query_id", "item_id"]].assign(logit=logit)
    return j.mapInPandas(run, "query_id long, item_id long, logit double")


def memo_lookup(requests: DataFrame, cache: DataFrame, compute, key: str = "question",
                value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Cache in front of an expensive step, keyed by ``key`` (the question
    text).  Every request gets its answer; hits come from ``cache`` (one row
    per key), the distinct missing keys go through ``compute`` once each (a
    DataFrame -> DataFrame function returning key + value), and the cache
    gains them.  Returns (requests with the value and ``from_cache``,
    updated cache)."""
    known = cache.select(key, value)
    misses = requests.select(key).distinct().join(known.select(key), key, "left_anti")
    fresh = compute(misses).select(key, value)
    both = known.withColumn("from_cache", F.lit(True)).unionByName(fresh.withColumn("from_cache", F.lit(False)))
    return requests.join(both, key), known.unionByName(fresh)


def rule_target_boosts(queries: DataFrame, rules: list[Rule]) -> DataFrame:
    """Fired rules summed per (question, target, match): rows sharing a
    rule id count once (max).  Stays at target level — a prefix family is
    one row, not one row per member item."""
    f = fired_rules(queries, rules)
    per_rule = f.groupBy("query_id", "rule_id", "target", "match").agg(F.max("delta").alias("d"))
    return per_rule.groupBy("query_id", "target", "match").agg(F.sum("d").alias("boost"))


def _item_targets(corpus: DataFrame, rules: list[Rule]) -> DataFrame:
    """(item_id, ordinal, target, match): every rule key an item answers to."""
    keys = [F.struct(F.lit("exact").alias("match"), F.col("name").alias("target"))]
    for L in sorted({len(r.target) for r in rules if r.match == "prefix"}):
        keys.append(F.struct(F.lit("prefix").alias("match"), F.substring("name", 1, L).alias("target")))
    return corpus.select("item_id", "ordinal", F.explode(F.array(*keys)).alias("k")) \
        .select("item_id", "ordinal", "k.target", "k.match")


def check_rules(rules: list[Rule], limit: float = 0.8) -> None:
    """A prefix rule lifts a whole family of items; families must stay below
    the boost that forces an item into the pool."""
    for r in rules:
        if r.match == "prefix":
            most = sum(x.delta for x in rules if x.match == "prefix" and x.delta > 0 and r.target.startswith(x.target))
            if most >= limit:
                raise ValueError(f"prefix rules of {r.target!r} add up to {most}; only exact rules may reach {limit}")


def apply_rule_boosts(pairs: DataFrame, corpus: DataFrame, tboost: DataFrame, rules: list[Rule],
                      fill_k: int | None = None) -> DataFrame:
    """(query_id, item_id, boost) for the given (query_id, item_id) pairs,
    plus, with ``fill_k``, unscored items enough for an exact
    top-``fill_k``: items that answer to the same rule targets form a class
    and get the same boost, so the ``fill_k`` lowest-ordinal unscored
    members of every (question, class) will do."""
    it = _item_targets(corpus, rules)
    pk = pairs.select("query_id", "item_id").distinct().join(it.select("item_id", "target", "match"), "item_id")
    got = pk.join(tboost, ["query_id", "target", "match"]).groupBy("query_id", "item_id") \
        .agg(F.sum("boost").alias("boost"))
    if fill_k and rules:
        known = F.array(*[F.concat_ws("\u0001", F.lit(r.match), F.lit(r.target)) for r in rules])
        key = F.concat_ws("\u0001", "match", "target")
        cls = it.filter(F.array_contains(known, key)).groupBy("item_id", "ordinal") \
            .agg(F.concat_ws("\u0002", F.array_sort(F.collect_set(key))).alias("cls"))
        kinds = cls.select("cls").distinct().withColumn("key", F.explode(F.split("cls", "\u0002")))
        worth = tboost.withColumn("key", key).join(kinds, "key").groupBy("query_id", "cls").agg(F.sum("boost").alias("boost"))
        free = first_free(worth.select("query_id", "cls"), cls, pairs, fill_k, ["cls"])
        got = got.unionByName(free.join(worth, ["query_id", "cls"]).select("query_id", "item_id", "boost"))
    return got
