"""Catalog operators: parse catalog rows into columns, classify columns,
describe tables and find the join keys they share.

A catalog row is ``(table_name, column_names, column_types)`` where the two
lists are JSON arrays inside strings, with a comma-separated fallback.

Shared keys are kept in *hub* form — (key column, tables sharing it) —
instead of a list of table pairs: a key shared by a third of the catalog
would otherwise make the edge list quadratic.  Descriptions therefore
name each join key with the number of tables it links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expand import ABBREVIATIONS

# --- fixed values: column-name rules of the catalog ------------------------
AUDIT_FRAGMENTS = ["warehouse_load_date", "last_activity_date", "load_date", "record_status",
                   "load_dt", "update_date"]
KEY_SUFFIXES = ["_id", "_key", "_code", "_number", "_num", "_name"]
GENERIC_CODES = ["level_code", "rule_code", "type_code", "status_code", "basis_code", "state_code"]
KNOWN_KEYS = ["subject_id", "term_code", "department_code", "building_key", "room_number",
              "student_id", "employee_id", "department", "school", "course", "building", "room"]
ROLE_NUMERIC = ["count", "num", "total", "sum", "amount"]
ROLE_TEXT = ["name", "title", "label", "desc", "code"]
ROLE_TIME = ["date", "time", "year", "term", "timestamp"]
# source type fragment -> storage type, tested in this order; default TEXT
TYPE_MAP = [("string", "TEXT"), ("int64", "INTEGER"), ("double", "REAL"), ("float64", "REAL"),
            ("bool", "INTEGER"), ("boolean", "INTEGER"), ("timestamp", "TEXT"), ("date", "TEXT")]
# --- end of fixed values ------------------------------------------------------


def _any_contains(c: Column, frags: list[str]) -> Column:
    out = F.lit(False)
    for f in frags:
        out = out | (F.instr(c, f) > 0)
    return out


def _parse_list(c: Column) -> Column:
    """JSON array in a string; otherwise comma split with `` []"'`` stripped
    from each piece and blank pieces dropped."""
    js = F.from_json(c, "array<string>")
    pieces = F.transform(F.split(c, ","), lambda p: F.regexp_replace(p, "^[ \\[\\]\"']+|[ \\[\\]\"']+$", ""))
    fb = F.filter(pieces, lambda p: p != "")
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(js, fb))


def catalog_columns(catalog: DataFrame) -> DataFrame:
    """(table_name, ordinal, column_name, column_type): types padded with
    'unknown', surplus types ignored."""
    p = catalog.select("table_name", _parse_list(F.col("column_names")).alias("n"),
                       _parse_list(F.col("column_types")).alias("t"))
    x = p.select("table_name", "t", F.posexplode_outer("n").alias("ordinal", "column_name")) \
        .filter(F.col("column_name").isNotNull())
    typ = F.coalesce(F.try_element_at("t", (F.col("ordinal") + 1).cast("int")), F.lit("unknown"))
    return x.select("table_name", "ordinal", "column_name", typ.alias("column_type"))


def storage_type(t: Column) -> Column:
    """Ordered substring test of the lower-cased type; TEXT by default."""
    lt = F.lower(t)
    out = F.lit("TEXT")
    for frag, val in reversed(TYPE_MAP):
        out = F.when(F.instr(lt, frag) > 0, F.lit(val)).otherwise(out)
    return out


def is_audit_column(name: Column) -> Column:
    return _any_contains(F.lower(name), AUDIT_FRAGMENTS)


def is_join_key(name: Column) -> Column:
    """Key suffix without a generic-code fragment, or a known key name;
    audit columns never."""
    c = F.lower(name)
    suffix = F.lit(False)
    for s in KEY_SUFFIXES:
        suffix = suffix | c.endswith(s)
    rule = F.when(suffix, ~_any_contains(c, GENERIC_CODES)).otherwise(c.isin(KNOWN_KEYS))
    return ~is_audit_column(name) & rule


def column_role(name: Column) -> Column:
    """First match wins: foreign key (``_id`` suffix), numeric aggregation,
    descriptive text, temporal; else null."""
    c = F.lower(name)
    return (F.when(c.endswith("_id"), F.concat(F.lit("foreign key referencing "),
                                               c.substr(F.lit(1), F.length(c) - 3), F.lit(" table")))
            .when(_any_contains(c, ROLE_NUMERIC), F.lit("numeric aggregation column"))
            .when(_any_contains(c, ROLE_TEXT), F.lit("descriptive text column"))
            .when(_any_contains(c, ROLE_TIME), F.lit("temporal column")))


def usecase_text(table_name: Column, overrides: dict[str, str] | None = None,
                 meanings_of: dict[str, str] = ABBREVIATIONS) -> Column:
    """The table's own text of ``overrides`` (by upper-case name), else the
    meanings of the name parts found in ``meanings_of``, else a generic
    sentence."""
    own = F.lit(None).cast("string")
    if overrides:
        given = F.create_map(*[x for name, text in overrides.items() for x in (F.lit(name.upper()), F.lit(text))])
        own = F.try_element_at(given, F.upper(table_name))
    m = F.create_map(*[x for ab, mean in meanings_of.items() for x in (F.lit(ab), F.lit(mean))])
    parts = F.split(F.upper(table_name), "_")
    meanings = F.filter(F.transform(parts, lambda p: F.try_element_at(m, p)), lambda x: x.isNotNull())
    return F.when(own.isNotNull(), own).when(F.size(meanings) > 0,
                  F.concat(F.lit("This table is useful for queries concerning "), F.array_join(meanings, ", "),
                           F.lit("."))) \
        .otherwise(F.concat(F.lit("This table stores records related to "),
                            F.regexp_replace(F.lower(table_name), "_", " "), F.lit(".")))


def classify_columns(cols: DataFrame) -> DataFrame:
    """Per column: storage type, audit flag, join-key flag and role."""
    return cols.select("table_name", "ordinal", "column_name", "column_type",
                       storage_type(F.col("column_type")).alias("storage_type"),
                       is_audit_column(F.col("column_name")).alias("is_audit"),
                       is_join_key(F.col("column_name")).alias("is_join_key"),
                       column_role(F.col("column_name")).alias("role"))


def key_hubs(cols: DataFrame) -> DataFrame:
    """Join-key columns shared by two or more tables:
    (key, n_tables) — the hub form of the shared-key edges."""
    k = cols.filter(is_join_key(F.col("column_name"))) \
        .select("table_name", F.lower("column_name").alias("key")).distinct()
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("n_tables")).filter(F.col("n_tables") > 1)


def table_keys(cols: DataFrame) -> DataFrame:
    """(table_name, key, n_tables): every shared join key of a table."""
    k = cols.filter(is_join_key(F.col("column_name"))) \
        .select("table_name", F.lower("column_name").alias("key")).distinct()
    return k.join(key_hubs(cols), "key")


def describe_tables(cols: DataFrame, clean: bool = False) -> DataFrame:
    """One description per table: name, use case, the column list in
    catalog order (with type and role unless ``clean``), and its shared
    join keys with the number of tables each links."""
    c = classify_columns(cols).filter(~F.col("is_audit"))
    if clean:
        item = F.col("column_name")
    else:
        item = F.concat(F.col("column_name"), F.lit(" ("), F.col("column_type"), F.lit(")"),
                        F.when(F.col("role").isNotNull(),
                               F.concat(F.lit(" [role: "), F.col("role"), F.lit("]"))).otherwise(F.lit("")))
    per = c.groupBy("table_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", item.alias("d")))),
                                 lambda s: s["d"]), ", ").alias("cols"))
    keys = table_keys(cols).groupBy("table_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "n_tables"))),
                                 lambda s: F.concat(s["key"], F.lit(" ("), s["n_tables"].cast("string"),
                                                    F.lit(" tables)"))), ", ").alias("keys"))
    j = per.join(keys, "table_name", "left")
    rel = F.when(F.col("keys").isNotNull(), F.concat(F.lit(" Join Keys: ["), F.col("keys"), F.lit("]."))) \
        .otherwise(F.lit(""))
    desc = F.concat(F.lit("Table: "), F.col("table_name"), F.lit(". "), usecase_text(F.col("table_name")),
                    F.lit(" Schema structure: ["), F.col("cols"), F.lit("]."), rel)
    return j.select("table_name", desc.alias("description"))


def compact_schema_line(cols: DataFrame) -> DataFrame:
    """``T(col, col, ...) -- use case`` with audit columns dropped."""
    c = cols.filter(~is_audit_column(F.col("column_name")))
    per = c.groupBy("table_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))),
                                 lambda s: s["column_name"]), ", ").alias("cols"))
    return per.select("table_name", F.concat(F.col("table_name"), F.lit("("), F.col("cols"), F.lit(") -- "),
                                             usecase_text(F.col("table_name"))).alias("line"))


MOST_SUBSETS_OF = 10  # keys of a pattern whose subsets are counted one by one


def neighbour_counts(cols: DataFrame) -> DataFrame:
    """(table_name, num_neighbours): tables that share a join key with it,
    each counted once however many keys they share.

    Tables with the same set of keys form a pattern.  The tables that share a
    key with a pattern are the union of its hubs, counted by inclusion and
    exclusion over the sizes of the hubs' intersections, which are counts of
    the patterns that hold a subset of keys: no pairs of tables, and a hub of
    any size is one number.  Patterns of more than ``MOST_SUBSETS_OF`` keys have
    too many subsets; the patterns (not the tables) they meet are joined."""
    tables = table_keys(cols).groupBy("table_name").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    patterns = tables.groupBy("keys").agg(F.count(F.lit(1)).alias("n"))
    few = patterns.filter(F.size("keys") <= MOST_SUBSETS_OF)

    def subsets(p: DataFrame) -> DataFrame:
        bits = F.explode(F.expr("sequence(1, shiftleft(1, size(keys)) - 1)")).alias("bits")
        chosen = F.expr("filter(keys, (x, i) -> (bits & shiftleft(1, i)) > 0)")
        return p.select("keys", "n", bits).select("keys", "n", chosen.alias("subset"))

    own = subsets(few)
    # subsets that some small pattern asks for, in patterns of any size
    wide = patterns.filter(F.size("keys") > MOST_SUBSETS_OF)
    asked = own.select("subset", F.col("subset")[0].alias("key")).distinct()
    in_wide = (wide.select(F.col("keys").alias("_w"), "n", F.explode("keys").alias("key")).join(asked, "key")
               .filter(F.size(F.array_except("subset", "_w")) == 0).select("subset", "n"))
    size = own.select("subset", "n").unionByName(in_wide).groupBy("subset").agg(F.sum("n").alias("size"))
    sign = F.when(F.size("subset") % 2 == 1, F.col("size")).otherwise(-F.col("size"))
    small = own.join(size, "subset").groupBy("keys").agg((F.sum(sign) - 1).alias("num_neighbours"))
    key = patterns.select(F.col("keys").alias("_o"), "n", F.explode("keys").alias("key"))
    met = (wide.select("keys", F.explode("keys").alias("key")).join(key, "key").select("keys", "_o", "n").distinct()
           .groupBy("keys").agg((F.sum("n") - 1).alias("num_neighbours")))
    return tables.join(small.unionByName(met), "keys").select("table_name", "num_neighbours")


def relation_counts(cols: DataFrame) -> DataFrame:
    """Per table: column count, number of shared join keys, the largest number
    of tables one of its keys links, the number of tables it shares a key with,
    and the first 200 characters of its description."""
    n = cols.groupBy("table_name").agg(F.count(F.lit(1)).alias("num_columns"))
    k = table_keys(cols).groupBy("table_name").agg(F.count(F.lit(1)).alias("num_join_keys"),
                                                    F.max("n_tables").alias("max_hub_tables"))
    return n.join(k, "table_name", "left").select(
        "table_name", "num_columns", F.coalesce("num_join_keys", F.lit(0)).alias("num_join_keys"),
        F.coalesce("max_hub_tables", F.lit(0)).alias("max_hub_tables")).join(neighbour_counts(cols), "table_name", "left") \
        .join(describe_tables(cols), "table_name", "left") \
        .withColumn("num_neighbours", F.coalesce("num_neighbours", F.lit(0))) \
        .withColumn("description", F.substring(F.coalesce("description", F.lit("")), 1, 200))


def catalog_search(descriptions: DataFrame, cols: DataFrame, term: str) -> DataFrame:
    """Tables whose name, description or any column contains ``term``
    (case-insensitive)."""
    t = term.lower()
    hit_col = cols.filter(F.instr(F.lower("column_name"), t) > 0).select("table_name").distinct()
    hit_desc = descriptions.filter((F.instr(F.lower("table_name"), t) > 0) |
                                   (F.instr(F.lower("description"), t) > 0)).select("table_name")
    return hit_desc.union(hit_col).distinct()


def join_paths(top: DataFrame, item_keys: DataFrame, known: list[tuple[str, str]] = ()) -> DataFrame:
    """Join paths inside each question's retrieved set: pairs of retrieved
    items (better-ranked first) that share a join key, with the sorted keys
    joined by ``/``.  Pairs are formed only within a question's top-k, so
    their number is bounded by k² per question.
    ``top`` = (query_id, item_id, rank); ``item_keys`` = (item_id, key).
    ``known`` = pairs of column names that mean the same without being
    equal: each is a key of its own, ``a=b``, of the items that have either
    column."""
    keys = item_keys.select("item_id", "key")
    for left, right in known:
        keys = keys.unionByName(item_keys.filter(F.col("key").isin(left, right))
                                .select("item_id", F.lit(f"{left}={right}").alias("key")).distinct())
    a = top.select("query_id", "item_id", "rank").join(keys, "item_id")
    x, y = a.alias("x"), a.alias("y")
    p = x.join(y, (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.key") == F.col("y.key"))
               & (F.col("x.rank") < F.col("y.rank")))
    g = p.groupBy(F.col("x.query_id").alias("query_id"), F.col("x.item_id").alias("left_item"),
                  F.col("y.item_id").alias("right_item")).agg(F.array_sort(F.collect_set("x.key")).alias("k"))
    return g.select("query_id", "left_item", "right_item", F.array_join("k", "/").alias("via"))


def edges_from_text(descriptions: DataFrame) -> DataFrame:
    """Join keys parsed back out of description text:
    (table_name, key, n_tables)."""
    inner = F.regexp_extract("description", r"Join Keys: \[(.*)\]\.$", 1)
    items = descriptions.select("table_name", F.explode(F.split(inner, ", ")).alias("it")).filter(F.col("it") != "")
    return items.select("table_name", F.regexp_extract("it", r"^(.*) \((\d+) tables\)$", 1).alias("key"),
                        F.regexp_extract("it", r"^(.*) \((\d+) tables\)$", 2).cast("long").alias("n_tables"))
