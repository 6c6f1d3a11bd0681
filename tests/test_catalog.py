from ranksmith.operators import catalog as cg


def test_catalog_columns_parsing_rules(spark):
    rows = [("A", '["id", "dept_code", "load_date"]', '["int64", "string"]'),        # types padded
            ("B", "[ 'x_id' , \"name\", ,]", "[int64, string, double, bool]"),       # comma fallback, surplus types
            ("C", '{"not": "a list"', "string")]                                      # invalid JSON -> fallback
    cat = spark.createDataFrame(rows, "table_name string, column_names string, column_types string")
    got = {(r.table_name, r.ordinal): (r.column_name, r.column_type)
           for r in cg.catalog_columns(cat).collect()}
    assert got[("A", 0)] == ("id", "int64") and got[("A", 2)] == ("load_date", "unknown")
    assert got[("B", 0)] == ("x_id", "int64") and got[("B", 1)] == ("name", "string")
    assert ("B", 2) not in got
    # invalid JSON falls back to the comma split; edge quotes are stripped
    assert got[("C", 0)] == ('{"not": "a list', "string")


def test_column_classification(spark):
    cols = spark.createDataFrame([("T", 0, "dept_id", "int64"), ("T", 1, "status_code", "string"),
                                  ("T", 2, "total_units", "double"), ("T", 3, "building", "string"),
                                  ("T", 4, "warehouse_load_date", "timestamp")],
                                 "table_name string, ordinal int, column_name string, column_type string")
    got = {r.column_name: r for r in cg.classify_columns(cols).collect()}
    assert got["dept_id"].is_join_key and got["dept_id"].role == "foreign key referencing dept table"
    assert not got["status_code"].is_join_key and got["status_code"].role == "descriptive text column"
    assert got["total_units"].role == "numeric aggregation column" and got["total_units"].storage_type == "REAL"
    assert got["building"].is_join_key and got["building"].storage_type == "TEXT"
    assert got["warehouse_load_date"].is_audit and not got["warehouse_load_date"].is_join_key


def test_usecase_overrides_and_meanings(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("en_src1_7",), ("FAC_X",), ("plain",)], "t string")
    col = cg.usecase_text(F.col("t"), {"EN_SRC1_7": "Own text."}, {"FAC": "buildings", "X": "crossings"})
    assert [r[0] for r in df.select(col).collect()] == [
        "Own text.", "This table is useful for queries concerning buildings, crossings.",
        "This table stores records related to plain."]


def test_join_paths_with_known_pairs(spark):
    top = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, item_id long, rank int")
    keys = spark.createDataFrame([(10, "dept_code"), (11, "department"), (12, "term"), (10, "term")], "item_id long, key string")
    got = {(r.left_item, r.right_item): r.via for r in cg.join_paths(top, keys, [("dept_code", "department")]).collect()}
    assert got == {(10, 11): "dept_code=department", (10, 12): "term"}
    assert {(r.left_item, r.right_item) for r in cg.join_paths(top, keys).collect()} == {(10, 12)}
