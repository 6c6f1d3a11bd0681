"""Null-safe numeric helpers and the guarded SQL functions (LOG, EXP,
ASCII, VARIANCE family) as Column expressions, plus SQL registration."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Text accepted as a number: what Python's float() accepts (digits with
# single underscores between them, optional fraction and exponent, or
# nan / inf / infinity), surrounded by optional whitespace.
NUMERIC_TEXT = (r"^\s*[+-]?((\d(_?\d)*)?\.?\d(_?\d)*([eE][+-]?\d(_?\d)*)?|\d(_?\d)*\."
                r"|(?i:nan|inf|infinity))\s*$")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(x) -> Column:
    """Numeric view of any value: numbers as is, text parsed the way
    Python's float() parses it, anything else null (skipped, not an
    error)."""
    s = _c(x).cast("string")
    return F.when(s.rlike(NUMERIC_TEXT), F.regexp_replace(s, "_", "").try_cast("double"))


def sigmoid(x) -> Column:
    """Logistic function; exp overflow gives exactly 0 or 1."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def calibrated_score(logit) -> Column:
    """sigmoid((x + 2.5) / 1.2), 0.5 when there is no logit, 4 d.p."""
    c = _c(logit)
    return F.round(F.when(c.isNull(), F.lit(0.5)).otherwise(sigmoid((c + 2.5) / 1.2)), 4)


def finite_or_zero(x) -> Column:
    """NaN and +/-infinity become 0."""
    c = _c(x)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def fn_log(x) -> Column:
    """Natural log; null for null, non-numeric or <= 0."""
    d = as_double(x)
    return F.when(d > 0, F.ln(d))


def fn_exp(x) -> Column:
    """exp; null for null, non-numeric or overflow."""
    e = F.exp(as_double(x))
    return F.when(F.abs(e) != float("inf"), e)


def fn_ascii(x, numeric: bool = False) -> Column:
    """Code point of the first character of the value as text; null for
    falsy values: null, the empty string, and zero when ``numeric``."""
    c = _c(x)
    if numeric:
        return F.when(c.isNotNull() & (c != 0), F.ascii(c.cast("string")))
    return F.when(c.isNotNull() & (c != ""), F.ascii(c))


# --- aggregates -----------------------------------------------------------

def agg_variance(x) -> Column:
    """Sample variance of the numeric values; 0.0 for one value, null for none."""
    d = as_double(x)
    return F.when(F.count(d) == 1, F.lit(0.0)).otherwise(F.var_samp(d))


def agg_stddev(x) -> Column:
    """Sample standard deviation; 0.0 for one value, null for none."""
    d = as_double(x)
    return F.when(F.count(d) == 1, F.lit(0.0)).otherwise(F.stddev_samp(d))


def agg_var_pop(x) -> Column:
    """Population variance of the numeric values; null for none."""
    return F.var_pop(as_double(x))


def agg_stddev_pop(x) -> Column:
    """Population standard deviation; null for none."""
    return F.stddev_pop(as_double(x))


# the SQL text of ``as_double`` for the argument x
_NUMERIC = "CASE WHEN x RLIKE '{}' THEN try_cast(replace(x, '_', '') AS DOUBLE) END".format(
    NUMERIC_TEXT.replace("\\", "\\\\"))

SQL_FUNCTIONS = {
    "rs_log": ("x STRING", "DOUBLE", f"CASE WHEN {_NUMERIC} > 0 THEN ln({_NUMERIC}) END"),
    "rs_exp": ("x STRING", "DOUBLE", f"CASE WHEN abs(exp({_NUMERIC})) != double('inf') THEN exp({_NUMERIC}) END"),
    "rs_ascii": ("x STRING", "INT", "CASE WHEN x IS NOT NULL AND x != '' THEN ascii(x) END"),
    "rs_sigmoid": ("x DOUBLE", "DOUBLE", "1.0 / (1.0 + exp(-x))"),
}


def register_sql_functions(spark: SparkSession) -> None:
    """SQL users get the guarded scalars under ``rs_*`` names as temporary
    SQL functions of the session."""
    for name, (args, ret, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
