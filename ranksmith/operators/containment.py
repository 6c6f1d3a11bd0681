"""Exact substring-containment join without a nested loop.

``contains_pairs(hay, needles)`` returns every (hay_id, needle_id) where
the needle text occurs verbatim in the haystack text.  A broadcast
``instr`` theta join would compare every needle with every haystack row;
instead the join runs on an equi-key:

* The haystack is indexed by its character g-grams at sampled positions
  1, 1+s, 1+2s, ...  (one row per distinct gram per row).
* A needle of length m >= g + s - 1, wherever it occurs, covers a sampled
  position whose whole g-gram lies inside it; which needle offsets those
  are depends only on the alignment r = offset mod s.  So for each r one
  needle gram of that residue class must be among the haystack's sampled
  grams: we pick the rarest one (by its haystack frequency), join, take
  the union over r and verify candidates with ``instr``.  No candidate is
  missed, and hot grams (repeated lines, boilerplate) are avoided
  whenever a rarer gram of the same class exists.
* Shorter needles go to a finer tier (smaller g and s); the last tier
  (g = s = 1) handles every non-empty needle.

Empty needles are skipped (they would match every row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .util import BROADCAST_MAX_ROWS, has_at_most

DEFAULT_TIERS = ((8, 8), (3, 3), (1, 1))


def _sampled_grams(hay: DataFrame, g: int, s: int) -> DataFrame:
    if g == s:
        # grams at 1, 1+g, 1+2g, ... are the consecutive g-character chunks:
        # one native regex pass, no per-element lambda
        grams = F.array_distinct(F.regexp_extract_all("htext", F.lit("(?s)(.{%d})" % g), 1))
    else:
        n = F.length("htext")
        pos = F.when(n >= g, F.sequence(F.lit(1), n - g + 1, F.lit(s))).otherwise(F.array().cast("array<int>"))
        grams = F.array_distinct(F.transform(pos, lambda p: F.col("htext").substr(p, F.lit(g))))
    return (hay.select("hid", F.explode_outer(grams).alias("gram"))
            .filter(F.col("gram").isNotNull()))


def _needle_grams(nt: DataFrame, g: int, s: int) -> DataFrame:
    offs = F.sequence(F.lit(0), F.length("ntext") - g)
    grams = F.transform(offs, lambda o: F.struct(
        (o % s).alias("r"), o.alias("o"), F.col("ntext").substr(o + 1, F.lit(g)).alias("gram")))
    return (nt.select("nid", F.explode_outer(grams).alias("x")).filter(F.col("x").isNotNull())
            .select("nid", "x.r", "x.o", "x.gram"))


def contains_pairs(hay: DataFrame, hay_id: str, hay_text: str,
                   needles: DataFrame, needle_id: str, needle_text: str,
                   tiers=DEFAULT_TIERS) -> DataFrame:
    """(hay_id, needle_id) pairs with ``needle_text`` inside ``hay_text``."""
    h = hay.select(F.col(hay_id).alias("hid"), F.col(hay_text).alias("htext")).filter(F.col("htext").isNotNull())
    n_all = needles.select(F.col(needle_id).alias("nid"), F.col(needle_text).alias("ntext")) \
        .filter(F.length("ntext") > 0)
    out = None
    upper = None
    for g, s in tiers:
        lo = g + s - 1
        cond = F.length("ntext") >= lo
        if upper is not None:
            cond = cond & (F.length("ntext") < upper)
        upper = lo
        nt = n_all.filter(cond)
        if has_at_most(nt, 0):
            continue
        # broadcast bounds, checked on the data: needle grams number about
        # the total needle length; needle text is bounded in bytes
        total_chars = nt.agg(F.sum(F.length("ntext"))).first()[0] or 0
        small = total_chars <= BROADCAST_MAX_ROWS and has_at_most(nt, BROADCAST_MAX_ROWS // s)
        ng = _needle_grams(nt, g, s)
        hg = _sampled_grams(h, g, s)
        wanted = ng.select("gram").distinct()
        freq = (hg.join(F.broadcast(wanted) if small else wanted, "gram")
                .groupBy("gram").agg(F.count(F.lit(1)).alias("df")))
        chosen = (ng.join(freq, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
                  .groupBy("nid", "r").agg(F.min_by("gram", F.struct("df", "o")).alias("gram"))
                  .select("nid", "gram"))
        cand = hg.join(F.broadcast(chosen) if small else chosen, "gram").select("hid", "nid").distinct()
        # candidates are usually few: when their checked count allows,
        # broadcast them with the needle text so the haystack text is
        # scanned in place for verification instead of shuffled
        checkpoint_dir(cand.sparkSession)
        cand = cand.checkpoint(eager=True)
        cn = cand.join(F.broadcast(nt) if small else nt, "nid")
        ver = (h.join(F.broadcast(cn) if small and has_at_most(cand, BROADCAST_MAX_ROWS // 8) else cn, "hid")
               .filter(F.instr(F.col("htext"), F.col("ntext")) > 0)
               .select("hid", "nid"))
        out = ver if out is None else out.unionByName(ver)
    if out is None:  # no non-empty needle: an empty result of the right schema
        out = h.select("hid", F.lit(None).cast(needles.schema[needle_id].dataType).alias("nid")).limit(0)
    return out.select(F.col("hid").alias(hay_id), F.col("nid").alias(needle_id))
