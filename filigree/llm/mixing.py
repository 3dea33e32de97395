"""Mixing sources to target weights with DataFrame operations only.

Every document gets a hash-random key; within its source, documents are taken in
the order of the keys up to the source's budget of words, the whole source
again and again where the budget exceeds it.  Running sums are distributed: the
key range of a source is cut in about sqrt(rows) ranges, the sums of the ranges
are accumulated (a small table), and each range is accumulated on its own, so
that no source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut


def n_words(text) -> F.Column:
    """The number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3) -> DataFrame:
    """``(source, source_size, rows, target, budget)`` from ``sizes (doc_id, source, size)``.

    Sources share the sum of all sizes by weight; a target stops at
    ``max_epochs`` times its source's size and the excess is shared anew by
    weight.  With the sources in the order of cap over weight that fixpoint is
    one pass: the first source whose cap is not reached sets the common level.
    ``weights (source, weight)``; without it 1, 2, 3, repeating, by code point,
    null last.  A source that ``weights`` does not name weighs 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    if weights is None:
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        per = per.withColumn("weight", ((rank - 1) % 3 + 1).cast("long"))
    else:
        named = weights.select(F.col("source").alias("_named"), F.col("weight").cast("double").alias("weight"))
        per = per.join(named, F.col("source").eqNullSafe(F.col("_named")), "left").drop("_named").fillna({"weight": 0})
    per = per.withColumn("cap", F.col("source_size") * max_epochs).withColumn("_ratio", F.col("cap") / F.nullif("weight", F.lit(0)))
    order = Window.orderBy(F.col("_ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    done = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    per = per.withColumn("_level", (F.sum("source_size").over(every) - done) / F.nullif(left, F.lit(0)))
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(every)["_level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    target = F.when(F.col("weight") > 0, target).otherwise(0.0)
    return per.withColumn("target", target).select(
        "source", "source_size", "rows", "target", F.least(F.round("target").cast("long"), "cap").alias("budget")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: DataFrame | None = None,
    max_epochs: int = 3,
    seed: int = 7,
) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken)`` for every row of ``docs``.

    ``taken``: words that the mix takes of the row, repeats counted; per source
    they add up to the target rounded to a whole word, so the last row taken may
    be taken in part.  A null text has size 0 and nothing is taken of it; rows
    with a null source are a source of their own; rows without an id are dealt
    by their text; equal ids and whole rows repeat in the result, and their
    order among each other does not matter; no rows give no rows; other columns
    are ignored.  Reruns agree: the key is a hash of id and seed.  ``targets``
    keeps a row per source and numbers them in one task: sources are thousands
    at most.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("?"), F.xxhash64(F.col(text_col)).cast("string")))
    key = F.md5(F.concat_ws("#", name, F.lit(str(seed))))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"))
    sizes = cut(sizes)
    plan = cut(targets(sizes, weights, max_epochs))
    named = plan.select(F.col("source").alias("_source"), "source_size", "target", "budget", F.ceil(F.sqrt("rows")).cast("long").alias("_ranges"))
    at = sizes.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    at = at.withColumn("_range", F.shiftright(place * F.col("_ranges"), 32))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_name")  # null apart from every string
    sums = at.groupBy(name, "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_name", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_name", "_range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = at.withColumn("_name", name).withColumn("_own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    run = run.join(sums, ["_name", "_range"])
    whole = F.coalesce(F.floor(F.col("budget") / F.nullif("source_size", F.lit(0))), F.lit(0))
    rest = F.col("budget") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least("size", rest - F.col("_before") - F.col("_own")))
    return run.select("doc_id", "size", "source", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as the mix takes of it, a row taken in part counted whole.

    ``mixed``: the result of ``mix(docs)``.  Where an id has several rows they
    share what is taken of the id in proportion, rounded up; null ids are one
    id.  Rows without words are never taken, so null and empty texts go; columns
    come back unchanged whatever their names; no rows give no rows.
    """
    per = mixed.groupBy("doc_id").agg(F.sum("taken").alias("_t"), F.sum("size").alias("_s"))
    times = per.where("_t > 0").select(F.col("doc_id").alias("_id"), F.ceil(F.col("_t") / F.col("_s")).cast("int").alias("_times"))
    held = docs.alias("d").join(times.alias("t"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("t._id")))
    own = F.struct(*[F.col(f"d.`{c}`") for c in docs.columns])
    copies = held.select(own.alias("d"), F.explode(F.sequence(F.lit(1), F.col("t._times"))))
    return copies.select(*[F.col("d").getField(c).alias(c) for c in docs.columns])
