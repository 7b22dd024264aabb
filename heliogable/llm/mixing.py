"""Mixing sources to target weights by capped water-filling, then seeded repetitions.

All in DataFrame functions.  Sources share a number of words by weight; none
gets more than ``max_epochs`` times its own size, and what a capped source can't
take goes to the others by their weights until nobody is above the cap.  In
order of cap / weight the capped sources come first, so the final level is found
in one pass over the sources: level(k) = (words - caps before k) / (weights from k).

A source's target is then a whole number of repetitions of all its documents and
a rest.  The rest is filled in the order of a seeded hash, up to the document
whose middle lies beyond it; the order is not sorted as a whole: sizes are
added up by 4096 ranges of the hash, and only the one range where the rest ends
is ordered, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogable.llm import store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: A source table up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int, share: float) -> DataFrame:
    """Of (source, source_size): each source's weight and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    every = Window.partitionBy(F.lit(1))
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    df = sources.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    df = df.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    words = F.sum("source_size").over(every) if share == 1 else F.lit(share) * F.sum("source_size").over(every)
    df = df.withColumn("level", (words - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # The first source in this order that its cap doesn't hold back sets the level of all that follow.
    df = df.withColumn("place", F.row_number().over(by_cap))
    df = df.withColumn("final", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(every)["level"])
    target = F.when(F.col("ratio") > F.col("final"), F.col("final") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return df.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """A row for each document: how often, and how many words of it, the mix takes.

    Returns doc_id, size, source_size, target (its source's), taken (words,
    repeats counted), times (repetitions) and the columns named in ``carry``.  Sources in code point order, null
    last, have the weights in turn.

    A null or empty text has size 0, and is taken as often as its place says,
    for 0 words.  A source without words has target 0.  A null id hashes as
    such; rows that repeat are documents of their own, ties in the hash are
    ordered by id, size and carried columns.  An empty table gives an empty one.
    The same rows give the same mix on every run and partitioning.  Other columns
    of the input are not read; a carried column may not have the name of a column
    returned.
    """
    spark, carry = docs.sparkSession, list(carry or [])
    if clash := {"doc_id", "size", "source_size", "target", "taken", "times"} & set(carry):
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    place = store.folder(spark, "mixing")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), *[F.col(c).alias("c_" + c) for c in carry])
    sized = store.keep(sized, f"{place}/sizes").withColumn("bin", F.substring("key", 1, 3))

    bins = store.keep(sized.groupBy("source", "bin").agg(F.sum("size").alias("words")), f"{place}/bins")
    plan = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = store.keep(plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), f"{place}/targets")
    small = plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if small else lambda x: x

    def with_plan(df: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "of")
        return df.join(hint(right), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    ends = with_plan(bins.withColumn("upto", upto), plan.select("source", "rest")).filter("upto >= rest")
    cut = ends.groupBy("source").agg(F.min("bin").alias("cut"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("below"))
    plan = plan.join(cut.withColumnRenamed("source", "cut_of"), F.col("source").eqNullSafe(F.col("cut_of")), "left").drop("cut_of", "weight")
    placed = with_plan(sized, store.keep(plan, f"{place}/plan"))

    inside = placed.filter("bin = cut")
    so_far = F.sum("size").over(Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", *["c_" + c for c in carry]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("extra", (F.col("below") + so_far - F.col("size") / F.lit(2.0) < F.col("rest")).cast("int"))
    outside = placed.filter("cut is null or bin <> cut").withColumn("extra", F.when(F.col("bin") < F.col("cut"), 1).otherwise(0))
    times = F.col("whole") + F.col("extra")
    return inside.unionByName(outside).select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.cast("int").alias("times"), *[F.col("c_" + c).alias(c) for c in carry])
