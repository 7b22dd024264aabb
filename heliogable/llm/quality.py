"""Quality rules whose cutoffs follow each language and source.

All in DataFrame functions.  Statistics are taken once per document and written;
each metric is then counted in logarithmic bins (a DDSketch: bin b holds values
in (g**(b-1), g**b], so any quantile has a relative error of at most
(g - 1) / (g + 1)).  A sketch is a set of counts: sketches of one language and
source add up to those of the language and of everything, whichever has enough
documents to speak for a group.  Upper and lower fences are read from the
quantiles, joined to the documents, and a document outside a fence goes.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogable.llm import store

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
GAMMA = 1.02
#: Documents that a sketch needs before its own quantiles count.
ENOUGH = 200
#: A group table up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000
#: metric: (fence below too, spread factor, least distance of a fence from the median)
METRICS = {"mean_word": (True, 4.0, 2.0), "symbols": (False, 4.0, 0.05), "dup_lines": (False, 4.0, 0.5), "capitals": (False, 4.0, 0.25)}


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _window_hashes(words: Column) -> Column:
    """A hash of each run of eight words."""
    runs = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - REPEAT_WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, REPEAT_WINDOW)))
    return _bound(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _covered(hashes: Column) -> Column:
    """Words in runs whose hash is there twice: sort (hash, place), keep places next to an equal hash, add up the gaps, eight at most."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, k, j: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
    places = _bound(placed, lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (same(s, k, k + 1) | same(s, k, k - 1)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"])))
    gaps = _bound(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(REPEAT_WINDOW)))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def statistics(docs: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    """A row for each document: counts by which rules judge."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(group_cols)], text.alias("t"))
    df = df.withColumn("w", F.filter(F.split("t", SPACE), lambda x: x != ""))
    df = df.withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("h", F.when(F.size("w") >= REPEAT_WINDOW, _window_hashes(F.col("w"))))
    count = lambda c: c.cast("long")
    repeated = F.when(F.col("h").isNull() | (F.size(F.array_distinct("h")) == F.size("h")), 0).otherwise(_covered(F.col("h")))
    return df.select(
        "doc_id", *[f"g{i}" for i in range(len(group_cols))], count(F.size("w")).alias("n_words"),
        count(F.length(F.array_join("w", ""))).alias("word_chars"),
        count(F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        count(F.size("l")).alias("n_lines"), count(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"), count(repeated).alias("n_repeat_words"),
        count(F.length(F.regexp_replace("t", r"\P{Lu}+", ""))).alias("n_capitals"),
    )


def _bin(value: Column) -> Column:
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(log(GAMMA)))).otherwise(F.lit(-100_000)).cast("int")


def _middle(b: Column) -> Column:
    """The value that stands for a bin."""
    return F.when(b == -100_000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), b.cast("double")) / (1 + GAMMA))


def sketches(stats: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of bins by group and metric: partial counts are made before the shuffle."""
    ratios = {"mean_word": F.col("word_chars") / F.col("n_words"), "symbols": F.col("n_symbols") / F.col("n_words"), "dup_lines": F.col("n_dup_lines") / F.col("n_lines"), "capitals": F.col("n_capitals") / F.col("word_chars")}
    values = F.array(*[F.struct(F.lit(k).alias("metric"), _bin(v).alias("bin")) for k, v in ratios.items()])
    return stats.filter("not base_failed").select(*groups, F.inline(values)).groupBy(*groups, "metric", "bin").agg(F.count("*").alias("n"))


def merged(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of several groups added up to coarser ones."""
    return counts.groupBy(*groups, "metric", "bin").agg(F.sum("n").alias("n"))


def fences(counts: DataFrame, groups: list[str]) -> DataFrame:
    """A row for each group: documents, and a lower and upper fence for each metric."""
    own = Window.partitionBy(*groups, "metric")
    ranked = counts.select("*", F.sum("n").over(own).alias("all"), F.sum("n").over(own.orderBy("bin")).alias("upto"))
    at = lambda q: _middle(F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))))
    row = ranked.groupBy(*groups, "metric").agg(F.max("all").alias("n"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    out = [F.max("n").alias("n")]
    for m, (below, k, least) in METRICS.items():
        of = F.col("metric") == m
        out.append(F.max(F.when(of, F.col("q2") + F.greatest(F.lit(least), k * (F.col("q3") - F.col("q2"))))).alias(f"{m}_high"))
        if below:
            out.append(F.max(F.when(of, F.col("q2") - F.greatest(F.lit(least), k * (F.col("q2") - F.col("q1"))))).alias(f"{m}_low"))
    return row.groupBy(*groups).agg(*out)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The statistics of each document, the fences that it is held against, base_failed and kept.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines, n_capitals, basis (how many of ``group_cols`` the
    fences are of: a group of under 200 documents that pass the base rule uses
    the sketch of the first column alone, then that of all), and the fences.

    A null or empty text has no words and fails the base rule.  Null groups are
    groups like others.  Rows that repeat are judged each.  Where no document
    passes the base rule there are no fences and nothing else fails.  Other
    columns of the input are not read.
    """
    spark, groups = docs.sparkSession, [f"g{i}" for i in range(len(group_cols))]
    place = store.folder(spark, "quality")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = store.keep(statistics(docs, id_col, text_col, list(group_cols)).withColumn("base_failed", failed), f"{place}/stats")
    counts = store.keep(sketches(stats, groups), f"{place}/sketches")
    names = [f"{m}_{side}" for m, (below, _, _) in METRICS.items() for side in (["high", "low"] if below else ["high"])]
    level = fences(counts, groups)
    for k in range(len(groups), -1, -1):
        if k == len(groups):
            level = level.withColumn("basis", F.when(F.col("n") >= ENOUGH, F.lit(k)))
            continue
        upper = fences(merged(counts, groups[:k]), groups[:k]).select(*[F.col(g).alias(f"u_{g}") for g in groups[:k]], F.col("n").alias("u_n"), *[F.col(c).alias(f"u_{c}") for c in names])
        joined = level.join(upper, on=[F.col(g).eqNullSafe(F.col(f"u_{g}")) for g in groups[:k]], how="left") if k else level.crossJoin(F.broadcast(upper))
        use = F.col("basis").isNull()
        level = joined.select(*groups, "n", *[F.when(use, F.col(f"u_{c}")).otherwise(F.col(c)).alias(c) for c in names], F.when(use & (F.lit(k == 0) | (F.col("u_n") >= ENOUGH)), F.lit(k)).otherwise(F.col("basis")).alias("basis"))
    level = store.keep(level.select(*[F.col(g).alias(f"f_{g}") for g in groups], *names, "basis"), f"{place}/fences")
    # The table has a row for each group; it is broadcast only where a count shows it small.
    small = level.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    judged = stats.join(F.broadcast(level) if small else level, on=[F.col(g).eqNullSafe(F.col(f"f_{g}")) for g in groups], how="left")
    value = {"mean_word": F.col("word_chars") / F.col("n_words"), "symbols": F.col("n_symbols") / F.col("n_words"), "dup_lines": F.col("n_dup_lines") / F.col("n_lines"), "capitals": F.col("n_capitals") / F.col("word_chars")}
    outside = F.lit(False)
    for m, (below, _, _) in METRICS.items():
        outside = outside | F.coalesce(value[m] > F.col(f"{m}_high"), F.lit(False))
        if below:
            outside = outside | F.coalesce(value[m] < F.col(f"{m}_low"), F.lit(False))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~outside)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lines", "n_capitals", "basis", *names)
