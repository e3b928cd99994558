"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. Of each source, whole documents
are taken once or not at all, and then some of them once more (never beyond twice),
so that the words taken come as near to the source's target as whole documents
allow, from below or above. How many documents of each length that needs is found by
taking every length in proportion, up to ``TABLE`` words before the budget's end, and
fitting the rest by bounded-knapsack dynamic programming over the remaining counts: the
nearest sum of all for budgets up to ``TABLE / 2``, and beyond that the nearest one that
holds what was taken in proportion. The documents of a length are then selected by
a seeded hash of their ids, so reruns agree.

Only the table of lengths is fitted in one task per source: it has at most
sqrt(2 * words of the source) rows. Documents of one source and length are selected
in slices of the hash, so a hot length is never sorted in one task.

Defined results: a null or empty text has size 0 and is never taken; a null source is
a source of its own, ordered last; rows that repeat a doc_id are chosen one by one; an
empty table gives no rows.
"""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from shelfwatch.llm.common import DOCUMENT, WORD, narrowed, staged, text_of

WEIGHTS = (3, 1, 2)  # repeating, over the sources in order
SHARE = 1.5  # of all sizes
MOST = 2  # times a document, and a source
TABLE = 1 << 16  # words the dynamic programme fits
SLICES = 1024
SEED = 20


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): weighted shares, capped at twice the source, excess reshared.

    The final level is found in closed form: sources in order of cap by weight are
    capped as long as the level that the others would get is above their own.
    ``sizes`` has one row per source, which one task can sort.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    everything = W.partitionBy()
    by_level = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * SHARE)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    rows = rows.withColumn("capped", level * F.col("weight") > F.col("cap"))
    free = F.when(~F.col("capped"), F.col("weight"))
    used = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    level = (F.col("budget") - used) / F.sum(free).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.least(level * F.col("weight"), F.col("cap").cast("double"))
    )
    return rows.select("source", "source_size", target.alias("target"))


def fit_budget(sizes: list[int], counts: list[int], budget: int, table: int = TABLE) -> list[int]:
    """How many of each size to take, at most ``counts``, to come nearest to ``budget``.

    Sizes are positive and distinct; of two sums as near, the one below is taken. Exact
    for budgets up to half of ``table``.
    """
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget >= total:
        return list(counts)
    proportion = max(0, budget - table // 2)
    picks = [c * proportion // total for c in counts]
    rest = budget - sum(s * p for s, p in zip(sizes, picks))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:  # down to what the table holds
        more = min(counts[i] - picks[i], max(0, -(-(rest - table) // sizes[i])), rest // sizes[i])
        picks[i] += more
        rest -= more * sizes[i]
    # Bounded knapsack: counts in powers of two, the sums reached as bits of one number.
    # The nearest sum above the rest goes beyond it by less than one document.
    free = [i for i in reversed(order) if counts[i] > picks[i]]
    most = rest + max((sizes[i] for i in free), default=0)
    reached, steps, within = 1, [], (1 << (most + 1)) - 1
    for i in free:
        left, part = min(counts[i] - picks[i], most // sizes[i]), 1
        while left > 0 and not reached >> rest & 1:
            part_now = min(part, left)
            steps.append((reached, i, part_now))
            reached |= (reached << (sizes[i] * part_now)) & within
            left -= part_now
            part *= 2
        if reached >> rest & 1:
            break
    at = (reached & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reached >> rest
    if above:
        over = (above & -above).bit_length() - 1
        if over < rest - at:
            at = rest + over
    for before, i, part in reversed(steps):
        if not before >> at & 1:
            picks[i] += part
            at -= sizes[i] * part
    return picks


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Every row with what the mix takes of it: doc_id, key, source, size, source_size, target, taken.

    ``taken`` is 0, 1 or 2 times the size; ``key`` is a hash of doc_id, source and text.
    """
    rows = narrowed(docs, "doc_id", "source", "text").select(
        "doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id").alias("draw"), F.xxhash64("doc_id", "source", "text").alias("key"),
    )
    rows = staged(rows.withColumn("slice", F.pmod("draw", F.lit(SLICES)).cast("int")), "lengths")
    slices = staged(rows.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n")), "slices")
    lengths = staged(slices.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    goal = staged(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        sizes, counts = group["size"].tolist(), group["n"].tolist()
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        base = int(target >= total)
        extra = fit_budget(sizes, counts, max(0, round(target) - base * total))
        return pd.DataFrame({"source": group["source"], "size": sizes, "base": base, "extra": extra})

    fitted = lengths.filter("size > 0").join(
        goal.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))
    ).groupBy("source").applyInPandas(fit, "source string, size long, base long, extra long")
    fitted = staged(fitted, "fitted")

    # The slice of each length in which the extra documents run out, and how many it gives.
    p = slices.alias("p").join(
        fitted.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")) & (F.col("p.size") == F.col("f.size"))
    ).select("p.source", "p.size", "slice", "n", "base", "extra")
    before = W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    quota = F.least(F.col("n"), F.greatest(F.lit(0), F.col("extra") - F.coalesce(F.sum("n").over(before), F.lit(0))))
    quotas = staged(p.select("source", "size", "slice", "base", quota.alias("quota")), "quotas")
    nth = F.row_number().over(W.partitionBy("source", "size", "slice").orderBy("draw", "doc_id"))
    r, q, g = rows.withColumn("nth", nth).alias("r"), quotas.alias("q"), goal.alias("g")
    return (
        r.join(q, F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.size") == F.col("q.size"))
               & (F.col("r.slice") == F.col("q.slice")), "left")
        .join(g, F.col("r.source").eqNullSafe(F.col("g.source")))
        .select(
            "r.doc_id", "r.key", "r.source", "r.size", "g.source_size", "g.target",
            (F.col("r.size") * F.coalesce(F.col("base") + (F.col("nth") <= F.col("quota")).cast("long"), F.lit(0)))
            .alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (columns of documents) as often as the mix takes them.

    Rows that are equal in doc_id, source and text share what the mix takes of them; where
    that does not go up evenly, those that come first by their other columns get one more.
    """
    columns = [c for c in DOCUMENT if c in docs.columns]
    known = docs.select(*columns).withColumn("_key", F.xxhash64("doc_id", "source", "text"))
    times = F.sum(F.expr("taken div size"))
    chosen = mix(docs, seed).filter("size > 0").groupBy("key").agg(times.alias("times"), F.count(F.lit(1)).alias("rows"))
    chosen = staged(chosen.filter("times > 0").select(
        F.col("key").alias("_key"), F.expr("int(times div rows)").alias("_times"), (F.col("times") % F.col("rows")).alias("_rest")
    ), "times")
    even = known.join(chosen.filter("_times > 0").drop("_rest"), "_key")
    uneven = known.join(chosen.filter("_rest > 0").drop("_times"), "_key").groupBy("_key", "_rest", *columns).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_key").orderBy(*columns).rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_rest") - F.coalesce(F.sum("_n").over(before), F.lit(0))
    uneven = uneven.withColumn("_times", F.least(F.col("_n"), left).cast("int")).filter("_times > 0").drop("_rest", "_n")
    return even.unionByName(uneven).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )
