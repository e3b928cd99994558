"""Benchmark decontamination by spaced-seed hashing, in native expressions only.

Texts are lower-cased and cut into runs of letters and digits. Fixed masks pick some
of the tokens in a span and ignore the others, so a changed word spoils only the seeds
that look at it. ``SEEDS`` has masks for every length of a window, such that each choice
of words that may change leaves one seed of it whole. Seeds of the benchmark and of the documents are joined
on their hash; a bounded bitmap of the benchmark's seeds drops nearly all document
seeds inside the scan. Around each hit the two token sequences are compared in place:
a document is contaminated by an item if, in some window of ``WINDOW`` aligned tokens
(all of a shorter item), at least ``SIMILARITY`` of them are equal.

Only the masks that the benchmark's lengths need are laid over documents. Hits are merged by document and item
before texts are fetched, and only documents with hits are fetched. A seed
that many documents share is split by adaptive skew handling, as each document seed
meets only the benchmark's own occurrences of it.

Defined results: null and empty texts or items give no rows; a null doc_id or item_id
gives no rows, as such a row cannot be named; rows that repeat a doc_id give one row
per item; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch.llm.bitmap import bitmap_of, may_contain
from shelfwatch.llm.common import narrowed, staged, table, text_of

# Fixed masks by window length: 1 is a token that counts, 0 one that is ignored. Windows of
# 5 to 9 tokens may have one other token, longer ones two; shorter ones are equal whole.
SEEDS = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("111", "1101"), 6: ("1111", "11011"), 7: ("11011",),
    8: ("111011", "110111"), 9: ("111011",), 10: ("111011", "1101011", "1110011"), 11: ("1101011", "1110011"),
    12: ("111011", "11010011"), 13: ("11101011", "110100111"),
}
# What the definition itself asks of an alignment before its windows are judged: one equal
# token. Oracle and brute force lay out all of these.
MASKS = ("1",)
SPAN = len(MASKS[0])
WINDOW = 13
SIMILARITY = 0.8


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased."""
    runs = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(runs, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(hashes: Column, mask: str) -> Column:
    """The seed of every position that has the mask's whole span."""
    used = [i for i, c in enumerate(mask) if c == "1"]
    positions = F.sequence(F.lit(0), F.size(hashes) - len(mask))
    seed = F.transform(positions, lambda i: F.xxhash64(F.lit(mask), *[F.get(hashes, i + k) for k in used]))
    return F.when(F.size(hashes) >= len(mask), seed).otherwise(F.array().cast("array<bigint>"))


def _window() -> Column:
    return F.least(F.lit(WINDOW), F.size("item_tokens"))


def masks_of(items: DataFrame) -> list[str]:
    """The masks that the items' lengths need; their windows have at most ``WINDOW`` lengths."""
    lengths = [r["n"] for r in items.select(_window().alias("n")).distinct().collect()]
    return sorted({m for n in lengths for m in SEEDS.get(n, ())}) or list(SEEDS[WINDOW])


def benchmark_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """(seed, item_id, item_at) of the items' positions, each under the masks of its length."""
    found = F.concat(*(
        F.when(_window().isin([n for n in SEEDS if m in SEEDS[n]]),
               F.transform(_seeds(F.col("item_tokens"), m), lambda seed, at: F.struct(at.alias("item_at"), seed.alias("seed"))))
        .otherwise(F.array().cast("array<struct<item_at:int,seed:bigint>>")) for m in masks
    ))
    return items.select("item_id", F.explode(found).alias("hit")).select("hit.seed", "item_id", "hit.item_at")


def document_seeds(docs: DataFrame, bitmap: Column, masks: list[str]) -> DataFrame:
    """(doc_id, doc_at, seed) of the positions whose seed may be one of the benchmark's."""
    rows = docs.select("doc_id", tokens(text_of()).alias("hashes"))

    def kept(mask: str) -> Column:
        return F.array_compact(F.transform(
            _seeds(F.col("hashes"), mask),
            lambda seed, at: F.when(may_contain(bitmap, seed), F.struct(at.alias("doc_at"), seed.alias("seed"))),
        ))

    return rows.select("doc_id", F.explode(F.concat(*map(kept, masks))).alias("hit")).select("doc_id", "hit.*")


def _window_matches(length: Column, equal: Column) -> Column:
    """The most equal tokens in a window of aligned ones; ``equal`` is an array of 0 and 1."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(equal) - length + 1))
    return F.array_max(F.transform(
        starts, lambda s: F.aggregate(F.slice(equal, s, length), F.lit(0), lambda total, x: total + x)
    ))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains, tolerating substitutions.

    Returns doc_id, item_id, window (tokens compared), matches (equal ones in the best
    window), overlap (equal tokens along the best alignment), item_length (its tokens).
    """
    docs = narrowed(docs, "doc_id", "text").filter("doc_id IS NOT NULL")
    items = narrowed(benchmark, "item_id", "text").filter("item_id IS NOT NULL")
    items = staged(items.select("item_id", tokens(text_of()).alias("item_tokens")), "items")
    masks = masks_of(items)
    seeds = staged(benchmark_seeds(items, masks), "seeds")
    hits = document_seeds(docs, bitmap_of(seeds, "seed"), masks).join(seeds, "seed")
    # one row per document and item; the shifts are no more than the tokens of both
    hits = hits.groupBy("doc_id", "item_id").agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("shifts"))
    hits = staged(hits, "hits")
    named = hits.select(F.xxhash64("doc_id").alias("key"))
    found = docs.filter(may_contain(bitmap_of(named, "key"), F.xxhash64("doc_id")))
    found = found.select("doc_id", tokens(text_of()).alias("doc_tokens"))
    pairs = hits.join(found, "doc_id").join(items, "item_id")
    n = F.size("item_tokens")
    rows = pairs.withColumn("window", _window()).withColumn("least", F.ceil(_window() * SIMILARITY).cast("int"))

    def equal_at(shift: Column) -> Column:
        """0 or 1 for the item's positions that lie over the document at this shift."""
        over = F.sequence(F.greatest(F.lit(0), -shift), F.least(n, F.size("doc_tokens") - shift) - 1)
        return F.transform(over, lambda i: (F.get("doc_tokens", i + shift) == F.get("item_tokens", i)).cast("int"))

    def judged(best: Column, shift: Column) -> Column:
        """The better of ``best`` and this shift, if it matches; one shift is laid out at a time."""
        laid = F.transform(F.array(equal_at(shift)), lambda equal: F.struct(
            _window_matches(F.col("window"), equal).alias("matches"),
            F.aggregate(equal, F.lit(0), lambda total, x: total + x).alias("overlap"),
        ))
        return F.get(F.transform(laid, lambda x: F.when(
            x["matches"] >= F.col("least"),
            F.struct(F.greatest(best["matches"], x["matches"]).alias("matches"), F.greatest(best["overlap"], x["overlap"]).alias("overlap")),
        ).otherwise(best)), 0)

    none = F.struct(F.lit(0).alias("matches"), F.lit(0).alias("overlap"))
    rows = rows.withColumn("best", F.aggregate("shifts", none, judged)).filter("best.matches > 0")
    return rows.groupBy("doc_id", "item_id").agg(  # rows that repeat a doc_id
        *[F.max(F.col(c).cast("long")).alias(a) for c, a in (
            ("window", "window"), ("best.matches", "matches"), ("best.overlap", "overlap"))],
        F.max(n.cast("long")).alias("item_length"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that contain a benchmark item; a null doc_id stays."""
    bad = staged(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents only, one row per document and benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
