"""What each filter of a chain removes, in every order of the filters, by decision diagrams.

Every document fails a set of the filters, its failure mask. Masks are counted per part
with map-side combine, so a part of any size is at most 32 rows. Its counts become a
decision diagram with one level per filter: a node has a child for documents that pass
the filter and one for those that fail it, equal sub-diagrams are one node, and every
node knows the weights below it. Neighbouring levels are swapped to reorder the filters;
the 120 orders are visited by such swaps alone, one per order. In each order the path of
the passing children has the numbers of all five steps.

Null texts count as empty, a null source is the part ''. Labels of one doc_id count as
one, quality or toxic if any of them says so; labels of no document count nowhere. A
document without doc_id has no label, and its doc_id comes after all others: it repeats
the text of every document that has one, and no other document without. Rows that repeat
a doc_id and its text are counted as often as they occur and don't repeat each other.
No document gives no row.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch.llm.common import documents, narrowed, staged, table, text_of, words_of
from shelfwatch.llm.diagram import Diagram, swaps_through_all_orders

# The filters in the order of the bits of a mask, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 2
SYMBOLS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> Column:
    """Bits of the four filters that look at the text alone."""
    words = words_of(text)
    capitals = (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long")
    fails = [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_PERCENT * F.size(words).cast("long"),
        100 * capitals > CAPITALS_PERCENT * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]
    bits = F.lit(0)
    for place, failing in enumerate(fails):
        bits = bits + F.when(failing, 1 << place).otherwise(0)
    return bits


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part have each failure mask."""
    rows = narrowed(docs, "doc_id", "text", "source").select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest"),
        text_failures(text_of()).alias("bits"),
    )
    rows = staged(rows, "failures")
    # joined by doc_id beside the digest: the copies of a text spread over all tasks
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    first = first.select(F.col("digest").alias("text"), "first", F.lit(True).alias("is_first"))
    rows = rows.join(first, (F.col("digest") == F.col("text")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = known.select(F.col("doc_id").alias("labelled"), "good", "toxic")
    rows = rows.join(known, F.col("doc_id") == F.col("labelled"), "left")
    repeats = F.when(F.col("is_first"), 0).otherwise(1 << FILTERS.index("E"))
    return rows.groupBy("part", (F.col("bits") + repeats).alias("mask")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("good").alias("good"),
        F.count_if("toxic").alias("toxic"),
    )


def audit_orders(counts: dict[int, tuple[int, int, int]]) -> Iterator[tuple]:
    """Rows of the audit without the part; counts are (n, good, toxic) by mask."""
    diagram = Diagram(FILTERS, counts, 3)
    paths = {diagram.order: list(diagram.path())}
    for level in swaps_through_all_orders(len(FILTERS)):
        diagram.swap(level)
        paths[diagram.order] = list(diagram.path())
    fails, alone, shared = {}, {}, dict.fromkeys(FILTERS, 0)
    for path in paths.values():
        fails[path[0][0]] = path[0][2][0]  # a filter at the front removes all that fail it,
        alone[path[-1][0]] = path[-1][2][0]  # and at the end what fails nothing else
        for letter, _, removed in path:
            shared[letter] += removed[0]
    for order, path in sorted(paths.items()):
        for step, (letter, kept, (removed, good, toxic)) in enumerate(path, 1):
            yield order, step, kept[0], removed, fails[letter] - removed, alone[letter], good, toxic, shared[letter]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, see AUDIT."""

    def of_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in rows.itertuples()}
        names = [c.split()[0] for c in AUDIT.split(", ")]
        return pd.DataFrame([(key[0], *row) for row in audit_orders(counts)], columns=names)

    return mask_counts(docs, labels).groupBy("part").applyInPandas(of_part, AUDIT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         min(doc_id) OVER (PARTITION BY t) AS first
  FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN first < w.doc_id OR (w.doc_id IS NULL AND first IS NOT NULL) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), m AS (
  SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY part, mask
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)
), chains AS (
  WITH RECURSIVE c(filter_order, seen, step, letter, bit, before) AS (
    SELECT letter, bit, 1, letter, bit, 0 FROM letters
    UNION ALL
    SELECT c.filter_order || l.letter, c.seen | l.bit, c.step + 1, l.letter, l.bit, c.seen
    FROM c JOIN letters l ON c.seen & l.bit = 0
  ) SELECT * FROM c
), steps AS (
  SELECT whole.filter_order, part.step, part.letter, part.bit, part.before
  FROM chains whole JOIN chains part ON whole.step = 5 AND starts_with(whole.filter_order, part.filter_order)
), audited AS (
  SELECT m.part, filter_order, step, letter,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m CROSS JOIN steps GROUP BY m.part, filter_order, step, letter
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM audited
"""
