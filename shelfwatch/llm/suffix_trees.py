"""Substring dedup over words by prefix-partitioned suffix trees.

Suffixes are dealt out by what equal ones share, so that each group fits one task:
normally the anchor inside their first window (``GRAM`` words). Where one anchor has more
than ``GROUP_LIMIT`` different contents, its suffixes are dealt out by the shortest of
their ``PREFIXES`` that at most as many begin with, and those of a longer prefix still by
the whole window, whose tree is one node (``trees_by_prefix``). In a task the
suffix trees of its groups are built from the root downwards, one level of words at a
time for all of them: a node's suffixes are parted by their next word, and a suffix
that is alone becomes a leaf and is done. Nodes still shared at the depth of a window
are the repeats; the smallest doc_id below such a node is the document that keeps it.

Words are compared as 64-bit hashes. What equal and nearly equal documents share is
merged before any tree is built (see ``repeats``).

Defined results: a null, empty or short text (under 50 words) loses nothing; a document
whose words are all removed keeps the empty string; rows that repeat a doc_id do not
remove each other's words; a null doc_id is larger than any other; an empty table gives
no rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwatch.llm import repeats, windows as win
from shelfwatch.llm.common import shuffle_partitions, staged, words_of

CHUNK = 64  # window starts in a chunk, on average
CHUNK_GRAM = 4
GRAM = 12
GROUP_LIMIT = 5000  # some 5 MB of words
PREFIXES = [16, 32]  # words of longer prefixes


def split_words(text: str) -> list[bytes]:
    return text.encode().split()  # on the six ASCII white-space characters


def word_units(text: str) -> np.ndarray:
    words = split_words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def tree_earliest(keys: np.ndarray, contents: list[np.ndarray], docs: np.ndarray) -> np.ndarray:
    """The smallest doc below the node of each window start at depth ``WINDOW``."""
    counts = np.array([len(c) - win.WINDOW + 1 for c in contents])
    lengths = counts + win.WINDOW - 1
    _, symbols = np.unique(np.concatenate(contents), return_inverse=True)
    begins = np.cumsum(lengths) - lengths
    at = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    earliest = np.repeat(docs, counts)
    own = earliest.copy()
    _, node = np.unique(np.repeat(keys, counts), return_inverse=True)
    shared = np.arange(len(at))
    for depth in range(win.WINDOW):
        child = node * (symbols.max() + 1) + symbols[at[shared] + depth]
        _, node, size = np.unique(child, return_inverse=True, return_counts=True)
        alone = size[node] == 1
        if alone.any():
            shared = shared[~alone]
            _, node = np.unique(node[~alone], return_inverse=True)
        if not len(shared):
            return earliest
    least = np.full(node.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, own[shared])
    earliest[shared] = least[node]
    return earliest


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window start: its window's words and the hashes of its prefixes."""
    for batch in batches:
        for key, content, doc, raw in zip(*(batch.column(n).to_pylist() for n in ("key", "content", "doc", "units"))):
            units = np.frombuffer(raw, np.uint64)
            spans, at = win.Spans(units), np.arange(len(units) - win.WINDOW + 1)
            same = [pa.array(np.full(len(at), x, np.int64)) for x in (key, content, doc)]
            whole = np.lib.stride_tricks.sliding_window_view(units, win.WINDOW)
            prefixes = [pa.array(spans.hashes(at, at + n).view(np.int64)) for n in [*PREFIXES, win.WINDOW]]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array(at), pa.array([w.tobytes() for w in whole], pa.binary()), *prefixes],
                names=["key", "content", "doc", "at", "units", *_PREFIX_NAMES],
            )


_PREFIX_NAMES = [f"prefix_{n}" for n in [*PREFIXES, win.WINDOW]]
_SUFFIX = "key long, content long, doc long, at long, units binary, " + ", ".join(f"{n} long" for n in _PREFIX_NAMES)


def _trees(suffixes: DataFrame, prefix: str) -> DataFrame:
    """``RESOLVED`` rows of suffixes from the trees below their prefixes."""

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        data = [np.frombuffer(x, np.uint64) for x in group["units"]]
        earliest = tree_earliest(group[prefix].to_numpy(), data, group["doc"].to_numpy())
        return group[["key", "content", "at"]].assign(n=1, earliest=earliest)

    parts = 8 * shuffle_partitions(suffixes.sparkSession)
    rows = suffixes.select("key", "content", "doc", "at", "units", prefix)
    return rows.groupBy(F.pmod(prefix, F.lit(parts)).alias("part")).applyInPandas(resolve, repeats.RESOLVED)


def trees_by_prefix(contents: DataFrame, dtype: type) -> DataFrame:
    """``RESOLVED`` rows of contents whose anchor has too many for one task, by longer prefixes.

    A prefix of more than ``GROUP_LIMIT`` suffixes hands them on to the next length; Spark
    takes the smallest doc of whole windows, combined before the shuffle.
    """
    rows = staged(contents.select("key", "content", "doc", "units").mapInArrow(_suffixes, _SUFFIX), "suffixes")
    found = []
    for prefix in _PREFIX_NAMES[:-1]:
        large = rows.groupBy(prefix).agg(F.count(F.lit(1)).alias("suffixes")).filter(F.col("suffixes") > GROUP_LIMIT)
        large = staged(large.select(prefix, F.lit(True).alias("large")), "large-prefixes")
        dealt = rows.join(large, prefix, "left")
        found.append(staged(_trees(dealt.filter("large IS NULL"), prefix), "trees"))
        rows = staged(dealt.filter("large").drop("large"), "suffixes")
    least = staged(rows.groupBy(_PREFIX_NAMES[-1]).agg(F.min("doc").alias("earliest")), "whole-windows")
    whole = rows.join(least, _PREFIX_NAMES[-1]).select("key", "content", "at", F.lit(1).cast("long").alias("n"), "earliest")
    for trees in found:
        whole = whole.unionByName(trees)
    return whole


def removed_words(docs: DataFrame) -> DataFrame:
    """(doc, rid, ranges) of documents with words to remove; ``docs`` as from ``identified``."""
    return repeats.repeated_windows(docs, word_units, np.uint64, (CHUNK, CHUNK_GRAM), GRAM, GROUP_LIMIT, tree_earliest,
                                    trees_by_prefix)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            words = split_words(text)
            if not ranges:
                rows.append((len(words), 0, b" ".join(words)))
                continue
            gone = win.covered(len(words), np.array([r["first"] for r in ranges]), np.array([r["n"] for r in ranges]))
            rows.append((len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)),
             pa.array([r[2].decode() for r in rows], pa.string())],
            names=["doc", "n_words", "n_removed", "kept_text"],
        )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of ``docs``."""
    rows = repeats.identified(docs)
    gone = removed_words(rows)
    # Only documents that may lose words travel to their ranges.
    touched, clean = repeats.parted(rows, gone)
    touched = touched.join(gone, ["doc", "rid"], "left").select("doc", "text", "ranges").mapInArrow(
        _kept, "doc long, n_words long, n_removed long, kept_text string"
    )
    words = words_of(F.col("text"))
    clean = clean.select("doc", words.alias("words")).select(
        "doc", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
        F.array_join("words", " ").alias("kept_text"),
    )
    return touched.unionByName(clean).select(repeats.doc_id(), "n_words", "n_removed", "kept_text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM s
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first_id FROM h) WHERE first_id < doc_id
), g AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM r GROUP BY doc_id
), k AS (
  SELECT d.doc_id, d.w, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE
         [w[i] for i in range(1, len(w) + 1) if NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM k
"""
