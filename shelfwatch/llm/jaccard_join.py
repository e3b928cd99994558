"""N-gram Jaccard join by a grouped prefix join, and the components of its links.

A document is the set of its distinct word shingles; two documents link when their
Jaccard similarity is at least a given ``Ratio`` t. Linked sets share a shingle
among the first ``n - ceil(t * n) + 1`` of each in any common order. The order is rare
shingles first, by a count sketch of fixed size over all documents, so that shingles
of frequent lines come last.

1. Documents with equal sets are one node. Nodes with equal prefix and size are one
   group, and groups, not documents, enter the join on prefix shingles.
2. Each group is first compared with a group of about its size that shares one of its
   shingles, and members with the first of their group. The shingle stands as early there
   as in any: of near copies that is the one with the fewest shingles of its own, which
   most others are similar to. These few pairs join most near copies into components.
3. Then shingles are joined by component: two components that share a shingle and
   could have similar sizes yield the pairs of groups between them that pass the size
   and position filters, these are expanded to members, and all such pairs are verified.
   Pairs within a component need no look, as they cannot change it. No link between
   components is lost, and a large group of near copies never meets itself pair by pair.

A pair needs a look only at the first shingle that its sets share: all that they share
comes after it, so what is left of a set there bounds the size of the other (``_reach``).
Copies too far from each other meet only behind that bound and yield no row.

Before texts are fetched, pairs are screened by parity bitmaps of the sets: the bits in
which two bitmaps differ are no more than the shingles in which the sets differ. Sets
are then compared exactly, as sorted arrays of 64-bit shingle hashes.

Defined results: a null or empty text has no shingles and is alone; a text of fewer
words than a shingle is one shingle; rows that repeat a doc_id are nodes of their own
and share its id; a null doc_id is larger than any other and null where it is alone;
an empty table gives no rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch.llm import windows as win
from shelfwatch.llm.bitmap import bitmap_of, may_contain
from shelfwatch.llm.common import narrowed, staged, text_of, text_pieces
from shelfwatch.llm.components import components

@dataclass(frozen=True)
class Ratio:
    """A similarity as a fraction; 0 < numerator < denominator."""

    numerator: int
    denominator: int


# What op9 takes, and what callers without a contract of their own take.
SHINGLE, SIMILARITY = 3, Ratio(90, 100)
COMMON_SHINGLE, COMMON_SIMILARITY = 5, Ratio(80, 100)
CELLS = 1 << 22  # of the sketch: 16 MB, whatever the data
STRIPES = 64  # the sketch is summed in so many parts
MOST_BITS = 1 << 15  # of a parity bitmap
_LAST = (1 << 63) - 1  # stands for a null doc_id
_U = np.uint64


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().lower().split()  # ASCII letters and white space only
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    words = word_hashes(text)
    if len(words) == 0:
        return words
    return np.unique(win.Spans(words).grams(min(size, len(words))) + _U(min(size, len(words))))


def signature(found: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(found.tobytes())


def needed(n: int, t: Ratio = SIMILARITY) -> int:
    """The least overlap that a set of ``n`` needs to link with anything."""
    return -(-t.numerator * n // t.denominator)


def linked(a: np.ndarray, b: np.ndarray, t: Ratio = SIMILARITY) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * t.denominator < t.numerator * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return t.denominator * both >= t.numerator * (len(a) + len(b) - both)


def parity(found: np.ndarray) -> bytes:
    """A bit per residue of the hashes: set where an odd number of shingles falls.

    Twice as many bits as shingles, rounded up to a power of two.
    """
    bits = min(MOST_BITS, max(8, 1 << (2 * len(found) - 1).bit_length()))
    odd = np.bincount((found & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def may_link(a: bytes, b: bytes, n_a: int, n_b: int, t: Ratio = SIMILARITY) -> bool:
    """False is certain: linked sets differ in at most (1 - t) / (1 + t) of their sizes' sum."""
    most = (t.denominator - t.numerator) * (n_a + n_b) // (t.denominator + t.numerator)
    return differing(a, b) <= most


# --- sets and their sketch ------------------------------------------------------------


def _cells(found: np.ndarray) -> np.ndarray:
    return (found >> _U(42)).astype(np.int64)


def _described(size: int):
    """One row per document, and the sketch of the task in stripes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros(CELLS, np.int32), ["doc", "content", "sig", "n", "bits", "stripe", "cells"]
        for batch in text_pieces(batches, "text"):
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            if sets:
                cells, counts = np.unique(_cells(np.concatenate(sets)), return_counts=True)
                total[cells] += counts.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("content"), pa.array([signature(s) for s in sets], pa.string()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()),
                 pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
        if total.any():
            # a task's counts are small; the few that are not are told apart by a second byte
            for stripe, part in enumerate(total.reshape(STRIPES, -1)):
                empty = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())]
                low = np.minimum(part, 65535).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
                yield pa.RecordBatch.from_arrays([*empty, pa.array([stripe], pa.int32()), pa.array([low], pa.binary())], names=names)

    return rows


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CELLS // STRIPES, np.int64)
    for raw in group["cells"]:
        total += np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(2, -1).T).view("<u2").reshape(-1)
    cells = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
    return pd.DataFrame({"stripe": group["stripe"].iloc[:1].to_list(), "cells": [cells.tobytes()]})


def sketch_of(described: DataFrame) -> np.ndarray:
    """How many documents have a shingle of each cell; at most STRIPES rows reach the driver.

    A task's counts saturate at 65,535, which only the order of very frequent shingles feels.
    """
    rows = described.filter("stripe IS NOT NULL").select("stripe", "cells")
    summed = rows.groupBy("stripe").applyInPandas(_summed, "stripe int, cells binary").collect()
    sketch = np.zeros((STRIPES, CELLS // STRIPES), np.int32)
    for row in summed:
        sketch[row["stripe"]] = np.frombuffer(row["cells"], np.int32)
    return sketch.reshape(-1)


# --- prefixes and groups ----------------------------------------------------------------


def _prefixes(size: int, t: Ratio, sketch):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in text_pieces(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                found = shingles(text, size)
                if len(found):
                    order = np.lexsort((found, counts[_cells(found)]))
                    prefix = found[order[: len(found) - needed(len(found), t) + 1]]
                    out.append((signature(found), len(found), prefix.view(np.int64), signature(prefix)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.string())],
                names=["sig", "n", "prefix", "prefix_sig"])

    return rows


def groups_of(docs: DataFrame, size: int, t: Ratio, sketch: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(sig, n, gid, head) of every node, and (token, at, gid, n) of the prefix shingles that several groups share.

    ``head`` is the smallest signature of the nodes with the same prefix and size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # 16 MB
    found = docs.mapInArrow(_prefixes(size, t, shared), "sig string, n long, prefix array<long>, prefix_sig string")
    found = staged(found, "prefixes")
    groups = found.groupBy("prefix_sig", "n").agg(F.min("sig").alias("head"), F.first("prefix").alias("prefix"))
    groups = staged(groups.withColumn("gid", F.xxhash64("prefix_sig", "n")), "groups")
    nodes = found.select("sig", "n", "prefix_sig").distinct()
    members = nodes.join(groups.select("prefix_sig", "n", "gid", "head"), ["prefix_sig", "n"]).select("sig", "n", "gid", "head")
    tokens = groups.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token"))
    several = tokens.groupBy("token").agg(F.min("gid").alias("low"), F.max("gid").alias("high")).filter("low < high")
    return staged(members, "members"), staged(tokens.join(staged(several.select("token"), "shared"), "token"), "shared-tokens")


# --- verification -----------------------------------------------------------------------


def _texts_verified(size: int, t: Ratio):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, "text_a", "text_b"):
            held: dict[str, np.ndarray] = {}  # sets that have their signature only
            good = []
            for a, b, x, y in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "text_a", "text_b"))):
                for sig, text in ((a, x), (b, y)):
                    if sig not in held and signature(found := shingles(text, size)) == sig:
                        held[sig] = found
                good.append(a in held and b in held and linked(held[a], held[b], t))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows


def _screened(t: Ratio):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [may_link(*x, t) for x in zip(*(batch.column(n).to_pylist() for n in ("bits_a", "bits_b", "n_a", "n_b")))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, t: Ratio) -> DataFrame:
    """The pairs (a, b) of signatures whose sets are similar enough.

    ``nodes`` has (sig, row, n, bits) of one document for each set, its ``row`` a struct of
    doc and content. Only documents of pairs that pass the bitmaps are read again.
    """
    pairs = staged(pairs.filter("a <> b").distinct(), "pairs")

    def with_node(rows: DataFrame, x: str) -> DataFrame:
        return rows.join(nodes.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)

    near = with_node(with_node(pairs, "b"), "a").filter(_similar_sizes("n_a", "n_b", t))
    near = staged(near.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_screened(t), "a string, b string"), "near")
    wanted = near.select(F.col("a").alias("sig")).unionByName(near.select(F.col("b").alias("sig"))).distinct()
    wanted = staged(wanted.join(nodes, "sig").select("sig", "row.doc", "row.content"), "wanted")
    named = bitmap_of(wanted.select(F.xxhash64("doc", "content").alias("key")), "key")
    texts = docs.filter(may_contain(named, F.xxhash64("doc", "content"))).join(wanted, ["doc", "content"])
    # Equal rows give their text once.
    texts = staged(texts.groupBy("doc", "content", "sig").agg(F.first("text").alias("text")).select("sig", "text"), "texts")
    both = near.join(texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a")), "a")
    return staged(both.select("a", "b", "text_a", "text_b").mapInArrow(_texts_verified(size, t), "a string, b string"), "links")


# --- the join -----------------------------------------------------------------------------


def _similar_sizes(x: str, y: str, t: Ratio) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return (F.col(x) * t.denominator >= F.col(y) * t.numerator) & (F.col(y) * t.denominator >= F.col(x) * t.numerator)


def _reach(t: Ratio) -> Column:
    """The largest set that can link with one whose first shared shingle stands at ``at``.

    Linked sets share at least t / (1 + t) of their sizes' sum, and here n - at at most.
    """
    return F.floor((F.col("n") - F.col("at")) * (t.denominator + t.numerator) / t.numerator).cast("long") - F.col("n")


def first_pairs(members: DataFrame, tokens: DataFrame, t: Ratio) -> DataFrame:
    """One pair for each group, with a group that it shares a shingle with, and one for each member."""
    level = F.floor(F.log(F.col("n")) / F.log(F.lit(t.denominator / t.numerator))).cast("int")
    rows = tokens.select("token", "gid", "at", level.alias("level"))
    hubs = staged(rows.groupBy("token", "level").agg(F.min(F.struct("at", "gid")).alias("hub")), "hubs")
    pairs = rows.select("token", "gid", "level").join(hubs, ["token", "level"]).filter("hub.gid <> gid")
    pairs = pairs.groupBy("gid").agg(F.min("hub").alias("hub")).select("gid", F.col("hub.gid").alias("hub"))
    heads = staged(members.filter("sig = head").select("gid", "head"), "heads")
    pairs = pairs.join(heads.select("gid", F.col("head").alias("b")), "gid").join(
        heads.select(F.col("gid").alias("hub"), F.col("head").alias("a")), "hub"
    )
    return pairs.select("a", "b").unionByName(
        members.filter("sig <> head").select(F.col("head").alias("a"), F.col("sig").alias("b"))
    )


def rest_pairs(members: DataFrame, tokens: DataFrame, comps: DataFrame, t: Ratio) -> DataFrame:
    """Pairs of nodes of different components whose groups share a shingle and have similar sizes."""
    comp = F.xxhash64(F.coalesce("component", "sig")).alias("comp")
    placed = staged(members.join(comps, F.col("sig") == F.col("node"), "left").select("sig", "n", "gid", comp), "placed")
    held = staged(placed.select("gid", "comp").distinct(), "group-components")
    rows = staged(tokens.join(held, "gid").withColumn("reach", _reach(t)).drop("at"), "token-components")
    # Components that meet in a shingle, before any of their groups are paired.
    spans = rows.groupBy("token", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"))
    several = spans.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    spans = staged(spans.join(several.select("token"), "token", "left_semi"), "spans")

    def renamed(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("token", *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "token"])

    meet = renamed(spans, "a").join(renamed(spans, "b"), "token").filter("comp_a < comp_b").filter(
        (F.col("most_a") * t.denominator >= F.col("least_b") * t.numerator) & (F.col("most_b") * t.denominator >= F.col("least_a") * t.numerator)
    )
    meet = staged(meet.filter("reach_a >= least_b AND reach_b >= least_a").select("token", "comp_a", "comp_b", "least_b", "reach_b"), "meetings")
    groups = meet.withColumnsRenamed({"least_b": "least", "reach_b": "most"}).join(renamed(rows, "a"), ["token", "comp_a"])
    groups = groups.filter("n_a <= most AND reach_a >= least").join(renamed(rows, "b"), ["token", "comp_b"])
    groups = groups.filter(_similar_sizes("n_a", "n_b", t) & F.expr("reach_a >= n_b AND reach_b >= n_a"))
    groups = groups.select("gid_a", "comp_a", "gid_b", "comp_b").distinct()
    # Members of one group that are still apart share its whole prefix.
    apart = held.select("gid", F.col("comp").alias("comp_a")).join(held.select("gid", F.col("comp").alias("comp_b")), "gid")
    apart = apart.filter("comp_a < comp_b").select(F.col("gid").alias("gid_a"), "comp_a", F.col("gid").alias("gid_b"), "comp_b")
    groups = staged(groups.unionByName(apart), "group-pairs")

    def member(x: str) -> DataFrame:
        return placed.select(F.col("gid").alias(f"gid_{x}"), F.col("comp").alias(f"comp_{x}"), F.col("sig").alias(x))

    return groups.join(member("a"), ["gid_a", "comp_a"]).join(member("b"), ["gid_b", "comp_b"]).select("a", "b")


def similar_documents(docs: DataFrame, size: int = SHINGLE, t: Ratio = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links."""
    rows = narrowed(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), text_of().alias("text"))
    rows = rows.withColumn("content", F.xxhash64("text"))
    described = rows.mapInArrow(_described(size), "doc long, content long, sig string, n long, bits binary, stripe int, cells binary")
    described = staged(described, "described")
    each = described.filter("stripe IS NULL").select("doc", "sig", "n")
    nodes = described.filter("n > 0").groupBy("sig").agg(F.min(F.struct("doc", "content")).alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = staged(nodes, "nodes")
    members, tokens = groups_of(rows, size, t, sketch_of(described))
    links = verify(first_pairs(members, tokens, t), rows, nodes, size, t)
    more = verify(rest_pairs(members, tokens, components(links), t), rows, nodes, size, t)
    comps = components(links.unionByName(more))
    placed = nodes.join(comps, F.col("sig") == F.col("node"), "left").select("sig", "row.doc", F.coalesce("component", "sig").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("doc").alias("component"))
    placed = staged(placed.join(staged(least, "least"), "comp").select("sig", "component"), "components")
    out = each.join(placed, "sig", "left")
    back = lambda c: F.when(c != _LAST, c)
    alone = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.select(back(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), back(alone).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, t: Ratio = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; a null doc_id stays."""
    gone = similar_documents(docs, size, t).filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(staged(gone, "near-copies"), "doc_id", "left_anti").select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
