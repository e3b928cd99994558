"""Near duplicates among embeddings of one label by an epsilon grid order join.

Unit vectors are turned to the principal directions of their scatter within labels. On
the leading ones they fall into grid cells as wide as EPSILON, the distance of two unit
vectors of cosine 0.93, and are sorted by label, cell after cell. Blocks of the sequence
have a bounding box on the leading directions; runs of FAN blocks have the box around
theirs, and so on up. The join starts with the whole sequence against itself and replaces
every pair of intervals by the pairs of their parts, skipping those whose boxes are
further apart than EPSILON: turning and leaving out directions never lengthens a
distance. Block pairs that are left are joined in tasks, which go on dividing them in the
same way down to a few vectors and then take cosines.

Equal vectors of a label are one node with a number of copies before anything is sorted.
A task returns per vector its number of links, and no more edges than a spanning forest
of what it linked, so large dense groups cost no table of pairs.

Vectors that are null, zero, empty or hold null or non-finite components, and all rows
with a null label, link with nothing and keep a row of their own. Vectors of different
lengths don't link. Rows may repeat: equal vectors link whatever their vec_id, and a
null vec_id is never smallest; a group without any vec_id has a null component_id. A row
is kept if its vec_id is its component_id, both null included.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch.llm.common import narrowed, shuffle_partitions, staged, table
from shelfwatch.llm.components import components
from shelfwatch.llm.vectors import common_dimension, is_finite, matrix, slices, summed

LEAST = 0.93
EPSILON = math.sqrt(2 - 2 * LEAST)
SLACK = 1e-9  # far above the rounding of coordinates and cosines
GRID = 4  # directions whose cells order the vectors
BOX = 16  # directions of the bounding boxes
BLOCK = 1024  # vectors of a block
FAN = 16  # intervals below one of the next level
LEAF = 64  # vectors that are compared without dividing further


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Rounded a few times only, for pairs at the threshold."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def directions(nodes: DataFrame, dimension: int) -> np.ndarray:
    """Orthonormal columns, the principal directions of the scatter within labels, at most BOX.

    Means are those of a label's vectors in a slice: that shifts the directions a little,
    which costs skipped blocks and never a result.
    """

    def scatter(batch: pa.RecordBatch) -> np.ndarray:
        unit = _unit(matrix(batch.column("vector")))
        _, group = np.unique(batch.column("label").to_numpy(zero_copy_only=False), return_inverse=True)
        means = np.zeros((group.max(initial=0) + 1, dimension))
        np.add.at(means, group, unit)
        means /= np.maximum(np.bincount(group, minlength=len(means)), 1)[:, None]
        centred = unit - means[group]
        return centred.T @ centred

    fitting = nodes.filter(F.size("vector") == dimension).select("label", "vector")
    _, found = np.linalg.eigh(summed(fitting, scatter, (dimension, dimension)))
    return found[:, ::-1][:, :BOX]


def _places(raw: np.ndarray, basis: np.ndarray) -> np.ndarray:
    if raw.shape[1] != len(basis):
        return np.zeros((len(raw), basis.shape[1]))  # other lengths are not pruned
    return _unit(raw) @ basis


def sequence(nodes: DataFrame, basis: np.ndarray) -> DataFrame:
    """(pos, label, vector, least, copies, place): the nodes in epsilon grid order.

    ``pos`` holds the number of the part of the sequence and the place in it.
    """
    width = basis.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            vectors = batch.column("vector")
            place = np.zeros((batch.num_rows, width))
            sizes = vectors.value_lengths().to_numpy()
            for size in np.unique(sizes):
                chosen = np.flatnonzero(sizes == size)
                place[chosen] = _places(matrix(vectors.take(pa.array(chosen))), basis)
            places = pa.FixedSizeListArray.from_arrays(pa.array(place.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, places], names=[*batch.schema.names, "place"])

    kinds = dict(nodes.dtypes)
    schema = f"label {kinds['label']}, vector {kinds['vector']}, least {kinds['least']}, copies long, place array<double>"
    rows = nodes.select("label", "vector", "least", "copies").mapInArrow(placed, schema)
    cells = [F.floor(F.col("place")[i] / EPSILON) for i in range(min(GRID, width))]
    order = ["label", F.size("vector"), *cells, F.col("place")[0], F.xxhash64("vector")]
    rows = rows.repartitionByRange(shuffle_partitions(nodes.sparkSession), *order).sortWithinPartitions(*order)
    return staged(rows.withColumn("pos", F.monotonically_increasing_id()), "grid-order")


def numbered_blocks(ordered: DataFrame) -> tuple[DataFrame, int]:
    """The sequence with the number of its block, and how many blocks there are.

    The driver sees one count per part of the sequence.
    """
    part, place = F.shiftright("pos", 33), F.col("pos").bitwiseAND((1 << 33) - 1)
    ends = ordered.groupBy(part.alias("part")).agg(F.max(place).alias("last")).collect()
    starts, blocks = [], 0
    for row in sorted(ends):
        starts.append((row.part, blocks))
        blocks += row.last // BLOCK + 1
    starts = staged(ordered.sparkSession.createDataFrame(starts, "part int, start long").coalesce(1), "block-starts")
    found = ordered.withColumn("part", part.cast("int")).join(starts, "part").drop("part")
    return found.withColumn("block", F.col("start") + (place / BLOCK).cast("long")).drop("start"), blocks


def _box(level: DataFrame, key: Column, low: str, high: str, width: int) -> DataFrame:
    """The boxes and label ranges around the rows of each key."""
    least = [F.min(F.col(low)[i]) for i in range(width)]
    most = [F.max(F.col(high)[i]) for i in range(width)]
    first, last = ("label", "label") if low == high else ("first", "last")
    return level.groupBy(key.alias("id")).agg(
        F.min(first).alias("first"), F.max(last).alias("last"), F.array(*least).alias("low"), F.array(*most).alias("high")
    )


def _are_near(a: str, b: str) -> Column:
    """Labels may be shared and the boxes are not further apart than EPSILON."""
    c = lambda side, name: F.col(f"{side}.{name}")
    gaps = F.zip_with(
        F.zip_with(c(a, "low"), c(b, "high"), lambda x, y: x - y),
        F.zip_with(c(b, "low"), c(a, "high"), lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    square = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    return (c(a, "first") <= c(b, "last")) & (c(b, "first") <= c(a, "last")) & (square <= (EPSILON + SLACK) ** 2)


def block_pairs(blocked: DataFrame, blocks: int, width: int) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks that may hold links, from the whole sequence downwards."""
    levels = [staged(_box(blocked, F.col("block"), "place", "place", width), "boxes")]
    while blocks > FAN:
        blocks = -(-blocks // FAN)
        levels.append(staged(_box(levels[-1], F.floor(F.col("id") / FAN), "low", "high", width), "boxes"))
    pairs = None
    for level in reversed(levels):
        level = level.withColumn("above", F.floor(F.col("id") / FAN))
        left = level.alias("x")
        if pairs is None:  # at most FAN intervals below the whole sequence
            both = left.join(level.alias("y"), (F.col("x.above") == F.col("y.above")) & (F.col("x.id") <= F.col("y.id")))
        else:
            both = pairs.join(left, F.col("a") == F.col("x.above")).join(
                level.alias("y"), (F.col("b") == F.col("y.above")) & (F.col("x.id") <= F.col("y.id"))
            )
        both = both.filter(_are_near("x", "y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        pairs = staged(both, "interval-pairs")
    return pairs


def _near(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays of the pairs whose rounded cosine reaches LEAST less SLACK, by dividing both intervals."""
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        p, q = px[a:b], py[c:d]
        gaps = np.maximum(np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)), 0)
        if (gaps * gaps).sum() > (EPSILON + SLACK) ** 2:
            continue
        if max(b - a, d - c) <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= LEAST - SLACK)
            i, j = i + a, j + c
            if same:
                below = i < j
                i, j = i[below], j[below]
            if len(i):
                yield i, j
        elif same and a == c:
            m = (a + b) // 2
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def _linked(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of ``n`` reaches by the links."""
    least = np.arange(n)
    while len(i):
        m = np.minimum(least[i], least[j])
        before = least.copy()
        np.minimum.at(least, i, m)
        np.minimum.at(least, j, m)
        least = np.minimum(least, least[least])
        if (before == least).all():
            break
    return least


def joined(pair: pa.Table, basis: np.ndarray) -> pa.Table:
    """Links per position and a spanning forest of the links of one pair of blocks."""
    pair = pair.sort_by("pos")
    block = pair.column("block").to_numpy()
    pos = pair.column("pos").to_numpy()
    copies = pair.column("copies").to_numpy()
    label = pair.column("label").combine_chunks()
    vectors = pair.column("vector").combine_chunks()
    sizes = vectors.value_lengths().to_numpy()
    code = label.dictionary_encode().indices.to_numpy()
    links, one, other = np.zeros(len(pos), dtype=np.int64), [], []
    first = pair.column("a")[0].as_py()
    alone = first == pair.column("b")[0].as_py()
    for c, size in {(int(c), int(s)) for c, s in zip(code, sizes)}:
        chosen = np.flatnonzero((code == c) & (sizes == size))
        raw = matrix(vectors.take(pa.array(chosen)))
        unit, place = _unit(raw), _places(raw, basis)
        left = np.ones(len(chosen), bool) if alone else block[chosen] == first
        right = left if alone else ~left
        if not (left.any() and right.any()):
            continue
        at_x, at_y = np.flatnonzero(left), np.flatnonzero(right)
        for i, j in _near(unit[at_x], unit[at_y], place[at_x], place[at_y], alone):
            i, j = at_x[i], at_y[j]
            value = np.einsum("ij,ij->i", unit[i], unit[j])
            sure = value >= LEAST + SLACK
            for k in np.flatnonzero(~sure):
                sure[k] = _cosine(raw[i[k]], raw[j[k]]) >= LEAST
            i, j = chosen[i[sure]], chosen[j[sure]]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            one.append(i)
            other.append(j)
    i, j = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (one, other))
    least = _linked(i, j, len(pos))
    touched = np.flatnonzero(links)
    return pa.table({"pos": pos[touched], "root": pos[least[touched]], "links": links[touched]})


def near_nodes(nodes: DataFrame) -> DataFrame:
    """(label, vector, n_links, component_id) for every node (label, vector, least, copies)."""
    dimension = common_dimension(nodes, "vector")
    if not dimension:  # there is no node
        return nodes.select("label", "vector", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    basis = directions(nodes, dimension)
    ordered = sequence(nodes, basis)
    blocked, blocks = numbered_blocks(ordered)
    pairs = block_pairs(blocked, blocks, basis.shape[1])
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    rows = blocked.select("block", "pos", "label", "vector", "copies").join(sides, "block")
    found = rows.groupBy("a", "b").applyInArrow(lambda pair: joined(pair, basis), "pos long, root long, links long")
    found = staged(found, "links")
    links = found.groupBy("pos").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("pos").alias("a"), F.col("root").alias("b")))
    member = ordered.join(links, "pos", "left").join(grouped, F.col("pos") == F.col("node"), "left")
    member = member.withColumn("root", F.coalesce("component", "pos"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return member.join(least, "root").select("label", "vector", n_links.alias("n_links"), "component_id")


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = narrowed(embeddings, "vec_id", "embedding", "label").withColumnRenamed("embedding", "vector")
    usable = F.col("label").isNotNull() & is_finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    compared, alone = rows.filter(usable), rows.filter(~usable)
    nodes = compared.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = staged(nodes, "nodes")
    found = compared.join(near_nodes(nodes), ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(r, other) AS (
  SELECT r, r FROM v UNION SELECT p.y, reach.other FROM reach JOIN p ON reach.r = p.x
), c AS (
  SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.other = v.r GROUP BY reach.r
), n AS (
  SELECT x AS r, count(*) AS n_links FROM p GROUP BY x
)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id,
       v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""
