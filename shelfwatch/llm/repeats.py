"""Which windows of a document also start in a document with a smaller doc_id.

The steps that substring dedup over words and over bytes share. A window is ``WINDOW``
units; how equal windows among the remaining candidates are found is the operator's own
part (suffix trees, prefix doubling) and comes in as ``earliest_of``.

1. Documents are cut into chunks where the content says so. A chunk and the units that
   its windows cover are one key; of equal chunks only the one in the smallest doc_id
   goes on, in the others every window is a repeat. Copies and near copies shrink to
   one instance here, however many there are.
2. In the chunks that go on, windows are gathered into runs with a common anchor.
   Anchors are dealt out by hash as packed arrays, an anchor of several documents of
   one block also by document; runs whose anchor, with the units before or after it,
   occurs in one document only are done. The others go back to their block, which
   knows their documents.
3. Of runs with equal content one goes on, with the smallest doc_id of its content;
   its units are fetched, and the smallest doc_id of each of its windows is found.
4. Windows whose smallest doc_id is smaller than their own are repeats.

Documents are told apart by doc_id and a hash of the text, so rows that repeat a doc_id
stay apart; they have no smaller doc_id than each other. A null doc_id is larger than
any other.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from shelfwatch.llm import windows as win
from shelfwatch.llm.bitmap import bitmap_of, may_contain
from shelfwatch.llm.common import narrowed, shuffle_partitions, staged, text_of, text_pieces
from shelfwatch.staging import only_last

Units = Callable[[str], np.ndarray]  # the units of a text: bytes, or hashes of words
_LAST = (1 << 63) - 1  # stands for a null doc_id
_U = np.uint64


def identified(docs: DataFrame) -> DataFrame:
    """(doc, rid, text): the doc_id without nulls, a hash of the text, the text without nulls."""
    rows = narrowed(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), text_of().alias("text"))
    return rows.withColumn("rid", F.hash("text").cast("long"))


def doc_id() -> Column:
    return F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id")


# --- 1. equal chunks ----------------------------------------------------------------


def _chunk_rows(units: Units, mean: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rid = batch.column("doc").to_numpy(), batch.column("rid").to_numpy()
            found = (p for i, t in enumerate(batch.column("text").to_pylist()) for p in win.pieces(i, units(t)))
            for runs in win.chunks(found, mean, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[runs.row]), pa.array(rid[runs.row]), pa.array(runs.first.astype(np.int64)),
                     pa.array(runs.count.astype(np.int64)), pa.array(runs.content.view(np.int64))],
                    names=["doc", "rid", "first", "n", "content"],
                )

    return rows


@only_last
def repeated_chunks(docs: DataFrame, units: Units, mean: int, gram: int) -> DataFrame:
    """(doc, rid, first, n) of the chunks that also occur in a smaller document."""
    rows = docs.mapInArrow(_chunk_rows(units, mean, gram), "doc long, rid long, first long, n long, content long")
    rows = staged(rows, "chunks")
    earliest = rows.groupBy("content", "n").agg(F.min("doc").alias("earliest"), F.max("doc").alias("latest"))
    earliest = staged(earliest.filter("earliest < latest").drop("latest"), "chunk-classes")
    return staged(rows.join(earliest, ["content", "n"]).filter("earliest < doc").select("doc", "rid", "first", "n"), "repeated-chunks")


def by_document(ranges: DataFrame) -> DataFrame:
    """All ranges of a document in one row; no more than the document has windows."""
    return ranges.groupBy("doc", "rid").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))


def _ranges(column: pa.Array) -> list[list[tuple[int, int]]]:
    return [[(r["first"], r["n"]) for r in row or ()] for row in column.to_pylist()]


# --- 2. runs with a common anchor ------------------------------------------------------

# A dealt run is 14 bytes and, for its place, a step of 2 bytes from the one before it in the
# same bucket, however many buckets there are; documents are listed once a block, not in
# each bucket.
_RUN = np.dtype([("key", "u1", 5), ("content", "u1", 6), ("left", "u1"), ("right", "u1"), ("mark", "u1")])
_KEPT = np.dtype([("key", "u1", 5), ("content", "u1", 6), ("mark", "u1"), ("at", "<u4")])
_DOC = np.dtype([("doc", "<i8"), ("rid", "<i4"), ("begin", "<u4")])
_KNOWN = 0x80  # in ``mark``, beside the number of window starts
_FAR = 0xFFFF  # a step that does not fit, which stands apart in 4 bytes
BLOCK_RUNS = 1 << 18  # that are dealt out together
_PIECE_BYTES = 1 << 19  # of text whose runs are found together
_BLOCK_BYTES = 1 << 30  # of their texts, so that a place fits 4 bytes
_PACKED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in ("runs", "steps", "far", "docs"))])
_PACKED_DDL = "bucket long, block long, runs binary, steps binary, far binary, docs binary"


def _narrow(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest bytes of 64-bit numbers."""
    return values.astype("<u8").view("u1").reshape(-1, 8)[:, :width]


def _wide(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), "u1")
    out[:, : raw.shape[1]] = raw
    return out.reshape(-1).view("<u8")


def _cut(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """One binary value for what lies between two edges."""
    offsets = (edges * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.view("u1"))])


def _steps(at: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, far, far in each stretch) of places that ascend in the stretches beginning at ``begin``."""
    step = np.diff(at, prepend=0)
    step[begin] = at[begin]
    far = step >= _FAR
    return np.minimum(step, _FAR).astype("<u2"), step[far].astype("<u4"), np.add.reduceat(far, begin, dtype=np.int64)


def _places(steps: np.ndarray, far: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    step = steps.astype(np.int64)
    step[step == _FAR] = far
    ends = np.cumsum(step)
    return ends - np.repeat(ends[begin] - step[begin], sizes)


def _sides(key: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40 bits of the anchor with 8 of the stretch on either side."""
    return key << _U(8) | left, key << _U(8) | right


def _shared(key: np.ndarray, owner: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether an entry's key has several owners or a ``known`` entry, and whether the entry is its key's first."""
    order = np.argsort(key)
    sorted_, own = key[order], owner[order]
    begin = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    hit = np.zeros(len(key), bool) if known is None else known[order]
    hit[1:] |= ~begin[1:] & (own[1:] != own[:-1])
    heads = np.flatnonzero(begin)
    several, first = np.zeros(len(key), bool), np.zeros(len(key), bool)
    several[order] = np.repeat(np.logical_or.reduceat(hit, heads), np.diff(np.append(heads, len(key))))
    first[order] = begin
    return several, first


def _narrowed(runs: win.Runs, doc: np.ndarray, rid: np.ndarray, n_rows: int) -> tuple[np.ndarray, ...]:
    """(row, first, doc, rid, key, dealt run) of runs that wait for the rest of their block."""
    out = np.zeros(len(runs.row), _RUN)
    out["key"], out["content"] = _narrow(runs.key >> _U(24), 5), _narrow(runs.content >> _U(16), 6)
    out["left"], out["right"], out["mark"] = runs.left >> _U(56), runs.right >> _U(56), runs.count
    return runs.row + n_rows, runs.first.astype("<u4"), doc[runs.row], rid[runs.row].astype("<i4"), runs.key, out


def _block(held: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's runs by bucket, and a row of its documents; ``held`` as from ``_narrowed``.

    A run's place is its first start in its document after the stretches of the documents
    before it. Blocks are named by a hash of all they hold, so a task that runs again gives
    the same names, and two blocks of one name are the same.
    """
    row, first, own, rid, key, runs = (np.concatenate(x) for x in zip(*held))
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    length = first[np.append(head[1:], len(row)) - 1].astype(np.int64) + 1
    docs = np.zeros(len(head), _DOC)
    docs["doc"], docs["rid"], docs["begin"] = own[head], rid[head], np.cumsum(length) - length
    at = first + np.repeat(docs["begin"].astype(np.int64), np.diff(np.append(head, len(row))))
    (left, first_left), (right, first_right) = (
        _shared(side, own) for side in _sides(key >> _U(24), runs["left"].astype(_U), runs["right"].astype(_U))
    )
    known = left | right
    runs["mark"] |= known * np.uint8(_KNOWN)
    spread = known & ~first_left & ~first_right
    by = np.where(spread, key ^ win.mixed(own.view(_U)), key)
    bucket = ((by >> _U(8)) % _U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order].astype(np.int64)) != 0]))
    runs, (steps, far, n_far) = runs[order], _steps(at[order], begin)
    name = xxhash.xxh3_64(docs.tobytes())
    for part in (runs, steps, far):
        name.update(part.tobytes())
    block = np.int64(np.uint64(name.intdigest()).view(np.int64))
    edges = np.append(begin, len(row))
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[order[begin]].astype(np.int64)), pa.array(np.full(len(begin), block)), _cut(runs, edges),
         _cut(steps, edges), _cut(far, np.concatenate([[0], np.cumsum(n_far)])), pa.nulls(len(begin), pa.binary())],
        schema=_PACKED,
    )
    yield pa.RecordBatch.from_pylist([{"bucket": int(block) % buckets, "block": int(block), "docs": docs.tobytes()}], schema=_PACKED)


def _anchor_rows(units: Units, gram: int, buckets: int, block_runs: int = BLOCK_RUNS):
    """Packed runs by bucket, block after block. An anchor that several documents of a block
    share, with the stretch on one side, is known to repeat; of these the first stay with the
    bucket of the anchor's hash, and the others are spread by document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_runs, n_bytes, n_rows = [], 0, 0, 0
        for batch in text_pieces(batches, "text", most=_PIECE_BYTES):
            doc, rid = batch.column("doc").to_numpy(), batch.column("rid").to_numpy()
            skip = _ranges(batch.column("ranges"))
            found = (p for i, t in enumerate(batch.column("text").to_pylist()) for p in win.pieces(i, units(t), skip[i]))
            for runs in win.anchors(found, gram):
                held.append(_narrowed(runs, doc, rid, n_rows))
                n_runs += len(runs.row)
                if n_runs >= block_runs:
                    yield from _block(held, buckets)
                    held, n_runs, n_bytes = [], 0, 0
            n_rows += batch.num_rows
            n_bytes += pc.sum(pc.binary_length(batch.column("text"))).as_py()
            if held and n_bytes >= _BLOCK_BYTES:
                yield from _block(held, buckets)
                held, n_runs, n_bytes = [], 0, 0
        if held:
            yield from _block(held, buckets)

    return rows


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    """Runs of a bucket whose key occurs in several documents, by block; rows of documents go on as they are."""
    out = [(block, None, docs) for block, docs in zip(group["block"], group["docs"]) if docs is not None]
    group = group[group["runs"].notna()]
    if len(group):
        runs = np.frombuffer(b"".join(group["runs"]), _RUN)
        steps, far = np.frombuffer(b"".join(group["steps"]), "<u2"), np.frombuffer(b"".join(group["far"]), "<u4")
        sizes = np.array([len(x) for x in group["runs"]]) // _RUN.itemsize
        begin = np.cumsum(sizes) - sizes
        known, block = runs["mark"] >= _KNOWN, np.repeat(group["block"].to_numpy(), sizes)
        # what a block knew to be shared makes its equals elsewhere shared too
        sides = _sides(_wide(runs["key"]), runs["left"].astype(_U), runs["right"].astype(_U))
        kept = known | _shared(sides[0], block, known)[0] | _shared(sides[1], block, known)[0]
        found = np.zeros(kept.sum(), _KEPT)
        for name in ("key", "content"):
            found[name] = runs[name][kept]
        found["mark"] = runs["mark"][kept] & (_KNOWN - 1)
        found["at"] = _places(steps, far, begin, sizes)[kept]
        ends = np.cumsum(np.add.reduceat(kept, begin, dtype=np.int64))
        out += [(b, found[i:j].tobytes(), None) for b, i, j in zip(group["block"], [0, *ends[:-1]], ends) if i < j]
    return pd.DataFrame(out, columns=["block", "runs", "docs"])


def _located(group: pd.DataFrame) -> pd.DataFrame:
    """A block's runs with their documents, in the order of their places."""
    docs = np.frombuffer(next(x for x in group["docs"] if x is not None), _DOC)
    runs = np.frombuffer(b"".join(x for x in group["runs"] if x is not None), _KEPT)
    runs = runs[np.argsort(runs["at"])]
    own = docs[np.searchsorted(docs["begin"], runs["at"], side="right") - 1]
    return pd.DataFrame({
        "key": _wide(runs["key"]).view(np.int64), "content": _wide(runs["content"]).view(np.int64),
        "doc": own["doc"], "rid": own["rid"].astype(np.int64),
        "first": runs["at"].astype(np.int64) - own["begin"], "n": runs["mark"].astype(np.int64),
    })


@only_last
def candidate_runs(docs: DataFrame, repeated: DataFrame, units: Units, gram: int) -> DataFrame:
    """(key, content, doc, rid, first, n): runs outside repeated chunks whose anchor others have too."""
    buckets = shuffle_partitions(docs.sparkSession)
    # Only documents that may have repeated chunks travel to these.
    touched, clean = parted(docs, repeated)
    touched = touched.join(by_document(repeated), ["doc", "rid"], "left").select("doc", "rid", "text", "ranges")
    rows = touched.unionByName(clean.select("doc", "rid", "text", F.lit(None).cast(touched.schema["ranges"].dataType).alias("ranges")))
    packed = rows.mapInArrow(_anchor_rows(units, gram, buckets, BLOCK_RUNS), _PACKED_DDL)
    # staged, so that the packed runs are gone when documents are put to what is left of them
    found = staged(packed.groupBy("bucket").applyInPandas(_repeated, "block long, runs binary, docs binary"), "repeated-runs")
    found = found.groupBy("block").applyInPandas(_located, "key long, content long, doc long, rid long, first long, n long")
    return staged(found, "candidates")


# --- 3. contents of the candidates ---------------------------------------------------


def _contents(units: Units):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column("text"), batch.column("wanted")
            for begin, end in _pieces_of(texts):
                part = wanted.slice(begin, end - begin)
                whole = [units(t) for t in texts.slice(begin, end - begin).to_pylist()]
                found, per_doc = part.flatten(), np.diff(part.offsets.to_numpy())
                if not len(found):
                    continue
                column = lambda n: found.field(n).to_numpy(zero_copy_only=False)
                data = np.concatenate(whole)
                size = np.array([len(w) for w in whole])
                first = np.repeat(np.cumsum(size) - size, per_doc) + column("first")
                length = column("n") + win.WINDOW - 1
                ends = np.cumsum(length)
                at = np.arange(ends[-1]) + np.repeat(first - (ends - length), length)
                offsets = np.concatenate([[0], ends * data.itemsize]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [found.field("key"), found.field("content"), found.field("shared"), found.field("many"),
                     pa.array(np.repeat(batch.column("doc").to_numpy()[begin:end], per_doc)),
                     pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])],
                    names=["key", "content", "shared", "many", "doc", "units"],
                )

    return rows


def _pieces_of(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some megabytes together."""
    size = np.asarray(pc.binary_length(texts))
    begin = 0
    for cut in np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1:
        yield begin, int(cut)
        begin = int(cut)
    yield begin, len(texts)


def parted(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that may be among ``wanted`` (doc, rid), and those that surely are not."""
    named = wanted.select(F.xxhash64("doc", "rid").alias("key"))
    maybe = may_contain(bitmap_of(named, "key"), F.xxhash64("doc", "rid"))
    return docs.filter(maybe), docs.filter(~maybe)


def distinct_contents(docs: DataFrame, runs: DataFrame, units: Units, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """One run per content, its smallest doc: (those to compare, those that stand alone).

    The first as (key, content, shared, many, doc, units); ``shared``: other runs have
    the content too, which else needs no row where its own doc is the smallest; ``many``: the key has more than
    ``group_limit`` contents, too many for one task. A window of a content whose key has no
    other is found in equal contents only, so its smallest doc is known, and the second are
    ``RESOLVED`` rows without a look at the text.
    """
    least = F.min(F.struct("doc", "rid", "first", "n")).alias("run")
    first = runs.groupBy("key", "content").agg(least, (F.count(F.lit(1)) > 1).alias("shared"))
    first = staged(first.select("key", "content", "shared", "run.*"), "contents")
    several = first.groupBy("key").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")
    several = staged(several, "several")
    maybe = may_contain(bitmap_of(several.select(F.xxhash64("key").alias("key")), "key"), F.xxhash64("key"))
    alone = first.filter(~maybe & F.col("shared")).select("key", "content", F.lit(0).cast("long").alias("at"), "n", F.col("doc").alias("earliest"))
    many = several.filter(F.col("contents") > group_limit).select("key", F.lit(True).alias("many"))
    first = first.filter(maybe).join(staged(many, "many"), "key", "left")
    wanted = first.groupBy("doc", "rid").agg(
        F.collect_list(F.struct("key", "content", "shared", "first", "n", F.coalesce("many", F.lit(False)).alias("many"))).alias("wanted")
    )
    wanted = staged(wanted, "wanted")
    rows = parted(docs, wanted)[0].join(wanted, ["doc", "rid"]).select("doc", "text", "wanted")
    rows = rows.mapInArrow(_contents(units), "key long, content long, shared boolean, many boolean, doc long, units binary")
    return staged(rows, "units"), alone


# --- the smallest document of each window ---------------------------------------------

RESOLVED = "key long, content long, at long, n long, earliest long"


def run_lengths(earliest: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, number, value) of the stretches of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], earliest[1:] != earliest[:-1]]))
    return list(zip(cut.tolist(), np.diff(np.append(cut, len(earliest))).tolist(), earliest[cut].tolist()))


def resolved_in_tasks(contents: DataFrame, earliest_of: Callable[[np.ndarray, list[np.ndarray], np.ndarray], np.ndarray],
                      dtype) -> DataFrame:
    """``RESOLVED`` rows from tasks that hold all contents of some anchors.

    ``earliest_of(keys, contents, docs)`` gives the smallest doc of each window start,
    content after content.
    """

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        data = [np.frombuffer(x, dtype) for x in group["units"]]
        earliest = earliest_of(group["key"].to_numpy(), data, group["doc"].to_numpy())
        ends = np.cumsum([len(d) - win.WINDOW + 1 for d in data])
        each = zip(group["key"], group["content"], group["shared"], group["doc"], np.split(earliest, ends[:-1]))
        rows = [(key, content, *run) for key, content, shared, doc, part in each for run in run_lengths(part)
                if shared or run[2] < doc]
        return pd.DataFrame(rows, columns=["key", "content", "at", "n", "earliest"])

    groups = 8 * shuffle_partitions(contents.sparkSession)
    return contents.groupBy(F.pmod("key", F.lit(groups)).alias("part")).applyInPandas(resolve, RESOLVED)


@only_last
def resolved(docs: DataFrame, runs: DataFrame, units: Units, dtype, group_limit: int, earliest_of: Callable,
             hot: Callable[[DataFrame, type], DataFrame]) -> DataFrame:
    """``RESOLVED`` rows of all contents among ``runs``."""
    contents, alone = distinct_contents(docs, runs, units, group_limit)
    known = resolved_in_tasks(contents.filter("NOT many"), earliest_of, dtype).unionByName(alone)
    return staged(known.unionByName(hot(contents.filter("many"), dtype)), "resolved")


@only_last
def repeated_windows(docs: DataFrame, units: Units, dtype, chunk: tuple[int, int], gram: int, group_limit: int,
                     earliest_of: Callable, hot: Callable[[DataFrame, type], DataFrame]) -> DataFrame:
    """(doc, rid, ranges): the window starts that are repeats, for documents that have any.

    ``docs`` as from ``identified``; ``earliest_of`` as in ``resolved_in_tasks``; ``hot``
    gives the ``RESOLVED`` rows of contents whose key has too many for one task.
    """
    chunks = repeated_chunks(docs, units, *chunk)
    runs = candidate_runs(docs, chunks, units, gram)
    known = resolved(docs, runs, units, dtype, group_limit, earliest_of, hot)
    found = runs.select("key", "content", "doc", "rid", "first").join(known, ["key", "content"]).filter("earliest < doc")
    found = found.select("doc", "rid", (F.col("first") + F.col("at")).alias("first"), "n")
    return staged(by_document(chunks.unionByName(found)), "repeats")
