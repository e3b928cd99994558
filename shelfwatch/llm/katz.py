"""Language-model scoring by a Katz backoff bigram model over words.

Good-Turing discounts take probability from counts up to ``DISCOUNTED``; what they leave
goes to words by their unigram probability, with a backoff weight per history that makes
every distribution sum to exactly 1 over the training words, the end and one unknown
word. Every bigram counts from ``STORED`` on, which is its first occurrence.

1. Words are counted (merged in each task, then by Spark): the unigram table.
2. Every token of every text is one entry (history, word, document). A pack of entries
   lists its words once and has short numbers for them and for its documents; it is cut
   by bucket. Entries are dealt once, by history; histories with more than a fourth of a
   bucket's even share are dealt by history and word.
3. Buckets count their training bigrams. What leaves them is how many bigrams occur how
   often, for the discounts, and the distinct words of the bucket, which a join gives
   their counts. No table of bigrams is written: buckets count them again where they
   need them.
4. A bucket has all bigrams of a history and weighs it itself; the few histories that are
   dealt by word too are weighed by an aggregation over the buckets' sums.
5. Each bucket evaluates its entries: the stored bigram, else the weight of the history
   and the unigram. The sums of a pack's documents come together again by pack.

The entries are shuffled once and read four times, so they are an RDD; everything else is
tables. Words are told apart by 56-bit hashes, documents by a 64-bit hash of
doc_id and text. Tasks hold the bigrams of one bucket and one pack of entries.

Defined results: a null or empty text is its end alone; a null doc_id counts as
training; rows that repeat a doc_id are scored one by one; without training documents
all probability is the unknown word's (score 0); an empty table gives no rows.
"""

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwatch.llm.common import narrowed, shuffle_partitions, staged, text_of
from shelfwatch.llm.windows import mixed

STORED = 1  # least count of a bigram in the table
DISCOUNTED = 5  # largest count that is discounted
START, END = 1, 2
PACK_WORDS = 1_000_000  # entries packed at once
PACK_BIGRAMS = 2_000_000  # bigrams a bucket gathers before it adds up equal ones
KNOWN_WORDS = 100_000  # words whose hash a task remembers
_U = np.uint64


class Hashes(dict):
    """56-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word) >> 8
        return found

    def of(self, text: str) -> list[int]:
        """Hashes of the words of a text, A-Z lower-cased."""
        return [self[w] for w in text.encode().lower().split()]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, held_out, text) of every row."""
    rows = narrowed(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), held_out(F.col("doc_id")).alias("held_out"), "text")


# --- 1. unigrams ------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        words = np.array([w for t in texts for w in hashes.of(t)] + [END] * len(texts), _U)
        found, counts = np.unique(words, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(counts)], names=["word", "n"])


def unigrams(rows: DataFrame) -> DataFrame:
    """(word, n) over the training documents."""
    found = rows.filter("NOT held_out").select("text").mapInArrow(_counted, "word long, n long")
    return staged(found.groupBy("word").agg(F.sum("n").alias("n")), "unigrams")


# --- 2. entries ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Deal:
    """Which bucket an entry goes to."""

    buckets: int
    hot: np.ndarray  # sorted histories that are dealt by word too

    def bucket(self, route: np.ndarray) -> np.ndarray:
        return ((route >> _U(24)) * _U(self.buckets) >> _U(32)).astype(np.int64)

    def route(self, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, history), len(self.hot) - 1)
        hot = self.hot[at] == history
        out = history.copy()
        out[hot] = _spread(history[hot], word[hot])
        return out


def _spread(history, word) -> np.ndarray:
    return mixed(history ^ (word * _U(0x9E3779B97F4A7C15))) >> _U(8)


def _narrow(x: np.ndarray) -> np.ndarray:
    """56-bit numbers in 7 bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :7])


def _widen(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), "u1")
    out[:, :7] = x
    return out.reshape(-1).view("<u8")


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as they need."""
    return x.astype(np.min_scalar_type(x.max(initial=0)))


def _squeezed(x: np.ndarray) -> tuple[str, int, bytes]:
    """Numbers from 0 on, compressed byte by byte: all lowest bytes first."""
    x = _small(x)
    places = np.ascontiguousarray(x.view("u1").reshape(len(x), x.itemsize).T)
    return x.dtype.str, len(x), pa.compress(places.tobytes(), codec="zstd", asbytes=True)


def _restored(kind: str, n: int, raw: bytes) -> np.ndarray:
    places = pa.decompress(raw, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(places, "u1").reshape(-1, n).T).view(kind).reshape(n)


def _begins(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    changed = np.zeros(max(0, len(sorted_by[0]) - 1), bool)
    for x in sorted_by:
        changed |= x[1:] != x[:-1]
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_by[0])), bool), changed]))


@dataclass(frozen=True)
class Pack:
    """Entries of some documents in one bucket, sorted by history and word.

    Histories and words are numbers in ``names``. Of a pack's parts, that of its first
    bucket has the documents' keys and numbers of tokens.
    """

    id: tuple[int, int]
    documents: tuple | None
    train: np.ndarray  # of the pack's documents
    names: np.ndarray  # sorted hashes
    heads: np.ndarray  # each history once
    per_head: np.ndarray  # bigrams of a history
    words: np.ndarray  # of each bigram
    per_pair: np.ndarray  # entries of a bigram
    owner: np.ndarray  # document of each entry

    def dumped(self) -> bytes:
        return pickle.dumps((
            self.id, self.documents, np.packbits(self.train), len(self.train), _squeezed(np.diff(self.names, prepend=_U(0))),
            *map(_squeezed, (self.heads, self.per_head, self.words, self.per_pair, self.owner))), protocol=5)

    @classmethod
    def loaded(cls, dumped: tuple) -> "Pack":
        i, documents, train, n, names, *rest = dumped
        names = np.cumsum(_restored(*names), dtype=_U)
        return cls(i, documents, np.unpackbits(train, count=n).astype(bool), names, *(_restored(*x).astype(np.int64) for x in rest))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(history, word, n), n over the training documents."""
        n = np.add.reduceat(self.train[self.owner].astype(np.int64), np.cumsum(self.per_pair) - self.per_pair)
        return np.repeat(self.names[self.heads], self.per_head), self.names[self.words], n


def _packed(pack_id, keys, train, line, lengths, deal: Deal) -> Iterator[tuple[int, bytes]]:
    """The parts of a pack; ``line`` has START, the words and END of each document."""
    names, number = np.unique(line, return_inverse=True)
    number = number.astype(np.int32)
    inner = line[:-1] != _U(END)
    history, word = number[:-1][inner], number[1:][inner]
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), lengths - 1)
    bucket = deal.bucket(deal.route(names[history], names[word])).astype(np.min_scalar_type(deal.buckets))
    order = np.lexsort((history.astype(np.int64) * len(names) + word, bucket))
    history, word, owner, bucket = history[order], word[order], owner[order], bucket[order]
    documents = (keys, _small(lengths - 1))
    edges = _begins(bucket)
    for a, b in zip(edges, [*edges[1:], len(bucket)]):
        h, w = history[a:b], word[a:b]
        there = np.zeros(len(names), bool)
        there[h] = there[w] = True
        local = np.cumsum(there) - 1
        pair = _begins(h, w)
        ph = h[pair]
        head = _begins(ph)
        yield int(bucket[a]), Pack(
            pack_id, documents, train, names[there], local[ph[head]], np.diff(np.append(head, len(pair))), local[w[pair]],
            np.diff(np.append(pair, b - a)), owner[a:b]).dumped()
        documents = None


def _entries(deal: Deal):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, hashes = TaskContext.get().partitionId(), 0, Hashes()
        for batch in batches:
            keys, train = batch.column("key").to_numpy(), ~batch.column("held_out").to_numpy(zero_copy_only=False)
            texts = batch.column("text").to_pylist()
            words: list[int] = []
            ends, begin = [0], 0
            for i, text in enumerate(texts):
                # START, the words, END: each but END is a history of the next.
                words.append(START)
                words += hashes.of(text)
                words.append(END)
                ends.append(len(words))
                if len(words) >= PACK_WORDS or i == len(texts) - 1:
                    own = slice(begin, i + 1)
                    out = list(_packed((task, nth), keys[own], train[own], np.array(words, _U), np.diff(ends), deal))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())],
                        names=["bucket", "pack"])
                    words, ends, begin, nth = [], [0], i + 1, nth + 1

    return rows


def entries(rows: DataFrame, deal: Deal) -> RDD:
    """(bucket, pack) dealt to the buckets."""
    packs = rows.select("key", "held_out", "text").mapInArrow(_entries(deal), "bucket int, pack binary")
    return packs.rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(deal.buckets)


# --- 3. bigrams ---------------------------------------------------------------------------


def _pair_hash(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(history * _U(0xD1342543DE82EF95) + word)


class Bigrams:
    """Training bigrams of a bucket."""

    def __init__(self):
        self.found = [(np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64))]
        self.size = 0

    def add(self, history: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
        there = n > 0
        self.found.append((history[there], word[there], n[there]))
        self.size += int(there.sum())
        if self.size > PACK_BIGRAMS:
            self.found, self.size = [self._merged()], 0

    def _merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, w, n = (np.concatenate([f[i] for f in self.found]) for i in range(3))
        self.found = []  # not held twice while they are sorted
        order = np.lexsort((w, h))
        h, w, n = h[order], w[order], n[order]
        begin = _begins(h, w)
        return h[begin], w[begin], np.add.reduceat(n, begin) if len(begin) else n

    def stored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(history, word, n) of the stored bigrams, sorted; nothing is left here."""
        h, w, n = self._merged()
        kept = n >= STORED
        return h[kept], w[kept], n[kept]


def _contents(bucket: int, items: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, list[int], bytes]]:
    """How many bigrams of a bucket occur how often, and its distinct words."""
    bigrams, names, size = Bigrams(), [np.zeros(0, _U)], 0
    for _, raw in items:
        pack = Pack.loaded(pickle.loads(raw))
        bigrams.add(*pack.bigrams())
        names.append(pack.names)
        size += len(pack.names)
        if size > PACK_BIGRAMS:
            names, size = [np.unique(np.concatenate(names))], 0
    words = np.unique(np.concatenate(names))
    _, _, n = bigrams.stored()
    counts = np.bincount(n[n <= DISCOUNTED + 1], minlength=DISCOUNTED + 2).tolist()
    for at in range(0, len(words), PACK_WORDS):
        yield bucket, counts if at == 0 else [], _narrow(words[at : at + PACK_WORDS]).tobytes()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
            words = _widen(np.frombuffer(raw, "u1").reshape(-1, 7)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), bucket, np.int32)), pa.array(words)], names=["bucket", "word"])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts packed by bucket."""
    for batch in batches:
        bucket, word, n = (batch.column(c).to_numpy() for c in ("bucket", "word", "n"))
        parts = [(int(b), np.flatnonzero(bucket == b)) for b in np.unique(bucket)]
        out = [pickle.dumps(("words", _narrow(word[i]), _small(n[i])), protocol=5) for _, i in parts]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array(out, pa.binary())], names=["bucket", "pack"])


def contents(dealt: RDD, words: DataFrame, buckets: int) -> tuple[dict[int, int], RDD]:
    """Counts of counts of the stored bigrams, and (bucket, words of the bucket with their counts) dealt as the entries are."""
    spark = words.sparkSession
    found = staged(spark.createDataFrame(dealt.mapPartitionsWithIndex(_contents), "bucket int, counts array<long>, words binary"), "contents")
    counts = found.select(F.posexplode("counts").alias("n", "m")).filter("m > 0").groupBy("n").agg(F.sum("m").alias("m")).collect()
    asked = found.select("bucket", "words").mapInArrow(_asked, "bucket int, word long")
    given = asked.join(words.select("word", "n"), "word").select("bucket", "word", "n").mapInArrow(_answered, "bucket int, pack binary")
    return {r["n"]: r["m"] for r in counts}, given.rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(buckets)


# --- 4. the model -------------------------------------------------------------------------


def good_turing(counts: dict[int, int], least: int) -> dict[int, float]:
    """Katz's discount of each count from ``least`` to ``DISCOUNTED``.

    Where the counts of counts give no discount between 0 and 1, nothing is taken from a
    count that Good-Turing estimates as at least itself, and half a count from others.
    """
    k, found = DISCOUNTED, {}
    n = lambda r: counts.get(r, 0)
    common = (k + 1) * n(k + 1) / (least * n(least)) if n(least) else 0.0
    for r in range(least, k + 1):
        share = (r + 1) * n(r + 1) / (r * n(r)) if n(r) else 0.0
        d = (share - common) / (1 - common) if common < 1 else 0.0
        found[r] = d if 0 < d < 1 else 1.0 if share >= 1 else (r - 0.5) / r
    return found


def _discounted(n: Column, discounts: dict[int, float]) -> Column:
    out = n.cast("double")
    for r, d in discounts.items():
        out = F.when(n == r, F.lit(r * d)).otherwise(out)
    return out


def _discounted_of(n: np.ndarray, discounts: dict[int, float]) -> np.ndarray:
    out = n.astype(np.float64)
    for r, d in discounts.items():
        out[n == r] = r * d
    return out


def _counts_of_counts(rows: DataFrame) -> dict[int, int]:
    found = rows.filter(F.col("n") <= DISCOUNTED + 1).groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()
    return {r["n"]: r["m"] for r in found}


@dataclass(frozen=True)
class Totals:
    tokens: int  # N
    words: int  # V, the end included
    scale: float  # of unigram probabilities
    unknown: float  # probability of the unknown word
    starts: int
    discounts: dict[int, float]  # of words

    def p(self, n: Column) -> Column:
        """Unigram probability of a word by its count."""
        return _discounted(n, self.discounts) * (self.scale / max(1, self.tokens))

    def p_of(self, n: np.ndarray) -> np.ndarray:
        return _discounted_of(n, self.discounts) * (self.scale / max(1, self.tokens))


def unigram_model(words: DataFrame, starts: int) -> tuple[DataFrame, Totals]:
    """(word, n, p) and the totals; probabilities and the unknown word's sum to 1."""
    discounts = good_turing(_counts_of_counts(words), 1)
    mass = _discounted(F.col("n"), discounts)
    tokens, distinct, kept = words.agg(F.sum("n"), F.count(F.lit(1)), F.sum(mass)).first()
    tokens, kept = tokens or 0, kept or 0.0
    scale = min(1.0, tokens * (1 - 0.5 / (tokens + 1)) / kept) if kept else 1.0
    totals = Totals(tokens, distinct, scale, 1 - scale * kept / tokens if tokens else 1.0, starts, discounts)
    return words.select("word", "n", totals.p(F.col("n")).alias("p")), totals


def weighed(mass: np.ndarray, p: np.ndarray, total: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """Scale and log10 of the backoff weight of histories.

    ``mass`` and ``p`` are the sums of their bigrams' discounted counts and words'
    probabilities, ``total`` how often they occur.
    """
    scale = np.minimum(1.0, (1 - 0.5 / (total + 1)) * total / mass)
    return scale, np.log10((1 - scale * mass / total) / np.maximum(1 - p, unknown))


def _look_up(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _counts(given: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's training words, sorted, and their counts."""
    word = np.concatenate([np.zeros(0, _U), *(_widen(g[1]) for g in given)])
    count = np.concatenate([np.zeros(0, np.int64), *(g[2].astype(np.int64) for g in given)])
    order = np.argsort(word)
    return word[order], count[order]


@dataclass(frozen=True)
class Hot:
    """The histories of ``Deal.hot``, which no bucket has whole."""

    total: np.ndarray
    scale: np.ndarray
    weight: np.ndarray


def _hot_sums(totals: Totals, discounts: dict[int, float], deal: Deal):
    """What a bucket adds to the mass and the probability of the words of hot histories."""

    def rows(items: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, float, float]]:
        given, bigrams = [], Bigrams()
        for _, raw in items:
            pack = pickle.loads(raw)
            if pack[0] == "words":
                given.append(pack)
                continue
            pack = Pack.loaded(pack)
            hot = np.isin(pack.names[pack.heads], deal.hot)
            if hot.any():
                here = np.repeat(hot, pack.per_head)
                bigrams.add(*(x[here] for x in pack.bigrams()))
        word, count = _counts(given)
        h, w, n = bigrams.stored()
        if len(h):
            at, size = np.searchsorted(deal.hot, h), len(deal.hot)
            mass = np.bincount(at, _discounted_of(n, discounts), size)
            p = np.bincount(at, totals.p_of(count[np.searchsorted(word, w)]), size)
            for i in np.unique(at):
                yield int(i), float(mass[i]), float(p[i])

    return rows


def hot_model(spark: SparkSession, everything: RDD, counts: dict[int, int], totals: Totals, discounts: dict[int, float], deal: Deal) -> Hot:
    """The weights of the hot histories, which occur ``counts`` times."""
    sums = spark.createDataFrame(everything.mapPartitions(_hot_sums(totals, discounts, deal)), "hot int, mass double, p double")
    found = {r["hot"]: (r["mass"], r["p"]) for r in sums.groupBy("hot").agg(F.sum("mass").alias("mass"), F.sum("p").alias("p")).collect()}
    total = np.array([counts.get(int(h), 0) for h in deal.hot], np.float64)
    scale, weight = np.ones(len(total)), np.zeros(len(total))
    there = np.array(sorted(found), np.int64)
    mass, p = np.array([found[i] for i in there], np.float64).reshape(-1, 2).T
    scale[there], weight[there] = weighed(mass, p, total[there], totals.unknown)
    return Hot(total, scale, weight)


# --- 5. evaluation ------------------------------------------------------------------------


def _evaluated(totals: Totals, discounts: dict[int, float], deal: Deal, hot: Hot):
    """Partial sums of a bucket's entries by pack; the words come first, then the entries twice."""
    smooth = totals.tokens + 0.1 * (totals.words + 1)
    least = math.log10(0.1 / smooth)
    unknown = math.log10(totals.unknown)
    start = hot.weight[np.searchsorted(deal.hot, _U(START))]

    def modelled(given: list[tuple], bigrams: Bigrams):
        """Sorted words with score (weight included) and base, and sorted bigrams with what they add to it."""
        word, count = _counts(given)
        own, base = np.log10(totals.p_of(count)), np.log10((count + 0.1) / smooth)
        at, there = _look_up(deal.hot, word)
        own += np.where(there, hot.weight[at], 0.0)
        h, w, n = bigrams.stored()
        if not len(h):
            return word, own, base, np.zeros(0, _U), np.zeros(0)
        mass, p = _discounted_of(n, discounts), totals.p_of(count[np.searchsorted(word, w)])
        begin = _begins(h)
        each = np.diff(np.append(begin, len(h)))
        heads = h[begin]
        at, is_hot = _look_up(deal.hot, heads)
        place, _ = _look_up(word, heads)  # every history but START has its count here
        total = np.where(is_hot, hot.total[at], count[place])
        scale, weight = weighed(np.add.reduceat(mass, begin), np.add.reduceat(p, begin), total, totals.unknown)
        own[place[~is_hot]] += weight[~is_hot]
        scale, weight = np.where(is_hot, hot.scale[at], scale), np.where(is_hot, hot.weight[at], weight)
        gain = np.log10(mass * np.repeat(scale / total, each)) - np.repeat(weight, each) - np.log10(p)
        pair = _pair_hash(h, w)
        order = np.argsort(pair)
        return word, own, base, pair[order], gain[order]

    def rows(items: Iterator[tuple[int, bytes]]) -> Iterator[tuple[tuple[int, int], bytes]]:
        given, bigrams, counted, model = [], Bigrams(), set(), None
        for _, raw in items:
            pack = pickle.loads(raw)
            if pack[0] == "words":
                given.append(pack)
                continue
            if model is None and pack[0] not in counted:
                counted.add(pack[0])
                bigrams.add(*Pack.loaded(pack).bigrams())
                continue
            if model is None:  # the entries begin anew
                model = modelled(given, bigrams)
                given, bigrams = [], Bigrams()
            word, own, base, pair, gain = model
            pack = Pack.loaded(pack)
            h = pack.names[pack.heads]
            at, known = _look_up(word, h)
            started = h == _U(START)
            score, plain = np.where(started, start, unknown), np.where(started, 0.0, least)
            score[known], plain[known] = own[at[known]], base[at[known]]
            at, there = _look_up(pair, _pair_hash(np.repeat(h, pack.per_head), pack.names[pack.words]))
            extra = np.zeros(len(there))
            extra[there] = gain[at[there]]
            each = lambda x: np.repeat(np.repeat(x, pack.per_head), pack.per_pair)
            sums = [np.bincount(pack.owner, x) for x in (each(known), each(plain), each(score) + np.repeat(extra, pack.per_pair))]
            docs = np.flatnonzero(np.bincount(pack.owner))
            known_tokens, plain, score = (x[docs] for x in sums)
            yield pack.id, pickle.dumps((pack.documents, _small(docs), _small(known_tokens.astype(np.int64)), plain, score), protocol=5)

    return rows


def _by_pack(pack_id: tuple[int, int]) -> int:
    return xxhash.xxh3_64_intdigest(b"%d %d" % pack_id) >> 8


def _added(items: Iterator[tuple[tuple[int, int], bytes]]) -> Iterator[tuple[bytes]]:
    """The sums of each pack over the buckets."""
    packs: dict[tuple[int, int], list] = {}
    for pack_id, raw in items:
        documents, docs, *parts = pickle.loads(raw)
        sums = packs.setdefault(pack_id, [None, np.zeros((3, 0))])
        sums[0] = documents or sums[0]
        last = int(docs[-1]) + 1
        if last > sums[1].shape[1]:
            sums[1] = np.pad(sums[1], ((0, 0), (0, last - sums[1].shape[1])))
        for total, part in zip(sums[1], parts):
            total[docs] += part
    for (keys, tokens), (known, base, score) in packs.values():
        yield (pickle.dumps((keys, tokens.astype(np.int64), known.astype(np.int64), base, score)),)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pickle.loads(raw)], names=["key", "tokens", "known", "base", "score"])


def score(docs: DataFrame) -> DataFrame:
    """Every row with its log10 probability under a model learned from the training rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    words = unigrams(rows)
    starts = words.filter(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    words, totals = unigram_model(words, starts)
    buckets = shuffle_partitions(spark)
    hot = words.filter(F.col("n") * 4 * buckets > totals.tokens).select("word", "n").collect()  # fewer than 4 * buckets
    hot = {START: starts} | {r["word"]: r["n"] for r in hot}
    deal = Deal(buckets, np.array(sorted(hot), _U))
    dealt = entries(rows, deal)
    counts, given = contents(dealt, words, buckets)
    discounts = good_turing(counts, STORED)
    # Same partitioner: each partition gets its words, then its entries, without a shuffle.
    everything = given.union(dealt)
    weights = hot_model(spark, everything, hot, totals, discounts, deal)
    smooth = totals.tokens + 0.1 * (totals.words + 1)
    parts = everything.union(dealt).mapPartitions(_evaluated(totals, discounts, deal, weights)).partitionBy(buckets, _by_pack)
    parts = spark.createDataFrame(parts.mapPartitions(_added), "pack binary")
    parts = parts.mapInArrow(_sums, "key long, tokens long, known long, base double, score double")
    # Equal rows share a key, and so its sums.
    total = parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")))
    rows = rows.select("doc_id", "key", "held_out")
    times = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    total = staged(total.join(times, "key"), "sums")
    end = words.filter(F.col("word") == END).agg(F.max("n"), F.max("p")).first()
    end_base = math.log10(((end[0] or 0) + 0.1) / smooth)
    end_score = math.log10(end[1] if end[1] else totals.unknown)
    each = lambda c: F.col(c) / F.col("times")
    return rows.join(total, "key").select(
        "doc_id", "held_out", each("tokens").cast("long").alias("n_tokens"),
        (each("known") + (1 if end[0] else 0)).cast("long").alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (each("base") + end_base).alias("base_score"), (each("score") + end_score).alias("score"),
    )


def op6_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
