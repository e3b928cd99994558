"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text from what stands before and after it; a
document's probabilities are the means over all its bytes. It is trained here, in
numpy by backpropagation through time, on a bounded sample of labelled documents:
``SAMPLE`` documents of each language, of each ``PARTS`` stretches of ``STRETCH`` bytes
spread over the text. Prediction reads every byte of every text, row by row, in Arrow
batches; nothing is shuffled but the sample.

Only text and lang of training documents are learned from: those with a non-null lang
whose crc32(doc_id as text) modulo 4 is not 2.

Defined results: a text that is null, empty or without letters is ``und`` with score 0,
and so is every text if nothing is labelled; a null doc_id is not trained on and counts
as not held out; repeated rows give repeated results; an empty table gives no rows.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from shelfwatch.llm.bigru import BiGRU, pooled, segments
from shelfwatch.llm.common import DOCUMENT, narrowed, staged

SAMPLE = 400  # documents a language
PARTS, STRETCH = 4, 64
EPOCHS = 5
NONE = "und"
LEAST = 0.35  # mean probability below which a text has no recognised language
BATCH_BYTES = 4 << 20
_LETTER = re.compile(r"[^\W\d_]")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    network: BiGRU
    languages: list[str]


def _stretches(text: str) -> list[bytes]:
    raw = text.encode()
    room = max(0, len(raw) - STRETCH)
    starts = sorted({room * i // max(1, PARTS - 1) for i in range(PARTS)})
    return [raw[s : s + STRETCH] for s in starts if raw]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of the languages of the training documents; None if there are none."""
    rows = narrowed(docs, "doc_id", "text", "lang").filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(~held_out())
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    draw = F.xxhash64(F.lit(8), "doc_id")
    nth = F.row_number().over(W.partitionBy("lang").orderBy(draw, "doc_id"))
    chosen = staged(rows.select("doc_id", "lang", nth.alias("nth")).filter(F.col("nth") <= sample), "sample")
    texts = rows.join(chosen.select("doc_id").distinct(), "doc_id").select("doc_id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, lang, s) for i, lang, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "lang", "text")))
                     for s in _stretches(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()),
                 pa.array([f[2] for f in found], pa.binary())], names=["doc_id", "lang", "part"])

    # At most SAMPLE * PARTS * STRETCH bytes a language reach the driver, in a fixed order.
    parts = sorted((r["lang"], r["doc_id"], bytes(r["part"])) for r in texts.mapInArrow(cut, "doc_id long, lang string, part binary").collect())
    languages = sorted({p[0] for p in parts})
    if not parts:
        return None
    data, lengths, owner = segments([p[2] for p in parts], STRETCH)
    labels = np.array([languages.index(p[0]) for p in parts])[owner]
    network = BiGRU(len(languages))
    network.train(data, lengths, labels, EPOCHS)
    return Model(network, languages)


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some megabytes together."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size > BATCH_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    yield begin, len(texts)


def _labelled(model: Model | None, columns: list[str]):
    """The given columns of a batch with the language and score of its text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, scores = [NONE] * len(texts), [0.0] * len(texts)
            for begin, end in _batches(texts) if model else ():
                lettered = [i for i in range(begin, end) if _LETTER.search(texts[i])]
                if not lettered:
                    continue
                found = pooled(model.network, [texts[i].encode() for i in lettered], len(model.languages))
                best = found.argmax(1)
                for i, b, row in zip(lettered, best, found):
                    names[i], scores[i] = model.languages[b], round(min(1.0, float(row[b])), 6)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*columns, "lang_pred", "score"])

    return rows


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; the model sees the text alone."""
    rows = narrowed(docs, "doc_id", "text").withColumn("held_out", held_out())
    return rows.mapInArrow(_labelled(model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` (columns of documents) in which a language is recognised.

    Rejected are texts without letters and those whose best language has a mean
    probability under ``least``.
    """
    rows = docs.select(*DOCUMENT)
    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    found = rows.mapInArrow(_labelled(fit(rows), DOCUMENT), f"{fields}, lang_pred string, score double")
    return found.filter((F.col("lang_pred") != NONE) & (F.col("score") >= least)).select(*DOCUMENT)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
