import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, lang, source]) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing extra columns."""
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (None, "one two three four", "en", "a"),
        (4, "same words here", "de", "b"), (4, "same words here", "de", "b"), (5, "same  words\there", "de", "a"),
        (6, "other text under a used id", "en", "a"), (6, "yet another text", None, "b"), (7, "x " * 30000, "en", "c"),
        (8, "y" * 50000, "en", "c"), (9, "ünïcödé 😀 тест 𝔘", "fr", "d"), (None, "one two three four", "en", "a"),
    ]
    out = docs_of(rows)
    for name in ("doc", "rid", "key", "sig", "digest", "bucket", "size", "n", "ranges", "shard", "slot", "nth", "word",
                 "content", "token", "gid", "taken", "target", "seed", "hits", "score", "held_out", "group_key"):
        from pyspark.sql import functions as F

        out = out.withColumn(name, F.lit("clash"))
    return out


@pytest.fixture(scope="session")
def empty(docs_of, spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """Random prose: a small vocabulary with passages shared between documents."""

    def build(n, seed=1, words=(20, 200), share=0.5, vocabulary=400):
        rng = random.Random(seed)
        vocab = ["".join(rng.choice("abcdefghilmnoprstuéü") for _ in range(rng.randint(1, 8))) for _ in range(vocabulary)]
        text = lambda k: [rng.choice(vocab) for _ in range(k)]
        passages = [text(rng.randint(30, 120)) for _ in range(4)]
        found = []
        for i in range(n):
            line = text(rng.randint(*words))
            if rng.random() < share:
                passage = list(rng.choice(passages))
                if rng.random() < 0.5:
                    passage[rng.randrange(len(passage))] = "changed"
                at = rng.randrange(len(line))
                line[at:at] = passage
            if found and rng.random() < 0.15:
                line = list(rng.choice(found)[1].split())
                if rng.random() < 0.6:
                    line[rng.randrange(len(line))] = "edited"
            found.append((i, rng.choice([" ", " ", "\n"]).join(line)))
        rng.shuffle(found)
        return found

    return build
