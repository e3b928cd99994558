import itertools
import random
import zlib

import corpus_pipeline
from shelfwatch.llm import decontaminate, jaccard_join, langid, mixing
from shelfwatch.llm.common import DOCUMENT, staged

SF = "/root/testdata/sf0.001"


def test_stages_apply_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(staged(stage(spark, tables[-1], SF), f"test-{name}"))
    start, known, single, clean, mixed, shards = tables
    for table in tables[1:-1]:
        assert table.columns == DOCUMENT
    ids = lambda t: sorted(r.doc_id for r in t.select("doc_id").collect())
    accepted = langid.predict(start, langid.fit(start)).filter(f"lang_pred <> 'und' AND score >= {langid.LEAST}")
    assert ids(known) == ids(accepted)
    alike = jaccard_join.similar_documents(known, jaccard_join.COMMON_SHINGLE, jaccard_join.COMMON_SIMILARITY)
    first = alike.filter("component_id = doc_id")
    assert ids(single) == ids(first)
    bad = {r.doc_id for r in decontaminate.contaminated(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert bad and ids(clean) == [i for i in ids(single) if i not in bad]
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(clean).filter("size > 0").collect()}
    assert ids(mixed) == sorted(i for i, n in times.items() for _ in range(n))
    assert ids(shards) == ids(mixed)
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in shards.collect())
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, shards.collect()), key=str)


def test_awkward_rows_pass_every_stage(spark, awkward, empty):
    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SF), f"awkward-{name}")


def kept_by_five_words(rows):
    """The doc_ids that are the smallest of their component, all pairs compared."""
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    least = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                least[a] = least[b] = min(least[a], least[b])
    return sorted(i for i in sets if least[i] == i)


def test_near_copies_of_five_words_leave(spark, docs_of):
    rng = random.Random(4)
    rows = []
    for base in range(8):
        words = [f"w{rng.randrange(400)}" for _ in range(100)]
        for edits in (0, 1, 2, 3, 4):  # each edit spoils five shingles of 96: similarity from 1 down to about 0.65
            copy = list(words)
            for e in range(edits):
                copy[10 + 20 * e] = f"edit{base}.{edits}.{e}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    expected = kept_by_five_words(rows)
    found = corpus_pipeline.near_duplicates(spark, docs_of(rows), SF)
    assert 8 <= len(expected) < len(rows) and sorted(r.doc_id for r in found.collect()) == expected
    three = jaccard_join.one_of_each(docs_of(rows))
    assert sorted(r.doc_id for r in three.collect()) != expected
