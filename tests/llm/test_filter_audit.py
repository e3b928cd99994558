import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from shelfwatch.llm import filter_audit
from shelfwatch.llm.diagram import Diagram, swaps_through_all_orders


def brute_masks(docs, labels):
    """Failed letters, part and labels of each (doc_id, text, source)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = []
    for doc, text, source in docs:
        t = text or ""
        words = [w for w in re.split("[\x20\x09-\x0D]+", t) if w]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        rank = lambda d: (d is None, d or 0)
        if any((o or "") == t and rank(d) < rank(doc) for d, o, _ in docs):
            fails.add("E")
        out.append((source or "", fails, doc in good, doc in toxic))
    return out


def brute(docs, labels):
    rows, masks = {}, brute_masks(docs, labels)
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                failing = sum(letter in m[1] for m in mine)
                alone = sum(m[1] == {letter} for m in mine)
                rows[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), alone, sum(m[2] for m in gone), sum(m[3] for m in gone)
                ]
    share = {}
    for (part, order, step), row in rows.items():
        share[part, order[step - 1]] = share.get((part, order[step - 1]), 0) + row[1]
    return {key: [*row, share[key[0], key[1][key[2] - 1]]] for key, row in rows.items()}


def audited(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    found = {
        (r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
        for r in rows
    }
    assert len(found) == len(rows)
    return found


def test_orders_come_once_by_neighbour_swaps():
    for n, orders in ((1, 1), (2, 2), (3, 6), (4, 24), (5, 120)):
        diagram = Diagram("ABCDE"[:n], {}, 1)
        seen = {diagram.order}
        for level in swaps_through_all_orders(n):
            diagram.swap(level)
            seen.add(diagram.order)
        assert len(seen) == orders == len(list(swaps_through_all_orders(n))) + 1


def test_swapped_diagram_is_the_one_built_in_that_order():
    rng = random.Random(4)
    counts = {m: (rng.randint(0, 9), rng.randint(0, 3)) for m in range(16)}
    diagram = Diagram("abcd", counts, 2)
    for level in (0, 2, 1, 1, 0, 2, 2, 1):
        diagram.swap(level)
        moved = {}
        for mask, weights in counts.items():
            bits = {c for i, c in enumerate("abcd") if mask >> i & 1}
            moved[sum(1 << i for i, c in enumerate(diagram.order) if c in bits)] = weights
        assert list(diagram.path()) == list(Diagram(diagram.order, moved, 2).path())


def test_equal_sub_diagrams_are_one_node():
    diagram = Diagram("ABCDE", {m: (1,) for m in range(32)}, 1)
    assert len(diagram._nodes) == 5


def test_against_brute_force(spark, docs_of):
    rng = random.Random(9)
    docs = []
    for i in range(300):
        n = rng.choice([3, 150, 199, 200, 260])
        vocabulary = rng.choice([40, 99, 100, 400])
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
        words[0] += rng.choice(["", "", "#", "AB CDE", "|X"]) + "Q" * rng.choice([0, 0, 30])
        docs.append((i, " ".join(words), rng.choice(["a", "b", None])))
    docs += [(1000 + i, docs[rng.randrange(5)][1], rng.choice(["a", "c"])) for i in range(150)]
    rng.shuffle(docs)
    labels = [(rng.randrange(1200), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(500)]
    table = docs_of([(d, t, "en", s) for d, t, s in docs])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(table, known) == brute(docs, labels)


def test_limits_are_exact(spark, docs_of):
    docs = [
        (1, " ".join(f"w{i}" for i in range(200)), "s"), (2, " ".join(f"w{i}" for i in range(199)), "s"),
        (3, " ".join(f"w{i % 100}" for i in range(200)), "s"), (4, " ".join(f"w{i % 99}" for i in range(200)), "s"),
        (5, "AA" + "x" * 98, "s"), (6, "AAA" + "x" * 97, "s"), (7, "é" * 49 + "A", "s"), (8, "ÀÈ" * 50, "s"), (9, "a\x0bb\x0cc\xa0d", "s"),
    ]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(docs_of([(d, t, "en", s) for d, t, s in docs]), labels) == brute(docs, [])


def test_awkward_rows(spark, awkward, empty):
    labels = [(4, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    docs = [(r.doc_id, r.text, r.source) for r in awkward.select("doc_id", "text", "source").collect()]
    assert audited(awkward, known) == brute(docs, labels)
    assert filter_audit.audit(empty, known).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(awkward, none) == brute(docs, [])
