import random
from collections import Counter, defaultdict

from spandrel.llm import frequency as Q

DDL = "clip string, seg int, f string, g string, term string, field int"


def brute(data):
    occ, rec = Counter(), defaultdict(set)
    for c, s, f, g, *_ in data:
        for name, t in (("f", f), ("g", g)):
            if t is not None:
                occ[name, t] += 1
                rec[name, t].add((c, s))
    return {k: (n, len(rec[k])) for k, n in occ.items()}


def test_against_brute_force(spark):
    r = random.Random(3)
    data = [(r.choice(["a", "b", None]), r.choice([None, *range(30)]), r.choice(["hot"] * 9 + [None, "", "x", "é", "é", str(r.randrange(40))]), r.choice(["y", None]), "z", 1) for _ in range(3000)]
    df = spark.createDataFrame(data, DDL).repartition(5)
    for buckets in (1, 64):
        counts = Q.term_counts(df, ["f", "g"], ["clip", "seg"], buckets)
        got = {(x.field, x.term): (x.occurrences, x.records) for x in counts.collect()}
        total = got.pop((Q.ALL, ""))
        assert got == brute(data) and total == (len(data), len({d[:2] for d in data}))


def test_marks(spark):
    data = [("c", i, "common" if i < 6 else "b", None, "", 0) for i in range(10)] + [("c", 0, "rare", None, "", 0)] * 5
    counts = Q.term_counts(spark.createDataFrame(data, DDL), ["f"], ["clip", "seg"])
    assert {x.term: x.mark for x in Q.marked_terms(counts, ["f"]).collect()} == {"common": "common", "b": None, "rare": "rare"}
    both = Q.term_counts(spark.createDataFrame(data[:2], DDL), ["f"], ["clip", "seg"])
    assert {x.mark for x in Q.marked_terms(both, ["f"]).collect()} == {"rare"}


def test_empty(spark):
    counts = Q.term_counts(spark.createDataFrame([], DDL), ["f"], ["clip", "seg"])
    assert Q.marked_terms(counts, ["f"]).count() == 0
