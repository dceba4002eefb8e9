import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spandrel.llm import packing as P


def test_best_fit_is_whole_and_tight():
    r = random.Random(1)
    sizes = [min(2048, int(r.lognormvariate(6.3, 0.9)) + 1) for _ in range(3000)]
    bins = P.best_fit(sizes, (512, 1024, 2048))
    assert sorted(i for _, b in bins for i in b) == list(range(3000))
    assert all(sum(sizes[i] for i in b) <= c for c, b in bins)
    assert sum(sizes) / sum(c for c, _ in bins) > 0.98
    assert P.best_fit([], (10,)) == [] and P.best_fit([5, 5, 5], (4, 6, 15)) == [(15, [0, 1, 2])] and P.best_fit([3], (4, 6, 15)) == [(4, [0])]


@pytest.mark.parametrize("kind", ["spread", "long", "short", "few"])
def test_sizes_compete_and_never_take_more_than_one_size(kind):
    r = random.Random(1)
    one = {"spread": lambda: min(2048, int(r.lognormvariate(6.3, 0.9)) + 1), "long": lambda: min(2048, int(r.gauss(1100, 300)) + 1), "short": lambda: r.randrange(20, 200), "few": lambda: r.choice((450, 500, 700, 1000))}[kind]
    sizes = [one() for _ in range(8000)]
    total = lambda bins: sum(c for c, _ in bins)
    single = P.best_fit(sizes, (2048,))
    for opening in (0, 16, 64):
        bins = P.best_fit(sizes, (512, 1024, 2048), opening)
        assert sorted(i for _, b in bins for i in b) == list(range(8000))
        assert all(sum(sizes[i] for i in b) <= c for c, b in bins)
        assert sum(sizes) <= total(bins) <= total(single)
    free = P.best_fit(sizes, (512, 1024, 2048), 0)
    assert len({c for c, _ in free}) > 1 and len(free) >= len(P.best_fit(sizes, (512, 1024, 2048), 64)) >= -(-sum(sizes) // 2048)


def check(rows, sizes, capacity):
    items, bins = defaultdict(list), defaultdict(list)
    for i, piece, first, n, container, cap, place in rows:
        items[i].append((piece, first, n))
        if container is not None:
            bins[container].append((place, n, cap))
    for i, n in sizes.items():
        at = 0
        for k, (piece, first, size) in enumerate(sorted(items[i])):
            assert (piece, first) == (k, at) and ((n or 0) > capacity or size == (n or 0))
            at += size
        assert at == (n or 0)
    for b in bins.values():
        at = 0
        for place, n, cap in sorted(b):
            assert place == at
            at += n
        assert at <= b[0][2] <= capacity
    return sum(n or 0 for n in sizes.values()) / sum(b[0][2] for b in bins.values())


@pytest.mark.parametrize("parts", [1, 7])
def test_operator(spark, parts):
    r = random.Random(2)
    sizes = {i: int(r.lognormvariate(6.5, 0.8)) for i in range(2000)} | {-1: 0, -2: None, -3: 2048, -4: 2049, -5: 100_000}
    df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "id bigint, n bigint, piece int").repartition(parts)
    out = P.pack(df, "id", "n", (512, 1024, 2048), shard=256, wider=4)
    rows = [tuple(x) for x in out.select("id", "piece", "first_token", "n_tokens", "container", "capacity", "place").collect()]
    assert check(rows, sizes, 2048) > 0.97
    again = P.pack(df.repartition(3), "id", "n", (512, 1024, 2048), shard=256, wider=4)
    assert sorted(map(str, rows)) == sorted(str(tuple(x)) for x in again.collect())


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, 1000)] * 5, "id bigint, n bigint")
    out = P.pack(df, "id", "n")
    assert out.count() == 5 and out.select("container").distinct().count() == 3
    assert P.pack(df.limit(0), "id", "n").count() == 0


@pytest.mark.skipif(not os.path.exists(P.VOCABULARY), reason="no vocabulary")
def test_counts_add_up(spark):
    c = P.counter(P.VOCABULARY)
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice(["a", "word", " ", "  ", "\n", "\r\n", "\n\n", "1", "00:01:05,001", "-->", "é", "'s", "日本", " ", "…", "\t"]) for _ in range(r.randrange(60)))
        assert c.of(t) == len(c.encode(t)), repr(t)
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "x" * 200_000)], "id int, text string")
    n = {x.id: x.n_tokens for x in P.token_lengths(df, "id", "text").collect()}
    assert n[1] == 2 and n[2] == 0 and n[3] == 0 and n[4] == len(c.encode("x" * 200_000))
    assert P.token_lengths(df, "id", "text").where(F.col("id") == 1).count() == 1
