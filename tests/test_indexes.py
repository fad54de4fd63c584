"""The vector and the lexical index against the scan of all items."""

import random

import numpy as np
import pytest

from ledgerlens.operators import indexed, lexical_index, vector_index
from ledgerlens.operators.candidates import candidates

ITEM = "scope string, id long, e array<float>, lex array<string>, recency long, tie_a string, tie_b string, cost long"


def items_of(spark, n=900, clusters=30, seed=1):
    r, g = random.Random(seed), np.random.default_rng(seed)
    centres = g.normal(size=(clusters, 8))
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        e = [float(x) for x in centres[i % clusters] + g.normal(size=8) * 0.15]
        lex = [w for w in r.choices(words, weights=[1 / (j + 1) for j in range(60)], k=r.choice([0, 3, 10, 40, 80]))]
        scope = "hot" if i % 3 else r.choice(["a", "b", None])
        rows.append((scope, i, r.choice([e] * 12 + [None, [0.0] * 8]), r.choice([lex] * 9 + [None]), r.randint(0, 3), r.choice(["m", "n", None]), "x", 1))
    return spark.createDataFrame(rows, ITEM)


def asked(items):
    return items.filter("id % 20 = 0").selectExpr("scope", "id", "e", "array_distinct(lex) as lex")


def axis(df, rank, value):
    return {(r.query_id, r.id): (r[rank], r[value]) for r in df.filter(f"{rank} is not null").collect()}


@pytest.fixture(scope="module")
def small(spark):
    import pytest as p

    with p.MonkeyPatch.context() as m:
        m.setattr(vector_index, "LIST", 20)
        m.setattr(lexical_index, "BLOCK", 8)
        items = items_of(spark).cache()
        yield items, *indexed.build(items)


@pytest.mark.parametrize("k", [1, 10, 64])
def test_both_indexes_find_what_a_scan_finds(small, k):
    items, vectors, lexemes = small
    want = candidates(items, asked(items), k).cache()
    assert axis(vector_index.nearest(vectors, asked(items), k), "by_vector", "distance") == axis(want, "by_vector", "distance")
    assert axis(lexical_index.best(lexemes, asked(items), k), "by_lexemes", "overlap") == axis(want, "by_lexemes", "overlap")
    got = indexed.indexed_candidates(vectors, lexemes, asked(items), k)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_probes_keep_the_recall_and_read_less(small):
    items, vectors, _ = small
    k = 10
    exact = candidates(items, asked(items), k).filter("by_vector is not null")
    probes = vector_index.probes_for(vectors, asked(items), k, 0.95)
    found = vector_index.nearest(vectors, asked(items), k, probes)
    rows = vector_index.recalls(found, exact).collect()
    assert sum(r.hits for r in rows) >= 0.9 * sum(r.of for r in rows)
    lists = vector_index.ranked_lists(vectors, asked(items)).filter("scope = 'hot'")
    assert probes <= 0.34 * lists.select("list").distinct().count()


def test_bounds_leave_blocks_and_lists_unread(small):
    items, vectors, lexemes = small
    _, needed = lexical_index.touched(lexemes, asked(items), 3)
    heads = asked(items).selectExpr("scope", "id as query_id", "explode(lex) as lexeme").join(lexemes.postings, ["scope", "lexeme"]).select("query_id", "block").distinct()
    assert needed.count() < 0.6 * heads.count()
    balls = vector_index.ranked_lists(vectors, asked(items)).filter("scope = 'hot'")
    assert balls.filter("bound < 0.9").count() > 0.5 * balls.count()


def test_every_row_is_in_one_list(small):
    items, vectors, _ = small
    assert vectors.lists.count() == items.filter("scope is not null").count()
    assert vectors.lists.groupBy("scope").agg({"list": "max"}).filter("scope = 'hot'").first()[1] > 10


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEM)
    vectors, lexemes = indexed.build(none)
    assert not indexed.indexed_candidates(vectors, lexemes, asked(none), 5).collect()
    one = spark.createDataFrame([("s", 1, [1.0], ["a"], 1, "", "", 1)], ITEM)
    vectors, lexemes = indexed.build(one)
    assert not indexed.indexed_candidates(vectors, lexemes, asked(one), 5).collect()


def test_recall_over_all_vectors(spark):
    from ledgerlens.plans.catalogue import QUERIES

    rows = QUERIES["t1_probed_recall"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 25 and sum(r.hits for r in rows) >= 0.9 * sum(r.of for r in rows) and all(r.of == 64 for r in rows)
