"""Every query with a SQL twin against DuckDB on the smallest tables."""

from datetime import datetime

import duckdb
import pytest

from ledgerlens.operators.ranking import greedy_pack
from ledgerlens.plans.catalogue import ORACLE_SQL, QUERIES
from ledgerlens.sources.tables import close_intervals

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.sql(ORACLE_SQL[name])
    assert canonical(df.columns, df.collect()) == canonical(found.columns, found.fetchall())


def test_intervals_close_and_link(spark):
    rows = [(1, "u", "a", datetime(2024, 1, 1)), (2, "u", "a", datetime(2024, 1, 3)), (3, "u", "b", datetime(2024, 1, 2))]
    out = close_intervals(spark.createDataFrame(rows, "id long, u string, p string, at timestamp"), ["u", "p"], "at", "id")
    assert {(r.id, r.status, r.supersedes_id, r.valid_to) for r in out.collect()} == {(1, "superseded", None, datetime(2024, 1, 3)), (2, "active", 1, None), (3, "active", None, None)}


def test_pack_skips_what_does_not_fit(spark):
    rows = [("q", 1, 10, 60), ("q", 2, 11, 50), ("q", 3, 12, 40)]
    out = greedy_pack(spark.createDataFrame(rows, "q string, rank long, id long, cost long"), "q", "rank", "id", "cost", 100)
    assert [(r.id, r.place) for r in out.orderBy("place").collect()] == [(10, 0), (12, 1)]


def test_candidates_match_brute_force_in_many_blocks(spark, monkeypatch):
    """Ties, null vectors and lexemes, scopes that differ behind a zero character, and blocks of two queries and three items."""
    import random

    from ledgerlens.operators import candidates as C

    monkeypatch.setattr(C, "QUERY_BLOCK", 2)
    monkeypatch.setattr(C, "ITEM_BLOCK", 3)
    r = random.Random(3)
    schema = "scope string, id long, e array<float>, lex array<string>, recency long, tie_a string, tie_b string, cost long"
    rows = [(r.choice(["a\0x", "a\0y", None]), i, r.choice([None, [float(r.randint(0, 2)) for _ in range(3)]]), r.choice([None, r.sample("pqrstu", 3)]), r.randint(0, 2), r.choice("mn"), None, 1) for i in range(60)]
    items = spark.createDataFrame(rows, schema)
    got = {(x.query_id, x.id): (x.by_vector, x.by_lexemes) for x in C.candidates(items, items.filter("id % 5 = 0").select("scope", "id", "e", "lex"), 4).collect()}
    want = {}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for scope, q, qe, qlex, *_ in rows:
        if q % 5 or scope is None:
            continue
        own = [x for x in rows if x[0] == scope and x[1] != q]
        ties = lambda x: (-x[4], x[5], x[1])
        dist = lambda x: round(1 - sum(a * b for a, b in zip(qe, x[2])) / norm(qe) / norm(x[2]), 6)
        near = sorted((x for x in own if qe and x[2] and norm(qe) and norm(x[2])), key=lambda x: (dist(x), ties(x)))[:4]
        shared = lambda x: len({*(x[3] or ())} & {*(qlex or ())})
        lexical = sorted((x for x in own if shared(x)), key=lambda x: (-shared(x), ties(x)))[:4]
        for axis, found in enumerate((near, lexical)):
            for place, x in enumerate(found, 1):
                want.setdefault((q, x[1]), [None, None])[axis] = place
    assert got == {k: tuple(v) for k, v in want.items()}


def test_packing_episodes_and_contested_facts(spark):
    from ledgerlens.operators.ranking import pack_packets

    rows = [(1, 1, "episode", 10, 60, None), (1, 2, "episode", 11, 30, None), (1, 3, "fact", 12, 20, [(13, 15), (14, 50)]), (1, 4, "fact", 13, 15, None), (1, 5, "fact", 15, 6, None), (1, 6, "fact", 16, 5, None)]
    pool = spark.createDataFrame(rows, "query_id long, rank long, kind string, id long, cost long, siblings array<struct<id:bigint,cost:bigint>>")
    got = [(r.id, r.action, r.reason_code, r.used) for r in pack_packets(pool, 100).orderBy("place").collect()]
    assert got == [(10, "included", "top_score", 60), (11, "excluded", "over_episode_budget", 60), (12, "included", "conflict_disputed", 80), (13, "included", "conflict_disputed", 95), (14, "excluded", "over_budget", 95), (15, "excluded", "over_budget", 95), (16, "included", "top_score", 100)]
    with pytest.raises(ValueError):
        pack_packets(pool, 0)
