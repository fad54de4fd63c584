"""Names, the second hop and merged values on hand-made cases."""

import json

import duckdb
from pyspark.sql import functions as F

from ledgerlens.functions import messages as M
from ledgerlens.functions.names import entity_tokens, person_factor
from ledgerlens.operators.expansion import feedback_names, second_hop
from ledgerlens.plans import retrieval


def hop(spark, packed, pool=(), facts=(), asked=("Zoe",), budget=100, barred=None):
    kept = spark.createDataFrame(packed, "query_id long, kind string, id long, used long, names array<string>")
    head = spark.createDataFrame(list(pool), "query_id long, rank long, names array<string>")
    queries = spark.createDataFrame([(1, "s", list(asked))], "query_id long, scope string, names array<string>")
    all_ = spark.createDataFrame(list(facts), "scope string, id long, cost long, words array<string>")
    gone = None if barred is None else spark.createDataFrame([(1, x) for x in barred], "query_id long, id long")
    return [(r.hop, r.entity, r.id, r.used) for r in second_hop(kept, head, queries, all_, budget, gone).orderBy("used").collect()]


FACTS = [("s", 10, 20, ["ann", "sings"]), ("s", 11, 20, ["ann", "ann"]), ("s", 12, 20, ["bob"]), ("t", 13, 5, ["ann"]), ("s", 14, 90, ["bob", "bob"]), ("s", 15, 5, ["cid"])]


def test_names_of_packed_facts_bring_theirs(spark):
    packed = [(1, "fact", 5, 10, ["Ann", "Bob", "Ann", "Zoe"]), (1, "episode", 6, 30, ["Cid", "Cid", "Cid"])]
    assert hop(spark, packed, facts=FACTS) == [(1, "Ann", 11, 50), (1, "Ann", 10, 70), (2, "Bob", 12, 90)]  # 14 is too long
    assert hop(spark, packed, facts=FACTS, barred=[11]) == [(1, "Ann", 10, 50), (2, "Bob", 12, 70)]
    assert hop(spark, packed, facts=FACTS, asked=("ANN".title(), "Bob")) == []
    assert hop(spark, packed, facts=FACTS, budget=30) == []  # nothing is left
    assert hop(spark, [(1, "episode", 6, 30, ["Ann"])], facts=FACTS) == []  # no fact is packed


def test_contested_facts_take_a_place_among_a_names_facts(spark, tmp_path):
    """Of the five facts that say a name most often two are contested and one is packed: they stay out, and no sixth one comes in. As the SQL does it."""
    texts = {0: "who sang there", 7: "here Ann sang"} | dict.fromkeys([10, 11], "ann ann ann") | dict.fromkeys([14, 16, 18, 22, 24], "and ann")
    near = {0: [1.0, 0.0], 7: [1.0, 0.1]}
    tables = {
        "documents": spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long"),
        "embeddings": spark.createDataFrame([(i, near.get(i, [0.0, 1.0]), 0) for i in texts], "vec_id long, embedding array<float>, label long"),
        "conversations": spark.createDataFrame([(999, 0, "user", "well")], "conv_id long, turn int, role string, text string"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = retrieval.r13_multi_hop(spark, str(tmp_path)).select("query_id", "hop", "entity", "fact_id", "used").collect()
    want = con.sql(f"WITH RECURSIVE {retrieval.MULTI_HOP}").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and [x[3] for x in sorted(want)] == [14, 16]


def test_feedback_names_join_the_seeds(spark):
    pool = [(1, 1, ["Cid", "Cid"]), (1, 2, ["Cid", "Bob"]), (1, 11, ["Bob"])]
    assert hop(spark, [(1, "fact", 5, 10, [])], pool, FACTS) == [(1, "Cid", 15, 15)]
    head = spark.createDataFrame(pool, "query_id long, rank long, names array<string>")
    assert [tuple(r) for r in feedback_names(head).collect()] == [(1, "Cid")]


def test_facts_about_others_count_for_less(spark):
    rows = [("Ann", ["Ann"], 1.0), ("Ann Lee", ["Lee"], 1.0), ("Ann", ["Bob"], 0.7), ("Ann", [], 1.0), (None, ["Bob"], 1.0), ("", ["Bob"], 1.0), ("Jo", ["Jo"], 1.0), ("Jo", ["Bob"], 0.7), ("Ann", None, 1.0)]
    got = spark.createDataFrame([(p, a, w) for p, a, w in rows], "p string, a array<string>, w double").select(person_factor(F.col("p"), F.col("a")).alias("f"), "w").collect()
    assert [r.f for r in got] == [r.w for r in got]
    names = spark.createDataFrame([("The Ann met Émile and Bo. With Ann",)], "t string").select(entity_tokens(F.col("t")).alias("n")).first().n
    assert names == ["Ann", "Émile", "Ann"]


def test_merged_values_keep_what_is_nested(spark):
    rows = [({"a": {"x": [1, {"y": None}]}, "b": 'say "hi"\\', 'k"1': 1.5}, {"b": None, "c": {"d": {}}}), ({}, {}), ({"a": 1}, {"a": {"z": True}})]
    made = spark.createDataFrame([(json.dumps(o), json.dumps(n)) for o, n in rows], "o string, n string")
    got = [json.loads(r.m) for r in made.select(M.value_merge(F.col("o"), F.col("n")).alias("m")).collect()]
    assert got == [{"a": {"x": [1, {"y": None}]}, 'k"1': 1.5, "c": {"d": {}}}, {}, {"a": {"z": True}}]
