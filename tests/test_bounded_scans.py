"""Scans hand on a bounded number of rows for each query, whatever ties and lists there are."""

import pandas as pd

from ledgerlens.operators import indexed
from ledgerlens.operators.candidates import Block

ITEM = "scope string, id long, e array<float>, lex array<string>, recency long, tie_a string, tie_b string, cost long"


def test_ties_of_a_chunk_are_cut_to_k():
    block = Block(2)
    block.add_queries(pd.DataFrame({"id": [100, 101], "e": [[1.0, 0.0]] * 2, "lex": [["a"]] * 2, "cells": [None] * 2}))
    n = 50
    block.add_items(pd.DataFrame({"id": range(n), "e": [[1.0, 1.0]] * n, "lex": [["a"]] * n, "cell": 0, "recency": 0, "tie_a": "", "tie_b": "", "cost": 1}))
    assert {axis: sum(map(len, own)) for axis, own in block.best.items()} == {"distance": 4, "overlap": 4}
    assert sorted(next(block.finish())["id"]) == [0, 0, 1, 1]


def test_indexed_candidates_carry_no_texts_for_each_pair(spark):
    items = spark.createDataFrame([("s", i, [1.0, float(i)], ["a", f"w{i % 3}"], 0, "", "", 1) for i in range(40)], ITEM)
    vectors, lexemes = indexed.build(items)
    found = indexed.indexed_candidates(vectors, lexemes, items.filter("id % 20 = 0").select("scope", "id", "e", "lex"), 5)
    assert "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString() and "items" not in lexemes.postings.columns
    assert found.filter("distance is null or overlap is null").isEmpty() and found.filter("by_vector is not null").count() == 10
