"""Pairs that share a lexeme are made in blocks, each once."""

import random

from ledgerlens.operators import lexical_match
from ledgerlens.plans import selection

ITEM = "scope string, id long, lex array<string>"


def test_blocks_find_the_pairs_that_share_a_lexeme(spark, monkeypatch):
    monkeypatch.setattr(lexical_match, "QUERY_BLOCK", 3)
    monkeypatch.setattr(lexical_match, "ITEM_BLOCK", 7)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "b", None]), i, [f"w{rng.randrange(40)}" for _ in range(rng.randrange(6))]) for i in range(120)] + [("b", 7, ["w1"]), ("b", 8, ["w1", "w1\0"]), ("b", 9, None)]
    items = spark.createDataFrame(rows, ITEM)
    found = sorted(map(tuple, lexical_match.lexical_matches(items, items.filter("id % 4 = 0")).collect()))
    expected = sorted((q, x) for qs, q, ql in rows if q % 4 == 0 for xs, x, xl in rows if qs == xs is not None and q != x and set(ql or ()) & set(xl or ()))
    assert found == expected and len(found) > 100


def test_no_row_is_made_for_each_shared_lexeme(spark, tmp_path):
    texts = [(i, " ".join(f"word{j}" for j in range(i % 3, 300)), "en", "s", 1) for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, [1.0]) for i in range(60)], "vec_id long, label long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = selection.p4_lexical_match(spark, str(tmp_path))
    assert "explode(lex" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 3 * 29
