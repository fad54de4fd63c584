"""Scores on the edge between two digits, against their SQL twins."""

import duckdb

from ledgerlens.plans.catalogue import ORACLE_SQL, QUERIES


def test_health_scores_agree_where_doubles_lie_beside_a_half(spark, tmp_path):
    kinds = ("purchase", "view", "error", "click", "signup")
    path = tmp_path / "events.parquet"
    con = duckdb.connect()
    # every combination of small counts, a user each
    con.execute(f"""COPY (WITH n AS (SELECT row_number() OVER () AS user_id, * FROM range(5) a(purchase), range(1, 8) b(view), range(8) c(error), range(1, 6) d(click), range(2) e(signup)),
      e AS (SELECT user_id, kind AS event_type, unnest(range(n)) AS i FROM (UNPIVOT n ON {", ".join(kinds)} INTO NAME kind VALUE n))
      SELECT row_number() OVER () AS event_id, user_id, event_type FROM e) TO '{path}'""")
    con.execute(f"CREATE VIEW events AS FROM '{path}'")
    for name in ("a14_health", "a14_health_score"):
        got = {r.user_id: r.score for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == dict(con.sql(f"SELECT user_id, score FROM ({ORACLE_SQL[name]})").fetchall()), name
