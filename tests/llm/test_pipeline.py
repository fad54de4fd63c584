"""The pipeline against a plain version of its stages, and its stages on odd tables."""

from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from ledgerlens.llm import langid, queries, simhash, tokens
from test_mixing import plain_targets

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().split()


def test_run_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    assert len(texts) == docs.count()
    # Language: exact trigram sets in place of the filters.
    shares = defaultdict(Counter)
    learned = {r.doc_id: r.lang for r in docs.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1) & F.col("lang").isNotNull()).collect()}
    for i, lang in learned.items():
        shares[lang].update(langid.trigrams(texts[i]).tolist() if texts[i] else [])
    total = {x: sum(n.values()) for x, n in shares.items()}
    most = Counter()
    for x, n in shares.items():
        for g, k in n.items():
            most[g] = max(most[g], k / total[x])
    sets = {x: {g for g, k in n.items() if k / total[x] >= langid.KEEP * most[g]} for x, n in shares.items()}
    share = {}
    for i, t in texts.items():
        own = langid.trigrams(t).tolist() if t else []
        share[i] = max((sum(g in s for g in own) / len(own) for s in sets.values()), default=0) if own else 0
    told = [i for i, s in share.items() if s >= P.LEAST_LANGUAGE_SHARE]
    assert all(abs(s - P.LEAST_LANGUAGE_SHARE) > 0.02 for s in share.values())  # no text is near the border, where filters may differ
    # Quality: the rules in SQL.
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op8_quality_rules']}) WHERE kept").fetchall()}
    clean = sorted(i for i in told if i in good)
    # Near copies: all pairs.
    fps = {i: simhash.fingerprints(texts[i], 5, several=P.FINGERPRINTS) for i in clean}
    root = {i: i for i in clean}
    shingles = {i: set(simhash.shingle_set(texts[i], 5).tolist()) for i in clean}
    alike = lambda i, j: len(shingles[i] & shingles[j]) >= P.LEAST_JACCARD * len(shingles[i] | shingles[j])
    changed = True
    while changed:
        changed = False
        for i in clean:
            for j in clean:
                if root[i] != root[j] and alike(i, j) and any(((x ^ y) & (2**64 - 1)).bit_count() <= P.NEAR_BITS for x, y in zip(fps[i], fps[j])):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    single = {i for i in clean if root[i] == i}
    # Mixing and packing, by what must hold of any mix and packing.
    out = P.run(spark, SF).collect()
    pieces = Counter((r.doc_id, r.piece) for r in out)
    assert {i for i, _ in pieces} <= single
    times = {i: pieces[i, 0] for i in single}
    sizes, taken = Counter(), Counter()
    for i in single:
        sizes[source[i]] += len(words(texts[i]))
        taken[source[i]] += times[i] * len(words(texts[i]))
        assert times[i] <= 3
    longest = max(len(words(texts[i])) for i in single)
    assert all(abs(taken[s] - t) <= longest for s, t in plain_targets(sizes).items())
    lib, length, bins = Tokenizer.from_file(tokens.default_tokenizer()), Counter(), defaultdict(list)
    for r in out:
        length[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    for i in {r.doc_id for r in out}:
        assert length[i] == times[i] * (len(lib.encode(texts[i], add_special_tokens=False).ids) + 1)
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.1 * sum(length.values()) / 2048 + 2


def test_stages_take_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, docs.first().text, None, None, None), (1, None, "en", "a", 0), (1, "", "en", "a", 0), (1, None, "en", "a", 0)], docs.schema)
    names = "fp node key host size quality found taken digest pattern u id mark h1 copies which".split()
    more = docs.unionByName(odd).unionByName(docs.limit(3)).withColumns({n: F.lit("x") for n in names})
    for name, stage in P.STAGES:
        for table in (more, more.filter("false")):
            got = stage(spark, table, SF)
            if name == P.STAGES[-1][0]:
                assert "sequence_id" in got.columns
            else:
                assert got.columns == table.columns and got.schema == table.schema
            assert got.count() >= 0
    told = P.language_id(spark, more, SF)
    assert told.filter("text is null or text = ''").count() == 0 and told.filter("doc_id is null").count() == 1
