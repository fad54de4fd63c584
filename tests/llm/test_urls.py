"""The URL language models against a plain version, and their calibration on URLs that were not counted."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import urls
from ledgerlens.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, id string, t string, part string, which string, r string"
MADE = ["http://a.net/de/1", "http://a.net/de/1", "http://b.net/de/22.html", "http://c.com/en/1", "http://d.com/en/9/", "http://é.org/fr/1", "http://e.com/de/4", "", None]


def pages_of(spark, made):
    return spark.createDataFrame([(i, u, "x", "x", "x", "x", "x") for i, u in enumerate(made)], SCHEMA)


def plain(spark, made, fold_left_out=None):
    """text -> (label, fold) and a function from text to its difference, by counts in dictionaries."""
    parsed = pages_of(spark, made).select(urls.host_of("url").alias("h"), urls.path_of("url").alias("p"))
    ruled = parsed.select(F.col("h").alias("host"), F.concat("h", "p").alias("t"), urls.rule_of(F.col("h"), F.col("p"), URL_RULES).alias("r"))
    rows = ruled.withColumn("fold", urls.fold_of(F.col("r.verdict") == "allow")).collect()
    after, before = Counter(), Counter()
    for x in rows:
        if x.r and x.fold != fold_left_out:
            data = bytes(urls.ORDER) + x.t.encode() + b"\n"
            for i in range(urls.ORDER, len(data)):
                for k in range(urls.ORDER + 1):
                    after[x.r.verdict, k, data[i - k : i + 1]] += 1
                    before[x.r.verdict, k, data[i - k : i]] += 1

    def difference(text):
        data, out = bytes(urls.ORDER) + text.encode() + b"\n", 0.0
        for i in range(urls.ORDER, len(data)):
            p = dict.fromkeys(("allow", "block"), 1 / 256)
            for k in range(urls.ORDER + 1):
                for y in p:
                    assert after[y, k, data[i - k : i + 1]] <= before[y, k, data[i - k : i]]
                    p[y] = (after[y, k, data[i - k : i + 1]] + urls.SMOOTH * p[y]) / (before[y, k, data[i - k : i]] + urls.SMOOTH)
                    assert 0 < p[y] <= 1
            out += math.log(p["allow"] / p["block"])
        return out / (len(data) - urls.ORDER)

    return rows, difference


@pytest.mark.parametrize("table", [None, 5])
def test_values_match_a_plain_model(spark, monkeypatch, table):
    """With a table of 5 windows all others are joined; null, empty and repeated URLs and clashing names are among the rows."""
    if table:
        monkeypatch.setattr(urls, "TABLE", table)
    got = urls.filter_urls(pages_of(spark, MADE), URL_RULES).collect()
    rows, difference = plain(spark, MADE)
    assert len(got) == len(MADE)
    monkeypatch.setattr(urls, "MISSED", 0.5)  # so that the few URLs here have a threshold
    got = urls.filter_urls(pages_of(spark, MADE), URL_RULES).collect()
    held = sorted(plain(spark, MADE, x.fold)[1](x.t) for x in rows if x.r and x.r.verdict == "allow")
    threshold = held[math.floor((len(held) + 1) / 2) - 1]
    for x in got:
        want = difference(x.host + x.path)
        assert abs(x.difference - want) < 1e-5
        assert x.verdict == (rows[x.page_id].r.verdict if rows[x.page_id].r else "block" if want < threshold else "allow")
    assert any(x.verdict == "block" and not x.rule for x in got)


def test_few_held_out_accepted_urls_are_blocked(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url", F.col("url").alias("u"))
    t = F.concat(urls.host_of("url"), urls.path_of("url"))
    rows = pages.withColumn("r", urls.rule_of(urls.host_of("url"), urls.path_of("url"), URL_RULES)).filter("r is not null").withColumn("t", t).withColumn("host", urls.host_of("url"))
    half = F.pmod(F.xxhash64(F.lit(9), "t"), F.lit(2))
    accepted = F.col("r.verdict") == "allow"
    fold = urls.fold_of(accepted)
    blocked = n = 0
    for i in (0, 1):
        part = F.when(half != i, urls.NO_LABEL).otherwise(F.when(accepted, urls.FOLDS).otherwise(0) + fold)
        values = urls.materialise(urls.window_values(urls.count_windows(rows.withColumn("part", part))), "values")
        low = urls.threshold_of(urls.differences(rows.filter(accepted & (half == i)), values, fold + 1))
        found = [x.difference for x in urls.differences(rows.filter(accepted & (half != i)), values, F.lit(0)).collect()]
        blocked, n = blocked + sum(d < low for d in found), n + len(found)
    assert n > 150 and blocked <= 0.025 * n  # 4 of 189; 1% is aimed at for hosts like those counted


def test_without_both_labels_all_is_allowed(spark):
    got = urls.filter_urls(pages_of(spark, ["http://a.net/de/1", "http://b.org/en/1", None]), URL_RULES).collect()
    assert {x.verdict for x in got} == {"allow"}
    assert urls.filter_urls(pages_of(spark, []), URL_RULES).count() == 0


def test_few_accepted_urls_still_have_a_threshold(spark):
    """It is the least of them: nothing like them is blocked, and what looks like the rejected is."""
    good, bad = [f"http://a{i}.net/de/news/{i}" for i in range(20)], [f"http://b{i}.com/en/casino-{i}" for i in range(20)]
    asked = ["http://x.info/de/news/3", "http://y.info/en/casino-5"]
    got = {x.host: x.verdict for x in urls.filter_urls(pages_of(spark, [*good, *bad, *asked]), URL_RULES).collect() if not x.rule}
    assert got == {"x.info": "allow", "y.info": "block"}
