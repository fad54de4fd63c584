"""URL filters: explicit rules by host and path, then a ratio of two character language models.

The rules also label URLs for the models: URLs that a rule allows are the accepted, those that one blocks the rejected. Each
model is a variable-order Markov model over the bytes of host and path: it knows how often a byte follows each context of length
0 to ``ORDER``, over all labelled URLs, and is smoothed from order to order. A byte's probability depends on the window of that
byte and the ``ORDER`` before it, so Spark counts windows exactly, derives the counts of all shorter ones and of the contexts from
them, and values each distinct window once by joins; what is gathered grows with the distinct windows of the corpus. A URL's
value is the log-likelihood difference of the two models, accepted less rejected, divided by its length.

The values of the ``TABLE`` most frequent windows are broadcast; a window that is not among them is joined. Hot windows are by
definition in that table, so the join has none.

A URL is blocked if its value is below a threshold, calibrated so that at most ``MISSED`` of the accepted URLs fall below it. For that each accepted URL is valued by models that have not counted any accepted one of its host (``FOLDS``-fold).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

ORDER, SMOOTH, MISSED, FOLDS = 4, 2.0, 0.01, 4
TABLE = 200_000

Rule = tuple[str, str]  # verdict, host followed by path


def host_of(url: str) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty for null and without ://."""
    raw = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """From the host's end up to ? # or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        cut = rule.index("/") if "/" in rule else len(rule)
        own, start = rule[:cut], rule[cut:]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: What a URL counts for: FOLDS * label + fold for a labelled one (label 0 rejected, 1 accepted), else NO_LABEL.
NO_LABEL = 2 * FOLDS


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of windows, its end mark included, and all texts' windows: a byte after the ``ORDER`` before it."""
    raw = [t.encode() + b"\n" for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(bytes(ORDER) + r for r in raw), np.uint8).astype(np.int64)
    at = np.arange(sizes.sum()) + ORDER * (np.repeat(np.arange(len(raw)), sizes) + 1)
    out = np.zeros(len(at), dtype=np.int64)
    for k in range(ORDER, -1, -1):
        out = out << 8 | data[at - k]
    return sizes, out


def count_windows(rows: DataFrame) -> DataFrame:
    """(window, seen, c0, c1, ...): occurrences of each distinct window in the texts ``t``, in all and by ``part``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, found = windows(list(batch["t"]))
            keys, n = np.unique(np.stack((np.repeat(batch["part"].to_numpy(), sizes), found)), axis=1, return_counts=True)
            yield pd.DataFrame({"part": keys[0].astype(np.int32), "window": keys[1], "n": n})

    counted = rows.select("t", "part").mapInPandas(count, "part int, window long, n long")
    parts = [F.coalesce(F.sum(F.when(F.col("part") == i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(NO_LABEL)]
    return counted.groupBy("window").agg(F.sum("n").alias("seen"), *parts)


def window_values(counts: DataFrame) -> DataFrame:
    """(window, seen, d, d0, d1, ...): each window's log-likelihood difference, by all counts and without those of a fold."""
    labels, joined = [f"c{i}" for i in range(NO_LABEL)], counts.select("window", "seen")
    sums = lambda df, key, k, kind: df.groupBy(key.alias(f"{kind}{k}")).agg(*[F.sum(x).alias(f"{kind}{k}_{x}") for x in labels])
    for k in range(ORDER + 1):
        own = F.col("window").bitwiseAND((1 << 8 * (k + 1)) - 1)
        context = F.shiftrightunsigned(own, 8)
        for kind, key in (("after", own), ("before", context)):
            found = sums(counts, key, k, kind)
            length = k + (kind == "after")  # bytes of the key: short ones have 256 ** length values at most
            joined = joined.withColumn(f"{kind}{k}", key).join(F.broadcast(found) if length <= 2 else found, f"{kind}{k}").drop(f"{kind}{k}")

    def value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = {(kind, k): batch[[f"{kind}{k}_{x}" for x in labels]].to_numpy(dtype=np.float64) for kind in ("after", "before") for k in range(ORDER + 1)}
            yield pd.DataFrame({"window": batch["window"], "seen": batch["seen"], **{name: log_ratio(n, left_out) for name, left_out in VALUES.items()}})

    return joined.mapInPandas(value, "window long, seen long, " + ", ".join(f"{x} double" for x in VALUES))


#: Value columns, and the fold that each leaves out.
VALUES = {"d": None} | {f"d{f}": f for f in range(FOLDS)}


def log_ratio(n: dict[tuple[str, int], np.ndarray], left_out: int | None) -> np.ndarray:
    """From counts by (kind, order), each windows x parts: log of the accepted model's probability over the rejected one's."""
    logs = []
    for label in (0, 1):
        parts = [FOLDS * label + f for f in range(FOLDS) if f != left_out]
        p = np.full(len(n["after", 0]), 1 / 256)
        for k in range(ORDER + 1):
            p = (n["after", k][:, parts].sum(axis=1) + SMOOTH * p) / (n["before", k][:, parts].sum(axis=1) + SMOOTH)
        logs.append(np.log(p))
    return logs[1] - logs[0]


def differences(rows: DataFrame, values: DataFrame, which: Column, table: int | None = None) -> DataFrame:
    """``rows`` with ``difference``: the mean value of the windows of ``t``, by the value column of the number ``which``.

    ``values`` should be a written table. Of texts with windows beyond the broadcast ones, those windows are joined, once for each
    distinct text.
    """
    table = table or TABLE
    known = values.orderBy(F.desc("seen"), "window").limit(table).toPandas().sort_values("window")
    shared = rows.sparkSession.sparkContext.broadcast((known["window"].to_numpy(), known[list(VALUES)].to_numpy(dtype=np.float64)))

    @F.pandas_udf("total double, size long, rest array<long>")
    def look_up(texts: pd.Series, which: pd.Series) -> pd.DataFrame:
        keys, own = shared.value
        sizes, found = windows(list(texts))
        at = np.searchsorted(keys, found)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == found[hit]
        text = np.repeat(np.arange(len(sizes)), sizes)
        column = which.to_numpy()[text]
        totals = np.bincount(text[hit], weights=own[at[hit], column[hit]], minlength=len(sizes))
        rest = np.split(found[~hit], np.cumsum(np.bincount(text[~hit], minlength=len(sizes)))[:-1]) if (~hit).any() else [None] * len(sizes)
        return pd.DataFrame({"total": totals, "size": sizes, "rest": rest})

    looked = rows.withColumn("which", which).withColumn("found", look_up("t", "which"))
    if values.count() <= table:
        return looked.withColumn("difference", F.col("found.total") / F.col("found.size")).drop("which", "found")
    missing = looked.filter(F.size("found.rest") > 0).select("t", "which", "found.rest").dropDuplicates(["t", "which"])
    exploded = missing.select("t", "which", F.explode("rest").alias("window")).join(values, "window")
    more = exploded.groupBy("t", "which").agg(F.sum(F.element_at(F.array(*VALUES), F.col("which") + 1)).alias("more"))
    joined = looked.join(more, ["t", "which"], "left")
    return joined.withColumn("difference", (F.col("found.total") + F.coalesce("more", F.lit(0.0))) / F.col("found.size")).drop("which", "found", "more")


def fold_of(accepted: Column) -> Column:
    """Accepted URLs (columns host and t) are left out with all those of their host, others one by one.

    So an accepted URL is valued as if its host were only known for what is rejected there, if anything: the hardest case.
    """
    return F.pmod(F.xxhash64(F.when(accepted, F.col("host")).otherwise(F.col("t"))), F.lit(FOLDS)).cast("int")


def threshold_of(accepted: DataFrame) -> float:
    """Where a share ``MISSED`` of accepted URLs is expected to lie below, by two estimates, of which the lower one holds.

    One is the k-th least ``difference`` of n, for k the whole part of (n + 1) * ``MISSED``: another such URL lies below it with a
    chance of k / (n + 1) at most, whatever the distribution. It takes 1 / ``MISSED`` URLs. The other carries the tail on, for any
    n: the distances of the least values from the m-th, for m the root of n, are taken for exponential.
    """
    n = accepted.count()
    m, k = math.ceil(math.sqrt(n)), math.floor(MISSED * (n + 1) + 1e-9)
    edge = accepted.agg(F.percentile_approx("difference", m / n, 100_000)).first()[0]
    spread = accepted.agg(F.sum(F.greatest(F.lit(0.0), edge - F.col("difference")))).first()[0] / max(1, m - 1)
    tail = edge - spread * math.log(max(1.0, m / (n * MISSED)))
    return min(tail, accepted.agg(F.percentile_approx("difference", k / n, 100_000)).first()[0]) if k else tail


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id") -> DataFrame:
    """Per row: key, host, path, rule, verdict, difference.

    Null URLs and URLs without :// have empty host and path and are judged like any other without a rule; ties between rules
    cannot occur, as the longest fitting rule of a host and path is one; without rejected or without accepted URLs nothing can be
    compared, and every URL without a rule is allowed; repeated rows are judged alike and count as often as they occur; an empty table gives no rows;
    other columns are left out, so their names cannot clash.
    """
    parsed = pages.select(F.col(key).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parsed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("t", F.concat("host", "path"))
    accepted = F.col("r.verdict") == "allow"
    fold = fold_of(accepted)
    part = F.when(F.col("r").isNull(), NO_LABEL).otherwise(F.when(accepted, FOLDS).otherwise(0) + fold)
    values = materialise(window_values(materialise(count_windows(ruled.withColumn("part", part)), "windows")), "values")
    scored = differences(ruled, values, F.lit(0))
    both = ruled.agg(F.count_if(accepted), F.count_if(F.col("r.verdict") == "block")).first()
    threshold = threshold_of(differences(ruled.filter(accepted), values, fold + 1)) if all(both) else -math.inf
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("difference") < threshold, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(key), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "difference")
