"""Lifecycle as whole-table operators: status changes, feedback, erasure with receipts, credits, scope rules, packet status.

Each takes many requests at once and returns what becomes of every one; nothing is looped over on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col

#: The status graph, from -> allowed targets; and the ratings of a feedback.
TRANSITIONS = {"candidate": "active superseded disputed disabled deleted", "active": "superseded disputed disabled deleted", "superseded": "disputed deleted", "disputed": "active superseded disabled deleted", "disabled": "active deleted"}
RATINGS = ("useful", "irrelevant", "incorrect")
ALLOWED = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs.split()]


def is_legal(status: Column, target: Column) -> Column:
    """Whether the status graph has this change; false if either is null."""
    return F.concat_ws(">", status, target).isin(ALLOWED)


def change_status(facts: DataFrame, wanted: DataFrame, now: Column, key: str = "fact_id") -> DataFrame:
    """The facts after the wanted changes (key, target; at most one a fact), and ``error``.

    A legal change sets the status, raises the version and at a deletion sets ``recorded_to``; an illegal one leaves the fact
    as it is and is named in ``error``.
    """
    legal, target = is_legal(c("status"), c("target")), c("target")
    new = {
        "status": F.when(legal, target).otherwise(c("status")),
        "version": c("version") + legal.cast("int"),
        "recorded_to": F.when(legal & (target == "deleted"), now).otherwise(c("recorded_to")),
    }
    kept = [new[x].alias(x) if x in new else c(x) for x in facts.columns]
    return facts.join(wanted.select(key, "target"), key, "left").select(*kept, F.when(target.isNotNull() & ~legal, "illegal_status_transition").alias("error"))


def judge_feedback(feedback: DataFrame, facts: DataFrame) -> DataFrame:
    """Of each feedback (feedback_id, project_id, fact_id, trace_id, rating): its error, or the fact's status after it.

    It names one fact or one trace; a fact of another project is not found. The first valid ``incorrect``, in order of ids,
    disputes a fact whose status allows it; later ones, of any rating, find it disputed.
    """
    rows = feedback.join(facts.select("fact_id", c("project_id").alias("owner"), "status"), "fact_id", "left")
    about_fact = c("fact_id").isNotNull()
    error = F.when(~F.coalesce(c("rating").isin(*RATINGS), F.lit(False)), "invalid_rating").when(about_fact == c("trace_id").isNotNull(), "not_one_target").when(about_fact & ~c("owner").eqNullSafe(c("project_id")), "fact_not_found")
    rows = rows.withColumn("error", error)
    disputing = rows.filter("error is null").filter((c("rating") == "incorrect") & is_legal(c("status"), F.lit("disputed")))
    since = disputing.groupBy("fact_id").agg(F.min("feedback_id").alias("since"))
    after = F.when(c("error").isNull() & about_fact, F.when(c("feedback_id") >= c("since"), "disputed").otherwise(c("status")))
    return rows.join(since, "fact_id", "left").select("feedback_id", "error", after.alias("fact_status"))


def erase(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows whose key is in ``gone``, and a receipt for each such key: the rows that each table loses."""
    gone = gone.select(key).distinct()
    lost = None
    for name, t in tables.items():
        own = t.select(key).join(gone, key, "left_semi").groupBy(key).agg(F.count("*").alias("n")).withColumn("of", F.lit(name))
        lost = own if lost is None else lost.unionByName(own)
    sums = lost.groupBy(key).agg(*[F.sum(F.when(c("of") == name, c("n"))).alias(name) for name in tables])
    receipts = gone.join(sums, key, "left").select(key, *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in tables])
    return {name: t.join(gone, key, "left_anti") for name, t in tables.items()}, receipts


def disable_subjects(facts: DataFrame, subjects: DataFrame, now: Column, key: str = "fact_id", subject: str = "subject_id") -> DataFrame:
    """The facts with those of the subjects that are active or candidates disabled."""
    own = facts.filter(c("status").isin("active", "candidate")).join(subjects.select(subject).distinct(), subject, "left_semi")
    return change_status(facts, own.select(key, F.lit("disabled").alias("target")), now, key)


def lazy_grants(captures: DataFrame, org: str, at: str, days: int = 30) -> DataFrame:
    """When each organisation gets its free credits: at its first capture, and at the first one ``days`` after the last grant.

    One pass over the captures in order: a task remembers its organisation's last grant and nothing else.
    """
    kinds = dict(captures.dtypes)
    moments = captures.select(c(org).alias("org"), F.unix_micros(c(at).cast("timestamp")).alias("at")).distinct().repartition("org").sortWithinPartitions("org", "at")

    def grants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_org, last = None, 0
        for batch in batches:
            out = []
            for own, moment in zip(batch["org"], batch["at"]):
                if own != last_org or moment >= last + days * 86_400_000_000:
                    out.append((own, moment))
                    last_org, last = own, moment
            yield pd.DataFrame(out, columns=["org", "at"])

    granted = moments.mapInPandas(grants, f"org {kinds[org]}, at long")
    return granted.select(c("org").alias(org), F.timestamp_micros("at").cast(kinds[at]).alias("granted_at"))


def debit_captures(captures: DataFrame, org: str, order: list[str], grant: str) -> DataFrame:
    """Adds ``debited`` and ``balance_after``: every capture first gets its grant, then costs one credit if there is one.

    A balance that stops at zero is a running sum less its lowest point so far, so windows of one partitioning do.
    """
    w = W.partitionBy(org).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    sums = captures.withColumn("_sum", F.sum(c(grant) - 1).over(upto)).withColumn("_low", F.least(F.min("_sum").over(upto), F.lit(0)))
    debited = c("_sum") >= F.lag("_low", 1, 0).over(w)
    return sums.withColumn("debited", debited).withColumn("balance_after", c("_sum") - c("_low")).drop("_sum", "_low")


def org_uuid(org: Column) -> Column:
    """The UUID of a provisioned organisation's id (``org_`` and a UUID in any usual spelling), else null."""
    digits = F.regexp_replace(F.substring(org, 5, 1000), r"urn:|uuid:|^\{|\}$|-", "")
    dashed = F.regexp_replace(F.lower(digits), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(org.startswith("org_") & digits.rlike("^[0-9a-fA-F]{32}$"), dashed)


def judge_scope(project: Column, key_project: Column, subject: Column, purpose: Column) -> Column:
    """Of a request: ``deny: forbidden_scope`` for a project that is not its key's, ``deny: missing_scope`` without a subject,
    ``warn: missing_purpose``, or ``allow``."""
    given = lambda x: x.isNotNull() & (x != "")
    return F.when(given(project) & ~project.eqNullSafe(key_project), "deny: forbidden_scope").when(~given(subject), "deny: missing_scope").when(~given(purpose), "warn: missing_purpose").otherwise("allow")


def packet_status(decisions: DataFrame, aliases: DataFrame, floor: float, query: str = "query_id", subject: str = "subject_id") -> DataFrame:
    """Of each query: its included rows, its warnings in order, ``ok`` or ``degraded``, and why it is empty.

    ``decisions`` has action and reason_code; ``aliases`` (alias_value, alias_kind, canonical_subject_id) tells an empty packet
    of a subject whose memory lies under another id from a subject without any.
    """
    why, included = c("reason_code"), c("action") == "included"
    n = decisions.groupBy(query, subject).agg(F.count_if(included).alias("n_included"), F.count_if(why == "conflict_open").alias("hidden"), F.count_if(included & (why == "conflict_disputed")).alias("disputed"), F.count_if(why == "below_relevance_floor").alias("below"))
    moved = aliases.filter("alias_value <> canonical_subject_id").groupBy(c("alias_value").alias(subject)).agg(F.min(F.struct("alias_kind", "canonical_subject_id")).alias("to"))
    n = n.join(moved, subject, "left")
    warnings = F.array_compact(F.array(
        F.when((c("n_included") == 0) & c("to").isNotNull(), F.format_string("identity_fragmentation: %s alias of %s", c("to.alias_kind"), c("to.canonical_subject_id"))),
        F.when(c("hidden") > 0, F.format_string("open_conflict: %d fact(s) hidden", c("hidden"))),
        F.when(c("disputed") > 0, F.format_string("open_conflict: %d fact(s) served with an unresolved value", c("disputed"))),
    ))
    empty = F.when((c("n_included") == 0) & (c("below") > 0) & F.lit(floor > 0), "no_relevant_memory")
    return n.withColumn("warnings", warnings).select(query, subject, "n_included", "warnings", F.when(F.size("warnings") > 0, "degraded").otherwise("ok").alias("status"), empty.alias("empty_reason"))


def look_up(requests: DataFrame, rows: DataFrame, key: str, scope: str, missing: str) -> DataFrame:
    """Each request (key, scope) with the row's columns, or the error ``missing`` if there is none or it has another scope."""
    known = rows.withColumnRenamed(scope, "_scope").withColumn("_found", F.lit(True))
    found = F.coalesce(c("_found"), F.lit(False)) & c(scope).eqNullSafe(c("_scope"))
    shown = [F.when(found, c(x)).alias(x) for x in rows.columns if x not in (key, scope)]
    return requests.join(known, key, "left").select(*requests.columns, *shown, F.when(~found, missing).alias("error"))
