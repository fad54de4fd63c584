"""Mixing sources to target weights by a min-cost flow between membership patterns and sources.

Documents are aggregated by the set of sources they belong to. Each pattern can send its words once for free, a second time
at a cost and a third time at a higher one; each source takes up to its target. As only the arcs into patterns cost
anything, and more with each repetition, augmenting paths over the first repetition, then the second, then the third, are
the successive shortest paths of the min-cost flow. Where no document has several sources, the flow is one arc for each source
and Spark sends it as it stands, however many sources there are; only patterns with several sources, and the sources they
touch, are routed on the driver, in numbers that follow the overlaps and not the documents.

The flow gives each pattern a number of words: all its documents as often as fits, and a seeded choice of documents once more.
That choice is a threshold on a seeded hash of key, text and copy (rows of the same key, text and sources are numbered), found by counting in ever finer ranges of the hash, for all patterns at
once, so no pattern, however large, is sorted or gathered; only its last range (``LAST_RANGE`` keys or so) is walked in hash
order, taking whatever still fits.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, broadcast_few, fresh, in_order, materialise

LAST_RANGE = 1000
DIGIT = 6


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3) -> DataFrame:
    """Sources (``source``, ``size``) with ``target``: shares of all words by the weights, dealt in code-point order, null last;
    what exceeds ``most`` times a source's size is shared again by weight among the others.

    Shares only grow while excess is dealt out, so a source at its limit stays there: each round is one sum over the sources.
    """
    placed = materialise(in_order(sizes, "source", "place").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)), "weights")
    limit, share = most * F.col("size"), 0.0
    while True:
        over = limit < share * F.col("weight")
        total, fixed, free = placed.agg(F.sum("size"), F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        again = (total - fixed) / free if free else share
        if again <= share:
            return placed.select("source", "size", F.least(limit, share * F.col("weight")).cast("double").alias("target"))
        share = again


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = 3) -> dict[tuple, int]:
    """Words that each pattern (a tuple of sources, with the words of its documents) sends in all."""
    flow: dict[tuple, dict] = {p: defaultdict(int) for p in patterns}
    sent, need = dict.fromkeys(patterns, 0), {s: round(q) for s, q in quotas.items()}
    members = defaultdict(list)
    for p in patterns:
        for s in p:
            members[s].append(p)
    for repeat in range(1, repeats + 1):
        for start in sorted(patterns, key=repr):
            while (spare := repeat * patterns[start] - sent[start]) > 0:
                came: dict = {("p", start): None}  # breadth first over what is still free
                queue, goal = deque(came), None
                while queue and goal is None:
                    kind, x = queue.popleft()
                    for to in [("s", s) for s in x] if kind == "p" else [("p", p) for p in members[x] if flow[p][x] > 0]:
                        if to not in came:
                            came[to] = (kind, x)
                            queue.append(to)
                            if to[0] == "s" and need[to[1]] > 0:
                                goal = to
                                break
                if goal is None:
                    break
                steps, at = [], goal
                while came[at] is not None:
                    steps.append((came[at], at))
                    at = came[at]
                amount = min([spare, need[goal[1]], *(flow[b[1]][a[1]] for a, b in steps if a[0] == "s")])
                for a, b in steps:
                    if a[0] == "p":
                        flow[a[1]][b[1]] += amount
                    else:
                        flow[b[1]][a[1]] -= amount
                sent[start] += amount
                need[goal[1]] -= amount
    return sent


def _flow(patterns: DataFrame, quotas: DataFrame, repeats: int) -> DataFrame:
    """(pattern, whole, rest): how often a pattern goes whole, and the words that it sends beyond that."""
    spark = patterns.sparkSession
    single = F.size("members") == 1
    alone = patterns.filter(single).join(quotas.select("source", "target"), F.element_at("members", 1).eqNullSafe(F.col("source")))
    sent = alone.select("pattern", "size", F.least(repeats * F.col("size"), F.round("target").cast("long")).alias("sent"))
    shared = patterns.filter(~single)
    if not shared.isEmpty():
        touched = shared.select(F.explode("members").alias("source")).distinct()
        own = quotas.join(F.broadcast(touched), quotas.source.eqNullSafe(touched.source), "left_semi").collect()
        near = patterns.join(F.broadcast(touched), F.exists("members", lambda m: m.eqNullSafe(F.col("source"))), "left_semi").collect()
        routed = route({tuple(r.members): r.size for r in near}, {r.source: r.target for r in own}, repeats)
        rows = [(r.pattern, r.size, routed[tuple(r.members)]) for r in near]
        found = spark.createDataFrame(rows, "pattern string, size long, sent long")
        sent = sent.join(F.broadcast(found.select("pattern")), "pattern", "left_anti").unionByName(found)
    whole = F.when(F.col("size") > 0, F.expr("sent div size")).otherwise(0)
    return sent.select("pattern", whole.alias("whole"), (F.col("sent") - whole * F.col("size")).alias("rest"))


def _choose(rows: DataFrame, flow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, whole, shift, range): hashes below the range go once more; and (pattern, u): those of the range that do."""
    counted = rows.groupBy("pattern").agg(F.count("*").alias("n"))
    state = flow.join(counted, "pattern").select("pattern", "whole", "rest", F.lit(63).alias("shift"), F.lit(0).cast("long").alias("range"), "n")
    state = materialise(state.withColumn("n", F.when(F.col("rest") > 0, F.col("n")).otherwise(0)), "state")
    coarse = (F.col("n") > LAST_RANGE) & (F.col("shift") > 0)
    inside = F.expr("shiftright(u, shift) = range")
    while not state.filter(coarse).isEmpty():
        own = rows.join(broadcast_few(state.filter(coarse)), "pattern").filter(inside)
        finer = F.greatest(F.col("shift") - DIGIT, F.lit(0)).cast("int")
        digits = own.groupBy("pattern", "rest", finer.alias("shift"), F.expr("shiftright(u, greatest(shift - %d, 0))" % DIGIT).alias("digit")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        # A pattern has 2 ** DIGIT rows here at most.
        upto = digits.withColumn("upto", F.sum("size").over(Window.partitionBy("pattern").orderBy("digit")))
        broken = F.col("upto") > F.col("rest")
        first = F.min(F.when(broken, F.struct("digit", "n", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))))
        ends = upto.groupBy("pattern", "shift").agg(first.alias("at"), F.max("digit").alias("last"), F.first("rest").alias("rest"), F.sum("size").alias("all"))
        new = ends.select("pattern", "shift", F.coalesce("at.digit", F.col("last") + 1).alias("range"), F.coalesce("at.n", F.lit(0)).alias("n"), F.coalesce("at.rest", F.col("rest") - F.col("all")).alias("rest"))
        moved = state.filter(coarse).select("pattern", "whole").join(new, "pattern").select(state.columns)
        state = materialise(state.filter(~coarse).unionByName(moved), "state")
    last = rows.join(broadcast_few(state.filter((F.col("rest") > 0) & (F.col("n") > 0))), "pattern").filter(inside).groupBy("pattern", "rest", "u").agg(F.sum("size").alias("size"))
    step = lambda s, x: F.when(x["size"] <= s.rest, F.struct((s.rest - x["size"]).alias("rest"), F.array_append(s.us, x.u).alias("us"))).otherwise(s)
    walked = last.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("u", "size"))).alias("keys"), F.max("rest").alias("left"))
    start = F.struct(F.col("left").alias("rest"), F.array().cast("array<long>").alias("us"))
    picks = walked.select("pattern", F.explode(F.aggregate("keys", start, step).us).alias("u"))
    return state, materialise(picks.withColumn("pick", F.lit(1)), "picks")


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", sources: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 7) -> DataFrame:
    """Per row: key, size, source_size and target (of the first of its sources by code point), taken (a multiple of size).

    ``sources`` is an array column; by default it holds the column ``source`` alone, and a null is a source of its own; a row whose
    array is null or empty belongs to none: it takes nothing, and its source_size and target are null. Null and empty texts have
    size 0 and take nothing; rows with the same key, or none, and even repeated rows are chosen one by one, so the rows of a key that
    holds a third of a source are not taken all or none; an empty table gives no rows; other columns are left out, so their names cannot clash. Reruns agree.
    """
    told, names = numbered(docs, text, key, sources)
    return _mixed_rows(told, names, text, key, sources, weights, repeats, seed).select(F.col("id").alias(key), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def pattern_of(sources: Column) -> Column:
    """A row's set of sources, as text."""
    return F.to_json(F.sort_array(F.array_distinct(sources), asc=True))


def numbered(docs: DataFrame, text: str, key: str, sources: Column | None) -> tuple[DataFrame, list[str]]:
    """The rows with two hashes of their text, the first also of their sources, and the number of their copy (from 0), and those
    columns' names.

    Only rows that share key, text and sources need numbers; they are numbered within their partition of a written table and moved on by
    the counts of the partitions before, so the copies of a row, however many, are never in one task.
    """
    names = [fresh(docs, x) for x in ("mark1", "mark2", "copy")]
    own = [key, *names[:2]]
    members = pattern_of(F.array("source") if sources is None else sources)
    told = docs.withColumns({names[0]: F.xxhash64(F.lit(0), text, members), names[1]: F.xxhash64(F.lit(1), text)})
    several = materialise(told.select(*own).groupBy(*own).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "several")
    if several.isEmpty():
        return told.withColumn(names[2], F.lit(0).cast("long")), names
    same = lambda a, b: (a[own[0]].eqNullSafe(b[own[0]])) & (a[own[1]] == b[own[1]]) & (a[own[2]] == b[own[2]])
    part, local, before = fresh(told, "part"), fresh(told, "local"), fresh(told, "before")
    hot = told.join(several, same(told, several), "left_semi").withColumn(part, F.spark_partition_id()).withColumn(local, F.monotonically_increasing_id())
    hot = materialise(hot, "copies")
    w = Window.partitionBy(*own, part).orderBy(local)
    counts = hot.groupBy(*own, part).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*own).orderBy(part)) - F.col("n")  # a row for each partition
    counts = materialise(counts.select(*own, part, upto.alias(before)), "offsets")
    placed = hot.withColumn(local, F.row_number().over(w))
    moved = placed.join(counts, same(placed, counts) & (placed[part] == counts[part]))
    moved = moved.select(*[placed[x] for x in told.columns], (F.col(local) + F.col(before) - 1).cast("long").alias(names[2]))
    single = told.join(several, same(told, several), "left_anti").withColumn(names[2], F.lit(0).cast("long"))
    return single.unionByName(as_required(moved, single.schema)), names


def as_required(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows that were written and read again, with the columns that can't be null known as such."""
    known = (T.NumericType, T.StringType, T.BooleanType)
    sure = {f.name for f in schema if not f.nullable and isinstance(f.dataType, known)}
    return df.select(*[F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name) if f.name in sure else F.col(f.name) for f in schema])


def _mixed_rows(docs: DataFrame, names: list[str], text: str, key: str, sources: Column | None, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 7) -> DataFrame:
    """id, mark1, mark2, copy, pattern, size, source_size, target, times, of rows that are ``numbered``."""
    sources = F.array("source") if sources is None else sources
    m1, m2, copy = map(F.col, names)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")), m1, m2, copy), 1)
    rows = docs.select(F.col(key).alias("id"), m1.alias("mark1"), m2.alias("mark2"), copy.alias("copy"), F.coalesce(pattern_of(sources), F.lit("[]")).alias("pattern"), word_count(text).alias("size"), u.alias("u"))
    rows = materialise(rows, "mix")
    patterns = materialise(rows.groupBy("pattern").agg(F.sum("size").alias("size")).withColumn("members", F.array_sort(F.from_json("pattern", "array<string>"))), "patterns")
    owned = patterns.filter(F.size("members") > 0)
    sizes = owned.select(F.explode("members").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    quotas = materialise(targets(sizes, weights, repeats), "quotas")
    state, picks = _choose(rows, materialise(_flow(owned, quotas, repeats), "flow"))
    facts = owned.select("pattern", F.element_at("members", 1).alias("own")).join(quotas, F.col("own").eqNullSafe(F.col("source")))
    facts = materialise(facts.select("pattern", F.col("size").alias("source_size"), "target"), "facts")
    beyond = F.expr("case when shift < 63 and shiftright(u, shift) < range then 1 else 0 end") + F.coalesce("pick", F.lit(0))
    taken = F.when(F.col("size") > 0, F.least(F.coalesce(F.col("whole") + beyond, F.lit(0)), F.lit(repeats))).otherwise(0)
    chosen = rows.join(broadcast_few(state.select("pattern", "whole", "shift", "range")), "pattern", "left").join(broadcast_few(facts), "pattern", "left").join(broadcast_few(picks), ["pattern", "u"], "left")
    return chosen.select("id", "mark1", "mark2", "copy", "pattern", "size", "source_size", "target", taken.cast("int").alias("times"))


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", sources: Column | None = None, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it (0 to 3 times), with all their columns.

    Rows find their repeats by key, text, sources and number of their copy.
    """
    told, names = numbered(docs, text, key, sources)
    rows = _mixed_rows(told, names, text, key, sources, **options).filter("times > 0")
    k, m1, m2, copy, t = [fresh(told, f"mix_{x}") for x in ("key", "mark1", "mark2", "copy", "times")]
    rows = rows.select(F.col("id").alias(k), F.col("mark1").alias(m1), F.col("mark2").alias(m2), F.col("copy").alias(copy), F.col("times").alias(t))
    same = F.col(key).eqNullSafe(F.col(k)) & (F.col(names[0]) == F.col(m1)) & (F.col(names[1]) == F.col(m2)) & (F.col(names[2]) == F.col(copy))
    joined = told.filter(F.col(text).rlike(WORD)).join(broadcast_few(materialise(rows, "times")), same)
    return joined.withColumn(t, F.explode(F.sequence(F.lit(1), F.col(t)))).select(*docs.columns)
