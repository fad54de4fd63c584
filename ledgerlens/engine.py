"""One object with the calls of the service: capture, consolidate, context, and what inspects and changes the ledger.

Every call takes and gives DataFrames and works on many requests at once. Tables are kept as base and delta files
(``sources.store``): a call adds rows and rewrites none, several writers may work at once, and ``compact`` merges now and then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import messages
from .functions.lexical import english_lexemes, english_words, simple_words
from .functions.names import entity_tokens, person_factor
from .functions.text import normalise_span, relative_day, token_estimate
from .operators import consolidation, lifecycle, merging
from .operators.candidates import candidates
from .operators.context_window import context_window
from .operators.expansion import second_hop
from .operators.indexed import build as build_indexes
from .operators.indexed import indexed_candidates
from .operators.ranking import pack_packets, relevance
from .sources.datasets import CANDIDATES
from .sources.scratch import written
from .sources.store import Store, Table

c = F.col
EVENT = "project_id string, subject_id string, event_id string, kind string, occurred_at timestamp, payload string, actor_type string, actor_id string, origin_trust string, idempotency_key string"
TABLES = {
    "events": Table(EVENT, ("project_id", "idempotency_key"), first=True),
    "chunks": Table("project_id string, subject_id string, event_id string, ordinal int, kind string, occurred_at timestamp, origin_trust string, text string, index_text string", ("project_id", "event_id", "ordinal")),
    "facts": Table(f"project_id string, subject_id string, identity string, {consolidation.FACT}", ("project_id", "fact_id")),
    "sets": Table(f"project_id string, subject_id string, identity string, {consolidation.SET}", ("project_id", "set_id")),
    "decisions": Table("project_id string, subject_id string, event_id string, ordinal int, outcome string, at timestamp", ("project_id", "event_id", "ordinal")),
    "traces": Table("trace_id string, project_id string, subject_id string, query_id long, place long, kind string, item_id string, action string, reason_code string, cost long, millis long, served_at timestamp", ("trace_id", "place")),
    "aliases": Table("project_id string, alias_kind string, alias_value string, canonical_subject_id string", tuple(merging.ALIAS_KEY)),
    "receipts": Table("receipt_id string, project_id string, subject_id string, events long, facts long, traces long, at timestamp", ("receipt_id",)),
    "merges": Table("receipt_id string, project_id string, source string, target string, events_moved long, facts_moved long, sets_moved long, traces_moved long, aliases_repointed long, at timestamp", ("receipt_id", "project_id", "source")),
    "erased": Table("project_id string, subject_id string, upto string", ("project_id", "subject_id", "upto")),
    "folded": Table("commit string", ("commit",)),
}
SCOPE = ["project_id", "subject_id"]
#: Tables whose rows belong to a subject.
OWNED = ("events", "chunks", "facts", "sets", "decisions", "traces")
#: A day's seconds, and the days after which a fact of each volatility is no longer current.
DAY, HORIZONS = 86_400, {"slow": 180, "volatile": 30, "ephemeral": 2}


class Engine:
    """The ledger under ``root``; ``now`` is a moment as text, so that a run can be repeated as of then; else the clock's."""

    def __init__(self, spark: SparkSession, root: str, now: str | None = None):
        self.spark, self.now = spark, F.lit(now).cast("timestamp") if now else F.current_timestamp()
        self.store = Store(spark, root, TABLES)

    # Tables

    def visible(self, rows: DataFrame) -> DataFrame:
        """Without what was stored of a subject before it was erased."""
        if not self.store.live("erased") or "subject_id" not in rows.columns:
            return rows
        gone = self.store.merged("erased").groupBy(*SCOPE).agg(F.max("upto").alias("upto"))
        return rows.join(gone, SCOPE, "left").filter(c("upto").isNull() | (c("_at") > c("upto"))).drop("upto")

    def table(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        return self.store.merged(name, keys, self.visible if name in OWNED else None)

    def compact(self, *names: str) -> None:
        for name in names or TABLES:
            if len(self.store.live(name)) > 1 or name in OWNED and self.store.live(name) and self.store.live("erased"):
                self.store.compact(name, self.visible if name in OWNED else None)

    # Subjects and their names

    def resolve_subject(self, rows: DataFrame) -> DataFrame:
        """Rows with the canonical subject of those that an alias names; merges keep aliases pointing at the end of their chain."""
        known = self.table("aliases").groupBy("project_id", c("alias_value").alias("subject_id")).agg(F.min("canonical_subject_id").alias("to"))
        return rows.join(known, SCOPE, "left").withColumn("subject_id", F.coalesce("to", "subject_id")).drop("to").select(rows.columns)

    def register_alias(self, aliases: DataFrame) -> DataFrame:
        """Adds aliases that are new; gives each with ``error`` (``alias_conflict`` if it already means another subject)."""
        key = merging.ALIAS_KEY
        asked = aliases.groupBy(*key).agg(F.min("canonical_subject_id").alias("canonical_subject_id"))
        known = self.table("aliases", asked).withColumnRenamed("canonical_subject_id", "known")
        judged = written(asked.join(known, key, "left").withColumn("error", F.when(c("known") != c("canonical_subject_id"), "alias_conflict")), "aliases")
        self.store.commit(aliases=judged.filter("known is null"))
        return judged.select(*key, "canonical_subject_id", "error")

    def merge_subjects(self, pairs: DataFrame) -> DataFrame:
        """Merges each ``subject_id`` of a project ``into`` another, chains to their end; gives every request with its error.

        Rows of all tables move, aliases are pointed anew, the old names stay as tombstones, and each merge has a receipt.
        """
        asked = pairs.select("project_id", c("subject_id").alias("source"), c("into").alias("target"))
        aliases = self.table("aliases")
        judged, ends = merging.plan_merges(asked, aliases)
        judged, ends = written(judged, "judged"), written(ends, "ends")
        gone = ends.select("project_id", c("source").alias("subject_id"))
        own = {name: written(self.table(name).join(gone, SCOPE, "left_semi"), name) for name in OWNED}
        done = merging.receipts(ends, {name: own[name] for name in ("events", "facts", "sets", "traces")}, aliases)
        receipts = done.select(F.lit(uuid.uuid4().hex).alias("receipt_id"), "*", self.now.alias("at"))
        changed = merging.repointed(aliases, ends).join(aliases, [*merging.ALIAS_KEY, "canonical_subject_id"], "left_anti")
        moves = {name: merging.moved(df, ends) for name, df in own.items()}
        # An event keeps its key and so its first commit's row; a merged one replaces that by a base of its own.
        events = moves.pop("events")
        self.store.commit(**moves, aliases=changed, merges=receipts)
        self._replace_events(events)
        return judged

    def _replace_events(self, changed: DataFrame) -> None:
        """Events with other subjects: the table keeps the first row of a key, so it is written anew."""
        if changed.isEmpty():
            return
        read = self.store.live("events")
        rows = self.store.merged("events", hidden=self.visible, stamps=True)
        to = changed.select("project_id", "idempotency_key", c("subject_id").alias("_to"))
        moved = rows.join(to, ["project_id", "idempotency_key"], "left").withColumn("subject_id", F.coalesce("_to", "subject_id")).drop("_to")
        self.store.commit(replaces={"events": read}, events=written(moved, "events"))

    # Writing

    def capture(self, requests: DataFrame) -> DataFrame:
        """Stores events once by their idempotency key; gives every request with its event's id and ``deduplicated``.

        Only the folders of the requests' keys are read.
        """
        named = self.resolve_subject(requests)
        trust = F.coalesce("origin_trust", F.when(c("actor_type").isin("agent", "tool", "system"), "semi_trusted").otherwise("trusted"))
        body = F.concat_ws("|", "project_id", "subject_id", "kind", c("occurred_at").cast("string"), "payload")
        key = F.coalesce("idempotency_key", F.concat_ws(":", F.sha2(body, 256), "subject_id"))
        keyed = named.withColumn("origin_trust", trust).withColumn("idempotency_key", key)
        keyed = written(keyed.withColumn("event_id", F.sha2(F.concat_ws("|", "project_id", "idempotency_key"), 256)).withColumn("_n", F.monotonically_increasing_id()), "captured")
        known = self.table("events", keyed).select("project_id", "idempotency_key", F.lit(True).alias("_old"))
        first = keyed.groupBy("project_id", "idempotency_key").agg(F.min_by(F.struct(*[x for x in TABLES["events"].columns if x not in TABLES["events"].key]), "_n").alias("e"), F.min("_n").alias("_first"))
        told = written(first.join(known, ["project_id", "idempotency_key"], "left").select("project_id", "idempotency_key", "e.*", "_first", "_old"), "first")
        self.store.commit(events=told.filter("_old is null"))
        answers = keyed.join(told.select("project_id", "idempotency_key", "_first", "_old"), ["project_id", "idempotency_key"])
        return answers.select("project_id", "subject_id", "idempotency_key", "event_id", (c("_old").isNotNull() | (c("_n") > c("_first"))).alias("deduplicated"))

    def consolidate(self, aliases: DataFrame | None = None, subjects: DataFrame | None = None, everything: bool = False, embed: Callable[[Column], Column] | None = None) -> DataFrame:
        """Chunks new events and folds the candidates of their subjects into facts and sets; gives those subjects' outcomes.

        Only subjects with events captured since the last call are folded, or the ``subjects`` (project_id, subject_id) given, or
        ``everything``, as new ``aliases`` call for. A subject's fold starts from its events, which are the ledger's truth, so
        running it again changes nothing. What was decided by hand stays: resolved sets with their facts, and facts that are
        disputed, disabled or deleted. With ``embed`` a subject's predicates are matched by meaning instead of ``aliases``, and what
        repeats the facts of its last packets is turned away.
        """
        commits, done = self.store.commits("events"), {r.commit for r in self.table("folded").collect()}
        fresh = [x for x in commits if x not in done]
        events = self.store.merged("events", hidden=self.visible, stamps=True)
        new = events if everything else events.filter(c("_at").isin(fresh)) if fresh else events.filter(F.lit(False))
        wanted = subjects.select(*SCOPE).distinct() if subjects is not None else new.select(*SCOPE).distinct()
        own = written(events.join(wanted, SCOPE, "left_semi").drop("_at"), "events")
        self._write_chunks(own)
        listed = F.from_json(F.get_json_object("payload", "$.mock_facts"), CANDIDATES)
        rows = own.select(*SCOPE, "event_id", "occurred_at", F.posexplode(listed).alias("ordinal", "f"), F.coalesce("origin_trust", F.lit("trusted")).alias("origin_trust"), "actor_id")
        names = ["predicate", "value", "qualifiers", "confidence", "action", "supersedes_predicate", "evidence_span", "reject_reason", "fact_kind", "volatility", "memory_form", "temporal_range"]
        made = rows.select(*SCOPE, "event_id", "occurred_at", "ordinal", "origin_trust", "actor_id", *[f"f.{x}" for x in names])
        judged = written(consolidation.judge(made), "judged")
        if embed is None:
            folded = written(consolidation.consolidate(consolidation.with_identity(judged, aliases)), "folded")
        else:
            said = judged.withColumn("e", embed(F.concat_ws(" ", "predicate", "value")))
            folded = written(consolidation.consolidate(consolidation.with_packets(said, self._served(wanted)), semantic=True), "folded")
        outcomes = consolidation.decisions_of(folded)
        refused = judged.filter("error is not null or rejected is not null")
        told = outcomes.select(*SCOPE, "event_id", "ordinal", "outcome").unionByName(refused.select(*SCOPE, "event_id", "ordinal", F.coalesce(F.concat(F.lit("invalid_"), "error"), F.concat(F.lit("rejected_"), "rejected")).alias("outcome")))
        old, old_sets = self.table("facts").join(wanted, SCOPE, "left_semi"), self.table("sets").join(wanted, SCOPE, "left_semi")
        old, old_sets = written(old, "old-facts"), written(old_sets, "old-sets")
        settled = old_sets.filter("status = 'resolved'").select(F.explode("fact_ids").alias("fact_id"))
        by_hand = old.filter(c("status").isin("disputed", "disabled", "deleted")).select("fact_id").union(settled).distinct()
        facts, sets = ((df if embed is None else df.withColumn("identity", F.lit(None).cast("string"))) for df in (consolidation.facts_of(folded), consolidation.sets_of(folded)))
        facts = facts.join(by_hand, "fact_id", "left_anti")
        sets = sets.join(old_sets.filter("status = 'resolved'").select("set_id"), "set_id", "left_anti")
        changed = {"facts": self._changes(facts, old.join(by_hand, "fact_id", "left_anti"), "facts"), "sets": self._changes(sets, old_sets.filter("status <> 'resolved'"), "sets")}
        self.store.commit(**changed, decisions=told.withColumn("at", self.now), folded=self.spark.createDataFrame([(x,) for x in fresh], "commit string"))
        self._merge_keys(wanted)
        return outcomes

    def _served(self, subjects: DataFrame) -> DataFrame:
        """The packets that the subjects were served: (project_id, subject_id, served_at, fact_ids)."""
        facts = self.table("traces").join(subjects, SCOPE, "left_semi").filter("action = 'included'")
        ids = F.collect_list(F.when(c("kind") == "fact", c("item_id")))
        return facts.groupBy("trace_id", *SCOPE, "served_at").agg(ids.alias("fact_ids")).drop("trace_id")

    def counters(self) -> DataFrame:
        """How often each outcome came of the candidates of each project."""
        return self.table("decisions").groupBy("project_id", "outcome").agg(F.count("*").alias("n"))

    def _changes(self, new: DataFrame, old: DataFrame, name: str) -> DataFrame:
        """Rows that are new or differ, and those that are no more, marked as gone."""
        own = TABLES[name]
        new, old = new.select(*own.columns), old.select(*own.columns)
        alike = F.xxhash64(*[F.to_json(F.struct(x)) for x in own.columns])
        same = old.select(*own.key, alike.alias("_same"))
        more = new.withColumn("_same", alike).join(same, [*own.key, "_same"], "left_anti").drop("_same").withColumn("_gone", F.lit(False))
        return more.unionByName(old.join(new.select(*own.key), list(own.key), "left_anti").withColumn("_gone", F.lit(True)))

    def _write_chunks(self, events: DataFrame) -> None:
        """Chunks of the events that have none yet; the same payload always has the same chunks, so a replay writes nothing."""
        known = self.table("chunks").select("project_id", "event_id").distinct()
        pending = events.join(known, ["project_id", "event_id"], "left_anti")
        cut = pending.select(*SCOPE, "event_id", F.posexplode(messages.chunk_payload(c("kind"), c("payload"))).alias("ordinal", "text"), "kind", "occurred_at", "origin_trust")
        self.store.commit(chunks=cut.withColumn("index_text", c("text")))

    def attributed(self, facts: DataFrame, chunks: DataFrame) -> DataFrame:
        """Facts with the ``ordinal`` of the chunk that they quote: their first event's only chunk, or the only one that holds their span."""
        f = facts.select("project_id", "fact_id", F.get("source_event_ids", F.lit(0)).alias("event_id"), normalise_span(c("evidence_span")).alias("span"))
        met = f.join(chunks.select("project_id", "event_id", "ordinal", normalise_span(c("text")).alias("said")), ["project_id", "event_id"])
        held = (c("span") != "") & F.contains("said", c("span"))
        found = met.groupBy("project_id", "fact_id", "event_id").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.count_if(held).alias("hits"), F.min(F.when(held, c("ordinal"))).alias("hit"))
        return found.select("project_id", "fact_id", "event_id", F.when(c("n") == 1, c("first")).when(c("hits") == 1, c("hit")).alias("ordinal"))

    def _merge_keys(self, subjects: DataFrame) -> None:
        """``index_text`` of each chunk: its text and the facts that quote it, in order; written only where it changes."""
        chunks = written(self.table("chunks").join(subjects, SCOPE, "left_semi"), "chunks")
        facts = self.table("facts").join(subjects, SCOPE, "left_semi")
        own = self.attributed(facts, chunks).filter("ordinal is not null").join(facts.select("project_id", "fact_id", "predicate", "value", "valid_from"), ["project_id", "fact_id"])
        line = F.array_sort(F.collect_list(F.struct("valid_from", "predicate", "value", "fact_id")))
        said = own.groupBy("project_id", "event_id", "ordinal").agg(line.alias("line"))
        merged = chunks.join(said, ["project_id", "event_id", "ordinal"], "left")
        shown = F.concat(c("text"), F.lit(" FACTS: "), F.array_join(F.transform("line", lambda x: F.concat_ws(" ", x.predicate, x.value)), "; "))
        index = F.when(c("line").isNotNull(), shown).otherwise(c("text"))
        self.store.commit(chunks=merged.withColumn("_new", index).filter(~c("_new").eqNullSafe(c("index_text"))).withColumn("index_text", c("_new")).drop("_new", "line"))

    # Reading

    def items(self, embed: Callable[[Column], Column], as_of: Column) -> tuple[DataFrame, DataFrame]:
        """What can be served as of a moment, with vectors and words: facts and episodes, numbered.

        Facts are those valid then, or active, and the candidate sides of open contradictions; these aren't looked for but come
        with their active side. Nothing of an untrusted origin is an episode.
        """
        scope = F.concat_ws("\u001f", *SCOPE)
        rows, chunks = self.table("facts"), self.table("chunks").filter("origin_trust <> 'untrusted'").filter(c("occurred_at") <= as_of)
        said = F.concat_ws(" ", "predicate", "value")
        since, till = F.to_timestamp("valid_from"), F.to_timestamp("valid_to")
        valid = (since <= as_of) & ((c("status") == "active") & till.isNull() | (c("status") == "superseded") & (till > as_of) | (c("status") == "candidate"))
        facts = rows.filter(valid).select(scope.alias("scope"), *SCOPE, "fact_id", "status", said.alias("said"), F.get_json_object("value", "$.person").alias("person"), F.unix_seconds(since).alias("recency"), c("predicate").alias("tie_a"), c("value").alias("tie_b"), token_estimate(said).alias("cost"))
        shown = F.concat_ws(" ", F.date_format("occurred_at", "yyyy-MM-dd HH:mm"), "kind", "text")
        episodes = chunks.select(scope.alias("scope"), *SCOPE, "event_id", "ordinal", "occurred_at", "text", c("index_text").alias("said"), F.unix_seconds("occurred_at").alias("recency"), F.lpad((1_000_000 - c("ordinal")).cast("string"), 10, "0").alias("tie_a"), c("event_id").alias("tie_b"), token_estimate(shown).alias("cost"))
        number = F.monotonically_increasing_id()
        words = {"id": number, "e": embed(c("said")), "lex": english_words(c("said")), "words": simple_words(c("said")), "names": entity_tokens(c("said"))}
        made = [written(df.withColumns(words).drop("said"), "items") for df in (facts, episodes)]
        return made[0], made[1]

    def context(self, queries: DataFrame, embed: Callable[[Column], Column], budget: int = 2000, k: int = 64, floor: float = 0.0, as_of: str | None = None, indexed: bool = False) -> DataFrame:
        """Queries (query_id, project_id, subject_id, text) answered: every candidate's decision with its text, traced.

        Facts and episodes are found by vector and by the cover density of stems, ranked together and packed, facts about people whom
        the question doesn't name behind others; contested facts bring their other sides. What is left of the budget goes to facts
        that name what the packed ones name most, and then to what surrounds the packet. ``embed`` is a Column to Column function. With
        ``floor`` above 0 items beyond that distance are left out. ``as_of`` asks at that moment, else now. ``indexed`` builds the
        vector and lexical indexes and searches those; the answers are the same.
        """
        moment = F.lit(as_of).cast("timestamp") if as_of else self.now
        facts, episodes = self.items(embed, moment)
        asked = written(self.resolve_subject(queries).select("query_id", *SCOPE, F.concat_ws("\u001f", *SCOPE).alias("scope"), embed(c("text")).alias("e"), english_lexemes(c("text")).alias("lex"), entity_tokens(c("text")).alias("names")), "asked")
        q = asked.select("scope", (-1 - c("query_id")).alias("id"), "e", "lex")
        find = (lambda df: indexed_candidates(*build_indexes(df), q, k)) if indexed else (lambda df: candidates(df, q, k))
        columns = ["scope", "id", "e", "lex", "recency", "tie_a", "tie_b", "cost"]
        pools = [find(df.select(*columns)).select("*", F.lit(kind).alias("kind"), F.lit(place).alias("first")) for kind, place, df in (("fact", 0, facts.filter("status <> 'candidate'")), ("episode", 1, episodes))]
        pool = written(pools[0].unionByName(pools[1].select(pools[0].columns)).withColumn("query_id", -1 - c("query_id")), "pool")
        near = F.coalesce(c("distance") <= floor, F.lit(False)) if floor > 0 else F.lit(True)
        every_item = facts.select(F.lit("fact").alias("kind"), "id", "person", c("names").alias("said")).unionByName(episodes.select(F.lit("episode").alias("kind"), "id", F.lit(None).cast("string").alias("person"), c("names").alias("said")))
        scored = pool.filter(near).withColumn("similarity", F.coalesce(1 - c("distance"), F.lit(0.0))).withColumn("score", relevance("similarity", "overlap", "query_id"))
        scored = scored.join(every_item, ["kind", "id"]).join(asked.select("query_id", "names"), "query_id").withColumn("score", c("score") * person_factor(c("person"), c("names")))
        w = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("recency"), "first", "tie_a", "tie_b", "id")
        sides = written(self._sides(facts), "sides")
        ranked = written(scored.withColumn("rank", F.row_number().over(w).cast("long")).select("query_id", "rank", "kind", "id", "cost", "said"), "ranked")
        decided = written(pack_packets(ranked.join(sides.withColumn("kind", F.lit("fact")), ["kind", "id"], "left").select("query_id", "rank", "kind", "id", "cost", "siblings"), budget), "packed")
        kept = decided.filter("action = 'included'").select("query_id", "kind", "id", "used")
        free = facts.filter("status <> 'candidate'").join(sides.select("id"), "id", "left_anti").select("scope", "id", "cost", "words")
        told_names = kept.join(every_item.select("kind", "id", c("said").alias("names")), ["kind", "id"])
        hop = written(second_hop(told_names, ranked.select("query_id", "rank", c("said").alias("names")), asked, free, budget), "hop")
        around = self._window(kept.unionByName(hop.select("query_id", F.lit("fact").alias("kind"), "id", "used")), facts, episodes, asked, moment, budget)
        below = pool.filter(~near).select("query_id", "kind", "id", "cost", F.lit("excluded").alias("action"), F.lit("below_relevance_floor").alias("reason_code"))
        every = decided.select("query_id", "place", "kind", "id", "cost", "action", "reason_code")
        every = every.unionByName(hop.select("query_id", (c("used") + 500_000).alias("place"), F.lit("fact").alias("kind"), "id", "cost", F.lit("included").alias("action"), F.lit("multi_hop_expansion").alias("reason_code")))
        every = every.unionByName(around.select("query_id", (c("place") + 1_000_000_000).alias("place"), F.lit("episode").alias("kind"), "id", "cost", "action", "reason_code"))
        every = every.unionByName(below.withColumn("place", F.lit(2_000_000_000).cast("long")))
        order = W.partitionBy("query_id").orderBy("place", "kind", "id")
        run = uuid.uuid4().hex
        known = facts.select(F.lit("fact").alias("kind"), "id", c("fact_id").alias("item_id"), c("tie_a").alias("predicate"), c("tie_b").alias("value"), F.lit(None).cast("string").alias("text"))
        known = known.unionByName(episodes.select(F.lit("episode").alias("kind"), "id", F.concat_ws(":", "event_id", c("ordinal").cast("string")).alias("item_id"), F.lit(None).cast("string").alias("predicate"), F.lit(None).cast("string").alias("value"), "text"))
        told = every.withColumn("place", (F.row_number().over(order) - 1).cast("long")).join(known, ["kind", "id"]).join(asked.select("query_id", *SCOPE), "query_id")
        served = written(told.select(F.concat_ws("|", F.lit(run), c("query_id").cast("string")).alias("trace_id"), "query_id", *SCOPE, "place", "kind", "item_id", "action", "reason_code", "cost", F.lit(None).cast("long").alias("millis"), self.now.alias("served_at"), "predicate", "value", "text"), "served")
        self.store.commit(traces=served)
        return served

    def _sides(self, facts: DataFrame) -> DataFrame:
        """(id, siblings): the other sides of the open contradictions of each fact."""
        own = facts.select("project_id", "fact_id", "id", "cost")
        open_ = self.table("sets").filter("status = 'open' and kind = 'contradiction'").select("project_id", "set_id", F.explode("fact_ids").alias("fact_id"))
        sides = open_.join(own, ["project_id", "fact_id"]).groupBy("project_id", "set_id").agg(F.array_sort(F.collect_list(F.struct("id", "cost"))).alias("sides")).filter(F.size("sides") > 1)
        each = sides.select(F.explode("sides").alias("x"), "sides").select("x.id", F.filter("sides", lambda y: y.id != c("x.id")).alias("others"))
        return each.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("siblings"))

    def _window(self, kept: DataFrame, facts: DataFrame, episodes: DataFrame, asked: DataFrame, moment: Column, budget: int) -> DataFrame:
        rows = self.table("facts")
        chunks = episodes.select("project_id", "scope", "id", "event_id", "ordinal", "occurred_at", "cost", messages.overlap_words(c("text")).alias("words"), F.lit(True).alias("trusted"), "text")
        exact = self.attributed(rows, chunks).join(chunks.select("project_id", "event_id", "ordinal", c("id").alias("chunk_id")), ["project_id", "event_id", "ordinal"], "left").select("project_id", "fact_id", "chunk_id")
        said = messages.overlap_words(F.concat_ws(" ", "predicate", "value"))
        own = facts.select("project_id", "fact_id", "id").join(rows.select("project_id", "fact_id", F.get("source_event_ids", F.lit(0)).alias("event_id"), said.alias("words")), ["project_id", "fact_id"])
        own = written(own.join(exact, ["project_id", "fact_id"], "left").select("id", "chunk_id", "event_id", "words"), "sources")
        return context_window(kept, own, chunks.drop("project_id", "text"), asked.select("query_id", "scope", moment.alias("as_of")), budget)

    def packets(self, trace_ids: DataFrame | None = None) -> DataFrame:
        """Each trace's packet: status, tokens, warnings, and its facts and episodes with all that a reader needs to weigh them."""
        traces = self.table("traces")
        traces = traces.join(trace_ids.select("trace_id").distinct(), "trace_id", "left_semi") if trace_ids is not None else traces
        kept = traces.filter("action = 'included'")
        rows = self.table("facts")
        open_ = self.table("sets").filter("status = 'open' and kind = 'contradiction'").select("project_id", F.explode("fact_ids").alias("fact_id"), "set_id").groupBy("project_id", "fact_id").agg(F.min("set_id").alias("conflict_id"))
        moment, confirmed = c("served_at"), F.to_timestamp(F.coalesce("last_reinforced_at", "valid_from"))
        days = lambda x: F.date_diff(moment.cast("date"), x.cast("date"))
        horizon = F.coalesce(*[F.when(c("volatility") == v, F.lit(n)) for v, n in HORIZONS.items()])
        age = (F.unix_seconds(moment) - F.unix_seconds(confirmed)) / DAY
        fresh = F.when(horizon.isNull() | (age <= horizon), "current").when(age <= 2 * horizon, "unconfirmed").otherwise("stale")
        about = F.to_timestamp("observed_at")
        fact = F.struct(
            "place", c("fact_id").alias("id"), "predicate", "value", "confidence", "valid_from", relative_day(days(F.to_timestamp("valid_from"))).alias("valid_from_relative"), "temporal_range", "observed_at",
            F.when(about.isNotNull(), relative_day(days(about))).alias("observed_at_relative"), c("reclassified").alias("auto_reclassified"), "source_event_ids", "fact_kind", "volatility",
            F.coalesce("last_reinforced_at", "valid_from").alias("last_confirmed"), fresh.alias("freshness"), F.coalesce("origin_trust", F.lit("trusted")).alias("origin_trust"), F.get_json_object("qualifiers", "$.attributed_to").alias("attributed_to"),
            c("conflict_id").isNotNull().alias("contested"), "conflict_id",
        )
        facts = kept.filter("kind = 'fact'").select("trace_id", "place", "project_id", "served_at", c("item_id").alias("fact_id")).join(rows.drop("subject_id", "identity"), ["project_id", "fact_id"]).join(open_, ["project_id", "fact_id"], "left")
        facts = facts.groupBy("trace_id").agg(F.array_sort(F.collect_list(fact)).alias("facts"))
        chunks = self.table("chunks").select("project_id", F.concat_ws(":", "event_id", c("ordinal").cast("string")).alias("item_id"), "event_id", c("kind").alias("event_kind"), "occurred_at", "text")
        beside = c("reason_code").isin("episode_neighbor", "fact_source_turn")
        episode = F.struct("place", c("item_id").alias("episode_id"), "event_id", c("event_kind").alias("kind"), "occurred_at", relative_day(days(c("occurred_at"))).alias("occurred_at_relative"), c("text").alias("excerpt"), beside.alias("context_neighbor"))
        episodes = kept.filter("kind = 'episode'").select("trace_id", "place", "project_id", "served_at", "item_id", "reason_code").join(chunks, ["project_id", "item_id"]).groupBy("trace_id").agg(F.array_sort(F.collect_list(episode)).alias("episodes"))
        own = traces.groupBy("trace_id", *SCOPE, "query_id").agg(F.coalesce(F.sum(F.when(c("action") == "included", c("cost"))), F.lit(0)).alias("token_count"), F.count_if((c("action") == "included") & (c("reason_code") == "conflict_disputed")).alias("disputed"), F.count_if(c("reason_code") == "below_relevance_floor").alias("below"))
        packet = own.join(facts, "trace_id", "left").join(episodes, "trace_id", "left")
        empty = c("facts").isNull() & c("episodes").isNull()
        warnings = F.array_compact(F.array(F.when(c("disputed") > 0, F.format_string("open_conflict: %d fact(s) served with an unresolved value", c("disputed")))))
        return packet.select("trace_id", *SCOPE, "query_id", "token_count", "facts", "episodes", warnings.alias("warnings"), F.when(empty | (c("disputed") > 0), "degraded").otherwise("ok").alias("status"), F.when(empty & (c("below") > 0), "no_relevant_memory").alias("empty_reason"))

    def prompts(self, trace_ids: DataFrame | None = None) -> DataFrame:
        """(trace_id, prompt): each packet as the lines of a prompt, facts first, episodes in the order of time."""
        packets = self.packets(trace_ids)
        facts = F.transform("facts", lambda f: messages.render_fact(f.predicate, f.value, F.to_timestamp(f.valid_from), f.valid_from_relative))
        turns = F.transform(F.array_sort("episodes", lambda a, b: F.when((a.occurred_at < b.occurred_at) | ((a.occurred_at == b.occurred_at) & (a.episode_id < b.episode_id)), -1).otherwise(1)), lambda e: messages.render_episode(e.occurred_at, e.kind, e.excerpt))
        none = F.array().cast("array<string>")
        return packets.select("trace_id", messages.prompt_block(F.coalesce(facts, none), F.coalesce(turns, none)).alias("prompt"))

    def inspect(self, trace_id: str) -> DataFrame:
        return self.table("traces").filter(c("trace_id") == trace_id).orderBy("place")

    def timeline(self) -> DataFrame:
        w = W.partitionBy(*SCOPE).orderBy("occurred_at", "event_id")
        return self.table("events").withColumn("place", F.row_number().over(w))

    def facts(self, status: str | None = None) -> DataFrame:
        return self.table("facts") if status is None else self.table("facts").filter(c("status") == status)

    def traces(self) -> DataFrame:
        return self.table("traces")

    def graph(self) -> DataFrame:
        """Edges (kind, source, target) of subjects, facts and the events that they come from."""
        f = self.table("facts")
        edge = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("source"), b.alias("target"))
        own = f.select(F.explode(F.array(edge("has_fact", c("subject_id"), c("fact_id")), edge("supersedes", c("fact_id"), c("supersedes_id")))).alias("e"))
        from_events = f.select(F.explode(F.transform("source_event_ids", lambda x: edge("derived_from", c("fact_id"), x))).alias("e"))
        return own.unionByName(from_events).select("e.*").filter("target is not null")

    def projects(self) -> DataFrame:
        return self.table("events").groupBy("project_id").agg(F.count_distinct("subject_id").alias("subjects"), F.count("*").alias("events"))

    def subjects(self) -> DataFrame:
        facts = self.facts("active").groupBy(*SCOPE).agg(F.count("*").alias("facts"))
        recalls = self.table("traces").groupBy(*SCOPE).agg(F.count_distinct("trace_id").alias("recalls"), F.max("served_at").alias("last_recall"))
        seen = self.table("events").groupBy(*SCOPE).agg(F.max("occurred_at").alias("last_event"))
        zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
        return seen.join(facts, SCOPE, "left").join(recalls, SCOPE, "left").select(*SCOPE, zero("facts"), zero("recalls"), F.greatest("last_event", "last_recall").alias("last_seen"))

    def stats(self) -> DataFrame:
        """A row for each project: facts, active facts, open sets, traces, and the share of included candidates."""
        facts = self.table("facts").groupBy("project_id").agg(F.count("*").alias("facts"), F.count_if(c("status") == "active").alias("active"))
        sets = self.conflicts().groupBy("project_id").agg(F.count("*").alias("open_sets"))
        traces = self.table("traces").groupBy("project_id").agg(F.count_distinct("trace_id").alias("traces"), F.avg((c("action") == "included").cast("int")).alias("included"))
        return self.projects().join(facts, "project_id", "left").join(sets, "project_id", "left").join(traces, "project_id", "left")

    def health(self, days: int = 30) -> DataFrame:
        """A row for each project over the last ``days``: what is measurable of its memory's health, and the score of that.

        ``injection_rate``: packets with facts; ``fact_density``: active facts for each event; ``write_rejection_rate`` with its
        breakdown by reason; ``contradiction_leakage``: packets that served a fact already superseded then. What has no denominator is
        null and doesn't weigh; staleness isn't measured yet.
        """
        since = self.now - F.make_dt_interval(days=F.lit(days))
        traces = self.table("traces").filter(c("served_at") >= since)
        served = traces.filter("kind = 'fact' and action = 'included'").select("project_id", "trace_id", "served_at", c("item_id").alias("fact_id"))
        facts = self.table("facts")
        replaced = facts.filter("supersedes_id is not null").select("project_id", c("supersedes_id").alias("fact_id"), F.to_timestamp("valid_from").alias("since")).groupBy("project_id", "fact_id").agg(F.min("since").alias("since"))
        leaked = served.join(replaced, ["project_id", "fact_id"]).filter(c("since") <= c("served_at")).groupBy("project_id").agg(F.count_distinct("trace_id").alias("leaked"))
        packets = traces.groupBy("project_id").agg(F.count_distinct("trace_id").alias("packets"), F.count_distinct(F.when((c("kind") == "fact") & (c("action") == "included"), c("trace_id"))).alias("with_facts"))
        written_ = self.table("decisions").filter(c("at") >= since)
        refused = c("outcome").startswith("rejected_")
        reasons = written_.filter(refused).groupBy("project_id", F.regexp_replace("outcome", "^rejected_", "").alias("reason")).agg(F.count("*").alias("n")).groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("rejection_breakdown"))
        writes = written_.groupBy("project_id").agg(F.try_divide(F.count_if(refused), F.count("*")).alias("write_rejection_rate"))
        sizes = facts.groupBy("project_id").agg(F.count("*").alias("facts"), F.count_if(c("status") == "active").alias("active"))
        open_ = self.conflicts().groupBy("project_id").agg(F.count("*").alias("open"))
        all_ = self.projects()
        for df in (sizes, open_, packets, leaked, writes, reasons):
            all_ = all_.join(df, "project_id", "left")
        none = lambda x: F.coalesce(x, F.lit(0))
        leakage = F.when(none("with_facts") > 0, none("leaked") / c("with_facts"))
        parts = [(0.3, F.try_divide("with_facts", "packets")), (0.3, 1 - leakage), (0.2, F.when(none("facts") > 0, F.greatest(F.lit(0.0), 1 - 0.1 * none("open"))))]
        total, weight = (sum((F.coalesce(f(w, x), F.lit(0.0)) for w, x in parts), F.lit(0.0)) for f in (lambda w, x: w * x, lambda w, x: F.when(x.isNotNull(), w)))
        return all_.select("project_id", F.try_divide("with_facts", "packets").alias("injection_rate"), F.try_divide(none("active"), "events").alias("fact_density"), "write_rejection_rate", "rejection_breakdown", leakage.alias("contradiction_leakage"), F.lit(None).cast("double").alias("staleness"), none("open").alias("open_conflicts"), F.bround(F.try_divide(100 * total, weight), 1).alias("health_score"))

    def conflicts(self) -> DataFrame:
        return self.table("sets").filter("status = 'open'")

    # Changes by hand

    def resolve(self, choices: DataFrame) -> None:
        """Closes sets (set_id, keep): the kept fact is active and supersedes the others of its set."""
        chosen = written(self.conflicts().join(choices, "set_id").filter(F.array_contains("fact_ids", c("keep"))), "chosen")
        sides = chosen.select("project_id", F.explode("fact_ids").alias("fact_id"), "keep", "fact_ids")
        facts = self.table("facts").join(sides, ["project_id", "fact_id"])
        kept, lost = c("fact_id") == c("keep"), F.element_at(F.filter("fact_ids", lambda x: x != c("keep")), 1)
        moved = facts.withColumn("status", F.when(kept, "active").otherwise("superseded")).withColumn("version", c("version") + 1)
        moved = moved.withColumn("supersedes_id", F.when(kept, F.coalesce(lost, "supersedes_id")).otherwise(c("supersedes_id")))
        self.store.commit(facts=moved, sets=chosen.withColumn("status", F.lit("resolved")))

    def feedback(self, given: DataFrame) -> DataFrame:
        """Judges feedback (feedback_id, project_id, fact_id, trace_id, rating); facts rated incorrect are disputed."""
        named = self.table("facts", given.filter("fact_id is not null"))
        judged = written(lifecycle.judge_feedback(given, named.select("fact_id", "project_id", "status")), "feedback")
        wrong = given.join(judged.filter("error is null and fact_status = 'disputed'").select("feedback_id"), "feedback_id").select("fact_id", F.lit("disputed").alias("target")).distinct()
        facts = named.join(wrong.select("fact_id"), "fact_id", "left_semi").withColumn("recorded_to", F.lit(None).cast("timestamp"))
        self.store.commit(facts=lifecycle.change_status(facts, wrong, self.now))
        return judged

    def forget(self, subjects: DataFrame) -> DataFrame:
        """Erases subjects (project_id, subject_id) from all tables; gives a receipt for each.

        They are hidden at once, whatever other writers do, and their rows leave the files with the compaction that follows.
        """
        gone = subjects.select(F.concat_ws("\u001f", *SCOPE).alias("scope"), *SCOPE).distinct()
        held = {name: self.table(name).select(F.concat_ws("\u001f", *SCOPE).alias("scope"), id_).distinct() for name, id_ in (("events", "event_id"), ("facts", "fact_id"), ("traces", "trace_id"))}
        receipts = lifecycle.erase(held, gone, "scope")[1]
        done = written(receipts.join(gone, "scope").select(F.expr("uuid()").alias("receipt_id"), *SCOPE, "events", "facts", "traces", self.now.alias("at")), "receipts")
        last = max((r.commit for r in self.store.log()), default="")
        self.store.commit(receipts=done, erased=gone.select(*SCOPE, F.lit(last).alias("upto")))
        self.compact(*OWNED)
        return done
