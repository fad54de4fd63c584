"""Consolidation: candidate facts of events become facts, reinforcements, successors, contradictions or held ones.

Checks that need one row are columns (``judge``). What depends on the facts before it is a fold over the candidates of one
identity class in the order of their events: a project's subject and a predicate, aliases resolved. Classes are dealt to tasks
by key and sorted within them, and a task folds row by row, so it holds the facts of one class and never a subject's rows. Where
statements have vectors, a subject is folded instead: its predicates are matched by meaning as they come, and statements that echo
the packets served to it are turned away. The stream applies the same fold to the state that it keeps for each key.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from json.encoder import encode_basestring

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import observed_at

# Ranks of origins, closed vocabularies, and the phrases that order an agent about.
TRUST = {"untrusted": 0, "third_party": 1, "semi_trusted": 2, "trusted": 3}
ACTIONS = ("create", "supersede", "reject")
REJECT_REASONS = ("echo_of_context", "system_noise", "config_dump", "transient_state", "unsupported_inference", "agent_self_reference", "no_evidence_span", "imperative_directive", "untrusted_instruction")
FACT_KINDS, VOLATILITIES, FORMS = ("attribute", "preference", "instruction"), ("stable", "slow", "volatile", "ephemeral"), ("state", "event")
DIRECTIVES = (
    r"ignor[ez]\s+(all\s+|toutes?\s+les\s+)?(the\s+)?(previous|prior|above|pr[eé]c[eé]dentes?)\s+instructions?",
    r"disregard\s+(your|the|all)\s+(previous\s+)?instructions?",
    r"consid[eè]re[sz]?\s+toujours\b",
    r"r[eé]ponds?\s+toujours\s+en\s+donnant\s+la\s+priorit[eé]",
    r"n'?oublie\s+jamais\s+de\s+toujours\b",
    r"you\s+must\s+always\b",
    r"always\s+(treat|trust|obey|prioriti[sz]e)\b",
    r"from\s+now\s+on,?\s+(always|never|you\s+must)\b",
)
LONGEST_NAME, LONGEST_SPAN, MOST_SIDES = 128, 4000, 2
# The cosine distance within which two statements are about the same, and the packets that an echo is sought in.
SAME, PACKETS = 0.28, 20

CANDIDATE = "project_id string, subject_id string, event_id string, occurred_at timestamp, ordinal int, origin_trust string, actor_id string, predicate string, value string, qualifiers string, confidence double, action string, supersedes_predicate string, evidence_span string, reject_reason string, fact_kind string, volatility string, memory_form string, temporal_range string"
FACT = "fact_id string, predicate string, value string, qualifiers string, status string, confidence double, valid_from string, valid_to string, supersedes_id string, source_event_ids array<string>, version int, reinforcement_count int, last_reinforced_at string, fact_kind string, volatility string, memory_form string, reclassified boolean, origin_trust string, temporal_range string, observed_at string, evidence_span string"
SET = "set_id string, fact_ids array<string>, status string, kind string, reason string"
CLASS, SUBJECT = ["project_id", "subject_id", "identity"], ["project_id", "subject_id"]


def directive(text: Column) -> Column:
    """Whether a text orders an agent about."""
    found = F.lit(False)
    for phrase in DIRECTIVES:
        found = found | text.rlike(f"(?iu){phrase}")
    return found


def trust_rank(origin: Column) -> Column:
    rank = F.lit(0)
    for name, n in TRUST.items():
        rank = F.when(origin == name, n).otherwise(rank)
    return F.when(origin.isNull(), TRUST["trusted"]).otherwise(rank)


def invalid(c=F.col) -> Column:
    """Why a candidate is no candidate at all, else null. Unknown kinds, volatilities and forms are no errors."""
    bounds = F.from_json("temporal_range", "struct<start:string,end:string>")
    keys = F.array_sort(F.map_keys(F.from_json("temporal_range", "map<string,string>")))
    is_object = lambda x: F.trim(c(x)).startswith("{") & F.try_parse_json(c(x)).isNotNull()
    dated = lambda x: F.try_to_timestamp(x).isNotNull()
    return (
        F.when(c("predicate").isNull() | ~F.length("predicate").between(1, LONGEST_NAME), "predicate")
        .when(F.length("supersedes_predicate") > LONGEST_NAME, "supersedes_predicate")
        .when(c("value").isNull() | ~is_object("value"), "value")
        .when(c("confidence").isNull() | F.isnan("confidence") | ~c("confidence").between(0, 1), "confidence")
        .when(~F.coalesce("action", F.lit("create")).isin(*ACTIONS), "action")
        .when(F.length("evidence_span") > LONGEST_SPAN, "evidence_span")
        .when(c("reject_reason").isNotNull() & ~c("reject_reason").isin(*REJECT_REASONS), "reject_reason")
        .when((c("action") == "reject") & c("reject_reason").isNull(), "reject_reason")
        .when(c("temporal_range").isNotNull() & ~F.coalesce((keys == F.array(F.lit("end"), F.lit("start"))) & dated(bounds.start) & dated(bounds.end), F.lit(False)), "temporal_range")
    )


def judge(candidates: DataFrame, echoes: DataFrame | None = None) -> DataFrame:
    """Candidates with unknown classes dropped, and ``error`` and ``rejected``: why they go no further, else null.

    Rejected are those that the extractor rejects, orders to the agent, instructions from origins below semi-trusted, and, where
    ``echoes`` (event_id, ordinal) is given, statements that repeat what a packet has just served; a supersede is no echo.
    """
    known = lambda x, some: F.when(F.col(x).isin(*some), F.col(x)).alias(x)
    named = {"fact_kind": FACT_KINDS, "volatility": VOLATILITIES, "memory_form": FORMS}
    rows = candidates.select(*[known(x, named[x]) if x in named else F.col(x) for x in candidates.columns]).withColumn("action", F.coalesce("action", F.lit("create")))
    echo = F.lit(False)
    if echoes is not None:
        rows = rows.join(echoes.select("event_id", "ordinal", F.lit(True).alias("echo")).distinct(), ["event_id", "ordinal"], "left")
        echo = F.coalesce("echo", F.lit(False)) & (F.col("action") != "supersede")
    said = F.concat_ws(" ", "predicate", "value", F.coalesce("qualifiers", F.lit("{}")), F.coalesce("evidence_span", F.lit("")))
    weak = (F.col("fact_kind") == "instruction") & (trust_rank(F.col("origin_trust")) < TRUST["semi_trusted"])
    reason = F.when(F.col("action") == "reject", F.col("reject_reason")).when(directive(said), "imperative_directive").when(weak, "untrusted_instruction").when(echo, "echo_of_context")
    judged = rows.withColumn("_error", invalid()).withColumn("_reason", reason)
    # A filter on what comes out of an array isn't pushed below it: pushed, it would compute all of the above anew for each mention.
    told = F.inline(F.array(F.struct(F.col("_error").alias("error"), F.when(F.col("_error").isNull(), F.col("_reason")).alias("rejected"))))
    return judged.select("*", told).drop("_error", "_reason", "echo")


#: Encoders are made once: ``json.dumps`` makes one for each call.
canonical = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode
compact = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def quoted(text: str | None) -> str:
    return "null" if text is None else encode_basestring(text)


def merged_value(old: dict, new: dict) -> dict:
    """What the new value doesn't state is carried forward; an explicit null removes a key."""
    return {k: v for k, v in {**old, **new}.items() if v is not None}


def own_identity(qualifiers: dict) -> str:
    """Qualifiers that tell facts apart: not who said it."""
    return canonical({k: v for k, v in qualifiers.items() if k != "attributed_to"}) if qualifiers else "{}"


class Near:
    """Unit vectors of facts by their place; the nearest one by cosine distance."""

    def __init__(self):
        self.places, self.rows, self.at = [], None, {}

    def add(self, place: int, vector: np.ndarray) -> None:
        n = len(self.places)
        if self.rows is None:
            self.rows = np.zeros((4, len(vector)))
        if n == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[n], self.at[place] = vector, n
        self.places.append(place)

    def drop(self, place: int) -> None:
        i = self.at.pop(place, None)
        if i is None:
            return
        last = self.places.pop()
        if last != place:
            self.places[i], self.rows[i], self.at[last] = last, self.rows[len(self.places)], i

    def nearest(self, vector: np.ndarray) -> tuple[float, int] | None:
        n = len(self.places)
        if not n or self.rows.shape[1] != len(vector):
            return None
        distance = np.round(1 - self.rows[:n] @ vector, 9)
        least = distance.min()
        return float(least), min(self.places[i] for i in np.flatnonzero(distance == least))


def unit(vector) -> np.ndarray | None:
    """Of length one; None for a null or zero vector."""
    v = np.asarray(vector, float) if vector is not None else np.zeros(0)
    size = np.sqrt((v * v).sum())
    return v / size if size > 0 else None


class Identity:
    """The facts and open sets of one identity class, or, with ``semantic``, of one subject; kept as JSON between batches.

    A class holds predicates known to mean the same, so any of its active facts answers for another. A subject's predicates find
    each other as they come: the same name, else a name learned before, else the nearest active fact within ``SAME``, from which
    the name is learned; whatever way, qualifiers must be equal. Look-ups go by index, so a candidate costs the same however many
    facts there are, but for the nearest one, which reads the subject's active vectors.
    """

    def __init__(self, facts: list[dict] | None = None, sets: list[dict] | None = None, semantic: bool = False, aliases: dict | None = None, ring: list | None = None):
        self.facts, self.sets, self.semantic, self.aliases, self.ring = [], [], semantic, aliases or {}, ring or []
        self.places: dict[str, int] = {}
        self.texts: list[tuple[str, str]] = []  # each fact's canonical value and identity, which never change
        self.vectors: list[np.ndarray | None] = []
        self.sources: dict[str, set] = {}
        self.live: dict[tuple, list[int]] = {}  # places of active facts, ascending, by several keys
        self.said: dict[tuple, list[int]] = {}  # places of states, active or not, ascending
        self.near: dict[str, Near] = {}
        self.sides: dict[str, dict] = {}
        for f in facts or []:
            self.add_fact(f)
        for x in sets or []:
            self.keep_set(x)

    # What is indexed

    def keys(self, place: int) -> list[tuple]:
        f, (said, identity) = self.facts[place], self.texts[place]
        keys = [("any", identity), ("named", f["predicate"], identity), ("mixed", f["predicate"], identity == "{}")]
        return keys if f["memory_form"] == "event" else [*keys, ("said", f["predicate"], said, identity)]

    def add_fact(self, f: dict, said: str | None = None) -> None:
        self.places[f["fact_id"]] = place = len(self.facts)
        said, identity = canonical(f["value"]) if said is None else said, own_identity(f["qualifiers"])
        self.facts.append(f)
        self.texts.append((said, identity))
        self.vectors.append(np.array(f["e"]) if f.get("e") is not None else None)
        self.sources[f["fact_id"]] = set(f["source_event_ids"])
        if f["memory_form"] != "event":
            self.said.setdefault((f["predicate"], said, identity), []).append(place)
        if f["status"] == "active":
            self.enter(place)

    def enter(self, place: int) -> None:
        for key in self.keys(place):
            insort(self.live.setdefault(key, []), place)
        if self.vectors[place] is not None:
            self.near.setdefault(self.texts[place][1], Near()).add(place, self.vectors[place])

    def leave(self, place: int) -> None:
        for key in self.keys(place):
            own = self.live[key]
            del own[bisect_left(own, place)]
        if self.vectors[place] is not None:
            self.near[self.texts[place][1]].drop(place)

    def move(self, fact: dict, status: str) -> None:
        place = self.places[fact["fact_id"]]
        if fact["status"] == "active":
            self.leave(place)
        fact["status"], fact["version"] = status, fact["version"] + 1
        if status == "active":
            self.enter(place)

    def text(self, fact: dict) -> str:
        return self.texts[self.places[fact["fact_id"]]][0]

    def newest(self, *key) -> dict | None:
        own = self.live.get(key)
        return self.facts[own[-1]] if own else None

    # What a candidate meets

    def active(self, predicate: str, identity: str, vector: np.ndarray | None = None) -> dict | None:
        """The newest active fact of a predicate, or the one that means the same."""
        exact = self.newest("named", predicate, identity)
        if exact is not None or not self.semantic:
            return exact or self.newest("any", identity)
        known = self.newest("named", self.aliases[predicate][0], identity) if predicate in self.aliases else None
        if known is not None or vector is None or identity not in self.near:
            return known
        found = self.near[identity].nearest(vector)
        if found is None or found[0] > SAME:
            return None
        near = self.facts[found[1]]
        if near["predicate"] != predicate:
            self.aliases.setdefault(predicate, [near["predicate"], 1 - found[0]])
        return near

    def duplicate(self, predicate: str, said: str, identity: str) -> dict | None:
        """The first state that says the same: an active one, else any."""
        own = self.live.get(("said", predicate, said, identity)) or self.said.get((predicate, said, identity))
        return self.facts[own[0]] if own else None

    def ambiguous(self, predicate: str, said: str, identity: str) -> dict | None:
        """An active fact of the predicate with another value where one of both has no qualifiers and the other has."""
        own = self.live.get(("mixed", predicate, identity != "{}"), ())
        return next((self.facts[i] for i in own if self.texts[i][0] != said), None)

    def echoes(self, vector: np.ndarray | None) -> bool:
        """Whether one of the facts in the last packets served is near."""
        if vector is None or not self.ring:
            return False
        served = {x for packet in self.ring for x in packet}
        near = [self.vectors[self.places[x]] for x in served if x in self.places]
        return any(v is not None and len(v) == len(vector) and round(1 - float(np.dot(v, vector)), 9) <= SAME for v in near)

    def serve(self, fact_ids: list[str]) -> None:
        """A packet goes out; only the last ``PACKETS`` are remembered."""
        self.ring = [*self.ring, list(fact_ids)][-PACKETS:]

    def reinforce(self, fact: dict, c: dict) -> str:
        """A new event restates an active fact: counted, and its clock moves on if the origin ranks no lower."""
        sources = self.sources[fact["fact_id"]]
        if fact["status"] != "active" or c["event_id"] in sources:
            return "duplicate"
        fact["reinforcement_count"] += 1
        later = fact["last_reinforced_at"] is None or c["occurred_at"] > fact["last_reinforced_at"]
        if later and TRUST.get(c["origin_trust"], 0) >= TRUST.get(fact["origin_trust"], 3):
            fact["last_reinforced_at"] = c["occurred_at"]
        sources.add(c["event_id"])
        fact["source_event_ids"].append(c["event_id"])
        return "reinforced"

    def keep_set(self, x: dict) -> None:
        self.sets.append(x)
        if x["status"] == "open":
            for fact_id in x["fact_ids"]:
                self.sides.setdefault(fact_id, x)

    def add_set(self, kind: str, ids: list[str], reason: str) -> None:
        self.keep_set({"set_id": hashlib.sha256("|".join([kind, *ids]).encode()).hexdigest()[:32], "fact_ids": ids, "status": "open", "kind": kind, "reason": reason})

    def apply(self, c: dict) -> tuple[str, str | None]:
        """The outcome of one candidate, and the fact that it made or met."""
        value, qualifiers, action = c["value"], c["qualifiers"], c["action"]
        vector = unit(c["e"]) if self.semantic else None
        if self.semantic and action != "supersede" and self.echoes(vector):
            return "echo_of_context", None
        said, target = c.get("said") or canonical(value), c["supersedes_predicate"] or c["predicate"]
        identity = c.get("own") or own_identity(qualifiers)
        twin = self.duplicate(c["predicate"], said, identity)
        existing = None
        if twin is None or twin["status"] != "active":
            existing = self.active(target, identity, vector)
        if twin is not None:
            if twin["status"] == "active" or existing is None:
                return self.reinforce(twin, c), twin["fact_id"]
            action = "supersede"  # a value that comes back replaces what replaced it
        if existing is None and action == "create":
            existing = self.ambiguous(target, said, identity)
        if action == "create" and existing is not None and existing["memory_form"] != "event" and self.text(existing) == said:
            return self.reinforce(existing, c), existing["fact_id"]
        heir = existing if action == "supersede" and existing is not None else {}
        origin = c["origin_trust"]
        lower = existing is not None and TRUST.get(origin, 0) < TRUST.get(existing["origin_trust"], 3)
        held = lower or origin == "untrusted"
        if heir and not held:
            value = merged_value(existing["value"], value)
            said = canonical(value)
        key = f"[{quoted(c['project_id'])},{quoted(c['subject_id'])},{quoted(c['event_id'])},{c['ordinal']},{quoted(c['predicate'])},{said}]"
        fact = {
            "fact_id": hashlib.sha256(key.encode()).hexdigest()[:32], "predicate": c["predicate"], "value": value, "status": "candidate", "confidence": c["confidence"],
            "qualifiers": {**qualifiers, "attributed_to": c["actor_id"] or "third_party"} if origin == "third_party" else qualifiers,
            "valid_from": c["occurred_at"], "valid_to": None, "supersedes_id": None, "source_event_ids": [c["event_id"]], "version": 1, "reinforcement_count": 0, "last_reinforced_at": None,
            "fact_kind": c["fact_kind"] or heir.get("fact_kind") or "attribute", "volatility": c["volatility"] or heir.get("volatility") or "stable",
            "memory_form": existing["memory_form"] if existing is not None else c["memory_form"] or "state", "reclassified": False, "origin_trust": origin,
            "temporal_range": c["temporal_range"] or heir.get("temporal_range"), "evidence_span": c["evidence_span"],
        }
        if self.semantic:
            fact["e"] = None if vector is None else vector.tolist()
        self.add_fact(fact, said)
        if held:
            self.add_set("quarantine", [fact["fact_id"]], "lower_trust_origin" if lower else "untrusted_origin")
            return "quarantined", fact["fact_id"]
        if action == "supersede":
            if existing is not None:
                self.move(existing, "superseded")
                existing["valid_to"], fact["supersedes_id"] = c["occurred_at"], existing["fact_id"]
            self.move(fact, "active")
            return "superseded" if existing is not None else "created", fact["fact_id"]
        if fact["memory_form"] == "event" or existing is None:
            self.move(fact, "active")
            return "created", fact["fact_id"]
        return self.contradict(existing, fact), fact["fact_id"]

    def contradict(self, existing: dict, fact: dict) -> str:
        """A second value opens a set; a third shows that the predicate never was a state, and all of its values become events."""
        both = self.sides.get(existing["fact_id"])
        if both is None:
            self.add_set("contradiction", [existing["fact_id"], fact["fact_id"]], f"{self.text(existing)} vs {self.text(fact)}")
            return "conflict"
        both["fact_ids"] = [*both["fact_ids"], fact["fact_id"]]
        if len(both["fact_ids"]) <= MOST_SIDES:
            self.sides.setdefault(fact["fact_id"], both)
            return "conflict"
        both["status"] = "reclassified_event"
        for fact_id in both["fact_ids"]:
            place = self.places[fact_id]
            f = self.facts[place]
            own = self.said.get((f["predicate"], *self.texts[place]), [])
            if place in own:
                own.remove(place)
            if f["status"] == "active":
                self.leave(place)
            f["memory_form"], f["reclassified"] = "event", True
            if f["status"] == "active":
                self.enter(place)
            else:
                self.move(f, "active")
            if self.sides.get(fact_id) is both:
                del self.sides[fact_id]
        return "reclassified_event"

    def state(self) -> str:
        return json.dumps([self.facts, self.sets, self.semantic, self.aliases, self.ring], ensure_ascii=False)


def decoded(text):
    """A JSON text's value, None for null or damaged ones."""
    try:
        return json.loads(text) if isinstance(text, str) else None
    except ValueError:
        return None


@lru_cache(1_000)
def _short(text: str, own: bool) -> tuple[dict, str]:
    return _read(text, own)


def _read(text: str | None, own: bool) -> tuple[dict, str]:
    value = decoded(text) or {}
    return value, own_identity(value) if own else canonical(value)


def read_object(text, own: bool = False) -> tuple[dict, str]:
    """A JSON object and its canonical text, that of its identity if ``own``; nobody changes the object, so short ones are remembered."""
    return _short(text, own) if isinstance(text, str) and len(text) <= 200 else _read(text, own)


def plain_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, with moments as text: Arrow's own lists cost far more than pandas' for each value."""

    def values(column: pa.Array) -> list:
        if pa.types.is_timestamp(column.type):
            local = pc.local_timestamp(column) if column.type.tz else column
            return [x.removesuffix(".000000") for x in np.datetime_as_string(local.to_numpy(zero_copy_only=False).astype("datetime64[us]")).tolist()]
        if pa.types.is_list(column.type) or column.null_count and not pa.types.is_string(column.type):
            return column.to_pylist()
        return column.to_numpy(zero_copy_only=False).tolist()

    names = batch.schema.names
    return (dict(zip(names, row)) for row in zip(*map(values, batch.columns)))


def plain(row: dict) -> dict:
    """A row of pandas with None for what is missing and its moment as text."""
    own = {k: None if v is None or v is pd.NaT or isinstance(v, float) and v != v else v for k, v in row.items()}
    return own | {"occurred_at": pd.Timestamp(own["occurred_at"]).isoformat()}


def read_candidate(row: dict) -> dict:
    """A row's candidate with its JSON decoded; moments are texts, which order alike."""
    value, said = read_object(row["value"])
    qualifiers, own = read_object(row["qualifiers"], True)
    return row | {"value": value, "said": said, "qualifiers": qualifiers, "own": own, "temporal_range": decoded(row["temporal_range"]), "origin_trust": row["origin_trust"] or "trusted", "ordinal": int(row["ordinal"])}


def with_identity(judged: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Accepted candidates with the predicate that their class goes by: that of ``aliases`` (project_id, alias, predicate), if any."""
    target = F.coalesce("supersedes_predicate", "predicate")
    rows = judged.filter("error is null and rejected is null").drop("error", "rejected").withColumn("identity", target)
    if aliases is None:
        return rows
    learned = aliases.select("project_id", F.col("alias").alias("identity"), F.col("predicate").alias("means"))
    return rows.join(learned, ["project_id", "identity"], "left").withColumn("identity", F.coalesce("means", "identity")).drop("means")


def applied(own: Identity, row: dict) -> tuple | None:
    """Event, ordinal, outcome and fact of a candidate's row; a packet's row is only remembered."""
    if row.get("served") is not None:
        own.serve(list(row["served"]))
        return None
    c = read_candidate(row)
    return (c["event_id"], c["ordinal"], *own.apply(c))


KINDS = ("fact", "set", "alias", "decision")
DECISION = "event_id string, ordinal int, outcome string, fact_id string"


def consolidate(accepted: DataFrame, semantic: bool = False, kinds: tuple = KINDS) -> DataFrame:
    """Key, ``kind`` (of ``kinds``), and a decision's columns or another's ``body`` (JSON); see ``facts_of`` and the like.

    Candidates need an identity (``with_identity``), whose class is folded; or, if ``semantic``, a vector ``e`` and the packets
    among them (``with_packets``), and a subject is folded, whose classes grow as its statements come.
    """
    key = SUBJECT if semantic else CLASS
    dealt = accepted.repartition(*key).sortWithinPartitions(*key, *_order(accepted))
    fields = [(k, pa.string()) for k in [*key, "kind", "event_id"]] + [("ordinal", pa.int32())] + [(k, pa.string()) for k in ("outcome", "fact_id", "body")]
    schema, decided = pa.schema(fields), "decision" in kinds

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own, out = None, Identity(semantic=semantic), []
        shown = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), fields)], schema=schema)
        for batch in batches:
            for row in plain_rows(batch):
                at = tuple([row[k] for k in key])
                if at != place:
                    out += closing(place, own, kinds)
                    place, own = at, Identity(semantic=semantic)
                if (told := applied(own, row)) and decided:
                    out.append((*at, "decision", *told, None))
            if out:
                yield shown(out)
            out = []
        if out := closing(place, own, kinds):
            yield shown(out)

    return dealt.mapInArrow(fold, ", ".join(f"{k} string" for k in [*key, "kind"]) + f", {DECISION}, body string")


def with_packets(judged: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """Accepted candidates, with their vectors ``e``, and among them the packets (project_id, subject_id, served_at, fact_ids) served.

    A packet counts for what is said at its own moment and later.
    """
    rows = judged.filter("error is null and rejected is null").drop("error", "rejected").withColumn("served", F.lit(None).cast("array<string>"))
    if packets is None:
        return rows
    sent = packets.select(*SUBJECT, F.col("served_at").alias("occurred_at"), F.coalesce("fact_ids", F.array().cast("array<string>")).alias("served"))
    return rows.unionByName(sent, allowMissingColumns=True)


def _order(accepted: DataFrame) -> list:
    """Packets before what is said at the same moment."""
    first = [F.col("served").isNull()] if "served" in accepted.columns else []
    return [F.col("occurred_at"), *first, F.col("event_id"), F.col("ordinal")]


def closing(place: tuple | None, own: Identity, kinds: tuple) -> list[tuple]:
    """The rows of a class's facts and sets, and of the names that a subject's predicates go by."""
    if place is None:
        return []
    text = lambda x: x if x is None or isinstance(x, str) else canonical(x)
    fact = lambda f, said: compact({**f, "value": said, "qualifiers": text(f["qualifiers"]), "temporal_range": text(f["temporal_range"]), "e": None})
    rows = lambda kind, bodies: [(*place, kind, None, None, None, None, x) for x in bodies] if kind in kinds else []
    learned = ({"alias": a, "predicate": p, "confidence": n} for a, (p, n) in own.aliases.items())
    return rows("fact", (fact(f, said) for f, (said, _) in zip(own.facts, own.texts))) + rows("set", map(compact, own.sets)) + rows("alias", map(compact, learned))


def _bodies(folded: DataFrame, kind: str, schema: str) -> DataFrame:
    key = [k for k in CLASS if k in folded.columns]
    return folded.filter(F.col("kind") == kind).select(*key, F.from_json("body", schema).alias("b")).select(*key, "b.*")


def facts_of(folded: DataFrame) -> DataFrame:
    """The facts; when one is about (``observed_at``) follows from its value and range."""
    facts = _bodies(folded, "fact", FACT)
    at = observed_at(F.col("value"), F.col("temporal_range"))
    return facts.withColumn("observed_at", F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))


def sets_of(folded: DataFrame) -> DataFrame:
    return _bodies(folded, "set", SET)


def aliases_of(folded: DataFrame) -> DataFrame:
    """What a semantic fold has learned: (project_id, subject_id, alias, predicate, confidence)."""
    return _bodies(folded, "alias", "alias string, predicate string, confidence double")


def decisions_of(folded: DataFrame) -> DataFrame:
    return folded.filter("kind = 'decision'").select(*[k for k in CLASS if k in folded.columns], "event_id", "ordinal", "outcome", "fact_id")


def consolidate_stream(accepted: DataFrame, semantic: bool = False) -> DataFrame:
    """The same over a stream: each key's facts and sets are its state, and every candidate gives a decision row.

    Candidates of one micro-batch are folded in the order of their events; a later batch cannot reach behind an earlier one.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    key = SUBJECT if semantic else CLASS
    columns = [*key, "event_id", "ordinal", "outcome", "fact_id"]
    schema = ", ".join(f"{k} {'int' if k == 'ordinal' else 'string'}" for k in columns)

    def step(at: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = Identity(*json.loads(state.get[0])) if state.exists else Identity(semantic=semantic)
        rows = pd.concat(list(batches))
        rows["_said"] = rows["served"].isna() if "served" in rows else True
        told = [applied(own, plain(row)) for row in rows.sort_values(["occurred_at", "_said", "event_id", "ordinal"]).to_dict("records")]
        state.update((own.state(),))
        yield pd.DataFrame([(*at, *x) for x in told if x], columns=columns)

    return accepted.groupBy(*key).applyInPandasWithState(step, schema, "body string", "append", GroupStateTimeout.NoTimeout)
