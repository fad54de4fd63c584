"""Loaders of the two evaluation data sets, and the extractor of facts that an event carries itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col

MESSAGE = "struct<role:string,content:string>"
SESSIONS = f"""question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>,
 haystack_dates array<string>, haystack_sessions array<array<{MESSAGE}>>, answer_session_ids array<string>"""
DIALOGUES = """sample_id string, conversation map<string,string>,
 qa array<string>"""
ASKED = "struct<question:string,answer:string,category:int,evidence:array<string>>"
#: Kinds of questions that no one can answer, and the day that sessions without any date are laid on.
ABSTENTIONS, FALLBACK = ("abstention", "adversarial"), "2023-01-01 00:00:00"
#: The question kinds by their number in the data.
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}
CANDIDATES = """array<struct<subject_id:string,predicate:string,value:string,qualifiers:string,confidence:double,action:string,
 supersedes_predicate:string,evidence_span:string,reject_reason:string,fact_kind:string,volatility:string,memory_form:string,temporal_range:string>>"""


def dated(said: str) -> F.Column:
    """``2023/06/01 (Thu) 10:00`` or ``1:56 pm on 8 May, 2023`` as a timestamp; null for anything else."""
    plain = F.regexp_replace(c(said), r"\s*\([A-Za-z]+\)", "")
    spoken = F.regexp_replace(F.upper(said), r"^(\d{1,2}:\d{2} [AP]M) ON (\d{1,2}) ([A-Z])", "$1 ON $2 $3")
    # Month names are read letter for letter, so they get their usual case back.
    spoken = F.concat(F.regexp_extract(spoken, r"^(\d{1,2}:\d{2} [AP]M)", 1), F.lit(" "), F.initcap(F.regexp_extract(spoken, r"ON (.*)$", 1)))
    return F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(plain, F.lit("yyyy/MM/dd")), F.try_to_timestamp(spoken, F.lit("h:mm a d MMMM, yyyy")))


def filled_dates(sessions: DataFrame, of: str, session: str) -> DataFrame:
    """A session without a date is laid on the day of the last one before it that has one, at the hour of its number."""
    before = F.last("occurred_at", ignorenulls=True).over(W.partitionBy(of).orderBy(session).rowsBetween(W.unboundedPreceding, -1))
    base = F.coalesce(before, F.lit(FALLBACK).cast("timestamp"))
    laid = F.date_trunc("day", base) + F.make_dt_interval(hours=c(session) % 24, mins=F.minute(base))
    return sessions.withColumn("occurred_at", F.coalesce("occurred_at", laid))


def session_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions: list answers joined by ``; ``, abstention by kind or by an id that ends in ``_abs``."""
    rows = spark.read.schema(SESSIONS).json(path, multiLine=True)
    several = F.from_json("answer", "array<string>")
    answer = F.when(c("answer").startswith("["), F.concat_ws("; ", several)).otherwise(c("answer"))
    abstains = c("question_type").isin(*ABSTENTIONS) | c("question_id").endswith("_abs")
    return rows.select("question_id", "question_type", "question", answer.alias("answer"), dated("question_date").alias("asked_at"), F.coalesce(abstains, F.lit(False)).alias("abstention"), "answer_session_ids")


def session_turns(spark: SparkSession, path: str) -> DataFrame:
    """One row for each message of each question's sessions, in order."""
    rows = spark.read.schema(SESSIONS).json(path, multiLine=True)
    zipped = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    # A session's id is a list of ids, read here as its JSON text.
    joined = F.when(c("session_id").startswith("["), F.array_join(F.from_json("session_id", "array<string>"), "+")).otherwise(c("session_id"))
    sessions = rows.select("question_id", F.posexplode(zipped).alias("session", "s")).select("question_id", "session", c("s.haystack_session_ids").alias("session_id"), c("s.haystack_dates").alias("said"), c("s.haystack_sessions").alias("messages"))
    sessions = filled_dates(sessions.withColumn("session_id", joined).withColumn("occurred_at", dated("said")), "question_id", "session")
    return sessions.select("question_id", "session", "session_id", "occurred_at", F.posexplode("messages").alias("turn", "m")).select("question_id", "session", "session_id", "occurred_at", "turn", "m.*")


def dialogue_turns(spark: SparkSession, path: str) -> DataFrame:
    """One row for each turn of the numbered sessions, up to the first number that is missing."""
    rows = spark.read.schema(DIALOGUES).json(path, multiLine=True)
    entries = rows.select("sample_id", "conversation", F.explode("conversation").alias("name", "body")).filter(c("name").rlike(r"^session_\d+$"))
    numbered = entries.withColumn("session", F.regexp_extract("name", r"(\d+)$", 1).cast("int"))
    unbroken = numbered.withColumn("nth", F.row_number().over(W.partitionBy("sample_id").orderBy("session"))).filter("nth = session")
    said = unbroken.withColumn("said", F.try_element_at("conversation", F.concat("name", F.lit("_date_time")))).withColumn("occurred_at", dated("said"))
    turns = F.from_json("body", "array<struct<speaker:string,dia_id:string,text:string>>")
    said = filled_dates(said, "sample_id", "session")
    return said.select("sample_id", "session", "occurred_at", F.posexplode(turns).alias("turn", "t")).select("sample_id", "session", "occurred_at", "turn", "t.*")


def dialogue_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with the name of their kind, whether none can answer them, the speakers, and the sessions that hold their evidence.

    An answer that is null is ``unanswerable``; one that isn't given at all is empty. Evidence counts where it begins with its session.
    """
    speakers = F.filter(F.array("conversation.speaker_a", "conversation.speaker_b"), lambda s: s.isNotNull() & (s != ""))
    raw = spark.read.schema(DIALOGUES).json(path, multiLine=True).select("sample_id", speakers.alias("speakers"), F.posexplode("qa").alias("number", "raw"))
    given = F.array_contains(F.json_object_keys("raw"), "answer")
    rows = raw.withColumn("q", F.from_json("raw", ASKED)).select("sample_id", "speakers", "number", "q.*", given.alias("given"))
    rows = rows.withColumn("unanswerable", c("given") & c("answer").isNull()).withColumn("answer", F.coalesce("answer", F.when(c("given"), "unanswerable").otherwise("")))
    names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    found = F.filter(F.transform("evidence", lambda e: F.regexp_extract(e, r"^D(\d+):", 1)), lambda x: x != "")
    kind = F.coalesce(F.try_element_at(names, c("category")), F.concat(F.lit("category-"), F.coalesce("category", F.lit(0)).cast("string")))
    sessions = F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))
    return rows.select("sample_id", "number", "question", "answer", "speakers", kind.alias("kind"), (kind.isin(*ABSTENTIONS) | c("unanswerable")).alias("abstention"), F.coalesce(sessions, F.array().cast("array<int>")).alias("evidence_sessions"))


def carried_facts(events: DataFrame, payload: str = "payload") -> DataFrame:
    """The candidates in each event's ``mock_facts``, one row each, with the event's other columns; malformed ones are left out."""
    listed = F.from_json(F.get_json_object(payload, "$.mock_facts"), CANDIDATES)
    return events.withColumn("candidate", F.explode(listed)).filter("candidate.predicate is not null").select(*events.columns, "candidate.*")
