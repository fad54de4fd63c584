"""Conversations as text: three forms of a session's transcript, message contents, and a memory block put before them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .messages import json_object

MESSAGES = "array<map<string,variant>>"


def json_string(x: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(x))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def plain_transcript(session: Column, at: Column, turns: Column) -> Column:
    """A headline with the session's name and moment, then a line for each turn (array of struct<speaker, content>)."""
    head = F.concat(F.lit("--- session "), session, F.lit(" ("), F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(" UTC) ---"))
    return F.concat_ws("\n", F.array(head), F.transform(turns, lambda t: F.concat(t.speaker, F.lit(": "), t.content)))


def dated_transcript(at: Column, turns: Column) -> Column:
    """Each turn with its session's moment, without headlines."""
    moment = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat_ws("\n", F.transform(turns, lambda t: F.concat(moment, F.lit(" | "), t.speaker, F.lit(": "), t.content)))


def session_history(number: Column, at: Column, turns: Column) -> Column:
    """A block of the session's number, moment and turns as JSON."""
    said = F.transform(turns, lambda t: F.concat(F.lit('{"role": '), json_string(t.speaker), F.lit(', "content": '), json_string(t.content), F.lit("}")))
    moment = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(F.lit("\n### Session "), number.cast("string"), F.lit(":\nSession Date: "), moment, F.lit("\nSession Content:\n\n["), F.array_join(said, ", "), F.lit("]\n"))


def content_text(content: Column) -> Column:
    """A message's content (variant) as text: a string, or the text parts of a list, a line each; null if there is none."""
    kind = F.schema_of_variant(content)
    parts = F.from_json(F.to_json(content), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: (p.type == "text") & (F.coalesce(p.text, F.lit("")) != "")), lambda p: p.text), "\n")
    return F.nullif(F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), joined), F.lit(""))


def last_user_text(messages: Column) -> Column:
    """What the user said last in a JSON list of messages, as text; null if there is nothing."""
    own = F.filter(F.from_json(messages, MESSAGES), lambda m: F.try_variant_get(F.try_element_at(m, F.lit("role")), "$", "string") == "user")
    return content_text(F.try_element_at(F.try_element_at(own, F.lit(-1)), F.lit("content")))


def with_memory(messages: Column, block: Column) -> Column:
    """A JSON list of messages with a block at the start of its first system message, or in a new one; an empty block changes nothing."""
    listed = F.from_json(messages, MESSAGES)
    is_system = lambda m: F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit("role")), "$", "string") == "system", F.lit(False))
    first = F.array_position(F.transform(listed, is_system), F.lit(True))
    part = F.concat(F.lit('{"text":'), json_string(block), F.lit(',"type":"text"}'))

    def told(m):
        content = F.try_element_at(m, F.lit("content"))
        old = F.coalesce(F.try_variant_get(content, "$", "string"), F.lit(""))
        listed_parts = F.to_json(content)
        rest = F.substr(listed_parts, F.lit(2), F.length(listed_parts) - 2)
        as_list = F.concat(F.lit("["), F.concat_ws(",", part, F.nullif(rest, F.lit(""))), F.lit("]"))
        as_text = json_string(F.when(old == "", block).otherwise(F.concat(block, F.lit("\n\n"), old)))
        new = F.when(F.startswith(F.coalesce(F.schema_of_variant(content), F.lit("")), F.lit("ARRAY")), as_list).otherwise(as_text)
        entries = F.filter(F.map_entries(m), lambda e: e.key != "content")
        return json_object(F.array_append(entries, F.struct(F.lit("content").alias("key"), F.parse_json(new).alias("value"))))

    shown = F.transform(listed, lambda m, i: F.when(i + 1 == first, told(m)).otherwise(json_object(F.map_entries(m))))
    created = F.concat(F.lit('{"content":'), json_string(block), F.lit(',"role":"system"}'))
    every = F.when(F.coalesce(block, F.lit("")) == "", F.transform(listed, lambda m: json_object(F.map_entries(m)))).when(first > 0, shown).otherwise(F.concat(F.array(created), shown))
    return F.concat(F.lit("["), F.array_join(every, ","), F.lit("]"))
