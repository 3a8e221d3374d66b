"""Texts that are put together for a reader or a model: evidence lines, rerank texts, numbered contexts, prompts;
compacted texts and redacted payloads."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A JSON field whose name holds one of these is redacted.
SECRET_FIELDS = ("password", "token", "secret", "api_key", "credit_card", "ssn", "phone", "email", "address", "id_number")
REDACTED = "***REDACTED***"
MOST_CONTEXTS, MOST_TURNS, MOST_LINES, MOST_TERMS = 12, 4, 3, 4


def _filled(column: Column) -> Column:
    return F.when(F.coalesce(column, F.lit("")) != "", column)


def evidence(entity: Column, labels: Column, description: Column, relation: Column, other: Column, fact: Column) -> Column:
    """One line on an entity and, if there is one, its relation."""
    head = F.concat(entity, F.coalesce(F.concat(F.lit(" ("), F.when(F.size(labels) > 0, F.array_join(labels, ", ")), F.lit(")")), F.lit("")))
    tail = F.concat_ws(" -> ", _filled(relation), _filled(other))
    return F.concat_ws("; ", head, _filled(description), _filled(tail), _filled(fact))


def merged_evidence(current: Column, incoming: Column) -> Column:
    """Different lines of two evidences in order, three at most."""
    lines = F.filter(F.array_distinct(F.concat(F.split(F.coalesce(current, F.lit("")), "\n"), F.split(F.coalesce(incoming, F.lit("")), "\n"))), lambda x: x != "")
    return F.array_join(F.slice(lines, 1, MOST_LINES), "\n")


def merged_terms(current: Column, incoming: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(current, empty), F.coalesce(incoming, empty))), 1, MOST_TERMS)


def rerank_text(title: Column, section: Column, content: Column, graph: Column, sources: Column) -> Column:
    """What a reranker reads of a candidate: title, section, body, evidence and channels, each if there is one."""
    parts = [
        F.concat(F.lit("Document: "), F.coalesce(title, F.lit("Unknown"))),
        F.concat(F.lit("Section: "), _filled(section)),
        F.concat(F.lit("Body:\n"), _filled(content)),
        F.concat(F.lit("Evidence:\n"), _filled(graph)),
        F.concat(F.lit("Channels: "), F.when(F.size(sources) > 0, F.array_join(sources, ", "))),
    ]
    return F.concat_ws("\n", *parts)


def context_block(place: Column, title: Column, section: Column, score: Column, content: Column, graph: Column) -> Column:
    """A numbered block of a context; evidence is added where the content doesn't hold it already."""
    body = F.coalesce(_filled(content), graph, F.lit(""))
    extra = F.when(F.coalesce(graph, F.lit("")) != "", F.when(~body.contains(graph), F.concat(F.lit("\nEvidence: "), graph)))
    head = F.format_string("[%d] %s | section=%s | score=%.4f\n", place, F.coalesce(title, F.lit("Unknown")), F.coalesce(_filled(section), F.lit("-")), F.coalesce(score, F.lit(0.0)).cast("double"))
    return F.concat(head, body, F.coalesce(extra, F.lit("")))


def context_text(places: Column, blocks: Column) -> Column:
    """Aggregate: the first twelve blocks of a group by place, parted by blank lines."""
    kept = F.array_sort(F.collect_list(F.when(places <= MOST_CONTEXTS, F.struct(places.alias("place"), blocks.alias("block")))))
    return F.array_join(F.transform(kept, lambda x: x["block"]), "\n\n")


def prompt(question: Column, context: Column, turns: Column) -> Column:
    """A question with its context and the last four turns (an array of question, answer)."""
    last = F.when(F.size(turns) > MOST_TURNS, F.slice(turns, -MOST_TURNS, MOST_TURNS)).otherwise(turns)
    said = F.flatten(F.transform(last, lambda t: F.array_compact(F.array(F.concat(F.lit("User: "), _filled(t["question"])), F.concat(F.lit("Assistant: "), _filled(t["answer"]))))))
    history = F.coalesce(F.when(F.size(said) > 0, F.concat(F.array_join(said, "\n"), F.lit("\n\n"))), F.lit(""))
    rules = "Answer from the context alone; say so if it does not suffice; cite titles in brackets.\n\n"
    return F.concat(F.lit(rules), history, F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def compact(text: Column, most: int = 1000) -> Column:
    """Runs of blanks as one, runs of empty lines as one; longer texts are cut, at a sentence's end if one lies in the last fifth."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    t = F.regexp_replace(t, "\n(?:[ ]*\n){2,}", "\n\n")
    head = F.substring(t, 1, most)
    ends = F.length(F.regexp_extract(head, "(?s)^(.*[.。!！?？])", 1))
    cut = F.when(ends - 1 > most * 0.8, F.concat(F.substring(head, F.lit(1), ends), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    return F.regexp_replace(F.when(F.length(t) > most, cut).otherwise(t), r"^\s+|\s+$", "")


def redacted_json(payload: Column) -> Column:
    """A JSON text whose secret fields, at any depth, have their scalar values replaced."""
    names = "|".join(map(re.escape, SECRET_FIELDS))
    value = r'"(?:[^"\\]|\\.)*"|-?\d[\d.eE+-]*|true|false|null'
    return F.regexp_replace(payload, rf'(?i)("[^"\\]*(?:{names})[^"\\]*"\s*:\s*)(?:{value})', f'$1"{REDACTED}"')
