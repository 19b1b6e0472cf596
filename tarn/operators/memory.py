"""Conversation units, extracted facts and their keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks a correction, and what marks architecture.
CORRECTIONS = [
    r"(?:actually|correction|wrong|mistake|not (?:right|correct)|should be|instead of)",
    r"(?:the (?:real|actual|correct) (?:way|approach|pattern))",
    r"(?:discovered|found out|realized|turns out)",
]
ARCHITECTURE = [
    r"(?:deploys? (?:via|using|with)|uses? (?:argocd|kubernetes|helm|docker))",
    r"(?:database|schema|migration|table|column)",
    r"(?:api|endpoint|route|handler|middleware)",
    r"(?:service|microservice|container|pod|namespace)",
    r"(?:pipeline|workflow|dag|step|stage)",
]
#: Passing states, and what makes a fact significant.
TRANSIENT = [
    r"currently (?:debugging|investigating|working on|looking at)",
    r"(?:todo|fixme|hack|workaround)",
    r"(?:trying|let me|i think|maybe|perhaps)",
    r"(?:this session|right now|at the moment)",
]
SIGNIFICANT = [
    r"(?:deploys?|deployment|infrastructure)",
    r"(?:database|schema|migration|model)",
    r"(?:api|endpoint|interface|contract)",
    r"(?:service|pipeline|workflow|queue)",
    r"(?:configuration|environment|secret)",
    r"(?:convention|pattern|standard|rule)",
    r"(?:depends? on|requires?|connects? to)",
]
#: Words that turn a statement round.
POLARITY = ["not", "no", "never", "none", "disabled", "enabled", "removed", "added", "off", "on", "without", "with"]


def session_units(turns: DataFrame) -> DataFrame:
    """``conv_id, body, turns``: one unit a session, ``speaker: text`` in order; the id stays out of the text."""
    said = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("said"))
    return grouped.select("conv_id", F.array_join(F.col("said.line"), "\n\n").alias("body"), F.size("said").cast("long").alias("turns"))


def any_of(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(patterns))


def extract_facts(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``session, ts, fact, confidence`` and the ``keep`` columns of ``messages (session, ts, text)``: sentences that correct or describe architecture."""
    keep = keep or []
    some = messages.where((F.length("text") >= 20) & any_of(F.lower("text"), CORRECTIONS + ARCHITECTURE))
    sentences = some.select(*keep, "session", "ts", F.explode(F.split("text", r"[.!?\n]")).alias("raw")).withColumn("fact", F.trim("raw"))
    fit = any_of(F.lower("raw"), CORRECTIONS + ARCHITECTURE) & F.length("fact").between(21, 499)
    return sentences.where(fit).select(*keep, "session", "ts", "fact", F.when(any_of(F.lower("fact"), CORRECTIONS), 0.8).otherwise(0.5).alias("confidence"))


def fingerprint(fact: Column) -> Column:
    return F.lower(F.substring(fact, 1, 80))


def fact_queue(facts: DataFrame, most: int = 100) -> DataFrame:
    """Facts folded by fingerprint: the first wording stays, sessions gather, the newest ``most`` keys stay queued."""
    folded = facts.groupBy(fingerprint(F.col("fact")).alias("fp")).agg(
        F.min_by("fact", "ts").alias("fact"), F.min_by("confidence", "ts").alias("confidence"),
        F.countDistinct("session").alias("sessions"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    return folded.orderBy(F.desc("first_seen"), F.desc("fp")).limit(most)


def significant(fact: Column) -> Column:
    return ~any_of(F.lower(fact), TRANSIENT) & any_of(F.lower(fact), SIGNIFICANT)


def same_statement(a: Column, b: Column, least: float = 0.8) -> Column:
    """Token Jaccard of ``least`` or more, the same numbers and the same polarity."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    x, y = words(a), words(b)
    numbers = lambda w: F.array_sort(F.filter(w, lambda t: t.rlike(r"[0-9]")))
    turned = lambda w: F.array_sort(F.array_intersect(w, F.array(*map(F.lit, POLARITY))))
    union = F.size(F.array_union(x, y))
    jaccard = F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)
    return (jaccard >= least) & (numbers(x) == numbers(y)) & (turned(x) == turned(y))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
