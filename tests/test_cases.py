"""Fixed cases of the parsers: what each is known to give for a note, a message, a log line."""

import pytest
from pyspark.sql import functions as F

from tarn.functions import chunking as C
from tarn.functions import text as X
from tarn.operators import lexical as L
from tarn.operators import memory as K
from tarn.operators import rank as R
from tarn.sources.logs import parse_hit_log, parse_transcript

ALPHA = """---
type: note
title: "Alpha note"
search: "Exclude"
supersedes: [beta, dir/gamma.md, [[delta]]]
superseded_by:\x20
valid_until: 2024-05-01
---
# Alpha one

Intro text here ^intro

## Setup steps ^setup

Do it. See [[beta#^x]] and [[gamma|G]] and [[beta]].

```
## not a heading
```

## Usage/Notes

Run it `^code` now ^run-it
^renamed

## Empty

## Data Flow

### Inner
a to b ^flow-a"""


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(1, "alpha", ALPHA), (2, "beta", "# Beta title\n\nBody of beta with [[alpha]] only."), (3, "gamma", "---\ntitle: Gamma\nsearch: include\n---\nplain gamma text"), (4, "delta", "no title, ^lonely")]
    return spark.createDataFrame(rows, "id long, slug string, content string")


def test_front_matter(notes):
    front = X.front_matter(F.col("content"))
    got = {r.id: (r.t, r.x) for r in notes.select("id", X.front_value(front, "title").alias("t"), X.excluded(F.col("content")).alias("x")).collect()}
    assert got == {1: ("Alpha note", True), 2: (None, False), 3: ("Gamma", False), 4: (None, False)}


def test_headings(notes):
    got = {(r.slug, r.block_id): (r.heading, r.content) for r in C.heading_sections(notes).collect()}
    assert set(got) == {("alpha", "overview"), ("alpha", "setup"), ("alpha", "renamed"), ("alpha", "data-flow"), ("beta", "overview"), ("gamma", "overview"), ("delta", "overview")}
    assert got["alpha", "setup"][0] == "Setup steps" and "## not a heading" in got["alpha", "setup"][1]
    assert got["gamma", "overview"] == ("Overview", "plain gamma text")


def test_anchors_and_links(notes):
    got = {r.id: (sorted(r.a), list(r.l)) for r in notes.select("id", X.anchors(F.col("content")).alias("a"), X.wikilinks(F.col("content")).alias("l")).collect()}
    assert got[1] == (["flow-a", "intro", "renamed", "run-it", "setup"], ["delta", "beta", "gamma"])
    assert got[2] == ([], ["alpha"]) and got[4] == (["lonely"], [])


def test_facts_and_their_queue(spark):
    rows = [
        ("s1", 1, "The api gateway uses docker and the port is 8080. Short one. Actually the database schema should be version 12 instead of 11!"),
        ("s2", 2, "the api gateway uses docker and the port is 8080"), ("s2", 3, "too short api"), ("s3", 4, "Nothing of note in this long message about the weather today."),
        ("s3", 5, "Let me think: maybe the pipeline workflow needs a hack for now\nThe search-index service must connect to postgres always"), ("s4", 6, "the search-index service must connect to postgres always"),
    ]
    facts = K.extract_facts(spark.createDataFrame(rows, "session string, ts long, text string"))
    assert sorted((r.ts, r.confidence) for r in facts.collect()) == [(1, 0.5), (1, 0.8), (2, 0.5), (5, 0.5), (5, 0.5), (6, 0.5)]
    queue = {r.fp: (r.sessions, r.first_seen, r.sig) for r in K.fact_queue(facts).withColumn("sig", K.significant(F.col("fact"))).collect()}
    assert queue["the api gateway uses docker and the port is 8080"] == (2, 1, True)
    assert queue["the search-index service must connect to postgres always"] == (2, 5, True)
    assert queue["let me think: maybe the pipeline workflow needs a hack for now"] == (1, 5, False)
    assert len(K.fact_queue(facts, most=2).collect()) == 2


@pytest.mark.parametrize(
    ("a", "b", "known"),
    [
        ("the cache runs on port 6379 in production", "In production the cache runs on port 6379.", True),
        ("the cache runs on port 6379 in production", "The cache runs on port 6380 in production", False),
        ("the flag is enabled by default now", "the flag is not enabled by default now", False),
        ("completely different words here", "nothing alike at all", False),
        ("", "", False),
    ],
)
def test_same_statement(spark, a, b, known):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(K.same_statement(F.col("a"), F.col("b"))).first()[0] is known


def test_log_lines(spark):
    lines = ['{"ts": 5, "q": "a b", "slugs": ["x", "y"], "sid": "s1"}', '{"ts": 6, "kind": "read", "slug": "x"}', "not json", '{"ts": 7, "kind": "read"}', '{"ts": 8, "q": "c"}', '{"ts": 9, "q": "d", "slugs": []}']
    got = parse_hit_log(spark.createDataFrame(list(enumerate(lines, 1)), "i int, line string"), "line").collect()
    assert sorted((r.i, r.kind, r.ts) for r in got) == [(1, "search", 5), (2, "read", 6), (6, "search", 9)]


def test_transcripts(spark):
    lines = [
        '{"type": "user", "message": {"content": "hello there"}}', '{"type": "user", "isMeta": true, "message": {"content": "meta"}}',
        '{"type": "assistant", "message": {"content": [{"type": "text", "text": "part one"}, {"type": "tool_use", "name": "t"}, {"type": "text", "text": "part two"}]}}',
        '{"type": "system", "message": {"content": "no"}}', '{"type": "user", "isSidechain": true, "message": {"content": "side"}}',
    ]
    got = parse_transcript(spark.createDataFrame(list(enumerate(lines, 1)), "i int, line string"), "line").collect()
    assert sorted((r.i, r.role, r.text) for r in got) == [(1, "user", "hello there"), (3, "assistant", "part one\npart two")]


def test_limits_and_pools(spark):
    rows = [("5", True, 40), ("0", False, 40), ("-1", True, 10), ("1000", True, 40), ("ten", False, 40), (None, True, 3)]
    frame = spark.createDataFrame(rows, "asked string, rerank boolean, depth int").withColumn("n", R.clamp_limit(F.col("asked")))
    got = [(r.n, r.p) for r in frame.select("n", R.pool_size(F.col("n"), F.col("rerank"), F.col("depth")).alias("p")).collect()]
    assert got == [(5, 40), (1, 2), (1, 10), (100, 200), (10, 20), (10, 20)]


def test_triggers(spark):
    skills = spark.createDataFrame([("deploy", "Deploys services with containers and runs migration scripts"), ("write", "Writing papers, drafting paragraphs and reviewing prose"), ("none", "")], "skill string, description string")
    prompts = spark.createDataFrame([(1, "deploy", "please deploy the containers tonight"), (2, "write", "review my paragraph about migrations"), (3, "deploy", "what time is it"), (4, "none", "anything at all")], "prompt int, item string, text string")
    got = {r.skill: (r.overlap, round(r.accuracy, 6)) for r in L.trigger_accuracy(prompts, skills).collect()}
    # the second prompt shares "migrations" with the first skill, the third nothing with any
    assert got == {"deploy": (3, 0.5), "write": (2, 1.0), "none": (0, 0.75)}
