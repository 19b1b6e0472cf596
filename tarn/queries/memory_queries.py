"""Facts, memory, link graph and promotion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.operators import memory as K
from tarn.operators import metrics as M
from tarn.queries import derived, fixture, query
from tarn.queries.rank_queries import EDGES_SQL, edges
from tarn.queries.text_queries import NOTES, notes
from tarn.sources.tables import sections, table

#: Every turn of the conversations with a remark at its end, about one of the nations at times.
MESSAGES = """(SELECT 's' || conv_id AS session, turn * 1000000 + conv_id AS ts, text || chr(10) || CASE (conv_id + turn) % 7
WHEN 0 THEN 'The api gateway of ' || replace(lower(n_name), ' ', '-') || ' uses docker and the port is ' || (8080 + conv_id % 9) || '. Short one. Actually the database schema should be version 12 instead of ' || (conv_id % 5) || '!'
WHEN 1 THEN 'the api gateway of ' || lower(n_name) || ' uses docker and the port is ' || (8080 + conv_id % 9) WHEN 2 THEN 'too short api' WHEN 3 THEN 'Nothing of note in this long message about the weather today.'
WHEN 4 THEN 'Let me think: maybe the pipeline workflow needs a hack for now' || chr(10) || 'The search-index service must connect to postgres always' WHEN 5 THEN 'the search-index service must connect to postgres always'
ELSE 'A convention: the schema of ' || n_name || ' requires a migration' END AS text FROM conversations JOIN nation ON n_nationkey = conv_id % 25) AS m"""
ALL = "|".join(K.CORRECTIONS + K.ARCHITECTURE)
FIX = "|".join(K.CORRECTIONS)
FACTS_SQL = f"""(SELECT session, ts::BIGINT AS ts, trim(raw) AS fact, CASE WHEN regexp_matches(lower(trim(raw)), '{FIX}') THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence
    FROM (SELECT session, ts, unnest(string_split_regex(text, '[.!?\\n]')) AS raw FROM {MESSAGES} WHERE length(text) >= 20) WHERE regexp_matches(lower(raw), '{ALL}') AND length(trim(raw)) BETWEEN 21 AND 499)"""
QUEUE_SQL = f"(SELECT lower(left(fact, 80)) AS fp, arg_min(fact, ts) AS fact, arg_min(confidence, ts) AS confidence, count(DISTINCT session)::BIGINT AS sessions, min(ts) AS first_seen, max(ts) AS last_seen FROM {FACTS_SQL} GROUP BY 1 ORDER BY first_seen DESC, fp DESC LIMIT 100)"
SIGNIFICANT_SQL = f"(NOT regexp_matches(lower(fact), '{'|'.join(K.TRANSIENT)}') AND regexp_matches(lower(fact), '{'|'.join(K.SIGNIFICANT)}'))"


def facts(spark, sf):
    return K.extract_facts(derived(spark, sf, MESSAGES))


def queue(spark, sf):
    return K.fact_queue(facts(spark, sf))


@query("extract_facts", f"SELECT session, ts, fact, confidence FROM {FACTS_SQL}")
def extract_facts(spark, sf):
    return facts(spark, sf)


@query("fact_queue", f"SELECT * FROM {QUEUE_SQL}")
def fact_queue(spark, sf):
    return queue(spark, sf)


@query("stable_facts", f"SELECT fp, sessions FROM {QUEUE_SQL} WHERE sessions >= 2")
def stable_facts(spark, sf):
    return queue(spark, sf).where("sessions >= 2").select("fp", "sessions")


@query("significant_facts", f"SELECT fp, {SIGNIFICANT_SQL} AS significant FROM {QUEUE_SQL}")
def significant_facts(spark, sf):
    return queue(spark, sf).select("fp", K.significant(F.col("fact")).alias("significant"))


SLUGS = "(SELECT n_nationkey AS i, replace(lower(n_name), ' ', '-') AS slug FROM nation) AS s"
TARGET_SQL = f"""(SELECT fp, fact, arg_min(slug, i) AS target FROM {QUEUE_SQL} CROSS JOIN (SELECT i, slug, unnest([slug, replace(slug, '-', ' '), replace(slug, '-', '_')]) AS c FROM {SLUGS})
    WHERE (length(c) >= 7 OR regexp_matches(c, '[-_ ]')) AND regexp_matches(lower(fact), '(^|[^a-z0-9])' || c || '($|[^a-z0-9])') GROUP BY fp, fact)"""


def targets(spark, sf):
    """The first slug that a fact names, whole words only, generic ones aside. Facts meet slugs by the slug's first word."""
    c = derived(spark, sf, SLUGS).select("i", "slug", F.explode(F.array("slug", F.translate("slug", "-", " "), F.translate("slug", "-", "_"))).alias("c"))
    c = c.where((F.length("c") >= 7) | F.col("c").rlike("[-_ ]")).withColumn("word", F.regexp_extract("c", "[a-z0-9]+", 0))
    said = queue(spark, sf).select("fp", "fact", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("fact"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))
    named = F.regexp_like(F.lower("fact"), F.concat(F.lit("(?<![a-z0-9])"), "c", F.lit("(?![a-z0-9])")))
    return said.join(c, "word").where(named).groupBy("fp", "fact").agg(F.min_by("slug", "i").alias("target"))


@query("fact_target", f"SELECT fp, target FROM {TARGET_SQL}")
def fact_target(spark, sf):
    return targets(spark, sf).select("fp", "target")


#: Statements about every turn, and what is said of it later: the same in other words, another number, the opposite, or something else.
PAIRS = """(SELECT conv_id * 1000 + turn AS id, 'the cache of ' || text || ' runs on port ' || turn || ' in production' AS a, CASE conv_id % 5 WHEN 0 THEN 'In production the cache of ' || text || ' runs on port ' || turn || '.'
WHEN 1 THEN 'The cache of ' || text || ' runs on port ' || (turn + 1) || ' in production' WHEN 2 THEN 'the cache of ' || text || ' not runs on port ' || turn || ' in production' WHEN 3 THEN 'completely different words here' ELSE '' END AS b FROM conversations) AS p"""


@query(
    "known_facts",
    f"""WITH w AS (SELECT id, list_distinct(regexp_extract_all(lower(a), '[a-z0-9]+')) AS x, list_distinct(regexp_extract_all(lower(b), '[a-z0-9]+')) AS y FROM {PAIRS}),
    f AS (SELECT *, {K.POLARITY} AS pol FROM w)
    SELECT id::BIGINT AS id, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN false ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE >= 0.8 END
      AND list_sort(list_filter(x, lambda t: regexp_matches(t, '[0-9]'))) = list_sort(list_filter(y, lambda t: regexp_matches(t, '[0-9]'))) AND list_sort(list_intersect(x, pol)) = list_sort(list_intersect(y, pol)) AS known FROM f""",
)
def known_facts(spark, sf):
    return derived(spark, sf, PAIRS).select(F.col("id").cast("long").alias("id"), K.same_statement(F.col("a"), F.col("b")).alias("known"))


@query("find_supersedes", f"""WITH w AS (SELECT id, list_distinct(regexp_extract_all(lower(a), '[a-z0-9]+')) AS x, list_distinct(regexp_extract_all(lower(b), '[a-z0-9]+')) AS y FROM {PAIRS} WHERE a <> '')
    SELECT id::BIGINT AS id FROM w WHERE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE >= 0.5
      AND list_sort(list_filter(x, lambda t: regexp_matches(t, '[0-9]'))) <> list_sort(list_filter(y, lambda t: regexp_matches(t, '[0-9]')))""")
def find_supersedes(spark, sf):
    """Pairs whose words overlap by half and whose numbers differ: the newer statement replaces the older."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    numbers = lambda c: F.array_sort(F.filter(words(c), lambda t: t.rlike("[0-9]")))
    p = derived(spark, sf, PAIRS).where("a <> ''")
    jaccard = F.size(F.array_intersect(words(F.col("a")), words(F.col("b")))) / F.size(F.array_union(words(F.col("a")), words(F.col("b"))))
    return p.where((jaccard >= 0.5) & (numbers(F.col("a")) != numbers(F.col("b")))).select(F.col("id").cast("long").alias("id"))


@query("provenance", f"SELECT fp, sessions, first_seen FROM {QUEUE_SQL}")
def provenance(spark, sf):
    return queue(spark, sf).select("fp", "sessions", "first_seen")


@query("repeat_request")
def repeat_request(spark, sf):
    """Prompts that come close to one asked before the previous one (difflib's ratio, one conversation a task)."""
    import difflib

    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        past, out = [], []
        for text in pdf["norm"]:
            older = past[:-1]
            near = len(text) >= 8 and any(not o or o == text or difflib.SequenceMatcher(None, text, o).ratio() >= 0.6 for o in older)
            out.append(bool(near))
            past.append(text)
        return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "repeats": out})

    from tarn.functions.text import normalize

    c = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", normalize(F.col("text")).alias("norm"))
    return c.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, repeats boolean")


NODES_SQL = "(SELECT DISTINCT lang || '-' || source AS slug FROM documents)"


def nodes(spark, sf):
    return sections(spark, sf).select("slug").distinct()


@query("link_degrees", f"WITH o AS (SELECT src AS slug, count(*) AS o FROM {EDGES_SQL} GROUP BY 1), i AS (SELECT dst AS slug, count(*) AS i FROM {EDGES_SQL} GROUP BY 1) SELECT slug, coalesce(o, 0)::BIGINT AS outgoing, coalesce(i, 0)::BIGINT AS incoming FROM {NODES_SQL} LEFT JOIN o USING (slug) LEFT JOIN i USING (slug)")
def link_degrees(spark, sf):
    e = edges(spark, sf)
    ends = e.select(F.col("src").alias("slug"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select(F.col("dst").alias("slug"), F.lit(0), F.lit(1)))
    g = ends.groupBy("slug").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return nodes(spark, sf).join(g, "slug", "left").select("slug", F.coalesce("o", F.lit(0)).cast("long").alias("outgoing"), F.coalesce("i", F.lit(0)).cast("long").alias("incoming"))


@query("isolated_nodes", f"SELECT slug FROM {NODES_SQL} WHERE slug NOT IN (SELECT src FROM {EDGES_SQL}) AND slug NOT IN (SELECT dst FROM {EDGES_SQL})")
def isolated_nodes(spark, sf):
    e = edges(spark, sf)
    ends = e.select(F.col("src").alias("slug")).unionAll(e.select(F.col("dst").alias("slug")))
    return nodes(spark, sf).join(ends, "slug", "left_anti")


NOTE_LINKS = f"(SELECT DISTINCT slug AS src, unnest(regexp_extract_all(content, '\\[\\[([^\\]|#]+)', 1)) AS dst FROM {NOTES})"


@query("dangling_links", f"SELECT src, dst, dst IN (SELECT slug FROM {NOTES}) AS there FROM {NOTE_LINKS}")
def dangling_links(spark, sf):
    """Every link of the notes and whether its target exists."""
    from tarn.functions.text import wikilinks

    n = notes(spark, sf)
    links = n.select(F.col("slug").alias("src"), F.explode(wikilinks(F.col("content"))).alias("dst"))
    return links.join(n.select(F.col("slug").alias("dst"), F.lit(True).alias("there")), "dst", "left").select("src", "dst", F.coalesce("there", F.lit(False)).alias("there"))


@query("incoming_links", f"SELECT dst AS slug, src FROM {NOTE_LINKS} WHERE dst IN (SELECT slug FROM {NOTES}) AND src <> dst")
def incoming_links(spark, sf):
    return dangling_links(spark, sf).where("there AND src <> dst").select(F.col("dst").alias("slug"), "src")


CLAIMED = "(SELECT 'n' || doc_id AS slug, CASE doc_id % 4 WHEN 0 THEN 'setup' WHEN 1 THEN 'gone' WHEN 2 THEN 'flow-' || lang ELSE 'lonely' END AS anchor FROM documents) AS c"


@query("bad_anchors", f"SELECT c.slug, anchor FROM {CLAIMED} LEFT JOIN {NOTES} USING (slug) WHERE NOT list_contains(regexp_extract_all(regexp_replace(regexp_replace(content, '`[^`]*`', '', 'g'), '\\[\\[[^\\]]*\\]\\]', '', 'g'), '\\^([a-z][a-z0-9-]*)', 1), anchor)")
def bad_anchors(spark, sf):
    """Claimed anchors that their entry does not hold."""
    from tarn.functions.text import anchors

    there = notes(spark, sf).select("slug", F.explode(anchors(F.col("content"))).alias("anchor"))
    return derived(spark, sf, CLAIMED).join(there, ["slug", "anchor"], "left_anti")


@query("fact_precision", "WITH s AS (SELECT l.*, d.lang FROM labels l JOIN documents d USING (doc_id) QUALIFY row_number() OVER (ORDER BY md5('11:' || doc_id), doc_id) <= 100) SELECT count(*)::BIGINT AS n, sum(quality)::BIGINT AS correct, round(avg(quality), 6) AS precision FROM s")
def fact_precision(spark, sf):
    """Precision over a hash-ordered sample of a hundred judged rows."""
    s = table(spark, sf, "labels").orderBy(F.md5(F.concat(F.lit("11:"), F.col("doc_id").cast("string"))), "doc_id").limit(100)
    return s.agg(F.count("*").alias("n"), F.sum("quality").alias("correct"), F.round(F.avg("quality"), 6).alias("precision"))


@query("injection_log", "SELECT left(sha256(text), 12) AS prompt, role AS source, count(*)::BIGINT AS n, min(turn)::BIGINT AS first FROM conversations GROUP BY 1, 2")
def injection_log(spark, sf):
    return table(spark, sf, "conversations").groupBy(F.substring(F.sha2("text", 256), 1, 12).alias("prompt"), F.col("role").alias("source")).agg(F.count("*").alias("n"), F.min("turn").alias("first"))


CHECKS = "(VALUES (1, 'contains', 'the'), (2, 'regex', '^[A-Z].*[.]'), (3, 'not_contains', 'zzz')) AS a(i, kind, arg)"


@query("assertions", f"SELECT i::BIGINT AS i, doc_id, CASE kind WHEN 'contains' THEN contains(lower(text), lower(arg)) WHEN 'regex' THEN regexp_matches(text, arg) ELSE NOT contains(lower(text), lower(arg)) END AS passed FROM documents CROSS JOIN {CHECKS}")
def assertions(spark, sf):
    d = table(spark, sf, "documents").join(F.broadcast(fixture(spark, CHECKS)), F.lit(True))
    has = F.contains(F.lower("text"), F.lower("arg"))
    return d.select(F.col("i").cast("long").alias("i"), "doc_id", F.when(F.col("kind") == "contains", has).when(F.col("kind") == "regex", F.regexp_like("text", "arg")).otherwise(~has).alias("passed"))


#: Fixed value: words of a telling line.
SALIENT = "actually|decided|decision|correct|instead|discovered|realized|fix(?:ed)?|pending|todo|next step|blocked|resolved"


@query(
    "salient_lines",
    f"""WITH f AS (SELECT doc_id, text, CASE WHEN contains(lower(text), 'licensed') THEN 1 ELSE 0 END AS hint FROM documents), r AS (SELECT * FROM (SELECT * FROM f ORDER BY doc_id DESC LIMIT 8) ORDER BY hint DESC, doc_id DESC LIMIT 3),
    l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM r),
    m AS (SELECT *, regexp_matches(lower(line), '{SALIENT}') AS hit FROM l WHERE line <> ''), n AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS any_hit FROM m)
    SELECT doc_id, i::BIGINT AS i, left(line, 240) AS line FROM n WHERE hit OR (NOT any_hit AND line NOT LIKE '#%') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 6""",
)
def salient_lines(spark, sf):
    """From the newest eight files the three that mention the topic or are newest; six telling lines of each, else its first."""
    d = table(spark, sf, "documents").select("doc_id", "text").orderBy(F.desc("doc_id")).limit(8)
    d = d.withColumn("hint", F.contains(F.lower("text"), F.lit("licensed")).cast("int")).orderBy(F.desc("hint"), F.desc("doc_id")).limit(3)
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    lines = lines.withColumn("hit", F.lower("line").rlike(SALIENT))
    lines = lines.withColumn("any_hit", F.bool_or("hit").over(W.partitionBy("doc_id"))).where("hit OR (NOT any_hit AND NOT startswith(line, '#'))")
    top = lines.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("i"))).where("n <= 6")
    return top.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), F.substring("line", 1, 240).alias("line"))


RECORDED = "(SELECT 'the api gateway of ' || lower(n_name) || ' uses docker and the port is 8081' AS fp FROM nation) AS r"


@query("promotion_pipeline", f"SELECT t.fp, t.target FROM {TARGET_SQL} t JOIN {QUEUE_SQL} q USING (fp) WHERE q.sessions >= 2 AND regexp_matches(lower(q.fact), '{'|'.join(K.SIGNIFICANT)}') AND NOT regexp_matches(lower(q.fact), '{'|'.join(K.TRANSIENT)}') AND q.confidence >= 0.5 AND fp NOT IN (SELECT fp FROM {RECORDED})")
def promotion_pipeline(spark, sf):
    """Stable, significant, confident facts that name a target and were not recorded."""
    q = queue(spark, sf).where("sessions >= 2 AND coalesce(confidence, 1) >= 0.5").where(K.significant(F.col("fact"))).select("fp")
    return targets(spark, sf).join(q, "fp").join(derived(spark, sf, RECORDED), "fp", "left_anti").select("fp", "target")


@query("proposal_new", f"SELECT DISTINCT regexp_replace(trim(fact), '\\s+', ' ', 'g') AS fact FROM {FACTS_SQL} WHERE lower(regexp_replace(trim(fact), '\\s+', ' ', 'g')) NOT IN (SELECT fp FROM {RECORDED})")
def proposal_new(spark, sf):
    """Facts whose squeezed text the sink does not hold."""
    squeezed = F.regexp_replace(F.trim("fact"), r"\s+", " ")
    f = facts(spark, sf).select(squeezed.alias("fact")).distinct()
    return f.join(derived(spark, sf, RECORDED), F.lower("fact") == F.col("fp"), "left_anti")
