"""Lexical search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import lexical as L
from tarn.plans import versioned
from tarn.queries import query
from tarn.sources.tables import SECTIONS_SQL, TEXT_QUERIES_SQL, sections, table, text_queries

SPLIT = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"
STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
#: distinct tokens of the queries in order of appearance: qid, term, i
TOKENS_SQL = f"(SELECT qid, term, min(i) AS i FROM (SELECT qid, unnest(ts) AS term, generate_subscripts(ts, 1) AS i FROM (SELECT qid, {SPLIT.format('query')} AS ts FROM {TEXT_QUERIES_SQL})) GROUP BY qid, term)"
TERMS_SQL = f"(SELECT qid, term FROM {TOKENS_SQL})"


def bm25_sql(content: str = "text", k: int = 10) -> str:
    return f"""(WITH t AS (SELECT doc_id, unnest({SPLIT.format(content)}) AS term FROM documents),
    p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT doc_id, len({SPLIT.format(content)}) AS dl FROM documents),
    s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    r AS (SELECT q.qid, p.doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM {TERMS_SQL} q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id) CROSS JOIN s GROUP BY q.qid, p.doc_id)
    SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank FROM r QUALIFY rank < {k})"""


#: Standing indexes of the documents and their fields.
INDEXES = {
    "sections": {"slug": F.col, "title": F.col, "heading": F.col, "block_id": lambda _: F.concat_ws("-", "heading", "id"), "content": F.col},
    "skills": {"head": lambda _: F.substring("content", 1, 200), "body": lambda _: F.substring("content", 201, 1 << 30)},
    "opening": {"opening": lambda _: F.substring("content", 1, 500)},
}
#: The index and the field of it that a search by one field looks at.
ALONE = {"text": ("sections", "content"), "head": ("skills", "head"), "body": ("skills", "body"), "opening": ("opening", "opening")}


def index(spark, sf, name: str = "sections") -> L.Index:
    """A standing index of the documents; it is built if there is none for the files as they are."""
    digest = versioned.identity(table(spark, sf, "documents"), "blocks", name)
    fields = {f: column(f) for f, column in INDEXES[name].items()}
    path = versioned.ensure(spark, f"index-{name}", digest, lambda p: L.write_index(sections(spark, sf), p, fields=fields))
    return L.read_index(spark, path)


def bm25(spark, sf, k: int = 10, field: str = "text"):
    name, alone = ALONE[field]
    return L.bm25_topk(L.query_terms(text_queries(spark, sf)), index(spark, sf, name), k, alone=alone)


@query("build_index", f"SELECT count(*)::BIGINT AS docs, sum(dl)::BIGINT AS tokens, (SELECT count(DISTINCT term) FROM (SELECT unnest({SPLIT.format('text')}) AS term FROM documents))::BIGINT AS terms FROM (SELECT len({SPLIT.format('text')}) AS dl FROM documents)")
def build_index(spark, sf):
    """A fresh index: its documents, their tokens, and distinct terms."""
    made = L.build_index(sections(spark, sf))
    whole = made.rows.where("h is null").agg(F.sum(F.size("docs")).cast("long").alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"))
    return whole.crossJoin(made.terms.agg(F.count("*").alias("terms")))


@query("query_tokens", f"SELECT qid, string_agg(term, ' ' ORDER BY i) AS tokens FROM {TOKENS_SQL} GROUP BY qid")
def query_tokens(spark, sf):
    return text_queries(spark, sf).select("qid", F.array_join(X.query_tokens(F.col("query")), " ").alias("tokens"))


@query(
    "query_tokens_stop",
    f"""WITH k AS (SELECT *, NOT list_contains({STOP}, term) OR regexp_matches(term, '\\p{{N}}') AS kept FROM {TOKENS_SQL}),
    n AS (SELECT *, count(*) FILTER (WHERE kept) OVER (PARTITION BY qid) AS kept_n FROM k)
    SELECT qid, string_agg(term, ' ' ORDER BY i) AS tokens FROM (SELECT * FROM n WHERE kept OR kept_n = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY i) <= 32) GROUP BY qid""",
)
def query_tokens_stop(spark, sf):
    return text_queries(spark, sf).select("qid", F.array_join(X.query_tokens_stop(F.col("query")), " ").alias("tokens"))


@query("measured_search", f"SELECT qid, count(*)::BIGINT AS hits, true AS timed FROM {bm25_sql()} WHERE qid IN (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 3) GROUP BY qid")
def measured_search(spark, sf):
    """Three searches one by one, their hits and whether their time was taken."""
    from tarn.operators.measure import measured_search

    standing, asked = index(spark, sf), text_queries(spark, sf)
    digest = versioned.identity(table(spark, sf, "documents").unionByName(table(spark, sf, "benchmark"), allowMissingColumns=True), "bm25", 10)
    rows = measured_search(lambda q: L.bm25_topk(L.query_terms(q), standing, 10, alone="content"), asked, "measured", digest, 3)
    return rows.select("qid", "hits", (F.col("seconds") > 0).alias("timed"))


#: The published examples of the stemmer.
STEMS = (
    "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop "
    "tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit "
    "radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope "
    "callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr goodness:good "
    "revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust "
    "dependent:depend adoption:adopt communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas "
    "controll:control roll:roll café:cafe Über:uber x2s:x2s"
)
_PAIRS = [p.split(":") for p in STEMS.split()]


@query("stem_tokens", "SELECT p_partkey, ({})[p_partkey % {} + 1] AS stem FROM part".format([stem for _, stem in _PAIRS], len(_PAIRS)))
def stem_tokens(spark, sf):
    """A published example for every part."""
    from tarn.functions.stemming import stemmed_tokens

    word = F.element_at(F.array(*(F.lit(w) for w, _ in _PAIRS)), (F.col("p_partkey") % len(_PAIRS) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.element_at(stemmed_tokens(word), 1).alias("stem"))


@query("bm25_stemmed")
def bm25_stemmed(spark, sf):
    """BM25 over stems without accents, from a standing index of its own."""
    from tarn.functions.stemming import stemmed_query, stemmed_tokens

    digest = versioned.identity(table(spark, sf, "documents"), "blocks", "stems")
    path = versioned.ensure(spark, "index-stems", digest, lambda p: L.write_index(sections(spark, sf), p, tokenise=stemmed_tokens))
    return L.bm25_topk(L.query_terms(text_queries(spark, sf), tokenise=stemmed_query), L.read_index(spark, path), 10)


@query("postings", f"SELECT term, doc_id, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({SPLIT.format('text')}) AS term FROM documents) GROUP BY term, doc_id")
def postings(spark, sf):
    return L.postings(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query("term_df", f"SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM (SELECT doc_id, unnest({SPLIT.format('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query("bm25_topk", f"SELECT qid, doc_id, rank, score FROM {bm25_sql()}")
def bm25_topk(spark, sf):
    return bm25(spark, sf)


#: Fixed values of the test: how much a word counts in each field.
WEIGHTS = {"slug": 2.0, "title": 3.0, "heading": 1.0, "content": 0.5}
_FIELDS_SQL = {"slug": "slug", "title": "title", "heading": "heading", "block_id": "heading || '-' || id", "content": "content"}


@query(
    "bm25_fields",
    "WITH t AS ("
    + " UNION ALL ".join(f"SELECT id AS doc_id, unnest({SPLIT.format('(' + c + ')')}) AS term, {w}::DOUBLE AS w FROM {SECTIONS_SQL}" for c, w in zip(_FIELDS_SQL.values(), (2.0, 3.0, 1.0, 0.0, 0.5), strict=True))
    + f"""), p AS (SELECT term, doc_id, sum(w) AS tf FROM t GROUP BY ALL), l AS (SELECT id AS doc_id, (SELECT count(*) FROM t WHERE t.doc_id = s.id) AS dl FROM {SECTIONS_SQL} s),
    s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT item_id AS qid, unnest(list_distinct({SPLIT.format("text || ' note src1 de'")})) AS term FROM benchmark),
    r AS (SELECT q.qid, p.doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id) CROSS JOIN s WHERE tf > 0 GROUP BY q.qid, p.doc_id)
    SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank FROM r QUALIFY rank < 10""",
)
def bm25_fields(spark, sf):
    """All five fields with weights; the block's name has none, but its words count for length and frequency."""
    asked = text_queries(spark, sf).withColumn("query", F.concat("query", F.lit(" note src1 de")))
    return L.bm25_topk(L.query_terms(asked), index(spark, sf), 10, weights=WEIGHTS)


@query("search_cost", f"SELECT qid, true AS fewer, count(*) > 0 AS found FROM (SELECT * FROM {TOKENS_SQL} JOIN (SELECT DISTINCT unnest({SPLIT.format('text')}) AS term FROM documents) USING (term)) GROUP BY qid")
def search_cost(spark, sf):
    """Blocks of postings that each query's terms have and that its search opened: never more than there are."""
    cost = L.search_cost(L.query_terms(text_queries(spark, sf)), index(spark, sf), 10, alone="content")
    return cost.select("qid", (F.col("opened") <= F.col("there")).alias("fewer"), (F.col("opened") > 0).alias("found"))


DECAYED = f"""(SELECT qid, doc_id, lang || '-' || source AS slug, text, score, row_number() OVER (PARTITION BY qid ORDER BY v DESC, rank) - 1 AS pos FROM (
    SELECT *, round(1.0 / (61 + rank) * pow(0.5, row_number() OVER (PARTITION BY qid, lang, source ORDER BY rank) - 1), 12) AS v FROM {bm25_sql(k=30)} JOIN documents USING (doc_id)) QUALIFY pos < 10)"""


@query(
    "search_fts",
    f"""WITH w AS (SELECT *, list_sort(list_filter(list_transform(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: length(w) >= 3), lambda w: instr(lower(text), w) - 1), lambda i: i >= 0)) AS hits FROM {DECAYED} JOIN {TEXT_QUERIES_SQL} USING (qid)),
    s AS (SELECT *, greatest(0, least(hits[len(hits) // 2 + 1] - 166, length(text) - 500)) AS start FROM w)
    SELECT qid, pos, doc_id, slug, round(score, 3) AS score, CASE WHEN length(text) <= 500 THEN text WHEN len(hits) = 0 THEN left(text, 500) WHEN start > 0 THEN '…' || substr(text, start + 1, 500) ELSE substr(text, start + 1, 500) END AS snippet FROM s""",
)
def search_fts(spark, sf):
    return L.search_fts(text_queries(spark, sf), sections(spark, sf), index(spark, sf), 10, 0.5, alone="content")


@query(
    "idf_top_tokens",
    f"""WITH k AS (SELECT *, NOT list_contains({STOP}, term) OR regexp_matches(term, '\\p{{N}}') AS kept FROM {TOKENS_SQL}),
    a AS (SELECT *, count(*) FILTER (WHERE kept) OVER (PARTITION BY qid) AS kept_n FROM k),
    t AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM (SELECT * FROM a WHERE kept OR kept_n = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY i) <= 32)),
    f AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({SPLIT.format('text')}) AS term FROM documents WHERE doc_id % 2 = 0) GROUP BY term),
    j AS (SELECT qid, n, t.term, i, df, count(df) OVER (PARTITION BY qid) AS known,
      row_number() OVER (PARTITION BY qid ORDER BY round(ln(((SELECT count(*) FROM documents WHERE doc_id % 2 = 0) + 1.0) / (df + 1)), 9) DESC NULLS LAST, i) AS r FROM t LEFT JOIN f USING (term))
    SELECT qid, string_agg(term, ' ' ORDER BY i) AS tokens FROM j WHERE n <= 6 OR known = 0 OR (df IS NOT NULL AND r <= 6) GROUP BY qid""",
)
def idf_top_tokens(spark, sf):
    """Against an index of every other document, so that some tokens are unknown."""
    return L.idf_top_tokens(text_queries(spark, sf), L.build_index(sections(spark, sf).where("id % 2 = 0")), 6)


@query("field_bm25", f"SELECT 'head' AS field, qid, doc_id, rank, score FROM {bm25_sql('left(text, 200)', 5)} UNION ALL SELECT 'body' AS field, qid, doc_id, rank, score FROM {bm25_sql('substr(text, 201)', 5)}")
def field_bm25(spark, sf):
    """Two rankings, each by one field alone."""
    named = lambda field: bm25(spark, sf, 5, field).select(F.lit(field).alias("field"), "qid", "doc_id", "rank", "score")
    return named("head").unionAll(named("body"))


@query("route", f"""WITH a AS {bm25_sql('left(text, 200)', 5)}, b AS {bm25_sql('substr(text, 201)', 5)},
    f AS (SELECT qid, doc_id, round(coalesce(1.0 / (61 + a.rank), 0.0) + coalesce(1.0 / (61 + b.rank), 0.0), 12) AS score, a.rank AS ar, b.rank AS br FROM a FULL JOIN b USING (qid, doc_id))
    SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ar NULLS LAST, br) - 1 AS rank, round(score, 4) AS score FROM f QUALIFY rank < 3""")
def route(spark, sf):
    """The description leg and the body leg fused by rank; the best three."""
    from tarn.operators import fusion

    both = fusion.legs(bm25(spark, sf, 5, "head"), bm25(spark, sf, 5, "body"))
    return fusion.rrf(both).where("rank < 3").withColumn("score", F.round("score", 4))


PAGES = "(SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS slug, lower(url) AS hay FROM pages)"


@query("manifest_lookup", f"SELECT w AS word, page_id FROM {PAGES} CROSS JOIN (VALUES ('example fr'), ('m. net')) AS q(w) WHERE list_bool_and(list_transform(string_split(w, ' '), lambda x: contains(hay, x))) QUALIFY row_number() OVER (PARTITION BY w ORDER BY page_id) <= 10")
def manifest_lookup(spark, sf):
    """Entries that hold every word of a query, ten at most."""
    from tarn.operators.fusion import ranked

    p = table(spark, sf, "pages").select("page_id", F.lower("url").alias("hay"))
    asked = F.explode(F.array(F.lit("example fr"), F.lit("m. net")))
    hits = p.withColumn("word", asked).where(F.forall(F.split("word", " "), lambda w: F.contains(F.col("hay"), w)))
    return ranked(hits.withColumnRenamed("word", "qid"), "page_id", k=10).select(F.col("qid").alias("word"), "page_id")


@query("fuzzy_slug", "SELECT DISTINCT lang || '-' || source AS slug FROM documents WHERE contains(lower(lang || '-' || source), 'n-src1') ORDER BY slug LIMIT 5")
def fuzzy_slug(spark, sf):
    return sections(spark, sf).select("slug").distinct().where(F.contains(F.lower("slug"), F.lit("n-src1"))).orderBy("slug").limit(5)


TSTOP = "[" + ", ".join(f"'{w}'" for w in X.TRIGGER_STOPWORDS) + "]"
_KEYS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z]+')), lambda x: length(x) > 3 AND NOT list_contains(" + TSTOP + ", x))"


@query(
    "trigger_accuracy",
    f"""WITH p AS (SELECT conv_id, turn, conv_id % 20 AS item, {_KEYS.format('text')} AS a FROM conversations WHERE role = 'user'), s AS (SELECT item_id AS skill, {_KEYS.format('text')} AS b FROM benchmark),
    w AS (SELECT skill, item = skill AS want, len(list_filter(a, lambda x: len(list_filter(b, lambda y: x = y OR (length(x) >= 5 AND length(y) >= 5 AND left(x, 5) = left(y, 5)))) > 0)) AS n FROM p CROSS JOIN s)
    SELECT skill, sum(n)::BIGINT AS overlap, round(avg(((n >= 1) = want)::INT), 9) AS accuracy FROM w GROUP BY skill""",
)
def trigger_accuracy(spark, sf):
    """How many key words prompts share with each skill's description, and how often sharing one is right."""
    prompts = table(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("prompt"), (F.col("conv_id") % 20).alias("item"), "text")
    skills = table(spark, sf, "benchmark").select(F.col("item_id").alias("skill"), F.col("text").alias("description"))
    return L.trigger_accuracy(prompts, skills)


@query(
    "keyword_overlap_topk",
    f"""WITH q AS (SELECT qid, w, count(*) OVER (PARTITION BY qid) AS n FROM (SELECT qid, unnest(list_distinct({SPLIT.format('query')})) AS w FROM {TEXT_QUERIES_SQL})),
    d AS (SELECT doc_id, unnest(list_distinct({SPLIT.format('text')})) AS w FROM documents),
    o AS (SELECT qid, doc_id, round(count(*) / max(n)::DOUBLE, 9) AS score FROM q JOIN d USING (w) GROUP BY qid, doc_id)
    SELECT qid, doc_id, score FROM o QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= 3""",
)
def keyword_overlap_topk(spark, sf):
    """Shared words as a share of the query's key words; the best three blocks. An equi-join on words, no cross product."""
    from tarn.operators.fusion import ranked

    q = text_queries(spark, sf).select("qid", X.query_tokens(F.col("query")).alias("w"))
    q = q.select("qid", F.size("w").alias("n"), F.explode("w").alias("word"))
    d = table(spark, sf, "documents").select("doc_id", F.explode(X.query_tokens(F.col("text"))).alias("word"))
    shared = q.join(d, "word").groupBy("qid", "doc_id").agg(F.round(F.count("*") / F.first("n"), 9).alias("score"))
    return ranked(shared, F.desc("score"), "doc_id", k=3).select("qid", "doc_id", "score")
