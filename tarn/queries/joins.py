"""Joins over logs, episodes and ledgers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.operators import logs as O
from tarn.queries import derived, query
from tarn.sources.tables import table

LOG_SQL = "(SELECT event_id, user_id AS sid, ts, event_type, (props::JSON->>'k')::BIGINT AS k FROM events)"
PAIRS = f"""(SELECT r.event_id AS read_id, s.event_id AS search_id, r.ts AS rts, s.ts AS sts FROM {LOG_SQL} r JOIN {LOG_SQL} s
    ON r.sid = s.sid AND r.event_type = 'click' AND s.event_type = 'view' AND r.k % 5 = s.k % 5 AND s.ts <= r.ts AND r.ts <= s.ts + INTERVAL 36000 SECOND)"""


def hits(spark, sf):
    """Searches and reads among the events: a view is a search that shows one slug in five, a click reads one."""
    e = table(spark, sf, "events").where("event_type IN ('view', 'click')")
    return e.select("event_id", F.col("user_id").alias("sid"), "ts", "event_type", (F.get_json_object("props", "$.k").cast("long") % 5).alias("slug"))


@query("read_rate", f"SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, count(*)::BIGINT AS searches, count(*) FILTER (WHERE event_id IN (SELECT search_id FROM {PAIRS}))::BIGINT AS \"read\" FROM events WHERE event_type = 'view' GROUP BY 1")
def read_rate(spark, sf):
    """Searches followed by a read of what they showed, within the bound, both ends included."""
    h = hits(spark, sf)
    searches, reads = h.where("event_type = 'view'"), h.where("event_type = 'click'")
    followed = O.bounded_join(searches, reads, 36000).select("event_id").distinct().withColumn("read", F.lit(1))
    rated = searches.join(followed, "event_id", "left")
    return rated.groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.count("*").alias("searches"), F.sum(F.coalesce("read", F.lit(0))).cast("long").alias("read"))


@query("preceding_query", f"SELECT read_id, search_id FROM {PAIRS} QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY sts DESC, search_id DESC) = 1")
def preceding_query(spark, sf):
    """Backward as-of join: the latest search before a read that showed its slug."""
    h = hits(spark, sf)
    pairs = O.bounded_join(h.where("event_type = 'view'"), h.where("event_type = 'click'"), 36000)
    last = pairs.groupBy("read_id").agg(F.max(F.struct("ts", "event_id")).alias("s"))
    return last.select("read_id", F.col("s.event_id").alias("search_id"))


VIEWS = f"(SELECT event_id, sid, ts, k % 5 AS slug FROM {LOG_SQL} WHERE event_type = 'view')"
CLICKS = f"(SELECT event_id, sid, ts, k % 5 AS slug FROM {LOG_SQL} WHERE event_type = 'click')"
#: One view for each time, so that an as-of join has one answer.
VIEWS_ONCE = f"(SELECT sid, slug, ts, max(event_id) AS event_id FROM {VIEWS} GROUP BY ALL)"


@query("asof_view", f"SELECT r.event_id AS read_id, s.event_id AS search_id FROM {CLICKS} r ASOF LEFT JOIN {VIEWS_ONCE} s ON r.sid = s.sid AND r.slug = s.slug AND r.ts >= s.ts")
def asof_view(spark, sf):
    """Every read with the latest search before it that showed its slug, however long ago."""
    h = hits(spark, sf)
    return O.asof(h.where("event_type = 'click'"), h.where("event_type = 'view'"), ["sid", "slug"]).select(F.col("event_id").alias("read_id"), "search_id")


@query("asof_kind", f"SELECT r.event_id AS read_id, s.event_id AS search_id FROM {CLICKS} r ASOF LEFT JOIN (SELECT slug, ts, max(event_id) AS event_id FROM {VIEWS} GROUP BY ALL) s ON r.slug = s.slug AND r.ts >= s.ts")
def asof_kind(spark, sf):
    """The same by five keys alone, each of which goes over many ranges."""
    h = hits(spark, sf)
    return O.asof(h.where("event_type = 'click'"), h.where("event_type = 'view'"), ["slug"]).select(F.col("event_id").alias("read_id"), "search_id")


@query(
    "preceding_in_ring",
    f"""WITH n AS (SELECT event_id, sid, ts, slug, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) AS n FROM {VIEWS}),
    s AS (SELECT r.event_id AS read_id, r.ts AS rts, n.*, (SELECT count(*) FROM n x WHERE x.sid = r.sid AND x.ts <= r.ts) AS so_far FROM {CLICKS} r LEFT JOIN n ON n.sid = r.sid AND n.slug = r.slug AND n.ts <= r.ts
      QUALIFY row_number() OVER (PARTITION BY r.event_id ORDER BY n.ts DESC NULLS LAST, n.event_id DESC) = 1)
    SELECT read_id, CASE WHEN so_far - n < 3 AND rts - ts <= INTERVAL 360000 SECOND THEN event_id END AS search_id FROM s""",
)
def preceding_in_ring(spark, sf):
    """Read attribution by a ring of three searches a session and a bound in time, as a batch."""
    h = hits(spark, sf)
    return O.preceding_in_ring(h.where("event_type = 'view'"), h.where("event_type = 'click'"), most=3, seconds=360_000)


@query("join_meta", "SELECT d.doc_id, l.quality, d.lang FROM documents d JOIN labels l USING (doc_id)")
def join_meta(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "quality", "lang")


@query("left_freshness", "SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_freshness(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"))


@query("dedupe_episodes", "SELECT doc_id, count(*) OVER (PARTITION BY source, sha1(text))::BIGINT AS copies FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha1(text) ORDER BY doc_id DESC) = 1")
def dedupe_episodes(spark, sf):
    """The newest of each (name, content) group is kept."""
    d = table(spark, sf, "documents")
    return d.groupBy("source", F.sha1("text")).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("run_ranges", """WITH m AS (SELECT conv_id, turn, role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop, max(turn) OVER (PARTITION BY conv_id) AS last,
      lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, turn AS start, coalesce(stop - 1, last)::BIGINT AS finish FROM m WHERE role = 'assistant' AND coalesce(before, 'user') <> 'assistant'""")
def run_ranges(spark, sf):
    """Runs of assistant turns up to the next user turn; a start inside a run is skipped."""
    w = W.partitionBy("conv_id").orderBy("turn")
    m = table(spark, sf, "conversations").select("conv_id", "turn", "role").withColumns({
        "stop": F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w.rowsBetween(1, W.unboundedFollowing)),
        "last": F.max("turn").over(W.partitionBy("conv_id")), "before": F.lag("role").over(w),
    })
    return m.where("role = 'assistant' AND coalesce(before, 'user') <> 'assistant'").select("conv_id", F.col("turn").alias("start"), F.coalesce(F.col("stop") - 1, "last").alias("finish"))


OLD = "(SELECT doc_id AS key, sha1(text) AS sha FROM documents WHERE doc_id % 7 <> 0)"
NEW = "(SELECT doc_id AS key, sha1(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS sha FROM documents WHERE doc_id % 11 <> 0)"


def ledgers(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    old = d.where("key % 7 <> 0").select("key", F.sha1("text").alias("sha"))
    new = d.where("key % 11 <> 0").select("key", F.sha1(F.when(F.col("key") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("sha"))
    return old, new


@query("hash_diff", f"SELECT key, CASE WHEN n.sha IS NULL THEN 'missing' WHEN o.sha IS NULL THEN 'extra' ELSE 'changed' END AS state FROM {OLD} o FULL JOIN {NEW} n USING (key) WHERE o.sha IS DISTINCT FROM n.sha")
def hash_diff(spark, sf):
    return O.hash_diff(*ledgers(spark, sf))


@query("feed_plan", f"SELECT n.key, CASE WHEN o.sha IS NULL THEN 'bootstrap' WHEN o.sha = n.sha THEN 'skip' ELSE 'incremental' END AS action FROM {NEW} n LEFT JOIN {OLD} o USING (key)")
def feed_plan(spark, sf):
    old, new = ledgers(spark, sf)
    joined = new.join(old.withColumnRenamed("sha", "was"), "key", "left")
    return joined.select("key", F.when(F.col("was").isNull(), "bootstrap").when(F.col("was") == F.col("sha"), "skip").otherwise("incremental").alias("action"))


@query("sync_plan", f"SELECT n.key FROM {NEW} n LEFT JOIN {OLD} o USING (key) WHERE o.sha IS DISTINCT FROM n.sha")
def sync_plan(spark, sf):
    old, new = ledgers(spark, sf)
    return new.join(old, ["key", "sha"], "left_anti").select("key")


@query("sync_pending", f"SELECT o.key FROM {OLD} o ANTI JOIN {NEW} n ON o.key = n.key AND o.sha = n.sha")
def sync_pending(spark, sf):
    """Acknowledged but not landed in the same version."""
    old, new = ledgers(spark, sf)
    return old.join(new, ["key", "sha"], "left_anti").select("key")


META_A = "(SELECT 'c' || s_nationkey AS key, '' || count(*) AS value FROM supplier GROUP BY s_nationkey) AS a"
META_B = "(SELECT 'c' || (c_nationkey + 3) AS key, '' || (count(*) % 3) AS value FROM customer GROUP BY c_nationkey) AS b"


@query("meta_mismatch", f"SELECT key, a.value AS stored, b.value AS wanted FROM {META_A} JOIN {META_B} USING (key) WHERE a.value <> b.value")
def meta_mismatch(spark, sf):
    """Only keys that the stored side has are compared."""
    a, b = derived(spark, sf, META_A), derived(spark, sf, META_B)
    return a.select("key", F.col("value").alias("stored")).join(b.select("key", F.col("value").alias("wanted")), "key").where("stored <> wanted")


@query("config_drift", f"SELECT key, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'dropped' ELSE 'changed' END AS drift FROM {META_A} FULL JOIN {META_B} USING (key) WHERE a.value IS DISTINCT FROM b.value")
def config_drift(spark, sf):
    a, b = derived(spark, sf, META_A).withColumnRenamed("value", "x"), derived(spark, sf, META_B).withColumnRenamed("value", "y")
    j = a.join(b, "key", "full_outer").where("NOT (x <=> y)")
    return j.select("key", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "dropped").otherwise("changed").alias("drift"))


@query(
    "seal_counts",
    """WITH c AS (SELECT doc_id // 1000 AS chunk, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS sha FROM documents GROUP BY 1)
    SELECT (SELECT count(*) FROM documents)::BIGINT AS docs, (SELECT count(DISTINCT source) FROM documents)::BIGINT AS queries, sha256(string_agg(sha, ',' ORDER BY chunk)) AS ids_sha FROM c""",
)
def seal_counts(spark, sf):
    """Counts, and a digest over the digests of the sorted ids of every thousand, that seal a set."""
    d = table(spark, sf, "documents")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), ",")
    chunks = d.groupBy(F.floor(F.col("doc_id") / 1000).alias("chunk")).agg(F.sha2(ids, 256).alias("sha"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sha"))), lambda c: c["sha"]), ",")
    return d.agg(F.count("*").alias("docs"), F.countDistinct("source").alias("queries")).crossJoin(chunks.agg(F.sha2(whole, 256).alias("ids_sha")))


@query("merge_shards", "SELECT source AS scope, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY source")
def merge_shards(spark, sf):
    """Three contiguous shards of whole scopes pooled; the merge checks that they share a configuration and no row."""
    d = O.contiguous_shards(table(spark, sf, "documents").select("doc_id", "source"), "source", 3, "doc_id")
    shards = [(d.where(F.col("shard") == i), {"model": "m", "k": 10}) for i in range(3)]
    return O.merge_shards(shards, ["doc_id"]).groupBy(F.col("source").alias("scope")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("contiguous_shards", """WITH s AS (SELECT url[1:24] AS scope, min(page_id) AS first FROM pages GROUP BY 1), t AS (SELECT scope, ntile(7) OVER (ORDER BY first, scope) - 1 AS shard FROM s)
    SELECT page_id, shard::INTEGER AS shard FROM pages JOIN t ON t.scope = url[1:24]""")
def contiguous_shards(spark, sf):
    """Pages in seven shards of whole scopes (what their addresses begin with), in the order of the pages."""
    p = table(spark, sf, "pages").select("page_id", F.substring("url", 1, 24).alias("scope"))
    return O.contiguous_shards(p, "scope", 7, "page_id").select("page_id", "shard")


@query("rebuild_decision", "SELECT source, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def rebuild_decision(spark, sf):
    """A standing summary of the documents: found as long as their files are what they were, else made anew and published whole."""
    from tarn.plans import versioned

    d = table(spark, sf, "documents")
    made = lambda path: d.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars")).write.parquet(path)
    return spark.read.parquet(versioned.ensure(spark, "summary", versioned.identity(d, "by source"), made))


@query("shard_coverage", "WITH g AS (SELECT source AS scope, count(DISTINCT doc_id % 3)::BIGINT AS shards, count(*)::BIGINT AS n FROM documents WHERE NOT (source = 'src7' AND doc_id % 3 <> 0) GROUP BY source) SELECT scope, shards, n, CASE WHEN shards < 3 THEN 'missing' ELSE 'duplicate' END AS state FROM g WHERE shards <> 1")
def shard_coverage(spark, sf):
    """Scopes that more than one shard claims."""
    d = table(spark, sf, "documents").where("NOT (source = 'src7' AND doc_id % 3 <> 0)")
    g = d.groupBy(F.col("source").alias("scope")).agg(F.countDistinct(F.col("doc_id") % 3).alias("shards"), F.count("*").alias("n"))
    return g.where("shards <> 1").withColumn("state", F.when(F.col("shards") < 3, "missing").otherwise("duplicate"))


@query("resume_blocks", "SELECT source, lang, count(*)::BIGINT AS n FROM documents GROUP BY source, lang")
def resume_blocks(spark, sf):
    """A block a language, each with a receipt: those that were finished are read, the rest are run."""
    from tarn.plans import versioned

    d = table(spark, sf, "documents")
    digest = versioned.identity(d, "counts")
    langs = sorted(r["lang"] for r in d.select("lang").distinct().collect() if r["lang"] is not None)
    count = lambda lang: d.where(F.col("lang") == lang).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return versioned.run_blocks(spark, "counts", {lang: f"{lang}-{digest}" for lang in langs}, count)
