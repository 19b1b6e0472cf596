"""A stream over what is there equals the batch join."""

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.operators.logs import bounded_join
from tarn.streaming import hitlog


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=97 * i), i % 3, "read" if i % 4 == 3 else "search", i % 2) for i in range(120)]
    events = spark.createDataFrame(rows, hitlog.EVENTS)
    for n in range(3):
        events.where(F.col("event_id") % 3 == n).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    hitlog.run_available(hitlog.attributed_reads(hitlog.read_events(spark, f"{tmp_path}/in"), 600), out, f"{tmp_path}/check")
    got = {(r.search_id, r.read_id) for r in spark.read.parquet(out).collect()}
    s, r = events.where("kind = 'search'"), events.where("kind = 'read'")
    want = {(x.event_id, x.read_id) for x in bounded_join(s, r, 600).collect()}
    assert got == want and len(want) > 20


def test_fact_state_across_triggers(spark, tmp_path):
    """Three files, a trigger each: sessions gather exactly, the first facts in go once a queue is full."""
    said = "the api gateway of team {} uses docker and port 80"
    files = [
        [("o", "s1", i, said.format(i)) for i in range(4)],
        [("o", "s2", 10, said.format(1)), ("o", "s1", 11, said.format(1)), ("p", "s9", 12, said.format(1))],
        [("o", "s3", 20 + i, said.format(30 + i)) for i in range(4)] + [("o", "s3", 30, said.format(0))],
    ]
    schema = "owner string, session string, ts long, text string"
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        hitlog.run_updates(hitlog.fact_state(stream, most=5), f"{tmp_path}/out", f"{tmp_path}/check")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    seen = {(r.trigger, r.owner, r.fact.split()[5]): (r.sessions, r.first_seen, r.last_seen) for r in rows}
    assert seen[0, "o", "1"] == (1, 1, 1) and seen[1, "o", "1"] == (2, 1, 11) and seen[1, "p", "1"] == (1, 12, 12)
    # four facts are in, four more come: the first three go, and the one said again is queued anew no longer
    assert {k[2] for k in seen if k[0] == 2 and k[1] == "o"} == {"30", "31", "32", "33"}


def test_preceding_searches_keep_a_ring(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, sid long, kind string, slugs array<long>"
    rows = [(i, start + timedelta(seconds=10 * i), 1, "search", [i, 99]) for i in range(6)]
    rows += [(10, start + timedelta(seconds=70), 1, "read", [5]), (11, start + timedelta(seconds=71), 1, "read", [1]), (12, start + timedelta(seconds=72), 1, "read", [99])]
    rows += [(13, start + timedelta(seconds=72), 2, "read", [99]), (14, start + timedelta(seconds=5000), 1, "read", [99])]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in")
    out = hitlog.preceding_searches(spark.readStream.schema(schema).json(f"{tmp_path}/in"), most=3)
    hitlog.run_available(out, f"{tmp_path}/out", f"{tmp_path}/check")
    got = {r.read_id: r.search_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {10: 5, 11: None, 12: 5, 13: None, 14: None}


def _rows_of_state(spark, checkpoint, name):
    """Entries of one state variable as the last trigger left them."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().count()


def test_rings_go_when_their_time_is_over(spark, tmp_path):
    """State of a session falls to nothing once the watermark has passed its bound, late rows are dropped."""
    start = datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, sid long, kind string, slugs array<long>"
    files = [
        [(i, start + timedelta(seconds=i), i % 3, "search", [7]) for i in range(30)],
        [(100, start + timedelta(seconds=400), 0, "read", [7])],
        [(101, start + timedelta(seconds=9000), 5, "read", [7])],
        [(102, start + timedelta(seconds=9001), 5, "read", [7])],
        [(103, start + timedelta(seconds=500), 1, "read", [7]), (104, start + timedelta(seconds=9002), 1, "read", [7])],
    ]
    left = []
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        out = hitlog.preceding_searches(spark.readStream.schema(schema).json(f"{tmp_path}/in"))
        hitlog.run_available(out, f"{tmp_path}/out", f"{tmp_path}/check")
        left.append(_rows_of_state(spark, f"{tmp_path}/check", "ring"))
    assert left[0] == left[1] == 30 and left[3] == left[4] == 0, left
    got = {r.read_id: r.search_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {100: 27, 101: None, 102: None, 104: None}  # 103 came too late


def test_facts_begin_with_a_table(spark, tmp_path):
    said = "the api gateway of team {} uses docker and port 80"
    initial = spark.createDataFrame([("o", said.format(n), said.format(n), ["s0", "s1"], n, n) for n in range(3)], "owner string, fp string, fact string, session_ids array<string>, first_seen long, last_seen long")
    schema = "owner string, session string, ts long, text string"
    spark.createDataFrame([("o", "s1", 10, said.format(1)), ("o", "s2", 11, said.format(1)), ("o", "s2", 12, said.format(7)), ("o", "s2", 13, said.format(8))], schema).coalesce(1).write.json(f"{tmp_path}/in")
    hitlog.run_updates(hitlog.fact_state(spark.readStream.schema(schema).json(f"{tmp_path}/in"), most=3, initial=initial), f"{tmp_path}/out", f"{tmp_path}/check")
    got = {r.fact.split()[5]: (r.sessions, r.first_seen, r.last_seen) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"7": (1, 12, 12), "8": (1, 13, 13)} | ({"1": (3, 1, 11)} if "1" in got else {})
    entries = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "entries").load()
    assert {r.user_map_key.fp.split()[5] for r in entries.collect()} == {"2", "7", "8"}


def test_queues_of_conversations_equal_a_loop(spark, tmp_path):
    """First in, first out over the given conversations in five triggers, and one changed fact writes one entry."""
    from tarn.operators import memory
    from tarn.queries import derived
    from tarn.queries.memory_queries import MESSAGES

    messages = derived(spark, "/root/testdata/sf0.001", MESSAGES).selectExpr("'all' AS owner", "session", "ts", "text").withColumn("n", F.ntile(5).over(Window.orderBy("ts")))
    schema = "owner string, session string, ts long, text string"
    for n in range(1, 6):
        messages.where(F.col("n") == n).drop("n").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        hitlog.run_updates(hitlog.fact_state(spark.readStream.schema(schema).json(f"{tmp_path}/in"), most=20), f"{tmp_path}/out", f"{tmp_path}/check")
    queue: dict[str, list] = {}
    facts = memory.extract_facts(messages, keep=["n"]).collect()
    for n in range(1, 6):
        for r in sorted((r for r in facts if r.n == n), key=lambda r: (r.ts, r.session, r.fact)):
            entry = queue.setdefault(r.fact[:80].lower(), [set(), r.ts, r.ts])
            entry[0].add(r.session)
            entry[2] = max(entry[2], r.ts)
        queue = dict(list(queue.items())[-20:])
    state = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "entries").load()
    got = {r.user_map_key.fp: (r.user_map_value.sessions, r.user_map_value.first, r.user_map_value.last) for r in state.collect()}
    assert got == {fp: (len(s), first, last) for fp, (s, first, last) in queue.items()} and len(got) == 20


def test_digests_move_on_by_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sizes = []
    for n, text in enumerate(["a\nb\n", "c\n", "a\nd\ne\n"]):
        (tmp_path / "in" / f"{n}.txt").write_text(text)
        if n == 1:
            continue  # arrives with the next
        lines = spark.readStream.text(f"{tmp_path}/in").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
        hitlog.digest_increments(lines, f"{tmp_path}/out", f"{tmp_path}/check")
        sizes.append(sorted(r.lines for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert sizes == [[2], [1, 2, 3]]


def test_lines_that_stand_twice_count(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a", "x\nx\n"), ("b", "y\ny\n"), ("c", "y\nx\n"), ("d", "x\ny\n")):
        (tmp_path / "in" / name).write_text(text)
    lines = spark.readStream.text(f"{tmp_path}/in").select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("line"))
    hitlog.digest_increments(lines, f"{tmp_path}/out", f"{tmp_path}/check")
    sums = {r.path: r["sum"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len({sums["a"], sums["b"], sums["c"]}) == 3 and sums["c"] == sums["d"]


def test_log_is_set_aside_when_full(spark, tmp_path):
    from tarn.sources.logs import append_log

    path = f"file://{tmp_path}/log"
    for _ in range(4):
        append_log(spark.range(100).selectExpr("id", "'x' AS q"), path, most=3000)
    assert spark.read.json(path).count() == 200 and spark.read.json(path + ".1").count() == 200


def test_each_content_is_embedded_once(spark, tmp_path):
    embed = lambda text: F.array(F.length(text).cast("double"))
    counts = []
    for n, rows in enumerate([["a", "bb", "a"], ["bb", "ccc", None], ["a"]]):
        spark.createDataFrame([(r,) for r in rows], "text string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        hitlog.embed_increments(spark.readStream.schema("text string").json(f"{tmp_path}/in"), f"{tmp_path}/cache", f"{tmp_path}/check", embed)
        counts.append(spark.read.parquet(f"{tmp_path}/cache").groupBy(F.substring_index("part", "-", -1).cast("int").alias("part")).count().orderBy("part").collect())
    assert [[tuple(r) for r in c] for c in counts] == [[(0, 2)], [(0, 2), (1, 1)], [(0, 2), (1, 1)]]
    # a new checkpoint finds what the cache holds, on its first trigger too
    spark.createDataFrame([("dddd",)], "text string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    hitlog.embed_increments(spark.readStream.schema("text string").json(f"{tmp_path}/in"), f"{tmp_path}/cache", f"{tmp_path}/other", embed)
    whole = spark.read.parquet(f"{tmp_path}/cache")
    assert whole.count() == whole.select("hash").distinct().count() == 4
