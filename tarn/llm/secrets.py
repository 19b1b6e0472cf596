"""Secret scans with DataFrame functions alone: regular-expression spans and multipart credential linking.

Plain findings come from three patterns. Weak candidates say little by themselves: login names, endpoints (URLs of
any scheme, bare hosts), secrets too short or too plain, and the plain patterns' near misses (assignments of short
values, access identifiers and hexadecimal runs that are too short). They are reported only where a complementary part
stands within ``scope`` code points of them in the same text. Parts become rows, each dealt to every scope-wide bin
that its reach touches, and an interval semi-join over (row, bin) keeps those with a partner, so a text with very many
parts spreads over its bins. Work on a text is in proportion to its spans: they are placed in blocks of ``CHUNK``.

Positions are code points, ends exclusive. Defined results: a null text counts as empty and has no
spans; repeated rows are scanned each on its own, nulls in other columns pass through; columns that are
not named are not read, those that are may bear any name; very long texts are scanned whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.arrow import named
from tarn.plans.scratch import cut

#: The plain patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
BASE_KINDS = ("assign", "access", "hex")

#: Weak candidates, one alternative a role: where a service is, who logs in, a secret too short or too plain to stand alone.
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+|(?:[A-Za-z0-9-]{1,63}\.){1,8}(?:com|net|org|io|dev|cloud|internal|local|example)(?::[0-9]{1,5})?"""
LOGIN = r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]+"""
PASS = r"""(?i:pwd|passphrase|credential|private_?key|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
WEAK = f"{LOGIN}|{PASS}|{ENDPOINT}"
LINKED_KINDS = ("endpoint", "login", "pass", "short_assign", "short_access", "short_hex")
KINDS = (*BASE_KINDS, *LINKED_KINDS)
#: The part that each kind plays: 0 endpoint, 1 identifier, 2 secret.
ROLES = (2, 1, 2, 0, 1, 2, 2, 1, 2)

SPAN = "array<struct<start:bigint,end:bigint,kind:int>>"
#: Spans that are placed or replaced one after another; blocks of them are put together afterwards.
CHUNK = 128


def _matches(text: Column, pattern: str) -> Column:
    """Every match with its place: gaps between matches come from splitting by the same pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.when(
        F.size(found) > 0,
        F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).cast("long").alias("gap"))),
    ).otherwise(F.array().cast("array<struct<m:string,gap:bigint>>"))


def _chunks(items: Column) -> Column:
    """An array's elements in arrays of ``CHUNK``; it must not be empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))


def _placed(matches: Column, kind) -> Column:
    """Spans of ``matches`` whose ``kind`` is not null."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), kind(x["m"]).cast("int").alias("kind"))
        return F.struct(end.alias("at"), F.when(span["kind"].isNotNull(), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def within(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(SPAN).alias("spans")), step, lambda acc: acc["spans"])

    zero = F.lit(0).cast("long")
    widths = F.transform(_chunks(matches), lambda c: F.aggregate(c, zero, lambda n, x: n + x["gap"] + F.length(x["m"])))
    starts = F.aggregate(widths, F.array(zero), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    many = F.flatten(F.zip_with(_chunks(matches), F.slice(starts, 1, F.size(starts) - 1), within))
    return F.when(F.size(matches) > CHUNK, many).otherwise(within(matches, zero))


def _fresh(taken: list[str]) -> str:
    """A column name that is not in use."""
    name = "none"
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def scan_parts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``base`` and ``weak`` span arrays, each row under a number of its own (``row_no``).

    The result is a scratch table: the texts are scanned once, and the numbers stay as they are.
    """
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    kept = [*(named(c) for c in keep or []), F.lit(0).alias(_fresh(keep or []))]
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak": WEAK}
    found = docs.select(F.struct(*kept).alias("kept"), *(_matches(text, p).alias(name) for name, p in patterns.items()))
    whole = lambda length, least, base, short: F.when(length >= least, base).otherwise(short)
    plain = F.concat(
        _placed(F.col("assign"), lambda m: whole(F.length(F.regexp_extract(m, ASSIGN, 2)), ASSIGN_LEAST, 0, 6)),
        _placed(F.col("access"), lambda m: whole(F.length(m), ACCESS_LEAST, 1, 7)),
        _placed(F.col("hex"), lambda m: whole(F.length(m), HEX_LEAST, 2, 8)),
    )
    is_a = lambda m, p: m.rlike(rf"\A(?:{p})\z")
    weak = _placed(F.col("weak"), lambda m: F.when(is_a(m, LOGIN), 4).when(is_a(m, PASS), 5).otherwise(3))
    placed = found.select(F.monotonically_increasing_id().alias("row_no"), "kept", plain.alias("plain"), weak.alias("weak"))
    base = F.filter("plain", lambda s: s["kind"] < 3)
    return cut(placed.select("row_no", "kept", base.alias("base"), F.concat(F.filter("plain", lambda s: s["kind"] > 3), "weak").alias("weak")), "parts")


def link_parts(parts: DataFrame, scope: int = 400) -> DataFrame:
    """``(row_no, linked)``: each row's weak spans that have a complementary part within ``scope`` code points.

    An identifier asks for a secret, a secret for an identifier or an endpoint, an endpoint for a secret; a part does
    not complement what it overlaps. Plain findings take part, and weak spans that overlap one are dropped.
    """
    span = ["row_no", "start", "end", "kind"]
    some = parts.where(F.size("weak") > 0)
    rows = some.select("row_no", F.explode(F.concat("base", "weak")).alias("s")).select("row_no", "s.start", "s.end", "s.kind")
    rows = cut(rows.withColumn("role", F.element_at(F.array(*map(F.lit, ROLES)), F.col("kind") + 1)), "spans")
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / scope), F.floor(hi / scope)))
    there = rows.withColumn("bin", bins(F.col("start"), F.col("end"))).alias("b")
    same = (F.col("a.row_no") == F.col("b.row_no")) & (F.col("a.bin") == F.col("b.bin"))
    overlaps = (F.col("b.start") < F.col("a.end")) & (F.col("a.start") < F.col("b.end"))
    weak = rows.where("kind >= 3")
    inside = weak.withColumn("bin", bins(F.col("start"), F.col("end"))).alias("a")
    dropped = inside.join(there.where("kind < 3").alias("b"), same & overlaps, "left_semi").select(*span).distinct()
    left = rows.join(dropped, span, "left_anti")
    asking = left.where("kind >= 3").withColumn("bin", bins(F.col("start") - scope, F.col("end") + scope)).alias("a")
    there = left.withColumn("bin", bins(F.col("start"), F.col("end"))).alias("b")
    near = (F.col("b.start") <= F.col("a.end") + scope) & (F.col("a.start") <= F.col("b.end") + scope) & ~overlaps
    complements = (F.col("a.role") != F.col("b.role")) & ((F.col("a.role") == 2) | (F.col("b.role") == 2))
    kept = asking.join(there, same & near & complements, "left_semi").select(*span).distinct()
    return kept.groupBy("row_no").agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, scope: int = 400) -> DataFrame:
    """``keep`` columns with ``base`` and ``linked``: arrays of (start, end, kind), by start, then kind.

    ``kind`` indexes ``KINDS``. Rows without weak candidates skip the join. A kept column may not be called ``base``
    or ``linked``; ``scan_kept`` holds kept columns apart.
    """
    found = scan_kept(docs, text_col, keep, scope)
    return found.select(*(F.col("kept")[c].alias(c) for c in keep or []), "base", "linked")


def scan_kept(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, scope: int = 400) -> DataFrame:
    """``kept, base, linked``, the ``keep`` columns as fields of ``kept``."""
    parts = scan_parts(docs, text_col, keep)
    with_weak = parts.where(F.size("weak") > 0).join(link_parts(parts, scope), "row_no", "left")
    none = F.array().cast(SPAN)
    ordered = lambda c: F.array_sort(c, lambda x, y: in_order(x, y))
    out = parts.where(F.size("weak") == 0).select("kept", "base", none.alias("linked")).unionByName(
        with_weak.select("kept", "base", F.coalesce("linked", none).alias("linked"))
    )
    return out.select("kept", ordered("base").alias("base"), ordered("linked").alias("linked"))


def in_order(x: Column, y: Column) -> Column:
    less = (x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["kind"] < y["kind"]))
    same = (x["start"] == y["start"]) & (x["kind"] == y["kind"]) & (x["end"] == y["end"])
    return F.when(same, 0).when(less, -1).otherwise(1)


def shown(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each span, and whatever spans overlap or touch it, replaced by one mark. Spans must be sorted by start."""
    # both are elements of an array: what is named in several places below is computed once a row
    row = F.array(F.struct(text.alias("text"), spans.alias("spans")))
    return F.when(F.size(spans) > 0, F.element_at(F.transform(row, lambda r: _redacted(r["text"], r["spans"], mark)), 1)).otherwise(text)


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    zero = F.lit(0).cast("long")
    last = lambda chunk: F.array_max(F.transform(chunk, lambda s: s["end"]))
    reach = F.aggregate(F.transform(_chunks(spans), last), F.array(zero), lambda acc, n: F.array_append(acc, F.greatest(F.element_at(acc, -1), n)))

    def part(chunk: Column, at: Column) -> Column:
        """A chunk with the text from the end of the last span before it to the end of its own last span."""
        return F.struct(chunk.alias("spans"), at.alias("at"), F.substring(text, at + 1, F.greatest(at, last(chunk)) - at).alias("text"))

    def replaced(p: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(p["text"], acc["at"] - p["at"] + 1, s["start"] - acc["at"])
            fresh = (s["start"] > acc["at"]) | (acc["at"] == 0)
            out = F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

        begin = F.struct(p["at"].alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(p["spans"], begin, step, lambda acc: F.array_join(acc["out"], ""))

    def whole(ends: Column) -> Column:
        parts = F.zip_with(_chunks(spans), F.slice(ends, 1, F.size(ends) - 1), part)
        return F.concat(F.array_join(F.transform(parts, replaced), ""), F.substring(text, F.element_at(ends, -1) + 1, F.lit(2147483647)))

    return F.element_at(F.transform(F.array(reach), whole), 1)
