"""Chunkers: heading sections by line functions, size and anchor splits as Arrow-batched folds."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

TEXTS = T.ArrayType(T.StringType())
MAX_CHARS = 2000
OVERLAP = 150


def heading_sections(notes: DataFrame) -> DataFrame:
    """``slug, part, heading, block_id, content`` of ``notes (slug, content)``: split at level-two headings outside fences.

    Text before the first heading is the overview; a trailing ``^id`` of a heading names its block, else its
    words do; a line that is an anchor renames the block it stands in; empty sections are dropped.
    """
    body = F.trim(F.when(F.col("content").startswith("---"), F.regexp_replace("content", r"(?s)\A---.*?\n---", "")).otherwise(F.col("content")))
    lines = notes.select("slug", F.posexplode(F.split(body, "\n")).alias("i", "line"))
    upto = W.partitionBy("slug").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    fence = F.sum(F.ltrim("line").startswith("```").cast("int")).over(upto) % 2 == 1
    lines = lines.withColumn("is_heading", F.col("line").startswith("## ") & ~fence)
    lines = lines.withColumn("part", F.sum(F.col("is_heading").cast("long")).over(upto))
    anchor_line = F.when(~F.col("is_heading") & F.trim("line").startswith("^") & (F.length(F.trim("line")) > 1), F.regexp_replace(F.trim("line"), r"^\^+", ""))
    grouped = lines.groupBy("slug", "part").agg(
        F.max(F.when(F.col("is_heading"), F.trim(F.regexp_replace("line", "^[# ]+", "")))).alias("raw"),
        F.max_by(anchor_line, F.when(anchor_line.isNotNull(), F.col("i"))).alias("renamed"),
        F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("i", "line")))).alias("body"),
    )
    content = F.regexp_replace(F.array_join(F.col("body.line"), "\n"), r"\A\s+|\s+\z", "")
    own = F.regexp_extract("raw", r"^(.*?)\s+\^(\S+)$", 2)
    heading = F.when(F.col("raw").isNull(), F.lit("Overview")).when(own != "", F.trim(F.regexp_extract("raw", r"^(.*?)\s+\^(\S+)$", 1))).otherwise(F.col("raw"))
    block = F.when(F.col("raw").isNull(), F.lit("overview")).when(own != "", own).otherwise(F.regexp_replace(F.lower("raw"), "[ /]", "-"))
    return grouped.select("slug", "part", heading.alias("heading"), F.coalesce("renamed", block).alias("block_id"), content.alias("content")).where("content <> ''")


#: Separators from the coarsest to the finest; the empty one stands between any two characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def piece_ends(body: str, separator: str) -> np.ndarray:
    """Where the pieces between separators end."""
    if not separator:
        return np.arange(1, len(body) + 1)
    ends = [m.start() for m in re.finditer(re.escape(separator), body)]
    return np.array([*ends, len(body)])


def part_bounds(ends: np.ndarray, gap: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Slices of a body that hold whole pieces: as many as fit ``limit``, each slice beginning ``overlap`` before the last one's end.

    What follows a piece counts ``gap`` characters towards the limit, but for the piece that a slice with an overlap begins with.
    """
    bounds, first, begin, slack = [], 0, 0, 0
    while first < len(ends):
        after = max(first + 1, int(np.searchsorted(ends, begin + limit + slack, "right")))
        end = int(ends[after - 1])
        bounds.append((begin, end))
        if overlap and end > begin:
            begin, slack = max(begin, end - overlap), gap
        else:
            begin, slack = end + gap, 0
        first = after
    return bounds


def split_by_size(body: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Parts of at most ``limit`` characters, cut at the coarsest separator that serves, each opening with the tail of the one before."""
    if len(body) <= limit:
        return [body]
    for separator in SEPARATORS:
        ends = piece_ends(body, separator)
        longest = int(np.diff(ends, prepend=-len(separator)).max()) - len(separator)
        if separator and (len(ends) == 1 or longest > limit):
            continue
        parts = [p for lo, hi in part_bounds(ends, len(separator), limit, overlap) if (p := body[lo:hi].strip())]
        if parts and max(map(len, parts)) <= limit:
            return parts
    return [body[i : i + limit] for i in range(0, len(body), limit)]


#: Fixed value: an anchor that ends a paragraph, code spans and links aside.
ENDING_ANCHOR = r"\^([a-z][a-z0-9-]*)\s*$"


def anchor_groups(notes: DataFrame, key: str = "id") -> DataFrame:
    """``key, pos, text, anchor``: runs of paragraphs of ``notes (key, content)``.

    A paragraph that ends in an anchor is a run of its own under that name; a heading begins a run. Other runs bear the name of
    the heading they stand under: its words, or its anchor with ``-body``; before any heading they have none.
    """
    rows = notes.select(key, F.posexplode(F.split("content", "\n\n", -1)).alias("i", "paragraph"))
    bare = F.regexp_replace(F.regexp_replace("paragraph", "`[^`]*`", ""), r"\[\[[^\]]*\]\]", "")
    heading = F.ltrim(F.col("paragraph")).rlike(r"^\s*#")
    title = F.regexp_replace(F.regexp_replace(F.regexp_replace("paragraph", r"^[\s#]+|\s+$", ""), ENDING_ANCHOR, ""), r"\s+$", "")
    name = F.coalesce(F.nullif(F.regexp_replace(F.lower(title), "[ /]", "-"), F.lit("")), F.lit("section"))
    rows = rows.withColumn("own", F.nullif(F.regexp_extract(bare, ENDING_ANCHOR, 1), F.lit("")))
    rows = rows.withColumn("scope", F.when(heading, F.coalesce(F.concat("own", F.lit("-body")), name)))
    order = W.partitionBy(key).orderBy("i")
    begins = heading | F.col("own").isNotNull() | F.lag("own").over(order).isNotNull()
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("pos", F.sum((begins | (F.col("i") == 0)).cast("long")).over(upto) - 1).withColumn("scope", F.last("scope", True).over(upto))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", "paragraph"))), lambda x: x["paragraph"])
    runs = rows.groupBy(key, "pos").agg(F.array_join(lines, "\n\n").alias("text"), F.coalesce(F.max("own"), F.max("scope")).alias("anchor"))
    return runs.select(key, "pos", "text", "anchor")


def pack_parts(text: str, limit: int = 12000) -> list[str]:
    """Consecutive pieces packed while they fit: cut at level-two headings, then level three, blank lines and characters."""
    pieces = [text]
    for at in (r"(?m)^(?=## )", r"(?m)^(?=### )", r"(?<=\n\n)"):
        pieces = [q for p in pieces for q in ([p] if len(p) <= limit else filter(None, re.split(at, p)))]
    pieces = [p[i : i + limit] for p in pieces for i in range(0, len(p), limit)]
    packed: list[str] = []
    for p in pieces:
        if packed and len(packed[-1]) + len(p) <= limit:
            packed[-1] += p
        else:
            packed.append(p)
    return packed


@pandas_udf(TEXTS)
def split_text(body: pd.Series) -> pd.Series:
    return body.map(lambda b: split_by_size(b or ""))


@pandas_udf(TEXTS)
def packed(body: pd.Series) -> pd.Series:
    return body.map(lambda b: pack_parts(b or ""))


def unique_ids(rows: DataFrame, file: str, base: str, order: Column) -> DataFrame:
    """Add ``block_id``: repeats of a base id in a file get ``-2``, ``-3`` in order."""
    n = F.row_number().over(W.partitionBy(file, base).orderBy(order))
    return rows.withColumn("block_id", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))
