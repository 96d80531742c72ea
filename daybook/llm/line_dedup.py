"""Operator 8: removal of boilerplate lines by the number of distinct sites that have them.

A HyperLogLog sketch of sites is kept for each line, under a 128-bit hash, and sketches merge by aggregation. A line whose
estimate is clear of the threshold is decided by it; lines near the threshold get an exact distinct count. A boilerplate
line (at least `min_sites` sites) stays where it stands first, by id and line number, and goes everywhere else: no text
leaves the corpus altogether.

Lines end at a newline and compare without spaces around them; lines without a word never count. Sites that are null count
as no site.

Cases: a null text has no lines and stays null; an empty one stays empty; rows that repeat an id and its text are the same
document; a null id sorts before others; texts of any length are taken whole; extra columns stay as they are; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import written

#: lg of the sketch's registers: a relative error of 1.04 / sqrt(2^12), under 2 %.
LG_K = 12
#: Estimates this close to the threshold, relatively or by one site, are counted exactly.
NEAR = 0.15
HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    at = F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("line_no", "line")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{site}`").cast("string").alias("site"), *_row(doc_id, text), at).where(F.col("line").rlike(HAS_WORD))
    line = F.trim("line")
    return rows.select("doc_id", "site", "row_a", "row_b", "line_no", F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _row(doc_id: str, text: str) -> list:
    own = [F.col(f"`{doc_id}`"), F.col(f"`{text}`")]
    return [F.xxhash64(*own).alias("row_a"), F.xxhash64(F.lit(1), *own).alias("row_b")]


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes (a, b) of lines on at least min_sites sites, where each stands first, and its number of sites (an estimate
    unless `exact`)."""
    sketches = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    spread = written(sketches.select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= F.lit(min_sites - max(1, int(min_sites * NEAR)))), "spread")
    near = F.col("sites") <= min_sites + max(1, int(min_sites * NEAR))
    exact = lines.join(spread.where(near).select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count("site").alias("exact_sites"))
    decided = spread.join(exact, ["a", "b"], "left")
    return decided.select("a", "b", "first", F.coalesce("exact_sites", "sites").alias("sites"), F.col("exact_sites").isNotNull().alias("exact")).where(F.col("sites") >= min_sites)


def remove_boilerplate(docs: DataFrame, min_sites: int = 5, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """docs with boilerplate lines taken out of the text, and the columns lines_before, lines_removed (replaced if there)."""
    lines = _lines(docs, doc_id, text, site)
    found = written(boilerplate(lines, min_sites), "boilerplate")
    here = F.struct("doc_id", "line_no")
    hits = lines.join(found.select("a", "b", "first"), ["a", "b"]).where(~here.eqNullSafe(F.col("first")))
    removed = hits.groupBy("row_a", "row_b").agg(F.collect_set("line_no").alias("removed"))
    # every column of docs travels as one struct, so none of its names can clash with what is added
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_row(doc_id, text))
    joined = keyed.join(removed, ["row_a", "row_b"], "left")
    own = lambda c: F.col("row").getField(c)
    parts = F.split(own(text), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
    clean = F.when(F.col("removed").isNull(), own(text)).otherwise(F.array_join(F.transform(kept, lambda k: F.get(parts, k)), "\n"))
    before = F.when(own(text).isNull(), 0).otherwise(F.size(parts)).alias("lines_before")
    gone = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).alias("lines_removed")
    rest = [c for c in docs.columns if c not in ("lines_before", "lines_removed")]
    return joined.select(*((clean if c == text else own(c)).alias(c) for c in rest), before, gone)
