"""Line dedup by the number of distinct sites that a line stands on.

Every line with a word is hashed. A HyperLogLog sketch of sites per line hash is built by partial aggregation and merged,
so that a line's cost does not grow with the rows that hold it. Lines whose estimate is clear of the threshold are
decided by it; lines near the threshold get an exact distinct count. A line on min_sites or more sites is boilerplate:
it is removed everywhere but at its first place (least doc_id, then least line number).

The sketch has an error of 1.04 / sqrt(2^lg_k); "near" is four such errors, and one site, to either side. A line held by
a third of all rows costs one partial sketch per task; rows that hold it are matched by broadcast of the boilerplate
lines where these are few, else by a join whose skewed side adaptive execution splits.

Defined edge cases: a null text has no lines and becomes an empty text. A null site counts as a site of its own. Lines
without a word are never removed. Rows that share a doc_id but not a text are documents of their own; repeated rows
count once for what is first, and all lose the same lines. An empty table gives an empty result. Extra columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_names, let, table, written

MIN_SITES = 10
LG_K = 10


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """(doc, text_hash, site, n, h1, h2) of each line with a word; h1 and h2 are two independent hashes of the line."""
    each = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col(site).cast("string"), F.lit("\0null")).alias("site"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return each.where(F.col("line").rlike("[^ \\t-\\r]")).select("doc", "text_hash", "site", "n", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, first) of the lines on min_sites or more distinct sites; first is struct(doc, text_hash, n)."""
    near = 4 * 1.04 / math.sqrt(2**lg_k) * min_sites + 1
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("doc", "text_hash", "n")).alias("first"), F.count("*").alias("places"))
    spread = written(
        sketched.where(F.col("places") >= min_sites).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites - near), "lines"
    )
    clear = spread.where(F.col("estimate") > min_sites + near).select("h1", "h2", "first")
    unsure = broadcast_if_small(spread.where(F.col("estimate") <= min_sites + near).select("h1", "h2", "first"), 50_000)
    exact = lines.join(unsure.drop("first"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    return clear.unionByName(unsure.join(exact.where(F.col("sites") >= min_sites), ["h1", "h2"]).select("h1", "h2", "first"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with text as it is kept, and the columns named by counts: lines with a word, and lines removed. They take the
    place of columns of docs of that name; all other columns of docs stay, whatever their names."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {x.lower() for x in counts}])
    hashed, hashed2, gone, doc = free_names(docs.withColumns({c: F.lit(0) for c in counts}), "_hash", "_hash2", "_gone", "_doc")
    filled = docs.withColumn("text", F.coalesce("text", F.lit("")))
    lines = _lines(filled, site)
    known = broadcast_if_small(written(boilerplate(lines, min_sites), "boilerplate"), 50_000)
    found = lines.join(known, ["h1", "h2"]).where(~F.struct("doc", "text_hash", "n").eqNullSafe(F.col("first")))
    per_doc = found.groupBy(F.col("doc").alias(doc), F.col("text_hash").alias(hashed2)).agg(F.collect_set("n").alias(gone))
    joined = filled.withColumn(hashed, F.xxhash64("text")).join(per_doc, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(hashed) == F.col(hashed2)), "left")
    has_word = lambda x: x.rlike("[^ \\t-\\r]")

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest))
    counted = joined.withColumns({counts[0]: F.size(F.filter(F.split("text", "\n"), has_word)).cast("long"), counts[1]: F.coalesce(F.size(gone), F.lit(0)).cast("long")})
    return counted.withColumn("text", kept).drop(doc, hashed, hashed2, gone)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH cut AS (SELECT doc_id, coalesce(source, chr(1)) AS site, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
line AS (SELECT doc_id, site, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM cut),
worded AS (SELECT *, regexp_matches(line, '[^ \\t\\n\\x0b\\x0c\\r]') AS has_word FROM line),
known AS (
  SELECT line, min(struct_pack(d := doc_id, n := n)) AS first FROM worded WHERE has_word
  GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (
  SELECT w.*, w.has_word AND k.line IS NOT NULL AND NOT (k.first.d = w.doc_id AND k.first.n = w.n) AS gone
  FROM worded w LEFT JOIN known k ON w.line = k.line)
SELECT doc_id, cast(count(*) FILTER (has_word) AS BIGINT) AS n_lines, cast(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  cast(length(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS BIGINT) AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
