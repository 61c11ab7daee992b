"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each text gets counts (words, symbols, repeated lines and word windows). Fixed base rules reject the plainly bad. Above
them, each stratum (language) gets one cutoff per metric, chosen on labelled documents so that, with confidence
1 - delta over all strata and metrics together, at most a share alpha of the stratum's good documents is rejected. A
cutoff is certified when the exact binomial tail P(X <= k | n, alpha_m) of the k of n good holdout documents that it
rejects is at most delta / (strata * metrics) (Bonferroni); within one metric the candidates are tested from lenient to
strict and testing stops at the first that fails (fixed-sequence testing, which needs no further correction). Among
certified cutoffs the most lenient that still catches nearly all that the strictest catches is taken, so that good
documents are not spent for nothing.

Defined edge cases: a null text has no words (base_failed). A null language is a stratum of its own. A stratum without
enough labelled good documents gets no cutoff, and keeps whatever passes the base rules. Repeated labels of a document
count once, as good only if all agree; labels with a null in quality are ignored. An empty table gives an empty result.
Repeated rows of a document are judged row by row. Extra columns are ignored by the query and kept by
filter_documents, whatever their names.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, row_marks, table, without, written

SYMBOLS = "#*$%&|<>"
#: What a verdict hangs on.
ROW = ("text", "lang")
#: Hashes of the text, by which equal texts are one trial of the holdout.
TEXT = ("_text", "_text2")
WINDOW = 5


@dataclass(frozen=True)
class RiskControl:
    """alpha: largest share of a stratum's good documents that all cutoffs together may reject. delta: probability that
    this fails for any stratum. enough: share of the strictest certified cutoff's catch that a more lenient one must
    reach. grids: for each metric its candidate cutoffs in thousandths, from lenient to strict."""

    alpha: float = 0.012
    delta: float = 0.05
    enough: float = 0.98
    grids: dict[str, tuple[int, ...]] = field(
        default_factory=lambda: {
            "symbol_milli": (500, 400, 300, 250, 200, 150, 100, 75, 50),
            "dup_line_milli": (900, 800, 700, 600, 500, 400, 300),
            "repeat_milli": (190, 170, 150, 130, 110, 90),
        }
    )


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ in order."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 5-word window which the text holds twice or more."""

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(WINDOW)]))

        def covered(h: Column) -> Column:
            ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
            starts = let(ranked, lambda r: F.array_sort(F.transform(F.filter(r, lambda x, i: (x["h"] == F.get(r, i - 1)["h"]) | (x["h"] == F.get(r, i + 1)["h"])), lambda x: x["at"])))
            total = let(starts, lambda s: F.aggregate(F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(total)

        return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(let(hashes, covered))

    return let(words, count).cast("long")


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns of keep and the counts of each row, n_lines (lines with a word) included."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    counted = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("chars"), repeated_words(w).alias("rep")))
    return docs.select(
        "doc_id",
        *keep,
        counted.alias("_w"),
        (F.size(F.split(text, f"[{SYMBOLS}]")) - 1).cast("long").alias("n_symbols"),
        line_counts.alias("_l"),
    ).select(
        "doc_id", *keep, F.col("_w.n").alias("n_words"), F.col("_w.chars").alias("word_chars"), "n_symbols", F.col("_l.dup").alias("n_dup_lines"), F.col("_w.rep").alias("n_repeat_words"), F.col("_l.n").alias("n_lines")
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def metrics(row: DataFrame) -> dict[str, Column]:
    """Each metric in thousandths, rounded down."""
    milli = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {"symbol_milli": milli("n_symbols", "word_chars"), "dup_line_milli": milli("n_dup_lines", "n_lines"), "repeat_milli": milli("n_repeat_words", "n_words")}


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X ~ Binomial(n, p): the terms from k down, until they are negligible. Where k lies below the mean the
    terms fall; all that are left out after 12 deviations come to less than the rounding of a double, so that the array
    has some 12 * sqrt(n * p) entries. Where k lies above the mean by so much, the tail is 1 to the last digit."""
    mean, deviation = n * p, F.sqrt(n * (p * (1 - p)))
    top = F.least(k, F.ceil(mean + 12 * deviation + 64), n)
    terms = F.least(top, F.ceil(12 * deviation + 64 + F.greatest(top - mean, F.lit(0)))).cast("long")
    last = log_gamma(n + 1) - log_gamma(top + 1) - log_gamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((top - i + 1) / (n - top + i)) + (math.log1p(-p) - math.log(p))
        most = F.greatest(s["total"], term)
        return F.struct(term.alias("term"), (most + F.log1p(F.exp(-F.abs(s["total"] - term)))).alias("total"))

    start = F.struct(last.alias("term"), last.alias("total"))
    summed = F.when(terms <= 0, last).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1))), start, step)["total"])
    return F.when(k < 0, F.lit(float("-inf"))).otherwise(F.least(summed, F.lit(0.0)))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series from x + 8 on; right to about 14 digits."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return series - functools.reduce(lambda a, b: a + b, [F.log(x + F.lit(float(i))) for i in range(8)])


def cutoffs(featured: DataFrame, labels: DataFrame, rule: RiskControl) -> DataFrame:
    """lang_key, and for each metric the cutoff, null where none is certified."""
    n_metrics = len(rule.grids)
    verdicts = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    held = featured.where(~F.col("base_failed")).join(verdicts, "doc_id").select("lang_key", *TEXT, "good", *[c.alias(m) for m, c in metrics(featured).items()])
    # one trial for each text, however many rows, documents and labels it has; a bad label makes it bad
    held = held.groupBy("lang_key", *TEXT).agg(F.min("good").alias("good"), *[F.first(m).alias(m) for m in metrics(featured)])
    counts = written(
        held.groupBy("lang_key").agg(
        F.sum((F.col("good") == 1).cast("long")).alias("n"),
        *[F.sum(((F.col(m) > c) & (F.col("good") == g)).cast("long")).alias(f"{m}_{c}_{g}") for m, grid in rule.grids.items() for c in grid for g in (0, 1)],
        ),
        "holdout",
    )
    threshold = math.log(rule.delta / (max(1, counts.count()) * n_metrics))
    tall = counts.select(
        "lang_key",
        "n",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(r).alias("rank"), F.lit(c).cast("long").alias("cutoff"), F.col(f"{m}_{c}_1").alias("k"), F.col(f"{m}_{c}_0").alias("caught")) for m, grid in rule.grids.items() for r, c in enumerate(grid)])).alias("x"),
    ).select("lang_key", "n", "x.*")
    tested = tall.withColumn("passed", (F.col("n") > 0) & (log_binomial_tail(F.col("k"), F.col("n"), rule.alpha / n_metrics) <= threshold))
    along = Window.partitionBy("lang_key", "metric").orderBy("rank")
    certified = tested.withColumn("so_far", F.min(F.col("passed").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))).where("so_far = 1")
    best = certified.withColumn("most", F.max("caught").over(Window.partitionBy("lang_key", "metric"))).where((F.col("caught") > 0) & (F.col("caught") >= rule.enough * F.col("most")))
    return best.groupBy("lang_key").agg(*[F.max(F.when(F.col("metric") == m, F.col("cutoff"))).alias(f"max_{m}") for m in rule.grids])


def judge(docs: DataFrame, labels: DataFrame, rule: RiskControl | None = None, *keep: str) -> DataFrame:
    """A row for each row of docs (doc_id, text, lang): the columns of keep, the counts, base_failed, kept, and the cutoffs
    of its stratum."""
    rule = rule or RiskControl()
    featured = written(features(docs.select("doc_id", "text", F.coalesce("lang", F.lit("\0null")).alias("lang_key"), *[F.xxhash64(F.lit(i), "text").alias(c) for i, c in enumerate(TEXT)], *keep), "lang_key", *TEXT, *keep), "quality")
    limits = broadcast_if_small(cutoffs(featured, labels, rule), 10_000)
    judged = featured.join(limits, "lang_key", "left")
    within = [F.coalesce(c <= F.col(f"max_{m}"), F.lit(True)) for m, c in metrics(featured).items() if m in rule.grids]
    kept = ~F.col("base_failed")
    for x in within:
        kept = kept & x
    return judged.withColumn("kept", kept).drop("lang_key", *TEXT)


def filter_documents(docs: DataFrame, labels: DataFrame, rule: RiskControl | None = None) -> DataFrame:
    """The rows of docs that are kept, with all their columns. A verdict follows from text and language, so rows that share
    a doc_id (or have none) go only if they share these too."""
    marked, marks = row_marks(docs, *ROW)
    gone = judge(marked, labels, rule, *marks).where(~F.col("kept")).select("doc_id", *marks).distinct()
    return without(marked, gone, marks)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "max_symbol_milli", "max_dup_line_milli", "max_repeat_milli")
