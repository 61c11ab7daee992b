"""Profile of a corpus: features, content classes, histograms, archetypes and totals (the scan).

Everything is a group-by with partial aggregation over one row per file; only the byte features and the lines need
content, so that structure-only profiles never read it (column pruning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..functions.bytes import featured, trigram_sets
from .graph import cut


def rank_percentile(ordered: str, q_num: int, q_den: int, *keys: str) -> Column:
    """Value of column ordered at index min(n - 1, floor(q * n)) of its ascending order within keys; a window
    expression, so that no group is collected."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ordered))
    n = F.count("*").over(Window.partitionBy(*keys))
    return F.when(rank - 1 == F.least(n - 1, F.floor(n * q_num / q_den)), F.col(ordered))


def size_percentiles(files: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n, p50, p90, max) of size, rounded to three digits. Sizes are counted first: the window sees one row per
    distinct size of a key, not one per file, however large a cluster is."""
    counted = files.groupBy(*keys, "size").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(*keys))
    placed = counted.select(*keys, "size", "c", upto.alias("upto"), total.alias("n"))
    at = lambda num, den: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * num / den)), F.col("size")))
    found = placed.groupBy(*keys).agg(F.max("n").alias("n"), at(1, 2).alias("p50"), at(9, 10).alias("p90"), F.max("size").alias("max"))
    return found.select(*keys, "n", *[S.round3(F.col(c)).alias(c) for c in ("p50", "p90", "max")])


def fold_name_like_extensions(files: DataFrame, least_dirs: int = 3) -> DataFrame:
    """files (path, ext) with extensions that are not known ones and stand in few directories made (other)."""
    folder = F.lower(F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    rare = files.where(F.col("ext").startswith(".") & ~F.col("ext").isin(list(S.KNOWN_EXTENSIONS))).select("ext", folder.alias("dir")).distinct().groupBy("ext").agg(F.count("*").alias("dirs")).where(F.col("dirs") < least_dirs).select("ext", F.lit(True).alias("rare"))
    return files.join(rare, "ext", "left").withColumn("ext", F.when(F.col("rare"), "(other)").otherwise(F.col("ext"))).drop("rare")


def size_histogram(files: DataFrame) -> DataFrame:
    counted = files.groupBy(S.size_band(F.col("size")).alias("band")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return counted.select(S.band_label(F.col("band")).alias("bucket"), "files", "bytes")


def extension_histogram(files: DataFrame, least: int) -> DataFrame:
    """(ext, files, bytes); extensions with fewer than least files go into (other)."""
    by_ext = files.groupBy("ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    folded = by_ext.withColumn("ext", F.when(F.col("files") < least, "(other)").otherwise(F.col("ext")))
    return folded.groupBy("ext").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def directories(files: DataFrame) -> DataFrame:
    """(dir, depth, child_dirs, child_files) of all directories above files (path); the root is the empty string."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = files.select(F.explode(ups).alias("dir")).distinct()
    parent = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    inner = dirs.where("dir <> ''").groupBy(parent(F.col("dir")).alias("dir")).agg(F.count("*").alias("child_dirs"))
    held = files.groupBy(parent(F.col("path")).alias("dir")).agg(F.count("*").alias("child_files"))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    return dirs.join(inner, "dir", "left").join(held, "dir", "left").select("dir", depth.cast("long").alias("depth"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("child_dirs", "child_files")])


def directory_histograms(dirs: DataFrame) -> DataFrame:
    """(kind, bucket, n) for depth, fan-out and files per directory."""
    kinds = F.array(F.struct(F.lit("depth").alias("kind"), F.col("depth").cast("string").alias("bucket")), *[F.struct(F.lit(k).alias("kind"), S.count_bucket(F.col(c)).alias("bucket")) for k, c in (("fanout", "child_dirs"), ("files", "child_files"))])
    return dirs.select(F.explode(kinds).alias("x")).groupBy("x.kind", "x.bucket").agg(F.count("*").alias("n"))


def header_counts(files: DataFrame) -> DataFrame:
    """One row: headers of 20 MB and more, of 1 to 20 MB, and smaller."""
    header = F.col("ext").isin([x for x in S.SOURCE_EXTENSIONS if x.startswith((".h", ".i"))])
    part = lambda c: F.count_if(header & c)
    return files.agg(part(F.col("size") >= 20 << 20).alias("giant"), part((F.col("size") >= 1 << 20) & (F.col("size") < 20 << 20)).alias("big"), part(F.col("size") < 1 << 20).alias("ordinary"))


def samples(files: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k files of each cluster in path order (0: all)."""
    if k == 0:
        return files
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("path"))).where(F.col("_r") <= k).drop("_r")


def file_stats(files: DataFrame) -> DataFrame:
    """A row for each file (path, content): all statistics of its prefix, and its content class."""
    made = featured(files).repartition("key")  # the one shuffle: all that follows goes by this key
    lines = T.lines_lf(made, "text", "key")
    tallies = T.line_tallies(lines, "key").join(T.distinct_identifiers(lines, "key"), "key", "left").join(T.modal_commas(lines, "key"), "key", "left")
    joined = made.drop("text").join(tallies, "key", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    some, kb = F.greatest(F.lit(1.0), n("lines") - n("blank")), F.greatest(F.lit(1.0), n("bytes") / 1024)
    share = lambda a, b: F.when(n(b) > 0, n(a) / n(b)).otherwise(0.0)
    stats = joined.select(
        F.col("key").alias("path"), "encoding", "bom", "bytes", "printable", "digitish", "entropy",
        F.when(F.col("cr_lines") > F.floor(F.col("lines") / 2), "crlf").otherwise("lf").alias("newline"),
        F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("max_line", F.lit(0)).alias("max_line_len"), share("line_bytes", "lines").alias("avg_line_len"),
        (n("blank") / F.greatest(F.lit(1.0), n("lines"))).alias("blank_frac"), (n("comments") / some).alias("comment_frac"), (n("defines") / some).alias("define_frac"), (n("includes") / some).alias("include_frac"),
        F.coalesce("idents", F.lit(0)).alias("idents"), F.coalesce("calls", F.lit(0)).alias("calls"),
        F.when(n("idents") > 0, F.least(n("distinct_idents"), F.lit(100_000.0)) / n("idents")).otherwise(0.0).alias("ident_unique_ratio"), share("ident_chars", "idents").alias("avg_ident_len"),
        (n("functions") / kb).alias("functions_per_kb"), F.when(n("functions") > 0, n("calls") / n("functions")).otherwise(n("calls")).alias("calls_per_function"),
        (n("x_macros") / some).alias("x_macro_frac"), (n("templates") / some).alias("template_frac"), ((n("enum_structs") + n("table_rows")) / some).alias("enum_struct_frac"), (n("hits") / some).alias("tabular_share"),
    )
    return stats.withColumn("class", content_class())


def content_class() -> Column:
    """The class of a row of file_stats, by fixed priority."""
    c = F.col
    blob = (c("digitish") >= 0.60) & (c("idents") / (c("bytes") / 1024) < 5)
    code = (c("idents") > 0) & ((c("functions_per_kb") > 0) | (c("define_frac") > 0) | (c("calls") > 0))
    return (
        F.when(c("bytes") == 0, "text")
        .when(~c("encoding").startswith("utf-16") & (c("printable") < 0.75), "binary")
        .when(blob & (c("entropy") >= 3.0), "data-blob-high-entropy")
        .when(blob, "data-blob-repetitive")
        .when((c("max_line_len") >= 100_000) & (c("lines") <= 50), "minified-longline")
        .when(c("define_frac") >= 0.50, "preprocessor-dense")
        .when(c("x_macro_frac") >= 0.30, "x-macro")
        .when(c("template_frac") >= 0.03, "template-metaprogramming")
        .when(c("functions_per_kb") >= 2.0, "inline-function-heavy")
        .when(c("enum_struct_frac") >= 0.20, "enum-struct-table")
        .when(c("tabular_share") >= 0.70, "tabular-data")
        .when(code, "generic-code")
        .otherwise("text")
    )


def modal_class(stats: DataFrame, *keys: str) -> DataFrame:
    """(keys..., class) most frequent; ties go to the class that comes first in CLASSES."""
    counted = stats.groupBy(*keys, "class").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.max_by("class", F.struct("n", -S.class_rank(F.col("class")))).alias("class"))


def density_means(stats: DataFrame, *keys: str) -> DataFrame:
    """(keys..., means and bands of functions per KB, calls per function and identifiers per file)."""
    means = stats.groupBy(*keys).agg(F.avg("functions_per_kb").alias("functions_per_kb"), F.avg("calls_per_function").alias("calls_per_function"), F.avg("idents").alias("global_refs"))
    return means.select("*", *[S.density_band(F.col(k), k).alias(f"{k}_band") for k in S.DENSITY_BOUNDS])


def content_means(stats: DataFrame, *keys: str) -> DataFrame:
    """(keys..., mean fractions, longest line, last encoding in path order that isn't ascii, any mark, any CRLF)."""
    mean = ("define_frac", "comment_frac", "blank_frac", "include_frac", "ident_unique_ratio", "avg_ident_len", "avg_line_len")
    return stats.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in mean],
        F.max("max_line_len").alias("max_line_len"),
        F.coalesce(F.max_by("encoding", F.when(F.col("encoding") != "ascii", F.col("path"))), F.lit("ascii")).alias("encoding"),
        F.bool_or("bom").alias("bom"),
        F.when(F.bool_or(F.col("newline") == "crlf"), "crlf").otherwise("lf").alias("newline"),
    )


def fold_small(clusters: DataFrame, files: DataFrame, least: int, *keys: str) -> DataFrame:
    """(label, n, p50, p90, max): clusters of least files and more by their keys, all others pooled as other."""
    label = F.when(F.col("n") < least, "other").otherwise(F.concat_ws("/", *keys))
    labelled = files.join(clusters.select(*keys, label.alias("label")), list(keys))
    return size_percentiles(labelled.select("label", "size"), "label")


def distinct_trigrams(files: DataFrame, group: str, content: str) -> DataFrame:
    """(group, distinct_tri) for each group, exactly; group null is the whole corpus. At most 2^24 rows per group reach
    the count."""
    found = cut(trigram_sets(files, group, content).distinct())
    per = found.groupBy("group").agg(F.count("*").alias("distinct_tri"))
    return per.unionByName(found.select("trigram").distinct().agg(F.count("*").alias("distinct_tri")).select(F.lit(None).cast("string").alias("group"), "distinct_tri"))


def include_stats(targets: DataFrame, names: DataFrame) -> DataFrame:
    """One row over targets (file, target) against names (name, count): how many, unresolved, ambiguous, rate."""
    joined = targets.join(names, targets["target"] == names["name"], "left")
    counted = joined.agg(F.count("*").alias("targets"), F.count_if(F.col("name").isNull()).alias("unresolved"), F.count_if(F.col("count") > 1).alias("ambiguous"))
    rate = F.when(F.col("targets") > 0, F.floor((1000 * F.col("unresolved") + F.floor(F.col("targets") / 2)) / F.col("targets"))).otherwise(0)
    return counted.select("targets", "unresolved", "ambiguous", rate.cast("long").alias("rate_milli"))


def population_stats(rows: DataFrame) -> DataFrame:
    """(name, file_count, total_bytes, ident_count) of (name, files, bytes, idents)."""
    return rows.groupBy("name").agg(F.sum("files").alias("file_count"), F.sum("bytes").alias("total_bytes"), F.sum("idents").alias("ident_count"))


def parsed_source_bytes(classed: DataFrame) -> DataFrame:
    """(class, bytes) of files (size, class) that are parsed as source."""
    return classed.where(S.is_parsed_source(F.col("class"))).groupBy("class").agg(F.sum("size").alias("bytes"))


def indexed_bytes(files: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: the bytes of all files (path, size) but those that were sampled (path, class) and found binary."""
    return files.join(stats.select("path", "class"), "path", "left").agg(F.sum(F.when(F.col("class").eqNullSafe("binary"), 0).otherwise(F.col("size"))).alias("indexed_bytes"))


def profile(files: DataFrame, sample: int = 50, least: int = 5, posture: str = "class-labeled") -> dict[str, DataFrame]:
    """The sections of a profile of files (path, size, content), each a DataFrame; the posture says what may leave."""
    reads, exact = S.POSTURES[posture]
    named = files.withColumn("ext", S.extension(F.regexp_extract("path", "[^/]*$", 0)))
    named = fold_name_like_extensions(named.withColumn("band", S.size_band(F.col("size"))))
    flat = named.select("path", "ext", "size", "band")
    clusters = size_percentiles(flat, "ext", "band")
    out = {
        "totals": flat.agg(F.count("*").alias("files"), F.sum("size").alias("bytes")),
        "size_histogram": size_histogram(flat),
        "extensions": extension_histogram(flat, least),
        "directories": directory_histograms(directories(flat)),
        "headers": header_counts(flat),
        "clusters": clusters,
        "archetypes": fold_small(clusters, flat, least, "ext", "band"),
    }
    if not reads:
        return out
    chosen = samples(named, sample, "ext", "band")
    stats = file_stats(chosen.select("path", "content")).join(chosen.select("path", "ext", "band", "size"), "path")
    kept = clusters.where(F.col("n") >= least).select("ext", "band")
    modal = modal_class(stats, "ext", "band")
    bands = density_means(stats, "ext", "band").join(kept, ["ext", "band"])
    hidden = [] if exact else list(S.DENSITY_BOUNDS)
    classed = flat.join(modal, ["ext", "band"])
    out |= {
        "classes": modal.join(kept, ["ext", "band"]),
        "densities": bands.drop(*hidden),
        "parsed_source_by_class": parsed_source_bytes(classed),
        "indexed": indexed_bytes(flat, stats),
    }
    if exact:
        out["content"] = content_means(stats, "ext", "band").join(kept, ["ext", "band"])
    return out


def closure_summary(closures: DataFrame) -> DataFrame:
    """One row over closures (unit, files, bytes): units, and p50, p95 and the largest of files and bytes, by index
    min(n - 1, floor(q * n)). Values are counted first, so the window sees one row per distinct value."""
    tall = closures.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("long").alias("v")) for c in ("files", "bytes")])).alias("x")).select("x.*")
    counted = tall.groupBy("what", "v").agg(F.count("*").alias("c"))
    placed = counted.withColumn("upto", F.sum("c").over(Window.partitionBy("what").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy("what")))
    at = lambda what, num, den: F.min(F.when((F.col("what") == what) & (F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * num / den))), F.col("v")))
    each = [x for c in ("files", "bytes") for x in (at(c, 1, 2).alias(f"{c}_p50"), at(c, 19, 20).alias(f"{c}_p95"), F.max(F.when(F.col("what") == c, F.col("v"))).alias(f"{c}_max"))]
    return placed.agg(F.max("n").alias("units"), *each)


def carve_bounds(defines: DataFrame, classes: DataFrame, bytes_before: int) -> DataFrame:
    """One row: how many define lines (name, length, terminator) are dropped at least and at most, and the bytes left, when
    names (name, cls) that are drop must go and those that are not keep may. A dropped line keeps its terminator at most."""
    d = defines.join(classes, "name", "left").withColumn("cls", F.coalesce("cls", F.lit("open")))
    drop, may = F.col("cls") == "drop", F.col("cls") != "keep"
    s = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    return d.agg(F.count("*").alias("defines"), s(drop, F.lit(1)).alias("dropped_min"), s(may, F.lit(1)).alias("dropped_max"), (F.lit(bytes_before) - s(may, F.col("length"))).alias("bytes_after_min"), (F.lit(bytes_before) - s(drop, F.col("length") - F.col("terminator"))).alias("bytes_after_max"))


def level_recounts(names: DataFrame, pattern: str) -> DataFrame:
    """(level, n, first, last) of names (name) that match pattern, whose group 1 is the level."""
    level = F.regexp_extract("name", pattern, 1).try_cast("int")
    return names.withColumn("level", level).where("level IS NOT NULL").groupBy("level").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))
