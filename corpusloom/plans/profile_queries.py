"""Profile queries over the bound tables: documents are the files, pages the include graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..functions.bytes import featured
from ..operators import graph as G
from ..operators import profile as P
from ..operators import verify as V
from ..sources.files import documents_as_files
from .registry import query, table

#: SQL of files and lines over documents; each query that needs them starts with it.
FILES = """files AS (SELECT doc_id, coalesce(source, '?') || '/' || coalesce(lang, '?') || '/' || doc_id AS path, coalesce(lang, '?') AS lang,
  coalesce(source, '?') AS source, cast(strlen(coalesce(text, '')) AS BIGINT) AS size, coalesce(text, '') AS text FROM documents)"""
LINES = """cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
  line AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM cut)"""
BAND = "CASE WHEN size < 1024 THEN 0 WHEN size < 10240 THEN 1 WHEN size < 102400 THEN 2 WHEN size < 1048576 THEN 3 WHEN size < 10485760 THEN 4 WHEN size < 104857600 THEN 5 WHEN size < 1073741824 THEN 6 ELSE 7 END"
LABELS = "['<1KB', '1-10KB', '10-100KB', '100KB-1MB', '1-10MB', '10-100MB', '100MB-1GB', '>1GB']"


def round3_sql(x: str) -> str:
    """Three significant digits, halves up."""
    scale = f"(CASE WHEN {x} < 1000 THEN 1 " + " ".join(f"WHEN {x} < {1000 * 10**k} THEN {10**k}" for k in range(1, 9)) + " END)"
    return f"cast((({x} + {scale} // 2) // {scale}) * {scale} AS BIGINT)"


def percentiles_sql(source: str, keys: str) -> str:
    """p50, p90 and max by index min(n - 1, floor(q n)) per keys of source (keys, size)."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY size) - 1 AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
  sized AS (SELECT {keys}, max(n) AS n, max(size) FILTER (r = least(n - 1, n // 2)) AS p50, max(size) FILTER (r = least(n - 1, 9 * n // 10)) AS p90, max(size) AS most FROM ranked GROUP BY {keys})"""


def files(spark, sf_dir):
    return documents_as_files(table(spark, sf_dir, "documents"))


def doc_lines(spark, sf_dir):
    return T.lines_lf(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "text", "doc_id")


@query(f"WITH {FILES} SELECT {LABELS}[{BAND} + 1] AS bucket, count(*) AS files, cast(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def agg_01_size_histogram(spark, sf_dir):
    return P.size_histogram(files(spark, sf_dir))


@query(f"""WITH {FILES}, e AS (SELECT source, count(*) AS c, sum(size) AS b FROM files GROUP BY 1)
SELECT CASE WHEN c < 50 THEN '(other)' ELSE source END AS ext, cast(sum(c) AS BIGINT) AS files, cast(sum(b) AS BIGINT) AS bytes FROM e GROUP BY 1""")
def agg_02_ext_histogram_kanon(spark, sf_dir):
    return P.extension_histogram(files(spark, sf_dir).withColumn("ext", F.split("path", "/")[0]), 50)


@query(f"""WITH {FILES}, d AS (SELECT DISTINCT source || '/' || lang AS dir, source FROM files),
  dirs AS (SELECT '' AS dir, 0 AS depth, (SELECT count(DISTINCT source) FROM files) AS fan, 0 AS held
    UNION ALL SELECT source, 1, count(*), 0 FROM d GROUP BY 1
    UNION ALL SELECT source || '/' || lang, 2, 0, count(*) FROM files GROUP BY 1),
  x AS (SELECT 'depth' AS kind, cast(depth AS VARCHAR) AS bucket FROM dirs UNION ALL
    SELECT 'fanout', CASE WHEN fan <= 4 THEN cast(fan AS VARCHAR) WHEN fan <= 16 THEN '5-16' WHEN fan <= 64 THEN '17-64' ELSE '65+' END FROM dirs UNION ALL
    SELECT 'files', CASE WHEN held <= 4 THEN cast(held AS VARCHAR) WHEN held <= 16 THEN '5-16' WHEN held <= 64 THEN '17-64' ELSE '65+' END FROM dirs)
SELECT kind, bucket, count(*) AS n FROM x GROUP BY 1, 2""")
def agg_03_directories(spark, sf_dir):
    return P.directory_histograms(P.directories(files(spark, sf_dir)))


@query(f"WITH {FILES} SELECT count_if(size >= 20480) AS giant, count_if(size >= 1024 AND size < 20480) AS big, count_if(size < 1024) AS ordinary FROM files")
def agg_04_size_counts(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("ext", F.lit(".h")).withColumn("size", F.col("size") * 1024)
    return P.header_counts(f)


@query(f"""WITH {FILES}, c AS (SELECT lang AS ext, {BAND} AS band, size FROM files), {percentiles_sql('c', 'ext, band')}
SELECT ext, band, n, {round3_sql('p50')} AS p50, {round3_sql('p90')} AS p90, {round3_sql('most')} AS max FROM sized""")
def agg_05_clusters(spark, sf_dir):
    return P.size_percentiles(files(spark, sf_dir).withColumn("band", S.size_band(F.col("size"))), "ext", "band")


@query(f"""WITH {FILES}, c AS (SELECT lang AS ext, {BAND} AS band, size FROM files),
  big AS (SELECT ext, band, count(*) AS n FROM c GROUP BY 1, 2),
  l AS (SELECT CASE WHEN big.n < 60 THEN 'other' ELSE c.ext || '/' || c.band END AS label, size FROM c JOIN big USING (ext, band)), {percentiles_sql('l', 'label')}
SELECT label, n, {round3_sql('p50')} AS p50, {round3_sql('p90')} AS p90, {round3_sql('most')} AS max FROM sized""")
def agg_10_small_fold(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("band", S.size_band(F.col("size")))
    return P.fold_small(P.size_percentiles(f, "ext", "band"), f, 60, "ext", "band")


@query("""WITH h AS (SELECT lang, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
  t AS (SELECT DISTINCT lang AS "group", substr(h, 2 * i + 1, 6) AS tri FROM (SELECT lang, h, unnest(range(greatest(length(h) // 2 - 2, 0))) AS i FROM h))
SELECT "group", count(*) AS distinct_tri FROM t GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT tri) FROM t""")
def agg_13_trigrams(spark, sf_dir):
    return P.distinct_trigrams(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "lang", "text")


@query("SELECT lang, cast(sum(greatest(strlen(coalesce(text, '')) - 2, 0)) AS BIGINT) AS occurrences FROM documents GROUP BY 1")
def agg_14_trigram_occurrences(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.greatest(F.octet_length(F.coalesce("text", F.lit(""))) - 2, F.lit(0))).cast("long").alias("occurrences"))


PAGES = """p AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1)) AS name, html FROM pages),
  t AS (SELECT page_id, name, lower(regexp_extract(x, '([^/]*)$', 1)) AS target FROM (SELECT page_id, name, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS x FROM p)),
  names AS (SELECT name, count(*) AS c FROM (SELECT target AS name FROM t WHERE length(target) % 3 > 0 UNION ALL SELECT name FROM p) GROUP BY 1)"""


def page_graph(spark, sf_dir):
    """Pages as files: (page_id, name) and their links (page_id, file, target), and how often names stand in the tree."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)/?$", 1)).alias("name"), "html")
    links = pages.select("page_id", F.col("name").alias("file"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("x")).select("page_id", "file", F.lower(F.regexp_extract("x", "([^/]*)$", 1)).alias("target"))
    names = links.where(F.length("target") % 3 > 0).select(F.col("target").alias("name")).unionByName(pages.select("name")).groupBy("name").agg(F.count("*").alias("count"))
    return pages.select("page_id", "name"), links, names


@query(f"""WITH {PAGES} SELECT count(*) AS targets, count_if(names.name IS NULL) AS unresolved, count_if(c > 1) AS ambiguous,
  cast((1000 * count_if(names.name IS NULL) + count(*) // 2) // greatest(count(*), 1) AS BIGINT) AS rate_milli FROM t LEFT JOIN names ON t.target = names.name""")
def agg_15_include_stats(spark, sf_dir):
    _, links, names = page_graph(spark, sf_dir)
    return P.include_stats(links, names)


@query(f"""WITH {PAGES}, d AS (SELECT DISTINCT t.page_id, target FROM t JOIN names ON target = names.name),
  step AS (SELECT DISTINCT t.name AS via, target FROM t JOIN names ON target = names.name),
  r AS (SELECT * FROM d UNION SELECT d.page_id, step.target FROM d JOIN step ON d.target = step.via),
  c AS (SELECT p.page_id, count(r.target) AS n FROM p LEFT JOIN r ON p.page_id = r.page_id GROUP BY 1)
SELECT CASE WHEN n <= 4 THEN '0-4' WHEN n <= 16 THEN '5-16' WHEN n <= 64 THEN '17-64' ELSE '65+' END AS bucket, count(*) AS n FROM c GROUP BY 1""")
def grf_02_two_hop(spark, sf_dir):
    pages, links, names = page_graph(spark, sf_dir)
    known = links.join(names.select(F.col("name").alias("target")), "target", "left_semi")
    direct = known.select(F.col("page_id").alias("file"), "target")
    reached = G.k_hops(direct, known.select("file", "target"))
    full = pages.join(reached.withColumnRenamed("file", "page_id"), "page_id", "left")
    return full.groupBy(S.fanout_bucket(F.coalesce("reach", F.lit(0))).alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT quality, toxic FROM labels) SELECT cast(quality AS VARCHAR) AS name, count(*) AS file_count, cast(sum(toxic) AS BIGINT) AS total_bytes, cast(sum(1 + toxic) AS BIGINT) AS ident_count FROM l GROUP BY 1""")
def agg_16_population_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("name"), F.lit(1).cast("long").alias("files"), F.col("toxic").cast("long").alias("bytes"), (1 + F.col("toxic")).cast("long").alias("idents"))
    return P.population_stats(rows)


NOT_BLANK = "regexp_matches(line, '[^ \\t]')"
DEFINE, COMMENT = "regexp_matches(line, '^[ \\t]*#[ \\t]*define($|[^A-Za-z0-9_])')", "regexp_matches(line, '^[ \\t]*(//|/\\*|\\*)')"
IDENT = "[A-Za-z_][A-Za-z0-9_]*"


@query(f"""WITH {LINES}, s AS (SELECT doc_id, regexp_replace(line, '\\r$', '') AS line FROM line),
  names AS (SELECT doc_id, count(DISTINCT x) AS d FROM (SELECT doc_id, unnest(regexp_extract_all(line, '{IDENT}')) AS x FROM s) GROUP BY 1),
  t AS (SELECT doc_id, count(*) AS lines, count_if(NOT {NOT_BLANK}) AS blank, count_if({NOT_BLANK} AND {DEFINE}) AS defines, count_if({NOT_BLANK} AND {COMMENT} AND NOT {DEFINE}) AS comments,
    cast(sum(len(regexp_extract_all(line, '{IDENT}'))) AS BIGINT) AS idents, cast(sum(len(regexp_extract_all(line, '{IDENT}\\('))) AS BIGINT) AS calls, cast(max(strlen(line)) AS BIGINT) AS max_line FROM s GROUP BY 1)
SELECT t.*, coalesce(names.d, 0) AS distinct_idents FROM t LEFT JOIN names USING (doc_id)""")
def txt_06_line_tallies(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    tallies = T.line_tallies(lines, "doc_id").select("doc_id", "lines", "blank", "defines", "comments", "idents", "calls", "max_line")
    return tallies.join(T.distinct_identifiers(lines, "doc_id"), "doc_id", "left").fillna(0, ["distinct_idents"])


@query(f"""WITH {LINES}, s AS (SELECT doc_id, n, CASE WHEN regexp_matches(line, '{IDENT}\\(') THEN 0 ELSE length(line) - length(replace(line, ',', '')) END AS commas FROM line WHERE {NOT_BLANK}),
  c AS (SELECT doc_id, commas, count(*) AS hits, min(n) AS f FROM s WHERE commas > 0 GROUP BY 1, 2)
SELECT doc_id, cast(commas AS INTEGER) AS commas, hits FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, f) = 1""")
def txt_09_modal_commas(spark, sf_dir):
    return T.modal_commas(doc_lines(spark, sf_dir), "doc_id").select("doc_id", "commas", "hits")


@query()
def txt_12_class(spark, sf_dir):
    stats = P.file_stats(files(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content")))
    return stats.groupBy("class").agg(F.count("*").alias("n"))


@query()
def txt_03_byte_features(spark, sf_dir):
    made = featured(files(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content")), with_text=False)
    return made.select(F.col("key").alias("path"), "encoding", "bom", "bytes", F.round("printable", 6).alias("printable"), F.round("digitish", 6).alias("digitish"), F.round("entropy", 6).alias("entropy"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, count_if(regexp_matches(line, '[^ \\t\\r]') AND NOT regexp_matches(line, '^[ \\t\\r]*/[/*]')) AS substantive,
  count_if(regexp_matches(line, '^[ \\t\\r]*#[ \\t]*define($|[^A-Za-z0-9_])')) AS defines FROM line GROUP BY 1)
SELECT doc_id, substantive, defines, substantive >= 50 AND 10 * defines >= 6 * substantive AS dense FROM s""")
def txt_18_define_density(spark, sf_dir):
    counts = T.density_counts(doc_lines(spark, sf_dir), "doc_id")
    return counts.withColumn("dense", T.density_verdict(F.col("substantive"), F.col("defines"))[0])


@query(f"""WITH {FILES}, r AS (SELECT lang AS ext, {BAND} AS band, path, row_number() OVER (PARTITION BY lang, {BAND} ORDER BY encode(path)) AS r FROM files)
SELECT ext, band, path FROM r WHERE r <= 3""")
def srt_03_sample(spark, sf_dir):
    f = files(spark, sf_dir).select("ext", S.size_band(F.col("size")).alias("band"), "path")
    return P.samples(f, 3, "ext", "band")


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def jon_07_dup_groups(spark, sf_dir):
    return V.duplicate_groups(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text")


@query("""WITH m AS (SELECT lang, count(*) AS n, cast(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1)
SELECT lang, n, chars FROM m ORDER BY chars DESC, lang LIMIT 2""")
def srt_02_largest(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return by.orderBy(F.desc("chars"), "lang").limit(2)


@query("""SELECT CASE WHEN v % 7 = 0 THEN 'a.' || 'c' WHEN v % 7 = 1 THEN '.name' WHEN v % 7 = 2 THEN 'none' WHEN v % 7 = 3 THEN 'x.BAD ONE' WHEN v % 7 = 4 THEN 'b.CPP' WHEN v % 7 = 5 THEN 'd.h++' ELSE 'e.' END AS name,
  CASE WHEN v % 7 = 0 THEN '.c' WHEN v % 7 = 1 THEN '(dotfile)' WHEN v % 7 = 2 THEN '(none)' WHEN v % 7 = 3 THEN '(other)' WHEN v % 7 = 4 THEN '.cpp' WHEN v % 7 = 5 THEN '.h++' ELSE '(none)' END AS ext, count(*) AS n
FROM (SELECT doc_id AS v FROM documents) GROUP BY 1, 2""")
def prj_01_extensions(spark, sf_dir):
    v = F.col("doc_id") % 7
    name = F.when(v == 0, "a.c").when(v == 1, ".name").when(v == 2, "none").when(v == 3, "x.BAD ONE").when(v == 4, "b.CPP").when(v == 5, "d.h++").otherwise("e.")
    named = table(spark, sf_dir, "documents").select(name.alias("name"))
    return named.groupBy("name", S.extension(F.col("name")).alias("ext")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {round3_sql('n_chars')} AS rounded, CASE WHEN n_chars <= 4 THEN cast(n_chars AS VARCHAR) WHEN n_chars <= 16 THEN '5-16' WHEN n_chars <= 64 THEN '17-64' ELSE '65+' END AS bucket, CASE WHEN n_chars / 1000.0 < 0.5 THEN 'low' WHEN n_chars / 1000.0 < 2.0 THEN 'med' ELSE 'high' END AS density FROM documents")
def prj_06_rounding(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", S.round3(n).alias("rounded"), S.count_bucket(n).alias("bucket"), S.density_band(n / 1000, "functions_per_kb").alias("density"))
