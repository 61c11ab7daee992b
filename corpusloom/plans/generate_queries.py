"""Generated tables: graphs, plans, headers, populations, streams of draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import delta as D
from ..operators import generate as G
from ..operators import graph, preproc, profile
from ..operators.rng import CATEGORIES, Stream
from .registry import query, table


@query("""WITH RECURSIVE e AS (SELECT (i - 1) // 3 AS src, i AS dst FROM range(1, 400) t(i) UNION ALL SELECT 400 + j, 400 + j - 1 FROM range(1, 100) t(j) WHERE j % 4 <> 0),
  r AS (SELECT 0::BIGINT AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT (SELECT count(*) FROM r) AS reachable, 500::BIGINT AS total""")
def gen_01_call_tree(spark, sf_dir):
    edges, n = G.call_tree(spark, 400, 3, fraction=0.8)
    reached = graph.reach(edges, spark.range(1).withColumnRenamed("id", "node"))
    return reached.agg(F.count("*").alias("reachable")).select("reachable", F.lit(n).cast("long").alias("total"))


@query("""SELECT i AS k, ['fnptr', 'vector-table', 'init_array'][i % 3 + 1] AS via, i % 2 = 0 AS dispatched, i % 3 <> 2 AS resolved, (i // 2) % 2 = 1 AS want_dead,
  CASE WHEN i % 3 <> 2 THEN 'itgt_' ELSE 'iext_' END || i AS target FROM range(0, 300) t(i)""")
def gen_02_indirect_plan(spark, sf_dir):
    return G.indirect_plan(spark, 300)


@query("""SELECT 'a/reg.h' AS path, i + 1 AS n, '#define HWIO_BLK7_REG' || i || '_ADDR (BASE_BLOCK7 + 0x' || lpad(lower(hex(i * 4)), 8, '0') || ')' || chr(10) || '#define HWIO_BLK7_REG' || i || '_RMSK 0x000000ff' || chr(10) || '#define HWIO_BLK7_REG' || i || '_IN in_dword(HWIO_BLK7_REG' || i || '_ADDR)' || chr(10) AS text FROM range(0, 500) t(i)""")
def gen_04_register_header(spark, sf_dir):
    return G.register_header(spark, "a/reg.h", 1500, 10**7, 7).where("text LIKE '%HWIO%'")


@query()
def gen_03_sources(spark, sf_dir):
    return G.call_sites(G.sources(spark, 40, 1, headers=5, body=10))


@query()
def gen_08_synthesized_classes(spark, sf_dir):
    """Files made for each class, and the class that they read as."""
    rows = [(c, ".x", 2, c, 3000, 5000, 8000) for c in S.CLASSES]
    made = G.from_archetypes(spark.createDataFrame(rows, "label string, ext string, count long, class string, p50 long, p90 long, max long"), 11)
    return profile.file_stats(made).select("path", "class")


@query()
def gen_09_populations(spark, sf_dir):
    parts = {"dup": G.duplicates(spark, 5, 3, 1).select("path", "content"), "broad": G.broad_token(spark, 4, 0.5, 1, 200), "encoding": G.encoding_mix(spark, 10, 1), "long": G.long_lines(spark, 2, 5000, 1), "patho": G.pathological_symbols(spark, 3, 1), "unresolved": G.unresolved_includes(spark, 3, 1), "tiny": G.tiny_files(spark, 5, 1), "blob": G.blobs(spark, 2, 1, 50), "header": G.ordinary_headers(spark, 5, 1)}
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("name"), F.lit(1).cast("long").alias("files"), F.octet_length("content").cast("long").alias("bytes"), F.lit(0).cast("long").alias("idents"))
        out = rows if out is None else out.unionByName(rows)
    return profile.population_stats(out)


@query()
def rng_01_streams(spark, sf_dir):
    """First raw value and a bounded draw of the streams of 100 indexes."""
    ids = spark.range(100)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            i = b.column(0).to_pylist()
            drawn = [(Stream(1337, CATEGORIES["Source"], k), Stream(1337, CATEGORIES["Source"], k)) for k in i]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array([str(a.next()) for a, _ in drawn]), pa.array([b_.below(1000) for _, b_ in drawn])], names=["index", "raw", "below"])

    return ids.mapInArrow(run, "index long, raw string, below long")


@query("""SELECT l_orderkey AS path, CASE WHEN l_linenumber % 6 = 0 THEN 'content' WHEN l_linenumber % 6 = 1 THEN 'eol' WHEN l_linenumber % 6 = 2 THEN 'whitespace' WHEN l_linenumber % 6 = 3 THEN 'encoding' WHEN l_linenumber % 6 = 4 THEN 'binary' ELSE 'metadata' END AS reason, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def dlt_17_mixed_reasons(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), D.reason(D.mixed_kind(F.col("l_linenumber"))).alias("reason"))
    return items.groupBy("path", "reason").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT 'd/f' || doc_id || '.c' AS path, doc_id AS i, len(string_split(text, chr(10))) AS lines FROM documents WHERE text IS NOT NULL)
SELECT path, i, 'd/f' || i || '_moved' || i || '.c' AS "to", [1000, 900, 600, 300][i % 4 + 1] AS target, cast(CASE WHEN i % 4 = 0 THEN 0 ELSE least(lines, ((1000 - [1000, 900, 600, 300][i % 4 + 1]) * lines + 999) // 1000) END AS BIGINT) AS changed FROM f""")
def dlt_20_rename_plan(spark, sf_dir):
    f = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d/f"), F.col("doc_id").cast("string"), F.lit(".c")).alias("path"), F.col("doc_id").alias("i"), F.size(F.split("text", "\n")).alias("lines"))
    return D.rename_plan(f, 0, 1).drop("decoy")


@query("SELECT doc_id AS path, CASE WHEN n = 1 THEN 'replace' ELSE 'insert' END AS op, greatest(1, n // 2) AS old_start, CASE WHEN n = 1 THEN 1 ELSE 0 END::BIGINT AS old_lines, CASE WHEN n = 1 THEN 1 ELSE greatest(1, n // 2) + 1 END AS new_start, CASE WHEN n = 1 THEN 2 ELSE 1 END::BIGINT AS new_lines FROM (SELECT doc_id, cast(len(string_split(text, chr(10))) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL)")
def dlt_19_single_insert(spark, sf_dir):
    f = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.size(F.split("text", "\n")).cast("long").alias("lines"), F.lit(True).alias("ends_open"))
    return D.single_insert(f)


@query("SELECT doc_id AS path, sha256(replace(text, chr(10), chr(13) || chr(10))) AS flipped, strlen(text) - length(text) > 0 AS wide FROM documents WHERE text IS NOT NULL")
def dlt_12_eol_flip(spark, sf_dir):
    from ..functions.text import lines_any

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    full = d.select(F.col("doc_id").alias("path"), "text", (F.octet_length("text") > F.length("text")).alias("wide"))
    lines = lines_any(full, "text", "path")
    text = D.rebuilt(D.eol_flipped(lines)).withColumnRenamed("text", "new")
    return full.join(text, "path", "left").select("path", F.sha2(F.coalesce("new", F.lit("")), 256).alias("flipped"), "wide")


@query("""WITH RECURSIVE h AS (SELECT k, k % 4 <> 3 AS guarded, CASE WHEN k > 0 THEN '#include "h' || (k // 2) || '.h"' || chr(10) || '#include "h' || (k // 3) || '.h"' || chr(10) ELSE '' END AS body FROM range(0, 3100) t(k)),
  s AS (SELECT k, guarded, strlen(CASE WHEN guarded THEN '#ifndef H' || k || '_H' || chr(10) || '#define H' || k || '_H 1' || chr(10) || body || '#endif' || chr(10) ELSE body END) AS size FROM h),
  u AS (SELECT j, strlen('#include "h' || (j + 20) || '.h"' || chr(10) || '#if H1_H && !defined(NONE)' || chr(10) || '#include <h' || (j + 1) || '.h>' || chr(10) || '#endif' || chr(10)) AS size FROM range(0, 3000) t(j)),
  e AS (SELECT k AS src, k // 2 AS dst FROM h WHERE k > 0 UNION ALL SELECT k, k // 3 FROM h WHERE k > 0),
  top AS (SELECT j, j + 20 AS k FROM u UNION ALL SELECT j, j + 1 FROM u),
  r AS (SELECT j, k FROM top UNION SELECT r.j, e.dst FROM r JOIN e ON e.src = r.k),
  starts AS (SELECT j, k FROM top UNION ALL SELECT r.j, e.dst FROM r JOIN h USING (k) JOIN e ON e.src = r.k WHERE h.guarded),
  v AS (SELECT j, k FROM starts UNION ALL SELECT v.j, e.dst FROM v JOIN e ON e.src = v.k WHERE v.k % 4 = 3),
  once AS (SELECT j, count(*) AS files, sum(size) AS bytes, count_if(guarded) AS guards, sum(size) FILTER (guarded) AS guarded FROM r JOIN s USING (k) GROUP BY j),
  often AS (SELECT j, count(*) AS n, sum(size) AS bytes FROM v JOIN s USING (k) WHERE NOT guarded GROUP BY j)
SELECT 'web/u' || j || '.c' AS unit, 1 + files AS files, cast(u.size + once.bytes AS BIGINT) AS bytes, 1 + guards + coalesce(n, 0) AS reads, cast(u.size + guarded + coalesce(often.bytes, 0) AS BIGINT) AS read_bytes,
  cast(length(bin(j + 20)) + 1 AS BIGINT) AS depth, guards AS defines, 0::BIGINT AS template_instances, NULL::VARCHAR AS error FROM u JOIN once USING (j) LEFT JOIN often USING (j)""")
def grf_12_closures(spark, sf_dir):
    """Closures of 3,000 units of a generated include web: units include headers that include others, guarded or not."""
    k, s = F.col("id"), F.col("id").cast("string")
    inner = F.when(k > 0, F.concat(F.lit('#include "h'), F.floor(k / 2).cast("string"), F.lit('.h"\n#include "h'), F.floor(k / 3).cast("string"), F.lit('.h"\n'))).otherwise("")
    guarded = F.when(k % 4 == 3, inner).otherwise(F.concat(F.lit("#ifndef H"), s, F.lit("_H\n#define H"), s, F.lit("_H 1\n"), inner, F.lit("#endif\n")))
    headers = spark.range(3100).select(F.concat(F.lit("inc/h"), s, F.lit(".h")).alias("path"), F.encode(guarded, "UTF-8").alias("content"))
    unit = F.concat(F.lit('#include "h'), (k + 20).cast("string"), F.lit('.h"\n#if H1_H && !defined(NONE)\n#include <h'), (k + 1).cast("string"), F.lit('.h>\n#endif\n'))
    units = spark.range(3000).select(F.concat(F.lit("web/u"), s, F.lit(".c")).alias("path"), F.encode(unit, "UTF-8").alias("content"))
    return preproc.closures(headers.unionByName(units), units.select(F.col("path").alias("unit")), ["inc"])


@query("""WITH RECURSIVE t AS (SELECT doc_id AS k FROM documents WHERE doc_id % 10 = 0 UNION SELECT k // 3 FROM t) SELECT 'TNAME' AS name UNION ALL SELECT 'G' || k FROM t""")
def grf_13_tracked_names(spark, sf_dir):
    """Every document's file defines a name by another's; every tenth asks for its own."""
    k = F.col("doc_id").cast("string")
    asked = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("#ifdef G"), k, F.lit("\n#endif\n"))).otherwise("")
    text = F.concat(asked, F.lit("#define G"), k, F.lit(" (G"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit(" + 1)\n"))
    return preproc.tracked_names(preproc.parsed_files(table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), k).alias("path"), F.encode(text, "UTF-8").alias("content"))))


@query("""WITH RECURSIVE e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0 AND doc_id % 11 <> 10),
  r AS (SELECT doc_id AS k FROM documents WHERE doc_id % 7 = 0 UNION SELECT e.dst FROM r JOIN e ON e.src = r.k)
SELECT CASE WHEN k % 3 = 0 THEN 'ext/h' ELSE 'fw/h' END || k || '.h' AS path, k % 3 <> 0 AND k % 5 <> 0 AND EXISTS (FROM e JOIN r AS o ON o.k = e.src WHERE e.dst = r.k AND e.src % 3 = 0) AS whole FROM r""")
def grf_15_included_whole(spark, sf_dir):
    """A file for each document, every third outside the carved root; each includes that of half its number, quoted with its
    directory or by one of two search paths."""
    k = F.col("doc_id")
    where = lambda n: F.when(n % 3 == 0, "ext").otherwise("fw")
    named = lambda n: F.concat(F.lit("h"), n.cast("string"), F.lit(".h"))
    path, half = F.concat_ws("/", where(k), named(k)), F.floor(k / 2).cast("long")
    d = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    quoted = F.concat(F.lit("../"), where(half), F.lit("/./"), named(half))
    includes = d.where("doc_id > 0 AND doc_id % 11 <> 10").select(F.col("path").alias("src"), F.when(k % 2 == 0, quoted).otherwise(named(half)).alias("spec"), (k % 2 == 1).alias("angled"))
    units = d.where("doc_id % 7 = 0").select(F.col("path").alias("unit"), (k % 2).cast("int").alias("search"))
    return preproc.build_closure(includes, units, [["fw", "ext"], ["none", "ext", "fw"]], d, "fw", d.where("doc_id % 5 <> 0"))
