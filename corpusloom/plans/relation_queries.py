"""Queries of the checks, deltas, aggregates and sets whose inputs are built from row keys, and round trips of sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import delta as D
from ..operators import graph as G
from ..operators import preproc as X
from ..operators import profile as P
from ..operators import verify as V
from ..sources import files as R
from ..sources import manifests as M
from ..sources import sinks as W
from .check_queries import lines
from .function_queries import by_case, case_sql, docs, k, quoted
from .profile_queries import BAND, FILES, LINES, files, percentiles_sql, round3_sql
from .registry import query, table

CLASSES = list(S.CLASSES)


# ---- aggregates ----


@query(f"""WITH c AS (SELECT lang, (doc_id * 7 + n_chars) % 12 AS r, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT lang, {str(CLASSES)}[r + 1] AS class FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, r) = 1""")
def agg_06_modal_class(spark, sf_dir):
    r = ((F.col("doc_id") * 7 + F.col("n_chars")) % 12).cast("int")
    return P.modal_class(docs(spark, sf_dir).select("lang", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), r + 1).alias("class")), "lang")


@query("""SELECT source, round(avg(n_chars % 7), 6) AS f, round(avg(n_chars % 11), 6) AS g, round(avg(n_chars), 4) AS h,
  CASE WHEN avg(n_chars % 7) < 0.5 THEN 'low' WHEN avg(n_chars % 7) < 2 THEN 'med' ELSE 'high' END AS band FROM documents GROUP BY 1""")
def agg_07_density_means(spark, sf_dir):
    n = F.col("n_chars")
    made = P.density_means(docs(spark, sf_dir).select("source", (n % 7).alias("functions_per_kb"), (n % 11).alias("calls_per_function"), n.alias("idents")), "source")
    return made.select("source", F.round("functions_per_kb", 6).alias("f"), F.round("calls_per_function", 6).alias("g"), F.round("global_refs", 4).alias("h"), F.col("functions_per_kb_band").alias("band"))


@query("""SELECT source, round(avg(n_chars), 4) AS mean, max(n_chars) AS longest, coalesce(arg_max(CASE WHEN doc_id % 9 = 0 THEN 'utf-8' WHEN doc_id % 9 = 1 THEN 'utf-16le' END, CASE WHEN doc_id % 9 < 2 THEN doc_id END), 'ascii') AS encoding,
  bool_or(doc_id % 9 < 2) AS bom, CASE WHEN bool_or(doc_id % 50 = 3) THEN 'crlf' ELSE 'lf' END AS newline FROM documents GROUP BY 1""")
def agg_08_content_means(spark, sf_dir):
    n, key = F.col("n_chars"), F.col("doc_id")
    mean = ("define_frac", "comment_frac", "blank_frac", "include_frac", "ident_unique_ratio", "avg_ident_len", "avg_line_len")
    encoding = F.when(key % 9 == 0, "utf-8").when(key % 9 == 1, "utf-16le").otherwise("ascii")
    stats = docs(spark, sf_dir).select("source", key.alias("path"), *[n.alias(c) for c in mean], n.alias("max_line_len"), encoding.alias("encoding"), (key % 9 < 2).alias("bom"), F.when(key % 50 == 3, "crlf").otherwise("lf").alias("newline"))
    return P.content_means(stats, "source").select("source", F.round("avg_line_len", 4).alias("mean"), F.col("max_line_len").alias("longest"), "encoding", "bom", "newline")


@query(f"WITH {FILES}, {percentiles_sql('files', 'source')} SELECT source, n, {round3_sql('p50')} AS p50, {round3_sql('p90')} AS p90, {round3_sql('most')} AS max FROM sized")
def agg_09_percentiles(spark, sf_dir):
    return P.size_percentiles(files(spark, sf_dir).withColumn("source", F.split("path", "/")[0]), "source")


@query(f"WITH c AS (SELECT {str(CLASSES)}[doc_id % 12 + 1] AS class, n_chars FROM documents) SELECT class, cast(sum(n_chars) AS BIGINT) AS bytes FROM c WHERE class IN ({', '.join(quoted(c for c, x in S.CLASSES.items() if x[1]))}) GROUP BY 1")
def agg_11_parsed_bytes(spark, sf_dir):
    return P.parsed_source_bytes(docs(spark, sf_dir).select(by_case([F.lit(c) for c in CLASSES]).alias("class"), F.col("n_chars").cast("long").alias("size")))


@query("SELECT cast(sum(CASE WHEN doc_id % 12 = 11 AND doc_id % 2 = 1 AND doc_id % 5 <> 0 THEN 0 ELSE n_chars END) AS BIGINT) AS indexed_bytes FROM documents")
def agg_12_indexed_bytes(spark, sf_dir):
    f = docs(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("n_chars").cast("long").alias("size"))
    stats = docs(spark, sf_dir).where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), by_case([F.lit(c) for c in CLASSES]).alias("class"))
    return P.indexed_bytes(f, stats)


@query("""WITH f AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY o_custkey) - 1 AS r, count(*) OVER () AS n FROM orders), b AS (SELECT o_orderkey * 3 AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
SELECT (SELECT count(*) FROM orders) AS units, (SELECT v FROM f WHERE r = least(n - 1, n // 2)) AS files_p50, (SELECT v FROM f WHERE r = least(n - 1, 19 * n // 20)) AS files_p95, (SELECT max(v) FROM f) AS files_max,
  (SELECT v FROM b WHERE r = least(n - 1, n // 2)) AS bytes_p50, (SELECT v FROM b WHERE r = least(n - 1, 19 * n // 20)) AS bytes_p95, (SELECT max(v) FROM b) AS bytes_max""")
def agg_17_closure_summary(spark, sf_dir):
    return P.closure_summary(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("files"), (F.col("o_orderkey") * 3).alias("bytes")))


@query("""WITH d AS (SELECT p_size AS length, CASE WHEN p_partkey % 3 = 0 THEN 'drop' WHEN p_partkey % 3 = 1 THEN 'keep' ELSE 'open' END AS cls FROM part)
SELECT count(*) AS defines, count_if(cls = 'drop') AS dropped_min, count_if(cls <> 'keep') AS dropped_max, cast(1000000000 - coalesce(sum(length) FILTER (cls <> 'keep'), 0) AS BIGINT) AS bytes_after_min, cast(1000000000 - coalesce(sum(length - 1) FILTER (cls = 'drop'), 0) AS BIGINT) AS bytes_after_max FROM d""")
def agg_18_carve_bounds(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cls = by_case([F.lit("drop"), F.lit("keep"), F.lit(None)], "p_partkey")
    named = part.where("p_partkey % 3 < 2").select(F.col("p_partkey").alias("name"), cls.alias("cls"))
    return P.carve_bounds(part.select(F.col("p_partkey").alias("name"), F.col("p_size").cast("long").alias("length"), F.lit(1).alias("terminator")), named, 1_000_000_000)


@query("SELECT cast(doc_id % 7 AS INTEGER) AS level, count(*) AS n, min('LV' || (doc_id % 7) || '_' || doc_id) AS first, max('LV' || (doc_id % 7) || '_' || doc_id) AS last FROM documents WHERE doc_id % 10 <> 0 GROUP BY 1")
def agg_19_level_recounts(spark, sf_dir):
    name = F.when(F.col("doc_id") % 10 == 0, k("other_")).otherwise(F.concat(F.lit("LV"), (F.col("doc_id") % 7).cast("string"), F.lit("_"), F.col("doc_id").cast("string")))
    return P.level_recounts(docs(spark, sf_dir).select(name.alias("name")), r"^LV(\d+)_\d+$")


@query("SELECT count(*) AS symbols, cast(sum(CASE WHEN doc_id % 4 > 0 THEN n_chars END) AS BIGINT) AS bytes FROM documents")
def agg_21_byte_mass(spark, sf_dir):
    return V.byte_mass(docs(spark, sf_dir).select(F.when(F.col("doc_id") % 4 > 0, F.col("n_chars").cast("long")).alias("bytes")))


@query("WITH RECURSIVE r AS (SELECT 0::BIGINT AS node UNION SELECT d.doc_id FROM r JOIN documents d ON d.doc_id > 0 AND (d.doc_id - 1) // 4 = r.node AND d.doc_id % 6 <> 5) SELECT round(1000.0 * (SELECT count(*) FROM r) / (SELECT count(*) FROM documents), 3) AS milli")
def agg_22_reachable_fraction(spark, sf_dir):
    edges = docs(spark, sf_dir).where("doc_id > 0 AND doc_id % 6 <> 5").select(F.floor((F.col("doc_id") - 1) / 4).cast("long").alias("src"), F.col("doc_id").alias("dst"))
    reached = G.reach(edges, spark.range(1).toDF("node")).agg(F.count("*").alias("r"))
    return reached.crossJoin(docs(spark, sf_dir).agg(F.count("*").alias("n"))).select(F.round(1000.0 * F.col("r") / F.col("n"), 3).alias("milli"))


# ---- checks ----


def text_lines(spark, sf_dir):
    """Three lines of a file for each document: a guard (not in every fifth), a use of its name, and a generator's call."""
    guard = F.when(F.col("doc_id") % 5 == 0, F.lit("#if 1")).otherwise(F.lit("#ifdef VENDOR_OK"))
    made = F.array(guard, F.concat(F.lit("int x = "), k("v"), F.lit(";")), F.concat(F.lit("GEN("), k(), F.lit(")")))
    return docs(spark, sf_dir).select(k("f").alias("path"), F.posexplode(made).alias("n", "content")).select("path", (F.col("n") + 1).alias("n"), "content")


@query("""SELECT 'gated' AS "check", 'v' || (doc_id + doc_id % 3 // 2) AS key, 'f' || doc_id || ':2' AS site, CASE WHEN doc_id % 3 = 2 THEN 'line does not hold the name' ELSE 'file has no guard' END AS reason FROM documents WHERE doc_id % 3 = 2 OR doc_id % 5 = 0""")
def jon_05_gated(spark, sf_dir):
    name = F.concat(F.lit("v"), (F.col("doc_id") + F.floor(F.col("doc_id") % 3 / 2)).cast("string"))
    return V.gated_refs(docs(spark, sf_dir).select(name.alias("name"), F.concat(k("f"), F.lit(":2")).alias("site")), text_lines(spark, sf_dir))


@query("""SELECT 'expected-miss' AS "check", 'v' || doc_id AS key, 'f' || doc_id || ':' || (2 + doc_id % 3) AS site, CASE doc_id % 3 WHEN 0 THEN 'the name is literally there' ELSE 'no such line' END AS reason FROM documents WHERE doc_id % 3 <> 1""")
def jon_06_expected_miss(spark, sf_dir):
    site = F.concat(k("f"), F.lit(":"), (2 + F.col("doc_id") % 3).cast("string"))
    return V.expected_misses(docs(spark, sf_dir).select(k("v").alias("name"), site.alias("site"), F.lit("GEN").alias("macro")), text_lines(spark, sf_dir))


@query("""WITH t AS (SELECT 'b' || (l_partkey % 50) AS target FROM lineitem), n AS (SELECT 'b' || (p_partkey % 30) AS name, count(*) AS c FROM part GROUP BY 1)
SELECT count(*) AS targets, count_if(name IS NULL) AS unresolved, count_if(c > 1) AS ambiguous, cast((1000 * count_if(name IS NULL) + count(*) // 2) // count(*) AS BIGINT) AS rate_milli FROM t LEFT JOIN n ON target = name""")
def jon_08_include_targets(spark, sf_dir):
    name = lambda c, m: F.concat(F.lit("b"), (F.col(c) % m).cast("string"))
    targets = table(spark, sf_dir, "lineitem").select(F.lit("f").alias("file"), name("l_partkey", 50).alias("target"))
    return P.include_stats(targets, table(spark, sf_dir, "part").groupBy(name("p_partkey", 30).alias("name")).agg(F.count("*").alias("count")))


@query("""SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'a/b/h' || doc_id WHEN 1 THEN 'a/h' || doc_id WHEN 2 THEN 'inc2/h' || doc_id ELSE 'inc1/h' || doc_id END AS path, CASE WHEN doc_id % 5 < 2 THEN -1 WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END AS idx FROM documents WHERE doc_id % 5 <> 4""")
def jon_09_resolution(spark, sf_dir):
    """Quoted in the own directory, quoted by two .. from a deeper one, next after the first directory, and angled."""
    v = F.col("doc_id") % 5
    spec = F.when(v == 1, F.concat(F.lit("../.././b/../"), k("h"))).otherwise(k("h"))
    from_dir = F.when(v == 0, "a/b").when(v == 1, "a/b/c").otherwise("z")
    includes = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), from_dir.alias("from_dir"), spec.alias("spec"), (v > 1).alias("angled"), F.when(v == 2, 0).otherwise(-1).alias("found_idx"), (v == 2).alias("next"))
    dirs = spark.createDataFrame([(0, "inc1"), (1, "inc2")], "idx int, dir string")
    made = F.when(v == 0, F.array(F.concat(F.lit("a/b/"), k("h")))).when(v == 1, F.array(F.concat(F.lit("a/"), k("h")))).when(v == 4, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("inc1/"), k("h")), F.concat(F.lit("inc2/"), k("h"))))
    return V.resolve_includes(includes, dirs, docs(spark, sf_dir).select(F.explode(made).alias("path")))


@query("""WITH a AS (SELECT DISTINCT l_partkey % 90 AS t, l_suppkey % 9 AS y FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT DISTINCT l_partkey % 90 AS t, l_suppkey % 9 AS y FROM lineitem WHERE l_orderkey % 3 = 0)
SELECT 'instances' AS "check", coalesce(a.t, b.t) || '|' || coalesce(a.y, b.y) AS key, cast(NULL AS VARCHAR) AS site, CASE WHEN a.t IS NULL THEN 'found but not declared' ELSE 'declared but not found' END AS reason FROM a FULL JOIN b ON a.t = b.t AND a.y = b.y WHERE a.t IS NULL OR b.t IS NULL""")
def jon_10_instances(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 90).alias("t"), (F.col("l_suppkey") % 9).alias("y"))
    made = lambda c: li.where(c).select("t", "y").distinct().withColumn("here", F.lit(True))
    return V.compared(made("l_orderkey % 2 = 0"), made("l_orderkey % 3 = 0"), ["t", "y"], ["here"], "instances")


@query("""SELECT 'compile-db' AS "check", 'u' || doc_id AS key, cast(NULL AS VARCHAR) AS site, CASE WHEN doc_id % 3 = 0 THEN 'no entry' ELSE 'include directories differ' END AS reason FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 1""")
def jon_12_compile_db(spark, sf_dir):
    incs = F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return V.compile_db_mismatches(docs(spark, sf_dir).select(k("u").alias("unit")), docs(spark, sf_dir).where("doc_id % 3 > 0").select(k("u").alias("unit"), incs.alias("incs")), ["a", "b"])


@query("""SELECT 'ref-is-def' AS "check", 'r' || o_orderkey AS key, 'f:' || o_custkey AS site, 'a reference stands on a definition' AS reason FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)""")
def jon_14_refs_on_defs(spark, sf_dir):
    site = lambda c: F.concat(F.lit("f:"), F.col(c).cast("string")).alias("site")
    refs = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), site("o_custkey"))
    return V.refs_on_definitions(refs, table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(site("c_custkey")))


@query(f"""WITH s AS (SELECT doc_id AS dst, {case_sql(quoted(['ctor', 'method', 'template', 'class', 'function']))} AS kind FROM documents WHERE doc_id % 11 <> 0), e AS (SELECT doc_id AS src, doc_id AS dst, {case_sql(quoted(['direct', 'implicit', 'member-ptr', 'instance-of']))} AS sort FROM documents)
SELECT 'kind' AS "check", src || '->' || e.dst AS key, cast(NULL AS VARCHAR) AS site, CASE WHEN kind IS NULL THEN 'target is missing' ELSE 'target is of a wrong kind' END AS reason FROM e LEFT JOIN s ON e.dst = s.dst
WHERE kind IS NULL OR (sort = 'direct' AND kind IN ('class', 'template')) OR (sort = 'implicit' AND kind <> 'ctor') OR (sort = 'member-ptr' AND kind <> 'method') OR (sort = 'instance-of' AND kind <> 'template')""")
def jon_15_kinds(spark, sf_dir):
    key = F.col("doc_id")
    edges = docs(spark, sf_dir).select(key.alias("src"), key.alias("dst"), by_case([F.lit(x) for x in ("direct", "implicit", "member-ptr", "instance-of")]).alias("sort"))
    return V.kind_mismatches(edges, docs(spark, sf_dir).where("doc_id % 11 > 0").select(key.alias("name"), by_case([F.lit(x) for x in ("ctor", "method", "template", "class", "function")]).alias("kind")))


@query("""WITH r AS (SELECT DISTINCT l_orderkey % 20 AS unit, 'n' || (l_partkey % 40) AS name FROM lineitem), n AS (SELECT doc_id AS key, doc_id % 20 AS unit, 'n' || (doc_id % 40) AS name, doc_id % 3 = 0 AS local FROM documents),
  l AS (SELECT r.unit, r.name, key FROM r JOIN n ON n.local AND n.unit = r.unit AND n.name = r.name)
SELECT * FROM l UNION ALL SELECT r.unit, r.name, key FROM r JOIN n ON NOT n.local AND n.name = r.name WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.unit = r.unit AND l.name = r.name)""")
def jon_16_shadowing(spark, sf_dir):
    name = lambda c: F.concat(F.lit("n"), (F.col(c) % 40).cast("string")).alias("name")
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20).alias("unit"), name("l_partkey")).distinct()
    return V.resolve_names(refs, docs(spark, sf_dir).select(F.col("doc_id").alias("key"), (F.col("doc_id") % 20).alias("unit"), name("doc_id"), (F.col("doc_id") % 3 == 0).alias("local")))


@query("""SELECT 'bases' AS "check", 'c' || doc_id AS key, cast(NULL AS VARCHAR) AS site, 'base list differs' AS reason FROM documents WHERE doc_id % 4 = 1""")
def jon_19_bases(spark, sf_dir):
    content = F.concat(F.lit("class "), k("c"), F.lit(" final : public A"), F.lit(", virtual B {"))
    declared = F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("B"), F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    return V.base_mismatches(docs(spark, sf_dir).select(k("c").alias("cls"), content.alias("content")), docs(spark, sf_dir).select(k("c").alias("cls"), declared.alias("declared")))


# ---- graphs ----


HEAP = """e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0 AND doc_id % 7 <> 3)"""


def heap(spark, sf_dir):
    return docs(spark, sf_dir).where("doc_id > 0 AND doc_id % 7 <> 3").select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 2).cast("long").alias("dst"))


@query(f"WITH RECURSIVE {HEAP}, r AS (SELECT doc_id AS node FROM documents WHERE doc_id % 40 = 0 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def grf_09_liveness(spark, sf_dir):
    """What classes with a key divisible by 40 make live over what they hold."""
    return G.reach(heap(spark, sf_dir), docs(spark, sf_dir).where("doc_id % 40 = 0").select(F.col("doc_id").alias("node")))


@query("""SELECT c_custkey AS src FROM customer WHERE c_custkey % 3 = 2""")
def grf_10_virtual_records(spark, sf_dir):
    """Customers are calls on a class A with a subclass B that overrides m; every third record lists one target only."""
    up = G.ancestors(spark, spark.createDataFrame([(2, 1, 0)], "cls long, base long, ord int"))
    methods = spark.createDataFrame([(1, "m", "A::m", False), (2, "m", "B::m", False)], "cls long, name string, symbol string, pure boolean")
    both = F.array(F.lit("B::m"), F.lit("A::m"))
    cha = F.when(F.col("c_custkey") % 3 == 2, F.array(F.lit("A::m"))).otherwise(both)
    return G.virtual_record_violations(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), F.lit("A::m").alias("static"), cha.alias("cha")), up, methods).select("src")


@query("""WITH RECURSIVE u AS (SELECT p_partkey AS tmpl, p_partkey // 2 AS inner_ FROM part), r AS (SELECT p_partkey AS tmpl, p_brand AS type FROM part WHERE p_partkey % 10 = 7 UNION SELECT u.inner_, r.type FROM r JOIN u ON u.tmpl = r.tmpl)
SELECT tmpl, type FROM r""")
def grf_11_instances(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    uses = part.select(F.col("p_partkey").alias("tmpl"), F.floor(F.col("p_partkey") / 2).cast("long").alias("inner"))
    return G.instance_propagation(part.where("p_partkey % 10 = 7").select(F.col("p_partkey").alias("tmpl"), F.col("p_brand").alias("type")), uses)


@query(f"WITH RECURSIVE {HEAP}, r AS (SELECT 3::BIGINT AS node UNION SELECT e.src FROM r JOIN e ON e.dst = r.node) SELECT node FROM r")
def grf_16_backward_flags(spark, sf_dir):
    return G.backward_flags(heap(spark, sf_dir), spark.range(3, 4).toDF("node"))


@query("""WITH RECURSIVE n AS (SELECT 'v' || doc_id AS name, doc_id FROM documents WHERE doc_id % 9 <> 5), e AS (SELECT 'v' || doc_id AS src, 'v' || (doc_id // 3) AS dst FROM documents WHERE doc_id > 0),
  r AS (SELECT name FROM n WHERE doc_id % 50 = 49 UNION SELECT e.dst FROM r JOIN e ON e.src = r.name JOIN n ON n.name = e.dst) SELECT name FROM r""")
def grf_18_wanted(spark, sf_dir):
    names = docs(spark, sf_dir).where("doc_id % 9 <> 5").select("doc_id", k("v").alias("name"))
    inner = F.concat(F.lit("v"), F.floor(F.col("doc_id") / 3).cast("string"))
    none = spark.createDataFrame([], "name string, prefix string, suffix string")
    return G.wanted_names(names.where("doc_id % 50 = 49").select("name"), docs(spark, sf_dir).where("doc_id > 0").select(k("v").alias("name"), inner.alias("inner")), none, names.select("name"))


@query(f"WITH RECURSIVE {HEAP}, r AS (SELECT doc_id AS node FROM documents WHERE doc_id % 13 = 0 AND doc_id % 2 = 1 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node WHERE e.src % 5 <> 0) SELECT node FROM r")
def grf_21_function_reach(spark, sf_dir):
    """Roots by a predicate, over the references of the strict reading only."""
    return G.reach(heap(spark, sf_dir).where("src % 5 <> 0"), docs(spark, sf_dir).where("doc_id % 13 = 0 AND doc_id % 2 = 1").select(F.col("doc_id").alias("node")))


# ---- deltas ----


def symbols(spark, sf_dir):
    """A symbol for each document, defined in one of ten files, with two references."""
    at = lambda m, n: F.concat(F.lit("f"), (F.col("doc_id") % m).cast("string"), F.lit(".c:"), n.cast("string"))
    return docs(spark, sf_dir).select(k("s").alias("name"), at(10, F.col("doc_id") + 1).alias("def"), F.array(at(3, F.col("doc_id") + 5), at(7, F.col("doc_id") + 9)).alias("refs"))


def refs_sql(r1: str = "'f' || (doc_id % 3) || '.c:' || (doc_id + 5)", r2: str = "'f' || (doc_id % 7) || '.c:' || (doc_id + 9)") -> str:
    return f"[{r1}, {r2}]"


@query(f"SELECT 's' || doc_id AS name, 'f' || (doc_id % 10) || '.c:' || (doc_id + 1) AS def, array_to_string([x for x in {refs_sql()} if x NOT LIKE 'f2.c:%'], ',') AS refs FROM documents WHERE doc_id % 10 <> 2")
def dlt_02_remove_file(spark, sf_dir):
    return D.remove_file(symbols(spark, sf_dir), "f2.c").select("name", "def", F.array_join("refs", ",").alias("refs"))


@query("""SELECT 's' || doc_id AS name, 'f' || (doc_id % 10) || '.c:' || (doc_id + 1 + CASE WHEN doc_id % 10 = 2 AND doc_id + 1 >= 100 THEN 4 ELSE 0 END) AS def,
  'f' || (doc_id % 3) || '.c:' || (doc_id + 5 + CASE WHEN doc_id % 3 = 2 AND doc_id + 5 >= 100 THEN 4 ELSE 0 END) || ',f' || (doc_id % 7) || '.c:' || (doc_id + 9 + CASE WHEN doc_id % 7 = 2 AND doc_id + 9 >= 100 THEN 4 ELSE 0 END) AS refs FROM documents""")
def dlt_03_line_shift(spark, sf_dir):
    return D.shift_lines(symbols(spark, sf_dir), "f2.c", 100, 4).select("name", "def", F.array_join("refs", ",").alias("refs"))


@query("SELECT 's' || doc_id AS name, CASE WHEN doc_id = 7 THEN 12345 ELSE n_chars END AS size FROM documents UNION ALL SELECT 'added', 1")
def dlt_04_add_and_resize(spark, sf_dir):
    f = docs(spark, sf_dir).select(k("s").alias("path"), F.col("n_chars").cast("long").alias("size"))
    grown = D.resize(f, "s7", 12345).select(F.col("path").alias("name"), "size")
    return D.add_symbol(grown.withColumn("def", F.lit("")), "added", "f:1").select("name", F.coalesce("size", F.lit(1)).alias("size"))


@query(f"WITH {LINES} SELECT doc_id AS path, count(*) - 1 AS crlf, strlen(string_agg(line, chr(13) || chr(10) ORDER BY n)) AS size FROM line GROUP BY 1 HAVING NOT bool_or(contains(line, chr(13)))")
def dlt_12_eol_flip_sizes(spark, sf_dir):
    every = lines(spark, sf_dir).withColumn("path", F.col("path").cast("long"))
    clean = every.join(docs(spark, sf_dir).where(F.contains("text", F.lit("\r"))).select(F.col("doc_id").alias("path")), "path", "left_anti")
    last = clean.groupBy("path").agg(F.max("n").alias("last"))
    termed = clean.join(last, "path").select("path", "n", "content", F.when(F.col("n") == F.col("last"), "").otherwise("\n").alias("term"))
    text = D.rebuilt(D.eol_flipped(termed))
    return text.select("path", F.regexp_count("text", F.lit("\r\n")).cast("long").alias("crlf"), F.octet_length("text").cast("long").alias("size"))


@query("WITH u AS (SELECT doc_id, unnest(string_split(text, '')) AS x FROM documents WHERE text IS NOT NULL AND text <> '') SELECT doc_id, cast(2 + 2 * sum(CASE WHEN unicode(x) > 65535 THEN 2 ELSE 1 END) AS BIGINT) AS size FROM u WHERE x <> '' GROUP BY 1")
def dlt_13_reencoded(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL AND text <> ''").select("doc_id", F.octet_length(D.utf16le(F.col("text"))).cast("long").alias("size"))


@query("SELECT doc_id AS path, 'metadata' AS reason, sha256(coalesce(text, '')) AS old_sha, n_chars AS old_size FROM documents")
def dlt_15_metadata(spark, sf_dir):
    f = docs(spark, sf_dir).select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.col("n_chars").alias("size"))
    return D.metadata_records(f).where("old_sha = new_sha").select("path", "reason", "old_sha", "old_size")


@query(f"WITH r AS (SELECT doc_id, {case_sql(quoted(D.REASONS.values()))} AS reason FROM documents) SELECT doc_id, reason FROM r WHERE reason = 'metadata' OR doc_id % 3 > 0")
def dlt_16_honest_reasons(spark, sf_dir):
    key = F.col("doc_id")
    recs = docs(spark, sf_dir).select("doc_id", D.reason(by_case([F.lit(x) for x in D.REASONS])).alias("reason"), key.cast("string").alias("old_sha"), F.when(key % 3 == 0, key.cast("string")).otherwise("n").alias("new_sha"))
    return D.honest(recs).select("doc_id", "reason")


@query("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 2 = 1 AND greatest(1, o_custkey // 2) = o_custkey THEN 'replace' ELSE 'insert' END AS op, cast(greatest(1, o_custkey // 2) AS BIGINT) AS old_start FROM orders")
def dlt_19_midpoint_insert(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("lines"), (F.col("o_orderkey") % 2 == 1).alias("ends_open"))
    return D.single_insert(f).select("path", "op", "old_start")


@query("""WITH rn AS (SELECT doc_id AS f, doc_id + 1000000 AS t, 900 AS m FROM documents WHERE doc_id % 4 = 0), sc AS (SELECT doc_id AS f, CASE WHEN doc_id % 12 = 0 THEN doc_id + 2000000 ELSE doc_id + 1000004 END AS a, CASE WHEN doc_id % 8 = 0 THEN 950 ELSE 500 END AS m FROM documents WHERE doc_id % 4 = 0)
SELECT 'decoy' AS kind, a AS key FROM sc WHERE f % 8 = 0 AND f % 12 = 0 UNION SELECT 'rename', sc.f FROM sc JOIN rn ON rn.t = sc.a WHERE sc.m > 880 AND sc.f % 8 = 0 UNION SELECT 'rename', rn.f FROM sc JOIN rn ON rn.t = sc.a WHERE sc.m > 880""")
def dlt_21_margin_filter(spark, sf_dir):
    key = F.col("doc_id")
    some = docs(spark, sf_dir).where("doc_id % 4 = 0")
    renames = some.select(key.alias("from"), (key + 1_000_000).alias("to"), F.lit(900).alias("similarity_milli"))
    scores = some.select(key.alias("from"), F.when(key % 12 == 0, key + 2_000_000).otherwise(key + 1_000_004).alias("added"), F.when(key % 8 == 0, 950).otherwise(500).alias("milli"), (key % 12 == 0).alias("decoy"))
    close, contested = D.margin_filter(renames, scores)
    return close.select(F.lit("decoy").alias("kind"), F.col("added").alias("key")).union(contested.select(F.lit("rename"), "from"))


@query("WITH x AS (SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 3 = 0 AS gone FROM orders) SELECT path, n, cast(n - count_if(gone) OVER (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING) + CASE WHEN gone THEN 1 ELSE 0 END AS BIGINT) AS v1_start FROM x")
def dlt_24_side_coordinates(spark, sf_dir):
    x = numbered(spark, sf_dir).select("path", "n", F.when(F.col("o_orderkey") % 3 == 0, "delete").alias("v1"))
    return D.side_coordinates(x, "v1").select("path", "n", "v1_start")


def numbered(spark, sf_dir):
    """A customer's orders as the lines of a path."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), n.alias("n"), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'insert' WHEN l_suppkey % 2 = 0 THEN 'delete' ELSE 'replace' END AS op FROM lineitem")
def dlt_25_hunk_op(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", D.hunk_op(F.col("l_partkey") % 3, F.col("l_suppkey") % 2).alias("op"))


# ---- round trips of sources and sinks ----


def place(spark, name: str) -> str:
    """A new folder for what a query writes, in the shared folder."""
    return f"{G.shared_folder(spark)}/corpusloom-round-trips/{name}-{uuid.uuid4().hex}"


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'a/' WHEN doc_id % 3 = 1 THEN 'b/c/' ELSE '' END || 'n' || doc_id AS name FROM documents")
def src_12_list(spark, sf_dir):
    """Names written as a gzip list and read again."""
    at = place(spark, "list")
    folder = by_case([F.lit("a/"), F.lit("b/c/"), F.lit("")])
    docs(spark, sf_dir).select(F.concat(folder, k("n")).alias("name")).write.option("compression", "gzip").text(at)
    return R.read_list(spark, at)


@query("SELECT 'n' || doc_id AS name, 'case' || (doc_id % 3) AS \"case\", 'f' || doc_id || ':1' AS site FROM documents")
def src_11_cases(spark, sf_dir):
    at = place(spark, "cases")
    docs(spark, sf_dir).select(k("n").alias("name"), F.concat(F.lit("case"), (F.col("doc_id") % 3).cast("string")).alias("case"), F.concat(k("f"), F.lit(":1")).alias("site")).write.csv(at, sep="\t", header=True)
    return R.read_cases(spark, at)


@query("SELECT doc_id, substr(text, 1, 100) AS text FROM documents WHERE text IS NOT NULL")
def src_02_prefix(spark, sf_dir):
    return R.prefix(docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.col("text").alias("content")), 100).select("doc_id", F.col("content").alias("text"))


@query("SELECT 'd' || (s_suppkey % 5) || '/f' || s_suppkey AS path, 'f' || s_suppkey AS name, strlen(s_name) AS size, sha256(s_name) AS sha FROM supplier")
def src_01_tree(spark, sf_dir):
    """Suppliers as files of a tree, written by tasks and read by the tree reader."""
    at = place(spark, "tree")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), (F.col("s_suppkey") % 5).cast("string"), F.lit("/f"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_name").cast("binary").alias("content"))
    W.write_files(rows, at)
    return R.read_tree(spark, at).select("path", "name", "size", F.sha2("content", 256).alias("sha"))


@query("""WITH f AS (SELECT coalesce(source, '?') AS dir, doc_id FROM documents) SELECT dir, 1::BIGINT AS depth, 0::BIGINT AS child_dirs, count(*) AS child_files FROM f GROUP BY 1 UNION ALL SELECT '', 0, count(DISTINCT dir), 0 FROM f""")
def src_03_directory_stats(spark, sf_dir):
    return P.directories(docs(spark, sf_dir).select(F.concat_ws("/", F.coalesce("source", F.lit("?")), F.col("doc_id").cast("string")).alias("path")))


@query("SELECT 'c' || c_custkey AS name, 'f:' || c_custkey AS def, 'e' || c_nationkey AS edges FROM customer")
def src_04_manifests(spark, sf_dir):
    """Customers as symbols of one manifest for each nation, written as JSON and read again."""
    at = place(spark, "manifests")
    c = table(spark, sf_dir, "customer")
    text = lambda x, p: F.concat(F.lit(p), F.col(x).cast("string"))
    entry = F.struct(text("c_custkey", "f:").alias("def"), F.array(text("c_nationkey", "e")).alias("edges"))
    whole = c.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(text("c_custkey", "c"), entry))).alias("symbols"))
    whole.select(F.to_json(F.struct("symbols")).alias("value")).repartition("value").write.text(at)
    return M.read_manifests(spark, at, whole=False).select("name", "def", F.array_join("edges", ",").alias("edges"))


@query("SELECT 'u' || n_nationkey AS unit, 'inc,d' || n_regionkey AS incs, 'A=1' AS defines FROM nation")
def src_07_compile_db(spark, sf_dir):
    import json

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()  # a compile database is one document
    body = [{"directory": "/", "file": f"u{r.n_nationkey}", "arguments": ["cc", "-I", "inc", f"-Id{r.n_regionkey}", "-DA=1", "-c"]} for r in rows]
    return M.read_compile_db(spark, json.dumps(body)).select("unit", F.array_join("incs", ",").alias("incs"), F.array_join("defines", ",").alias("defines"))


@query("""WITH s AS (SELECT 'f' || doc_id AS name, doc_id AS k FROM documents) SELECT '{"_meta": {"manifestVersion": 1}, "symbols": {' AS line UNION ALL SELECT '}}'
UNION ALL SELECT CASE WHEN name = (SELECT min(name) FROM s) THEN '' ELSE ',' END || '"' || name || '": {"def":"d:' || k || '","refs":["r:' || (k % 7) || '"]' || CASE WHEN k % 5 = 0 THEN ',"kind":"method"' ELSE '' END || '}' FROM s""")
def snk_01_manifest(spark, sf_dir):
    at = place(spark, "manifest")
    key = F.col("doc_id")
    symbols = docs(spark, sf_dir).select(k("f").alias("name"), k("d:").alias("def"), F.array(F.concat(F.lit("r:"), (key % 7).cast("string"))).alias("refs"), F.when(key % 5 == 0, "method").alias("kind"))
    W.write_lines(W.manifest_lines(symbols, {"manifestVersion": 1}), at)
    return spark.read.text(at).withColumnRenamed("value", "line")


@query("""WITH s AS (SELECT 'f' || doc_id AS name, doc_id AS k FROM documents) SELECT '{' AS line UNION ALL SELECT '}'
UNION ALL SELECT CASE WHEN name = (SELECT min(name) FROM s) THEN '' ELSE ',' END || '"' || name || '": ' || CASE WHEN k % 3 = 0 THEN '"TOMBSTONE"' ELSE '{"def":"d:' || k || '","refs":[],"edges":["f' || (k // 2) || '"]' || CASE WHEN k % 2 = 0 THEN ',"removedSites":["a:' || k || '"]' ELSE '' END || '}' END FROM s""")
def snk_03_overlay(spark, sf_dir):
    at = place(spark, "overlay")
    key = F.col("doc_id")
    overlay = docs(spark, sf_dir).select(k("f").alias("name"), F.when(key % 3 == 0, "TOMBSTONE").otherwise("CHANGED").alias("op"), k("d:").alias("def"), F.array().cast("array<string>").alias("refs"), F.array(F.concat(F.lit("f"), F.floor(key / 2).cast("string"))).alias("edges"), F.when(key % 2 == 0, F.array(k("a:"))).alias("removed_sites"))
    W.write_lines(W.overlay_lines(overlay), at)
    return spark.read.text(at).withColumnRenamed("value", "line")


@query("SELECT 'f' || doc_id AS name FROM documents")
def snk_07_list(spark, sf_dir):
    """A truth list, written in parallel in order and read again."""
    at = place(spark, "list")
    W.write_lines(docs(spark, sf_dir).select(k("f").alias("name")), at, ("name",), "name")
    return spark.read.text(at).withColumnRenamed("value", "name")


@query("SELECT o_orderkey AS path, o_orderstatus AS reason FROM orders")
def snk_04_ordered(spark, sf_dir):
    at = place(spark, "diff")
    W.write_ordered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("reason")), at)
    return spark.read.schema("path long, reason string").json(at)


@query("SELECT l_orderkey AS path, cast(l_linenumber AS BIGINT) AS base_start, 1::BIGINT AS base_lines FROM lineitem")
def snk_06_conflicts(spark, sf_dir):
    at = place(spark, "conflicts")
    W.write_conflicts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("base_start"), F.lit(1).cast("long").alias("base_lines")), at)
    return spark.read.schema("path long, base_start long, base_lines long").json(at)


@query(f"""WITH {LINES} SELECT doc_id AS path, coalesce(string_agg(CASE WHEN doc_id % 4 = 0 AND n = 1 THEN NULL ELSE line || chr(10) END, '' ORDER BY n), '') AS text FROM line GROUP BY 1 HAVING count(*) > 1""")
def snk_10_carve(spark, sf_dir):
    """Documents of two lines and more whose first line is a define; those of every fourth document go."""
    every = lines(spark, sf_dir).withColumn("path", F.col("path").cast("long"))
    many = every.groupBy("path").agg(F.count("*").alias("c")).where("c > 1").select("path")
    name = F.concat(F.lit("D"), F.col("path").cast("string"))
    made = every.join(many, "path", "left_semi").withColumn("content", F.when(F.col("n") == 1, F.concat(F.lit("#define "), name)).otherwise(F.col("content"))).withColumn("term", F.lit("\n"))
    carved = W.carve(made, docs(spark, sf_dir).where("doc_id % 4 = 0").select(k("D").alias("name")))
    back = lines(spark, sf_dir).withColumn("path", F.col("path").cast("long")).where("n = 1").select("path", F.col("content").alias("first"))
    return carved.join(back, "path").select("path", F.when(F.col("path") % 4 == 0, F.col("text")).otherwise(F.concat("first", F.expr("substring(text, instr(text, '\n'))"))).alias("text"))


# ---- order, sets, windows ----


@query("SELECT source || '/' || doc_id AS path, cast(row_number() OVER (ORDER BY encode(source || '/' || doc_id)) AS BIGINT) AS rank FROM documents WHERE source IS NOT NULL")
def srt_01_ordinal_paths(spark, sf_dir):
    """Ranks in ordinal order of paths with either slash, by shards of one row."""
    rows = docs(spark, sf_dir).where("source IS NOT NULL").select(S.normal_path(F.concat_ws("\\", "source", F.col("doc_id").cast("string"))).alias("path"))
    return D.shards(rows, "path", 1).select("path", (F.col("shard") + 1).alias("rank"))


@query("""WITH v AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0), t AS (SELECT 'x: ' || doc_id || '  r' AS line FROM v ORDER BY cast(doc_id AS VARCHAR) LIMIT 20) SELECT line FROM t UNION ALL SELECT '... and ' || (count(*) - 20) || ' more' FROM v HAVING count(*) > 20""")
def srt_06_report(spark, sf_dir):
    found = V.violation(docs(spark, sf_dir).where("doc_id % 3 = 0"), "x", "doc_id", "r")
    return spark.createDataFrame([(x,) for x in V.report(found)], "line string")


@query("SELECT l_partkey AS key FROM lineitem WHERE l_orderkey % 2 = 0 UNION SELECT p_partkey FROM part WHERE p_partkey % 5 = 0")
def set_01_union(spark, sf_dir):
    """Roots of the strict reading go into those of the wide one."""
    edges = spark.createDataFrame([], "src long, dst long")
    strict = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_partkey").cast("long").alias("node"))
    return G.reach(edges, strict.union(table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").cast("long")))).select(F.col("node").alias("key"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def set_02_except(spark, sf_dir):
    others = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return V.only_here(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), others, "c_custkey")


@query("SELECT doc_id, doc_id % 4 <> 1 AS same FROM documents")
def set_03_equality(spark, sf_dir):
    key = F.col("doc_id")
    return docs(spark, sf_dir).select("doc_id", V.same_set(F.array(key, key + 1, key), F.array(key + F.when(key % 4 == 1, 2).otherwise(1), key)).alias("same"))


@query("""SELECT 'repeated' AS "check", cast(doc_id AS VARCHAR) AS key, cast(NULL AS VARCHAR) AS site, 'list holds an item twice' AS reason FROM documents WHERE doc_id % 6 = 2""")
def set_04_repeated(spark, sf_dir):
    key = F.col("doc_id")
    return V.repeated_items(docs(spark, sf_dir).select("doc_id", F.array(key, key + 1, F.when(key % 6 == 2, key).otherwise(key + 2)).alias("items")), "doc_id", "items")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def set_05_first_occurrence(spark, sf_dir):
    return V.first_occurrences(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_orderkey", "o_custkey")


@query("SELECT o_custkey AS path, o_orderkey, cast(sum(o_orderkey % 7) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM orders")
def win_01_running_sum(spark, sf_dir):
    return numbered(spark, sf_dir).select("path", "o_orderkey", F.sum(F.col("o_orderkey") % 7).over(D.so_far()).cast("long").alias("upto"))


@query("WITH l AS (SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey FROM orders), x AS (SELECT path, n, n - row_number() OVER (PARTITION BY path ORDER BY n) AS g FROM l WHERE o_orderkey % 3 > 0) SELECT path, min(n) AS start, count(*) AS lines FROM x GROUP BY path, g")
def win_02_islands(spark, sf_dir):
    return D.runs(numbered(spark, sf_dir).where("o_orderkey % 3 > 0").select("path", "n"))


@query("WITH r AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_name) - 1) // 37 AS page FROM customer) SELECT c_custkey, page FROM r")
def win_03_pages(spark, sf_dir):
    return D.shards(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", 37).select("c_custkey", F.col("shard").alias("page"))
