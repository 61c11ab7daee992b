"""Integrity checks, digests and deltas over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import delta as D
from ..operators import digest as G
from ..operators import verify as V
from .profile_queries import LINES
from .registry import query, table

U, R, GS = "chr(31)", "chr(30)", "chr(29)"


def sections_sql(*parts: tuple[str, str]) -> str:
    """SHA of sections, each (record expression, relation); a record stands once."""
    one = [f"(SELECT coalesce(string_agg(rec || {R}, '' ORDER BY encode(rec)), '') FROM (SELECT DISTINCT {rec} AS rec FROM {source}))" for rec, source in parts]
    return f"SELECT sha256({f' || {GS} || '.join(one)}) AS sha"


def fields(*names: str) -> str:
    return f" || {U} || ".join(f"cast({n} AS VARCHAR)" for n in names)


# ---- symbols over doc_id: an edge from (i-1) // 3 to i; every seventh node is no symbol ----


def edges(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id > 0").select(F.floor((F.col("doc_id") - 1) / 3).cast("long").alias("src"), F.col("doc_id").alias("dst"))


@query("SELECT (doc_id - 1) // 3 AS src, doc_id AS dst FROM documents WHERE doc_id > 0 AND doc_id % 7 = 0")
def jon_02_dangling_edges(spark, sf_dir):
    symbols = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("name"))
    return V.dangling_edges(edges(spark, sf_dir), symbols)


@query("SELECT 'roots' AS \"check\", cast(c_custkey AS VARCHAR) AS key, cast(NULL AS VARCHAR) AS site, 'root is not a symbol' AS reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jon_01_undeclared_roots(spark, sf_dir):
    roots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"))
    return V.undeclared_roots(roots, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name")).distinct())


@query("""WITH e AS (SELECT doc_id AS source, doc_id * 3 AS target, doc_id % 2 = 0 AS resolved FROM documents)
SELECT 'indirect' AS "check", source || '->' || target AS key, cast(NULL AS VARCHAR) AS site, CASE WHEN resolved THEN 'resolved target is missing' ELSE 'unresolved target is a symbol' END AS reason
FROM e WHERE resolved <> (target IN (SELECT doc_id FROM documents))""")
def jon_03_indirect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    e = docs.select(F.col("doc_id").alias("source"), (F.col("doc_id") * 3).alias("target"), (F.col("doc_id") % 2 == 0).alias("resolved"))
    return V.indirect_mismatches(e, docs.select(F.col("doc_id").alias("name")))


def lines(spark, sf_dir):
    """(path, n, content) with the document as path."""
    return T.lines_lf(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "text", "doc_id").select(F.col("doc_id").cast("string").alias("path"), F.col("n").cast("long").alias("n"), F.col("line").alias("content"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, doc_id % 12 + 1 AS n, CASE WHEN doc_id % 2 = 0 THEN 'the' ELSE 'de' END AS name FROM documents),
  j AS (SELECT s.doc_id, s.n, name, line.line FROM s LEFT JOIN line ON s.doc_id = line.doc_id AND s.n = line.n)
SELECT 'site' AS "check", name AS key, doc_id || ':' || n AS site, CASE WHEN line IS NULL THEN 'no such line' ELSE 'line does not hold the name' END AS reason
FROM j WHERE line IS NULL OR NOT regexp_matches(line, '(^|[^A-Za-z0-9_])' || name || '($|[^A-Za-z0-9_])')""")
def jon_04_sites(spark, sf_dir):
    sites = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, "the").otherwise("de").alias("name"), F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("doc_id") % 12 + 1).cast("string")).alias("site"))
    return V.site_mismatches(sites, lines(spark, sf_dir))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 10 <> 0),
  b AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 13 = 0 THEN 'changed' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 11 <> 0)
SELECT 'closure' AS "check", cast(coalesce(a.k, b.k) AS VARCHAR) AS key, cast(NULL AS VARCHAR) AS site,
  CASE WHEN a.k IS NULL THEN 'found but not declared' WHEN b.k IS NULL THEN 'declared but not found' ELSE 'differs in p' END AS reason
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.p <> b.p""")
def jon_11_compared(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    found = o.where("k % 11 <> 0").withColumn("p", F.when(F.col("k") % 13 == 0, "changed").otherwise(F.col("p")))
    return V.compared(o.where("k % 10 <> 0"), found, ["k"], ["s", "p"], "closure")


@query(f"""WITH {LINES} SELECT 'completeness' AS "check", doc_id || ':' || n AS key, cast(NULL AS VARCHAR) AS site, 'definition is no symbol''s' AS reason
FROM line WHERE regexp_matches(line, '^The ') AND n % 2 = 1""")
def jon_13_completeness(spark, sf_dir):
    every = lines(spark, sf_dir)
    return V.undeclared_definitions(every, every.where("n % 2 = 0").select("path", "n"), "^The ")


# ---- similarity ----


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
  bag AS (SELECT doc_id, line, count(*) AS c FROM l WHERE line <> '' GROUP BY 1, 2), sz AS (SELECT doc_id, sum(c) AS n FROM bag GROUP BY 1)
SELECT x.doc_id AS a, y.doc_id AS b, cast(sum(least(x.c, y.c)) AS BIGINT) AS common, cast((1000 * sum(least(x.c, y.c)) + greatest(any_value(p.n), any_value(q.n)) // 2) // greatest(any_value(p.n), any_value(q.n)) AS BIGINT) AS milli
FROM bag x JOIN bag y USING (line) JOIN sz p ON p.doc_id = x.doc_id JOIN sz q ON q.doc_id = y.doc_id WHERE x.doc_id % 20 = 0 AND x.doc_id <> y.doc_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def sim_01_line_similarity(spark, sf_dir):
    """A search: each document whose id is divisible by 20 against all others that share two lines or more with it."""
    every = lines(spark, sf_dir).where("content <> ''").select(F.col("path").cast("long").alias("key"), F.col("content").alias("line"))
    return D.searched(every, F.col("key") % 20 == 0, 2)


@query("""WITH d AS (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1, 2),
  i AS (SELECT item_id, line, count(*) AS c FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) GROUP BY 1, 2),
  n AS (SELECT doc_id, sum(c) AS n FROM d GROUP BY 1), m AS (SELECT item_id, sum(c) AS n FROM i GROUP BY 1),
  wanted AS (SELECT DISTINCT item_id, doc_id FROM i JOIN d USING (line) WHERE length(line) > 20)
SELECT item_id AS a, doc_id AS b, cast(sum(least(i.c, d.c)) AS BIGINT) AS common, cast((1000 * sum(least(i.c, d.c)) + greatest(any_value(n.n), any_value(m.n)) // 2) // greatest(any_value(n.n), any_value(m.n)) AS BIGINT) AS milli
FROM wanted JOIN i USING (item_id) JOIN d USING (doc_id, line) JOIN n USING (doc_id) JOIN m USING (item_id) GROUP BY 1, 2""")
def jon_18_margin(spark, sf_dir):
    """Benchmark items against documents that share a line of more than 20 characters: the pairs wanted."""
    items = T.lines_lf(table(spark, sf_dir, "benchmark"), "text", "item_id").select(F.col("item_id").alias("path"), F.col("line").alias("content"))
    mine, all_ = D.line_bags(items), D.line_bags(lines(spark, sf_dir).withColumn("path", F.col("path").cast("long")))
    long = lambda x, name: x.where(F.length("line") > 20).select(F.col("key").alias(name), "line")
    return D.similarities(mine, all_, long(mine, "a").join(long(all_, "b"), "line").select("a", "b").distinct())


# ---- digests ----


@query(f"""WITH s AS (SELECT 'func_' || doc_id AS name, 'src/' || doc_id || '.c:' || (doc_id % 9 + 1) AS def, 'func_' || ((doc_id - 1) // 3) AS edge, doc_id % 13 = 0 AS miss, doc_id FROM documents)
SELECT sha256(coalesce(string_agg(name || {U} || def || {U} || (def || ',' || def) || {U} || CASE WHEN doc_id > 0 THEN edge ELSE '' END || {U} || CASE WHEN miss THEN '1' ELSE '0' END || {R}, '' ORDER BY encode(name)), '')) AS sha FROM s""")
def dig_01_truth(spark, sf_dir):
    k = F.col("doc_id")
    site = F.concat(F.lit("src/"), k.cast("string"), F.lit(".c:"), (k % 9 + 1).cast("string"))
    edge = F.when(k > 0, F.array(F.concat(F.lit("func_"), F.floor((k - 1) / 3).cast("string")))).otherwise(F.array().cast("array<string>"))
    symbols = table(spark, sf_dir, "documents").select(F.concat(F.lit("func_"), k.cast("string")).alias("name"), site.alias("def"), F.array(site, site).alias("refs"), edge.alias("edges"), (k % 13 == 0).alias("expected_miss"))
    return G.truth_sha(symbols)


@query("WITH e AS (SELECT p_partkey AS s, p_size AS t, p_brand AS v, p_size % 2 = 0 AS d, p_size % 3 = 0 AS r FROM part), q AS (SELECT r_name FROM region) " + sections_sql((f"{fields('s', 't', 'v')} || {U} || CASE WHEN d THEN '1' ELSE '0' END || {U} || CASE WHEN r THEN '1' ELSE '0' END", "e"), ("r_name", "q")))
def dig_02_indirect(spark, sf_dir):
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.col("p_size").alias("target"), F.col("p_brand").alias("via"), (F.col("p_size") % 2 == 0).alias("dispatched"), (F.col("p_size") % 3 == 0).alias("resolved"))
    return G.indirect_sha(e, table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@query("WITH v AS (SELECT n_name, n_regionkey FROM nation), m AS (SELECT s_name, s_nationkey FROM supplier), e AS (SELECT 1 WHERE false) " + sections_sql((fields("n_name", "n_regionkey", "n_regionkey + 1 || ',' || (n_regionkey + 2)", "''"), "v"), (fields("s_name", "s_nationkey"), "m"), (f"{fields('s_name', 's_nationkey', "'arg'")} || {U} || '1'", "m"), (f"{fields('n_name', "'class'")} || {U}", "v"), ("''", "e")))
def dig_03_cpp(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = lambda d: (F.col("n_regionkey") + d).cast("string")
    virtual = n.select(F.col("n_name").alias("source"), key(0).alias("static"), F.array(key(2), key(1), key(2)).alias("cha"), F.array().cast("array<string>").alias("rta"))
    m = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), F.col("s_nationkey").alias("target"))
    kinds = n.select(F.col("n_name").alias("name"), F.lit("class").alias("kind"), F.lit(None).cast("string").alias("instance_of"))
    return G.cpp_sha(virtual, m, m.withColumn("via", F.lit("arg")).withColumn("dispatched", F.lit(True)), kinds, n.limit(0).select(F.col("n_name").alias("name")))


@query("WITH f AS (SELECT * FROM orders WHERE o_orderkey % 3 = 0), h AS (SELECT * FROM orders WHERE o_orderkey % 3 = 1), r AS (SELECT * FROM orders WHERE o_orderkey % 3 = 2) " + sections_sql((fields("o_orderkey", "'content'", "o_orderstatus", "'n'", "o_custkey", "o_custkey + 1"), "f"), (fields("o_orderkey", "'replace'", "o_custkey", "1", "o_custkey", "1"), "h"), (fields("o_orderkey", "'replace'", "20", "1", "5000", "1"), "r"), (fields("o_orderkey", "o_orderkey + 1", "900"), "r")))
def dig_04_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), "o_orderstatus", "o_custkey")
    f, h, r = (o.where(f"path % 3 = {k}") for k in range(3))  # every order is in one kind of section
    c = F.col("o_custkey")
    recs = f.select("path", F.lit("content").alias("reason"), F.col("o_orderstatus").alias("old_sha"), F.lit("n").alias("new_sha"), c.alias("old_size"), (c + 1).alias("new_size"))
    hunks = h.select("path", F.lit("replace").alias("op"), c.alias("old_start"), F.lit(1).alias("old_lines"), c.alias("new_start"), F.lit(1).alias("new_lines"))
    rules = r.select("path", F.lit("replace").alias("op"), F.lit(20).alias("stride"), F.lit(1).alias("range_start"), F.lit(5000).alias("range_end"), F.lit(1).alias("per_hunk"))
    return G.diff_sha(recs, hunks, rules, r.select(F.col("path").alias("from"), (F.col("path") + 1).alias("to"), F.lit(900).alias("similarity_milli")))


@query("WITH c AS (SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0), m AS (SELECT conv_id, turn FROM conversations WHERE turn % 2 = 1) " + sections_sql((fields("conv_id", "turn", "1", "'replace'", "turn", "1", "'delete'", "turn", "0"), "c"), (fields("conv_id", "'v1'", "'insert'", "turn", "0", "turn", "2"), "m")))
def dig_05_conflict(spark, sf_dir):
    v = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), "turn")
    one, t = F.lit(1), F.col("turn")
    c = v.where("turn % 2 = 0").select("path", t.alias("base_start"), one.alias("base_lines"), F.lit("replace").alias("v1_op"), t.alias("v1_new_start"), one.alias("v1_new_lines"), F.lit("delete").alias("v2_op"), t.alias("v2_new_start"), F.lit(0).alias("v2_new_lines"))
    m = v.where("turn % 2 = 1").select("path", F.lit("v1").alias("side"), F.lit("insert").alias("op"), t.alias("old_start"), F.lit(0).alias("old_lines"), t.alias("new_start"), F.lit(2).alias("new_lines"))
    return G.conflict_sha(c, m)


@query("SELECT sha256(coalesce(string_agg(c_name || chr(10), '' ORDER BY encode(c_name)), '')) AS sha, count(*) AS n FROM customer")
def dig_07_list(spark, sf_dir):
    return G.list_sha_row(table(spark, sf_dir, "customer"), "c_name")


# ---- overlays ----


@query("""WITH b AS (SELECT o_orderkey AS name, o_orderstatus AS def FROM orders WHERE o_orderkey % 5 <> 0), a AS (SELECT o_orderkey AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS def FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'TOMBSTONE' ELSE 'changed' END AS op, a.def AS def FROM b FULL JOIN a ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.def <> b.def""")
def dlt_05_symbol_diff(spark, sf_dir):
    b, a = states(spark, sf_dir)
    return D.symbol_diff(b, a).select("name", "op", "def")


def states(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    row = lambda d: (F.col("o_orderkey").alias("name"), d.alias("def"), F.array(F.col("o_orderpriority")).alias("refs"), F.array(F.col("o_custkey").cast("string")).alias("edges"))
    before = o.where("o_orderkey % 5 <> 0").select(*row(F.col("o_orderstatus")))
    after = o.where("o_orderkey % 7 <> 0").select(*row(F.when(F.col("o_orderkey") % 4 == 0, "new").otherwise(F.col("o_orderstatus"))))
    return before, after


@query("SELECT o_orderkey AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS def FROM orders WHERE o_orderkey % 7 <> 0")
def dlt_06_overlay(spark, sf_dir):
    b, a = states(spark, sf_dir)
    return D.compose(b, D.symbol_diff(b, a)).select("name", "def")


# ---- line edits ----

PICKED = f"{LINES}, sel AS (SELECT doc_id AS path, cast(n AS BIGINT) AS n, line, (doc_id * 31 + n) % 20 < 2 OR (doc_id * 31 + n) % 7 = 0 AS sel FROM line)"
ISLANDS = "run AS (SELECT path, n, n - row_number() OVER (PARTITION BY path ORDER BY n) AS g, before FROM x WHERE sel)"


def picked(spark, sf_dir):
    at = F.col("path").cast("long") * 31 + F.col("n")
    return lines(spark, sf_dir).withColumn("path", F.col("path").cast("long")).withColumn("sel", (at % 20 < 2) | (at % 7 == 0))


@query(f"WITH {PICKED}, x AS (SELECT *, 0 AS before FROM sel), {ISLANDS} SELECT path, min(n) AS old_start, count(*) AS old_lines FROM run GROUP BY path, g")
def dlt_08_hunks(spark, sf_dir):
    return D.replace_hunks(picked(spark, sf_dir)).select("path", "old_start", "old_lines")


@query(f"WITH {PICKED}, x AS (SELECT *, sum(CASE WHEN sel THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING) - 1 AS before FROM sel) SELECT path, 'insert' AS op, n - 1 AS old_start, 0::BIGINT AS old_lines, cast(n + 2 * before AS BIGINT) AS new_start, 2::BIGINT AS new_lines FROM x WHERE sel")
def dlt_10_insert_coords(spark, sf_dir):
    return D.insert_hunks(picked(spark, sf_dir))


@query(f"WITH {PICKED}, x AS (SELECT *, sum(CASE WHEN sel THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING) AS before FROM sel), {ISLANDS} SELECT path, 'delete' AS op, min(n) AS old_start, count(*) AS old_lines, cast(min(before) + 1 AS BIGINT) AS new_start, 0::BIGINT AS new_lines FROM run GROUP BY path, g")
def dlt_11_delete_coords(spark, sf_dir):
    return D.delete_hunks(picked(spark, sf_dir))


@query(f"WITH {LINES} SELECT doc_id AS path, sha256(string_agg(CASE WHEN (doc_id + n) % 5 = 0 THEN line || ' /*mut:' || n || '*/' ELSE line END, chr(10) ORDER BY n)) AS sha FROM line GROUP BY 1")
def dlt_09_marked(spark, sf_dir):
    every = lines(spark, sf_dir).withColumn("path", F.col("path").cast("long"))
    last = every.groupBy("path").agg(F.max("n").alias("last"))
    termed = every.join(last, "path").select("path", "n", "content", F.when(F.col("n") == F.col("last"), "").otherwise("\n").alias("term"), ((F.col("path") + F.col("n")) % 5 == 0).alias("sel"))
    edited = D.marked(termed, F.concat(F.lit(" /*mut:"), F.col("n").cast("string"), F.lit("*/")))
    return D.rebuilt(edited).select("path", F.sha2("text", 256).alias("sha"))


@query("WITH f AS (SELECT doc_id AS path, cast(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents WHERE text IS NOT NULL) SELECT path, unnest(range(1, lines + 1, 3)) AS line FROM f")
def dlt_18_run_expand(spark, sf_dir):
    f = lines(spark, sf_dir).groupBy(F.col("path").cast("long").alias("path")).agg(F.count("*").alias("lines"))
    return D.expand_runs(D.run_rule(f, 3))


@query(f"""WITH {LINES}, x AS (SELECT doc_id AS path, cast(n AS BIGINT) AS n, line, doc_id % 3 + n AS k FROM line),
  e AS (SELECT path, n, line, k % 5 = 0 OR k % 11 = 0 AS a1, k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 AS a2, k % 13 = 0 AS gone, CASE WHEN k % 11 = 0 THEN line || '!' WHEN k % 5 = 0 THEN line || '1' ELSE line END AS t1, CASE WHEN k % 11 = 0 AND k % 13 <> 0 THEN line || '!' WHEN k % 7 = 0 THEN line || '2' ELSE line END AS t2 FROM x),
  o AS (SELECT *, CASE WHEN gone THEN 0 ELSE 1 END AS l2, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING) AS u2 FROM e),
  g AS (SELECT *, n - row_number() OVER (PARTITION BY path ORDER BY n) AS g FROM o WHERE a1 OR a2),
  r AS (SELECT path, min(n) AS base_start, count(*) AS base_lines, bool_or(a1) AS a1, bool_or(a2) AS a2, cast(sum(l2) AS BIGINT) AS n2, cast(min(u2 - l2 + 1) AS BIGINT) AS s2,
    coalesce(string_agg(t1, chr(10) ORDER BY n), '') AS x1, coalesce(string_agg(t2, chr(10) ORDER BY n) FILTER (l2 > 0), '') AS x2 FROM g GROUP BY path, g)
SELECT path, CASE WHEN a1 AND a2 AND NOT (x1 = x2 AND n2 = base_lines) THEN 'conflict' ELSE 'clean' END AS kind,
  CASE WHEN a1 AND a2 AND NOT (x1 = x2 AND n2 = base_lines) THEN NULL WHEN a1 THEN 'v1' ELSE 'v2' END AS side, base_start, base_lines,
  'replace' AS v1_op, base_start AS v1_new_start, base_lines AS v1_new_lines, CASE WHEN n2 = 0 THEN 'delete' ELSE 'replace' END AS v2_op, s2 AS v2_new_start, n2 AS v2_new_lines FROM r""")
def dlt_23_three_way(spark, sf_dir):
    x = lines(spark, sf_dir).withColumn("path", F.col("path").cast("long"))
    k, c = F.col("path") % 3 + F.col("n"), F.col("content")
    both, one, two, gone = k % 11 == 0, k % 5 == 0, k % 7 == 0, k % 13 == 0
    edited = x.select(
        "*",
        F.when(both | one, "replace").alias("v1"),
        F.when(both, F.concat(c, F.lit("!"))).when(one, F.concat(c, F.lit("1"))).otherwise(c).alias("v1_text"),
        F.when(gone, "delete").when(both | two, "replace").alias("v2"),
        F.when(gone, F.lit(None)).when(both, F.concat(c, F.lit("!"))).when(two, F.concat(c, F.lit("2"))).otherwise(c).alias("v2_text"),
    )
    return D.three_way(edited)


@query("""WITH r AS (SELECT source || '/' || doc_id AS path, (row_number() OVER (ORDER BY encode(source || '/' || doc_id)) - 1) // 100 AS shard FROM documents)
SELECT shard, arg_min(path, encode(path)) AS first, arg_max(path, encode(path)) AS last, count(*) AS n FROM r GROUP BY 1""")
def snk_05_shards(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return D.shard_index(D.shards(rows, "path", 100), "path")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R')
SELECT cast((SELECT sum(greatest(l_linenumber, l_quantity)) FROM h) + (SELECT sum((o_custkey + 50 - 1) // 7 + 1) FROM orders) AS BIGINT) AS touched""")
def agg_20_touched(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_linenumber").cast("long").alias("old_lines"), F.col("l_quantity").cast("long").alias("new_lines"))
    rules = table(spark, sf_dir, "orders").select(F.lit(1).cast("long").alias("range_start"), (F.col("o_custkey") + 50).alias("range_end"), F.lit(7).cast("long").alias("stride"))
    return D.touched_lines(h, rules)


#: Draws of joint edits: three in ten lines of a side, half of the second side's shared.
JOINT = f"""{LINES}, draw AS (SELECT doc_id AS path, n, line, n % 2 = 1 AS odd, {", ".join(f"('0x' || left(md5('9:{t}:' || doc_id || ':' || n), 8))::BIGINT % 10000 AS {t}" for t in ("v1", "v2", "share"))} FROM line),
  joint AS (SELECT path, n, line, odd AND v2 < 3000 AS two, odd AND CASE WHEN v2 < 3000 THEN share < 5000 ELSE v1 < 3000 END AS one FROM draw)"""


@query(f"""WITH {JOINT} SELECT path, count_if(one) AS v1, count_if(two) AS v2, count_if(one AND two) AS shared,
  sha256(string_agg(line || CASE WHEN one THEN ' /*v1:' || n || '*/' ELSE '' END, chr(10) ORDER BY n)) AS v1_sha, sha256(string_agg(line || CASE WHEN two THEN ' /*v2:' || n || '*/' ELSE '' END, chr(10) ORDER BY n)) AS v2_sha FROM joint GROUP BY 1""")
def dlt_22_joint_edits(spark, sf_dir):
    """Both sides' texts of joint edits on odd lines."""
    edited = D.joint_edits(lines(spark, sf_dir).withColumn("path", F.col("path").cast("long")), 0.3, 0.5, 9)
    side = lambda s: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(f"{s}_text").alias("t")))), lambda x: x["t"]), "\n"), 256).alias(f"{s}_sha")
    one, two = F.col("v1").isNotNull(), F.col("v2").isNotNull()
    return edited.groupBy("path").agg(F.count_if(one).alias("v1"), F.count_if(two).alias("v2"), F.count_if(one & two).alias("shared"), side("v1"), side("v2"))


@query(f"""WITH {JOINT}, x AS (SELECT path, n, one, two, n - row_number() OVER (PARTITION BY path ORDER BY n) AS g FROM joint WHERE one OR two)
SELECT path, CASE WHEN one AND two THEN 'conflict' ELSE 'clean' END AS kind, CASE WHEN one AND two THEN NULL WHEN one THEN 'v1' ELSE 'v2' END AS side, cast(n AS BIGINT) AS base_start FROM x""")
def dlt_22_joint_regions(spark, sf_dir):
    """Regions of joint edits: no two touch, since even lines stay; shared lines are marked differently and conflict."""
    edited = D.joint_edits(lines(spark, sf_dir).withColumn("path", F.col("path").cast("long")), 0.3, 0.5, 9)
    return D.three_way(edited).select("path", "kind", "side", "base_start")


@query("""SELECT doc_id, sha256(coalesce(array_to_string([x for x in string_split(replace(replace(coalesce(text, ''), chr(13), ''), lang, ''), chr(10)) if NOT contains(x, source)], chr(10)), '')) AS sha FROM documents WHERE lang <> '' AND source IS NOT NULL""")
def dig_08_manifest_identity(spark, sf_dir):
    """Documents as manifests, their language as the root to blank, their source as the leaf."""
    d = table(spark, sf_dir, "documents").where("lang <> '' AND source IS NOT NULL")
    return d.select("doc_id", G.manifest_identity(F.coalesce("text", F.lit("")), F.col("lang"), F.col("source")).alias("sha"))


@query(f"""WITH {LINES} SELECT doc_id AS path, cast(n AS BIGINT) AS n FROM line WHERE ('0x' || left(md5('4:line:' || doc_id || ':' || n), 8))::BIGINT % 10000 < 123""")
def dlt_07_selected_lines(spark, sf_dir):
    """Lines that an edit of density 0.0123 takes."""
    chosen = D.selected(lines(spark, sf_dir), 0.01230004, 4).where("sel")
    return chosen.select(F.col("path").cast("long").alias("path"), "n")
