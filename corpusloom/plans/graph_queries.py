"""Graph queries: an F-ary call tree with dead chains over doc_id, a class forest, two reference runs, three builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import verify as V
from .registry import query, table

#: Every fifth node is dead: it hangs on a chain that the root does not reach.
TREE = """edges AS (SELECT (doc_id - 1) // 3 AS src, doc_id AS dst FROM documents WHERE doc_id > 0 AND doc_id % 5 <> 4),
  reached AS (SELECT 0::BIGINT AS node UNION SELECT e.dst FROM reached r JOIN edges e ON e.src = r.node)"""


def tree(spark, sf_dir):
    """(src, dst) of the call tree."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("dst"))
    return ids.where((F.col("dst") > 0) & (F.col("dst") % 5 != 4)).select(F.floor((F.col("dst") - 1) / 3).cast("long").alias("src"), "dst")


def root(spark):
    return spark.range(1).select(F.col("id").alias("node"))


@query(f"WITH RECURSIVE {TREE} SELECT (SELECT count(*) FROM reached) AS reachable, (SELECT count(*) FROM documents) AS total")
def grf_01_reach_direct(spark, sf_dir):
    reached = G.reach(tree(spark, sf_dir), root(spark)).agg(F.count("*").alias("reachable"))
    return reached.crossJoin(table(spark, sf_dir, "documents").agg(F.count("*").alias("total")))


@query(f"WITH RECURSIVE {TREE} SELECT node FROM reached")
def grf_01_reach_recursive(spark, sf_dir):
    tree(spark, sf_dir).createOrReplaceTempView("corpusloom_tree")
    root(spark).createOrReplaceTempView("corpusloom_root")
    return G.reach_acyclic(spark, "corpusloom_tree", "corpusloom_root")


@query("""WITH RECURSIVE direct AS (SELECT (doc_id - 1) // 3 AS src, doc_id AS dst FROM documents WHERE doc_id > 0 AND doc_id % 5 <> 4),
  indirect AS (SELECT doc_id AS src, doc_id + 4 AS dst, doc_id % 2 = 0 AS live FROM documents WHERE doc_id % 11 = 0),
  modes AS (SELECT 'direct' AS mode, src, dst FROM direct UNION ALL SELECT 'sound', src, dst FROM direct UNION ALL SELECT 'sound', src, dst FROM indirect
    UNION ALL SELECT 'precise', src, dst FROM direct UNION ALL SELECT 'precise', src, dst FROM indirect WHERE live),
  r AS (SELECT mode, 0::BIGINT AS node FROM (VALUES ('direct'), ('sound'), ('precise')) v(mode) UNION SELECT r.mode, m.dst FROM r JOIN modes m ON m.mode = r.mode AND m.src = r.node)
SELECT mode, count(*) AS n FROM r GROUP BY 1""")
def grf_03_reach_modes(spark, sf_dir):
    direct = tree(spark, sf_dir)
    pointers = table(spark, sf_dir, "documents").where("doc_id % 11 = 0").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 4).alias("dst"), (F.col("doc_id") % 2 == 0).alias("dispatched"))
    none = direct.limit(0)
    virtual = none.select("src", F.array("dst").alias("cha"), F.array("dst").alias("rta"))
    out = None
    for mode in ("direct", "sound", "precise"):
        found = G.reach(G.mode_edges(direct, none, virtual, pointers, mode), root(spark)).agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = found if out is None else out.unionByName(found)
    return out


#: A class forest over nations: class k derives from k // 2, and from k // 3 besides where k is a multiple of 6.
FOREST = """bases AS (SELECT n_nationkey::BIGINT AS cls, n_nationkey::BIGINT // 2 AS base, 0 AS ord FROM nation WHERE n_nationkey > 0
    UNION ALL SELECT n_nationkey, n_nationkey::BIGINT // 3, 1 FROM nation WHERE n_nationkey > 0 AND n_nationkey % 6 = 0),
  up AS (SELECT n_nationkey::BIGINT AS cls, n_nationkey::BIGINT AS anc, '' AS path FROM nation
    UNION ALL SELECT u.cls, b.base, u.path || b.ord FROM up u JOIN bases b ON b.cls = u.anc),
  methods AS (SELECT n_nationkey::BIGINT AS cls, 'm' || (n_nationkey % 3) AS name, 'c' || n_nationkey || '::m' || (n_nationkey % 3) AS symbol, n_nationkey % 4 = 1 AS pure FROM nation),
  resolved AS (SELECT cls, name, arg_min(symbol, path) AS symbol, arg_min(pure, path) AS pure FROM up JOIN methods m ON m.cls = up.anc GROUP BY 1, 2)""".replace("SELECT cls, name, arg_min", "SELECT up.cls, name, arg_min")


def forest(spark, sf_dir):
    """bases (cls, base, ord) and methods (cls, name, symbol, pure)."""
    k = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("cls"))
    up = k.where("cls > 0")
    bases = up.select("cls", F.floor(F.col("cls") / 2).cast("long").alias("base"), F.lit(0).alias("ord")).unionByName(up.where("cls % 6 = 0").select("cls", F.floor(F.col("cls") / 3).cast("long").alias("base"), F.lit(1).alias("ord")))
    name = F.concat(F.lit("m"), (F.col("cls") % 3).cast("string"))
    methods = k.select("cls", name.alias("name"), F.concat(F.lit("c"), F.col("cls").cast("string"), F.lit("::"), name).alias("symbol"), (F.col("cls") % 4 == 1).alias("pure"))
    return bases, methods


@query(f"WITH RECURSIVE {FOREST} SELECT anc AS cls, count(DISTINCT cls) AS n FROM up GROUP BY 1")
def grf_04_subtree(spark, sf_dir):
    bases, _ = forest(spark, sf_dir)
    return G.subtree(G.ancestors(spark, bases)).groupBy("cls").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {FOREST} SELECT cls, name, symbol, pure FROM resolved")
def grf_05_resolution(spark, sf_dir):
    bases, methods = forest(spark, sf_dir)
    return G.resolve_methods(G.ancestors(spark, bases), methods)


@query(f"""WITH RECURSIVE {FOREST}, s AS (SELECT DISTINCT anc AS cls, cls AS sub FROM up)
SELECT s.cls, name, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS cha FROM s JOIN resolved r ON r.cls = s.sub WHERE NOT pure GROUP BY 1, 2""")
def grf_07_cha(spark, sf_dir):
    bases, methods = forest(spark, sf_dir)
    found = G.class_hierarchy_targets(G.ancestors(spark, bases), methods)
    return found.select("cls", "name", F.array_join("cha", ",").alias("cha"))


@query(f"WITH RECURSIVE {FOREST} SELECT cls, cast(max(length(path)) AS INTEGER) AS level FROM up GROUP BY 1")
def grf_06_topological(spark, sf_dir):
    bases, _ = forest(spark, sf_dir)
    placed, left = G.topological_order(bases)
    return placed.select("cls", "level").unionByName(left.select("cls", F.lit(-1).alias("level")))


@query()
def grf_08_rta(spark, sf_dir):
    """Live classes, reachable bodies and rounds of the mutual fixpoint over the class forest."""
    bases, methods = forest(spark, sf_dir)
    bodies = methods.where("NOT pure")
    sites = bodies.select(F.col("symbol").alias("src"), F.floor(F.col("cls") / 4).cast("long").alias("cls"), F.concat(F.lit("m"), ((F.col("cls") + 1) % 3).cast("string")).alias("name"))
    constructs = bodies.where("cls % 3 = 0").select(F.col("symbol").alias("src"), (F.col("cls") + 5).alias("cls"))
    members = bases.where("cls % 7 = 0").select("cls", (F.col("cls") + 1).alias("member"))
    static = spark.range(1, 2).select(F.col("id").alias("cls"))
    fixed = bodies.where("cls = 0").select(F.lit("main").alias("src"), F.col("symbol").alias("dst"))
    roots = spark.range(1).select(F.lit("main").alias("node"))
    solved = G.rapid_types(spark, sites, bases, methods, members, constructs, static, fixed, roots)
    live = solved["live"].select(F.lit("live").alias("kind"), F.col("cls").cast("string").alias("name"))
    return live.unionByName(solved["reach"].select(F.lit("reach").alias("kind"), F.col("node").alias("name"))).unionByName(spark.range(1).select(F.lit("rounds").alias("kind"), F.lit(str(solved["rounds"])).alias("name")))


#: Two runs over references: min follows those with an even sum, max all.
RUNS = """refs AS (SELECT doc_id AS src, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS dst FROM documents UNION ALL SELECT doc_id, (doc_id * 5 + 1) % (SELECT count(*) FROM documents) FROM documents WHERE doc_id % 3 = 0),
  a AS (SELECT 0::BIGINT AS node UNION SELECT r.dst FROM a JOIN refs r ON r.src = a.node WHERE (r.src + r.dst) % 4 <> 1),
  b AS (SELECT 0::BIGINT AS node UNION SELECT r.dst FROM b JOIN refs r ON r.src = b.node)"""


def two_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.agg(F.count("*").alias("n"))
    wide = docs.crossJoin(F.broadcast(n))
    refs = wide.select(F.col("doc_id").alias("src"), ((F.col("doc_id") * 7 + 3) % F.col("n")).alias("dst")).unionByName(wide.where("doc_id % 3 = 0").select(F.col("doc_id").alias("src"), ((F.col("doc_id") * 5 + 1) % F.col("n")).alias("dst")))
    # one fixpoint for both runs, over nodes tagged with the run
    tag = lambda c: F.struct("run", F.col(c).alias("key"))
    runs = F.explode(F.when((F.col("src") + F.col("dst")) % 4 != 1, F.array(F.lit("min"), F.lit("max"))).otherwise(F.array(F.lit("max"))))
    start = root(spark).withColumn("run", F.explode(F.array(F.lit("min"), F.lit("max")))).select(tag("node").alias("node"))
    met = G.reach(refs.withColumn("run", runs).select(tag("src").alias("src"), tag("dst").alias("dst")), start)
    of = lambda run: met.where(F.col("node.run") == run).select(F.col("node.key").alias("node"))
    return of("min"), of("max"), docs.select(F.col("doc_id").alias("key"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 2).cast("string")).alias("name"))


@query(f"""WITH RECURSIVE {RUNS}, c AS (SELECT 'f' || (doc_id // 2) AS name, CASE WHEN doc_id IN (SELECT node FROM a) THEN 0 WHEN doc_id IN (SELECT node FROM b) THEN 1 ELSE 2 END AS r FROM documents)
SELECT name, ['keep', 'open', 'drop'][min(r) + 1] AS cls FROM c GROUP BY 1""")
def grf_23_classify(spark, sf_dir):
    in_min, in_max, functions = two_runs(spark, sf_dir)
    return G.classify(functions, in_min, in_max)


@query("""WITH g AS (SELECT doc_id % 97 AS k, CASE WHEN quality = 1 AND toxic = 1 THEN 'keep' WHEN toxic = 1 THEN NULL WHEN quality = 1 AND doc_id % 2 = 0 THEN 'open' ELSE 'drop' END AS cls FROM labels)
SELECT 'n' || k AS name, CASE WHEN bool_or(cls = 'keep') THEN 'keep' WHEN bool_and(cls = 'drop') THEN 'drop' ELSE 'open' END AS cls FROM g GROUP BY 1""")
def grf_24_vote(spark, sf_dir):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    cls = F.when(q & t, "keep").when(t, F.lit(None)).when(q & (F.col("doc_id") % 2 == 0), "open").otherwise("drop")
    return G.vote(table(spark, sf_dir, "labels").select(F.concat(F.lit("n"), (F.col("doc_id") % 97).cast("string")).alias("name"), F.col("doc_id").alias("build"), cls.alias("cls")))


@query("""WITH d AS (SELECT DISTINCT p_brand AS name, p_type AS file FROM part), m AS (SELECT name, count(*) AS c FROM d GROUP BY 1)
SELECT name, file, CASE WHEN c > 1 THEN name || '@' || file ELSE name END AS shown FROM d JOIN m USING (name)""")
def grf_25_qualified(spark, sf_dir):
    return G.qualified_names(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("file")).distinct())


@query("""WITH c AS (SELECT s_nationkey AS unit, min(s_suppkey) AS m FROM supplier GROUP BY 1), s AS (SELECT m, s_suppkey AS k FROM supplier JOIN c ON unit = s_nationkey WHERE s_suppkey <> m)
SELECT m AS src, k AS dst FROM s UNION SELECT k, m FROM s""")
def grf_22_sections(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("unit"), F.lit(".text").alias("section"))
    return G.section_edges(nodes)


@query("""WITH RECURSIVE needs AS (SELECT p_partkey AS k, p_partkey // 2 AS dep FROM part WHERE p_partkey >= 3 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3),
  never AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 = 6 UNION SELECT needs.k FROM never JOIN needs ON needs.dep = never.k) SELECT 'n' || p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT k FROM never)""")
def grf_17_may_be_empty(spark, sf_dir):
    """Part k needs k // 2 and k // 3; parts below 3 need nothing; every seventh has no body."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).where("k % 7 <> 6")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    deps = F.when(F.col("k") < 3, F.array(F.lit(None).cast("string"))).otherwise(F.array(name(F.floor(F.col("k") / 2)), name(F.floor(F.col("k") / 3))))
    return G.all_of_fixpoint(parts.select(name(F.col("k")).alias("name"), F.lit(0).alias("body"), F.explode(deps).alias("dep")))


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS id, 'v_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '_ADDR' ELSE '_IN' END AS name FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 3, 'v_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '_ADDR' ELSE '_IN' END FROM documents WHERE doc_id % 3 <> 0""")
def jon_17_affixes(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.concat(F.lit("v_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "_ADDR").otherwise("_IN")).alias("name"))
    patterns = spark.createDataFrame([(1, "v_", "_ADDR"), (3, "", "N")], "id int, prefix string, suffix string")
    return V.affix_matches(patterns, names)


# ---- what sets the operators apart from plain reachability ----


#: Class k derives from k // 2, but for every seventh; every fifth holds another class as a member.
HOLDERS = """b AS (SELECT doc_id AS cls, doc_id // 2 AS base FROM documents WHERE doc_id > 0 AND doc_id % 7 <> 3),
  up AS (SELECT doc_id AS cls, doc_id AS anc FROM documents UNION SELECT up.cls, b.base FROM up JOIN b ON b.cls = up.anc),
  h AS (SELECT DISTINCT up.cls AS src, m.doc_id // 3 + m.doc_id % 11 AS dst FROM up JOIN documents m ON m.doc_id = up.anc WHERE m.doc_id % 5 = 2)"""


@query(f"WITH RECURSIVE {HOLDERS}, r AS (SELECT doc_id AS cls FROM documents WHERE doc_id % 40 = 0 UNION SELECT h.dst FROM r JOIN h ON h.src = r.cls) SELECT cls FROM r")
def grf_09_live_members(spark, sf_dir):
    """Classes made live by those with a key divisible by 40, through members of their own and of their ancestors."""
    k = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cls"))
    derived = (F.col("cls") > 0) & (F.col("cls") % 7 != 3)
    bases = k.select("cls", F.when(derived, F.floor(F.col("cls") / 2)).cast("long").alias("base"), F.lit(0).alias("ord"))
    members = k.where("cls % 5 = 2").select("cls", (F.floor(F.col("cls") / 3) + F.col("cls") % 11).cast("long").alias("member"))
    return G.live_classes(G.ancestors(spark, bases), members, k.where("cls % 40 = 0"))


@query(f"""WITH RECURSIVE {FOREST}, s AS (SELECT DISTINCT anc AS cls, cls AS sub FROM up),
  o AS (SELECT s.cls, name, list_sort(list(DISTINCT symbol)) AS cha FROM s JOIN resolved r ON r.cls = s.sub WHERE NOT pure GROUP BY 1, 2),
  c AS (SELECT c_custkey AS src, c_custkey % 25 AS cls, CASE WHEN c_custkey % 3 = 2 THEN c_custkey % 25 // 2 ELSE c_custkey % 25 END AS other, 'm' || (c_custkey % 2) AS name FROM customer),
  w AS (SELECT src, resolved.symbol AS static, o.cha FROM c JOIN resolved ON resolved.cls = c.cls AND resolved.name = c.name JOIN o ON o.cls = c.other AND o.name = c.name),
  known AS (SELECT DISTINCT symbol AS static, cha FROM o JOIN resolved USING (cls, name))
SELECT src, static, array_to_string(cha, ',') AS cha FROM w WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.static = w.static AND k.cha = w.cha)""")
def grf_10_override_sets(spark, sf_dir):
    """Customers are calls over the class forest; every third lists the overrides of its class's base instead. Those pass
    too where some receiver with the same static target has that very set."""
    bases, methods = forest(spark, sf_dir)
    up = G.ancestors(spark, bases)
    key = F.col("c_custkey")
    calls = table(spark, sf_dir, "customer").select(key.alias("src"), (key % 25).alias("cls"), F.when(key % 3 == 2, F.floor(key % 25 / 2)).otherwise(key % 25).cast("long").alias("other"), F.concat(F.lit("m"), (key % 2).cast("string")).alias("name"))
    static = G.resolve_methods(up, methods).select("cls", "name", F.col("symbol").alias("static"))
    sets = G.class_hierarchy_targets(up, methods).select(F.col("cls").alias("other"), "name", "cha")
    records = calls.join(static, ["cls", "name"]).join(sets, ["other", "name"]).select("src", "static", "cha")
    return G.virtual_record_violations(records, up, methods).select("src", "static", F.array_join("cha", ",").alias("cha"))


@query("""WITH RECURSIVE n AS (SELECT 'v' || doc_id AS name, doc_id FROM documents WHERE doc_id % 9 <> 5),
  p AS (SELECT 'v' || doc_id AS name, 'v' || (doc_id // 10) AS prefix, cast(doc_id % 10 AS VARCHAR) AS suffix FROM documents WHERE doc_id % 6 = 1),
  e AS (SELECT 'v' || doc_id AS src, n.name AS dst FROM documents d JOIN n ON n.name = 'v' || (d.doc_id // 3) WHERE d.doc_id > 0
    UNION SELECT p.name, n.name FROM p JOIN n ON starts_with(n.name, prefix) AND ends_with(n.name, suffix) AND length(n.name) >= length(prefix) + length(suffix)),
  r AS (SELECT name FROM n WHERE doc_id % 50 = 49 UNION SELECT e.dst FROM r JOIN e ON e.src = r.name) SELECT name FROM r""".replace("SELECT 'v' || doc_id AS src", "SELECT 'v' || d.doc_id AS src"))
def grf_18_built_names(spark, sf_dir):
    """Wanted names through bodies and through names that wanted bodies build from a prefix and a suffix."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    v = lambda c: F.concat(F.lit("v"), c.cast("string"))
    names = docs.where("doc_id % 9 <> 5").select("doc_id", v(F.col("doc_id")).alias("name"))
    inner = docs.where("doc_id > 0").select(v(F.col("doc_id")).alias("name"), v(F.floor(F.col("doc_id") / 3)).alias("inner"))
    built = docs.where("doc_id % 6 = 1").select(v(F.col("doc_id")).alias("name"), v(F.floor(F.col("doc_id") / 10)).alias("prefix"), (F.col("doc_id") % 10).cast("string").alias("suffix"))
    return G.wanted_names(names.where("doc_id % 50 = 49").select("name"), inner, built, names.select("name"))


@query("""WITH RECURSIVE n AS (SELECT doc_id AS k, doc_id // 8 AS u, 'f' || (doc_id // 32) || '_' || (doc_id % 4) AS name, doc_id % 3 = 0 AS loc FROM documents),
  r AS (SELECT k AS src, u, 'f' || (k // 32) || '_' || ((k + 1) % 4) AS name, k % 5 <> 0 AS strict FROM n UNION ALL SELECT k, u, 'f' || (k // 64) || '_' || (k % 4), true FROM n),
  own AS (SELECT r.src, n.k AS dst, strict FROM r JOIN n ON n.u = r.u AND n.name = r.name AND n.loc),
  far AS (SELECT r.src, n.k AS dst, strict FROM r JOIN n ON n.name = r.name AND NOT n.loc WHERE NOT EXISTS (SELECT 1 FROM n l WHERE l.u = r.u AND l.name = r.name AND l.loc)),
  a AS (SELECT * FROM own UNION ALL SELECT * FROM far),
  e AS (SELECT 'max' AS run, src, dst FROM a UNION SELECT 'min', src, dst FROM a WHERE strict),
  x AS (SELECT run, k AS node FROM n, (VALUES ('min'), ('max')) v(run) WHERE k % 41 = 40 OR (name LIKE 'f3/_%' ESCAPE '/' AND NOT loc)
    UNION SELECT x.run, e.dst FROM x JOIN e ON e.run = x.run AND e.src = x.node) SELECT run, node FROM x""")
def grf_21_resolved_reach(spark, sf_dir):
    """Functions reached under both readings: local definitions hide others of their name, roots by predicate and by name."""
    k = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    part = lambda by, d: F.concat(F.lit("f"), F.floor(F.col("key") / by).cast("string"), F.lit("_"), ((F.col("key") + d) % 4).cast("string"))
    unit = F.floor(F.col("key") / 8).alias("unit")
    nodes = k.select("key", unit, part(32, 0).alias("name"), (F.col("key") % 3 == 0).alias("local"), (F.col("key") % 41 == 40).alias("root"))
    near = k.select(F.col("key").alias("src"), unit, part(32, 1).alias("name"), (F.col("key") % 5 != 0).alias("strict"))
    far = k.select(F.col("key").alias("src"), unit, part(64, 0).alias("name"), F.lit(True).alias("strict"))
    return G.function_reach(nodes, near.unionByName(far), nodes.where("name LIKE 'f3/_%' ESCAPE '/'").select("name"))
