"""Reachability, class hierarchies and fixpoints over edge tables.

Fixpoints are loops on the driver over DataFrames. A job joins the frontier with the edges, several steps at once, and takes
away what was seen; jobs end when nothing is new. Each job's result goes to the shared checkpoint folder (a table there, so
that lineage stays short and a lost executor costs a read). Edges are partitioned by their join key once and kept. Long
chains are shortened by doubling: steps taken grow with the logarithm of a chain's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder  # noqa: F401  (used by callers)
from ..storage import written as cut

#: Steps of one job at most, and the size of a frontier from which on a job takes one step only.
MOST_STEPS, WIDE = 12, 2_000_000
#: Steps after which chains are shortened.
PATIENCE = 24


def shortcuts(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) over 2, 4, 8, ... steps along chains, that is nodes with one way on. They are paths of the graph, so
    that they change nothing of what is reachable."""
    jump = cut(edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1 and src <> dst").select("src", "dst"))
    longest, out, span = jump.count(), None, 1
    while span < longest:
        jump = cut(jump.join(jump.select(F.col("src").alias("dst"), F.col("dst").alias("on")), "dst").select("src", F.col("on").alias("dst")))
        if not jump.take(1):
            break
        out, span = jump if out is None else out.unionByName(jump), 2 * span
    return out if out is not None else edges.limit(0)


def reach(edges: DataFrame, roots: DataFrame, most_jobs: int = 100_000, by: tuple[str, ...] = ()) -> DataFrame:
    """(node) reachable from roots (node) over edges (src, dst), roots included. Cycles are fine. A job takes 1, 2, 4, ...
    steps while frontiers are small, and ends with one anti-join against what was seen. by: further columns of roots; what
    is reachable is told apart by them, over the same edges."""
    found = [*by, "node"]
    kept = edges.select("src", "dst").distinct().repartition("src").persist()
    seen = frontier = cut(roots.select(*found).distinct())
    steps, taken, shortened = 1, 0, False
    try:
        for _ in range(most_jobs):
            met = frontier.withColumn("k", F.lit(0))
            for k in range(steps):  # each step reads the one before once; a group by node keeps the edges' partitioning
                on = met.join(kept, (met["node"] == kept["src"]) & (met["k"] == k), "left")
                pair = F.array(F.struct(*found, "k"), F.when(F.col("dst").isNotNull(), F.struct(*by, F.col("dst").alias("node"), F.lit(k + 1).alias("k"))))
                met = on.select(F.explode(F.array_compact(pair)).alias("x")).groupBy(*[f"x.{c}" for c in found]).agg(F.min("x.k").alias("k"))
            new = cut(met.where("k > 0").join(seen, found, "left_anti"))
            # nodes met before the last step have been followed within the job
            frontier = new.where(F.col("k") == steps).select(*found)
            seen = seen.unionByName(new.select(*found))
            if len(seen.inputFiles()) > 400:
                seen = cut(seen)
            size = frontier.count()
            if not size:
                return seen
            taken += steps
            steps = 1 if size >= WIDE else min(2 * steps, MOST_STEPS)
            if taken >= PATIENCE and not shortened:
                shortened = True
                longer = edges.select("src", "dst").union(shortcuts(kept)).distinct().repartition("src").persist()
                kept.unpersist()
                kept = longer
        raise RuntimeError(f"not closed after {most_jobs} jobs")
    finally:
        kept.unpersist()


def reach_acyclic(spark: SparkSession, edges: str, roots: str, depth: int = 10_000) -> DataFrame:
    """The same for graphs without cycles, as one recursive query over two views (src, dst) and (node); paths longer than
    depth are an error."""
    return spark.sql(
        f"""WITH RECURSIVE r(node, d) MAX RECURSION LEVEL {depth} AS (
              SELECT node, 0 FROM {roots} UNION ALL SELECT e.dst, r.d + 1 FROM r JOIN {edges} e ON e.src = r.node)
            SELECT DISTINCT node FROM r"""
    )


def k_hops(targets: DataFrame, includes: DataFrame, k: int = 2) -> DataFrame:
    """(file, reach): distinct nodes within k steps, where targets and includes are (file, target); files without any
    target are the caller's to add."""
    level = targets.select("file", "target").distinct()
    seen = level
    for _ in range(k - 1):
        step = includes.select(F.col("file").alias("via"), F.col("target").alias("next")).distinct()
        level = level.join(step, level["target"] == step["via"]).select("file", F.col("next").alias("target")).distinct()
        seen = seen.unionByName(level)
    return seen.distinct().groupBy("file").agg(F.count("*").alias("reach"))


def mode_edges(direct: DataFrame, implicit: DataFrame, virtual: DataFrame, member_ptr: DataFrame, mode: str) -> DataFrame:
    """The edges (src, dst) of a closure: direct (direct ones only), sound (all that classes allow) or precise (live
    receivers, dispatched pointers). virtual: (src, cha, rta); member_ptr: (src, dst, dispatched)."""
    if mode == "direct":
        return direct.select("src", "dst")
    receivers = "cha" if mode == "sound" else "rta"
    pointers = member_ptr if mode == "sound" else member_ptr.where("dispatched")
    return direct.select("src", "dst").union(implicit.select("src", "dst")).union(virtual.select("src", F.explode(receivers))).union(pointers.select("src", "dst"))


def ancestors(spark: SparkSession, bases: DataFrame) -> DataFrame:
    """(cls, anc, path) of every class above every class of bases (cls, base, ord), with the class itself; path is the
    least one, in the order in which a depth-first walk meets it. One row for a pair however many ways lead up, found by
    doubling: a round joins what lies within k steps with itself. Least paths of a hierarchy without cycles consist of
    least paths, since two paths to one class are never prefixes of each other."""
    known = bases.where("base IS NOT NULL")
    classes = bases.select("cls").union(known.select("base")).distinct()
    nothing = F.array().cast("array<int>")
    step = known.select("cls", F.col("base").alias("anc"), F.array(F.col("ord").cast("int")).alias("path"))
    least = lambda x: x.groupBy("cls", "anc").agg(F.min("path").alias("path"))
    up = cut(least(classes.select("cls", F.col("cls").alias("anc"), nothing.alias("path")).unionByName(step)))
    state = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("cls", "anc", "path").cast("decimal(38,0)"))).first())
    before, span, most = state(up), 1, classes.count()
    while span < most:
        on = up.select(F.col("cls").alias("anc"), F.col("anc").alias("top"), F.col("path").alias("rest"))
        up = cut(least(up.join(on, "anc").select("cls", F.col("top").alias("anc"), F.concat("path", "rest").alias("path"))))
        span *= 2
        if (now := state(up)) == before:
            break
        before = now
    return up


def subtree(up: DataFrame) -> DataFrame:
    """(cls, sub): each class with all classes at or below it."""
    return up.select(F.col("anc").alias("cls"), F.col("cls").alias("sub")).distinct()


def resolve_methods(up: DataFrame, methods: DataFrame) -> DataFrame:
    """(cls, name, symbol, pure): what a method name means from a class: its own, then its bases' in order, depth first.
    methods: (cls, name, symbol, pure)."""
    found = up.join(methods.withColumnRenamed("cls", "anc"), "anc")
    return found.groupBy("cls", "name").agg(F.min_by(F.struct("symbol", "pure"), "path").alias("x")).select("cls", "name", "x.symbol", "x.pure")


def class_hierarchy_targets(up: DataFrame, methods: DataFrame) -> DataFrame:
    """(cls, name, cha): the methods that are not pure which a call on a receiver of cls or below can reach."""
    each = subtree(up).join(resolve_methods(up, methods).where("NOT pure").withColumnRenamed("cls", "sub"), "sub")
    return each.groupBy("cls", "name").agg(F.array_sort(F.collect_set("symbol")).alias("cha"))


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (cls, base) with chains taken out: (cls, base, far) of classes with several ways up, (cls, base, far) of
    classes with one, and (cls) of those found on or above a cycle of single ways. far is the longest way's length; bases
    are classes with several ways, with none, or on cycles. Single ways are followed by doubling; where all ways of a
    class then lead to one base it has a single way itself, and goes round again."""
    up = cut(edges.select("cls", "base", F.lit(1).cast("long").alias("far")).distinct())
    looped = edges.select("cls").limit(0)
    singles = -1
    while True:
        ways = up.groupBy("cls").agg(F.count("*").alias("n"), F.min("base").alias("base"), F.max("far").alias("far"))
        jump = cut(ways.where("n = 1").drop("n"))
        one = jump.count()
        if one == singles:
            return up.join(jump, "cls", "left_anti"), jump, looped
        span, on = 1, lambda x: x.select(F.col("cls").alias("base"), F.col("base").alias("top"), F.col("far").alias("more"))
        while span < 2 * one and jump.join(on(jump), "base", "left_semi").take(1):
            further = jump.join(on(jump), "base", "left")
            jump = cut(further.select("cls", F.coalesce("top", "base").alias("base"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
            span *= 2
        # a way that has not ended after as many steps as there are single ways never does
        endless = cut(jump.join(on(jump), "base", "left_semi").select("cls"))
        looped = looped.union(endless)
        jump = jump.join(endless, "cls", "left_anti")
        many = up.join(ways.where("n > 1").select("cls"), "cls", "left_semi").join(on(jump), "base", "left")
        lifted = many.select("cls", F.coalesce("top", "base").alias("base"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        up, singles = cut(lifted.groupBy("cls", "base").agg(F.max("far").alias("far")).unionByName(jump)), one - endless.count()


def topological_order(bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, level) by the longest way up, and (cls) of those in or above a cycle. Chains, however long, and diamonds in
    them go by doubling; what is left is placed level by level, each round taking what it placed off the counts of open
    bases. Repeated rows count once; null bases are none."""
    edges = cut(bases.where("cls IS NOT NULL AND base IS NOT NULL").select("cls", "base").distinct())
    every = cut(bases.select("cls").union(edges.select("base")).where("cls IS NOT NULL").distinct())
    many, single, looped = contracted(edges)
    many, looped = cut(many), cut(looped)
    placed = frontier = cut(every.join(edges, "cls", "left_anti").select("cls", F.lit(0).cast("long").alias("level")))
    waiting = cut(many.groupBy("cls").agg(F.count("*").alias("open"), F.lit(0).cast("long").alias("level")))
    while frontier.take(1) and waiting.take(1):
        met = many.join(frontier.select(F.col("cls").alias("base"), F.col("level").alias("at")), "base")
        met = met.groupBy("cls").agg(F.count("*").alias("less"), F.max(F.col("at") + F.col("far")).alias("to"))
        left = waiting.join(met, "cls", "left").select("cls", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open"), F.greatest("level", "to").alias("level"))
        left = cut(left)
        frontier, waiting = left.where("open = 0").select("cls", "level"), left.where("open > 0")
        placed = placed.unionByName(frontier)
        if len(placed.inputFiles()) > 400:
            placed = cut(placed)
    chains = single.join(placed.select(F.col("cls").alias("base"), "level"), "base").select("cls", (F.col("level") + F.col("far")).alias("level"))
    placed = cut(placed.unionByName(chains).select("cls", F.col("level").cast("int").alias("level")))
    return placed, every.join(placed, "cls", "left_anti")


def live_classes(up: DataFrame, members: DataFrame, seeds: DataFrame) -> DataFrame:
    """(cls) that seeds (cls) make live: a live class makes live the classes that it and its ancestors hold as members."""
    return reach(held_classes(up, members), seeds.select(F.col("cls").alias("node"))).withColumnRenamed("node", "cls")


def held_classes(up: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (src, dst) from each class to the members (cls, member) of itself and of its ancestors."""
    return up.join(members.withColumnRenamed("cls", "anc"), "anc").select(F.col("cls").alias("src"), F.col("member").alias("dst")).distinct()


def rapid_types(spark: SparkSession, sites: DataFrame, bases: DataFrame, methods: DataFrame, members: DataFrame, constructs: DataFrame, static_objects: DataFrame, fixed: DataFrame, roots: DataFrame) -> dict:
    """Mutual fixpoint of live classes and reachable bodies. sites: (src, cls, name) virtual calls; members: (cls, member)
    classes held as members; constructs: (src, cls); static_objects: (cls); fixed: (src, dst) edges of all other kinds;
    roots: (node). Result: live (cls), reach (node), rta (src, cls, name, rta), rounds."""
    up = cut(ancestors(spark, bases))
    resolved = cut(resolve_methods(up, methods).where("NOT pure"))
    receivers = cut(sites.join(subtree(up), "cls").join(resolved.select(F.col("cls").alias("sub"), "name", "symbol"), ["sub", "name"]))
    holds = cut(held_classes(up, members))
    live = reach(holds, static_objects.select(F.col("cls").alias("node")))
    rounds = 0
    while True:
        rounds += 1
        called = cut(receivers.join(live.select(F.col("node").alias("sub")), "sub", "left_semi"))
        reached = reach(fixed.select("src", "dst").union(called.select("src", "symbol")), roots)
        made = constructs.join(reached.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("cls").alias("node"))
        grown = cut(reach(holds, live.union(made)))
        if grown.count() == live.count():
            break
        live = grown
    rta = sites.join(called.groupBy("src", "cls", "name").agg(F.array_sort(F.collect_set("symbol")).alias("rta")), ["src", "cls", "name"], "left")
    return {"live": live.withColumnRenamed("node", "cls"), "reach": reached, "rta": rta.withColumn("rta", F.coalesce("rta", F.array().cast("array<string>"))), "rounds": rounds}


def virtual_record_violations(records: DataFrame, up: DataFrame, methods: DataFrame) -> DataFrame:
    """records (src, static, cha) for which no receiver class that resolves to static has exactly this override set."""
    resolved = resolve_methods(up, methods)
    sets = class_hierarchy_targets(up, methods).join(resolved.select("cls", "name", F.col("symbol").alias("static")), ["cls", "name"])
    wanted = records.withColumn("cha", F.array_sort(F.array_distinct("cha")))
    return wanted.join(sets.select("static", "cha").distinct(), ["static", "cha"], "left_anti")


def instance_propagation(seeds: DataFrame, uses: DataFrame) -> DataFrame:
    """(tmpl, type) of all instances: a used template passes its type on to the templates (tmpl, inner) it uses."""
    found = reach(uses.select(F.col("tmpl").alias("src"), F.col("inner").alias("dst")), seeds.select("type", F.col("tmpl").alias("node")), by=("type",))
    return found.select(F.col("node").alias("tmpl"), "type")


def backward_flags(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(node) from which a marked node can be reached: reachability over reversed edges."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), marked)


def all_of_fixpoint(bodies: DataFrame) -> DataFrame:
    """(name) that can be empty: bodies (name, body, dep) fire when all their deps are in (no dep: dep null); a name is in
    when any of its bodies fires. A round takes only the names it added off the counts of the bodies that wait for them."""
    deps = cut(bodies.where("dep IS NOT NULL").select("name", "body", "dep").distinct())
    waiting = cut(deps.groupBy("name", "body").agg(F.count("*").alias("open")))
    inside = fresh = cut(bodies.select("name", "body").distinct().join(waiting, ["name", "body"], "left_anti").select("name").distinct())
    while fresh.take(1):
        met = deps.join(fresh.select(F.col("name").alias("dep")), "dep").groupBy("name", "body").agg(F.count("*").alias("less"))
        left = waiting.join(met, ["name", "body"], "left").select("name", "body", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open"))
        left = cut(left)
        fresh = cut(left.where("open = 0").select("name").distinct().join(inside, "name", "left_anti"))
        waiting, inside = left.where("open > 0"), inside.unionByName(fresh)
        if len(inside.inputFiles()) > 400:
            inside = cut(inside)
    return inside


def wanted_names(seeds: DataFrame, body_names: DataFrame, patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(name): seeds, the carved names in bodies (name, inner) of wanted ones, and the names that patterns (name, prefix,
    suffix) in wanted bodies build, to a fixpoint."""
    from .verify import affix_matches

    built = cut(affix_matches(patterns.select(F.concat_ws("\x1f", "name", "prefix", "suffix").alias("id"), "prefix", "suffix").distinct(), names.select("name")).select(F.substring_index("id", "\x1f", 1).alias("src"), F.col("name").alias("dst")))
    inner = body_names.join(names.select(F.col("name").alias("inner")), "inner", "left_semi").select(F.col("name").alias("src"), F.col("inner").alias("dst"))
    return reach(inner.union(built), seeds.select(F.col("name").alias("node"))).withColumnRenamed("node", "name")


def resolved_references(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges (src, dst) of references (src, unit, name) to what their names mean: the local definitions of the name in the
    referring unit hide all others; else every definition of that name that is not local. nodes: (key, unit, name, local);
    a key with several names has several rows."""
    local = nodes.where("local").select("unit", "name", F.col("key").alias("dst"))
    outer = nodes.where("NOT local").select("name", F.col("key").alias("dst"))
    own = refs.join(local, ["unit", "name"]).select("src", "dst")
    rest = refs.join(local.select("unit", "name").distinct(), ["unit", "name"], "left_anti")
    return own.unionByName(rest.join(outer, "name").select("src", "dst")).distinct()


def function_reach(nodes: DataFrame, refs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(run, node) under the readings min, over references (src, unit, name, strict) that are strict, and max, over all.
    Roots are nodes (key, unit, name, local, root) marked as roots and the definitions that are not local of names in
    seeds (name). Both readings are one fixpoint over nodes tagged with the reading."""
    strict, loose = (resolved_references(nodes, refs.where(x)) for x in ("strict", "NOT strict"))
    edges = strict.withColumn("loose", F.lit(False)).unionByName(loose.withColumn("loose", F.lit(True)))
    runs = F.explode(F.when(F.col("loose"), F.array(F.lit("max"))).otherwise(F.array(F.lit("min"), F.lit("max"))))
    tag = lambda c: F.struct(F.col("run"), F.col(c).alias("key"))
    tagged = edges.withColumn("run", runs).select(tag("src").alias("src"), tag("dst").alias("dst"))
    named = nodes.where("NOT local").join(seeds.select("name").distinct(), "name", "left_semi").select("key")
    roots = nodes.where("root").select("key").union(named).distinct().withColumn("run", F.explode(F.array(F.lit("min"), F.lit("max"))))
    return reach(tagged, roots.select(tag("key").alias("node"))).select("node.run", F.col("node.key").alias("node"))


def section_edges(nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) between nodes (key, unit, section) of one input section: a star to the least key, both ways."""
    centre = nodes.groupBy("unit", "section").agg(F.min("key").alias("centre"))
    star = nodes.join(centre, ["unit", "section"]).where("key <> centre")
    return star.select(F.col("centre").alias("src"), F.col("key").alias("dst")).union(star.select("key", "centre")).distinct()


def classify(functions: DataFrame, in_min: DataFrame, in_max: DataFrame) -> DataFrame:
    """(name, cls) of functions (key, name): keep if reached under min, open if only under max, else drop; of several
    definitions of a name the most kept counts."""
    marked = functions.join(in_min.select(F.col("node").alias("key"), F.lit(True).alias("kept")), "key", "left").join(in_max.select(F.col("node").alias("key"), F.lit(True).alias("maybe")), "key", "left")
    rank = F.when(F.col("kept"), 0).when(F.col("maybe"), 1).otherwise(2)
    return marked.groupBy("name").agg(F.min(rank).alias("r")).select("name", F.element_at(F.array(F.lit("keep"), F.lit("open"), F.lit("drop")), F.col("r") + 1).alias("cls"))


def vote(graded: DataFrame) -> DataFrame:
    """(name, cls) over builds (name, build, cls; cls null: not graded): keep if any keeps, drop if all graded drop, else
    open."""
    seen = graded.groupBy("name").agg(F.bool_or(F.col("cls") == "keep").alias("any_keep"), F.bool_and(F.col("cls") == "drop").alias("all_drop"))
    return seen.select("name", F.when(F.col("any_keep"), "keep").when(F.col("all_drop"), "drop").otherwise("open").alias("cls"))


def qualified_names(defined: DataFrame) -> DataFrame:
    """(name, file, shown): a name that several files define is shown with its file."""
    many = defined.select("name", "file").distinct().groupBy("name").agg(F.count("*").alias("files"))
    return defined.join(many, "name").select("name", "file", F.when(F.col("files") > 1, F.concat_ws("@", "name", "file")).otherwise(F.col("name")).alias("shown"))
