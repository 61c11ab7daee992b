import random

from corpusloom.operators import graph as G


def nodes(df):
    return sorted(r[0] for r in df.collect())


def test_reach_with_cycle(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 6)], "src long, dst long")
    assert nodes(G.reach(e, spark.createDataFrame([(1,)], "node long"))) == [0, 1, 2]
    assert nodes(G.backward_flags(e, spark.createDataFrame([(6,)], "node long"))) == [5, 6]


def test_topological_order_finds_cycles(spark):
    b = spark.createDataFrame([("c", "b", 0), ("b", "a", 0), ("x", "y", 0), ("y", "x", 0)], "cls string, base string, ord int")
    placed, left = G.topological_order(b)
    assert {r.cls: r.level for r in placed.collect()} == {"a": 0, "b": 1, "c": 2} and nodes(left) == ["x", "y"]


def longest(edges):
    """Levels by trying every class until nothing changes; what never settles is on or above a cycle."""
    every = {c for e in edges for c in e}
    levels = {}
    while True:
        new = {c: 1 + max((levels[b] for a, b in edges if a == c), default=-1) for c in every if c not in levels and all(b in levels for a, b in edges if a == c)}
        if not new:
            return levels, sorted(every - set(levels))
        levels |= new


def test_topological_order_as_by_trying(spark):
    """Chains, diamonds, shared bases, repeated rows, nulls, cycles of single and of several ways, and classes above them."""
    draw = random.Random(5)
    for n, ways, loops in ((40, 1, 2), (16, 2, 0), (24, 3, 2)):
        edges = {(c, draw.randrange(c)) for c in range(1, n) for _ in range(draw.randint(1, ways))}
        edges |= {(draw.randrange(n // 2), draw.randrange(n // 2, n)) for _ in range(loops)}
        rows = [(*e, 0) for e in edges] + [(0, None, 0), (None, 3, 0), (*min(edges), 1)]
        placed, left = G.topological_order(spark.createDataFrame(rows, "cls long, base long, ord int"))
        assert ({r.cls: r.level for r in placed.collect()}, nodes(left)) == longest(sorted(edges))


def test_topological_order_of_long_chains(spark):
    """10,000 classes in a row, and 600 diamonds on top of each other, go by doubling."""
    chain = spark.range(1, 10_000).selectExpr("id AS cls", "id - 1 AS base")
    diamonds = spark.range(600).selectExpr("20000 + 3 * id AS k").selectExpr("explode(array(struct(k + 1 AS cls, k AS base), struct(k + 2 AS cls, k AS base), struct(k + 3 AS cls, k + 1 AS base), struct(k + 3 AS cls, k + 2 AS base))) AS x").select("x.*")
    placed, left = G.topological_order(chain.unionByName(diamonds))
    levels = {r.cls: r.level for r in placed.collect()}
    assert levels[9_999] == 9_999 and levels[21_800] == 1_200 and levels[21_799] == 1_199 and not left.take(1)
    assert all(levels[k] == k for k in range(10_000))


def test_topological_order_of_nothing(spark):
    placed, left = G.topological_order(spark.createDataFrame([], "cls long, base long, ord int"))
    assert placed.count() == left.count() == 0


def test_resolution_is_depth_first(spark):
    b = spark.createDataFrame([("d", "b", 0), ("d", "c", 1), ("b", "a", 0)], "cls string, base string, ord int")
    m = spark.createDataFrame([("a", "f", "a::f", False), ("c", "f", "c::f", False)], "cls string, name string, symbol string, pure boolean")
    got = {r.cls: r.symbol for r in G.resolve_methods(G.ancestors(spark, b), m).collect()}
    assert got["d"] == "a::f" and got["c"] == "c::f"


def test_rta_needs_rounds(spark):
    b = spark.createDataFrame([("B", "A", 0), ("C", "A", 0), ("D", "A", 0)], "cls string, base string, ord int")
    m = spark.createDataFrame([("A", "f", "A::f", True), ("B", "f", "B::f", False), ("C", "f", "C::f", False), ("D", "f", "D::f", False)], "cls string, name string, symbol string, pure boolean")
    sites = spark.createDataFrame([("main", "A", "f")], "src string, cls string, name string")
    members = spark.createDataFrame([("C", "D")], "cls string, member string")
    made = spark.createDataFrame([("B::f", "C")], "src string, cls string")
    static = spark.createDataFrame([("B",)], "cls string")
    fixed = spark.createDataFrame([], "src string, dst string")
    got = G.rapid_types(spark, sites, b, m, members, made, static, fixed, spark.createDataFrame([("main",)], "node string"))
    assert nodes(got["live"]) == ["B", "C", "D"] and nodes(got["reach"]) == ["B::f", "C::f", "D::f", "main"]
    assert got["rounds"] == 2 and got["rta"].first().rta == ["B::f", "C::f", "D::f"]


def test_all_of_fixpoint(spark):
    rows = [("a", 0, None), ("b", 0, "a"), ("c", 0, "a"), ("c", 0, "z"), ("c", 1, "b"), ("d", 0, "z"), ("e", 0, "a"), ("e", 0, "d")]
    assert nodes(G.all_of_fixpoint(spark.createDataFrame(rows, "name string, body int, dep string"))) == ["a", "b", "c"]


def test_wanted_names(spark):
    names = spark.createDataFrame([(x,) for x in ("A", "B", "PRE_1", "PRE_2", "C")], "name string")
    bodies = spark.createDataFrame([("A", "B"), ("B", "other")], "name string, inner string")
    patterns = spark.createDataFrame([("B", "PRE_", "2")], "name string, prefix string, suffix string")
    assert nodes(G.wanted_names(spark.createDataFrame([("A",)], "name string"), bodies, patterns, names)) == ["A", "B", "PRE_2"]


def test_vote(spark):
    g = spark.createDataFrame([("a", 0, "drop"), ("a", 1, "keep"), ("b", 0, "drop"), ("b", 1, None), ("c", 0, "drop"), ("c", 1, "open"), ("d", 0, None)], "name string, build int, cls string")
    assert {r.name: r.cls for r in G.vote(g).collect()} == {"a": "keep", "b": "drop", "c": "open", "d": "open"}


def test_instances_and_records(spark):
    seen = G.instance_propagation(spark.createDataFrame([("v", "int")], "tmpl string, type string"), spark.createDataFrame([("v", "w"), ("w", "v")], "tmpl string, inner string"))
    assert sorted((r.tmpl, r.type) for r in seen.collect()) == [("v", "int"), ("w", "int")]
    b = spark.createDataFrame([("B", "A", 0)], "cls string, base string, ord int")
    m = spark.createDataFrame([("A", "f", "A::f", False), ("B", "f", "B::f", False)], "cls string, name string, symbol string, pure boolean")
    rec = spark.createDataFrame([("x", "A::f", ["A::f", "B::f"]), ("y", "A::f", ["A::f"])], "src string, static string, cha array<string>")
    assert [r.src for r in G.virtual_record_violations(rec, G.ancestors(spark, b), m).collect()] == ["y"]


def test_long_chain_by_doubling(spark):
    """A chain far longer than the jobs that follow it, with a fork and a cycle at its end."""
    n = 5000
    edges = spark.range(n).selectExpr("id AS src", "id + 1 AS dst").unionByName(spark.createDataFrame([(n, 10), (70, 9001), (9001, 9002), (9100, 9101)], "src long, dst long"))
    got = {r.node for r in G.reach(edges, spark.range(1).toDF("node")).collect()}
    assert got == set(range(n + 1)) | {9001, 9002}


def test_chain_past_the_recursion_limit(spark):
    spark.range(151).selectExpr("id AS src", "id + 1 AS dst").createOrReplaceTempView("chain_edges")
    spark.range(1).selectExpr("id AS node").createOrReplaceTempView("chain_root")
    assert G.reach_acyclic(spark, "chain_edges", "chain_root").count() == 152


def test_class_lattice(spark):
    """Two classes a level, each with both of the level above as bases: paths double with each level, rows do not."""
    levels = 30
    rows = [(2 * level + k, 2 * (level - 1) + b, b) for level in range(1, levels) for k in range(2) for b in range(2)]
    up = {(r.cls, r.anc): list(r.path) for r in G.ancestors(spark, spark.createDataFrame(rows, "cls long, base long, ord int")).collect()}
    assert len(up) == sum(1 + 2 * level for level in range(levels)) * 2
    assert up[58, 0] == [0] * 29 and up[58, 1] == [0] * 28 + [1] and up[7, 7] == []


def test_rapid_types_query_by_sets(spark):
    """The registered query against sets that grow one by one, over the same forest of 25 classes."""
    from corpusloom.plans.queries import QUERIES

    bases = {k: [k // 2] * (k > 0) + [k // 3] * (k > 0 and k % 6 == 0) for k in range(25)}
    symbol = {k: f"c{k}::m{k % 3}" for k in range(25)}

    def above(c):
        return {c}.union(*[above(b) for b in bases.get(c, [])])

    def means(c, name):
        if c % 3 == name:
            return c
        return next((m for b in bases[c] if (m := means(b, name)) is not None), None)

    def closed(live):
        while more := {a + 1 for c in live if c < 25 for a in above(c) if a and a % 7 == 0} - live:
            live = live | more
        return live

    def reached(live):
        seen, todo = set(), [0]
        while todo:
            k = todo.pop()
            if k in seen:
                continue
            seen.add(k)
            targets = {means(c, (k + 1) % 3) for c in live if c < 25 and k // 4 in above(c)} - {None}
            todo += [m for m in targets if m % 4 != 1]
        return seen

    live, rounds = closed({1}), 0
    while True:
        rounds += 1
        bodies = reached(live)
        grown = closed(live | {k + 5 for k in bodies if k % 3 == 0})
        if grown == live:
            break
        live = grown
    wanted = {("live", str(c)) for c in live} | {("reach", symbol[k]) for k in bodies} | {("reach", "main"), ("rounds", str(rounds))}
    got = [tuple(r) for r in QUERIES["grf_08_rta"](spark, "/root/testdata/sf0.001").collect()]
    assert set(got) == wanted and len(got) == len(wanted)
