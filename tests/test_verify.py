from corpusloom.operators import verify as V
from pyspark.sql import functions as F


def test_tampering_is_found(spark):
    symbols = spark.createDataFrame([("f",), ("g",)], "name string")
    assert V.undeclared_roots(spark.createDataFrame([("f",), ("x",)], "name string"), symbols).first().key == "x"
    assert V.dangling_edges(spark.createDataFrame([("f", "g"), ("f", "x")], "src string, dst string"), symbols).first().dst == "x"
    lines = spark.createDataFrame([("a.c", 1, "int f(int x) {"), ("a.c", 2, "return g;"), ("a.c", 3, "#ifdef VENDOR_OK")], "path string, n int, content string")
    sites = spark.createDataFrame([("f", "a.c:1"), ("f", "a.c:2"), ("f", "a.c:9"), ("f", "a.c:01")], "name string, site string")
    assert {r.site: r.reason for r in V.site_mismatches(sites, lines, definition=True).collect()} == {"a.c:2": "line does not hold the name", "a.c:9": "no such line", "a.c:01": "site is not canonical"}
    assert V.gated_refs(spark.createDataFrame([("g", "a.c:2")], "name string, site string"), lines).count() == 0
    assert V.gated_refs(spark.createDataFrame([("g", "a.c:2")], "name string, site string"), lines.where("n < 3")).first().reason == "file has no guard"
    miss = spark.createDataFrame([("made", "a.c:2", "g"), ("g", "a.c:2", "g"), ("m", "a.c:2", "h")], "name string, site string, macro string")
    assert {r.key: r.reason for r in V.expected_misses(miss, lines).collect()} == {"g": "the name is literally there", "m": "the macro is not there"}
    assert V.undeclared_definitions(lines, spark.createDataFrame([("b.c", 1)], "path string, n int"), r"\) \{$").first().key == "a.c:1"


def test_groups(spark):
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x")), ("c", bytearray(b"y"))], "path string, content binary")
    sha = files.select(F.sha2("content", 256).alias("s")).first().s
    g = spark.createDataFrame([("g", sha, ["a", "b", "d"], ["c", "b"])], "name string, sha256 string, paths array<string>, near_variants array<string>")
    assert {r.site: r.reason for r in V.dup_group_mismatches(g, files).collect()} == {"d": "file is missing", "b": "variant is identical"}


def test_includes_resolve_in_order(spark):
    inc = spark.createDataFrame([(1, "src", "a.h", False, -1, False), (2, "src", "a.h", True, -1, False), (3, "inc", "a.h", True, 0, True), (4, "src", "../../x.h", False, -1, False)], "id int, from_dir string, spec string, angled boolean, found_idx int, next boolean")
    dirs = spark.createDataFrame([(0, "inc"), (1, "inc2")], "idx int, dir string")
    files = spark.createDataFrame([("src/a.h",), ("inc/a.h",), ("inc2/a.h",)], "path string")
    assert {r.id: (r.path, r.idx) for r in V.resolve_includes(inc, dirs, files).collect()} == {1: ("src/a.h", -1), 2: ("inc/a.h", 0), 3: ("inc2/a.h", 1)}


def test_names_shadow(spark):
    refs = spark.createDataFrame([(1, "f"), (2, "f")], "unit int, name string")
    nodes = spark.createDataFrame([("1:f", 1, "f", True), ("f", 0, "f", False)], "key string, unit int, name string, local boolean")
    assert sorted((r.unit, r.key) for r in V.resolve_names(refs, nodes).collect()) == [(1, "1:f"), (2, "f")]


def test_affixes(spark):
    names = spark.createDataFrame([(x,) for x in ("abc", "abcabc", "ab1c", "abXc", "c")], "name string")
    p = spark.createDataFrame([(1, "ab", "c"), (2, "", "c"), (3, "abcab", "bc")], "id int, prefix string, suffix string")
    got = {}
    for r in V.affix_matches(p, names).collect():
        got.setdefault(r.id, set()).add(r.name)
    assert got == {1: {"abc", "abcabc", "ab1c", "abXc"}, 2: {"abc", "abcabc", "ab1c", "abXc", "c"}}
    assert [r.name for r in V.affix_matches(p, names, digits_only=True).where("id = 1").collect()] == ["ab1c"]


def test_kinds_bases_verdict(spark):
    symbols = spark.createDataFrame([("C", "class"), ("m", "method"), ("k", "ctor")], "name string, kind string")
    e = spark.createDataFrame([("a", "C", "direct"), ("a", "k", "implicit"), ("a", "m", "implicit"), ("a", "z", "direct")], "src string, dst string, sort string")
    assert {r.key for r in V.kind_mismatches(e, symbols).collect()} == {"a->C", "a->m", "a->z"}
    cl = spark.createDataFrame([("D", "class D : public A, private virtual B {"), ("E", "struct E {")], "cls string, content string")
    bases = spark.createDataFrame([("D", ["B", "A"]), ("E", [])], "cls string, declared array<string>")
    wrong = V.base_mismatches(cl, bases)
    assert [r.key for r in wrong.collect()] == ["D"]
    checked = spark.createDataFrame([("bases", 2), ("kind", 4)], "check string, n long")
    assert {tuple(r) for r in V.verdict(checked, wrong).collect()} == {("bases", 1, 1), ("kind", 4, 0)}
    assert len(V.report(V.kind_mismatches(e, symbols), 2)) == 3
    lists = spark.createDataFrame([("a", ["x", "x"]), ("b", ["x"])], "k string, v array<string>")
    assert [r.key for r in V.repeated_items(lists, "k", "v").collect()] == ["a"]
    assert V.compile_db_mismatches(spark.createDataFrame([("u",), ("w",)], "unit string"), spark.createDataFrame([("u", ["b", "a"])], "unit string, incs array<string>"), ["a", "b"]).count() == 2
    assert V.refs_on_definitions(spark.createDataFrame([("r", "s:1")], "name string, site string"), spark.createDataFrame([("s:1",)], "site string")).count() == 1


def test_includes_with_nested_dots(spark):
    includes = spark.createDataFrame([(1, "a/b/c", "../../d.h", False, -1, False), (2, "a/b/c", "./.././x/../e.h", False, -1, False), (3, "a", "../../d.h", False, -1, False)], "id int, from_dir string, spec string, angled boolean, found_idx int, next boolean")
    files = spark.createDataFrame([("a/d.h",), ("a/b/e.h",), ("d.h",)], "path string")
    dirs = spark.createDataFrame([(0, "inc")], "idx int, dir string")
    assert {r.id: r.path for r in V.resolve_includes(includes, dirs, files).collect()} == {1: "a/d.h", 2: "a/b/e.h"}


def test_affixes_of_any_length(spark):
    names = [f"{a}{b}{c}" for a in ("pre", "p", "", "prefix") for b in ("", "1", "mid") for c in ("", "s", "suf")]
    patterns = [(i, p, q) for i, (p, q) in enumerate((p, q) for p in ("", "p", "pre", "prefix") for q in ("", "s", "suf") if p or q)]
    got = {(r.id, r.name) for r in V.affix_matches(spark.createDataFrame(patterns, "id int, prefix string, suffix string"), spark.createDataFrame([(n,) for n in set(names)], "name string")).collect()}
    assert got == {(i, n) for i, p, q in patterns for n in set(names) if n.startswith(p) and n.endswith(q) and len(n) >= len(p) + len(q)}
