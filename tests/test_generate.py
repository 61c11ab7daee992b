import json

import pytest
from corpusloom.functions.scalars import CLASSES
from corpusloom.operators import generate as G
from corpusloom.operators import graph, profile
from corpusloom.operators.rng import Stream
from pyspark.sql import functions as F


def test_trees(spark):
    edges, root = G.chain(spark, 1)
    assert (edges.count(), root) == (1, 1)
    edges, n = G.call_tree(spark, 200, 3, leaves=5, fraction=0.8, seed=4)
    reached = graph.reach(edges, spark.range(1).withColumnRenamed("id", "node")).count()
    assert reached == 205 and n == 256 and edges.groupBy("dst").count().where("count = 2").count() == 5
    assert G.call_tree(spark, 10_000, 2, depth=3)[1] == 15
    quadrants = G.indirect_plan(spark, 4).select("dispatched", "want_dead").distinct().count()
    assert quadrants == 4


def test_sources_call_each_other(spark):
    f = G.sources(spark, 5, 1, headers=3, body=4)
    sites = G.call_sites(f)
    assert sites.where("kind = 'def'").count() == 5 and {r.name for r in sites.where("kind = 'ref'").collect()} == {f"func_{i}" for i in range(4)}
    assert f.orderBy("path").collect() == G.sources(spark, 5, 1, headers=3, body=4).orderBy("path").collect()


@pytest.mark.parametrize(("defines", "most"), [(10, 10**6), (5000, 10**6), (5000, 20_000), (1, 500)])
def test_register_header(spark, defines, most):
    rows = G.register_header(spark, "a/reg.h", defines, most, 7).orderBy("n").collect()
    text = "".join(r.text for r in rows)
    made = text.count("#define HWIO")
    assert len(text) <= most and text.endswith("#endif\n") and (made == defines if most == 10**6 else made <= defines)
    if made < defines:
        assert len(text) + 220 > most


@pytest.mark.parametrize("label", sorted(CLASSES))
def test_content_reads_as_its_class(spark, label):
    raw = G.synthesized(label, 6000, Stream(1, 2, 3))
    row = profile.file_stats(spark.createDataFrame([("f", bytearray(raw))], "path string, content binary")).first()
    assert row["class"] == ("inline-function-heavy" if label == "template-metaprogramming" else label)


def test_populations(spark):
    dup = G.duplicates(spark, 3, 2, 1)
    by = {(r.group, r.near): r.n for r in dup.groupBy("group", "near", F.sha2("content", 256)).agg(F.count("*").alias("n")).collect()}
    assert all(by[g, False] == 2 and by[g, True] == 1 for g in range(3))
    hot = [bytes(r.content).count(b"acc += broad_hot") for r in G.broad_token(spark, 4, 0.5, 1, lines=100).collect()]
    assert sorted(hot) == [0, 0, 5, 5]
    classes = {r.path.rsplit("_", 1)[1]: r.encoding for r in profile.file_stats(G.encoding_mix(spark, 5, 1)).collect()}
    assert classes["utf16le.c"] == "utf-16le" and classes["utf8bom.c"] == "utf-8" and classes["nonascii.c"] == "ascii"
    assert [len(r.content) for r in G.long_lines(spark, 2, 1000, 1).orderBy("path").collect()] in ([1001, 1000], [1000, 1001])
    patho = bytes(G.pathological_symbols(spark, 1, 1).first().content).decode()
    assert "patho0_handler_3" not in patho and "CS_MK_HANDLER(3)" in patho
    assert all(d.count() == 2 for d in (G.unresolved_includes(spark, 2, 1), G.tiny_files(spark, 2, 1), G.blobs(spark, 2, 1, 10), G.ordinary_headers(spark, 2, 1)))


def test_profiles_regenerate(spark):
    a = spark.createDataFrame([("x", ".c", 4, "generic-code", 2000, 5000, 9000), ("y", ".csv", 3, "tabular-data", 100, 200, 300)], "label string, ext string, count long, class string, p50 long, p90 long, max long")
    got = G.from_archetypes(a, 5)
    assert got.count() == 7 and sorted(got.collect()) == sorted(G.from_archetypes(a, 5).repartition(3).collect())


def test_small_helpers(spark):
    assert [G.effective(1375, 0.01), G.effective(12, 0.01, keep_one=True), G.effective(12, 0.01), G.effective(5, 0.1, True), G.effective(0, 1, keep_one=True)] == [14, 1, 0, 5, 0]
    db = G.compile_db(["u.c"], "/old", ["inc"])
    assert json.loads(G.rebased(db, "/old", "/new"))[0] == {"directory": "/new", "file": "u.c", "command": "clang -I/new/inc -c u.c"}
    assert G.expand_preset("ci", {"scale": 1}) == {"scale": 1} and len(G.PRESETS) == 14
    dirs = spark.createDataFrame([("a", 1), ("b", 3)], "dir string, weight long")
    picks = spark.createDataFrame([(1, 0), (2, 2**30), (3, 2**32 - 1)], "id int, draw long")
    assert {r.id: r.dir for r in G.directories_by_weight(dirs, picks).collect()} == {1: "a", 2: "b", 3: "b"}
    lines = spark.createDataFrame([("a.h", 1, "class Foo;"), ("a.h", 2, 'Foo f("Foo"); Food x;'), ("a.h", 3, "class Foo {")], "path string, n int, content string")
    classes = spark.createDataFrame([("Foo", "ns::Foo", "a.h:3")], "name string, symbol string, def_site string")
    assert sorted(r.site for r in G.class_references(lines, classes).collect()) == ["a.h:1", "a.h:2"]
