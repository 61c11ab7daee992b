"""Golden vectors, and what digests must and must not depend on."""

import hashlib

from corpusloom.operators import digest as G
from pyspark.sql import functions as F

TRUTH = "7de5e47c16574fd481e461173401dbbe2c874e8712c61049b8830c3a78775d6e"
INDIRECT = "fa9432bd75cd97b7d0a509f885f964b86b8ef41d449cc8c23b1b79df1aa1572f"
DIFF = "66c7e62566ee105e63dce7e770d47e1a9fbe71b86d50249e209f5bf41f03d542"
CONFLICT = "68cd14ac9a54521fc967f8c4632536bb9f0725cd394b8296cd1d62d4a9310e6a"

SYMBOLS = "name string, def string, refs array<string>, edges array<string>, expected_miss boolean"


def truth(spark, rows):
    return G.truth_sha(spark.createDataFrame(rows, SYMBOLS)).first().sha


def test_truth(spark):
    rows = [("func_0", "block1/src_0.c:11", ["block1/src_1.c:14"], [], False), ("func_1", "block1/src_1.c:12", [], ["func_0"], False)]
    assert truth(spark, rows) == TRUTH == truth(spark, rows[::-1])
    assert truth(spark, [rows[0], (*rows[1][:4], True)]) != TRUTH
    assert truth(spark, [rows[0], (*rows[1][:3], ["func_0", "func_0"], False)]) != TRUTH


def test_indirect(spark):
    e = spark.createDataFrame([("func_0", "itgt_0", "fnptr", True, True), ("func_0", "iext_1", "vector-table", False, False), ("func_1", "itgt_0", "init_array", True, True)], "source string, target string, via string, dispatched boolean, resolved boolean")
    roots = spark.createDataFrame([("func_0",)], "name string")
    assert G.indirect_sha(e, roots).first().sha == INDIRECT == G.indirect_sha(e.union(e), roots).first().sha


def test_diff(spark):
    files = spark.createDataFrame([("z/last.c", "content", "o1", "n1", 100, 110), ("a/first.c", "content", "o2", "n2", 200, 205), ("big.h", "content", "o3", "n3", 1048576, 1050000)], "path string, reason string, old_sha string, new_sha string, old_size long, new_size long")
    hunks = spark.createDataFrame([("z/last.c", "replace", 5, 2, 5, 2), ("a/first.c", "replace", 1, 1, 1, 1), ("a/first.c", "replace", 9, 3, 9, 3)], "path string, op string, old_start long, old_lines long, new_start long, new_lines long")
    runs = spark.createDataFrame([("big.h", "replace", 20, 1, 5000, 1)], "path string, op string, stride long, range_start long, range_end long, per_hunk long")
    none = spark.createDataFrame([], "`from` string, `to` string, similarity_milli long")
    assert G.diff_sha(files, hunks, runs, none).first().sha == DIFF


def test_conflict(spark):
    c = spark.createDataFrame([("f.c", 5, 1, "replace", 5, 1, "replace", 5, 1), ("a.c", 9, 2, "replace", 9, 2, "delete", 9, 0)], "path string, base_start long, base_lines long, v1_op string, v1_new_start long, v1_new_lines long, v2_op string, v2_new_start long, v2_new_lines long")
    m = spark.createDataFrame([("f.c", "v1", "replace", 3, 1, 3, 1), ("a.c", "v2", "insert", 7, 0, 7, 2)], "path string, side string, op string, old_start long, old_lines long, new_start long, new_lines long")
    assert G.conflict_sha(c, m).first().sha == CONFLICT


def test_empty_sections(spark):
    none = spark.createDataFrame([], "source string, target string, via string, dispatched boolean, resolved boolean")
    assert G.indirect_sha(none, spark.createDataFrame([], "name string")).first().sha == "1f18d650d205d71d934c3646ff5fac1c096ba52eba4cf758b865364f4167d3cd"


def test_sections_over_many_parts(spark):
    """Records of several sections in many parts and batches, repeated ones on both sides of a batch's edge, a record longer
    than a piece; sections at either end and between may be empty."""
    none = spark.createDataFrame([], "v string")
    some = [f"k{i * 7919 % 5000:05d}" for i in range(9000)] + ["", "é", "\U0001f600", "\uffff", "x" * 3 * G.PIECE] * 2
    df = spark.createDataFrame([(x,) for x in some], "v string").repartition(5)
    text = lambda rows: "".join(x + G.RS for x in sorted(rows, key=str.encode))
    sha = lambda *parts: hashlib.sha256(G.GS.join(parts).encode()).hexdigest()
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        once, each = G.section(df, G.record("v")), G.section(df, G.record("v"), False)
        assert G.combined(once).first().sha == sha(text(set(some)))
        assert G.combined(each).first().sha == sha(text(some))
        empty = G.section(none, G.record("v"))
        assert G.combined(empty, once, empty, each, empty).first().sha == sha("", text(set(some)), "", text(some), "")
        assert G.combined(empty).first().sha == sha("") and G.combined(empty, empty).first().sha == sha("", "")
        held = G.pieces([each]).agg(F.max(F.octet_length("text")), F.sum(F.octet_length("text")), F.count_distinct("part")).first()
        assert held[0] == G.PIECE and held[1] == len(text(some).encode()) and held[2] == 4  # no row holds a section
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_tree_and_list(spark):
    files = spark.createDataFrame([("b", bytearray(b"2")), ("a", bytearray(b"11"))], "path string, content binary")
    assert G.tree_sha(files) == hashlib.sha256(b"a\n2\n11b\n1\n2").hexdigest()
    assert G.list_sha(["a", "b"]) == (hashlib.sha256(b"a\nb\n").hexdigest(), 2)
    assert tuple(G.list_sha_row(spark.createDataFrame([("b",), ("a",)], "n string"), "n").first()) == G.list_sha(["a", "b"])


def test_manifest_identity_is_manifest_sha(spark):
    from pyspark.sql import functions as F

    cases = [("a\r\n/r/x\nleaf 1\nz\n", "/r", "leaf"), ("", "/r", "leaf"), ("one", "", "x"), ("one\ntwo", "o", ""), ("\n\n", "q", "q"), ("a.b\n(c)", ".", "("), ("é\nü\n", "é", "ü")]
    rows = spark.createDataFrame([*cases, (None, "a", "b")], "raw string, root string, leaf string")
    got = {tuple(r)[:3]: r.sha for r in rows.withColumn("sha", G.manifest_identity(F.col("raw"), F.col("root"), F.col("leaf"))).collect()}
    assert got.pop((None, "a", "b")) is None
    assert got == {c: G.manifest_sha(c[0].encode(), c[1], c[2]) for c in cases}
