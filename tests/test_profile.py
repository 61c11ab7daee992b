import pytest
from corpusloom.functions.bytes import looks_binary, made_binary, strict_text, trigram_sets
from corpusloom.operators import profile as P

CASES = [
    (b"", "text"),
    (b"\0" * 2048, "binary"),
    (b"0123456789" * 400, "data-blob-high-entropy"),
    (b"0," * 2000, "data-blob-repetitive"),
    (b"#define REG_ALPHA_ADDR value\n" * 60, "preprocessor-dense"),
    (b"ENTRY(alpha, beta)\n" * 40, "x-macro"),
    (b"template <class T> struct Wrap { T v; };\n" * 30, "template-metaprogramming"),
    (b"static int fn(int x){ int a=x; return a; }\n" * 60, "inline-function-heavy"),
    (b"enum Color { Red, Green };\n" * 40, "enum-struct-table"),
    (b"alpha,beta,gamma,delta,epsilon\n" * 40, "tabular-data"),
    (b"".join(b"int api_%d(int handle, const char *name);\n" % i for i in range(40)), "generic-code"),
    (b"function(){return this;}" * 6000, "minified-longline"),
    (b"".join(b"int var_%d = %d;\n" % (i, i) for i in range(40)) + b"int compute(int x){ return x + 1; }\n", "generic-code"),
    (b"the quick brown fox jumps over the lazy dog\n" * 20, "text"),
]


def test_classes(spark):
    files = spark.createDataFrame([(str(i), bytearray(c)) for i, (c, _) in enumerate(CASES)], "path string, content binary")
    found = {int(r.path): r["class"] for r in P.file_stats(files).collect()}
    assert [found[i] for i in range(len(CASES))] == [c for _, c in CASES]


def test_utf16_is_not_binary(spark):
    raw = b"\xff\xfe" + "hello world this is text".encode("utf-16-le")
    row = P.file_stats(spark.createDataFrame([("a", bytearray(raw))], "path string, content binary")).first()
    assert (row["class"] != "binary", row.encoding, row.bom) == (True, "utf-16le", True)


@pytest.mark.parametrize(("raw", "n"), [(b"abcd", 2), (b"aaaa", 1), (b"", 0), (b"ab", 0)])
def test_trigrams(spark, raw, n):
    assert trigram_sets(spark.createDataFrame([("g", bytearray(raw))], "g string, c binary"), "g", "c").count() == n


def test_percentile_index(spark):
    files = spark.createDataFrame([("a", s) for s in (1, 2, 3, 10)], "k string, size long")
    assert tuple(P.size_percentiles(files, "k").first()) == ("a", 4, 3, 10, 10)


def test_include_stats(spark):
    targets = spark.createDataFrame([("a.c", t) for t in ("b.h", "missing.h", "dup.h")], "file string, target string")
    names = spark.createDataFrame([("b.h", 1), ("dup.h", 2)], "name string, count long")
    assert tuple(P.include_stats(targets, names).first()) == (3, 1, 1, 333)


def test_name_like_extensions(spark):
    files = spark.createDataFrame([(f"d{i}/x.acme", ".acme") for i in range(2)] + [(f"d{i}/x.team", ".team") for i in range(3)] + [("d/x.c", ".c")], "path string, ext string")
    assert {r.ext for r in P.fold_name_like_extensions(files).collect()} == {"(other)", ".team", ".c"}


def test_profile_postures(spark):
    files = spark.createDataFrame([(f"a/f{i}.c", 40, bytearray(b"int f(int x){ return x; }\n" * 2)) for i in range(6)], "path string, size long, content binary")
    assert "classes" not in P.profile(files, posture="structure-only")
    full = P.profile(files, posture="content-stats")
    assert full["classes"].first()["class"] == "inline-function-heavy"
    assert full["content"].count() == 1 and "functions_per_kb" in full["densities"].columns
    assert "functions_per_kb" not in P.profile(files)["densities"].columns


def test_text_and_binary():
    assert strict_text(b"\xff\xfea\0") == ("a", "utf-16-le")
    assert strict_text(b"a\0b") is None and strict_text(b"\xff\xfe\0\0") is None and strict_text(b"\xc3") is None
    assert looks_binary(b"a\0") and not looks_binary(b"\xff\xfea\0")
    import numpy as np

    made = made_binary(b"hello world", np.array([0]))
    assert made[4] == 0 and made[0] == ord("h") ^ 0x5A and looks_binary(made)


def test_closure_and_carve_summaries(spark):
    c = spark.createDataFrame([("u1", 1, 10), ("u2", 2, 20), ("u3", 3, 30), ("u4", 10, 100)], "unit string, files long, bytes long")
    assert tuple(P.closure_summary(c).first()) == (4, 3, 10, 10, 30, 100, 100)
    d = spark.createDataFrame([("a", 10, 1), ("b", 20, 1), ("c", 30, 2)], "name string, length long, terminator long")
    k = spark.createDataFrame([("a", "keep"), ("b", "drop"), ("c", "open")], "name string, cls string")
    assert tuple(P.carve_bounds(d, k, 100).first()) == (3, 1, 2, 50, 81)
    n = spark.createDataFrame([("L1_a",), ("L1_b",), ("L2_a",), ("x",)], "name string")
    assert sorted(tuple(r) for r in P.level_recounts(n, r"^L(\d+)_").collect()) == [(1, 2, "L1_a", "L1_b"), (2, 1, "L2_a", "L2_a")]
