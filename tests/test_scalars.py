import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from corpusloom.functions import scalars as S
from corpusloom.functions import text as T
from corpusloom.plans.queries import QUERIES, SQL
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("name", "ext"), [("a.C", ".c"), ("noext", "(none)"), (".profile", "(dotfile)"), ("x.b d", "(other)"), ("a.tar.gz", ".gz"), ("a.", "(none)"), ("d.h++", ".h++")])
def test_extension(spark, name, ext):
    assert one(spark, name, S.extension) == ext


@pytest.mark.parametrize(("v", "r"), [(0, 0), (999, 999), (1000, 1000), (1347, 1350), (840043, 840000), (1345, 1350), (99950, 100000)])
def test_round3(spark, v, r):
    assert one(spark, v, S.round3, "long") == r


@pytest.mark.parametrize(("size", "band"), [(0, 0), (1023, 0), (1024, 1), (1 << 30, 7), ((1 << 30) - 1, 6)])
def test_band(spark, size, band):
    assert one(spark, size, S.size_band, "long") == band


def test_sites(spark):
    assert one(spark, "a:b.c:12", S.site_path) == "a:b.c"
    assert one(spark, "a/b.c:12", S.site_line) == 12
    assert one(spark, "a/b.c:x", S.site_line) is None
    assert one(spark, "a/b.c:012", S.is_site) is False


@pytest.mark.parametrize(("path", "inside"), [("a/b", True), ("../a", False), ("a/../../b", False), ("/a", False), ("a/../b", True), ("C:/a", False)])
def test_contained(spark, path, inside):
    assert one(spark, path, S.contained) is inside


def test_glob(spark):
    assert one(spark, ".text.a/b", lambda c: S.glob_match(c, ".text.*")) is True
    assert one(spark, "ab", lambda c: S.glob_match(c, "a?c")) is False


def test_spelling(spark):
    assert [one(spark, v, S.spelled_class) for v in ("ZaZ", "YbY", "Z", "abc")] == ["drop", "open", "keep", "keep"]


def test_whole_word(spark):
    row = spark.createDataFrame([("x ~foo(foobar) a.b", "foo", "a.b", "bar")], "t string, a string, b string, c string")
    w = lambda c, t=False: S.whole_word(F.col("t"), F.col(c), t)
    assert tuple(row.select(w("a"), w("a", True), w("b"), w("c")).first()) == (True, False, True, False)


def test_line_models(spark):
    df = spark.createDataFrame([("p", "a\r\nb\rc\n")], "path string, text string")
    assert [(r.n, r.content, r.term) for r in T.lines_any(df, "text", "path").collect()] == [(1, "a", "\r\n"), (2, "b", "\r"), (3, "c", "\n")]
    assert [(r.line, r.has_cr) for r in T.lines_lf(df, "text", "path").orderBy("n").collect()] == [("a", True), ("b\rc", False), ("", False)]


@pytest.mark.parametrize(("line", "target"), [('#include "a/B.h"', "b.h"), ("# include <x\\Y.hpp>", "y.hpp"), ("#include MACRO", ""), ('#include "open', "")])
def test_include_target(spark, line, target):
    assert one(spark, line, T.include_target) == target


def test_qualified(spark):
    got = spark.createDataFrame([("ns::A<B<int>>::f",)], "v string").select(*S.owner_and_last(F.col("v"))).first()
    assert tuple(got) == ("ns::A::f", "ns::A", "f")


def test_bytes_of_whole_texts(spark, tmp_path):
    """Empty texts and texts longer than a profile's prefix count whole; one with a character beyond 16 bits is left out."""
    texts = {0: "", 1: None, 2: "a\0\u0100\u00e9", 3: "x\U0001f600", 4: "\u00e9" * 2_097_151, 5: "\u00e9" * 2_100_000, 6: "x1" * 2_150_000}
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    pq.write_table(pa.table({"doc_id": list(texts), "text": list(texts.values())}, kinds), tmp_path / "documents.parquet")
    found = lambda name: {r.doc_id: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert found("txt_02_thinned") == {0: 0, 2: 2, 4: 2_097_151, 5: 2_100_000, 6: 4_300_000}
    assert found("txt_03_printable")[6] == found("txt_04_digitish")[6] == 4_300_000 and found("txt_05_entropy")[6] == 1.0


def test_odd_rows_by_sql(spark, tmp_path):
    """Empty texts, rows without a doc_id, and rows that share one, of which one may be wide."""
    rows = [(0, ""), (1, "ab"), (2, "c"), (2, "de"), (3, "f"), (3, "\U0001f600"), (None, "g"), (None, "h"), (4, None)]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), tmp_path / "documents.parquet")
    wanted = duckdb.execute(SQL["txt_02_thinned"].replace("documents", f"'{tmp_path}/documents.parquet'")).fetchall()
    assert set(wanted) == {(0, 0), (1, 2), (2, 3), (None, 2)}
    assert sorted((tuple(r) for r in QUERIES["txt_02_thinned"](spark, str(tmp_path)).collect()), key=repr) == sorted(wanted, key=repr)
