"""Orders in two levels, states over lines, trees and shards: against plain Python, with hot, empty and odd input."""

import bisect
import hashlib
import json
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import literals as L
from corpusloom.operators import order as O
from corpusloom.sources import manifests as M
from corpusloom.sources import tree as T


def test_running_and_carried(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 0, 1, 7, 10**12]), f"g{r.randrange(3)}", r.choice([None, None, None, i])) for i in r.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k long, v long, g string, mark long").repartition(7)
    total, want = 0, {}
    for k, v, _, _ in sorted(rows):
        total += v or 0
        want[k] = total
    assert {x.k: x.upto for x in O.running(df, F.col("v"), ["k"]).collect()} == want
    last, want = {}, {}
    for k, _, g, mark in sorted(rows):
        last[g] = mark if mark is not None else last.get(g)
        want[k] = last[g]
    for block in (1, 90, 100_000):
        assert {x.k: x.carried for x in O.carried(df, F.col("mark"), ["g"], "k", block).collect()} == want
    assert O.running(df.limit(0), F.col("v"), ["k"]).collect() == O.carried(df.limit(0), F.col("mark"), ["g"], "k", 9).collect() == []


@pytest.mark.parametrize("weights", [[1] * 50, [10**12, *[1] * 40], [None, 0, 5, 0, 3, -2], [0, None], [], [7]])
def test_weighted_picks(spark, weights):
    """One weight over all buckets, many in one bucket, weights that get nothing, draws at both ends, repeated draws."""
    r = random.Random(2)
    draws = [(i, d) for i, d in enumerate([0, 2**32 - 1, 2**31, None, 5, 5, *[r.getrandbits(32) for _ in range(300)]])]
    got = O.weighted_picks(spark.createDataFrame(draws, "id long, draw long"), spark.createDataFrame([(f"n{i:03d}", w) for i, w in enumerate(weights)], "dir string, weight long"), "id", "dir")
    named = [(f"n{i:03d}", w) for i, w in enumerate(weights) if w and w > 0]
    sums = [sum(w for _, w in named[: i + 1]) for i in range(len(named))]
    want = {i: named[bisect.bisect_right(sums, sums[-1] * d >> 32)][0] for i, d in draws if d is not None} if sums else {}
    assert {x.id: x.dir for x in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("n", "most"), [(0, 10), (1, 1), (137, 3), (137, 10**6), (400, 5), (10**6, 5)])
def test_chosen(spark, n, most):
    rows = [(i % 700, "x" if i % 3 else "y") for i in range(1000)]  # 300 keys stand twice
    df = spark.createDataFrame(rows, "k long, kind string")
    key = lambda k: hashlib.md5(f"9:{k}".encode()).hexdigest()
    want = sorted((k for k, kind in rows if kind == "x"), key=lambda k: (key(k), k))[:n]
    assert sorted(x.k for x in O.chosen(df, n, "k", 9, F.col("kind") == "x", most_sorted=most).collect()) == sorted(want)


def plan_of(files, edits, seed):
    pools = {p: sorted(f for f, q in files if q == p) for p in ("source", "grow", "shrink")}
    pools["source"].sort(key=lambda f: (hashlib.md5(f"{seed}:{f}".encode()).hexdigest(), f))
    kinds = ["remove", "line-shift", "add", *["grow"] * bool(pools["grow"]), *["shrink"] * bool(pools["shrink"])]
    out, used = [], {"source": 0, "grow": 0, "shrink": 0}
    for k in range(edits):
        kind = kinds[k % len(kinds)]
        pool = "source" if kind in ("remove", "line-shift") else kind
        path = f"mut_add_{k}.c" if kind == "add" else None
        if kind != "add":
            at = used[pool] % len(pools[pool]) if kind == "grow" else used[pool]
            path = pools[pool][at] if at < len(pools[pool]) else None
            used[pool] += 1
        out.append((k, kind, path, None if path else f"no file is left for {kind}"))
    return out


@pytest.mark.parametrize(("sources", "grow", "shrink", "edits"), [(20, 1, 5, 40), (6, 0, 0, 9), (3, 4, 1, 30), (0, 0, 0, 4), (5, 3, 3, 0), (2, 30, 0, 8)])
def test_edit_plan(spark, sources, grow, shrink, edits):
    files = [(f"{p}{i}", p) for p, n in (("source", sources), ("grow", grow), ("shrink", shrink)) for i in range(n)] + [("other", "none"), ("null", None)]
    got = O.edit_plan(spark.createDataFrame(files, "path string, pool string"), edits, 4)
    assert sorted(tuple(x) for x in got.select("step", "kind", "path", "error").collect()) == plan_of(files, edits, 4)


def test_states_over_lines(spark):
    """Against one pass over whole files, with blocks of two lines, files of one line and of none."""
    r = random.Random(3)
    bits = ["name", "/*", "*/", '"', '\\"', "//", "'", 'R"(', ')"', "/*/", " x1", "\\", "a.b"]
    texts = [[" ".join(r.choice(bits) for _ in range(r.randrange(5))) for _ in range(r.choice((1, 2, 9, 40)))] for _ in range(60)]
    rows = [(f"f{i}", n, line or None) for i, t in enumerate(texts) for n, line in enumerate(t, 1)]
    token = re.compile(r"""(?<![A-Za-z0-9_])R"\(.*?\)"|(?<![A-Za-z0-9_])R"\(.*|"(?:[^"\\\n]|\\[^\n])*"?|'(?:[^'\\\n]|\\[^\n])*'?|//[^\n]*|/\*.*?\*/|/\*.*""", re.DOTALL)
    want = sorted((f"f{i}", w) for i, t in enumerate(texts) for w in re.findall("[A-Za-z_][A-Za-z0-9_]*", token.sub(" ", "\n".join(t))))
    df = spark.createDataFrame(rows, "path string, n long, content string")
    for block in (2, 7, 256):
        assert sorted((x.path, x.name) for x in L.names_outside(df, block).collect()) == want
    assert L.names_outside(df.limit(0)).collect() == []


def test_listing_and_prefixes(spark, tmp_path):
    """Links to files, to folders and to nothing, an empty folder, a folder too deep to be listed, names with blanks."""
    (tmp_path / "a b" / "empty").mkdir(parents=True)
    (tmp_path / "a b" / "long.bin").write_bytes(bytes(range(256)) * 40)
    (tmp_path / "none").write_bytes(b"")
    os.symlink("a b", tmp_path / "folder-link")
    os.symlink("a b/long.bin", tmp_path / "a b" / "file-link")
    os.symlink("nothing", tmp_path / "dangling")
    os.mkfifo(tmp_path / "pipe")
    here, deep = os.getcwd(), 0
    os.chdir(tmp_path)
    for _ in range(18):  # a path longer than the system takes
        os.mkdir("d" * 250)
        os.chdir("d" * 250)
        deep += 1
    os.chdir(here)
    got = [tuple(x)[:3] for x in T.list_tree(spark, f"file://{tmp_path}").collect()]
    plain = [x for x in got if "ddd" not in x[1]]
    assert sorted(plain) == sorted([("dir", "a b", None), ("dir", "a b/empty", None), ("file", "a b/long.bin", 10_240), ("file", "none", 0), ("link", "folder-link", None), ("link", "a b/file-link", None), ("link", "dangling", None), ("other", "pipe", None)])
    assert sum(x[0] in ("closed", "unreadable") for x in got) == 1
    read = {x.path: (x.size, x.n_read, bytes(x.content)) for x in T.read_prefixes(spark, str(tmp_path), most=1000, bin_bytes=3000).collect()}
    assert read == {"a b/long.bin": (10_240, 1000, (bytes(range(256)) * 4)[:1000]), "none": (0, 0, b"")}


def test_shards_are_whole_or_absent(spark, tmp_path):
    """A task that fails, after others have written whole shards, leaves no index, no shard and no private file."""
    at = str(tmp_path / "shards")
    rows = spark.range(500).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("key"), F.concat(F.lit("a\r"), F.col("id").cast("string")).alias("line"))
    broken = rows.withColumn("line", F.when(F.col("key") == "0431", F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        T.write_shards(broken, "key", 20, at)
    assert [x.collect() for x in T.read_shards(spark, at)] == [[], []] and (not os.path.exists(at) or os.listdir(at) == [])
    T.write_shards(rows, "key", 20, at)
    lines, index = T.read_shards(spark, at)
    assert sorted(x.line for x in lines.collect()) == sorted(f"a{i}" for i in range(500))
    assert sorted(tuple(x) for x in index.collect()) == [(s, f"{20 * s:04d}", f"{20 * s + 19:04d}", 20) for s in range(25)]
    assert len(os.listdir(at)) == 26
    T.write_shards(rows.limit(0), "key", 20, str(tmp_path / "none"))
    assert T.read_shards(spark, str(tmp_path / "none"))[1].collect() == []


def test_an_index_is_written_last(tmp_path):
    """Shards of tasks that went well vanish when the job is given up."""
    writer = T.ShardWriter(str(tmp_path))
    done = writer.write([{"shard": 3, "key": "a", "line": "x"}, {"shard": 3, "key": "b", "line": None}])
    assert [n.startswith(".") for n in os.listdir(tmp_path)] == [True]
    writer.abort([done, None])
    assert os.listdir(tmp_path) == []
    with pytest.raises(RuntimeError):
        writer.write(x if x else (_ for _ in ()).throw(RuntimeError()) for x in ({"shard": 1, "key": "a", "line": "x"}, 0))


def test_profiles_and_logs(spark):
    bodies = [("a", '{"archetypes": [{"label": "X", "extension": ".c", "class": "text"}, {"label": "x", "extension": ".C", "class": "text"}, {"class": "text"}, {"class": null}]}'), ("b", "{"), ("c", None), ("d", "{}"), ("e", '{"archetypes": []}'), ("f", "[1]")]
    got = {(x.profile, x.place): x.reason for x in M.read_profiles(spark.createDataFrame(bodies, "profile string, body string"), ("text",)).collect()}
    assert got == {("a", 0): None, ("a", 1): "stands twice", ("a", 2): None, ("a", 3): "unknown class", ("b", None): "not a profile", ("c", None): "not a profile", ("f", None): "not a profile"}
    logs = {"one": ["x", "ld.lld -T a.ld b.o", "y", " ld.lld -o -T -L l -T ../s/./q.ld ../../up/x.a z.o z.o -x.o", "z"], "none": ["cc"], "bare": ["ld.lld a.o"], "null": [None]}
    rows = [(log, n, line) for log, all_ in logs.items() for n, line in enumerate(all_)]
    scopes, lines = M.build_scopes(spark.createDataFrame(rows, "log string, n long, line string"), block=2)
    got = {x.log: (x.n, x.script, x.dirs, x.objects, x.error) for x in scopes.collect()}
    assert got["one"] == (3, "../s/q.ld", ["l"], ["../../up/x.a", "z.o"], None)
    assert got["none"][4] == got["null"][4] == "no ld.lld line" and got["bare"][3:] == (["a.o"], "the link line has no script")
    want = M.read_build_log("\n".join(logs["one"]))
    assert (want["script"], want["dirs"], want["objects"]) == got["one"][1:4]
    assert {x.n: x.linked for x in lines.where("log = 'one'").collect()} == {0: None, 1: 1, 2: 1, 3: 3, 4: 3}


def test_names_are_registered_once():
    from corpusloom.plans.queries import QUERIES
    from corpusloom.plans.registry import query

    def grf_01_reach_direct(spark, sf_dir):
        return None

    assert "grf_01_reach_direct" in QUERIES
    with pytest.raises(ValueError, match="two queries"):
        query()(grf_01_reach_direct)
    assert json.dumps(sorted(QUERIES))


def test_native_streams(spark):
    """Fixed vectors, and draws and sizes of many rows against the streams in plain Python; no Python worker in the plan."""
    from corpusloom.operators import draws as X
    from corpusloom.operators.rng import CATEGORIES, Stream

    one = X.drawn(X.seeded(spark.createDataFrame([(42,)], "i long"), 1337, 7, F.col("i")), "x", "y", "z").first()
    assert [v & (2**64 - 1) for v in (one.x, one.y, one.z)] == [14422954827547773155, 8900491109341867659, 16519258455261250301]
    assert X.drawn(X.seeded(spark.createDataFrame([(42,)], "i long"), 1337, 7, F.col("i")), "x").select(X.below(F.col("x"), 1000)).first()[0] == 781
    r = random.Random(4)
    rows = [(i, *sorted(r.choice((0, 1, 2, 3, 7, 64, 1000, 10**6, 10**9, -5)) for _ in range(3))) for i in [0, -1, 2**62, *range(300)]]
    made = X.sizes(spark.createDataFrame(rows, "i long, p50 long, p90 long, max long"), 11, CATEGORIES["ProfileGen"], F.col("i"))
    assert {x.i: x.size for x in made.collect()} == {i: Stream(11, CATEGORIES["ProfileGen"], i).size(a, b, c) for i, a, b, c in rows}
    plan = X.drawn(X.seeded(spark.range(5), 1, 1, F.col("id")), "x")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_size_query(spark):
    from corpusloom.operators.rng import CATEGORIES, Stream
    from corpusloom.plans.queries import QUERIES

    rows = QUERIES["gen_07_sizes"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 1500 and all(x.size == Stream(11, CATEGORIES["ProfileGen"], x.o_orderkey).size(x.p50, x.p90, x.max) for x in rows)


@pytest.mark.parametrize("least", [1, 2, 4])
def test_similarities_on_hot_lines(spark, least):
    """Against all pairs; one line stands in every text, another in most, counts differ, and some texts are one line."""
    from corpusloom.operators import delta as D

    r = random.Random(least)
    bags = {k: {"hot": 1 + k % 3, **({"warm": 2} if k % 4 else {}), **{f"l{r.randrange(60)}": r.randrange(1, 4) for _ in range(r.choice((0, 1, 3, 12)))}} for k in range(80)}
    df = spark.createDataFrame([(k, line, c) for k, bag in bags.items() for line, c in bag.items()], "key long, line string, c long")
    want = {}
    for a in (k for k in bags if k % 5 == 0):
        for b in bags:
            shared = bags[a].keys() & bags[b].keys()
            if len(shared) >= least:
                common, most = sum(min(bags[a][x], bags[b][x]) for x in shared), max(sum(bags[a].values()), sum(bags[b].values()))
                want[a, b] = (common, (1000 * common + most // 2) // most)
    got = D.similarities(df.where("key % 5 = 0"), df, least=least)
    assert {(x.a, x.b): (x.common, x.milli) for x in got.collect()} == want


def test_hot_lines_make_no_pairs(spark):
    """1,000 texts that share one line, and each of which has one of its own, make no rows that are joined."""
    from corpusloom.operators import delta as D

    rows = [(k, line, 1) for k in range(1000) for line in ("hot", f"own{k}")]
    df = spark.createDataFrame(rows, "key long, line string, c long")
    counts = df.groupBy("line").agg(F.count("*").alias("held"))
    kept = D.without_commonest(df, counts, 1).where(~F.col("common"))
    assert kept.where("line = 'hot'").count() == 0 and kept.count() == 1000
    assert D.similarities(df, df, least=2).where("a <> b").collect() == []


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_searched_texts_against_all_pairs(spark, monkeypatch, few):
    """Copies by the dozen, some with lines of their own, hot lines, texts without shared lines; classes dealt to several
    chunks and tasks, with and without broadcasts."""
    from corpusloom.operators import delta as D

    for name, value in (("CHUNK", 3), ("PAIRS_A_TASK", 50), ("FEW_MARKS", few), ("FEW_BYTES", few)):
        monkeypatch.setattr(D, name, value)
    r, texts = random.Random(5), {}
    for k in range(150):
        kind = k % 7
        texts[k] = ["hot"] * (1 + kind % 2) + ([f"copy{i}" for i in range(kind)] if kind < 4 else [f"l{r.randrange(40)}" for _ in range(r.choice((0, 1, 4, 9)))]) + [f"own{k}"] * (k % 3)
    want = {}
    for a in (k for k in texts if k % 5 == 0):
        for b in texts.keys() - {a}:
            x, y = Counter(texts[a]), Counter(texts[b])
            if len(x.keys() & y.keys()) >= 2:
                common, most = sum((x & y).values()), max(len(texts[a]), len(texts[b]))
                want[a, b] = (common, (1000 * common + most // 2) // most)
    rows = spark.createDataFrame([(k, x) for k, lines in texts.items() for x in lines], "key long, line string").repartition(3)
    got = D.searched(rows, F.col("key") % 5 == 0, 2).collect()
    assert len(got) == len(want) and {(x.a, x.b): (x.common, x.milli) for x in got} == want


def test_copies_are_compared_once(spark):
    """1,000 texts alike in the lines they share are one class, whose pair with itself is all that is compared."""
    from corpusloom.operators import delta as D

    bags = spark.createDataFrame([(k, line, 1) for k in range(1000) for line in ("x", "y", f"own{k}")], "key long, line string, c long")
    ours, theirs, counts = D.shared_lines(bags.where("key % 20 = 0"), bags, True)
    assert counts.count() == 2 and ours.count() == 100 and theirs.count() == 2000
    texts, kinds = D.kinds(theirs, 2)
    assert [tuple(r) for r in texts.select("class", "n").distinct().collect()] == [(0, 1000)] and kinds.count() == 2
    assert D.similarities(bags.where("key % 20 = 0"), bags, least=2, others=True).count() == 50 * 999
