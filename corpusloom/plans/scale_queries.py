"""Trees read in tasks, shards that appear whole, orders in two levels, and states that lines carry on."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions.scalars import effective_count, flipped_to_binary, include_flags, rebased_path, spelled_class_for
from ..operators import draws as X
from ..operators import literals as L
from ..operators import order as O
from ..sources import manifests as M
from ..sources import sinks as W
from ..sources import tree as T
from ..operators.rng import CATEGORIES, MASK, mix
from .registry import query, table
from .relation_queries import place

FILE = "coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt'"


def written_files(spark, sf_dir, name):
    """A folder with a file for each document, its text in UTF-8."""
    at = T.local(place(spark, name))
    d = table(spark, sf_dir, "documents").select(F.expr(FILE).alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    W.write_files(d, at)
    return at


@query(f"SELECT {FILE} AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, least(2000, octet_length(encode(coalesce(text, '')))) AS n_read, upper(left(hex(encode(coalesce(text, ''))), 4000)) AS content FROM documents")
def src_02_prefix_reads(spark, sf_dir):
    """The first 2,000 bytes of files, of which no more are read."""
    found = T.read_prefixes(spark, written_files(spark, sf_dir, "prefixes"), most=2000, bin_bytes=1 << 20)
    return found.select("path", "size", "n_read", F.hex("content").alias("content"))


@query(f"""WITH f AS (SELECT {FILE} AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, doc_id FROM documents)
SELECT 'file' AS kind, path, size FROM f UNION ALL SELECT 'link', path || '.link', NULL FROM f WHERE doc_id % 10 = 0
UNION ALL SELECT DISTINCT 'dir', regexp_extract(path, '^[^/]*'), NULL::BIGINT FROM f UNION ALL SELECT DISTINCT 'dir', regexp_extract(path, '^[^/]*/[^/]*'), NULL::BIGINT FROM f""")
def src_01_listing(spark, sf_dir):
    """A tree in which every tenth file has a link beside it, to a folder above (a loop for whoever follows it)."""
    at = written_files(spark, sf_dir, "listing")

    def link(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                full = os.path.join(at, path) + ".link"
                if not os.path.islink(full):
                    os.symlink("..", full)
            yield batch.slice(0, 0)

    linked = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.expr(FILE).alias("path"))
    linked.mapInArrow(link, "path string").write.format("noop").mode("overwrite").save()
    return T.list_tree(spark, at).select("kind", "path", "size")


SHARDED = "SELECT lpad(doc_id::VARCHAR, 12, '0') AS key, lpad(doc_id::VARCHAR, 12, '0') || ':' || coalesce(lang, '') AS line FROM documents"


@query(f"""WITH r AS (SELECT *, (row_number() OVER (ORDER BY key) - 1) // 100 AS shard FROM ({SHARDED}))
SELECT shard, min(key) AS first, max(key) AS last, count(*) AS n, md5(string_agg(line || chr(10), '' ORDER BY key)) AS body FROM r GROUP BY shard""")
def snk_08_atomic_shards(spark, sf_dir):
    """Shards and their index as a reader finds them. CRs, which lines have at their ends here, are dropped."""
    at = T.local(place(spark, "shards"))
    key = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    T.write_shards(table(spark, sf_dir, "documents").select(key.alias("key"), F.concat(key, F.lit(":"), F.coalesce("lang", F.lit("")), F.lit("\r")).alias("line")), "key", 100, at)
    lines, index = T.read_shards(spark, at)
    bodies = spark.read.text(f"file://{at}/shard-*.jsonl", wholetext=True).select(F.regexp_extract("_metadata.file_name", r"shard-(\d+)", 1).cast("long").alias("shard"), F.md5("value").alias("body"))
    counted = lines.groupBy("shard").agg(F.count("*").alias("n"))
    return index.drop("n").join(counted, "shard").join(bodies, "shard")


DRAW = "CAST(conv('0x' || left(md5(e.event_id::VARCHAR), 8)) AS BIGINT)"


@query("""WITH w AS (SELECT c_custkey, sum(weight) OVER (ORDER BY c_custkey) AS upto, weight FROM (SELECT c_custkey, CAST(greatest(floor(c_acctbal), 0) AS BIGINT) AS weight FROM customer) WHERE weight > 0),
p AS (SELECT event_id, ('0x' || left(md5(event_id::VARCHAR), 8))::HUGEINT * (SELECT max(upto) FROM w) // 4294967296 AS u FROM events)
SELECT event_id, c_custkey FROM p ASOF JOIN (SELECT c_custkey, upto - weight AS low FROM w) w ON p.u >= w.low""")
def gen_06_weighted_picks(spark, sf_dir):
    """A customer for each event, in proportion to balances; those without one are never drawn."""
    weights = table(spark, sf_dir, "customer").select("c_custkey", F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("long").alias("weight"))
    draw = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long")
    return O.weighted_picks(table(spark, sf_dir, "events").select("event_id", draw.alias("draw")), weights, "event_id", "c_custkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'P' ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 700")
def srt_04_exact_choice(spark, sf_dir):
    """700 orders by a seeded shuffle; those that may not be edited are made up for by the next."""
    return O.chosen(table(spark, sf_dir, "orders"), 700, "o_orderkey", 7, F.col("o_orderstatus") != "P", most_sorted=50).select("o_orderkey", "o_orderpriority")


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY md5('3:' || o_orderkey), o_orderkey) AS r FROM orders WHERE o_totalprice > 50000 AND o_orderkey % 7 <> 0)
SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM o WHERE r <= 1000""")
def srt_05_fill_up(spark, sf_dir):
    got = O.chosen(table(spark, sf_dir, "orders"), 1000, "o_orderkey", 3, (F.col("o_totalprice") > 50_000) & (F.col("o_orderkey") % 7 != 0))
    return got.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""WITH f AS (SELECT 'd' || doc_id AS path, CASE doc_id % 8 WHEN 0 THEN 'grow' WHEN 1 THEN 'shrink' ELSE 'source' END AS pool FROM documents),
r AS (SELECT path, pool, row_number() OVER (PARTITION BY pool ORDER BY CASE WHEN pool = 'source' THEN md5('5:' || path) ELSE '' END, encode(path)) - 1 AS r, count(*) OVER (PARTITION BY pool) AS n FROM f),
k AS (SELECT i AS step, ['remove', 'line-shift', 'add', 'grow', 'shrink'][i % 5 + 1] AS kind, i // 5 AS turn FROM range((SELECT 2 * count(*) FROM documents)) t(i)),
m AS (SELECT step, kind, CASE kind WHEN 'remove' THEN 'source' WHEN 'line-shift' THEN 'source' ELSE kind END AS pool,
  CASE kind WHEN 'remove' THEN 2 * turn WHEN 'line-shift' THEN 2 * turn + 1 WHEN 'grow' THEN turn % (SELECT max(n) FROM r WHERE pool = 'grow') ELSE turn END AS need FROM k)
SELECT step, kind, CASE WHEN kind = 'add' THEN 'mut_add_' || step || '.c' ELSE path END AS path, CASE WHEN kind <> 'add' AND path IS NULL THEN 'no file is left for ' || kind END AS error
FROM m LEFT JOIN r ON r.pool = m.pool AND r.r = m.need""")
def dlt_01_edit_plan(spark, sf_dir):
    """Twice as many edits as there are documents: growing files come again, sources and shrinking files run out."""
    d = table(spark, sf_dir, "documents")
    pool = F.when(F.col("doc_id") % 8 == 0, "grow").when(F.col("doc_id") % 8 == 1, "shrink").otherwise("source")
    return O.edit_plan(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), pool.alias("pool")), 2 * d.count(), 5)


#: Fixed values of the query below: what is planted at a line's start or end, by a number of the line.
STARTS = {0: "/* ", 7: ')" ', 8: '"a ', 4: "*/ "}
ENDS = {3: " */", 5: ' R"(', 9: ' // it is " /*', 6: ' "\\" /*"', 2: " /*/", 8: ' b" /* x */'}
PLANTED = f"""l AS (SELECT doc_id, n, CASE (doc_id + 3 * n) % 23 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in STARTS.items())} ELSE '' END || line || CASE (doc_id + 3 * n) % 23 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in ENDS.items())} ELSE '' END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL))"""


@query(f"""WITH {PLANTED}, whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM l GROUP BY 1),
bare AS (SELECT doc_id, regexp_replace(text, 'R"\\(.*?\\)"|R"\\(.*|"(?:[^"\\\\\\n]|\\\\[^\\n])*"?|''(?:[^''\\\\\\n]|\\\\[^\\n])*''?|//[^\\n]*|/\\*.*?\\*/|/\\*.*', ' ', 'gs') AS text FROM whole)
SELECT doc_id, count(*) AS n_names, count(DISTINCT name) AS n_distinct, md5(string_agg(name, ' ' ORDER BY encode(name))) AS names FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM bare) GROUP BY 1""")
def gen_12_names_outside(spark, sf_dir):
    """Names of each document outside comments and literals that run over lines."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("n", "content"))
    turn = (F.col("path") + 3 * (F.col("n") + 1)) % 23
    planted = lambda what: F.coalesce(*[F.when(turn == i, x) for i, x in what.items()], F.lit(""))
    found = L.names_outside(d.withColumn("content", F.concat(planted(STARTS), "content", planted(ENDS))), block=16)
    return found.groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("n_names"), F.countDistinct("name").alias("n_distinct"), F.md5(F.array_join(F.array_sort(F.collect_list("name")), " ")).alias("names"))


LOGS = """SELECT 'log' || user_id % 40 AS log, event_id AS n, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN CASE WHEN event_id % 3 = 0 THEN '  ' ELSE '' END || 'ld.lld -L lib/' || user_id || ' -T ./s/x/../' || event_id || '.ld  a' || event_id || '.o -o x.elf b/./c.o -L -q lib.a b/c.o' ELSE 'clang -c f' || event_id || '.c' END AS line FROM events"""


@query(f"""WITH l AS ({LOGS}) SELECT log, n, last_value(CASE WHEN ltrim(line) LIKE 'ld.lld %' THEN n END IGNORE NULLS) OVER (PARTITION BY log ORDER BY n ROWS UNBOUNDED PRECEDING) AS linked FROM l""")
def src_09_log_lines(spark, sf_dir):
    """The link line in force at each line of logs that are cut into blocks of 64 lines."""
    return M.build_scopes(spark_logs(spark, sf_dir), block=64)[1].select("log", "n", "linked")


@query(f"""WITH l AS ({LOGS}), x AS (SELECT log, max(n) AS n, regexp_extract(arg_max(line, n), 'lib/(\\d+)', 1) AS u FROM l WHERE ltrim(line) LIKE 'ld.lld %' GROUP BY 1)
SELECT a.log, x.n, 's/' || x.n || '.ld' AS script, 'lib/' || u || ',-q' AS dirs, 'a' || x.n || '.o,b/c.o,lib.a' AS objects, CASE WHEN x.n IS NULL THEN 'no ld.lld line' END AS error FROM (SELECT DISTINCT log FROM l) a LEFT JOIN x USING (log)""")
def src_09_build_scopes(spark, sf_dir):
    scopes = M.build_scopes(spark_logs(spark, sf_dir))[0]
    return scopes.select("log", "n", "script", F.array_join("dirs", ",").alias("dirs"), F.array_join("objects", ",").alias("objects"), "error")


def spark_logs(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("_log_events")
    return spark.sql(LOGS.replace("FROM events", "FROM _log_events"))


@query("""WITH p AS (SELECT c_nationkey AS profile, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS label, '.e' || c_custkey % 9 AS extension,
  CASE WHEN c_custkey % 11 = 0 THEN 'odd' ELSE 'text' END AS class, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer WHERE c_nationkey % 6 <> 5)
SELECT profile, place, label, extension, class, CASE WHEN class = 'odd' THEN 'unknown class' WHEN row_number() OVER (PARTITION BY profile, lower(label), extension ORDER BY place) > 1 THEN 'stands twice' END AS reason FROM p
UNION ALL SELECT n_nationkey, NULL, NULL, NULL, NULL, 'not a profile' FROM nation WHERE n_nationkey % 6 = 5""")
def src_06_profiles(spark, sf_dir):
    """A profile for each nation, its archetypes from customers: good ones, unknown classes, repeated labels, and broken text."""
    key = F.col("c_custkey")
    label = F.when(key % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    one = F.struct(key.alias("k"), label.alias("label"), F.concat(F.lit(".e"), (key % 9).cast("string")).alias("extension"), F.when(key % 11 == 0, "odd").otherwise("text").alias("class"), F.lit(1).alias("count"))
    whole = table(spark, sf_dir, "customer").where("c_nationkey % 6 <> 5").groupBy(F.col("c_nationkey").alias("profile")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("archetypes"))).alias("body"))
    broken = table(spark, sf_dir, "nation").where("n_nationkey % 6 = 5").select(F.col("n_nationkey").alias("profile"), F.lit('{"archetypes": [').alias("body"))
    return M.read_profiles(whole.unionByName(broken), ("text", "binary")).select("profile", "place", "label", "extension", "class", "reason")


def raw_sql(source: str, key: str, seed: int, category: str, n: int) -> str:
    """SQL of key and x1 .. xn: the first raw values of the streams (seed, category, key), in integers of 128 bits."""
    times = lambda x, c: f"((({x})::UHUGEINT * {c}::UHUGEINT) % {1 << 64}::UHUGEINT)::UBIGINT"
    plus = lambda x, c: f"((({x})::UHUGEINT + {c}::UHUGEINT) % {1 << 64}::UHUGEINT)::UBIGINT"
    turn = lambda x, k: f"({times(x, 1 << k)} | ({x} >> {64 - k}))"
    steps, last = [], "t0"

    def let(what: str) -> None:
        nonlocal last
        new = f"t{len(steps) + 1}"
        steps.append(f"{new} AS MATERIALIZED (SELECT *, {what} FROM {last})")
        last = new

    def mixed(x: str, name: str) -> None:
        let(f"{times(f'xor({x}, {x} >> 30)', X.FIRST)} AS {name}_1")
        let(f"{times(f'xor({name}_1, {name}_1 >> 27)', X.SECOND)} AS {name}_2")
        let(f"xor({name}_2, {name}_2 >> 31) AS {name}")

    head = mix(mix(X.STEP ^ (seed & 0xFFFFFFFF)) ^ (CATEGORIES[category] << 32))
    let(f"xor({key}::UBIGINT, {head}::UBIGINT) AS h0")
    mixed("h0", "seedling")
    for i in range(4):
        let(f"{plus('seedling', X.STEP * (i + 1) & MASK)} AS in{i}")
        mixed(f"in{i}", f"s0_{i}")
    for k in range(n):
        a, b, c, d = (f"s{k}_{i}" for i in range(4))
        let(f"{times(b, 5)} AS f{k}, xor({c}, {a}) AS c{k}, xor({d}, {b}) AS d{k}")
        let(f"{turn(f'f{k}', 7)} AS g{k}")
        let(f"{times(f'g{k}', 9)} AS x{k + 1}, xor({a}, d{k}) AS s{k + 1}_0, xor({b}, c{k}) AS s{k + 1}_1, xor(c{k}, {times(b, 1 << 17)}) AS s{k + 1}_2, {turn(f'd{k}', 45)} AS s{k + 1}_3")
    return f"t0 AS ({source}), {', '.join(steps)}, raw AS (SELECT {key}, {', '.join(f'x{i + 1}' for i in range(n))} FROM {last})"


@query(f"""WITH {raw_sql("SELECT o_orderkey FROM orders", "o_orderkey", 1337, "Mutate", 3)}
SELECT o_orderkey, x1::VARCHAR AS raw, ((1000::UHUGEINT * (x2 >> 32)) // 4294967296)::BIGINT AS below_1000, (10 + (10::UHUGEINT * (x3 >> 32)) // 4294967296)::BIGINT AS from_10_to_19 FROM raw""")
def rng_02_bounded_draws(spark, sf_dir):
    """A raw value and two bounded ones of each order's stream."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    made = X.drawn(X.seeded(orders, 1337, CATEGORIES["Mutate"], F.col("o_orderkey")), "x1", "x2", "x3")
    unsigned = F.expr("cast(cast(x1 as decimal(20,0)) + if(x1 < 0, 18446744073709551616BD, 0BD) as string)")
    return made.select("o_orderkey", unsigned.alias("raw"), X.below(F.col("x2"), 1000).alias("below_1000"), (10 + X.below(F.col("x3"), 10)).alias("from_10_to_19"))


@query(f"""WITH c AS (SELECT unnest({sorted(CATEGORIES.values())}) AS category, doc_id FROM documents), per AS (SELECT category, count(*) AS n FROM c GROUP BY 1)
SELECT category, n, {len(CATEGORIES)}::BIGINT AS categories FROM per""")
def rng_03_categories(spark, sf_dir):
    """Each document has a stream in each category, and no two of them begin alike."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(c) for c in CATEGORIES.values()])).alias("category"))
    out = X.drawn(X.seeded(d, 7, F.col("category"), F.col("doc_id")), "x")
    first = out.groupBy("x").agg(F.min("category").alias("category"))
    return first.groupBy("category").agg(F.count("*").alias("n")).withColumn("categories", F.lit(len(CATEGORIES)).cast("long"))


@query()
def gen_07_sizes(spark, sf_dir):
    """A size for each order, in bands from its price; tests hold it against the streams, draw by draw."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("p50"), F.floor(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 5)).alias("p90"), F.floor(F.col("o_totalprice") * 40).alias("max"))
    return X.sizes(o, 11, CATEGORIES["ProfileGen"], F.col("o_orderkey"))


@query("""SELECT 'src/u' || doc_id || '.c' AS unit, '/copy/of/inc' AS first, '/copy/of/d' || (doc_id % 7) AS second, '/old/root2/keep' AS kept FROM documents""")
def gen_13_rebased_db(spark, sf_dir):
    """A compile database of documents, of a line for each entry, rebased to a copy of its tree; a longer root that begins
    alike stays."""
    at = place(spark, "db")
    d = table(spark, sf_dir, "documents")
    unit = F.concat(F.lit("src/u"), F.col("doc_id").cast("string"), F.lit(".c"))
    words = F.array(F.lit("clang"), F.lit("-I/old/root/inc"), F.concat(F.lit("-I/old/root/d"), (F.col("doc_id") % 7).cast("string")), F.lit("-I/old/root2/keep"), F.lit("-c"), unit)
    d.select(F.to_json(F.struct(F.lit("/old/root").alias("directory"), unit.alias("file"), words.alias("arguments"))).alias("value")).write.text(at)
    read = spark.read.text(at).select(F.from_json(rebased_path("value", "/old/root", "/copy/of"), "file string, arguments array<string>").alias("e"))
    flag = lambda i: F.substring(F.get("e.arguments", F.lit(i)), 3, 1000)
    return read.select(F.col("e.file").alias("unit"), flag(1).alias("first"), flag(2).alias("second"), flag(3).alias("kept"))


@query("""WITH p AS (SELECT p_partkey AS name, p_size * 37 AS usual, p_partkey % 3 = 0 AS keep_one, CASE WHEN p_partkey % 5 = 0 THEN p_size - 10 END AS given FROM part)
SELECT name, CASE WHEN coalesce(given, usual) <= 0 THEN 0 ELSE greatest(coalesce(given, round_even(usual * 0.01::DOUBLE, 0)), CASE WHEN keep_one THEN 1 ELSE 0 END) END::BIGINT AS effective FROM p""")
def gen_14_effective_counts(spark, sf_dir):
    """Counts of populations from parts: given ones as they are, others scaled, some kept from vanishing."""
    p = table(spark, sf_dir, "part")
    given = F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") - 10)
    return p.select(F.col("p_partkey").alias("name"), effective_count(F.col("p_size") * 37, 0.01, given, F.col("p_partkey") % 3 == 0).alias("effective"))


@query("""WITH s AS (SELECT 'f' || doc_id AS name, doc_id AS k FROM documents), l AS (SELECT 0 AS part, '' AS name, '{"_meta": {"manifestVersion": 1}, "symbols": {' AS line UNION ALL SELECT 2, '', '}}'
UNION ALL SELECT 1, name, CASE WHEN name = (SELECT min(name) FROM s) THEN '' ELSE ',' END || '"' || name || '": {"def":"d:' || k || '"}' FROM s) SELECT row_number() OVER (ORDER BY part, encode(name)) AS n, line FROM l""")
def snk_01_line_order(spark, sf_dir):
    """Each line of a manifest at its place in the file."""
    at = place(spark, "manifest")
    key = F.col("doc_id").cast("string")
    W.write_lines(W.manifest_lines(table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), key).alias("name"), F.concat(F.lit("d:"), key).alias("def")), {"manifestVersion": 1}), at)
    return W.numbered_lines(spark, at)


@query("""WITH s AS (SELECT 'f' || doc_id AS name, doc_id AS k FROM documents), l AS (SELECT 0 AS part, '' AS name, '{' AS line UNION ALL SELECT 2, '', '}'
UNION ALL SELECT 1, name, CASE WHEN name = (SELECT min(name) FROM s) THEN '' ELSE ',' END || '"' || name || '": ' || CASE WHEN k % 3 = 0 THEN '"TOMBSTONE"' ELSE '{"def":"d:' || k || '","refs":[],"edges":[]}' END FROM s) SELECT row_number() OVER (ORDER BY part, encode(name)) AS n, line FROM l""")
def snk_03_line_order(spark, sf_dir):
    at = place(spark, "overlay")
    key, none = F.col("doc_id").cast("string"), F.array().cast("array<string>")
    changed = F.when(F.col("doc_id") % 3 == 0, "TOMBSTONE").otherwise("CHANGED")
    W.write_lines(W.overlay_lines(table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), key).alias("name"), changed.alias("op"), F.concat(F.lit("d:"), key).alias("def"), none.alias("refs"), none.alias("edges"), F.lit(None).cast("array<string>").alias("removed_sites"))), at)
    return W.numbered_lines(spark, at)


@query("""SELECT row_number() OVER (ORDER BY encode('p/' || o_orderkey)) AS n, 'p/' || o_orderkey AS path, o_orderstatus AS reason FROM orders""")
def snk_04_line_order(spark, sf_dir):
    at = place(spark, "diff")
    W.write_ordered(table(spark, sf_dir, "orders").select(F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderstatus").alias("reason")), at)
    return W.numbered_lines(spark, at).select("n", F.from_json("line", "path string, reason string").alias("x")).select("n", "x.*")


@query("SELECT row_number() OVER (ORDER BY encode(c_name)) AS n, c_name AS line FROM customer")
def snk_07_line_order(spark, sf_dir):
    at = place(spark, "list")
    W.write_lines(table(spark, sf_dir, "customer").select("c_name"), at, ("c_name",), "c_name")
    return W.numbered_lines(spark, at)


@query("""SELECT doc_id, ['keep', 'keep', 'keep', 'open', 'keep'][c + 1] AS none, ['keep', 'open', 'keep', 'open', 'keep'][c + 1] AS first, ['drop', 'keep', 'keep', 'open', 'keep'][c + 1] AS second, ['open', 'drop', 'keep', 'open', 'keep'][c + 1] AS third
FROM (SELECT doc_id, doc_id % 5 AS c FROM documents)""")
def prj_14_target_suffix(spark, sf_dir):
    """The class of a name in each of three targets."""
    key = F.col("doc_id")
    name = F.when(key % 5 == 0, F.concat(F.lit("a:n"), key.cast("string"), F.lit("__KDO"))).when(key % 5 == 1, "Z__OKD").when(key % 5 == 2, "__DDD").when(key % 5 == 3, "YaY").otherwise("k:ZqZ__KD")
    return table(spark, sf_dir, "documents").select("doc_id", spelled_class_for(name, 0, 9).alias("none"), *[spelled_class_for(name, i, 3).alias(c) for i, c in enumerate(("first", "second", "third"))])


@query("SELECT o_orderkey, 'inc,d ' || o_custkey || ',e' || (o_orderkey % 3) AS incs FROM orders")
def src_08_include_flags(spark, sf_dir):
    """Flags joined to their value, apart from it, and in quotes; what only looks like one is left."""
    text = F.concat(F.lit("clang -I inc x-Iy -O2 -I\"d "), F.col("o_custkey").cast("string"), F.lit("\" -DA=-Ib -Ie"), (F.col("o_orderkey") % 3).cast("string"), F.lit(" -c u.c"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(include_flags(text), ",").alias("incs"))


@query("""SELECT doc_id, CASE WHEN t = '' THEN '' ELSE left(h, p) || '00' || substr(h, p + 3) END AS content FROM (SELECT doc_id, t, hex(encode(t)) AS h, 2 * least(4, octet_length(encode(t)) - 1) AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def dlt_14_binary_flip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(flipped_to_binary(F.encode(F.coalesce("text", F.lit("")), "utf-8"))).alias("content"))


@query("""SELECT 'c' || c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN 'method' ELSE 'class' END AS kind, c_custkey % 3 = 0 AS pure, 'e' || c_nationkey AS implicit, 's' || c_custkey AS static, 'x,y' || c_nationkey AS cha, 'm' || c_custkey AS member FROM customer""")
def src_05_v2_fields(spark, sf_dir):
    """Manifests of version 2, one for each nation, with the fields that version 1 lacks."""
    at = place(spark, "v2")
    text = lambda x, p: F.concat(F.lit(p), F.col(x).cast("string"))
    key = F.col("c_custkey")
    virtual = F.array(F.struct(text("c_custkey", "s").alias("static"), F.array(F.lit("x"), text("c_nationkey", "y")).alias("cha"), F.array().cast("array<string>").alias("rta")))
    member = F.array(F.struct(text("c_custkey", "m").alias("target"), F.lit("fn").alias("via"), F.lit(True).alias("dispatched")))
    entry = F.struct(F.when(key % 2 == 0, "method").otherwise("class").alias("kind"), (key % 3 == 0).alias("pure"), F.array(text("c_nationkey", "e")).alias("implicitEdges"), virtual.alias("virtualEdges"), member.alias("memberPtrEdges"))
    whole = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(text("c_custkey", "c"), entry))).alias("symbols"))
    whole.select(F.to_json(F.struct("symbols")).alias("value")).repartition("value").write.text(at)
    read = M.read_manifests(spark, at, whole=False)
    return read.select("name", "kind", "pure", F.array_join("implicitEdges", ",").alias("implicit"), F.get("virtualEdges.static", F.lit(0)).alias("static"), F.array_join(F.get("virtualEdges.cha", F.lit(0)), ",").alias("cha"), F.get("memberPtrEdges.target", F.lit(0)).alias("member"))
