"""Queries of the column functions and text models: inputs are built from row keys, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import scalars as S
from ..functions import text as T
from ..operators import preproc as X
from ..operators import profile as P
from .profile_queries import BAND, FILES, IDENT, LABELS, LINES, NOT_BLANK, doc_lines, files
from .registry import query, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def by_case(values: list, k="doc_id", many: int | None = None):
    """The value of values at k modulo their number, as a column."""
    out, n = None, many or len(values)
    for i, v in enumerate(values):
        hit = F.col(k) % n == i
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out


def case_sql(values: list[str], k: str = "doc_id") -> str:
    return "CASE " + " ".join(f"WHEN {k} % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


def quoted(values) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


def bucket_sql(n: str) -> str:
    return f"CASE WHEN {n} <= 4 THEN cast({n} AS VARCHAR) WHEN {n} <= 16 THEN '5-16' WHEN {n} <= 64 THEN '17-64' ELSE '65+' END"


# ---- projections ----


@query("""WITH f AS (SELECT '.x' || (doc_id // 4) AS ext, lower(coalesce(source, '?') || '/' || coalesce(lang, '?')) AS dir FROM documents),
  r AS (SELECT ext FROM f GROUP BY 1 HAVING count(DISTINCT dir) < 3) SELECT CASE WHEN r.ext IS NULL THEN f.ext ELSE '(other)' END AS ext, count(*) AS n FROM f LEFT JOIN r USING (ext) GROUP BY 1""")
def prj_02_fold_extensions(spark, sf_dir):
    named = files(spark, sf_dir).withColumn("ext", F.concat(F.lit(".x"), F.floor(F.col("doc_id") / 4).cast("string")))
    return P.fold_name_like_extensions(named).groupBy("ext").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {LABELS}[{BAND} + 1] AS band FROM (SELECT doc_id, cast(n_chars AS BIGINT) * (1 + doc_id % 7) * (1 + (doc_id % 5) * 9000) AS size FROM documents)")
def prj_03_size_band(spark, sf_dir):
    k = F.col("doc_id")
    size = F.col("n_chars").cast("long") * (1 + k % 7) * (1 + (k % 5) * 9000)
    return docs(spark, sf_dir).select("doc_id", S.band_label(S.size_band(size)).alias("band"))


@query(f"WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, {bucket_sql('n')} AS bucket FROM c")
def prj_04_count_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", S.count_bucket(F.col("n")).alias("bucket"))


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN n <= 4 THEN '0-4' WHEN n <= 16 THEN '5-16' WHEN n <= 64 THEN '17-64' ELSE '65+' END AS bucket FROM c")
def prj_05_fanout_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", S.fanout_bucket(F.col("n")).alias("bucket"))


@query("SELECT doc_id, " + ", ".join(f"CASE WHEN n_chars / {d} < {lo} THEN 'low' WHEN n_chars / {d} < {hi} THEN 'med' ELSE 'high' END AS {c}" for c, d, lo, hi in (("f", 1000, 0.5, 2), ("g", 300, 1, 5), ("h", 4, 100, 1000))) + " FROM documents")
def prj_07_density_bands(spark, sf_dir):
    n = F.col("n_chars")
    return docs(spark, sf_dir).select("doc_id", S.density_band(n / 1000, "functions_per_kb").alias("f"), S.density_band(n / 300, "calls_per_function").alias("g"), S.density_band(n / 4, "global_refs").alias("h"))


@query(f"SELECT doc_id, {case_sql(quoted(x[0] for x in S.CLASSES.values()))} AS cost, {case_sql([str(x[1]).lower() for x in S.CLASSES.values()])} AS source FROM documents")
def prj_08_parse_cost(spark, sf_dir):
    label = by_case([F.lit(c) for c in S.CLASSES])
    return docs(spark, sf_dir).select("doc_id", S.parse_cost(label).alias("cost"), S.is_parsed_source(label).alias("source"))


TARGETS = ("a/b.cpp", "a/b.H", "compile_commands.json", "x/y.mut.tmp", "x/_truth.json", "z.txt")


@query(f"SELECT doc_id, {case_sql(['true', 'false', 'false', 'false', 'false', 'false'])} AS source, {case_sql(['false', 'true', 'false', 'false', 'false', 'false'])} AS headers, n_chars >= 2000 AND {case_sql(['true', 'true', 'false', 'false', 'false', 'true'])} AS giant, {case_sql(['true', 'true', 'false', 'false', 'false', 'true'])} AS every FROM documents")
def prj_09_targets(spark, sf_dir):
    path, size = by_case([F.lit(x) for x in TARGETS]), F.col("n_chars").cast("long") * ((20 << 20) // 2000 + 1)
    on = lambda t: S.is_target(path, size, t, markers=("_truth.json",))
    return docs(spark, sf_dir).select("doc_id", on("source").alias("source"), on("headers").alias("headers"), on("giant").alias("giant"), on("all").alias("every"))


@query(f"SELECT doc_id, {case_sql(['true', 'false', 'false', 'true', 'false', 'false', 'true'])} AS inside FROM documents")
def prj_10_contained(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", S.contained(by_case([F.lit(x) for x in ("a/b", "/a", "a/../../b", "a/../b/./c", "C:/x", "..", "a/b/../../c")])).alias("inside"))


@query("SELECT doc_id, coalesce(source, '') || ':x' AS path, cast(doc_id AS INTEGER) AS line FROM documents")
def prj_11_site_split(spark, sf_dir):
    site = F.concat(F.coalesce("source", F.lit("")), F.lit(":x:"), F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select("doc_id", S.site_path(site).alias("path"), S.site_line(site).alias("line"))


@query(f"SELECT doc_id, {case_sql(['true', 'false', 'false', 'false', 'false', 'false', 'true'])} AS ok FROM documents")
def prj_12_canonical_site(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", S.is_site(by_case([F.lit(x) for x in ("a/b.c:1", "a/b.c:0", "a/b.c:01", "/a.c:1", "a\\b.c:2", "a.c", "a b.c:10")])).alias("ok"))


@query("SELECT p_partkey, p_type LIKE '%BRASS%' AS brass, p_name LIKE '%_a%' AS inner_a, p_brand LIKE 'Brand#_3' AS third FROM part")
def prj_13_globs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.glob_match(F.col("p_type"), "*BRASS*").alias("brass"), S.glob_match(F.col("p_name"), "*?a*").alias("inner_a"), S.glob_match(F.col("p_brand"), "Brand#?3").alias("third"))


@query(f"SELECT doc_id, {case_sql(quoted(['drop', 'open', 'keep', 'keep', 'keep']))} AS cls FROM documents")
def prj_14_spelled_class(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", S.spelled_class(by_case([F.lit(x) for x in ("ZabZ", "Y_Y", "Zab", "Z", "aYY")])).alias("cls"))


GATED = ("classes", "densities", "parsed_source_by_class", "indexed", "content")


@query("SELECT 'structure-only' AS posture, '' AS sections UNION ALL SELECT 'class-labeled', 'classes,densities,indexed,parsed_source_by_class' UNION ALL SELECT 'content-stats', 'classes,content,densities,indexed,parsed_source_by_class'")
def prj_15_posture_gate(spark, sf_dir):
    f = files(spark, sf_dir).select("path", "size", F.col("text").cast("binary").alias("content"))
    rows = [(p, ",".join(sorted(set(P.profile(f, posture=p)) & set(GATED)))) for p in S.POSTURES]
    return spark.createDataFrame(rows, "posture string, sections string")


# ---- texts ----


@query(f"SELECT doc_id, {case_sql(quoted(['utf-8', 'utf-16le', 'utf-16be', 'ascii']))} AS encoding, doc_id % 4 < 3 AS bom FROM documents")
def txt_01_encoding(spark, sf_dir):
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    content = by_case([F.concat(F.unhex(F.lit(m)), raw) for m in ("EFBBBF", "FFFE", "FEFF")] + [F.concat(F.unhex(F.lit("41")), raw)])
    return docs(spark, sf_dir).select("doc_id", T.encoding(content).alias("e")).select("doc_id", "e.encoding", "e.bom")


BYTES = """h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL AND text <> ''),
  b AS (SELECT doc_id, substr(h, 2 * i + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM h)),
  c AS (SELECT doc_id, b, count(*) AS c FROM b GROUP BY 1, 2), n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY 1)"""


def features(spark, sf_dir):
    some = docs(spark, sf_dir).where("text IS NOT NULL AND text <> ''")
    return B.featured(some.select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id", with_text=False, prefix=None).select(F.col("key").cast("long").alias("doc_id"), "bytes", "printable", "digitish", "entropy")


@query("WITH u AS (SELECT doc_id, unnest(string_split(text, '')) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, count_if(x <> '' AND unicode(x) % 256 > 0) AS bytes FROM u GROUP BY 1 HAVING max(unicode(x)) < 65536")
def txt_02_thinned(spark, sf_dir):
    """Rows of one doc_id count together; one with a character beyond 16 bits has no content, so no mark, and takes its doc_id out."""
    content = F.when(~F.col("text").rlike("[\\x{10000}-\\x{10FFFF}]"), F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    made = B.featured(docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", content.alias("content")), "doc_id", with_text=False, prefix=None)
    return made.groupBy(F.col("key").cast("long").alias("doc_id")).agg(F.sum("bytes").alias("bytes"), F.bool_and("bom").alias("narrow")).where("narrow").select("doc_id", "bytes")


@query(f"WITH {BYTES} SELECT doc_id, cast(sum(c) FILTER (b IN ('09', '0A', '0D') OR (b >= '20' AND b <= '7E')) AS BIGINT) AS printable FROM c GROUP BY 1")
def txt_03_printable(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", F.nullif(F.round(F.col("printable") * F.col("bytes")).cast("long"), F.lit(0)).alias("printable"))


@query(f"WITH {BYTES} SELECT doc_id, cast(coalesce(sum(c) FILTER (regexp_matches(chr(cast('0x' || b AS INTEGER)), '[0-9a-fA-Fx, \\n]')), 0) AS BIGINT) AS digitish FROM c GROUP BY 1")
def txt_04_digitish(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", F.round(F.col("digitish") * F.col("bytes")).cast("long").alias("digitish"))


@query(f"WITH {BYTES} SELECT doc_id, round(abs(sum((c / n) * log2(c / n))), 4) AS entropy FROM c JOIN n USING (doc_id) GROUP BY 1")
def txt_05_entropy(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", F.round(F.abs("entropy"), 4).alias("entropy"))


@query(f"""WITH {LINES}, x AS (SELECT doc_id, unnest(regexp_extract_all(line, '{IDENT}')) AS x FROM line)
SELECT doc_id, count(*) AS idents, cast(sum(length(x)) AS BIGINT) AS chars, count(DISTINCT x) AS distinct_idents FROM x GROUP BY 1""")
def txt_07_identifiers(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    tallies = T.line_tallies(lines, "doc_id").select("doc_id", "idents", F.col("ident_chars").alias("chars")).where("idents > 0")
    return tallies.join(T.distinct_identifiers(lines, "doc_id"), "doc_id")


@query(f"WITH {LINES} SELECT doc_id, cast(sum(len(regexp_extract_all(replace(line, ' ', '('), '{IDENT}\\('))) AS BIGINT) AS calls FROM line GROUP BY 1")
def txt_08_calls(spark, sf_dir):
    called = docs(spark, sf_dir).where("text IS NOT NULL").withColumn("text", F.replace("text", F.lit(" "), F.lit("(")))
    return T.line_tallies(T.lines_lf(called, "text", "doc_id"), "doc_id").select("doc_id", "calls")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND len(string_split(coalesce(text, ''), chr(10))) > 2 THEN 'crlf' ELSE 'lf' END AS newline FROM documents WHERE text IS NULL OR NOT contains(text, chr(13))")
def txt_10_newline(spark, sf_dir):
    plain = docs(spark, sf_dir).where(F.col("text").isNull() | ~F.contains("text", F.lit("\r")))
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return P.file_stats(plain.select(F.col("doc_id").cast("string").alias("path"), text.cast("binary").alias("content"))).select(F.col("path").cast("long").alias("doc_id"), "newline")


@query(f"""WITH {LINES}, s AS (SELECT doc_id, regexp_replace(line, '\\r$', '') AS line FROM line),
  t AS (SELECT doc_id, count(*) AS n, count_if(NOT {NOT_BLANK}) AS blank, count_if({NOT_BLANK} AND regexp_matches(line, '^[ \\t]*(//|/\\*|\\*)')) AS comments FROM s GROUP BY 1)
SELECT doc_id, round(blank / n, 6) AS blank_frac, round(comments / greatest(1, n - blank), 6) AS comment_frac FROM t""")
def txt_11_ratios(spark, sf_dir):
    some = docs(spark, sf_dir).where("text IS NOT NULL")
    made = P.file_stats(some.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")))
    empty = some.where("text = ''").select("doc_id")
    found = made.select(F.col("path").cast("long").alias("doc_id"), F.round("blank_frac", 6).alias("blank_frac"), F.round("comment_frac", 6).alias("comment_frac"))
    return found.join(empty, "doc_id", "left_anti").unionByName(empty.select("doc_id", F.lit(1.0).alias("blank_frac"), F.lit(0.0).alias("comment_frac")))


INCLUDES = ('#include "a/B{k}.H"', "# include <sys/C{k}.h>", "#include MACRO", '#include "x\\Y{k}.h" // <z>')


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'b' || doc_id || '.h' WHEN 1 THEN 'c' || doc_id || '.h' WHEN 2 THEN '' ELSE 'y' || doc_id || '.h' END AS target FROM documents")
def txt_13_include_targets(spark, sf_dir):
    line = by_case([F.replace(F.lit(x), F.lit("{k}"), F.col("doc_id").cast("string")) for x in INCLUDES])
    return docs(spark, sf_dir).select("doc_id", T.include_target(line).alias("target"))


@query("SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') AS held FROM documents WHERE text IS NOT NULL")
def txt_14_whole_word(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", S.whole_word(F.col("text"), F.lit("the")).alias("held"))


@query(f"SELECT doc_id, {case_sql(quoted(['utf-8', '', 'utf-16-le', '', 'utf-8']))} AS encoding FROM documents WHERE text IS NULL OR NOT contains(text, chr(0))")
def txt_15_strict_decode(spark, sf_dir):
    return checked(spark, sf_dir).select("doc_id", F.coalesce("decodes", F.lit("")).alias("encoding"))


@query(f"SELECT doc_id, {case_sql(['false', 'true', 'false', 'false', 'false'])} AS binary FROM documents WHERE text IS NULL OR NOT contains(text, chr(0))")
def txt_16_looks_binary(spark, sf_dir):
    return checked(spark, sf_dir).select("doc_id", "binary")


def checked(spark, sf_dir):
    """Plain, with a NUL, as UTF-16LE with a mark, with a byte that is no UTF-8, and with a UTF-8 mark."""
    text = F.coalesce("text", F.lit(""))
    raw, put = F.encode(text, "UTF-8"), lambda h: F.unhex(F.lit(h))
    content = by_case([raw, F.concat(put("4100"), raw), F.concat(put("FFFE"), F.encode(text, "UTF-16LE")), F.concat(put("FE"), raw), F.concat(put("EFBBBF"), raw)])
    some = docs(spark, sf_dir).where(F.col("text").isNull() | ~F.contains("text", F.lit("\0")))
    return B.decode_checks(some.select("doc_id", content.alias("content")), "doc_id").withColumn("doc_id", F.col("key").cast("long"))


@query("""WITH t AS (SELECT doc_id, replace(replace(text, '. ', '.' || chr(13)), ', ', ',' || chr(13) || chr(10)) AS t FROM documents WHERE text IS NOT NULL),
  l AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\\r\\n]*(?:\\r\\n|\\n|\\r|$)')) AS raw FROM t)
SELECT doc_id, count(*) AS lines, count_if(raw LIKE '%' || chr(13)) AS cr, count_if(raw LIKE '%' || chr(13) || chr(10)) AS crlf FROM l WHERE raw <> '' GROUP BY 1""")
def txt_17_line_ends(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\r")), F.lit(", "), F.lit(",\r\n"))
    cut = T.lines_any(docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", text.alias("text")), "text", "doc_id")
    return cut.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("term") == "\r").alias("cr"), F.count_if(F.col("term") == "\r\n").alias("crlf"))


def k(prefix: str = ""):
    return F.concat(F.lit(prefix), F.col("doc_id").cast("string"))


@query("""WITH e AS (SELECT doc_id, unnest([{'i': 0, 'kind': 'ifndef', 'line': 2, 'name': 'G' || doc_id, 'text': NULL}, {'i': 1, 'kind': 'define', 'line': 3, 'name': 'G' || doc_id, 'text': '1'},
  {'i': 2, 'kind': 'include', 'line': 4, 'name': NULL, 'text': 'h' || doc_id || '.h'}, {'i': 3, 'kind': 'if', 'line': 5, 'name': NULL, 'text': 'A + ' || doc_id}, {'i': 4, 'kind': 'endif', 'line': 7, 'name': NULL, 'text': NULL}, {'i': 5, 'kind': 'endif', 'line': 8, 'name': NULL, 'text': NULL}]) AS e FROM documents)
SELECT cast(doc_id AS VARCHAR) AS path, e.i AS i, e.kind AS kind, e.line AS line, e.name AS name, e.text AS text FROM e""")
def txt_19_directives(spark, sf_dir):
    text = F.concat(F.lit("// a\n#ifndef "), k("G"), F.lit(" /* x */\n# define "), k("G"), F.lit(' 1\n#include "'), k("h"), F.lit('.h"\n#if A + \\\n'), k(), F.lit("\n#endif\n#endif\n"))
    return X.directive_events(docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), text.alias("text")))


@query("""SELECT cast(doc_id AS VARCHAR) AS path, cast(i - 1 AS INTEGER) AS i, t[i] AS token FROM (SELECT doc_id, ['x' || doc_id, '<<=', '0x' || doc_id || 'uL', '+', '"a//' || doc_id || '"', '[', '1', ']', '...'] AS t, unnest(range(1, 10)) AS i FROM documents)""")
def txt_20_tokens(spark, sf_dir):
    text = F.concat(k("x"), F.lit("<<=0x"), k(), F.lit('uL/* c */+"a//'), k(), F.lit('"<:1:>... // end'))
    return X.token_rows(docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), text.alias("text")))


def macro_rows(spark, sf_dir, text: str):
    """(key, text, macros): N is the key modulo 5, A stands for N, E is defined for even keys."""
    n = (F.col("doc_id") % 5).cast("string")
    macros = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("N"), n), F.struct(F.lit("A"), F.lit("N")), F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("E"), F.lit("1"))))))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("key"), F.lit(text).alias("text"), macros.alias("macros"))


@query("SELECT doc_id AS key, (doc_id % 2 = 0 AND doc_id % 5 = 3) OR NOT (doc_id % 5 = 0 OR doc_id % 5 = 3) AS two FROM documents")
def txt_21_conditions(spark, sf_dir):
    return X.conditions(macro_rows(spark, sf_dir, "defined(E) && A == 3 || !(N == 0 || A == 3 || X)")).select("key", "two")


@query("""SELECT doc_id AS key, CASE WHEN doc_id % 5 = 4 THEN true WHEN doc_id % 2 = 0 THEN NULL ELSE NULL END AS open, doc_id % 5 = 4 AS closed FROM documents""")
def txt_22_three_valued(spark, sf_dir):
    return X.conditions(macro_rows(spark, sf_dir, "N == 4 || (E == 1 && U) || V")).select("key", "open", "closed")


@query(f"SELECT doc_id AS key, {case_sql(['doc_id', 'doc_id * 8 + 7', 'doc_id * 16 + 10', 'NULL', 'NULL'])} AS value FROM documents WHERE doc_id > 0")
def txt_23_integers(spark, sf_dir):
    forms = [F.concat(k(), F.lit("uLL")), F.concat(F.lit("0"), F.conv(F.col("doc_id").cast("string"), 10, 8), F.lit("7")), F.concat(F.lit("0x"), F.lower(F.conv(F.col("doc_id").cast("string"), 10, 16)), F.lit("A")), F.concat(k(), F.lit("_0")), F.concat(k("99999999999999999999"))]
    return X.integers(docs(spark, sf_dir).where("doc_id > 0").select(F.col("doc_id").alias("key"), by_case(forms).alias("text")))


@query("SELECT doc_id AS key, (doc_id % 5) || ' + ' || (doc_id % 5) || '_x (' || CASE WHEN doc_id % 2 = 0 THEN '1' ELSE 'E' END || ')' AS text FROM documents")
def txt_24_expansion(spark, sf_dir):
    return X.expansions(macro_rows(spark, sf_dir, "A + CAT(N, x) (E)"))


@query("SELECT doc_id, 'ns::T::f' || doc_id AS bare, 'ns::T' AS owner, 'f' || doc_id AS last FROM documents")
def txt_25_owner_last(spark, sf_dir):
    bare, owner, last = S.owner_and_last(F.concat(F.lit("ns::T<int, std::v<a>>::"), k("f"), F.lit("<x>")))
    return docs(spark, sf_dir).select("doc_id", bare.alias("bare"), owner.alias("owner"), last.alias("last"))


@query("SELECT doc_id, sha256(text) AS sha, cast(strlen(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL")
def txt_26_sha(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.sha256_hex(F.encode("text", "UTF-8")).alias("sha"), F.octet_length("text").cast("long").alias("size"))


@query("""WITH h AS (SELECT p_partkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, [unicode(x)::HUGEINT for x in string_split(p_name, '')]), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM part)
SELECT p_partkey, cast(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS hash FROM h""")
def txt_27_line_hash(spark, sf_dir):
    return B.line_hashes(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("content"))).select("p_partkey", "hash")
