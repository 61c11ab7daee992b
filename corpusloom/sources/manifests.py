"""Reading manifests, profiles, compile databases and build logs: fixed schemas, never inferred. Bad input raises."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import carried

INDIRECT = "array<struct<target:string,via:string,dispatched:boolean,resolved:boolean>>"
SYMBOL = f"struct<def:string,refs:array<string>,edges:array<string>,indirectEdges:{INDIRECT},unreachableRefs:array<string>,bytes:bigint,expectedMiss:boolean,templateHead:string,includedVia:string,defNotLiteral:boolean>"
SYMBOL_V2 = SYMBOL[:-1] + ",kind:string,simpleName:string,instanceOf:string,pure:boolean,implicitEdges:array<string>,virtualEdges:array<struct<static:string,cha:array<string>,rta:array<string>>>,memberPtrEdges:array<struct<target:string,via:string,dispatched:boolean>>>"
VERSIONS = {1: SYMBOL, 2: SYMBOL_V2}


class BadInput(ValueError):
    """Input that cannot be checked at all, as against a check that fails."""


def _no_duplicates(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise BadInput(f"duplicate key among {sorted(k for k, _ in pairs)[:20]}")
    return out


def load_json(text: str):
    try:
        return json.loads(text, object_pairs_hook=_no_duplicates)
    except json.JSONDecodeError as e:
        raise BadInput(str(e)) from e


def read_manifest(spark: SparkSession, text: str) -> tuple[DataFrame, dict]:
    """(symbols, meta): a row for each symbol (name, ord, fields); version 1 or 2."""
    whole = load_json(text)
    meta = whole.get("_meta", {}) if isinstance(whole, dict) else {}
    version = meta.get("manifestVersion", 1)
    if version not in VERSIONS:
        raise BadInput(f"manifestVersion {version} is not read here")
    symbols = whole.get("symbols")
    if not isinstance(symbols, dict):
        raise BadInput("symbols is not an object")
    rows = [(k, i, json.dumps(v)) for i, (k, v) in enumerate(symbols.items())]
    raw = spark.createDataFrame(rows, "name string, ord int, body string")
    return raw.select("name", "ord", F.from_json("body", VERSIONS[version].replace("bigint", "long")).alias("s")).select("name", "ord", "s.*"), meta


def read_manifests(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(file, name, fields) of many manifests, read in parallel: one document a file, or with whole False one a line."""
    one = spark.read.text(path, wholetext=whole).select(F.input_file_name().alias("file"), F.from_json("value", f"struct<symbols:map<string,{SYMBOL_V2}>>").alias("m"))
    return one.select("file", F.explode("m.symbols").alias("name", "s")).select("file", "name", "s.*")


PROFILE = "archetypes array<struct<label:string,extension:string,class:string,count:bigint>>, _bad string"


def read_profiles(documents: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(profile, place, label, extension, class, count, reason) of profiles, one JSON document a row (profile, body): a row
    for each archetype. reason is null for good ones; others name an unknown class, or repeat a label and extension (but
    for case) of an archetype before them in their profile. A body that is no such document has one row with that reason."""
    read = documents.select("profile", F.from_json("body", PROFILE, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("p"), F.col("body").isNull().alias("none"))
    broken = F.col("none") | F.col("p._bad").isNotNull() | F.col("p").isNull()
    each = read.select("profile", broken.alias("broken"), F.posexplode_outer(F.when(~broken, F.coalesce("p.archetypes", F.array()))).alias("place", "a"))
    rows = each.where("broken or place is not null").select("profile", "broken", F.col("place").cast("long").alias("place"), "a.*")
    plain = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    turn = F.row_number().over(Window.partitionBy("profile", plain("label"), plain("extension"), "broken").orderBy("place"))
    reason = F.when(F.col("broken"), "not a profile").when(~F.coalesce(F.col("class").isin(*labels), F.lit(False)), "unknown class").when(turn > 1, "stands twice")
    return rows.withColumn("reason", reason).drop("broken")


def words_of_link(line: Column) -> Column:
    """struct<script, dirs, objects> of a link line, in its order: the value of the last -T, of all -L, and what ends in .o
    or .a and is neither an option nor the value of one."""
    words = F.filter(F.split(line, " "), lambda w: w != "")
    start = F.struct(F.lit("").alias("wants"), F.lit(None).cast("string").alias("script"), F.array().cast("array<string>").alias("dirs"), F.array().cast("array<string>").alias("objects"))

    def step(s: Column, w: Column) -> Column:
        free = s["wants"] == ""
        an_object = free & ~w.startswith("-") & (w.endswith(".o") | w.endswith(".a"))
        return F.struct(
            F.when(free & w.isin("-T", "-L", "-o"), w).otherwise("").alias("wants"),
            F.when(s["wants"] == "-T", w).otherwise(s["script"]).alias("script"),
            F.when(s["wants"] == "-L", F.concat(s["dirs"], F.array(w))).otherwise(s["dirs"]).alias("dirs"),
            F.when(an_object, F.concat(s["objects"], F.array(w))).otherwise(s["objects"]).alias("objects"),
        )

    return F.aggregate(F.slice(words, 2, 2_000_000_000), start, step)


def plain_path(path: Column) -> Column:
    """A relative path without empty parts, "." and, where a part stands before it, ".."."""
    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def build_scopes(logs: DataFrame, linker: str = "ld.lld", block: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Build logs (log, n, line), of any length. (scopes, lines): scopes (log, n, script, dirs, objects, error) of each log's
    last link line; a log without one, or whose link line has no script, has an error. lines are the rows of logs
    with linked: the number of the link line before or at each, null before the first."""
    link = F.coalesce(F.ltrim("line").startswith(linker + " "), F.lit(False))
    last = logs.groupBy("log").agg(F.max(F.when(link, F.struct("n", "line"))).alias("x")).select("log", "x.n", words_of_link(F.ltrim("x.line")).alias("w"))
    error = F.when(F.col("n").isNull(), f"no {linker} line").when(F.col("w.script").isNull(), "the link line has no script")
    objects = F.array_sort(F.array_distinct(F.transform("w.objects", plain_path)))
    scopes = last.select("log", "n", plain_path(F.col("w.script")).alias("script"), F.col("w.dirs").alias("dirs"), objects.alias("objects"), error.alias("error"))
    return scopes, carried(logs, F.when(link, F.col("n")), ["log"], "n", block, "linked")


def read_profile(text: str, labels: tuple[str, ...]) -> dict:
    """A profile; archetype classes must be known, label and extension unique without case."""
    whole = load_json(text)
    seen: set[tuple[str, str]] = set()
    for a in whole.get("archetypes", []):
        if a.get("class") not in labels:
            raise BadInput(f"unknown class {a.get('class')}")
        key = (str(a.get("label", "")).lower(), str(a.get("extension", "")).lower())
        if key in seen:
            raise BadInput(f"archetype {key} stands twice")
        seen.add(key)
    return whole


def read_compile_db(spark: SparkSession, text: str, root: str = "") -> DataFrame:
    """(unit, incs array, defines array) of a compile database; a flag and its value may be one word or two."""
    load_json(text)
    kind = "array<struct<directory:string,file:string,arguments:array<string>,command:string>>"
    entries = spark.createDataFrame([(text,)], "body string").select(F.posexplode(F.from_json("body", kind)).alias("i", "e"))
    words = F.coalesce("e.arguments", F.filter(F.split("e.command", " "), lambda w: w != ""))

    def values(flag: str):
        def at(w, i):
            return F.when((F.get(words, i - 1) == flag) & (i > 1), w).when(w.startswith(flag) & (F.length(w) > len(flag)) & ~F.coalesce(F.get(words, i - 1).isin("-I", "-D") & (i > 1), F.lit(False)), F.substr(w, F.lit(len(flag) + 1)))

        return F.array_compact(F.transform(F.slice(F.transform(words, at), 2, 1_000_000), lambda x: x))

    return entries.select(F.col("e.file").alias("unit"), values("-I").alias("incs"), values("-D").alias("defines"), "i").orderBy("i").drop("i")


def read_build_log(text: str, linker: str = "ld.lld") -> dict:
    """Script, library directories and objects of the last link line of a build log."""
    lines = [x for x in text.splitlines() if x.lstrip().startswith(linker + " ")]
    if not lines:
        raise BadInput(f"no {linker} line")
    words = iter(lines[-1].split()[1:])
    script, dirs, objects = None, [], []
    for w in words:
        if w in ("-T", "-L", "-o"):
            value = next(words, None)
            script = value if w == "-T" else script
            dirs += [value] * (w == "-L" and value is not None)
        elif not w.startswith("-") and w.endswith((".o", ".a")):
            objects.append(posixpath.normpath(w))
    if script is None:
        raise BadInput("the link line has no script")
    return {"script": posixpath.normpath(script), "dirs": dirs, "objects": sorted(set(objects))}
