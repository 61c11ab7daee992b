"""Integrity checks as relations: each check returns violations (check, key, site, reason); union them, group for the
verdict. All joins are equi-joins, semi or anti where only existence counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import broadcast_if_small

COLUMNS = ("check", "key", "site", "reason")


def violation(df: DataFrame, check: str, key: Column | str, reason: Column | str, site: Column | None = None) -> DataFrame:
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(F.lit(check).alias("check"), as_column(key).cast("string").alias("key"), (site if site is not None else F.lit(None)).cast("string").alias("site"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def undeclared_roots(roots: DataFrame, symbols: DataFrame) -> DataFrame:
    """roots (name) that no symbol has."""
    return violation(roots.join(symbols.select("name"), "name", "left_anti"), "roots", "name", "root is not a symbol")


def dangling_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges (src, dst) to no symbol."""
    return edges.join(symbols.select(F.col("name").alias("dst")), "dst", "left_anti").select("src", "dst")


def indirect_mismatches(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges (source, target, resolved) whose flag differs from whether the target is a symbol."""
    known = symbols.select(F.col("name").alias("target"), F.lit(True).alias("known"))
    joined = edges.join(known, "target", "left").where(F.col("resolved") != F.col("known").isNotNull())
    return violation(joined, "indirect", F.concat_ws("->", "source", "target"), F.when(F.col("resolved"), "resolved target is missing").otherwise("unresolved target is a symbol"))


def site_mismatches(sites: DataFrame, lines: DataFrame, check: str = "site", definition: bool = False) -> DataFrame:
    """sites (name, site) whose line (path, n, content) is missing or does not hold name: followed by ( for a
    definition, as a whole word otherwise."""
    placed = sites.select("name", "site", S.site_path(F.col("site")).alias("path"), S.site_line(F.col("site")).alias("n"))
    joined = placed.join(lines.select("path", F.col("n").cast("int").alias("n"), "content"), ["path", "n"], "left")
    holds = F.contains("content", F.concat("name", F.lit("("))) if definition else S.whole_word(F.col("content"), F.col("name"))
    reason = F.when(~F.coalesce(S.is_site(F.col("site")), F.lit(False)), "site is not canonical").when(F.col("content").isNull(), "no such line").when(~holds, "line does not hold the name")
    return violation(joined.withColumn("reason", reason).where("reason IS NOT NULL"), check, "name", F.col("reason"), F.col("site"))


def gated_refs(sites: DataFrame, lines: DataFrame, guard: str = "#ifdef VENDOR_OK", absent: str = r"VENDOR_missing_.*\.h$") -> DataFrame:
    """Gated sites whose file lacks the guard, or that are ungated because a file that must be absent exists."""
    placed = sites.select("name", "site", S.site_path(F.col("site")).alias("path"), S.site_line(F.col("site")).alias("n"))
    guarded = lines.where(F.contains("content", F.lit(guard))).select("path").distinct().withColumn("guarded", F.lit(True))
    present = lines.where(F.col("path").rlike(absent)).select(F.lit(True).alias("present")).limit(1)
    joined = placed.join(lines.select("path", F.col("n").cast("int").alias("n"), "content"), ["path", "n"], "left").join(guarded, "path", "left").join(F.broadcast(present), F.lit(True), "left")
    reason = F.when(F.col("content").isNull() | ~S.whole_word(F.col("content"), F.col("name")), "line does not hold the name").when(F.col("guarded").isNull(), "file has no guard").when(F.col("present"), "the gating header exists")
    return violation(joined.withColumn("reason", reason).where("reason IS NOT NULL"), "gated", "name", F.col("reason"), F.col("site"))


def expected_misses(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """symbols (name, site, macro) that must be made by macro: name does not stand in the line, macro does."""
    placed = symbols.select("name", "macro", "site", S.site_path(F.col("site")).alias("path"), S.site_line(F.col("site")).alias("n"))
    joined = placed.join(lines.select("path", F.col("n").cast("int").alias("n"), "content"), ["path", "n"], "left")
    reason = F.when(F.col("content").isNull(), "no such line").when(S.whole_word(F.col("content"), F.col("name")), "the name is literally there").when(~S.whole_word(F.col("content"), F.col("macro")), "the macro is not there")
    return violation(joined.withColumn("reason", reason).where("reason IS NOT NULL"), "expected-miss", "name", F.col("reason"), F.col("site"))


def dup_group_mismatches(groups: DataFrame, files: DataFrame) -> DataFrame:
    """groups (name, sha256, paths, near_variants) against files (path, content): members must have the hash, variants not."""
    members = groups.select("name", "sha256", F.explode("paths").alias("path"), F.lit(True).alias("same")).union(groups.select("name", "sha256", F.explode("near_variants"), F.lit(False)))
    hashed = members.join(files.select("path", F.sha2("content", 256).alias("found")), "path", "left")
    reason = F.when(F.col("found").isNull(), "file is missing").when(F.col("same") & (F.col("found") != F.col("sha256")), "hash differs").when(~F.col("same") & (F.col("found") == F.col("sha256")), "variant is identical")
    return violation(hashed.withColumn("reason", reason).where("reason IS NOT NULL"), "dup", "name", F.col("reason"), F.col("path"))


def duplicate_groups(files: DataFrame, key: str, content: str) -> DataFrame:
    """(sha, copies, first) of contents that stand more than once."""
    return files.groupBy(F.sha2(content, 256).alias("sha")).agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")


def resolve_includes(includes: DataFrame, dirs: DataFrame, files: DataFrame) -> DataFrame:
    """First hit of each include (id, from_dir, spec, angled, found_idx, next): the includer's own directory for quoted
    ones, then dirs (idx, dir) in order; next starts after the directory in which the includer was found. Result: id,
    path, idx (-1: own directory)."""
    own = includes.where("NOT angled AND NOT (next AND found_idx >= 0)").select("id", F.lit(-1).alias("idx"), F.col("from_dir").alias("dir"), "spec")
    least = F.when(F.col("next") & (F.col("found_idx") >= 0), F.col("found_idx") + 1).otherwise(0)
    # the search path is a list of directories of the build: its size does not follow the corpus, and is checked
    searched = includes.crossJoin(broadcast_if_small(dirs, 100_000)).where(F.col("idx") >= least).select("id", "idx", "dir", "spec")
    path = F.when(F.col("dir") == "", F.col("spec")).otherwise(F.concat_ws("/", "dir", "spec"))
    flat = S.folded_path(F.col("path"))
    hits = own.unionByName(searched).select("id", "idx", path.alias("path")).where(S.contained(F.col("path"))).select("id", "idx", flat.alias("path")).join(files.select("path"), "path", "left_semi")
    return hits.groupBy("id").agg(F.min_by("path", "idx").alias("path"), F.min("idx").alias("idx"))


def compared(declared: DataFrame, found: DataFrame, keys: list[str], fields: list[str], check: str) -> DataFrame:
    """Full outer comparison field by field: missing, invented, or differing rows."""
    left = declared.select(*keys, F.struct(*fields).alias("declared"))
    right = found.select(*keys, F.struct(*fields).alias("found"))
    joined = left.join(right, keys, "full_outer")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"declared.{f}").eqNullSafe(F.col(f"found.{f}")), F.lit(f)) for f in fields])) if fields else F.array().cast("array<string>")
    reason = F.when(F.col("declared").isNull(), "found but not declared").when(F.col("found").isNull(), "declared but not found").when(F.size(wrong) > 0, F.concat(F.lit("differs in "), F.array_join(wrong, ",")))
    return violation(joined.withColumn("reason", reason).where("reason IS NOT NULL"), check, F.concat_ws("|", *keys), F.col("reason"))


def compile_db_mismatches(units: DataFrame, entries: DataFrame, dirs: list[str]) -> DataFrame:
    """units (unit) without an entry (unit, incs), or with other include directories or another order."""
    joined = units.join(entries, "unit", "left")
    wanted = F.array(*[F.lit(d) for d in dirs]) if dirs else F.array().cast("array<string>")
    reason = F.when(F.col("incs").isNull(), "no entry").when(F.col("incs") != wanted, "include directories differ")
    return violation(joined.withColumn("reason", reason).where("reason IS NOT NULL"), "compile-db", "unit", F.col("reason"))


def undeclared_definitions(lines: DataFrame, defs: DataFrame, pattern: str) -> DataFrame:
    """Lines (path, n, content) that look like a definition and are no symbol's def (path, n)."""
    missing = lines.where(F.col("content").rlike(pattern)).join(defs, ["path", "n"], "left_anti")
    return violation(missing, "completeness", F.concat_ws(":", "path", "n"), "definition is no symbol's")


def refs_on_definitions(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """refs (name, site) that stand on a definition's site."""
    return violation(refs.join(defs.select("site").distinct(), "site", "left_semi"), "ref-is-def", "name", "a reference stands on a definition", F.col("site"))


#: Kinds that an edge of each sort may point to.
TARGET_KINDS = {"implicit": ("ctor", "dtor"), "member-ptr": ("method",), "instance-of": ("template",)}


def kind_mismatches(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges (src, dst, sort) whose target (name, kind) is missing or of a kind that the sort may not point to; direct
    edges may not point to classes or templates."""
    joined = edges.join(symbols.select(F.col("name").alias("dst"), F.col("kind"), F.lit(True).alias("known")), "dst", "left")
    bad = (F.col("sort") == "direct") & F.col("kind").isin("class", "template")
    for sort, kinds in TARGET_KINDS.items():
        bad = bad | ((F.col("sort") == sort) & ~F.coalesce(F.col("kind").isin(list(kinds)), F.lit(False)))
    return violation(joined.where(F.col("known").isNull() | bad), "kind", F.concat_ws("->", "src", "dst"), F.when(F.col("known").isNull(), "target is missing").otherwise("target is of a wrong kind"))


def resolve_names(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (unit, name) to nodes (key, unit, name, local): the unit's own local nodes shadow all global ones."""
    local = refs.join(nodes.where("local").select("unit", "name", "key"), ["unit", "name"])
    rest = refs.join(local.select("unit", "name").distinct(), ["unit", "name"], "left_anti")
    return local.unionByName(rest.join(nodes.where("NOT local").select("name", "key"), "name").select("unit", "name", "key"))


def affix_matches(patterns: DataFrame, names: DataFrame, digits_only: bool = False) -> DataFrame:
    """(id, name): names that start with prefix and end with suffix, without overlap. Patterns (id, prefix, suffix) meet names
    by their whole prefix, or without one by their whole suffix: a name stands under its beginnings (or ends) of those
    lengths that patterns have, which are few."""
    fits = (F.length("name") >= F.length("prefix") + F.length("suffix")) & F.startswith("name", F.col("prefix")) & F.endswith("name", F.col("suffix"))
    if digits_only:
        middle = F.expr("substring(name, length(prefix) + 1, length(name) - length(prefix) - length(suffix))")
        fits = fits & middle.rlike("^[0-9]+$")

    def met(side: DataFrame, by: str, part: str) -> DataFrame:
        lengths = [r.n for r in side.select(F.length(by).alias("n")).distinct().collect() if r.n]
        parts = F.array(*[F.when(F.length("name") >= n, F.expr(f"{part}(name, {n})")) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>")
        return side.join(names.select("name", F.explode(F.array_compact(parts)).alias("k")), F.col(by) == F.col("k"))

    found = met(patterns.where("prefix <> ''"), "prefix", "left").unionByName(met(patterns.where("prefix = '' AND suffix <> ''"), "suffix", "right"))
    return found.where(fits).select("id", "name").distinct()


def base_mismatches(class_lines: DataFrame, bases: DataFrame) -> DataFrame:
    """class_lines (cls, content) whose base list differs from bases (cls, declared array), in order."""
    listed = F.regexp_extract("content", r"^\s*(?:class|struct)\s+\w+[^:]*:\s*([^{]*)", 1)
    found = F.transform(F.filter(F.split(listed, ","), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.trim(x), r"^(?:(?:public|protected|private|virtual)\s+)*", ""))
    joined = class_lines.select("cls", found.alias("found")).join(bases, "cls", "full_outer")
    return violation(joined.where(~F.col("found").eqNullSafe(F.col("declared"))), "bases", "cls", "base list differs")


def repeated_items(df: DataFrame, key: str, items: str) -> DataFrame:
    return violation(df.where(F.size(items) != F.size(F.array_distinct(items))), "repeated", key, "list holds an item twice")


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def verdict(checked: DataFrame, violations: DataFrame) -> DataFrame:
    """(check, passed, failed) from checked (check, n) and violations; no checks at all is an error of the caller."""
    failed = violations.groupBy("check").agg(F.count("*").alias("failed"))
    joined = checked.join(failed, "check", "full_outer")
    return joined.select("check", (F.coalesce("n", F.lit(0)) - F.coalesce("failed", F.lit(0))).alias("passed"), F.coalesce("failed", F.lit(0)).alias("failed"))


def report(violations: DataFrame, top: int = 20) -> list[str]:
    """The first lines of a report, and how many more there are."""
    total = violations.count()
    lines = [f"{r.check}: {r.key} {r.site or ''} {r.reason}" for r in violations.orderBy("check", "key", "site").limit(top).collect()]
    return lines + ([f"... and {total - top} more"] if total > top else [])


def byte_mass(symbols: DataFrame) -> DataFrame:
    """One row: symbols, and the bytes of those whose bytes are known."""
    return symbols.agg(F.count("*").alias("symbols"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def only_here(mine: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """The rows of mine whose keys others lack."""
    return mine.join(others.select(*keys).distinct(), list(keys), "left_anti")


def first_occurrences(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """Of rows with the same keys the one that comes first in order; (keys..., order, all other columns)."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("x")).select(*keys, "x.*")
