"""Text functions: three line models, line tallies, include targets, digests of content.

The three line models differ on purpose: lines_lf splits at line feeds and keeps an empty last line (classifier);
lines_any ends a line at LF, CRLF or a lone CR and starts none after the last (editor); logical_lines joins
continuations and takes comments out (preprocessor, in preproc.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"

#: Tests of one line; ^ is the line's first character that is no blank.
LINE_TESTS = {
    "define": r"^[ \t]*#[ \t]*define(?![A-Za-z0-9_])",
    "include": r"^[ \t]*#[ \t]*include(?![A-Za-z0-9_])",
    "comment": r"^[ \t]*(//|/\*|\*)",
    "body": r"\) *\{",
    "control": r"^[ \t]*(if|for|while|switch|catch|else|do)(?![A-Za-z0-9_])",
    "template": r"template *<",
    "enum_struct": r"^[ \t]*(enum|struct|union|typedef)(?![A-Za-z0-9_])",
    "table_row": r"\},",
    "x_macro": r"^[ \t]*[A-Z_][A-Z0-9_]{2,}\(",
}


def lines_lf(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., n from 1, line): split at LF, one CR at the end stripped into has_cr."""
    cut = df.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("n", "raw"))
    return cut.select(*keep, (F.col("n") + 1).alias("n"), F.regexp_replace("raw", "\r$", "").alias("line"), F.col("raw").endswith("\r").alias("has_cr"))


def lines_any(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., n from 1, content, term): LF, CRLF or CR end a line; a text's last terminator starts no line."""
    found = F.filter(F.regexp_extract_all(F.col(text), F.lit("[^\\r\\n]*(?:\\r\\n|\\n|\\r|$)"), F.lit(0)), lambda x: x != "")
    cut = df.select(*keep, F.posexplode(found).alias("n", "raw"))
    return cut.select(*keep, (F.col("n") + 1).alias("n"), F.regexp_extract("raw", "^[^\\r\\n]*", 0).alias("content"), F.regexp_extract("raw", "[\\r\\n]*$", 0).alias("term"))


def include_target(line: Column) -> Column:
    """Lower-cased base name of an include line's first quoted or angled part; empty if none of 1 to 255 characters."""
    spec = F.coalesce(
        F.nullif(F.regexp_extract(line, r'^[^"<]*"([^"]*)"', 1), F.lit("")),
        F.nullif(F.regexp_extract(line, r'^[^"<]*<([^>]*)>', 1), F.lit("")),
        F.lit(""),
    )
    base = F.lower(F.regexp_extract(spec, r"[^/\\]*$", 0))
    return F.when(F.length(base).between(1, 255), base).otherwise(F.lit(""))


def encoding(content: Column) -> Column:
    """(encoding, bom) from the first bytes."""
    head = F.hex(F.substring(content, 1, 3))
    name = F.when(head == "EFBBBF", "utf-8").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be").otherwise("ascii")
    return F.struct(name.alias("encoding"), (name != "ascii").alias("bom"))


def line_tallies(lines: DataFrame, *keys: str) -> DataFrame:
    """Sums over the lines (n, line, has_cr) of each key: counts that the content class depends on."""
    hit = {k: F.col("line").rlike(v) for k, v in LINE_TESTS.items()}
    blank = ~F.col("line").rlike(r"[^ \t]")
    names = F.regexp_extract_all("line", F.lit(IDENTIFIER), F.lit(0))
    calls = F.regexp_count("line", F.lit(IDENTIFIER + r"\("))
    count = lambda c: F.sum((c & ~blank).cast("long"))
    return lines.groupBy(*keys).agg(
        F.count("*").alias("lines"),
        F.sum(blank.cast("long")).alias("blank"),
        count(hit["define"]).alias("defines"),
        count(hit["include"] & ~hit["define"]).alias("includes"),
        count(hit["comment"] & ~hit["define"] & ~hit["include"]).alias("comments"),
        count(hit["body"] & ~hit["control"]).alias("functions"),
        count(hit["template"]).alias("templates"),
        count(hit["enum_struct"]).alias("enum_structs"),
        count(hit["table_row"]).alias("table_rows"),
        count(hit["x_macro"]).alias("x_macros"),
        F.sum(F.size(names)).cast("long").alias("idents"),
        F.sum(F.length(F.array_join(names, ""))).cast("long").alias("ident_chars"),
        F.sum(calls).cast("long").alias("calls"),
        F.sum(F.octet_length("line")).cast("long").alias("line_bytes"),
        F.max(F.octet_length("line")).cast("long").alias("max_line"),
        F.sum(F.col("has_cr").cast("long")).alias("cr_lines"),
    )


def distinct_identifiers(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys..., distinct_idents), counted exactly: distinct per key before the count, so that nothing is collected."""
    names = lines.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(IDENTIFIER), F.lit(0)))).alias("name"))
    return names.distinct().groupBy(*keys).agg(F.count("*").alias("distinct_idents"))


def modal_commas(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys..., commas, hits): the most frequent comma count over lines without a call, leaving out 0; ties go to the
    count that comes first."""
    called = F.col("line").rlike(IDENTIFIER + r"\(")
    commas = F.when(called, 0).otherwise(F.regexp_count("line", F.lit(",")))
    per = lines.where(F.col("line").rlike(r"[^ \t]")).select(*keys, "n", commas.alias("commas")).where("commas > 0").groupBy(*keys, "commas").agg(F.count("*").alias("hits"), F.min("n").alias("first"))
    return per.groupBy(*keys).agg(F.max_by(F.struct("commas", "hits"), F.struct("hits", -F.col("first"))).alias("x")).select(*keys, "x.*")


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def density_counts(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys..., substantive, defines) of lines (line): lines that are neither blank nor a comment's start."""
    blank, comment = ~F.col("line").rlike(r"[^ \t\r]"), F.col("line").rlike(r"^[ \t\r]*/[/*]")
    define = F.col("line").rlike(r"^[ \t\r]*#[ \t]*define(?![A-Za-z0-9_])")
    return lines.groupBy(*keys).agg(F.sum((~blank & ~comment).cast("long")).alias("substantive"), F.sum((~blank & ~comment & define).cast("long")).alias("defines"))


def density_verdict(substantive: Column, defines: Column) -> tuple[Column, Column]:
    """Whether a file is define-dense (50 lines or more, 60 % defines), and whether one line more or less flips that."""
    dense = lambda s, d: (s >= 50) & (10 * d >= 6 * s)
    now = dense(substantive, defines)
    flips = (dense(substantive, defines + 1) != now) | ((defines > 0) & (dense(substantive, defines - 1) != now)) | (dense(substantive + 1, defines) != now)
    return now, flips | ((substantive > 0) & (dense(substantive - 1, F.least(defines, substantive - 1)) != now))
