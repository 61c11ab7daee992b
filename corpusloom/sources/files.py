"""Reading corpora: file trees, directory statistics, prefixes, tables bound as corpora."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import PREFIX


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path relative to root, name, size, content) of all files below root, by Spark's own reader. Links are a matter of the
    file system: use local_listing first where a tree may hold any."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})") if base else F.col("path")
    return found.select(rel.alias("path"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("size"), "content")


def prefix(files: DataFrame, most: int = PREFIX) -> DataFrame:
    return files.withColumn("content", F.substring("content", 1, most))


def local_listing(root: str) -> tuple[list[tuple[str, int]], list[str], int]:
    """((path, size) of files, directories, unreadable files) of a local tree, links left out."""
    files, dirs, unreadable = [], [], 0
    for at, below, names in os.walk(root):
        below[:] = sorted(d for d in below if not os.path.islink(os.path.join(at, d)))
        dirs += [os.path.relpath(os.path.join(at, d), root).replace(os.sep, "/") for d in below]
        for name in names:
            full = os.path.join(at, name)
            try:
                seen = os.lstat(full)
            except OSError:
                unreadable += 1
                continue
            if stat.S_ISREG(seen.st_mode):
                files.append((os.path.relpath(full, root).replace(os.sep, "/"), seen.st_size))
    return sorted(files), sorted(dirs), unreadable


def documents_as_files(documents: DataFrame) -> DataFrame:
    """Documents as a corpus: path source/lang/doc_id, extension the language."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?")), F.col("doc_id").cast("string"))
    return documents.select("doc_id", path.alias("path"), F.coalesce("lang", F.lit("?")).alias("ext"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), "text")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(name) lines of a plain or gzip list."""
    return spark.read.text(path).withColumnRenamed("value", "name")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(name, case, site) of a tab-separated list with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema="name string, case string, site string", enforceSchema=False)
