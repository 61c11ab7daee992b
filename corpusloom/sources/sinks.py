"""Writing manifests, profiles, deltas, sharded tables and lists. Tables of any size go through Spark's committers, whose
_SUCCESS marker readers check; single small documents go through one rename. A document of any size is written as lines in
parallel, in parts that follow each other by name, and may be joined to one file by a copy of bounded pieces."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import POSTURES
from ..operators.delta import shard_index, shards

#: Lists larger than this are compressed.
COMPRESS_FROM = 100 << 20


def write_atomic(path: str, body: bytes, text: bool = True) -> None:
    """One document, complete or not there at all; of text, CRs are dropped."""
    folder = os.path.dirname(path) or "."
    with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
        f.write(body.replace(b"\r", b"") if text else body)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def symbols_json(symbols: DataFrame) -> DataFrame:
    """(name, body): each symbol as JSON; null fields are left out."""
    return symbols.select("name", F.to_json(F.struct(*[c for c in symbols.columns if c not in ("name", "ord")])).alias("body"))


#: Bytes that a copy holds at once.
PIECE = 1 << 20


def document_lines(entries: DataFrame, head: str, foot: str, order: str = "name") -> DataFrame:
    """(part, key, line) of a JSON object with a line for each of entries (name, body), which stand between head and foot in
    the order of a column without ties."""
    spark = entries.sparkSession
    first = entries.agg(F.min(order).alias("first")).first()["first"]
    comma = F.when(F.col(order) == F.lit(first), "").otherwise(",")
    kind = entries.schema[order].dataType
    edge = lambda part, line: spark.range(1).select(F.lit(part).alias("part"), F.lit(None).cast(kind).alias("key"), F.lit(line).alias("line"))
    quoted = F.expr("substring(to_json(array(name)), 2, length(to_json(array(name))) - 2)")
    body = entries.select(F.lit(1).alias("part"), F.col(order).alias("key"), F.concat(comma, quoted, F.lit(": "), "body").alias("line"))
    return edge(0, head).unionByName(body).unionByName(edge(2, foot))


def manifest_lines(symbols: DataFrame, meta: dict) -> DataFrame:
    """The lines of a manifest in order of ord, else of name; null fields are left out."""
    order = "ord" if "ord" in symbols.columns else "name"
    body = F.to_json(F.struct(*[c for c in symbols.columns if c not in ("name", "ord")]))
    entries = symbols.select(*dict.fromkeys(("name", order)), body.alias("body"))
    return document_lines(entries, '{"_meta": ' + json.dumps(meta) + ', "symbols": {', "}}", order)


def overlay_lines(overlay: DataFrame) -> DataFrame:
    """The lines of a symbol delta: changed entries, and TOMBSTONE for what is gone."""
    entry = F.when(F.col("op") == "TOMBSTONE", F.lit('"TOMBSTONE"')).otherwise(F.to_json(F.struct("def", "refs", "edges", F.col("removed_sites").alias("removedSites"))))
    return document_lines(overlay.select("name", entry.alias("body")), "{", "}")


def write_lines(lines: DataFrame, path: str, order: tuple[str, ...] = ("part", "key"), line: str = "line") -> None:
    """The lines as text in parallel; parts follow each other by name."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of text written by write_lines, n from 1 over all parts in the order of their names. A part is one row while
    its lines are counted (2 GB at most)."""
    parts = spark.read.text(path, wholetext=True).where("value <> ''").select(F.col("_metadata.file_name").alias("part"), F.split(F.regexp_replace("value", r"\n\z", ""), "\n").alias("lines"))
    before = F.coalesce(F.sum(F.size("lines")).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("before"))  # a row for each part
    return parts.join(starts, "part").select(F.posexplode("lines").alias("i", "line"), "before").select((F.col("before") + F.col("i") + 1).alias("n"), "line")


def pieces(folder: str):
    """The bytes of the parts of a local or mounted folder, one after another, in bounded pieces."""
    folder = folder.removeprefix("file://")
    for name in sorted(n for n in os.listdir(folder) if n.startswith("part-")):
        with open(os.path.join(folder, name), "rb") as f:
            while piece := f.read(PIECE):
                yield piece


def joined(folder: str, path: str) -> None:
    """The parts of a folder as one file, complete or not there at all."""
    with tempfile.NamedTemporaryFile(dir=os.path.dirname(path) or ".", delete=False) as f:
        for piece in pieces(folder):
            f.write(piece.replace(b"\r", b""))
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def write_manifest(symbols: DataFrame, meta: dict, path: str) -> None:
    """A manifest as one file; its parts stay beside it in path.parts."""
    write_lines(manifest_lines(symbols, meta), path + ".parts")
    joined(path + ".parts", path)


def write_profile(sections: dict[str, DataFrame], posture: str, path: str) -> None:
    """The sections of a profile that the posture lets out, as one document; sections are small by construction."""
    reads, exact = POSTURES[posture]
    hidden = set() if exact else {"content"}
    hidden |= set() if reads else {"classes", "densities", "parsed_source_by_class", "indexed"}
    body = {k: [r.asDict(recursive=True) for r in df.collect()] for k, df in sections.items() if k not in hidden}
    write_atomic(path, json.dumps(body | {"posture": posture}, indent=1, sort_keys=True).encode())


def write_overlay(overlay: DataFrame, path: str) -> None:
    """A symbol delta as one file; its parts stay beside it in path.parts."""
    write_lines(overlay_lines(overlay), path + ".parts")
    joined(path + ".parts", path)


def write_ordered(rows: DataFrame, path: str, order: str = "path") -> None:
    """Rows as JSON lines in order, in parallel: range partitions follow each other by name."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.json(path)


def write_conflicts(regions: DataFrame, path: str) -> None:
    regions.repartitionByRange("path", "base_start").sortWithinPartitions("path", "base_start", "base_lines").write.json(path)


def write_sharded(rows: DataFrame, order: str, size: int, path: str) -> DataFrame:
    """Rows in shards of at most size, in order; the index is written last, so that it vouches for the shards."""
    cut = shards(rows, order, size)
    cut.write.partitionBy("shard").json(f"{path}/shards")
    index = shard_index(cut, order)
    index.coalesce(1).write.json(f"{path}/index")
    return index


def write_list(names: DataFrame, name: str, path: str, hash_only: bool = False) -> tuple[str, int]:
    """(sha, count) of a column of names, written in order with LF ends, compressed when large. The names are written in
    parallel to path.parts, from where the digest, which is sequential, takes them in bounded pieces."""
    write_lines(names, path + ".parts", (name,), name)
    h, n, size = hashlib.sha256(), 0, 0
    for piece in pieces(path + ".parts"):
        h.update(piece)
        n += piece.count(b"\n")
        size += len(piece)
    if not hash_only and size <= COMPRESS_FROM:
        joined(path + ".parts", path)
    elif not hash_only:
        with tempfile.NamedTemporaryFile(dir=os.path.dirname(path) or ".", delete=False) as f, gzip.GzipFile(fileobj=f, mode="wb", mtime=0) as packed:
            for piece in pieces(path + ".parts"):
                packed.write(piece)
        os.replace(f.name, path + ".gz")
    return h.hexdigest(), n


def write_files(files: DataFrame, root: str) -> None:
    """Files (path, content) of a tree below a local or mounted folder, each written by the task that holds it, under a name
    of its own first and then renamed, so that a task that runs twice leaves one whole file."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                write_atomic(full, content or b"", text=False)
            yield batch.slice(0, 0)

    root = root.removeprefix("file://")
    files.select("path", F.col("content").cast("binary")).mapInArrow(run, "path string, content binary").write.format("noop").mode("overwrite").save()


def carve(lines: DataFrame, dropped: DataFrame) -> DataFrame:
    """(path, text) of lines (path, n, content, term) without the define lines of dropped names (name)."""
    from ..operators.delta import rebuilt

    name = F.regexp_extract("content", r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_][A-Za-z0-9_]*)", 1)
    return rebuilt(lines.withColumn("name", name).join(dropped.select("name"), "name", "left_anti").drop("name"))
