"""Canonical digests of relations: SHA-256 over sections of sorted records.

Fields are joined by US, each record is followed by RS, sections are separated by GS and always present. Except in the
truth digest, a section holds each record once. Records are sorted in parallel, in ranges, and written as pieces of text.
SHA-256 itself goes through its input one piece after another: one task takes the sorted pieces and holds a batch of them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

US, RS, GS = "\x1f", "\x1e", "\x1d"


def record(*fields: Column | str) -> Column:
    """Fields as one record's text; booleans become 1 and 0, nulls become empty."""
    return F.concat_ws(US, *[F.coalesce(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string"), F.lit("")) for c in fields])


def flag(c: str | Column) -> Column:
    return F.when(F.col(c) if isinstance(c, str) else c, "1").otherwise("0")


#: Bytes of text in a row of what is digested.
PIECE = 16 << 10


def section(df: DataFrame, rec: Column, distinct: bool = True) -> DataFrame:
    """The section's records (once, text)."""
    return df.select(F.lit(distinct).alias("once"), rec.alias("text"))


def pieces(sections: list[DataFrame]) -> DataFrame:
    """(section, part, n, text): the sections' records in order, each with RS behind it, cut into pieces of PIECE bytes at
    most. Where a section holds a record once, equal ones meet in one part and follow each other there."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, n, last = TaskContext.get().partitionId(), 0, (None, None)
        for batch in batches:
            for at in pc.unique(batch.column(0)).to_pylist():  # few: batches are sorted by section
                rows = batch.filter(pc.equal(batch.column(0), at))
                text = rows.column(2)
                before = pa.array([last[1] if last[0] == at else None], text.type)
                last = at, text[-1].as_py()
                if rows.column(1)[0].as_py():
                    before = pa.concat_arrays([before, text[:-1]])
                    text = text.filter(pc.fill_null(pc.not_equal(text, before), True))
                joined = pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text)
                ended = pc.binary_join(joined, RS.encode())[0].as_py() + RS.encode() if len(text) else b""
                cut = [ended[i : i + PIECE] for i in range(0, len(ended), PIECE)]
                columns = ([at] * len(cut), pa.int32()), ([part] * len(cut), pa.int32()), (range(n, n + len(cut)), pa.int64()), (cut, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["section", "part", "n", "text"])
                n += len(cut)

    rows = [s.select(F.lit(i).alias("section"), "once", F.col("text").cast("binary").alias("text")) for i, s in enumerate(sections)]
    dealt = functools.reduce(DataFrame.unionByName, rows).repartitionByRange("section", "text").sortWithinPartitions("section", "text")
    return dealt.mapInArrow(run, "section int, part int, n long, text binary")


def combined(*sections: DataFrame) -> DataFrame:
    """One row sha: the digest of sections."""

    def run(batches):
        import pyarrow as pa

        h, now = hashlib.sha256(), 0
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h.update(GS.encode() * (at - now))
                h.update(text.as_buffer())
                now = at
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["sha"])

    cut = written(pieces(list(sections)), "pieces")
    end = cut.sparkSession.range(1).select(F.lit(len(sections) - 1).alias("section"), F.lit((1 << 31) - 1).alias("part"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("text"))
    whole = cut.unionByName(end).coalesce(1).sortWithinPartitions("section", "part", "n")
    return whole.select("section", "text").mapInArrow(run, "sha string")


def truth_sha(symbols: DataFrame) -> DataFrame:
    """symbols: name, def, refs array, edges array (strings), expected_miss. Refs and edges keep repetitions."""
    listed = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    return combined(section(symbols, record("name", "def", listed(F.col("refs")), listed(F.col("edges")), flag("expected_miss")), False))


def indirect_sha(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges: source, target, via, dispatched, resolved; roots: name."""
    return combined(section(edges, record("source", "target", "via", flag("dispatched"), flag("resolved"))), section(roots, record("name")))


def cpp_sha(virtual: DataFrame, implicit: DataFrame, member_ptr: DataFrame, kinds: DataFrame, static_roots: DataFrame) -> DataFrame:
    """virtual: source, static, cha array, rta array; implicit: source, target; member_ptr: source, target, via,
    dispatched; kinds: name, kind, instance_of; static_roots: name."""
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(c))), ",")
    return combined(
        section(virtual, record("source", "static", names("cha"), names("rta"))),
        section(implicit, record("source", "target")),
        section(member_ptr, record("source", "target", "via", flag("dispatched"))),
        section(kinds.where("kind IS NOT NULL"), record("name", "kind", "instance_of")),
        section(static_roots, record("name")),
    )


def diff_sha(files: DataFrame, hunks: DataFrame, runs: DataFrame, renames: DataFrame) -> DataFrame:
    """files: path, reason, old_sha, new_sha, old_size, new_size; hunks: path, op, old_start, old_lines, new_start,
    new_lines; runs: path, op, stride, range_start, range_end, per_hunk; renames: from, to, similarity_milli."""
    return combined(
        section(files, record("path", "reason", "old_sha", "new_sha", "old_size", "new_size")),
        section(hunks, record("path", "op", "old_start", "old_lines", "new_start", "new_lines")),
        section(runs, record("path", "op", "stride", "range_start", "range_end", "per_hunk")),
        section(renames, record("from", "to", "similarity_milli")),
    )


def conflict_sha(conflicts: DataFrame, clean: DataFrame) -> DataFrame:
    """conflicts: path, base_start, base_lines, v1_op, v1_new_start, v1_new_lines, v2_op, v2_new_start, v2_new_lines;
    clean: path, side, op, old_start, old_lines, new_start, new_lines."""
    return combined(
        section(conflicts, record("path", "base_start", "base_lines", "v1_op", "v1_new_start", "v1_new_lines", "v2_op", "v2_new_start", "v2_new_lines")),
        section(clean, record("path", "side", "op", "old_start", "old_lines", "new_start", "new_lines")),
    )


def tree_sha(files: DataFrame) -> str:
    """Digest over path LF size LF bytes of each file in path order; one partition at a time passes through the driver."""
    h = hashlib.sha256()
    for row in files.select("path", F.octet_length("content").alias("size"), "content").orderBy("path").toLocalIterator():
        h.update(f"{row.path}\n{row.size}\n".encode() + bytes(row.content))
    return h.hexdigest()


def list_sha(names: Iterable[str]) -> tuple[str, int]:
    """(sha, count) of sorted names, each followed by LF."""
    h, n = hashlib.sha256(), 0
    for name in names:
        h.update(name.encode() + b"\n")
        n += 1
    return h.hexdigest(), n


def list_sha_row(names: DataFrame, name: str) -> DataFrame:
    """One row (sha, n) of a column of names, for lists that fit a row."""
    ordered = names.agg(F.array_sort(F.collect_list(name)).alias("r"))
    return ordered.select(F.sha2(F.concat(F.array_join("r", "\n"), F.when(F.size("r") > 0, "\n").otherwise("")), 256).alias("sha"), F.size("r").cast("long").alias("n"))


def manifest_sha(raw: bytes, root: str, leaf: str) -> str:
    """Identity of a manifest: carriage returns dropped, the corpus root blanked, the leaf's line left out."""
    text = raw.replace(b"\r", b"").replace(root.encode(), b"")
    return hashlib.sha256(b"\n".join(x for x in text.split(b"\n") if leaf.encode() not in x)).hexdigest()


def manifest_identity(raw: Column, root: Column, leaf: Column) -> Column:
    """manifest_sha of a row's manifest, a string or binary, as a column; null where any of the three is null. An empty
    root blanks nothing, an empty leaf leaves out every line."""
    text = F.replace(F.replace(raw.cast("string"), F.lit("\r"), F.lit("")), root, F.lit(""))
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~F.contains(x, leaf))
    return F.sha2(F.array_join(kept, "\n").cast("binary"), 256)
