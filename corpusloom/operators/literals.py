"""References outside literals and comments, where these run over line ends.

A line is a function of the state in which it begins: code, block comment or raw string. The state of each line is the
composition of all lines before it in its file, which is associative: lines are composed in blocks, blocks in blocks of
blocks, and so on; then the states go down again. No task sees more than a block at once, however long a file is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

CODE, COMMENT, RAW = 0, 1, 2

#: What hides names within a line, the first that begins wins; the last of each pair runs on over the line's end.
TOKENS = r"""(?s)(?<![A-Za-z0-9_])R"\(.*?\)"|(?<![A-Za-z0-9_])R"\(.*|"[^"\\]*+(?:\\.[^"\\]*+)*+"?|'[^'\\]*+(?:\\.[^'\\]*+)*+'?|//.*|/\*.*?\*/|/\*.*"""
NAME = "[A-Za-z_][A-Za-z0-9_]*"


def rest_of(line: Column, state: int) -> Column:
    """What is left of a line that begins in a state once that has ended; null where it does not end."""
    if state == CODE:
        return line
    end = "*/" if state == COMMENT else ')"'
    at = F.instr(line, F.lit(end))
    return F.when(at > 0, F.substring(line, at + 2, F.length(line)))


def next_state(line: Column, state: int) -> Column:
    """The state after a line that begins in a state."""
    last = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(rest_of(line, state), F.lit(TOKENS), F.lit(0))), -1)
    comment = last.startswith("/*") & ~((F.length(last) >= 4) & last.endswith("*/"))
    raw = last.startswith('R"(') & ~((F.length(last) >= 5) & last.endswith(')"'))
    return F.when(rest_of(line, state).isNull(), state).when(comment, COMMENT).when(raw, RAW).otherwise(CODE)


def entry_states(rows: DataFrame, steps: str, by: Sequence[str], place: str, block: int = 256, start: int = 0) -> DataFrame:
    """rows with entry: the state before each row, from start at the first one of by, when each maps state s to steps[s].
    place numbers the rows of by in order, from 0 or 1, gaps allowed."""
    n = 3
    cut = rows.withColumn("_b", F.floor(F.col(place) / block).cast("long"))
    through = lambda found, state: F.aggregate(found, state, lambda s, f: F.element_at(f, s + 1))
    if cut.agg(F.max("_b")).first()[0]:
        whole = cut.groupBy(*by, "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct(place, steps))), lambda x: x[steps]).alias("_all"))
        blocks = written(whole.select(*by, F.col("_b").alias("_at"), F.array(*[through(F.col("_all"), F.lit(s)) for s in range(n)]).alias("_steps")), "blocks")
        starts = entry_states(blocks, "_steps", by, "_at", block, start).select(*by, F.col("_at").alias("_b"), F.col("entry").alias("_start"))
        cut = cut.join(starts, [*by, "_b"])
    else:
        cut = cut.withColumn("_start", F.lit(start))
    before = F.collect_list(steps).over(Window.partitionBy(*by, "_b").orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("entry", through(before, F.col("_start"))).drop("_b", "_start")


def bare_lines(lines: DataFrame, block: int = 256) -> DataFrame:
    """lines (path, n, content) with bare: the content without comments, strings and characters, raw strings (without a
    delimiter) and block comments over several lines included. A string that its line does not end, ends with it."""
    line = F.coalesce("content", F.lit(""))
    steps = written(lines.withColumn("_steps", F.array(*[next_state(line, s) for s in (CODE, COMMENT, RAW)])), "steps")
    states = entry_states(steps, "_steps", ["path"], "n", block)
    left = F.coalesce(*[F.when(F.col("entry") == s, rest_of(line, s)) for s in (CODE, COMMENT, RAW)], F.lit(""))
    return states.withColumn("bare", F.regexp_replace(left, TOKENS, " ")).drop("_steps", "entry")


def names_outside(lines: DataFrame, block: int = 256) -> DataFrame:
    """(path, n, name): a row for each whole word of lines outside comments and literals."""
    return bare_lines(lines, block).select("path", "n", F.explode(F.regexp_extract_all("bare", F.lit(NAME), F.lit(0))).alias("name"))
