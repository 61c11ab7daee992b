"""Operators on an order that is too long for one task: running totals, values carried on, weighted picks, exact seeded
choices, and plans that match needs with files by rank.

Totals and carried values take two levels: rows are dealt by range (or lie in blocks), each part is summed up to one row,
a window over these few rows gives what stands before each part, and a window within parts does the rest. So no task sees
more than a part. Dealt rows are written to the shared folder, since both levels must see one dealing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def running(rows: DataFrame, value: Column, order: Sequence[str], name: str = "upto") -> DataFrame:
    """rows with the total of value over all rows up to this one, in an order without ties; a null value counts as 0."""
    dealt = written(rows.withColumn("_v", F.coalesce(value.cast("long"), F.lit(0))).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy("_p").agg(F.sum("_v").alias("_s"))  # a row for each part
    before = F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, within).join(F.broadcast(starts), "_p").withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_v", "_before")


def carried(rows: DataFrame, value: Column, by: Sequence[str], place: str, block: int, name: str = "carried") -> DataFrame:
    """rows with the last value that is not null up to this row, along place (a number without ties) within by. Blocks of so
    many places are gone over apart; what a block passes on reaches the next ones through a window over blocks."""
    cut = rows.withColumn("_v", value).withColumn("_b", F.floor(F.col(place) / block).cast("long"))
    last = cut.where(F.col("_v").isNotNull()).groupBy(*by, "_b").agg(F.max(F.struct(place, "_v")).getField("_v").alias("_last"))
    blocks = cut.select(*by, "_b").distinct().join(last, [*by, "_b"], "left")
    passed = F.last("_last", True).over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    within = F.last("_v", True).over(Window.partitionBy(*by, "_b").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn(name, within).join(blocks.select(*by, "_b", passed.alias("_passed")), [*by, "_b"]).withColumn(name, F.coalesce(name, "_passed")).drop("_v", "_b", "_passed")


def weighted_picks(draws: DataFrame, weights: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): each of draws (key, draw: 32 random bits) falls to one of weights (name, weight) in proportion to its
    weight; null and zero weights get none, and where all are so there are no picks.

    Weights become bounds by running totals. Bounds and draws are cut into buckets of equal width; a weight that spans
    several stands at the start of each. Within a bucket, sorted by place, a draw takes the last bound before it. Draws are
    even over buckets whatever the weights, and a bucket's work is linear in its rows."""
    bounds = running(weights.where("weight > 0").select(F.col(name).alias("_name"), "weight"), F.col("weight"), ["_name"])
    found = bounds.agg(F.max("upto"), F.count("*")).first()
    total, n = found[0] or 0, found[1]
    width = max(1, -(-total // max(n, 1)))
    low = F.col("upto") - F.col("weight")
    cells = bounds.select("_name", low.alias("_low"), F.explode(F.sequence(F.expr(f"(upto - weight) div {width}"), F.expr(f"(upto - 1) div {width}"))).alias("_b"))
    starts = cells.select("_b", F.greatest("_low", F.col("_b") * width).alias("_at"), F.lit(0).alias("_rank"), "_name", F.lit(None).cast(draws.schema[key].dataType).alias(key))
    place = F.expr(f"(cast({total} as decimal(20,0)) * cast(draw as decimal(10,0))) div cast(4294967296 as decimal(10,0))")
    asked = draws.where(F.col("draw").isNotNull()).select(place.alias("_at"), key)
    asked = asked.select(F.expr(f"_at div {width}").alias("_b"), "_at", F.lit(1).alias("_rank"), F.lit(None).cast(weights.schema[name].dataType).alias("_name"), key)
    taken = F.last("_name", True).over(Window.partitionBy("_b").orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, 0))
    return starts.unionByName(asked).withColumn("_name", taken).where("_rank = 1 and _name is not null").select(key, F.col("_name").alias(name))


#: Rows of a histogram's bin that are sorted; larger bins are cut by more digits first.
SORTED = 100_000
#: Hexadecimal digits of a step.
DIGITS = 4


def keyed_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def chosen(rows: DataFrame, n: int, key: str, seed: int, eligible: Column | None = None, most_sorted: int = SORTED) -> DataFrame:
    """Exactly n of the eligible rows (all, if fewer), the first in a shuffle by seed and key: rows that may not be taken are
    made up for by the next. Equal hashes go by key; of rows of one key any may be taken.

    A histogram of the hashes' first digits finds the bin in which the n-th row lies; all before it are in, and only
    that bin is sorted, after more digits where it is large. Nothing is sorted as a whole."""
    pool = (rows if eligible is None else rows.where(eligible)).withColumn("_h", keyed_hash(key, seed))
    known, need = "", n
    while True:
        inside = pool.where(F.col("_h").startswith(known)) if known else pool
        bins = inside.groupBy(F.substring("_h", len(known) + 1, DIGITS).alias("bin")).count().orderBy("bin").collect()  # 65,536 rows at most
        for x in bins:
            if need <= x["count"]:
                break
            need -= x["count"]
        else:
            return pool.drop("_h")  # fewer than n
        known += x["bin"]
        if x["count"] <= most_sorted or len(known) == 32:
            break
    edge = pool.where(F.col("_h").startswith(known)).orderBy("_h", key).limit(need)
    return pool.where(F.col("_h") < known).unionByName(edge).drop("_h")


#: Kinds of edits in their turn, and the pool that each takes its files from.
EDITS = {"remove": "source", "line-shift": "source", "add": None, "grow": "grow", "shrink": "shrink"}


def edit_plan(files: DataFrame, edits: int, seed: int) -> DataFrame:
    """(step, kind, path, error) of so many edits over files (path, pool: source, grow or shrink; paths are unique). Kinds
    come in turn, without those whose pool is empty (sources are always asked for). Sources are taken once each in a shuffle
    by seed, shrinking files once each in order, growing files again and again in order. Where a pool runs out the
    row has an error instead of a path, so that a plan is whole when no row has one.

    The k-th need of a pool meets its file of rank k; ranks come from running counts. A growing file is repeated by
    the number of its turns, so that needs and files meet one to one."""
    spark = files.sparkSession
    have = {r["pool"]: r["count"] for r in files.where(F.col("pool").isin("source", "grow", "shrink")).groupBy("pool").count().collect()}
    kinds = [k for k, pool in EDITS.items() if pool in (None, "source") or have.get(pool)]
    m = len(kinds)
    sort = F.when(F.col("pool") == "source", keyed_hash("path", seed)).otherwise(F.lit(""))
    ranked = running(files.where(F.col("pool").isin("source", "grow", "shrink")).select("path", "pool", sort.alias("_sort")), F.lit(1), ["pool", "_sort", "path"])
    starts = ranked.groupBy("pool").agg(F.min("upto").alias("_start"))  # three rows at most
    ranked = ranked.join(F.broadcast(starts), "pool").select("pool", "path", (F.col("upto") - F.col("_start")).alias("need"))
    turns = F.when((F.col("pool") == "grow") & (F.lit(edits) > F.col("need")), F.sequence(F.col("need"), F.greatest(F.lit(edits).cast("long") - 1, F.col("need")), F.lit(max(1, have.get("grow", 1))).cast("long"))).otherwise(F.array("need"))
    ranked = ranked.select("pool", "path", F.explode(turns).alias("need"))
    step = F.col("step")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (step % m + 1).cast("int"))
    turn = F.expr(f"step div {m}")
    need = F.when(kind == "remove", 2 * turn).when(kind == "line-shift", 2 * turn + 1).otherwise(turn)
    pool = F.when(kind.isin("remove", "line-shift"), "source").when(kind != "add", kind)
    needs = spark.range(edits).withColumnRenamed("id", "step").select("step", kind.alias("kind"), pool.alias("pool"), need.alias("need"))
    met = needs.join(ranked, ["pool", "need"], "left")
    path = F.when(F.col("kind") == "add", F.concat(F.lit("mut_add_"), step.cast("string"), F.lit(".c"))).otherwise(F.col("path"))
    return met.select("step", "kind", path.alias("path")).withColumn("error", F.when(F.col("path").isNull(), F.concat(F.lit("no file is left for "), "kind")))
