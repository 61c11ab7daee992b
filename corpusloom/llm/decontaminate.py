"""Benchmark decontamination by greedy string tiling.

Words of benchmark items and documents become numbers. Windows of LEAST words that an item and a document share are the
seeds; their join gives the pairs of item and document worth a look. Each such pair is tiled: the longest common runs of
unmarked words are found by Karp-Rabin hashes of a falling length, extended word by word (equal hashes are compared), and
marked from long to short so that no word is in two tiles. A document is contaminated by an item if tiles cover enough of
the item's words, in whatever order the passages stand.

The benchmark is the stated query set: it is taken in blocks of bounded size, each block sent to all tasks and matched
with all rows of the documents in one pass. A benchmark of B bytes so costs B / BLOCK_BYTES passes over the documents (or
items / BLOCK_ITEMS, if more), one after the other, and never more than one block's memory. Only windows whose words all
occur in the block can match, so a document without such a window costs one dictionary lookup per word. A pair of item and
document costs time in proportion to their lengths and to the number of distinct tile lengths, however often words repeat.

Defined edge cases: a null or empty text has no words and no hits; an item without words is no query; an item shorter
than LEAST words must be found whole. Repeated rows give repeated hits. Ties between equally long runs go to the first in
the item, then in the document. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, row_marks, table, without, written
from .licenses import split_words

LEAST = 5
COVERAGE = 0.5
#: Bounds of a block of the benchmark.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8_000_000

BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2^64) of all windows of so many numbers, by doubling."""
    if len(ids) < length:
        return np.empty(0, np.uint64)
    part, width, base = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), 1, BASE
    done, got, shift = None, 0, np.uint64(1)
    left = length
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if done is None:
                    done, got = part, width
                else:
                    n = len(ids) - got - width + 1
                    done, got = done[:n] * base + part[got : got + n], got + width
            left >>= 1
            if left:
                n = len(part) - width
                part, width, base = part[:n] * base + part[width:], 2 * width, base * base
    return done


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of so many places none of which is marked."""
    if len(marked) < length:
        return np.empty(0, np.int64)
    before = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(before[length:] == before[:-length])


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the tiles, longest first, then by place in the item, then in the document.
    Negative numbers in doc match nothing. Each turn finds the longest common run of unmarked words by bisection over its
    length, with one pass of Karp-Rabin hashes over both for each try, then marks all runs of that length in order: a turn
    is linear but for a logarithm, however often words repeat."""
    used_item, used_doc = np.zeros(len(item), bool), doc < 0
    out: list[tuple[int, int, int]] = []

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, j = _free(used_item, length), _free(used_doc, length)
        a, b = window_hashes(item, length)[i], window_hashes(doc, length)[j]
        in_both = np.isin(a, b)
        i, a = i[in_both], a[in_both]
        in_both = np.isin(b, a)
        return i, a, j[in_both], b[in_both]

    most = min(len(item), len(doc))
    while most >= least:
        if not len(common(least)[0]):
            return out
        low = least
        while 2 * low <= most and len(common(2 * low)[0]):
            low *= 2
        high = min(most, 2 * low - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        i, a, j, b = common(low)
        places: dict[int, list[int]] = defaultdict(list)
        for x, h in zip(j.tolist(), b.tolist(), strict=True):
            places[h].append(x)
        for x in places.values():
            x.reverse()
        marked = False
        for x, h in zip(i.tolist(), a.tolist(), strict=True):
            if used_item[x] or used_item[x + low - 1]:
                continue  # marks are as long as the window, so that one which overlaps it covers an end
            left = places[h]
            while left and (used_doc[left[-1]] or used_doc[left[-1] + low - 1]):
                left.pop()
            if left and (item[x : x + low] == doc[left[-1] : left[-1] + low]).all():
                y = left.pop()
                used_item[x : x + low] = used_doc[y : y + low] = True
                out.append((x, y, low))
                marked = True
        most = low if marked else low - 1  # no mark: hashes that are equal by chance
    return out


class Block:
    """Items of a block with an index of their seeds."""

    def __init__(self, items: list[tuple[int, bytes]], least: int = LEAST):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        seeds: dict[int, dict[int, dict[int, list[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        for item_id, text in items:
            words = split_words(text)
            if words:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
                short = min(least, len(ids))
                for i, h in enumerate(window_hashes(ids, short)):
                    seeds[short][int(h)][len(self.items)].append(i)
                self.items.append((item_id, ids, short))
        # for each seed length: the hashes, and for each hash the places by item
        self.seeds = {n: (np.sort(np.fromiter(x, np.uint64, len(x))), {h: [(k, np.array(v)) for k, v in by.items()] for h, by in x.items()}) for n, x in seeds.items()}

    def match(self, text: bytes, coverage: float) -> list[tuple[int, int, int, int, int]]:
        """(item_id, item's words, covered words, tiles, longest tile) of the items that the text covers far enough."""
        doc = np.fromiter(map(lambda w: self.vocabulary.get(w, -1), split_words(text)), np.int64)
        known = doc >= 0
        # of each item the seeds that the text holds, each once, whatever number of places it has in either
        shared: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for n, (table_, index) in self.seeds.items():
            where = _free(~known, n)
            if not len(where):
                continue
            hashes = window_hashes(doc, n)[where]
            at = np.searchsorted(table_, hashes)
            at[at == len(table_)] = 0
            hit = table_[at] == hashes
            where, hashes = where[hit], hashes[hit]
            order = np.argsort(hashes, kind="stable")
            where, hashes = where[order], hashes[order]
            cuts = np.flatnonzero(hashes[1:] != hashes[:-1]) + 1
            for h, part in zip(hashes[np.concatenate(([0], cuts))].tolist(), np.split(where, cuts), strict=True) if len(where) else ():
                for item, places in index[h]:
                    shared[item].append((places, part))
        out = []
        for item, met in shared.items():
            item_id, ids, least = self.items[item]
            if len(_covered([p for p, _ in met], least, len(ids))) < coverage * len(ids):
                continue  # tiles lie within seeds, so they cannot cover more
            inside = _covered([p for _, p in met], least, len(doc))
            parts = np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1)
            found = tiles(ids, np.concatenate([x for p in parts for x in (doc[p], [-1])]), least)
            total = sum(n for _, _, n in found)
            if total >= coverage * len(ids) and total:
                out.append((item_id, len(ids), total, len(found), max(n for _, _, n in found)))
        return sorted(out)


def _covered(starts: list[np.ndarray], length: int, size: int) -> np.ndarray:
    """The places that windows of so many places with these starts cover, in order."""
    edge = np.zeros(size + 1, np.int64)
    at = np.concatenate(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


SCHEMA = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, longest_tile long"


def blocks(items: DataFrame, most_items: int, most_bytes: int):
    """The benchmark's (item_id, text) in blocks, read one partition at a time."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).where("text is not null").toLocalIterator():
        block.append((row.item_id, bytes(row.text)))
        size += len(row.text)
        if len(block) >= most_items or size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, least: int = LEAST, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document (doc_id, text) and item (item_id, text) whose tiles cover enough of the item; last the
    document's columns of keep, all of type long."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *keep)
    schema = ", ".join([SCHEMA, *[f"{c} long" for c in keep]])
    done, pending = spark.createDataFrame([], schema), None
    for block in blocks(items, block_items, block_bytes):
        if pending is not None:  # one block's index at a time lies on the executors
            done = done.unionByName(written(pending, "hits"))
            sent.unpersist()
        sent = spark.sparkContext.broadcast(block)

        def rows(batch: dict[str, list], sent=sent) -> dict[str, list]:
            index = _index(sent, least)
            found = [(d, *x, *more) for d, t, *more in zip(batch["doc_id"], batch["text"], *[batch[c] for c in keep], strict=True) if t for x in index.match(t, coverage)]
            names = ("doc_id", "item_id", "item_words", "covered_words", "n_tiles", "longest_tile", *keep)
            return dict(zip(names, map(list, zip(*found)), strict=True)) if found else {n: [] for n in names}

        pending = map_rows(source, rows, schema)
    return done if pending is None else done.unionByName(pending)


def _index(sent, least: int) -> Block:
    if getattr(sent, "_block", None) is None:
        sent._block = Block(sent.value, least)
    return sent._block


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated rows; rows that share a doc_id (or have none) go only if they share the text too."""
    marked, marks = row_marks(docs, "text")
    gone = contaminated(marked, items, keep=tuple(marks)).select("doc_id", *marks).distinct()
    return without(marked, gone, marks)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("coverage", F.col("covered_words") / F.col("item_words"))
