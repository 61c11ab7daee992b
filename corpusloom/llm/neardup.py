"""Near duplicates by MinHash and a multi-index Hamming join, confirmed on full shingle sets.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes). Texts with one set are one class, and the least
   doc_id stands for it: copies cost nothing further on.
2. A class has a signature of POSITIONS b-bit MinHash values. Two sets of similarity s differ in a position with
   probability 1 - s, so the pairs wanted lie within a distance that the index covers (see below).
3. Multi-index: the positions are split into chunks. By the pigeonhole principle two signatures that differ in at most
   2 * chunks - 1 positions have a chunk with at most one error; chunks_for() takes the fewest chunks whose distance
   covers the share asked for. Every chunk is indexed under each of its
   one-error masks (the chunk without one position, which an exact match shares as well), so all pairs within DISTANCE
   share a key.
4. A key of two classes is a pair. Of larger keys every class is first paired with the least class of one of its keys, the
   one whose signature is nearest. Confirmed pairs make components.
5. Keys that hold more than one component are then searched to the end. The home of a class is its most crowded key; a key
   knows the homes of its members. A class that is not of its key's largest component asks the homes of the others there,
   each home once, whatever number of keys leads to it. Odd
   sketches, whose difference is a lower bound of how the sets differ, rule pairs out without losing a link; what is left
   is tested, most alike first, round by round, until no untested pair remains.
6. Pairs are confirmed on full sets: 100 * |A & B| >= share * |A | B|. Links become components by alternating large-star
   and small-star steps.

At similarity 0.85 the distance of a pair is binomial with mean 9 of 60 positions; it passes 23 (12 chunks) with
probability 2.3e-6, and less the more similar the pair. At 0.80 it would with 3e-4, so 15 chunks cover 29 there. A share
that no split of the positions covers with a loss of at most LOSS is refused.

Scale: keys are counted with map-side combination, so a key held by a third of all classes costs one row per task. No step
gathers a key's classes in one task: pairs of step 4 are rows of joins, and groups of step 5 are dealt as blocks of bounded
size against blocks of bounded size. Signatures and sketches travel once for a class and step, not for each of its keys.
Texts travel for candidate documents only. All joins are equi-joins that adaptive execution can split when skewed.
Intermediate tables lie in the shared folder, so nothing hangs on one executor.

Defined edge cases: a null or empty text, or one without words, has no shingles, is linked with nothing and kept. A text
of fewer than five words is one shingle. A null doc_id has no component and is kept. Repeated rows are returned row by
row; rows that share a doc_id count as one document with the links of all of them. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW_GONE, broadcast_if_small, free_names, giving_back, map_rows, table, written

WORDS = 5
SHARE = 85
CHUNKS, CHUNK = 12, 5
POSITIONS, DISTANCE = CHUNKS * CHUNK, 2 * CHUNKS - 1
#: Largest probability that a pair at exactly the share passes the distance of the index.
LOSS = 4e-6
#: Bytes of sketches that a side of a block holds.
BLOCK_BYTES = 4 << 20
#: Homes in a list that a key sends to its classes.
HOMES = 256
#: Pairs of a member and another component that the first round across components tests; later rounds test 8 times as many.
FIRST_ACROSS = 64
#: Document ids that may be sent to all tasks to pick candidates' texts; beyond, the texts are joined by a shuffle.
MANY = 1_000_000

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IN_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

_U = np.uint64
_RNG = np.random.default_rng(60)
BYTE_HASH = _RNG.integers(1, 2**63, 256, np.uint64) * _U(2) + _U(1)
ODD = _U(0x9E3779B97F4A7C15)
ODD_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
MULTIPLY = _RNG.integers(1, 2**63, POSITIONS, np.uint64) * _U(2) + _U(1)
ADD = _RNG.integers(0, 2**63, POSITIONS, np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD^i and ODD^-i for i < n; made once per worker for the next power of two."""
    size = max(1 << 12, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        if len(_POWERS) > 4:
            _POWERS.clear()
        made = []
        for base in (ODD, ODD_INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _POWERS[size] = tuple(made)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, in order."""
    raw = LOWER[np.frombuffer(text, np.uint8)]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = IN_WORD[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_HASH[raw] * up, out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of the text's 5-word shingles."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    n = min(WORDS, len(words))
    if not n:
        return words
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            total = total * ODD + words[k : len(words) - n + 1 + k]
        return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """POSITIONS 16-bit MinHash values of a set that is not empty."""
    best = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 512):
            part = found[at : at + 512]
            np.minimum(best, (part[None, :] * MULTIPLY[:, None] + ADD[:, None]).min(1), out=best)
        return (mixed(best) >> _U(48)).astype("<u2")


def chunk_keys(signatures: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """For each row of signatures its POSITIONS keys: every chunk without each one of its positions."""
    size = POSITIONS // chunks
    rows = signatures.reshape(len(signatures), chunks, size).astype(np.uint64)
    with np.errstate(over="ignore"):
        slots = mixed(np.arange(POSITIONS, dtype=np.uint64) + _U(1)).reshape(chunks, size)
        out = np.empty((len(rows), chunks, size), np.uint64)
        for gone in range(size):
            packed = np.zeros((len(rows), chunks), np.uint64)
            for k in range(size):
                if k != gone:
                    packed = (packed << _U(16)) | rows[:, :, k]
            out[:, :, gone] = mixed(packed ^ slots[None, :, gone])
    return out.reshape(len(rows), POSITIONS)


def chunks_for(share: int) -> int:
    """The fewest chunks, of equal size, whose distance a pair of that share passes with probability LOSS at most."""
    differ = 1 - share / 100
    for chunks in (CHUNKS, *[POSITIONS // size for size in range(CHUNK - 1, 2, -1) if POSITIONS % size == 0]):
        if sum(math.comb(POSITIONS, d) * differ**d * (1 - differ) ** (POSITIONS - d) for d in range(2 * chunks, POSITIONS + 1)) <= LOSS:
            return chunks
    raise ValueError(f"share {share}: no index of {POSITIONS} positions covers it")


def odd_sketch(found: np.ndarray) -> bytes:
    """A bit for each of 4 to 8 times as many cells as the set has members: whether an odd number of them falls there. Two
    sketches of one size differ in no more bits than the sets differ in members, whatever the hashes do."""
    cells = max(64, 1 << (4 * len(found) - 1).bit_length())
    counts = np.bincount((found & _U(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


class Asked:
    """Classes that look for links, by the width of their sketches."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]], share: int):
        self.share, self.by_width = share, {}
        for width in {len(x[3]) for x in rows}:
            part = [x for x in rows if len(x[3]) == width]
            self.by_width[width] = *(np.array(c) for c in zip(*[x[:3] for x in part], strict=True)), np.frombuffer(b"".join(x[3] for x in part), np.uint64).reshape(len(part), -1)

    def pairs(self, reps: np.ndarray, components: np.ndarray, sizes: np.ndarray, sketches: list[bytes], most: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Pairs with the classes given that lie in another component and that the sketches do not rule out: for each class
        that asks and other component the most alike, at most so many; and the classes for which there were more. A pair
        that is linked is never ruled out: |A ^ B| <= (|A| + |B|) (1 - s) / (1 + s)."""
        out, more = [], set()
        widths = np.array([len(x) for x in sketches])
        for w in set(widths.tolist()):
            rows = np.flatnonzero(widths == w)
            bits = np.frombuffer(b"".join(sketches[i] for i in rows), np.uint64).reshape(len(rows), -1)
            half = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
            for width, against in ((w // 2, half), (w, bits), (2 * w, bits)):
                for x, component, n, own in zip(*self.by_width.get(width, ((), (), (), ())), strict=True):
                    mine = own[: len(own) // 2] ^ own[len(own) // 2 :] if width > w else own
                    gap = np.bitwise_count(against ^ mine).sum(1, dtype=np.int64)
                    near = np.flatnonzero((100 + self.share) * gap <= (100 - self.share) * (sizes[rows] + n))
                    near = near[components[rows[near]] != component]
                    if not len(near):
                        continue
                    near = near[np.lexsort((reps[rows[near]], gap[near], components[rows[near]]))]
                    of = components[rows[near]]
                    first = np.concatenate(([True], of[1:] != of[:-1]))
                    rank = np.arange(len(near)) - np.maximum.accumulate(np.where(first, np.arange(len(near)), 0))
                    if (rank >= most).any():
                        more.add(int(x))
                    out += [(min(int(x), y), max(int(x), y)) for y in reps[rows[near[rank < most]]].tolist()]
        return out, more


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, signature, sketch) of each row; the last three are null for an empty set."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t) for t in batch["text"]]
        return {
            "doc_id": batch["doc_id"],
            "n_shingles": [len(s) for s in sets],
            "digest": [hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None for s in sets],
            "signature": [signature(s).tobytes() if len(s) else None for s in sets],
            "sketch": [odd_sketch(s) if len(s) else None for s in sets],
        }

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), rows, "doc_id long, n_shingles long, digest binary, signature binary, sketch binary")


def _keyed(classes: DataFrame, chunks: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, POSITIONS)
            for at in range(0, len(sig), 1000):
                keys = chunk_keys(sig[at : at + 1000], chunks)
                reps = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False)[at : at + 1000], POSITIONS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(reps)], names=["key", "rep"])

    return classes.select("rep", "signature").mapInArrow(giving_back(run), "key long, rep long")


def _nearest(stars: DataFrame, classes: DataFrame, distance: int) -> DataFrame:
    """(a, b): for each class b of the pairs (a, b) its nearest a by signature, within the distance."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, POSITIONS) for c in ("signature", "signature_b"))
            d = (one != other).sum(1)
            near = np.flatnonzero(d <= distance)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(near)), batch.column("b").take(pa.array(near)), pa.array(d[near].astype(np.int64))], names=["a", "b", "d"])

    sides = stars.join(classes.select(F.col("rep").alias("b"), F.col("signature").alias("signature_b")), "b").join(classes.select(F.col("rep").alias("a"), "signature"), "a")
    measured = sides.select("a", "b", "signature", "signature_b").mapInArrow(giving_back(run), "a long, b long, d long")
    return measured.groupBy("b").agg(F.min(F.struct("d", "a")).alias("x")).select("x.a", "b")


def _questions(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """(home, rep): the homes that a class asks (see step 5 above). crowded: (key, rep); labels: (rep, home, component)."""
    held = written(crowded.join(labels, "rep").groupBy("key", "component", "home").agg(F.count("*").alias("n"), F.max("rep").alias("last")), "held")
    parts = held.groupBy("key", "component").agg(F.sum("n").alias("n"))
    split = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    split = written(split.select("key", F.col("top.component").alias("main")), "split")
    beside = crowded.join(labels.select("rep", "component"), "rep").join(split, "key").where(F.col("component") != F.col("main")).select("key", "rep")
    # of two classes beside the main component the lesser one asks
    last = F.when(F.col("component") == F.col("main"), F.lit(2**63 - 1)).otherwise(F.col("last"))
    hosts = written(held.join(split, "key").groupBy("key", "home").agg(F.max(last).alias("last")), "hosts")
    # a key's homes travel as lists of about HOMES, not as a row for each class and home
    part = F.pmod(F.xxhash64("home"), F.ceil(F.col("homes") / HOMES))
    lists = hosts.join(hosts.groupBy("key").agg(F.count("*").alias("homes")), "key").groupBy("key", part.alias("part")).agg(F.collect_list(F.struct("home", "last")).alias("hosts"))
    met = beside.join(lists, "key").select("rep", F.transform(F.filter("hosts", lambda x: x["last"] > F.col("rep")), lambda x: x["home"]).alias("homes"))
    asked = met.groupBy("rep").agg(F.collect_set("homes").alias("homes"))
    return asked.select(F.explode(F.array_distinct(F.flatten("homes"))).alias("home"), "rep")


def _answers(asks: DataFrame, labels: DataFrame, classes: DataFrame, share: int, most: int) -> DataFrame:
    """Pairs (a, b) of classes of different components, of questions asks (home, rep) and the classes of those homes, as
    Asked finds them; (a, null) where a has more. Either side of a home is dealt to blocks of about BLOCK_BYTES, and every
    block of one meets every block of the other."""
    asking = asks.join(labels.select("rep", "component"), "rep").select("home", "rep", "component", F.lit(0).alias("side"))
    asked = labels.join(asks.select("home").distinct(), "home", "left_semi").select("home", "rep", "component", F.lit(1).alias("side"))
    rows = asking.unionByName(asked).join(classes.select("rep", "sketch", "n"), "rep")
    blocks = lambda side: F.ceil(F.sum(F.when(F.col("side") == side, F.octet_length("sketch") + 64).otherwise(1)) / BLOCK_BYTES).cast("int")
    met = rows.join(rows.groupBy("home").agg(blocks(0).alias("n0"), blocks(1).alias("n1")), "home")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = met.where("side = 0").withColumn("x", own("n0")).withColumn("y", every("n1")).unionByName(met.where("side = 1").withColumn("y", own("n1")).withColumn("x", every("n0")))
    names = ("home", "x", "y", "side", "rep", "component", "n")

    def run(batches):
        import pyarrow as pa

        place, waiting, ready, seen = None, [], None, set()
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            sketches = batch.column("sketch")
            heads = np.stack([c.astype(np.int64) for c in columns[:4]], 1)
            cuts = np.concatenate(([0], np.flatnonzero((heads[1:] != heads[:-1]).any(1)) + 1, [len(heads)]))
            out: set = set()
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if (here := tuple(heads[lo, :3].tolist())) != place:
                    place, waiting, ready = here, [], None
                reps, component, n = (c[lo:hi] for c in columns[4:])
                bits = sketches.slice(lo, hi - lo).to_pylist()
                if heads[lo, 3] == 0:
                    waiting += zip(reps.tolist(), component.tolist(), n.tolist(), bits, strict=True)
                    continue
                ready = ready or Asked(waiting, share)
                found, more = ready.pairs(reps, component, n, bits, most)
                out.update(found)
                out.update((x, None) for x in more)
            out -= seen
            seen |= out
            if len(seen) > 500_000:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return dealt.select(*names, "sketch").repartition("home", "x", "y").sortWithinPartitions("home", "x", "y", "side", "rep").mapInArrow(giving_back(run), "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, share: int) -> DataFrame:
    """(a, b, linked) of distinct pairs (a, b) of doc_ids, on the full sets of their texts."""
    needed = broadcast_if_small(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), MANY)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def rows(batch: dict[str, list]) -> dict[str, list]:
        linked, last, left = [], None, None
        for text_a, text_b in zip(batch["text_a"], batch["text_b"], strict=True):
            if text_a is not last and text_a != last:
                last, left = text_a, shingles(text_a)
            right = shingles(text_b)
            common = len(np.intersect1d(left, right, assume_unique=True))
            linked.append(100 * common >= share * (len(left) + len(right) - common) > 0)
        return {"a": batch["a"], "b": batch["b"], "linked": linked}

    return map_rows(both.select("a", "b", "text_a", "text_b"), rows, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of nodes with links (a, b); component is the least node reachable. Large-star and small-star
    steps alternate until no edge changes; each star is an aggregation and a join on the node."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            near = edges.union(edges.select("b", "a")).toDF("u", "v")
        else:
            near = edges.select(F.greatest("a", "b"), F.least("a", "b")).toDF("u", "v")
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.join(least, "u")
        kept = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return kept.where("a <> b").distinct()

    edges = written(links.select("a", "b"), "edges")
    while True:
        edges = written(star(star(edges, True), False), "edges")
        # done when every node has one edge, to a node that has none
        state = edges.select("a", F.lit(0).alias("down")).union(edges.select("b", F.lit(1))).groupBy("a").agg(F.count_if(F.col("down") == 0).alias("up"), F.max("down").alias("down"))
        if not state.where("up > 1 or (up > 0 and down > 0)").take(1):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    chunks = chunks_for(share)
    made = written(prepared(docs), "signatures")
    usable = made.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"), F.min("sketch").alias("sketch"), F.min("n_shingles").alias("n")), "classes")
    keyed = _keyed(classes, chunks)
    counted = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b")).where("n > 1"), "keys")
    crowded = written(keyed.join(counted.where("n > 2").select("key", "n", "a"), "key").select("key", "rep", "n", "a"), "groups")
    homes = written(crowded.groupBy("rep").agg(F.max(F.struct("n", "key")).alias("x")).select("rep", F.col("x.key").alias("home")), "homes")
    stars = crowded.where(F.col("rep") != F.col("a")).select("a", F.col("rep").alias("b")).distinct()
    # written first: confirmed() reads its pairs several times
    pairs = written(counted.where("n = 2 and a <> b").select("a", "b").union(_nearest(stars, classes, 2 * chunks - 1)).distinct(), "pairs")
    tested = written(confirmed(pairs, docs, share), "tested")
    known, most, asks = components(tested.where("linked")), FIRST_ACROSS, None
    while True:
        labels = written(homes.join(known, homes["rep"] == known["node"], "left").select("rep", "home", F.coalesce("component", "rep").alias("component")), "labels")
        # components only grow together, so that later rounds ask no more than the first
        asks = written(_questions(crowded.select("key", "rep"), labels), "asks") if asks is None else asks
        found = written(_answers(asks, labels, classes, share, most).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "across")
        new = found.where("b is not null")
        if new.take(1):
            more = written(confirmed(new, docs, share), "tested")
            tested = tested.unionByName(more)
            if more.where("linked").take(1):
                known = components(tested.where("linked"))
        left = found.where("b is null").select(F.col("a").alias("rep")).distinct()
        if not left.take(1):
            break  # every pair that the questions lead to is tested, linked by others or ruled out
        asks, most = written(asks.join(left, "rep", "left_semi"), "asks"), 8 * most
    of_class = classes.join(known, classes["rep"] == known["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    joined = made.join(of_class, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row of docs for each group of near duplicates: the one of least doc_id, rows without one last. Rows are judged
    as rows: equal ones are copies of each other, different texts under one doc_id are not, and rows without a doc_id take
    part. Rows are numbered in a written table, so that a lost executor changes no number."""
    (row,) = free_names(docs, "_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), share)
    found = written(found.select(F.col("doc_id").alias("node"), "component_id", "kept"), "found")
    members = found.join(found.where(~F.col("kept")).select("component_id").distinct(), "component_id").select("component_id", "node")
    named = members.join(numbered.select(F.col(row).alias("node"), "doc_id"), "node")
    ranked = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")
    stay = named.groupBy("component_id").agg(F.min(ranked).alias("first")).select(F.col("first.node").alias("node"))
    gone = written(members.join(stay, "node", "left_anti").select(F.col("node").alias(row)), "gone")
    return numbered.join(broadcast_if_small(gone, FEW_GONE), row, "left_anti").drop(row)


def op10_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
