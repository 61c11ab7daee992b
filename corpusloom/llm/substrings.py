"""Exact removal of repeated substrings by suffix ordering.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Sorting all
suffixes of a corpus would shuffle many times its size, so candidates are found first:

1. Anchors. Every string of LENGTH bytes holds a GRAM whose hash is least among its grams (a minimizer), at a place that
   depends on the string alone. So equal strings have equal grams at equal places: only grams that two documents hold
   as anchors can lie in a repeated string. About one place in sixteen is an anchor.
2. Shared anchors. Hashes of anchors, packed into one row per Arrow batch and bucket, meet in their bucket; those held by
   two documents go back to their documents. Where one batch holds a hash in two documents that is decided at once and
   one entry goes out, so that a passage that a third of all documents hold costs one entry per batch.
3. Contexts. Around each shared anchor lie all strings of LENGTH bytes that hold it: LENGTH - GRAM bytes before it, and
   LENGTH from it on. Equal contexts of a batch are decided at once for all but the least doc_id; one goes out.
4. Order. In a bucket, the suffixes from the anchor on and the reversed prefixes before it are ordered by deep-shallow
   sorting (deepshallow.py). For each split of LENGTH into bytes before and after the anchor, neighbours in both orders
   that share that many bytes are one class, and the least doc_id of a class tells which strings repeat.
5. Removal. Each document gets its repeated starts and drops the bytes they cover.

Everything is decided on bytes; hashes only choose what meets. Buckets grow in number with the session's shuffle
partitions, hence with the data. What a bucket finds goes back in one row per group of documents, and is put together by
document there; groups grow in number like buckets. Shuffled and written are packed anchors, contexts of shared anchors and, once for each of
the two joins by document, the texts. Intermediate tables lie in the shared folder.

Defined edge cases: a null text is empty; a text shorter than LENGTH keeps all its bytes. Matches never cross documents.
Rows that share a doc_id do not repeat each other, and are returned row by row; a null doc_id neither removes nor loses
anything. Ties do not arise, since the least doc_id decides. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, scan_partitions, table, written
from .deepshallow import deep_shallow

LENGTH, GRAM = 50, 20
BEFORE = LENGTH - GRAM
SPLITS = BEFORE + 1
#: Bytes that are hashed at a time, for arrays that stay in a core's cache.
STRIDE = 1 << 17

_U = np.uint64
_BYTES = np.random.default_rng(50).integers(1, 2**63, 256, np.uint64) * _U(2) + _U(1)
_BASE = _U(0xD6E8FEB86659FD93)
_TOP = _U(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def _power(k: int) -> np.uint64:
    return _U(pow(int(_BASE), k, 2**64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place on, by doubling: 1, 2, 4, 8, 16, then 16 + 4."""
    one = _BYTES[data]
    two = one[:-1] * _BASE + one[1:]
    four = two[:-2] * _power(2) + two[2:]
    eight = four[:-4] * _power(4) + four[4:]
    sixteen = eight[:-8] * _power(8) + eight[8:]
    return _mixed(sixteen[:-4] * _power(4) + four[16:])


def _sliding(x: np.ndarray, span: int, op) -> np.ndarray:
    width = 1
    while width * 2 <= span:
        x = op(x[:-width], x[width:])
        width *= 2
    return op(x[: len(x) - (span - width)], x[span - width :]) if width < span else x


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams of a text that are least in some string of LENGTH bytes."""
    places, hashes = [], []
    n = len(text)
    for at in range(0, n - LENGTH + 1, STRIDE):
        # strings that start in [at, stop) hold grams that start in [at, stop + BEFORE)
        stop = min(at + STRIDE, n - LENGTH + 1)
        h = gram_hashes(text[at : stop + LENGTH - 1])
        least = _sliding(h, SPLITS, np.minimum)
        wide = np.zeros(len(least) + 2 * BEFORE, np.uint64)
        wide[BEFORE : BEFORE + len(least)] = least
        found = np.flatnonzero(_sliding(wide, SPLITS, np.maximum) == h)
        places.append(found + at)
        hashes.append(_mixed(h[found] * _BASE))  # least hashes are small; mixed again they fill all buckets alike
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    where, h = np.concatenate(places), np.concatenate(hashes)
    if len(places) > 1:
        where, first = np.unique(where, return_index=True)
        h = h[first]
    return where, h


def _packed(*columns: np.ndarray) -> bytes:
    return _zstd()[0].compress(b"".join([np.int64(len(columns[0])).tobytes(), *[np.ascontiguousarray(c).tobytes() for c in columns]]))


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = _zstd()[1].decompress(blob)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        k = np.dtype(kind)
        out.append(np.frombuffer(data, k, n * k.itemsize // k.itemsize, at))
        at += n * k.itemsize
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(40)) * _U(buckets)) >> _U(24)


def _home(ids: np.ndarray, text_hashes: np.ndarray, groups: int) -> np.ndarray:
    """The group of each document: by doc_id and text, so that copies of one text are spread over all groups."""
    mixed = _mixed(_mixed(np.asarray(ids, np.int64).astype(np.uint64) * _BASE) ^ np.asarray(text_hashes, np.int64).astype(np.uint64))
    return (_mixed(mixed) % _U(groups)).astype(np.int64)


#: A document in transit: its doc_id and a hash that tells its text from others of that doc_id.
WHO = "doc_id long, text_hash long"
SHARED_BY_BATCH = 2**31 - 1


def _rows_of_docs(docs: np.ndarray, who: list[tuple[int, int]], *columns: np.ndarray):
    """For each document number in docs, (doc_id, text_hash, packed columns of its entries)."""
    by = np.argsort(docs, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], docs[by][1:] != docs[by][:-1], [True]))) if len(by) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        part = by[a:b]
        yield (*who[docs[part[0]]], _packed(*[c[part] for c in columns]))


def _anchor_rows(batch: dict[str, list], buckets: int) -> dict[str, list]:
    """Rows of a batch: (bucket, null, null, anchors) for a bucket, (bucket, doc_id, text_hash, places) for a document."""
    who = list(zip(batch["doc_id"], batch["text_hash"], strict=True))
    docs, places, hashes = [], [], []
    for i, text in enumerate(batch["text"]):
        if text and len(text) >= LENGTH:
            p, h = anchors(np.frombuffer(text, np.uint8))
            docs.append(np.full(len(p), i, np.int32))
            places.append(p.astype(np.int32))
            hashes.append(h)
    out: dict[str, list] = {"bucket": [], "doc_id": [], "text_hash": [], "packed": []}
    if not docs:
        return out
    doc, place, h = np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)
    by = np.lexsort((doc, h))
    doc, place, h = doc[by], place[by], h[by]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.concatenate((heads[1:], [len(h)])) - 1
    many = (doc[heads] != doc[tails])[group]
    for doc_id, text_hash, packed in _rows_of_docs(doc[many], who, place[many]):
        out["bucket"].append(int(_home([doc_id], [text_hash], buckets)[0]))
        out["doc_id"].append(doc_id)
        out["text_hash"].append(text_hash)
        out["packed"].append(packed)
    doc = np.where(many, np.int32(SHARED_BY_BATCH), doc)
    keep = ~many | new
    doc, place, h = doc[keep], place[keep], h[keep]
    bucket = _bucket(h, buckets)
    ids = np.array([w[0] for w in who], np.int64)
    text_hashes = np.array([w[1] for w in who], np.int64)
    edge = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
    for b in np.flatnonzero(np.diff(edge)):
        part = slice(edge[b], edge[b + 1])
        used, local = np.unique(doc[part], return_inverse=True)
        real = used[used != SHARED_BY_BATCH]
        # 48 bits of hash are enough: a false meeting costs a context, not a result
        short = h[part] >> _U(16)
        steps = np.diff(short, prepend=_U(0))
        out["bucket"].append(int(b))
        out["doc_id"].append(None)
        out["text_hash"].append(None)
        out["packed"].append(_packed(ids[real], text_hashes[real]) + b"|" + _packed(steps, np.where(doc[part] == SHARED_BY_BATCH, -1, local).astype(np.int32), place[part]))
    return out


def _cut_at_magic(blob: bytes) -> tuple[bytes, bytes]:
    size = _zstd()[1].decompressobj()
    size.decompress(blob)
    rest = size.unused_data
    return blob[: len(blob) - len(rest)], rest[1:]


def _group_rows(docs: np.ndarray, who: list[tuple[int, int]], groups: int, *columns: np.ndarray):
    """(document group, packed entries): one row for each group of documents, whatever the number of documents."""
    if not len(docs):
        return
    ids, text_hashes = (np.array(x, np.int64) for x in zip(*who, strict=True))
    group = _home(ids, text_hashes, groups)[docs]
    by = np.argsort(group, kind="stable")
    edge = np.searchsorted(group[by], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(edge)):
        part = by[edge[g] : edge[g + 1]]
        used, local = np.unique(docs[part], return_inverse=True)
        yield int(g), _packed(ids[used], text_hashes[used]) + b"|" + _packed(local.astype(np.int32), *[c[part] for c in columns])


def _merged_rows(batches, kinds: tuple[str, ...]):
    """Rows of _group_rows of one document group, from all buckets, as one row for each document."""
    import pyarrow as pa

    ids, text_hashes, docs, columns, seen = [], [], [], [[] for _ in kinds], 0
    for batch in batches:
        for packed in batch.column("packed").to_pylist():
            head, entries = _cut_at_magic(packed)
            i, t = _unpacked(head, "i8", "i8")
            local, *values = _unpacked(entries, "i4", *kinds)
            ids.append(i)
            text_hashes.append(t)
            docs.append(local.astype(np.int64) + seen)
            seen += len(i)
            for column, v in zip(columns, values, strict=True):
                column.append(v)
    if not ids:
        return
    i, t = np.concatenate(ids), np.concatenate(text_hashes)
    by = np.lexsort((t, i))
    new = np.concatenate(([True], (i[by][1:] != i[by][:-1]) | (t[by][1:] != t[by][:-1])))
    number = np.empty(seen, np.int64)
    number[by] = np.cumsum(new) - 1
    who = list(zip(i[by][new].tolist(), t[by][new].tolist(), strict=True))
    out = list(_rows_of_docs(number[np.concatenate(docs)], who, *[np.concatenate(c) for c in columns]))
    for at in range(0, len(out), 2_000):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out[at : at + 2_000], strict=True)], names=["doc_id", "text_hash", "packed"])


def _passed(rows: list[tuple[int, int, bytes]], who: list[tuple[int, int]], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """Entries (document number, columns) of documents' own rows; the documents are added to who."""
    docs, columns = [np.empty(0, np.int64)], [[np.empty(0, k)] for k in kinds]
    for doc_id, text_hash, packed in rows:
        values = _unpacked(packed, *kinds)
        docs.append(np.full(len(values[0]), len(who), np.int64))
        who.append((doc_id, text_hash))
        for column, v in zip(columns, values, strict=True):
            column.append(v)
    return [np.concatenate(docs), *[np.concatenate(c) for c in columns]]


def _grouped_batch(rows):
    import pyarrow as pa

    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.binary())], names=["bucket", "packed"])


def _shared_rows(batches, groups: int):
    """Of the anchors of one bucket, those that two documents hold, and those that documents' own rows tell of, by group of
    documents."""
    who: list[tuple[int, int]] = []
    own: list[tuple[int, int, bytes]] = []
    hashes, docs, places = [], [], []
    lone = 0
    for batch in batches:
        for doc_id, text_hash, packed in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "packed")], strict=True):
            if doc_id is not None:
                own.append((doc_id, text_hash, packed))
                continue
            ids, entries = _cut_at_magic(packed)
            doc_ids, text_hashes = _unpacked(ids, "i8", "i8")
            steps, local, place = _unpacked(entries, "u8", "i4", "i4")
            # an entry that its batch has found shared counts for two documents that ask for nothing
            number = np.where(local < 0, -1 - lone, local.astype(np.int64) + len(who))
            lone += 1
            who += zip(doc_ids.tolist(), text_hashes.tolist(), strict=True)
            hashes.append(np.cumsum(steps, dtype=np.uint64))
            docs.append(number)
            places.append(place)
    doc, place = np.empty(0, np.int64), np.empty(0, np.int32)
    if hashes:
        h, doc, place = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
        by = np.lexsort((doc, h))
        h, doc, place = h[by], doc[by], place[by]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        heads = np.flatnonzero(new)
        tails = np.concatenate((heads[1:], [len(h)])) - 1
        shared = ((doc[heads] != doc[tails]) | (doc[heads] < 0))[np.cumsum(new) - 1] & (doc >= 0)
        doc, place = doc[shared], place[shared]
    more, at = _passed(own, who, ("i4",))
    yield from _grouped_batch(_group_rows(np.concatenate((doc, more)), who, groups, np.concatenate((place, at))))


def contexts(text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, before, after): for each place BEFORE bytes before it and LENGTH from it on, zeros beyond the text, and how
    many of them are the text's."""
    n = len(text)
    padded = np.zeros(n + BEFORE + LENGTH, np.uint8)
    padded[BEFORE : BEFORE + n] = text
    return padded[places[:, None] + np.arange(BEFORE + LENGTH)[None, :]], np.minimum(places, BEFORE), np.minimum(n - places, LENGTH)


def _all_splits(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Bit o: the string with o bytes before the anchor lies in the text."""
    o = np.arange(SPLITS)
    fits = (o[None, :] <= before[:, None]) & (LENGTH - o[None, :] <= after[:, None])
    return (fits.astype(np.uint32) << o.astype(np.uint32)[None, :]).sum(1, dtype=np.uint32)


def _context_rows(batch: dict[str, list], buckets: int) -> dict[str, list]:
    """Rows of a batch: (bucket, null, null, contexts) for a bucket, (bucket, doc_id, text_hash, repeats) for a document."""
    who = list(zip(batch["doc_id"], batch["text_hash"], strict=True))
    parts = []
    for i, (text, blobs) in enumerate(zip(batch["text"], batch["places"], strict=True)):
        places = np.unique(np.concatenate([_unpacked(b, "i4")[0] for b in blobs])).astype(np.int64)
        parts.append((np.full(len(places), i, np.int32), places, *contexts(np.frombuffer(text, np.uint8), places)))
    doc, place, ctx, before, after = (np.concatenate(x) for x in zip(*parts, strict=True))
    before, after = before.astype(np.uint8), after.astype(np.uint8)
    out: dict[str, list] = {"bucket": [], "doc_id": [], "text_hash": [], "packed": []}
    ids = np.array([w[0] for w in who], np.int64)[doc]
    # equal contexts: all but those of the least doc_id repeat it, whole
    h = np.concatenate([np.zeros(0, np.uint64), *[_context_hash(ctx[at : at + 65536], before[at : at + 65536], after[at : at + 65536]) for at in range(0, len(ctx), 65536)]])
    by = np.lexsort((ids, h))
    same = (h[by[1:]] == h[by[:-1]]) & (ctx[by[1:]] == ctx[by[:-1]]).all(1) & (before[by[1:]] == before[by[:-1]]) & (after[by[1:]] == after[by[:-1]])
    head = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(by)), 0))
    more = ids[by] > ids[by[head]]
    repeats = by[more]
    for doc_id, text_hash, packed in _rows_of_docs(doc[repeats], who, place[repeats].astype(np.int32), _all_splits(before[repeats], after[repeats])):
        out["bucket"].append(int(_home([doc_id], [text_hash], buckets)[0]))
        out["doc_id"].append(doc_id)
        out["text_hash"].append(text_hash)
        out["packed"].append(packed)
    keep = np.sort(by[~more])
    doc, place, ctx, before, after = doc[keep], place[keep], ctx[keep], before[keep], after[keep]
    bucket = _bucket(np.concatenate([np.zeros(0, np.uint64), *[gram_hashes_of(ctx[at : at + 65536]) for at in range(0, len(ctx), 65536)]]), buckets)
    by = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[by], np.arange(buckets + 1).astype(np.uint64))
    all_ids, all_hashes = np.array([w[0] for w in who], np.int64), np.array([w[1] for w in who], np.int64)
    for b in np.flatnonzero(np.diff(edge)):
        part = by[edge[b] : edge[b + 1]]
        used, local = np.unique(doc[part], return_inverse=True)
        out["bucket"].append(int(b))
        out["doc_id"].append(None)
        out["text_hash"].append(None)
        out["packed"].append(_packed(all_ids[used], all_hashes[used]) + b"|" + _packed(local.astype(np.int32), place[part].astype(np.int32), before[part], after[part], np.ascontiguousarray(ctx[part]).view(f"V{BEFORE + LENGTH}").ravel()))
    return out


def _context_hash(ctx: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(ctx).view(np.uint64)
    out = before.astype(np.uint64) * _U(64) + after.astype(np.uint64)
    for k in range(words.shape[1]):
        out = _mixed((out ^ words[:, k]) * _BASE)
    return out


def gram_hashes_of(ctx: np.ndarray) -> np.ndarray:
    """The hash of each context's anchor."""
    one = _BYTES[ctx[:, BEFORE : BEFORE + GRAM]]
    out = np.zeros(len(ctx), np.uint64)
    for k in range(GRAM):
        out = out * _BASE + one[:, k]
    return _mixed(_mixed(out) * _BASE)


def repeated_splits(ctx: np.ndarray, before: np.ndarray, after: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
    """For each context, bit o tells whether a smaller doc_id has its string with o bytes before the anchor."""
    right, right_common = deep_shallow(np.ascontiguousarray(ctx[:, BEFORE:]))
    left, left_common = deep_shallow(np.ascontiguousarray(ctx[:, BEFORE - 1 :: -1]))
    masks = np.zeros(len(ctx), np.uint32)
    right_class, left_class = np.empty(len(ctx), np.int64), np.empty(len(ctx), np.int64)
    # only contexts whose anchor another context has can share a string
    right_class[right] = np.cumsum(right_common < GRAM)
    some = np.bincount(right_class)[right_class] > 1
    by_doc = np.argsort(doc_ids, kind="stable")
    for o in range(SPLITS):
        use = some & (before >= o) & (after >= LENGTH - o)
        if not use.any():
            continue
        right_class[right] = np.cumsum(right_common < LENGTH - o)
        left_class[left] = np.cumsum(left_common < o)
        rows = by_doc[use[by_doc]]
        key = right_class[rows] * (len(ctx) + 1) + left_class[rows]
        by = np.argsort(key, kind="stable")  # within a class still by doc_id
        rows, key = rows[by], key[by]
        head = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(key)), 0))
        masks[rows[doc_ids[rows] > doc_ids[rows[head]]]] |= np.uint32(1 << o)
    return masks


def _repeat_rows(batches, groups: int):
    """Of the contexts of one bucket, the repeats, and those that documents' own rows tell of, by group of documents."""
    who: list[tuple[int, int]] = []
    own: list[tuple[int, int, bytes]] = []
    parts = []
    for batch in batches:
        for doc_id, text_hash, packed in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "packed")], strict=True):
            if doc_id is not None:
                own.append((doc_id, text_hash, packed))
                continue
            ids, entries = _cut_at_magic(packed)
            doc_ids, text_hashes = _unpacked(ids, "i8", "i8")
            local, place, before, after, ctx = _unpacked(entries, "i4", "i4", "u1", "u1", f"V{BEFORE + LENGTH}")
            parts.append((local.astype(np.int64) + len(who), place, before, after, ctx.view(np.uint8).reshape(-1, BEFORE + LENGTH)))
            who += zip(doc_ids.tolist(), text_hashes.tolist(), strict=True)
    doc, place, masks = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)
    if parts:
        doc, place, before, after, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        masks = repeated_splits(ctx, before, after, np.array([w[0] for w in who], np.int64)[doc])
        hit = np.flatnonzero(masks)
        doc, place, masks = doc[hit], place[hit], masks[hit]
    more, at, own_masks = _passed(own, who, ("i4", "u4"))
    yield from _grouped_batch(_group_rows(np.concatenate((doc, more)), who, groups, np.concatenate((place, at)), np.concatenate((masks, own_masks))))


def covered(n: int, blobs: list[bytes]) -> np.ndarray:
    """Which of a text's n bytes its repeated strings cover."""
    if not blobs:
        return np.zeros(n, bool)
    parts = [_unpacked(blob, "i4", "u4") for blob in blobs]
    place, masks = (np.concatenate(x) for x in zip(*parts, strict=True))
    at, o = np.nonzero((masks[:, None] >> np.arange(SPLITS, dtype=np.uint32)[None, :]) & np.uint32(1))
    starts = np.concatenate(([0], np.cumsum(np.bincount(place[at] - o, minlength=n))))
    before = np.concatenate((np.zeros(LENGTH, np.int64), starts))[: n + 1]
    return starts[1:] > before[1:]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed_rows(batch: dict[str, list], with_text: bool) -> dict[str, list]:
    out: dict[str, list] = defaultdict(list)
    for doc_id, text, blobs in zip(batch["doc_id"], batch["text"], batch["repeats"], strict=True):
        text = text or b""
        gone = covered(len(text), blobs or [])
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out["doc_id"].append(doc_id)
        out["n_bytes"].append(len(text))
        out["n_removed"].append(int(gone.sum()))
        out["n_spans"].append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        if with_text:
            out["kept"].append(kept)
    return out


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """A row for each row of docs (doc_id, text); with_text: also kept, the remaining bytes."""
    spark = docs.sparkSession
    buckets = scan_partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    usable = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    transit = f"bucket int, {WHO}, packed binary"
    grouped = "bucket int, packed binary"

    def by_document(rows: DataFrame, reduce, kinds: tuple[str, ...], label: str) -> DataFrame:
        """rows (transit) meet in their buckets; what reduce finds there meets again by group of documents."""
        met = rows.repartitionById(buckets, "bucket").mapInArrow(lambda b: reduce(b, buckets), grouped)
        return written(met.repartitionById(buckets, "bucket").mapInArrow(lambda b: _merged_rows(b, kinds), f"{WHO}, packed binary"), label)

    shared = by_document(map_rows(usable, lambda b: _anchor_rows(b, buckets), transit), _shared_rows, ("i4",), "anchors")
    of_doc = shared.select("doc_id", "text_hash", F.array("packed").alias("places"))
    around = map_rows(usable.join(of_doc, ["doc_id", "text_hash"]), lambda b: _context_rows(b, buckets), transit)
    repeats = by_document(around, _repeat_rows, ("i4", "u4"), "repeats")
    of_text = repeats.select("doc_id", "text_hash", F.array("packed").alias("repeats"))
    joined = texts.join(of_text, ["doc_id", "text_hash"], "left").select("doc_id", "text", "repeats")
    return map_rows(joined, lambda b: _removed_rows(b, with_text), RESULT + (", kept binary" if with_text else ""))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
