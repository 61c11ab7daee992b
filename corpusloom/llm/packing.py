"""Packing along a space-filling curve.

Each document becomes token ids and a hashed vector of them, projected to a few dimensions; the cells of the projection
are numbered along a Hilbert curve. Documents are range-sorted by (curve, doc_id), and each partition cuts its stretch of
the curve into sequences, so that neighbours on the curve share sequences. A document is cut only where a sequence is
full. The last sequence of a partition is cut into powers of two, which need no padding.

Tokens are made once: the ids, compressed, are written to the shared folder with their curve key; the sort samples and
shuffles only those. A task streams over its partition and holds one open sequence, whatever the size of the data or of a
document. Many documents with one key (copies) are dealt by doc_id within the key. sequence_id is the partition number
times 2^40 plus a count, so that no global count is needed.

Defined edge cases: a null or empty text is the closing id alone. Repeated rows are packed row by row. Documents are
ordered by (curve, doc_id, length); rows with a null doc_id come first. An empty table gives no pieces. Extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, map_rows, scan_partitions, table, written

LENGTH = 2048
CLOSING_ID = 1
DIMENSIONS, BITS, BUCKETS = 4, 15, 256
#: Bytes of a worker's word cache, about: two halves, the older of which goes when the other is full. Workers keep it from
#: task to task, so that an executor holds one for each worker.
CACHE = 160 << 20

#: Distinct words that are looked up, and where missing encoded, at a time.
STEP_WORDS = 8192

#: Signs of a word's tail, behind a letter or digit: tokens of their own anyway; apart, more words are found in the cache.
#: They are neither letters nor digits, nor do they begin a token with letters, as "'" does.
TAIL = re.compile(r"[.,;:!?*#$%&](?<=[^\W_].)[.,;:!?*#$%&]*(?=[ \t\n\x0b\x0c\r]|$)")

#: Texts of these characters alone are tokenized word by word: they are stable under NFC, lower-case one by one, and only
#: the white space among them separates words. Other texts go through the tokenizer whole.
PLAIN = re.compile("[\t\n\x0b\x0c\r -~¡-įı-ňŊ-ž‐-‧‰-⁞]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts, with a cache by word: the tokenizer drops white space and treats the words between on their own."""

    _made: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.wide = self.inner.get_vocab_size(with_added_tokens=True) > 65536
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        #: By id, whether its token ends a word; None where the tokenizer's tokens do not tell.
        self.last: np.ndarray | None = None
        if suffix := getattr(self.inner.model, "end_of_word_suffix", None):
            vocabulary = self.inner.get_vocab(with_added_tokens=False)
            self.last = np.zeros(max([*vocabulary.values(), self.inner.get_vocab_size(with_added_tokens=True)]) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        words = [x for x in texts if x.isalpha()] if self.last is not None else []
        made = self._in_one(words) if len(words) > 1 else {}
        rest = [x for x in texts if x not in made]
        made |= zip(rest, (np.asarray(e.ids, self.kind).tobytes() for e in self.inner.encode_batch_fast(rest, add_special_tokens=False)), strict=True)
        return [made[x] for x in texts]

    def _in_one(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters, encoded as one text: each has one token that ends a word, its last. Nothing where the
        count of such tokens is another, so that a word could have been cut."""
        ids = np.asarray(self.inner.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return {}
        raw, cuts = ids.tobytes(), [0, *(ends * self.kind.itemsize).tolist()]
        return {w: raw[a:b] for w, a, b in zip(words, cuts, cuts[1:])}

    def encode(self, text: str) -> bytes:
        """The ids as bytes of self.kind."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode of each text. A word is looked up once, however often it stands in them."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = [i for i, text in enumerate(texts) if "<|" not in text and PLAIN.fullmatch(text)]
        # these texts' only white space is ASCII's
        words = pc.ascii_split_whitespace(pa.array([TAIL.sub(r" \g<0>", texts[i].lower()) for i in plain], pa.large_string()))
        found = words.flatten().dictionary_encode()
        distinct = found.dictionary
        ids = [pa.array([], pa.large_binary())]
        for at in range(0, len(distinct), STEP_WORDS):
            ids.append(pa.array(self._known(distinct.slice(at, STEP_WORDS).to_numpy(zero_copy_only=False).tolist()), pa.large_binary()))
        joined = pa.concat_arrays(ids).take(found.indices)
        _, starts, data = joined.buffers()
        cuts = np.frombuffer(starts, np.int64, len(joined) + 1)[words.offsets.to_numpy()].tolist() if len(joined) else [0] * (len(plain) + 1)
        view = memoryview(data or b"")
        out: list[bytes | None] = [None] * len(texts)
        for i, a, b in zip(plain, cuts, cuts[1:]):
            out[i] = bytes(view[a:b])
        return [self._whole([text])[0] if x is None else x for x, text in zip(out, texts, strict=True)]

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, through the cache."""
        if self.held > CACHE // 2:
            self.older, self.cache, self.held = self.cache, {}, 0
        cache, older = self.cache, self.older
        out = list(map(cache.get, words))
        missing = [w for w, x in zip(words, out, strict=True) if x is None]
        if not missing:
            return out
        found = {w: older[w] for w in missing if w in older}
        new = [w for w in missing if w not in found]
        found |= zip(new, self._whole(new), strict=True)
        cache.update(found)
        self.held += 180 * len(found) + 6 * sum(map(len, found))
        return [found[w] if x is None else x for w, x in zip(words, out, strict=True)]


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of cell coordinates, each of so many bits."""
    x = [cells[:, d].astype(np.uint64) for d in range(cells.shape[1])]
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > 1:
        below = q - one
        for d in range(n):
            high = (x[d] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[d]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
        q >>= one
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    flip, q = np.zeros(len(x[0]), np.uint64), one << np.uint64(bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - one), flip)
        q >>= one
    key = np.zeros(len(x[0]), np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << one) | (((x[d] ^ flip) >> np.uint64(b)) & one)
    return key.astype(np.int64)


class Projection:
    """Token ids to cells: hashed signed counts, normalised, projected by a fixed random matrix, squashed to bits."""

    def __init__(self):
        ids = np.arange(1 << 17, dtype=np.uint64)
        with np.errstate(over="ignore"):
            mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
        self.bucket = (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS
        self.sign = np.where((mixed >> np.uint64(63)).astype(bool), 1.0, -1.0)
        self.matrix = np.random.default_rng(2048).standard_normal((BUCKETS, DIMENSIONS))

    def cells(self, ids: np.ndarray) -> np.ndarray:
        at = ids & 0x1FFFF
        vector = np.bincount(self.bucket[at], self.sign[at], BUCKETS)
        y = vector @ self.matrix / max(1.0, float(np.sqrt(vector @ vector)))
        return ((np.tanh(0.8 * y) + 1) * 0.5 * (2**BITS - 1)).astype(np.int64)


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, curve, n_tokens, ids) of each row, the closing id included; ids are zstd of little-endian numbers."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        import zstandard

        words, project, pack = WordTokenizer.of(tokenizer), Projection(), zstandard.ZstdCompressor(level=3)
        closing = np.asarray([CLOSING_ID], words.kind).tobytes()
        ids = [x + closing for x in words.encode_all([t or "" for t in batch["text"]])]
        cells = np.array([project.cells(np.frombuffer(x, words.kind).astype(np.int64)) for x in ids])
        return {"doc_id": batch["doc_id"], "curve": hilbert_key(cells, BITS).tolist(), "n_tokens": [len(x) // words.kind.itemsize for x in ids], "ids": [pack.compress(x) for x in ids]}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, curve long, n_tokens long, ids binary", 4 << 20)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Cuts a stream of documents into sequences. Holds the pieces of one open sequence."""

    def __init__(self, first_id: int):
        self.next_id, self.fill, self.open = first_id, 0, []
        self.out: list[tuple] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, LENGTH - self.fill)
            self.open.append((doc_id, at, ids[at : at + n], len(ids)))
            self.fill += n
            at += n
            if self.fill == LENGTH:
                self._close(LENGTH)

    def _close(self, length: int) -> None:
        """Makes a sequence of the first length ids that are open."""
        offset, rest = 0, []
        for doc_id, start, ids, total in self.open:
            n = min(len(ids), length - offset)
            if n:
                self.out.append((doc_id, start, n, zlib.crc32(ids[:n].astype("<u4").tobytes()), total, self.next_id, offset, ids[:n]))
                offset += n
            if n < len(ids):
                rest.append((doc_id, start + n, ids[n:], total))
        self.open, self.fill, self.next_id = rest, self.fill - length, self.next_id + 1

    def finish(self) -> None:
        while self.fill:
            self._close(1 << (self.fill.bit_length() - 1))

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text); with_ids: also ids array<int>, the piece's tokens."""
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    kind = WordTokenizer.of(path).kind.str
    made = written(tokenized(docs, path), "tokens")
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def run(batches):
        import pyarrow as pa
        import zstandard

        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        unpack, packer = zstandard.ZstdDecompressor(), Packer(TaskContext.get().partitionId() << 40)

        def batch_of(rows: list[tuple]):
            columns = list(zip(*rows, strict=True))[: len(names)]
            return pa.RecordBatch.from_arrays([pa.array([c.tolist() for c in x] if i == 7 else x, k) for i, (x, k) in enumerate(zip(columns, kinds, strict=True))], names=names)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                packer.add(doc_id, np.frombuffer(unpack.decompress(ids), kind))
                if len(packer.out) >= 4096:
                    yield batch_of(packer.taken())
        packer.finish()
        if rows := packer.taken():
            yield batch_of(rows)

    along = made.repartitionByRange(scan_partitions(spark), "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "n_tokens")
    return along.select("doc_id", "ids").mapInArrow(giving_back(run), schema)


def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
