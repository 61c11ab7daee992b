"""BPE encoding and decoding through a table of distinct words.

Texts are split at white space into words, and the stops behind a letter or digit into words of their own: the tokenizer
drops white space and treats what stands between it alone, so a text's ids are its words' ids one after the other. Stretches
of 32 MB of text (parts) are written as numbers into their own lists of distinct words. All lists are exploded and meet
by word; each distinct word of the corpus is encoded once, its ids find their pieces through a join with the vocabulary,
and ids and pieces go back to the parts' lists, where each document's ids are joined by position. A frequent word thus
travels once a part, however often it stands there, and documents travel never: the parts' numbers lie bucketed
by part in the shared folder, and only the (much smaller) lists are shuffled.

A task holds one part's distinct words and a row of its documents, a few MB; a longer document is a row of its own. A
part's ids and texts reach a task once, beside the first row of its documents. Parts are numbered when they are written, so a lost executor costs the reading of files.

Defined edge cases: a null or empty text, or one of white space alone, has no ids and decodes to an empty text. Repeated
rows are encoded row by row, rows without a doc_id as others. An empty table gives no rows. Extra columns are ignored.
Special tokens in a text are found as the tokenizer finds them.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, scan_partitions, shared_folder, slices, table
from .packing import PLAIN, default_tokenizer

#: Bytes of text in a part, and of those whose numbers stand in one row.
PART_BYTES, ROW_BYTES = 32 << 20, 8 << 20
#: Words of a part's list in one row.
ROW_WORDS = 8192
#: Bytes of the stream of encoded words that are packed at a time.
STRETCH = 8 << 20
#: Words that are put together at a time.
STEP_WORDS = 1 << 17

#: Stops at a word's end, behind a letter or digit: a word of their own for the tokenizer too.
STOPS = re.compile(rb"([A-Za-z0-9])([.,]+)(?=[ \t\n\x0b\x0c\r]|$)")

#: first_code: the number of a row's first word; of a row of documents its place among those of its part.
PARTS = "part long, doc_ids array<long>, sizes array<int>, codes binary, first_code int, words array<string>"


def words_of(text: str) -> list[bytes]:
    """The words of a text in UTF-8. Texts that are stable under NFC come in lower case; the tokenizer would put them so.
    Others stay as they are, since lower case can make a letter combine with what follows it."""
    plain = "<|" not in text and PLAIN.fullmatch(text)
    return STOPS.sub(rb"\1 \2", (text.lower() if plain else text).encode()).split()


class Part:
    """Documents as numbers into the list of their distinct words."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.known: dict[bytes, int] = {}
        self.rows: list[tuple[list, list[int], list[np.ndarray]]] = []
        self.row_size = ROW_BYTES

    def add(self, doc_id: int | None, text: str) -> None:
        words, known = words_of(text), self.known
        for w in words:
            if w not in known:
                known[w] = len(known)
        if self.row_size >= ROW_BYTES:
            self.rows.append(([], [], []))
            self.row_size = 0
        ids, sizes, codes = self.rows[-1]
        ids.append(doc_id)
        sizes.append(len(words))
        codes.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        size = len(text) + 16
        self.size += size
        self.row_size += size

    def batches(self, schema):
        """Rows of documents, then rows of words. Frequent words get low numbers, which compress better."""
        import pyarrow as pa
        import zstandard

        n, pack = len(self.known), zstandard.ZstdCompressor(level=3)
        counts = np.zeros(n, np.int64)
        for _, _, codes in self.rows:
            counts += np.bincount(np.concatenate(codes), minlength=n)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        for place, (ids, sizes, codes) in enumerate(self.rows):
            planes = rank[np.concatenate(codes)].astype("<i4").view(np.uint8).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.number]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack.compress(planes.tobytes())], pa.binary()), pa.array([place], pa.int32()), pa.nulls(1, pa.list_(pa.string()))],
                schema=schema,
            )
        words = list(self.known)
        for at in range(0, n, ROW_WORDS):
            some = pa.array([words[i] for i in order[at : at + ROW_WORDS].tolist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.number]), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.binary()), pa.array([at], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)],
                schema=schema,
            )


def split_words(docs: DataFrame) -> DataFrame:
    """The parts of docs (doc_id, text): rows of documents (doc_ids, sizes: words a document, codes: all their numbers) and
    rows of words (words, the first of which has the number first_code)."""
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(PARTS)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kinds)
        number = TaskContext.get().partitionId() << 32
        part = Part(number)
        for batch in batches:
            for some in slices(batch, 8 << 20):
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    part.add(doc_id, text or "")
                    if part.size >= PART_BYTES:
                        yield from part.batches(schema)
                        number += 1
                        part = Part(number)
        if part.rows:
            yield from part.batches(schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), kinds)


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by key, so that what meets it by key need not move it."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{shared_folder(spark)}/corpusloom/{name}").bucketBy(buckets, key).format("parquet").saveAsTable(name)
    return spark.table(name)


def vocabulary(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece) of a tokenizer's file, special tokens included: as many rows as it has ids."""
    from tokenizers import Tokenizer

    pieces = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(sorted((i, p) for p, i in pieces.items()), "id int, piece string")


TOKENS = "part long, code int, at int, id int"


def encoded_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (part, code, word), sorted by word, to one stream of rows: for each distinct word its ids (at: place among
    them, from 0; a word without ids has one row with a null id), then its places (part, code), without an id."""

    def run(batches):
        import os

        import pyarrow as pa
        import pyarrow.compute as pc

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        inner = Tokenizer.from_file(tokenizer)
        inner.no_truncation()
        inner.no_padding()
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column("word"))
            heads = runs.values.to_pylist()
            new = heads[1:] if heads[0] == last else heads
            last = heads[-1]
            ids = [np.asarray(e.ids, np.int32) for e in inner.encode_batch(new, add_special_tokens=False)]
            lengths = np.array([len(x) for x in ids], np.int64)
            shown = np.maximum(lengths, 1)
            if len(new) < len(heads):
                lengths, shown = np.append(0, lengths), np.append(0, shown)
            places = np.diff(np.append(0, np.asarray(runs.run_ends)).astype(np.int64))
            ends = np.cumsum(shown + places)
            n, begins = int(ends[-1]), ends - shown - places
            at = np.arange(int(shown.sum())) - np.repeat(np.cumsum(shown) - shown, shown)
            token = np.repeat(begins, shown) + at
            is_token = np.zeros(n, bool)
            is_token[token] = True
            ats, made, has_id = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
            ats[token] = at
            has_id[np.repeat(begins, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = True
            if len(ids):
                made[has_id] = np.concatenate(ids)
            part, code = np.zeros(n, np.int64), np.zeros(n, np.int32)
            part[~is_token], code[~is_token] = batch.column("part").to_numpy(), batch.column("code").to_numpy()
            columns = [pa.array(part, mask=is_token), pa.array(code, mask=is_token), pa.array(ats, mask=~is_token), pa.array(made, mask=~has_id)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "code", "at", "id"])

    return words.mapInArrow(giving_back(run), TOKENS)


ANSWERS = "part long, codes binary, sizes binary, ids binary, texts binary"


def answers_of(stream: DataFrame) -> DataFrame:
    """The stream of encoded_words, with the ids' pieces, to rows of parts: numbers of words, and their ids and texts (the
    pieces with blanks between), compressed; a part has a row in each stretch of the stream that holds words of it."""
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(ANSWERS)

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        pack, schema = zstandard.ZstdCompressor(level=3).compress, to_arrow_schema(kinds)

        def rows(whole):
            """The answers of a stretch, and the ids of its last word, whose places may go on in the next one."""
            at = whole.column("at").fill_null(-1).to_numpy()
            ids, pieces = whole.column("id").fill_null(-1).to_numpy(), whole.column("piece").to_pylist()
            group = np.cumsum(at == 0) - 1
            token = np.flatnonzero((at >= 0) & (ids >= 0))
            sizes = np.bincount(group[token], minlength=group[-1] + 1)
            begins = np.cumsum(sizes) - sizes
            pieces = [pieces[i] for i in token.tolist()]
            texts = [" ".join(pieces[b : b + n]) for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
            ids, place = ids[token], np.flatnonzero(at < 0)
            parts, codes, group = whole.column("part").fill_null(-1).to_numpy()[place], whole.column("code").fill_null(-1).to_numpy()[place], group[place]
            order = np.lexsort((codes, parts))
            parts, codes, group = parts[order], codes[order], group[order]
            out, begin = [], 0
            for end in np.append(np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts)).tolist() if len(parts) else []:
                mine = group[begin:end]
                flat = ids[spread(begins[mine], sizes[mine])].astype("<i4").view(np.uint8).reshape(-1, 4).T
                out.append((int(parts[begin]), pack(codes[begin:end].astype("<i4").tobytes()), pack(sizes[mine].astype("<i4").tobytes()), pack(flat.tobytes()), pack("\n".join([texts[g] for g in mine.tolist()]).encode())))
                begin = end
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else None

        def tokens_of_last(whole):
            at = whole.column("at").fill_null(-1).to_numpy()
            begin = int(np.flatnonzero(at == 0)[-1])
            return whole.slice(begin).filter(pa.array(at[begin:] >= 0))

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > STRETCH:
                whole = pa.Table.from_batches(held).combine_chunks()
                if (made := rows(whole)) is not None:
                    yield made
                held, size = tokens_of_last(whole).combine_chunks().to_batches(), 0
        if held and (made := rows(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield made

    return stream.mapInArrow(giving_back(run), kinds)


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begins[0], begins[0] + 1, .. of so many each, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


ENCODED = "doc_id long, ids binary, decoded string"


def whole(planes: bytes) -> np.ndarray:
    """Numbers of 32 bits of which the lowest bytes come first, then the next, and so on."""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


class Words:
    """The ids and texts of a part's words, by number: flat arrays, and where each word's stretch begins. A text has a blank
    behind it."""

    def __init__(self, answers: list[dict], unpack):
        codes = np.concatenate([np.zeros(0, "<i4"), *[np.frombuffer(unpack(x["codes"]), "<i4") for x in answers]])
        n = len(codes)
        self.sizes, self.begins, self.lengths, self.starts = (np.zeros(n, np.int64) for _ in range(4))
        sizes = np.concatenate([np.zeros(0, "<i4"), *[np.frombuffer(unpack(x["sizes"]), "<i4") for x in answers]])
        self.sizes[codes], self.begins[codes] = sizes, np.cumsum(sizes, dtype=np.int64) - sizes
        self.ids = np.concatenate([np.zeros(0, "<i4"), *[whole(unpack(x["ids"])) for x in answers]])
        self.texts = np.frombuffer(bytearray(b"".join(unpack(x["texts"]) + b"\n" for x in answers)), np.uint8)
        ends = np.flatnonzero(self.texts == 10) + 1
        self.texts[ends - 1] = 32
        self.lengths[codes], self.starts[codes] = np.diff(ends, prepend=0), np.append(0, ends[:-1])[:n]
        self.lengths[self.sizes == 0] = 0

    def documents(self, counts: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Ids and texts of documents of so many words each, whose numbers follow each other in codes."""
        parts = [codes[i : i + STEP_WORDS] for i in range(0, len(codes), STEP_WORDS)]
        ids = b"".join([self.ids[spread(self.begins[c], self.sizes[c])].tobytes() for c in parts])
        texts = b"".join([self.texts[spread(self.starts[c], self.lengths[c])].tobytes() for c in parts])
        ends = np.cumsum(counts)
        at, to = (np.append(0, np.cumsum(x[codes]))[np.append(0, ends)].tolist() for x in (4 * self.sizes, self.lengths))
        return [ids[i:j] for i, j in zip(at, at[1:], strict=False)], [texts[i : max(i, j - 1)] for i, j in zip(to, to[1:], strict=False)]


def joined(batches):
    """Rows of documents to documents, one row's after the other. Rows of a part follow each other, and the answers stand
    beside the first, so that a part's words travel and are unpacked once."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    part, words = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            if words is None or batch.column("part")[i].as_py() != part:
                words = None  # before the next part's words are unpacked
                part, words = batch.column("part")[i].as_py(), Words(batch.column("answers")[i].as_py() or [], unpack)
            doc_ids, counts, codes = batch.column("doc_ids")[i].values, batch.column("sizes")[i].values.to_numpy(), whole(unpack(batch.column("codes")[i].as_py()))
            ends, begin = np.cumsum(counts, dtype=np.int64), 0
            while begin < len(counts):  # some documents at a time
                done = int(ends[begin] - counts[begin])
                end = max(begin + 1, int(np.searchsorted(ends, done + STEP_WORDS, "right")))
                ids, decoded = words.documents(counts[begin:end], codes[done : int(ends[end - 1])])
                yield pa.RecordBatch.from_arrays([doc_ids.slice(begin, end - begin), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())], schema=schema)
                begin = end


def answered(documents: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of documents in order of part and place, the first of a part with its answers beside it, the others with null."""
    d, a = documents.alias("d"), answers.hint("merge").alias("a")
    met = d.join(a, (F.col("d.part") == F.col("a.part")) & (F.col("d.place") == 0), "left")
    return met.select("d.*", "a.answers").sortWithinPartitions("part", "place")


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of each row of docs (doc_id, text): the ids as unsigned little-endian numbers of 32 bits, and
    the text that decoding them gives."""
    path, n = tokenizer or default_tokenizer(), scan_partitions(docs.sparkSession)
    parts = bucketed(split_words(docs), "part", n, "parts")
    words = parts.where(F.col("words").isNotNull()).select("part", "first_code", F.posexplode("words").alias("_at", "word"))
    # One shuffle brings the parts' words together; each distinct word is encoded where they lie.
    words = words.select("part", (F.col("first_code") + F.col("_at")).alias("code"), "word").repartition(n, "word").sortWithinPartitions("word")
    # The join keeps the stream's order, since the vocabulary is sent to all tasks; it is bounded by the tokenizer's size.
    stream = encoded_words(words, path).join(F.broadcast(vocabulary(docs.sparkSession, path)), "id", "left").select("part", "code", "at", "id", "piece")
    answers = answers_of(stream)
    answers = answers.groupBy("part").agg(F.collect_list(F.struct("codes", "sizes", "ids", "texts")).alias("answers"))
    documents = parts.where(F.col("doc_ids").isNotNull()).select("part", F.col("first_code").alias("place"), "doc_ids", "sizes", "codes")
    return answered(documents, answers).mapInArrow(giving_back(joined), ENCODED)


def decode_ids(encoded: DataFrame, tokenizer: str | None = None, ids: str = "ids") -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, array of ids), for ids from elsewhere: each row's ids meet the vocabulary by id
    and come together by row again. Ids that the vocabulary lacks, and nulls among them, give nothing; a null or empty
    array gives an empty text."""
    rows = encoded.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.col(ids).alias("_ids"))
    rows = rows.select("doc_id", "_row", F.posexplode_outer("_ids").alias("_at", "id"))
    pieces = rows.join(F.broadcast(vocabulary(encoded.sparkSession, tokenizer or default_tokenizer())), "id", "left")
    # collect_list leaves nulls out, but not structs that hold them
    found = pieces.groupBy("doc_id", "_row").agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("_at", "piece")))).alias("found"))
    return found.select("doc_id", F.array_join(F.transform("found", lambda x: x["piece"]), " ").alias("decoded"))


def op13_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_documents(table(spark, sf_dir, "documents"))
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
