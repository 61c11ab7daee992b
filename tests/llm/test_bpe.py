"""Encoding and decoding by distinct words against the tokenizers library, on odd texts, small parts and whole tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe
from corpusloom.llm.packing import default_tokenizer

LONG = "Überlänge " * 30_000 + "x" * 100_000 + "日本語" * 5_000
ODD = [
    None, "", " \n\t\x0b\x0c\r", "\xa0 　 ", "a", "The end.", "the END.,,.", "it's, isn't; we'll. I'd.", "3.14. 1,000, v2..", "--. -, .. ,a.", LONG,
    "H̱ ẖ Á.B̈, é", "Σίσυφος ΟΔΥΣΣΕΥΣ", "İstanbul ı I", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>. a<|b", "ẞ ß ﬁ ŉ", "日本語。テキスト、です", "emoji 👩‍👩‍👧 ok‍.", "nul\x00byte a\x1cb\x85c", "snake_case.CamelCase,a.b.", "tab\tsep\r\nnew",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(default_tokenizer())
    inner.no_truncation()
    inner.no_padding()
    return inner


def brute(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.asarray(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


def docs(spark, texts):
    rows = [(i if i % 7 else None, t, i, "p", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, code long, part string, word string")


def test_odd_texts(spark, library):
    """Nulls, no ids, combining letters, special tokens, clashing column names, rows without a doc_id, repeated rows."""
    texts = ODD + ODD
    got = [(x.doc_id, bytes(x.ids), x.decoded) for x in bpe.encode_documents(docs(spark, texts).repartition(3)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(got, key=key) == sorted(((i if i % 7 else None, *brute(library, t)) for i, t in enumerate(texts)), key=key)


def test_many_parts_and_stretches(spark, library, monkeypatch):
    """Parts, rows and stretches of a few bytes, so that words and documents cross all of them; one word in a third of all
    places."""
    for name, value in (("PART_BYTES", 700), ("ROW_BYTES", 150), ("ROW_WORDS", 5), ("STRETCH", 300)):
        monkeypatch.setattr(bpe, name, value)
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "The.", f"w{r.randrange(40)}", "unbelievably,", "\xa0", "Éá"]) for _ in range(r.choice((0, 1, 9, 60)))) for _ in range(120)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = bpe.split_words(d)
        assert parts.select("part").distinct().count() > 10
        got = {x.doc_id: (bytes(x.ids), x.decoded) for x in bpe.encode_documents(d).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: brute(library, t) for i, t in enumerate(texts)}


def test_each_distinct_word_is_encoded_once(spark):
    words = spark.createDataFrame([(p, c, w) for p in range(9) for c, w in enumerate(["the", "zebra", "\xa0"])], "part long, code int, word string").repartition(2, "word").sortWithinPartitions("word")
    rows = bpe.encoded_words(words, default_tokenizer()).collect()
    assert sum(x["at"] == 0 for x in rows) == 3 and sum(x.part is not None for x in rows) == 27
    assert sum(x["at"] is not None and x.id is None for x in rows) == 1


def test_answers_reach_a_part_once(spark):
    """Not beside every row of its documents; rows of a part come in order, also of one without answers."""
    documents = spark.createDataFrame([(p, k, [10 * p + k], [1], b"x") for p in (3, 1, 2) for k in (2, 0, 1)], "part long, place int, doc_ids array<long>, sizes array<int>, codes binary").repartition(2)
    answers = spark.createDataFrame([(p, [(b"c", b"s", b"i", b"t")]) for p in (1, 2)], "part long, answers array<struct<codes: binary, sizes: binary, ids: binary, texts: binary>>")
    rows = bpe.answered(documents, answers).collect()
    assert {p: [(x.place, x.answers is not None) for x in rows if x.part == p] for p in (1, 2, 3)} == {1: [(0, True), (1, False), (2, False)], 2: [(0, True), (1, False), (2, False)], 3: [(0, False), (1, False), (2, False)]}


def test_decode_ids(spark, library):
    lists = [[320, 1125, 49406, 7], [], None, [3, None, 10**8, 3], [49407]]
    d = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    got = {x.doc_id: x.decoded for x in bpe.decode_ids(d).collect()}
    assert got == {i: library.decode([x for x in ids or [] if x is not None], skip_special_tokens=False) for i, ids in enumerate(lists)}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(none).collect() == [] and bpe.decode_ids(none.select("doc_id", F.array().cast("array<int>").alias("ids"))).collect() == []


def test_query(spark, library):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = {x.doc_id: x for x in entry.queries()["op13_distinct_word_bpe"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids, text = brute(library, row.text)
        x = got[row.doc_id]
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
