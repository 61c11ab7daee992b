"""HTML, packing, substrings, near duplicates, decontamination and the pipeline against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import decontaminate, html, html_training, neardup, packing, substrings
from corpusloom.llm.deepshallow import BlindTrie, deep_shallow

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, curve string"
ODD = [None, "", " \n", "a", "A b", "x" * 150_000, "ab " * 20_000, "no\0ise é ü ＡＢ", "<|endoftext|> İ ﬁ"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", 0, "x") for i, t in enumerate(texts)], DOCS)


def prose(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


# ---- html ----


def labelled(page):
    blocks = html.read_blocks(page)
    odds = html.Labeller.load().scores([blocks])[0]
    return " ".join(b.text for b, x in zip(blocks, odds, strict=True) if x > 0)


def test_reading_blocks():
    page = "<html><head><title>T</title><script>var a='</p>';</script><style>p{}</style></head><body><!-- c --><p>a<b>b</b>c &amp; d<br>e<p>f\n\n g<ul><li>1<li>2</ul>x < y<div title='>'>z"
    assert [b.text for b in html.read_blocks(page)] == ["abc & d", "e", "f g", "1", "2", "x < y", "z"]
    for odd in ("", "<", "<p", "</", "a</b", "<script>", "<!--", "<p class='", "&#x110000;&bogus;", "<" * 5000, "<a href='x" * 3000):
        html.read_blocks(odd)


def test_labels_common_pages():
    page = '<html><body><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-banner">We use cookies.</div><article><h1>Title here</h1><p>First text of it.</p><p>Second one.</p></article><aside class="sidebar"><p>Other news of the day.</p></aside><section id="comments"><p>Nice post, thanks.</p></section><form><label>Name</label></form><footer>&copy; me</footer></body></html>'
    assert labelled(page) == "Title here First text of it. Second one."


def test_held_out_accuracy():
    blocks, pages = html_training.held_out(html.Labeller.load().p, 20_000_000, 300)
    assert blocks > 0.995 and pages > 0.95


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<article><p>Only this text.</p></article>", "x"), (3, "u", "<article><p>Only this text.</p></article>", "x")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract_text(pages).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "Only this text.", 15), (3, "Only this text.", 15)]
    assert html.extract_text(pages.limit(0)).count() == 0


# ---- packing ----


def test_word_tokenizer_agrees():
    t = packing.WordTokenizer.of(packing.default_tokenizer())
    r = random.Random(2)
    pool = ["don't", "l'été.", "***,", "x2y", "a.b.", "Straße,", "ÉCOLE", "“q”", "1,000.", "...", "co-op.", "’s", "İx", "ﬁ", "á", "naïve..", "É.", "5.", "_a_."]
    for text in [*filter(None, ODD), *(" ".join(r.choices(pool, k=r.randint(1, 12))) for _ in range(400))]:
        assert np.frombuffer(t.encode(text), t.kind).tolist() == t.inner.encode(text, add_special_tokens=False).ids, text


def test_new_words_reach_the_tokenizer_together(monkeypatch):
    """Words of letters that no cache holds are encoded as one text, not one by one."""
    t = packing.WordTokenizer(packing.default_tokenizer())
    inner, sent = t.inner, []

    class Counting:
        def __getattr__(self, name):
            return (lambda texts, **k: sent.extend(texts) or getattr(inner, name)(texts, **k)) if name.startswith("encode_batch") else getattr(inner, name)

    monkeypatch.setattr(t, "inner", Counting())
    r = random.Random(3)
    text = " ".join("".join(r.choices("aeinorstéß", k=9)) + r.choice(["", ",", ".", "***", "?!"]) for _ in range(5000))
    assert np.frombuffer(t.encode(text), t.kind).tolist() == inner.encode(text, add_special_tokens=False).ids
    assert len(sent) < 20


@pytest.mark.parametrize("telling", [True, False])
def test_texts_of_a_part_agree(monkeypatch, telling):
    """Every character of word-wise texts, tails of signs, empty texts and others, all at once; also where an encoded
    text does not tell its words apart."""
    t = packing.WordTokenizer(packing.default_tokenizer())
    if not telling:
        monkeypatch.setattr(t, "last", np.zeros_like(t.last))
    signs = [c for c in map(chr, range(0x2100)) if packing.PLAIN.fullmatch(c)]
    texts = ["", " \n\t", *(x or "" for x in ODD), *(f"{c} a{c}b {c}{c}X, x{c}. A{c}'s q{c}*** 5{c}%" for c in signs), "a'*s it's?! <|endoftext|> b", "x\x0b\x0cy  z ", "ﬁ á b&#$", ""]
    got = [np.frombuffer(x, t.kind).tolist() for x in t.encode_all(texts)]
    assert got == [t.inner.encode(x, add_special_tokens=False).ids for x in texts]
    assert t.encode_all([]) == [] and t.encode_all(["", "Ω"])[0] == b"" and t.encode_all(["Ω"]) == [t.encode("Ω")]


def test_word_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20_000)
    t = packing.WordTokenizer(packing.default_tokenizer())
    for i in range(60):
        text = " ".join(f"w{i}x{k}" for k in range(20)) + " " + "q" * 900
        assert np.frombuffer(t.encode(text), t.kind).tolist() == t.inner.encode(text, add_special_tokens=False).ids
        assert t.held < 40_000 and sum(len(w) for w in t.cache) < 40_000


def test_word_cache_keeps_words_in_use(monkeypatch):
    """A full cache gives up its older half alone; both halves together stay near the bound."""
    monkeypatch.setattr(packing, "CACHE", 40_000)
    t = packing.WordTokenizer(packing.default_tokenizer())
    made, whole = [], t._whole
    monkeypatch.setattr(t, "_whole", lambda texts: made.extend(texts) or whole(texts))
    for i in range(200):
        text = f"common. w{i}x w{i}y " + "q" * 100 + str(i)
        assert np.frombuffer(t.encode(text), t.kind).tolist() == t.inner.encode(text, add_special_tokens=False).ids
        assert 180 * (len(t.cache) + len(t.older)) < 44_000
    assert made.count("common") == 1 and t.older


def test_workers_give_memory_back():
    """A task's freed memory does not stay with its worker, which later tasks use."""
    import re
    from pathlib import Path

    from corpusloom.llm.common import giving_back

    held = lambda: int(re.search(r"\nPss_Anon: +(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10

    def run(batches):
        for n in batches:
            some = [np.ones(8000, np.uint8) for _ in range(n)]
            del some[: n - 1]  # what is left lies behind it
            yield some

    before = held()
    kept = [*giving_back(run)([20_000])]
    assert len(kept[0]) == 1 and held() - before < 60


def test_hilbert_neighbours_touch():
    n, bits = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    order = cells[np.argsort(packing.hilbert_key(cells, bits))]
    assert sorted(packing.hilbert_key(cells, bits)) == list(range(len(cells))) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_packing(spark):
    r = random.Random(5)
    texts = [*ODD, *(prose(r, r.choice((1, 50, 700, 3000))) for _ in range(40))]
    d = docs(spark, texts)
    rows = packing.pack_documents(d.union(d.limit(1))).collect()
    inner = packing.WordTokenizer.of(packing.default_tokenizer()).inner
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in rows:
        ids = (inner.encode(texts[x.doc_id] or "", add_special_tokens=False).ids + [1])[x.start : x.start + x.length]
        assert ids == x.ids and zlib.crc32(np.array(ids, "<u4").tobytes()) == x.ids_crc32
        pieces[x.doc_id].append((x.start, x.length, x.doc_tokens))
        sequences[x.sequence_id].append((x.offset, x.length))
    for i in range(1, len(texts)):
        at = 0
        for start, length, total in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == total
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack_documents(d.limit(0)).count() == 0


# ---- substrings ----


def brute_repeats(rows):
    first: dict[bytes, int] = {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for s in range(len(b) - 49):
                if first[b[s : s + 50]] < i:
                    gone[s : s + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed):
    r = random.Random(seed)
    shared = [prose(r, r.choice((8, 14, 40)), 30) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(shared) if r.random() < 0.6 else prose(r, r.randint(1, 30), 30) for _ in range(r.randint(0, 5))]
        t = r.choice(("", " ", "é")).join(parts)
        if r.random() < 0.3 and t:
            k = r.randrange(len(t))
            t = t[:k] + "Q" + t[k + 1 :]
        rows.append((i, t))
    rows += [(60, None), (61, ""), (62, "z" * 400), (63, "z" * 120), (64, "ab" * 200), (65, "ab" * 30 + "c"), (None, shared[0]), (66, "y" * 49), (67, "y" * 50), (67, "y" * 50), (68, "y" * 50), (5, shared[1] * 2), (69, "\0" * 90), (70, "\0" * 60)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, packed string").repartition(3)
    got = substrings.remove_repeats(d)
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()), key=repr) == brute_repeats(rows)
    assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in got.collect())


def test_repeats_across_strides(spark, monkeypatch):
    r = random.Random(9)
    monkeypatch.setattr(substrings, "STRIDE", 64)
    t = np.frombuffer(prose(r, 300, 20).encode(), np.uint8)
    small = substrings.anchors(t)
    monkeypatch.setattr(substrings, "STRIDE", 1 << 17)
    assert all((a == b).all() for a, b in zip(small, substrings.anchors(t), strict=True))


def test_repeats_empty(spark):
    assert substrings.remove_repeats(docs(spark, ["a"]).limit(0)).count() == 0


def test_copies_of_one_text_are_spread():
    """Thousands of documents of one text, with negative and equal keys, lie in all groups alike."""
    ids = np.arange(-2000, 6000)
    home = substrings._home(ids, np.full(len(ids), -7), 50)
    counts = np.bincount(home, minlength=50)
    assert counts.min() > 100 and counts.max() < 230
    assert [int(substrings._home([i], [-7], 50)[0]) for i in ids[:20].tolist()] == home[:20].tolist()


def test_deep_shallow_sorts(monkeypatch):
    from corpusloom.llm import deepshallow

    r = np.random.default_rng(1)
    monkeypatch.setattr(deepshallow, "DIRECT", 16)
    for width, letters, n in ((50, 2, 500), (30, 3, 300), (5, 2, 100), (40, 1, 20), (50, 2, 1)):
        rows = r.integers(0, letters, (n, width), dtype=np.uint8)
        rows[:, : width // 2] = rows[0, : width // 2]
        rows[n // 2 :] = rows[: n - n // 2]
        order, common = deep_shallow(rows)
        text = [rows[i].tobytes() for i in order]
        assert text == sorted(x.tobytes() for x in rows)
        lead = lambda a, b: next((k for k in range(width) if a[k] != b[k]), width)
        assert common.tolist() == [0] + [lead(a, b) for a, b in zip(text, text[1:], strict=False)]


def test_blind_trie():
    r = random.Random(3)
    strings = list({bytes(r.choice(b"ab") for _ in range(12)) for _ in range(300)})
    assert [strings[i] for i in BlindTrie(strings).order()] == sorted(strings)


# ---- near duplicates ----


def brute_components(rows, share=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, seed):
    r = random.Random(seed)
    texts = [*ODD, "one two three", "One two\tthree"]
    for _ in range(12):
        base = prose(r, r.choice((6, 30, 120, 400)), 5000)
        for _ in range(r.choice((1, 3, 25))):
            texts.append(edited(r, base, r.choice((0, 0, 1, 1, 2, 3, 4))))
    common = prose(r, 60, 5000)
    texts += [f"{common} {prose(r, r.choice((2, 6, 12)), 5000)}" for _ in range(40)]
    r.shuffle(texts)
    wanted = brute_components(list(enumerate(texts)))
    got = neardup.near_duplicates(docs(spark, texts)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == wanted and all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_near_duplicates_by_share(spark):
    import corpus_pipeline

    r = random.Random(5)
    texts = []
    for _ in range(40):
        base = prose(r, 200, 5000)
        texts += [base, edited(r, base, 4), edited(r, base, 5), edited(r, base, 3)]
    rows = list(enumerate(texts))
    wanted = brute_components(rows, 80)
    assert wanted != brute_components(rows)
    got = neardup.near_duplicates(docs(spark, texts), 80).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == wanted
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, texts), "").collect()
    assert {x.doc_id for x in kept} == {i for i, (_, c) in wanted.items() if i == c}


def test_index_covers_the_share():
    assert [neardup.chunks_for(s) for s in (100, 90, 85, 80)] == [12, 12, 12, 15]
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 16, neardup.POSITIONS).astype("<u2")
    for _ in range(200):
        b = a.copy()
        b[r.choice(neardup.POSITIONS, 29, replace=False)] ^= 1
        ka, kb = neardup.chunk_keys(np.stack([a, b]), 15)
        assert set(ka) & set(kb)
    with pytest.raises(ValueError, match="share 20"):
        neardup.chunks_for(20)


def test_near_duplicate_rows(spark):
    """The stage works by row: texts under one doc_id are apart, equal rows and rows without a doc_id are copies."""
    r = random.Random(6)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    x, y, z = (words(60) for _ in range(3))
    near = [*x[:30], "changed", *x[31:]]
    text = {k: " ".join(v) for k, v in (("X", x), ("Y", y), ("Z", z), ("N", near))}
    rows = [(5, "X"), (1, "X"), (5, "Y"), (None, "X"), (2, "Z"), (2, "Z"), (2, "Z"), (7, "N"), (None, None), (None, ""), (3, None)]
    d = spark.createDataFrame([(i, text.get(t, t), i, True) for i, t in rows], "doc_id long, text string, node long, kept boolean")
    assert len(set(near[i : i + 5].__str__() for i in range(56)) & {x[i : i + 5].__str__() for i in range(56)}) * 100 < 85 * 61
    key = lambda v: (str(v[0]), str(v[1]))
    got = sorted(((q.doc_id, {v: k for k, v in text.items()}.get(q.text, q.text)) for q in neardup.drop_near_duplicates(d, share=80).collect()), key=key)
    assert got == sorted([(1, "X"), (5, "Y"), (2, "Z"), (None, None), (None, ""), (3, None)], key=key)
    assert neardup.drop_near_duplicates(d, share=80).columns == d.columns


def test_near_duplicate_edges(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in neardup.near_duplicates(d).collect()), key=repr)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=repr)
    assert neardup.near_duplicates(d.limit(0)).count() == 0
    kept = neardup.drop_near_duplicates(docs(spark, ["a b c d e f", "a b c d e f", None]))
    assert sorted(x.doc_id for x in kept.collect()) == [0, 2]


def test_keys_guarantee_the_distance():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 16, neardup.POSITIONS).astype("<u2")
    for _ in range(200):
        b = a.copy()
        b[r.choice(neardup.POSITIONS, neardup.DISTANCE, replace=False)] ^= 1
        ka, kb = neardup.chunk_keys(np.stack([a, b]))
        assert set(ka) & set(kb)


def test_odd_sketches_never_rule_out_a_link():
    r = np.random.default_rng(4)
    for n in (1, 6, 20, 300):
        for _ in range(60):
            a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: len(a) - r.integers(0, 1 + n // 6)], r.integers(0, 1 << 62, r.integers(0, 1 + n // 8)).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if common and 100 * common >= 85 * (len(a) + len(b) - common):
                asked = neardup.Asked([(0, 0, len(a), neardup.odd_sketch(a))], 85)
                assert asked.pairs(np.array([1]), np.array([1]), np.array([len(b)]), [neardup.odd_sketch(b)], 9) == ([(0, 1)], set())


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 103), (102, 103)], "a long, b long")
    got = {x.node: x.component for x in neardup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[102] == got[103] == 100


def test_blocks_and_rounds(spark, monkeypatch):
    """Groups larger than a block, and links that only a second round finds."""
    r = random.Random(21)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(neardup, "FIRST_ACROSS", 1)
    monkeypatch.setattr(neardup, "HOMES", 2)
    base = prose(r, 60, 5000)
    texts = [edited(r, base, r.choice((0, 1, 1, 2, 2, 3))) for _ in range(150)]
    half = prose(r, 50, 5000)
    texts += [f"{half} {prose(r, 7, 5000)}" for _ in range(60)]
    wanted = brute_components(list(enumerate(texts)))
    assert len({c for _, c in wanted.values()}) > 5
    got = neardup.near_duplicates(docs(spark, texts)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == wanted


# ---- decontamination ----


def brute_tiles(item, doc, least):
    """Greedy string tiling as its definition has it."""
    free_i, free_d, out = [True] * len(item), [x >= 0 for x in doc], []
    while True:
        best = []
        longest = least
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_i[i + n] and free_d[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > longest:
                    best, longest = [(i, j, n)], n
                elif n == longest:
                    best.append((i, j, n))
        if not best:
            return out
        for i, j, n in best:
            if all(free_i[i : i + n]) and all(free_d[j : j + n]):
                free_i[i : i + n] = free_d[j : j + n] = [False] * n
                out.append((i, j, n))


def test_tiles():
    r = random.Random(6)
    for _ in range(300):
        item = [r.randrange(6) for _ in range(r.randint(1, 25))]
        doc = [r.choice((-1, r.randrange(6))) for _ in range(r.randint(0, 40))]
        if r.random() < 0.5 and len(item) > 8:
            doc += item[5:] + [-1] + item[:5]
        got, wanted = decontaminate.tiles(np.array(item), np.array(doc, np.int64), 3), brute_tiles(item, doc, 3)
        assert sorted(got) == sorted(wanted)
        assert max(Counter(i + k for i, _, n in got for k in range(n)).values(), default=1) == 1 == max(Counter(j + k for _, j, n in got for k in range(n)).values(), default=1)
        assert all(item[i + k] == doc[j + k] for i, j, n in got for k in range(n)) and all(n >= 3 for *_, n in got)


def test_repeated_words_stay_linear():
    import time

    words = "one and the same sentence again " * 4000
    block = decontaminate.Block([(1, words.encode()), (2, b"one and the same sentence"), (3, b"the end")])
    began = time.perf_counter()
    text = "x " + words * 4 + " the end"
    assert block.match(text.encode(), 0.5) == [(1, 24000, 24000, 1, 24000), (2, 5, 5, 1, 5), (3, 2, 2, 1, 2)]
    assert time.perf_counter() - began < 10


def test_decontamination(spark):
    r = random.Random(8)
    items = [prose(r, 30, 100_000) for _ in range(5)] + ["short one", None, "", "!!"]
    w = items[0].split()
    texts = [
        *ODD,
        f"{prose(r, 50, 100_000)} {items[0]} {prose(r, 50, 100_000)}",
        " ".join(w[20:] + ["x"] + w[10:20] + ["y"] + w[:10]),
        items[1].upper().replace(" ", ", "),
        " ".join(items[2].split()[:12]),
        f"a short one b {prose(r, 500, 100_000)}",
        prose(r, 500, 100_000),
    ]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    n = len(ODD)
    wanted = {(n, 0), (n + 1, 0), (n + 2, 1), (n + 4, 5)}
    for block in (20_000, 2):
        got = decontaminate.contaminated(docs(spark, texts), table, block_items=block)
        assert {(x.doc_id, x.item_id) for x in got.collect()} == wanted
    assert {x.doc_id for x in decontaminate.drop_contaminated(docs(spark, texts), table).collect()} == set(range(len(texts))) - {d for d, _ in wanted}
    assert decontaminate.contaminated(docs(spark, texts).limit(0), table).count() == 0
    assert decontaminate.contaminated(docs(spark, texts), table.limit(0)).count() == 0


def test_decontamination_by_row(spark):
    item = " ".join(f"b{i}" for i in range(25))
    rows = [(None, item), (None, "clean one"), (None, None), (3, item), (3, "clean two"), (4, item), (5, "clean one")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.drop_contaminated(d, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert kept.columns == d.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[2], rows[4], rows[6]], key=repr)


# ---- pipeline ----

CLASHES = ("gone", "_gone", "doc", "text_hash", "_hash", "n_lines", "N_Removed", "_row", "_row2", "first", "kept", "row", "side", "digest", "signature", "packed")


def test_clashing_columns(spark, tmp_path):
    """Columns of any name pass all stages as they are, with odd rows, repeated rows and rows without a doc_id."""
    import corpus_pipeline as c

    r = random.Random(3)
    texts = [*(prose(r, 40, 9000) + "\nmenu line here" for _ in range(14)), None, "", " \n", "a", "x" * 100_000]
    rows = [(i, t, "en", f"s{i % 12}", len(t or ""), *(f"{name}{i}" for name in CLASHES)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, *rows[1][1:]), (None, *rows[14][1:])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in CLASHES)
    d = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(0, "bench mark words of some length")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = d
    for name, f in c.STAGES[:-1]:
        now = f(spark, now, str(tmp_path))
        assert now.columns == d.columns, name
        found = now.collect()
        assert {x["doc_id"] for x in found} >= set(range(1, 14)) and all(x[k] == f"{k}{x['doc_id']}" for x in found if x["doc_id"] is not None for k in CLASHES)
        now = spark.createDataFrame(found, schema)
    assert {x.doc_id for x in c.packing(spark, now, "").collect()} >= set(range(1, 14))
    for _, f in c.STAGES:
        assert f(spark, d.limit(0), str(tmp_path)).count() == 0



def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    r = random.Random(11)
    base = [prose(r, 40, 9000) + "\nmenu line\n" + prose(r, 40, 9000) for _ in range(30)]
    texts = base + [edited(r, base[0], 1), base[1], prose(r, 3, 9000), "again and again so " * 30, base[2] + "\n" + "bench " + " ".join(f"b{i}" for i in range(25)), None]
    rows = [(i, t, "en", f"s{i % 12}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(f"b{i}" for i in range(25)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    assert [n for n, _ in c.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"] and c.ORACLE_SQL is None
    for name, f in c.STAGES[:-1]:
        out = f(spark, docs_, str(tmp_path))
        assert out.dtypes == docs_.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs_ = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x.doc_id: x for x in docs_.collect()}
    assert set(kept["quality"]) == set(range(30)) | {30, 31, 34}
    assert sum("menu line" in x.text.split("\n") for x in kept["lines"].values()) == 1 and all(x.n_chars == len(x.text) for x in kept["lines"].values())
    assert set(kept["near_duplicates"]) == set(range(30)) | {34}
    assert set(kept["decontamination"]) == set(range(30))
    assert {x.doc_id for x in c.run(spark, str(tmp_path)).collect()} == set(range(30))
