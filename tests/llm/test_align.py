"""Alignment against tokenizers on whole texts and plain loops over all token pairs."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fundloom.llm import align, queries
from fundloom.llm.tokens import byte_alphabet

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    """(ids, bytes) of the A and B tokens of a whole text."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    of_char = {c: x for x, c in byte_alphabet().items()}
    with open(A_PATH, encoding="utf-8") as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(of_char[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        same = b"".join(x for _, x in left) == want == b"".join(x for _, x in right)
        return (left, right) if same else ([], [])

    return tokens


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(texts, tokens):
    links, rows = {}, {}
    for k, text in texts:
        a, b = (spans(side) for side in tokens(text))
        links[k] = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        cuts = sorted({e for *_, e in a} & {f for *_, f in b})
        groups = []
        for s, e in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for i, x, y in side if s <= x and y <= e) for side in (a, b)))
        rows[k] = (len(a), len(b), len(groups), len(links[k]), ";".join(groups))
    count = Counter(p for x in links.values() for p in x)
    high = defaultdict(int)
    for (_, j), n in count.items():
        high[j] = max(high[j], n)
    return {k: (*rows[k][:4], sum(count[p] == high[p[1]] for p in links[k]), sum(count[p] for p in links[k]), hashlib.sha256(rows[k][4].encode()).hexdigest() if links[k] else "") for k, _ in texts}, {k: r[4] for k, r in rows.items()}


SPECIAL = ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "a▁b", "don't", "it's've", "  ", "   ", "\n", "\n\n", " \n ", "\t", "\r\n", ";\r\n", " ", " x", "　", " ", "é", "é", "ﬁ", "漢字", "😀", "👩‍👩", "“q”", "​", "\x00", "\x1f", "\x7f", "0123456789", "12,345.67", "ÀÉÎ", "straße", "----", "____", "{}();", "\x85"]


def random_texts(rng, n):
    words = ["the", "data", "Über", "naïve", "tokenizers", "abc123", "x", "ing", "l'été", "Größe"]
    out = []
    for _ in range(n):
        parts = [rng.choice(SPECIAL) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(12))]
        out.append("".join(p + rng.choice([" ", "", " ", "\n"]) for p in parts))
    return out


def test_against_all_token_pairs(spark, whole, monkeypatch):
    rng = random.Random(12)
    texts = [None, "", " ", "\n", "  a  b\n", *SPECIAL, *random_texts(rng, 250), "same text here.", "same text here.", " ".join(random_texts(rng, 400))]
    rows = list(enumerate(texts))
    want, groups = brute(rows, whole)
    docs = spark.createDataFrame([(k, t, "n", 7) for k, t in rows], "doc_id long, text string, block string, n_a int").repartition(5)
    got = {r.doc_id: r for r in align.aligned(docs).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        r = got[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, repr(texts[k])
    assert sum(w[0] == 0 for w in want.values()) > 4 and sum(w[3] > w[0] for w in want.values()) > 100
    assert {r.doc_id: r.groups for r in align.token_groups(docs).collect()} == groups


def test_units_alone_and_together(whole):
    """A memory of few units, and small batches, change nothing."""
    rng = random.Random(13)
    aligner = align.Aligner(A_PATH, B_PATH)
    for text in random_texts(rng, 400):
        data = text.encode()
        if not data:
            continue
        codes, names, _ = align.cut_in_units([data])
        assert b"".join(names[c] for c in codes) == b" " + data
        units = aligner.units(names)
        if all(u.groups is not None for u in units):
            assert b";".join(units[c].groups for c in codes).decode() == brute([(0, text)], whole)[1][0]
        else:
            assert whole(text) == ([], [])


def test_small_blocks_and_short_memory(spark, whole, monkeypatch):
    """Blocks of one text, in tasks of this process, and a memory that forgets."""
    monkeypatch.setattr(align, "BLOCK", 100)
    monkeypatch.setattr(align, "REMEMBERED", 3)
    texts = random_texts(random.Random(14), 60)
    rows = list(enumerate(texts))
    want, groups = brute(rows, whole)
    aligner = align.Aligner(A_PATH, B_PATH)
    for k, t in rows:
        if t and want[k][0]:
            codes, names, _ = align.cut_in_units([t.encode()])
            units = aligner.units(names)
            assert b";".join(units[c].groups for c in codes).decode() == groups[k]
    assert len(aligner.young) <= 3 + max(len(t) for t in texts)


def test_long_and_empty(spark, whole):
    rng = random.Random(15)
    rows = [(1, "word " * 30_000), (2, "x" * 20_000), (3, " " * 5_000), (4, None), (None, "a b")]
    got = {r.doc_id: r for r in align.aligned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        a, b = whole(t)
        assert (got[k].n_a, got[k].n_b) == (len(a), len(b))
    assert got[4].groups_sha256 == "" and rng
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned(empty).count() == 0 and align.token_groups(empty).count() == 0
    assert align.aligned(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].n_a == 0


def test_query_on_documents(spark, whole):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [(k, t) for k, t in rows]
    got = queries.op12_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert found.keys() == {k for k, _ in rows}
    # All pairs of tokens of long texts take too long; ranges that touch are walked instead.
    links, rest = {}, {}
    for k, t in rows:
        a, b = (spans(side) for side in whole(t))
        out, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            m = j
            while m < len(b) and b[m][1] < e:
                out.append((i, b[m][0]))
                m += 1
        links[k], rest[k] = out, (len(a), len(b), len({e for *_, e in a} & {f for *_, f in b}), len(out))
    count = Counter(p for x in links.values() for p in x)
    high = defaultdict(int)
    for (_, j), n in count.items():
        high[j] = max(high[j], n)
    for k, _ in rows:
        assert found[k][:6] == (*rest[k], sum(count[p] == high[p[1]] for p in links[k]), sum(count[p] for p in links[k]))
