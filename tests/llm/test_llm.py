"""The operators of ``fundloom.llm`` on small and awkward tables, against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fundloom.llm import decontaminate, licences, linedup, media, packing, quality, queries, simhash, tokencount, tokens, toxicity, warc, webp
from fundloom.llm.components import connected_components

RUN = "\n".join(f"line {i} of a passage with quite a few words in it" for i in range(8))
TEXTS = [None, "", "   \n\t ", "A", "the the", "x " * 3000, RUN, RUN + "\nown end", "intro\n" + RUN, RUN, "É漢字 ὀδός 🙂 end", "Released under the MIT License."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src", "en", 0, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, "clash", 2), (3, "A", "src", "en", 1, "clash", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, Simhash_FP string, linedup_doc int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(12)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def test_word_cache_equals_tokenizer():
    import pyarrow as pa

    t = tokenizer()
    odd = ["it's Don'T 2² ½x ªb İstanbul ǅ é école <|endoftext|>x a_b 12,345.67 ... ß ẞ ÷ø x​z 漢字 \x1fq\x85r a\x00b ''s", *[x or "" for x in TEXTS]]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd]
    for most in (250_000, 3):
        own = tokens.WordCachedTokenizer(tokens.default_vocabulary(), most=most)
        assert own.encode_many(pa.array([x.encode() for x in odd], pa.binary())) == want
        assert [own.encode(x.encode()) for x in odd] == want


def test_token_counts(docs, empty, spark, tmp_path):
    t = tokenizer()
    t.encode_special_tokens = True
    want = sorted((str(r.doc_id), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    for block in (1 << 18, 7):  # documents lie across blocks
        got = tokencount.token_counts(docs, block_ids=block).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want and all(r.complete for r in got)
    tokencount.write_token_files(docs, f"file://{tmp_path}/flat")
    got = tokencount.count_token_files(spark, f"file://{tmp_path}/flat", block_ids=5).collect()
    assert sorted(r.n_tokens for r in got) == sorted(n for _, n in want)
    (tmp_path / "open.bin").write_bytes(np.array([5, tokencount.END_ID, 6, 7], "<u2").tobytes())
    assert [(r.start, r.n_tokens, r.complete) for r in tokencount.count_token_files(spark, f"file://{tmp_path}/open.bin").orderBy("start").collect()] == [(0, 1, True), (2, 2, False)]
    assert tokencount.token_counts(empty).count() == 0


def test_quality(docs, empty, labels, spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["good" if rng.random() < g / 4 else "bad" for _ in range(40)]), int(g)) for i, g in enumerate(rng.integers(0, 4, 800))]
    d = spark.createDataFrame(rows, "doc_id long, text string, g int")
    got = quality.quality(d, d.select("doc_id", F.col("g").alias("grade")), cut=2).join(d.select("doc_id", "g"), "doc_id").where("held_out").toPandas()
    assert np.corrcoef(got.expected_grade, got.g)[0, 1] > 0.9 and ((got.tail_probability >= 0.5) == (got.g >= 2)).mean() > 0.9
    ratings = labels.select("doc_id", F.col("quality").alias("grade"))
    assert quality.quality(docs, ratings).count() == docs.count()
    assert quality.quality(empty, ratings).count() == 0
    assert {r.expected_grade for r in quality.quality(docs, ratings.where("false")).collect()} == {0.0}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_contamination(texts, items):
    patterns = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            patterns[tuple(w[k : k + 10])].add(str(i))
    for t in texts:
        w, hit, found = words(t), set(), set()
        for p, names in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= names
        yield len(w), len(hit), sorted(found)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, empty, pass_bytes):
    items = [(1, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "short one"), (3, ""), (4, None), (12, "Short  ONE!"), (5, "b b b b b b b b b b b")]
    rng = np.random.default_rng(1)
    texts = [*TEXTS, "x w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 y", "a short one here", "b " * 30, *(" ".join(f"w{k}" for k in rng.integers(0, 12, 50)) for _ in range(20)), "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w0"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(d, b, pass_bytes=pass_bytes).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute_contamination(texts, items))
    assert decontaminate.decontaminate(empty, b).count() == 0
    assert decontaminate.clean_of_benchmark(docs, b.where("false")).count() == docs.count()


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprints(docs):
    got = docs.select("text", simhash.fingerprint(F.col("text")).alias("fp")).collect()
    assert all(r.fp & (2**64 - 1) == brute_fingerprint(r.text) for r in got)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_near_links_against_all_pairs(spark, bucket):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(20, rng.integers(0, 4), replace=False)) for b in base for _ in range(8)})
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket=bucket)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert all(got.get(f, f) == root(f) for f in fps)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7, 24, 31])
def test_bit_sliced_comparison_at_any_radius(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 34), replace=False)) for b in base for _ in range(45)], np.uint64)
    query = np.repeat(np.arange(len(fps)), 3)
    mask = simhash.within_radius(fps, query, np.tile(np.arange(3), len(fps)), radius).reshape(-1, 3)
    for i, a in enumerate(fps):
        for j, b in enumerate(fps):
            assert bool(int(mask[i, j // 64]) >> (j % 64) & 1) == ((int(a) ^ int(b)).bit_count() <= radius)


def test_near_duplicates_of_awkward_rows(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count() and {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in got if r.doc_id in (6, 9)} == {6}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id in (0, 1, 2, 3, 6, 9)) == [0, 3, 6]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 53
    assert connected_components(links.where("false")).count() == 0


def test_toxicity(docs, empty, labels, spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 60)) + (" you 1d1оt" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(d, d.select("doc_id", "toxic")).join(d.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.toxic).all() and got.score.between(0, 1).all()
    assert toxicity.fold("1D1ОT!!  ｉｄｉｏｔ").split() == ["idiot", "idiot"]
    m = toxicity.Matcher({"trash": 3.0}, ("trash can",))
    assert m.features("the trash can") == (0.0,) * 4 and m.features("you trash")[0] > 0
    for few in (labels, labels.where("false")):
        assert toxicity.toxicity(docs, few).where("score IS NULL").count() == 0
        assert toxicity.toxicity(empty, few).count() == 0
        assert toxicity.not_toxic(docs, few).columns == docs.columns


def test_packing(docs, empty):
    t = tokenizer()
    for capacity, piece in ((2048, 512), (16, 8)):
        got = packing.pack_documents(docs.where("doc_id IS NULL OR doc_id <> 3"), capacity, piece).toPandas()
        for i, text in enumerate(TEXTS):
            if i == 3:
                continue
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
            own = got[got.doc_id == i].sort_values("start")
            assert own.start.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
            assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32))
        for _, g in got.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert g.offset.tolist() == np.cumsum([0, *g.length[:-1]]).tolist() and g.length.sum() <= capacity
    assert packing.pack_documents(empty).count() == 0
    sums = [s for s, _ in packing.pack_group([8, 7, 6, 5, 4], 16)]
    assert sorted(sums) == [14, 16] and sum(s for s, _ in packing.pack_group([9, 9, 9], 16)) == 27


def test_warc(spark, tmp_path):
    big = "ü" * 600
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "e", None), (6, "w", "WARC/1.0\r\nfake\r\n\r\n" * 60), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[2].refers_to) == ("revisit", 2, "response", None)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert got[None].record_type == "revisit" and got[4].record_type == "response"
    assert warc.archive_round_trip(pages.where("false")).count() == 0
    for compress in (True, False):
        warc.write_archives(warc.with_revisits(pages).coalesce(1), f"file://{tmp_path}/{compress}", compress=compress)
        (file,) = (tmp_path / str(compress)).glob("*.txt")
        data = file.read_bytes()
        whole = [s for s in warc.salvage(data) if s.kind == "record"]
        assert len(whole) == 7
        at = whole[3].offset + 12
        hurt = b"junk" + data[:at] + b"\xff\xff\xff" + data[at + 3 :]
        parts = list(warc.salvage(hurt))
        assert len([s for s in parts if s.kind == "record"]) == 6 and [s.kind for s in parts].count("gap") == 2
        (tmp_path / f"hurt-{compress}").mkdir()
        (tmp_path / f"hurt-{compress}/a.bin").write_bytes(hurt)
        got = warc.read_archives(spark, f"file://{tmp_path}/hurt-{compress}", compress).orderBy("offset").collect()
        assert sorted((r.offset, r.kind, r.gap_bytes) for r in got) == sorted((s.offset, s.kind, None if s.kind == "record" else s.length) for s in parts)
        with pytest.raises(Exception, match="a gap of"):
            warc.measured(warc.read_archives(spark, f"file://{tmp_path}/hurt-{compress}", compress, False)).collect()


def test_line_dedup(docs, empty, spark):
    got = {r.doc_id: r for r in linedup.without_repeats(docs).where("doc_id IS NOT NULL").collect()}
    assert got[6].text == RUN and got[7].text == "own end" and got[8].text == "intro" and got[9].text == "" and got[0].text is None
    assert got[7].n_deleted == 8 and got[7].n_chars == 7 and got[11].text == TEXTS[11]
    assert linedup.without_repeats(docs).count() == docs.count() and linedup.without_repeats(empty).count() == 0
    inside = spark.createDataFrame([(1, RUN + "\n" + RUN)], "doc_id long, text string")
    assert linedup.without_repeats(inside).first().text == RUN
    short = spark.createDataFrame([(i, "a few words\nand no more") for i in range(3)], "doc_id long, text string")
    assert linedup.without_repeats(short).where("n_deleted > 0").count() == 0


def test_licences(spark, docs, empty):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c.py", "code only"), (3, "a/b/d.py", f"code here and there, a lot of it, all of it our own. {gpl}"), (4, "e.py", "nothing"), (5, None, None), (6, "a/b/COPYING", gpl), (7, "a/z.py", ""), (7, "a/z.py", "")]
    f = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.origin, r.licensed_by) for r in licences.scan_licences(f).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("GPL-3.0", "own", None), 4: (None, "none", None), 5: (None, "none", None), 6: ("GPL-3.0", "own", None), 7: ("MIT", "inherited", "a")}
    assert licences.scan_licences(f).count() == 8 and licences.scan_licences(f.where("false")).count() == 0
    assert licences.scan_licences(docs.select("doc_id", licences.corpus_path(docs).alias("path"), "text")).count() == docs.count()


def test_media(docs, empty):
    got = media.media_round_trip(docs).collect()
    assert len(got) == docs.count() and media.media_round_trip(empty).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, text in enumerate(TEXTS):
        data = (text or "").encode()
        data += b" " * (-len(data) % 192 if data else 192)
        assert (by[i].payload_bytes, by[i].payload_sha256, by[i].tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert by[6].media_sha256 == by[9].media_sha256 and by[6].feature == by[9].feature
    rng = np.random.default_rng(4)
    for data in (rng.integers(0, 256, 192 * 30, dtype=np.uint8).tobytes(), b"ab" * 96 * 200, bytes(192)):
        assert webp.decode_payloads([webp.encode_payload(data)])[0].tobytes() == data


def test_damaged_media_are_told(spark):
    rows = spark.createDataFrame([(1, bytearray(b"RIFF1234WEBPVP8Lxx")), (2, None), (3, bytearray(b""))], "id int, media binary")
    got = {r.id: r.error for r in media.decode_media(rows).collect()}
    assert got[1] and got[2] is None and got[3] is None


def test_queries_have_names_by_number():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
