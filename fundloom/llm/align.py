"""Alignment of two tokenizers' tokens over the same bytes.

Token ranges of a text are sorted and touch, so the starts and ends of the B
tokens are a static interval index: two bisections tell for each A token the
range of B tokens that it overlaps. Offsets that no token of either side spans
are the ends that both have; they cut the tokens into groups.

Both tokenizers always cut before a space or a line end that follows a visible
character: the patterns of A keep white space out of the end of a token, and no
piece of B holds a space behind another character or a line end. Between two
such cuts stands a unit, most often a word with its space, whose ids don't
depend on what stands around it. A worker tokenizes and aligns each unit once
and remembers it. Texts with other white space, or the sign that B has for a
space, are one unit.

Corpus-wide counts: documents are taken in blocks of some MB. A block's distinct
id pairs are counted once, summed over all blocks, and brought back to the
blocks that hold them, so what is shuffled are distinct pairs of blocks, not links.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import Scratch, materialise
from fundloom.llm.tokens import byte_alphabet

#: Bytes of text of a block; one longer text is a block of its own.
BLOCK = 4 << 20
#: Units that are tokenized as one text, and the longest of them.
TOGETHER, LONGEST = 2000, 1000
#: Units that a worker remembers, at most, in each of two generations.
REMEMBERED = 50_000
#: White space beyond ASCII, and the sign that stands for a space in pieces.
OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xe2\x96\x81")


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first B token that it overlaps, and the first behind those; tokens of both sides touch from offset 0 on."""
    a_starts, b_starts = (np.concatenate([[0], e[:-1]]) for e in (a_ends, b_ends))
    return np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")


class Unit:
    """What one unit's tokens say: numbers of tokens and groups, linked id pairs, and the groups as text."""

    __slots__ = ("groups", "n_a", "n_b", "n_groups", "pairs")

    def __init__(self, n_a: int, n_b: int, n_groups: int, pairs: np.ndarray, groups: bytes | None):
        self.n_a, self.n_b, self.n_groups, self.pairs, self.groups = n_a, n_b, n_groups, pairs, groups


#: A unit whose tokens don't give its bytes.
BROKEN = Unit(0, 0, 0, np.zeros(0, np.int64), None)


class Aligner:
    """Tokenizes and aligns units with the byte-level vocabulary at ``a_path`` and the pieces at ``b_path``."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            config = json.load(f)
        of_char = {c: b for b, c in byte_alphabet().items()}
        special = {t["id"] for t in config["added_tokens"]}
        vocab = config["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(of_char[c] for c in token)
        self.whole = Tokenizer.from_file(a_path)
        self.whole.encode_special_tokens = True
        # The same merges by rank, which are the ids: several times faster on short texts.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.short = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(self.a_bytes) if i not in special}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_b = self.pieces.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.pieces.id_to_piece(i)) for i in range(self.n_b))]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([str(i) for i in range(len(side))] for side in (self.a_bytes, self.b_bytes))
        self.young: dict[bytes, Unit] = {}
        self.old: dict[bytes, Unit] = {}

    def _tokens(self, text: str, short: bool) -> tuple[list[int], list[int]]:
        a = self.short.encode_ordinary(text) if short else self.whole.encode(text, add_special_tokens=False).ids
        return a, self.pieces.encode(text[1:])

    def _aligned(self, data: bytes, ends: np.ndarray, short: bool) -> list[Unit] | None:
        """The units of a text that begins with a space, or None where tokens don't give its bytes or cross a unit's end."""
        try:
            a, b = self._tokens(data.decode(), short)
        except UnicodeDecodeError:
            return None
        if b"".join([self.b_bytes[i] for i in b]) != data or b"".join([self.a_bytes[i] for i in a]) != data:
            return None
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        first, behind = overlaps(a_ends, b_ends)
        many = behind - first
        links = np.cumsum(many)
        at = np.arange(int(links[-1])) - np.repeat(links - many, many) + np.repeat(first, many)
        pairs = np.repeat(a_ids, many) * self.n_b + b_ids[at]
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_cuts, b_cuts = np.searchsorted(a_ends, cuts) + 1, np.searchsorted(b_ends, cuts) + 1
        last = np.searchsorted(cuts, ends)
        if not np.array_equal(cuts[np.minimum(last, len(cuts) - 1)], ends):
            return None
        a_text, b_text = [self.a_text[i] for i in a], [self.b_text[i] for i in b]
        groups, i, k = [], 0, 0
        for j, m in zip(a_cuts.tolist(), b_cuts.tolist(), strict=True):
            groups.append((a_text[i] if j == i + 1 else ",".join(a_text[i:j])) + "|" + (b_text[k] if m == k + 1 else ",".join(b_text[k:m])))
            i, k = j, m
        out = []
        g = i = k = n = 0
        for to, j, m, end in zip((last + 1).tolist(), a_cuts[last].tolist(), b_cuts[last].tolist(), links[a_cuts[last] - 1].tolist(), strict=True):
            out.append(Unit(j - i, m - k, to - g, pairs[n:end].copy(), ";".join(groups[g:to]).encode()))
            g, i, k, n = to, j, m, end
        return out

    def _alone(self, unit: bytes) -> Unit:
        # With " a" before it, as pieces always begin with a space, and one space alone has none.
        found = self._aligned(b" a" + unit, np.array([2, 2 + len(unit)]), len(unit) <= LONGEST)
        return found[-1] if found else BROKEN

    def learn(self, units: list[bytes]) -> list[Unit]:
        """Units in order; those that end in a visible character are tokenized together."""
        out: list[Unit | None] = [None] * len(units)
        plain = [k for k, u in enumerate(units) if len(u) <= LONGEST and (32 < u[-1] < 127 or u[-1] > 127) and (u.isascii() or not OTHER_SPACE.search(u))]
        for at in range(0, len(plain), TOGETHER):
            rows = plain[at : at + TOGETHER]
            parts = [b" a", *(units[k] for k in rows)]
            found = self._aligned(b"".join(parts), np.cumsum([len(p) for p in parts]), True)
            if found:
                for k, unit in zip(rows, found[1:], strict=True):
                    out[k] = unit
        return [u if u is not None else self._alone(units[k]) for k, u in enumerate(out)]

    def units(self, names: list[bytes]) -> list[Unit]:
        """Each unit, from memory or learned; the memory forgets what wasn't asked for in two generations."""
        young, old = self.young, self.old
        out = [young.get(n) or old.get(n) for n in names]
        new = [k for k, u in enumerate(out) if u is None]
        for k, unit in zip(new, self.learn([names[k] for k in new]), strict=True):
            out[k] = unit
        for n, u in zip(names, out, strict=True):
            if len(n) <= LONGEST:
                young[n] = u
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One aligner for each worker process; its memory outlives a task."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def cut_in_units(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(unit of each place, distinct units, first place of each text) of non-empty texts, a space before each."""
    data = b"".join([b" " + t for t in texts])
    size = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.cumsum(size) - size
    b = np.frombuffer(data, np.uint8)
    cut = np.zeros(len(b), bool)
    cut[1:] = ((b[1:] == 32) | (b[1:] == 10)) & (b[:-1] > 32) & (b[:-1] != 127)
    for k, t in enumerate(texts):
        if not t.isascii() and OTHER_SPACE.search(t):
            cut[start[k] : start[k] + size[k]] = False
    cut[start] = True
    at = np.flatnonzero(cut)
    offsets = np.append(at, len(b)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.searchsorted(at, start)


DOCS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, units binary, pairs array<long>, counts array<long>, starts binary"


def _blocks(a_path: str, b_path: str, digests: bool, counted: bool):
    """Over (doc_id, text): a row for each document and, if ``counted``, one for each block with its pairs, as ``DOCS``."""
    schema = pa.schema([("block", pa.int64()), *((n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("units", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("starts", pa.binary())])

    def block_rows(number: int, ids: list, texts: list) -> pa.RecordBatch:
        aligner = aligner_of(a_path, b_path)
        n = len(ids)
        numbers = np.zeros((4, n), np.int64)
        groups, codes_of, pairs_row = [""] * n, [None] * n, []
        some = [k for k, t in enumerate(texts) if t]
        if some:
            codes, names, first = cut_in_units([texts[k] for k in some])
            units = aligner.units(names)
            table = np.array([(u.n_a, u.n_b, u.n_groups, len(u.pairs), u.groups is None) for u in units], np.int64)
            broken = np.add.reduceat(table[codes, 4], first) > 0
            for c in range(4):
                numbers[c, some] = np.where(broken, 0, np.add.reduceat(table[codes, c], first))
            written = [u.groups for u in units]
            ends = np.append(first[1:], len(codes))
            good = np.repeat(~broken, ends - first)
            for k, i, j, bad in zip(some, first.tolist(), ends.tolist(), broken.tolist(), strict=True):
                if not bad:
                    joined = b";".join([written[c] for c in codes[i:j].tolist()])
                    groups[k] = hashlib.sha256(joined).hexdigest() if digests else joined.decode()
                    codes_of[k] = codes[i:j].astype("<i4").tobytes() if counted else None
            if counted and good.any():
                times = np.bincount(codes[good], minlength=len(units))
                every = np.concatenate([u.pairs for u in units])
                pairs, of = np.unique(every, return_inverse=True)
                counts = np.bincount(of, np.repeat(times, table[:, 3]), len(pairs)).astype(np.int64)
                starts = np.append(0, np.cumsum(table[:, 3])).astype("<i4")
                pairs_row = [(pairs, counts, starts.tobytes(), of.astype("<i4").tobytes())]
        more = len(pairs_row)
        columns = [
            pa.array([number] * (n + more), pa.int64()), pa.array(ids + [None] * more, pa.int64()),
            *(pa.array(np.append(x, [0] * more)) for x in numbers), pa.array(groups + [None] * more, pa.string()),
            pa.array(codes_of + [r[3] for r in pairs_row], pa.binary()), pa.array([None] * n + [r[0] for r in pairs_row], pa.list_(pa.int64())),
            pa.array([None] * n + [r[1] for r in pairs_row], pa.list_(pa.int64())), pa.array([None] * n + [r[2] for r in pairs_row], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if ids and size + len(text or b"") > BLOCK:
                    yield block_rows(number, ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(text)
                size += len(text or b"") + 50
        if ids:
            yield block_rows(number, ids, texts)

    return run


def _vocabularies(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def token_groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups): groups as ``a1,a2|b1;a3|b2,b3``, by A and B ids in order.

    Cases are those of ``aligned``; a text without tokens has empty groups.
    """
    return _texts(docs).mapInArrow(_blocks(*_vocabularies(a_path, b_path), False, False), DOCS).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of one block, with the counts of its pairs in ``right``."""
    docs = left.filter(pc.is_null(left.column("starts")))
    own = left.filter(pc.is_valid(left.column("starts")))
    best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    if len(own):
        starts = np.frombuffer(own.column("starts")[0].as_py(), "<i4")
        of = np.frombuffer(own.column("units")[0].as_py(), "<i4")
        at = right.column("at").to_numpy()
        scores = np.zeros((2, int(at.max()) + 1), np.int64)
        scores[0, at], scores[1, at] = right.column("best").to_numpy(), right.column("count").to_numpy()
        by_unit = [np.diff(np.append(0, np.cumsum(s[of]))[starts]) for s in scores]
        for k, codes in enumerate(docs.column("units").to_pylist()):
            if codes:
                c = np.frombuffer(codes, "<i4")
                best[k], total[k] = by_unit[0][c].sum(), by_unit[1][c].sum()
    names = [c.split()[0] for c in SCORED.split(", ")]
    columns = [*(docs.column(c) for c in names[:5]), pa.array(best), pa.array(total), docs.column("groups")]
    return pa.table(columns, names=names)


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row a document: tokens, groups and links of two tokenizers, and how its links rank in the corpus.

    A link is an A and a B token that overlap. The count of an id pair is the
    number of links of the whole table that hold it; ``n_best`` are links whose
    count is the highest of their B id, ties included, ``count_sum`` is over all links.

    Null and empty texts, and texts that the tokens of one side don't give back
    byte by byte, have no tokens: numbers are zero and ``groups_sha256`` is
    empty. Strings of special tokens are plain text. Texts are taken whole, a
    long one as a block of its own. Repeated rows count each; an empty table
    gives no rows; other columns are ignored.
    """
    spark, (a_path, b_path) = docs.sparkSession, _vocabularies(a_path, b_path)
    n_b = aligner_pieces(b_path)
    with Scratch(spark, "align") as scratch:
        blocks = scratch.table(_texts(docs).mapInArrow(_blocks(a_path, b_path, True, True), DOCS), "blocks")
        held = blocks.where("pairs IS NOT NULL")
        counted = held.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
        total = scratch.table(counted.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
        # One row for each id of B's vocabulary at most.
        highest = total.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("count").alias("highest"))
        ranked = total.join(F.broadcast(highest), F.col("pair") % n_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
        places = held.select("block", F.posexplode("pairs").alias("at", "pair"))
        scores = places.join(ranked.hint("merge"), "pair").select(F.col("block").alias("of_block"), "at", "count", "best")
        left = blocks.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "units", "starts")
        return materialise(left.groupBy("block").cogroup(scores.groupBy("of_block")).applyInArrow(_scored, SCORED), "aligned")


def aligner_pieces(b_path: str) -> Column:
    """The size of B's vocabulary, as a literal."""
    import sentencepiece

    return F.lit(sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())
