"""Word-cached use of a public word-level BPE tokenizer.

The tokenizer drops white space, and neither its normaliser nor its
pre-tokeniser joins anything across it. The ids of a text are therefore the
ids of its white-space-separated words, one after the other, and words can be
looked up instead of encoded again.

Most new words are Latin letters with punctuation behind them. Their letters
are encoded many at a time by a second tokenizer with the same merges but no
normaliser; ids that end a word tell the words apart again. All other words go
through the tokenizer as it is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Latin letters whose lower case is one letter that normal forms leave alone, then ASCII punctuation but the apostrophe.
PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
WORD_END = "</w>"
#: Words that the second tokenizer encodes as one text.
LINE = 200
#: Bytes of texts that are encoded together.
TOGETHER = 4 << 20
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class LetterEncoder:
    """Encodes words of letters with the merges of a tokenizer file, many at a time."""

    def __init__(self, model: dict):
        from tokenizers import Tokenizer, models, pre_tokenizers

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.tokenizer = Tokenizer(models.BPE(model["vocab"], merges, end_of_word_suffix=WORD_END, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith(WORD_END)]] = True
        self.alphabet = byte_alphabet()

    def encode(self, words: Sequence[str]) -> list[bytes]:
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(self.alphabet) for w in words]
        lines = [" ".join(shown[i : i + LINE]) for i in range(0, len(shown), LINE)]
        out: list[bytes] = []
        for line in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(line.ids, dtype="<u4")
            data, at = ids.tobytes(), 0
            for end in ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist():
                out.append(data[at:end])
                at = end
        if len(out) != len(words):
            raise ValueError("the vocabulary doesn't end each word with one id")
        return out


class WordCachedTokenizer:
    """``encode`` gives a text's ids as little-endian unsigned 32-bit bytes.

    Words are found, split into letters and punctuation, and told apart as
    Arrow arrays, so Python sees each distinct part once for some MB of text.
    ``plain_specials``: strings of special tokens in a text are ordinary text.
    At most ``most`` parts of words are kept; when there are more, the cache
    starts anew.
    """

    def __init__(self, path: str, plain_specials: bool = False, most: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if plain_specials:
            self.tokenizer.encode_special_tokens = True
        self.most = most
        self.parts: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.letters = LetterEncoder(config["model"]) if config["model"].get("end_of_word_suffix") == WORD_END and "Lowercase" in json.dumps(config["normalizer"]) else None

    def _encode_each(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ids_of(self, parts: list[str], letters: bool) -> list[bytes]:
        """The ids of words, or of the letters of words; those not known are learned together."""
        known = self.parts
        new = [p for p in parts if p not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = parts
        if new:
            known.update(zip(new, self.letters.encode(new) if letters else self._encode_each(new), strict=True))
        return [known[p] for p in parts]

    def _table(self, words: pa.StringArray) -> tuple[list[bytes], np.ndarray]:
        """(ids of parts, the two parts of each word); part 0 is empty."""
        pairs = np.zeros((len(words), 2), np.int64)
        table = [b""]

        def add(values: pa.Array, rows: np.ndarray, column: int, letters: bool) -> None:
            coded = values.dictionary_encode()
            pairs[rows, column] = coded.indices.to_numpy() + len(table)
            table.extend(self._ids_of(coded.dictionary.to_pylist(), letters))

        other = np.arange(len(words))
        if self.letters:
            found = pc.extract_regex(words, PLAIN)
            plain = found.is_valid().to_numpy(zero_copy_only=False)
            rows, other = np.flatnonzero(plain), np.flatnonzero(~plain)
            found = found.take(pa.array(rows))
            add(pc.utf8_lower(found.field("core")), rows, 0, True)
            add(found.field("tail"), rows, 1, False)
        add(words.take(pa.array(other)), other, 0, False)
        return table, pairs

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each one ends), for binary texts of some MB in all."""
        try:
            strings = pc.fill_null(texts.cast(pa.string()), "")
        except pa.ArrowInvalid:  # bytes that aren't UTF-8
            strings = pa.array([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
        split = pc.ascii_split_whitespace(strings)
        coded = split.flatten().dictionary_encode()
        table, pairs = self._table(coded.dictionary)
        ids = np.frombuffer(b"".join(table), "<u4")
        size = np.array([len(t) // 4 for t in table], np.int64)
        start = np.cumsum(size) - size
        parts = pairs[coded.indices.to_numpy()].ravel()
        length = size[parts]
        done = np.cumsum(length)
        total = int(done[-1]) if len(done) else 0
        out = ids[np.repeat(start[parts] - (done - length), length) + np.arange(total)]
        ends = 2 * (split.offsets.to_numpy()[1:] - split.offsets[0].as_py())
        return out, np.concatenate([[0], done])[ends]

    def encode(self, text: bytes | None) -> bytes:
        """The ids of one text, however long; it is cut at spaces."""
        rest, out = text or b"", []
        at = 0
        while at < len(rest):
            to = at + TOGETHER
            cut = next((m.start() for m in SPACE.finditer(rest, to)), len(rest)) if to < len(rest) else len(rest)
            out.append(self.encode_array(pa.array([rest[at:cut]], pa.binary()))[0].tobytes())
            at = cut
        return b"".join(out)

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each of some binary texts."""
        ids, ends = self.encode_array(texts)
        data, at, out = ids.tobytes(), 0, []
        for end in (4 * ends).tolist():
            out.append(data[at:end])
            at = end
        return out


def encoded_rows(batches: Iterator[pa.RecordBatch], tokenizer: WordCachedTokenizer) -> Iterator[tuple]:
    """(doc_id, ids) of each row, some MB of text at a time."""
    for batch in batches:
        ids, data = batch.column("doc_id"), batch.column("text")
        sizes = pc.fill_null(pc.binary_length(data), 0).to_pylist()
        at, held = 0, 0
        for to, size in enumerate([*sizes, None]):
            if to > at and (size is None or held + size > TOGETHER):
                if to == at + 1:
                    yield ids[at].as_py(), tokenizer.encode(data[at].as_py())
                else:
                    yield from zip(ids[at:to].to_pylist(), tokenizer.encode_many(data[at:to]), strict=True)
                at, held = to, 0
            held += size or 0


_loaded: dict[tuple, WordCachedTokenizer] = {}


def tokenizer_of(path: str, plain_specials: bool = False) -> WordCachedTokenizer:
    """One tokenizer for each worker process; its cache outlives a task."""
    key = (path, plain_specials)
    if key not in _loaded:
        _loaded[key] = WordCachedTokenizer(path, plain_specials)
    return _loaded[key]


def default_vocabulary() -> str:
    """The path of the 49k-word vocabulary where the public files are installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
