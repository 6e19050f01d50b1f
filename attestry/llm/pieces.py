"""SentencePiece encoding and decoding by a table of last tokens, one per prefix.

The vocabulary's merges join any two neighbours whose concatenation is a piece, best score
first, leftmost of equal scores. Such an encoding is valid exactly if all neighbouring tokens
are: two tokens are compatible if their joined text encodes to just these two. So each prefix
of a text has one last token, found without merging the text:

1. An automaton over all pieces yields the pieces that end at each place.
2. Of these, the one that is compatible with the last token of the prefix before it is stored
   for the prefix. Tests are remembered, as are the pieces that do not encode to themselves.
3. From the end backwards, the table names the tokens.

A character without a piece stands alone and becomes its UTF-8 bytes. No piece of the
vocabulary holds a space mark after another character (checked on loading), so a text falls
into words, each encoded once and remembered; words above `LONG_WORD` characters are not kept.

Null text counts as empty: begin and end id only. Any column but the text may be null, rows
may repeat; each row is encoded on its own. An empty table gives an empty result. Further
columns are ignored. Only models with byte pieces, a dummy prefix and no other normalisation
are read; others raise ValueError.
"""

from __future__ import annotations

import codecs
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import columns_of

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHED_WORDS, CACHED_PAIRS, LONG_WORD = 600_000, 2_000_000, 64
ALONE = -1  # a character without a piece


class Pieces:
    """The pieces of a model, its automaton and the tests remembered so far."""

    def __init__(self, model: str):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.text, self.score, self.byte_id, self.raw = [], [], {}, []
        self.id_of: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.text.append(piece)
            self.score.append(sp.get_score(i))
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.id_of[piece] = i
                self.raw.append(piece.replace(SPACE, " ").encode())
        if len(self.byte_id) < 256 or any(
                sp.normalize(x) != self.normal(x)
                for x in ("", " ", "a  b ", "\n\t　 ", "ﬁＡé", "\x01A")):
            raise ValueError(f"{model}: byte pieces and plain normalisation expected")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of):
            raise ValueError(f"{model}: a piece holds a space mark after another character")
        self.size = [len(p) for p in self.text]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        apart = re.escape("".join(c for c in "\n\t\r" if c not in self.id_of))
        alone = f"[{apart}]|" if apart else ""
        self.parts = re.compile(f"{alone}{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+")
        # What may follow each token; the last row is that of ALONE.
        self.after: list[dict[int, bool]] = [{} for _ in range(len(self.text) + 1)]
        self.tested = 0
        self.words: dict[str, bytes] = {}

    @staticmethod
    def normal(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """The text merged step by step; only ever called on two tokens."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; a = ALONE: whether b stands by itself."""
        if self.tested >= CACHED_PAIRS:
            for row in self.after:
                row.clear()
            self.tested = 0
        two = [self.text[b]] if a == ALONE else [self.text[a], self.text[b]]
        joined = "".join(two)
        # Two tokens whose concatenation is a piece would have been merged.
        known = (a == ALONE or joined not in self.id_of) and self.merged(joined) == two
        self.after[a][b] = known
        self.tested += 1
        return known

    def last_tokens(self, s: str) -> list[int]:
        """The last token of each prefix of s, ALONE for a character without a piece."""
        last, after = [ALONE] * (len(s) + 1), self.after
        for end, (token, size) in self.automaton.iter(s):
            if last[end + 1] == ALONE:
                before = last[end + 1 - size]
                fits = after[before].get(token)
                if self.compatible(before, token) if fits is None else fits:
                    last[end + 1] = token
        return last

    def tokens(self, s: str) -> list[int]:
        last, out, at = self.last_tokens(s), [], len(s)
        while at:
            token = last[at]
            if token == ALONE:
                out += [self.byte_id[x] for x in reversed(s[at - 1].encode())]
                at -= 1
            else:
                out.append(token)
                at -= self.size[token]
        return out[::-1]

    def word(self, s: str) -> bytes:
        """Ids of a word not remembered yet."""
        ids = _packed(self.tokens(s))
        if len(s) <= LONG_WORD:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[s] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers, with begin and end id."""
        words, known = self.parts.findall(self.normal(text)), self.words.get
        return b"".join([_packed([self.begin]), *[known(w) or self.word(w) for w in words],
                         _packed([self.end])])

    def decode(self, ids: bytes) -> str:
        """The pieces joined; bytes that are no UTF-8 become one U+FFFD each."""
        parts = [self.raw[i] for i in np.frombuffer(ids, "<u4").tolist()]
        text = b"".join(parts).decode("utf-8", "one_by_one")
        first = next((p for p in parts if p), b"")
        return text[1:] if first.startswith(b" ") and first[1:2] != "⁇".encode()[:1] else text


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


def _one_by_one(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("one_by_one", _one_by_one)


@lru_cache(maxsize=2)
def pieces_of(model: str) -> Pieces:
    return Pieces(model)


def _with_id(docs: DataFrame, *names: str) -> tuple[DataFrame, str]:
    source = columns_of(docs, "doc_id", *names)
    kind = source.schema["doc_id"].dataType.simpleString()
    if kind == "void":
        source, kind = source.withColumn("doc_id", F.col("doc_id").cast("bigint")), "bigint"
    return source, kind


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every text."""
    source, kind = _with_id(docs, "text")
    source = source.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                ids = [pieces.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids and text of encoded rows; null ids count as none."""
    source, kind = _with_id(encoded, "ids")
    source = source.withColumn("ids", F.col("ids").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                text = [pieces.decode(x.as_py() or b"") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    return source.mapInArrow(run, f"doc_id {kind}, ids binary, text string")
