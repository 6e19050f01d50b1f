"""Counts over whole texts, worked out for a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import (
    SPACES,
    Texts,
    chunks,
    columns_of,
    mix,
    sum_by,
    window_hashes,
    word_hashes,
    words,
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_distinct_words", "n_same_as_last", "n_single", "n_upper", "n_digits", "n_marks")
WINDOW = 3


def _flags(chars: bytes) -> np.ndarray:
    f = np.zeros(256, bool)
    f[list(chars)] = True
    return f


SYMBOLS = _flags(b"#*$%&|<>")
UPPER = _flags(bytes(range(65, 91)))
DIGITS = _flags(b"0123456789")
MARKS = _flags(b"!?\"'()-/:;@[]\\^_`{}~+=")


def per_text(flags: np.ndarray, t: Texts) -> np.ndarray:
    return sum_by(flags, t.at)


def seen_again(keys: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def counts(t: Texts) -> dict[str, np.ndarray]:
    """Every count of COUNTS for each text."""
    w = words(t)
    n = w.per_text()
    h = word_hashes(t, w)
    out = {"n_words": n}
    letters = np.zeros(len(t.data), bool)
    heads = (t.data & 0xC0) != 0x80  # one byte of each code point
    edge = np.zeros(len(t.data) + 1, np.int8)
    edge[w.start] += 1
    np.add.at(edge, w.end, -1)
    np.cumsum(edge[:-1], out=edge[:-1], dtype=np.int8)
    letters = edge[:-1].astype(bool) & heads
    out["word_chars"] = per_text(letters, t)
    for name, flags in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_digits", DIGITS),
                        ("n_marks", MARKS)):
        out[name] = per_text(flags[t.data], t)
    heads_at = np.concatenate([[0], np.cumsum(heads)])
    out["n_single"] = np.bincount(w.text[heads_at[w.end] - heads_at[w.start] == 1],
                                  minlength=len(t))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    out["n_same_as_last"] = np.bincount(w.text[same], minlength=len(t))
    place = mix(w.text.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(mix(h + place), return_index=True)
    out["n_distinct_words"] = np.bincount(w.text[first], minlength=len(t))
    out["n_repeat_words"] = _repeated(h, w.text, place, len(t))
    lines, again = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    for i in range(len(t)):
        full = [x for x in t.raw(i).split(b"\n") if x.strip(SPACES)]
        lines[i], again[i] = len(full), len(full) - len(set(full))
    out["n_lines"], out["n_dup_lines"] = lines, again
    return out


def _repeated(h: np.ndarray, text: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Words inside windows that their text holds twice or more."""
    spans = window_hashes(h, WINDOW)
    whole = text[:len(spans)] == text[WINDOW - 1:] if len(spans) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    at = at[seen_again(mix(spans[at] + place[at]))] if len(at) else at
    inside = np.zeros(len(h), bool)
    for k in range(WINDOW):
        inside[at + k] = True
    return np.bincount(text[inside], minlength=n)


def count_batches(text_at: int, carried: int):
    """A batch function that puts the counts of column `text_at` after the first columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [counts(t) for t in chunks(b.column(text_at))]
            cols = [np.concatenate([*[p[c] for p in parts], np.zeros(0, np.int64)])
                    for c in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:carried], *[pa.array(c, pa.int64()) for c in cols]],
                names=[*b.schema.names[:carried], *COUNTS])

    return run


FIELDS = ", ".join(f"{c} bigint" for c in COUNTS)


def table(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text; null counts as empty."""
    source = columns_of(docs, "doc_id", "text")
    void = source.schema["doc_id"].dataType.simpleString() == "void"
    source = source.select(F.col("doc_id").cast("bigint") if void else F.col("doc_id"),
                           F.col("text").cast("string"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count_batches(1, 1), f"doc_id {kind}, {FIELDS}")


def beside(docs: DataFrame) -> DataFrame:
    """The columns of `docs` as c0, c1, ..., then the counts of its text."""
    given = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names).mapInArrow(
        count_batches(docs.columns.index("text"), len(names)), f"{given}, {FIELDS}")


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0D END"


# Sizes and shares of a text as SQL; none of them knows language, source or label.
RATIOS = {
    "log_words": "log1p(CAST(n_words AS DOUBLE))",
    "word_length": _share("word_chars", "n_words"),
    "symbols": _share("n_symbols", "word_chars"),
    "repeated": _share("n_repeat_words", "n_words"),
    "same_lines": _share("n_dup_lines", "n_lines"),
    "distinct": _share("n_distinct_words", "n_words"),
    "doubled": _share("n_same_as_last", "n_words"),
    "single": _share("n_single", "n_words"),
    "upper": _share("n_upper", "word_chars"),
    "digits": _share("n_digits", "word_chars"),
    "marks": _share("n_marks", "word_chars"),
    "line_words": _share("n_words", "n_lines"),
}


def labelled(rows: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """`rows` with a 0/1 label; rows without one, and labels that disagree, drop out."""
    known = columns_of(labels, "doc_id", column).filter(F.col(column).isin(0, 1)).groupBy(
        "doc_id").agg(F.min(column).alias("label"), F.max(column).alias("_max")).filter(
        F.col("label") == F.col("_max"))
    return rows.join(known.select("doc_id", "label"), "doc_id")
