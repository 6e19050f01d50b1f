import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import periodic, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lyndon(s):
    """From each place to the next smaller suffix."""
    n = len(s)
    return [next((j for j in range(i + 1, n) if s[j:] < s[i:]), n) - i for i in range(n)]


def plain_runs(s, copies=4, least=6):
    """Every maximal stretch of every period, smallest periods first."""
    out, n = [], len(s)
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and s[k] == s[k + q]:
                k += 1
            length = k - i + q
            if length >= max(least, copies * q) and not any(
                    s[i:i + length - p] == s[i + p:i + length] for p in range(1, q)):
                out.append((i, length, q))
            i = max(k, i + 1) if k > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=500, deadline=None)
def test_lyndon_lengths_under_both_orders(s):
    assert periodic.lyndon_lengths(s) == plain_lyndon(s)
    assert periodic.lyndon_lengths([-c for c in s]) == plain_lyndon([-c for c in s])


@given(st.lists(st.sampled_from("aab"), max_size=60) | st.builds(
    lambda a, b, k, c: [*a, *(b * k)[:k * len(b) - 1], *c],
    st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("ab"), min_size=1,
                                                           max_size=5),
    st.integers(2, 9), st.lists(st.sampled_from("abc"), max_size=9)))
@settings(max_examples=800, deadline=None)
def test_runs_equal_brute_force(letters):
    assert periodic.find([c.encode() for c in letters]) == plain_runs(letters)


@given(st.lists(st.integers(0, 1), min_size=1, max_size=60))
@settings(max_examples=300, deadline=None)
def test_all_runs_of_two_copies(s):
    assert periodic.runs_of(np.array(s), 2, 2) == plain_runs(s, 2, 2)


def test_colliding_hashes_are_extended_word_by_word(monkeypatch):
    s = np.array([0, 1, 2] * 5 + [3, 4, 5, 6])
    monkeypatch.setattr(periodic, "extensions", lambda s, i, j: (i * 0, len(s) - j))
    assert periodic.runs_of(s) == [(0, 15, 3)]


def test_thue_morse_has_no_cubes():
    s = [bin(i).count("1") % 2 for i in range(1 << 12)]
    assert periodic.runs_of(np.array(s), 3, 3) == []


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_periodic_runs(spark, SF).collect()
    assert len(rows) == len(docs)
    found = 0
    for r in rows:
        words = planted(r.doc_id, docs[r.doc_id])
        code = {w: i for i, w in enumerate(dict.fromkeys(words))}
        runs = plain_runs([code[w] for w in words]) if len(words) < 3000 else periodic.find(
            [w.encode() for w in words])
        found += len(runs)
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == (
            (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert found > 5


def test_nulls_repeats_long_and_empty_tables(spark, docs_of, rows_of):
    long = "a b c " * 30_000
    docs = docs_of([(1, None), (2, " \n\t"), (None, "x x x x x x"), (3, "x x x x x"),
                    (4, long), (4, long), (5, "é é é é é é é z")])
    rows = sorted(rows_of(periodic.runs(docs)), key=lambda r: (r["doc_id"] or 0, r["n_words"]))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
           for r in rows]
    assert got == [
        (None, 6, [(0, 6, 1)], "x"), (1, 0, [], ""), (2, 0, [], ""), (3, 5, [], "x x x x x"),
        (4, 90_000, [(0, 90_000, 3)], "a b c"), (4, 90_000, [(0, 90_000, 3)], "a b c"),
        (5, 8, [(0, 7, 1)], "é z")]
    assert periodic.runs(docs.limit(0)).count() == 0
    assert rows_of(periodic.runs(spark.createDataFrame([(None, None)], "doc_id void, text void"))
                   )[0]["n_words"] == 0
