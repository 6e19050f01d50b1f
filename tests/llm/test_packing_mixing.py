import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestry.llm import mixing, packing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ids(b: bytes):
    return list(struct.unpack(f"<{len(b) // 4}I", b))


def test_ids_equal_the_reference_tokenizer(spark, reference):
    enc = packing.encoder(packing.VOCABULARY)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "  a  b", "a \n b", "　x y　 z", "<|endoftext|> a", "a <|endoftext|>b", "x<|endoftext|><|endoftext|>", "<|endoftext", "it's o'clock's",
              "a\x00b c", "x" * 5000, " " * 3000 + "q", "a\x1c b", "tab\t x", "퟿ é  ñ", "1 22  333"]
    for text in texts:
        assert ids(enc.ids(text)) == reference(text), repr(text[:50])


@given(st.text(alphabet=" \n\t 　\x1fab1'é!ß中́", max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_equal_on_odd_spacing(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(
        test_ids_equal_on_odd_spacing, "t") else test_ids_equal_on_odd_spacing.t
    test_ids_equal_on_odd_spacing.t = t
    assert ids(packing.encoder(packing.VOCABULARY).ids(text)) == t.encode(
        text, add_special_tokens=False).ids


def test_added_tokens_have_their_own_id(reference):
    enc = packing.encoder(packing.VOCABULARY)
    assert ids(enc.ids("<|endoftext|> a")) == reference("<|endoftext|> a")
    assert 50256 in ids(enc.ids("a b<|endoftext|>c d")) and 50256 not in ids(enc.ids("a endoftext"))


def test_only_long_documents_are_cut():
    assert list(packing.cut(1, 4)) == [(0, 1)]
    assert list(packing.cut(4, 4)) == [(0, 4)]
    assert list(packing.cut(10, 4)) == [(0, 2), (2, 4), (6, 4)]


def plain_best_two_fit(counts, capacity):
    """One bin at a time, without repeating bins."""
    free = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
    bins = []
    while free:
        bin_, gap = [], capacity
        for s in list(free):
            if s <= gap:
                bin_.append(s)
                free.remove(s)
                gap -= s
        if gap and len(bin_) > 1:
            small = bin_[-1]
            best = max(((a + b, a, b) for i, a in enumerate(free) for b in free[i + 1:]
                        if a + b <= gap + small), default=None)
            if best and best[0] > small:
                bin_[-1:] = list(best[1:])
                free.remove(best[1])
                free.remove(best[2])
                free.append(small)
                free.sort(reverse=True)
        bins.append(sorted(bin_))
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_two_fit_bin_by_bin(seed):
    rng = random.Random(seed)
    counts = {s: rng.randint(1, 9) for s in rng.sample(range(1, 41), rng.randint(1, 14))}
    plan = packing.best_two_fit(counts, 40)
    got = [sum(b) for n, b in plan for _ in range(n)]
    packed = defaultdict(int)
    for n, b in plan:
        assert sum(b) <= 40
        for s in b:
            packed[s] += n
    assert packed == counts
    assert sorted(got) == sorted(sum(b) for b in plain_best_two_fit(counts, 40))


def test_swap_fills_the_gap_better():
    # 6 + 3 leaves 1; the 3 makes way for 2 + 2, which fit its gap of 4.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])
    assert packing.best_pair(np.array([0, 0, 1, 0]), 1, 4) == (0, 0)  # one piece is no pair


def test_packed_pieces_are_gapless_and_whole(docs_of, rows_of, reference):
    texts = ["", None, "a b c", "word " * 3000, "zz", "zz", "x" * 300] + [
        "some text " * k for k in range(1, 60)]
    rows = rows_of(packing.pack(docs_of([*enumerate(texts), (None, "zz"), (4, "zz")])))
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    for i, text in enumerate(texts):
        if i == 4:
            continue
        whole = [*reference(text or ""), 2]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert sum(p["length"] for p in parts) == len(whole)
        assert all(p["length"] == 1024 for p in parts[1:])
        for p in parts:
            own = whole[p["start"]:p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
    assert len(by_doc[4]) == 2 and len(by_doc[None]) == 1


def test_packing_nothing(docs_of):
    assert packing.pack(docs_of([])).count() == 0


def expected_targets(size):
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target = 1.5 * sum(size.values()), {}
    open_ = set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * size[s]}
        for s in full or open_:
            target[s] = 2 * size[s] if full else weight[s] * level
            left -= target[s] if full else 0
        open_ -= full or open_
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_its_targets(docs_of, rows_of, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 7, 20, 90]))),
             rng.choice(["a", "b", "B", "é", "ä", None, "c"]) if i > 5 else "a")
            for i in range(400)]
    rows += [(7, None, "b"), (8, "x y", "b"), (8, "x y", "b"), (None, "x", None)]
    docs = docs_of(rows)
    got = rows_of(mixing.mix(docs))
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, text, s in rows:
        size[s] += len(WORD.findall(text or ""))
    target = expected_targets(size)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s])
    key = lambda r: tuple(map(str, r.values()))
    assert sorted(map(key, got)) == sorted(map(key, rows_of(mixing.mix(docs.repartition(5)))))


def test_rates_are_exponential_tilts(docs_of, rows_of):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 3 == 0]) for i in range(300)]
    got = [r for r in rows_of(mixing.mix(docs_of(rows)))
           if r["target"] < 2 * r["source_size"] * 0.999]
    by_source = defaultdict(dict)
    for r in got:
        by_source[r["source"]][r["size"]] = r["rate"]
    for rates in by_source.values():
        tilt = [np.log(v) / k for k, v in rates.items() if v < 2]
        assert tilt and max(tilt) - min(tilt) < 1e-9
    words = defaultdict(float)
    for r in got:
        words[r["source"], r["target"]] += r["rate"] * r["size"]
    for (_, target), took in words.items():
        assert took == pytest.approx(target, rel=1e-5)


def test_mixing_nothing_and_only_empty_texts(docs_of, rows_of):
    assert mixing.mix(docs_of([])).count() == 0
    got = rows_of(mixing.mix(docs_of(["", None, " "])))
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 3
