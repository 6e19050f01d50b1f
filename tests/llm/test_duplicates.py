import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from attestry.llm import jaccard, line_dedup, tries
from attestry.llm.common import Texts, chunks, window_hashes, word_hashes, words
from attestry.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def texts_of(*values):
    import pyarrow as pa

    return list(chunks(pa.array(values, pa.string()), 16))


def test_words_and_hashes_do_not_cross_texts():
    values = ["ab cd", "", "cd", None, " \t", "é x ab", "x" * 200 + " cd", "cd\x0bab"]
    got = []
    for t in texts_of(*values):
        w = words(t)
        h = word_hashes(t, w)
        for i in range(len(t)):
            spans = [t.data[a:b].tobytes().decode() for a, b in zip(
                w.start[w.first[i]:w.first[i + 1]], w.end[w.first[i]:w.first[i + 1]], strict=True)]
            got.append((spans, list(h[w.first[i]:w.first[i + 1]])))
    assert [s for s, _ in got] == [WORD.findall(v or "") for v in values]
    by_word = defaultdict(set)
    for spans, hashes in got:
        for s, h in zip(spans, hashes, strict=True):
            by_word[s].add(h)
    assert all(len(h) == 1 for h in by_word.values())
    assert len(set.union(*by_word.values())) == len(by_word)


def test_windows():
    h = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    w = window_hashes(h, 3)
    assert len(w) == 4 and w[0] == w[3] and w[0] != w[1]
    assert len(window_hashes(h[:2], 3)) == 0


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 3:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k:k + 3]) for k in range(len(w) - 2))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            q = len(a & sets[j])
            if a and sets[j] and 100 * q >= 90 * (len(a) + len(sets[j]) - q):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d is None, d, len(sets[i]), least.get(find(i), None) if sets[i] else d)
                  for i, (d, _) in enumerate(rows) if d is not None)


def corpus(seed, n, vocabulary=300):
    """Unrelated texts, edited copies of a few of them, copies of copies, shared passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, vocabulary)}"
    bases = [[word() for _ in range(rng.choice([3, 8, 20, 60, 130, 300]))] for _ in range(8)]
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.6:
            t = list(rng.choice(bases if kind < 0.3 else bases[-3:]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                k = rng.randrange(len(t))
                t[k:k + rng.choice([0, 1, 2])] = [word()] if rng.random() < 0.7 else []
                t = t or [word()]
            if kind < 0.1:
                bases.append(t)
        else:
            t = [word() for _ in range(rng.randint(1, 80))]
            if kind > 0.85:
                t += passage
        out.append(" ".join(x.upper() if rng.random() < 0.05 else x for x in t))
    return out


@pytest.mark.parametrize("seed, light, n", [(1, 16, 150), (2, 1, 200), (3, 2, 250), (4, 4, 300)])
def test_components_equal_brute_force(docs_of, rows_of, seed, light, n):
    rows = list(enumerate(corpus(seed, n)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "a b"),
             (1006, "b a"), (3, rows[3][1]), (None, rows[5][1])]
    got = rows_of(jaccard.near_copies(docs_of(rows), light=light))
    assert len(got) == len(rows)
    mine = sorted((False, r["doc_id"], r["n_shingles"], r["component_id"])
                  for r in got if r["doc_id"] is not None)
    assert mine == brute_components(rows)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [
        next(r["component_id"] for r in got if r["doc_id"] == 5)]


def test_edited_copies_in_one_large_group(docs_of, rows_of):
    """Hubs, outsiders and neighbourhoods, with hundreds of copies of one text."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(260):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            t[rng.randrange(len(t))] = f"x{rng.randint(0, 40)}"
        rows.append((i, " ".join(t)))
    got = rows_of(jaccard.near_copies(docs_of(rows), light=3))
    assert sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in got
                  ) == brute_components(rows)


def test_pairs_that_agree_on_empty_segments_only_still_meet():
    """One difference in every other segment, two in as many as the limit allows."""
    rng = np.random.default_rng(11)
    alone = 0
    for _ in range(600):
        m = int(rng.integers(2, 60))
        x = np.unique(rng.integers(0, 1 << 64, int(m * rng.choice([2.7, 4])), np.uint64))
        at = jaccard.segment_sums(x, m)[1]
        full = np.flatnonzero(np.diff(at))
        if len(full) == m:
            continue
        twice = set(rng.choice(full, min(len(full), m - 1 - len(full)), replace=False))
        y = set(x.tolist())
        for k in full:
            for _ in range(1 + (k in twice)):
                inside = [t for t in y if (t >> 32) * m >> 32 == k]
                if len(inside) > 1 and rng.random() < 0.5:
                    y.discard(inside[int(rng.integers(len(inside)))])
                else:
                    least = -(-(int(k) << 32) // m) << 32
                    y.add(least + int(rng.integers(1 << 20)))
        y = np.array(sorted(y), np.uint64)
        if len(np.setxor1d(x, y)) > m - 1:
            continue
        alone += 1
        (wx, px), (wy, py) = (jaccard.index_of(s, 7, m) for s in (x, y))
        assert len(np.intersect1d(np.r_[wx, px], np.r_[wy, py]))
        assert len(np.intersect1d(wx, wy)) or len(np.intersect1d(wx, py)) or len(
            np.intersect1d(px, wy))
    assert alone > 200


@pytest.mark.parametrize("size", [300, 1200])
def test_unlike_sets_make_no_pairs_and_no_hubs(spark, docs_of, size):
    """What a segment without tokens would tie together: nothing, at either size."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))) for i in range(size)]
    found = jaccard.signatures(docs_of(rows), 1, 80).repartition("sig").sortWithinPartitions(
        "sig", "c64").mapInArrow(jaccard._runs(80, 16), "kind tinyint, a bigint, b bigint, info bigint")
    assert found.count() < size / 20


def test_bands_reach_any_text():
    low, _, segments = jaccard.bands(80)
    assert low[-1] > 1 << 31 and len(low) < 1024
    assert jaccard.groups_of(80_000_000, 80) and segments[-1] < 1 << 31


def test_long_runs_are_cut_into_the_same_rows():
    """Batches of one row or of all rows name the same pairs and dear rows."""
    import pyarrow as pa

    rng = random.Random(1)
    rows = []
    for sig, (wholes, parts) in enumerate([(1, 0), (2, 1), (3, 2), (9, 0), (9, 3), (0, 40), (1, 40),
                                           (30, 0), (30, 30), (2, 5), (1, 4)]):
        for k in range(wholes + parts):
            row = (sig, 1000 * sig + k, jaccard._pack(50 + rng.randrange(3), 4, int(k >= wholes)))
            rows += [row] * rng.choice([1, 1, 2])

    def through(step):
        batches = [pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*rows[i:i + step], strict=True)],
            names=["sig", "c64", "info"]) for i in range(0, len(rows), step)]
        return sorted(tuple(r.values()) for b in jaccard._runs(80, 3)(iter(batches))
                      for r in b.to_pylist())

    whole = through(len(rows))
    pairs = {(r[1], r[2]) for r in whole if r[0] == jaccard.PAIR}
    assert (1000, 1001) in pairs and (1000, 1002) in pairs and (10000, 10003) in pairs
    assert not any(a // 1000 in (3, 5, 7) for a, _ in pairs)
    for step in (1, 2, 7, 50):
        assert through(step) == whole


def test_bands_hold_every_pair_that_can_link():
    low, upper, segments = jaccard.bands(90)
    for a in range(1, 400):
        for b in range(a, a * 10 // 9 + 1):
            common = set(jaccard.groups_of(a, 90)) & set(jaccard.groups_of(b, 90))
            assert common
            # The least overlap that links, so the most tokens that differ.
            shared = -(-90 * (a + b) // 190)
            if shared <= a:
                own = int(np.searchsorted(low, a, "right")) - 1
                assert own in common and a + b - 2 * shared < segments[own]


def shingles_of(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1))


def kept_of(rows, width, percent):
    """Ids that stay: the least of each component, and rows without shingles."""
    sets = [shingles_of(t, width) for _, t in rows]
    least = list(range(len(rows)))
    for _ in rows:
        old = list(least)
        for i, a in enumerate(sets):
            for j in range(i):
                q = len(a & sets[j])
                if a and sets[j] and 100 * q >= percent * (len(a) + len(sets[j]) - q):
                    least[i] = least[j] = min(least[i], least[j])
        if old == least:
            break
    return sorted(rows[i][0] for i, x in enumerate(least) if x == i)


@pytest.mark.parametrize("seed, n", [(11, 150), (12, 260)])
def test_near_stage_equals_brute_force_at_five_words_and_eight_tenths(spark, docs_of, seed, n):
    import corpus_pipeline as cp

    rng = random.Random(seed)
    base = [f"n{rng.randint(0, 5000)}" for _ in range(300)]
    longer = base + [f"t{k}" for k in range(45)]
    edited = list(base)
    for k in range(20, 300, 50):
        edited[k] = f"e{k}"
    rows = [*enumerate(corpus(seed, n)), (5000, " ".join(base)), (5001, " ".join(longer)),
            (5002, " ".join(edited)), (5003, None), (5004, ""), (5005, "two words")]
    stay = cp.near_dedup(spark, docs_of(rows), "")
    kept = sorted(r.doc_id for r in stay.select("doc_id").collect())
    assert kept == kept_of(rows, 5, 80)
    assert kept != kept_of(rows, 3, 90) and not {5001, 5002} & set(kept)


@pytest.mark.parametrize("light", [1, 3])
def test_large_groups_at_eight_tenths(docs_of, rows_of, light):
    rng = random.Random(light)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(200):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            t[rng.randrange(len(t))] = f"x{rng.randint(0, 40)}"
        rows.append((i, " ".join(t)))
    rows += [(300 + i, t) for i, t in enumerate(corpus(light, 150))]
    got = rows_of(jaccard.near_copies(docs_of(rows), width=5, percent=80, light=light))
    assert sorted(r["doc_id"] for r in got if r["doc_id"] == r["component_id"]) == kept_of(
        rows, 5, 80)


def test_sketches_never_exceed_the_differences():
    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, rng.integers(2, 900)).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, len(pool) + 1))) for _ in range(2))
        assert jaccard.fewest_differences(jaccard.sketch(a), jaccard.sketch(b)) <= len(
            np.setxor1d(a, b))


def test_near_copies_of_nothing(docs_of):
    assert jaccard.near_copies(docs_of([])).count() == 0


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 1), (20, 21), (21, 22), (7, 7), (3, 5)] + [
        (100 + i, 101 + i) for i in range(40)]
    got = dict(components(spark.createDataFrame(links, "a int, b int")).collect())
    assert {k: got[k] for k in (5, 3, 9, 1, 20, 21, 22)} == {5: 1, 3: 1, 9: 1, 1: 1, 20: 20,
                                                           21: 20, 22: 20}
    assert {got[100 + i] for i in range(41)} == {100}


def strip(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_trie_splits_edges_and_keeps_least():
    t = tries.Trie()
    values = [b"abcd", b"abxy", b"ab", b"", b"abcd", b"abcdef", b"b", b"abx"]
    nodes = [t.insert(v, 10 + i) for i, v in enumerate(values)]
    t.insert(b"abcd", 3)
    assert nodes[0] is nodes[4] and nodes[0].least == 3
    assert len({id(n) for n in nodes}) == len(set(values))
    assert t.bytes <= sum(map(len, values))
    assert tries.common_prefix(b"abcdx", b"abcdy") == 4 and tries.common_prefix(b"", b"a") == 0


@pytest.mark.parametrize("budget", [1, 1 << 20])
def test_exact_groups_equal_brute_force(docs_of, rows_of, budget):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a b", "ab", "a\tb ", "é", "é", "", None, " \n", "x" * 4000,
                            "x" * 4000 + " ", f"own {i % 40}", " ", "AB"])) for i in range(300)]
    rows += [(7, "ab"), (7, "ab"), (None, "ab"), (None, "only null")]
    got = rows_of(tries.duplicates(docs_of(rows).repartition(3), budget))
    groups = defaultdict(list)
    for d, t in rows:
        groups[strip(t)].append((-len(t or ""), d is None, d))
    best = {k: min(v)[2] for k, v in groups.items()}
    sizes = {hashlib.sha256(k.encode()).hexdigest(): (best[k], len(v)) for k, v in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == sizes[r["text_sha256"]]
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_kept_rows_come_with_their_columns(docs_of, rows_of):
    docs = docs_of([(1, "a b", "s1"), (2, "ab", "s2"), (3, None, "s3"), (4, "", None)])
    got = rows_of(tries.deduplicated(docs))
    assert tries.deduplicated(docs).columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in got) == [
        (1, "a b", "s1"), (3, None, "s3")]
    assert tries.deduplicated(docs_of([])).count() == 0


def test_one_subtree_for_all_still_tells_texts_apart(spark, rows_of):
    reps = spark.createDataFrame([(k, 2, 5, t) for k, t in enumerate(["ab", "ac", "ab", "ba"])],
                                 "rep_key bigint, n_bytes bigint, head bigint, text string")
    got = {r["rep_key"]: r["owner_rep"] for r in rows_of(tries.owners(reps, lambda n, h: 0))}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}


LINES = [f"line number {k} has quite a few words in it" for k in range(12)]


def test_patience_aligns_in_order():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_dedup.patience([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])
    assert line_dedup.patience([5, 5, 5], [5, 5]) == [(0, 0), (1, 1)]
    assert line_dedup.patience([], [1]) == []
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randint(1, 9) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(1, 9) for _ in range(rng.randint(0, 14))]
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_later_documents_lose_common_blocks(docs_of, rows_of):
    a = "\n".join(LINES[:4])
    b = "\n".join(["my own first line that nobody else has got", *LINES[1:3], "", LINES[3], "end"])
    rows = [(1, a), (2, b), (3, a), (4, "\n".join(LINES[6:8])), (5, "short\nshort"), (6, None),
            (7, ""), (8, LINES[9] + "  \n" + LINES[10]), (None, LINES[9] + "\n" + LINES[10]),
            (9, "Licensed by X"), (10, "Licensed by X"), (1, a)]
    got = rows_of(line_dedup.deduplicate(docs_of(rows)))
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append((r["text"], r["n_lines"], r["n_removed"]))
    assert sorted(by_id[1]) == [("", 4, 4), (a, 4, 0)]
    assert by_id[2] == [("my own first line that nobody else has got\n\nend", 6, 3)]
    assert by_id[3] == [("", 4, 4)]
    assert by_id[4][0][2] == 0 and by_id[5] == [("short\nshort", 2, 0)]
    assert by_id[6] == [(None, 0, 0)] and by_id[7] == [("", 1, 0)]
    assert by_id[8][0][2] == 0 and by_id[None] == [("", 2, 2)]
    assert by_id[9] == by_id[10] == [("Licensed by X", 1, 0)]
    assert line_dedup.deduplicate(docs_of([])).count() == 0


def test_common_and_rare_lines_both_find_pairs(spark, docs_of):
    rows = [(i, LINES[0] + f"\nown line {i} of document {i} here\n" + (LINES[1] if i % 9 == 0 else ""))
            for i in range(60)]
    table = line_dedup.lined(docs_of(rows)).cache()
    pairs = line_dedup.candidate_pairs(table, rare=8).collect()
    # Every later holder meets the first; the rare line also links neighbours.
    assert len(pairs) == 59 + 5


def test_frequent_lines_find_an_earlier_holder_of_the_block(docs_of, rows_of):
    """Lines of six words with over 32 holders, each alone in its first holder."""
    first, second = "six words are in this line", "and six more are in this"
    rows = [(0, first), (1, second), *[(2 + i, f"{first}\n{second}\nown{i}") for i in range(40)]]
    got = {r["doc_id"]: r["text"] for r in rows_of(line_dedup.deduplicate(docs_of(rows)))}
    assert got[0] == first and got[1] == second and got[2] == rows[2][1]
    assert [got[3 + i] for i in range(39)] == [f"own{i}" for i in range(1, 40)]


def test_blocks_of_short_lines_leave(docs_of, rows_of):
    verse = "\n".join(f"verse {k} is short" for k in range(20))
    got = rows_of(line_dedup.deduplicate(docs_of([verse, verse])))
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(0, verse), (1, "")]


def test_passages_held_twice_are_found():
    p, x, y, z, u, v, w = range(1, 8)
    for a, b, gone in (([x, p, y, p, z], [u, p, v], [(1, 2)]),
                       ([x, p, y], [u, p, v, p, w], [(1, 2), (3, 4)])):
        sizes = [12] * len(b)
        found = line_dedup.blocks(line_dedup.patience(a, b), b, sizes, 10)
        assert sorted(found + line_dedup.unaligned(a, b, sizes, found, 10)) == gone


def lines_left(rows, block_words):
    """Texts without the lines of runs of enough words that an earlier row holds as a run."""
    out, before = [], []
    for _, text in rows:
        lines = [x.strip() for x in text.split("\n")]
        gone = set()
        for low in range(len(lines)):
            for high in range(low + 1, len(lines) + 1):
                run = lines[low:high]
                if run[0] and run[-1] and sum(len(x.split()) for x in run) >= block_words and any(
                        run == old[k:k + len(run)] for old in before for k in range(len(old))):
                    gone |= set(range(low, high))
        out.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))
        before.append(lines)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_every_block_of_an_earlier_document_leaves(docs_of, rows_of, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"l{k}w{j}" for j in range(n)) for k, n in enumerate(
        [1, 2, 3, 4, 4, 5, 6, 6, 7, 9, 11, 14])] + ["", " "]
    rows = []
    for i in range(150):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"own {i} {k}"
                 for k in range(rng.randint(1, 12))]
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in rows_of(line_dedup.deduplicate(docs_of(rows)))}
    assert [got[i] for i, _ in rows] == lines_left(rows, line_dedup.BLOCK_WORDS)
