import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestry.llm import manifest, queries

SF = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}"
                       for f in FIELDS))


def tree(leaves):
    """Root and siblings of each leaf, level by level."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, a in enumerate(at):
            if a ^ 1 < len(level):
                paths[k].append(level[a ^ 1])
        at = [a >> 1 for a in at]
        level = [sha("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs = []
    for lang in langs:
        by[lang].sort(key=lambda x: x[:3])
        subs.append(tree([x[2] for x in by[lang]]))
    root, tops = tree([s[0] for s in subs])
    out = []
    for lang, (sub, paths), top in zip(langs, subs, tops, strict=True):
        for (_, _, leaf, r), path in zip(by[lang], paths, strict=True):
            hit = (r["doc_id"] is not None and r["n_chars"] is not None
                   and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0)
            out.append((r["doc_id"], leaf, sub, root, sha("".join(path + top)), not hit))
    return out


def plainly(x):
    return sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[4]))


def ours(m):
    rows = manifest.view(m, "suspect")
    got = manifest.fold(rows.withColumn("now", F.coalesce("suspect", "leaf")), "now", "folded")
    return [(r.key, r.leaf.hex(), r.subroot.hex(), r.root.hex(),
             sha((r.witness + r.top_witness).hex()), bytes(r.folded) == bytes(r.root))
            for r in got.collect()]


@given(st.integers(1, 70), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_blocks_of_blocks_give_the_tree(n, levels):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    layer, paths = leaves, [[] for _ in leaves]
    shift = 0
    while True:
        roots = []
        for k, first in enumerate(range(0, len(layer), 1 << levels)):
            block = manifest.Block()
            for node in layer[first:first + (1 << levels)]:
                block.append(node)
            roots.append(block.close(levels if k else 0))
            for i in range(n):
                at = (i >> shift) - first
                if 0 <= at < len(block.witness):
                    paths[i] += block.witness[at]
        layer, shift = roots, shift + levels
        if len(layer) == 1:
            break
    root, want = tree([x.hex() for x in leaves])
    assert layer[0].hex() == root
    assert [[x.hex() for x in p] for p in paths] == want
    for i in range(n):
        assert manifest.folded(leaves[i], i, n, b"".join(paths[i])).hex() == root


def test_query_equals_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op11_merkle_manifest(spark, SF).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in rows]
    assert plainly(got) == plainly(plain(docs))
    assert all((r.folded_root == r.root) == r.verified for r in rows)
    assert {r.verified for r in rows} == {True, False}


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, grp string, at int"


def rows_between(a, b):
    langs = ["en", "en", "en", "de", None, "", "é", "en", "fr"]
    return [(i, None if i % 5 == 0 else "s", langs[i % 9], None if i % 4 == 0 else i,
             None if i % 7 == 0 else "t" * (i % 3), "x", 1) for i in range(a, b)]


@pytest.mark.parametrize("cuts", [(0, 60), (0, 1, 2, 30), (0, 17, 18, 50, 60)])
def test_appends_equal_one_build(spark, cuts):
    m = None
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        m = manifest.documents(spark.createDataFrame(rows_between(a, b), SCHEMA), m, levels=2)
    want = plain([dict(zip(FIELDS, r[:5], strict=True)) for r in rows_between(0, cuts[-1])])
    assert plainly(ours(m)) == plainly(want)


def test_an_append_keeps_full_blocks(spark):
    one = [(i, "s", "en", 1, "t", "x", 1) for i in range(9)]
    m = manifest.documents(spark.createDataFrame(one[:8], SCHEMA), levels=2)
    old = m.layers[0].inputFiles()
    more = manifest.documents(spark.createDataFrame(one[8:], SCHEMA), m, levels=2)
    kept = more.layers[0].filter("block < 2")
    assert set(kept.inputFiles()) & set(old)
    assert kept.count() == 10 and more.layers[0].filter("block = 2").count() == 2


def test_appends_must_come_behind(spark):
    m = manifest.documents(spark.createDataFrame(rows_between(10, 20), SCHEMA))
    with pytest.raises(ValueError, match="before earlier"):
        manifest.documents(spark.createDataFrame(rows_between(9, 12), SCHEMA), m)


def test_nulls_repeats_long_and_empty_tables(spark):
    rows = [(None, None, None, None, None, "x", 1), (None, "s", None, 1, "", "x", 1),
            (3, "s", "en", 2, "a", "x", 1), (3, "s", "en", 2, "a", "x", 1),
            (3, "s", "en", 2, "b", "x", 1), (1, "s", "en", 3, "l" * 300_000, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = plain([dict(zip(FIELDS, r[:5], strict=True)) for r in rows])
    assert plainly(ours(manifest.documents(docs))) == plainly(want)
    empty = manifest.documents(docs.limit(0))
    assert manifest.fold(manifest.view(empty, "suspect"), "leaf", "f").count() == 0
    again = manifest.documents(docs, empty)
    assert plainly(ours(again)) == plainly(want)
    void = spark.createDataFrame([(None, None)], "doc_id void, text void")
    assert manifest.view(manifest.documents(void)).count() == 1
