import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from attestry.llm import mixing, pii, qda, queries, rules, stats, url_filter, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "a b a b a b", "x\nx\n x\n\n\n", "#*$%&|<> é #", "ab " * 400,
       "one two three one two three", "é\x0bé é é", "line\nline \nline", "y" * 3000]


def plain_counts(text):
    w = WORD.findall(text or "")
    spans = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    n = Counter(spans)
    inside = {k + j for k, s in enumerate(spans) if n[s] > 1 for j in range(3)}
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(full) - len(set(full)), "n_repeat_words": len(inside),
            "n_lines": len(full), "n_distinct_words": len(set(w)),
            "n_same_as_last": sum(a == b for a, b in zip(w, w[1:], strict=False)),
            "n_single": sum(len(x) == 1 for x in w)}


def test_counts_equal_a_plain_reading(spark, docs_of, rows_of):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in rows_of(stats.table(docs_of(texts)))}
    for i, text in enumerate(texts):
        expected = plain_counts(text)
        assert {k: got[i][k] for k in expected} == expected, repr(text)[:60]


def labelled(spark, n=400):
    good = "the cat sat on a mat while it rained and nobody came by to see it or them at all today"
    rows, labels = [], []
    for i in range(n):
        junk = i % 4 == 0
        text = " ".join(w + "abcdef"[k] * (1 + i % 5) + "$$" * junk
                        for k in range(4) for w in good.split())
        rows.append((i, text))
        labels.append((i, 0 if junk else 1))
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_rules_are_learnt_and_applied_in_order(spark, docs_of, rows_of):
    rows, labels = labelled(spark)
    docs = docs_of(rows + [(None, rows[1][1]), (9000, None), (9001, ""), (9002, "a b c " * 40)])
    got = {r["doc_id"]: r for r in rows_of(rules.judge(docs, labels))}
    assert all(got[i]["kept"] == (i % 4 != 0) for i, _ in rows)
    assert got[None]["kept"] and got[9000]["base_failed"] and not got[9001]["kept"]
    assert got[9002]["base_failed"] and not got[9002]["kept"]
    kept = rules.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in got.values())


def test_rules_without_labels_keep_all_that_passes(spark, docs_of, rows_of):
    rows, labels = labelled(spark, 12)
    got = rows_of(rules.judge(docs_of(rows), labels.limit(0)))
    assert all(r["kept"] for r in got)
    assert rules.judge(docs_of([]), labels).count() == 0


def test_covering_finds_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = (x[:, 0] > 0.7) & (x[:, 2] < 0.4)
    learnt = rules.learn(x, y, rng.integers(0, 3, 4000))
    hit = np.any([rules.covers(r, x) for r in learnt], axis=0)
    assert (hit & ~y).sum() <= 0.02 * hit.sum() and (hit & y).sum() >= 0.95 * y.sum()
    assert {c.feature for c in learnt[0]} <= {0, 2}


def test_discriminant_equals_the_written_out_densities():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (500, 3))
    known = {c: (len(v), v.sum(0), v.T @ v) for c, v in ((0, a), (1, b))}
    model = qda.fit(known, to_pooled=0.0, to_identity=0.0)
    x = rng.normal(0.5, 1.5, (50, 3))

    def density(v):
        m, s = v.mean(0), np.cov(v.T, bias=True)
        d = x - m
        return -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1])

    gap = density(b) - density(a) + np.log(500 / 300)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-gap)), atol=1e-9)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = qda.scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert right >= 0.95 * len(rows)
    assert {r["held_out"] for r in rows} == {True}


def test_scores_of_odd_rows(spark, docs_of, rows_of):
    rows, labels = labelled(spark)
    docs = docs_of(rows + [(None, None), (5000, ""), (5001, "z" * 100000), (1, rows[1][1])])
    got = rows_of(qda.scores(docs, labels))
    assert len(got) == len(rows) + 4
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in rows_of(qda.scores(docs, labels.filter("quality = 1")))} == {1.0}
    assert {r["score"] for r in rows_of(qda.scores(docs, labels.limit(0)))} == {0.5}
    assert qda.scores(docs_of([]), labels).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items()
            for m in re.finditer(p, text or "") if valid(k, m.group())]


TRICKY = [
    None, "", "a@b.com@c.org x.y@z.co..uk_q@r.st", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004",
    "+1 (222) 333-4444 +12 +1--------2 +123456789012345678 +1 2 3 4 5 6 7 8 9)",
    "4111 1111 1111 1111 4111-1111-1111-1112 " * 3, "é@x.com ü 4111111111111111é 😀 a.b@c.de",
    "a@b a@b.c. @x.y .@-.-", "5" * 400, " ".join(f"u{i}@h{i}.com" for i in range(400)),
    "+4111111111111111 1.1.1.1@x.y 4111111111111111@x.com"]


def test_base_spans_equal_the_patterns(spark, docs_of, rows_of):
    texts = TRICKY + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in rows_of(pii.report(docs_of(texts)))}
    for i, text in enumerate(texts):
        spans = base_spans(text)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), text
        assert [r[f"n_{k}"] for k in pii.KINDS] == [
            sum(s.startswith(k) for s in spans) for k in pii.KINDS]
        assert set(spans) <= set(r["spans"].split(",")) | {""}
    assert pii.report(docs_of([])).count() == 0


def test_search_is_native(spark, docs_of):
    plan = pii.searched(docs_of(["x"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD.*Python", plan)


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(2)
    z = rng.random(20000) < 0.7
    acc = np.array([0.95, 0.8, 0.7, 0.6, 0.9, 0.75])
    v = np.where(rng.random((20000, 6)) < acc, np.where(z[:, None], 1, -1),
                 np.where(z[:, None], -1, 1))
    pats, n = np.unique(v, axis=0, return_counts=True)
    share, rel, p = pii.em(np.zeros(len(pats), int), pats, n.astype(float))
    assert abs(share[0] - 0.7) < 0.03
    assert np.abs(rel[:, 1, 2] - acc).max() < 0.05
    w = pii.logistic(pii.features(np.zeros(len(pats), int), pats), p, n.astype(float))
    q = 1 / (1 + np.exp(-pii.features(np.zeros(len(pats), int), pats) @ w))
    assert ((q > 0.5) == (p > 0.5))[n > 50].all()


def test_look_alikes_are_candidates_outside_of_base_spans(docs_of, rows_of):
    text = "mail bob [at] site [dot] com or a@b.com, tel (415) 555-1234, card 4111 1111 1111 1112"
    row = rows_of(pii.searched(docs_of([text])))[0]
    loose = [(pii.KINDS[c["kind"]], text[c["start"]:c["end"]]) for c in row["cands"]
             if not c["base"]]
    assert ("email", "bob [at] site [dot] com") in loose
    assert ("phone", "(415) 555-1234") in loose and ("card", "4111 1111 1111 1112") in loose
    assert [text[b["start"]:b["end"]] for b in row["base"]] == ["a@b.com"]


URLS = [
    (1, "http://A.Net/x"), (2, "https://www.example.net/en/1?utm_source=x#y"), (3, "http://net"),
    (4, "http://example.com/de/"), (5, "http://x.example.com/de"), (6, "http://q.org/fr/a"),
    (7, None), (8, "no scheme"), (9, "http://www.bad.org/p/?ref=1&b=2"), (10, "http://bad.org/p?b=2"),
    (11, "http://bad.org/p"), (12, "://h/p"), (13, "http://"), (14, "http://m.bad.org:80/p/?b=2#z"),
    (15, "http://notnet/"), (16, "http://planet/x"), (9, "http://www.bad.org/p/?ref=1&b=2")]


@pytest.mark.parametrize("most", [1, 1 << 16])
def test_url_verdicts(spark, rows_of, most):
    pages = spark.createDataFrame([(*u, "x", "y") for u in URLS],
                                  "page_id bigint, url string, rule string, key string")
    listed = spark.createDataFrame([("HTTP://BAD.org/p?b=2",), (None,), ("http://a.net/x",),
                                    *[(f"http://h{i}.org/",) for i in range(300)]], "url string")
    got = rows_of(url_filter.judge(pages, listed, most=most))
    assert len(got) == len(URLS)
    by_id = {r["page_id"]: r for r in got}
    assert {i: r["rule"] for i, r in by_id.items() if r["rule"]} == {
        1: "net/", 2: "example.net/en/", 4: "example.com/de/", 6: "org/fr/"}
    assert {i for i, r in by_id.items() if r["verdict"] == "block"} == {1, 4, 9, 10, 14}
    assert (by_id[7]["host"], by_id[7]["path"], by_id[8]["host"]) == ("", "", "")
    assert (by_id[2]["host"], by_id[2]["path"]) == ("www.example.net", "/en/1")
    assert by_id[13]["canonical"] is None and by_id[3]["path"] == ""
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    none = rows_of(url_filter.judge(pages, listed.limit(0)))
    assert {r["page_id"] for r in none if r["verdict"] == "block"} == {1, 4}


def test_bloom_passes_all_keys_and_few_others(spark):
    keys = spark.range(4000).selectExpr("CAST(id AS STRING) AS key")
    filter_, blocks = url_filter.bloom(keys, "key", 4000)
    assert blocks == 256 and filter_.count() <= 256
    assert url_filter.passing(keys, "key", filter_, blocks).count() == 4000
    others = spark.range(10_000, 50_000).selectExpr("CAST(id AS STRING) AS key")
    assert url_filter.passing(others, "key", filter_, blocks).count() < 800


def test_revisits(spark, rows_of):
    kind = "record_id bigint, warc_type string, status int, target_uri string, " \
           "captured_at timestamp, headers map<string,string>, payload_digest string, url string"
    import datetime as dt

    def at(hours):
        return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)

    u = "http://www.a.org/x/"
    rows = [
        (1, "response", 200, u, at(0), {"ETag": '"1"', "X": "old", "Content-Length": "5"}, "d1", "z"),
        (2, "response", 404, u, at(1), {"ETag": '"9"'}, "d9", "z"),
        (3, "revisit", 304, "http://a.org/x", at(30), {"etag": 'W/"1"', "x": "new",
                                                       "content-length": "0", "Y": "y"}, None, "z"),
        (4, "response", 200, u, at(40), {"ETag": '"2"', "Last-Modified": "m"}, "d2", "z"),
        (5, "response", 200, u, at(40), {"ETag": '"3"'}, "d3", "z"),
        (6, "revisit", 304, u, at(40), {"ETag": '"1"'}, None, "z"),
        (7, "revisit", 304, u, at(41), {"ETag": '"2"'}, "d3", "z"),
        (8, "revisit", 304, u, at(99), None, "d3", "z"),
        (9, "revisit", 304, u, at(99), None, None, "z"),
        (10, "revisit", 304, "http://b.org/", at(99), {}, None, "z"),
        (11, "revisit", 304, None, at(99), None, None, "z"),
        (12, "revisit", 304, u, None, None, None, "z"),
        (13, None, None, u, at(3), None, None, "z"),
        (8, "revisit", 304, u, at(99), None, "d3", "z")]
    df = spark.createDataFrame(rows, kind)
    for seconds in (60, 3600, 10 ** 9):
        got = rows_of(warc.resolve(df, seconds))
        found = {r["record_id"]: (r["outcome"], r["response_id"], r["checked_by"]) for r in got}
        assert len(got) == 9
        assert found == {
            3: ("resolved", 1, "etag"), 6: ("resolved", 1, "etag"), 7: ("changed", 5, "etag"),
            8: ("resolved", 5, "digest"), 9: ("unchecked", 5, "none"), 10: ("no_response", None, None),
            11: ("no_response", None, None), 12: ("no_response", None, None)}
        merged = next(r["headers"] for r in got if r["record_id"] == 3)
        assert merged == {"etag": 'W/"1"', "x": "new", "content-length": "5", "y": "y"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_responses_that_share_an_id(spark, rows_of):
    """The one of the found time counts; of equal times the headers that sort last."""
    import datetime as dt

    kind = "record_id bigint, warc_type string, status int, target_uri string, " \
           "captured_at timestamp, headers map<string,string>, payload_digest string"
    u, at = "http://a.org/x", lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, "response", 200, u, at(0), {"X": "a"}, "d"),
            (1, "response", 200, u, at(0), {"X": "b"}, "d"),
            (1, "response", 200, u, at(5), {"X": "c"}, "d"),
            (2, "revisit", 304, u, at(1), None, None), (3, "revisit", 304, u, at(9), None, None)]
    for order in (rows, rows[::-1]):
        got = rows_of(warc.resolve(spark.createDataFrame(order, kind)))
        assert {r["record_id"]: r["headers"] for r in got} == {2: {"x": "b"}, 3: {"x": "c"}}


def test_archive_has_every_outcome(spark, rows_of):
    got = rows_of(queries.op2_warc_revisits(spark, SF))
    assert {r["outcome"] for r in got} == {"resolved", "changed", "no_response"}
    assert {r["checked_by"] for r in got} >= {"etag", "last-modified", "digest"}


def _norm(v):
    return repr(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(
        repr([row[i] for i in at]) for row in rel.fetchall())


def test_pipeline_stages_keep_the_documents_shape(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, seen = docs, []
    for _, stage in cp.STAGES[:-1]:
        at = stage(spark, at, SF).cache()
        assert at.columns == docs.columns
        seen.append(at.count())
    assert docs.count() >= seen[0] >= seen[1] >= seen[2] > 0
    last = cp.STAGES[-1][1](spark, at, SF)
    assert last.filter("piece = 0").count() == seen[3]
    assert cp.run(spark, SF).count() == last.count()
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_stages_equal_plain_versions(spark):
    """Planted exact and near copies through the stages, rows of each against plain Python."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = [r.asDict() for r in docs.collect()]
    longest = sorted(first, key=lambda r: -len(r["text"] or ""))[:6]
    for k, r in enumerate(longest):
        w = r["text"].split(" ")
        grown = w + [f"grown{k}x{j}" for j in range(len(w) * 15 // 100)]
        first.append(r | {"doc_id": 10_000_000 + 2 * k, "text": r["text"].replace(" ", "  ", 1)})
        first.append(r | {"doc_id": 10_000_001 + 2 * k, "text": " ".join(grown)})
    docs = spark.createDataFrame(first, docs.schema)
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    passed = cp.quality_rules(spark, docs, SF).cache()
    judged = {r.doc_id for r in rules.judge(docs, labels).collect() if r.kept}
    at = [r.asDict() for r in passed.collect()]
    assert sorted(r["doc_id"] for r in at) == sorted(judged)

    # The longest of equal texts stays, of those the one of least id.
    best = {}
    for r in sorted(first, key=lambda r: (-len(r["text"] or ""), r["doc_id"])):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), r["doc_id"])
    exact = cp.exact_dedup(spark, docs, SF).cache()
    at = [(r.doc_id, r.text) for r in exact.collect()]
    assert sorted(i for i, _ in at) == sorted(best.values())
    assert not {r["doc_id"] for r in longest} & {i for i, _ in at}

    sets = []
    for _, text in at:
        w = [x.lower() if x.isascii() else x for x in WORD.findall(text or "")]
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5
                    else {tuple(w)} if w else set())
    least = [i for i, _ in at]
    linked = [(x, y) for x, a in enumerate(sets) for y, b in enumerate(sets[:x])
              if a and b and 10 * len(a & b) >= 8 * len(a | b)]
    for _ in at:
        for x, y in linked:
            least[x] = least[y] = min(least[x], least[y])
    near = cp.near_dedup(spark, exact, SF).cache()
    kept = sorted(r.doc_id for r in near.collect())
    assert kept == sorted(i for (i, _), n in zip(at, least, strict=True) if i == n)
    assert len(kept) <= len(at) - 6

    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    rows = Counter(r.doc_id for r in cp.source_mix(spark, near, SF).collect())
    assert rows == {i: n for i, n in copies.items() if n}
