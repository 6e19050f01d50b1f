"""The operators of this folder applied to their whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import (
    jaccard,
    line_dedup,
    manifest,
    mixing,
    packing,
    periodic,
    pieces,
    pii,
    qda,
    rules,
    tries,
    url_filter,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


# The test tables hold pages but no archive, so each page gives two captures of its whole url:
# a response, and a revisit, mostly later, under another spelling of the url. The same SELECT
# feeds the SQL check.
RECORDS = r"""
SELECT 2 * page_id AS record_id, 'response' AS warc_type,
  CASE WHEN page_id % 11 = 5 THEN 404 ELSE 200 END AS status, url AS target_uri,
  1704067200 + (page_id * 7919) % 2592000 AS seconds,
  CASE WHEN page_id % 5 = 0 THEN NULL
       ELSE 'W/"v' || CAST(page_id % 3 AS STRING) || '"' END AS etag,
  CASE WHEN page_id % 7 = 0 THEN NULL
       ELSE 'Mon, 0' || CAST(page_id % 2 + 1 AS STRING) || ' Jan 2024 00:00:00 GMT' END AS modified,
  CAST(length(html) AS STRING) AS size, md5(html) AS digest
FROM {pages}
UNION ALL
SELECT 2 * page_id + 1, 'revisit', 304,
  CASE WHEN page_id % 4 = 0 THEN url
       WHEN page_id % 4 = 1 THEN regexp_replace(url, '^https?://(www[.])?', 'http://www.')
       WHEN page_id % 4 = 2 AND url NOT LIKE '%#%' THEN url
         || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 'utm_source=mail'
       ELSE url || '#top' END,
  1704067200 + (page_id * 7919) % 2592000 + (page_id * 104729) % 5000000 - 800000,
  CASE WHEN page_id % 10 = 0 THEN NULL WHEN page_id % 6 = 1
       THEN '"v' || CAST((page_id + 1) % 3 AS STRING) || '"'
       ELSE '"v' || CAST(page_id % 3 AS STRING) || '"' END,
  CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 20 = 5 THEN 'Tue, 09 Jan 2024 00:00:00 GMT'
       ELSE 'Mon, 0' || CAST(page_id % 2 + 1 AS STRING) || ' Jan 2024 00:00:00 GMT' END,
  NULL, CASE WHEN page_id % 13 = 0 THEN md5('moved') ELSE md5(html) END
FROM {pages}"""


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive records made from the pages table."""
    rows = spark.sql(RECORDS, pages=_table(spark, sf_dir, "pages"))
    headers = F.map_filter(F.create_map(
        F.lit("ETag"), "etag", F.lit("Last-Modified"), "modified", F.lit("Content-Length"), "size",
        F.lit("X-Record"), F.col("record_id").cast("string")), lambda _, v: v.isNotNull())
    return rows.select(
        "record_id", "warc_type", "status", "target_uri",
        F.timestamp_seconds("seconds").alias("captured_at"), headers.alias("headers"),
        F.col("digest").alias("payload_digest"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(archive(spark, sf_dir))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(
        e["key"], F.lit(": "), e["value"])))
    return found.select(
        "record_id", "url", "outcome", "response_id", "checked_by",
        F.when(F.col("headers").isNotNull(), F.concat_ws("; ", entries)).alias("headers"))


LISTED = r"(^|[.-])(adult|bets|casino|spam)([.-]|$)"


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of pages on hosts with one of four words in their name."""
    pages = _table(spark, sf_dir, "pages")
    listed = pages.filter(url_filter.host_of(F.col("url")).rlike(LISTED)).select("url")
    return url_filter.judge(pages, listed)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.duplicates(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf, roots and siblings, and the root that its possibly changed leaf gives."""
    rows = manifest.view(manifest.documents(_table(spark, sf_dir, "documents")), "suspect")
    told = manifest.fold(rows.withColumn("leaf_now", F.coalesce("suspect", "leaf")),
                         "leaf_now", "folded")
    proof = F.lower(F.concat(F.hex("witness"), F.hex("top_witness")))
    return told.select(
        F.col("key").alias("doc_id"), *[F.lower(F.hex(c)).alias(c) for c in (
            "leaf", "subroot", "root")],
        F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        F.lower(F.hex("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))


# Every tenth document, by hash, gets a tail that repeats: word a of it on, p words at a time.
REPEATED = r"""
CASE WHEN doc_id IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 10 = 0 THEN
  array_join(transform(
    array(filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')),
    ws -> transform(ws, (w, i) -> IF(i < g % size(ws), w,
      ws[CAST(g % size(ws) + (i - g % size(ws)) % (1 + (size(ws) - g % size(ws)) DIV (3 + g % 8))
         AS INT)])))[0], ' ')
ELSE text END"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn(
        "g", F.expr("crc32(CAST(doc_id AS STRING)) DIV 10")).select(
        "doc_id", F.expr(REPEATED).alias("text"))
    best = F.expr("array_min(transform(runs, r -> struct("
                  "-r.length AS shorter, r.start AS start, r.period AS period)))")
    lines = F.expr(r"array_join(transform(runs, "
                   r"r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return periodic.runs(docs).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-1000 * best.shorter DIV best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids, and of the text decoded from just these ids."""
    encoded = pieces.encode(_table(spark, sf_dir, "documents"))
    return pieces.decode(encoded).select(
        "doc_id", F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_best_fit_packing, op2_warc_revisits, op3_url_filter, op4_quality_classifier,
    op5_personal_data, op6_source_mixing, op7_quality_rules, op8_line_dedup,
    op9_ngram_jaccard_join, op10_exact_dedup, op11_merkle_manifest,
    op12_periodic_runs, op13_sentencepiece, pipeline)}

_CANONICAL = r"""
part AS (
  SELECT *, translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
    [p FOR p IN string_split(regexp_extract({url}, '^.*?://[^/?#]*[^?#]*\?([^#]*)', 1, 's'), '&')
     IF length(p) > 0 AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)')] AS query
  FROM {table}),
named AS (
  SELECT *, CASE WHEN length(bare) > 0 THEN bare || regexp_replace(path, '/$', '')
      || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END
    END AS canonical
  FROM (SELECT *, regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':[0-9]+$', '') AS bare
        FROM part))"""

_TOLD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(_TOLD.format(c) for c in (
        "doc_id", "source", "lang", chars, "text")) + ")"


# A tree (t) has leaves (t, i, n, h); two levels of them here, one per lang and one on top.
_MERKLE = r"""
WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents),
crc AS (
  SELECT DISTINCT id, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM d WHERE id IS NOT NULL
  UNION ALL
  SELECT id, k + 1, list_reduce(
    list_prepend(xor(c, CAST(ascii(id[k + 1]) AS BIGINT)), CAST(range(8) AS BIGINT[])),
    lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))
  FROM crc WHERE k < length(id)),
leaf AS (
  SELECT d.*, coalesce(xor(c, 4294967295) % 7 = 0, false) AS hit, {leaf} AS h,
    CASE WHEN xor(c, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN {changed} ELSE {leaf}
      END AS now
  FROM d LEFT JOIN crc ON crc.id = d.id AND crc.k = length(d.id)),
own AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (
      PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n FROM leaf),
up AS (
  SELECT 0 AS l, lang AS t, i, n, h FROM own
  UNION ALL
  SELECT l + 1, t, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM up WHERE n > 1 GROUP BY l, t, i // 2, n),
subs AS (
  SELECT t AS lang, h, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS i,
    count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS l, i, n, h FROM subs
  UNION ALL
  SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM top WHERE n > 1 GROUP BY l, i // 2, n),
levels AS (SELECT DISTINCT l, t, n FROM up WHERE n > 1),
top_levels AS (SELECT DISTINCT l, n FROM top WHERE n > 1),
steps AS (
  SELECT o.r, v.l AS k, (o.i >> v.l) & 1 AS odd, u.h
  FROM own o JOIN levels v ON v.t IS NOT DISTINCT FROM o.lang
  LEFT JOIN up u ON u.t IS NOT DISTINCT FROM o.lang AND u.l = v.l AND u.i = xor(o.i >> v.l, 1)
  UNION ALL
  SELECT o.r, 1000 + v.l, (s.i >> v.l) & 1, u.h
  FROM own o JOIN subs s ON s.lang IS NOT DISTINCT FROM o.lang CROSS JOIN top_levels v
  LEFT JOIN top u ON u.l = v.l AND u.i = xor(s.i >> v.l, 1)),
path AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS step FROM steps),
fold AS (
  SELECT r, 0 AS step, now AS h FROM own
  UNION ALL
  SELECT f.r, f.step + 1, sha256(CASE WHEN p.odd = 1 THEN coalesce(p.h, '') || f.h
    ELSE f.h || coalesce(p.h, '') END)
  FROM fold f JOIN path p ON p.r = f.r AND p.step = f.step),
proof AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256,
    count(*) AS steps FROM path GROUP BY r)
SELECT o.doc_id, o.h AS leaf, s.h AS subroot, g.h AS root,
  coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = g.h AS verified
FROM own o JOIN subs s ON s.lang IS NOT DISTINCT FROM o.lang
JOIN (SELECT h FROM top WHERE n = 1) g ON true
LEFT JOIN proof p ON p.r = o.r
JOIN fold f ON f.r = o.r AND f.step = coalesce(p.steps, 0)"""

SQL = {
    "op11_merkle_manifest": _MERKLE.format(leaf=_leaf("n_chars"), changed=_leaf("(n_chars + 1)")),
    "op2_warc_revisits": "WITH rec AS (" + RECORDS.replace("{pages}", "pages") + "),"
    + _CANONICAL.format(url="target_uri", table="rec") + r""",
hit AS (
  SELECT r.record_id, r.canonical AS url, r.etag, r.modified, r.size, r.digest,
    p.record_id AS response_id, p.etag AS old_etag, p.modified AS old_modified,
    p.size AS old_size, p.digest AS old_digest,
    row_number() OVER (PARTITION BY r.record_id ORDER BY p.seconds DESC NULLS LAST,
                       p.record_id DESC) AS k
  FROM named r LEFT JOIN named p ON p.canonical = r.canonical AND p.seconds < r.seconds
    AND p.warc_type = 'response' AND p.status = 200
  WHERE r.warc_type = 'revisit'),
checked AS (
  SELECT *, CASE WHEN response_id IS NULL THEN NULL
      WHEN etag IS NOT NULL AND old_etag IS NOT NULL THEN 'etag'
      WHEN modified IS NOT NULL AND old_modified IS NOT NULL THEN 'last-modified'
      ELSE 'digest' END AS checked_by FROM hit WHERE k = 1),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
      WHEN (checked_by = 'etag' AND regexp_replace(etag, '^W/', '') <> regexp_replace(old_etag, '^W/', ''))
        OR (checked_by = 'last-modified' AND modified <> old_modified)
        OR (checked_by = 'digest' AND digest <> old_digest) THEN 'changed'
      ELSE 'resolved' END AS outcome FROM checked)
SELECT record_id, url, outcome, response_id, checked_by,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN concat_ws('; ', 'content-length: ' || old_size,
    'etag: ' || coalesce(etag, old_etag), 'last-modified: ' || coalesce(modified, old_modified),
    'x-record: ' || CAST(record_id AS STRING)) END AS headers
FROM judged""",
    "op3_url_filter": "WITH" + _CANONICAL.format(url="coalesce(url, '')", table="pages") + r""",
ruled AS (
  SELECT page_id, host, path, canonical,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%'
        THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%'
        THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM named),
listed AS (SELECT DISTINCT canonical FROM named
  WHERE regexp_matches(host, '(^|[.-])(adult|bets|casino|spam)([.-]|$)') AND canonical IS NOT NULL)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict,
  canonical, rule IS NULL AND coalesce(canonical IN (SELECT canonical FROM listed), false) AS listed
FROM ruled""",
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(
      [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
  FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL),
link AS (SELECT x, y FROM shared WHERE 100 * c >= 90 * (nx + ny - c)),
sym AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x),
least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles,
  least(s.doc_id, coalesce(l.y, s.doc_id)) AS component_id
FROM s LEFT JOIN least_id l ON s.doc_id = l.x""",
    "op10_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t,
    length(coalesce(text, '')) AS size FROM documents),
g AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY size DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM g""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
