"""Landed files, stores and streams over temporary folders."""

import json

from pyspark.sql import functions as F

from attestry.plans.adapters import TABLES, Tables
from attestry.sources import landed as L
from attestry.sources import stores
from attestry.streaming import streams as ST

SF = "/root/testdata/sf0.001"


def test_work_list_csv_with_mark(spark, tmp_path):
    (tmp_path / "w.csv").write_text(
        "service_id,service_name,resource_id,resource_name,resource_website,service_edit_url,"
        "service_updated_at\n1,Food,5,Org,,,2026\n2,,x7,Org,,https://e,2026\n"
        "3,Beds, 5 ,Org,,https://e/5,2026\n", encoding="utf-8-sig")
    work = L.read_work_list(spark, str(tmp_path / "w.csv"))
    assert work.columns[0] == "service_id" and work.count() == 3
    idx = L.work_list_index(work).collect()
    assert [(r["resource_id"], r["service_edit_url"], r["n_curated"]) for r in idx] == [
        (5, "https://e/5", 2)]
    names = L.curated_services(work).orderBy("row_no").collect()
    assert [r["service_name"] for r in names] == ["Food", "Beds"]


def test_listing_files(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "1.json").write_text(json.dumps({"resource": {
        "id": 1, "name": "A", "status": "approved", "phones": [{"id": 9, "number": "1"}]}}, indent=1))
    (docs / "2.json").write_text(json.dumps([{"id": 2, "name": "B", "status": "inactive"},
                                             {"id": 3, "name": "C", "status": "approved"}]))
    (docs / "3.json").write_text("{broken")
    (docs / "4.json").write_text(json.dumps({"id": 4, "status": "approved"}))
    got = L.read_listings(spark, str(docs))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3]
    assert sorted(r["id"] for r in L.read_listings(spark, str(docs), approved_only=True)
                  .collect()) == [1, 3]
    assert L.read_listings(spark, str(docs), listing_id=3).count() == 1


def test_missing_ids_ascending_cap(spark):
    idx = spark.createDataFrame([(i,) for i in (5, 3, 9, 1)], "resource_id bigint")
    have = spark.createDataFrame([(1,), (9,)], "id bigint")
    assert sorted(r[0] for r in L.missing_ids(idx, have).collect()) == [3, 5]
    assert [r[0] for r in L.missing_ids(idx, have, 2).collect()] == [3]


def test_outcome_log_quarantine(spark, tmp_path):
    folder = tmp_path / "log" / "outcome=approved"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"resource_id":"7","action":"confirm"}\n{"resource_id": "8\n')
    good, bad = stores.read_outcomes(spark, str(tmp_path / "log"))
    assert [(r["resource_id"], r["outcome"]) for r in good.collect()] == [("7", "approved")]
    assert bad.count() == 1


def test_claim_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026", "A"), (2, None, None)],
                                 "id bigint, updated_at string, name string")
    first = rows.withColumn("version", stores.version_key())
    stores.append_claims(first.filter("id = 1").select("version"), str(tmp_path / "claims"))
    saved = spark.read.parquet(str(tmp_path / "claims"))
    assert [r["id"] for r in stores.new_versions(rows, saved).collect()] == [2]
    moved = rows.withColumn("updated_at", F.lit("2027"))
    assert stores.new_versions(moved, saved).count() == 2


def test_two_taps_record_one_decision(spark, tmp_path):
    src = tmp_path / "in"
    schema = "resource_id string, action string, decided_at timestamp"
    rows = [("1", "confirm", "2026-01-01 10:00:00"), ("1", "confirm", "2026-01-01 10:00:01"),
            ("2", "skip", "2026-01-01 10:00:00"), ("3", "reject", "2026-01-01 11:00:00")]
    spark.createDataFrame(rows, "resource_id string, action string, decided_at string").withColumn(
        "decided_at", F.to_timestamp("decided_at")).write.parquet(str(src))
    df = spark.read.schema(schema).parquet(str(src))
    stream = ST.timed(ST.read_stream(spark, df.schema, str(src)), "decided_at")
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    for _ in range(2):  # a restart replays nothing
        ST.write_decisions(ST.decision_log(stream), out, chk).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted((r["resource_id"], r["outcome"]) for r in got) == [
        ("1", "approved"), ("3", "rejected")]


def test_a_later_batch_does_not_decide_again(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    schema = "resource_id string, action string, decided_at timestamp"

    def arrive(*rows):
        spark.createDataFrame(rows, "resource_id string, action string, decided_at string").select(
            "resource_id", "action", F.to_timestamp("decided_at").alias("decided_at")).coalesce(
            1).write.mode("append").parquet(src)
        stream = ST.timed(ST.read_stream(
            spark, spark.createDataFrame([], schema).schema, src), "decided_at")
        ST.write_decisions(ST.decision_log(stream), out, chk).awaitTermination()

    arrive(("1", "reject", "2026-01-01 10:05:00"), ("1", "confirm", "2026-01-01 10:00:00"))
    arrive(("1", "reject", "2026-01-20 10:00:00"), ("2", "reject", "2025-12-01 10:00:00"))
    got = spark.read.parquet(out).collect()
    assert sorted((r["resource_id"], r["outcome"]) for r in got) == [
        ("1", "approved"), ("2", "rejected")]


def test_first_decisions_hold_state_by_key_and_read_no_log(spark, tmp_path):
    """Three triggers; the log may even be gone, the first decision still holds."""
    src, chk = str(tmp_path / "in"), str(tmp_path / "chk")
    schema = "resource_id string, action string, decided_at timestamp"
    for n, rows in enumerate([[("1", "reject"), ("2", "confirm")], [("1", "confirm")],
                              [("2", "reject"), ("3", "confirm"), ("1", "reject")]]):
        spark.createDataFrame([(k, a, f"2026-01-0{5 - n} 10:00:00") for k, a in rows],
                              "resource_id string, action string, decided_at string").select(
            "resource_id", "action", F.to_timestamp("decided_at").alias("decided_at")).coalesce(
            1).write.mode("append").parquet(src)
        stream = ST.timed(ST.read_stream(
            spark, spark.createDataFrame([], schema).schema, src), "decided_at")
        out = str(tmp_path / f"out{n}")  # a folder of its own per trigger
        ST.write_decisions(ST.decision_log(stream), out, chk).awaitTermination()
        got = {(r.resource_id, r.outcome) for r in spark.read.schema(
            "resource_id string, outcome string").parquet(out).collect()} if (
            tmp_path / f"out{n}").exists() else set()
        assert got == [{("1", "rejected"), ("2", "approved")}, set(), {("3", "approved")}][n]


def test_latest_table_merges_batches_and_bounds_folders(spark, tmp_path):
    path, want = str(tmp_path / "t"), {}
    table = ST.LatestTable(spark, path, ["k"], most=3)
    assert table.folders() == [] and table.held() == -1
    for n in range(11):
        rows = [(f"k{(n * 7 + j) % 9}", n * 10 + j) for j in range(3)]
        table.write(spark.createDataFrame(rows, "k string, v int"), n)
        want.update(rows)
        assert len(table.folders()) <= 4
        assert {r.k: r.v for r in table.read().collect()} == want
        again = ST.LatestTable(spark, path, ["k"], most=3)  # a reader or a restart
        again.write(spark.createDataFrame(rows, "k string, v int"), n)
        assert {r.k: r.v for r in again.read().collect()} == want
    assert table.held() >= 7


def test_remaining_queue_follows_every_trigger(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    schema = "resource_id string, action string, decided_at timestamp, row_no bigint"
    queue = spark.createDataFrame([(str(i),) for i in range(6)], "resource_id string")
    done = set()
    for n, rows in enumerate([[("1", "confirm"), ("2", "skip")], [("2", "reject")],
                              [("9", "confirm"), ("1", "reject")], [("5", "looks_right")]]):
        spark.createDataFrame([(k, a, "2026-01-01 10:00:00", n) for k, a in rows],
                              "resource_id string, action string, t string, row_no bigint").select(
            "resource_id", "action", F.to_timestamp("t").alias("decided_at"), "row_no").coalesce(
            1).write.mode("append").parquet(src)
        stream = ST.timed(ST.read_stream(
            spark, spark.createDataFrame([], schema).schema, src), "decided_at")
        ST.write_updates(ST.latest_by_resource(stream), out, chk, ["resource_id"],
                         most=2).awaitTermination()
        done |= {k for k, a in rows if a != "skip"}
        table = ST.LatestTable(spark, out, ["resource_id"])
        left = ST.remaining_queue(queue, table.read())
        assert {r.resource_id for r in left.collect()} == {str(i) for i in range(6)} - done
        assert len(table.folders()) <= 3


def test_views_cover_every_table(spark):
    t = Tables(spark, SF)
    assert all(getattr(t, n).columns for n in TABLES)


def test_work_list_quotes_breaks_and_file_order(spark, tmp_path):
    from attestry.sources import landed as L

    head = "resource_id,service_name,service_edit_url\n"
    (tmp_path / "a.csv").write_text(head + '1,"He said ""hi"", ok",\n1,"two\nlines",http://first\n')
    (tmp_path / "b.csv").write_text(head + "1,x,http://second\n" + "2,y,\n" * 200)
    work = L.read_work_list(spark, str(tmp_path))
    names = {r["service_name"] for r in L.curated_services(work).filter("resource_id = 1").collect()}
    assert names == {'He said "hi", ok', "two\nlines", "x"}
    first = L.work_list_index(work).filter("resource_id = 1").first()
    assert first["service_edit_url"] == "http://first"
