"""What shows only in tables larger or more crowded than the driver's small ones."""

import threading
import uuid
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinweave.operators import pairs
from kinweave.plans.stages import Stages
from kinweave.sources.shared import written

SF = "/root/testdata/sf0.001"
BASE = ("customer", "orders", "lineitem", "events", "supplier")


def tables(folder, **changed):
    """The smallest data with some tables replaced by SQL, in which they stand in braces."""
    for t in BASE:
        sql = changed.get(t, "select * from {%s}" % t).format(**{b: f"'{SF}/{b}.parquet'" for b in BASE})
        duckdb.sql(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
    return str(folder)


def rows(found):
    return Counter(tuple(None if v is None or v != v else v for v in r) for r in found)


def follows_sql(spark, name, folder):
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = rows(entry.queries()[name](spark, folder).select(*want.columns).collect())
    assert got == rows(want.fetchall())
    return got


def test_stores_of_one_id_have_a_row_each(spark, tmp_path):
    # Ids are of four digits: stores 1003 and 10031 are both store 1003.
    folder = tables(
        tmp_path,
        lineitem="select * replace (l_suppkey + 1000 as l_suppkey) from {lineitem}",
        supplier="select * replace (s_suppkey + 1000 as s_suppkey) from {supplier} union all select * replace (s_suppkey * 10 + 10001 as s_suppkey, s_nationkey + 1 as s_nationkey) from {supplier}",
    )
    got = follows_sql(spark, "most_used_store", folder)
    assert got.total() == 2 * len({card for card, *_ in got})


def test_pairs_of_a_crowded_device_are_looked_up_not_made(spark, tmp_path):
    # 60,000 cards on one device have 1,800 million pairs; those of phones, e-mails and households are some 80,000.
    folder = tables(
        tmp_path,
        customer="select * replace (i as c_custkey) from {customer} cross join range(60000) r(i) where c_custkey = 0",
        events="select * replace (i as user_id, 5000 * ((61 - i * 7 % 61) % 61) as event_id) from {events} cross join range(60000) r(i) where event_id = 0",
    )
    late = threading.Timer(240, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = rows(entry.queries()["pairs_minus_device"](spark, folder).select("card_nbr_1", "card_nbr_2").collect())
    finally:
        late.cancel()
    alike = "(first_nm_1 <> '' and first_nm_1 = first_nm_2 and last_nm_1 <> '' and last_nm_1 = last_nm_2) or (email_address_1 <> '' and email_address_1 = email_address_2)"
    every = Stages(spark, folder).all_pairs
    assert every.where(alike).count() > 10_000
    assert got == rows(every.where(f"not ({alike})").select("card_nbr_1", "card_nbr_2").collect())


def test_pairs_of_one_device_are_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "DEVICE_PART", 64, raising=False)
    cards = spark.range(1000).selectExpr("lpad(id, 4, '0') as card_nbr")
    twice = cards.where("card_nbr = '0500'").selectExpr("card_nbr", "'b' as first_nm", "'' as last_nm", "'' as email_address")
    pii = cards.selectExpr("card_nbr", "'a' as first_nm", "'' as last_nm", "'' as email_address").unionByName(twice)
    found = pairs.device_pairs(cards.withColumn("mobile_device_id", F.lit("d")), pii)
    made = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in made) == 1000 * 999 // 2 + 999  # card 0500 has two rows
    assert found.where("card_nbr_1 >= card_nbr_2").isEmpty() and found.select("c1c2").distinct().count() == 1000 * 999 // 2
    assert len(made) > 1


def shuffled(spark, job):
    """Rows that a job shuffles."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        job()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_rows_of_a_crowded_device_are_not_dealt_out_with_its_square(spark, monkeypatch):
    monkeypatch.setattr(pairs, "DEVICE_PART", 8)

    def dealt(n):
        cards = spark.range(n).selectExpr("lpad(id, 4, '0') as card_nbr", "'a' as first_nm", "'' as last_nm", "'' as email_address")
        found = pairs.device_pairs(cards.select("card_nbr", F.lit("d").alias("mobile_device_id")), cards)
        counts = []
        dealt = shuffled(spark, lambda: counts.append(found.count()))
        assert counts == [n * (n - 1) // 2]
        return dealt

    assert dealt(2000) < 3 * dealt(1000) < 3 * 1000 * 64


def test_matches_of_a_crowded_device_in_parts_follow_their_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "DEVICE_PART", 4)
    folder = tables(
        tmp_path,
        customer="select * replace (i as c_custkey) from {customer} cross join range(600) r(i) where c_custkey = 0",
        events="select * replace (i as user_id, 5000 * ((61 - i * 7 % 61) % 61) as event_id) from {events} cross join range(600) r(i) where event_id = 0",
    )
    got = []
    dealt = shuffled(spark, lambda: got.append(follows_sql(spark, "device_match", folder)))
    assert got[0].total() > 100_000 and sum(n for row, n in got[0].items() if row[-1]) > 100
    assert dealt < 50_000


def crowd(tmp_path, n):
    """The smallest data with n cards of which all use one device."""
    return tables(
        tmp_path,
        customer=f"select * replace (i as c_custkey) from {{customer}} cross join range({n}) r(i) where c_custkey = 0",
        events=f"select * replace (i as user_id, 5000 * ((61 - i * 7 % 61) % 61) as event_id) from {{events}} cross join range({n}) r(i) where event_id = 0",
    )


def test_matches_of_a_crowded_device_are_whole_and_take_little_disk(spark, tmp_path):
    found = entry.queries()["device_match"](spark, crowd(tmp_path, 5000))
    found.write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5000 * 4999 // 2
    assert sum(p.stat().st_size for p in Path(tmp_path, "out").rglob("*.parquet")) < 0.4 * 5000 * 4999 // 2


def test_blocks_of_a_crowded_device_follow_their_sql(spark, tmp_path, monkeypatch):
    # 13 cards a block and 40 a part: blocks that parts cut, and blocks in which side 1 stands too.
    monkeypatch.setattr(pairs, "DEVICE_PART", 40)
    monkeypatch.setattr(pairs, "DEVICE_BLOCK", 13, raising=False)
    monkeypatch.setattr(pairs, "DEVICE_TASK", 1000, raising=False)
    for name in ("device_match", "device_pairs", "device_features"):
        (tmp_path / name).mkdir()
        got = follows_sql(spark, name, crowd(tmp_path / name, 300))
        assert got.total() == 300 * 299 // 2


def test_shuffles_of_a_written_table_are_removed(spark, tmp_path):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    shuffles = lambda: {f for f in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before, switch = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    table = written(grouped, "grouped", shuffles_go=True)
    assert not shuffles() - before
    assert table.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == switch
    assert len(grouped.collect()) == 7 and shuffles() - before  # others keep theirs
    # Those of device_match are all gone before its pairs are made, but for some of a sum over devices.
    folder, before = crowd(tmp_path, 300), shuffles()
    entry.queries()["device_match"](spark, folder)
    assert len(shuffles() - before) <= 12
