import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinweave.functions import text as T
from kinweave.operators import pairs
from kinweave.plans.stages import Stages
from kinweave.sources.shared import written

SF = "/root/testdata/sf0.001"
SOME = ["clean_int", "hash_15", "lev_ratio_alnum", "gen_lev", "soundex", "fuzz_jw_alnum", "pairs_numbered", "device_cards", "phone_validity", "name_clean", "email_clean", "address_clean", "gender_nb", "pairs_phone", "device_match", "person_ids", "incremental_cards", "most_used_store", "name_in_email_rich", "device_match_rich", "hh_pairs_email_rich", "hh_components_whole", "source_read", "sink_append", "sink_truncate", "statements", "table_exists", "table_fresh_both"]


def plain(v):
    return None if v is None or v != v else v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", SOME)
def test_queries_follow_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "supplier"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in columns]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(want.columns) == columns
    assert sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=key) == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=key)


def test_rules_act_on_the_rich_accounts(spark):
    s = Stages(spark, SF, rich=True)
    matched = s.device_matches.where("prediction = 1")
    assert matched.count() > 10
    pairs_ = written(pairs.record_pairs(s.table, "phone"), "pairs")
    assert pairs_.where(T.name_in_email(F.col("first_nm_1"), F.col("first_nm_2"), F.col("email_user_1")) == 1).count() > 10
    assert pairs.without_pairs(pairs_, matched).count() < pairs_.count()
    assert pairs.household_pairs(s.table, "email_address").count() > 10


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
