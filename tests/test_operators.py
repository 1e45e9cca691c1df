import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import classify, cleaning, evaluate, graph, identity, incremental, pairs
from kinweave.sources import shared
from kinweave.sources.catalog import Catalog, empty, literal


def test_components_on_chain_star_loop_and_nothing(spark):
    rng = random.Random(1)
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("s000", f"s{i:03}") for i in range(1, 40)] + [("z", "z"), (None, "q"), ("a", ""), ("b", ""), ("", "d")]
    rng.shuffle(edges)
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {f"c{i:03}": "c000" for i in range(61)} | {f"s{i:03}": "s000" for i in range(40)} | {"z": "z"}
    assert graph.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_a_shared_phone_gives_all_pairs_and_one_person(spark):
    rows = [(c, "2065551234", c.lower(), "x", "", d) for c, d in (("A", "2024"), ("B", "2023"), ("C", None))]
    pii = spark.createDataFrame(rows, "card_nbr string, phone string, first_nm string, last_nm string, email_address string, first_txn_dte string").withColumns({"first_used_store_id": F.lit("1"), "first_upc": F.lit("1")})
    p = pairs.record_pairs(pii, "phone")
    assert sorted(r.c1c2 for r in p.collect()) == ["AB", "AC", "BC"]
    ids = identity.person_ids(pii, graph.connected_components(p, "card_nbr_1", "card_nbr_2"))
    assert {r.shopper_first_card_nbr for r in ids.collect()} == {"B"} and ids.select("shopper_id").distinct().count() == 1
    assert evaluate.reduction(ids).first().person_reduction == pytest.approx(2 / 3)
    assert pairs.household_pairs(pii, "phone").count() == 3 and pairs.household_stars(pii, "phone").count() == 2
    with pytest.raises(ValueError):
        pairs.household_pairs(pii, "first_nm")


def test_households_are_linked_by_all_five_keys(spark):
    from kinweave.plans.stages import Stages

    blank = dict.fromkeys(("phone", "address", "first_nm", "last_nm", "first_used_store_id", "len_add", "len_add_comp", "email_address", "household_id"), "")
    links = [("shopper_id", "01", "02"), ("phone", "02", "03"), ("email_address", "03", "04"), ("household_id", "04", "05")]
    cards = {c: {**blank, "card_nbr": c, "shopper_id": c} for c in ("01", "02", "03", "04", "05", "06", "07")}
    for key, a, b in links:
        cards[a][key] = cards[b][key] = "2065551234" if key == "phone" else f"same {key}"
    s = Stages(spark, "unused")
    s.person_cards = spark.createDataFrame([tuple(c[k] for k in cards["01"]) for c in cards.values()], ", ".join(f"{k} string" for k in cards["01"]))
    assert {r.id: r.component for r in s.whole_household_components.collect()} == dict.fromkeys(("01", "02", "03", "04", "05"), "01")


def test_cleaning_rules(spark):
    df = spark.createDataFrame([("1", "john adams", "De la Cruz", "Anna@Gmail.com", "123 Main Ave", "Apt5B", "2065551234"), ("2", None, "", "bad..@x", "PO Box 1", None, "8005551234")], "card_nbr string, first_nm string, last_nm string, email_address string, address_line1 string, address_line2 string, phone string")
    profane, suffixes = spark.createDataFrame([("spam",)], "invalid_name string"), spark.createDataFrame([("avenue", "ave")], "full string, v string")
    a, b = cleaning.clean_accounts(df, profane, suffixes).orderBy("card_nbr").collect()
    assert (a.first_nm, a.email_address, a.address, a.is_valid_phone_number) == ("johdams", "an@gmail.com", "123 maive apt 5 b", "true")
    assert (b.first_nm, b.email_address, b.address, b.phone) == ("", "", "", "")
    a = cleaning.clean_accounts(df, profane, suffixes, legacy_scrub=False).orderBy("card_nbr").first()
    assert (a.first_nm, a.email_address, a.address) == ("john", "anna@gmail.com", "123 main avenue apt 5 b")


def test_too_many_suffixes_are_an_error_not_cut(spark):
    with pytest.raises(ValueError):
        cleaning.suffix_map(spark.range(10_001).selectExpr("concat('full', id) as full", "concat('v', id) as v"))


def test_device_stars_have_the_components_of_matched_pairs(spark):
    people = [("1", "ann", "lee", "a@x"), ("2", "ann", "lee", None), ("3", "bob", "lee", "a@x"), ("4", None, "lee", "z@x"), ("5", "eve", None, "z@x"), ("6", "ann", "lee", "")]
    pii = spark.createDataFrame(people, "card_nbr string, first_nm string, last_nm string, email_address string")
    devices = spark.createDataFrame([(c, "d1") for c in "123456"] + [("1", "d2"), ("5", "d2"), ("9", "d2"), ("", "d1"), ("2", None)], "card_nbr string, mobile_device_id string")
    found = pairs.device_pairs(devices, pii)
    assert {r.c1c2 for r in found.collect()} == {"12", "13", "15", "16", "23", "25", "26", "35", "36", "56"}  # card 4 has no first name, card 9 no contact data
    matched = classify.rule_match(classify.rule_features(found)).where("prediction = 1")
    assert {r.c1c2 for r in matched.collect()} == {"12", "13", "16", "26"}
    whole = graph.connected_components(matched, "card_nbr_1", "card_nbr_2").collect()
    assert set(whole) == set(graph.connected_components(pairs.device_match_stars(devices, pii), "card_nbr_1", "card_nbr_2").collect())
    assert pairs.device_pairs(devices, pii, cap=4).count() == 1
    alone = pairs.device_pairs(devices, pii.select("card_nbr", "email_address"))
    assert {r.c1c2 for r in alone.where("mobile_device_id = 'd2'").collect()} == {"15", "19", "59"}


def test_unions_of_one_table_of_several_and_of_none(spark):
    a = spark.createDataFrame([("1", "2", "1-2")], "card_nbr_1 string, card_nbr_2 string, paired_cards string")
    a.createOrReplaceTempView("some_pairs")
    assert pairs.union_household_pairs([]).count() == 0 and pairs.union_household_pairs([]).columns == a.columns and pairs.union_pairs([]).count() == 0
    for parts in (a, [a], "some_pairs", ["some_pairs", a]):
        assert pairs.union_household_pairs(parts).collect() == a.collect()
    assert pairs.union_pairs([a, "some_pairs"]).count() == 2 and pairs.union_pairs("some_pairs", distinct=True).count() == 1


def test_literals(spark):
    values = [None, True, 7, 1.5, "O'Neil \\ x", datetime.date(2024, 2, 3), datetime.datetime(2024, 2, 3, 4, 5, 6), decimal.Decimal("1.20")]
    assert list(spark.sql("select " + ", ".join(map(literal, values))).first()) == values
    with pytest.raises(TypeError):
        literal([1])


def test_area_codes(spark):
    df = spark.createDataFrame([("2065551234",), ("3125551234",), ("(206) 555-1234",)], "phone string")
    codes = spark.createDataFrame([(206,)], "area_code int")
    got = [r.is_valid_phone_number for r in cleaning.phone_validity(df, area_codes=codes).collect()]
    assert got == [True, False, True]
    assert cleaning.phone_validity(df, normalize=True).collect()[2].phone == "2065551234"


def test_classifier_learns_and_thresholds_strictly(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.random() < 0.3), rng.random()) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, int(a + b > 1.2)) for i, a, b in rows], "i int, a double, b double, target int")
    model = classify.train(df, ["a", "b"], "target")
    got = classify.predictions(model, df).collect()
    assert sum(r.prediction == r.target for r in got) > 290 and all(abs(r.prob_0 + r.prob_1 - 1) < 1e-6 for r in got)
    most = max(r.prob_1 for r in got)
    assert classify.predictions(model, df, most).where("prediction = 1").count() == 0
    assert [tuple(r) for r in classify.predictions(classify.train(df, ["a", "b"], "target"), df).collect()] == [tuple(r) for r in got]


def test_tables_are_removed_when_done(spark):
    t = shared.written(spark.range(3), "t")
    assert t.count() == 3
    shared.remove(t)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(t._kinweave_path).count()


def test_inserts_are_idempotent_and_snapshots_keep_the_newest(spark):
    full, new = spark.createDataFrame([("1", "a")], "card_nbr string, x string"), spark.createDataFrame([("1", "b"), ("2", "c")], "card_nbr string, x string")
    once = identity.insert_unseen(full, new, ["card_nbr", "x"])
    assert sorted(map(tuple, once.collect())) == [("1", "a"), ("2", "c")] == sorted(map(tuple, identity.insert_unseen(once, new, ["card_nbr", "x"]).collect()))
    rows = spark.createDataFrame([("1", "2023", "p"), ("1", "2024", "q"), ("1", None, "r")], "card_nbr string, dw_last_update_ts string, phone string")
    assert [r.phone for r in incremental.one_row_a_card(rows).collect()] == ["q"]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}", user="me")
    assert "me" not in repr(c)
    with pytest.raises(NameError):
        c.set_option("nonsense", "1")
    c.write(spark.createDataFrame([(1,)], "A int"), "t")
    assert c.read("t").columns == ["a"] and "rows" in c.check_exists("t")
    c.append(spark.createDataFrame([(2,)], "A int"), "t")
    assert c.read("t").count() == 2
    c.truncate("t")
    with pytest.raises(ValueError):
        c.check_exists("t")
    with pytest.raises(ValueError):
        c.run("drop nonsense", "t")
    assert empty(spark, "a", "b").columns == ["a", "b"]


def test_an_identity_stream_adds_only_unseen_cards(spark, tmp_path):
    from kinweave.streaming.maintain import insert_stream

    source, full, state = (f"file://{tmp_path}/{n}" for n in ("in", "full", "state"))
    spark.createDataFrame([("1", "old")], "card_nbr string, shopper_first_card_nbr string").write.parquet(full)
    spark.createDataFrame([("1",), ("2",)], "card_nbr string").write.parquet(source)
    stream = spark.readStream.schema("card_nbr string").parquet(source)
    for _ in range(2):
        q = insert_stream(stream, lambda: spark.read.parquet(full), lambda df: df.write.mode("append").parquet(full), ["card_nbr", "shopper_first_card_nbr"], lambda df: identity.person_ids(df, None, hashed=False), state).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(full).collect())) == [("1", "old"), ("2", "2")]


def test_numbers_follow_the_order_over_all_partitions(spark):
    rows = [(random.Random(i).randrange(40), i) for i in range(200)]
    got = pairs.numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.rn)] == sorted(rows) and sorted(r.rn for r in got) == list(range(1, 201))
    assert pairs.numbered(spark.createDataFrame([], "a int"), "a").count() == 0
