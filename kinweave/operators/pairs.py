"""Candidate pairs by blocking, for persons, devices and households.

A block is a key value that more than one and not too many different cards share. Blocks are counted with partial
aggregates, then joined with themselves on the key; the smaller card (as a string) is side 1. Where all pairs of a block
count as one household, star edges give the same components with a row a card instead of a pair.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions import text as T
from kinweave.sources.catalog import empty
from kinweave.sources.shared import written

PERSON_CAP, HOUSEHOLD_CAP = 10_000, 10_000
#: Fewest cards of a part of a device, and meetings of two parts that a task has where parts are larger; no limits on the cards
#: of a device. DEVICE_BLOCK: cards of a part that stand in one array. DEVICE_TASK: pairs from which on there are more tasks.
DEVICE_PART, DEVICE_MEETINGS, DEVICE_BLOCK, DEVICE_TASK = 2048, 8, 512, 2**26
PERSON_KEYS = ("phone", "email_address", "household_id")
HOUSEHOLD_KEYS = ("shopper_id", "phone", "email_address", "household_id", "multi_key")
ROLES = ("card_nbr", "household_id", "phone", "first_nm", "last_nm", "email_address", "email_user", "address", "gender", "first_txn_dte", "first_used_store_id", "first_used_zip_code", "first_upc")


def block_sizes(cards: DataFrame, key: str, cap: int = PERSON_CAP, inclusive: bool = False) -> DataFrame:
    """key and cnt of the blocks of more than one and fewer than cap cards (or as many as cap)."""
    sizes = cards.where(T.valid(F.col(key))).groupBy(key).agg(F.countDistinct("card_nbr").alias("cnt"))
    return sizes.where((F.col("cnt") > 1) & ((F.col("cnt") <= cap) if inclusive else (F.col("cnt") < cap)))


def has_name_or_email(df: DataFrame) -> Column:
    known = [T.valid(F.col(c)) for c in ("first_nm", "last_nm") if c in df.columns]
    names = reduce(lambda a, b: a & b, known) if known else F.lit(False)
    return names | T.valid(F.col("email_address")) if "email_address" in df.columns else names


def record_pairs(pii: DataFrame, key: str, cap: int = PERSON_CAP, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """c1c2 and every role of both records. The name-or-e-mail condition holds for record 1 alone."""
    roles = tuple(r for r in roles if r in pii.columns)
    keyed = pii.where(T.valid(F.col(key))).join(block_sizes(pii, key, cap).select(key), key, "left_semi")
    left = keyed.where(has_name_or_email(keyed)).select(F.col(key).alias("_k"), *[F.col(r).alias(f"{r}_1") for r in roles]).distinct()
    right = keyed.select(F.col(key).alias("_k"), *[F.col(r).alias(f"{r}_2") for r in roles]).distinct()
    pairs = left.join(right, "_k").where("card_nbr_1 < card_nbr_2")
    return pairs.select(F.concat("card_nbr_1", "card_nbr_2").alias("c1c2"), *[f"{r}_{i}" for r in roles for i in (1, 2)])


def _parts(parts: list[DataFrame | str] | DataFrame | str) -> list[DataFrame]:
    """One table or several, as frames or by name."""
    parts = parts if isinstance(parts, list) else [parts]
    return [SparkSession.active().table(p) if isinstance(p, str) else p for p in parts]


def union_pairs(parts: list[DataFrame | str] | DataFrame | str, distinct: bool = False) -> DataFrame:
    """All pairs of all keys, one behind the other; distinct drops equal rows. No tables give no rows of two card columns."""
    found = _parts(parts)
    out = reduce(DataFrame.unionByName, found) if found else empty(SparkSession.active(), "card_nbr_1", "card_nbr_2")
    return out.distinct() if distinct else out


def _device_roles(pii: DataFrame) -> list[str]:
    wanted = [c for c in ("first_nm", "last_nm", "email_address") if c in pii.columns]
    if not ({"first_nm", "last_nm"} <= set(wanted) or "email_address" in wanted):
        raise ValueError("device pairs need first and last names or e-mail addresses")
    return wanted


def _seen(devices: DataFrame) -> DataFrame:
    return devices.where(T.valid(F.col("mobile_device_id")) & T.valid(F.col("card_nbr"))).select("card_nbr", "mobile_device_id").distinct()


def device_rows(devices: DataFrame, pii: DataFrame) -> DataFrame:
    """card_nbr, mobile_device_id, and names and e-mail of the card, of devices that several cards use.

    Cards keep their row where the contact data has none of them, unless there is a first name to know: those without one go.
    """
    wanted = _device_roles(pii)
    rows = _seen(devices).join(pii.select("card_nbr", *wanted).distinct(), "card_nbr", "left")
    rows = rows.where(F.col("first_nm").isNotNull()) if "first_nm" in wanted else rows
    shared = rows.groupBy("mobile_device_id").agg(F.countDistinct("card_nbr").alias("cnt")).where(F.col("cnt") > 1)
    return rows.join(shared, "mobile_device_id").select("card_nbr", "mobile_device_id", *wanted, "cnt")


def device_pairs(devices: DataFrame, pii: DataFrame, cap: int | None = None, blocks: bool = False) -> DataFrame:
    """c1c2, mobile_device_id, and card, names and e-mail of both cards of each pair that shares a device.

    cap: most cards of a device. The rule has none; a device of very many cards has a row for each pair of them, so where only
    the matches' components are wanted, device_match_stars() is the way.
    blocks: pairs in an order that a columnar file of cards and outcome holds in few bytes; pairs with all columns take longer so.
    """
    rows = device_rows(devices, pii)
    rows = rows.where(F.col("cnt") <= cap) if cap else rows
    wanted = [c for c in rows.columns if c not in ("card_nbr", "mobile_device_id", "cnt")]
    # Cards of a device in order, in parts: each two parts meet by themselves, so a crowded device is many tasks' work. Equal
    # cards are numbered alike, so that they are in one part.
    place = F.dense_rank().over(Window.partitionBy("mobile_device_id").orderBy("card_nbr"))
    rows = written(rows.withColumn("_place", place), "device_rows", shuffles_go=True)
    # A row is dealt out once for each part that it meets, so parts are as large as leaves each task its meetings: of one
    # size, they would be dealt out with the square of a device's cards.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("mobile_device_id").agg(F.max("cnt").cast("double").alias("cnt"))
    met = sizes.agg(F.sum(F.col("cnt") * F.col("cnt"))).first()[0] or 0.0
    part = max(DEVICE_PART, math.ceil(math.sqrt(met / (2 * DEVICE_MEETINGS * tasks))))
    tasks = max(tasks, min(DEVICE_MEETINGS * tasks, math.ceil(met / (2 * DEVICE_TASK)))) if blocks else tasks
    at = lambda n: F.floor((F.col("_place") - 1) / n).cast("int")
    rows = rows.withColumn("_part", at(part)).withColumn("_last", F.floor((F.col("cnt") - 1) / part).cast("int")).withColumn("_block", at(DEVICE_BLOCK))
    side = lambda i: [F.col(c).alias(f"{c}_{i}") for c in (*wanted, "card_nbr")]
    left = rows.select("mobile_device_id", F.col("_part").alias("_a"), F.explode(F.sequence("_part", "_last")).alias("_b"), *side(1))
    right = rows.select("mobile_device_id", F.explode(F.sequence(F.lit(0), "_part")).alias("_a"), F.col("_part").alias("_b"), "_block", *side(2))
    # A number is given, as by their bytes AQE would have one task make all pairs of some thousand cards.
    by = ["mobile_device_id", "_a", "_b"]
    left, right = left.repartition(tasks, *by), right.repartition(tasks, *by)
    if blocks:
        # Side 2 stands in arrays of a block, by names, and each card of side 1 goes through one array after the other: so pairs
        # come out in short rounds of the same cards, and of runs of the same outcome.
        block = F.array_sort(F.collect_list(F.struct(*[f"{c}_2" for c in (*wanted, "card_nbr")])))
        arrays = right.groupBy(*by, "_block").agg(F.max("card_nbr_2").alias("_top"), block.alias("_cards"))
        # Merged, so that the arrays are what is gone through once.
        meetings = arrays.hint("merge").join(left, by).where("_a < _b or card_nbr_1 < _top")
        pairs = meetings.select(*by, *[f"{c}_1" for c in (*wanted, "card_nbr")], F.inline("_cards"))
    else:
        pairs = left.join(right.drop("_block"), by)
    pairs = pairs.where("_a < _b or card_nbr_1 < card_nbr_2")
    return pairs.select(F.concat("card_nbr_1", "card_nbr_2").alias("c1c2"), "mobile_device_id", *[f"{c}_{i}" for c in ("card_nbr", *wanted) for i in (1, 2)])


def device_match_stars(devices: DataFrame, pii: DataFrame) -> DataFrame:
    """card_nbr_1, card_nbr_2: cards of one device with equal known names, both of them, or equal known e-mails, each with the
    first card of its kind. Components are those of the matched device pairs, with a row a card instead of a pair."""
    rows = device_rows(devices, pii)
    kinds = [k for k in (("first_nm", "last_nm"), ("email_address",)) if set(k) <= set(rows.columns)]
    out = []
    for kind in kinds:
        known = rows.where(reduce(lambda a, b: a & b, [T.valid(F.col(c)) for c in kind])).select("mobile_device_id", *kind, "card_nbr").distinct()
        first = known.groupBy("mobile_device_id", *kind).agg(F.min("card_nbr").alias("card_nbr_1"))
        out.append(known.join(first, ["mobile_device_id", *kind]).where("card_nbr_1 < card_nbr").select("card_nbr_1", F.col("card_nbr").alias("card_nbr_2")))
    return union_pairs(out, distinct=True)


def device_matched(asked: DataFrame, devices: DataFrame, pii: DataFrame) -> DataFrame:
    """card_nbr_1, card_nbr_2 of the asked pairs that are among the matched device pairs: equal known names, both of them, or
    equal known e-mails, and a device of both. The asked pairs are looked up, so no device's pairs are made."""
    wanted = _device_roles(pii)
    kinds = [k for k in (("first_nm", "last_nm"), ("email_address",)) if set(k) <= set(wanted)]
    people = pii.select("card_nbr", *wanted).distinct()
    people = people.where(F.col("first_nm").isNotNull()) if "first_nm" in wanted else people
    side = lambda i: people.select(*[F.col(c).alias(f"{c}_{i}") for c in ("card_nbr", *wanted)])
    same = lambda c: T.both_valid(F.col(f"{c}_1"), F.col(f"{c}_2")) & (F.col(f"{c}_1") == F.col(f"{c}_2"))
    alike = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [same(c) for c in k]) for k in kinds])
    cards = ["card_nbr_1", "card_nbr_2"]
    found = asked.where("card_nbr_1 < card_nbr_2").select(*cards).distinct().join(side(1), "card_nbr_1").join(side(2), "card_nbr_2").where(alike).select(*cards).distinct()
    seen = _seen(devices)
    found = found.join(seen.withColumnRenamed("card_nbr", "card_nbr_1"), "card_nbr_1")
    return found.join(seen.withColumnRenamed("card_nbr", "card_nbr_2"), ["card_nbr_2", "mobile_device_id"], "left_semi").select(*cards).distinct()


def device_cards(devices: DataFrame) -> DataFrame:
    """mobile_device_id, cnt and cards (different cards, in order, by commas) of the devices of more than one card."""
    known = devices.where(T.valid(F.col("mobile_device_id")) & T.valid(F.col("card_nbr"))).groupBy("mobile_device_id").agg(F.collect_set("card_nbr").alias("all"))
    known = known.select("mobile_device_id", F.size("all").cast("long").alias("cnt"), F.array_join(F.array_sort("all"), ",").alias("cards"))
    return known.where("cnt > 1")


def numbered(rows: DataFrame, *by: str, name: str = "rn") -> DataFrame:
    """rows with their place, from 1, in the order of the columns by; equal ones in any order.

    Rows are dealt out by ranges and numbered within each; the ranges' sizes, one row a partition, give what comes before.
    """
    ranged = written(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranged")
    # One row a partition of the shuffle, so this window and the broadcast are small whatever the input.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return ranged.withColumn("_at", within).join(F.broadcast(sizes), "_range").select(*rows.columns, (F.col("_before") + F.col("_at")).alias(name))


def without_pairs(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs that are not in done; a pair is known by its two cards, not by their concatenation."""
    return pairs.join(done.select("card_nbr_1", "card_nbr_2").distinct(), ["card_nbr_1", "card_nbr_2"], "left_anti")


def with_multi_key(cards: DataFrame) -> DataFrame:
    """multi_key: area and exchange of the phone, address, names and store, where all are known and long enough."""
    parts = [F.substring("phone", 1, 6), F.col("address"), F.col("first_nm"), F.col("last_nm"), F.col("first_used_store_id")]
    whole = reduce(lambda a, b: a & b, [T.valid(F.trim(p)) for p in parts])
    long = (F.col("len_add").cast("int") >= 3) & (F.col("len_add_comp").cast("int") >= 3) & (F.length("first_nm") >= 2) & (F.length("last_nm") >= 2)
    return cards.withColumn("multi_key", F.when(whole & long, F.concat_ws("-", *parts)))


def household_pairs(cards: DataFrame, key: str, cap: int = HOUSEHOLD_CAP) -> DataFrame:
    """group_col, card_nbr_1, card_nbr_2, paired_cards of the cards that share a key value."""
    if key not in HOUSEHOLD_KEYS:
        raise ValueError(f"households are not formed by {key!r} but by one of {', '.join(HOUSEHOLD_KEYS)}")
    cards = with_multi_key(cards) if key == "multi_key" else cards
    keyed = cards.where(T.valid(F.col(key))).join(block_sizes(cards, key, cap, True).select(key), key, "left_semi").select(F.col(key).alias("group_col"), "card_nbr").distinct()
    pairs = keyed.withColumnRenamed("card_nbr", "card_nbr_1").join(keyed.withColumnRenamed("card_nbr", "card_nbr_2"), "group_col").where("card_nbr_1 < card_nbr_2")
    return pairs.withColumn("paired_cards", F.concat_ws("-", "card_nbr_1", "card_nbr_2"))


def household_stars(cards: DataFrame, key: str, cap: int = HOUSEHOLD_CAP) -> DataFrame:
    """card_nbr_1, card_nbr_2: each card of a block with the block's smallest. Components are those of household_pairs."""
    cards = with_multi_key(cards) if key == "multi_key" else cards
    blocks = cards.where(T.valid(F.col(key))).groupBy(key).agg(F.countDistinct("card_nbr").alias("cnt"), F.min("card_nbr").alias("card_nbr_1"))
    blocks = blocks.where((F.col("cnt") > 1) & (F.col("cnt") <= cap)).drop("cnt")
    members = cards.where(T.valid(F.col(key))).select(key, F.col("card_nbr").alias("card_nbr_2")).distinct()
    return members.join(blocks, key).where("card_nbr_1 < card_nbr_2").select("card_nbr_1", "card_nbr_2")


def union_household_pairs(parts: list[DataFrame | str] | DataFrame | str) -> DataFrame:
    """card_nbr_1, card_nbr_2, paired_cards of all keys, each pair once. One table or several, as frames or by name; none gives no rows."""
    columns = ("card_nbr_1", "card_nbr_2", "paired_cards")
    found = [p.select(*columns) for p in _parts(parts)] or [empty(SparkSession.active(), *columns)]
    return reduce(DataFrame.unionByName, found).dropDuplicates(["card_nbr_1", "card_nbr_2"])
