"""Incremental maintenance: snapshots, the cards to work on anew, and their purchases and devices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import text as T

LINKS = ("phone", "household_id", "email_address")


def one_row_a_card(df: DataFrame, key: str = "card_nbr", newest: str = "dw_last_update_ts") -> DataFrame:
    """The newest row of each card; of equals the first by all columns."""
    rest = [F.col(c).asc_nulls_last() for c in sorted(df.columns) if c not in (key, newest)]
    turn = Window.partitionBy(key).orderBy(F.col(newest).desc_nulls_last(), *rest)
    return df.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")


def incremental_cards(current: DataFrame, previous: DataFrame, incremental: bool = True) -> DataFrame:
    """card_nbr of new cards and of those that share a phone, household or e-mail with one; all cards if not incremental."""
    if not incremental:
        return current.select("card_nbr").distinct()
    new = current.join(previous.select("card_nbr").distinct(), "card_nbr", "left_anti")
    linked = [current.where(T.valid(F.col(k))).join(new.where(T.valid(F.col(k))).select(k).distinct(), k, "left_semi").select("card_nbr") for k in LINKS if k in current.columns]
    return reduce(DataFrame.union, [new.select("card_nbr"), *linked]).distinct()


def purchases_of(cards: DataFrame, transactions: DataFrame) -> DataFrame:
    return transactions.join(cards.select("card_nbr").distinct(), "card_nbr", "left_semi")


def store_footprint(transactions: DataFrame) -> DataFrame:
    """card_nbr, first_txn_dte, first_upc and the first, last and most used store. Ties: the smallest values."""
    by = F.struct("txn_dte", "store_id", "upc_id")
    edges = transactions.groupBy("card_nbr").agg(F.min(by).alias("f"), F.max(F.struct("txn_dte", "store_id")).alias("l"))
    visits = transactions.groupBy("card_nbr", "store_id").agg(F.count("*").alias("n"))
    most = visits.groupBy("card_nbr").agg(F.min(F.struct((-F.col("n")).alias("n"), "store_id")).alias("m"))
    return edges.join(most, "card_nbr").select("card_nbr", F.col("f.txn_dte").alias("first_txn_dte"), F.col("f.upc_id").alias("first_upc"), F.col("f.store_id").alias("first_used_store_id"), F.col("l.store_id").alias("last_used_store_id"), F.col("m.store_id").alias("most_used_store_id"))


def purchase_footprint(transactions: DataFrame, stores: DataFrame) -> DataFrame:
    """store_footprint() with the stores' zip codes, a row a card: of a store id that several stores have, the smallest zip code."""
    out = store_footprint(transactions)
    zips = stores.groupBy("store_id").agg(F.min("zip_code").alias("zip"))
    for use in ("first", "last", "most"):
        out = out.join(zips.withColumnsRenamed({"store_id": f"{use}_used_store_id", "zip": f"{use}_used_zip_code"}), f"{use}_used_store_id", "left")
    return out.select("card_nbr", "first_txn_dte", "first_upc", *[f"{u}_used_{c}" for u in ("first", "last", "most") for c in ("store_id", "zip_code")])


def most_used_stores(transactions: DataFrame, stores: DataFrame) -> DataFrame:
    """card_nbr, last and most used store, and most_used_zip_code: a row for each store that has the most used store's id, or one of no zip code."""
    zips = stores.select(F.col("store_id").alias("most_used_store_id"), F.col("zip_code").alias("most_used_zip_code"))
    return store_footprint(transactions).join(zips, "most_used_store_id", "left").select("card_nbr", "last_used_store_id", "most_used_store_id", "most_used_zip_code")


def incremental_info(cards: DataFrame, accounts: DataFrame, footprint: DataFrame) -> DataFrame:
    """The accounts of cards, with the footprint's columns in place of their own where it has the card."""
    shared = [c for c in footprint.columns if c != "card_nbr"]
    rows = accounts.join(cards.select("card_nbr").distinct(), "card_nbr", "left_semi").alias("a").join(footprint.alias("f"), "card_nbr", "left")
    own = [c for c in accounts.columns if c not in shared]
    new = [F.coalesce(F.col(f"f.{c}"), F.col(f"a.{c}")).alias(c) if c in accounts.columns else F.col(f"f.{c}").alias(c) for c in shared]
    return rows.select(*[F.col("card_nbr") if c == "card_nbr" else F.col(f"a.{c}") for c in own], *new)


def update_devices(known: DataFrame, clicks: DataFrame, cards: DataFrame) -> DataFrame:
    """known with the (card, device) rows of the clicks of these cards that it does not have."""
    pair = ["card_nbr", "mobile_device_id"]
    seen = clicks.where(T.valid(F.col("card_nbr")) & T.valid(F.col("mobile_device_id"))).select(*pair).distinct()
    seen = seen.join(cards.select("card_nbr").distinct(), "card_nbr", "left_semi")
    return known.select(*pair).unionByName(seen.join(known.select(*pair).distinct(), pair, "left_anti"))
