"""Stable ids of persons and households.

The id of a component hashes its first card: the least by date, store, item and number of the first purchase, as strings, in
one aggregate. Unknown levels come after known ones when null; '' is a value and comes first, unless blank_as_missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import kernels as K

LEVELS = ("first_txn_dte", "first_used_store_id", "first_upc")


def _order(levels: tuple[str, ...], card: str, blank_as_missing: bool) -> Column:
    """A struct that sorts nulls last at every level."""
    fields = []
    for k, c in enumerate((*levels, card)):
        v = F.col(c).cast("string")
        v = F.when(v != "", v) if blank_as_missing else v
        fields += [v.isNull().alias(f"n{k}"), v.alias(f"v{k}")]
    return F.struct(*fields)


def first_cards(members: DataFrame, out: str, card: str = "card_nbr", levels: tuple[str, ...] = LEVELS, blank_as_missing: bool = False) -> DataFrame:
    """component and its first card, from rows with component, card and levels."""
    least = F.min(F.struct(_order(levels, card, blank_as_missing).alias("o"), F.col(card).alias("c")))
    return members.groupBy("component").agg(least.alias("m")).select("component", F.col("m.c").alias(out))


def _with_first(df: DataFrame, components: DataFrame | None, out: str, card: str, blank_as_missing: bool) -> DataFrame:
    if components is None:
        return df.withColumn(out, F.col(card))
    rows = df.join(components.select(F.col("id").alias("card_nbr"), "component"), "card_nbr", "left")
    first = first_cards(rows.where("component is not null"), out, card, blank_as_missing=blank_as_missing)
    return rows.join(first, "component", "left").withColumn(out, F.coalesce(out, card)).drop("component")


def person_ids(pii: DataFrame, components: DataFrame | None = None, blank_as_missing: bool = False, hashed: bool = True) -> DataFrame:
    """pii with shopper_first_card_nbr and shopper_id; cards outside all components are their own first."""
    out = _with_first(pii, components, "shopper_first_card_nbr", "card_nbr", blank_as_missing)
    return out.withColumn("shopper_id", K.hash20(F.col("shopper_first_card_nbr"))) if hashed else out


def household_ids(persons: DataFrame, components: DataFrame | None = None, blank_as_missing: bool = False, hashed: bool = True) -> DataFrame:
    """persons with hhid_first_card_nbr (the least first card of its persons) and hhid."""
    out = _with_first(persons, components, "hhid_first_card_nbr", "shopper_first_card_nbr", blank_as_missing)
    return out.withColumn("hhid", K.hash20(F.col("hhid_first_card_nbr"))) if hashed else out


def insert_unseen(full: DataFrame, new: DataFrame, columns: list[str], key: str = "card_nbr") -> DataFrame:
    """full and the rows of new whose card it does not have; what is there is never changed."""
    return full.select(*columns).unionByName(new.join(full.select(key).distinct(), key, "left_anti").select(*columns))


def merge_candidates(full: DataFrame, components: DataFrame, id_col: str = "shopper_id") -> DataFrame:
    """component, n_ids: components that join cards which already have different ids. Inserts leave those as they are."""
    joined = components.select(F.col("id").alias("card_nbr"), "component").join(full.select("card_nbr", id_col), "card_nbr")
    return joined.groupBy("component").agg(F.countDistinct(id_col).alias("n_ids")).where("n_ids > 1")
