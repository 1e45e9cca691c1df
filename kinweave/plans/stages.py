"""The pipeline's stages over the fixtures, as lazily built DataFrames: what one query needs is all that runs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import text as T
from kinweave.operators import classify, cleaning, evaluate, gender, graph, identity, incremental, pairs
from kinweave.sources.shared import written

from .fixtures import Fixtures

ROLES = ("card_nbr", "household_id", "phone", "first_nm", "last_nm", "email_address", "email_user", "address", "gender", "first_txn_dte", "first_used_store_id", "first_upc")
ID_COLUMNS = ["card_nbr", "shopper_first_card_nbr"]
HH_COLUMNS = ["card_nbr", "shopper_first_card_nbr", "hhid_first_card_nbr"]


class Stages:
    def __init__(self, spark: SparkSession, sf_dir: str, rich: bool = False):
        self.spark = spark
        self.data = Fixtures(spark, sf_dir, rich)

    @cached_property
    def accounts(self) -> DataFrame:
        return self.data.accounts

    @cached_property
    def cleaned(self) -> DataFrame:
        return cleaning.clean_accounts(self.accounts, self.data.profane, self.data.suffixes)

    @cached_property
    def table(self) -> DataFrame:
        """Cleaned accounts as a written table, for what reads them more than once."""
        return written(self.cleaned, "cleaned", shuffles_go=True)

    @cached_property
    def known(self) -> DataFrame:
        """Cleaned accounts with gender."""
        d = self.data
        return gender.predict(self.table, d.names_us_ca, d.names_row, d.labelled_names)

    def person_pairs(self, key: str) -> DataFrame:
        return pairs.record_pairs(self.known, key, roles=ROLES)

    @cached_property
    def all_pairs(self) -> DataFrame:
        return pairs.union_pairs([self.person_pairs(k) for k in pairs.PERSON_KEYS])

    @cached_property
    def device_pairs(self) -> DataFrame:
        return pairs.device_pairs(self.data.devices, self.table)

    @cached_property
    def device_matches(self) -> DataFrame:
        met = pairs.device_pairs(self.data.devices, self.table, blocks=True)
        return classify.rule_match(classify.rule_features(met))

    def unmatched_pairs(self, columns: list[str]) -> DataFrame:
        """Columns of all pairs that are no matched device pairs."""
        found = written(self.all_pairs.select(*columns), "pairs")
        return pairs.without_pairs(found, pairs.device_matched(found, self.data.devices, self.table)).select(*columns)

    @cached_property
    def person_edges(self) -> DataFrame:
        """Phone pairs with one last name or one e-mail, and matched device pairs."""
        p = pairs.record_pairs(self.table, "phone", roles=ROLES)
        same = lambda c: T.both_valid(F.col(f"{c}_1"), F.col(f"{c}_2")) & (F.col(f"{c}_1") == F.col(f"{c}_2"))
        rule = p.where(same("last_nm") | same("email_address")).select("card_nbr_1", "card_nbr_2")
        return rule.unionByName(pairs.device_match_stars(self.data.devices, self.table))

    @cached_property
    def person_components(self) -> DataFrame:
        return written(graph.connected_components(self.person_edges, "card_nbr_1", "card_nbr_2"), "person_components")

    @cached_property
    def persons(self) -> DataFrame:
        return written(identity.person_ids(self.table, self.person_components, hashed=False), "persons")

    @cached_property
    def person_cards(self) -> DataFrame:
        """Persons with the household key shopper_id (before hashing, so that SQL can follow)."""
        return self.persons.withColumn("shopper_id", F.col("shopper_first_card_nbr"))

    def household_pairs(self, key: str) -> DataFrame:
        return pairs.household_pairs(self.person_cards, key)

    @cached_property
    def household_edges(self) -> DataFrame:
        stars = [pairs.household_stars(self.person_cards, k) for k in ("shopper_id", "phone", "multi_key")]
        return pairs.union_pairs(stars)

    @cached_property
    def household_components(self) -> DataFrame:
        return written(graph.connected_components(self.household_edges, "card_nbr_1", "card_nbr_2"), "household_components")

    @cached_property
    def households(self) -> DataFrame:
        return identity.household_ids(self.persons, self.household_components, hashed=False)

    @cached_property
    def whole_household_components(self) -> DataFrame:
        """Components by all household keys; household_components, as its SQL has it, leaves out e-mail addresses and existing households."""
        stars = [pairs.household_stars(self.person_cards, k) for k in pairs.HOUSEHOLD_KEYS]
        return written(graph.connected_components(pairs.union_pairs(stars), "card_nbr_1", "card_nbr_2"), "whole_household_components")

    @cached_property
    def whole_households(self) -> DataFrame:
        return identity.household_ids(self.persons, self.whole_household_components, hashed=False)

    @cached_property
    def previous(self) -> DataFrame:
        return self.accounts.where(F.col("card_nbr").cast("long") % 10 < 8)

    @cached_property
    def new_cards(self) -> DataFrame:
        return incremental.incremental_cards(self.accounts, self.previous)

    @cached_property
    def labelled_pairs(self) -> DataFrame:
        """Features and the truth by construction: three cards in a row are one person."""
        same = F.floor(F.col("card_nbr_1").cast("long") / 3) == F.floor(F.col("card_nbr_2").cast("long") / 3)
        features = classify.model_features(self.all_pairs.dropDuplicates(["card_nbr_1", "card_nbr_2"])).withColumn("target", T.flag(same))
        return written(features, "labelled_pairs")  # read once a round of training

    @cached_property
    def model(self):
        return classify.train(self.labelled_pairs.orderBy("card_nbr_1", "card_nbr_2"), classify.FEATURES, "target")

    @cached_property
    def name_pairs(self) -> DataFrame:
        """Different pairs of raw full names and addresses of cards that share a household: a, b."""
        whole = F.concat_ws(" ", "first_nm", "last_nm", "address_line1")
        side = lambda i: self.accounts.where(T.valid(F.col("household_id"))).select("household_id", F.col("card_nbr").alias(f"c{i}"), whole.alias("ab"[i]))
        return side(0).join(side(1), "household_id").where("c0 < c1").select("a", "b").distinct()

    def report(self) -> DataFrame:
        return evaluate.reduction(self.persons)
