"""Figures: pair classification against labels, and how far accounts are reduced to persons and households."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, truth: str = "target", said: str = "prediction") -> DataFrame:
    """n, accuracy, precision and recall in one row; a ratio over nothing is null."""
    cell = lambda t, s: F.count_if((F.col(truth) == t) & (F.col(said) == s))
    n = pairs.agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 9)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def roc_auc(pairs: DataFrame, truth: str = "target", score: str = "score") -> DataFrame:
    """auc by ranks: share of (1, 0) pairs in order, ties half. Scores are counted first, so the running sum is over different scores."""
    by = pairs.groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    # Running totals of different scores only, which rounding bounds.
    below = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("lower", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return by.agg(F.round(F.try_divide(F.sum(F.col("p") * (F.col("lower") + F.col("n") / 2)), F.sum("p") * F.sum("n")), 9).alias("auc"))


def reduction(ids: DataFrame) -> DataFrame:
    """cards, persons, households and the shares by which the latter are fewer."""
    wanted = {"shopper_first_card_nbr": "persons", "hhid_first_card_nbr": "households"}
    have = {c: n for c, n in wanted.items() if c in ids.columns}
    out = ids.agg(F.count("*").alias("cards"), *[F.count_distinct(c).alias(n) for c, n in have.items()])
    return out.select("*", *[F.round(1 - F.try_divide(n, "cards"), 9).alias(f"{n[:-1]}_reduction") for n in have.values()])


def report(ids: DataFrame) -> DataFrame:
    """Rows and different ids of each kind."""
    columns = [c for c in ("shopper_first_card_nbr", "hhid_first_card_nbr", "household_id") if c in ids.columns]
    return ids.agg(F.count("*").alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in columns])
