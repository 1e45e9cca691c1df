r"""Quality rules whose cutoffs are chosen so that few good documents are lost, with proof.

Three statistics of a text are held against cutoffs: a document that is above any of them is rejected. The cutoffs are set in
STEPS of a fixed order, each of which tightens one rule: symbols first, then repeated lines and repeated words in turn. So
a step rejects all that the steps before it do. For each stratum (language) the labelled good documents are a holdout: of n,
a step rejects k. A step passes if the exact binomial probability of at most k rejections among n, were the true rate
`risk`, is no more than `doubt` / strata. Steps are tested in their order up to the first that does not pass, which needs no
correction within a stratum (a fixed sequence); Bonferroni's correction over the strata makes all hold at once: with
confidence 1 - `doubt` the rules reject at most `risk` of the good documents of every stratum. The last step that passed is
the stratum's; one without any rejects nothing. With four strata the first step needs 144 good labelled documents.

Everything is DataFrame expressions. Null and empty texts have no words and fail the base; a null language is a stratum
of its own; documents without a label only get verdicts. Of several labels for an id the lowest quality counts; null
labels are left out. Repeated rows give repeated results. Empty tables give empty results. Extra columns are ignored.
Repeated windows and lines are told by 64-bit hashes within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.sources.catalog import dimension

from . import common

MIN_WORDS = 50
REPEAT_PERCENT = 50
RISK, DOUBT = 0.03, 0.05
#: Statistics and the grids of their cutoffs, loosest first.
RULES = {
    "symbols": [2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1],
    "dup_lines": [0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeats": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
}
#: The fixed order in which cutoffs are tightened: (rule, cutoff).
STEPS = [("symbols", c) for c in RULES["symbols"]] + [step for pair in zip(RULES["dup_lines"], RULES["repeats"], strict=True) for step in zip(("dup_lines", "repeats"), pair, strict=True)]
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines. One row a document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"), text.alias("text"))
    inner = F.btrim("text", F.lit(BLANKS))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.xxhash64(x))
    df = df.select(
        "doc_id",
        "stratum",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, common.GAP)).alias("words"),
        lines.alias("lines"),
    )
    windows = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    df = df.select(
        "doc_id",
        "stratum",
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Only texts with a repeated window are looked at further: windows sorted by hash and place show which have an equal neighbour.
    repeated = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = F.when(repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("placed", placed).drop("windows")
    equal = F.filter("placed", lambda x, i: (x["h"] == F.get("placed", i - 1)["h"]) | (x["h"] == F.get("placed", i + 1)["h"]))
    df = df.withColumn("starts", F.sort_array(F.transform(equal, lambda x: x["i"]))).drop("placed")
    covered = F.transform("starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    return df.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")


def statistics() -> dict[str, Column]:
    of = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": of("n_symbols", "n_words"), "dup_lines": of("n_dup_lines", "n_lines"), "repeats": of("n_repeat_words", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def at_most(k: Column, n: Column, p: float) -> Column:
    """Probability of at most k successes of n at rate p, from the logarithms of the terms' ratios."""
    log_odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i) + F.lit(log_odds)
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, start, add, lambda a: a["sum"])


def rejecting_step() -> Column:
    """Number of the first step that rejects a document; len(STEPS) if none does."""
    never = F.lit(len(STEPS))
    firsts = []
    for rule, value in statistics().items():
        first = F
        for j, (of, cutoff) in enumerate(STEPS):
            if of == rule:
                first = first.when(value > cutoff, j)
        firsts.append(first.otherwise(never))
    return F.least(*firsts)


def cutoffs(features: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """stratum and step, the last that passed (-1: none). One row a stratum that has good labelled documents."""
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = features.where(~base_failed()).join(good, "doc_id").select("stratum", rejecting_step().alias("step"))
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("step") <= j) for j in range(len(STEPS))]).alias("ks"))
    # One row a stratum, so one task numbers them.
    counts = counts.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(1))))
    tests = counts.select("stratum", "n", "strata", F.posexplode("ks").alias("j", "k"))
    passed = F.when(F.col("k") <= risk * F.col("n"), at_most(F.col("k"), F.col("n"), risk) <= F.lit(doubt) / F.col("strata")).otherwise(False)
    return tests.groupBy("stratum").agg((F.coalesce(F.min(F.when(~passed, F.col("j"))), F.lit(len(STEPS))) - 1).alias("step"))


def judge(features: DataFrame, cuts: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed and kept."""
    # One row a stratum with good labels, broadcast if those are few, as languages are.
    rejected = F.coalesce(rejecting_step() <= F.col("step"), F.lit(False))
    return features.join(dimension(cuts), "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents by rules whose cutoffs the labels allow."""
    features = common.written(base_features(common.table(spark, sf_dir, "documents")), "quality")
    return judge(features, common.written(cutoffs(features, common.table(spark, sf_dir, "labels")), "cutoffs"))


_STAT = {"symbols": "n_symbols / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)"}
_STEP = "least(" + ", ".join("case " + " ".join(f"when {_STAT[r]} > {c} then {j}" for j, (of, c) in enumerate(STEPS) if of == r) + f" else {len(STEPS)} end" for r in RULES) + ")"
OP7_SQL = rf"""
with split as (
  select doc_id, coalesce('=' || lang, '') as stratum, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
windows as (
  select *, list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) as t from split),
seen as (
  select doc_id, i, count(*) over (partition by doc_id, x) > 1 as again from (select doc_id, unnest(t) as x, unnest(range(len(t))) as i from windows)),
covered as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from seen where again) group by doc_id),
f as (
  select s.doc_id, stratum, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words, len(lines) as n_lines
  from split s left join covered c on s.doc_id = c.doc_id),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed from f),
good as (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1),
stepped as (select *, {_STEP} as step from b),
held as (select stratum, step from stepped join good using (doc_id) where not base_failed),
strata as (select stratum, count(*) as n, count(*) over () as strata from held group by stratum),
tests as (
  select s.stratum, n, strata, j, (select count(*) from held h where h.stratum = s.stratum and h.step <= j) as k
  from strata s, range({len(STEPS)}) steps(j)),
failed as (
  select stratum, min(j) as j from tests
  where not (k <= {RISK} * n and list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) <= {DOUBT} / strata)
  group by stratum),
chosen as (select s.stratum, coalesce(f.j, {len(STEPS)}) - 1 as last from strata s left join failed f on s.stratum = f.stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and step > coalesce(last, -1) as kept
from stepped s left join chosen c on s.stratum = c.stratum
"""
