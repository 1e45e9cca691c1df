"""Every query of the library by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import ast
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import kernels as K
from kinweave.functions import text as T
from kinweave.operators import classify, cleaning, evaluate, gender, identity, incremental, pairs
from kinweave.sources import catalog, shared

from . import oracles as O
from .stages import HH_COLUMNS, ID_COLUMNS, Stages

DIGITS = 6
_QUERIES: dict[str, Callable[[Stages], DataFrame]] = {}
_SQL: dict[str, str] = {}
_RICH: set[str] = set()


def query(name: str, select: str | None = None, rich: bool = False):
    """Registers a query; select is its SQL over the fixtures and stages. rich: over the accounts in which every rule finds something; under the name with _rich."""

    def register(f: Callable[[Stages], DataFrame]):
        _QUERIES[name] = f
        if select:
            _SQL[name] = O.sql(select)
        if rich:
            _QUERIES[f"{name}_rich"] = f
            _RICH.add(f"{name}_rich")
            if select:
                _SQL[f"{name}_rich"] = O.sql(select, True)
        return f

    return register


# String functions over single values and over pairs of names and addresses.

WHOLE = "concat_ws(' ', first_nm, last_nm, address_line1, phone)"


def _single(name: str, of: Callable[[Column], Column], sql: str | None) -> None:
    @query(name, f"select distinct v, {sql} as result from (select {WHOLE} as v from accounts)" if sql else None)
    def _(s: Stages) -> DataFrame:
        return s.accounts.select(F.concat_ws(" ", "first_nm", "last_nm", "address_line1", "phone").alias("v")).distinct().select("v", of(F.col("v")).alias("result"))


def _double(name: str, of: Callable[[Column, Column], Column], sql: str) -> None:
    @query(name, f"select a, b, {sql} as result from name_pairs")
    def _(s: Stages) -> DataFrame:
        r = of(F.col("a"), F.col("b"))
        return s.name_pairs.select("a", "b", r.alias("result"))


def _rounded(of: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.round(of(a, b), DIGITS)


HORNER = "list_reduce(list_transform(range(5), lambda i: ('0x' || substr(sha1(v), 8 * i + 1, 8))::hugeint), lambda x, y: (x * 4294967296::hugeint + y) % 1000000000000000::hugeint)"
_single("clean_alpha", T.alpha, O.alpha("v"))
_single("clean_numeric", T.numeric, "regexp_replace(v, '[^0-9]+', '', 'g')")
_single("clean_int", T.integer, "try_cast(case when contains(v, '.') then case when regexp_full_match(split_part(v, '.', 1), '\\s*[+-]?[0-9]+\\s*') then split_part(v, '.', 1) end else nullif(regexp_replace(v, '[^0-9]+', '', 'g'), '') end as bigint)")
_single("clean_alnum", T.alnum, O.alnum("v"))
_single("hash_15", T.hash15, f"cast({HORNER} as bigint)")
_single("string_length", F.length, "cast(length(v) as integer)")
_single("word_count", T.word_count, f"cast(len({O.words('v')}) as integer)")
_single("only_digits", T.only_digits, r"regexp_full_match(v, '[0-9\s]*')")
_single("split_digit_runs", T.split_digit_runs, r"regexp_replace(regexp_replace(v, '([0-9])([A-Za-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g')")
_single("soundex", T.soundex, O.soundex("v"))
_single("metaphone", K.metaphone_code, None)
_single("person_hash", K.hash20, None)


@query("email_user_name", "select distinct email_address, coalesce(split_part(email_address, '@', 1), '') as result from accounts")
def _email_user(s: Stages) -> DataFrame:
    return s.accounts.select("email_address").distinct().withColumn("result", T.email_user(F.col("email_address")))


def _hamming_sql(clean: Callable[[str], str]) -> str:
    x, y = clean("a"), clean("b")
    n = f"greatest(length({x}), length({y}))"
    return f"cast(case when {n} = 0 then 0 else hamming(lpad({x}, {n}::int, ' '), lpad({y}, {n}::int, ' ')) end as integer)"


def _indel_sql(x: str, y: str) -> str:
    row = f"list_reduce(range(1, length({y}) + 1), lambda done, j: list_append(done, case when substr({y}, j, 1) = c then prev[j] + 1 else greatest(prev[j + 1], done[j]) end), [0::bigint])"
    last = f"list_reduce(string_split({x}, ''), lambda prev, c: {row}, list_resize([0::bigint], length({y}) + 1, 0::bigint))"
    return f"case when length({x}) + length({y}) = 0 then 1.0::double when {x} = '' or {y} = '' then 0.0::double else 2.0::double * ({last})[length({y}) + 1] / (length({x}) + length({y})) end"


def _overlap_sql(clean: Callable[[str], str]) -> str:
    tokens = lambda e: f"list_filter(list_transform(string_split_regex(trim({e}), '\\s+'), lambda t: {clean('t')}), lambda t: t <> '')"
    x, y = tokens("a"), tokens("b")
    shared = f"coalesce(list_sum(list_transform(list_distinct({x}), lambda w: least(len(list_filter({x}, lambda t: t = w)), len(list_filter({y}, lambda t: t = w))))), 0)"
    return f"round(case when greatest(len({x}), len({y})) > 0 then {shared}::double / greatest(len({x}), len({y})) else 0.0::double end, {DIGITS})"


def _prefix_sql(value: Callable[[str, str], str]) -> str:
    x, y = O.alnum("substr(lower(a), 1, i)"), O.alnum("substr(lower(b), 1, i)")
    return f"round(case when a = '' or b = '' then 0.0::double else list_avg(list_transform(range(1, greatest(length(a), length(b)) + 1), lambda i: {value(x, y)})) end, {DIGITS})"


def _jw_sql(x: str, y: str) -> str:
    return f"case when {x} = {y} then 1.0::double when {x} = '' or {y} = '' then 0.0::double else jaro_winkler_similarity({x}, {y}) end"


def _damerau_sql(x: str, y: str) -> str:
    return f"case when {x} = {y} then 1.0::double else 1 - damerau_levenshtein({x}, {y})::double / greatest(length({x}), length({y})) end"


for _kind, _clean, _clean_sql in (("alpha", T.alpha, O.alpha), ("alnum", T.alnum, O.alnum)):
    _x, _y = _clean_sql("a"), _clean_sql("b")
    _double(f"token_overlap_{_kind}", _rounded(lambda a, b, c=_clean: T.token_overlap(a, b, c)), _overlap_sql(_clean_sql))
    _double(f"hamming_{_kind}", lambda a, b, c=_clean: T.hamming(a, b, c), _hamming_sql(_clean_sql))
    _double(f"hamming_norm_{_kind}", _rounded(lambda a, b, c=_clean: T.hamming_normalized(a, b, c)), f"round(case when {_x} = '' and {_y} = '' then 0.0::double else {_hamming_sql(_clean_sql)}::double / greatest(length(a), length(b), 1) end, {DIGITS})")
    _double(f"lev_{_kind}", lambda a, b, c=_clean: T.levenshtein(a, b, c), f"cast(levenshtein({_x}, {_y}) as integer)")
    _double(f"lev_ratio_{_kind}", _rounded(lambda a, b, c=_clean: T.indel_ratio(a, b, c)), f"round({_indel_sql(_x, _y)}, {DIGITS})")
    _double(f"damerau_{_kind}", _rounded(lambda a, b, k=_kind: K.pair_function(f"damerau_{k}", a, b)), f"round({_damerau_sql(_x, _y)}, {DIGITS})")
    _double(f"jw_{_kind}", _rounded(lambda a, b, k=_kind: K.pair_function(f"jw_{k}", a, b)), f"round({_jw_sql(_x, _y)}, {DIGITS})")
_double("gen_jw", _rounded(lambda a, b: K.pair_function("gen_jw", a, b)), _prefix_sql(_jw_sql))
_double("gen_damerau", _rounded(lambda a, b: K.pair_function("gen_damerau", a, b)), _prefix_sql(_damerau_sql))
_double("gen_lev", _rounded(lambda a, b: K.pair_function("gen_lev", a, b)), _prefix_sql(_indel_sql))
# The same measures under the names of another string library: its ratio is the indel ratio, its Jaro-Winkler the usual one.
_double("fuzz_lev_ratio_alnum", _rounded(lambda a, b: T.indel_ratio(a, b, T.alnum)), f"round({_indel_sql(O.alnum('a'), O.alnum('b'))}, {DIGITS})")
_double("fuzz_jw_alnum", _rounded(lambda a, b: K.pair_function("jw_alnum", a, b)), f"round({_jw_sql(O.alnum('a'), O.alnum('b'))}, {DIGITS})")
_double("gen_fuzz_lev", _rounded(lambda a, b: K.pair_function("gen_lev", a, b)), _prefix_sql(_indel_sql))
_double("gen_fuzz_jw", _rounded(lambda a, b: K.pair_function("gen_jw", a, b)), _prefix_sql(_jw_sql))
_double("name_contains", T.contained, "cast(a <> '' and b <> '' and (contains(a, b) or contains(b, a)) as integer)")


@query("name_in_email", "select c1c2, cast((first_nm_1 <> '' and email_user_1 <> '' and contains(email_user_1, first_nm_1)) or (first_nm_2 <> '' and email_user_1 <> '' and contains(email_user_1, first_nm_2)) as integer) as result from (" + O.person_pairs("phone", "cleaned") + ")", rich=True)
def _name_in_email(s: Stages) -> DataFrame:
    p = pairs.record_pairs(s.cleaned, "phone", roles=("card_nbr", "first_nm", "last_nm", "email_address", "email_user"))
    return p.select("c1c2", T.name_in_email(F.col("first_nm_1"), F.col("first_nm_2"), F.col("email_user_1")).alias("result"))


# Cleaning.


@query("lower_columns", "select card_nbr, lower(first_nm) as first_nm from accounts")
def _lower_columns(s: Stages) -> DataFrame:
    df = s.accounts.select(F.col("card_nbr").alias("CARD_NBR"), F.col("first_nm").alias("First_NM"))
    return cleaning.lower_columns(df, ("first_nm",))


@query("phone_validity", "select card_nbr, phone, is_valid_phone_number from phoned")
def _phone_validity(s: Stages) -> DataFrame:
    return cleaning.phone_validity(s.accounts).select("card_nbr", "phone", "is_valid_phone_number")


@query("profane_flag", "select card_nbr, coalesce(split_part(lower(email_address), '@', 1) = 'spam', false) as is_profane from accounts")
def _profane(s: Stages) -> DataFrame:
    return cleaning.profane_flag(s.accounts, s.data.profane).select("card_nbr", "is_profane")


for _name, _columns in {
    "name_clean": "card_nbr, first_nm, last_nm, first_nm_orig, last_nm_orig, household_id, first_used_store_id, first_used_zip_code",
    "email_clean": "card_nbr, email_user, email_address_old, email_address",
    "address_clean": "card_nbr, address, address_old, len_add, len_add_comp",
}.items():
    query(_name, f"select {_columns} from cleaned")(lambda s, c=_columns: s.cleaned.select(*c.split(", ")))

query("gender_lookup", "select name, gender from dims where gender is not null")(
    lambda s: s.cleaned.where(T.valid(F.col("first_nm"))).select(F.col("first_nm").alias("name")).distinct().join(gender.name_dimension(s.data.names_us_ca), "name", "left").join(gender.name_dimension(s.data.names_row).withColumnRenamed("gender", "g"), "name", "left").select("name", F.coalesce("gender", "g").alias("gender")).where("gender is not null")
)
query("gender_features", "select distinct first_nm as name, substr(first_nm, 1, 1) as first1, substr(first_nm, 1, 2) as first2, right(first_nm, 1) as last1, right(first_nm, 2) as last2, right(first_nm, 3) as last3 from cleaned where first_nm <> ''")(
    lambda s: s.cleaned.where(T.valid(F.col("first_nm"))).select(F.col("first_nm").alias("name")).distinct().withColumns(gender.features(F.col("name")))
)
query("gender_nb_model", "select feature, value, label, round(logp, 6) as logp from nb")(lambda s: gender.train(s.data.labelled_names).withColumn("logp", F.round("logp", DIGITS)))
query("gender_nb", "select card_nbr, first_nm, gender from known")(lambda s: s.known.select("card_nbr", "first_nm", "gender"))


# Pairs.

query("block_sizes", "select phone, cast(count(distinct card_nbr) as bigint) as cnt from cleaned where phone <> '' group by phone having count(distinct card_nbr) > 1 and count(distinct card_nbr) < 10000")(lambda s: pairs.block_sizes(s.cleaned, "phone"))
for _short, _key in (("phone", "phone"), ("email", "email_address"), ("household", "household_id")):
    query(f"pairs_{_short}", O.person_pairs(_key), rich=True)(lambda s, k=_key: s.person_pairs(k))
_FEW = "card_nbr_1, card_nbr_2, c1c2, first_nm_1, first_nm_2, email_address_1, email_address_2"
query("pairs_union_all", f"select {_FEW} from all_pairs")(lambda s: s.all_pairs.select(*_FEW.split(", ")))
query("pairs_union_distinct", f"select distinct {_FEW} from all_pairs")(lambda s: pairs.union_pairs([s.all_pairs.select(*_FEW.split(", "))], distinct=True))
query("pairs_numbered", f"select card_nbr_1, card_nbr_2, row_number() over (order by card_nbr_1, card_nbr_2) as rn from ({O.person_pairs('phone')})")(lambda s: pairs.numbered(s.person_pairs("phone").select("card_nbr_1", "card_nbr_2"), "card_nbr_1", "card_nbr_2"))
query("device_cards", "select mobile_device_id, count(distinct card_nbr) as cnt, string_agg(distinct card_nbr, ',' order by card_nbr) as cards from devices where mobile_device_id <> '' and card_nbr <> '' group by 1 having count(distinct card_nbr) > 1")(
    lambda s: pairs.device_cards(s.data.devices)
)
query("device_pairs", "select * from device_pairs", rich=True)(lambda s: s.device_pairs)
query("device_features", "select * from device_features", rich=True)(lambda s: classify.rule_features(s.device_pairs))
query("device_match", "select card_nbr_1, card_nbr_2, mobile_device_id, prediction from device_matches", rich=True)(lambda s: s.device_matches.select("card_nbr_1", "card_nbr_2", "mobile_device_id", "prediction"))
query("pairs_minus_device", f"select {_FEW} from all_pairs where (card_nbr_1, card_nbr_2) not in (select (card_nbr_1, card_nbr_2) from device_matches where prediction = 1)", rich=True)(lambda s: s.unmatched_pairs(_FEW.split(", ")))
_INDICATORS = ["either_null_first_nm", "both_valid_first_nm", "either_null_email_address", "same_fn", "approx_fn", "same_ln", "approx_ln", "same_email_address", "approx_email_address", "same_address", "same_gender", "first_nm_in_email", "jw_simi_fn", "lev_ratio_ln", "damerau_lev_simi_fn", "jw_simi_address"]


_MORE = ["either_null_last_nm", "either_null_address", "either_null_gender", "same_first_nm_sdx", "same_last_nm_sdx", "lev_ratio_fn", "jw_simi_ln", "damerau_lev_simi_ln"]


def _features_sql(wanted: list[str]) -> str:
    known = lambda r: f"({r}_1 <> '' and {r}_2 <> '')"
    inside = lambda r: f"cast({known(r)} and (contains({r}_1, {r}_2) or contains({r}_2, {r}_1)) as integer)"
    same = lambda r: f"cast({known(r)} and {r}_1 = {r}_2 as integer)"

    def similar(r: str, of: Callable[[str, str], str]) -> str:
        return f"case when {known(r)} then (select {_prefix_sql(of)} from (select {r}_1 as a, {r}_2 as b)) else 0.1::double end"

    found = {
        "either_null_first_nm": f"cast(not {known('first_nm')} as integer)", "both_valid_first_nm": f"cast({known('first_nm')} as integer)", "either_null_email_address": f"cast(not {known('email_address')} as integer)",
        "same_fn": same("first_nm"), "approx_fn": inside("first_nm"), "same_ln": same("last_nm"), "approx_ln": inside("last_nm"), "same_email_address": same("email_address"), "approx_email_address": same("email_user"),
        "same_address": same("address"), "same_gender": same("gender"),
        "first_nm_in_email": "cast((first_nm_1 <> '' and email_user_1 <> '' and contains(email_user_1, first_nm_1)) or (first_nm_2 <> '' and email_user_1 <> '' and contains(email_user_1, first_nm_2)) as integer)",
        "either_null_last_nm": f"cast(not {known('last_nm')} as integer)", "either_null_address": f"cast(not {known('address')} as integer)", "either_null_gender": f"cast(not {known('gender')} as integer)",
        "same_first_nm_sdx": f"cast({known('first_nm')} and {O.soundex('first_nm_1')} = {O.soundex('first_nm_2')} as integer)", "same_last_nm_sdx": f"cast({known('last_nm')} and {O.soundex('last_nm_1')} = {O.soundex('last_nm_2')} as integer)",
        "lev_ratio_fn": similar("first_nm", _indel_sql), "jw_simi_ln": similar("last_nm", _jw_sql), "damerau_lev_simi_ln": similar("last_nm", _damerau_sql),
        "jw_simi_fn": similar("first_nm", _jw_sql), "lev_ratio_ln": similar("last_nm", _indel_sql), "damerau_lev_simi_fn": similar("first_nm", _damerau_sql), "jw_simi_address": similar("address", _jw_sql),
    }
    return "select card_nbr_1, card_nbr_2, " + ", ".join(f"{found[n]} as {n}" for n in wanted) + f" from ({O.person_pairs('phone')})"


for _name, _wanted in (("model_features", _INDICATORS), ("model_features_more", _MORE)):
    query(_name, _features_sql(_wanted), rich=True)(
        lambda s, wanted=_wanted: classify.model_features(s.person_pairs("phone")).select("card_nbr_1", "card_nbr_2", *[F.round(n, DIGITS).alias(n) if "simi" in n or "ratio" in n else F.col(n) for n in wanted])
    )


@query("model_train")
def _model_train(s: Stages) -> DataFrame:
    gain = s.model.stages[-1].featureImportances.toArray().tolist()
    return s.spark.createDataFrame(list(zip(classify.FEATURES, gain, strict=True)), "feature string, importance double")


query("model_predict")(lambda s: classify.predictions(s.model, s.labelled_pairs, 0.75).select("card_nbr_1", "card_nbr_2", "prob_1", "prob_0", "prediction", *classify.FEATURES).distinct())


@query("model_threshold", "select cast(0 as bigint) as wrong, true as some_at_it")
def _model_threshold(s: Stages) -> DataFrame:
    """Predictions that do not follow from their probability, at a threshold that some pairs just reach."""
    said = classify.predictions(s.model, s.labelled_pairs)
    most = said.agg(F.max("prob_1")).first()[0]
    at = classify.predictions(s.model, s.labelled_pairs, most)
    return at.agg(F.count_if(F.col("prediction") != 0).alias("wrong"), (F.count_if(F.col("prob_1") == F.lit(most).cast("float")) > 0).alias("some_at_it"))


# Components and ids.

query("person_components", "select id, component from person_components", rich=True)(lambda s: s.person_components)
query("person_ids", "select card_nbr, first_nm, shopper_first_card_nbr from persons", rich=True)(lambda s: s.persons.select("card_nbr", "first_nm", "shopper_first_card_nbr"))
query("person_ids_hashed")(lambda s: identity.person_ids(s.cleaned, s.person_components).select("card_nbr", "shopper_id"))
query("person_ids_no_components", "select card_nbr, card_nbr as shopper_first_card_nbr from cleaned")(lambda s: identity.person_ids(s.cleaned, None, hashed=False).select(*ID_COLUMNS))
_HALF = "cast(card_nbr as bigint) % 10 < 8"
query("person_full_insert", f"select card_nbr, case when {_HALF} then 'old' else shopper_first_card_nbr end as shopper_first_card_nbr from persons")(
    lambda s: identity.insert_unseen(s.persons.where(_HALF).withColumn("shopper_first_card_nbr", F.lit("old")), s.persons, ID_COLUMNS)
)
query("merge_candidates", "select component, count(distinct p.shopper_first_card_nbr) as n_ids from household_components h join persons p on p.card_nbr = h.id group by component having count(distinct p.shopper_first_card_nbr) > 1", rich=True)(
    lambda s: identity.merge_candidates(s.persons, s.household_components, "shopper_first_card_nbr")
)
for _short, _key in (("shopper", "shopper_id"), ("phone", "phone"), ("email", "email_address"), ("household", "household_id"), ("multi", "multi_key")):
    query(f"hh_pairs_{_short}", f"select a.{_key} as group_col, a.card_nbr as card_nbr_1, b.card_nbr as card_nbr_2, a.card_nbr || '-' || b.card_nbr as paired_cards from household_cards a join household_cards b on a.{_key} = b.{_key} and a.card_nbr < b.card_nbr where a.{_key} <> '' and a.{_key} in (select {_key} from household_cards where {_key} <> '' group by 1 having count(distinct card_nbr) <= 10000)")(
        lambda s, k=_key: s.household_pairs(k)
    )
query("hh_pairs_union", " union ".join(f"select a.card_nbr as card_nbr_1, b.card_nbr as card_nbr_2, a.card_nbr || '-' || b.card_nbr as paired_cards from household_cards a join household_cards b on a.{k} = b.{k} and a.card_nbr < b.card_nbr where a.{k} <> ''" for k in ("phone", "multi_key")))(
    lambda s: pairs.union_household_pairs([s.household_pairs(k) for k in ("phone", "multi_key")])
)
query("hh_components", "select id, component from household_components", rich=True)(lambda s: s.household_components)
query("household_ids", "select card_nbr, shopper_first_card_nbr, hhid_first_card_nbr from households", rich=True)(lambda s: s.households.select(*HH_COLUMNS))
query("household_ids_hashed")(lambda s: identity.household_ids(s.persons, s.whole_household_components).select("card_nbr", "hhid"))
# By all five keys of the reference; the queries above follow their SQL, which has fewer.
query("hh_pairs_union_whole", " union ".join(f"select a.card_nbr as card_nbr_1, b.card_nbr as card_nbr_2, a.card_nbr || '-' || b.card_nbr as paired_cards from household_cards a join household_cards b on a.{k} = b.{k} and a.card_nbr < b.card_nbr where a.{k} <> '' and a.{k} in (select {k} from household_cards where {k} <> '' group by 1 having count(distinct card_nbr) <= 10000)" for k in pairs.HOUSEHOLD_KEYS))(lambda s: pairs.union_household_pairs([s.household_pairs(k) for k in pairs.HOUSEHOLD_KEYS]))
query("hh_components_whole", "select id, component from whole_components")(lambda s: s.whole_household_components)
query("household_ids_whole", "select card_nbr, shopper_first_card_nbr, hhid_first_card_nbr from whole_households")(lambda s: s.whole_households.select(*HH_COLUMNS))
query("household_full_insert_whole", f"select card_nbr, shopper_first_card_nbr, case when {_HALF} then 'old' else hhid_first_card_nbr end as hhid_first_card_nbr from whole_households")(
    lambda s: identity.insert_unseen(s.whole_households.where(_HALF).withColumn("hhid_first_card_nbr", F.lit("old")), s.whole_households, HH_COLUMNS)
)
query("merge_candidates_whole", "select component, count(distinct p.shopper_first_card_nbr) as n_ids from whole_components h join persons p on p.card_nbr = h.id group by component having count(distinct p.shopper_first_card_nbr) > 1")(lambda s: identity.merge_candidates(s.persons, s.whole_household_components, "shopper_first_card_nbr"))
query("reduction_whole", "select count(*) as cards, count(distinct shopper_first_card_nbr) as persons, count(distinct hhid_first_card_nbr) as households, round(1 - count(distinct shopper_first_card_nbr) / count(*), 9) as person_reduction, round(1 - count(distinct hhid_first_card_nbr) / count(*), 9) as household_reduction from whole_households")(lambda s: evaluate.reduction(s.whole_households))
query("household_full_insert", f"select card_nbr, shopper_first_card_nbr, case when {_HALF} then 'old' else hhid_first_card_nbr end as hhid_first_card_nbr from households")(
    lambda s: identity.insert_unseen(s.households.where(_HALF).withColumn("hhid_first_card_nbr", F.lit("old")), s.households, HH_COLUMNS)
)


# The e-mail, household and union pairs of the accounts that have some.
for _short in ("email", "household"):
    _QUERIES[f"hh_pairs_{_short}_rich"] = _QUERIES[f"hh_pairs_{_short}"]
    _RICH.add(f"hh_pairs_{_short}_rich")
    _key = {"email": "email_address", "household": "household_id"}[_short]
    _SQL[f"hh_pairs_{_short}_rich"] = O.sql(f"select a.{_key} as group_col, a.card_nbr as card_nbr_1, b.card_nbr as card_nbr_2, a.card_nbr || '-' || b.card_nbr as paired_cards from household_cards a join household_cards b on a.{_key} = b.{_key} and a.card_nbr < b.card_nbr where a.{_key} <> ''", True)


# Tables: each query goes through the catalogue's own reading and writing, in a folder of its own.


@contextmanager
def _catalog(s: Stages):
    yield catalog.Catalog(s.spark, f"{shared.session_folder(s.spark)}/tables-{uuid.uuid4().hex}", user="someone", database="cards")


def _constants(**columns: str) -> str:
    return "select " + ", ".join(f"{v} as {k}" for k, v in columns.items())


_TWO = "card_nbr, phone"


@query("source_read", f"select {_TWO} from accounts")
def _source_read(s: Stages) -> DataFrame:
    with _catalog(s) as c:
        c.write(s.accounts.select(F.col("card_nbr").alias("CARD_NBR"), F.col("phone").alias("Phone")), "t")
        return c.read("t")


@query("source_read_select", "select phone, count(*) as n from accounts where phone <> '' group by phone")
def _source_read_select(s: Stages) -> DataFrame:
    with _catalog(s) as c:
        c.view(s.accounts, "kinweave_accounts")
        return c.read("select phone, count(*) as N from kinweave_accounts where phone <> '' group by phone")


@query("sink_append", f"select {_TWO} from accounts")
def _sink_append(s: Stages) -> DataFrame:
    """Written, half of it; then the rest is added."""
    with _catalog(s) as c:
        c.write(s.accounts.select("card_nbr", "phone").where(_HALF), "t")
        c.append(s.accounts.select("card_nbr", "phone").where(f"not ({_HALF})"), "t")
        return c.read("t")


@query("sink_overwrite", f"select {_TWO} from accounts where phone <> ''")
def _sink_overwrite(s: Stages) -> DataFrame:
    with _catalog(s) as c:
        c.write(s.accounts.select("card_nbr", "phone"), "t")
        return c.materialize(s.accounts.select("card_nbr", "phone").where("phone <> ''"), "t")


@query("sink_truncate", _constants(n_rows="cast(0 as bigint)", columns="'card_nbr,phone'"))
def _sink_truncate(s: Stages) -> DataFrame:
    with _catalog(s) as c:
        c.write(s.accounts.select("card_nbr", "phone"), "t")
        c.truncate("t")
        left = c.read("t")
        return left.agg(F.count("*").alias("n_rows")).withColumn("columns", F.lit(",".join(left.columns)))


@query("typed_empty", _constants(n_rows="cast(0 as bigint)", types="'card_nbr string, shopper_id string'"))
def _typed_empty(s: Stages) -> DataFrame:
    none = catalog.empty(s.spark, "card_nbr", "shopper_id")
    return none.agg(F.count("*").alias("n_rows")).withColumn("types", F.lit(", ".join(f"{n} {t}" for n, t in none.dtypes)))


@query("temp_view", "select household_id, count(*) as n from accounts group by household_id")
def _temp_view(s: Stages) -> DataFrame:
    with _catalog(s) as c:
        c.view(s.accounts, "kinweave_view")
        return s.spark.table("kinweave_view").groupBy("household_id").agg(F.count("*").alias("n"))


@query("table_fresh_both", _constants(today="true", long_ago="false"))
def _table_fresh_both(s: Stages) -> DataFrame:
    with _catalog(s) as c:
        c.write(s.accounts.select("card_nbr", F.current_timestamp().cast("string").alias("dw_last_update_ts")), "new")
        c.write(s.accounts.select("card_nbr", "dw_last_update_ts"), "old")
        return s.spark.range(1).select(F.lit(c.is_fresh("new")).alias("today"), F.lit(c.is_fresh("old")).alias("long_ago"))


@query("statements", "select * from (values (1, 'numbers created'), (2, 'numbers inserted into'), (3, 'numbers truncated'), (4, 'numbers dropped'), (5, 'numbers: drop statement failed')) v(step, said)")
def _statements(s: Stages) -> DataFrame:
    """What is said of statements that work and of one that does not."""
    name = f"numbers_{uuid.uuid4().hex}"
    with _catalog(s) as c:
        said = [c.run(sql.format(name), name) for sql in ("create table {} (n int) using parquet", "insert into {} values (1)", "truncate table {}", "drop table {}")]
        try:
            c.run(f"drop table {name}", name)
        except ValueError as e:
            said.append(str(e).split(":", 2)[0] + ":" + str(e).split(":", 2)[1])
        return s.spark.createDataFrame([(k + 1, x.replace(name, "numbers")) for k, x in enumerate(said)], "step int, said string")


@query("catalog_options", "select * from (values ('database', 'cards', 'cards'), ('user', 'other', '***')) v(name, value, shown)")
def _catalog_options(s: Stages) -> DataFrame:
    """Options as they are got, and as the catalogue shows itself: who uses it stays hidden."""
    with _catalog(s) as c:
        c.set_option("user", "other")
        shown = ast.literal_eval(repr(c)[repr(c).index("{") : -1])
        return s.spark.createDataFrame([(n, c.option(n), shown[n]) for n in ("database", "user")], "name string, value string, shown string")


@query("call_procedure", "select count(*) as n, 'O''Neil' as said from accounts where phone is null")
def _call_procedure(s: Stages) -> DataFrame:
    with _catalog(s) as c:
        c.procedures["unknown"] = lambda column, said: s.accounts.where(F.col(column).isNull()).agg(F.count("*").alias("n")).withColumn("said", F.lit(said))
        return c.call("unknown", "phone", "O'Neil")


@query("model_round_trip", _constants(rows_differ="cast(0 as bigint)"))
def _model_round_trip(s: Stages) -> DataFrame:
    """The classifier saved, loaded and asked again: rows whose prediction differs from the trained one's."""
    with _catalog(s) as c:
        path = f"{c.root}/model"
        s.model.save(path)
        said = [classify.predictions(m, s.labelled_pairs, 0.75).select("card_nbr_1", "card_nbr_2", "prob_1", "prediction") for m in (s.model, c.model(path))]
        return said[0].exceptAll(said[1]).agg(F.count("*").alias("rows_differ"))


# Incremental maintenance, checks and figures.


@query("snapshot_dedupe", "select card_nbr, phone, dw_last_update_ts from accounts")
def _snapshot(s: Stages) -> DataFrame:
    older = s.accounts.withColumns({"phone": F.lit("old"), "dw_last_update_ts": F.lit("2023-01-01 00:00:00")})
    return incremental.one_row_a_card(s.accounts.unionByName(older)).select("card_nbr", "phone", "dw_last_update_ts")


query("incremental_cards", "select card_nbr from new_cards")(lambda s: s.new_cards)
query("incremental_cards_full", "select card_nbr from accounts")(lambda s: incremental.incremental_cards(s.accounts, s.previous, False))
query("incremental_purchases", "select card_nbr, txn_dte, store_id, upc_id from transactions where card_nbr in (select card_nbr from new_cards)")(lambda s: incremental.purchases_of(s.new_cards, s.data.transactions))
query("first_txn", "select card_nbr, first_txn_dte, first_upc, first_used_store_id from footprint")(lambda s: incremental.purchase_footprint(s.data.transactions, s.data.stores).select("card_nbr", "first_txn_dte", "first_upc", "first_used_store_id"))
query("most_used_store", "select f.card_nbr, last_used_store_id, most_used_store_id, z.zip_code as most_used_zip_code from footprint f left join stores z on z.store_id = f.most_used_store_id")(
    lambda s: incremental.most_used_stores(s.data.transactions, s.data.stores)
)
query("incremental_info", "select a.card_nbr, a.phone, coalesce(f.first_txn_dte, a.first_txn_dte) as first_txn_dte, f.last_used_store_id from accounts a left join footprint f on f.card_nbr = a.card_nbr where a.card_nbr in (select card_nbr from new_cards)")(
    lambda s: incremental.incremental_info(s.new_cards, s.accounts, incremental.purchase_footprint(s.data.transactions, s.data.stores)).select("card_nbr", "phone", "first_txn_dte", "last_used_store_id")
)
query("device_update", "select card_nbr, mobile_device_id from devices where mobile_device_id < 'dev-0030' or card_nbr in (select card_nbr from new_cards)")(
    lambda s: incremental.update_devices(s.data.devices.where("mobile_device_id < 'dev-0030'"), s.data.devices, s.new_cards)
)


@query("table_exists", "select count(*) > 0 as found from accounts")
def _table_exists(s: Stages) -> DataFrame:
    with _catalog(s) as c:
        c.write(s.accounts, "accounts")
        found = c.check_exists("accounts") == "accounts exists and has rows"
        return s.spark.range(1).select(F.lit(found).alias("found"))


query("table_fresh", "select cast(max(dw_last_update_ts) as date) >= current_date as is_fresh from accounts")(lambda s: catalog.fresh(s.accounts, "dw_last_update_ts"))
query("report_counts", "select count(*) as n_rows, count(distinct shopper_first_card_nbr) as n_shopper_first_card_nbr, count(distinct hhid_first_card_nbr) as n_hhid_first_card_nbr, count(distinct household_id) as n_household_id from households")(lambda s: evaluate.report(s.households))
query("reduction", "select count(*) as cards, count(distinct shopper_first_card_nbr) as persons, count(distinct hhid_first_card_nbr) as households, round(1 - count(distinct shopper_first_card_nbr) / count(*), 9) as person_reduction, round(1 - count(distinct hhid_first_card_nbr) / count(*), 9) as household_reduction from households", rich=True)(
    lambda s: evaluate.reduction(s.households)
)
_JUDGED = "select cast(cast(card_nbr_1 as bigint) // 3 = cast(card_nbr_2 as bigint) // 3 as integer) as target, cast(last_nm_1 <> '' and last_nm_1 = last_nm_2 as integer) as prediction, cast(last_nm_1 <> '' and last_nm_1 = last_nm_2 as integer) + cast(first_nm_1 <> '' and first_nm_1 = first_nm_2 as integer) as score from all_pairs"


def _judged(s: Stages) -> DataFrame:
    same = lambda c: T.flag(T.both_valid(F.col(f"{c}_1"), F.col(f"{c}_2")) & (F.col(f"{c}_1") == F.col(f"{c}_2")))
    truth = F.floor(F.col("card_nbr_1").cast("long") / 3) == F.floor(F.col("card_nbr_2").cast("long") / 3)
    return s.all_pairs.select(T.flag(truth).alias("target"), same("last_nm").alias("prediction"), (same("last_nm") + same("first_nm")).alias("score"))


query("pair_metrics", f"select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall from (select count(*) filter (target = 1 and prediction = 1) as tp, count(*) filter (target = 0 and prediction = 1) as fp, count(*) filter (target = 1 and prediction = 0) as fn, count(*) filter (target = 0 and prediction = 0) as tn from ({_JUDGED}))")(
    lambda s: evaluate.confusion(_judged(s))
)
query("pair_auc", f"with j as ({_JUDGED}), g as (select score, count(*) filter (target = 1) as p, count(*) filter (target = 0) as n from j group by score) select round(sum(a.p * (coalesce((select sum(b.n) from g b where b.score < a.score), 0) + a.n / 2)) / ((select sum(p) from g) * (select sum(n) from g)), 9) as auc from g a")(
    lambda s: evaluate.roc_auc(_judged(s))
)
_SQL["pair_auc"] = O.sql("select * from (" + "with" + _SQL["pair_auc"].split("\nwith", 1)[1] + ")")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, pair, match, link, give ids: how far accounts are reduced to persons and households."""
    return evaluate.reduction(Stages(spark, sf_dir).whole_households)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f, rich=name in _RICH: f(Stages(spark, sf_dir, rich))) for name, f in _QUERIES.items()}


def oracles() -> dict[str, str]:
    return dict(_SQL)
