"""Cleaning of contact data as Column expressions: each step is one projection.

legacy_scrub deletes na, n a, none and nan inside values too, as the rules had it; without it only whole values count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as T
from kinweave.sources.catalog import dimension


@dataclass(frozen=True)
class PiiColumns:
    """Physical names of the roles that the operators use."""

    card_nbr: str = "card_nbr"
    household_id: str = "household_id"
    phone: str = "phone"
    first_nm: str = "first_nm"
    last_nm: str = "last_nm"
    address_line1: str = "address_line1"
    address_line2: str = "address_line2"
    email_address: str = "email_address"
    store_ids: tuple[str, ...] = ("first_used_store_id", "last_used_store_id", "most_used_store_id")
    zip_codes: tuple[str, ...] = ("first_used_zip_code", "last_used_zip_code", "most_used_zip_code")
    others: tuple[str, ...] = ("first_txn_dte", "first_upc")

    def roles(self, df: DataFrame) -> DataFrame:
        """df with the physical columns renamed to their roles."""
        return df.withColumnsRenamed({v: k for k, v in vars(self).items() if isinstance(v, str) and v != k and v in df.columns})


# Toll-free area codes, values that stand for no name, e-mail or address, and the form of an e-mail address.
TOLL_FREE = ["800", "888", "877", "866", "855", "844"]
NO_NAME = ["valued customer", "customer", "valued", "anycart", "albertsons", "safeway"]
NO_FIRST_OR_LAST = ["test", "notgiven", "noname", *NO_NAME, "na", "n/a", "", " "]
NO_EMAIL_USER = ["n/a", " ", "", "na", "n a", "no", "none", "noemail", "email", "albertsons", "safeway", "invalid"]
NO_ADDRESS = ["n/a", " ", "", "na", "n a", "no", "none", "albertsons", "safeway", "invalid"]
EMAIL = r'''^(?:[\-!#-'*+/-9=?A-Z\^-~]+(?:\.[\-!#-'*+/-9=?A-Z\^-~]+)*|"(?:[\]!#-\[\^-~ \t]|(?:\\[\t -~]))+")@(?:[\-!#-'*+/-9=?A-Z\^-~]+(?:\.[\-!#-'*+/-9=?A-Z\^-~]+)*|\[[\t -Z\^-~]*\])\z'''


def lower_columns(df: DataFrame, values: tuple[str, ...] = ()) -> DataFrame:
    """Column names in lower case; the values of the named columns too."""
    df = df.toDF(*[c.lower() for c in df.columns])
    return df.select(*[F.lower(c).alias(c) if c in values else F.col(c) for c in df.columns])


def phone_validity(df: DataFrame, cols: PiiColumns = PiiColumns(), area_codes: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """is_valid_phone_number; the phone is emptied where it is not valid.

    Valid: ten digits of the North American form, no toll-free area code and, if area_codes (column area_code) are given, one
    of those. They are broadcast if they are as few as area codes are.
    """
    digits = T.numeric(F.col(cols.phone))
    ok = (F.length(cols.phone) >= 10) & F.regexp_like(digits, F.lit(r"^[2-9][0-9]{2}[2-9][0-9]{6}\z")) & ~F.substring(digits, 1, 3).isin(TOLL_FREE)
    if area_codes is not None:
        known = area_codes.select(F.col("area_code").cast("string").alias("_area")).distinct().withColumn("_known", F.lit(True))
        df = df.join(dimension(known), F.substring(digits, 1, 3) == F.col("_area"), "left")
        ok = ok & F.coalesce("_known", F.lit(False))
    ok = F.coalesce(ok, F.lit(False))
    kept = digits if normalize else F.col(cols.phone)
    return df.withColumns({"is_valid_phone_number": ok, cols.phone: F.when(ok, kept).otherwise("")}).drop("_area", "_known")


def _scrub(c: Column, words: list[str], legacy: bool) -> Column:
    for w in words if legacy else []:
        c = F.replace(c, F.lit(w), F.lit(""))
    return c


def _clean_name(c: Column, legacy: bool) -> Column:
    kept = F.trim(F.regexp_replace(c, r"[^A-Za-z\s]+", ""))
    if not legacy:
        kept = T.blank_if(kept, F.lower(kept).isin("na", "n a"))
    return F.lower(_scrub(kept, ["n/a", "n a", "na"], legacy))


def _pick(c: Column, want: int) -> Column:
    """The token in place `want` (0 or 1) unless the other is longer, or as long and this one is under three letters."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")
    this, other = F.coalesce(F.get(words, want), F.lit("")), F.coalesce(F.get(words, 1 - want), F.lit(""))
    longer = F.length(this) > F.length(other)
    picked = F.when(F.size(words) == 1, F.get(words, 0)).when(longer | (F.length(this) >= 3), this).otherwise(other)
    return T.blank_if(picked, c.isin(NO_FIRST_OR_LAST))


def clean_names(df: DataFrame, cols: PiiColumns = PiiColumns(), legacy_scrub: bool = True) -> DataFrame:
    """first_nm, last_nm and their cleaned originals (*_orig); every column becomes a trimmed lower-case string, nulls ''."""
    names = {cols.first_nm, cols.last_nm}
    done: list[Column] = []
    for c in df.columns:
        v = F.col(c).cast("string")
        if c in cols.store_ids:
            v = F.lower(F.coalesce(v, F.lit("9999")))
        elif c in cols.zip_codes:
            v = F.coalesce(v, F.lit("99999"))
        elif c in (cols.card_nbr, *names):
            v = F.lower(F.coalesce(v, F.lit("")))
        elif "last_update_ts" not in c:
            low = F.lower(v)
            low = _scrub(low, ["none", "nan"], True) if legacy_scrub else T.blank_if(low, F.trim(low).isin("none", "nan"))
            v = F.coalesce(F.trim(low), F.lit(""))
        if c in names:
            v = T.blank_if(v, v.isin(NO_NAME))
            v = _clean_name(v, legacy_scrub)
        done.append(v.alias(c))
    df = df.select(*done)
    first, last = F.col(cols.first_nm), F.col(cols.last_nm)
    return df.withColumns({f"{cols.first_nm}_orig": first, f"{cols.last_nm}_orig": last, cols.first_nm: _pick(first, 0), cols.last_nm: _pick(last, 1)})


def profane_flag(df: DataFrame, profane: DataFrame, cols: PiiColumns = PiiColumns()) -> DataFrame:
    """is_profane: whether the e-mail's part before @ is a row of profane.invalid_name. The list is one of words, not of data; Spark picks the join."""
    words = profane.select(F.lower("invalid_name").alias("_word")).distinct().withColumn("is_profane", F.lit(True))
    joined = df.join(words, F.substring_index(F.lower(cols.email_address), "@", 1) == F.col("_word"), "left")
    return joined.drop("_word").withColumn("is_profane", F.coalesce("is_profane", F.lit(False)))


def clean_emails(df: DataFrame, profane: DataFrame, cols: PiiColumns = PiiColumns(), legacy_scrub: bool = True) -> DataFrame:
    """email_user, email_address_old (lower case, before validation) and email_address ('' unless it is of the mailbox form)."""
    df = profane_flag(df, profane, cols)
    low = F.lower(F.coalesce(F.col(cols.email_address), F.lit("")))
    user = _scrub(T.email_user(low), ["n/a", "na"], legacy_scrub)
    user = T.blank_if(user, user.isin(NO_EMAIL_USER))
    plain = T.blank_if(low, low.isin("na", "n/a"), F.col("is_profane"), ~F.regexp_like(low, F.lit(EMAIL)))
    address = T.blank_if(_scrub(plain, ["n/a", "na"], legacy_scrub), user == "")
    return df.withColumns({"email_user": user, f"{cols.email_address}_old": low, cols.email_address: address}).drop("is_profane")


def _scrub_address(c: Column, legacy: bool) -> Column:
    c = F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " ")
    c = F.trim(F.regexp_replace(T.split_digit_runs(c), r"\s+", " "))
    if not legacy:
        return T.blank_if(c, c.isin("n a", "na"))
    return F.trim(_scrub(c, ["n/a", "na", "n a"], True))


#: Most rows of the suffix dimension.
SUFFIXES = 10_000


def suffix_map(suffixes: DataFrame) -> Column:
    """A map literal of variant to full name, from a dimension whose columns are full name and variants by place. A few hundred rows; more than SUFFIXES are an error."""
    full, *variants = suffixes.columns
    rows = suffixes.limit(SUFFIXES + 1).collect()
    if len(rows) > SUFFIXES:
        raise ValueError(f"more than {SUFFIXES} rows of address suffixes do not fit a map literal")
    pairs = sorted({(str(r[v]).lower(), str(r[full]).lower()) for r in rows for v in variants if r[v]})
    return F.create_map(*[F.lit(x) for p in dict(pairs).items() for x in p])


def clean_addresses(df: DataFrame, suffixes: DataFrame, cols: PiiColumns = PiiColumns(), legacy_scrub: bool = True) -> DataFrame:
    """address, address_old, len_add, len_add_comp (characters and words, before post-box addresses are emptied)."""
    has = lambda c: F.when(T.valid(F.col(c)), F.col(c)) if c in df.columns else F.lit(None).cast("string")
    old = F.concat_ws(" ", has(cols.address_line1), has(cols.address_line2))
    df = df.withColumn("address_old", old)
    once = _scrub_address(F.col("address_old"), legacy_scrub)
    df = df.withColumn("address", T.blank_if(once, once.isin(NO_ADDRESS), T.only_digits(once)))
    full = suffix_map(suffixes)
    words = F.transform(F.split(_scrub_address(F.col("address"), legacy_scrub), " "), lambda t, i: F.when(i >= 2, F.coalesce(F.try_element_at(full, t), t)).otherwise(t))
    df = df.withColumn("address", F.array_join(words, " "))
    df = df.withColumns({"len_add": F.length("address"), "len_add_comp": T.word_count(F.col("address"))})
    return df.withColumn("address", T.blank_if(F.col("address"), F.contains("address", F.lit("general delivery")), F.startswith("address", F.lit("po box"))))


def clean_accounts(df: DataFrame, profane: DataFrame, suffixes: DataFrame, cols: PiiColumns = PiiColumns(), legacy_scrub: bool = True) -> DataFrame:
    """All cleaning steps in their order."""
    df = clean_names(phone_validity(lower_columns(df), cols), cols, legacy_scrub)
    return clean_addresses(clean_emails(df, profane, cols, legacy_scrub), suffixes, cols, legacy_scrub)
