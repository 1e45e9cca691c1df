"""String kernels as Column expressions. A value that is null or '' is unknown; ANSI mode never makes them fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions import kernels as K

TEN_15 = 10**15


def valid(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def both_valid(a: Column, b: Column) -> Column:
    return valid(a) & valid(b)


def flag(c: Column) -> Column:
    """1 where the condition holds, else 0; null counts as not."""
    return F.when(c, 1).otherwise(0)


def alpha(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z]+", "")


def numeric(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "")


def alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]+", "")


def integer(c: Column) -> Column:
    """The part before the first dot as a long, or all digits where there is no dot; null if that is no number."""
    text = F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", 1)).otherwise(numeric(c))
    return text.try_cast("long")


def hash15(c: Column) -> Column:
    """SHA-1 modulo 10**15, by Horner's rule over five groups of eight hex digits."""
    digest = F.sha1(c.cast("binary"))
    total = F.lit(0).cast("decimal(38,0)")
    for k in range(5):
        part = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")
        total = ((total * F.lit(1 << 32).cast("decimal(20,0)") + part) % F.lit(TEN_15).cast("decimal(20,0)")).cast("decimal(18,0)")
    return total.cast("long")


def tokens(c: Column, clean) -> Column:
    """Cleaned words of a string, empties left out."""
    return F.filter(F.transform(F.split(F.trim(c), r"\s+"), clean), lambda t: t != "")


def token_overlap(a: Column, b: Column, clean=alpha) -> Column:
    """Size of the multiset intersection of the words over the greater number of words; 0 if neither has any."""
    x, y = tokens(a, clean), tokens(b, clean)
    count = lambda words, t: F.size(F.filter(words, lambda w: w == t))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, t: n + F.least(count(x, t), count(y, t)))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, shared / most).otherwise(F.lit(0.0))


def _hamming(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    x, y = F.lpad(a, n, " "), F.lpad(b, n, " ")
    return F.aggregate(places, F.lit(0), lambda d, i: d + flag(F.substr(x, i, F.lit(1)) != F.substr(y, i, F.lit(1))))


def hamming(a: Column, b: Column, clean=alpha) -> Column:
    """Differing places after the shorter string got spaces in front."""
    return _hamming(clean(a), clean(b))


def hamming_normalized(a: Column, b: Column, clean=alpha) -> Column:
    """hamming() over the greater raw length; 0 if nothing is left of either."""
    empty = (clean(a) == "") & (clean(b) == "")
    return F.when(empty, F.lit(0.0)).otherwise(hamming(a, b, clean) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def levenshtein(a: Column, b: Column, clean=alpha) -> Column:
    return F.levenshtein(clean(a), clean(b))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    return K.pair_function("lcs", a, b).cast("int")


def indel_ratio(a: Column, b: Column, clean=alpha) -> Column:
    """Twice the common subsequence over both lengths; 1 for two empty strings."""
    return K.pair_function({alpha: "indel_alpha", alnum: "indel_alnum"}[clean], a, b)


def soundex(c: Column) -> Column:
    return F.when(c == "", F.lit("")).otherwise(F.soundex(c))


def contained(a: Column, b: Column) -> Column:
    """One of two known strings contains the other."""
    return flag(both_valid(a, b) & (F.contains(a, b) | F.contains(b, a)))


def name_in_email(first: Column, last: Column, user: Column) -> Column:
    """A known first or last name is part of a known e-mail user."""
    return flag(both_valid(first, user) & F.contains(user, first) | both_valid(last, user) & F.contains(user, last))


def only_digits(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^[0-9\s]*\z"))


def split_digit_runs(c: Column) -> Column:
    return F.regexp_replace(c, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", " ")


def email_user(c: Column) -> Column:
    return F.coalesce(F.substring_index(c, "@", 1), F.lit(""))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda t: t != ""))


def blank_if(c: Column, *conditions: Column) -> Column:
    return F.when(F.coalesce(reduce(lambda x, y: x | y, conditions), F.lit(False)), F.lit("")).otherwise(c)
