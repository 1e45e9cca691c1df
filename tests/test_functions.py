import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import kernels as K
from kinweave.functions import text as T


def values(spark, of, *rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"{'ab'[k]} string" for k in range(len(rows[0]))) + ", i int")
    return [r[0] for r in df.orderBy("i").select(of(*[F.col("ab"[k]) for k in range(len(rows[0]))])).collect()]


def test_cleaning_of_values(spark):
    assert values(spark, T.alpha, ("O'Neil 3",), (None,), ("",)) == ["ONeil", None, ""]
    assert values(spark, T.integer, ("12.7",), ("a1b2",), ("x",), (None,)) == [12, 12, None, None]
    assert values(spark, T.hash15, ("abc",)) == [707566766479517]
    assert values(spark, T.split_digit_runs, ("apt5b",), ("5th",)) == ["apt 5 b", "5 th"]


def test_distances(spark):
    assert values(spark, T.levenshtein, ("kitten", "sitting")) == [3]
    assert values(spark, T.lcs, ("kitten", "sitting"), ("", "a"), ("a", "")) == [4, 0, 0]
    assert values(spark, T.indel_ratio, ("kitten", "sitting"), ("", "")) == [pytest.approx(8 / 13), 1.0]
    assert values(spark, T.hamming, ("abc", "bc"), ("", "")) == [1, 0]
    assert values(spark, T.token_overlap, ("al roberto", "roberto al"), ("a a", "a"), ("", "")) == [1.0, 0.5, 0.0]
    assert values(spark, T.soundex, ("robert",), ("rupert",), ("",)) == ["R163", "R163", ""]


def test_kernels():
    assert K.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert K.jaro_winkler("", "") == 1 and K.jaro_winkler("", "a") == 0
    assert K.damerau_table("ca", "abc")[-1][-1] == 2
    assert K.metaphone("Thomas"[:2] + "ink") == "0NK" and K.metaphone("knight")[0] == "N" and K.metaphone("") == ""
    assert K.blake2b20("") == "3345524abf6bbe1809449224b5972c41790b6cf2"  # BLAKE2b of 160 bits


@pytest.mark.parametrize("word, code", [("Philip", "FLP"), ("Xavier", "SFR"), ("Wagner", "WKNR"), ("Cathy", "K0"), ("Judge", "JJ"), ("phone", "FN"), ("bishop", "BXP"), ("nation", "NXN"), ("tomb", "TM"), ("knee", "N"), ("wrack", "RK"), ("Whisky", "WSK"), ("Aeneas", "ENS"), ("match", "MX"), ("science", "SNS"), ("Zoe", "S"), ("quick", "KK"), ("axe", "AKS"), ("yes", "YS"), ("Gnome", "NM")])
def test_metaphone_of_known_words(word, code):
    assert K.metaphone(word) == code


def plain_jaro_winkler(a, b):
    """By the definition: characters match within reach, each once, from left to right."""
    if a == b:
        return 1.0
    reach, used, mine = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, u in zip(b, used, strict=True) if u]
    m, t = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_bit_kernels_follow_plain_ones():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abcé", k=rng.randrange(90 if not _ % 50 else 9))) for _s in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert K.lcs_length(a, b) == t[-1][-1]
        assert K.jaro_winkler(a, b) == pytest.approx(plain_jaro_winkler(a, b))


def test_prefix_means_follow_single_values():
    rng = random.Random(3)
    single = {K._indel: lambda a, b: K.indel_similarity(a, b), K._damerau: K.damerau_similarity, K._jw: K.jaro_winkler}
    for of, plain in single.items():
        for _ in range(40):
            a, b = ("".join(rng.choices("ab-c", k=rng.randrange(1, 9))) for _ in "ab")
            most = max(len(a), len(b))
            want = sum(plain(K.alnum(a[:i]), K.alnum(b[:i])) for i in range(1, most + 1)) / most
            assert K.prefix_mean(of)(a, b) == pytest.approx(want)
