"""Similarities and codes that no built-in function gives, as Arrow-batched pandas functions. Equal pairs of a batch are worked out once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity; above 0.7 raised by a tenth of what is missing for each of up to four equal first letters."""
    return _jaro_winkler(a, b, _places(b)) if a else float(a == b)


def _places(s: str) -> dict[str, int]:
    """For each character a bit at each of its places."""
    at: dict[str, int] = {}
    for j, c in enumerate(s):
        at[c] = at.get(c, 0) | 1 << j
    return at


def _jaro_winkler(a: str, b: str, at: dict[str, int]) -> float:
    """With the places of b's characters, of which those beyond its end do not count. Bits stand for places of b that are still free."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = (1 << len(b)) - 1
    mine = []
    for i, c in enumerate(a):
        found = at.get(c, 0) & free & (1 << i + reach + 1) - 1
        if i > reach:
            found &= -1 << i - reach
        if found:
            free ^= found & -found
            mine.append(c)
    if not mine:
        return 0.0
    theirs = [c for j, c in enumerate(b) if not free >> j & 1]
    m, swapped = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def damerau_table(a: str, b: str) -> list[list[int]]:
    """Unrestricted Damerau-Levenshtein distances of all prefixes: table[i][j] of a[:i] and b[:j]."""
    far = len(a) + len(b)
    t = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        t[i + 1][1] = i
    for j in range(len(b) + 1):
        t[1][j + 1] = j
    row_of: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        column = 0
        for j, y in enumerate(b, 1):
            k, m = row_of.get(y, 0), column
            if x == y:
                column = j
            t[i + 1][j + 1] = min(t[i][j] + (x != y), t[i + 1][j] + 1, t[i][j + 1] + 1, t[k][m] + i - k + j - m - 1)
        row_of[x] = i
    return [row[1:] for row in t[1:]]


def damerau_similarity(a: str, b: str) -> float:
    most = max(len(a), len(b))
    return 1 - damerau_table(a, b)[-1][-1] / most if most else 1.0


def lcs_rows(a: str, b: str) -> list[int]:
    """For each prefix of a a number whose zero bits, counted up to j, are the length of its longest common subsequence with b[:j]."""
    at, v = _places(b), (1 << len(b)) - 1
    rows = [v]
    for x in a:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & (1 << len(b)) - 1
        rows.append(v)
    return rows


def lcs_length(a: str, b: str) -> int:
    return len(b) - lcs_rows(a, b)[-1].bit_count()


def indel_similarity(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty strings."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def _only(keep: Callable[[str], bool]) -> Callable[[str], str]:
    return lambda s: "".join(c for c in s if c.isascii() and keep(c))


alpha, alnum = _only(str.isalpha), _only(str.isalnum)


def _prefix_sizes(s: str, most: int) -> list[int]:
    """How much of the cleaned string the first 1, 2, ... characters leave; what is beyond the end leaves all."""
    out, n = [], 0
    for i in range(most):
        n += i < len(s) and s[i].isascii() and s[i].isalnum()
        out.append(n)
    return out


def prefix_mean(of: Callable[[str, str], Callable[[int, int], float]]) -> Callable[[str, str], float]:
    """Mean over growing prefixes of both strings in lower case, each cleaned; 0 if either is empty."""

    def mean(a: str, b: str) -> float:
        if not a or not b:
            return 0.0
        a, b = a.lower(), b.lower()
        most = max(len(a), len(b))
        value = of(alnum(a), alnum(b))
        return sum(map(value, _prefix_sizes(a, most), _prefix_sizes(b, most))) / most

    return mean


def _jw(a: str, b: str):
    at = _places(b)
    return lambda i, j: _jaro_winkler(a[:i], b[:j], at)


def _indel(a: str, b: str):
    rows = lcs_rows(a, b)
    return lambda i, j: 2 * (j - (rows[i] & (1 << j) - 1).bit_count()) / (i + j) if i + j else 1.0


def _damerau(a: str, b: str):
    t = damerau_table(a, b)
    return lambda i, j: 1 - t[i][j] / max(i, j) if i or j else 1.0


def metaphone(word: str) -> str:
    """Metaphone as Philips published it, of the letters of a word."""
    w = alpha(word).upper()
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out, n, front = [], len(w), "EIY"
    at = lambda k: w[k] if 0 <= k < n else ""
    for i, c in enumerate(w):
        if c == at(i - 1) and c != "C":
            continue
        after, before = at(i + 1), at(i - 1)
        code = ""
        if c in "AEIOU":
            code = c if i == 0 else ""
        elif c == "B":
            code = "" if before == "M" and i == n - 1 else "B"
        elif c == "C":
            if before == "S" and after and after in front:
                code = ""
            elif w[i : i + 3] == "CIA" or after == "H" and before != "S":
                code = "X"
            else:
                code = "S" if after and after in front else "K"
        elif c == "D":
            code = "J" if after == "G" and at(i + 2) and at(i + 2) in front else "T"
        elif c == "G":
            if after == "H" and not (i + 2 == n or at(i + 2) in "AEIOU") or after == "N" and (i + 2 == n or w[i + 1 :] == "NED"):
                code = ""
            else:
                code = "J" if after and after in front and before != "G" else "K"
            if before == "D" and after and after in front:
                code = ""
        elif c == "H":
            code = "H" if after and after in "AEIOU" and before not in tuple("CSPTG") else ""
        elif c == "K":
            code = "" if before == "C" else "K"
        elif c == "P":
            code = "F" if after == "H" else "P"
        elif c == "Q":
            code = "K"
        elif c == "S":
            code = "X" if after == "H" or w[i : i + 3] in ("SIO", "SIA") else "S"
        elif c == "T":
            code = "X" if w[i : i + 3] in ("TIA", "TIO") else "0" if after == "H" else "" if w[i : i + 3] == "TCH" else "T"
        elif c == "V":
            code = "F"
        elif c in "WY":
            code = c if after and after in "AEIOU" else ""
        elif c == "X":
            code = "KS"
        elif c == "Z":
            code = "S"
        else:
            code = c
        out.append(code)
    return "".join(out)


def blake2b20(s: str) -> str:
    return hashlib.blake2b(s.encode(), digest_size=20).hexdigest()


def _pairwise(name: str, of: Callable[[str, str], float], clean: Callable[[str], str] | None = None):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in known:
                known[x, y] = of(clean(x), clean(y)) if clean else of(x, y)
            out.append(known[x, y])
        return pd.Series(out, dtype="float64")

    run.__name__ = name
    return F.pandas_udf(run, "double")


def _single(name: str, of: Callable[[str], str]):
    def run(a: pd.Series) -> pd.Series:
        known = {x: of(x) for x in a.dropna().unique()}
        return a.map(known, na_action="ignore")

    run.__name__ = name
    return F.pandas_udf(run, "string")


def pair_function(name: str, a: Column, b: Column) -> Column:
    """One of the pair similarities by name; null if either string is null."""
    return {
        "jw_alpha": lambda: _pairwise("jw_alpha", jaro_winkler, alpha),
        "jw_alnum": lambda: _pairwise("jw_alnum", jaro_winkler, alnum),
        "lcs": lambda: _pairwise("lcs", lcs_length),
        "indel_alpha": lambda: _pairwise("indel_alpha", indel_similarity, alpha),
        "indel_alnum": lambda: _pairwise("indel_alnum", indel_similarity, alnum),
        "damerau_alpha": lambda: _pairwise("damerau_alpha", damerau_similarity, alpha),
        "damerau_alnum": lambda: _pairwise("damerau_alnum", damerau_similarity, alnum),
        "gen_jw": lambda: _pairwise("gen_jw", prefix_mean(_jw)),
        "gen_lev": lambda: _pairwise("gen_lev", prefix_mean(_indel)),
        "gen_damerau": lambda: _pairwise("gen_damerau", prefix_mean(_damerau)),
    }[name]()(a, b)


def metaphone_code(c: Column) -> Column:
    return _single("metaphone", metaphone)(c)


def hash20(c: Column) -> Column:
    """BLAKE2b of 20 bytes, in hex."""
    return _single("hash20", blake2b20)(c)
