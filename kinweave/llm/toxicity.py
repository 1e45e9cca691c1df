"""Toxicity by a subsequence string kernel: a support vector machine over the sentences of labelled documents, with Nyström landmarks.

A text is a list of sentences, a sentence a set of units: its words in lower case, letters and digits only, between marks for
their two ends; runs of three or more single letters are joined (spelled-out words). The kernel of two units counts the
subsequences of ORDER characters that they share, each weighted DECAY to the power of the stretch it covers in both, so
that letters put between still leave a match; it is divided by the root of both units' kernels with themselves, and kernels
under NEAR, or of units that do not hold HELD of a landmark's characters in order, are 0. The kernel of a sentence with a
landmark is the sum over its units.

Landmarks are bounded strings that set toxic labelled documents apart from others: stems, taken until none passes the bar, and
whole words that hold a stem. A sentence's kernels with them, times the inverse root of the landmarks' own kernel matrix,
are its features, and a linear machine with squared hinge loss is trained on them: sentences of toxic documents against
sentences of others. Labels are those of whole documents, so the toxic sentences are learned, too: at first all of a toxic
document that have any feature, then those the machine itself finds toxic, and the document's worst. A document's evidence
is the margin of its worst sentence and the mean of those of its TOP worst ones. A logistic curve fitted on training
documents makes a probability of both, which is the score: it rises with either, so several doubtful sentences count for
more than one, and sentences added to a text never lower its score.

At most POSITIVE and NEGATIVE labelled documents of at most LONGEST_TEXT bytes, by hash of the id, are learned from, and none
that are held out. All texts are scored whole.

Null, empty and word-less texts have the evidence of an empty sentence. Units of more than LONGEST characters are read in
overlapping windows, sentences of more than SENTENCE words in pieces. Labels that are null teach nothing; of several labels
for an id the highest counts. Without toxic labels every score is that of the prior, 0. Repeated rows repeat; null ids are
held out; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER, DECAY = 4, 0.7
#: Least kernel that counts, and the share of a landmark's characters that a unit must hold in order.
NEAR, HELD = 0.2, 0.86
#: Marks for the two ends of a word.
LEFT, RIGHT = "\x02", "\x03"
#: Characters of a window of a long unit, and from one window to the next; two overlap by twice the longest landmark.
LONGEST, STRIDE, MARKED = 40, 16, 12
#: Words of a sentence, at most.
SENTENCE = 60
#: Most labelled documents learned from, and the most bytes of one.
POSITIVE, NEGATIVE, LONGEST_TEXT = 1500, 2500, 20_000
#: Least likelihood ratio statistic of a stem and of a whole word that holds one, and fewest toxic documents that have either.
LEAST_G, WORD_G, LEAST_DOCS = 30.0, 15.0, 3
KEPT = 400_000
#: Units that are held against the landmarks at once.
PART = 16_384
#: Worst sentences of a document whose mean margin counts beside that of the very worst.
TOP = 2
#: Weight of either class in training.
COST = 10_000.0
SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}[.,;:!?]*(?!\S)")
END = re.compile(r"(?<=[^\s.!?]{2}[.!?])\s+|\n+")


def units(text: str) -> set[str]:
    """Words in lower case, and spelled-out ones in one."""
    low = text.lower()
    found = set(low.split())
    for run in SPELLED.findall(low):
        found.add(re.sub(r"\s", "", run))
    return found


def sentences(text: str) -> list[str]:
    """Parts that end in a line or after a point, of at most SENTENCE words."""
    out = []
    for part in END.split(text):
        words = part.split(" ")
        out += [part] if len(words) <= SENTENCE else [" ".join(words[i : i + SENTENCE]) for i in range(0, len(words), SENTENCE)]
    return out


def core(unit: str) -> str:
    """A unit's letters and digits; all of it, if it has none."""
    return unit if unit.isalnum() else "".join(filter(str.isalnum, unit)) or unit


def windows(unit: str) -> list[str]:
    """The core between its marks, in pieces of at most LONGEST."""
    marked = f"{LEFT}{core(unit)}{RIGHT}"
    if len(marked) <= LONGEST:
        return [marked]
    return [marked[i : i + LONGEST] for i in range(0, len(marked) - LONGEST + STRIDE, STRIDE)]


def _codes(strings: list[str], width: int, blank: int) -> np.ndarray:
    out = np.full((len(strings), width), blank, np.int32)
    for k, s in enumerate(strings):
        out[k, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Kernels of left[k] with right[k]; left has rows of one length, right is filled with -2."""
    rows, width = right.shape
    steps = np.arange(width)
    # fading[j, k]: weight that what ended at j has at k.
    fading = np.where(steps[None, :] >= steps[:, None], DECAY ** (steps[None, :] - steps[:, None]), 0.0).astype(np.float32)
    # open_[i]: subsequences of i + 1 characters that began in both, faded to here; each stands one place further right.
    open_ = [np.zeros((rows, width + 1), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(rows, np.float32)
    for x in range(left.shape[1]):
        same = (left[:, x, None] == right) * np.float32(DECAY**2)
        ended = [same, *(same * o[:, :-1] for o in open_)]
        total += ended[-1].sum(axis=1)
        for o, e in zip(open_, ended, strict=False):
            o *= np.float32(DECAY)
            o[:, 1:] += e @ fading
    return total


@functools.cache
def _letter_masks(right: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the strings, and for each letter and string a bit at each of its places; none in the last row."""
    letters = sorted({c for s in right for c in s})
    masks = np.zeros((len(letters) + 1, len(right)), np.uint32)
    for k, s in enumerate(right):
        for i, c in enumerate(s):
            masks[letters.index(c), k] |= np.uint32(1 << i)
    return np.array([ord(c) for c in letters], np.int32), masks


def _shared(left: np.ndarray, right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each row of left with each string, 32 characters at most: one bit a character."""
    v = np.full((left.shape[0], len(right)), 0xFFFFFFFF, np.uint32)
    letters, masks = _letter_masks(tuple(right))
    at = np.minimum(np.searchsorted(letters, left), letters.size - 1)
    at = np.where(letters[at] == left, at, letters.size)
    for x in range(left.shape[1]):
        m = masks[at[:, x]]
        u = v & m
        v = (v + u) | (v - u)
    full = np.array([(1 << len(s)) - 1 for s in right], np.uint32)
    return np.bitwise_count(~v & full)


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Unnormalised kernels of all a with all b (at most 32 characters). Only pairs that share a subsequence of ORDER are worked out."""
    out = np.zeros((len(a), len(b)))
    lengths = np.array([len(s) for s in a])
    right = _codes(b, max(map(len, b), default=1), -2)
    for n in np.unique(lengths[lengths >= ORDER]):
        rows = np.flatnonzero(lengths == n)
        left = _codes([a[i] for i in rows], n, -1)
        p, q = np.nonzero(_shared(left, b) >= ORDER)
        for i in range(0, p.size, 4096):
            k, m = p[i : i + 4096], q[i : i + 4096]
            out[rows[k], m] = _pairs(left[k], right[m])
    return out


def own_kernel(a: list[str]) -> np.ndarray:
    """Kernel of each string with itself."""
    out = np.zeros(len(a))
    lengths = np.array([len(s) for s in a])
    for n in np.unique(lengths[lengths >= ORDER]):
        rows = np.flatnonzero(lengths == n)
        left = _codes([a[i] for i in rows], n, -1)
        for i in range(0, rows.size, 2048):
            out[rows[i : i + 2048]] = _pairs(left[i : i + 2048], left[i : i + 2048])
    return out


@functools.cache
def _roots(strings: tuple[str, ...]) -> np.ndarray:
    return np.sqrt(own_kernel(list(strings)))


def near(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernels of all strings with all landmarks; 0 where too few characters are shared or the kernel is under NEAR."""
    out = np.zeros((len(strings), len(landmarks)))
    if not landmarks:
        return out
    own = _roots(tuple(landmarks))
    least = np.array([math.ceil(HELD * len(s)) for s in landmarks])
    lengths = np.array([len(s) for s in strings])
    right = _codes(landmarks, max(map(len, landmarks)), -2)
    for n in np.unique(lengths[lengths >= ORDER]):
        rows = np.flatnonzero(lengths == n)
        left = _codes([strings[i] for i in rows], n, -1)
        p, q = np.nonzero(_shared(left, landmarks) >= least)
        if p.size:
            some, back = np.unique(p, return_inverse=True)
            roots = np.sqrt(own_kernel([strings[rows[i]] for i in some]))[back]
            for i in range(0, p.size, 4096):
                k, m = p[i : i + 4096], q[i : i + 4096]
                value = _pairs(left[k], right[m]) / (roots[i : i + 4096] * own[m])
                out[rows[k], m] = np.where(value >= NEAR, value, 0)
    return out


class Machine:
    """A trained model: stems and whole words as landmarks, the features' projection, the machine's weights and the logistic curves."""

    def __init__(self, stems: list[str], words: list[str]):
        self.stems, self.words = stems, words
        own = near(stems + words, stems + words)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        self.project = vectors / np.sqrt(np.maximum(values, 1e-3))
        self.weights, self.bias = np.zeros(len(own)), -1.0
        self.curve = (1.0, 0.0, 0.0)

    def kernels(self, strings: list[str]) -> np.ndarray:
        """near() with all landmarks; only strings near a stem are held against whole words, which hold stems."""
        out = np.zeros((len(strings), len(self.stems) + len(self.words)))
        out[:, : len(self.stems)] = near(strings, self.stems)
        some = np.flatnonzero(out.any(axis=1))
        out[some, len(self.stems) :] = near([strings[i] for i in some], self.words)
        return out

    def unit_kernels(self, found: list[str]) -> tuple[list[str], np.ndarray]:
        """The units that are near any landmark, and their kernels; of a unit's windows the one with the greatest sum."""
        units_, rows = [], [np.zeros((0, len(self.stems) + len(self.words)))]
        for i in range(0, len(found), PART):
            part = found[i : i + PART]
            cut = [windows(u) for u in part]
            flat = sorted({w for ws in cut for w in ws})
            raw = self.kernels(flat)
            total = raw.sum(axis=1)
            at = {flat[i]: i for i in np.flatnonzero(total > 0).tolist()}
            best = [max((at[w] for w in ws if w in at), key=lambda i: total[i], default=-1) for ws in cut]
            some = [k for k, i in enumerate(best) if i >= 0]
            units_ += [part[k] for k in some]
            rows.append(raw[[best[k] for k in some]])
        return units_, np.concatenate(rows)

    def pulls(self, found: list[str]) -> dict[str, float]:
        """What each unit that is near a landmark adds to the margin of a sentence."""
        some, raw = self.unit_kernels(found)
        return dict(zip(some, self.pull(raw), strict=True))

    def pull(self, raw: np.ndarray) -> list[float]:
        return np.round(raw @ (self.project @ self.weights), 4).tolist()

    def margins(self, text: str, pulling: dict[str, float]) -> list[float]:
        """Of the sentences of a text that hold units which pull."""
        out = []
        for s in sentences(text) if pulling else []:
            low = s.lower()
            # A unit of a sentence stands in it as it is, or spelled out.
            if any(u in low for u in pulling) or SPELLED.search(low):
                pull = sorted(pulling[u] for u in units(s) & pulling.keys())
                if pull:
                    out.append(round(self.bias + sum(pull), 4))
        return out

    def train(self, x: np.ndarray, y: np.ndarray, c: np.ndarray) -> None:
        """Squared hinge loss, weighted by c, by Newton steps over the rows inside the margin."""
        x = np.hstack([x, np.ones((len(x), 1))])
        w = np.zeros(x.shape[1])
        w[-1] = -1
        ridge = np.eye(x.shape[1])
        ridge[-1, -1] = 1e-6
        for _ in range(30):
            inside = y * (x @ w) < 1
            a = x[inside] * c[inside, None]
            new = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
            if np.allclose(new, w, atol=1e-7):
                break
            w = new
        self.weights, self.bias = w[:-1], round(float(w[-1]), 4)

    def evidence(self, margins: list[float]) -> tuple[float, float]:
        """A document's greatest margin and the mean of its TOP greatest, from those of its sentences and TOP empty ones."""
        top = sorted([*margins, *[self.bias] * TOP], reverse=True)[:TOP]
        return top[0], sum(top) / TOP

    def calibrate(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """The curve of both parts of the evidence, or of the one that raises scores if the other lowers them in it."""
        both = logistic(evidence, toxic)
        if both[0] < 0:
            both = (0.0, *logistic(evidence[:, 1:], toxic))
        elif both[1] < 0:
            both = ((alone := logistic(evidence[:, :1], toxic))[0], 0.0, alone[1])
        self.curve = both

    def probability(self, *margins: float) -> float:
        """Of a document whose sentences have these margins."""
        worst, mean = self.evidence(list(margins))
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * worst + b * mean + c))))


def logistic(x: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Weights of x's columns and the constant, by Newton steps with smoothed labels, both classes weighing as the rows do."""
    p, n = toxic.sum(), (~toxic).sum()
    t = np.where(toxic, (p + 1) / (p + 2), 1 / (n + 2))
    x = np.column_stack([x, np.ones(len(t))])
    ridge = np.r_[np.full(x.shape[1] - 1, 1e-3), 0.0]
    w = np.r_[np.full(x.shape[1] - 1, 1 / (x.shape[1] - 1)), 0.0]
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (q - t) + ridge * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def bounded(word: str) -> list[str]:
    """Beginnings and ends of a word's core with the mark at their side, and all of it with both: of 3 letters or more."""
    c = core(word)
    if not 3 <= len(c) <= MARKED:
        return [LEFT + c[:n] for n in range(3, MARKED + 1)] if len(c) > MARKED else []
    return [f"{LEFT}{c}{RIGHT}", *(LEFT + c[:n] for n in range(3, len(c))), *(c[-n:] + RIGHT for n in range(3, len(c)))]


def likelihood(k: int, p: int, m: int, n: int) -> float:
    """Likelihood ratio statistic of a string in k of p toxic and m of n other documents; 0 unless it is four times as frequent in toxic ones."""
    if k / max(p, 1) <= 4 * m / max(n, 1):
        return 0.0
    total = 0.0
    for seen, size in ((k, p), (m, n)):
        expected = (k + m) * size / (p + n)
        for o, e in ((seen, expected), (size - seen, size - expected)):
            if o > 0 and e > 0:
                total += 2 * o * math.log(o / e)
    return total


def pick_landmarks(toxic: Iterable[set[str]], others: Iterable[set[str]]) -> tuple[list[str], list[str]]:
    """Stems: bounded strings by likelihood ratio, again and again the best (of near equals the longest), without words that
    hold one already, until none passes the bar. Words: whole words that hold a stem and pass theirs. Documents are met one by one."""
    p = n = 0
    docs_of: dict[str, set[int]] = {}
    for doc in toxic:
        for w in doc:
            docs_of.setdefault(core(w), set()).add(p)
        p += 1
    # Most strings stand in one word of one document: no more than a bound on the documents is kept of those.
    most = bytearray(1 << 22)
    for w, held_by in docs_of.items():
        for s in bounded(w):
            k = hash(s) & len(most) - 1
            most[k] = min(most[k] + len(held_by), 255)
    words_of: dict[str, set[str]] = {}
    for w in docs_of:
        for s in bounded(w):
            if most[hash(s) & len(most) - 1] >= LEAST_DOCS:
                words_of.setdefault(s, set()).add(w)
    docs = lambda s: len(set().union(*(docs_of[w] for w in words_of[s])))
    held = {s: k for s in words_of if (k := docs(s)) >= LEAST_DOCS}
    inside: dict[str, tuple[str, ...]] = {}
    against: Counter[str] = Counter()
    for doc in others:
        seen: set[str] = set()
        for w in doc:
            if w not in inside:
                if len(inside) > KEPT // 4:
                    inside.clear()
                inside[w] = tuple(s for s in bounded(w) if s in held)
            seen.update(inside[w])
        against.update(seen)
        n += 1
    inside.clear()
    strength = {s: g for s, k in held.items() if (g := likelihood(k, p, against[s], n)) >= WORD_G}
    whole = {s for s in strength if s[0] == LEFT and s[-1] == RIGHT}
    strength = {s: g for s, g in strength.items() if g >= LEAST_G}
    stems: list[str] = []
    while strength:
        most = max(strength.values())
        best = min((s for s, g in strength.items() if g >= 0.93 * most), key=lambda s: (-len(s), -strength[s], s))
        stems.append(best)
        # Words that hold it are explained; strings of theirs count no longer in documents that do not hold them elsewhere.
        changed = set()
        for w in words_of[best].copy():
            for s in bounded(w):
                if s in words_of:
                    words_of[s].discard(w)
                    changed.add(s)
        for s in changed & strength.keys():
            if (k := docs(s)) < LEAST_DOCS or (g := likelihood(k, p, against[s], n)) < LEAST_G:
                del strength[s]
            else:
                strength[s] = g
        strength.pop(best, None)
    return stems, sorted(w for w in whole if w not in stems and any(s in w for s in stems))


def unlike(texts: list[str]) -> list[str]:
    """The texts without near copies of earlier ones: those that share one of four least shingle hashes."""
    seen: set[tuple[int, int]] = set()
    out = []
    for t in texts:
        words = t.lower().split()
        shingles = {zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))}
        marks = {(k, min((x * odd + 0x7F4A7C15) & 0xFFFFFFFF for x in shingles)) for k, odd in enumerate((1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))}
        if not marks & seen:
            out.append(t)
        seen |= marks
    return out


def train_machine(toxic: list[str], others: list[str]) -> Machine | None:
    """From the texts of toxic and other labelled documents; null if nothing sets them apart."""
    bad_texts, good_texts = unlike(toxic), unlike(others)
    stems, words = pick_landmarks(map(units, bad_texts), map(units, good_texts))
    if not stems:
        return None
    machine = Machine(stems, words)
    texts = bad_texts + good_texts
    bad = np.arange(len(texts)) < len(bad_texts)
    # Units are worked out part by part; only those near a landmark stay, and which of them each text holds.
    raw, at, near_units = [np.zeros((0, len(stems) + len(words)))], {}, []
    for i in range(0, len(texts), 256):
        found = [units(t) for t in texts[i : i + 256]]
        some, rows = machine.unit_kernels(sorted(set().union(*found) - at.keys()))
        raw.append(rows)
        at.update({u: len(at) + k for k, u in enumerate(some)})
        near_units += [f & at.keys() for f in found]
    raw = np.concatenate(raw)
    # One row for each sentence that has any feature, and one for all that have none.
    x, owner = [np.zeros(raw.shape[1])], [-1]
    for k, t in enumerate(texts):
        for s in sentences(t) if near_units[k] else []:
            mine = [at[u] for u in units(s) if u in at]
            if mine:
                x.append(raw[sorted(mine)].sum(axis=0))
                owner.append(k)
    x, owner = np.array(x) @ machine.project, np.array(owner)
    toxic_row = (owner >= 0) & bad[owner]
    positive = toxic_row.copy()
    for _ in range(4):
        use = positive | ~toxic_row
        y = np.where(positive, 1.0, -1.0)
        c = np.where(positive, COST / max(positive.sum(), 1), COST / max((~toxic_row).sum(), 1))
        c[0] = COST / 10  # the empty sentence: most of all there are
        machine.train(x[use], y[use], c[use])
        margin = x @ machine.weights + machine.bias
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner[1:], margin[1:])
        positive = toxic_row & ((margin > 0) | (margin >= worst[owner]))
    known = dict(zip(at, machine.pull(raw), strict=True))
    machine.calibrate(np.array([machine.evidence(machine.margins(t, {u: known[u] for u in f if known[u]})) for t, f in zip(texts, near_units, strict=True)]), bad)
    return machine


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """Texts of at most POSITIVE toxic and NEGATIVE other labelled documents that are not held out, by hash of the id, without those of over LONGEST_TEXT bytes."""
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    turn = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    picked = [marks.where(F.col("toxic") == toxic).orderBy(turn, "doc_id").limit(most) for toxic, most in ((True, POSITIVE), (False, NEGATIVE))]
    # POSITIVE + NEGATIVE rows of two values each, whatever the tables' size.
    ids = F.broadcast(picked[0].union(picked[1]))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= LONGEST_TEXT).join(ids, "doc_id")
    rows = sorted(tuple(r) for r in texts.collect())
    return [t for _, t, toxic in rows if toxic], [t for _, t, toxic in rows if not toxic]


def judge_of(machine: Machine) -> Judge:
    """The machine's judge. A worker has one machine of a broadcast, so tasks that it runs one after the other share what is known."""
    if not hasattr(machine, "judge"):
        machine.judge = Judge(machine)
    return machine.judge


class Judge:
    """Scores of texts by one machine; what units pull is kept, up to a bound."""

    def __init__(self, machine: Machine):
        self.machine, self.known, self.nothing = machine, {}, machine.probability()

    def scores(self, texts: list[str | None]) -> list[float]:
        known, m = self.known, self.machine
        docs = [units(t or "") for t in texts]
        missing = sorted(set().union(*docs) - known.keys())
        if len(known) + len(missing) > KEPT:
            known.clear()
            missing = sorted(set().union(*docs))
        known.update(dict.fromkeys(missing, 0.0))
        known.update(m.pulls(missing))
        out = []
        for t, d in zip(texts, docs, strict=True):
            pulling = {u: x for u in d if (x := known[u])}
            out.append(m.probability(*m.margins(t, pulling)) if pulling else self.nothing)
        return out


def drop_toxic(docs: DataFrame, machine: Machine | None, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores 0.5 or more; all columns as they are."""
    if machine is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        judge = judge_of(shared.value)
        for batch in batches:
            clean = [x < 0.5 for x in judge.scores(batch.column(text_col).to_pylist())]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, held_out, score, predicted. The machine has as many landmarks as the sample of labels bears out; it goes to the workers with the code."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if machine is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        judge = judge_of(shared.value)

        def step(batch):
            p = judge.scores(batch["text"])
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": p, "predicted": [int(x >= 0.5) for x in p]}

        return step

    return common.map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def machine_for(docs: DataFrame, labels: DataFrame) -> Machine | None:
    return train_machine(*labelled_sample(docs, labels))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, machine_for(docs, common.table(spark, sf_dir, "labels")))
