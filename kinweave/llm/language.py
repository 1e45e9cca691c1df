"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of one to three characters (letters in lower case, all else a space) are hashed to 2**BITS buckets. A text's vector is
each bucket's share of the grams of its length times the bucket's inverse document frequency, which is counted over all
training documents. Weights are trained by follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) on
at most SAMPLE documents taken by hash of the id; every CALIBRATE-th of them is kept back and gives the temperature that
makes the probabilities fit. Weights are then fixed-point integers, so that a text's score never depends on its batch.

Texts that are null or hold no letter are `und` with score 0. Rows with a null language teach nothing; without training
rows every text with letters is `und`. Only text is an input of a prediction. Long texts are read whole. Repeated rows
repeat, null ids are held out; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 15
GRAMS = 3
#: Most documents that the weights are trained on.
SAMPLE = 3000
CALIBRATE = 5
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 2e-3, 1e-3, 3
SCALE = 100.0
FIXED = 1 << 16
SPACE = 32


def letter_map() -> np.ndarray:
    """Lower-case letter of each code of the basic plane, a space for what is no letter."""
    out = np.full(65536, SPACE, np.uint32)
    for c in range(65536):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Grams:
    def __init__(self):
        self.map = letter_map()

    def codes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = self.map[np.minimum(raw, 65535)]
        high = raw > 65535
        if high.any():
            low[high] = [ord(c) if (c := chr(x)).isalpha() else SPACE for x in raw[high].tolist()]
        return low

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Bucket of each gram by length, over all texts behind one another; each text's first place; whether it has a letter.

        Each text stands between GRAMS spaces, so that it has grams and none of those counted reaches into another.
        """
        gap = np.full(GRAMS, SPACE, np.uint32)
        parts, lengths, letters = [gap], [], []
        for t in texts:
            c = self.codes(t)
            parts += [c, gap]
            lengths.append(c.size + GRAMS)
            letters.append(bool((c != SPACE).any()))
        all_codes = np.concatenate(parts).astype(np.uint64)
        n = int(sum(lengths))
        h = np.zeros(n, np.uint64)
        out = []
        for k in range(GRAMS):
            h = (h + all_codes[GRAMS - 1 - k : GRAMS - 1 - k + n] + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            out.append((((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int32))
        return out, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), np.array(letters, bool)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training documents each bucket occurs, and how many there are. All documents are counted."""

    def make():
        grams = Grams()

        def step(rows):
            seen = np.zeros(1 << BITS, np.int64)
            for text in rows["text"]:
                mark = np.zeros(1 << BITS, bool)
                for ids in grams.ids([text])[0]:
                    mark[ids] = True
                seen += mark
            at = np.flatnonzero(seen)
            return {"bucket": [-1, *at.tolist()], "n": [len(rows["text"]), *seen[at].tolist()]}

        return step

    counts = common.map_rows(train.select("text"), make, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(1 << BITS, np.int64)
    total = 0
    for bucket, n in counts.collect():  # 2 ** BITS + 1 rows at most
        if bucket < 0:
            total = n
        else:
            found[bucket] = n
    return found, total


def sample_vectors(train: DataFrame, most: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, values) of at most `most` documents, by hash of the id; values: share of the grams of a length, without idf."""
    by = F.xxhash64(F.lit("language"), F.col("doc_id"))
    last = train.select(by.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return []

    def make():
        grams = Grams()

        def step(rows):
            out = {"lang": rows["lang"], "buckets": [], "counts": []}
            for text in rows["text"]:
                total = sum(np.bincount(ids, minlength=1 << BITS) for ids in grams.ids([text])[0])
                at = np.flatnonzero(total)
                out["buckets"].append(at.tolist())
                out["counts"].append(total[at].tolist())
            return out

        return step

    picked = train.where(by <= F.lit(last)).orderBy(by, "doc_id").limit(most).select("lang", "text")
    out = []
    for lang, buckets, counts in common.map_rows(picked, make, "lang string, buckets array<int>, counts array<int>").collect():
        c = np.array(counts, np.float64)
        out.append((lang, np.array(buckets, np.int64), c / (c.sum() / GRAMS)))
    return out


class Leader:
    """Follow-the-regularised-leader for multinomial logistic regression."""

    def __init__(self, classes: int):
        self.z = np.zeros((1 << BITS, classes))
        self.n = np.zeros((1 << BITS, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_model(train: DataFrame, most: int = SAMPLE) -> dict:
    """languages, weights (int32, fixed point, idf included) and temperature, from doc_id, text and lang (none null)."""
    df, total = document_frequencies(train)
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = sample_vectors(train, most)
    languages = sorted({r[0] for r in rows})
    place = {x: k for k, x in enumerate(languages)}
    rows = [(place[lang], at, SCALE * v * idf[at]) for lang, at, v in rows]
    fit, back = [r for k, r in enumerate(rows) if k % CALIBRATE], rows[::CALIBRATE]
    leader = Leader(len(languages))
    for turn in range(PASSES):
        for k in np.random.default_rng(turn).permutation(len(fit)):
            label, at, x = fit[k]
            leader.learn(at, x, label)
    weights = leader.weights()
    temperature = 1.0
    if back and languages:
        logits, labels = np.array([x @ weights[at] for _, at, x in back]), np.array([r[0] for r in back])
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()
        temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return {"languages": languages, "weights": np.rint(weights * idf[:, None] * FIXED).astype(np.int32), "temperature": temperature}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score. The model has a fixed number of buckets; it goes to the workers by broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    languages = model["languages"]

    def make():
        grams, weights = Grams(), shared.value["weights"]
        columns = [np.ascontiguousarray(weights[:, k]) for k in range(len(languages))]
        temperature = shared.value["temperature"]

        def scored(texts: list[str]) -> tuple[list[str], list[float]]:
            ids, starts, letters = grams.ids(texts)
            n = np.diff([*starts, ids[0].size])
            sums = np.empty((len(texts), len(columns)))
            for k, column in enumerate(columns):
                sums[:, k] = sum(np.add.reduceat(column[i], starts, dtype=np.int64) for i in ids)
            p = softmax(SCALE * sums / FIXED / n[:, None] / temperature)
            best = p.argmax(axis=1)
            return [languages[b] if yes else "und" for b, yes in zip(best, letters, strict=True)], np.where(letters, p.max(axis=1), 0.0).tolist()

        def step(rows):
            texts = rows["text"]
            if not languages:
                return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
            said: list[str] = []
            scores: list[float] = []
            group: list[str] = []
            for k, t in enumerate(texts):
                group.append(t)
                if k + 1 == len(texts) or sum(map(len, group)) > 1 << 17:
                    a, b = scored(group)
                    said += a
                    scores += b
                    group = []
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": said, "score": scores}

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return common.map_rows(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the rows that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train_model(training_rows(docs)))
