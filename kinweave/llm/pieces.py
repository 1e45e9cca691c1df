"""Encoding and decoding with a merge-type (BPE) SentencePiece model, by a table of prefixes.

In a merge-type vocabulary the encodings of all prefixes of a string fit together: the encoding of a prefix is its last
token behind the encoding of a shorter prefix. So a table with the one last token of each prefix holds the whole encoding.
An automaton gives the tokens that end at each position; of those exactly one may follow the last token of the prefix before
it, where two tokens may stand side by side if no merge across their seam would have come first. Ids are recovered from the
end of the table backwards.

Merges never cross the start of a word (pieces hold the space mark only at their front) nor a character that no piece
holds, so a text is cut there and equal parts are encoded once and kept, up to a bound. Characters outside the vocabulary
become their bytes. Runs of two or more spaces are merged step by step, since the model gives their pieces equal scores.

Null and empty texts have no tokens but begin and end. Any text is allowed; repeated rows repeat; the id column may be null.
Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Parts kept by a worker; when there are so many, all are dropped.
KEPT = 250_000
#: Parts longer than this many characters are not kept.
KEEP_UP_TO = 64
NEVER = 1 << 60


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Encoder and decoder of one model. Loaded once a worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = model.bos_id(), model.eos_id()
        n = model.get_piece_size()
        names = model.id_to_piece(list(range(n)))
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.ids = {names[i]: i for i in range(n) if plain[i]}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.length = [len(x) for x in names]
        self.names = names
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in range(n) if plain[i]}, reverse=True))}
        self.rank = {i: order[model.get_score(i)] for i in range(n) if plain[i]}
        self.known = frozenset("".join(self.ids))
        if any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("pieces that hold a space inside are not supported")
        inner = "".join(re.escape(c) for c in sorted(self.known - {MARK}))
        self.parts = re.compile(f"{MARK}*[{inner}]+|{MARK}+|.", re.S)
        self.whole = re.compile(f"{MARK}*[{inner}]+").fullmatch
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        #: By left token, the right tokens that have been judged against it.
        self.fits: list[dict[int, bool]] = [{} for _ in range(n)]
        self.judgements = 0
        self.kept: dict[str, bytes] = {}

    def merged(self, text: str) -> list[int]:
        """Step by step: of all neighbours that form a piece, the best and of equals the leftmost join, until none do."""
        n = len(text)
        # parts[k]: the part that starts at k, empty once it has been joined to the one before it.
        parts, before, after = list(text), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                both = parts[k] + parts[after[k]]
                i = self.ids.get(both)
                if i is not None:
                    heapq.heappush(heap, (self.rank[i], k, both))

        for k in range(n):
            offer(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            right = after[k]
            # Of an offer whose parts have been joined otherwise since, the lengths no longer add up.
            if not parts[k] or right >= n or len(parts[k]) + len(parts[right]) != len(both):
                continue
            parts[k], parts[right], after[k] = both, "", after[right]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [self.ids[p] for p in parts if p]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; null for a single character."""
        if token not in self.halves:
            parts, last = list(self.names[token]), None
            while len(parts) > 1:
                best = min(((self.rank[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
                if best is None:
                    raise ValueError(f"no merges make {self.names[token]!r}")
                k = best[1]
                last = self.ids[parts[k]], self.ids[parts[k + 1]]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.halves[token] = last
        return self.halves[token]

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that stand at one edge while this one is being made: (token, its birth, its end), as ranks."""
        key = token, side
        if key not in self.spines:
            out, until = [], NEVER
            while token is not None:
                half = self.split(token)
                born = self.rank[token] if half else -1
                out.append((token, born, until))
                token, until = (half[side], born) if half else (None, until)
            self.spines[key] = out
        return self.spines[key]

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side: no merge across the seam comes before the merges that make them."""
        for x, x_born, x_end in self.spine(left, 1):
            for y, y_born, y_end in self.spine(right, 0):
                if x_born < y_end and y_born < x_end:
                    i = self.ids.get(self.names[x] + self.names[y])
                    if i is not None and self.rank[i] < x_end and self.rank[i] <= y_end:
                        return False
        return True

    def table(self, part: str) -> list[int]:
        """The last token of each prefix of a part whose characters are all known (at 0: -1)."""
        last, length, fits = [-1] * (len(part) + 1), self.length, self.fits
        for end, token in self.automaton.iter(part):
            end += 1
            if last[end] < 0:
                before = last[end - length[token]]
                if before < 0:  # only at the start of the part
                    last[end] = token
                    continue
                fit = fits[before].get(token)
                if fit is None:
                    fit = self.judged(before, token)
                if fit:
                    last[end] = token
        return last

    def judged(self, left: int, right: int) -> bool:
        fit = self.fits[left][right] = self.fit(left, right)
        self.judgements += 1
        return fit

    def encode_part(self, part: str) -> list[int]:
        if MARK * 2 in part:
            return self.merged(part)
        last, length, ids, at = self.table(part), self.length, [], len(part)
        while at:
            token = last[at]
            ids.append(token)
            at -= length[token]
        ids.reverse()
        return ids

    def part_ids(self, word: str) -> bytes:
        """Ids, as bytes, of a string that begins with a space mark and has none that follows another character."""
        if self.whole(word):
            ids = self.encode_part(word)
        else:
            ids = []
            for part in self.parts.findall(word):
                if part[-1] in self.known:
                    ids += self.encode_part(part)
                else:
                    ids += [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")]
        out = array("I", ids).tobytes()
        if len(word) <= KEEP_UP_TO:
            if len(self.kept) >= KEPT:
                self.kept.clear()
                if self.judgements > 4 * KEPT:
                    self.judgements = 0
                    for known in self.fits:
                        known.clear()
            self.kept[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """All ids without begin and end, each as four bytes, low byte first."""
        if not text:
            return b""
        words = text.replace(MARK, " ").split(" ")
        if "" in words:
            words = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        else:
            words = [MARK + w for w in words]
        kept, make = self.kept, self.part_ids
        return b"".join([kept.get(w) or make(w) for w in words])

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def encode_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int, with begin and end) of every text."""

    def make():
        pieces = Pieces(path or default_model())

        def step(rows):
            return {"doc_id": rows["doc_id"], "ids": [[pieces.bos, *array("I", pieces.encode(x)), pieces.eos] for x in rows["text"]]}

        return step

    return common.map_rows(_input(docs, id_col, text_col), make, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id and ids; begin, end and null ids give no text."""

    def make():
        pieces = Pieces(path or default_model())
        return lambda rows: {"doc_id": rows["doc_id"], "text": [pieces.decode(x or []) for x in rows["ids"]]}

    return common.map_rows(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass."""

    def make():
        pieces = Pieces(path or default_model())
        first, last = array("I", [pieces.bos]).tobytes(), array("I", [pieces.eos]).tobytes()

        def step(rows):
            out: dict[str, list] = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in rows["text"]:
                ids = first + pieces.encode(text) + last
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(pieces.decode(array("I", ids).tolist()).encode()).hexdigest())
            return out

        return step

    return common.map_rows(_input(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every text encoded with begin and end, and decoded."""
    return piece_digests(common.table(spark, sf_dir, "documents"))
