"""Substring dedup on word windows behind a count-min prefilter.

A window is `window` consecutive words. Each window owns one gram: the one of its `gram`-word stretches with the least
hash, the leftmost of equals. Equal windows that start at different places own equal grams at different places, so a gram's
count over the corpus is no smaller than the count of any window that owns it, and there are several times fewer grams than
windows.

First pass: each part of a partition makes a count-min sketch of its owned grams (PLANES rows of counters that stop at 2).
The sketches are cut into slices of the counters, and each slice is merged by one task: what comes back to a part is a bit
for each of its counters, and from these the part marks its grams. The number of slices grows with the corpus, so counters
stay as sparsely used at any size, and no task, broadcast or driver ever holds more than a slice. Second pass: only windows
whose gram may occur twice are grouped, by 128 bits of hash, for the first place (smallest id, then row, then start) of
each. A row is told which of its possible windows are first; all its other possible windows are repeats, and the words that
those cover go. Windows are judged on the input.

Every row is a document of its own. Null and empty texts have no words. Texts of fewer words than a window lose nothing. Null
ids come before all others; rows without an id, or with the same one, go in an order of their own: of equal ones one stays.
Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, rolling

WINDOW, GRAM = 20, 8
#: Rows of counters in the sketch.
PLANES = 2
#: Bytes of text for each counter of a plane: an owned gram stands for some 40.
SPREAD = 5
#: Bits of a counter's number in a slice, at most: a slice is merged in one task, with a byte for each of its counters.
SLICE_BITS = 26
#: Grams that a task sketches before it sends what it has, and those that go in one record.
FLUSH, PIECE = 1_000_000, 1 << 15
#: Places in a document when a row and a place share a long.
PLACE_BITS = 24
LEAST = -(1 << 63)


class Windows:
    """Owned grams and window hashes of one text. Made once a task."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.first, self.second = rolling.Hasher(11), rolling.Hasher(12)

    def words(self, raw: bytes) -> np.ndarray:
        self.data = np.frombuffer(raw, np.uint8)
        self.starts, self.stops = rolling.word_spans(self.data)
        return self.first.words(self.data, self.starts, self.stops)

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each gram, and for each window the place of the gram that it owns."""
        h = self.first.windows(words, self.gram)
        return h, rolling.least_in_windows(h, self.window - self.gram + 1)

    def full(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each window, of words told by two hashes."""
        other = self.second.words(self.data, self.starts, self.stops)
        return self.first.windows(words, self.window), self.second.windows(other, self.window)


def counters_of(h: np.ndarray, plane: int, slices: int, bits: int) -> np.ndarray:
    """Slice and counter of each hash in a long: slice << bits | counter."""
    g = rolling.mix(h + np.uint64(0x9E3779B97F4A7C15 * (plane + 1) & (1 << 64) - 1))
    part = (g >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    return (part << np.uint64(bits) | g & np.uint64((1 << bits) - 1)).view(np.int64)


def width(size: int) -> tuple[int, int]:
    """Number of slices and bits of a counter's number in one, for so many bytes of text: SPREAD bytes a counter whatever the size."""
    counters = max(size // SPREAD, 1 << 18)
    bits = min(max((counters // 64).bit_length(), 12), SLICE_BITS)
    return -(-counters >> bits), bits


def pack(values: np.ndarray) -> bytes:
    """Rising integers as compressed differences, a plane for each byte."""
    steps = np.diff(values, prepend=0).astype("<u4")
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


#: to: where a record goes first; then part, plane and slice tell what it is. Plane -1: hashes (one) and rows (two) of a part.
_RECORD = "to long, part long, plane int, slice int, n int, one binary, two binary"


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _RECORD.split(", ")])


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").view(bool)


def partition_sketches(rows: DataFrame, slices: int, bits: int, window: int, gram: int) -> DataFrame:
    """From row and raw: the sketch of each part (some FLUSH grams of one task), cut by slices, and the part's own list of hashes."""

    def run(batches):
        tool, held, n, turn = Windows(window, gram), [], 0, 0
        task = TaskContext.get().partitionId()

        def sent():
            part = task << 24 | turn
            h = np.concatenate([x for _, x in held])
            owners, sizes = np.array([r for r, _ in held], np.int64), np.array([x.size for _, x in held], np.int64)
            for k, i in enumerate(range(0, h.size, PIECE)):
                mine = np.concatenate([owners, sizes]).tobytes() if not i else b""
                yield _records([(-1 - (part * 31 + k), part, -1, k, len(owners), h[i : i + PIECE].tobytes(), mine)])
            for plane in range(PLANES):
                at, counts = np.unique(counters_of(h, plane, slices, bits), return_counts=True)
                begin = np.flatnonzero(np.diff(at >> bits, prepend=-1))
                out = []
                for i, j in zip(begin.tolist(), [*begin[1:].tolist(), at.size], strict=True):
                    s = int(at[i] >> bits)
                    out.append((plane * slices + s, part, plane, s, j - i, pack(at[i:j] & (1 << bits) - 1), _bits(counts[i:j] > 1)))
                    if len(out) == 1024:
                        yield _records(out)
                        out = []
                if out:
                    yield _records(out)

        for batch in batches:
            for i, raw in zip(batch.column("row").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                h, owned = tool.grams(tool.words(raw))
                if owned.size:
                    held.append((i, h[places(owned)]))
                    n += held[-1][1].size
            if n > FLUSH:
                yield from sent()
                held, n, turn = [], 0, turn + 1
        if n:
            yield from sent()

    return rows.mapInArrow(run, _RECORD)


def merged(sketches: DataFrame, bits: int) -> DataFrame:
    """The sketches of all parts added up, slice by slice. Back to each part: a bit for each of its counters, whether it reached 2 over the corpus."""

    def run(batches):
        held: list[tuple] = []

        def close():
            total = np.zeros(1 << bits, np.uint8)
            for *_, n, one, two in held:
                at = unpack(one)
                total[at] = np.minimum(total[at] + 1 + _flags(two, n), 2)
            return _records([(part, part, plane, s, n, _bits(total[unpack(one)] > 1), None) for _, part, plane, s, n, one, _ in held])

        for batch in batches:
            for record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if record[2] < 0:  # a part's own list only passes
                    yield _records([(record[1], *record[1:])])
                    continue
                if held and held[0][0] != record[0]:
                    yield close()
                    held = []
                held.append(record)
        if held:
            yield close()

    return sketches.repartition("to").sortWithinPartitions("to", "part").mapInArrow(run, _RECORD)


def estimated_repeats(answers: DataFrame, slices: int, bits: int) -> DataFrame:
    """row and marks, a bit for each of the row's owned grams in order: whether all its counters reached 2. Rows without any are left out."""

    def run(batches):
        held: list[tuple] = []

        def close():
            own = [r for r in held if r[2] < 0]
            h = np.concatenate([np.frombuffer(r[5], np.uint64) for r in own])
            owners, sizes = np.frombuffer(own[0][6], np.int64).reshape(2, -1)
            yes = np.ones(h.size, bool)
            for plane in range(PLANES):
                _, at = np.unique(counters_of(h, plane, slices, bits), return_inverse=True)
                yes &= np.concatenate([_flags(r[5], r[4]) for r in held if r[2] == plane])[at]
            ends = np.cumsum(sizes)
            some = np.flatnonzero(np.add.reduceat(yes, ends - sizes))
            marks = [_bits(yes[ends[k] - sizes[k] : ends[k]]) for k in some]
            return pa.RecordBatch.from_arrays([pa.array(owners[some]), pa.array(marks, pa.binary())], ["row", "marks"])

        for batch in batches:
            for record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][1] != record[1]:
                    yield close()
                    held = []
                held.append(record)
        if held:
            yield close()

    return answers.repartition("part").sortWithinPartitions("part", "plane", "slice").mapInArrow(run, "row long, marks binary")


def places(owned: np.ndarray) -> np.ndarray:
    """The different owned grams, in order."""
    return owned[np.flatnonzero(np.diff(owned, prepend=-1))]


def window_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw (the text's bytes) and removed: (start, stop) pairs of words, flat, that the repeats cover. One row for each row of docs."""
    rows, known = common.rows_told_apart(docs, id_col, "raw", raw=common.text_bytes(text_col))
    slices, bits = width(known["bytes"] or 0)
    sketches = partition_sketches(rows.select("row", "raw"), slices, bits, window, gram)
    marks = common.written(estimated_repeats(merged(sketches, bits), slices, bits), "estimated")

    def possible(tool: Windows, words: np.ndarray, marked: bytes) -> np.ndarray:
        """Starts of the windows whose gram may occur twice."""
        h, owned = tool.grams(words)
        at = places(owned)
        yes = np.zeros(h.size, bool)
        yes[at] = _flags(marked, at.size)
        return np.flatnonzero(yes[owned])

    def emit(batches):
        tool = Windows(window, gram)
        for batch in batches:
            parts = []
            for i, row, raw, marked in zip(*(batch.column(n).to_pylist() for n in ("id", "row", "raw", "marks")), strict=True):
                words = tool.words(raw)
                at = possible(tool, words, marked)
                a, b = tool.full(words)
                parts.append((a[at].view(np.int64), b[at].view(np.int64), np.full(at.size, LEAST if i is None else i), np.full(at.size, i is not None), np.full(at.size, row), at.astype(np.int32)))
            if parts:
                a, b, ids, there, row, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ids, pa.int64(), mask=~there), pa.array(row, pa.int64()), pa.array(at)], ["a", "b", "id", "row", "at"])

    found = rows.select("id", "row", "raw").join(marks, "row").mapInArrow(emit, "a long, b long, id long, row long, at int")
    if known["by_id"] and known["least"] is not None and known["least"] >= 0 and known["greatest"] < 1 << (62 - PLACE_BITS) and known["longest"] < 1 << PLACE_BITS:
        # Row and place in one long: minima of longs are aggregated by hash, those of structs by sorting. The minimum is the same.
        first = found.groupBy("a", "b").agg(F.min(F.col("row") * (1 << PLACE_BITS) + F.col("at")).alias("f"))
        first = first.select(F.shiftright("f", PLACE_BITS).alias("row"), F.col("f").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("at"))
    else:
        # Null ids come first, as nulls do in structs; rows of one id go by their numbers.
        first = found.groupBy("a", "b").agg(F.min(F.struct("id", "row", "at")).alias("f")).select("f.row", "f.at")
    first = first.groupBy("row").agg(F.collect_list("at").alias("first"))
    told = common.written(marks.join(first, "row", "left"), "first")
    common.remove(marks)

    def remove(batches):
        tool = Windows(window, gram)
        for batch in batches:
            out = []
            for raw, marked, first_ in zip(*(batch.column(n).to_pylist() for n in ("raw", "marks", "first")), strict=True):
                if marked is None:
                    out.append([])
                    continue
                words = tool.words(raw)
                at = np.setdiff1d(possible(tool, words, marked), first_ or [])
                gone = rolling.covered(at, window, words.size)
                out.append(np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("raw"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "raw", "removed"])

    return rows.join(told, "row", "left").select("id", "raw", "marks", "first").mapInArrow(remove, "doc_id long, raw binary, removed array<int>")


def kept_words(raw: bytes, removed: list[int]) -> tuple[int, bytes]:
    """Number of words, and those outside the removed stretches joined by spaces."""
    words = raw.split()
    if not removed:
        return len(words), b" ".join(words)
    keep = np.ones(len(words), bool)
    for a, b in zip(removed[::2], removed[1::2], strict=True):
        keep[a:b] = False
    return len(words), b" ".join(compress(words, keep.tolist()))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 20-word windows."""
    found = window_repeats(common.table(spark, sf_dir, "documents"))

    def make():
        def step(rows):
            out: dict[str, list] = {"doc_id": rows["doc_id"], "n_words": [], "n_removed": [], "kept_sha256": []}
            for raw, removed in zip(rows["raw"], rows["removed"], strict=True):
                n, kept = kept_words(raw, removed)
                out["n_words"].append(n)
                out["n_removed"].append(sum(removed[1::2]) - sum(removed[::2]))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            return out

        return step

    return common.map_rows(found, make, "doc_id long, n_words long, n_removed long, kept_sha256 string")
