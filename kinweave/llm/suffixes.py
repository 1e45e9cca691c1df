"""Suffix-array dedup: bytes covered by a `length`-byte string that also starts anywhere else in the corpus.

Sorting every suffix of the corpus would move a row for each byte. Instead each `length`-byte window owns an anchor: the
stretch of GRAM bytes in it with the least hash, the leftmost of equals. Equal windows own equal anchors, so only suffixes
that begin at anchors of the same bytes are sorted together, one in about seventy:

* an anchor whose bytes occur once: none of its windows is repeated;
* occurrences with the same surroundings, as far as their windows reach, are a group: one stands for all. In a group of
  several all windows are repeated. Suffixes of an anchor with one group need no sorting;
* otherwise the suffixes from the anchor on, one a group, are sorted, deep-shallow: multikey quicksort, eight bytes a key,
  down to a shallow depth, then a blind trie for each part that still agrees. The common prefixes of neighbours in that
  order, and the common suffixes of what stands before the anchor, tell which windows around it occur elsewhere;
* of an anchor with over HOT groups the windows are counted one by one, by 128 bits of hash, one row a group, aggregated
  before they are shuffled: every split of such windows by the bytes around the anchor ends there.

Matches never cross texts; overlaps in one text count. Every row is a text of its own: rows without an id, or with the same
one, are told apart by numbers. Null texts are empty. Texts shorter than `length` lose nothing but may hold nothing either.
Rows with equal texts lose the same. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.sources.catalog import dimension

from . import common, rolling

LENGTH, GRAM = 200, 64
#: Depth in bytes at which quicksort gives way to blind tries.
SHALLOW = 96
#: Different surroundings of an anchor beyond which its windows are counted one by one.
HOT = 4096
#: An anchor with over one in so many of all repeated ones is dealt out to SALTS tasks.
MANY_ANCHORS, SALTS = 10_000, 64


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[len(a) - n :], "little") ^ int.from_bytes(b[len(b) - n :], "little")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Compact trie that keeps only the place and the byte of each branching; strings are compared with one leaf each."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: int | list | None = None

    def byte(self, k: int, at: int) -> int:
        s = self.strings[k]
        return s[at] if at < len(s) else -1

    def add(self, k: int) -> None:
        if self.root is None:
            self.root = k
            return
        # Blind descent: only the bytes at branchings are looked at.
        node = self.root
        while not isinstance(node, int):
            child = node[1].get(self.byte(k, node[0]))
            node = next(iter(node[1].values())) if child is None else child
        same = common_prefix(self.strings[k], self.strings[node])
        mine, other = self.byte(k, same), self.byte(node, same)
        above, key, node = None, None, self.root
        while not isinstance(node, int) and node[0] < same:
            key = self.byte(k, node[0])
            above, node = node, node[1][key]
        if mine == other:  # equal strings: one leaf stands for all
            while not isinstance(node, int):
                node = next(iter(node[1].values()))
            self.equal.setdefault(node, []).append(k)
            return
        if not isinstance(node, int) and node[0] == same:
            node[1][mine] = k
            return
        new = [same, {other: node, mine: k}]
        if above is None:
            self.root = new
        else:
            above[1][key] = new

    def order(self, ks: list[int]) -> list[int]:
        self.equal: dict[int, list[int]] = {}
        for k in ks:
            self.add(k)
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
                out += self.equal.get(node, ())
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Places of the strings in sorted order."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        ks, depth = stack.pop()
        if len(ks) < 2:
            out += ks
        elif depth >= SHALLOW:
            out += BlindTrie(strings).order(ks)
        else:
            # Multikey quicksort: three parts by the next eight bytes; a string that ends is before all that go on.
            keys = {k: strings[k][depth : depth + 8] for k in ks}
            pivot = keys[ks[len(ks) // 2]]
            less, same, more = [k for k in ks if keys[k] < pivot], [k for k in ks if keys[k] == pivot], [k for k in ks if keys[k] > pivot]
            stack.append((more, depth))
            if len(pivot) < 8:
                stack += [([k], 0) for k in reversed(same)]
            else:
                stack.append((same, depth + 8))
            stack.append((less, depth))
    return out


def repeats_around(before: list[bytes], after: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each occurrence of an anchor, with the bytes before it and from it on: (least, most) numbers of bytes before the
    anchor at which a window of `length` may begin that another occurrence has at the same distance too."""
    n = len(after)
    order = deep_shallow(after)
    lcp = [common_prefix(after[order[i]], after[order[i + 1]]) for i in range(n - 1)]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    # Sets of occurrences that agree on `depth` bytes before the anchor, in suffix order, with their neighbours' prefixes.
    stack = [(order, lcp, 0)]
    while stack:
        ks, near, depth = stack.pop()
        if len(ks) < 2:
            continue
        one = before[ks[0]]
        agree = min(min(common_suffix(one, before[k]) for k in ks[1:]), length)
        for i, k in enumerate(ks):
            right = max(near[i - 1] if i else 0, near[i] if i < len(near) else 0)
            least = max(depth, length - right)
            if least <= agree:
                out[k].append((least, agree))
        groups: dict[int, list[int]] = {}
        for i, k in enumerate(ks):
            if len(before[k]) > agree:
                groups.setdefault(before[k][-agree - 1], []).append(i)
        for places in groups.values():
            if len(places) > 1:
                stack.append(([ks[i] for i in places], [min(near[a:b]) for a, b in zip(places, places[1:], strict=False)], agree + 1))
    return out


class Anchors:
    """Anchors of one text. Made once a task."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.back, self.on = length - gram, length
        self.first, self.second = rolling.Hasher(21), rolling.Hasher(22)

    def owned(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every gram; for each window the place of its anchor."""
        self.data = np.frombuffer(raw, np.uint8)
        if self.data.size < self.length:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.first.byte_windows(self.data, self.gram)
        return h, rolling.least_in_windows(h, self.length - self.gram + 1)

    def surroundings(self, at: np.ndarray) -> np.ndarray:
        """Hash of all that windows with these anchors may hold."""
        start, stop = np.maximum(at - self.back, 0), np.minimum(at + self.on, self.data.size)
        where = self.second.stretches(self.second.table[self.data], start, stop, self.second.bytes_)
        return rolling.mix(where + (at - start).astype(np.uint64))


def places(owned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different anchors, in order, and the first and last of the windows that own each: neighbours, as least places only move on."""
    low = np.flatnonzero(np.diff(owned, prepend=-1))
    return owned[low], low, np.append(low[1:], owned.size) - 1


# A mark is an anchor of one text in a long: first window that owns it, how many follow, where in the first it lies, and two
# bits for what it stands for among the groups of equal surroundings.
CROWD, MANY = 2, 1


def pack_marks(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return ((low << 8 | high - low) << 8 | at - low) << 2


def unpack_marks(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, first and last windows, the two bits."""
    low = marks >> 18
    return low + (marks >> 2 & 255), low, low + (marks >> 10 & 255), marks & 3


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of a column of lists of longs; null is empty."""
    values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().fill_null(0).to_numpy())
    yield from np.split(values, ends[:-1])


def _anchor_rows(rows: DataFrame, length: int, gram: int, marks: bool, frequent: np.ndarray | None = None) -> DataFrame:
    """h and c, the hash of all around, of every anchor; if marks are wanted with row, mark and salt, which differs for frequent ones."""

    def run(batches):
        tool = Anchors(length, gram)
        for batch in batches:
            parts = []
            for i, raw in zip(batch.column("row").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                h, owned = tool.owned(raw)
                if owned.size:
                    at, low, high = places(owned)
                    own = h[at].view(np.int64)
                    more = (np.full(at.size, i, np.int64), pack_marks(at, low, high), np.where(np.isin(own, frequent), i % SALTS, 0).astype(np.int32)) if marks else ()
                    parts.append((own, tool.surroundings(at).view(np.int64), *more))
            if parts:
                columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["h", "c", "row", "mark", "salt"][: len(columns)])

    return rows.mapInArrow(run, "h long, c long" + (", row long, mark long, salt int" if marks else ""))


def _contexts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """From row, raw, marks and keys of the groups that a row stands for: crowd, key, more, row, at, lone, before, after. One surrounding a group; crowded ones window by window."""

    def run(batches):
        tool = Anchors(length, gram)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("crowd", "key", "more", "row", "at", "lone", "before", "after")}
            for i, raw, marks, keys in zip(batch.column("row").to_pylist(), batch.column("raw").to_pylist(), _lists(batch.column("marks")), _lists(batch.column("keys")), strict=True):
                at, low, high, kind = unpack_marks(marks)
                plain = (kind & CROWD) == 0
                pick = at[plain].tolist()
                out["crowd"] += [False] * len(pick)
                out["key"] += keys[plain].tolist()
                out["more"] += [0] * len(pick)
                out["row"] += [i] * len(pick)
                out["at"] += pick
                out["lone"] += ((kind[plain] & MANY) == 0).tolist()
                out["before"] += [raw[max(0, p - tool.back) : p] for p in pick]
                out["after"] += [raw[p : p + tool.on] for p in pick]
                if not plain.all():
                    tool.data = np.frombuffer(raw, np.uint8)
                    at = np.concatenate([np.arange(a, b + 1) for a, b in zip(low[~plain], high[~plain], strict=True)])
                    a, b = (t.stretches(t.table[tool.data], at, at + length, t.bytes_).view(np.int64).tolist() for t in (tool.first, tool.second))
                    for name, x in (("crowd", [True] * at.size), ("key", a), ("more", b), ("row", [i] * at.size), ("at", at.tolist()), ("lone", [True] * at.size), ("before", [None] * at.size), ("after", [None] * at.size)):
                        out[name] += x
            if out["key"]:
                kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], list(out))

    return rows.mapInArrow(run, "crowd boolean, key long, more long, row long, at int, lone boolean, before binary, after binary")


def _sorted_stretches(contexts: DataFrame, length: int) -> DataFrame:
    """row, start, stop: bytes that the sorted suffixes of one anchor prove repeated, for groups of one."""

    def close(held: list[tuple]) -> Iterator[tuple[int, int, int]]:
        for (row, at, lone, *_), found in zip(held, repeats_around([x[3] for x in held], [x[4] for x in held], length), strict=True):
            if lone:
                for least, most in found:
                    yield row, at - most, at - least + length

    def run(batches):
        held: list[tuple] = []
        key = None
        for batch in batches:
            out = []
            for k, *one in zip(*(batch.column(n).to_pylist() for n in ("key", "row", "at", "lone", "before", "after")), strict=True):
                if k != key:
                    out += close(held)
                    held, key = [], k
                held.append(tuple(one))
            if out:
                yield _triples(out)
        if out := list(close(held)):
            yield _triples(out)

    return contexts.where("not crowd").select("key", "row", "at", "lone", "before", "after").repartition("key").sortWithinPartitions("key").mapInArrow(run, "row long, start int, stop int")


def _triples(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    ids, start, stop = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["row", "start", "stop"])


def _runs(start: np.ndarray, stop: np.ndarray) -> list[int]:
    """The union of stretches as starts and stops in turn."""
    if not start.size:
        return []
    # Sorted by start, a run ends where the next start is beyond all stops so far.
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(start[1:] > reach[:-1]) + 1
    return np.column_stack([start[np.r_[0, new]], reach[np.r_[new - 1, start.size - 1]]]).ravel().tolist()


def byte_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, raw (the text's bytes) and removed: (start, stop) pairs of bytes, flat, of the maximal repeated runs. One row for each row of docs. keep: columns that come along in a struct, kept."""
    if length - gram > 255:
        raise ValueError("a window may be at most 255 bytes longer than its anchor")
    rows, _ = common.rows_told_apart(docs, id_col, raw=common.text_bytes(text_col), **({"kept": F.struct(*[F.col(c) for c in keep])} if keep else {}))
    kept_type = f", kept {rows.schema['kept'].dataType.simpleString()}" if keep else ""
    texts = rows.select("row", "raw").where(F.octet_length("raw") >= length)

    # Which anchors occur again, and whether with one surrounding only.
    seen = _anchor_rows(texts, length, gram, False).groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("n > 1")
    kinds = common.written(seen.select("h", (F.col("low") == F.col("high")).alias("alike"), "n"), "anchors")
    # Anchors with over one in MANY_ANCHORS of all repeated ones: fewer than MANY_ANCHORS, whatever the corpus.
    most = max(kinds.agg(F.sum("n")).first()[0] or 0, 1) // MANY_ANCHORS + HOT
    frequent = np.array([r.h for r in kinds.where(F.col("n") > most).select("h").collect()], np.int64)
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, SALTS - 1).otherwise(0)))
    marks = _anchor_rows(texts, length, gram, True, frequent).join(kinds.select("h", "alike", salts.alias("salt")), ["h", "salt"]).groupBy("row").agg(F.collect_list(F.when(F.col("alike"), F.col("mark"))).alias("sure"), F.collect_list(F.when(~F.col("alike"), F.struct("mark", "h", "c"))).alias("open"))
    marks = common.written(marks, "marks")
    common.remove(kinds)

    # Of the others, a group for each surrounding; its first row stands for it.
    each = marks.select("row", F.explode("open").alias("o")).select("row", "o.mark", "o.h", "o.c")
    groups = common.written(each.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("row", "mark")).alias("f")).select("h", "c", "n", "f.row", "f.mark"), "groups")
    # Broadcast where there are few, so that the groups of a crowded anchor do not meet.
    crowds = common.written(groups.groupBy("h").agg(F.count("*").alias("different")).where(F.col("different") > (HOT if hot is None else hot)).select("h", F.lit(CROWD).alias("crowd")), "crowds")
    code = F.col("mark") + F.coalesce("crowd", F.lit(0)) + F.when(F.col("n") > 1, MANY).otherwise(0)
    stand = common.written(groups.join(dimension(crowds), "h", "left").groupBy("row").agg(F.collect_list(F.struct(code.alias("mark"), F.col("h").alias("key"))).alias("all")).select("row", F.col("all.mark").alias("marks"), F.col("all.key").alias("keys")), "stand")
    contexts = common.written(_contexts(texts.join(stand, "row"), length, gram), "contexts")
    proven = _sorted_stretches(contexts, length).groupBy("row").agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 31) + F.col("stop")).alias("proven"))
    single = contexts.where("crowd").groupBy("key", "more").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("at").alias("at")).where("n = 1").groupBy("row").agg(F.collect_list(F.col("at").cast("long")).alias("single"))
    again = each.join(groups.where("n > 1").select("h", "c"), ["h", "c"]).groupBy("row").agg(F.collect_list("mark").alias("again"))
    told = marks.select("row", "sure").join(again, "row", "left").join(stand.select("row", F.filter("marks", lambda m: m.bitwiseAND(3) == CROWD).alias("crowd")), "row", "left").join(proven, "row", "left").join(single, "row", "left")
    told = common.written(told, "told")
    common.remove(marks, groups, crowds, stand, contexts)

    def remove(batches):
        for batch in batches:
            out = []
            for sure, again_, crowd, spans, alone in zip(*(_lists(batch.column(n)) for n in ("sure", "again", "crowd", "proven", "single")), strict=True):
                start, stop = [spans >> 31], [spans & (1 << 31) - 1]
                for marked in (sure, again_):
                    _, low, high, _ = unpack_marks(marked)
                    start.append(low)
                    stop.append(high + length)
                if crowd.size:
                    _, low, high, _ = unpack_marks(crowd)
                    at = np.setdiff1d(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high, strict=True)]), alone)
                    start.append(at)
                    stop.append(at + length)
                out.append(_runs(np.concatenate(start), np.concatenate(stop)))
            more = [batch.column("kept")] if keep else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("raw"), pa.array(out, pa.list_(pa.int32())), *more], ["doc_id", "raw", "removed", "kept"][: 3 + len(more)])

    return rows.join(told, "row", "left").select("id", "raw", "sure", "again", "crowd", "proven", "single", *(["kept"] if keep else [])).mapInArrow(remove, "doc_id long, raw binary, removed array<int>" + kept_type)


def kept_bytes(raw: bytes, removed: list[int]) -> bytes:
    edges = [0, *removed, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(raw: bytes, removed: list[int]) -> list[int]:
    """The removed stretches drawn in to whole UTF-8 characters, so that what is left is text."""
    out: list[int] = []
    for a, b in zip(removed[::2], removed[1::2], strict=True):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out += [a, b]
    return out


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with texts without their repeated stretches, in whole characters; n_chars, where there is one, counts what is left. No row goes."""
    others = tuple(c for c in docs.columns if c != text_col)
    found = byte_repeats(docs, id_col=id_col, text_col=text_col, keep=others)

    def run(batches):
        for batch in batches:
            texts = [kept_bytes(raw, whole_characters(raw, removed)).decode() for raw, removed in zip(batch.column("raw").to_pylist(), batch.column("removed").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("kept")], ["text", "kept"])

    kept = found.schema["kept"].dataType.simpleString()
    left = found.mapInArrow(run, f"text string, kept {kept}")
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("text").alias(c))
        elif c == "n_chars":
            columns.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("kept")[c].alias(c))
    return left.select(*columns)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 200-byte strings."""
    found = byte_repeats(common.table(spark, sf_dir, "documents"))

    def make():
        def step(rows):
            out: dict[str, list] = {"doc_id": rows["doc_id"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for raw, removed in zip(rows["raw"], rows["removed"], strict=True):
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(sum(removed[1::2]) - sum(removed[::2]))
                out["n_spans"].append(len(removed) // 2)
                out["kept_sha256"].append(hashlib.sha256(kept_bytes(raw, removed)).hexdigest())
            return out

        return step

    return common.map_rows(found, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
