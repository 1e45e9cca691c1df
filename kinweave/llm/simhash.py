"""SimHash near-duplicates: fingerprints linked through Gray-order hierarchical indexes.

Fingerprints that differ in at most `most` of 64 bits agree wholly in some blocks of bits, so all of them are dealt out by
the values of those blocks and every bucket is searched by itself: no link is lost. In a bucket fingerprints are sorted by
their rank in the reflected Gray order, in which neighbours differ little; runs of FAN become nodes, runs of nodes become
upper nodes, and each node keeps the bits on which all below it agree, less those that a node above it already has. A
search goes down from the top with the differences so far and drops a node, with all below it, as soon as they exceed
`most`. Buckets send a spanning star of each group, not its pairs. Components of the stars are the classes.

With more fingerprints more blocks must agree, so that buckets stay small: 1 of 5 blocks, then 2 of 6, then 3 of 7. A
bucket of over HOT rows is split into parts that are searched against one another in pairs of parts, nothing dropped.

Null and word-less texts have fingerprint 0 and link like any other. Equal fingerprints are aggregated first. Rows with a
null id keep their fingerprint and get the component of their class, null if no row of it has an id. Repeated rows repeat;
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.graph import connected_components
from kinweave.sources.catalog import dimension

from . import common

SEED = 42
SHINGLE = 4
MOST = 4
FAN = 8
HOT = 4096
#: Rows of a frontier that is worked on at once.
WIDE = 1 << 18
#: Rows of a class beyond which they are met by a broadcast row of their class.
HOT_CLASS = 100_000
#: Mean rows of a bucket at which more blocks are made to agree.
CROWDED = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    ends = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "fp": [f - (1 << 64) if (f := fingerprint(t, shingle)) >> 63 else f for t in rows["raw"]]}

    return common.map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_bytes(text_col).alias("raw")), make, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchical index over fingerprints. levels[0] has the fingerprints themselves, in Gray order, the last the top nodes."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        bits, mask = fps[self.order], np.full(fps.size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.levels = [[bits, mask]]
        while bits.size > FAN:
            at = np.arange(0, bits.size, FAN)
            agree = np.bitwise_and.reduceat(mask, at) & ~(np.bitwise_or.reduceat(bits, at) ^ np.bitwise_and.reduceat(bits, at))
            upper = bits[at] & agree
            # What the node above has is factored out below.
            low = self.levels[-1]
            low[1] = mask & ~np.repeat(agree, FAN)[: bits.size]
            low[0] = bits & low[1]
            bits, mask = upper, agree
            self.levels.append([bits, mask])

    def search(self, queries: np.ndarray, most: int):
        """Yields (query, place in the given fingerprints) of all pairs within `most` bits, in parts."""
        top = self.levels[-1][0].size
        step = max(1, WIDE // max(top, 1))
        for begin in range(0, queries.size, step):
            q = np.arange(begin, min(begin + step, queries.size))
            yield from self._down(queries, np.repeat(q, top), np.tile(np.arange(top), q.size), np.zeros(q.size * top, np.int64), len(self.levels) - 1, most)

    def _down(self, queries, q, node, far, level, most):
        bits, mask = self.levels[level]
        far = far + np.bitwise_count((queries[q] ^ bits[node]) & mask[node])
        near = far <= most
        q, node, far = q[near], node[near], far[near]
        if not level:
            yield q, self.order[node]
            return
        size = self.levels[level - 1][0].size
        for i in range(0, q.size, WIDE // FAN):
            below = node[i : i + WIDE // FAN, None] * FAN + np.arange(FAN)
            real = below < size
            wide = lambda x: np.broadcast_to(x[i : i + WIDE // FAN, None], below.shape)[real]  # noqa: B023, E731
            yield from self._down(queries, wide(q), below[real], wide(far), level - 1, most)


def stars(ids: np.ndarray, fps: np.ndarray, left: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, first of its group) of the groups that links join, of links between a row of `left` and any row."""
    parent = np.arange(fps.size)
    index = GrayIndex(fps)
    asked = np.flatnonzero(left)
    for q, p in index.search(fps[asked], most):
        q = asked[q]
        other = q != p
        q, p = q[other], p[other]
        while q.size:
            a, b = parent[q], parent[p]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            q, p, low, high = q[apart], p[apart], low[apart], high[apart]
            np.minimum.at(parent, high, low)
            while (up := parent[parent] < parent).any():
                parent[up] = parent[parent[up]]
    member = np.flatnonzero(parent != np.arange(fps.size))
    return ids[member], ids[parent[member]]


def masks(n: int, most: int) -> list[int]:
    """For n fingerprints: masks of which two fingerprints within `most` bits agree on at least one."""
    for agree in (1, 2, 3):
        blocks = most + agree
        cuts = np.linspace(0, 64, blocks + 1).round().astype(int)
        if n / 2.0 ** (64 // blocks * agree) <= CROWDED:
            break
    whole = [sum(1 << b for b in range(cuts[k], cuts[k + 1])) for k in range(blocks)]
    return [sum(whole[k] for k in c) for c in combinations(range(blocks), agree)]


def links(classes: DataFrame, most: int = MOST) -> DataFrame:
    """src, dst: spanning edges of the groups within each bucket, over rows of id and fp (no null, each fp once)."""
    chosen = [m - (1 << 64) if m >> 63 else m for m in masks(classes.count(), most)]
    keyed = classes.select("id", "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(chosen)])).alias("key"))
    keyed = keyed.select("id", "fp", F.xxhash64("key.k", "key.v").alias("bucket"))
    hot = keyed.groupBy("bucket").count().where(F.col("count") > HOT).select("bucket", F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
    if hot.isEmpty():
        keyed = keyed.select("id", "fp", "bucket", F.lit(True).alias("asks"))
    else:
        # A row of part p meets the pairs (p, any) as one that asks and (any, p) as one that is only found.
        keyed = keyed.join(hot, "bucket", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))))
        other = F.explode(F.when(F.col("part").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
        keyed = keyed.withColumn("other", other).withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
        keyed = keyed.select("id", "fp", F.when(F.col("part").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "low", "high")).alias("bucket"), (F.col("part").isNull() | (F.col("part") == F.col("low"))).alias("asks"))

    def run(batches):
        held: list[tuple] = []

        def close():
            if not held:
                return None
            ids, fps, asks = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            held.clear()
            if ids.size < 2:
                return None
            a, b = stars(ids, fps, asks, most)
            return (a, b) if a.size else None

        for batch in batches:
            bucket = batch.column(2).to_numpy()
            ids, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy().view(np.uint64)
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.diff(bucket)) + 1
            out = []
            for i, j in zip([0, *edge], [*edge, bucket.size], strict=True):
                if held and held[0][0] != bucket[i]:
                    out.append(close())
                held.append((bucket[i], ids[i:j], fps[i:j], asks[i:j]))
            out = [x for x in out if x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]), pa.int64()) for k in (0, 1)], ["src", "dst"])
        if last := close():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in last], ["src", "dst"])

    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long), component_id of every row."""
    rows = common.written(fingerprints(docs, shingle), "fingerprints")
    classes = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "classes")
    joined = connected_components(links(classes.where("id is not null").select("id", "fp"), most))
    # Only a class of several rows, or one that is linked, has a component that its row does not show.
    of = classes.join(joined.select("id", "component"), "id", "left").select("fp", F.coalesce("component", "id").alias("component"), "n", "id").where((F.col("n") > 1) | (F.col("component") != F.col("id")))
    of = common.written(of.select("fp", "component", "n"), "components")
    common.remove(classes)
    # Rows of hot classes, of which there can be no more than rows / HOT_CLASS, do not meet in one task.
    hot = dimension(of.where(F.col("n") > HOT_CLASS).select("fp", "component"))
    rest = rows.join(hot.select("fp"), "fp", "left_anti").join(of.where(F.col("n") <= HOT_CLASS).select("fp", "component"), "fp", "left")
    return rows.join(hot, "fp").unionByName(rest).select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """Of each component one row of docs, as it is: that with the smallest id, null last; of rows that share it the first by an order of their own."""
    rows, known = common.rows_told_apart(docs, "doc_id", kept=F.struct("*"))
    if known["by_id"]:
        keep = near_duplicates(docs, most).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
        return docs.join(keep, docs["doc_id"] == keep["kept_id"], "left_semi")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("kept.text").alias("text")), most)
    each = found.join(rows.select("row", "id"), F.col("doc_id") == F.col("row")).select("component_id", F.struct(F.col("id").isNull(), "id", "row").alias("turn"))
    keep = each.groupBy("component_id").agg(F.min("turn").alias("first")).select("first.row")
    return rows.join(keep, "row", "left_semi").select("kept.*")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
