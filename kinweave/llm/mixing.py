"""Mixing sources to target weights, along a curriculum.

Each source has a weight schedule w(t) over training time t in [0, 1]; its integral W(t), scaled to its target, is the
demand for its words up to t. A document that covers the words from c on of its source is due when the demand reaches c,
so its position is the inverse of W at c over the target. Documents are then sorted by position over ranges.

Targets: sources, by code point with null last, weigh 1, 2, 3 in turn and share all words; none gets over `most` times
what it has, and the excess goes to the others by weight. With sources ordered by most * size / weight this is one pass of
running sums: a source is full if its share of what fuller ones leave would be above its limit.

Order within a source: md5 of the id, then the id. Running sums go by tops of that order, by blocks within a top, then
within a block, so that no task sees a whole source, nor all its blocks. Only sources, and a source's tops, meet in one task.

Null texts have size 0. Sources of size 0 have target 0 and nothing is taken. Null ids are allowed and sort first; equal
ids that repeat are laid one after the other, shorter texts first. Empty tables give empty results. Of extra columns those in
`keep` stay, under names that clash with none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: No document is taken more often.
MOST = 3.0
#: Hex digits of md5 that name a block: 16 ** 4 blocks a source. Results do not depend on it; 33 TB of one source make blocks of half a GB.
BLOCK_DIGITS = 4
#: Digits of a block's name that name its top: a source has 16 ** 2 tops, a top has as many blocks.
TOP_DIGITS = 2
#: Weight at the beginning and the end of training, by rank modulo 3: even, falling, rising. Integrals over [0, 1] are 1.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))


def size_of(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(per: DataFrame, most: float = MOST) -> DataFrame:
    """From key, source, source_size (a row a source): these, rank (from 0), weight and target (double)."""
    whole, by_name = Window.partitionBy(F.lit(1)), Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", (F.col("rank") % 3 + 1).cast("double"))
    fullest = Window.orderBy((F.col("source_size") * most / F.col("weight")).asc(), F.col("rank").asc())
    earlier, later = fullest.rowsBetween(Window.unboundedPreceding, -1), fullest.rowsBetween(0, Window.unboundedFollowing)
    per = per.select(
        "*",
        (F.col("source_size") * most).alias("most"),
        (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))).alias("left"),
        F.sum("weight").over(later).alias("weights"),
    ).withColumn("full", F.col("most") * F.col("weights") <= F.col("weight") * F.col("left"))
    # All sources before the first that is not full are full; that one and the rest share what is left.
    rest = F.max(F.when(~F.col("full"), F.struct("weights", "left"))).over(whole)
    share = F.col("weight") * F.col("rest.left") / F.col("rest.weights")
    per = per.withColumn("rest", rest)
    return per.select("key", "source", "source_size", "rank", "weight", F.when(F.col("full"), F.col("most")).otherwise(share).alias("target"))


def due(u: Column, rank: Column) -> Column:
    """Training time at which a source of this rank has been given the share u of its target: the inverse of the integral."""
    out = u
    for r, (a, b) in enumerate(SCHEDULES):
        if a != b:
            # The root of a*t + (b - a)/2 * t*t = u in the form that subtracts no near equals and gives plain zero at 0.
            out = F.when(rank % len(SCHEDULES) == r, 2 * u / (F.lit(a) + F.sqrt(F.greatest(a * a + 2 * (b - a) * u, F.lit(0.0))))).otherwise(out)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = MOST, cut: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, source, size, source_size, target, taken, copies, position, and the columns in keep; sorted by position.

    taken: words that the mix takes of the document, repeats counted. cut: the document at which a source's target is met gives
    only the words still wanted; otherwise it is taken whole if that comes nearer. copies: passes that take words of it.
    position: training time of the first pass, null if nothing is taken.
    """
    kept = [F.col(c).alias(f"kept_{c}") for c in keep]
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("key"),
        size_of(F.col(text_col).cast("string")).alias("size"),
        order.alias("turn"),
        F.substring(order, 1, BLOCK_DIGITS).alias("block"),
        *kept,
    ).repartition("key", "block")
    blocks = sized.groupBy("key", "source", "block").agg(F.sum("size").alias("in_block"))
    of = targets(blocks.groupBy("key", "source").agg(F.sum("in_block").alias("source_size")), most)
    # What is ahead of a block: the tops before its own, and the blocks before it in its top.
    blocks = blocks.select("key", "block", "in_block", F.substring("block", 1, TOP_DIGITS).alias("top"))
    first, then = (Window.partitionBy(*by).orderBy(of_).rowsBetween(Window.unboundedPreceding, -1) for by, of_ in ((("key",), "top"), (("key", "top"), "block")))
    tops = blocks.groupBy("key", "top").agg(F.sum("in_block").alias("in_top")).select("key", "top", F.coalesce(F.sum("in_top").over(first), F.lit(0)).alias("tops_ahead"))
    blocks = blocks.withColumn("blocks_ahead", F.coalesce(F.sum("in_block").over(then), F.lit(0))).join(tops, ["key", "top"])
    blocks = blocks.select("key", "block", (F.col("tops_ahead") + F.col("blocks_ahead")).alias("ahead"))
    blocks = blocks.join(of.select("key", "source_size", "rank", "target"), "key")
    before = Window.partitionBy("key", "block").orderBy("turn", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).join(blocks, ["key", "block"])
    at, wanted = F.col("ahead") + F.col("before"), F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(wanted / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    placed = placed.select("*", at.alias("at"), passes.alias("passes"), (wanted - passes * F.col("source_size") - at).alias("more"))
    if cut:
        extra = F.greatest(F.lit(0).cast("long"), F.least("more", "size"))
    else:
        extra = F.when((F.col("more") * 2 >= F.col("size")) & (F.col("more") > 0), F.col("size")).otherwise(0).cast("long")
    placed = placed.withColumn("taken", F.col("passes") * F.col("size") + extra)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    first = F.when(F.col("taken") > 0, due(F.col("at") / F.col("target"), F.col("rank")))
    out = placed.select(F.col("id").alias(id_col), F.col("source"), "size", "source_size", "target", "taken", copies.alias("copies"), first.alias("position"), "at", "rank", *[f"kept_{c}" for c in keep])
    return out


def op10_mix_curriculum(spark, sf_dir: str) -> DataFrame:
    """All documents with their share of the mix, in training order."""
    mixed = mix(common.table(spark, sf_dir, "documents"))
    ordered = mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole, by position. Columns as in docs (id, text and source among them)."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    mixed = mix(docs, cut=False, keep=others)
    each = mixed.where(F.col("copies") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = (F.col("at") + F.col("pass") * F.col("source_size")) / F.col("target")
    each = each.withColumn("position", due(F.least(share, F.lit(1.0)), F.col("rank")))
    columns = [F.col(c) if c in ("doc_id", "source") else F.col(f"kept_{c}").alias(c) for c in docs.columns]
    return each.orderBy("position", "doc_id").select(*columns)


SCHEDULE_SQL = """case rank % 3 when 1 then 2 * u / (1.5::double + sqrt(greatest(1.5::double * 1.5 + 2 * (0.5::double - 1.5) * u, 0.0::double)))
  when 2 then 2 * u / (0.5::double + sqrt(greatest(0.5::double * 0.5 + 2 * (1.5::double - 0.5) * u, 0.0::double))) else u end"""

OP10_SQL = rf"""
with sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as turn,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
per as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as rank from sized group by source),
weighed as (select *, cast(rank % 3 + 1 as double) as weight from per),
lined as (
  select *, source_size * 3.0::double as most, sum(source_size) over () - 3.0::double * coalesce(sum(source_size) over (order by source_size * 3.0::double / weight, rank rows between unbounded preceding and 1 preceding), 0) as left_over,
    sum(weight) over (order by source_size * 3.0::double / weight, rank rows between current row and unbounded following) as weights from weighed),
judged as (select *, most * weights <= weight * left_over as is_full from lined),
rest as (select max(weights) as weights, arg_max(left_over, weights) as left_over from judged where not is_full),
aims as (select j.source, j.source_size, j.rank, case when is_full then most else weight * r.left_over / r.weights end as target from judged j left join rest r on true),
placed as (
  select s.*, a.source_size, a.rank, a.target, cast(round(a.target) as bigint) as wanted,
    cast(coalesce(sum(size) over (partition by s.source order by turn, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as bigint) as ahead
  from sized s join aims a on s.source is not distinct from a.source),
passed as (select *, case when source_size > 0 then wanted // source_size else 0 end as passes from placed),
given as (select *, passes * size + greatest(0, least(wanted - passes * source_size - ahead, size)) as taken, ahead / target as u from passed)
select doc_id, size, source_size, target, cast(taken as bigint) as taken, round(case when taken > 0 then {SCHEDULE_SQL} end, 6) as position from given
"""
