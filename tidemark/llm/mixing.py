"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Targets: the sources, by code point with null last, weigh 5, 2, 1 and so on, and share the words of all documents; no
target exceeds `REPEATS` times its source, and the excess is shared again by weight until none does. With the sources
ordered by (limit / weight) the limited ones are a prefix, so the level of the others follows from running sums.

Schedule: slot k of the mix maps the golden-ratio point frac(k * phi) through the cumulative weights to a source. The
weight of a source is the number of slots its target fills, and a little more: a run of points misses the fair share of a
range by no more than a logarithm of its length, so every source gets the slots it needs; those past its target are
dropped. The slots of a source are ranked: counts per chunk of `CHUNK` slots are summed up over the chunks, and within a chunk the
slots of a source are numbered, so no task ever sorts all slots of a source.

Blocks: the documents of a source are laid end to end in the order of a hash and cut into blocks of `BLOCK_WORDS` words
(the last may be shorter). The slot of rank r takes block r mod n, and the slot that reaches the target takes only the
words still missing. The join of slots and blocks is by (source, block), which spreads any source, however large. The
place of a document in its source comes from sums per (source, hash prefix), again without a task that sees it whole.

Every source so gives its target, rounded, and no document more than `REPEATS` times its size.

Cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own; a null id is hashed as
empty; repeated rows are separate documents; an empty table gives an empty result. Only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stored, whole_text

WEIGHTS, REPEATS, BLOCK_WORDS, CHUNK = (5, 2, 1), 3, 128, 4096

#: Hex digits of the hash that make a bucket: 4,096 buckets per source.
BUCKET_DIGITS = 3

#: frac(phi) scaled to 2^31: the points k * GOLDEN mod 2^31 are spread evenly in every prefix of the schedule.
GOLDEN, UNIT_BITS = 1327217885, 31


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          **carried: Column) -> DataFrame:
    """id, source, size in words and the shuffle key of every document."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
        *[c.alias(n) for n, c in carried.items()])


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target and its cumulative range [low, high) in units of 2^-31. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    rows = sizes.groupBy("source").agg(F.sum("source_size").alias("source_size")).withColumn(
        "place", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(weights, F.pmod("place", F.lit(len(WEIGHTS)))).cast("bigint")).withColumn(
        "limit", F.col("source_size") * REPEATS)
    by_level = Window.orderBy((F.col("limit") / F.col("weight")).asc(), "place")
    before, everyone = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levelled = rows.withColumns({
        "used": F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "left": F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "total": F.sum("source_size").over(everyone)})
    # what a weight of one gets if all sources before this one are limited; the first source below its limit sets it
    share = (F.col("total") - F.col("used")) / F.col("left").cast("double")
    free = F.when(F.col("share") * F.col("weight") < F.col("limit"), F.col("order"))
    level = F.max(F.when(F.col("order") == F.col("first_free"), F.col("share"))).over(everyone)
    final = levelled.withColumns({"share": share, "order": F.row_number().over(by_level)}).withColumn(
        "first_free", F.min(free).over(everyone)).withColumn("level", level).withColumn("target", F.when(
            F.col("order") >= F.col("first_free"), F.col("level") * F.col("weight")).otherwise(
            F.col("limit").cast("double")))
    quota, size = F.col("quota"), F.col("source_size")
    slots = F.when(quota > 0, F.expr("quota div source_size") * F.ceil(size / BLOCK_WORDS)
                   + F.ceil(quota % size / BLOCK_WORDS)).otherwise(0).cast("bigint")
    spare = F.floor(1.5 * F.log2(F.sum("slots").over(everyone) + 2)) + 4
    upto = by_name.rowsBetween(Window.unboundedPreceding, 0)
    edge = F.sum("draws").over(upto) / F.greatest(F.sum("draws").over(everyone), F.lit(1)) * (1 << UNIT_BITS)
    return final.withColumn("quota", F.round("target").cast("bigint")).withColumn("slots", slots).withColumn(
        "draws", F.when(F.col("slots") > 0, F.col("slots") + spare).otherwise(0)).withColumn(
        "high", F.round(edge).cast("bigint")).withColumn(
        "low", F.coalesce(F.lag("high").over(by_name), F.lit(0).cast("bigint"))).select(
        "source", "place", "source_size", "target", "quota", "draws", "low", "high")


def ranked_slots(targets: DataFrame) -> DataFrame:
    """place (of the source) and rank of every slot of the schedule, a few more per source than its quota needs."""
    drawn = targets.agg(F.sum("draws")).first()[0] or 0
    slots = targets.sparkSession.range(drawn).select(
        "id", F.expr(f"((id & {(1 << UNIT_BITS) - 1}L) * {GOLDEN}L) & {(1 << UNIT_BITS) - 1}L").alias("point"))
    edges = targets.filter("high > low").agg(F.sort_array(F.collect_list(F.struct("high", "place")))).first()[0]
    # the sources are few, so their edges become one expression; each point falls below the first edge that exceeds it
    place = F.lit(None).cast("int")
    for edge in reversed(edges):
        place = F.when(F.col("point") < edge.high, edge.place).otherwise(place)
    placed = slots.select((F.col("id") / CHUNK).cast("bigint").alias("chunk"), "id", place.alias("place")).filter(
        "place IS NOT NULL")
    counts = placed.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("place", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("place", "chunk").orderBy("id")
    return placed.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["place", "chunk"]).select(
        "place", (F.col("start") + F.col("nth")).alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **carried: Column) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words, repeats counted), source."""
    rows = stored(sized(docs, id_col, text_col, source_col, **carried).withColumns({
        "bucket": F.substring("key", 1, BUCKET_DIGITS), "row": F.monotonically_increasing_id()}), "mix-sizes")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sums), "mix-targets")
    same_source = F.col("s.source").eqNullSafe(F.col("t.source"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.withColumn("ahead", F.coalesce(F.sum("source_size").over(ahead), F.lit(0))).drop(
        "source_size").alias("s").join(targets.alias("t"), same_source).select(
        F.col("s.source").alias("of"), F.col("bucket").alias("in"), "ahead", "place", "source_size", "target", "quota")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(
        Window.unboundedPreceding, -1)
    laid = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        buckets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in"))).withColumn(
        "start", F.col("ahead") + F.col("within"))

    block = lambda at: (at / BLOCK_WORDS).cast("bigint")
    pieces = laid.filter("size > 0").select(
        "row", "place", "start", "size", F.explode(F.sequence(block(F.col("start")), block(
            F.col("start") + F.col("size") - 1))).alias("block"))
    slots = ranked_slots(targets).join(targets.select("place", "source_size", "quota"), "place")
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    turn = (F.col("rank") / blocks).cast("bigint")
    taken_slots = slots.withColumns({"block": F.pmod("rank", blocks), "turn": turn}).withColumn(
        # words of the source that earlier slots take; the slot that reaches the quota takes what is missing
        "before", F.col("turn") * F.col("source_size") + F.col("block") * BLOCK_WORDS).filter(
        F.col("before") < F.col("quota")).withColumn(
        "words", F.least(F.lit(BLOCK_WORDS).cast("bigint"), F.col("quota") - F.col("before"),
                         F.col("source_size") - F.col("block") * BLOCK_WORDS))
    uses = taken_slots.groupBy("place", "block", "words").agg(F.count("*").alias("uses"))
    first = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    last = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK_WORDS + F.col("words"))
    took = pieces.join(uses, ["place", "block"]).groupBy("row").agg(
        F.sum(F.greatest(last - first, F.lit(0)) * F.col("uses")).alias("taken"))
    return laid.join(took, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"),
        "source", *carried)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with all their columns: each repeated as often as the mix takes it, to the nearest.

    Rows that repeat an id are taken alike, each by the share of all of them. Columns named `_mix_...` are reserved.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    taken = mix(docs, id_col, text_col, source_col).groupBy(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_mix_key")).agg(
        F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("_mix_n"))
    return docs.withColumn("_mix_key", key).join(taken.filter("_mix_n > 0"), "_mix_key").withColumn(
        "_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(*docs.columns)
