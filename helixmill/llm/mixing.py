"""Operator 3, mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; for each source the bucket in which its budget ends is found, and only
that bucket is refined, twelve bits a round, until it holds one hash. A document is then taken by comparing its own
hash with its source's threshold, so nothing is sorted and thresholds nest: a larger budget takes a superset.

Sources stand in code point order, null last, and weigh ``weights`` in turn. Targets share all words by weight; a
target over ``most`` times its source's size stops there and the rest is reshared by weight until none is above.
Orders and running sums over sources go by ranges, so that very many sources need no single task either.
A source takes each document floor(target / size) times, and once more those below the threshold; the document at
the threshold is taken if that brings the sum nearer.

Texts are taken whole. Defined results: a null text has size 0; null sources are one source of their own; rows with one
doc_id share its hash and are taken together; a source without words has target 0; an empty table gives an empty
result; columns of other names, whatever they are, are carried by ``mix`` and ignored by ``taken``. The hash depends on
the doc_id alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import WORD_PATTERN, Scratch, free_prefix, written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Bits of the hash, and bits that a round settles.
BITS, ROUND_BITS = 48, 12
#: The plan has a row for each source; up to so many rows it is broadcast, beyond it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def source_key(source: Column) -> Column:
    """A join key that null sources have too."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def id_hash(doc_id: Column) -> Column:
    """48 bits of md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix-"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, BITS // 4), 16, 10).cast("bigint")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, size (words of the text), h (hash of the doc_id)."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD_PATTERN)).cast("bigint")
    counted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    return counted.select("doc_id", "source", source_key(F.col("source")).alias("key"), "size", id_hash(F.col("doc_id")).alias("h"))


def summed_before(df: DataFrame, order: list, sums: dict[str, str], scratch: Scratch) -> DataFrame:
    """Adds sums over the rows that come earlier in the order: {new column: column}, 0 for the first row.

    Rows are dealt into ranges of the order and written; each range sums its own rows and is moved by the totals of those
    before it, a row for each range.
    """
    ranged = scratch.write(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside, ranges = earlier.partitionBy("range").orderBy(*order), earlier.orderBy("range")
    totals = ranged.groupBy("range").agg(*(F.sum(c).alias(f"{out}_all") for out, c in sums.items()))
    totals = totals.select("range", *(F.coalesce(F.sum(f"{out}_all").over(ranges), F.lit(0)).alias(f"{out}_base") for out in sums))
    own = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(out) for out, c in sums.items()))
    moved = own.join(F.broadcast(totals), "range")  # a row for each range, at most as many as shuffle partitions
    return moved.select(*df.columns, *((F.col(out) + F.col(f"{out}_base")).alias(out) for out in sums))


def targets(sized: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source: key, source_size, target, whole (full passes), budget (words beyond them)."""
    total = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    total = total.select("key", F.col("source").isNull().alias("none"), "source", "source_size", F.lit(1).cast("bigint").alias("one"))
    placed = summed_before(total, ["none", "source"], {"place": "one"}, scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("bigint")
    placed = placed.select("key", "source_size", "place", weight.alias("weight"), (F.col("source_size") / weight).alias("by"))
    # In order of size by weight, those that stop at their cap are the first ones.
    summed = scratch.write(summed_before(placed, ["by", "place"], {"words_before": "source_size", "weight_before": "weight"}, scratch))
    all_of = summed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    rate = (F.lit(all_of["words"]) - most * F.col("words_before")).cast("double") / (F.lit(all_of["weight"]) - F.col("weight_before")).cast("double")
    capped = rate * F.col("weight") > most * F.col("source_size")
    first_free = summed.select(rate.alias("rate"), capped.alias("capped"), "by", "place").where("NOT capped").agg(F.min(F.struct("by", "place", "rate")).alias("free")).first()["free"]
    cap = F.lit(float(most)) * F.col("source_size")
    found = summed.withColumn("target", F.least(F.lit(first_free["rate"]) * F.col("weight"), cap) if first_free else cap)
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("bigint")
    return found.select("key", "source_size", "target", passes.alias("whole"), (F.col("target") - passes * F.col("source_size")).alias("budget"))


def thresholds(sized: DataFrame, target: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds shift, bucket and edge: a document is below if h >> shift < bucket, or = bucket and edge."""
    bound = target.select("key", "budget", F.lit(0).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("before"))
    settled, shift = None, BITS
    while shift > 0:
        upper, shift = shift, shift - ROUND_BITS
        inside = sized.select("key", "size", F.shiftright("h", shift).alias("fine"), F.shiftright("h", upper).alias("bucket"))
        summed = inside.join(bound, ["key", "bucket"]).groupBy("key", "fine").agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("budget").alias("budget"), F.first("before").alias("base"))
        order = Window.partitionBy("key").orderBy("fine")
        found = summed.withColumn("upto", F.col("base") + F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
        found = scratch.write(found.where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("upto"))).select("key", "budget", F.col("fine").alias("bucket"), "before", "upto", "rows"))
        done = found if shift == 0 else found.where("rows = 1")
        edge = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("before"))
        done = done.select("key", F.lit(shift).alias("shift"), "bucket", edge.alias("edge"))
        settled = done if settled is None else settled.unionByName(done)
        bound = found.where("rows > 1").select("key", "budget", "bucket", "before")
        if bound.isEmpty():
            break
    return target.join(settled, "key", "left")


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix as a row for each source; ``copies`` reads it."""
    scratch = Scratch(sized.sparkSession)
    plan = written(thresholds(sized, scratch.write(targets(sized, scratch, weights, most)), scratch))
    scratch.drop()
    return plan


def copies(keyed: DataFrame, plan: DataFrame, own: str) -> DataFrame:
    """Adds how often the mix takes each row, and the columns of the plan; their names, and those of key and h, begin with ``own``."""
    plan = plan.select(*(F.col(c).alias(own + c) for c in plan.columns))
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    bucket, edge = F.col(f"{own}bucket"), F.col(f"{own}edge")
    at = F.expr(f"shiftright({own}h, {own}shift)")
    below = F.coalesce((at < bucket) | ((at == bucket) & edge), F.lit(False))
    return keyed.join(plan, f"{own}key").withColumn(f"{own}copies", F.col(f"{own}whole") + below.cast("bigint"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed table: rows of ``docs``, each as often as the mix takes it (0 to ``most`` times)."""
    scratch, own = Scratch(docs.sparkSession), free_prefix(docs.columns)
    plan = mixing_plan(scratch.write(sizes(docs)), weights, most)
    scratch.drop()
    keyed = docs.withColumns({f"{own}key": source_key(F.col("source").cast("string")), f"{own}h": id_hash(F.col("doc_id").cast("bigint"))})
    times = F.col(f"{own}copies")
    taken = copies(keyed, plan, own).where(times > 0).withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    sized = written(sizes(docs))
    keyed = sized.select("doc_id", "size", F.col("key").alias("_key"), F.col("h").alias("_h"))
    out = copies(keyed, mixing_plan(sized, weights, most), "_")
    return out.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"))
