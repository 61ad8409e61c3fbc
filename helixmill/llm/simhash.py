"""Operator 9, document fingerprints (SimHash) by DataFrame functions alone.

A term is a word with the word after it, lower-cased; it weighs its length, at most ``HEAVIEST``, each time it
occurs. Terms are exploded and their hash bits voted by one hash aggregate: a long holds the counters of two bits, so
64 bits take 32 sums, which whole-stage code keeps in registers of one row for each document. A bit is set if more
than half of the weight has it.

``near`` finds fingerprints within a Hamming radius by permuted block tables. Templated texts crowd into few buckets, so
a bucket of more than ``CROWDED`` is split by block tables over the bits that its key leaves free, again and again until
few bits are left. A pair is met in many tables and taken in the first that fits it, so pairs need no shuffle of their own.

Successors ("next" documents) come from ranges of ids: each range is ordered on its own, and the first document of
the range below is added to each as its last row, so no task orders the whole table. A range is a partition.

Texts are taken whole. Defined results: a text without words has fingerprint 0; equal texts have equal fingerprints; a
null text is empty; rows with one doc_id are ordered by text; a null doc_id comes last, after the least number; an only
document is its own successor; an empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import quantiles, written

BITS = 64
HEAVIEST = 16
BLANKS = " \t\n\x0b\f\r"
#: Bits within which another fingerprint is counted as near, and blocks of the tables that find it.
RADIUS, BLOCKS = 3, 6
#: Fingerprints of a bucket above which it is split by a further level of blocks, and such buckets that are broadcast.
CROWDED, BROADCAST = 256, 250_000
LANES = 0x0000000100000001


def vote(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and ``fingerprint`` (bigint) of the rows' texts; rows are told apart by ``keys``."""
    words = F.split(F.btrim(F.lower(F.col(text_col)), F.lit(BLANKS)), "[ \t\n\x0b\f\r]+")
    listed = rows.select(*keys, words.alias("__w"))
    pairs = listed.select(*keys, F.explode(F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", F.lit(2), F.size("__w")).alias("b"))).alias("__t"))
    hashed = pairs.select(*keys, F.xxhash64("__t.a", "__t.b").alias("__h"), F.least(F.length("__t.a") + F.coalesce(F.length("__t.b"), F.lit(0)), F.lit(HEAVIEST)).cast("bigint").alias("__m"))
    half = BITS // 2
    sums = [F.sum(F.shiftright("__h", i).bitwiseAND(F.lit(LANES)) * F.col("__m")).alias(f"__s{i}") for i in range(half)]
    voted = hashed.groupBy(*keys).agg(F.sum("__m").alias("__all"), *sums)
    bits = []
    for i in range(half):
        low, high = F.col(f"__s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"__s{i}", 32)
        bits += [F.when(2 * low > F.col("__all"), F.lit(1 << i)).otherwise(0), F.when(2 * high > F.col("__all"), F.lit((1 << (i + half)) - (1 << 64 if i + half == 63 else 0))).otherwise(0)]
    fingerprint = bits[0].cast("bigint")
    for bit in bits[1:]:
        fingerprint = fingerprint.bitwiseOR(bit.cast("bigint"))
    return voted.select(*keys, fingerprint.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two texts' term vectors from the bits that differ, 0 if negative."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * F.lit(math.pi / BITS)))


def in_hex(fingerprint: Column) -> Column:
    """16 hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def range_of(order: Column, cuts: list[int]) -> Column:
    """Number of cuts below ``order``, by a binary search in one literal array."""
    if not cuts:
        return F.lit(0)
    sorted_cuts = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(sorted_cuts, at + step - 1) < order, at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and of the next document in descending doc_id order: range, place, next_text, last.

    Rows with ``last`` are the added ones; they end each range and are left out of results. Ranges are as many as the
    input has partitions, up to a bound (``common.MOST_RANGES``); a number for each of them is collected and broadcast.
    """
    lowest = -(2**63)
    base = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("order", F.coalesce("doc_id", F.lit(lowest)))
    cuts = quantiles(base, "order", docs.rdd.getNumPartitions())
    base = base.withColumn("range", range_of(F.col("order"), cuts))
    rows = base.select("range", F.lit(False).alias("last"), "order", "doc_id", "text")
    # The first row of each range follows the last one of the range above it; that of the highest follows the lowest's.
    heads, above = base.groupBy("range").agg(F.max("order").alias("head")), Window.orderBy("range")
    to = F.coalesce(F.lead("range").over(above), F.first("range").over(above.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("head").alias("order"), to.alias("to"))
    added = base.join(F.broadcast(heads), "order").select(F.col("to").alias("range"), F.lit(True).alias("last"), "order", "doc_id", "text")
    dealt = rows.unionByName(added).repartitionById(len(cuts) + 1, F.col("range"))
    order = Window.partitionBy("range").orderBy("last", F.desc("order"), F.col("doc_id").isNull(), F.desc("text"))
    return dealt.select("range", "last", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (bigint), a row for each doc_id; texts of rows that share one are voted together."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return vote(rows, ["doc_id"], "text")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next text, their likeness, and how many are near.

    One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    n_near, the number of distinct fingerprints of all documents within ``RADIUS`` bits of its own, itself included.
    """
    rows = with_next(docs)
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.left("text", n - k), F.left("next_text", k))
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.when(~F.col("last"), edited))
    rows = rows.withColumn("edited_sha256", F.when(~F.col("last"), F.sha2("edited", 256)))
    both = rows.select("range", "place", "last", "doc_id", "n_chars", "edited_sha256", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t"))), lambda x: x["t"].isNotNull())).alias("x"))
    both = both.select("range", "place", "last", "doc_id", "n_chars", "edited_sha256", F.col("x.v").alias("v"), F.col("x.t").alias("t"))
    voted = vote(both, ["range", "place", "v", "last", "doc_id", "n_chars", "edited_sha256"], "t")
    voted = voted.repartitionById(max(1, docs.rdd.getNumPartitions()), F.col("range"))
    order = Window.partitionBy("range").orderBy("place", "v")
    # Each document has two rows, its own (v = 0) and its edited one; the row after these is the next document's own.
    lined = voted.select("*", F.lead("fingerprint").over(order).alias("edited"), F.lead("fingerprint", 2).over(order).alias("next"))
    own = written(lined.where("v = 0 AND NOT last").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited", "next"))
    counted = own.join(count_near(own), "fingerprint")
    return counted.select("doc_id", "n_chars", "edited_sha256", in_hex(F.col("fingerprint")).alias("fingerprint"), in_hex(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"), "n_near")


def signed(bits: int) -> int:
    """64 bits as a long."""
    return bits - (1 << 64) if bits >> 63 else bits


class Level:
    """Block tables over ``width`` bits: one for each choice of ``blocks - radius`` blocks, keyed by these.

    Two values within the radius agree in so many blocks at least, so each such pair shares a key in some table.
    """

    def __init__(self, width: int, radius: int, blocks: int) -> None:
        ends = [width * i // blocks for i in range(blocks + 1)]
        self.spans = [(ends[b], ends[b + 1] - ends[b]) for b in range(blocks)]
        self.choices = list(itertools.combinations(range(blocks), blocks - radius))
        self.masks = [signed(sum(((1 << self.spans[b][1]) - 1) << self.spans[b][0] for b in chosen)) for chosen in self.choices]
        #: Bits that a key leaves free.
        self.free = sum(sorted(size for _, size in self.spans)[blocks - radius :])

    def others(self, value: Column, chosen: tuple[int, ...]) -> Column:
        """The bits of the blocks that aren't chosen, moved together."""
        out, at = F.lit(0).cast("bigint"), 0
        for block, (start, size) in enumerate(self.spans):
            if block not in chosen:
                out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << size) - 1)), at))
                at += size
        return out

    def rows(self, value: Column) -> Column:
        """An array with table, key and the free bits of each table."""
        return F.array(*(F.struct(F.lit(t).alias("table"), value.bitwiseAND(F.lit(mask)).alias("key"), self.others(value, chosen).alias("free")) for t, (mask, chosen) in enumerate(zip(self.masks, self.choices, strict=True))))

    def first(self, differing: Column) -> Column:
        """The first table in which two values meet that differ in these bits."""
        return F.coalesce(*(F.when(differing.bitwiseAND(F.lit(mask)) == 0, F.lit(t)) for t, mask in enumerate(self.masks)))


def candidates(fingerprint_rows: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs that meet in a bucket: query, fingerprint, and whether this is the first bucket in which they do.

    The levels are the same for both tables, since buckets of ``fingerprint_rows`` decide. A bucket of the last level has
    few free bits, so that few fingerprints fit in it.
    """
    if not radius < blocks <= BITS:
        raise ValueError("blocks must exceed the radius")

    def start(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col("fingerprint").alias(name), F.col("fingerprint").alias(f"{name}0")).where(F.col(name).isNotNull()).distinct()

    sides = {name: start(rows, name) for name, rows in (("query", queries), ("fingerprint", fingerprint_rows))}
    width, path, first, found = BITS, [], F.lit(True), None
    for at in itertools.count():
        level = Level(width, radius, blocks)
        for name, rows in sides.items():
            dealt = rows.select("*", F.explode(level.rows(F.col(f"{name}{at}"))).alias("x"))
            sides[name] = dealt.select(*rows.columns, F.col("x.table").alias(f"table{at}"), F.col("x.key").alias(f"key{at}"), F.col("x.free").alias(f"{name}{at + 1}"))
        path = [*path, f"table{at}", f"key{at}"]
        first = first & (F.col(f"table{at}") == level.first(F.col(f"query{at}").bitwiseXOR(F.col(f"fingerprint{at}"))))
        few, crowded = sides, None
        if blocks < level.free < width:
            sizes = sides["fingerprint"].groupBy(*path).agg(F.count("*").alias("n"))
            crowded = written(sizes.where(F.col("n") > CROWDED).select(*path))
            if n := crowded.count():
                hint = F.broadcast(crowded) if n <= BROADCAST else crowded
                few = {name: rows.join(hint, path, "left_anti") for name, rows in sides.items()}
                sides = {name: rows.join(hint, path, "left_semi") for name, rows in sides.items()}
            else:
                crowded = None
        pairs = few["query"].join(few["fingerprint"], path).select("query", "fingerprint", first.alias("first"))
        found = pairs if found is None else found.unionByName(pairs)
        if crowded is None:
            return found
        width = level.free


def near(fingerprint_rows: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct fingerprints of ``fingerprint_rows`` within ``radius`` bits of each distinct one of ``queries``.

    Both have a column fingerprint (bigint); null ones are left out. Returns query, fingerprint, distance.
    """
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    met = candidates(fingerprint_rows, queries, radius, blocks).where((distance <= radius) & F.col("first"))
    return met.select("query", "fingerprint", distance.alias("distance"))


def count_near(rows: DataFrame) -> DataFrame:
    """For each distinct fingerprint of ``rows``: fingerprint and n_near, distinct ones within the radius, itself included."""
    return written(near(rows, rows).groupBy(F.col("query").alias("fingerprint")).agg(F.count("*").alias("n_near")))
