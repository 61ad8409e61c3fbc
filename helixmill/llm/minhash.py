"""Operator 1, near-duplicates by MinHash.

A document's set of five-word shingles is sketched by fast similarity sketching and banded; documents that share a band
are candidates, and each candidate link is confirmed on the full sets. With 32 bands of 4 coordinates a pair at the
threshold (0.75) shares no band with probability 5e-6, and less above it.

Work stays in proportion where groups are large:

* Documents with equal sets are one class, and only its first document goes on.
* A bucket (documents that share a band) of at most ``HOT`` gives its pairs.
* Larger buckets are joined into groups. A group's most central member is its hub, and each member is confirmed against
  the hub alone. Those that link to it are one star and need no test among each other.
* What else can link is found by an exact prefix filter over the sets of the group, not by pairs of the group. Shingles
  are ordered by how many members have them, rarest first. Two sets that link share one of their first shingles, and the
  more alike their sizes, the fewer first ones that are; so sizes go by classes. Members of one template, which share
  its shingles and not their rare ones, meet nowhere. Where more than ``HOT`` members of several stars share a first
  shingle, each is confirmed against hubs of such shingles before, for at most ``HUB_ROUNDS`` rounds, and stars that
  link become one. Members of one star aren't paired, by triangle inequality of Jaccard distance neither are those of
  a star and one with similarity below 0.5 to its hub.

Links go through connected components. Defined results: a document without words, or with a null text, has an empty
set and is linked with nothing; one with fewer than five words has its whole sequence as one shingle; a row without doc_id
is linked with nothing, has a null component and is kept; an empty table gives an empty result; columns of other names
are ignored. Texts are taken whole. Rows that share a doc_id are one document to ``near_duplicates``: each of their texts
with words is a node, and these nodes belong together. ``deduplicated`` drops rows, not documents: a row stays if its set is its
group's first (by doc_id) and its doc_id the least that has this set, so each text that goes has a like one that stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import Scratch, as_bytes, by_id, free_prefix, mix64, steps, written
from helixmill.llm.components import connected_components
from helixmill.llm.mixing import summed_before
from helixmill.llm.shingles import band_keys, shingle_sets, similarity_sketch

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
HOT = 64
#: Rounds of hubs of shared shingles, and tests of a member in each; rounds end when one leaves more than 1 - 1 / SLOW of the stars.
HUB_ROUNDS, ASKS, SLOW = 6, 4, 25
#: Tokens that a task holds when it counts them.
TOKENS = 500_000
#: Leading bits of a size that tell its class.
CLASS_BITS = 5
#: A side of ids is broadcast up to so many rows (8 bytes each), beyond it is joined by shuffle.
BROADCAST_ROWS = 500_000


def sketches(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, sig_a, sig_b (128 bits of the set), bands (keys; null for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            hashes, counts = shingle_sets(as_bytes(batch.column("text")), size)
            ends = np.concatenate([[0], np.cumsum(counts)])
            keys = band_keys(similarity_sketch(hashes, counts, bands * rows), rows)
            sums = signatures(hashes, ends)
            offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[counts > 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(sums[0]), pa.array(sums[1]), listed], ["doc_id", "n_shingles", "sig_a", "sig_b", "bands"])

    return by_id(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, sig_a bigint, sig_b bigint, bands array<bigint>")


def only(rows: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Join of ``rows`` with ``ids`` (distinct by ``key``); broadcasts ids only when they are few."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def signatures(hashes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set, as two bigints; ``ends``: 0 and the ends of the sets."""
    sums = []
    with np.errstate(over="ignore"):
        for seed in (11, 12):
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes, seed), dtype=np.uint64)])
            sums.append((running[ends[1:]] - running[ends[:-1]]).view(np.int64))
    return sums


def shingle_table(docs: DataFrame, nodes: DataFrame, size: int = SHINGLE) -> DataFrame:
    """id and set (ascending uint64 hashes as binary) of ``nodes`` (doc_id, sig_a, sig_b, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            hashes, counts = shingle_sets(as_bytes(batch.column("text")), size)
            ends = np.concatenate([[0], np.cumsum(counts)])
            ids, sets = [], []
            for i, (own, a, b) in enumerate(zip(batch.column("own").to_pylist(), *signatures(hashes, ends), strict=True)):
                found = [x["id"] for x in own if x["sig_a"] == a and x["sig_b"] == b]
                ids += found
                sets += [hashes[ends[i] : ends[i + 1]].tobytes()] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])

    listed = nodes.groupBy("doc_id").agg(F.collect_list(F.struct("sig_a", "sig_b", "id")).alias("own"))
    return only(by_id(docs, "doc_id", "text"), listed, "inner").select("text", "own").mapInArrow(run, "id bigint, set binary")


def pair_counts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds both (size of the intersection) and either (of the union) to rows with a and b."""
    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    full = first.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                n = len(np.intersect1d(x, y, assume_unique=True))
                both.append(n)
                either.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"])

    return full.mapInArrow(run, "a bigint, b bigint, both bigint, either bigint")


def overlap(n: np.ndarray, other: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least intersection with which sets of these sizes link."""
    return -(-percent * (n + other) // (100 + percent))


def class_of(n: np.ndarray) -> np.ndarray:
    """The least size whose ``CLASS_BITS`` leading bits are those of ``n``."""
    shift = np.maximum(np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1 - CLASS_BITS, 0)
    return (n >> shift) << shift


def classes_above(n: int, percent: int = PERCENT) -> np.ndarray:
    """Classes of the sizes from ``n`` to the largest that can link with it."""
    return np.unique(class_of(np.arange(n, 100 * n // percent + 1)))


def token_owners(members: DataFrame, sets: DataFrame) -> DataFrame:
    """token and owners (how many of ``members`` (id) have it), counted inside tasks first, ``TOKENS`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            token, owners = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(owners)], ["token", "owners"])

        for batch in steps(batches, "set"):
            held += [np.frombuffer(x, "<i8") for x in batch.column("set").to_pylist()]
            if sum(map(len, held)) > TOKENS:
                yield counted()
        yield counted()

    counted = sets.join(members.select("id"), "id", "left_semi").select("set").mapInArrow(run, "token bigint, owners bigint")
    return counted.groupBy("token").agg(F.sum("owners").alias("owners"))


def tokens(members: DataFrame, sets: DataFrame) -> DataFrame:
    """id and token of the sets of ``members`` (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "set"):
            held = [np.frombuffer(x, "<i8") for x in batch.column("set").to_pylist()]
            owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), pa.array(np.concatenate([np.zeros(0, np.int64), *held]))], ["id", "token"])

    return sets.join(members.select("id"), "id", "left_semi").select("id", "set").mapInArrow(run, "id bigint, token bigint")


def first_tokens(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The rows of ``prefixes`` for sets (id, n, tokens that others have too, how many have them)."""
    out: list[tuple] = []
    for doc, n, token, owners in rows:
        token = token[np.lexsort((token, owners))]
        place = n - len(token) + np.arange(len(token))
        stands = (int(class_of(np.int64(n))), n - -(-PERCENT * n // 100), False)
        for of_class, last, probes in [stands, *((int(c), int(n - overlap(n, max(c, n))), True) for c in classes_above(n))]:
            upto = int(np.searchsorted(place, last, "right"))
            out.append((np.full(upto, doc), np.full(upto, n), token[:upto], place[:upto], np.full(upto, of_class), np.full(upto, probes)))
    types = (np.int64, np.int64, np.int64, np.int64, np.int64, np.bool_)
    columns = [pa.array(np.concatenate([np.zeros(0, t), *(x[i].astype(t) for x in out)])) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, ["id", "n", "token", "place", "class", "probes"])


def prefixes(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """First tokens of sets, in the order of how many members have them: id, n, token, place, class, probes.

    A set stands by its tokens for those at most as large as itself (``probes`` false) under its own class, and asks by
    the fewer that it must share with a set of a class at least as large (``probes`` true). Tokens of one member alone
    come first and are left out. The others go to each task if they are few, else they are joined by shuffle.
    """
    common = scratch.write(token_owners(members, sets).where("owners > 1"))
    schema = "id bigint, n bigint, token bigint, place bigint, class bigint, probes boolean"
    if common.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = common.toArrow().sort_by("token")
        all_tokens, all_owners = (known.column(c).to_numpy() for c in ("token", "owners"))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, "set"):
                rows = []
                for doc, n, held in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "set")), strict=True):
                    token = np.frombuffer(held, "<i8")
                    at = np.searchsorted(all_tokens, token)
                    at = at[all_tokens[np.minimum(at, len(all_tokens) - 1)] == token] if len(all_tokens) else at[:0]
                    rows.append((doc, n, all_tokens[at], all_owners[at]))
                yield first_tokens(rows)

        return scratch.write(sets.join(members.select("id", "n"), "id").select("id", "n", "set").mapInArrow(look_up, schema))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(x.values.field("token").to_numpy(), x.values.field("owners").to_numpy()) for x in batch.column("held")]
            yield first_tokens([(doc, n, *h) for doc, n, h in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), held, strict=True)])

    found = tokens(members, sets).join(common, "token").groupBy("id").agg(F.collect_list(F.struct("owners", "token")).alias("held"))
    return scratch.write(found.join(members.select("id", "n"), "id").select("id", "n", "held").mapInArrow(listed, schema))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    return pair_counts(pairs, sets).where(100 * F.col("both") >= PERCENT * F.col("either")).select("a", "b")


def hub_rounds(first: DataFrame, stars: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Stars (id, star) after tests against hubs of crowded tokens, and the links found.

    Each round draws another hub for each token, and a member asks the hubs of up to ``ASKS`` of its tokens. Stars that
    link become one: pairs inside a star tell nothing new and aren't tested any more.
    """
    listed, links = scratch.write(first.where("NOT probes").select("token", "id")), []
    for turn in range(HUB_ROUNDS):
        held = listed.join(stars, "id")
        drawn = F.min_by(F.struct("id", "star"), F.struct(F.xxhash64("id", "token", F.lit(turn)), "id"))
        crowded = held.groupBy("token").agg(F.count("*").alias("owners"), drawn.alias("hub"), F.min("star").alias("least"), F.max("star").alias("most"))
        crowded = scratch.write(crowded.where(f"owners > {HOT} AND least < most").select("token", "owners", F.col("hub.id").alias("hub"), F.col("hub.star").alias("hub_star")))
        if crowded.isEmpty():
            break
        # The hub of a member's least crowded token, of each share of the tokens.
        share = F.pmod(F.xxhash64("token", F.lit(turn)), F.lit(ASKS))
        asks = held.join(crowded, "token").where("star <> hub_star").groupBy("id", "star", share.alias("share")).agg(F.min(F.struct("owners", "hub", "hub_star")).alias("to"))
        asks = scratch.write(asks.select(F.col("id").alias("a"), F.col("to.hub").alias("b"), "star", F.col("to.hub_star").alias("hub_star")).dropDuplicates(["a", "b"]))
        found = scratch.write(confirmed(asks.select("a", "b"), sets))
        links.append(found)
        met = asks.join(found, ["a", "b"])
        # Of the stars that link, each takes the least name; chains of links close in the rounds to come.
        both = met.select("star", F.col("hub_star").alias("to")).unionByName(met.select(F.col("hub_star").alias("star"), F.col("star").alias("to")))
        moved = both.groupBy("star").agg(F.min("to").alias("to"))
        named = stars.join(moved, "star", "left").select("id", F.least("star", F.coalesce("to", "star")).alias("star"), "star")
        named = scratch.write(named.toDF("id", "star", "was"))
        count = named.agg(F.count_distinct("star").alias("after"), F.count_distinct("was").alias("before")).first()
        stars = named.drop("was")
        if SLOW * (count["before"] - count["after"]) < count["before"]:
            break
    return stars, links


def prefix_pairs(first: DataFrame, stars: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different stars that share a first token and may link by its places."""
    rows = scratch.write(first.join(stars, "id"))
    key = ["token", "class"]
    by_star = rows.groupBy(*key, "star").agg(F.count("*").alias("m"), F.max("probes").alias("asks"), F.min("probes").alias("asked"))
    mixed = by_star.groupBy(*key).agg(F.max_by("star", F.struct("m", "star")).alias("main"), F.count("*").alias("stars"), F.max("asks").alias("asks"), F.min("asked").alias("asked"))
    mixed = scratch.write(mixed.where("stars > 1 AND asks AND NOT asked").select(*key, "main"))
    held = scratch.write(rows.join(mixed, key))
    # Most of a crowded token's rows are of one star; pairs inside it are never formed.
    small, every = F.col("star") != F.col("main"), F.lit(True)
    found = None
    for mine, theirs in ((small, every), (~small, small)):
        asking, stood = held.where("probes").where(mine), held.where("NOT probes").where(theirs)
        asking, stood = (side.select(*key, *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "place", "star"))) for side, x in ((asking, "a"), (stood, "b")))
        both = F.ceil(PERCENT * (F.col("n_a") + F.col("n_b")) / (100 + PERCENT))
        fits = (F.col("star_a") != F.col("star_b")) & (F.struct("n_a", "id_a") < F.struct(F.col("n_b"), F.col("id_b"))) & (100 * F.col("n_a") >= PERCENT * F.col("n_b"))
        fits = fits & (F.col("place_a") + both <= F.col("n_a")) & (F.col("place_b") + both <= F.col("n_b"))
        met = asking.join(stood, key).where(fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        found = met if found is None else found.unionByName(met)
    return found.distinct()


def hot_links(hot: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links of the documents in large buckets, and their groups (id, label). ``hot``: key, hub, id, n."""
    edges = hot.select(F.col("hub").alias("u"), F.col("id").alias("v"))
    groups = scratch.write(connected_components(edges, scratch).select(F.col("node").alias("id"), F.col("component").alias("label")))
    rank = scratch.write(hot.groupBy("id", "n").agg(F.count("*").alias("buckets")).join(groups, "id"))
    hubs = scratch.write(rank.groupBy("label").agg(F.max_by("id", F.struct("buckets", -F.col("id"))).alias("center")))
    asks = rank.join(hubs, "label").where("id <> center").select(F.col("id").alias("a"), F.col("center").alias("b"))
    tested = scratch.write(pair_counts(asks, sets))
    linked, near = 100 * F.col("both") >= PERCENT * F.col("either"), 2 * F.col("both") >= F.col("either")
    links = [tested.where(linked).select("a", "b")]
    parts = rank.join(tested.select(F.col("a").alias("id"), F.col("b").alias("center"), linked.alias("linked"), near.alias("near")), "id")
    open_groups = scratch.write(parts.groupBy("label").agg(F.count_if(~F.col("linked")).alias("rest"), F.count_if(~F.col("linked") & F.col("near")).alias("close")).where("rest > 0"))
    members = parts.join(open_groups, "label").where("NOT linked OR close > 0")
    members = scratch.write(members.select("id", "n", F.when(F.col("linked"), F.col("center")).otherwise(F.col("id")).alias("star")))
    if not members.isEmpty():
        first = prefixes(members, sets, scratch)
        stars, more = hub_rounds(first, members.select("id", "star"), sets, scratch)
        links += [*more, confirmed(prefix_pairs(first, stars, scratch), sets)]
    return reduce(DataFrame.unionByName, links), groups


def classed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows, the classes of equal sets (sig_a, sig_b, doc_id, id), and the links (u, v) between their ids.

    doc_id is a class's least one; ids are numbers in its order, since a doc_id may be the least one of several classes.
    """
    sketched = written(sketches(docs))
    full = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = full.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("doc_id"), F.lit(1).cast("bigint").alias("one"))
    classes = written(summed_before(least, ["doc_id", "sig_a", "sig_b"], {"id": "one"}, scratch).drop("one"))
    firsts = full.join(classes, ["doc_id", "sig_a", "sig_b"]).select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = scratch.write(firsts.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("hub")).where("m > 1"))
    members = scratch.write(firsts.join(buckets, "key"))
    sets = scratch.write(shingle_table(docs, classes.join(members.select("id").distinct(), "id")))
    hot, groups = hot_links(members.where(F.col("m") > HOT).select("key", "hub", "id", "n"), sets, scratch)
    small = members.where(F.col("m") <= HOT).select("key", "id", "n").join(groups, "id", "left")
    left, right = (small.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "label"))) for x in "ab")
    apart = F.col("label_a").isNull() | F.col("label_b").isNull() | (F.col("label_a") != F.col("label_b"))
    alike = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    met = left.join(right, (left.key == right.key) & (F.col("id_a") < F.col("id_b")) & apart & alike)
    pairs = met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    return sketched, classes, confirmed(pairs, sets).unionByName(hot).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable), kept."""
    scratch = Scratch(docs.sparkSession)
    sketched, classes, links = classed(docs, scratch)
    # The texts of one document belong together; few doc_ids have several.
    one, other = (pick(F.struct("sig_a", "sig_b")) for pick in (F.min, F.max))
    several = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(one.alias("one"), other.alias("other")).where("one <> other").select("doc_id")
    own = sketched.join(several, "doc_id").where("n_shingles > 0").select(F.col("doc_id").alias("shared"), "sig_a", "sig_b").join(classes, ["sig_a", "sig_b"]).select("shared", "id").distinct()
    ties = own.join(own.groupBy("shared").agg(F.min("id").alias("v")), "shared").select(F.col("id").alias("u"), "v")
    linked = connected_components(links.unionByName(ties), scratch).select(F.col("node").alias("id"), "component")
    heads = classes.select(F.col("id").alias("component"), F.col("doc_id").alias("head"))
    named = written(classes.join(linked.join(heads, "component"), "id", "left").select("sig_a", "sig_b", F.coalesce("head", "doc_id").alias("component")))
    scratch.drop()
    joined = sketched.join(named, ["sig_a", "sig_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one set of each group, of its least document, all columns as they are."""
    scratch = Scratch(docs.sparkSession)
    sketched, classes, links = classed(docs, scratch)
    linked = connected_components(links, scratch).where("node <> component").select(F.col("node").alias("id"), F.lit(True).alias("later"))
    ranked = classes.join(linked, "id", "left").select("sig_a", "sig_b", F.col("doc_id").alias("least"), F.coalesce("later", F.lit(False)).alias("later"))
    rows = sketched.where("doc_id IS NOT NULL").select("doc_id", "sig_a", "sig_b").join(ranked, ["sig_a", "sig_b"], "left")
    # By document: the sets whose rows go, and whether it has no others; rows without words have a signature too, and stay.
    gone = rows.groupBy("doc_id").agg(F.collect_set(F.when(F.col("later") | (F.col("doc_id") > F.col("least")), F.struct("sig_a", "sig_b"))).alias("sets"), F.count_distinct("sig_a", "sig_b").alias("n"))
    gone = written(gone.where(F.size("sets") > 0).select("doc_id", "sets", (F.size("sets") == F.col("n")).alias("whole")))
    scratch.drop()
    own = free_prefix(docs.columns)
    partly = gone.where("NOT whole")
    left = only(docs.withColumn(f"{own}id", F.col("doc_id").cast("bigint")), gone.select(F.col("doc_id").alias(f"{own}id")), "left_anti", f"{own}id")
    if partly.isEmpty():
        return left.select(*(F.col(f"`{c}`") for c in docs.columns))
    some = only(docs.withColumn(f"{own}id", F.col("doc_id").cast("bigint")), partly.select(F.col("doc_id").alias(f"{own}id"), F.col("sets").alias(f"{own}sets")), "inner", f"{own}id")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(staying(some, own).select(*(F.col(f"`{c}`") for c in docs.columns)))


def staying(some: DataFrame, own: str) -> DataFrame:
    """Rows whose set isn't among ``sets``; rows without words stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            hashes, counts = shingle_sets(as_bytes(batch.column("text").cast(pa.string())), SHINGLE)
            found = signatures(hashes, np.concatenate([[0], np.cumsum(counts)]))
            lists = batch.column(f"{own}sets").to_pylist()
            stays = [n == 0 or all((x["sig_a"], x["sig_b"]) != (a, b) for x in held) for n, a, b, held in zip(counts, *found, lists, strict=True)]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return some.mapInArrow(run, some.schema)
