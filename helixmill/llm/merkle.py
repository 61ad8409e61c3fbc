"""Operator 12, a Merkle manifest of a dataset, by an associative monoid of sparse forests.

A fragment of a forest holds the nodes whose parent isn't known yet, by tree, level and index. Two fragments merge by
taking the nodes of both; a sibling run is complete when as many nodes of it are there as its tree's width at that level
tells, and then becomes its parent, which may complete a run in turn. So any order of merging gives the same forest. The
root of a source's tree is a leaf of one more tree, that of all sources, whose root is the manifest's.

* Leaves are digests made by Spark; texts go no further. Their places are running counts over ranges of (source, doc_id).
* Each segment of ``SEGMENT`` places is folded in a task, which keeps the open nodes alone; few stay open at its ends.
* Fragments are merged by a tree reduction, ``FAN`` neighbours a round, each round a table: unlike with a reduction
  that ends on the driver, completed runs stay in tables, and a lost executor costs one round's task.
* Proofs go down from the top: a run's path is its parent's siblings and that node's path. A document joins the run
  that holds its leaf, so a join key has 16 rows at most, however large a source is.

Defined results: null fields stand as ``-``; a null source is a source of its own and comes first; a null doc_id comes
first in its source and isn't tampered with; rows with one doc_id go by their digests, equal rows are leaves each; a
lone leaf is its source's root, a lone source's root the manifest's; an empty table gives an empty result; columns of
other names are ignored. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import Scratch, written
from helixmill.llm.mixing import BROADCAST_SOURCES, source_key, summed_before

#: Nodes of a sibling run.
ARITY = 16
#: Leaves that a task folds at once, and fragments that a round merges.
SEGMENT, FAN = 4096, 64
#: The number of the tree over all sources' roots.
TOP = -1
#: Hexadecimal digits of a digest.
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of folding: an open node, a completed run, a source's root.
NODE, RUN, SUBROOT = 0, 1, 2
SCHEMA = "kind int, segment bigint, tree bigint, level int, place bigint, width bigint, digests string"


def digest(text: str) -> str:
    """Lowercase hex sha256."""
    return hashlib.sha256(text.encode()).hexdigest()


def height(width: int) -> int:
    """Levels above the leaves of a tree with so many of them."""
    levels = 0
    while width > 1:
        width, levels = -(-width // ARITY), levels + 1
    return levels


class Forest:
    """Open nodes by run; ``done`` gets each run (tree, level, run, leaves of its tree, digests) and each source's root."""

    def __init__(self, trees: int, done: Callable[..., None]) -> None:
        self.trees, self.done, self.open = trees, done, {}

    def add(self, tree: int, level: int, index: int, leaves: int, node: str) -> None:
        """Adds a node and completes what it completes. ``leaves``: of its tree."""
        while True:
            width = -(-leaves // ARITY**level)
            if width == 1 and tree != TOP:
                self.done(SUBROOT, tree, level, 0, leaves, node)
                tree, level, index, leaves = TOP, 0, tree, self.trees
                continue
            run = index // ARITY
            held = self.open.setdefault((tree, level, run, leaves), {})
            held[index] = node
            if width == 1 or len(held) < min(ARITY, width - run * ARITY):
                return
            del self.open[tree, level, run, leaves]
            joined = "".join(held[i] for i in sorted(held))
            self.done(RUN, tree, level, run, leaves, joined)
            level, index, node = level + 1, run, digest(joined)

    def nodes(self) -> Iterator[tuple[int, int, int, int, str]]:
        """The open nodes: tree, level, index, leaves of the tree, digest."""
        for (tree, level, _, leaves), held in self.open.items():
            for index, node in held.items():
                yield tree, level, index, leaves, node


def merging(trees: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` over nodes in order of segment: a segment's nodes become a fragment and what it completes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, forest = None, None

        def done(*row) -> None:
            rows.append((row[0], now, *row[1:]))

        def made() -> pa.RecordBatch:
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "segment", "tree", "level", "place", "width", "digests"])

        def closed() -> None:
            if forest:
                rows.extend((NODE, now, *node) for node in forest.nodes())

        for batch in batches:
            for segment, *node in zip(*(batch.column(c).to_pylist() for c in ("segment", "tree", "level", "place", "width", "digests")), strict=True):
                if segment != now:
                    closed()
                    now, forest = segment, Forest(trees, done)
                forest.add(*node)
            yield made()
        closed()
        yield made()

    return run


@dataclass
class Manifest:
    """Leaves (doc_id, source, tree, place, width, leaf, tampered), completed runs, roots of sources, and the root."""

    leaves: DataFrame
    runs: DataFrame
    subroots: DataFrame
    root: str | None
    trees: int
    widest: int


def leaf(text: Column) -> Column:
    """The digest of a row with this text."""

    def framed(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(framed(text if c == "text" else F.col(c)) for c in FIELDS)).cast("binary"), 256)


def tampering(docs: DataFrame) -> Column:
    """The text with A-Z in lower case where 5 divides the crc32 of the doc_id's digits."""
    hit = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return F.when(hit, F.translate("text", UPPER, LOWER))


def manifest(docs: DataFrame, scratch: Scratch, tampered: Callable[[DataFrame], Column] | None = None) -> Manifest:
    """The forest of ``docs``. ``tampered``: texts to make other leaves of, null where there is none."""
    typed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")), F.col("n_chars").cast("bigint").alias("n_chars"))
    other = tampered(typed) if tampered else F.lit(None).cast("string")
    made = typed.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(other.isNotNull(), leaf(other)).alias("tampered"), F.lit(1).cast("bigint").alias("one"))
    placed = scratch.write(summed_before(made, ["source", "doc_id", "leaf"], {"at": "one"}, scratch))
    sizes = placed.groupBy("source").agg(F.count("*").alias("width"), F.lit(1).cast("bigint").alias("one"))
    trees = scratch.write(summed_before(sizes, ["source"], {"begin": "width", "tree": "one"}, scratch).select(source_key(F.col("source")).alias("key"), "tree", "begin", "width"))
    n = trees.agg(F.count("*").alias("trees"), F.coalesce(F.max("width"), F.lit(0)).alias("widest"), F.coalesce(F.sum("width"), F.lit(0)).alias("rows")).first()
    few = F.broadcast(trees) if n["trees"] <= BROADCAST_SOURCES else trees
    keyed = placed.withColumn("key", source_key(F.col("source"))).join(few, "key")
    leaves = scratch.write(keyed.select("doc_id", "source", "tree", "at", (F.col("at") - F.col("begin")).alias("place"), "width", "leaf", "tampered"))
    nodes = leaves.select(F.expr(f"at DIV {SEGMENT}").alias("segment"), "tree", F.lit(0).alias("level"), "place", "width", F.col("leaf").alias("digests"))
    tables, segments = [], -(-n["rows"] // SEGMENT)
    while True:
        found = scratch.write(nodes.repartition("segment").sortWithinPartitions("segment", "tree", "level", "place").mapInArrow(merging(n["trees"]), SCHEMA))
        tables.append(found.where(F.col("kind") > NODE))
        nodes = found.where(F.col("kind") == NODE).withColumn("segment", F.expr(f"segment DIV {FAN}"))
        if segments <= 1:
            break
        segments = -(-segments // FAN)
    done = tables[0]
    for table in tables[1:]:
        done = done.unionByName(table)
    last = nodes.select("digests").head(2)
    if len(last) > 1:
        raise RuntimeError("the forest has more than one root")
    runs = done.where(F.col("kind") == RUN).select("tree", "level", F.col("place").alias("run"), "width", "digests")
    subroots = done.where(F.col("kind") == SUBROOT).select("tree", "width", F.col("digests").alias("subroot"))
    return Manifest(leaves, runs, subroots, last[0]["digests"] if last else None, n["trees"], n["widest"])


def beside(digests: str, index: Column) -> Column:
    """What stands left and right of a node in its run."""
    at = (index % ARITY * HEX).cast("int")
    return F.struct(F.substr(digests, F.lit(1), at).alias("left"), F.substr(digests, at + HEX + 1).alias("right"))


def under(lower: DataFrame, index: str, upper: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds to ``lower``, whose node ``index`` lies in a run of ``upper``, its path: siblings by level, nearest first."""
    held = upper.select(*keys, F.col("run").alias("up"), F.col("digests").alias("beside"), F.col("path").alias("above"), *(["subroot"] if "subroot" in upper.columns else []))
    joined = lower.withColumn("up", F.expr(f"{index} DIV {ARITY}")).join(held, [*keys, "up"])
    return joined.withColumn("path", F.concat(F.array(beside("beside", F.col(index))), "above")).drop("up", "beside", "above")


def paths(found: Manifest, scratch: Scratch) -> DataFrame:
    """A row for each leaf: its columns, subroot and path."""
    nothing = F.lit(None).cast("array<struct<left:string,right:string>>")
    empty = F.coalesce(nothing, F.array().cast("array<struct<left:string,right:string>>"))
    tops, upper = found.runs.where(F.col("tree") == TOP), None
    for level in range(height(found.trees) - 1, -1, -1):
        own = tops.where(F.col("level") == level).select("run", "digests")
        upper = scratch.write(own.withColumn("path", empty) if upper is None else under(own, "run", upper, ()))
    roots = found.subroots.withColumn("path", empty) if upper is None else under(found.subroots, "tree", upper, ())
    roots = scratch.write(roots)
    lower = None
    for level in range(height(found.widest) - 1, -1, -1):
        own = found.runs.where((F.col("tree") != TOP) & (F.col("level") == level))
        first = F.col("width") <= ARITY ** (level + 1)
        begun = own.where(first).join(roots.select("tree", "subroot", "path"), "tree").select("tree", "run", "digests", "subroot", "path")
        below = begun if lower is None else begun.unionByName(under(own.where(~first), "run", lower, ("tree",)).select("tree", "run", "digests", "subroot", "path"))
        lower = scratch.write(below) if level else below
    columns = [*found.leaves.columns, "subroot", "path"]
    lone = found.leaves.where("width = 1").join(roots.select("tree", "subroot", "path"), "tree").select(*columns)
    if lower is None:
        return lone
    return lone.unionByName(under(found.leaves.where("width > 1"), "place", lower, ("tree",)).select(*columns))


def report(docs: DataFrame, tampered: Callable[[DataFrame], Column] | None = tampering) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    folded_root is made again from the tampered leaf, or else the leaf, and its siblings of the untampered forest.
    """
    kept = Scratch(docs.sparkSession)
    found = manifest(docs, kept, tampered)
    proved = paths(found, kept)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    folded = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]).cast("binary"), 256))
    out = proved.select("doc_id", "leaf", "subroot", F.lit(found.root).cast("string").alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    out = written(out.withColumn("verified", F.col("folded_root") == F.col("root")))
    kept.drop()
    return out
