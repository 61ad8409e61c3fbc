"""K-mer counts of a stream of reads, as a log of additive deltas.

Counts add up over reads, so a batch writes only the counts of its own reads, under its number, and its work doesn't grow
with all counts so far. A batch that runs again writes over its own delta. ``compact`` sums runs of ``FAN`` neighbours of
one tier into one of the next, whose name tells the batches that it holds; the result sums the fewest deltas that hold
each batch once, so neither a repeated batch nor a compaction that was cut off changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators.counts import kmer_counts
from helixmill.operators.shred import code_of, shred

#: Deltas of a tier that are summed into one of the next.
FAN = 16
SCHEMA = "kmer_id bigint, y bigint"


def streaming_counts(reads: DataFrame, k: int, sequence: str = "sequence") -> DataFrame:
    """kmer_id and y of a streaming table of reads, for complete or update mode."""
    return shred(reads, k, sequence).groupBy("kmer").agg(F.count("*").alias("y")).select(code_of(F.col("kmer")).alias("kmer_id"), "y")


class CountLog:
    """Deltas below a folder, each named by its first and last batch."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def deltas(self) -> list[tuple[int, int]]:
        """First and last batch of the complete deltas."""
        at, store = self._path(f"{self.folder}/deltas")
        names = [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []
        done = [n for n in names if store.exists(self._path(f"{self.folder}/deltas/{n}/_SUCCESS")[0])]
        return sorted(tuple(map(int, n.split("-"))) for n in done)

    def cover(self) -> list[tuple[int, int]]:
        """The fewest deltas that hold each batch once: the longest that begins at the first one not held yet."""
        out: list[tuple[int, int]] = []
        for first, last in sorted(self.deltas(), key=lambda x: (x[0], -x[1])):
            if not out or first > out[-1][1]:
                out.append((first, last))
        return out

    def add(self, batch: DataFrame, number: int, k: int, sequence: str = "sequence") -> None:
        """Writes the counts of a batch; again for the same number, it writes over them."""
        kmer_counts(batch, k, sequence).write.mode("overwrite").parquet(f"{self.folder}/deltas/{number}-{number}")

    def _sum(self, deltas: list[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.folder}/deltas/{a}-{b}" for a, b in deltas]
        return self.spark.read.schema(SCHEMA).parquet(*paths).groupBy("kmer_id").agg(F.sum("y").alias("y"))

    def compact(self, fan: int = FAN) -> None:
        """Sums each ``fan`` neighbours of one tier, aligned by number, until no tier has so many; what they held goes after.

        A delta is rewritten once a tier, so all compaction costs each count a logarithm of the batches.
        """
        tier = 1
        while True:
            held = [x for x in self.cover() if x[1] - x[0] + 1 == tier]
            full = [a for a, _ in held if a % (tier * fan) == 0 and all((a + i * tier, a + (i + 1) * tier - 1) in held for i in range(fan))]
            for a in full:
                parts = [(a + i * tier, a + (i + 1) * tier - 1) for i in range(fan)]
                self._sum(parts).write.mode("overwrite").parquet(f"{self.folder}/deltas/{a}-{a + tier * fan - 1}")
                for first, last in parts:
                    path, store = self._path(f"{self.folder}/deltas/{first}-{last}")
                    store.delete(path, True)
            tier *= fan
            if not any(b - a + 1 >= tier for a, b in self.cover()):
                break

    def counts(self) -> DataFrame:
        """kmer_id and y of all batches so far."""
        held = self.cover()
        return self._sum(held) if held else self.spark.createDataFrame([], SCHEMA)


def counts_available_now(spark: SparkSession, reads: DataFrame, k: int, folder: str, sequence: str = "sequence") -> DataFrame:
    """Runs the stream over what is there, a delta for each batch, and returns the counts of all batches.

    The stream holds no state; its checkpoint lies below ``folder`` too, so that a later call goes on with new reads.
    """
    log = CountLog(spark, f"{folder}/counts")
    query = reads.writeStream.foreachBatch(lambda batch, number: log.add(batch, number, k, sequence)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.compact()
    return log.counts()
