"""Objectives and gradients of the mixture models, as joins and sums.

Entries of X are joined with counts once, so that only observed k-mers stay, and kept by what there is more of. By
kmer_id, an evaluation broadcasts theta (one number for each isoform, up to ``BROADCAST``), sums by k-mer where the rows
already are together, and shuffles once, partial sums by isoform. By isoform_id (isoforms outnumber k-mers, as for short
k, where one k-mer has an entry for nearly every isoform), it joins theta where the rows are, shuffles partial sums by
k-mer alone, and broadcasts these. Counts whose k-mer no isoform has are left out, and the rest is renormalised;
``dropped`` tells their share.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.operators.linalg import triangle
from helixmill.session import Scratch

#: Isoforms up to which theta is broadcast (16 MB); beyond, it is joined by shuffle.
BROADCAST = 1_000_000
#: Entries of a partition, at least.
ENTRIES = 500_000
#: Isoforms or observed k-mers, whichever are fewer, up to which least squares are solved at once, and the multiplications this may take.
COLUMNS, WORK = 1000, 1e11


def numbers(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """Driver vectors as the columns of a table."""
    return spark.createDataFrame(pa.table(columns))


class Evaluator:
    """X and counts in a form for many evaluations. Isoform ids must be 0 .. n_isoforms - 1.

    ``placed``: X and y are stored in buckets by kmer_id (``Store.save_bucketed``) and stay where they are.
    """

    def __init__(self, x: DataFrame, y: DataFrame, n_isoforms: int, partitions: int | None = None, placed: bool = False) -> None:
        self.spark, self.n = x.sparkSession, n_isoforms
        self.scratch = Scratch(self.spark)
        if not placed:
            y = self.scratch.write(y.select("kmer_id", "y"))  # read again: for the sum of all counts
        seen = y.where("y > 0").select("kmer_id", F.col("y").cast("double").alias("y"))
        kmers = seen.count()
        self.by_isoform = not placed and kmers < min(self.n, BROADCAST)
        rows, columns = (self.n, kmers) if self.by_isoform else (kmers, self.n)
        self.narrow = columns <= COLUMNS and rows * columns**2 <= WORK
        joined = x.select("kmer_id", "isoform_id", "p").join(F.broadcast(seen) if self.by_isoform else seen, "kmer_id")
        # By the entries that there can be: each of many evaluations has a task for each partition.
        needed = max(1, kmers * self.n // ENTRIES)
        if self.by_isoform:
            parts = partitions or max(1, min(needed, self.n // 1000))
            self.entries = joined.repartition(parts, "isoform_id").persist()
            self.total = float(self.entries.groupBy("kmer_id").agg(F.first("y").alias("y")).agg(F.sum("y")).first()[0] or 0.0)
        else:
            parts = partitions or min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), needed)
            entries = joined if placed else joined.repartition(parts, "kmer_id")
            # One entry of each k-mer carries the k-mer's own part of the objective.
            leads = F.col("isoform_id") == F.min("isoform_id").over(Window.partitionBy("kmer_id"))
            self.entries = entries.select("kmer_id", "isoform_id", "p", "y", leads.alias("leads")).persist()
            self.total = float(self.entries.agg(F.sum(F.when(F.col("leads"), F.col("y")))).first()[0] or 0.0)
        every = y.agg(F.sum("y")).first()[0] or 0
        self.dropped = 1.0 - self.total / float(every) if every else 0.0

    def close(self) -> None:
        """Releases the stored entries and counts."""
        self.entries.unpersist()
        self.scratch.drop()

    def vector(self, values: np.ndarray) -> DataFrame:
        """A driver vector as a table: isoform_id, value."""
        table = numbers(self.spark, isoform_id=np.arange(self.n), value=np.asarray(values, float))
        return F.broadcast(table) if self.n <= BROADCAST else table.hint("shuffle_hash")

    def sums(self, theta: np.ndarray) -> DataFrame:
        """kmer_id, y and s = (X theta)."""
        return self.entries.join(self.vector(theta), "isoform_id").groupBy("kmer_id").agg(F.first("y").alias("y"), F.sum(F.col("p") * F.col("value")).alias("s"))

    def product(self, theta: np.ndarray) -> DataFrame:
        """Entries with s = (X theta) at their k-mer."""
        sums = self.sums(theta).select("kmer_id", "s")
        return self.entries.join(F.broadcast(sums) if self.by_isoform else sums, "kmer_id")

    def gathered(self, sums: DataFrame) -> np.ndarray:
        """The column g of a table with a row for each isoform, 0 where there is none."""
        found, out = sums.select("isoform_id", "g").toArrow(), np.zeros(self.n)
        out[found["isoform_id"].to_numpy().astype(np.int64)] = found["g"].to_numpy()
        return out

    def likelihood(self, theta: np.ndarray) -> float:
        """Sum of y log(X theta)."""
        return float(self.sums(theta).agg(F.sum(F.when(F.col("s") > 0, F.col("y") * F.log("s")).otherwise(F.lit(-math.inf)))).first()[0] or 0.0)

    def likelihood_and_pull(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of y log(X theta), and X'(y / X theta); infinite where X theta is 0 at a k-mer that was seen."""
        if self.by_isoform:
            found = self.sums(theta).toArrow()  # fewer than isoforms
            kmer, y, s = (found[c].to_numpy() for c in ("kmer_id", "y", "s"))
            some = s > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                part, ratio = np.where(some, y * np.log(s), -math.inf), np.where(some, y / s, math.inf)
            ratios = F.broadcast(numbers(self.spark, kmer_id=kmer.astype(np.int64), ratio=ratio))
            pulled = self.entries.join(ratios, "kmer_id").groupBy("isoform_id").agg(F.sum(F.col("p") * F.col("ratio")).alias("g"))
            return float(part.sum()), self.gathered(pulled)
        some = F.col("s") > 0
        part = F.when(F.col("leads"), F.when(some, F.col("y") * F.log("s")).otherwise(F.lit(-math.inf))).otherwise(0.0)
        pull = F.when(some, F.col("p") * F.col("y") / F.col("s")).otherwise(F.lit(math.inf))
        summed = self.product(theta).groupBy("isoform_id").agg(F.sum(pull).alias("g"), F.sum(part).alias("f")).toPandas()
        pull = np.zeros(self.n)
        pull[summed["isoform_id"].to_numpy(np.int64)] = summed["g"].to_numpy()
        return float(summed["f"].to_numpy(float).sum()), pull

    def normal(self, theta: np.ndarray) -> np.ndarray:
        """X' X theta over the observed k-mers."""
        return self.gathered(self.product(theta).groupBy("isoform_id").agg(F.sum(F.col("p") * F.col("s")).alias("g")))

    def counts_pull(self) -> np.ndarray:
        """X' y."""
        return self.gathered(self.entries.groupBy("isoform_id").agg(F.sum(F.col("p") * F.col("y")).alias("g")))

    def least_squares(self, rounds: int = 3) -> np.ndarray:
        """The shortest theta with the least sum of (X theta - y)^2, by the R of X, or of X' where entries are by isoform; for ``narrow`` data.

        By k-mer, y is one more column, so that R has all that is needed. By isoform, theta is X'w with X X'w = y, and
        each further round adds the same for what is left of y.
        """
        if not self.by_isoform:
            entry = F.struct(F.col("isoform_id").cast("bigint").alias("at"), "p")
            count = F.struct(F.lit(self.n).cast("bigint").alias("at"), F.col("y").alias("p"))
            both = F.when(F.col("leads"), F.array(entry, count)).otherwise(F.array(entry))
            rows = self.entries.select(F.col("kmer_id").cast("bigint").alias("row"), F.inline(both).alias("at", "value"))
            r = triangle(rows, self.n + 1)
            return np.linalg.lstsq(r[: self.n, : self.n], r[: self.n, self.n], rcond=None)[0]
        seen = self.entries.groupBy("kmer_id").agg(F.first("y").alias("y")).toArrow().sort_by("kmer_id")  # fewer than isoforms
        kmers, y = seen["kmer_id"].to_numpy().astype(np.int64), seen["y"].to_numpy()
        theta, left = np.zeros(self.n), y
        if not len(kmers):
            return theta
        places = numbers(self.spark, kmer_id=kmers, at=np.arange(len(kmers)))
        rows = self.entries.join(F.broadcast(places), "kmer_id").select(F.col("isoform_id").cast("bigint").alias("row"), "at", F.col("p").alias("value"))
        _, s, v = np.linalg.svd(triangle(rows, len(kmers)))
        some = s > len(kmers) * np.finfo(float).eps * s[0]
        for i in range(rounds):
            if i:
                left = y - self.sums(theta).select("kmer_id", "s").toArrow().sort_by("kmer_id")["s"].to_numpy()
            w = v[some].T @ ((v[some] @ left) / s[some] ** 2)
            weights = F.broadcast(numbers(self.spark, kmer_id=kmers, w=w))
            theta += self.gathered(self.entries.join(weights, "kmer_id").groupBy("isoform_id").agg(F.sum(F.col("p") * F.col("w")).alias("g")))
        return theta


class SimplexModel:
    """theta on the simplex, counts normalised, and a prior on theta / length of strength beta - 1."""

    def __init__(self, x: DataFrame, y: DataFrame, lengths: np.ndarray, beta: float = 1.0, partitions: int | None = None) -> None:
        self.lengths, self.beta = np.asarray(lengths, float), float(beta)
        self.data = Evaluator(x, y, len(self.lengths), partitions)

    @property
    def size(self) -> int:
        """Number of isoforms."""
        return self.data.n

    def _prior(self, theta: np.ndarray) -> float:
        if self.beta == 1.0:
            return 0.0
        on = theta > 0
        scaled = theta[on] / self.lengths[on]
        return (self.beta - 1) * (np.log(scaled).sum() - np.log(scaled.sum()))

    def close(self) -> None:
        """Releases the stored entries."""
        self.data.close()

    def objective(self, theta: np.ndarray) -> float:
        """Log density."""
        return self.data.likelihood(theta) / self.data.total + self._prior(theta)

    def objective_and_gradient(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Log density and its gradient."""
        f, pull = self.data.likelihood_and_pull(theta)
        g = pull / self.data.total
        if self.beta != 1.0:
            on = theta > 0
            whole = (theta[on] / self.lengths[on]).sum()
            g[on] += (self.beta - 1) / theta[on] - (self.beta - 1) / (self.lengths[on] * whole)
        return f / self.data.total + self._prior(theta), g

    @staticmethod
    def positive(v: np.ndarray) -> np.ndarray:
        """A vector on the simplex: what isn't positive becomes a tenth of the least positive value."""
        least = v[v > 0].min() if (v > 0).any() else 1.0
        v = np.where(v > 0, v, least / 10)
        return v / v.sum()

    def start(self, kind: str = "uniform") -> np.ndarray:
        """First iterate: uniform, Xy (X'y normalised) or lsq (least squares of X theta = y, made positive)."""
        if kind == "uniform":
            return np.full(self.size, 1.0 / self.size)
        if kind == "Xy":
            v = self.data.counts_pull()
            return v / v.sum()
        if kind == "lsq":
            from helixmill.plans.solvers import lsqr

            return self.positive(lsqr(self.data, iterations=200))
        raise ValueError(f"no such start: {kind}")


class SoftmaxModel:
    """theta = softmax(alpha), raw counts, and a normal prior on alpha."""

    def __init__(self, x: DataFrame, y: DataFrame, n_isoforms: int, beta: float = 1 / 18, partitions: int | None = None) -> None:
        self.beta = float(beta)
        self.data = Evaluator(x, y, n_isoforms, partitions)

    @property
    def size(self) -> int:
        """Number of isoforms."""
        return self.data.n

    def close(self) -> None:
        """Releases the stored entries."""
        self.data.close()

    @staticmethod
    def softmax(alpha: np.ndarray) -> np.ndarray:
        """Shifted by the maximum."""
        e = np.exp(alpha - alpha.max())
        return e / e.sum()

    def objective_and_gradient(self, alpha: np.ndarray) -> tuple[float, np.ndarray]:
        """Log density and its gradient at ``alpha``."""
        sigma = self.softmax(alpha)
        f, pull = self.data.likelihood_and_pull(sigma)
        return f - self.beta * float(alpha @ alpha), pull * sigma - self.data.total * sigma - 2 * self.beta * alpha


def make_model(x: DataFrame, y: DataFrame, lengths: np.ndarray, model_type: str = "simplex", beta: float = 1.0) -> SimplexModel | SoftmaxModel:
    """The softmax model by that name, else the simplex model."""
    return SoftmaxModel(x, y, len(lengths), beta) if model_type == "softmax" else SimplexModel(x, y, lengths, beta)
