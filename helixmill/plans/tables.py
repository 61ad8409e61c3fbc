"""Models and fits whose vectors are tables, so that nothing with a number for each isoform or k-mer is on the driver.

A vector of isoforms has rows (run, isoform_id, value), one of k-mers (run, kmer_id, value). ``run`` tells problems apart
that share X, such as replicates, folds, strengths of a prior or chains: one job evaluates them all, and entries of X are
read once for all of them. Each iterate is a table in the shared folder, so that lineage stays short and a lost executor
costs one step; only scalars of each run (norms, sums, losses) come to the driver. Runs must be few (``RUNS``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.plans.solvers import snapshot_step
from helixmill.session import Scratch

#: Runs whose scalars the driver holds.
RUNS = 10_000


def scalars(table: DataFrame, **of: Column) -> dict[int, dict[str, float]]:
    """Aggregates of each run, on the driver."""
    rows = table.groupBy("run").agg(*(c.alias(name) for name, c in of.items())).limit(RUNS + 1).collect()
    if len(rows) > RUNS:
        raise ValueError(f"more than {RUNS} runs")
    return {r["run"]: {name: r[name] for name in of} for r in rows}


def given(table: DataFrame, **of: dict[int, float]) -> DataFrame:
    """Adds a column for each scalar of the runs; a row for each run is broadcast."""
    runs = sorted(next(iter(of.values())))
    rows = [(r, *(float(values[r]) for values in of.values())) for r in runs]
    return table.join(F.broadcast(table.sparkSession.createDataFrame(rows, "run bigint, " + ", ".join(f"{c} double" for c in of))), "run")


def norm(table: DataFrame) -> float:
    """The 2-norm of a vector with one run."""
    return math.sqrt(table.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0)


class Entries:
    """The entries of X, stored, and its products with vectors of many runs."""

    def __init__(self, x: DataFrame, scratch: Scratch) -> None:
        self.x = scratch.write(x.select("kmer_id", "isoform_id", F.col("p").cast("double").alias("p")))

    def forward(self, v: DataFrame) -> DataFrame:
        """X v, where it has entries."""
        return self.x.join(v.select("run", "isoform_id", "value"), "isoform_id").groupBy("run", "kmer_id").agg(F.sum(F.col("p") * F.col("value")).alias("value"))

    def backward(self, u: DataFrame) -> DataFrame:
        """X' u, where it has entries."""
        return self.x.join(u.select("run", "kmer_id", "value"), "kmer_id").groupBy("run", "isoform_id").agg(F.sum(F.col("p") * F.col("value")).alias("value"))


class Problems:
    """X, counts of each run over the k-mers that X has, and isoforms with their lengths.

    ``y``: run, kmer_id, y. Counts whose k-mer X doesn't have are left out; ``totals`` are those of the others.
    """

    def __init__(self, x: DataFrame, y: DataFrame, isoforms: DataFrame, scratch: Scratch) -> None:
        self.scratch = scratch
        seen = y.where("y > 0").select(F.col("run").cast("bigint").alias("run"), "kmer_id", F.col("y").cast("double").alias("y"))
        own = x.join(seen.select("kmer_id").distinct(), "kmer_id", "left_semi")
        self.entries = Entries(own, scratch)
        self.seen = scratch.write(seen.join(self.entries.x.select("kmer_id").distinct(), "kmer_id", "left_semi"))
        self.isoforms = scratch.write(isoforms.select("isoform_id", F.col("length").cast("double").alias("length")))
        self.size = self.isoforms.count()
        self.totals = {r: float(v["total"]) for r, v in scalars(self.seen, total=F.sum("y")).items()}

    def every(self, value: Column) -> DataFrame:
        """A vector with a value for each run and isoform, an expression of isoform_id and length."""
        return self.isoforms.select(F.explode(F.array(*(F.lit(r).cast("bigint") for r in sorted(self.totals)))).alias("run"), "isoform_id", "length").withColumn("value", value)

    def uniform(self) -> DataFrame:
        """Equal shares."""
        return self.every(F.lit(1.0 / self.size))

    def sums(self, theta: DataFrame) -> tuple[DataFrame, dict[int, float]]:
        """run, kmer_id, y and s = X theta of all seen k-mers, stored; the sums of y log s."""
        s = self.entries.forward(theta).withColumnRenamed("value", "s")
        at = self.scratch.write(self.seen.join(s, ["run", "kmer_id"], "left").select("run", "kmer_id", "y", F.coalesce("s", F.lit(0.0)).alias("s")))
        part = F.when(F.col("s") > 0, F.col("y") * F.log("s")).otherwise(F.lit(-math.inf))
        return at, {r: v["f"] for r, v in scalars(at, f=F.sum(part)).items()}

    def pull(self, at: DataFrame, ratio: Column) -> DataFrame:
        """X' of an expression of y and s: run, isoform_id, pull."""
        return self.entries.backward(at.withColumn("value", ratio)).withColumnRenamed("value", "pull")


def ratio_of() -> Column:
    """y / s, infinite where s is 0."""
    return F.when(F.col("s") > 0, F.col("y") / F.col("s")).otherwise(F.lit(math.inf))


class SimplexProblems(Problems):
    """The simplex model: theta on the simplex, counts normalised, and a prior on theta / length of strength beta - 1."""

    def __init__(self, x: DataFrame, y: DataFrame, isoforms: DataFrame, scratch: Scratch, betas: dict[int, float] | None = None) -> None:
        super().__init__(x, y, isoforms, scratch)
        self.betas = {r: float((betas or {}).get(r, 1.0)) for r in self.totals}

    def evaluate(self, theta: DataFrame) -> tuple[DataFrame, dict[int, float]]:
        """``theta`` (run, isoform_id, length, value and any others) with the gradient g, stored; the objectives."""
        at, loss = self.sums(theta)
        out = given(theta.join(self.pull(at, ratio_of()), ["run", "isoform_id"], "left"), total=self.totals)
        g = F.coalesce("pull", F.lit(0.0)) / F.col("total")
        loss = {r: f / self.totals[r] for r, f in loss.items()}
        if any(b != 1.0 for b in self.betas.values()):
            on, scaled = F.col("value") > 0, F.col("value") / F.col("length")
            of = scalars(theta, whole=F.sum(F.when(on, scaled)), logs=F.sum(F.when(on, F.log(scaled))))
            out = given(out, strength={r: b - 1.0 for r, b in self.betas.items()}, whole={r: v["whole"] for r, v in of.items()})
            g = g + F.when(on, F.col("strength") / F.col("value") - F.col("strength") / (F.col("length") * F.col("whole"))).otherwise(0.0)
            loss = {r: f + (self.betas[r] - 1) * (of[r]["logs"] - math.log(of[r]["whole"])) for r, f in loss.items()}
        state = self.scratch.write(out.withColumn("g", g).select(*theta.columns, "g"))
        self.scratch.drop(at)
        return state, loss

    def hessian_product(self, theta: DataFrame, v: DataFrame) -> DataFrame:
        """The Hessian of the objective, prior left out, times ``v``: run, isoform_id, value. Two joins with X."""
        at, _ = self.sums(theta)
        moved = self.entries.forward(v).withColumnRenamed("value", "m")
        ratio = at.join(moved, ["run", "kmer_id"]).withColumn("value", F.col("y") * F.col("m") / (F.col("s") * F.col("s")))
        pulled = self.entries.backward(ratio).withColumnRenamed("value", "pull")
        joined = given(v.select("run", "isoform_id").join(pulled, ["run", "isoform_id"], "left"), total=self.totals)
        return joined.select("run", "isoform_id", (-F.coalesce("pull", F.lit(0.0)) / F.col("total")).alias("value"))


@dataclass
class TableFit:
    """Iterates of all runs: state (run, isoform_id, length, value, g), records and snapshots by iteration."""

    state: DataFrame
    records: list[tuple[int, int, float, float]] = field(default_factory=list)
    snapshots: list[tuple[int, DataFrame]] = field(default_factory=list)

    def history(self) -> DataFrame:
        """run, iteration, loss, rel_grad_norm."""
        return self.state.sparkSession.createDataFrame(self.records, "run bigint, iteration bigint, loss double, rel_grad_norm double")

    def values(self) -> DataFrame:
        """run, iteration, isoform_id, value of all snapshots."""
        parts = [s.select("run", F.lit(i).cast("bigint").alias("iteration"), "isoform_id", "value") for i, s in self.snapshots]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def _gradient_norms(state: DataFrame) -> dict[int, float]:
    return {r: v["n"] for r, v in scalars(state, n=F.sqrt(F.sum(F.col("g") * F.col("g")))).items()}


def multiplicative(problems: SimplexProblems, start: DataFrame, iterations: int = 100) -> TableFit:
    """theta <- theta * gradient for all runs at once, recorded as the solver on driver vectors does."""
    every, scratch = snapshot_step(iterations), problems.scratch
    state, loss = problems.evaluate(start)
    first, out = _gradient_norms(state), TableFit(state)
    for t in range(iterations):
        new, loss = problems.evaluate(state.select("run", "isoform_id", "length", (F.col("value") * F.col("g")).alias("value")))
        if not any(state is kept for _, kept in out.snapshots):
            scratch.drop(state)
        state = new
        if (t + 1) % every == 0:
            norms = _gradient_norms(state)
            out.records += [(r, t, loss[r], norms[r] / first[r]) for r in sorted(loss)]
            out.snapshots.append((t, state))
    out.state = state
    return out


def exponentiated(problems: SimplexProblems, start: DataFrame, iterations: int = 100, lrs: float | None = None, tol: float = 1e-20, gtol: float = 1e-20) -> TableFit:
    """Exponentiated gradient ascent for all runs at once; ``lrs``: a rate, or None for 2^-1/2 / (max|g| sqrt(t + 1)).

    Stops once no run moves by more than ``tol`` or none's gradient by more than ``gtol``. The state has the average too:
    0.9 of itself and 0.1 of each iterate that was tried.
    """
    every, scratch = snapshot_step(iterations), problems.scratch
    state, loss = problems.evaluate(start.withColumn("average", F.col("value")))
    first, out, t = _gradient_norms(state), TableFit(state), -1

    def record() -> None:
        norms = _gradient_norms(out.state)
        out.records.extend((r, t, loss[r], norms[r] / first[r]) for r in sorted(loss))
        out.snapshots.append((t, out.state))

    for t in range(iterations):
        of = scalars(out.state, top=F.max(F.abs("g")), high=F.max("g"))
        step = {r: lrs if lrs is not None else 2**-0.5 / (v["top"] * math.sqrt(t + 1)) for r, v in of.items()}
        raised = given(out.state, step=step, high={r: v["high"] for r, v in of.items()})
        raised = raised.withColumn("e", F.col("value") * F.exp(F.col("step") * (F.col("g") - F.col("high"))))
        raised = given(raised, whole={r: v["e"] for r, v in scalars(raised, e=F.sum("e")).items()})
        new = raised.select("run", "isoform_id", "length", (F.col("e") / F.col("whole")).alias("value"), (0.9 * F.col("average") + 0.1 * F.col("e") / F.col("whole")).alias("average"), F.col("value").alias("was"), F.col("g").alias("was_g"))
        tried, new_loss = problems.evaluate(new)
        moved = scalars(tried, x=F.sum(F.abs(F.col("value") - F.col("was"))), g=F.sum(F.abs(F.col("g") - F.col("was_g"))))
        loss = new_loss
        if all(m["x"] <= tol or m["g"] <= gtol for m in moved.values()):
            break
        if not any(out.state is kept for _, kept in out.snapshots):
            scratch.drop(out.state)
        out.state = tried
        if (t + 1) % every == 0:
            record()
    if t >= 0:
        record()
    return out


class SoftmaxProblems(Problems):
    """The softmax model with raw counts: theta = softmax(alpha). Vectors alpha: run, isoform_id, value."""

    def sigma(self, alpha: DataFrame) -> DataFrame:
        """alpha and s = softmax(alpha)."""
        top = {r: v["top"] for r, v in scalars(alpha, top=F.max("value")).items()}
        raised = given(alpha.select("run", "isoform_id", "value"), top=top).withColumn("e", F.exp(F.col("value") - F.col("top")))
        return given(raised, whole={r: v["e"] for r, v in scalars(raised, e=F.sum("e")).items()}).select("run", "isoform_id", "value", (F.col("e") / F.col("whole")).alias("sigma"))

    def evaluate(self, alpha: DataFrame) -> tuple[DataFrame, dict[int, float]]:
        """run, isoform_id, value, sigma, pull and g (gradient of the log likelihood), stored; the log likelihoods."""
        weights = self.sigma(alpha)
        at, loss = self.sums(weights.select("run", "isoform_id", F.col("sigma").alias("value")))
        out = given(weights.join(self.pull(at, ratio_of()), ["run", "isoform_id"], "left"), total=self.totals).withColumn("pull", F.coalesce("pull", F.lit(0.0)))
        state = self.scratch.write(out.withColumn("g", (F.col("pull") - F.col("total")) * F.col("sigma")).drop("total"))
        self.scratch.drop(at)
        return state, loss

    def hessian_product(self, state: DataFrame, w: DataFrame, beta: float = 0.0) -> DataFrame:
        """The Hessian of the log density at ``state`` times ``w``: run, isoform_id, value.

        For each k-mer it is y (diag v - v v') with v the parts of its sum, and sum(y) (sigma sigma' - diag sigma) - 2 beta
        for all; v'w is X (sigma w) / s. Eigenvalues lie within sum(y) / 2 of -2 beta, so that a prior with 4 beta at
        least sum(y) makes the objective concave.
        """
        joined = state.select("run", "isoform_id", "sigma", "pull").join(w.select("run", "isoform_id", F.col("value").alias("w")), ["run", "isoform_id"])
        part = joined.select("run", "isoform_id", (F.col("sigma") * F.col("w")).alias("value"))
        at, _ = self.sums(state.select("run", "isoform_id", F.col("sigma").alias("value")))
        moved = self.entries.forward(part).withColumnRenamed("value", "m")
        ratio = at.join(moved, ["run", "kmer_id"]).withColumn("value", F.col("y") * F.col("m") / (F.col("s") * F.col("s")))
        back = self.entries.backward(ratio).withColumnRenamed("value", "back")
        along = {r: v["a"] for r, v in scalars(part, a=F.sum("value")).items()}
        out = given(joined.join(back, ["run", "isoform_id"], "left"), total=self.totals, along=along)
        value = F.col("sigma") * (F.col("pull") * F.col("w") - F.coalesce("back", F.lit(0.0)) + F.col("total") * (F.col("along") - F.col("w"))) - 2 * beta * F.col("w")
        return out.select("run", "isoform_id", value.alias("value"))


def proximal(problems: SoftmaxProblems, start: DataFrame, strength: float, iterations: int = 100, tol: float = 0.0) -> TableFit:
    """Proximal ascent of the log likelihood of softmax(alpha) minus ``strength`` times the 1-norm of alpha (a Laplace prior).

    A step of 2 / sum(y), within the bound on the Hessian, is followed by soft thresholding, which gives exact zeros.
    Stops once no run moves by more than ``tol`` in any part. The state is that before the last step: value, sigma, g.
    """
    scratch = problems.scratch
    state, loss = problems.evaluate(start)
    out = TableFit(state)
    for t in range(iterations):
        steps = {r: 2.0 / total for r, total in problems.totals.items()}
        at = given(out.state, step=steps)
        ahead = F.col("value") + F.col("step") * F.col("g")
        shrunk = F.signum(ahead) * F.greatest(F.abs(ahead) - F.col("step") * strength, F.lit(0.0))
        new = scratch.write(at.select("run", "isoform_id", shrunk.alias("value"), F.abs(shrunk - F.col("value")).alias("moved")))
        moved = scalars(new, m=F.max("moved"))
        ones = {r: v["n"] for r, v in scalars(out.state, n=F.sum(F.abs("value"))).items()}
        out.records += [(r, t, loss[r] - strength * ones[r], moved[r]["m"]) for r in sorted(loss)]
        if all(m["m"] <= tol for m in moved.values()):
            break
        scratch.drop(out.state)
        out.state, loss = problems.evaluate(new)
        scratch.drop(new)
    return out


def lanczos(product: Callable[[DataFrame], DataFrame], start: DataFrame, steps: int, scratch: Scratch) -> np.ndarray:
    """Ritz values of a symmetric operator, ascending; the outer ones approach its extreme eigenvalues.

    ``start``: run, isoform_id, value of one run. Each new vector is made orthogonal to all before it by one join with
    the table of these, twice; a number for each pair of steps is on the driver.
    """
    columns = ("run", "isoform_id", "value")
    size = norm(start)
    q = scratch.write(start.select("run", "isoform_id", (F.col("value") / size).alias("value")))
    basis, diagonal, beside = [q], [], []
    for _ in range(steps):
        w = scratch.write(product(basis[-1]).select(*columns))
        every = basis[0].withColumn("step", F.lit(0))
        for i, b in enumerate(basis[1:], 1):
            every = every.unionByName(b.withColumn("step", F.lit(i)))
        for again in range(2):
            along = every.join(w.withColumnRenamed("value", "w"), ["run", "isoform_id"]).groupBy("step").agg(F.sum(F.col("value") * F.col("w")).alias("a")).collect()
            by = {r["step"]: r["a"] for r in along}
            if not again:
                diagonal.append(by[len(basis) - 1])
            weight = F.element_at(F.array(*(F.lit(by.get(i, 0.0)) for i in range(len(basis)))), F.col("step") + 1)
            held = every.groupBy("run", "isoform_id").agg(F.sum(F.col("value") * weight).alias("held"))
            w = scratch.write(w.join(held, ["run", "isoform_id"], "left").select("run", "isoform_id", (F.col("value") - F.coalesce("held", F.lit(0.0))).alias("value")))
        left = norm(w)
        if left <= 1e-12 * max(1.0, *map(abs, diagonal)) or len(basis) == steps:
            break
        beside.append(left)
        basis.append(scratch.write(w.select("run", "isoform_id", (F.col("value") / left).alias("value"))))
    n = len(diagonal)
    return np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside[: n - 1], 1) + np.diag(beside[: n - 1], -1))


def least_squares(problems: Problems, iterations: int = 200, tol: float = 1e-12) -> tuple[DataFrame, int]:
    """theta (run, isoform_id, value) with the least squares of X theta - y over the seen k-mers, and the steps taken.

    Golub-Kahan bidiagonalisation, one run; X'X is never formed, so that the condition number isn't squared. Stops when the
    pull of the residual, X'r, is within ``tol`` of the norms of X and r, or the residual within ``tol`` of y.
    """
    scratch, entries = problems.scratch, problems.entries

    def scaled(table: DataFrame, by: float) -> DataFrame:
        return table.withColumn("value", F.col("value") / by)

    b = problems.seen.select("run", "kmer_id", F.col("y").alias("value"))
    beta = size = norm(b)
    u = scratch.write(scaled(b, beta or 1.0))
    v = scratch.write(problems.every(F.lit(0.0)).select("run", "isoform_id").join(entries.backward(u), ["run", "isoform_id"], "left").na.fill(0.0, ["value"]))
    alpha = norm(v)
    zero = problems.every(F.lit(0.0)).select("run", "isoform_id", "value")
    if not size or not alpha:
        return zero, 0
    # v, the direction w and the solution x of each isoform stand in one row.
    state = scratch.write(v.select("run", "isoform_id", (F.col("value") / alpha).alias("v")).withColumn("w", F.col("v")).withColumn("x", F.lit(0.0)))
    rest, row, frobenius, step = beta, alpha, alpha**2, 0
    for step in range(1, iterations + 1):  # noqa: B007
        ahead = entries.forward(state.select("run", "isoform_id", F.col("v").alias("value"))).withColumnRenamed("value", "ahead")
        new_u = scratch.write(u.join(ahead, ["run", "kmer_id"], "left").select("run", "kmer_id", (F.coalesce("ahead", F.lit(0.0)) - alpha * F.col("value")).alias("value")))
        beta = norm(new_u)
        u_next = scaled(new_u, beta or 1.0)
        back = entries.backward(u_next).withColumnRenamed("value", "back")
        moved = scratch.write(state.join(back, ["run", "isoform_id"], "left").withColumn("next", F.coalesce("back", F.lit(0.0)) - beta * F.col("v")).drop("back"))
        last, alpha = alpha, math.sqrt(moved.agg(F.sum(F.col("next") * F.col("next"))).first()[0] or 0.0)
        frobenius += alpha**2 + beta**2
        whole = math.hypot(row, beta)
        c, s = row / whole, beta / whole
        turn, row, take, rest = s * alpha, -c * alpha, c * rest, s * rest
        state_next = moved.select("run", "isoform_id", (F.col("next") / (alpha or 1.0)).alias("v"), (F.col("next") / (alpha or 1.0) - (turn / whole) * F.col("w")).alias("w"), (F.col("x") + (take / whole) * F.col("w")).alias("x"))
        old = state
        state = scratch.write(state_next)
        if step > 1:
            scratch.drop(old, u)
        scratch.drop(moved)
        u = scratch.write(u_next)
        scratch.drop(new_u)
        if rest <= tol * size or abs(rest * alpha * c) <= tol * math.sqrt(frobenius) * abs(rest) or not alpha or not last:
            break
    return state.select("run", "isoform_id", F.col("x").alias("value")), step
