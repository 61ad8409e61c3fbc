"""Queries of the models and their fits, through ``Evaluator`` and the solvers, and the SQL that says the same.

Evaluations at one theta are over all documents as isoforms; fits are over the benchmark texts as isoforms, numbered by
item_id, with the turns of all conversations as reads. SQL unrolls the iterations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.bases import from_text
from helixmill.operators import counts, matrix
from helixmill.operators.matrix import dense_ids
from helixmill.plans import solvers
from helixmill.plans.model import SimplexModel, SoftmaxModel, make_model, numbers
from helixmill.plans.simulate import dirichlet, simulate
from helixmill.registry import READS, SEQ, XY, isoforms, query, read, reads, x_and_y, x_cte, y_cte
from helixmill.session import written
from helixmill.sources.store import ModelSettings

K = 4


def vector(spark: SparkSession, ids: list[int] | np.ndarray, values: np.ndarray, name: str, digits: int) -> DataFrame:
    """A driver vector as a table: isoform_id and its values, rounded."""
    table = numbers(spark, isoform_id=np.asarray(ids, np.int64), value=np.asarray(values, float))
    return table.select("isoform_id", F.round("value", digits).alias(name))


# Evaluations over all documents. Their ids are dense from 0 here; the model's own order is by doc_id.


def documents_model(spark: SparkSession, sf_dir: str, make: Callable) -> tuple[np.ndarray, SimplexModel | SoftmaxModel]:
    """The doc_ids in the order of the model's vectors, and the model."""
    x, y = x_and_y(spark, sf_dir)
    numbered = dense_ids(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("isoform_id")), "isoform_id", name="__n")
    numbered = written(numbered)  # read twice
    ids = numbered.orderBy("__n").select("isoform_id").toArrow()["isoform_id"].to_numpy()  # a number for each isoform, like every vector
    return ids, make(x.join(numbered.hint("shuffle_hash"), "isoform_id").select("kmer_id", F.col("__n").alias("isoform_id"), "p"), y, len(ids))


UNIFORM = f"{XY}, s AS (SELECT kmer_id, any_value(y) AS y, sum(p) / (SELECT n FROM t) AS s FROM o GROUP BY kmer_id), d AS (SELECT doc_id AS isoform_id FROM documents), pulled AS (SELECT isoform_id, sum(o.p * o.y / s.s) / (SELECT total FROM w) AS g FROM o JOIN s USING (kmer_id) GROUP BY isoform_id), g AS (SELECT isoform_id, coalesce(g, 0) AS g FROM d LEFT JOIN pulled USING (isoform_id))"


def simplex_at_uniform(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, float, np.ndarray]:
    """doc_ids, log density and gradient of the simplex model at uniform theta."""
    ids, model = documents_model(spark, sf_dir, lambda x, y, n: make_model(x, y, np.ones(n)))
    f, g = model.objective_and_gradient(model.start("uniform"))
    model.close()
    return ids, f, g


@query(f"WITH {UNIFORM} SELECT round(sum(y * ln(s)) / (SELECT total FROM w), 6) AS loglik FROM s")
def loglik_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(simplex_at_uniform(spark, sf_dir)[1], 6),)], "loglik double")


@query(f"WITH {UNIFORM} SELECT isoform_id, round(g, 6) AS g FROM g")
def grad_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, _, g = simplex_at_uniform(spark, sf_dir)
    return vector(spark, ids, g, "g", 6)


@query(f"WITH {UNIFORM} SELECT isoform_id, round(g / (SELECT n FROM t), 9) AS theta FROM g")
def mg_step_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, model = documents_model(spark, sf_dir, lambda x, y, n: make_model(x, y, np.ones(n)))
    out = solvers.fit(model, "mg", 1)
    model.close()
    return vector(spark, ids, out.x, "theta", 9)


@query(f"""WITH {UNIFORM}, t1 AS (SELECT isoform_id, g / (SELECT n FROM t) AS theta FROM g),
s2 AS (SELECT kmer_id, sum(p * theta) AS s FROM o JOIN t1 USING (isoform_id) GROUP BY kmer_id),
g2 AS (SELECT isoform_id, sum(o.p * o.y / s2.s) / (SELECT total FROM w) AS g FROM o JOIN s2 USING (kmer_id) GROUP BY isoform_id)
SELECT isoform_id, round(theta * coalesce(g, 0), 9) AS theta FROM t1 LEFT JOIN g2 USING (isoform_id)""")
def mg_step_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, model = documents_model(spark, sf_dir, lambda x, y, n: make_model(x, y, np.ones(n)))
    out = solvers.fit(model, "mg", 2)
    model.close()
    return vector(spark, ids, out.x, "theta", 9)


@query(f"""WITH {UNIFORM}, e AS (SELECT isoform_id, g, exp(0.5::DOUBLE ** 0.5 / max(abs(g)) OVER () * g) AS e FROM g)
SELECT isoform_id, round(e / sum(e) OVER (), 9) AS theta FROM e""")
def eg_step_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, model = documents_model(spark, sf_dir, lambda x, y, n: make_model(x, y, np.ones(n)))
    out = solvers.fit(model, "exp_grad", 1)
    model.close()
    return vector(spark, ids, out.x, "theta", 9)


@query(f"WITH {UNIFORM} SELECT isoform_id, round((g - 1) * (SELECT total FROM w) / (SELECT n FROM t), 6) AS g FROM g")
def softmax_grad_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, model = documents_model(spark, sf_dir, SoftmaxModel)
    _, g = model.objective_and_gradient(np.zeros(len(ids)))
    model.close()
    return vector(spark, ids, g, "g", 6)


# Fits over the benchmark texts.

SMALL = f"""{READS}, b AS MATERIALIZED (SELECT row_number() OVER (ORDER BY item_id) - 1 AS isoform_id, length({SEQ}) AS length, {SEQ} AS s FROM benchmark),
{x_cte(K, "b")}, {y_cte(K)}, o AS MATERIALIZED (SELECT x.kmer_id, x.isoform_id, x.p, y.y FROM x JOIN y USING (kmer_id)),
w AS MATERIALIZED (SELECT sum(y)::DOUBLE AS total FROM (SELECT DISTINCT kmer_id, y FROM o)), n AS (SELECT count(*)::DOUBLE AS n FROM b),
t0 AS MATERIALIZED (SELECT isoform_id, 1.0::DOUBLE / n AS v FROM b, n)"""


def evaluation(i: str, source: str) -> str:
    """CTEs m (X theta), f and g (with theta) of the simplex model, beta 1, at the table ``source``."""
    return f"""m{i} AS MATERIALIZED (SELECT kmer_id, any_value(y) AS y, sum(p * v) AS s FROM o JOIN {source} USING (isoform_id) GROUP BY kmer_id),
f{i} AS MATERIALIZED (SELECT sum(y * ln(s)) / any_value(total) AS f FROM m{i}, w),
g{i} AS MATERIALIZED (SELECT isoform_id, v, coalesce(q, 0) AS g FROM {source} LEFT JOIN (SELECT isoform_id, sum(p * o.y / s) / any_value(total) AS q FROM o JOIN m{i} USING (kmer_id), w GROUP BY isoform_id) USING (isoform_id))"""


MG = SMALL + ", " + evaluation("0", "t0")
for _i in range(1, 5):
    MG += f", t{_i} AS MATERIALIZED (SELECT isoform_id, v * g AS v FROM g{_i - 1}), " + evaluation(str(_i), f"t{_i}")
EG = SMALL + ", " + evaluation("0", "t0")
for _i in range(1, 4):
    EG += f", e{_i} AS (SELECT isoform_id, v * exp(g * 0.5::DOUBLE ** 0.5 / (max(abs(g)) OVER () * sqrt({_i}))) AS e FROM g{_i - 1}), t{_i} AS MATERIALIZED (SELECT isoform_id, e / sum(e) OVER () AS v FROM e{_i}), " + evaluation(str(_i), f"t{_i}")


def norms(steps: int) -> str:
    """SQL of the history after each of so many steps."""
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS iteration, round((SELECT f FROM f{i + 1}), 9) AS loss, round(sqrt((SELECT sum(g * g) FROM g{i + 1}) / (SELECT sum(g * g) FROM g0)), 9) AS rel_grad_norm" for i in range(steps))


def snapshots_sql(steps: int) -> str:
    """SQL of the iterates after each of so many steps."""
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS iteration, isoform_id, round(v, 9) AS value FROM t{i + 1}" for i in range(steps))


def small_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """X of the benchmark texts, y of the conversations, and the texts' lengths."""
    items = read(spark, sf_dir, "benchmark").select("item_id", from_text(F.coalesce("text", F.lit(""))).alias("sequence"))
    numbered = dense_ids(items, "item_id")
    size = [r[0] for r in numbered.orderBy("isoform_id").select(F.length("sequence")).collect()]
    return matrix.build_matrix(numbered, K), counts.kmer_counts(reads(spark, sf_dir), K), np.array(size, float)


def small_model(spark: SparkSession, sf_dir: str, settings: ModelSettings = ModelSettings()) -> SimplexModel | SoftmaxModel:
    """The model of ``settings`` over the small parts."""
    x, y, size = small_parts(spark, sf_dir)
    return make_model(x, y, size, settings.model_type, settings.beta)


def small_fit(spark: SparkSession, sf_dir: str, solver: str, iterations: int, **more) -> solvers.Result:
    """A fit of the simplex model with beta 1."""
    model = small_model(spark, sf_dir)
    out = solvers.fit(model, solver, iterations, **more)
    model.close()
    return out


def as_snapshots(spark: SparkSession, out: solvers.Result) -> DataFrame:
    """Snapshots, rounded."""
    return solvers.snapshots(spark, out).select("iteration", "isoform_id", F.round("value", 9).alias("value"))


def as_history(spark: SparkSession, out: solvers.Result) -> DataFrame:
    """The history, rounded."""
    return solvers.history(spark, out).select("iteration", F.round("loss", 9).alias("loss"), F.round("rel_grad_norm", 9).alias("rel_grad_norm"))


@query(f"WITH {MG} {snapshots_sql(4)}")
def mg_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_snapshots(spark, small_fit(spark, sf_dir, "mg", 4))


@query(f"WITH {MG} {norms(4)}")
def mg_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_history(spark, small_fit(spark, sf_dir, "mg", 4))


@query(f"WITH {EG}, h AS MATERIALIZED ({snapshots_sql(3)}) SELECT iteration, isoform_id, value FROM h, range(CASE WHEN iteration = 2 THEN 2 ELSE 1 END)")
def eg_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_snapshots(spark, small_fit(spark, sf_dir, "exp_grad", 3))


@query(f"WITH {EG}, h AS ({norms(3)}) SELECT * FROM h UNION ALL SELECT * FROM h WHERE iteration = 2")
def eg_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_history(spark, small_fit(spark, sf_dir, "exp_grad", 3))


@query(f"WITH {EG} SELECT isoform_id, round(0.729 * t0.v + 0.081 * t1.v + 0.09 * t2.v + 0.1 * t3.v, 9) AS average FROM t0 JOIN t1 USING (isoform_id) JOIN t2 USING (isoform_id) JOIN t3 USING (isoform_id)")
def eg_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = small_fit(spark, sf_dir, "exp_grad", 3)
    return vector(spark, list(range(len(out.average))), out.average, "average", 9)


@query(f"WITH {EG}, c AS (SELECT isoform_id, v * exp(0.5::DOUBLE * g) AS e FROM g0) SELECT isoform_id, round(e / sum(e) OVER (), 9) AS theta FROM c")
def eg_constant_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = small_fit(spark, sf_dir, "exp_grad", 1, lrs=0.5)
    return vector(spark, list(range(len(out.x))), out.x, "theta", 9)


def search_sql(armijo: bool, steps: int = 2) -> str:
    """SQL of a line search: every one of 20 tries is evaluated, and the first that exceeds its bound is taken."""
    out = SMALL + ", " + evaluation("0", "t0") + ", a0 AS (SELECT 0.5::DOUBLE ** 0.5 / max(abs(g)) AS a FROM g0)"
    for i in range(1, steps + 1):
        bound = "fo + 0.9 * slope" if armijo else "fo + slope - kl / a"
        out += f""", e{i} AS (SELECT k, a, isoform_id, v AS old, g, v * exp(a * (g - max(g) OVER (PARTITION BY k))) AS e FROM (SELECT k, (SELECT a FROM a{i - 1}) * 1.2 * 0.9::DOUBLE ** k AS a FROM range(1, 21) r(k)), g{i - 1}),
c{i} AS MATERIALIZED (SELECT k, a, isoform_id, old, g, e / sum(e) OVER (PARTITION BY k) AS v FROM e{i}),
mm{i} AS (SELECT k, kmer_id, any_value(y) AS y, sum(p * v) AS s FROM o JOIN c{i} USING (isoform_id) GROUP BY k, kmer_id),
ff{i} AS (SELECT k, sum(y * ln(s)) / any_value(total) AS f FROM mm{i}, w GROUP BY k),
q{i} AS (SELECT k, any_value(a) AS a, sum(g * (v - old)) AS slope, coalesce(sum(v * ln(v / old)) FILTER (old > 0 AND v > 0), 0) AS kl, (SELECT f FROM f{i - 1}) AS fo FROM c{i} GROUP BY k),
p{i} AS MATERIALIZED (SELECT coalesce(min(k) FILTER (f > {bound}), 20) AS k FROM q{i} JOIN ff{i} USING (k)),
a{i} AS MATERIALIZED (SELECT a FROM q{i} JOIN p{i} USING (k)),
t{i} AS MATERIALIZED (SELECT isoform_id, v FROM c{i} JOIN p{i} USING (k)), {evaluation(str(i), f"t{i}")}"""
    return f"WITH {out} {snapshots_sql(steps)}"


def searched(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    """The iterates of two steps with a line search."""
    out = small_fit(spark, sf_dir, "exp_grad", 2, lrs=rule)
    return as_snapshots(spark, out).distinct()


@query(search_sql(True))
def eg_armijo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark, sf_dir, "armijo")


@query(search_sql(False))
def eg_divergence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark, sf_dir, "warmstart")


#: Isoforms without abundance have no entries here either, so that no k-mer is left without any.
SOME = SMALL.replace("JOIN y USING (kmer_id))", "JOIN y USING (kmer_id) WHERE isoform_id % 5 <> 4)")
TILTED = f"{SOME}, tt AS MATERIALIZED (SELECT isoform_id, CASE WHEN isoform_id % 5 = 4 THEN 0 ELSE isoform_id + 1.0::DOUBLE END / sum(CASE WHEN isoform_id % 5 = 4 THEN 0 ELSE isoform_id + 1.0::DOUBLE END) OVER () AS v FROM b), {evaluation('t', 'tt')}"


@query(f"""WITH {TILTED}, u AS (SELECT isoform_id, v, g, length, v / length AS r, sum(v / length) OVER () AS whole FROM gt JOIN b USING (isoform_id)),
f AS (SELECT (SELECT f FROM ft) - 0.6::DOUBLE * (sum(ln(r)) FILTER (v > 0) - ln(any_value(whole))) AS f FROM u)
SELECT isoform_id, round(CASE WHEN v > 0 THEN g - 0.6::DOUBLE / v + 0.6::DOUBLE / (length * whole) ELSE g END, 6) AS g, round(f, 9) AS f FROM u, f""")
def simplex_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """beta 0.4, some abundances 0, so that prior terms leave those out."""
    x, y, size = small_parts(spark, sf_dir)
    model = SimplexModel(x.where("isoform_id % 5 <> 4"), y, size, 0.4)
    i = np.arange(model.size)
    theta = np.where(i % 5 == 4, 0.0, i + 1.0)
    f, g = model.objective_and_gradient(theta / theta.sum())
    model.close()
    return vector(spark, list(range(model.size)), g, "g", 6).withColumn("f", F.lit(round(f, 9)))


@query(f"""WITH {SMALL}, al AS (SELECT isoform_id, ((isoform_id * 7) % 11)::DOUBLE / 10 AS a FROM b), ts AS MATERIALIZED (SELECT isoform_id, exp(a) / sum(exp(a)) OVER () AS v FROM al), {evaluation("s", "ts")},
f AS (SELECT (SELECT f FROM fs) * (SELECT total FROM w) - sum(a * a) / 18 AS f FROM al)
SELECT isoform_id, round((g - 1) * v * (SELECT total FROM w) - a / 9, 5) AS g, round((SELECT f FROM f), 4) AS f FROM gs JOIN al USING (isoform_id)""")
def softmax_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, size = small_parts(spark, sf_dir)
    model = SoftmaxModel(x, y, len(size))
    f, g = model.objective_and_gradient(np.arange(len(size)) * 7 % 11 / 10)
    model.close()
    return vector(spark, list(range(len(size))), g, "g", 5).withColumn("f", F.lit(round(f, 4)))


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS isoform_id, 0.0::DOUBLE AS gradient, true AS on_simplex FROM benchmark")
def softmax_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the optimum the gradient vanishes, so that its tenths of a thousandth of all counts are 0."""
    model = small_model(spark, sf_dir, ModelSettings(model_type="softmax", beta=1 / 18))
    out = solvers.fit(model, iterations=60, start=np.zeros(model.size))
    model.close()
    share = np.abs(np.round(out.gradient / model.data.total, 4))
    return vector(spark, list(range(model.size)), share, "gradient", 4).withColumn("on_simplex", F.lit(bool(abs(out.x.sum() - 1) < 1e-9 and (out.x > 0).all())))


@query(f"WITH {SMALL}, v AS (SELECT isoform_id, coalesce(sum(p * y), 0) AS v FROM b LEFT JOIN o USING (isoform_id) GROUP BY isoform_id) SELECT isoform_id, round(v / sum(v) OVER (), 9) AS theta FROM v")
def counts_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = small_model(spark, sf_dir)
    theta = model.start("Xy")
    model.close()
    return vector(spark, list(range(model.size)), theta, "theta", 9)


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS isoform_id, 0.0::DOUBLE AS residual, true AS positive FROM benchmark")
def least_squares_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X'(y - X theta) is 0 at the least squares solution; the start made of it is positive and sums to 1."""
    model = small_model(spark, sf_dir)
    solved = solvers.lsqr(model.data)
    start, pull = model.positive(solved), model.data.counts_pull()
    residual = np.abs(np.round((pull - model.data.normal(solved)) / (np.abs(pull).max(initial=0) or 1.0), 6))
    model.close()
    return vector(spark, list(range(model.size)), residual, "residual", 6).withColumn("positive", F.lit(bool((start > 0).all() and abs(start.sum() - 1) < 1e-9)))


@query(f"WITH {SMALL} SELECT sum(y)::BIGINT AS counted, (SELECT total FROM w)::BIGINT AS covered, round(1 - (SELECT total FROM w) / sum(y), 9) AS dropped FROM y")
def covered_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = small_model(spark, sf_dir)
    model.close()
    every = round(model.data.total / (1 - model.data.dropped))
    return spark.createDataFrame([(every, round(model.data.total), round(model.data.dropped, 9))], "counted bigint, covered bigint, dropped double")


@query(f"WITH {SMALL} SELECT 0::BIGINT AS x_outside, (SELECT count(*) FILTER (kmer_id >= 128) FROM y) AS y_outside, (SELECT count(DISTINCT isoform_id) FROM x WHERE isoform_id % 3 = 0) AS isoforms_without_length")
def shape_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of shapes that don't agree: doubled ids lie beyond the k-mers, and every third isoform has no length."""
    x, y, size = small_parts(spark, sf_dir)
    known = spark.range(len(size)).where("id % 3 <> 0").select(F.col("id").alias("isoform_id"))
    return matrix.shape_faults(x, y.withColumn("kmer_id", F.col("kmer_id") * 2), known, K)


@query("SELECT count(*) AS isoforms, 3000::BIGINT AS reads, 1.0::DOUBLE AS psi, 1.0::DOUBLE AS theta_true, 1.0::DOUBLE AS theta_sampled, 0::BIGINT AS wrong FROM documents WHERE length(text) >= 40 AND NOT contains(source, 'PREDICTED')")
def simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the truth's columns, and reads that aren't in the isoform that their header names."""
    records = isoforms(spark, sf_dir).select("isoform_id", F.concat(F.col("source"), F.lit("/"), F.col("isoform_id")).alias("header"), "sequence")
    made, truth = simulate(records, 3000, 40, 0.5)
    at = made.withColumn("id", F.element_at(F.split("header", "/"), -1).cast("bigint"))
    wrong = at.join(records.select(F.col("isoform_id").alias("id"), F.col("sequence").alias("whole")), "id").agg(F.count("*").alias("reads"), F.count_if(~F.contains("whole", "sequence") | (F.length("sequence") != 40)).alias("wrong"))
    sums = truth.agg(F.count("*").alias("isoforms"), *(F.round(F.sum(c), 9).alias(c) for c in ("psi", "theta_true", "theta_sampled")))
    return sums.withColumns({c: wrong.select(c).scalar() for c in ("reads", "wrong")})


@query("SELECT i AS isoform_id, true AS positive, 1.0::DOUBLE AS whole FROM range(500) r(i)")
def dirichlet_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw is positive, sums to 1, and is the same again for its seed."""
    drawn, again = dirichlet(500, 0.8, 5), dirichlet(500, 0.8, 5)
    rows = [(i, bool(v > 0 and v == w), round(float(drawn.sum()), 9)) for i, (v, w) in enumerate(zip(drawn, again, strict=True))]
    return spark.createDataFrame(rows, "isoform_id bigint, positive boolean, whole double")
