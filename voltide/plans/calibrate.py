"""Parameter studies: score tables along a grid and Adam ascent steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.functions import columns as fn
from voltide.functions.config import FilterConfig
from voltide.plans.series_filter import filter_series, table_exists
from voltide.session import scratch_table

# The grids of the score sweeps.
NU_GRID = (3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 15.0, 20.0, 30.0)
SIGMA_GRID = (0.05, 0.08, 0.10, 0.12, 0.15, 0.18, 0.20, 0.25, 0.30, 0.40)


def direction(g: Column, threshold: float) -> Column:
    return F.when(g > threshold, "increase").when(g < -threshold, "decrease").otherwise("equilibrium")


def sweep_table(scores: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Direction and sign changes along the grid; a drop through zero gives the midpoint as equilibrium.

    ``scores`` has one row per key and grid value, so the window holds one short grid."""
    w = Window.partitionBy(*keys).orderBy("value")
    prev_g, prev_v = F.lag("mean_grad").over(w), F.lag("value").over(w)
    cross = F.when((prev_g > 0) & (F.col("mean_grad") < 0), (prev_v + F.col("value")) / 2)
    d = scores.withColumn("direction", direction(F.col("mean_grad"), threshold)).withColumn("crossing", cross)
    return d.withColumn("equilibrium", F.last("crossing", True).over(Window.partitionBy(*keys).orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)))


PARAMS = ("rho_u", "sigma_u", "mu")


def adam_start(theta: DataFrame) -> DataFrame:
    return theta.select("series_id", *PARAMS, *[F.lit(0.0).alias(f"{k}_{p}") for k in "mv" for p in PARAMS])


def adam_step(state: DataFrame, grad: DataFrame, step: int, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """One ascent step per series; updates are limited to +-0.5. ``step`` counts from 1."""
    d = state.join(grad, "series_id")
    cols = []
    for p in PARAMS:
        g = F.col(f"g_{p}")
        m, v = b1 * F.col(f"m_{p}") + (1 - b1) * g, b2 * F.col(f"v_{p}") + (1 - b2) * g * g
        move = lr * (m / (1 - b1**step)) / (F.sqrt(v / (1 - b2**step)) + eps)
        cols += [(F.col(p) + F.greatest(F.lit(-0.5), F.least(F.lit(0.5), move))).alias(p), m.alias(f"m_{p}"), v.alias(f"v_{p}")]
    return d.select("series_id", *cols)


def perturbed(theta: DataFrame, delta: float) -> DataFrame:
    """theta (series_id, rho_u, sigma_u, mu; unconstrained) as six configurations: each parameter moved up and down."""
    moves = F.array(*[F.struct(F.lit(f"{p}{sign}").alias("config_id"), *[F.lit(step * delta if q == p else 0.0).alias(f"d_{q}") for q in PARAMS])
                      for p in PARAMS for sign, step in (("+", 1), ("-", -1))])
    d = theta.select("series_id", *PARAMS, F.inline(moves))
    x = fn.constrain("sigmoid", F.col("rho_u") + F.col("d_rho_u"), F.col("sigma_u") + F.col("d_sigma_u"), F.col("mu") + F.col("d_mu"))
    return d.select("series_id", "config_id", x["rho"].alias("rho"), x["sigma"].alias("sigma_z"), x["mu"].alias("mu"))


def score_differences(obs: DataFrame, theta: DataFrame, cfg: FilterConfig, delta: float = 0.01, **run) -> DataFrame:
    """Central differences of the log-likelihood of every series by its unconstrained parameters: series_id, g_rho_u,
    g_sigma_u, g_mu, loglik (mean of the six runs). The six configurations are one run with the same draws. ``run``: the
    arguments of run_filter, and ``likelihood``, the estimate that is added up."""
    likelihood = run.pop("likelihood", "loglik_filtered")
    est = filter_series(obs, cfg, perturbed(theta, delta), **run)
    total = est.groupBy("series_id", "config_id").agg(F.sum(likelihood).alias("l"))
    at = lambda p, sign: F.sum(F.when(F.col("config_id") == f"{p}{sign}", F.col("l")))
    return total.groupBy("series_id").agg(*[((at(p, "+") - at(p, "-")) / (2 * delta)).alias(f"g_{p}") for p in PARAMS], F.avg("l").alias("loglik"))


def ascend(obs: DataFrame, theta: DataFrame, cfg: FilterConfig, epochs: int, lr: float = 0.01, delta: float = 0.01, settled: float = 0.0,
           path: str | None = None, **run) -> DataFrame:
    """Likelihood ascent over ``epochs``: series_id, rho_u, sigma_u, mu, the moments of the updates, loglik and epoch, the last
    one that moved the series. Draws of epoch e have seed 42 + e.

    Each epoch is one run for all series still moving and is written to ``path`` (a fresh folder of the shared one where
    None); with the path of a loop that was lost, this one goes on after its last whole epoch. A series whose parameters
    all move by less than ``settled`` stays as it is in later epochs."""
    spark = obs.sparkSession
    path = scratch_table(spark, "ascent") if path is None else path
    state = adam_start(theta).withColumns({"loglik": F.lit(None).cast("double"), "epoch": F.lit(0), "moving": F.lit(True)})
    schema = state.schema
    for e in range(epochs):
        at = f"{path}/epoch-{e}"
        if not table_exists(spark, at):
            moving = state.where("moving")
            grad = score_differences(obs.join(moving.select("series_id"), "series_id", "left_semi"), moving, cfg, delta, seed=42 + e, path=f"{path}/run-{e}", **run)
            new = adam_step(moving, grad, e + 1, lr).join(grad.select("series_id", "loglik"), "series_id")
            old = moving.select("series_id", *[F.col(p).alias(f"_{p}") for p in PARAMS])
            step = F.greatest(*[F.abs(F.col(p) - F.col(f"_{p}")) for p in PARAMS])
            new = new.join(old, "series_id").withColumns({"epoch": F.lit(e + 1), "moving": step >= settled})
            new.select(*schema.names).unionByName(state.where(~F.col("moving"))).write.mode("overwrite").parquet(at)
        state = spark.read.schema(schema).parquet(at)
    return state.drop("moving")
