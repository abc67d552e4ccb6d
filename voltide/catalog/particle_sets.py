"""Queries over particle sets: every embedding is one set of 64 particles with deterministic draws, paired by id with
one event for the observation."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.catalog.registry import query, rounded, table
from voltide.catalog.returns import OFF5, _r, psi
from voltide.functions import columns as fn
from voltide.functions.config import FilterConfig, implied_offset, log_norm
from voltide.operators import particles as pt
from voltide.operators import stats

K = ["set_id"]
NORM5 = "(lgamma(3) - lgamma(2.5) - 0.5 * ln(pi() * 5))"


def _cl(x: str, lo: float = -15.0, hi: float = 5.0) -> str:
    return f"least(greatest({x}, {lo!r}), {hi!r})"


# base sets: parents (h_prev), prior means (m), predicted particles (h), draws (z, z2, u), one observation per set
SETS = f"""
b0 AS (SELECT v.vec_id AS set_id, v.label, v.embedding, CAST(-3.5 + 0.1 * v.label AS DOUBLE) AS mu, 0.05 * ln(greatest(e.value, 0.01)) AS y, 0.05 * ln(greatest(f.value, 0.01)) AS y_prev
  FROM embeddings v JOIN events e ON e.event_id = v.vec_id JOIN events f ON f.event_id = v.vec_id + 1),
b1 AS (SELECT set_id, label, mu, y, y_prev, CAST(range AS INT) AS i, 8 * CAST(embedding[range + 1] AS DOUBLE) AS z,
  8 * CAST(embedding[64 - range] AS DOUBLE) AS z2 FROM b0, range(64)),
b2 AS (SELECT *, mu + 0.5 * z AS h_prev, mu + 0.4 * z2 AS h_prev2, 1 / (1 + exp(-1.7 * z2)) AS u FROM b1),
b3 AS (SELECT *, mu + 0.98 * (h_prev - mu) + 0.01 * y_prev / (exp(h_prev / 2) + 1e-8) AS m FROM b2),
b4 AS (SELECT *, {_cl('m + 0.15 * z2')} AS h FROM b3),
b5 AS (SELECT *, y * y / (exp(h) + 1e-8) / 5 AS a FROM b4),
ps AS (SELECT *, {NORM5} - 0.5 * h - 3 * ln(1 + a) AS log_w,
  {_cl('-(h - m) / 0.0225 + 0.65 * (-0.5 + 3 * a / (1 + a) - 0.3)', -10.0, 10.0)} AS s,
  {_cl('3 * a / ((1 + a) * (1 + a)) + 1 / 0.0225', 0.1, 100.0)} AS c FROM b5)
"""


def base(spark, sf):
    v, e = table(spark, sf, "embeddings"), table(spark, sf, "events")
    now = e.select(F.col("event_id").alias("vec_id"), (0.05 * F.log(F.greatest(F.col("value"), F.lit(0.01)))).alias("y"))
    prev = e.select((F.col("event_id") - 1).alias("vec_id"), (0.05 * F.log(F.greatest(F.col("value"), F.lit(0.01)))).alias("y_prev"))
    # events of a set by a hash table of ids, so that no task sorts its share of all events; the joins after it have a row a set
    of_sets = lambda d: d.join(v.select("vec_id").hint("shuffle_hash"), "vec_id", "left_semi")
    b = v.join(of_sets(now), "vec_id").join(of_sets(prev), "vec_id").select(
        F.col("vec_id").alias("set_id"), "label", (F.lit(-3.5) + 0.1 * F.col("label")).alias("mu"), "y", "y_prev",
        F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("embedding") - 1).alias("i"), F.col("embedding").alias("a"),
                               F.reverse("embedding").alias("b"))).alias("x"))
    b = b.select("set_id", "label", "mu", "y", "y_prev", F.col("x.i").alias("i"), (8 * F.col("x.a").cast("double")).alias("z"),
                 (8 * F.col("x.b").cast("double")).alias("z2"))
    return b.withColumn("h_prev", F.col("mu") + 0.5 * F.col("z")).withColumn("h_prev2", F.col("mu") + 0.4 * F.col("z2")).withColumn(
        "u", fn.sigmoid(1.7 * F.col("z2")))


def sets(spark, sf):
    d = base(spark, sf).withColumn("m", pt.prior_mean("h_prev", "y_prev", 0.98, "mu", 0.01))
    d = d.withColumn("h", fn.clamp_h(F.col("m") + 0.15 * F.col("z2"))).withColumn("log_w", fn.t_logpdf("y", "h", 5.0, log_norm(5.0)))
    lik = pt.grad_lik_exact("y", "h", 5.0, 0.3)
    d = d.withColumn("s", pt.grad_combine(-(F.col("h") - F.col("m")) / 0.0225, lik, 0.65))
    return d.withColumn("c", pt.curvature("y", "h", 5.0, -1 / 0.0225))


@query("init_particles", f"WITH {SETS} SELECT set_id, i, {_r(_cl('mu + sqrt(0.0225 / (1 - 0.98 * 0.98 + 1e-6)) * z'), 'h')} FROM ps")
def init_particles(spark, sf):
    b = base(spark, sf)
    return rounded(b.select("set_id", "i", pt.init_h("mu", F.sqrt(fn.stationary_variance(0.98, 0.15)), "z").alias("h")))


@query("predict_ar1", f"WITH {SETS} SELECT set_id, i, {_r(_cl('m + 0.15 * z2'), 'h')}, {_r('h_prev')} FROM ps")
def predict_ar1(spark, sf):
    return rounded(base(spark, sf).select("set_id", "i", pt.predict_ar1("h_prev", "y_prev", "z2", 0.98, 0.15, "mu", 0.01).alias("h"), "h_prev"))


MIM = f"""{SETS}, mb AS (SELECT set_id, avg(h_prev) AS hb FROM ps GROUP BY 1),
mm AS (SELECT ps.*, hb, least(greatest((CASE WHEN h_prev > h_prev2 THEN 0.98 ELSE 0.93 END) + 0.02 * tanh(h_prev - hb), 0), 0.999) AS r,
  0.15 * (1 + 0.1 * abs(h_prev - hb)) * (CASE WHEN u < 0.25 THEN 9 ELSE 1 END) * z2 AS nz FROM ps JOIN mb USING (set_id)),
mi AS (SELECT *, mu + r * (h_prev - mu) + 0.01 * y_prev / (exp(h_prev / 2) + 1e-8) AS pm FROM mm)"""
MIM_ARGS = dict(gamma=0.01, jump_prob=0.25, jump_scale=9.0, d_rho=0.02, d_sigma=0.1)


def with_mean(spark, sf):
    b = base(spark, sf)
    return b.join(b.groupBy("set_id").agg(F.avg("h_prev").alias("h_bar")), "set_id")


@query("predict_mim", f"WITH {MIM} SELECT set_id, i, {_r(_cl('pm + nz'), 'h')} FROM mi")
def predict_mim(spark, sf):
    h = pt.predict_mim("h_prev", "h_prev2", "h_bar", "y_prev", "z2", "u", 0.98, 0.93, 0.15, "mu", **MIM_ARGS)
    return rounded(with_mean(spark, sf).select("set_id", "i", h.alias("h")))


@query("predict_guided", f"""
WITH {MIM}, g AS (SELECT *, greatest(ln(y * y + 1e-10) + {OFF5}, -5.0) AS im FROM mi),
q AS (SELECT *, CASE WHEN (im - pm) / 2.5 > 0.1 THEN 0.4 * tanh((im - pm) / 2.5 - 0.1) ELSE 0 END AS al FROM g)
SELECT set_id, i, {_r(_cl('(1 - al) * pm + al * im + nz'), 'h')} FROM q""")
def predict_guided(spark, sf):
    h = pt.predict_guided("h_prev", "h_prev2", "h_bar", "y_prev", "y", "z2", "u", 0.98, 0.93, 0.15, "mu", implied_offset(5.0),
                          alpha_base=0.0, alpha_shock=0.4, threshold=0.1, **MIM_ARGS)
    return rounded(with_mean(spark, sf).select("set_id", "i", h.alias("h")))


@query("guide_moves", f"""
WITH {SETS}, b AS (SELECT set_id, avg(h_prev) AS hb FROM ps GROUP BY 1)
SELECT set_id, i, {_r(_cl('h + 0.05 * ((mu + 1) - h)'), 'contracted')}, {_r(_cl('0.95 * hb + 0.05 * (mu + 1) + h - hb'), 'preserved')} FROM ps JOIN b USING (set_id)""")
def guide_moves(spark, sf):
    p = sets(spark, sf)
    p = p.join(p.groupBy("set_id").agg(F.avg("h_prev").alias("h_bar")), "set_id")
    return rounded(p.select("set_id", "i", pt.guide_contract("h", F.col("mu") + 1, 0.05).alias("contracted"),
                            pt.guide_preserve("h", "h_bar", F.col("mu") + 1, 0.05).alias("preserved")))


@query("particle_summary", f"""
WITH {SETS}, t AS (SELECT set_id, max(log_w) AS top FROM ps GROUP BY 1), w AS (SELECT ps.*, top, exp(log_w - top) AS w FROM ps JOIN t USING (set_id))
SELECT set_id, {_r('avg(h)', 'h_mean')}, {_r('stddev_pop(h)', 'h_std')}, {_r('avg(exp(h / 2))', 'vol')}, {_r('stddev_pop(exp(h / 2))', 'vol_std')},
  {_r('max(top) + ln(greatest(avg(w), 1e-10))', 'loglik')}, {_r('sum(w) * sum(w) / (sum(w * w) + 1e-10)', 'ess')},
  {_r('sum(w) * sum(w) / (sum(w * w) + 1e-10) / count(*)', 'ess_ratio')} FROM w GROUP BY 1""")
def particle_summary(spark, sf):
    return rounded(pt.posterior_summary(sets(spark, sf), K).drop("n"))


@query("particle_moments", f"""
WITH {SETS} SELECT set_id, {_r('avg(h)', 'h_mean')}, {_r('stddev_pop(h)', 'h_std')} FROM ps GROUP BY 1""")
def particle_moments(spark, sf):
    return rounded(pt.particle_stats(sets(spark, sf), K))


@query("particle_outputs", f"""
WITH {SETS} SELECT set_id, {_r('avg(exp(h / 2))', 'vol')}, {_r('stddev_pop(exp(h / 2))', 'vol_std')}, {_r('avg(h)', 'h_mean')} FROM ps GROUP BY 1""")
def particle_outputs(spark, sf):
    return rounded(pt.particle_outputs(sets(spark, sf), K))


@query("log_evidence", f"""
WITH {SETS}, t AS (SELECT set_id, max(log_w) AS top FROM ps GROUP BY 1)
SELECT set_id, {_r('max(top) + ln(greatest(avg(exp(log_w - top)), 1e-10))', 'loglik')} FROM ps JOIN t USING (set_id) GROUP BY 1""")
def log_evidence(spark, sf):
    return rounded(pt.log_mean_exp(sets(spark, sf), K))


@query("effective_sample_size", f"""
WITH {SETS}, t AS (SELECT set_id, max(log_w) AS top FROM ps GROUP BY 1), w AS (SELECT set_id, exp(log_w - top) AS w FROM ps JOIN t USING (set_id))
SELECT set_id, {_r('sum(w) * sum(w) / (sum(w * w) + 1e-10)', 'ess')}, {_r('sum(w) * sum(w) / (sum(w * w) + 1e-10) / count(*)', 'ess_ratio')} FROM w GROUP BY 1""")
def effective_sample_size(spark, sf):
    return rounded(pt.ess(sets(spark, sf), K))


@query("interval_coverage", f"""
WITH {SETS}, r AS (SELECT set_id, label, y, mu, h, row_number() OVER (PARTITION BY set_id ORDER BY h, i) - 1 AS rk FROM ps),
q AS (SELECT set_id, max(label) AS label, max(mu + 10 * y) AS x, max(CASE WHEN rk = 16 THEN h END) AS l50, max(CASE WHEN rk = 48 THEN h END) AS h50,
  max(CASE WHEN rk = 3 THEN h END) AS l90, max(CASE WHEN rk = 60 THEN h END) AS h90, max(CASE WHEN rk = 1 THEN h END) AS l95, max(CASE WHEN rk = 62 THEN h END) AS h95 FROM r GROUP BY 1)
SELECT label, {_r('avg(CASE WHEN x BETWEEN l50 AND h50 THEN 1.0 ELSE 0.0 END)', 'coverage_50')}, {_r('avg(CASE WHEN x BETWEEN l90 AND h90 THEN 1.0 ELSE 0.0 END)', 'coverage_90')},
  {_r('avg(CASE WHEN x BETWEEN l95 AND h95 THEN 1.0 ELSE 0.0 END)', 'coverage_95')} FROM q GROUP BY 1""")
def interval_coverage(spark, sf):
    p = sets(spark, sf)
    truth = p.filter("i = 0").select("set_id", "label", (F.col("mu") + 10 * F.col("y")).alias("h_true"))
    return rounded(stats.coverage(p.select("set_id", "i", "h"), truth, K, ["label"]))


BADP = SETS + """,
bp AS (SELECT set_id, i, CASE WHEN set_id % 17 = 3 AND i = 5 THEN CAST('NaN' AS DOUBLE) WHEN set_id % 19 = 4 AND i = 6 THEN CAST('Infinity' AS DOUBLE)
  WHEN set_id % 23 = 7 THEN h + 9 ELSE h END AS h, CASE WHEN set_id % 29 = 1 THEN log_w * 40 ELSE log_w END AS log_w FROM ps),
tp AS (SELECT set_id, max(log_w) AS top FROM bp GROUP BY 1),
hw AS (SELECT bp.*, isnan(h) AS bad_n, NOT isnan(h) AND abs(h) = CAST('Infinity' AS DOUBLE) AS bad_i, exp(log_w - top) AS w FROM bp JOIN tp USING (set_id)),
hg AS (SELECT *, NOT bad_n AND NOT bad_i AS good FROM hw),
he AS (SELECT set_id, count(*) AS n, count(*) FILTER (bad_n) AS n_nan, count(*) FILTER (bad_i) AS n_inf, min(h) FILTER (good) AS h_min, max(h) FILTER (good) AS h_max,
  avg(h) FILTER (good) AS h_mean, sum(w) FILTER (good) AS sum_w, sum(w * w) FILTER (good) AS sum_w2 FROM hg GROUP BY 1)"""


def flawed_sets(spark, sf):
    p, s, i = sets(spark, sf), F.col("set_id"), F.col("i")
    h = (F.when((s % 17 == 3) & (i == 5), F.lit(float("nan"))).when((s % 19 == 4) & (i == 6), F.lit(float("inf")))
         .when(s % 23 == 7, F.col("h") + 9).otherwise(F.col("h")))
    return p.select("set_id", "i", h.alias("h"), F.when(s % 29 == 1, F.col("log_w") * 40).otherwise(F.col("log_w")).alias("log_w"))


@query("particle_health", f"""
WITH {BADP} SELECT set_id, n, n_nan, n_inf, {_r('h_min')}, {_r('h_max')}, {_r('h_mean')}, {_r('sum_w')}, {_r('sum_w2')} FROM he""")
def particle_health(spark, sf):
    return rounded(pt.particle_health(flawed_sets(spark, sf), K))


@query("health_status", f"""
WITH {BADP}, c AS (SELECT *, sum_w * sum_w / sum_w2 / n AS er, exp(h_mean / 2) AS v FROM he),
d AS (SELECT *, CASE WHEN n_nan > 0 THEN 200 WHEN n_inf > 0 THEN 203 WHEN sum_w <= 1e-10 THEN 211 WHEN v > 10 OR v < 1e-4 THEN 1001 WHEN er < 0.3 THEN 1000 ELSE 0 END AS st FROM c)
SELECT set_id, {_r('er', 'ess_ratio')}, {_r('v', 'vol_estimate')}, CAST(st AS INT) AS status, CASE st WHEN 200 THEN 'NAN_IN_PARTICLES' WHEN 203 THEN 'INF_IN_PARTICLES'
  WHEN 211 THEN 'WEIGHT_UNDERFLOW' WHEN 1001 THEN 'VOL_EXTREME' WHEN 1000 THEN 'ESS_LOW' ELSE 'OK' END AS status_name FROM d""")
def health_status(spark, sf):
    h = pt.health_status(pt.particle_health(flawed_sets(spark, sf), K))
    return rounded(h.select("set_id", "ess_ratio", "vol_estimate", "status", "status_name"))


@query("bandwidths", f"""
WITH {SETS}
SELECT set_id, {_r('var_pop(h)', 'var')}, {_r('max(h) - min(h)', 'spread')}, count(*) AS n, {_r('2 * var_pop(h) / ln(65)', 'bw_sq')},
  {_r('greatest(1.06 * sqrt(greatest(var_pop(h), 1e-8)) * pow(64, -0.2), 0.01)', 'bw_silverman')},
  {_r('greatest(0.01, least(2.0, sqrt(greatest(2 * var_pop(h) / ln(65), 1e-6))))', 'bw_simple')} FROM ps GROUP BY 1""")
def bandwidths(spark, sf):
    return rounded(pt.bandwidth_rules(sets(spark, sf), K))


@query("bandwidth_median", f"""
WITH {SETS}, d AS (SELECT a.set_id, abs(a.h - b.h) AS d FROM ps a JOIN ps b ON a.set_id = b.set_id),
r AS (SELECT set_id, d, row_number() OVER (PARTITION BY set_id ORDER BY d) - 1 AS rk FROM d),
q AS (SELECT set_id, max(CASE WHEN rk = 3072 THEN d END) AS d FROM r GROUP BY 1)
SELECT set_id, {_r(_cl(_cl('d', 0.01, 10.0) + ' / ln(65)', 0.01, 10.0), 'bandwidth')} FROM q""")
def bandwidth_median(spark, sf):
    return rounded(pt.bandwidth_median(sets(spark, sf), K))


PAIR = SETS + ", pr AS (SELECT a.set_id, a.i, a.h, a.s AS si, a.c AS ci, b.h AS hb, b.m AS mb, b.s AS sj, b.c AS cj, a.h - b.h AS d, a.h - b.m AS e FROM ps a JOIN ps b ON a.set_id = b.set_id)"


@query("grad_prior_gauss", f"""
WITH {PAIR}, t AS (SELECT set_id, i, max(-e * e / 0.045) AS top FROM pr GROUP BY 1, 2)
SELECT set_id, i, {_r('-sum(exp(-e * e / 0.045 - top) * e) / 0.0225 / (sum(exp(-e * e / 0.045 - top)) + 1e-8)', 'g_prior')}
FROM pr JOIN t USING (set_id, i) GROUP BY 1, 2""")
def grad_prior_gauss(spark, sf):
    p = sets(spark, sf).withColumn("sigma", F.lit(0.15))
    return rounded(pt.grad_prior_gauss(p, K).select("set_id", "i", "g_prior"))


@query("grad_prior_t", f"""
WITH {PAIR}, l AS (SELECT *, -3 * ln(1 + e * e / 0.1125) AS lr FROM pr), t AS (SELECT set_id, i, max(lr) AS top FROM l GROUP BY 1, 2),
w AS (SELECT l.*, exp(lr - top) AS r, 0.1125 + e * e AS den FROM l JOIN t USING (set_id, i))
SELECT set_id, i, {_r('-6 * sum(r * e / den) / (sum(r) + 1e-8)', 'g_prior')}, {_r('-6 * sum(r * (0.1125 - e * e) / (den * den)) / (sum(r) + 1e-8)', 'hess_prior')} FROM w GROUP BY 1, 2""")
def grad_prior_t(spark, sf):
    p = sets(spark, sf).withColumn("sigma", F.lit(0.15))
    return rounded(pt.grad_prior_t(p, K).select("set_id", "i", "g_prior", "hess_prior"))


@query("grad_likelihood", f"""
WITH {SETS}
SELECT set_id, i, {_r('-0.5 + 3 * a / (1 + a) - 0.3', 'g_exact')}, {_r('(ln(y * y + 1e-10) - h + 0.45) / 1.4', 'g_surrogate')}, {_r('s', 'g_combined')},
  {_r(_cl('-(h - m) / 0.0225 + (-0.5 + 3 * a / (1 + a) - 0.3)', -10.0, 10.0), 'g_fan')}, {_r('c', 'curv')}, {_r('0.7 * s / c', 'g_precond')}, {_r('log_w')} FROM ps""")
def grad_likelihood(spark, sf):
    p = sets(spark, sf)
    fan = pt.grad_combine(-(F.col("h") - F.col("m")) / 0.0225, pt.grad_lik_exact("y", "h", 5.0, 0.3), 0.65, True)
    return rounded(p.select("set_id", "i", pt.grad_lik_exact("y", "h", 5.0, 0.3).alias("g_exact"), pt.grad_lik_surrogate("y", "h", 0.45).alias("g_surrogate"),
                            F.col("s").alias("g_combined"), fan.alias("g_fan"), F.col("c").alias("curv"), pt.precondition("s", "c").alias("g_precond"), "log_w"))


# the sets with a per-set bandwidth, and all kernel sums per particle
STEIN = PAIR + f""",
bw AS (SELECT set_id, {_cl('sqrt(greatest(2 * var_pop(h) / ln(65), 1e-6))', 0.01, 2.0)} AS bw FROM ps GROUP BY 1),
kk AS (SELECT pr.*, 1 / (bw * bw) AS ib, d * d / (bw * bw) AS q, 1 / (1 + d * d / (bw * bw)) AS k FROM pr JOIN bw USING (set_id)),
sm AS (SELECT set_id, i, sum(k * sj) AS ks, sum(2 * d * ib * k * k) AS gs, sum(2 * d * ib * k * k / cj) AS gi, sum(k * 0.7 * sj / cj) AS kp, sum(k) AS kn,
  sum(cj * k + 2 * ib * k * k * abs(3 * q - 1)) AS hs,
  sum(k * si * sj + si * 2 * d * ib * k * k - sj * 2 * d * ib * k * k) AS ub, sum(2 * ib * k * k * (1 - 4 * q * k)) AS uc FROM kk GROUP BY 1, 2)"""


def stein_sets(spark, sf):
    p = sets(spark, sf).select("set_id", "i", "h", "z", F.col("s").alias("grad"), F.col("c").alias("curv"))
    return p.join(pt.bandwidth_simple(p, K, ["h"]).withColumnRenamed("bw_h", "bandwidth"), K)


@query("stein_plain", f"WITH {STEIN} SELECT set_id, i, {_r('(ks - gs) / 64', 'phi')}, {_r('ub + uc', 'ksd_part')} FROM sm")
def stein_plain(spark, sf):
    return rounded(pt.stein_phi(stein_sets(spark, sf), K).select("set_id", "i", "phi", "ksd_part"))


@query("stein_paper_sign", f"WITH {STEIN} SELECT set_id, i, {_r('(ks + gs) / 64', 'phi')}, {_r('ub - uc', 'ksd_part')} FROM sm")
def stein_paper_sign(spark, sf):
    return rounded(pt.stein_phi(stein_sets(spark, sf), K, paper_sign=True, compat=True).select("set_id", "i", "phi", "ksd_part"))


@query("stein_newton", f"WITH {STEIN} SELECT set_id, i, {_r('(kp - gi) / 64', 'phi')} FROM sm")
def stein_newton(spark, sf):
    return rounded(pt.stein_phi(stein_sets(spark, sf), K, "newton").select("set_id", "i", "phi"))


@query("stein_full_newton", f"WITH {STEIN} SELECT set_id, i, {_r('(ks - gs) / 64 / ' + _cl('hs / greatest(kn, 1e-6)', 0.1, 100.0) + ' * 0.7', 'phi')} FROM sm")
def stein_full_newton(spark, sf):
    return rounded(pt.stein_phi(stein_sets(spark, sf), K, "full_newton").select("set_id", "i", "phi"))


@query("ksd", f"""
WITH {STEIN} SELECT set_id, {_r('sqrt(greatest(sum(ub + uc) / 4096, 0))', 'ksd')}, {_r('sqrt(greatest(sum(ub - uc) / 4096, 0))', 'ksd_compat')} FROM sm GROUP BY 1""")
def ksd(spark, sf):
    p = stein_sets(spark, sf)
    return rounded(pt.ksd(pt.stein_phi(p, K, both_signs=True), K, {"ksd": "ksd_part", "ksd_compat": "ksd_part_other"}))


@query("stein_rbf", f"""
WITH {STEIN}, r AS (SELECT *, exp(-d * d * ib / 2) AS kr FROM kk)
SELECT set_id, i, {_r('(sum(kr * sj) + sum(kr * d * ib)) / 64', 'phi')}, {_r(_cl('max(h) + ' + _cl('0.1 * (sum(kr * sj) + sum(kr * d * ib)) / 64', -1.0, 1.0)), 'h')} FROM r GROUP BY 1, 2""")
def stein_rbf(spark, sf):
    p = pt.stein_phi(stein_sets(spark, sf), K, kernel="rbf")
    return rounded(p.select("set_id", "i", "phi", fn.clamp_h(F.col("h") + fn.clamp(0.1 * F.col("phi"), -1, 1)).alias("h")))


@query("stein_imq_half", f"""
WITH {STEIN}, r AS (SELECT kk.*, bw * bw + 1e-8 AS bs, 1 + d * d / (bw * bw + 1e-8) AS ba FROM kk JOIN bw USING (set_id))
SELECT set_id, i, {_r('(sum(sj / sqrt(ba)) - sum(d / (bs * ba * sqrt(ba)))) / 64', 'phi')} FROM r GROUP BY 1, 2""")
def stein_imq_half(spark, sf):
    return rounded(pt.stein_phi(stein_sets(spark, sf), K, kernel="imq_half").select("set_id", "i", "phi"))


@query("transport", f"""
WITH {STEIN}, x AS (SELECT ps.set_id, ps.i, ps.h, ps.z, (ks - gs) / 64 AS phi, abs(z2) / 10 AS v FROM sm JOIN ps USING (set_id, i)),
w AS (SELECT *, 0.9 * v + 0.1 * phi * phi AS v2 FROM x)
SELECT set_id, i, {_r('v2', 'v')}, {_r(_cl('h + 0.05 * sqrt(0.65) * phi / sqrt(v2 + 1e-6) + sqrt(2 * 0.05 * sqrt(0.65) * 0.45) * z'), 'h')} FROM w""")
def transport(spark, sf):
    p = pt.stein_phi(sets(spark, sf).select("set_id", "i", "h", "z", "z2", F.col("s").alias("grad"), F.col("c").alias("curv")).join(
        stein_sets(spark, sf).select("set_id", "i", "bandwidth"), ["set_id", "i"]), K)
    h, v = pt.transport("h", F.abs("z2") / 10, "phi", "z", 0.05, F.sqrt(F.lit(0.65)), 0.45)
    return rounded(p.select("set_id", "i", v.alias("v"), h.alias("h")))


@query("transport_heun", f"""
WITH {STEIN}, x AS (SELECT ps.set_id, ps.i, ps.h, ps.z, ps.m, ps.y, (ks - gs) / 64 AS phi, abs(z2) / 10 AS v FROM sm JOIN ps USING (set_id, i)),
pd AS (SELECT x.*, bw, {_cl('h + 0.05 * sqrt(0.65) * phi / sqrt(v + 1e-6)')} AS hp FROM x JOIN bw USING (set_id)),
p2 AS (SELECT *, y * y / (exp(hp) + 1e-8) / 5 AS a2 FROM pd),
p3 AS (SELECT *, {_cl('-(hp - m) / 0.0225 + 0.65 * (-0.5 + 3 * a2 / (1 + a2) - 0.3)', -10.0, 10.0)} AS s2 FROM p2),
f2 AS (SELECT a.set_id, a.i, sum(b.s2 / (1 + (a.hp - b.hp) * (a.hp - b.hp) / (a.bw * a.bw)) - 2 * (a.hp - b.hp) / (a.bw * a.bw) / pow(1 + (a.hp - b.hp) * (a.hp - b.hp) / (a.bw * a.bw), 2)) / 64 AS phi2
  FROM p3 a JOIN p3 b ON a.set_id = b.set_id GROUP BY 1, 2),
w AS (SELECT pd.*, (phi + phi2) / 2 AS fa, 0.9 * v + 0.1 * pow((phi + phi2) / 2, 2) AS v2 FROM pd JOIN f2 USING (set_id, i))
SELECT set_id, i, {_r('hp', 'h_pred')}, {_r('v2', 'v')}, {_r(_cl('h + 0.05 * sqrt(0.65) * fa / sqrt(v2 + 1e-6) + sqrt(2 * 0.05 * sqrt(0.65) * 0.45) * z'), 'h')} FROM w""")
def transport_heun(spark, sf):
    br = F.sqrt(F.lit(0.65))
    p = sets(spark, sf).select("set_id", "i", "h", "z", "z2", "m", "y", F.col("s").alias("grad"), F.col("c").alias("curv"))
    p = p.join(pt.bandwidth_simple(p, K, ["h"]).withColumnRenamed("bw_h", "bandwidth"), K)
    p = pt.stein_phi(p, K).withColumn("v0", F.abs("z2") / 10).withColumnRenamed("phi", "phi1").drop("ksd_part")
    p = p.withColumn("h0", F.col("h")).withColumn("h", pt.heun_predict("h0", "v0", "phi1", 0.05, br))
    p = p.withColumn("grad", pt.grad_combine(-(F.col("h") - F.col("m")) / 0.0225, pt.grad_lik_exact("y", "h", 5.0, 0.3), 0.65))
    p = pt.stein_phi(p, K)
    h, v = pt.heun_correct("h0", "v0", "phi1", "phi", "z", 0.05, br, 0.45)
    return rounded(p.select("set_id", "i", F.col("h").alias("h_pred"), v.alias("v"), h.alias("h")))


@query("rejuvenate", f"""
WITH {SETS} SELECT set_id, i, {_r(f"CASE WHEN u < 0.3 AND label > 2 THEN {_cl('0.7 * h + 0.3 * (mu + 0.5 + sqrt(0.04) * z)')} ELSE h END", 'h')} FROM ps""")
def rejuvenate(spark, sf):
    h = pt.rejuvenate("h", "u", "z", F.col("mu") + 0.5, 0.04, gate=F.col("label") > 2)
    return rounded(sets(spark, sf).select("set_id", "i", h.alias("h")))


@query("local_density", f"""
WITH {PAIR}, n AS (SELECT a.set_id, a.i, count(*) FILTER (a.i <> b.i AND abs(a.h - b.h) < 0.2) AS c FROM ps a JOIN ps b ON a.set_id = b.set_id GROUP BY 1, 2)
SELECT set_id, i, {_r('c / 63', 'density')} FROM n""")
def local_density(spark, sf):
    p = sets(spark, sf).select("set_id", "i", "h", F.lit(0.2).alias("bandwidth"))
    return rounded(pt.local_density(p, K).select("set_id", "i", "density"))


@query("knn_distance", f"""
WITH {SETS}, d AS (SELECT a.set_id, a.i, abs(a.h - b.h) AS d, row_number() OVER (PARTITION BY a.set_id, a.i ORDER BY abs(a.h - b.h)) AS rk
  FROM ps a JOIN ps b ON a.set_id = b.set_id AND a.i <> b.i)
SELECT set_id, i, {_r('d', 'knn')} FROM d WHERE rk = 5""")
def knn_distance(spark, sf):
    return rounded(pt.knn_distance(sets(spark, sf).select("set_id", "i", "h"), K, 5).select("set_id", "i", "knn"))


W = SETS + ", tw AS (SELECT set_id, max(log_w) AS top FROM ps GROUP BY 1), wt AS (SELECT ps.*, exp(log_w - top) AS w FROM ps JOIN tw USING (set_id))"


@query("nu_gradient", f"""
WITH {W}, g AS (SELECT *, (y / (exp(h / 2) + 1e-8)) * (y / (exp(h / 2) + 1e-8)) AS z3 FROM wt)
SELECT set_id, {_r(f'sum(w * 0.5 * ({psi(3.0) - psi(2.5) - 0.2!r} - ln(1 + z3 / 5) + 6 * z3 / (25 * (1 + z3 / 5)))) / (sum(w) + 1e-8)', 'nu_grad')},
  {_r('sum(w * z3) / (sum(w) + 1e-8)', 'z_sq')} FROM g GROUP BY 1""")
def nu_gradient(spark, sf):
    return rounded(pt.nu_gradient(sets(spark, sf).withColumn("nu", F.lit(5.0)), K))


@query("sigma_gradient", f"""
WITH {W}, g AS (SELECT *, pow(h - (mu + 0.98 * (h_prev - mu)), 2) / 0.01 AS r FROM wt)
SELECT set_id, {_r('sum(w * (r - 1) / 0.1) / (sum(w) + 1e-8)', 'sigma_grad')}, {_r('sum(w * r) / (sum(w) + 1e-8)', 'eps_sq_norm')} FROM g GROUP BY 1""")
def sigma_gradient(spark, sf):
    p = sets(spark, sf).withColumn("rho", F.lit(0.98)).withColumn("sigma", F.lit(0.1)).withColumn("h_pred", F.col("h"))
    return rounded(pt.sigma_gradient(p, K))


GV = 0.0225 / (1 - 0.98**2)
PP = 0.98**2 * GV + 0.0225
GAIN = PP / (PP + 6.93 + 1e-8)


@query("filter_tick_sets", f"""
WITH {SETS},
k0 AS (SELECT set_id, i, y, z, z2, h_prev, -3.5 + 0.98 * (h_prev + 3.5) + 0.01 * y_prev / (exp(h_prev / 2) + 1e-8) AS mm FROM ps),
k1 AS (SELECT *, {_cl('mm + 0.15 * z2')} AS hq, -3.5 + {GAIN!r} * (ln(y * y + 1e-8) + {OFF5} + 3.5) AS gm, avg(h_prev) OVER (PARTITION BY set_id) AS hb FROM k0),
k2 AS (SELECT *, {_cl('0.95 * hb + 0.05 * gm + hq - hb')} AS hg FROM k1),
kb AS (SELECT set_id, greatest(2 * var_pop(hg) / ln(65), 1e-6) AS raw, greatest(1.0, least((max(hg) - min(hg)) * 0.5, 2.0)) AS big FROM k2 GROUP BY 1),
kw AS (SELECT set_id, {_cl('sqrt(raw * greatest(0.5, least(1.0, 1 - 0.25 * least(big - 1, 2.0))))', 0.01, 2.0)} AS bw FROM kb),
kt AS (SELECT a.set_id, a.i, max(-(a.hg - b.mm) * (a.hg - b.mm) / 0.045) AS top FROM k2 a JOIN k2 b ON a.set_id = b.set_id GROUP BY 1, 2),
kg AS (SELECT a.set_id, a.i, -sum(exp(-(a.hg - b.mm) * (a.hg - b.mm) / 0.045 - top) * (a.hg - b.mm)) / 0.0225 / (sum(exp(-(a.hg - b.mm) * (a.hg - b.mm) / 0.045 - top)) + 1e-8) AS gp
  FROM k2 a JOIN k2 b ON a.set_id = b.set_id JOIN kt ON kt.set_id = a.set_id AND kt.i = a.i GROUP BY 1, 2),
k3 AS (SELECT k2.*, bw, gp, y * y / (exp(hg) + 1e-8) / 5 AS aa, y * y / (exp(hq) + 1e-8) / 5 AS aq FROM k2 JOIN kg USING (set_id, i) JOIN kw USING (set_id)),
k4 AS (SELECT *, {_cl('gp + (-0.5 + 3 * aa / (1 + aa) - 0.3)', -10.0, 10.0)} AS sc, {NORM5} - 0.5 * hg - 3 * ln(1 + aa) AS lf, {NORM5} - 0.5 * hq - 3 * ln(1 + aq) AS lp FROM k3),
k5 AS (SELECT a.set_id, a.i, a.sc AS si, b.sc AS sj, a.hg - b.hg AS d, 1 / (a.bw * a.bw) AS ib, 1 / (1 + (a.hg - b.hg) * (a.hg - b.hg) / (a.bw * a.bw)) AS k FROM k4 a JOIN k4 b ON a.set_id = b.set_id),
k6 AS (SELECT set_id, i, sum(k * sj - 2 * d * ib * k * k) / 64 AS phi, sum(k * si * sj + (si - sj) * 2 * d * ib * k * k + 2 * ib * k * k * (1 - 4 * d * d * ib * k)) AS u FROM k5 GROUP BY 1, 2),
k7 AS (SELECT k4.*, u, {_cl('hg + 0.05 * phi / sqrt(0.1 * phi * phi + 1e-6) + sqrt(2 * 0.05 * 0.45) * z')} AS hn, max(lf) OVER w AS tf, max(lp) OVER w AS tp
  FROM k4 JOIN k6 USING (set_id, i) WINDOW w AS (PARTITION BY set_id))
SELECT set_id AS series_id, {_r('avg(exp(hn / 2))', 'vol')}, {_r('stddev_pop(exp(hn / 2))', 'vol_std')}, {_r('avg(hn)', 'h_mean')}, {_r('max(bw)', 'bandwidth')},
  {_r('sqrt(greatest(sum(u) / 4096, 0))', 'ksd')}, {_r('max(tf) + ln(avg(exp(lf - tf)))', 'loglik_filtered')}, {_r('max(tp) + ln(avg(exp(lp - tp)))', 'loglik_predictive')},
  {_r('pow(sum(exp(lf - tf)), 2) / (sum(exp(2 * (lf - tf))) + 1e-10)', 'ess')}, {_r('max(gm)', 'guide_mean')} FROM k7 GROUP BY 1""")
def filter_tick_sets(spark, sf):
    """A whole filter tick (predict, guide, bandwidth, scores, Stein move, outputs) of every set."""
    from voltide.plans import cross_section

    cfg = FilterConfig("tick", mu=-3.5, rho=0.98, sigma_z=0.15, gamma=0.01, n_particles=64, mim=False, annealing=False, min_steps=1, max_steps=1,
                       exact_gradient=True, lik_offset=0.3, temperature=0.45)
    b = base(spark, sf).withColumnRenamed("set_id", "series_id")
    p = b.select("series_id", "i", F.col("h_prev").alias("h"), F.col("h_prev2").alias("h_prev"), F.lit(0.0).alias("v"), "z", "z2")
    s = b.groupBy("series_id").agg(
        F.lit(0).cast("long").alias("t"), F.avg("h_prev").alias("h_bar"), F.lit(-3.5).alias("g_mean"), F.lit(GV).alias("g_var"), F.lit(0.0).alias("ema"),
        F.lit(0.0).alias("bw_sq"), F.lit(0.05).alias("vol_prev"), F.lit(1e10).alias("ksd_prev"), F.max("y_prev").alias("y_prev"))
    y = b.groupBy("series_id").agg(F.max("y").alias("y"))
    draw = lambda role, stage=0, it=0, uniform=False: F.lit(0.5) if uniform else F.col("z2" if role == "state" else "z")
    est = cross_section.filter_tick(p, s, y, cfg, draw)[2]
    return rounded(est.select("series_id", "vol", "vol_std", "h_mean", "bandwidth", "ksd", "loglik_filtered", "loglik_predictive", "ess", "guide_mean"))


TWO = SETS + f""",
t0 AS (SELECT *, {_cl('0.15 / sqrt(1 - 0.81 + 1e-8) * z')} AS fp, {_cl('0.05 / sqrt(1 - 0.9801 + 1e-8) * z2')} AS sp FROM ps),
t1 AS (SELECT *, 0.9 * fp + 0.15 * z2 * (CASE WHEN u < 0.05 THEN 5 ELSE 1 END) AS f0, 0.99 * sp + 0.05 * z AS s0, ln(y * y + 1e-8) + {OFF5} AS im FROM t0),
t2 AS (SELECT *, CASE WHEN abs(im - (mu + fp + sp)) > 1.5 THEN least(0.1 + 0.4 * (abs(im - (mu + fp + sp)) - 1.5) / 1.5, 0.8) ELSE 0.1 END AS al FROM t1),
tf AS (SELECT *, {_cl('f0')} AS hf, {_cl('s0')} AS hs, {_cl('(1 - al) * f0 + al * (im - mu - s0)')} AS hg FROM t2),
tr AS (SELECT *, mu + hf + hs AS ht, y * y / (5 * exp(mu + hf + hs) + 1e-8) AS rt FROM tf)"""


def two_factor(spark, sf):
    d = sets(spark, sf)
    a = pt.init_two_factor("z", "z2", 0.9, 0.15, 0.99, 0.05)
    d = d.withColumn("fp", a["h_fast"]).withColumn("sp", a["h_slow"])
    c = pt.predict_two_factor("fp", "sp", "z2", "z", "u", 0.9, 0.15, 0.99, 0.05)
    return d.withColumn("h_fast", c["h_fast"]).withColumn("h_slow", c["h_slow"])


@query("two_factor_predict", f"WITH {TWO} SELECT set_id, i, {_r('fp', 'fast_init')}, {_r('sp', 'slow_init')}, {_r('hf', 'h_fast')}, {_r('hs', 'h_slow')}, {_r('hg', 'h_fast_guided')} FROM tf")
def two_factor_predict(spark, sf):
    d = two_factor(spark, sf)
    g = pt.predict_two_factor("fp", "sp", "z2", "z", "u", 0.9, 0.15, 0.99, 0.05, guided={
        "y": "y", "mu": "mu", "offset": implied_offset(5.0), "alpha_base": 0.1, "alpha_shock": 0.4, "threshold": 1.5})
    return rounded(d.select("set_id", "i", F.col("fp").alias("fast_init"), F.col("sp").alias("slow_init"), "h_fast", "h_slow", g["h_fast"].alias("h_fast_guided")))


@query("two_factor_gradient", f"""
WITH {TWO}, g AS (SELECT *, -0.5 + 3 * rt / (1 + rt + 1e-8) AS le, 0.5 * (ln(y * y + 1e-8) - ht) AS ls FROM tr)
SELECT set_id, i, {_r('-(hf - 0.9 * fp) / (0.0225 + 1e-8) + 0.5 * ((0.0225 + 1e-8) / (0.025 + 2e-8)) * le', 'g_fast')},
  {_r('-(hs - 0.99 * sp) / (0.0025 + 1e-8) + 0.5 * (1 - (0.0225 + 1e-8) / (0.025 + 2e-8)) * le', 'g_slow')}, {_r(f'{NORM5} - 0.5 * ht - 3 * ln(1 + rt)', 'log_w')},
  {_r('-(hf - 0.9 * fp) / (0.0225 + 1e-8) + 0.5 * ((0.0225 + 1e-8) / (0.025 + 2e-8)) * ls', 'g_fast_surrogate')} FROM g""")
def two_factor_gradient(spark, sf):
    d = two_factor(spark, sf)
    args = ("y", "mu", "h_fast", "h_slow", "fp", "sp", 0.9, 0.15, 0.99, 0.05, 0.5, 5.0, log_norm(5.0))
    g, s = pt.two_factor_gradient(*args), pt.two_factor_gradient(*args, exact=False)
    return rounded(d.select("set_id", "i", *[g[k].alias(k) for k in ("g_fast", "g_slow", "log_w")], s["g_fast"].alias("g_fast_surrogate")))


@query("two_factor_outputs", f"""
WITH {TWO}, l AS (SELECT *, {NORM5} - 0.5 * ht - 3 * ln(1 + rt) AS lw FROM tr), t AS (SELECT set_id, max(lw) AS top FROM l GROUP BY 1)
SELECT set_id, {_r('avg(hf)', 'fast_mean')}, {_r('avg(hs)', 'slow_mean')}, {_r('avg(ht)', 'h_mean')}, {_r('avg(exp(0.5 * ht))', 'vol')},
  {_r('max(top) + ln(greatest(avg(exp(lw - top)), 1e-10))', 'loglik')}, {_r(_cl('0.95 * avg(hf) + 0.05 * 0.3 + avg(hs) - avg(hf)'), 'guided_mean')},
  {_r(_cl('0.95 * avg(hs) + 0.05 * 0.3'), 'contracted_mean')} FROM l JOIN t USING (set_id) GROUP BY 1""")
def two_factor_outputs(spark, sf):
    d = two_factor(spark, sf)
    g = pt.two_factor_gradient("y", "mu", "h_fast", "h_slow", "fp", "sp", 0.9, 0.15, 0.99, 0.05, 0.5, 5.0, log_norm(5.0))
    out = pt.two_factor_outputs(d.drop("log_w").withColumn("log_w", g["log_w"]), K)
    return rounded(out.withColumn("guided_mean", pt.guide_two_factor("slow_mean", "fast_mean", 0.3, 0.05)).withColumn(
        "contracted_mean", pt.guide_two_factor("slow_mean", "fast_mean", 0.3, 0.05, preserving=False)))


JC = FilterConfig("joint", model="joint", nu=30.0, lik_offset=0.10)
NORM30 = "(lgamma(15.5) - lgamma(15) - 0.5 * ln(pi() * 30))"
SIG = lambda x: f"(1 / (1 + exp(-({x}))))"
JOINT = SETS + f""",
j0 AS (SELECT *, -3.5 + 0.5 * z AS h0, -3.5 + 0.2 * z2 AS m0, 2.0 + 0.2 * z AS r0, -2.0 + 0.2 * z2 AS s0 FROM ps),
j1 AS (SELECT *, {_cl('m0 + 0.005 * z', -10.0, 5.0)} AS mt, {_cl('r0 + 0.0005 * z2', -5.0, 5.0)} AS rt, {_cl('s0 + 0.002 * z', -5.0, 2.0)} AS st FROM j0),
j2 AS (SELECT *, {SIG('rt')} AS rr, greatest(exp(st), 0.01) AS sg FROM j1),
j3 AS (SELECT *, {_cl('mt + rr * (h0 - mt) + sg * z2')} AS hh, 3 * y AS yy FROM j2),
j4 AS (SELECT *, yy * yy / (exp(hh) + 1e-8) / 30 AS ja, yy * yy / (exp(h0) + 1e-8) AS zz, hh - (mt + rr * (h0 - mt)) AS df FROM j3),
j5 AS (SELECT *, CASE WHEN zz > 9 THEN greatest(mv, 1.0) ELSE mv END AS vm, CASE WHEN zz > 9 THEN 0.3 ELSE 1.0 END AS tw FROM
  (SELECT *, greatest(sg * sg * (1 + 0.3 * least(greatest(zz - 4, 0), 20)), 0.0009) AS mv FROM j4)),
jg AS (SELECT *, {_cl('(ln(yy * yy + 1e-10) - hh + 0.1) / 1.4 - tw * df / vm', -10.0, 10.0)} AS gh,
  {_cl('tw * df / vm * (1 - rr) - 0.05 * (mt + 3.5) / 10', -5.0, 5.0)} AS gm, {_cl('tw * df / vm * (h0 - mt) * rr * (1 - rr) - 0.05 * (rt - 2) / 5', -5.0, 5.0)} AS gr,
  greatest(-5.0, least(CASE WHEN zz > 9 THEN 10.0 ELSE 5.0 END, df * df / (sg * sg) - 1 + (CASE WHEN zz > 9 THEN least((zz - 9) * 0.5, 5.0) WHEN zz < 1.5 THEN -(1.5 - zz) ELSE 0 END)
    - 0.2 * (st + 2) - 0.05 * (st + 2) / 5)) AS gs, {NORM30} - 0.5 * hh - 15.5 * ln(1 + ja) AS lw FROM j5)"""


def joint(spark, sf):
    d = sets(spark, sf).select("set_id", "i", "z", "z2", (3 * F.col("y")).alias("y"))
    first = pt.joint_init({"h": "z", "mu_t": "z2", "rho_t": "z", "sigma_t": "z2"}, JC)
    d = d.select("*", *[v.alias(k) for k, v in first.items()]).withColumn("h_prev", F.col("h"))
    moved = pt.joint_predict({"h": "z2", "mu_t": "z", "rho_t": "z2", "sigma_t": "z"}, JC)
    d = d.select("set_id", "i", "y", "h_prev", *[v.alias(k) for k, v in moved.items()])
    return d.select("*", *[v.alias(k) for k, v in pt.joint_gradient("y", JC, log_norm(30.0)).items()])


@query("joint_predict", f"WITH {JOINT} SELECT set_id, i, {_r('hh', 'h')}, {_r('mt', 'mu_t')}, {_r('rt', 'rho_t')}, {_r('st', 'sigma_t')} FROM jg")
def joint_predict(spark, sf):
    return rounded(joint(spark, sf).select("set_id", "i", "h", "mu_t", "rho_t", "sigma_t"))


@query("joint_gradient", f"WITH {JOINT} SELECT set_id, i, {_r('gh', 'g_h')}, {_r('gm', 'g_mu_t')}, {_r('gr', 'g_rho_t')}, {_r('gs', 'g_sigma_t')}, {_r('lw', 'log_w')} FROM jg")
def joint_gradient(spark, sf):
    return rounded(joint(spark, sf).select("set_id", "i", "g_h", "g_mu_t", "g_rho_t", "g_sigma_t", "log_w"))


JBW = ", ".join(f"greatest(0.01, least(2.0, sqrt(greatest(2 * var_pop({c}) / ln(65), 1e-6)))) AS b{c}" for c in ("hh", "mt", "rt", "st"))


@query("joint_stein", f"""
WITH {JOINT}, jb AS (SELECT set_id, {JBW} FROM jg GROUP BY 1),
jp AS (SELECT a.set_id, a.i, b.hh - a.hh AS dh, b.mt - a.mt AS dm, b.rt - a.rt AS dr, b.st - a.st AS ds, b.gh, b.gm, b.gr, b.gs,
  1 / (bhh * bhh + 1e-8) AS ih, 1 / (bmt * bmt + 1e-8) AS im, 1 / (brt * brt + 1e-8) AS ir, 1 / (bst * bst + 1e-8) AS iss
  FROM jg a JOIN jg b ON a.set_id = b.set_id JOIN jb ON jb.set_id = a.set_id),
jk AS (SELECT *, 1 / (1 + dh * dh * ih + dm * dm * im + dr * dr * ir + ds * ds * iss) AS k FROM jp),
jf AS (SELECT set_id, i, sum(k * gh - 2 * dh * ih * k * k) AS fh, sum(k * gm - 2 * dm * im * k * k) AS fm, sum(k * gr - 2 * dr * ir * k * k) AS fr,
  sum(k * gs - 2 * ds * iss * k * k) AS fs, greatest(least(sum(k), 64), 32) AS nk FROM jk GROUP BY 1, 2)
SELECT jf.set_id, jf.i, {_r(_cl('hh + 0.15 * (CASE WHEN zz > 9 THEN 5 ELSE 1 END) * fh / nk'), 'h')}, {_r(_cl('mt + 0.005 * (CASE WHEN zz > 9 THEN 2 ELSE 1 END) * fm / nk', -10.0, 5.0), 'mu_t')},
  {_r(_cl('rt + 0.002 * fr / nk', -5.0, 5.0), 'rho_t')}, {_r(_cl('st + 0.03 * (CASE WHEN zz > 9 THEN 4 ELSE 1 END) * fs / nk', -5.0, 2.0), 'sigma_t')} FROM jf JOIN jg USING (set_id, i)""")
def joint_stein(spark, sf):
    p = joint(spark, sf)
    p = p.join(pt.bandwidth_simple(p, K, list(pt.JOINT)), K)
    return rounded(pt.joint_stein(p, K, "y", JC).select("set_id", "i", *pt.JOINT))


@query("joint_diagnostics", f"""
WITH {JOINT}, t AS (SELECT set_id, max(lw) AS top FROM jg GROUP BY 1), w AS (SELECT jg.*, top, exp(lw - top) AS w FROM jg JOIN t USING (set_id))
SELECT set_id, {_r('avg(hh)', 'h_mean')}, {_r('exp(avg(hh) / 2)', 'vol_mean')}, {_r('avg(mt)', 'mu_mean')}, {_r('avg(rr)', 'rho_mean')}, {_r('avg(exp(st))', 'sigma_mean')},
  {_r('stddev_pop(mt)', 'mu_std')}, {_r('stddev_pop(rr)', 'rho_std')}, {_r('stddev_pop(exp(st))', 'sigma_std')}, {_r('stddev_pop(mt)', 'std_mu_tilde')}, {_r('stddev_pop(rt)', 'std_rho_tilde')},
  {_r('stddev_pop(st)', 'std_sigma_tilde')}, stddev_pop(mt) < 0.05 AS mu_collapsed, stddev_pop(rt) < 0.02 AS rho_collapsed, stddev_pop(st) < 0.02 AS sigma_collapsed,
  {_r('sum(w) * sum(w) / (sum(w * w) + 1e-10)', 'ess')}, {_r('max(top) + ln(avg(w))', 'loglik')} FROM w GROUP BY 1""")
def joint_diagnostics(spark, sf):
    return rounded(pt.joint_diagnostics(joint(spark, sf), K, JC))
