"""Queries over the fitted landscapes: fit_cells as nodes, fit_edges as edges, all fits at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fellscape.functions.scalar import array_norm, clipped_exp, phase_of
from fellscape.operators import edges as E
from fellscape.operators import fixpoint as X
from fellscape.operators import nodeagg as N
from fellscape.operators import stats as S
from fellscape.operators import topology as T
from fellscape.plans.base import FITS, fit_edges, fit_ends, fit_nodes, rounded, rounded_sql
from fellscape.session import latest, table

QUERIES: dict = {}
ORACLE: dict = {}
BY = ["fit_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(rounded_sql(FITS, "edge_no; ~greatest(0, b_energy - a_energy) AS barrier", "FROM ft"))
def barrier_heights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(E.barrier_heights(fit_ends(spark, folder)).select("edge_no", "barrier"))


@query(rounded_sql(FITS, "edge_no; ~work * alignment AS drift; ~work * (1 - alignment) AS density_part; ~greatest(0, work * work) AS noise; ~exp(least(greatest(-work, -60), 60)) AS weight", "FROM fe", 5))
def edge_path_samples(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(E.path_samples(fit_edges(spark, folder)).select("edge_no", "drift", "density_part", "noise", "weight"), 5)


@query(rounded_sql(FITS, "edge_no; ~sign(c) * ln(1 + abs(c)) AS log_current", "FROM (SELECT edge_no, (exp(-least(greatest(b_energy - a_energy, -50), 50)) - exp(least(greatest(b_energy - a_energy, -50), 50))) * alignment AS c FROM ft)"))
def edge_current(spark: SparkSession, folder: str) -> DataFrame:
    """Current of every edge, the steepest included, as its signed logarithm."""
    c = F.col("current")
    return rounded(E.edge_current(fit_ends(spark, folder)).select("edge_no", (F.signum(c) * F.log1p(F.abs(c))).alias("log_current")))


@query(rounded_sql(FITS, "edge_no; ~CASE WHEN src = 1 OR dst = 1 THEN alignment * 0.25 ELSE alignment END AS alignment_cf", "FROM fe"))
def counterfactual_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment with the edges of node 1 damped."""
    return rounded(E.counterfactual_alignment(fit_edges(spark, folder), 1, 0.25).select("edge_no", "alignment_cf"))


@query(rounded_sql(FITS + ", s AS (SELECT fit_id, edge_no, (a_energy - b_energy) * (0.25 + greatest(0, alignment)) / (0.1 + dist) AS score FROM ft)",
    "fit_id; edge_no; ~score AS score; CASE WHEN score > 0 THEN 'downhill' ELSE 'control' END AS rationale", "FROM (SELECT *, row_number() OVER (PARTITION BY fit_id ORDER BY round(score, 9) DESC, edge_no) AS rn FROM s) WHERE rn <= 5"))
def intervention_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The five best steps of every fit."""
    w = Window.partitionBy("fit_id").orderBy(F.desc(F.round("score", 9)), "edge_no")
    s = E.intervention_scores(fit_ends(spark, folder))
    return rounded(s.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("fit_id", "edge_no", "score", "rationale"))


@query(rounded_sql(FITS, "e.fit_id; ~coalesce(avg(abs(e.work + r.work)), 0) AS gap; count(r.work) AS reversible", "FROM fe e LEFT JOIN fe r ON r.fit_id = e.fit_id AND r.src = e.dst AND r.dst = e.src GROUP BY e.fit_id"))
def reversibility_gap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(E.reversibility_gap(fit_edges(spark, folder), BY))


@query("""SELECT count(*) AS delivered, count(DISTINCT edge_no) AS edges, count(DISTINCT CASE WHEN isfinite(work) THEN edge_no END) AS finite,
 count(DISTINCT CASE WHEN isnan(work) OR work IS NULL OR isinf(work) THEN edge_no END) AS dropped FROM fit_edges""")
def finite_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with and without a finite work."""
    from fellscape.functions.scalar import finite

    e = table(spark, folder, "fit_edges")
    ok = F.coalesce(finite("work"), F.lit(False))
    return e.agg(F.count("*").alias("delivered"), F.count_distinct("edge_no").alias("edges"), F.count_distinct(F.when(ok, F.col("edge_no"))).alias("finite"), F.count_distinct(F.when(~ok, F.col("edge_no"))).alias("dropped"))


_FLUX = FITS + """, ms AS (SELECT fit_id, sum(density) AS mass FROM fn GROUP BY 1), pp AS (SELECT fit_id, idx, greatest(density / mass, 1e-15) AS p FROM fn JOIN ms USING (fit_id)),
dr AS (SELECT fit_id, least(src, dst) AS i, greatest(src, dst) AS j, avg(CASE WHEN src < dst THEN work END) AS f, avg(CASE WHEN src > dst THEN work END) AS b FROM fe WHERE src <> dst GROUP BY 1, 2, 3),
bo AS (SELECT fit_id, i, j, coalesce(f, -b) AS wf, coalesce(b, -f) AS wb FROM dr), wk AS (SELECT fit_id, wf AS w FROM bo UNION ALL SELECT fit_id, wb FROM bo),
md AS (SELECT fit_id, median(w) AS m FROM wk GROUP BY 1), sl AS (SELECT fit_id, greatest(1, 1.4826 * median(abs(w - m))) AS scale FROM wk JOIN md USING (fit_id) GROUP BY 1),
ra AS (SELECT bo.fit_id, i, j, x.p * greatest(1e-12, exp(-least(greatest(wf / scale, -30), 30))) AS forward, y.p * greatest(1e-12, exp(-least(greatest(wb / scale, -30), 30))) AS backward
 FROM bo JOIN sl USING (fit_id) JOIN pp x ON x.fit_id = bo.fit_id AND x.idx = i JOIN pp y ON y.fit_id = bo.fit_id AND y.idx = j),
fl AS (SELECT *, (forward - backward) * ln(greatest(forward / backward, 1e-12)) AS contribution FROM ra)"""


def _fluxes(spark: SparkSession, folder: str) -> DataFrame:
    return N.pair_fluxes(fit_edges(spark, folder), fit_nodes(spark, folder), BY)


@query(rounded_sql(_FLUX, "fit_id; i; j; ~forward AS forward; ~backward AS backward; ~contribution AS contribution", "FROM fl"))
def pair_flux(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_fluxes(spark, folder))


@query(rounded_sql(_FLUX, "fit_id; ~0.5 * sum(contribution) AS rate; count(*) AS pairs", "FROM fl GROUP BY fit_id"))
def entropy_production(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(N.entropy_production(_fluxes(spark, folder), BY))


@query(rounded_sql(_FLUX + """, en AS (SELECT fit_id, i AS idx, backward - forward AS x FROM fl UNION ALL SELECT fit_id, j, forward - backward FROM fl), ne AS (SELECT fit_id, idx, sum(x) AS x FROM en GROUP BY 1, 2),
sq AS (SELECT fit_id, sum(x * x) AS s FROM ne GROUP BY 1), ct AS (SELECT fit_id, count(*) AS n FROM fn GROUP BY 1)""", "fit_id; ~sqrt(coalesce(s, 0) / n) AS residual", "FROM ct LEFT JOIN sq USING (fit_id)", 8))  # fmt: skip
def stationarity_residual(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(N.stationarity_residual(_fluxes(spark, folder), fit_nodes(spark, folder), BY), 8)


_SPEED = FITS + """, nc AS (SELECT node_no AS idx, nullif(upper(trim(cell_id)), '') AS cell FROM (SELECT *, row_number() OVER (PARTITION BY node_no ORDER BY loaded_at DESC) AS rn FROM fit_cells) WHERE rn = 1),
cc AS (SELECT nullif(upper(trim(cell_id)), '') AS cell, vel FROM (SELECT *, row_number() OVER (PARTITION BY cell_no ORDER BY loaded_at DESC) AS rn FROM cells) WHERE rn = 1 AND deleted_at IS NULL),
sp AS (SELECT cell, sqrt(list_sum(list_transform(vel, lambda x: x * x))) AS speed FROM cc WHERE len(vel) = 24 AND len(list_filter(vel, lambda x: isfinite(x))) = 24)"""


@query(rounded_sql(_SPEED, "fit_id; label; count(*) AS size; ~avg(energy) AS energy_mean; ~coalesce(stddev_samp(energy), 0) AS energy_spread; ~avg(speed) AS velocity_mean",
    "FROM fn LEFT JOIN nc USING (idx) LEFT JOIN sp USING (cell) GROUP BY fit_id, label"))
def basin_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Size, energy and speed of every label of every fit; the speed is that of the nodes' cells with a complete velocity."""
    cell = F.nullif(F.upper(F.trim("cell_id")), F.lit("")).alias("cell")
    of = latest(table(spark, folder, "fit_cells"), "node_no", "loaded_at", ["cell_id"]).select(F.col("node_no").alias("idx"), cell)
    vel = latest(table(spark, folder, "cells"), "cell_no", "loaded_at", ["deleted_at", "cell_id", "vel"]).where("deleted_at is null").select(cell, "vel")
    whole = vel.where(F.expr("cell is not null and size(vel) = 24 and forall(vel, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"))
    nodes = fit_nodes(spark, folder).join(of, "idx", "left").join(whole.select("cell", array_norm("vel").alias("speed")), "cell", "left")
    return rounded(N.basin_statistics(nodes, [*BY, "label"], "energy", "speed"))


@query(rounded_sql(FITS, "fit_id; a_label AS from_basin; b_label AS to_basin; ~sum(exp(-greatest(0, work))) AS flux", "FROM ft WHERE a_label <> b_label GROUP BY ALL"))
def flux_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(N.flux_matrix(fit_ends(spark, folder), BY))


@query(rounded_sql(FITS, "fit_id; count(work) AS n; ~avg(work) AS mean_work; ~coalesce(var_samp(work), 0) AS var_work; ~min(work) AS min_work; ~max(work) AS max_work; "
    "~sum(exp(least(greatest(-work, -60), 60))) ** 2 / sum(exp(least(greatest(-work, -60), 60)) ** 2) AS ess; ~avg((work < 0)::INT) AS negative_share", "FROM fe GROUP BY fit_id"))  # fmt: skip
def work_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(N.work_summary(fit_edges(spark, folder), BY))


@query(rounded_sql(FITS + """, tp AS (SELECT fit_id, dst, max(-work) AS m FROM fe GROUP BY 1, 2),
ag AS (SELECT fit_id, dst AS idx, m, count(*) AS n, sum(exp(-work - m)) AS s, sum(exp(2 * (-work - m))) AS s2, avg(work) AS w, var_pop(work) AS v FROM fe JOIN tp USING (fit_id, dst) GROUP BY 1, 2, 3),
jz AS (SELECT fit_id, idx, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN energy ELSE -(m + ln(s / n)) END AS f, coalesce(w, 0) AS w, coalesce(v, 0) AS v, coalesce(s * s / s2, 0) AS ess FROM fn LEFT JOIN ag USING (fit_id, idx))""",
    "fit_id; idx; n; ~f AS free_energy; ~w AS work_mean; ~sqrt(v) AS work_spread; ~CASE WHEN n = 0 THEN 0 ELSE w - f END AS dissipation; ~CASE WHEN n = 0 THEN f ELSE w - v / 2 END AS cumulant; ~ess AS ess;"
    " CASE WHEN n = 0 THEN 'unsupported' WHEN ess / n >= 0.5 AND sqrt(v) <= 3 THEN 'stable' ELSE 'high_variance' END AS status", "FROM jz", 7))  # fmt: skip
def jarzynski_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Free energy of every node from the works of its incoming edges; nodes without one keep their energy."""
    return rounded(N.jarzynski_nodes(fit_nodes(spark, folder), fit_edges(spark, folder), BY), 7)


@query(rounded_sql(FITS, "fit_id; ~avg((b_energy <= a_energy)::INT) AS downhill; ~avg(alignment) AS alignment; ~avg(abs(work)) AS dissipation; ~sum(alignment) / greatest(count(*), 1) AS balance", "FROM ft GROUP BY fit_id"))
def landscape_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Downhill share, mean alignment and dissipation of every fit."""
    return rounded(fit_ends(spark, folder).groupBy("fit_id").agg(F.avg((F.col("b_energy") <= F.col("a_energy")).cast("double")).alias("downhill"), F.avg("alignment").alias("alignment"), F.avg(F.abs("work")).alias("dissipation"), (F.sum("alignment") / F.count("*")).alias("balance")))


_MIN = FITS + ", lm AS (SELECT fit_id, src AS idx, a_energy AS energy FROM ft GROUP BY 1, 2, 3 HAVING min(b_energy) >= a_energy)"


def _plain(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return fit_nodes(spark, folder), fit_edges(spark, folder)


@query(rounded_sql(_MIN, "fit_id; idx; ~energy AS energy", "FROM lm"))
def local_minima(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(T.local_minima(*_plain(spark, folder), BY))


@query(rounded_sql(_MIN, "fit_id; idx; ~energy AS energy", "FROM lm JOIN (SELECT fit_id, quantile_cont(energy, 0.5) AS q FROM lm GROUP BY 1) USING (fit_id) WHERE energy <= q"))
def attractors(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(T.attractors(*_plain(spark, folder), BY))


@query(rounded_sql(FITS + """, up AS (SELECT DISTINCT fit_id, src AS idx FROM ft WHERE b_energy < a_energy), rt AS (SELECT fit_id, energy, min(idx) AS root FROM fn ANTI JOIN up USING (fit_id, idx) GROUP BY 1, 2),
nr AS (SELECT n.fit_id, n.idx, root, row_number() OVER (PARTITION BY n.fit_id, n.idx ORDER BY abs(n.energy - r.energy), root) AS rn FROM fn n JOIN rt r ON r.fit_id = n.fit_id)""", "fit_id; idx; root", "FROM nr WHERE rn = 1"))  # fmt: skip
def watershed_basins(spark: SparkSession, folder: str) -> DataFrame:
    return T.watershed_basins(*_plain(spark, folder), BY)


@query(rounded_sql(FITS, "fit_id; src AS idx; CASE WHEN min(b_energy) >= a_energy THEN 'minimum' WHEN max(b_energy) <= a_energy THEN 'maximum' ELSE 'saddle' END AS kind", "FROM ft WHERE src <> dst GROUP BY fit_id, src, a_energy"))
def critical_points(spark: SparkSession, folder: str) -> DataFrame:
    return T.critical_points(*_plain(spark, folder), BY)


@query()
def persistence_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(T.persistence_pairs(*_plain(spark, folder), "fit_id"))


@query()
def cycle_summary(spark: SparkSession, folder: str) -> DataFrame:
    return T.cycle_summary(fit_edges(spark, folder), "fit_id")


@query()
def schnakenberg_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """The five largest cycles of every fit."""
    length = E.canonical_pairs(fit_edges(spark, folder), BY).join(
        fit_edges(spark, folder).where("src <> dst").groupBy("fit_id", F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg(F.min("dist").alias("distance")), [*BY, "i", "j"]
    )
    return rounded(T.schnakenberg(_fluxes(spark, folder).join(length, [*BY, "i", "j"]), "fit_id"))


@query()
def propagated_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Free energies propagated from the node of most out-edges of every fit."""
    e = fit_edges(spark, folder)
    deg = e.groupBy("fit_id", "src").agg(F.count("*").alias("n"))
    first = deg.groupBy("fit_id").agg(F.max_by("src", F.struct("n", -F.col("src"))).alias("idx"))
    return rounded(T.propagate_energy(first, e, "fit_id"))


@query(rounded_sql(FITS, "fit_id; edge_no; ~score AS score", "FROM (SELECT *, work + greatest(0, b_energy - a_energy) AS score, row_number() OVER (PARTITION BY fit_id ORDER BY work + greatest(0, b_energy - a_energy) DESC, edge_no) AS rn FROM ft) WHERE rn <= 10"))
def critical_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The ten edges of the greatest work plus barrier in every fit."""
    s = E.barrier_heights(fit_ends(spark, folder)).withColumn("score", F.col("work") + F.col("barrier"))
    w = Window.partitionBy("fit_id").orderBy(F.desc("score"), "edge_no")
    return rounded(s.withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("fit_id", "edge_no", "score"))


_SOFT = FITS + """, mx AS (SELECT fit_id, src, max(a_energy - b_energy) AS m FROM ft GROUP BY 1, 2), w1 AS (SELECT ft.*, exp(least(greatest(a_energy - b_energy - m, -60), 60)) AS w FROM ft JOIN mx USING (fit_id, src)),
tr AS (SELECT *, w / sum(w) OVER (PARTITION BY fit_id, src) AS p FROM w1)"""


def _chain(spark: SparkSession, folder: str) -> DataFrame:
    """Transition probabilities: softmax of the energy drops of each source's edges."""
    return X.softmax_edges(fit_ends(spark, folder).withColumn("score", F.col("a_energy") - F.col("b_energy")), "score", BY)


@query(rounded_sql(_SOFT, "edge_no; ~p AS p", "FROM tr"))
def transition_softmax(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_chain(spark, folder).select("edge_no", "p"))


@query(rounded_sql(_SOFT + ", ac AS (SELECT fit_id, edge_no, p, greatest(0, b_energy - a_energy) AS act FROM tr)",
    "fit_id; ~avg(act) AS mean_activation; ~avg(p) AS mean_probability; ~1 / greatest(sum(p * exp(-act)), 1e-12) AS escape_time", "FROM ac GROUP BY fit_id"))
def transition_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Mean activation and probability of steps, and an escape time, per fit."""
    met = E.barrier_heights(_chain(spark, folder))
    return rounded(met.groupBy("fit_id").agg(F.avg("barrier").alias("mean_activation"), F.avg("p").alias("mean_probability"), (1 / F.greatest(F.sum(F.col("p") * F.exp(-F.col("barrier"))), F.lit(1e-12))).alias("escape_time")))


# ---- fixed points: as many steps as the operators make at most, so that SQL makes the same

COMMITTOR, PASSAGE, PUSH, POWER = 256, 400, 80, 256
_ROLE = """, ro AS (SELECT fit_id, idx, CASE WHEN label = 'stem' THEN 'source' WHEN label = 'erythroid' THEN 'target' END AS role FROM fn),
cw AS (SELECT fit_id, src, dst, exp(least(greatest(-(b_energy - a_energy), -40), 40)) AS w FROM ft), cp AS (SELECT fit_id, src, dst, w / sum(w) OVER (PARTITION BY fit_id, src) AS p FROM cw)"""
_COMM = "RECURSIVE " + FITS + _ROLE + f""", ce AS (SELECT c.fit_id, src, dst, p FROM cp c JOIN ro ON ro.fit_id = c.fit_id AND ro.idx = c.src WHERE role IS NULL
 UNION ALL SELECT fit_id, idx, idx, 1.0 FROM ro WHERE role IS NOT NULL OR (fit_id, idx) NOT IN (SELECT fit_id, src FROM cp)),
cm(it, fit_id, idx, q) AS (SELECT 0, fit_id, idx, CASE role WHEN 'source' THEN 0.0::DOUBLE WHEN 'target' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END FROM ro
 UNION ALL SELECT any_value(it) + 1, e.fit_id, e.src, sum(e.p * q) FROM cm JOIN ce e ON e.fit_id = cm.fit_id AND e.dst = cm.idx WHERE it < {COMMITTOR} GROUP BY e.fit_id, e.src),
qq AS (SELECT fit_id, idx, q FROM cm WHERE it = {COMMITTOR})"""


def _committor(spark: SparkSession, folder: str) -> DataFrame:
    role = F.when(F.col("label") == "stem", "source").when(F.col("label") == "erythroid", "target")
    nodes = fit_nodes(spark, folder).select("fit_id", "idx", role.alias("role"))
    weight = clipped_exp(-(F.col("b_energy") - F.col("a_energy")), 40.0)
    return X.committor(nodes, fit_ends(spark, folder).withColumn("weight", weight), BY, COMMITTOR, None)


@query(rounded_sql(_COMM, "fit_id; idx; ~q AS q", "FROM qq"))
def committor(spark: SparkSession, folder: str) -> DataFrame:
    """Probability to reach erythroid before stem."""
    return rounded(_committor(spark, folder))


@query(rounded_sql(_COMM, "fit_id; CASE WHEN q < 0.2 THEN 'progenitor' WHEN q < 0.4 THEN 'early' WHEN q < 0.6 THEN 'transition state' WHEN q < 0.8 THEN 'late' ELSE 'committed' END AS phase; count(*) AS n", "FROM qq GROUP BY ALL"))
def commitment_phases(spark: SparkSession, folder: str) -> DataFrame:
    return _committor(spark, folder).groupBy("fit_id", phase_of("q").alias("phase")).agg(F.count("*").alias("n"))


@query(rounded_sql(_COMM, "fn.fit_id; label; count(*) AS n; ~avg(q) AS mean_q; ~coalesce(stddev_samp(q), 0) AS sd_q", "FROM qq JOIN fn USING (fit_id, idx) GROUP BY fn.fit_id, label"))
def commitment_profile(spark: SparkSession, folder: str) -> DataFrame:
    met = _committor(spark, folder).join(fit_nodes(spark, folder), ["fit_id", "idx"])
    return rounded(met.groupBy("fit_id", "label").agg(F.count("*").alias("n"), F.avg("q").alias("mean_q"), F.coalesce(F.stddev_samp("q"), F.lit(0.0)).alias("sd_q")))


@query(rounded_sql(_COMM, "ft.fit_id; ~ln(1 + sum(exp(least(greatest(-(b_energy - a_energy), -40), 40)) * greatest(0, y.q - x.q))) AS log_flux; count(*) FILTER (WHERE y.q > x.q + 1e-9) AS steps",
    "FROM ft JOIN qq x ON x.fit_id = ft.fit_id AND x.idx = src JOIN qq y ON y.fit_id = ft.fit_id AND y.idx = dst GROUP BY ft.fit_id", 5))
def reactive_flux(spark: SparkSession, folder: str) -> DataFrame:
    """Logarithm of the total reactive flux of every fit and its forward steps."""
    nodes = fit_nodes(spark, folder).join(_committor(spark, folder), ["fit_id", "idx"])
    fl = E.reactive_flux(E.with_ends(fit_edges(spark, folder), nodes, ["energy", "q"], BY))
    return rounded(fl.groupBy("fit_id").agg(F.log(1 + F.sum("flux")).alias("log_flux"), F.sum((F.col("b_q") > F.col("a_q") + 1e-9).cast("bigint")).alias("steps")), 5)


@query(rounded_sql(_COMM + """, dn AS (SELECT DISTINCT ft.fit_id, src, dst, y.q - x.q AS gain FROM ft JOIN qq x ON x.fit_id = ft.fit_id AND x.idx = src JOIN qq y ON y.fit_id = ft.fit_id AND y.idx = dst WHERE y.q > x.q + 1e-4)""",
    "fit_id; src; dst; rank", "FROM (SELECT *, row_number() OVER (PARTITION BY fit_id, src ORDER BY round(gain, 9) DESC, dst) AS rank FROM dn) WHERE rank <= 3"))
def downstream_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The three neighbours furthest ahead in commitment."""
    ends = E.with_ends(fit_edges(spark, folder).select("fit_id", "src", "dst").distinct(), fit_nodes(spark, folder).join(_committor(spark, folder), ["fit_id", "idx"]), ["q"], BY)
    w = Window.partitionBy("fit_id", "src").orderBy(F.desc(F.round(F.col("b_q") - F.col("a_q"), 9)), "dst")
    return ends.where("b_q > a_q + 1e-4").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("fit_id", "src", "dst", "rank")


@query(rounded_sql(_COMM + """, gr AS (SELECT fit_id, round(q * 1024) AS b, count(*) AS n FROM qq GROUP BY 1, 2), de AS (SELECT fit_id, at_, sum(n * (exp(-((at_ / 59.0 - b / 1024) ** 2) / (2 * 0.08 ** 2)) + exp(-((at_ / 59.0 + b / 1024) ** 2) / (2 * 0.08 ** 2))
 + exp(-((at_ / 59.0 - 2 + b / 1024) ** 2) / (2 * 0.08 ** 2)))) / sum(n) / (0.08 * 2.5066282746310002) AS density FROM gr CROSS JOIN range(60) t(at_) GROUP BY 1, 2)""",
    "fit_id; at_ AS at; ~density AS density; ~-ln(greatest(density, 1e-12)) - min(-ln(greatest(density, 1e-12))) OVER (PARTITION BY fit_id) AS free_energy".replace(" AS at;", ' AS "at";'), "FROM de", 5))
def pmf_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Free energy along the commitment probability."""
    return rounded(S.kde_profile(_committor(spark, folder), "q", BY), 5)


_ATT = """, at0 AS (SELECT fit_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY fit_id ORDER BY energy, idx) AS rn FROM fn) WHERE rn <= 3),
kk AS (SELECT fit_id, src, dst, exp(-least(greatest(work, -50), 50)) AS w FROM ft), kp AS (SELECT fit_id, src, dst, w / sum(w) OVER (PARTITION BY fit_id, src) AS p FROM kk)"""
_MFPT = "RECURSIVE " + FITS + _ATT + f""", nn AS (SELECT fit_id, count(*)::DOUBLE AS n FROM fn GROUP BY 1), fx AS (SELECT fit_id, idx, (fit_id, idx) IN (SELECT fit_id, idx FROM at0) AS att, (fit_id, idx) IN (SELECT fit_id, src FROM kp) AS moves FROM fn),
ke AS (SELECT k.fit_id, src, dst, p, 1.0::DOUBLE AS one FROM kp k JOIN fx ON fx.fit_id = k.fit_id AND fx.idx = k.src WHERE NOT att UNION ALL SELECT fit_id, idx, idx, 1.0, 0.0 FROM fx WHERE att OR NOT moves),
hm(it, fit_id, idx, h) AS (SELECT 0, fit_id, idx, CASE WHEN att THEN 0.0::DOUBLE ELSE n END FROM fx JOIN nn USING (fit_id)
 UNION ALL SELECT any_value(it) + 1, e.fit_id, e.src, any_value(e.one) + sum(e.p * h) FROM hm JOIN ke e ON e.fit_id = hm.fit_id AND e.dst = hm.idx WHERE it < {PASSAGE} GROUP BY e.fit_id, e.src)"""


def _lowest(spark: SparkSession, folder: str, n: int) -> DataFrame:
    w = Window.partitionBy("fit_id").orderBy("energy", "idx")
    return fit_nodes(spark, folder).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("fit_id", "idx")


@query(rounded_sql(_MFPT, "fit_id; idx; ~h AS h", f"FROM hm WHERE it = {PASSAGE}", 4))
def mean_first_passage(spark: SparkSession, folder: str) -> DataFrame:
    """Steps to the three lowest nodes."""
    nodes = fit_nodes(spark, folder).select("fit_id", "idx").join(_lowest(spark, folder, 3).withColumn("a", F.lit(True)), ["fit_id", "idx"], "left").select("fit_id", "idx", F.coalesce("a", F.lit(False)).alias("attractor"))
    return rounded(X.mean_first_passage(nodes, fit_ends(spark, folder), BY, 1.0, PASSAGE, None), 4)


def _pushed(steps: int) -> str:
    return "RECURSIVE " + FITS + _ATT + f""", pe AS (SELECT fit_id, src, dst, p FROM kp UNION ALL SELECT fit_id, idx, idx, 1.0 FROM fn WHERE (fit_id, idx) NOT IN (SELECT fit_id, src FROM kp)),
ct AS (SELECT fit_id, count(*) AS n FROM fn GROUP BY 1), z0 AS (SELECT fit_id, idx FROM fn),
pm(it, fit_id, idx, mass) AS (SELECT 0, fit_id, idx, 1.0::DOUBLE / n FROM fn JOIN ct USING (fit_id)
 UNION ALL SELECT any_value(it) + 1, e.fit_id, e.dst, sum(e.p * mass) FROM pm JOIN pe e ON e.fit_id = pm.fit_id AND e.src = pm.idx WHERE it < {steps} GROUP BY e.fit_id, e.dst),
fm AS (SELECT z.fit_id, z.idx, coalesce(mass, 0) AS mass FROM z0 z LEFT JOIN pm ON pm.fit_id = z.fit_id AND pm.idx = z.idx AND it = {steps})"""


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    ends = fit_ends(spark, folder).withColumn("w", F.exp(-F.least(F.greatest("work", F.lit(-50.0)), F.lit(50.0))))
    return X.row_normalized(ends, "w", BY)


def _uniform(spark: SparkSession, folder: str) -> DataFrame:
    nodes = fit_nodes(spark, folder)
    return nodes.join(nodes.groupBy("fit_id").agg(F.count("*").alias("n")), "fit_id").select("fit_id", "idx", (1.0 / F.col("n")).alias("mass"))


@query(rounded_sql(_pushed(PUSH), "fit_id; idx; ~mass AS mass", "FROM fm"))
def forecast_mass(spark: SparkSession, folder: str) -> DataFrame:
    """Mass of every node after 80 steps from the uniform distribution."""
    return rounded(X.push_mass(_uniform(spark, folder), _steps(spark, folder), BY, PUSH))


@query(rounded_sql(_pushed(POWER), "fit_id; idx; ~mass AS mass", "FROM fm"))
def spectral_stationary(spark: SparkSession, folder: str) -> DataFrame:
    """Power iteration with self loops at dead ends."""
    return rounded(X.stationary(fit_nodes(spark, folder), _steps(spark, folder), BY, POWER, None))


@query(rounded_sql(_pushed(POWER) + ", ph AS (SELECT fit_id, src AS idx, -sum(p * ln(p)) AS h FROM kp WHERE p > 0 GROUP BY 1, 2)", "fit_id; ~sum(mass * coalesce(h, 0)) AS entropy_rate; ~-sum(CASE WHEN mass > 0 THEN mass * ln(mass) ELSE 0 END) AS entropy", "FROM fm LEFT JOIN ph USING (fit_id, idx) GROUP BY fit_id"))
def chain_entropy(spark: SparkSession, folder: str) -> DataFrame:
    e = _steps(spark, folder)
    return rounded(X.spectrum_summary(X.stationary(fit_nodes(spark, folder), e, BY, POWER, None), e, BY))


_BF = "RECURSIVE " + FITS + """, be AS (SELECT fit_id, src, dst, min(greatest(0, work) + greatest(0, b_energy - a_energy)) AS c FROM ft GROUP BY 1, 2, 3),
bs AS (SELECT fit_id, min(idx) AS idx FROM fn GROUP BY 1), bf(it, fit_id, idx, cost) AS (SELECT 0, fit_id, idx, 0.0::DOUBLE FROM bs
 UNION ALL SELECT any_value(it) + 1, fit_id, idx, min(cost) FROM (SELECT b.it, e.fit_id, e.dst AS idx, b.cost + e.c AS cost FROM bf b JOIN be e ON e.fit_id = b.fit_id AND e.src = b.idx WHERE b.it < 64
   UNION ALL SELECT it, fit_id, idx, cost FROM bf WHERE it < 64) GROUP BY fit_id, idx)"""


@query()
def minimum_action(spark: SparkSession, folder: str) -> DataFrame:
    """Least action from the first node of every fit over non-negative edge costs."""
    e = E.barrier_heights(fit_ends(spark, folder)).withColumn("cost", F.greatest("work", F.lit(0.0)) + F.col("barrier"))
    start = fit_nodes(spark, folder).groupBy("fit_id").agg(F.min("idx").alias("idx"))
    return rounded(X.shortest_costs(start, e, BY).select("fit_id", "idx", "cost"))


ORACLE["minimum_action"] = rounded_sql(_BF, "fit_id; idx; ~cost AS cost", "FROM bf WHERE it = 64")


@query()
def minimum_action_path(spark: SparkSession, folder: str) -> DataFrame:
    """The path of least action from the first node of every fit to its three lowest ones."""
    e = E.barrier_heights(fit_ends(spark, folder)).withColumn("cost", F.greatest("work", F.lit(0.0)) + F.col("barrier"))
    start = fit_nodes(spark, folder).groupBy("fit_id").agg(F.min("idx").alias("idx"))
    ways = X.least_paths(X.shortest_costs(start, e, BY), _lowest(spark, folder, 3), BY)
    return rounded(ways.select("fit_id", "target", F.col("cost").alias("action"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.col("cost").isNotNull().alias("reachable")))


@query()
def multi_source_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Free energies propagated from a source of every component of every fit, with coverage."""
    return rounded(T.multi_source_energy(fit_edges(spark, folder), "fit_id"))


@query()
def components(spark: SparkSession, folder: str) -> DataFrame:
    """Weakly connected components of every fit's usable edges."""
    return X.weak_components(fit_edges(spark, folder), BY)


ORACLE["components"] = "WITH RECURSIVE " + FITS + """, tw AS (SELECT DISTINCT fit_id, src AS a, dst AS b FROM fe UNION SELECT fit_id, dst, src FROM fe),
lb(it, fit_id, node, c) AS (SELECT 0, fit_id, a, min(least(a, b)) FROM tw GROUP BY fit_id, a
 UNION ALL SELECT any_value(l.it) + 1, t.fit_id, t.a, least(min(l.c), min(m.c)) FROM lb l JOIN tw t ON t.fit_id = l.fit_id AND t.b = l.node JOIN lb m ON m.fit_id = t.fit_id AND m.node = t.a WHERE l.it < 60 GROUP BY t.fit_id, t.a)
SELECT fit_id, node AS idx, c AS component FROM lb WHERE it = 60"""


@query()
def greedy_walks(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy walks from the three lowest nodes: alignment less 0.15 of the climb."""
    e = fit_ends(spark, folder).withColumn("score", F.col("alignment") - 0.15 * (F.col("b_energy") - F.col("a_energy")))
    out = X.greedy_walk(_lowest(spark, folder, 3), e, BY, 8)
    return out.select("fit_id", "start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query()
def random_walks(spark: SparkSession, folder: str) -> DataFrame:
    """Visits of seeded random walks from the three lowest nodes."""
    w = X.random_walk(_lowest(spark, folder, 3), _chain(spark, folder), BY, 25)
    return w.groupBy("fit_id", "at").agg(F.count("*").alias("visits"))


@query(rounded_sql(FITS + ", pc AS (SELECT fit_id, quantile_cont(energy, 0.24) AS lo, quantile_cont(energy, 0.76) AS hi FROM fn GROUP BY 1)",
    "fit_id; CASE WHEN energy <= lo THEN 'deep' WHEN energy >= hi THEN 'ridge' ELSE 'corridor' END AS state; count(*) AS n", "FROM fn JOIN pc USING (fit_id) GROUP BY ALL"))
def state_classes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = fit_nodes(spark, folder)
    edge = nodes.groupBy("fit_id").agg(F.percentile("energy", F.array(F.lit(0.24), F.lit(0.76))).alias("p"))
    state = F.when(F.col("energy") <= F.col("p")[0], "deep").when(F.col("energy") >= F.col("p")[1], "ridge").otherwise("corridor")
    return nodes.join(edge, "fit_id").groupBy("fit_id", state.alias("state")).agg(F.count("*").alias("n"))


@query(rounded_sql(FITS, "fit_id; src AS idx; ~sum(work * alignment) AS leverage; ~avg(abs(work)) AS mean_change; rank",
    "FROM (SELECT fit_id, src, work, alignment, 0 AS rank FROM fe UNION ALL SELECT fit_id, dst, work, alignment, 0 FROM fe WHERE dst <> src) GROUP BY fit_id, src, rank"))
def counterfactual_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Effect of removing each node, from one pass over the edges it touches."""
    e = fit_edges(spark, folder)
    touch = F.array_distinct(F.array("src", "dst"))
    ends = e.select("fit_id", F.explode(touch).alias("idx"), "work", "alignment")
    return rounded(ends.groupBy("fit_id", "idx").agg(F.sum(F.col("work") * F.col("alignment")).alias("leverage"), F.avg(F.abs("work")).alias("mean_change"), F.lit(0).alias("rank")))


@query(rounded_sql(FITS + ", av AS (SELECT fit_id, label, avg(energy) AS e FROM fn WHERE label IS NOT NULL GROUP BY 1, 2)", "fit_id; label; ~exp(-e) / sum(exp(-e)) OVER (PARTITION BY fit_id) AS probability", "FROM av"))
def fate_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Softmax of minus the mean energy of each label."""
    m = fit_nodes(spark, folder).where("label is not null").groupBy("fit_id", "label").agg(F.avg("energy").alias("e"))
    return rounded(m.select("fit_id", "label", (F.exp(-F.col("e")) / F.sum(F.exp(-F.col("e"))).over(Window.partitionBy("fit_id"))).alias("probability")))


@query(rounded_sql(FITS + ", ao AS (SELECT fit_id, label, avg(energy) AS e, count(*) AS n FROM fn WHERE label IS NOT NULL GROUP BY 1, 2)",
    "fit_id; label; ~e AS mean_energy; row_number() OVER (PARTITION BY fit_id ORDER BY e, label) AS depth_order; ~e - min(e) OVER (PARTITION BY fit_id) AS barrier_kt; ~-sum(n * 1.0 / 1) OVER (PARTITION BY fit_id) AS minus_total", "FROM ao"))
def depth_order(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by depth with their height over the deepest."""
    m = fit_nodes(spark, folder).where("label is not null").groupBy("fit_id", "label").agg(F.avg("energy").alias("e"), F.count("*").alias("n"))
    w = Window.partitionBy("fit_id")
    return rounded(m.select("fit_id", "label", F.col("e").alias("mean_energy"), F.row_number().over(w.orderBy("e", "label")).alias("depth_order"), (F.col("e") - F.min("e").over(w)).alias("barrier_kt"), (-F.sum(F.col("n") * 1.0).over(w)).alias("minus_total")))


@query(rounded_sql(FITS + ", fc AS (SELECT fit_id, label, count(*) AS n FROM fn GROUP BY 1, 2)", "fit_id; ~ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy; sum(n)::BIGINT AS n", "FROM fc GROUP BY fit_id"))
def basin_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.entropy_of(fit_nodes(spark, folder), ["label"], BY))


@query(rounded_sql(FITS, "fit_id; src AS idx; count(*) AS steps; ~avg((b_energy > a_energy)::INT) AS uphill; ~min(b_energy - a_energy) AS lowest; ~max(b_energy - a_energy) AS highest", "FROM ft GROUP BY fit_id, src"))
def frontier(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("b_energy") - F.col("a_energy")
    return rounded(fit_ends(spark, folder).groupBy("fit_id", F.col("src").alias("idx")).agg(F.count("*").alias("steps"), F.avg((d > 0).cast("double")).alias("uphill"), F.min(d).alias("lowest"), F.max(d).alias("highest")))


@query(rounded_sql(FITS + """, bl AS (SELECT fit_id, label, min(energy) AS e FROM fn WHERE label IS NOT NULL GROUP BY 1, 2),
tm AS (SELECT a.fit_id, a.label AS from_label, b.label AS to_label, exp(-least(greatest(greatest(0, b.e - a.e), -40), 40)) AS w FROM bl a JOIN bl b ON a.fit_id = b.fit_id AND a.label <> b.label)""",
    "fit_id; from_label; to_label; ~w / sum(w) OVER (PARTITION BY fit_id, from_label) AS p", "FROM tm"))
def attractor_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Row-normalized Boltzmann factors between the deepest nodes of labels (a few rows per fit)."""
    low = fit_nodes(spark, folder).where("label is not null").groupBy("fit_id", "label").agg(F.min("energy").alias("e"))
    to = low.select("fit_id", F.col("label").alias("to_label"), F.col("e").alias("e2"))
    met = low.join(to, "fit_id").where("label <> to_label").withColumn("w", clipped_exp(-F.greatest(F.lit(0.0), F.col("e2") - F.col("e")), 40.0))
    return rounded(met.select("fit_id", F.col("label").alias("from_label"), "to_label", (F.col("w") / F.sum("w").over(Window.partitionBy("fit_id", "label"))).alias("p")))
