"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every Spark builder takes ``(spark, sf_dir)`` and reads the driver tables;
every oracle is plain SQL over the same tables (``fixtures.sql_ctes``).
"""
from __future__ import annotations

from typing import Callable, Dict, Optional, Tuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import curves as cv
from ..operators import folds as fo
from ..operators.grid import sql_grid_counts, sql_grid_value
from ..sources.corpus import corpus_profile
from ..functions.text import n_lines
from . import fixtures as fx
from . import oracle as oq
from . import pt as ptm
from . import reports as rp
from . import transfer as tr

Builder = Callable[[SparkSession, str], DataFrame]
CATALOG: Dict[str, Tuple[Builder, Optional[str]]] = {}
D = "::DOUBLE"


def register(name: str, sql: Optional[str]):
    def deco(fn: Builder) -> Builder:
        CATALOG[name] = (fn, sql)
        return fn
    return deco


RK = ["model", "seed", "fold"]
RKS = "model, seed, fold"
PT_SQL = ptm.sql_transfer_pt()
EV_PT_SQL = ptm.sql_transfer_pt(src="events_corpus")


def W(ctes: str, select: str) -> str:
    """Fixture CTEs + extra CTEs + final statement; a statement that starts
    with more CTE definitions (``_name AS (...)``) continues the list."""
    body = select.lstrip()
    if body.startswith("_"):
        select = ",\n" + body
    return fx.with_ctes(ctes, select)


# ------------------------------------------------------------ corpus (S, P)
@register("corpus_profile", W("", """
SELECT 'raw' AS stage, COUNT(*) AS n_rows, CAST(SUM(label) AS BIGINT) AS n_pos,
       COUNT(DISTINCT project) AS n_projects, 100.0::DOUBLE * SUM(label) / COUNT(*) AS pct_pos FROM corpus_raw
UNION ALL
SELECT 'prepared', COUNT(*), CAST(SUM(label) AS BIGINT), COUNT(DISTINCT project),
       100.0::DOUBLE * SUM(label) / COUNT(*) FROM corpus"""))
def q_corpus_profile(spark, d):
    raw = corpus_profile(fx.raw_corpus(spark, d)).withColumn("stage", F.lit("raw"))
    prep = corpus_profile(fx.corpus(spark, d)).withColumn("stage", F.lit("prepared"))
    return raw.unionByName(prep)


@register("corpus_prepared", W("", f"""
SELECT row_id, func, label, project, cwe, {fx.sql_nlines('func')} AS n_lines FROM corpus"""))
def q_corpus_prepared(spark, d):
    return fx.corpus(spark, d).withColumn("n_lines", n_lines(F.col("func")))


# ------------------------------------------------------------ folds (J)
@register("fold_assignment", W(oq.folds("corpus"), "SELECT seed, project, fold FROM folds"))
def q_fold_assignment(spark, d):
    c = fx.corpus(spark, d).select("project", "label")
    return fo.group_folds(c, 5, ptm.SEEDS)


@register("fold_profile", W(oq.folds("corpus"), f"""
, per AS (SELECT f.seed, f.fold, COUNT(*) AS n_test, COUNT(DISTINCT c.project) AS test_projects,
                 SUM(c.label) AS test_pos FROM corpus c JOIN folds f ON c.project = f.project
          GROUP BY f.seed, f.fold)
SELECT seed, fold, n_test, test_projects, test_pos{D} / n_test{D} AS test_pos_rate,
       SUM(n_test) OVER (PARTITION BY seed) - n_test AS n_train,
       SUM(test_projects) OVER (PARTITION BY seed) - test_projects AS train_projects FROM per"""
   .replace("\n, per AS", ",\nper AS", 1)))
def q_fold_profile(spark, d):
    c = fx.corpus(spark, d).select("project", "label")
    return fo.fold_profile(c, fo.group_folds(c, 5, ptm.SEEDS))


@register("leak_check", W(oq.folds("corpus"), """
SELECT f.seed, c.project, COUNT(DISTINCT f.fold) AS n_folds FROM corpus c JOIN folds f ON c.project = f.project
GROUP BY f.seed, c.project HAVING COUNT(DISTINCT f.fold) > 1"""))
def q_leak_check(spark, d):
    c = fx.corpus(spark, d).select("project", "label")
    return fo.leak_check(fo.assign_folds(c, fo.group_folds(c, 5, ptm.SEEDS)))


@register("fold_choice", W(oq.folds("corpus"), """
SELECT seed, max_by(fold, (n_projects, -fold)) AS fold, max(n_projects) AS n_projects
FROM (SELECT seed, fold, COUNT(*) AS n_projects FROM folds GROUP BY seed, fold) GROUP BY seed"""))
def q_fold_choice(spark, d):
    c = fx.corpus(spark, d).select("project", "label")
    return fo.fold_with_most_projects(fo.group_folds(c, 5, ptm.SEEDS))


@register("validation_sides", W(PT_SQL, "SELECT * FROM sides"))
def q_validation_sides(spark, d):
    return ptm.corpus_sides(spark, d)


# ------------------------------------------------------------ transfer
@register("threshold_transfer", W(PT_SQL + "," + oq.transfer_runs("pt"), "SELECT * FROM runs"))
def q_threshold_transfer(spark, d):
    return tr.threshold_transfer_runs(ptm.transfer_pt(spark, d).drop("logit0", "logit1"))


@register("per_project_report", W(EV_PT_SQL + "," + oq.transfer_runs("pt"), "SELECT * FROM per_project"))
def q_per_project(spark, d):
    p = ptm.events_transfer_pt(spark, d).drop("logit0", "logit1")
    curve = cv.pr_curve(p, RK + ["side"])
    return tr.per_project(p, tr.run_thresholds(curve, RK), RK)


@register("transfer_summary", W(PT_SQL + "," + oq.transfer_runs("pt"), f"""
SELECT model, round(avg(f1_gap), 9) AS mean_f1_gap, round(stddev_pop(f1_gap), 9) AS std_f1_gap,
  round(avg(thr_gap), 9) AS mean_thr_gap, round(avg(f1_source), 9) AS mean_f1_at_source,
  round(avg(per_project_f1_gap_mean), 9) AS mean_per_project_gap,
  round(avg(per_project_thr_std), 9) AS mean_per_project_thr_std, COUNT(*) AS n_runs,
  CASE WHEN round(avg(f1_gap), 9) > 0.05{D} THEN 'viable' WHEN round(avg(f1_gap), 9) > 0.02{D}
       THEN 'borderline' ELSE 'dead' END AS verdict
FROM runs GROUP BY model"""))
def q_transfer_summary(spark, d):
    runs = tr.threshold_transfer_runs(ptm.transfer_pt(spark, d).drop("logit0", "logit1"))
    return tr.transfer_summary(runs)


# ------------------------------------------------------------ metrics
@register("metrics_at_05", W(",".join([
    oq.score_table("_agg", "scored_events", ["model"]), oq.curve("_cur", "_agg", ["model"]),
    f"_th AS (SELECT DISTINCT model, 0.5{D} AS threshold FROM _agg)",
    oq.confusion("_m", "_agg", "_th", ["model"], extra=[]),
    oq.curve_summary("_s", "_cur", ["model"])]), """
SELECT m.model, m.threshold, m.tp, m.fp, m.fn, m.tn, m.precision, m.recall, m.f1, m.pred_pos_rate,
       m.base_pos_rate, m.collapsed, round(s.pr_auc, 9) AS pr_auc, s.roc_auc
FROM _m m LEFT JOIN _s s ON m.model = s.model"""))
def q_metrics_at_05(spark, d):
    m = cv.compute_metrics(fx.scored_events(spark, d), ["model"])
    return m.withColumn("pr_auc", F.round("pr_auc", 9))


@register("pr_curve", W(",".join([oq.score_table("_agg", "scored", ["model"]),
                                  oq.curve("_cur", "_agg", ["model"])]), """
SELECT model, score, pos, neg, tp, fp, n_pos, n_neg, precision, recall, f1 FROM _cur"""))
def q_pr_curve(spark, d):
    return cv.pr_curve(fx.scored(spark, d), ["model"])


@register("pr_curve_fine", W(",".join([oq.score_table("_agg", "scored_fine", ["model"]),
                                       oq.curve("_cur", "_agg", ["model"])]), """
SELECT model, score, pos, neg, tp, fp, n_pos, n_neg, precision, recall, f1 FROM _cur"""))
def q_pr_curve_fine(spark, d):
    """As many distinct scores as rows, summed in 64 buckets a model."""
    return cv.pr_curve(fx.scored_fine(spark, d), ["model"], n_buckets=64)


@register("thresholds", W(",".join([oq.score_table("_agg", "scored_events", ["model"]),
                                    oq.curve("_cur", "_agg", ["model"])]), f"""
SELECT a.model, a.thr_max_f1, b.thr_p30, c.thr_p50 FROM {oq.thr_max_f1('_cur', ['model'], 'thr_max_f1')} a
JOIN {oq.thr_at_precision('_cur', ['model'], 0.3, 'thr_p30')} b ON a.model = b.model
JOIN {oq.thr_at_precision('_cur', ['model'], 0.5, 'thr_p50')} c ON a.model = c.model"""))
def q_thresholds(spark, d):
    cur = cv.pr_curve(fx.scored_events(spark, d), ["model"])
    return (cv.threshold_max_f1(cur, ["model"], name="thr_max_f1")
            .join(cv.threshold_at_precision(cur, ["model"], 0.3, name="thr_p30"), "model")
            .join(cv.threshold_at_precision(cur, ["model"], 0.5, name="thr_p50"), "model"))


# ------------------------------------------------------------ cost (C)
def _cost_sql_ctes(src_pt: str = "pt") -> str:
    kk = RK
    ratios = "(VALUES (1), (5), (10), (25), (50), (100)) AS rr(fn_fp_ratio)"
    return ",".join([
        f"""_csel AS (SELECT seed, max_by(fold, (n_projects, -fold)) AS fold FROM
   (SELECT seed, fold, COUNT(DISTINCT project) AS n_projects FROM {src_pt}
    WHERE side = 'test' AND seed = 0 GROUP BY seed, fold) GROUP BY seed),
_cpt AS (SELECT p.* FROM {src_pt} p JOIN _csel s ON p.seed = s.seed AND p.fold = s.fold)""",
        oq.score_table("_cagg", "(SELECT * FROM _cpt WHERE side = 'test')", kk),
        oq.score_table("_cvagg", "(SELECT * FROM _cpt WHERE side = 'val')", kk),
        oq.curve("_cvcur", "_cvagg", kk),
        f"""_cf1 AS (SELECT {oq.k(kk, 'r')}, coalesce(t.threshold, 0.5{D}) AS threshold
   FROM (SELECT DISTINCT {RKS} FROM _cagg) r LEFT JOIN {oq.thr_max_f1('_cvcur', kk)} t ON {oq.on(kk, 'r', 't')})""",
        sql_grid_counts("_cg", "_cagg", kk, 0.0, 1.0, 500),
        f"""_cgr AS (SELECT g.*, rr.fn_fp_ratio,
   (CAST((g.n_pos - g.tp) * rr.fn_fp_ratio AS DOUBLE) + CAST(g.fp AS DOUBLE) * 1.0{D})
   / CAST(g.n_pos + g.n_neg AS DOUBLE) AS expected_cost FROM _cg g CROSS JOIN {ratios}),
_copt AS (SELECT {RKS}, fn_fp_ratio, min_by(threshold, (expected_cost, j)) AS optimal_threshold,
   min(expected_cost) AS min_expected_cost FROM _cgr GROUP BY {RKS}, fn_fp_ratio),
_cths AS (SELECT {RKS}, fn_fp_ratio, 'cost' AS kind, optimal_threshold AS threshold FROM _copt
   UNION ALL SELECT {oq.k(kk, 't')}, rr.fn_fp_ratio, 'f1' AS kind, t.threshold FROM _cf1 t CROSS JOIN {ratios})""",
        oq.confusion("_cm", "_cagg", "_cths", kk, extra=["fn_fp_ratio", "kind"]),
        f"""_cmc AS (SELECT *, (CAST(fn * fn_fp_ratio AS DOUBLE) + CAST(fp AS DOUBLE) * 1.0{D})
   / CAST(tp + fp + fn + tn AS DOUBLE) AS _cost FROM _cm),
_cw AS (SELECT {RKS}, fn_fp_ratio,
   max(CASE WHEN kind = 'f1' THEN _cost END) AS cost_at_f1_threshold,
   max(CASE WHEN kind = 'f1' THEN threshold END) AS f1_threshold,
   max(CASE WHEN kind = 'cost' THEN recall END) AS recall_at_cost_optimal,
   max(CASE WHEN kind = 'cost' THEN precision END) AS precision_at_cost_optimal,
   max(CASE WHEN kind = 'cost' THEN f1 END) AS f1_at_cost_optimal,
   max(CASE WHEN kind = 'f1' THEN recall END) AS recall_at_f1_optimal FROM _cmc GROUP BY {RKS}, fn_fp_ratio),
cost_table AS (SELECT o.*, w.cost_at_f1_threshold, w.f1_threshold, w.recall_at_cost_optimal,
   w.precision_at_cost_optimal, w.f1_at_cost_optimal, w.recall_at_f1_optimal,
   100.0{D} * (w.cost_at_f1_threshold - o.min_expected_cost) / greatest(o.min_expected_cost, 1e-9{D})
   AS cost_penalty_pct
   FROM _copt o JOIN _cw w ON {oq.on(kk + ['fn_fp_ratio'], 'o', 'w')})"""])


@register("cost_table", W(PT_SQL + "," + _cost_sql_ctes(), "SELECT * FROM cost_table"))
def q_cost_table(spark, d):
    return rp.cost_study(ptm.transfer_pt(spark, d))


@register("cost_ranking", W(PT_SQL + "," + _cost_sql_ctes(), f"""
SELECT {RKS}, fn_fp_ratio, min_expected_cost,
  ROW_NUMBER() OVER (PARTITION BY seed, fold, fn_fp_ratio ORDER BY min_expected_cost, model) AS rank
FROM cost_table"""))
def q_cost_ranking(spark, d):
    return rp.cost_ranking(ptm.transfer_pt(spark, d))


@register("cost_curves", W(PT_SQL + "," + _cost_sql_ctes() + "," + sql_grid_counts(
    "_cc", "_cagg", RK, 0.01, 0.99, 200), f"""
SELECT {oq.k(RK, 'g')}, rr.fn_fp_ratio, g.j, g.threshold,
  (CAST((g.n_pos - g.tp) * rr.fn_fp_ratio AS DOUBLE) + CAST(g.fp AS DOUBLE) * 1.0{D})
  / CAST(g.n_pos + g.n_neg AS DOUBLE) AS expected_cost
FROM _cc g CROSS JOIN (VALUES (10), (50)) AS rr(fn_fp_ratio)"""))
def q_cost_curves(spark, d):
    return rp.cost_curves(ptm.transfer_pt(spark, d))


@register("budget_recall", W(PT_SQL + "," + _cost_sql_ctes(), f"""
, _br AS (SELECT {RKS}, label, ROW_NUMBER() OVER (PARTITION BY {RKS} ORDER BY score DESC, row_id) AS pos_,
   SUM(label) OVER (PARTITION BY {RKS}) AS n_pos FROM _cpt WHERE side = 'test'),
_bb AS (SELECT DISTINCT {RKS}, n_pos FROM _br)
SELECT {oq.k(RK, 'b')}, bb.budget, CAST(coalesce(SUM(CASE WHEN r.pos_ <= bb.budget THEN r.label END), 0) AS BIGINT) AS found,
  CAST(b.n_pos AS BIGINT) AS n_pos,
  CASE WHEN b.n_pos = 0 THEN 0.0{D} ELSE CAST(coalesce(SUM(CASE WHEN r.pos_ <= bb.budget THEN r.label END), 0) AS DOUBLE) / b.n_pos{D} END AS budget_recall
FROM _bb b CROSS JOIN (VALUES (50), (100), (200), (500), (1000), (2000)) AS bb(budget)
JOIN _br r ON {oq.on(RK, 'b', 'r')}
GROUP BY {oq.k(RK, 'b')}, bb.budget, b.n_pos""".replace("\n, _br AS", ",\n_br AS", 1)))
def q_budget_recall(spark, d):
    return rp.budget_study(ptm.transfer_pt(spark, d))


# ------------------------------------------------------------ calibration
def _adaptive_sql() -> str:
    kk = RK
    base = oq.transfer_runs("pt", with_projects=False)
    gv = sql_grid_value("r.j", 0.01, 0.99, 1000)
    kinds = [("fixed_05", "0.5::DOUBLE"), ("source_calibrated", "thr_source"),
             ("ppr_adapted", "thr_ppr"), ("density_valley", "thr_valley"), ("oracle", "thr_oracle")]
    ths = "\n   UNION ALL ".join(f"SELECT {RKS}, '{n}' AS kind, {c} AS threshold FROM _at"
                                for n, c in kinds)
    piv = ", ".join(f"max(CASE WHEN kind = '{n}' THEN {c} END) AS {c}_{n}"
                    for n, _ in kinds for c in ["f1", "recall", "precision"])
    return ",".join([base, f"""
_atest AS (SELECT {RKS}, score, pos, neg FROM _tagg WHERE side = 'test')""",
        sql_grid_counts("_apg", "_atest", kk, 0.01, 0.99, 1000), f"""
_appr AS (SELECT {RKS}, CASE WHEN min(_d) < 1.0{D} THEN min_by(threshold, (_d, j)) ELSE 0.5{D} END AS thr_ppr
   FROM (SELECT *, abs(CAST(tp + fp AS DOUBLE) / CAST(n_pos + n_neg AS DOUBLE) - 0.057{D}) AS _d FROM _apg)
   GROUP BY {RKS}),
_vst AS (SELECT {RKS}, stddev_samp(score) AS _sd, COUNT(*) AS _n FROM pt WHERE side = 'test' GROUP BY {RKS}),
_vcn AS (SELECT {RKS}, round(score, 4) AS _s, COUNT(*) AS _c FROM pt WHERE side = 'test' GROUP BY {RKS}, round(score, 4)),
_vgr AS (SELECT CAST(r.j AS INTEGER) AS j, {gv} AS _x FROM range(0, 1000) r(j)),
_vden AS (SELECT {oq.k(kk, 'c')}, g.j, g._x,
   SUM(CAST(c._c AS DOUBLE) * exp(-0.5{D} * ((g._x - c._s) / (0.05{D} * s._sd)) * ((g._x - c._s) / (0.05{D} * s._sd)))) AS _dens
   FROM _vcn c JOIN _vst s ON {oq.on(kk, 'c', 's')} CROSS JOIN _vgr g
   WHERE g._x > 0.05{D} AND g._x < 0.95{D} GROUP BY {oq.k(kk, 'c')}, g.j, g._x),
_avl AS (SELECT {oq.k(kk, 's')}, CASE WHEN s._n >= 2 AND s._sd IS NOT NULL AND s._sd > 0 THEN v._t ELSE 0.5{D} END AS thr_valley
   FROM _vst s LEFT JOIN (SELECT {RKS}, min_by(_x, (_dens, j)) AS _t FROM _vden GROUP BY {RKS}) v
   ON {oq.on(kk, 's', 'v')}),
_at AS (SELECT {oq.k(kk, 't')}, t.thr_source, t.thr_oracle, p.thr_ppr, v.thr_valley FROM _tthr t
   JOIN _appr p ON {oq.on(kk, 't', 'p')} JOIN _avl v ON {oq.on(kk, 't', 'v')}),
_aths AS ({ths})""",
        oq.confusion("_am", "_atest", "_aths", kk), f"""
adaptive AS (SELECT a.*, w.* EXCLUDE ({RKS}) FROM _at a JOIN (SELECT {RKS}, {piv} FROM _am GROUP BY {RKS}) w
   ON {oq.on(kk, 'a', 'w')})"""])


_METHODS = rp.METHODS
_LONG_SQL = " UNION ALL ".join(f"SELECT {RKS}, '{m}' AS method, f1_{m} AS f1 FROM adaptive" for m in _METHODS)


@register("adaptive_thresholds", W(PT_SQL + "," + _adaptive_sql(), "SELECT * FROM adaptive"))
def q_adaptive(spark, d):
    return rp.adaptive_thresholds(ptm.transfer_pt(spark, d))


@register("method_summary", W(PT_SQL + "," + _adaptive_sql(), f"""
SELECT method, round(avg(f1), 9) AS mean_f1, round(stddev_pop(f1), 9) AS std_f1, min(f1) AS min_f1,
  max(f1) AS max_f1, COUNT(*) AS n FROM ({_LONG_SQL}) GROUP BY method"""))
def q_method_summary(spark, d):
    return rp.method_summary(rp.adaptive_thresholds(ptm.transfer_pt(spark, d)))


@register("gap_closed", W(PT_SQL + "," + _adaptive_sql(), f"""
SELECT l.method, round(avg(100.0{D} * (l.f1 - a.f1_source_calibrated) / (a.f1_oracle - a.f1_source_calibrated)), 9) AS mean_gap_closed_pct,
  round(stddev_pop(100.0{D} * (l.f1 - a.f1_source_calibrated) / (a.f1_oracle - a.f1_source_calibrated)), 9) AS std_gap_closed_pct,
  COUNT(*) AS n
FROM ({_LONG_SQL}) l JOIN adaptive a ON {oq.on(RK, 'l', 'a')}
WHERE l.method NOT IN ('source_calibrated', 'oracle') AND a.f1_oracle - a.f1_source_calibrated > 0.01{D}
GROUP BY l.method"""))
def q_gap_closed(spark, d):
    return rp.gap_closed(rp.adaptive_thresholds(ptm.transfer_pt(spark, d)))


def _temperature_sql() -> str:
    """CTE ``temps``: calibration draws, bisection on the derivative of the NLL, F1 of the rest."""
    kk = RK + ["cal_size"]
    keys = oq.k(kk)
    return ",".join([f"""
_tz AS (SELECT {RKS}, row_id, label, ln((score + 0.0005{D}) / (1.0005{D} - score)) AS margin, CAST(cal_size AS INTEGER) AS cal_size
   FROM pt CROSS JOIN (VALUES (20), (50), (100), (200)) s(cal_size) WHERE side = 'test'),
_tz2 AS (SELECT z.* FROM _tz z JOIN (SELECT {keys} FROM _tz GROUP BY {keys} HAVING COUNT(*) >= cal_size + 100) n
   ON {oq.on(kk, 'z', 'n')})""",
        oq.stratified_take("_tcal", "_tz2", kk, "cal_size", "seed + fold", "calibration", kk + ["row_id"]), f"""
_td AS (SELECT z.*, c.row_id IS NOT NULL AS cal FROM _tz2 z LEFT JOIN _tcal c ON {oq.on(kk + ['row_id'], 'z', 'c')}),
_tb AS (SELECT DISTINCT {keys}, 0 AS i, ln(0.1{D}) AS lo, ln(10.0{D}) AS hi FROM _td WHERE cal
  UNION ALL
  SELECT {keys}, i + 1, CASE WHEN g > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN g > 0 THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT {oq.k(kk, 'b')}, b.i, b.lo, b.hi,
          SUM((1.0{D} / (1.0{D} + exp(-d.margin * exp(-(b.lo + b.hi) / 2))) - d.label) * d.margin) AS g
        FROM _tb b JOIN _td d ON {oq.on(kk, 'b', 'd')} WHERE d.cal AND b.i < 48 GROUP BY {oq.k(kk, 'b')}, b.i, b.lo, b.hi)),
_tt AS (SELECT {keys}, round(exp((lo + hi) / 2), 6) AS T FROM _tb WHERE i = 48),
_ts AS (SELECT d.*, t.T, round(1.0{D} / (1.0{D} + exp(-d.margin / t.T)), 9) AS score FROM _td d JOIN _tt t ON {oq.on(kk, 'd', 't')})""",
        oq.score_table("_tca", "(SELECT * FROM _ts WHERE cal)", kk), oq.curve("_tcu", "_tca", kk),
        oq.score_table("_tea", "(SELECT * FROM _ts WHERE NOT cal)", kk),
        f"_tth2 AS {oq.thr_max_f1('_tcu', kk)}",
        oq.confusion("_tme", "_tea", "_tth2", kk, extra=[]), f"""
temps AS (SELECT {oq.k(kk, 'm')}, t.T, m.threshold, m.f1, m.recall, m.precision FROM _tme m JOIN _tt t ON {oq.on(kk, 'm', 't')})"""])


@register("temperature_scaling", W(EV_PT_SQL + "," + _temperature_sql(), "SELECT * FROM temps"))
def q_temperature(spark, d):
    return rp.temperature_study(ptm.events_transfer_pt(spark, d))


_FEW_SQL = f" UNION ALL SELECT {RKS}, 'temperature_k' || cal_size AS method, f1 FROM temps"
_EVENTS_ADAPTIVE = EV_PT_SQL + "," + _adaptive_sql() + "," + _temperature_sql()


@register("events_method_summary", W(_EVENTS_ADAPTIVE, f"""
SELECT method, round(avg(f1), 9) AS mean_f1, round(stddev_pop(f1), 9) AS std_f1, min(f1) AS min_f1,
  max(f1) AS max_f1, COUNT(*) AS n FROM ({_LONG_SQL}{_FEW_SQL}) GROUP BY method"""))
def q_events_methods(spark, d):
    pt = ptm.events_transfer_pt(spark, d)
    return rp.method_summary(rp.adaptive_thresholds(pt), few=rp.temperature_study(pt))


@register("events_gap_closed", W(_EVENTS_ADAPTIVE, f"""
SELECT l.method, round(avg(100.0{D} * (l.f1 - a.f1_source_calibrated) / (a.f1_oracle - a.f1_source_calibrated)), 9) AS mean_gap_closed_pct,
  round(stddev_pop(100.0{D} * (l.f1 - a.f1_source_calibrated) / (a.f1_oracle - a.f1_source_calibrated)), 9) AS std_gap_closed_pct,
  COUNT(*) AS n
FROM ({_LONG_SQL}{_FEW_SQL}) l JOIN adaptive a ON {oq.on(RK, 'l', 'a')}
WHERE l.method NOT IN ('source_calibrated', 'oracle') AND a.f1_oracle - a.f1_source_calibrated > 0.01{D}
GROUP BY l.method"""))
def q_events_gap_closed(spark, d):
    pt = ptm.events_transfer_pt(spark, d)
    return rp.gap_closed(rp.adaptive_thresholds(pt), few=rp.temperature_study(pt))


# ------------------------------------------------------------ drift
def _drift_sql() -> str:
    kk = RK
    ks = RK + ["side"]
    edges = ", ".join(f"({i}, {sql_grid_value(str(i), 0.0, 1.0, 51)})" for i in range(51))
    from ..operators.drift import _bin_widths
    widths = ", ".join(f"({i}, {w!r}::DOUBLE)" for i, w in enumerate(_bin_widths(50)))
    ent = ("-(least(greatest(score, 1e-10::DOUBLE), 0.9999999999::DOUBLE) * ln(least(greatest(score, 1e-10::DOUBLE), 0.9999999999::DOUBLE))"
           " + (1 - least(greatest(score, 1e-10::DOUBLE), 0.9999999999::DOUBLE)) * ln(1 - least(greatest(score, 1e-10::DOUBLE), 0.9999999999::DOUBLE)))")
    return ",".join([oq.transfer_runs("pt", with_projects=False), f"""
_dm AS (SELECT {oq.k(ks)}, avg(score) AS _mean, avg({ent}) AS _ent,
   avg(CASE WHEN score >= 0.5{D} THEN 1.0{D} ELSE 0.0{D} END) AS _ppr FROM pt GROUP BY {oq.k(ks)}),
_dmw AS (SELECT {RKS},
   round(abs(max(CASE WHEN side = 'test' THEN _mean END) - max(CASE WHEN side = 'val' THEN _mean END)), 9) AS mean_shift,
   round(abs(max(CASE WHEN side = 'test' THEN _ent END) - max(CASE WHEN side = 'val' THEN _ent END)), 9) AS entropy_diff,
   abs(max(CASE WHEN side = 'test' THEN _ppr END) - max(CASE WHEN side = 'val' THEN _ppr END)) AS ppr_diff
   FROM _dm GROUP BY {RKS}),
_edges AS (SELECT * FROM (VALUES {edges}) AS e(i, e)),
_widths AS (SELECT * FROM (VALUES {widths}) AS w(bin, w)),
_dbin AS (SELECT {oq.k(ks, 'p')}, p.row_id, least(max(e.i), 49) AS bin FROM pt p JOIN _edges e ON e.e <= p.score
   GROUP BY {oq.k(ks, 'p')}, p.row_id),
_dcnt AS (SELECT {oq.k(ks)}, bin, COUNT(*) AS _c FROM _dbin GROUP BY {oq.k(ks)}, bin),
_dtot AS (SELECT {oq.k(ks)}, SUM(_c) AS _n FROM _dcnt GROUP BY {oq.k(ks)}),
_dfull AS (SELECT {oq.k(ks, 't')}, CAST(r.bin AS INTEGER) AS bin, t._n, coalesce(c._c, 0) AS _c
   FROM _dtot t CROSS JOIN range(0, 50) r(bin) LEFT JOIN _dcnt c ON {oq.on(ks, 't', 'c')} AND c.bin = r.bin),
_dd AS (SELECT f.*, CAST(f._c AS DOUBLE) / (CAST(f._n AS DOUBLE) * w.w) + 1e-10{D} AS _d
   FROM _dfull f JOIN _widths w ON f.bin = w.bin),
_dp AS (SELECT {oq.k(ks)}, bin, _d / SUM(_d) OVER (PARTITION BY {oq.k(ks)}) AS p FROM _dd),
_dpw AS (SELECT {RKS}, bin, max(CASE WHEN side = 'val' THEN p END) AS ps,
   max(CASE WHEN side = 'test' THEN p END) AS pt FROM _dp GROUP BY {RKS}, bin),
_dkl AS (SELECT {RKS}, round(SUM(pt * ln(pt / ps)), 9) AS kl_divergence,
   round(0.5{D} * SUM(ps * ln(ps / (0.5{D} * (ps + pt)))) + 0.5{D} * SUM(pt * ln(pt / (0.5{D} * (ps + pt)))), 9) AS js_divergence
   FROM _dpw GROUP BY {RKS}),
_kc AS (SELECT {RKS}, score, SUM(CASE WHEN side = 'val' THEN 1 ELSE 0 END) AS cs,
   SUM(CASE WHEN side = 'test' THEN 1 ELSE 0 END) AS ct FROM pt GROUP BY {RKS}, score),
_kw AS (SELECT *, SUM(cs) OVER (PARTITION BY {RKS} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ls,
   SUM(ct) OVER (PARTITION BY {RKS} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lt,
   SUM(cs) OVER (PARTITION BY {RKS}) AS ns, SUM(ct) OVER (PARTITION BY {RKS}) AS nt FROM _kc),
_dks AS (SELECT {RKS}, max(abs(ls{D} / ns{D} - lt{D} / nt{D})) AS ks_statistic FROM _kw GROUP BY {RKS}),
drift AS (SELECT {oq.k(kk, 'r')}, r.f1_gap, r.f1_source, r.f1_oracle, r.test_projects, r.test_vuln_rate,
   m.mean_shift, m.entropy_diff, m.ppr_diff, k.kl_divergence, k.js_divergence, s.ks_statistic
   FROM _truns_out r JOIN _dmw m ON {oq.on(kk, 'r', 'm')} JOIN _dkl k ON {oq.on(kk, 'r', 'k')}
   JOIN _dks s ON {oq.on(kk, 'r', 's')})"""])


@register("drift", W(PT_SQL + "," + _drift_sql(), "SELECT * FROM drift"))
def q_drift(spark, d):
    return rp.drift_report(ptm.transfer_pt(spark, d))


# ------------------------------------------------------------ logits, losses, scalars
_L1 = "ln((score + 0.0005::DOUBLE) / (1.0005::DOUBLE - score))"


@register("logit_diagnostics", W("", f"""
SELECT model, round(avg({_L1}), 9) AS logit_pos_mean, round(avg(0.0{D}), 9) AS logit_neg_mean,
  round(avg({_L1} - 0.0{D}), 9) AS margin_mean, round(stddev_pop({_L1} - 0.0{D}), 9) AS margin_std,
  stddev_pop({_L1} - 0.0{D}) < 1e-3{D} AS is_constant,
  avg(CASE WHEN {_L1} - 0.0{D} > 0 THEN 1.0{D} ELSE 0.0{D} END) AS frac_predicts_pos
FROM scored GROUP BY model"""))
def q_logit_diagnostics(spark, d):
    from ..operators.losses import logit_diagnostics
    return logit_diagnostics(fx.scored(spark, d), ["model"])


def _loss_sql() -> str:
    m = f"greatest(0.0{D}, {_L1})"
    lse = f"({m} + ln(exp(0.0{D} - {m}) + exp({_L1} - {m})))"
    nll = f"({lse} - CASE WHEN label = 1 THEN {_L1} ELSE 0.0{D} END)"
    py = f"exp(-{nll})"
    out = []
    for name, w0, w1 in [("ce", 1.0, 1.0), ("weighted_ce", 1.0, 30.0)]:
        w = f"(CASE WHEN label = 1 THEN {w1!r}{D} ELSE {w0!r}{D} END)"
        out.append(f"SELECT model, '{name}' AS loss, round(SUM({w} * {nll}) / SUM({w}), 9) AS value "
                   f"FROM scored GROUP BY model")
    wf = f"(CASE WHEN label = 1 THEN 0.95{D} ELSE {1 - 0.95!r}{D} END)"
    out.append(f"SELECT model, 'focal' AS loss, round(avg(-{wf} * pow(1.0{D} - {py}, 2.0{D}) * (-{nll})), 9) "
               f"AS value FROM scored GROUP BY model")
    return "\nUNION ALL ".join(out)


@register("losses", W("", _loss_sql()))
def q_losses(spark, d):
    from ..operators.losses import loss_table
    return loss_table(fx.scored(spark, d), ["model"], ["ce", "weighted_ce", "focal"])


@register("softmax_scores", W("", f"""
SELECT model, row_id,
  round(exp({_L1} - greatest(0.0{D}, {_L1})) / (exp(0.0{D} - greatest(0.0{D}, {_L1})) + exp({_L1} - greatest(0.0{D}, {_L1}))), 9) AS p_softmax,
  round({_L1} - 0.0{D}, 9) AS margin, least(greatest(score, 0.1{D}), 0.9{D}) AS score_clipped,
  abs(score - 0.5{D}) AS confidence
FROM scored"""))
def q_softmax(spark, d):
    s = fx.scored(spark, d)
    return s.select("model", "row_id",
                    F.round(sc.softmax_pos("logit0", "logit1"), 9).alias("p_softmax"),
                    F.round(sc.margin("logit0", "logit1"), 9).alias("margin"),
                    sc.clip("score", 0.1, 0.9).alias("score_clipped"),
                    F.abs(F.col("score") - F.lit(0.5)).alias("confidence"))


@register("risk_zones", W("", f"""
SELECT project, COUNT(*) AS n, SUM(label){D} / COUNT(*){D} AS base_rate,
  CASE WHEN SUM(label){D} / COUNT(*){D} < 0.03{D} THEN 'low' WHEN SUM(label){D} / COUNT(*){D} < 0.08{D}
       THEN 'medium' ELSE 'high' END AS risk_zone
FROM events_corpus GROUP BY project"""))
def q_risk_zones(spark, d):
    g = fx.events_corpus(spark, d).groupBy("project").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("_p"))
    g = g.withColumn("base_rate", F.col("_p").cast("double") / F.col("n").cast("double"))
    return g.select("project", "n", "base_rate", sc.risk_zone("base_rate").alias("risk_zone"))


# ------------------------------------------------------------ sampling
from ..functions.hashing import sql_hash  # noqa: E402
from ..operators import sampling as sa  # noqa: E402
from ..operators import stats as st  # noqa: E402


def _h(seed: str, salt: str, col: str = "row_id") -> str:
    return sql_hash(seed, f"'{salt}'", col)


@register("hard_balance", W("", f"""
_bc AS (SELECT label, COUNT(*) AS n FROM corpus GROUP BY label),
_bk AS (SELECT CASE WHEN COUNT(*) < 2 THEN 0 ELSE min(n) END AS k FROM _bc)
SELECT row_id, label, project FROM (SELECT row_id, label, project,
  ROW_NUMBER() OVER (PARTITION BY label ORDER BY {_h('0', 'balance')}, row_id) AS _r FROM corpus) c, _bk
WHERE c._r <= _bk.k"""))
def q_hard_balance(spark, d):
    return sa.hard_balance(fx.corpus(spark, d).select("row_id", "label", "project"), seed=0)


@register("epoch_balance", W("", f"""
_e AS (SELECT c.*, CAST(e.epoch AS INTEGER) AS epoch FROM corpus c CROSS JOIN range(0, 3) e(epoch)),
_ec AS (SELECT epoch, label, COUNT(*) AS n FROM _e GROUP BY epoch, label),
_ek AS (SELECT epoch, CASE WHEN COUNT(*) < 2 THEN 0 ELSE min(n) END AS k FROM _ec GROUP BY epoch)
SELECT e.row_id, e.label, e.epoch FROM (SELECT row_id, label, epoch,
  ROW_NUMBER() OVER (PARTITION BY epoch, label ORDER BY {_h('epoch', 'balance')}, row_id) AS _r FROM _e) e
JOIN _ek k ON e.epoch = k.epoch WHERE e._r <= k.k"""))
def q_epoch_balance(spark, d):
    return sa.epoch_balance(fx.corpus(spark, d).select("row_id", "label"), epochs=3)


def _split_sql() -> str:
    frac = 0.1 / (1.0 - 0.2)
    return ",".join([
        "_s0 AS (SELECT row_id, label, project, 1 AS _one FROM corpus)",
        oq.stratified_take("_st", "_s0", ["_one"], f"ceil(n{D} * 0.2{D})", "0", "split_test",
                           ["row_id"]),
        "_s1 AS (SELECT * FROM _s0 WHERE row_id NOT IN (SELECT row_id FROM _st))",
        oq.stratified_take("_sv", "_s1", ["_one"], f"ceil(n{D} * {frac!r}{D})", "0", "split_val",
                           ["row_id"])])


@register("random_split", W(_split_sql(), """
SELECT row_id, label, project, CASE WHEN row_id IN (SELECT row_id FROM _st) THEN 'test'
  WHEN row_id IN (SELECT row_id FROM _sv) THEN 'val' ELSE 'train' END AS split FROM _s0"""))
def q_random_split(spark, d):
    return sa.random_split(fx.corpus(spark, d).select("row_id", "label", "project"), seed=0)


@register("downsample_positives", W("", f"""
_dc AS (SELECT SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS _pos, SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS _neg
        FROM events_corpus),
_dk AS (SELECT least(CAST(floor({0.05 / 0.95!r}{D} * _neg) AS BIGINT), _pos) AS k FROM _dc)
SELECT row_id, project, cwe, label FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {_h('0', 'downsample')}, row_id) AS _r
  FROM events_corpus WHERE label = 1) p, _dk WHERE p._r <= _dk.k
UNION ALL SELECT row_id, project, cwe, label FROM events_corpus WHERE label = 0"""))
def q_downsample(spark, d):
    return sa.downsample_positives(fx.events_corpus(spark, d), ratio=0.05, seed=0)


def _cal_sql() -> str:
    return ",".join([
        "_cs AS (SELECT e.*, CAST(s.cal_size AS INTEGER) AS cal_size FROM events_corpus e "
        "CROSS JOIN (VALUES (20), (50), (100), (200)) s(cal_size))",
        "_cn AS (SELECT cal_size FROM _cs GROUP BY cal_size HAVING COUNT(*) >= cal_size + 100)",
        "_cs2 AS (SELECT s.* FROM _cs s JOIN _cn n ON s.cal_size = n.cal_size)",
        oq.stratified_take("_ct", "_cs2", ["cal_size"], "cal_size", "0", "calibration",
                           ["cal_size", "row_id"])])


@register("calibration_draw", W(_cal_sql(), """
SELECT s.row_id, s.project, s.cwe, s.label, s.cal_size,
  CASE WHEN t.row_id IS NULL THEN 'eval' ELSE 'cal' END AS part
FROM _cs2 s LEFT JOIN _ct t ON s.cal_size = t.cal_size AND s.row_id = t.row_id"""))
def q_calibration_draw(spark, d):
    return sa.calibration_draw(fx.events_corpus(spark, d), [20, 50, 100, 200], 0)


@register("sample_k", W("", f"""
SELECT row_id, project, cwe, label FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {_h('0', 'sample')}, row_id) AS _r
  FROM events_corpus) WHERE _r <= 100"""))
def q_sample_k(spark, d):
    return sa.sample_k(fx.events_corpus(spark, d), 100, 0)


@register("validation_groups", W("", f"""
SELECT project, ROW_NUMBER() OVER (ORDER BY {_h('0', 'val_frac', 'project')}, project)
  <= greatest(round_even(COUNT(*) OVER () * 0.15{D}, 0), 1) AS is_val
FROM (SELECT DISTINCT project FROM corpus)"""))
def q_validation_groups(spark, d):
    return fo.validation_groups_fraction(fx.corpus(spark, d), 0.15, 0)


# ------------------------------------------------------------ statistics
def _runs_sql():
    return PT_SQL + "," + oq.transfer_runs("pt")


@register("bootstrap_ci", W(_runs_sql(), f"""
, _bv AS (SELECT model, f1_gap AS _v, ROW_NUMBER() OVER (PARTITION BY model ORDER BY seed, fold) - 1 AS _idx,
   COUNT(*) OVER (PARTITION BY model) AS _n FROM runs),
_bs AS (SELECT model, first(_n) AS _n, avg(_v) AS _mean FROM _bv GROUP BY model),
_bd AS (SELECT s.model, s._n, b.b, j.j FROM _bs s CROSS JOIN range(0, 10000) b(b) JOIN LATERAL
   (SELECT * FROM range(0, s._n) j(j)) j ON TRUE),
_bm AS (SELECT d.model, d.b, round(avg(v._v), 12) AS _m FROM _bd d JOIN _bv v ON v.model = d.model
   AND v._idx = CAST({sql_hash('0', "'boot'", 'd.b', 'd.j')} % d._n AS INTEGER) GROUP BY d.model, d.b)
SELECT s.model, s._n AS n, round(s._mean, 9) AS mean,
  round(quantile_cont(m._m, 0.025), 9) AS ci_lo, round(quantile_cont(m._m, 0.975), 9) AS ci_hi
FROM _bs s JOIN _bm m ON s.model = m.model GROUP BY s.model, s._n, s._mean""".replace("\n, _bv AS", ",\n_bv AS", 1)))
def q_bootstrap(spark, d):
    runs = tr.threshold_transfer_runs(ptm.transfer_pt(spark, d).drop("logit0", "logit1"))
    return st.bootstrap_ci(runs, ["model"], "f1_gap", ["seed", "fold"])


def _pairs_sql() -> str:
    return f"""
_wp AS (SELECT a.seed, a.fold, a.f1_source - b.f1_source AS _d FROM runs a JOIN runs b
   ON a.seed = b.seed AND a.fold = b.fold WHERE a.model = 'm0' AND b.model = 'm1'),
_wr AS (SELECT _d, rank() OVER (ORDER BY abs(_d)) + (COUNT(*) OVER (PARTITION BY abs(_d)) - 1) / 2.0{D} AS _r
   FROM _wp WHERE _d <> 0)"""


# p: all 2^n sign patterns are listed and those of a sum up to W counted.
@register("wilcoxon_paired", W(PT_SQL + "," + oq.transfer_runs("pt", with_projects=False)
                               + "," + _pairs_sql(), f"""
_ws AS (SELECT COUNT(*) AS n, SUM(CASE WHEN _d > 0 THEN _r ELSE 0.0 END) AS w_plus,
  SUM(CASE WHEN _d < 0 THEN _r ELSE 0.0 END) AS w_minus, list(CAST(2 * _r AS BIGINT)) AS _x FROM _wr),
_wl AS (SELECT COUNT(*) AS _low FROM (SELECT s.w_plus, s.w_minus,
    list_sum(list_transform(range(0, s.n), lambda i: s._x[i + 1] * ((b.b >> i) & 1))) AS _sum
  FROM _ws s, LATERAL (SELECT unnest(range(0, 1::BIGINT << s.n)) AS b) b)
  WHERE _sum <= 2 * least(w_plus, w_minus))
SELECT 'm0_vs_m1' AS test, s.n, s.w_plus, s.w_minus, least(s.w_plus, s.w_minus) AS statistic,
  CASE WHEN s.n > 0 AND (SELECT COUNT(*) FROM _wp) >= 5
       THEN least(1.0{D}, 2.0{D} * l._low / CAST(1::BIGINT << s.n AS DOUBLE)) END AS p_value
FROM _ws s, _wl l"""))
def q_wilcoxon(spark, d):
    runs = tr.threshold_transfer_runs(ptm.transfer_pt(spark, d).drop("logit0", "logit1"),
                                      with_projects=False)
    a = runs.filter(F.col("model") == "m0").select("seed", "fold", F.col("f1_source").alias("a"))
    b = runs.filter(F.col("model") == "m1").select("seed", "fold", F.col("f1_source").alias("b"))
    return st.wilcoxon(a.join(b, ["seed", "fold"]).withColumn("test", F.lit("m0_vs_m1")),
                       ["test"], "a", "b")


_DRIFT_METRICS = ["mean_shift", "kl_divergence", "js_divergence", "ks_statistic", "entropy_diff",
                  "ppr_diff"]


def _rank_sql(src: str, col: str) -> str:
    return (f"(rank() OVER (PARTITION BY metric ORDER BY {col}) + "
            f"(COUNT(*) OVER (PARTITION BY metric, {col}) - 1) / 2.0{D})")


_RANKED_SQL = W(PT_SQL + "," + _drift_sql(), f"""
, _sl AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {i} AS place, {m} AS value, f1_gap FROM drift" for i, m in enumerate(_DRIFT_METRICS))}),
_sr AS (SELECT metric, place, value, {_rank_sql('_sl', 'value')} AS _rv, {_rank_sql('_sl', 'f1_gap')} AS _rt FROM _sl),
_rho AS (SELECT metric, place, COUNT(*) AS n, COUNT(DISTINCT value) AS n_distinct,
  CASE WHEN COUNT(DISTINCT value) > 2 THEN round(corr(_rv, _rt), 9) END AS rho FROM _sr GROUP BY metric, place)
""".replace("\n, _sl AS", ",\n_sl AS", 1))


@register("spearman_drift", _RANKED_SQL + "SELECT metric, n, n_distinct, rho FROM _rho")
def q_spearman(spark, d):
    dr_ = rp.drift_report(ptm.transfer_pt(spark, d))
    return st.spearman(dr_, _DRIFT_METRICS, "f1_gap").drop("p_value")


@register("best_predictor", _RANKED_SQL + """
SELECT metric, rho, n, abs(rho) > 0.4 AS usable FROM _rho WHERE abs(rho) > 0 AND NOT isnan(rho)
ORDER BY abs(rho) DESC, place LIMIT 1""")
def q_best_predictor(spark, d):
    dr_ = rp.drift_report(ptm.transfer_pt(spark, d))
    return st.best_predictor(st.spearman(dr_, _DRIFT_METRICS, "f1_gap"), _DRIFT_METRICS)


# p: the density of Student's t over the angle atan(t / sqrt(df)), summed by Simpson's
# rule over 2,000 steps from the observed angle to pi / 2.
@register("spearman_pvalues", _RANKED_SQL + f"""
, _ang AS (SELECT metric, n, n_distinct, rho, n - 2 AS df,
  CASE WHEN n > 2 AND abs(rho) < 1 THEN atan(abs(rho) / sqrt(1 - rho * rho)) END AS a FROM _rho),
_simp AS (SELECT g.metric, SUM(CASE WHEN r.i IN (0, 2000) THEN 1 WHEN r.i % 2 = 1 THEN 4 ELSE 2 END
    * pow(greatest(cos(g.a + r.i * (pi() / 2 - g.a) / 2000.0{D}), 0.0{D}), g.df - 1)) * (pi() / 2 - g.a) / 6000.0{D} AS _area
  FROM _ang g CROSS JOIN range(0, 2001) r(i) WHERE g.a IS NOT NULL GROUP BY g.metric, g.a)
SELECT g.metric, g.n, g.n_distinct, g.rho, CASE WHEN g.rho IS NULL OR g.n <= 2 THEN NULL WHEN abs(g.rho) >= 1 THEN 0.0{D}
  ELSE round(2 * s._area * exp(lgamma((g.df + 1) / 2.0{D}) - lgamma(g.df / 2.0{D})) / sqrt(pi()), 9) END AS p_value
FROM _ang g LEFT JOIN _simp s ON g.metric = s.metric""".replace("\n, _ang AS", ",\n_ang AS", 1))
def q_spearman_p(spark, d):
    dr_ = rp.drift_report(ptm.transfer_pt(spark, d))
    return st.spearman(dr_, _DRIFT_METRICS, "f1_gap").withColumn("p_value", F.round("p_value", 9))


@register("gap_shift_fit", W(PT_SQL + "," + _drift_sql(), """
SELECT model, round(regr_slope(f1_gap, mean_shift), 9) AS slope,
  round(regr_intercept(f1_gap, mean_shift), 9) AS intercept, COUNT(*) AS n FROM drift GROUP BY model"""))
def q_gap_fit(spark, d):
    return st.linear_fit(rp.drift_report(ptm.transfer_pt(spark, d)), ["model"], "f1_gap", "mean_shift")


@register("method_boxplot", W(PT_SQL + "," + _adaptive_sql(), f"""
, _l AS ({_LONG_SQL}),
_q AS (SELECT method, quantile_cont(f1, 0.25) AS q1, quantile_cont(f1, 0.5) AS median,
   quantile_cont(f1, 0.75) AS q3, avg(f1) AS _mean FROM _l GROUP BY method)
SELECT q.method, round(q.q1, 9) AS q1, round(q.median, 9) AS median, round(q.q3, 9) AS q3,
  round(q._mean, 9) AS mean,
  min(CASE WHEN l.f1 >= q.q1 - 1.5{D} * (q.q3 - q.q1) THEN l.f1 END) AS whisker_lo,
  max(CASE WHEN l.f1 <= q.q3 + 1.5{D} * (q.q3 - q.q1) THEN l.f1 END) AS whisker_hi, COUNT(*) AS n
FROM _l l JOIN _q q ON l.method = q.method GROUP BY q.method, q.q1, q.median, q.q3, q._mean"""
   .replace("\n, _l AS", ",\n_l AS", 1)))
def q_boxplot(spark, d):
    return st.box_table(rp.method_long(rp.adaptive_thresholds(ptm.transfer_pt(spark, d))),
                        ["method"], "f1")


# ------------------------------------------------------------ text, models, explain (X, M, E)
from . import studies as sd  # noqa: E402
from ..operators import perturb as pe  # noqa: E402
from ..functions.text import WORD_RUN  # noqa: E402


@register("tfidf", W("", f"""
_tok AS (SELECT row_id, unnest(regexp_extract_all(lower(func), '{WORD_RUN.replace(chr(92) * 2, chr(92))}')) AS term FROM corpus),
_tc AS (SELECT row_id, term, COUNT(*) AS tf FROM _tok GROUP BY row_id, term),
_st AS (SELECT term, SUM(tf) AS cnt, COUNT(*) AS df FROM _tc GROUP BY term),
_top AS (SELECT * FROM _st ORDER BY cnt DESC, term LIMIT 10000),
_voc AS (SELECT term, ROW_NUMBER() OVER (ORDER BY term) - 1 AS idx,
   ln((1 + (SELECT COUNT(DISTINCT row_id) FROM corpus))::DOUBLE / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM _top),
_w AS (SELECT c.row_id, c.term, v.idx, (1.0::DOUBLE + ln(c.tf::DOUBLE)) * v.idf AS _w FROM _tc c JOIN _voc v ON c.term = v.term)
SELECT row_id, term, idx, round(_w / sqrt(SUM(_w * _w) OVER (PARTITION BY row_id)), 9) AS weight FROM _w"""))
def q_tfidf(spark, d):
    return sd.tfidf_table(spark, d).withColumn("weight", F.round("weight", 9))


@register("token_drift", None)
def q_token_drift(spark, d):
    c = fx.code_corpus(spark, d).select("row_id", "func")
    return pe.token_drift(pe.perturb(c, ("rename", "deadcode", "whitespace", "whitespace_safe")))


@register("perturbations", None)
def q_perturbations(spark, d):
    c = fx.code_corpus(spark, d).select("row_id", "func")
    p = pe.perturb(c, ("rename", "deadcode", "whitespace", "whitespace_safe"), n_variants=2)
    return p.select("row_id", "kind", "variant", F.length("func").alias("n_chars"),
                    F.length("func_perturbed").alias("n_chars_perturbed"),
                    F.sha2("func_perturbed", 256).alias("digest"))


@register("edited_texts", W(oq.edits(), """
SELECT row_id, kind, length(func_perturbed) AS n_chars, sha256(func_perturbed) AS digest FROM _edits"""))
def q_edited_texts(spark, d):
    p = pe.perturb(fx.code_corpus(spark, d).select("row_id", "func"), ("rename", "deadcode"))
    return p.select("row_id", "kind", F.length("func_perturbed").cast("long").alias("n_chars"),
                    F.sha2("func_perturbed", 256).alias("digest"))


@register("token_drift_edits", W(oq.edits(), f"""
_td AS (SELECT kind, CAST({oq.tokens('func')} <> {oq.tokens('func_perturbed')} AS INTEGER) AS _c,
  CAST({oq.tokens('func', False)} <> {oq.tokens('func_perturbed', False)} AS INTEGER) AS _c2 FROM _edits)
SELECT kind, COUNT(*) AS n, SUM(_c) AS n_changed, avg(_c) AS frac_changed,
  SUM(_c2) AS n_changed_no_blank, avg(_c2) AS frac_changed_no_blank FROM _td GROUP BY kind"""))
def q_token_drift_edits(spark, d):
    return pe.token_drift(pe.perturb(fx.code_corpus(spark, d).select("row_id", "func"), ("rename", "deadcode")))


#: Classifier sizes of the registered baseline query: 200 trees of depth 30 and 200
#: boosting rounds, the library's defaults, take minutes on the smallest tables.
BASELINE_SETTINGS = {"trees": 20, "depth": 10, "rounds": 10}


@register("simple_baselines", None)
def q_simple_baselines(spark, d):
    return sd.simple_baselines(spark, d, settings=BASELINE_SETTINGS)


_SPLIT_OF = ("CASE WHEN row_id IN (SELECT row_id FROM _st) THEN 'test' "
             "WHEN row_id IN (SELECT row_id FROM _sv) THEN 'val' ELSE 'train' END")


def _plan_sql(fits) -> str:
    return "(VALUES " + ", ".join(f"({i}, {t}, {float(w)!r}{D})" for i, (t, w) in enumerate(fits)) + ") AS pp(fit, task, w1)"


def _down_sql(name: str, src: str) -> str:
    """Test rows of each fit with positives down-sampled to 95:5."""
    return f"""
{name}_n AS (SELECT fit, SUM(1 - label) AS neg, SUM(label) AS pos FROM {src} GROUP BY fit),
{name} AS (SELECT t.* EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY fit, label ORDER BY {_h('0', 'downsample')}, row_id) AS r
   FROM {src}) t JOIN {name}_n n USING (fit)
   WHERE label = 0 OR r <= least(CAST(floor({0.05 / 0.95!r}{D} * neg) AS BIGINT), pos))"""


def _rounded_scores(plan: str) -> str:
    return f"""
_pl AS (SELECT * FROM {plan}),
{oq.keyed_logistic('_mem', '_pl')},
_pr AS (SELECT fit, row_id, round(margin, 6) AS margin, round(score, 6) AS score FROM _lp)"""


_METRIC_COLS = "threshold, tp, fp, fn, tn, precision, recall, f1, pred_pos_rate, base_pos_rate, collapsed, round(pr_auc, 9) AS pr_auc, roc_auc"
_GRID = [(t, w) for t in (0, 1) for w in (1.0, 30.0)]


def _grid_sql() -> str:
    return W(_split_sql() + f""",
_sp AS (SELECT row_id, label, {_SPLIT_OF} AS side FROM _s0),
_gb AS (SELECT row_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_h('0', 'balance')}, row_id) AS r
   FROM _sp WHERE side = 'train') WHERE r <= (SELECT CASE WHEN COUNT(*) < 2 THEN 0 ELSE min(n) END
   FROM (SELECT COUNT(*) AS n FROM _sp WHERE side = 'train' GROUP BY label))),
_mem AS (SELECT 0 AS task, row_id, label, side, side = 'train' AS train FROM _sp
   UNION ALL SELECT 1, row_id, label, side, side = 'train' FROM _sp WHERE side <> 'train' OR row_id IN (SELECT row_id FROM _gb)),
{_rounded_scores(_plan_sql(_GRID))},
_pt AS (SELECT r.*, m.label, m.side FROM _pr r JOIN _pl USING (fit) JOIN _mem m ON m.task = _pl.task AND m.row_id = r.row_id),
_te AS (SELECT * FROM _pt WHERE side = 'test'),
{_down_sql('_dn', '_te')},
_tk AS (SELECT *, 'natural' AS test_kind FROM _te UNION ALL SELECT *, 'downsampled' FROM _dn),
_vk AS (SELECT p.*, test_kind FROM _pt p CROSS JOIN (VALUES ('natural'), ('downsampled')) AS tk(test_kind) WHERE side = 'val'),
{oq.protocol_metrics('_vk', '_tk', ['fit', 'test_kind'])},
_dg AS (SELECT fit, test_kind, round(avg(margin), 9) AS logit_pos_mean, 0.0{D} AS logit_neg_mean,
   round(avg(margin), 9) AS margin_mean, round(stddev_pop(margin), 9) AS margin_std, stddev_pop(margin) < 1e-3{D} AS is_constant,
   avg(CASE WHEN margin > 0 THEN 1.0{D} ELSE 0.0{D} END) AS frac_predicts_pos FROM _tk GROUP BY fit, test_kind)""", f"""
SELECT CASE fit {' '.join(f"WHEN {i} THEN 'balance={bool(t)},w1={w}'" for i, (t, w) in enumerate(_GRID))} END AS cell,
  test_kind, thr_kind, {_METRIC_COLS}, _dg.* EXCLUDE (fit, test_kind) FROM _pm JOIN _dg USING (fit, test_kind)""")


@register("weight_balance_grid", _grid_sql())
def q_weight_grid(spark, d):
    return sd.weight_balance_grid(spark, d).withColumn("pr_auc", F.round("pr_auc", 9))


@register("robustness", None)
def q_robustness(spark, d):
    return sd.robustness(spark, d)


def _fixed_f1(name: str, src: str, keys) -> str:
    """Confusion counts and metrics of the fixed call scorer at 0.5 by ``keys``."""
    return f"""
{name}_t AS (SELECT {oq.k(keys)}, label, {oq.call_score('func_perturbed', sd.CALL_WEIGHTS)} >= 0.5{D} AS hit FROM {src}),
{name}_c AS (SELECT {oq.k(keys)}, CAST(SUM(CASE WHEN hit THEN label ELSE 0 END) AS BIGINT) AS tp,
   CAST(SUM(CASE WHEN hit THEN 1 - label ELSE 0 END) AS BIGINT) AS fp, CAST(SUM(CASE WHEN hit THEN 0 ELSE label END) AS BIGINT) AS fn,
   CAST(SUM(CASE WHEN hit THEN 0 ELSE 1 - label END) AS BIGINT) AS tn FROM {name}_t GROUP BY {oq.k(keys)}),
{name} AS (SELECT *, {oq.metric_cols()} FROM {name}_c)"""


@register("robustness_fixed", W(oq.all_edits(), f"""
_src AS (SELECT e.kind, e.variant, e.func_perturbed, c.label FROM _ev e JOIN code c USING (row_id)
   UNION ALL SELECT 'clean', 0, func, label FROM code),
{_fixed_f1('_rf', '_src', ['kind', 'variant'])},
_per AS (SELECT kind, round(avg(f1), 9) AS f1, COUNT(*) AS n_variants FROM _rf GROUP BY kind)
SELECT p.kind, p.f1, p.n_variants, b.f1 AS clean_f1, b.f1 - p.f1 AS abs_drop,
  100.0{D} * (b.f1 - p.f1) / greatest(b.f1, 1e-9{D}) AS rel_drop_pct
FROM _per p, (SELECT f1 FROM _per WHERE kind = 'clean') b WHERE p.kind <> 'clean'"""))
def q_robustness_fixed(spark, d):
    return sd.robustness_fixed(spark, d)


@register("category_robustness_fixed", W(oq.all_edits(1), f"""
_cat AS (SELECT cwe FROM (SELECT cwe, COUNT(*) AS n FROM code GROUP BY cwe ORDER BY n DESC, cwe LIMIT 10) WHERE cwe <> '' AND n >= 10),
_src AS (SELECT c.cwe, e.kind, e.func_perturbed, c.label FROM _ev e JOIN code c USING (row_id) JOIN _cat USING (cwe)
   UNION ALL SELECT cwe, 'clean', func, label FROM code JOIN _cat USING (cwe)),
{_fixed_f1('_rf', '_src', ['cwe', 'kind'])}
SELECT m.cwe, m.kind, m.tp, m.fp, m.fn, m.tn, m.f1, m.recall, m.precision, b.f1 AS clean_f1, b.f1 - m.f1 AS abs_drop,
  100.0{D} * (b.f1 - m.f1) / greatest(b.f1, 1e-9{D}) AS rel_drop_pct
FROM _rf m JOIN _rf b ON b.cwe = m.cwe AND b.kind = 'clean'"""))
def q_category_robustness_fixed(spark, d):
    return sd.category_robustness_fixed(spark, d)


@register("whitespace_edits", W(oq.all_edits(), """
SELECT row_id, variant, length(func_perturbed) AS n_chars, sha256(func_perturbed) AS digest FROM _ev WHERE kind = 'whitespace'"""))
def q_whitespace_edits(spark, d):
    p = pe.perturb(fx.code_corpus(spark, d).select("row_id", "func"), ("whitespace",), n_variants=2)
    return p.select("row_id", "variant", F.length("func_perturbed").cast("long").alias("n_chars"),
                    F.sha2("func_perturbed", 256).alias("digest"))


@register("per_category_robustness", None)
def q_per_category(spark, d):
    return sd.per_category_robustness(spark, d)


@register("counterfactual_flips", None)
def q_counterfactual(spark, d):
    return sd.counterfactual_study(spark, d)


@register("counterfactual_fixed", W(fx.sql_code(), f"""
_cb AS (SELECT row_id, label, func, {oq.call_score('func', sd.CALL_WEIGHTS)} AS p_before FROM code),
_cx AS (SELECT c.*, replace(c.func, s.sink, '/*' || s.sink || '*/safe_noop') AS _cf FROM _cb c
  JOIN (VALUES {", ".join(f"('{x}')" for x in sd.ex.SINKS)}) AS s(sink) ON contains(c.func, s.sink)),
_cd AS (SELECT label, row_id, p_before, {oq.call_score('_cf', sd.CALL_WEIGHTS)} AS p_after FROM _cx),
_cr AS (SELECT label, row_id, max(CAST(p_before >= 0.5 AND p_after < 0.5 AS INTEGER)) AS _f,
  max(p_before - p_after) AS _md, COUNT(*) AS _n FROM _cd GROUP BY label, row_id),
_cn AS (SELECT label, COUNT(*) AS n_tested FROM code GROUP BY label)
SELECT r.label, n.n_tested, COUNT(*) AS n_with_sink, SUM(r._f) AS n_flipped, SUM(r._n) AS sinks_found,
  round(max(r._md), 9) AS max_delta, SUM(r._f){D} / n.n_tested{D} AS flip_rate_all,
  SUM(r._f){D} / COUNT(*){D} AS flip_rate_with_sink
FROM _cr r JOIN _cn n ON r.label = n.label GROUP BY r.label, n.n_tested"""))
def q_counterfactual_fixed(spark, d):
    return sd.counterfactual_fixed(spark, d)


@register("attributions", None)
def q_attributions(spark, d):
    return sd.attribution_study(spark, d)


def _attribution_sql() -> str:
    tfidf = CATALOG["tfidf"][1]
    head = tfidf[tfidf.index("_tok AS"):tfidf.index("_w AS")].rstrip().rstrip(",")
    b = f"{sd.FIXED_INTERCEPT!r}{D}"
    sig = lambda x: f"(1.0{D} / (1.0{D} + exp(-({x}))))"
    return W(head + f""",
_au AS (SELECT c.row_id, c.term, (1.0{D} + ln(c.tf{D})) * v.idf AS u,
   CASE WHEN c.tf > 1 THEN (1.0{D} + ln((c.tf - 1){D})) * v.idf ELSE 0.0{D} END AS u2,
   CAST({_h('0', 'coef').replace('row_id', 'c.term')} % 2001 - 1000 AS DOUBLE) / 250.0{D} AS coef
   FROM _tc c JOIN _voc v ON c.term = v.term),
_as AS (SELECT *, SUM(u * u) OVER (PARTITION BY row_id) AS n2, SUM(u * coef) OVER (PARTITION BY row_id) AS dot FROM _au),
_az AS (SELECT *, {b} + dot / sqrt(n2) AS z, n2 - u * u + u2 * u2 AS n2m FROM _as),
_av AS (SELECT row_id, term, 'occlusion' AS method, round({sig('z')} - {sig(f"{b} + CASE WHEN n2m > 0 THEN (dot - coef * u + coef * u2) / sqrt(n2m) ELSE 0.0{D} END")}, 9) AS value FROM _az
  UNION ALL SELECT row_id, term, 'integrated_gradients', round(coef * u / sqrt(n2) * CASE WHEN abs(z - {b}) > 1e-12{D}
    THEN ({sig('z')} - {sig(b)}) / (z - {b}) ELSE {sig(b)} * (1.0{D} - {sig(b)}) END, 9) FROM _az)""", """
SELECT row_id, term, value, method, row_number() OVER (PARTITION BY method, row_id ORDER BY abs(value) DESC, term) AS rank
FROM _av QUALIFY rank <= 10""")


@register("attributions_fixed", _attribution_sql())
def q_attributions_fixed(spark, d):
    return sd.attributions_fixed(spark, d)


@register("counterfactual_examples", W(fx.sql_code(), f"""
_cb AS (SELECT row_id, label, cwe, func, {oq.call_score('func', sd.CALL_WEIGHTS)} AS p_before FROM code),
_cx AS (SELECT c.*, s.sink, replace(c.func, s.sink, '/*' || s.sink || '*/safe_noop') AS _cf FROM _cb c
  JOIN (VALUES {", ".join(f"('{x}')" for x in sd.ex.SINKS)}) AS s(sink) ON contains(c.func, s.sink)),
_cd AS (SELECT sink, row_id, label, cwe, p_before, {oq.call_score('_cf', sd.CALL_WEIGHTS)} AS p_after FROM _cx),
_ce AS (SELECT sink, row_id, label, cwe, p_before >= 0.5 AND p_after < 0.5 AS flipped, round(p_before, 9) AS p_before,
  round(p_after, 9) AS p_after, round(p_before - p_after, 9) AS delta FROM _cd)
SELECT *, row_number() OVER (PARTITION BY sink ORDER BY delta DESC, row_id) AS rank FROM _ce QUALIFY rank <= 5"""))
def q_counterfactual_examples(spark, d):
    return sd.counterfactual_examples(spark, d)


@register("top_projects", W(EV_PT_SQL + "," + oq.transfer_runs("pt"), f"""
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {RKS} ORDER BY f1_gap DESC, project) AS rank
  FROM per_project) WHERE rank <= 20"""))
def q_top_projects(spark, d):
    p = ptm.events_transfer_pt(spark, d).drop("logit0", "logit1")
    curve = cv.pr_curve(p, RK + ["side"])
    return tr.top_projects(tr.per_project(p, tr.run_thresholds(curve, RK), RK), RK, 20)


@register("cross_project_runs", W(oq.folds("corpus") + "," + oq.cross_group_members() + f""",
_mem AS (SELECT CAST(seed * 5 + fold AS INTEGER) AS task, row_id, any_value(label) AS label, bool_or(side = 'train') AS train
   FROM _xs GROUP BY seed, fold, row_id),
{_rounded_scores(_plan_sql([(i, 1.0) for i in range(15)]))},
_pt AS (SELECT r.*, x.label, x.side FROM _pr r JOIN _xs x ON x.seed * 5 + x.fold = r.fit AND x.row_id = r.row_id),
_te AS (SELECT * FROM _pt WHERE side = 'test'), _va AS (SELECT * FROM _pt WHERE side = 'val'),
{oq.protocol_metrics('_va', '_te', ['fit'])}""", f"""
SELECT CAST(fit // 5 AS INTEGER) AS seed, CAST(fit % 5 AS INTEGER) AS fold, thr_kind, {_METRIC_COLS} FROM _pm"""))
def q_cross_project_runs(spark, d):
    return sd.cross_project_runs(spark, d).withColumn("pr_auc", F.round("pr_auc", 9))


@register("cross_project_cv", None)
def q_cross_project_cv(spark, d):
    return sd.cross_project_cv(spark, d)


def q_external_scorer(spark, d):
    from ..operators import models as md_
    code = fx.code_corpus(spark, d).select("row_id", "func", "label", "project")
    pt = md_.score_with(code, md_.lexicon_predict, keep=("label", "project"))
    return cv.compute_metrics(pt.withColumn("model", F.lit("lexicon")), ["model"])


@register("project_codes", W("", """
SELECT project, CAST(dense_rank() OVER (ORDER BY project) - 1 AS BIGINT) AS code, n_rows
FROM (SELECT project, COUNT(*) AS n_rows FROM corpus GROUP BY project) t"""))
def q_project_codes(spark, d):
    from ..operators.prep import ordinal_codes
    sizes = fx.corpus(spark, d).groupBy("project").agg(F.count(F.lit(1)).alias("n_rows"))
    return ordinal_codes(sizes, "project").select("project", "code", "n_rows")


@register("weight_sweep", W(_split_sql() + f""",
_sp AS (SELECT row_id, label, {_SPLIT_OF} AS side FROM _s0),
_mem AS (SELECT 0 AS task, row_id, label, side, side = 'train' AS train FROM _sp),
{_rounded_scores(_plan_sql([(0, w) for w in sd.SWEEP_WEIGHTS]))},
_pt AS (SELECT r.*, m.label, m.side FROM _pr r JOIN _mem m USING (row_id)),
_te AS (SELECT * FROM _pt WHERE side = 'test'), _va AS (SELECT * FROM _pt WHERE side = 'val'),
{_down_sql('_dn', '_te')},
{oq.protocol_metrics('_va', '_dn', ['fit'])}""", f"""
SELECT (list_value({", ".join(f"{w!r}{D}" for w in sd.SWEEP_WEIGHTS)}))[fit + 1] AS w1, thr_kind, {_METRIC_COLS} FROM _pm"""))
def q_weight_sweep(spark, d):
    return sd.weight_sweep(spark, d).withColumn("pr_auc", F.round("pr_auc", 9))


@register("wilcoxon_statistic", W(PT_SQL + "," + oq.transfer_runs("pt", with_projects=False)
                                  + "," + _pairs_sql(), """
SELECT 'm0_vs_m1' AS test, COUNT(*) AS n, SUM(CASE WHEN _d > 0 THEN _r ELSE 0.0 END) AS w_plus,
  SUM(CASE WHEN _d < 0 THEN _r ELSE 0.0 END) AS w_minus,
  least(SUM(CASE WHEN _d > 0 THEN _r ELSE 0.0 END), SUM(CASE WHEN _d < 0 THEN _r ELSE 0.0 END)) AS statistic
FROM _wr"""))
def q_wilcoxon_stat(spark, d):
    return q_wilcoxon(spark, d).drop("p_value")


def _lexicon_sql() -> str:
    from ..operators.models import LEXICON
    z = "-1.0::DOUBLE"
    for w, c in LEXICON.items():
        z = f"({z} + {float(c)!r}::DOUBLE * CAST(len(regexp_extract_all(func, '\\b{w}\\b')) AS DOUBLE))"
    return z


@register("external_scorer_metrics", W(",".join([
    fx.sql_code(),
    f"_xs AS (SELECT 'lexicon' AS model, row_id, label, least(greatest(1.0::DOUBLE / (1.0::DOUBLE + exp(-{_lexicon_sql()})), 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS score FROM code)",
    oq.score_table("_agg", "_xs", ["model"]), oq.curve("_cur", "_agg", ["model"]),
    f"_th AS (SELECT DISTINCT model, 0.5{D} AS threshold FROM _agg)",
    oq.confusion("_m", "_agg", "_th", ["model"], extra=[]),
    oq.curve_summary("_s", "_cur", ["model"])]), """
SELECT m.model, m.threshold, m.tp, m.fp, m.fn, m.tn, m.precision, m.recall, m.f1, m.pred_pos_rate,
       m.base_pos_rate, m.collapsed, round(s.pr_auc, 9) AS pr_auc, s.roc_auc
FROM _m m LEFT JOIN _s s ON m.model = s.model"""))
def q_external_scorer2(spark, d):
    m = q_external_scorer(spark, d)
    return m.withColumn("pr_auc", F.round("pr_auc", 9))


def _summary_ci_sql() -> str:
    boot = CATALOG["bootstrap_ci"][1]
    summ = CATALOG["transfer_summary"][1]
    b_sel = boot[boot.index("SELECT s.model, s._n AS n"):]
    b_ctes = boot[len("WITH RECURSIVE "):boot.index("SELECT s.model, s._n AS n")].rstrip().rstrip(",")
    s_sel = summ[summ.index("SELECT model, round(avg(f1_gap)"):]
    return (f"WITH RECURSIVE {b_ctes},\n_ci AS ({b_sel}),\n_su AS ({s_sel})\n"
            f"SELECT u.*, CASE WHEN c.n >= 3 THEN c.ci_lo ELSE 0.0{D} END AS ci95_lo, "
            f"CASE WHEN c.n >= 3 THEN c.ci_hi ELSE 0.0{D} END AS ci95_hi "
            f"FROM _su u JOIN _ci c ON u.model = c.model")


@register("transfer_summary_ci", _summary_ci_sql())
def q_transfer_summary_ci(spark, d):
    runs = tr.threshold_transfer_runs(ptm.transfer_pt(spark, d).drop("logit0", "logit1"))
    return tr.summary_with_ci(runs)
