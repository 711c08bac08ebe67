"""DuckDB SQL text for the oracle check of every registered query.

Each builder returns CTE text (``name AS (...)``) that mirrors one library
operator, written independently in plain SQL: windows instead of the
bucketed kernels, recursive CTE instead of the driver-side greedy fold
assignment. Floating expressions are written in the same evaluation order
as the Spark side so that values agree bit for bit where the inputs are
integers; floating sums are rounded to 9 digits on both sides.
"""
from __future__ import annotations

import re
from typing import Sequence

from ..functions.hashing import py_hash, sql_hash
from ..functions.text import WORD_RUN, WS_CLASS_SQL
from ..operators import perturb
from . import fixtures as fx

D = "::DOUBLE"


def k(keys: Sequence[str], alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return ", ".join(p + c for c in keys)


def on(keys: Sequence[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)


def seeds_values(seeds: Sequence[int]) -> str:
    return "(VALUES " + ", ".join(f"({int(s)})" for s in seeds) + ") AS ss(seed)"


def folds(src: str = "corpus", n_splits: int = 5, seeds: Sequence[int] = (0, 1, 2),
          name: str = "folds") -> str:
    """Greedy lightest-fold grouped K-fold as a recursive CTE."""
    zeros = "[" + ", ".join("0" for _ in range(n_splits)) + "]::BIGINT[]"
    h = sql_hash("ss.seed", "'fold'", "g.project")
    return f"""
_gsz AS (SELECT project, COUNT(*) AS n FROM {src} GROUP BY project),
_gord AS (SELECT ss.seed, g.project, g.n,
            ROW_NUMBER() OVER (PARTITION BY ss.seed ORDER BY g.n DESC, {h}, g.project) AS rk
          FROM _gsz g CROSS JOIN {seeds_values(seeds)}),
_greedy AS (
  SELECT ss.seed, 0 AS rk, CAST(NULL AS VARCHAR) AS project, -1 AS fold, {zeros} AS loads
  FROM {seeds_values(seeds)}
  UNION ALL
  SELECT o.seed, o.rk, o.project,
         list_position(g.loads, list_min(g.loads)) - 1 AS fold,
         list_transform(generate_series(1, {n_splits}),
           lambda i: g.loads[i] + CASE WHEN i = list_position(g.loads, list_min(g.loads))
                                      THEN o.n ELSE 0 END) AS loads
  FROM _greedy g JOIN _gord o ON o.seed = g.seed AND o.rk = g.rk + 1),
{name} AS (SELECT seed, project, CAST(fold AS INTEGER) AS fold FROM _greedy WHERE rk > 0)"""


def largest_remainder(name: str, counts: str, keys: Sequence[str], total: str) -> str:
    """Quota per (keys, label) by largest remainder; ``counts`` has keys,
    label, n_label, n; ``total`` is an SQL expression over n."""
    kk = k(keys)
    return f"""
{name}_t AS (SELECT *, CAST({total} AS BIGINT) AS _t FROM {counts}),
{name}_f AS (SELECT *, _t * n_label AS _num, (_t * n_label) // n AS _fl, (_t * n_label) % n AS _rem
             FROM {name}_t),
{name} AS (SELECT {kk}, label,
             _fl + CASE WHEN ROW_NUMBER() OVER (PARTITION BY {kk} ORDER BY _rem DESC, label)
                             <= _t - SUM(_fl) OVER (PARTITION BY {kk}) THEN 1 ELSE 0 END AS k
           FROM {name}_f)"""


def stratified_take(name: str, src: str, keys: Sequence[str], total: str, seed: str,
                    salt: str, cols: Sequence[str]) -> str:
    """Exact stratified draw (mirrors sampling.stratified_take)."""
    kk = k(keys)
    h = sql_hash(seed, f"'{salt}'", "row_id")
    return f"""
{name}_c AS (SELECT {kk}, label, COUNT(*) AS n_label,
               SUM(COUNT(*)) OVER (PARTITION BY {kk}) AS n FROM {src} GROUP BY {kk}, label),
{largest_remainder(name + '_q', name + '_c', keys, total)},
{name}_r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {kk}, label ORDER BY {h}, row_id) AS _r
             FROM {src}),
{name} AS (SELECT {k(cols, 'r')} FROM {name}_r r JOIN {name}_q q
             ON {on(list(keys) + ['label'], 'r', 'q')} WHERE r._r <= q.k)"""


def sides(src: str = "corpus", folds_name: str = "folds", name: str = "sides",
          cols: Sequence[str] = ("row_id", "project", "cwe", "label")) -> str:
    """Test rows per fold and validation rows by group or fallback."""
    cc = k(cols, "c")
    h = sql_hash("fg.seed + ks.k", "'val'", "fg.project")
    return f"""
_gs AS (SELECT project, COUNT(*) AS n, SUM(label) AS n_pos FROM {src} GROUP BY project),
_fg AS (SELECT f.seed, f.project, f.fold, g.n, g.n_pos FROM {folds_name} f JOIN _gs g ON f.project = g.project),
_ks AS (SELECT DISTINCT fold AS k FROM _fg),
_src AS (SELECT fg.seed, ks.k, fg.project, fg.n, fg.n_pos,
           ROW_NUMBER() OVER (PARTITION BY fg.seed, ks.k ORDER BY {h}, fg.project) AS rk,
           COUNT(*) OVER (PARTITION BY fg.seed, ks.k) AS cnt
         FROM _fg fg JOIN _ks ks ON fg.fold <> ks.k),
_vg AS (SELECT * FROM _src WHERE rk <= greatest(cnt // 5, 1)),
_chk AS (SELECT seed, k, (SUM(n_pos) >= 3 AND SUM(n_pos) < SUM(n)) AS ok FROM _vg GROUP BY seed, k),
_val_g AS (SELECT v.seed, CAST(v.k AS INTEGER) AS fold, {cc}
           FROM _vg v JOIN _chk h ON v.seed = h.seed AND v.k = h.k JOIN {src} c ON c.project = v.project
           WHERE h.ok),
_tr AS (SELECT b.seed, CAST(b.k AS INTEGER) AS fold, {cc}
        FROM {src} c JOIN {folds_name} f ON c.project = f.project
        JOIN (SELECT seed, k FROM _chk WHERE NOT ok) b ON f.seed = b.seed AND f.fold <> b.k),
{stratified_take('_val_r', '_tr', ['seed', 'fold'], 'ceil(n' + D + ' * 0.2' + D + ')', 'seed',
                 'val_rows', ['seed', 'fold'] + list(cols))},
{name} AS (
  SELECT f.seed, f.fold, 'test' AS side, {cc} FROM {src} c JOIN {folds_name} f ON c.project = f.project
  UNION ALL SELECT seed, fold, 'val' AS side, {k(cols)} FROM _val_g
  UNION ALL SELECT seed, fold, 'val' AS side, {k(cols)} FROM _val_r)"""


def with_scores(name: str, src: str, models: Sequence[str], extra: Sequence[str]) -> str:
    h = sql_hash("0", "'score' || mm.model", "s.row_id")
    vals = "(VALUES " + ", ".join(f"('{m}')" for m in models) + ") AS mm(model)"
    return f"""
{name} AS (SELECT mm.model, {k(extra, 's')},
             CAST(300 * s.label + {h} % 701 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score
           FROM {src} s CROSS JOIN {vals})"""


def score_table(name: str, src: str, keys: Sequence[str]) -> str:
    kk = k(keys)
    return f"""
{name} AS (SELECT {kk}, score, CAST(SUM(label) AS BIGINT) AS pos,
             CAST(COUNT(*) - SUM(label) AS BIGINT) AS neg FROM {src} GROUP BY {kk}, score)"""


def curve(name: str, agg: str, keys: Sequence[str]) -> str:
    """PR curve with curve F1."""
    kk = k(keys)
    return f"""
{name}_w AS (SELECT *,
   CAST(SUM(pos) OVER (PARTITION BY {kk} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
   CAST(SUM(neg) OVER (PARTITION BY {kk} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp,
   CAST(SUM(pos) OVER (PARTITION BY {kk}) AS BIGINT) AS n_pos,
   CAST(SUM(neg) OVER (PARTITION BY {kk}) AS BIGINT) AS n_neg FROM {agg}),
{name}_p AS (SELECT *, tp{D} / (tp + fp){D} AS precision,
   CASE WHEN n_pos = 0 THEN 1.0{D} ELSE tp{D} / n_pos{D} END AS recall FROM {name}_w),
{name} AS (SELECT *, 2.0{D} * precision * recall / (precision + recall + 1e-12{D}) AS f1 FROM {name}_p)"""


def thr_max_f1(src: str, keys: Sequence[str], alias: str = "threshold", where: str = "TRUE") -> str:
    kk = k(keys)
    return (f"(SELECT {kk}, max_by(score, (f1, -score)) AS {alias} FROM {src} "
            f"WHERE {where} GROUP BY {kk})")


def thr_at_precision(src: str, keys: Sequence[str], p: float, alias: str = "threshold",
                     where: str = "TRUE") -> str:
    kk = k(keys)
    return (f"(SELECT {kk}, coalesce(min(CASE WHEN precision >= {p}{D} THEN score END), 1.0{D}) "
            f"AS {alias} FROM {src} WHERE {where} GROUP BY {kk})")


def confusion(name: str, agg: str, ths: str, keys: Sequence[str], extra: Sequence[str] = ("kind",),
              where: str = "TRUE") -> str:
    """Confusion counts and metrics at the thresholds of ``ths`` (A1)."""
    grp = ", ".join([k(keys, "a")] + ([k(extra, "t")] if extra else []))
    return f"""
{name}_c AS (SELECT {grp}, first(t.threshold) AS threshold,
   CAST(SUM(CASE WHEN a.score >= t.threshold THEN a.pos ELSE 0 END) AS BIGINT) AS tp,
   CAST(SUM(CASE WHEN a.score >= t.threshold THEN a.neg ELSE 0 END) AS BIGINT) AS fp,
   CAST(SUM(CASE WHEN a.score >= t.threshold THEN 0 ELSE a.pos END) AS BIGINT) AS fn,
   CAST(SUM(CASE WHEN a.score >= t.threshold THEN 0 ELSE a.neg END) AS BIGINT) AS tn
   FROM {agg} a JOIN {ths} t ON {on(keys, 'a', 't')} WHERE {where} GROUP BY {grp}),
{name} AS (SELECT *, {metric_cols()} FROM {name}_c)"""


def sdiv(num: str, den: str, default: str = "0.0") -> str:
    return f"CASE WHEN ({den}) = 0 THEN {default}{D} ELSE ({num}){D} / ({den}){D} END"


def metric_cols() -> str:
    n = "(tp + fp + fn + tn)"
    ppr = sdiv("tp + fp", n)
    return ", ".join([
        f"{sdiv('tp', 'tp + fp')} AS precision",
        f"{sdiv('tp', 'tp + fn')} AS recall",
        f"{sdiv('2 * tp', '2 * tp + fp + fn')} AS f1",
        f"{ppr} AS pred_pos_rate",
        f"{sdiv('tp + fn', n)} AS base_pos_rate",
        f"({ppr} < 1e-3{D} OR {ppr} > 1{D} - 1e-3{D}) AS collapsed"])


def curve_summary(name: str, cur: str, keys: Sequence[str]) -> str:
    kk = k(keys)
    return f"""
{name} AS (SELECT {kk},
   CASE WHEN first(n_pos) = 0 OR first(n_neg) = 0 THEN NULL
        ELSE SUM(pos{D} * precision) / first(n_pos){D} END AS pr_auc,
   CASE WHEN first(n_pos) = 0 OR first(n_neg) = 0 THEN NULL
        ELSE CAST(SUM(CAST(pos AS HUGEINT) * CAST(2 * (n_neg - fp) + neg AS HUGEINT)) AS DOUBLE)
             / (2.0{D} * first(n_pos){D} * first(n_neg){D}) END AS roc_auc
   FROM {cur} GROUP BY {kk})"""


def transfer_runs(pt: str, keys: Sequence[str] = ("model", "seed", "fold"), p: float = 0.3,
                  with_projects: bool = True) -> str:
    """Mirror of ``transfer.threshold_transfer_runs``; final CTE ``runs``."""
    keys = list(keys)
    kk = k(keys)
    ks = keys + ["side"]
    kinds = ["source", "oracle", "fixed", "p30_source", "p30_target"]
    piv = ", ".join(f"max(CASE WHEN kind = '{kd}' THEN {c} END) AS {c}_{kd}"
                    for kd in kinds for c in ["f1", "recall", "precision"])
    s = f"""
{score_table('_tagg', pt, ks)},
{curve('_tcur', '_tagg', ks)},
_truns AS (SELECT DISTINCT {kk} FROM _tcur WHERE side = 'test'),
_tthr AS (SELECT {k(keys, 'r')},
   coalesce(a.thr_source, 0.5{D}) AS thr_source, coalesce(b.thr_oracle, 0.5{D}) AS thr_oracle,
   coalesce(c.thr_p30_source, 1.0{D}) AS thr_p30_source, coalesce(d.thr_p30_target, 1.0{D}) AS thr_p30_target
   FROM _truns r
   LEFT JOIN {thr_max_f1('_tcur', keys, 'thr_source', "side = 'val'")} a ON {on(keys, 'r', 'a')}
   LEFT JOIN {thr_max_f1('_tcur', keys, 'thr_oracle', "side = 'test'")} b ON {on(keys, 'r', 'b')}
   LEFT JOIN {thr_at_precision('_tcur', keys, p, 'thr_p30_source', "side = 'val'")} c ON {on(keys, 'r', 'c')}
   LEFT JOIN {thr_at_precision('_tcur', keys, p, 'thr_p30_target', "side = 'test'")} d ON {on(keys, 'r', 'd')}),
_tths AS (
   SELECT {kk}, 'source' AS kind, thr_source AS threshold FROM _tthr
   UNION ALL SELECT {kk}, 'oracle', thr_oracle FROM _tthr
   UNION ALL SELECT {kk}, 'p30_source', thr_p30_source FROM _tthr
   UNION ALL SELECT {kk}, 'p30_target', thr_p30_target FROM _tthr
   UNION ALL SELECT {kk}, 'fixed', 0.5{D} FROM _tthr),
{confusion('_tmet', '_tagg', '_tths', keys, where="a.side = 'test'")},
_twide AS (SELECT {kk}, {piv} FROM _tmet GROUP BY {kk}),
_tsize AS (SELECT {kk},
   SUM(CASE WHEN side = 'val' THEN pos + neg ELSE 0 END) AS n_val,
   SUM(CASE WHEN side = 'test' THEN pos + neg ELSE 0 END) AS n_test,
   SUM(CASE WHEN side = 'test' THEN pos ELSE 0 END) AS _tp FROM _tagg GROUP BY {kk}),
_tnp AS (SELECT {kk}, COUNT(DISTINCT project) AS test_projects FROM {pt} WHERE side = 'test' GROUP BY {kk}),
_truns_out AS (SELECT {k(keys, 't')}, z.n_val, z.n_test, np.test_projects,
   z._tp{D} / z.n_test{D} AS test_vuln_rate, t.thr_source, t.thr_oracle,
   abs(t.thr_oracle - t.thr_source) AS thr_gap,
   w.f1_fixed AS f1_fixed_05, w.f1_source, w.f1_oracle, w.f1_oracle - w.f1_source AS f1_gap,
   w.recall_source, w.recall_oracle, w.recall_oracle - w.recall_source AS recall_gap,
   w.precision_source, w.precision_oracle,
   w.f1_p30_source AS f1_at_p30_source_thr, w.f1_p30_target AS f1_at_p30_target_thr,
   w.f1_p30_target - w.f1_p30_source AS p30_gap
   FROM _tthr t JOIN _twide w ON {on(keys, 't', 'w')} JOIN _tsize z ON {on(keys, 't', 'z')}
   JOIN _tnp np ON {on(keys, 't', 'np')})"""
    if not with_projects:
        return s + ",\nruns AS (SELECT * FROM _truns_out)"
    pk = keys + ["project"]
    pkk = k(pk)
    s += f""",
{score_table('_pagg0', f"(SELECT * FROM {pt} WHERE side = 'test')", pk)},
_psz AS (SELECT {pkk}, SUM(pos) AS n_pos, SUM(pos) + SUM(neg) AS n FROM _pagg0 GROUP BY {pkk}),
_pel AS (SELECT * FROM _psz WHERE n_pos >= 2 AND n >= 10),
_pagg AS (SELECT a.* FROM _pagg0 a JOIN _pel e ON {on(pk, 'a', 'e')}),
{curve('_pcur', '_pagg', pk)},
_pown AS {thr_max_f1('_pcur', pk, 'thr_optimal')},
_pths AS (SELECT {pkk}, 'own' AS kind, thr_optimal AS threshold FROM _pown
   UNION ALL SELECT {k(pk, 'e')}, 'src' AS kind, t.thr_source AS threshold
   FROM _pel e JOIN _tthr t ON {on(keys, 'e', 't')}),
{confusion('_pmet', '_pagg', '_pths', pk)},
_pwide AS (SELECT {pkk}, max(CASE WHEN kind = 'own' THEN f1 END) AS f1_own,
   max(CASE WHEN kind = 'src' THEN f1 END) AS f1_src FROM _pmet GROUP BY {pkk}),
per_project AS (SELECT {k(pk, 'e')}, e.n, e.n_pos{D} / e.n{D} AS vuln_rate, o.thr_optimal,
   w.f1_src AS f1_at_source_thr, w.f1_own AS f1_at_project_oracle, w.f1_own - w.f1_src AS f1_gap
   FROM _pel e JOIN _pown o ON {on(pk, 'e', 'o')} JOIN _pwide w ON {on(pk, 'e', 'w')}),
_proll AS (SELECT {kk}, round(stddev_pop(thr_optimal), 9) AS per_project_thr_std,
   min(thr_optimal) AS per_project_thr_min, max(thr_optimal) AS per_project_thr_max,
   round(avg(f1_gap), 9) AS per_project_f1_gap_mean, max(f1_gap) AS per_project_f1_gap_max,
   COUNT(*) AS n_projects_evaluated,
   SUM(CASE WHEN f1_gap > 0.1{D} THEN 1 ELSE 0 END) AS n_projects_with_gap_gt_01
   FROM per_project GROUP BY {kk}),
runs AS (SELECT r.*, p.per_project_thr_std, p.per_project_thr_min, p.per_project_thr_max,
   p.per_project_f1_gap_mean, p.per_project_f1_gap_max,
   coalesce(p.n_projects_evaluated, 0) AS n_projects_evaluated,
   coalesce(p.n_projects_with_gap_gt_01, 0) AS n_projects_with_gap_gt_01
   FROM _truns_out r LEFT JOIN _proll p ON {on(keys, 'r', 'p')})"""
    return s


# Word characters of the text edits (letters, marks, digits, connectors).
_WORD = "\\p{L}\\p{M}\\p{Nd}\\p{Pc}"


def tokens(col: str, blanks: bool = True) -> str:
    """Token list of a text: word, punctuation and (optional) blank runs."""
    ws = WS_CLASS_SQL[1:-2]
    return f"regexp_extract_all({col}, '[{_WORD}]+|[^{_WORD}{ws}]+{'|[' + ws + ']+' if blanks else ''}')"


def call_score(col: str, weights: dict) -> str:
    """Fixed call scorer: 1 / (1 + exp(1 - 10 * weighted calls / lines))."""
    z = f"0.0{D}"
    for call, w in weights.items():
        z = f"({z} + {float(w)!r}{D} * len(regexp_extract_all({col}, '\\b{call}\\('))::DOUBLE)"
    return f"(1.0{D} / (1.0{D} + exp(-(-1.0{D} + 10.0{D} * {z} / len(string_split({col}, chr(10)))::DOUBLE))))"


def edits(seed: int = 0, n_inserts: int = 3) -> str:
    """CTE ``_edits`` (row_id, kind, func, func_perturbed): rename one name after
    the other by recursion, dead code by positions (X1, X2), over ``code``."""
    ws = WS_CLASS_SQL[:-1]
    decl = f"(?:{'|'.join(perturb.TYPE_KW)}){ws}+\\**{ws}*([A-Za-z_][{_WORD}]*)"
    lib = ", ".join(f"'{x}'" for x in perturb.LIB_CALLS)
    edge = f"[^{_WORD}]"

    def once(t: str) -> str:
        return (f"regexp_replace({t}, '(^|{edge})' || names[i + 1] || '($|{edge})', "
                "'\\1v' || i || '\\2', 'g')")
    ins = ""
    for n in reversed(range(n_inserts)):
        at = py_hash(seed, "dead_point", n)
        kind = py_hash(seed, "dead_snippet", n) % len(perturb.DEAD_CODE_TEMPLATES)
        text = perturb.DEAD_CODE_TEMPLATES[kind].format(n=f"_{seed}_{n}")
        ins += (f" || CASE WHEN _pts[{at} % len(_pts) + 1] = i THEN "
                f"[regexp_extract(ln, '^{ws}*') || '{text}'] ELSE []::VARCHAR[] END")
    return f"""{fx.sql_code()},
_en AS (SELECT DISTINCT row_id, name FROM (SELECT row_id, unnest(regexp_extract_all(func, '{decl}', 1)) AS name FROM code)
  WHERE name NOT IN ({lib})),
_el AS (SELECT row_id, list(name ORDER BY {sql_hash(str(seed), "'rename'", 'name')}, name) AS names FROM _en GROUP BY row_id),
_er AS (SELECT c.row_id, 0 AS i, coalesce(l.names, []::VARCHAR[]) AS names, c.func AS t FROM code c
          LEFT JOIN _el l ON c.row_id = l.row_id
  UNION ALL SELECT row_id, i + 1, names, {once(once('t'))} FROM _er WHERE i < len(names)),
_ed AS (SELECT row_id, string_split(func, chr(10)) AS _ln FROM code),
_ep AS (SELECT *, list_filter(range(1, len(_ln) + 1), lambda i: regexp_matches(_ln[i], '[;{{]{ws}*$')) AS _pts FROM _ed),
_ei AS (SELECT row_id, CASE WHEN len(_pts) = 0 THEN array_to_string(_ln, chr(10)) ELSE array_to_string(flatten(
  list_transform(_ln, lambda ln, i: [ln]{ins})), chr(10)) END AS t FROM _ep),
_edits AS (SELECT c.row_id, 'rename' AS kind, c.func, r.t AS func_perturbed FROM code c
    JOIN _er r ON c.row_id = r.row_id WHERE r.i = len(r.names)
  UNION ALL SELECT c.row_id, 'deadcode', c.func, e.t FROM code c JOIN _ei e ON c.row_id = e.row_id)"""


def keyed_tfidf(members: str, max_features: int = 10_000) -> str:
    """CTE ``_lx`` (task, row_id, idx, x): TF-IDF rows under the vocabulary of the
    training rows of each task. ``members`` has task, row_id, train."""
    return f"""
_lt AS (SELECT row_id, term, COUNT(*) AS tf FROM (
  SELECT row_id, unnest(regexp_extract_all(lower(func), '{WORD_RUN.replace(chr(92) * 2, chr(92))}')) AS term FROM corpus)
  GROUP BY row_id, term),
_ls AS (SELECT task, term, SUM(tf) AS cnt, COUNT(*) AS df FROM _lt JOIN {members} USING (row_id) WHERE train GROUP BY task, term),
_ln AS (SELECT task, COUNT(*) AS n FROM {members} WHERE train GROUP BY task),
_lb AS (SELECT * FROM _ls QUALIFY row_number() OVER (PARTITION BY task ORDER BY cnt DESC, term) <= {max_features}),
_lv AS (SELECT task, term, row_number() OVER (PARTITION BY task ORDER BY term) - 1 AS idx,
   ln((1 + n){D} / (1.0{D} + df)) + 1.0{D} AS idf FROM _lb JOIN _ln USING (task)),
_lw AS (SELECT m.task, m.row_id, v.idx, (1.0{D} + ln(t.tf{D})) * v.idf AS w
   FROM {members} m JOIN _lt t USING (row_id) JOIN _lv v ON v.task = m.task AND v.term = t.term),
_lx AS (SELECT task, row_id, idx, w / sqrt(SUM(w * w) OVER (PARTITION BY task, row_id)) AS x FROM _lw)"""


def keyed_logistic(members: str, plan: str, steps: int = 1500) -> str:
    """CTE ``_lp`` (fit, row_id, margin, score): all fits of ``plan`` (fit, task, w1) by
    accelerated gradient steps on the training rows' coefficients (w = sum of beta_j x_j,
    through the kernel matrix), with the step 1 / L of the largest row sum of the weighted
    kernel. ``members``: task, row_id, train, label. The optimum is unique, so this needs
    nothing of the solver it checks but enough ``steps``."""
    return f"""{keyed_tfidf(members)},
_lk AS (SELECT a.task, a.row_id AS i, b.row_id AS j, SUM(a.x * b.x) AS k FROM _lx a JOIN _lx b USING (task, idx)
   JOIN {members} m ON m.task = b.task AND m.row_id = b.row_id AND m.train GROUP BY a.task, a.row_id, b.row_id),
_lr AS (SELECT a.task, a.row_id, any_value(a.train) AS train, any_value(a.label) AS label,
   list(coalesce(k, 0.0{D}) ORDER BY b.row_id) AS krow, list(b.label ORDER BY b.row_id) AS labels
   FROM {members} a JOIN {members} b ON b.task = a.task AND b.train
   LEFT JOIN _lk ON _lk.task = a.task AND _lk.i = a.row_id AND _lk.j = b.row_id GROUP BY a.task, a.row_id),
_lf AS (SELECT p.fit, r.row_id, row_number() OVER (PARTITION BY p.fit ORDER BY r.row_id) AS pos, r.label AS y, r.krow,
   CASE WHEN r.label = 1 THEN p.w1 ELSE 1.0{D} END AS s,
   list_sum(list_transform(r.krow, lambda k, i: sqrt((CASE WHEN r.label = 1 THEN p.w1 ELSE 1.0{D} END)
     * (CASE WHEN r.labels[i] = 1 THEN p.w1 ELSE 1.0{D} END)) * (k + 1.0{D}))) AS row_sum
   FROM _lr r JOIN {plan} p ON p.task = r.task WHERE r.train),
_ll AS (SELECT fit, 1.0{D} + 0.25{D} * max(row_sum) AS L, COUNT(*) AS n FROM _lf GROUP BY fit),
_li AS (SELECT fit, 0 AS t, list_transform(range(0, n), lambda i: 0.0{D}) AS beta,
   list_transform(range(0, n), lambda i: 0.0{D}) AS v, 0.0{D} AS b, 0.0{D} AS bv, L,
   (sqrt(L) - 1.0{D}) / (sqrt(L) + 1.0{D}) AS m FROM _ll
  UNION ALL
  SELECT fit, t + 1, nb, list_transform(nb, lambda x, i: x + m * (x - beta[i])), nbb, nbb + m * (nbb - b), L, m
  FROM (SELECT *, list_transform(v, lambda x, i: x - (x + rl[i]) / L) AS nb, bv - rs / L AS nbb
    FROM (SELECT z.fit, z.t, any_value(z.beta) AS beta, any_value(z.v) AS v, any_value(z.b) AS b, any_value(z.bv) AS bv,
            any_value(z.L) AS L, any_value(z.m) AS m, list(r ORDER BY pos) AS rl, SUM(r) AS rs
          FROM (SELECT z.*, f.pos, f.s * (1.0{D} / (1.0{D} + exp(-(list_dot_product(f.krow, z.v) + z.bv))) - f.y) AS r
                FROM _li z JOIN _lf f USING (fit) WHERE z.t < {steps}) z GROUP BY z.fit, z.t))),
_lp AS (SELECT z.fit, r.row_id, list_dot_product(r.krow, z.beta) + z.b AS margin,
   1.0{D} / (1.0{D} + exp(-(list_dot_product(r.krow, z.beta) + z.b))) AS score
   FROM _li z JOIN {plan} p USING (fit) JOIN _lr r ON r.task = p.task WHERE z.t = {steps})"""


def protocol_metrics(val: str, test: str, keys: Sequence[str]) -> str:
    """CTE ``_pm``: mirror of ``curves.protocol_metrics``; both inputs have keys, label, score."""
    kk = k(keys)
    return f"""
{score_table('_pva', val, keys)},
{curve('_pvc', '_pva', keys)},
{score_table('_pta', test, keys)},
{curve('_ptc', '_pta', keys)},
_pth AS (SELECT {k(keys, 'a')}, kind AS thr_kind, CASE WHEN kind = 'fixed_05' THEN 0.5{D} ELSE coalesce(b.best, 0.5{D}) END AS threshold
   FROM (SELECT DISTINCT {kk} FROM _pta) a CROSS JOIN (VALUES ('fixed_05'), ('calibrated')) AS q(kind)
   LEFT JOIN {thr_max_f1('_pvc', keys, 'best')} b ON {on(keys, 'a', 'b')}),
{confusion('_pmc', '_pta', '_pth', keys, extra=['thr_kind'])},
{curve_summary('_pms', '_ptc', keys)},
_pm AS (SELECT c.*, s.pr_auc, s.roc_auc FROM _pmc c LEFT JOIN _pms s ON {on(keys, 'c', 's')})"""


def cross_group_members(src: str = "corpus", folds_name: str = "folds", frac: float = 0.15) -> str:
    """CTE ``_xs`` (seed, fold, row_id, label, side): mirror of ``folds.cross_group_sides``."""
    h = sql_hash("seed + k", "'val_frac'", "project")
    return f"""
_xg AS (SELECT project, COUNT(*) AS n, SUM(label) AS n_pos FROM {src} GROUP BY project),
_xo AS (SELECT f.seed, q.k, f.project, g.n, g.n_pos FROM {folds_name} f JOIN _xg g USING (project)
   JOIN (SELECT DISTINCT fold AS k FROM {folds_name}) q ON q.k <> f.fold),
_xv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, k ORDER BY {h}, project) AS r,
   COUNT(*) OVER (PARTITION BY seed, k) AS c FROM _xo) WHERE r <= greatest(round_even(c * {frac}{D}, 0), 1)),
_xb AS (SELECT seed, k FROM _xv GROUP BY seed, k HAVING SUM(n_pos) = 0 OR SUM(n_pos) = SUM(n)),
_xs AS (SELECT f.seed, f.fold, c.row_id, c.label, 'test' AS side FROM {src} c JOIN {folds_name} f USING (project)
   UNION ALL SELECT o.seed, o.k, c.row_id, c.label, 'train' FROM {src} c JOIN _xo o USING (project)
     ANTI JOIN _xv v ON v.seed = o.seed AND v.k = o.k AND v.project = o.project
   UNION ALL SELECT v.seed, v.k, c.row_id, c.label, 'val' FROM {src} c JOIN _xv v USING (project)
   UNION ALL SELECT o.seed, o.k, c.row_id, c.label, 'val' FROM {src} c JOIN _xo o USING (project)
     JOIN _xb b ON b.seed = o.seed AND b.k = o.k
     ANTI JOIN _xv v ON v.seed = o.seed AND v.k = o.k AND v.project = o.project)"""


def whitespace_edit(seed: int, name: str) -> str:
    """CTE ``name`` (row_id, func, t): the naive whitespace edit of ``code``."""
    out = "func"
    for j, op in enumerate(perturb.WS_OPERATORS):
        if py_hash(seed, "ws_op", j) / 4294967296.0 < 0.5:
            out = f"replace({out}, '{op}', ' {op} ')"
    line, run = (perturb.sql_position_draw("i - 1", seed, x) for x in ("ws_line", "ws_run"))
    return f"""
{name}_l AS (SELECT row_id, func, array_to_string(flatten(list_transform(string_split({out}, chr(10)), lambda ln, i:
   CASE WHEN {line} % 1000 < 300 THEN [ln, ''] ELSE [ln] END)), chr(10)) AS t FROM code),
{name}_p AS (SELECT row_id, func, regexp_split_to_array(t, '[ \t]+') AS pieces FROM {name}_l),
{name} AS (SELECT row_id, func, array_to_string(list_transform(pieces, lambda p, i:
   CASE WHEN i < len(pieces) THEN p || repeat(' ', 1 + {run} % 3) ELSE p END), '') AS t FROM {name}_p)"""


def all_edits(variants: int = 2, seed: int = 0) -> str:
    """CTE ``_ev`` (row_id, kind, variant, func, func_perturbed) over ``code``: rename,
    dead code and whitespace for every variant (X1-X5, A21)."""
    ctes, parts = [], []
    for v in range(variants):
        text = re.sub(r"\b_e(n|l|r|d|p|i|dits)\b", rf"_e\1_{v}", edits(seed + v))
        if v:
            text = text[text.index(f"_en_{v} AS"):]
        ctes += [text, whitespace_edit(seed + v, f"_ww_{v}")]
        parts += [f"SELECT row_id, kind, {v} AS variant, func, func_perturbed FROM _edits_{v}",
                  f"SELECT row_id, 'whitespace', {v}, func, t FROM _ww_{v}"]
    return ",\n".join(ctes) + ",\n_ev AS (" + " UNION ALL ".join(parts) + ")"
