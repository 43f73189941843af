"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark code, from the operator definitions:
views ``lineitem`` and ``events`` are the driver's parquet tables. Computed
doubles are rounded to 6 decimals (``+ 0.0`` folds a rounded ``-0.0`` into
``0.0``); DuckDB returns inf/NaN where Spark returns NULL (division by zero,
log of a non-positive value), so those cases are spelled out with CASE.
"""

from __future__ import annotations

SEED = 151101


def r6(x: str) -> str:
    return f"(round(({x}) * 1000000.0::DOUBLE) / 1000000.0::DOUBLE + 0.0)"


RUN_ID = ("concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
          "CAST(l_quantity AS INTEGER))")

RUNS = f"""
runs AS (
  SELECT {RUN_ID} AS run_id,
         l_quantity AS Vc,
         l_discount AS Fz,
         l_tax + 0.5::DOUBLE AS ap,
         l_extendedprice / 10000.0::DOUBLE AS Ra,
         round(0.2::DOUBLE + 0.02::DOUBLE * l_quantity
               + 3.0::DOUBLE * l_discount * (l_tax + 0.5::DOUBLE)
               + 0.15::DOUBLE * sin(l_quantity / 8.0::DOUBLE)
               + 0.1::DOUBLE * ((('0x' || substr(md5({RUN_ID}), 1, 8))::BIGINT / 4294967295.0::DOUBLE)
                                - 0.5::DOUBLE), 6) AS Ra_planted
  FROM lineitem)"""

FOLDED = RUNS + f""",
edges AS (
  SELECT list_sort(list_distinct(quantile_cont(Ra_planted, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e
  FROM runs),
binned AS (
  SELECT runs.*, CAST(len(list_filter(e[2:len(e) - 1], lambda x: runs.Ra_planted > x)) AS INTEGER) AS bin
  FROM runs, edges),
folded AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY bin ORDER BY md5('{SEED}:' || run_id)) - 1) % 5 AS INTEGER) AS fold
  FROM binned)"""

OOF = FOLDED + """,
micro AS (SELECT *, CAST(round(Ra_planted * 1000000.0::DOUBLE) AS BIGINT) AS yi FROM folded),
g1 AS (SELECT Vc, fold, sum(yi) AS gs, count(*) AS gn FROM micro GROUP BY Vc, fold),
t1 AS (SELECT Vc, sum(gs) AS ts, sum(gn) AS tn FROM g1 GROUP BY Vc),
s1 AS (SELECT g1.Vc, g1.fold, ts - gs AS rs, tn - gn AS rn FROM g1 JOIN t1 ON g1.Vc = t1.Vc),
g2 AS (SELECT Fz, ap, fold, sum(yi) AS gs, count(*) AS gn FROM micro GROUP BY Fz, ap, fold),
t2 AS (SELECT Fz, ap, sum(gs) AS ts, sum(gn) AS tn FROM g2 GROUP BY Fz, ap),
s2 AS (SELECT g2.Fz, g2.ap, g2.fold, ts - gs AS rs, tn - gn AS rn
       FROM g2 JOIN t2 ON g2.Fz = t2.Fz AND g2.ap = t2.ap),
tot AS (SELECT sum(yi) AS s, count(*) AS n FROM micro),
tm AS (SELECT fold, CAST(max(tot.s) - sum(yi) AS DOUBLE) / CAST(max(tot.n) - count(*) AS DOUBLE) / 1000000.0::DOUBLE AS tm
       FROM micro, tot GROUP BY fold),
oof AS (
  SELECT f.run_id, f.fold, f.Ra_planted AS y,
         CASE WHEN s1.rn > 0 THEN CAST(s1.rs AS DOUBLE) / CAST(s1.rn AS DOUBLE) / 1000000.0::DOUBLE ELSE tm.tm END AS pred_svr,
         CASE WHEN s2.rn > 0 THEN CAST(s2.rs AS DOUBLE) / CAST(s2.rn AS DOUBLE) / 1000000.0::DOUBLE ELSE tm.tm END AS pred_gpr
  FROM folded f
  JOIN s1 ON f.Vc = s1.Vc AND f.fold = s1.fold
  JOIN s2 ON f.Fz = s2.Fz AND f.ap = s2.ap AND f.fold = s2.fold
  JOIN tm ON f.fold = tm.fold)"""

BLEND = OOF + """,
bstats AS (SELECT count(*) AS n, sum((y - pred_svr) * (y - pred_svr)) AS A,
                  sum((y - pred_svr) * (pred_gpr - pred_svr)) AS B,
                  sum((pred_gpr - pred_svr) * (pred_gpr - pred_svr)) AS C FROM oof),
balpha AS (SELECT CASE WHEN C = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, B / C)) END AS alpha,
                  A, B, C, n FROM bstats),
blended AS (SELECT oof.*, balpha.alpha, balpha.alpha * pred_gpr + (1.0::DOUBLE - balpha.alpha) * pred_svr AS pred_ens
            FROM oof, balpha)"""


def _ridge_coef(a: str) -> str:
    """Columns i11, i12, i22, c1, c2, b0 for penalty ``a`` from ``rs``."""
    det = f"((Sss + {a}) * (Sgg + {a}) - Ssg * Ssg)"
    i11 = f"((Sgg + {a}) / {det})"
    i22 = f"((Sss + {a}) / {det})"
    i12 = f"(-Ssg / {det})"
    c1 = f"({i11} * Ssy + {i12} * Sgy)"
    c2 = f"({i12} * Ssy + {i22} * Sgy)"
    b0 = f"(my - {c1} * ms - {c2} * mg)"
    return i11, i12, i22, c1, c2, b0


ALPHAS = (0.1, 1.0, 10.0)

STACK = BLEND + """,
rs AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(pred_svr) AS ms, avg(pred_gpr) AS mg, avg(y) AS my,
              count(*) * var_pop(pred_svr) AS Sss, count(*) * var_pop(pred_gpr) AS Sgg,
              count(*) * covar_pop(pred_svr, pred_gpr) AS Ssg,
              count(*) * covar_pop(pred_svr, y) AS Ssy, count(*) * covar_pop(pred_gpr, y) AS Sgy FROM oof),
cand AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 1.0::DOUBLE), (2, 10.0::DOUBLE)) t(idx, alpha)),
coef AS (
  SELECT cand.idx, cand.alpha, rs.*,
""" + ",\n".join(
    f"         {expr} AS {name}"
    for name, expr in zip(("i11", "i12", "i22", "c1", "c2", "b0"), _ridge_coef("cand.alpha"))
) + """
  FROM cand, rs),
loo AS (
  SELECT coef.idx, avg(power((o.y - (coef.b0 + coef.c1 * o.pred_svr + coef.c2 * o.pred_gpr))
           / (1.0::DOUBLE - (1.0::DOUBLE / coef.n
              + coef.i11 * (o.pred_svr - coef.ms) * (o.pred_svr - coef.ms)
              + 2.0::DOUBLE * coef.i12 * (o.pred_svr - coef.ms) * (o.pred_gpr - coef.mg)
              + coef.i22 * (o.pred_gpr - coef.mg) * (o.pred_gpr - coef.mg))), 2)) AS loo_mse
  FROM oof o, coef GROUP BY coef.idx),
ridge AS (
  SELECT coef.idx, coef.alpha, loo.loo_mse, coef.b0 AS intercept, coef.c1 AS coef_svr, coef.c2 AS coef_gpr
  FROM coef JOIN loo ON coef.idx = loo.idx),
chosen AS (SELECT * FROM ridge ORDER BY loo_mse, idx LIMIT 1),
stacked AS (SELECT blended.*, chosen.intercept + chosen.coef_svr * pred_svr + chosen.coef_gpr * pred_gpr AS pred_stack
            FROM blended, chosen)"""


def _with(body: str, cte: str) -> str:
    return f"WITH {cte.strip()}\n{body}"


METRICS_LONG = """
long AS (
  SELECT 'SVR' AS model, y, pred_svr AS p FROM stacked
  UNION ALL SELECT 'GPR', y, pred_gpr FROM stacked
  UNION ALL SELECT 'Weighted_Ensemble', y, pred_ens FROM stacked
  UNION ALL SELECT 'Stacking_Ensemble', y, pred_stack FROM stacked),
magg AS (
  SELECT model, count(*) AS n, avg((p - y) * (p - y)) AS mse, sum((p - y) * (p - y)) AS sse,
         avg(abs(p - y)) AS mae, avg(p - y) AS mbe,
         avg(abs((y - p) / greatest(abs(y), 1e-9))) AS mape, avg(abs(y)) AS may, var_pop(y) AS vy
  FROM long GROUP BY model)"""


def metrics_report() -> str:
    body = f"""
SELECT model,
       {r6('mse')} AS "MSE",
       {r6('sqrt(mse)')} AS "RMSE",
       {r6('CASE WHEN may = 0 THEN NULL ELSE sqrt(mse) / may END * 100.0')} AS "RMSE_%",
       {r6('mae')} AS "MAE",
       {r6('CASE WHEN may = 0 THEN NULL ELSE mae / may END * 100.0')} AS "MAE_%",
       {r6('mbe')} AS "MBE",
       {r6('CASE WHEN may = 0 THEN NULL ELSE mbe / may END * 100.0')} AS "MBE_%",
       {r6('mape * 100.0')} AS "MAPE",
       {r6('CASE WHEN n * vy = 0 THEN (CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 - sse / (n * vy) END')} AS "R2"
FROM magg"""
    return _with(body, STACK + "," + METRICS_LONG)


# fixed values: the 12 monolith inputs and their matrix order
F12 = ("Vc", "Fz", "ap", "Vc2", "Fz2", "ap2", "Vc_Fz", "Vc_ap", "Fz_ap", "Vc/Fz", "Fz/ap", "Vc/ap")
F15 = ("Vc", "Fz", "ap", "Vc2", "Fz2", "ap2", "Vc_Fz", "Vc_ap", "Fz_ap",
       "Vc_Fz_ratio", "Fz_ap_ratio", "Vc_ap_ratio", "log_Vc", "log_Fz", "log_ap")

FEAT15 = RUNS + """,
feat AS (
  SELECT *, Vc * Vc AS Vc2, Fz * Fz AS Fz2, ap * ap AS ap2,
         Vc * Fz AS Vc_Fz, Vc * ap AS Vc_ap, Fz * ap AS Fz_ap,
         CASE WHEN Fz + 1e-9 = 0 THEN NULL ELSE Vc / (Fz + 1e-9) END AS Vc_Fz_ratio,
         CASE WHEN ap + 1e-9 = 0 THEN NULL ELSE Fz / (ap + 1e-9) END AS Fz_ap_ratio,
         CASE WHEN ap + 1e-9 = 0 THEN NULL ELSE Vc / (ap + 1e-9) END AS Vc_ap_ratio,
         CASE WHEN Vc + 1e-9 > 0 THEN ln(Vc + 1e-9) END AS log_Vc,
         CASE WHEN Fz + 1e-9 > 0 THEN ln(Fz + 1e-9) END AS log_Fz,
         CASE WHEN ap + 1e-9 > 0 THEN ln(ap + 1e-9) END AS log_ap
  FROM runs)"""

FEAT12 = RUNS + """,
feat AS (
  SELECT *, Vc * Vc AS Vc2, Fz * Fz AS Fz2, ap * ap AS ap2,
         Vc * Fz AS Vc_Fz, Vc * ap AS Vc_ap, Fz * ap AS Fz_ap,
         CASE WHEN Fz = 0 THEN NULL ELSE Vc / Fz END AS "Vc/Fz",
         CASE WHEN ap = 0 THEN NULL ELSE Fz / ap END AS "Fz/ap",
         CASE WHEN ap = 0 THEN NULL ELSE Vc / ap END AS "Vc/ap",
         CASE WHEN Vc > 0 THEN ln(Vc) END AS log_Vc,
         CASE WHEN Fz > 0 THEN ln(Fz) END AS log_Fz,
         CASE WHEN ap > 0 THEN ln(ap) END AS log_ap
  FROM runs)"""


def q(name: str) -> str:
    return f'"{name}"'


def _matrix(names, cte, rounded_from):
    cols = []
    for i, n in enumerate(names):
        e = q(n)
        cols.append(f"{r6(e) if i >= rounded_from else e} AS x{i:02d}")
    return _with(f"SELECT run_id, {', '.join(cols)}, Ra_planted AS y FROM feat", cte)


def _poly_d2(names):
    cols = []
    n = len(names)
    for i in range(n):
        cols.append(f"{q(names[i])} AS {q(names[i])}")
    for i in range(n):
        for j in range(i, n):
            nm = f"{names[i]}^2" if i == j else f"{names[i]} {names[j]}"
            cols.append(f"{q(names[i])} * {q(names[j])} AS {q(nm)}")
    return _with(f"SELECT run_id, {', '.join(cols)} FROM feat", FEAT12)


def _robust_scale():
    parts = []
    for c in F15:
        parts.append(f"quantile_cont({q(c)}, [0.25, 0.5, 0.75]) AS {q(c + '__q')}")
    stats = f"st AS (SELECT {', '.join(parts)} FROM feat)"
    sel = []
    for c in F15:
        qq = q(c + "__q")
        iqr = f"({qq}[3] - {qq}[1])"
        den = f"(CASE WHEN {iqr} < {10 * 2.220446049250313e-16!r} THEN 1.0::DOUBLE ELSE {iqr} END)"
        sel.append(f"{r6(f'({q(c)} - {qq}[2]) / {den}')} AS {q(c)}")
    return _with(f"SELECT run_id, {', '.join(sel)} FROM feat, st", FEAT15 + ",\n" + stats)


def _yj(x: str, lam: float) -> str:
    eps = 2.220446049250313e-16
    if abs(lam) < eps:
        p = f"ln(1.0::DOUBLE + {x})"
    else:
        p = f"((power({x} + 1.0::DOUBLE, {lam!r}::DOUBLE) - 1.0::DOUBLE) / {lam!r}::DOUBLE)"
    if abs(lam - 2.0) > eps:
        n = f"(-(power(1.0::DOUBLE - {x}, {2.0 - lam!r}::DOUBLE) - 1.0::DOUBLE) / {2.0 - lam!r}::DOUBLE)"
    else:
        n = f"(-ln(1.0::DOUBLE - {x}))"
    return f"(CASE WHEN {x} >= 0 THEN {p} ELSE {n} END)"


def _yj_col(x: str, lam: str) -> str:
    """Yeo-Johnson with a lambda column (no exact 0 / 2 cases on our grids
    except the literal ones, handled by CASE)."""
    x = f"({x})"
    return (f"(CASE WHEN {x} >= 0 THEN (CASE WHEN abs({lam}) < 2.220446049250313e-16 THEN ln(1.0::DOUBLE + {x}) "
            f"ELSE (power({x} + 1.0::DOUBLE, {lam}) - 1.0::DOUBLE) / {lam} END) "
            f"ELSE (CASE WHEN abs({lam} - 2.0::DOUBLE) > 2.220446049250313e-16 "
            f"THEN -(power(1.0::DOUBLE - {x}, 2.0::DOUBLE - {lam}) - 1.0::DOUBLE) / (2.0::DOUBLE - {lam}) "
            f"ELSE -ln(1.0::DOUBLE - {x}) END) END)")


def _yj_inv_col(t: str, lam: str) -> str:
    t = f"({t})"
    return (f"(CASE WHEN {t} >= 0 THEN (CASE WHEN abs({lam}) < 2.220446049250313e-16 THEN exp({t}) - 1.0::DOUBLE "
            f"ELSE power({t} * {lam} + 1.0::DOUBLE, 1.0::DOUBLE / {lam}) - 1.0::DOUBLE END) "
            f"ELSE (CASE WHEN abs({lam} - 2.0::DOUBLE) > 2.220446049250313e-16 "
            f"THEN 1.0::DOUBLE - power(-(2.0::DOUBLE - {lam}) * {t} + 1.0::DOUBLE, 1.0::DOUBLE / (2.0::DOUBLE - {lam})) "
            f"ELSE -(exp(-{t}) - 1.0::DOUBLE) END) END)")


def _grid_values(lo=-3.0, hi=5.0, n=33):
    import numpy as np
    return [float(v) for v in np.linspace(lo, hi, n)]


def _yj_fit_cte(src: str, col: str) -> str:
    vals = ", ".join(f"({v!r}::DOUBLE)" for v in _grid_values())
    return f"""
grid AS (SELECT * FROM (VALUES {vals}) g(lam)),
fitv AS (SELECT grid.lam, count(*) AS n, var_pop({_yj_col(col, 'grid.lam')}) AS v
         FROM {src}, grid GROUP BY grid.lam),
slog AS (SELECT sum(sign({col}) * ln(1.0::DOUBLE + abs({col}))) AS s FROM {src}),
fit AS (SELECT lam, CASE WHEN v < 2.2250738585072014e-308 THEN '-inf'::DOUBLE
                          ELSE -n / 2.0 * ln(v) + (lam - 1.0) * slog.s END AS loglik FROM fitv, slog),
bestlam AS (SELECT lam FROM fit ORDER BY loglik DESC, lam ASC LIMIT 1)"""


def _importance_cte():
    reps = 10
    feats = F12
    case_val = "CASE feat " + " ".join(f"WHEN {j} THEN p{j}" for j, f in enumerate(feats)) + " END"

    def swapped(f):
        j = feats.index(f)
        return f"(CASE WHEN feat = {j} THEN pv ELSE {q(f)} END)"

    def svr(c):
        return (f"(0.2::DOUBLE + 0.02::DOUBLE * {c('Vc')} + 3.0::DOUBLE * {c('Fz_ap')} "
                f"+ 0.15::DOUBLE * sin({c('Vc')} / 8.0::DOUBLE))")

    def gpr(c):
        return f"(0.2::DOUBLE + 0.02::DOUBLE * {c('Vc')} + 3.0::DOUBLE * {c('Fz')} * {c('ap')})"

    plain = lambda f: q(f)
    return FEAT12 + f""",
pbase AS (SELECT run_id, {', '.join(q(f) for f in feats)}, Ra_planted AS y,
                 row_number() OVER (ORDER BY md5('{SEED}:' || run_id)) AS ra
          FROM feat),
pdonor AS (SELECT r.rep, row_number() OVER (PARTITION BY r.rep ORDER BY md5('{SEED}:' || r.rep || ':' || run_id)) AS ra,
                  {', '.join(f'{q(f)} AS p{j}' for j, f in enumerate(feats))}
           FROM pbase, range({reps}) r(rep)),
ppaired AS (SELECT f.feat, pdonor.rep, pbase.*, {case_val} AS pv
            FROM pbase JOIN pdonor ON pbase.ra = pdonor.ra, range({len(feats)}) f(feat)),
pbaseline AS (SELECT avg(power({svr(plain)} - y, 2)) AS b0, avg(power({gpr(plain)} - y, 2)) AS b1 FROM pbase),
prep AS (SELECT rep, feat, avg(power({svr(swapped)} - y, 2)) AS m0, avg(power({gpr(swapped)} - y, 2)) AS m1
         FROM ppaired GROUP BY rep, feat),
pdiff AS (SELECT 'Formula (Fz/ap)' AS method, rep, feat, m0 - b0 AS d FROM prep, pbaseline
          UNION ALL SELECT 'Formula (Fz x ap)', rep, feat, m1 - b1 FROM prep, pbaseline),
featnames AS (SELECT * FROM (VALUES {', '.join(f"({j}, '{f}')" for j, f in enumerate(feats))}) t(feat, feature)),
pimp AS (SELECT method, feature, avg(d) AS importance, stddev_pop(d) AS std
         FROM pdiff JOIN featnames USING (feat) GROUP BY method, feature)"""


# fixed values: lineage of the 12 inputs onto the base variables
LINEAGE = (
    ("Vc", "Vc"), ("Fz", "Fz"), ("ap", "ap"),
    ("Vc2", "Vc"), ("Fz2", "Fz"), ("ap2", "ap"),
    ("Vc_Fz", "Vc"), ("Vc_Fz", "Fz"), ("Vc_ap", "Vc"), ("Vc_ap", "ap"), ("Fz_ap", "Fz"), ("Fz_ap", "ap"),
    ("Vc/Fz", "Vc"), ("Vc/Fz", "Fz"), ("Fz/ap", "Fz"), ("Fz/ap", "ap"), ("Vc/ap", "Vc"), ("Vc/ap", "ap"),
)
# the substring rule as coded: x0 -> Vc; x1, x10, x11 -> Fz; x2 -> ap
LITERAL = (("Vc", "Vc"), ("Fz", "Fz"), ("Fz/ap", "Fz"), ("Vc/ap", "Fz"), ("ap", "ap"))


def _grouped_cte(mapping):
    vals = ", ".join(f"('{f}', '{v}')" for f, v in mapping)
    return _importance_cte() + f""",
fmap AS (SELECT * FROM (VALUES {vals}) t(feature, variable)),
vars AS (SELECT * FROM (VALUES ('Vc'), ('Fz'), ('ap')) t(variable)),
methods AS (SELECT DISTINCT method FROM pimp),
gsum AS (SELECT method, variable, sum(importance) AS importance, avg(std) AS std
         FROM pimp JOIN fmap USING (feature) GROUP BY method, variable),
grouped AS (SELECT m.method, v.variable, coalesce(g.importance, 0.0) AS importance, coalesce(g.std, 0.0) AS std
            FROM methods m CROSS JOIN vars v LEFT JOIN gsum g ON g.method = m.method AND g.variable = v.variable),
normed AS (SELECT method, variable, std,
                  CASE WHEN sum(importance) OVER (PARTITION BY method) > 0
                       THEN importance / sum(importance) OVER (PARTITION BY method) ELSE importance END AS importance
           FROM grouped)"""


def _histogram():
    return _with(f"""
SELECT b.bin, {r6('mn + CAST(b.bin AS DOUBLE) * ((mx - mn) / 15.0)')} AS lo,
       {r6('mn + CAST(b.bin + 1 AS DOUBLE) * ((mx - mn) / 15.0)')} AS hi,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(15)) b
CROSS JOIN mm
LEFT JOIN (
  SELECT CAST(least(CASE WHEN mx - mn = 0 THEN 0 ELSE floor((Ra_planted - mn) / (mx - mn) * 15.0) END, 14) AS INTEGER) AS bin,
         count(*) AS cnt
  FROM runs, mm GROUP BY 1) c ON c.bin = b.bin""", RUNS + ",\nmm AS (SELECT min(Ra_planted) AS mn, max(Ra_planted) AS mx FROM runs)")


def _sample_idx_cte():
    return BLEND + f""",
sidx AS (SELECT blended.*, CAST(row_number() OVER (ORDER BY fold, md5('{SEED}:' || run_id)) - 1 AS BIGINT) AS sample_idx
         FROM blended)"""


def _lenient(x: str) -> str:
    num = r"^[+-]?(([0-9]+\.?[0-9]*)|(\.[0-9]+))([eE][+-]?[0-9]+)?$"
    special = r"^[+-]?(inf|infinity|nan)$"
    return (f"(CASE WHEN regexp_matches(trim({x}), '{num}') OR regexp_matches(lower(trim({x})), '{special}') "
            f"THEN TRY_CAST(trim({x}) AS DOUBLE) END)")


def _poly_sums(degree: int) -> str:
    """Sums of all monomials of a degree from power sums (Newton's identities)."""
    parts = {"Vc": 50.0, "Fz": 0.1, "ap": 0.6, "Vc2": 2500.0, "Fz2": 0.01, "ap2": 0.36, "Vc_Fz": 5.0, "Vc_ap": 30.0, "Fz_ap": 0.06}
    power = ", ".join(
        " + ".join(f"power({c} / {v!r}::DOUBLE, {k})" for c, v in parts.items()) + f" AS p{k}" for k in range(1, 5))
    sums = ["p1", "(p1 * p1 + p2) / 2", "(p1 * p1 * p1 + 3 * p1 * p2 + 2 * p3) / 6",
            "(p1 * p1 * p1 * p1 + 6 * p1 * p1 * p2 + 3 * p2 * p2 + 8 * p1 * p3 + 6 * p4) / 24"]
    terms = {3: 219, 4: 714}[degree]
    return _with(f"SELECT run_id, {terms} AS n_terms, " + ", ".join(f"{r6(x)} AS sum_d{k + 1}" for k, x in enumerate(sums[:degree]))
                 + f" FROM (SELECT run_id, {power} FROM feat)", FEAT15)


def _fold_robust() -> str:
    def unit(first):
        return f"(('0x' || substr(md5(run_id), {first}, 8))::BIGINT / 4294967295.0::DOUBLE)"

    features = ["Vc", "Fz", "ap", "Vc * Vc", "Fz * Fz", "ap * ap", "Vc * Fz", "Vc * ap", "Fz * ap",
                "Vc / (Fz + 1e-9)", "Fz / (ap + 1e-9)", "Vc / (ap + 1e-9)", "ln(Vc + 1e-9)", "ln(Fz + 1e-9)", "ln(ap + 1e-9)"]
    long = " UNION ALL ".join(f"SELECT fold, '{name}' AS feature, {e} AS v FROM cont" for name, e in zip(F15, features, strict=True))
    return _with(f"""
SELECT state, feature, {r6('q[2]')} AS median,
       {r6(f'CASE WHEN q[3] - q[1] < {10 * 2.220446049250313e-16!r} THEN 1.0 ELSE q[3] - q[1] END')} AS iqr
FROM (SELECT CAST(s.state AS INTEGER) AS state, feature, quantile_cont(v, [0.25, 0.5, 0.75]) AS q
      FROM long JOIN range(6) s(state) ON fold <> s.state GROUP BY s.state, feature)""",
        FOLDED + f""",
cont AS (SELECT fold, Vc + {unit(9)} AS Vc, Fz + 0.01::DOUBLE * {unit(17)} + 0.001::DOUBLE AS Fz, ap + 0.1::DOUBLE * {unit(25)} AS ap FROM folded),
long AS ({long})""")


def _nested_stacking() -> str:
    coefs = ",\n".join(
        f"         {expr} AS {name}" for name, expr in zip(("i11", "i12", "i22", "c1", "c2", "b0"), _ridge_coef("cand.alpha")))
    return _with(f"""
SELECT o.run_id, o.fold, o.y, {r6('c.alpha')} AS alpha, {r6('c.b0 + c.c1 * o.pred_svr + c.c2 * o.pred_gpr')} AS pred_stack
FROM oof o JOIN nchosen c ON c.k = o.fold""", OOF + f""",
ntrain AS (SELECT k.k, oof.* FROM oof JOIN range(5) k(k) ON oof.fold <> k.k),
rs AS (SELECT k, CAST(count(*) AS DOUBLE) AS n, avg(pred_svr) AS ms, avg(pred_gpr) AS mg, avg(y) AS my,
              count(*) * var_pop(pred_svr) AS Sss, count(*) * var_pop(pred_gpr) AS Sgg,
              count(*) * covar_pop(pred_svr, pred_gpr) AS Ssg,
              count(*) * covar_pop(pred_svr, y) AS Ssy, count(*) * covar_pop(pred_gpr, y) AS Sgy FROM ntrain GROUP BY k),
cand AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 1.0::DOUBLE), (2, 10.0::DOUBLE)) t(idx, alpha)),
coef AS (SELECT cand.idx, cand.alpha, rs.*,
{coefs}
         FROM cand, rs),
loo AS (SELECT coef.k, coef.idx, avg(power((o.y - (coef.b0 + coef.c1 * o.pred_svr + coef.c2 * o.pred_gpr))
           / (1.0::DOUBLE - (1.0::DOUBLE / coef.n
              + coef.i11 * (o.pred_svr - coef.ms) * (o.pred_svr - coef.ms)
              + 2.0::DOUBLE * coef.i12 * (o.pred_svr - coef.ms) * (o.pred_gpr - coef.mg)
              + coef.i22 * (o.pred_gpr - coef.mg) * (o.pred_gpr - coef.mg))), 2)) AS loo_mse
        FROM ntrain o JOIN coef ON o.k = coef.k GROUP BY coef.k, coef.idx),
nchosen AS (SELECT * FROM (SELECT coef.*, row_number() OVER (PARTITION BY coef.k ORDER BY loo.loo_mse, coef.idx) AS r
            FROM coef JOIN loo ON coef.k = loo.k AND coef.idx = loo.idx) WHERE r = 1)""")


def oracle_sql() -> dict[str, str]:
    ln = "CAST(l_linenumber AS VARCHAR)"
    sql: dict[str, str] = {}
    sql["scan_runs"] = _with("SELECT run_id, Vc, Fz, ap, Ra, Ra_planted FROM runs", RUNS)
    sql["clean_cast"] = f"""
SELECT {RUN_ID} AS run_id,
       {_lenient(ln)} AS c_plain,
       {_lenient('l_returnflag')} AS c_text,
       {_lenient(f"{ln} || 'd'")} AS c_suffix,
       {_lenient(f"' ' || {ln} || ' '")} AS c_padded,
       {_lenient(f"{ln} || 'e1'")} AS c_sci,
       {_lenient(f"'1_' || {ln}")} AS c_underscore,
       {_lenient(f"'0x' || {ln}")} AS c_hex
FROM lineitem"""
    sql["clean_runs"] = _with(
        "SELECT run_id, Vc, Fz, ap, Ra FROM runs WHERE Vc IS NOT NULL AND NOT isnan(Vc) AND Fz IS NOT NULL "
        "AND NOT isnan(Fz) AND ap IS NOT NULL AND NOT isnan(ap) AND Ra IS NOT NULL AND NOT isnan(Ra)", RUNS)
    sql["dense_index"] = _with(
        "SELECT run_id, CAST(row_number() OVER (ORDER BY md5(run_id)) - 1 AS BIGINT) AS idx FROM runs", RUNS)
    sql["feature_matrix_15"] = _matrix(F15, FEAT15, 12)
    sql["feature_matrix_12"] = _matrix(F12, FEAT12, 12)
    sql["sample_count"] = _with("SELECT count(*) AS n_samples, 3 AS n_features FROM runs", RUNS)
    sql["train_test_counts"] = _with(
        "SELECT fold, CAST((SELECT count(*) FROM folded) - count(*) AS BIGINT) AS n_train, count(*) AS n_test "
        "FROM folded GROUP BY fold", FOLDED)
    sql["feat_squares"] = _with("SELECT run_id, Vc2, Fz2, ap2 FROM feat", FEAT15)
    sql["feat_interactions"] = _with("SELECT run_id, Vc_Fz, Vc_ap, Fz_ap FROM feat", FEAT15)
    sql["feat_ratios"] = _with("SELECT run_id, Vc_Fz_ratio, Fz_ap_ratio, Vc_ap_ratio FROM feat", FEAT15)
    sql["feat_ratios_raw"] = _with('SELECT run_id, "Vc/Fz", "Fz/ap", "Vc/ap" FROM feat', FEAT12)
    sql["feat_logs"] = _with(
        f"SELECT run_id, {r6('log_Vc')} AS log_Vc, {r6('log_Fz')} AS log_Fz, {r6('log_ap')} AS log_ap FROM feat", FEAT15)
    sql["feat_logs_raw"] = _with(
        f"SELECT run_id, {r6('log_Vc')} AS log_Vc, {r6('log_Fz')} AS log_Fz, {r6('log_ap')} AS log_ap FROM feat", FEAT12)
    sql["engineered_features"] = _with(
        "SELECT run_id, Vc2, Fz2, ap2, Vc_Fz, Vc_ap, Fz_ap, Vc_Fz_ratio, Fz_ap_ratio, Vc_ap_ratio, "
        f"{r6('log_Vc')} AS log_Vc, {r6('log_Fz')} AS log_Fz, {r6('log_ap')} AS log_ap FROM feat", FEAT15)
    sql["poly_features_d2"] = _poly_d2(F12)
    sql["poly_features_d3"] = _poly_sums(3)
    sql["poly_features_d4"] = _poly_sums(4)
    sql["robust_scale"] = _robust_scale()
    sql["fold_robust_stats"] = _fold_robust()
    sql["stacking_predict_nested"] = _nested_stacking()
    yj_names = {-1.0: "yj_m1", 0.0: "yj_0", 0.5: "yj_0p5", 2.0: "yj_2", 3.0: "yj_3"}
    sql["yeo_johnson_apply"] = (
        "SELECT event_id, v, " + ", ".join(f"{r6(_yj('v', lam))} AS {nm}" for lam, nm in yj_names.items())
        + " FROM (SELECT event_id, value - 50.0::DOUBLE AS v FROM events)")
    sql["yeo_johnson_fit"] = _with(
        f"SELECT {r6('lam')} AS lambda, round(loglik * 10000.0::DOUBLE) / 10000.0::DOUBLE + 0.0 AS loglik, lam = (SELECT lam FROM bestlam) AS best FROM fit",
        "ev AS (SELECT value FROM events)," + _yj_fit_cte("ev", "value"))
    std_cols = ["Vc", "Fz", "ap", "Ra_planted"]
    stdsel = ", ".join(
        f"{r6(f'({c} - (SELECT avg({c}) FROM runs)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END FROM runs)')} AS {c}"
        for c in std_cols)
    sql["standardize"] = _with(f"SELECT run_id, {stdsel} FROM runs", RUNS)
    sql["target_roundtrip"] = _with(f"""
SELECT run_id, y, {r6('lam')} AS lambda, {r6('(t0 - m) / sd')} AS t,
       {r6(_yj_inv_col('((t0 - m) / sd) * sd + m', 'lam'))} AS back
FROM (SELECT run_id, y, lam, {_yj_col('y', 'lam')} AS t0 FROM ry, bestlam) z,
     (SELECT avg(t0) AS m, CASE WHEN stddev_pop(t0) = 0 THEN 1.0 ELSE stddev_pop(t0) END AS sd
      FROM (SELECT {_yj_col('y', 'lam')} AS t0 FROM ry, bestlam)) st""",
        RUNS + ",\nry AS (SELECT run_id, Ra_planted AS y FROM runs)," + _yj_fit_cte("ry", "y"))
    sql["target_normalize"] = _with(f"""
SELECT run_id, y, {r6('(y - m) / sd')} AS z, {r6('((y - m) / sd) * sd + m')} AS back
FROM (SELECT run_id, Ra_planted AS y FROM runs) r,
     (SELECT avg(Ra_planted) AS m, CASE WHEN stddev_pop(Ra_planted) = 0 THEN 1.0 ELSE stddev_pop(Ra_planted) END AS sd FROM runs) s""",
        RUNS)
    sql["quantile_edges"] = _with(
        f"SELECT CAST(i - 1 AS INTEGER) AS edge_idx, {r6('e[i]')} AS edge FROM edges, range(1, len(e) + 1) t(i)",
        FOLDED)
    sql["stratified_bins"] = _with("SELECT run_id, Ra_planted, bin FROM binned", FOLDED)
    sql["stratified_kfold"] = _with("SELECT run_id, bin, fold FROM folded", FOLDED)
    sql["seeded_shuffle"] = _with(
        f"SELECT run_id, CAST(row_number() OVER (ORDER BY md5('{SEED}:' || run_id)) - 1 AS BIGINT) AS shuffle_pos FROM runs",
        RUNS)
    sql["permute_column"] = _with(f"""
SELECT a.run_id, a.Vc, b.Vc AS Vc_perm
FROM (SELECT run_id, Vc, row_number() OVER (ORDER BY md5('{SEED}:' || run_id)) AS r FROM runs) a
JOIN (SELECT Vc, row_number() OVER (ORDER BY md5('{SEED}:0:' || run_id)) AS r FROM runs) b
ON a.r = b.r""", RUNS)
    sql["scatter_binned"] = _with("""
SELECT param, CAST(coalesce(least(floor((x - xmn) / nullif(xmx - xmn, 0) * 20), 19), 0) AS INTEGER) AS xbin,
       CAST(coalesce(least(floor((y - ymn) / nullif(ymx - ymn, 0) * 20), 19), 0) AS INTEGER) AS ybin, count(*) AS count
FROM (SELECT param, x, y, min(x) OVER (PARTITION BY param) AS xmn, max(x) OVER (PARTITION BY param) AS xmx,
             min(y) OVER () AS ymn, max(y) OVER () AS ymx
      FROM (SELECT 'Vc' AS param, Vc AS x, Ra_planted AS y FROM runs UNION ALL SELECT 'Fz', Fz, Ra_planted FROM runs
            UNION ALL SELECT 'ap', ap, Ra_planted FROM runs))
GROUP BY 1, 2, 3""", RUNS)
    sql["oof_union"] = _with(f"SELECT run_id, fold, y, {r6('pred_svr')} AS pred_svr, {r6('pred_gpr')} AS pred_gpr FROM oof", OOF)
    sql["meta_matrix"] = _with(f"SELECT run_id, y, {r6('pred_svr')} AS pred_svr, {r6('pred_gpr')} AS pred_gpr FROM oof", OOF)
    sql["weighted_ensemble"] = _with(
        f"SELECT run_id, fold, y, {r6('pred_svr')} AS pred_svr, {r6('pred_gpr')} AS pred_gpr, {r6('alpha')} AS alpha, "
        f"{r6('pred_ens')} AS pred_ens FROM blended", BLEND)
    sql["metrics_report"] = metrics_report()
    sql["pooled_oof_mse"] = _with(f"""
SELECT model, {r6('sum(s) / sum(n)')} AS pooled_mse, {r6('avg(s / n)')} AS mean_fold_mse, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT 'SVR' AS model, fold, count(*) AS n, sum((pred_svr - y) * (pred_svr - y)) AS s FROM oof GROUP BY fold
      UNION ALL
      SELECT 'GPR', fold, count(*), sum((pred_gpr - y) * (pred_gpr - y)) FROM oof GROUP BY fold)
GROUP BY model""", OOF)
    sql["ensemble_alpha"] = _with(f"SELECT {r6('alpha')} AS alpha, {r6('(A - 2.0 * alpha * B + alpha * alpha * C) / n')} AS mse FROM balpha", BLEND)
    trials = f"""
trials AS (SELECT CAST(t AS INTEGER) AS trial_id,
                  ('0x' || substr(md5('{SEED}:ensemble:' || t || ':alpha'), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS alpha
           FROM range(80) r(t)),
tscored AS (SELECT trial_id, alpha, (A - 2.0 * alpha * B + alpha * alpha * C) / n AS mse FROM trials, bstats)"""
    sql["ensemble_trials"] = _with(f"SELECT trial_id, alpha, {r6('mse')} AS mse FROM tscored", BLEND + "," + trials)
    sql["best_trial"] = _with(
        f"SELECT trial_id, alpha, {r6('mse')} AS mse FROM tscored ORDER BY mse, trial_id LIMIT 1", BLEND + "," + trials)
    sql["ridgecv_stacking"] = _with(
        f"SELECT {r6('alpha')} AS alpha, {r6('loo_mse')} AS loo_mse, {r6('intercept')} AS intercept, "
        f"{r6('coef_svr')} AS coef_svr, {r6('coef_gpr')} AS coef_gpr, idx = (SELECT idx FROM chosen) AS selected FROM ridge",
        STACK)
    sql["stacking_predict"] = _with(f"SELECT run_id, y, {r6('pred_stack')} AS pred_stack FROM stacked", STACK)
    sql["stacking_weights"] = _with(
        f"SELECT {r6('alpha')} AS alpha, "
        f"{r6('CASE WHEN coef_svr + coef_gpr <> 0 THEN coef_svr / (coef_svr + coef_gpr) ELSE coef_svr END')} AS weight_svr, "
        f"{r6('CASE WHEN coef_svr + coef_gpr <> 0 THEN coef_gpr / (coef_svr + coef_gpr) ELSE coef_gpr END')} AS weight_gpr "
        "FROM chosen", STACK)
    sql["permutation_importance"] = _with(
        f"SELECT method, feature, {r6('importance')} AS importance, {r6('std')} AS std FROM pimp", _importance_cte())
    sql["importance_grouped"] = _with(
        f"SELECT method, variable, {r6('importance')} AS importance, {r6('std')} AS std FROM grouped", _grouped_cte(LINEAGE))
    sql["importance_grouped_literal"] = _with(
        f"SELECT method, variable, {r6('importance')} AS importance, {r6('std')} AS std FROM grouped", _grouped_cte(LITERAL))
    sql["importance_group_std"] = _with(
        f"SELECT method, variable, {r6('std')} AS std FROM grouped", _grouped_cte(LINEAGE))
    sql["importance_normalize"] = _with(
        f"SELECT method, variable, {r6('importance')} AS importance FROM normed", _grouped_cte(LINEAGE))
    sql["importance_table"] = _with(f"""
SELECT variable,
       {r6("max(CASE WHEN method = 'Formula (Fz/ap)' THEN importance END)")} AS "Formula (Fz/ap)",
       {r6("max(CASE WHEN method = 'Formula (Fz x ap)' THEN importance END)")} AS "Formula (Fz x ap)"
FROM normed GROUP BY variable""", _grouped_cte(LINEAGE))
    sql["sensitivity_mean"] = _with(
        f"SELECT variable, {r6('avg(importance)')} AS mean_importance FROM normed GROUP BY variable", _grouped_cte(LINEAGE))
    sql["target_histogram"] = _histogram()
    sql["scatter_by_param"] = _with("""
SELECT run_id, 'Vc' AS param, Vc AS x, Ra_planted AS y FROM runs
UNION ALL SELECT run_id, 'Fz', Fz, Ra_planted FROM runs
UNION ALL SELECT run_id, 'ap', ap, Ra_planted FROM runs""", RUNS)
    sql["actual_vs_predicted"] = _with(f"""
SELECT 'SVR' AS model, run_id, y AS actual, {r6('pred_svr')} AS predicted FROM blended
UNION ALL SELECT 'GPR', run_id, y, {r6('pred_gpr')} FROM blended
UNION ALL SELECT 'ENSEMBLE', run_id, y, {r6('pred_ens')} FROM blended""", BLEND)
    sql["actual_vs_predicted_bounds"] = _with("SELECT min(y) AS mn, max(y) AS mx FROM oof", OOF)
    sql["model_comparison_series"] = _with(
        f"SELECT sample_idx, y AS actual, {r6('pred_svr')} AS SVR, {r6('pred_gpr')} AS GPR, {r6('pred_ens')} AS Ensemble FROM sidx",
        _sample_idx_cte())
    return sql
