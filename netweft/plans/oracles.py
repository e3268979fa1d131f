"""The queries of the catalog in plain SQL, by joins where the library has windows, and the other way round."""
from __future__ import annotations

from netweft.functions import formulas as X
from netweft.operators.greedy import bernoulli_gain_formula, categorical_gain_formula, cell_gain_formula, edge_gain_formula, poisson_gain_formula
from netweft.plans.fixtures import ALPHA, PI, Q, param_formula

_q = range(Q)
_NET = """net AS (SELECT CAST(year(a.l_shipdate) - 1995 AS INT) AS t, a.l_partkey AS src, b.l_partkey AS dst, CAST(count(*) AS BIGINT) AS w
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey AND year(a.l_shipdate) = year(b.l_shipdate)
GROUP BY 1, 2, 3)"""
_SYM = "sym AS (SELECT t, src, dst, CAST(1 AS DOUBLE) AS w FROM net UNION ALL SELECT t, dst, src, CAST(1 AS DOUBLE) FROM net)"
_PRES = "pres AS (SELECT DISTINCT src AS node, t FROM sym)"
_LAB = f"lab AS (SELECT node, t, {X.label_of('node', 't', Q)} AS q FROM pres)"
_PRED = f"pred AS (SELECT node, t, CAST((node + t) % {Q} AS INT) AS r FROM pres)"
_SUCC = """succ AS (SELECT CAST(LEAST(4, (day(ts) - 1) // 6) AS INT) AS t, user_id AS src, nxt AS dst, CAST(count(*) AS BIGINT) AS w
FROM (SELECT ts, user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events) e WHERE nxt IS NOT NULL AND nxt <> user_id GROUP BY 1, 2, 3)"""
_CONT = "cont AS (SELECT l.t, l.q, p.r, CAST(count(*) AS BIGINT) AS n FROM lab l JOIN pred p ON l.node = p.node AND l.t = p.t GROUP BY 1, 2, 3)"
_YEARS = """years AS (SELECT l_partkey AS node, CAST(year(l_shipdate) - 1995 AS INT) AS t, CAST(count(*) AS DOUBLE) AS n,
CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) AS n_a, CAST(count(*) FILTER (l_returnflag = 'N') AS DOUBLE) AS n_n, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS n_r, """ + ", ".join(
    f"CAST(max(CASE WHEN l_returnflag = '{a}' AND l_linestatus = '{b}' THEN 1 ELSE 0 END) AS DOUBLE) AS pair{i}" for i, (a, b) in enumerate([("A", "F"), ("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O")])
) + " FROM lineitem GROUP BY 1, 2)"
_YLAB = f"ylab AS (SELECT *, {X.label_of('node', 't', Q)} AS q FROM years)"

_MAR = f"mar AS (SELECT node, t, {', '.join(f'{e} AS p{i}' for i, e in enumerate(X.planted('q', 'node', 't', Q)))} FROM lab)"
_ST = (
    "st AS (SELECT a.node, a.t, "
    + ", ".join(f"a.p{i}, CASE WHEN b.node IS NOT NULL THEN a.p{i} END AS fwd{i}, b.p{i} AS bwd{i}" for i in _q)
    + " FROM mar a LEFT JOIN mar b ON a.node = b.node AND b.t = a.t + 1)"
)
_BLK = (
    "blk AS (SELECT s.t, "
    + ", ".join(f"total / n / (n * {Q + 1}) * {2 if i == j else 1} AS b{i}{j}" for i in _q for j in _q)
    + " FROM (SELECT t, sum(w) AS total FROM sym GROUP BY t) s JOIN (SELECT t, count(*) AS n FROM pres GROUP BY t) p ON s.t = p.t)"
)
_PSI = X.planted("q", "send * 13 + recv", "t", Q)
_MSG = (
    "msg AS (SELECT t, recv, send, w_fwd, w_rev, "
    + ", ".join(f"{e} AS psi{i}" for i, e in enumerate(_PSI))
    + " FROM (SELECT s.t, s.dst AS recv, s.src AS send, s.w AS w_fwd, s.w AS w_rev, l.q FROM sym s JOIN lab l ON l.node = s.src AND l.t = s.t) m)"
)
_FLD = "fld AS (SELECT m.*, " + ", ".join(f"{X.dot(X.cols('psi', Q), [f'b{r}{k}' for r in _q])} AS f{k}" for k in _q) + " FROM msg m JOIN blk b ON m.t = b.t)"
_H = (
    "h AS (SELECT b.t, "
    + ", ".join(f"{X.dot([f's{r}' for r in _q], [f'b{r}{k}' for r in _q])} AS h{k}" for k in _q)
    + " FROM blk b JOIN (SELECT t, "
    + ", ".join(f"sum(p{k}) AS s{k}" for k in _q)
    + " FROM mar GROUP BY t) s ON s.t = b.t)"
)
_lit = lambda x: f"CAST({float(x)!r} AS DOUBLE)"
_TT = (
    "tt AS (SELECT a.*, b.node IS NOT NULL AND b.fwd0 IS NOT NULL AS continues, "
    + ", ".join(f"CASE WHEN b.fwd0 IS NULL THEN {_lit(0)} ELSE ln({X.dot([f'b.fwd{r}' for r in _q], [_lit(PI[r][k]) for r in _q])}) END AS lf{k}" for k in _q)
    + ", "
    + ", ".join(f"CASE WHEN a.bwd0 IS NULL THEN {_lit(0)} ELSE ln({X.dot([f'a.bwd{r}' for r in _q], [_lit(PI[k][r]) for r in _q])}) END AS lb{k}" for k in _q)
    + " FROM st a LEFT JOIN st b ON a.node = b.node AND b.t = a.t - 1)"
)
_SITE = "site AS (SELECT recv AS node, t, " + ", ".join(f"sum({X.safe_ln(f'f{k}')}) AS s{k}" for k in _q) + " FROM fld GROUP BY 1, 2)"
_START = f"ln({_lit(ALPHA[0])})"
_PRE = (
    "pre AS (SELECT tt.*, "
    + ", ".join(f"s{k} - h{k} + lb{k} + CASE WHEN tt.t = 0 THEN {_START} ELSE 0 END AS pre{k}" for k in _q)
    + " FROM tt JOIN site ON tt.node = site.node AND tt.t = site.t JOIN h ON h.t = tt.t)"
)
_W = "wt AS (SELECT pre.*, " + ", ".join(f"pre{k} + CASE WHEN t = 0 THEN 0 WHEN continues THEN lf{k} ELSE {_START} END AS w{k}" for k in _q) + " FROM pre)"
_STATE = [_NET, _SYM, _PRES, _LAB, _MAR, _ST, _BLK]
_SWEEP = [*_STATE, _MSG, _FLD, _H, _TT, _SITE, _PRE, _W]
_PAIR = (
    "pairs AS (SELECT x.t, x.recv, x.send, x.w_fwd, "
    + ", ".join(f"(x.psi{r} * y.psi{k}" + (f" + x.psi{k} * y.psi{r}" if r != k else "") + f") * b{r}{k} AS u{r}{k}" for r in _q for k in _q)
    + " FROM msg x JOIN msg y ON x.t = y.t AND x.recv = y.send AND x.send = y.recv JOIN blk b ON b.t = x.t)"
)
_ALL = [f"u{r}{k}" for r in _q for k in _q]
_E = "e AS (SELECT t, recv, send, w_fwd, " + ", ".join(f"{u} / {X.add(_ALL)} AS e{u[1:]}" for u in _ALL) + " FROM pairs)"
_TP = "tp AS (SELECT node, t, " + ", ".join(f"fwd{r} * bwd{k} * {_lit(PI[r][k])} AS u{r}{k}" for r in _q for k in _q) + " FROM st WHERE bwd0 IS NOT NULL)"
_G = "g AS (SELECT node, t, " + ", ".join(f"{u} / {X.add(_ALL)} AS g{u[1:]}" for u in _ALL) + " FROM tp)"
_MSGW = _MSG.replace("s.w AS w_fwd, s.w AS w_rev", "n.w AS w_fwd, n.w AS w_rev").replace(
    "FROM sym s JOIN lab", "FROM sym s JOIN (SELECT t, src, dst, CAST(w AS DOUBLE) / 2 AS w FROM net UNION ALL SELECT t, dst, src, CAST(w AS DOUBLE) / 2 FROM net) n ON n.t = s.t AND n.src = s.src AND n.dst = s.dst JOIN lab"
)
_DEGW = "degw AS (SELECT node, t, sum(w) AS d FROM (SELECT src AS node, t, CAST(w AS DOUBLE) / 2 AS w FROM net UNION ALL SELECT dst, t, CAST(w AS DOUBLE) / 2 FROM net) z GROUP BY 1, 2)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def rnd(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE AS {name}"


def _block_long(table: str, prefix: str, name: str = "v", digits: int = 8) -> str:
    """(t, q, r, v) of a wide table."""
    return " UNION ALL ".join(f"SELECT t, {r} AS q, {k} AS r, {rnd(f'{prefix}{r}{k}', name, digits)} FROM {table}" for r in _q for k in _q)


_MIX = 0.2


def _loglik(dist: str) -> str:
    th = lambda k: f"({param_formula(dist, k)})"
    if dist == "poisson":
        e = f"n * ln({th(0)}) - {th(0)} - lgamma(n + 1)"
    elif dist == "indep bernoulli":
        e = X.add([f"(pair{k} * ln({th(k)}) + (1 - pair{k}) * {X.safe_ln(f'(1 - {th(k)})')})" for k in range(6)])
    elif dist == "categorical":
        e = X.add([f"CASE WHEN node % 5 = {k} THEN ln({th(k)}) ELSE 0 END" for k in range(5)])
    else:
        e = X.add([f"({c} * ln({th(k)}) - lgamma({c} + 1))" for k, c in enumerate(("n_a", "n_n", "n_r"))])
    return _with(_YEARS) + f"SELECT node, t, q, {rnd(e, 'loglik')} FROM years, (SELECT CAST(range AS INT) AS q FROM range({Q})) g WHERE t BETWEEN 0 AND 6"


def _mstep(dist: str) -> str:
    columns = {"poisson": ["n"], "indep bernoulli": [f"pair{i}" for i in range(6)], "multinomial": ["n_a", "n_n", "n_r"], "categorical": [f"CASE WHEN node % 5 = {i} THEN 1.0 ELSE 0.0 END" for i in range(5)]}[dist]
    below = "count(*)" if dist in ("poisson", "indep bernoulli") else "sum(" + " + ".join(f"({c})" for c in columns) + ")"
    return _with(_YEARS, _YLAB) + " UNION ALL ".join(f"SELECT t, q, {l} AS l, {rnd(f'sum(CAST({c} AS DOUBLE)) / {below}', 'v')} FROM ylab GROUP BY t, q" for l, c in enumerate(columns))


def _gain(columns: list[str], formula: str, total: bool = False) -> str:
    """Gains of a field's positions, summed; total: less the same of their sum."""
    cells = [f"SELECT node, t, q, {i} AS l, CAST({c} AS DOUBLE) AS x FROM ylab" for i, c in enumerate(columns)]
    if total:
        cells.append(f"SELECT node, t, q, -1 AS l, {' + '.join(columns)} AS x FROM ylab")
    lg = "lg AS (" + " UNION ALL ".join(cells) + ")"
    ag = "ag AS (SELECT t, q, l, sum(x) AS s, CAST(count(*) AS DOUBLE) AS n FROM lg GROUP BY 1, 2, 3)"
    sign = "CASE WHEN l < 0 THEN -1 ELSE 1 END"
    return _with(_YEARS, _YLAB, lg, ag) + (
        f"SELECT node, t, q, r, {rnd(f'sum({sign} * ({formula}))', 'gain')} FROM (SELECT lg.node, lg.t, lg.q, g.r, lg.l, lg.x, a.s AS x_q, a.n AS n_q, coalesce(b.s, 0.0) AS x_r, coalesce(b.n, 0.0) AS n_r"
        f" FROM lg JOIN (SELECT CAST(range AS INT) AS r FROM range({Q})) g ON g.r <> lg.q JOIN ag a ON a.t = lg.t AND a.q = lg.q AND a.l = lg.l LEFT JOIN ag b ON b.t = lg.t AND b.q = g.r AND b.l = lg.l) w GROUP BY 1, 2, 3, 4"
    )


_beta_cell = lambda r, k: f"dn{r} / dd{r}" if r == k else f"(n{r}{k} / (p{r} * p{k}) + n{k}{r} / (p{k} * p{r})) / 2"

ORACLES = {
    "net_edges": _with(_NET) + "SELECT t, src, dst, w FROM net",
    "net_edges_symmetric": _with(_NET, _SYM) + "SELECT t, src, dst, w FROM sym",
    "net_presence": _with(_NET, _SYM, _PRES) + "SELECT node, t FROM pres",
    "net_transition_presence": _with(_NET, _SYM, _PRES) + "SELECT a.node, a.t FROM pres a JOIN pres b ON a.node = b.node AND b.t = a.t + 1",
    "net_new_arrivals": _with(_NET, _SYM, _PRES) + "SELECT a.node, a.t FROM pres a LEFT JOIN pres b ON a.node = b.node AND b.t = a.t - 1 WHERE b.node IS NULL",
    "net_degrees": _with(_SUCC) + "SELECT node, t, sum(i) AS d_in, sum(o) AS d_out FROM (SELECT dst AS node, t, CAST(w AS DOUBLE) AS i, 0.0::DOUBLE AS o FROM succ UNION ALL SELECT src, t, 0.0, w FROM succ) x GROUP BY 1, 2",
    "net_density": _with(_NET, _SYM) + f"SELECT t, n_nodes, CAST(count(*) AS BIGINT) AS n_edges, {rnd('CAST(sum(w) AS DOUBLE) / (n_nodes * n_nodes)', 'density', 9)} FROM net, (SELECT CAST(count(DISTINCT src) AS BIGINT) AS n_nodes FROM sym) x GROUP BY t, n_nodes",
    "net_missing_nodes": _with(_NET, _SYM, _PRES) + "SELECT g.t, CAST(count(*) FILTER (p.node IS NULL) AS BIGINT) AS n_missing FROM (SELECT n.node, d.t FROM (SELECT DISTINCT node FROM pres) n, (SELECT DISTINCT t FROM pres) d) g LEFT JOIN pres p ON p.node = g.node AND p.t = g.t GROUP BY g.t",
    "net_succession_directed": _with(_SUCC) + "SELECT t, src, dst, w FROM succ",
    "net_last_snapshots": _with(_NET) + "SELECT CAST(t - 3 AS INT) AS t, src, dst, w FROM net WHERE t >= (SELECT max(t) FROM net) - 3",
    "group_sizes": _with(_NET, _SYM, _PRES, _LAB) + "SELECT t, q, CAST(count(*) AS BIGINT) AS n FROM lab GROUP BY 1, 2",
    "group_degrees": _with(_NET, _SYM, _PRES, _LAB) + "SELECT l.t, l.q, sum(d.i) AS k_in, sum(d.o) AS k_out FROM lab l JOIN (SELECT dst AS node, t, CAST(w AS DOUBLE) AS i, 0.0::DOUBLE AS o FROM net UNION ALL SELECT src, t, 0.0, w FROM net) d ON d.node = l.node AND d.t = l.t GROUP BY 1, 2",
    "block_edge_counts": _with(_NET, _SYM, _PRES, _LAB) + "SELECT n.t, a.q, b.q AS r, CAST(sum(n.w) AS BIGINT) AS m FROM net n JOIN lab a ON a.node = n.src AND a.t = n.t JOIN lab b ON b.node = n.dst AND b.t = n.t GROUP BY 1, 2, 3",
    "effective_beta": _with(_NET, _SYM, _PRES, _LAB, "sz AS (SELECT t, q, count(*) AS n FROM lab GROUP BY 1, 2)", "bl AS (SELECT s.t, a.q, b.q AS r, sum(s.w) AS m FROM sym s JOIN lab a ON a.node = s.src AND a.t = s.t JOIN lab b ON b.node = s.dst AND b.t = s.t GROUP BY 1, 2, 3)")
    + f"SELECT x.t, x.q, y.q AS r, {rnd('coalesce(m, 0) / (x.n * y.n) / 2', 'beta', 9)} FROM sz x JOIN sz y ON x.t = y.t LEFT JOIN bl ON bl.t = x.t AND bl.q = x.q AND bl.r = y.q",
    "effective_pi": _with(_NET, _SYM, _PRES, _LAB, "mv AS (SELECT a.q, b.q AS r, count(*) AS n FROM lab a JOIN lab b ON a.node = b.node AND b.t = a.t + 1 GROUP BY 1, 2)")
    + f"SELECT mv.q, r, CAST(n AS BIGINT) AS n, {rnd('n / CAST(total AS DOUBLE)', 'pi')} FROM mv JOIN (SELECT q, sum(n) AS total FROM mv GROUP BY q) s ON s.q = mv.q",
    "majority_label": _with(_NET, _SYM, _PRES, _LAB) + "SELECT node, q, n FROM (SELECT node, q, CAST(count(*) AS BIGINT) AS n, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, q) AS k FROM lab GROUP BY node, q) x WHERE k = 1",
    "induced_subgraph": _with(_NET, _SYM, _PRES, _LAB) + "SELECT n.t, n.src, n.dst, n.w FROM net n JOIN lab a ON a.node = n.src AND a.t = n.t AND a.q = 1 JOIN lab b ON b.node = n.dst AND b.t = n.t AND b.q = 1",
    "contingency": _with(_NET, _SYM, _PRES, _LAB, _PRED, _CONT) + "SELECT t, q, r, n FROM cont",
    "ari_by_time": _with(_NET, _SYM, _PRES, _LAB, _PRED, _CONT)
    + "SELECT s.t, " + rnd("(s.v - a.v * b.v / (n.v * (n.v - 1) / 2)) / ((a.v + b.v) / 2 - a.v * b.v / (n.v * (n.v - 1) / 2))", "ari")
    + " FROM (SELECT t, sum(n * (n - 1) / 2.0::DOUBLE) AS v FROM cont GROUP BY t) s JOIN (SELECT t, sum(n * (n - 1) / 2.0::DOUBLE) AS v FROM (SELECT t, q, sum(n) AS n FROM cont GROUP BY 1, 2) x GROUP BY t) a ON a.t = s.t JOIN (SELECT t, sum(n * (n - 1) / 2.0::DOUBLE) AS v FROM (SELECT t, r, sum(n) AS n FROM cont GROUP BY 1, 2) x GROUP BY t) b ON b.t = s.t JOIN (SELECT t, CAST(sum(n) AS DOUBLE) AS v FROM cont GROUP BY t) n ON n.t = s.t",
    "mutual_information": _with(_NET, _SYM, _PRES, _LAB, _PRED, _CONT, "m AS (SELECT t, q, r, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY t, q) AS DOUBLE) AS a, CAST(sum(n) OVER (PARTITION BY t, r) AS DOUBLE) AS b, CAST(sum(n) OVER (PARTITION BY t) AS DOUBLE) AS tot FROM cont)")
    + f"SELECT t, {rnd('sum(n / tot * ln(n * tot / (a * b)))', 'mi')} FROM m GROUP BY t",
    "nmi_by_time": _with(_NET, _SYM, _PRES, _LAB, _PRED, _CONT, "m AS (SELECT t, q, r, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY t, q) AS DOUBLE) AS a, CAST(sum(n) OVER (PARTITION BY t, r) AS DOUBLE) AS b, CAST(sum(n) OVER (PARTITION BY t) AS DOUBLE) AS tot FROM cont)")
    + f"SELECT t, {rnd('sum(n / tot * ln(n * tot / (a * b))) / (-(sum(n / tot * ln(a / tot)) + sum(n / tot * ln(b / tot))) / 2)', 'nmi')} FROM m GROUP BY t",
    "max_overlap": _with(_NET, _SYM, _PRES, _LAB, _PRED, _CONT, "c AS (SELECT q, r, sum(n) AS n FROM cont GROUP BY 1, 2)", "d AS (SELECT CAST(range AS INT) AS v FROM range(4))")
    + f"SELECT {rnd('(max(m) / (SELECT CAST(sum(n) AS DOUBLE) FROM cont) - 0.25) / 0.75', 'overlap')} FROM (SELECT a.v, b.v, e.v, f.v, (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM c WHERE (r = 0 AND q = a.v) OR (r = 1 AND q = b.v) OR (r = 2 AND q = e.v) OR (r = 3 AND q = f.v)) AS m FROM d a, d b, d e, d f WHERE a.v <> b.v AND a.v <> e.v AND a.v <> f.v AND b.v <> e.v AND b.v <> f.v AND e.v <> f.v) x",
    "meta_bernoulli_topk": _with("bf AS (SELECT l_partkey AS node, CAST(year(l_shipdate) - 1995 AS INT) AS t, CAST(l_suppkey % 30 AS INT) AS l, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3)") + "SELECT node, t, l FROM (SELECT *, row_number() OVER (PARTITION BY node, t ORDER BY v DESC, l DESC) AS k FROM bf) x WHERE k <= 3",
    "meta_categorical_top1": _with(_YEARS) + "SELECT node, t, CASE WHEN n_r >= n_a AND n_r >= n_n THEN 2 WHEN n_n >= n_a THEN 1 ELSE 0 END AS l FROM years",
    "meta_poisson_shift": _with(_YEARS) + "SELECT node, t, n - (SELECT min(n) FROM years) AS x FROM years",
    "meta_multinomial_counts": _with(_YEARS, "lv AS (SELECT node, t, n_a * 0.37::DOUBLE AS a, n_n * 0.37::DOUBLE AS b, n_r * 0.37::DOUBLE AS c FROM years)", "ex AS (SELECT node, t, least(CASE WHEN a > 0 THEN a END, CASE WHEN b > 0 THEN b END, CASE WHEN c > 0 THEN c END) AS lo, greatest(a, b, c) AS hi, a, b, c FROM lv)")
    + "SELECT node, t, " + ", ".join(f"CASE WHEN {c} > 0 THEN CASE WHEN hi > lo THEN round_even(({c} - lo) / (hi - lo) * 1000 + 1, 0) ELSE 1.0::DOUBLE END ELSE {c} END AS x{i}" for i, c in enumerate("abc")) + " FROM ex",
    "meta_drop_null_dims": _with(_YEARS, "lg AS (" + " UNION ALL ".join(f"SELECT node, t, {i} AS l, pair{i} AS v FROM years" for i in range(6)) + ")") + "SELECT node, t, CAST(k - 1 AS INT) AS l, v FROM lg JOIN (SELECT l AS ol, row_number() OVER (ORDER BY l) AS k FROM lg GROUP BY l HAVING sum(v) > 0) d ON d.ol = lg.l",
    "meta_extract": "SELECT 0 AS s, p_partkey AS node, 0 AS t, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT 1, p_partkey, 0, p_retailprice FROM part",
    **{f"loglik_{n}": _loglik(d) for n, d in (("poisson", "poisson"), ("bernoulli", "indep bernoulli"), ("categorical", "categorical"), ("multinomial", "multinomial"))},
    **{f"mstep_{n}": _mstep(d) for n, d in (("poisson", "poisson"), ("bernoulli", "indep bernoulli"), ("categorical", "categorical"), ("multinomial", "multinomial"))},
    "beta_noninformative_init": _with(*_STATE) + _block_long("blk", "b", "beta", 9),
    "beta_planted_init": _with(_NET, _SYM, _PRES, _LAB, _MAR, _ST, _BLK, "sz AS (SELECT t, q, count(*) AS n FROM lab GROUP BY 1, 2)", "bl AS (SELECT s.t, a.q, b.q AS r, sum(s.w) AS m FROM sym s JOIN lab a ON a.node = s.src AND a.t = s.t JOIN lab b ON b.node = s.dst AND b.t = s.t GROUP BY 1, 2, 3)", "lb AS (" + " UNION ALL ".join(f"SELECT t, {r} AS q, {k} AS r, b{r}{k} AS v FROM blk" for r in _q for k in _q) + ")")
    + f"SELECT x.t, x.q, y.q AS r, {rnd('0.6::DOUBLE * coalesce(m, 0) / (x.n * y.n) + 0.4::DOUBLE * lb.v', 'beta', 9)} FROM sz x JOIN sz y ON x.t = y.t JOIN lb ON lb.t = x.t AND lb.q = x.q AND lb.r = y.q LEFT JOIN bl ON bl.t = x.t AND bl.q = x.q AND bl.r = y.q",
    "lambda_planted_init": _with(_NET, _SYM, _PRES, _LAB, "ws AS (SELECT t, src, dst, CAST(w AS DOUBLE) / 2 AS w FROM net UNION ALL SELECT t, dst, src, CAST(w AS DOUBLE) / 2 FROM net)", "kd AS (SELECT l.t, l.q, sum(ws.w) AS k FROM ws JOIN lab l ON l.node = ws.src AND l.t = ws.t GROUP BY 1, 2)", "bl AS (SELECT s.t, a.q, b.q AS r, sum(s.w) AS m FROM ws s JOIN lab a ON a.node = s.src AND a.t = s.t JOIN lab b ON b.node = s.dst AND b.t = s.t GROUP BY 1, 2, 3)")
    + f"SELECT x.t, x.q, y.q AS r, {rnd('coalesce(m, 0) / (x.k * y.k)', 'lam', 9)} FROM kd x JOIN kd y ON x.t = y.t LEFT JOIN bl ON bl.t = x.t AND bl.q = x.q AND bl.r = y.q",
    "pi_planted_init": _with(_NET, _SYM, _PRES, _LAB, "mv AS (SELECT a.q, b.q AS r, count(*) AS n FROM lab a JOIN lab b ON a.node = b.node AND b.t = a.t + 1 GROUP BY 1, 2)")
    + f"SELECT mv.q, r, {rnd('0.6::DOUBLE * n / CAST(total AS DOUBLE) + 0.4::DOUBLE / 4', 'pi')} FROM mv JOIN (SELECT q, sum(n) AS total FROM mv GROUP BY q) s ON s.q = mv.q",
    "bp_field_terms": _with(*_STATE, _MSG, _FLD) + f"SELECT t, recv, send, {', '.join(rnd(f'f{k}', f'f{k}', 9) for k in _q)} FROM fld",
    "bp_field_terms_directed": _with(_SUCC, "bl AS (SELECT 0.01::DOUBLE AS lo)", "pr AS (SELECT t, recv, send, sum(f) AS w_fwd, sum(r) AS w_rev FROM (SELECT t, dst AS recv, src AS send, CAST(w AS DOUBLE) AS f, 0.0::DOUBLE AS r FROM succ UNION ALL SELECT t, src, dst, 0.0, w FROM succ) x GROUP BY 1, 2, 3)", f"lm AS (SELECT *, {X.label_of('send', 't', Q)} AS q FROM pr)", "ms AS (SELECT *, " + ", ".join(f"{e} AS psi{i}" for i, e in enumerate(_PSI)) + " FROM lm)")
    + "SELECT t, recv, send, " + ", ".join(
        rnd(X.dot(X.cols("psi", Q), [f"power({0.02 if r == k else (0.01 + 0.001 * (r - k))!r}::DOUBLE, w_fwd) * power({0.02 if r == k else (0.01 + 0.001 * (k - r))!r}::DOUBLE, w_rev)" for r in _q]), f"f{k}", 12) for k in _q
    ) + " FROM ms",
    "bp_external_field": _with(*_STATE, _H) + f"SELECT t, {', '.join(rnd(f'h{k}', f'h{k}') for k in _q)} FROM h",
    "bp_temporal_terms": _with(*_STATE, _TT) + f"SELECT node, t, {', '.join(rnd(f'lf{k}', f'lf{k}') for k in _q)}, {', '.join(rnd(f'lb{k}', f'lb{k}') for k in _q)} FROM tt",
    "bp_node_marginals_1sweep": _with(*_SWEEP) + f"SELECT node, t, {', '.join(rnd(e, f'p{k}') for k, e in enumerate(X.softmax(X.cols('w', Q))))} FROM wt",
    "bp_messages_1sweep": _with(*_SWEEP, "ou AS (SELECT f.t, f.recv, f.send, " + ", ".join(f"w{k} - {X.safe_ln(f'f{k}')} AS o{k}" for k in _q) + " FROM fld f JOIN wt ON wt.node = f.recv AND wt.t = f.t)")
    + f"SELECT t, send AS recv, recv AS send, {', '.join(rnd(e, f'psi{k}') for k, e in enumerate(X.softmax(X.cols('o', Q))))} FROM ou",
    "bp_temporal_messages_1sweep": _with(*_SWEEP, "bk AS (SELECT node, t, " + ", ".join(f"{e} AS k{k}" for k, e in enumerate(X.softmax(X.cols("pre", Q)))) + " FROM wt)", "ah AS (SELECT node, t, " + ", ".join(f"{e} AS a{k}" for k, e in enumerate(X.softmax([f"(w{k} - lb{k})" for k in _q]))) + " FROM wt)")
    + f"SELECT a.node, a.t, {', '.join(rnd(f'a{k}', f'fwd{k}') for k in _q)}, {', '.join(rnd(f'k{k}', f'bwd{k}') for k in _q)} FROM ah a JOIN bk b ON b.node = a.node AND b.t = a.t + 1",
    "twopoint_edge_1sweep": _with(*_STATE, _MSG, _PAIR, _E) + " UNION ALL ".join(f"SELECT t, {r} AS q, {k} AS r, {rnd(f'sum(e{r}{k})', 'v')} FROM e GROUP BY t" for r in _q for k in _q),
    "twopoint_time_1sweep": _with(*_STATE, _TP, _G) + " UNION ALL ".join(f"SELECT {r} AS q, {k} AS r, {rnd(f'sum(g{r}{k})', 'v')} FROM g" for r in _q for k in _q),
    "alpha_update": _with(*_STATE) + f"SELECT {', '.join(rnd(f'{_MIX} * avg(p{k}) + {1 - _MIX} * 0.25', f'a{k}') for k in _q)} FROM mar",
    "pi_update": _with(*_STATE, _TP, _G) + " UNION ALL ".join(f"SELECT {r} AS q, {k} AS r, {rnd(f'{_MIX}::DOUBLE * sum(g{r}{k}) / (' + ' + '.join(f'sum(g{r}{j})' for j in _q) + f') + {1 - _MIX}::DOUBLE * {PI[r][k]}', 'pi')} FROM g" for r in _q for k in _q),
    "beta_update": _with(*_STATE, _MSG, _PAIR, _E, "nu AS (SELECT t, " + ", ".join(f"sum(e{r}{k}) AS n{r}{k}" for r in _q for k in _q) + " FROM e GROUP BY t)", "sz AS (SELECT t, " + ", ".join(f"sum(p{k}) AS p{k}" for k in _q) + " FROM mar GROUP BY t)", "dg AS (SELECT " + ", ".join(f"sum(n{k}{k}) AS dn{k}, sum(p{k} * p{k}) AS dd{k}" for k in _q) + " FROM nu JOIN sz ON nu.t = sz.t)")
    + " UNION ALL ".join(f"SELECT nu.t, {r} AS q, {k} AS r, {rnd(_beta_cell(r, k), 'beta', 8)} FROM nu JOIN sz ON nu.t = sz.t, dg" for r in _q for k in _q),
    "lambda_update": _with(*_STATE, _MSGW, _PAIR, _E, _DEGW, "nu AS (SELECT t, " + ", ".join(f"sum(e{r}{k} * w_fwd) AS n{r}{k}" for r in _q for k in _q) + " FROM e GROUP BY t)", "sz AS (SELECT m.t, " + ", ".join(f"sum(p{k} * d) AS p{k}" for k in _q) + " FROM mar m JOIN degw d ON d.node = m.node AND d.t = m.t GROUP BY m.t)", "dg AS (SELECT " + ", ".join(f"sum(n{k}{k}) AS dn{k}, sum(p{k} * p{k}) AS dd{k}" for k in _q) + " FROM nu JOIN sz ON nu.t = sz.t)")
    + " UNION ALL ".join(f"SELECT nu.t, {r} AS q, {k} AS r, {rnd(_beta_cell(r, k), 'lam', 8)} FROM nu JOIN sz ON nu.t = sz.t, dg" for r in _q for k in _q),
    "bp_field_terms_dc": _with(*_STATE, _MSGW, _DEGW)
    + ", dl AS (SELECT m.*, " + ", ".join(f"w_fwd * ln(ds.d * dr.d * {0.02 if r == k else 0.01}) - ds.d * dr.d * {0.02 if r == k else 0.01} - lgamma(w_fwd + 1) AS d{r}{k}" for r in _q for k in _q)
    + " FROM msg m JOIN degw ds ON ds.node = m.send AND ds.t = m.t JOIN degw dr ON dr.node = m.recv AND dr.t = m.t) SELECT t, recv, send, "
    + ", ".join(rnd(X.dot(X.cols("psi", Q), [f"exp(d{r}{k} - greatest({', '.join(f'd{i}{j}' for i in _q for j in _q)}))" for r in _q]), f"f{k}") for k in _q) + " FROM dl",
    "free_energy": _with(*_SWEEP, _PAIR, _TP)
    + "SELECT " + rnd("edge / n", "edge") + ", " + rnd("tm / n", "time") + ", " + rnd("site / n", "site") + ", " + rnd("pair / n", "pair") + ", " + rnd("(edge + tm - site + pair) / n", "energy")
    + f" FROM (SELECT sum(ln({X.add(_ALL)})) AS edge FROM pairs) a, (SELECT sum(ln({X.add(_ALL)})) AS tm FROM tp) b, (SELECT sum(greatest(w0, w1, w2, w3) + ln({X.add([f'exp(w{k} - greatest(w0, w1, w2, w3))' for k in _q])})) AS site, count(*) AS n FROM wt) c, (SELECT sum({X.dot([f'h{k}' for k in _q], [f's{k}' for k in _q])}) AS pair FROM h JOIN (SELECT t, {', '.join(f'sum(p{k}) AS s{k}' for k in _q)} FROM mar GROUP BY t) s ON s.t = h.t) d",
    "map_labels": _with(*_STATE) + f"SELECT node, t, CAST({X.argmax(X.cols('p', Q))} AS INT) AS q FROM mar",
    "components_weak": _with(_NET, _SYM, _PRES).replace("WITH ", "WITH RECURSIVE ", 1) + ", rc AS (SELECT node, t, node AS c FROM pres UNION SELECT s.dst, s.t, rc.c FROM rc JOIN sym s ON s.src = rc.node AND s.t = rc.t WHERE s.dst > rc.c AND s.t = 0) SELECT t, node, min(c) AS component FROM rc WHERE t = 0 GROUP BY 1, 2",
    "profile_outer_join": _with(_YEARS) + "SELECT coalesce(a.node, b.node) AS node, coalesce(a.t, b.t) AS t, a.career_age, b.region FROM (SELECT node, t, n AS career_age FROM years WHERE node % 3 <> 0) a FULL OUTER JOIN (SELECT node, t, n_r AS region FROM years WHERE node % 2 = 0) b ON a.node = b.node AND a.t = b.t",
    "topics_export": _with(_YEARS) + " UNION ALL ".join(f"SELECT node, t, {i} AS topic FROM years WHERE pair{i} > 0" for i in range(6)),
    "greedy_edge_gain": _with(_NET, _SYM, _PRES, _LAB, "mm AS (SELECT s.t, a.q, b.q AS r, sum(s.w) AS m FROM sym s JOIN lab a ON a.node = s.src AND a.t = s.t JOIN lab b ON b.node = s.dst AND b.t = s.t GROUP BY 1, 2, 3)", "gr AS (SELECT CAST(range AS INT) AS g FROM range(4))", "mf AS (SELECT d.t, a.g AS q, b.g AS r, coalesce(m, 0.0) AS m FROM (SELECT DISTINCT t FROM lab) d, gr a CROSS JOIN gr b LEFT JOIN mm ON mm.t = d.t AND mm.q = a.g AND mm.r = b.g)", "kp AS (SELECT t, q, sum(m) AS kappa FROM mf GROUP BY 1, 2)", "ks AS (SELECT s.src AS node, s.t, l.q AS s, sum(s.w) AS k FROM sym s JOIN lab l ON l.node = s.dst AND l.t = s.t GROUP BY 1, 2, 3)", "kf AS (SELECT l.node, l.t, g.g AS s, coalesce(k, 0.0) AS k FROM lab l CROSS JOIN gr g LEFT JOIN ks ON ks.node = l.node AND ks.t = l.t AND ks.s = g.g)", "mo AS (SELECT l.node, l.t, l.q, g.g AS r FROM lab l, gr g WHERE g.g <> l.q)")
    + f", re AS (SELECT mo.node, mo.t, mo.q, mo.r, sum(2 * (({X.xlogx('(a.m - kf.k)')}) - ({X.xlogx('a.m')}) + ({X.xlogx('(b.m + kf.k)')}) - ({X.xlogx('b.m')}))) FILTER (kf.s <> mo.q AND kf.s <> mo.r) AS rest, sum(kf.k) AS k_i, sum(kf.k) FILTER (kf.s = mo.q) AS k_q, sum(kf.k) FILTER (kf.s = mo.r) AS k_r FROM mo JOIN kf ON kf.node = mo.node AND kf.t = mo.t JOIN mf a ON a.t = mo.t AND a.q = mo.q AND a.r = kf.s JOIN mf b ON b.t = mo.t AND b.q = mo.r AND b.r = kf.s GROUP BY 1, 2, 3, 4)"
    + f" SELECT node, t, q, r, {rnd(edge_gain_formula(), 'gain')} FROM (SELECT re.*, x.m AS m_qr, y.m AS m_qq, z.m AS m_rr, u.kappa AS kappa_q, v.kappa AS kappa_r FROM re JOIN mf x ON x.t = re.t AND x.q = re.q AND x.r = re.r JOIN mf y ON y.t = re.t AND y.q = re.q AND y.r = re.q JOIN mf z ON z.t = re.t AND z.q = re.r AND z.r = re.r JOIN kp u ON u.t = re.t AND u.q = re.q JOIN kp v ON v.t = re.t AND v.q = re.r) w",
    "greedy_poisson_gain": _gain(["n"], poisson_gain_formula()),
    "greedy_bernoulli_gain": _gain([f"pair{i}" for i in range(6)], bernoulli_gain_formula()),
    "greedy_multinomial_gain": _gain(["n_a", "n_n", "n_r"], cell_gain_formula(), total=True),
    "greedy_categorical_gain": _with(_YEARS, f"cl AS (SELECT node, t, {X.label_of('node', 't', Q)} AS q, CAST(node % 5 AS INT) AS l FROM years)", "cc AS (SELECT t, q, l, CAST(count(*) AS DOUBLE) AS x FROM cl GROUP BY 1, 2, 3)", "cn AS (SELECT t, q, CAST(count(*) AS DOUBLE) AS n FROM cl GROUP BY 1, 2)")
    + f"SELECT node, t, q, r, {rnd(categorical_gain_formula(), 'gain')} FROM (SELECT cl.node, cl.t, cl.q, g.r, a.x AS x_q, coalesce(b.x, 0.0) AS x_r, n.n AS n_q, coalesce(m.n, 0.0) AS n_r FROM cl JOIN (SELECT CAST(range AS INT) AS r FROM range(4)) g ON g.r <> cl.q JOIN cc a ON a.t = cl.t AND a.q = cl.q AND a.l = cl.l LEFT JOIN cc b ON b.t = cl.t AND b.q = g.r AND b.l = cl.l JOIN cn n ON n.t = cl.t AND n.q = cl.q LEFT JOIN cn m ON m.t = cl.t AND m.q = g.r) w",
    # -1 stands for a label that isn't there. Moving a node changes four cells of the transition counts at most, and their rows' sums.
    "greedy_transition_gain": _with(
        _NET, _SYM, _PRES, _LAB,
        "cnt AS (SELECT a.q AS x, b.q AS y, CAST(count(*) AS DOUBLE) AS n FROM lab a JOIN lab b ON b.node = a.node AND b.t = a.t + 1 GROUP BY 1, 2)",
        "near AS (SELECT l.node, l.t, l.q, g.r, coalesce(p.q, -1) AS a, coalesce(f.q, -1) AS b FROM lab l LEFT JOIN lab p ON p.node = l.node AND p.t = l.t - 1"
        f" LEFT JOIN lab f ON f.node = l.node AND f.t = l.t + 1 JOIN (SELECT CAST(range AS INT) AS r FROM range({Q})) g ON g.r <> l.q)",
        "combo AS (SELECT DISTINCT a, q, b, r FROM near)",
        "moved AS (SELECT a, q, b, r, a AS x, q AS y, -1 AS d FROM combo WHERE a >= 0 UNION ALL SELECT a, q, b, r, a, r, 1 FROM combo WHERE a >= 0"
        " UNION ALL SELECT a, q, b, r, q, b, -1 FROM combo WHERE b >= 0 UNION ALL SELECT a, q, b, r, r, b, 1 FROM combo WHERE b >= 0)",
        "cells AS (SELECT m.*, coalesce(cnt.n, 0.0) AS n FROM (SELECT a, q, b, r, x, y, sum(d) AS d FROM moved GROUP BY ALL) m LEFT JOIN cnt ON cnt.x = m.x AND cnt.y = m.y)",
        "sums AS (SELECT m.*, coalesce(c.n, 0.0) AS n FROM (SELECT a, q, b, r, x, sum(d) AS d FROM moved GROUP BY ALL) m LEFT JOIN (SELECT x, sum(n) AS n FROM cnt GROUP BY x) c ON c.x = m.x)",
        f"terms AS (SELECT a, q, b, r, ({X.xlogx('(n + d)')}) - ({X.xlogx('n')}) AS v FROM cells UNION ALL SELECT a, q, b, r, ({X.xlogx('n')}) - ({X.xlogx('(n + d)')}) FROM sums)",
        "gains AS (SELECT a, q, b, r, sum(v) AS v FROM terms GROUP BY ALL)",
    )
    + f"SELECT node, t, q, r, {rnd('coalesce(v, 0.0)', 'gain')} FROM near LEFT JOIN gains USING (a, q, b, r)",
}
