"""DuckDB SQL for the queries of ``catalog``, over whole tables."""

from __future__ import annotations

DRAWS, SEED, LAM = 3, 7, 0.25
PICKED, OTHER = (119, 153, 101, 34, 200), (17, 68, 136, 187, 238)
ROUNDS = 8  # hops: more than the graph's diameter


def uni(*parts: str) -> str:
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(CAST('0x' || substr(md5(concat_ws(':', {text})), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE))"


def ids(picked) -> str:
    return ", ".join(map(str, picked))


def grid(rows: int, cols: int, diag: bool = False, torus: bool = False) -> str:
    off = ", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (diag or 0 in (a, b)))
    at = f"SELECT v AS u, v // {cols} + o.dr AS r, v % {cols} + o.dc AS c FROM (SELECT range AS v FROM range({rows * cols})) n, (VALUES {off}) o(dr, dc)"
    if torus:
        return f"SELECT u, (r + {rows}) % {rows} * {cols} + (c + {cols}) % {cols} AS v FROM ({at})"
    return f"SELECT u, r * {cols} + c AS v FROM ({at}) WHERE r BETWEEN 0 AND {rows - 1} AND c BETWEEN 0 AND {cols - 1}"


N = "(SELECT count(*) FROM customer)"
DIRECTED = f"SELECT o_custkey AS u, (o_orderkey * 37 + 11) % {N} AS v FROM orders WHERE o_custkey < {N}"
SPARSE = f"SELECT u, v FROM ({DIRECTED}) UNION ALL SELECT v, u FROM ({DIRECTED})"
SOURCES = f"SELECT DISTINCT CAST(n_nationkey AS BIGINT) * 37 % {N} AS src FROM nation"
SAGENTS = f"SELECT s_suppkey AS agent, s_suppkey % {N} AS s, (s_suppkey * 17 + 5) % {N} AS t FROM supplier WHERE s_suppkey % {N} <> (s_suppkey * 17 + 5) % {N}"
BLOCKED = "SELECT DISTINCT s_suppkey * 3 % 256 AS v FROM supplier"
AGENTS = "SELECT o_orderkey AS agent, o_custkey % 256 AS s, (o_orderkey * 31 + 7) % 256 AS t FROM orders WHERE o_custkey % 256 <> (o_orderkey * 31 + 7) % 256"
NODES = "SELECT range AS v FROM range(256)"
L1 = "abs(a.v // 16 - b.v // 16) + abs(a.v % 16 - b.v % 16)"
HARD = f"SELECT a.v AS u, a.v AS cpos, b.v AS v, CAST(1 AS DOUBLE) AS w FROM ({NODES}) a, ({NODES}) b WHERE {L1} <= 2"
SOFT = f"SELECT a.v AS u, a.v AS cpos, b.v AS v, exp(CAST(-0.5 AS DOUBLE) * ({L1})) AS w FROM ({NODES}) a, ({NODES}) b WHERE {L1} <= 3"


def lattice(draws: int = DRAWS) -> str:
    """CTEs ag, st, pn(agent, path, pos, v), pl(agent, path, len)."""
    return f"""ag AS ({AGENTS}),
st AS (SELECT agent, s, t, t // 16 - s // 16 AS dr, t % 16 - s % 16 AS dc, path, unnest(range(0, abs(t // 16 - s // 16) + abs(t % 16 - s % 16) + 1)) AS pos
  FROM (SELECT *, unnest(range({draws})) AS path FROM ag)),
rk AS (SELECT *, CASE WHEN pos > 0 AND row_number() OVER (PARTITION BY agent, path ORDER BY CASE WHEN pos = 0 THEN 2.0 ELSE {uni(str(SEED), "agent", "path", "pos")} END, pos) <= abs(dr) THEN 1 ELSE 0 END AS down FROM st),
pn AS MATERIALIZED (SELECT agent, path, pos, CAST((s // 16 + sign(dr) * r) * 16 + s % 16 + sign(dc) * (pos - r) AS BIGINT) AS v
  FROM (SELECT *, sum(down) OVER (PARTITION BY agent, path ORDER BY pos) AS r FROM rk)),
pl AS MATERIALIZED (SELECT agent, path, count(*) - 1 AS len FROM pn GROUP BY agent, path)"""


def hops(name: str, edges: str, starts: str, limit: int = ROUNDS) -> str:
    """CTE ``name``(src, v, d) and its rounds; starts: SELECT src, v."""
    out = [f"{name}_e AS MATERIALIZED (SELECT DISTINCT u, v FROM ({edges}))", f"{name}_0 AS MATERIALIZED (SELECT DISTINCT src, v FROM ({starts}))"]
    for d in range(1, limit + 1):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM {name}_{k} x WHERE x.src = f.src AND x.v = e.v)" for k in range(d))
        out.append(f"{name}_{d} AS MATERIALIZED (SELECT DISTINCT f.src, e.v FROM {name}_{d - 1} f JOIN {name}_e e ON e.u = f.v WHERE true {seen})")
    rows = " UNION ALL ".join(f"SELECT src, v, CAST({d} AS BIGINT) AS d FROM {name}_{d}" for d in range(limit + 1))
    return ",\n".join([*out, f"{name} AS MATERIALIZED ({rows})"])


DAG = f"""sa AS ({SAGENTS}),
{hops("hs", SPARSE, "SELECT s AS src, s AS v FROM sa")},
{hops("ht", SPARSE, "SELECT t AS src, t AS v FROM sa")},
dag AS MATERIALIZED (SELECT sa.agent, e.u, e.v, a.d FROM sa JOIN hs z ON z.src = sa.s AND z.v = sa.t JOIN hs a ON a.src = sa.s JOIN ({SPARSE}) e ON e.u = a.v JOIN ht b ON b.src = sa.t AND b.v = e.v WHERE a.d + 1 + b.d = z.d)"""


def counts() -> str:
    out = [f"ln AS (SELECT agent, max(d) + 1 AS len FROM dag GROUP BY agent)", "c0 AS (SELECT agent, t AS u, CAST(1 AS DOUBLE) AS cnt FROM sa)"]
    for k in range(1, ROUNDS + 1):
        out.append(f"c{k} AS MATERIALIZED (SELECT agent, g.u, sum(c.cnt) AS cnt FROM dag g JOIN ln USING (agent) JOIN (SELECT agent, u AS v, cnt FROM c{k - 1}) c USING (agent, v) WHERE ln.len - g.d = {k} GROUP BY agent, g.u)")
    out.append("ct AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(ROUNDS + 1)) + ")")
    return ",\n".join(out)


def walks(draws: int = 3) -> str:
    out = ["op AS MATERIALIZED (SELECT agent, u, v, cnt, sum(cnt) OVER (PARTITION BY agent, u ORDER BY v) AS high, sum(cnt) OVER (PARTITION BY agent, u) AS total FROM (SELECT agent, g.u, v, sum(c.cnt) AS cnt FROM dag g JOIN (SELECT agent, u AS v, cnt FROM ct) c USING (agent, v) GROUP BY agent, g.u, v))"]
    out.append(f"k0 AS (SELECT agent, unnest(range({draws})) AS path, CAST(0 AS BIGINT) AS pos, s AS v FROM sa WHERE agent IN (SELECT agent FROM dag))")
    for k in range(1, ROUNDS + 1):
        out.append(f"k{k} AS MATERIALIZED (SELECT agent, path, CAST({k} AS BIGINT) AS pos, op.v FROM (SELECT agent, path, v AS u, {uni(str(SEED), 'agent', 'path', str(k))} AS r FROM k{k - 1}) JOIN op USING (agent, u) WHERE r * total < high AND r * total >= high - cnt)")
    return ",\n".join(out)


def psi(t: str, kind: str = "log1p", p: float = 0) -> str:
    t = f"greatest({t}, CAST(0 AS DOUBLE))"
    return {"clip": f"least({t}, CAST({p} AS DOUBLE))", "log1p": f"ln(1 + {t})", "expsat": f"1 - exp(-CAST({p} AS DOUBLE) * {t})", "power": f"CASE WHEN {t} > 0 THEN pow({t}, CAST({p} AS DOUBLE)) ELSE 0 END"}[kind]


SCALARS = "SELECT coalesce(sum(least(k, 2) * lmin), 0) AS lsum_r, coalesce(sum(lmin), 0) AS lmin1, coalesce(sum(al), 0) AS lsum_all FROM (SELECT agent, min(len) AS lmin, count(*) AS k, sum(len) AS al FROM pl GROUP BY agent)"
STATS = "SELECT agent, v, count(*) AS n FROM (SELECT DISTINCT agent, path, v FROM pn) GROUP BY agent, v"
COEF = {
    "certified": ("SELECT v, CAST(count(*) AS DOUBLE) AS c FROM (SELECT DISTINCT agent, v FROM pn) GROUP BY v", f"(SELECT lmin1 FROM ({SCALARS}))"),
    "proxy": (f"SELECT v, CAST(sum(least(n, 2)) AS DOUBLE) AS c FROM ({STATS}) GROUP BY v", f"(SELECT lsum_r FROM ({SCALARS}))"),
    "lb1": ("SELECT v, CAST(count(*) AS DOUBLE) AS c FROM pn WHERE path = 0 GROUP BY v", "(SELECT sum(len) FROM pl WHERE path = 0)"),
    "lb2": (f"SELECT v, sum(CAST(1 AS DOUBLE) / {DRAWS}) AS c FROM pn GROUP BY v", f"(SELECT sum(CAST(len AS DOUBLE) / {DRAWS}) FROM pl)"),
}
TOPK = "SELECT v, sum(w) AS m FROM (SELECT v, w, row_number() OVER (PARTITION BY v ORDER BY w DESC, u) AS r FROM w) WHERE r <= 3 GROUP BY v"
GLOBAL = "SELECT v, sum(w) AS m FROM w GROUP BY v"


def best_caps(most: str, kind: str = "log1p") -> str:
    return f"SELECT agent, max(coalesce(x, 0)) AS cap FROM pl LEFT JOIN (SELECT agent, path, sum({psi('m', kind)}) AS x FROM pn JOIN ({most}) USING (v) GROUP BY agent, path) USING (agent, path) GROUP BY agent"


def gains(kind: str, m: str, co: str = "co", f=psi) -> str:
    """SELECT u, cpos, gain given the state CTE m(v, m)."""
    g = f"({f('coalesce(m, 0) + w')}) - ({f('coalesce(m, 0)')})"
    if kind in COEF:
        return f"SELECT u, cpos, sum(c * ({g})) AS gain FROM w JOIN {co} USING (v) LEFT JOIN {m} USING (v) WHERE c <> 0 GROUP BY u, cpos"
    delta = f"SELECT u, cpos, v, {g} AS g FROM w LEFT JOIN {m} USING (v)"
    if kind == "capped":
        return f"""SELECT u, cpos, sum(least(room, delta)) AS gain FROM (SELECT u, cpos, agent, sum(g) AS delta FROM ({delta}) JOIN un USING (v) WHERE g > 0 GROUP BY u, cpos, agent)
JOIN (SELECT agent, greatest(cap - coalesce(cur, 0), 0) AS room FROM cap LEFT JOIN (SELECT agent, sum({psi('m')}) AS cur FROM un JOIN {m} USING (v) GROUP BY agent) USING (agent)) USING (agent) GROUP BY u, cpos"""
    score = f"SELECT agent, path, coalesce(x, 0) - {LAM} * len AS score FROM pl LEFT JOIN (SELECT agent, path, sum({psi('m')}) AS x FROM pn JOIN {m} USING (v) GROUP BY agent, path) USING (agent, path)"
    return f"""SELECT u, cpos, sum(greatest(top - best, 0)) AS gain FROM (SELECT u, cpos, agent, max(score + delta) AS top
FROM (SELECT u, cpos, agent, path, sum(g) AS delta FROM ({delta}) JOIN pn USING (v) WHERE g > 0 GROUP BY u, cpos, agent, path) JOIN ({score}) USING (agent, path) GROUP BY u, cpos, agent)
JOIN (SELECT agent, max(score) AS best FROM ({score}) GROUP BY agent) USING (agent) GROUP BY u, cpos"""


def scores(m: str, f=psi) -> str:
    return f"SELECT agent, path, coalesce(x, 0) - {LAM} * len AS score FROM pl LEFT JOIN (SELECT agent, path, sum({f('m')}) AS x FROM pn JOIN {m} USING (v) GROUP BY agent, path) USING (agent, path)"


def problem(kind: str) -> str:
    out = [lattice(), f"w AS MATERIALIZED ({SOFT})"]
    if kind in COEF:
        out.append(f"co AS MATERIALIZED ({COEF[kind][0]})")
    if kind == "capped":
        out += ["un AS MATERIALIZED (SELECT DISTINCT agent, v FROM pn)", f"cap AS MATERIALIZED ({best_caps(TOPK)})"]
    return ",\n".join(out)


def state(name: str, chosen: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT v, sum(w) AS m FROM w WHERE u IN ({chosen}) GROUP BY v)"


def value(kind: str) -> str:
    head = f"WITH {problem(kind)}, {state('m0', ids(PICKED))} "
    if kind in COEF:
        return head + f"SELECT round((SELECT sum(c * ({psi('m')})) FROM co JOIN m0 USING (v)) - {LAM} * {COEF[kind][1]}, 6) AS value"
    if kind == "capped":
        return head + f"SELECT round(sum(least(cap, coalesce(cur, 0))) - {LAM} * (SELECT lmin1 FROM ({SCALARS})), 6) AS value FROM cap LEFT JOIN (SELECT agent, sum({psi('m')}) AS cur FROM un JOIN m0 USING (v) GROUP BY agent) USING (agent)"
    return head + f"SELECT round(sum(b), 6) AS value FROM (SELECT max(score) AS b FROM ({scores('m0')}) GROUP BY agent)"


def marginals(kind: str) -> str:
    return f"WITH {problem(kind)}, {state('m0', ids(PICKED[:2]))} SELECT u, cpos, round(gain, 4) AS gain FROM ({gains(kind, 'm0')})"


def greedy_rounds(kind: str, k: int, tag: str = "", co: str = "co", f=psi) -> list[str]:
    """CTEs: b1 .. bk(round, u, gain) and s0 .. sk(u), their names tagged."""
    out = [f"{tag}s0 AS (SELECT CAST(NULL AS BIGINT) AS u WHERE false)"]
    for n in range(1, k + 1):
        out.append(state(f"{tag}m{n}", f"SELECT u FROM {tag}s{n - 1}"))
        out.append(f"{tag}b{n} AS MATERIALIZED (SELECT CAST({n} AS BIGINT) AS round, u, round(gain, 6) AS gain FROM ({gains(kind, f'{tag}m{n}', co, f)}) WHERE u NOT IN (SELECT u FROM {tag}s{n - 1}) AND round(gain, 6) > 0 ORDER BY round(gain, 6) DESC, cpos LIMIT 1)")
        out.append(f"{tag}s{n} AS MATERIALIZED (SELECT u FROM {tag}s{n - 1} UNION ALL SELECT u FROM {tag}b{n})")
    return out


def rounds(k: int, tag: str = "") -> str:
    return " UNION ALL ".join(f"SELECT * FROM {tag}b{n}" for n in range(1, k + 1))


def greedy(head: str, kind: str, k: int) -> str:
    return "WITH " + ",\n".join([head, *greedy_rounds(kind, k)]) + " " + rounds(k)


def total(m: str, f=psi) -> str:
    """The original objective's value at a state."""
    return f"(SELECT sum(b) FROM (SELECT max(score) AS b FROM ({scores(m, f)}) GROUP BY agent))"


def linear(co: str, m: str, const: str, f=psi) -> str:
    return f"((SELECT coalesce(sum(c * ({f('m')})), 0) FROM {co} JOIN {m} USING (v)) - {LAM} * {const})"


def lb3(k: int) -> str:
    """Two rounds from PICKED; the better stands, the first where the values have settled."""
    out = [lattice(), f"w AS MATERIALIZED ({SOFT})", state("z0", ids(PICKED))]
    for n in (1, 2):
        out.append(f"sc{n} AS MATERIALIZED ({scores(f'z{n - 1}')})")
        out.append(f"al{n} AS MATERIALIZED (SELECT agent, path, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY agent) AS alpha FROM (SELECT *, max(score) OVER (PARTITION BY agent) AS top FROM sc{n}))")
        out.append(f"co{n} AS MATERIALIZED (SELECT v, sum(alpha) AS c FROM pn JOIN al{n} USING (agent, path) GROUP BY v)")
        out += greedy_rounds("certified", k, f"r{n}", f"co{n}")
        out.append(state(f"z{n}", f"SELECT u FROM r{n}s{k}"))
    out.append(f"f AS MATERIALIZED (SELECT {total('z0')} AS f0, {total('z1')} AS f1, {total('z2')} AS f2)")
    later = "(f2 > f1 AND abs(f1 - f0) >= 1e-6)"
    return "WITH " + ",\n".join(out) + f" SELECT round, u, round(f1, 6) AS value FROM ({rounds(k, 'r1')}), f WHERE NOT {later} UNION ALL SELECT round, u, round(f2, 6) AS value FROM ({rounds(k, 'r2')}), f WHERE {later}"


def clip(t: str) -> str:
    return psi(t, "clip", 1)


def sandwich(k: int) -> str:
    """(key, value) of the deterministic results under the certified union."""
    out = [lattice(), f"w AS MATERIALIZED ({HARD})"]
    for name, kind in (("ub", "certified"), ("lb", "lb1"), ("px", "proxy")):
        out += [f"{name}co AS MATERIALIZED ({COEF[kind][0]})", *greedy_rounds(kind, k, name, f"{name}co", clip), state(f"{name}z", f"SELECT u FROM {name}s{k}")]
        out.append(f"{name}list AS MATERIALIZED (SELECT string_agg(u, ' ' ORDER BY round) AS s FROM ({rounds(k, name)}))")
    out.append(f"f AS MATERIALIZED (SELECT {total('ubz', clip)} AS fu, {total('lbz', clip)} AS fl, {linear('ubco', 'ubz', COEF['certified'][1], clip)} AS cu, {linear('ubco', 'lbz', COEF['certified'][1], clip)} AS cl, {linear('pxco', 'pxz', COEF['proxy'][1], clip)} AS px, (SELECT count(DISTINCT agent) FROM pl) AS n)")
    up = "fu >= fl"
    six = lambda x: f"printf('%.6f', {x})"
    bound = f"CASE WHEN {up} THEN cu ELSE cl END"
    rows = [("S_UB", "(SELECT s FROM ublist)"), ("S_LB", "(SELECT s FROM lblist)"), ("S_proxy", "(SELECT s FROM pxlist)"), ("S_pick", f"CASE WHEN {up} THEN (SELECT s FROM ublist) ELSE (SELECT s FROM lblist) END"), ("picked", f"CASE WHEN {up} THEN 'UB' ELSE 'LB' END"), ("F_UB", six("fu")), ("F_LB", six("fl"))]
    rows += [(n, six(bound)) for n in ("certified_union_value", "capped_union_value", "certified_ub_value")]
    rows += [("ub_objective_total_S_UB", six("cu")), ("ub_objective_mean_S_UB", six("cu / n")), ("ub_objective_mean_pick", six(f"({bound}) / n")), ("proxy_score", six("px"))]
    return "WITH " + ",\n".join(out) + " " + " UNION ALL ".join(f"SELECT '{key}' AS key, {value_} AS value FROM f" for key, value_ in rows)


def method(chosen: str, more: str = "") -> str:
    """(pos, u, f_pick, certified) of a baseline's picks; chosen: SELECT pos, u."""
    head = [lattice(), f"w AS MATERIALIZED ({SOFT})", f"co AS MATERIALIZED ({COEF['certified'][0]})", *([more] if more else []), f"pk AS MATERIALIZED ({chosen})", state("z", "SELECT u FROM pk")]
    return "WITH " + ",\n".join(head) + f" SELECT pos, u, round({total('z')}, 6) AS f_pick, round({linear('co', 'z', COEF['certified'][1])}, 6) AS certified FROM pk"


def print_of(columns: str, rows: str) -> str:
    return f"SELECT printf('%x', CAST(coalesce(sum(CAST(CAST('0x' || substr(md5(concat_ws(':', {columns})), 1, 12) AS BIGINT) AS HUGEINT)), 0) % 1152921504606846976 AS BIGINT)) AS fingerprint FROM ({rows})"


def values(rows) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


# What option values, data set keys and places read as, worked out by hand.
OPTIONS = [
    ("cap", "auto clip:1 0 5", "pathlen 5"), ("cap", "auto log1p 0 5", "topk 5"), ("cap", "pathlen power:0.5 3 5", "topk 3"), ("cap", "global clip:2 0 5", "global 5"),
    ("fnv", "a", "af63dc4c8601ec8c"), ("grid", "rows=3, cols=4,diag=1", "3 4 true false"), ("hotspots", "0:3, 7:1", "0 3.000000 7 1.000000"), ("kernel", "exp:0.5:3:0.01", "0.500000 3 0.010000"), ("kernel", "gauss:1", "1.000000 3 0.000100"),
    ("kernel", "gauss:0.5", "4.000000 2 0.000100"), ("od", " UniformWithDistBand", "band"), ("od", "Hotspots", "hotspot"), ("pairs", "K=5, seed=7", "k=5 seed=7"), ("path", "0 1 2", "a940e14f3a8f72be"), ("psi", "CLIP:1.5", "clip:1.5 1.500000 true"),
    ("psi", "expsat:2", "expsat:2 1.000000 true"), ("psi", "log1p", "log1p inf true"), ("key", "dataset_key=my city-2", "MY_CITY_2 dataset_key"), ("key", "edges=data/rome/Edges.txt", "ROME edges"), ("key", "edges=data/rome/old town.txt", "OLD_TOWN edges"), ("key", "graph_bin_in=x/lyon.v2.bin;edges=a/b.txt", "LYONV2 graph_bin_in"),
    ("key", "edges=graph.txt", "DATASET edges"), ("key", "", "DATASET fallback"), ("od_json", "band 4 12", '{"band":[4,12]}'), ("od_json", "gaussian 1.5", '{"sigma":1.500000}'), ("od_json", "gravity 0.3", '{"beta":0.300000}'), ("od_json", "uniform", "{}"),
    ("place", "edges=data/rome/edges.txt;out_dir=data", "edges=data/datasets/ROME/edges.txt out_dir=data/experiments/ROME"), ("place", "graph_bin_out=lyon.bin;out_dir=out", "graph_bin_out=data/datasets/LYON/LYON.bin"),
]


def static(k: int) -> str:
    g = f"({psi('coalesce(m, 0) + w', 'clip', 1)}) - ({psi('coalesce(m, 0)', 'clip', 1)})"
    out = [f"w AS MATERIALIZED ({HARD})", "co AS MATERIALIZED (SELECT c_custkey % 256 AS v, greatest(CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE), 0) AS c FROM customer GROUP BY 1)", "s0 AS (SELECT CAST(NULL AS BIGINT) AS u WHERE false)"]
    for n in range(1, k + 1):
        out.append(state(f"m{n}", f"SELECT u FROM s{n - 1}"))
        out.append(f"b{n} AS MATERIALIZED (SELECT CAST({n} AS BIGINT) AS round, u, round(sum(c * ({g})), 6) AS gain FROM w JOIN co USING (v) LEFT JOIN m{n} USING (v) WHERE u NOT IN (SELECT u FROM s{n - 1}) GROUP BY u, cpos HAVING round(sum(c * ({g})), 6) > 0 ORDER BY gain DESC, cpos LIMIT 1)")
        out.append(f"s{n} AS MATERIALIZED (SELECT u FROM s{n - 1} UNION ALL SELECT u FROM b{n})")
    return "WITH " + ",\n".join(out) + " " + " UNION ALL ".join(f"SELECT * FROM b{n}" for n in range(1, k + 1))


def stats(rows: str, v: str = "value", z: float = 1.959963984540054, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"SELECT {b}round(mean, 6) AS mean, round(var, 6) AS var, round(se, 6) AS se, round(mean - {z} * se, 6) AS ci_low, round(mean + {z} * se, 6) AS ci_high, m FROM (SELECT *, sqrt(var / m) AS se FROM (SELECT {b}avg({v}) AS mean, coalesce(var_samp({v}), 0) AS var, count({v}) AS m FROM ({rows}) {'GROUP BY ' + by if by else ''}))"


def od(kind: str) -> str:
    u = lambda role, *more: uni(str(SEED), "attempt", "try", f"'{role}'", *more)
    tries = "tr AS (SELECT c_custkey AS attempt, unnest(range(12)) AS try FROM customer)"
    walk = "wk AS (SELECT row_number() OVER (ORDER BY node) - 1 AS idx, node FROM (SELECT DISTINCT p_partkey % 256 AS node FROM part))"
    l1 = "abs(s // 16 - t // 16) + abs(s % 16 - t % 16)"
    good, rank = "s <> t", "try"
    start = f"SELECT attempt, try, node AS s FROM (SELECT *, CAST(floor({u('s')} * (SELECT count(*) FROM wk)) AS BIGINT) AS idx FROM tr) JOIN wk USING (idx)"
    if kind == "hotspot":
        hot = f"hw AS (SELECT node, sum(weight) AS weight FROM (SELECT c_custkey % 256 AS node, CAST(round(c_acctbal * 100) AS BIGINT) AS weight FROM customer) WHERE weight > 0 AND node NOT IN ({BLOCKED}) GROUP BY node), hr AS MATERIALIZED (SELECT node, CAST(sum(weight) OVER (ORDER BY node) AS BIGINT) AS high, CAST(sum(weight) OVER (ORDER BY node) - weight AS BIGINT) AS low FROM hw)"
        pick = lambda role: f"SELECT attempt, try, node AS {role} FROM (SELECT *, {u(role)} * (SELECT CAST(max(high) AS DOUBLE) FROM hr) AS r FROM tr) JOIN hr ON r >= low AND r < high"
        pairs = f"SELECT attempt, try, s, t FROM ({pick('s')}) JOIN ({pick('t')}) USING (attempt, try)"
        head = f"{tries}, {hot}"
    else:
        head = f"{tries}, {walk}"
        if kind == "gaussian":
            normal = lambda d: f"(sqrt(-2.0 * ln(1.0 - {u(d, chr(39) + 'r' + chr(39))})) * cos(2.0 * pi() * {u(d, chr(39) + 'a' + chr(39))}))"
            pairs = f"SELECT attempt, try, s, r * 16 + c AS t FROM (SELECT attempt, try, s, s // 16 + CAST(round(1.5 * {normal('dr')}) AS BIGINT) AS r, s % 16 + CAST(round(1.5 * {normal('dc')}) AS BIGINT) AS c FROM ({start})) WHERE r BETWEEN 0 AND 15 AND c BETWEEN 0 AND 15 AND r * 16 + c NOT IN ({BLOCKED})"
        else:
            pairs = f"SELECT attempt, try, s, node AS t FROM (SELECT *, CAST(floor({u('t')} * (SELECT count(*) FROM wk)) AS BIGINT) AS idx FROM ({start})) JOIN wk USING (idx)"
    if kind == "band":
        good += f" AND {l1} BETWEEN 4 AND 12"
    if kind == "gravity":
        rank = f"CASE WHEN {u('accept')} < exp(CAST(-0.3 AS DOUBLE) * ({l1})) THEN try ELSE 24 - try END"
    return f"WITH {head}, pr AS (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY {rank}, s, t) AS k FROM ({pairs}) WHERE {good}) SELECT attempt, s, t, CAST(try AS BIGINT) AS try FROM pr WHERE k = 1"


# What a report says that a run was asked for: fixed names, in a fixed order.
ASKED = [
    ("k", "5"), ("corridor_r", "2"), ("ub_mode", "CertifiedUnion"), ("cap_mode", "Auto"), ("cap_topk_k", "0"), ("cap_cache", "true"), ("lambda", "0.250000"), ("psi_type", "ClipMinC"), ("psi_C", "1.000000"), ("corridor_band_r", "-1"),
    ("M_agents", "100"), ("K_paths_per_agent", "5"), ("M_eval", "0"), ("reuse_eval_samples", "true"), ("ci_alpha", "0.050000"), ("proxy_baseline_enabled", "true"), ("proxy_corridor_r", "2"), ("use_LB2_fixed_mixture", "false"), ("use_LB3_softmax", "false"), ("lb3_softmax_eta", "1.000000"),
    ("use_LB3_single", "false"), ("use_LB3_iter", "false"), ("lb3_start_from_UB", "true"), ("lb3_max_iters", "1"), ("lb3_eta", "1.000000"), ("lb3_tol", "0.000001"), ("lb3_keep_best", "true"), ("seed", "7"), ("od_distribution", "UniformWithDistBand"), ("od_rows", "16"),
    ("od_cols", "16"), ("od_dist_band", "4,12"), ("od_sigma", "0.000000"), ("od_decay_beta", "0.000000"), ("od_hotspot_count", "0"),
]


def report_lines() -> str:
    head = f"WITH {problem('original')}, {state('m0', ids(PICKED))}, {state('m1', ids(OTHER))}"
    for n in (0, 1):
        head += f", st{n} AS MATERIALIZED ({stats(f'SELECT max(score) AS value FROM ({scores(f'm{n}')}) GROUP BY agent')})"
    plain = lambda line: f"SELECT '{line}' AS value"
    rows = [plain("tag\tt"), plain("k\t5")]
    for name, n, picked in (("pick", 0, PICKED), ("UB", 0, PICKED), ("LB", 1, OTHER)):
        rows += [plain(""), plain(f"{name}\tBEGIN"), plain(f"{name}\tS\t" + " ".join(map(str, picked)))]
        rows += [f"SELECT '{name}\t{c}\t' || printf('%.6f', {c}) AS value FROM st{n}" for c in ("mean", "var", "se", "ci_low", "ci_high")]
        rows += [f"SELECT '{name}\tM\t' || m AS value FROM st{n}", plain(f"{name}\tEND")]
    return head + " " + " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS ord, value FROM ({r})" for n, r in enumerate(rows))


def lines_of(rows: str, column: str) -> str:
    return f"SELECT CAST({column} AS VARCHAR) AS value FROM ({rows})"


DEDUPED = "SELECT p_partkey * 7 % 601 AS u, min(p_partkey) AS line FROM part WHERE p_partkey * 7 % 601 < 500 GROUP BY 1"
LAT = "WITH " + lattice()
ORACLES: dict[str, str] = {
    "grid_edges_4": grid(16, 16),
    "grid_edges_8": grid(12, 20, diag=True),
    "grid_edges_torus": grid(9, 2, torus=True),
    "grid_edge_list": f"SELECT DISTINCT least(u, v) || ' ' || greatest(u, v) AS value FROM ({grid(9, 7, True, True)}) WHERE u <> v",
    "edge_text_scan": SPARSE,
    "edge_text_odd_lines": "SELECT o_custkey - 1 AS u, o_orderkey - 1 AS v FROM orders WHERE o_orderkey % 5 > 2 AND o_custkey BETWEEN 1 AND (SELECT max(o_orderkey) FROM orders) AND o_orderkey >= 1",
    "candidate_dedup": "SELECT u, row_number() OVER (ORDER BY line, u) - 1 AS cpos FROM (SELECT p_partkey * 7 % 601 AS u, min(p_partkey) AS line FROM part WHERE p_partkey * 7 % 601 < 500 GROUP BY 1)",
    "blocked_ids": "SELECT DISTINCT s_suppkey % 64 - 1 AS v FROM supplier WHERE s_suppkey % 64 >= 1",
    "hotspot_parse": "SELECT c_custkey AS node, abs(c_acctbal) + CAST(0.01 AS DOUBLE) AS weight FROM customer WHERE c_custkey % 7 > 1",
    "obstacle_coordinates": "SELECT DISTINCT (r - 1) * 16 + c - 1 AS v FROM (SELECT s_suppkey % 19 AS r, s_suppkey * 5 % 17 AS c FROM supplier) WHERE r BETWEEN 1 AND 16 AND c BETWEEN 1 AND 16",
    "path_text_round_trip": f"{LAT} SELECT agent, path, pos, v FROM pn WHERE (agent, path) IN (SELECT (agent, path) FROM pl WHERE len >= 1)",
    "graph_bundle_round_trip": SPARSE,
    "infer_node_count": f"SELECT max(greatest(u, v)) + 1 AS n FROM ({SPARSE})",
    "reverse_edges": "SELECT v AS u, u AS v FROM (" + DIRECTED.replace(f" WHERE o_custkey < {N}", "") + ")",
    "degree_summary": f"SELECT c_custkey AS v, count(e.u) AS degree FROM customer LEFT JOIN ({SPARSE}) e ON e.u = c_custkey GROUP BY c_custkey",
    "graph_summary": f"SELECT CAST(256 AS BIGINT) AS n, (SELECT count(*) FROM ({grid(16, 16)})) AS directed_edges, (SELECT count(*) FROM ({BLOCKED})) AS n_blocked",
    "path_summary": f"{LAT} SELECT count(*) AS paths, min(len) AS min_len, round(avg(len), 6) AS avg_len, max(len) AS max_len FROM pl",
    "bfs_distances": f"WITH {hops('h', SPARSE, f'SELECT src, src AS v FROM ({SOURCES})')} SELECT src, v, d FROM h",
    "reachable_pairs": f"WITH sa AS ({SAGENTS}), {hops('h', DIRECTED, 'SELECT s AS src, s AS v FROM sa', 24)} SELECT agent, s, t FROM sa WHERE EXISTS (SELECT 1 FROM h WHERE h.src = s AND h.v = t)",
    "shortest_path_dag": f"WITH {DAG} SELECT agent, u, v, d FROM dag",
    "corridor_band": f"WITH {DAG}, cl AS MATERIALIZED (SELECT sa.agent, a.v FROM sa JOIN hs z ON z.src = sa.s AND z.v = sa.t JOIN hs a ON a.src = sa.s JOIN ht b ON b.src = sa.t AND b.v = a.v WHERE a.d + b.d = z.d) SELECT agent, v FROM cl UNION SELECT agent, e.v FROM cl JOIN ({SPARSE}) e ON e.u = cl.v",
    "obstacles_random": f"SELECT v FROM ({NODES}) WHERE v NOT IN ({BLOCKED}) ORDER BY {uni('11', 'v')}, v LIMIT 40",
    "obstacles_apply": f"SELECT u, v FROM ({grid(16, 16)}) WHERE u NOT IN ({BLOCKED}) AND v NOT IN ({BLOCKED})",
    "walkable_nodes": f"SELECT v FROM ({NODES}) WHERE v NOT IN ({BLOCKED})",
    "weights_hard": HARD,
    "weights_soft": f"SELECT u, cpos, v, round(w, 6) AS w FROM ({SOFT})",
    "weights_sparse": f"WITH {hops('h', SPARSE, f'SELECT src, src AS v FROM ({SOURCES})', 2)} SELECT src AS u, src AS cpos, v, round(exp(-d), 6) AS w FROM h",
    **{f"psi_{k}": f"SELECT l_orderkey, l_linenumber, round({psi('((l_quantity - 5) / 10)', k, p)}, 6) AS psi FROM lineitem" for k, p in (("clip", 1.5), ("log1p", 0), ("expsat", 0.7), ("power", 0.5))},
    **{f"od_{k}": od(k) for k in ("uniform", "band", "gaussian", "hotspot", "gravity")},
    "od_first_agents": f"SELECT row_number() OVER (ORDER BY attempt) - 1 AS agent, s, t FROM ({od('band')}) ORDER BY attempt LIMIT 500",
    "lattice_paths": f"{LAT} SELECT agent, path, pos, v FROM pn",
    "k_distinct_paths": f"WITH {lattice(5)}, sq AS (SELECT agent, path, string_agg(v, ' ' ORDER BY pos) AS q FROM pn GROUP BY agent, path), fi AS (SELECT agent, min(path) AS draw FROM sq GROUP BY agent, q), ra AS (SELECT agent, draw, row_number() OVER (PARTITION BY agent ORDER BY draw) - 1 AS path FROM fi) SELECT pn.agent, ra.path, pn.pos, pn.v FROM pn JOIN ra ON pn.agent = ra.agent AND pn.path = ra.draw WHERE ra.path < 3",
    "dag_path_counts": f"WITH {DAG}, {counts()} SELECT agent, u, cnt FROM ct",
    "dag_path_sample": f"WITH {DAG}, {counts()}, {walks()} " + " UNION ALL ".join(f"SELECT agent, path, pos, v FROM k{k}" for k in range(ROUNDS + 1)),
    "union_counts": f"{LAT} {COEF['certified'][0]}",
    "agent_lengths": f"{LAT} SELECT agent, min(len) AS lmin, max(len) AS lmax, count(*) AS npaths FROM pl GROUP BY agent",
    "corridor_stats": f"{LAT} SELECT v, CAST(sum(least(n, 2)) AS BIGINT) AS b_r, count(*) AS in_union, CAST(sum(n) AS BIGINT) AS c_total FROM ({STATS}) GROUP BY v",
    "corridor_scalars": f"{LAT} SELECT CAST(lsum_r AS BIGINT) AS lsum_r, CAST(lmin1 AS BIGINT) AS lmin1, CAST(lsum_all AS BIGINT) AS lsum_all FROM ({SCALARS})",
    **{f"{k}_value": value(k) for k in (*COEF, "original", "capped")},
    **{f"marginals_{k}": marginals(k) for k in (*COEF, "original", "capped")},
    **{f"greedy_{k}": greedy(problem(k), k, 5) for k in (*COEF, "original", "capped")},
    "lazy_greedy_certified": greedy(problem("certified"), "certified", 5),
    "static_greedy": static(4),
    "caps_pathlen": f"{LAT} SELECT agent, CAST(max(len) + 1 AS DOUBLE) AS cap FROM pl GROUP BY agent",
    "caps_topk": f"{LAT}, w AS ({SOFT}) SELECT agent, round(cap, 6) AS cap FROM ({best_caps(TOPK)})",
    "caps_global": f"{LAT}, w AS ({SOFT}) SELECT agent, round(cap, 6) AS cap FROM ({best_caps(GLOBAL)})",
    "cap_summary": f"{LAT}, w AS ({SOFT}) SELECT min(c) AS cap_min, round(median(c), 6) AS cap_median, max(c) AS cap_max FROM (SELECT round(cap, 6) AS c FROM ({best_caps(TOPK)}))",
    "random_k": f"SELECT p_partkey AS u, p_partkey AS cpos FROM part ORDER BY {uni(str(SEED), 'p_partkey')}, p_partkey LIMIT 50",
    "regular_spacing": f"SELECT v, CAST(CASE WHEN v // 16 >= 2 AND v % 16 >= 2 AND (v // 16 - 2) % 4 = 0 AND (v % 16 - 2) % 4 = 0 THEN 0 ELSE 1 END AS INTEGER) AS fill FROM ({NODES}) WHERE v NOT IN ({BLOCKED}) ORDER BY fill, v LIMIT 20",
    "bruteforce_small": f"WITH {problem('certified')}, fw AS (SELECT CAST(n_nationkey AS BIGINT) AS p, w.v, w.w FROM nation JOIN w ON w.u = n_nationkey * 10), se AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey JOIN nation c ON b.n_nationkey < c.n_nationkey), mm AS (SELECT a, b, c, v, sum(w) AS m FROM se JOIN fw ON fw.p IN (a, b, c) GROUP BY a, b, c, v) SELECT a || ',' || b || ',' || mm.c AS members, round(sum(co.c * ({psi('m')})), 6) AS value FROM mm JOIN co USING (v) GROUP BY a, b, mm.c",
    "softmax_mixture": f"WITH {problem('original')}, {state('m0', ids(PICKED))}, sc AS ({scores('m0')}) SELECT agent, path, round(exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY agent), 6) AS alpha FROM (SELECT *, max(score) OVER (PARTITION BY agent) AS top FROM sc)",
    "eval_stats": f"WITH {problem('original')}, {state('m0', ids(PICKED))} " + stats(f"SELECT max(score) AS value FROM ({scores('m0')}) GROUP BY agent"),
    "eval_diff_stats": f"WITH {problem('original')}, {state('m0', ids(PICKED))}, {state('m1', ids(OTHER))} " + stats(f"SELECT x - y AS value FROM (SELECT agent, max(score) AS x FROM ({scores('m0')}) GROUP BY agent) JOIN (SELECT agent, max(score) AS y FROM ({scores('m1')}) GROUP BY agent) USING (agent)"),
    "sample_summary_by_segment": stats("SELECT * FROM customer", "c_acctbal", 1.6448536269514715, "c_mktsegment"),
    "grid_edges_cylinder": "SELECT v AS u, r * 4 + (c + 4) % 4 AS v FROM (SELECT range AS v, range // 4 + dr AS r, range % 4 + dc AS c FROM range(20), (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dr, dc)) WHERE r BETWEEN 0 AND 4",
    "edge_file": f"SELECT u || ' ' || v AS value FROM ({SPARSE})",
    "candidate_file": lines_of(DEDUPED, "u"),
    "obstacle_file": f"SELECT 'id' AS kind, CAST(v AS VARCHAR) AS value FROM ({BLOCKED}) UNION ALL SELECT 'cell', (v // 16) || ' ' || (v % 16) FROM ({BLOCKED})",
    "obstacle_ids": "SELECT DISTINCT s_suppkey % 90 AS v FROM supplier WHERE s_suppkey % 90 < 64",
    "blocked_metadata": "SELECT 'survey' AS blocked_source, count(*) AS blocked_seed, count(*) / CAST(256 AS DOUBLE) AS blocked_fraction FROM supplier",
    "solution_file": "WITH " + ",\n".join([problem("certified"), *greedy_rounds("certified", 3)]) + f" SELECT CAST(0 AS BIGINT) AS ord, '# value' AS value UNION ALL SELECT 1, printf('%.6f', sum(gain)) FROM ({rounds(3)}) UNION ALL SELECT 2, '# selected (NodeId)' UNION ALL SELECT 3, string_agg(u, ' ' ORDER BY round) FROM ({rounds(3)}) UNION ALL SELECT 4, '# gains_per_step' UNION ALL SELECT 5, string_agg(printf('%.6f', gain), ' ' ORDER BY round) FROM ({rounds(3)})",
    "weights_cache": f"SELECT u, cpos, v, round(w, 6) AS w FROM ({SOFT})",
    "corridor_cache": f"{LAT} SELECT v, CAST(sum(least(n, 2)) AS BIGINT) AS b_r, count(*) AS in_union, CAST(sum(n) AS BIGINT) AS c_total FROM ({STATS}) GROUP BY v",
    "weights_fingerprint": print_of("u, v, CAST(round(w, 6) AS DECIMAL(30, 6))", SOFT),
    "edges_fingerprint": print_of("u, v", SPARSE),
    "path_fingerprints": f"{LAT} SELECT agent, path, md5(string_agg(v, ' ' ORDER BY pos)) AS fingerprint FROM pn GROUP BY agent, path",
    "union_averages": f"{LAT}, w AS ({SOFT}) SELECT (SELECT sum(c) / 256 FROM ({COEF['certified'][0]})) AS avg_agents_per_node, round((SELECT sum(cap) FROM ({best_caps(TOPK)})), 4) AS total_cap",
    "dataset_summary": f"SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM ({SPARSE})) // 2 AS edges, (SELECT count(*) FROM ({DEDUPED})) AS candidates, (SELECT count(*) FROM ({BLOCKED})) AS blocked",
    "lattice_log_counts": f"SELECT agent, round(coalesce(list_sum(list_transform(range(1, least(r, c) + 1), lambda i: ln(CAST(r + c - least(r, c) + i AS DOUBLE)) - ln(CAST(i AS DOUBLE)))), 0), 6) AS log_paths FROM (SELECT agent, abs(t // 16 - s // 16) AS r, abs(t % 16 - s % 16) AS c FROM ({AGENTS}))",
    "option_values": values(OPTIONS).replace("SELECT *", "SELECT col0 AS kind, col1 AS given, col2 AS found"),
    "report_metadata": values([(str(n), *r) for n, r in enumerate(ASKED)]).replace("SELECT *", "SELECT CAST(col0 AS BIGINT) AS ord, col1 AS key, col2 AS value"),
    "report_file": report_lines(),
    "lb3_iterate": lb3(3),
    "sandwich_report": sandwich(3),
    "method_random_k": method(f"SELECT row_number() OVER (ORDER BY {uni(str(SEED), 'v')}, v) - 1 AS pos, v AS u FROM ({NODES}) QUALIFY pos < 4"),
    "method_regular_spacing_grid": method(f"SELECT row_number() OVER (ORDER BY fill, v) - 1 AS pos, v AS u FROM (SELECT v, CASE WHEN v // 16 >= 4 AND v % 16 >= 4 AND (v // 16 - 4) % 8 = 0 AND (v % 16 - 4) % 8 = 0 THEN 0 ELSE 1 END AS fill FROM ({NODES})) QUALIFY pos < 4"),
    "method_static_com_greedy": method(f"SELECT round - 1 AS pos, u FROM ({rounds(4, 'st')})", ",\n".join([f"one AS ({NODES.replace('range AS v', 'range AS v, CAST(1 AS DOUBLE) AS c')})", *greedy_rounds("certified", 4, "st", "one")])),
    "method_greedy_original_full": method(f"SELECT round - 1 AS pos, u FROM ({rounds(2, 'gr')})", ",\n".join(greedy_rounds("original", 2, "gr"))),
    "method_bruteforce_ub": method(
        "SELECT unnest([0, 1]) AS pos, unnest([a, b]) * 20 AS u FROM (SELECT a, b FROM ss ORDER BY round(value, 6) DESC, a, b LIMIT 1)",
        f"ce AS (SELECT range AS p FROM range(12)), ss AS MATERIALIZED (SELECT a, b, sum(c * ({psi('m')})) AS value FROM (SELECT a.p AS a, b.p AS b, w.v, sum(w.w) AS m FROM ce a JOIN ce b ON a.p < b.p JOIN w ON w.u IN (a.p * 20, b.p * 20) GROUP BY 1, 2, 3) JOIN co USING (v) GROUP BY a, b)",
    ),
}
