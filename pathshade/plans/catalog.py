"""The engine's queries by name; their oracles are in ``oracles``."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathshade.functions.psi import Psi
from pathshade.functions.stats import summary
from pathshade.operators import agents as ag
from pathshade.operators import caps as cp
from pathshade.operators import graph as gr
from pathshade.operators import greedy as gd
from pathshade.operators import lb3
from pathshade.operators import objectives as ob
from pathshade.operators import paths as pt
from pathshade.operators import unions as un
from pathshade.operators import weights as wt
from pathshade.operators.evaluate import evaluate, evaluate_difference
from pathshade.plans import caches as ch
from pathshade.plans import inputs as i
from pathshade.plans.metadata import asked, value
from pathshade.plans.methods import Context
from pathshade.plans.methods import run as run_method
from pathshade.plans.oracles import OPTIONS, ORACLES  # noqa: F401
from pathshade.plans.sandwich import Config, Sample, report, report_tsv, sandwich
from pathshade.session import new_path, written
from pathshade.sources import text as tx
from pathshade.sources.bundle import read_bundle, write_bundle
from pathshade.sources.grid import Grid, col_of, grid_edges, nodes, row_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c) if c in names else F.col(c) for c in df.columns])


# lattices


@query
def grid_edges_4(spark, sf):
    return grid_edges(spark, i.GRID)


@query
def grid_edges_8(spark, sf):
    return grid_edges(spark, Grid(12, 20, diag=True))


@query
def grid_edges_torus(spark, sf):
    return grid_edges(spark, Grid(9, 2, torus=True))


@query
def grid_edge_list(spark, sf):
    return tx.edge_lines(tx.canonical(grid_edges(spark, Grid(9, 7, diag=True, torus=True))))


@query
def grid_edges_cylinder(spark, sf):
    return grid_edges(spark, Grid(5, 4, wrap_cols=True))


# text sources and sinks


def _file(spark, lines: DataFrame) -> DataFrame:
    """Lines written to a text file and read back."""
    path = new_path(spark, "lines")
    tx.write_lines(lines, path)
    return spark.read.text(path)


@query
def edge_file(spark, sf):
    return _file(spark, tx.edge_lines(i.sparse(spark, sf)))


@query
def candidate_file(spark, sf):
    return _file(spark, tx.id_lines(QUERIES["candidate_dedup"](spark, sf), "u"))


@query
def obstacle_file(spark, sf):
    """Blocked nodes as ids, and as cells."""
    shut = i.blocked(spark, sf)
    out = [_file(spark, lines).select(F.lit(kind).alias("kind"), "value") for kind, lines in (("id", tx.id_lines(shut, "v")), ("cell", tx.coordinate_lines(shut, 16)))]
    return out[0].unionByName(out[1])


@query
def obstacle_ids(spark, sf):
    s = i.table(spark, sf, "supplier").select((F.col("s_suppkey") % 90).cast("string").alias("value"))
    path = new_path(spark, "blocked")
    tx.write_lines(s, path)
    return tx.load_blocked(spark, path, 64)


@query
def blocked_metadata(spark, sf):
    folder, n = new_path(spark, "blocked"), i.table(spark, sf, "supplier").count()
    tx.write_bytes(spark, f"{folder}/blocked_meta.json", json.dumps({"blocked_source": "survey", "blocked_seed": n, "blocked_fraction": n / 256, "other": [1]}, indent=1).encode())
    m = tx.blocked_metadata(spark, f"{folder}/blocked.txt")
    return spark.createDataFrame([(m["blocked_source"], m["blocked_seed"], m["blocked_fraction"])], "blocked_source string, blocked_seed long, blocked_fraction double")


@query
def solution_file(spark, sf):
    chosen = gd.greedy(Problem(spark, sf, i.LOG, soft=True).certified(), 3)
    path = new_path(spark, "solution")
    lines = tx.solution_lines([u for u, _ in chosen], sum(g for _, g in chosen), [g for _, g in chosen])
    tx.write_bytes(spark, path, "\n".join(lines).encode())
    return spark.createDataFrame(list(enumerate(tx.read_text(spark, path).split("\n"))), "ord long, value string")


@query
def weights_cache(spark, sf):
    """Weights saved with what they depend on, refused for another kernel, loaded."""
    path, c = new_path(spark, "weights"), i.candidates(spark)
    given = {k: ch.weights_parameters(i.GRID.n, k, c) for k in (str(i.SOFT), "hard:2")}
    ch.save(i.soft(spark), path, **given[str(i.SOFT)])
    try:
        return ch.load(spark, path, **given["hard:2"]).limit(0)
    except ch.Stale:
        return rounded(ch.load(spark, path, **given[str(i.SOFT)]), "w")


@query
def corridor_cache(spark, sf):
    path = new_path(spark, "corridor")
    make = lambda: un.corridor_stats(i.path_nodes(spark, sf), 2)
    ch.load_or_make(spark, path, make, n=i.GRID.n, r=2)
    return ch.load(spark, path, n=i.GRID.n, r=2)


def _fingerprint(spark, df: DataFrame, *columns: str) -> DataFrame:
    return spark.createDataFrame([(ch.fingerprint(df, *columns),)], "fingerprint string")


@query
def weights_fingerprint(spark, sf):
    return _fingerprint(spark, i.soft(spark), "u", "v", "w")


@query
def edges_fingerprint(spark, sf):
    return _fingerprint(spark, i.sparse(spark, sf), "u", "v")


@query
def path_fingerprints(spark, sf):
    drawn = pt.lattice_arrays(i.agents(spark, sf), i.GRID.cols, i.DRAWS, i.SEED).select("agent", F.posexplode("drawn").alias("path", "nodes"))
    return drawn.select("agent", F.col("path").cast("long").alias("path"), F.md5(F.array_join(F.transform("nodes", lambda x: x.cast("string")), " ")).alias("fingerprint"))


@query
def lattice_log_counts(spark, sf):
    a = i.agents(spark, sf)
    down, across = (F.abs(f(F.col("t"), 16) - f(F.col("s"), 16)) for f in (row_of, col_of))
    return a.select("agent", F.round(pt.log_choose(down + across, F.least(down, across)), 6).alias("log_paths"))


@query
def dataset_summary(spark, sf):
    n = i.table(spark, sf, "customer").select(F.col("c_custkey").alias("v"))
    g = gr.graph_summary(n, i.sparse(spark, sf), i.blocked(spark, sf)).first()
    c = QUERIES["candidate_dedup"](spark, sf).count()
    return spark.createDataFrame([(g.n, g.directed_edges // 2, c, g.n_blocked)], "nodes long, edges long, candidates long, blocked long")


@query
def option_values(spark, sf):
    """How option values, data set keys and file places read."""
    from pathshade.plans.options import read_back

    return spark.createDataFrame([(kind, given, read_back(kind, given)) for kind, given, _ in OPTIONS], "kind string, given string, found string")


@query
def edge_text_scan(spark, sf):
    return i.sparse(spark, sf)


@query
def edge_text_odd_lines(spark, sf):
    """One-based ids with comments, short lines and words among them."""
    o = i.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    line = F.when(k % 5 == 0, F.concat(F.lit("# "), k)).when(k % 5 == 1, k.cast("string")).when(k % 5 == 2, F.concat_ws(" ", k, F.lit("x"))).otherwise(F.concat(F.lit("  "), F.col("o_custkey"), F.lit("\t"), k, F.lit(" tail ")))
    n = o.agg(F.max("o_orderkey")).first()[0]  # every id of the lines is below it, but for the last order's
    return tx.edges_of(o.select(line.alias("value")), n=n, undirected=False, one_based=True)


@query
def candidate_dedup(spark, sf):
    p = i.table(spark, sf, "part").select((F.col("p_partkey") * 7 % 601).cast("string").alias("value"), F.col("p_partkey").alias("line"))
    return tx.ids_of(p, n=500)


@query
def blocked_ids(spark, sf):
    return tx.blocked_of(i.table(spark, sf, "supplier").select((F.col("s_suppkey") % 64).cast("string").alias("value")), one_based=True)


@query
def hotspot_parse(spark, sf):
    """Balances as weights, with comments and blank lines among them; those of 0 or less, which
    are errors, lose their sign."""
    c = i.table(spark, sf, "customer").select("c_custkey", (F.abs("c_acctbal") + 0.01).alias("w"))
    line = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("# "), "c_custkey")).when(F.col("c_custkey") % 7 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_custkey", F.lit("\t"), "w"))
    return tx.hotspots_of(c.select(line.alias("value")))


@query
def obstacle_coordinates(spark, sf):
    s = i.table(spark, sf, "supplier")
    return tx.coordinates_of(s.select(F.concat_ws(" ", F.col("s_suppkey") % 19, F.col("s_suppkey") * 5 % 17).alias("value")), 16, 16, one_based=True)


@query
def path_text_round_trip(spark, sf):
    lines = tx.path_lines(i.path_nodes(spark, sf))
    return tx.paths_of(lines, n=i.GRID.n, agent="agent")


@query
def graph_bundle_round_trip(spark, sf):
    path = new_path(spark, "bundle") + ".gbin"
    write_bundle(spark, i.sparse(spark, sf), path, i.customers(spark, sf), blocked=i.blocked(spark, sf))
    return read_bundle(spark, path)


@query
def infer_node_count(spark, sf):
    return tx.node_count(i.sparse(spark, sf))


# graphs


@query
def reverse_edges(spark, sf):
    return gr.reversed_edges(tx.edges_of(i.edge_text(spark, sf), undirected=False))


@query
def degree_summary(spark, sf):
    n = i.table(spark, sf, "customer").select(F.col("c_custkey").alias("v"))
    return gr.degrees(n, i.sparse(spark, sf))


@query
def graph_summary(spark, sf):
    return gr.graph_summary(nodes(spark, i.GRID), grid_edges(spark, i.GRID), i.blocked(spark, sf))


@query
def path_summary(spark, sf):
    return rounded(gr.path_summary(i.paths(spark, sf)), "avg_len")


@query
def bfs_distances(spark, sf):
    return gr.hops(i.sparse(spark, sf), i.sources(spark, sf), symmetric=True)


@query
def reachable_pairs(spark, sf):
    directed = tx.edges_of(i.edge_text(spark, sf), undirected=False)
    return gr.reachable(directed, i.sparse_agents(spark, sf)).select("agent", "s", "t")


@query
def shortest_path_dag(spark, sf):
    return gr.shortest_path_dag(i.sparse(spark, sf), i.sparse_agents(spark, sf), symmetric=True)


@query
def corridor_band(spark, sf):
    return gr.corridor(i.sparse(spark, sf), i.sparse_agents(spark, sf), 1, symmetric=True)


@query
def obstacles_random(spark, sf):
    return gr.random_obstacles(nodes(spark, i.GRID), 40, 11, i.blocked(spark, sf))


@query
def obstacles_apply(spark, sf):
    return gr.without_obstacles(grid_edges(spark, i.GRID), i.blocked(spark, sf))


@query
def walkable_nodes(spark, sf):
    return gr.walkable(nodes(spark, i.GRID), i.blocked(spark, sf))


# weights and responses


@query
def weights_hard(spark, sf):
    return i.hard(spark)


@query
def weights_soft(spark, sf):
    return rounded(i.soft(spark), "w")


@query
def weights_sparse(spark, sf):
    c = i.sources(spark, sf).select(F.col("src").alias("u"), F.col("src").alias("cpos"))
    return rounded(wt.soft_weights(i.sparse(spark, sf), c, wt.SoftDecay(1.0, 2, 1e-4)), "w")


def _psi(name: str, psi: Psi):
    def run(spark, sf):
        t = i.table(spark, sf, "lineitem")
        return t.select("l_orderkey", "l_linenumber", F.round(psi((F.col("l_quantity") - 5) / 10), 6).alias("psi"))

    QUERIES[name] = run


for _name, _p in (("psi_clip", Psi("clip", 1.5)), ("psi_log1p", Psi("log1p", 0.0)), ("psi_expsat", Psi("expsat", 0.7)), ("psi_power", Psi("power", 0.5))):
    _psi(_name, _p)


# agents


def _od(name: str, od: ag.OD, **more):
    def run(spark, sf):
        attempts = i.table(spark, sf, "customer").select(F.col("c_custkey").alias("attempt"))
        walk = i.table(spark, sf, "part").select((F.col("p_partkey") % i.GRID.n).alias("v"))
        hot = i.hotspots(spark, sf) if od.kind == "hotspot" else None
        return ag.sample_od(attempts, walk, od, i.SEED, 12, hot, i.blocked(spark, sf) if od.kind in ("gaussian", "hotspot") else None)

    QUERIES[name] = run


for _k, _o in (("uniform", {}), ("band", {"dmin": 4, "dmax": 12}), ("gaussian", {"sigma": 1.5}), ("hotspot", {}), ("gravity", {"beta": 0.3})):
    _od(f"od_{_k}", ag.OD(_k, rows=16, cols=16, **_o))


@query
def od_first_agents(spark, sf):
    return ag.first_agents(QUERIES["od_band"](spark, sf), 500)


# paths


@query
def lattice_paths(spark, sf):
    return i.path_nodes(spark, sf)


@query
def k_distinct_paths(spark, sf):
    return pt.exploded(pt.distinct_arrays(pt.lattice_arrays(i.agents(spark, sf), i.GRID.cols, 5, i.SEED), 3))


@query
def dag_path_counts(spark, sf):
    return pt.shortest_counts(i.sparse(spark, sf), written(i.sparse_agents(spark, sf), "agents"), symmetric=True)


@query
def dag_path_sample(spark, sf):
    return pt.shortest_draws(i.sparse(spark, sf), written(i.sparse_agents(spark, sf), "agents"), 3, i.SEED, symmetric=True)


# unions


@query
def union_counts(spark, sf):
    return un.union_counts(un.agent_nodes(i.path_nodes(spark, sf)))


@query
def agent_lengths(spark, sf):
    return un.agent_lengths(i.paths(spark, sf))


@query
def corridor_stats(spark, sf):
    return un.corridor_stats(i.path_nodes(spark, sf), 2)


@query
def corridor_scalars(spark, sf):
    return un.corridor_scalars(i.paths(spark, sf), 2)


# objectives


class Problem:
    """The tables that objectives share, written once."""

    def __init__(self, spark, sf, psi: Psi = i.CLIP, soft: bool = False):
        self.psi, self.weights = psi, written(i.soft(spark) if soft else i.hard(spark), "weights")
        self.path_nodes = written(i.path_nodes(spark, sf), "paths")
        self.paths = written(pt.path_lengths(self.path_nodes), "lengths")
        self.nodes = un.agent_nodes(self.path_nodes)

    def scalars(self):
        return un.corridor_scalars(self.paths, 2).first()

    def certified(self) -> ob.Linear:
        return ob.Linear(self.weights, written(un.union_counts(self.nodes), "coef"), self.psi, i.LAMBDA, self.scalars().lmin1)

    def proxy(self) -> ob.Linear:
        coef = un.corridor_stats(self.path_nodes, 2).select("v", F.col("b_r").cast("double").alias("c"))
        return ob.Linear(self.weights, written(coef, "coef"), self.psi, i.LAMBDA, self.scalars().lsum_r)

    def lower(self, kind: str) -> ob.Linear:
        mix = ob.mixture(self.paths, kind)
        return ob.Linear(self.weights, written(ob.mixture_coef(self.path_nodes, mix), "coef"), self.psi, i.LAMBDA, ob.mixture_const(self.paths, mix).first()[0])

    def original(self) -> ob.Original:
        return ob.Original(self.weights, self.path_nodes, self.paths, self.psi, i.LAMBDA)

    def capped(self, mode: str = "pathlen", k: int = 3) -> ob.Capped:
        caps = written(cp.caps(mode, self.paths, self.path_nodes, self.weights, self.psi, k), "caps")
        return ob.Capped(self.weights, written(self.nodes, "nodes"), caps, self.psi, i.LAMBDA, self.scalars().lmin1)


OBJECTIVES = {"certified": lambda p: p.certified(), "proxy": lambda p: p.proxy(), "lb1": lambda p: p.lower("first"), "lb2": lambda p: p.lower("uniform"), "original": lambda p: p.original(), "capped": lambda p: p.capped("topk")}


def _value(kind: str):
    def run(spark, sf):
        return rounded(OBJECTIVES[kind](Problem(spark, sf, i.LOG, soft=True)).value(i.PICKED), "value")

    QUERIES[f"{kind}_value"] = run


def _marginals(kind: str):
    def run(spark, sf):
        gains = OBJECTIVES[kind](Problem(spark, sf, i.LOG, soft=True)).gains(i.PICKED[:2])
        return gains.withColumn("gain", F.round("gain", 4))

    QUERIES[f"marginals_{kind}"] = run


def _greedy(kind: str, k: int):
    def run(spark, sf):
        return gd.picks(spark, gd.greedy(OBJECTIVES[kind](Problem(spark, sf, i.LOG, soft=True)), k))

    QUERIES[f"greedy_{kind}"] = run


for _k in OBJECTIVES:
    _value(_k)
    _marginals(_k)
    _greedy(_k, 5)


@query
def static_greedy(spark, sf):
    demand = i.table(spark, sf, "customer").groupBy((F.col("c_custkey") % i.GRID.n).alias("v")).agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).cast("double").alias("c"))
    return gd.picks(spark, gd.greedy(gd.coverage(written(i.hard(spark), "weights"), written(demand, "demand"), i.CLIP), 4))


@query
def lazy_greedy_certified(spark, sf):
    return gd.picks(spark, gd.lazy_greedy(Problem(spark, sf, i.LOG, soft=True).certified(), 5))


# caps


def _caps(mode: str, psi: Psi):
    def run(spark, sf):
        p = Problem(spark, sf, psi, soft=True)
        return rounded(cp.caps(mode, p.paths, p.path_nodes, p.weights, psi, 3), "cap")

    QUERIES[f"caps_{mode}"] = run


for _m, _q in (("pathlen", i.CLIP), ("topk", i.LOG), ("global", i.LOG)):
    _caps(_m, _q)


@query
def union_averages(spark, sf):
    p = Problem(spark, sf, i.LOG, soft=True)
    caps = cp.total(cp.caps("topk", p.paths, p.path_nodes, p.weights, i.LOG, 3)).first()[0]
    return un.average_agents(un.union_counts(p.nodes), i.GRID.n).select("avg_agents_per_node", F.round(F.lit(caps), 4).alias("total_cap"))


@query
def cap_summary(spark, sf):
    return rounded(cp.cap_summary(QUERIES["caps_topk"](spark, sf)), "cap_min", "cap_median", "cap_max")


# baselines


@query
def random_k(spark, sf):
    return gd.random_k(i.table(spark, sf, "part").select(F.col("p_partkey").alias("u"), F.col("p_partkey").alias("cpos")), 50, i.SEED)


@query
def regular_spacing(spark, sf):
    return gd.regular_spacing(nodes(spark, i.GRID), 16, 16, 20, i.blocked(spark, sf))


@query
def bruteforce_small(spark, sf):
    few = i.table(spark, sf, "nation").select((F.col("n_nationkey").cast("long") * 10).alias("u"), F.col("n_nationkey").cast("long").alias("cpos"))
    p = Problem(spark, sf, i.LOG, soft=True)
    w = p.weights.drop("cpos").join(few, "u")
    out = gd.brute_force(w, few, p.certified().coef, i.LOG, 3, guard=10_000)
    return out.select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.round("value", 6).alias("value"))


# lower bounds and evaluation


@query
def softmax_mixture(spark, sf):
    return rounded(ob.softmax_mixture(Problem(spark, sf, i.LOG, soft=True).original().scores(i.PICKED), 1.0), "alpha")


@query
def lb3_iterate(spark, sf):
    out = lb3.iterate(Problem(spark, sf, i.LOG, soft=True).original(), list(i.PICKED), 3, 1.0, 2)
    return spark.createDataFrame([(n + 1, u, round(out.value, 6)) for n, u in enumerate(out.picked)], "round long, u long, value double")


@query
def eval_stats(spark, sf):
    return rounded(evaluate(Problem(spark, sf, i.LOG, soft=True).original(), i.PICKED), "mean", "var", "se", "ci_low", "ci_high")


@query
def eval_diff_stats(spark, sf):
    return rounded(evaluate_difference(Problem(spark, sf, i.LOG, soft=True).original(), i.PICKED, i.OTHER), "mean", "var", "se", "ci_low", "ci_high")


@query
def sample_summary_by_segment(spark, sf):
    return rounded(summary(i.table(spark, sf, "customer"), "c_acctbal", 0.1, ["c_mktsegment"]), "mean", "var", "se", "ci_low", "ci_high")


REPORTED = ("S_UB", "S_LB", "S_proxy", "S_pick", "picked", "F_UB", "F_LB", "certified_union_value", "capped_union_value", "certified_ub_value", "ub_objective_total_S_UB", "ub_objective_mean_S_UB", "ub_objective_mean_pick", "proxy_score")


@query
def sandwich_report(spark, sf):
    """What does not depend on the clock."""
    p = Problem(spark, sf, i.CLIP)
    out = sandwich(spark, p.weights, Sample(p.path_nodes, p.paths), Config(k=3, lam=i.LAMBDA))
    return spark.createDataFrame([(k, value(out[k])) for k in REPORTED], "key string, value string")


@query
def report_metadata(spark, sf):
    """What a report says that a run was asked for, in order."""
    run = {"cap_cache": True, "corridor_band_r": -1, "M_agents": 100, "K_paths_per_agent": 5, "M_eval": 0, "reuse_eval_samples": True, "seed": 7}
    rows = asked(Config(k=5, lam=i.LAMBDA), run, ag.OD("band", 4, 12, rows=16, cols=16))
    return spark.createDataFrame([(n, k, value(v)) for n, (k, v) in enumerate(rows)], "ord long, key string, value string")


@query
def report_file(spark, sf):
    """A report's lines, written and read back."""
    o = Problem(spark, sf, i.LOG, soft=True).original()
    of = {"pick": i.PICKED, "UB": i.PICKED, "LB": i.OTHER}
    result = {f"S_{k}": list(s) for k, s in of.items()} | {f"stats_{k}": evaluate(o, s).first().asDict() for k, s in of.items()}
    path = new_path(spark, "report")
    tx.write_bytes(spark, path, report_tsv(report(result, [("tag", "t"), ("k", "5")])).encode())
    return spark.createDataFrame(list(enumerate(tx.read_text(spark, path).rstrip("\n").split("\n"))), "ord long, value string")


def _method(name: str, k: int):
    def run(spark, sf):
        c, w = i.candidates(spark), written(i.soft(spark), "weights")
        packed = written(pt.lattice_packed(i.agents(spark, sf), i.GRID.cols, i.DRAWS, i.SEED), "agents")
        if name == "bruteforce_ub":  # every twentieth node
            c = spark.range(12).select((F.col("id") * 20).alias("u"), F.col("id").alias("cpos"))
            w = written(w.drop("cpos").join(c, "u"), "few")
        context = Context(spark, w, c, nodes(spark, i.GRID), Sample(i.path_nodes(spark, sf), i.paths(spark, sf), packed=packed), Config(k=k, psi=i.LOG, lam=i.LAMBDA), i.SEED, 16, 16)
        out = run_method(name, context)
        return spark.createDataFrame([(n, u, round(out["F_pick"], 6), round(out["certified_union_value"], 6)) for n, u in enumerate(out["S_pick"])], "pos long, u long, f_pick double, certified double")

    QUERIES[f"method_{name}"] = run


for _m, _n in (("random_k", 4), ("regular_spacing_grid", 4), ("static_com_greedy", 4), ("greedy_original_full", 2), ("bruteforce_ub", 2)):
    _method(_m, _n)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["greedy_certified"](spark, sf)
