"""Command line: ``python -m pathshade.plans.cli --make_grid rows=16,cols=16 --hard_cutoff 2 ...``."""

from __future__ import annotations

import argparse
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathshade.functions.psi import parse_psi
from pathshade.functions.text import parse_bool
from pathshade.operators import agents as ag
from pathshade.operators import graph as gr
from pathshade.operators import paths as pt
from pathshade.operators import unions as un
from pathshade.operators.weights import hard_weights, parse_soft_decay, soft_weights
from pathshade.plans.caches import cap_key, load, save, weights_parameters
from pathshade.plans.locations import copy, located, on_disk
from pathshade.plans.metadata import header, run_config
from pathshade.plans.methods import CAP_MODES, METHODS, Context, run
from pathshade.plans.sandwich import UB_MODES, Config, Sample, report, report_tsv
from pathshade.session import local_session, written
from pathshade.sources import text as tx
from pathshade.sources.bundle import read_bundle, read_bundle_sets, write_bundle
from pathshade.sources.grid import grid_edges, parse_grid


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathshade", description="Place k facilities on a pedestrian network.")
    at_least = lambda low: lambda s: max(low, int(s))
    for flag, kind, default in (
        ("edges", str, None), ("n", int, None), ("one_based", parse_bool, False), ("undirected", parse_bool, True), ("cands", str, None), ("blocked", str, None),
        ("graph_bin_in", str, None), ("graph_bin_out", str, None), ("pack_candidates", str, None), ("pack_blocked", str, None), ("emit_edges", str, None), ("chain_run", parse_bool, False),
        ("make_grid", parse_grid, None), ("hard_cutoff", int, None), ("soft_decay", parse_soft_decay, None), ("weights_bin", str, None), ("load_weights", parse_bool, False), ("save_weights", parse_bool, False),
        ("psi", parse_psi, parse_psi("clip:1.0")), ("lambda", float, 0.0), ("k", at_least(1), 50), ("M_agents", at_least(1), 10000), ("K_paths_per_agent", at_least(1), 10), ("M_eval", at_least(0), 0),
        ("reuse_eval_samples", parse_bool, True), ("corridor_r", at_least(1), 2), ("corridor_band_r", int, -1), ("proxy_r", at_least(1), 2), ("cap_topk_k", at_least(0), 0), ("cap_cache", parse_bool, True), ("enable_proxy_baseline", parse_bool, True),
        ("use_LB3_softmax", parse_bool, False), ("use_LB3_single", parse_bool, False), ("use_LB3_iter", parse_bool, False), ("lb3_max_iters", at_least(1), 1), ("lb3_eta", float, 1.0), ("lb3_tol", float, 1e-6),
        ("lb3_keep_best", parse_bool, True), ("lb3_start_from_UB", parse_bool, True), ("lb3_softmax_eta", float, 1.0), ("use_LB2", parse_bool, False), ("ci_alpha", float, 0.05), ("od_band", str, None), ("od_sigma", float, 0.0), ("od_hotspots", tx.parse_hotspots, None),
        ("od_hotspots_file", str, None), ("od_gravity_beta", float, 0.0), ("od_rows", int, 0), ("od_cols", int, 0), ("out_dir", str, "out"), ("tag", str, "run"), ("dataset_key", str, None), ("seed", int, 1), ("dry_run", parse_bool, False), ("json_meta", str, None), ("margs", str, ""),
    ):
        p.add_argument(f"--{flag}", type=kind, default=default)
    p.add_argument("--ub_mode", choices=UB_MODES, default="CertifiedUnion")
    p.add_argument("--cap_mode", choices=CAP_MODES, default="Auto")
    p.add_argument("--od_dist", type=ag.parse_od, default="uniform")
    p.add_argument("--paths_mode", choices=("smart", "legacy"), default="legacy")
    p.add_argument("--log_level", choices=("info", "debug"), default="info")
    p.add_argument("--method", type=str.lower, choices=METHODS, default="sandwich")
    p.add_argument("--list-methods", action="store_true")
    p.add_argument("--path_mode", choices=("auto", "bfs"), default="auto", help="bfs: true shortest paths on grids, too")
    p.add_argument("--exclude_blocked", type=parse_bool, default=False, help="take blocked nodes out of the candidates")
    return p


def validated(o: argparse.Namespace, p: argparse.ArgumentParser) -> argparse.Namespace:
    if not (o.edges or o.graph_bin_in or o.make_grid):
        p.error("a graph is needed: --edges, --graph_bin_in or --make_grid")
    if (o.emit_edges or o.chain_run) and not o.make_grid:
        p.error("--emit_edges and --chain_run need --make_grid")
    if bool(o.od_rows) != bool(o.od_cols):
        p.error("--od_rows and --od_cols go together")
    if o.hard_cutoff is not None and o.soft_decay is not None:
        p.error("one kernel at most")
    only_edges = o.emit_edges and not o.chain_run
    if not only_edges and not o.graph_bin_out and o.hard_cutoff is None and o.soft_decay is None and not o.load_weights:
        p.error("a kernel is needed: --hard_cutoff, --soft_decay or --load_weights 1")
    if o.od_dist == "hotspot" and not (o.od_hotspots or o.od_hotspots_file):
        p.error("hotspot needs --od_hotspots or --od_hotspots_file")
    if o.od_hotspots and o.od_hotspots_file:
        p.error("--od_hotspots and --od_hotspots_file exclude each other")
    o.od_inherited = bool(o.make_grid and not o.od_rows)
    if o.od_inherited:
        o.od_rows, o.od_cols = o.make_grid.rows, o.make_grid.cols
    if o.od_dist == "band" and not o.od_band:
        p.error("band needs --od_band MIN:MAX")
    distribution(o)  # the parameters it needs, before anything runs
    return o


class Log:
    """Lines that are printed and kept for stdout.txt."""

    def __init__(self, debug: bool):
        self.debug, self.lines = debug, []

    def say(self, line: str, debug: bool = False) -> None:
        if self.debug or not debug:
            print(line)
            self.lines.append(line)

    def flush(self, spark: SparkSession, path: str) -> None:
        tx.write_bytes(spark, path, ("\n".join(self.lines) + "\n").encode())


def distribution(o: argparse.Namespace) -> ag.OD:
    dmin, dmax = (int(x) for x in o.od_band.split(":")) if o.od_band else (0, 0)
    return ag.OD(o.od_dist, dmin, dmax, o.od_sigma, o.od_gravity_beta, o.od_rows, o.od_cols)


def load_graph(spark: SparkSession, o: argparse.Namespace) -> tuple[DataFrame, int]:
    if o.graph_bin_in:
        about = read_bundle_sets(spark, o.graph_bin_in)
        o.undirected = o.undirected and not about["directed"]
        return read_bundle(spark, o.graph_bin_in), about["n"]
    if o.make_grid:
        return grid_edges(spark, o.make_grid), o.make_grid.n
    lines = tx.read_lines(spark, o.edges)
    n = o.n or tx.node_count(tx.edges_of(lines, None, True, o.one_based)).first().n
    if not n:
        raise ValueError("the edge list is empty")
    return tx.edges_of(lines, n, o.undirected, o.one_based), n


def sample_paths(spark: SparkSession, edges: DataFrame, candidates: DataFrame, o: argparse.Namespace, m: int, seed: int, blocked: DataFrame | None, hot: DataFrame | None = None) -> tuple[Sample, int]:
    """The first m agents of at most max(20 m, 200) attempts, with K paths each, and the
    number of attempts before the last of them that had a pair without a path. Attempts are
    drawn in rounds, each twice as large, until there are enough."""
    od, most = distribution(o), max(20 * m, 200)
    walk = candidates.select(F.col("u").alias("v"))
    lattice = o.od_cols and o.corridor_band_r < 0 and o.path_mode == "auto"
    at, size, parts, pairs, have = 0, max(2 * m, 200), [], [], 0
    while have < m and at < most:
        attempts = spark.range(at, min(most, at + size)).withColumnRenamed("id", "attempt")
        drawn = written(ag.sample_od(attempts, walk, od, seed, ag.TRIES, hot, blocked), "drawn")
        pairs.append(drawn)
        parts.append(drawn if lattice else written(gr.reachable(edges, drawn, o.undirected).select("attempt", "s", "t", "try"), "reachable"))
        have += parts[-1].count()
        at, size = at + size, size * 2
    if not have:
        raise ValueError("no attempt gave a pair of nodes with a path between them")
    good, all_pairs = (reduce(DataFrame.unionByName, x) for x in (parts, pairs))
    chosen = written(good.orderBy("attempt").limit(m), "attempts")
    agents = written(ag.first_agents(chosen, m), "agents")
    last = chosen.agg(F.max("attempt")).first()[0]
    dropped = 0 if lattice else all_pairs.where(F.col("attempt") <= last).count() - chosen.count()
    k, tries = o.K_paths_per_agent, max(2 * o.K_paths_per_agent, 8)
    nodes = None
    if lattice:
        drawn = pt.lattice_arrays(agents, o.od_cols, tries, seed)
    else:
        band = written(gr.corridor(edges, agents, o.corridor_band_r, o.undirected), "band") if o.corridor_band_r >= 0 else None
        dag = written(gr.shortest_path_dag(edges, agents, band, o.undirected), "dag")
        drawn, nodes = pt.arrays_of(pt.dag_draws(dag, written(pt.dag_counts(dag, agents), "counts"), agents, tries, seed)), band
    path_nodes = written(pt.exploded(pt.distinct_arrays(drawn, k)), "paths")
    return Sample(path_nodes, written(pt.path_lengths(path_nodes), "lengths"), nodes), dropped if o.corridor_band_r >= 0 else 0


def hotspots(spark: SparkSession, o: argparse.Namespace, n: int) -> tuple[DataFrame | None, dict]:
    """hotspots(node, weight) and what the report says of them."""
    if o.od_dist != "hotspot":
        return None, {}
    if o.od_hotspots:
        given, more = o.od_hotspots, {}
    else:
        lines = tx.read_lines(spark, o.od_hotspots_file)
        given = [(r.node, r.weight) for r in tx.hotspots_of(lines).collect()]  # they are named in the report
        more = {"od_hotspots_hash": tx.hotspots_hash(lines)}
    if not given or any(node >= n for node, _ in given):
        raise ValueError("hotspots are missing or outside the graph")
    return spark.createDataFrame(given, "node long, weight double"), {"hotspots": given, "od_hotspot_count": len(given), **more}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = parser()
    o = p.parse_args(argv)
    if o.list_methods:
        for name, (what, _) in METHODS.items():
            print(f"{name}\t{what}")
        return {}
    o = validated(o, p)
    spark = spark or local_session()
    began, log = time.perf_counter(), Log(o.log_level == "debug")
    placed, copies, said = located(vars(o), on_disk(spark))
    for source, target in copies:
        copy(spark, source, target)
    o = argparse.Namespace(**placed)
    out = f"{o.out_dir.rstrip('/')}/{o.tag}"
    for line in said:
        log.say(line)
    edges, n = load_graph(spark, o)
    if o.emit_edges:
        tx.write_lines(tx.edge_lines(tx.canonical(edges)), o.emit_edges)
        if not o.chain_run:
            return {"emitted": o.emit_edges}
    nodes = spark.range(n).withColumnRenamed("id", "v")
    candidates = tx.ids_of(tx.read_lines(spark, o.cands), n, o.one_based) if o.cands else nodes.select(F.col("v").alias("u"), F.col("v").alias("cpos"))
    blocked = tx.load_blocked(spark, o.blocked, n, o.one_based) if o.blocked else None
    about = {"blocked_source": o.blocked, **tx.blocked_metadata(spark, o.blocked)} if o.blocked else {}
    if blocked is not None and o.exclude_blocked:
        candidates = candidates.join(blocked.withColumnRenamed("v", "u"), "u", "left_anti")
    if o.graph_bin_out:
        packed = tx.ids_of(tx.read_lines(spark, o.pack_candidates), n, o.one_based) if o.pack_candidates else candidates
        shut = tx.load_blocked(spark, o.pack_blocked, n, o.one_based, allow_empty=True) if o.pack_blocked else blocked
        told = tx.blocked_metadata(spark, o.pack_blocked) if o.pack_blocked else about
        write_bundle(spark, edges, o.graph_bin_out, n, packed, shut, not o.undirected, {"candidates_src": o.pack_candidates or o.cands or "all", **told, "build_cmdline": " ".join(argv or [])})
        if o.hard_cutoff is None and o.soft_decay is None and not o.load_weights:
            return {"packed": o.graph_bin_out}
    summary = gr.graph_summary(nodes, edges).first()
    counts = {"candidate_count": candidates.count(), "blocked_count": blocked.count() if blocked is not None else 0}
    log.say(f"[debug] dataset_summary: nodes={n}, edges={summary.directed_edges // 2 if o.undirected else summary.directed_edges}, candidates={counts['candidate_count']}, blocked={counts['blocked_count']}", debug=True)
    config = Config(
        k=o.k, psi=o.psi, lam=getattr(o, "lambda"), ub_mode=o.ub_mode, corridor_r=o.corridor_r, proxy_r=o.proxy_r, cap_mode=CAP_MODES[o.cap_mode], cap_topk=o.cap_topk_k, cap_cache=o.cap_cache, proxy_baseline=o.enable_proxy_baseline,
        lb="uniform" if o.use_LB2 else "first", lb3_softmax=o.use_LB3_softmax, lb3_single=o.use_LB3_single, lb3_iter=o.use_LB3_iter, lb3_rounds=o.lb3_max_iters, lb3_eta=o.lb3_eta, lb3_softmax_eta=o.lb3_softmax_eta, lb3_tol=o.lb3_tol, lb3_keep_best=o.lb3_keep_best, lb3_from_ub=o.lb3_start_from_UB, alpha=o.ci_alpha,
    )
    meta = vars(o) | {"n": n}
    tx.write_bytes(spark, o.json_meta or f"{out}/run_config.json", run_config(meta).encode())
    for key, value in meta.items():
        log.say(f"[debug] {key}={value}", debug=True)
    if o.dry_run:
        log.flush(spark, f"{out}/stdout.txt")
        return meta
    built = time.perf_counter()
    weights = load_weights(spark, o, edges, n, candidates, o.weights_bin or f"{out}/weights")
    built = time.perf_counter() - built
    hot, of_hotspots = hotspots(spark, o, n)
    draw = lambda m, seed: sample_paths(spark, edges, candidates, o, m, seed, blocked, hot)
    sample, dropped = draw(o.M_agents, o.seed)
    fresh = fresh_lb = None
    if o.M_eval and (not o.reuse_eval_samples or o.method != "sandwich"):
        fresh = draw(o.M_eval, o.seed + 999)[0]
        fresh_lb = draw(o.M_eval, o.seed + 1999)[0] if o.method == "sandwich" else None
    context = Context(spark, weights, candidates, nodes, sample, config, o.seed, o.od_rows, o.od_cols, blocked, fresh, fresh_lb, lambda: draw(o.M_agents, o.seed + 424242)[0])
    result = run(o.method, context, o.margs)
    if not o.M_eval:  # nothing was evaluated beyond the totals
        result |= {f"stats_{s}": {"mean": 0.0, "var": 0.0, "se": 0.0, "ci_low": 0.0, "ci_high": 0.0, "m": 0} for s in ("pick", "UB", "LB")}
    average = un.average_agents(un.union_counts(sample.nodes), n).first()[0]
    ran = {**vars(o), **counts, **about, **of_hotspots, "agents_dropped": dropped, "avg_agents_per_node": average, "time_build_weights_sec": built}
    if result.get("cap_mode_used") in ("topk", "global"):
        ran["cap_cache_key"] = cap_key(weights, result["cap_mode_used"], result["cap_k_used"], config.psi)
    rows = report(result, header(config, result, ran, distribution(o), o.tag))
    tx.write_bytes(spark, f"{out}/report.tsv", report_tsv(rows).encode())
    solution = "\n".join(tx.solution_lines(result["S_pick"], result.get("F_pick", max(result.get("F_UB", 0.0), result.get("F_LB", 0.0))), result.get("gains")))
    tx.write_bytes(spark, f"{out}/solution.txt", (solution + "\n").encode())
    log.say(f"[info] method={o.method} selection_time={result['selection_time_sec']:.6f} s (total wall clock {time.perf_counter() - began:.6f} s)")
    log.flush(spark, f"{out}/stdout.txt")
    return result


def load_weights(spark: SparkSession, o: argparse.Namespace, edges: DataFrame, n: int, candidates: DataFrame, cache: str) -> DataFrame:
    """Weights from the cache, which must have been made for this graph's size, candidates
    and kernel (if one is given), or new ones."""
    kernel = f"hard:{o.hard_cutoff}" if o.hard_cutoff is not None else str(o.soft_decay) if o.soft_decay is not None else None
    if o.load_weights:
        return load(spark, cache, **weights_parameters(n, kernel, candidates))
    weights = hard_weights(edges, candidates, o.hard_cutoff) if o.hard_cutoff is not None else soft_weights(edges, candidates, o.soft_decay)
    return save(weights, cache, **weights_parameters(n, kernel, candidates)) if o.save_weights else written(weights, "weights")


if __name__ == "__main__":
    main()
