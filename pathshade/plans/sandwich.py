"""The sandwich: an upper and a lower bound are selected greedily, both picks are
evaluated under the original objective, the better one stands (ties: the upper
bound's), certificates bound how far it can be from the best.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathshade.functions.psi import Psi
from pathshade.functions.text import compact, joined
from pathshade.operators import caps as cp
from pathshade.operators import dense
from pathshade.operators import lb3
from pathshade.operators import objectives as ob
from pathshade.operators import unions as un
from pathshade.operators.evaluate import evaluate
from pathshade.operators.greedy import greedy
from pathshade.plans.caches import cap_key
from pathshade.session import written

UB_MODES = ("CertifiedUnion", "CappedUnion", "ProxyCorridor", "SumDeprecated")


@dataclass(frozen=True)
class Config:
    k: int = 50
    psi: Psi = field(default_factory=Psi)
    lam: float = 0.0
    ub_mode: str = "CertifiedUnion"
    corridor_r: int = 2  # of a proxy that selects
    proxy_r: int = 2  # of the proxy baseline
    cap_mode: str = "auto"
    cap_topk: int = 0
    cap_cache: bool = True
    proxy_baseline: bool = True
    lb: str = "first"  # or uniform
    lb3_softmax: bool = False
    lb3_single: bool = False
    lb3_iter: bool = False
    lb3_rounds: int = 1
    lb3_eta: float = 1.0
    lb3_softmax_eta: float = 1.0
    lb3_tol: float = 1e-6
    lb3_keep_best: bool = True
    lb3_from_ub: bool = True
    alpha: float = 0.05


@dataclass
class Sample:
    """Agents' paths; nodes: the union per agent, or its corridor. packed: the paths as
    ``dense.packed``, written, where the other tables need not be read."""

    path_nodes: DataFrame
    paths: DataFrame
    nodes: DataFrame | None = None
    packed: DataFrame | None = None

    def __post_init__(self):
        if self.nodes is not None:
            self.packed = None  # a corridor is not the union of the paths
        else:
            self.nodes = un.agent_nodes(self.path_nodes)


@dataclass(frozen=True)
class Route:
    """The bound that selects: mode, its r, and how it came about."""

    mode: str
    r: int
    one: bool = False  # a proxy of one visit, which is the certified union
    summed: bool = False  # the deprecated sum, which is the proxy over all paths


def routed(config: Config, sample: Sample) -> Route:
    mode, r = config.ub_mode, max(1, config.corridor_r)
    if mode not in UB_MODES:
        raise ValueError(f"unknown upper bound: {mode}")
    summed = mode == "SumDeprecated"
    if summed:
        mode, r = "ProxyCorridor", sample.paths.groupBy("agent").count().agg(F.max("count")).first()[0] or 1
    if mode == "ProxyCorridor" and r <= 1:
        return Route("CertifiedUnion", 1, True, summed)
    return Route(mode, r, False, summed)


def shortest(sample: Sample) -> int:
    """The sum of the agents' shortest lengths."""
    if sample.packed is not None:
        return dense.paths(sample.packed).agg(F.coalesce(F.sum("lmin"), F.lit(0)).cast("long")).first()[0]
    return un.corridor_scalars(sample.paths, 1).first().lmin1


def certified(weights: DataFrame, sample: Sample, config: Config) -> ob.Linear:
    counts = un.union_counts(sample.nodes) if sample.packed is None else dense.union_counts(sample.packed)
    return ob.Linear(weights, written(counts, "coef"), config.psi, config.lam, shortest(sample))


def proxy(weights: DataFrame, sample: Sample, config: Config, r: int) -> ob.Linear:
    coef = un.corridor_stats(sample.path_nodes, r).select("v", F.col("b_r").cast("double").alias("c"))
    return ob.Linear(weights, written(coef, "coef"), config.psi, config.lam, un.corridor_scalars(sample.paths, r).first().lsum_r)


def capped(weights: DataFrame, sample: Sample, config: Config) -> tuple[ob.Capped, str]:
    mode, k = cp.resolve(config.cap_mode, config.psi, config.cap_topk, config.k)
    key = cap_key(weights, mode, k, config.psi) if config.cap_cache and mode != "pathlen" else None
    most = k if mode != "pathlen" else config.k
    if sample.packed is not None and dense.fits(weights):
        caps = cp.packed_caps(mode, sample.packed, weights, config.psi, most, key)
    else:
        caps = cp.caps(mode, sample.paths, sample.path_nodes, weights, config.psi, most, key)
    return ob.Capped(weights, sample.nodes, written(caps, "caps"), config.psi, config.lam, shortest(sample), sample.packed), mode


def lower(weights: DataFrame, sample: Sample, config: Config) -> ob.Linear:
    mix = ob.mixture(sample.paths, config.lb)
    coef = written(ob.mixture_coef(sample.path_nodes, mix), "coef")
    return ob.Linear(weights, coef, config.psi, config.lam, ob.mixture_const(sample.paths, mix).first()[0])


def number(df: DataFrame) -> float:
    return float(df.first()[0])


def lb3_start(weights: DataFrame, sample: Sample, config: Config) -> list[int]:
    """Where the iteration starts: at the proxy's picks over its own sample, or at none."""
    if not config.lb3_from_ub:
        return []
    return [u for u, _ in greedy(proxy(weights, sample, config, max(1, config.corridor_r)), config.k)]


def sandwich(spark: SparkSession, weights: DataFrame, sample: Sample, config: Config, fresh: Sample | None = None, fresh_lb: Sample | None = None, lb3_sample: Callable[[], Sample] | None = None) -> dict:
    """Ordered results: picks, values, certificates, times. fresh: the sample to evaluate on,
    the training sample if none; fresh_lb: another one for the lower bound's set; lb3_sample
    draws the iterated lower bound's own sample (the training sample if none)."""
    began = time.perf_counter()
    route = routed(config, sample)
    original = ob.Original(weights, sample.path_nodes, sample.paths, config.psi, config.lam)
    times: list[float] = []
    union = certified(weights, sample, config)
    cap_mode, cap_k = cp.resolve(config.cap_mode, config.psi, config.cap_topk, config.k)
    wants_caps = route.mode == "CappedUnion" or config.cap_mode != "auto"
    capped_union = capped(weights, sample, config)[0] if wants_caps else None
    upper = {"CappedUnion": lambda: capped_union, "ProxyCorridor": lambda: proxy(weights, sample, config, route.r), "CertifiedUnion": lambda: union}[route.mode]()
    select = time.perf_counter()
    s_ub = [u for u, _ in greedy(upper, config.k, times)]
    if config.lb3_softmax:
        times.clear()
        select = time.perf_counter()
        s_ub = [u for u, _ in greedy(lb3.linearised(original, s_ub, config.lb3_softmax_eta), config.k, times)]
    selection_time = time.perf_counter() - select
    out: dict = {"S_UB": s_ub, "lb3_run_mode": "none", "lb3_iters_done": 0, "lb3_improved": False, "lb3_best_value": 0.0, "lb3_base_value": 0.0}
    if config.lb3_single or config.lb3_iter:
        own = sample if lb3_sample is None else lb3_sample()
        pool = ob.Original(weights, own.path_nodes, own.paths, config.psi, config.lam)
        tried = lb3.iterate(pool, lb3_start(weights, own, config), config.k, config.lb3_eta, config.lb3_rounds if config.lb3_iter else 1, config.lb3_tol, config.lb3_keep_best)
        base = number(original.value(s_ub))
        value = number(original.value(tried.picked)) if tried.picked else base
        if value > base + 1e-9:
            s_ub = tried.picked
        out |= {"S_UB": s_ub, "lb3_run_mode": "iter" if config.lb3_iter else "single", "lb3_iters_done": tried.rounds, "lb3_improved": s_ub is tried.picked, "lb3_best_value": value, "lb3_base_value": base}
    proxy_began = time.perf_counter()
    s_proxy, proxy_score, proxy_r = [], 0.0, 0
    if config.proxy_baseline:
        base_proxy, proxy_r = proxy(weights, sample, config, max(1, config.proxy_r)), max(1, config.proxy_r)
        s_proxy = [u for u, _ in greedy(base_proxy, config.k)]
        proxy_score = number(base_proxy.value(s_proxy))
    elif route.mode == "ProxyCorridor":
        s_proxy, proxy_score, proxy_r = s_ub, number(upper.value(s_ub)), route.r
    out |= {"S_proxy": s_proxy, "proxy_score": proxy_score, "proxy_corridor_r_effective": proxy_r, "proxy_baseline_time_sec": time.perf_counter() - proxy_began if config.proxy_baseline else 0.0}
    s_lb = [u for u, _ in greedy(lower(weights, sample, config), config.k)]
    judge = lambda on: ob.Original(weights, on.path_nodes, on.paths, config.psi, config.lam)
    judges = {"UB": judge(fresh or sample), "LB": judge(fresh_lb or fresh or sample)}
    f_ub, f_lb = number(judges["UB"].value(s_ub)), number(judges["LB"].value(s_lb))
    picked = "UB" if f_ub >= f_lb else "LB"
    pick = {"UB": s_ub, "LB": s_lb}[picked]
    out |= {"S_LB": s_lb, "S_pick": pick, "picked": picked, "F_UB": f_ub, "F_LB": f_lb}
    out |= certificates(config, sample, route, upper, union, capped_union, s_ub, pick)
    out |= {"cap_mode_used": cap_mode, "cap_k_used": cap_k, "selection_objective_type": "proxy" if route.mode == "ProxyCorridor" else "certified"}
    out |= {"selection_mode_effective": route.mode, "selection_proxy_r": route.r if route.mode == "ProxyCorridor" else 0, "routed_r_equals_one": route.one, "sum_deprecated_used": route.summed}
    summary_ = cp.cap_summary(capped_union.caps).first().asDict() if capped_union else {"cap_min": 0.0, "cap_median": 0.0, "cap_max": 0.0}
    out |= {k: float(v or 0.0) for k, v in summary_.items()} | {"cap_total": number(capped_union.caps.agg(F.sum("cap"))) if capped_union else 0.0}
    for name, s in (("pick", pick), ("UB", s_ub), ("LB", s_lb)):
        out[f"stats_{name}"] = evaluate(judges[picked if name == "pick" else name], s, config.alpha).first().asDict()
    return out | {"selection_times": times, "selection_time_sec": selection_time, "time_run_sandwich_sec": time.perf_counter() - began}


def certificates(config: Config, sample: Sample, route: Route, upper, union: ob.Linear, capped_union: ob.Capped | None, s_ub: list[int], pick: list[int]) -> dict:
    """Upper bounds at the pick and at the upper bound's set, in total and by agent. A
    proxy is no bound, so its own total counts as 0."""
    agents = sample.paths.select("agent").distinct().count() if sample.packed is None else sample.packed.count()
    mean = lambda x: x / agents if agents else 0.0
    whole = number(union.value(pick))
    tight = number(capped_union.value(pick)) if capped_union else whole
    bound = tight if route.mode == "CappedUnion" and capped_union else whole
    own = 0.0 if route.mode == "ProxyCorridor" else number(upper.value(s_ub))
    return {
        "certified_union_value": whole,
        "capped_union_value": tight,
        "certified_ub_value": bound,
        "ub_objective_total_S_UB": own,
        "ub_objective_mean_S_UB": mean(own),
        "ub_objective_mean_pick": mean(bound),
        "agents": agents,
    }


def report(result: dict, header: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(section, key, value): the header's pairs in order, then the blocks of the picks."""
    rows = [("header", k, v) for k, v in header]
    for name in ("pick", "UB", "LB"):
        s = result[f"stats_{name}"]
        rows += [(name, "S", joined(result[f"S_{name}"])), *((name, k, compact(s[k])) for k in ("mean", "var", "se", "ci_low", "ci_high")), (name, "M", str(s["m"]))]
    return rows


def report_tsv(rows: list[tuple[str, str, str]]) -> str:
    """Header lines, a blank line, then BEGIN / END blocks with a blank line between."""
    blocks = ["".join(f"{k}\t{v}\n" for s, k, v in rows if s == "header")]
    for name in ("pick", "UB", "LB"):
        blocks.append("".join([f"{name}\tBEGIN\n", *(f"{name}\t{k}\t{v}\n" for s, k, v in rows if s == name), f"{name}\tEND\n"]))
    return "\n".join(blocks)
