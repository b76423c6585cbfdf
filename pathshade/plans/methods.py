"""Selection methods by name. Each takes a Context and returns ordered results
that ``sandwich.report_tsv`` can write."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathshade.functions.text import parse_bool, parse_int, parse_pairs
from pathshade.operators import greedy as gd
from pathshade.operators import objectives as ob
from pathshade.operators.evaluate import evaluate
from pathshade.operators.caps import cap_summary
from pathshade.plans.sandwich import Config, Route, Sample, capped, certificates, certified, number, sandwich


@dataclass
class Context:
    spark: SparkSession
    weights: DataFrame
    candidates: DataFrame
    nodes: DataFrame
    sample: Sample
    config: Config
    seed: int = 1
    rows: int = 0
    cols: int = 0
    blocked: DataFrame | None = None
    fresh: Sample | None = None
    fresh_lb: Sample | None = None
    lb3_sample: Callable[[], Sample] | None = None
    nmax: int = 16
    guard: int | None = None


def measured(c: Context, picked: list[int], began: float, gains: list[float] | None = None, note: str = "") -> dict:
    """A baseline's picks under the original objective, with certificates."""
    on = c.fresh or c.sample
    judge = ob.Original(c.weights, on.path_nodes, on.paths, c.config.psi, c.config.lam, on.packed)
    stats = evaluate(judge, picked, c.config.alpha).first().asDict()
    seconds = time.perf_counter() - began
    out = {"S_pick": picked, "S_UB": picked, "S_LB": picked, "F_pick": number(judge.value(picked)), "gains": gains}
    union, (tight, mode) = certified(c.weights, c.sample, c.config), capped(c.weights, c.sample, c.config)
    out |= certificates(c.config, c.sample, Route("CertifiedUnion", 0), union, union, tight, picked, picked)
    out |= {"cap_mode_used": mode, "cap_k_used": c.config.cap_topk or c.config.k, "note": note}
    out |= {k: float(v or 0.0) for k, v in cap_summary(tight.caps).first().asDict().items()}
    return out | {f"stats_{n}": stats for n in ("pick", "UB", "LB")} | {"selection_time_sec": seconds, "time_method_sec": time.perf_counter() - began}


def run_sandwich(c: Context) -> dict:
    return sandwich(c.spark, c.weights, c.sample, c.config, c.fresh, c.fresh_lb, c.lb3_sample)


def run_random(c: Context) -> dict:
    began = time.perf_counter()
    return measured(c, [r.u for r in gd.random_k(c.candidates, c.config.k, c.seed).collect()], began)


def run_spacing(c: Context) -> dict:
    began = time.perf_counter()
    if c.rows * c.cols != c.nodes.count():
        raise ValueError("regular spacing needs rows * cols to be the number of nodes")
    return measured(c, [r.v for r in gd.regular_spacing(c.nodes, c.rows, c.cols, c.config.k, c.blocked).collect()], began)


def run_coverage(c: Context) -> dict:
    began = time.perf_counter()
    chosen = gd.greedy(gd.coverage(c.weights, None, c.config.psi), c.config.k)
    return measured(c, [u for u, _ in chosen], began, [g for _, g in chosen])


def run_original(c: Context) -> dict:
    began = time.perf_counter()
    objective = ob.Original(c.weights, c.sample.path_nodes, c.sample.paths, c.config.psi, c.config.lam, c.sample.packed)
    chosen = gd.greedy(objective, c.config.k)
    return measured(c, [u for u, _ in chosen], began, [g for _, g in chosen])


def run_brute_force(c: Context) -> dict:
    began = time.perf_counter()
    if c.candidates.count() > c.nmax:
        raise ValueError(f"more than {c.nmax} candidates")
    coef = certified(c.weights, c.sample, c.config).coef
    sets = gd.brute_force(c.weights, c.candidates, coef, c.config.psi, c.config.k, c.guard)
    best = sets.orderBy(F.desc(F.round("value", gd.DIGITS)), "members").first()
    by_position = {r.cpos: r.u for r in c.candidates.collect()}  # at most nmax rows
    return measured(c, [by_position[p] for p in best.members], began)


# Fixed names of cap modes, methods and override keys.
CAP_MODES = {"Auto": "auto", "PathlenOnly": "pathlen", "TopkLocal": "topk", "GlobalAll": "global"}
METHODS: dict[str, tuple[str, Callable[[Context], dict]]] = {
    "sandwich": ("upper and lower bounds, the better pick", run_sandwich),
    "random_k": ("k random candidates", run_random),
    "regular_spacing_grid": ("evenly spaced grid cells", run_spacing),
    "static_com_greedy": ("greedy coverage without paths", run_coverage),
    "greedy_original_full": ("greedy on the original objective", run_original),
    "bruteforce_ub": ("every subset under the certified bound", run_brute_force),
}

ALIASES = {"proxy_r": ("proxy_r", parse_int), "corridor_r": ("corridor_r", parse_int), "cap_cache": ("cap_cache", parse_bool), "ci_alpha": ("alpha", float), "use_lb2": ("lb", lambda x: "uniform" if parse_bool(x) else "first"), "ub_mode": ("ub_mode", str), "cap_mode": ("cap_mode", lambda x: CAP_MODES.get(x, x)), "cap_topk_k": ("cap_topk", parse_int), "k": ("k", parse_int), "lambda": ("lam", float), "enable_proxy_baseline": ("proxy_baseline", parse_bool)}
ALIASES |= {"use_lb3_softmax": ("lb3_softmax", parse_bool), "use_lb3_single": ("lb3_single", parse_bool), "use_lb3_iter": ("lb3_iter", parse_bool), "lb3_max_iters": ("lb3_rounds", parse_int), "lb3_eta": ("lb3_eta", float), "lb3_softmax_eta": ("lb3_softmax_eta", float), "lb3_tol": ("lb3_tol", float), "lb3_keep_best": ("lb3_keep_best", parse_bool), "lb3_start_from_ub": ("lb3_from_ub", parse_bool)}
CONTEXT = {"seed": parse_int, "rows": parse_int, "cols": parse_int, "nmax": parse_int, "guard": parse_int}


def overridden(context: Context, spec: str) -> tuple[Context, list[str]]:
    """The context with ``key=value`` overrides, and the keys that are unknown."""
    given, unknown = parse_pairs(spec), []
    for key, value in given.items():
        if key in ALIASES:
            name, parse = ALIASES[key]
            context = replace(context, config=replace(context.config, **{name: parse(value)}))
        elif key in CONTEXT:
            context = replace(context, **{key: CONTEXT[key](value)})
        else:
            unknown.append(key)
    return context, unknown


def run(name: str, context: Context, overrides: str = "") -> dict:
    if name.lower() not in METHODS:
        raise ValueError(f"unknown method {name!r}; there are {', '.join(METHODS)}")
    context, unknown = overridden(context, overrides)
    out = METHODS[name.lower()][1](replace(context, config=replace(context.config, k=min(context.config.k, context.candidates.count()))))
    return {"method": name.lower(), **({"unknown_overrides": " ".join(unknown)} if unknown else {}), **out}
