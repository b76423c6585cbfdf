"""Option values read back as text, for golden comparisons."""

from __future__ import annotations

from pathshade.functions.psi import parse_psi
from pathshade.functions.text import compact, dataset_key, flag, fnv1a_hex, parse_pairs, path_hash
from pathshade.operators.agents import OD, parse_od
from pathshade.operators.caps import resolve
from pathshade.operators.weights import parse_soft_decay
from pathshade.plans.locations import located
from pathshade.plans.metadata import od_params
from pathshade.sources.grid import parse_grid
from pathshade.sources.text import parse_hotspots


def _options(given: str) -> dict:
    return dict(x.split("=", 1) for x in given.split(";") if x)


def _cap(given: str) -> str:
    mode, psi, topk, budget = given.split()
    return "{} {}".format(*resolve(mode, parse_psi(psi), int(topk), int(budget)))


def _grid(given: str) -> str:
    g = parse_grid(given)
    return f"{g.rows} {g.cols} {flag(g.diag)} {flag(g.torus)}"


def _kernel(given: str) -> str:
    k = parse_soft_decay(given)
    return f"{compact(k.alpha)} {k.radius} {compact(k.epsilon)}"


def _psi(given: str) -> str:
    p = parse_psi(given)
    return f"{p} {compact(p.bound)} {flag(p.monotone)}"


def _od_json(given: str) -> str:
    kind, *numbers = given.split()
    named = dict(zip({"band": ("dmin", "dmax"), "gaussian": ("sigma",), "gravity": ("beta",)}.get(kind, ()), (int(x) if x.isdigit() else float(x) for x in numbers)))
    return od_params(OD(kind, rows=16, cols=16, **named))


def _place(given: str) -> str:
    before = _options(given)
    after, _, _ = located({**before, "paths_mode": "smart"}, lambda path: path in before.values())
    return " ".join(f"{k}={after[k]}" for k in before if after[k] != before[k])


READERS = {
    "cap": _cap,
    "fnv": lambda x: fnv1a_hex(x.encode()),
    "grid": _grid,
    "hotspots": lambda x: " ".join(f"{v} {compact(w)}" for v, w in parse_hotspots(x)),
    "kernel": _kernel,
    "od": parse_od,
    "od_json": _od_json,
    "pairs": lambda x: " ".join(f"{k}={v}" for k, v in parse_pairs(x).items()),
    "path": lambda x: f"{path_hash(map(int, x.split())):016x}",
    "place": _place,
    "psi": _psi,
    "key": lambda x: " ".join(dataset_key(_options(x))),
}


def read_back(kind: str, given: str) -> str:
    return READERS[kind](given)
