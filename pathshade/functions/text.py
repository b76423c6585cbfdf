"""Strict parsing and formatting of option values."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable


def parse_int(text: str) -> int:
    if not re.fullmatch(r"[+-]?\d+", text.strip()):
        raise ValueError(f"not an integer: {text!r}")
    return int(text)


def parse_bool(text: str) -> bool:
    found = {"1": True, "true": True, "True": True, "0": False, "false": False, "False": False}.get(text)
    if found is None:
        raise ValueError(f"not 0, 1, true or false: {text!r}")
    return found


def parse_pairs(text: str) -> dict[str, str]:
    """``a=1,b=2`` with lower-case keys."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, eq, value = part.partition("=")
        if not eq or not key.strip():
            raise ValueError(f"not key=value: {part!r}")
        out[key.strip().lower()] = value.strip()
    return out


# Fixed values of the FNV-1a hash; graphs and paths start from a basis of their own.
FNV_BASIS, FNV_WORD_BASIS, FNV_PRIME = 0xCBF29CE484222325, 1469598103934665603, 0x100000001B3


def fnv1a(values: Iterable[int], basis: int = FNV_BASIS) -> int:
    """The 64-bit FNV-1a hash over bytes or whole words."""
    h = basis
    for x in values:
        h = ((h ^ x) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_hex(data: bytes) -> str:
    """16 hex digits."""
    return f"{fnv1a(data):016x}"


def path_hash(nodes: Iterable[int]) -> int:
    """Of a path's nodes in order, each a 32-bit word."""
    return fnv1a((v & 0xFFFFFFFF for v in nodes), FNV_WORD_BASIS)


def log_choose(n: int, k: int) -> float:
    """Logarithm of the binomial coefficient; -1e300 outside 0 <= k <= n."""
    if k < 0 or k > n:
        return -1e300
    return sum(math.log(n - min(k, n - k) + i) - math.log(i) for i in range(1, min(k, n - k) + 1))


def sanitized(raw: str) -> str:
    """Upper-case letters and digits; runs of blanks, hyphens and underscores become
    one underscore, all else goes."""
    kept = re.sub(r"[^A-Za-z0-9_\- ]", "", raw)
    return re.sub(r"[_\- ]+", "_", kept).lstrip("_").upper() or "DATASET"


def stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name[: name.rindex(".")] if "." in name[1:] else name


def parent(path: str) -> str:
    return path.rstrip("/").rsplit("/", 2)[-2] if "/" in path.strip("/") else ""


# File names that say nothing of a data set.
GENERIC = ("edges", "graph", "graph_edges", "grid_edges")


def dataset_key(options: dict[str, str | None]) -> tuple[str, str]:
    """(key, the option it comes from) of a run. A key that is given stands. Else a
    generically named edge list is called by its folder, then come the names of bundles
    and of edge lists; what is still generic, or nothing, is DATASET."""
    get = lambda k: options.get(k) or ""
    if get("dataset_key"):
        return sanitized(get("dataset_key")), "dataset_key"
    lists = ("emit_edges", "edges")
    rules = [(k, parent(get(k)) or "dataset") for k in lists if stem(get(k)).lower() in GENERIC]
    rules += [(k, stem(get(k))) for k in ("graph_bin_out", "graph_bin_in", "edges", "emit_edges") if get(k)]
    for rule, name in rules:
        return ("DATASET", "fallback") if sanitized(name).lower() in GENERIC else (sanitized(name), rule)
    return "DATASET", "fallback"


def compact(x: float) -> str:
    return f"{x:.6f}"


def flag(x: bool) -> str:
    return "true" if x else "false"


def joined(ids: Iterable[int], separator: str = " ") -> str:
    return separator.join(map(str, ids))
