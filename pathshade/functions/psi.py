"""Concave response functions as native column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Psi:
    """clip: min(t, p); log1p; expsat: 1 - exp(-p t); power: t ** p with p held to
    [0, 1]. All are 0 for t <= 0."""

    kind: str = "clip"
    p: float = 1.0

    def __call__(self, t: Column) -> Column:
        t = F.greatest(t, F.lit(0.0))
        if self.kind == "clip":
            return F.least(t, F.lit(float(self.p)))
        if self.kind == "log1p":
            return F.log1p(t)
        if self.kind == "expsat":
            return 1 - F.exp(-self.p * t)
        if self.kind == "power":
            return F.when(t > 0, F.pow(t, F.lit(min(1.0, max(0.0, self.p))))).otherwise(0.0)
        raise ValueError(f"unknown response: {self.kind}")

    def value(self, t: float) -> float:
        if t <= 0:
            return 0.0
        return {"clip": lambda: min(t, self.p), "log1p": lambda: math.log1p(t), "expsat": lambda: 1 - math.exp(-self.p * t), "power": lambda: t ** min(1.0, max(0.0, self.p))}[self.kind]()

    @property
    def bound(self) -> float:
        return {"clip": self.p, "expsat": 1.0}.get(self.kind, math.inf)

    @property
    def bounded(self) -> bool:
        return math.isfinite(self.bound)

    @property
    def monotone(self) -> bool:
        """All members of the family are, and none is negative."""
        return True

    def __str__(self) -> str:
        return self.kind if self.kind == "log1p" else f"{self.kind}:{self.p:g}"


def parse_psi(spec: str) -> Psi:
    """clip:C (C > 0), expsat:b (b > 0), log1p, power:a (0 < a <= 1), in any case."""
    kind, _, arg = spec.strip().lower().partition(":")
    if kind == "log1p" and not arg:
        return Psi("log1p", 0.0)
    if kind not in ("clip", "expsat", "power") or not arg:
        raise ValueError(f"not a response: {spec!r}")
    p = float(arg)
    if not p > 0 or not math.isfinite(p) or (kind == "power" and p > 1):
        raise ValueError(f"parameter out of range: {spec!r}")
    return Psi(kind, p)
