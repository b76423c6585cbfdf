"""Lower bound by iterated softmax mixtures."""

from __future__ import annotations

from dataclasses import dataclass

from pathshade.operators.greedy import greedy
from pathshade.operators.objectives import Linear, Original, mixture_coef, mixture_const, softmax_mixture
from pathshade.session import written


@dataclass(frozen=True)
class Solved:
    picked: list[int]
    value: float
    rounds: int


def linearised(original: Original, picked: list[int], eta: float) -> Linear:
    mix = written(softmax_mixture(original.scores(picked), eta), "mixture")
    coef = written(mixture_coef(original.path_nodes, mix), "coef")
    return Linear(original.weights, coef, original.psi, original.lam, mixture_const(original.paths, mix).first()[0])


def iterate(original: Original, start: list[int], k: int, eta: float = 1.0, rounds: int = 1, tol: float = 1e-6, keep_best: bool = True, exact_rounds: bool = False) -> Solved:
    """Linearise at the current set, select greedily, evaluate, and go on from there.

    With keep_best the first round always replaces the start, later ones only if
    they improve; without it the last round stands. Stops when two rounds in a row (the
    start counts as one) differ by less than ``tol``, unless all rounds are asked for."""
    evaluate = lambda s: float(original.value(s).first()[0])
    current, f_current = list(start), evaluate(start)
    best, f_best, done = current, f_current, 0
    for _ in range(max(1, rounds)):
        following = [u for u, _ in greedy(linearised(original, current, eta), k)]
        f_following = evaluate(following)
        if not keep_best or not done or f_following > f_best:
            best, f_best = following, f_following
        settled = abs(f_following - f_current) < tol
        current, f_current, done = following, f_following, done + 1
        if settled and tol > 0 and not exact_rounds:
            break
    return Solved(best, f_best, done)
