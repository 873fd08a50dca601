"""An ordered rule list learned by incremental reduced-error pruning, exported as a SQL CASE expression."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Condition:
    feature: int
    at_most: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        return v <= self.threshold if self.at_most else v > self.threshold


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, y: np.ndarray) -> list[Condition]:
    """Add the condition of the highest information gain until no negative row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while (n := int((~y[inside]).sum())) and len(rule) < 6:
        p = int(y[inside].sum())
        if not p:
            break
        best, found = 1e-9, None
        for f in range(x.shape[1]):
            v, order = x[inside, f], np.argsort(x[inside, f], kind="stable")
            v, t = v[order], y[inside][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            below = np.cumsum(t)[cut], np.cumsum(~t)[cut]
            for at_most, (pos, neg) in ((True, below), (False, (p - below[0], n - below[1]))):
                gain = pos * (np.log2(np.maximum(pos, 1e-9) / np.maximum(pos + neg, 1e-9)) - math.log2(p / (p + n)))
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, found = gain[i], Condition(f, at_most, float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if found is None:
            break
        rule.append(found)
        inside &= found.holds(x)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, y: np.ndarray) -> list[Condition]:
    """The beginning of the rule that is purest on the pruning rows; of equally pure ones the shortest."""

    def worth(r: list[Condition]) -> float:
        c = _covers(r, x)
        p, n = int(y[c].sum()), int((~y)[c].sum())
        return (p - n) / max(p + n, 1)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=[])


def induce(x: np.ndarray, y: np.ndarray, *, seed: int = 7, most: int = 12, tries: int = 4) -> list[list[Condition]]:
    """Rules for the rows where y holds, in order: each is grown on two thirds of the rows left, as many of each class, and pruned on the rest.

    A rule that is wrong on half of the pruning rows it covers is given up; learning ends when that came so many times in a row.
    """
    rng, rules, failed = np.random.default_rng(seed), [], 0
    x, y = x.astype(float), y.astype(bool)
    while y.any() and len(rules) < most and failed < tries:
        grow = np.zeros(len(y), bool)
        for c in (True, False):
            own = rng.permutation(np.flatnonzero(y == c))
            grow[own[: math.ceil(len(own) * 2 / 3)]] = True
        rule = _prune(_grow(x[grow], y[grow]), x[~grow], y[~grow])
        hit = _covers(rule, x[~grow])
        if not rule or not hit.any() or y[~grow][hit].mean() <= 0.5:
            failed += 1
            continue
        failed = 0
        rules.append(rule)
        left = ~_covers(rule, x)
        x, y = x[left], y[left]
    return rules


def to_case(rules: list[list[Condition]], features: list[str]) -> str:
    """The rules as one SQL CASE expression that is true for the rows they cover."""
    if not rules:
        return "FALSE"
    sql = lambda c: f"`{features[c.feature]}` {'<=' if c.at_most else '>'} CAST({c.threshold!r} AS DOUBLE)"
    return "CASE " + " ".join(f"WHEN {' AND '.join(map(sql, r))} THEN TRUE" for r in rules) + " ELSE FALSE END"
