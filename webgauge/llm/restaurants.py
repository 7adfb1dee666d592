"""Seating in Pitman-Yor restaurants, for many dishes at once.

Of a dish's customers only two numbers matter: how many there are, c, and at how many tables they sit, t; how the customers
share the tables is summed over. There are S(c, t) ways to do so, the generalised Stirling numbers
S(c, t) = S(c - 1, t - 1) + (c - 1 - d t) S(c - 1, t) of the discount d, so that the table count of a dish given all else has

    P(t) ~ S(c, t) * prod over j < t of (strength + d (rest + j)) * (parent's probability once it has j more customers)

with ``rest`` the restaurant's other tables. A Gibbs step takes all customers of a dish out, with their tables' customers at
the parent, and seats them again by a draw from this distribution, whatever c is.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from webgauge.llm.textarrays import U64, mix, mix_int

DISCOUNT, STRENGTH = 0.8, 1.0
#: The parent is a restaurant of discount 0 (its probabilities need no seating) with this strength for each word.
ROOT = 0.5
#: Stirling numbers come from the recursion up to so many customers, and from their saddle point beyond.
EXACT = 256


@lru_cache
def _ratios(discount: float) -> np.ndarray:
    """S(c, t + 1) / S(c, t) at [c, t] for 1 <= t < c <= EXACT, else 0."""
    log = np.full((EXACT + 1, EXACT + 2), -np.inf)
    log[1, 1] = 0.0
    t = np.arange(EXACT + 2)
    for c in range(2, EXACT + 1):
        stay = np.log(np.maximum(c - 1 - discount * t[1:c], 1e-300)) + log[c - 1, 1:c]
        log[c, 1:c] = np.logaddexp(log[c - 1, : c - 1], stay)
        log[c, c] = 0.0
    out = np.zeros((EXACT + 1, EXACT + 1))
    for c in range(2, EXACT + 1):
        out[c, 1:c] = np.exp(log[c, 2 : c + 1] - log[c, 1:c])
    return out


@lru_cache
def _peaks(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log(c / t - 1) and log(1 - y^d) where the coefficients of (1 - (1 - x)^d)^t peak: t d (1 - y) y^(d - 1) = c (1 - y^d)."""
    log_y = -np.geomspace(1e-7, 80 / (1 - d), 20_000)
    share = -np.expm1(d * log_y)
    return np.log(-d * np.expm1(log_y) * np.exp((d - 1) * log_y) / share - 1), np.log(share)


def more_tables(c: np.ndarray, t: np.ndarray, d: float = DISCOUNT) -> np.ndarray:
    """S(c, t + 1) / S(c, t) for t < c."""
    out = np.zeros(len(c))
    few = c <= EXACT
    out[few] = _ratios(d)[c[few], t[few]]
    if not few.all():
        big, k = c[~few].astype(np.float64), t[~few].astype(np.float64)
        share = np.exp(np.interp(np.log(big / (k + 0.5) - 1), *_peaks(d)))
        out[~few] = share / (d * k) * (big - k) / (big - k - 0.5)
    return out


def draws(seeds: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Uniform numbers that depend on nothing but the dish and the sweep, of which the seeds are made, and the step: a task run again draws the same."""
    h = mix(seeds + step.astype(U64) * U64(0x9E3779B97F4A7C15))
    return (h >> U64(11)).astype(np.float64) / 2.0**53


def seat(c: np.ndarray, rest: np.ndarray, at_parent: np.ndarray, all_parent: np.ndarray, words: int, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish, drawn given all else.

    c: its customers; rest: the restaurant's tables of other dishes; at_parent, all_parent: the parent's customers of this word
    and in all, without those of this dish here. Table counts are walked upwards; each takes the place of the one
    chosen so far with its share of the mass up to it. A walk starts where the mass below is out of reach.
    """

    def ratio(i: np.ndarray, t: np.ndarray) -> np.ndarray:
        grown = (at_parent[i] + t + ROOT) / (all_parent[i] + t + ROOT * (words + 1))
        return more_tables(c[i], t) * (STRENGTH + DISCOUNT * (rest[i] + t)) * grown

    t = np.minimum(c, 1)
    at = np.flatnonzero(c > 1)
    far = at[c[at] > 64]
    far = far[ratio(far, np.full(len(far), 64)) > 1] if len(far) else far
    if len(far):  # the most likely count is where the ratio falls below 1
        low, high = np.full(len(far), 64), c[far] - 1
        for _ in range(int(c[far].max()).bit_length() + 1):
            middle = np.maximum((low + high) // 2, 1)
            up = ratio(far, middle) > 1
            low, high = np.where(up, middle, low), np.where(up, high, middle)
        t[far] = np.maximum(1, low - 12 * np.sqrt(low) - 12).astype(np.int64)
    walked, share, seeds = t.copy(), np.ones(len(c)), mix(keys + U64(mix_int(sweep + 1)))
    while len(at):
        r = ratio(at, walked[at])
        grown = share[at] * r
        share[at] = grown / (1 + grown)
        walked[at] += 1
        taken = draws(seeds[at], walked[at]) < share[at]
        t[at[taken]] = walked[at[taken]]
        at = at[(walked[at] < c[at]) & ((r >= 1) | (share[at] > 1e-10))]
    return t
