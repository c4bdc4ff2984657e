"""Counter-based random numbers in integer column arithmetic.

A draw depends only on its counter and the seed, so the same row gets the same
value under any partitioning, retry or engine. Counters may go up to 2^60.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus and multiplier of the congruential step.
MODULUS = 2147483647
MULTIPLIER = 48271
ROUNDS = 3
LOW_BITS = 30  # of a counter; the rest chooses the sequence


def mixed(s: int) -> int:
    """The mixing rounds on a plain number."""
    for _ in range(ROUNDS):
        s = (s * MULTIPLIER + 11) % MODULUS
        s ^= s >> 15
    return s


def seed_words(seed: int) -> tuple[int, int, int]:
    """Three words of a seed, each from its own rounds."""
    first = mixed(seed % MODULUS)
    second = mixed((first + 1) % MODULUS)
    return first % (MODULUS - 1) + 1, second, mixed((second + 1) % MODULUS)


def _step(s: Column) -> Column:
    return (s * F.lit(MULTIPLIER) + F.lit(11)) % F.lit(MODULUS)


def _mix(s: Column) -> Column:
    """The rounds as a fold over a constant array: each round's number is bound once, so the expression stays small."""

    def folded(x: Column) -> Column:
        x = _step(x)
        return x.bitwiseXOR(F.shiftright(x, 15))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), s.cast("bigint"), lambda acc, _: folded(acc))


def uniform(counter: Column, seed: int) -> Column:
    """Uniform in (0, 1) for a non-negative bigint counter.

    The high word of the counter and the seed choose a multiplier, the low word runs
    through the sequence it makes, so neither seeds nor far counters are shifted copies
    of each other.
    """
    a, b, c = seed_words(seed)
    n = counter.cast("bigint")
    high, low = F.shiftright(n, LOW_BITS), n.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("bigint"))
    stride = _mix((high * F.lit(a) + F.lit(b)) % F.lit(MODULUS)) % F.lit(MODULUS - 1) + F.lit(1)
    s = _mix((low * stride + F.lit(c)) % F.lit(MODULUS))
    return (_step(s) + F.lit(0.5)) / F.lit(float(MODULUS))


def normal(counter: Column, seed: int) -> Column:
    """Standard normal for a counter; uses uniforms 2*counter and 2*counter+1."""
    base = counter.cast("bigint") * 2
    u0, u1 = uniform(base, seed), uniform(base + 1, seed)
    return F.sqrt(F.lit(-2.0) * F.log(u0)) * F.cos(F.lit(2.0 * math.pi) * u1)


def path_normal(path: Column, horizon: Column, seed: int) -> Column:
    """Normal of one simulated path and horizon (1..3), independent across both."""
    return normal(path.cast("bigint") * 3 + (horizon - 1), seed)


def beta_5_2(counter: Column, seed: int) -> Column:
    """Beta(5, 2): the fifth smallest of six uniforms has this distribution."""
    base = counter.cast("bigint") * 6
    return F.element_at(F.sort_array(F.array(*[uniform(base + i, seed) for i in range(6)])), 5)


def pick(u: Column, choices: list[str], weights: list[float]) -> Column:
    """Weighted choice by cumulative weight; the last choice takes the rest."""
    out, total = None, 0.0
    for name, weight in list(zip(choices, weights))[:-1]:
        total += weight
        test = u < F.lit(round(total, 12))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(choices[-1])) if out is not None else F.lit(choices[-1])
