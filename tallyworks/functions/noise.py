"""Whole-number Laplace noise from exact coin flips. Floating-point draws leave traces in the low bits; these have none.

The sampler draws uniform integers only: a coin of probability exp(-x) is made of coins of probability x/k, and a
geometric number of full scales plus a remainder gives a magnitude, to which a sign is added (zero counted once).
"""

from __future__ import annotations

import random
from fractions import Fraction


def _coin(p: Fraction, rng: random.Random) -> bool:
    return rng.randrange(p.denominator) < p.numerator


def coin_exp(x: Fraction, rng: random.Random) -> bool:
    """True with probability exp(-x), for x from 0 to 1: the number of first successes among coins x/1, x/2, ... is even."""
    k = 1
    while _coin(x / k, rng):
        k += 1
    return k % 2 == 1


def discrete_laplace(scale: Fraction, rng: random.Random | None = None) -> int:
    """A whole number n with probability in proportion to exp(-|n| / scale); 0 for a scale of 0. Without ``rng`` the
    operating system's randomness is used."""
    if scale < 0:
        raise ValueError("a scale cannot be negative")
    if scale == 0:
        return 0
    rng = rng or random.SystemRandom()
    one = Fraction(1)
    while True:
        part = rng.randrange(scale.numerator)
        if not coin_exp(Fraction(part, scale.numerator), rng):
            continue
        whole = 0
        while coin_exp(one, rng):
            whole += 1
        n = (part + scale.numerator * whole) // scale.denominator
        negative = rng.randrange(2) == 1
        if not (negative and n == 0):
            return -n if negative else n
