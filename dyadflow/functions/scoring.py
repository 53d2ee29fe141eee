"""Probability, loss and interval expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from dyadflow.functions import vocab
from dyadflow.functions.text import col


def elo_expectation(rating_a, rating_b) -> Column:
    gap = (col(rating_b) - col(rating_a)) / F.lit(vocab.ELO_SCALE)
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), gap))


def logistic_gap(theta_a, theta_b) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(col(theta_a) - col(theta_b))))


def glicko_g(phi) -> Column:
    return F.lit(1.0) / F.sqrt(F.lit(1.0) + F.lit(3.0 / math.pi**2) * col(phi) * col(phi))


def glicko_expectation(mu, opponent_mu, opponent_phi) -> Column:
    return F.lit(1.0) / (
        F.lit(1.0) + F.exp(-glicko_g(opponent_phi) * (col(mu) - col(opponent_mu)))
    )


def glicko_win_probability(mu_a, phi_a, mu_b, phi_b) -> Column:
    """Both deviations enter: neither side's strength is known exactly."""
    return glicko_expectation(
        mu_a, mu_b, F.sqrt(col(phi_a) * col(phi_a) + col(phi_b) * col(phi_b))
    )


def to_glicko_scale(rating, deviation) -> tuple[Column, Column]:
    return (
        (col(rating) - vocab.ELO_DEFAULT) / vocab.GLICKO_SCALE,
        col(deviation) / vocab.GLICKO_SCALE,
    )


def from_glicko_scale(mu, phi) -> tuple[Column, Column]:
    return F.lit(vocab.ELO_DEFAULT) + col(mu) * vocab.GLICKO_SCALE, col(phi) * vocab.GLICKO_SCALE


def log_loss(p_a, a_won) -> Column:
    """Loss of one prediction, clipped away from 0 and 1 so that certainty stays finite."""
    p = F.when(col(a_won), col(p_a)).otherwise(F.lit(1.0) - col(p_a))
    clipped = F.least(
        F.greatest(p, F.lit(vocab.LOG_LOSS_EPSILON)), F.lit(1.0 - vocab.LOG_LOSS_EPSILON)
    )
    return -F.log(clipped)


def squared_error(p_a, a_won) -> Column:
    return F.pow(col(p_a) - F.when(col(a_won), 1.0).otherwise(0.0), F.lit(2.0))


def is_correct(p_a, a_won) -> Column:
    """A tie at 0.5 is a pick for side a."""
    return (col(p_a) >= 0.5) == col(a_won)


def wilson(successes, n, z: float = vocab.WILSON_Z) -> tuple[Column, Column]:
    k, total = col(successes).cast("double"), col(n).cast("double")
    rate = k / total
    scale = 1.0 + F.lit(z * z) / total
    centre = (rate + F.lit(z * z) / (2.0 * total)) / scale
    half = (
        F.lit(z)
        * F.sqrt(rate * (1.0 - rate) / total + F.lit(z * z) / (4.0 * total * total))
        / scale
    )
    empty = total == 0
    return (
        F.when(empty, F.lit(0.0)).otherwise(centre - half),
        F.when(empty, F.lit(0.0)).otherwise(centre + half),
    )


def log_gamma(x) -> Column:
    """Stirling's series after shifting the argument up by eight."""
    x = col(x).cast("double")
    y = x + 8.0
    series = (
        1.0 / (12.0 * y)
        - 1.0 / (360.0 * F.pow(y, F.lit(3.0)))
        + 1.0 / (1260.0 * F.pow(y, F.lit(5.0)))
        - 1.0 / (1680.0 * F.pow(y, F.lit(7.0)))
    )
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + float(i))
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - shift


def mcnemar_exact(a_only, b_only) -> Column:
    """Two-sided exact binomial test on the discordant pairs.

    Tail terms fall off at least geometrically below the mode, so the sum starts at the largest
    one and stops where the remaining terms are below double precision.
    """
    b, c = col(a_only).cast("long"), col(b_only).cast("long")
    n = b + c
    k = F.least(b, c)
    reach = (F.sqrt(n.cast("double")) * 40.0 + 100.0).cast("long")
    first = F.greatest(F.lit(0).cast("long"), k - reach)
    total = n.cast("double")
    term = lambda i: F.exp(
        log_gamma(total + 1.0)
        - log_gamma(i.cast("double") + 1.0)
        - log_gamma(total - i.cast("double") + 1.0)
        - total * math.log(2.0)
    )
    tail = F.aggregate(F.sequence(first, k), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * tail))
