"""Statistical column expressions."""

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import _col, strip


def p_true_from_logprobs(top="top_k") -> Column:
    """Probability of *true* from a top-k list ``array<struct<token, logprob>>``.

    Mass is summed over every spelling of each answer; with neither present the
    score is 0.5 and counted as a miss.
    """
    def mass(word):
        return F.aggregate(
            F.filter(_col(top), lambda x: F.lower(strip(x["token"])) == word),
            F.lit(0.0), lambda acc, x: acc + F.exp(F.coalesce(x["logprob"], F.lit(-100.0))))

    t, f = mass("true"), mass("false")
    answered = t + f
    return F.struct(
        F.when(answered > 0, t / answered).otherwise(F.lit(0.5)).alias("p"),
        F.when(answered > 0, t / answered).alias("p_true"),
        answered.alias("mass_on_answer"),
        (~(answered > 0)).alias("miss"),
        F.coalesce(F.try_element_at(_col(top), F.lit(1))["token"], F.lit("")).alias("top_token"),
    )


def sigmoid_score(mean_logprob) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(_col(mean_logprob) + F.lit(2.0))))


def z_score(p, mean, sd) -> Column:
    return (_col(p) - _col(mean)) / F.greatest(_col(sd), F.lit(V.MIN_SD))


def hypergeometric_hit(n, m, k) -> Column:
    """P(at least one of k draws without replacement is among m of n)."""
    n, m, k = _col(n), _col(m), _col(k)
    draws = F.least(k, n)
    miss = F.aggregate(
        F.sequence(F.lit(0), (draws - 1).cast("int")), F.lit(1.0),
        lambda acc, i: acc * F.greatest(n - m - i, F.lit(0)) / (n - i))
    return F.when(m == 0, F.lit(0.0)).otherwise(F.lit(1.0) - miss)


def coefficient_of_variation(c) -> Column:
    """Aggregate: population sd over mean absolute value, for signed quantities
    near zero. Below the floor: 0, or infinite when the values still spread."""
    c = _col(c)
    scale, sd = F.avg(F.abs(c)), F.stddev_pop(c)
    return (
        F.when(F.count(c) < 2, F.lit(0.0))
        .when(scale < V.MIN_SD, F.when(sd < V.MIN_SD, F.lit(0.0)).otherwise(F.lit(float("inf"))))
        .otherwise(sd / scale)
    )
