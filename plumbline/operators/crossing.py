"""Probabilities that an empirical step function leaves a band, as column expressions.

``outside_band`` places m ordered points on an axis where point i must lie in lows[i]..highs[i]. The bounds cut the axis into
at most 2 m + 2 segments; inside one, each point is either allowed or not, so the state is only the number of points placed
so far, and a segment of a given length takes k points in a known number of ways. All terms are positive, so small
probabilities keep their digits, and the cost depends on m alone: a side of ten billion rows costs what a hundred do.

* Two samples: the places are the gaps of the larger sample (exact law without ties).
* Distance to the uniform: the axis is 0..1 (exact below ``SMALL_N`` points; beyond, the law of two barriers with the
  finite-sample shift, closer than 0.0005 to the exact one).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL_N = 30  # fixed value: below this the exact distribution is used
#: Terms of the two-barrier series on either side, and the sum of the barriers below which it is 0 to 12 digits.
TERMS, NARROW = 12, 0.4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ways(points: Column, length: Column, step: Column) -> Column:
    """Array over k = 0..points: weight of k points in a length; ``step`` is the width of one place (0: a line)."""
    return F.aggregate(
        F.sequence(F.lit(1), points), F.array(F.lit(1.0)),
        lambda ways, k: F.concat(ways, F.array(F.get(ways, k - 1) * (length + (k - 1) * step) / k)),
    )


def outside_band(points: Column, lows: Column, highs: Column, end: Column, unit: Column, step: Column) -> Column:
    """Chance that ``points`` ordered uniform points break a bound; ``highs`` are exclusive.

    Lengths count in multiples of ``unit``; the axis is 0..``end``.
    """
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), end), lows, highs)))
    zero = F.struct(F.array_repeat(F.lit(0.0), points).alias("rest"), F.lit(0.0).alias("out"))
    start = F.struct(F.concat(F.array(F.lit(1.0)), zero["rest"]).alias("q"), F.lit(0.0).alias("out"))

    def with_cuts(bounds):
        spans = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda s: F.struct(F.get(bounds, s - 1).alias("a"), F.get(bounds, s).alias("b")))

        def add(acc, span):
            upto = F.size(F.filter(lows, lambda x: x <= span["a"]))
            least = F.size(F.filter(highs, lambda x: x <= span["b"]))

            def placed(ways):
                return F.transform(
                    F.sequence(F.lit(0), points),
                    lambda i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0.0), lambda t, k: t + F.get(acc["q"], i - k) * F.get(ways, k)),
                )

            def split(both):
                inside = lambda i: (i >= both["least"]) & (i <= both["upto"])
                q = F.transform(both["now"], lambda v, i: F.when(inside(i), v).otherwise(0.0))
                lost = F.aggregate(
                    F.sequence(F.lit(0), points), F.lit(0.0),
                    lambda t, i: t + F.when(inside(i), 0.0).otherwise(F.get(both["now"], i) * F.get(both["later"], points - i)),
                )
                return F.struct(q.alias("q"), (acc["out"] + lost).alias("out"))

            state = F.struct(
                let(_ways(points, (span["b"] - span["a"]) / unit, step), placed).alias("now"),
                _ways(points, (end - span["b"]) / unit, step).alias("later"), upto.alias("upto"), least.alias("least"),
            )
            return let(state, split)

        return F.aggregate(spans, start, add, lambda acc: acc["out"])

    whole = F.get(_ways(points, end / unit, step), points)
    return F.least(F.lit(1.0), let(cuts, with_cuts) / whole)


def exact_ks_p(n1: Column, n2: Column, d: Column) -> Column:
    """P(D >= d) of two samples without ties; the cost grows with the smaller side only."""

    def of(x):
        m, n, h = x["m"], x["n"], x["h"]  # distances are multiples of 1 / (m n)
        index = F.sequence(F.lit(1), m)
        lows = F.transform(index, lambda i: F.greatest(F.lit(0.0), F.floor((i * n - h) / m) + 1).cast("double"))
        highs = F.transform(index, lambda i: (F.least(n, F.floor(((i - 1) * n + h - 1) / m).cast("double")) + 1).cast("double"))
        inner = lambda b: outside_band(b["m"], b["lows"], b["highs"], b["n"] + 1.0, b["n"], 1.0 / b["n"])
        return F.when(h <= 0, 1.0).otherwise(let(F.struct(m.alias("m"), n.alias("n"), lows.alias("lows"), highs.alias("highs")), inner))

    m, n = F.least(n1, n2).cast("int"), F.greatest(n1, n2).cast("double")
    return let(F.struct(m.alias("m"), n.alias("n"), F.round(d * m * n).alias("h")), of)


def _exact_uniform(d: Column, n: Column) -> Column:
    def of(x):
        index = F.sequence(F.lit(1), x["n"])
        lows = F.transform(index, lambda i: F.greatest(F.lit(0.0), i / x["n"] - x["d"]))
        highs = F.transform(index, lambda i: F.least(F.lit(1.0), i / x["n"] + x["d"]))
        inner = lambda b: outside_band(b["n"], b["lows"], b["highs"], F.lit(1.0), F.lit(1.0), F.lit(0.0))
        return let(F.struct(x["n"].alias("n"), lows.alias("lows"), highs.alias("highs")), inner)

    return let(F.struct(n.cast("int").alias("n"), d.alias("d")), of)


def two_barriers_p(d: Column, n: Column) -> Column:
    """1 - P(-b < bridge < a) for the distances d and d + 1 / n of the steps, both shifted for finite n."""
    root = F.sqrt(n)
    a = root * d
    width = a + 0.5 / root
    shift = 1.0 / (6.0 * root) + (width - 1.0) / (4.0 * n)

    def of(x):
        a, s = x["a"], x["s"]
        term = lambda k: F.exp(-2.0 * k * k * s * s) - F.exp(-2.0 * (a + k * s) * (a + k * s))
        inside = F.aggregate(F.sequence(F.lit(-TERMS), F.lit(TERMS)), F.lit(0.0), lambda t, k: t + term(k))
        return F.when(s < NARROW, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - inside)))

    return let(F.struct((a + shift).alias("a"), (2.0 * (width + shift)).alias("s")), of)


def uniform_distance_p(d: Column, n: Column) -> Column:
    """Chance that the largest |i / n - U_(i)| of n uniform draws is at least ``d``."""
    return F.when(n < SMALL_N, F.greatest(F.lit(0.0), _exact_uniform(d, n))).otherwise(two_barriers_p(d, n))
