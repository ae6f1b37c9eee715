"""T-conorms that merge all contributions to one edge, as aggregates free of order.

Each takes a column of weights (or of distances, for the m-schemes) and gives an aggregate column. So Spark merges on the
map side, and the number of contributions to an edge never matters for memory. Nilpotent maximum needs the two largest
only, and the hyperbolic scheme must know the first: fuzzy.merge() ranks contributions for these two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Aggregate = Callable[[Column], Column]


def probabilistic_sum(w: Column) -> Column:
    return 1 - F.product(1 - w)


def bounded_sum(w: Column) -> Column:
    return F.least(F.sum(w), F.lit(1.0))


def drastic_sum(w: Column) -> Column:
    return F.when(F.count_if(w != 0) > 1, 1.0).otherwise(F.max(w))


def einstein_sum(w: Column) -> Column:
    return F.when(F.max(w) >= 1, 1.0).otherwise(F.tanh(F.sum(F.atanh(F.when(w < 1, w)))))


def nilpotent_maximum(w: Column) -> Column:
    """Of the two largest weights (others must be left out before): 1 if they add up to 1 or more, else the largest."""
    return F.when((F.count(w) > 1) & (F.sum(w) >= 1), 1.0).otherwise(F.max(w))


#: On weights phi(distance).
WEIGHTS: dict[str, Aggregate] = {
    "canonical": F.max,
    "probabilistic sum": probabilistic_sum,
    "bounded sum": bounded_sum,
    "drastic sum": drastic_sum,
    "Einstein sum": einstein_sum,
    "nilpotent maximum": nilpotent_maximum,
}


def m_scheme(m: float, largest: Column) -> Aggregate:
    """The least distance, or m times the graph's largest if that is less and there are several."""
    return lambda d: F.when(F.count(d) == 1, F.min(d)).otherwise(F.least(F.min(d), m * F.first(largest)))


def wiener_shannon(m: float) -> Aggregate:
    return lambda d: F.greatest(F.lit(0.0), -F.log(F.sum(F.exp(-m * d))) / m)


def composition(m: float) -> Aggregate:
    return lambda d: F.greatest(F.lit(0.0), -F.log(1 - F.product(1 - F.exp(-m * d))) / m)


def hyperbolic(later: Column) -> Aggregate:
    """The first contribution counts as 1; later ones add up as reciprocals, and a later 0 gives 0."""
    return lambda d: F.when(F.count_if(later & (d == 0)) > 0, 0.0).otherwise(1 / (1 + F.coalesce(F.sum(F.when(later & (d != 0), 1 / d)), F.lit(0.0))))


#: On distances.
SCHEMES = ("m_scheme", "m_scheme_Wiener_Shannon", "m_scheme_Composition", "m_scheme_Hyperbolic")


def register(name: str, aggregate: Aggregate) -> None:
    """Add a t-conorm of one's own, on weights."""
    WEIGHTS[name] = aggregate
