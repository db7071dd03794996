"""Column expressions. They stay inside the JVM and take part in code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import lgamma

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """NaN to null, so that aggregates skip both alike."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def number(c: str | Column) -> Column:
    """Text to double; text that is no number becomes null."""
    return col(c).try_cast("double")


def mirrored(x: str | Column, side: str | Column, same: str = "Right") -> Column:
    """Coordinate measured towards the cue; null when the side is unknown."""
    x, side = col(x), col(side)
    return F.when(side == same, x).when(side != same, 1 - x)


def two_way(x: str | Column, cut: float, below: str, above: str) -> Column:
    """Label by a cut point; null in, null out."""
    x = col(x)
    return F.when(x < cut, F.lit(below)).when(x >= cut, F.lit(above))


def second_bucket(secs: str | Column, width: float = 1.0) -> Column:
    """1-based bucket number of ``width`` seconds."""
    return (F.floor(col(secs) / F.lit(float(width))) + 1).cast("bigint")


def key(*cols: str, sep: str = "_") -> Column:
    """Composite label. A null part keeps its place as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cols])


def recode(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Replace labels; labels without an entry pass through."""
    c = col(c)
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def level_index(c: str | Column, levels: Sequence[str]) -> Column:
    """0-based position among the declared levels; null for any other value."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), col(c))
    return F.when(pos > 0, (pos - 1).cast("int"))


def percent_of(c: str | Column, whole: float | Column) -> Column:
    whole = whole if isinstance(whole, Column) else F.lit(float(whole))
    return F.try_divide(100 * col(c), whole)


def shape_to_prec(a: Column, b: Column) -> tuple[Column, Column]:
    """Beta shapes to (mean, precision)."""
    return F.try_divide(a, a + b), a + b


def prec_to_shape(mu: Column, phi: Column) -> tuple[Column, Column]:
    """Beta (mean, precision) to shapes."""
    return mu * phi, (1 - mu) * phi


def beta_log_density(x: str | Column, a: float, b: float, eps: float = 1e-9) -> Column:
    """Log density of Beta(a, b); x is kept ``eps`` away from 0 and 1."""
    x = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), col(x)))
    norm = lgamma(a) + lgamma(b) - lgamma(a + b)
    log_density = (a - 1) * F.ln(x) + (b - 1) * F.ln(1 - x) - F.lit(norm)
    return F.when(x.isNotNull(), log_density)


def mean_sd_text(label: str, mean: Column, sd: Column) -> Column:
    return F.format_string(f"{label} : %.1f %% ± %.1f %%", mean, sd)


def stationary3(p: Mapping[tuple[int, int], Column]) -> list[Column]:
    """Stationary law of a 3-state chain from its off-diagonal probabilities.

    Weights come from the Markov-chain tree theorem; a chain without a unique law gives null.
    """
    w1 = p[2, 1] * p[3, 1] + p[2, 3] * p[3, 1] + p[3, 2] * p[2, 1]
    w2 = p[1, 2] * p[3, 2] + p[1, 3] * p[3, 2] + p[3, 1] * p[1, 2]
    w3 = p[1, 3] * p[2, 3] + p[1, 2] * p[2, 3] + p[2, 1] * p[1, 3]
    total = w1 + w2 + w3
    return [F.try_divide(w, total) for w in (w1, w2, w3)]
