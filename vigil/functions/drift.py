"""Distribution and severity expressions.

All of these build ``Column`` expressions only: they run inside whole-stage
codegen and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on (kept equal to the monitored system's settings).
EPSILON = 1e-6
WARNING_THRESHOLD = 0.10
CRITICAL_THRESHOLD = 0.25
RECENT_WINDOW_SIZE = 200
MIN_SAMPLES = 30
SEVERITY_ORDER = {"insufficient_data": 0, "normal": 1, "warning": 2, "critical": 3}
# Eleven quantile levels as a linear space on [0, 1] computes them (i * 0.1, last one exact).
DECILE_LEVELS = [i * 0.1 for i in range(10)] + [1.0]
# Ten equal probability bins on [0, 1], same construction.
PROBABILITY_EDGES = [i * 0.1 for i in range(10)] + [1.0]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def severity_from_score(score, warning: float = WARNING_THRESHOLD, critical: float = CRITICAL_THRESHOLD) -> Column:
    """Inclusive thresholds: ``>= critical`` → critical, ``>= warning`` → warning, else normal."""
    s = _c(score)
    return F.when(s >= F.lit(critical), "critical").when(s >= F.lit(warning), "warning").otherwise("normal")


def severity_rank(severity) -> Column:
    """Ordered severity enum; anything unranked (``unknown``, null) ranks 0."""
    m = F.create_map(*[x for k, v in SEVERITY_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[_c(severity)], F.lit(0))


def normalize(arr) -> Column:
    """Counts → shares; a side summing to <= 0 becomes uniform."""
    a = F.transform(_c(arr), lambda x: x.cast("double"))
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(total <= 0, F.transform(a, lambda x: F.lit(1.0) / F.size(a))).otherwise(
        F.transform(a, lambda x: x / total)
    )


def clip(x, eps: float = EPSILON) -> Column:
    return F.greatest(_c(x), F.lit(eps))


def psi(expected, actual) -> Column:
    """Population stability index of two aligned count arrays.

    Normalise each side, clip at 1e-6 after normalising (no renormalisation),
    natural log, sum. Every term is >= 0.
    """
    pairs = F.arrays_zip(normalize(expected).alias("e"), normalize(actual).alias("a"))
    terms = F.transform(
        pairs,
        lambda p: (clip(p["a"]) - clip(p["e"])) * F.log(clip(p["a"]) / clip(p["e"])),
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def bin_index(value, edges) -> Column:
    """Histogram bin of ``value`` against ascending ``edges``: ``[e_i, e_i+1)``, last bin closed.

    Values outside the edges, NaN and nulls give null (they are not counted).
    """
    v, e = _c(value), _c(edges)
    last = F.element_at(e, -1)
    return (
        F.when(v.isNull() | F.isnan(v) | (F.size(e) < 2), F.lit(None))
        .when((v < F.element_at(e, 1)) | (v > last), F.lit(None))
        .when(v == last, F.size(e) - 2)
        .otherwise(F.size(F.filter(e, lambda z: z <= v)) - 1)
        .cast("int")
    )


def linspace(lo, hi, num: int = 11) -> Column:
    """``num`` evenly spaced values from lo to hi; i * step + lo, last value exactly hi."""
    lo, hi = _c(lo), _c(hi)
    step = (hi - lo) / F.lit(num - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(num - 1)),
        lambda i: F.when(i == num - 1, hi).otherwise(i.cast("double") * step + lo),
    )


def learned_edges(quantiles, vmin, vmax) -> Column:
    """Unique decile edges; fewer than 3 → ``[v-0.5, v+0.5]`` for a constant, else 11 equal steps."""
    q = F.array_distinct(_c(quantiles))
    vmin, vmax = _c(vmin), _c(vmax)
    return (
        F.when(vmin.isNull(), F.array(F.lit(0.0), F.lit(1.0)))
        .when(F.size(q) >= 3, q)
        .when(vmin == vmax, F.array(vmin - 0.5, vmin + 0.5))
        .otherwise(linspace(vmin, vmax, 11))
    )


def chi_square_stat(expected, actual) -> Column:
    """Goodness-of-fit statistic of observed counts against the reference shares.

    observed + 1e-6 against normalise(expected) * max(sum(observed), 1) + 1e-6.
    """
    act = F.transform(_c(actual), lambda x: x.cast("double"))
    n_obs = F.aggregate(act, F.lit(0.0), lambda acc, x: acc + x)
    scale = F.greatest(n_obs, F.lit(1.0))
    pairs = F.arrays_zip(normalize(expected).alias("e"), act.alias("o"))
    terms = F.transform(
        pairs,
        lambda p: F.pow((p["o"] + EPSILON) - (p["e"] * scale + EPSILON), 2) / (p["e"] * scale + EPSILON),
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def chi_square_defined(expected, actual) -> Column:
    """The test needs observed and expected totals to agree; with no observations they do not."""
    act = F.transform(_c(actual), lambda x: x.cast("double"))
    n_obs = F.aggregate(act, F.lit(0.0), lambda acc, x: acc + x)
    return (n_obs > 0) & (F.size(_c(expected)) > 0)
