"""Column expressions for guarded statistics, error metrics and moment regressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return _c(a) / F.nullif(_c(b), F.lit(0.0))


def std_guarded(x) -> Column:
    return F.when(F.count(_c(x)) >= 2, F.stddev_samp(_c(x)))


def skew_g1(x) -> Column:
    """Bias-corrected skewness; Spark's own is the population moment."""
    n = F.count(_c(x)).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(_c(x)) > 0), F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(_c(x)))


def kurt_g2(x) -> Column:
    n = F.count(_c(x)).cast("double")
    return F.when((n >= 4) & (F.stddev_pop(_c(x)) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(_c(x)) + 6))


def cov_guarded(x, y) -> Column:
    both = _c(x).isNotNull() & _c(y).isNotNull()
    return F.when(F.count_if(both) >= 2, F.covar_samp(_c(x), _c(y)))


def corr(x, y) -> Column:
    """Correlation of the rows that have both values, NULL where either doesn't vary. Spark's own raises an error there, as an
    aggregate is worked out before any guard around it."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    return F.covar_pop(_c(x), _c(y)) / F.nullif(F.stddev_pop(F.when(both, _c(x))) * F.stddev_pop(F.when(both, _c(y))), F.lit(0.0))


def corr_guarded(x, y) -> Column:
    both = _c(x).isNotNull() & _c(y).isNotNull()
    return F.when(F.count_if(both) >= 3, corr(x, y))


def error_metrics(y, p) -> dict[str, Column]:
    """Aggregates of truth and prediction; a metric whose normaliser is not positive is NULL."""
    y, p = _c(y), _c(p)
    e = p - y
    return {
        "nmae": F.when(F.max(y) > 0, F.avg(F.abs(e)) / F.max(y) * 100),
        "y_max": F.max(y),
        "wape": F.when(F.sum(y) > 0, F.sum(F.abs(e)) / F.sum(y) * 100),
        "mape": F.avg(F.when(y != 0, F.abs(e) / F.abs(y))) * 100,
        "r2": F.when((F.count(y) > 1) & (F.var_pop(y) > 0), 1 - F.avg(e * e) / F.var_pop(y)),
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
    }


def r8(c, digits: int = 8) -> Column:
    return F.round(_c(c).cast("double"), digits)
