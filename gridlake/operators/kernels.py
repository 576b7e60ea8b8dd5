"""Statistics that columns cannot express: extreme-value fits, tests and sample sizes, one series a call."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def l_moments(x: np.ndarray) -> tuple[float, float, float]:
    """Mean, L-scale and L-skewness."""
    x, n = np.sort(x), len(x)
    i = np.arange(n)
    b0, b1 = x.mean(), (i * x).sum() / (n * (n - 1))
    b2 = (i * (i - 1) * x).sum() / (n * (n - 1) * (n - 2)) if n > 2 else 0.0
    l2 = 2 * b1 - b0
    return b0, l2, (6 * b2 - 6 * b1 + b0) / l2 if l2 else 0.0


def _gamma(z: float) -> float:
    return math.gamma(z)


def fit_gumbel(x: np.ndarray) -> tuple[float, float, float]:
    """(shape 0, location, scale) of the largest likelihood."""
    x = np.asarray(x, float)
    scale = max(x.std() * np.sqrt(6) / np.pi, 1e-12)
    for _ in range(200):
        w = np.exp(-(x - x.min()) / scale)
        new = x.mean() - (x * w).sum() / w.sum()
        if new <= 0:
            break
        if abs(new - scale) < 1e-12 * scale:
            scale = new
            break
        scale = (scale + new) / 2
    return 0.0, float(x.min() - scale * np.log(np.exp(-(x - x.min()) / scale).mean())), float(scale)


def fit_gev(x: np.ndarray) -> tuple[float, float, float]:
    """(xi, location, scale): from L-moments, improved by a simplex search on the likelihood."""
    x = np.asarray(x, float)
    l1, l2, t3 = l_moments(x)
    c = 2 / (3 + t3) - np.log(2) / np.log(3)
    k = 7.859 * c + 2.9554 * c * c  # Hosking's approximation (fixed values)
    if abs(k) < 1e-6 or l2 <= 0:
        return fit_gumbel(x)
    scale = l2 * k / ((1 - 2.0**-k) * _gamma(1 + k))
    start = np.array([-k, l1 - scale * (1 - _gamma(1 + k)) / k, scale])

    def cost(p: np.ndarray) -> float:
        xi, mu, s = p
        if s <= 0:
            return np.inf
        z = (x - mu) / s
        if abs(xi) < 1e-8:
            return len(x) * np.log(s) + (z + np.exp(-z)).sum()
        y = 1 + xi * z
        return np.inf if (y <= 0).any() else len(x) * np.log(s) + ((1 + 1 / xi) * np.log(y) + y ** (-1 / xi)).sum()

    return tuple(float(v) for v in simplex(cost, start, np.array([0.1, 0.1 * scale, 0.1 * scale])))


def simplex(cost, start: np.ndarray, step: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The downhill simplex search of Nelder and Mead."""
    points = np.vstack([start, start + np.diag(step)])
    values = np.array([cost(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if np.isfinite(values).all() and values[-1] - values[0] < 1e-10:
            break
        centre = points[:-1].mean(0)
        reflected = 2 * centre - points[-1]
        f = cost(reflected)
        if f < values[0]:
            further = 3 * centre - 2 * points[-1]
            g = cost(further)
            points[-1], values[-1] = (further, g) if g < f else (reflected, f)
        elif f < values[-2]:
            points[-1], values[-1] = reflected, f
        else:
            inner = (centre + points[-1]) / 2
            g = cost(inner)
            if g < values[-1]:
                points[-1], values[-1] = inner, g
            else:
                points[1:] = (points[1:] + points[0]) / 2
                values[1:] = [cost(p) for p in points[1:]]
    return points[np.argmin(values)]


def _negative(x: np.ndarray, log_density) -> float:
    with np.errstate(all="ignore"):
        v = -log_density(x).sum()
    return v if np.isfinite(v) else np.inf


def _searched(x: np.ndarray, log_density, start: list[float]) -> tuple[float, ...]:
    step = np.maximum(0.1 * np.abs(start), 0.05)
    return tuple(float(v) for v in simplex(lambda p: _negative(x, lambda y: log_density(y, *p)), np.array(start, float), step, 800))


def _pareto_log(x, xi, mu, s):
    z = (x - mu) / s
    if s <= 0 or (z < 0).any():
        return np.full(len(x), -np.inf)
    return -np.log(s) - z if abs(xi) < 1e-8 else -np.log(s) - (1 + 1 / xi) * np.log1p(xi * z)


def fit_pareto(x: np.ndarray) -> tuple[float, float, float]:
    """(xi, location, scale) of the generalised Pareto; the location is the smallest value, where the likelihood is largest."""
    x = np.asarray(x, float)
    low = float(x.min())
    m, v = x.mean() - low, x.var()
    xi = 0.5 * (1 - m * m / v) if v > 0 else 0.0
    xi, s = _searched(x, lambda y, a, b: _pareto_log(y, a, low, b), [xi, max(m * (1 - xi), 1e-9)])
    return xi, low, s


def _weibull_log(x, c, mu, s):
    z = (x - mu) / s
    if s <= 0 or c <= 0 or (z <= 0).any():
        return np.full(len(x), -np.inf)
    return np.log(c / s) + (c - 1) * np.log(z) - z**c


def fit_weibull(x: np.ndarray) -> tuple[float, float, float]:
    """(shape, location, scale) of the Weibull distribution of smallest values."""
    x = np.asarray(x, float)
    below = float(x.min() - 0.1 * x.std())
    return _searched(x, _weibull_log, [1.5, below, float(x.mean() - below)])


def _gamma_log(x, a, mu, s):
    z = (x - mu) / s
    if s <= 0 or not 0 < a < 1e6 or (z <= 0).any():
        return np.full(len(x), -np.inf)
    return (a - 1) * np.log(z) - z - math.lgamma(a) - np.log(s)


def _skew(x: np.ndarray) -> float:
    return float(((x - x.mean()) ** 3).mean() / x.std() ** 3)


def fit_gamma(x: np.ndarray) -> tuple[float, float, float]:
    """(shape, location, scale), begun at the moments."""
    x = np.asarray(x, float)
    skew = max(_skew(x), 0.2)
    a = 4 / skew**2
    s = x.std() / np.sqrt(a)
    return _searched(x, _gamma_log, [a, float(min(x.mean() - a * s, x.min() - 0.05 * x.std())), float(s)])


def fit_pearson3(x: np.ndarray) -> tuple[float, float, float]:
    """(skew, mean, standard deviation): a gamma distribution, turned round where the skew is negative."""
    x = np.asarray(x, float)
    sign = -1.0 if _skew(x) < 0 else 1.0
    a, mu, s = fit_gamma(sign * x)
    return sign * 2 / math.sqrt(a), sign * (mu + a * s), s * math.sqrt(a)


def gamma_p(a: float, x) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    x = np.atleast_1d(np.asarray(x, float))
    out = np.zeros(len(x))
    for i, v in enumerate(x):
        if v <= 0:
            continue
        scale = math.exp(a * math.log(v) - v - math.lgamma(a))
        if v < a + 1:
            term = total = 1 / a
            n = 0
            while abs(term) > 1e-15 * abs(total) and n < 10000:
                n += 1
                term *= v / (a + n)
                total += term
            out[i] = total * scale
        else:
            # modified Lentz
            b = v + 1 - a
            c, d = 1e300, 1 / b
            h = d
            for n in range(1, 10000):
                an = -n * (n - a)
                b += 2
                d = 1 / (an * d + b or 1e-300)
                c = b + an / c or 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            out[i] = 1 - scale * h
    return np.clip(out, 0, 1)


def _gev_cdf(x, xi, mu, s):
    z = (x - mu) / s
    if abs(xi) < 1e-8:
        return np.exp(-np.exp(-z))
    y = np.maximum(1 + xi * z, 0)
    with np.errstate(divide="ignore"):
        return np.where(y > 0, np.exp(-(y ** (-1 / xi))), 0.0 if xi > 0 else 1.0)


def _gev_quantile(p, xi, mu, s):
    y = -np.log(p)
    return mu - s * np.log(y) if abs(xi) < 1e-8 else mu + s * (y**-xi - 1) / xi


def _pareto_cdf(x, xi, mu, s):
    z = np.maximum((x - mu) / s, 0)
    return 1 - np.exp(-z) if abs(xi) < 1e-8 else 1 - np.maximum(1 + xi * z, 0) ** (-1 / xi)


def _pareto_quantile(p, xi, mu, s):
    return mu - s * np.log1p(-p) if abs(xi) < 1e-8 else mu + s * ((1 - p) ** -xi - 1) / xi


def _pearson_cdf(x, skew, mean, sd):
    a = 4 / skew**2
    z = a + np.sign(skew) * math.sqrt(a) * (np.asarray(x, float) - mean) / sd
    p = gamma_p(a, z).reshape(np.shape(x))
    return p if skew > 0 else 1 - p


def _inverted(cdf, low: float, high: float):
    """The place where a distribution function reaches p, by bisection of a bracket that is widened as needed."""

    def one(p: float) -> float:
        a, b = low, high
        while cdf(a) > p:
            a -= b - a
        while cdf(b) < p:
            b += b - a
        for _ in range(100):
            m = (a + b) / 2
            a, b = (m, b) if cdf(m) < p else (a, m)
        return (a + b) / 2

    return np.vectorize(one)


#: Distributions: (fit, cdf, quantile), each with the fit's three parameters.
FITS = {
    "gumbel": (fit_gumbel, _gev_cdf, _gev_quantile),
    "gev": (fit_gev, _gev_cdf, _gev_quantile),
    "genpareto": (fit_pareto, _pareto_cdf, _pareto_quantile),
    "weibull": (fit_weibull, lambda x, c, mu, s: 1 - np.exp(-(np.maximum((x - mu) / s, 0) ** c)), lambda p, c, mu, s: mu + s * (-np.log1p(-p)) ** (1 / c)),
    "gamma": (fit_gamma, lambda x, a, mu, s: gamma_p(a, (np.asarray(x, float) - mu) / s).reshape(np.shape(x)), lambda p, a, mu, s: _inverted(lambda y: gamma_p(a, (y - mu) / s)[0], mu, mu + s * (a + 10 * math.sqrt(a)))(p)),
    "pearson3": (fit_pearson3, _pearson_cdf, lambda p, g, m, sd: _inverted(lambda y: float(_pearson_cdf(y, g, m, sd)), m - 10 * sd, m + 10 * sd)(p)),
}


def quantile(p, fit: tuple[float, float, float], kind: str = "gev"):
    return FITS[kind][2](np.asarray(p, float), *fit)


def cdf(x, fit: tuple[float, float, float], kind: str = "gev"):
    return FITS[kind][1](np.asarray(x, float), *fit)


def return_value(period, fit, kind: str = "gev", block: int = 1, extreme: str = "max"):
    """The value of an event that comes once in `period` years, from blocks of some years; to five places."""
    event = block / np.asarray(period, float)
    return np.round(quantile(1 - event if extreme == "max" else event, fit, kind), 5)


def return_probability(value, fit, kind: str = "gev", block: int = 1, extreme: str = "max"):
    """The chance of an event beyond a value in a year. The block's root is taken before the tail, also for minima."""
    below = cdf(value, fit, kind) ** (1 / block)
    return 1 - below if extreme == "max" else below


def return_period(value, fit, kind: str = "gev", block: int = 1, extreme: str = "max"):
    """Years between events beyond a value, to three places; NaN where there is no chance of one."""
    p = np.asarray(return_probability(value, fit, kind, block, extreme), float)
    return np.where(p > 0, np.round(1 / np.where(p > 0, p, 1), 3), np.nan)


def ks(x: np.ndarray, probabilities: np.ndarray) -> tuple[float, float]:
    """One-sample Kolmogorov-Smirnov statistic, and its p by the asymptotic series."""
    p, n = np.sort(probabilities), len(x)
    d = max((np.arange(1, n + 1) / n - p).max(), (p - np.arange(n) / n).max())
    return float(d), kolmogorov((np.sqrt(n) + 0.12 + 0.11 / np.sqrt(n)) * d)


def kolmogorov(t: float) -> float:
    k = np.arange(1, 101)
    return float(np.clip(2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * t * t)).sum(), 0, 1)) if t > 0.2 else 1.0


def effective_size(x: np.ndarray, positive_only: bool = False) -> float:
    """n / (1 + 2 sum (1 - k/n) r_k), the autocorrelations by FFT.

    The sum runs over all lags; positive_only ends it at the first that is not
    positive, which is less noisy.
    """
    x = np.asarray(x, float) - np.mean(x) if len(x) else np.zeros(0)
    n = len(x)
    if n < 2 or not x.any():
        return float(n)
    f = np.fft.rfft(x, 2 * n)
    r = np.fft.irfft(f * np.conj(f))[:n]
    r = r[1:] / r[0]
    if positive_only and (r <= 0).any():
        r = r[: int(np.argmax(r <= 0))]
    return float(n / (1 + 2 * ((1 - np.arange(1, len(r) + 1) / n) * r).sum()))


def effective_size_sampled(x: np.ndarray, samples: int = 20, most: int = 100) -> float:
    """As effective_size for long series, from a sample of lags evenly spaced in their logarithm.

    The longest lag is a quarter of the series, at most `most`; a short lag that
    the spacing hits several times counts as often. Each correlation is that of
    the two overlapping parts.
    """
    x = np.asarray(x, float)
    n, longest = len(x), min(len(x) // 4, most)
    if longest < 1:
        return float(n)
    total = 0.0
    for k in np.geomspace(1, longest, samples).astype(int):
        a, b = x[: n - k] - x[: n - k].mean(), x[k:] - x[k:].mean()
        size = np.sqrt((a * a).sum() * (b * b).sum())
        if k < n - 1 and size > 0:
            total += (a * b).sum() / size * (n - k) / n
    return float(n / (1 + 2 * total))


def _fields(df: DataFrame, key: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema.fields)


def one_in_x(
    df: DataFrame, key: list[str], value: str, at: list[float], measure: str = "value", fit: str = "gev", runs: int = 100,
    alpha: float | None = 0.05, block: int = 1, extreme: str = "max", seed: int = 0,
) -> DataFrame:
    """For each series of block extremes: return values of periods, or probabilities or periods of values.

    df has a row for each block. Rows: key, at, result, conf_low, conf_high,
    p_value (of the fit's Kolmogorov-Smirnov test). Limits are quantiles alpha/2 and
    1 - alpha/2 over `runs` refits of samples drawn with replacement, seeded by the
    key; alpha None leaves them out. Fewer than three blocks, or equal ones, give
    NULLs. One series is one call, and a series has a row for each block only.
    """
    compute = {"value": return_value, "probability": return_probability, "period": return_period}[measure]
    estimate, levels = FITS[fit][0], np.asarray(at, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[key].iloc[0]
        x = np.sort(pdf[value].dropna().to_numpy(float))
        out = pd.DataFrame({**{k: [own[k]] * len(levels) for k in key}, "at": levels})
        if len(x) < 3 or x[0] == x[-1]:
            return out.assign(result=None, conf_low=None, conf_high=None, p_value=None)
        fitted = estimate(x)
        low = high = np.full(len(levels), np.nan)
        if alpha is not None:
            rng = np.random.Generator(np.random.PCG64([seed, zlib.crc32(repr(tuple(map(str, own))).encode())]))
            samples = [compute(levels, estimate(s), fit, block, extreme) for s in (rng.choice(x, len(x)) for _ in range(runs)) if s.min() < s.max()]
            if samples:
                low, high = np.nanquantile(samples, [alpha / 2, 1 - alpha / 2], axis=0)
        return out.assign(result=compute(levels, fitted, fit, block, extreme), conf_low=np.round(low, 5), conf_high=np.round(high, 5), p_value=ks(x, cdf(x, fitted, fit))[1])

    return df.select(*key, value).groupBy(*key).applyInPandas(run, f"{_fields(df, key)}, at double, result double, conf_low double, conf_high double, p_value double")


def return_values(df: DataFrame, key: list[str], value: str, periods: list[float], fit: str = "gev", runs: int = 100, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Values that blocks exceed once in each number of periods, with bootstrap limits and the fit's p-value (see one_in_x)."""
    return one_in_x(df, key, value, periods, "value", fit, runs, alpha, seed=seed).withColumnsRenamed({"at": "one_in_x", "result": "return_value"})


def two_sample_ks(df: DataFrame, key: list[str], value: str, sample: str, first, second) -> DataFrame:
    """(key, statistic, n_first, n_second, p_value) of the two samples of each key, as columns only.

    The statistic is the largest distance between the two shares of values so far,
    taken where values end, so ties count at once; p by the asymptotic series with
    100 terms. A key that lacks a sample has NULLs.
    """
    d = df.where(F.col(value).isNotNull() & F.col(sample).isin(first, second))
    at = d.groupBy(*key, value).agg(F.count_if(F.col(sample) == first).alias("a"), F.count_if(F.col(sample) == second).alias("b"))
    w = Window.partitionBy(*key)
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    n = {c: F.sum(c).over(w) for c in "ab"}
    shares = at.select(*key, n["a"].alias("n_first"), n["b"].alias("n_second"), F.abs(F.sum("a").over(upto) / F.nullif(n["a"], F.lit(0)) - F.sum("b").over(upto) / F.nullif(n["b"], F.lit(0))).alias("d"))
    found = shares.groupBy(*key, "n_first", "n_second").agg(F.max("d").alias("statistic"))
    size = F.sqrt(F.col("n_first") * F.col("n_second") / (F.col("n_first") + F.col("n_second")))
    t = size * F.col("statistic")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * t * t))
    p = F.when(t > 0.2, F.least(F.greatest(2 * terms, F.lit(0.0)), F.lit(1.0))).when(t.isNotNull(), 1.0)
    return found.select(*key, "statistic", "n_first", "n_second", p.alias("p_value"))


def sample_sizes(df: DataFrame, key: list[str], value: str, time: str = "time", sampled: bool = False) -> DataFrame:
    """Effective sample size of each series, from all lags or from a sample of them."""
    fields = _fields(df, key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values([time, value])[value].dropna().to_numpy(float)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in key}, "n": [len(x)], "ess": [(effective_size_sampled if sampled else effective_size)(x)]})

    return df.select(*key, time, value).groupBy(*key).applyInPandas(run, f"{fields}, n long, ess double")


def quantile_delta(df: DataFrame, key: list[str], observed: str, historical: str, target: str, levels: int = 20) -> DataFrame:
    """Additive quantile delta mapping: target plus what observed exceeds historical by at the target's quantile.

    One row holds one step of the three samples (NULL where a sample has none).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        o, h, t = (pdf[c].dropna().to_numpy(float) for c in (observed, historical, target))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(t) for k in key}, target: t, "adjusted": _adjusted(o, h, t, t, levels)})

    return df.groupBy(*key).applyInPandas(run, f"{_fields(df, key)}, `{target}` double, adjusted double")


def _adjusted(o: np.ndarray, h: np.ndarray, t: np.ndarray, own: np.ndarray, levels: int) -> np.ndarray:
    """own (values among t) plus observed less historical at their quantile within t; NaN where a sample is empty."""
    if not len(o) or not len(h) or not len(t):
        return np.full(len(own), np.nan)
    q, s = (np.arange(levels) + 0.5) / levels, np.sort(t)
    rank = (np.searchsorted(s, own, "left") + np.searchsorted(s, own, "right")) / 2 / len(t)
    return own + np.interp(rank, q, np.quantile(o, q) - np.quantile(h, q))


def quantile_delta_by_day(df: DataFrame, key: list[str], observed: str, historical: str, target: str, time: str = "time", window: int = 90, levels: int = 20) -> DataFrame:
    """As quantile_delta, each day of the year by the days of a window around it, over the turn of the year.

    Rows on 29 February are left out. One series is one call: some decades of
    steps at most; cells and stations share out the work.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        when = pdf[time].dt
        pdf = pdf[~((when.month == 2) & (when.day == 29))]
        doy = (pdf[time].dt.dayofyear - (pdf[time].dt.is_leap_year & (pdf[time].dt.month > 2))).to_numpy()
        # positions of each day of the year, the year laid out three times
        order = np.argsort(doy, kind="stable")
        begun = np.searchsorted(doy[order], np.arange(1, 367))
        columns = {c: pdf[c].to_numpy(float) for c in (observed, historical, target)}
        out = np.full(len(pdf), np.nan)
        some = lambda x: x[np.isfinite(x)]
        for d in range(1, 366):
            own = order[begun[d - 1] : begun[d]]
            own = own[np.isfinite(columns[target][own])]
            if len(own):
                days = (np.arange(d - window // 2, d - window // 2 + window) - 1) % 365
                near = np.concatenate([order[begun[x] : begun[x + 1]] for x in days])
                o, h, t = (some(columns[c][near]) for c in (observed, historical, target))
                out[own] = _adjusted(o, h, t, columns[target][own], levels)
        given = np.isfinite(columns[target])
        return pd.DataFrame({**{k: [pdf[k].iloc[0] if len(pdf) else None] * int(given.sum()) for k in key}, time: pdf[time].to_numpy()[given], target: columns[target][given], "adjusted": out[given]})

    kind = df.schema[time].dataType.simpleString()
    return df.select(*key, time, observed, historical, target).groupBy(*key).applyInPandas(run, f"{_fields(df, key)}, `{time}` {kind}, `{target}` double, adjusted double")
