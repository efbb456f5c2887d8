"""Distribution functions and small regressions in numpy (no statistics library is assumed)."""

from __future__ import annotations

import math

import numpy as np


def normal_sf2(z):
    """Two-sided normal tail."""
    return np.vectorize(lambda x: math.erfc(abs(x) / math.sqrt(2)), otypes=[float])(z)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_i(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) and df > 0 else float("nan")


def negbinom_quantile(q: float, mean: float, size: float) -> int:
    """Smallest k with a distribution function of at least q; a Poisson for an infinite size."""
    if mean <= 0:
        return 0
    k, total = 0, 0.0
    while True:
        if math.isinf(size):
            log_p = k * math.log(mean) - mean - math.lgamma(k + 1)
        else:
            log_p = math.lgamma(k + size) - math.lgamma(size) - math.lgamma(k + 1) + size * math.log(size / (size + mean)) + k * math.log(mean / (size + mean))
        total += math.exp(log_p)
        if total >= q or k > 10_000_000:
            return k
        k += 1


def theta_moments(y: np.ndarray, mu: np.ndarray, times: np.ndarray | None = None, squares: float | None = None) -> float:
    """Size of a negative binomial by matching the Pearson statistic; infinite without overdispersion."""
    n = np.ones(len(y)) if times is None else times
    over = ((y - mu) ** 2 - mu).sum() if times is None else squares + (n * (mu * mu - 2 * y * mu - mu)).sum()
    return float((n * mu**2).sum() / over) if over > 0 else float("inf")


def fit_glm(y: np.ndarray, x: np.ndarray, family: str, rounds: int = 50, times: np.ndarray | None = None, squares: float | None = None) -> tuple[np.ndarray, float]:
    """(fitted means, theta) of a log-link Poisson or negative binomial model by reweighted least squares.

    ``times``: y has means of so many observations each, ``squares`` is the sum of all squares.
    """
    theta = float("inf")
    n = np.ones(len(y)) if times is None else times
    mu = np.maximum((n * y).sum() / n.sum(), 1e-8) * np.ones(len(y))
    beta = np.zeros(x.shape[1])
    for outer in range(5 if family == "negbinom" else 1):
        for _ in range(rounds):
            w = n * mu / (1 + (mu / theta if math.isfinite(theta) else 0))
            z = np.log(mu) + (y - mu) / mu
            new = np.linalg.lstsq(x * np.sqrt(w)[:, None], z * np.sqrt(w), rcond=None)[0]
            mu = np.exp(np.clip(x @ new, -30, 30))
            if np.abs(new - beta).max() < 1e-9:
                break
            beta = new
        if family == "negbinom":
            theta = theta_moments(y, mu, times, squares)
    return mu, theta


def fit_glms(y: np.ndarray, x: np.ndarray, family: str, rounds: int = 50, times: np.ndarray | None = None, squares: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fitted means, thetas, coefficients) of ``fit_glm`` for the rows of y, which share the design x (ones come first): normal equations of all rows at once.

    Observations of one design row can be one column: ``times`` is their number, y has their sums and ``squares`` each row's
    sum of squares. A row whose equations are singular is fitted by least squares.
    """
    many, k = len(y), x.shape[1]
    times = np.ones(len(x)) if times is None else times
    squares = (y * y).sum(axis=1) if squares is None else squares
    middle = np.concatenate([[0.0], times @ x[:, 1:] / times.sum()])
    z = x - middle
    products, sides = (z[:, :, None] * z[:, None, :]).reshape(len(x), k * k) * times[:, None], z
    inverse, beta, ok = np.zeros(many), np.zeros((many, k)), np.ones(many, dtype=bool)
    eta = np.log(np.maximum(y.sum(axis=1) / times.sum(), 1e-8))[:, None] * np.ones(len(x))
    for _ in range(5 if family == "negbinom" else 1):
        left = np.flatnonzero(ok)
        for _ in range(rounds):
            if not len(left):
                break
            e = eta[left]
            m = np.exp(e)
            r = 1 / (1 + m * inverse[left, None])
            left_side = ((m * r) @ products).reshape(-1, k, k)
            right = (r * (times * m * (e - 1) + y[left])) @ sides
            scale = np.sqrt(np.maximum(np.einsum("bii->bi", left_side), 1e-300))
            left_side = left_side / scale[:, :, None] / scale[:, None, :]
            fine = np.linalg.det(left_side) > 1e-10
            if not fine.all():
                ok[left[~fine]] = False
                left, left_side, right, scale = left[fine], left_side[fine], right[fine], scale[fine]
                if not len(left):
                    break
            new = np.linalg.solve(left_side, (right / scale)[:, :, None])[:, :, 0] / scale
            eta[left] = np.clip(new @ z.T, -30, 30)
            new[:, 0] -= new[:, 1:] @ middle[1:]
            done = np.abs(new - beta[left]).max(axis=1) < 1e-9
            beta[left] = new
            left = left[~done]
        if family == "negbinom":
            mu = np.exp(eta)
            over = squares - 2 * (y * mu).sum(axis=1) + (mu * (mu - 1)) @ times
            inverse = np.where(over > 0, over, 0.0) / np.maximum((mu * mu) @ times, 1e-300)
    mu = np.exp(eta)
    with np.errstate(divide="ignore"):
        theta = 1 / inverse
    for i in np.flatnonzero(~ok):
        mu[i], theta[i] = fit_glm(y[i] / times, x, family, rounds, times, squares[i])
    # as the coefficients of means that are held within bounds
    far = np.flatnonzero(~ok | (mu.min(axis=1) <= 1e-12) | (mu.max(axis=1) >= 1e13))
    if len(far):
        root = np.sqrt(times)[:, None]
        beta[far] = np.linalg.lstsq(x * root, np.log(np.maximum(mu[far], 1e-12)).T * root, rcond=None)[0].T
    return mu, theta, beta


def glm_deviance_test(y: np.ndarray, x_null: np.ndarray, x_full: np.ndarray, family: str) -> float:
    """p of the likelihood-ratio test between two nested log-link models; theta from the full one."""

    def loglik(mu, theta):
        lg = np.vectorize(math.lgamma)
        if math.isinf(theta):
            return float((y * np.log(mu) - mu - lg(y + 1)).sum())
        return float((lg(y + theta) - math.lgamma(theta) - lg(y + 1) + theta * np.log(theta / (theta + mu)) + y * np.log(mu / (theta + mu))).sum())

    full, theta = fit_glm(y, x_full, family)
    null, _ = fit_glm(y, x_null, family)
    return chi2_sf(max(0.0, 2 * (loglik(full, theta) - loglik(null, theta))), x_full.shape[1] - x_null.shape[1])


def logistic_loglik(y: np.ndarray, x: np.ndarray, rounds: int = 60) -> float:
    """Maximised log-likelihood of a logistic model (Newton steps, a little ridge for separable data)."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - 1e-8 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-8 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    eta = np.clip(x @ beta, -30, 30)
    return float((y * eta - np.logaddexp(0, eta)).sum())


def logistic_logliks(x: np.ndarray, w1: np.ndarray, w2: np.ndarray, size: np.ndarray, rounds: int = 60) -> np.ndarray:
    """``logistic_loglik`` of an intercept and one column for many models at once: model by model ``size`` rows of x, each for w1 ones and w2 zeros."""
    beta, best = np.zeros((len(size), 2)), np.empty(len(size))
    left, start = np.arange(len(size)), np.cumsum(size) - size

    def rows(models):
        n = size[models]
        at = np.cumsum(n) - n
        return np.repeat(start[models] - at, n) + np.arange(n.sum()), np.repeat(np.arange(len(models)), n), at

    take, of, at = rows(left)
    for _ in range(rounds):
        z, a, b = x[take], w1[take], w2[take]
        p = 1 / (1 + np.exp(-np.clip(beta[left, 0][of] + beta[left, 1][of] * z, -30, 30)))
        gap, curve = a - (a + b) * p, (a + b) * p * (1 - p)
        add = lambda t, at=at: np.add.reduceat(t, at)
        g0, g1 = add(gap) - 1e-8 * beta[left, 0], add(gap * z) - 1e-8 * beta[left, 1]
        h00, h01, h11 = add(curve) + 1e-8, add(curve * z), add(curve * z * z) + 1e-8
        det = h00 * h11 - h01 * h01
        step = np.column_stack([h11 * g0 - h01 * g1, h00 * g1 - h01 * g0]) / det[:, None]
        beta[left] += np.clip(step, -5, 5)
        more = np.abs(step).max(axis=1) >= 1e-9
        if not more.any():
            break
        if not more.all():
            left = left[more]
            take, of, at = rows(left)
    of = np.repeat(np.arange(len(size)), size)
    eta = np.clip(beta[of, 0] + beta[of, 1] * x, -30, 30)
    best[:] = np.add.reduceat(w1 * eta - (w1 + w2) * np.logaddexp(0, eta), start)
    return best


def negbinom_loglik_fixed(y: np.ndarray, x: np.ndarray, theta: float, rounds: int = 50) -> float:
    """Log-likelihood, but for terms of y alone, of a log-linear negative binomial fit with a given theta."""
    beta = np.linalg.lstsq(x, np.log(y + 0.1), rcond=None)[0]
    for _ in range(rounds):
        mu = np.exp(np.clip(x @ beta, -30, 30))
        w = mu / (1 + mu / theta)
        step = np.linalg.lstsq(x * np.sqrt(w)[:, None], (x @ beta + (y - mu) / mu) * np.sqrt(w), rcond=None)[0] - beta
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    mu = np.exp(np.clip(x @ beta, -30, 30))
    return float((y * np.log(mu / (mu + theta)) + theta * np.log(theta / (mu + theta))).sum())


def nested_negbinom_test(y: np.ndarray, common: np.ndarray, group: np.ndarray, theta: float) -> float:
    """p of the group's effect beyond common factors, from the deviances of nested fits with one theta."""
    null = np.column_stack([np.ones(len(y)), common])
    full = np.column_stack([null, group])
    gain = 2 * (negbinom_loglik_fixed(y, full, theta) - negbinom_loglik_fixed(y, null, theta))
    return chi2_sf(max(0.0, gain), full.shape[1] - null.shape[1])
