"""Linear fits from sums of products: one aggregate over any number of rows, a small solve on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Penalties to choose from, the share of the latest rows that chooses, gates and scale of points.
LAMBDAS = (0.1, 1.0, 10.0, 100.0)
VALIDATION = 0.2
T_LEAST = 1.0
FIRED_LEAST = 30
POINTS = 5
POINT_CAP = 6


@dataclass
class Moments:
    """Sums over rows of the products of (1, x...) with itself and with y."""

    n: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def ridge(self, penalty: float) -> np.ndarray:
        """Coefficients, the intercept first and without penalty."""
        weights = np.full(len(self.xx), float(penalty))
        weights[0] = 0.0
        return np.linalg.solve(self.xx + np.diag(weights), self.xy)

    def loss(self, beta: np.ndarray) -> float:
        """Mean squared error."""
        return float((self.yy - 2 * beta @ self.xy + beta @ self.xx @ beta) / max(self.n, 1))

    def t_stats(self) -> np.ndarray:
        """Classical t of the least-squares coefficients, the intercept left out; 0 where there is no spread."""
        inverse = np.linalg.pinv(self.xx)
        beta = inverse @ self.xy
        sigma2 = max(self.yy - beta @ self.xy, 0.0) / max(1.0, self.n - len(beta))
        error = np.sqrt(np.clip(np.diag(inverse) * sigma2, 0.0, None))
        return np.divide(beta, error, out=np.zeros_like(beta), where=error > 0)[1:]


def moments(rows: DataFrame, features: list[str], label: str, *parts: Column) -> list[Moments]:
    """Moments of the rows of each condition in ``parts`` (of all rows without one), from one aggregate. Null labels are left out."""
    rows = rows.filter(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features, 1)], F.col(label).cast("double").alias("y"), *[F.coalesce(p, F.lit(False)).alias(f"part{k}") for k, p in enumerate(parts or (F.lit(True),))])
    rows = rows.na.fill(0.0, [f"x{i}" for i in range(1, len(features) + 1)])
    terms = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, len(features) + 1)]]
    k, n_parts = len(terms), len(parts) or 1
    sums = []
    for part in range(n_parts):
        on = lambda v, part=part: F.coalesce(F.sum(F.when(F.col(f"part{part}"), v)), F.lit(0.0))
        sums += [on(terms[i] * terms[j]) for i in range(k) for j in range(i, k)] + [on(t * F.col("y")) for t in terms] + [on(F.col("y") * F.col("y"))]
    found = np.array(rows.agg(F.array(*sums).alias("s")).first()["s"]).reshape(n_parts, -1)
    out = []
    for values in found:
        xx = np.zeros((k, k))
        upper = np.triu_indices(k)
        xx[upper] = values[: len(upper[0])]
        xx = xx + np.triu(xx, 1).T
        out.append(Moments(xx[0, 0], xx, values[len(upper[0]) : -1], values[-1]))
    return out


def chosen_ridge(early: Moments, late: Moments, penalties: tuple[float, ...] = LAMBDAS) -> tuple[float, float]:
    """The penalty whose fit on the early rows has the least error on the late ones, and that error."""
    losses = [late.loss(early.ridge(p)) for p in penalties]
    best = int(np.argmin(losses))
    return penalties[best], losses[best]


def points(coefficients: np.ndarray, t: np.ndarray, fired: np.ndarray, *, t_least: float = T_LEAST, fired_least: float = FIRED_LEAST, cap: int = POINT_CAP) -> np.ndarray:
    """Whole points: coefficients that are significant and fired often enough, the largest scaled to ``POINTS``."""
    kept = np.where((np.abs(t) >= t_least) & (fired >= fired_least), coefficients, 0.0)
    top = np.abs(kept).max(initial=0.0)
    return np.clip(np.round(kept * POINTS / top), -cap, cap).astype(int) if top > 0 else np.zeros(len(kept), int)
