"""Least squares, ridge, logistic regression, linear SVM, additive forecasting, principal components."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.expr import dot, num, sigmoid


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; raises if a column holds nulls or NaN (one aggregate)."""
    bad = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns]).first()
    if worst := [c for c in columns if bad[c]]:
        raise ValueError(f"null or NaN in {worst}")
    return df


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centered cross products, by one aggregate with map-side partial sums."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    r = df.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
    n, k = r[0], len(columns)
    if not n:
        raise ValueError("no rows")
    s = np.zeros((k, k))
    for (i, j), v in zip(pairs, r[1 + k :]):
        s[i, j] = s[j, i] = v * n
    return n, np.array(r[1 : 1 + k], float), s


@dataclass
class LeastSquares:
    """Linear (one feature), multiple, and ridge regression (alpha > 0, intercept free) in closed form."""

    features: list[str]
    label: str = "label"
    alpha: float = 0.0
    intercept: float | None = None
    coefficients: np.ndarray | None = None
    n: int = 0
    mean: np.ndarray | None = None
    inverse: np.ndarray | None = None
    residual_variance: float | None = None

    def fit(self, df: DataFrame) -> LeastSquares:
        complete(df, [*self.features, self.label])
        self.n, mean, s = moments(df, [*self.features, self.label])
        k = len(self.features)
        gram = s[:k, :k] + self.alpha * np.eye(k)
        self.coefficients = np.linalg.lstsq(gram, s[:k, k], rcond=None)[0] if np.linalg.cond(gram) > 1e14 else np.linalg.solve(gram, s[:k, k])
        self.intercept = float(mean[k] - mean[:k] @ self.coefficients)
        self.mean, self.inverse, left = mean[:k], np.linalg.pinv(gram), self.n - k - 1
        self.residual_variance = max(float(s[k, k] - 2 * self.coefficients @ s[:k, k] + self.coefficients @ s[:k, :k] @ self.coefficients), 0.0) / left if left > 0 else None
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.expr(dot(self.features, self.coefficients, self.intercept)))

    def interval(self, df: DataFrame, z: float = 1.96, new_row: bool = True) -> DataFrame:
        """df with prediction, error (standard error of a new row, or of the mean), lower and upper; alpha must be 0."""
        if self.alpha or self.residual_variance is None:
            raise ValueError("intervals need alpha 0 and more rows than coefficients")
        x = [f"({f} - {num(m)})" for f, m in zip(self.features, self.mean)]
        lever = " + ".join([num(1 / self.n + new_row), *(f"{num(v)} * {x[i]} * {x[j]}" for (i, j), v in np.ndenumerate(self.inverse))])
        out = self.predict(df).withColumn("error", F.expr(f"sqrt({num(self.residual_variance)} * ({lever}))"))
        return out.withColumns({"lower": F.col("prediction") - z * F.col("error"), "upper": F.col("prediction") + z * F.col("error")})

    def get_coefficients(self) -> dict:
        return {"intercept": self.intercept, "coefficients": list(self.coefficients), "slope": float(self.coefficients[0]), "alpha": self.alpha}

    def score(self, df: DataFrame) -> float | None:
        return metrics.r2(self.predict(df), self.label)


@dataclass
class LogisticRegression:
    """Full-batch gradient descent: each step is one aggregate over the cached rows."""

    features: list[str]
    label: str = "label"
    learning_rate: float = 0.01
    iterations: int = 1000
    fit_intercept: bool = True
    start: list[float] | None = None  # intercept first; zeros if none
    weights: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame) -> LogisticRegression:
        rows = complete(df, [*self.features, self.label]).select(*self.features, self.label).persist()
        w = np.array(self.start if self.start is not None else np.zeros(len(self.features) + 1), float)
        self.losses = []
        for _ in range(self.iterations):
            p = sigmoid(dot(self.features, w[1:], w[0]))
            q = f"least(greatest({p}, 1e-15D), 1 - 1e-15D)"
            r = rows.agg(*[F.expr(f"avg(({p} - {self.label}) * {f})") for f in ("1", *self.features)], F.expr(f"-avg({self.label} * ln({q}) + (1 - {self.label}) * ln(1 - {q}))")).first()
            self.losses.append(r[-1])
            g = np.array(r[:-1], float)
            g[0] *= self.fit_intercept
            w = w - self.learning_rate * g
        rows.unpersist()
        self.weights = w
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", F.expr(sigmoid(dot(self.features, self.weights[1:], self.weights[0]))))

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return self.predict_proba(df).withColumn("prediction", (F.col("probability") >= threshold).cast("int"))

    def get_coefficients(self) -> dict:
        return {"intercept": float(self.weights[0]), "coefficients": list(self.weights[1:])}

    def score(self, df: DataFrame) -> float | None:
        return metrics.accuracy(self.predict(df), self.label)


@dataclass
class LinearSvm:
    """Hinge loss with L2 by full-batch subgradient steps; labels at most 0 count as -1."""

    features: list[str]
    label: str = "label"
    learning_rate: float = 0.001
    lambda_param: float = 0.01
    iterations: int = 1000
    weights: np.ndarray | None = None
    bias: float = 0.0
    losses: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame) -> LinearSvm:
        sign = f"case when {self.label} <= 0 then -1D else 1D end"
        rows = complete(df, [*self.features, self.label]).select(*self.features, F.expr(sign).alias("y_")).persist()
        w, b, self.losses = np.zeros(len(self.features)), 0.0, []
        for _ in range(self.iterations):
            z = f"y_ * ({dot(self.features, w, b)})"
            r = rows.agg(*[F.expr(f"avg(case when {z} < 1 then -y_ * {f} else 0D end)") for f in ("1", *self.features)], F.expr(f"avg(greatest(0D, 1 - {z}))")).first()
            self.losses.append(self.lambda_param * float(w @ w) + r[-1])
            w = w - self.learning_rate * (2 * self.lambda_param * w + np.array(r[1:-1], float))
            b -= self.learning_rate * r[0]
        rows.unpersist()
        self.weights, self.bias = w, b
        return self

    def decision_function(self, df: DataFrame) -> DataFrame:
        return df.withColumn("margin", F.expr(dot(self.features, self.weights, self.bias)))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.decision_function(df).withColumn("prediction", F.when(F.col("margin") >= 0, 1).otherwise(-1))

    def score(self, df: DataFrame) -> float | None:
        return metrics.accuracy(self.predict(df).withColumn("y_", F.expr(f"case when {self.label} <= 0 then -1 else 1 end")), "y_")

    def get_params(self) -> dict:
        return {"weights": list(self.weights), "bias": self.bias, "norm_w": float(np.linalg.norm(self.weights))}


@dataclass
class PrincipalComponents:
    """n_components: None (all), a number, or a share of the variance; loadings have their largest entry positive."""

    features: list[str]
    n_components: int | float | None = None
    mean: np.ndarray | None = None
    components: np.ndarray | None = None
    explained_variance: np.ndarray | None = None
    explained_variance_ratio: np.ndarray | None = None
    singular_values: np.ndarray | None = None

    def fit(self, df: DataFrame) -> PrincipalComponents:
        n, self.mean, s = moments(complete(df, self.features), self.features)
        values, vectors = np.linalg.eigh(s / (n - 1))
        order = np.argsort(-values)
        values, vectors = np.maximum(values[order], 0), vectors[:, order].T
        vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
        ratio = values / values.sum()
        k = len(values) if self.n_components is None else int(np.searchsorted(np.cumsum(ratio), self.n_components - 1e-12) + 1) if isinstance(self.n_components, float) else self.n_components
        self.components, self.explained_variance, self.explained_variance_ratio = vectors[:k], values[:k], ratio[:k]
        self.singular_values = np.sqrt(values[:k] * (n - 1))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"pc_{i}": F.expr(dot(self.features, c, -float(c @ self.mean))) for i, c in enumerate(self.components)})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        names = [f"pc_{i}" for i in range(len(self.components))]
        return df.withColumns({f"{f}_restored": F.expr(dot(names, self.components[:, j], self.mean[j])) for j, f in enumerate(self.features)})

    def get_covariance(self) -> np.ndarray:
        return self.components.T @ np.diag(self.explained_variance) @ self.components

    def score(self, df: DataFrame) -> float:
        both = self.inverse_transform(self.transform(df))
        return -metrics.first(both.agg(F.expr("avg((" + " + ".join(f"pow({f} - {f}_restored, 2)" for f in self.features) + f") / {len(self.features)})")))


@dataclass
class AdditiveForecast:
    """Trend with change points, yearly and weekly Fourier terms, by least squares on generated columns."""

    n_changepoints: int = 25
    yearly_seasonality: bool = True
    weekly_seasonality: bool = True
    yearly_fourier_order: int = 10
    weekly_fourier_order: int = 3
    changepoint_range: float = 0.8
    cap: float | None = None  # logistic growth towards cap: the sum of the terms is fitted to ln(y / (cap - y))
    refine: int = 0  # of logistic growth: steps of damped Gauss-Newton on the squared errors of y itself, from that fit
    start: dt.date | None = None
    last: dt.date | None = None
    changepoints: np.ndarray | None = None
    weights: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)  # squared errors of y: at the start and after each step

    def _terms(self) -> list[tuple[str, str]]:
        out = [("trend", "t_"), *(("trend", f"greatest(0D, t_ - {num(s)})") for s in self.changepoints)]
        for name, on, order, period in (("yearly", self.yearly_seasonality, self.yearly_fourier_order, 365.25), ("weekly", self.weekly_seasonality, self.weekly_fourier_order, 7.0)):
            out += [(name, f"{fn}({num(2 * np.pi * i / period)} * t_)") for i in range(1, order + 1) for fn in ("cos", "sin") if on]
        return out

    def _time(self, df: DataFrame) -> DataFrame:
        return df.withColumn("t_", F.expr(f"cast(datediff(to_date(ds), date'{self.start}') as double)"))

    def fit(self, df: DataFrame) -> AdditiveForecast:
        """df: ds (date or 'yyyy-MM-dd'), y.  The start is the first date; change points lie evenly over the first dates."""
        self.start, self.last = df.agg(F.min(F.to_date("ds")), F.max(F.to_date("ds"))).first()
        rows = every = self._time(df)
        if self.cap is not None:
            rows = rows.where(F.col("y").between(0, self.cap) & (F.col("y") > 0) & (F.col("y") < self.cap)).withColumn("y", F.log(F.col("y") / (F.lit(float(self.cap)) - F.col("y"))))
        top = metrics.first(rows.agg(F.max("t_"))) * self.changepoint_range
        self.changepoints = np.linspace(0, top, self.n_changepoints + 2)[1:-1] if self.n_changepoints else np.zeros(0)
        terms = self._terms()
        design = rows.select("y", *[F.expr(e).alias(f"x_{i}") for i, (_, e) in enumerate(terms)])
        n, mean, s = moments(design, [*(f"x_{i}" for i in range(len(terms))), "y"])
        k = len(terms)
        scale = np.sqrt(np.maximum(np.diag(s)[:k], 1e-12))
        beta = np.linalg.lstsq(s[:k, :k] / np.outer(scale, scale), s[:k, k] / scale, rcond=1e-10)[0] / scale
        self.weights = np.append(mean[k] - mean[:k] @ beta, beta)
        if self.cap is not None and self.refine:
            self._refined(every.where(F.col("y").isNotNull()).select("y", *[F.expr(e).alias(f"x_{i}") for i, (_, e) in enumerate(terms)]))
        return self

    def _refined(self, design: DataFrame) -> None:
        """Levenberg's and Marquardt's steps: all rows give the sums of squares of the Jacobian, one job a step; a step that
        does not lower the errors is taken back and the damping raised."""
        k = len(self.weights)
        design = design.persist()

        def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            p = sigmoid("(" + dot([f"x_{i}" for i in range(k - 1)], w[1:], w[0]) + ")")
            rows = design.withColumn("p_", F.expr(p)).withColumn("s_", F.expr(f"{num(self.cap)} * p_ * (1 - p_)"))
            rows = rows.select(F.col("s_").alias("j_0"), *[F.expr(f"s_ * x_{i}").alias(f"j_{i + 1}") for i in range(k - 1)], F.expr(f"y - {num(self.cap)} * p_").alias("r_"))
            n, mean, s = moments(rows, [*(f"j_{i}" for i in range(k)), "r_"])
            s = s + n * np.outer(mean, mean)
            return float(s[k, k]), s[:k, :k], s[:k, k]

        loss, square, slope = at(self.weights)
        self.losses, damping = [loss], 1e-3
        for _ in range(self.refine):
            scale = np.sqrt(np.maximum(np.diag(square), 1e-300))
            step = np.linalg.lstsq(square / np.outer(scale, scale) + damping * np.eye(k), slope / scale, rcond=1e-14)[0] / scale
            tried = at(self.weights + step)
            if tried[0] < loss:
                (loss, square, slope), self.weights, damping = tried, self.weights + step, damping / 10
            else:
                damping *= 10
            self.losses.append(loss)
        design.unpersist()

    def get_components(self, df: DataFrame) -> DataFrame:
        terms, parts = self._terms(), {"trend": [num(self.weights[0])], "yearly": ["0D"], "weekly": ["0D"]}
        for (name, e), w in zip(terms, self.weights[1:]):
            parts[name].append(f"{num(w)} * {e}")
        out = self._time(df).withColumns({k: F.expr(" + ".join(v)) for k, v in parts.items()}).drop("t_")
        total = F.expr("trend + yearly + weekly")
        return out.withColumn("yhat", total if self.cap is None else float(self.cap) / (1 + F.exp(-total)))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.get_components(df).drop("trend", "yearly", "weekly")

    def make_future_dataframe(self, spark, periods: int, freq: str = "D") -> DataFrame:
        step = {"D": 1, "W": 7, "M": 30}
        if freq not in step:
            raise ValueError(f"unknown freq {freq!r}")
        return spark.range(1, periods + 1).select(F.expr(f"date_add(date'{self.last}', cast(id * {step[freq]} as int))").alias("ds"))

    def cross_validate(self, df: DataFrame, n_folds: int = 5, test_days: int = 30) -> list[tuple[int, float | None]]:
        """(training rows, mean absolute error) by fold: windows of test_days before the last date, each after all it is fitted on."""
        days = df.withColumn("day_", F.to_date("ds"))
        last, out = metrics.first(days.agg(F.max("day_"))), []
        for fold in range(n_folds, 0, -1):
            cut, end = (last - dt.timedelta(days=test_days * k) for k in (fold, fold - 1))
            train = days.where(F.col("day_") <= F.lit(cut)).drop("day_")
            test = days.where((F.col("day_") > F.lit(cut)) & (F.col("day_") <= F.lit(end))).drop("day_")
            out.append((train.count(), replace(self).fit(train).mae(test)))
        return out

    def score(self, df: DataFrame) -> float | None:
        return metrics.r2(self.predict(df), "y", "yhat")

    def mae(self, df: DataFrame) -> float:
        return metrics.mae(self.predict(df), "y", "yhat")

    def rmse(self, df: DataFrame) -> float:
        return metrics.rmse(self.predict(df), "y", "yhat")
