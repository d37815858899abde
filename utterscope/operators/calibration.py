"""Temperature calibration.

The NLL over a temperature grid is one pass: each scored row, its logits
shifted once, is expanded by a generator over the (small, fixed) grid and
partial averages per temperature reduce it before the shuffle.
The fit refines the grid around the best point twice (NLL is convex in
1/T), i.e. three aggregate passes instead of a driver-side optimiser loop
over rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscope.functions import vectors as vx


def log_grid(lo: float = 0.1, hi: float = 10.0, n: int = 41) -> list[float]:
    return [round(math.exp(math.log(lo) + i * (math.log(hi) - math.log(lo)) / (n - 1)), 12) for i in range(n)]


def nll_at_temperature(df: DataFrame, temps: list[float], logits: str = "logits",
                       label_idx: str = "label") -> DataFrame:
    """(temperature, nll) — mean of logsumexp(z/T) - z_y/T per T.

    Logits are shifted by their maximum once per row; a row is then expanded
    over the grid and averaged before any shuffle, one sum per temperature."""
    if not temps:
        return df.sparkSession.createDataFrame([], "temperature double, nll double")
    shifted = df.select(vx.with_const(logits, F.array_max(logits), lambda z, most: z - most).alias("z"), label_idx)
    grid = shifted.select("z", F.get("z", F.col(label_idx)).alias("zy"),
                          F.explode(F.array(*[F.lit(float(t)) for t in temps])).alias("temperature"))
    total = F.aggregate("z", F.lit(0.0), lambda acc, z: acc + F.exp(z / F.col("temperature")))
    return grid.groupBy("temperature").agg(F.avg(F.log(total) - F.col("zy") / F.col("temperature")).alias("nll"))


def _best(nll: DataFrame) -> tuple[float, float]:
    """Best (T, nll) of a grid result — one row read back."""
    r = nll.orderBy("nll", "temperature").limit(1).collect()[0]
    return float(r["temperature"]), float(r["nll"])


def fit_temperature(df: DataFrame, logits: str = "logits", label_idx: str = "label",
                    lo: float = 0.1, hi: float = 10.0, n: int = 41, refine: int = 2,
                    n_refine: int = 21) -> tuple[float, float]:
    """I4: minimise NLL over T in [lo, hi]: log grid, then ``refine`` finer
    grids between the best point's neighbours."""
    from utterscope.session import reliable_checkpoint
    df = reliable_checkpoint(df.select(logits, label_idx))  # read once per grid, scored once
    grid = log_grid(lo, hi, n)
    t_best, nll_best = _best(nll_at_temperature(df, grid, logits, label_idx))
    for _ in range(refine):
        i = min(range(len(grid)), key=lambda j: abs(grid[j] - t_best))
        a, b = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
        grid = [round(a + (b - a) * j / (n_refine - 1), 12) for j in range(n_refine)]
        t_best, nll_best = _best(nll_at_temperature(df, grid, logits, label_idx))
    return t_best, nll_best


def verdict(t) -> F.Column:
    t = t if isinstance(t, F.Column) else F.lit(float(t))
    return (F.when(t > 1.5, F.lit("over-confident")).when(t < 0.8, F.lit("under-confident"))
            .otherwise(F.lit("reasonable")))


def calibration_report(df: DataFrame, temperature: float, logits: str = "logits",
                       label_idx: str = "label") -> DataFrame:
    """Accuracy and mean/median confidence before (T = 1) and after
    (T = fitted), count of confidences >= 0.9999 before, verdict."""
    from utterscope.operators.metrics import exact_median
    rows = []
    for name, t in (("before", 1.0), ("after", float(temperature))):
        p = vx.softmax(logits, t)
        x = df.select(F.col(label_idx), F.array_max(p).alias("conf"), vx.argmax(p).alias("pred"))
        med = exact_median(x, "conf").select("median").scalar()
        rows.append(x.agg(F.lit(name).alias("stage"), F.lit(t).alias("temperature"),
                          F.avg((F.col("pred") == F.col(label_idx)).cast("double")).alias("accuracy"),
                          F.avg("conf").alias("mean_confidence"),
                          F.count_if(F.col("conf") >= 0.9999).alias("n_saturated"))
                     .withColumn("median_confidence", med))
    out = rows[0].unionByName(rows[1])
    return out.withColumn("verdict", verdict(F.lit(float(temperature))))
