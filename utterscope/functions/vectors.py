"""Array-valued math as Spark higher-order expressions (no Python UDF).

Vectors are ``ARRAY<DOUBLE>``; logits/probabilities are indexed by class id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def with_const(arr, const, fn) -> Column:
    """``transform(arr, x -> fn(x, const))`` with ``const`` evaluated once
    per row.  (An outer expression referenced inside a lambda is evaluated
    for every element — and the optimizer inlines staged columns into
    lambdas — so per-row constants travel through ``array_repeat``.)"""
    a = _c(arr)
    return F.zip_with(a, F.array_repeat(const, F.size(a)), fn)


def as_double(col) -> Column:
    return F.transform(_c(col), lambda x: x.cast("double"))


def array_sum(col) -> Column:
    return F.aggregate(_c(col), F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return array_sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x))


def euclidean(a, b) -> Column:
    return F.sqrt(array_sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def sq_euclidean(a, b) -> Column:
    return array_sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def cosine(a, b, eps: float = 0.0) -> Column:
    """Cosine; 0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b) + F.lit(eps)), F.lit(0.0))


def scale(a, k) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(_c(a), lambda x: x * k)


def unit(a) -> Column:
    """The vector at length one; a zero vector stays zero."""
    return with_const(a, norm(a), lambda x, n: F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(x, n)))


def softmax(logits, temperature=1.0) -> Column:
    """Max-shifted softmax of ``logits / temperature``."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    z = with_const(logits, t, lambda x, tt: x / tt)
    e = with_const(z, F.array_max(z), lambda x, m: F.exp(x - m))
    return with_const(e, array_sum(e), lambda x, s: x / s)


def log_sum_exp(col) -> Column:
    """max + log(sum(exp(x - max))), the max carried in the accumulator."""
    z = _c(col)
    acc = F.struct(F.array_max(z).alias("m"), F.lit(0.0).alias("s"))
    return F.aggregate(z, acc, lambda a, x: F.struct(a["m"].alias("m"), (a["s"] + F.exp(x - a["m"])).alias("s")),
                       lambda a: a["m"] + F.log(a["s"]))


def log_softmax(logits, temperature=1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    z = with_const(logits, t, lambda x, tt: x / tt)
    return with_const(z, log_sum_exp(z), lambda x, lse: x - lse)


def argmax(col) -> Column:
    """0-based index of the first maximum (NumPy tie rule)."""
    p = _c(col)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def at(col, idx0) -> Column:
    """Element at a 0-based index column."""
    i = idx0 if isinstance(idx0, Column) else F.lit(int(idx0))
    return F.element_at(_c(col), i + 1)


def top_k(probs, k: int) -> Column:
    """Top-k (class, prob) structs, prob descending, lower class id first on ties."""
    p = _c(probs)
    pairs = F.transform(p, lambda x, i: F.struct(i.alias("cls"), x.alias("p")))
    ordered = F.array_sort(
        pairs,
        lambda l, r: (F.when(l.p > r.p, -1).when(l.p < r.p, 1)
                      .when(l.cls < r.cls, -1).when(l.cls > r.cls, 1).otherwise(0)),
    )
    return F.slice(ordered, 1, k)


def elementwise_mean(arrays) -> Column:
    """Mean of several equally long arrays (columns), element by element."""
    cols = [_c(a) for a in arrays]
    acc = cols[0]
    for c in cols[1:]:
        acc = F.zip_with(acc, c, lambda x, y: x + y)
    n = float(len(cols))
    return F.transform(acc, lambda x: x / n)
