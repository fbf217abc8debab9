"""Vectors as array columns; arithmetic in doubles."""

from pyspark.sql import Column, DataFrame, functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column, floor: float = 0.0) -> Column:
    """Unit length; a zero vector stays zero. With a floor, that is the least divisor."""
    n = F.greatest(norm(v), F.lit(floor)) if floor else norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v))


def rounded(v: Column, places: int) -> Column:
    """Elements to so many places; what rounds to zero keeps its sign, as in SQL."""
    return F.transform(v, lambda x: F.signum(x) * F.abs(F.round(x, places)))


def weighted_sum(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None, name: str = "vector") -> DataFrame:
    """keys and the sum of weight * vector for each group, element by element.

    Elements are summed as rows of (keys, place), with partial sums before the shuffle; null vectors are left out.
    """
    w = weight if weight is not None else F.lit(1.0)
    parts = df.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_at", "_x"))
    sums = parts.groupBy(*keys, "_at").agg(F.sum(F.col("_w") * F.col("_x").cast("double")).alias("_x"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(name))
