"""Vector functions over array<double> columns, as built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12
V = "array<double>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where body uses it inside other functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def vector(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def cast(column: Column | str, precision: str = "f64") -> Column:
    """Any numeric array as array<double>; f32 rounds each number through a float."""
    c = vector(column)
    return c.cast("array<float>").cast(V) if precision == "f32" else c.cast(V)


def total(column: Column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(vector(a), vector(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(vector(a), F.lit(0.0), lambda s, x: s + x * x))


def scale(a: Column | str, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(vector(a), lambda x: x * by)


def normalize(a: Column | str) -> Column:
    """The unit vector; a vector shorter than TINY stays as it is."""
    return let(vector(a), lambda v: let(norm(v), lambda n: F.when(n < TINY, v).otherwise(F.transform(v, lambda x: x / n))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 if either vector is shorter than TINY."""
    guarded = lambda x, y, na, nb: F.when((na < TINY) | (nb < TINY), F.lit(0.0)).otherwise(dot(x, y) / (na * nb))
    return let(vector(a), lambda x: let(vector(b), lambda y: let(norm(x), lambda na: let(norm(y), lambda nb: guarded(x, y, na, nb)))))


def softmax(values: Column | str, beta: float | Column = 1.0) -> Column:
    """Softmax of beta times an array; uniform if the largest value is not finite, empty for an empty array."""
    beta = beta if isinstance(beta, Column) else F.lit(float(beta))

    def shares(x: Column, top: Column) -> Column:
        odd = F.isnan(top) | (F.abs(top) == F.lit(float("inf")))
        even = F.transform(x, lambda _: F.lit(1.0) / F.size(x))
        return F.when(odd, even).otherwise(let(F.transform(x, lambda v: F.exp(v - top)), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s))))

    return let(F.transform(vector(values), lambda v: v * beta), lambda x: F.when(F.size(x) == 0, F.array().cast(V)).otherwise(let(F.array_max(x), lambda top: shares(x, top))))


def logsumexp(values: Column | str, beta: float = 1.0) -> Column:
    """ln of the sum of exp(beta * value), shifted by the largest value; 0 for an empty array."""
    shifted = lambda x, top: top + F.log(total(F.transform(x, lambda v: F.exp(v - top))))
    return let(scale(values, beta), lambda x: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(let(F.array_max(x), lambda top: shifted(x, top))))


def entropy(weights: Column | str) -> Column:
    """Entropy of weights over its largest value; 0 for fewer than two weights."""
    w = vector(weights)
    h = total(F.transform(w, lambda x: F.when(x > 0, -x * F.log(x)).otherwise(F.lit(0.0))))
    return F.when(F.size(w) < 2, F.lit(0.0)).otherwise(h / F.log(F.size(w).cast("double")))


def add_scaled(a: Column | str, b: Column | str, by: Column | float = 1.0) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.zip_with(vector(a), vector(b), lambda x, y: x + by * y)


def weighted_sum(rows: Column, weight: str = "w", value: str = "v") -> Column:
    """Sum of weight * vector over an array of structs."""

    def summed(r: Column) -> Column:
        zero = F.transform(F.element_at(r, 1)[value], lambda x: x * 0.0)
        return F.aggregate(r, zero, lambda s, one: F.zip_with(s, one[value], lambda x, y: x + one[weight] * y))

    return let(rows, summed)


def finite(a: Column | str) -> Column:
    return F.forall(vector(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def checked(a: Column | str, d: int) -> Column:
    """The vector, or an error naming what is wrong with its size or numbers."""
    c = vector(a)
    return F.when(F.size(c) != d, F.raise_error(F.concat(F.lit(f"expected {d} numbers, got "), F.size(c).cast("string"))).cast(V)).when(~finite(c), F.raise_error(F.lit("a vector holds NaN or infinity")).cast(V)).otherwise(c)


def involve(a: Column | str) -> Column:
    """Reads a vector backwards from its second number: the inverse under circular convolution of unitary vectors."""
    c = vector(a)
    return F.concat(F.slice(c, 1, 1), F.reverse(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))))


def _circular(a: Column, b: Column, sign: int) -> Column:
    d = F.size(a)
    places = F.sequence(F.lit(0), d - 1)
    at = lambda k, i: F.element_at(b, (F.pmod(k - i if sign > 0 else i - k, d) + 1).cast("int"))
    return F.transform(places, lambda k: F.aggregate(places, F.lit(0.0), lambda s, i: s + F.element_at(a, i + 1) * at(k, i)))


def convolve(a: Column | str, b: Column | str) -> Column:
    """Circular convolution by definition, d * d products; spectral.bind is the fast form."""
    return _circular(vector(a), vector(b), 1)


def correlate(c: Column | str, a: Column | str) -> Column:
    """Circular correlation: what is bound to a in c."""
    return _circular(vector(c), vector(a), -1)


def bind(a: Column | str, b: Column | str) -> Column:
    return normalize(convolve(a, b))


def permute(a: Column | str, indices: Column | list[int]) -> Column:
    """out[i] = a[indices[i]]."""
    order = F.array(*[F.lit(i) for i in indices]) if isinstance(indices, list) else indices
    return F.transform(order, lambda i: F.element_at(vector(a), (i + 1).cast("int")))


def matrix_apply(matrix: list[list[float]], a: Column | str) -> Column:
    """matrix times vector, for matrices of a fixed small size."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in matrix])
    return F.transform(rows, lambda row: dot(row, a))


def slerp(a: Column | str, b: Column | str, t: Column | float) -> Column:
    """Spherical interpolation; straight interpolation where the vectors are almost parallel or opposite."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    flat = lambda c: F.abs(c) > 0.9995
    parts = lambda w: F.struct((F.sin((1 - t) * w) / F.sin(w)).alias("a"), (F.sin(t * w) / F.sin(w)).alias("b"))
    straight = F.struct((1 - t).cast("double").alias("a"), t.cast("double").alias("b"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))
    weights = let(cos, lambda c: F.when(flat(c), straight).otherwise(let(F.acos(c), parts)))
    return normalize(let(weights, lambda w: F.zip_with(vector(a), vector(b), lambda x, y: w["a"] * x + w["b"] * y)))


def pattern(counter: Column | str, count: Column | str) -> Column:
    """counter / write_count; zeros where nothing was written."""
    n = vector(count)
    return F.when(F.abs(n) < TINY, scale(counter, 0.0)).otherwise(F.transform(vector(counter), lambda x: x / n))


def unit_pattern(counter: Column | str, count: Column | str) -> Column:
    return normalize(pattern(counter, count))


def engram_bits(locations: Column, d: int) -> Column:
    """Cost in bits of one more location."""
    return F.log2(locations + 1) + F.log2(F.greatest(F.lit(d / 32), F.lit(2.0)))


def surprise_bits(similarity: Column) -> Column:
    """Cost in bits of an input at a similarity to what is known."""
    return -F.log2(F.greatest(F.lit(2.0**-12), F.least(similarity, F.lit(1.0))))


def neighbor_cap(locations: Column, k: int, enabled: bool = True) -> Column:
    """Neighbours that a location may list among so many locations."""
    wide = (k - 1) * F.ceil(F.log(F.greatest(locations.cast("double"), F.lit(1.0))))
    return F.greatest(wide, F.lit(2 * k)).cast("long") if enabled else F.lit(0).cast("long")


def learning_rate(writes: Column, eta_0: float, decay: float, eta_min: float) -> Column:
    """The rate after so many writes, in closed form."""
    return F.greatest(F.lit(eta_0) * F.pow(F.lit(decay), writes), F.lit(eta_min))


def vector_sum(df: DataFrame, keys: list[str], value: str, weight: Column | None = None, name: str = "total") -> DataFrame:
    """Weighted sum of a vector column per key: partial sums by position before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    parts = df.select(*keys, w.alias("_w"), F.posexplode(vector(value)).alias("_at", "_x"))
    sums = parts.groupBy(*keys, "_at").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"))
    return sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_s"))), lambda r: r["_s"]).alias(name))


def bundle(df: DataFrame, keys: list[str], value: str, weight: Column | None = None, unit: bool = True, name: str = "bundle") -> DataFrame:
    """Superposition of a vector column per key, normalised unless unit is false. Negative weights are allowed."""
    out = vector_sum(df, keys, value, weight, name)
    return out.withColumn(name, normalize(name)) if unit else out


def seed_of(name: Column) -> Column:
    """The first eight bytes of the SHA-256 of a text as an unsigned number."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, 10).cast("decimal(20,0)")
