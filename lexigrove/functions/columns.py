"""Scalar column functions; all of them stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_trim(c: Column | str) -> Column:
    """Strip every kind of Unicode white space; an all-blank value becomes ''."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def vector_norm(c: Column | str) -> Column:
    c = _col(c)
    return F.sqrt(_sum(F.transform(c, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(c: Column | str) -> Column:
    """Unit-length copy of a vector as ``array<float>``; the zero vector stays zero."""
    c = _col(c)
    # the norm is an argument of the outer lambda, so that it is computed once per row
    scaled = F.transform(
        F.array(vector_norm(c)),
        lambda n: F.transform(
            c, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)
        ),
    )
    return scaled[0].cast("array<float>")


def sq_l2(a: Column | str, b: Column | str) -> Column:
    return _sum(
        F.zip_with(
            _col(a),
            _col(b),
            lambda x, y: (x.cast("double") - y.cast("double"))
            * (x.cast("double") - y.cast("double")),
        )
    )


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(sq_l2(a, b))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cos(a, b); 1 where either vector is zero."""
    norms = vector_norm(a) * vector_norm(b)
    return F.when(norms == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / norms)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """|a & b| / |a | b| of two arrays taken as sets, 0 where either is empty or null."""
    a, b = _col(a), _col(b)
    empty = F.coalesce(F.size(a) <= 0, F.lit(True)) | F.coalesce(F.size(b) <= 0, F.lit(True))
    return F.when(empty, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def char_ngrams(
    c: Column | str, n_min: int = 3, n_max: int = 6, distinct: bool = True
) -> Column:
    """Character n-grams of ``<word>`` and the marked word itself.

    Each is listed once. With ``distinct=False`` each is listed as often as it occurs, the
    marked word only if it is not one of the n-grams by its length.
    """
    marked = F.concat(F.lit("<"), _col(c), F.lit(">"))

    def of_size(n: int) -> Column:
        starts = F.when(
            F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - (n - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(marked, i, n))

    grams = F.concat(*[of_size(n) for n in range(n_min, n_max + 1)])
    if distinct:
        return F.array_distinct(F.concat(grams, F.array(marked)))
    listed = F.length(marked).between(n_min, n_max)
    return F.when(listed, grams).otherwise(F.concat(grams, F.array(marked)))


def truncate_tokens(c: Column | str, max_length: int = 16) -> Column:
    """First ``max_length`` tokens of a token array."""
    return F.slice(_col(c), 1, max_length)
