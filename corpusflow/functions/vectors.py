"""Vector Column expressions (higher-order functions, JVM-side).

These are the SQL forms; the corpus-scale search uses the Arrow matmul path in
``operators.vector_search``. Vectors are cast to DOUBLE before any arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def cosine(a, b) -> Column:
    """dot / (|a||b|), 0.0 when either norm is 0. Unequal lengths are a contract violation
    (see ``operators.embedding.vector_contract``) and yield NULL here."""
    na, nb = norm(a), norm(b)
    same = F.size(_col(a)) == F.size(_col(b))
    return F.when(~same, F.lit(None).cast("double")).when(
        (na == 0) | (nb == 0), F.lit(0.0)
    ).otherwise(dot(a, b) / (na * nb))


def l2_normalise(v) -> Column:
    """Unit vector; an all-zero vector stays zero (divide by 1)."""
    n = norm(v)
    safe = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(as_double(v), lambda x: x / safe)
