"""Vector expressions on array columns: double accumulation, JVM-side, usable in any plan or in SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Denominators under this make a cosine 0.
TINY = 1e-12


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products; null if a vector is null or lengths differ."""
    products = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    squares = F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; 0 where the product of the norms is under TINY. Norms that are already columns may be given."""
    scale = (l2_norm(a) if norm_a is None else norm_a) * (l2_norm(b) if norm_b is None else norm_b)
    return F.when(scale < TINY, F.lit(0.0)).otherwise(inner_product(a, b) / scale)


def normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    norm = l2_norm(v)
    return F.when(norm < TINY, _double(v)).otherwise(F.transform(_double(v), lambda x: x / norm))


def vector_literal(values) -> Column:
    """A query vector as a constant."""
    return F.array(*[F.lit(float(x)) for x in values])


# Bodies of the SQL functions of the same names.
SQL = {
    "inner_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "l2_norm": ("v ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"),
    "l2_squared": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "cosine_similarity": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        f"CASE WHEN sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) < {TINY}D THEN 0D"
        " ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
        " / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))) END",
    ),
    "normalize_vector": (
        "v ARRAY<DOUBLE>",
        "ARRAY<DOUBLE>",
        f"CASE WHEN sqrt(aggregate(v, 0D, (s, x) -> s + x * x)) < {TINY}D THEN v ELSE transform(v, x -> x / sqrt(aggregate(v, 0D, (s, y) -> s + y * y))) END",
    ),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL in this session; Spark inlines them into the plan."""
    for name, (args, returns, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
