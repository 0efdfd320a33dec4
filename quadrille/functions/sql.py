"""The predicates and distances as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "q_dist": "(ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE) RETURNS DOUBLE RETURN sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))",
    "q_in_box": "(x DOUBLE, y DOUBLE, lx DOUBLE, ly DOUBLE, hx DOUBLE, hy DOUBLE) RETURNS BOOLEAN RETURN x >= lx AND x <= hx AND y >= ly AND y <= hy",
    "q_in_circle": "(x DOUBLE, y DOUBLE, cx DOUBLE, cy DOUBLE, r DOUBLE) RETURNS BOOLEAN RETURN sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) <= r",
    "q_box_dist": "(x DOUBLE, y DOUBLE, lx DOUBLE, ly DOUBLE, hx DOUBLE, hy DOUBLE) RETURNS DOUBLE RETURN sqrt(greatest(lx - x, 0, x - hx) * greatest(lx - x, 0, x - hx) + greatest(ly - y, 0, y - hy) * greatest(ly - y, 0, y - hy))",
    "q_cell": "(x DOUBLE, width DOUBLE) RETURNS BIGINT RETURN CAST(floor(x / width) AS BIGINT)",
    "q_cells_around": "(cx BIGINT, cy BIGINT) RETURNS TABLE(gx BIGINT, gy BIGINT) RETURN SELECT cx + a.o, cy + b.o FROM VALUES (-1), (0), (1) AS a(o), VALUES (-1), (0), (1) AS b(o)",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")
    return list(FUNCTIONS)
