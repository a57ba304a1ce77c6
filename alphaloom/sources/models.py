"""Models as tables: the entries of named matrices (name, i, j, w) in Parquet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, i int, j int, w double"


def write_model(weights: DataFrame, path: str) -> None:
    weights.select(*[F.col(c).cast(t) for c, t in (x.split() for x in SCHEMA.split(", "))]).write.parquet(path)


def read_model(spark: SparkSession, path: str, shapes: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
    """The matrices named in `shapes`, which bound what reaches the driver: a table with other entries is an error.

    An entry that is missing, doubled, outside its matrix, null or not finite is an error that names the matrix.
    """
    table = spark.read.schema(SCHEMA).parquet(path).where(F.col("name").isin(list(shapes)))
    inside = F.lit(False)
    for name, (rows, columns) in shapes.items():
        inside = inside | ((F.col("name") == name) & F.col("i").between(0, rows - 1) & F.col("j").between(0, columns - 1))
    good = inside & F.col("w").isNotNull() & ~F.isnan("w") & (F.abs("w") < float("inf"))
    found = table.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("i", "j").alias("places"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad")).collect()
    seen = {r["name"]: r for r in found}
    for name, (rows, columns) in shapes.items():
        r = seen.get(name)
        if r is None or r["bad"] or not r["n"] == r["places"] == rows * columns:
            raise ValueError(f"model at {path}: matrix {name} is not {rows} by {columns} finite entries")
    out = {name: np.zeros(shape) for name, shape in shapes.items()}
    for r in table.collect():
        out[r["name"]][r["i"], r["j"]] = r["w"]
    return out
