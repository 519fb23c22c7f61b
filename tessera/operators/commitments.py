"""Products of big integers by group: the commitment to a total is the product of the commitments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups whose products a task holds at once.
HELD = 100_000
NAN = float("nan")


def modular_product(df: DataFrame, by: str, value: str, modulus: int, parts: int = 32) -> DataFrame:
    """by, product (hex) of hexadecimal values modulo `modulus`; nulls don't count.

    Multiplied in two steps, in `parts` partitions at least: rows as they come, so that of a large group each task sends few rows, then
    what is left of each group.
    """
    kind = dict(df.dtypes)[by]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products: dict = {}
        for batch in batches:
            own, schema = batch.column(0).dictionary_encode(), batch.schema
            if not batch.num_rows:
                continue
            # The last place is null's; a NaN is one group, as it is to Spark.
            names = [NAN if k is not None and k != k else k for k in [*own.dictionary.to_pylist(), None]]
            at = pc.fill_null(own.indices, len(names) - 1).to_numpy().tolist()
            for key, x in zip(map(names.__getitem__, at), batch.column(1).to_numpy(zero_copy_only=False).tolist(), strict=True):
                products[key] = products.get(key, 1) * int(x, 16) % modulus
            if len(products) > HELD:
                # In rows that are in order, only the last group can go on.
                rest = {key: products.pop(key)}
                yield table(products, schema)
                products = rest
        if products:
            yield table(products, schema)

    def table(products: dict, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(products), schema.field(0).type), pa.array(list(map(hex, products.values())), pa.string())], names=[by, "x"])

    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).alias("x"))
    partial = rows.mapInArrow(multiply, f"{by} {kind}, x string")
    n = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return partial.repartition(n, by).sortWithinPartitions(by).mapInArrow(multiply, f"{by} {kind}, x string").withColumnRenamed("x", "product")
