"""Table functions for SQL."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

FIELDS = ("chist", "chist_p", "dhash", "emb", "emb_p")


class Frames:
    """frames(fingerprint, fields): a row for each frame of a fingerprint's JSON, with defaults, and a column of numbers for each of the fields
    that are asked for by name, comma-separated. What is no object with a list of frames has no rows."""

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.wanted = [f.name for f in analyzed.schema.fields[4:]] if analyzed else []

    @staticmethod
    def analyze(fingerprint: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not fields.isConstantExpression:
            raise ValueError("fields must be a constant")
        wanted = [f.strip() for f in (fields.value or "").split(",") if f.strip()]
        if unknown := [f for f in wanted if f not in FIELDS]:
            raise ValueError(f"no such fields: {', '.join(unknown)}")
        schema = StructType().add("seq", IntegerType()).add("file", StringType()).add("cell", StringType()).add("sector", IntegerType())
        for f in wanted:
            schema = schema.add(f, ArrayType(DoubleType()))
        return AnalyzeResult(schema)

    def eval(self, fingerprint: str, fields: str):
        try:
            frames = json.loads(fingerprint or "").get("frames")
        except (ValueError, AttributeError):
            return
        whole = lambda x, otherwise: x if isinstance(x, int) and not isinstance(x, bool) else otherwise
        for i, f in enumerate(frames if isinstance(frames, list) else []):
            if isinstance(f, dict):
                file = f.get("file") if isinstance(f.get("file"), str) else f"frames/{i:03d}.jpg"
                vectors = [[float(x) if isinstance(x, (int, float)) else None for x in v] if isinstance(v := f.get(k), list) else None for k in self.wanted]
                yield (whole(f.get("seq"), i + 1), file, str(f["cell"]) if f.get("cell") not in (None, "") else f"c{file}", whole(f.get("sector"), -1), *vectors)


def register(spark: SparkSession) -> None:
    """Make `frames` known to SQL."""
    spark.udtf.register("frames", udtf(Frames))
