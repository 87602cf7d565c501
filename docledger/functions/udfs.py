"""Optional extensions for SQL users: full Unicode folding, fee lines as a table function, views over job outputs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nfkc():
    """Vectorised NFKC with a split SARA AM composed again."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).replace("ํา", "ำ"))

    return run


def register_fee_lines(spark: SparkSession, name: str = "fee_lines") -> None:
    """fee_lines(text) as a SQL table function: (name, amount)."""
    import re

    from pyspark.sql.functions import udtf

    from .fields import FEE_LINE

    @udtf(returnType="name string, amount string")
    class FeeLines:
        def eval(self, text: str):
            for m in re.finditer(FEE_LINE, text or ""):
                yield m[1].strip()[:60], (m[4] or m[2]).replace(",", "")

    spark.udtf.register(name, FeeLines)


def register_views(**frames: DataFrame) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
