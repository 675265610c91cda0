"""Row translators: a series row to any number of rows of a user's own schema, as a Python table function."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: What a translator makes of one row, and its schema: fixed, or worked out from that of the row.
RowsOf = Callable[[Mapping], Iterable[tuple]]
SchemaOf = StructType | str | Callable[[StructType], StructType]


def register(spark: SparkSession, name: str, rows_of: RowsOf, schema: SchemaOf) -> None:
    """Registers ``rows_of`` as the table function ``name`` of one struct.

    In SQL: ``SELECT t.* FROM series s, LATERAL name(named_struct('sum', s.sum)) t``.  A row may give none, one or many; batches of rows
    go to Python by Arrow.
    """
    fixed = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    class Translator:
        @staticmethod
        def analyze(row: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(row.dataType, StructType):
                raise ValueError(f"{name} takes a struct")
            return AnalyzeResult(fixed if isinstance(fixed, StructType) else fixed(row.dataType))

        def eval(self, row):
            yield from rows_of(row.asDict())

    spark.udtf.register(name, udtf(Translator))


def translate(series: DataFrame, name: str) -> DataFrame:
    """All rows that the registered translator makes of the series."""
    fields = ", ".join(f"'{c}', s.`{c}`" for c in series.columns)
    return series.sparkSession.sql(f"SELECT t.* FROM {{series}} s, LATERAL {name}(named_struct({fields})) t", series=series)
