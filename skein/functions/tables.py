"""Functions that return rows, called laterally: one call a row, so a frequent key is nobody's group."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class TextWindows:
    """text_windows(text, width, step [, with_text]): overlapping windows of a text, in code points.

    (ordinal, char_start, char_end), and the window's text if asked for: the schema follows the arguments, which must be
    constants but for the text. The last window ends with the text; a null or empty text has none.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, width: AnalyzeArgument, step: AnalyzeArgument, with_text: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, argument in (("width", width), ("step", step)):
            if not argument.isConstantExpression or argument.value is None or argument.value < 1:
                raise ValueError(f"{name} must be a constant of at least 1")
        schema = T.StructType().add("ordinal", T.IntegerType()).add("char_start", T.IntegerType()).add("char_end", T.IntegerType())
        if with_text is not None and with_text.value:
            schema = schema.add("text", T.StringType())
        return AnalyzeResult(schema)

    def eval(self, text: str | None, width: int, step: int, with_text: bool = False) -> Iterator[tuple]:
        size = len(text or "")
        start = ordinal = 0
        while start < size:
            end = min(size, start + width)
            yield (ordinal, start, end, text[start:end]) if with_text else (ordinal, start, end)
            if end == size:
                return
            start, ordinal = start + step, ordinal + 1


def registered(spark: SparkSession) -> None:
    """Makes the functions known to SQL by their names."""
    spark.udtf.register("text_windows", TextWindows)
