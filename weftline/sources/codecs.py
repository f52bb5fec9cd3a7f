"""Results as JSON, CSV and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def result_json(df: DataFrame, pretty: bool = False) -> Column:
    """A row as JSON text; null fields are left out."""
    return F.to_json(F.struct(*df.columns), {"pretty": "true"} if pretty else {})


def flattened(df: DataFrame, sep: str = ".") -> DataFrame:
    """Structs as columns a.b, arrays and maps as JSON text: what CSV can hold."""

    def columns(schema: T.StructType, path: tuple = ()):
        for f in schema:
            here = (*path, f.name)
            at = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, T.StructType):
                yield from columns(f.dataType, here)
            else:
                yield (F.to_json(at) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else at).alias(sep.join(here))

    return df.select(*columns(df.schema))


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180: quotes are doubled, cells with commas, quotes or line ends are quoted."""
    flattened(df).write.option("header", "true").option("escape", '"').option("lineSep", "\r\n").csv(path)


def csv_line(columns: list[Column]) -> Column:
    quoted = [F.when(F.regexp_like(c, F.lit('[,"\r\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in (F.coalesce(c.cast("string"), F.lit("")) for c in columns)]
    return F.concat_ws(",", *quoted)


def table_row(columns: list[Column]) -> Column:
    """A row of a GitHub-flavoured Markdown table."""
    cells = [F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s*[\r\n]+\s*", " "), F.lit("|"), F.lit(r"\|")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def table_head(names: list[str]) -> str:
    return "| " + " | ".join(names) + " |\n|" + " --- |" * len(names)
