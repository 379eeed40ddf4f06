"""Export of series as CSV files in a zip archive, with a summary of its contents."""

from __future__ import annotations

import io
import re
import warnings
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def export_text(df: DataFrame) -> DataFrame:
    """``df`` with its value as text of eight decimals; a null stays null."""
    return df.withColumn("value", F.when(F.col("value").isNotNull(), F.format_string("%.8f", F.col("value"))))


def summary(df: DataFrame, keys: Sequence[str], prefix: str = "export_serie") -> DataFrame:
    """``(number, filename, keys...)`` of the distinct series, numbered in key order. It is a listing of one zip file."""
    series = df.select(*keys).distinct()
    number = (F.row_number().over(Window.orderBy(*keys)) - 1).cast("int")
    return series.select(number.alias("number"), F.concat(F.lit(f"{prefix}_"), number.cast("string"), F.lit(".csv")).alias("filename"), *keys)


def write_csv(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """The distributed sink: a CSV directory for each series."""
    export_text(df).write.partitionBy(*keys).option("sep", ";").option("header", True).mode("overwrite").csv(path)


def zip_bytes(df: DataFrame, keys: Sequence[str], most_rows: int = 5_000_000) -> bytes:
    """A zip file of a selection that fits the driver: one CSV for each series and ``content_summary.csv``."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows; use write_csv")
    listing = summary(df, keys).orderBy("number").collect()  # no more series than rows
    if not listing:
        warnings.warn("nothing was selected", stacklevel=2)
    out = io.BytesIO()
    names = {tuple(r[k] for k in keys): r["filename"] for r in listing}
    texts: dict[tuple, list[str]] = {k: [";value"] for k in names}
    for row in export_text(df).orderBy(*keys, "ts").toLocalIterator():
        texts[tuple(row[k] for k in keys)].append(f"{row['ts']};{row['value'] or ''}")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for key, lines in texts.items():
            archive.writestr(re.sub(r"[\\/]", "_", names[key]), "\n".join(lines) + "\n")
        head = ";".join(["", "filename", *keys])
        body = [";".join(map(str, [r["number"], r["filename"], *(r[k] for k in keys)])) for r in listing]
        archive.writestr("content_summary.csv", "\n".join([head, *body]) + "\n")
    return out.getvalue()
