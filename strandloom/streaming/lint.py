"""Linting of files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import lint
from strandloom.sources import files


def records(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the records of Stockholm files that come to a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrived = spark.readStream.format("binaryFile").schema(schema).load(folder)
    columns = files.names(files.RECORD)

    def run(batches):
        import pandas as pd

        from strandloom.functions import ids

        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                for r in files.stockholm_records(files.text_lines(bytes(content))):
                    own = [dict(zip(("original_id", *ids.FIELDS, "aligned_seq"), (n, *ids.parse(n), s))) for n, s in r["rows"]]
                    rows.append((file, r["record_num"], r["start_line"], r["header"], [{"tag": t, "value": v} for t, v in r["gf"]], r["gc"], own, r["unknown"], r["terminated"], r["separator"]))
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return arrived.select(F.col("path"), F.col("content")).mapInPandas(run, files.RECORD)


def findings(spark: SparkSession, folder: str, least: str = "INFO") -> DataFrame:
    """A stream of the findings on single records; it keeps no state."""
    return lint.record_rules(records(spark, folder)).where(F.col("severity_rank") >= lint.RANK[least])
