"""Where results go: answers, reports, records that could not be served, JPEG by a provider."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.operators.receipts import receipt_json


def write_answers(results: DataFrame, path: str) -> None:
    """One JSON answer a line, by reference id; image quality comes last where there is some."""
    answer = receipt_json()
    if "image_quality" in results.columns:
        answer = F.concat(F.substring(answer, 1, F.length(answer) - 1), F.lit(',"image_quality":'), F.coalesce(F.to_json("image_quality", {"ignoreNullFields": "false"}), F.lit("null")), F.lit("}"))
    results.select("ref", answer.alias("answer")).write.json(path)


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """An evaluation: its rows and its roll-up, each as JSON lines."""
    rows.write.json(f"{path}/rows")
    summary.coalesce(1).write.json(f"{path}/summary")  # one row for each variant


def write_dead_letters(rejected: DataFrame, path: str) -> None:
    """Requests that could not be served, with what was wrong and the status it maps to."""
    from sheafline.operators.routing import status_of

    rejected.withColumn("status", status_of(F.lit("invalid_request"))).write.json(path)
