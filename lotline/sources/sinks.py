"""Sinks: panels as Parquet, bounded samples as CSV, reports as JSON and Markdown."""

from __future__ import annotations

import json
import os
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 500


def write_panel(panel: DataFrame, path: str, by: str | None = None) -> None:
    """The whole panel; partitioned by a column (as the window) if one is given."""
    writer = panel.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def panel_sample(panel: DataFrame, order: list[str], n: int = SAMPLE) -> DataFrame:
    """The first rows in a stated order."""
    return panel.orderBy(*order).limit(n)


def write_sample_csv(panel: DataFrame, path: str, order: list[str], n: int = SAMPLE) -> None:
    """One CSV file with a header in a folder; it holds at most n rows, so one task writes it."""
    panel_sample(panel, order, n).coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def plain(value):
    """JSON with decimals and times as text."""
    if isinstance(value, Decimal):
        return format(value, "f")
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def report_rows(report: DataFrame, most: int = 10_000) -> list[dict]:
    """The rows of a report; a table with more rows than a report has is refused, not cut."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return [plain(r) for r in rows]


def _write(path: str, text: str) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(path + ".part", path)
    return path


def write_report_json(path: str, **sections: DataFrame) -> str:
    """A JSON object with sorted keys; each section is the list of its rows."""
    return _write(path, json.dumps({k: report_rows(v) for k, v in sections.items()}, sort_keys=True, indent=2) + "\n")


def write_report_markdown(path: str, title: str, **sections: DataFrame) -> str:
    """A heading and a table for each section."""
    out = [f"# {title}", ""]
    for name, table in sections.items():
        out += [f"## {name.replace('_', ' ')}", "", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in (r[c] for c in table.columns)) + " |" for r in report_rows(table)] + [""]
    return _write(path, "\n".join(out))


def write_coverage_json(path: str, coverage: DataFrame) -> str:
    return write_report_json(path, coverage=coverage.select(*[F.col(c) for c in sorted(coverage.columns)]))
