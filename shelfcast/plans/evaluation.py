"""Evaluate a forecaster on the whole panel, section by section."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import clean_panel, drop_unscored
from ..functions.numeric import month_key
from ..operators.metrics import (
    accuracy_of,
    assessment,
    category_section,
    drift,
    error_columns,
    error_distribution,
    error_percentiles,
    metrics_in_one_pass,
    month_section,
    store_section,
    within_tolerance,
)
from ..functions.rules import quality_grade
from ..schema import DATE
from ..sources.artifacts import save_evaluation
from ..sources.panel import write_eval_detail
from .recommend import scored_history


# What the sections of a report group by.
SECTIONS = {"overall": (), "by_store": ("store_id",), "by_category": ("category",), "by_month": ("period",)}


def report_metrics(scored: DataFrame, names: Sequence[str] = tuple(SECTIONS)) -> DataFrame:
    """Metrics of the named sections, all from one pass over the scored rows."""
    dated = scored.withColumn("period", month_key(DATE)) if "by_month" in names else scored
    return metrics_in_one_pass(dated, {name: SECTIONS[name] for name in names})


def section(passed: DataFrame, name: str) -> DataFrame:
    """One section of :func:`report_metrics`."""
    others = {key for by in SECTIONS.values() for key in by} - set(SECTIONS[name])
    return passed.filter(F.col("section") == name).drop("section", *others)


def evaluation_sections(scored: DataFrame, saved: DataFrame | None = None) -> dict[str, DataFrame]:
    """All sections from rows with ``actual`` and ``predicted``.

    The accuracy of all rows, of stores, categories and months comes from one
    pass. A table without rows has no overall section either.
    """
    passed = report_metrics(scored)
    overall = assessment(section(passed, "overall")).withColumns(
        {
            "accuracy": 100.0 - F.col("mape"),
            "grade": quality_grade(100.0 - F.col("mape")),
        }
    )
    sections = {
        "overall": overall,
        "by_store": store_section(accuracy_of(section(passed, "by_store"), ["store_id"])),
        "by_category": category_section(accuracy_of(section(passed, "by_category"), ["category"])),
        "by_month": month_section(accuracy_of(section(passed, "by_month"), ["period"])),
        "error_distribution": error_distribution(scored),
        "error_percentiles": error_percentiles(scored),
        "within_tolerance": within_tolerance(scored),
    }
    if saved is not None:
        sections["drift"] = drift(overall, saved)
    return sections


def evaluation_report(
    panel: DataFrame,
    forecaster,
    saved: DataFrame | None = None,
    path: str | None = None,
    run_id: str | None = None,
    detail_fmt: str = "csv",
) -> dict[str, DataFrame]:
    """Score, evaluate and, with ``path``, save the sections and the row detail."""
    scored = drop_unscored(scored_history(clean_panel(panel), forecaster))
    if path is None:
        return {**evaluation_sections(scored, saved), "detail": error_columns(scored)}
    if run_id is None:
        raise ValueError("saving an evaluation needs a run id")
    # Eight writes read the same scored rows.
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sections = evaluation_sections(scored, saved)
        detail = error_columns(scored)
        save_evaluation(sections, path, run_id)
        write_eval_detail(detail, f"{path}/run_id={run_id}/detail", detail_fmt)
    finally:
        scored.unpersist()
    return {**sections, "detail": detail}
