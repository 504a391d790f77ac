"""Tasks from findings: one each, numbered by severity, with exports and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .policy import rank

PRIORITY = {"Blocker": "p1", "High": "p2", "Medium": "p3"}


def tasks(findings: DataFrame) -> DataFrame:
    """One task a failed finding of (site, id, severity, title, evidence, files, steps, criteria, effort_hours).

    Within a severity the least effort comes first, then the id.
    """
    own = findings.where("verdict = 'Fail'")
    order = Window.partitionBy("site", "severity").orderBy(F.col("effort_hours").asc_nulls_last(), "id", "evidence")
    no = F.row_number().over(order)
    seq = F.concat(F.upper("severity"), F.lit("-"), F.when(no < 10, F.concat(F.lit("0"), no.cast("string"))).otherwise(no.cast("string")))
    priority = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("severity"))
    return own.select("site", rank(F.col("severity")).alias("rank"), seq.alias("seq"), "id", "severity", priority.alias("priority"), "title", "evidence", "files", "steps", "criteria", "effort_hours")


def summary(found: DataFrame) -> DataFrame:
    """site, severity (TOTAL for all), tasks, files and hours."""
    by = found.rollup("site", "severity").agg(F.count("*").alias("tasks"), F.sum(F.size("files")).alias("files"), F.sum("effort_hours").alias("hours"), F.grouping_id().alias("g"))
    return by.where("g < 3").select("site", F.coalesce("severity", F.lit("TOTAL")).alias("severity"), "tasks", "files", "hours")


def todo_lines(found: DataFrame) -> DataFrame:
    head = F.format_string("[%s] %s: %s (%s, %sh, @%s)", "site", "seq", "title", "priority", F.col("effort_hours").cast("string"), F.lower("severity"))
    rest = F.concat(F.lit("\n- needs: "), "id", F.lit("\n- seen: "), "evidence", F.lit("\n- do: "), F.array_join("steps", "; "), F.lit("\n- done when: "), F.array_join("criteria", "; "))
    return found.select("site", "rank", "seq", F.concat(head, rest).alias("line"))


def issue_texts(found: DataFrame) -> DataFrame:
    steps = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("- [ ] "), s)), "\n")
    body = F.concat(F.lit("## "), F.format_string("[%s] %s: %s", "site", "seq", "title"), F.lit("\n\nRequirement: "), "id", F.lit("\n\nEvidence: "), "evidence", F.lit("\n\nSteps:\n"), steps, F.lit("\n\nLabels: "), F.lower("severity"), F.lit(", "), "site")
    return found.select("site", "rank", "seq", body.alias("issue"))
