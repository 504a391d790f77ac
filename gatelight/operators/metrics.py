"""How well verdicts foretell decisions: the confusion matrix with explicitly named cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(cases: DataFrame) -> DataFrame:
    """From (flagged, rejected): cells and ratios.

    ``tp_share_of_rejected`` is sometimes reported as precision, and ``tp_share_of_flagged`` as recall;
    usual names give them the other way round.
    """
    def n(a: bool, b: bool) -> Column:
        return F.count_if((F.col("flagged") == F.lit(a)) & (F.col("rejected") == F.lit(b)))

    cells = cases.agg(n(True, True).alias("flagged_rejected"), n(False, True).alias("passed_rejected"), n(True, False).alias("flagged_approved"), n(False, False).alias("passed_approved"))
    tp, fn, fp, tn = (F.col(c) for c in ("flagged_rejected", "passed_rejected", "flagged_approved", "passed_approved"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 6))

    return cells.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "tp_share_of_rejected": ratio(tp, tp + fn), "tp_share_of_flagged": ratio(tp, tp + fp)})
