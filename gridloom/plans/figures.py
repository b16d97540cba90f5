"""The plotted numbers of the two figures as tables, behind the gates that a drawing would have. Drawing itself is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.errors import GateError
from gridloom.functions import scalar as S
from gridloom.functions.claims import BANNED_NAMES, require_clean
from gridloom.operators.facilities import HEADLINE, refuse_names
from gridloom.plans.laws import P_DEFINITION

# The line that no site clears, and the texts under the figures.
SCREEN, DIGITS = 0.5, 3
SCORES_NOTE = f"{P_DEFINITION} is map-completion, not a 1-percent annual-chance product."
SCREEN_NOTE = "Rank is p_max. Inventory pounds are not the lead."


def scores_figure(spark: SparkSession, ap: float, ap_hand: float, prevalence: float) -> tuple[DataFrame, str]:
    """(ordinal, label, value, shown) of three bars, and the title."""
    title = f"Stage C PR-AUC {ap:.3f} beats HAND {ap_hand:.3f} (prevalence {prevalence:.3f}). Modest. Not a FIRM."
    for text, what in ((title, "title"), (SCORES_NOTE, "footer")):
        require_clean(text, what, BANNED_NAMES)
    rows = spark.createDataFrame([(0, "Stage C", float(ap)), (1, "HAND", float(ap_hand)), (2, "prevalence", float(prevalence))], "ordinal int, label string, value double")
    return rows.withColumn("shown", F.format_string(f"%.{DIGITS}f", "value")), title


def screen_figure(top: DataFrame, aliases: dict[str, str], refused_first: str | None = None, screen: float = SCREEN) -> DataFrame:
    """ordinal, label, p_max, p_mean of the five headline rows (ordinal, name, p_max, p_mean), none of which may reach the screen."""
    require_clean(SCREEN_NOTE, "footer")
    n = top.agg(F.count("*").alias("n"), F.max("p_max").alias("most")).first()
    if n.n != HEADLINE:
        raise GateError(f"the figure needs {HEADLINE} rows")
    if n.most is None or n.most >= screen:
        raise GateError("a site clears the screen")
    rows = refuse_names(top, BANNED_NAMES).select("ordinal", S.short_name(F.col("name"), aliases).alias("label"), "p_max", "p_mean")
    if refused_first is not None and rows.orderBy("ordinal").first().label == refused_first:
        raise GateError(f"{refused_first} does not lead")
    return rows
