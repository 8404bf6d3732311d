"""Assessment of private raises: evidence, opacity, vetoes, hurdle, verdict, network, tasks, rationale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.config import ANGEL_VERDICTS, HurdleTerms
from ebbline.functions.raises import hurdle_columns
from ebbline.functions.scalar import lookup
from ebbline.operators import evidence
from ebbline.operators.vetoes import network_columns, verdict, vetoes


def rationale() -> Column:
    wrapper = F.when(F.col("terms.tax_wrapper") == "NONE", F.lit("no relief")).otherwise(F.col("terms.tax_wrapper"))
    multiple = evidence.revenue_multiple()

    def codes(hard: bool) -> Column:
        chosen = F.filter("vetoes", lambda v: v["hard"] == F.lit(hard))
        return F.array_join(F.transform(chosen, lambda v: F.regexp_replace(v["code"], "_", " ")), "; ")

    return F.array_compact(
        F.array(
            F.concat(F.lit("With "), wrapper, F.format_string(
                ", the company must return %.2fx gross; a total loss keeps %.2fx of the money at risk.",
                "hurdle_multiple", "downside_multiple")),
            F.when(multiple.isNotNull(), F.format_string("Entry price is %.1fx trailing revenue.", multiple)).otherwise(
                "Entry price cannot be assessed from what is disclosed."),
            F.format_string("%.0f%% of scored weight is undisclosed.", F.col("opacity") * 100.0),
            F.when(F.exists("vetoes", lambda v: v["hard"]), F.concat(F.lit("Disqualifying: "), codes(True), F.lit("."))),
            F.when(F.exists("vetoes", lambda v: ~v["hard"]), F.concat(F.lit("Flagged: "), codes(False), F.lit("."))),
            F.when(F.col("verdict").startswith("ELIGIBLE"), "Passed the filter; this is not a ranking."),
        )
    )


def verdict_rank(c: str = "verdict") -> Column:
    return lookup(c, {v: i for i, v in enumerate(ANGEL_VERDICTS)})


def assess(deals: DataFrame, as_of, terms: HurdleTerms = HurdleTerms()) -> DataFrame:
    """All assessment columns of every deal, without moving a row."""
    df = evidence.with_profile(deals, as_of)
    df = df.withColumns(hurdle_columns(F.col("terms.tax_wrapper"), F.col("platform"), terms))
    df = df.withColumns({"vetoes": vetoes(F.col("opacity")), "revenue_multiple": evidence.revenue_multiple()})
    df = df.withColumns({"verdict": verdict(F.col("vetoes"), F.col("opacity")), **network_columns()})
    return df.withColumns({"task_codes": evidence.task_codes(), "rationale": rationale()})


def in_display_order(assessed: DataFrame) -> DataFrame:
    """Eligible first, then by how much is known; deal id breaks ties."""
    return assessed.orderBy(verdict_rank(), "opacity_index", "deal_id")
