"""What each selector of each definition finds, whether an empty one is a true zero, and which definitions are ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compile import keyed
from . import selectors as sel

#: End states of a requirement that prove its source was read whole, and reasons that disprove it.
TRUSTED = ("RESOLVED", "CONFIRMED_NONE", "ABSENT_FROM_SOURCE", "NOT_APPLICABLE")
UNTRUSTED = ("INCOMPLETE_PPE_ROLL_FORWARD", "UNRESOLVED_SOURCE_QUALITY", "OCR_REQUIRED", "PARTIAL", "OCR_FAILED", "ENCODING_CORRUPTED")
FACT_KINDS = {
    "ONE_TIME_ADD_BACKS": "ONE_TIME_ADD_BACK",
    "SEVERANCE_LIABILITY": "OFF_LEDGER_AMOUNT",
    "GROUP_CAPEX": "GROUP_CAPEX",
    "CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS": "SUBSIDIARY_STATUS",
}


def dependency() -> Column:
    """Which source a selector depends on."""
    c = F.col("category")
    return (
        F.when(F.col("related_only") | (c == "RELATED_PARTY_PAYMENTS"), "RELATED_PARTY_IDENTITY")
        .when((c == "GROUP_CAPEX") | F.col("group_level"), "GROUP_SOURCE")
        .when(c == "CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS", "SUBSIDIARY_STATUS")
        .when(c == "ONE_TIME_ADD_BACKS", "FACT_AUGMENTED")
        .when(c == "SEVERANCE_LIABILITY", "FACT_ONLY")
        .otherwise("LEDGER_ONLY")
    )


def complete_sources(requirements: DataFrame) -> DataFrame:
    """(scenario_id, fact_kind, complete): every requirement of the kind ended in a trusted state."""
    good = F.col("state").isin(*TRUSTED) & ~((F.col("state") == "ABSENT_FROM_SOURCE") & F.coalesce(F.col("reason").isin(*UNTRUSTED), F.lit(False)))
    return requirements.groupBy("scenario_id", "fact_kind").agg(F.bool_and(good).alias("complete"))


def coverage(slots: DataFrame, inputs: DataFrame, requirements: DataFrame | None = None) -> DataFrame:
    """status (READY, TRUE_ZERO, UNRESOLVED), reason and matching inputs of every slot."""
    s = slots.select("definition_id", "scenario_id", "slot", "category", "include_flags", "exclude_flags", "related_only", "group_level")
    # an input meets the selectors of its own categories; unknown parties are counted per scenario
    wanted = keyed(inputs).withColumnRenamed("scenario_id", "i_scenario").join(
        s.select("definition_id", "slot", F.col("scenario_id").alias("s_scenario"), F.col("category").alias("wanted"), "related_only", "group_level"),
        (F.col("i_scenario") == F.col("s_scenario")) & (F.col("key") == F.col("wanted")),
    )
    hit = sel.matches(F.col("wanted"), F.col("related_only"), F.col("group_level"), F.array().cast("array<string>"), F.array().cast("array<string>"))
    found = wanted.where(hit).groupBy("definition_id", "slot").agg(F.count("*").alias("n"))
    doubt = inputs.where(F.col("related_party") == "UNKNOWN").groupBy("scenario_id").agg(F.count("*").alias("unknown"))
    out = s.join(found, ["definition_id", "slot"], "left").join(doubt, "scenario_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "unknown": F.coalesce("unknown", F.lit(0)), "source": dependency()})
    kind = F.coalesce(*[F.when(F.col("category") == c, F.lit(k)) for c, k in FACT_KINDS.items()])
    out = out.withColumn("fact_kind", kind)
    if requirements is None:
        out = out.withColumn("complete", F.lit(False))
    else:
        out = out.join(complete_sources(requirements), ["scenario_id", "fact_kind"], "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    by_fact = F.col("source").isin("FACT_ONLY", "FACT_AUGMENTED", "GROUP_SOURCE", "SUBSIDIARY_STATUS")
    reason = (
        F.when(F.col("n") > 0, "OK")
        .when((F.col("source") == "RELATED_PARTY_IDENTITY") & (F.col("unknown") > 0), "RELATED_PARTY_IDENTITY_UNKNOWN")
        .when(by_fact & ~F.col("complete"), "UNRESOLVED_SOURCE_QUALITY")
        .when(F.col("category") == "GROUP_CAPEX", "NO_GROUP_CAPEX_INPUTS")
        .when(F.col("category") == "CAPITAL_ASSET_TRANSFERS_TO_UNRESTRICTED_SUBS", "NO_UNRESTRICTED_TRANSFER_INPUTS")
        .otherwise("NO_MATCHING_INPUTS")
    )
    status = F.when(F.col("reason_code") == "OK", "READY").when(F.col("reason_code").startswith("NO_"), "TRUE_ZERO").otherwise("UNRESOLVED")
    return out.withColumn("reason_code", reason).select("definition_id", "scenario_id", "slot", "category", "source", status.alias("status"), "reason_code", F.col("n").alias("matching_input_count"))


def readiness(covered: DataFrame) -> DataFrame:
    """Definitions with any unresolved selector are UNRESOLVED and list category:reason."""
    bad = F.when(F.col("status") == "UNRESOLVED", F.concat_ws(":", "category", "reason_code"))
    per = covered.groupBy("definition_id", "scenario_id").agg(F.array_join(F.sort_array(F.collect_set(bad)), ",").alias("unresolved"))
    return per.select("definition_id", "scenario_id", F.when(F.col("unresolved") == "", "READY").otherwise("UNRESOLVED").alias("status"), F.when(F.col("unresolved") == "", "OK").otherwise("UNRESOLVED_INPUT").alias("reason_code"), "unresolved")


def invalid(inputs: DataFrame, definitions: DataFrame) -> DataFrame:
    """What is wrong with the universe as a whole: (kind, subject): repeated input ids, inputs of scenarios without definitions, definitions without inputs."""
    twice = inputs.groupBy("input_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("DUPLICATE_INPUT_ID").alias("kind"), F.col("input_id").alias("subject"))
    d, i = definitions.select("scenario_id").distinct(), inputs.select("scenario_id").distinct()
    stray = i.join(d, "scenario_id", "left_anti").select(F.lit("SCENARIO_WITHOUT_DEFINITION").alias("kind"), F.col("scenario_id").alias("subject"))
    empty = d.join(i, "scenario_id", "left_anti").select(F.lit("DEFINITION_WITHOUT_INPUTS").alias("kind"), F.col("scenario_id").alias("subject"))
    return twice.unionByName(stray).unionByName(empty)


def only_period(definitions: DataFrame) -> DataFrame:
    """(scenario_id, category) -> the flow period and as-of date that all definitions agree on, or NULL."""
    per = definitions.groupBy("scenario_id", "category").agg(
        F.count_distinct(F.struct("start", "end")).alias("n"), F.min(F.struct("start", "end")).alias("p"), F.count_distinct("as_of").alias("m"), F.min("as_of").alias("as_of")
    )
    return per.select("scenario_id", "category", F.when(F.col("n") == 1, F.col("p.start")).alias("start"), F.when(F.col("n") == 1, F.col("p.end")).alias("end"), F.when(F.col("m") == 1, F.col("as_of")).alias("as_of"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
