"""Related parties: owners at or above a scenario's threshold, matched to counterparties by exact identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names


def threshold(thresholds: DataFrame) -> DataFrame:
    """(scenario_id, threshold) where a scenario's facts name exactly one value."""
    per = thresholds.groupBy("scenario_id").agg(F.count_distinct("percent").alias("n"), F.min("percent").alias("threshold"))
    return per.where("n = 1").select("scenario_id", "threshold")


def owners(ownership: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Ownership rows at or above the threshold, with identity and whether the name is damaged."""
    rows = ownership.join(threshold(thresholds), "scenario_id").where(F.col("percent") >= F.col("threshold"))
    return rows.select("scenario_id", "entity_name", names.identity_key(F.col("entity_name")).alias("identity"), "percent", "threshold", names.damaged(F.col("entity_name")).alias("damaged"))


def qualifying(ownership: DataFrame, thresholds: DataFrame) -> DataFrame:
    return owners(ownership, thresholds).where(~F.col("damaged"))


def damaged(ownership: DataFrame, thresholds: DataFrame) -> DataFrame:
    return owners(ownership, thresholds).where("damaged")


def keyed(damaged_owners: DataFrame) -> DataFrame:
    """Damaged owners (scenario_id, entity_name) that end in a legal form, with size, places and key of names.open_key()."""
    rows = damaged_owners.select("scenario_id", "entity_name", names.tokens(names.masked(F.col("entity_name"))).alias("words"), names.hidden_places(F.col("entity_name")).alias("places"))
    rows = rows.where(names.is_form(F.try_element_at("words", F.lit(-1))))
    return rows.select("scenario_id", "entity_name", F.size("words").alias("size"), "places", names.open_key(F.col("words"), F.col("places")).alias("key"))


def claimed(parties: DataFrame, owners_keyed: DataFrame) -> DataFrame:
    """scenario_id, counterparty, identity, key of every key that a damaged owner has and a counterparty fits.

    A counterparty makes one key for each way in which owners of its scenario are damaged, and keys meet by equality: no owner is
    compared with a counterparty that it can't be, and owners of one key count once.
    """
    ways = owners_keyed.select("scenario_id", "size", "places").distinct()
    p = parties.select("scenario_id", "counterparty").distinct().withColumn("words", names.tokens(F.col("counterparty"))).where(names.is_form(F.try_element_at("words", F.lit(-1))))
    made = p.withColumn("size", F.size("words")).join(ways, ["scenario_id", "size"])
    made = made.select("scenario_id", "counterparty", F.array_join("words", " ").alias("identity"), names.open_key(F.col("words"), F.col("places")).alias("key"))
    return made.join(owners_keyed.select("scenario_id", "key").distinct(), ["scenario_id", "key"], "left_semi").select("scenario_id", "counterparty", "identity", "key")


def recovered(damaged_owners: DataFrame, parties: DataFrame) -> DataFrame:
    """Damaged owners that are certain: exactly one counterparty may be the owner and the owner only may be it."""
    d = keyed(damaged_owners)
    hits = claimed(parties, d)
    sharing = d.groupBy("scenario_id", "key").agg(F.count_distinct("entity_name").alias("owners"))
    choices = hits.groupBy("scenario_id", "key").agg(F.count_distinct("identity").alias("choices"))
    sole = sharing.join(choices, ["scenario_id", "key"]).where("owners = 1 and choices = 1").select("scenario_id", "key")
    # an identity that fits one key, which one owner has, is claimed once
    claims = hits.groupBy("scenario_id", "identity").agg(F.count_distinct("key").alias("claims")).where("claims = 1").select("scenario_id", "identity")
    found = hits.join(sole, ["scenario_id", "key"]).join(claims, ["scenario_id", "identity"], "left_semi")
    return found.join(d.select("scenario_id", "key", "entity_name"), ["scenario_id", "key"]).select("scenario_id", "entity_name", "counterparty", "identity")


def resolve(parties: DataFrame, ownership: DataFrame, thresholds: DataFrame) -> DataFrame:
    """related_party (TRUE, FALSE, UNKNOWN) and basis of each (scenario_id, counterparty).

    In this order: no scenario, no threshold, no ownership facts, several owners of one identity
    under different names, exactly one owner, a damaged owner that may be it, none.
    """
    p = parties.select("scenario_id", "counterparty").distinct().withColumn("identity", names.identity_key(F.col("counterparty")))
    match = qualifying(ownership, thresholds).groupBy("scenario_id", "identity").agg(F.count("*").alias("rows"), F.count_distinct("entity_name").alias("named"))
    # a damaged name keeps all words but the damaged ones, so names meet by those and not by scenario alone
    possible = claimed(p, keyed(damaged(ownership, thresholds))).select("scenario_id", "counterparty").distinct().withColumn("unclear", F.lit(True))
    out = (
        p.join(threshold(thresholds), "scenario_id", "left")
        .join(ownership.select("scenario_id").distinct().withColumn("owned", F.lit(True)), "scenario_id", "left")
        .join(match, ["scenario_id", "identity"], "left")
        .join(possible, ["scenario_id", "counterparty"], "left")
    )
    basis = (
        F.when(F.col("scenario_id").isNull(), "ROUTING_NOISE")
        .when(F.col("threshold").isNull(), "MISSING_THRESHOLD")
        .when(F.col("owned").isNull(), "MISSING_OWNERSHIP")
        .when(F.col("named") > 1, "AMBIGUOUS_IDENTITY")
        .when(F.col("rows") == 1, "OWNERSHIP_THRESHOLD")
        .when(F.col("unclear"), "DAMAGED_OWNERSHIP_IDENTITY")
        .otherwise("NO_IDENTITY_MATCH")
    )
    state = F.when(F.col("basis") == "OWNERSHIP_THRESHOLD", "TRUE").when(F.col("basis") == "NO_IDENTITY_MATCH", "FALSE").otherwise("UNKNOWN")
    return out.withColumn("basis", basis).select("scenario_id", "counterparty", state.alias("related_party"), "basis")


def subsidiaries(parties: DataFrame, facts: DataFrame) -> DataFrame:
    """subsidiary_status of each (scenario_id, counterparty) by exact identity; several statuses are a CONFLICT."""
    p = parties.select("scenario_id", "counterparty").distinct().withColumn("identity", names.identity_key(F.col("counterparty")))
    s = facts.select("scenario_id", names.identity_key(F.col("entity_name")).alias("identity"), "status").groupBy("scenario_id", "identity").agg(F.count_distinct("status").alias("n"), F.min("status").alias("status"))
    state = F.when(F.col("n").isNull(), "UNKNOWN").when(F.col("n") > 1, "CONFLICT").otherwise(F.col("status"))
    return p.join(s, ["scenario_id", "identity"], "left").select("scenario_id", "counterparty", state.alias("subsidiary_status"))
