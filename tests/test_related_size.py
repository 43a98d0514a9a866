"""Damaged owners on larger tables."""

import random

from pyspark.sql import functions as F

from ledgerlens.functions import names
from ledgerlens.operators import related


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_damaged_names_meet_by_their_whole_words(spark):
    rng = random.Random(7)
    words, forms = ["Alfa", "Beta", "Gama", "Al?a", "B�ta", "???", "G?ma", "ALFA,", '"Beta"'], ["LLP", "JSC", "ao", "L.L.P.", "?", ""]
    made = lambda ws: " ".join(filter(None, [*rng.choices(ws, k=rng.randint(1, 3)), rng.choice(forms)]))
    owners = spark.createDataFrame(sorted({(s, n) for s in ("A", "B") for _ in range(60) if "?" in (n := made(words)) or "�" in n}), "scenario_id string, entity_name string")
    parties = spark.createDataFrame(sorted({(s, made(words)) for s in ("A", "B") for _ in range(60)}), "scenario_id string, counterparty string")
    pairs = owners.join(parties, "scenario_id").where(names.may_be(F.col("entity_name"), F.col("counterparty"))).select("scenario_id", "entity_name", "counterparty", names.identity_key(F.col("counterparty")).alias("identity")).collect()
    choices, claims = {}, {}
    for s, owner, _, identity in pairs:
        choices.setdefault((s, owner), set()).add(identity)
        claims.setdefault((s, identity), set()).add(owner)
    want = {tuple(x) for x in pairs if len(choices[x[0], x[1]]) == 1 and len(claims[x[0], x[3]]) == 1}
    assert {(r["scenario_id"], r["counterparty"]) for r in related.claimed(parties, related.keyed(owners)).collect()} == {(x[0], x[2]) for x in pairs}
    got = [tuple(r) for r in related.recovered(owners, parties).collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_a_word_that_is_damaged_whole_can_be_recovered(spark):
    owners = spark.createDataFrame([("A", "??? Gama LLP")], "scenario_id string, entity_name string")
    parties = spark.createDataFrame([("A", "Alfa Gama LLP"), ("A", "Gama LLP"), ("A", "Alfa Beta LLP")], "scenario_id string, counterparty string")
    assert [r["counterparty"] for r in related.recovered(owners, parties).collect()] == ["Alfa Gama LLP"]


def test_owners_are_not_compared_with_all_counterparties_of_a_scenario(spark):
    owners = spark.createDataFrame([("A", f"Fi?m {k} LLP") for k in range(3000)], "scenario_id string, entity_name string")
    parties = spark.createDataFrame([("A", f"Firm {k} LLP") for k in range(3000)], "scenario_id string, counterparty string")
    got = related.recovered(owners, parties)
    assert "may_be" not in plan(got) and "forall" not in plan(got)
    assert {tuple(r)[1:3] for r in got.collect()} == {(f"Fi?m {k} LLP", f"Firm {k} LLP") for k in range(3000)}
