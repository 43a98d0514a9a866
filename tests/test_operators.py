"""Operators on small cases whose outcomes are known."""

import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens import types as t
from ledgerlens.functions import money, names, normal, periods, text
from ledgerlens.operators import documents, facts, profile, related, retrieval, routing, scoring, taxonomy
from ledgerlens.sources import files, sinks
from ledgerlens.streaming import events


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_descriptions(spark):
    cases = {
        "Capitalised interest charge — Q4 2025": "INTEREST_EXPENSE", "Sublet rent received — February": "RENT", "Customer invoice collection — March settlement": "REVENUE", "Product launch ad campaign — Q1": "OTHER_EXPENSE",
        "Catalyst regeneration servicing contract": "OPEX", "Telecom leased line — site office": "UTILITIES", "Office rent and equipment lease combined charge": "CONFLICT", "Miscellaneous unclassified internal memo": "UNRESOLVED",
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string").withColumn("h", text.classify(F.col("d")))
    assert {r["d"]: r["h"]["category"] or r["h"]["status"] for r in df.collect()} == cases


def test_signs(spark):
    df = spark.createDataFrame([("UTILITIES", -100), ("UTILITIES", 20), ("REVENUE", 100)], "c string, a int")
    assert [int(r[0]) for r in df.select(taxonomy.metric_amount(F.col("a").cast(t.AMOUNT), F.col("c"))).collect()] == [100, -20, 100]


def test_routing(spark):
    ledger = [(1, "TXN-P1-0001", "ACC-7801"), (2, "txn-p1-0003", " acc-7801"), (3, "TXNP10005", "ACC-7801"), (4, "TXN-Q7-CAP-EXT-PHASE2-0031", "Q"), (5, "TXN-9001-0036", "ZZ"), (6, "TXN-P1-0001", "ACC-7801"), (7, "TXN-P1-0002", "ACC-7900"), (8, "TXN-P2-0002", "ACC-7900"), (9, "bad", "ACC-7900")]
    df = spark.createDataFrame([(i, x, None, acc, "c", "d", "1", "USD") for i, x, acc in ledger], t.LEDGER)
    got = {r["row_index"]: (r["scenario_id"], r["method"]) for r in routing.route(df, spark.createDataFrame([("P1",), ("P2",), ("Q7",)], "scenario_id string")).collect()}
    assert got == {1: ("P1", "TXN_ID_PREFIX"), 2: ("P1", "ACCOUNT_ID_FALLBACK"), 3: ("P1", "ACCOUNT_ID_FALLBACK"), 4: ("Q7", "TXN_ID_PREFIX"), 5: (None, "UNRESOLVED"), 7: (None, "TXN_ID_ACCOUNT_CONFLICT"), 8: (None, "TXN_ID_ACCOUNT_CONFLICT"), 9: (None, "UNRESOLVED")}


def test_related_parties(spark):
    own = spark.createDataFrame([("S", "Aktau Holdings LLP", Decimal(25)), ("S", "Aktau Holdings JSC", Decimal(40)), ("S", "Tr?de House LLP", Decimal(60))], "scenario_id string, entity_name string, percent decimal(9,4)")
    thr = spark.createDataFrame([("S", Decimal(25))], "scenario_id string, percent decimal(9,4)")
    parties = spark.createDataFrame([("S", '"Aktau Holdings" L.L.P.'), ("S", "AKTAU HOLDINGS, JSC"), ("S", "Unknown Counterparty LLP"), ("S", "Trade House LLP"), ("X", "A LLP")], "scenario_id string, counterparty string")
    got = {r["counterparty"]: (r["related_party"], r["basis"]) for r in related.resolve(parties, own, thr).collect()}
    assert got == {'"Aktau Holdings" L.L.P.': ("TRUE", "OWNERSHIP_THRESHOLD"), "AKTAU HOLDINGS, JSC": ("TRUE", "OWNERSHIP_THRESHOLD"), "Unknown Counterparty LLP": ("FALSE", "NO_IDENTITY_MATCH"), "Trade House LLP": ("UNKNOWN", "DAMAGED_OWNERSHIP_IDENTITY"), "A LLP": ("UNKNOWN", "MISSING_THRESHOLD")}
    assert rows(related.recovered(related.damaged(own, thr), parties).select("counterparty")) == [("Trade House LLP",)]
    twice = parties.unionByName(spark.createDataFrame([("S", "Tride House LLP")], parties.schema))
    assert related.recovered(related.damaged(own, thr), twice).count() == 0


def test_scores(spark):
    cells = "scenario_id string, clause_id string, status string, actual decimal(38,6), evidence_txn_id string"
    truth = [("S", str(i), "BREACH", Decimal(a), e) for i, (a, e) in enumerate([(100, "T"), (100, "T"), (100, "T"), (100, None), (0, None), (0, "T"), (100, "T")])]
    sent = [("S", str(i), s, Decimal(a), e) for i, (s, a, e) in enumerate([("BREACH", "100", "T"), ("BREACH", "102.5", "U"), ("BREACH", "105", "T"), ("BREACH", "102.5", "T"), ("BREACH", "0", None), ("BREACH", "1", "T"), ("COMPLIANT", "100", "T")])]
    got = {r["clause_id"]: round(r["score"], 6) for r in scoring.scored(spark.createDataFrame(sent, cells), spark.createDataFrame(truth, cells)).collect()}
    assert got == {"0": 1.0, "1": 0.65, "2": 0.7, "3": 0.75, "4": 1.0, "5": 0.7, "6": 0.0}


def test_rank_fusion_counts_an_id_at_its_first_position(spark):
    ranked = [("q", "a", 1, "x"), ("q", "a", 2, "x"), ("q", "a", 3, "y")]
    got = {r["id"]: r["score"] for r in retrieval.fuse(spark.createDataFrame(ranked, "query_id string, list string, position int, id string")).collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 63})


def test_recall_and_rank(spark):
    ranked = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("xabyc")], "query_id string, id string, rank int")
    relevant = spark.createDataFrame([("q", x, 1.0) for x in "abc"], "query_id string, id string, grade double")
    got = {k: retrieval.metrics(ranked, relevant, k).first() for k in (1, 2, 5)}
    assert [got[k]["recall"] for k in (1, 2, 5)] == pytest.approx([0, 1 / 3, 1]) and got[5]["mrr"] == 0.5


def test_money_is_whole_or_malformed(spark):
    df = spark.createDataFrame([("Paid $1,234.50 and EUR 10",), ("Fee $1,234.5x",), ("$1,23",), ("none",)], "s string")
    got = [(m[0], m[1]) for m in ((r[0]["values"], r[0]["malformed"]) for r in df.select(money.money_scan(F.col("s"))).collect())]
    assert [([(v["currency"], float(v["value"])) for v in a], b) for a, b in got] == [([("USD", 1234.5), ("EUR", 10.0)], False), ([], True), ([], True), ([], False)]


def test_periods():
    assert periods.parse_period("in Q2 of the year").quarter == 2
    assert periods.parse_period("as of 2025-06-30").kind == "AS_OF"
    assert periods.parse_period("from 2025-01-01 to 2025-12-31 and as of 2025-12-31").kind == "MIXED"
    assert periods.parse_period("nothing") is None


def test_chunks_cover_text():
    body = ("Sentence one. Sentence two is here.\n" * 40 + "\n") * 5
    cut = list(documents.split_ranges(body, 500, 50))
    assert cut[0][0] == 0 and cut[-1][1] == len(body) and all(b2 >= b1 >= a2 > a1 and b1 - a1 <= 500 for (a1, b1), (a2, b2) in zip(cut, cut[1:]))
    assert list(documents.split_ranges("", 10)) == [] and list(documents.split_ranges("x" * 25, 10, 2)) == [(0, 10), (8, 18), (16, 25)]
    assert documents.banner("SUPERSEDED copy", 0, 10) and not documents.banner("the superseded copy", 4, 14) and not documents.banner("This Superseded", 5, 15)


def test_facts(spark):
    page = "TXN-S1-7 was recorded as OPEX, reclassified to Capex. Aktau Trade LLP is an unrestricted subsidiary. Severance liability of $1,250.00 stands as of 2025-12-31."
    pages = spark.createDataFrame([("d", 1, "S1", page)], "document_id string, page_number int, scenario_id string, raw_text string")
    got = facts.extract(pages)
    assert {(r["fact_kind"], r["transaction_id"], r["status"], float(r["amount"] or 0)) for r in got.collect()} == {("RECLASSIFICATION", "TXN-S1-7", None, 0.0), ("SUBSIDIARY_STATUS", None, "UNRESTRICTED", 0.0), ("OFF_LEDGER_AMOUNT", None, None, 1250.0)}
    assert {r[0] for r in facts.validated(got, pages).select("reason").collect()} == {"ACCEPTED"}
    moved = got.withColumn("quote", F.lit("never said"))
    assert {r[0] for r in facts.validated(moved, pages).select("reason").collect()} == {"QUOTE_NOT_ON_PAGE"}
    ppe = "Net book value at the beginning of the year $100. Depreciation charge for the year $10. Net book value at the end of the year $150. There were no other movements: no other movements."
    assert facts.roll_forward(ppe) == (Decimal(60), "OK") and facts.roll_forward(ppe.replace("no other movements", "x"))[1] == "INCOMPLETE_PPE_ROLL_FORWARD"


def test_names_of_columns_and_files():
    assert profile.semantics("Txn ID")[0] == ("transaction_id", 0.9) and profile.semantics("zzz") == [("unknown", 0.2)]
    assert profile.answer_key({"scenarios": {"S": {"covenants": {"6.1": {"status": "BREACH", "actual": 1}}}}}) and not profile.answer_key({"scenarios": {"S": {"covenants": {"6.1": {}}}}})
    assert normal.squeezed(" a \n b ") == ("a b", [1, 4, 5])
    assert normal.repaired("Привет".encode().decode("cp1251")) == "Привет" and normal.repaired("plain") == "plain"


def test_ledger_files(spark, tmp_path):
    path = tmp_path / "ledger.csv"
    path.write_text("﻿Transaction ID;Date;Account;Vendor;Memo;Сумма;CCY\nTXN-P1-1;2025-01-01;A;V;\"a;b\";-1.5;USD\n;;;;;;\nTXN-P1-2;2025-01-02;A;V;x;2;USD\n", encoding="utf-8")
    got = [(r["row_index"], r["txn_id"], r["description"], r["amount"]) for r in files.ledger(spark, f"file://{path}").collect()]
    assert got == [(0, "TXN-P1-1", "a;b", "-1.5"), (2, "TXN-P1-2", "x", "2")]
    with pytest.raises(ValueError, match="several"):
        files.header(["txn_id", "transaction_id", "date", "account", "vendor", "amount", "ccy"])
    with pytest.raises(ValueError, match="missing"):
        files.header(["txn_id"])


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("docs/a.pdf", "docs/A.pdf", "../up.txt"):
            z.writestr(name, "x")
    got = files.inventory(spark, f"file://{tmp_path}/a.zip")
    assert {r["path"]: r["fault"] for r in got.collect()} == {"docs/a.pdf": None, "docs/A.pdf": None, "../up.txt": "UNSAFE_PATH"}
    assert [r["kind"] for r in files.archive_faults(got).collect()] == ["CASE_COLLISION"]


def test_publish_swaps_whole_outputs(spark, tmp_path):
    for n in (1, 2):
        sinks.publish({"t": spark.range(n)}, f"file://{tmp_path}/out")
        assert spark.read.parquet(f"file://{tmp_path}/out/t").count() == n
    assert sinks.content_hash(spark.range(5)) == sinks.content_hash(spark.range(5).repartition(3)) != sinks.content_hash(spark.range(6))


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime

    data = spark.createDataFrame([(i % 8, datetime(2024, 1, 1, i % 3, i), 1, "ab"[i % 2], float(i % 8), "") for i in range(8)] + [(0, datetime(2024, 1, 1, 0, 0), 1, "a", 0.0, "")], events.EVENTS)
    data.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    q = events.run(events.sums(events.arriving(spark, f"file://{tmp_path}/in")), "sums", f"file://{tmp_path}/cp", "complete")
    q.awaitTermination()
    key = lambda df: sorted((str(r[0]), r[1], r[2], float(r[3])) for r in df.collect())
    assert key(spark.table("sums")) == key(events.sums(data))


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    made, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(made) and len(made) > 60
