"""Registered queries do the whole job: small tables against brute force."""

import math
import re
from collections import Counter

import numpy as np

from ledgerlens.operators import retrieval
from ledgerlens.queries import QUERIES
from ledgerlens.sources import tables as src

WORDS = "bank loan rate asset cash debt the of lease rent tax fee bond note swap fund gain loss".split()


def write(spark, folder, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")


def words(text):
    return [x for x in re.split(r"[^\w-]+", text.lower()) if x]


def bm25(docs, text):
    """{doc: score} and the docs that hold all terms."""
    tf = {i: Counter(words(t)) for i, t in docs}
    size = {i: sum(c.values()) for i, c in tf.items()}
    mean = sum(size.values()) / len(size)
    asked = set(words(text)) - set(retrieval.STOP)
    score, whole = Counter(), {i for i in tf if all(tf[i][w] for w in asked)}
    for w in asked:
        df = sum(w in c for c in tf.values())
        for i, c in tf.items():
            if c[w]:
                score[i] += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[i] / mean))
    return score, whole


def best(score, k):
    return sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]


def cosines(x, q):
    return {i: float(v @ q / math.sqrt((v @ v) * (q @ q))) for i, v in enumerate(x)}


def test_searches_ask_whole_texts_of_every_fiftieth_row(spark, tmp_path):
    rng, d = np.random.default_rng(5), f"file://{tmp_path}"
    text = lambda n: " ".join(rng.choice(WORDS, n))
    docs = [(i, text(int(rng.integers(5, 30)))) for i in range(60)]
    items = [(i, text(9)) for i in (0, 1, 19, 50, 51, 100)]
    docs += [(60 + k, items[k][1] + " " + text(5)) for k in (0, 3, 5)]
    x = np.float32(rng.normal(size=(120, 8)))
    write(spark, d, "documents", docs, "doc_id long, text string")
    write(spark, d, "benchmark", items, "item_id long, text string")
    write(spark, d, "embeddings", [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    either, every, both = {}, {}, {}
    for i, t in items:
        if i % 50 == 0:
            score, whole = bm25(docs, t)
            either |= {(i, j): score[j] for j in best(score, 10)}
            every |= {(i, j): score[j] for j in best({j: score[j] for j in whole}, 10)}
            near, fused = cosines(x.astype(float), x[i].astype(float)), Counter()
            for ranked in (best(score, 50), sorted(near, key=lambda j: (-near[j], j))[:50]):
                for place, j in enumerate(ranked):
                    fused[j] += 1 / (61 + place)
            both |= {(i, j): fused[j] for j in best(fused, 10)}
    assert every and {i for i, _ in either} == {0, 50, 100}
    for name, want in (("h2_bm25_or", either), ("h3_bm25_and", every), ("r12_hybrid", both)):
        got = {(r["query_id"], r["id"]): r["score"] for r in QUERIES[name](spark, d).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_every_fiftieth_vector_is_asked_in_blocks(spark, tmp_path):
    rng, d = np.random.default_rng(6), f"file://{tmp_path}"
    x = np.float32(rng.normal(size=(230, 8)))
    x[60:75] = x[50]  # ties go by id
    write(spark, d, "embeddings", [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    brute = {}
    for i in range(len(x)):
        c = {j: round(s, 6) for j, s in cosines(x.astype(float), x[i].astype(float)).items()}
        brute[i] = [(j, c[j]) for j in sorted(c, key=lambda j: (-c[j], j))[:5]]
    told = lambda df: {i: [(r["id"], r["score"]) for r in sorted((r for r in df if r["query_id"] == i), key=lambda r: r["rank"])] for i in {r["query_id"] for r in df}}
    assert told(QUERIES["h1_h4_h5_cosine"](spark, d).collect()) == {i: brute[i] for i in (0, 50, 100, 150, 200)}
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    assert told(retrieval.nearest(e, e.toDF("query_id", "query_vector"), 5, digits=6, block=40).collect()) == brute


def test_odd_vectors_score_nothing(spark):
    v = [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [0.0, 0.0]), (5, [1.0]), (6, [-1.0, 0.0]), (7, [float("nan"), 1.0])]
    got = retrieval.nearest(spark.createDataFrame(v, "id long, vector array<float>"), spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, query_vector array<float>"), 9).collect()
    assert [(r["id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1.0), (2, 0.0), (3, 0.0), (4, 0.0), (6, -1.0), (5, None), (7, None)]


SMALL = "/root/testdata/sf0.001"


def test_every_order_is_scanned_and_extracted_from(spark):
    orders = {r[0] for r in src.read(spark, SMALL, "orders").select("o_orderkey").collect()}
    assert {int(r["document_id"]) for r in QUERIES["n26_n38_facts"](spark, SMALL).collect()} == orders
    known = {r[0].strip() for r in src.ledger(spark, SMALL).select("txn_id").collect()}
    told = {(k, x) for k in orders for x in (f"TXN-N1-{k}-1", f"TXN-N2-{k}-2", f"TXN-N3-{k}") if x in known}
    assert {(r["o_orderkey"], r["txn_id"]) for r in QUERIES["s19_s20_s21_txn_spans"](spark, SMALL).collect()} == told


def test_whole_lists_are_fused(spark):
    e = src.read(spark, SMALL, "events").select("event_type", "user_id", "value", "ts", "event_id").collect()
    want = Counter()
    for kind in {r["event_type"] for r in e}:
        for order in (lambda r: (-r["value"], r["event_id"]), lambda r: (r["ts"], r["event_id"])):
            first = {}
            for place, r in enumerate(sorted((r for r in e if r["event_type"] == kind), key=order)):
                first.setdefault(r["user_id"], place + 1)
            for user, place in first.items():
                want[kind, user] += 1 / (60 + place)
    got = {(r["query_id"], r["id"]): r["score"] for r in QUERIES["w1_w2_rrf"](spark, SMALL).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_facts_come_from_all_rows(spark):
    lines = src.read(spark, SMALL, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").collect()
    ids = lambda name: {r["fact_id"] for r in QUERIES[name](spark, SMALL).select("fact_id").collect()}
    assert ids("c4_add_backs") == {f"AB-{r[0]}-{r[1]}-{r[2]}" for r in lines}
    ledger = src.ledger(spark, SMALL).select("row_index", "txn_id").collect()
    first = {}
    for row, txn in sorted((r["row_index"], r["txn_id"].strip()) for r in ledger):
        first.setdefault(txn, row)
    named = {f"F{x}" for x in first.values()}
    doubled = {f"F{x}b" for x in first.values() if x % 4 == 0 and x % 10 == 0}
    assert ids("c2_fact_links") == named | doubled
    pairs = {x for r in QUERIES["f13_f14_fact_conflicts"](spark, SMALL).collect() for x in r["fact_ids"].split(",")}
    assert doubled and pairs >= doubled
    assert ids("c3_reclass_targets") <= {f"R{r[0]}" for r in lines} and len(ids("c3_reclass_targets")) > len({r[0] for r in lines if r[0] % 31 == 0})
