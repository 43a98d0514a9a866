"""The pipeline's stages, one after another, against brute force on a small corpus."""

import random

import corpus_pipeline
from ledgerlens.llm import decontaminate, quality
from tests.llm.test_texts import jaccard, prose


def test_stages(spark, tmp_path):
    rng = random.Random(20)
    item = f"{prose(rng, 25)}. {prose(rng, 14)}."
    docs = []
    for i in range(160):
        text = prose(rng, 60)
        if i % 8 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 8 == 1 and len(docs) > 2:
            text = docs[-3][1] if i % 16 == 1 else docs[-3][1] + " " + prose(rng, 1)
        elif i % 20 == 7:
            text = f"{text} {item}"
        docs.append((i, text, ["en", None][i % 9 == 0], "abc"[i % 3], len(text)))
    docs += [(500, None, "en", "a", None), (501, "", None, None, 0), (None, prose(rng, 50), "en", "b", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/sf/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/sf/benchmark.parquet")
    sf, seen = f"file://{tmp_path}/sf", [df]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, seen[-1], sf).write.parquet(path)
        seen.append(spark.read.parquet(path))
    rows = [[tuple(r) for r in x.collect()] for x in seen]
    assert all(x.columns == df.columns for x in seen[:5])

    model = quality.train(df, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(df, model).where("predicted = 1").collect()}
    assert {r[0] for r in rows[1]} == good and len([i for i in good if i is not None and i < 160 and i % 8 == 0]) == 0

    _, low = jaccard([(r[0], r[1]) for r in rows[1] if r[0] is not None])
    assert {r[0] for r in rows[2]} == {i for i, x in low.items() if i == x} | {r[0] for r in rows[1] if r[0] is None} and len(rows[2]) < len(rows[1])

    index = decontaminate.Index([(1, item)])
    assert sorted(map(str, rows[3])) == sorted(str(r) for r in rows[2] if not index.leaks(r[1])) and len(rows[3]) < len(rows[2])

    size = lambda r: len((r[1] or "").split())
    total = sum(map(size, rows[3]))
    assert {r[0] for r in rows[4]} <= {r[0] for r in rows[3]} and abs(sum(map(size, rows[4])) - total) <= 60 * 4
    assert sum(rows[4].count(r) for r in set(rows[4])) == len(rows[4]) and max(rows[4].count(r) for r in set(rows[4])) <= 3

    by = {}
    for r in seen[5].collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, by.values())) == len(rows[4]) and all(sorted(v) == list(range(len(v))) for v in by.values())
