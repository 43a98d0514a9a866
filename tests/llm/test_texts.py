"""Quality, decontamination, token store, n-gram join, embeddings and line dedup against brute force."""

import random
import zlib

import numpy as np
import pytest

from ledgerlens.llm import decontaminate, embed_dedup, line_dedup, ngram_join, quality, token_store

DOCS = "doc_id long, text string, source string, class_id string"
WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t l m nd st ng x".split()]


def rows(df):
    return [r.asDict() for r in df.collect()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(1)
    docs = [(i, prose(rng, 60) + "." if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "s", "") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([*docs, (1000, None, "s", ""), (1001, "", "s", ""), (None, "a", "s", "")], DOCS)
    model = quality.train(df, labels)
    got = {r["doc_id"]: r for r in rows(quality.score(df, model))}
    held = [r for k, r in got.items() if k is not None and r["held_out"] and k < 300]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values()) and got[1000]["score"] == got[1001]["score"]
    assert quality.keep_good(df, model).columns == df.columns
    none = quality.train(df, labels.where("quality = 5"))
    assert {r["score"] >= 0.5 for r in rows(quality.score(df, none))} == {True}


def test_quality_trees_walk_like_plain_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = quality.fit(x, y, trees=30)
    b = m.bins(x)
    for i in range(20):
        total = m.base
        for at in m.roots:
            while m.feature[at] >= 0:
                at = m.left[at] if b[i, m.feature[at]] <= m.cut[at] else m.right[at]
            total += m.value[at]
        assert m.score(x[i : i + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((m.score(x) >= 0.5) == (y == 1)).mean() > 0.9


def test_block_max_wand_finds_what_a_full_scan_finds():
    rng = random.Random(2)
    index = decontaminate.Index([(i, prose(rng, rng.randrange(5, 60))) for i in range(300)])
    for _ in range(60):
        terms = {rng.randrange(len(index.term)) for _ in range(rng.randrange(1, 40))}
        full = {}
        for t in terms:
            for d, s in zip(index.docs[t], index.shares[t]):
                full[d] = full.get(d, 0) + s
        for threshold in (0.1, 0.3, 0.6):
            got = dict(index.search(terms, threshold))
            assert got == pytest.approx({d: s for d, s in full.items() if s >= threshold - 1e-12})


def test_passages_that_are_skipped_hold_nothing():
    rng = random.Random(3)
    index = decontaminate.Index([(i, prose(rng, 30)) for i in range(40)])
    for n in (1, 31, 32, 33, 64, 65, 200):
        ids = np.array([rng.randrange(len(index.term) + 1) for _ in range(n)])
        near = set(index.near(ids, 0.25).tolist())
        for a in range(0, max(1, n - 32), 32):
            terms = set(ids[a : a + 64].tolist()) - {len(index.term)}
            assert a in near or not index.search(terms, 0.25)


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, f"{prose(rng, 20)}. {prose(rng, 12)}.") for i in range(30)] + [(99, None), (98, ""), (7, f"{prose(rng, 9)}.")]
    noise = lambda n: " ".join(rng.choice(WORDS) + rng.choice("aeiou") for _ in range(n))
    docs = [(0, f"{noise(100)} {items[3][1]} {noise(50)}"), (1, f"{noise(31)} {items[4][1].upper().replace('.', '')} {noise(300)}"), (2, noise(400)), (3, items[5][1].split(".")[0]), (4, None), (5, ""), (6, f"{items[8][1]} {noise(9)} {items[9][1]}")]
    df = spark.createDataFrame([(*d, "s", "") for d in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in rows(decontaminate.leaks(df, bench))}
    assert got == {0: [3], 1: [4], 2: [], 3: [], 4: [], 5: [], 6: [8, 9]}
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in rows(kept)} == {2, 3, 4, 5}
    assert decontaminate.leaks(df, bench.limit(0)).where("contaminated").count() == 0


def test_token_store(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    shared = prose(rng, 900)
    texts = [prose(rng, 2000), shared, f"{prose(rng, 5)} {shared}", "", None, "  two  spaces\n\n", "tab\there <|endoftext|> é\x00ñ", "Ünï code.\nNew line, it's\nfine", shared, "x" * 3000, "the the " * 500]
    docs = [(100 - i, t, "s", "") for i, t in enumerate(texts)] + [(None, "null id", "s", ""), (50, shared, "s", "")]
    got = sorted(rows(token_store.roundtrip(spark.createDataFrame(docs, DOCS))), key=lambda r: r["start"])
    plain, at = Tokenizer.from_file(token_store.default_tokenizer()), 0
    for r, (doc_id, text, *_) in zip(got, sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)), strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert rows(token_store.roundtrip(spark.createDataFrame([], DOCS))) == []


def test_token_store_stores_once_and_notices_damage(spark, tmp_path):
    text = prose(random.Random(6), 3000)
    token_store.write(spark.createDataFrame([(i, text, "s", "") for i in range(5)], DOCS), f"file://{tmp_path}/store")
    packs = spark.read.parquet(f"file://{tmp_path}/store/packs")
    assert packs.where("size(absent) = 0").count() == 1 and packs.where("size(absent) = size(digests)").count() == 4
    bad = packs.withColumn("start", packs.start).toPandas()
    bad.loc[0, "root"] = "0" * 64
    kinds = packs.schema
    spark.createDataFrame(bad, kinds).write.parquet(f"file://{tmp_path}/bad/packs")
    token_store._manifest(spark.read.parquet(f"file://{tmp_path}/bad/packs").select("row_number", "root")).write.parquet(f"file://{tmp_path}/bad/manifest")
    with pytest.raises(ValueError, match="manifest"):
        token_store.read(spark, f"file://{tmp_path}/bad")


def test_chunks_follow_content():
    rng = np.random.default_rng(7)
    ids = rng.integers(0, 50000, 9000).astype(np.uint16)
    ends = token_store.boundaries(ids)
    assert ends[-1] == len(ids) and all(0 < b - a <= token_store.MOST for a, b in zip([0, *ends], ends))
    moved = token_store.boundaries(np.concatenate([rng.integers(0, 50000, 777).astype(np.uint16), ids]))
    assert len({e - 777 for e in moved} & set(ends)) > 0.8 * len(ends)
    assert token_store.boundaries(np.zeros(5000, np.uint16))[-1] == 5000


def jaccard(docs, threshold=0.8):
    shingler = ngram_join.Shingler()
    sets = {i: set(shingler.shingles(t).tolist()) for i, t in docs}
    links, low = {i: 0 for i in sets}, {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in docs:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return links, low


def test_ngram_join(spark):
    rng = random.Random(8)
    base = [prose(rng, 120).split() for _ in range(4)]
    docs = []
    for i in range(150):  # one large group of near copies, small ones, and single documents
        w = list(base[0 if i < 90 else i % 4]) if i < 130 else prose(rng, 40).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + "q"
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "Two words"), (203, "two  WORDS."), (204, "!!")]
    got = {r["doc_id"]: r for r in rows(ngram_join.join(spark.createDataFrame([(i, t, "s", "x") for i, t in docs], DOCS)))}
    links, low = jaccard(docs)
    assert {k: r["n_links"] for k, r in got.items()} == links and {k: r["component_id"] for k, r in got.items()} == low
    assert all(r["kept"] == (k == low[k]) for k, r in got.items())
    assert rows(ngram_join.join(spark.createDataFrame([], DOCS))) == []


def test_ngram_join_of_odd_rows(spark):
    text = prose(random.Random(9), 50)
    df = spark.createDataFrame([(1, text, "s", ""), (1, text, "s", ""), (2, text + " more", "s", ""), (None, text, "s", "")], DOCS)
    assert sorted((r["doc_id"] or 0, r["n_links"], r["kept"]) for r in rows(ngram_join.join(df))) == [(0, 0, True), (1, 2, True), (1, 2, True), (2, 2, False)]
    assert sorted(r["doc_id"] or 0 for r in rows(ngram_join.keep_one(df))) == [0, 1]


def test_bands_reach_their_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, per = ngram_join.bands_and_rows(threshold, 0.999)
        assert 1 - (1 - threshold**per) ** bands >= 0.999 and bands * per <= ngram_join.MOST_HASHES


def test_embeddings(spark):
    rng = np.random.default_rng(10)
    vectors, labels = [], []
    for g in range(60):
        center = rng.normal(size=64)
        for k in range(1 + g % 6 * (5 if g == 5 else 1)):
            v = center + rng.normal(size=64) * 0.13 * (k > 0)
            vectors.append([float(x) for x in np.float32(v)])
            labels.append(g % 3)
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[0]], None, [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [1.0, 2.0], [1.0, 2.0], []]
    labels += [0, 1, 0, 0, 0, 0, 0, 0, 0, 0]
    data = [(i, v, lab, "x") for i, (v, lab) in enumerate(zip(vectors, labels))] + [(900, vectors[0], None, "x")]
    got = {r["vec_id"]: r for r in rows(embed_dedup.link(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, class_id string")))}
    unit = {i: embed_dedup.clean(v) for i, v, lab, _ in data if lab is not None}
    lab = {i: x for i, _, x, _ in data}
    pairs = [(a, b) for a in unit for b in unit if a < b and lab[a] == lab[b] and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.98]
    links = {i: sum(i in p for p in pairs) for i in lab}
    assert pairs and {k: r["n_links"] for k, r in got.items()} == links
    low = {i: i for i in lab}
    for _ in range(20):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    assert {k: r["component_id"] for k, r in got.items()} == low


def test_multi_sequence_order():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embed_dedup.fit(x, 5000, 1)
    homes, walks = index.walks(x[:20], radius=0.3)
    width = len(index.books[1])
    for i in range(20):
        far = [index.distances(h, part)[1][0] ** 2 for h, part in enumerate(index.halves(x[i : i + 1]))]
        d = {a * width + b: far[0][a] + far[1][b] for a in range(len(far[0])) for b in range(width)}
        assert walks[i][0] == homes[i] and set(walks[i]) == {c for c, v in d.items() if v <= 0.09}
        assert [round(d[c], 9) for c in walks[i]] == sorted(round(d[c], 9) for c in walks[i])


def lines_deleted(docs, least=50):
    seen, out = {}, {}
    split = {i: [x.strip(" ") for x in (t or "").split("\n")] for i, t in docs}
    for again in (False, True):
        for i in sorted(split):
            ls = split[i]
            w = [max(1, len(x.split())) for x in ls]
            gone = set()
            for s in range(len(ls)):
                for e in range(s, len(ls)):
                    if sum(w[s : e + 1]) >= least:
                        key = tuple(ls[s : e + 1])
                        if not again:
                            seen.setdefault(key, (i, s))
                        elif seen[key][0] < i or seen[key][1] + len(key) <= s:  # a copy that overlaps the first is none
                            gone.update(range(s, e + 1))
            out[i] = sorted(gone)
    return out


def test_line_dedup(spark):
    rng = random.Random(12)
    pool = [prose(rng, rng.choice([1, 3, 8, 20, 30, 60])) for _ in range(30)]
    docs = []
    for i in range(40):
        ls = [rng.choice(pool) if rng.random() < 0.5 else prose(rng, rng.choice([2, 10, 25])) for _ in range(rng.randrange(1, 12))]
        at = rng.randrange(20)
        ls[rng.randrange(len(ls)) : 0] = pool[at : at + rng.randrange(1, 7)]
        docs.append((i, "\n".join(ls)))
    docs += [(50, docs[3][1]), (51, docs[3][1]), (52, None), (53, ""), (54, "same\n" * 70), (55, "  " + docs[4][1])]
    df = spark.createDataFrame([(i, t, "s", "x") for i, t in docs], DOCS)
    got = {r["doc_id"]: list(r["deleted"]) for r in rows(line_dedup.dedup(df))}
    want = lines_deleted(docs)
    assert got == want and any(want.values())
    kept = {r["doc_id"]: r["text"] for r in rows(line_dedup.deduplicated(df))}
    split = {i: (t or "").split("\n") for i, t in docs}
    assert kept == {i: ("\n".join(x for k, x in enumerate(split[i]) if k not in set(want[i])) if want[i] else t) for i, t in docs if len(want[i]) < len(split[i])}
    assert rows(line_dedup.dedup(spark.createDataFrame([], DOCS))) == []


def test_walks_reach_partners_along_the_axes_of_spread():
    rng, spread = np.random.default_rng(7), np.full(64, 0.05)
    spread[[3, 40]] = 1.0
    a = rng.normal(size=(4000, 64)) * spread
    b = a + rng.normal(size=a.shape) * spread * rng.uniform(0.01, 0.2, len(a))[:, None]
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    near = (a * b).sum(1) >= 0.98
    index = embed_dedup.fit(a, 64 * 64 * embed_dedup.CELL_ROWS, 1)
    homes, _ = index.walks(b[near], radius=0.0)
    _, walks = index.walks(a[near])
    assert near.sum() > 1000 and len(set(homes.tolist())) > 200 and all(h in w for h, w in zip(homes.tolist(), walks, strict=True))


def test_lines_are_compared_without_any_white_space_around_them(spark):
    lines = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(2)]
    docs = [(1, "\n".join(lines)), (2, f"\t{lines[0]}\r\n\u00a0{lines[1]}\u2003\nown words")]
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: list(r["deleted"]) for r in got} == {1: [], 2: [0, 1]}
