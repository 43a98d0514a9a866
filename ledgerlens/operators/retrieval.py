"""Hybrid retrieval: BM25 over postings, exact cosine, rank fusion, and ranking metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

K1, B, RRF_K = 1.2, 0.75, 60
#: Rows of a block of queries, and of a block of vectors.
BLOCK_ROWS = 4096
STOP = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with", "и", "в", "на", "по", "с", "для", "не")
TOKEN_SPLIT = r"[^\p{L}\p{N}_-]+"


def terms(text: Column) -> Column:
    """Lower-cased tokens; hyphens stay inside them."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda x: x != "")


def filtered(chunks: DataFrame, pages: list[int] | None = None, **fields: list) -> DataFrame:
    """Hard filters, before any ranking: AND across fields, IN within one, a page list matches on any page."""
    out = chunks
    for name, values in fields.items():
        if values:
            out = out.where(F.col(name).isin(*values))
    if pages:
        out = out.where(F.arrays_overlap("page_numbers", F.array(*map(F.lit, pages))))
    return out


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, length): one row per distinct term of a chunk; counting is one aggregate with partial counts. only: (term)
    keeps postings of these terms alone, before anything is counted or shuffled."""
    words = chunks.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("w")).withColumn("length", F.size("w"))
    each = words.select("id", "length", F.explode("w").alias("term"))
    return (each if only is None else each.join(only, "term", "left_semi")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct words of each query without stop words."""
    return queries.select("query_id", F.explode(F.array_distinct(F.array_except(terms(F.col("text")), F.array(*map(F.lit, STOP))))).alias("term"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int, policy: str = "AND", id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score, rank): the k best chunks of each query. queries: (query_id, text); policy AND needs all terms.

    Chunks without words don't count. One scan gives their number and mean length; another keeps the words that queries
    ask for, which Spark joins by broadcast where the terms are few, and counts those alone. Postings are written once, as
    frequencies and scores both read them. The k best come from partial top lists per task, not from one sorted group;
    scores are rounded to nine digits, so equal chunks tie whatever the order of a sum.
    """
    q = query_terms(queries)
    wanted = q.groupBy("query_id").agg(F.count("*").alias("terms"))
    length = F.size(terms(F.col(text_col)))
    stats = chunks.select(length.alias("length")).where("length > 0").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    posts = written(postings(chunks, id_col, text_col, q.select("term").distinct()), "postings")
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    hits = posts.join(q, "term").join(df, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.groupBy("query_id", "id").agg(F.round(F.sum(weight), 9).alias("score"), F.count("*").alias("found"))
    if policy == "AND":
        scored = scored.join(wanted, "query_id").where("found = terms")
    return top(scored.select("query_id", "id", "score"), k)


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query by score, then id. A first cut by hashed salt keeps a query with very many hits from
    meeting in one task: each of 32 parts gives k rows at most."""
    order = [F.col("score").desc(), F.col("id")]
    part = Window.partitionBy("query_id", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy(*order)
    few = scored.withColumn("p", F.row_number().over(part)).where(F.col("p") <= k)
    whole = Window.partitionBy("query_id").orderBy(*order)
    return few.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, digits: int | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, score, rank): exact top k of any number of queries (query_id, query_vector).

    Queries and vectors are dealt to blocks of about `block` rows; each block of queries meets each block of vectors and gives
    the k best of every query there, so a task holds two blocks whatever the size of either side. A score that is no number is null and comes last.
    """
    whole = lambda x: F.when(~F.exists(x, F.isnull), F.col(x)).alias(x)  # noqa: E731  a vector with a null part is none
    v, q = vectors.select("id", whole("vector")), queries.select("query_id", whole("query_vector"))
    v_parts, q_parts = (max(1, -(-x.count() // block)) for x in (v, q))
    deal = lambda x, key, own, parts, other, others: x.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    left = deal(q, "query_id", "q_part", q_parts, "v_part", v_parts).groupBy("q_part", "v_part")
    right = deal(v, "id", "v_part", v_parts, "q_part", q_parts).groupBy("q_part", "v_part")

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return _nearest_block(asked, rows, k, digits)

    names = {"query_id": q.schema["query_id"].dataType.simpleString(), "id": v.schema["id"].dataType.simpleString()}
    found = left.cogroup(right).applyInPandas(run, f"query_id {names['query_id']}, id {names['id']}, score double")
    return top(found.withColumn("score", F.round("score", digits)) if digits is not None else found, k)


def _nearest_block(asked: pd.DataFrame, rows: pd.DataFrame, k: int, digits: int | None) -> pd.DataFrame:
    """The k best of rows for each query: a product of matrices picks candidates, whose products are then summed in cosine()'s order."""
    rows = rows.sort_values("id", kind="stable")  # a stable sort by score leaves ties in order of id
    ids, out = rows["id"].to_numpy(), []
    dims = np.array([-1 if x is None else len(x) for x in rows.vector], dtype=int)
    each = [np.zeros(0) if x is None else np.asarray(x, np.float64) for x in rows.vector]
    sizes = np.sqrt([np.cumsum(x * x)[-1] if len(x) else 0.0 for x in each])
    wide = {d: (at := np.flatnonzero(dims == d), np.stack([each[i] for i in at])) for d in {len(x) for x in asked.query_vector if x is not None} & set(dims.tolist())}
    for query_id, x in zip(asked.query_id, asked.query_vector, strict=True):
        q = np.zeros(0) if x is None else np.asarray(x, np.float64)
        size = math.sqrt(np.cumsum(q * q)[-1]) if len(q) else 0.0
        # what can't be compared scores null, a side without length 0
        score = np.where((dims == -1) | (sizes == 0) | (size == 0), 0.0, np.nan)
        at, v = wide.get(len(q), (np.zeros(0, int), None))
        if len(at) and size != 0:
            long = sizes[at] != 0
            at, v = (at, v) if long.all() else (at[long], v[long])
            with np.errstate(all="ignore"):
                rough = v @ q / (sizes[at] * size)
                finite = np.sort(rough[np.isfinite(rough)])
                near = rough >= finite[-k] - (10.0**-digits if digits is not None else 0) - 1e-9 if len(finite) > k else np.isfinite(rough)
                score[at[near]] = np.cumsum(v[near] * q, axis=1)[:, -1] / (sizes[at[near]] * size)
        shown = np.sign(score) * np.floor(np.abs(score) * 10.0**digits + 0.5) if digits is not None else score
        first = np.argsort(-np.where(np.isnan(shown), -np.inf, shown), kind="stable")[:k]
        out.append(pd.DataFrame({"query_id": [query_id] * len(first), "id": ids[first], "score": score[first]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})


def valid_vector(v: Column, dim: int) -> Column:
    """OK, or what is wrong with an embedding."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull(), "MISSING").when(F.size(v) != dim, "DIMENSION").when(odd, "NOT_FINITE").otherwise("OK")


def fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list, position, id): sum of 1 / (k + position) over lists, an id counting once per list, at its first position."""
    first = ranked.groupBy("query_id", "list", "id").agg(F.min("position").alias("position"))
    scored = first.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("position"))).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, candidates: int = 50, lexical_only: bool = False, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """queries (query_id, text, query_vector) -> the k best of both retrievers, fused."""
    lists = bm25(chunks, queries, candidates, "OR", id_col, text_col).select("query_id", F.lit("lexical").alias("list"), F.col("rank").alias("position"), "id")
    if not lexical_only:
        lists = lists.unionByName(nearest(vectors, queries, candidates).select("query_id", F.lit("vector").alias("list"), F.col("rank").alias("position"), "id"))
    return fuse(lists).where(F.col("rank") <= k)


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Hits ordered again by a model's score; the fused score stays."""
    again = hits.withColumnRenamed("score", "fused_score").drop("rank").withColumn("score", score)
    return again.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= k)


def metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query with relevant ids (query_id, id, grade): recall, reciprocal rank, hit and nDCG (gain 2^grade - 1) at k."""
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "id"])
    got = hits.groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "id")
    ideal = relevant.withColumn("n", F.row_number().over(best)).groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("n") <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("n") + 1)).otherwise(0.0)).alias("ideal"))
    out = ideal.join(got, "query_id", "left")
    return out.select(
        "query_id",
        (F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.avg(c).alias(c) for c in ("recall", "mrr", "hit", "ndcg")], F.count("*").alias("queries"))
