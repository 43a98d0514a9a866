"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (lengths, character classes, repetition, line shapes) are binned by
quantiles of the training sample; trees grow level by level on gradient histograms. A
trained model is a handful of arrays (feature, bin, children, value of every node), and scoring
walks all rows of a batch down a tree at once by indexing those arrays.

The sample is bounded: the ``train_rows`` labelled rows whose hashed ids are least, spread over
the corpus, outside the held-out third. Labels, language, source and id are never inputs. One
pass reads the sample's texts, one scores every document.

Edge cases: null and empty texts are scored (all statistics 0, is_empty 1); a label that is null
or not 0 or 1 is ignored; contradicting labels of an id count as their mean, rounded down from a
half; an id that repeats with several texts is one training row, that of the least statistics; without labels of
both kinds the score is the share of label 1 (1 if there are none), the same for every row; repeated rows get
equal scores; a null id is kept and not held out; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bound of the sample the model is fitted on.
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST_WEIGHT, RIDGE = 64, 60, 4, 0.15, 4.0, 1.0

FEATURES = (
    "is_empty", "log_chars", "log_words", "mean_word", "sd_word", "longest_word", "upper_share", "capital_words", "all_caps_words", "alpha_share", "digit_share",
    "space_share", "punct_share", "symbol_share", "non_ascii_share", "bang_share", "pipe_share", "distinct_words", "top_word", "top3_words", "same_neighbours",
    "repeat_bigrams", "lines_log", "mean_line", "repeat_lines", "short_lines", "line_end_punct", "sentence_rate", "comma_rate", "symbol_words", "char_entropy", "bracket_share", "url_rate",
)
_SYMBOLS = frozenset("#$%&*@^~_=+<>\\|{}[]/")
_NOT_WORD = re.compile(r"[^\w\s]{3}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of FEATURES."""
    if not text:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    n, words, lines = len(text), text.split(), text.split("\n")
    chars = Counter(text)
    upper = lower = digit = space = punct = symbol = wide = 0
    entropy = 0.0
    for c, k in chars.items():
        entropy -= k / n * math.log2(k / n)
        if c.isupper():
            upper += k
        elif c.islower():
            lower += k
        elif c.isdigit():
            digit += k
        elif c.isspace():
            space += k
        elif c in _SYMBOLS:
            symbol += k
        else:
            punct += k
        if c > "\x7f":
            wide += k
    m = max(1, len(words))
    lens = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    top = [k for _, k in counts.most_common(3)]
    pairs = Counter(zip(words, words[1:]))
    same = sum(k for (a, b), k in pairs.items() if a == b)
    shapes = Counter(lines)
    ends = sum(x[-1:] in ".!?:" for x in lines if x)
    caps = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    first = sum(k for w, k in counts.items() if w[:1].isupper())
    symbols = sum(k for w, k in counts.items() if _NOT_WORD.search(w))
    return [
        0.0, math.log1p(n), math.log1p(len(words)), float(lens.mean()), float(lens.std()), float(lens.max()), upper / max(1, upper + lower), first / m, caps / m, (upper + lower) / n, digit / n,
        space / n, punct / n, symbol / n, wide / n, chars.get("!", 0) / m, chars.get("|", 0) / m, len(counts) / m, (top[0] if top else 0) / m, sum(top) / m, same / m,
        1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0, math.log1p(len(lines)), len(words) / len(lines), 1 - len(shapes) / len(lines), sum(len(x) < 20 for x in lines) / len(lines),
        ends / len(lines), (chars.get(".", 0) + chars.get("?", 0)) / m, chars.get(",", 0) / m, symbols / m, entropy, (chars.get("(", 0) + chars.get("[", 0) + chars.get("{", 0)) / m, text.count("http") / m,
    ]


@dataclass
class Model:
    """All trees in flat arrays, tree by tree; a leaf has feature -1."""

    edges: np.ndarray  # features x (bins - 1)
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b, total, every = self.bins(x), np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                f = np.where(inner, self.feature[at], 0)
                at = np.where(inner, np.where(b[every, f] <= self.cut[at], self.left[at], self.right[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Model:
    """Boost trees on the logistic loss; splits come from per-bin sums of gradients and Hessians."""
    share = float(y.mean()) if len(y) else 1.0
    if len(y) == 0 or share in (0.0, 1.0):
        none = np.zeros(0, int)
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros((len(FEATURES), bins - 1)), none, none, none, none, none, np.zeros(0), math.log(p / (1 - p)))
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    model = Model(edges, *[np.zeros(0, int)] * 5, np.zeros(0), math.log(share / (1 - share)))
    b, raw, width = model.bins(x).astype(int), np.full(len(y), model.base), x.shape[1]
    offsets = np.arange(width) * bins
    feature, cuts, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for part, start in ((feature, -1), (cuts, 0), (left, 0), (right, 0), (value, 0.0)):
            part.append(start)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(node())
        level = [(roots[-1], np.arange(len(y)))]
        for d in range(depth + 1):
            below = []
            for at, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[at] = -rate * gs / (hs + RIDGE)
                if d < depth and hs >= 2 * LEAST_WEIGHT:
                    cells = (b[rows] + offsets).ravel()
                    gl = np.bincount(cells, np.repeat(g[rows], width), width * bins).reshape(width, bins).cumsum(1)
                    hl = np.bincount(cells, np.repeat(h[rows], width), width * bins).reshape(width, bins).cumsum(1)
                    gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                    gain[(hl < LEAST_WEIGHT) | (hs - hl < LEAST_WEIGHT)] = -1
                    f, c = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, c] > 1e-3:
                        goes = b[rows, f] <= c
                        feature[at], cuts[at], left[at], right[at] = int(f), int(c), node(), node()
                        below += [(left[at], rows[goes]), (right[at], rows[~goes])]
                        continue
                raw[rows] += value[at]
            level = below
    model.roots, model.feature, model.cut, model.left, model.right = (np.array(z, int) for z in (roots, feature, cuts, left, right))
    model.value = np.array(value)
    return model


def _described(docs: DataFrame, also: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({**{c: batch[c] for c in also}, "x": [np.array(statistics(t or ""), dtype=float).tolist() for t in batch.text]})

    kinds = {c: k for c, k in docs.dtypes}
    return docs.select(*also, "text").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in also) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the sample: at most train_rows labelled documents, least hashed ids first."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # at most train_rows pairs of numbers are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
    # one row per id, so no more than train_rows come to the driver however often an id repeats
    rows = _described(texts, ["doc_id", "y"]).groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(rows.x.tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, rows.y.to_numpy(dtype=float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.text], dtype=float).reshape(len(batch), len(FEATURES))
            yield pd.DataFrame({"doc_id": batch.doc_id, "held_out": batch.held_out, "score": model.score(x)})

    # ids travel as text: pandas would make doubles of integers beside a null
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(run, "doc_id string, held_out boolean, score double")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, in the columns of docs."""

    @F.pandas_udf("double")
    def good(text: pd.Series) -> pd.Series:
        x = np.array([statistics(t or "") for t in text], dtype=float).reshape(len(text), len(FEATURES))
        return pd.Series(model.score(x))

    return docs.where(good(F.col("text")) >= 0.5)
