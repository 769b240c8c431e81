"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting cycles through the features; each step fits a tree of at most four leaves to one feature's
binned gradients and adds it to that feature's lookup table. Then a few pairs of features, ranked by
what a table over both would still gain, get tables of their own the same way. A score is a sum of
table entries, looked up for whole batches at once. The model is fitted on a bounded sample of the
labelled rows (``max_rows``) and every document is scored in the task that reads it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.textops import as_bytes, pieces

THRESHOLD = 0.3
FOLDS = 5
_CLASSES = ("upper", "lower", "digit", "space", "newline", "sentence", "symbol", "other_mark", "high")
_MASKS = np.zeros((256, len(_CLASSES)), np.float64)
for _b in range(256):
    _c = chr(_b)
    _k = "high" if _b > 127 else "upper" if _c.isupper() else "lower" if _c.islower() else "digit" if _c.isdigit() else "newline" if _c == "\n" else "space" if _c.isspace() else "sentence" if _c in ".,;:?'\"-()" else "symbol" if _c in "#*$%&|<>" else "other_mark"
    _MASKS[_b, _CLASSES.index(_k)] = 1
_HARD_RUN = re.compile(rb"[bcdfghjklmnpqrstvwxz]{5,}")
FEATURES = (
    *(f"share_{c}" for c in _CLASSES), "log_words", "word_bytes", "distinct_share", "top_share", "run_share", "longest_run",
    "repeat_line_share", "line_words", "hard_run_share", "capital_share", "marked_share", "byte_entropy", "lone_mark_share",
)


def features_of(raw: bytes) -> tuple[float, ...]:
    """The features of one whole text; all 0 where there is nothing to divide by."""
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = counts[counts > 0] / len(raw)
    shares = (counts @ _MASKS / len(raw)).tolist()
    seen = Counter(words)
    same = list(map(eq, words, words[1:]))
    run = longest = 0
    if any(same):
        for x in same:
            run = run + 1 if x else 0
            longest = max(longest, run)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(raw) - n
    return (
        *shares, float(np.log1p(n)), chars / n, len(seen) / n, seen.most_common(1)[0][1] / n, sum(same) / n, float(np.log1p(longest)),
        1 - len(set(lines)) / len(lines), n / len(lines), sum(map(len, _HARD_RUN.findall(raw.lower()))) / len(raw), sum(map(bytes.istitle, words)) / n,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n, float(-(p * np.log2(p)).sum()), sum(len(w) == 1 and not w.isalnum() for w in words) / n,
    )


def feature_matrix(raws: list[bytes]) -> np.ndarray:
    return np.array([features_of(x) for x in raws], np.float64).reshape(len(raws), len(FEATURES))


@dataclass
class GAM:
    """Cuts of each feature, one table a feature, and tables for pairs over coarser cuts."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (cut, values) in enumerate(zip(self.cuts, self.tables)):
            out += values[np.searchsorted(cut, x[:, k], side="right")]
        for i, j, values in self.pairs:
            out += values[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def _best_split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain of the best cut of the bins in two, and where the right side begins; gain 0 if none helps."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A value for each bin: the bins cut in two and each side once more, where that gains."""
    out = np.zeros(len(g))
    _, k = _best_split(g, h, ridge)
    for a, b in ((0, k), (k, len(g))) if k else ((0, len(g)),):
        gain, m = _best_split(g[a:b], h[a:b], ridge)
        for c, d in ((a, a + m), (a + m, b)) if gain > 0 and m else ((a, b),):
            out[c:d] = -g[c:d].sum() / (h[c:d].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table in four quadrants: gain and values."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def four(c: np.ndarray) -> list[np.ndarray]:
        tl = c[:-1, :-1]
        top, left = c[:-1, -1:] - tl, c[-1:, :-1] - tl
        return [tl, top, left, c[-1, -1] - tl - top - left]

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gq, hq = four(gc), four(hc)
    gain = sum(a**2 / (b + ridge) for a, b in zip(gq, hq)) - g.sum() ** 2 / (h.sum() + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [-a[i, j] / (b[i, j] + ridge) for a, b in zip(gq, hq)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, bins: int = 32, rate: float = 0.15, ridge: float = 5.0) -> GAM:
    """Fit to labels 0 and 1; without labels every score is 0.5, with one class only its smoothed share."""
    model = GAM()
    if not len(y):
        return model
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return model
    model.cuts = [_cuts(x[:, k], bins) for k in range(x.shape[1])]
    model.coarse = [_cuts(x[:, k], 8) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    wide = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.coarse)]
    f = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, b in enumerate(at):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(b, g, len(model.tables[k])), np.bincount(b, h, len(model.tables[k])), ridge)
            model.tables[k] += step
            f += step[b]
    g, h = slopes()
    ranked = []
    for i in range(x.shape[1]):
        for j in range(i):
            shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
            cell = wide[i] * shape[1] + wide[j]
            gain, _ = _quadrants(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), ridge)
            ranked.append((-gain, i, j, cell, shape))
    ranked.sort(key=lambda r: r[:3])
    chosen = [(i, j, cell, np.zeros(shape)) for _, i, j, cell, shape in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for _, _, cell, values in chosen:
            g, h = slopes()
            step = rate * _quadrants(np.bincount(cell, g, values.size).reshape(values.shape), np.bincount(cell, h, values.size).reshape(values.shape), ridge)[1]
            values += step
            f += step.ravel()[cell]
    model.pairs = [(i, j, values) for i, j, _, values in chosen]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold whose labels are not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 30_000) -> GAM:
    """Fit on at most max_rows labelled rows outside the held-out fold: those whose ids hash lowest.

    Several labels of one doc_id count as their majority (1 at a tie); null ids and labels are left out.
    """
    usable = labels.filter(labels["doc_id"].isNotNull() & labels["quality"].isNotNull() & ~held_out(labels["doc_id"]))
    usable = usable.groupBy(labels["doc_id"].cast("long").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(source):
            x = feature_matrix(as_bytes(part.column(2)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), schema.types[2])], schema=schema)

    text = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].alias("_text"))
    rows = text.join(F.broadcast(sample), "_id").select("_id", "_y", "_text").mapInArrow(run, "id long, y int, x array<double>")
    # rows that share an id would all be drawn: one of them is enough, and keeps the bound
    rows = rows.groupBy("id").agg(F.max("y").alias("y"), F.max("x").alias("x")).orderBy("id").toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(rows.num_rows, len(FEATURES))
    return fit_gam(x, rows["y"].to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: GAM) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    Null and empty texts have all features 0 and are scored like others; a null doc_id is not held
    out; repeated rows get equal scores; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(source):
            scores = shared.value.score(feature_matrix(as_bytes(part.column(2))))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores)], schema=schema)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: GAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold.

    Only texts travel to Python and only scores come back. A null text scores like an empty one, all
    features 0; repeated rows stay or go together; ids and other columns play no part; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        some = [shared.value.score(feature_matrix(as_bytes(texts.slice(at, 500)))) for at in range(0, len(texts), 500)]
        return pa.array(np.concatenate(some) if some else np.zeros(0), pa.float64())

    return docs.filter(score(docs["text"]) >= threshold)
