"""Quality classifier: Bradley-Terry pairwise ranking (operator 9).

Documents are worth a linear score of features of their whole text. Pairs of a
good and a bad labelled document are preferences; the weights maximise the
likelihood that the better of a pair wins, by Newton steps on the logistic loss
of feature differences. The cut is the quantile of the training scores that
leaves the share of bad labels below it; scores are shifted so that the cut is
at THRESHOLD and squashed to 0..1.

Labels are the only thing learned from; at most ``most_labels`` labelled rows
(those of the smallest id hashes) and ``most_pairs`` pairs of them are used.

Defined results
* null or empty text: features of an empty text, a score like any other
* labels with null quality are ignored; of several labels of an id the lowest
  counts, of several texts of an id the one with the least hash
* ties of score at the threshold count as good
* no labels, or labels of one kind only: every score is 0.5
* each row gives a row; id, language and source never enter a score
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.common import small_batches

THRESHOLD = 0.3
MOST_LABELS = 20_000
MOST_PAIRS = 100_000

_bytes = bytes(range(256))
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,", b"!?", b";:'\"-()",
    b"%&$#*", b"|", b"@+=<>/\\^~_{}[]`", b"\n", b" ", bytes(range(128, 256)),
)
N_FEATURES = 2 * (len(CLASSES) + 9)


def raw_features(text: bytes) -> list[float]:
    size = len(text) or 1
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_words, n_lines = len(words) or 1, len(lines) or 1
    shares = [(len(text) - len(text.translate(None, c))) / size for c in CLASSES]
    distinct = len(set(words))
    return [
        *[x**0.5 for x in shares],
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n_words, distinct / n_words, np.log1p(distinct), len(set(lines)) / n_lines,
        np.log1p(size / n_lines), sum(map(len, set(lines))) / size, np.log1p(len(lines)),
    ]


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -5, 5)
    return np.hstack([z, np.abs(z)])


class Ranker:
    """mean, scale of the raw features; weights; cut."""

    def __init__(self, x: np.ndarray, good: np.ndarray, most_pairs: int = MOST_PAIRS, ridge: float = 1e-3):
        self.known = bool(len(good)) and 0 < good.sum() < len(good)
        if not self.known:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        f = standard(x, self.mean, self.scale)
        rng = np.random.Generator(np.random.PCG64(7))
        winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
        n = min(most_pairs, len(winners) * len(losers))
        d = f[rng.choice(winners, n)] - f[rng.choice(losers, n)]
        w = np.zeros(f.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            grad = d.T @ (1 - p) / n - ridge * w
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w)), grad)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        self.cut = float(np.quantile(f @ w, (~good).mean()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), 0.5)
        u = standard(x, self.mean, self.scale) @ self.weights - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(u, -500, 500)))


def features_of(column: pa.Array) -> np.ndarray:
    texts = column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
    return np.array([raw_features(x or b"") for x in texts], float).reshape(len(texts), N_FEATURES // 2)


def _featuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = features_of(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], ["quality", "x"])


def _scoring(ranker: Ranker, text_at: int, width: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(ranker.score(features_of(batch.column(text_at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], score], [*batch.schema.names[:width], name])

    return run


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labels: int = MOST_LABELS) -> Ranker:
    """Fit on labelled rows that aren't held out."""
    small_batches(docs.sparkSession)
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").cast("int").alias("quality"))
    rows = rows.orderBy(F.xxhash64("label_id"), "label_id").limit(most_labels)
    found = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "label_id")
    found = found.groupBy("label_id", "quality").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")))).alias("text")).select("quality", "text")
    got = found.mapInArrow(_featuring, "quality int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, N_FEATURES // 2)
    good = np.array(got.column("quality").to_pylist(), int) == 1
    order = np.lexsort((*x.T, good))
    return Ranker(x[order], good[order])


def scored(docs: DataFrame, ranker: Ranker, keep: list[str], text_col: str = "text", name: str = "_score") -> DataFrame:
    """The columns keep of all rows, and their score (double) as ``name``, which keep must not hold."""
    if name in keep:
        raise ValueError(f"{name} is a column already")
    small_batches(docs.sparkSession)
    rows = docs.select(*[docs[f"`{c}`"] for c in [*keep, *([] if text_col in keep else [text_col])]])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])
    return rows.mapInArrow(_scoring(ranker, rows.columns.index(text_col), len(keep), name), f"{fields}, `{name}` double")
