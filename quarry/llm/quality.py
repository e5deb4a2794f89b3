"""A quality classifier from compressed sizes.

Two zstandard dictionaries are trained, one from text labelled good and one
from text labelled bad. A text is cut into segments, each is compressed with
either dictionary, and the difference of the two sizes per byte tells which
kind of text it is like. The difference and the smaller size per byte (a text
of one repeated word compresses to nothing with either dictionary) are
calibrated to a probability with a logistic curve on labelled rows that
trained no dictionary.

Only the fit uses a sample: of each label at most ``FIT_ROWS`` rows, those
with the lowest hash of their id, and of those every segment. Scores are made
from whole texts.

Defined results: a null text counts as empty; an empty text gets the share of
label 1 among the labelled rows used; without rows of both labels every text
gets that share (0.5 without any). Columns of the documents may have any
names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.rows import with_columns

SEGMENT = 600
DICTIONARY = 112_640
LEVEL = 3
FIT_ROWS = 3000
THRESHOLD = 0.3
SCHEMA = "score double"


def segments(text: str | None, size: int = SEGMENT) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


@dataclass
class Model:
    """Picklable: two dictionaries and the curve; without dictionaries, the share of label 1."""

    bad: bytes
    good: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]
    share: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        import zstandard

        self.model, self.sizes = model, []
        for raw in (model.bad, model.good) if model.good else ():
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.sizes.append(lambda parts, c=c: sum(len(c.compress(p)) for p in parts))

    def features(self, text: str | None) -> list[float] | None:
        parts = segments(text)
        if not parts or not self.sizes:
            return None
        n = sum(map(len, parts)) + 20 * len(parts)  # a frame's own bytes weigh little in a short text
        bad, good = (f(parts) for f in self.sizes)
        low = math.log(min(bad, good) / n)
        return [(bad - good) / n, low, low * low]

    def score(self, text: str | None) -> float:
        m, x = self.model, self.features(text)
        if x is None:
            return m.share
        z = m.weights[-1] + sum(w * (v - a) / s for w, v, a, s in zip(m.weights, x, m.mean, m.scale, strict=False))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Logistic regression by Newton's steps, lightly regularised."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    x = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return mean.tolist(), scale.tolist(), w.tolist()


def fit(texts: list[tuple[int, list[bytes]]]) -> Model:
    """texts: label and segments, in an order without meaning. Every other
    text of a label trains its dictionary; the rest calibrate."""
    import zstandard

    labels = [y for y, _ in texts]
    share = sum(labels) / len(labels) if labels else 0.5
    kinds = [[s for y, s in texts if y == k and s] for k in (0, 1)]
    empty = Model(b"", b"", [], [], [], share)
    if min(map(len, kinds)) < 4:
        return empty
    dictionaries = []
    for kind in kinds:
        parts = [p for s in kind[::2] for p in s]
        try:
            d = zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, parts)) // 4)), parts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few or too short samples: the text itself serves as a raw dictionary
            d = b"".join(parts)[-DICTIONARY:]
        dictionaries.append(d)
    model = Model(*dictionaries, [], [], [], share)
    scorer = model.scorer()
    rows = [(scorer.features(b"".join(s).decode("utf-8", "replace")), y) for y, kind in enumerate(kinds) for s in kind[1::2]]
    rows = [(x, y) for x, y in rows if x is not None]
    model.mean, model.scale, model.weights = _curve(np.array([x for x, _ in rows]), np.array([y for _, y in rows], float))
    return model


def learn(
    docs: DataFrame,
    labels: DataFrame,
    training: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_rows: int = FIT_ROWS,
) -> Model:
    """Fit on labelled rows. training: a condition on the id column of the label table."""
    spark = docs.sparkSession
    marked = labels.filter(F.col(label_col).isin(0, 1))
    if training is not None:
        marked = marked.filter(training)
    order = [F.xxhash64(F.col(id_col)), F.col(id_col)]
    marked = marked.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"), *(c.alias(f"o{k}") for k, c in enumerate(order)))
    few = marked.filter("y = 0").orderBy("o0", "o1").limit(fit_rows).unionByName(marked.filter("y = 1").orderBy("o0", "o1").limit(fit_rows))
    chosen = few.collect()  # ids and labels of the sample, 2 * fit_rows at most
    if not chosen:
        return fit([])
    few = spark.createDataFrame(chosen, few.schema)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(few), "i")
    rows = texts.select("o0", "o1", "y", "t").collect()  # whole texts of the sample
    rows.sort(key=lambda r: (r["o0"], r["o1"], r["y"], r["t"] or ""))
    return fit([(r["y"], segments(r["t"])) for r in rows])


def score(docs: DataFrame, model: Model, text: str | Column = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row per document: its columns as the struct ``row`` and its ``score``, higher for label 1."""
    text = F.col(text) if isinstance(text, str) else text
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        f = shared.value.scorer().score
        return lambda texts: {"score": list(map(f, texts))}

    return with_columns(docs, text, make, SCHEMA, keep)


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels, fold() != 0)
    rows = score(docs, model, keep=("doc_id",)).select("row.doc_id", "score")
    return rows.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns."""
    model = learn(docs, labels, fold() != 0)
    return score(docs, model).filter(F.col("score") >= threshold).select("row.*")
