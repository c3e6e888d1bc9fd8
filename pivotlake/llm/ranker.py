"""Quality classifier: Bradley-Terry pairwise ranking.

Labelled rows give preference pairs (a good document over a bad one); the probability that
one beats the other is the logistic of the difference of their scores, and scores are linear
in features of the text, so the weights minimise the logistic loss on feature differences.
The threshold is a quantile of the training scores: the share of bad labels. A document's
score is the logistic of its distance to the threshold, moved so that the threshold is
``CUT``.

Only a bounded sample of labelled rows (``MAX_ROWS``, lowest hashes first) is used to fit;
every document is scored, by its whole text.

Defined results: null and empty texts have all-zero features and get a score like any other;
null ids pass through and are held out of training; repeated label rows of one id count once
(the larger label); label rows without a document are ignored; without both labels all
scores are 0.5; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pivotlake.functions.shipping import ship
from pivotlake.llm.common import table

CUT = 0.3
#: Labelled rows that are used to fit, at most.
MAX_ROWS = 20_000
#: Partners that each document of the smaller class meets, and the most pairs in all.
PARTNERS, MAX_PAIRS = 20, 200_000
RIDGE = 1e-3
FOLDS = 5

#: Function words of the supported languages (fixed values).
_STOP_WORDS = "the of and to a in is it that for with as was on be by are this der die das und ist nicht ein eine zu den von mit sich auf für dem le la les et de des un une que qui en du dans pour est sur par el los las y una por con no para se su al lo".split()
_STOP = frozenset(f(w).encode() for w in _STOP_WORDS for f in (str.lower, str.upper, str.capitalize))
#: Characters whose shares are features, a group each.
_GROUPS = (b"|", b"#$%*&<>", b"!", b"?", b".", b",", b"0123456789", b"{}[]()=;", b"\"'")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WHITE = b"\t\n\x0b\x0c\r "
N_BASE = 21


def _capital(word: bytes) -> bool:
    return 65 <= word[0] <= 90 if word[0] < 128 else word.decode("utf-8", "surrogatepass")[0].isupper()


def text_features(text: str | None) -> list[float]:
    """Measures of one text; shares are taken of words or characters. Characters of a group
    are counted in whole passes over the bytes; only distinct words are looked at one by
    one. Lengths count code points."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * N_BASE
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x and not x.isspace()] or [text]
    counts, pairs = Counter(words), Counter(zip(words, islice(words, 1, None), strict=False))
    missing = lambda group: len(raw) - len(raw.translate(None, group))
    return [
        math.log1p(n),
        (chars - missing(_WHITE)) / n / 10,
        len(counts) / n,
        max(counts.values()) / n,
        sum(v for v in pairs.values() if v > 1) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        sum(counts[w] for w in _STOP & counts.keys()) / n,
        sum(v for w, v in counts.items() if _capital(w)) / n,
        missing(_UPPER) / chars,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)) / 5,
        sum(map(len, lines)) / chars,
        *(missing(g) / n for g in _GROUPS),
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their square roots, so that small shares already count."""
    return np.hstack([x, np.sqrt(np.abs(x))])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def preference_pairs(y: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the good and of the bad member of each pair. Rows of the smaller class
    meet ``PARTNERS`` random partners of the other, and every row takes part once at least
    (as far as ``MAX_PAIRS`` allows), before any takes part twice more."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    n = min(MAX_PAIRS, max(PARTNERS * min(len(good), len(bad)), len(good), len(bad)))
    turn = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]
    return turn(good), turn(bad)


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 1) -> dict:
    """Weights and threshold from feature rows and labels."""
    x = expand(x)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    good, bad = preference_pairs(y, seed)
    diff, n = z[good] - z[bad], len(good)
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps on a convex loss
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -diff.T @ p / n + RIDGE * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    scores = z @ w
    # between the scores on either side of the quantile
    ranked = np.sort(scores)
    k = int((y == 0).sum())
    return {"mean": mean, "scale": scale, "w": w, "cut": float((ranked[k - 1] + ranked[k]) / 2)}


def score_features(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    raw = ((expand(x) - model["mean"]) / model["scale"]) @ model["w"] - model["cut"]
    return 1 / (1 + np.exp(-np.clip(raw + math.log(CUT / (1 - CUT)), -700, 700)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> dict | None:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold. The sample is
    broadcast (its size is the parameter), so texts are not shuffled."""
    ship(docs.sparkSession)
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(F.col(id_col)) != 0))
    own = own.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("long").alias("_y"))
    own = own.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([text_features(t.as_py()) for t in b.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], ["_id", "_y", "_x"])

    texts = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t"))
    rows = texts.join(F.broadcast(own), F.col("_d") == F.col("_id")).select("_id", "_y", "_t")
    found = rows.mapInArrow(features, "_id long, _y long, _x array<double>").groupBy("_id").agg(F.min(F.struct("_y", "_x")).alias("r"))
    got = sorted((r["_id"], r["r"]["_y"], r["r"]["_x"]) for r in found.collect())
    y = np.array([r[1] for r in got])
    if not len(got) or len(set(y)) < 2:
        return None
    return fit_pairs(np.array([r[2] for r in got]), y)


def score_documents(docs: DataFrame, model: dict | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, score)`` for every row."""
    ship(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t.as_py()) for t in b.column(1)]).reshape(-1, N_BASE)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_features(model, x), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(score, "doc_id long, score double")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
