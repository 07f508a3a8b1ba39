"""Toxicity: maximum-scoring segments over token log-odds.

Tokens are character n-grams of words (a word between marks; short words whole), so
that compounds of a toxic stem are seen. Their log-odds between toxic and other
labelled texts are smoothed with a Dirichlet prior, and the lower confidence bound
is their score; a word scores as its best token, or DRIFT below zero. A linear-time
scan finds every maximal-scoring segment of a text. A segment's score S becomes an
expected number of such segments by chance, E = K n exp(-lambda S), with lambda
and K from the clean texts' segments; the chance 1 - exp(-E) of the best one, the
sum statistic of all and the best score go through a logistic link.

Labels are taken from at most MAX_TRAIN rows, in the order of a hash of their id.
They give the log-odds; the calibration uses scores of each half under the log-odds
of the other. Every text is
scored whole, in one scan without a shuffle; the model that is broadcast has at most
MAX_TOKENS tokens.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from orrery.llm.common import materialise, table
from orrery.llm.decontam import split_words

MAX_TRAIN, MAX_TOKENS, GRAM = 20_000, 50_000, 5
#: Dirichlet prior: so much for each token, and so much in all by background frequency.
PRIOR_EACH, PRIOR_ALL = 0.5, 500.0
Z, MIN_ODDS, DRIFT, THRESHOLD = 1.64, 1.0, -0.25, 0.7
#: A passage is told where fewer than so many of its score are expected by chance in a text of that length.
SIGNIFICANCE = 0.05
#: A token needs so many toxic texts.
MIN_TEXTS = 3


def tokens(word: bytes) -> list[bytes]:
    marked = b"^" + word + b"$"
    return [marked[i : i + GRAM] for i in range(max(1, len(marked) - GRAM + 1))]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end exclusive, score), in linear time.

    Each candidate keeps the sums before and after it and its link to the nearest
    earlier candidate with a lesser sum before it.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # start, end, sum before, sum after
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right, j])
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, b - a) for s, e, a, b, _ in found]


@dataclass
class Model:
    """Token scores and calibration."""

    tokens: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    weights: tuple[float, ...] = (-2.0, 0.0, 0.0, 0.0)

    def word_scores(self) -> dict[bytes, float]:
        own = self.tokens

        class Scores(dict):
            def __missing__(self, word):
                if len(self) > 500_000:
                    self.clear()
                best = max((own.get(t, DRIFT) for t in tokens(word)), default=DRIFT)
                self[word] = best
                return best

        return Scores()

    def features(self, found: list, n: int) -> tuple[float, float, float]:
        """-ln of the chance of so good a segment, ln(1 + sum statistic of all segments), the best score."""
        if not found:
            return 0.0, 0.0, 0.0
        best = max(s for _, _, s in found)
        level = max(0.0, math.log(max(self.scale * n, 1e-300)))
        total = sum(max(0.0, self.rate * s - level) for _, _, s in found)
        return min(50.0, self.surprise(best, n)), math.log1p(total), best

    def expected(self, s: float, n: int) -> float:
        """How many segments of this score or more chance gives n words."""
        return self.scale * n * math.exp(-min(self.rate * s, 300.0))

    def surprise(self, s: float, n: int) -> float:
        return -math.log(-math.expm1(-max(self.expected(s, n), 1e-30)))

    def score(self, found: list, n: int) -> float:
        x = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], self.features(found, n), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, x))))


def scan(model: Model, cache: dict, text: str | None) -> tuple[list, int]:
    words = split_words(text)
    scores = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
    return segments(scores), len(words)


def held_out(ident: Column) -> Column:
    """Rows that only serve for evaluation: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, part (0 or 1) of the labelled rows to learn from; equal texts count once.

    The ids are MAX_TRAIN at most, which bounds their broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.withColumn("_h", F.md5(F.concat(F.lit("toxicity|"), F.col("doc_id").cast("string")))).orderBy("_h", "doc_id").limit(MAX_TRAIN)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known.select("doc_id", "toxic")), "doc_id")
    rows = rows.groupBy(F.md5("text").alias("_h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return rows.select("text", "toxic", (F.conv(F.substring("_h", 1, 1), 16, 10).cast("int") % 2).alias("part"))


def learn_tokens(rows: DataFrame) -> dict[bytes, float]:
    """Scores of the tokens that speak for toxic texts, from texts with column toxic."""

    def words(batches):
        for batch in batches:
            out = [(w, int(t)) for text, t in zip(batch["text"], batch["toxic"], strict=True) for w in set(split_words(text))]
            yield pd.DataFrame(out, columns=["word", "toxic"]).astype({"toxic": "int64"})

    per = rows.select("text", "toxic").mapInPandas(words, "word binary, toxic long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    marked = F.concat(F.lit("^").cast("binary"), "word", F.lit("$").cast("binary"))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length("word") + 2 - GRAM + 1))
    grams = per.select("t", "c", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(marked, i, F.lit(GRAM))))).alias("token"))
    grams = grams.groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    total = grams.agg(F.sum("t"), F.sum("c"), F.count("*")).first()
    nt, nc, kinds = (float(x or 0) for x in total)
    prior = F.lit(PRIOR_EACH) + PRIOR_ALL * (F.col("t") + F.col("c")) / F.lit(max(nt + nc, 1.0))
    all_prior = PRIOR_EACH * kinds + PRIOR_ALL
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + all_prior - F.col(y) - prior))
    spread = F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    scored = grams.where(F.col("t") >= MIN_TEXTS).select("token", (odds("t", nt) - odds("c", nc) - Z * spread).alias("score")).where(F.col("score") >= MIN_ODDS)
    return {bytes(r["token"]): float(r["score"]) for r in scored.orderBy(F.desc("score"), "token").limit(MAX_TOKENS).collect()}


def _scan_rows(rows: DataFrame, model: Model, schema: str, tell) -> DataFrame:
    """tell(model, toxic, segments, words) of each text with column toxic, one tuple for each."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in schema.split(", ")]

    def found(batches):
        own = shared.value
        cache = own.word_scores()
        for batch in batches:
            yield pd.DataFrame([tell(own, int(t), *scan(own, cache, text)) for text, t in zip(batch["text"], batch["toxic"], strict=True)], columns=names)

    return rows.select("text", "toxic").mapInPandas(found, schema)


def chance(parts: list[tuple[DataFrame, Model]]) -> tuple[float, float]:
    """lambda and K, from the segments of clean texts: their scores fall off exponentially."""
    tell = lambda _, toxic, found, n: (0, 0.0, 0) if toxic else (len(found), float(sum(s for *_, s in found)), n)
    count, total, words = 1, MIN_ODDS, 1.0  # one segment is added so that K > 0
    for rows, model in parts:
        r = _scan_rows(rows, model, "count long, total double, words long", tell).agg(F.sum("count"), F.sum("total"), F.sum("words")).first()
        count, total, words = count + (r[0] or 0), total + (r[1] or 0.0), words + (r[2] or 0)
    return count / total, count / words


def calibrate(model: Model, parts: list[tuple[DataFrame, Model]]) -> Model:
    """Sets lambda, K and the logistic weights of model from texts that gave no log-odds to the models of parts.

    What comes to the driver is four numbers for each of at most MAX_TRAIN texts.
    """
    model.rate, model.scale = chance(parts)
    told = []
    for rows, other in parts:
        other.rate, other.scale = model.rate, model.scale
        told += _scan_rows(rows, other, "toxic int, a double, b double, c double", lambda m, toxic, found, n: (toxic, *m.features(found, n))).collect()
    x = np.array([[1.0, r["a"], r["b"], r["c"]] for r in told]).reshape(-1, 4)
    y = np.array([float(r["toxic"]) for r in told])
    w = logistic(x, y)
    while (w[1:] < 0).any():  # evidence never speaks against toxicity
        x[:, 1 + int(np.argmin(w[1:]))] = 0.0
        w = logistic(x, y)
    model.weights = tuple(float(v) for v in w)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - q) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Log-odds from all training texts, calibrated on scores from the other half's log-odds.

    Without labels of both kinds the model gives each text the same low score.
    """
    rows = materialise(training_rows(docs, labels))
    crossed = [(rows.where(F.col("part") == part), Model(learn_tokens(rows.where(F.col("part") != part)))) for part in (0, 1)]
    return calibrate(Model(learn_tokens(rows)), crossed)


def score(docs: DataFrame, model: Model, text_col="text") -> DataFrame:
    """docs with _tox: score double, n_segments, best_start, best_end (words, end exclusive), passages.

    passages has start, end and score of every segment of which fewer than SIGNIFICANCE
    are expected by chance, in the order of the text; n_segments is their number. The
    best segment is given whether it is one of them or not.
    Null and empty texts have no segments and get the score of such texts. Texts are
    judged row by row, whatever their ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        cache = own.word_scores()
        out = []
        for text in texts:
            found, n = scan(own, cache, text)
            best = max(found, key=lambda s: s[2], default=(None, None, 0.0))
            told = [{"start": a, "end": b, "score": s} for a, b, s in found if own.expected(s, n) < SIGNIFICANCE]
            out.append((own.score(found, n), len(told), best[0], best[1], told))
        return pd.DataFrame(out, columns=["score", "n_segments", "best_start", "best_end", "passages"]).astype({"best_start": "Int64", "best_end": "Int64"})

    return docs.withColumn("_tox", pandas_udf(judge, "score double, n_segments long, best_start long, best_end long, passages array<struct<start:long,end:long,score:double>>")(F.col(text_col)))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_tox.score", F.when(F.col("_tox.score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "_tox.n_segments", "_tox.best_start", "_tox.best_end", "_tox.passages")
