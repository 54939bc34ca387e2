"""Toxicity by non-negative positive-unlabelled learning (operator 12)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.shared import fresh_path, table

WORD = re.compile(r"\w+")
#: Code points of the beginnings of words that count besides whole words; insults are bent and compounded at their end.
STEMS = (3, 4, 5, 6)
#: Longer words count by their beginnings alone.
LONGEST_WORD = 40
#: Words whose features a task remembers.
REMEMBERED = 300_000


@dataclass(frozen=True)
class Fit:
    """Bounds of the fitting sample, and the settings of the fit. All rows are scored, whatever these are.

    Features that ``min_documents`` positive rows have are candidates; those kept set positive rows apart from unlabelled ones by ``min_strength``
    standard errors of the difference of shares. ``prior`` is the share of toxic rows; None: that of the labelled training rows. ``folds``: ids whose checksum is 0 modulo this are held out.
    """

    max_positive: int = 20_000
    max_unlabelled: int = 30_000
    max_candidates: int = 50_000
    max_features: int = 4_096
    min_documents: int = 4
    prior: float | None = None
    folds: int = 5
    min_strength: float = 5.0
    steps: int = 600
    batch: int = 2_048
    rate: float = 0.03
    decay: float = 1e-4
    slack: float = 0.0
    seed: int = 12


def stems(word: str) -> Iterator[str]:
    """The features of one word: itself in brackets, and its beginnings."""
    if len(word) <= LONGEST_WORD:
        yield f"<{word}>"
    for n in STEMS:
        if len(word) > n:
            yield word[:n]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Rows:
    """Rows of feature numbers, laid end to end."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.n = len(rows)
        self.at = np.r_[0, np.cumsum([*map(len, rows)])].astype(np.int64)
        self.features = np.fromiter((x for r in rows for x in r), np.int64, self.at[-1])

    def take(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, place among the chosen) of all their features."""
        size = self.at[chosen + 1] - self.at[chosen]
        row = np.repeat(np.arange(len(chosen)), size)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        return self.features[self.at[chosen][row] + inside], row


def fit_nnpu(positive: list[list[int]], unlabelled: list[list[int]], n_features: int, prior: float, fit: Fit = Fit()) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear classifier that minimises the non-negative estimate of its risk under the logistic loss.

    With prior q, loss l, scores f(x): q mean_P l(f) + max(0, mean_U l(-f) - q mean_P l(-f)). The bracket estimates the risk on the negative
    rows, which unlabelled ones hold with a share of 1 - q; where a batch makes it less than -``slack``, the step goes the other way, as
    a negative risk is a sign of overfitting (Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator"). Without a
    positive or an unlabelled row there is nothing to learn: weights 0, and the prior as the bias.
    """
    weights, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return weights, bias
    p, u = Rows(positive), Rows(unlabelled)
    rng = np.random.default_rng(fit.seed)
    theta = np.r_[weights, bias]
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def scores(rows: Rows, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        features, row = rows.take(chosen)
        return theta[-1] + np.bincount(row, theta[features], len(chosen)), features, row

    def pull(slope: np.ndarray, features: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(features, slope[row], n_features), slope.sum()] / len(slope)

    for step in range(1, fit.steps + 1):
        fp, *xp = scores(p, rng.integers(p.n, size=fit.batch))
        fu, *xu = scores(u, rng.integers(u.n, size=fit.batch))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        slope = pull(_sigmoid(fu), *xu) - prior * pull(_sigmoid(fp), *xp)  # of the negative rows' risk
        if negative >= -fit.slack:
            slope += prior * pull(-_sigmoid(-fp), *xp)
        else:
            slope = -slope
        slope[:-1] += fit.decay * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        rate = fit.rate * min(1.0, 2 * (1 - step / (fit.steps + 1)))
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _features(word: str, known: dict[str, int], cache: dict[str, tuple[int, ...]]) -> tuple[int, ...]:
    found = cache.get(word)
    if found is None:
        if len(cache) >= REMEMBERED:
            cache.clear()
        found = cache[word] = tuple(known[x] for x in stems(word) if x in known)
    return found


def _numbers(texts: list[str | None], known: dict[str, int]) -> Iterator[list[int]]:
    """The numbers of each text's features, each once, ascending."""
    cache: dict[str, tuple[int, ...]] = {}
    for text in texts:
        yield sorted({x for w in words_of(text) for x in _features(w, known, cache)})


def _count(sample: DataFrame, known: dict[str, int] | None) -> DataFrame:
    """(feature, n): the texts of ``sample`` that have each feature, of all or the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                has = {x for w in words_of(text) for x in stems(w)}
                found.update(has if known is None else has & known.keys())
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["feature", "n"])

    return sample.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Weights of features, and a bias: 4,096 words at most, whatever the corpus. The score of a text is the logistic function of their sum."""

    weights: dict[str, float]
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        known = {x: i for i, x in enumerate(self.weights)}
        rows = Rows(list(_numbers(texts, known)))
        features, row = rows.take(np.arange(rows.n))
        return _sigmoid(self.bias + np.bincount(row, np.array([*self.weights.values()])[features] if len(features) else None, rows.n))


def is_held_out(id_col: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", fit: Fit = Fit()) -> Model:
    """A model from confirmed toxic rows (label 1) and unlabelled text: rows labelled 0 give the prior alone.

    Ids of fold 0 are in no sample. The samples are the ids of least hash, at most ``fit.max_positive`` confirmed ones and about ``fit.max_unlabelled``
    others; an id with several texts gives the least of them, one with several labels is toxic if any says so, and null ids and null labels are
    ignored. The unlabelled sample is drawn from all rows, as the estimator asks: toxic ones are among them, their labels unread. Candidates, counts and
    feature numbers of the samples come from Spark; what reaches the driver is bounded by ``fit``. An empty table gives a model without weights.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("i"), F.col(label).alias("y")).filter("i IS NOT NULL AND y IS NOT NULL").filter(~is_held_out("i", fit.folds)).groupBy("i").agg(F.max("y").alias("y"))
    n_known, n_toxic = known.agg(F.count("*"), F.count_if(F.col("y") == 1)).first()
    prior = min(max((n_toxic / n_known if n_known else 0.5) if fit.prior is None else fit.prior, 0.001), 0.999)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).filter("i IS NOT NULL").filter(~is_held_out("i", fit.folds))
    n = texts.count()
    hashed = F.pmod(F.xxhash64(F.lit(fit.seed), "i"), F.lit(1 << 32))
    chosen = known.filter("y = 1").select("i").orderBy(hashed, "i").limit(fit.max_positive)
    part = lambda rows, kind: rows.groupBy("i").agg(F.min("text").alias("text")).select(F.lit(kind).alias("kind"), "i", "text")
    positive = part(texts.join(F.broadcast(chosen), "i", "left_semi"), 1)  # 20,000 numbers at most
    unlabelled = part(texts.filter(hashed < int((1 << 32) * min(1.0, fit.max_unlabelled / max(1, n)))), 0)
    path = fresh_path(spark, "toxicity-sample")
    positive.unionByName(unlabelled).write.parquet(path)
    sample = spark.read.parquet(path)
    size = {r["kind"]: r["count"] for r in sample.groupBy("kind").count().collect()}
    toxic = _count(sample.filter("kind = 1"), None).filter(F.col("n") >= fit.min_documents).orderBy(F.desc("n"), "feature").limit(fit.max_candidates)
    among = {r["feature"]: r["n"] for r in toxic.collect()}
    others = {r["feature"]: r["n"] for r in _count(sample.filter("kind = 0"), dict.fromkeys(among, 0)).collect()} if among else {}
    strength = {x: _strength(k, size[1], others.get(x, 0), size.get(0, 0)) for x, k in among.items()}
    kept = sorted((x for x, s in strength.items() if s >= fit.min_strength), key=lambda x: (-strength[x], x))[: fit.max_features]
    numbers = {x: i for i, x in enumerate(kept)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(_numbers(batch.column(2).to_pylist(), numbers)), pa.list_(pa.int32()))], names=["kind", "i", "x"])

    rows = sample.mapInArrow(run, f"kind int, i {sample.schema['i'].dataType.simpleString()}, x array<int>").toArrow().sort_by([("kind", "ascending"), ("i", "ascending")])
    kinds, lists = rows["kind"].to_pylist(), rows["x"].to_pylist()
    weights, bias = fit_nnpu([x for k, x in zip(kinds, lists, strict=True) if k], [x for k, x in zip(kinds, lists, strict=True) if not k], len(kept), prior, fit)
    return Model(dict(zip(kept, weights.tolist(), strict=True)), bias)


def _strength(k: int, n: int, other_k: int, other_n: int) -> float:
    """By how many standard errors the share ``k / n`` differs from ``other_k / other_n``; 0 where one is of nothing."""
    if not n or not other_n:
        return 0.0
    share = (k + other_k) / (n + other_n)
    return abs(k / n - other_k / other_n) / max(1e-9, (share * (1 - share) * (1 / n + 1 / other_n)) ** 0.5)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: how likely its whole text is toxic, 0 to 1. Null and empty texts get the bias's score; repeated rows are scored each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op12_nnpu_toxicity(spark: SparkSession, sf_dir: str, fit: Fit = Fit()) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_toxicity(docs, fit_model(docs, table(spark, sf_dir, "labels"), fit=fit))
    return found.select("doc_id", is_held_out("doc_id", fit.folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
