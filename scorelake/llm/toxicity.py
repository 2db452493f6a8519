"""Toxicity as ordinal regression: a cumulative-link model gives P(grade <= k) = sigmoid(threshold_k - weights . x).

Labels say toxic or not, so severity grades of toxic training texts come from how many marker words they hold: words that
are much more frequent in toxic texts than in others. Grades 1 to 3 are thirds of that count, 0 is not toxic. All
thresholds share one weight vector over sparse word features (log of 1 + count). Features are marker words, taken one by
one, the surest first, from the toxic texts that don't hold three of the taken words yet: so words that merely stand beside
markers, as in a group of copies, aren't taken. Expected severity is the sum of P(grade >= k).

The model is fitted on at most ``MAX_ROWS`` labelled rows (the smallest hashes of their ids) and ``VOCABULARY`` candidate
words; so many rows come to the driver. Word statistics of that sample are counted in Spark; every text is scored, whole.

Defined cases: null and empty texts have no features; their score is that of an empty text; label rows with a null label
or without a document are ignored; without labels of both classes every score is 0; repeated rows each get their row;
other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import map_batches, stored, text_of

MAX_ROWS = 20_000
VOCABULARY = 20_000               # candidates for marker words
GRADES = 3
LEAST_Z, LEAST_ODDS = 2.5, 2.0    # of a marker word: standard errors and log odds ratio
SUPPORT = 0.002                   # share of the toxic texts for which a marker must still speak: labels are noisy
_WORD = re.compile(r"[^\W\d_]+")

SCORES = "n_words long, severity double, grade int, score double, toxic boolean"


def words_of(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns ``id, y`` with the counts of the words of each text."""
    chosen = docs.select("id", "y", text_of(text_col).alias("text"))

    def work(batch: pa.RecordBatch):
        for k in range(batch.num_rows):
            words, counts = np.unique(np.array(_WORD.findall(batch.column(2)[k].as_py().lower()), object), return_counts=True)
            one = [pa.array([batch.column(c)[k].as_py()] * len(words), batch.column(c).type) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*one, pa.array(words, pa.string()), pa.array(counts.astype(np.int64))], ["id", "y", "word", "n"])

    return map_batches(chosen, f"id {chosen.schema['id'].dataType.simpleString()}, y int, word string, n long", work)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """Bounded sample of labelled texts, joined by broadcast (at most ``max_rows`` ids)."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    drawn = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col)).join(F.broadcast(drawn), "id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_ROWS, vocabulary: int = VOCABULARY) -> dict | None:
    """Vocabulary, weights and thresholds; None without both classes."""
    counted = stored(words_of(training_rows(docs, labels, id_col, text_col, label_col, max_rows), text_col), "toxicity-words")
    sizes = {r.id: (r.y, r.size) for r in counted.groupBy("id", "y").agg(F.sum("n").alias("size")).collect()}   # <= max_rows
    n_bad = sum(y for y, _ in sizes.values())
    n_good = len(sizes) - n_bad
    if not n_bad or not n_good:
        return None
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    log_odds = F.log(bad / (n_bad - F.col("bad") + 0.5)) - F.log(good / (n_good - F.col("good") + 0.5))
    error = F.sqrt(1 / bad + 1 / good)
    ranked = (counted.groupBy("word").agg(F.sum("y").cast("long").alias("bad"), F.sum(1 - F.col("y")).cast("long").alias("good"))
              .where("bad + good >= 3").withColumn("odds", log_odds).withColumn("z", log_odds / error)
              .where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
              .orderBy(F.desc("z"), "word").limit(vocabulary))
    ranked = stored(ranked, "toxicity-candidates")
    top = ranked.toPandas()
    held = counted.where("y = 1").join(ranked.select("word"), "word").select("id", "word").toPandas()
    place = {word: k for k, word in enumerate(top["word"])}
    words = markers(held["id"].factorize()[0], held["word"].map(place).to_numpy(np.int64), top["good"].to_numpy(np.int64), n_bad, n_good)
    words = [top["word"][k] for k in words]
    order, index = {key: k for k, key in enumerate(sorted(sizes))}, {word: k for k, word in enumerate(words)}
    y = np.array([sizes[key][0] for key in order])
    count = np.zeros((len(order), len(index)), np.float32)
    for key, word, n in counted.where(F.col("word").isin(words)).select("id", "word", "n").toPandas().itertuples(index=False):
        count[order[key], index[word]] = n
    total = count.sum(axis=1)
    cuts = np.quantile(total[y == 1], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, total, side="left"), 0)
    return {"words": words, **cumulative_link(np.log1p(count), grade, GRADES)}


def markers(text: np.ndarray, word: np.ndarray, good: np.ndarray, n_bad: int, n_good: int, cover: int = 3) -> list[int]:
    """Words taken greedily. ``text, word``: which toxic text holds which candidate; ``good``: other texts that hold it.

    Texts with ``cover`` taken words no longer speak for others."""
    good, taken = good + 0.5, []
    seen = np.zeros(n_bad, np.int64)
    while True:
        open_ = seen < cover
        bad = np.bincount(word[open_[text]], minlength=len(good)) + 0.5
        odds = np.log(bad / (open_.sum() - bad + 1)) - np.log(good / (n_good - good + 1))
        z = odds / np.sqrt(1 / bad + 1 / good)
        z[taken] = -np.inf
        z[(odds < LEAST_ODDS) | (bad < max(3, SUPPORT * n_bad))] = -np.inf
        if not len(z) or z.max() < LEAST_Z:
            return taken
        taken.append(int(z.argmax()))
        seen[text[word == taken[-1]]] += 1


def cumulative_link(x: np.ndarray, grade: np.ndarray, grades: int, ridge: float = 2e-5, rounds: int = 400) -> dict:
    """Maximum likelihood by Adam. Thresholds stay ordered: each is the last one plus the exponential of a free number."""
    n = len(grade)
    above = np.array([np.clip((grade >= k).mean(), 1 / (2 * n), 1 - 1 / (2 * n)) for k in range(1, grades + 1)])
    theta = np.log(1 / above - 1)
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    p = np.concatenate([np.zeros(x.shape[1]), free])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    for step in range(1, rounds + 1):
        w, free = p[:x.shape[1]], p[x.shape[1]:]
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        cdf = 1 / (1 + np.exp(-np.clip(theta[None] - (x @ w.astype(np.float32))[:, None], -30, 30)))
        full = np.hstack([np.zeros((n, 1)), cdf, np.ones((n, 1))])
        like = np.maximum(full[rows, grade + 1] - full[rows, grade], 1e-9)
        slope = np.hstack([np.zeros((n, 1)), cdf * (1 - cdf), np.zeros((n, 1))])
        upper, lower = slope[rows, grade + 1] / like, slope[rows, grade] / like
        by_theta = np.zeros(grades)
        np.add.at(by_theta, grade[grade < grades], upper[grade < grades])
        np.add.at(by_theta, grade[grade > 0] - 1, -lower[grade > 0])
        by_free = np.cumsum(by_theta[::-1])[::-1] * np.concatenate([[1.0], np.exp(free[1:])])
        g = np.concatenate([x.T @ (lower - upper).astype(np.float32), by_free]) / n
        g[:len(w)] -= ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    w, free = p[:x.shape[1]], p[x.shape[1]:]
    return {"weights": w, "thresholds": np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))}


def _below(texts: list[str], model: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text and its P(grade <= k)."""
    weight = dict(zip(model["words"], model["weights"].tolist(), strict=True)) if model else {}
    sizes, sums = np.zeros(len(texts)), np.zeros(len(texts))
    for k, text in enumerate(texts):
        words = _WORD.findall(text.lower())
        counts: dict[str, int] = {}
        for word in words:
            if word in weight:
                counts[word] = counts.get(word, 0) + 1
        sizes[k] = len(words)
        sums[k] = sum(weight[word] * np.log1p(n) for word, n in sorted(counts.items()))
    if model is None:
        return sizes, np.ones((len(texts), GRADES))
    return sizes, 1 / (1 + np.exp(-np.clip(model["thresholds"][None] - sums[:, None], -30, 30)))


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id, n_words, severity`` (expected grade), most likely ``grade``, ``score`` (P(grade >= 1)) and ``toxic``."""
    chosen = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    names = [part.split()[0] for part in SCORES.split(", ")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, below = _below(batch.column(1).to_pylist(), model)
        edge = np.zeros((len(sizes), 1))
        grade = np.diff(np.hstack([edge, below, edge + 1]), axis=1).argmax(axis=1)
        columns = [pa.array(sizes.astype(np.int64)), pa.array((1 - below).sum(axis=1)), pa.array(grade.astype(np.int32)),
                   pa.array(1 - below[:, 0]), pa.array(1 - below[:, 0] >= threshold)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    return map_batches(chosen, f"id {chosen.schema['id'].dataType.simpleString()}, {SCORES}", work).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text is toxic; rows stay where they are (no shuffle)."""
    model = fit(docs, labels, id_col, text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])        # Python functions take no dotted names
    place = docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, below = _below([text or "" for text in batch.column(place).to_pylist()], model)
        return batch.filter(pa.array(1 - below[:, 0] < threshold))

    return map_batches(plain, plain.schema, work).toDF(*docs.columns)
