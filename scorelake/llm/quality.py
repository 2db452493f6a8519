"""Quality classifier as a sparse rule ensemble.

1. ``statistics`` counts every whole text (no label, language, source or id among them).
2. Trees of a small forest are grown on labelled rows; every path from a root to a node is a conjunctive rule.
3. A lasso logistic regression over the rules' 0/1 values keeps few of them.
4. The kept rules are compiled into Spark column expressions; the score is a sigmoid of their weighted sum.

The fit takes at most ``MAX_ROWS`` labelled rows (the smallest hashes of their ids); every text is counted and scored.

Defined cases: null and empty texts have statistics of zero and a score like any other; label rows with null labels or
without a document are ignored; without labels of both classes the score is the smoothed share of label 1; repeated rows
each get their row; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import map_batches, stored, text_of
from scorelake.llm.textstats import base_counts

MAX_ROWS = 50_000
TREES, DEPTH = 12, 3
LASSO = 5e-4

STATISTICS = ("log_words", "word_chars", "symbol_share", "digit_share", "upper_share", "mark_share", "line_words", "repeated_lines",
              "repeated_words", "distinct_words", "short_words", "long_words", "top_word_share", "end_marks", "pipe_share", "run_share")

_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]")


def _statistics(text: str) -> list[float]:
    raw = text.encode()
    words = raw.split()
    n, word_chars, symbols, dup_lines, repeats = base_counts(text, raw, words)
    m, chars = max(n, 1), max(word_chars, 1)
    lines = raw.count(b"\n") + 1
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    kinds, counts = np.unique(np.array(words, object) if n else np.zeros(0), return_counts=True)
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = len(raw) - len(raw.translate(None, b".,;:!?"))
    ends = sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in raw.split(b"\n"))
    return [float(np.log1p(n)), word_chars / m, symbols / chars, digits / chars, len(_UPPER.findall(text)) / chars, marks / chars,
            n / lines, dup_lines / lines, repeats / m, len(kinds) / m, float((lengths <= 3).mean()), float((lengths >= 12).mean()),
            float(counts.max() / m) if n else 0.0, ends / lines, raw.count(b"|") / m, runs / m]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and one double per name in ``STATISTICS``, for every whole text."""
    chosen = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_statistics(text) for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], ["id", *STATISTICS])

    shape = ", ".join(f"{name} double" for name in STATISTICS)
    return map_batches(chosen, f"id {chosen.schema['id'].dataType.simpleString()}, {shape}", work)


def paths(trees: str) -> list[tuple[tuple[int, str, float], ...]]:
    """All distinct paths to nodes below the roots, from the text that Spark gives of a forest."""
    found: dict[tuple, None] = {}
    stack: list[tuple[int, str, float]] = []
    for line in trees.splitlines():
        tree = re.search(r"Tree \d+", line)
        test = re.search(r"(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dE]+)\)", line)
        if tree:
            base, stack = len(line) - len(line.lstrip()), []
        elif test:
            level = len(line) - len(line.lstrip()) - base
            stack = [s for s in stack if s[0] < level] + [(level, (int(test[1]), test[2], float(test[3])))]
            found[tuple(sorted(condition for _, condition in stack))] = None
    return list(found)


def compiled(rule: tuple[tuple[int, str, float], ...]) -> Column:
    """A rule as a column of 0.0 and 1.0."""
    holds = F.lit(True)
    for feature, sign, bound in rule:
        column = F.col(STATISTICS[feature])
        holds = holds & (column <= bound if sign == "<=" else column > bound)
    return holds.cast("double")


def fit(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS,
        trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> dict:
    """Rules with their weights, and the intercept, from the labelled rows given."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    drawn = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = stored(counted.dropDuplicates(["id"]).join(drawn, "id"), "quality-training").repartition(8, "id").sortWithinPartitions("id")
    size, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, size):
        return {"rules": [], "bias": float(np.log((good + 1) / (size - good + 1)))}
    assembled = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="0.5", seed=42,
                                    labelCol="label").fit(assembled)
    rules = paths(forest.toDebugString)
    if not rules:
        return {"rules": [], "bias": float(np.log((good + 1) / (size - good + 1)))}
    # Rows with equal rule values count together; there are at most as many patterns as rows of the bounded sample.
    bits = F.concat(*[F.when(compiled(rule) == 1.0, "1").otherwise("0") for rule in rules])
    seen = rows.groupBy(bits.alias("bits"), "label").count().orderBy("bits", "label").collect()
    x = np.array([np.frombuffer(r.bits.encode(), np.uint8) == 49 for r in seen], np.float64)
    weights, bias = lasso_logistic(x, np.array([r.label for r in seen]), np.array([r["count"] for r in seen], np.float64), lasso)
    return {"rules": [(rule, float(w)) for rule, w in zip(rules, weights, strict=True) if w], "bias": bias}


def lasso_logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray, penalty: float, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Mean logistic loss plus ``penalty`` times the sum of absolute weights (not the bias), by accelerated proximal steps."""
    share = count / count.sum()
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((share @ y) / (1 - share @ y))
    step = 4 / np.linalg.norm(x * np.sqrt(share)[:, None], 2) ** 2
    ahead, momentum = w.copy(), 1.0
    for _ in range(rounds):
        miss = share * (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - y)
        moved = ahead - step * (x.T @ miss)
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead = moved + (momentum - 1) / following * (moved - w)
        w, momentum = moved, following
    return w[:-1], float(w[-1])


def score(counted: DataFrame, model: dict) -> DataFrame:
    """``id, score, predicted``."""
    total = F.lit(model["bias"])
    for rule, weight in model["rules"]:
        total = total + compiled(rule) * weight
    return counted.select("id", (1 / (1 + F.exp(-total))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on labelled rows that are not held out, then score every document."""
    counted = stored(statistics(docs, id_col, text_col), "quality-statistics")
    model = fit(counted, labels.where(~held_out(id_col)), id_col)
    return score(counted, model).select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", "predicted")
