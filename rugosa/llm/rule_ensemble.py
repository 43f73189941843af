"""Quality classifier as a sparse rule ensemble.

1. Every whole text is measured: shares and rates that do not depend on the
   language (``FEATURES``).
2. On a bounded sample of labelled rows a small random forest is grown; each
   path from a root to an inner node or leaf is a rule, a conjunction of
   threshold tests.
3. A lasso logistic regression over the rules' 0/1 outcomes keeps few of them.
4. The kept rules are compiled into one Spark column expression, which scores
   all documents inside whole-stage code.

Defined results: null and empty texts have all measures 0 and are scored as
such; without labelled rows every score is 0.5, with one class alone it is that
class; labels of unknown documents and repeated label rows do no harm (a
document counts once per label row); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rugosa.llm.common import arrow_rows, store

#: Labelled rows that training reads, about (bound of the sample).
TRAIN_ROWS = 20_000
TREES = 20
DEPTH = 4
#: Lasso penalty.
LASSO = 0.002
SEED = 7

FEATURES = [
    "log_words",
    "word_length",
    "symbols",
    "uppercase",
    "digits",
    "marks",
    "distinct_words",
    "top_word",
    "same_as_before",
    "line_words",
    "repeated_lines",
    "non_ascii",
    "word_length_spread",
    "stops",
]
SCHEMA = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]~^_=+\\/@]")
_MARK = re.compile(r"[!?]")
_STOP = re.compile(r"[.,;:]")


def measure(text: str | None) -> list[float]:
    """The values of FEATURES of one whole text."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    number: dict[str, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), dtype=np.int64, count=n)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    chars = int(sizes.sum())
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, words)) / n  # words without a lower-case letter
    return [
        float(np.log1p(n)),
        chars / n,
        len(_SYMBOL.findall(text)) / n,
        upper,
        sum(map(text.count, "0123456789")) / chars,
        len(_MARK.findall(text)) / n,
        len(number) / n,
        float(np.bincount(w).max()) / n,
        float((w[1:] == w[:-1]).mean()) if n > 1 else 0.0,
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        1 - len(text.encode("ascii", "ignore")) / len(text),
        float(sizes.std()),
        len(_STOP.findall(text)) / n,
    ]


def features(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_rows(rows, SCHEMA, ["doc_id", *FEATURES], lambda: lambda part: [(d, *measure(t)) for d, t in part])


#: One test of a rule: feature number, threshold, whether the value is at most it.
Test = tuple[int, float, bool]


@dataclass
class RuleModel:
    rules: list[tuple[Test, ...]]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 as a column over FEATURES."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def text(self) -> list[str]:
        names = [" and ".join(f"{FEATURES[f]} {'<=' if low else '>'} {t:.6g}" for f, t, low in r) for r in self.rules]
        return [f"{w:+.4f} if {n}" for n, w in zip(names, self.weights, strict=True)]


def rule_column(rule: tuple[Test, ...]) -> Column:
    out = F.lit(True)
    for f, threshold, low in rule:
        col = F.col(FEATURES[f])
        out = out & (col <= threshold if low else col > threshold)
    return out


_BRANCH = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)$")


def tree_paths(debug: str) -> list[tuple[Test, ...]]:
    """Every path below the root of a printed decision tree, as a rule. Tests of
    one feature in one direction are folded into the narrowest."""
    stack: list[tuple[int, Test]] = []
    found = []
    for line in debug.split("\n"):
        if not (m := _BRANCH.match(line)):
            continue
        indent = len(m[1])
        while stack and stack[-1][0] >= indent:
            stack.pop()
        stack.append((indent, (int(m[3]), float(m[5]), m[4] == "<=")))
        narrow: dict[tuple[int, bool], float] = {}
        for _, (f, t, low) in stack:
            old = narrow.get((f, low), t)
            narrow[f, low] = min(old, t) if low else max(old, t)
        found.append(tuple(sorted((f, t, low) for (f, low), t in narrow.items())))
    return found


def fit(labelled: DataFrame, max_rows: int = TRAIN_ROWS) -> RuleModel:
    """Fit on ``FEATURES`` and ``label`` (0/1), about ``max_rows`` of them."""
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        base = 0.0 if not sizes else 20.0 if 1 in sizes else -20.0
        return RuleModel([], [], base)
    share = min(1.0, max_rows / total)
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    # ordered, so that training draws alike on any cluster
    rows = labelled.where(chance < share).select("doc_id", F.col("label").cast("double").alias("label"), *FEATURES)
    rows = store(rows.repartition(2, "doc_id").sortWithinPartitions("doc_id", "label"), "quality-sample")
    vector = rows.select("label", array_to_vector(F.array(*FEATURES)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5, cacheNodeIds=False).fit(vector)
    times: dict[tuple[Test, ...], int] = {}
    for tree in forest.trees:
        for rule in tree_paths(tree.toDebugString):
            times[rule] = times.get(rule, 0) + 1
    rules = sorted(times, key=lambda r: (-times[r], r))  # TREES and DEPTH bound their number
    if not rules:  # no split helps: the share of label 1
        return RuleModel([], [], float(np.log(sizes.get(1, 0) / sizes.get(0, 1))))
    outcome = F.array(*[rule_column(r).cast("double") for r in rules])
    table = rows.select("label", array_to_vector(outcome).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(table)
    weights = lasso.coefficients.toArray()
    kept = np.flatnonzero(weights)
    return RuleModel([rules[i] for i in kept], [float(weights[i]) for i in kept], float(lasso.intercept))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score, predicted of every document; ``labels`` (doc_id, label) holds
    the rows to learn from."""
    measured = store(features(docs), "quality-features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label").where("label in (0, 1)")
    model = fit(known.join(measured, "doc_id"), max_rows)
    score = model.score()
    return measured.select("doc_id", score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))
