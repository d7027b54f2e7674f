"""Quality of documents by a sparse ensemble of rules over their statistics.

Method: a random forest is grown on the statistics of labelled documents; every path from a root to a node is a rule, a conjunction
of bounds on statistics. Rules that say the same are one. A logistic regression with an L1 penalty over the rules keeps few of
them with a weight, and these are compiled to Spark column expressions, so scoring is a projection that never leaves the JVM.

It is fitted on at most ``SAMPLE_DOCS`` labelled documents of each class, in the order of a hash of the id; rows weigh what their class has
in all labels, so the score is a probability at any size. All labels are counted. Trees and weights are fitted by Spark; the driver gets tree
descriptions and weights only, whose number is bounded by ``TREES`` and ``DEPTH``.

A null text is empty; empty texts have all statistics zero and get the score that the rules give them. Statistics are of whole texts. Rows of a labelled id that
occur several times count once, by the text with the least hash; of several labels of an id the highest counts, and null labels do not. Without
labels of both classes there are no rules and the score is the smoothed share of label 1, 0.5 without any. A clashing ``score`` column is replaced; names of two leading underscores are the operator's own.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import written

SAMPLE_DOCS = 10_000
#: Tasks of a step of a fit, over at most 2 * SAMPLE_DOCS rows of numbers.
FIT_TASKS = 4
TREES, DEPTH, LEAST_SHARE, PENALTY = 40, 3, 0.005, 0.0002
#: The statistics of a text, in the order of the trees' features.
STATISTICS = ["words", "word_length", "longest_word", "short_words", "distinct_words", "bare_marks", "capitals", "digits", "stops", "marks", "lines", "line_length", "distinct_lines"]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds __stats, a struct of ``STATISTICS`` as doubles."""
    share = lambda part, whole: F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))
    words, lines, rest, n, size = (F.col(f"__{c}") for c in ("words", "lines", "rest", "n", "size"))
    count = lambda c, kind: F.length(c) - F.length(F.regexp_replace(c, f"[{kind}]+", ""))
    df = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({
        "__size": F.length("__text"),
        "__words": F.filter(F.split("__text", r"\s+"), lambda w: w != ""),
        "__lines": F.filter(F.split("__text", "\n"), lambda x: x != ""),
        "__rest": F.regexp_replace("__text", r"[\p{L}\s]+", ""),
    }).withColumn("__n", F.size("__words"))
    df = df.withColumn("__lengths", F.transform(words, F.length))
    lengths = F.col("__lengths")
    values = {
        "words": n.cast("double"), "word_length": share(F.length(F.array_join(words, "")), n), "longest_word": F.coalesce(F.array_max(lengths), F.lit(0)).cast("double"),
        "short_words": share(F.size(F.filter(lengths, lambda x: x <= 2)), n),
        "distinct_words": share(F.size(F.array_distinct(words)), n),
        "bare_marks": share(F.regexp_count("__text", F.lit(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)")), n),
        "capitals": share(F.length(F.regexp_replace("__text", r"[^\p{Lu}]+", "")), size), "digits": share(count(rest, "0-9"), size), "stops": share(count(rest, ".!?"), n),
        "marks": share(F.length(F.regexp_replace(rest, r"[\p{N}.,;:!?'\"()-]+", "")), size),
        "lines": F.size(lines).cast("double"), "line_length": share(size, F.size(lines)), "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
    }
    return df.withColumn("__stats", F.struct(*[values[s].alias(s) for s in STATISTICS])).drop("__text", "__size", "__words", "__lines", "__rest", "__n", "__lengths")


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds (statistic, above, at most), none given twice, and its weight in the logit."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def column(self, stats: F.Column) -> F.Column:
        parts = [stats[s] > low for s, low, _ in self.bounds if low > -math.inf] + [stats[s] <= high for s, _, high in self.bounds if high < math.inf]
        return functools.reduce(lambda a, b: a & b, parts)

    def __str__(self) -> str:
        return " and ".join(f"{low:.6g} < {s} <= {high:.6g}" for s, low, high in self.bounds)


@dataclass(frozen=True)
class Model:
    """The rules that carry weight, and the logit without them."""

    rules: tuple[Rule, ...]
    intercept: float

    def logit(self, stats: F.Column) -> F.Column:
        return functools.reduce(lambda total, r: total + F.when(r.column(stats), r.weight).otherwise(0.0), self.rules, F.lit(self.intercept))


SPLIT = re.compile(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(description: str) -> list[Rule]:
    """The rules of all paths in the description of a forest, without repeats, in their order."""
    found: dict[Rule, None] = {}
    way: list[tuple[int, str, str, float]] = []
    for line in description.split("\n"):
        m = SPLIT.match(line)
        if not m:
            continue
        deep = len(m[1])
        way = [w for w in way if w[0] < deep] + [(deep, STATISTICS[int(m[2])], m[3], float(m[4]))]
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, side, value in way:
            low, high = bounds.get(name, (-math.inf, math.inf))
            bounds[name] = (low, min(high, value)) if side == "<=" else (max(low, value), high)
        found[Rule(tuple((s, *bounds[s]) for s in sorted(bounds)))] = None
    return list(found)


def sample(labels: DataFrame, doc_id: str, label: str, most: int) -> DataFrame:
    """(doc_id, label, weight): at most ``most`` labelled ids of each class, each with the number of all labelled ids that it stands for."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    return parts[0].unionByName(parts[1]).join(sizes, "label").select("doc_id", "label", (F.col("n") / F.least("n", F.lit(most))).alias("weight"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = SAMPLE_DOCS, penalty: float = PENALTY, seed: int = 13) -> Model:
    """Learns from the labelled documents of ``labels``; give only rows to learn from."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    chosen = written(sample(labels, doc_id, label, sample_docs))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 * sample_docs ids
    once = rows.groupBy("doc_id", "label", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    known = written(with_statistics(once).select("doc_id", "label", "weight", "__stats"))
    n = {r.label: (r.n, r.w) for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    total = sum(w for _, w in n.values())
    if len(n) < 2:
        good = n.get(1.0, (0, 0.0))[1]
        return Model((), math.log((good + 0.5) / (total - good + 0.5)))
    numbers = known.select("doc_id", "label", "weight", "__stats", array_to_vector(F.array(*[F.col("__stats")[s] for s in STATISTICS])).alias("features"))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=max(1, int(LEAST_SHARE * sum(k for k, _ in n.values()))), subsamplingRate=0.5,
        featureSubsetStrategy="0.5", weightCol="weight", seed=seed,
    ).fit(numbers.coalesce(FIT_TASKS))
    rules = paths(forest.toDebugString)
    if not rules:
        return Model((), math.log(n[1.0][1] / n[0.0][1]))
    held = numbers.select("label", "weight", array_to_vector(F.array(*[r.column(F.col("__stats")).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, weightCol="weight", maxIter=60, tol=1e-5).fit(written(held.coalesce(FIT_TASKS)))
    weights = lasso.coefficients.toArray()
    return Model(tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights, strict=True) if w), float(lasso.intercept))


def score(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Adds the probability of label 1."""
    logit = model.logit(F.col("__stats"))
    return with_statistics(df, text).withColumn(score, 1 / (1 + F.exp(-logit))).drop("__stats")


def explain(df: DataFrame, model: Model, text: str = "text", name: str = "reasons") -> DataFrame:
    """Adds the rules that hold for a text with their weights, the heaviest first."""
    each = [F.when(r.column(F.col("__stats")), F.struct(F.lit(str(r)).alias("rule"), F.lit(r.weight).alias("weight"))) for r in sorted(model.rules, key=lambda r: (-abs(r.weight), str(r)))]
    held = F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast("array<struct<rule:string,weight:double>>")
    return with_statistics(df, text).withColumn(name, held).drop("__stats")
