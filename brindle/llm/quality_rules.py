"""Quality rules: text statistics in built-in functions, fixed base rules, and a learned decision list.

The decision list is learned by sequential covering.  Labelled rows (at most ``MAX_LABELLED``, the first by a hash of their id)
are reduced in Spark to statistics: the quantiles of each feature among rejected documents give the thresholds, and counts
per cell of binned features and fold give what the search needs.  The search grows a conjunction of threshold conditions that
gains most information on the growing fold, prunes its last conditions on the other fold, keeps it if it is precise enough
there, removes the rows it covers and goes on.  The result is an ordered Spark conditional expression: the first rule that
holds rejects a document, and a document that no rule covers is kept.

Everything that runs over documents is a built-in function: no UDF, pandas, Arrow or RDD code.

Defined cases.  Null and empty texts have no words: all counts 0, base_failed; a null id is judged like any other.  Null labels and labels of
unknown documents are ignored; several labels of one document count as one (rejected if any says so).  Without labels the list is empty and the base rules
decide.  Ties: of conditions that gain alike the first in the order of FEATURES, at-least before less-than, lowest threshold; of labelled rows with
equal hashes the smaller id.  Repeated rows are judged separately and alike.  Texts of any length are judged whole; a row's arrays are in proportion to its
text.  Empty tables give no rows.  Columns named like a statistic are not overwritten: statistics carry a prefix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import WORD_SEPARATORS, cut, drop_cut

#: The bound on the labelled rows that a list is learned from.
MAX_LABELLED = 20_000
QUANTILES = 48
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "capital_ratio")


def with_counts(df: DataFrame, text: str = "text", p: str = "q_") -> DataFrame:
    """``df`` and the counts of COUNTS, ``n_lines`` and ``n_capitals``, each named with the prefix ``p``.

    Repeated 3-word windows are found inside the row.  Each window's 64-bit hash is shifted left and its position put in the
    low bits, so sorting plain longs brings equal windows together; windows whose hash bits are shared are then compared as
    text, and the words under the repeated ones are counted once each.
    """
    c = lambda name: F.col(f"{p}{name}")
    ws = F.lit(" \t\n\x0b\f\r")
    df = df.withColumn(f"{p}text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(f"{p}words", F.when(F.length(F.btrim(c("text"), ws)) == 0, F.array().cast("array<string>")).otherwise(F.split(F.btrim(c("text"), ws), WORD_SEPARATORS)))
    df = df.withColumn(f"{p}lines", F.filter(F.split(c("text"), "\n"), lambda x: x.rlike(r"[^ \t\n\u000B\f\r]")))
    df = df.withColumns(
        {
            f"{p}n_words": F.size(c("words")).cast("long"),
            f"{p}word_chars": F.length(F.array_join(c("words"), "")).cast("long"),
            f"{p}n_symbols": F.length(F.regexp_replace(c("text"), r"[^#*$%&|<>]+", "")).cast("long"),
            f"{p}n_capitals": F.length(F.regexp_replace(c("text"), r"[^A-Z]+", "")).cast("long"),
            f"{p}n_lines": F.size(c("lines")).cast("long"),
            f"{p}n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
            f"{p}bits": F.length(F.bin(F.size(c("words")).cast("long"))),
        }
    )
    window = f"concat_ws(' ', {p}words[int(i)], {p}words[int(i) + 1], {p}words[int(i) + 2])"
    df = df.withColumn(f"{p}keys", F.expr(f"if({p}n_words >= 4, sort_array(transform(sequence(0, int({p}n_words) - 3), i -> shiftleft(xxhash64({window}), {p}bits) | bigint(i))), array())"))
    shared = f"""if(size({p}keys) >= 2, array_distinct(flatten(filter(zip_with(slice({p}keys, 1, size({p}keys) - 1), slice({p}keys, 2, size({p}keys) - 1),
        (a, b) -> if(shiftright(a, {p}bits) = shiftright(b, {p}bits), array(a, b), null)), x -> x is not null))), array())"""
    df = df.withColumn(f"{p}shared", F.expr(shared))
    named = f"sort_array(transform({p}shared, k -> struct({window.replace('int(i)', f'int(k & (shiftleft(1L, {p}bits) - 1))')} as t, int(k & (shiftleft(1L, {p}bits) - 1)) as at)))"
    df = df.withColumn(f"{p}named", F.expr(named))
    starts = f"""if(size({p}named) >= 2, sort_array(array_distinct(flatten(filter(zip_with(slice({p}named, 1, size({p}named) - 1), slice({p}named, 2, size({p}named) - 1),
        (a, b) -> if(a.t = b.t, array(a.at, b.at), null)), x -> x is not null)))), array())"""
    df = df.withColumn(f"{p}starts", F.expr(starts))
    covered = f"""if(size({p}starts) = 0, 0L, 3L + aggregate(zip_with(slice({p}starts, 1, size({p}starts) - 1), slice({p}starts, 2, size({p}starts) - 1), (a, b) -> bigint(least(3, b - a))), 0L, (s, x) -> s + x))"""
    # A filter on a count would be pushed below all of this, with every array expression copied into its lambdas.  A column
    # that isn't deterministic by its form (its value is) keeps filters above.
    df = df.withColumn(f"{p}n_repeat_words", F.when(F.spark_partition_id() >= 0, F.expr(covered)).otherwise(F.lit(0)))
    return df.drop(*[f"{p}{x}" for x in ("text", "words", "lines", "bits", "keys", "shared", "named", "starts")])


def feature(name: str, p: str = "q_") -> Column:
    c = lambda x: F.col(f"{p}{x}").cast("double")
    words = F.greatest(c("n_words"), F.lit(1.0))
    return {
        "word_length": c("word_chars") / words,
        "symbol_ratio": c("n_symbols") / words,
        "dup_line_ratio": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1.0)),
        "repeat_ratio": c("n_repeat_words") / words,
        "capital_ratio": c("n_capitals") / F.greatest(c("word_chars"), F.lit(1.0)),
    }[name]


def base_failed(p: str = "q_") -> Column:
    n = F.col(f"{p}n_words")
    return (n < 50) | (100 * F.col(f"{p}n_repeat_words") > 50 * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, p: str = "q_") -> Column:
        x = feature(self.feature, p)
        return x >= F.lit(self.threshold) if self.at_least else x < F.lit(self.threshold)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; each is a conjunction that rejects."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def rejects(self, p: str = "q_") -> Column:
        out: Column | None = None
        for rule in self.rules:
            held = rule[0].column(p)
            for x in rule[1:]:
                held = held & x.column(p)
            out = F.when(held, F.lit(True)) if out is None else out.when(held, F.lit(True))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))


def cover(cells: list[tuple], thresholds: dict[str, list[float]], min_precision: float = 0.95, min_covered: int = 5, max_conditions: int = 4) -> DecisionList:
    """Sequential covering over cell counts.  A cell: the bin of each feature, then rejected and kept rows of the growing and of the pruning fold.

    A row is in bin b of a feature if b of its thresholds are at or below its value.
    """
    if not cells:
        return DecisionList()
    bins = np.array([c[: len(FEATURES)] for c in cells], dtype=np.int64)
    counts = np.array([c[len(FEATURES) :] for c in cells], dtype=float)
    left, rules = np.ones(len(cells), bool), []

    def gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
        return p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - math.log2(p0 / (p0 + n0)))

    def held(rule: list[Condition]) -> np.ndarray:
        on = np.ones(len(cells), bool)
        for x in rule:
            b = bins[:, FEATURES.index(x.feature)]
            k = thresholds[x.feature].index(x.threshold)
            on &= b > k if x.at_least else b <= k
        return on

    def worth(rule: list[Condition]) -> tuple[float, float, float]:
        p, n = counts[left & held(rule)][:, 2:].sum(axis=0) if rule else counts[left][:, 2:].sum(axis=0)
        return (p - n) / max(p + n, 1.0), p, n

    while counts[left][:, 0].sum() >= min_covered:
        rule: list[Condition] = []
        on = left.copy()
        while len(rule) < max_conditions:
            p0, n0 = counts[on][:, 0].sum(), counts[on][:, 1].sum()
            if n0 == 0 or p0 == 0:
                break
            best: tuple[float, Condition | None] = (1e-9, None)
            for f, name in enumerate(FEATURES):
                m = len(thresholds[name])
                if not m:
                    continue
                below = np.cumsum([np.bincount(bins[on, f], weights=counts[on, j], minlength=m + 1)[:m] for j in (0, 1)], axis=1)
                for at_least in (True, False):
                    p, n = (p0 - below[0], n0 - below[1]) if at_least else (below[0], below[1])
                    g = np.where(p >= 1, gain(p, n, p0, n0), -1.0)
                    if g.max() > best[0]:
                        best = (float(g.max()), Condition(name, at_least, thresholds[name][int(g.argmax())]))
            if best[1] is None:
                break
            rule.append(best[1])
            on = left & held(rule)
        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule.pop()
        _, p, n = worth(rule)
        grown = counts[left & held(rule)][:, :2].sum(axis=0) if rule else np.zeros(2)
        if not rule or p + n == 0 or p / (p + n) < min_precision or grown[0] / max(grown.sum(), 1) < min_precision or grown[0] < min_covered:
            break
        rules.append(tuple(rule))
        left &= ~held(rule)
    return DecisionList(tuple(rules))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """A decision list from (doc_id, text) and (doc_id, quality): quality 0 is what is to be rejected."""
    said = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.min("quality") == 0).alias("bad"))
    said = said.withColumn("draw", F.xxhash64("label_id")).orderBy("draw", "label_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(F.broadcast(said), "label_id")
    rows = with_counts(rows).where(~base_failed())
    rows = cut(spark, rows.select("bad", (F.pmod("draw", F.lit(3)) == 0).alias("prune"), *[feature(x).alias(x) for x in FEATURES]))
    at = F.lit([(i + 0.5) / QUANTILES for i in range(QUANTILES)])
    found = rows.where("bad").agg(*[F.percentile(x, at).alias(x) for x in FEATURES], *[F.min(x).alias(f"least_{x}") for x in FEATURES]).first()
    clean = rows.where("not bad").agg(*[F.percentile(x, at).alias(x) for x in FEATURES], *[F.max(x).alias(f"most_{x}") for x in FEATURES]).first()
    thresholds = {x: sorted({*(found[x] or []), *(clean[x] or []), *(v for v in (found[f"least_{x}"],) if v is not None)}) for x in FEATURES}
    # a threshold between the classes' values, where they meet, leaves a margin to what is clean
    for x in FEATURES:
        top = clean[f"most_{x}"]
        above = [t for t in thresholds[x] if top is not None and t > top]
        if above:
            thresholds[x] = sorted({*thresholds[x], (top + above[0]) / 2})
    bins = [sum((F.when(F.col(x) >= F.lit(t), 1).otherwise(0) for t in thresholds[x]), F.lit(0)).alias(f"b_{x}") for x in FEATURES]
    count = lambda bad, prune: F.sum(F.when((F.col("bad") == bad) & (F.col("prune") == prune), 1).otherwise(0))
    cells = rows.select("bad", "prune", *bins).groupBy(*[f"b_{x}" for x in FEATURES]).agg(count(True, False), count(False, False), count(True, True), count(False, True)).collect()
    drop_cut(spark, rows)
    return cover([tuple(c) for c in sorted(cells)], thresholds)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", p: str = "q_") -> DataFrame:
    """``docs`` with the counts, ``{p}base_failed`` and ``{p}kept``."""
    out = with_counts(docs, text, p).withColumn(f"{p}base_failed", base_failed(p))
    return out.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & ~rules.rejects(p))


def digest(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every (doc_id, text)."""
    out = judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules)
    return out.select("doc_id", *[F.col(f"q_{x}").alias(x) for x in (*COUNTS, "base_failed", "kept")])


def filter_stage(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``docs`` for the documents that are kept."""
    return judge(docs, learn(spark, docs, labels), p="quality_rules_").where("quality_rules_kept").select(*docs.columns)
