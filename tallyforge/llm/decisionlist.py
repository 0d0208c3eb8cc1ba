"""Quality rules as a learned decision list over counts of whole texts.

Sequential covering: a rule is a conjunction of thresholds on ratios, grown
condition by condition on two thirds of the labelled rows for the most
information gained about junk, then pruned from its end on the other third.
Its rows are taken out and the next rule is grown, until none is precise enough.  The list
becomes one ordered Spark conditional expression; what no rule takes is kept.

Base rules come first: fewer than 10 words, or more than a fifth of the words in
five-word windows that the text has twice or more, fail.  Null texts have no words.
Rows are judged one by one, repeated and null ids included, very long texts whole; an empty table gives none,
and columns with this module's own names don't matter.  Without labels only the base rules hold;
documents with contradictory labels are judged, but not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm import textstats as S
from tallyforge.llm.common import bounded_batches
from tallyforge.llm.samples import agreed, sample_by_class

#: Labelled rows of each quality that fitting takes, about.
EACH = 6000
#: Of the rows a rule takes in pruning, so many must be junk.
PRECISION = 0.9
LEAST = 5
#: Conditions of a rule and rules of a list at most, so that a list can be read; pruning and precision mostly end both sooner.
CONDITIONS, RULES = 4, 24
#: Ratios that rules may use, as (name, numerator, denominator).
RATIOS = (
    ("words", "n_words", None),
    ("chars_a_word", "word_chars", "n_words"),
    ("symbols_a_word", "n_symbols", "n_words"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("distinct_share", "n_distinct", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("marks_a_word", "n_marks", "n_words"),
    ("words_a_line", "n_words", "n_lines"),
)


@dataclass(frozen=True)
class Condition:
    ratio: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.ratio] >= self.threshold if self.above else x[:, self.ratio] <= self.threshold

    def column(self) -> Column:
        _, over, under = RATIOS[self.ratio]
        value = F.col(over).cast("double") / (F.greatest(F.col(under), F.lit(1)) if under else F.lit(1))
        return value >= self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{RATIOS[self.ratio][0]} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: np.ndarray, junk: np.ndarray) -> Rule:
    """Conditions that gain most, until a rule takes nothing but junk or nothing gains."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < CONDITIONS:
        p, n = junk[inside].sum(), (~junk[inside]).sum()
        if not p or not n:
            break
        start, best = np.log2(p / (p + n)), (1e-9, None)
        own, bad = x[inside], junk[inside]
        for k in range(x.shape[1]):
            for t in np.unique(np.quantile(own[:, k], np.linspace(0.01, 0.99, 50))):
                for above in (True, False):
                    got = own[:, k] >= t if above else own[:, k] <= t
                    q = bad[got].sum()
                    if q >= LEAST:
                        gain = q * (np.log2(q / got.sum()) - start)
                        if gain > best[0]:
                            best = (gain, Condition(k, above, float(t)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def prune(rule: Rule, x: np.ndarray, junk: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule that is worth most on rows it wasn't grown on."""
    best: tuple[float, Rule, float, int] = (-2.0, rule, 0.0, 0)
    for size in range(len(rule), 0, -1):
        got = covers(rule[:size], x)
        p, n = int(junk[got].sum()), int((~junk[got]).sum())
        worth = (p - n) / max(1, p + n)
        if worth > best[0] + 1e-9:
            best = (worth, rule[:size], p / max(1, p + n), p)
    return best[1], best[2], best[3]


def learn(x: np.ndarray, junk: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """Ordered rules that take junk, from ratios (rows by RATIOS) and a flag a row."""
    order = np.random.default_rng(5).permutation(len(x))
    x, junk = x[order], junk[order]
    third = np.arange(len(x)) % 3 == 0
    rules: list[Rule] = []
    while junk[~third].sum() >= LEAST and len(rules) < RULES:
        rule = grow(x[~third], junk[~third])
        if not rule:
            break
        rule, sure, p = prune(rule, x[third], junk[third])
        if sure < precision or not p:
            break
        rules.append(rule)
        left = ~covers(rule, x)
        x, junk, third = x[left], junk[left], third[left]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: false where the first rule that applies takes junk."""
    out = None
    for rule in rules:
        every = rule[0].column()
        for c in rule[1:]:
            every = every & c.column()
        out = F.when(every, F.lit(False)) if out is None else out.when(every, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", each: int = EACH) -> list[Rule]:
    """Rules from a sample of labelled rows that aren't held out; base failures are left to the base rules."""
    chosen = sample_by_class(agreed(labels, label_col), "label", "doc_id", each).select(F.col("doc_id").alias("of_doc"), "label")
    chosen = F.broadcast(chosen)  # 2.6 times ``each`` rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(chosen, F.col("doc_id") == F.col("of_doc"))
    counted = rows.select("doc_id", "text").mapInArrow(K.lean(S.batches_of_counts), S.SCHEMA).where(~base_failed()).distinct()
    found = counted.join(chosen, F.col("doc_id") == F.col("of_doc")).orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id", *S.COUNTS).limit(4 * each).toPandas()
    x = np.stack([found[over].to_numpy() / (np.maximum(found[under].to_numpy(), 1) if under else 1) for _, over, under in RATIOS], axis=1).astype(np.float64)
    return learn(x, found["label"].to_numpy() == 0)


def judge(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, base_failed, kept of every row; no shuffle."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(K.lean(S.batches_of_counts), S.SCHEMA)
    rows = rows.withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))
