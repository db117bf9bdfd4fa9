"""Quality rules as weak supervision.

Each rule looks at one measured trait of a document and votes good, votes bad or abstains. Expectation-
maximisation over the counts of vote patterns estimates how each rule votes on good and on bad documents,
and the posterior probability of good quality takes the place of a filter that all rules must pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, words_of

_SYMBOLS = b"#*$%&|<>"
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Traits measured for each document.
TRAITS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_shouts", "n_ends")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more among words, the first time included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    x = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    if v == n:
        return 0
    pair = x[:-1] * v + x[1:]
    if v >= 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, back, count = np.unique(pair[:-1] * v + x[2:], return_inverse=True, return_counts=True)
    hit = count[back] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def traits_of(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = words_of(raw)
    if not words:
        return (0,) * len(TRAITS)
    points = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters, capitals = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    return (len(words), points, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines), letters, capitals, raw.count(b"!"), ends)


def measured(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with the TRAITS as longs, and without its text unless keep_text; null and wordless texts measure zero throughout."""
    others = [c for c in docs.columns if c != text_col]
    names = [f"__k{i}" for i in range(len(others))]
    slim = docs.select(*(docs[c].alias(n) for c, n in zip(others, names, strict=True)), docs[text_col].alias("__text"))
    kept = slim.schema.fields if keep_text else slim.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([traits_of(t.as_py()) for t in b.column(b.num_columns - 1)], np.int64).reshape(-1, len(TRAITS))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *(pa.array(got[:, i]) for i in range(len(TRAITS)))], names=[*(f.name for f in kept), *TRAITS])

    out = T.StructType([*kept, *(T.StructField(t, T.LongType()) for t in TRAITS)])
    return slim.mapInArrow(run, out).withColumnsRenamed(dict(zip([*names, "__text"], [*others, text_col], strict=True)))


@dataclass(frozen=True)
class Rule:
    """Looks at over / by: votes bad at bad or beyond, good at good or beyond, else abstains.

    Beyond means upwards for bad where bad > good or good is None, downwards otherwise; a rule without
    a good bound is a detector, which never speaks for a document. Below least of by it abstains.
    """

    over: str
    by: str
    bad: float | None
    good: float | None = None
    least: int = 1

    def vote(self) -> Column:
        ratio = F.col(self.over) / F.col(self.by)
        up = self.good is None or (self.bad is not None and self.bad > self.good)
        votes = F.when(F.col(self.by) < self.least, 1)
        if self.bad is not None:
            votes = votes.when(ratio >= self.bad if up else ratio <= self.bad, 0)
        if self.good is not None:
            votes = votes.when(ratio <= self.good if up else ratio >= self.good, 2)
        return votes.otherwise(1)


RULES = (
    Rule("n_symbols", "n_words", bad=0.1),
    Rule("n_repeat_words", "n_words", bad=0.35),
    Rule("n_dup_lines", "n_lines", bad=0.4, least=3),
    Rule("n_upper", "n_letters", bad=0.4),
    Rule("n_shouts", "n_words", bad=0.2),
    Rule("word_chars", "n_words", bad=14.0),
    Rule("n_letters", "word_chars", bad=0.8, good=0.94),
    Rule("n_ends", "n_lines", bad=None, good=0.8),
)


def vote_pattern(rules: tuple[Rule, ...] = RULES) -> Column:
    """The votes as one number in base 3: 0 bad, 1 abstains, 2 good."""
    total = F.lit(0)
    for r in rules:
        total = total * 3 + r.vote()
    return total.cast("int")


def fit_votes(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 100) -> np.ndarray:
    """Posterior of good quality for each vote pattern.

    The hidden class of a document is good or bad, and a rule casts a bad or a good vote at one rate on
    bad documents and at another on good ones; abstaining says nothing. Rates and the share of good
    documents are estimated in turn with the posterior, which starts from a bad vote weighing 30 to 1
    and a good vote 3 to 1. A vote never speaks for the other side, which keeps the classes from
    changing places, none weighs over 1000 to 1, and the share of good documents stays between a half
    and 0.95, so that a document on which all rules abstain is not held to be bad.
    """
    votes = np.stack([patterns // 3**k % 3 for k in range(n_rules)][::-1], axis=1)
    weight = counts.astype(np.float64)
    bad, good = (votes == 0).astype(np.float64), (votes == 2).astype(np.float64)
    against, favour, share = np.full(n_rules, np.log(30)), np.full(n_rules, np.log(3)), 0.9
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-(np.log(share / (1 - share)) - bad @ against + good @ favour)))
        on_bad, on_good = weight * (1 - post), weight * post
        rate = lambda on, votes: (on @ votes + 0.1) / (on.sum() + 1)
        against = np.clip(np.log(rate(on_bad, bad) / rate(on_good, bad)), np.log(2), np.log(1000))
        favour = np.clip(np.log(rate(on_good, good) / rate(on_bad, good)), 0, np.log(1000))
        share = float(np.clip((on_good.sum() + 9) / (weight.sum() + 10), 0.5, 0.95))
    return post


def _p_good(rows: DataFrame) -> Column:
    """The posterior of each row's pattern, fitted to the counts of patterns over all rows: at most 3 ** len(RULES) of them."""
    found = rows.groupBy("pattern").count().orderBy("pattern").collect()
    if not found:
        return F.lit(None).cast("double")
    post = fit_votes(np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64), len(RULES))
    return F.create_map(*(F.lit(x) for r, p in zip(found, post, strict=True) for x in (r[0], float(p))))[F.col("pattern")]


def _judged(rows: DataFrame, p_good: Column, threshold: float, min_words: int, max_repeat_share: int) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_share * F.col("n_words"))
    return rows.withColumn("p_good", p_good).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= threshold))


def quality_verdicts(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, min_words: int = 50, max_repeat_share: int = 50) -> DataFrame:
    """docs without its text, with the traits, base_failed, p_good and kept.

    base_failed: fewer than min_words words, or over max_repeat_share percent of the words in repeated
    3-word windows. kept: not base_failed and p_good >= threshold. Null and wordless texts fail. Columns
    of docs that clash with these names go. The hidden-class model is the same for every row, so
    repeated rows get equal verdicts; an empty table gives an empty result.
    """
    clash = {*TRAITS, "pattern", "p_good", "base_failed", "kept"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in clash and c != text_col])
    rows = materialize(measured(docs, text_col).withColumn("pattern", vote_pattern()), "quality-traits")
    return _judged(rows, _p_good(rows), threshold, min_words, max_repeat_share)


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, min_words: int = 50, max_repeat_share: int = 50) -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with all their columns.

    The texts are read twice, to count patterns and to judge, which spares a shuffle of them.
    """
    inner = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__own"))
    patterns = measured(docs.select(text_col), text_col).select(vote_pattern().alias("pattern"))
    p_good = _p_good(patterns)
    rows = measured(inner, "__own").withColumn("pattern", vote_pattern())
    return _judged(rows, p_good, threshold, min_words, max_repeat_share).where("kept").select("__row.*")
