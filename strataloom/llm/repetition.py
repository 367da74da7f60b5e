"""Repeated content inside a document.

Method: weak supervision. Rules on repeated words, lines, sentences, paragraphs and short phrases vote repetitive, clean
or abstain; expectation-maximisation over the vote patterns estimates how accurate each rule is, and every document gets
the posterior probability of being repetitive. Documents are selected by that posterior, not by any rule; the limit is the
greatest at which no document of the share asked for is lost, found on the counts of the vote patterns of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.words import batch_words, codes, covered, earlier_same, portions
from strataloom.session import cut, spread

GRAM = 8


@dataclass(frozen=True)
class Rule:
    """Votes repetitive from ``high`` on, clean up to ``low``, abstains between and below ``least_words`` words."""

    measure: str
    low: float
    high: float
    least_words: int = 16


RULES = (
    Rule("word_share", 0.05, 0.25),
    Rule("line_share", 0.02, 0.30),
    Rule("sentence_share", 0.02, 0.30),
    Rule("paragraph_share", 0.01, 0.30, 40),
    Rule("phrase_share", 0.08, 0.35),
    Rule("top_phrase_share", 0.04, 0.15, 40),
)
MEASURES = [r.measure for r in RULES]
_ROUNDS = 200
_LINE, _SENTENCE, _PARAGRAPH = re.compile(r"\r\n?|\n"), re.compile(r"(?<=[.!?…])\s+|[\r\n]+"), re.compile(r"(?:\r\n?|\n)\s*(?:\r\n?|\n)")


def _piece_share(text: str | None, by: re.Pattern) -> float:
    """Share of characters in pieces that equal an earlier piece (case and outer blanks aside)."""
    if not text:
        return 0.0
    seen: set[str] = set()
    total = again = 0
    for piece in by.split(text):
        p = piece.strip().lower()
        if not p:
            continue
        total += len(p)
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 1):
        texts = batch.column(1).to_pylist()
        flat, starts = batch_words(texts)
        ids = codes(flat)
        length = np.diff(starts)

        def share(n: int, ids=ids, starts=starts, length=length) -> np.ndarray:
            mark = covered(len(ids), earlier_same(ids, starts, n)[0], n)
            sums = np.concatenate([[0], np.cumsum(mark)])
            return (sums[starts[1:]] - sums[starts[:-1]]) / np.maximum(length, 1)

        here, head = earlier_same(ids, starts, 3)
        top = np.zeros(len(texts))
        if len(here):
            heads, uses = np.unique(head, return_counts=True)
            owner = np.searchsorted(starts, heads, side="right") - 1
            np.maximum.at(top, owner, (uses + 1) * 3.0)
        values = {
            "word_share": share(GRAM),
            "line_share": [_piece_share(t, _LINE) for t in texts],
            "sentence_share": [_piece_share(t, _SENTENCE) for t in texts],
            "paragraph_share": [_piece_share(t, _PARAGRAPH) for t in texts],
            "phrase_share": share(4),
            "top_phrase_share": np.minimum(top / np.maximum(length, 1), 1.0) * (top > 6),
        }
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(length), *(pa.array(np.asarray(values[m], float)) for m in MEASURES)],
            names=["doc_id", "n_words", *MEASURES],
        )


def fit_votes(patterns: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Posterior of "repetitive" per vote pattern (1 repetitive, -1 clean, 0 abstain), by EM on their counts.

    Rules are independent given the class; an abstention says nothing. Accuracies start at 0.8 and stay above one half,
    which keeps the two classes from changing places. A pattern of abstentions only gets the prior.
    """
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns], float)
    counts = np.array([c for _, c in patterns], float)
    right = np.full((2, votes.shape[1]), 0.8)  # of repetitive, of clean documents
    prior = 0.2
    for _ in range(_ROUNDS):
        yes = np.where(votes > 0, right[0], np.where(votes < 0, 1 - right[0], 1)).prod(1) * prior
        no = np.where(votes < 0, right[1], np.where(votes > 0, 1 - right[1], 1)).prod(1) * (1 - prior)
        post = yes / (yes + no)
        w1, w0 = counts * post, counts * (1 - post)
        new = np.stack([
            ((votes > 0).T @ w1 + 0.8) / ((votes != 0).T @ w1 + 1),
            ((votes < 0).T @ w0 + 0.8) / ((votes != 0).T @ w0 + 1),
        ]).clip(0.51, 0.999)
        prior = float(np.clip((w1.sum() + 0.2) / (counts.sum() + 1), 1e-4, 1 - 1e-4))
        moved = np.abs(new - right).max()
        right = new
        if moved < 1e-9:
            break
    return {p: float(x) for (p, _), x in zip(patterns, post, strict=True)}


def fit_limit(counts: list[tuple[tuple[int, ...], int, int]], posterior: dict[tuple[int, ...], float]) -> float:
    """The greatest posterior limit that keeps every document of the share asked for; 0.5 where there is none.

    ``counts``: vote pattern, documents, and how many of them have that share.
    """
    return min((posterior[p] for p, _, sought in counts if sought), default=0.5)


def repetition(
    documents: DataFrame, key: str, text: str, least_words: int = GRAM * 2, least_share: float = 0.25
) -> DataFrame:
    """``doc_id, n_words``, the six measures, ``votes``, ``posterior`` and ``selected`` of every document.

    ``word_share`` is the share of words that lie in 8 consecutive words which also start earlier in the document,
    overlap allowed. Null, empty and word-less texts have shares of 0 and only abstaining rules; equal texts get equal
    values; a null key is kept. Texts of any length are measured whole. ``selected``: the posterior reaches the limit
    that ``fit_limit`` finds for a ``word_share`` of ``least_share`` in ``least_words`` words. The rules' votes make at
    most 729 patterns, of which the driver gets the counts.
    """
    slim = spread(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    kinds = ", ".join(["doc_id bigint", "n_words bigint", *(f"{m} double" for m in MEASURES)])
    measured = slim.mapInArrow(_measure, kinds)

    def vote(r: Rule):
        m = F.col(r.measure)
        return (
            F.when(F.col("n_words") < r.least_words, 0).when(m >= r.high, 1).when(m <= r.low, -1).otherwise(0)
        )

    voted = cut(measured.withColumn("votes", F.array(*(vote(r) for r in RULES))))
    sought = _sought(least_words, least_share)
    grouped = voted.groupBy("votes").agg(F.count("*").alias("n"), F.count_if(sought).alias("s")).collect()  # <= 729 rows
    counts = sorted((tuple(r["votes"]), r["n"], r["s"]) for r in grouped)
    fitted = fit_votes([(p, n) for p, n, _ in counts])
    limit = fit_limit(counts, fitted)
    table = documents.sparkSession.createDataFrame(
        [(list(p), x, x >= limit) for p, x in sorted(fitted.items())], "pattern array<int>, posterior double, selected boolean"
    )
    return voted.join(F.broadcast(table), F.col("votes") == F.col("pattern"), "left").drop("pattern")  # <= 729 rows


def _sought(least_words: int, least_share: float):
    return (F.col("n_words") >= least_words) & (F.col("word_share") >= least_share)


def repetitive(scored: DataFrame, least_words: int = GRAM * 2, least_share: float = 0.25) -> DataFrame:
    """Of the documents that the posterior selects, those that the exact measure confirms."""
    return scored.where(F.col("selected") & _sought(least_words, least_share))
