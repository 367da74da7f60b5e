"""Words of texts as integer arrays, batch by batch, for the Python side of the text operators."""

from __future__ import annotations

import re

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: A word is a maximal run of letters and digits of the lower-cased text.
WORD = re.compile(r"[^\W_]+")


def split_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def portions(batches: Iterator[pa.RecordBatch], column: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``most`` bytes of text, whole rows each, to bound a worker's memory."""
    for batch in batches:
        size = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64)
        piece = (np.cumsum(size) - size) // most
        edges = np.flatnonzero(np.diff(piece, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)


def batch_words(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """All words of the texts in a row, and the place of each text's first word, with the end added."""
    flat: list[str] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            flat += WORD.findall(t.lower())
        starts[i + 1] = len(flat)
    return flat, starts


def codes(flat: list[str]) -> np.ndarray:
    """Equal words have equal numbers within the batch."""
    if not flat:
        return np.zeros(0, np.int64)
    return pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64)


#: Odd multipliers of the mixing steps of SplitMix64, a public generator (fixed values).
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray | np.uint64) -> np.ndarray:
    x = np.atleast_1d(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the ``n`` numbers from each place on (for the places that have so many after them)."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(count, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)  # fixed value: the increment of SplitMix64
    for k in range(n):
        key = mix(key + ids[k : k + count].astype(np.uint64) + step)
    return key


def earlier_same(ids: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose ``n`` numbers also start earlier in the same text, and for each the first such place.

    Equal keys are confirmed number by number, so a clash of keys can't count as a repetition.
    """
    key = gram_keys(ids, n)
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = np.flatnonzero(text[: len(key)] == text[n - 1 :])
    key = mix(key[inside] + mix(text[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    fresh = np.concatenate([[True], k[1:] != k[:-1]])
    head = inside[order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]]
    here = inside[order]
    later = ~fresh
    here, head = here[later], head[later]
    same = text[here] == text[head]
    for j in range(n):
        same &= ids[here + j] == ids[head + j]
    return here[same], head[same]


def covered(length: int, places: np.ndarray, n: int) -> np.ndarray:
    """Which of ``length`` words lie in a gram of ``n`` that starts at one of ``places``."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + n, -1)
    return np.cumsum(edge[:-1]) > 0
