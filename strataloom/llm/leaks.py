"""Passages of evaluation items inside a corpus.

Method: a BM25 inverted index of the items, its postings cut into blocks that know their greatest impact, searched with
block-max WAND. Terms are three words in a row, as single words say little of a passage. Every passage of every document is a
query. Of its terms in ascending order of their greatest impact, those before the pivot, whose impacts together stay below
the threshold, open no candidate; the others' blocks do. The bound of a candidate block is summed from the strongest term to
the weakest and given up where what is left can't reach the threshold; blocks that reach it are scored in full, and what
passes is verified word by word.

A passage is 2n words long and starts every n words, so each run of n words lies in one. The threshold of an item is the
least that the terms of any of its own runs of n words add to the score. All weights are positive, so a passage that holds
a run of the item reaches the threshold: nothing is lost by the search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.words import batch_words, gram_keys, mix, portions, split_words
from strataloom.session import spread

RUN, TERM, BLOCK = 12, 3, 16
#: Bytes of one index about, which every Python worker holds; beyond that the items are cut into shards, each with a pass
#: over the corpus. Bytes of an index per character of its items, at most about (measured, see the tests).
INDEX_BYTES, BYTES_PER_CHAR = 128_000_000, 14
#: Block entries that are looked at together.
_ENTRIES = 2_000_000
_SLACK = 1e-4


@dataclass
class ItemIndex:
    """Impacts of each term in each item, divided by the item's threshold, so that the threshold is 1 for all.

    ``numbers`` are those of the words, ``terms`` the keys of the terms in order. ``items`` and ``impact`` are the
    postings by term and item. A block entry stands for a term's postings in one block of items: ``keys`` (term times
    blocks, plus block), ``block_top`` its greatest impact, ``first`` its first posting; ``rows`` are the first entries of
    each term, ``top`` a term's greatest impact. ``text`` holds the words of all items in a row, ``run_keys`` and
    ``run_at`` the keys of the runs in each item and their places.
    """

    numbers: dict[str, int]
    item_ids: np.ndarray
    terms: np.ndarray
    items: np.ndarray
    impact: np.ndarray
    keys: np.ndarray
    block_top: np.ndarray
    first: np.ndarray
    rows: np.ndarray
    top: np.ndarray
    text: np.ndarray
    run_keys: np.ndarray
    run_at: np.ndarray
    blocks: int

    @property
    def nbytes(self) -> int:
        """Bytes of the arrays, and about 120 of each word and its number."""
        return sum(a.nbytes for a in vars(self).values() if isinstance(a, np.ndarray)) + 120 * len(self.numbers)

    def coded(self, flat: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of texts in a row, and of the terms that begin at them; what no item has gets the number
        after the last."""
        get, unknown = self.numbers.get, len(self.numbers)
        words = np.fromiter((get(w, unknown) for w in flat), np.int64, len(flat))
        terms = np.full(len(words), len(self.terms), np.int64)
        known = np.concatenate([[0], np.cumsum(words == unknown)])
        size = max(0, len(words) - TERM + 1)
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        whole = np.flatnonzero((known[TERM:] == known[:size]) & (text[:size] == text[TERM - 1 :])) if size else np.zeros(0, np.int64)
        keys = gram_keys(words[whole[:, None] + np.arange(TERM)].ravel(), TERM)[::TERM]
        at = np.minimum(np.searchsorted(self.terms, keys), len(self.terms) - 1)
        terms[whole] = np.where(self.terms[at] == keys, at, len(self.terms))
        return words, terms


def build_index(items: list[tuple[int, str]], n: int = RUN, k1: float = 1.2, b: float = 0.75) -> ItemIndex | None:
    """Index of the items that have at least ``n`` words; None if there are none."""
    texts = [(i, w) for i, t in sorted(items) if len(w := split_words(t)) >= n]
    if not texts:
        return None
    numbers: dict[str, int] = {}
    coded = [np.array([numbers.setdefault(x, len(numbers)) for x in w], np.int32) for _, w in texts]
    text_of = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
    term_keys = [gram_keys(c, TERM) for c in coded]
    terms, flat = np.unique(np.concatenate(term_keys), return_inverse=True)
    length = np.array([len(k) for k in term_keys])
    numbered = np.split(flat.astype(np.int32), np.cumsum(length)[:-1])
    pairs = [np.unique(c, return_counts=True) for c in numbered]
    df = np.zeros(len(terms), np.int64)
    for mine, _ in pairs:
        df[mine] += 1
    idf = np.log(1 + (len(coded) - df + 0.5) / (df + 0.5))
    term_of, item_of, weight, keys, runs = [], [], [], [], []
    for i, (c, t, (mine, uses)) in enumerate(zip(coded, numbered, pairs, strict=True)):
        w = idf[mine] * uses * (k1 + 1) / (uses + k1 * (1 - b + b * length[i] / length.mean()))
        sums = np.concatenate([[0], np.cumsum(w[np.searchsorted(mine, t)])])
        span = n - TERM + 1
        term_of.append(mine)
        item_of.append(np.full(len(mine), i, np.int32))
        weight.append((w / (sums[span:] - sums[:-span]).min()).astype(np.float32))
        own, where = np.unique(gram_keys(c, n), return_index=True)
        keys.append(_item_keys(own, i))
        runs.append((where + text_of[i]).astype(np.int32))
    term, item, impact = (np.concatenate(x) for x in (term_of, item_of, weight))
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    v, blocks = len(terms), -(-len(coded) // BLOCK)
    entry = term.astype(np.int64) * blocks + item // BLOCK
    first = np.flatnonzero(np.diff(entry, prepend=-1))
    block_top = np.maximum.reduceat(impact, first)
    block_keys = entry[first]
    rows = np.searchsorted(block_keys, np.arange(v + 2) * blocks).astype(np.int32)
    top = np.zeros(v + 1, np.float32)  # the last one is for terms of no item
    np.maximum.at(top, block_keys // blocks, block_top)
    run_keys, run_at = np.concatenate(keys), np.concatenate(runs)
    by = np.argsort(run_keys, kind="stable")
    return ItemIndex(
        numbers, np.array([i for i, _ in texts]), terms, item, impact, block_keys, block_top, np.append(first, len(item)).astype(np.int32),
        rows, top, np.concatenate(coded), run_keys[by], run_at[by], blocks,
    )


def _item_keys(keys: np.ndarray, items: np.ndarray | int) -> np.ndarray:
    """Keys of runs within items."""
    return mix(keys ^ mix(np.asarray(items).astype(np.uint64) + np.uint64(1)))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) for all places of the ranges [lo, hi)."""
    many = hi - lo
    which = np.repeat(np.arange(len(lo)), many)
    return which, np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())


def retrieve(index: ItemIndex, terms: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of a passage, item) for all passages that reach the item's threshold.

    ``terms`` are numbers of terms by the word that begins them, for texts in a row.
    """
    length = np.diff(starts)
    many = np.where(length >= n, np.maximum(1, -(-(length - n) // n)), 0)
    text, step = _ranges(np.zeros(len(length), np.int64), many)
    at = starts[text] + step * n
    end = np.minimum(at + 2 * n, starts[text + 1]) - TERM + 1
    # bound over all items
    sums = np.concatenate([[0], np.cumsum(index.top[terms], dtype=np.float64)])
    keep = np.flatnonzero(sums[end] - sums[at] >= 1 - _SLACK)
    at, end = at[keep], end[keep]
    out = []
    for lo in range(0, len(at), 8192):
        out += _wand(index, terms, at[lo : lo + 8192], end[lo : lo + 8192], 2 * n - TERM + 1)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _wand(index: ItemIndex, terms: np.ndarray, at: np.ndarray, end: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    none = len(index.top) - 1
    place = at[:, None] + np.arange(size)
    term = np.where(place < end[:, None], terms[np.minimum(place, len(terms) - 1)], none)
    # the strongest terms first
    term = np.take_along_axis(term, np.argsort(-index.top[term], axis=1, kind="stable"), 1)
    tops = index.top[term].astype(np.float64)
    left = tops[:, ::-1].cumsum(1)[:, ::-1]  # of a term and all weaker ones
    opens = (left >= 1 - _SLACK) & (tops > 0)
    many = np.where(opens, index.rows[term + 1] - index.rows[term], 0).sum(1)
    part = np.cumsum(many) // _ENTRIES
    left = np.concatenate([left, np.zeros((len(left), 1))], 1)
    for k in np.unique(part):
        p, j = np.nonzero(opens & (part == k)[:, None])
        w = term[p, j]
        which, entry = _ranges(index.rows[w].astype(np.int64), index.rows[w + 1].astype(np.int64))
        pair = np.unique(p[which] * index.blocks + index.keys[entry] % index.blocks)
        p, block = pair // index.blocks, pair % index.blocks
        bound = np.zeros(len(p))
        for j in range(size):
            key = term[p, j] * index.blocks + block
            e = np.minimum(np.searchsorted(index.keys, key), len(index.keys) - 1)
            bound += np.where(index.keys[e] == key, index.block_top[e], 0)
            alive = bound + left[p, j + 1] >= 1 - _SLACK
            if not alive.all():
                p, block, bound = p[alive], block[alive], bound[alive]
        if not len(p):
            continue
        key = term[p].astype(np.int64) * index.blocks + block[:, None]
        e = np.minimum(np.searchsorted(index.keys, key.ravel()), len(index.keys) - 1)
        hit = np.flatnonzero(index.keys[e] == key.ravel())
        which, posting = _ranges(index.first[e[hit]].astype(np.int64), index.first[e[hit] + 1].astype(np.int64))
        slot = (hit // size)[which] * BLOCK + index.items[posting] % BLOCK
        score = np.bincount(slot, index.impact[posting], len(p) * BLOCK)
        good = np.flatnonzero(score >= 1 - _SLACK)
        yield at[p[good // BLOCK]], block[good // BLOCK] * BLOCK + good % BLOCK


def verify(index: ItemIndex, ids: np.ndarray, starts: np.ndarray, at: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """(text, item) pairs of the retrieved passages that do share ``n`` consecutive words."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    text = np.searchsorted(starts, at, side="right") - 1
    places = at[:, None] + np.arange(n + 1)
    inside = places + n <= starts[text + 1][:, None]
    owner, places = np.nonzero(inside)[0], places[inside]
    here, back = np.unique(places, return_inverse=True)
    near = ids[here[:, None] + np.arange(n)]
    key = _item_keys(gram_keys(near.ravel(), n)[::n][back], item[owner])
    run = np.minimum(np.searchsorted(index.run_keys, key), len(index.run_keys) - 1)
    hit = np.flatnonzero(index.run_keys[run] == key)
    owner, back, run = owner[hit], back[hit], index.run_at[run[hit]].astype(np.int64)
    same = (near[back] == index.text[run[:, None] + np.arange(n)]).all(1)
    owner = owner[same]
    return np.unique(np.stack([text[owner], item[owner]], 1), axis=0)


def _search(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in portions(batches, 1):
            flat, starts = batch_words(batch.column(1).to_pylist())
            if not flat:
                continue
            words, terms = index.coded(flat, starts)
            pairs = verify(index, words, starts, *retrieve(index, terms, starts, n), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(pairs[:, 0])), pa.array(index.item_ids[pairs[:, 1]], pa.int64())],
                names=["doc_id", "item_id"],
            )

    return run


def leaks(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, n: int = RUN,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """``doc_id, item_id``: documents that hold at least ``n`` consecutive words of an item; each pair once.

    Null or empty texts, and items shorter than ``n`` words, match nothing; repeated documents are found each, a
    repeated item id counts with each of its texts. Only items reach the driver, as many at a time as make an index of
    about ``index_bytes``, the size of what is broadcast.
    """
    spark = documents.sparkSession
    corpus = spread(
        documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    )
    asked = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("t")).where(
        "id is not null and t is not null"
    )
    chars = asked.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    shards = max(1, -(-chars * BYTES_PER_CHAR // index_bytes))
    out = None
    for k in range(shards):
        mine = asked if shards == 1 else asked.where(F.pmod(F.xxhash64("id", "t"), F.lit(shards)) == k)
        index = build_index([(r["id"], r["t"]) for r in mine.collect()], n)
        if index is None:
            continue
        found = corpus.mapInArrow(_search(spark.sparkContext.broadcast(index), n), "doc_id bigint, item_id bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()
