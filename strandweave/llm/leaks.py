"""Held-out texts inside training documents: rare n-gram seeds and Smith-Waterman alignment.

Method. Texts become sequences of words in their consistent form (case, punctuation, quote
marks, spacing and look-alike characters folded). Documents that hold a seed of an item are
aligned with it around the seed by Smith-Waterman over words. The score decides: a passage
of ``run`` words that was copied, or edited here and there, reaches a share of what an exact
copy of ``run`` words scores; the exact test for the longest run of consecutive words follows
on the same table. Where edited copies are asked for, every ``n``-gram of an item is a seed,
since an edit can destroy any of them. For exact copies the rarest ``n``-gram of every run of
``run`` words, by its count over all documents, is enough: each passage of at least ``run``
words holds it. There is no cap and no stop list.

Items go to the tasks in blocks of bounded size (``BLOCK_ITEMS``, ``BLOCK_CHARS``); more items
mean more passes over the documents, one block at a time, with the same rows. Documents are
read once (edited copies) or twice (counts, search) for a block and never shuffled; only the
counts of the items' own n-grams are. Jobs run while the query is built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .charforms import skeleton

BLOCK_ITEMS = 50_000
BLOCK_CHARS = 16_000_000
EDITED = 1.0  # share of the score of an exact copy of ``run`` words that a passage must reach

_WORD = re.compile(r"[^\W_]+")
_JOINED = "'’‘`´ʼ＇\u00ad"


def words_of(text: str) -> list[str]:
    """The words of a text in their consistent form; apostrophes join, all other marks separate."""
    plain = skeleton(text)
    for mark in _JOINED if not plain.isascii() else "'`":
        plain = plain.replace(mark, "")
    return _WORD.findall(plain.casefold())


class Items:
    """The items as rows of word numbers (1...; 0 stands for any word no item has)."""

    def __init__(self, rows: list[tuple[int, str]], n: int, run: int):
        self.n, self.run = n, run
        self.ids = [i for i, _ in rows]
        words = [words_of(t) for _, t in rows]
        self.number: dict[str, int] = {}
        for ws in words:
            for w in ws:
                self.number.setdefault(w, len(self.number) + 1)
        self.words = [np.array([self.number[w] for w in ws], np.int64) for ws in words]
        self.base = np.uint64(len(self.number) + 1)

    def grams(self, words: np.ndarray) -> np.ndarray:
        """A code for every n-gram (0 where it holds a foreign word): exact if it fits 64 bits, else a hash."""
        m = len(words) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        code, ok = np.zeros(m, np.uint64), np.ones(m, bool)
        with np.errstate(over="ignore"):
            for k in range(self.n):
                part = words[k : k + m]
                code = code * self.base + part.astype(np.uint64)
                ok &= part > 0
        return np.where(ok, np.maximum(code, np.uint64(1)), np.uint64(0))

    def all_grams(self) -> np.ndarray:
        return np.unique(np.concatenate([self.grams(w) for w in self.words] or [np.zeros(0, np.uint64)]))

    def seeds(self, count: dict[int, int] | None) -> dict[int, list[tuple[int, int]]]:
        """Seed code -> (item, place in the item): the rarest n-gram of every run, the first of equals; without counts every n-gram."""
        out: dict[int, set[tuple[int, int]]] = {}
        for item, words in enumerate(self.words):
            g = self.grams(words)
            per = self.run - self.n + 1
            if len(words) < self.run:
                continue
            if count is None:
                for at, x in enumerate(g):
                    out.setdefault(int(x), set()).add((item, at))
                continue
            freq = np.array([count.get(int(x), 0) for x in g], np.int64)
            for s in range(len(words) - self.run + 1):
                at = s + int(np.argmin(freq[s : s + per]))
                out.setdefault(int(g[at]), set()).add((item, at))
        return {k: sorted(v) for k, v in out.items()}


def align(docs: list[np.ndarray], items: list[np.ndarray], match: int = 2, miss: int = -1, gap: int = -1) -> list[tuple[int, int]]:
    """(best local score, longest run of equal consecutive words) of pairs of rows of word numbers.

    Smith-Waterman row by row, for all pairs of a chunk of similar length at once.
    """
    out: list[tuple[int, int]] = [(0, 0)] * len(docs)
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    for at in range(0, len(order), 128):
        part = order[at : at + 128]
        m = max(len(items[i]) for i in part)
        item = np.zeros((len(part), m), np.int32)
        doc = np.full((len(part), max(len(docs[i]) for i in part)), -1, np.int32)
        for k, i in enumerate(part):
            item[k, : len(items[i])] = items[i]
            doc[k, : len(docs[i])] = np.where(docs[i] > 0, docs[i], -1)
        step = np.arange(m, dtype=np.int32) * -gap
        row, runs = np.zeros((len(part), m + 1), np.int32), np.zeros((len(part), m + 1), np.int32)
        best, longest = np.zeros(len(part), np.int32), np.zeros(len(part), np.int32)
        for j in range(doc.shape[1]):
            same = item == doc[:, j : j + 1]
            score = np.maximum(np.maximum(row[:, :-1] + np.where(same, match, miss), row[:, 1:] + gap), 0)
            # a gap in the item costs in proportion to its length: a running maximum does the whole row
            score = np.maximum.accumulate(score + step, axis=1) - step
            runs[:, 1:] = np.where(same, runs[:, :-1] + 1, 0)
            row[:, 1:] = score
            np.maximum(best, score.max(axis=1), out=best)
            np.maximum(longest, runs.max(axis=1), out=longest)
        for k, i in enumerate(part):
            out[i] = (int(best[k]), int(longest[k]))
    return out


def _numbers(texts: list[str | None], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all texts, each followed by a 0, and where each text begins."""
    get, flat, starts = number.get, [], []
    for t in texts:
        starts.append(len(flat))
        if t:
            flat += [get(w, 0) for w in words_of(t)]
        flat.append(0)
    return np.array(flat, np.int64), np.array(starts, np.int64)


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one after another; the driver holds one."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.select(item, text).where(F.col(text).isNotNull()).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(r[1]) > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    yield block


def find_leaks(
    docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text",
    n: int = 5, run: int = 15, share: float = EDITED, edited: bool = True,
) -> DataFrame:
    """(doc, item, score, longest_run, leaked): every pair whose document holds a seed of the item.

    ``score`` is that of the best alignment (2 a word, -1 a change or gap); ``leaked`` says that
    it reaches ``share`` of 2 * ``run``: a passage of ``run`` words, whole or edited, that keeps
    ``n`` consecutive words. ``longest_run >= run`` is the exact test for a copied passage.
    Without ``edited`` only pairs with a run of ``run`` words are sure to have a row, for less
    work. Null and empty texts and items of fewer than ``run`` words give no row; copies of a
    document are each reported.
    """
    out = None
    for k, block in enumerate(_blocks(items, item, item_text)):
        if k == 1:
            out = cut(out)
        part = _find_block(docs, Items(sorted(block), n, run), doc, text, item, run, edited)
        out = part if out is None else out.unionByName(cut(part))
    return out.withColumn("leaked", F.col("score") >= F.lit(share * 2 * run))


def _find_block(docs: DataFrame, known: Items, doc: str, text: str, item: str, run: int, edited: bool) -> DataFrame:
    grams = known.all_grams()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grams), np.int64)
        for b in batches:
            g = known.grams(_numbers(b.column(0).to_pylist(), known.number)[0])
            g = g[g > 0]
            if len(g) and len(grams):
                at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                total += np.bincount(at[grams[at] == g], minlength=len(grams))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["gram", "n"])

    if edited:
        seeds = known.seeds(None)
    else:
        counted = docs.select(text).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        # at most one row for each n-gram of the items of a block
        seeds = known.seeds({int(grams[r[0]]): r[1] for r in counted.collect()})
    codes = np.array(sorted(seeds), np.uint64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # (row, item) and the parts of the document to align, each around seeds
            where: list[tuple[int, int]] = []
            parts: list[np.ndarray] = []
            ids = b.column(0).to_pylist()
            words, starts = _numbers(b.column(1).to_pylist(), known.number)
            g = known.grams(words)
            hits = np.zeros(0, np.int64)
            if len(g) and len(codes):
                at = np.minimum(np.searchsorted(codes, g), len(codes) - 1)
                hits = np.flatnonzero(codes[at] == g)
            spots: dict[tuple[int, int], list[tuple[int, int]]] = {}
            ends = np.append(starts[1:], len(words)) - 1
            for p, d in zip(hits.tolist(), (np.searchsorted(starts, hits, side="right") - 1).tolist(), strict=True):
                for i, q in seeds[int(g[p])]:
                    spots.setdefault((d, i), []).append((max(int(starts[d]), p - q - run), min(int(ends[d]), p - q + len(known.words[i]) + run)))
            for pair, spans in spots.items():
                spans.sort()
                lo, hi = spans[0]
                for a, z in [*spans[1:], (1 << 60, 0)]:
                    if a > hi:
                        where.append(pair)
                        parts.append(words[lo:hi])
                        lo, hi = a, z
                    else:
                        hi = max(hi, z)
            out: dict[tuple[int, int], tuple[int, int]] = {}
            for k, (score, longest) in zip(where, align(parts, [known.words[i] for _, i in where]), strict=True):
                old = out.get(k, (0, 0))
                out[k] = (max(old[0], score), max(old[1], longest))
            rows = [(ids[d], known.ids[i], s, r) for (d, i), (s, r) in out.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [doc, item, "score", "longest_run"])

    return docs.select(doc, text).mapInArrow(search, f"{doc} bigint, {item} bigint, score bigint, longest_run bigint")
