"""Exact token ids of every text in a public byte-level BPE vocabulary.

Method: dynamic programming over the prefixes of a piece. For every prefix the encoding is
unique, so it is enough to store its *last token*. Candidates are the vocabulary entries
that are suffixes of the prefix: the matches of a suffix-linked automaton of the whole
vocabulary, longest first. A candidate is the last token exactly if it is compatible with
the last token of the prefix before it, that is, if encoding the two tokens' bytes together
gives the same two tokens again. Back-pointers then give the ids. No merge loop runs over a
text; compatible pairs and pieces are remembered (bounded, emptied when full).

Vocabulary files are read by path on each worker and never copied into the repository.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECES_KEPT = 200_000  # remembered pieces and pairs a worker; only speed depends on it


class PrefixEncoder:
    """Encodes bytes to ids; ``ranks`` gives the id (merge order) of every token's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def _by_merging(self, b: bytes) -> list[int]:
        """The definition of the encoding, for the bytes of two tokens: merge the lowest rank first."""
        parts = [b[i : i + 1] for i in range(len(b))]
        ranks, far = self.ranks, len(self.ranks)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], far))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PIECES_KEPT:
                self.pairs.clear()
            known = self.pairs[a, b] = self._by_merging(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece (a match of the pre-split pattern), all of whose bytes must be tokens."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = [-1] * (len(piece) + 1)
        size: list[int] = [0] * (len(piece) + 1)
        for end, (n, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if size[end]:  # a longer suffix already fits; the last token of a prefix is unique
                continue
            start = end - n
            if start == 0 or (size[start] and self.compatible(last[start], token)):
                last[end], size[end] = token, n
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids


@lru_cache(maxsize=2)
def _encoder(path: str) -> PrefixEncoder:
    with open(path, "rb") as f:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def default_vocabulary() -> tuple[str, str]:
    """(path, pre-split pattern) of byte_bpe_50k on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_corpus(rows: DataFrame, key: str, text: str, *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids): the ids of every text, without special tokens (their strings are ordinary text).

    Null and empty texts give an empty list; white space and characters outside the basic
    plane are encoded as they are; repeated rows give repeated results. ``path`` is a
    vocabulary file of base64 tokens and ranks that every worker can read. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        where, split = (path, pattern) if path and pattern else default_vocabulary()
        enc = _encoder(where)
        pieces_of = regex.compile(split).findall
        known: dict[str, list[int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            flat: list[int] = []
            ends = [0]
            for t in b.column(text).to_pylist():
                if t:
                    for p in pieces_of(t):
                        ids = known.get(p)
                        if ids is None:
                            if len(known) >= PIECES_KEPT:
                                known.clear()
                            ids = known[p] = enc.encode(p.encode())
                        flat += ids
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(key), lists], [key, "ids"])

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>")
