"""Substring dedup with difference-cover anchors.

A *window* is ``window`` consecutive words of one document; each word that lies in a window
whose word sequence also starts elsewhere goes.  A difference cover of a period
v is a set of residues such that any two positions, shifted by the same d < v, both
fall on it.  So of two equal windows some pair of cover positions at equal depth
starts equal *anchors* of window - v + 1 words, and only anchors are hashed and
compared over the corpus: about a quarter of the positions.

Pass 1 asks how often each anchor occurs (blocks.ask()).  Pass 2 extends: every
window over a repeated anchor is a candidate; the corpus is asked about the
candidates' own hashes, of 96 bits.  Pass 3 marks the words of repeated windows and
joins what is left.  Anchors can only name too many candidates; what counts as
repeated is decided by whole windows.  No pairs are made, no document is sent.

Defined cases: null text has no words, and an empty kept text.  Windows are judged on the
input.  Rows with equal identifiers are documents of their own, repeated rows are
repeats of each other.  A null identifier stays null.  Documents shorter than a window keep all.
An empty table gives an empty result.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelake.llm.blocks import Block, WordHashes, answer, as_blocks, ask, distinct, mixed, parts_for, read_blocks, total_bytes
from tidelake.llm.common import text_batches

#: A perfect difference set: each residue modulo 21 but 0 is the difference of exactly one pair.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    """base to the 0th .. nth power modulo 2^64."""
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


class Rolling:
    """Hashes of all stretches of some length over one array of word hashes."""

    def __init__(self, words: np.ndarray, base: int) -> None:
        n = len(words)
        ups, downs = (_powers(b, n) for b in (base, pow(base, -1, 2**64)))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * ups[:n], out=self.sums[1:])
        self.downs = downs

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.sums[starts + length] - self.sums[starts]) * self.downs[starts])


class Words:
    """A block's words, end to end."""

    def __init__(self, block: Block, hashes: WordHashes, window: int) -> None:
        self.words = [t.split() for t in block.texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.hashes = np.concatenate([hashes.of(w) for w in self.words])
        ends = np.cumsum(self.sizes)
        self.place = np.arange(len(self.hashes)) - np.repeat(ends - self.sizes, self.sizes)
        self.starts_window = self.place + window <= np.repeat(self.sizes, self.sizes)
        self.left = np.repeat(ends, self.sizes) - np.arange(len(self.hashes))

    def anchors(self, window: int) -> np.ndarray:
        """Cover positions whose anchor lies in some window."""
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        long = np.repeat(self.sizes >= window, self.sizes)
        return np.flatnonzero(cover[self.place % PERIOD] & long & (self.left >= window - PERIOD + 1))

    def candidates(self, window: int, repeated: np.ndarray) -> np.ndarray:
        """Window starts with a repeated anchor at a depth below the period."""
        marks = np.zeros(len(self.hashes) + 1, np.int64)
        marks[repeated + 1] = 1
        sums = np.cumsum(marks)
        starts = np.flatnonzero(self.starts_window)
        return starts[sums[starts + PERIOD] > sums[starts]]


def _window_hashes(words: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    first, second = (Rolling(words.hashes, b).at(starts, window) for b in _BASE)
    return first, (second >> np.uint64(32)).astype(np.uint32)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = False) -> DataFrame:
    """One row a document: id, n_words, n_removed, kept_sha256 (hex, of the kept words joined by one space) and, if asked for, kept."""
    if window < PERIOD + 1:
        raise ValueError(f"a window has at least {PERIOD + 1} words")
    with text_batches(docs.sparkSession):
        blocks = as_blocks(docs, id_col, text_col)
    parts = parts_for(total_bytes(blocks))
    hashes = WordHashes()

    def anchor_keys(block: Block) -> tuple[np.ndarray, None]:
        words = Words(block, hashes, window)
        return Rolling(words.hashes, _BASE[0]).at(words.anchors(window), window - PERIOD + 1), None

    with text_batches(docs.sparkSession):
        anchor_replies = ask(blocks, anchor_keys, parts, "anchors", bits=48)

    def candidates(block: Block) -> tuple[Words, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        words = Words(block, hashes, window)
        anchors = words.anchors(window)
        keys = Rolling(words.hashes, _BASE[0]).at(anchors, window - PERIOD + 1)
        starts = words.candidates(window, anchors[answer(anchor_replies, block, keys, None, bits=48) > 1])
        return words, starts, _window_hashes(words, starts, window)

    with text_batches(docs.sparkSession):
        window_replies = ask(blocks, lambda block: candidates(block)[2], parts, "windows")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read_blocks(batches):
            words, starts, keys = candidates(block)
            again = starts[answer(window_replies, block, *keys) > 1]
            edges = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(edges, again, 1)
            np.subtract.at(edges, again + window, 1)
            keep = np.cumsum(edges[:-1]) == 0
            at, out = 0, []
            for n, own in zip(words.sizes.tolist(), words.words, strict=True):
                mask = keep[at : at + n]
                removed = n - int(np.count_nonzero(mask))
                kept = b" ".join(compress(own, mask.tolist()) if removed else own)
                out.append((n, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                at += n
            columns = [pa.array(block.ids, pa.int64()), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(columns[: 4 + with_text], names=["id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    return blocks.mapInArrow(finish, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
