"""Best-fit packing of token sequences, bulk-synchronous over size classes.

Documents become pieces of at most ``size`` tokens.  A piece's length is a whole number
up to ``size``, so documents and gaps, range-sorted, form at most ``size`` classes each,
whatever the corpus holds.  Rounds go from the longest class down.  In a round all
pieces of the class are matched at once: a successor sweep over the gap classes
gives them the smallest gaps that hold them, conflicts over the same gap class
are resolved by rank (rank r gets the r-th gap, the rest sweep on), what is left opens new sequences, gaps
are updated, and the next round begins.  That is best-fit decreasing.  A round
works on counts; its outcome is a list of intervals (length, ranks, first sequence,
offset).  Their number is bounded by ``size`` alone (its harmonic sum, twice), so they are sent
to all tasks; pieces look up their own rank.  Ranks within a class come from salted cells
(common.salted_rank()), so a class that a third of all pieces fall in is no one task's.

Tokens: white space never lies in a token of this family, so a text's ids are
those of its stretches without ASCII white space, one after the other; a worker tokenizes
each distinct stretch once and keeps it in a bounded table (see StretchIds).

Defined cases: null text is empty, its ids are the end id alone.  Rows with equal
identifiers are packed each.  A null identifier stays null.  An empty table gives an empty result.  Other
columns aren't read.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.blocks import runs
from tidelake.llm.common import salt_count, salted_rank, stage, text_batches, worker_state


#: Each byte's sign in a byte-level vocabulary: itself if it is printable, else one from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class StretchIds:
    """Token ids by stretch of text without white space.

    That holds only where white space separates tokens and makes none: a tokenizer for which it doesn't is refused.
    A stretch of lower-case Latin letters, perhaps with one comma or full stop behind it, is one word of the
    model, and goes to the model itself; all others take the tokenizer's whole way.
    """

    def __init__(self, tokenizer_json: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most = Tokenizer.from_str(tokenizer_json), most
        self.ends = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ",."}
        alike = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids == [i for x in text.split() for i in self.tokenizer.encode(x, add_special_tokens=False).ids]
        if not all(map(alike, ("a b", "the  cat\tsat", "x\n\ny 12", " end "))):
            raise ValueError("this tokenizer makes tokens of white space: texts can't be taken apart at it")
        # Only a tokenizer that does as said above is taken apart; any other is asked for each stretch.
        probe = ["thé", "zzxy,", "añob.", "the"]
        self.plain = [self._word(x) for x in probe] == [self.tokenizer.encode(x, add_special_tokens=False).ids for x in probe] and self._lowers()
        self.clear()

    def _lowers(self) -> bool:
        a, b = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("Thé QUICK, Brown", "thé quick, brown"))
        return a == b

    def clear(self) -> None:
        numbers: defaultdict[str, int] = defaultdict(lambda: len(numbers))
        self.numbers, self.known = numbers, 0
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _word(self, stretch: str) -> list[int] | None:
        """Ids of a stretch that is one word; null of any other."""
        core, end = (stretch[:-1], self.ends[stretch[-1]]) if stretch[-1:] in self.ends else (stretch, [])
        if not core.isalpha() or max(core) >= "\u0250" or core != core.lower():
            return None
        signs = core if core.isascii() else "".join(BYTE_SIGNS[b] for b in core.encode())
        return [x.id for x in self.tokenizer.model.tokenize(signs)] + end

    def _learn(self, fresh: list[str]) -> None:
        found = [self._word(x) for x in fresh] if self.plain else [None] * len(fresh)
        if rest := [k for k, x in enumerate(found) if x is None]:
            for k, e in zip(rest, self.tokenizer.encode_batch_fast([fresh[k] for k in rest], add_special_tokens=False), strict=True):
                found[k] = e.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
        self.known += len(fresh)

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.numbers) > self.most:
            self.clear()
        rows = pa.array(texts, pa.large_string())
        if self.plain:  # special tokens are looked for in the text as it stands
            rows = pc.if_else(pc.match_substring(rows, "<|"), rows, pc.ascii_lower(rows))
        split = pc.ascii_split_whitespace(rows)
        coded = split.flatten().dictionary_encode()
        own = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.numbers.__getitem__, own), np.int64, len(own))
        if len(self.numbers) > self.known:
            self._learn(list(islice(self.numbers, self.known, None)))
        at = numbers[np.asarray(coded.indices)]
        cuts = np.cumsum(np.asarray(split.value_lengths()))
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            n = at[a:b]
            sizes = self.sizes[n]
            ends = np.cumsum(sizes)
            yield self.flat[np.repeat(self.starts[n] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def pieces_of(docs: DataFrame, tokenizer_json: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_state(("stretches", hash(tokenizer_json)), lambda: StretchIds(tokenizer_json))
        end = np.array([end_id], np.uint32)
        for own, texts in runs(batches, 4_000_000):
            rows = []
            for i, ids in zip(own, table.ids(texts), strict=True):
                data, n = np.concatenate([ids, end]).astype("<u4").tobytes(), len(ids) + 1
                rows += [(i, k, a, min(size, n - a), zlib.crc32(data[4 * a : 4 * (a + size)])) for k, a in enumerate(range(0, n, size))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Intervals (length, first rank, first sequence, offset): piece ``first rank + k`` of a length goes to sequence ``first sequence + k``; the interval ends where the length's next begins."""
    out, gaps, opened = [], defaultdict(list), 0  # gaps: gap -> bundles (first sequence, sequences) that have it
    order: list[int] = []  # the gaps that some bundle has

    def fill(length: int, rank: int, left: int, gap: int, first: int, bins: int) -> int:
        """Places pieces in a bundle; returns how many."""
        layers = gap // length
        full = min(bins, left // layers)
        some = left - full * layers if full < bins else 0
        for sequences, fits, base in ((full, layers, first), (int(some > 0), some, first + full)):
            if sequences:
                for j in range(fits):
                    out.append((length, rank, base, size - gap + j * length))
                    rank += sequences
                put(gap - fits * length, base, sequences)
        rest = bins - full - (some > 0)
        put(gap, first + bins - rest, rest)
        return full * layers + some

    def put(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if not gaps[gap]:
                bisect.insort(order, gap)
            gaps[gap].append((first, bins))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(at)
            else:
                gap, first, bins = size, opened, -(-left // (size // length))
                opened += bins
            placed = fill(length, rank, left, gap, first, bins)
            rank, left = rank + placed, left - placed
    return out


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    with text_batches(docs.sparkSession):
        pieces = stage(pieces_of(docs, Path(tokenizer_path).read_text(encoding="utf-8"), size, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    salts = salt_count(sum(counts.values()))
    cells = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    ranked = salted_rank(cells, ["length"], [], "salt", ["id", "piece", "ids_crc32"], "rank")
    # Intervals in order of (length, first rank): one search finds a piece's own.
    steps = np.array(sorted(plan(counts, size)), np.int64).reshape(-1, 4)
    keys = steps[:, 0] * np.int64(2**51) + steps[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            step = steps[np.searchsorted(keys, length * np.int64(2**51) + rank, "right") - 1] if len(steps) else np.zeros((0, 4), np.int64)
            kept = batch.select(["id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(step[:, 2] + rank - step[:, 1]), pa.array(step[:, 3])], names=[*kept.schema.names, "sequence_id", "offset"])

    return ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
