"""Token counts by the whole-token shortcut.

Byte-level pair merging works on *pre-tokens* one by one: which tokens a pre-token
becomes depends on nothing around it.  So each string of the vocabulary is tried
alone, once, on the driver: those that the model gives back as one token are
proved whole (prove_whole()).  A pre-token of the corpus that is such a string counts as one
token without a merge; only the rest is merged, by the library's own model.

Where to find pre-tokens: no pre-token of this family goes from a sign that isn't white space over
into white space, so a text falls into *stretches* (white space and what follows
up to the next white space) whose counts add up.  A batch's texts are cut into stretches by NumPy,
on bytes and at ASCII white space only, never behind a character that may be white space
itself; Arrow finds the distinct ones; each distinct stretch is pre-tokenized by the library once and
its count kept in a bounded table.  A stretch that may hold an added token (``<|``) is encoded
by the library whole: added tokens are found inside texts, as is its default.

Nothing is shuffled: a document's count is a sum in the task that reads it.

Defined cases: null text is empty, and an empty text has no bytes and no tokens.  Texts of any
length are taken whole.  Null or repeated identifiers are rows as all others; an empty table gives an empty
result; other columns aren't read.  A tokenizer that isn't byte-level with this pre-token
pattern (a normalizer, a prefix space, continuing prefixes or white space around added tokens) raises ValueError.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import worker_state

COLUMNS = "id long, n_bytes long, n_tokens long, over_limit boolean"

#: First two bytes, in UTF-8, of the characters beyond ASCII that are white space (U+0085, U+00A0, U+1680, U+180E, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).
WIDE_SPACE = (0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380)
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WIDE = np.zeros(65536, bool)
_WIDE[list(WIDE_SPACE)] = True


def check_family(tokenizer_json: str) -> None:
    """Raises ValueError unless counts of stretches add up for this tokenizer."""
    d = json.loads(tokenizer_json)
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    sound = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and d.get("normalizer") is None
    sound = sound and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    if not sound or any(a["lstrip"] or a["rstrip"] or a["single_word"] or "<|" not in a["content"] or set(a["content"].encode()) & {0x20, *range(0x09, 0x0E)} for a in d["added_tokens"]):
        raise ValueError("this tokenizer's counts don't add up over stretches of text: only byte-level merges without normalizer or prefix space are taken")


def prove_whole(tokenizer_json: str) -> bytes:
    """One bit for each identifier of the vocabulary: set if its string, alone, becomes that one token.  Its size is that of the vocabulary."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    proved = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    for string, i in vocabulary.items():
        proved[i] = [x.id for x in tokenizer.model.tokenize(string)] == [i]
    return np.packbits(proved).tobytes()


class StretchCounts:
    """Token counts by stretch; forgets all when it is full.  Long stretches are counted anew each time."""

    def __init__(self, tokenizer_json: str, proved: bytes, most: int = 600_000, longest: int = 48) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        bits = np.unpackbits(np.frombuffer(proved, np.uint8))
        self.whole = {s for s, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if bits[i]}
        self.known: dict[bytes, int] = {}
        self.most, self.longest, self.merged = most, longest, 0

    def count(self, stretch: bytes) -> int:
        text = stretch.decode("utf-8", "replace")
        if "<|" in text:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        own = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        rest = [p for p in own if p not in self.whole]
        self.merged += len(rest)
        return len(own) - len(rest) + sum(len(self.tokenizer.model.tokenize(p)) for p in rest)

    def counts(self, stretches: list[bytes]) -> np.ndarray:
        out = np.empty(len(stretches), np.int64)
        if len(self.known) > self.most:
            self.known.clear()
        for k, x in enumerate(stretches):
            n = self.known.get(x)
            if n is None:
                n = self.count(x)
                if len(x) <= self.longest:
                    self.known[x] = n
            out[k] = n
        return out


def cut_stretches(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where stretches begin in the bytes of texts that stand one behind the other: at each text's start, and at ASCII white space behind a character that surely is none."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _ASCII_SPACE[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(begins)
    # The character before ends at at - 1; if it is beyond ASCII, its first two bytes stand one or two places before its end.
    last = data[at - 1]
    wide = last >= 0x80
    for back in (2, 3):
        far = at >= back
        lead = np.where(far, data[np.maximum(at - back, 0)].astype(np.int64) << 8 | data[np.maximum(at - back + 1, 0)], 0)
        wide_here = wide & far & _WIDE[lead]
        begins[at[wide_here]] = False
    begins[text_starts[text_starts < len(data)]] = True
    return np.flatnonzero(begins)


def count_batch(batch_texts: pa.Array, table: StretchCounts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text of a batch; null is empty."""
    texts = batch_texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.diff(ends)
    if not sizes.sum():
        return sizes, np.zeros(len(sizes), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts = ends - ends[0]
    begins = cut_stretches(data, starts[:-1][sizes > 0])
    cuts = np.append(begins, len(data)).astype(np.int64)
    stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    coded = stretches.dictionary_encode()
    found = table.counts(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
    total = np.concatenate([[0], np.cumsum(found)])
    place = np.searchsorted(begins, starts)
    return sizes, total[place[1:]] - total[place[:-1]]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", step: int = 2_000) -> DataFrame:
    """One row a document: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    tokenizer_json = Path(tokenizer_path).read_text(encoding="utf-8")
    check_family(tokenizer_json)
    proved = prove_whole(tokenizer_json)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_state(("whole tokens", hash(tokenizer_json)), lambda: StretchCounts(tokenizer_json, proved))
        for batch in batches:
            for part in (batch.slice(a, step) for a in range(0, batch.num_rows, step)):
                n_bytes, n_tokens = count_batch(part.column(1), table)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, COLUMNS)
