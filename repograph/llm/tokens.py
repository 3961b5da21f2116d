"""Token ids of whole texts with a public tokenizer file, each distinct chunk encoded once.

A chunk is a run of white space and what follows up to the next one.  Byte-level pre-tokenization never
joins a character and white space after it, so a text's ids are those of its chunks in order.  Texts
with other than ASCII white space, or with a special token's string, are encoded whole.

Where the file's merges are ranked like its ids, as in byte-level vocabularies, chunks go through a faster
encoder that is built from the same file's vocabulary; it gives the same ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from repograph.llm import arrays

SLICE_BYTES = 1 << 20
CACHED = 1 << 18
AT_ONCE = 1 << 12
#: How byte-level pre-tokenization splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LEADS = np.zeros(256, bool)
_LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_WHOLE = re.compile(
    rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""

    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_file(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def fast_encoding(held: dict) -> tiktoken.Encoding | None:
    """An encoder of plain text with the file's ids; None if its ids are not the order of its merges."""

    pre, model = held.get("pre_tokenizer") or {}, held["model"]
    if (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True), held.get("normalizer")) != (
            "ByteLevel", False, True, None) or model.get("type") != "BPE" or model.get("ignore_merges"):
        return None
    alphabet = _byte_alphabet()
    special = {t["content"] for t in held.get("added_tokens", [])}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [vocabulary.get(m, -1) for m in merged]
    if len(vocabulary) != 256 + len(merged) or any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or ids[0] != 256:
        return None
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items()}
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TextEncoder:
    """Encodes slices of texts; keeps the ids of at most ``CACHED`` chunks besides those of a slice."""

    def __init__(self, path: str):
        held = read_file(path)
        self.path = path
        self.specials = [t["content"].encode() for t in held.get("added_tokens", [])]
        self.fast = fast_encoding(held)
        self._forget()

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.fast:
            found = list(map(self.fast.encode_ordinary, texts))
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        return self._encode_whole(texts)

    def _encode_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [np.empty(0, np.uint32)], []
        for start in range(0, len(texts), AT_ONCE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[start:start + AT_ONCE], add_special_tokens=False)]
            lengths += map(len, found)
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        return np.concatenate(ids), np.array(lengths, np.int64)

    def _learn(self, chunks: list[bytes], whole: list[bool]) -> None:
        texts = [c.decode() for c in chunks]
        ids, lengths = self._encode(texts)
        if any(whole):
            # Texts that special tokens or other white space keep in one piece.
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i in np.flatnonzero(whole):
                parts[i], lengths[i:i + 1] = self._encode_whole([texts[i]])
            ids = np.concatenate(parts)
        self.known |= zip(chunks, range(len(self.starts), len(self.starts) + len(chunks)), strict=True)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def _whole_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that cannot be cut into chunks."""

        leads = np.flatnonzero(_LEADS[data])
        rows = set(np.unique(np.searchsorted(offsets, leads, side="right") - 1).tolist())
        rows = {r for r in rows if _WHOLE.search(data[offsets[r]:offsets[r + 1]].tobytes())}
        held = data.tobytes()
        for special in self.specials:
            rows |= {int(np.searchsorted(offsets, m.start(), side="right")) - 1
                     for m in re.finditer(re.escape(special), held)}
        return np.array(sorted(rows), np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each row's first one."""

        rows = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(rows + 1, np.int64)
        space = arrays._SPACE[data]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        whole = self._whole_rows(data, offsets)
        for row in whole:
            begins[offsets[row]:offsets[row + 1]] = False
            begins[offsets[row]] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(data))
        # Chunks are told apart by their bytes.
        found = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]
        ).dictionary_encode()
        inverse, distinct = found.indices.to_numpy(), found.dictionary.to_pylist()
        if len(self.known) > CACHED:
            self._forget()
        new = [i for i, chunk in enumerate(distinct) if chunk not in self.known]
        if new:
            sample = np.empty(len(distinct), np.int64)
            sample[inverse[::-1]] = starts[::-1]
            self._learn([distinct[i] for i in new], np.isin(sample[new], offsets[whole]).tolist())
        place = np.fromiter((self.known[chunk] for chunk in distinct), np.int64, len(distinct))
        lengths = self.lengths[place][inverse]
        ids = self.ids[arrays.ragged(self.starts[place][inverse], lengths)]
        ends = np.append(0, np.cumsum(lengths))
        return ids, ends[np.searchsorted(starts, offsets)]

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, ids, first ids) of each slice of a text column."""

        for start, stop, data, offsets in arrays.text_slices(column, SLICE_BYTES):
            yield start, stop, *self.encode(data, offsets)


@lru_cache(maxsize=1)
def text_encoder(path: str) -> TextEncoder:
    """The worker's encoder; tasks that follow each other in a worker share its chunks."""

    return TextEncoder(path)
