"""Cutting texts into words that a tokenizer encodes alike alone and in place, and ragged arrays."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from solvane.llm.transducer import byte_alphabet

# Every pre-tokeniser of the public files ends a word, whatever stands around it, before a space or line feed behind a
# character that is surely not white space, and before these marks behind a Latin letter. The marks are none that a
# special token holds.
CUT = r"(?=[ \n])(?<=[!-~\p{L}])|(?=[.,;:!?*%$#&])(?<=[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F])"


def cut_words(text: Column) -> Column:
    """The words of a text; joined, they are the text. A null or empty text has one empty word."""
    return F.split(F.coalesce(text, F.lit("")), CUT, -1)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task its core
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def encode_words(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and how many each has."""
    ids = [e.ids for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts


# Letters that normalisation leaves as they are or turns into one small letter.
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00DE\u00E0-\u00F6\u00F8-\u00FF"
PROBE = ["", "A", "Zebra", "Über", "ÀÉÎÕÜÝÞ", "àéîõüýþÿ", "Internationalisation", "qxzj", "ÆØÅæøå", "the", "don"]


class SpacelessWords:
    """Words for a tokenizer that drops white space, lowers letters and takes a run of letters as one word.

    Texts can then be cut at every space and between letters and marks, and a word of letters alone goes straight to the
    tokenizer's model. ``fits`` is false if the tokenizer, asked for a few words, turns out to be another kind.
    """

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = tokenizer(path)
        shown = {b: c for c, b in byte_alphabet().items()}
        letters = [chr(c) for c in range(0x41, 0x100) if re.fullmatch(f"[{LETTERS}]", chr(c))]
        self.spelled = {ord(c): "".join(shown[b] for b in c.lower().encode()) for c in letters}
        words = [w for w in PROBE if w] + letters
        plain = self.tokenizer.encode(" ".join(words) + " ab,cd; e!f", add_special_tokens=False).ids
        apart = [i for w in [*words, "ab", ",", "cd", ";", "e", "!", "f"] for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        try:
            self.fits = plain == apart and [i for w in words for i in self.letters(w)] == plain[: -len(self.tokenizer.encode("ab,cd; e!f", add_special_tokens=False).ids)]
        except Exception:  # a model that can't be asked for one word
            self.fits = False

    def letters(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word.translate(self.spelled))]

    def cut(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.replace_substring_regex(texts, f"([{LETTERS}])([.,;:!?*%$#&])", r"\1 \2"), " ")

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and where each word's begin."""
        pure = pc.match_substring_regex(words, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        ids: list = [None] * len(words)
        spelled, ask = self.spelled, self.tokenizer.model.tokenize
        rest = []
        for i, (word, easy) in enumerate(zip(words.to_pylist(), pure.tolist(), strict=True)):
            if easy:
                ids[i] = [t.id for t in ask(word.translate(spelled))]
            else:
                rest.append((i, word))
        flat, counts = encode_words(self.path, [w for _, w in rest])
        bounds, values = starts_of(counts).tolist(), flat.tolist()
        for (i, _), a, b in zip(rest, bounds, bounds[1:], strict=False):
            ids[i] = values[a:b]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), starts_of(counts)


@lru_cache(maxsize=4)
def spaceless(path: str) -> SpacelessWords:
    return SpacelessWords(path)


def offsets_of(array: pa.Array) -> np.ndarray:
    """Offsets of a list, string or binary array, from 0 on, as 64-bit integers."""
    kind = np.int64 if pa.types.is_large_list(array.type) or pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    if not len(array):
        return np.zeros(1, np.int64)
    out = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return out - out[0]


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def take_ragged(flat: np.ndarray, starts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``flat[starts[p]:starts[p + 1]]`` for all picks in a row, and their lengths."""
    lengths = np.diff(starts)[picks]
    shift = np.repeat(starts[picks] - (np.cumsum(lengths) - lengths), lengths)
    return flat[shift + np.arange(len(shift))], lengths


def binary_rows(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose row i is ``flat[bounds[i]:bounds[i + 1]]``, bounds counting items."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * flat.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def parcels(part: pa.RecordBatch, column: str, most: int):
    """Slices of a batch whose ``column`` (text or lists of text) holds about ``most`` bytes each, a row at least."""
    if not len(part):
        return
    array = part.column(column)
    sizes = offsets_of(array)
    if pa.types.is_list(array.type):
        sizes = offsets_of(array.flatten())[sizes]
    parts = sizes[:-1] // most
    bounds = np.flatnonzero(np.diff(parts, prepend=parts[0] - 1)).tolist() + [len(part)]
    for low, high in zip(bounds, bounds[1:], strict=False):
        yield part.slice(low, high - low)


def gathered(parts, column: str, most: int):
    """Batches of about ``most`` bytes in ``column``, cut from or put together from those of ``parts``."""
    held, size = [], 0
    for whole in parts:
        for part in parcels(whole, column, most):
            array = part.column(column)
            size += int(offsets_of(array.flatten() if pa.types.is_list(array.type) else array)[-1])
            held.append(part)
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
