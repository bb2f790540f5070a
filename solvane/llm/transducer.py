"""A byte-level BPE tokenizer compiled into a deterministic transducer whose transitions carry token counts.

The machine reads UTF-8 bytes. A state holds what the future can still depend on: the kind of word being read, a
pending apostrophe or white-space character, and, for each suffix of the word that may yet become part of a token, the
last token before that suffix and the number of tokens up to it. Reading a byte changes the count of tokens by a
number that belongs to the transition. Two facts about BPE make this work: a sequence of tokens is the encoding of its
bytes if each neighbouring pair is, and so each prefix has one last token, found among its suffixes.

Transitions are compiled the first time they are met and kept in a table of bounded size; when it is full, all but the
states in use are forgotten.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

# Fixed values of the public pre-tokenisation pattern: endings that are words of their own.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
LETTER, NUMBER, OTHER, SPACE = "L", "N", "O", "S"
BEGIN = -1  # stands for "no token yet in this word"
EMPTY = ((b"", BEGIN, 0),)
START = ("0",)
BIAS = 128  # counts change by -127..127 a byte; stored in eight bits
MEMO = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 as is, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Transducer:
    def __init__(self, path: str, max_states: int = 1 << 18):
        described = json.loads(Tokenizer.from_file(path).to_str())
        pre, model = described["pre_tokenizer"] or {}, described["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or described["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normaliser or prefix space is needed")
        special = [t["content"].encode() for t in described["added_tokens"]]
        if len(special) > 1 or any(s[:1] in s[1:] for s in special):
            raise ValueError("at most one special token, which does not repeat its first byte")
        self.special = special[0] if special else b""
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.vocabulary, self.beginnings = {}, {}
        alphabet = byte_alphabet()
        for token, number in model["vocab"].items():
            word = bytes(alphabet[c] for c in token)
            self.vocabulary[word] = number
            for i in range(1, len(word)):
                self.beginnings.setdefault(word[:i], word[:i])
        self.words = {number: word for word, number in self.vocabulary.items()}
        self.classes: dict[str, str] = {}
        self.fitting: dict[tuple[int, int], bool] = {}
        self.max_states = max_states
        self.columns = np.full(256, -1, np.int64)  # of the bytes met so far
        self.bytes: list[int] = []
        self.width = 64
        self.forget()

    # ---- one word -------------------------------------------------------------------------------------------

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens (or the token alone at the start of a word) are the encoding of their bytes."""
        known = self.fitting.get((before, token))
        if known is None:
            parts = [token] if before == BEGIN else [before, token]
            text = "".join(self.letters[b] for n in parts for b in self.words[n])
            known = [t.id for t in self.tokenizer.model.tokenize(text)] == parts
            if len(self.fitting) >= MEMO:
                self.fitting.clear()
            self.fitting[before, token] = known
        return known

    def extend(self, live: tuple, word: bytes) -> tuple[tuple, int]:
        """Add bytes to the word: the new suffixes that matter, and the change of the count."""
        total = 0
        for byte in word:
            grown = [(suffix + bytes([byte]), last, back) for suffix, last, back in live]
            token, gain = next((n, back + 1) for s, last, back in grown if (n := self.vocabulary.get(s)) is not None and self.fits(last, n))
            kept = [(self.beginnings[s], last, back - gain) for s, last, back in grown if s in self.beginnings]
            live = tuple(self.shared.setdefault(part, part) for part in (*kept, (b"", token, 0)))
            total += gain
        return live, total

    # ---- characters ------------------------------------------------------------------------------------------

    def kind(self, c: str) -> str:
        """The class of a character, asked of the library's own pre-tokeniser."""
        known = self.classes.get(c)
        if known is None:
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            known = next((k for k, with_ in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(with_ + c)) == 1), SPACE)
            self.classes[c] = known
        return known

    def feed(self, state: tuple, c: str) -> tuple[tuple, int]:
        kind = self.kind(c)
        if state[0] == "word":
            if kind == state[1]:
                live, gain = self.extend(state[2], c.encode())
                return ("word", kind, live), gain
            return self.feed(START, c)
        if state[0] == "space":  # all of the run but its last character is counted
            _, run, last = state
            if kind == SPACE:
                run, gain = self.extend(run, last.encode())
                return ("space", run, c), gain
            if last == " ":
                live, gain = self.extend(EMPTY, (last + c).encode())
                return ("word", kind, live), gain
            alone = self.extend(EMPTY, last.encode())[1]
            state, gain = self.feed(START, c)
            return state, alone + gain
        if state[0] == "quote":
            seen = state[1] + c
            if seen in ENDINGS:
                return START, self.extend(EMPTY, seen.encode())[1]
            if any(e.startswith(seen) for e in ENDINGS):
                return ("quote", seen), 0
            return self.replay(seen)
        if kind == SPACE:
            return ("space", EMPTY, c), 0
        if c == "'":
            return ("quote", c), 0
        live, gain = self.extend(EMPTY, c.encode())
        return ("word", kind, live), gain

    def replay(self, seen: str) -> tuple[tuple, int]:
        """An apostrophe that began no ending is a word of its own kind; read on behind it."""
        live, total = self.extend(EMPTY, b"'")
        state = ("word", OTHER, live)
        for c in seen[1:]:
            state, gain = self.feed(state, c)
            total += gain
        return state, total

    def pending(self, state: tuple) -> int:
        """Tokens that the end of the text adds."""
        if state[0] == "space":
            return self.extend(state[1], state[2].encode())[1]
        if state[0] == "quote":
            state, gain = self.replay(state[1])
            return gain + self.pending(state)
        return 0

    # ---- bytes: (state, unfinished character, bytes of the special token, state before it, count since) -------

    def read(self, full: tuple, byte: int) -> tuple[tuple, int]:
        state, part, matched, before, since = full
        part += bytes([byte])
        inner, gain = state, 0
        complete = byte < 0x80 or len(part) >= (4 if part[0] >= 0xF0 else 3 if part[0] >= 0xE0 else 2)
        if complete:
            for c in part.decode("utf-8", "replace"):
                inner, more = self.feed(inner, c)
                gain += more
        if matched and self.special[matched] == byte:
            if matched + 1 == len(self.special):
                return (START, b"", 0, None, 0), since + self.pending(before) + 1
            return (inner, b"", matched + 1, before, since - gain), gain
        if self.special and byte == self.special[0]:
            return (inner, b"", 1, state, -gain), gain
        return (inner, b"" if complete else part, 0, None, 0), gain

    def end(self, full: tuple) -> int:
        state, gain = full[0], 0
        for c in full[1].decode("utf-8", "replace"):
            state, more = self.feed(state, c)
            gain += more
        return gain + self.pending(state)

    # ---- the table ----------------------------------------------------------------------------------------------

    def forget(self) -> None:
        self.keys: list[tuple] = []
        self.shared: dict[tuple, tuple] = {}
        self.numbers: dict[tuple, int] = {}
        self.ends = np.zeros(1024, np.int64)
        self.table = np.full((1024, self.width), -1, np.int32)
        self.number((START, b"", 0, None, 0))

    def number(self, key: tuple) -> int:
        at = self.numbers.get(key)
        if at is None:
            at = self.numbers[key] = len(self.keys)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.keys.append(key)
            self.ends[at] = self.end(key)
        return at

    def columns_of(self, data: np.ndarray) -> np.ndarray:
        """The columns of the bytes in ``data``; the table is widened for bytes not met before."""
        for byte in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.columns[byte] < 0:
                self.columns[byte] = len(self.bytes)
                self.bytes.append(byte)
        while len(self.bytes) > self.width:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            self.width *= 2
        return self.columns[data].astype(np.uint8)

    def compile(self, moves: np.ndarray) -> None:
        """Fill in the transitions (state * width + column)."""
        for move in moves.tolist():
            state, column = divmod(move, self.width)
            key, gain = self.read(self.keys[state], self.bytes[column])
            if not -BIAS < gain < BIAS:
                raise OverflowError("a byte changes the count by too much for the table")
            to = self.number(key)
            self.table[state, column] = to * 256 + gain + BIAS

    def make_room(self, lanes: int, held: list[np.ndarray]) -> None:
        """Forget all states but those in ``held``, which are renumbered in place, if ``lanes`` new ones might not fit."""
        if len(self.keys) + lanes <= self.max_states:
            return
        used = np.unique(np.concatenate([h.ravel() for h in held]))
        keys = [self.keys[i] for i in used.tolist()]
        self.forget()
        new = np.array([self.number(k) for k in keys], np.int64)
        for h in {id(h): h for h in held}.values():  # each array once
            h[...] = new[np.searchsorted(used, h)]

    def advance(self, data: np.ndarray, at: np.ndarray, lengths: np.ndarray, state: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
        """Read ``lengths`` columns from ``at`` in all lanes at once; ``state`` becomes the states reached. Returns the counts."""
        order = np.argsort(-lengths, kind="stable")
        at, lengths = at[order], lengths[order]
        now, count = state[order], np.zeros(len(order), np.int64)
        ends = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        for i, n in enumerate(ends.tolist()):
            move = now[:n] * self.width + data[at[:n] + i]
            to = self.table.reshape(-1).take(move)
            missing = to < 0
            if missing.any():
                fresh = np.unique(move[missing])
                if len(self.keys) + len(fresh) > self.max_states:
                    state[order] = now
                    self.make_room(len(fresh), [state, now, *held])
                    move = now[:n] * self.width + data[at[:n] + i]
                    fresh = np.unique(move[self.table.reshape(-1).take(move) < 0])
                self.compile(fresh)
                to = self.table.reshape(-1).take(move)
            now[:n] = to >> 8
            count[:n] += to & 255
        out = np.empty_like(count)
        out[order] = count - BIAS * lengths
        state[order] = now
        return out

