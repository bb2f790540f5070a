"""Token counts of whole texts by a compiled finite-state tokenizer.

Texts are cut into chunks of a fixed number of bytes wherever these fall. Each chunk gets a state map: for some states
in which it may be entered, the state in which it is left and the tokens emitted between. All chunks of a batch are
read in lockstep, byte by byte, through the transducer's table. The maps of a text's chunks are then composed by a
parallel prefix scan. A map starts with the machine's first state and the state in which the preceding chunk is left
from it; where the scan meets a state that a map does not hold yet, the maps get a further entry and the scan is
repeated, so the counts are exact for any text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.llm.transducer import Transducer

CHUNK = 1024  # bytes that a lane reads
HEAD = 64  # bytes after which lanes entered in different states are compared
LANES = 1 << 14  # chunks in one round; bounds memory


@lru_cache(maxsize=2)
def machine(path: str) -> Transducer:
    return Transducer(path)


class Maps:
    """State maps of consecutive chunks, a column for each entry state that is held."""

    def __init__(self, machine: Transducer, data: np.ndarray, at: np.ndarray, lengths: np.ndarray, first: np.ndarray, entry: np.ndarray):
        self.machine, self.data, self.at, self.lengths, self.first = machine, data, at, lengths, first
        self.entries, self.exits, self.counts = [entry], [], []
        self.mid, self.mid_count = entry.copy(), None
        exit_ = self.mid
        self.mid_count = self.read(exit_, np.minimum(lengths, HEAD), 0, slice(None))
        out = self.mid.copy()
        rest = self.read(out, np.maximum(lengths - HEAD, 0), HEAD, slice(None))
        self.exits.append(out)
        self.counts.append(self.mid_count + rest)

    def read(self, state: np.ndarray, lengths: np.ndarray, skip: int, lanes) -> np.ndarray:
        return self.machine.advance(self.data, self.at[lanes] + skip, lengths, state, [*self.entries, *self.exits, self.mid])

    def add(self) -> None:
        """A column for the states in which the preceding chunks are left from the last column."""
        entry = np.empty_like(self.entries[-1])
        entry[1:] = self.exits[-1][:-1]
        entry[self.first] = self.entries[0][self.first]
        self.entries.append(entry)
        out, count = self.exits[0].copy(), self.counts[0].copy()
        self.exits.append(out)
        lanes = np.flatnonzero(entry != self.entries[0])
        state = entry[lanes]
        self.exits.append(state)  # held while lanes are read
        head = self.read(state, np.minimum(self.lengths[lanes], HEAD), 0, lanes)
        met = state == self.mid[lanes]
        count[lanes] += head - self.mid_count[lanes]
        apart = np.flatnonzero(~met)
        if len(apart):
            own = lanes[apart]
            late = state[apart]
            rest = self.read(late, np.maximum(self.lengths[own] - HEAD, 0), HEAD, own)
            count[own] = head[apart] + rest
            out[own] = late
        self.exits.pop()
        self.counts.append(count)

    def compose(self) -> tuple[np.ndarray, np.ndarray]:
        """For the last chunk of each text the column in which it is entered (-1: not held yet), and the text's count."""
        width, chunks = len(self.exits), len(self.at)
        column = np.full((chunks, width), -1, np.int64)  # of the next chunk
        for c in range(width):
            for to in range(width):
                hit = np.flatnonzero((column[:-1, c] < 0) & (self.exits[c][:-1] == self.entries[to][1:]))
                column[hit, c] = to
        total = np.stack(self.counts, axis=1)
        place = np.arange(chunks) - np.maximum.accumulate(np.where(self.first, np.arange(chunks), 0))
        step = 1
        while step <= place.max(initial=0):
            late = np.flatnonzero(place >= step)
            through = column[late - step]
            known = through >= 0
            through = np.where(known, through, 0)
            sums = total[late - step] + np.take_along_axis(total[late], through, axis=1)
            column[late] = np.where(known, np.take_along_axis(column[late], through, axis=1), -1)
            total[late] = sums
            step *= 2
        last = np.append(np.flatnonzero(self.first)[1:], chunks) - 1
        entered = np.where(place[last] == 0, 0, column[np.maximum(last - 1, 0), 0])
        return entered, np.where(entered >= 0, total[last, 0], 0)


def count_batch(machine: Transducer, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    lengths = np.diff(offsets)
    data, offsets = machine.columns_of(data[offsets[0] : offsets[-1]]), offsets - offsets[0]
    chunks = np.maximum(-(-lengths // CHUNK), 1)
    text = np.repeat(np.arange(len(lengths)), chunks)
    begin = np.cumsum(chunks) - chunks
    place = np.arange(len(text)) - begin[text]
    at = offsets[:-1][text] + place * CHUNK
    size = np.minimum(lengths[text] - place * CHUNK, CHUNK)
    out = np.zeros(len(lengths), np.int64)
    carried = 0
    for low in range(0, len(text), LANES):
        part = slice(low, low + LANES)
        first = place[part] == 0
        entry = np.zeros(len(first), np.int64)
        entry[0] = carried if not first[0] else 0
        first[0] = True
        maps = Maps(machine, data, at[part], size[part], first, entry)
        while True:
            entered, counts = maps.compose()
            if (entered >= 0).all():
                break
            maps.add()
        owner = text[part][first]
        np.add.at(out, owner, counts)
        last = np.append(np.flatnonzero(first)[1:], len(first)) - 1
        left = np.stack(maps.exits, axis=1)[last, entered]
        done = np.append(owner[1:] != owner[:-1], low + LANES >= len(text) or text[low + LANES] != owner[-1])
        np.add.at(out, owner[done], machine.ends[left[done]])
        carried = int(left[-1])
        if not done[-1]:  # the state goes on into the next round
            state = np.array([0, carried], np.int64)
            machine.make_room(2 * LANES, [state])
            carried = int(state[1])
        else:
            machine.make_room(2 * LANES, [np.zeros(1, np.int64)])
    return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every text as the byte-level BPE tokenizer in file ``path`` gives them.

    Returns (id, n_bytes, n_tokens, over_limit), a row for each row of ``docs``. A null text counts as empty: no bytes,
    no tokens. A null id stays null; repeated rows stay repeated; other columns, whatever their names, are not read.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()

    def batches(parts):
        for part in parts:
            texts = part.column("text").cast(pa.large_binary())
            if not len(texts):
                continue
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"\0", np.uint8)
            counts = count_batch(machine(path), data, offsets)
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return read.mapInArrow(batches, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("doc_id", id_col)
