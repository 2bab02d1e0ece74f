"""Sum-of-squares packing of tokenised documents into windows of fixed length."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwell.llm.common import steps
from markwell.llm.tokens import default_vocabulary, encode_column

WINDOW = 2048
END_ID = 1
# Open windows that one task holds at most; beyond it they are filled up by cutting, as at the end of the task.
MAX_OPEN = 4096

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("padded_length", T.LongType()),
    ]
)


class Packer:
    """Online packing. A window's level is the number of ids in it; ``levels[h]`` holds the open windows of level ``h``.

    A document's whole windows are cut off first. The rest goes to the level (0: a new window) that leaves the smallest sum of
    squared counts of open windows; among equals, to the fullest.
    """

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.levels: list[deque] = [deque() for _ in range(window)]
        self.open = 0

    def add(self, key, ids: np.ndarray) -> Iterator[list]:
        """Pieces are ``(key, start, ids, total)``; yields the windows that this document completes."""
        total, start = len(ids), 0
        while total - start >= self.window:
            yield [(key, start, ids[start : start + self.window], total)]
            start += self.window
        if start < total:
            yield from self._place((key, start, ids[start:].copy(), total))
        if self.open > self.max_open:
            yield from self.flush()

    def _place(self, piece) -> Iterator[list]:
        size = len(piece[2])
        level = self._level(size)
        if level:
            pieces = self.levels[level].popleft()
            self.count[level] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
        else:
            self.levels[level + size].append(pieces)
            self.count[level + size] += 1
            self.open += 1

    def _level(self, size: int) -> int:
        top = self.window - size
        best, cost = 0, 2 * self.count[size] + 1
        held = np.flatnonzero(self.count[1 : top + 1]) + 1
        if len(held):
            into = 2 * self.count[held + size] + 1
            into[held + size == self.window] = 0
            costs = into - 2 * self.count[held] + 1
            k = len(held) - 1 - int(np.argmin(costs[::-1]))
            if costs[k] <= cost:
                best = int(held[k])
        return best

    def flush(self) -> Iterator[list]:
        """Close all open windows: the fullest are filled with what the emptiest hold, cut where needed, so one stays short."""
        rest = deque(pieces for level in range(self.window - 1, 0, -1) for pieces in self.levels[level])
        for level in self.levels:
            level.clear()
        self.count[:] = 0
        self.open = 0
        while rest:
            pieces = rest.popleft()
            room = self.window - sum(len(p[2]) for p in pieces)
            while room and rest:
                key, start, ids, total = rest[-1].pop()
                pieces.append((key, start, ids[:room], total))
                if len(ids) > room:
                    rest[-1].append((key, start + room, ids[room:], total))
                if not rest[-1]:
                    rest.pop()
                room -= min(room, len(ids))
            yield pieces


def _padded(length: int, window: int) -> int:
    """A window is padded to its full length, unless its content is a power of two."""
    return length if length & (length - 1) == 0 else window


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    max_open: int = MAX_OPEN,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document's ids in a sequence; with ``keep_ids`` also the ids themselves (little-endian, 32 bits).

    Each task packs its own split, so nothing is shuffled, and at most one sequence per task is left short. Null or empty text:
    the end id alone. A null key is kept as it is; repeated rows are packed once each; an empty table gives no rows; other
    columns of ``docs`` are not read. A text of any length is cut into whole windows and one rest.
    """
    path = vocabulary or default_vocabulary()
    schema = T.StructType([*PIECE.fields, *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])

    def rows(windows: Iterator[list], state: list[int], out: list[list]) -> None:
        for pieces in windows:
            offset = 0
            padded = _padded(sum(len(p[2]) for p in pieces), window)
            for owner, start, ids, total in pieces:
                raw = ids.astype("<u4", copy=False).tobytes()
                row = (owner, start, len(ids), zlib.crc32(raw), total, state[0], offset, padded)
                out.append(row + (raw,) if keep_ids else row)
                offset += len(ids)
            state[0] += 1

    def batch_of(out: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        types = [pa.int64()] * len(PIECE.fields) + [pa.binary()] * keep_ids
        return pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    def run(batches):
        packer = Packer(window, max_open)
        state = [TaskContext.get().partitionId() << 33]
        for whole in batches:
            for batch in steps(whole, "text"):
                out: list = []
                ids, bounds = encode_column(batch.column("text"), path)
                for row, owner in enumerate(batch.column("key").to_pylist()):
                    own = np.append(ids[bounds[row] : bounds[row + 1]], np.uint32(end_id))
                    rows(packer.add(owner, own), state, out)
                if out:
                    yield batch_of(out)
        out = []
        rows(packer.flush(), state, out)
        if out:
            yield batch_of(out)

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, schema)
