"""SentencePiece ids and back: each distinct marked word is segmented once per task, and its ids are joined back by position."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from markwell.llm.common import steps, text_buffer
from markwell.llm.tokens import spread_ranges

MARK = "▁"
MARK_BYTES = MARK.encode()
SPACE = 0x20

# A task's table of segmented words starts anew beyond so many entries; longer words are segmented anew in each step.
TABLE_ENTRIES = 1 << 18
TABLE_WORD_BYTES = 64

# Stands before a word while it is encoded, so that the library's own leading marker falls on it.
GUARD = "a"

# Ids that one vectorised step of the decoder holds at once; a longer single row is still taken whole.
STEP_IDS = 1 << 19


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@lru_cache(maxsize=2)
def splits_at_markers(model: str) -> bool:
    """Whether the ids of a text are those of its marked words, one after the other.

    That holds for merges (BPE) over plain texts, if a marker leads the text and each space becomes one, and if no piece has a
    marker behind another character. For any other model a whole text counts as one word.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto.FromString(_processor(model).serialized_model_proto())
    rules, trainer = spec.normalizer_spec, spec.trainer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces
    return (
        plain
        and not rules.remove_extra_whitespaces
        and not trainer.treat_whitespace_as_suffix
        and trainer.model_type == trainer.BPE
        and not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
    )


def marked_words(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the marked words: a run of markers (spaces count) and what follows up to the next marker. Rows start words too."""
    marks = data == SPACE
    wide = np.flatnonzero(data[:-2] == MARK_BYTES[0]) if len(data) > 2 else np.zeros(0, dtype=np.int64)
    wide = wide[(data[wide + 1] == MARK_BYTES[1]) & (data[wide + 2] == MARK_BYTES[2])]
    for k in range(3):
        marks[wide + k] = True
    first = marks.copy()
    first[1:] &= ~marks[:-1]
    first[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(first)


@lru_cache(maxsize=2)
def _widths(model: str) -> np.ndarray:
    """Bytes that each id covers of a text whose spaces are written as markers."""
    sp = _processor(model)
    return np.fromiter(
        (1 if sp.is_byte(i) else len(sp.id_to_piece(i).encode()) for i in range(sp.get_piece_size())), np.int64, sp.get_piece_size()
    )


def is_bare(word: bytes) -> bool:
    """Whether a marked word consists of markers alone."""
    return not word.replace(MARK_BYTES, b"").strip(b" ")


class WordTable:
    """The ids of every distinct marked word seen so far, in one flat pool."""

    def __init__(self, model: str):
        self.library = _processor(model)
        self.split = splits_at_markers(model)
        self.guard = len(self.library.encode(GUARD))
        self.widths = _widths(model)
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.begin, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words as one flat array, and their number per word. Words of markers alone come first among ``words``."""
        if not self.split:
            found = self.library.encode([w.decode() for w in words], num_threads=1)
            return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))
        # a word of markers alone would run into the next one: such words go one by one, before all others
        bare = [w for w in words if is_bare(w)]
        alone = [ids[self.guard :] for ids in self.library.encode([GUARD + w.decode() for w in bare], num_threads=1)]
        full = b"".join(words[len(bare) :])
        ids = np.array(self.library.encode(GUARD + full.decode())[self.guard :], dtype=np.int32)
        ends = np.cumsum([len(w) + (len(MARK_BYTES) - 1) * w.count(b" ") for w in words[len(bare) :]])
        counts = np.diff(np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1, prepend=0)
        flat = np.fromiter(chain.from_iterable(alone), np.int32)
        return np.concatenate((flat, ids)), np.concatenate((np.fromiter(map(len, alone), np.int64, len(alone)), counts)).astype(np.int64)

    def _add(self, words: list[bytes]) -> np.ndarray:
        """Segment new words and append them to the pool; their places in it."""
        flat, counts = self._segment(words)
        places = len(self.count) + np.arange(len(words))
        self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(counts) - counts))
        self.count = np.concatenate((self.count, counts))
        self.pool = np.concatenate((self.pool, flat))
        return places

    def _places(self, words: list[bytes]) -> np.ndarray:
        """The place of every word of a step; unknown ones are added. Long words hold a place for this step only."""
        if len(self.place) + len(words) > TABLE_ENTRIES:
            self.clear()
        at = np.fromiter((self.place.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        for kept in (True, False):
            group = [i for i in new if (len(words[i]) <= TABLE_WORD_BYTES) == kept]
            group.sort(key=lambda i: not is_bare(words[i]))
            if group:
                fresh = [words[i] for i in group]
                at[group] = places = self._add(fresh)
                if kept:
                    self.place.update(zip(fresh, places.tolist(), strict=True))
        return at

    def _forget_long(self) -> None:
        kept = len(self.place)
        if kept < len(self.count):
            self.begin, self.count = self.begin[:kept], self.count[:kept]
            self.pool = self.pool[: int(self.begin[-1] + self.count[-1]) if kept else 0]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text column as one flat array, and each row's bounds in it."""
        data, offs = text_buffer(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        if self.split:
            filled = np.diff(offs) > 0
            data = np.insert(data, offs[:-1][filled], SPACE)
            offs = offs + np.concatenate(([0], np.cumsum(filled)))
            starts = marked_words(data, offs)
        else:
            starts = offs[:-1][np.diff(offs) > 0]
        tiles = np.append(starts, len(data))
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(tiles), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        at = self._places(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
        counts = self.count[at]
        flat = self.pool[spread_ranges(self.begin[at], counts)]
        self._forget_long()
        before = np.concatenate(([0], np.cumsum(counts)))
        return flat, before[np.searchsorted(starts, offs)]


def encode_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, bos: bool = False, eos: bool = True
) -> DataFrame:
    """``(doc_id, ids)`` per row of ``docs``: the library's ids of the whole text, with begin and end ids as asked for.

    Null and empty texts have no ids of their own, only those asked for. Repeated rows and null keys are encoded once each; other
    columns are not read, whatever their names; an empty table gives no rows. A task holds one step of text and at most
    ``TABLE_ENTRIES`` segmented words, so nothing is shuffled and a lost task is simply run again.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(path)
        for whole in batches:
            for batch in steps(whole, "text"):
                flat, bounds = table.encode(batch.column("text"))
                if bos:
                    flat, bounds = np.insert(flat, bounds[:-1], table.library.bos_id()), bounds + np.arange(len(bounds))
                if eos:
                    flat, bounds = np.insert(flat, bounds[1:], table.library.eos_id()), bounds + np.arange(len(bounds))
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.record_batch([batch.column("key"), ids], names=["doc_id", "ids"])

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>")


class Surfaces:
    """What each id of a model stands for in a decoded text."""

    def __init__(self, model: str):
        self.library = sp = _processor(model)
        every = range(sp.get_piece_size())
        self.byte = np.fromiter((sp.is_byte(i) for i in every), bool, len(every))
        self.silent = np.fromiter((sp.is_control(i) for i in every), bool, len(every))
        self.leads = np.fromiter((sp.id_to_piece(i).startswith(MARK) for i in every), bool, len(every)) & ~self.byte & ~self.silent
        self.bytes = pa.array([self._one(i) for i in every], pa.large_binary())

    def _one(self, i: int) -> bytes:
        if self.byte[i]:
            return bytes([int(self.library.id_to_piece(i)[3:-1], 16)])
        if self.silent[i]:
            return b""
        if self.library.is_unknown(i):
            return self.library.decode([i]).encode()
        return self.library.id_to_piece(i).replace(MARK, " ").encode()

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of the rows ``ids[bounds[r]:bounds[r + 1]]``: surfaces side by side, without the marker that leads a text."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.bytes)):
            raise ValueError("an id lies outside the vocabulary")
        _, offsets, data = self.bytes.take(pa.array(ids)).buffers()
        at = np.frombuffer(offsets, np.int64)[bounds] if len(ids) else np.zeros(len(bounds), np.int64)
        body = np.frombuffer(data, np.uint8)[: at[-1]] if data is not None and len(ids) else np.zeros(0, np.uint8)
        loud = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
        opening = loud[np.searchsorted(loud, bounds[:-1])]
        led = opening < bounds[1:]
        led[led] = self.leads[ids[opening[led]]]
        body = np.delete(body, at[:-1][led])
        at = at - np.concatenate(([0], np.cumsum(led)))
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(body)])
        # bytes that are no UTF-8, alone or cut by a control id: the library says what stands for them
        cut = self.silent[ids] & np.append(self.byte[ids][1:], False)
        cut = np.diff(np.concatenate(([0], np.cumsum(cut)))[bounds]) > 0
        try:
            if not cut.any():
                return texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            pass
        rows = zip(texts, cut, bounds[:-1], bounds[1:], strict=True)
        return pa.array([self._text(t, c, ids[a:b]) for t, c, a, b in rows], pa.large_string())

    def _text(self, made: pa.Scalar, cut: bool, ids: np.ndarray) -> str:
        try:
            if not cut:
                return made.as_py().decode()
        except UnicodeDecodeError:
            pass
        return self.library.decode(ids.tolist())


def decode_pieces(encoded: DataFrame, ids: str = "ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """The rows of ``encoded`` with the text of their ids (integers) as a further column ``text``, as the library decodes it.

    Null or empty id lists and lists of control ids give an empty text; null ids count as the unknown id; ids outside the
    vocabulary raise an error. A column that already bears the new name is replaced. Other columns pass through.
    """
    path = model or default_model()
    rest = [F.col(f"`{c}`") for c in encoded.columns if c != text]
    packed = encoded.select(F.struct(*rest).alias("row"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces = Surfaces(path)
        unknown = surfaces.library.unk_id()
        for batch in batches:
            column = batch.column("ids")
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths, dtype=np.int64)
            row = 0
            while row < len(lengths):
                before = ends[row - 1] if row else 0
                stop = max(row + 1, int(np.searchsorted(ends, before + STEP_IDS, side="right")))
                part = batch.slice(row, stop - row)
                flat = part.column("ids").flatten().fill_null(unknown).to_numpy(zero_copy_only=False)
                bounds = np.concatenate(([0], np.cumsum(lengths[row:stop], dtype=np.int64)))
                made = surfaces.decode(flat, bounds).cast(pa.string())
                yield pa.record_batch([part.column("row"), made], names=["row", "text"])
                row = stop

    made = packed.mapInArrow(run, StructType([packed.schema["row"], StructField("text", StringType())]))
    return made.select(*[F.col(f"row.`{c}`").alias(c) for c in encoded.columns if c != text], F.col("text").alias(text))

