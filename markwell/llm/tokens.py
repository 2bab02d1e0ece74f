"""Token ids of text batches by a byte-level BPE vocabulary, each distinct chunk encoded once."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from markwell.llm.common import span_hashes, text_buffer

SPACE = 0x20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next free code from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for shift, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + shift)] = b
    return letters


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A fast encoder with the vocabulary file's ids, and the byte length of every id."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    encoder = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    for token, i in special.items():
        lengths[i] = len(token.encode())
    return encoder, lengths, tuple(special)


# A chunk never starts at a space whose next byte is, or may begin, white space.
_MAY_BE_BLANK = np.zeros(256, dtype=bool)
_MAY_BE_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def spread_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indexes of the ranges ``[start, start + count)``, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def encode_column(column: pa.Array, vocabulary: str, specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text column as one flat array, and each row's bounds in it; null and empty texts have no ids.

    The pre-tokenizer always cuts before a space that a non-blank follows, so texts fall into chunks there, equal chunks have
    equal ids, and each distinct chunk of the batch is encoded once. ``specials``: whether special strings in a text become
    their ids or stay ordinary text.
    """
    encoder, byte_lengths, names = _encoder(vocabulary)
    allowed = set(names) if specials else set()
    data, offs = text_buffer(column)
    if not len(data):
        return np.zeros(0, dtype=np.uint32), np.zeros(len(offs), dtype=np.int64)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[: len(data) - 1] = (data[:-1] == SPACE) & ~_MAY_BE_BLANK[data[1:]]
    inner_ends = offs[1:-1]
    cut[inner_ends[inner_ends > 0] - 1] = False
    led = cut.copy()
    cut[offs[:-1]] = True
    starts = np.flatnonzero(cut[:-1])
    ends = np.append(starts[1:], len(data))
    _, sample, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[sample], ends[sample]
    counts, at = np.zeros(len(sample), dtype=np.int64), np.zeros(len(sample), dtype=np.int64)

    def encode(piece: bytes) -> np.ndarray:
        return encoder.encode_to_numpy(piece.decode("utf-8"), allowed_special=allowed, disallowed_special=())

    joined = np.flatnonzero(led[s])
    ids = encode(data[spread_ranges(s[joined], (e - s)[joined])].tobytes())
    bounds = np.searchsorted(np.cumsum(byte_lengths[ids]), np.cumsum((e - s)[joined]), side="left") + 1
    counts[joined] = np.diff(bounds, prepend=0)
    at[joined] = bounds - counts[joined]
    parts, filled = [ids], len(ids)
    for k in np.flatnonzero(~led[s]):
        own = encode(data[s[k] : e[k]].tobytes())
        at[k], counts[k] = filled, len(own)
        parts.append(own)
        filled += len(own)
    pool = np.concatenate(parts)
    per_chunk = counts[which]
    flat = pool[spread_ranges(at[which], per_chunk)]
    before = np.concatenate(([0], np.cumsum(per_chunk)))
    return flat.astype(np.uint32, copy=False), before[np.searchsorted(starts, offs)]
