"""Repeated passages by merging Burrows-Wheeler transforms.

Equal ``LENGTH``-byte strings have equal anchors (see ``placed_runs``), so texts are compared anchor by anchor: only runs of
strings whose anchor stands in two documents or more are cut out as pieces and brought together. A task merges the transforms of
its pieces by refining their interleave one symbol at a time (see ``merge_transforms``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from markwell.llm.common import mix, power_tables, release_memory, span_hashes, stash, steps, text_buffer
from markwell.llm.tokens import spread_ranges

LENGTH = 50
KEY = 16
# An anchor that so many documents hold is split: each of its strings is routed by its own content.
HOT = 2_000
# Bytes of text whose anchors are taken at once.
ANCHOR_STEP = 1 << 19
# Bits of an anchor's hash that name it while anchors are counted (a false match only costs work), and bits of the hash of a
# run's bytes, which tells runs of one anchor apart.
NAME_BITS = 48
CONTENT_BITS = 40
COVERED, SPLIT = 1, 2
# Bits that tell apart what stands beside anchors (0: nothing does); a false match only costs work.
SIDE_BITS = 16
# Where a span that stands for the whole text begins.
WHOLE = -1
# Bytes of pieces that one merge takes together; a route is never cut in two.
MERGE_BYTES = 1 << 20
# Buckets of anchors per shuffle partition; a task takes its buckets one at a time.
BUCKETS = 4
_LOW = np.uint64((1 << 24) - 1)
_ONE = np.uint64(1)


def placed_runs(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, ...]:
    """Cut each text's ``length``-byte strings into runs that share an anchor.

    The anchor of a string is the ``key``-byte window in it whose hash is least (the first of equals), so equal strings have
    equal anchors wherever they stand. Returns ``(hash, row, first, last, place)`` per run: the anchor's hash (its lowest bit 0), the
    row, the first and last start of its strings, and where the anchor stands, as positions in ``data``.
    """
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, *[np.int64] * 4))
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _ONE) * up[: len(data)], out=sums[1:])
    count = len(data) - key + 1
    hashes = mix((sums[key:] - sums[:-key]) * down[:count])
    least = (hashes & ~_LOW) | (np.arange(count, dtype=np.uint64) & _LOW)
    span, width = 1, length - key + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    start = np.arange(n)
    owner = start + ((least[:n] - start.astype(np.uint64)) & _LOW).astype(np.int64)
    sizes = np.diff(offs)
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    long_enough = sizes >= length
    np.add.at(inside, offs[:-1][long_enough], 1)
    np.add.at(inside, (offs[1:] - length + 1)[long_enough], -1)
    valid = np.cumsum(inside[:n]) > 0
    edge = np.ones(n, dtype=bool)
    edge[1:] = (owner[1:] != owner[:-1]) | ~valid[:-1]
    edge[offs[:-1][offs[:-1] < n]] = True
    first = np.flatnonzero(edge & valid)
    closing = np.ones(n, dtype=bool)
    closing[:-1] = edge[1:] | ~valid[1:]
    last = np.flatnonzero(closing & valid)
    place = owner[first]
    return hashes[place] & ~_ONE, np.searchsorted(offs, first, side="right") - 1, first, last, place


def anchor_runs(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, ...]:
    """``placed_runs`` without the places of the anchors."""
    return placed_runs(data, offs, length, key)[:4]


def side_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple:
    """``(content, left, right)`` of runs: hashes of their bytes, and of the bytes beside the anchor, in ``SIDE_BITS`` bits, 0 if no string of
    the run holds them.

    A string holds ``length - key`` bytes beside its anchor, half of them at least on one side. So equal strings of two runs have
    equal bytes of that number on the same side of their anchors: runs with neither side in common share no string.
    """
    half = (length - key + 1) // 2
    has_left, has_right = first <= place - half, last + length >= place + key + half
    begin = np.concatenate((first, np.where(has_left, place - half, place), np.where(has_right, place + key, place)))
    end = np.concatenate((last + length, place, np.where(has_right, place + key + half, place)))
    content, left, right = np.split(span_hashes(data, begin, end), 3)
    shift = np.uint64(64 - SIDE_BITS)
    left, right = (np.where(has, np.maximum(h >> shift, _ONE), np.uint64(0)) for has, h in ((has_left, left), (has_right, right)))
    return content >> np.uint64(64 - CONTENT_BITS), left, right


# ---------------------------------------------------------------- the merge


def merge_transforms(data: np.ndarray, last: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms of many strings: starts of their ``depth``-byte substrings in sorted order, and block boundaries.

    ``last`` holds, for each such substring, the position behind its end. Every string is a shard; a row is a suffix, its symbol
    the byte before it. A round takes the rows in their present interleave, stably by their symbols: that is the order, by one
    byte more, of the suffixes one byte longer. Nothing is ever sorted but single symbols. Of each string only the rows that a
    substring passes through in this round are carried. Where two neighbours come from different blocks or symbols, their common
    prefix is shorter than the round's number, so a boundary stands between them; rounds refine the blocks, and after ``depth``
    rounds a block is one repeated substring.
    """
    rows = last
    edge = np.zeros(len(rows), dtype=bool)
    edge[:1] = True
    for _ in range(depth):
        symbol = data[rows - 1]
        order = np.argsort(symbol, kind="stable")
        block = np.cumsum(edge, dtype=np.int32)[order]
        symbol = symbol[order]
        rows = rows[order] - 1
        edge[1:] = (block[1:] != block[:-1]) | (symbol[1:] != symbol[:-1])
    return rows, edge


def lowest_owner(data: np.ndarray, begin: np.ndarray, end: np.ndarray, owners: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every start of a ``length``-byte string in the pieces ``data[begin:end]``, piece after piece, the least owner of an
    equal string."""
    counts = np.maximum(end - begin - length + 1, 0)
    starts = spread_ranges(begin, counts)
    if not len(starts):
        return np.zeros(0, dtype=owners.dtype)
    rows, edge = merge_transforms(data, starts + length, length)
    slot = np.empty(len(data), dtype=np.int64)
    slot[starts] = np.arange(len(starts))
    at = slot[rows]
    least = np.minimum.reduceat(np.repeat(owners, counts)[at], np.flatnonzero(edge))
    found = np.empty(len(starts), dtype=owners.dtype)
    found[at] = least[np.cumsum(edge) - 1]
    return found


# ---------------------------------------------------------------- the distributed operator


def _packed(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def _anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Anchors of every text with a hash of their run's bytes, dealt to buckets: packed rows ``(bucket, names, contents, sides, docs)``."""

    def run(batches):
        for whole in batches:
            for batch in steps(whole, "text", ANCHOR_STEP):
                data, offs = text_buffer(batch.column("text"))
                hashes, row, first, last, place = placed_runs(data, offs, length)
                if not len(hashes):
                    continue
                names = hashes >> np.uint64(64 - NAME_BITS)
                contents, left, right = side_hashes(data, first, last, place, length)
                sides = (left << np.uint64(SIDE_BITS)) | right
                keys = batch.column("doc_id").to_numpy()[row]
                order = np.lexsort((keys, sides, contents, names))
                names, contents, sides, keys = (x[order] for x in (names, contents, sides, keys))
                fresh = np.ones(len(names), dtype=bool)
                fresh[1:] = np.any([x[1:] != x[:-1] for x in (names, contents, sides, keys)], axis=0)
                names, contents, sides, keys = (x[fresh] for x in (names, contents, sides, keys))
                bucket = ((names >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(NAME_BITS - 16)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(cuts))
                parts = [slice(cuts[b], cuts[b + 1]) for b in used]
                yield pa.record_batch(
                    [
                        pa.array(used, pa.int32()),
                        pa.array([_packed(names[p], NAME_BITS // 8) for p in parts], pa.binary()),
                        pa.array([_packed(contents[p], CONTENT_BITS // 8) for p in parts], pa.binary()),
                        pa.array([_packed(sides[p], SIDE_BITS // 4) for p in parts], pa.binary()),
                        pa.array([keys[p].tobytes() for p in parts], pa.binary()),
                    ],
                    names=["bucket", "names", "contents", "sides", "docs"],
                )

    return docs.mapInArrow(run, "bucket int, names binary, contents binary, sides binary, docs binary")


def _shared_anchors(anchors: DataFrame, parts: int, hot: int) -> DataFrame:
    """``(doc_id, name)`` of the anchors that two documents or more hold; the lowest bits of the name say how to go on.

    If all runs of an anchor are equal, each but the lowest document's is covered as it stands (``COVERED``). Else the runs that have a
    side of the anchor in common with another document's have to be compared; where more than ``hot`` of them do, they travel
    string by string (``SPLIT``).
    """

    def met(name: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether another document has the same side of the same anchor."""
        found = np.zeros(len(name), dtype=bool)
        at = np.flatnonzero(side)
        if not len(at):
            return found
        both = (name[at] << np.uint64(SIDE_BITS)) | side[at]
        at, both = (x[np.lexsort((doc[at], both))] for x in (at, both))
        cuts = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        size = np.diff(np.append(cuts, len(both)))
        found[at] = np.repeat(doc[at[cuts]] != doc[at[cuts + size - 1]], size)
        return found

    def judged(names: list[bytes], contents: list[bytes], sides: list[bytes], docs: list[bytes]):
        name = _unpacked(b"".join(names), NAME_BITS // 8)
        content = _unpacked(b"".join(contents), CONTENT_BITS // 8)
        side = _unpacked(b"".join(sides), SIDE_BITS // 4)
        doc = np.frombuffer(b"".join(docs), dtype=np.int64)
        order = np.lexsort((doc, name))
        name, content, side, doc = name[order], content[order], side[order], doc[order]
        start = np.ones(len(name), dtype=bool)
        start[1:] = name[1:] != name[:-1]
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(name)))
        lowest = doc[at]
        shared = lowest != doc[at + size - 1]
        equal = np.minimum.reduceat(content, at) == np.maximum.reduceat(content, at)
        likely = np.repeat(shared & ~equal, size)
        low = np.uint64((1 << SIDE_BITS) - 1)
        likely[likely] = np.any([met(name[likely], s, doc[likely]) for s in (side[likely] >> np.uint64(SIDE_BITS), side[likely] & low)], axis=0)
        flag = np.where(equal, COVERED, np.where(np.add.reduceat(likely, at, dtype=np.int64) > hot, SPLIT, 0)).astype(np.uint64)
        keep = likely | (np.repeat(shared & equal, size) & (doc > np.repeat(lowest, size)))
        marked = ((name << np.uint64(2)) | np.repeat(flag, size))[keep].view(np.int64)
        doc = doc[keep]
        for lo in range(0, len(doc), 1 << 17):
            yield pa.record_batch([pa.array(doc[lo : lo + (1 << 17)]), pa.array(marked[lo : lo + (1 << 17)])], names=["doc_id", "name"])

    def run(batches):
        held: list[tuple] = []
        bucket = None
        for batch in batches:
            for b, *packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "names", "contents", "sides", "docs")), strict=True):
                if b != bucket and held:
                    yield from judged(*zip(*held, strict=True))
                    held = []
                bucket = b
                held.append(tuple(packed))
        if held:
            yield from judged(*zip(*held, strict=True))
            held = []
        release_memory()

    dealt = anchors.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "doc_id long, name long")


_PIECE = "route long, piece binary, doc_id long, h int, at int, size int"
_SPAN = "doc_id long, h int, at int, size int"


def _pieces(texts: DataFrame, length: int) -> DataFrame:
    """Runs with a shared anchor, cut out. Of equal pieces of a batch only the one of the lowest document travels on; the others
    are covered by it, so they leave as spans, without a piece."""

    def run(batches):
        for whole in batches:
            for batch in steps(whole, "text"):
                data, offs = text_buffer(batch.column("text"))
                names, row, first, last = anchor_runs(data, offs, length)
                lists = batch.column("names")
                flat = np.frombuffer(lists.flatten().to_numpy().tobytes(), dtype=np.uint64)
                counts = np.diff(lists.offsets.to_numpy())
                of_row = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), counts)
                known = mix((flat >> np.uint64(2)) + mix(of_row))
                sort = np.argsort(known)
                asked = mix((names >> np.uint64(64 - NAME_BITS)) + mix(row.astype(np.uint64)))
                slot = np.minimum(np.searchsorted(known[sort], asked), len(known) - 1)
                hit = known[sort][slot] == asked
                flag = flat[sort][slot] & np.uint64(3)
                done, hot = hit & (flag == COVERED), hit & (flag == SPLIT)
                cool = hit & (flag == 0)
                # strings of hot anchors travel one by one
                singles = spread_ranges(first[hot], (last - first + 1)[hot])
                begin = np.concatenate((first[cool], singles))
                end = np.concatenate((last[cool], singles)) + length
                owner = np.concatenate((row[cool], np.repeat(row[hot], (last - first + 1)[hot])))
                content = span_hashes(data, begin, end)
                route = np.concatenate((names[cool], content[int(cool.sum()) :]))
                keys = batch.column("doc_id").to_numpy()
                order = np.lexsort((keys[owner], content))
                begin, end, owner, content, route = (x[order] for x in (begin, end, owner, content, route))
                doc = keys[owner]
                lead = np.ones(len(begin), dtype=bool)
                lead[1:] = content[1:] != content[:-1]
                lowest = doc[np.flatnonzero(lead)][np.cumsum(lead) - 1] if len(doc) else doc
                covered = doc > lowest
                # equal pieces of the lowest document itself travel too
                go = np.flatnonzero(~covered)
                span_from, span_to, span_row = _union(
                    np.concatenate((begin[covered], first[done])),
                    np.concatenate((end[covered], last[done] + length)),
                    np.concatenate((owner[covered], row[done])),
                )
                marks = batch.column("h").to_numpy()
                m = len(span_from)
                cut = np.concatenate(([0], np.cumsum((end - begin)[go]), np.full(m, (end - begin)[go].sum()))).astype(np.int32)
                valid = pa.array([True] * len(go) + [False] * m).buffers()[1] if m else None
                body = data[spread_ranges(begin[go], (end - begin)[go])]
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate((route[go].view(np.int64), keys[span_row]))),
                        pa.Array.from_buffers(pa.binary(), len(go) + m, [valid, pa.py_buffer(cut), pa.py_buffer(body)]),
                        pa.array(np.concatenate((doc[go], keys[span_row]))),
                        pa.array(np.concatenate((marks[owner[go]], marks[span_row]))),
                        pa.array(np.concatenate((begin[go] - offs[owner[go]], span_from - offs[span_row])).astype(np.int32)),
                        pa.array(np.concatenate(((end - begin)[go], span_to - span_from)).astype(np.int32)),
                    ],
                    names=["route", "piece", "doc_id", "h", "at", "size"],
                )

    return texts.mapInArrow(run, _PIECE)


def _union(begin: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge spans of a row that touch or overlap; positions of different rows never overlap."""
    if not len(begin):
        return begin, end, row
    order = np.lexsort((begin, row))
    begin, end, row = begin[order], end[order], row[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (begin[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return begin[at], np.maximum.reduceat(end, at), row[at]


def covered_spans(route: np.ndarray, data: np.ndarray, offs: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(piece, at, size)`` of the stretches of pieces that equal strings of lower documents cover.

    Equal pieces are taken once, for their lowest document. A route with one distinct piece needs no merge: all its strings
    belong to that document.
    """
    begin, end = offs[:-1], offs[1:]
    _, sample, which = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
    owner = np.full(len(sample), np.iinfo(np.int64).max)
    np.minimum.at(owner, which, doc)
    counts = (end - begin)[sample] - length + 1
    bounds = np.concatenate(([0], np.cumsum(counts)))
    least = np.repeat(owner, counts)
    _, of_route, often = np.unique(route[sample], return_inverse=True, return_counts=True)
    several = often[of_route] > 1
    least[spread_ranges(bounds[:-1][several], counts[several])] = lowest_owner(
        data, begin[sample][several], end[sample][several], owner[several], length
    )
    mine = counts[which]
    hit = least[spread_ranges(bounds[:-1][which], mine)] < np.repeat(doc, mine)
    edges = np.concatenate(([0], np.cumsum(mine)))
    first, last = hit.copy(), hit.copy()
    first[1:] &= ~hit[:-1]
    first[edges[:-1]] |= hit[edges[:-1]]
    last[:-1] &= ~hit[1:]
    last[edges[1:] - 1] |= hit[edges[1:] - 1]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    piece = np.searchsorted(edges, lo, side="right") - 1
    return piece, lo - edges[piece], hi - lo + length


def _covered(pieces: DataFrame, length: int) -> DataFrame:
    """Spans that an equal string of a lower document covers, from pieces that meet by their route."""
    span = ["doc_id", "h", "at", "size"]

    def spans(table: pa.Table) -> pa.RecordBatch:
        data, offs = text_buffer(table.column("piece"))
        doc = table.column("doc_id").to_numpy()
        piece, at, size = covered_spans(table.column("route").to_numpy(), data, offs, doc, length)
        at = at + table.column("at").to_numpy()[piece]
        return pa.record_batch(
            [pa.array(doc[piece]), pa.array(table.column("h").to_numpy()[piece]), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))],
            names=span,
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            tied = pc.is_valid(batch.column("piece"))
            loose = batch.filter(pc.invert(tied))
            if loose.num_rows:
                yield loose.select(span)
            batch = batch.filter(tied)
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("piece").nbytes
            if size < MERGE_BYTES:
                continue
            table = pa.Table.from_batches(held)
            route = table.column("route").to_numpy()
            cut = int(np.searchsorted(route, route[-1]))
            if cut:
                yield spans(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = sum(b.column("piece").nbytes for b in held)
        if held:
            yield spans(pa.Table.from_batches(held))
            held = []
        release_memory()

    return pieces.repartition("route").sortWithinPartitions("route").mapInArrow(run, _SPAN)


def _cut(texts: DataFrame, length: int, as_text: bool) -> DataFrame:
    """Apply the spans to whole texts; ``kept`` is the rest as bytes, or as a string without the characters that were cut through."""

    def spans_of(batch: pa.RecordBatch, row: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        hs, ats, sizes = (batch.column(c)[row].values for c in ("hs", "ats", "sizes"))
        if hs is None:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        mine = hs.to_numpy() == batch.column("h")[row].as_py()
        begin, long = ats.to_numpy()[mine].astype(np.int64), sizes.to_numpy()[mine]
        if size >= length and (begin == WHOLE).any():
            return np.array([0]), np.array([size])
        begin, long = begin[begin != WHOLE], long[begin != WHOLE]
        lo, hi, _ = _union(begin, begin + long, np.zeros(len(begin), np.int64))
        return lo, hi

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in range(batch.num_rows):
            raw = batch.column("text")[row].as_py().encode()
            lo, hi = spans_of(batch, row, len(raw))
            edges = [0, *np.column_stack((lo, hi)).ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            digest = hashlib.sha256(kept).hexdigest()
            readable = kept.decode("utf-8", errors="ignore") if as_text else kept
            out.append((len(raw), len(raw) - len(kept), len(lo), readable, digest, lo.tolist(), (hi - lo).tolist()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.record_batch(
            [batch.column("doc_id"), batch.column("rest"), *(pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))],
            names=["doc_id", "rest", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "starts", "sizes"],
        )

    def run(batches):
        for whole in batches:
            for batch in steps(whole, "text"):
                yield cut(batch)

    rest = texts.schema["rest"].dataType.simpleString()
    kinds = f"doc_id long, rest {rest}, n_bytes long, n_removed long, n_spans long, kept {"string" if as_text else "binary"}, kept_sha256 string, starts array<int>, sizes array<int>"
    return texts.mapInArrow(run, kinds)


def _cut_rows(docs: DataFrame, key: str, text: str, length: int, hot: int, rest: list, as_text: bool) -> DataFrame:
    """``cut_repeats`` with the struct of ``rest`` carried along each row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a needless alias would stay on one side of the joins below only, and each side would get an exchange of its own
    doc_id = F.col(key) if (key, docs.schema[key].dataType) == ("doc_id", LongType()) else F.col(key).cast("long").alias("doc_id")
    plain = docs.select(
        doc_id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.struct(*rest).alias("rest")
    )
    plain = plain.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(7), "text"))
    groups = plain.filter("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"))
    copied = stash(groups.filter("lowest < highest").select("h1", "h2", "lowest"))
    copies = plain.filter("doc_id is not null").select("doc_id", "h1", "h2").join(copied, ["h1", "h2"]).filter("doc_id > lowest")
    copies = copies.select("doc_id", F.hash("h1", "h2").alias("h"), F.lit(WHOLE).alias("at"), F.lit(WHOLE).alias("size"))
    if copied.isEmpty():
        marked = plain.withColumn("whole", F.lit(False))
    else:
        marked = plain.join(copied, ["h1", "h2"], "left").withColumn("whole", F.coalesce(F.col("doc_id") > F.col("lowest"), F.lit(False)))
    single = marked.filter("not whole and doc_id is not null").select("doc_id", "text")
    names = _shared_anchors(_anchors(single, length, BUCKETS * parts), parts, hot)
    names = stash(names).groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    # one exchange of the texts serves both joins, so both use the same columns and the same key, and nothing is joined before it;
    # rows that share a key are told apart by a part of their text's hash
    named = plain.select("doc_id", F.hash("h1", "h2").alias("h"), "text", "rest")
    dealt = named.filter("doc_id is not null").repartition("doc_id")
    hit = dealt.join(names, "doc_id").select("doc_id", "h", "text", "rest", "names")
    spans = _covered(_pieces(hit, length), length).unionByName(copies)
    spans = spans.groupBy("doc_id").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("h", "at", "size")])
    joined = dealt.join(spans, "doc_id", "left").select("doc_id", "h", "text", "rest", "hs", "ats", "sizes")
    nothing = [F.lit(None).cast("array<int>").alias(c) for c in ("hs", "ats", "sizes")]
    loose = named.filter("doc_id is null").select("doc_id", "h", "text", "rest", *nothing)
    return _cut(joined.unionByName(loose), length, as_text)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256, starts, sizes``.

    A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller key; strings are judged on
    the input. Null text is empty; texts shorter than ``length`` stay whole. Rows that share a key don't cover each other; a row
    with a null key covers nothing and stays whole. Exact copies of a whole text are found by two hashes before all else. An
    empty table gives no rows; further columns are not read. ``kept`` are bytes: a span may end inside a character; ``starts``
    and ``sizes`` are the spans that went.
    """
    return _cut_rows(docs, key, text, length, hot, [F.lit(0).alias("none")], as_text=False).drop("rest")


def cut_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``docs`` with what ``cut_repeats`` keeps as their text; characters that a cut runs through go as a whole. All other
    columns stay. A row whose whole text goes keeps an empty text; a null text stays null."""
    others = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    cut = _cut_rows(docs, key, text, length, hot, [docs[text].isNull().alias("none"), *others], as_text=True)
    back = F.when(F.col("rest.none"), F.lit(None).cast("string")).otherwise(F.col("kept"))
    columns = [F.col(f"rest.c{i}").alias(c) if c != text else back.alias(c) for i, c in enumerate(docs.columns)]
    return cut.select(*columns)
