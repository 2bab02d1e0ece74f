"""Near-duplicate texts by an LSH forest over MinHash signatures.

A signature is 80 minimum hashes, cut into ten orders of eight. In each order the distinct shingle sets are sorted by their
eight values, and each one is linked with the neighbour of longest common prefix that agrees with it best, down to
``least_depth`` shared values. In a sparse region a prefix of that depth is all that neighbours share; in a dense one the
neighbours lie deeper, so the depth adapts. Regions (sets with one prefix of ``least_depth`` values) that these links leave in
several components are settled exactly, whatever their width: their members meet by rare shingles. Every link is confirmed on
full sets. Only signatures travel through the orders; sets are joined to distinct candidate pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwell.llm.common import mix, ngram_hashes, release_memory, stash, steps, word_hashes
from markwell.llm.components import components

SHINGLE = 5
PERCENT = 85
ORDERS = 10
ORDER_DEPTH = 8
# Two sets at 0.85 share three leading values of an order with chance 0.85^3, so ten orders miss one pair in 13,000. For other
# thresholds the depth is the largest that misses no more.
MISSED = 1 / 13_000
# Neighbours among which each row of an order picks the best; what they leave open is settled exactly.
WINDOW = 32
# Counters of the sketch that orders shingles from rare to common; more of them only make the order sharper.
SKETCH = 1 << 20
# Bits (a power of two) of the filter that spares texts without a near neighbour a second scan for shingles.
ID_BITS = 26

_VALUES = ORDERS * ORDER_DEPTH


def least_agreement(percent: int) -> float:
    """Neighbours whose signatures agree less are no candidates: four standard deviations below the threshold."""
    share = percent / 100
    return share - 4 * (share * (1 - share) / _VALUES) ** 0.5


def least_depth(percent: int) -> int:
    """Leading values of an order that two sets share before they are compared."""
    return max((d for d in range(1, ORDER_DEPTH + 1) if (1 - (percent / 100) ** d) ** ORDERS <= MISSED), default=1)


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, _VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _short_sets(words: np.ndarray, first: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Rows with some but fewer than ``n`` words: the whole sequence is the one shingle."""
    for row in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n)):
        total = np.uint64(len(words[first[row] : first[row + 1]]))
        for word in words[first[row] : first[row + 1]]:
            total = mix(total * np.uint64(0xA0761D6478BD642F) + word)
        yield int(row), int(total)


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    with np.errstate(over="ignore"):
        words, first = word_hashes(column, lower=True)
        grams, bounds = ngram_hashes(words, first, n)
        sets = [np.unique(grams[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]
        for row, value in _short_sets(words, first, n):
            sets[row] = np.array([value], dtype=np.uint64)
    return sets


def set_id(values: np.ndarray) -> int:
    """A 63-bit name of a set; equal sets have equal names."""
    with np.errstate(over="ignore"):
        name = mix(np.array([mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(values))], dtype=np.uint64))
    return int(name[0] >> np.uint64(1))


def signature(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    lows = np.full(_VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(values), 4096):
        part = (values[at : at + 4096][None, :] * multipliers[:, None]) >> np.uint64(32)
        np.minimum(lows, part.min(axis=1).astype(np.uint32), out=lows)
    return lows


def _describe(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, n_shingles, set_id, signature)`` per row."""

    def run(batches):
        multipliers = _multipliers()
        for whole in batches:
            for batch in steps(whole, "text"):
                sets = shingle_sets(batch.column("text"), shingle)
                yield pa.record_batch(
                    [
                        batch.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                        # big-endian, so that bytes sort as the values do
                        pa.array([signature(s, multipliers).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "signature"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id long, signature binary")


def _bits_of(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def _id_bits(wanted: DataFrame) -> np.ndarray:
    """A bit array of fixed size with a bit for each wanted ``doc_id``; it can only let too many pass."""

    def run(batches):
        bits = np.zeros(1 << ID_BITS, dtype=bool)
        for batch in batches:
            bits[_bits_of(batch.column("doc_id").to_numpy())] = True
        packed = np.packbits(bits)
        some = np.flatnonzero(packed)
        for lo in range(0, len(some), 1 << 16):
            part = some[lo : lo + (1 << 16)]
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(packed[part], pa.int32())], names=["at", "bits"])

    found = wanted.select("doc_id").mapInArrow(run, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros((1 << ID_BITS) // 8, dtype=np.uint8)
    packed[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return packed


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(set_id, members)`` for the wanted ``(doc_id, set_id)``, from the texts again; texts are not shuffled."""
    packed = docs.sparkSession.sparkContext.broadcast(_id_bits(wanted))

    def run(batches):
        for whole in batches:
            asked = whole.filter(pc.is_valid(whole.column("doc_id")))
            at = _bits_of(asked.column("doc_id").to_numpy())
            asked = asked.filter(pa.array((packed.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            for batch in steps(asked, "text"):
                sets = shingle_sets(batch.column("text"), shingle)
                some = [row for row, values in enumerate(sets) if len(values)]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(some, pa.int64())),
                        pa.array([set_id(sets[row]) for row in some], pa.int64()),
                        pa.array([sets[row].tobytes() for row in some], pa.binary()),
                    ],
                    names=["doc_id", "set_id", "members"],
                )

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_id long, members binary")
    # repeated rows count once
    return found.join(wanted, ["doc_id", "set_id"], "left_semi").dropDuplicates(["set_id"]).select("set_id", "members")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _best_neighbours(rows: DataFrame, percent: int, window: int) -> DataFrame:
    """Walk the sorted orders: for each row the one of the ``window`` rows before it with its prefix that agrees with it best."""
    depth, least = least_depth(percent), least_agreement(percent)

    def run(batches):
        head = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, _VALUES), np.uint32))
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                raw = b"".join(batch.column("signature").to_pylist())
                old = len(head[1])
                order = np.concatenate((head[0], batch.column("place").to_numpy().astype(np.int64)))
                ids = np.concatenate((head[1], batch.column("set_id").to_numpy()))
                sigs = np.concatenate((head[2], np.frombuffer(raw, dtype=">u4").reshape(batch.num_rows, _VALUES).astype(np.uint32)))
                lead = np.take_along_axis(sigs, order[:, None] * ORDER_DEPTH + np.arange(depth), axis=1)
                best = np.full(len(ids), np.nextafter(least, 0))
                mate = np.full(len(ids), -1)
                for shift in range(1, min(window, len(ids) - 1) + 1):
                    later = np.arange(max(old, shift), len(ids))
                    later = later[(order[later] == order[later - shift]) & (lead[later] == lead[later - shift]).all(axis=1)]
                    if not len(later):
                        break
                    agree = (sigs[later] == sigs[later - shift]).mean(axis=1)
                    better = later[agree > best[later]]
                    best[better] = agree[agree > best[later]]
                    mate[better] = better - shift
                found = np.flatnonzero(mate >= 0)
                a, b = ids[found], ids[mate[found]]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                head = (order[-window:], ids[-window:], sigs[-window:])
        release_memory()

    return rows.mapInArrow(run, "a long, b long").distinct()


def index_length(size: int, percent: int) -> int:
    """Leading shingles of a set of which any linked set of its size or larger shares one: it shares 2p / (100 + p) of the size."""
    return size - -(-2 * percent * size // (100 + percent)) + 1


def probe_length(size: int, percent: int) -> int:
    """Leading shingles of a set of which any linked set of its size or smaller shares one: it shares p / 100 of the size."""
    return size - -(-percent * size // 100) + 1


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many of the sets hold a shingle, counted by its low bits: an array of fixed size, whatever the number of sets."""

    def run(batches):
        counts = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for members in batch.column("members").to_pylist():
                at = (np.frombuffer(members, dtype=np.uint64) & np.uint64(SKETCH - 1)).astype(np.int64)
                np.add.at(counts, at, 1)
        some = np.flatnonzero(counts)
        for lo in range(0, len(some), 1 << 16):
            part = some[lo : lo + (1 << 16)]
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(counts[part])], names=["at", "n"])

    found = sets.select("members").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = found.select("at", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    counts = np.zeros(SKETCH, dtype=np.int32)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return counts


def _rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """``(shingle, set_id, component, size, position, indexed)``: the leading shingles of each set, from rare to common."""
    rarity = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                leading, sizes = [], []
                for members in batch.column("members").to_pylist():
                    values = np.frombuffer(members, dtype=np.uint64)
                    rare = np.lexsort((values, rarity.value[values & np.uint64(SKETCH - 1)]))
                    leading.append(values[rare[: probe_length(len(values), percent)]])
                    sizes.append(len(values))
                if not leading:
                    continue
                each = [len(x) for x in leading]
                columns = [
                    pa.array(np.concatenate(leading).view(np.int64)),
                    pa.array(np.repeat(batch.column("set_id").to_numpy(), each)),
                    pa.array(np.repeat(batch.column("component").to_numpy(), each)),
                    pa.array(np.repeat(np.array(sizes, np.int64), each)),
                    pa.array(np.concatenate([np.arange(n, dtype=np.int64) for n in each])),
                    pa.array(np.concatenate([np.arange(n) < index_length(size, percent) for n, size in zip(each, sizes, strict=True)])),
                ]
                yield pa.record_batch(columns, names=["shingle", "set_id", "component", "size", "position", "indexed"])
        release_memory()

    return sets.select("set_id", "component", "members").mapInArrow(
        run, "shingle long, set_id long, component long, size long, position long, indexed boolean"
    )


def _pairs_across(sets: DataFrame, percent: int) -> DataFrame:
    """All pairs ``(a, b)`` of sets in different components that can be linked.

    In one order of all shingles, a set shares one of its first ``index_length`` shingles with one of the first
    ``probe_length`` of any larger set it is linked with; the first that they share leaves enough behind it in both. A shingle
    whose sets all lie in one component is dropped before the join, so a group of copies that are linked already costs nothing.
    """
    rows = stash(_rare_shingles(sets, percent))
    mixed = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("shingle")
    open_rows = stash(rows.join(mixed, "shingle", "left_semi"))
    a = open_rows.filter("indexed").select("shingle", *[F.col(c).alias(f"a_{c}") for c in ("set_id", "component", "size", "position")])
    b = open_rows.select("shingle", *[F.col(c).alias(f"b_{c}") for c in ("set_id", "component", "size", "position")])
    met = a.join(b, "shingle").filter(
        (F.col("a_component") != F.col("b_component"))
        & ((F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_set_id") < F.col("b_set_id"))))
        & (100 * F.col("a_size") >= percent * F.col("b_size"))
        & (
            (100 + percent) * F.least(F.col("a_size") - F.col("a_position"), F.col("b_size") - F.col("b_position"))
            >= percent * (F.col("a_size") + F.col("b_size"))
        )
    )
    return met.select(F.least("a_set_id", "b_set_id").alias("a"), F.greatest("a_set_id", "b_set_id").alias("b")).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` that are linked, judged on full sets."""

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("a", "b", "left", "right"))
            good = [
                (a, b)
                for a, b, left, right in zip(*columns, strict=True)
                if linked(np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64), percent)
            ]
            yield pa.record_batch([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], names=["a", "b"])

    left = sets.select(F.col("set_id").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("set_id").alias("b"), F.col("members").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, window: int = WINDOW
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Texts are split into words at blanks after A-Z are lower-cased. A text with fewer than ``shingle`` words is one shingle; a
    text without words (null, empty, blank) has none and is linked with nothing. Equal sets are one node, whatever their number;
    rows that share a key are linked; a row with a null key is linked with nothing and kept. An empty table gives no rows;
    further columns are not read. A set is always judged whole, and read only if another set shares ``least_depth`` leading
    values of an order with it; a pair that shares them in no order is missed (``MISSED`` at the threshold, fewer above it).
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    described = stash(_describe(plain, shingle))
    named = described.filter("set_id is not null and doc_id is not null")
    distinct = stash(named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")))
    width = 4 * ORDER_DEPTH
    placed = distinct.select(
        "set_id", "doc_id", "signature", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("place")
    ).select("set_id", "doc_id", "place", F.substring("signature", F.col("place") * width + 1, F.lit(4 * least_depth(percent))).alias("prefix"))
    shared = placed.groupBy("place", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    regions = stash(placed.join(shared, ["place", "prefix"]))
    wanted = stash(regions.select("doc_id", "set_id").distinct())
    sets = stash(_sets_of(plain, wanted, shingle))
    rows = regions.select("set_id", "place").join(distinct.select("set_id", "signature"), "set_id")
    order = [F.col("place"), F.substring("signature", F.col("place") * width + 1, F.lit(width)), F.col("set_id")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    near = _best_neighbours(rows.select("place", "set_id", "signature"), percent, window)
    links = stash(_confirm(near, sets, percent))
    labels = components(links)
    placed = stash(regions.select("place", "prefix", "set_id").join(labels, regions["set_id"] == labels["node"], "left").select(
        "place", "prefix", "set_id", F.coalesce("component", "set_id").alias("component")
    ))
    mixed = placed.groupBy("place", "prefix").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
    unsettled = placed.join(mixed.select("place", "prefix"), ["place", "prefix"], "left_semi").select("set_id", "component").distinct()
    across = _confirm(_pairs_across(stash(sets.join(unsettled, "set_id")), percent), sets, percent)
    links = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(across)
    shared_key = named.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).filter("a != z")
    links = links.union(named.join(shared_key, "doc_id").filter("set_id != a").select("a", F.col("set_id").alias("b")))
    return _with_components(described, distinct, components(links))


def _with_components(described: DataFrame, distinct: DataFrame, labels: DataFrame) -> DataFrame:
    joined = distinct.select("set_id", "doc_id").join(labels, distinct["set_id"] == labels["node"], "left")
    joined = joined.select("set_id", "doc_id", F.coalesce("component", "set_id").alias("component"))
    lowest = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = stash(joined.join(lowest, "component").select("set_id", "component_id"))
    rows = described.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    component = F.coalesce("component_id", "doc_id")
    return rows.join(by_set, "set_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates those with its smallest key."""
    kept = near_duplicates(docs, key, text, **options).filter("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("key"))  # any column names are fine
    found = rows.join(kept, rows["key"] == kept["doc_id"], "left").filter("doc_id is not null or key is null")
    return found.select("row.*")
