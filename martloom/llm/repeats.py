"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

A byte goes if a string of `length` bytes over it also starts earlier. Sorting every suffix
of a corpus would shuffle each byte many times, so the doubling runs over a sample that
loses nothing: the *anchor* of a `length`-byte window is its `GRAM`-byte string of smallest
hash, and equal windows have equal anchors at equal offsets. The windows of one anchor form
a block. Positions are ranked by strings of growing length, a rank being a 64-bit hash, as
only equality matters; what is unique at one length is out at the next:

1. `GRAM` bytes choose the anchors, inside a task.
2. `MIDDLE` bytes to the right or left of the anchor, one of which lies in every window of
   the block: Spark sorts (rank, position) pairs, unique ranks leave.
3. The whole block, about `length` + 40 bytes: of equal blocks the later ones are repeated
   as a whole, and the first goes on only if the rank has other blocks too.
4. `length` bytes: for those blocks Spark sorts the pairs of ranks at a position and at the
   offset that completes the length; of equal pairs all but the first position are repeated.

Each task keeps only the first of equal strings before it shuffles and tells at once that
the later ones are repeated, and a rank that it meets with many different blocks goes
straight to the last step. So a rank that a third of all documents share sends a few rows a
task, never a row a document.

Documents are ordered by id. Defined results: null texts are empty; rows with a null id take
no part; rows that repeat an id and a text are one document, rows that repeat an id only are
ordered by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.frames import map_stream, packed, slices
from martloom.session import cut

LENGTH = 100
GRAM = 20
MIDDLE = 60
# Different blocks of one rank that a task sends on; more of them go straight to the last step.
BLOCKS_SENT = 8
SLICE = 1 << 21
POSITION_BITS = np.uint64(24)
PLACE = ("id", "t", "lo", "hi")


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and the powers of an odd base and of its inverse modulo 2 ** 64."""
    values = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(size + 1, b, dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


class Ranks:
    """Hashes of any substring of some bytes in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        size = max(SLICE * 2, 1 << int(len(data)).bit_length())
        values, up, self.down = powers(size)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        x = (self.sums[stop] - self.sums[start]) * self.down[start]
        return mixed(x + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1) * np.asarray(salt, dtype=np.uint64))

    def every(self, n: int) -> np.ndarray:
        """Hash of the `n` bytes from each position on."""
        size = max(0, len(self.sums) - n)
        return mixed((self.sums[n:] - self.sums[:size]) * self.down[:size])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def lowest(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each `n` neighbours, by doubling."""
    done, out = 1, x
    while done < n:
        step = min(done, n - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def blocks(data: np.ndarray, ends: np.ndarray, ranks: Ranks, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of the runs of windows that share an anchor.

    `ends` are where the documents in `data` end; windows lie in one document.
    """
    if len(data) < length:
        return (np.zeros(0, dtype=np.int64),) * 3
    place = np.uint64((1 << int(POSITION_BITS)) - 1)
    keys = ranks.every(GRAM)
    keys = (keys & ~place) | np.arange(len(keys), dtype=np.uint64)
    anchor = (lowest(keys, length - GRAM + 1) & place).astype(np.int64)
    window = np.arange(len(anchor))
    inside = window + length <= np.repeat(ends, np.diff(ends, prepend=0))[: len(anchor)]
    window, anchor = window[inside], anchor[inside]
    if not len(window):
        return (np.zeros(0, dtype=np.int64),) * 3
    new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(window) != 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(window)]]) - 1
    return anchor[first], window[first], window[last]


def halves(anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, lo, hi, left): blocks cut where the middle string changes sides.

    A window that starts at most `MIDDLE` - `GRAM` bytes before its anchor holds the middle
    string to the right of it, any other the one to the left.
    """
    turn = anchor - (length - MIDDLE)
    right = np.maximum(lo, turn) <= hi
    left = lo < turn
    return (
        np.concatenate([anchor[right], anchor[left]]),
        np.concatenate([np.maximum(lo, turn)[right], lo[left]]),
        np.concatenate([hi[right], np.minimum(hi, turn - 1)[left]]),
        np.repeat([False, True], [right.sum(), left.sum()]),
    )


def by_group(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by `keys` (the last one first) and which rows begin a new group of the last key."""
    order = np.lexsort(keys)
    top = keys[-1][order]
    return order, np.concatenate([[True], top[1:] != top[:-1]]) if len(top) else np.zeros(0, dtype=bool)


def number(starts: np.ndarray) -> np.ndarray:
    """Index of the group of each row."""
    return np.cumsum(starts) - 1


def merged(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching runs [lo, end) of each document joined."""
    if not len(doc):
        return doc, lo, end
    order = np.lexsort((lo, doc))
    doc, lo, end = doc[order], lo[order], end[order]
    # Documents are spread far apart, so that a running maximum never crosses them.
    far = (doc - doc.min()) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + far)
    new = np.concatenate([[True], (lo + far)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], lo[first], reach[last] - far[last]


def texts_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts one after another, and where each ends."""
    texts = [t or b"" for t in batch.column("text").to_pylist()]
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


class Rows:
    """Rows of one batch under way: what is repeated, what must be compared on, what is asked for."""

    KIND = "kind tinyint, a bigint, b bigint, many boolean, id bigint, t bigint, lo bigint, hi bigint"
    REPEATED, SENT, ASKED = 0, 1, 2

    @staticmethod
    def of(kind: int, place: dict, a: np.ndarray | None = None, b: np.ndarray | None = None, many: np.ndarray | None = None) -> dict:
        n = len(place["id"])
        zero = np.zeros(n, dtype=np.int64)
        out = {"kind": np.full(n, kind, dtype=np.int8), "many": np.zeros(n, dtype=bool) if many is None else many}
        out |= {"a": zero if a is None else a.view(np.int64), "b": zero if b is None else b.view(np.int64)}
        return out | {c: place[c] for c in PLACE}


def picked(place: dict, rows: np.ndarray) -> dict:
    return {c: x[rows] for c, x in place.items()}


def repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept): each document without its repeated bytes."""
    rows = packed(docs, id_col, text_col).select("id", F.coalesce("text", F.lit(b"")).alias("text"))
    known = rows.where("id is not null").select("id", "text", F.crc32("text").alias("t"))
    sent = map_stream(known, Rows.KIND, lambda parts: _send_blocks(parts, length))
    found = cut(_dealt(sent, lambda parts: _settle_blocks(parts, length)), "blocks")
    asked = found.where(F.col("kind") == Rows.ASKED).groupBy("id", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    windows = map_stream(
        known.join(asked, ["id", "t"]).select("id", "t", "text", "runs"), Rows.KIND, lambda parts: _send_windows(parts, length)
    )
    late = _dealt(windows, lambda parts: _settle_windows(parts, length))
    gone = found.where(F.col("kind") == Rows.REPEATED).unionByName(late).where(F.col("kind") == Rows.REPEATED)
    # `hi` is the end of a repeated run here.
    gone = gone.groupBy("id", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    joined = known.join(gone, ["id", "t"], "left").select("id", "text", "runs")
    nothing = F.lit(None).cast(joined.schema["runs"].dataType).alias("runs")
    joined = joined.unionByName(rows.where("id is null").select("id", "text", nothing))
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return map_stream(joined, schema, _without_runs).withColumnRenamed("id", id_col)


def _dealt(sent: DataFrame, settle: object) -> DataFrame:
    """Rows dealt out and sorted by their rank, then settled group by group."""
    spread = F.when(F.col("kind") == Rows.SENT, F.col("a")).otherwise(F.xxhash64("id", "t", "lo"))
    dealt = sent.withColumn("a", spread)
    number_of = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_stream(dealt.repartition(number_of, "a").sortWithinPartitions("a"), Rows.KIND, settle)


def _send_blocks(parts: Iterable[pa.RecordBatch], length: int) -> Iterator[dict]:
    for batch in pieces_of(parts, length):
        data, ends, ids, t, base = batch
        ranks = Ranks(data)
        anchor, lo, hi, left = halves(*blocks(data, ends, ranks, length), length)
        if not len(anchor):
            continue
        doc = np.searchsorted(ends, lo, "right")
        begin = ends[doc] - np.diff(ends, prepend=0)[doc]
        middle = np.where(left, anchor - (MIDDLE - GRAM), anchor)
        a = ranks(middle, middle + MIDDLE, left.astype(np.uint64))
        b = ranks(lo, hi + length, (anchor - lo).astype(np.uint64) + np.uint64(1 << 32))
        shift = base[doc] - begin
        place = {"id": ids[doc], "t": t[doc], "lo": lo + shift, "hi": hi + shift}
        order, new = by_group(place["lo"], place["t"], place["id"], b, a)
        a, b, place = a[order], b[order], picked(place, order)
        fresh = new | np.concatenate([[True], b[1:] != b[:-1]])
        yield _repeated(place, fresh, length)
        # Ranks with many different blocks: one row goes on, all blocks are asked for.
        a, b, new, place = a[fresh], b[fresh], new[fresh], picked(place, fresh)
        group = number(new)
        many = np.bincount(group)[group] > BLOCKS_SENT
        go = ~many | new
        yield Rows.of(Rows.SENT, picked(place, go), a[go], b[go], many[go])
        yield Rows.of(Rows.ASKED, picked(place, many))


def pieces_of(parts: Iterable[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(data, ends, ids, t, base): texts in slices of bounded size; long ones cut with an overlap.

    `base` is where a piece starts in its document.
    """
    step = 2 * SLICE
    for batch in slices(parts, "text", SLICE):
        ids, t = (batch.column(c).to_numpy() for c in ("id", "t"))
        data, ends = texts_of(batch)
        if batch.num_rows > 1 or len(data) <= step + length:
            yield data, ends, ids, t, np.zeros(len(ids), dtype=np.int64)
            continue
        for start in range(0, len(data) - length + 1, step):
            piece = data[start : start + step + length - 1]
            yield piece, np.array([len(piece)]), ids, t, np.array([start])


def _repeated(place: dict, fresh: np.ndarray, length: int) -> dict:
    """Rows for the places that are not the first of their group; a place is no repeat of itself."""
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
    same = np.ones(len(fresh), dtype=bool)
    for c in ("id", "t", "lo"):
        same &= place[c] == place[c][first]
    late = picked(place, ~fresh & ~same)
    keys, doc = np.unique(np.stack([late["id"], late["t"]]), axis=1, return_inverse=True)
    doc, lo, end = merged(doc.reshape(-1).astype(np.int64), late["lo"], late["hi"] + length)
    return Rows.of(Rows.REPEATED, {"id": keys[0][doc], "t": keys[1][doc], "lo": lo, "hi": end})


def _groups(parts: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Column arrays that hold whole groups of `a` of rows sorted by it."""
    names = ("kind", "a", "b", "many", *PLACE)
    held: list[dict] = []
    for batch in parts:
        if not batch.num_rows:
            continue
        own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        whole = int(np.searchsorted(own["a"], own["a"][-1]))
        if whole:
            yield {c: np.concatenate([*(h[c] for h in held), own[c][:whole]]) for c in names}
            held = []
        held.append({c: x[whole:] for c, x in own.items()})
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in names}


def _settle(rows: dict, length: int) -> tuple[dict, dict, np.ndarray, np.ndarray, np.ndarray]:
    """What has been settled before, and the first places of equal (a, b) with their groups."""
    compare = rows["kind"] == Rows.SENT
    done = {c: x[~compare] for c, x in rows.items()}
    rows = {c: x[compare] for c, x in rows.items()}
    order, new = by_group(rows["lo"], rows["t"], rows["id"], rows["b"], rows["a"])
    rows = {c: x[order] for c, x in rows.items()}
    fresh = new | np.concatenate([[True], rows["b"][1:] != rows["b"][:-1]]) if len(new) else new
    return done, rows, new, fresh, number(new)


def _settle_blocks(parts: Iterable[pa.RecordBatch], length: int) -> Iterator[dict]:
    for rows in _groups(parts):
        done, rows, _, fresh, group = _settle(rows, length)
        if len(done["id"]):
            yield done
        if not len(fresh):
            continue
        place = {c: rows[c] for c in PLACE}
        yield _repeated(place, fresh, length)
        several = np.bincount(group, weights=fresh) > 1
        several |= np.bincount(group, weights=rows["many"]) > 0
        yield Rows.of(Rows.ASKED, picked(place, fresh & several[group]))


def _send_windows(parts: Iterable[pa.RecordBatch], length: int) -> Iterator[dict]:
    for batch in slices(parts, "text", SLICE):
        data, ends = texts_of(batch)
        begin = ends - np.diff(ends, prepend=0)
        runs = batch.column("runs")
        doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(runs.offsets)))
        runs = runs.flatten()
        lo, hi = (runs.field(c).to_numpy().astype(np.int64) + begin[doc] for c in ("lo", "hi"))
        size = hi - lo + 1
        doc = np.repeat(doc, size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        at, own = np.unique(at, return_index=True)
        doc = doc[own]
        ranks = Ranks(data)
        a = ranks(at, at + MIDDLE + 4, 1)
        b = ranks(at + length - MIDDLE - 4, at + length, 2)
        ids, t = (batch.column(c).to_numpy() for c in ("id", "t"))
        place = {"id": ids[doc], "t": t[doc], "lo": at - begin[doc], "hi": at - begin[doc]}
        order, new = by_group(place["lo"], place["t"], place["id"], b, a)
        a, b, place = a[order], b[order], picked(place, order)
        fresh = new | np.concatenate([[True], b[1:] != b[:-1]]) if len(new) else new
        if len(fresh):
            yield _repeated(place, fresh, length)
            yield Rows.of(Rows.SENT, picked(place, fresh), a[fresh], b[fresh])


def _settle_windows(parts: Iterable[pa.RecordBatch], length: int) -> Iterator[dict]:
    for rows in _groups(parts):
        done, rows, _, fresh, _ = _settle(rows, length)
        if len(done["id"]):
            yield done
        if len(fresh):
            yield _repeated({c: rows[c] for c in PLACE}, fresh, length)


def _without_runs(parts: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in slices(parts, "text", SLICE * 4):
        out = {"id": batch.column("id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs"), strict=True):
            kept, spans, at = [], 0, 0
            if runs.is_valid:
                lo, end = (runs.values.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
                _, lo, end = merged(np.zeros(len(lo), dtype=np.int64), lo, end)
                for start, stop in zip(lo.tolist(), end.tolist(), strict=True):
                    kept.append(text[at:start])
                    at, spans = stop, spans + 1
            kept = b"".join([*kept, text[at:]])
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(spans)
            out["kept"].append(kept)
        yield out
