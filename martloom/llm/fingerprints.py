"""I-Match fingerprints over randomised lexicons.

Terms are the words of a text in ASCII lower case. The lexicon keeps those whose document
frequency, and so whose inverse document frequency, lies in a band. A fingerprint hashes the
sorted different lexicon terms of a text, once for the whole lexicon and once for each of
`REPLICAS` x `len(LEVELS)` random subsets of it; the subsets get ever smaller, so that texts
of any length have some in which a moderate change touches no term. Likeness is the share
of equal hashes among subsets small enough to tell (`likeness`).

The lexicon is broadcast. Its size is bounded: documents have T different terms on average,
so at most T / share terms occur in that share of all documents, and the lower end of the
band is raised to T / `LEXICON` where `LOW` would allow more.

Defined results: a null text is empty; a text without a lexicon term is fingerprinted by all
its terms; the order is by id, null ids first, then by text, and after the last document
comes the first.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.frames import map_stream, packed, slices
from martloom.session import cut

LOW, HIGH = 0.001, 0.25
LEXICON = 1 << 20
LEVELS = tuple(range(2, 12))
REPLICAS = 6
DIGITS = 4
MASK = (1 << 4 * DIGITS) - 1
EMPTY = "-" * DIGITS
SEEDS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(1, REPLICAS + 1)], dtype=np.uint64)


def term_hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def lexicon(rows: DataFrame, low: float = LOW, high: float = HIGH, bound: int = LEXICON) -> np.ndarray:
    """Sorted hashes of the terms in the band, from the texts of a packed table."""

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(parts, "text", 1 << 24):
            found: Counter = Counter()
            for text in batch.column("text").to_pylist():
                found.update(set((text or b"").lower().split()))
            hashes = np.array([term_hash(t) for t in found], dtype=np.uint64)
            yield {"h": hashes.view(np.int64), "n": list(found.values())}

    counts = cut(map_stream(rows.select("text"), "h bigint, n bigint", count).groupBy("h").agg(F.sum("n").alias("n")), "terms")
    documents = rows.count()
    pairs = counts.agg(F.sum("n")).first()[0] or 0
    least = max(low * documents, pairs / bound, 1.0)
    band = counts.where((F.col("n") >= least) & (F.col("n") <= max(1.0, high * documents))).select("h").toArrow()
    return np.sort(np.asarray(band["h"].to_numpy()).view(np.uint64))


class Fingerprinter:
    """Fingerprints of texts; words met before need no second look-up."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms, self.known = terms, {}

    def _look_up(self, words: set[bytes]) -> None:
        if len(self.known) > 500_000:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        hashes = np.array([term_hash(w) for w in new], dtype=np.uint64)
        at = np.searchsorted(self.terms, hashes)
        inside = at < len(self.terms)
        inside[inside] = self.terms[at[inside]] == hashes[inside]
        self.known.update(zip(new, np.where(inside, hashes, np.uint64(0)).tolist(), strict=True))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Hashes of all subsets, a row per text; 0 where a subset holds no term of it."""
        sets = [set(t.lower().split()) for t in texts]
        self._look_up(set().union(*sets))
        found = [np.fromiter(map(self.known.__getitem__, s), dtype=np.uint64, count=len(s)) for s in sets]
        found = [f[f != 0] for f in found]
        ends = np.cumsum([0, *map(len, found)])
        terms = np.concatenate([*found, np.zeros(0, dtype=np.uint64)])
        values = mixed(terms)
        out = np.zeros((len(texts), 1 + REPLICAS * len(LEVELS)), dtype=np.uint64)
        out[:, 0] = self._sums(values, ends)
        for c, seed in enumerate(SEEDS):
            draw = mixed(terms ^ seed)
            for i, level in enumerate(LEVELS):
                inside = draw < np.uint64(1 << (64 - level))
                out[:, 1 + c * len(LEVELS) + i] = self._sums(np.where(inside, values, np.uint64(0)), ends)
        for i in np.flatnonzero(np.diff(ends) == 0):
            out[i, 0] = term_hash(b" ".join(sorted(sets[i])))
        return out

    @staticmethod
    def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each text's set of terms: equal for equal sorted sets, 0 for none."""
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values, out=sums[1:])
        return mixed(sums[ends[1:]] - sums[ends[:-1]])


def as_text(hashes: np.ndarray) -> list[str]:
    return ["".join(f"{x & MASK:0{DIGITS}x}" if x else EMPTY for x in row) for row in hashes.tolist()]


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the telling subsets of each pair of rows.

    Telling are the subsets that hold a term of either text, at the levels where some subset
    holds none: there most hold a single term, and the share follows the terms in common.
    Without such a level all subsets with a term of either text count.
    """
    some = (left != 0) | (right != 0)
    same = some & (left != 0) & (right != 0) & ((left & np.uint64(MASK)) == (right & np.uint64(MASK)))
    by_level = some[:, 1:].reshape(len(some), REPLICAS, len(LEVELS))
    sparse = np.repeat(~by_level.all(axis=1, keepdims=True), REPLICAS, axis=1).reshape(len(some), -1)
    telling = some.copy()
    telling[:, 0] = False
    telling[:, 1:] &= sparse
    telling = np.where(telling.any(axis=1, keepdims=True), telling, some)
    return (same & telling).sum(axis=1) / np.maximum(telling.sum(axis=1), 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) of every text."""
    rows = packed(docs, id_col, text_col).select("id", "text")
    terms = lexicon(rows)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        of = Fingerprinter(terms)
        for batch in slices(parts, "text", 1 << 23):
            yield {"id": batch.column("id"), "fingerprint": as_text(of([t or b"" for t in batch.column("text").to_pylist()]))}

    return map_stream(rows, "id bigint, fingerprint string", run).withColumnRenamed("id", id_col)


def in_order(rows: DataFrame) -> DataFrame:
    """(part, tail, id, text): rows in order within parts of ids, each with the row that follows it.

    Parts begin at ids that occur. Rows of the id that begins a part go to the part before
    too, marked `tail`, and those of the first id to the last part. The rows of a part lie
    in one partition, sorted, and there are more parts than partitions.
    """
    number = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / number) for i in range(1, number)])
    low, some_null, ends = rows.agg(
        F.min("id"), F.count_if(F.col("id").isNull()) > 0, F.percentile_approx("id", shares, F.lit(10 * number))
    ).first()
    first = None if some_null else low
    bounds = np.array(sorted({b for b in ends or [] if some_null or b != low}), dtype=np.int64)

    def deal(parts: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts:
            if not batch.num_rows:
                continue
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("id").fill_null(0).to_numpy()
            part = np.where(known, np.searchsorted(bounds, ids, "right"), 0)
            begins = known & (part > 0)
            begins[begins] = bounds[part[begins] - 1] == ids[begins]
            opens = ~known if first is None else known & (ids == first)
            rows_of = np.concatenate([np.arange(len(ids)), np.flatnonzero(begins), np.flatnonzero(opens)])
            some = batch.take(pa.array(rows_of))
            yield {
                "part": np.concatenate([part, part[begins] - 1, np.full(opens.sum(), len(bounds))]),
                "tail": np.arange(len(rows_of)) >= len(ids),
                "id": some.column("id"), "text": some.column("text"),
            }

    dealt = map_stream(rows.select("id", "text"), "part int, tail boolean, id bigint, text binary", deal)
    return dealt.repartition(number // 4, "part").sortWithinPartitions("part", "tail", "id", "text")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its second half from the next one, and their likeness.

    (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    """
    rows = packed(docs, id_col, text_col).select("id", F.coalesce("text", F.lit(b"")).alias("text"))
    terms = lexicon(rows)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        of, held = Fingerprinter(terms), None
        for batch in slices(parts, "text", 1 << 23):
            texts = batch.column("text").to_pylist()
            own = list(zip(batch.column("part").to_pylist(), batch.column("tail").to_pylist(),
                           batch.column("id").to_pylist(), texts, of(texts), strict=True))
            ordered = own if held is None else [held, *own]
            held = own[-1]
            # A row and the one after it in its part; of the tail only the first row has a use.
            pairs = [(x, y) for x, y in zip(ordered, ordered[1:], strict=False) if x[0] == y[0] and not x[1]]
            if pairs:
                yield compared(pairs, of)

    def compared(pairs: list[tuple], of: Fingerprinter) -> dict:
        edited, sizes = [], []
        for x, y in pairs:
            text = x[3].decode("utf-8", "replace")
            n = len(text)
            # A code point has at most four bytes.
            after = y[3][: 4 * (n // 2)].decode("utf-8", "ignore")[: n // 2]
            edited.append((text[: n - n // 2] + after).encode())
            sizes.append(n)
        prints, changed = np.stack([x[4] for x, _ in pairs]), of(edited)
        return {
            "id": [x[2] for x, _ in pairs],
            "n_chars": sizes,
            "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
            "fingerprint": as_text(prints),
            "edited_fingerprint": as_text(changed),
            "near_edited": likeness(prints, changed),
            "near_next": likeness(prints, np.stack([y[4] for _, y in pairs])),
        }

    schema = (
        "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return map_stream(in_order(rows), schema, run).withColumnRenamed("id", id_col)

