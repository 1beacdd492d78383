"""Best-fit packing of tokenised documents by minimum bin slack.

Bins are filled one after another: each takes the longest piece left, and a subset-sum
dynamic program over the lengths still available, held as the bits of one integer, finds
the fullest rest that goes with it. Only lengths matter for that, so the program works on
the histogram of lengths (at most `capacity` numbers, whatever the size of the corpus) and
repeats a found combination until one of its lengths runs out. There are thus at most
`capacity` combinations. Spark tokenises, counts the lengths, ranks the pieces of each
length and looks up the bin and the place of each rank.

Defined results: a null text is empty and so one piece of one token (the closing id);
rows that repeat an id are packed each on its own.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.frames import map_batches, map_stream, packed, slices
from martloom.session import cut

CAPACITY = 4096
END_ID = 1
# Words and parts of words whose ids a worker remembers before it starts afresh.
REMEMBERED_WORDS = 400_000
# Fixed value: the vocabulary's own split of lower-case text.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Letters of the Latin blocks whose lower case is one letter; with them, printable ASCII
# without angle brackets, which could spell a special token.
LATIN_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e"
LATIN = regex.compile(f"[{LATIN_LETTERS}]+")
PLAIN = regex.compile(f"[!-;=?-~{LATIN_LETTERS}]+")
SIGNS = np.isin(np.arange(256), list(b".,"))
SPACES = np.isin(np.arange(256), list(b" \n"))
BEFORE_SIGN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
# Second bytes of U+00C0 to U+00FF in UTF-8 that are letters.
LATIN_BYTES = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of words between ASCII white space, as little-endian bytes.

    The tokenizer splits at white space before it merges, so a text's ids are those of its
    words one after another, and a word met before need not be merged again. New words that
    the vocabulary's pattern keeps whole go to the tokenizer many at a time, since the last
    id of each is marked as such in the vocabulary; other words in plain characters are
    joined from parts found that way. What remains goes word by word.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.last[i] = piece.endswith("</w>")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        split = [words_of(text) for text in texts]
        self._learn({word for words in split for word in words if word not in self})
        return [b"".join(map(self.__getitem__, words)) for words in split]

    def _learn(self, words: set[bytes]) -> None:
        whole, mixed, rest = [], {}, []
        for word in words:
            if word.isalpha():
                whole.append(word)
                continue
            text = word.decode("utf-8", "replace")
            if LATIN.fullmatch(text):
                whole.append(word)
            elif PLAIN.fullmatch(text):
                mixed[word] = [part.encode() for part in PARTS.findall(text.lower())]
            else:
                rest.append(word)
        whole += {part for parts in mixed.values() for part in parts if part not in self}.difference(whole)
        for start in range(0, len(whole), 1000):
            some = whole[start : start + 1000]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(some):
                data = ids.tobytes()
                self.update(zip(some, [data[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
            else:
                self._each(some)
        self.update((word, b"".join([self[part] for part in parts])) for word, parts in mixed.items())
        for start in range(0, len(rest), 1000):
            self._each(rest[start : start + 1000])

    def _each(self, words: list[bytes]) -> None:
        texts = [word.decode("utf-8", "replace") for word in words]
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        self.update((word, array("I", e.ids).tobytes()) for word, e in zip(words, found, strict=True))


def words_of(text: bytes) -> list[bytes]:
    """A text cut at white space, in ASCII lower case, which the vocabulary brings it to anyway.

    Commas and full stops that end a word are cut off too if each of them follows a letter
    or digit, as they are then no part of a longer run of signs. Texts that may spell a
    special token are only cut at white space.
    """
    if b"<|" in text:
        return text.split()
    text = text.lower()
    data = np.frombuffer(text, dtype=np.uint8)
    at = np.flatnonzero(SIGNS[data[2:-1]]) + 2
    at = at[SPACES[data[at + 1]]]
    before = data[at - 1]
    if (BEFORE_SIGN[before] | LATIN_BYTES[before] & (data[at - 2] == 0xC3)).all() and text[:1] not in b".," and text[1:2] not in b".,":
        text = text.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n")
    return text.split()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def pieces_of(ids: bytes, capacity: int, end_id: int) -> list[bytes]:
    """A document's ids with the closing one, cut into pieces of `capacity` ids."""
    ids += array("I", [end_id]).tobytes()
    return [ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)]


def pieces(rows: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, crc) of a packed table; `ids` too if asked for."""

    def tokenise(parts: Iterable[pa.RecordBatch]) -> Iterable[dict]:
        words = word_ids(vocabulary)
        for batch in slices(parts, "text", 1 << 22):
            out = []
            texts = [text or b"" for text in batch.column("text").to_pylist()]
            for i, ids in zip(batch.column("id").to_pylist(), words.encode(texts), strict=True):
                out += [(i, n, piece) for n, piece in enumerate(pieces_of(ids, capacity, end_id))]
            yield {
                "id": [i for i, _, _ in out],
                "piece": [n for _, n, _ in out],
                "start": [n * capacity for _, n, _ in out],
                "length": [len(piece) // 4 for _, _, piece in out],
                "crc": [zlib.crc32(piece) for _, _, piece in out],
                "ids": [piece if with_ids else None for _, _, piece in out],
            }

    schema = "id bigint, piece int, start bigint, length bigint, crc bigint, ids binary"
    out = map_stream(rows.select("id", "text"), schema, tokenise)
    return out if with_ids else out.drop("ids")


class Slot(NamedTuple):
    """Where ranks `first` onwards of one length go: `each` a bin, from `bin` on, at `offset`."""

    length: int
    first: int
    bin: int
    each: int
    offset: int


def fullest(available: list[tuple[int, int]], room: int) -> list[int]:
    """Lengths with the largest sum up to `room`, of (length, count) pairs, long ones first.

    Bit s of `sums` says that s can be reached; the bits before each step are kept to walk
    back from the best sum. Counts go in by doubling, so a length takes few steps.
    """
    sums, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length, count in available:
        if length > room:
            continue
        left, chunk = min(count, room // length), 1
        while left > 0:
            n = min(chunk, left)
            wider = sums | (sums << (n * length)) & mask
            if wider != sums:
                steps.append((length, n, sums))
                sums = wider
            left, chunk = left - n, chunk * 2
        if sums >> room:
            break
    best, out = sums.bit_length() - 1, []
    for length, n, before in reversed(steps):
        if not before >> best & 1:
            out += [length] * n
            best -= n * length
    return out


def bin_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slot], int]:
    """The slots of all lengths and the number of bins."""
    left = {length: histogram[length] for length in sorted(histogram, reverse=True) if histogram[length] > 0}
    used = dict.fromkeys(left, 0)
    slots, bins = [], 0
    while left:
        longest = next(iter(left))
        rest = [(n, count - (n == longest)) for n, count in left.items()]
        lengths = [longest, *fullest(rest, capacity - longest)]
        each = {n: lengths.count(n) for n in dict.fromkeys(lengths)}
        times = min(left[n] // k for n, k in each.items())
        offset = 0
        for n, k in each.items():
            slots.append(Slot(n, used[n], bins, k, offset))
            offset += n * k
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        bins += times
    return slots, bins


def ranked(parts: DataFrame) -> DataFrame:
    """`parts` with `rank`, from 0 among the pieces of the same length.

    Each length is dealt into hash buckets that are numbered on their own, so a length that
    many pieces have is not one task's work; bucket counts then give the first ranks.
    """
    buckets = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(buckets)))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "crc")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = dealt.withColumn("number", F.row_number().over(inside))
    return (
        numbered.join(firsts, ["length", "bucket"])
        .withColumn("rank", F.col("first") + F.col("number") - 1)
        .drop("bucket", "first", "number")
    )


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """Where each piece of each document goes: (id_col, piece, start, length, ids_crc32, sequence_id, offset)."""
    rows = packed(docs, id_col, text_col)
    parts = cut(pieces(rows, vocabulary or default_vocabulary(), capacity, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    slots, _ = bin_plan(histogram, capacity)
    slots.sort()
    # At most `capacity` combinations, and no more slots than their different lengths.
    length, first, base, each, offset = (np.array(x, dtype=np.int64) for x in zip(*slots, strict=True)) if slots else (
        np.zeros(0, dtype=np.int64),
    ) * 5
    keys = length * (1 << 48) + first

    def place(batch: pa.RecordBatch) -> dict:
        rank, n = (batch.column(c).to_numpy() for c in ("rank", "length"))
        at = np.searchsorted(keys, n * (1 << 48) + rank, "right") - 1
        turn, spot = np.divmod(rank - first[at], each[at])
        own = {c: batch.column(c) for c in ("id", "piece", "start", "length", "crc")}
        return own | {"sequence_id": base[at] + turn, "offset": offset[at] + spot * n}

    schema = "id bigint, piece int, start bigint, length bigint, crc bigint, sequence_id bigint, offset bigint"
    placed = map_batches(ranked(parts), schema, place)
    return placed.withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})


def sequences(
    docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, at most `capacity` ids each.

    Needs different ids; tokenises again rather than keeping every token of the corpus.
    """
    parts = pieces(packed(docs, id_col, text_col), vocabulary or default_vocabulary(), capacity, end_id, True)
    own = placed.select(F.col(id_col).alias("id"), "piece", "sequence_id", "offset")
    members = parts.select("id", "piece", "ids").join(own, ["id", "piece"])
    ordered = members.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("members"))

    def joined(batch: pa.RecordBatch) -> dict:
        filled = [b"".join(m["ids"] for m in own) for own in batch.column("members").to_pylist()]
        return {"sequence_id": batch.column("sequence_id"), "ids": [np.frombuffer(x, "<u4") for x in filled]}

    return map_batches(ordered, "sequence_id bigint, ids array<bigint>", joined)
