"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

Pieces and scores come from a model file. A text is normalised as these files ask for (a
space in front, spaces as U+2581) and cut where no piece can reach across: before a run of
U+2581 and around line ends. The different words of a batch that are new to the worker are
grouped by length and advance together, one position at a time: hashes of all substrings
that end there are looked up among the sorted hashes of the pieces, and the maximum over
their starts is stored with its back pointer. Characters that are in no piece become their
UTF-8 bytes.

What a path is worth depends on the kind of the model. For `unigram` files it is the sum of
the scores, earlier starts winning ties. For `bpe` files, whose scores are the order of
merges, a piece may follow another only if merging the text of both gives back these two;
a segmentation all of whose neighbours pass that is the one that merging gives, and every
prefix has exactly one, so paths that break the rule are worth nothing and the ids are those
of the merges. Pairs of neighbours are judged once and remembered.

Defined results: null and empty texts have no ids; rows are encoded each on its own. Decoding
gives the text back, but for U+2581 itself, which stands for a space.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from martloom.llm.frames import map_stream, packed, slices

SPACE = "▁"
WORDS = regex.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
REMEMBERED_WORDS = 400_000
REMEMBERED_PAIRS = 1_000_000
# Fixed value: how far below the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
BASE = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a model file, and the ids of words met before as little-endian bytes."""

    def __init__(self, path: str, kind: str = "bpe") -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.merges = kind == "bpe"
        self.text = [model.id_to_piece(i) for i in ids]
        self.byte_ids = {int(self.text[i][1:-1], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.unknown = model.unk_id()
        self.longest = max(len(self.text[i]) for i in plain)
        scores = {i: model.get_score(i) for i in plain}
        self.unknown_score = min(scores.values()) - UNKNOWN_PENALTY
        self.score_of = {self.text[i]: x for i, x in scores.items()}
        if self.merges:
            # A piece that merging its own characters does not make is never met.
            plain = [i for i in plain if self._merged(self.text[i]) == [self.text[i]]]
        hashes = np.array([self._hash(self.text[i]) for i in plain], dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        self.ids = np.array(plain, dtype=np.int64)[order]
        self.scores = np.array([scores[i] for i in plain])[order]
        self.known: dict[str, bytes] = {}
        self.fitting: dict[int, bool] = {}

    @staticmethod
    def _hash(piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * int(BASE) + ord(c) + 1) % (1 << 64)
        return out

    def _merged(self, text: str) -> list[str]:
        """The best pair merged, the first of equals, until no pair is a piece."""
        parts, score_of = list(text), self.score_of
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                score = score_of.get(parts[i] + parts[i + 1], -np.inf)
                if score > best:
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces may stand side by side; -1 is the start of a word or an unknown character."""
        code = left * len(self.text) + right
        different, at = np.unique(code, return_inverse=True)
        out = np.ones(len(different), dtype=bool)
        if len(self.fitting) > REMEMBERED_PAIRS:
            self.fitting.clear()
        for i, c in enumerate(different.tolist()):
            if c < 0:
                continue
            known = self.fitting.get(c)
            if known is None:
                a, b = self.text[c // len(self.text)], self.text[c % len(self.text)]
                known = self.fitting[c] = self._merged(a + b) == [a, b]
            out[i] = known
        return out[at]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        split = [WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        by_length = defaultdict(list)
        for word in {w for words in split for w in words if w not in self.known}:
            by_length[len(word)].append(word)
        for length, words in by_length.items():
            # Words of one length advance together; the bound keeps long words to few at a time.
            step = max(1, (1 << 18) // length)
            for start in range(0, len(words), step):
                self._search(words[start : start + step], length)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def _search(self, words: list[str], length: int) -> None:
        m = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype="<u4").reshape(m, length)
        sums = np.zeros((length + 1, m), dtype=np.uint64)
        for i in range(length):
            sums[i + 1] = sums[i] * BASE + codes[:, i] + np.uint64(1)
        power = np.cumprod(np.full(self.longest, BASE, dtype=np.uint64))
        best = np.full((length + 1, m), -np.inf)
        best[0] = 0
        back = np.zeros((length + 1, m), dtype=np.int32)
        piece = np.full((length + 1, m), -1, dtype=np.int64)
        column = np.arange(m)
        for end in range(1, length + 1):
            start = np.arange(max(0, end - self.longest), end)
            hashes = sums[end] - sums[start] * power[end - start - 1][:, None]
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            found = np.where(hit, self.ids[at], -1)
            # A character that is no piece of its own may stand for itself as unknown.
            alone = ~hit[-1]
            if self.merges:
                own, word = np.nonzero(hit)
                hit[own, word] = self._fit(piece[start[own], word], found[own, word])
                total = np.where(hit, 0.0, -np.inf)
                total[-1, alone] = 0
            else:
                total = best[start] + np.where(hit, self.scores[at], -np.inf)
                total[-1, alone] = best[end - 1, alone] + self.unknown_score
            choice = total.argmax(axis=0)
            best[end], back[end], piece[end] = total[choice, column], start[choice], found[choice, column]
        self._follow(words, codes, back, piece, length)

    def _follow(self, words: list[str], codes: np.ndarray, back: np.ndarray, piece: np.ndarray, length: int) -> None:
        """All words walked back together, then their ids stored."""
        column, end, steps = np.arange(len(words)), np.full(len(words), length), []
        while end.any():
            on = end > 0
            steps.append(np.where(on, piece[end, column], -2))
            # An unknown character is marked by where it stands.
            steps[-1] = np.where(on & (steps[-1] == -1), -2 - end, steps[-1])
            end = np.where(on, back[end, column], 0)
        ids = np.stack(steps[::-1], axis=1)
        if (ids < -2).any():
            for j in np.flatnonzero((ids < -2).any(axis=1)).tolist():
                own = [x for i in ids[j].tolist() if i != -2 for x in ([i] if i >= 0 else self._spelled(words[j][-3 - i]))]
                self.known[words[j]] = np.array(own, dtype="<u4").tobytes()
        whole = np.flatnonzero((ids >= -2).all(axis=1))
        ids = ids[whole]
        data = ids[ids >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum((ids >= 0).sum(axis=1))).tolist()
        self.known.update((words[j], data[a:b]) for j, a, b in zip(whole.tolist(), [0, *ends], ends, strict=False))

    def _spelled(self, char: str) -> list[int]:
        data = char.encode("utf-8", "replace")
        return [self.byte_ids[b] for b in data] if self.byte_ids else [self.unknown]

    def decode(self, ids: Iterable[int]) -> str:
        out = []
        for i in ids:
            byte = self.byte_of.get(i)
            out.append(bytes([byte]) if byte is not None else self.text[i].replace(SPACE, " ").encode())
        text = b"".join(out).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id_col, ids) of every text."""
    path = model or default_model()

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        vocabulary = pieces(path)
        for batch in slices(parts, "text", 1 << 21):
            found = vocabulary.encode([(t or b"").decode("utf-8", "replace") for t in batch.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, found)]) // 4
            flat = np.frombuffer(b"".join(found), dtype="<u4").astype(np.int32)
            yield {"id": batch.column("id"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}

    rows = packed(docs, id_col, text_col).select("id", "text")
    return map_stream(rows, "id bigint, ids array<int>", run).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id_col, text) of every list of ids."""
    path = model or default_model()

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        vocabulary = pieces(path)
        for batch in parts:
            yield {"id": batch.column(0), "text": [vocabulary.decode(x or ()) for x in batch.column(1).to_pylist()]}

    rows = encoded.select(encoded[id_col].cast("bigint").alias("id"), encoded[ids_col].alias("ids"))
    return map_stream(rows, "id bigint, text string", run).withColumnRenamed("id", id_col)


def encode_and_check(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None
) -> DataFrame:
    """(id_col, n_ids, ids_crc32, round_trip): a digest of each encoding and whether it decodes to its text."""
    path = model or default_model()

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        vocabulary = pieces(path)
        # Bytes of every id, so that a text is put together by one join.
        spelled = [
            bytes([vocabulary.byte_of[i]]) if i in vocabulary.byte_of else t.replace(SPACE, " ").encode()
            for i, t in enumerate(vocabulary.text)
        ]
        for batch in slices(parts, "text", 1 << 21):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            found = vocabulary.encode([t.decode("utf-8", "replace") for t in texts])
            yield {
                "id": batch.column("id"),
                "n_ids": [len(ids) // 4 for ids in found],
                "ids_crc32": [zlib.crc32(ids) for ids in found],
                "round_trip": [
                    b"".join(map(spelled.__getitem__, memoryview(ids).cast("I")))[1:] == t for ids, t in zip(found, texts, strict=True)
                ],
            }

    rows = packed(docs, id_col, text_col).select("id", "text")
    schema = "id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean"
    return map_stream(rows, schema, run).withColumnRenamed("id", id_col)
