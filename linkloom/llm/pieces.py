"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbols wait on an agenda ordered by the score of the piece they make;
the best pair, the leftmost of equals, is merged until none is left. A merge never
crosses two characters that no piece has side by side, so a text is encoded in
chunks cut before a space sign and around line ends, and each distinct chunk is
merged once per worker as long as a bounded cache remembers it. Chunks new in an
Arrow batch are checked against the sentencepiece library; a text with a chunk
on which the two differ is encoded by the library.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import as_texts, column_of, pick

SPACE = "▁"
#: Chunks that each of the two generations of the cache holds.
CACHE = 600_000
#: Longest chunk whose pairs are kept in the common table of a batch; longer ones have a heap of their own.
SHORT = 24
#: Texts that are encoded and decoded together.
_TOGETHER = 256


#: Stands for the ids of a chunk on which the library differs.
_DIFFERS = (-1,)


@contextmanager
def _no_collector() -> Iterator[None]:
    """No cycle search meanwhile: nothing here makes cycles, and the cache holds many small tuples."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Pieces:
    """A merge-type vocabulary with its cache of encoded chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(self.library.get_piece_size())
        special = (self.library.is_control, self.library.is_unknown, self.library.is_byte, self.library.is_unused)
        self._known = {self.library.id_to_piece(k): (self.library.get_score(k), k) for k in size if not any(f(k) for f in special)}
        self._bytes = {int(self.library.id_to_piece(k)[3:5], 16): k for k in size if self.library.is_byte(k)}
        self._unknown, self.end = self.library.unk_id(), self.library.eos_id()
        # each pattern cuts between characters by these two alone, so it is safe if it cuts no piece
        letter = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u1fff\u2c00-\U0010ffff"
        words = rf"{SPACE}*[{letter}]+|{SPACE}*[^{letter}{SPACE}\n]+|{SPACE}+|\n"
        spaces = rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n"
        safe = (x for x in (words, spaces) if all(len(re.findall(x, piece)) == 1 for piece in self._known))
        self._chunks = re.compile(next(safe, ".+"), re.DOTALL)
        self._names = [str(k) for k in size]
        self._tables()
        self._young: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}
        #: Chunks, and texts, that the library had to encode.
        self.differing = self.by_library = 0

    def _tables(self) -> None:
        """Numbers of single characters, and of the piece that two adjacent pieces make."""
        self._char = np.full(0x110000, -1, np.int32)
        pairs = {}
        for piece, (_, k) in self._known.items():
            if len(piece) == 1:
                self._char[ord(piece)] = k
            for at in range(1, len(piece)):
                left, right = self._known.get(piece[:at]), self._known.get(piece[at:])
                if left and right:
                    pairs[left[1] << 32 | right[1]] = k
        # pieces in the order of their scores; a common table needs it to be one order
        order = sorted((score, k) for piece, (score, k) in self._known.items() if piece.strip(SPACE))
        self._short = SHORT if len({score for score, _ in order}) == len(order) else 0
        self._by_rank = np.array([k for _, k in order], np.int32)
        rank = {k: r for r, (_, k) in enumerate(order)}
        self._pair_keys = np.array(sorted(pairs), np.int64)
        self._pair_rank = np.array([rank.get(pairs[key], -1) for key in sorted(pairs)], np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two adjacent ones make, -1 where there is none."""
        if not len(self._pair_keys):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._pair_keys, key), len(self._pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self._pair_keys[at] == key), self._pair_rank[at], np.int32(-1))

    def merge_together(self, symbols: np.ndarray) -> list[list[int]]:
        """Ids of many short chunks, one in each row of character numbers with -1 after its end.

        All rows share one agenda: the ranks of their adjacent pairs. In a step every
        row merges its best pair, the leftmost of equals.
        """
        rows, width = symbols.shape
        done: list[list[int]] = [[]] * rows
        row = np.arange(rows)
        agenda = np.full((rows, width), -1, np.int32)
        for at in range(width - 1):
            agenda[:, at] = self._ranks(symbols[:, at], symbols[:, at + 1])
        place = np.arange(width)
        while len(row):
            best = agenda.argmax(axis=1)
            top = agenda[np.arange(len(row)), best]
            ended = np.flatnonzero(top < 0)
            if len(ended):
                lengths = (symbols[ended] >= 0).sum(axis=1).tolist()
                for k, ids, n in zip(row[ended].tolist(), symbols[ended].tolist(), lengths, strict=True):
                    done[k] = ids[:n]
                going = top >= 0
                row, best, top, symbols, agenda = row[going], best[going], top[going], symbols[going], agenda[going]
            here = np.arange(len(row))
            symbols[here, best] = self._by_rank[top]
            source = np.minimum(place + (place > best[:, None]), width - 1)
            symbols, agenda = np.take_along_axis(symbols, source, axis=1), np.take_along_axis(agenda, source, axis=1)
            symbols[:, -1], agenda[:, -1] = -1, -1
            before = np.flatnonzero(best > 0)
            for k, at in ((here, best), (before, best[before] - 1)):
                agenda[k, at] = self._ranks(symbols[k, at], symbols[k, np.minimum(at + 1, width - 1)])
        return done

    def _merge_all(self, chunks: list[str]) -> list[list[int]]:
        """Ids of every chunk; long ones, and those with unknown characters or several spaces, have a heap of their own."""
        codes = self._char[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        lengths = np.array([len(c) for c in chunks])
        starts = np.cumsum(lengths) - lengths
        if not chunks:
            return []
        spaced = np.array([c.startswith(SPACE * 2) for c in chunks])
        odd = np.logical_or.reduceat(codes < 0, starts) | (lengths > self._short) | spaced
        out: list[list[int]] = [[]] * len(chunks)
        for k in np.flatnonzero(odd):
            out[k] = self.merge(chunks[k])
        for low in range(0, SHORT, 6):
            some = np.flatnonzero(~odd & (lengths > low) & (lengths <= low + 6))
            if len(some):
                at = starts[some][:, None] + np.arange(low + 6)
                inside = np.arange(low + 6) < lengths[some][:, None]
                symbols = np.where(inside, codes[np.minimum(at, len(codes) - 1)], np.int32(-1))
                for k, ids in zip(some, self.merge_together(symbols), strict=True):
                    out[k] = ids
        return out

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk, its spaces already space signs, by the agenda of adjacent pairs."""
        known = self._known
        symbols: list[str | None] = list(chunk)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            piece = symbols[a] + symbols[b]
            if found := known.get(piece):
                heapq.heappush(agenda, (-found[0], a, b, piece))

        for at in range(len(symbols) - 1):
            offer(at, at + 1)
        while agenda:
            _, a, b, piece = heapq.heappop(agenda)
            if symbols[a] is None or symbols[b] is None or after[a] != b or symbols[a] + symbols[b] != piece:
                continue
            symbols[a], symbols[b], after[a] = piece, None, after[b]
            if after[b] < len(symbols):
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        ids: list[int] = []
        for symbol in symbols:
            if symbol in known:
                ids.append(known[symbol][1])
            elif symbol is not None:
                ids += [self._bytes[x] for x in symbol.encode()] if self._bytes else [self._unknown]
        return ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, without an end id."""
        with _no_collector():
            return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        split = [self._chunks.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        young, old = self._young, self._old
        fresh = [c for c in set(chain.from_iterable(split)) if c not in young]
        young.update((c, old[c]) for c in fresh if c in old)
        self._learn([c for c in fresh if c not in old])
        out = []
        for text, chunks in zip(texts, split, strict=True):
            ids = list(map(young.__getitem__, chunks))
            if self.differing and _DIFFERS in ids:
                self.by_library += 1
                out.append(self.library.encode(text))
            else:
                out.append(list(chain.from_iterable(ids)))
        if len(young) > CACHE:
            self._young, self._old = {}, young
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Merge new chunks and compare each with the library's ids for it."""
        # a chunk without a leading space sign is shown to the library behind a line end
        led = [c[0] == SPACE and len(c) > 1 for c in chunks]
        shown = [(c[1:] if own else "\n" + c).replace(SPACE, " ") for c, own in zip(chunks, led, strict=True)]
        lead = len(self.library.encode("\n"))
        theirs = self.library.encode(shown, num_threads=1) if shown else []
        for chunk, own, a, b in zip(chunks, led, self._merge_all(chunks), theirs, strict=True):
            same = a == (b if own else b[lead:])
            self.differing += not same
            self._young[chunk] = tuple(a) if same else _DIFFERS

    def named(self, ids: list[int]) -> str:
        """Ids as decimal numbers with a space between."""
        return " ".join(map(self._names.__getitem__, ids))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One vocabulary per worker process."""
    return Pieces(path)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _encoder(path: str, end: bool) -> Callable:
    def run(batches):
        vocabulary = pieces(path)
        tail = [vocabulary.end] if end else []
        for batch in batches:
            for at in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(at, _TOGETHER)
                ids = [x + tail for x in vocabulary.encode(as_texts(column_of(part, "text")))]
                yield pa.record_batch({"doc_id": column_of(part, "doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return run


def _decoder(path: str) -> Callable:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(at, _TOGETHER)
                texts = pieces(path).decode([x or [] for x in column_of(part, "ids").to_pylist()])
                yield pa.record_batch({"doc_id": column_of(part, "doc_id"), "text": pa.array(texts, pa.string())})

    return run


def _round_trip(path: str) -> Callable:
    def run(batches):
        vocabulary = pieces(path)
        tail = [vocabulary.end]
        for batch in batches:
            for at in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(at, _TOGETHER)
                ids = [x + tail for x in vocabulary.encode(as_texts(column_of(part, "text")))]
                yield pa.record_batch(
                    {
                        "doc_id": column_of(part, "doc_id"),
                        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                        "ids_sha256": pa.array([_sha(vocabulary.named(x)) for x in ids], pa.string()),
                        "decoded_sha256": pa.array([_sha(x) for x in vocabulary.decode(ids)], pa.string()),
                    }
                )

    return run


def encode(docs: DataFrame, path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row. A null text is an empty one: no ids but the end id. Other columns are not read."""
    return _rows(docs, id_col, text_col).mapInArrow(_encoder(path, end), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids); null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids, end id included, and of what they decode to.

    The same encoding and decoding as above in one pass, so that no ids leave the workers.
    """
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _rows(docs, id_col, text_col).mapInArrow(_round_trip(path), kinds)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
