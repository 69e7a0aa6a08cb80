"""SentencePiece encoding and decoding with a streaming Viterbi search.

The vocabulary file's scores are taken as unigram scores: of all ways to cut the text into pieces, the one with the largest
sum is chosen; of equal ones that whose last piece is longest, at every position. Characters without a piece cost a fixed
penalty and become byte pieces.

The search keeps only the last ``max_len`` positions, which is as far as a piece can reach back. Whenever the back pointers
of all positions that may still be extended lead through one boundary, the ids before it are final: they are given out and
the window is cut there. Where no piece of the vocabulary spans two neighbouring characters - before a space, at a line
end - the paths always converge; the text is cut there first, and the ids of the stretches between are remembered.

Defined results: a null text counts as empty, which has no ids and decodes to itself; ids are the same for equal texts. The
text is not normalized, so decoding gives it back exactly, also where it has the sign U+2581 that pieces use for a space: that
becomes byte pieces. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import given_back, ship_package
from riskstream.llm.piecetable import SPACE, code_points, equal_lengths, gather, piece_table

UNKNOWN_PENALTY = 10.0
SLICE_BYTES = 2 << 20  # of texts encoded at once, about
CACHE = 150_000  # stretches remembered by a Python worker, of at most STRETCH characters; half of them the older ones
STRETCH = 40

_CODECS: dict[str, Codec] = {}


class StreamingViterbi:
    """Best segmentation of a stream of characters.

    ``scores`` has the pieces with their scores, and every beginning of a piece that is none itself with None."""

    def __init__(self, scores: dict[str, float | None], max_len: int, unknown: float):
        self.scores, self.max_len, self.unknown = scores, max_len, unknown
        self._reset()

    def _reset(self) -> None:
        self.text, self.at = "", 0  # the window, and up to where its positions have been extended
        self.best, self.back = [0.0], [0]

    def _extend(self, stop: int) -> None:
        """Let every piece that begins before ``stop`` reach its end."""
        text, scores, best, back, size = self.text, self.scores, self.best, self.back, len(self.text)
        best += [None] * (size + 1 - len(best))
        back += [0] * (size + 1 - len(back))
        for begin in range(self.at, stop):
            so_far, single = best[begin], False
            for end in range(begin + 1, size + 1):
                s = scores.get(text[begin:end], False)
                if s is False:
                    break
                if s is not None:
                    single = single or end == begin + 1
                    s += so_far
                    if best[end] is None or s > best[end]:
                        best[end], back[end] = s, begin
            if not single and (best[begin + 1] is None or so_far + self.unknown > best[begin + 1]):
                best[begin + 1], back[begin + 1] = so_far + self.unknown, begin
        self.at = stop

    def feed(self, text: str) -> Iterator[str]:
        """Pieces that the characters so far make final."""
        step = 4 * self.max_len
        for start in range(0, len(text), step):
            self.text += text[start:start + step]
            if len(self.text) - self.max_len > self.at:
                self._extend(len(self.text) - self.max_len)
                yield from self._commit()

    def _path(self, end: int) -> list[int]:
        path = [end]
        while path[-1]:
            path.append(self.back[path[-1]])
        return path

    def _commit(self) -> Iterator[str]:
        """Give out what lies before the last boundary that all reached positions share, and cut the window there."""
        common = set(self._path(self.at))
        for end in range(self.at + 1, len(self.best)):
            if self.best[end] is not None:
                common &= set(self._path(end))
        stop = max(common)
        if stop:
            yield from self._pieces(stop)
            base = self.best[stop]
            self.text, self.at = self.text[stop:], self.at - stop
            self.best = [None if b is None else b - base for b in self.best[stop:]]
            self.back = [max(0, b - stop) for b in self.back[stop:]]

    def _pieces(self, stop: int) -> list[str]:
        path = self._path(stop)[::-1]
        return [self.text[a:z] for a, z in zip(path, path[1:])]

    def finish(self) -> list[str]:
        self._extend(len(self.text))
        out = self._pieces(len(self.text))
        self._reset()
        return out


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        t = self.table = piece_table(path)
        self.ids = dict(zip(t.pieces, t.ids.tolist()))
        self.scores = dict(zip(t.pieces, t.scores.tolist()))
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.reach = dict.fromkeys(p[:i] for p in self.scores for i in range(1, len(p))) | self.scores
        inside = {a + b for p in t.pieces for a, b in zip(p, p[1:])}
        self.cut_lines = not any("\n" in x for x in inside)
        self.cut_words = not any(x[1] == SPACE and x[0] != SPACE for x in inside)
        self.dtype = np.dtype("<u2" if t.vocabulary_size <= 1 << 16 else "<u4")
        self.bytes = [b""] * t.vocabulary_size
        for p, i in self.ids.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in t.byte_ids.items():
            self.bytes[i] = bytes([b])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def search(self, stretch: str) -> bytes:
        """Ids of a stretch of any length."""
        v = StreamingViterbi(self.reach, self.table.max_len, self.unknown)
        out = []
        for p in [*v.feed(stretch), *v.finish()]:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.table.byte_ids[b] for b in p.encode()]
        return np.array(out, self.dtype).tobytes()

    def search_many(self, stretches: list[str]) -> list[bytes]:
        """Ids of short stretches: those of equal length go through the search position by position together."""
        out = [b""] * len(stretches)
        scores = np.append(self.table.scores, -np.inf)
        for at in equal_lengths(stretches, self.table.max_len):
            if len(stretches[at[0]]) == 0:
                continue
            words = [stretches[i] for i in at]
            edges = self.table.edges(code_points(words))
            rows, width = edges[0].shape
            best, back = np.zeros((width + 1, rows)), np.zeros((width + 1, rows), np.int64)
            for end in range(1, width + 1):
                reach = [k for k in range(min(self.table.max_len, end), 0, -1)]  # of equal scores the longest last piece
                sums = np.stack([best[end - k] + scores[edges[k - 1][:, end - k]] for k in reach])
                top = sums.argmax(axis=0)
                best[end], back[end] = sums[top, np.arange(rows)], np.array(reach)[top]
            strange = (edges[0] < 0).any(axis=1)  # a character without a piece
            place, number, pieces = np.full(rows, width), np.arange(rows), np.zeros((rows, width), self.dtype)
            first = np.full(rows, width)
            while len(number):
                k = back[place[number], number]
                place[number] -= k
                first[number] -= 1
                for size in np.unique(k):
                    mine = number[k == size]
                    pieces[mine, first[mine]] = self.table.ids[edges[size - 1][mine, place[mine]]]
                number = number[place[number] > 0]
            for j, i in enumerate(at):
                out[i] = self.search(words[j]) if strange[j] else pieces[j, first[j]:].tobytes()
        return out

    def _learn(self, stretches: list[str]) -> list[bytes]:
        """Ids of distinct stretches, of which the short ones are remembered."""
        known, older = self.known, self.older
        if older:
            known.update((s, older[s]) for s in stretches if s in older)
        short = [s for s in stretches if len(s) <= STRETCH and s not in known]
        known.update(zip(short, self.search_many(short)))
        return [known[s] if s in known else self.search(s) for s in stretches]

    def stretches(self, text: str, inner: bool = False) -> list[str]:
        """``text`` with the space that goes before it (if not ``inner``), cut where no piece crosses."""
        t = (text if inner else " " + text).replace(" ", SPACE)
        if not self.cut_words:
            return [t]
        parts = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", t)
        return [x for p in parts for x in (re.split("(\n)", p) if self.cut_lines else [p]) if x]

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, of any kind."""
        sign = bytes(0).join(np.array([self.table.byte_ids[b]], self.dtype).tobytes() for b in SPACE.encode())
        parts = text.split(SPACE) if text else []  # the sign for a space goes into byte pieces where the text has it
        return np.frombuffer(sign.join(b"".join(self._learn(self.stretches(p, i > 0))) for i, p in enumerate(parts)),
                             self.dtype)

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        if len(self.known) > CACHE // 2:
            self.known, self.older = {}, self.known
        odd = pc.match_substring_regex(texts, f"  |^ |\\x00|{SPACE}|^$")
        if not (self.cut_words and self.cut_lines):
            odd = pc.or_(odd, True)
        cut = pc.binary_join_element_wise(SPACE, pc.replace_substring(pc.replace_substring(
            pc.if_else(odd, "", texts), "\n", "\x00\n\x00"), " ", "\x00" + SPACE), "")
        stretches = pc.split_pattern(cut, "\x00")
        coded = stretches.flatten().dictionary_encode()
        ids, lengths = gather(self._learn(coded.dictionary.to_pylist()), coded.indices.to_numpy(), self.dtype)
        stops = np.concatenate([[0], np.cumsum(lengths)])[stretches.offsets.to_numpy()]
        lengths = np.diff(stops)
        other = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(other):
            own = [ids[a:z].tobytes() for a, z in zip(stops, stops[1:])]
            for i in other:
                own[i] = self.encode(texts[int(i)].as_py()).tobytes()
            ids, lengths = gather(own, np.arange(len(own)), self.dtype)
        return ids, lengths

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()[1:]


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, b.num_rows * SLICE_BYTES // (b.nbytes + 1))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _encoder(vocabulary: str, check: bool = False):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in _slices(batches):
            ids, lengths = c.encode_many(b.column("text"))
            stops = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            if check:
                for a, z, doc_id, text in zip(stops, stops[1:], b.column("doc_id"), b.column("text")):  # one at a time
                    if (c.decode(ids[a:z].tolist()) if z > a else "") != text.as_py():
                        raise ValueError(f"the ids of document {doc_id.as_py()} do not decode to its text")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(stops), pa.array(ids.astype(np.int32)))],
                names=["doc_id", "ids"])

    return encode


def _round_trip(vocabulary: str):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in _slices(batches):
            ids, lengths = c.encode_many(b.column("text"))
            stops = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            words = ids.astype("<u4")
            back = [c.decode(ids[a:z].tolist()) for a, z in zip(stops, stops[1:])]
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n_chars": pa.array(map(len, texts), pa.int64()),
                "n_ids": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(words[a:z].tobytes()) for a, z in zip(stops, stops[1:])], pa.int64()),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                "exact": pa.array([x == t for x, t in zip(back, texts)], pa.bool_())})

    return check


def _texts(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encoded(docs: DataFrame, vocabulary: str, check: bool = False) -> DataFrame:
    """(doc_id, ids) of each document; with ``check`` the ids are decoded too, and the job fails if a text does not come back."""
    return _texts(docs).mapInArrow(given_back(_encoder(vocabulary, check), lambda: codec(vocabulary).forget()), "doc_id long, ids array<int>")


def decoded(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(
                [c.decode(x) if x else "" for x in b.column("ids").to_pylist()], pa.string())})

    ship_package(pieces.sparkSession)
    return pieces.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_chars, n_ids, ids_crc32, decoded_sha256, exact): what encoding and decoding each document gives."""
    return _texts(docs).mapInArrow(_round_trip(vocabulary), "doc_id long, n_chars long, n_ids long, ids_crc32 long, "
                                   "decoded_sha256 string, exact boolean")
