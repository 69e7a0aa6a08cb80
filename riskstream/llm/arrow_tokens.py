"""Token ids as Arrow files of equal-length sequences.

Documents are dealt by ranges of ``doc_id`` and sorted within them; each task encodes its documents, ends each with an end
id, packs the ids into sequences of ``SEQUENCE`` and writes files of at most ``FILE_ROWS`` sequences in the Arrow
file format. A record batch has three columns: ``ids``, a fixed-size list of unsigned integers; ``mask``, a fixed-size
list of booleans, false where the last sequence is padded; and ``ends``, the documents that end in a sequence with the
position after their end id. Every batch but the last has ``BATCH_ROWS`` rows, so sequence ``i`` of a file is at a computed
place of a memory map and is read without copying (``sequence``).

Files are written with Spark's text writer, one row a file, whose line separator is the magic string that closes an Arrow
file; so they go through the cluster's file system and commit protocol. Their order is in the metadata of the schema.

Defined results: a null text is an empty one, which has the end id only; a null ``doc_id`` comes first; rows with equal ids
are ordered by text; an empty table gives no files. Other columns are ignored. Ids are stored in 16 bits if the vocabulary
allows, else in 32.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskstream.llm.common import checkpoint_path, given_back, materialize, partitions, ship_package

END_ID = 0
SEQUENCE = 2048
BATCH_ROWS = 256
FILE_ROWS = 4096
MAGIC = b"ARROW1"
CACHE = 1_000_000  # chunks remembered by a Python worker, of about 200 bytes each, in up to two generations
SLICE_BYTES = 8 << 20  # of texts encoded at once, about
JOINED = 64  # of them encoded as one text

#: Two white-space characters in a row, in the widest sense.
ODD = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]{2}"

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts chunk by chunk with a byte-level BPE file of the tokenizers library.

    Its pre-tokenizer starts a token at every single space between two other characters and makes a single line end a token
    of its own, so what lies between is encoded alone and remembered. Texts with other white space, or with the text of an added token, are encoded whole."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.line = self.lib.encode("\n", add_special_tokens=False).ids
        self.marks = dict(zip(",.", self._encode([",", "."])))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Like ``_encode``, but many in one text: joined by line ends, which stay tokens of their own between chunks that
        neither hold nor end in white space and start with at most a space."""
        if len(self.line) != 1:
            return self._encode(chunks)
        plain, rest, done = [], [], {}
        for c in chunks:
            s = c.strip()
            (plain if s and "\n" not in s and (c == s or c == " " + s) else rest).append(c)
        done.update(zip(rest, self._encode(rest)))
        size, line = self.dtype.itemsize, self.line[0]
        groups = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        for g, e in zip(groups, self.lib.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False)):
            ids, start = e.ids, 0
            data = array(self.code, ids).tobytes()
            for c in g:
                try:
                    stop = ids.index(line, start)
                except ValueError:
                    stop = len(ids)
                done[c] = data[start * size:stop * size]
                start = stop + 1
        return [done[c] for c in chunks]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        odd = pc.or_(pc.match_substring_regex(texts, ODD), pc.match_substring(texts, "\x00"))
        for token in self.added:  # the library looks for these before it cuts a text
            odd = pc.or_(odd, pc.match_substring(texts, token))
        even = pc.if_else(odd, "", texts)
        cut = pc.replace_substring(pc.replace_substring(even, "\n", "\x00\n\x00"), " ", "\x00 ")
        chunks = pc.split_pattern(cut, "\x00")  # a space goes to the chunk after it
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn([c for c in words if c not in self.known])
        own = [self.known[c] for c in words]
        ids, lengths = self._gather(own, coded.indices.to_numpy())
        stops = np.concatenate([[0], np.cumsum(lengths)])[chunks.offsets.to_numpy()]
        lengths = np.diff(stops)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):
            own = [ids[a:z].tobytes() for a, z in zip(stops, stops[1:])]
            for i, x in zip(whole, self._encode([texts[int(i)].as_py() for i in whole])):
                own[i] = x
            ids, lengths = self._gather(own, np.arange(len(own)))
        return ids, lengths

    def _gather(self, parts: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``parts`` in the given order, and how many each has."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[order]
        at = np.repeat(starts[order] - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(parts), self.dtype)[at], lengths

    def _learn(self, new: list[str]) -> None:
        """Put the ids of chunks into ``known``. A last comma or full stop after a letter is a token of its own."""
        known, older = self.known, self.older
        if older:
            known.update((c, older[c]) for c in new if c in older)
            new = [c for c in new if c not in known]
        ended = [c for c in new if c[-1:] in self.marks and "a" <= c[-2:-1].lower() <= "\u024f" and c[-2].isalpha()]
        words = set(new).difference(ended).union([c[:-1] for c in ended]).difference(known)
        if words:
            words = list(words)
            known.update(zip(words, self._encode_chunks(words)))
        for c in ended:
            known[c] = known[c[:-1]] + self.marks[c[-1]]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _schema(dtype: np.dtype, order: tuple[int, int]) -> pa.Schema:
    end = pa.struct([("doc_id", pa.int64()), ("position", pa.int64())])
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE)),
                      ("ends", pa.list_(end))],
                     metadata={"part": str(order[0]), "file": str(order[1])})


def file_bytes(ids: np.ndarray, docs: list, lengths: np.ndarray, order: tuple[int, int]) -> bytes:
    """An Arrow file of ``ids``, the ids of ``docs`` with the ``lengths`` one after the other."""
    rows = -(-len(ids) // SEQUENCE)
    padded = np.zeros(rows * SEQUENCE, ids.dtype)
    padded[:len(ids)] = ids
    mask = np.arange(rows * SEQUENCE) < len(ids)
    stops = np.cumsum(lengths)
    schema = _schema(ids.dtype, order)
    per_row = np.searchsorted(stops, np.arange(rows + 1) * SEQUENCE, side="right")
    ends = pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(docs, pa.int64()), pa.array(stops)], fields=list(schema.field("ends").type.value_type)))
    table = pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(padded), SEQUENCE),
                             pa.FixedSizeListArray.from_arrays(pa.array(mask), SEQUENCE), ends], schema=schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, schema) as w:
        for i in range(0, rows, BATCH_ROWS):
            w.write_batch(table.slice(i, BATCH_ROWS))
    return sink.getvalue().to_pybytes()


def sequence(file: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, pa.Array]:
    """Ids (a view of the file's memory) and mask of sequence ``i``."""
    b = file.get_batch(i // BATCH_ROWS)
    j = i % BATCH_ROWS
    return b.column("ids")[j].values.to_numpy(), b.column("mask")[j].values


def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, file = encoder(path), TaskContext.get().partitionId(), 0
        docs, held, counts, size = [], [], [], 0

        def flush():
            content = file_bytes(np.concatenate(held), docs, np.concatenate(counts), (task, file))
            return pa.RecordBatch.from_pydict({"file": pa.array([content.removesuffix(MAGIC)], pa.binary())})

        for b in batches:
            step = max(1, b.num_rows * SLICE_BYTES // (b.nbytes + 1))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                ids, lengths = enc(part.column("text"))
                stops = np.cumsum(lengths)
                ids, stops = np.insert(ids, stops, END_ID), stops + np.arange(1, len(stops) + 1)
                names = part.column("doc_id").to_pylist()
                first, at = 0, 0
                for j, stop in enumerate(stops.tolist()):
                    if size + stop - at >= FILE_ROWS * SEQUENCE or j + 1 == len(names):
                        docs += names[first:j + 1]
                        held.append(ids[at:stop])
                        counts.append(np.diff(stops[first:j + 1], prepend=at))
                        size += stop - at
                        first, at = j + 1, stop
                    if size >= FILE_ROWS * SEQUENCE:
                        yield flush()
                        file, docs, held, counts, size = file + 1, [], [], [], 0
        if docs:
            yield flush()

    return write


def write_files(docs: DataFrame, path: str, vocabulary: str) -> None:
    spark = docs.sparkSession
    ship_package(spark)
    d = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
         .repartitionByRange(2 * partitions(spark), F.col("doc_id").asc_nulls_first())
         .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    (d.mapInArrow(given_back(_writer(vocabulary)), "file binary")
     .select(F.col("file").cast("string")).write.option("lineSep", MAGIC.decode()).option("maxRecordsPerFile", 1)
     .text(path))


READ = "part long, file long, row long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for content in b["content"]:
            f = pa.ipc.open_file(pa.BufferReader(content))
            meta = f.schema.metadata
            parts = [f.get_batch(i) for i in range(f.num_record_batches)]
            ids = np.concatenate([p.column("ids").flatten().to_numpy() for p in parts])
            mask = np.concatenate([p.column("mask").flatten().to_numpy(zero_copy_only=False) for p in parts])
            ids = ids[mask].astype("<u4")
            ends = [e for p in parts for e in p.column("ends").flatten().to_pylist()]
            stops = [e["position"] for e in ends]
            starts = [0, *stops[:-1]]
            yield pd.DataFrame({
                "part": int(meta[b"part"]), "file": int(meta[b"file"]), "row": np.arange(len(ends)),
                "doc_id": pd.array([e["doc_id"] for e in ends], "Int64"), "local_start": starts,
                "n_tokens": np.array(stops) - np.array(starts),
                "ids_crc32": [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(starts, stops)]})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files below ``path``."""
    ship_package(spark)
    d = materialize(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
                    .mapInPandas(given_back(_reader), READ), "tokens-read")
    per = d.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    base = materialize(per.select(F.col("part").alias("p"), F.col("file").alias("f"),
                                  F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base")), "tokens-base")
    return (d.join(base, (F.col("part") == F.col("p")) & (F.col("file") == F.col("f")))
            .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"))


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode ``docs`` into files in the shared folder and read them back."""
    path = checkpoint_path(docs.sparkSession, "tokens")
    write_files(docs, path, vocabulary)
    return read_documents(docs.sparkSession, path)
