import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskstream.llm import arrow_tokens as A
from riskstream.llm.common import checkpoint_path
from riskstream.llm.queries import vocabulary

from .conftest import LONG, edge_rows, rows

TEXTS = ["", " ", " a", "a ", "a\n", "\n", "\na b\nc", "a  b", "a \nb", "don't stop 's 've x 　 y", "x\x00y z", "\ta b", "a b\t",
         "a\tb c", "a b \x85", "a, b. c!, d., e's, ..x, é, 日, 本.", "\x0bq r\x0b s,\x0b", "a\xa0 b", "<|endoftext|> x", "a<|endoftext|>b", "a <|endoftext|>\n<|endoftext|> b, c.", "<|endoftext", LONG]


@pytest.fixture(scope="module")
def path():
    return vocabulary("byte_bpe_50k.json")


def whole(path, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    return [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_give_the_librarys_ids(path, monkeypatch):
    for cache in (A.CACHE, 3):
        monkeypatch.setattr(A, "CACHE", cache)
        e = A.Encoder(path)
        for texts in (TEXTS, TEXTS[::-1]):
            ids, lengths = e(pa.array(texts))
            stops = np.concatenate([[0], np.cumsum(lengths)])
            assert [ids[a:z].tolist() for a, z in zip(stops, stops[1:])] == whole(path, texts)


def test_documents_come_back(edges, clashing, nothing, path, monkeypatch):
    monkeypatch.setattr(A, "FILE_ROWS", 2)
    order = sorted(((i, t or "") for i, t, *_ in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start, want = 0, []
    for (i, _), ids in zip(order, whole(path, [t for _, t in order])):
        ids.append(A.END_ID)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    equal = rows(A.tokenized(edges, path)) == sorted(want, key=repr)
    assert equal
    equal = rows(A.tokenized(clashing, path)) == sorted(want, key=repr)
    assert equal
    assert A.tokenized(nothing, path).count() == 0


def test_random_access_without_copies(spark, make, path):
    at = checkpoint_path(spark, "tokens-test")
    A.write_files(make([LONG, "the end"]).coalesce(1), at, path)
    found, total = [], sum(len(x) + 1 for x in whole(path, [LONG, "the end"]))
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).collect():
        buffer = pa.py_buffer(bytes(r.content))
        f = pa.ipc.open_file(pa.BufferReader(buffer))
        n = sum(f.get_batch(i).num_rows for i in range(f.num_record_batches))
        for i in range(n):
            ids, mask = A.sequence(f, i)
            assert len(ids) == len(mask) == A.SEQUENCE
            assert buffer.address <= ids.__array_interface__["data"][0] < buffer.address + buffer.size
            found.append(sum(mask.to_pylist()))
    assert sum(found) == total
