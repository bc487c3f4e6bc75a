import random
import zlib

import numpy as np
import pytest

from tests.conftest import SF_DIR
from threadtide.llm import chunked, idfile, queries
from threadtide.llm.mph import Mph
from threadtide.session import scratch_path


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(chunked.BYTE_BPE)


def whole(rows):
    """Key, start, ids and checksum of rows in their order, each text encoded by itself."""
    out, at = [], 0
    for key, text in rows:
        ids = np.array([*tokenizer_().encode(text or "", add_special_tokens=False).ids, idfile.END_ID], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def tokenizer_(held=[]):  # noqa: B006
    if not held:
        held.append(tokenizer())
    return held[0]


def test_slots_are_a_permutation():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        found = Mph.from_bytes(Mph.build(keys).to_bytes())
        assert found.size == len(keys) and np.array_equal(np.sort(found.slots(keys)), np.arange(len(keys)))
        other = found.slots(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
        assert ((other >= -1) & (other < max(1, len(keys)))).all()
    with pytest.raises(ValueError):
        Mph.build(np.array([7, 7], np.uint64))


def test_stretches_encode_as_whole_texts():
    rng = random.Random(5)
    parts = ["the", " ", "  ", "\n", "\t", " a", "é", "à ", "　", " ", " ", "漢字", "<|endoftext|>", "don't", "12", "!?", "😀", "\x00", "\u0085", "x" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(400)] + ["", " ", "a" * 5000]
    import pyarrow as pa

    for plain in (False, True):
        own = tokenizer()
        own.encode_special_tokens = plain
        coder = chunked.byte_bpe(chunked.definition(), plain)
        for lead in ("", " "):
            cut = chunked.stretches(pa.array(texts), lead)
            ids, firsts = coder.many(cut.distinct)
            for i, text in enumerate(texts):
                got = [v for c in cut.codes[cut.rows[i] : cut.rows[i + 1]] for v in ids[firsts[c] : firsts[c + 1]]]
                assert got == own.encode(lead + text, add_special_tokens=False).ids


def test_every_document_is_read_back(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = whole(sorted((r.doc_id, r.text) for r in rows))
    got = queries.QUERIES["op12_token_ids"](spark, SF_DIR)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(idfile, "TASK_BYTES", 64)
    monkeypatch.setattr(idfile, "READ_DOCS", 3)
    monkeypatch.setattr(idfile, "READ_IDS", 20)
    rng = random.Random(2)
    rows = [(rng.choice([None, 5, -7, 0, 1 << 62, *range(20)]), rng.choice([None, "", "a b", "some words of a text", "<|endoftext|>", "é" * 400])) for _ in range(150)]
    rows += [(5, "same words")] * 60 + [(9, "long " * 20_000)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, key int, shard string, row int")
    path = scratch_path(spark, "odd")
    idfile.write(frame, path, chunked.definition(), shard_bytes=4000, part_keys=7)
    got = sorted(idfile.read(idfile.look(frame, path).unionByName(idfile.unkeyed(spark, path)), path).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got[:-1])]))
    assert sorted(((r.key is not None, r.key or 0), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        ((k is not None, k or 0), n, c) for k, _, n, c in whole(rows)
    )
    held = idfile.Dataset(spark, path)
    assert len(held.get(5)) == sum(k == 5 for k, _ in rows) and held.get(4711) == []
    assert sorted(map(len, held.get(9))) == sorted(n for k, _, n, _ in whole(rows) if k == 9)
    assert all(idfile.ShardReader(f).check() for f in held.shards.values()) and len(held.shards) > 3
    absent = spark.createDataFrame([(4711,), (None,), (5,), (5,)], "doc_id long")
    assert {r.key for r in idfile.look(absent, path).collect()} == {5}


def test_empty_table(spark):
    frame, path = spark.createDataFrame([], "doc_id long, text string"), scratch_path(spark, "none")
    idfile.write(frame, path, chunked.definition())
    assert idfile.read(idfile.look(frame, path).unionByName(idfile.unkeyed(spark, path)), path).count() == 0
    asked = spark.createDataFrame([(1,)], "doc_id long")
    assert idfile.look(asked, path).count() == 0 and idfile.Dataset(spark, path).get(1) == []
