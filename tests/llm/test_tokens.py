import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import zstandard
from tokenizers import Tokenizer

from furrow.llm import queries as Q
from furrow.llm import tokens
from tests.llm.conftest import AWKWARD, table

ODD = ["a\x1cb c\x85d don't WE'LL x'S <|endoftext|> <|ENDOFTEXT|> é é ß ẞ İx ª º² _a_b 12a3 a1 it's, 'tis ---", "", " ", None, "ÀÉÎ naïve×÷ über", "日本語 текст"]


def ids_of(texts):
    found = Tokenizer.from_file(Q.vocabulary()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in found]


def test_words_encode_as_whole_texts(texts):
    encoder = tokens.WordEncoder(Q.vocabulary())
    sample = [t for _, t in texts] + ODD
    for _ in range(2):  # new words, then remembered ones
        ids, bounds = encoder.encode(pa.array(sample, pa.string()))
        assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:], strict=True)] == ids_of(sample)


def test_query_by_direct_encoding(spark, sf, texts):
    start, want = 0, set()
    for (i, _), ids in zip(texts, ids_of([t for _, t in texts]), strict=True):
        ids = [*ids, 2]
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in Q.op6_tokens(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/tokens"


def test_files_are_plain_zstandard_with_a_seek_table(spark, docs, texts, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "FRAME_IDS", 500)
    manifest = tokens.write_tokens(docs.limit(60), folder, Q.vocabulary(), files=2).orderBy("number").collect()
    assert sorted(p.name for p in (tmp_path / "tokens").glob("*.zst")) == sorted(r["file"] for r in manifest)
    for r in manifest:
        path = tmp_path / "tokens" / r["file"]
        raw = path.read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert len(whole) == 4 * r["ids"] and struct.unpack("<I", raw[-4:])[0] == tokens.SEEK_MAGIC
        file = tokens.TokenFile(pafs.LocalFileSystem(), str(path))
        assert b"".join(file.frame(k).tobytes() for k in range(len(file.frames))) == whole


def test_damage_is_found(spark, docs, folder, tmp_path):
    name = tokens.write_tokens(docs.limit(5), folder, Q.vocabulary(), files=1).first()["file"]
    path = tmp_path / "tokens" / name
    raw = bytearray(path.read_bytes())
    raw[-10 - 4] ^= 1  # the checksum of the last frame
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        list(tokens.TokenFile(pafs.LocalFileSystem(), str(path)).documents())


def test_reader_opens_only_the_frames_asked_for(spark, docs, texts, folder, monkeypatch):
    tokens.write_tokens(docs, folder, Q.vocabulary(), files=3)
    wanted = spark.createDataFrame([(3,), (77,), (150,), (10**9,)], "doc_id long")
    got = {r["doc_id"]: r["ids"] for r in tokens.read_documents(spark, folder, wanted).collect()}
    by_id = dict(texts)
    assert got == {i: [*ids, 2] for i, ids in zip((3, 77, 150), ids_of([by_id[i] for i in (3, 77, 150)]), strict=True)}


def test_one_frame_for_one_document(spark, docs, folder, tmp_path):
    name = tokens.write_tokens(docs, folder, Q.vocabulary(), files=1).first()["file"]
    file = tokens.TokenFile(pafs.LocalFileSystem(), str(tmp_path / "tokens" / name))
    opened = []
    plain = file.frame
    file.frame = lambda k: opened.append(k) or plain(k)
    list(file.documents(np.array([2])))
    assert len(file.frames) > 1 and len(opened) == 1


def test_leftovers_of_lost_attempts_go(spark, docs, folder, tmp_path):
    (tmp_path / "tokens").mkdir()
    (tmp_path / "tokens" / "part-000000-9-lost.zst").write_bytes(b"half a file")
    tokens.write_tokens(docs.limit(3), folder, Q.vocabulary(), files=1)
    assert len(list((tmp_path / "tokens").glob("*.zst"))) == 1


def test_awkward_rows(spark, awkward, nothing, folder):
    tokens.write_tokens(awkward, folder, Q.vocabulary())
    got = tokens.read_tokens(spark, folder).orderBy("start").collect()
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(i, len(ids) + 1) for (i, *_), ids in zip(order, ids_of([t for _, t, *_ in order]), strict=True)]
    tokens.write_tokens(nothing, folder + "-none", Q.vocabulary())
    assert tokens.read_tokens(spark, folder + "-none").count() == 0
    assert tokens.read_documents(spark, folder + "-none", table(spark, [(1, "", "", "")])).count() == 0
