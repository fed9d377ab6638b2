import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starfold.llm import bpe, codec, packing, shared, token_files

from .helpers import empty, odd, table

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = codec.vocabulary("byte_bpe_50k.json"), codec.vocabulary("word_bpe_49k.json")


def library(path):
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


REF = {p: library(p) for p in (BYTE, WORD)}
ODD = ["", "a" * 1000, "don't I'll 'S  x  \n\n y\t\tz   q　w\x1c\x1d e", "<|endoftext|>a <|endoftext|> b", "ΑΣ ΣΑΣ İ ß ﬁ é é 🙂👍🏽 漢字かな 한국 ١٢٣ ½²", "\x00\x01 \x85x y​z", "ab" * 500 + " xyz" * 3, "  lead", "trail  ", "\r\n\r\n a\r\n", "_x_ __ a1b2", "<|startoftext|>Hi<|endoftext|>", "x.\ny, z", "a  b \nc"]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("own", [True, False])
def test_ids_match_the_library(path, own):
    model = bpe.Bpe(path, own)
    assert [x.tolist() for x in model.encode_many(ODD)] == [e.ids for e in REF[path].encode_batch(ODD, add_special_tokens=False)]
    assert model.encode_many([None, ""])[0].size == 0


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    for path in (BYTE, WORD):
        want = REF[path].encode(text, add_special_tokens=False).ids
        assert bpe.load(path).encode(text).tolist() == bpe.load(path, False).encode(text).tolist() == want
    assert bpe.load(BYTE).decode(bpe.load(BYTE).encode(text)) == REF[BYTE].decode(REF[BYTE].encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_long_and_short_words_merge_alike(monkeypatch):
    model = bpe.Bpe(BYTE)
    words = ["internationalization", "aaaaaaaaaaaaaaaaaaaa", "xyzzy", "a", "ЖЖЖЖ", "unbelievably"]
    want = [model.merge_word(w.encode()) for w in words]
    assert [np.frombuffer(b, model.dtype).tolist() for b in model.merge_words([w.encode() for w in words])] == want
    monkeypatch.setattr(bpe, "LONG", 0)
    assert [model.merge_word(w.encode()) for w in words] == want


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "RECENT", 20)
    model = bpe.Bpe(BYTE)
    texts = [" ".join(f"w{i * j % 997}x" for j in range(60)) for i in range(600)]
    assert [x.tolist() for x in model.encode_many(texts)] == [e.ids for e in REF[BYTE].encode_batch(texts, add_special_tokens=False)]


def test_round_trip_of_odd_rows(spark):
    docs = odd(spark)
    got = codec.round_trip(docs, BYTE).collect()
    assert len(got) == docs.count()
    want = sorted((r["doc_id"] or 0, hashlib.sha256(",".join(map(str, REF[BYTE].encode(r["text"] or "", add_special_tokens=False).ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((r["doc_id"] or 0, r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    back = codec.decode(codec.encode(docs, BYTE), BYTE).collect()
    assert all(r["decoded"] == r["text"] for r in back)
    assert codec.round_trip(empty(spark), BYTE).count() == 0


def test_packing(spark):
    docs = odd(spark)
    rows = packing.pack(docs, WORD, with_ids=True).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 and r["length"] == 1 << r["bucket"] <= 2048 for r in rows)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        if r["doc_id"] in (1, 6, 8, 4):
            by.setdefault(r["doc_id"], []).extend(r["ids"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(ids == [*REF[WORD].encode(texts[d], add_special_tokens=False).ids, 1] for d, ids in by.items())
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert packing.pack(empty(spark), WORD).count() == 0
    assert packing.cuts(4096 + 7, 2048) == [(0, 2048), (2048, 2048), (4096, 4), (4100, 2), (4102, 1)] and packing.cuts(0, 8) == []
    with pytest.raises(ValueError):
        packing.pack(docs, WORD, 100)


def test_token_files(spark):
    docs = odd(spark)
    folder = shared.new_folder(spark, "test")
    shards = token_files.write_shards(docs, BYTE, folder)
    got = sorted(token_files.read_shards(shards).collect(), key=lambda r: r["start"])
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at = 0
    for r, d in zip(got, rows, strict=True):
        ids = [*REF[BYTE].encode(d["text"] or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_shards(token_files.write_shards(empty(spark), BYTE, shared.new_folder(spark, "test"))).count() == 0
    only = table(spark, [(3, "x"), (1, "y y")])
    assert [r["start"] for r in sorted(token_files.read_shards(token_files.write_shards(only, BYTE, shared.new_folder(spark, "test"), end_id=None)).collect(), key=lambda r: r["doc_id"])] == [0, 2]


def test_queries_over_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd(spark).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ids = {t: REF[BYTE].encode(t, add_special_tokens=False).ids for _, t in rows}
    own = {t: REF[WORD].encode(t, add_special_tokens=False).ids for _, t in rows}
    got = codec.op3_bpe(spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(REF[BYTE].decode(ids[t], skip_special_tokens=False))) for i, t in rows]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    at, want = 0, []
    for i, t in rows:
        raw = np.array([*ids[t], 0], "<u4")
        want.append((i, at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    assert sorted([tuple(r) for r in token_files.op10_token_files(spark, str(tmp_path)).collect()], key=lambda r: r[1]) == want
    pieces = packing.op8_packing(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        raw = np.array([*own[t], 1], "<u4")
        want += [(i, a, n, zlib.crc32(raw[a : a + n].tobytes()), len(raw), 0, n.bit_length() - 1) for a, n in packing.cuts(len(raw), 2048)]
    assert sorted([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["offset"], r["bucket"]) for r in pieces], key=str) == sorted(want, key=str)
    assert len({r["sequence_id"] for r in pieces}) == len(pieces)


def test_far_files_and_their_names(tmp_path):
    from pyarrow import fs

    np.arange(100, dtype="<u2").tofile(tmp_path / "x.ids")
    far = token_files.Far(fs.LocalFileSystem(), str(tmp_path / "x.ids"), "<u2")
    assert far[10:20].tolist() == list(range(10, 20)) and far[95:200].tolist() == list(range(95, 100)) and far.size == 100
    assert token_files._store(f"file:{tmp_path}/x")[1] == token_files._store(f"file://{tmp_path}/x")[1] == token_files._store(f"{tmp_path}/x")[1] == f"{tmp_path}/x"
    assert token_files.arrow_name("s3a://bucket/some/key") == "s3://bucket/some/key" and token_files.arrow_name("hdfs://host:9000/a") == "hdfs://host:9000/a"


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_plain_words_meet_no_pattern(path):
    """Letters of any script, with one stop after them or none, are cut without the pattern, and their ids are the library's."""
    model = bpe.Bpe(path, False)
    model.split = None
    texts = ["Été déjà, où! là été; Straße", "Привет, мир. Ещё? 漢字 かな: ǅ ﬁ", "Foo foo foo. FOO, fOO!"]
    assert [x.tolist() for x in model.encode_many(texts)] == [e.ids for e in REF[path].encode_batch(texts, add_special_tokens=False)]
