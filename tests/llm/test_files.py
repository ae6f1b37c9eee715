"""Byte-level BPE, token files and WARC archives."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graticule.llm import bpe, range_coder, token_store, warc
from graticule.llm.common import materialise, shared_dir

from .conftest import prose

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coders():
    ranks = bpe.read_ranks(RANKS)
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Decoder(ranks)


def test_bpe_is_that_of_the_library(coders):
    ours, library, decoder = coders
    draw = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "éäß ñ'’ 12\n\t中文字🙂ÃЖд "
    for n in (0, 1, 5, 30, 200):
        for _ in range(300):
            text = "".join(draw.choices(letters, k=n))
            ids = ours.encode(text)
            assert ids.tolist() == library.encode_ordinary(text)
            assert decoder.decode(ids, chunk=3) == text


def test_every_piece_is_answered_by_states(coders):
    machine, library = bpe.Transducer(coders[0].machine.ranks), coders[1]
    pieces = [w.encode() for w in prose(5, 300).split()] + [b"a" * 500, "ß".encode() * 99, b"ab" * 200, b"qzxj", bytes(range(97, 123)) * 4]
    many = [p for p in dict.fromkeys(pieces) if p not in machine.ranks]
    answered, steps = 0, machine.steps
    for piece in many:
        state, path = 0, True
        ids = machine.encode(piece)
        for byte in piece:
            path = path and (state << 8 | byte) in steps
            state = steps[state << 8 | byte][0]
        answered += path
        assert ids == library._core_bpe.encode_single_piece(piece)
    assert answered == len(many) > 20 and len(machine.states) > 10


def test_states_begin_anew_at_their_bound(coders, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    machine = bpe.Transducer(coders[0].machine.ranks)
    for word in prose(6, 300).split():
        assert machine.encode(word.encode()) == coders[1]._core_bpe.encode_single_piece(word.encode())
    assert len(machine.states) < 100


def test_long_texts_are_split_step_by_step(coders, monkeypatch):
    text = prose(8, 3000) + " 中文 " + "x" * 5000
    whole = coders[1].encode_ordinary(text)
    monkeypatch.setattr("graticule.llm.pretokens.PART", 100)
    assert coders[0].encode(text).tolist() == whole


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(1, 5), min_size=1, max_size=30))
def test_utf8_stream_holds_back_incomplete_characters(data, sizes):
    stream, out, at = bpe.Utf8Stream(), "", 0
    for size in sizes:
        out += stream.feed(data[at : at + size])
        at += size
    assert out + stream.feed(data[at:]) + stream.finish() == data.decode("utf-8", "replace")


def test_bpe_on_awkward_rows(awkward, nothing, coders):
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    one, two = bpe.round_trip(awkward, RANKS, public_tokenizers.PATTERN), bpe.decode(bpe.encode(awkward, RANKS, public_tokenizers.PATTERN), RANKS)
    for coded in (one, two):
        rows = bpe.digests(coded).collect()
        assert len(rows) == awkward.count()
        for r in rows:
            ids = coders[1].encode_ordinary(texts[r.doc_id])
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    judged = bpe.verified(awkward, RANKS, public_tokenizers.PATTERN)
    assert judged.columns == [*awkward.columns, "ids", "decodes"] and all(r.decodes for r in judged.collect())
    clash = awkward.withColumnRenamed("node", "ids").withColumnRenamed("score", "decoded")
    assert bpe.round_trip(clash, RANKS, public_tokenizers.PATTERN).columns == clash.columns
    assert bpe.round_trip(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n", [1, 2, 31, 33, 700, 9000])
def test_range_coder_round_trip(n):
    draw = np.random.default_rng(n)
    for ids in (draw.integers(0, 50257, n), np.zeros(n, int), draw.integers(0, 3, n), np.full(n, 50256), np.minimum(draw.geometric(0.01, n), 50256)):
        data = range_coder.encode(ids, 50257)
        assert (range_coder.decode(data, n, 50257) == ids).all()


def test_range_coder_uses_its_contexts():
    draw = np.random.default_rng(0)
    ids = np.tile(draw.integers(0, 50257, 50), 2000)
    assert 8 * len(range_coder.encode(ids, 50257)) < 2 * len(ids)  # 5.6 bits by itself
    follows = draw.integers(0, 300, (300, 4))  # four successors of each id, 8.2 bits by itself and 2 by the one before
    ids = [0]
    for k in draw.integers(0, 4, 100_000).tolist():
        ids.append(int(follows[ids[-1], k]))
    assert 8 * len(range_coder.encode(np.array(ids), 50257)) < 4 * len(ids)


def test_range_coder_gains_on_order_0_by_corpus_ids(spark):
    coder = token_store.Encoder(JSON, public_tokenizers.PATTERN)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids = np.concatenate(coder.encode(texts))[: token_store.BLOCK_IDS]
    shares = np.bincount(ids) / len(ids)
    order0 = -np.sum(shares * np.log2(np.where(shares > 0, shares, 1)))
    data = range_coder.encode(ids, 50257)
    assert (range_coder.decode(data, len(ids), 50257) == ids).all()
    assert 8 * len(data) / len(ids) < 0.85 * order0


def test_blocks_split_documents_and_show_damage():
    docs = [(5, np.arange(10, dtype=np.int32)), (None, np.array([0], np.int32)), (7, np.arange(25, dtype=np.int32))]
    data = b"".join(token_store.blocks(iter(docs), 100, most=8))
    back: list = []
    for doc_id, ids, more in token_store.read_blocks(io.BytesIO(data), 100):
        if back and back[-1][2]:
            back[-1] = (doc_id, back[-1][1] + ids.tolist(), more)
        else:
            back.append((doc_id, ids.tolist(), more))
    assert [(d, i) for d, i, _ in back] == [(d, i.tolist()) for d, i in docs]
    with pytest.raises(ValueError, match="damaged"):
        list(token_store.read_blocks(io.BytesIO(data[:30] + bytes([data[30] ^ 1]) + data[31:]), 100))


def test_texts_split_in_numpy_are_the_librarys():
    coder, draw = token_store.Encoder(JSON, public_tokenizers.PATTERN), random.Random(3)
    coder.split = None  # not asked for texts of code points below 256 without apostrophes
    letters = "abcXYZ\xe9\xdf\xaa\xb2\xbd019 \n\t\r\x85\xa0\x1c\x00.,-#\xd7" + "   \n ea"
    texts = ["", " ", "\n", "", "x", "  x", "x  ", " \n x", "x\n\n", ""] + ["".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(4000)]
    texts += [prose(k, 300) for k in range(20)] + ["a" * 300, ""]
    for at in range(0, len(texts), 97):
        some = texts[at : at + 97]
        for text, ids in zip(some, coder.encode(some), strict=True):
            assert ids.tolist() == coder.library.encode(text, add_special_tokens=False).ids, repr(text)
    assert [x.tolist() for x in coder.encode(["", ""])] == [[], []] and coder.encode([]) == []


def test_token_store_on_awkward_rows(awkward, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    files, n = token_store.store(awkward, JSON, public_tokenizers.PATTERN)
    rows = sorted(token_store.read_summary(files, 50257, n).collect(), key=lambda r: r.start)
    docs = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for r, d in zip(rows, docs, strict=True):
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    back = {r.start: r.ids for r in token_store.read_ids(files, 50257, n).collect()}
    assert all(len(back[r.start]) == r.n_tokens for r in rows)
    files, n = token_store.store(nothing, JSON, public_tokenizers.PATTERN)
    assert n == 0 and token_store.read_summary(files, 50257, n).count() == 0


def test_tokens_of_special_strings_are_the_library_s():
    coder = token_store.Encoder(JSON, public_tokenizers.PATTERN)
    for text in ("a<|endoftext|>b", "", " ", "\n", "  \n  x", "'s 'S it's"):
        assert coder.encode([text])[0].tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_take_whole_texts(tmp_path):
    import json

    spec = json.load(open(JSON))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    for path, pattern, alike in ((JSON, public_tokenizers.PATTERN, True), (JSON, r"\S+|\s+", False), (str(tmp_path / "other.json"), public_tokenizers.PATTERN, False)):
        coder = token_store.Encoder(path, pattern)
        assert coder.alike == alike
        for text in ("word again  and 12 more", "x", ""):
            assert coder.encode([text])[0].tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_warc_round_trip_in_small_chunks():
    pages = [(1, "http://a/%0A\n", b"<p>" + bytes(range(256)) * 90), (-5, None, b""), (None, "u", b"x\r\n\r\ny")]
    data = b"".join(warc.member(i, u, p, warc.digest(p), None, False) for i, u, p in pages) + warc.member(9, "v", b"abc", warc.digest(b"abc"), 1, True)
    for chunk in (1, 7, 1 << 18):
        records = list(warc.read(io.BytesIO(data), chunk))
        assert [warc.page_of(h["WARC-Record-ID"]) for h, _ in records] == [1, -5, None, 9]
        assert [warc.payload_of(h, b) for h, b in records] == [*((len(p), p) for _, _, p in pages), (3, None)]
        assert warc.page_of(records[3][0]["WARC-Refers-To"]) == 1
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read(io.BytesIO(data[:-9])))
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabd"
    with pytest.raises(ValueError, match="digest"):
        warc.payload_of({"WARC-Type": "response", "WARC-Payload-Digest": f"sha1:{warc.digest(b'abc')}"}, block)


def test_warc_on_awkward_pages(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (3, None, None), (4, "x\ny", ""), (5, "v", "é" * 300000), (None, "w", "lone"), (6, "w", "same")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha int")
    archives = materialise(warc.write(warc.plan(pages), shared_dir(spark, "warc")), "warc-files")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.scan(archives, archives.count()).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = {"same": 6, "": 4}
    want = sorted((str(i), len((h or "").encode()), sha(h), "revisit" if last.get(h or "", i) != i else "response", None if last.get(h or "", i) == i else last[h or ""]) for i, _, h in rows)
    assert got == want
    empty = warc.write(warc.plan(pages.where("false")), shared_dir(spark, "warc"))
    assert empty.count() == 0
