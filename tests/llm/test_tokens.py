"""BPE (operator 10) and packing (operator 4) against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewell.llm import bpe, packing

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    return tool


def test_codec_equals_library_on_odd_texts():
    tool, codec, rng = library(WORD), bpe.codec(WORD), random.Random(3)
    texts = ["", "  ", "ΑΣ ΣΑΣ.", "İI ß ŉ", "don't we'll", "<|endoftext|>a<|startoftext|>", "12 3a4", "é é"]
    texts += ["".join(chr(rng.randrange(1, 0x250)) for _ in range(80)) for _ in range(300)]
    for text in texts:
        ids = tool.encode(text, add_special_tokens=False).ids
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text)
        assert codec.decode(packed) == tool.decode(ids, skip_special_tokens=False)


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.Codec(WORD)
    text = "alpha beta gamma delta alpha beta epsilon"
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library(WORD).encode(text, add_special_tokens=False).ids
    assert len(codec.words) <= 3


def test_digests(awkward):
    tool = library(WORD)
    found = bpe.digests(awkward, WORD).collect()
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    assert len(found) == awkward.count()
    for row in found:
        ids = tool.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        plain = tool.decode(ids, skip_special_tokens=False).encode()
        assert row.decoded_sha256 == hashlib.sha256(plain).hexdigest()


def test_encode_returns_ids_and_text(documents):
    row = bpe.encode(documents([(1, "Hello world")]), WORD).first()
    assert row.decoded == "hello</w> world</w>" and len(row.ids) == 8


@pytest.mark.parametrize("partitions", [1, 3])
def test_packing_is_whole_and_gapless(awkward, partitions):
    tool = library(BYTE)
    rows = awkward.where("doc_id is null or doc_id <> 6").repartition(partitions)
    pieces = packing.digests(packing.pack(rows, BYTE)).collect()
    total = sum(p.length for p in pieces)
    place = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    at = 0
    for sequence, offset, length in place:
        assert (sequence, offset) == divmod(at, 2048) and offset + length <= 2048
        at += length
    assert at == total
    for doc in rows.collect():
        ids = [*tool.encode(doc.text or "", add_special_tokens=False).ids, 1]
        own = sorted((p for p in pieces if p.doc_id == doc.doc_id), key=lambda p: p.start)
        assert {p.doc_tokens for p in own} == {len(ids)}
        at = 0
        for p in own:
            assert p.start == at
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : at], "<u4").tobytes())
        assert at == len(ids)


def test_repeated_rows_are_packed_again(documents):
    pieces = packing.pack(documents([(1, "a b"), (1, "a b")]), BYTE).collect()
    assert sum(p.length for p in pieces) == 6


def test_empty_tables(documents):
    none = documents([]).select("doc_id", "text")
    assert bpe.digests(none, WORD).count() == 0
    assert packing.digests(packing.pack(none, BYTE)).count() == 0


def test_very_long_white_space(documents):
    """Runs of white space on which the fast encoder gives up."""
    texts = {1: "\n" * 1_000_000, 2: "a" + " " * 2_000_000, 3: " \n" * 600_000 + "end", 4: "\t" * 1_000_000 + "<|endoftext|>"}
    tool = library(BYTE)
    pieces = packing.digests(packing.pack(documents(list(texts.items())), BYTE)).collect()
    for doc, text in texts.items():
        ids = [*tool.encode(text, add_special_tokens=False).ids, 1]
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert sum(p.length for p in own) == own[0].doc_tokens == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in own)


def test_ids_beyond_16_bits_stop(documents, tmp_path):
    with pytest.raises(Exception, match="65536|out of bounds"):
        packing.pack(documents([(1, "a")]), BYTE, end_id=65_536).collect()
