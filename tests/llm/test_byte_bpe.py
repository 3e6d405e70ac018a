"""Byte-level BPE against the public library: ids, boundaries, decoding, odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lamina.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "s", "t", "'", " ", "  ", "\n", "\t", "re", "ve", "ll", "'s", "'ll", "'re", "'r", "'l", "1", "23", "é", "ß", "語", "!", "!!", " ", "　", "\r\n", "\x1c", "\0", "😀", "don't", "'S", "½", "́", "\U00013460", "<|endoftext|>", "   ", "'m'd"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_equal_the_library(ranks, library):
    rng = random.Random(2)
    texts = random_texts(1, 4000) + ["", "'", " ", "\n", "  a", "a  ", "'s", "' s", "a'", "a 's", "a" * 5000, "=-" * 3000, " " * 1000 + "x", "e" * 300 + "1" * 400]
    texts += ["".join(rng.choice("abé") for _ in range(2000)) for _ in range(3)]  # one long piece each
    ids, count = ranks.encode([t.encode() for t in texts])
    own = np.split(ids, np.cumsum(count)[:-1])
    assert [x.tolist() for x in own] == [library.encode_ordinary(t) for t in texts]
    for t, x in zip(texts, own, strict=True):
        size = ranks.sizes[x]
        assert ranks.decode(x, np.cumsum(size) - size) == t.encode()


def test_a_stretch_decodes_from_its_offsets(ranks):
    text = "The offsets stay with the ids, so any stretch decodes."
    ids, _ = ranks.encode([text.encode()])
    size = ranks.sizes[ids]
    starts = np.cumsum(size) - size
    assert ranks.decode(ids[3:7], starts[3:7]) == text.encode()[starts[3] : starts[7]]


def test_every_code_point_is_in_the_library_s_class():
    """A code point joins a letter, a digit or a line end in one piece just if the library's pattern has it in that class."""
    kinds = byte_bpe.char_classes()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lead, want in ((b"a", [byte_bpe.LETTER]), (b"1", [byte_bpe.NUMBER]), (b"\n", [byte_bpe.BLANK, byte_bpe.SPACE])):
        joined = {bytes([i]): i for i in range(256)} | {lead + bytes([i]): 256 + i for i in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=joined, special_tokens={})
        got = np.array([probe.encode_ordinary(lead.decode() + chr(c))[0] >= 256 for c in points])
        assert (got == np.isin(kinds[points], want)).all()


def test_states_do_not_depend_on_the_stretch(monkeypatch):
    kinds = np.random.default_rng(3).integers(0, 8, 1000).astype(np.uint8)
    state, want = byte_bpe.FRESH, []
    for k in kinds.tolist():
        want.append(state)
        state = int(byte_bpe.AFTER[k, state])
    for size in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(byte_bpe, "STRETCH", size)
        assert byte_bpe.states_before(kinds).tolist() == want


@pytest.mark.parametrize("most", [1, 5, 100])
def test_parts_of_a_long_text_give_the_same_ids(ranks, library, most):
    for text in random_texts(4, 200):
        parts = byte_bpe.parts_of(text.encode(), most)
        assert b"".join(parts) == text.encode()
        assert [i for p in parts for i in ranks.encode([p])[0].tolist()] == library.encode_ordinary(text)


def test_what_is_remembered_is_bounded(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    for text in random_texts(6, 50):
        assert ranks.encode([text.encode()])[0].tolist() == library.encode_ordinary(text)
        assert len(ranks.known) < 200


def digests(ids, text):
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, library):
    texts = [None, "", "  ", "same", "same", "a b c " * 500_000, "x" * 3000]  # one text of many parts
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 1), (3, "same", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(1)
    want = sorted((str(i), *digests(library.encode_ordinary(t or ""), t or "")) for i, t, _ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in byte_bpe.round_trip(docs, PATH).collect()) == want
    back = byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert byte_bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_bytes_that_are_not_utf8(spark, library):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF2062') AS STRING) AS text")
    (row,) = byte_bpe.round_trip(docs, PATH).collect()
    assert tuple(row)[1:] == digests(library.encode_ordinary("a� b"), "a� b")


def test_query_equals_the_library(spark, library):
    want = sorted((r.doc_id, *digests(library.encode_ordinary(r.text or ""), r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(tuple(r) for r in queries.op12_byte_bpe(spark, SF).collect()) == want
