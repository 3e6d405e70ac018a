"""Token tables: exact round trip against the tokenizer itself; Elias-Fano against plain lists."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamina.llm import token_table
from lamina.llm.token_table import EliasFano
from tests.llm.test_repeats import thue_morse

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 9, 9, 1000], list(range(1000)), sorted(random.Random(1).choices(range(10**9), k=777))])
def test_elias_fano(values):
    back = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.int64)).to_bytes())
    assert back.decode().tolist() == values
    assert [back.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        back.select(len(values))


def brute(rows):
    tk, at, out = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_round_trip(spark, monkeypatch):
    texts = ["", None, "Hello, World. it's 3.14 x. y, z.", "J̌ é ́x     end", "<|endoftext|>. <|ENDOFTEXT|> a<|startoftext|>b", "word " * 5000, "ß İstanbul ΑΣ. \x00 \x1c x", "don't.,, a..b ,,a .5, 5.", "日本語。テスト, ok.", " ".join(chr(c) for c in range(0x41, 0x3000, 7)), "क़ख़ word İİ Kelvin \u212a ǅ ŉ"]
    rows = [(i * 3 % 17, t) for i, t in enumerate(texts)] + [(None, "last"), (4, "twin"), (4, "twin"), (4, "other")]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in token_table.tokens_round_trip(df, PATH).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    assert token_table.tokens_round_trip(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_words_that_a_polynomial_confuses():
    """Two words of 1,024 letters that have one hash by any polynomial modulo 2**64."""
    encoder, tk = token_table.WordEncoder(PATH), Tokenizer.from_file(PATH)
    texts = ["first " + x for x in thue_morse()]
    for _ in range(2):  # new words, then remembered ones
        ids, counts = encoder.encode([t.encode() for t in texts])
        assert ids.tolist() == [i for t in texts for i in tk.encode(t, add_special_tokens=False).ids] and counts[0] == len(tk.encode(texts[0], add_special_tokens=False).ids)


def test_equal_hashes_are_told_apart(monkeypatch):
    """Even if every word had one hash."""
    monkeypatch.setattr(token_table.seqs, "span_hashes", lambda buf, start, end: np.zeros(len(start), np.uint64))
    encoder, tk = token_table.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ("one two three two one", "four one five", "two"):
        assert encoder.encode([text.encode()])[0].tolist() == tk.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_table, "MEMORY", 10_000)
    encoder, tk = token_table.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for i in range(20):
        text = " ".join(f"word{i}x{j}" for j in range(200))
        assert encoder.encode([text.encode()])[0].tolist() == tk.encode(text, add_special_tokens=False).ids
        assert encoder.held() < 40_000


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tk = token_table.WordEncoder(path), Tokenizer.from_file(path)
    assert not encoder.by_words and token_table.WordEncoder(PATH).by_words
    texts = ["Hello  world. ", "", "tab\tand\nline"]
    ids, counts = encoder.encode([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in tk.encode(t, add_special_tokens=False).ids] and len(counts) == 3


def test_some_documents_and_clashing_columns(spark):
    rows = [(i, f"text number {i} " * (i % 5), 1, 2) for i in range(300)] + [(1000, "long " * 400_000, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, block int")
    blocks = token_table.written(token_table.blocks_of(df, PATH, 2), "some")
    tk = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.ids for r in token_table.tokens_of(blocks, [0, 7, 299, 5000]).collect()}
    assert got == {i: [*tk.encode(rows[i][1], add_special_tokens=False).ids, 2] for i in (0, 7, 299)}
    assert {r.doc_id: r.n_tokens for r in token_table.read_tokens(blocks).collect()}[1000] == 400_001
