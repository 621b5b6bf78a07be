import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from protolens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def same(library, text):
    ids = bpe.codec(PATH).encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert bpe.codec(PATH).decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    same(LIBRARY, text)


def test_chosen(library):
    spaces = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8203, 8232, 8239, 8287, 12288, 6158, 65279]))
    for text in ["", " ", "  a  b ", "don't I'LL we've", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "日本語 テスト", "🙂🙂 x", "½ ²3 Ⅷ ٣", "a\r\n\r\nb\t\tc  \n", *spaces, " ".join(spaces), "x".join(spaces), "aaaa" * 3000, "ab" * 5000, "é" * 2001, "the" * 1000]:
        same(library, text)


def test_random(library):
    r = random.Random(2)
    for _ in range(300):
        same(library, "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x300), r.randrange(0x3000), r.randrange(0x1F000, 0x1FAFF)])) for _ in range(r.randrange(60))))


def test_documents(spark, odd_docs, odd_rows, no_docs, library):
    out = bpe.decode(bpe.encode(odd_docs, PATH), PATH)
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert list(r["ids"]) == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    assert bpe.encoded_documents(no_docs).count() == 0
    assert bpe.encoded_documents(odd_docs).where("doc_id = 2").first()["n_tokens"] == 0
