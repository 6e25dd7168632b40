"""Strings of added tokens in texts, remembered words, and bases of parts."""

import json

import numpy as np
import pytest

from docgraph.llm import queries, tokenids

TEXTS = [
    "a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>", "x <|startoftext|><|endoftext|> y.", "<|ENDOFTEXT|> is a word", "half <|endof text|> and <|endoftext", "İ<|endoftext|>́e café <|startoftext|>'s",
    "<|endoftext|>" * 3 + " 12,5", "", "plain text, with marks.",
]


def test_added_tokens(spark):
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(queries.tokenizer_path()), tokenids.Encoder(queries.tokenizer_path(), "<u2")
    for text in TEXTS:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_bounded_memory(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenids, "REMEMBERED", 3000)
    whole, encoder = Tokenizer.from_file(queries.tokenizer_path()), tokenids.Encoder(queries.tokenizer_path(), "<u2")
    for k in range(40):
        text = " ".join(f"word{chr(97 + (k + i) % 26)}{i}x" for i in range(10)) + " the the"
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) < 40


@pytest.mark.parametrize("group", [2, 4096])
def test_bases(spark, group, monkeypatch, tmp_path):
    monkeypatch.setattr(tokenids, "GROUP", group)
    written = spark.createDataFrame([(p, 1, 10 + p) for p in (0, 1, 2, 5, 6, 7, 9)], "part long, docs long, tokens long")
    got = {r.part: r.base for r in tokenids._bases(written).collect()}
    at = 0
    for p in sorted(got):
        assert got[p] == at
        at += 10 + p
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    placed = tokenids.write_tokens(docs, str(tmp_path / "t"), queries.tokenizer_path())
    index = json.loads((tmp_path / "t" / "index.json").read_text())
    assert (index["parts"], index["dtype"]) == (placed.count(), "<u2")
