from __future__ import annotations

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import tokens
from tidemill.llm.tokens import count_tokens

PATTERN = re.compile(r"\w+|[^\w\s]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(exclude_categories=["Cs"]))), max_size=8))
def test_counts_equal_the_pattern(texts):
    assert count_tokens(pa.array(texts, pa.string())).tolist() == [len(PATTERN.findall(t or "")) for t in texts]


def test_small_chunks_long_texts_and_empty(monkeypatch):
    monkeypatch.setattr(tokens.chunks, "__defaults__", (10,))
    texts = ["a b", None, "", "x" * 100 + " é😀 ...", "   ", "last"]
    assert count_tokens(pa.array(texts)).tolist() == [len(PATTERN.findall(t or "")) for t in texts]
    assert count_tokens(pa.array([], pa.string())).tolist() == []
    assert count_tokens(pa.array(["ab, " * 1_000_000])).tolist() == [2_000_000]
