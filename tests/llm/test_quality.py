from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import linestats
from tidemill.llm.hmm import STATES, fit, posteriors, shares
from tidemill.llm.linestats import SIZES, CommonWords, describe
from tidemill.llm.quality import label_shares, statistics, train

WORDS = CommonWords.of([("en", "the"), ("en", "of"), ("de", "die")])


def brute(text, lang):
    text = text or ""
    words = re.findall(r"\w+", text)
    lines = [x.rstrip() for x in text.split("\n") if x.strip()]
    table = {"en": {"the", "of"}, "de": {"die"}}.get((lang or "").strip().lower(), {"the", "of", "die"})
    return {
        "words": len(words),
        "word_chars": sum(map(len, words)),
        "visible": len(re.sub(r"\s", "", text)),
        "lines": len(lines),
        "stopped": sum(x[-1] in ".!?…。" for x in lines),
        "common": sum(w.lower() in table for w in words),
    }


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(alphabet="aTthe of die.!\n\t |é😀1_,", max_size=60)), st.sampled_from([None, "en", " DE ", "xx"])), max_size=6))
def test_sums_equal_brute_force(rows):
    got = describe(pa.array([t for t, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string()), WORDS)
    for k, (text, lang) in enumerate(rows):
        want = brute(text, lang)
        assert {c: int(got.docs[c][k]) for c in want} == want
        assert (got.doc == k).sum() == want["lines"]


def test_chunks_make_no_difference(monkeypatch):
    texts = pa.array(["one. two\n\nthree", None, "", "a | b\n" * 40, "x " * 500, "end"])
    langs = pa.array(["en"] * 6)
    a = describe(texts, langs, WORDS)
    monkeypatch.setattr(linestats.chunks, "__defaults__", (7,))
    b = describe(texts, langs, WORDS)
    assert (a.doc == b.doc).all() and (a.codes == b.codes).all() and (a.chars == b.chars).all()


def test_repeats_are_seen_and_equal_words_have_equal_codes():
    phrase = "one two three four five six seven eight nine. "
    got = describe(pa.array([phrase * 50, phrase]), pa.array([None, None], pa.string()), WORDS)
    at = list(linestats.BINS).index("repeats")
    assert got.codes[0, at] == len(linestats.BINS["repeats"]) and got.codes[1, at] == 0


def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(0)
    doc = np.array([0, 0, 0, 1])
    codes = np.stack([rng.integers(0, n, 4) for n in SIZES], axis=1).astype(np.uint8)
    model = fit(doc, codes, np.array([9, 4, 1, 16]), np.array([0, 0, 0, 2]), SIZES, rounds=2)
    likely, _ = posteriors(model, doc, model.scores(codes))
    s, k = model.scores(codes), model.first.size
    total = np.zeros((3, k))
    for a in range(k):
        for b in range(k):
            for c in range(k):
                p = np.exp(model.first[a] + s[0, a] + model.moves[a, b] + s[1, b] + model.moves[b, c] + s[2, c] - s[:3].max(axis=1).sum())
                total[0, a] += p
                total[1, b] += p
                total[2, c] += p
    assert np.allclose(likely[:3], total / total.sum(axis=1, keepdims=True))


def test_edge_texts_and_no_labels(spark):
    rows = [(1, None, None, 1), (2, "", "en", 2), (3, " \n\t", "en", 3), (4, "The mill of the town. " * 60_000, "en", 4), (5, "x" * 1_000_000, None, 5), (None, "a", "en", 6), (5, "x", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, visible long")
    got = sorted(((r["doc_id"] or 0), r["words"], r["symbol_share"]) for r in statistics(docs, WORDS).collect())
    assert [g[:2] for g in got] == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 300_000), (5, 1), (5, 1)]
    labels = spark.createDataFrame([], "doc_id long, label string")
    model = train(docs, labels, WORDS)
    assert model is None
    out = {(r["doc_id"], r["visible"]): r["prose"] for r in label_shares(docs, model, WORDS).collect()}
    assert set(out.values()) == {None} and out[(1, 0)] is None
    assert label_shares(docs.limit(0), None, WORDS).collect() == []
    some = spark.createDataFrame([(4, " Prose "), (5, "junk"), (None, "list"), (2, "table"), (4, "prose"), (5, "what")], "doc_id long, label string")
    shown = label_shares(docs, train(docs, some, WORDS), WORDS).collect()
    assert len(shown) == len(rows)


def test_held_out_accuracy():
    """Fitted on half of the labelled texts, the model tells prose from the rest on the other half."""
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["label"] for r in ds.dataset(f"{folder}/page_labels.parquet").to_table().to_pylist()}
    docs = ds.dataset(f"{folder}/documents.parquet").to_table(columns=["doc_id", "text", "lang"], filter=ds.field("doc_id").isin(list(labels)))
    common = CommonWords.of([(r["lang"], r["word"]) for r in ds.dataset(f"{folder}/common_words.parquet").to_table().to_pylist()])
    lines = describe(docs["text"].combine_chunks(), docs["lang"].combine_chunks(), common)
    truth = np.array([STATES.index(labels[d]) for d in docs["doc_id"].to_pylist()])
    taught = np.arange(truth.size) % 2 == 0
    mine = taught[lines.doc]
    model = fit(lines.doc[mine], lines.codes[mine], lines.chars[mine], truth[lines.doc[mine]], SIZES)
    found = shares(model, lines.doc, lines.codes, lines.chars, truth.size)[:, 0] < 0.5
    wrong = (found != (truth != 0))[~taught]
    assert wrong.mean() < 0.06, wrong.mean()


@pytest.mark.parametrize("lang", ["en", None])
def test_case_and_language(lang):
    got = describe(pa.array(["The OF die"]), pa.array([lang], pa.string()), WORDS)
    assert int(got.docs["common"][0]) == (2 if lang else 3)
