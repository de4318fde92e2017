"""Problem 9: statistics of texts, and the share of prose that a hidden Markov model over their lines finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import tidy
from tidemill.llm.containers import SPACES
from tidemill.llm.hmm import STATES, LineModel, fit, shares
from tidemill.llm.linestats import SIZES, CommonWords, describe
from tidemill.plans.events import sql_tidy
from tidemill.plans.registry import Registry
from tidemill.sources.tables import spread, table

REGISTRY = Registry()
#: Labelled texts that the model is fitted on, at most, and lines that one of them may have to be taken.
MAX_LABELLED = 3000
MAX_LINES = 5000


def common_words(words: DataFrame) -> CommonWords:
    """The common words (lang, word) of each language: a table of fixed size."""
    rows = words.select(tidy("lang").alias("lang"), tidy("word").alias("word")).where("lang is not null and word is not null").distinct()
    return CommonWords.of([(r["lang"], r["word"]) for r in rows.collect()])


def statistics(documents: DataFrame, words: CommonWords) -> DataFrame:
    """Per text of (doc_id, text, lang): words, mean_word_length, symbol_share, stopped_share, common_share.

    A word is a run of letters, digits and underscores; symbols are what else isn't white space, as a share of all
    that isn't; stopped_share is that of lines ending in one of . ! ? … 。, blank lines aside; common_share that of
    words which are common in the text's language (in any, if the language has no list). Null, empty and blank
    texts have 0 words and null shares. One row per row of ``documents``; there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = describe(batch["text"], batch["lang"], words).docs
            share = lambda a, b: pa.array(a / np.maximum(b, 1), mask=b == 0)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(s["words"]), share(s["word_chars"], s["words"]), share(s["symbols"], s["visible"]), share(s["stopped"], s["lines"]), share(s["common"], s["words"])],
                ["doc_id", "words", "mean_word_length", "symbol_share", "stopped_share", "common_share"],
            )

    schema = "doc_id bigint, words bigint, mean_word_length double, symbol_share double, stopped_share double, common_share double"
    return documents.select("doc_id", "text", "lang").mapInArrow(run, schema)


def train(documents: DataFrame, labels: DataFrame, words: CommonWords, max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES) -> LineModel | None:
    """The model fitted on at most ``max_labelled`` labelled texts (doc_id, label), those with the least hash of doc_id.

    Texts of more than ``max_lines`` lines aren't fitted on. Labels other than the four kinds, and texts labelled
    twice in different ways, aren't used. Lines are described where they are; the codes of that bounded sample
    come to the driver. None if nothing is labelled.
    """
    known = labels.select("doc_id", tidy("label").alias("label")).where(F.col("label").isin(STATES) & F.col("doc_id").isNotNull())
    one = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other").drop("_other")
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = describe(batch["text"], batch["lang"], words)
            cuts = np.searchsorted(lines.doc, np.arange(batch.num_rows + 1))
            keep = [k for k in range(batch.num_rows) if 0 < cuts[k + 1] - cuts[k] <= max_lines]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(keep, pa.int64())),
                    batch["label"].take(pa.array(keep, pa.int64())),
                    pa.array([lines.chars[cuts[k] : cuts[k + 1]].tobytes() for k in keep], pa.binary()),
                    pa.array([lines.codes[cuts[k] : cuts[k + 1]].tobytes() for k in keep], pa.binary()),
                ],
                ["doc_id", "label", "chars", "codes"],
            )

    # at most max_labelled rows of two short fields
    labelled = documents.select("doc_id", "text", "lang").join(F.broadcast(sample), "doc_id")
    rows = labelled.mapInArrow(run, "doc_id bigint, label string, chars binary, codes binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["codes"]))
    chars = [np.frombuffer(r["chars"], np.int64) for r in rows]
    codes = [np.frombuffer(r["codes"], np.uint8).reshape(-1, len(SIZES)) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [c.size for c in chars])
    labels_of = np.array([STATES.index(r["label"]) for r in rows])
    return fit(doc, np.concatenate(codes), np.concatenate(chars), labels_of[doc], SIZES)


def label_shares(documents: DataFrame, model: LineModel | None, words: CommonWords) -> DataFrame:
    """Per text: the shares of its characters in lines of prose, list, table and junk; null if it has no visible character.

    Without a model (nothing is labelled) all shares are null for any text. One row per row of ``documents``; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = describe(batch["text"], batch["lang"], words)
            found = shares(model, lines.doc, lines.codes, lines.chars, batch.num_rows) if model else np.zeros((batch.num_rows, len(STATES)))
            none = found.sum(axis=1) == 0
            visible = pa.array(lines.docs["visible"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], visible, *[pa.array(found[:, k], mask=none) for k in range(len(STATES))]], ["doc_id", "visible", *STATES])

    return documents.select("doc_id", "text", "lang").mapInArrow(run, "doc_id bigint, visible bigint, " + ", ".join(f"`{s}` double" for s in STATES))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    words = common_words(table(spark, folder, "common_words"))
    return label_shares(documents, train(documents, table(spark, folder, "page_labels"), words), words)


@REGISTRY.add("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with less than half of their characters in prose lines, or without any visible character."""
    return labelled(spark, folder).where("visible = 0 or prose < 0.5").select("doc_id")


@REGISTRY.add("p9_label_shares")
def p9_label_shares(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(spark, folder).select("doc_id", *[F.round(s, 4).alias(f"{s}_share") for s in STATES])


SQL_STATS = rf"""
with d as (
  select doc_id, {sql_tidy("lang")} lang, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') w, length(regexp_replace(text, '[{SPACES}]+', '', 'g')) visible,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[{SPACES}]+$', '')), lambda x: x <> '') lines from documents
), c as (select {sql_tidy("lang")} lang, list(distinct {sql_tidy("word")}) ws from common_words group by 1
), a as (select list(distinct {sql_tidy("word")}) ws from common_words
), s as (
  select doc_id, coalesce(len(w), 0) words, length(array_to_string(w, '')) word_chars, visible, len(lines) lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。]$'))) stopped,
    len(list_filter(w, lambda x: list_contains(coalesce(c.ws, a.ws), lower(x)))) common
  from d left join c using (lang), a
)
select doc_id, words, case when words > 0 then word_chars / words end mean_word_length, case when visible > 0 then (visible - word_chars) / visible end symbol_share,
  case when lines > 0 then stopped / lines end stopped_share, case when words > 0 then common / words end common_share from s"""


@REGISTRY.add("p9_statistics", SQL_STATS)
def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return statistics(spread(table(spark, folder, "documents").select("doc_id", "text", "lang")), common_words(table(spark, folder, "common_words")))
