"""Token counts by a map-side lookup in two tiers.

Tier one is a compact table of frequent pre-tokens and their token counts, broadcast: at most `frequent` entries, found over all
documents.  For that each task keeps a bounded summary of its own pre-tokens and only the heads of the summaries meet.  Tier two is
each task's own memory of bounded size: what tier one doesn't have is encoded once and remembered.  Pre-tokens themselves are never
shuffled, and a count never depends on what either tier holds.

Cases: a null text counts as empty (no tokens); repeated rows are counted each by itself; other columns pass through, those with the
name of an added column are replaced; an empty table gives an empty result.
"""
from __future__ import annotations

from collections import Counter
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from graftline.llm.bpe import PreTokens, Remembered, Vocabulary, default_tokenizer
from graftline.llm.rows import add_from_text, quoted, small_batches, text_slices

#: Entries of the broadcast table, pre-tokens of one task's summary and of the head it passes on, remembered misses of one task.
FREQUENT, SUMMARY, HEAD, REMEMBERED = 32_768, 100_000, 4_096, 300_000


def _heads(df: DataFrame, text_col: str, content: Any) -> DataFrame:
    """(word, n): the most frequent pre-tokens of each task, counted within bounded memory."""

    def run(batches):
        cut, counts = PreTokens(content.value, Vocabulary(content.value)), Counter()
        for batch in batches:
            for _, _, data in text_slices(batch.column(0)):
                for t in data:
                    counts.update(cut(t.decode("utf-8", "replace")))
                if len(counts) > SUMMARY:
                    counts = Counter(dict(counts.most_common(SUMMARY // 2)))
        head = counts.most_common(HEAD)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in head], pa.string()), pa.array([n for _, n in head], pa.int64())], ["word", "n"])

    return small_batches(df).select(quoted(text_col)).mapInArrow(run, "word string, n long")


def frequent_lengths(df: DataFrame, text_col: str, content: Any, frequent: int = FREQUENT) -> tuple[bytes, bytes]:
    """The broadcast table: frequent pre-tokens joined by spaces, and their token counts as 32-bit numbers."""
    top = _heads(df, text_col, content).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(frequent)
    words = [r["word"] for r in top.select("word").collect()]
    vocabulary = Vocabulary(content.value)
    words = [w for w in words if w not in vocabulary.special]
    _, count = vocabulary.encode_words([w.encode() for w in words]) if words else (None, np.empty(0, np.int64))
    return " ".join(words).encode(), count.astype(np.uint32).tobytes()


class Lengths:
    """Token counts of texts, by the broadcast table and one task's memory."""

    def __init__(self, content: str, table: tuple[bytes, bytes]):
        self.vocabulary = Vocabulary(content)
        self.cut = PreTokens(content, self.vocabulary)
        self.words, self.known = table[0].decode().split(" ") if table[0] else [], np.frombuffer(table[1], np.uint32).astype(np.int64)
        self._forget()

    def _forget(self) -> None:
        self.seen = Remembered()
        self.seen.update({w: i for i, w in enumerate(self.words)})
        self.count = self.known

    def __call__(self, data: list[bytes]) -> np.ndarray:
        if len(self.seen) > len(self.words) + REMEMBERED:
            self._forget()
        words, per_text = [], []
        for t in data:
            w = self.cut(t.decode("utf-8", "replace"))
            words.append(np.fromiter(map(self.seen.__getitem__, w), np.int64, len(w)))
            per_text.append(len(w))
        if new := self.seen.new:
            _, count = self.vocabulary.encode_words([w.encode() for w in new])
            count[[i for i, w in enumerate(new) if w in self.vocabulary.special]] = 1
            self.count, self.seen.new = np.r_[self.count, count], []
        upto = np.r_[0, np.cumsum(self.count[np.concatenate(words)])] if words else np.zeros(1, np.int64)
        return np.diff(upto[np.r_[0, np.cumsum(per_text, dtype=np.int64)]])


def count_tokens(df: DataFrame, text_col: str = "text", count_col: str = "n_tokens", tokenizer: str | None = None, frequent: int = FREQUENT,
                 keep_text: bool = True) -> DataFrame:
    """Add the number of tokens of each whole text, special strings in it counting as one token each."""
    spark: SparkSession = df.sparkSession
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    table = spark.sparkContext.broadcast(frequent_lengths(df, text_col, content, frequent))

    def make():
        lengths = Lengths(content.value, table.value)
        return lambda data: [pa.array(lengths(data), pa.int64())]

    return add_from_text(df, text_col, [(count_col, LongType())], make, keep_text)
