"""Byte-pair encoding and decoding of whole texts.

A text is cut into pre-tokens; each task keeps the pre-tokens it has met, with their ids, in a table of bounded size, and encodes the
new ones of a slice together: the symbols of all these words lie in one flat array, and a round finds the lowest-ranked pair of every
word by binary search over the sorted pair keys and merges all its places at once.  No shuffle, nothing on the driver but the
vocabulary file, which is read there by path and broadcast (a file of fixed size).

Cases: a null text counts as empty and gets no ids; null ids decode to null, an empty list to the empty string; repeated rows are
encoded each by itself; other columns pass through, those with the name of an added column are replaced.
"""
from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from graftline.llm.rows import add_from_text, quoted, without

#: Pre-tokens a task remembers before it starts afresh.
REMEMBERED = 300_000
FAR = np.iinfo(np.int64).max


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges as sorted pair keys, symbols of bytes, strings of ids; from the text of a tokenizer file."""

    def __init__(self, content: str):
        d = json.loads(content)
        model = d["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        ids, self.end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in d["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.width = max([*ids.values(), *self.special.values()]) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], np.arange(len(key))[order]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + self.end] for c in letters], np.int64)
        self.strings = np.empty(self.width, object)
        self.strings[:] = ""
        for s, i in [*ids.items(), *self.special.items()]:
            self.strings[i] = s
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def texts(self, ids: np.ndarray, size: list[int | None]) -> list[str | None]:
        """The text of each list of ids, all lists in a row; a list without size is null."""
        known = (ids >= 0) & (ids < self.width)
        strings = self.strings[np.where(known, ids, 0)]
        strings[~known] = ""
        strings = strings.tolist()
        out, at = [], 0
        for n in size:
            out.append(None if n is None else " ".join(s for s in strings[at:at + n] if s))
            at += n or 0
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each."""
        size = np.array([len(w) for w in words], np.int64)
        sym = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(size) - 1
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            pair = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.append(np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.ranks[at], FAR), FAR)
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            over = best == FAR
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, best = (x[~over] for x in (sym, word, rank, best))
                if not len(sym):
                    break
            left = np.flatnonzero(rank == best)
            run = np.r_[True, np.diff(left) != 1]  # the same pair at neighbouring places overlaps: every second one counts
            nth = np.arange(len(left))
            left = left[(nth - np.maximum.accumulate(np.where(run, nth, 0))) % 2 == 0]
            sym[left] = self.merged[rank[left]]
            keep = np.ones(len(sym), bool)
            keep[left + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_sym)[order].astype(np.int32), np.bincount(word, minlength=len(words))


#: Letters and numbers up to U+024F, lower-cased; further characters take the way of the library's own rules.
_NEAR = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]|[^\\t\\n\\x0b\\x0c\\r \\x85\\xa0a-zA-ZªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+")
_BEYOND = re.compile("[^\\x00-\\u024f]")


class PreTokens:
    """Cuts texts into pre-tokens as the tokenizer file states."""

    def __init__(self, content: str, vocabulary: Vocabulary):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        split = json.loads(content)["pre_tokenizer"]["pretokenizers"][0]
        self.library = Tokenizer.from_str(content)
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.special = vocabulary.special
        self.split_special = vocabulary.split_special

    def _by_library(self, text: str) -> list[str]:
        return [w for w, _ in self.split.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return _NEAR.findall(text.lower())
        if _BEYOND.search(text):
            return self._by_library(text)
        near = unicodedata.normalize("NFC", text).lower()
        return self._by_library(text) if _BEYOND.search(near) else _NEAR.findall(near)

    def __call__(self, text: str) -> list[str]:
        if self.split_special is None or not self.split_special.search(text):
            return self._plain(text)
        return [w for part in self.split_special.split(text) for w in ([part] if part in self.special else self._plain(part))]


class Remembered(dict):
    """Number of each pre-token met so far; new ones wait in `new` until they are encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Ids of texts; holds one task's table of pre-tokens."""

    def __init__(self, content: str):
        self.vocabulary = Vocabulary(content)
        self.cut = PreTokens(content, self.vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.seen, self.ids, self.start, self.count = Remembered(), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        new, special = self.seen.new, self.vocabulary.special
        ids, count = self.vocabulary.encode_words([w.encode() for w in new])
        if any(w in special for w in new):
            parts = np.split(ids, np.cumsum(count)[:-1])
            parts = [np.array([special[w]], np.int32) if w in special else p for w, p in zip(new, parts, strict=True)]
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(count) - count]
        self.ids, self.count = np.concatenate([self.ids, ids]), np.r_[self.count, count]
        self.seen.new = []

    def encode(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        if len(self.seen) > REMEMBERED:
            self._forget()
        words, per_text = [], []
        for t in data:
            w = self.cut(t.decode("utf-8", "replace"))
            words.append(np.fromiter(map(self.seen.__getitem__, w), np.int64, len(w)))
            per_text.append(len(w))
        if self.seen.new:
            self._learn()
        word = np.concatenate(words) if words else np.empty(0, np.int64)
        count = self.count[word]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[word] - (ends - count), count) + np.arange(total)]
        upto = np.r_[0, ends][np.cumsum(per_text)]
        return ids, np.diff(np.r_[0, upto])


def _broadcast(spark: SparkSession, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", tokenizer: str | None = None, keep_text: bool = True) -> DataFrame:
    """Add the ids of each whole text, special strings inside texts counting as special tokens, none added, nothing cut off."""
    content = _broadcast(df.sparkSession, tokenizer or default_tokenizer())

    def make():
        encoder = Encoder(content.value)

        def work(data: list[bytes]) -> list[pa.Array]:
            ids, count = encoder.encode(data)
            return [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(ids, pa.int32()))]

        return work

    return add_from_text(df, text_col, [(ids_col, ArrayType(IntegerType()))], make, keep_text)


def decode(df: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """Add the text of each list of ids: the strings of the ids, special ones too, joined by one space, as the file names no decoder.

    Ids that the vocabulary doesn't have are left out, as the library does."""
    content = _broadcast(df.sparkSession, tokenizer or default_tokenizer())
    carried = without(df, [decoded_col])
    schema = StructType([*carried.schema.fields, StructField(decoded_col, StringType())])
    place = carried.columns.index(ids_col)

    def run(batches):
        vocabulary = Vocabulary(content.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                column = part.column(place)
                ids = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                out = vocabulary.texts(ids, pc.list_value_length(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], schema.names)

    return carried.select(*[quoted(c) for c in carried.columns]).mapInArrow(run, schema)


def encode_and_decode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", tokenizer: str | None = None, keep_text: bool = True) -> DataFrame:
    """What `decode(encode(df))` gives, in one pass: a task holds one vocabulary, and the ids don't go through Spark in between."""
    content = _broadcast(df.sparkSession, tokenizer or default_tokenizer())

    def make():
        encoder = Encoder(content.value)

        def work(data: list[bytes]) -> list[pa.Array]:
            ids, count = encoder.encode(data)
            return [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(ids, pa.int32())), pa.array(encoder.vocabulary.texts(ids, count.tolist()), pa.string())]

        return work

    return add_from_text(df, text_col, [(ids_col, ArrayType(IntegerType())), (decoded_col, StringType())], make, keep_text)
