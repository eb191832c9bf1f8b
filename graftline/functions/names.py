"""Name keys: the many ways one variety's name is written, folded to one key.

Accent folding is a JVM `translate` over a table worked out from the Unicode decomposition rules, so keys stay inside code
generation.  `name_key_full` is the Arrow-batched variant with the complete rules (every entity, every decomposition)."""
from __future__ import annotations

import html
import html.entities
import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graftline import fixed_values as fx
from graftline.functions.numeric import col


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """(characters, their plain letters, characters that fold to several letters), from the decomposition rules."""
    single, plain, several = [], [], {}
    for cp in list(range(0xA0, 0x2150)) + list(range(0xFB00, 0xFB07)) + list(range(0xFF01, 0xFF5F)):
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and base.isascii() and base.isalnum():
            if len(base) == 1:
                single.append(c)
                plain.append(base)
            elif cp >= 0xFB00 or 0x2100 <= cp < 0x2150:
                several[c] = base
    return "".join(single), "".join(plain), several


def strip_accents(c: Column | str) -> Column:
    """Plain letters for accented ones; loose combining marks are dropped.

    Text that is ASCII already is passed through after one look; the text is bound once, as the element of an array."""
    single, plain, several = _folding()

    def fold(x: Column) -> Column:
        out = x
        for ch, letters in several.items():
            out = F.replace(out, F.lit(ch), F.lit(letters))
        out = F.regexp_replace(F.translate(out, single, plain), r"\p{M}+", "")
        return F.when(x.rlike(r"[^\x00-\x7F]"), out).otherwise(x)

    return F.element_at(F.transform(F.array(col(c)), fold), 1)


_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@cache
def _entities() -> tuple[Column, str]:
    """The standard's named entities for Latin letters and punctuation as a map, and a pattern of those that need no semicolon."""
    names = {k: v for k, v in html.entities.html5.items() if len(v) == 1 and (ord(v) < 0x180 or 0x2010 <= ord(v) <= 0x2044)}
    bare = sorted((k for k in names if not k.endswith(";")), key=len, reverse=True)
    return F.map_from_arrays(F.lit(list(names)), F.lit(list(names.values()))), "^(" + "|".join(bare) + ")"


def _character(number: Column) -> Column:
    """The character of a numeric reference; the standard's replacements for zero, surrogates and the control range."""
    control = "".join(html.unescape(f"&#{i};") for i in range(0x80, 0xA0))
    plain = F.translate(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"), "".join(map(chr, range(0x80, 0xA0))), control)
    silent = number.between(1, 8) | number.between(14, 31) | number.isin(11, 127)
    return F.when(number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd").when(silent, "").otherwise(plain)


def _decoded(entity: Column) -> Column:
    names, bare = _entities()
    body = F.substr(entity, F.lit(2))
    digits = F.regexp_extract(body, "^#(?:[xX]0*([0-9a-fA-F]{0,8})|0*([0-9]{0,18}))(?:;|$)", 0)
    number = F.when(body.rlike("^#[xX]"), F.conv(F.regexp_extract(digits, "[xX]0*([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(digits, "[0-9]+", 0)).try_cast("bigint")
    number = F.when(body.rlike("^#[xX]?0+;?$"), 0).otherwise(number)

    def named(b: Column) -> Column:
        opening = F.regexp_extract(b, bare, 1)
        return F.coalesce(F.try_element_at(names, b), F.concat(F.try_element_at(names, opening), F.substr(b, F.char_length(opening) + 1)), F.concat(F.lit("&"), b))

    return F.when(body.startswith("#"), F.element_at(F.transform(F.array(number), _character), 1)).otherwise(F.element_at(F.transform(F.array(body), named), 1))


def unescape(c: Column | str) -> Column:
    """HTML entities, numeric and named (Latin letters and punctuation), as the standard decodes them.

    Only text with an ampersand is taken apart.  `name_key_full` knows the mathematical and other names as well."""

    def decode(x: Column) -> Column:
        between, found = F.split(x, _ENTITY, -1), F.regexp_extract_all(x, F.lit(_ENTITY), 0)
        return F.when(F.contains(x, F.lit("&")), F.array_join(F.zip_with(between, found, lambda p, e: F.concat(p, F.coalesce(_decoded(e), F.lit("")))), "")).otherwise(x)

    return F.element_at(F.transform(F.array(col(c)), decode), 1)


def _words_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def _key(plain: Column) -> Column:
    s = F.regexp_replace(F.lower(strip_accents(plain)), "['’‘`]", "")
    return _words_only(F.regexp_replace(s, r"\b(st|saint)\.?\s", "st "))


def name_key(c: Column | str) -> Column:
    """Case, accent and punctuation do not matter; apostrophes vanish; 'St.' and 'Saint' are 'st'."""
    return _key(unescape(c))


def loose_key(c: Column | str) -> Column:
    """`name_key` after dropping possessive endings."""
    s = F.regexp_replace(unescape(c), r"([\p{L}\p{N}_])['’]s(?![\p{L}\p{N}_])", "$1")
    return _key(F.regexp_replace(s, r"([\p{L}\p{N}_])s['’](?=\s|$)", "$1s"))


def build_key(c: Column | str) -> Column:
    """The plain key used to link names inside the atlas (no entities, no saint rule)."""
    return _words_only(F.regexp_replace(F.lower(strip_accents(c)), "['’]", ""))


def upper_key(c: Column | str) -> Column:
    """Upper-case key for printed headings."""
    s = F.regexp_replace(strip_accents(c), "[’'`]", "")
    return F.upper(F.trim(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))


def _full(s: str | None) -> str | None:
    if s is None:
        return None
    s = unicodedata.normalize("NFKD", html.unescape(s))
    s = "".join(ch for ch in s if not unicodedata.combining(ch)).lower()
    s = re.sub(r"\b(st|saint)\.?\s", "st ", re.sub("['’‘`]", "", s))
    return " ".join(re.sub("[^a-z0-9]+", " ", s).split())


@F.pandas_udf(StringType())
def name_key_full(names: pd.Series) -> pd.Series:
    """`name_key` with every HTML entity and every Unicode decomposition (Arrow batches; for text outside Latin scripts)."""
    return names.map(_full)


def heading_keys(name: Column | str, aka: Column | str) -> Column:
    """Upper-case keys a book may head an entry with: the name, without a lone S, and without a trailing PIPPIN or the like.

    Keys of one word must have seven letters, so that short words do not match prose."""
    names = F.concat(F.array(col(name)), F.coalesce(col(aka), F.array().cast("array<string>")))

    def variants(n: Column) -> Column:
        k = upper_key(n)
        k2 = F.trim(F.replace(F.regexp_replace(k, r"\bS\b", ""), F.lit("  "), F.lit(" ")))
        k3 = F.regexp_replace(k2, r" (PIPPIN|PEARMAIN|SEEDLING|APPLE)$", "")
        return F.when(F.length(k) >= 5, F.concat(F.array(k), F.filter(F.array(k2, k3), lambda x: F.length(x) >= 5))).otherwise(F.array().cast("array<string>"))

    keys = F.array_distinct(F.flatten(F.transform(names, variants)))
    return F.filter(keys, lambda k: F.contains(k, F.lit(" ")) | (F.length(k) >= 7))


def clean_name(c: Column | str) -> Column:
    """Trade marks dropped, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), "[®™]", ""), r"\s+", " "))


def slug(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(strip_accents(clean_name(c))), "[’'`]", "")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_title(c: Column | str) -> Column:
    """Listing title without '(apple)', the botanical form and a trailing 'apple', except where 'apple' belongs to the name."""
    t = F.regexp_replace(col(c), r"(?i)\s*\((apple|cultivar|apple cultivar|malus)\)$", "")
    t = F.regexp_replace(t, r"^Malus\s+['‘]?(.+?)['’]?$", "$1")
    bare = F.regexp_replace(t, r"(?i)\s+(apple|apples)$", "")
    return F.trim(F.when(t.rlike(r"(?i)^(lady|crab|pine|winter|summer)\b"), t).otherwise(bare))


def parse_accession(c: Column | str) -> Column:
    """Accession name -> struct(base, quals, syns): parenthesised qualifiers, '(syn X)' names and a trailing clone code."""
    name = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    inside = F.transform(F.regexp_extract_all(name, F.lit(r"\(([^()]*)(?:\)|$)"), 1), lambda q: F.trim(q))
    syn = r"(?i)^syn\.?\s+(.+)$"
    syns = F.transform(F.filter(inside, lambda q: q.rlike(syn)), lambda q: F.trim(F.regexp_extract(q, syn, 1)))
    quals = F.filter(inside, lambda q: (q != "") & ~q.rlike(syn))
    base = F.trim(F.substring_index(name, "(", 1))
    code = F.regexp_extract(base, fx.TRAILING_CLONE_CODE, 1)
    return F.struct(F.trim(F.regexp_replace(base, fx.TRAILING_CLONE_CODE, "")).alias("base"),
                    F.when(code != "", F.concat(quals, F.array(code))).otherwise(quals).alias("quals"), syns.alias("syns"))


def accession_id(prefix: Column | str, number: Column | str, suffix: Column | str) -> Column:
    return F.concat_ws(" ", *[F.nullif(col(x), F.lit("")) for x in (prefix, number, suffix)])


def words(c: Column | str) -> Column:
    """Plain words of three letters or more, hyphenated line ends joined."""
    s = F.regexp_replace(F.lower(strip_accents(c)), r"-\s*\n\s*", "")
    return F.filter(F.regexp_extract_all(s, F.lit("([a-z]+)"), 1), lambda w: F.length(w) > 2)
