"""What a screenshot's file name says: the image it shows, whatever happened to the spelling.

A name is reduced to a `gate` (the parts that are never mistyped: ticket, capture time, hash or
pool number; form factor; shot number; competitor mark) and `words` (application, screen or pool
name, orientation, kind), whose typing errors are undone with a lexicon learnt from all names.
Two real names show the same image when gate and words agree.

Null, blank and mark-only names show no image (all fields null).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# The form factors, orientations and kinds that file names carry.
FORM_FACTORS = ("unfold", "fold", "laptop", "tent", "desktop")
ORIENTATIONS = ("portrait", "landscape")
KINDS = ("screenshot", "photo")
COMPETITOR = "competitor"

_CLOSED = (*FORM_FACTORS, *ORIENTATIONS, *KINDS, COMPETITOR)
_EXTENSION = r"\.(?:png|jpe?g|webp|bmp)"
_TAIL = re.compile(rf"(?:{_EXTENSION}|\s*\(\d+\)|[\s_.-]+cop(?:y|ia|ie))+\s*$")
_HEAD = re.compile(r"^(?:copy of|copia de)[\s_-]+")
_ANNOTATED = re.compile(r"(?<![a-z0-9])bound[^a-z0-9]*box(?:es)?(?![a-z0-9])")
_TICKET = re.compile(r"(?<![a-z])iksww[^a-z0-9]*(\d+)")
_TIME = re.compile(r"(?<!\d)((?:19|20)\d\d)\D?(\d\d)\D?(\d\d)(?:[^0-9a-z]*(?:at)?[^0-9a-z]*)(\d\d)\D?(\d\d)\D?(\d\d)(?!\d)")
_HASH = re.compile(r"(?<![a-z0-9])([0-9a-f]{8})(?![a-z0-9])")
_SYNTHETIC = re.compile(r"^(.*)__[^/]*?__v\d+$", re.S)
_WORD = re.compile(r"[a-z]+")

PARSED = T.StructType([T.StructField(c, T.StringType()) for c in ("gate", "words", "raw")])


#: Letters of the longest word that a lexicon holds.
LONGEST = 32


def fold_name(name: str) -> str:
    """Lower case, without URL escapes, accents, extensions, copy marks and annotation marks."""
    if "%" in name:
        name = unquote(name)
    name = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower().strip()
    name = _HEAD.sub("", _TAIL.sub("", name))
    return _TAIL.sub("", _ANNOTATED.sub(" ", name)).strip()


def base_name(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]


def parent_stem(name: str) -> str | None:
    """Stem of the parent that a synthetic file is named after; None for numbered files."""
    found = _SYNTHETIC.match(re.sub(rf"(?:{_EXTENSION})+$", "", name, flags=re.I))
    return found[1] if found and found[1] else None


@lru_cache(maxsize=1 << 16)
def one_typing_error(a: str, b: str) -> bool:
    """True if `b` comes from `a` by one dropped, added, changed or exchanged letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


#: Words that a lexicon may hold: it comes to the driver and goes to every task.
MOST_WORDS = 1_000_000
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def misspellings(word: str) -> set[str]:
    """What one dropped, exchanged, changed or added letter makes of a word."""
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {
        *(a + b[1:] for a, b in cut if b), *(a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1),
        *(a + c + b[1:] for a, b in cut if b for c in _LETTERS), *(a + c + b for a, b in cut for c in _LETTERS),
    } - {word}


class Lexicon:
    """Undoes single typing errors: a rare word becomes the far more frequent word next to it."""

    RATIO = 8

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.known: dict[str, str] = {}

    def correct(self, word: str) -> str:
        if word in _CLOSED:
            return word
        if word not in self.known:
            self.known[word] = self._correct(word)
        return self.known[word]

    def _correct(self, word: str) -> str:
        if not 4 <= len(word) <= LONGEST + 1:
            return word
        own = self.counts.get(word, 0)
        for fixed in _CLOSED:
            if one_typing_error(word, fixed) and own * self.RATIO <= self.counts.get(fixed, 0) + self.RATIO:
                return fixed
        near = [w for w in misspellings(word) if self.counts.get(w, 0) >= max(2, own * self.RATIO)]
        return min(near, key=lambda w: (-self.counts[w], w), default=word)


def parse(name: str | None, lexicon: Lexicon) -> tuple[str | None, str | None, str | None]:
    """(gate, words, raw): what is never mistyped, the corrected words, the words as typed."""
    text = fold_name(base_name(name)) if name else ""
    if not re.search(r"[a-z0-9]", text):
        return None, None, None
    kind, number = "", ""
    if found := _TICKET.search(text):
        kind, number = "ticket", found[1]
    elif found := _TIME.search(text):
        kind, number = "time", "".join(found.groups())
    elif found := _HASH.search(text):
        kind, number = "hash", found[1]
    if found:
        text = f"{text[: found.start()]} {text[found.end() :]}"
    form, shot, rival = "", "", ""
    orientation, taken, words, raw, rest = "", "", [], [], []
    for token in re.findall(r"[a-z0-9]+", text):
        letters = _WORD.match(token)
        word, digits = (letters[0], token[letters.end() :]) if letters else ("", token)
        fixed = lexicon.correct(word) if word else ""
        if fixed in KINDS and (digits.isdigit() or not digits):
            taken, shot = (taken or fixed), shot or digits.lstrip("0")
            if kind == "time":
                taken = ""
            raw.append(word if kind != "time" else "")
        elif digits and word and kind == "hash" and digits.isdigit() and len(digits) <= 3:
            continue  # the device: the hash already tells the capture
        elif digits and not word and taken and not shot and kind == "ticket" and len(digits) <= 3:
            shot = digits.lstrip("0")
        elif digits:
            rest.append(token)
        elif fixed in FORM_FACTORS:
            form = form or fixed
        elif fixed in ORIENTATIONS:
            orientation = orientation or fixed
            raw.append(word)
        elif fixed == COMPETITOR:
            rival = "competitor"
        else:
            words.append(fixed)
            raw.append(word)
    gate = "|".join((kind, number, form, shot, rival, ".".join(rest)))
    return gate, "|".join((".".join(words), orientation, taken)), ".".join(w for w in raw if w)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words: Counter[str] = Counter()
        for name in batch.iloc[:, 0]:
            if name:
                words.update(_WORD.findall(re.sub(r"[0-9a-f]{8,}", " ", fold_name(base_name(name)))))
        yield pd.DataFrame({"word": list(words), "n": list(words.values())}).astype({"word": str, "n": "int64"})


def learn_lexicon(names: DataFrame, least: int = 2) -> Lexicon:
    """Word counts over all names of the one string column of `names`.

    Words are counted per batch before the shuffle. What comes to the driver is a vocabulary: words of 3 to LONGEST
    letters seen at least `least` times, whose number grows with the language of the names and not with rows; more
    than MOST_WORDS are an error. Other words correct nothing and are kept as typed.
    """
    counted = names.mapInPandas(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n") >= least).where(F.length("word").between(3, LONGEST)).limit(MOST_WORDS + 1).collect()
    if len(kept) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words in the names")
    return Lexicon({r.word: r.n for r in kept})


def parser(lexicon: Lexicon):
    """Arrow UDF string -> struct(gate, words, raw)."""
    counts = lexicon.counts

    @F.pandas_udf(PARSED)
    def parse_names(names: pd.Series) -> pd.DataFrame:
        own = Lexicon(counts)
        seen: dict[str | None, tuple] = {}
        for name in names:
            if name not in seen:
                seen[name] = parse(name, own)
        return pd.DataFrame([seen[name] for name in names], columns=["gate", "words", "raw"])

    return parse_names


def group_key(group: Column) -> Column:
    """`group` without case, blanks and the separator within a ticket; null and blank give null."""
    bare = F.regexp_replace(F.lower(group), r"[\s ​﻿]+", "")
    return F.nullif(F.regexp_replace(bare, r"^iksww[-_]*(?=\d)", "iksww-"), F.lit(""))


def clean_split(split: Column, path: Column) -> Column:
    """`split` without case and blanks; where null or blank, the first segment of `path`."""
    own = F.nullif(F.lower(F.trim(split)), F.lit(""))
    return F.coalesce(own, F.lower(F.trim(F.split_part(path, F.lit("/"), F.lit(1)))))
