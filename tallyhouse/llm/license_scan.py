"""Licence scans: fuzzy search for short notices.

A notice of m code points with a budget of k edits is cut into k + 1 pieces. Wherever it occurs with at most k edits, at
least one piece occurs exactly (pigeonhole), so an Aho-Corasick automaton over all pieces finds every place where a notice
can be. Places of one notice that lie within 2 * k of each other form a window, and the regex library's bounded-error
matching looks for the whole notice in that window: it verifies the edits and gives the span. Where spans of one notice
overlap, the one with the fewest edits stays, of equal ones the leftmost.

Texts are compared word by word: letters A-Z in lower case, every other ASCII character but digits separates words, all
others belong to them. Notices begin and end with a word. A notice without budget is a plain phrase: all of its places are
reported, overlapping ones too. Some notices differ from others in one short word only, so a match has to have that word
unchanged.

Null and empty texts have no words and no matches; each row gives one row, repeated rows too; texts are searched whole;
other columns are never read; an empty table gives no rows. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_tasks, table, with_text

#: Edits allowed for each code point of a notice, the most edits (bounded-error matching slows down with them), and the
#: shortest exact piece a notice is cut into.
RATE, MOST, PIECE = 0.1, 5, 6
#: Bytes that separate words become spaces, letters A-Z lower-case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# fixed values: phrases whose places count as base, with their labels
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# fixed values: label, notice, the word that must not change
NOTICES = [
    ("agpl", "gnu affero general public license", ""),
    ("apache", "apache license version 2 0", ""),
    ("apache", "apache software license", ""),
    ("apache", "licensed under the apache license version 2 0", ""),
    ("boost", "boost software license version 1 0", ""),
    ("bsd", "bsd 2 clause license", "bsd"),
    ("bsd", "bsd 3 clause license", "bsd"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ""),
    ("bsd", "released under the bsd license", "bsd"),
    ("cc-by", "creative commons attribution", ""),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ""),
    ("cc-by", "licensed under cc by", "cc"),
    ("cc-by-nc", "cc by nc", "nc"),
    ("cc-by-nc", "creative commons attribution noncommercial", ""),
    ("cc-by-nd", "cc by nd", "nd"),
    ("cc-by-nd", "creative commons attribution noderivatives", ""),
    ("cc-by-sa", "cc by sa", "sa"),
    ("cc-by-sa", "creative commons attribution sharealike", ""),
    ("cc0", "cc0 1 0 universal", "cc0"),
    ("epl", "eclipse public license", ""),
    ("gpl", "gnu general public license", ""),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ""),
    ("lgpl", "gnu lesser general public license", ""),
    ("lgpl", "gnu library general public license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ""),
    ("mit", "released under the mit license", "mit"),
    ("mit", "the mit license", "mit"),
    ("mpl", "mozilla public license", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
]

MATCH = "struct<label: string, notice: string, start: long, end: long, word: long, edits: int, base: boolean>"
SCANNED = f"doc_id long, n_words long, matches array<{MATCH}>"


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    budget: int = 0
    fixed: str = ""
    base: bool = False

    @property
    def padded(self) -> str:
        return f" {self.text} "

    def pieces(self) -> list[tuple[int, str]]:
        """Offset and text of budget + 1 pieces."""
        edges = [len(self.padded) * i // (self.budget + 1) for i in range(self.budget + 2)]
        return [(a, self.padded[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def budget(text: str, rate: float = RATE, piece: int = PIECE) -> int:
    size = len(text) + 2
    return max(0, min(int(rate * size), MOST, size // piece - 1))


def production() -> list[Notice]:
    base = [Notice(label, text, base=True) for label, text in PHRASES]
    return base + [Notice(label, text, budget(text), fixed) for label, text, fixed in NOTICES]


def folded(text: str) -> str:
    return text.encode().translate(FOLD).decode()


class Search:
    """Pieces of all notices in one automaton, and a pattern with bounded errors for each notice."""

    def __init__(self, notices: list[Notice]):
        self.notices = notices
        places = defaultdict(list)
        for i, notice in enumerate(notices):
            for offset, piece in notice.pieces():
                places[piece].append((i, offset, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.padded, literal_spaces=True)}){{e<={n.budget}}}") for n in notices]
        # a window that repeats, as in a text of one repeated word, is verified once
        self.verify = lru_cache(1 << 16)(self._verify)

    def _verify(self, i: int, window: str) -> tuple[int, int, int] | None:
        """Start and end without the spaces around, and edits, of the best match of a notice in a window."""
        notice = self.notices[i]
        exact = window.find(notice.padded)
        if exact >= 0:
            return exact + 1, exact + 1 + len(notice.text), 0
        found = self.patterns[i].search(window)
        if not found:
            return None
        text = found.group()
        if notice.fixed and f" {notice.fixed} " not in f" {text} ":
            return None
        start = found.start() + len(text) - len(text.lstrip(" "))
        return start, start + len(text.strip(" ")), sum(found.fuzzy_counts)

    def spans(self, words: str) -> list[tuple[int, int, int, int]]:
        """Notice, start, end and edits of all matches in words with one space before, between and behind them."""
        if not self.notices:
            return []
        hits = defaultdict(set)
        for last, where in self.automaton.iter(words):
            for i, offset, size in where:
                hits[i].add(last + 1 - size - offset)
        out = []
        for i, starts in hits.items():
            notice = self.notices[i]
            k, size = notice.budget, len(notice.padded)
            if not k:
                out += [(i, s + 1, s + 1 + len(notice.text), 0) for s in starts]
                continue
            best: list[tuple[int, int, int, int]] = []
            ordered = sorted(starts)
            at = 0
            while at < len(ordered):
                low = high = ordered[at]
                while at < len(ordered) and ordered[at] - low <= 2 * k:
                    high = ordered[at]
                    at += 1
                begin = max(0, low - k)
                found = self.verify(i, words[begin : high + size + k])
                if found:
                    best.append((found[2], begin + found[0], begin + found[1], i))
            out += apart(best)
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of runs of overlapping spans (edits, start, end, notice) each one with the fewest edits, then the leftmost, that
    overlaps none chosen before."""
    out: list[tuple[int, int, int, int]] = []
    run: list[tuple[int, int, int, int]] = []
    reach = -1
    for span in [*sorted(set(found), key=lambda m: m[1]), None]:
        if span is None or span[1] >= reach:
            chosen: list[tuple[int, int, int, int]] = []
            for m in sorted(run):
                if all(m[2] <= c[1] or m[1] >= c[2] for c in chosen):
                    chosen.append(m)
            out += [(i, start, end, edits) for edits, start, end, i in chosen]
            run = []
        if span is not None:
            run.append(span)
            reach = max(reach, span[2])
    return out


def document_matches(text: str, search: Search) -> tuple[int, list[dict]]:
    """Words of a text and its matches; spans in code points of the text, places in words."""
    low = folded(text)
    words = f" {re.sub('  +', ' ', low).strip(' ')} "
    n_words = words.count(" ") - 1 if words.strip(" ") else 0
    spans = search.spans(words) if n_words else []
    if not spans:
        return n_words, []
    gap = np.frombuffer(low.encode("utf-32-le"), np.uint32) == 32
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    spaces = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), np.uint32) == 32)

    def place(at: int) -> tuple[int, int]:
        word = int(np.searchsorted(spaces, at)) - 1
        return word, int(starts[word]) + at - int(spaces[word]) - 1

    out = []
    for i, start, end, edits in spans:
        notice = search.notices[i]
        word, begin = place(start)
        last = place(end - 1)[1] + 1
        out.append({"label": notice.label, "notice": notice.text, "start": begin, "end": last, "word": word, "edits": edits, "base": notice.base})
    return n_words, out


def scan(docs: DataFrame, notices: list[Notice] | None = None) -> DataFrame:
    """doc_id, n_words, matches (label, notice, start, end, word, edits, base) of each row, matches by place."""
    spark = docs.sparkSession
    python_tasks(spark)
    sent = spark.sparkContext.broadcast(production() if notices is None else notices)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(sent.value)
        kind = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            found = [document_matches(t.as_py(), search) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found], kind)],
                ["doc_id", "n_words", "matches"],
            )

    return with_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCANNED)


def labels_of(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(matches["label"])), ",")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best match's share of unchanged
    code points, 0 without a match), spans (label:start:end:edits of the method's own matches, comma-joined)."""
    found = scan(table(spark, sf_dir, "documents"))
    base, own = F.filter("matches", lambda m: m["base"]), F.filter("matches", lambda m: ~m["base"])
    close = F.transform("matches", lambda m: 1 - m["edits"] / (F.char_length(m["notice"]) + 2))
    spans = F.transform(own, lambda m: F.concat_ws(":", m["label"], m["start"], m["end"], m["edits"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["word"]).alias("first_word"),
        F.array_max(base["word"]).alias("last_word"),
        labels_of(base).alias("base_labels"),
        labels_of(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(close), F.lit(0.0)).alias("score"),
        F.array_join(spans, ",").alias("spans"),
    )
