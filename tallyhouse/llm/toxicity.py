"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton after folding disguises.

Folding lower-cases, strips accents' look-alike alphabets (Cyrillic and Greek letters that look Latin) and turns digits
and signs that stand for letters into them. Entries are whole words or stems, which match at the start of a word. Their
weights are log odds of documents, learned from a bounded sample of labelled rows; so are exception phrases, two-word
phrases around an entry that occur in clean documents only. A hit inside an exception does not count. The score is a
logistic function of the sum of weights over the square root of the number of words.

Null texts count as empty; a text without hits gets the score of the bias alone. Repeated rows are scored each. Without
labelled rows of both kinds the lexicon is empty, and the score is 0. Empty tables give no rows. Texts are scanned
whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import SPACE, chunks
from .common import held_out, labelled_sample, python_tasks, table, with_text

#: Labelled rows of each label value that training takes at most.
SAMPLE = 4_000
THRESHOLD = 0.5
#: Letters that a sign, digit or letter of another alphabet stands for.
LOOKALIKES = str.maketrans(
    "0134578@$!|" + "авеёкмнорстухіјѕ" + "αβεικμνορτυχ",
    "oieastbasii" + "abeekmhopctyxijs" + "abeikmvoptux",
)
#: Letters always, digits and signs only where a letter follows: at the end of a word they are punctuation.
DISGUISED = re.compile("[авеёкмнорстухіјѕαβεικμνορτυχ]+|[0134578@$!|]+(?=[^\\W\\d_])")
WORD = re.compile(r"[^\W_]+")
#: Lengths of stems, and how a stem or word must stand out: documents, log odds, and log odds less twice their error.
STEMS = range(3, 9)
SEEN, ODDS, SURE = 4, 3.0, 1.5


def fold(text: str) -> str:
    text = text.lower()
    return DISGUISED.sub(lambda m: m.group().translate(LOOKALIKES), text)


@dataclass
class Lexicon:
    """Weights of stems and of whole words, and phrases within which hits do not count."""

    stems: dict[str, float] = field(default_factory=dict)
    whole: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    bias: float = -30.0

    def automaton(self):
        a = ahocorasick.Automaton()
        for e in self.stems.keys() | self.whole.keys():
            a.add_word(e, (len(e), self.stems.get(e), self.whole.get(e), False))
        for e in self.exceptions:
            a.add_word(e, (len(e), None, None, True))
        a.make_automaton()
        return a

    def hits(self, a, text: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of each hit; of several at one word the heaviest."""
        text = fold(text)
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for last, (size, stem, whole, exception) in a.iter(text):
            start, end = last - size + 1, last + 1
            if start and text[start - 1].isalnum():
                continue
            closed = end == len(text) or not text[end].isalnum()
            if exception:
                if closed:
                    spared.append((start, end))
                continue
            weight = max(stem or 0.0, (whole or 0.0) if closed else 0.0)
            if weight > best.get(start, (0, 0.0))[1]:
                best[start] = (end, weight)
        return [
            (s, e, w) for s, (e, w) in sorted(best.items()) if not any(x <= s and e <= y for x, y in spared)
        ]

    def strength(self, a, text: str, n_words: int) -> float:
        total = sum(w for _, _, w in self.hits(a, text)) if len(a) else 0.0
        return float(np.log1p(10 * total / np.sqrt(max(1, n_words))))

    def score(self, strength: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * strength + self.bias, -30, 30))))


def learn(rows: list[tuple[str, int]], exceptions: Iterable[str] = ()) -> Lexicon:
    """Lexicon, exceptions and logistic function from texts and labels."""
    # copies prove nothing new: of texts with the same set of words one is enough
    one_each = {}
    for t, y in sorted(rows):
        ws = WORD.findall(fold(t))
        one_each.setdefault((y, frozenset(ws)), (t, ws))
    rows = [(t, key[0]) for key, (t, _) in one_each.items()]
    texts = [(ws, key[0]) for key, (_, ws) in one_each.items()]
    n = Counter(y for _, y in texts)
    if not n[0] or not n[1]:
        return Lexicon()
    stems: tuple[Counter, Counter] = (Counter(), Counter())
    whole: tuple[Counter, Counter] = (Counter(), Counter())
    for ws, y in texts:
        kinds = set(ws)
        whole[y].update(kinds)
        stems[y].update({w[:k] for w in kinds for k in STEMS if len(w) >= k})

    def odds(counts: tuple[Counter, Counter], e: str) -> float:
        toxic, clean = counts[1][e] + 0.5, counts[0][e] + 0.5
        raw = np.log(toxic / (n[1] + 1) / clean * (n[0] + 1))
        return float(raw - 2 * np.sqrt(1 / toxic + 1 / clean)) if raw >= ODDS else 0.0

    lexicon = Lexicon()
    longer: dict[str, str] = {}
    for e, c in stems[1].items():
        if c > stems[1][longer.get(e[:-1], "")]:
            longer[e[:-1]] = e
    # a stem stands for what begins with it, unless a shorter one does so as well, or a longer one does it more purely
    for e in sorted((e for e, c in stems[1].items() if c >= SEEN), key=lambda e: (len(e), e)):
        w, child = odds(stems, e), longer.get(e, "")
        if stems[1][child] >= 0.8 * stems[1][e] and stems[0][child] < stems[0][e]:
            continue
        if w >= SURE and not any(lexicon.stems.get(e[:k], -9) >= w - 0.5 for k in range(STEMS[0], len(e))):
            lexicon.stems[e] = w
    for e, c in whole[1].items():
        if c >= SEEN and (w := odds(whole, e)) >= SURE:
            if not any(lexicon.stems.get(e[:k], -9) >= w - 0.5 for k in STEMS):
                lexicon.whole[e] = w
    known = lexicon.stems.keys() | lexicon.whole.keys()
    phrases: tuple[Counter, Counter] = (Counter(), Counter())
    for ws, y in texts:
        marked = [w in lexicon.whole or any(w[:k] in known for k in STEMS) for w in ws]
        phrases[y].update({f"{a} {b}" for a, b, p, q in zip(ws, ws[1:], marked, marked[1:], strict=False) if p or q})
    learned = sorted(p for p, c in phrases[0].items() if c >= SEEN and not phrases[1][p])
    lexicon.exceptions = sorted({*learned, *(fold(x) for x in exceptions)})
    # a logistic function, fitted by Newton's steps with a little shrinkage
    a = lexicon.automaton()
    x = np.array([lexicon.strength(a, t, len(t.split())) for t, _ in rows])
    y = np.array([y for _, y in rows], float)
    design, theta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (p - y) + 0.01 * theta
        curve = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        theta -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    lexicon.slope, lexicon.bias = float(theta[0]), float(theta[1])
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, exceptions: Iterable[str] = ()) -> Lexicon:
    """Lexicon of ``labels.toxic``; only a bounded sample leaves the executors."""
    sample = labelled_sample(docs, labels, "toxic", rows).select("doc_id", "text", "label")
    drawn = sorted(((r["doc_id"], r["text"], r["label"]) for r in sample.toLocalIterator()), key=lambda r: r[:2])
    return learn([(t, y) for _, t, y in drawn], exceptions)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score and number of hits of each row of ``docs`` (doc_id, text)."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for part, data, off in chunks(batches):
            gap = SPACE[data]
            starts = ~gap
            starts[1:] &= gap[:-1]
            n_words = np.diff(np.concatenate([[0], np.cumsum(starts)])[off])
            strength = [lexicon.strength(a, t, n) for t, n in zip(part.column(1).to_pylist(), n_words, strict=True)]
            scores = pa.array([lexicon.score(x) for x in strength], pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), scores], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_text(table(spark, sf_dir, "documents"))
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, lexicon).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
