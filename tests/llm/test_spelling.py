"""Spelling variants against a comparison of all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
from tallyhouse.llm import spelling
from tallyhouse.llm.fm_index import Vocabulary

SCHEMA = "doc_id long, text string, lang string, word string, n int, half string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, "h") for i, t in rows], SCHEMA)


def near(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 5}
    by = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= 5 * n[w] else None for w, v in by.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, str(form[w]), root, n[w], len(by[w]), str(n.get(form[w]))))
    return sorted(out)


def rows_of(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((r[0], str(r[1]), r[2], r[3], r[4], str(r[5])) for r in rows)


def texts():
    rng = np.random.default_rng(12)
    letters = list("abcé")
    base = ["".join(rng.choice(letters, int(rng.integers(6, 9)))) for _ in range(60)]
    words = set(base)
    for w in base:
        for _ in range(6):
            i, kind, c = int(rng.integers(len(w))), int(rng.integers(3)), str(rng.choice(letters))
            words.add((w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :])[kind])
    some = sorted(words)
    weight = rng.pareto(0.7, len(some)) + 0.2
    rows = [(i, " ".join(rng.choice(some, 120, p=weight / weight.sum()))) for i in range(400)]
    return [*rows, (None, rows[0][1]), (None, None), (900, ""), (901, None), (902, "short ab " + "Été" * 5 + "x×÷" * 4), (903, "z" * 9000 + " " + "z" * 8999), (0, rows[0][1].upper()),
            *[(904 + i, "z" * 9000 + "," + "z" * 8999 + "-THE_ABCABC") for i in range(5)]]


def test_variants_match_all_pairs(spark):
    rows = texts()
    want = brute(rows)
    assert rows_of(spelling.variants(frame(spark, rows))) == want
    assert sum(w[1] != "None" for w in want) > 20 and any(w[2] not in (w[0], w[1]) for w in want)
    assert rows_of(spelling.variants(frame(spark, []))) == []
    assert rows_of(spelling.variants(frame(spark, [(1, "only short words")]))) == []


def test_split_halves_give_the_same_pairs(spark):
    words = spark.createDataFrame([(w, n) for w, _, _, n, _, _ in brute(texts())], "word string, n long")
    whole = sorted(map(tuple, spelling.near_words(words).collect()))
    assert whole and sorted(map(tuple, spelling.near_words(words, group=3, task=20).collect())) == whole
    assert sorted(map(tuple, spelling.near_words(words, group=1).collect())) == whole


def test_slices_end_between_words(monkeypatch):
    text = "Abcdefgh ijklmn,opqrstu" * 40
    whole = [r for part in spelling.runs(text) for r in part]
    monkeypatch.setattr(spelling, "SLICE", 5)
    assert [r for part in spelling.runs(text) for r in part] == whole


def test_index_finds_each_near_word_once():
    rng = np.random.default_rng(7)
    for letters in ("ab", "aÀé", "abcdef"):
        words = sorted({"".join(rng.choice(list(letters), int(rng.integers(2, 8)))) for _ in range(150)})
        index = Vocabulary(words)
        for left in (True, False):
            got = Counter((words[a], words[b]) for a, b in zip(*index.near(np.arange(len(words)), left), strict=True))
            want = {
                (a, b) for a in words for b in words
                if near(a, b) and (b.startswith(a[: len(a) // 2]) if left else b.endswith(a[len(a) // 2 :]))
            }
            assert set(got) == want and set(got.values()) <= {1}
    assert Vocabulary([]).near(np.zeros(0, np.int64), True)[0].size == 0
