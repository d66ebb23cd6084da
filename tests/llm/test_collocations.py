"""Collocations against a plain count of all phrases."""

import re
from collections import Counter

import numpy as np
import xxhash
from tallyhouse.llm import collocations as colloc

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, 2) for i, (t, g) in enumerate(rows)], SCHEMA)


def brute(rows, most=3, least=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und", tuple(words[i : i + size])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= covered * a and p in [q[i : i + len(p)] for i in range(len(q))] for (g, q), b in found.items()):
            continue
        score, _, le, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), le, r))
    rows, rank = [], Counter()
    for lang, score, a, phrase, le, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, le, r, n[lang], -score))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


HARD = [
    (None, None), ("", "en"), (" \t ", None), ("..!?;,:\n\r\x0b\x0c", "en"), ("lone", None), ("a b c " * 30, None), ("The Red Fox, the red fox. " * 12, "en"),
    ("the red fox" + "\n" + "x\ty", "en"), ("Été à là " * 15 + " nb sp", "fr"), ("z " * 40, "fr"), ("z " * 40, "fr"), ("w" * 5000 + " end", "fr"),
]


def test_collocations_match_brute_force(spark):
    rng = np.random.default_rng(13)
    words = ["red", "fox", "the", "of", "É", "k2", "so", "THE"]
    text = [" ".join(rng.choice(words, 60, p=[0.1, 0.1, 0.3, 0.2, 0.1, 0.1, 0.05, 0.05])) for _ in range(30)]
    rows = HARD + [(t.replace(" so ", ". "), g) for t, g in zip(text, ["en", None, "fr"] * 10, strict=True)]
    want = brute(rows)
    assert rows_of(colloc.collocations(frame(spark, rows))) == sorted(want) and len(want) > 20
    assert rows_of(colloc.collocations(frame(spark, rows), top=3)) == sorted(r for r in want if r[1] <= 3)
    assert rows_of(colloc.collocations(frame(spark, rows), words=4)) == sorted(brute(rows, 4))
    assert rows_of(colloc.collocations(frame(spark, rows), words=2, least=3)) == sorted(brute(rows, 2, 3))
    assert rows_of(colloc.collocations(frame(spark, []))) == []


def test_blocks_lose_no_phrase(monkeypatch):
    rng = np.random.default_rng(5)
    text = b" ".join(rng.choice([b"ab", b"c", b"dd", b"e\n", b""], 3000))
    parts = [p.split() for p in text.split(b"\n")]
    ids, own, names = colloc.numbered(text)
    assert (names[0], names[1], own) == (b"\n", b"", len(ids) - 1)
    for deepest in (2, 3):
        every = np.flatnonzero(ids != 0)
        padded = np.append(ids, np.zeros(deepest, ids.dtype))
        pointers, sizes = colloc.quicksort(padded, every, np.array([len(every)]), 0, deepest)
        got = Counter({b" ".join(names[i] for i in padded[p : p + deepest]): int(n) for p, n in zip(pointers[np.cumsum(sizes) - sizes], sizes, strict=True)})
        want = Counter(b" ".join(p[i : i + deepest]) for p in parts for i in range(len(p) - deepest + 1))
        assert got == want
    everything = [np.ones(64, bool)] * 2  # all bits set: every phrase passes
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(colloc, "BLOCK", size)
        total = Counter()
        for own, beyond in colloc.blocks([text, text, b""], 2):
            for phrases, n in colloc.counted(*colloc.numbered(own, beyond), b"en", everything):
                total.update(dict(zip(phrases, n.tolist(), strict=True)))
        assert total == Counter({b"en\n" + k: 2 * v for k, v in want.items()})


def test_phrases_are_hashed_alike_in_tasks_and_tables(spark):
    words = ["été", "où", "", "x"]
    h = 0
    for w in words:
        h = ((h << 1 | h >> 63) % (1 << 64)) ^ xxhash.xxh64_intdigest(f"fr\n{w}".encode(), 42)
    row = spark.createDataFrame([("fr", " ".join(words))], "lang string, phrase string").select(colloc.phrase_hash()).first()
    assert row[0] % (1 << 64) == h
