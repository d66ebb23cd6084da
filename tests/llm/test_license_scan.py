"""Licence scans against plain patterns (base) and edit distances at every place (fuzzy notices)."""

import re

import numpy as np
from tallyhouse.llm import license_scan as lic

SCHEMA = "doc_id long, text string, lang string, matches string, n_words int, label string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, "y") for i, t in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    words = WORD.findall(lower(text))
    return len(words), sorted(
        (i, label) for label, p in lic.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
    )


def fewest(notice, words):
    """Fewest edits of the notice against any part of the words."""
    cost = list(range(len(notice) + 1))
    best = cost[-1]
    for c in words:
        new = [0]
        for j, p in enumerate(notice):
            new.append(min(cost[j] + (p != c), cost[j + 1] + 1, new[j] + 1))
        cost = new
        best = min(best, cost[-1])
    return best


TEXTS = [
    (1, None), (2, ""), (3, " .,;-_ "), (4, "Licensed under the Apache License, Version 2.0."), (5, "MIT_License MIT-LICENSE mit license"),
    (6, "cc by cc BY cc\nby"), (7, "permit license; summit license x"), (8, "GNU General  Public\tLicense, and the gnu general public license"),
    (9, "Relesed under the MIT Licence"), (10, "released under the bsd license"), (11, "Licensed under CC BY-NC 4.0."), (11, "Licensed under CC BY-NC 4.0."),
    (None, "éMIT License 文 MIT License"), (12, "word " * 40_000 + "Mozila Public Licence" + " word" * 40_000), (13, "license " * 20_000),
    (14, "Permission is hereby granted, free of charge, to any persons obtaning a copy of this sofware"), (15, "mit license" * 30),
]


def test_base_places_match_plain_words(spark):
    got = lic.scan(frame(spark, TEXTS)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in TEXTS)
    want = {(i, *map(str, base(t))) for i, t in TEXTS}
    assert {(r["doc_id"], str(r["n_words"]), str(sorted((m["word"], m["label"]) for m in r["matches"] if m["base"]))) for r in got} == want
    by = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in got}
    assert by[9] == {"mit"} and by[10] == {"bsd"} and by[11] == {"cc-by", "cc-by-nc"} and by[12] == {"mpl"} and by[14] == {"mit"}
    assert not by[7] and not by[13] and by[None] == {"mit"}
    assert lic.scan(frame(spark, [])).collect() == []
    assert [r["matches"] for r in lic.scan(frame(spark, TEXTS), []).collect()] == [[]] * len(TEXTS)


def test_spans_are_places_in_the_text(spark):
    texts = dict(TEXTS)
    for r in lic.scan(frame(spark, TEXTS)).collect():
        text = texts[r["doc_id"]] or ""
        for m in r["matches"]:
            part = text[m["start"] : m["end"]]
            inner = " ".join(WORD.findall(lower(part)))
            assert fewest(f" {m['notice']} ", f" {inner} ") == m["edits"] if m["edits"] else inner == m["notice"]
            assert len(WORD.findall(lower(text[: m["start"]]))) == m["word"]


def test_every_notice_within_its_budget_is_found():
    search = lic.Search(lic.production())
    rng = np.random.default_rng(11)
    letters = list("abcdeilmnrstu é")
    seen = {True: 0, False: 0}
    for _ in range(400):
        i = int(rng.integers(len(lic.PHRASES), len(search.notices)))
        notice = search.notices[i]
        text = list(notice.text)
        for _ in range(int(rng.integers(0, notice.budget + 3))):
            at, kind, c = int(rng.integers(len(text))), int(rng.integers(3)), str(rng.choice(letters))
            text[at : at + 1] = [[c], [text[at], c], []][kind]
        words = " ".join(("xx yy " + "".join(text) + " zz").split(" "))
        words = f" {re.sub('  +', ' ', words).strip()} "
        edits = fewest(notice.padded, words)
        found = [m for m in search.spans(words) if m[0] == i]
        inside = edits <= notice.budget and (not notice.fixed or f" {notice.fixed} " in words)
        assert bool(found) == inside, (notice, words, edits)
        assert all(m[3] == edits for m in found)
        seen[inside] += 1
    assert min(seen.values()) > 50


def test_budgets_leave_whole_pieces():
    for n in lic.production():
        assert n.budget == 0 or min(len(p) for _, p in n.pieces()) >= lic.PIECE
        assert "".join(p for _, p in n.pieces()) == n.padded and len(n.pieces()) == n.budget + 1


def test_query_has_the_contract_columns(spark, tmp_path):
    frame(spark, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = lic.op11_license_scan(spark, str(tmp_path))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert rows[1]["n_words"] == 0 and rows[1]["first_word"] is None and rows[1]["labels"] == "" and rows[1]["score"] == 0
    assert (rows[5]["n_base"], rows[5]["first_word"], rows[5]["last_word"], rows[5]["base_labels"]) == (3, 0, 4, "mit")
    assert rows[9]["base_labels"] == "" and rows[9]["labels"] == "mit" and 0.85 < rows[9]["score"] < 1
    assert rows[11]["labels"] == "cc-by,cc-by-nc" and rows[4]["score"] == 1
