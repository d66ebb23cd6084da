"""Small cases of the training-data operators against brute force: nulls, empties, long texts, ties, repeats, extras."""

import hashlib
import itertools
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tallyhouse.llm import ann, common, decontaminate, jaccard, packing, pii, pii_rules, quality, repeats, secret_scan, toxicity, warc
from tallyhouse.llm.tagger import Tagger

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, token int, comp int"
LONG = " ".join(f"w{i}" for i in range(9000))
PASSAGE = "It was the best of passages, it was the worst of passages, " * 5
DOCS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "One  TWO"), (6, LONG), (7, LONG + " tail"),
    (8, PASSAGE + "and eight"), (9, "nine starts so " + PASSAGE), (9, "nine starts so " + PASSAGE), (None, PASSAGE[7:260]),
    (10, "a" * 700), (11, "x" * 199), (12, "ü" * 150 + "end"), (13, "zü" * 110), (14, "the cat sat on the mat"),
    (15, "the cat sat on the mat"), (None, None),
]


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in rows], SCHEMA)


# ---- 1: repeats -----------------------------------------------------------------


def test_repeats_match_brute_force(spark):
    raw = [(i, (t or "").encode()) for i, t in DOCS]
    seen = Counter(t[p : p + 200] for _, t in raw for p in range(len(t) - 199))
    want = []
    for i, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        want.append((str(i), len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = repeats.remove_repeats(frame(spark)).drop("kept").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert repeats.remove_repeats(frame(spark, [])).collect() == []


def test_repeats_at_every_edge(spark):
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("abcdef "), 2500))
    docs = [(0, base)]
    for i in range(1, 12):
        a, n = int(rng.integers(0, 2000)), int(rng.integers(195, 420))
        noise = "".join(rng.choice(list("uvwxyz"), 300))
        docs.append((i, noise[: i * 20] + base[a : a + n] + noise[i * 20 :]))
    seen = Counter(t[p : p + 200] for _, t in docs for p in range(len(t) - 199))
    want = {}
    for i, t in docs:
        gone = set()
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone.update(range(p, p + 200))
        want[i] = len(gone)
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(frame(spark, docs)).collect()}
    assert got == want


# ---- 2: decontamination -----------------------------------------------------------


def test_decontamination_finds_edits_within_budget(spark):
    item = "When in the course of many events it becomes needful to test a thing, one tests it twice and writes it down."
    edited = item.replace("course", "corse").replace("twice", "thrice")
    far = item.replace("the course of many events", "some other words entirely now")
    docs = [(1, "before " + item + " after"), (2, "x " + edited.upper() + " y"), (3, far), (4, None), (None, item), (5, item + item)]
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "tiny", 1), (9, "", 1)], "item_id long, text string, k1 int")
    got = decontaminate.contaminated(frame(spark, docs), bench).collect()
    hits = Counter((r["doc_id"], r["item_id"]) for r in got)
    assert hits == {(1, 7): 1, (2, 7): 1, (None, 7): 1, (5, 7): 2}
    assert {r["edits"] for r in got if r["doc_id"] == 1} == {0}
    assert all(r["edits"] == 3 for r in got if r["doc_id"] == 2)
    kept = decontaminate.without_benchmark(frame(spark, docs), bench)
    assert {r["doc_id"] for r in kept.collect()} == {3, 4} and kept.columns == decontaminate.DOCUMENT
    assert decontaminate.contaminated(frame(spark, []), bench).isEmpty()
    assert decontaminate.contaminated(frame(spark, docs), bench.limit(0)).isEmpty()


def test_decontamination_reports_every_exact_place(spark):
    bench = spark.createDataFrame([(1, "tiny"), (2, "aa"), (3, "ab" * 12)], "item_id long, text string")
    docs = [(1, "tiny and TINY, tiny"), (2, "x aaaa"), (3, "ab" * 14)]
    got = decontaminate.contaminated(frame(spark, docs), bench).filter("edits = 0").collect()
    want = [(1, 1, 0), (1, 1, 9), (1, 1, 15), (2, 2, 2), (2, 2, 3), (2, 2, 4), (3, 3, 0), (3, 3, 2), (3, 3, 4)]
    assert sorted((r["doc_id"], r["item_id"], r["start"]) for r in got) == want


# ---- 3 and 6: classifiers -----------------------------------------------------------


def words(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary, n))


def labelled(spark, label, texts):
    rows = [(i, t) for i, (t, _) in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(y)) for i, (_, y) in enumerate(texts)], f"doc_id long, {label} int")
    return frame(spark, [*rows, (900, None), (901, ""), (None, "plain words"), (0, texts[0][0])]), labels


def test_quality_learns_and_keeps_every_row(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["river", "stone", "quiet", "morning", "letter", "walks", "under", "bridge", "and", "the"]
    good = [(words(rng, vocabulary, 40), 1) for _ in range(120)]
    bad = [(" | ".join(rng.choice(vocabulary, 30)) + "!!! $$$", 0) for _ in range(60)]
    docs, labels = labelled(spark, "quality", good + bad)
    model = quality.fit(docs, labels)
    got = quality.score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model).collect()
    assert len(got) == 184 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert np.mean([by_id[i] >= 0.5 for i in range(120)]) > 0.95 and np.mean([by_id[i] < 0.5 for i in range(120, 180)]) > 0.95
    none = quality.fit(docs, labels.limit(0))
    assert none.bias == 0 and quality.score(docs.limit(0), none).isEmpty()


def test_toxicity_folds_disguises_and_spares_exceptions(spark):
    rng = np.random.default_rng(1)
    plain = [a + b for a in ("riv", "sto", "qui", "mor", "let", "wal", "und", "bri") for b in ("er", "ne", "et", "ing", "ks", "ow")]
    clean = [(words(rng, plain, 30), 0) for _ in range(150)]
    toxic = [(words(rng, plain, 15) + " grumblefoo " + words(rng, plain, 15), 1) for _ in range(60)]
    docs, labels = labelled(spark, "toxic", clean + toxic)
    lexicon = toxicity.fit(docs, labels, exceptions=["grumblefoo river"])
    a = lexicon.automaton()
    high = lambda t: lexicon.score(lexicon.strength(a, t, len(t.split()))) >= 0.5
    assert high("you GRUMBL3F00 person") and high("а grumblеfoo") and not high("a quiet stone")
    assert not high("the grumblefoo river is quiet") and not high("1984 was 100% fine!") and not high("")
    got = toxicity.score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), lexicon)
    assert got.count() == 214
    assert toxicity.learn([]).score(3.0) < 0.5


def test_toxicity_learns_from_texts_that_share_their_smallest_hashes():
    names = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nter", "rdin", "lsom", "vang", "zzel", "ctop")]
    names.sort(key=lambda w: zlib.crc32(w.encode()))
    shared, plain = " ".join(names[:3]), names[3:]
    rng = np.random.default_rng(2)
    clean = [(f"{shared} {words(rng, plain, 20)}", 0) for _ in range(150)]
    toxic = [(f"{shared} {words(rng, plain, 20)} grumblefoo", 1) for _ in range(60)]
    lexicon = toxicity.learn(clean + toxic)
    assert any("grumblefoo".startswith(e) for e in [*lexicon.stems, *lexicon.whole])


# ---- 4: secrets ---------------------------------------------------------------------

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secrets_match_brute_force(spark):
    docs = [
        (1, None), (2, ""), (3, 'ä PassWord: "hunter22" and secret=token: abcdefgh'), (4, "AKIA" + "A1" * 8 + " AKIASHORT"),
        (5, "id 0123456789abcdef01234567 and 0123456789ABCDEF"), (6, "api_key = x.y, token=" + "ab" * 20),
        (7, "a plain text of some words " * 50), (7, "a plain text of some words " * 50), (None, "passwd=123456"),
        (8, "key dG9rZW5fMTIzNDU2Nzg5MGFiY2RlZkdISUpLTE1OT1Bx end"), (9, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 3),
    ]
    got = defaultdict(list)
    for r in secret_scan.secrets(frame(spark, docs)).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(docs)
    for i, t in docs:
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(1)) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
        text = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base))
        n = Counter(k for _, k, _ in base)
        for r in got[i]:
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n[0], n[1], n[2])
            assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    assert secret_scan.secrets(frame(spark, [])).isEmpty()


def test_random_tokens_are_told_from_words(spark):
    rng = np.random.default_rng(2)
    code = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 40))
    docs = [(1, f"see {code} there"), (2, "the unbelievablyoverlongcompoundword is fine"), (3, "internationalizationworkers")]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secrets(frame(spark, docs)).collect()}
    assert got == {1: "random:4:44", 2: "", 3: ""}


# ---- 5: WARC ------------------------------------------------------------------------


def test_warc_round_trip_and_filters(spark, tmp_path):
    big = "<p>" + "é" * 800
    rows = [(1, "u1", big), (2, "u2", big), (3, None, "small"), (4, "u\n4", "small"), (None, "u", None), (5, "u5", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    got = {r["page_id"]: r for r in warc.page_archives(pages, path).collect()}
    assert len(got) == 6
    for i, _, html in rows:
        data = (html or "").encode()
        kind = "revisit" if i in (1, 2) else "response"
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (kind, 5 if kind == "revisit" else None)
    read = spark.read.format("warc").load(path)
    assert {bytes(r["payload"]) for r in read.filter("record_type = 'response'").collect()} == {big.encode(), b"small", b""}
    assert read.filter("payload_bytes >= 1000 and target_uri = 'u5'").count() == 1
    light = spark.read.format("warc").option("payload", "false").load(path)
    assert light.count() == 6 and light.filter("payload is not null").count() == 0
    empty = str(tmp_path / "empty")
    assert warc.page_archives(pages.limit(0), empty).collect() == []


def test_warc_pushes_filters_and_splits_files(spark, tmp_path):
    warc.register(spark)
    rows = [("response", f"<urn:{i}>", f"http://h/{i}", None, None, 500, bytes([i % 256]) * 500) for i in range(300)]
    df = spark.createDataFrame(rows, warc.SCHEMA).coalesce(1)
    path = str(tmp_path / "split")
    df.write.format("warc").option("split_bytes", 4000).mode("append").save(path)
    reader = warc.WarcReader(path, True)
    pieces = reader.partitions()
    assert len(pieces) > 5
    left = list(reader.pushFilters([warc.EqualTo(("record_id",), "<urn:7>"), warc.EqualTo(("payload",), b"")]))
    assert len(left) == 1
    assert [r[1] for p in pieces for r in reader.read(p)] == ["<urn:7>"]


def test_warc_reads_other_writers(spark, tmp_path):
    import gzip

    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    warc.register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    assert [bytes(r["payload"]) for r in got] == [b"hello", b"hello"]


# ---- 7: Jaccard ----------------------------------------------------------------------


def shingles(text, n):
    ws = [w for w in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()


def reached(sets, percent):
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if u and 100 * i >= percent * u:
                comp = [comp[b] if c == comp[a] else c for c in comp]
    return comp


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join_matches_brute_force(spark, n, percent):
    rng = np.random.default_rng(n)
    common = [f"c{i}" for i in range(30)]
    docs = list(DOCS)
    for i in range(100, 190):
        ws = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(2, 90)))] + common
        docs.append((i, " ".join(ws)))
        for j in range(int(rng.integers(0, 3))):
            copy = list(ws)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = f"e{rng.integers(50)}"
            docs.append((1000 * (j + 1) + i, " ".join(copy)))
    sets = [shingles(t, n) for _, t in docs]
    comp, smallest = reached(sets, percent), {}
    for (i, _), c in zip(docs, comp, strict=True):
        if i is not None:
            smallest[c] = min(i, smallest.get(c, i))
    want = sorted(str((i, len(s), i if not s else smallest.get(c))) for (i, _), s, c in zip(docs, sets, comp, strict=True))
    got = jaccard.similar_documents(frame(spark, docs), n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == want


@pytest.mark.parametrize(("n", "percent", "group"), [(3, 90, 7), (5, 80, 200)])
def test_join_counts_links_within_components(spark, monkeypatch, n, percent, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    rng = np.random.default_rng(n)
    docs = list(DOCS)
    for base in range(3):
        ws = [f"b{base}w{i}" for i in range(60)]
        for i in range(40):
            copy = list(ws)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(60))] = f"e{rng.integers(9)}"
            docs.append((100 * (base + 1) + i, " ".join(copy)))
    sets = [shingles(t, n) for _, t in docs]
    alike = lambda s, t: s | t and 100 * len(s & t) >= percent * len(s | t)
    want = [sum(bool(alike(s, t)) for y, t in enumerate(sets) if x != y) for x, s in enumerate(sets)]
    got = jaccard.similar_documents(frame(spark, docs), n, percent).select("doc_id", "n_shingles", "n_links").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, len(s), w)) for (i, _), s, w in zip(docs, sets, want, strict=True))
    assert max(want) > 10


def test_signatures_keep_every_link():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 63, 120, dtype=np.uint64)
    sets = [np.unique(np.delete(base, rng.integers(120, size=int(rng.integers(0, 40))))) for _ in range(60)]
    row, value = np.repeat(np.arange(60), [len(x) for x in sets]), np.concatenate(sets)
    sig = jaccard.signatures(row, value, 60)
    a, b = np.triu_indices(60, 1)
    size, common = np.array([len(x) for x in sets]), np.array([len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)])
    both = size[a] + size[b]
    left_out = jaccard.apart(sig, a, b, both * 10 // 190)
    link = 100 * common >= 90 * (both - common)
    assert link.any() and not (left_out & link).any()
    assert left_out[~link].mean() > 0.6


def test_dense_group_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEET", 7, raising=False)
    rng = np.random.default_rng(3)
    ws, docs = [f"w{i}" for i in range(120)], []
    for i in range(48):  # each copy lacks words that the others have, and has none of its own
        at = int(rng.integers(0, 112))
        docs.append((i, " ".join(ws[:at] + ws[at + 8 :])))
    compared, links = [], jaccard.links

    def counted(pairs, *args):
        compared.append((args[-1], pairs.count()))
        return links(pairs, *args)

    monkeypatch.setattr(jaccard, "links", counted)
    got = jaccard.similar_documents(frame(spark, docs), 3, 90, count_links=False).select("doc_id", "component_id").collect()
    comp = reached([shingles(t, 3) for _, t in docs], 90)
    smallest = {c: min(i for i, x in enumerate(comp) if x == c) for c in comp}
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: smallest[c] for i, c in enumerate(comp)}
    assert sum(n for name, n in compared if name == "more") <= 48


@pytest.mark.parametrize("listed", [40, 32, 20])
def test_pairs_of_many_nodes_come_once(spark, monkeypatch, listed):
    monkeypatch.setattr(jaccard, "LISTED", listed, raising=False)
    rng = np.random.default_rng(6)
    node, sets = np.arange(1, 41) * 7, [rng.choice(60, int(rng.integers(25, 41)), False) for _ in range(40)]
    rows = [(int(t), int(i), 100, int(i), 40, bytes(jaccard.BUCKETS)) for i, s in zip(node, sets, strict=True) for t in s]
    found = spark.createDataFrame(rows, "token long, node long, size int, comp long, total long, sig binary")
    got, times = Counter(), Counter()
    for r in jaccard.common_of_many(found, 90).collect():
        got[r["a"], r["b"]] += r["common"]
        times[r["a"], r["b"]] += 1
    pairs = [(x, y) for x in range(40) for y in range(x + 1, 40)]
    assert got == {(node[x], node[y]): len(np.intersect1d(sets[x], sets[y])) for x, y in pairs}
    assert all(times[node[x], node[y]] == 1 for x, y in pairs if max(len(sets[x]), len(sets[y])) <= listed)


def test_driver_gets_sieves_and_tokens_as_arrow(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", 1)
    texts = spark.range(64).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 1500), x -> id || 'w' || x), ' ') AS text")
    texts = texts.unionByName(texts).coalesce(1)  # each token twice in one task
    values = spark.range(1 << 18).select(F.xxhash64("id").alias("h"))
    tracemalloc.start()
    tokens, counts = jaccard.frequent_tokens(texts, 1)
    bitmap = common.sieve(values, "h")
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(tokens) == 64 * 1500 and counts.sum() == 128 * 1500 and (np.diff(tokens.astype(object)) > 0).all()
    hashes = np.array([r["h"] for r in values.limit(1000).collect()], np.int64)
    assert common.passes(bitmap, hashes).all() and bitmap.sum() <= 1 << 18
    assert most < 16 << 20  # 100,000 rows as Python objects are more


def test_join_of_nothing(spark):
    assert jaccard.similar_documents(frame(spark, []), 3, 90).collect() == []


# ---- 8: personal data ------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_rules_match_plain_patterns():
    texts = ["a@b@c.de x@y", "me.a%b+1@host-1.example.com,", "@x.y a@.b", "1.2.3.4 999.1.1.1 01.2.3.4.5", "+1 (555) 010-9999 +12", "ü 4111 1111 1111 1111, 4111111111111112"]
    for t in texts:
        assert [m.span() for m in EMAIL.finditer(t)] == pii_rules.emails(t)
    kinds = [k for t in texts for k, _, _ in pii_rules.rule_spans(t)]
    assert Counter(kinds) == {"email": 2, "ip": 2, "phone": 1, "card": 1}


def test_tagger_gradient():
    t, rng = Tagger(3, 4, 5), np.random.default_rng(0)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    windows, gold = rng.integers(0, 131, (2, 7)), rng.integers(0, 3, (2, 7))
    _, grad = t.learn(windows, gold)
    for k, v in t.p.items():
        at = (windows[0, 3], 1) if k == "embed" else tuple(int(rng.integers(0, n)) for n in v.shape)
        old, v_step = v[at], 1e-3
        v[at] = old + v_step
        up = t.learn(windows, gold)[0]
        v[at] = old - v_step
        down = t.learn(windows, gold)[0]
        v[at] = old
        assert abs((up - down) / (2 * v_step) - grad[k][at]) < 1e-3


def test_tagger_adds_what_patterns_miss(spark):
    tagger = pii.fit(frame(spark))
    held = pii.generated(150, seed=77)
    found = pii.added_spans(tagger, [t for t, _ in held], [[] for _ in held])
    gold = {(i, *s) for i, (_, ss) in enumerate(held) for s in ss}
    got = {(i, *s) for i, ss in enumerate(found) for s in ss}
    assert len(gold & got) > 0.8 * len(gold) and len(gold & got) > 0.85 * len(got)
    docs = frame(spark, [*DOCS, (50, "mail bob.1@mail.example.com now"), (51, "x " * 300 + "call +1 (555) 010-9999 now")])
    rows = pii.find(docs, tagger).collect()
    assert len(rows) == len(DOCS) + 2
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[50]["masked"] == "mail <EMAIL> now" and by_id[50]["spans"] == "email:5:27"
    assert by_id[51]["n_phone"] == 1 and by_id[51]["spans"].startswith("phone:605:")
    assert by_id[2]["spans"] == "" and by_id[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find(docs.limit(0), tagger).isEmpty()


class Capitals(Tagger):
    """Takes runs of capital letters for e-mail addresses."""

    def __init__(self):
        super().__init__(2 * len(pii.KINDS) + 1)
        self.p["step"][:] = 0

    def scores(self, windows):
        out = np.zeros((*windows.shape, len(self.p["step"])), np.float32)
        capital = (windows > ord("A")) & (windows <= ord("Z") + 1)
        start = capital & ~np.pad(capital, ((0, 0), (1, 0)))[:, :-1]
        out[..., 0], out[..., 1], out[..., 2] = ~capital * 9, start * 18, capital * 9
        return out


def test_tagger_reads_every_place(monkeypatch):
    """No @, digit or bracket in these texts: every window is scored, whatever it holds."""
    texts = ["ABCDEFGHIJ " + "word " * 100 + "KLMNOPQRST", "", "quiet", "x " * 3000 + "UVWXYZABC" + " y" * 41 + "QWERTZUIOP"]
    want = [[("email", 0, 10), ("email", 511, 521)], [], [], [("email", 6000, 6009), ("email", 6091, 6101)]]
    assert pii.added_spans(Capitals(), texts, [[] for _ in texts]) == want
    monkeypatch.setattr(pii, "BATCH", 3)
    assert pii.added_spans(Capitals(), texts, [[] for _ in texts]) == want


def test_parts_have_the_best_path_of_the_whole_text():
    tagger, rng = Tagger(9), np.random.default_rng(4)
    windows = rng.integers(0, 131, (5, 64))
    x = tagger.p["embed"][windows]
    h = np.concatenate([tagger.lstm(x, "f"), tagger.lstm(x[:, ::-1], "b")[:, ::-1]], axis=2)
    assert np.abs(h @ tagger.p["out"] + tagger.p["bias"] - tagger.scores(windows)).max() < 1e-4
    tagger.p["step"] = rng.normal(size=(9, 9)).astype(np.float32)
    some = [rng.normal(size=(n, 9)).astype(np.float32) for n in (1, 4, 0, 3, 4)]
    for s, path in zip(some, tagger.paths(some, batch=2), strict=True):
        worth = {p: sum(s[t, k] for t, k in enumerate(p)) + sum(tagger.p["step"][a, b] for a, b in itertools.pairwise(p)) for p in itertools.product(range(9), repeat=len(s))}
        assert tuple(path) == max(worth, key=worth.get)


# ---- 9: packing ------------------------------------------------------------------------


def test_packing_is_gapless_and_tight(spark):
    got = packing.pack_documents(frame(spark)).collect()
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in DOCS)
    by_seq, total = defaultdict(list), 0
    for r in got:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(want)
    assert sum(r["piece"] == 0 for r in got) == len(DOCS)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_seq) == -(-total // 1024)
    assert packing.pack_documents(frame(spark, [])).collect() == []


def test_bound_and_rounds(spark):
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 1024, 500), np.full(30, 600), np.full(31, 342), rng.integers(300, 700, 400)):
        _, _, rooms = packing.best_fit_decreasing(lengths, 1024)
        assert -(-int(lengths.sum()) // 1024) <= packing.lower_bound(lengths, 1024) <= len(rooms)
    assert packing.lower_bound(np.full(31, 342), 1024) == 16  # three such items do not fit a bin
    rows = spark.createDataFrame([(int(x),) for x in rng.integers(1, 1024, 3000)], "length long")
    many = packing.pack(rows, group_rows=200)
    assert many.count() == 3000
    bins = many.select("sequence_id").distinct().count()
    _, _, rooms = packing.best_fit_decreasing(np.array([r[0] for r in rows.collect()]), 1024)
    assert bins <= 1.02 * len(rooms) + 1
    assert many.groupBy("sequence_id").agg(F.sum("length").alias("s")).filter("s > 1024").isEmpty()


def test_last_group_after_many(spark):
    # 130 groups of four bins each leave a piece each, so 13 groups follow, then 2, then one
    rows = spark.range(1300).select("id", F.lit(300).cast("long").alias("length"))
    got = packing.pack(rows, group_rows=10)
    assert dict(got.dtypes)["sequence_id"] == "bigint" and sorted(r["id"] for r in got.collect()) == [*range(1300)]
    bins = got.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("offset")).alias("at")).collect()
    assert len(bins) == -(-1300 // 3) and all(r["at"] == [0, 300, 600][: r["n"]] for r in bins)


# ---- 10: nearest vectors -----------------------------------------------------------------


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).round(3)
    x[40:60] = x[40]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2020, [None] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = ann.nearest_vectors(df, df.filter("vec_id % 20 = 0"), k=10, block=400).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == {*range(0, 1500, 20), 2060}
    hits = 0
    for q in range(0, 1500, 20):
        score = np.cumsum(x * x[q], axis=1)[:, -1]
        best = sorted((-s, i) for i, s in enumerate(score) if i != q)[:10]
        assert len(found[q]) == 10 and all(s == score[i] for i, s in found[q] if i < 1500)
        hits += len({i for _, i in best} & {i for i, _ in found[q]})
    assert hits / 750 >= 0.9
    assert ann.nearest_vectors(df.limit(0), df.limit(0)).collect() == []
    few = ann.nearest_vectors(df.filter("vec_id < 5"), df.filter("vec_id = 0"))
    assert few.count() == 4


@pytest.mark.parametrize("times", [1, 200])
def test_fast_scores_are_those_of_the_network(times):
    tagger = Tagger(9)
    tagger.p["xb"] = tagger.p["xb"] * np.float32(times)
    windows = np.random.default_rng(2).integers(0, 131, (7, 64))
    x = tagger.p["embed"][windows]
    h = np.concatenate([tagger.lstm(x, "f"), tagger.lstm(x[:, ::-1], "b")[:, ::-1]], axis=2)
    assert np.abs(tagger.scores(windows) - (h @ tagger.p["out"] + tagger.p["bias"])).max() < 1e-3
