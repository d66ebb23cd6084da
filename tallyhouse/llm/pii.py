"""Personal data: patterns, and a character tagger (``tagger``) that adds what patterns miss.

Spans of the patterns (``pii_rules``) always stay. The tagger is trained on labelled spans: a bounded sample of passages
whose labels are those of the patterns, and generated passages in which the same data is written in other ways (an
address with (at) and dot, a phone number without +). It reads every place of every text, in windows on a fixed grid;
scores of neighbouring windows are reconciled, and parts that a span can be in are decoded as one. A decoded span is added if it is sure enough
and touches no span of a pattern.

Null texts count as empty and have no spans. Repeated rows are rows of the result each. Empty tables give no rows.
Texts are read whole; offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import chunks
from .common import DOCUMENT, python_tasks, table, with_text
from .pii_rules import KINDS, rule_spans
from .tagger import EDGE, STRIDE, WINDOW, Tagger, symbols

#: Sampled and generated passages for training.
SAMPLE, GENERATED = 700, 1_300
#: Mean probability of its tags from which a decoded span is added, and its least length.
SURE, SHORTEST = 0.9, 7
#: Windows that are scored at a time.
BATCH = 1024
#: Blocks on each side of a place with a tag that belong to its part.
MARGIN = 2


# ---- training -------------------------------------------------------------------


def tags_of(length: int, spans: Iterable[tuple[str, int, int]]) -> np.ndarray:
    """0 outside; 2 k + 1 at the start and 2 k + 2 within a span of the k-th kind."""
    out = np.zeros(length, np.int64)
    for kind, s, e in spans:
        k = KINDS.index(kind)
        out[max(0, s) : max(0, e)] = 2 * k + 2
        if 0 <= s < length:
            out[s] = 2 * k + 1
    return out


def generated(n: int, seed: int = 9) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Passages with data of each kind, also in forms that the patterns don't know, and with what only looks alike."""
    rng = np.random.default_rng(seed)
    letters, digits = list("abcdefghijklmnopqrstuvwxyz"), list("0123456789")
    word = lambda a, b: "".join(rng.choice(letters, int(rng.integers(a, b))))
    number = lambda k: "".join(rng.choice(digits, k))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    out = []
    for _ in range(n):
        text, spans = word(2, 9), []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(1, 6))):
                text += pick(" ", " ", " ", ", ", ". ") + word(1, 10)
            text += pick(" ", " ", ": ", " (")
            kind = pick(*KINDS, "none", "none")
            if kind == "email":
                a, b, dot = pick(*["@"] * 3, " (at) ", " [at] ", "(at)"), word(3, 9), pick(".", ".", " dot ", " (dot) ")
                value = word(2, 9) + pick("", "." + number(2), "_" + word(2, 6)) + a + b + pick("", number(1)) + dot + pick("com", "org", "net", "example" + dot + "com")
            elif kind == "ip":
                value = ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
            elif kind == "card":
                gap, d = pick("", "", " ", "-"), number(16)
                value = gap.join(d[i : i + 4] for i in range(0, 16, 4))
            elif kind == "phone":
                a, b, c = number(3), number(3), number(4)
                value = pick(f"+{number(1)} ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(1)}-{a}-{b}-{c}")
            else:
                value = pick(number(int(rng.integers(1, 8))), f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", "".join(rng.choice(list("0123456789abcdef"), 40)), f"v{number(1)}.{number(1)}.{number(2)}", word(3, 8) + number(2), f"password={word(2, 5)}{number(4)}")
            if kind != "none":
                spans.append((kind, len(text), len(text) + len(value)))
            text += value
        out.append((text + pick(" ", ". ", ", ") + word(2, 12), spans))
    return out


def passages(docs: DataFrame, rows: int) -> list[str]:
    """Texts around the first trigger of sampled documents, in order of a hash of the id."""
    at = F.regexp_instr("text", F.lit("[@0-9]"))
    # only the passages are sorted, not the texts
    some = docs.filter(F.col("text").rlike("[@0-9]")).select(
        F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b"), F.substring("text", F.greatest(at - 90, F.lit(1)), F.lit(240)).alias("passage")
    )
    return [r["passage"] for r in some.orderBy("a", "b").limit(rows).select("passage").collect()]


def fit(docs: DataFrame, rows: int = SAMPLE) -> Tagger:
    """Trained on the driver, on bounded samples."""
    examples = generated(GENERATED) + [(t, rule_spans(t)) for t in passages(docs, rows)]
    windows, gold = [], []
    for text, spans in examples:
        s, g = symbols(text), tags_of(len(text), spans)
        for i in range(0, max(1, len(s) - STRIDE), WINDOW):
            windows.append(np.pad(s[i : i + WINDOW], (0, max(0, WINDOW - len(s[i : i + WINDOW])))))
            gold.append(np.pad(g[i : i + WINDOW], (0, max(0, WINDOW - len(g[i : i + WINDOW])))))
    tagger = Tagger(2 * len(KINDS) + 1)
    tagger.train(np.array(windows), np.array(gold))
    return tagger


# ---- decoding -------------------------------------------------------------------


def blocks(tagger: Tagger, coded: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Scores of whole texts, some windows at a time: text and number of each block of ``STRIDE`` places, and its scores.

    A window begins every ``STRIDE`` places. A block is the first half of one window and the second half of the window
    before; scores of the two are averaged with weights that fall towards a window's edges.
    """
    sizes = np.array([-(-len(s) // STRIDE) for s in coded], np.int64)
    text = np.repeat(np.arange(len(coded)), sizes)
    number = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first, second = EDGE[:STRIDE, None], EDGE[STRIDE:, None]
    before = np.zeros((STRIDE, 1), np.float32)
    for at in range(0, len(text), BATCH):
        t, k = text[at : at + BATCH], number[at : at + BATCH]
        windows = np.zeros((len(t), WINDOW), np.int64)
        for row, (i, j) in enumerate(zip(t.tolist(), (k * STRIDE).tolist(), strict=True)):
            s = coded[i][j : j + WINDOW]
            windows[row, : len(s)] = s
        scores = tagger.scores(windows)
        last = np.concatenate([np.broadcast_to(before, (1, STRIDE, scores.shape[2])), scores[:-1, STRIDE:]])
        before = scores[-1, STRIDE:]
        inner = (k > 0)[:, None, None]
        yield t, k, (scores[:, :STRIDE] * first + np.where(inner, last * second, 0)) / (first + inner * second)


def parts(tagger: Tagger, coded: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Text, first place and scores of each part that a span can be in.

    Every place is scored. A span gains over the path outside it, so at one of its places at least a tag beats tag 0 by
    more than a step within spans can gain; a part is the blocks with such a place and ``MARGIN`` blocks on each side.
    """
    step = tagger.p["step"]
    least = min(0.0, float(step[0, 0] - step.max()))
    kept: dict[tuple[int, int], np.ndarray] = {}
    tail: tuple = ()
    for batch in blocks(tagger, coded):
        text, number, scores = (np.concatenate(x) for x in zip(tail, batch, strict=True)) if tail else batch
        hot = (scores[..., 1:].max(2) - scores[..., 0] > least).any(1)
        near = hot.copy()
        for d in range(1, MARGIN + 1):
            alike = text[d:] == text[:-d]
            near[d:] |= hot[:-d] & alike
            near[:-d] |= hot[d:] & alike
        for j in np.flatnonzero(near):
            kept[int(text[j]), int(number[j])] = scores[j]
        # the next blocks may want the last of these, and these may be why they are wanted
        tail = (text[-2 * MARGIN :], number[-2 * MARGIN :], scores[-2 * MARGIN :])
    run: list[tuple[int, int]] = []
    for at in [*sorted(kept), (-1, -1)]:
        if run and at != (run[-1][0], run[-1][1] + 1):
            i, begin = run[0][0], run[0][1] * STRIDE
            yield i, begin, np.concatenate([kept[x] for x in run])[: len(coded[i]) - begin]
            run = []
        run.append(at)


def decode(tagger: Tagger, s: np.ndarray, path: np.ndarray, begin: int) -> list[tuple[str, int, int]]:
    """Spans of the best path of one part, if they are sure enough."""
    if not path.any():
        return []
    kind_of = (path + 1) // 2
    sure = tagger.marginals(s)[np.arange(len(path)), path]
    out, i = [], 0
    while i < len(path):
        if not path[i]:
            i += 1
            continue
        j = i + 1
        while j < len(path) and path[j] == 2 * kind_of[i]:
            j += 1
        if j - i >= SHORTEST and sure[i:j].mean() >= SURE:
            out.append((KINDS[kind_of[i] - 1], begin + i, begin + j))
        i = j
    return out


def added_spans(tagger: Tagger, texts: list[str], known: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger adds to those known, per text. Every place of every text is scored."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    found = list(parts(tagger, [symbols(t) for t in texts]))
    for (i, begin, s), path in zip(found, tagger.paths([s for _, _, s in found]), strict=True):
        for kind, x, y in decode(tagger, s, path, begin):
            if all(y <= a or b <= x for _, a, b in known[i]):
                out[i].append((kind, x, y))
    return out


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def mask(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first counts, widened to the last end."""
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join(out) + text[at:]


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``docs`` (with text) and, for each row: n_<kind> and base_sha256 of the patterns' spans, spans, masked text."""
    spark = docs.sparkSession
    python_tasks(spark)
    sent = spark.sparkContext.broadcast(tagger)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "masked"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in chunks(batches):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            base = [rule_spans(t) for t in texts]
            more = added_spans(sent.value, texts, base)
            columns = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            columns.append(pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]))
            columns.append(pa.array([joined(b + m) for b, m in zip(base, more, strict=True)]))
            columns.append(pa.array([mask(t, b + m) for t, b, m in zip(texts, base, more, strict=True)]))
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.mapInArrow(run, f"{kept}, {counts}, base_sha256 string, spans string, masked string")


def masked_documents(docs: DataFrame) -> DataFrame:
    """Documents with all personal data replaced, and n_chars of what is left."""
    tagger = fit(with_text(docs))
    found = find(docs.select(*DOCUMENT), tagger).withColumn("text", F.col("masked"))
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*DOCUMENT)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_text(table(spark, sf_dir, "documents"))
    return find(docs, fit(docs)).drop("text", "masked")
