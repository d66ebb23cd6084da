"""Secrets in texts, with DataFrame functions only.

Three patterns give the base spans: assignments to names like password or token, access keys, and long runs of
hexadecimal digits. A battery of randomness tests adds more: tokens of at least ``SHORTEST`` characters of a base64 or
hexadecimal alphabet that look drawn at random.

For each token the encoding is inferred from its characters (decimal, hex in one case, letters and digits of one case,
base64 and its URL form). The place of a character in the alphabet of its encoding is its value. Three statistics are
standardised under "ordinary text", whose characters crowd into few classes and follow one another:

- chi-squared of the values against uniformity, over bins of the alphabet, per character,
- the number of runs of character classes (lower, upper, digit, sign), per character,
- the serial correlation of neighbouring values, as its size.

Ordinary text has a large chi-squared and few runs; so each statistic gives a p-value of how rarely text looks as
random, and Stouffer's sum combines them. Long tokens carry more evidence: the sum grows with the square root of the
length, and p-values are weighted by length. A token is a finding if its weighted p-value passes the Benjamini-Hochberg
bound over all tokens of the table, at ``RATE`` false discoveries. The bound comes from counts over a fixed grid of
p-values, added up over all rows, so only a small histogram of bounded size meets in one task.

Null texts count as empty. Repeated rows are rows of the result each. Empty tables give no rows. Texts are read whole.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, stored, table, with_text

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are taken whole, so a least length in the pattern drops the same matches as one asked afterwards.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")
#: Least length of a token that is tested, and accepted share of false discoveries.
SHORTEST, RATE = 20, 0.01
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"
#: Steps of the grid of log10 p-values, down to 1e-30.
STEPS, STEP = 600, 0.05
SPAN = "array<struct<start:bigint,kind:int,end:bigint,t:string>>"


def spans(pattern: str, kind: int, group: int = 0, shortest: int = 0, column: str = "text") -> Column:
    """start, kind, end and text (of the group) of each match. Starts add up the lengths before a match."""
    texts = F.regexp_extract_all(column, F.lit(pattern), F.lit(group))
    whole = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    between = F.split(column, pattern, -1)
    between = F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0)))
    matches = F.zip_with(
        F.zip_with(texts, whole, lambda t, w: F.struct(t.alias("t"), w.alias("w"))),
        between,
        lambda m, b: F.struct(m["t"].alias("t"), F.length(m["w"]).alias("n"), F.length(b).alias("gap")),
    )
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start = (acc["at"] + m["gap"]).cast("long")
        end = (start + m["n"]).cast("long")
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["t"].alias("t")))
        out = F.when(F.length(m["t"]) >= shortest, F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(matches, begin, step, lambda acc: acc["out"])


def only(spans_column: str) -> Column:
    return F.transform(spans_column, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def joined(column: Column) -> Column:
    """kind:start:end, by start, then kind as listed."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(F.array_sort(column), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scanned(docs: DataFrame) -> DataFrame:
    """Row keys, the base spans and the tokens of each text. What cannot match is not searched."""
    none = F.array().cast(SPAN)
    return docs.select(
        "doc_id",
        *row_key(),
        F.when(F.col("text").rlike("[:=]"), spans(ASSIGN, 0, 1, 6)).otherwise(none).alias("assign"),
        F.when(F.col("text").contains("AKIA"), spans(ACCESS, 1)).otherwise(none).alias("access"),
        F.when(F.col("text").rlike(HEX), spans(HEX, 2)).otherwise(none).alias("hex"),
        F.when(F.col("text").rlike(TOKEN), spans(TOKEN, 3)).otherwise(none).alias("tokens"),
    )


# ---- randomness -------------------------------------------------------------------

ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
BINS = 8
#: Mean of each statistic in ordinary text, and its deviation at a length of 20, from which it falls with the root.
TEXT = {"uneven": (1.5, 0.5), "turns": (0.03, 0.08), "serial": (0.25, 0.2)}


def tested(tokens: DataFrame) -> DataFrame:
    """``tokens`` with a column t, and: encoding, n, z (standard normal for ordinary text) and log_p of it."""
    body = F.regexp_replace("t", "=+$", "")
    encoding = (
        F.when(body.rlike("^[0-9]+$"), "decimal")
        .when(body.rlike("^[0-9a-f]+$"), "hex")
        .when(body.rlike("^[0-9A-F]+$"), "HEX")
        .when(body.rlike("^[0-9a-z]+$"), "lower")
        .when(body.rlike("^[0-9A-Z]+$"), "upper")
        .otherwise("base64")
    )
    abc = F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair))
    t = tokens.select("*", body.alias("body"), encoding.alias("encoding"))
    t = t.withColumns({"n": F.length("body").cast("double"), "abc": F.element_at(abc, F.col("encoding"))})
    t = t.withColumn("chars", F.expr("filter(split(body, ''), c -> c <> '')")).filter("n > 2")
    t = t.withColumn("u", F.expr("transform(chars, c -> (locate(c, abc) - 0.5D) / length(abc))"))
    counts = f"transform(sequence(0, {BINS - 1}), b -> size(filter(u, x -> least(greatest(floor(x * {BINS}), 0), {BINS - 1}) = b)))"
    classes = "transform(chars, c -> CASE WHEN c BETWEEN 'a' AND 'z' THEN 0 WHEN c BETWEEN 'A' AND 'Z' THEN 1 WHEN c BETWEEN '0' AND '9' THEN 2 ELSE 3 END)"
    t = t.withColumns({"counts": F.expr(counts), "classes": F.expr(classes)})
    ahead = "slice(u, 2, size(u) - 1)"
    t = t.withColumns(
        {
            "uneven": F.expr(f"aggregate(counts, 0D, (a, c) -> a + pow(c - n / {BINS}, 2) / (n / {BINS})) / n"),
            "turns": F.expr(
                "aggregate(zip_with(slice(classes, 2, size(classes) - 1), slice(classes, 1, size(classes) - 1), "
                "(a, b) -> int(a <> b)), 0D, (a, x) -> a + x) / (n - 1)"
            ),
            "mean": F.expr("aggregate(u, 0D, (a, x) -> a + x) / n"),
        }
    )
    t = t.withColumn("spread", F.expr("aggregate(u, 0D, (a, x) -> a + pow(x - mean, 2))"))
    t = t.withColumn(
        "serial",
        F.expr(
            f"CASE WHEN spread > 0 THEN abs(aggregate(zip_with({ahead}, slice(u, 1, size(u) - 1), "
            "(a, b) -> (a - mean) * (b - mean)), 0D, (a, x) -> a + x)) / spread ELSE 1D END"
        ),
    )
    scale = F.sqrt(F.lit(20.0) / F.col("n"))
    z = {k: (F.lit(m) - F.col(k)) / (F.lit(s) * scale) for k, (m, s) in TEXT.items()}
    # digits alone have one class, so their turns say nothing
    turns = F.when(F.col("encoding") == "decimal", F.lit(0.0)).otherwise(-z["turns"])
    t = t.withColumn("z", (z["uneven"] + turns + z["serial"]) / F.sqrt(F.lit(3.0)))
    # upper tail of the normal distribution, by its continued fraction
    x = F.greatest("z", F.lit(0.0))
    tail = x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 5))))
    log_p = F.least(F.lit(-0.30103), -(x * x / 2) / F.log(F.lit(10.0)) - F.log10(tail * 2.5066282746310002))
    return t.withColumn("log_p", log_p)


def discoveries(tokens: DataFrame, rate: float = RATE) -> DataFrame:
    """Those of the tested tokens that pass the bound on false discoveries, p-values weighted by length."""
    weight = F.least(F.sqrt(F.col("n") / 32), F.lit(4.0))
    step = F.least(F.floor((F.log10(weight) - F.col("log_p")) / STEP), F.lit(STEPS)).cast("int")
    t = tokens.withColumn("grid", F.greatest(step, F.lit(0)))
    seen = dict(t.groupBy("grid").agg(F.count(F.lit(1))).collect())  # at most STEPS + 1 rows
    total, above, bound = sum(seen.values()), 0, STEPS + 1
    for g in sorted(seen, reverse=True):
        above += seen[g]
        if 10 ** (-g * STEP) <= rate * above / total:
            bound = g
    return t.filter(F.col("grid") >= bound)


def secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row."""
    scan = stored(scanned(with_text(docs)), "secrets")
    base = F.concat(only("assign"), only("access"), only("hex"))
    tokens = scan.filter(F.size("tokens") > 0).select(
        "k1", "k2", base.alias("base"), F.explode(F.array_distinct("tokens")).alias("s")
    )
    tokens = tokens.filter(~F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"])))
    tokens = stored(tested(tokens.select("k1", "k2", "s.start", "s.end", "s.t").distinct()), "tokens")
    more = discoveries(tokens, rate).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("more")
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return scan.join(more, ["k1", "k2"], "left").select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, F.coalesce("more", none))).alias("spans"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
