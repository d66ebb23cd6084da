"""Standardisation expressions over raw text columns.

Nothing here raises on bad input: unreadable text becomes NULL, also under
ANSI mode, so one stray value cannot fail a job.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unify(df: DataFrame, *variants: str) -> Column:
    """First non-null of the variant columns that ``df`` really has."""
    present = [F.col(f"`{v}`") for v in variants if v in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def normalise(c: Column | str, spellings: dict[str, list[str]], default: Column | None = None) -> Column:
    """Map spellings to their canonical value; others keep ``default`` (the value itself)."""
    c = as_col(c)
    out = None
    for canonical, accepted in spellings.items():
        hit = c.isin(accepted)
        out = F.when(hit, canonical) if out is None else out.when(hit, canonical)
    return out.otherwise(c if default is None else default)


def swap_if_state(city: Column | str, state: Column | str) -> tuple[Column, Column]:
    """(city, state), exchanged where the city holds the name of a state."""
    city, state = as_col(city), as_col(state)
    swapped = city.isin(vocab.US_STATES)
    return F.when(swapped, state).otherwise(city), F.when(swapped, city).otherwise(state)


def presence_score(weights: dict[str, int]) -> Column:
    """Sum of the weights of the columns that are not null."""
    terms = [F.when(F.col(c).isNotNull(), w).otherwise(0) for c, w in weights.items()]
    return reduce(lambda a, b: a + b, terms)


def finite(c: Column) -> Column:
    """Texts like NaN and Infinity are no amounts."""
    return F.when(F.abs(c) < float("inf"), c)


def number(c: Column | str, kind: str = "double") -> Column:
    value = as_col(c).try_cast(kind)
    return finite(value) if kind == "double" else value


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(as_col(c), F.lit(None).cast("double"))


def percent_or_fraction(c: Column | str) -> Column:
    """``40%`` and ``0.4`` both give 0.4."""
    c = as_col(c)
    return finite(
        F.when(c.endswith("%"), F.replace(c, F.lit("%"), F.lit("")).try_cast("double") / 100).otherwise(c.try_cast("double"))
    )


def money(c: Column | str) -> Column:
    """``$1,130.65`` gives 1130.65."""
    return finite(F.regexp_replace(as_col(c), vocab.MONEY_MARKS, "").try_cast("double"))


def blank(c: Column | str) -> Column:
    c = as_col(c)
    return c.isNull() | (F.trim(c) == "")


def garbage_to_null(c: Column | str, garbage: list[str] | None = None) -> Column:
    """Trimmed text; placeholder spellings (compared in upper case) become NULL."""
    text = F.trim(as_col(c))
    return F.when(~F.upper(text).isin(garbage or vocab.GARBAGE_WIDE), text)


# regular expressions of the parts of a fixed-width format
_PART = {"yyyy": r"(\d{4})", "MM": r"(\d{2})", "dd": r"(\d{2})", "HH": "(?:[01]\\d|2[0-3])", "mm": r"[0-5]\d", "ss": r"[0-5]\d"}
_TOKEN = re.compile(r"yyyy|MM|dd|HH|mm|ss|'[^']*'|.")


def _date_pattern(formats: list[str]) -> tuple[str, str]:
    """(pattern, replacement) that turns ``#`` and a text of any of the formats into ``yyyy-MM-dd``."""
    tails: dict[str, list[str]] = {}
    order: dict[str, list[str]] = {}
    for fmt in formats:
        tokens = _TOKEN.findall(fmt)
        last = max(i for i, t in enumerate(tokens) if t in ("yyyy", "MM", "dd")) + 1
        text = [_PART.get(t, re.escape(t.strip("'") if len(t) > 1 else t)) for t in tokens]
        head = "".join(text[:last])
        tails.setdefault(head, []).append("".join(text[last:]))
        order[head] = [t for t in tokens[:last] if t in ("yyyy", "MM", "dd")]
    groups: dict[str, list[int]] = {"yyyy": [], "MM": [], "dd": []}
    count = 0
    for parts in order.values():
        for part in parts:
            count += 1
            groups[part].append(count)
    pattern = "|".join(f"{head}(?:{'|'.join(ends)})" for head, ends in tails.items())
    year, month, day = ("".join(f"${g}" for g in groups[p]) for p in ("yyyy", "MM", "dd"))
    return f"^#(?:{pattern})$", f"{year}-{month}-{day}"


def parse_date(c: Column | str, formats: list[str]) -> Column:
    """Date of a text in any of the fixed-width formats; NULL if none fits.

    One regular expression rewrites every accepted format to ISO, so a value
    is parsed once. Trying a formatter per format throws inside the JVM for
    each miss, and the generated method grows too large for its compiler.
    A mark in front, which a match removes, keeps other text from being cast.
    """
    pattern, iso = _date_pattern(formats)
    return F.regexp_replace(F.concat(F.lit("#"), as_col(c)), pattern, iso).try_cast("date")


def parse_timestamp(c: Column | str, formats: list[str]) -> Column:
    c = as_col(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def return_date(c: Column | str) -> Column:
    c = as_col(c)
    return parse_date(F.when(F.upper(F.trim(c)) != "NULL", c), vocab.RETURN_DATE_FORMATS)


def rescued_text(key: str, rescued: Column | str = "_rescued_data") -> Column:
    return F.get_json_object(as_col(rescued), f"$.{key}")


def rescued_any(keys: list[str], rescued: Column | str = "_rescued_data") -> Column:
    """First of the keys found in the rescued JSON object; keys are case-sensitive."""
    return F.coalesce(*[rescued_text(k, rescued) for k in keys])


def size_list(c: Column | str) -> Column:
    """Comma list of valid, distinct size codes; ``One Size`` if none is left."""
    text = as_col(c)
    for word, code in vocab.SIZE_WORDS:
        text = F.regexp_replace(text, rf"(?i)\b{word}\b", code)
    tokens = F.transform(F.split(text, ","), lambda t: F.regexp_replace(F.trim(t), r"(\d)\s+([A-Za-z])", "$1$2"))
    valid = F.array_distinct(F.filter(tokens, lambda t: t.rlike(vocab.SIZE_TOKEN)))
    return F.when(F.size(valid) > 0, F.array_join(valid, ",")).otherwise(vocab.NO_SIZE)


def category_of(c: Column | str) -> Column:
    low = F.lower(as_col(c))
    out = None
    for word, name in vocab.CATEGORY_WORDS:
        out = F.when(low.contains(word), name) if out is None else out.when(low.contains(word), name)
    return out.otherwise(vocab.CATEGORY_OTHER)


def kilograms(c: Column | str) -> Column:
    """``500 g``, ``2 lbs`` or ``1.5 kg`` as kilograms; other units give NULL."""
    c = as_col(c)
    amount = F.regexp_extract(c, r"([0-9.]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(c, r"([a-zA-Z]+)", 1))
    out = None
    for name, factor in vocab.KILOGRAMS.items():
        value = amount / 1000 if factor == 0.001 else amount * factor
        out = F.when(unit == name, value) if out is None else out.when(unit == name, value)
    return out


def date_key(c: Column | str) -> Column:
    """Date as the integer yyyyMMdd."""
    c = as_col(c)
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def date_shape_name(c: Column | str) -> Column:
    c = as_col(c)
    return (
        F.when(c.isNull(), "NULL")
        .when(F.upper(F.trim(c)) == "NULL", "STRING_NULL")
        .when(c.rlike(r"^\d{2}/\d{2}/\d{4}"), "MM/DD/YYYY")
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), "YYYY-MM-DD")
        .when(c.rlike(r"^\d{2}-\d{2}-\d{4}"), "DD-MM-YYYY")
        .otherwise("UNKNOWN")
    )


# -- order-independent arithmetic -------------------------------------------
# Double sums depend on the order in which tasks finish. Sums here add scaled
# longs instead: exact, code-generated, and equal from run to run. Each addend
# is rounded to ``digits`` first. A value that is not finite or does not fit
# (9.2e14 money units at four digits) raises; ANSI mode raises if a sum overflows.


def scaled(c: Column | str, digits: int = 4) -> Column:
    value = as_col(c) * float(10**digits) + 0.5
    wrong = F.raise_error(F.concat(F.lit("cannot add up "), as_col(c).cast("string"))).cast("double")
    return F.floor(F.when(value.isNull() | (F.abs(value) < 9.2e18), value).otherwise(wrong)).cast("bigint")


def exact_sum(c: Column | str, digits: int = 4) -> Column:
    return F.sum(scaled(c, digits)) / F.lit(float(10**digits))


def decimal_sum(c: Column | str, digits: int = 10) -> Column:
    """Sum of decimals: no addend is rounded to money first, so small ones count. Slower than ``exact_sum``."""
    return F.sum(as_col(c).cast(f"decimal({digits + 16},{digits})"))


def exact_avg(c: Column | str, digits: int = 4) -> Column:
    c = as_col(c)
    return F.try_divide(exact_sum(c, digits), F.count(c))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded to two digits, NULL for an empty whole."""
    return F.floor(F.try_divide(part * 100.0, F.nullif(whole, F.lit(0))) * 100 + 0.5) / 100.0


def two_digits(c: Column | str) -> Column:
    return F.floor(as_col(c) * 100 + 0.5) / 100.0
