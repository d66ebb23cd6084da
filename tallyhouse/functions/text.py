"""Text rendering and cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col


def valid_text(c: Column | str) -> Column:
    """Text without invalid UTF-8; the empty string counts as missing."""
    return F.nullif(F.make_valid_utf8(as_col(c)), F.lit(""))


def fixed2(c: Column | str) -> Column:
    """Number with two decimals, rounded half up, without an exponent."""
    hundredths = F.floor(as_col(c) * 100 + 0.5).cast("bigint")
    size = F.abs(hundredths)
    sign = F.when(hundredths < 0, "-").otherwise("")
    return F.concat(
        sign, F.floor(size / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0")
    )


def dollars(c: Column | str) -> Column:
    return F.concat(F.lit("$"), fixed2(c))


def fill(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column; NULL renders as 'null'."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(F.coalesce(values[name].cast("string"), F.lit("null")))
    return F.concat(*parts)


def first_text_item(c: Column | str) -> Column:
    """Text of the first ``type = "text"`` item of a JSON content list."""
    items = F.from_json(as_col(c), "array<struct<type:string,text:string>>")
    return F.trim(F.get(F.filter(items, lambda i: i["type"] == "text"), F.lit(0))["text"])
