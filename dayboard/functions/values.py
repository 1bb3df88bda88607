"""Small classifications and formats."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time, however often it is used.

    Spark shares equal parts of a projection, but not below conditions, where each use would compute its value anew;
    nested uses then multiply.
    """
    return F.get(F.transform(F.array(value), use), 0)


def filled(text: Column) -> Column:
    """A text, null instead of an empty one."""
    return once(text, lambda t: F.when(t != "", t))


# Patterns of error texts in the order in which they are tried, exit codes, region slugs.
ERROR_PATTERNS = [
    ("VALIDATION", r"\[VALIDATION ERROR\]"),
    ("EMPTY_RESULT", "イベントが0件|date_from が1件も|取得結果が空"),
    ("NETWORK", r"(?i)HTTP 取得に失敗|HTTP \d+|AbortError|fetch failed|timeout"),
    ("PARSE", "デコードに失敗|解凍に失敗|パース|解析|見つからない"),
]
PREFECTURES = {"徳島県": "tokushima", "香川県": "kagawa", "愛媛県": "ehime", "高知県": "kochi"}


def rate_status(rate: Column, warn: float = 0.01, fail: float = 0.03) -> Column:
    return F.when(rate > fail, "fail").when(rate > warn, "warn").otherwise("ok")


def percent(rate: Column) -> Column:
    return F.format_string("%.2f%%", rate * 100)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def tail(text: Column, n: int = 100_000) -> Column:
    return F.right(text, F.lit(n))


def error_type(message: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ERROR_PATTERNS):
        out = F.when(message.rlike(pattern), name).otherwise(out)
    return out


def is_retryable(kind: Column) -> Column:
    return F.coalesce(kind == "NETWORK", F.lit(False))


def schema_org_status(status: Column) -> Column:
    s = F.lower(status)
    return F.concat(F.lit("https://schema.org/"), F.when(s.isin("cancelled", "canceled"), "EventCancelled").when(s == "postponed", "EventPostponed").otherwise("EventScheduled"))


def prefecture_slug(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PREFECTURES.items() for x in kv])
    return F.coalesce(table[name], F.lit("others"))


def seconds(ms: Column) -> Column:
    return F.round(ms / 1000, 1)


def parse_json(text: Column, schema: str, default: Column) -> Column:
    """Parsed JSON, or a default where it cannot be parsed."""
    return F.coalesce(F.from_json(text, schema), default)


def require_json(text: Column, schema: str, what: str = "JSON") -> Column:
    """Parsed JSON; what cannot be parsed is an error of the kind PARSE."""
    parsed = F.from_json(text, schema)
    return F.when(text.isNotNull() & F.try_parse_json(text).isNull(), F.raise_error(F.lit(f"{what} の JSON パースに失敗しました。"))).otherwise(parsed)


def pretty_json(value: Column, kind: DataType, depth: int = 0) -> Column:
    """JSON of a value of the type ``kind`` with two spaces a level, nulls kept."""
    inner, outer = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    if isinstance(kind, StructType) and kind.fields:
        lines = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), pretty_json(value.getField(f.name), f.dataType, depth + 1)) for f in kind.fields]
        out = F.concat(F.lit("{" + inner), F.concat_ws("," + inner, *lines), F.lit(outer + "}"))
    elif isinstance(kind, ArrayType):
        items = F.transform(value, lambda x: pretty_json(x, kind.elementType, depth + 1))
        out = F.when(F.size(value) == 0, "[]").otherwise(F.concat(F.lit("[" + inner), F.array_join(items, "," + inner), F.lit(outer + "]")))
    else:  # Spark writes structs and arrays only
        one = F.to_json(F.array(value))
        out = F.substr(one, F.lit(2), F.length(one) - 2)
    return F.when(value.isNull(), "null").otherwise(out)
