"""Secret scans of whole texts with the combined automaton, and redaction."""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from laneflow.llm.automaton import BASE_RULES, MORE_RULES, Rule, Scanner, compile_rules
from laneflow.llm.common import small_batches

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

@cache
def _compiled(rules: tuple[Rule, ...]) -> Scanner:
    """One compilation per Python worker."""
    return compile_rules(rules)


def _spans(scanner: Scanner, text: str | None) -> list[tuple[int, int, int]]:
    """Matches in code points."""
    data = (text or "").encode()
    found = scanner.scan(data)
    if len(data) == len(text or "") or not found:
        return found
    points, at, place = {}, 0, 0
    for byte in sorted({x for start, end, _ in found for x in (start, end)}):
        at, place = at + len(data[place:byte].decode()), byte
        points[byte] = at
    return [(points[start], points[end], rule) for start, end, rule in found]


def secret_spans(text: Column, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> Column:
    """The secrets in a text: an array of (kind, start, end), in code points, end exclusive.

    Ordered by start, then by the order of the rules; the spans of different
    kinds may overlap.  Null and empty texts have none.  A text of any length is
    read once, byte by byte.
    """

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        scanner = _compiled(rules)
        return pa.array(
            [[{"kind": rules[r].kind, "start": s, "end": e} for s, e, r in _spans(scanner, t.as_py())] for t in texts], _SPANS
        )

    return scan(text)


def find_secrets(df: DataFrame, text: str = "text", name: str = "secrets", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """All columns of ``df`` and the array of secret spans; an existing column ``name`` is replaced."""
    small_batches(df.sparkSession)
    return df.withColumn(name, secret_spans(F.col(f"`{text}`"), rules))


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[{kind}]", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``df`` with every secret in ``text`` replaced by ``mark``; overlapping spans become one mark, of the first kind.

    Null texts stay null; texts without secrets stay as they are.
    """
    small_batches(df.sparkSession)

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        scanner, out = _compiled(rules), []
        for value in texts:
            whole = value.as_py()
            parts, free = [], 0
            for start, end, rule in _spans(scanner, whole):
                if start >= free:
                    parts += [whole[free:start], mark.format(kind=rules[rule].kind)]
                free = max(free, end)
            out.append("".join([*parts, whole[free:]]) if parts else whole)
        return pa.array(out, pa.string())

    return df.withColumn(text, redact(F.col(f"`{text}`")))
