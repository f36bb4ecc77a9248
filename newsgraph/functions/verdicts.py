"""Parsing of landed model replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsgraph.functions import maps


def parse_significance(reply: Column) -> Column:
    """Struct: impact, breadth, novelty (1..10); null for an unusable reply.

    The whole reply is tried as JSON, then its first braced part.  A value over ten means the
    reply is on a scale of 100.
    """
    schema = "impact string, breadth string, novelty string"
    whole = F.from_json(F.trim(reply), schema)
    inner = F.from_json(F.regexp_extract(reply, r"(\{[^}]+\})", 1), schema)
    usable = whole["impact"].isNotNull() | whole["breadth"].isNotNull() | whole["novelty"].isNotNull()

    def number(text: Column) -> Column:
        return F.coalesce(text.try_cast("int"), text.try_cast("double").cast("int"))

    def scale(v: Column) -> Column:
        parts = [number(v[n]) for n in ("impact", "breadth", "novelty")]
        wide = F.greatest(*parts) > 10
        fit = lambda x: F.greatest(
            F.lit(1), F.least(F.lit(10), F.when(wide, F.bround(x / 10.0, 0).cast("int")).otherwise(x))
        )
        known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
        return F.when(
            known, F.struct(*[fit(p).alias(n) for p, n in zip(parts, ("impact", "breadth", "novelty"))])
        )

    return maps.let(F.when(usable, whole).otherwise(inner), scale)
