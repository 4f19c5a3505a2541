"""Overlap resolution: greedy interval packing by priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nubla.functions.regex import clusters_sql

# Which kinds come first.
PRIORITY = "case when s.type = 'UBICACION' then 3 when s.type = 'IDENTIFICADOR' or s.subtype = 'familiar' then 2 when s.type = 'SOSPECHOSO' or s.subtype = 'profesional' then 1 else 0 end"


def resolve_sql(candidates: str) -> str:
    """SQL of the disjoint spans of the SQL array ``candidates`` by start: the best by priority, confidence and length come
    first, then the rules' order.

    Only spans that overlap, or are linked by such that do, can stand in each other's way, so each such group is packed by
    itself: near linear in the note's spans, as these groups are small.
    """
    valid = f"filter({candidates}, s -> s.start >= 0 and s.`end` > s.start)"
    key = f"named_struct('priority', -({PRIORITY}), 'confidence', -s.confidence, 'size', s.start - s.`end`, 'rule', s.rule, 'start', s.start, 'span', s)"
    ranked = f"transform(array_sort(transform(group, s -> {key})), k -> k.span)"
    free = "not exists(kept, k -> k.start < s.`end` and s.start < k.`end`)"
    packed = f"array_sort(aggregate({ranked}, filter(group, s -> false), (kept, s) -> if({free}, concat(kept, array(s)), kept)))"
    return f"flatten(transform({clusters_sql(valid)}, group -> if(size(group) > 1, {packed}, group)))"


def resolve(candidates: str) -> Column:
    """``resolve_sql`` of the column ``candidates``."""
    return F.expr(resolve_sql(f"`{candidates}`"))
