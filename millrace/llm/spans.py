"""Spans in texts as columns: array<struct<kind,start,end,score,base>>, code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_DDL = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def digest(spans: Column) -> Column:
    return F.sha2(listed(base(spans)).cast("binary"), 256)


def apart(found: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether start to end overlaps none of the sorted, disjoint spans found."""
    from bisect import bisect_left

    i = bisect_left(found, (start, start))
    return not (i < len(found) and found[i][0] < end or i and found[i - 1][1] > start)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
