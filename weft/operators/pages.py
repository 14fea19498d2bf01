"""Pages of a table in a total order, without sorting what lies before the page.

A page after a known row is a range of the order (`page_after`).  A page by its number is found by ranges: a few
keys of the table cut it into ranges, the rows of each are counted, and the range that holds the page is cut again until
it is small.  Each step is one pass with a count for each range; only the last range is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a range that is put in order, and keys that cut a range.
SORTED_ROWS, CUTS = 200_000, 64


def _beyond(df: DataFrame, order: list[str], row: tuple, inclusive: bool) -> Column:
    """Whether a row's key is greater than (or equal to) `row`, nulls first; its first column alone is a condition too, which files can be skipped by."""
    fields = [F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, row)]
    key, other = F.struct(*[F.col(c) for c in order]), F.struct(*fields)
    exact = key >= other if inclusive else key > other
    return exact if row[0] is None else exact & (F.col(order[0]) >= F.lit(row[0]))


def _below(df: DataFrame, order: list[str], row: tuple) -> Column:
    fields = [F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, row)]
    exact = F.struct(*[F.col(c) for c in order]) < F.struct(*fields)
    return exact if row[0] is None else exact & (F.col(order[0]).isNull() | (F.col(order[0]) <= F.lit(row[0])))


def page_after(df: DataFrame, order: list[str], last: tuple | None = None, limit: int = 20) -> DataFrame:
    """The `limit` rows that follow the row with the key `last` in the order of the columns `order` (all ascending, nulls first); the first ones without it."""
    rows = df if last is None else df.where(_beyond(df, order, last, inclusive=False))
    return rows.orderBy(*order).limit(min(100, max(1, limit)))


def range_of_page(df: DataFrame, order: list[str], start: int, stop: int, total: int) -> tuple[DataFrame, int]:
    """(rows of a range that holds places `start` to `stop` - 1, rows before it); `order` must be total."""
    before, size = 0, total
    while size > SORTED_ROWS:
        some = df.select(*order).orderBy(F.xxhash64(*order)).limit(CUTS).distinct().orderBy(*order).collect()  # CUTS rows at most
        cuts = [tuple(r) for r in some]
        fields = F.array(*[F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, cut)]) for cut in cuts])
        key = F.struct(*[F.col(c) for c in order])
        counts = dict(df.groupBy(F.size(F.filter(fields, lambda cut: cut <= key)).alias("range")).count().collect())
        first = last = None
        upto = before
        for n in range(len(cuts) + 1):
            begin, upto = upto, upto + counts.get(n, 0)
            if first is None and upto > start:
                first, ahead = n, begin
            if last is None and upto >= stop:
                last, behind = n, upto
        if first is None:  # beyond the last row
            return df.limit(0), before
        last, behind = (len(cuts), upto) if last is None else (last, behind)
        if behind - ahead >= size:
            break
        if first > 0:
            df = df.where(_beyond(df, order, cuts[first - 1], inclusive=True))
        if last < len(cuts):
            df = df.where(_below(df, order, cuts[last]))
        before, size = ahead, behind - ahead
    return df, before


def page_of(df: DataFrame, order: list[str], page: int = 1, limit: int = 20) -> tuple[DataFrame, dict]:
    """Rows of one page in a total order, and total, total_pages, has_next; page is at least 1, limit from 1 to 100."""
    page, limit = max(1, page), min(100, max(1, limit))
    total = df.count()
    pages = -(-total // limit)
    start = (page - 1) * limit
    rows, before = range_of_page(df, order, start, min(start + limit, total), total)
    return rows.orderBy(*order).offset(start - before).limit(limit), {"page": page, "limit": limit, "total": total, "total_pages": pages, "has_next": page < pages}
