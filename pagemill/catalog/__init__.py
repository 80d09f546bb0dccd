"""Named queries over the tables of a folder, with their SQL counterparts."""

from pagemill.catalog import crawl, data_flow, literal, pages, streams

MODULES = [data_flow, crawl, pages, literal, streams]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.SQL)
    return out
