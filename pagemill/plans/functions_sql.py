"""Functions for SQL: registered under fixed names on a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagemill.functions import css, dom, text, urls


def register(spark: SparkSession) -> None:
    """html_text, html_readable, html_markdown, css_select, url_normalize and url_resolve for SQL; Arrow-batched."""

    def strings(fn):
        return lambda s: s.map(lambda x: None if x is None else fn(x))

    body = lambda h: (lambda r: r.first("body") or r)(dom.parse(h))

    @F.pandas_udf("string")
    def html_text(s: pd.Series) -> pd.Series:
        return strings(lambda h: text.fragment_text(body(h)))(s)

    @F.pandas_udf("string")
    def html_readable(s: pd.Series) -> pd.Series:
        return strings(lambda h: text.readable(dom.parse(h))["text"])(s)

    @F.pandas_udf("string")
    def html_markdown(s: pd.Series) -> pd.Series:
        return strings(lambda h: text.markdown(body(h)))(s)

    @F.pandas_udf("array<string>")
    def css_select(s: pd.Series, selector: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else [n.clean() for n in css.select(dom.parse(h), q)] for h, q in zip(s, selector)])

    @F.pandas_udf("string")
    def url_normalize(s: pd.Series) -> pd.Series:
        return strings(urls.normalise)(s)

    @F.pandas_udf("string")
    def url_resolve(s: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([urls.resolve(a, b) or None for a, b in zip(s, base)])

    for f in (html_text, html_readable, html_markdown, css_select, url_normalize, url_resolve):
        spark.udf.register(f.__name__, f)
