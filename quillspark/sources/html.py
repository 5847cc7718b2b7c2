"""Text of HTML columns."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


HIDDEN = ("script", "style", "template")  # their content is no text


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.hidden += tag in HIDDEN

    def handle_endtag(self, tag) -> None:
        self.hidden -= tag in HIDDEN and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def text_of(html: str | None) -> str:
    """The character data of a page, in order, without scripts and style sheets; null gives the empty string."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.parts)


def html_text(df: DataFrame, column: str, to: str = "text") -> DataFrame:
    """Adds the text of an HTML column, batch by batch."""

    @F.pandas_udf("string")
    def strip(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(text_of)

    return df.withColumn(to, strip(F.col(column)))
