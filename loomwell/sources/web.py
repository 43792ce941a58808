"""Web search as a supplement: off unless a provider is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From a query to its results (title, url, snippet), best first.
Provider = Callable[[str], list[tuple[str, str, str]]]
RESULTS = "query string, pos int, title string, url string, snippet string"


def web_results(queries: DataFrame, provider: Provider | None = None, most: int = 5) -> DataFrame:
    """Results of the distinct queries (query), from tasks; none without a provider, and none for a query whose call fails."""
    if provider is None:
        return queries.sparkSession.createDataFrame([], RESULTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for q in pdf["query"]:
                try:
                    found = provider(q)
                except OSError:  # the network; a supplement never fails a search
                    continue
                rows += [(q, k, *r) for k, r in enumerate(found[:most])]
            yield pd.DataFrame(rows, columns=["query", "pos", "title", "url", "snippet"])

    return queries.select("query").filter(F.trim("query") != "").distinct().mapInPandas(run, RESULTS)
