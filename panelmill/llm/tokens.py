"""Token counts with the whole-token shortcut."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add ``out``: the number of tokens of each whole text, as the tokenizers library counts them.

    Vocabulary strings that encode alone as one token are proven once per process; a pre-token among them counts one
    without merging, and only the rest is merged. Row-local, no shuffle. A null or empty text has no tokens; repeated
    rows are counted alike; other columns pass through, and ``out`` replaces a column of that name.
    """

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        count = bpe.counter(path)
        return pd.Series([count(t) for t in texts], dtype="int64")

    return docs.withColumn(out, counted(F.col(f"`{text}`")))
