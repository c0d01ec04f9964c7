"""A filter of fixed size for keys, to spare a shuffle of rows that a join would drop anyway."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 16 MB at any size of the data. When it fills up it lets more rows pass, never fewer.
FILTER_BITS = 27


def maybe_in(df: DataFrame, keys: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that may be among ``keys`` by ``columns``, and the rows that surely are not.

    The bits are gathered by an aggregate; at most one number per 32 bits reaches the driver. A join has to decide
    about the rows that may be in.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS))
    bits = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits")
    ).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    table[bits["word"].to_numpy(dtype=np.int64)] = bits["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def known(s: pd.Series) -> pd.Series:
        at = s.to_numpy(dtype=np.int64)
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0)

    return df.filter(known(slot)), df.filter(~known(slot))
