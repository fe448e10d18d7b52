"""Six decimals on both sides. A hair is added first: sums end in exact halves often, and two engines may round those apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAIR = 1e-10


def six(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(HAIR), 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: six(n) for n in names})


def six_sql(sql: str) -> str:
    """The SQL with the hair added inside every round(..., 6)."""
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + 6 : k - 1]
        if inner.endswith(", 6"):
            out.append(f"{sql[i:j]}round(({six_sql(inner[:-3])}) + {HAIR:.10f}, 6)")
        else:
            out.append(f"{sql[i:j]}round({six_sql(inner)})")
        i = k
    return "".join(out) + sql[i:]
