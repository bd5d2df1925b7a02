"""Short forms of wallets and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import UNKNOWN_LABEL


def _ends(col: Column, head: int, tail: int) -> Column:
    return F.concat(F.left(col, F.lit(head)), F.lit("..."), F.right(col, F.lit(tail)))


def short_wallet(col: Column) -> Column:
    """First and last four characters; short wallets as they are, none as "?"."""
    return (F.when(F.coalesce(F.length(col), F.lit(0)) == 0, F.lit(UNKNOWN_LABEL))
            .when(F.length(col) < 8, col)
            .otherwise(_ends(col, 4, 4)))


def short_token(col: Column, longer_than: int = 12) -> Column:
    """First six and last four characters of a token id above the given length."""
    return F.when(F.length(col) > longer_than, _ends(col, 6, 4)).otherwise(col)
