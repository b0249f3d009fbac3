"""Rows of two frames, compared as the driver does: by column name, in any order."""

import math
from decimal import Decimal


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if type(v).__name__ in ("NaTType", "NAType"):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float, Decimal)) or hasattr(v, "dtype"):
        return f"{float(v):.6f}"
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))
