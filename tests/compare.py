"""Rows of two results, comparable whatever their order."""

import math


def plain(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False, name=None):
        row = []
        for x in r:
            if x is None or x != x or str(x) in ("<NA>", "NaT"):
                row.append("~")
            elif isinstance(x, bool) or type(x).__name__ == "bool_":
                row.append(str(bool(x)))
            elif isinstance(x, float):
                row.append("~" if math.isnan(x) else f"{x:.6f}")
            elif isinstance(x, int) or "int" in type(x).__name__:
                row.append(f"{float(x):.6f}")
            else:
                row.append(str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x))
        out.append(tuple(row))
    return sorted(out)
