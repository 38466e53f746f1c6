"""Results as plain values."""


def rows(df, *cols):
    """Collect selected columns as a sorted list of tuples."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
