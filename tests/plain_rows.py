"""Plain tuples of small results."""


def rows(df, *cols):
    """Sorted plain tuples of a small result."""
    got = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(got, key=lambda t: tuple((x is None, str(x)) for x in t))
