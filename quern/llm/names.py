"""Column names that a frame doesn't have yet."""

from pyspark.sql import DataFrame


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores in front as it takes to be new (case doesn't tell names apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
