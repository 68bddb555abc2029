"""What the corpus operators share: the library's storage, and names for columns of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..storage import Scratch, materialize, new_path, shared_dir, table

__all__ = ["Scratch", "materialize", "new_path", "shared_dir", "table", "unused"]


def unused(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have, in whatever case."""
    taken, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (name := f"own_{i}") not in taken:
            out.append(name)
        i += 1
    return out
