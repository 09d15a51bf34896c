"""What may leave for a model: categories by mode, and groups only if they are large enough."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabulens.types import TabulensError, col

#: Least group size, and rows of a result that are told at most.
K, MOST_ROWS = 5, 20
#: What each mode lets through: names and types, aggregates, grouped values, and single values.
CATEGORIES = ("schema", "aggregates", "groups", "values")
MODES = {"strict": {"schema", "aggregates"}, "balanced": {"schema", "aggregates", "groups"}, "full": set(CATEGORIES), "local": set()}


def suppressed(groups: DataFrame, size: str, keys: list[str], k: int = K, most: int = MOST_ROWS) -> DataFrame:
    """Groups of at least k rows, the first ones by key; small groups go with their key and measures, before the cut."""
    return groups.filter(col(size) >= k).orderBy(*[col(c).asc_nulls_last() for c in keys]).limit(most)


class Gate:
    def __init__(self, mode: str):
        if mode not in MODES:
            raise TabulensError(f"there is no privacy mode {mode!r}")
        self.allowed = MODES[mode]

    def allows(self, category: str) -> bool:
        return category in self.allowed

    def groups(self, rows: list[dict], size: str) -> tuple[list[dict], int]:
        """(rows that may be told, how many were held back)."""
        if not self.allows("groups"):
            return [], len(rows)
        large = [r for r in rows if r[size] >= K]
        return large[:MOST_ROWS], len(rows) - min(len(large), MOST_ROWS)

    def schema(self, columns: list[tuple[str, str]]) -> list[tuple[str, str]]:
        return columns if self.allows("schema") else []
