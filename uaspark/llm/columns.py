"""Column names that can't clash with the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(taken: list[str], name: str, ending: str = "_") -> str:
    """``name``, lengthened until no column in ``taken`` has it (case aside)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += ending
    return name


def apart(columns: list[str], *results: str) -> list[str]:
    """``columns`` with those that bear the name of a result renamed: ``_in`` is
    appended until the name is free."""
    wanted = {r.lower() for r in results}
    names = list(columns)
    for i, name in enumerate(names):
        if name.lower() in wanted:
            names[i] = fresh([*names[:i], *names[i + 1:], *results], f"{name}_in", "_in")
    return names


def set_apart(df: DataFrame, *results: str) -> DataFrame:
    """``df`` with clashing columns renamed (``apart``), so the caller's values stay."""
    names = apart(df.columns, *results)
    return df.toDF(*names) if names != df.columns else df


def renamed(df: DataFrame, column: str, *results: str) -> tuple[DataFrame, str]:
    """``set_apart``, and the name that ``column`` has then."""
    out = set_apart(df, *results)
    return out, out.columns[[c.lower() for c in df.columns].index(column.lower())]


def only_given(out: DataFrame, given: DataFrame) -> DataFrame:
    """Of an operator's result, the columns that it was given, under the names they had."""
    return out.select(*out.columns[:len(given.columns)]).toDF(*given.columns)


class Neutral:
    """A table whose columns are called ``c0``, ``c1`` ... while an operator adds its own."""

    def __init__(self, df: DataFrame):
        self.columns = df.columns
        self.names = [f"c{i}" for i in range(len(df.columns))]
        self.df = df.toDF(*self.names)

    def __getitem__(self, column: str) -> str:
        """The present name of a column."""
        return self.names[[c.lower() for c in self.columns].index(column.lower())]

    def shown(self, df: DataFrame, *results: str) -> DataFrame:
        """The columns under their own names (``apart``), and the results."""
        return df.select(*self.names, *results).toDF(*apart(self.columns, *results), *results)
