"""What an operator lowers to: a DataFrame plus what its columns mean.

Every DataFrame carries EVAL, the evaluation date that a row belongs to, so that one Spark plan serves all
dates at once. With a lookback an evaluation date sees rows of several sessions; operators that stay within
a session work on rows that are there once (own_day), and only then is each row copied to the evaluation dates
that see it. From there on each grouping, window and join has EVAL among its keys.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from quantloom.plans.graph import BAR, DAY

EVAL = "__eval"


@dataclass(frozen=True)
class Field:
    """A column's meaning. components are the columns an arithmetic field was made of; path has
    the (frequency, auction) steps it was aggregated through; hidden columns are the engine's."""

    operator: str = "identity"
    components: tuple[str, ...] = ()
    recompute: bool = False
    source: str | None = None
    lookback: int = 1
    path: tuple[tuple[str, str], ...] = ()

    def plain(self) -> Field:
        return replace(self, operator="identity", components=(), recompute=False)


@dataclass(frozen=True)
class Frame:
    """A DataFrame with its identity keys and a Field for each column, in column order. With own_day = n
    each row is there once, EVAL repeats its date, and the copies for a lookback of n are still due (none for 1);
    with 0 they have been made."""

    df: DataFrame
    keys: tuple[str, ...]
    fields: dict[str, Field]
    own_day: int = 0

    def __post_init__(self) -> None:
        if self.df.columns != [EVAL, *self.fields]:
            object.__setattr__(self, "df", self.df.select(EVAL, *self.fields))

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.fields)

    @property
    def values(self) -> tuple[str, ...]:
        return tuple(c for c in self.fields if c not in self.keys and not c.startswith("__"))

    @property
    def hidden(self) -> tuple[str, ...]:
        return tuple(c for c in self.fields if c.startswith("__"))

    def value(self, what: str = "this operator") -> str:
        if len(self.values) != 1:
            raise ValueError(f"{what} needs exactly one public value column, found {list(self.values)}")
        return self.values[0]

    @property
    def grain(self) -> str:
        if self.keys == DAY:
            return "daily"
        if set(BAR) <= set(self.keys):
            return "minute" if self.keys == BAR and any(self.fields[v].path for v in self.values) else "raw"
        return "unknown"

    @property
    def collectable(self) -> bool:
        return self.keys == DAY and len(self.values) == 1

    def origin(self) -> Field:
        """Source, lookback and path that a field made from this frame inherits."""
        return merged([self.fields[c] for c in (self.values or [c for c in self.fields if not c.startswith("__")])])


def merged(fields: list[Field]) -> Field:
    """What fields have in common: the source and path if they agree, and the longest lookback."""
    lookback = max((f.lookback for f in fields), default=1)
    where = {(f.source, f.path) for f in fields}
    source, path = where.pop() if len(where) == 1 else (None, ())
    return Field(source=source, lookback=lookback, path=path if source is not None else ())


def union_keys(*groups: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(k for g in groups for k in g))


def join_keys(left: tuple[str, ...], right: tuple[str, ...], on: tuple[str, ...] | None, how: str) -> tuple[str, ...]:
    """Columns to join on: `on`, or the shared keys. They must be keys on both sides and have all that
    both sides share, else rows would fan out unseen."""
    chosen = tuple(k for k in left if k in right) if on is None else tuple(on)
    if not chosen:
        raise ValueError(f"a {how} join needs a shared identity key")
    if bad := [k for k in chosen if k not in left or k not in right]:
        raise ValueError(f"a {how} join is on identity columns of both inputs; not so: {bad}")
    if left_out := [k for k in left if k in right and k not in chosen]:
        raise ValueError(f"a {how} join must include the shared identity columns {left_out}")
    return chosen
