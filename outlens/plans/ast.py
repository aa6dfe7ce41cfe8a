"""Syntax trees of the SQL dialect, with their SQL text."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any

    def sql(self) -> str:
        if self.value is None:
            return "NULL"
        if isinstance(self.value, str):
            return "'" + self.value.replace("'", "''") + "'"
        return str(self.value).upper() if isinstance(self.value, bool) else str(self.value)


@dataclass(frozen=True)
class Name:
    name: str

    def sql(self) -> str:
        return self.name


@dataclass(frozen=True)
class Call:
    function: str
    args: tuple

    def sql(self) -> str:
        return f"{self.function}({', '.join(a.sql() for a in self.args)})"


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any

    def sql(self) -> str:
        return f"({self.op} {self.of.sql()})"


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any

    def sql(self) -> str:
        return f"({self.left.sql()} {self.op} {self.right.sql()})"


@dataclass(frozen=True)
class Test:
    """IS NULL, BETWEEN, IN and LIKE, perhaps negated; a comparison with ALL or ANY of a query has its operator in ``kind``."""

    kind: str
    of: Any
    args: tuple = ()
    negated: bool = False

    def sql(self) -> str:
        no = "NOT " if self.negated else ""
        of, args = self.of.sql() if self.of is not None else "", [a.sql() for a in self.args]
        if self.kind == "NULL":
            return f"({of} IS {no}NULL)"
        if self.kind == "BETWEEN":
            return f"({of} {no}BETWEEN {args[0]} AND {args[1]})"
        if self.kind == "EXISTS":
            return f"({no}EXISTS ({args[0]}))"
        if self.kind.endswith((" ALL", " ANY")):
            return f"({of} {self.kind} ({args[0]}))"
        return f"({of} {no}IN ({', '.join(args)}))" if self.kind == "IN" else f"({of} {no}LIKE {args[0]})"


@dataclass(frozen=True)
class Item:
    """A select item; expr None is a star."""

    expr: Any = None
    alias: str | None = None

    def name(self) -> str:
        return self.alias or self.expr.sql()

    def sql(self) -> str:
        if self.expr is None:
            return "*"
        return self.expr.sql() + (f" AS {self.alias}" if self.alias else "")


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None

    def sql(self) -> str:
        return self.name + (f" {self.alias}" if self.alias else "")


@dataclass(frozen=True)
class Sub:
    query: Any
    alias: str | None = None

    def sql(self) -> str:
        return f"({self.query.sql()})" + (f" {self.alias}" if self.alias else "")


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any
    kind: str = "inner"
    using: tuple[str, ...] = ()
    natural: bool = False
    on: Any = None

    def sql(self) -> str:
        how = "NATURAL " if self.natural else ""
        how += "" if self.kind == "inner" else f"{self.kind.upper()} "
        tail = f" USING ({', '.join(self.using)})" if self.using else f" ON {self.on.sql()}" if self.on is not None else ""
        return f"{self.left.sql()} {how}JOIN {self.right.sql()}{tail}"


@dataclass(frozen=True)
class Split:
    relation: Any
    where: Any

    def sql(self) -> str:
        return f"(SPLIT {self.relation.sql()} WHERE {self.where.sql()})"


@dataclass(frozen=True)
class Diff:
    inputs: tuple
    on: tuple[str, ...] | str
    min_ratio: float = 1.5
    min_support: float = 0.2
    ratio: str = "global_ratio"
    max_combo: int = 3

    def sql(self) -> str:
        on = self.on if isinstance(self.on, str) else ", ".join(self.on)
        return f"DIFF {', '.join(i.sql() for i in self.inputs)} ON {on} WITH MIN RATIO {self.min_ratio} MIN SUPPORT {self.min_support} COMPARE BY {self.ratio}(COUNT(*)) MAX COMBO {self.max_combo}"


@dataclass(frozen=True)
class Sort:
    expr: Any
    descending: bool = False
    nulls: str | None = None

    def sql(self) -> str:
        return self.expr.sql() + (" DESC" if self.descending else "") + (f" NULLS {self.nulls}" if self.nulls else "")


@dataclass(frozen=True)
class Export:
    path: str
    field_by: str = ","
    line_by: str = "\n"


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...]
    source: Any
    where: Any = None
    order: tuple[Sort, ...] = ()
    limit: int | None = None
    distinct: bool = False
    export: Export | None = None

    def sql(self) -> str:
        out = f"SELECT {'DISTINCT ' if self.distinct else ''}{', '.join(i.sql() for i in self.items)}"
        out += f" FROM {self.source.sql()}" if self.source else ""
        out += f" WHERE {self.where.sql()}" if self.where is not None else ""
        out += f" ORDER BY {', '.join(s.sql() for s in self.order)}" if self.order else ""
        return out + (f" LIMIT {self.limit}" if self.limit is not None else "")


@dataclass(frozen=True)
class Import:
    path: str
    table: str
    columns: tuple[tuple[str, str], ...] = field(default=())

    def sql(self) -> str:
        cols = ", ".join(f"{n} {t}" for n, t in self.columns)
        return f"IMPORT FROM CSV FILE '{self.path}' INTO {self.table}" + (f"({cols})" if cols else "")
