"""Query specifications: what a query may ask, how it is checked, and the plan and envelope it becomes."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from .coverage import Coverage


class QueryError(ValueError):
    """An answer can't be given; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Parameter:
    """One argument: the predicate it stands for and how it is checked.

    ``shape`` changes the rows that all predicates left, before they are sorted, as "latest of each" does.
    """

    predicate: Callable[[Any], Column]
    kind: type = str
    choices: tuple = ()
    least: float | None = None
    most: float | None = None
    point: bool = False
    shape: Callable[[DataFrame, Any], DataFrame] | None = None

    def checked(self, name: str, value: Any) -> Any:
        if self.kind is bool and isinstance(value, str):
            value = {"true": True, "false": False}.get(value.lower(), value)
        wanted = (int, float) if self.kind is float else self.kind
        if not isinstance(value, wanted) or (self.kind is not bool and isinstance(value, bool)):
            raise QueryError("INVALID_ARGUMENT", f"{name} must be {self.kind.__name__}")
        if self.choices and value not in self.choices:
            raise QueryError("INVALID_ARGUMENT", f"{name} must be one of {', '.join(map(str, self.choices))}")
        if (self.least is not None and value < self.least) or (self.most is not None and value > self.most):
            raise QueryError("INVALID_ARGUMENT", f"{name} is out of range")
        return value


@dataclass(frozen=True)
class Spec:
    """A table's query: parameters, sort fields and the date its window binds to.

    ``date`` is the column of ``since`` and ``until``; None binds them to the sort field, which must then be a date; without
    ``dated`` there is no window.  ``ascending`` is the default order.  ``complete`` adds the arguments that depend on others.
    ``gap`` says whether a request falls into a known gap, ``shallow`` what to say with every answer of a shallow table, and
    ``since`` and ``until`` name all window ends of a request.  ``notes`` says what else a request's answer can't tell.
    """

    table: str
    key: str
    parameters: Mapping[str, Parameter]
    sorts: Mapping[str, str]
    default_sort: str
    date: str | None = None
    numeric_sorts: frozenset[str] = frozenset()
    derive: Callable[[DataFrame], DataFrame] = lambda df: df
    default_limit: int = 50
    max_limit: int = 500
    dated: bool = True
    ascending: bool = False
    complete: Callable[[Mapping[str, Any]], Mapping[str, Any]] = dict
    gap: Callable[[Mapping[str, Any]], str | None] = lambda arguments: None
    shallow: str | None = None
    since: tuple[str, ...] = ("since",)
    until: tuple[str, ...] = ("until",)
    notes: Callable[[Mapping[str, Any], Coverage | None], list[str | None]] = lambda arguments, held: []


@dataclass
class Result:
    """Rows of a page, lazily, and what goes with them."""

    rows: DataFrame
    has_more: Column
    warnings: list[str] = field(default_factory=list)


RESERVED = {"since", "until", "sort_by", "sort_order", "limit"}


def plan(spec: Spec, source: DataFrame, arguments: Mapping[str, Any]) -> tuple[DataFrame, int]:
    """The page of ``limit + 1`` rows that an argument list asks for, numbered from 1, and the limit.

    All given predicates hold together, on derived columns too, before the limit; a point lookup ignores the rest.
    """
    arguments = spec.complete(arguments)
    unknown = set(arguments) - set(spec.parameters) - (RESERVED if spec.dated else RESERVED - {"since", "until"})
    if unknown:
        raise QueryError("UNKNOWN_PARAMETER", ", ".join(sorted(unknown)))
    limit = arguments.get("limit", spec.default_limit)
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= spec.max_limit:
        raise QueryError("INVALID_ARGUMENT", f"limit must be 1 to {spec.max_limit}")
    given = {k: spec.parameters[k].checked(k, v) for k, v in arguments.items() if k in spec.parameters and v is not None}
    rows = spec.derive(source)
    for name, value in given.items():
        if spec.parameters[name].point:
            return rows.where(spec.parameters[name].predicate(value)).limit(1).withColumn("rn", F.lit(1).cast("long")), limit
    sort_by = arguments.get("sort_by", spec.default_sort)
    if sort_by not in spec.sorts:
        raise QueryError("INVALID_ARGUMENT", f"sort_by must be one of {', '.join(spec.sorts)}")
    since, until = arguments.get("since"), arguments.get("until")
    if (since or until) and spec.date is None and sort_by in spec.numeric_sorts:
        raise QueryError("INVALID_QUERY", f"a date window can't be combined with sorting by {sort_by}")
    column = F.col(spec.date or spec.sorts[sort_by])
    for value, test in ((since, column.__ge__), (until, column.__le__)):
        if value:
            rows = rows.where(test(F.lit(value)))
    for name, value in given.items():
        if spec.parameters[name].shape is None:
            rows = rows.where(spec.parameters[name].predicate(value))
    for name, value in given.items():
        if spec.parameters[name].shape is not None:
            rows = spec.parameters[name].shape(rows, value)
    direction = arguments.get("sort_order", "asc" if spec.ascending else "desc")
    if direction not in ("asc", "desc"):
        raise QueryError("INVALID_ARGUMENT", "sort_order must be asc or desc")
    ascending = direction == "asc"
    sort = F.col(spec.sorts[sort_by])
    order = [sort.asc_nulls_last() if ascending else sort.desc_nulls_last(), F.asc(spec.key)]
    return R.top(rows, order, limit + 1), limit


def run(spec: Spec, source: DataFrame, arguments: Mapping[str, Any]) -> tuple[DataFrame, bool]:
    """The page's rows and whether there are more, at the edge where an answer is given."""
    page, limit = plan(spec, source, arguments)
    return page.where(F.col("rn") <= limit), bool(page.where(F.col("rn") > limit).limit(1).count())
