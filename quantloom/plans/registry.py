"""A registered query: a Spark plan over the views and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.views import SQL as VIEWS


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def __call__(self, spark, sf_dir: str) -> DataFrame:
        return shaped(self.fn(spark, sf_dir), self.columns)


def shaped(df: DataFrame, columns) -> DataFrame:
    """The named columns in comparable types: numbers rounded, dates and times as text, whole numbers long."""
    out = []
    for name, kind in columns:
        x = F.col(f"`{name}`")
        if kind[0] == "n":
            x = F.round(x.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
        elif kind == "d":
            x = F.date_format(x.cast("date"), "yyyy-MM-dd")
        elif kind == "t":
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "i":
            x = x.cast("long")
        out.append(x.alias(name))
    return df.select(*out)


def sql_of(columns, views, body: str) -> str:
    """The oracle: the views it names, the body, and the same shaping."""
    need, seen = list(views), []
    while need:
        v = need.pop()
        if v not in seen:
            seen.append(v)
            need += [w for w in VIEWS if w != v and w in VIEWS[v]]
    ordered = [v for v in VIEWS if v in seen]
    outs = []
    for name, kind in columns:
        q = f'"{name}"'
        x = {"n": f"round(cast({q} as double), {int(kind[1:] or 6) if kind[0] == 'n' else 0}) + 0.0", "d": f"strftime(cast({q} as date), '%Y-%m-%d')", "t": f"strftime({q}, '%Y-%m-%d %H:%M:%S.%f')", "i": f"cast({q} as bigint)", "s": q}[kind[0]]
        outs.append(f"{x} as {q}")
    body = body.strip()
    head = ", ".join(f"{v} as ({VIEWS[v]})" for v in ordered)
    if body.lower().startswith("with "):
        ctes, _, last = body[5:].rpartition("\n;\n")
        head = ", ".join(x for x in (head, ctes) if x)
        body = last
    return f"{'with ' + head if head else ''} select {', '.join(outs)} from ({body}) final_rows"


class Registry(dict):
    def add(self, name: str, columns: str, views=(), sql: str | None = None):
        """Decorator. columns: "name kind, ..." with kinds s text, i whole, n[digits] number, d date, t time."""
        cols = tuple(tuple(c.split()) for c in columns.split(","))

        def keep(fn):
            self[name] = Query(name, fn, cols, sql_of(cols, views, sql) if sql else None)
            return fn

        return keep
