"""Rows of a DataFrame and of a DuckDB query, in one form."""

from __future__ import annotations

import json


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(columns: list[str], values: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(json.dumps([plain(r[i]) for i in order], default=str) for r in values)


def same(df, con, sql: str) -> None:
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())
