"""Rows of a query and of its SQL, in one comparable form."""

from pathlib import Path

import duckdb


def sql_rows(folder, sql):
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    cursor = connection.execute(sql)
    return normalized([d[0] for d in cursor.description], cursor.fetchall())


def spark_rows(frame):
    return normalized(frame.columns, [tuple(r) for r in frame.collect()])


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(repr(row[i]) for i in order) for row in rows)
