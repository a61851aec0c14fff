"""Interchange of small tables with SQLite files, on the driver."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_nested(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, since a SQLite cell holds no others."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema))


def decode_nested(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The reverse, into the types of ``schema``."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    as_type = lambda f: F.from_json(F.col(f"`{f.name}`"), f.dataType) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast(f.dataType)
    return df.select(*(as_type(f).alias(f.name) for f in schema))


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def save_tables(path: str, tables: Mapping[str, DataFrame], *, if_exists: str = "replace", chunk_rows: int = 2048, max_rows: int = 5_000_000) -> None:
    """Write all tables in one transaction; rows stream through the driver in chunks.

    All pass through the driver into one file, so a table of more than ``max_rows`` rows
    is refused, and nothing is written; Parquet is the format for those.

    ``if_exists`` is 'replace', 'append' or 'fail'. Nested columns are written as JSON.
    """
    if if_exists not in ("replace", "append", "fail"):
        raise ValueError("if_exists must be 'replace', 'append' or 'fail'")
    con = sqlite3.connect(path, isolation_level=None)
    try:
        _write(con, tables, if_exists, chunk_rows, max_rows)
    finally:
        con.close()


def to_bytes(tables: Mapping[str, DataFrame], *, chunk_rows: int = 2048, max_rows: int = 1_000_000) -> bytes:
    """The content of a SQLite file with all tables, made in memory; readers take it in place of a path."""
    con = sqlite3.connect(":memory:", isolation_level=None)
    try:
        _write(con, tables, "replace", chunk_rows, max_rows)
        return con.serialize()
    finally:
        con.close()


def _open(source: str | bytes) -> sqlite3.Connection:
    if isinstance(source, str):
        return sqlite3.connect(source)
    con = sqlite3.connect(":memory:")
    con.deserialize(source)
    return con


def _write(con: sqlite3.Connection, tables: Mapping[str, DataFrame], if_exists: str, chunk_rows: int, max_rows: int) -> None:
    con.execute("begin")
    try:
        for name, df in tables.items():
            plain = encode_nested(df)
            exists = con.execute("select 1 from sqlite_master where type = 'table' and name = ?", [name]).fetchone()
            if exists and if_exists == "fail":
                raise ValueError(f"table {name} exists")
            if exists and if_exists == "replace":
                con.execute(f"drop table {_name(name)}")
            if not exists or if_exists == "replace":
                con.execute(f"create table {_name(name)} ({', '.join(f'{_name(f.name)} {_affinity(f.dataType)}' for f in plain.schema)})")
            marks = ", ".join("?" * len(plain.columns))
            written = 0
            for chunk in _chunks(plain, chunk_rows):
                written += len(chunk)
                if written > max_rows:
                    raise ValueError(f"table {name} has more than {max_rows} rows")
                con.executemany(f"insert into {_name(name)} values ({marks})", chunk)
        con.execute("commit")
    except BaseException:
        con.execute("rollback")
        raise


def _affinity(kind: T.DataType) -> str:
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "INTEGER"
    return "REAL" if isinstance(kind, (T.DoubleType, T.FloatType)) else "BLOB" if isinstance(kind, T.BinaryType) else "TEXT"


def _chunks(df: DataFrame, size: int) -> Iterator[list[tuple]]:
    chunk: list[tuple] = []
    for row in df.toLocalIterator():
        chunk.append(tuple(int(x) if isinstance(x, bool) else x if x is None or isinstance(x, (int, float, str, bytes)) else bytes(x) if isinstance(x, bytearray) else str(x) for x in row))
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def list_tables(path: str | bytes, *, system: bool = False) -> list[str]:
    con = _open(path)
    try:
        names = [r[0] for r in con.execute("select name from sqlite_master where type = 'table' order by name")]
    finally:
        con.close()
    return [n for n in names if system or not n.startswith("sqlite_")]


def load_table(spark: SparkSession, path: str | bytes, name: str, schema: T.StructType, *, max_rows: int = 5_000_000) -> DataFrame:
    """A table of a SQLite file; JSON cells become the nested types of ``schema``. One of more than ``max_rows`` rows, which the driver would hold, is refused."""
    con = _open(path)
    try:
        rows = con.execute(f"select {', '.join(_name(f.name) for f in schema)} from {_name(name)}").fetchmany(max_rows + 1)
    finally:
        con.close()
    if len(rows) > max_rows:
        raise ValueError(f"table {name} has more than {max_rows} rows")
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, nested) else T.LongType() if isinstance(f.dataType, (T.IntegralType, T.BooleanType)) else T.DoubleType() if isinstance(f.dataType, T.FractionalType) else T.BinaryType() if isinstance(f.dataType, T.BinaryType) else T.StringType()) for f in schema])
    return decode_nested(spark.createDataFrame(rows, flat), schema)
