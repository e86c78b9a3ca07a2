"""Registration of queries and the SQL building blocks of their equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ternweave.functions.codebook import BLOCK, POSITION_PREFIX, SET_ATOM
from ternweave.functions.session import checkpoint_dir
from ternweave.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its name, with its SQL equivalent."""
    def register(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavier than its scan: on all cores, however small its file is."""
    return spread(table(spark, sf_dir, name))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints (shared storage on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hex_text(vec: Column | str) -> Column:
    return F.lower(F.hex(vec))


# ---- SQL pieces ------------------------------------------------------------------------------

SET_SQL = f"chr({ord(SET_ATOM[0])}) || '{SET_ATOM[1:]}'"
POSITION_SQL = f"chr({ord(POSITION_PREFIX[0])}) || '{POSITION_PREFIX[1:]}'"


def codebook_sql(atoms: str, dims: int, name: str = "cb") -> str:
    """CTEs giving ``name(a, d, x)`` for the atoms ``SELECT ... AS a``."""
    return f"""
{name}_h AS (SELECT a, b, md5(a || '#' || b) AS h
             FROM (SELECT DISTINCT a FROM ({atoms}) q), range({dims // BLOCK}) t(b)),
{name}_w AS (SELECT a, b, i, CAST('0x' || substr(h, CAST(4 * i + 1 AS INT), 4) AS INT) AS w
             FROM {name}_h, range(8) u(i)),
{name} AS (SELECT a, CAST(b * {BLOCK} + i * 8 + j AS INT) AS d, CAST((w // p) % 3 - 1 AS INT) AS x
           FROM {name}_w, (SELECT j, CAST(pow(3, j) AS INT) AS p FROM range(8) v(j)))"""


def pairs_sql(source: str, key: str, columns, name: str = "kv") -> str:
    """CTE ``name(id, k, v)``: one row per field of a flat table."""
    rows = " UNION ALL ".join(
        f"SELECT {key} AS id, '{c}' AS k, coalesce(CAST({c} AS VARCHAR), 'nil') AS v FROM {source}" for c in columns)
    return f"{name} AS ({rows})"


def map_sql(name: str = "dv", pairs: str = "kv", book: str = "cb") -> str:
    """CTEs giving ``name(id, d, x)``: sign of the sum of key * value."""
    return f"""
{name}_p AS (SELECT p.k, p.v, c.d, c.x * e.x AS x FROM (SELECT DISTINCT k, v FROM {pairs}) p
             JOIN {book} c ON c.a = p.k JOIN {book} e ON e.a = p.v AND e.d = c.d),
{name} AS (SELECT id, d, CAST(sign(sum(x)) AS INT) AS x FROM {pairs} JOIN {name}_p USING (k, v) GROUP BY id, d)"""


def flat_map_sql(source: str, key: str, columns, dims: int, name: str = "dv", extra_atoms: str = "") -> str:
    atoms = "SELECT k AS a FROM kv UNION SELECT v FROM kv" + (f" UNION {extra_atoms}" if extra_atoms else "")
    return f"{pairs_sql(source, key, columns)}, {codebook_sql(atoms, dims)}, {map_sql(name)}"


HEX = "string_agg(CASE WHEN x > 0 THEN '01' WHEN x < 0 THEN 'ff' ELSE '00' END, '' ORDER BY d)"


def words_sql(text: str) -> str:
    """Normalised words of a text, as a list."""
    return (f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({text}), "
            f"'[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')")
