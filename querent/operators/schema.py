"""Operators over schema catalogs.

A catalog row carries a whole database as parallel arrays, so columns, keys and
the rendered text are computed inside the row: none of them needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layout of the rendered schema text.
DATABASE_LINE = "Database: "
TABLES_HEADING = "\n\nTables and Columns:\n"
FOREIGN_KEYS_HEADING = "\nForeign Keys:\n"
PRIMARY_KEYS_HEADING = "\nPrimary Keys:\n"
ITEM_INDENT = "  - "

_TABLES, _COLUMNS, _TYPES = "table_names_original", "column_names_original", "column_types"


def list_databases(catalog: DataFrame) -> DataFrame:
    return catalog.select("db_id").distinct()


def missing_databases(catalog: DataFrame, db_ids: DataFrame) -> DataFrame:
    """The distinct ids that are not in the catalog."""
    return db_ids.select("db_id").distinct().join(catalog.select("db_id"), "db_id", "left_anti")


def require_databases(catalog: DataFrame, db_ids: DataFrame) -> None:
    """Raise if an id is not in the catalog.

    The message tells how many and names the first; ``missing_databases`` has all.
    """
    unknown = missing_databases(catalog, db_ids)
    n = unknown.count()
    if n:
        first = [row.db_id for row in unknown.orderBy("db_id").limit(20).collect()]
        raise ValueError(f"{n} databases not found in the catalog, among them {first}")


def schema_of(catalog: DataFrame, db_ids: DataFrame) -> DataFrame:
    """Catalog rows of the given ids; an unknown id is an error."""
    require_databases(catalog, db_ids)
    return catalog.join(db_ids.select("db_id").distinct(), "db_id", "left_semi")


def _table_idx(column: Column) -> Column:
    return F.get(column, F.lit(0)).cast("int")


def _or_error(value: Column, what: str, *where: Column) -> Column:
    """The value; where it is null, an error naming the database and the place."""
    parts = [F.coalesce(part.cast("string"), F.lit("null")) for part in where]
    message = F.concat(F.lit("database "), F.coalesce("db_id", F.lit("null")), F.lit(f": {what} "), *parts)
    return F.coalesce(value, F.raise_error(message).cast("string"))


def _table_of(column: Column) -> Column:
    """The table's name; null for the column that belongs to no table (index -1)."""
    at = _table_idx(column)
    return F.when(at == -1, F.lit(None).cast("string")).otherwise(
        _or_error(F.get(_TABLES, at), "no table of index", at)
    )


def _name_of(column: Column) -> Column:
    return _or_error(F.get(column, F.lit(1)), "a column without name")


def _at(position: Column) -> Column:
    """The column at a position of a key, which must exist and belong to a table."""
    found = F.get(_COLUMNS, position)
    checked = _or_error(F.get(found, F.lit(1)), "a key names no column of index", position)
    return F.when(checked.isNotNull(), found)


def flatten_columns(catalog: DataFrame) -> DataFrame:
    """``(db_id, col_idx, table_idx, table, column, type)``; ``*`` belongs to no table."""
    described = F.transform(
        F.arrays_zip(F.col(_COLUMNS).alias("c"), F.col(_TYPES).alias("t")),
        lambda z: F.struct(
            _table_idx(z["c"]).alias("table_idx"),
            _table_of(z["c"]).alias("table"),
            _name_of(z["c"]).alias("column"),
            z["t"].alias("type"),
        ),
    )
    flat = catalog.select("db_id", described.alias("described"))
    exploded = flat.select("db_id", F.posexplode("described").alias("col_idx", "d"))
    return exploded.select("db_id", "col_idx", "d.*").filter("table_idx >= 0")


def resolve_foreign_keys(catalog: DataFrame) -> DataFrame:
    """``(db_id, fk_ord, from_table, from_column, to_table, to_column)``."""

    def ends(key: Column) -> Column:
        source, target = _at(F.get(key, F.lit(0))), _at(F.get(key, F.lit(1)))
        return F.struct(
            _table_of(source).alias("from_table"),
            _name_of(source).alias("from_column"),
            _table_of(target).alias("to_table"),
            _name_of(target).alias("to_column"),
        )

    keys = catalog.select("db_id", F.transform("foreign_keys", ends).alias("keys"))
    return keys.select("db_id", F.posexplode("keys").alias("fk_ord", "k")).select(
        "db_id", "fk_ord", "k.*"
    )


def resolve_primary_keys(catalog: DataFrame) -> DataFrame:
    """``(db_id, pk_ord, table, column)``."""
    keys = catalog.select(
        "db_id",
        F.transform(
            "primary_keys",
            lambda i: F.struct(_table_of(_at(i)).alias("table"), _name_of(_at(i)).alias("column")),
        ).alias("keys"),
    )
    return keys.select("db_id", F.posexplode("keys").alias("pk_ord", "k")).select(
        "db_id", "pk_ord", "k.*"
    )


def _lines(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "")


def _section(heading: str, items: Column, line) -> Column:
    """Heading and lines, or nothing for an absent or empty list."""
    text = F.concat(F.lit(heading), _lines(items, line))
    return F.when(F.size(items) > 0, text).otherwise(F.lit(""))


def _qualified(column: Column) -> Column:
    return F.concat(_or_error(_table_of(column), "a key of no table"), F.lit("."), _name_of(column))


def render_schema_text(catalog: DataFrame) -> DataFrame:
    """``(db_id, schema_text)``: tables with typed columns, then the keys."""
    typed = F.arrays_zip(F.col(_COLUMNS).alias("c"), F.col(_TYPES).alias("t"))

    def table_block(table: Column, table_idx: Column) -> Column:
        own = F.filter(typed, lambda z: _table_idx(z["c"]) == table_idx)
        column_line = lambda z: F.concat(
            F.lit(ITEM_INDENT), _name_of(z["c"]), F.lit(" ("), _or_error(z["t"], "no type of column ", _name_of(z["c"])), F.lit(")\n")
        )
        name = _or_error(table, "a table without name")
        return F.concat(F.lit("\n"), name, F.lit(":\n"), _lines(own, column_line))

    foreign_keys = _section(
        FOREIGN_KEYS_HEADING,
        F.col("foreign_keys"),
        lambda key: F.concat(
            F.lit(ITEM_INDENT),
            _qualified(_at(F.get(key, F.lit(0)))),
            F.lit(" -> "),
            _qualified(_at(F.get(key, F.lit(1)))),
            F.lit("\n"),
        ),
    )
    primary_keys = _section(
        PRIMARY_KEYS_HEADING,
        F.col("primary_keys"),
        lambda i: F.concat(F.lit(ITEM_INDENT), _qualified(_at(i)), F.lit("\n")),
    )
    text = F.concat(
        F.lit(DATABASE_LINE),
        F.col("db_id"),
        F.lit(TABLES_HEADING),
        F.array_join(F.transform(_TABLES, table_block), ""),
        foreign_keys,
        primary_keys,
    )
    return catalog.select("db_id", text.alias("schema_text"))
