"""Values of no fixed shape: JSON text read once into variants, kept in shredded columns, and read by paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.scratch import kept


def with_variant(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with a JSON text column as a variant; null where the text is no JSON, which `name`_error tells."""
    value = F.try_parse_json(F.col(text))
    return rows.withColumns({name: value, f"{name}_error": F.col(text).isNotNull() & value.isNull()})


def shredded(rows: DataFrame, what: str) -> DataFrame:
    """rows written once: what values mostly have in common lies in columns of its own, so that a path is read without the rest."""
    return kept(rows, what)


def at(value: Column, path: str, kind: str) -> Column:
    """What stands at a path ($.a[0].b) as a type; null where nothing does, or what can't be one."""
    return F.try_variant_get(value, path, kind)


def fields(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
    """by, field and type, and in how many rows the variant has it at its top; shapes are found, not declared."""
    each = rows.select(*by, F.from_json(F.to_json(F.col(name)), "map<string,string>").alias("_m"), name).select(*by, F.explode(F.map_keys("_m")).alias("field"), name)
    kind = F.schema_of_variant(F.expr(f"try_variant_get({name}, concat('$[\\'', replace(field, '\\'', ''), '\\']'), 'variant')"))
    return each.select(*by, "field", kind.alias("type")).groupBy(*by, "field", "type").agg(F.count("*").alias("n"))
