"""JSON records whose keys differ, read once into VARIANT: known keys typed, unknown ones kept, the schema found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARSED = "_parsed"
_FIELDS = "map<string, variant>"


def _fields(text: str) -> Column:
    """The top-level keys of a JSON object; NULL for text that is none."""
    return F.try_variant_get(F.try_parse_json(F.col(text)), "$", _FIELDS)


def _quoted(key: Column) -> Column:
    inside = F.to_json(F.array(key))
    return inside.substr(F.lit(2), F.length(inside) - 2)


def ragged_records(df: DataFrame, text: str, schema: T.StructType, *, rest: str = "rest", bad: str = "bad_json") -> DataFrame:
    """``df`` with the JSON objects of ``text`` as columns.

    A key of ``schema`` that a record lacks is NULL, and so is a value that its type cannot hold; ``rest`` has
    the other keys as JSON, NULL if there are none, sorted by key. ``bad`` has the text of a record that is no
    JSON object. Each text is parsed once.
    """
    found = df.withColumn(_PARSED, _fields(text))
    others = F.map_filter(_PARSED, lambda k, v: ~k.isin([f.name for f in schema.fields]))
    spelled = F.transform(F.array_sort(F.map_keys(others)), lambda k: F.concat(_quoted(k), F.lit(":"), F.to_json(F.element_at(others, k))))
    left = F.when(F.size(F.map_keys(others)) > 0, F.concat(F.lit("{"), F.array_join(spelled, ","), F.lit("}")))
    typed = [
        F.try_variant_get(F.try_element_at(_PARSED, F.lit(f.name)), "$", f.dataType.simpleString()).alias(f.name) for f in schema.fields
    ]
    kept = [c for c in df.columns if c != text]
    unread = F.when(F.col(_PARSED).isNull(), F.col(text))
    return found.select(*kept, *typed, left.alias(rest), unread.alias(bad))


def found_fields(df: DataFrame, text: str) -> DataFrame:
    """One row per top-level key and type that occurs: ``(field, type, n)``. Combined before it moves."""
    each = df.select(F.explode(_fields(text)).alias("field", "_value"))
    return each.groupBy("field", F.schema_of_variant("_value").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def ragged_schema(df: DataFrame, text: str) -> DataFrame:
    """One row ``(schema, n_records, n_bad)``: the type that holds every record, from one aggregate."""
    parsed = F.try_parse_json(F.col(text))
    return df.agg(
        F.schema_of_variant_agg(parsed).alias("schema"),
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(parsed.isNull() & F.col(text).isNotNull()).alias("n_bad"),
    )
