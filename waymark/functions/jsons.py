"""Access to loosely shaped JSON text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Text, _c


def variant(x: Text) -> Column:
    """JSON text as a variant; null if it isn't JSON."""
    return F.try_parse_json(_c(x))


def record_or_empty(x: Text) -> Column:
    """The text if it's a JSON object, else {}."""
    v = variant(x)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), _c(x)).otherwise("{}")


def text_at(x: Text, path: str) -> Column:
    """The text at a path; null if something else stands there."""
    v = F.try_variant_get(variant(x), path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(variant(x), path, "string"))


def number_at(x: Text, path: str) -> Column:
    v = F.try_variant_get(variant(x), path, "variant")
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(variant(x), path, "double"))


def texts_at(x: Text, path: str) -> Column:
    """The texts of an array at a path; an empty array if there is none."""
    items = F.try_variant_get(variant(x), path, "array<variant>")
    texts = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(texts, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def has_any(x: Text, path: str, wanted: list[str]) -> Column:
    """Whether the array at a path holds any of the wanted texts."""
    return F.arrays_overlap(texts_at(x, path), F.array(*[F.lit(w) for w in wanted]))


def canonical_map(m: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


@F.pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON text with all keys sorted at every depth, no spaces; null if it isn't JSON."""

    def one(v):
        try:
            return None if v is None else json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return values.map(one)


def object_in(x: Text) -> Column:
    """The JSON object in fenced or noisy text: a fenced block, else from the first brace to the last."""
    fenced = F.regexp_extract(_c(x), r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    loose = F.regexp_extract(_c(x), r"(?s)\{.*\}", 0)
    pick = F.when(variant(fenced).isNotNull() & (fenced != ""), fenced).otherwise(loose)
    return F.when(variant(pick).isNotNull() & (pick != ""), pick)


def as_evidence(x: Text, path: str, confidence: float = 0.5) -> Column:
    """{value, confidence, source_text} of what stands at a path, be it such an object or a bare value."""
    v = F.try_variant_get(variant(x), path, "variant")
    get = lambda p, kind: F.try_variant_get(v, p, kind)
    nested = F.schema_of_variant(v).startswith("OBJECT")
    value = F.when(nested, get("$.value", "string")).otherwise(get("$", "string"))
    sure = F.coalesce(F.when(nested, get("$.confidence", "double")), F.lit(confidence))
    return F.struct(value.alias("value"), F.least(F.greatest(sure, F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.when(nested, get("$.sourceText", "string")).otherwise(value).alias("source_text"))


def as_array(x: Text, path: str) -> Column:
    """Texts at a path, a single text as an array of one."""
    one = text_at(x, path)
    return F.when(one.isNotNull(), F.array(one)).otherwise(texts_at(x, path))


def first_text(x: Text, name: str) -> Column:
    """The first text under a name in an object, or in an array of them."""
    many = F.filter(F.try_variant_get(variant(x), "$", "array<variant>"), lambda v: v.isNotNull())
    found = F.transform(many, lambda v: F.try_variant_get(v, f"$.{name}", "string"))
    return F.coalesce(text_at(x, f"$.{name}"), F.get(F.array_compact(found), F.lit(0)))
