"""Coded values of passports and components: five lists of values, the payload of a component, and points as bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

#: The values each coded field can have.
CODES: dict[str, tuple[str, ...]] = {
    "material": (
        "natural_stone", "lime_mortar", "concrete", "terrazzo", "cement_mortar", "aerated_concrete", "lightweight_clinker_concrete", "plaster", "brick", "glazed_tile", "metal_general", "iron", "steel",
        "stainless_steel", "aluminum", "copper", "zinc", "lead", "construction_wood", "wood_unclassified", "precious_wood", "laminated_wood", "veneer", "wood_fibers", "wood_fiber_boards", "wood_shavings",
        "chipboards", "paper", "corrugated_cardboard", "impregnated_cardboard", "wood_concrete_cement_fibers", "mineral_wool", "asphalt", "fibers", "lining_paper", "linoleum", "rubber", "plastic",
        "foam_plastic", "glass", "natural_filling_aggregate", "painting_supplies", "other"),
    "tristate": ("yes", "no", "unknown"),
    "emission_quantity": ("exact", "minimum", "maximum", "interval"),
    "substance_content": ("assumed", "measured_surface", "measured_material"),
    "transaction": ("document", "property"),
}
#: Kinds of components, and what the payload of each holds.
COMPONENTS = {"window": {"style": "string", "pane_count": "int", "operable": "boolean"}, "door": {"style": "string", "swing": "string"}, "wall": {}}
PAYLOAD = "component_type string, style string, pane_count int, operable boolean, swing string"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def code(text: str | Column, kind: str) -> Column:
    """The text if it is a value of that list, else null; blanks and case count."""
    return F.when(_c(text).isin(*CODES[kind]), _c(text))


def code_number(text: str | Column, kind: str) -> Column:
    """The position of a value in its list, from 0; null for other texts."""
    return F.nullif(F.array_position(F.array(*map(F.lit, CODES[kind])), _c(text)) - 1, F.lit(-1)).cast("int")


def component_payload(kind: str | Column, **fields: Column) -> Column:
    """The JSON payload of a component: its kind as `component_type` and the fields that kind has; others are left out, and so are nulls."""
    out = None
    for name, has in COMPONENTS.items():
        one = F.to_json(F.struct(F.lit(name).alias("component_type"), *(fields[f].cast(t).alias(f) for f, t in has.items() if f in fields)))
        out = F.when(_c(kind) == name, one) if out is None else out.when(_c(kind) == name, one)
    return out


def read_payload(text: str | Column, kind: str | Column | None = None) -> Column:
    """The payload as a struct (columns of PAYLOAD). The kind in the payload wins over `kind`; fields the kind doesn't have are null. Null for
    an empty text, for one that is no JSON, and for an unknown kind."""
    p = F.from_json(F.nullif(F.trim(_c(text)), F.lit("")), PAYLOAD)
    of = F.coalesce(p["component_type"], _c(kind)) if kind is not None else p["component_type"]
    has = lambda f: of.isin([k for k, v in COMPONENTS.items() if f in v])
    names = [x.split()[0] for x in PAYLOAD.split(", ")][1:]
    return F.when(of.isin(list(COMPONENTS)) & F.try_parse_json(_c(text)).isNotNull(), F.struct(of.alias("component_type"), *(F.when(has(f), p[f]).alias(f) for f in names)))


@F.pandas_udf(BinaryType())
def pack_doubles(values: pd.Series) -> pd.Series:
    """Arrays of doubles as little-endian bytes."""
    return values.map(lambda v: None if v is None else np.asarray(v, "<f8").tobytes())


@F.pandas_udf(ArrayType(DoubleType()))
def unpack_doubles(data: pd.Series) -> pd.Series:
    """The doubles in bytes; null where the length is no multiple of eight."""
    return data.map(lambda b: None if b is None or len(b) % 8 else np.frombuffer(b, "<f8"))


def points_of(values: str | Column) -> Column:
    """Points (array of structs x, y, z) of a column of doubles; null where their number is no multiple of three."""
    v = _c(values)
    at = lambda i: F.struct(*(F.get(v, i * 3 + k).alias(a) for k, a in enumerate("xyz")))
    n = (F.size(v) / 3).cast("int")
    none = F.array().cast("array<struct<x:double,y:double,z:double>>")
    return F.when(F.size(v) == 0, none).when((F.size(v) > 0) & (F.size(v) % 3 == 0), F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), at))
