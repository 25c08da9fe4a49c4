"""Walks over nested types: rewriting every text at any depth, dropping fields at any depth, and telling two values apart.

The type is walked when the query is built, and what comes out is one expression of built-in functions, whatever the depth.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIFFERENCE = "array<struct<path: string, code: string>>"


def _touched(kind: T.DataType, drop: Collection[str]) -> bool:
    if isinstance(kind, T.StructType):
        return any(f.name in drop or _touched(f.dataType, drop) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _touched(kind.elementType, drop)
    if isinstance(kind, T.MapType):
        return _touched(kind.valueType, drop)
    return isinstance(kind, T.StringType)


def rewritten(value: Column, kind: T.DataType, text: Callable[[Column], Column], drop: Collection[str] = ()) -> Column:
    """*value* with *text* applied to every string in it and without the fields named in *drop*, wherever they are; keys of maps
    stay.  Nulls stay nulls."""
    if not _touched(kind, drop):
        return value
    if isinstance(kind, T.StructType):
        parts = [rewritten(value[f.name], f.dataType, text, drop).alias(f.name) for f in kind if f.name not in drop]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rewritten(x, kind.elementType, text, drop))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: rewritten(x, kind.valueType, text, drop))
    return text(value)


def differences(seed: Column, draft: Column, kind: T.DataType, path: Column | str = "", keys: Collection[str] = ()) -> Column:
    """array<struct<path, code>>: where *draft* departs from *seed*, both of the type *kind*.

    Codes: missing (a field that the seed has is null), unexpected (one that the seed lacks), changed; removed and added for
    entries of maps and of arrays whose elements are structs with a field in *keys*, which are held together by that key (of
    equal keys the first).  Other arrays are compared whole, in order.  Nulls equal nulls.
    """
    at = F.lit(path) if isinstance(path, str) else path
    none = F.array().cast(DIFFERENCE)
    one = lambda code, where=at: F.array(F.struct(where.alias("path"), F.lit(code).alias("code")))
    inner = lambda name: F.when(at == "", F.lit(name)).otherwise(F.concat(at, F.lit("."), F.lit(name)))
    entry = lambda k: F.concat(at, F.lit("["), k.cast("string"), F.lit("]"))

    def entries(old: Column, new: Column, old_keys: Column, new_keys: Column, find: Callable[[Column, Column], Column], of: T.DataType) -> Column:
        def each(k: Column) -> Column:
            a, b = find(old, k), find(new, k)
            return F.when(~F.array_contains(new_keys, k), one("removed", entry(k))).when(~F.array_contains(old_keys, k), one("added", entry(k))).otherwise(differences(a, b, of, entry(k), keys))

        return F.flatten(F.transform(F.array_union(old_keys, new_keys), each))

    if isinstance(kind, T.StructType):
        parts = [differences(seed[f.name], draft[f.name], f.dataType, inner(f.name), keys) for f in kind]
        deep = F.concat(*parts) if parts else none
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and (key := next((f.name for f in kind.elementType if f.name in keys), None)):
        ids = lambda c: F.array_distinct(F.transform(c, lambda x: F.coalesce(x[key].cast("string"), F.lit("null"))))
        find = lambda c, k: F.try_element_at(F.filter(c, lambda x: F.coalesce(x[key].cast("string"), F.lit("null")) == k), F.lit(1))
        deep = entries(seed, draft, ids(seed), ids(draft), find, kind.elementType)
    elif isinstance(kind, T.MapType):
        find = lambda c, k: F.try_element_at(c, k)
        deep = entries(seed, draft, F.map_keys(seed), F.map_keys(draft), find, kind.valueType)
    else:
        deep = F.when(seed == draft, none).otherwise(one("changed"))
    return F.when(seed.isNull() & draft.isNull(), none).when(draft.isNull(), one("missing")).when(seed.isNull(), one("unexpected")).otherwise(F.coalesce(deep, none))
