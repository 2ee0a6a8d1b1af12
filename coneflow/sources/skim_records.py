"""Analysed jets as skim records: names by level, flat columns by prefix, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructField, StructType

#: What stands for a missing number in flat columns.
FILL = -9999.0


def to_skim_records(jets: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """One struct per level under the skim's names, from the analysis' records (fixed names of both layouts).

    ``prefixes``: level of the analysis -> level of the skim. A leading track pt
    before subtraction, where a level has one, stands as the leading track pt.
    """
    out = []
    for level, name in prefixes.items():
        fields = {f.name for f in jets.schema[level].dataType}
        col = F.col(level)
        constituents = F.transform(col["constituents"], lambda c: F.struct(c["pt"].alias("pt"), c["eta"].alias("eta"), c["phi"].alias("phi"), c["index"].alias("id")))
        subjets = F.transform(
            col["reclustering"]["subjets"],
            lambda s: F.struct(s["part_of_iterative_splitting"].alias("part_of_iterative_splitting"), s["splitting_node_index"].alias("parent_splitting_index"), s["constituent_indices"].alias("constituent_indices")),
        )
        record = [col["pt"].alias("jet_pt"), constituents.alias("jet_constituents"), col["reclustering"]["jet_splittings"].alias("jet_splittings"), subjets.alias("subjets")]
        if "unsubtracted_leading_track_pt" in fields:
            record.append(col["unsubtracted_leading_track_pt"].alias("leading_track_pt"))
        out.append(F.when(col.isNotNull(), F.struct(*record)).alias(name))
    return jets.select(*[c for c in jets.columns if c not in prefixes], *out)


def _leaves(kind: DataType, path: tuple[str, ...], inside: bool = False):
    """(path, type) of every flat column of a type: structs are walked into, also inside one level of arrays."""
    if isinstance(kind, StructType):
        for f in kind:
            yield from _leaves(f.dataType, (*path, f.name), inside)
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and not inside:
        for p, k in _leaves(kind.elementType, path, True):
            yield p, ArrayType(k)
    else:
        yield path, kind


def flat_schema(schema: StructType, separator: str = "_") -> StructType:
    """Names and types of the flat columns of a nested schema; names that clash are an error."""
    fields = [StructField(separator.join(p), k) for p, k in _leaves(schema, ())]
    if len({f.name for f in fields}) < len(fields):
        raise ValueError(f"flat names clash: {sorted(f.name for f in fields)}")
    return StructType(fields)


def flattened(df: DataFrame, types: dict[str, str] | None = None, fill: float = FILL, separator: str = "_") -> DataFrame:
    """Every leaf of every struct as a column named by its path; arrays of structs become parallel arrays.

    Missing floating numbers become ``fill``; ``types`` casts leaves by the last part of their name.
    """
    flat_schema(df.schema, separator)
    out = []
    for path, kind in _leaves(df.schema, ()):
        col = F.col(".".join(f"`{p}`" for p in path))
        if (to := (types or {}).get(path[-1])) is not None:
            col = col.cast(f"array<{to}>" if isinstance(kind, ArrayType) else to)
        if isinstance(kind, (DoubleType, FloatType)):
            col = F.coalesce(col, F.lit(fill).cast((types or {}).get(path[-1]) or kind))
        out.append(col.alias(separator.join(path)))
    return df.select(*out)


def _gathered(kind: DataType, path: tuple[str, ...], fill: float, separator: str) -> tuple[Column, Column]:
    """A value of a type from flat columns, and whether any of its leaves is there."""
    if isinstance(kind, StructType):
        parts = [(f.name, *_gathered(f.dataType, (*path, f.name), fill, separator)) for f in kind]
        there = parts[0][2]
        for _, _, t in parts[1:]:
            there = there | t
        return F.when(there, F.struct(*[c.alias(n) for n, c, _ in parts])), there
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        leaves = list(_leaves(kind.elementType, path, True))
        lists = {".".join(p): F.col(separator.join(p)) for p, _ in leaves}
        zipped = F.arrays_zip(*[c.alias(f"c{k}") for k, c in enumerate(lists.values())])
        at = {p: k for k, p in enumerate(lists)}

        def one(x: Column, k: DataType, p: tuple[str, ...]) -> Column:
            if isinstance(k, StructType):
                return F.struct(*[one(x, f.dataType, (*p, f.name)).alias(f.name) for f in k])
            return x[f"c{at['.'.join(p)]}"].cast(k.simpleString())

        return F.transform(zipped, lambda x: one(x, kind.elementType, path)), next(iter(lists.values())).isNotNull()
    col = F.col(separator.join(path)).cast(kind.simpleString())  # by name: fields may be null
    if isinstance(kind, (DoubleType, FloatType)):
        col = F.when(col != F.lit(fill), col)
    return col, col.isNotNull()


def nested_again(df: DataFrame, schema: StructType, fill: float = FILL, separator: str = "_") -> DataFrame:
    """The inverse of ``flattened``: records of ``schema`` from flat columns. A record none of whose leaves is there is null."""
    return df.select(*[_gathered(f.dataType, (f.name,), fill, separator)[0].alias(f.name) for f in schema])
