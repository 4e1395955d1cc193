"""Tagged values: graph properties and vector metadata whose type travels with the value.

A property is read through ``Prop``, over a tagged struct or over a plain typed column, so that graphs laid
over typed tables keep column pruning and pushdown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGGED = "struct<t:string,i:bigint,d:double,b:boolean,s:string,v:array<float>>"
PROPS = f"map<string,{TAGGED}>"
FIELDS = {"integer": "i", "real": "d", "boolean": "b", "string": "s", "vector": "v"}
SPARK_TYPES = {"integer": "bigint", "real": "double", "boolean": "boolean", "string": "string", "vector": "array<float>"}
NUMERIC = ("integer", "real", "boolean")


def tag_of(value) -> str:
    """The tag of a Python value; ValueError for what no property can hold."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise ValueError("an integer property has 64 bits at most")
        return "integer"
    if isinstance(value, float):
        return "real"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (list, tuple)) or type(value).__module__ == "numpy":
        if len(value) == 0:
            raise ValueError("a vector must not be empty")
        return "vector"
    raise ValueError(f"unsupported property value {value!r}")


def tagged(value) -> dict:
    """A Python value as the tagged struct's fields."""
    t = tag_of(value)
    out = dict.fromkeys(("t", "i", "d", "b", "s", "v")) | {"t": t}
    if t == "vector":
        out["v"] = [float(x) for x in value]
    elif t != "null":
        out[FIELDS[t]] = value
    return out


def untag(value):
    """A tagged struct (a Row or a dict) as a Python value."""
    if value is None or value["t"] == "null":
        return None
    return value[FIELDS[value["t"]]]


def as_tagged(column: Column, tag: str) -> Column:
    """A column of one type as tagged structs; nulls are explicit nulls."""
    fields = [F.when(column.isNull(), "null").otherwise(tag).alias("t")]
    for t, name in FIELDS.items():
        fields.append((column if t == tag else F.lit(None)).cast(SPARK_TYPES[t]).alias(name))
    return F.struct(*fields)


def literal(value) -> Column:
    """A literal tagged struct."""
    made = tagged(value)
    v = F.array(*(F.lit(x) for x in made["v"])).cast("array<float>") if made["v"] else F.lit(None).cast("array<float>")
    return F.struct(F.lit(made["t"]).alias("t"), F.lit(made["i"]).cast("bigint").alias("i"), F.lit(made["d"]).cast("double").alias("d"), F.lit(made["b"]).cast("boolean").alias("b"), F.lit(made["s"]).cast("string").alias("s"), v.alias("v"))


def _sure(column: Column) -> Column:
    """For tests that are negated. The others may be null: they stand in filters under AND and OR only, where null is false, and can so be pushed into scans."""
    return F.coalesce(column, F.lit(False))


@dataclass(frozen=True)
class Prop:
    """``tag`` is None over a tagged struct, else the type of a plain column, whose nulls are missing properties."""

    column: Column
    tag: str | None = None

    def of(self, tag: str) -> Column:
        """The value where it has the tag, else null."""
        if self.tag is None:
            return F.when(self.column["t"] == tag, self.column[FIELDS[tag]])
        return self.column if self.tag == tag else F.lit(None).cast(SPARK_TYPES[tag])

    def is_null(self) -> Column:
        return self.column.isNull() if self.tag else _sure(self.column["t"] == "null") | self.column.isNull()

    def is_explicit_null(self) -> Column:
        return F.lit(False) if self.tag else _sure(self.column["t"] == "null")

    def equals(self, value, coerced: bool = False) -> Column:
        """Type-strict by default; coerced compares integers, reals and booleans as numbers."""
        tag = tag_of(value)
        if tag == "null":
            return self.is_explicit_null()
        if tag == "vector":
            raise ValueError("a vector can't be compared")
        if coerced and tag in NUMERIC:
            return self.compares("=", value)
        return self.of(tag) == F.lit(value)

    def compares(self, op: str, value) -> Column:
        """A numeric comparison; booleans count as 0 and 1. Integers are compared with integers exactly."""
        if tag_of(value) not in NUMERIC:
            raise ValueError(f"{op} needs a number or a boolean")
        value = int(value) if isinstance(value, bool) else value
        apply = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
        parts = []
        for tag in NUMERIC:
            if self.tag in (None, tag):
                own = self.of(tag)
                parts.append(apply(own.cast("int") if tag == "boolean" else own, F.lit(value)))
        if not parts:
            return F.lit(False)
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out

    def matches(self, op: str, needle) -> Column:
        """STARTS WITH, ENDS WITH and CONTAINS on strings, case-sensitive."""
        if not isinstance(needle, str):
            raise ValueError(f"{op} needs a string")
        s = self.of("string")
        return {"STARTS WITH": s.startswith, "ENDS WITH": s.endswith, "CONTAINS": s.contains}[op](needle)

    def sort_keys(self, desc: bool) -> list[Column]:
        """Ascending: missing and null, then strings, then numbers."""
        number = F.coalesce(self.of("real"), self.of("integer").cast("double"), self.of("boolean").cast("int").cast("double"))
        keys = [number, self.of("integer"), self.of("string")]
        if self.tag:
            keys = [self.of(self.tag).cast("int") if self.tag == "boolean" else self.of(self.tag)]
        return [k.desc_nulls_last() if desc else k.asc_nulls_first() for k in keys]
