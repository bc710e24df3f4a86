"""JSON texts as a prompt shows them: indented by four blanks, all ASCII, slashes escaped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, StringType, StructType

#: Escapes of single characters (fixed values).
ESCAPES = {'"': '\\"', "\\": "\\\\", "/": "\\/", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def quoted(c: Column) -> Column:
    """A text as a JSON string; what is beyond ASCII as code units."""
    known = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])

    def shown(x: Column) -> Column:
        code = F.ascii(x)
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
        beyond = F.when(code < 0x10000, _unit(code)).otherwise(F.concat(_unit(high), _unit(low)))
        return F.coalesce(F.try_element_at(known, x), F.when((x != "") & ((code < 32) | (code > 127)), beyond).otherwise(x))

    return F.concat(F.lit('"'), F.array_join(F.transform(F.split(c, ""), shown), ""), F.lit('"'))


def pretty(c: Column, kind: DataType, level: int = 0) -> Column:
    """A value of a known type as an indented JSON text. Nulls are shown, empty lists are ``[]``, whole numbers have no fraction."""
    here, inner = "    " * level, "    " * (level + 1)
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(f'{inner}"{f.name}": '), pretty(c[f.name], f.dataType, level + 1)) for f in kind.fields]
        out = F.concat(F.lit("{\n"), F.concat_ws(",\n", *fields), F.lit(f"\n{here}}}"))
    elif isinstance(kind, ArrayType):
        items = F.transform(c, lambda x: F.concat(F.lit(inner), pretty(x, kind.elementType, level + 1)))
        out = F.when(F.size(c) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit(f"\n{here}]")))
    elif isinstance(kind, StringType):
        out = quoted(c)
    elif isinstance(kind, (DoubleType, FloatType)):
        out = F.regexp_replace(c.cast("string"), r"\.0$", "")
    elif isinstance(kind, BooleanType):
        out = F.when(c, "true").otherwise("false")
    else:
        out = c.cast("string")
    return F.when(c.isNull(), "null").otherwise(out)
