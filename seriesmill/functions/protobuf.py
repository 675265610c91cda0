"""Protocol Buffers' wire format as column expressions: no Python and no descriptors at run time.

Messages are binary columns: fields are concatenated, a sub-message is length-delimited.
Fields at their default are left out, as writers of proto3 do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VARINT, _FIXED64, _DELIMITED = 0, 1, 2


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal_varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append((n & 127) | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _tag(field: int, kind: int) -> Column:
    return F.lit(bytearray(_literal_varint(field << 3 | kind)))


def none() -> Column:
    return F.lit(bytearray())


def varint(v: Column) -> Column:
    """Seven bits a byte, lowest first; a negative bigint has ten bytes, as two's complement."""

    def groups(x: Column) -> Column:
        last = F.floor((F.length(F.bin(x)) - 1) / 7).cast("int")
        byte = lambda i: F.call_function("shiftrightunsigned", x, i * 7).bitwiseAND(F.lit(127)) + F.when(i < last, 128).otherwise(0)
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))

    return _let(v.cast("bigint"), lambda x: F.when((x >= 0) & (x < 128), F.unhex(F.lpad(F.hex(x), 2, "0"))).otherwise(groups(x)))


def zigzag(v: Column) -> Column:
    """Signed numbers as unsigned ones, small for small: 0, -1, 1, -2..."""
    return F.when(v < 0, -2 * v.cast("bigint") - 1).otherwise(2 * v.cast("bigint"))


def fixed64(v: Column) -> Column:
    """Eight bytes of a bigint, lowest first; negative ones in two's complement."""
    return _let(F.lpad(F.hex(v.cast("bigint")), 16, "0"), lambda h: F.unhex(F.concat(*[F.substring(h, F.lit(i), F.lit(2)) for i in range(15, 0, -2)])))


def double_bits(v: Column) -> Column:
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v.cast("double")).cast("bigint")


def joined(parts: Column) -> Column:
    """The bytes of an array of binaries one after the other."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), ""))


# Fields


def message(field: int, body: Column) -> Column:
    """A sub-message, string or bytes; an empty sub-message is written too."""
    return _let(body.cast("binary"), lambda b: F.concat(_tag(field, _DELIMITED), varint(F.octet_length(b)), b))


def text(field: int, value: Column) -> Column:
    """A string or bytes; nothing if it is empty or null."""
    return F.when(F.octet_length(value) > 0, message(field, value)).otherwise(none())


def unsigned(field: int, value: Column) -> Column:
    """A varint; nothing if it is 0 or null."""
    return F.when(value != 0, F.concat(_tag(field, _VARINT), varint(value))).otherwise(none())


def fixed(field: int, value: Column) -> Column:
    """A fixed64 or sfixed64; nothing if it is 0 or null."""
    return F.when(value != 0, F.concat(_tag(field, _FIXED64), fixed64(value))).otherwise(none())


def double(field: int, value: Column) -> Column:
    """An optional double, 0 written too; nothing if it is null."""
    return F.when(value.isNotNull(), F.concat(_tag(field, _FIXED64), fixed64(double_bits(value)))).otherwise(none())


def oneof_fixed(field: int, value: Column) -> Column:
    """A member of a oneof: written at 0, too."""
    return F.concat(_tag(field, _FIXED64), fixed64(value))


def repeated(field: int, bodies: Column) -> Column:
    """A sub-message for each element of an array."""
    return joined(F.transform(bodies, lambda b: message(field, b)))


def packed(field: int, values: Column, encode) -> Column:
    """Numbers without tags between them; nothing if there are none."""
    return F.when(F.size(values) > 0, message(field, joined(F.transform(values, encode)))).otherwise(none())
