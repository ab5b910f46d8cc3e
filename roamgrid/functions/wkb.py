"""Points as well-known binary with a reference system, longitude first, as column expressions.

Byte order little-endian; the type's flag says that the system's number follows. A double's 64 bits are put together
from its sign, exponent and mantissa: all steps are exact, as they only scale by powers of two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Little-endian, point with a system's number (WGS 84)
_HEAD = "01" + "01000020" + "E6100000"
_BIAS, _MANTISSA = 1023, 52


def _turned(digits: Column) -> Column:
    """Eight bytes as 16 hexadecimal digits, last byte first."""
    return F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(8)))


def _bits(x: Column) -> Column:
    """The bits of a double as a long."""
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    # the logarithm may be off by one next to a power of two
    power = F.when(size >= F.pow(F.lit(2.0), guess + 1), guess + 1).when(size < F.pow(F.lit(2.0), guess), guess - 1).otherwise(guess)
    rest = (size / F.pow(F.lit(2.0), power) - 1) * F.lit(float(1 << _MANTISSA))
    bits = F.shiftleft((power + _BIAS).cast("long"), _MANTISSA) + rest.cast("long")
    negative = x.cast("string").startswith("-")  # of zero too
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(bits).bitwiseOR(F.when(negative, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long")))


def _double(digits: Column) -> Column:
    """16 hexadecimal digits, last byte first, as a double."""
    plain = _turned(digits)
    high, low = (F.conv(F.substring(plain, at, 8), 16, 10).cast("long") for at in (1, 9))
    power = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF)) - _BIAS
    mantissa = high.bitwiseAND(F.lit(0xFFFFF)).cast("double") * F.lit(float(1 << 32)) + low.cast("double")
    size = (1 + mantissa / F.lit(float(1 << _MANTISSA))) * F.pow(F.lit(2.0), power)
    size = F.when(power == -_BIAS, F.lit(0.0)).otherwise(size)
    return F.when(high >= F.lit(1 << 31), -size).otherwise(size)


def point(lat: Column, lng: Column) -> Column:
    """Binary of a point; null where a coordinate is null, not a number or infinite."""
    sound = lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng) & (F.abs(lat) < 1e300) & (F.abs(lng) < 1e300)
    digits = lambda x: _turned(F.lpad(F.hex(_bits(x)), 16, "0"))
    return F.when(sound, F.unhex(F.concat(F.lit(_HEAD), digits(lng), digits(lat))))


def latitude(binary: Column) -> Column:
    return F.when(F.substring(F.hex(binary), 1, 18) == _HEAD, _double(F.substring(F.hex(binary), 35, 16)))


def longitude(binary: Column) -> Column:
    return F.when(F.substring(F.hex(binary), 1, 18) == _HEAD, _double(F.substring(F.hex(binary), 19, 16)))
