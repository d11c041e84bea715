"""Numbers as text and text as numbers, by SQLite's rules rather than IEEE's.

The steps of text_to_real are those of SQLite 3.50's public-domain conversion, since
results must agree to the last bit: the leading digits as 64 bits, then products of
double-doubles with fixed powers of ten.
"""

from __future__ import annotations

import math
import re
import struct

from tessera.types import INT_MAX, INT_MIN

#: The six characters that may stand around a number in text.
BLANKS = " \t\n\x0b\x0c\r"
_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
PREFIX = re.compile(rf"[{BLANKS}]*({_NUMBER})")
WHOLE = re.compile(rf"[{BLANKS}]*({_NUMBER})[{BLANKS}]*\Z")
DIGITS = re.compile(r"[+-]?[0-9]+\Z")
_PARTS = re.compile(r"([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?\Z")

_U64 = (1 << 64) - 1
#: Powers of ten as a double and the rest that the double lacks.
_POWERS = {
    100: (1.0e100, -1.5902891109759918046e83),
    10: (1.0e10, 0.0),
    1: (1.0e1, 0.0),
    -100: (1.0e-100, -1.99918998026028836196e-117),
    -10: (1.0e-10, -3.6432197315497741579e-27),
    -1: (1.0e-1, -5.5511151231257827021e-18),
}


def _high(x: float) -> float:
    """A double without its 26 lowest bits."""
    (bits,) = struct.unpack("<Q", struct.pack("<d", x))
    return struct.unpack("<d", struct.pack("<Q", bits & 0xFFFFFFFFFC000000))[0]


def _times(x: tuple[float, float], y: tuple[float, float]) -> tuple[float, float]:
    """A product of two numbers that are each a sum of two doubles."""
    a, b = _high(x[0]), _high(y[0])
    rest_a, rest_b = x[0] - a, y[0] - b
    exact, cross = a * b, a * rest_b + rest_a * b
    top = exact + cross
    low = exact - top + cross + rest_a * rest_b
    low = x[0] * y[1] + x[1] * y[0] + low
    total = top + low
    return total, top - total + low


def text_to_real(text: str) -> float:
    """A numeral as a double: 64 bits of its leading digits, scaled in double-double steps."""
    sign, whole, fraction, exponent = _PARTS.match(text).groups()
    digits, power, full = 0, 0, (_U64 - 9) // 10
    for c in whole:
        if digits >= full:
            power += 1
        else:
            digits = digits * 10 + int(c)
    for c in fraction or "":
        if digits < full:
            digits, power = digits * 10 + int(c), power - 1
    if exponent:
        power += max(-10000, min(10000, int(exponent)))
    if digits == 0:
        return -0.0 if sign == "-" else 0.0
    while power > 0 and digits < (_U64 - 0x7FF) // 10:
        digits, power = digits * 10, power - 1
    while power < 0 and digits % 10 == 0:
        digits, power = digits // 10, power + 1
    if power == 0:
        out = float(digits)
    else:
        near = float(digits)
        pair = (near, float(digits - min(int(near), _U64)))
        for step in (100, 10, 1):
            while abs(power) >= step:
                signed = step if power > 0 else -step
                pair, power = _times(pair, _POWERS[signed]), power - signed
        out = pair[0] + pair[1]
        out = math.inf if math.isnan(out) else out
    return -out if sign == "-" else out


def numeral(text: str) -> int | float:
    """A numeral without blanks: an integer if it is digits that fit 64 bits, else a double."""
    if DIGITS.match(text) and INT_MIN <= int(text) <= INT_MAX:
        return int(text)
    return text_to_real(text)


def integer_literal(text: str) -> int | float:
    value = int(text)
    return value if value <= INT_MAX else text_to_real(text)


def prefix_number(text: str) -> int | float:
    """The number that a text begins with, or 0."""
    m = PREFIX.match(text)
    return numeral(m[1]) if m else 0


def whole_number(text: str) -> int | float | None:
    """The number that a text is, or None."""
    m = WHOLE.match(text)
    return numeral(m[1]) if m else None


def leading_integer(text: str) -> int:
    """The digits that a text begins with, as % reads them: clamped to 64 bits, 0 if there are none."""
    m = re.match(rf"[{BLANKS}]*([+-]?[0-9]+)", text)
    return max(INT_MIN, min(INT_MAX, int(m[1]))) if m else 0


def real_to_text(x: float) -> str:
    """At most 15 significant digits, always with a point."""
    if math.isinf(x):
        return "Inf" if x > 0 else "-Inf"
    text = format(x + 0.0 if x else 0.0, ".15g")
    mantissa, mark, exponent = text.partition("e")
    return (mantissa if "." in mantissa else mantissa + ".0") + mark + exponent
