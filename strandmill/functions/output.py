"""Results as JSON or as data notation, with short floats."""

from __future__ import annotations

import json
import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 4


def float32(x: float) -> float:
    """The nearest single-precision value; beyond the range, infinity."""
    try:
        return struct.unpack("f", struct.pack("f", x))[0]
    except OverflowError:
        return math.copysign(math.inf, x)


def short_float(x: float, digits: int = DIGITS) -> str:
    """A number with at most ``digits`` significant digits, plain or scientific, whichever is shorter.

    Whole numbers are written in full; a missing value is ``"NaN"``.
    """
    if x != x:
        return '"NaN"'
    if math.isinf(x):
        return '"Infinity"' if x > 0 else '"-Infinity"'
    if x == int(x):
        return str(int(x))
    mantissa, exp = f"{float32(x):.{digits - 1}e}".split("e")
    exp = int(exp)
    sign = "-" if mantissa[0] == "-" else ""
    ds = mantissa.lstrip("-").replace(".", "").rstrip("0") or "0"
    if exp < 0:
        plain = "0." + "0" * (-exp - 1) + ds
    elif exp + 1 >= len(ds):
        plain = ds + "0" * (exp + 1 - len(ds))
    else:
        plain = ds[: exp + 1] + "." + ds[exp + 1 :]
    sci = ds[0] + ("." + ds[1:] if len(ds) > 1 else "") + "e" + str(exp)
    return sign + (sci if len(sci) < len(plain) else plain)


def to_json(v) -> str:
    """A value of the engine as JSON text."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if isinstance(v, float):
        return short_float(v)
    if isinstance(v, str):
        return json.dumps(v)
    if isinstance(v, dict):
        return "{" + ",".join(json.dumps(str(getattr(k, "name", k))) + ":" + to_json(x) for k, x in v.items()) + "}"
    if hasattr(v, "name"):
        return json.dumps(v.name)
    if hasattr(v, "isoformat"):
        return json.dumps(v.isoformat())
    return "[" + ",".join(to_json(x) for x in v) + "]"


def to_edn(v) -> str:
    """A value of the engine in data notation."""
    if v is None:
        return "nil"
    if isinstance(v, (bool, int, float)):
        return {True: "true", False: "false"}[v] if isinstance(v, bool) else "NaN" if v != v else repr(v)
    if isinstance(v, str):
        return json.dumps(v)
    if isinstance(v, dict):
        return "{" + ", ".join(f"{to_edn(k)} {to_edn(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (set, frozenset)):
        return "#{" + " ".join(map(to_edn, v)) + "}"
    if hasattr(v, "name"):
        return f":{v.name}"
    return "[" + " ".join(map(to_edn, v)) + "]"


def respond(v, accept: str = "application/json") -> str:
    """The body of an answer in the format that is asked for."""
    return to_edn(v) if "edn" in accept else to_json(v)


def short_float_column(c: Column, digits: int = DIGITS) -> Column:
    """:func:`short_float` inside the JVM; NULL stays NULL."""
    f = c.cast("float").cast("double")
    sci = F.format_string(f"%.{digits - 1}e", f)
    parts = F.split(sci, "e")
    exp = parts[1].cast("int")
    sign = F.when(f < 0, "-").otherwise("")
    ds = F.regexp_replace(F.regexp_replace(parts[0], "[-.]", ""), "0+$", "")
    plain = (
        F.when(exp < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), ds))
        .when(exp + 1 >= F.length(ds), F.concat(ds, F.repeat(F.lit("0"), exp + 1 - F.length(ds))))
        .otherwise(F.concat(F.substring(ds, F.lit(1), exp + 1), F.lit("."), F.substring(ds, exp + 2, F.lit(400))))
    )
    short = F.concat(
        F.substring(ds, 1, 1), F.when(F.length(ds) > 1, F.concat(F.lit("."), F.substring(ds, 2, 400))).otherwise(""), F.lit("e"), exp.cast("string")
    )
    return (
        F.when(c.isNull(), None)
        .when(F.isnan(c), "NaN")
        .when(c == F.round(c, 0), F.format_string("%.0f", c.cast("double")))
        .otherwise(F.concat(sign, F.when(F.length(short) < F.length(plain), short).otherwise(plain)))
    )
