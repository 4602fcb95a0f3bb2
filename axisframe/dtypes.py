"""The element types of arrays, their Spark types, promotion and casts.

Shape and element type of an array are kept on the driver; columns only hold
values.  Unsigned and half types are stored in the next wider Spark type that
holds their values, and brought back to their range after every operation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DType:
    name: str
    kind: str  # b, i, u, f or c
    bits: int
    spark: str

    @property
    def itemsize(self) -> int:
        return max(1, self.bits // 8)


_INTS = {"i": {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}, "u": {8: "smallint", 16: "int", 32: "bigint", 64: "decimal(20,0)"}}
DTYPES: dict[str, DType] = {"bool": DType("bool", "b", 1, "boolean")}
DTYPES |= {f"{'u' * (k == 'u')}int{n}": DType(f"{'u' * (k == 'u')}int{n}", k, n, t) for k, own in _INTS.items() for n, t in own.items()}
DTYPES |= {f"float{n}": DType(f"float{n}", "f", n, "double" if n == 64 else "float") for n in (16, 32, 64)}
DTYPES |= {f"complex{2 * n}": DType(f"complex{2 * n}", "c", 2 * n, f"struct<re:{t},im:{t}>") for n, t in ((32, "float"), (64, "double"))}
ALIASES = {"int": "int64", "float": "float64", "complex": "complex128", "double": "float64", "single": "float32", "half": "float16", "long": "int64", "intc": "int32", "short": "int16", "byte": "int8", "ubyte": "uint8", "ushort": "uint16", "uintc": "uint32", "ulong": "uint64", "csingle": "complex64", "cdouble": "complex128", "bool_": "bool"}


def dtype(x) -> DType:
    """The type of a name, a Python type or a DType."""
    if isinstance(x, DType):
        return x
    name = x if isinstance(x, str) else getattr(x, "__name__", str(x))
    name = ALIASES.get(name, name)
    if name not in DTYPES:
        raise TypeError(f"unknown element type {x!r}")
    return DTYPES[name]


def of_spark(t: str) -> DType:
    """The element type of a column of this Spark type."""
    names = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}
    if t.startswith("struct<re:"):
        return DTYPES["complex128" if "double" in t else "complex64"]
    if t not in names:
        raise TypeError(f"columns of type {t} aren't array elements")
    return DTYPES[names[t]]


def _holds(a: DType, b: DType) -> bool:
    """Whether every value of ``a`` is one of ``b`` (64-bit integers count as held by float64)."""
    if a == b or a.kind == "b":
        return True
    if b.kind == "b" or "biufc".index(a.kind) > "biufc".index(b.kind) and not (a.kind == "u" and b.kind == "i"):
        return False
    if a.kind in "iu":
        if b.kind in "iu":
            return (a.kind == b.kind and a.bits <= b.bits) or (a.kind == "u" and b.kind == "i" and a.bits < b.bits)
        digits = {16: 11, 32: 24, 64: 53}[b.bits if b.kind == "f" else b.bits // 2]
        return a.bits - (a.kind == "i") <= digits or digits == 53
    return a.bits <= (b.bits if b.kind == a.kind else b.bits // 2)


def promote(*types) -> DType:
    """The smallest type that holds all of them."""
    order = [DTYPES[x] for x in ("bool", "int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float16", "float32", "float64", "complex64", "complex128")]
    own = [dtype(t) for t in types]
    return next(t for t in order if all(_holds(x, t) for x in own))


def result_type(*operands) -> DType:
    """Promotion in which Python scalars only raise the kind, not the width."""
    strong = [dtype(x) for x in operands if isinstance(x, (str, DType, type))]
    weak = [x for x in operands if not isinstance(x, (str, DType, type))]
    base = promote(*strong) if strong else None
    for x in weak:
        kind = "b" if isinstance(x, bool) else "i" if isinstance(x, int) else "f" if isinstance(x, float) else "c"
        if base is None:
            base = DTYPES[{"b": "bool", "i": "int64", "f": "float64", "c": "complex128"}[kind]]
        elif kind == "i" and base.kind == "b":
            base = DTYPES["int64"]
        elif kind == "f" and base.kind in "biu":
            base = DTYPES["float64"]
        elif kind == "c" and base.kind != "c":
            base = DTYPES["complex64" if base.kind == "f" and base.bits < 64 else "complex128"]
    return base


def can_cast(a, b, casting: str = "safe") -> bool:
    a, b = dtype(a), dtype(b)
    if casting == "unsafe":
        return True
    if casting in ("no", "equiv"):
        return a == b
    if casting == "safe":
        return _holds(a, b)
    rank = {"b": 0, "u": 1, "i": 2, "f": 3, "c": 4}
    return _holds(a, b) or rank[a.kind] <= rank[b.kind]


def wider_sum(t: DType) -> DType:
    """The type in which sums and products of ``t`` are kept."""
    return DTYPES["int64"] if t.kind in "bi" else DTYPES["uint64"] if t.kind == "u" else t


def limits(t) -> tuple[int, int]:
    t = dtype(t)
    return (0, (1 << t.bits) - 1) if t.kind == "u" else (0, 1) if t.kind == "b" else (-(1 << (t.bits - 1)), (1 << (t.bits - 1)) - 1)


def wrapped(value: Column, t: DType) -> Column:
    """An exact whole number (any decimal) brought into the range of ``t`` modulo its size."""
    lo, _ = limits(t)
    size, low = (F.lit(str(n)).cast("decimal(38,0)") for n in (1 << t.bits, lo))
    d = value.cast("decimal(38,0)") - low
    r = d % size
    return (F.when(r < 0, r + size).otherwise(r) + low).cast(t.spark)


def cast(value: Column, a, b) -> Column:
    """``value`` of type ``a`` as ``b``: floats saturate to integers with NaN as 0, integers wrap, complex numbers lose their imaginary part."""
    a, b = dtype(a), dtype(b)
    if a == b:
        return value
    if a.kind == "c" and b.kind != "c":
        return cast(value["re"], "float64" if a.bits == 128 else "float32", b)
    if b.kind == "c":
        part = "double" if b.bits == 128 else "float"
        if a.kind == "c":
            return F.struct(value["re"].cast(part).alias("re"), value["im"].cast(part).alias("im"))
        return F.struct(cast(value, a, "float64").cast(part).alias("re"), F.lit(0.0).cast(part).alias("im"))
    if b.kind == "b":
        return value != 0
    if a.kind == "b":
        return value.cast("int").cast(b.spark)
    if a.kind == "f" and b.kind in "iu":
        lo, hi = limits(b)
        x = value.cast("double")
        whole = F.when(x < 0, F.ceil(F.greatest(x, F.lit(float(lo))))).otherwise(F.floor(F.least(x, F.lit(float(hi)))))
        edge = F.when(F.isnan(x), F.lit(0).cast(b.spark)).when(x >= float(hi), F.lit(str(hi)).cast(b.spark)).when(x <= float(lo), F.lit(str(lo)).cast(b.spark))
        return edge.otherwise(whole.cast("decimal(38,0)").cast(b.spark))
    if b.kind in "iu":
        return value.cast(b.spark) if _holds(a, b) else wrapped(value, b)
    return value.cast(b.spark)


@dataclass(frozen=True)
class FloatInfo:
    """What a floating type can hold; of a complex type its parts'."""

    bits: int
    eps: float
    epsneg: float
    max: float
    min: float
    tiny: float
    smallest_subnormal: float
    precision: int

    @property
    def smallest_normal(self) -> float:
        return self.tiny


def finfo(t) -> FloatInfo:
    """Derived from the width of the fraction and of the exponent."""
    t = dtype(t)
    if t.kind not in "fc":
        raise ValueError(f"{t.name} isn't a floating type")
    bits = t.bits // (2 if t.kind == "c" else 1)
    fraction = {16: 10, 32: 23, 64: 52}[bits]
    top = 2 ** (bits - fraction - 2) - 1  # the largest exponent
    most = 2.0**top * (2 - 2.0**-fraction)
    return FloatInfo(bits, 2.0**-fraction, 2.0 ** -(fraction + 1), most, -most, 2.0 ** (1 - top), 2.0 ** (1 - top - fraction), int(fraction * 0.30103))


@dataclass(frozen=True)
class IntInfo:
    bits: int
    min: int
    max: int


def iinfo(t) -> IntInfo:
    t = dtype(t)
    if t.kind not in "iu":
        raise ValueError(f"{t.name} isn't an integer type")
    return IntInfo(t.bits, *limits(t))


#: Groups of types, each of which holds the kinds that are named.
FAMILIES = {"generic": "biufc", "number": "iufc", "integer": "iu", "signedinteger": "i", "unsignedinteger": "u", "inexact": "fc", "floating": "f", "complexfloating": "c", "bool": "b"}


def issubdtype(a, b) -> bool:
    """Whether type ``a`` is type ``b`` or belongs to the family that ``b`` names."""
    if a in FAMILIES and a != "bool":
        return b in FAMILIES and set(FAMILIES[a]) <= set(FAMILIES[b])
    return dtype(a).kind in FAMILIES[b] if b in FAMILIES else dtype(a) == dtype(b)


#: Kinds by the names that isdtype takes.
KINDS = {"bool": "b", "signed integer": "i", "unsigned integer": "u", "integral": "iu", "real floating": "f", "complex floating": "c", "numeric": "iufc"}


def isdtype(t, kind) -> bool:
    if isinstance(kind, tuple):
        return any(isdtype(t, k) for k in kind)
    return dtype(t).kind in KINDS[kind] if kind in KINDS else dtype(t) == dtype(kind)


def min_scalar_type(x) -> DType:
    """The smallest type that holds a number."""
    if isinstance(x, bool):
        return dtype("bool")
    if isinstance(x, int):
        names = ("uint8", "uint16", "uint32", "uint64") if x >= 0 else ("int8", "int16", "int32", "int64")
        fitting = [n for n in names if limits(n)[0] <= x <= limits(n)[1]]
        if not fitting:
            raise OverflowError(f"no integer type holds {x}")
        return dtype(fitting[0])
    parts = (x.real, x.imag) if isinstance(x, complex) else (x,)
    # An infinity or a NaN has no size.
    most = max((abs(p) for p in parts if abs(p) < float("inf")), default=0.0)
    bits = next((n for n in (16, 32) if most <= finfo(f"float{n}").max), 64)
    return dtype(f"complex{max(64, 2 * bits)}" if isinstance(x, complex) else f"float{bits}")


def common_type(*types) -> DType:
    """The inexact type that arrays of all these types fit into."""
    kinds = [dtype(t) for t in types]
    if any(t.kind == "b" for t in kinds):
        raise TypeError("booleans have no inexact type")
    return promote(*(t if t.kind in "fc" else dtype("float64") for t in kinds))


# One letter for each type, and what it is called.
LETTERS = {"?": ("bool", "bool"), "b": ("int8", "signed char"), "B": ("uint8", "unsigned char"), "h": ("int16", "short"), "H": ("uint16", "unsigned short"), "i": ("int32", "integer"), "I": ("uint32", "unsigned integer"), "l": ("int64", "long integer"), "L": ("uint64", "unsigned long integer"), "e": ("float16", "half precision"), "f": ("float32", "single precision"), "d": ("float64", "double precision"), "F": ("complex64", "complex single precision"), "D": ("complex128", "complex double precision")}


def typename(letter: str) -> str:
    return LETTERS[letter][1]


def mintypecode(letters: str, typeset: str = "GDFgdf", default: str = "d") -> str:
    """The letter of the smallest type of ``typeset`` that all of ``letters`` in it can be cast to."""
    own = [c for c in letters if c in typeset]
    if not own:
        return default
    return "D" if "F" in own and "d" in own else min(own, key="GDFgdf".find)
