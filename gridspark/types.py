"""Type descriptors of array elements, their Spark types, and the conversions between them."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import types as T

from .errors import ConversionError

POINTER = 16  # bytes of a variable-length slot on disk


class Conversion(enum.IntEnum):
    """How much a conversion changes; a reader allows up to a level."""

    NOOP = 0
    HARD = 1
    SOFT = 2


@dataclass(frozen=True)
class Type:
    """Base of all descriptors."""

    @property
    def size(self) -> int:
        raise NotImplementedError

    @property
    def alignment(self) -> int:
        return self.size

    def spark(self) -> T.DataType:
        raise NotImplementedError

    def to_packed(self) -> Type:
        return self

    def to_c(self) -> Type:
        return self

    @property
    def has_vlen(self) -> bool:
        return False


@dataclass(frozen=True)
class Integer(Type):
    bytes: int

    @property
    def size(self) -> int:
        return self.bytes

    @property
    def bounds(self) -> tuple[int, int]:
        return -(1 << (8 * self.bytes - 1)), (1 << (8 * self.bytes - 1)) - 1

    def spark(self) -> T.DataType:
        return {1: T.ByteType(), 2: T.ShortType(), 4: T.IntegerType(), 8: T.LongType()}[self.bytes]

    def __str__(self) -> str:
        return f"int{8 * self.bytes}"


@dataclass(frozen=True)
class Unsigned(Type):
    bytes: int

    @property
    def size(self) -> int:
        return self.bytes

    @property
    def bounds(self) -> tuple[int, int]:
        return 0, (1 << (8 * self.bytes)) - 1

    def spark(self) -> T.DataType:
        return {1: T.ShortType(), 2: T.IntegerType(), 4: T.LongType(), 8: T.DecimalType(20, 0)}[self.bytes]

    def __str__(self) -> str:
        return f"uint{8 * self.bytes}"


@dataclass(frozen=True)
class Float(Type):
    bytes: int

    @property
    def size(self) -> int:
        return self.bytes

    def spark(self) -> T.DataType:
        return T.DoubleType() if self.bytes == 8 else T.FloatType()

    def __str__(self) -> str:
        return f"float{8 * self.bytes}"


@dataclass(frozen=True)
class Boolean(Type):
    @property
    def size(self) -> int:
        return 1

    def spark(self) -> T.DataType:
        return T.BooleanType()

    def __str__(self) -> str:
        return "bool"


@dataclass(frozen=True)
class Enum(Type):
    base: Integer | Unsigned
    members: tuple[tuple[str, int], ...]

    @property
    def size(self) -> int:
        return self.base.size

    def spark(self) -> T.DataType:
        return self.base.spark()

    def name_of(self, value: int) -> str | None:
        return next((n for n, v in self.members if v == value), None)

    def __str__(self) -> str:
        return f"enum ({self.base})"


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    offset: int = 0


@dataclass(frozen=True)
class Compound(Type):
    fields: tuple[Field, ...]
    bytes: int

    @property
    def size(self) -> int:
        return self.bytes

    @property
    def alignment(self) -> int:
        return max((f.type.alignment for f in self.fields), default=1)

    @property
    def has_vlen(self) -> bool:
        return any(f.type.has_vlen for f in self.fields)

    def spark(self) -> T.DataType:
        return T.StructType([T.StructField(f.name, f.type.spark(), True, metadata(f.type)) for f in self.fields])

    def to_packed(self) -> Compound:
        return layout([(f.name, f.type.to_packed()) for f in self.fields])

    def to_c(self) -> Compound:
        return layout([(f.name, f.type.to_c()) for f in self.fields], aligned=True)

    def __str__(self) -> str:
        return f"compound ({len(self.fields)} fields)"


def layout(members: list[tuple[str, Type]], aligned: bool = False) -> Compound:
    """A compound with its members one after another, each at a multiple of its alignment if aligned."""
    at, widest, out = 0, 1, []
    for name, t in members:
        if aligned:
            at += -at % t.alignment
            widest = max(widest, t.alignment)
        out.append(Field(name, t, at))
        at += t.size
    return Compound(tuple(out), at + (-at % widest if aligned else 0))


def record(*types: Type) -> Compound:
    """A tuple: a compound whose fields are called 0, 1, ..."""
    return layout([(str(i), t) for i, t in enumerate(types)], aligned=True)


def complex_of(part: Float) -> Compound:
    return layout([("r", part), ("i", part)])


@dataclass(frozen=True)
class FixedArray(Type):
    item: Type
    length: int

    @property
    def size(self) -> int:
        return self.item.size * self.length

    @property
    def alignment(self) -> int:
        return self.item.alignment

    @property
    def has_vlen(self) -> bool:
        return self.item.has_vlen

    def spark(self) -> T.DataType:
        return T.ArrayType(self.item.spark())

    def __str__(self) -> str:
        return f"[{self.item}; {self.length}]"


@dataclass(frozen=True)
class VarLenArray(Type):
    item: Type

    @property
    def size(self) -> int:
        return POINTER

    @property
    def alignment(self) -> int:
        return 8

    @property
    def has_vlen(self) -> bool:
        return True

    def spark(self) -> T.DataType:
        return T.ArrayType(self.item.spark())

    def __str__(self) -> str:
        return f"[{self.item}] (var len)"


@dataclass(frozen=True)
class FixedString(Type):
    bytes: int
    utf8: bool = False

    @property
    def size(self) -> int:
        return self.bytes

    @property
    def alignment(self) -> int:
        return 1

    def spark(self) -> T.DataType:
        return T.StringType()

    def __str__(self) -> str:
        return f"{'unicode' if self.utf8 else 'string'} (len {self.bytes})"


@dataclass(frozen=True)
class VarLenString(Type):
    utf8: bool = True

    @property
    def size(self) -> int:
        return POINTER

    @property
    def alignment(self) -> int:
        return 8

    @property
    def has_vlen(self) -> bool:
        return True

    def spark(self) -> T.DataType:
        return T.StringType()

    def __str__(self) -> str:
        return f"{'unicode' if self.utf8 else 'string'} (var len)"


@dataclass(frozen=True)
class Opaque(Type):
    """Bytes that are carried but not interpreted: opaque values and references."""

    bytes: int

    @property
    def size(self) -> int:
        return self.bytes

    def spark(self) -> T.DataType:
        return T.BinaryType()

    def __str__(self) -> str:
        return f"opaque ({self.bytes})"


I8, I16, I32, I64 = (Integer(n) for n in (1, 2, 4, 8))
U8, U16, U32, U64 = (Unsigned(n) for n in (1, 2, 4, 8))
F16, F32, F64 = (Float(n) for n in (2, 4, 8))
BOOL = Boolean()


def metadata(t: Type) -> dict[str, Any]:
    """What a Spark type does not say about t, for a field's metadata."""
    if isinstance(t, Unsigned):
        return {"unsigned": True, "bytes": t.bytes}
    if isinstance(t, Float) and t.bytes == 2:
        return {"f16": True}
    if isinstance(t, Enum):
        return {"enum": {n: v for n, v in t.members}, "unsigned": isinstance(t.base, Unsigned), "bytes": t.base.bytes}
    if isinstance(t, FixedArray):
        return {"length": t.length, "item": metadata(t.item)}
    if isinstance(t, FixedString):
        return {"nbytes": t.bytes, "utf8": t.utf8}
    if isinstance(t, VarLenString):
        return {"utf8": t.utf8}
    return {}


def from_spark(t: T.DataType, meta: dict | None = None) -> Type:
    """The descriptor of a Spark type; metadata narrows it."""
    meta = meta or {}
    if "enum" in meta:
        base = (Unsigned if meta.get("unsigned") else Integer)(meta.get("bytes", 4))
        return Enum(base, tuple(meta["enum"].items()))
    if meta.get("unsigned"):
        return Unsigned(meta["bytes"])
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.DecimalType) and t.scale == 0 and t.precision == 20:
        return U64
    simple = {T.ByteType: I8, T.ShortType: I16, T.IntegerType: I32, T.LongType: I64, T.FloatType: F16 if meta.get("f16") else F32, T.DoubleType: F64, T.BinaryType: VarLenArray(U8)}
    if type(t) in simple:
        return simple[type(t)]
    if isinstance(t, T.StringType):
        return FixedString(meta["nbytes"], meta.get("utf8", False)) if "nbytes" in meta else VarLenString(meta.get("utf8", True))
    if isinstance(t, T.ArrayType):
        item = from_spark(t.elementType, meta.get("item"))
        return FixedArray(item, meta["length"]) if "length" in meta else VarLenArray(item)
    if isinstance(t, T.StructType):
        return layout([(f.name, from_spark(f.dataType, f.metadata)) for f in t.fields])
    raise ConversionError(f"no element type for {t.simpleString()}")


def describe(cls: Any, *, rename: dict[str, str] | None = None) -> Type:
    """The descriptor of a Python class: a dataclass is a compound, an IntEnum an enumeration, a tuple a record, int, float, bool and str the
    widest of their kind. Annotated[T, descriptor] names one outright; fields without size are refused."""
    if isinstance(cls, Type):
        return cls
    if extra := getattr(cls, "__metadata__", None):
        return next(x for x in extra if isinstance(x, Type))
    if cls in (int, float, bool, str):
        return {int: I64, float: F64, bool: BOOL, str: VarLenString()}[cls]
    origin = get_origin(cls)
    if origin is tuple:
        return record(*map(describe, get_args(cls)))
    if origin is list:
        return VarLenArray(describe(get_args(cls)[0]))
    if isinstance(cls, type) and issubclass(cls, enum.IntEnum):
        values = [(m.name, int(m)) for m in cls]
        if not values:
            raise ConversionError("an enumeration needs members")
        size = next(n for n in (1, 2, 4, 8) if -(1 << (8 * n - 1)) <= min(v for _, v in values) and max(v for _, v in values) < 1 << (8 * n - 1))
        return Enum(Integer(size), tuple(values))
    if is_dataclass(cls):
        hints = get_type_hints(cls, include_extras=True)
        members = [((rename or {}).get(f.name, f.metadata.get("rename", f.name)), describe(hints[f.name])) for f in fields(cls) if not f.metadata.get("skip")]
        if not members:
            raise ConversionError("a compound needs fields")
        return layout(members, aligned=True)
    raise ConversionError(f"no element type for {cls!r}")


def conversion_path(src: Type, dst: Type) -> Conversion | None:
    """The least conversion that turns src into dst; None if there is none."""
    if src == dst:
        return Conversion.NOOP
    numeric = (Integer, Unsigned, Float)
    text = (FixedString, VarLenString)
    if isinstance(src, numeric) and isinstance(dst, numeric):
        return Conversion.HARD
    if isinstance(src, text) and isinstance(dst, text):
        return Conversion.SOFT
    if isinstance(src, Compound) and isinstance(dst, Compound):
        by = {f.name: f.type for f in src.fields}
        if len(src.fields) != len(dst.fields) or any(f.name not in by for f in dst.fields):
            return None
        return _worst([conversion_path(by[f.name], f.type) for f in dst.fields])
    if isinstance(src, FixedArray) and isinstance(dst, FixedArray):
        return conversion_path(src.item, dst.item) if src.length == dst.length else None
    if isinstance(src, VarLenArray) and isinstance(dst, VarLenArray):
        return conversion_path(src.item, dst.item)
    if {type(src), type(dst)} == {Enum, Boolean} and src.size == dst.size == 1:
        return Conversion.SOFT
    return None


def _worst(paths: list[Conversion | None]) -> Conversion | None:
    if any(p is None for p in paths):
        return None
    return max([*paths, Conversion.NOOP])


def check_conversion(src: Type, dst: Type, allowed: Conversion = Conversion.SOFT) -> Conversion:
    path = conversion_path(src, dst)
    if path is None:
        raise ConversionError(f"no conversion from {src} to {dst}")
    if path > allowed:
        raise ConversionError(f"conversion from {src} to {dst} is {path.name.lower()}, at most {allowed.name.lower()} is allowed")
    return path


@dataclass
class Dynamic:
    """A value with its descriptor, for readers that learn types from a file."""

    type: Type
    value: Any = field(default=None)

    def cast(self, want: Type) -> Any:
        if want != self.type:
            raise ConversionError(f"value is {self.type}, not {want}")
        return self.value

    def __str__(self) -> str:
        if isinstance(self.type, Enum):
            return self.type.name_of(self.value) or str(self.value)
        if isinstance(self.type, Compound):
            return "{" + ", ".join(f"{f.name}: {Dynamic(f.type, self.value[f.name])}" for f in self.type.fields) + "}"
        if isinstance(self.type, (FixedArray, VarLenArray)):
            return "[" + ", ".join(str(Dynamic(self.type.item, v)) for v in self.value) + "]"
        return repr(self.value) if isinstance(self.value, str) else str(self.value).lower() if isinstance(self.value, bool) else str(self.value)
