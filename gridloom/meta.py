"""Array and group metadata of format versions 2 and 3: parsing, validation, builders."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import types as T

from . import codecs
from .errors import GridError

#: Element types with their little-endian numpy code and the Spark type that holds all their values.
DTYPES = {
    "bool": ("|b1", T.BooleanType()),
    "int8": ("|i1", T.ByteType()),
    "int16": ("<i2", T.ShortType()),
    "int32": ("<i4", T.IntegerType()),
    "int64": ("<i8", T.LongType()),
    "uint8": ("|u1", T.ShortType()),
    "uint16": ("<u2", T.IntegerType()),
    "uint32": ("<u4", T.LongType()),
    "uint64": ("<u8", T.DecimalType(20, 0)),
    "float32": ("<f4", T.FloatType()),
    "float64": ("<f8", T.DoubleType()),
}
_NAMES = {np.dtype(code).newbyteorder("="): name for name, (code, _) in DTYPES.items()}
ARRAY_KEYS = {"zarr_format", "node_type", "shape", "data_type", "chunk_grid", "chunk_key_encoding", "fill_value", "codecs", "dimension_names", "attributes", "storage_transformers"}
V2_KEYS = {"zarr_format", "shape", "chunks", "dtype", "fill_value", "order", "filters", "compressor", "dimension_separator"}
GROUP_KEYS = {"zarr_format", "node_type", "attributes", "consolidated_metadata"}


def parse_fill(value, dtype: str):
    """A JSON fill value as a numpy scalar of the type; null stays None."""
    kind = np.dtype(DTYPES[dtype][0])
    if value is None:
        return None
    if isinstance(value, bool):
        if dtype != "bool":
            raise GridError(f"fill value {value!r} is not of type {dtype}")
        return np.bool_(value)
    if isinstance(value, (int, float)):
        if dtype == "bool":
            return np.bool_(int(value) & 0xFF != 0)
        if kind.kind == "f":
            return kind.type(value)
        if isinstance(value, float) and not math.isfinite(value):
            raise GridError(f"fill value {value!r} is not of type {dtype}")
        bits = 8 * kind.itemsize
        return np.asarray(int(value) & (1 << bits) - 1, f"<u{kind.itemsize}").view(kind)[()]
    if isinstance(value, str):
        named = {"NaN": math.nan, "+Infinity": math.inf, "Infinity": None, "-Infinity": -math.inf}
        if kind.kind == "f" and named.get(value) is not None:
            return kind.type(named[value])
        for prefix, base in (("0x", 16), ("0b", 2)):
            if value.startswith(prefix):
                digits = value[2:]
                per = 2 if base == 16 else 8
                if len(digits) != per * kind.itemsize or not re.fullmatch("[01]+" if base == 2 else "[0-9a-fA-F]+", digits):
                    raise GridError(f"fill value {value!r} does not have the size of {dtype}")
                raw = bytes(int(digits[i : i + per], base) for i in range(0, len(digits), per))
                return np.bool_(raw[0] != 0) if dtype == "bool" else np.frombuffer(raw, kind.newbyteorder("<"))[0]
    raise GridError(f"fill value {value!r} is not of type {dtype}")


def fill_json(value):
    """A fill value as JSON has it."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, (np.bool_, np.integer)):
        return value.item()
    value = float(value)
    return "NaN" if math.isnan(value) else ("+Infinity" if value > 0 else "-Infinity") if math.isinf(value) else value


def default_chunks(shape) -> tuple[int, ...]:
    """Near-equal parts of about 512 cells in each dimension."""
    out = []
    for d in shape:
        parts = d // 512
        size = d // (parts + 1)
        out.append(d if not parts else size if d % size == 0 else size + 1)
    return tuple(out)


@dataclass(frozen=True)
class ArraySpec:
    """An array's metadata. ``codecs`` are JSON objects: v3's list, or v2's compressor alone."""

    shape: tuple[int, ...]
    dtype: str
    chunks: tuple[int, ...]
    fill_value: object = 0
    codecs: tuple[dict, ...] = ({"name": "bytes", "configuration": {"endian": "little"}},)
    zarr_format: int = 3
    key_encoding: str = "default"
    separator: str = "/"
    dimension_names: tuple[str | None, ...] | None = None
    attributes: dict | None = None
    storage_transformers: tuple | None = None
    order: str = "C"
    byte_order: str = "<"

    def __post_init__(self):
        if self.dtype not in DTYPES:
            raise GridError(f"unknown data type {self.dtype!r}")
        if len(self.shape) != len(self.chunks):
            raise GridError(f"shape {self.shape} and chunk shape {self.chunks} differ in rank")
        if any(s < 0 for s in self.shape) or any(c < 1 for c in self.chunks):
            raise GridError("shapes are not negative and chunks not empty")
        if self.storage_transformers:
            raise GridError("storage transformers are not supported")
        if self.separator not in ("/", "."):
            raise GridError(f"separator {self.separator!r}")
        if self.dimension_names is not None and len(self.dimension_names) != len(self.shape):
            raise GridError("dimension names differ in number from the dimensions")
        parse_fill(self.fill_value, self.dtype)
        object.__setattr__(self, "_pipeline", self._made_pipeline())

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pipeline"}

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def numpy_dtype(self) -> np.dtype:
        return np.dtype(DTYPES[self.dtype][0])

    @property
    def spark_type(self) -> T.DataType:
        return DTYPES[self.dtype][1]

    @property
    def fill(self):
        """The value of cells without a chunk; zero where none is set."""
        own = parse_fill(self.fill_value, self.dtype)
        return self.numpy_dtype.type(0) if own is None else own

    @property
    def chunk_size(self) -> int:
        return math.prod(self.chunks)

    @property
    def chunk_bytes(self) -> int:
        return self.chunk_size * self.numpy_dtype.itemsize

    @property
    def grid(self) -> tuple[int, ...]:
        """Chunks along each dimension."""
        return tuple(-(-s // c) for s, c in zip(self.shape, self.chunks, strict=True))

    @property
    def dims(self) -> list[str]:
        """Column names of the dimensions."""
        names = self.dimension_names or [None] * self.ndim
        return [n or f"d{i}" for i, n in enumerate(names)]

    def pipeline(self) -> codecs.Pipeline:
        """The codecs, made once in each process."""
        if "_pipeline" not in self.__dict__:
            object.__setattr__(self, "_pipeline", self._made_pipeline())
        return self._pipeline

    def _made_pipeline(self) -> codecs.Pipeline:
        if self.zarr_format == 2:
            if self.order not in ("C", "F"):
                raise GridError(f"order {self.order!r}")
            first = [] if self.order == "C" else [{"name": "transpose", "configuration": {"order": list(range(self.ndim))[::-1]}}]
            own = [*first, {"name": "bytes", "configuration": {"endian": "big" if self.byte_order == ">" else "little"}}, *self.codecs]
            return codecs.Pipeline(own, self.chunks, self.numpy_dtype, self.fill, version=2)
        return codecs.Pipeline(self.codecs, self.chunks, self.numpy_dtype, self.fill)

    def chunk_key(self, coords) -> str:
        own = [str(c) for c in coords]
        if self.zarr_format == 3 and self.key_encoding == "default":
            own = ["c", *own]
        return self.separator.join(own) if own else "0"

    def to_json(self) -> str:
        if self.zarr_format == 2:
            code = np.dtype(DTYPES[self.dtype][0])
            doc = {
                "zarr_format": 2, "shape": list(self.shape), "chunks": list(self.chunks), "dtype": (self.byte_order if code.itemsize > 1 else "|") + code.str[1:],
                "fill_value": fill_json(self.fill_value), "order": self.order, "filters": None, "compressor": self.codecs[0] if self.codecs else None, "dimension_separator": self.separator,
            }
            return json.dumps(doc, indent=2)
        doc = {
            "zarr_format": 3, "node_type": "array", "shape": list(self.shape), "data_type": self.dtype,
            "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(self.chunks)}},
            "chunk_key_encoding": {"name": self.key_encoding, "configuration": {"separator": self.separator}},
            "fill_value": fill_json(self.fill_value), "codecs": list(self.codecs), "attributes": self.attributes,
            "dimension_names": None if self.dimension_names is None else list(self.dimension_names),
            "storage_transformers": None if self.storage_transformers is None else list(self.storage_transformers),
        }
        return json.dumps({k: v for k, v in doc.items() if v is not None or k == "fill_value"}, indent=2)

    @staticmethod
    def from_json(text: str | bytes, attributes: dict | None = None) -> ArraySpec:
        doc = json.loads(text)
        version = doc.get("zarr_format")
        if version == 2:
            return _from_v2(doc, attributes)
        if version != 3 or doc.get("node_type") != "array":
            raise GridError(f"not an array: zarr_format {version!r}, node_type {doc.get('node_type')!r}")
        _known(doc, ARRAY_KEYS)
        grid, encoding = doc["chunk_grid"], doc["chunk_key_encoding"]
        if grid.get("name") != "regular" or encoding.get("name") not in ("default", "v2"):
            raise GridError(f"unknown chunk grid {grid.get('name')!r} or key encoding {encoding.get('name')!r}")
        separator = (encoding.get("configuration") or {}).get("separator", "/" if encoding["name"] == "default" else ".")
        names, transformers = doc.get("dimension_names"), doc.get("storage_transformers")
        return ArraySpec(
            tuple(doc["shape"]), doc["data_type"], tuple(grid["configuration"]["chunk_shape"]), doc["fill_value"], tuple(doc.get("codecs") or ()), 3, encoding["name"], separator,
            None if names is None else tuple(names), doc.get("attributes"), None if transformers is None else tuple(transformers),
        )


def _known(doc: dict, keys: set[str]) -> None:
    if more := set(doc) - keys:
        raise GridError(f"unknown properties {sorted(more)}")


def _from_v2(doc: dict, attributes: dict | None) -> ArraySpec:
    _known(doc, V2_KEYS)
    if doc.get("filters"):
        raise GridError("filters are not supported")
    code = doc["dtype"]
    name = _NAMES.get(np.dtype(code).newbyteorder("=")) if re.fullmatch(r"[<>|][biuf][1248]", code) else None
    if name is None:
        raise GridError(f"unknown dtype {code!r}")
    compressor = doc.get("compressor")
    return ArraySpec(tuple(doc["shape"]), name, tuple(doc["chunks"]), doc["fill_value"], (compressor,) if compressor else (), 2, "v2", doc.get("dimension_separator") or ".", None, attributes, None, doc["order"], ">" if code[0] == ">" else "<")


@dataclass(frozen=True)
class GroupSpec:
    zarr_format: int = 3
    attributes: dict | None = None

    def to_json(self) -> str:
        if self.zarr_format == 2:
            return json.dumps({"zarr_format": 2}, indent=2)
        return json.dumps({"zarr_format": 3, "node_type": "group"} | ({} if self.attributes is None else {"attributes": self.attributes}), indent=2)

    @staticmethod
    def from_json(text: str | bytes, attributes: dict | None = None) -> GroupSpec:
        doc = json.loads(text)
        if doc.get("zarr_format") == 2 and "node_type" not in doc:
            return GroupSpec(2, attributes)
        if doc.get("zarr_format") != 3 or doc.get("node_type") != "group":
            raise GridError(f"not a group: zarr_format {doc.get('zarr_format')!r}, node_type {doc.get('node_type')!r}")
        _known(doc, GROUP_KEYS)
        return GroupSpec(3, doc.get("attributes"))


@dataclass(frozen=True)
class SpecBuilder:
    """Builds an ``ArraySpec`` step by step; every method gives a new builder."""

    zarr_format: int = 3
    given: dict = field(default_factory=dict)

    def _with(self, **more) -> SpecBuilder:
        return replace(self, given=self.given | more)

    def with_shape(self, *shape: int) -> SpecBuilder:
        return self._with(shape=tuple(shape))

    def with_dtype(self, dtype: str) -> SpecBuilder:
        code = re.fullmatch(r"([<>|])([biuf][1248])", dtype)
        if not code:
            return self._with(dtype=dtype)
        name = _NAMES.get(np.dtype(dtype).newbyteorder("="))
        if name is None:
            raise GridError(f"unknown dtype {dtype!r}")
        return self._with(dtype=name, byte_order=">" if code[1] == ">" else "<")

    def with_chunks(self, *chunks: int) -> SpecBuilder:
        return self._with(chunks=tuple(chunks))

    def with_default_keys(self, separator: str = "/") -> SpecBuilder:
        return self._with(key_encoding="default", separator=separator)

    def with_v2_keys(self, separator: str = ".") -> SpecBuilder:
        return self._with(key_encoding="v2", separator=separator)

    def with_fill(self, value) -> SpecBuilder:
        return self._with(fill_value=value)

    def with_codecs(self, build) -> SpecBuilder:
        """A list of JSON objects, or a function of a ``CodecBuilder``."""
        if not callable(build):
            return self._with(codecs=tuple(build))
        if "dtype" not in self.given:
            raise GridError("set the data type before the codecs")
        return self._with(codecs=tuple(build(codecs.CodecBuilder(self.given["dtype"])).build()))

    def with_compressor(self, name: str | None, **configuration) -> SpecBuilder:
        """Version 2: blosc, zlib or zstd."""
        return self._with(codecs=() if name is None else ({"id": name} | codecs.v2_defaults(name) | configuration,))

    def with_order(self, order: str) -> SpecBuilder:
        return self._with(order=order)

    def with_dimension_names(self, *names: str) -> SpecBuilder:
        return self._with(dimension_names=tuple(names))

    def with_attributes(self, attributes: dict) -> SpecBuilder:
        return self._with(attributes={**(self.given.get("attributes") or {}), **attributes})

    def with_storage_transformers(self, *transformers) -> SpecBuilder:
        return self._with(storage_transformers=tuple(transformers))

    def build(self) -> ArraySpec:
        own = dict(self.given)
        if "shape" not in own or "dtype" not in own:
            raise GridError("an array needs a shape and a data type")
        own.setdefault("chunks", default_chunks(own["shape"]))
        if self.zarr_format == 2:
            own = {"codecs": (), "key_encoding": "v2", "separator": ".", "fill_value": None} | own
        return ArraySpec(zarr_format=self.zarr_format, **own)

    @staticmethod
    def of(spec: ArraySpec, attributes: bool = True) -> SpecBuilder:
        own = {k: getattr(spec, k) for k in spec.__dataclass_fields__ if k != "zarr_format"}
        return SpecBuilder(spec.zarr_format, own | ({} if attributes else {"attributes": None}))
