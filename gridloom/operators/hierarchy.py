"""Groups, nodes and their listing."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GridError, MissingNode
from ..meta import ArraySpec, GroupSpec
from ..sources.stores import FileStore, Handle, handle_for

MARKERS = ("zarr.json", ".zarray", ".zgroup")
NODES = "path string, node_type string, zarr_format int, shape array<bigint>, chunks array<bigint>, data_type string, attributes string"


def node_type(where, zarr_format: int | None = None) -> tuple[int, str]:
    """Format version and "array" or "group" of what lies at a place."""
    handle = handle_for(where)
    document = handle.read("zarr.json") if zarr_format in (None, 3) else None
    old = next((k for k, m in (("array", ".zarray"), ("group", ".zgroup")) if handle.exists(m)), None) if zarr_format in (None, 2) else None
    if document is not None and old:
        raise GridError(f"{handle} has metadata of both format versions")
    if document is not None:
        return 3, json.loads(document).get("node_type")
    if old:
        return 2, old
    raise MissingNode(f"no array or group at {handle}")


def read_spec(where, kind: str, zarr_format: int | None = None):
    handle = handle_for(where)
    version, found = node_type(handle, zarr_format)
    if found != kind:
        raise GridError(f"{handle} is {'an' if found == 'array' else 'a'} {found}, not {kind}")
    cls = ArraySpec if kind == "array" else GroupSpec
    if version == 3:
        return cls.from_json(handle.read_existing("zarr.json"))
    attributes = handle.read(".zattrs")
    return cls.from_json(handle.read_existing(".zarray" if kind == "array" else ".zgroup"), None if attributes is None else json.loads(attributes))


def write_spec(handle: Handle, spec) -> None:
    if spec.zarr_format == 3:
        handle.set(spec.to_json().encode(), "zarr.json")
        return
    if spec.attributes is not None:
        handle.set(json.dumps(spec.attributes, indent=2).encode(), ".zattrs")
    handle.set(spec.to_json().encode(), ".zarray" if isinstance(spec, ArraySpec) else ".zgroup")


def open_node(where, zarr_format: int | None = None):
    from .array import Array

    handle = handle_for(where)
    version, kind = node_type(handle, zarr_format)
    return (Array if kind == "array" else Group).open(handle, version)


@dataclass
class Group:
    handle: Handle
    spec: GroupSpec

    @staticmethod
    def open(where, zarr_format: int | None = None) -> Group:
        handle = handle_for(where)
        return Group(handle, read_spec(handle, "group", zarr_format))

    @staticmethod
    def create(where, attributes: dict | None = None, zarr_format: int = 3) -> Group:
        """Writes the metadata, also over what is there."""
        group = Group(handle_for(where), GroupSpec(zarr_format, attributes))
        write_spec(group.handle, group.spec)
        return group

    @property
    def attributes(self) -> dict:
        if self.spec.attributes is None:
            raise GridError(f"{self.handle} has no attributes")
        return self.spec.attributes

    def get(self, *key: str):
        """The node below, or None."""
        try:
            return open_node(self.handle.resolve(*key), self.spec.zarr_format)
        except MissingNode:
            return None

    def list(self) -> list:
        """All nodes below, at any depth."""
        marks = MARKERS[:1] if self.spec.zarr_format == 3 else MARKERS[1:]
        found = sorted({k.rpartition("/")[0] for k in self.handle.list() if "/" in k and k.rsplit("/", 1)[1] in marks})
        return [open_node(self.handle.resolve(p), self.spec.zarr_format) for p in found]

    def create_group(self, key: str, attributes: dict | None = None) -> Group:
        return Group.create(self.handle.resolve(key), attributes, self.spec.zarr_format)

    def create_array(self, key: str, spec: ArraySpec, exists_ok: bool = False):
        from .array import Array

        return Array.create(self.handle.resolve(key), spec, exists_ok)

    def set_attributes(self, attributes: dict) -> Group:
        """Replaces all attributes; this object has them too."""
        self.spec = replace(self.spec, attributes=dict(attributes))
        write_spec(self.handle, self.spec)
        return self

    def update_attributes(self, change) -> Group:
        return self.set_attributes(change(dict(self.spec.attributes or {})))

    def __repr__(self) -> str:
        return f"<v{self.spec.zarr_format}.Group {{{self.handle}}}>"


def nodes(spark: SparkSession, where) -> DataFrame:
    """Every array and group at or below a place: ``NODES``; path is relative, "" the place itself.

    Files are listed and read by Spark's file source and parsed in columns; other stores are listed by the driver.
    """
    handle = handle_for(where)
    if isinstance(handle.store, FileStore):
        root = "/".join(p for p in (handle.store.url.rstrip("/"), handle.prefix) if p)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{zarr.json,.zarray,.zgroup,.zattrs}").load(root)
        plain = root.split("://", 1)[-1].lstrip("/") if "://" in root else root.removeprefix("file:").lstrip("/")
        inside = F.substring_index(F.col("path"), f"{plain}/", -1)
        found = files.select(inside.alias("key"), F.col("content").cast("string").alias("document"))
    else:
        rows = [(k, handle.read(k).decode()) for k in handle.list() if k.rsplit("/", 1)[-1] in (*MARKERS, ".zattrs")]
        found = spark.createDataFrame(rows, "key string, document string")
    name = F.substring_index("key", "/", -1)
    folder = F.when(F.instr("key", "/") > 0, F.expr("left(key, length(key) - length(substring_index(key, '/', -1)) - 1)")).otherwise("")
    found = found.select(folder.alias("path"), name.alias("name"), "document")
    extra = found.where("name = '.zattrs'").select("path", F.col("document").alias("extra"))

    def part(where: str) -> Column:
        return F.get_json_object("document", where)

    own = found.where("name <> '.zattrs'").join(extra, "path", "left")
    is_v3 = F.col("name") == "zarr.json"
    return own.select(
        "path",
        F.when(is_v3, part("$.node_type")).when(F.col("name") == ".zarray", "array").otherwise("group").alias("node_type"),
        F.when(is_v3, 3).otherwise(2).alias("zarr_format"),
        F.from_json(part("$.shape"), "array<bigint>").alias("shape"),
        F.from_json(F.coalesce(part("$.chunk_grid.configuration.chunk_shape"), part("$.chunks")), "array<bigint>").alias("chunks"),
        F.coalesce(part("$.data_type"), part("$.dtype")).alias("data_type"),
        F.when(is_v3, part("$.attributes")).otherwise(F.col("extra")).alias("attributes"),
    )
