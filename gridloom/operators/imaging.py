"""Bio-imaging metadata: multiscale images, plates, wells and scenes, versions 0.4, 0.5 and 0.6.

Documents are plain dictionaries as JSON has them; unknown fields are kept and warned about once. Version 0.4 lies in
``.zattrs`` of format 2, 0.5 and 0.6 under ``ome`` in the attributes of format 3. Images, wells and transforms are
also given as DataFrames.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GridError
from ..meta import ArraySpec
from ..sources.stores import handle_for
from .array import Array
from .hierarchy import Group, node_type

_log = logging.getLogger(__name__)
_warned: set[str] = set()

#: Known fields, for the warning.
FIELDS = {
    "ome": {"version", "multiscales", "omero", "labels", "plate", "well", "bioformats2raw.layout", "scene", "series", "image-label"},
    "multiscales": {"name", "axes", "datasets", "coordinateTransformations", "coordinateSystems", "type", "metadata", "version"},
    "omero": {"id", "name", "version", "channels", "rdefs"},
    "plate": {"name", "columns", "rows", "wells", "acquisitions", "field_count", "version"},
    "well": {"images", "version"},
}
#: Transform types of version 0.6; others are kept as they are.
TRANSFORMS = ("scale", "translation", "identity", "sequence", "mapAxis", "affine", "rotation", "displacements", "coordinates", "bijection", "byDimension")
SHARED = ("scale", "translation", "identity")


def _warn(what: str) -> None:
    if what not in _warned:
        _warned.add(what)
        _log.warning(what)


def _checked(kind: str, document: dict) -> dict:
    for key in sorted(set(document) - FIELDS[kind]):
        _warn(f"unknown field {key!r} in {kind}")
    return document


def ome_of(group: Group) -> tuple[str, dict]:
    """Version ("0.4", "0.5" or "0.6") and document of a group."""
    attributes = group.spec.attributes or {}
    if group.spec.zarr_format == 2:
        part = next((attributes[k] for k in ("multiscales", "plate", "well") if k in attributes), None)
        if part is None:
            raise GridError(f"no imaging metadata at {group.handle}")
        return "0.4", attributes
    if "ome" not in attributes:
        raise GridError(f"no imaging metadata at {group.handle}")
    version = str(attributes["ome"].get("version", ""))
    return "0.6" if version.startswith("0.6") else "0.5", _checked("ome", attributes["ome"])


def _written(group: Group, version: str, document: dict) -> None:
    attributes = dict(group.spec.attributes or {})
    group.set_attributes(attributes | document if version == "0.4" else attributes | {"ome": document})


def _created(where, version: str, document: dict) -> Group:
    if version == "0.4":
        return Group.create(where, document, 2)
    return Group.create(where, {"ome": {"version": {"0.5": "0.5", "0.6": "0.6.dev3"}.get(version, version)} | document}, 3)


def shared_transform(t: dict) -> dict:
    """A transform in the form that all versions share: scale, translation, identity, or the raw document."""
    kind = t.get("type")
    if kind in SHARED:
        return {"type": kind} | {k: t[k] for k in (kind, "path") if k in t}
    return {"type": kind, "raw": dict(t)}


def own_transform(t: dict, source=None, target=None) -> dict:
    """A shared transform in the form of version 0.6, between coordinate systems."""
    out = dict(t["raw"]) if "raw" in t else dict(t)
    return out | {k: v for k, v in (("input", source), ("output", target)) if v is not None}


def reference(ref) -> str | None:
    """A coordinate system's reference as text: a string as it is, an object as ``path#name``."""
    if ref is None or isinstance(ref, str):
        return ref
    path, name = ref.get("path"), ref.get("name")
    return path if name is None else f"{path or '.'}#{name}"


def normal_path(path: str) -> str:
    """Trimmed, with ``/``, without a leading ``./`` or ``/``."""
    path = path.strip().replace("\\", "/")
    path = path[2:] if path.startswith("./") else path
    return path.lstrip("/")


@dataclass
class MultiscaleImage:
    group: Group
    version: str
    document: dict

    @staticmethod
    def open(where) -> MultiscaleImage:
        group = Group.open(where)
        version, document = ome_of(group)
        if "multiscales" not in document:
            raise GridError(f"no image at {group.handle}")
        return MultiscaleImage(group, version, document)

    @staticmethod
    def create(where, axes: list[dict], name: str | None = None, version: str = "0.5", **more) -> MultiscaleImage:
        entry = {"datasets": []} | ({"name": name} if name else {}) | more
        entry |= {"coordinateSystems": [{"name": "physical", "axes": axes}]} if version == "0.6" else {"axes": axes}
        if version == "0.4":
            entry["version"] = "0.4"
        group = _created(where, version, {"multiscales": [entry]})
        return MultiscaleImage(group, *ome_of(group))

    def _save(self) -> None:
        _written(self.group, self.version, self.document)

    def entry(self, i: int = 0) -> dict:
        """The i-th multiscale in one form for all versions: name, axes, datasets of path and shared transforms."""
        own = _checked("multiscales", self.document["multiscales"][i])
        axes = own.get("axes") or next((s.get("axes") for s in own.get("coordinateSystems", ())), [])
        datasets = [{"path": d["path"], "transforms": [shared_transform(t) for t in d.get("coordinateTransformations", ())]} for d in own.get("datasets", ())]
        return {"name": own.get("name"), "axes": axes, "datasets": datasets, "transforms": [shared_transform(t) for t in own.get("coordinateTransformations") or ()]}

    def axis_names(self) -> list[str]:
        return [a if isinstance(a, str) else a["name"] for a in self.entry()["axes"]]

    def level_count(self) -> int:
        return len(self.entry()["datasets"])

    def open_level(self, i: int) -> Array:
        return Array.open(self.group.handle.resolve(self.entry()["datasets"][i]["path"]))

    def create_level(self, path: str, spec: ArraySpec, transforms: list[dict]) -> Array:
        """A new resolution: its array, and its entry in the datasets."""
        array = self.group.create_array(path, spec)
        if self.version == "0.6":
            transforms = [own_transform(t, {"path": path}, {"name": self.document["multiscales"][0]["coordinateSystems"][0]["name"]}) for t in transforms]
        self.document["multiscales"][0]["datasets"].append({"path": path, "coordinateTransformations": transforms})
        self._save()
        return array

    def labels(self) -> list[str]:
        below = self.group.get("labels")
        if below is None:
            return []
        attributes = below.spec.attributes or {}
        return list(attributes.get("labels") or attributes.get("ome", {}).get("labels") or [])

    def open_label(self, name: str) -> MultiscaleImage:
        return MultiscaleImage.open(self.group.handle.resolve("labels", name))

    @property
    def omero(self) -> dict | None:
        own = self.document.get("omero")
        if own is not None:
            _checked("omero", own)
            for k, channel in enumerate(own.get("channels", ())):
                for need in ("color", "window"):
                    if need not in channel:
                        _warn(f"channel {k} has no {need}")
        return own

    def set_omero(self, omero: dict) -> None:
        self.document["omero"] = omero
        self._save()

    @property
    def bioformats_layout(self) -> int | None:
        return self.document.get("bioformats2raw.layout")

    def levels(self, spark: SparkSession) -> DataFrame:
        """A row per resolution: level, path, shape, chunks, data_type, scale."""
        rows = []
        for i, d in enumerate(self.entry()["datasets"]):
            spec = self.open_level(i).spec
            scale = next(([float(x) for x in t["scale"]] for t in d["transforms"] if t["type"] == "scale"), None)
            rows.append((i, d["path"], list(spec.shape), list(spec.chunks), spec.dtype, scale))
        return spark.createDataFrame(rows, "level int, path string, shape array<bigint>, chunks array<bigint>, data_type string, scale array<double>")


@dataclass
class Well:
    group: Group
    version: str
    document: dict

    @staticmethod
    def open(where) -> Well:
        group = Group.open(where)
        version, document = ome_of(group)
        return Well(group, version, _checked("well", document["well"]))

    @staticmethod
    def create(where, images: list[dict], version: str = "0.5") -> Well:
        _created(where, version, {"well": {"images": images} | ({"version": "0.4"} if version == "0.4" else {})})
        return Well.open(where)

    def open_image(self, path: str) -> MultiscaleImage:
        return MultiscaleImage.open(self.group.handle.resolve(path))


@dataclass
class Plate:
    group: Group
    version: str
    document: dict

    @staticmethod
    def open(where) -> Plate:
        group = Group.open(where)
        version, document = ome_of(group)
        if "plate" not in document:
            raise GridError(f"no plate at {group.handle}")
        return Plate(group, version, _checked("plate", document["plate"]))

    @staticmethod
    def create(where, rows: list[str], columns: list[str], wells: list[str], name: str | None = None, version: str = "0.5", acquisitions: list[dict] | None = None) -> Plate:
        own = {"rows": [{"name": r} for r in rows], "columns": [{"name": c} for c in columns], "wells": [{"path": w, "rowIndex": rows.index(w.split("/")[0]), "columnIndex": columns.index(w.split("/")[1])} for w in wells]}
        own |= ({"name": name} if name else {}) | ({"acquisitions": acquisitions} if acquisitions else {}) | ({"version": "0.4"} if version == "0.4" else {})
        _created(where, version, {"plate": own})
        return Plate.open(where)

    def open_well(self, path: str) -> Well:
        return Well.open(self.group.handle.resolve(path))

    def wells(self, spark: SparkSession) -> DataFrame:
        """A row per well: path, row_name, column_name, row_index, column_index."""
        name = lambda kind, i: self.document[kind][i]["name"]
        rows = [(w["path"], name("rows", w["rowIndex"]), name("columns", w["columnIndex"]), w["rowIndex"], w["columnIndex"]) for w in self.document.get("wells", ())]
        return spark.createDataFrame(rows, "path string, row_name string, column_name string, row_index int, column_index int")


@dataclass
class Scene:
    group: Group
    document: dict

    @staticmethod
    def open(where) -> Scene:
        group = Group.open(where)
        version, document = ome_of(group)
        if version != "0.6" or "scene" not in document:
            raise GridError(f"no scene at {group.handle}")
        return Scene(group, document["scene"])

    @staticmethod
    def create(where, coordinate_systems: list[dict], transforms: list[dict]) -> Scene:
        _created(where, "0.6", {"scene": {"coordinateSystems": coordinate_systems, "coordinateTransformations": transforms}})
        return Scene.open(where)

    def transforms_group(self) -> Group:
        return self.group.create_group("coordinateTransformations")

    def images(self) -> list[str]:
        """Names of the images below; other children are passed over."""
        found = []
        for name in self.group.handle.children():
            try:
                if node_type(self.group.handle.resolve(name))[1] == "group" and MultiscaleImage.open(self.group.handle.resolve(name)).version == "0.6":
                    found.append(name)
            except (GridError, FileNotFoundError):
                continue
        return found

    def open_image(self, path: str) -> MultiscaleImage:
        return MultiscaleImage.open(self.group.handle.resolve(normal_path(path)))

    def graph(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """nodes (id, path, name, axes): coordinate systems; edges (position, name, type, source, target, path): each
        transform and each part of one, a part without a name having that of the whole, an end null where no system
        answers to it; warnings (position, side, reference): those ends."""
        systems = [(".", s) for s in self.document.get("coordinateSystems") or ()]
        for name in self.images():
            entry = self.open_image(name).document["multiscales"][0]
            systems += [(name, s) for s in entry.get("coordinateSystems") or ()]
        nodes = {f"{path}#{s['name']}": (path, s["name"], [a["name"] for a in s.get("axes") or ()]) for path, s in systems}
        every = [part for t in self.document.get("coordinateTransformations") or () for part in transform_parts(t)]
        rows = []
        for k, (name, t) in enumerate(every):
            path = t.get("path")
            rows.append((k, name, t.get("type"), answered(t.get("input"), nodes), answered(t.get("output"), nodes), path and normal_path(path)))
        told = spark.createDataFrame(rows, "position int, name string, type string, input string, output string, path string")
        node_rows = spark.createDataFrame([(i, *x) for i, x in nodes.items()], "id string, path string, name string, axes array<string>")
        ids = node_rows.select("id")
        edges = told.join(ids.toDF("source"), told.input == F.col("source"), "left").join(ids.toDF("target"), told.output == F.col("target"), "left")
        ends = told.selectExpr("position", "stack(2, 'input', input, 'output', output) AS (side, reference)").where("reference IS NOT NULL")
        edges = edges.select("position", told.name, "type", "source", "target", told.path)
        return node_rows, edges, ends.join(ids, ends.reference == ids.id, "left_anti")


def transform_parts(t: dict, inherited: str | None = None) -> Iterator[tuple[str | None, dict]]:
    """A transform and all that it is made of, the outer before the inner, each with the name it has or inherits."""
    name = t.get("name") or inherited
    if "type" in t:
        yield name, t
    for key in ("transformations", "transformation", "forward", "inverse"):
        inner = t.get(key) or []
        for part in inner if isinstance(inner, list) else [inner]:
            if isinstance(part, dict):
                yield from transform_parts(part, name)


def answered(ref, nodes) -> str | None:
    """The id of the node that a reference means; where none is known, what it asks for."""
    text = reference(ref)
    if text is None:
        return None
    path, hash_, name = text.partition("#")
    if hash_:
        return f"{normal_path(path) if path not in ('', '.') else '.'}#{name}"
    return next((n for n in nodes if n == f".#{text}"), next((n for n in nodes if n.startswith(f"{normal_path(text)}#")), text))


def open_imaging(where):
    """The plate, well, scene or image at a place."""
    version, document = ome_of(Group.open(handle_for(where)))
    for key, cls in (("plate", Plate), ("well", Well), ("scene", Scene), ("multiscales", MultiscaleImage)):
        if key in document:
            return cls.open(where)
    raise GridError(f"no imaging metadata of version {version} at {where}")
