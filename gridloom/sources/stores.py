"""Key-value stores of array hierarchies. All can be sent to executors; none holds an open connection.

``store_for(url)`` gives the store of a URL or path: plain paths and ``file://``, ``s3://`` and ``hdfs://`` by Arrow's
file systems, ``http(s)://`` read-only with ranged requests, ``zip://FILE`` read-only, ``memory://NAME`` in this
process.
"""

from __future__ import annotations

import io
import time
import urllib.error
import urllib.request
import uuid
import zipfile
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs

from ..errors import StoreError


def _safe(key: str) -> str:
    parts = [p for p in key.split("/") if p]
    if any(p in (".", "..") for p in parts):
        raise StoreError(f"key {key!r} leaves the store")
    return "/".join(parts)


def _cut(data: bytes | None, start: int | None, stop: int | None) -> bytes | None:
    return data if data is None or start is None else data[start:stop]


class Store:
    """``get(key, start, stop)`` gives bytes or None; a negative start counts from the end. ``shared`` stores can be
    written by executors."""

    shared = False
    listable = True

    def get(self, key: str, start: int | None = None, stop: int | None = None) -> bytes | None:
        raise NotImplementedError

    def set(self, key: str, data: bytes) -> None:
        raise StoreError(f"{type(self).__name__} is read-only")

    def delete(self, key: str) -> None:
        raise StoreError(f"{type(self).__name__} is read-only")

    def exists(self, key: str) -> bool:
        return self.size(key) >= 0

    def size(self, key: str) -> int:
        """Bytes, or -1 without the key."""
        data = self.get(key)
        return -1 if data is None else len(data)

    def list(self, prefix: str = "") -> list[str]:
        """All keys below a prefix, relative to the store, in order."""
        raise StoreError(f"{type(self).__name__} can't list keys")

    def children(self, prefix: str = "") -> list[str]:
        """Names directly below a prefix."""
        start = f"{_safe(prefix)}/" if _safe(prefix) else ""
        return sorted({k[len(start) :].split("/")[0] for k in self.list(prefix)})

    def stream(self, key: str, start: int | None = None, stop: int | None = None) -> io.BytesIO | None:
        data = self.get(key, start, stop)
        return None if data is None else io.BytesIO(data)

    def handle(self, *parts: str) -> Handle:
        return Handle(self, _safe("/".join(parts)))


@dataclass(frozen=True)
class FileStore(Store):
    """A folder of a file system: local, S3 or HDFS."""

    url: str
    shared = True

    def _at(self, key: str = "") -> tuple[pafs.FileSystem, str]:
        key = _safe(key)
        if "://" in self.url or self.url.startswith("file:/"):
            fs, root = pafs.FileSystem.from_uri(self.url if "://" in self.url else self.url.replace("file:/", "file:///", 1))
        else:
            fs, root = pafs.LocalFileSystem(), self.url
        return fs, f"{root.rstrip('/')}/{key}" if key else root.rstrip("/") or "/"

    def get(self, key, start=None, stop=None):
        fs, path = self._at(key)
        try:
            with fs.open_input_file(path) as f:
                if start is None:
                    return f.read()
                size = f.size()
                start = max(0, size + start) if start < 0 else min(start, size)
                f.seek(start)
                return f.read((size if stop is None else min(stop, size)) - start)
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None
        except OSError as e:
            if fs.get_file_info(path).type != pafs.FileType.File:
                return None
            raise StoreError(f"can't read {key!r}: {e}") from e

    def set(self, key, data):
        """Written beside and moved, so no reader meets a part of it."""
        fs, path = self._at(key)
        aside = f"{path}.{uuid.uuid4().hex}.tmp"
        try:
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(aside) as f:
                f.write(data)
            fs.move(aside, path)
        except OSError as e:
            raise StoreError(f"can't write {key!r}: {e}") from e

    def delete(self, key):
        fs, path = self._at(key)
        try:
            fs.delete_file(path)
        except FileNotFoundError:
            pass
        except OSError as e:
            if fs.get_file_info(path).type == pafs.FileType.File:
                raise StoreError(f"can't delete {key!r}: {e}") from e

    def size(self, key):
        info = (fs := self._at(key))[0].get_file_info(fs[1])
        return info.size if info.type == pafs.FileType.File else -1

    def list(self, prefix=""):
        fs, root = self._at()
        found = fs.get_file_info(pafs.FileSelector(self._at(prefix)[1], allow_not_found=True, recursive=True))
        cut = len(root.rstrip("/")) + 1
        return sorted(i.path[cut:] for i in found if i.type == pafs.FileType.File and not i.path.endswith(".tmp"))

    def children(self, prefix=""):
        found = (fs := self._at(prefix))[0].get_file_info(pafs.FileSelector(fs[1], allow_not_found=True))
        return sorted(i.base_name for i in found if not i.base_name.endswith(".tmp"))


@dataclass(frozen=True)
class MemoryStore(Store):
    """Keys in this process. Scans send a copy to the executors; their writes come back through the driver."""

    name: str = ""
    held: dict[str, bytes] = field(default_factory=dict, compare=False, repr=False)

    def get(self, key, start=None, stop=None):
        return _cut(self.held.get(_safe(key)), start, stop)

    def set(self, key, data):
        self.held[_safe(key)] = bytes(data)

    def delete(self, key):
        self.held.pop(_safe(key), None)

    def list(self, prefix=""):
        start = f"{_safe(prefix)}/" if _safe(prefix) else ""
        return sorted(k for k in self.held if k.startswith(start))


@dataclass(frozen=True)
class HttpStore(Store):
    """GET and HEAD with byte ranges. Failed connections and server errors are tried again, other errors are not."""

    url: str
    timeout: float = 60.0
    retries: int = 3
    delay: float = 1.0
    listable = False

    def _asked(self, key: str, method: str = "GET", headers: dict | None = None):
        request = urllib.request.Request(f"{self.url.rstrip('/')}/{_safe(key)}", method=method, headers=headers or {})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return answer.status, answer.headers, answer.read()
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code == 416:
                    return 416, e.headers, b""
                if e.code < 500 or attempt == self.retries:
                    raise StoreError(f"can't read {key!r}: HTTP {e.code}") from e
            except OSError as e:
                if attempt == self.retries:
                    raise StoreError(f"can't read {key!r}: {e}") from e
            time.sleep(self.delay)

    def get(self, key, start=None, stop=None):
        asked = None if start is None else f"bytes={start}" if start < 0 else f"bytes={start}-{'' if stop is None else stop - 1}"
        answer = self._asked(key, headers={"Range": asked} if asked else None)
        if answer is None:
            return None
        return _cut(answer[2], start, stop) if asked and answer[0] == 200 else answer[2]  # 200: ranges are not served

    def size(self, key):
        answer = self._asked(key, "HEAD")
        return -1 if answer is None else int(answer[1].get("Content-Length") or -1)


@dataclass(frozen=True)
class ZipStore(Store):
    """A ZIP file, read-only; its central directory gives random access."""

    path: str

    def _open(self) -> zipfile.ZipFile:
        return zipfile.ZipFile(pa.OSFile(self.path) if "://" not in self.path else pafs.FileSystem.from_uri(self.path)[0].open_input_file(pafs.FileSystem.from_uri(self.path)[1]))

    def get(self, key, start=None, stop=None):
        with self._open() as z:
            try:
                return _cut(z.read(_safe(key)), start, stop)
            except KeyError:
                return None

    def size(self, key):
        with self._open() as z:
            try:
                return z.getinfo(_safe(key)).file_size
            except KeyError:
                return -1

    def list(self, prefix=""):
        start = f"{_safe(prefix)}/" if _safe(prefix) else ""
        with self._open() as z:
            return sorted(n for n in z.namelist() if n.startswith(start) and not n.endswith("/"))

    @property
    def comment(self) -> str | None:
        with self._open() as z:
            return z.comment.decode() or None


class BufferedZipStore(MemoryStore):
    """A ZIP file held in memory and written as a whole on ``flush`` or ``close``, or on every change with
    ``flush_on_write``. Entries are stored uncompressed, documents of the root first."""

    def __init__(self, path: str, flush_on_write: bool = False, comment: str | None = None):
        super().__init__(path)
        object.__setattr__(self, "path", path)
        object.__setattr__(self, "flush_on_write", False)
        object.__setattr__(self, "comment", comment)
        old = ZipStore(path)
        if FileStore(path.rsplit("/", 1)[0] or "/").exists(path.rsplit("/", 1)[-1]):
            for key in old.list():
                super().set(key, old.get(key))
            object.__setattr__(self, "comment", comment if comment is not None else old.comment)
        object.__setattr__(self, "flush_on_write", flush_on_write)

    def set(self, key, data):
        super().set(key, data)
        if self.flush_on_write:
            self.flush()

    def delete(self, key):
        super().delete(key)
        if self.flush_on_write:
            self.flush()

    def set_comment(self, comment: str | None) -> None:
        object.__setattr__(self, "comment", comment)

    def flush(self) -> None:
        order = sorted(self.held, key=lambda k: (not k.endswith("zarr.json"), k.count("/") if k.endswith("zarr.json") else 0, k))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for key in order:
                z.writestr(key, self.held[key])
            z.comment = (self.comment or "").encode()
        folder, _, name = self.path.rpartition("/")
        FileStore(folder or "/").set(name, out.getvalue())

    close = flush

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


_memory: dict[str, MemoryStore] = {}


def store_for(url: str) -> Store:
    if url.startswith(("http://", "https://")):
        return HttpStore(url)
    if url.startswith("zip://"):
        return ZipStore(url[len("zip://") :])
    if url.startswith("memory://"):
        return _memory.setdefault(url, MemoryStore(url))
    return FileStore(url)


@dataclass(frozen=True)
class Handle:
    """A place in a store."""

    store: Store
    prefix: str = ""

    def key(self, key: str = "") -> str:
        return "/".join(p for p in (self.prefix, key) if p)

    def resolve(self, *parts: str) -> Handle:
        return Handle(self.store, self.key(_safe("/".join(parts))))

    def read(self, key: str = "", start: int | None = None, stop: int | None = None) -> bytes | None:
        return self.store.get(self.key(key), start, stop)

    def read_existing(self, key: str = "") -> bytes:
        if (data := self.read(key)) is None:
            raise StoreError(f"there is no {self.key(key)!r}")
        return data

    def set(self, data: bytes, key: str = "") -> None:
        self.store.set(self.key(key), data)

    def delete(self, key: str = "") -> None:
        self.store.delete(self.key(key))

    def exists(self, key: str = "") -> bool:
        return self.store.exists(self.key(key))

    def size(self, key: str = "") -> int:
        return self.store.size(self.key(key))

    def list(self) -> list[str]:
        cut = len(self.prefix) + 1 if self.prefix else 0
        return [k[cut:] for k in self.store.list(self.prefix)]

    def children(self) -> list[str]:
        return self.store.children(self.prefix)

    def __str__(self) -> str:
        return f"{getattr(self.store, 'url', None) or getattr(self.store, 'path', None) or getattr(self.store, 'name', '')}/{self.prefix}".rstrip("/")


def handle_for(where) -> Handle:
    """Of a handle, store, path or URL."""
    if isinstance(where, Handle):
        return where
    return where.handle() if isinstance(where, Store) else Handle(store_for(str(where)))
