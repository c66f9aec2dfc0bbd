import http.server
import threading
import zipfile

import numpy as np
import pytest

from gridloom.errors import StoreError
from gridloom.meta import SpecBuilder
from gridloom.operators.array import Array
from gridloom.operators.hierarchy import Group
from gridloom.sources.stores import BufferedZipStore, FileStore, HttpStore, MemoryStore, ZipStore, handle_for


@pytest.fixture(params=["file", "uri", "memory", "zip"])
def store(request, tmp_path):
    return {"file": lambda: FileStore(str(tmp_path)), "uri": lambda: FileStore(f"file://{tmp_path}"), "memory": MemoryStore, "zip": lambda: BufferedZipStore(str(tmp_path / "a.zip"))}[request.param]()


def test_contract(store):
    assert not store.exists("a/b") and store.get("a/b") is None and store.size("a/b") == -1 and store.list() == []
    store.set("a/b", b"0123456789")
    store.set("/a/c", b"x")
    store.set("d", b"")
    assert store.get("a/b") == b"0123456789" and store.get("a/b", 2) == b"23456789" and store.get("a/b", 2, 5) == b"234" and store.get("a/b", -3) == b"789"
    assert store.exists("a/c") and not store.exists("a") and store.size("a/b") == 10 and store.size("d") == 0
    assert store.list() == ["a/b", "a/c", "d"] and store.list("a") == ["a/b", "a/c"] and store.children() == ["a", "d"] and store.children("a") == ["b", "c"]
    assert store.stream("a/b", 1, 3).read() == b"12"
    store.set("a/b", b"new")
    assert store.get("a/b") == b"new"
    store.delete("a/b")
    store.delete("a/b")
    assert store.list("a") == ["a/c"]
    h = store.handle("a")
    assert h.read("c") == b"x" and h.children() == ["c"] and h.list() == ["c"] and h.resolve("c").exists() and h.resolve("c").size() == 1
    with pytest.raises(StoreError):
        h.read_existing("nothing")
    for key in ("../x", "a/../../x"):
        with pytest.raises(StoreError):
            store.get(key)


def test_zip(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    with BufferedZipStore(path, comment="hello") as store:
        Group.create(store)
        array = Array.create(store.handle("sub", "array"), SpecBuilder().with_shape(9, 9).with_dtype("int32").with_chunks(4, 4))
        array.write(np.arange(81).reshape(9, 9))
    names = zipfile.ZipFile(path).namelist()
    assert names[:2] == ["zarr.json", "sub/array/zarr.json"] and all(i.compress_type == zipfile.ZIP_STORED for i in zipfile.ZipFile(path).infolist())
    read = ZipStore(path)
    assert read.comment == "hello" and (Array.open(read.handle("sub", "array")).read() == np.arange(81).reshape(9, 9)).all()
    assert (Array.open(read.handle("sub", "array")).read((3, 3), (5, 5), spark=spark) == np.arange(81).reshape(9, 9)[3:8, 3:8]).all()
    with pytest.raises(StoreError):
        read.set("x", b"")
    again = BufferedZipStore(path, flush_on_write=True)
    again.set("more", b"1")
    again.set_comment(None)
    again.delete("zarr.json")
    assert ZipStore(path).get("more") == b"1" and ZipStore(path).comment is None and not ZipStore(path).exists("zarr.json")


class Handler(http.server.SimpleHTTPRequestHandler):
    fail, seen, ranges = 0, 0, True

    def do_GET(self):
        Handler.seen += 1
        if Handler.fail > 0:
            Handler.fail -= 1
            self.send_error(503)
            return
        path = self.translate_path(self.path)
        try:
            data = open(path, "rb").read()
        except OSError:
            self.send_error(404)
            return
        asked = self.headers.get("Range") if Handler.ranges else None
        if asked:
            a, b = asked.removeprefix("bytes=").split("-")
            data = data[-int(b) :] if not a else data[int(a) : int(b) + 1 if b else None]
        self.send_response(206 if asked else 200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(data)

    do_HEAD = do_GET

    def log_message(self, *_):
        pass


@pytest.fixture
def server(tmp_path):
    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), lambda *a: Handler(*a, directory=str(tmp_path)))
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def test_http(spark, tmp_path, server):
    spec = SpecBuilder().with_shape(8, 8).with_dtype("uint16").with_chunks(8, 8).with_codecs(lambda c: c.sharding(4, 4))
    Array.create(str(tmp_path), spec).write(np.arange(64).reshape(8, 8))
    store = HttpStore(server, retries=2, delay=0.01)
    (tmp_path / "x").write_bytes(b"0123456789")
    assert store.get("x", 2, 4) == b"23" and store.get("x", -2) == b"89" and store.size("x") == 10 and store.get("none") is None and store.size("none") == -1
    assert (Array.open(store).read((1, 1), (3, 3)) == np.arange(64).reshape(8, 8)[1:4, 1:4]).all()
    assert Array.open(server).cells(spark).where("d0 = 7").count() == 8
    Handler.ranges = False
    assert store.get("x", 2, 4) == b"23" and store.get("x", -2) == b"89"
    Handler.ranges, Handler.fail, Handler.seen = True, 2, 0
    assert store.get("x") == b"0123456789" and Handler.seen == 3
    Handler.fail = 3
    with pytest.raises(StoreError):
        store.get("x")
    Handler.fail = 0
    for call in (lambda: store.set("a", b""), lambda: store.delete("a"), store.list):
        with pytest.raises(StoreError):
            call()
    assert handle_for(server).store == HttpStore(server)
