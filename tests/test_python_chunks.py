"""Golden chunks of small Python sources."""

import pyarrow as pa

from lodestone.operators.python_chunks import definitions, enclosing, python_chunks

SOURCE = '''"""Pays."""
LIMIT, OTHER = 1, 2


@route("/pay")
def pay(x):
    """Outer."""
    def inner(y):
        return y
    return inner(x)


class Service(Base,
              metaclass=Meta):
    """Serves."""
    name: str = "x"

    async def run(self):
        class Local:
            size = 1
            print("kept")
        return Local

if LIMIT:
    def late(): return 3
'''


def rows(generation, **more):
    return [(c["symbol"], c["kind"], c["line_start"], c["line_end"]) for c in python_chunks("a.py", SOURCE, generation, **{"least": 1, "header": False} | more)]


def test_generation_one():
    assert rows(1) == [
        ("(module docstring)", "module_doc", 1, 1), ("LIMIT, OTHER", "assign", 2, 2), ("pay", "function", 5, 10),
        ("Service.__doc__", "docstring", 15, 15), ("Service.name", "class_assign", 16, 16), ("Service.run", "method", 18, 22),
    ]


def test_generation_two_goes_deep():
    assert rows(2) == [
        ("(module docstring)", "module_doc", 1, 1), ("LIMIT, OTHER", "assign", 2, 2), ("pay", "function", 5, 10), ("pay.inner", "function", 8, 9),
        ("Service", "class", 13, 14), ("Service.__doc__", "docstring", 15, 15), ("Service.name", "class_assign", 16, 16), ("Service.run", "method", 18, 22),
        ("Service.run.Local", "class", 19, 19), ("Service.run.Local.size", "class_assign", 20, 20), ("late", "function", 25, 25),
    ]


def test_nested_definitions_are_masked():
    text = {c["symbol"]: c["text"] for c in python_chunks("a.py", SOURCE, 2, least=1, header=False)}
    assert text["pay"] == '@route("/pay")\ndef pay(x):\n    """Outer."""\n    # <nested: pay.inner>\n\n    return inner(x)'
    assert text["Service.run"] == 'async def run(self):\n        # <nested: Service.run.Local>\n\n            print("kept")\n        return Local'
    assert text["pay.inner"] == "def inner(y):\n        return y"


def test_headers_short_chunks_and_marks():
    chunks = list(python_chunks("a.py", SOURCE, 3))
    assert [c["symbol"] for c in chunks] == ["pay", "pay.inner", "Service", "Service.run", "Service.run.Local", "Service.run.Local.size"]
    assert chunks[1]["text"].startswith("# a.py > def pay > def inner\ndef inner")
    assert len(definitions("﻿" + SOURCE, 3)) == len(definitions(SOURCE, 3))
    (window,) = python_chunks("a.py", "﻿" + SOURCE, 2, least=1)
    assert window["kind"] is None  # generation 2 cannot parse a mark


def test_long_definitions_are_cut():
    body = "def f():\n" + "".join(f"    x{i} = {i}\n" for i in range(100))
    parts = list(python_chunks("a.py", body, 3, longest=400, overlap=60))
    assert parts[0]["text"].startswith("# a.py > def f [part 1/") and parts[0]["line_start"] == 1 and parts[-1]["line_end"] == 101
    assert all(b["line_start"] <= a["line_end"] + 1 for a, b in zip(parts, parts[1:], strict=False))


def test_broken_source_and_enclosing():
    lines = ["class A:", "    def helper(self):", "        pass", "    def process(self):", "        x = 1", "        y = 2"]
    assert enclosing(lines, 5) == ["class A", "def process"] and enclosing(lines, 0) == []
    assert enclosing(["export function go() {", "  a()"], 1) == ["function go"]
    broken = list(python_chunks("a.py", "\n".join([*lines, "def ("] * 20), 3))
    assert broken and all(c["kind"] is None for c in broken)


def test_routes_have_their_prefixes():
    from lodestone.operators.chunks import route_lines

    source = '''
router = APIRouter(prefix="/pay")
app.include_router(router, prefix="/v1")
fake = MagicMock()

@router.get(f"/{kind}/x")
def a(): pass

@app.route("/b", methods=["post", "PUT"])
@fake.get("/no")
def b(): pass

class C:
    @app.delete(path="/c")
    def c(self): pass
'''
    assert route_lines(source) == [("GET", "/v1/pay/{kind}/x", 7), ("POST", "/b", 11), ("PUT", "/b", 11), ("DELETE", "/c", 15)]


def test_routes_belong_to_the_scope_of_their_decorator():
    from lodestone.operators.chunks import route_owners

    source = '''
from unittest import mock
app = FastAPI()
api = APIRouter(prefix="/api")

def make(api):
    @api.get("/hidden by a parameter")
    def a(): ...
    sub = APIRouter(prefix="/sub")
    @sub.post("/made here")
    def b():
        @app.get("/module's own")
        def c(): ...
    return sub

def fake():
    app = mock.Mock()
    @app.get("/mocked")
    def d(): ...

class Views:
    api = APIRouter(prefix="/class")
    @api.get("/of the class")
    def e(self):
        @api.get("/of the module")
        def f(): ...

@sub.get("/unknown owner")
def g(): ...

@api.route("/both", methods=["GET", "put"])
def h(): ...
'''
    assert [(m, p) for m, p, _, _ in route_owners(source)] == [
        ("POST", "/sub/made here"), ("GET", "/module's own"), ("GET", "/class/of the class"), ("GET", "/api/of the module"), ("GET", "/unknown owner"), ("GET", "/api/both"), ("PUT", "/api/both"),
    ]


def test_chunks_leave_a_task_in_slices(spark, monkeypatch):
    """However many rows a batch has, no more than a slice of chunks is held; all chunks come, a null id too."""
    from lodestone.operators import chunks

    monkeypatch.setattr(chunks, "SLICE_BYTES", 2_000)
    held = []
    made = pa.RecordBatch.from_pylist

    class Counted:
        from_pylist = staticmethod(lambda rows, schema: held.append(sum(len(r["text"]) for r in rows)) or made(rows, schema))

    text = "\n".join(f"line {i} of some text that is long enough" for i in range(200))
    docs = spark.createDataFrame([(None if i == 3 else i, "a.txt", text) for i in range(20)], "doc_id int, path string, text string")
    found = chunks.chunk(docs).collect()
    want = list(chunks.line_windows(text))
    assert len(found) == 20 * len(want) and sum(r.doc_id is None for r in found) == len(want)
    # the same function outside of Spark
    run = {}
    fake = type("Rows", (), {"select": lambda self, *a: self, "mapInArrow": lambda self, f, schema: run.update(f=f)})()
    chunks.chunk(fake)
    monkeypatch.setattr(pa, "RecordBatch", Counted)
    list(run["f"]([made([{"doc_id": i, "path": "a.txt", "text": text} for i in range(20)])]))
    assert len(held) > 20 and max(held) <= 2_000 + 1_300
