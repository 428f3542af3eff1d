from graphloom.functions.scalars import fnv1a, normalize_space
from graphloom.sources.extract import analyze
from graphloom.sources.scan import fnv_many

CPP = """#include "shape.hpp"
#include <vector>

namespace geo {
class Shape;
struct Point { int x; int y; };

class Circle : public Base<int> {
public:
  explicit Circle(int r) : radius_(make(r)) {}
  int area(int scale) const;
  ~Circle();
private:
  int radius_;
};

int twice(int v), thrice(int v);

namespace {
int hidden() { return 1; }
}

int Circle::area(int scale) const {
  auto n = static_cast<int>(scale);
  Point p(1, 2);
  if (n > 0) { helper(n, scale); }
  this->grow(n);
  geo::detail::run<int>(n);
  pick<int>(n);
  (*callback)(n);
  table[n](1);
  return twice(hidden());
}
}  // namespace geo
"""

PY = '''import os, sys as system
from . import one, two as second
from .pkg import thing
from __future__ import annotations


@decorate(1)
class Service(Base, metaclass=Meta):
    x = make()

    def process(self, value: int = default()) -> int:
        self.step(value)
        other.step(value, key=1)
        return [f(v) for v in value][0]()

    async def run(self): ...


def free(a,
         b):
    def inner():
        return sum(x for x in a)
    return inner()
'''


def test_cpp():
    a = analyze("src/circle.cpp", "cpp", CPP.encode())
    assert a["status"] == "parsed" and not a["diagnostics"]
    assert [(i["target"], i["is_system"]) for i in a["includes"]] == [("shape.hpp", False), ("vector", True)]
    got = [(s["kind"], s["role"], s["qualified_name"], s["signature"]) for s in a["symbols"]]
    assert got == [
        ("class", "declaration", "geo::Shape", ""),
        ("struct", "definition", "geo::Point", ""),
        ("class", "definition", "geo::Circle", ""),
        ("method", "definition", "geo::Circle::Circle", "Circle(int r)"),
        ("method", "declaration", "geo::Circle::area", "area(int scale) const"),
        ("method", "declaration", "geo::Circle::~Circle", "~Circle()"),
        ("function", "declaration", "geo::thrice", "thrice(int v)"),
        ("function", "declaration", "geo::twice", "twice(int v)"),
        ("function", "definition", "geo::(anonymous)::hidden", "hidden()"),
        ("method", "definition", "geo::Circle::area", "Circle::area(int scale) const"),
    ]
    calls = [(c["caller_qualified_name"], c["callee_text"], c["callee_name"], c["form"], c["argument_count"]) for c in a["calls"]]
    assert calls == [
        ("geo::Circle::Circle", "make", "make", "unqualified", 1),
        ("geo::Circle::area", "helper", "helper", "unqualified", 2),
        ("geo::Circle::area", "this->grow", "grow", "member", 1),
        ("geo::Circle::area", "geo::detail::run<int>", "run", "qualified", 1),
        ("geo::Circle::area", "pick<int>", "pick", "unqualified", 1),
        ("geo::Circle::area", "(*callback)", "(*callback)", "indirect", 1),
        ("geo::Circle::area", "table[n]", "table[n]", "indirect", 1),
        ("geo::Circle::area", "twice", "twice", "unqualified", 1),
        ("geo::Circle::area", "hidden", "hidden", "unqualified", 0),
    ]


def test_places_are_bytes():
    a = analyze("a.cpp", "cpp", "// é\nint f() { return é(); }\nint g();\n".encode())
    r = {s["name"]: s["range"] for s in a["symbols"]}
    assert (r["f"]["start_line"], r["f"]["start_column"], r["f"]["start_byte"]) == (2, 1, 6)
    assert (r["g"]["start_line"], r["g"]["start_byte"], r["g"]["end_byte"]) == (3, 31, 39)


def test_malformed_and_unknown():
    assert analyze("a.cpp", "cpp", b"int ok() { return 1; }\nint broken( {\n")["diagnostics"]
    a = analyze("m.py", "python", b"def ok():\n    pass\n\ndef broken(:\n    pass\n")
    assert [d["code"] for d in a["diagnostics"]] == ["syntax-error"] and [s["name"] for s in a["symbols"]] == ["ok"]
    a = analyze("x.rs", "rust", b"")
    assert (a["status"], a["diagnostics"][0]["code"], a["diagnostics"][0]["message"]) == ("failed", "analysis-failed", "unsupported language")


def test_python():
    a = analyze("app/service.py", "python", PY.encode())
    assert [i["target"] for i in a["includes"]] == ["os", "sys", ".one", ".two", ".pkg"]
    got = [(s["kind"], s["qualified_name"], s["signature"]) for s in a["symbols"]]
    assert got == [
        ("class", "app.service::Service", "Service(Base, metaclass=Meta)"),
        ("method", "app.service::Service::process", "process(self, value:int = default()) -> int"),
        ("method", "app.service::Service::run", "async run(self)"),
        ("function", "app.service::free", "free(a, b)"),
        ("function", "app.service::free::inner", "inner()"),
    ]
    calls = [(c["caller_qualified_name"].rpartition("::")[2], c["callee_text"], c["callee_name"], c["form"], c["argument_count"]) for c in a["calls"]]
    assert ("process", "step", "step", "unqualified", 1) in calls and ("process", "other.step", "step", "member", 2) in calls
    assert ("process", "default", "default", "unqualified", 0) in calls and ("inner", "sum", "sum", "unqualified", 1) in calls
    assert not any(c[1] in ("decorate", "make") for c in calls)
    assert [c[3] for c in calls if c[1].startswith("[")] == ["indirect"]


def test_scalars():
    assert fnv1a(b"abc") == "e71fa2190541574b"
    data = [b"", b"abc", b"x" * 9000, b"abc", bytes(range(256)) * 20]
    assert fnv_many(data) == [fnv1a(x) for x in data]
    assert normalize_space("( self ,  value : int )\n ->  x [ 1 ]") == "(self, value :int) -> x [1]"


def test_every_unpaired_bracket_is_diagnosed():
    a = analyze("a.cpp", "cpp", b"int broken( {\n  return 0;\n}\nint more() { ) }\nvoid open() {\n")
    assert [(d["code"], d["message"], d["range"]["start_line"]) for d in a["diagnostics"]] == [("missing-syntax", "parser expected )", 1), ("syntax-error", "unrecognized syntax", 4), ("missing-syntax", "parser expected }", 5)]


def test_wide_characters_cost_linear_time():
    import time

    text = "".join(f"// ééé 漢字 {i}\nint f{i}() {{ return g{i}(); }}\n" for i in range(6000))
    began = time.perf_counter()
    a = analyze("a.cpp", "cpp", text.encode())
    assert time.perf_counter() - began < 20 and len(a["symbols"]) == len(a["calls"]) == 6000
    for s in a["symbols"][::500]:
        r = s["range"]
        assert text.encode()[r["start_byte"] : r["end_byte"]].decode().startswith(f"int {s['name']}()")


def test_deep_expressions_are_read():
    deep = "def f():\n    return " + " + ".join(["g()"] * 3000) + "\n"
    a = analyze("m.py", "python", deep.encode())
    assert a["status"] == "parsed" and a["symbols"][0]["name"] == "f" and len(a["calls"]) == 3000
