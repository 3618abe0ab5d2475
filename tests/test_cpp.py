"""C and C++ sources against tables made by hand."""

import time

from sparkloom.sources.cpp import cpp_symbols, module_symbols

SHAPES = r'''
#include <vector>
#include "shapes/base.h"
// class NotHere { void f(); };
/* int also_not(); */
#define MAKE(x) struct x { int a; }
#if 0
void hidden() { nothing(); }
#else
void seen() { helper(1); }
#endif
#ifdef WINDOWS
int one_branch() {
#else
int other_branch() {
#endif
  return pick(); }

namespace geo::flat {
enum class Kind { circle, square };
template <typename T, int N = (1 > 0)>
class Shape : public Base<T>, private util::Named {
 public:
  Shape() : Base<T>(), size_{0}, name_("x { y") { init(); }
  virtual ~Shape() = default;
  virtual double area() const = 0;
  bool operator()(int a) const { return check(a); }
  Shape& operator=(const Shape& o);
  struct Inner { int v; int get() { return v; } };
 private:
  int size_{3};
  std::vector<int> items_ = {1, 2, 3};
};
namespace { int local(int n) { return n > 0 ? local(n - 1) : 0; } }
}  // namespace

extern "C" {
int c_function(const char *s, int (*callback)(int));
}
double geo::flat::total(const std::vector<Shape*>& all) {
  double sum = 0; auto f = [&](int x) { return weigh(x); };
  for (auto* s : all) { sum += s->area(); if (s) geo::log("call(1)"); }
  Point p(1, 2); std::sort(all.begin(), all.end());
  auto r = R"(fake() { )" "more() }"; char q = '"'; int big = 1'000'000;
  return static_cast<double>(sum) + f(2);
}
int table[] = { 1, 2 };
static struct { int z; } unnamed;
int x = compute(3);
'''


def test_a_source_with_everything():
    rows = module_symbols("s.cpp", SHAPES)
    cards = {(r[1], r[3]) for r in rows if r[0] == "card"}
    g = "geo::flat::"
    assert cards == {
        ("s.cpp", "module"), ("seen", "function"), ("one_branch", "function"), (g + "Shape", "class"), (g + "Shape::Shape", "method"), (g + "Shape::~Shape", "method"), (g + "Shape::area", "method"),
        (g + "Shape::operator()", "method"), (g + "Shape::operator=", "method"), (g + "Shape::Inner", "struct"), (g + "Shape::Inner::get", "method"), (g + "local", "function"), ("c_function", "declaration"), (g + "total", "function"),
    }
    assert {(r[1], r[2]) for r in rows if r[0] == "calls"} == {
        ("seen", "helper"), ("one_branch", "pick"), (g + "Shape::Shape", "init"), (g + "Shape::operator()", "check"), (g + "local", "local"),
        (g + "total", "weigh"), (g + "total", "area"), (g + "total", "geo::log"), (g + "total", "std::sort"), (g + "total", "begin"), (g + "total", "end"), (g + "total", "f"),
    }
    assert {(r[1], r[2]) for r in rows if r[0] == "implements"} == {(g + "Shape", "Base"), (g + "Shape", "util::Named")}
    assert {(r[1], r[2]) for r in rows if r[0] == "imports"} == {("s.cpp", "vector"), ("s.cpp", "shapes/base.h")}
    contains = {(r[1], r[2]) for r in rows if r[0] == "contains"}
    assert (g + "Shape", g + "Shape::area") in contains and (g + "Shape", g + "Shape::Inner") in contains and ("s.cpp", g + "Shape") in contains and ("s.cpp", "c_function") in contains
    spans = {r[1]: (r[4], r[5]) for r in rows if r[0] == "card"}
    lines = SHAPES.split("\n")
    assert lines[spans["seen"][0] - 1].startswith("void seen") and lines[spans[g + "Shape"][0] - 1].startswith("template") and lines[spans[g + "Shape"][1] - 1] == "};" and lines[spans[g + "total"][1] - 1] == "}"


def test_sources_that_are_not_balanced_or_not_there(spark):
    assert [r[:2] for r in module_symbols("a.c", "}}}} int f() { g(")] == [("card", "a.c"), ("card", "f"), ("contains", "a.c"), ("calls", "f")]
    assert module_symbols("a.h", None) == [("card", "a.h", "a.h", "module", 1, 1)]
    frame = spark.createDataFrame([("a.c", "int f() { return g(); }"), ("b.h", None), (None, "class A { void m(); };")], "path string, source string")
    found = {(r.kind, r.src, r.dst, r.label) for r in cpp_symbols(frame).collect()}
    assert found == {("card", "a.c", "a.c", "module"), ("card", "f", "f", "function"), ("contains", "a.c", "f", None), ("calls", "f", "g", None), ("card", "b.h", "b.h", "module"), ("card", "", "", "module"), ("card", "A", "A", "class"), ("contains", "", "A", None), ("card", "A::m", "m", "method"), ("contains", "A", "A::m", None)}
    for source in ("{" * 50_000, "(" * 50_000, "/*" * 50_000, '"' * 50_000, 'R"(' * 50_000, "#if 1\n" * 20_000, "a::" * 50_000, "int f() {" + "g();" * 50_000 + "}"):
        began = time.time()
        module_symbols("x", source)
        assert time.time() - began < 15
