"""Chunkers on small sources: overlapping chunks, scopes, lines, imports and broken files."""

import time

from strandline.operators.chunking import chunk_file, chunk_files, file_headers

PY = """# head
import os
from a import b


class K(Base):
    @deco
    def m(self):
        def inner():
            return "é"
        return inner


@app.route("/")
async def home():
    return 1


if __name__ == "__main__":
    home()
"""
JAVA = """package a.b;
import java.util.List;
import java.util.*;
// a note with a brace {
@RestController
public class Song extends Base {
    private final int[] a = {1, 2};
    public Song(int q) { this.q = "}"; }
    @PostMapping("/send")
    public Mono<String> send(@RequestParam String query) { // ❌ {
        Runnable r = new Runnable() { public void run() { go(); } };
        return list.map(v -> { return v; });
    }
    interface I { void f(int x); }
}
enum Top { X, Y; int k() { return 1; } }
"""


def named(chunks):
    return [(c["name"], c["type"], c["start_line"], c["end_line"], c["parent_scope"]) for c in chunks]


def test_python():
    meta, chunks = chunk_file("p.py", PY, "py")
    assert named(chunks) == [
        ("K", "class_definition", 6, 11, "p.py"),
        ("m", "function_definition", 8, 11, "K"),
        ("inner", "function_definition", 9, 10, "K"),
        ("home", "function_definition", 15, 16, "p.py"),
        ("module_scope", "global_logic", 14, 20, "p.py"),
    ]
    assert meta["imports"] == ["import os", "from a import b"] and meta["exports"] == []
    assert meta["skeleton"][0] == "class_definition: class K(Base):,parent:p.py"
    assert 'return "é"' in chunks[2]["code"] and chunks[3]["code"].startswith("async def home")


def test_broken_python_is_cut_by_indentation():
    meta, chunks = chunk_file("p.py", PY.replace('"é"', '"é\n"'), "py")
    assert [c["name"] for c in chunks] == ["K", "m", "inner", "home", "module_scope"]
    assert meta["imports"] == ["import os", "from a import b"]


def test_java():
    meta, chunks = chunk_file("S.java", JAVA, "java")
    assert [(c["name"], c["type"], c["parent_scope"]) for c in chunks] == [
        ("Song", "class_declaration", "S.java"),
        ("send", "method_declaration", "Song"),
        ("run", "method_declaration", "Song"),
        ("I", "interface_declaration", "Song"),
        ("f", "method_declaration", "I"),
        ("k", "method_declaration", "Top"),
        ("module_scope", "global_logic", "S.java"),
    ]
    assert len(meta["imports"]) == 2 and meta["exports"] == []
    assert meta["skeleton"][:2] == ["class_declaration: public class Song extends Base {,parent:S.java", "method_declaration: public Mono<String> send(@RequestParam String query) { // ❌ {,parent:Song"]
    assert chunks[-1]["code"] == "package a.b;\n// a note with a brace {"


def test_other_languages():
    _, js = chunk_file("a.js", "import a from 'x';\nexport class A {\n  go(y) { return '}'; }\n}\nconst f = (z) => { return z; };\nlet q = 5;\n", "js")
    assert [c["name"] for c in js] == ["A", "go", "f", "module_scope"]
    _, go = chunk_file("a.go", "package m\ntype T struct {\n a int\n}\nfunc (t *T) M() error {\n return nil\n}\n", "go")
    assert [(c["name"], c["type"]) for c in go] == [("T", "type_declaration"), ("M", "method_declaration"), ("module_scope", "global_logic")]
    _, c = chunk_file("a.c", "#include <x.h>\nstruct P { int x; };\nint main(int a) {\n return 0;\n}\n", "c")
    assert [x["name"] for x in c] == ["P", "main"]
    _, html = chunk_file("a.html", "<div><p>a</p>\n<script>x</script></div>", "html")
    assert [(x["name"], x["type"], x["parent_scope"]) for x in html] == [("div", "element", "a.html"), ("p", "element", "div"), ("script", "script_element", "div")]


def test_fallback_and_blank():
    _, chunks = chunk_file("a.txt", "one\r\ntwo\n", "txt")
    assert named(chunks) == [("global_scope", "module", 1, 2, "a.txt")] and chunks[0]["code"] == "one\r\ntwo\n"
    assert chunk_file("a.py", " \n", "py")[1] == [] and chunk_file("a.py", "", "py")[1] == []


def test_deep_code_is_cut_quickly():
    """Thousands of levels neither raise nor take long; what is read by pattern is found at every level."""
    n = 2000
    sources = {
        "plus.py": "def f():\n    return " + " + ".join("a" for _ in range(n)) + "\n",
        "attr.py": "def f():\n    return a" + ".b" * n + "\n",
        "call.py": "def f():\n    return a" + "()" * n + "\n",
        "elif.py": "def f(a):\n    if a:\n        pass\n" + "    elif a:\n        pass\n" * n,
        "par.py": "def f():\n    return " + "(" * n + ")" * n + "\n",
        "lines.py": "def f(:\n" + "  x\n" * 20_000,
    }
    start = time.perf_counter()
    for path, code in sources.items():
        assert [c["name"] for c in chunk_file(path, code, "py")[1] if c["type"] == "function_definition"] == ["f"], path
    deep = 5000
    java = "".join(f"class C{i} {{ " for i in range(deep)) + "}" * deep
    assert len(chunk_file("a.java", java, "java")[1]) == deep
    inner = "class A { void f() { " + "new B() { void g() { " * n + "} } ;" * n + " } }"
    assert sum(c["name"] == "g" for c in chunk_file("a.java", inner, "java")[1]) == n
    js = "".join(f"function f{i}() {{ " for i in range(deep)) + "}" * deep
    assert len(chunk_file("a.js", js, "js")[1]) == deep
    html = "<div>" * deep + "</span>" * deep + "</div>" * deep
    assert len(chunk_file("a.html", html, "html")[1]) == deep
    assert time.perf_counter() - start < 20


def test_expressions_and_jsx():
    code = "const a = function () { return 1; };\nb.map(x => x + 1);\nc(function go() {});\nconst d = () => (\n  <ul id={k}>\n    <li>one</li>\n    <Item on={() => { go(); }} />\n  </ul>\n);\nconst e = x < y && z > 1;\n"
    found = [(c["name"], c["type"]) for c in chunk_file("a.js", code, "js")[1]]
    assert ("anonymous", "function_expression") in found and ("go", "function_expression") in found and ("anonymous", "arrow_function") in found
    assert [x for x in found if x[1].startswith("jsx")] == [("ul", "jsx_element"), ("li", "jsx_element"), ("Item", "jsx_self_closing_element")]


def test_frames(spark):
    files = spark.createDataFrame([("r", "p.py", "py", PY), ("r", "n.py", "py", None), ("r", "e.xx", "xx", "")], "repo_id string, path string, language string, content string")
    assert chunk_files(files).count() == 5
    heads = {r.file_path: r for r in file_headers(files).collect()}
    assert heads["p.py"].chunks_indexed == 5 and heads["n.py"].chunks_indexed == 0
