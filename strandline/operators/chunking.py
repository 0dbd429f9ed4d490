"""[CHK-*] Cuts source files into syntax-level chunks, one file to many rows.

Python files go through the standard library's ``ast``. The others are read as text whose comments and strings are
blanked out, so that declarations can be found by pattern and their ends by matching braces. Overlapping chunks are
kept: a class is a chunk and so is each of its methods. A file that gives no chunk, or does not parse, is one chunk.

Broken files still give chunks: a Python file that ``ast`` refuses is cut by its indentation, and a string may run on
for a few lines until its closing quote.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandline.functions.batches import slices
from strandline.schemas import CHUNK

#: Fixed values of the languages: what is a chunk, and what gives its name to what is inside.
NODE_TYPES = {
    "py": ("function_definition", "class_definition"),
    "java": ("method_declaration", "class_declaration", "interface_declaration"),
    "js": (
        "function_declaration", "function_expression", "arrow_function", "generator_function_declaration", "class_declaration",
        "method_definition", "jsx_element", "jsx_self_closing_element",
    ),
    "ts": (
        "function_declaration", "function_expression", "arrow_function", "class_declaration", "method_definition", "jsx_element",
        "jsx_self_closing_element",
    ),
    "go": ("function_declaration", "method_declaration", "type_declaration"),
    "c": ("function_definition", "struct_specifier"),
    "html": ("element", "script_element", "style_element"),
}
ANONYMOUS = "anonymous"
PARENT_TYPES = {
    "py": ("class_definition",),
    "java": ("class_declaration", "interface_declaration", "enum_declaration"),
    "js": ("class_declaration",),
    "ts": ("class_declaration", "interface_declaration", "enum_declaration"),
    "go": ("type_declaration",),
    "c": ("struct_specifier", "union_specifier", "enum_specifier"),
    "html": ("element",),
}
_LINE_ENDS = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


@dataclass
class Found:
    """A declaration: [start, end) of the text."""

    kind: str
    name: str
    start: int
    end: int
    inner: list[Found] = field(default_factory=list)


@dataclass
class Parsed:
    """What a language's reader gives: declarations, and the spans of imports, exports and of other top-level code."""

    found: list[Found]
    imports: list[tuple[int, int]] = field(default_factory=list)
    exports: list[tuple[int, int]] = field(default_factory=list)
    loose: list[tuple[int, int]] = field(default_factory=list)


# -- Python ----------------------------------------------------------------------------------------------------------


class _Offsets:
    """Turns ast's (line, column in UTF-8 bytes) into offsets of the text."""

    def __init__(self, text: str):
        self.lines = re.split("(?<=\n)|(?<=\r)(?!\n)", text)
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line))

    def at(self, line: int, column: int) -> int:
        text = self.lines[line - 1]
        return self.starts[line - 1] + (column if text.isascii() else len(text.encode()[:column].decode(errors="replace")))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)


_PY_BLANKED = re.compile(
    r'#[^\n]*|"""(?:\\.|.)*?(?:"""|\Z)|\'\'\'(?:\\.|.)*?(?:\'\'\'|\Z)'
    r'|"(?:\\.|[^"\\\n])*(?:\n(?:\\.|[^"\\\n])*){0,3}"|\'(?:\\.|[^\'\\\n])*(?:\n(?:\\.|[^\'\\\n])*){0,3}\'',
    re.DOTALL,
)
_PY_DECLARED = re.compile(r"(async\s+def|def|class)\s+(\w+)")


def read_python_lines(text: str) -> Parsed:
    """Declarations by indentation, for files that do not parse."""
    code = _PY_BLANKED.sub(lambda m: " " * len(m[0]) if m[0][0] == "#" else re.sub(r"[^\n]", "s", m[0]).replace("\n", " "), text)
    depth, at = 0, 0
    begins: list[tuple[int, int]] = []  # (place, indentation) of each logical line
    for line in code.splitlines(keepends=True):
        bare = line.strip()
        if bare and not depth:
            begins.append((at + len(line) - len(line.lstrip()), len(line) - len(line.lstrip())))
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
        at += len(line)
    ends = [len(code.rstrip())] * len(begins)
    inside: list[int] = []
    for i, (place, indent) in enumerate([*begins, (len(code), -1)]):
        last = len(code) - len(code[place:]) if i == len(begins) else place
        while last and code[last - 1].isspace():
            last -= 1
        while inside and begins[inside[-1]][1] >= indent:
            ends[inside.pop()] = last
        inside.append(i)
    found = [
        Found("class_definition" if m[1] == "class" else "function_definition", m[2], place, end)
        for (place, _), end in zip(begins, ends, strict=True)
        if (m := _PY_DECLARED.match(code, place))
    ]
    parsed = Parsed(nest(found))
    joined = re.compile(r"(?:else|elif|except|finally)\b")
    tops = [(b, e) for (b, indent), e in zip(begins, ends, strict=True) if not indent]
    i = 0
    while i < len(tops):
        start, end = tops[i]
        while i + 1 < len(tops) and (joined.match(code, tops[i + 1][0]) or code[start] == "@"):
            i += 1
            end = tops[i][1]
            if code[tops[i][0]] != "@" and code[start] == "@":
                break
        i += 1
        if re.match(r"import\b|from\s+(?!__future__)", code[start:end]):
            parsed.imports.append((start, end))
        elif not _PY_DECLARED.match(code, start):
            parsed.loose.append((start, end))
    return parsed


def read_python(text: str) -> Parsed:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return read_python_lines(text)
    where = _Offsets(text)

    found: list[Found] = []
    todo: list[tuple[ast.AST, list[Found]]] = [(tree, found)]
    lists = [found]
    while todo:  # a stack of its own: expressions may be thousands of levels deep
        node, out = todo.pop()
        for child in ast.iter_child_nodes(node):
            below = out
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class_definition" if isinstance(child, ast.ClassDef) else "function_definition"
                below = []
                lists.append(below)
                out.append(Found(kind, child.name, *where.span(child), below))
            todo.append((child, below))
    for out in lists:
        out.sort(key=lambda f: f.start)

    parsed = Parsed(found)
    for node in tree.body:
        start, end = where.span(node)
        decorators = getattr(node, "decorator_list", None)
        if isinstance(node, ast.Import) or isinstance(node, ast.ImportFrom) and node.module != "__future__":
            parsed.imports.append((start, end))
        elif decorators:
            parsed.loose.append((text.rindex("@", 0, where.span(decorators[0])[0]), end))
        elif not isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            parsed.loose.append((start, end))
    return parsed


# -- languages with braces -------------------------------------------------------------------------------------------

_BLANKED = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*(?:\n(?:\\.|[^"\\\n])*){0,3}"|"[^\n]*|\'(?:\\.|[^\'\\\n])*\'?|`(?:\\.|[^`\\])*`?', re.DOTALL)


class Code(str):
    """Source text without comments and strings; ``close`` has the place after the bracket that closes each opening one."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.close, opened = {}, []
        for m in _BRACKETS.finditer(text):
            if m[0] in "([{":
                opened.append(m.start())
            elif opened:
                self.close[opened.pop()] = m.end()
        return self


_BRACKETS = re.compile(r"[()\[\]{}]")


def spaced(text: str) -> str:
    return "\n".join(" " * len(line) for line in text.split("\n"))


def blank(text: str) -> tuple[Code, list[tuple[int, int]]]:
    """The text with comments and strings replaced by spaces (line ends stay), and the spans of the comments."""
    comments = []

    def spaces(m: re.Match) -> str:
        if m[0].startswith(("//", "/*")):
            comments.append(m.span())
            return spaced(m[0])
        return spaced(m[0]) if len(m[0]) < 2 else m[0][0] + spaced(m[0][1:-1]) + m[0][-1]

    return Code(_BLANKED.sub(spaces, text)), comments


def match(code: Code, at: int, end: int) -> int:
    """The place after the bracket that closes the one at ``at``; ``end`` if there is none before it."""
    return min(code.close.get(at, end), end)


#: What lies between members, and what ends one or opens a bracket in it.
_BETWEEN, _MARK = re.compile(r"[\s;})\]]*"), re.compile(r"[;{=(\[]")


def members(code: Code, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, body start, body end) of each member of a type or file; without a body the last two are equal."""
    while (at := _BETWEEN.match(code, min(at, end), end).end()) < end:
        start, i, assigned = at, at, False
        while (i := m.start() if (m := _MARK.search(code, i, end)) else end) < end and code[i] != ";":
            if code[i] == "{" and not assigned:
                break
            if code[i] == "=" and code[i - 1] not in "=!<>" and code[i + 1 : i + 2] != "=":
                assigned = True
            i = match(code, i, end) if code[i] in "([{" else i + 1
        if i < end and code[i] == "{":
            stop = match(code, i, end)
            yield start, stop, i + 1, max(i + 1, stop - 1)
            at = stop
        else:
            yield start, min(end, i + 1), i, i
            at = i + 1


_ANNOTATION = re.compile(r"@(?!interface\b)[\w.]+\s*")
_JAVA_TYPE = re.compile(r"(?:^|\s)(class|interface|enum|record|@interface)\s+(\w+)")
_JAVA_METHOD = re.compile(r"(?P<type>[\w.$<>\[\],?&\s]*[\w>\]])\s+(?P<name>\w+)\s*\(")
_JAVA_WORDS = frozenset("public protected private static final abstract synchronized native strictfp default transient volatile sealed".split())
_JAVA_INNER = re.compile(r"\bnew\s+[\w.<>,\s?]+\(|\b(?:class|interface|enum|record)\s+\w+[^;{(]*\{")


_SPACE = re.compile(r"\s+")


def _header(code: Code, start: int, end: int) -> str:
    """A member's text up to its body, without annotations; runs of white space, blanked comments too, are one space."""
    out, at = [], start
    while m := _ANNOTATION.search(code, at, end):
        out.append(code[at : m.start()])
        at = match(code, m.end(), end) if code[m.end() : m.end() + 1] == "(" else m.end()
    return _SPACE.sub(" ", "".join([*out, code[at:end]]))


def _java_members(code: Code, at: int, end: int) -> list[Found]:
    """Declarations of a stretch of code; types inside types, and in bodies, wait on a stack of their own."""
    found: list[Found] = []
    lists = [found]
    todo: list[tuple[bool, int, int, bool, list[Found]]] = [(True, at, end, False, found)]  # (members or a body, from, to, enum, into)

    def declare(kind: str, name: str, start: int, stop: int, out: list[Found]) -> list[Found]:
        out.append(Found(kind, name, start, stop))
        lists.append(out[-1].inner)
        return out[-1].inner

    while todo:
        is_type, at, end, enum, out = todo.pop()
        if not is_type:
            todo += [(True, a, e, False, out) for a, e in _java_bodies(code, at, end)]
            continue
        if enum:  # the constants come before the first semicolon
            while at < end and code[at] != ";":
                at = match(code, at, end) if code[at] in "([{" else at + 1
        for start, stop, body, body_end in members(code, at, end):
            header = _header(code, start, body)
            if m := _JAVA_TYPE.search(header.split("(")[0] if "record" not in header else header):
                kind = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration"}.get(m[1], f"{m[1].strip('@')}_declaration")
                todo.append((True, body, body_end, m[1] == "enum", declare(kind, m[2], start, stop, out)))
                continue
            m = _JAVA_METHOD.search(header) if "=" not in header.split("(")[0] else None
            words = set(re.findall(r"\w+", m["type"])) if m else set()
            into = declare("method_declaration", m["name"], start, stop, out) if m and words - _JAVA_WORDS else out
            todo.append((False, body if body < body_end else start, body_end if body < body_end else stop, False, into))
    for out in lists:
        out.sort(key=lambda f: f.start)
    return found


def _java_bodies(code: Code, at: int, end: int) -> list[tuple[int, int]]:
    """Stretches of code with the members of local and anonymous classes inside code."""
    stretches, todo = [], [(at, end)]
    while todo:
        at, end = todo.pop()
        while m := _JAVA_INNER.search(code, at, end):
            if m[0].startswith("new"):
                after = match(code, m.end() - 1, end)
                brace = re.compile(r"\s*\{").match(code, after, end)
                todo.append((m.end(), after))
                at = after
                if brace:
                    at = match(code, brace.end() - 1, end)
                    stretches.append((brace.end(), at - 1))
            else:
                at = match(code, m.end() - 1, end)
                stretches.append((m.start(), at))
    return stretches


def read_java(text: str) -> Parsed:
    code, comments = blank(text)
    parsed = Parsed([])
    covered: list[tuple[int, int]] = []
    for start, stop, body, body_end in members(code, 0, len(code)):
        header = _header(code, start, body)
        if re.match(r"\s*import\b", header):
            parsed.imports.append((start, stop))
        elif (m := _JAVA_TYPE.search(header)) and m[1] in ("class", "interface", "enum"):
            parsed.found += _java_members(code, start, stop)
        else:
            if m:
                parsed.found += [x for f in _java_members(code, start, stop) for x in f.inner]
            parsed.loose.append((start, stop))
        covered.append((start, stop))
    # comments between members are code of the file in this language
    parsed.loose += [c for c in comments if not any(s <= c[0] < e for s, e in covered)]
    parsed.loose.sort()
    return parsed


#: Declarations of other languages: (kind, pattern with the name as its group, whether a body has to follow).
_PATTERNS: dict[str, list[tuple[str, str, bool]]] = {
    "js": [
        ("class_declaration", r"\bclass\s+(\w+)[^{;()]*", True),
        ("generator_function_declaration", r"\b(?:async\s+)?function\s*\*\s*(\w+)\s*\(", True),
        ("function_expression", r"(?<=[=(,:?\[!&|])\s*+(?:async\s+)?function\s*\*?\s*(\w*)\s*\(", True),
        ("function_declaration", r"\b(?:async\s+)?function\s+(\w+)\s*(?:<[^>{]*>)?\(", True),
        ("arrow_function", r"(?<=[(,:?\[])\s*+(?:async\s*)?()(?=(?:\([^()]*\)|\w+)\s*=>)", False),
        ("arrow_function", r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?=\([^()]*\)\s*(?::[^={]+)?=>|\w+\s*=>)", False),
        ("method_definition", r"(?<=[{};\n])(?![ \t]*+\n)[ \t]*+(?:(?:public|private|protected|static|readonly|async|get|set)\s+)*\*?\s*(?!(?:if|for|while|switch|catch|function|return|constructor\s*;)\b)(\w+)\s*\(", True),
    ],
    "go": [
        ("method_declaration", r"(?m)^func\s*\([^)]*\)\s*(\w+)\s*\(", True),
        ("function_declaration", r"(?m)^func\s+(\w+)\s*(?:\[[^\]]*\])?\(", True),
        ("type_declaration", r"(?m)^type\s+(\w+)\b[^\n{]*", False),
    ],
    "c": [
        ("struct_specifier", r"\bstruct\s+(\w+)\s*(?=\{)", True),
        ("function_definition", r"(?m)^(?!\s|#|typedef\b|struct\s+\w+\s*\{)[\w \t*]+?(?:\n[\w \t*]*?)?[\s*](\w+)\s*\(", True),
    ],
}
_PATTERNS["ts"] = [
    ("interface_declaration", r"\binterface\s+(\w+)[^{;]*", True),
    ("enum_declaration", r"\benum\s+(\w+)\s*", True),
    *_PATTERNS["js"],
]
_TOP = {
    "js": (r"(?m)^import\b[^;\n]*(?:\{[^}]*\}[^;\n]*)?;?", r"(?m)^export\b"),
    "go": (r"(?m)^import\s*(?:\([^)]*\)|\S[^\n]*)", None),
    "c": (r"(?m)^[ \t]*#[ \t]*include[^\n]*", None),
}
_TOP["ts"] = _TOP["js"]


_TAG = re.compile(r"<(/?)([A-Za-z][\w.:-]*)?(?=[\s/>])")
_BEFORE_JSX = re.compile(r"(?:[(,=?:&|>{\[;}]|\breturn|^)\s*\Z")


def jsx(code: Code) -> list[Found]:
    """JSX elements: a tag where an expression may begin, up to its end tag, or closed by itself."""
    found, opened, at = [], [], 0
    places: dict[str, int] = {}  # how many of each tag are open
    while m := _TAG.search(code, at):
        at, tag, start = m.end(), m[2] or "", m.start()
        if m[1]:
            end = code.find(">", at) + 1 or len(code)
            while places.get(tag) and opened:
                name, since = opened.pop()
                places[name] -= 1
                if name == tag:
                    found.append(Found("jsx_element", tag or ANONYMOUS, since, end))
                    break
            continue
        if not (opened or _BEFORE_JSX.search(code, max(0, start - 40), start)):
            continue
        while at < len(code) and code[at] not in "<>;":
            at = match(code, at, len(code)) if code[at] in "({[" else at + 1
        if at < len(code) and code[at] == ">":
            at += 1
            if code[at - 2] == "/":
                found.append(Found("jsx_self_closing_element", tag or ANONYMOUS, start, at))
            else:
                opened.append((tag, start))
                places[tag] = places.get(tag, 0) + 1
    return found


def read_braces(language: str) -> Callable[[str], Parsed]:
    patterns = [(kind, re.compile(p), body) for kind, p, body in _PATTERNS[language]]
    imports, exports = (re.compile(p) if p else None for p in _TOP[language])

    def read(text: str) -> Parsed:
        code, _ = blank(text)
        spans: dict[int, Found] = {}
        for kind, pattern, needs_body in patterns:
            for m in pattern.finditer(code):
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                at = match(code, m.end() - 1, len(code)) if m[0].endswith("(") else m.end()
                brace = re.compile(r"[^;{}()=]*(?:\{)" if needs_body else r"[^;\n{]*\{").match(code, at)
                if kind == "arrow_function":
                    arrow = code.find("=>", at)
                    brace = re.compile(r"\s*\{").match(code, arrow + 2)
                    at = arrow + 2
                if brace:
                    end = match(code, brace.end() - 1, len(code))
                elif needs_body:
                    continue
                else:
                    end = next((i for i in range(at, len(code)) if code[i] in ";\n"), len(code))
                spans.setdefault(start, Found(kind, m[1] or ANONYMOUS, start, end))
        if language in ("js", "ts"):
            for f in jsx(code):
                spans.setdefault(f.start, f)
        parsed = Parsed(nest(sorted(spans.values(), key=lambda f: (f.start, -f.end))))
        if imports:
            parsed.imports = [m.span() for m in imports.finditer(text)]
        if exports:
            starts = [f.start for f in parsed.found]
            for m in exports.finditer(code):
                i = bisect_left(starts, m.end())
                end = parsed.found[i].end if i < len(starts) and starts[i] <= m.end() + 16 else next((i + 1 for i in range(m.end(), len(code)) if code[i] in ";\n"), len(code))
                parsed.exports.append((m.start(), end))
        covered = sorted([*parsed.imports, *parsed.exports, *((f.start, f.end) for f in parsed.found)])
        at = 0
        for s, e in [*covered, (len(code), len(code))]:
            gap = code[at:s]
            if gap.strip(" \t\r\n;)(}{"):
                parsed.loose.append((at + len(gap) - len(gap.lstrip()), at + len(gap.rstrip())))
            at = max(at, e)
        return parsed

    return read


def nest(found: list[Found]) -> list[Found]:
    """Declarations inside others become their inner ones."""
    top: list[Found] = []
    stack: list[Found] = []
    for f in found:
        while stack and stack[-1].end <= f.start:
            stack.pop()
        (stack[-1].inner if stack else top).append(f)
        stack.append(f)
    return top


class _Elements(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.text, self.open, self.found, self.places = text, [], [], {}
        self.feed(text)
        self.close()

    def place(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, self.place()))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        start = self.place()
        self.found.append(Found("element", tag, start, start + len(self.get_starttag_text() or "")))

    def handle_endtag(self, tag: str) -> None:
        if not self.places.get(tag):
            return
        i = self.places[tag][-1]
        end = self.text.find(">", self.place()) + 1 or len(self.text)
        kind = {"script": "script_element", "style": "style_element"}.get(tag, "element")
        self.found.append(Found(kind, tag, self.open[i][1], end))
        while len(self.open) > i:
            self.places[self.open.pop()[0]].pop()


def read_html(text: str) -> Parsed:
    return Parsed(nest(sorted(_Elements(text).found, key=lambda f: (f.start, -f.end))))


#: [B1] Readers by language. Other languages give one chunk for the file.
READERS: dict[str, Callable[[str], Parsed | None]] = {
    "py": read_python,
    "java": read_java,
    **{language: read_braces(language) for language in ("js", "ts", "go", "c")},
    "html": read_html,
}


# -- chunks ----------------------------------------------------------------------------------------------------------


def chunk_file(path: str, content: str, language: str) -> tuple[dict, list[dict]]:
    """[CHK-1] (metadata, chunks) of a file. Lines count from 1. A file that its reader can't read is one chunk."""
    reader = READERS.get(language)
    try:
        parsed = (reader(content) if reader else None) or Parsed([])
    except (RecursionError, MemoryError):
        parsed = Parsed([])
    ends = [m.start() for m in re.finditer("\n", content)]

    def line_of(at: int) -> int:
        return bisect_left(ends, at) + 1

    kinds, parents = NODE_TYPES.get(language, ()), PARENT_TYPES.get(language, ())
    chunks: list[dict] = []

    def add(name: str, scope: str, code: str, kind: str, first: int, last: int) -> None:
        chunks.append({"name": name, "parent_scope": scope, "code": code, "language": language, "file": path, "type": kind, "start_line": first, "end_line": last})

    todo = [(f, path) for f in reversed(parsed.found)]
    while todo:  # [CHK-2] outer before inner, in the order of the text
        f, scope = todo.pop()
        if f.kind in kinds:
            add(f.name, scope, content[f.start : f.end], f.kind, line_of(f.start), line_of(f.end))
        todo += [(x, f.name if f.kind in parents else scope) for x in reversed(f.inner)]
    if parsed.loose:  # [CHK-4]
        code = "\n".join(content[s:e].strip() for s, e in parsed.loose)
        add("module_scope", path, code, "global_logic", line_of(parsed.loose[0][0]), line_of(parsed.loose[-1][1]))
    if not chunks and content.strip():  # [CHK-5]
        count = len(_LINE_ENDS.split(content)) - bool(_LINE_ENDS.search(content[-1:]))
        add("global_scope", path, content, "module", 1, count)
    skeleton = [f"{c['type']}: {signature(c['code'])},parent:{c['parent_scope']}" for c in chunks if c["type"] in (*kinds, *parents)]
    texts = lambda spans: [content[s:e].strip() for s, e in spans]
    return {"path": path, "imports": texts(parsed.imports), "exports": texts(parsed.exports), "language": language, "skeleton": skeleton}, chunks


def signature(code: str) -> str:
    """[SCL-7]"""
    lines = (line.strip() for line in code.strip().splitlines())
    return next((line for line in lines if not line.startswith("@")), "None")


_PARSED = "repo_id string, file_path string, language string, imports array<string>, exports array<string>, skeleton array<string>"
_CHUNKS = f"chunks array<struct<{CHUNK.replace(' ', ': ').replace(',: ', ', ')}>>"


def _parsed(files: DataFrame, last: str, of: Callable[[list[dict]], object]) -> DataFrame:
    """The rows of files with ``of`` their chunks in a column ``last``. Only about a MB of files are Python objects at a time."""
    fields = f"{_PARSED}, {last}"
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            rows = []
            for repo, path, language, content in zip(*(c.to_pylist() for c in part.columns), strict=True):
                meta, chunks = chunk_file(path, content or "", language)
                rows.append((repo, path, language, meta["imports"], meta["exports"], meta["skeleton"], of(chunks)))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select("repo_id", "path", "language", "content").mapInArrow(run, fields)


def parse_files(files: DataFrame) -> DataFrame:
    """[CHK-1, CHK-3, CHK-9] A row (repo_id, file_path, language, imports, exports, skeleton, chunks) for each of files (repo_id, path,
    language, content). Files are read in tasks, one at a time; a null content is an empty file."""
    return _parsed(files, _CHUNKS, list)


def chunks_of(parsed: DataFrame) -> DataFrame:
    """[CHK-2] The chunks of parsed files, with repo_id."""
    names = [f.split()[0] for f in CHUNK.split(", ")]
    return parsed.select("repo_id", F.explode("chunks").alias("chunk")).select(*(F.col(f"chunk.{n}").alias(n) for n in names), "repo_id")


def headers_of(parsed: DataFrame) -> DataFrame:
    """[CHK-3, AGG-8] What is known of parsed files themselves. Chunks are counted before equal ones collapse [AGG-6]."""
    return parsed.select("repo_id", "file_path", "language", "imports", "exports", "skeleton", F.size("chunks").alias("chunks_indexed"))


def chunk_files(files: DataFrame) -> DataFrame:
    """[CHK-1, CHK-9] Chunks of files (repo_id, path, language, content), with repo_id."""
    return chunks_of(parse_files(files))


def file_headers(files: DataFrame) -> DataFrame:
    """[CHK-3, AGG-8] (repo_id, file_path, language, imports, exports, skeleton, chunks_indexed) of files; their chunks stay in the task."""
    return _parsed(files, "chunks_indexed int", len)
