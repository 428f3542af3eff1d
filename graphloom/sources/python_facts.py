"""Facts of Python sources, from the standard library's syntax trees."""

from __future__ import annotations

import ast
import re
import warnings

from graphloom.functions.scalars import normalize_space, scopes_joined


def module_of(path: str) -> str:
    """Dotted module of a source path."""
    dotted = re.sub(r"\.[^.]*$", "", path).replace("/", ".")
    return "" if dotted == "__init__" else re.sub(r"\.__init__$", "", dotted)


def _brackets(text: str, at: int) -> int:
    """End of the bracketed text that opens at ``at``, strings and comments skipped."""
    depth = 0
    for m in re.compile(r"#[^\n]*|(\"\"\"|''')(?:\\.|(?!\1).)*\1|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[()\[\]{}]", re.S).finditer(text, at):
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth -= 1
            if not depth:
                return m.end()
    return len(text)


class _Walker:
    def __init__(self, text: str, module: str, first_line: int = 0, first_byte: int = 0):
        self.lines = text.encode().splitlines(keepends=True)
        self.starts = [first_byte]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line))
        self.raw, self.first_line, self.first_byte = text.encode(), first_line, first_byte
        self.scopes, self.in_class = ([module] if module else []), ([False] if module else [])
        self.caller: tuple[str, int] | None = None
        self.out = {"symbols": [], "includes": [], "calls": []}

    def place(self, node: ast.AST) -> dict:
        a, b = self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset
        return {"start_line": node.lineno + self.first_line, "start_column": node.col_offset + 1, "end_line": node.end_lineno + self.first_line, "end_column": node.end_col_offset + 1, "start_byte": a, "end_byte": b}

    def text(self, node: ast.AST | None) -> str:
        if node is None:
            return ""
        r = self.place(node)
        return self.raw[r["start_byte"] - self.first_byte : r["end_byte"] - self.first_byte].decode()

    def visit(self, root: ast.AST) -> None:
        """All nodes, each before its children; a stack instead of recursion, as expressions can be very deep."""
        self.todo: list = [root]
        while self.todo:
            node = self.todo.pop()
            if not isinstance(node, ast.AST):
                node()  # what a definition does at its begin and end
            elif isinstance(node, ast.ClassDef):
                self.define(node, "class")
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.define(node, "method" if self.in_class and self.in_class[-1] else "function")
            else:
                self.take(node)
                self.todo += reversed(list(ast.iter_child_nodes(node)))

    def take(self, node: ast.AST) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                self.out["includes"].append({"target": a.name, "is_system": False, "range": self.place(node)})
        elif isinstance(node, ast.ImportFrom):
            dots = "." * node.level
            targets = [dots + node.module] if node.module else [dots + a.name for a in node.names if a.name != "*"]
            if (node.module, node.level) != ("__future__", 0):
                self.out["includes"] += [{"target": t, "is_system": False, "range": self.place(node)} for t in targets]
        elif isinstance(node, ast.Call) and self.caller:
            self.call(node)

    def define(self, node, kind: str) -> None:
        name, body = node.name, self.text(node)
        where = self.place(node)
        head = re.match(r"(?:async\s+)?(?:def|class)\s+" + re.escape(name) + r"\s*", body)
        at = head.end() if head else 0
        if body[at : at + 1] == "[":  # type parameters
            at = _brackets(body, at)
            at += len(body[at:]) - len(body[at:].lstrip())
        signature = name
        if body[at : at + 1] == "(":
            signature += normalize_space(body[at : _brackets(body, at)])
        if kind != "class":
            if isinstance(node, ast.AsyncFunctionDef):
                signature = f"async {signature}"
            if node.returns is not None:
                signature += f" -> {normalize_space(self.text(node.returns))}"
        qualified = scopes_joined(self.scopes, name)
        self.out["symbols"].append({"kind": kind, "role": "definition", "name": name, "qualified_name": qualified, "signature": signature, "range": where})
        before = self.caller

        def enter() -> None:
            if kind != "class":
                self.caller = (qualified, where["start_byte"])
            self.scopes.append(name)
            self.in_class.append(kind == "class")

        def leave() -> None:
            self.scopes.pop()
            self.in_class.pop()
            self.caller = before

        inside = [child for child in ast.iter_child_nodes(node) if child not in node.decorator_list]
        self.todo += reversed([*node.decorator_list, enter, *inside, leave])  # decorators stand outside

    def call(self, node: ast.Call) -> None:
        text, form = normalize_space(self.text(node.func)), "indirect"
        name = text
        if isinstance(node.func, ast.Name):
            form = "unqualified"
        elif isinstance(node.func, ast.Attribute):
            name, form = node.func.attr, "member"
            if text.startswith(("self.", "cls.")):
                text, form = name, "unqualified"
        self.out["calls"].append({"caller_qualified_name": self.caller[0], "caller_start_byte": self.caller[1], "callee_text": text, "callee_name": name, "form": form, "argument_count": len(node.args) + len(node.keywords), "range": self.place(node)})


def extract(text: str, path: str) -> dict:
    """Facts of one file; of a malformed one, those of its sound top-level statements, and a diagnostic for each other."""
    module, out = module_of(path), {"symbols": [], "includes": [], "calls": [], "diagnostics": []}

    def add(part: str, line: int, byte: int) -> None:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(part)
        w = _Walker(part, module, line, byte)
        w.visit(tree)
        for k, v in w.out.items():
            out[k] += v

    try:
        add(text, 0, 0)
    except SyntaxError:
        # statements begin at lines that are neither indented nor continue a bracket
        lines = text.splitlines(keepends=True)
        cuts = [i for i, x in enumerate(lines) if re.match(r"[A-Za-z_@]", x) and not re.match(r"(?:elif|else|except|finally)\b", x)]
        cuts = [c for k, c in enumerate(cuts) if not (k and lines[cuts[k - 1]].startswith("@"))] or [0]
        for a, b in zip([0, *cuts[1:]] if cuts[0] else cuts, [*cuts[1:], len(lines)], strict=False):
            part, byte = "".join(lines[a:b]), len("".join(lines[:a]).encode())
            try:
                add(part, a, byte)
            except SyntaxError:
                n = part.count("\n")
                out["diagnostics"].append({"severity": "error", "code": "syntax-error", "message": "unrecognized syntax", "range": {"start_line": a + 1, "start_column": 1, "end_line": a + 1 + n, "end_column": 1, "start_byte": byte, "end_byte": byte + len(part.encode())}})
    return out
