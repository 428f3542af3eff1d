"""Facts of C and C++ sources, by a tokenizer and a scope scanner of our own.

It knows namespaces, classes, function declarators, includes and call expressions, and nothing of types: what
only a full grammar can tell (a declaration from a call with the same look) is decided by the token before.
Columns and bytes count UTF-8 bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

from graphloom.functions.scalars import normalize_space, scopes_joined

TOKEN = re.compile(
    r"(?P<space>\s+|\\\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<pre>(?m:^)[ \t]*#(?:[^\n\\]|\\.|\\\n)*)"
    r"|(?P<string>(?:u8|[uUL])?R\"(?P<d>[^()\s\\]{0,16})\(.*?\)(?P=d)\"|(?:u8|[uUL])?\"(?:\\.|[^\"\\\n])*\"|(?:u8|[uUL])?'(?:\\.|[^'\\\n])+')"
    r"|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\.?\d(?:[\w.']|[eEpP][+-])*)|(?P<op>::|->\*?|\.\.\.|<<=|<=>|[-+*/%&|^=!<>]=|&&|\|\||\+\+|--|.)",
    re.S,
)
CASTS = frozenset(["static_cast", "dynamic_cast", "reinterpret_cast", "const_cast"])
NOT_CALLED = frozenset("if for while switch return sizeof alignof alignas decltype catch new delete throw typeid noexcept static_assert co_return co_await co_yield case else do goto defined requires explicit operator asm and or not".split())
#: After these words a name begins an expression, so that what follows can be a call.
BEFORE_EXPRESSION = frozenset("return else do case throw co_return co_await co_yield and or not goto".split())
NOT_NAMES = NOT_CALLED | CASTS | frozenset("const volatile struct class enum union public private protected void int char bool float double long short unsigned signed auto static inline constexpr virtual typename template using typedef friend extern namespace this nullptr true false __attribute__ __declspec".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Scanner:
    def __init__(self, text: str):
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        # characters of more than one byte, and the bytes that they and those before them have above one each
        self.wide = [] if text.isascii() else [m.start() for m in re.finditer(r"[^\x00-\x7f]", text)]
        self.extra = [0]
        for at in self.wide:
            self.extra.append(self.extra[-1] + len(text[at].encode("utf-8", "surrogatepass")) - 1)
        self.tokens: list[Token] = []
        self.out = {"symbols": [], "includes": [], "calls": [], "diagnostics": []}
        for m in TOKEN.finditer(text):
            kind = m.lastgroup if m.lastgroup != "d" else "string"
            if kind == "pre":
                self.directive(m)
            elif kind not in ("space", "comment"):
                self.tokens.append(Token(kind, m[0], m.start(), m.end()))
        self.match = self.pairs()
        self.scopes: list[str] = []
        self.classes = 0

    # --- places ---

    def byte(self, at: int) -> int:
        return at + self.extra[bisect_left(self.wide, at)]

    def place(self, a: int, b: int) -> dict:
        out = {}
        for name, at in (("start", a), ("end", b)):
            line = bisect_right(self.lines, at) - 1
            out[f"{name}_line"], out[f"{name}_column"], out[f"{name}_byte"] = line + 1, self.byte(at) - self.byte(self.lines[line]) + 1, self.byte(at)
        return out

    def directive(self, m: re.Match) -> None:
        found = re.match(r"[ \t]*#[ \t]*(?:include|import|include_next)[ \t]*(<[^>\n]*>|\"[^\"\n]*\"|[^\s/][^\n]*?)[ \t]*(?://[^\n]*|/\*.*)?$", m[0], re.S)
        if found:
            target, system = found[1], found[1][0] == "<" and found[1][-1] == ">"
            target = target[1:-1] if len(target) >= 2 and (system or target[0] == target[-1] == '"') else target
            if target:
                start = m.start() + m[0].index("#")
                self.out["includes"].append({"target": target, "is_system": system, "range": self.place(start, m.end())})

    def pairs(self) -> dict[int, int]:
        """Index of each bracket's partner; every unpaired one is diagnosed: one that does not close as missing its
        partner, where it opens, and a closing one that nothing opens as an error.
        """
        found, stack, bad = {}, [], []
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in OPEN:
                stack.append(i)
            elif t.text in CLOSE:
                while stack and OPEN[self.tokens[stack[-1]].text] != t.text and t.text == "}":
                    bad.append(stack.pop())
                if stack and OPEN[self.tokens[stack[-1]].text] == t.text:
                    found[stack[-1]], found[i] = i, stack[-1]
                    stack.pop()
                else:
                    bad.append(i)
        for i in sorted([*bad, *stack]):
            t = self.tokens[i]
            if t.text in OPEN:
                self.out["diagnostics"].append({"severity": "error", "code": "missing-syntax", "message": f"parser expected {OPEN[t.text]}", "range": self.place(t.end, t.end)})
            else:
                self.out["diagnostics"].append({"severity": "error", "code": "syntax-error", "message": "unrecognized syntax", "range": self.place(t.start, t.end)})
        return found

    def op(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind in ("op", "name")

    def source(self, a: int, b: int) -> str:
        return normalize_space(self.text[self.tokens[a].start : self.tokens[b].end])

    # --- declarations ---

    def angle(self, i: int, end: int) -> int:
        """Index after the template arguments that open at i, or i if they do not close."""
        depth, j = 0, i
        while j < end:
            t = self.tokens[j].text
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif t in ("(", "[", "{") and j in self.match:
                j = self.match[j]
            elif t in (";", "{", "}", "&&", "||"):
                return i
            j += 1
        return i

    def block(self, i: int, end: int) -> None:
        """Declarations of a namespace, class or file."""
        while i < end:
            i = max(self.declaration(i, end), i + 1)

    def declaration(self, i: int, end: int) -> int:
        t = self.tokens
        if self.op(i, ";", "}", ":", ",") or t[i].kind in ("string", "number"):
            return i + 1
        if self.op(i, "public", "private", "protected") and self.op(i + 1, ":"):
            return i + 2
        if self.op(i, "template"):
            return max(self.angle(i + 1, end), i + 1)
        if self.op(i, "extern") and i + 2 < end and t[i + 1].kind == "string" and self.op(i + 2, "{"):
            close = self.match.get(i + 2, end)
            self.block(i + 3, min(close, end))
            return close + 1
        if self.op(i, "namespace") or self.op(i, "inline") and self.op(i + 1, "namespace"):
            j = i + (2 if self.op(i, "inline") else 1)
            name = ""
            while j < end and not self.op(j, "{", ";", "="):
                name += t[j].text if t[j].text != "inline" else ""
                j += 1
            if not self.op(j, "{"):
                return self.statement_end(i, end)
            close = self.match.get(j, end)
            self.scopes.append(name or "(anonymous)")
            self.block(j + 1, min(close, end))
            self.scopes.pop()
            return close + 1
        if self.op(i, "using", "typedef", "static_assert", "friend") and not (self.op(i, "typedef") and self.op(i + 1, "struct", "class")):
            return self.statement_end(i, end)
        return self.general(i, end)

    def statement_end(self, i: int, end: int) -> int:
        while i < end and not self.op(i, ";"):
            i = self.match[i] + 1 if self.op(i, "(", "[", "{") and self.match.get(i, -1) > i else i + 1
        return i + 1

    def general(self, i: int, end: int) -> int:
        """A class, a function or another declaration."""
        t, first, j = self.tokens, i, i
        function: tuple[int, int] | None = None  # name and parameters of the first declarator
        declared: list[tuple[int, int]] = []
        initialised = False
        while j < end:
            x = t[j].text
            if x in ("class", "struct") and t[j].kind == "name" and not self.op(j - 1, "enum") and function is None:
                after = self.record(j, end)
                if after is not None:
                    j = after
                    continue
            if x == "enum" and t[j].kind == "name":
                while j < end and not self.op(j, "{", ";", ")"):
                    j += 1
                if self.op(j, "{"):
                    j = self.match.get(j, end) + 1
                continue
            if x == "<" and j > first and t[j - 1].kind == "name":
                after = self.angle(j, end)
                if after > j:
                    j = after
                    continue
            if x == "operator" and t[j].kind == "name":
                k = j + 1
                k = k + 2 if self.op(k, "(") and self.op(k + 1, ")") else k
                while k < end and not self.op(k, "("):
                    k += 1
                if self.op(k, "(") and k in self.match:
                    start = self.name_start(j)
                    declared.append((start, k))
                    function = function or (start, k)
                    j = self.match[k] + 1
                    continue
            if x == "(" and t[j].kind == "op":
                close = self.match.get(j)
                if close is None or close < j:
                    return j + 1
                named = j > first and t[j - 1].kind == "name" and t[j - 1].text not in NOT_NAMES or j > first and self.op(j - 1, ">") and self.angle_name(j - 1) is not None
                if named and not initialised and self.parameters(j, close):
                    start = self.name_start(self.angle_name(j - 1) if self.op(j - 1, ">") else j - 1)
                    if function is None or self.op(start - 1, ","):
                        declared.append((start, j))
                        function = function or (start, j)
                j = close + 1
                continue
            if x == "[" and t[j].kind == "op" and self.match.get(j, -1) > j:
                j = self.match[j] + 1
                continue
            if x == "=" and t[j].kind == "op":
                initialised = True
            if x == ":" and t[j].kind == "op" and function is not None and not initialised:  # member initialisers
                j += 1
                while j < end and not self.op(j, ";"):
                    if self.op(j, "(", "[") and self.match.get(j, -1) > j:
                        j = self.match[j] + 1
                    elif self.op(j, "{") and (t[j - 1].kind == "name" or self.op(j - 1, ">")) and self.match.get(j, -1) > j:
                        j = self.match[j] + 1
                    elif self.op(j, "{"):
                        break
                    else:
                        j += 1
                continue
            if x == "{" and t[j].kind == "op":
                close = self.match.get(j)
                if close is None or close < j:
                    self.block(j + 1, end)
                    return end
                if function is not None and not initialised:
                    caller = self.function(first, function, j - 1, t[close].end, "definition")
                    self.calls(first, close, caller, function)
                    return close + 1
                if not initialised and not (j > first and t[j - 1].kind == "name" and t[j - 1].text not in NOT_NAMES):
                    self.block(j + 1, close)  # a union, or braces that are no initialiser
                j = close + 1
                continue
            if x == "}" and t[j].kind == "op":
                return j + 1
            if x == ";" and t[j].kind == "op":
                for d in declared:
                    self.function(first, d, None, t[j].end, "declaration", j)
                return j + 1
            j += 1
        return j

    def angle_name(self, i: int) -> int | None:
        """Index of the name whose template arguments close at i."""
        depth = 0
        while i >= 0:
            if self.op(i, ">"):
                depth += 1
            elif self.op(i, "<"):
                depth -= 1
                if not depth:
                    return i - 1 if i and self.tokens[i - 1].kind == "name" and self.tokens[i - 1].text not in NOT_NAMES else None
            elif self.op(i, ";", "{", "}"):
                return None
            i -= 1
        return None

    def name_start(self, i: int) -> int:
        """First token of the qualified name that ends at i."""
        if self.op(i - 1, "~"):
            i -= 1
        while self.op(i - 1, "::"):
            i -= 1
            if i and self.tokens[i - 1].kind == "name" and self.tokens[i - 1].text not in NOT_NAMES:
                i -= 1
            elif self.op(i - 1, ">") and self.angle_name(i - 1) is not None:
                i = self.angle_name(i - 1)
        return i

    def parameters(self, open_: int, close: int) -> bool:
        """Whether brackets can hold parameters; values mean an initialiser."""
        inside = self.tokens[open_ + 1 : close]
        if not inside:
            return True
        if inside[0].kind in ("number", "string") or inside[0].text in ("-", "!", "{", "[", "true", "false", "nullptr", "this"):
            return False
        return not any(t.text in (".", "->", "+", "/", "==", "++") for t in inside[:3])

    def function(self, first: int, declarator: tuple[int, int], body: int | None, end: int, role: str, stop: int | None = None) -> tuple[str, int]:
        start, open_ = declarator
        raw = self.source(start, open_ - 1)
        last = close = self.match[open_]
        limit = stop if body is None else body + 1
        while last + 1 < limit and not self.op(last + 1, ",", ":", "=", ";", "{"):
            last += 1
            if self.op(last, "(", "[") and self.match.get(last, -1) > last:
                last = self.match[last]
        last = max(last, close)
        outer = self.scopes[: len(self.scopes) - self.classes] if "::" in raw and self.classes else self.scopes
        qualified = scopes_joined(outer, raw)
        self.out["symbols"].append({"kind": "method" if self.classes or "::" in raw else "function", "role": role, "name": raw.rpartition("::")[2], "qualified_name": qualified, "signature": self.source(start, last), "range": self.place(self.tokens[first].start, end)})
        return qualified, self.byte(self.tokens[first].start)

    def record(self, j: int, end: int) -> int | None:
        """A class or struct; index after it, None if it has no name."""
        t, k = self.tokens, j + 1
        while self.op(k, "[", "alignas", "__attribute__", "__declspec"):
            k = self.match[k] + 1 if self.op(k, "[") and k in self.match else self.match.get(k + 1, k) + 1
        if k >= end or t[k].kind != "name":
            return None
        # an upper-case macro may stand before the name
        while k + 1 < end and t[k + 1].kind == "name" and t[k].text.isupper() and t[k + 1].text not in ("final",):
            k += 1
        at = k
        while self.op(k + 1, "::") and k + 2 < end and t[k + 2].kind == "name":
            k += 2
        if self.op(k + 1, "<"):
            k = self.angle(k + 1, end) - 1
        name, n = self.source(at, k), k + 1
        if self.op(n, "final"):
            n += 1
        if self.op(n, ":"):
            while n < end and not self.op(n, "{", ";"):
                n = self.angle(n, end) if self.op(n, "<") and self.angle(n, end) > n else n + 1
        body = self.op(n, "{")
        close = self.match.get(n, end - 1) if body else None
        finish = t[min(close, len(t) - 1)].end if body else t[k].end
        self.out["symbols"].append({"kind": t[j].text, "role": "definition" if body else "declaration", "name": name, "qualified_name": scopes_joined(self.scopes, name), "signature": "", "range": self.place(t[j].start, finish)})
        if not body:
            return k + 1
        self.scopes.append(name)
        self.classes += 1
        self.block(n + 1, min(close, end))
        self.classes -= 1
        self.scopes.pop()
        return close + 1

    # --- calls ---

    def calls(self, first: int, last: int, caller: tuple[str, int], own: tuple[int, int]) -> None:
        t = self.tokens
        skip, j = {own[1]}, self.match[own[1]] + 1
        while j < self.match[last]:  # brackets of member initialisers and specifiers are no calls
            if self.op(j, "(") and self.match.get(j, -1) > j:
                skip.add(j)
                j = self.match[j]
            j += 1
        for i in range(first, last):
            if not self.op(i, "(") or t[i].kind != "op" or i in skip or self.match.get(i, -1) < i:
                continue
            found = self.callee(i, first)
            if found is None:
                continue
            start, form, name = found
            text = self.source(start, i - 1)
            name = normalize_space(name).split("<")[0] or text
            if name in CASTS:
                continue
            close = self.match[i]
            self.out["calls"].append({"caller_qualified_name": caller[0], "caller_start_byte": caller[1], "callee_text": text, "callee_name": name, "form": form, "argument_count": self.arguments(i, close), "range": self.place(t[start].start, t[close].end)})

    def arguments(self, open_: int, close: int) -> int:
        n, j = 0, open_ + 1
        if j == close:
            return 0
        while j < close:
            if self.op(j, "(", "[", "{") and self.match.get(j, -1) > j:
                j = self.match[j]
            elif self.op(j, "<") and self.tokens[j - 1].kind == "name" and self.op(self.angle(j, close), "(", "{", "::"):
                j = self.angle(j, close) - 1
            elif self.op(j, ","):
                n += 1
            j += 1
        return n + 1

    def callee(self, i: int, first: int) -> tuple[int, str, str] | None:
        """(first token, form, name) of what is called by the bracket at i."""
        t, j = self.tokens, i - 1
        if self.op(j, ">"):
            j = self.angle_name(j)
            if j is None:
                return None
        if j < first:
            return None
        if t[j].kind == "name":
            if t[j].text in NOT_NAMES - CASTS:
                return None
            start = self.name_start(j)
            if self.op(start - 1, ".", "->"):
                return self.chain(start, first), "member", t[j].text
            before = t[start - 1] if start > first else None
            if before and (before.kind == "name" and before.text not in BEFORE_EXPRESSION and before.text not in CASTS or before.text in (">", "~") and self.angle_name(start - 1) is not None):
                return None  # a declaration
            qualified = any(self.op(k, "::") for k in range(start, j))
            return start, "qualified" if qualified else "unqualified", t[j].text
        if self.op(j, ")", "]") and self.match.get(j, i) < j:
            open_ = self.match[j]
            if self.op(j, "]") and not (open_ > first and (t[open_ - 1].kind == "name" or self.op(open_ - 1, ")", "]"))):
                return None  # a lambda's captures
            if self.op(j, ")") and open_ > first and t[open_ - 1].kind == "name" and t[open_ - 1].text in NOT_CALLED | CASTS:
                return None
            if self.op(j, ")") and not self.op(open_ + 1, "*") and not (t[open_ - 1].kind == "name" or self.op(open_ - 1, ")", "]", ">")):
                return None  # a cast or a grouped value
            return self.chain(i, first), "indirect", ""
        return None

    def chain(self, i: int, first: int) -> int:
        """First token of the postfix expression before i."""
        t = self.tokens
        while i > first:
            if self.op(i - 1, ".", "->"):
                i -= 1
            elif self.op(i - 1, ")", "]") and self.match.get(i - 1, i) < i - 1:
                i = self.match[i - 1]
                if self.op(i, "(") and not (t[i - 1].kind == "name" and t[i - 1].text not in NOT_CALLED or self.op(i - 1, ")", "]", ">")):
                    return i
            elif t[i - 1].kind == "name" and (t[i - 1].text not in NOT_NAMES or t[i - 1].text == "this"):
                i = self.name_start(i - 1)
                if not self.op(i - 1, ".", "->"):
                    return i
            else:
                return i
        return i


def extract(text: str, path: str) -> dict:
    """Facts of one file."""
    s = Scanner(text)
    s.block(0, len(s.tokens))
    return s.out
