"""PHP source to tables of syntax records, without a PHP installation.

A tokenizer and a statement-level parser turn each file into rows: one pass over
the files of a partition, no state between files, errors kept as rows.  All record
kinds share one schema (``rec`` tells them apart), so one written table serves every
measure; ``view`` selects a kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import cut

SCHEMA = (
    "file_id long, path string, rec string, kind string, role string, value string, name string, class_name string, func_name string, namespace string, "
    "start_line int, end_line int, lloc int, nest_depth int, loop_depth int, params int, optional int, is_abstract boolean, is_final boolean, is_static boolean, is_public boolean, typed boolean, has_doc boolean, doc string, dst string"
)

TOKEN = re.compile(
    r"""(?P<ws>\s+)|(?P<var>\$+[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)"""
    r"""|(?P<id>\\?[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*)"""
    r"""|(?P<close>\?>\n?)|(?P<doc>/\*\*(?=\s).*?\*/)|(?P<comment>/\*.*?\*/|(?://|\#(?!\[))(?:(?!\?>)[^\n])*)"""
    r"""|(?P<str><<<[ \t]*(?P<q>["']?)(?P<tag>\w+)(?P=q)\r?\n.*?^[ \t]*(?P=tag)\b|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<num>0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?)"""
    r"""|(?P<op>\?\?=|<=>|\*\*=|===|!==|<<=|>>=|\.\.\.|\?->|\?\?|->|=>|::|\+\+|--|&&|\|\||<=|>=|==|!=|<>|<<|>>|\*\*|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|\#\[|.)""",
    re.S | re.M,
)
BINARY = set("+ - * / % . ** & | ^ << >> && || == != <> === !== < <= > >= <=> ??".split())
ASSIGN = set("+= -= *= /= .= %= &= |= ^= <<= >>= **= ??=".split())
WORD_OPS = {"and": "&&", "or": "||", "xor": "xor"}
TYPES_OF_CAST = {"int", "integer", "float", "double", "string", "bool", "boolean", "array", "object"}
OWN = {"self", "static", "parent"}
NOT_CALLS = {"if", "while", "for", "foreach", "switch", "match", "catch", "isset", "empty", "unset", "list", "array", "exit", "die", "echo", "print", "return", "function", "fn", "use", "declare", "and", "or", "xor", "new", "include", "require", "include_once", "require_once", "clone", "yield", "throw", "instanceof"}
NO_OPERANDS = NOT_CALLS | {"case"}
OPENING, CLOSING = {"(", "[", "{", "#["}, {")", "]", "}"}
BRACKETS = OPENING | CLOSING
#: The kinds of records.
KINDS = frozenset(("file", "class", "function", "member", "node", "call", "access", "edge", "method_call", "error"))
MODIFIERS = {"public", "private", "protected", "static", "abstract", "final", "readonly", "var"}
BUILTIN = {"int", "float", "string", "bool", "array", "mixed", "void", "null", "iterable", "callable", "object", "never", "false", "true", "self", "static", "parent"}


class ParseError(ValueError):
    pass


OPEN = re.compile(r"<\?(?:php\b|=)")
#: Tokens that can hold line ends.
LONG = {"doc", "comment", "str"}


def tokenize(text: str) -> list[tuple[str, str, int]]:
    """(type, text, line) of the tokens that mean something, html and comments included."""
    out, at, line = [], 0, 1
    while at < len(text):
        m = OPEN.search(text, at)
        stop = m.start() if m else len(text)
        if stop > at:
            out.append(("html", text[at:stop], line))
            line += text.count("\n", at, stop)
        if not m:
            break
        if m[0] == "<?=":
            out.append(("id", "echo", line))
        at = m.end()
        for t in iter(TOKEN.scanner(text, at).match, None):
            kind, s = t.lastgroup, t[0]
            if kind == "ws":
                line += s.count("\n")
                continue
            if kind == "close":
                out.append(("op", ";", line))
                line += s.count("\n")
                at = t.end()
                break
            if kind in ("q", "tag"):
                kind = "str"
            out.append((kind, s, line))
            if kind in LONG:
                line += s.count("\n")
        else:
            at = len(text)
    return out


class Parser:
    def __init__(self, file_id: int, path: str, text: str, wanted: frozenset[str] | None = None):
        self.rows: list[dict] = []
        self.wanted = KINDS if wanted is None else wanted
        self.base = {"file_id": file_id, "path": path}
        every = tokenize(text)
        self.docs = {}
        self.t: list[tuple[str, str, int]] = []
        doc = None
        self.html_lines = 0
        for tok in every:
            if tok[0] == "doc":
                doc = tok[1]
            elif tok[0] == "html":
                self.html_lines += len([x for x in tok[1].split("\n") if x.strip()])
            elif tok[0] not in ("comment",):
                if doc:
                    self.docs[len(self.t)] = doc
                    if tok[1].lower() not in MODIFIERS and tok[1] != "#[":
                        doc = None
                self.t.append(tok)
        self.words = [t[1] for t in self.t]
        self.lows = [w.lower() for w in self.words]
        self.pairs: dict[int, int] = {}
        opened = []
        for k, w in enumerate(self.words):
            if w in BRACKETS and self.t[k][0] == "op":
                if w in OPENING:
                    opened.append(k)
                elif opened:
                    self.pairs[opened.pop()] = k
        self.ns, self.uses = "", {}
        self.cls: list[str] = []
        self.fn: list[str] = []
        self.nest = self.loop = 0
        self.last_line = text.rstrip("\n").count("\n") + 1 if text else 0

    # -- rows --

    def row(self, rec: str, line: int, **more) -> None:
        if rec in self.wanted:
            self.rows.append(self.base | {"rec": rec, "namespace": self.ns, "class_name": self.cls[-1] if self.cls else None, "func_name": self.fn[-1] if self.fn else None, "start_line": line, "end_line": line, "nest_depth": self.nest, "loop_depth": self.loop} | more)

    def node(self, kind: str, line: int, *, operator: str | None = None, value: str | None = None) -> None:
        if "node" in self.wanted:
            self.row("node", line, kind=kind, role="operator" if operator else None, value=operator or value)

    def operand(self, value: str, line: int) -> None:
        if "node" in self.wanted:
            self.row("node", line, kind="operand", role="operand", value=value)

    def full(self, name: str) -> str:
        if name.startswith("\\"):
            return name[1:]
        first, _, rest = name.partition("\\")
        if first in self.uses:
            return self.uses[first] + ("\\" + rest if rest else "")
        return f"{self.ns}\\{name}" if self.ns else name

    def edge(self, name: str, kind: str, line: int) -> None:
        if self.cls and "edge" in self.wanted and name.lower().lstrip("\\") not in BUILTIN:
            self.row("edge", line, kind=kind, dst=self.full(name))

    # -- tokens --

    def at(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def low(self, i: int) -> str:
        return self.lows[i] if 0 <= i < len(self.lows) else ""

    def line(self, i: int) -> int:
        return self.t[min(i, len(self.t) - 1)][2] if self.t else 1

    def close(self, i: int) -> int:
        """The place of the bracket that closes the one at i."""
        if i in self.pairs:
            return self.pairs[i]
        depth = 0
        for k in range(i, len(self.t)):
            if self.t[k][0] == "op":
                depth += self.t[k][1] in ("(", "[", "{", "#[")
                depth -= self.t[k][1] in (")", "]", "}")
                if not depth:
                    return k
        raise ParseError(f"unclosed {self.at(i)} in line {self.line(i)}")

    # -- statements --

    def parse(self) -> list[dict]:
        i = 0
        while i < len(self.t):
            if self.at(i) == "}":
                raise ParseError(f"unexpected }} in line {self.line(i)}")
            i = self.statement(i)
        self.row("file", 1, end_line=self.last_line, lloc=len({t[2] for t in self.t}), params=self.html_lines)
        return self.rows

    def block(self, i: int) -> int:
        """The statements between the braces at i; the place after them."""
        end = self.close(i)
        i += 1
        while i < end:
            i = self.statement(i)
        return end + 1

    def inside(self, i: int, *, loop: bool = False, alternative: tuple[str, ...] = ()) -> int:
        """A body, one level deeper: a block, a single statement, or the alternative syntax up to a keyword."""
        self.nest += 1
        self.loop += loop
        if self.at(i) == "{":
            i = self.block(i)
        elif self.at(i) == ":" and alternative:
            i += 1
            while i < len(self.t) and self.low(i) not in alternative:
                i = self.statement(i)
        else:
            i = self.statement(i)
        self.nest -= 1
        self.loop -= loop
        return i

    def ended(self, i: int, word: str) -> int:
        return i + 2 if self.low(i) == word else i

    def statement(self, i: int) -> int:
        w, n = self.low(i), self.line(i)
        if w in ("{", ";"):
            return self.block(i) if w == "{" else i + 1
        if w == "#[":
            return self.close(i) + 1
        if self.t[i][0] != "id":
            return self.expression(i)
        if w == "if":
            return self.branch(i)
        if w in ("for", "foreach", "while"):
            self.node(w, n, operator=w)
            end = self.close(i + 1)
            self.loop += 0
            self.expression(i + 2, end)
            return self.ended(self.inside(end + 1, loop=True, alternative=("end" + w,)), "end" + w)
        if w == "do":
            self.node("do", n, operator="do")
            i = self.inside(i + 1, loop=True)
            end = self.close(i + 1)
            self.expression(i + 2, end)
            return end + 1
        if w == "switch":
            self.node("switch", n, operator="switch")
            end = self.close(i + 1)
            self.expression(i + 2, end)
            self.nest += 1
            stop = self.close(end + 1) if self.at(end + 1) == "{" else next(k for k in range(end, len(self.t)) if self.low(k) == "endswitch")
            i = end + 2
            while i < stop:
                if self.low(i) == "case":
                    self.node("case", self.line(i))
                    i = self.expression(i + 1, stop, stops=(":", ";"))
                elif self.low(i) == "default" and self.at(i + 1) in (":", ";"):
                    self.node("default", self.line(i))
                    i += 2
                else:
                    i = self.statement(i)
            self.nest -= 1
            return stop + 1 + (self.low(stop) == "endswitch")
        if w == "try":
            self.node("try", n, operator="try")
            i = self.block(i + 1)
            while self.low(i) in ("catch", "finally"):
                if self.low(i) == "finally":
                    i = self.block(i + 1)
                    continue
                self.node("catch", self.line(i), operator="catch")
                end = self.close(i + 1)
                for k in range(i + 2, end):
                    if self.t[k][0] == "var":
                        self.operand(self.at(k), self.line(k))
                i = self.inside(end + 1)
            return i
        if w == "namespace" and self.at(i + 1) != "\\":
            self.ns, self.uses = (self.at(i + 1) if self.t[i + 1][0] == "id" else ""), {}
            i += 1 + (self.t[i + 1][0] == "id")
            return self.block(i) if self.at(i) == "{" else i + 1
        if w == "use" and not self.cls:
            return self.imports(i)
        if w in ("abstract", "final", "readonly") or w in ("class", "interface", "trait") or (w == "enum" and self.t[i + 1][0] == "id"):
            k = i
            while self.low(k) in MODIFIERS:
                k += 1
            if self.low(k) in ("class", "interface", "trait", "enum"):
                return self.declare(k, {self.low(x) for x in range(i, k)}, i)
        if w == "function" and (self.t[i + 1][0] == "id" or self.at(i + 1) == "&" and self.t[i + 2][0] == "id"):
            return self.function(i, set(), i)
        if w in ("echo", "print"):
            self.node(w, n)
            return self.expression(i + 1)
        if w == "return":
            self.node("return", n, operator="return")
            return self.expression(i + 1)
        return self.expression(i)

    def branch(self, i: int) -> int:
        self.node("if", self.line(i), operator="if")
        end = self.close(i + 1)
        self.expression(i + 2, end)
        i = self.inside(end + 1, alternative=("elseif", "else", "endif"))
        while self.low(i) in ("elseif", "else"):
            self.node(self.low(i), self.line(i), operator=self.low(i))
            if self.low(i) == "elseif":
                end = self.close(i + 1)
                self.expression(i + 2, end)
                i = self.inside(end + 1, alternative=("elseif", "else", "endif"))
            else:
                i = self.inside(i + 1, alternative=("endif",))
        return self.ended(i, "endif")

    def imports(self, i: int) -> int:
        i += 1 + (self.low(i + 1) in ("function", "const"))
        prefix = ""
        while i < len(self.t) and self.at(i) != ";":
            if self.t[i][0] == "id" and self.low(i) != "as":
                name = self.at(i).lstrip("\\")
                if self.at(i + 1) == "\\" and self.at(i + 2) == "{":
                    prefix, i = name + "\\", i + 3
                    continue
                alias = self.at(i + 2) if self.low(i + 1) == "as" else name.rpartition("\\")[2]
                self.uses[alias] = prefix + name
                i += 2 * (self.low(i + 1) == "as")
            i += 1
        return i + 1

    # -- declarations --

    def declare(self, k: int, flags: set[str], first: int) -> int:
        kind, name = self.low(k), self.at(k + 1)
        i, relation, parents = k + 2, None, []
        while self.at(i) != "{":
            if self.low(i) in ("extends", "implements"):
                relation = self.low(i)
            elif self.t[i][0] == "id" and relation:
                parents.append((relation, self.at(i), self.line(i)))
            i += 1
            if i >= len(self.t):
                raise ParseError(f"class without a body in line {self.line(k)}")
        return self.members(i, kind, self.full("\\" + (f"{self.ns}\\{name}" if self.ns else name)), flags, first, parents)

    def members(self, i: int, kind: str, name: str, flags: set[str], first: int, parents: list) -> int:
        end = self.close(i)
        self.cls.append(name)
        self.fn.append(None)
        held, self.nest, self.loop = (self.nest, self.loop), (self.nest if kind == "anonymous" else 0), 0
        body = len({t[2] for t in self.t[first : end + 1]})
        doc = self.docs.get(first)
        self.row("class", self.line(first), kind="class" if kind == "anonymous" else kind, name=name, end_line=self.line(end), lloc=body, is_abstract="abstract" in flags, is_final="final" in flags, is_public=kind != "anonymous", has_doc=bool(doc), doc=doc)
        for relation, parent, line in parents:
            self.edge(parent, relation, line)
        i += 1
        while i < end:
            first = i
            while self.at(i) == "#[":
                i = self.close(i) + 1
            mods = set()
            while self.low(i) in MODIFIERS and not (self.at(i + 1) == "("):
                mods.add(self.low(i))
                i += 1
            if self.low(i) == "use":
                while self.at(i) not in (";", "{"):
                    if self.t[i][0] == "id" and self.low(i) != "use":
                        self.edge(self.at(i), "trait", self.line(i))
                    i += 1
                i = self.close(i) + 1 if self.at(i) == "{" else i + 1
            elif self.low(i) == "function":
                i = self.function(i, mods | ({"abstract"} if kind == "interface" else set()), first, method=True)
            elif self.low(i) in ("const", "case"):
                k = i
                while self.at(k) not in ("=", ";"):
                    k += 1
                self.row("member", self.line(i), kind="constant", name=self.at(k - 1), is_public=not mods & {"private", "protected"})
                i = self.expression(k + 1, end) if self.at(k) == "=" else k + 1
            else:
                k = i
                while k < end and self.t[k][0] != "var":
                    k += 1
                if k >= end:
                    break
                for x in range(i, k):
                    if self.t[x][0] == "id":
                        self.edge(self.at(x), "type", self.line(x))
                doc = self.docs.get(first)
                self.row("member", self.line(k), kind="property", name=self.at(k)[1:], typed=k > i, is_public=not mods & {"private", "protected"}, is_static="static" in mods, has_doc=bool(doc), value=(re.search(r"@var\s+(\S+)", doc) or [None, None])[1] if doc else None)
                i = self.expression(k + 1, end)
        self.cls.pop()
        self.fn.pop()
        self.nest, self.loop = held
        return end + 1

    def parameters(self, i: int, method: bool) -> tuple[int, int, int, int, int]:
        """(place after, all, optional, typed, nullable) of the list at i."""
        end, count, optional, typed, nullable = self.close(i), 0, 0, 0, 0
        i += 1
        while i < end:
            while self.at(i) == "#[":
                i = self.close(i) + 1
            promoted, kinds = False, []
            while i < end and self.t[i][0] != "var":
                if self.low(i) in MODIFIERS:
                    promoted = True
                elif self.t[i][0] == "id" or self.at(i) == "?":
                    kinds.append((self.at(i), self.line(i)))
                i += 1
            if i >= end:
                break
            count += not promoted
            typed += bool(kinds) and not promoted
            nullable += any(k in ("?", "null") for k, _ in kinds) and not promoted
            if promoted:
                self.row("member", self.line(i), kind="property", name=self.at(i)[1:], typed=bool(kinds), is_public=False, is_static=False)
            for k, line in kinds:
                if k != "?":
                    self.edge(k, "type", line)
            self.operand("param", self.line(i))
            self.operand(self.at(i), self.line(i))
            i += 1
            if self.at(i) == "=":
                optional += not promoted
                i = self.expression(i + 1, end, stops=(",",), keep=True)
            i += self.at(i) == ","
        return end + 1, count, optional, typed, nullable

    def function(self, i: int, mods: set[str], first: int, method: bool = False) -> int:
        i += 1 + (self.at(i + 1) == "&")
        name, doc = self.at(i), self.docs.get(first)
        if method:
            self.fn[-1] = name
        else:
            self.fn.append(self.full("\\" + (f"{self.ns}\\{name}" if self.ns else name)))
        held, self.nest, self.loop = (self.nest, self.loop), 0, 0
        at = len(self.rows)
        i, count, optional, typed, nullable = self.parameters(i + 1, method)
        returns = self.at(i) == ":"
        while self.at(i) not in ("{", ";"):
            if self.t[i][0] == "id":
                self.edge(self.at(i), "type", self.line(i))
            i += 1
            if i >= len(self.t):
                raise ParseError(f"function without an end in line {self.line(first)}")
        body = 0
        if self.at(i) == "{":
            end = self.close(i)
            body = len({t[2] for t in self.t[i + 1 : end]})
            i = self.block(i)
        else:
            i += 1
        described = len(set(re.findall(r"@param\s+[^$\n]*\$(\w+)", doc or "")))
        self.row("function", self.line(first), kind="method" if method else "function", name=name, end_line=self.line(i - 1), lloc=body, params=count, optional=optional, is_static="static" in mods, is_abstract="abstract" in mods, is_public=not mods & {"private", "protected"}, typed=returns, has_doc=bool(doc), doc=doc, value=f"{typed},{nullable},{described}")
        if "function" in self.wanted:
            self.rows.insert(at, self.rows.pop())
        if method:
            self.fn[-1] = None
        else:
            self.fn.pop()
        self.nest, self.loop = held
        return i

    # -- expressions --

    def expression(self, i: int, end: int | None = None, *, stops: tuple[str, ...] = (";",), keep: bool = False) -> int:
        """Nodes up to a stop at the expression's own depth, or the end; the place after it (of it, to keep)."""
        end = len(self.t) if end is None else end
        depth, sequences = 0, {0: None}
        while i < end:
            kind, s, n = self.t[i]
            w = self.lows[i]
            prev = self.t[i - 1] if i else ("op", ";", 0)
            if depth == 0 and kind == "op" and s in stops:
                return i if keep else i + 1
            if kind == "var":
                self.operand(s, n)
                if w == "$this" and self.at(i + 1) in ("->", "?->") and self.t[i + 2][0] == "id" and self.cls:
                    self.row("access", n, kind="method" if self.at(i + 3) == "(" else "property", name=self.at(i + 2))
            elif kind in ("num", "str"):
                # long literals are one operand each: their beginning and a digest of the whole
                self.operand(s if len(s) < 200 else s[:160] + hashlib.sha256(s.encode("utf-8", "replace")).hexdigest(), n)
                if kind == "str" and self.at(i + 1) == "." and prev[1] != "." and SQL_START.match(s):
                    for _ in range(self.unsafe_parts(i + 2, end)):
                        self.row("call", n, kind="sql concat", value="sql concat")
            elif kind == "op":
                if s in ("(", "[", "{", "#["):
                    if s == "(" and self.low(i + 1) in TYPES_OF_CAST and self.at(i + 2) == ")":
                        self.operand("cast:" + self.low(i + 1), n)
                        i += 3
                        continue
                    depth += 1
                    sequences[depth] = None
                elif s in (")", "]", "}"):
                    if depth == 0:
                        return i
                    depth -= 1
                elif s == ",":
                    sequences[depth] = None
                elif s == "?" and self.ends_operand(i):
                    self.node("ternary", n, operator="ternary")
                elif s == "=":
                    self.node("op", n, operator="assign")
                elif s in ASSIGN:
                    self.node("op", n, operator="assign" + s)
                elif s in ("&&", "||"):
                    if sequences[depth] != s:
                        self.node("boolean", n)
                        sequences[depth] = s
                    self.node("op", n, operator=s)
                elif s in ("+", "-") and not self.ends_operand(i):
                    self.node("op", n, operator="unary" + s)
                elif s == "&" and not self.ends_operand(i):
                    pass
                elif s in ("++", "--"):
                    self.node("op", n, operator=("post" if self.ends_operand(i) else "pre") + s)
                elif s == "??":
                    self.node("coalesce", n, operator=s)
                elif s == "<=>":
                    self.node("spaceship", n, operator=s)
                elif s in BINARY or s in ("!", "~"):
                    self.node("op", n, operator=s)
            elif w in WORD_OPS and self.ends_operand(i):
                if sequences[depth] != WORD_OPS[w]:
                    self.node("boolean", n)
                    sequences[depth] = WORD_OPS[w]
                self.node("op", n, operator=WORD_OPS[w])
            elif w == "instanceof":
                self.node("op", n, operator="instanceof")
            elif w == "throw":
                self.node("throw", n, operator="throw")
            elif w in ("eval", "print"):
                self.node(w, n, value=w)
            elif w == "match" and self.at(i + 1) == "(" and prev[1] not in ("->", "::", "?->"):
                self.node("match", n, operator="match")
                stop = self.close(i + 1)
                self.expression(i + 2, stop)
                brace = self.close(stop + 1)
                self.nest += 1
                self.expression(stop + 2, brace, stops=())
                self.nest -= 1
                i = brace + 1
                continue
            elif w in ("function", "fn") and prev[1] not in ("->", "::", "?->"):
                k = i + 1 + (self.at(i + 1) == "&")
                k, *_ = self.parameters(k, False)
                if w == "function":
                    while self.at(k) != "{":
                        k += 1
                    self.nest += 1
                    i = self.block(k)
                    self.nest -= 1
                    continue
                while self.at(k) != "=>":
                    k += 1
                self.nest += 1
                i = self.expression(k + 1, end, stops=(",", ";"), keep=True)
                self.nest -= 1
                continue
            elif w == "new":
                self.node("op", n, operator="new")
                if self.low(i + 1) == "class":
                    k = i + 2
                    if self.at(k) == "(":
                        stop = self.close(k)
                        self.expression(k + 1, stop, stops=())
                        k = stop + 1
                    parents, relation = [], None
                    while self.at(k) != "{":
                        if self.low(k) in ("extends", "implements"):
                            relation = self.low(k)
                        elif self.t[k][0] == "id":
                            parents.append((relation, self.at(k), self.line(k)))
                        k += 1
                    self.nest += 1
                    i = self.members(k, "anonymous", f"anonymous@{self.base['path']}:{n}:{i}", set(), i, parents)
                    self.nest -= 1
                    continue
                if self.t[i + 1][0] == "id":
                    self.used(self.at(i + 1), n, "__construct")
                    i += 2
                    continue
            elif self.at(i + 1) == "::":
                call = self.t[i + 2][0] == "id" and self.at(i + 3) == "("
                if call:
                    self.node("op", n, operator="static call")
                    if w in OWN and self.cls:
                        self.row("access", n, kind="method", name=self.at(i + 2))
                if call or self.t[i + 2][0] == "id":
                    self.used(s, n, self.at(i + 2) if call else None)
                    i += 3
                    continue
            elif self.at(i + 1) == "(" and w not in NOT_CALLS:
                method = prev[1] in ("->", "?->")
                self.node("method call" if method else "call", n, operator="method call" if method else "function call")
                if not method:
                    value = w.lstrip("\\")
                    if value == "unserialize" and self.names_classes(i + 1):
                        value = "unserialize with allowed_classes"
                    self.row("call", n, kind="call", value=value)
            i += 1
        return i

    def ends_operand(self, i: int) -> bool:
        """Whether the token before i ends an operand."""
        if not i:
            return False
        kind, s, _ = self.t[i - 1]
        return kind in ("var", "str", "num") or s in CLOSING or (kind == "id" and self.lows[i - 1] not in NO_OPERANDS)

    def unsafe_parts(self, i: int, end: int) -> int:
        """The joins of a chain a . b . c, from its second part on, that hold more than constants so far."""
        found, safe, depth, first = 0, True, 0, i
        while True:
            s = self.at(i) if i < end else ";"
            kind = self.t[i][0] if i < end else "op"
            if depth == 0 and kind == "op" and s not in ("(", "[", "{", "->", "?->", "::"):
                part = self.t[first:i]
                constant = len(part) == 1 and (part[0][0] == "num" or part[0][0] == "id" or (part[0][0] == "str" and not INTERPOLATED.match(part[0][1])))
                constant = constant or (len(part) == 3 and part[1][1] == "::" and part[2][0] == "id")
                safe = safe and constant
                found += not safe
                if s != ".":
                    return found
                first = i + 1
            elif kind == "op" and s in ("(", "[", "{"):
                depth += 1
            elif kind == "op" and s in (")", "]", "}"):
                depth -= 1
            i += 1

    def names_classes(self, opening: int) -> bool:
        """Whether the second argument of a call is an array with the key allowed_classes."""
        end, i, depth = self.close(opening), opening + 1, 0
        while i < end and (depth or self.at(i) != ","):
            depth += (self.at(i) in ("(", "[", "{")) - (self.at(i) in (")", "]", "}"))
            i += 1
        array = self.low(i + 1) if i + 1 < end else ""
        return array in ("[", "array") and any(self.t[k][0] == "str" and self.at(k).strip("'\"") == "allowed_classes" and self.at(k + 1) == "=>" for k in range(i + 2, end))

    def used(self, name: str, line: int, method: str | None) -> None:
        if name.lower() in OWN or not self.cls:
            return
        self.edge(name, "used", line)
        if method and self.fn and self.fn[-1] and self.full(name) != self.cls[-1]:
            self.row("method_call", line, kind="calls", name=f"{self.cls[-1]}::{self.fn[-1]}", dst=f"{self.full(name)}::{method}")


#: A literal without values inside that begins with a word of SQL.
SQL_START = re.compile(r"""(?:'|"(?!(?:[^"\\]|\\.)*[${]))\s*(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE)""", re.I)
INTERPOLATED = re.compile(r'"(?:[^"\\]|\\.)*\$')


def parse_file(file_id: int, path: str, text: str, wanted: frozenset[str] | None = None) -> list[dict]:
    """The records of one file (of the wanted kinds), or one error record."""
    try:
        return Parser(file_id, path, text or "", wanted).parse()
    except (ParseError, IndexError, StopIteration, RecursionError) as e:
        return [{"file_id": file_id, "path": path, "rec": "error", "value": f"{type(e).__name__}: {e}"}]


#: Rows that a batch of records holds before it is sent on.
BATCH = 20_000


def records(sources: DataFrame, *wanted: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """All records (SCHEMA) of (file_id, path, content), each task its own files.

    With kinds (``wanted``) and ``columns``, the records of those kinds and of
    files with errors, and those columns: what a measure does not read is neither
    built nor sent.
    """
    types = dict(f.split() for f in SCHEMA.split(", "))
    names = [c for c in types if not columns or c in columns or c == "rec"]
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c, arrow[types[c]]) for c in names])
    kinds = frozenset((*wanted, "error")) if wanted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], arrow[types[c]]) for c in names], schema=schema)
            rows.clear()
            return out

        for files in batches:
            for file_id, path, content in zip(*(files.column(c).to_pylist() for c in ("file_id", "path", "content")), strict=True):
                rows.extend(parse_file(file_id, path, content, kinds))
                if len(rows) >= BATCH:
                    yield batch()
        if rows:
            yield batch()

    return sources.select("file_id", "path", "content").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names))


def view(recs: DataFrame, rec: str) -> DataFrame:
    return recs.where(F.col("rec") == rec)


def nodes(recs: DataFrame) -> DataFrame:
    """Nodes with the ids that the node operators group by: class_id and func_id are names, the latter with its class."""
    func = F.concat_ws("::", "class_name", "func_name")
    return recs.where(F.col("rec").isin("node", "call")).withColumns({"class_id": F.col("class_name"), "func_id": F.when(F.col("func_name").isNotNull(), func)})


def edges(recs: DataFrame) -> DataFrame:
    """src, dst, kind of class dependencies, once each."""
    return view(recs, "edge").select(F.col("class_name").alias("src"), "dst", "kind").where("src <> dst").distinct()


def classes(recs: DataFrame, depth: int = 2) -> DataFrame:
    from ..functions.scalars import package_of

    c = view(recs, "class")
    return c.select("name", "path", "kind", package_of(F.col("namespace"), depth).alias("package"), (F.col("is_abstract") | (F.col("kind") == "interface")).alias("is_abstract"), (F.col("kind") == "trait").alias("is_trait"), "is_final", "lloc", (F.col("end_line") - F.col("start_line") + 1).alias("loc"))


def functions(recs: DataFrame) -> DataFrame:
    f = view(recs, "function")
    part = lambda k: F.element_at(F.split("value", ","), k).cast("int")
    return f.select(F.concat_ws("::", "class_name", "func_name").alias("func_id"), "name", "class_name", "kind", "params", "optional", part(1).alias("typed_params"), part(2).alias("nullable_params"), part(3).alias("described_params"), F.col("typed").alias("typed_return"), "has_doc", "is_public", "is_static", "is_abstract", "lloc", "start_line", "end_line")


def lcom(recs: DataFrame) -> DataFrame:
    """class_name, lcom: the components of methods that share properties or call each other.

    What methods are and touch is read once and cut: ``recs`` may still have to be parsed.
    """
    from ..operators.graph import group_components

    read = recs.where("rec = 'function' and kind = 'method' or rec = 'access' and func_name is not null")
    read = cut(read.select("rec", "kind", "class_name", "func_name", "name").distinct())
    methods = view(read, "function").select("class_name", F.concat(F.lit("m:"), "name").alias("a"), F.concat(F.lit("m:"), "name").alias("b"))
    known = methods.select("class_name", F.col("a").alias("b"))
    touch = view(read, "access").select("class_name", F.concat(F.lit("m:"), "func_name").alias("a"), F.concat(F.when(F.col("kind") == "method", "m:").otherwise("p:"), F.col("name")).alias("b"))
    own = touch.where("b like 'p:%'").unionByName(touch.where("b like 'm:%'").join(known, ["class_name", "b"], "left_semi").select("class_name", "a", "b"))
    return group_components(methods.unionByName(own), ["class_name"]).select("class_name", F.col("components").alias("lcom"))


def type_slots(recs: DataFrame) -> DataFrame:
    """class_name, slot, typed: one row for each parameter, return and property."""
    f = functions(recs)
    params = f.select("class_name", F.explode(F.expr("transform(sequence(1, greatest(params, 1)), i -> struct(i <= params AS real, i <= typed_params AS typed))")).alias("p")).where("p.real").select("class_name", F.lit("param").alias("slot"), F.col("p.typed").alias("typed"))
    returns = f.where("name not in ('__construct', '__destruct')").select("class_name", F.lit("return").alias("slot"), F.col("typed_return").alias("typed"))
    props = view(recs, "member").where("kind = 'property'").select("class_name", F.lit("property").alias("slot"), F.coalesce("typed", F.lit(False)).alias("typed"))
    return params.unionByName(returns).unionByName(props)


def doc_slots(recs: DataFrame) -> DataFrame:
    f = functions(recs)
    return f.select("class_name", "is_public", F.col("name").startswith("__").alias("is_magic"), "has_doc")


def dead_private(recs: DataFrame) -> DataFrame:
    from ..operators.nodes import dead_members

    private = view(recs, "function").where("kind = 'method' and not is_public").select(F.col("class_name").alias("class_id"), "name", F.col("name").startswith("__").alias("is_magic"))
    calls = view(recs, "access").where("kind = 'method'").select(F.col("class_name").alias("class_id"), "name")
    return dead_members(private, calls)


def globals_used(recs: DataFrame) -> DataFrame:
    """class and function scopes with the variables used, superglobals apart, as counts by name."""
    v = view(recs, "node").where("role = 'operand' and value like '$%'")
    super_ = F.col("value").isin("$GLOBALS", "$_SERVER", "$_GET", "$_POST", "$_FILES", "$_COOKIE", "$_SESSION", "$_REQUEST", "$_ENV")
    return v.groupBy("path", "class_name", "func_name", F.when(super_, "superglobal").otherwise("variable").alias("scope"), F.col("value").alias("name")).agg(F.count("*").alias("uses"))


def doc_summary(doc):
    """The first paragraph of a documentation block, without marks and tags."""
    body = F.regexp_replace(F.regexp_replace(doc, r"^/\*\*|\*/$", ""), r"(?m)^[ \t]*\*[ \t]?", "")
    return F.trim(F.regexp_replace(F.regexp_extract(F.trim(F.regexp_replace(body, r"(?ms)^@.*", "")), r"(?s)^(.*?)(\n\s*\n|$)", 1), r"\s+", " "))
