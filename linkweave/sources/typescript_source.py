"""Facts of TypeScript sources: imports, calls, definitions, decorators, types, Zod schemas.

There is no TypeScript parser here: a file becomes a list of tokens with matched brackets, and one pass over them emits rows
of one wide table.  Each file is a row of its own and is read whole; a file whose brackets don't match gives one error row.

Decided as the analysed tool behaves: Zod schemas and arrow functions count only where they aren't exported and stand at the top
level; string arguments keep their quotes; arguments that aren't a name or a literal are ``expr``.
Null and empty sources give no rows; extra columns of the input are not used."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import names
from linkweave.operators import linking
from linkweave.plans.fixtures import per_supplier, per_supplier_sql

FACTS = "path string, ord int, fact string, name string, owner string, detail string, args array<string>, generics string, line int"
_KINDS = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32())

_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)+", re.S)
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_WORD = re.compile(r"[#$\w]+")
_SIGN = re.compile(r"=>|\?\.(?!\d)|\?\?=?|\.\.\.|&&|\|\||[-+*/%!=]=+|\+\+|--|.", re.S)

_CLOSERS = {"(": ")", "[": "]", "{": "}"}
_MODIFIERS = frozenset("export default declare abstract public private protected static readonly async get set override".split())
_NOT_CALLED = frozenset("async if for while switch catch return typeof function await new import with do else throw void delete in of yield case constructor".split())
_TYPE_WORDS = frozenset("keyof typeof readonly extends infer is unique new".split())
_ZOD_ROOTS = frozenset("object string number boolean array".split())
_ZOD_CHECKS = frozenset("parse safeParse parseAsync safeParseAsync".split())

#: Example sources for the queries.
EXAMPLE = {
    "users.controller.ts": "import { Controller, Get, Post, Body, Param } from '@nestjs/common';\nimport { UsersService } from './users.service';\n\n@Controller('users')\nexport class UsersController {\n  constructor(private readonly users: UsersService) {}\n\n  @Get(':id')\n  async findOne(@Param('id') id: string): Promise<User> {\n    return this.users.findOne(id);\n  }\n\n  @Post()\n  create(@Body() dto: CreateUserDto) {\n    return this.users.create(dto);\n  }\n}\n",
    "api.ts": "import axios from 'axios';\nimport { z } from \"zod\";\n\nconst User = z.object({ id: z.number(), mail: z.string().email().optional(), note: z.string().nullable(), tags: z.array(z.string()) });\nexport const Hidden = z.object({ id: z.number() });\n\nexport interface Item {\n  id: number;\n  title?: string;\n  owners: Array<User>\n}\ntype Id = string | number;\n\nasync function load(id: string): Promise<Item> {\n  const r = await axios.get<Item>('/items/1'); // axios.post('/no')\n  fetch(\"/health\");\n  return r.data as Item;\n}\nconst save = (item: Item) => { api.post('/items', item); };\nUser.safeParse(load('1'));\n",
    "broken.ts": "function broken( {",
    "empty.ts": "",
}


class Unmatched(ValueError):
    def __init__(self, line: int) -> None:
        super().__init__(line)
        self.line = line


class Source:
    """Tokens of a file, the partner of each bracket, and the innermost open bracket around each token."""

    def __init__(self, text: str) -> None:
        self.text, self.words, self.spans, self.lines = text, [], [], []
        self.partner: dict[int, int] = {}
        self.inside: list[int] = []
        self._read()
        self._match()

    def _read(self) -> None:
        at, line, text = 0, 1, self.text
        while at < len(text):
            if gap := _SPACE.match(text, at):
                line += text.count("\n", at, gap.end())
                at = gap.end()
                continue
            end = self._end(at)
            self.words.append(text[at:end])
            self.spans.append((at, end))
            self.lines.append(line)
            line += text.count("\n", at, end)
            at = end

    def _end(self, at: int) -> int:
        first = self.text[at]
        if first == "`":
            return self._template(at)
        last = self.words[-1] if self.words else ""
        if first == "/" and not (last and (last[-1] in ")]}\"'`" or _WORD.fullmatch(last) and last not in _NOT_CALLED)) and (found := _REGEX.match(self.text, at)):
            return found.end()
        found = _STRING.match(self.text, at) or _WORD.match(self.text, at) or _SIGN.match(self.text, at)
        return found.end()

    def _template(self, at: int) -> int:
        """The end of a template; ``${}`` may hold further templates."""
        open_braces, at = [], at + 1  # one counter for each template that is interrupted by an expression
        in_text = True
        while at < len(self.text):
            c = self.text[at]
            if in_text:
                if c == "\\":
                    at += 1
                elif c == "`":
                    if not open_braces:
                        return at + 1
                    in_text = False
                elif c == "$" and self.text.startswith("{", at + 1):
                    open_braces.append(0)
                    in_text, at = False, at + 1
            elif found := _STRING.match(self.text, at):
                at = found.end() - 1
            elif c == "`":
                in_text = True
            elif c == "{":
                open_braces[-1] += 1
            elif c == "}":
                if open_braces[-1] == 0:
                    open_braces.pop()
                    in_text = True
                else:
                    open_braces[-1] -= 1
            at += 1
        return len(self.text)

    def _match(self) -> None:
        stack: list[int] = []
        for i, w in enumerate(self.words):
            if w in (")", "]", "}"):
                if not stack or _CLOSERS[self.words[stack[-1]]] != w:
                    raise Unmatched(self.lines[i])
                self.partner[stack.pop()] = i
            self.inside.append(stack[-1] if stack else -1)
            if w in _CLOSERS:
                stack.append(i)
        if stack:
            raise Unmatched(self.lines[stack[-1]])

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def is_name(self, i: int) -> bool:
        w = self.word(i)
        return bool(w) and not w[0].isdigit() and _WORD.fullmatch(w) is not None

    def shown(self, start: int, end: int) -> str:
        """The text of tokens start..end-1, white space made one space."""
        return " ".join(self.text[self.spans[start][0] : self.spans[end - 1][1]].split()) if end > start else ""

    def angle_end(self, i: int) -> int | None:
        """The index behind the ``>`` of the ``<`` at i, or None where it can't be a list of types."""
        depth = 0
        while i < len(self.words):
            w = self.words[i]
            if w == "<":
                depth += 1
            elif w == ">":
                depth -= 1
                if depth == 0:
                    return i + 1
            elif w in _CLOSERS:
                i = self.partner[i]
            elif w not in (",", ".", "|", "&", "=>", "?", ":", "=") and not (_WORD.fullmatch(w) or w[0] in "\"'`"):
                return None
            i += 1
        return None

    def type_end(self, i: int) -> int:
        """The index behind the type that starts at i."""
        due, first = True, i
        while i < len(self.words):
            w = self.words[i]
            if w == "<":
                i, due = self.angle_end(i) or i + 1, False
            elif w in ("(", "["):
                if not due and w == "(":
                    return i
                i, due = self.partner[i] + 1, False
            elif w == "{":
                if not due:
                    return i
                i, due = self.partner[i] + 1, False
            elif w in ("|", "&", ".", "?", ":", "=>"):
                i, due = i + 1, True
            elif _WORD.fullmatch(w) or w[0] in "\"'`-":
                if not due and w not in _TYPE_WORDS:
                    return i
                if not due and i > first and self.lines[i] != self.lines[i - 1]:
                    return i
                i, due = i + 1, w in _TYPE_WORDS or w == "-"
            else:
                return i
        return i

    def parts(self, opened: int) -> list[tuple[int, int]]:
        """Ranges between the commas of a bracket."""
        out, start, i, end = [], opened + 1, opened + 1, self.partner[opened]
        while i < end:
            if self.words[i] in _CLOSERS:
                i = self.partner[i]
            elif self.words[i] == "<" and (behind := self.angle_end(i)) and behind <= end:
                i = behind - 1
            elif self.words[i] == ",":
                out.append((start, i))
                start = i + 1
            i += 1
        return [p for p in [*out, (start, end)] if p[1] > p[0]]

    def argument(self, start: int, end: int) -> str:
        one = end == start + 1 and (self.words[start][0] in "\"'`" or _WORD.fullmatch(self.words[start]))
        path = all(self.is_name(i) if (i - start) % 2 == 0 else self.words[i] == "." for i in range(start, end)) and (end - start) % 2 == 1
        return self.shown(start, end) if one or path else "expr"


class Walk:
    """One pass over the tokens of a file."""

    def __init__(self, path: str, source: Source) -> None:
        self.path, self.s, self.rows = path, source, []
        self.bodies: dict[int, tuple[str, str]] = {}
        self.owners: dict[int, str] = {-1: ""}
        self.parameters: dict[int, str] = {}
        self.busy = 0

    def add(self, fact: str, name: str, owner: str, detail: str, at: int, args: list[str] | None = None, generics: str = "") -> None:
        self.rows.append((self.path, len(self.rows), fact, name, owner, detail, args or [], generics, self.s.lines[at]))

    def owner(self, i: int) -> str:
        """Names of the definitions around token i, joined by dots."""
        opened, chain = self.s.inside[i], []
        while opened not in self.owners:
            chain.append(opened)
            opened = self.s.inside[opened]
        name = self.owners[opened]
        for b in reversed(chain):
            if b in self.bodies:
                name = f"{name}.{self.bodies[b][0]}" if name else self.bodies[b][0]
            self.owners[b] = name
        return name

    def run(self) -> list[tuple]:
        s, i = self.s, 0
        while i < len(s.words):
            w, opened = s.words[i], s.inside[i]
            if w == "@" and s.is_name(i + 1):
                i = self.decorator(i)
            elif i >= self.busy and opened in self.bodies and self.bodies[opened][1] == "class" and s.is_name(i):
                i = self.member(i, opened)
            elif s.is_name(i) and s.word(i - 1) not in (".", "?."):
                i = self.statement(i)
            else:
                i += 1
        return self.rows

    def statement(self, i: int) -> int:
        s, w = self.s, self.s.words[i]
        if w == "export" and s.word(i + 1) == "*" and s.inside[i] == -1:
            k = next((k for k in range(i + 2, min(i + 6, len(s.words))) if s.words[k][0] in "\"'"), None)
            if k is not None:
                self.add("reexport", s.words[k][1:-1], "", "", i)
                return k + 1
        if w == "import" and s.inside[i] == -1 and s.word(i + 1) not in ("(", "."):
            return self.imported(i)
        if w == "function":
            k = i + 2 if s.word(i + 1) == "*" else i + 1
            return self.function(k, k + 1, i) if s.is_name(k) else i + 1
        if w == "class" and s.is_name(i + 1):
            return self.classed(i + 1)
        if w in ("interface", "type") and s.is_name(i + 1) and s.word(i + 2) in ("{", "<", "extends", "="):
            return self.typed(i, i + 1)
        if w in ("const", "let", "var"):
            return self.variable(i)
        return self.call(i)

    def imported(self, i: int) -> int:
        s, k, found, star = self.s, i + 1, [], False
        while k < len(s.words) and s.words[k][0] not in "\"'" and s.words[k] != ";":
            if s.is_name(k) and s.words[k] not in ("from", "type"):
                if s.word(k - 1) == "as" and not star:
                    pass  # a new name of a named import: the original one counts
                elif s.words[k] != "as":
                    found.append(s.words[k])
                star = False
            elif s.words[k] == "*":
                star = True
                k += 1
            k += 1
        if k < len(s.words) and s.words[k][0] in "\"'":
            self.add("import", s.words[k][1:-1], "", ",".join(found), i)
        return k + 1

    def signature(self, opened: int) -> tuple[list[str], str, int]:
        """Parameters, return type and the index behind them, of the list that opens at ``opened``."""
        s, shown = self.s, []
        for start, end in s.parts(opened):
            while start < end and s.words[start] == "@":
                start += 2
                while s.word(start) == ".":
                    start += 2
                if s.word(start) == "(":
                    start = s.partner[start] + 1
            while start + 1 < end and s.words[start] in _MODIFIERS:
                start += 1
            if s.is_name(start):
                k = start + 1 + (s.word(start + 1) == "?")
                kind = s.shown(k + 1, min(s.type_end(k + 1), end)) if k < end and s.words[k] == ":" else ""
                shown.append(s.words[start] + (":" + kind if kind else ""))
        k, result = s.partner[opened] + 1, ""
        if s.word(k) == ":":
            end = s.type_end(k + 1)
            result, k = s.shown(k + 1, end), end
        return shown, result, k

    def function(self, name: int, k: int, at: int) -> int:
        s = self.s
        if s.word(k) == "<":
            k = s.angle_end(k) or k
        if s.word(k) != "(":
            return k
        shown, result, end = self.signature(k)
        self.add("function", s.words[name], self.owner(at), result, at, shown)
        if s.word(end) == "{":
            self.bodies[end] = (s.words[name], "function")
        return k

    def classed(self, name: int) -> int:
        s, k = self.s, name + 1
        base = ""
        while k < len(s.words) and s.words[k] != "{":
            if s.words[k] == "extends" and s.is_name(k + 1):
                base = s.words[k + 1]
            k = (s.angle_end(k) or k + 1) if s.words[k] == "<" else k + 1
        self.add("class", s.words[name], self.owner(name), base, name)
        if k < len(s.words):
            self.bodies[k] = (s.words[name], "class")
        return k

    def member(self, i: int, opened: int) -> int:
        s, start = self.s, i
        while s.words[i] in _MODIFIERS and s.is_name(i + 1):
            i += 1
        k = i + 1 + (s.word(i + 1) in ("?", "!"))
        if s.word(k) == "<":
            k = s.angle_end(k) or k
        owner = self.owner(start)
        if s.word(k) == "(":
            shown, result, end = self.signature(k)
            if s.word(end) in ("{", ";"):
                self.add("method", s.words[i], owner, result, i, shown)
                self.parameters[k] = f"{owner}.{s.words[i]}"
                if s.words[end] == "{":
                    self.bodies[end] = (s.words[i], "function")
                return k
            return k
        if s.word(k) not in (":", "=", ";"):
            return i + 1
        end = s.type_end(k + 1) if s.words[k] == ":" else k
        self.add("field", s.words[i], owner, s.shown(k + 1, end) if s.words[k] == ":" else "", i, ["optional"] if s.word(i + 1) == "?" else [])
        if s.word(end) == "=":
            self.busy = end + 1
            close = s.partner[opened]
            while self.busy < close and s.words[self.busy] != ";":
                new_line = s.lines[self.busy] != s.lines[self.busy - 1] and s.words[self.busy][0] not in ".?:&|+-*/" and self.busy > end + 1
                if new_line and s.words[self.busy - 1] not in ("=>", "=", "&&", "||", "??", "?", ":", "+"):
                    break
                self.busy = s.partner[self.busy] + 1 if s.words[self.busy] in _CLOSERS else self.busy + 1
        return max(end, k)

    def typed(self, at: int, name: int) -> int:
        s, k = self.s, name + 1
        if s.word(k) == "<":
            k = s.angle_end(k) or k
        while s.word(k) not in ("{", "=", ""):
            k = (s.angle_end(k) or k + 1) if s.words[k] == "<" else k + 1
        end = s.type_end(k + 1) if s.word(k) == "=" else k
        body = k + 1 if s.word(k) == "=" else k
        if s.word(body) == "{" and (s.word(k) == "{" or end == s.partner[body] + 1):
            self.add("schema", s.words[name], "", s.words[at], name)
            self.fields(s.words[name], body)
            return s.partner[body] + 1
        if s.word(k) == "=":
            self.add("schema", s.words[name], "", s.shown(k + 1, end), name)
        return max(end, k)

    def fields(self, owner: str, opened: int) -> None:
        s, i, close = self.s, opened + 1, self.s.partner[opened]
        while i < close:
            if s.words[i] == "readonly" and s.is_name(i + 1):
                i += 1
            optional = s.word(i + 1) == "?"
            k = i + 1 + optional
            if (s.is_name(i) or s.words[i][0] in "\"'") and s.word(k) == ":":
                end = min(s.type_end(k + 1), close)
                self.add("schema_field", s.words[i].strip("\"'"), owner, s.shown(k + 1, end), i, ["optional"] if optional else [])
                i = end
            else:
                i = s.partner[i] + 1 if s.words[i] in _CLOSERS else i + 1

    def variable(self, i: int) -> int:
        s, name = self.s, i + 1
        if not s.is_name(name):
            return i + 1
        exported, top = s.word(i - 1) == "export", s.inside[i] == -1
        k = s.type_end(name + 2) if s.word(name + 1) == ":" else name + 1
        if s.word(k) != "=":
            return name + 1
        k += 1
        start = k
        if s.word(k) == "async":
            k += 1
        if s.word(k) == "<":
            k = s.angle_end(k) or k
        shown, result, end = self.signature(k) if s.word(k) == "(" else ([s.word(k)], "", k + 1)
        if s.word(end) == "=>":
            if not exported:
                self.add("function", s.words[name], self.owner(i), result, i, shown)
            if s.word(end + 1) == "{":
                self.bodies[end + 1] = (s.words[name], "function")
        elif top and not exported:
            self.zod(start, s.words[name])
        return start

    def zod(self, i: int, name: str) -> bool:
        """A schema that is a plain ``z.kind(...)``, with its fields."""
        s = self.s
        if not (s.word(i) == "z" and s.word(i + 1) == "." and s.word(i + 2) in _ZOD_ROOTS and s.word(i + 3) == "(" and s.word(s.partner[i + 3] + 1) not in (".", "?.")):
            return False
        self.add("zod", name, "", s.words[i + 2], i)
        given = s.parts(i + 3)
        if s.words[i + 2] == "object" and given and s.words[given[0][0]] == "{" and s.partner[given[0][0]] + 1 == given[0][1]:
            for start, end in s.parts(given[0][0]):
                if s.word(start + 1) == ":" and (s.is_name(start) or s.words[start][0] in "\"'"):
                    kind, flags = self.zod_type(start + 2, end)
                    self.add("zod_field", s.words[start].strip("\"'"), name, kind, start, flags)
        return True

    def zod_type(self, i: int, end: int) -> tuple[str, list[str]]:
        """The kind at the root of a chain of calls, and which of optional and nullable are in it."""
        s, calls, first, root = self.s, [], i, i
        i += 1
        while i + 2 < end and s.words[i] == "." and s.is_name(i + 1):
            if s.words[i + 2] == "(":
                calls.append((s.words[i + 1], i == root + 1))
                i = s.partner[i + 2] + 1
            else:
                calls, i = [], i + 2
        if i != end:
            return "unknown", []
        kind = calls[0][0] if calls and calls[0][1] and s.words[first] == "z" else "unknown"
        return kind, [f for f in ("optional", "nullable") if any(c == f for c, _ in calls)]

    def call(self, i: int) -> int:
        s, behind = self.s, i + 1
        if s.words[i] in _NOT_CALLED or s.word(i - 1) in ("new", "function"):
            return i + 1
        if s.inside[i] == -1 and s.words[i] == "z" and (i == 0 or s.word(i - 1) in (";", "}", ")")) and self.zod(i, "ZodSchema"):
            pass
        chain, k = [s.words[i]], i + 1
        while k < len(s.words):
            w = s.words[k]
            if w in (".", "?.") and s.is_name(k + 1):
                chain.append(s.words[k + 1])
                k += 2
                continue
            types, opened = "", k + (w == "?.")
            if w == "<" and (end := s.angle_end(k)) and s.word(end) == "(":
                types, opened = self.generics(k, end), end
            if s.word(opened) != "(":
                break
            args = [s.argument(*p) for p in s.parts(opened)]
            self.add("call", ".".join(chain), self.owner(i), str(len(args)), k - 1, args, types)
            if len(chain) == 2 and chain[1] in _ZOD_CHECKS:
                self.add("zod_usage", chain[0], self.owner(i), chain[1], i)
            k = s.partner[opened] + 1
        return behind

    def generics(self, start: int, end: int) -> str:
        s, out, k = self.s, [], start + 1
        while k < end - 1:
            stop = s.type_end(k)
            if stop == k:
                stop = k + 1
            else:
                out.append(s.shown(k, min(stop, end - 1)))
            k = stop + (s.word(stop) == ",")
        return "|".join(out)

    def decorator(self, i: int) -> int:
        s, at, name, k = self.s, i, s_name(self.s, i + 1), i + 2
        while s.word(k) == "." and s.is_name(k + 1):
            k += 2
        args = [s.argument(*p) for p in s.parts(k)] if s.word(k) == "(" else []
        k = behind = s.partner[k] + 1 if s.word(k) == "(" else k
        while s.word(k) == "@":
            k += 2
            while s.word(k) == ".":
                k += 2
            if s.word(k) == "(":
                k = s.partner[k] + 1
        while s.word(k) in _MODIFIERS and s.is_name(k + 1):
            k += 1
        target, opened, owner = s.word(k), s.inside[at], self.owner(at)
        if target == "class":
            self.add("class_decorator", name, s.word(k + 1), ",".join(args), at, args)
        elif opened in self.parameters:
            self.add("param_decorator", name, f"{self.parameters[opened]}.{target}", ",".join(args), at, args)
        elif s.is_name(k):
            kind = "method_decorator" if s.word(k + 1) in ("(", "<") else "field_decorator"
            self.add(kind, name, f"{owner}.{target}" if owner else target, ",".join(args), at, args)
        return behind


def s_name(source: Source, i: int) -> str:
    """The dotted name that starts at token i."""
    k = i + 1
    while source.word(k) == "." and source.is_name(k + 1):
        k += 2
    return source.shown(i, k)


def facts_of(path: str, content: str | None) -> list[tuple]:
    try:
        return Walk(path, Source(content or "")).run()
    except Unmatched as error:
        return [(path, 0, "error", "Unmatched", "", "", [], "", error.line)]


def extract(files: DataFrame) -> DataFrame:
    """Facts of (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [c.split()[0] for c in FACTS.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if rows := facts_of(path, content):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=columns)

    return files.select("path", "content").mapInArrow(run, FACTS)


def _bare(text):
    return F.coalesce(F.regexp_replace(text, "^['\"`]|['\"`]$", ""), F.lit(""))


def nest_routes(facts: DataFrame) -> DataFrame:
    """Routes of controller classes: verb and path of the method's decorator, joined to the class's path."""
    prefix = facts.filter("fact = 'class_decorator' and name = 'Controller'").groupBy("path", F.col("owner").alias("class")).agg(F.max_by(_bare(F.get("args", 0)), "ord").alias("prefix"))
    verb = F.when(F.col("name").rlike("^(Get|Post|Put|Delete|Patch|GET|POST|PUT|DELETE|PATCH)$"), F.upper("name"))
    methods = facts.filter("fact = 'method_decorator'").select("path", verb.alias("method"), F.substring_index("owner", ".", 1).alias("class"), F.col("owner").alias("handler"), _bare(F.get("args", 0)).alias("own"), "line")
    joined = methods.filter("method is not null").join(prefix, ["path", "class"], "left")
    return joined.select("path", "method", names.join_paths(F.coalesce("prefix", F.lit("")), F.col("own")).alias("route"), "handler", "line")


def api_calls(facts: DataFrame, sdk: DataFrame | None = None) -> DataFrame:
    """Calls of HTTP clients and data hooks, by the ordered rules of ``linking.classify_calls``; ``sdk``: name, method, path of generated functions."""
    dotted = F.split("name", r"\.")
    calls = facts.filter("fact = 'call'").select(
        F.col("path").alias("file"), "ord", "line", F.col("name").alias("callee"), F.get("args", 0).alias("arg"), "generics", F.lit(None).cast("string").alias("options"),
        F.get(dotted, 0).alias("base"), F.when(F.size(dotted) > 1, F.element_at(dotted, -1)).alias("property"),
    )
    none = calls.limit(0).select(F.col("callee").alias("name"), F.col("callee").alias("method"), F.col("callee").alias("path"))
    return linking.classify_calls(calls, none if sdk is None else sdk)


def zod_fields(facts: DataFrame) -> DataFrame:
    """Fields of Zod schemas with their kind and flags."""
    has = lambda flag: F.array_contains("args", flag).alias(flag)
    return facts.filter("fact = 'zod_field'").select("path", F.col("owner").alias("schema"), F.col("name").alias("field"), F.col("detail").alias("field_type"), has("optional"), has("nullable"))


def type_fields(facts: DataFrame) -> DataFrame:
    """Fields of interfaces and object types."""
    return facts.filter("fact = 'schema_field'").select("path", F.col("owner").alias("schema"), F.col("name").alias("field"), F.col("detail").alias("field_type"), F.array_contains("args", "optional").alias("optional"))


def zod_usages(facts: DataFrame) -> DataFrame:
    """Checks by a Zod schema, in top-level statements only."""
    return facts.filter("fact = 'zod_usage' and owner = ''").select("path", F.col("name").alias("schema"), F.col("detail").alias("check"), "line")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example's sources, and those of a team for each supplier."""
    return per_supplier(spark, sf_dir, EXAMPLE, "User")


QUERIES = {
    "typescript_facts": lambda spark, sf_dir: extract(examples(spark, sf_dir)),
    "nest_routes": lambda spark, sf_dir: nest_routes(extract(examples(spark, sf_dir))),
    "typescript_api_calls": lambda spark, sf_dir: api_calls(extract(examples(spark, sf_dir))).select("file", "rule", "method", "path"),
    "zod_fields": lambda spark, sf_dir: zod_fields(extract(examples(spark, sf_dir))),
    "typescript_fields": lambda spark, sf_dir: type_fields(extract(examples(spark, sf_dir))),
    "zod_usages": lambda spark, sf_dir: zod_usages(extract(examples(spark, sf_dir))),
}
ORACLE_SQL = {
    "nest_routes": per_supplier_sql("SELECT * FROM (VALUES ('users.controller.ts', 'GET', '/users/:id', 'UsersController.findOne', 8), ('users.controller.ts', 'POST', '/users', 'UsersController.create', 13)) AS t(path, method, route, handler, line)", ('User',), ('handler',), ('path',)),
    "typescript_api_calls": per_supplier_sql("SELECT * FROM (VALUES ('api.ts', 'axios', 'GET', '''/items/1'''), ('api.ts', 'fetch', 'GET', '\"/health\"'), ('api.ts', 'client', 'POST', '''/items''')) AS t(file, rule, method, path)", ('User',), (), ('file',)),
    "zod_fields": per_supplier_sql("SELECT * FROM (VALUES ('api.ts', 'User', 'id', 'number', false, false), ('api.ts', 'User', 'mail', 'string', true, false), ('api.ts', 'User', 'note', 'string', false, true), ('api.ts', 'User', 'tags', 'array', false, false)) AS t(path, schema, field, field_type, optional, nullable)", ('User',), ('schema',), ('path',)),
    "typescript_fields": per_supplier_sql("SELECT * FROM (VALUES ('api.ts', 'Item', 'id', 'number', false), ('api.ts', 'Item', 'title', 'string', true), ('api.ts', 'Item', 'owners', 'Array<User>', false)) AS t(path, schema, field, field_type, optional)", ('User',), ('schema', 'field_type'), ('path',)),
    "zod_usages": per_supplier_sql("SELECT * FROM (VALUES ('api.ts', 'User', 'safeParse', 20)) AS t(path, schema, \"check\", line)", ('User',), ('schema',), ('path',)),
}
