"""Two facts about places in JavaScript and TypeScript sources, from a tokeniser that recovers instead of a full parser.

For a place: the name of the innermost variable declarator around it, and whether it is inside an environment access or an
interpolation. What can't be read ends with its line, or with the statement whose brackets don't close; places in there count as ones
without a tree, and the rules that need one keep what they find. All else of the source has its facts.

A slash is a regular expression after what can't end an operand, after the brackets of if, while, for and with, and after blocks; JSX that
doesn't close is taken for signs of comparison. Facts of all places come from one sweep over the sorted spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

EXTENSIONS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")
WITH_JSX = (".js", ".jsx", ".mjs", ".cjs", ".tsx")

SPACES = re.compile(r"[\s\ufeff]+|//[^\n\r  ]*|/\*.*?\*/", re.S)
NAME = re.compile(r"#?(?:[^\W\d]|[$])[\w$‌‍]*|\\u")
NUMBER = re.compile(r"0[xXoObB][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[A-Za-z]*")
STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n\r]|\\(?:\r\n|[\s\S]))*{q}") for q in "\"'"}
PUNCTUATION = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
#: Words after which an operand comes, so a slash starts a regular expression.
BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else await yield extends default".split())
#: Words whose brackets are followed by a statement, so by an operand.
HEADERS = frozenset("if while for with".split())
#: Signs before a brace that begins a block.
BEFORE_BLOCK = frozenset("; { } ) =>".split())
#: Words that begin a statement where a line begins with them: there reading goes on after brackets that don't close.
STARTS = frozenset("const let var function class export import type interface enum".split())
#: Signs that go on with an expression on a new line.
GOES_ON = frozenset(". ?. ( [ ` ? : , => = + - * / % ** & | ^ && || ?? < > <= >= == != === !== << >> >>> += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())


class Unreadable(ValueError):
    """A place from which reading can't go on within what is being read."""


@dataclass
class Token:
    kind: str  # name, number, string, regex, template, jsx, or the sign itself
    start: int
    end: int
    text: str
    newline: bool  # a line ends before it
    mate: int = -1  # place of the closing bracket's token


@dataclass
class Template:
    start: int
    end: int = -1
    quasis: list[tuple[int, int]] = field(default_factory=list)

    @property
    def interpolates(self) -> bool:
        return len(self.quasis) > 1

    def is_static(self, at: int) -> bool:
        """Whether a place is in the template's own text."""
        k = bisect_right(self.quasis, (at, 1 << 62)) - 1
        return k >= 0 and self.quasis[k][0] <= at < self.quasis[k][1]


class Source:
    """Tokens, declarators, environment accesses and templates of one source."""

    def __init__(self, text: str, extension: str = ".js"):
        self.text, self.jsx = text, extension in WITH_JSX
        self.tokens: list[Token] = []
        self.templates: list[Template] = []
        #: Spans without facts, and, for each open bracket, whether an operand follows where it closes.
        self.broken: list[tuple[int, int]] = []
        self.opened: list[bool] = []
        self.at = text.index("\n") if text.startswith("#!") and "\n" in text else len(text) if text.startswith("#!") else 0
        try:
            self.read(None)
        except Unreadable as e:
            self.broken.append((e.args[0], len(text)))
        self.match()
        self.declarators: list[tuple[int, int, str | None]] = []
        self.accesses: list[tuple[int, int]] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "name" and t.text in ("const", "let", "var"):
                self.declare(i)
            elif t.kind == "name" and t.text in ("process", "import"):
                self.access(i)

    # ---- tokens

    def skip(self) -> bool:
        """Passes white space and comments; whether a line ended."""
        ended = False
        while m := SPACES.match(self.text, self.at):
            ended = ended or any(c in m[0] for c in "\n\r  ")
            self.at = m.end()
        if self.text.startswith("/*", self.at):
            raise Unreadable(self.at)
        return ended

    def pass_line(self) -> None:
        """Gives up the line."""
        begin = max(self.text.rfind("\n", 0, self.at) + 1, self.tokens[-1].end if self.tokens and self.tokens[-1].kind in ("{", "}", ";") else 0)
        end = self.text.find("\n", self.at)
        end = len(self.text) if end < 0 else end
        self.broken.append((begin, end))
        self.tokens.append(Token(";", self.at, end, "", False))
        self.at = end

    def operand_next(self) -> bool:
        if not self.tokens:
            return True
        last = self.tokens[-1]
        if last.kind == "name":
            after_dot = len(self.tokens) > 1 and self.tokens[-2].kind in (".", "?.")
            return last.text in BEFORE_OPERAND and not after_dot
        if last.kind in (")", "}"):
            return self.closed
        return last.kind not in ("number", "string", "regex", "template", "jsx", "]", "++", "--")

    def opens(self, sign: str) -> bool:
        """Whether an operand follows where the bracket that is read now will close."""
        last = self.tokens[-1] if self.tokens else None
        if sign == "(":
            return last is not None and last.kind == "name" and last.text in HEADERS and not (len(self.tokens) > 1 and self.tokens[-2].kind in (".", "?."))
        return sign == "{" and (last is None or last.kind in BEFORE_BLOCK or last.kind == "name" and last.text in ("else", "do", "try", "finally"))

    def read(self, until: str | None) -> None:
        """Reads tokens to the end, or up to and with the `until` that closes what is being read."""
        depth = 0
        text, begun = self.text, self.at
        while True:
            newline = self.skip()
            if self.at >= len(text):
                if until is not None:
                    raise Unreadable(begun)
                return
            c, start = text[self.at], self.at
            if c == "}" and until == "}" and depth == 0:
                self.at += 1
                return
            if c in STRING:
                if m := STRING[c].match(text, start):
                    self.push("string", m.end(), newline)
                else:
                    self.pass_line()
            elif c == "`":
                self.template(newline)
            elif (m := NUMBER.match(text, start)) and (c.isdigit() or text[start + 1 : start + 2].isdigit()):
                self.push("number", m.end(), newline)
            elif (m := NAME.match(text, start)) is not None:
                self.push("name", m.end(), newline)
            elif c == "/" and self.operand_next() and (m := REGEX.match(text, start)):
                self.push("regex", m.end(), newline)
            elif c == "<" and self.jsx and (self.operand_next() or self.tokens[-1].kind == "}") and self.element_ahead() and self.whole_element():
                self.tokens.append(Token("jsx", start, self.at, "", newline))
            elif m := PUNCTUATION.match(text, start):
                depth += (m[0] == "{") - (m[0] == "}")
                if m[0] in ("(", "[", "{"):
                    self.opened.append(self.opens(m[0]))
                elif m[0] in (")", "]", "}"):
                    self.closed = self.opened.pop() if self.opened else m[0] == "}"
                self.push(m[0], m.end(), newline)
            else:
                self.pass_line()

    closed = False

    def whole_element(self) -> bool:
        """Passes a JSX element, or nothing if it doesn't close."""
        at, tokens, templates, broken, opened = self.at, len(self.tokens), len(self.templates), len(self.broken), [*self.opened]
        try:
            self.element()
            return True
        except Unreadable:
            self.at, self.opened = at, opened
            del self.tokens[tokens:], self.templates[templates:], self.broken[broken:]
            return False

    def push(self, kind: str, end: int, newline: bool) -> None:
        self.tokens.append(Token(kind, self.at, end, self.text[self.at : end], newline))
        self.at = end

    def template(self, newline: bool) -> None:
        start = self.at
        found = Template(start)
        self.templates.append(found)
        self.at += 1
        quasi = self.at
        while True:
            if self.at >= len(self.text):
                self.templates.remove(found)
                raise Unreadable(start)
            c = self.text[self.at]
            if c == "\\":
                self.at += 2
            elif c == "`":
                found.quasis.append((quasi, self.at))
                self.at += 1
                break
            elif self.text.startswith("${", self.at):
                found.quasis.append((quasi, self.at))
                # brackets within the interpolation match among themselves
                self.tokens.append(Token("{", self.at, self.at + 2, "${", False))
                self.at += 2
                self.read("}")
                self.tokens.append(Token("}", self.at - 1, self.at, "}", False))
                quasi = self.at
            else:
                self.at += 1
        found.end = self.at
        self.tokens.append(Token("template", start, self.at, "", newline))

    def element_ahead(self) -> bool:
        m = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?P<next>\s*(?:extends\b|,|=(?!>))?))").match(self.text, self.at)
        return bool(m) and not (m["next"] or "").strip()

    def element(self) -> None:
        """Passes a JSX element; tokens within its braces are read like others."""
        text, nesting = self.text, 0
        while True:
            # at a tag
            m = re.compile(r"<\s*(/?)\s*([\w$.:-]*)").match(text, self.at)
            if not m:
                raise Unreadable(self.at)
            closing = bool(m[1])
            self.at = m.end()
            empty = False
            while True:
                self.skip()
                c = text[self.at : self.at + 1]
                if not c:
                    raise Unreadable(self.at)
                if c == ">":
                    self.at += 1
                    break
                if text.startswith("/>", self.at):
                    self.at += 2
                    empty = True
                    break
                if c in "\"'":
                    end = text.find(c, self.at + 1)
                    if end < 0:
                        raise Unreadable(self.at)
                    self.at = end + 1
                elif c == "{":
                    self.braces()
                elif c == "<":
                    self.element()
                else:
                    self.at += 1
            nesting += 0 if empty else -1 if closing else 1
            if nesting <= 0:
                return
            while True:
                c = text[self.at : self.at + 1]
                if not c:
                    raise Unreadable(self.at)
                if c == "{":
                    self.braces()
                elif c == "<":
                    break
                else:
                    self.at += 1

    def braces(self) -> None:
        self.tokens.append(Token("{", self.at, self.at + 1, "{", False))
        self.at += 1
        self.read("}")
        self.tokens.append(Token("}", self.at - 1, self.at, "}", False))

    def match(self) -> None:
        """Pairs brackets. One that closes nothing gives up its line, one that isn't closed all up to the next line that begins a statement."""
        closing, stack = {")": "(", "]": "[", "}": "{"}, []
        for i, t in enumerate(self.tokens):
            if t.kind in ("(", "[", "{"):
                stack.append(i)
            elif t.kind in closing:
                at = next((k for k in range(len(stack) - 1, -1, -1) if self.tokens[stack[k]].kind == closing[t.kind]), None)
                if at is None:
                    self.broken.append((self.line_begin(t.start), self.line_end(t.end)))
                    continue
                for k in stack[at + 1 :]:
                    self.lose(k, i)
                self.tokens[stack[at]].mate = i
                del stack[at:]
        for k in stack:
            self.lose(k, len(self.tokens))

    def line_begin(self, at: int) -> int:
        return self.text.rfind("\n", 0, at) + 1

    def line_end(self, at: int) -> int:
        end = self.text.find("\n", at)
        return len(self.text) if end < 0 else end

    def lose(self, i: int, stop: int) -> None:
        """Gives up what follows an opening bracket that isn't closed before token `stop`."""
        after = next((t.start for t in self.tokens[i + 1 : stop] if t.newline and t.kind == "name" and t.text in STARTS), None)
        end = after if after is not None else self.tokens[stop].start if stop < len(self.tokens) else len(self.text)
        self.broken.append((self.line_begin(self.tokens[i].start), end))

    # ---- facts

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def declare(self, i: int) -> None:
        """Declarators that the keyword at i starts."""
        if self.kind(i - 1) in (".", "?.") or self.kind(i + 1) not in ("name", "{", "["):
            return
        if self.tokens[i + 1].text in ("enum", "in", "of", "instanceof"):
            return
        in_for = self.kind(i - 1) == "(" and i >= 2 and self.tokens[i - 2].text in ("for", "await")
        i += 1
        while self.kind(i) in ("name", "{", "["):
            first = self.tokens[i]
            name = first.text if first.kind == "name" else None
            i = (i if name is not None else first.mate) + 1
            end = self.expression(i, in_for)
            self.declarators.append((first.start, self.tokens[end - 1].end, name))
            if self.kind(end) != ",":
                return
            i = end + 1

    def expression(self, i: int, in_for: bool) -> int:
        """Place after the type and initialiser that may follow a declared name: the first token that isn't part of it."""
        angle = 0
        typed = self.kind(i) == ":" or self.kind(i) == "!"
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "=":
                typed = False
                angle = 0
                i = self.angles(i + 1)
                continue
            if typed:
                angle += (t.kind == "<") - (t.kind.count(">") if set(t.kind) == {">"} else 0)
            if t.kind in (";", ")", "]", "}") or t.kind == "," and angle <= 0:
                return i
            if t.kind == "name" and t.text in ("of", "in") and in_for and self.kind(i - 1) in ("name", "]", "}"):
                return i
            if t.newline and self.kind(i - 1) not in ("=",) and self.ends(i):
                return i
            i = t.mate + 1 if t.mate >= 0 else i + 1
        return i

    def angles(self, i: int) -> int:
        """Place after the type parameters or the assertion at i, or i if there is none."""
        if self.kind(i) != "<":
            return i
        angle = 0
        for k in range(i, len(self.tokens)):
            t = self.tokens[k]
            angle += (t.kind == "<") - (t.kind.count(">") if set(t.kind) == {">"} else 0)
            if angle <= 0:
                return k + 1
            if t.kind in (";", ")", "]", "}"):
                break
        return i

    def ends(self, i: int) -> bool:
        """Whether a line end before the token at i ends the statement."""
        before, t = self.tokens[i - 1], self.tokens[i]
        complete = before.kind in ("name", "number", "string", "regex", "template", "jsx", ")", "]", "}", "++", "--") and before.text not in BEFORE_OPERAND
        goes_on = t.kind in GOES_ON or t.kind == "template" or t.kind == "name" and t.text in ("instanceof", "in", "as", "satisfies", "of")
        return complete and not goes_on

    def access(self, i: int) -> None:
        """The access process.env.X or import.meta.env.X that starts at i."""
        if self.kind(i - 1) in (".", "?."):
            return
        path = ["process", "env"] if self.tokens[i].text == "process" else ["import", "meta", "env"]
        k = i
        for n, name in enumerate(path):
            if n:
                if self.kind(k) != ".":
                    return
                k += 1
            if self.kind(k) != "name" or self.tokens[k].text != name:
                return
            k += 1
        if self.kind(k) == "." and self.kind(k + 1) == "name":
            self.accesses.append((self.tokens[i].start, self.tokens[k + 1].end))
        elif self.kind(k) == "[":
            self.accesses.append((self.tokens[i].start, self.tokens[self.tokens[k].mate].end))

    def facts(self, offsets: list[int]) -> dict[int, tuple[bool, str | None, bool, bool]]:
        """(has a tree, innermost declarator's name, in an access, interpolated) of places, from one sweep for each kind of span."""
        lost = _sweep([(a, b, True) for a, b in self.broken], offsets)
        named = _sweep(self.declarators, offsets)
        read = _sweep([(a, b, True) for a, b in self.accesses], offsets)
        inside = _sweep([(t.start, t.end, t) for t in self.templates], offsets)
        out = {}
        for at in offsets:
            if lost[at]:
                out[at] = False, None, False, False
                continue
            around = inside[at]
            static = bool(around) and around[-1].is_static(at)
            out[at] = True, named[at][-1] if named[at] else None, bool(read[at]), bool(around) and not static and any(t.interpolates for t in around)
        return out


def _sweep(spans: list[tuple], offsets: list[int]) -> dict[int, list]:
    """What stands with the spans around each offset, outermost first."""
    spans, stack, k, out = sorted(spans, key=lambda s: (s[0], -s[1])), [], 0, {}
    for at in sorted(set(offsets)):
        while k < len(spans) and spans[k][0] <= at:
            while stack and stack[-1][1] <= spans[k][0]:
                stack.pop()
            stack.append(spans[k])
            k += 1
        while stack and stack[-1][1] <= at:
            stack.pop()
        out[at] = [s[2] for s in stack if s[1] > at]
    return out


def facts(text: str, extension: str, places: list[tuple[int, int]]) -> list[tuple[bool, str | None, bool, bool]]:
    """(has a tree, declarator's name, in an environment access, interpolated) for each (line, character) place.

    Lines count from 1, characters from 0; a place outside the text has no facts, nor has one in a part that can't be read.
    """
    try:
        source = Source(text, extension)
    except RecursionError:
        return [(False, None, False, False)] * len(places)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    offsets = []
    for line, at in places:
        offset = starts[line - 1] + at if 0 < line <= len(starts) else -1
        offsets.append(offset if 0 <= offset < len(text) and (line == len(starts) or offset < starts[line]) else None)
    found = source.facts([o for o in offsets if o is not None])
    return [(True, None, False, False) if o is None else found[o] for o in offsets]
