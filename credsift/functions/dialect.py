"""ECMAScript regular expressions, as pattern registries have them, with the same meaning in the JVM's syntax or in that of Python's
`regex` module.

What differs: word boundaries and white space (ASCII against Unicode), what a dot leaves out, where `$` matches, class syntax.
Anything that has no equal is rejected loudly.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

FLAGS = "dgimsuvy"
# The white space and line ends of ECMAScript.
SPACE = "\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
LINE_END = "\\n\\r\\x{2028}\\x{2029}"
WORD_CLASS = "0-9A-Za-z_"
WORD = f"[{WORD_CLASS}]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
NO_BOUNDARY = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}")


class UnsupportedPattern(ValueError):
    """The pattern uses what the JVM has no equal for, or isn't a valid pattern."""


@dataclass(frozen=True)
class Compiled:
    regex: str
    groups: int


@dataclass(frozen=True)
class Target:
    """How a dialect writes what differs: a code point of 4 or more hexadecimal digits, the end of the text, a reference by name.

    nested: whether classes may hold classes.
    """

    point: Callable[[str], str]
    end: str
    reference: str
    nested: bool

    def points(self, text: str) -> str:
        """Text with the JVM's code points written as the dialect does."""
        return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: self.point(m[1]), text)


JVM = Target(lambda digits: f"\\x{{{digits}}}", "\\z", "\\k<{}>", True)
PYTHON = Target(lambda digits: f"\\U{int(digits, 16):08X}", "\\Z", "(?P={})", False)


def translate(source: str, flags: str = "", to: Target = JVM) -> Compiled:
    """A pattern in another dialect, and its number of capture groups."""
    if len(set(flags)) < len(flags) or set(flags) - set(FLAGS):
        raise UnsupportedPattern(f"invalid flags {flags!r}")
    if "y" in flags:
        raise UnsupportedPattern("sticky patterns have no equal")
    out: list[str] = []
    groups = i = depth = 0
    unicode_mode = "u" in flags or "v" in flags
    while i < len(source):
        c = source[i]
        if c == "\\":
            piece, i = _escape(source, i, unicode_mode, False, to)
            out.append(piece)
            continue
        if c == "[":
            piece, i = _class(source, i, unicode_mode, to)
            out.append(piece)
            continue
        if c == ".":
            out.append("(?s:.)" if "s" in flags else to.points(f"[^{LINE_END}]"))
        elif c == "$":
            out.append(to.points(f"(?=[{LINE_END}]|{to.end})") if "m" in flags else to.end)
        elif c == "^":
            out.append(to.points(f"(?:(?<=[{LINE_END}])|\\A)") if "m" in flags else "\\A")
        elif c == "(":
            one = _choice(source, i, unicode_mode, to)
            if one:
                piece, captured, i = one
                groups += captured
                out.append(piece)
                continue
            depth += 1
            rest = source[i + 1 : i + 4]
            if rest[:1] != "?":
                groups += 1
            elif rest[:2] == "?<" and rest[2:3] not in ("=", "!"):
                groups += 1
                name = re.match(r"\?<([A-Za-z$_][\w$]*)>", source[i + 1 :])
                if not name:
                    raise UnsupportedPattern("invalid group name")
                if not name[1].isalnum() or not name[1].isascii():
                    # group names are only letters and digits in the JVM; numbers stay the same without the name
                    out.append("(")
                    i += 1 + name.end()
                    continue
            elif not re.match(r"\?(?:[:=!]|<[=!]|[ims]*(?:-[ims]*)?:)", source[i + 1 :]):
                raise UnsupportedPattern(f"unknown group at {i}")
            out.append("(")
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise UnsupportedPattern("unmatched )")
            out.append(")")
        elif c == "{":
            m = QUANTIFIER.match(source, i)
            if m and out:
                out.append(m[0])
                i = m.end()
                continue
            out.append("\\{")
        elif c in "}]":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    if depth:
        raise UnsupportedPattern("unmatched (")
    # folding beyond ASCII only where the pattern itself goes beyond it
    mode = "" if "i" not in flags else "(?i)" if source.isascii() else "(?iu)"
    return Compiled(mode + "".join(out), groups)


def _choice(source: str, i: int, unicode_mode: bool, to: Target) -> tuple[str, int, int] | None:
    """The group at i as one class, how many groups it captures, and where it ends; None unless all its alternatives are single characters.

    At most one alternative of such a choice matches, and takes one character, so nothing changes but the time: choices are tried one after
    another at each character. Alternatives that share characters, or go beyond ASCII, stay as they are written.
    """
    captured = int(source[i + 1 : i + 2] != "?")
    if not captured and source[i + 1 : i + 3] != "?:":
        return None
    body, taken = "", set()
    i += 1 if captured else 3
    first = i
    while i < len(source):
        c = source[i]
        if c == "[":
            piece, i = _class(source, i, unicode_mode, to)
            piece = piece[1:-1] if piece.startswith("[") else "^"
        elif c == "\\":
            if not re.match(r"[dw]|[^\sA-Za-z0-9]", source[i + 1 : i + 2]):
                return None
            piece, i = _escape(source, i, unicode_mode, True, to)
        elif c in "^$.*+?()]{}|":
            return None
        else:
            piece, i = ("\\" + c if c in "&~-" else c), i + 1
        members = _members(piece)
        if not members or members & taken:
            return None
        body, taken = body + piece, taken | members
        if source[i : i + 1] == ")" and source.find("|", first, i) >= 0:
            return ("([{}])" if captured else "[{}]").format(body), captured, i + 1
        if source[i : i + 1] != "|":
            return None
        i += 1
    return None


def _members(body: str) -> set[int]:
    """Characters of a class without negation, classes within it, escapes by letters, dashes at its ends or anything beyond ASCII; else none."""
    if body.startswith(("^", "-")) or body.endswith("-") and not body.endswith("\\-") or not body.isascii() or re.search(r"\\[A-Za-z0-9]|(?<!\\)\[", body):
        return set()
    ends = re.findall(r"\\?(.)(?:-\\?(.))?", body, re.S)
    return {n for low, high in ends for n in range(ord(low), ord(high or low) + 1)}


def _escape(source: str, i: int, unicode_mode: bool, inside: bool, to: Target = JVM) -> tuple[str, int]:
    """The escape at i, and where it ends. Negated classes within a class stay as they are for _class to see."""
    if i + 1 >= len(source):
        raise UnsupportedPattern("\\ at the end")
    c = source[i + 1]
    if c == "b":
        return ("\\x08" if inside else BOUNDARY), i + 2
    if c == "B" and not inside:
        return NO_BOUNDARY, i + 2
    if c == "s":
        return to.points(SPACE if inside else f"[{SPACE}]"), i + 2
    if c in "SDW" and inside and not to.nested:
        return "\\" + c, i + 2
    if c == "S":
        return to.points(f"[^{SPACE}]"), i + 2
    if c in "dDwW" and to.nested:
        return "\\" + c, i + 2
    if c in "dDwW":
        range_ = "0-9" if c in "dD" else WORD_CLASS
        return (range_ if inside else f"[{'^' * c.isupper()}{range_}]"), i + 2
    if c in "tnrf":
        return "\\" + c, i + 2
    if c == "v":
        return "\\x0B", i + 2
    if c == "0" and not source[i + 2 : i + 3].isdigit():
        return "\\x00", i + 2
    if c.isdigit():
        if inside or c == "0":
            raise UnsupportedPattern("octal escape")
        m = re.compile(r"\d+").match(source, i + 1)
        return f"\\{m[0]}", m.end()
    if c == "x":
        m = re.compile(r"[0-9A-Fa-f]{2}").match(source, i + 2)
        return (f"\\x{m[0]}", m.end()) if m else ("x", i + 2)
    if c == "u":
        m = re.compile(r"[0-9A-Fa-f]{4}").match(source, i + 2)
        low = m and not to.nested and "d8" <= m[0][:2].lower() <= "db" and re.compile(r"\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})").match(source, m.end())
        if low:  # two halves of a character, which Python has as one
            return to.point(f"{0x10000 + ((int(m[0], 16) & 0x3FF) << 10) + (int(low[1], 16) & 0x3FF):X}"), low.end()
        if m:
            return f"\\u{m[0]}", m.end()
        m = re.compile(r"\{([0-9A-Fa-f]+)\}").match(source, i + 2)
        if m and unicode_mode:
            return to.point(m[1]), m.end()
        raise UnsupportedPattern("\\u without four digits")
    if c == "c":
        m = re.compile(r"[A-Za-z]").match(source, i + 2)
        if not m:
            raise UnsupportedPattern("\\c without a letter")
        return f"\\x{ord(m[0].upper()) ^ 64:02x}", m.end()
    if c == "k":
        m = re.compile(r"<([A-Za-z0-9]+)>").match(source, i + 2)
        if not m:
            raise UnsupportedPattern("named reference")
        return to.reference.format(m[1]), m.end()
    if c in "pP":
        m = re.compile(r"\{[\w=]+\}").match(source, i + 2)
        if unicode_mode and m:
            return "\\" + c + m[0], m.end()
        return c, i + 2
    if c.isalpha():
        if unicode_mode:
            raise UnsupportedPattern(f"unknown escape \\{c}")
        return c, i + 2
    return "\\" + c, i + 2


def _class(source: str, i: int, unicode_mode: bool, to: Target = JVM) -> tuple[str, int]:
    """The character class at i, and where it ends."""
    start, i = i, i + 1
    negated = source[i : i + 1] == "^"
    i += negated
    out: list[str] = []
    while i < len(source) and source[i] != "]":
        c = source[i]
        if c == "\\":
            piece, i = _escape(source, i, unicode_mode, True, to)
            out.append(piece)
            continue
        out.append("\\" + c if c in "[&^~" else c)
        i += 1
    if i >= len(source):
        raise UnsupportedPattern(f"class at {start} isn't closed")
    if not out:
        return ("(?s:.)" if negated else "(?!)"), i + 1
    if to.nested or not {"\\S", "\\D", "\\W"} & set(out):
        return f"[{'^' * negated}{''.join(out)}]", i + 1
    # without nested classes: a choice of classes, or, negated, all of their opposites at once
    ranges = {"\\S": to.points(SPACE), "\\D": "0-9", "\\W": WORD_CLASS}
    plain, opposites = "".join(x for x in out if x not in ranges), [ranges[x] for x in out if x in ranges]
    if negated:
        ahead = [f"(?=[{r}])" for r in opposites[1:]] + ([f"(?![{plain}])"] if plain else [])
        return f"(?:{''.join(ahead)}[{opposites[0]}])", i + 1
    return "(?:" + "|".join([f"[^{r}]" for r in opposites] + ([f"[{plain}]"] if plain else [])) + ")", i + 1


def required_literals(source: str) -> frozenset[str] | None:
    """Strings of which every match contains at least one, or None if there are none of two characters and more.

    They are a cheap test before a pattern is tried at all.
    """
    try:
        found, end = _alternatives(source, 0)
    except (IndexError, UnsupportedPattern):
        return None
    return found if end == len(source) and found and min(map(len, found)) >= 2 else None


def _alternatives(source: str, i: int) -> tuple[frozenset[str], int]:
    """Required strings of the alternatives from i to the end or the closing bracket; empty if one has none."""
    every: list[frozenset[str]] = []
    while True:
        best, i = _sequence(source, i)
        every.append(best)
        if i < len(source) and source[i] == "|":
            i += 1
            continue
        return (frozenset().union(*every) if all(every) else frozenset()), i


def _sequence(source: str, i: int) -> tuple[frozenset[str], int]:
    candidates: list[frozenset[str]] = []
    run = ""

    def flush() -> None:
        nonlocal run
        if run:
            candidates.append(frozenset([run]))
        run = ""

    while i < len(source) and source[i] not in "|)":
        c, literal, inner = source[i], None, None
        if c == "\\":
            n = source[i + 1]
            if n.isalnum():
                piece_end = _escape(source, i, False, False)[1]
            else:
                literal, piece_end = n, i + 2
        elif c == "[":
            piece_end = _class(source, i, False)[1]
        elif c == "(":
            m = re.compile(r"\((?:\?(?::|<[A-Za-z_$][\w$]*>|(?P<look>[=!]|<[=!])))?").match(source, i)
            inner, piece_end = _alternatives(source, m.end())
            if source[piece_end] != ")":
                raise UnsupportedPattern("group")
            piece_end += 1
            if m["look"]:
                inner = frozenset()
        elif c in ".^$":
            piece_end = i + 1
        else:
            literal, piece_end = c, i + 1
        q = re.compile(r"[*+?]\??|\{(\d+)(?:,\d*)?\}\??").match(source, piece_end)
        optional = bool(q) and (q[0][0] in "*?" or q[1] == "0")
        if literal is not None and not q:
            run += literal
        else:
            if literal is not None and not optional:
                run += literal
            flush()
            if inner and not optional:
                candidates.append(inner)
        i = q.end() if q else piece_end
    flush()
    return max(candidates, key=lambda s: min(map(len, s)), default=frozenset()), i
