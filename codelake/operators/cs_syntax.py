"""One C#-like content as plain values: declarations, imports and reference hints.

Runs in a Python worker, one content at a time, over what ``extract_cs`` hands
it. The patterns are written as Java reads them and translated by ``java``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from codelake import fixed_values as fv

CONFIDENCE = 0.75
# Depth given to a file-scoped namespace: nothing in the file closes it.
OPEN_ENDED = -1
# Larger than any line number.
NEVER = 1 << 30

# Tokens that are no code, over line breaks where the language allows it; what is
# never closed runs to the end. Possessive repeats: Java would match a greedy
# repeated group by recursion, one level per round, so a very long literal would
# overflow the stack of the task. The look ahead spares most places all but one test.
TOKEN = (
    r'[$@]*("{3,}+)(?s:.*?)(?:\1"*+|\z)'
    r'|(?:@|\$+@|@\$+)"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
    r'|\$*"[^"\\\r\n]*+(?:\\.[^"\\\r\n]*+)*+"'
    r"|'(?:[^'\\\r\n]|\\(?:x[0-9A-Fa-f]{1,4}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[^\r\n]))'"
    r"|//[^\r\n]*+"
    r"|/\*(?s:.*?)(?:\*/|\z)"
)
NOISE = rf"(?=[\"'/$@])(?:{TOKEN})|(?m:^)[ \t]*+#[^\r\n]*+"
ATTRIBUTES = r"(?:\[[^\]]*\]\s*)*"
MODIFIER = (
    r"(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|virtual|"
    r"override|async|extern|unsafe|new|volatile|const|required|file|ref)"
)
MODIFIERS = rf"((?:{MODIFIER}\s+)*)"
TYPE = r"([A-Za-z_][\w.:]*(?:<[^()=;{}]*>)?(?:\[[,\s]*\])*\??(?:\[[,\s]*\])*)"
NOT_A_TYPE = (
    r"(?!(?:return|new|throw|await|else|using|namespace|yield|case|goto|typeof|default|"
    r"class|struct|interface|enum|record|delegate|event|if|for|foreach|while|switch|lock|"
    r"catch|get|set|init|add|remove|where|public|private|protected|internal)\b)"
)

NAMESPACE = r"^\s*namespace\s+([\w.]+)\s*([;{]?)"
TYPE_HEAD = (
    rf"^\s*{ATTRIBUTES}{MODIFIERS}(class|struct|interface|enum|record\s+struct|record\s+class|record)"
    r"\s+([A-Za-z_]\w*)\s*(<[^>{(:]*>)?\s*(?:\((?:[^()]++|\([^()]*+\))*+\))?\s*(?::\s*([^{;]*))?"
)
DELEGATE = rf"^\s*{ATTRIBUTES}{MODIFIERS}delegate\s+{TYPE}\s+([A-Za-z_]\w*)\s*(<[^>(]*>)?\s*\("
CONSTRUCTOR = rf"^\s*{ATTRIBUTES}{MODIFIERS}([A-Za-z_]\w*)\s*\(((?:[^()]++|\([^()]*+\))*+)\)\s*(?::.*|\{{.*|=>.*)?$"
METHOD = (
    rf"^\s*{ATTRIBUTES}{MODIFIERS}{NOT_A_TYPE}{TYPE}\s+(?:[\w.]+(?:<[^>]*>)?\.)?([A-Za-z_]\w*)\s*"
    r"(<[^>(]*>)?\s*\(((?:[^()]++|\([^()]*+\))*+)\)\s*(?:where\b.*|\{.*|=>.*|;.*)?$"
)
# A member may name the interface that it implements.
EXPLICIT = r"(?:(?:[A-Za-z_]\w*(?:<[^<>]*>)?\.)+)?"
EVENT = rf"^\s*{ATTRIBUTES}{MODIFIERS}event\s+{TYPE}\s+{EXPLICIT}([A-Za-z_]\w*[^;{{]*)"
INDEXER = rf"^\s*{ATTRIBUTES}{MODIFIERS}{NOT_A_TYPE}{TYPE}\s+{EXPLICIT}this\s*\["
FIELD = (
    rf"^\s*{ATTRIBUTES}{MODIFIERS}{NOT_A_TYPE}{TYPE}\s+"
    r"([A-Za-z_]\w*\s*(?:(?:[=,](?!>).*)?(?=;\s*$)|=(?!>)[^;]*$))"
)
PROPERTY = (
    rf"^\s*{ATTRIBUTES}{MODIFIERS}{NOT_A_TYPE}{TYPE}\s+{EXPLICIT}([A-Za-z_]\w*)\s*(?:\{{.*|=>.*)?$"
)
USING = r"^\s*(?:global\s+)?using\s+(static\s+)?(?:([A-Za-z_]\w*)\s*=\s*)?([\w.:<>, ]+?)\s*;"

# A comma that separates types rather than generic arguments.
TYPE_COMMA = r",(?![^<>]*(?:<[^<>]*>[^<>]*)*>)"
BRACKETED = r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>=]*>"
# What is created may get its arguments or its braces on a later line.
CREATION = r"\bnew\s+([A-Za-z_][\w.]*(?:<[^();{}]*>)?\??)\s*(?:[({]|$)"

# Java's ``\s``.
_BLANKS = " \t\n\v\f\r"
_BREAKS = r"\n\r\x85\u2028\u2029"
_TRANSLATED = {
    "(?s:.*?)": r"(?:[\s\S]*?)",
    "(?m:^)": rf"(?<![^{_BREAKS}])",
    r"\z": r"\Z",
    r"\b": r"(?u:\b)",
    ".": rf"[^{_BREAKS}]",
    "$": r"(?=(?:\r\n|(?<!\r)\n|[\r\x85\u2028\u2029])?\Z)",
}
_PIECES = re.compile(r"\(\?s:\.\*\?\)|\(\?m:\^\)|\[\^?\]?(?:\\.|[^\]\\])*\]|\\.|.", re.S)


def java(pattern: str) -> re.Pattern:
    """A pattern of Java's syntax; ``\\w`` and ``\\s`` are of ASCII there, ``\\b``, ``.`` and ``$`` are not.

    One difference stays: numerals such as ``²`` count as part of a word here, and not in Java.
    """
    return re.compile("".join(_TRANSLATED.get(p, p) for p in _PIECES.findall(pattern)), re.ASCII)


_token, _namespace, _type_head, _using = java(TOKEN), java(NAMESPACE), java(TYPE_HEAD), java(USING)
_creation, _type_comma, _bracketed = java(CREATION), java(TYPE_COMMA), java(BRACKETED)
# With what a text must hold one of to match, in the order in which they are tried.
_members = {
    "delegate": (("delegate",), java(DELEGATE)), "event": (("event",), java(EVENT)), "indexer": (("this",), java(INDEXER)),
    "constructor": (("(",), java(CONSTRUCTOR)), "method": (("(",), java(METHOD)), "field": (("=", ";"), java(FIELD)),
    "property": (("",), java(PROPERTY)),
}
_suspect = java("[\"'/#]")
_noise_start = java("[\"'/$@#]")
_directive_start = java(r"(?m:^)[ \t]*+#")
_line_break = java(r"\r\n|\n|\r")
_no_break = java(r"[^\r\n]+")
_attribute_line = java(r"^(?:\[[^\]]*+\]\s*+)++$")
_head_word = java(r"\b(?:namespace|class|struct|interface|enum|record)\s")
_member_like = java(r"[A-Za-z_]\w*[^\w]*[A-Za-z_(]")
_not_member = java(r"^\s*(?:using|namespace)\b")
_where = java(r"\bwhere\b.*$")
_space = java(r"\s+")
_variance = java(r"^(?:in|out)\s+")
_first_word = java(r"^\s*([A-Za-z_]\w*)")
_word_only = java(r"[\w\s]*\z")
_type_noise = java(r"[?\s]|\[[,\s]*\]")
_type_args = java(r"<.*$")
_identifier = java(r"^[A-Za-z_]\w*$")
_param_attributes = java(r"^\s*(?:\[[^\]]*\]\s*)*")
_param_words = java(r"^(?:(?:this|ref|out|in|params|scoped|readonly)\s+)+")
_param = java(r"^(.*\S)\s+@?[A-Za-z_]\w*$")
_call = java(r"\(.*$")
_spaced_call = java(r"\s*\(.*$")
_bracket_first = java(r"^\s*\[")
_file_attribute = java(r"^\s*\[\s*(?:assembly|module)\s*:")
_round = java(r"\([^()]*\)")
_groups = java(r"^\s*((?:\[[^\]]*\]\s*)+)")
_attribute_name = java(r"[\[,]\s*(?:\w+\s*:\s*)?([A-Za-z_][\w.]*)")

_HEAD_WORDS = ("namespace", "class", "struct", "interface", "enum", "record")
_PREDEFINED = frozenset(fv.PREDEFINED_TYPES)
_VISIBILITY = frozenset(fv.VISIBILITY_WORDS)


def physical_lines(text: str) -> list[str]:
    """Lines on CRLF, LF or CR; a final terminator opens no further line."""
    if text.endswith("\r\n"):
        text = text[:-2]
    elif text.endswith(("\n", "\r")):
        text = text[:-1]
    return _line_break.split(text) if "\r" in text else text.split("\n")


def code_text(text: str) -> str:
    """The content without strings, comments and directives; their line breaks stay."""
    if not _suspect.search(text):
        return text
    # ``NOISE`` begins with one of a few characters, or with blanks and "#" on a line of their own:
    # going from one of these to the next spares the pattern all other places.
    kept, begin, at = [], 0, 0
    while found := _noise_start.search(text, at):
        start = found.start()
        if text[start] == "#":
            at = start + 1
            while start > begin and text[start - 1] in " \t":
                start -= 1
            token = _directive_start.match(text, start) and _no_break.match(text, start)
        else:
            token = _token.match(text, start)
            at = start + 1
        if token:
            kept += (text[begin:start], _no_break.sub("", token[0]))
            begin = at = token.end()
    kept.append(text[begin:])
    return "".join(kept)


def simple_type(text: str) -> str | None:
    """Rightmost identifier of a type; None for predefined types and tuples."""
    if text.isascii() and text.isidentifier():
        return text if text not in _PREDEFINED else None
    bare = _type_noise.sub("", text)
    if "<" in bare:
        bare = _type_args.sub("", bare)
    name = bare.rpartition(".")[2].rpartition(":")[2]
    return name if _identifier.match(name) and name not in _PREDEFINED else None


def is_interface(name: str) -> bool:
    """``fixed_values.INTERFACE_NAME``."""
    return name[:1] == "I" and len(name) > 1 and unicodedata.category(name[1]) == "Lu"


def _strip(text: str) -> str:
    return text.strip(" \t\r")


def _parts(text: str) -> list[str]:
    """What type commas separate, without empty parts."""
    return [p for p in map(_strip, _type_comma.split(text) if "," in text else (text,)) if p]


def _param_type(text: str) -> str:
    """Type text of one parameter, without attributes, modifiers and default."""
    head = text.partition("=")[0]
    head = _strip(head[_param_attributes.match(head).end() :])
    words = _param_words.match(head)
    if words:
        head = head[words.end() :]
    found = _param.match(head)
    return found[1] if found else ""


class AtMost:
    """Finds the first value at or after a place that is not above a limit, by minima of blocks of blocks."""

    SIZE = 64

    def __init__(self, values: list[int]) -> None:
        self.levels = [values]
        while len(self.levels[-1]) > self.SIZE:
            low = self.levels[-1]
            self.levels.append([min(low[i : i + self.SIZE]) for i in range(0, len(low), self.SIZE)])

    def find(self, start: int, limit: int, level: int = 0) -> int | None:
        """0-based."""
        values = self.levels[level]
        top = level == len(self.levels) - 1
        block = start // self.SIZE + 1
        for i in range(start, len(values) if top else min(block * self.SIZE, len(values))):
            if values[i] <= limit:
                return i
        if top:
            return None
        found = self.find(block, limit, level + 1)
        if found is None:
            return None
        for i in range(found * self.SIZE, min((found + 1) * self.SIZE, len(values))):
            if values[i] <= limit:
                return i
        return None


class _Box:
    """A namespace or type, with the open boxes around it."""

    __slots__ = ("n", "depth", "end", "is_ns", "subkind", "name", "generics", "mods", "bases", "outer", "path")


class _Member:
    __slots__ = ("n", "kind", "names", "mods", "type_text", "generics", "param_types", "end", "outer", "path")

    @property
    def full_path(self) -> str:
        return f"{self.path}.{self.names[0]}"


class _Outer:
    """The boxes around a place, outermost first; shared by all that stands there."""

    __slots__ = ("boxes", "up", "path", "least", "inside")

    def __init__(self, up: _Outer | None = None, box: _Box | None = None) -> None:
        self.up = up
        self.boxes = [*up.boxes, box] if box else []
        self.path = up.within(box.name) if box else ""
        self.least = min(up.least, box.end) if box else NEVER
        # A container below the root level hides its whole subtree in an outline.
        self.inside = bool(box) and (up.inside or (box.is_ns and bool(up.boxes)))

    def within(self, name: str) -> str:
        return f"{self.path}.{name}" if self.boxes else name

    def at(self, n: int) -> _Outer:
        """Without the boxes that ended before line ``n``, which cannot come back."""
        open_ = self
        while open_.boxes and open_.boxes[-1].end < n:
            open_ = open_.up
        if open_.least < n:
            left, open_ = [b for b in open_.boxes if b.end >= n], _Outer()
            for b in left:
                open_ = _Outer(open_, b)
        return open_


def _statement_lines(code: list[str]) -> list[tuple[int, int, bool]]:
    """First and last line of every statement and every group of attributes, and which of both it is."""
    out = []
    n, attribute, depth = 0, False, 0
    for at, line in enumerate(code, 1):
        w = _strip(line)
        if not w:
            continue
        first, last = w[0], w[-1]
        if first in "{}":
            if n and not attribute:
                out.append((n, at - 1, False))
            n, attribute, depth = 0, False, 0
            continue
        closes = last in ";}" or "{" in w
        if attribute:
            depth += w.count("[") - w.count("]")
            if depth > 0:
                continue
            if last == "]":
                out.append((n, at, True))
                n, attribute, depth = 0, False, 0
            elif closes:
                out.append((at, at, False))
                n, attribute, depth = 0, False, 0
            else:
                n, attribute, depth = at, False, 0
            continue
        if not n and first == "[":
            if _attribute_line.match(w):
                out.append((at, at, True))
                continue
            opened = w.count("[") - w.count("]")
            if opened > 0:
                n, attribute, depth = at, True, opened
                continue
        if closes:
            out.append((n or at, at, False))
            n = 0
        elif not n:
            n = at
    if n and not attribute:
        out.append((n, len(code), False))
    return out


class Source:
    """What one content declares, cut once; nodes, imports and hints are worked out as they are asked for."""

    def __init__(self, content: str) -> None:
        self.lines = physical_lines(content) if content else []
        self.code = physical_lines(code_text(content)) if content else []
        self.statements: list[tuple[int, str, bool]] = []
        self.boxes: list[_Box] = []
        self.members: list[_Member] = []

    def structure(self) -> Source:
        """Finds statements, containers and members."""
        code = self.code
        count = len(code)
        depth, self.after = 0, []
        for line in code:
            if "{" in line or "}" in line:
                depth += line.count("{") - line.count("}")
            self.after.append(depth)
        self.low = AtMost(self.after)
        # Per line, the first one at or after it with a brace or a closing semicolon.
        self.opening, at = [None] * count, None
        for i in range(count - 1, -1, -1):
            if "{" in code[i] or code[i].rstrip(" ").endswith(";"):
                at = i
            self.opening[i] = at
        self.statements = [
            (n, code[n - 1] if n == last else " ".join(code[n - 1 : last]), attribute) for n, last, attribute in _statement_lines(code)
        ]
        items = [
            (n, t, self.after[n - 2] if n > 1 else 0, self._head(n, t)) for n, t, attribute in self.statements if not attribute
        ]
        depths = {box.depth + 1 for *_, box in items if box}
        outer = _Outer()
        for n, t, depth, box in items:
            if outer.least < n:
                outer = outer.at(n)
            if box:
                box.outer, box.path = outer, outer.within(box.name)
                self.boxes.append(box)
                outer = _Outer(outer, box)
            elif depth in depths:
                self._member(n, t, depth, outer)
        return self

    def _end(self, n: int, depth: int) -> int:
        """Last line of a declaration, from where it opens."""
        at = self.opening[n - 1]
        if at is None:
            return n
        if "{" not in self.code[at]:
            return at + 1
        closed = self.low.find(at, depth)
        return len(self.code) if closed is None else closed + 1

    def _head(self, n: int, t: str) -> _Box | None:
        if not any(w in t for w in _HEAD_WORDS) or not _head_word.search(t):
            return None
        space, head = _namespace.match(t), _type_head.match(t)
        if not (space or head):
            return None
        box = _Box()
        depth = self.after[n - 2] if n > 1 else 0
        box.n, box.is_ns = n, space is not None
        if space and space[2] == ";":
            box.depth, box.end = OPEN_ENDED, len(self.code)
        else:
            box.depth, box.end = depth, self._end(n, depth)
        if space:
            box.subkind, box.name, box.generics, box.mods, box.bases = "namespace", space[1], "", "", ""
        else:
            word = head[2] if head[2].isalpha() else _space.sub(" ", head[2])
            box.subkind = "record class" if word == "record" else word
            box.name, box.generics, box.mods = head[3], head[4] or "", head[1]
            bases = head[5] or ""
            box.bases = "" if word == "enum" else _strip(_where.sub("", bases) if "where" in bases else bases)
        return box

    def _member(self, n: int, t: str, depth: int, outer: _Outer) -> None:
        if not outer.boxes:
            return
        owner = outer.boxes[-1]
        own_depth = 0 if owner.is_ns and owner.depth < 0 else owner.depth + 1
        if own_depth != depth or owner.subkind == "enum" or not _member_like.search(t) or _not_member.match(t):
            return
        for kind, (needed, pattern) in _members.items():
            found = pattern.match(t) if any(w in t for w in needed) else None
            if found and (kind != "constructor" or found[2] == owner.name):
                break
        else:
            return
        if owner.is_ns and kind != "delegate":
            return
        m = _Member()
        m.n, m.kind, m.outer, m.path, m.mods = n, kind, outer, outer.path, found[1]
        m.type_text = "" if kind == "constructor" else found[2]
        m.generics = found[4] or "" if kind in ("delegate", "method") else ""
        if kind in ("field", "event"):
            # `int a = F(1, 2), b` declares a and b.
            plain = found[3]
            if not _word_only.match(plain):
                plain = _bracketed.sub("", _bracketed.sub("", plain))
            m.names = [w[1] for w in map(_first_word.match, plain.split(",")) if w]
        elif kind == "indexer":
            m.names = ["this[]"]
        else:
            m.names = [found[2] if kind == "constructor" else found[3]]
        params = found[3] if kind == "constructor" else found[5] if kind == "method" else ""
        m.param_types = [_param_type(p) for p in _parts(params)] if params else []
        m.end = self._end(n, depth)
        self.members.append(m)

    # ---- nodes ---------------------------------------------------------------

    def nodes(self, file_id: str | None) -> list[tuple]:
        prefix = "" if file_id is None else f"{file_id}:"
        made = []

        def node(line, end, name, outer, kind, subkind, display, mods, has_children):
            parent = outer.boxes[-1] if outer.boxes else None
            words = mods.split()
            made.append((
                f"{prefix}{line}:{name}",
                f"{prefix}{parent.n}:{parent.name}" if parent else None,
                None if parent is None else "Container" if parent.is_ns else "Declaration",
                kind, subkind, "csharp", name, display, outer.within(name),
                line, len(self.lines[line - 1]) - len(self.lines[line - 1].lstrip(_BLANKS)) + 1, end,
                words, next((w for w in words if w in _VISIBILITY), None), len(outer.boxes), outer.inside, has_children, CONFIDENCE,
            ))

        # A container holds a declaration if the next one stands before its end.
        following = sorted([b.n for b in self.boxes] + [m.n for m in self.members])
        after = dict(zip(following, [*following[1:], NEVER], strict=True)) if following else {}
        for b in self.boxes:
            display = b.name
            if b.generics:
                args = ", ".join(_variance.sub("", _strip(g)) for g in b.generics.strip("<>").split(","))
                display = f"{b.name}<{args}>"
            kind = "Container" if b.is_ns else "Declaration"
            node(b.n, b.end, b.name, b.outer, kind, b.subkind, display, b.mods, after[b.n] <= b.end)
        for m in self.members:
            kind = "Declaration" if m.kind == "delegate" else "Callable" if m.kind in ("method", "constructor") else "Member"
            signature = f"({', '.join(m.param_types)})" if kind == "Callable" else ""
            for name in m.names:
                if m.kind == "delegate":
                    display = name + m.generics
                elif m.kind == "constructor":
                    display = name + signature
                else:
                    display = f"{m.type_text} {name}{m.generics}{signature}"
                node(m.n, m.end, name, m.outer, kind, m.kind, display, m.mods, False)
        made.sort(key=lambda x: x[9])
        return made

    # ---- imports -------------------------------------------------------------

    def imports(self) -> list[tuple]:
        out = []
        for n, t in enumerate(self.code, 1):
            found = _using.match(t) if "using" in t else None
            if found:
                kind = "using-alias" if found[2] else "using-static" if found[1] else "using"
                out.append((kind, _strip(t), found[3], found[2], n))
        return out

    # ---- hints: (source, kind, target, evidence, line) ------------------------

    def hints(self, parts: Iterable[str] | None = None) -> list[tuple]:
        """Hints of the named ``HINT_PARTS``, or of all; those without a target or a source are left out."""
        return [h for part in parts or HINT_PARTS for h in HINT_PARTS[part](self) if h[0] is not None and h[2] is not None]

    def _base(self):
        for b in self.boxes:
            for text in _parts(b.bases):
                called = "(" in text
                target = simple_type(_call.sub("", text) if called else text)
                if target is not None:
                    implements = b.subkind in ("interface", "struct") or is_interface(target)
                    yield b.path, "Implements" if implements else "Inherits", target, _spaced_call.sub("", text) if called else text, b.n

    def _typed(self, member_kind: str, kind: str):
        for m in self.members:
            if m.kind == member_kind:
                yield m.path, kind, simple_type(m.type_text), m.type_text, m.n

    def _callable(self, member_kind: str):
        for m in self.members:
            if m.kind == member_kind:
                if member_kind == "method":
                    yield m.full_path, "ReturnsType", simple_type(m.type_text), m.type_text, m.n
                for text in m.param_types:
                    yield m.full_path, "AcceptsParameterType", simple_type(text), text, m.n

    def _around(self, asked: list[int]) -> list[tuple[str | None, str | None]]:
        """For lines ``asked`` in order: path of the innermost callable, else type, around each, and of the innermost type."""
        if not asked:
            return []
        events = [(b.n, 0, b) for b in self.boxes if b.subkind != "enum"]
        events += [(m.n, 1, m) for m in self.members if m.kind in ("method", "constructor")]
        events += [(n, 2, None) for n in asked]
        events.sort(key=lambda e: e[:2])
        boxes, calls, box_least, call_least, out = [], [], NEVER, NEVER, []
        for n, order, x in events:
            if box_least < n:
                boxes = [b for b in boxes if b.end >= n]
                box_least = min((b.end for b in boxes), default=NEVER)
            if call_least < n:
                calls = [c for c in calls if c.end >= n]
                call_least = min((c.end for c in calls), default=NEVER)
            if order == 0:
                boxes.append(x)
                box_least = min(box_least, x.end)
            elif order == 1:
                calls.append(x)
                call_least = min(call_least, x.end)
            else:
                types = boxes[-1].path if boxes and not boxes[-1].is_ns else None
                out.append((calls[-1].full_path if calls else types, types))
        return out

    def _creations(self):
        found = [(n, _creation.findall(t)) for n, t in enumerate(self.code, 1) if "new " in t]
        found = [x for x in found if x[1]]
        for (n, types), (enclosing, _) in zip(found, self._around([n for n, _ in found]), strict=True):
            for text in types:
                yield enclosing, "CreatesInstanceOf", simple_type(text), text, n

    def _attributes(self):
        lines = [(n, t) for n, t, _ in self.statements if _bracket_first.match(t) and not _file_attribute.match(t)]
        targets = self._attribute_targets([n for n, _ in lines])
        for (n, t), target in zip(lines, targets, strict=True):
            # Leading bracket groups only, without their arguments.
            groups = _groups.match(_round.sub("", _round.sub("", t)) if "(" in t else t)
            for name in _attribute_name.findall(groups[1] if groups else ""):
                simple = name.rpartition(".")[2]
                full = simple if simple.lower().endswith("attribute") else f"{simple}Attribute"
                yield target, "UsesAttributeOrAnnotation", full, name, n

    def _attribute_targets(self, asked: list[int]) -> list[str | None]:
        """The method, constructor or type that attributes belong to, from what stands around and after them."""
        if not asked:
            return []
        events = [(b.n, 1, b, None) for b in self.boxes if not b.is_ns] + [(m.n, 1, None, m) for m in self.members]
        events += [(n, 0, None, None) for n in asked]
        # From the last line to the first; of one line, declarations before the question.
        events.sort(key=lambda e: e[:2], reverse=True)
        box = member = None
        after = []
        for _, declared, b, m in events:
            if declared:
                box, member = b or box, m or member
            else:
                after.append((box, member))
        out = []
        for (box, member), (_, types) in zip(reversed(after), self._around(asked), strict=True):
            target = None
            if box and (member is None or box.n < member.n):
                target = box.path if box.subkind != "enum" else None
            elif member and member.kind in ("method", "constructor"):
                target = member.full_path
            out.append(types if target is None else target)
        return out


HINT_PARTS = {
    "base": Source._base,
    "field": lambda s: s._typed("field", "ContainsFieldOfType"),
    "property": lambda s: s._typed("property", "ContainsPropertyOfType"),
    "method": lambda s: s._callable("method"),
    "constructor": lambda s: s._callable("constructor"),
    "creation": Source._creations,
    "attribute": Source._attributes,
}
