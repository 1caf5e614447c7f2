"""One Python content as plain values: declarations, imports and base-class hints.

Runs in a Python worker, one content at a time; see ``functions.parsing``.
"""

from __future__ import annotations

from collections.abc import Iterable

from codelake import fixed_values as fv
from codelake.operators.cs_syntax import NEVER, AtMost, is_interface, java

# Java's ``\s`` with Unicode character classes.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_text = java(rf"[^{_SPACE}]")
_comment = java(rf"^[{_SPACE}]*#")
_head, _class, _def = java(r"^[ \t]*(?:class|def|async)\s"), java(fv.PY_CLASS), java(fv.PY_DEF)
_import_line, _import, _from = java(r"^[ \t]*(?:import|from)\s"), java(fv.PY_IMPORT), java(fv.PY_FROM_IMPORT)


def _indent(line: str) -> int:
    """A tab counts four."""
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return len(lead) + 3 * lead.count("\t")


def _strip(text: str) -> str:
    return text.strip(" \t\r")


class _Declaration:
    __slots__ = ("n", "is_class", "name", "bases", "is_async", "params", "returns", "scope_end", "block_end", "outer", "path", "has_children")


class Source:
    """What one content declares; nodes, imports and hints are worked out as they are asked for."""

    def __init__(self, content: str) -> None:
        self.lines = content.split("\n")
        self.declared: list[_Declaration] = []

    def structure(self) -> Source:
        """Finds declarations with where they end and what they stand in."""
        heads = [(n, t) for n, t in enumerate(self.lines, 1) if ("class" in t or "def" in t) and _head.match(t) and (_class.match(t) or _def.match(t))]
        if not heads:
            return self
        block, scope = [], []
        for t in self.lines:
            first = t.lstrip(" \t")[:1]
            plain = "!" <= first <= "~"
            indent = _indent(t) if plain or _text.search(t) else NEVER
            block.append(indent)
            scope.append(NEVER if first == "#" or not plain and _comment.match(t) else indent)
        blocks, scopes = AtMost(block), AtMost(scope)
        open_: tuple[_Declaration, ...] = ()
        for n, t in heads:
            d = _Declaration()
            head = _class.match(t)
            d.n, d.is_class, d.has_children = n, head is not None, False
            if head:
                d.name, d.bases, d.is_async, d.params, d.returns = head[2], (head[3] or "").strip(" "), False, "", ""
            else:
                head = _def.match(t)
                d.name, d.bases, d.is_async = head[3], "", bool(head[2])
                d.params, d.returns = _strip(head[4]), _strip(head[5] or "")
            indent = _indent(t)
            # Last line still inside the scope of this declaration, and of its block.
            ends = (found.find(n, indent) for found in (scopes, blocks))
            d.scope_end, d.block_end = (len(self.lines) if end is None else end for end in ends)
            # What ended before a line cannot come back.
            if any(o.scope_end < n for o in open_):
                open_ = tuple(o for o in open_ if o.scope_end >= n)
            d.outer, d.path = open_, ".".join([*(o.name for o in open_), d.name])
            # Declarations stand in line order, so a first child follows its parent at once.
            if self.declared and open_ and open_[-1] is self.declared[-1]:
                open_[-1].has_children = True
            self.declared.append(d)
            open_ = (*open_, d)
        return self

    def nodes(self, file_id: str | None) -> list[tuple]:
        prefix = "" if file_id is None else f"{file_id}:"
        out = []
        for d in self.declared:
            parent = d.outer[-1] if d.outer else None
            returns = f" -> {d.returns}" if d.returns else ""
            out.append((
                f"{prefix}{d.n}:{d.name}",
                f"{prefix}{parent.n}:{parent.name}" if parent else None,
                None if parent is None else "Declaration" if parent.is_class else "Callable",
                "Declaration" if d.is_class else "Callable",
                "class" if d.is_class else "method" if parent else "function",
                "python", d.name,
                d.name if d.is_class else f"{'async ' if d.is_async else ''}{d.name}({d.params}){returns}",
                d.path, d.n, None, d.block_end,
                ["async"] if d.is_async else [], None, len(d.outer), False, d.has_children, 0.75 if d.is_class else 0.8,
            ))
        return out

    def imports(self) -> list[tuple]:
        out = []
        for n, t in enumerate(self.lines, 1):
            if "import" not in t or not _import_line.match(t):
                continue
            if found := _import.match(t):
                out.append(("import", _strip(t), found[1], found[2], n))
            elif found := _from.match(t):
                module = found[1] or ""
                kind = "relative-import" if module.startswith(".") else "from-import"
                out.append((kind, _strip(t), module.lstrip("."), _strip(found[2]), n))
        return out

    def hints(self, parts: Iterable[str] | None = None) -> list[tuple]:
        """Bases of classes, the one kind of hints there is."""
        out = []
        for d in self.declared:
            for base in map(_strip, d.bases.split(",")) if d.bases else ():
                simple = _strip(base.partition("[")[0])
                if simple:
                    out.append((d.path, "Implements" if is_interface(simple) else "Inherits", simple, base, d.n))
        return out
