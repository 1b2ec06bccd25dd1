"""Scope analysis of a module in one walk: a tree of scopes with an index of definitions and uses.

Every statement is visited once.  Its names are noted as uses in the scope where it stands; when a
scope ends, uses of names that it binds go to their variables and the rest go to the scope
outside (past classes, as Python does).  So the work is linear in the source, whatever the number of
variables is.

Rules:

* Variables are bound by assignments, annotations, ``for`` targets, ``with .. as`` and ``:=``, wherever they stand
  (under ``if``, ``try``, ``with``, loops and ``match`` as well); ``self.x`` in a method is an attribute of the class,
  where ``self`` is the method's first parameter; ``global`` and ``nonlocal`` names are those of the scope that they name.
* Names bound by ``except``, ``import``, ``del``, patterns, comprehensions and lambdas are no slots.
* Parameters are all but ``*args`` and ``**kwargs`` and, in classes, ``self``.
* A function has a return slot if a ``return`` with a value is its own, not that of a function inside.
* Each definition of a name that is defined again (overloads, property setters, branches) keeps its own slots:
  ``at`` is the line of the definition, ``owner`` that of the class which holds it, ``place`` counts the
  slots of the file.
* Occurrences are the statements, or heads of compound statements, that use the variable, as its names and then its attributes.
"""

from __future__ import annotations

import ast
from typing import NamedTuple

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def text_of(node: ast.AST) -> str:
    """``ast.unparse``, which takes long to start, without it for plain and dotted names."""
    parts, at = [], node
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    return ".".join([at.id, *reversed(parts)]) if isinstance(at, ast.Name) else ast.unparse(node)


def walked(node: ast.AST) -> list[ast.AST]:
    """The nodes of ``ast.walk`` in its order, without contexts and operators, in about half of its time."""
    found = [node]
    for n in found:
        if isinstance(n, (ast.Name, ast.Constant)):
            continue
        for field in n._fields:
            value = getattr(n, field, None)
            if isinstance(value, list):
                found += [v for v in value if isinstance(v, ast.AST)]
            elif isinstance(value, ast.AST) and field not in ("ctx", "op"):
                found.append(value)
    return found


class Slot(NamedTuple):
    scope: str
    level: str
    kind: str
    name: str
    annotation: str
    occurrences: list
    line: int
    at: int
    owner: int
    place: int


class Definition(NamedTuple):
    """A function or class: where its document entry begins and ends."""

    scope: str
    level: str
    name: str
    at: int
    end: int
    owner: int
    docstring: str | None


class _Variable:
    __slots__ = ("annotation", "level", "line", "name", "node", "place", "scope", "uses")

    def __init__(self, scope: _Scope, name: str, annotation: str, node: ast.AST, place: int):
        self.scope, self.level, self.name, self.annotation, self.node, self.line, self.place = scope, scope.level, name, annotation, node, node.lineno, place
        self.uses: list[tuple[int, str]] = []


class _Scope:
    def __init__(self, level: str, name: str, line: int, owner: int, parent: _Scope | None, receiver: str | None = None):
        self.level, self.name, self.line, self.owner, self.parent, self.receiver = level, name, line, owner, parent, receiver
        self.bound: dict[str, _Variable] = {}
        self.hidden: set[str] = set()  # parameters without a slot
        self.elsewhere: dict[str, _Scope] = {}  # global and nonlocal names
        self.uses: dict[str, list[tuple[int, str]]] = {}
        self.returns: list[str] = []

    def outside(self) -> _Scope | None:
        """The next scope whose names are seen from a scope inside of this one."""
        at = self.parent
        while at is not None and at.level == "class":
            at = at.parent
        return at


class Analysis:
    """``slots``, ``definitions`` and ``imports`` of a source; ``positions`` has the syntax node of each slot, by place."""

    def __init__(self, source: str):
        self.slots: list[Slot] = []
        self.definitions: list[Definition] = []
        self.imports: list[str] = []
        self.positions: dict[int, tuple[str, ast.AST]] = {}
        self._place, self._statement = 0, 0
        self._finished: list[tuple[int, Slot]] = []
        self._module = _Scope("module", "", 0, 0, None)
        self._body(ast.parse(source).body, self._module)
        self._close(self._module)
        self.slots = [slot for _, slot in sorted(self._finished, key=lambda x: x[0])]
        self.imports = list(dict.fromkeys(self.imports))

    def _next(self) -> int:
        self._place += 1
        return self._place - 1

    # -- binding

    def _bind(self, scope: _Scope, name: str, node: ast.AST, annotation: str = "") -> None:
        scope = scope.elsewhere.get(name, scope)
        if name in scope.hidden:
            return
        found = scope.bound.get(name)
        if found is None:
            scope.bound[name] = _Variable(scope, name, annotation, node, self._next())
        elif annotation and not found.annotation and not isinstance(found.node, ast.arg):
            found.annotation, found.node = annotation, node

    def _class_of(self, scope: _Scope, receiver: str) -> _Scope | None:
        """The class whose instance the name is in this scope."""
        at = scope
        while at is not None and at.level == "function":
            if at.receiver == receiver:
                return at.parent
            if receiver in at.bound or receiver in at.hidden:
                return None
            at = at.parent
        return None

    def _target(self, scope: _Scope, target: ast.AST, node: ast.AST, annotation: str = "") -> None:
        if isinstance(target, ast.Name):
            self._bind(scope, target.id, node if annotation or isinstance(node, (ast.Assign, ast.AnnAssign)) else target, annotation)
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self._target(scope, t, t)
        elif isinstance(target, ast.Starred):
            self._target(scope, target.value, target.value)
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and (owner := self._class_of(scope, target.value.id)) is not None:
            self._bind(owner, target.attr, node, annotation)

    # -- uses

    def _use(self, scope: _Scope, *parts: ast.AST | None) -> None:
        """Notes the names of a statement, or of the head of one, and binds what ``:=`` binds in it."""
        names, attributes, own, hidden = [], [], [], set()
        for part in parts:
            for n in walked(part) if part is not None else ():
                if isinstance(n, ast.Name):
                    names.append(n.id)
                elif isinstance(n, ast.Attribute):
                    attributes.append(n.attr)
                    if isinstance(n.value, ast.Name):
                        own.append((n.value.id, n.attr))
                elif isinstance(n, ast.NamedExpr):
                    self._bind(scope, n.target.id, n.target)
                elif isinstance(n, ast.comprehension):
                    hidden |= {t.id for t in ast.walk(n.target) if isinstance(t, ast.Name)}
                elif isinstance(n, ast.Lambda):
                    hidden |= {a.arg for a in ast.walk(n.args) if isinstance(a, ast.arg)}
        if not names and not attributes:
            return
        self._statement += 1
        text = " ".join(names + attributes)
        for name in dict.fromkeys(names):
            if name not in hidden:
                to = scope.elsewhere.get(name, scope)
                to.uses.setdefault(name, []).append((self._statement, text))
        for receiver, name in dict.fromkeys(own):
            if (owner := self._class_of(scope, receiver)) is not None:
                owner.uses.setdefault(name, []).append((self._statement, text))

    def _close(self, scope: _Scope) -> None:
        """Gives the uses to the scope's variables, or to the scope outside."""
        outside = scope.outside()
        for name, uses in scope.uses.items():
            if name in scope.bound:
                scope.bound[name].uses += uses
            elif outside is not None and name not in scope.hidden:
                outside.uses.setdefault(name, []).extend(uses)
        for v in scope.bound.values():
            texts = [text for _, text in sorted(dict(v.uses).items())]
            kind = "Parameter" if isinstance(v.node, ast.arg) else "Variable"
            self._add(Slot(scope.name, scope.level, kind, v.name, v.annotation, texts, v.line, scope.line, scope.owner, v.place), v.node)

    def _add(self, slot: Slot, node: ast.AST) -> None:
        self._finished.append((slot.place, slot))
        self.positions[slot.place] = (slot.kind, node)

    # -- statements

    def _body(self, body: list[ast.stmt], scope: _Scope) -> None:
        for node in body:
            self._visit(node, scope)

    def _visit(self, node: ast.stmt, scope: _Scope) -> None:
        if isinstance(node, FUNCTIONS):
            self._function(node, scope)
        elif isinstance(node, ast.ClassDef):
            self._class(node, scope)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            self.imports += [n for a in node.names for n in (a.name, a.asname) if n and n != "*"]
        elif isinstance(node, ast.Global):
            scope.elsewhere |= dict.fromkeys(node.names, self._module)
        elif isinstance(node, ast.Nonlocal):
            for name in node.names:
                at = scope.outside()
                while at is not None and name not in at.bound and at.level != "module":
                    at = at.outside()
                scope.elsewhere[name] = at or self._module
        elif isinstance(node, (ast.If, ast.While)):
            self._use(scope, node.test)
            self._body(node.body, scope), self._body(node.orelse, scope)
        elif isinstance(node, (ast.For, ast.AsyncFor)):
            self._target(scope, node.target, node.target)
            self._use(scope, node.iter)
            self._body(node.body, scope), self._body(node.orelse, scope)
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                if item.optional_vars is not None:
                    self._target(scope, item.optional_vars, item.optional_vars)
            self._use(scope, *(i.context_expr for i in node.items))
            self._body(node.body, scope)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            self._body(node.body, scope)
            for handler in node.handlers:
                self._use(scope, handler.type)
                self._body(handler.body, scope)
            self._body(node.orelse, scope), self._body(node.finalbody, scope)
        elif isinstance(node, ast.Match):
            self._use(scope, node.subject)
            for case in node.cases:
                self._use(scope, case.guard)
                self._body(case.body, scope)
        else:
            if isinstance(node, ast.Assign):
                for target in node.targets:
                    self._target(scope, target, node if len(node.targets) == 1 else target)
            elif isinstance(node, ast.AnnAssign):
                self._target(scope, node.target, node, text_of(node.annotation))
            elif isinstance(node, ast.Return) and node.value is not None and scope.level == "function":
                scope.returns.append(text_of(node.value))
            self._use(scope, node)

    def _function(self, node, scope: _Scope) -> None:
        arguments = node.args
        self._use(scope, *node.decorator_list, *arguments.defaults, *arguments.kw_defaults)
        in_class = scope.level == "class"
        name = f"{scope.name}.{node.name}" if scope.name else node.name
        every = [*arguments.posonlyargs, *arguments.args]
        static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in node.decorator_list)
        receiver = every[0].arg if in_class and every and not static else None
        inner = _Scope("function", name, node.lineno, scope.line if in_class else scope.owner, scope, receiver)
        self.definitions.append(Definition(name, "function", node.name, node.lineno, node.end_lineno, inner.owner, ast.get_docstring(node)))
        inner.hidden = {a.arg for a in (arguments.vararg, arguments.kwarg) if a is not None}
        for a in (*every, *arguments.kwonlyargs):
            if in_class and a.arg == "self":
                inner.hidden.add(a.arg)
            else:
                self._bind(inner, a.arg, a, text_of(a.annotation) if a.annotation else "")
        place = self._next()
        self._body(node.body, inner)
        if inner.returns:
            self._add(Slot(name, "function", "Return", node.name, text_of(node.returns) if node.returns else "", [f"return {r}" for r in inner.returns], node.lineno, node.lineno, inner.owner, place), node)
        self._close(inner)

    def _class(self, node: ast.ClassDef, scope: _Scope) -> None:
        self._use(scope, *node.decorator_list, *node.bases, *node.keywords)
        name = f"{scope.name}.{node.name}" if scope.name else node.name
        inner = _Scope("class", name, node.lineno, node.lineno, scope)
        self.definitions.append(Definition(name, "class", node.name, node.lineno, node.end_lineno, scope.owner if scope.level == "function" else scope.line, ast.get_docstring(node)))
        self._body(node.body, inner)
        self._close(inner)


def imported_names(source: str) -> list[str]:
    """The names that a module imports, and their aliases, in their order; none if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = [n for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))]
    found.sort(key=lambda n: (n.lineno, n.col_offset))
    return list(dict.fromkeys(x for n in found for a in n.names for x in (a.name, a.asname) if x and x != "*"))
