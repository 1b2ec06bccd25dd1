"""Modules written by hand, each with its slots as a reader would list them: what ``scope_slots`` is checked with.

``NAME`` stands for an identifier that the query takes from its table.  A slot is
scope|kind|name|annotation|line|line of the definition|line of its class.
"""

from __future__ import annotations

# Sources and the slots that are in them.
MODULES: tuple[tuple[str, str], ...] = (
    ("import os\nNAME: int = 3\n", "|Variable|NAME|int|2|0|0"),
    ("if True:\n    def NAME(a: int):\n        return a\nelse:\n    def NAME(b):\n        return b\n", "NAME|Parameter|a|int|2|2|0\nNAME|Return|NAME||2|2|0\nNAME|Parameter|b||5|5|0\nNAME|Return|NAME||5|5|0"),
    ("try:\n    import json\n    NAME = json\nexcept ImportError:\n    NAME = None\nfinally:\n    done = 1\n", "|Variable|NAME||3|0|0\n|Variable|done||7|0|0"),
    ("with open('x') as NAME, lock() as (p, *q):\n    size = len(NAME)\n", "|Variable|NAME||1|0|0\n|Variable|p||1|0|0\n|Variable|q||1|0|0\n|Variable|size||2|0|0"),
    ("for i, NAME in pairs:\n    total = NAME\nelse:\n    left = 1\n", "|Variable|i||1|0|0\n|Variable|NAME||1|0|0\n|Variable|total||2|0|0\n|Variable|left||4|0|0"),
    ("while (NAME := read()) > 0:\n    last = NAME\n", "|Variable|NAME||1|0|0\n|Variable|last||2|0|0"),
    ("def outer(a):\n    def NAME(b):\n        return b\n    x = NAME(a)\n", "outer|Parameter|a||1|1|0\nouter.NAME|Parameter|b||2|2|0\nouter.NAME|Return|NAME||2|2|0\nouter|Variable|x||4|1|0"),
    ("class NAME:\n    kind: str = 'x'\n    def __init__(self, size: int):\n        self.size: int = size\n        self.rest = []\n", "NAME|Variable|kind|str|2|1|1\nNAME.__init__|Parameter|size|int|3|3|1\nNAME|Variable|size|int|4|1|1\nNAME|Variable|rest||5|1|1"),
    ("class A:\n    @property\n    def NAME(self) -> int:\n        return self._v\n    @NAME.setter\n    def NAME(self, value):\n        self._v = value\n", "A.NAME|Return|NAME|int|3|3|1\nA.NAME|Parameter|value||6|6|1\nA|Variable|_v||7|1|1"),
    ("from typing import overload\n@overload\ndef NAME(a: int) -> int: ...\n@overload\ndef NAME(a: str) -> str: ...\ndef NAME(a):\n    return a\n", "NAME|Parameter|a|int|3|3|0\nNAME|Parameter|a|str|5|5|0\nNAME|Parameter|a||6|6|0\nNAME|Return|NAME||6|6|0"),
    ("class Outer:\n    class Inner:\n        NAME = 1\n        def get(self):\n            return self.NAME\n", "Outer.Inner|Variable|NAME||3|2|2\nOuter.Inner.get|Return|get||4|4|2"),
    ("async def NAME(a, *, key: bool = False, **more):\n    async with a as b:\n        async for c in b:\n            return c\n", "NAME|Parameter|a||1|1|0\nNAME|Parameter|key|bool|1|1|0\nNAME|Return|NAME||1|1|0\nNAME|Variable|b||2|1|0\nNAME|Variable|c||3|1|0"),
    ("def NAME(a, /, b, *rest):\n    return [x for x in rest if x]\n", "NAME|Parameter|a||1|1|0\nNAME|Parameter|b||1|1|0\nNAME|Return|NAME||1|1|0"),
    ("NAME = count = 0\nx, (y, *z) = read()\nd['k'] = 1\nd.attr = 2\n", "|Variable|NAME||1|0|0\n|Variable|count||1|0|0\n|Variable|x||2|0|0\n|Variable|y||2|0|0\n|Variable|z||2|0|0"),
    ("NAME = 0\ndef bump():\n    global NAME, other\n    NAME = NAME + 1\n    other = 2\n", "|Variable|NAME||1|0|0\n|Variable|other||5|0|0"),
    ("def outer():\n    NAME = 0\n    def bump():\n        nonlocal NAME\n        NAME = 1\n        return NAME\n    return bump\n", "outer|Return|outer||1|1|0\nouter|Variable|NAME||2|1|0\nouter.bump|Return|bump||3|3|0"),
    ("class A:\n    @staticmethod\n    def NAME(first):\n        first.x = 1\n    @classmethod\n    def make(cls):\n        cls.made = True\n        return cls\n", "A.NAME|Parameter|first||3|3|1\nA.make|Parameter|cls||6|6|1\nA.make|Return|make||6|6|1\nA|Variable|made||7|1|1"),
    ("def NAME(a):\n    yield a\n    return\n", "NAME|Parameter|a||1|1|0"),
    ("NAME = lambda a: a + 1\nsquares = {k: v for k, v in NAME}\n", "|Variable|NAME||1|0|0\n|Variable|squares||2|0|0"),
    ("match read():\n    case [NAME, *_]:\n        found = NAME\n    case _:\n        def late():\n            return 1\n", "|Variable|found||3|0|0\nlate|Return|late||5|5|0"),
    ("def NAME(\n    a: 'int',\n    b: dict[str,\n            int] = None,\n) -> (\n    list\n):\n    return [a]\n", "NAME|Parameter|a|'int'|2|1|0\nNAME|Parameter|b|dict[str, int]|3|1|0\nNAME|Return|NAME|list|1|1|0"),
    ("NAME: int\nNAME = 4\nlater = 1\nlater: str = 'x'\n", "|Variable|NAME|int|1|0|0\n|Variable|later|str|3|0|0"),
    ("try:\n    a = 1\nexcept* (ValueError, OSError) as NAME:\n    b = NAME\nelse:\n    c = 2\n", "|Variable|a||2|0|0\n|Variable|b||4|0|0\n|Variable|c||6|0|0"),
    ("class A(Base, key=1):\n    def NAME(self):\n        def inner():\n            self.deep = 1\n            return self.deep\n        return inner\n", "A.NAME|Return|NAME||2|2|1\nA.NAME.inner|Return|inner||3|3|1\nA|Variable|deep||4|1|1"),
    ("def NAME():\n    class Local:\n        v = 1\n        def get(self, a):\n            return a\n    return Local\n", "NAME|Return|NAME||1|1|0\nNAME.Local|Variable|v||3|2|2\nNAME.Local.get|Parameter|a||4|4|2\nNAME.Local.get|Return|get||4|4|2"),
    ("if (n := 3) and (NAME := 4):\n    pass\nelif n:\n    m = [(last := x) for x in range(n)]\n", "|Variable|n||1|0|0\n|Variable|NAME||1|0|0\n|Variable|m||4|0|0\n|Variable|last||4|0|0"),
    ("# nothing but a comment about NAME\n", ""),
    ("'''from here we import nothing'''\nfrom shop import (\n    Basket,\n    Item as Thing,\n)\nNAME = Basket()\n", "|Variable|NAME||6|0|0"),
    ("class A:\n    def NAME(this, self):\n        this.a = self\n        (this.b, c) = 1, 2\n        this = None\n        this.d = 3\n", "A.NAME|Parameter|this||2|2|1\nA|Variable|a||3|1|1\nA|Variable|b||4|1|1\nA.NAME|Variable|c||4|2|1\nA|Variable|d||6|1|1"),
    ("def dec(f):\n    return f\n\n@dec\n@dec\ndef NAME(a=1):\n    if a:\n        return a\n    with a: return None\n", "dec|Parameter|f||1|1|0\ndec|Return|dec||1|1|0\nNAME|Parameter|a||6|6|0\nNAME|Return|NAME||6|6|0"),
    ("NAME = 1; other = 2\nif other: third = 3\ndel other\nassert NAME\nNAME += 1\n", "|Variable|NAME||1|0|0\n|Variable|other||1|0|0\n|Variable|third||2|0|0"),
    ("def NAME[T](a: T, b: 'ö' = 'ä') -> T:\n    ö = a\n    return ö\n", "NAME|Parameter|a|T|1|1|0\nNAME|Parameter|b|'ö'|1|1|0\nNAME|Return|NAME|T|1|1|0\nNAME|Variable|ö||2|1|0"),
)


def slot_rows() -> list[tuple]:
    """(module, scope, kind, name, annotation, line, at, owner) of all modules."""
    out = []
    for number, (_, slots) in enumerate(MODULES):
        for slot in filter(None, slots.split("\n")):
            scope, kind, name, annotation, *lines = slot.split("|")
            out.append((number, scope, kind, name, annotation, *map(int, lines)))
    return out
