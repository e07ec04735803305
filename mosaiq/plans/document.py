"""The document: a small tree on the driver over lazy pixel relations, with a history of versions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from .relation import EMPTY, Rel


class ScriptError(ValueError):
    """The script is not valid, or an op cannot be applied."""


@dataclass(frozen=True)
class Mask:
    rel: Rel
    enabled: bool = True
    outside: int = 0


@dataclass(frozen=True)
class Node:
    id: str
    kind: str  # raster, adjustment or group
    name: str = ""
    visible: bool = True
    opacity: float = 1.0
    fill: float = 1.0
    mode: str = "norm"
    seed: int = 0
    clip: bool = False
    clbl: bool = True
    lock: bool = False
    mask: Mask | None = None
    pixels: Rel = EMPTY
    adjustment: str = ""
    params: dict[str, Any] = field(default_factory=dict)
    children: tuple[Node, ...] = ()
    passes: bool = True  # groups: pass-through

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            yield c
            yield from c.walk()


@dataclass(frozen=True)
class State:
    w: int
    h: int
    bg: int
    root: Node
    selection: Rel = EMPTY
    active: bool = False
    saved: Rel = EMPTY

    def find(self, node_id: str) -> Node | None:
        return next((n for n in self.root.walk() if n.id == node_id), None)

    def require(self, node_id: str, *kinds: str) -> Node:
        node = self.find(node_id)
        if node is None:
            raise ScriptError(f"no layer {node_id!r}")
        if kinds and node.kind not in kinds:
            raise ScriptError(f"{node_id!r} is a {node.kind}")
        return node

    def parent_of(self, node_id: str) -> tuple[Node, int]:
        for p in (self.root, *self.root.walk()):
            for i, c in enumerate(p.children):
                if c.id == node_id:
                    return p, i
        raise ScriptError(f"no layer {node_id!r}")

    def container(self, node_id: str) -> Node:
        return self.root if node_id == "root" else self.require(node_id, "group")

    def put(self, node: Node) -> State:
        """The state with the node of that id replaced."""

        def rebuilt(n: Node) -> Node:
            if n.id == node.id and n is not self.root:
                return node
            return replace(n, children=tuple(map(rebuilt, n.children))) if n.children else n

        if node.id == "root":
            return replace(self, root=node)
        return replace(self, root=rebuilt(self.root))

    def change(self, node_id: str, **changes: Any) -> State:
        return self.put(replace(self.require(node_id), **changes))

    def insert(self, parent: str, index: int | None, *nodes: Node) -> State:
        p = self.container(parent)
        at = len(p.children) if index is None else index
        return self.put(replace(p, children=p.children[:at] + nodes + p.children[at:]))

    def remove(self, node_id: str) -> State:
        p, i = self.parent_of(node_id)
        return self.put(replace(p, children=p.children[:i] + p.children[i + 1 :]))

    def check_new(self, node_id: str) -> str:
        if not node_id or node_id == "root" or self.find(node_id):
            raise ScriptError(f"id {node_id!r} is empty or taken")
        return node_id


def empty_root() -> Node:
    return Node("root", "group")


class Document:
    """The present state, and the states before each op (the newest `depth` of them). States share their relations'
    lineage, so a version costs nothing."""

    def __init__(self, w: int, h: int, bg: int = 0, depth: int = 50) -> None:
        self.state = State(w, h, bg, empty_root())
        self.depth = depth
        self.past: list[State] = []
        self.future: list[State] = []
        self.tool: dict[str, Any] = {}

    def push(self) -> None:
        self.past = [*self.past, self.state][-self.depth :]
        self.future = []

    def undo(self, steps: int = 1) -> None:
        if steps > len(self.past):
            raise ScriptError(f"only {len(self.past)} steps to undo")
        for _ in range(steps):
            self.future.append(self.state)
            self.state = self.past.pop()

    def redo(self, steps: int = 1) -> None:
        if steps > len(self.future):
            raise ScriptError(f"only {len(self.future)} steps to redo")
        for _ in range(steps):
            self.past.append(self.state)
            self.state = self.future.pop()
