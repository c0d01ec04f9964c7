"""An adaptive radix tree over byte keys whose length is a multiple of a fixed width.

Inner nodes come in four layouts that grow with their children: up to 4 and up to 16 sorted key bytes, an index of
256 bytes into 48 slots, and 256 slots. Paths without a branch are kept in the node below them. A key may be the
beginning of another one, so every node can carry values.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class _Sorted:
    """Up to ``limit`` children by sorted key bytes."""

    __slots__ = ("keys", "nodes")
    limit = 4

    def __init__(self):
        self.keys = bytearray()
        self.nodes: list[Node] = []

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.keys, byte)
        return self.nodes[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, node: Node) -> _Sorted | Layout48:
        """The layout that holds the child: this one, or a larger one when this is full."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.keys) == self.limit:
            return self.grown().put(byte, node)
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def children(self) -> list[Node]:
        return self.nodes


class Layout4(_Sorted):
    __slots__ = ()

    def grown(self) -> Layout16:
        out = Layout16()
        out.keys, out.nodes = self.keys, self.nodes
        return out


class Layout16(_Sorted):
    __slots__ = ()
    limit = 16

    def grown(self) -> Layout48:
        out = Layout48()
        for byte, node in zip(self.keys, self.nodes):
            out.put(byte, node)
        return out


class Layout48:
    """Up to 48 children in slots that an index of 256 bytes points to."""

    __slots__ = ("slot", "nodes")
    none = 255

    def __init__(self):
        self.slot = bytearray([self.none]) * 256
        self.nodes: list[Node] = []

    def get(self, byte: int) -> Node | None:
        at = self.slot[byte]
        return None if at == self.none else self.nodes[at]

    def put(self, byte: int, node: Node) -> Layout48 | Layout256:
        at = self.slot[byte]
        if at != self.none:
            self.nodes[at] = node
            return self
        if len(self.nodes) == 48:
            out = Layout256()
            for b in range(256):
                if self.slot[b] != self.none:
                    out.nodes[b] = self.nodes[self.slot[b]]
            return out.put(byte, node)
        self.slot[byte] = len(self.nodes)
        self.nodes.append(node)
        return self

    def children(self) -> list[Node]:
        return [self.nodes[at] for at in self.slot if at != self.none]


class Layout256:
    """A slot for every byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Layout256:
        self.nodes[byte] = node
        return self

    def children(self) -> list[Node]:
        return [node for node in self.nodes if node is not None]


class Node:
    """The bytes of the path that leads here from the branch above, the layout below, and the values of the key that ends here."""

    __slots__ = ("path", "below", "values")

    def __init__(self, path: bytes):
        self.path = path
        self.below: Layout4 | Layout16 | Layout48 | Layout256 | None = None
        self.values: list = []

    def attach(self, node: Node) -> None:
        self.below = (Layout4() if self.below is None else self.below).put(node.path[0], node)


class RadixTree:
    def __init__(self, width: int):
        self.width = width
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        """Adds ``value`` to those of ``key``."""
        if len(key) % self.width:
            raise ValueError("the key is no multiple of the width")
        node, at = self.root, 0
        while at < len(key):
            child = node.below.get(key[at]) if node.below is not None else None
            if child is None:
                leaf = Node(key[at:])
                leaf.values.append(value)
                node.attach(leaf)
                return
            path = child.path
            if key.startswith(path, at):
                node, at = child, at + len(path)
                continue
            rest = key[at : at + len(path)]
            same = next((i for i, (a, b) in enumerate(zip(path, rest)) if a != b), len(rest))
            fork = Node(path[:same])
            child.path = path[same:]
            fork.attach(child)
            node.attach(fork)
            node, at = fork, at + same
        node.values.append(value)

    def aligned(self) -> Iterator[tuple[int, int, bytes, list]]:
        """(parent, depth, last id, values) of every prefix of whole ids, parents before children and in the order of the keys.

        ``parent`` is the place of the parent in this sequence, -1 for the empty prefix, whose last id is empty.
        Branches inside an id give nothing; a path over several ids gives one entry for each.
        """
        yield -1, 0, b"", self.root.values
        count = 1
        stack = [(child, 0, 0, b"") for child in reversed(self.root.below.children())] if self.root.below is not None else []
        while stack:
            node, parent, depth, begun = stack.pop()
            run = begun + node.path
            whole = len(run) // self.width
            for k in range(whole):
                ends = (k + 1) * self.width == len(run)
                depth += 1
                yield parent, depth, run[k * self.width : (k + 1) * self.width], node.values if ends else []
                parent = count
                count += 1
            begun = run[whole * self.width :]
            if node.below is not None:
                stack.extend((child, parent, depth, begun) for child in reversed(node.below.children()))
