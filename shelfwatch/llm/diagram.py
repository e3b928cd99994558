"""Count-weighted decision diagrams whose levels are reordered by swaps of neighbours."""

from collections.abc import Iterable, Iterator


class Node:
    """Weights below, and the children for what passes and what fails; a leaf has none."""

    __slots__ = ("total", "passing", "failing")

    def __init__(self, total: tuple[int, ...], passing: "Node | None" = None, failing: "Node | None" = None):
        self.total, self.passing, self.failing = total, passing, failing


class Diagram:
    """Weights of masks, one level for each letter of ``order``; bit i of a mask is letter i.

    No level is left out, and equal sub-diagrams are one node, also across swaps.
    """

    def __init__(self, order: str, counts: dict[int, tuple[int, ...]], width: int):
        self.order = order
        self._leaves: dict[tuple[int, ...], Node] = {}
        self._nodes: dict[tuple[int, int], Node] = {}
        none = (0,) * width

        def built(level: int, mask: int) -> Node:
            if level == len(order):
                return self._leaf(counts.get(mask, none))
            return self._node(built(level + 1, mask), built(level + 1, mask | 1 << level))

        self._root = built(0, 0)

    def _leaf(self, total: tuple[int, ...]) -> Node:
        return self._leaves.setdefault(total, Node(total))

    def _node(self, passing: Node, failing: Node) -> Node:
        key = (id(passing), id(failing))  # nodes live as long as the diagram
        if key not in self._nodes:
            total = tuple(a + b for a, b in zip(passing.total, failing.total))
            self._nodes[key] = Node(total, passing, failing)
        return self._nodes[key]

    def swap(self, level: int) -> None:
        """Exchange a level with the next one."""
        done: dict[int, Node] = {}

        def swapped(node: Node, depth: int) -> Node:
            if id(node) not in done:
                a, b = node.passing, node.failing
                if depth < level:
                    done[id(node)] = self._node(swapped(a, depth + 1), swapped(b, depth + 1))
                else:
                    done[id(node)] = self._node(self._node(a.passing, b.passing), self._node(a.failing, b.failing))
            return done[id(node)]

        self._root = swapped(self._root, 0)
        o = self.order
        self.order = o[:level] + o[level + 1] + o[level] + o[level + 2 :]

    def path(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(letter, weights kept, weights removed) down the path of what passes everything."""
        node = self._root
        for letter in self.order:
            yield letter, node.passing.total, node.failing.total
            node = node.passing


def swaps_through_all_orders(n: int) -> Iterable[int]:
    """Levels to swap, one after another, so that each order of ``n`` levels comes up exactly once.

    The last element wanders through every order of the others, to and fro.
    """
    if n < 2:
        return
    down = True
    for inner in [*swaps_through_all_orders(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            # the wanderer stands at the front (after going down) or at the end
            yield inner + 1 if down else inner
        down = not down
