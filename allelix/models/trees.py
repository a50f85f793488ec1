"""Trees of taxa: BIONJ from distances and variances, and maximum likelihood with nearest-neighbour interchanges."""

from __future__ import annotations

import numpy as np

#: Rows of an alignment: base number, or 4 for anything that is not A, C, G or T.
BASES = {"A": 0, "C": 1, "G": 2, "T": 3}


class Node:
    """A node of an unrooted tree, held from one of its inner nodes."""

    def __init__(self, name: str | None = None, children: list["Node"] | None = None, length: float = 0.1):
        self.name, self.children, self.length = name, children or [], length

    def newick(self) -> str:
        inner = f"({','.join(c.newick() for c in self.children)})" if self.children else self.name
        return f"{inner}:{self.length:.6f}"

    def walk(self):
        for c in self.children:
            yield from c.walk()
        yield self


def bionj(d: np.ndarray, names: list[str]) -> Node:
    """BIONJ: neighbour joining whose reduced distances have the least variance."""
    d, v = d.astype(float).copy(), d.astype(float).copy()
    nodes = [Node(n) for n in names]
    while len(nodes) > 3:
        n, r = len(nodes), d.sum(1)
        q = (n - 2) * d - r[:, None] - r[None]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(q.argmin()), n))
        a = 0.5 * (d[i, j] + (r[i] - r[j]) / (n - 2))
        b = d[i, j] - a
        rest = [k for k in range(n) if k not in (i, j)]
        lam = 0.5 if v[i, j] <= 0 else 0.5 + (v[j, rest] - v[i, rest]).sum() / (2 * (n - 2) * v[i, j])
        lam = min(max(lam, 0.0), 1.0)
        nodes[i].length, nodes[j].length = max(a, 0.0), max(b, 0.0)
        row_d = lam * (d[i] - a) + (1 - lam) * (d[j] - b)
        row_v = lam * v[i] + (1 - lam) * v[j] - lam * (1 - lam) * v[i, j]
        joined = Node(children=[nodes[i], nodes[j]])
        d[i], d[:, i], v[i], v[:, i] = row_d, row_d, row_v, row_v
        d[i, i] = v[i, i] = 0
        d, v = (np.delete(np.delete(m, j, 0), j, 1) for m in (d, v))
        nodes[i] = joined
        del nodes[j]
    if len(nodes) == 3:
        for k in range(3):
            x, y = [m for m in range(3) if m != k]
            nodes[k].length = max(0.0, 0.5 * (d[k, x] + d[k, y] - d[x, y]))
    elif len(nodes) == 2:
        nodes[0].length, nodes[1].length = max(0.0, d[0, 1]), 0.0
    return Node(children=nodes, length=0.0)


def _jc(t: float) -> tuple[float, float]:
    e = np.exp(-4 * t / 3)
    return 0.25 + 0.75 * e, 0.25 - 0.25 * e


def log_likelihood(tree: Node, rows: dict[str, np.ndarray], weight: np.ndarray) -> float:
    """Jukes-Cantor log-likelihood by pruning; unknown bases are 1 for all four."""
    scale = np.zeros(len(weight))

    def part(node: Node) -> np.ndarray:
        if not node.children:
            r = rows[node.name]
            out = np.ones((4, len(r)))
            known = r < 4
            out[:, known] = 0
            out[r[known], np.flatnonzero(known)] = 1
            return out
        total = None
        for c in node.children:
            p = part(c)
            same, other = _jc(c.length)
            up = other * p.sum(0) + (same - other) * p
            total = up if total is None else total * up
        top = np.maximum(total.max(0), 1e-300)
        scale[:] += np.log(top)
        return total / top

    at = np.maximum(0.25 * part(tree).sum(0), 1e-300)
    return float(weight @ (np.log(at) + scale))


def _lengths(tree: Node, rows: dict[str, np.ndarray], weight: np.ndarray, rounds: int) -> float:
    """Branch lengths one after the other, by a shrinking search around the current value."""
    best = log_likelihood(tree, rows, weight)
    for _ in range(rounds):
        before = best
        for node in tree.walk():
            if node is tree:
                continue
            for factor in (2.0, 1.4, 1.1):
                for t in (node.length * factor + 1e-4, node.length / factor):
                    old, node.length = node.length, t
                    ll = log_likelihood(tree, rows, weight)
                    if ll > best + 1e-9:
                        best = ll
                    else:
                        node.length = old
        if best - before < 1e-3:
            break
    return best


def maximum_likelihood(alignment: dict[str, str], rounds: int = 5) -> tuple[Node, float]:
    """(tree, log-likelihood): from a BIONJ start, interchanges across inner branches while they raise the likelihood.

    Equal columns of the alignment are one column with a weight.
    """
    names = sorted(alignment)
    grid = np.array([[BASES.get(c, 4) for c in alignment[n].upper()] for n in names], np.int64).reshape(len(names), -1)
    columns, weight = np.unique(grid, axis=1, return_counts=True)
    rows = dict(zip(names, columns))
    n = len(names)
    d = np.ones((n, n))
    for i in range(n):
        for j in range(n):
            both = (columns[i] < 4) & (columns[j] < 4)
            m = weight[both].sum()
            x = 1 - 4 / 3 * (weight[both & (columns[i] != columns[j])].sum() / m if m else 0.75)
            d[i, j] = 0 if i == j else min(-0.75 * np.log(x), 1.0) if x > 0 else 1.0
    tree = bionj(d, names)
    best = _lengths(tree, rows, weight, 2)
    for _ in range(rounds):
        changed = False
        for parent in list(tree.walk()):
            for child in list(parent.children):
                for a in range(len(child.children)):
                    for sibling in list(parent.children):
                        if sibling is child or not child.children or child not in parent.children or sibling not in parent.children:
                            continue
                        i, inner = parent.children.index(sibling), child.children[a]
                        parent.children[i], child.children[a] = inner, sibling
                        ll = log_likelihood(tree, rows, weight)
                        if ll > best + 1e-6:
                            best, changed = _lengths(tree, rows, weight, 1), True
                        else:
                            parent.children[i], child.children[a] = sibling, inner
        if not changed:
            break
    return tree, _lengths(tree, rows, weight, 2)
