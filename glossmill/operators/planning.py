"""Content planning on a document's graph: extraction, trees, redundancy, order.

These are greedy algorithms on one document, so each is a group function; the plain functions
below them take ordinary Python values and are tested alone. Random choices are seeded by the
document. A document without graph has no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict, deque
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from glossmill.operators.graph import fresh, role_rules
from glossmill.options import Options

V = Hashable


@dataclass
class Graph:
    """A document's graph: weights, edges (src, dst) → role, sources and finite verbs of vertices."""

    weights: dict[V, float]
    edges: dict[tuple[V, V], str]
    sources: dict[V, frozenset] = field(default_factory=dict)
    verbs: frozenset = frozenset()
    rules: dict[str, tuple[bool, str | None]] = field(default_factory=role_rules)

    def __post_init__(self) -> None:
        self.near: dict[V, list[tuple[V, tuple[V, V]]]] = defaultdict(list)
        for s, d in sorted(self.edges, key=str):
            self.near[s].append((d, (s, d)))
            self.near[d].append((s, (s, d)))


@dataclass(frozen=True)
class State:
    vertices: frozenset
    root: V
    source: V


def allowed(g: Graph, n: V, edge: tuple[V, V], state: State, policy: str) -> bool:
    """Whether the neighbour may join: any, of the state's source, or also as a non-core argument."""
    if n in state.vertices:
        return False
    if policy == "all" or state.source in g.sources.get(n, ()):
        return True
    return policy == "non_core" and not g.rules.get(g.edges[edge], (False, None))[0] and edge[1] == n


def required(g: Graph, v: V, state: State, policy: str, closure: bool = True) -> frozenset:
    """The vertex and all that it needs, and what these need; only itself without ``closure``."""
    seen, front = {v}, deque([v])
    while closure and front:
        u = front.popleft()
        for n, edge in g.near[u]:
            side = g.rules.get(g.edges[edge], (False, None))[1]
            if n not in seen and side == ("source" if edge[0] == u else "target") and allowed(g, n, edge, state, policy):
                seen.add(n)
                front.append(n)
    return frozenset(seen)


def start_states(g: Graph, policy: str, closure: bool = True) -> list[State]:
    """One state for each finite verb and each of its sources, with what it needs."""
    found: dict[State, None] = {}
    for v in sorted(g.verbs, key=str):
        for s in sorted(g.sources.get(v, ()), key=str):
            alone = State(frozenset([v]), v, s)
            found[State(alone.vertices | required(g, v, alone, policy, closure), v, s)] = None
    return list(found)


def next_states(g: Graph, state: State, policy: str, closure: bool = True) -> list[State]:
    """The state grown by each allowed neighbour and what that needs; distinct vertex sets."""
    found: dict[frozenset, None] = {}
    for v in sorted(state.vertices, key=str):
        for n, edge in g.near[v]:
            if allowed(g, n, edge, state, policy):
                found[state.vertices | required(g, n, state, policy, closure)] = None
    return [State(vs, state.root, state.source) for vs in found]


def subgraph_value(g: Graph, vertices: frozenset, lam: float) -> float:
    """lam times the weight, less the mean weight for each vertex taken and plus it for each there is."""
    c = sum(g.weights.values()) / len(g.weights)
    return lam * sum(g.weights[v] for v in vertices) - len(vertices) * c + len(g.weights) * c


def arg_max(values: list[float], rng: np.random.Generator) -> int:
    return int(np.argmax(values))


def soft_max(temperature: float) -> Callable[[list[float], np.random.Generator], int]:
    """Sampling by the softmax of the values, shifted by their maximum so that nothing overflows."""

    def choose(values: list[float], rng: np.random.Generator) -> int:
        x = np.asarray(values) / temperature
        p = np.exp(x - x.max())
        return int(rng.choice(len(p), p=p / p.sum()))

    return choose


def is_connected(g: Graph, vertices: frozenset) -> bool:
    start = next(iter(vertices))
    seen, front = {start}, [start]
    while front:
        for n, _ in g.near[front.pop()]:
            if n in vertices and n not in seen:
                seen.add(n)
                front.append(n)
    return len(seen) == len(vertices)


def extract(g: Graph, n: int, lam: float = 1.0, tries: int = 1000, policy: str = "non_core", choose: Callable = arg_max, closure: bool = True, seed: int = 0) -> list[tuple[State, float]]:
    """Up to ``n`` subgraphs of different vertex sets that have an edge and hang together.

    Each try starts at a state of choice and grows while the chosen next state is worth more.
    A choice without chance would repeat itself, so with ``arg_max`` each try leaves out the starts used.
    """
    rng = np.random.default_rng(seed)
    starts = start_states(g, policy, closure)
    kept: dict[frozenset, tuple[State, float]] = {}
    left = list(range(len(starts)))
    for _ in range(tries):
        if len(kept) >= n or not left:
            break
        at = left[choose([subgraph_value(g, starts[i].vertices, lam) for i in left], rng)]
        if choose is arg_max:
            left.remove(at)
        state = starts[at]
        value = subgraph_value(g, state.vertices, lam)
        while options := next_states(g, state, policy, closure):
            values = [subgraph_value(g, s.vertices, lam) for s in options]
            k = choose(values, rng)
            if values[k] <= value + 1e-12:
                break
            state, value = options[k], values[k]
        has_edge = any(s in state.vertices and d in state.vertices for s, d in g.edges)
        if has_edge and is_connected(g, state.vertices) and state.vertices not in kept:
            kept[state.vertices] = (state, value)
    return list(kept.values())


# --- trees ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    label: str
    role: str
    meaning: V | None
    children: tuple[Node, ...] = ()

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def preorder(self) -> list[Node]:
        return [self] + [x for c in self.children for x in c.preorder()]


def unfold(vertices: frozenset, edges: dict[tuple[V, V], str], meanings: dict[V, V], repeats: int | None = None) -> Node:
    """A tree of a subgraph: a vertex is repeated under each of its parents, several roots get one of their own.

    Children stand in the order of (role, vertex). A cycle is cut where it would come back to a vertex of its path.
    Repeats multiply along chains of vertices with several parents; with ``repeats``, once a tree has so many
    nodes for each vertex, further repeats stand as leaves.
    """
    made = 0
    down: dict[V, list[tuple[str, V]]] = defaultdict(list)
    indegree = dict.fromkeys(vertices, 0)
    for (s, d), role in edges.items():
        if s in vertices and d in vertices:
            down[s].append((role, d))
            indegree[d] += 1

    done: set[V] = set()

    def build(v: V, role: str, path: frozenset) -> Node:
        nonlocal made
        made += 1
        again = repeats is not None and made > repeats * len(vertices) and v in done
        done.add(v)
        kids = [] if again else [build(d, r, path | {v}) for r, d in sorted(down[v], key=lambda x: (x[0], str(x[1]))) if d not in path and d != v]
        return Node(str(v), role, meanings.get(v), tuple(kids))

    roots = sorted((v for v in vertices if not indegree[v]), key=str) or [min(vertices, key=str)]
    if len(roots) == 1:
        return build(roots[0], "", frozenset())
    return Node("root", "", None, tuple(build(v, "root", frozenset()) for v in roots))


def edit_distance(a: Node, b: Node, replace: Callable[[Node, Node], float]) -> float:
    """Ordered tree edit distance with unit insertions and deletions (keyroot dynamic programme)."""

    def index(t: Node) -> tuple[list[Node], list[int], list[int]]:
        nodes: list[Node] = []
        left: list[int] = []

        def visit(n: Node) -> int:
            first = None
            for c in n.children:
                leaf = visit(c)
                first = leaf if first is None else first
            nodes.append(n)
            left.append(len(nodes) - 1 if first is None else first)
            return left[-1]

        visit(t)
        keys = {leaf: i for i, leaf in enumerate(left)}
        return nodes, left, sorted(keys.values())

    na, la, ka = index(a)
    nb, lb, kb = index(b)
    dist = np.zeros((len(na), len(nb)))
    for i in ka:
        for j in kb:
            oi, oj = la[i], lb[j]
            f = np.zeros((i - oi + 2, j - oj + 2))
            f[1:, 0], f[0, 1:] = np.arange(1, i - oi + 2), np.arange(1, j - oj + 2)
            for x in range(oi, i + 1):
                for y in range(oj, j + 1):
                    r, c = x - oi + 1, y - oj + 1
                    if la[x] == oi and lb[y] == oj:
                        f[r, c] = min(f[r - 1, c] + 1, f[r, c - 1] + 1, f[r - 1, c - 1] + replace(na[x], nb[y]))
                        dist[x, y] = f[r, c]
                    else:
                        f[r, c] = min(f[r - 1, c] + 1, f[r, c - 1] + 1, f[la[x] - oi, lb[y] - oj] + dist[x, y])
    return float(dist[-1, -1])


def tree_similarity(a: Node, b: Node, meaning_similarity: Callable[[V, V], float | None], role_share: float = 0.1) -> float:
    """1 less the edit distance over the size of both trees, never below 0."""

    def replace(x: Node, y: Node) -> float:
        same = float(x.role == y.role)
        sim = meaning_similarity(x.meaning, y.meaning) if x.meaning is not None and y.meaning is not None else None
        return 1 - role_share * same - (1 - role_share) * (sim or 0.0)

    return 1 - min(1.0, edit_distance(a, b, replace) / (a.size() + b.size()))


def remove_redundant(similarity: np.ndarray, weights: list[float], keep: int) -> list[int]:
    """Indexes left after dropping the lighter of the most alike pair until ``keep`` are left.

    Equal similarities: the lowest pair first; equal weights: the second goes.
    """
    left = np.ones(len(weights), dtype=bool)
    i, j = np.triu_indices(len(weights), 1)
    over = len(weights) - max(keep, 0)
    for at in np.argsort(-similarity[i, j], kind="stable").tolist() if over > 0 else ():
        if over <= 0:
            break
        a, b = i[at], j[at]
        if left[a] and left[b]:
            left[a if weights[a] < weights[b] else b] = False
            over -= 1
    return np.flatnonzero(left).tolist()


def discourse_order(similarity: np.ndarray, rank: list[float]) -> list[int]:
    """From the highest rank on, always the one of most similarity to any taken, and rank, together."""
    if not rank:
        return []
    order = np.array(sorted(range(len(rank)), key=lambda i: (-rank[i], i)))
    weight = np.asarray(rank, dtype=float)[order]
    near = np.asarray(similarity)[np.ix_(order, order)]
    best, free = near[0].copy(), np.ones(len(order), dtype=bool)
    free[0] = False
    taken = [0]
    while free.any():
        at = int(np.argmax(np.where(free, best + weight, -np.inf)))
        taken.append(at)
        free[at] = False
        best = np.maximum(best, near[at])
    return order[taken].tolist()


# --- a document at a time ----------------------------------------------------------------------

PLAN_SCHEMA = "place int, root string, value double, weight double, vertices array<string>, edges array<struct<src:string,dst:string,role:string>>"


def plan_documents(vertices: DataFrame, edges: DataFrame, options: Options = Options(), keep: int = 10, sampled: bool = False, stage: str = "order") -> DataFrame:
    """Plans of documents, up to a stage: "extract", "dedup" or "order".

    ``vertices(doc_id, v, w, meaning, vec, sources, verb)``, ``edges(doc_id, src, dst, role)``.
    """
    doc = vertices.schema["doc_id"].dataType.simpleString()

    def run(vs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "place", "root", "value", "weight", "vertices", "edges"]
        if not len(vs):
            return pd.DataFrame([], columns=columns)
        vs = vs.sort_values("v", kind="stable").drop_duplicates("v")
        weight = dict(zip(vs["v"], vs["w"].fillna(0.0).astype(float)))
        role = {(s, d): r for s, d, r in zip(es["src"], es["dst"], es["role"]) if s in weight and d in weight and s != d}
        sources = {v: frozenset(s) if s is not None else frozenset() for v, s in zip(vs["v"], vs["sources"])}
        g = Graph(weight, role, sources, frozenset(vs.loc[vs["verb"].fillna(False).astype(bool), "v"]))
        seed = int(hashlib.md5(str(vs["doc_id"].iloc[0]).encode()).hexdigest()[:12], 16)
        choose = soft_max(options.softmax_temperature) if sampled else arg_max
        found = extract(g, options.num_subgraphs, min(options.num_subgraphs, options.extraction_lambda), options.max_tries, choose=choose, seed=seed)
        meaning = dict(zip(vs["v"], vs["meaning"]))
        unit: dict = {}
        for m, x in zip(vs["meaning"], vs["vec"]):
            if x is not None and np.linalg.norm(x) > 0:
                unit[m] = np.asarray(x, dtype=float) / np.linalg.norm(x)

        def alike(a: V, b: V) -> float | None:
            return 1.0 if a == b else float(unit[a] @ unit[b]) if a in unit and b in unit else None

        means = [float(np.mean([w for v in s.vertices if (w := weight[v]) != 0] or [0.0])) for s, _ in found]
        order = list(range(len(found)))
        if stage != "extract" and found:
            trees = [unfold(s.vertices, role, meaning, options.tree_repeats) for s, _ in found]
            sim = np.eye(len(trees))
            for i in range(len(trees)):
                for j in range(i):
                    sim[i, j] = sim[j, i] = tree_similarity(trees[i], trees[j], alike, options.tree_edit_lambda)
            order = remove_redundant(sim, means, keep)
            if stage == "order":
                inner = discourse_order(sim[np.ix_(order, order)], [means[i] for i in order])
                order = [order[i] for i in inner]
        out = []
        for place, i in enumerate(order):
            s, value = found[i]
            inside = [{"src": a, "dst": b, "role": r} for (a, b), r in sorted(role.items()) if a in s.vertices and b in s.vertices]
            out.append((vs["doc_id"].iloc[0], place, s.root, value, means[i], sorted(s.vertices), inside))
        return pd.DataFrame(out, columns=columns)

    return vertices.groupBy("doc_id").cogroup(fresh(edges).groupBy("doc_id")).applyInPandas(run, f"doc_id {doc}, {PLAN_SCHEMA}")
