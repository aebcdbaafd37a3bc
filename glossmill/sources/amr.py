"""AMR banks: reading, alignments and writing.

A bank is a text of blocks parted by blank lines. A block needs ``# ::id``, ``# ::tok`` and
``# ::alignments`` lines and a graph in bracket notation; a block that cannot be read gives one row
with its error instead of stopping the bank.

Defined results: null and empty banks have no blocks; inverse roles (``-of``, and ``:mod`` for
``:domain``) are kept as written unless ``keep_inverse`` is off; constants are quoted, and one that
comes again gets a suffix ``_2``, ``_3`` ...
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(\()|(\))|(/)(?=\s)|(:[^\s()]+)|("(?:[^"\\\n]|\\.)*"(?:~[A-Za-z0-9.,]+)?)|([^\s()]+))')
_ALIGNED = re.compile(r"~e\.([0-9]+)\Z")
_VARIABLE = re.compile(r"[a-z]+[0-9]*\Z")
#: A constant at the end of a vertex's name, and what tells repeated ones apart.
_CONSTANT = re.compile(r'("(?:[^"\\\n]|\\.)*")(?:_[0-9]+)?\Z')


@dataclass
class Parsed:
    """Graph of one block: edges in order of writing, places of tokens, order of vertices."""

    root: str = ""
    edges: list[tuple[str, str, str]] = field(default_factory=list)
    reentrant: list[bool] = field(default_factory=list)
    aligned: list[tuple[str, int]] = field(default_factory=list)
    variables: set[str] = field(default_factory=set)


def _part(text: str) -> tuple[str, int | None]:
    """A mark and the token it is aligned to; a mark of several tokens stays unaligned."""
    cut = text.rfind("~", 1)
    if cut < 0:
        return text, None
    m = _ALIGNED.search(text)
    return text[:cut], int(m[1]) if m else None


def parse_graph(text: str, keep_inverse: bool = True) -> Parsed:
    """Bracket notation to edges with a stack of open variables; raises ValueError on a broken graph."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unreadable at {at}")
        tokens.append((m.lastindex, m[m.lastindex]))
        at = m.end()
    out, seen, counts = Parsed(), set(), {}
    variables = {tokens[i + 1][1] for i in range(len(tokens) - 2) if tokens[i][0] == 1 and tokens[i + 2][0] == 3}
    stack: list[str] = []
    pending: list[tuple[str, int | None] | None] = []
    role: tuple[str, int | None] | None = None
    k = 0

    def link(source: str, label: str, target: str, again: bool) -> None:
        inverse = label == ":mod" or (label.endswith("-of") and label not in (":consist-of", ":prep-out-of"))
        if inverse and not keep_inverse:
            source, target = target, source
            label = ":domain" if label == ":mod" else label[: -len("-of")]
        if source == target or (label != ":instance" and any(s == source and d == target for s, _, d in out.edges)):
            raise ValueError(f"edge {source} {label} {target} is a loop or comes twice")
        out.edges.append((source, label, target))
        out.reentrant.append(again)

    while k < len(tokens):
        kind, word = tokens[k]
        if kind == 1:
            if k + 3 >= len(tokens) or tokens[k + 2][0] != 3:
                raise ValueError("a bracket without variable and concept")
            variable, (concept, where) = tokens[k + 1][1], _part(tokens[k + 3][1])
            if not _VARIABLE.match(variable):
                raise ValueError(f"no variable: {variable}")
            seen.add(variable)
            out.variables.add(variable)
            link(variable, ":instance", concept, False)
            if where is not None:
                out.aligned.append((variable, where))
            if not stack and not out.root:
                out.root = variable
            elif role is None:
                raise ValueError("a second graph in one block")
            pending.append(role)
            role = None
            stack.append(variable)
            k += 4
            continue
        if kind == 2:
            if not stack:
                raise ValueError("a bracket too many")
            variable, via = stack.pop(), pending.pop()
            if via is not None:
                link(stack[-1], via[0], variable, False)
                if via[1] is not None and all(v != variable for v, _ in out.aligned):
                    out.aligned.append((variable, via[1]))
        elif kind == 4:
            role = _part(word)
        elif role is None or not stack:
            raise ValueError(f"a value without role: {word}")
        else:
            label, where = _part(word)
            if label in variables:
                link(stack[-1], role[0], label, label in seen)
                seen.add(label)
            else:
                label = label if label.startswith('"') else f'"{label}"'
                if label in seen:
                    counts[label] = counts.get(label, 1) + 1
                    label = f"{label}_{counts[label]}"
                seen.add(label)
                link(stack[-1], role[0], label, False)
            if where is not None:
                out.aligned.append((label, where))
            role = None
        k += 1
    if stack or not out.root:
        raise ValueError("an open bracket, or no graph")
    return out


def read_alignments(text: str) -> list[tuple[int, tuple[int, ...]]]:
    """(token, address) pairs of either written form, ``token-address`` or ``from-to|address+address``.

    Of several addresses for k tokens, the last k belong to one token each and all before to every token.
    """
    def address(a: str) -> tuple[int, ...]:
        return tuple(0 if x in "rR" else int(x) for x in a.split("."))

    out: list[tuple[int, tuple[int, ...]]] = []
    for item in text.split():
        span, bar, places = item.partition("|")
        if not bar:
            token, _, a = item.partition("-")
            out.append((int(token), address(a)))
            continue
        first, last = map(int, span.split("-"))
        marks = [address(a) for a in places.split("+")]
        width = last - first
        if width == 1:
            out += [(first, a) for a in marks]
        elif len(marks) > width:
            shared = len(marks) - width
            for i in range(width):
                out += [(first + i, a) for a in (marks[shared + i], *marks[:shared])]
        else:
            raise ValueError(f"alignment {item}")
    return out


def vertex_at(graph: Parsed, address: tuple[int, ...]) -> str | None:
    """The vertex of an address; the root's own number tells whether children count from 0 or 1."""
    base, v = address[0], graph.root
    for step in address[1:]:
        children = [d for (s, r, d), again in zip(graph.edges, graph.reentrant) if s == v and r != ":instance" and not again]
        order = sorted(children, key=lambda d: next(i for i, e in enumerate(_written(graph)) if e == d))
        if not 0 <= step - base < len(order):
            return None
        v = order[step - base]
    return v


def _written(graph: Parsed) -> list[str]:
    """Vertices in the order they are first written."""
    order = [graph.root]
    down: dict[str, list[str]] = {}
    for s, r, d in graph.edges:
        if r != ":instance":
            down.setdefault(s, []).append(d)
    # edges to a bracket are noted when it closes, so go down again from the root
    seen, stack = {graph.root}, list(reversed(down.get(graph.root, [])))
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            order.append(v)
            stack += reversed(down.get(v, []))
    return order + [d for _, r, d in graph.edges if r != ":instance" and d not in seen] + [s for s, _, _ in graph.edges if s not in seen]


BLOCK_SCHEMA = "graph_id string, root string, tokens array<string>, edges array<struct<src:string,role:string,dst:string>>, alignments array<struct<v:string,i:int>>, error string"


def read_block(block: str, number: int, keep_inverse: bool = True) -> tuple:
    """One row of ``BLOCK_SCHEMA``; the error is set if the block cannot be read."""
    lines = block.strip("\n").split("\n")
    head = {}
    for line in lines:
        if m := re.match(r"#\s::(id|tok|alignments)\s?(.*)", line):
            head.setdefault(m[1], m[2])
    name = (head.get("id", "").split() or [str(number)])[0]
    try:
        for need in ("id", "tok", "alignments"):
            if need not in head:
                raise ValueError(f"no {need} line")
        g = parse_graph("\n".join(x for x in lines if not x.startswith("#")), keep_inverse)
        aligned = list(g.aligned)
        if not aligned:
            found = read_alignments(head["alignments"].split("::")[0])
            aligned = [(v, i) for i, a in found if (v := vertex_at(g, a)) is not None]
        edges = [{"src": s, "role": r, "dst": d} for s, r, d in g.edges]
        return name, g.root, head["tok"].split(" "), edges, [{"v": v, "i": i} for v, i in dict.fromkeys(aligned)], None
    except (ValueError, StopIteration) as e:
        return name, None, None, None, None, str(e)[:200]


def read_banks(documents: DataFrame, keep_inverse: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, block columns): one row a graph of each text; narrow, no shuffle."""
    kind = documents.schema[id_column].dataType.simpleString()
    blocks = documents.where(F.col(text_column).contains("# ::")).select(
        id_column, F.posexplode(F.split(F.regexp_replace(text_column, "\r\n?", "\n"), r"\n[ \t]*\n\s*")).alias("number", "block")
    ).where(~F.col("block").rlike(r"\A(?:#[^\n]*\n?)*\z") & F.col("block").contains("# ::"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["graph_id", "root", "tokens", "edges", "alignments", "error"]
        for p in batches:
            out = pd.DataFrame([read_block(b, n, keep_inverse) for b, n in zip(p["block"], p["number"])], columns=names)
            out.insert(0, id_column, p[id_column].to_numpy())
            yield out

    return blocks.mapInPandas(run, f"{id_column} {kind}, {BLOCK_SCHEMA}")


def graph_tables(graphs: DataFrame, id_column: str = "doc_id") -> dict[str, DataFrame]:
    """Flat tables of the graphs: edges, tokens, alignments and roots."""
    good = graphs.where("error is null")
    key = [F.col(id_column).alias("doc_id"), "graph_id"]
    return {
        "roots": good.select(*key, "root"),
        "edges": good.select(*key, F.inline("edges")),
        "tokens": good.select(*key, F.posexplode("tokens").alias("i", "form")),
        "alignments": good.select(*key, F.inline("alignments")),
        "errors": graphs.where("error is not null").select(*key, "error"),
    }


def span_tops(graphs: DataFrame, max_span: int = 5) -> DataFrame:
    """(id, graph_id, l, r, top): the vertex on top of all vertices aligned to a span of two or more tokens.

    The aligned vertices must hang together, and the one nearest to the root must reach the others.
    """

    def tops(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc, gid, root, tokens, edges, alignments in p[["doc_id", "graph_id", "root", "tokens", "edges", "alignments"]].itertuples(index=False):
            down: dict[str, list[str]] = {}
            for e in edges:
                if e["role"] != ":instance":
                    down.setdefault(e["src"], []).append(e["dst"])
            depth, front = {root: 0}, [root]
            for v in front:
                for d in down.get(v, []):
                    if d not in depth:
                        depth[d] = depth[v] + 1
                        front.append(d)
            at: dict[int, set] = {}
            for a in alignments:
                at.setdefault(a["i"], set()).add(a["v"])
            for left in range(len(tokens)):
                for right in range(left + 2, min(left + max_span, len(tokens)) + 1):
                    vs = set().union(*[at.get(i, set()) for i in range(left, right)])
                    if not vs:
                        continue
                    top = min(vs, key=lambda v: (depth.get(v, 1 << 20), v))
                    reach, front = {top}, [top]
                    for v in front:
                        for d in down.get(v, []):
                            if d in vs and d not in reach:
                                reach.add(d)
                                front.append(d)
                    if reach == vs:
                        out.append((doc, gid, left, right, top))
        return pd.DataFrame(out, columns=["doc_id", "graph_id", "l", "r", "top"])

    kind = graphs.schema["doc_id"].dataType.simpleString()
    good = graphs.where("error is null").select("doc_id", "graph_id", "root", "tokens", "edges", "alignments")
    return good.mapInPandas(lambda it: map(tops, it), f"doc_id {kind}, graph_id string, l int, r int, top string")


def write_graph(root: str, edges: list[tuple[str, str, str]], concepts: dict[str, str]) -> str:
    """Bracket notation of a graph: edges against the walk are turned round, cycles and repeats named only.

    Roles are written in order; a vertex that was written before appears as its variable. Vertices named
    after their graph get the variable that ends their name, with a number where it is taken; constants
    lose the graph and the suffix that told them apart.
    """
    around: dict[str, list[tuple[str, str]]] = {}
    for s, r, d in sorted(set(edges)):
        turned = r[: -len("-of")] if r.endswith("-of") else f"{r}-of"
        around.setdefault(s, []).append((r, d))
        around.setdefault(d, []).append((turned, s))
    used: set[frozenset] = set()
    seen: set[str] = set()
    variables: dict[str, str] = {}
    taken: dict[str, int] = {}

    def named(v: str) -> str:
        if v not in variables:
            tail = v.rpartition("_")[2]
            base = tail if _VARIABLE.match(tail) else "x"
            k = taken.get(base, 0) + 1
            while (name := base if k == 1 else f"{base.rstrip('0123456789')}{k + 100}") in variables.values():
                k += 1
            taken[base], variables[v] = k, name
        return variables[v]

    def walk(v: str, depth: int) -> str:
        seen.add(v)
        parts = [f"({named(v)} / {concepts.get(v, 'thing')}"]
        for role, d in sorted(around.get(v, [])):
            if (pair := frozenset((v, d))) in used:
                continue
            used.add(pair)
            constant = _CONSTANT.search(d)
            inner = constant[1] if constant else named(d) if d in seen else walk(d, depth + 1)
            parts.append("\n" + "   " * (depth + 1) + f"{role} {inner}")
        return "".join(parts) + ")"

    return walk(root, 0)


def write_plans(plans: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc_id, place, amr) of planned subgraphs; a vertex without concept is a thing, the least concept counts."""
    kinds = concepts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "concept"))).alias("c"))
    kind = plans.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            texts = [write_graph(r, [(e["src"], e["role"], e["dst"]) for e in es], dict(c) if c is not None else {}) for r, es, c in zip(p["root"], p["edges"], p["c"])]
            yield pd.DataFrame({"doc_id": p["doc_id"], "place": p["place"], "amr": texts})

    return plans.join(kinds, "doc_id", "left").select("doc_id", "place", "root", "edges", "c").mapInPandas(run, f"doc_id {kind}, place int, amr string")
