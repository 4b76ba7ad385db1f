"""The node table that every adapter fills and every operator reads.

Node ids are pre-order ranks within a tree. A node's subtree is the ranks from `pre` to `post` + `depth`, so what lies inside what is told by
ranges (plans/structural.py), and no row grows with its depth but by the tokens below it.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.plans.structural import inside
from treeloom.sources.work import shuffled, written

NODE_FIELDS = (
    "tree_id string, node_id bigint, parent_id bigint, role string, child_kind string, pos int, node_type string, dsl_type string, "
    "is_expr boolean, is_leaf boolean, depth int, pre bigint, post bigint, label string, name string, "
    "expr_type string, value string, tokens array<string>, props map<string,string>, flags map<string,boolean>, start_line int, "
    "end_line int, data_dep_id bigint, subtree_hash string"
)


@dataclass
class Node:
    """A tree under construction; only parsers and per-tree algorithms hold these, one tree at a time."""

    node_type: str
    role: str = ""
    dsl_type: str | None = None
    label: str = ""
    name: str | None = None
    value: str | None = None
    expr_type: str | None = None
    is_expr: bool = False
    child_kind: str = "Child"
    props: dict[str, str] = field(default_factory=dict)
    flags: dict[str, bool] = field(default_factory=dict)
    start_line: int | None = None
    end_line: int | None = None
    children: list[Node] = field(default_factory=list)
    own_tokens: list[str] = field(default_factory=list)
    at: int = 0  # the place of its first token in its source

    def add(self, child: Node, role: str = "", child_kind: str | None = None) -> Node:
        child.role = role or child.role
        child.child_kind = child_kind or child.child_kind
        self.children.append(child)
        return child


def allow_depth(frames: int = 1_000_000) -> None:
    """Lets the interpreter recurse as deep as trees are; its frames lie on the heap, not on the stack of the thread."""
    import sys

    sys.setrecursionlimit(max(frames, sys.getrecursionlimit()))


def preorder(root: Node):
    """(node, parent) pairs; without recursion, as trees may be deep."""
    stack = [(root, None)]
    while stack:
        node, parent = stack.pop()
        yield node, parent
        stack += [(c, node) for c in reversed(node.children)]


def rows_of(tree_id: str, root: Node, columns: Collection[str] | None = None) -> list[dict]:
    """The tree's rows in NODE_FIELDS, parents before children; tokens and subtree_hash, which cost most, are left out where columns are named without them."""
    import hashlib

    order: list[Node] = []
    parents: list[int | None] = []
    kids: list[list[int]] = []
    depth: list[int] = []
    stack: list[tuple[Node, int | None]] = [(root, None)]
    while stack:
        n, p = stack.pop()
        i = len(order)
        order.append(n)
        parents.append(p)
        kids.append([])
        depth.append(0 if p is None else depth[p] + 1)
        if p is not None:
            kids[p].append(i)
        stack += [(c, i) for c in reversed(n.children)]
    digest: list[str] = [""] * len(order)
    tokens: list[list[str]] = [[] for _ in order]
    size = [1] * len(order)
    hashed, worded = (columns is None or c in columns for c in ("subtree_hash", "tokens"))
    for i in range(len(order) - 1, -1, -1):  # children come after their parents
        n = order[i]
        if hashed:
            text = "\0".join([n.node_type, n.label, *[f"{order[k].role}={digest[k]}" for k in kids[i]]])
            digest[i] = hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest()
        if worded:
            tokens[i] = n.own_tokens or [t for k in kids[i] for t in tokens[k]]
        if parents[i] is not None:
            size[parents[i]] += size[i]
    rows = []
    position: dict[tuple[int | None, str], int] = {}
    for i, (n, p) in enumerate(zip(order, parents, strict=True)):
        at = position.get((p, n.role), 0)
        position[p, n.role] = at + 1
        rows.append(
            {
                "tree_id": tree_id, "node_id": i, "parent_id": p, "role": n.role, "child_kind": n.child_kind, "pos": at,
                "node_type": n.node_type, "dsl_type": n.dsl_type, "is_expr": n.is_expr, "is_leaf": not n.children, "depth": depth[i],
                "pre": i, "post": i + size[i] - 1 - depth[i], "label": n.label, "name": n.name, "expr_type": n.expr_type, "value": n.value,
                "tokens": tokens[i], "props": n.props, "flags": n.flags, "start_line": n.start_line, "end_line": n.end_line,
                "data_dep_id": None, "subtree_hash": digest[i],
            }
        )
    return rows


def tree_of(rows: list[dict]) -> Node | None:
    """The tree that rows_of() made rows of; only columns that make up a tree are read."""
    made: dict[int, Node] = {}
    root = None
    for r in sorted(rows, key=lambda r: r["node_id"]):
        n = Node(r["node_type"], r.get("role") or "", label=r.get("label") or "", name=r.get("name"), value=r.get("value"), dsl_type=r.get("dsl_type"))
        made[r["node_id"]] = n
        parent = r.get("parent_id")
        if parent is None or parent != parent:
            root = n
        else:
            made[int(parent)].children.append(n)
    return root


def methods(nodes: DataFrame, node_type: str = "MethodDeclaration") -> DataFrame:
    """Nodes of a type that have no ancestor of it."""
    own = nodes.where(F.col("node_type") == node_type)
    return own.join(shuffled(inside(own, own)), ["tree_id", "node_id"], "left_anti")


def flatten(nodes: DataFrame) -> DataFrame:
    """The nodes in pre-order within their trees."""
    return nodes.repartition("tree_id").sortWithinPartitions("tree_id", "pre")


#: Hops up to which a neighbourhood is one plan of joins; longer walks write each frontier.
PLAN_HOPS = 2


def neighbourhood(nodes: DataFrame, seeds: DataFrame, hops: int | None = 1, data_deps: bool = True) -> DataFrame:
    """(tree_id, node_id, hops): nodes within some steps of the seeds along parent, child and data dependency edges; hops None: all that are reached.

    Beyond a few hops each frontier is written, and only nodes not met yet go on, so neither plan nor work grows with the hops given.
    """
    key = ["tree_id", "node_id"]
    edges = nodes.where(F.col("parent_id").isNotNull()).select(*key, F.col("parent_id").alias("to"))
    if data_deps:
        edges = edges.unionByName(nodes.where(F.col("data_dep_id").isNotNull()).select(*key, F.col("data_dep_id").alias("to")))
    edges = edges.unionByName(edges.select("tree_id", F.col("to").alias("node_id"), F.col("node_id").alias("to")))
    found = seeds.select(*key).distinct().withColumn("hops", F.lit(0))
    step = lambda df, k: df.join(shuffled(edges), key).select("tree_id", F.col("to").alias("node_id"), F.lit(k).alias("hops"))
    if hops is not None and hops <= PLAN_HOPS:
        for k in range(hops):
            found = found.unionByName(step(found, k + 1)).groupBy(*key).agg(F.min("hops").alias("hops"))
        return found
    edges = written(edges, "edges")
    frontier = written(found, "frontier")
    met, k = [frontier], 0
    while hops is None or k < hops:
        k += 1
        new = step(frontier, k).distinct()
        # edges go both ways, so a node met before was met in the last two steps
        for seen in met[-2:]:
            new = new.join(shuffled(seen.select(*key)), key, "left_anti")
        frontier = written(new, "frontier")
        if frontier.limit(1).count() == 0:
            break
        met.append(frontier)
    return reduce(DataFrame.unionByName, met)
