"""Applying a pattern's edits to trees that match it, down to their source text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators.treediff import Edit, Item, diff_with_origins, items
from treeloom.sources.work import dealt, shuffled
from treeloom.tree.nodes import Node, allow_depth, preorder
from treeloom.tree.printing import source_of


@dataclass(frozen=True)
class InsertAt:
    """Where an inserted or moved node goes: a strategy by name, so that a plan can carry it.

    "index": the index of the script, at the end if the parent has fewer children. "sibling": after the bound node that stood
    before it in the pattern, else as "index".
    """

    name: str = "index"

    def place(self, up: Item, pos: int, before: Item | None) -> int:
        if self.name == "sibling" and before is not None and before in up.kids:
            return up.kids.index(before) + 1
        return min(pos, len(up.kids))


#: Nodes whose labels are names of variables.
NAMING = ("SimpleName", "SingleVariableDeclaration", "VariableDeclarationStatement", "VariableDeclarationExpression")
STRATEGIES = {s.name: s for s in (InsertAt("index"), InsertAt("sibling"))}


def left_keys(pattern: Node, edits: list[Edit]) -> list[int | None]:
    """For each edit of a pattern the key of what stands before the place of its insert or move, in the before tree as it is by then."""
    own = {x.key: x for x in items(pattern, measured=False)}
    leaving = {e.node for e in edits if e.kind == "move"}  # until they have moved nothing is placed by them
    out: list[int | None] = []
    for e in edits:
        left = None
        if e.kind in ("insert", "tree-insert", "move"):
            up = own[e.parent]
            if e.kind == "move":
                x = own[e.node]
                leaving.discard(e.node)
                x.parent.kids.remove(x)
                x.parent = up
            else:
                x = own[e.node] = Item(e.node, e.type, e.label, e.role, up)
            left = next((k.key for k in reversed(up.kids[: e.pos]) if k.key not in leaving), None)
            up.kids.insert(e.pos, x)
        elif e.kind in ("delete", "tree-delete"):
            own[e.node].parent.kids.remove(own[e.node])
        out.append(left)
    return out


def apply_pattern(
    target: Node,
    edits: list[Edit],
    binding: dict[int, int],
    renames: dict[str, str] | None = None,
    origins: dict[int, Node] | None = None,
    pattern: Node | None = None,
    strategy: InsertAt = STRATEGIES["index"],
    lefts: list[int | None] | None = None,
) -> Item:
    """target's items with a pattern's edits. binding: pattern keys to target keys (pre-order numbers).

    origins: nodes that inserted ones come from, for printing. pattern: its before tree, which the strategy "sibling" needs, or
    lefts: what left_keys makes of it.

    New labels that name the pattern's own variables are renamed to the target's. Edits of nodes that aren't bound are left out, as
    are moves of a node below itself. Positions beyond a parent's children mean its end.
    """
    made = {x.key: x for x in items(target, measured=False)}
    for x in made.values():
        x.whole = True

    def touch(x: Item | None) -> None:
        while x is not None and x.whole:
            x.whole, x = False, x.parent

    at: dict[int, Item] = {p: made[t] for p, t in binding.items()}
    at.setdefault(-1, made[-1])
    label = lambda s: (renames or {}).get(s, s)
    if lefts is None:
        lefts = left_keys(pattern, edits) if pattern is not None else [None] * len(edits)

    for e, left in zip(edits, lefts, strict=True):
        if e.kind in ("insert", "tree-insert"):
            if e.parent in at:
                up = at[e.parent]
                x = Item(e.node, e.type, label(e.label), e.role, up, origin=(origins or {}).get(e.node))
                touch(up)
                up.kids.insert(strategy.place(up, e.pos, at.get(left)), x)
                at[e.node] = x
        elif e.node not in at:
            pass
        elif e.kind == "update":
            touch(at[e.node])
            at[e.node].label = label(e.label)
        elif e.kind == "move":
            x, to = at[e.node], at.get(e.parent)
            up = to
            while up is not None and up is not x:
                up = up.parent
            if not (to is None or up is x or x.parent is None):
                touch(x.parent)
                touch(to)
                x.parent.kids.remove(x)
                x.parent, x.role = to, e.role
                to.kids.insert(strategy.place(to, e.pos, at.get(left)), x)
        elif at[e.node].parent is not None:
            x = at[e.node]
            if x in x.parent.kids:
                touch(x.parent)
                x.parent.kids.remove(x)
    return made[-1]


PATCHED = "pattern_id string, tree_id string, instance int, patched string, skipped int, error string"


def patched(texts: DataFrame, instances: DataFrame, changes: dict[str, tuple[str, str]], parse, strategy: str = "index") -> DataFrame:
    """PATCHED rows: the text of each tree after a pattern's change, for each instance of the pattern in it.

    texts: (tree_id, text); instances: (pattern_id, tree_id, instance, p_node, t_node) over the trees that parse gives; changes:
    the before and after texts of each pattern (a bounded number of them). skipped counts edits whose nodes aren't bound; a
    text that can't be read gives a row with its error.
    """
    bound = instances.groupBy("pattern_id", "tree_id", "instance").agg(F.map_from_entries(F.collect_list(F.struct("p_node", "t_node"))).alias("binding"))
    # joined by sorting, so that the rows of a tree come one after another
    rows = dealt(texts.select("tree_id", "text"), "tree_id").join(shuffled(bound), "tree_id").select("pattern_id", "tree_id", "instance", "text", "binding")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {}
        allow_depth()
        for key, (before, after) in changes.items():
            a = parse(before)
            edits, _, origins = diff_with_origins(a, parse(after))
            new = {e.node for e in edits if e.kind == "insert"}
            named = [e.parent if e.kind == "insert" else e.node for e in edits]
            known[key] = ([n for n, _ in preorder(a)], edits, origins, left_keys(a, edits), [n for n in named if n is not None and n != -1 and n not in new])
        last, target, nodes, error = None, None, [], None  # a text is read once for all that is done to it
        for batch in batches:
            out = []
            for key, tree, k, text, binding in batch.itertuples(index=False):
                if (tree, text) != last:
                    last, target, nodes, error = (tree, text), None, [], None
                    try:
                        target = parse(text)
                        nodes = [n for n, _ in preorder(target)]
                    except ValueError as e:
                        error = str(e)
                if error is not None:
                    out.append((key, tree, k, None, None, error))
                    continue
                own, edits, origins, lefts, named = known[key]
                binding = {int(p): int(t) for p, t in dict(binding).items()}
                try:
                    top = apply_pattern(target, edits, binding, _renames(own, nodes, binding), origins, strategy=STRATEGIES[strategy], lefts=lefts)
                except ValueError as e:
                    out.append((key, tree, k, None, None, str(e)))
                    continue
                out.append((key, tree, k, source_of(top), sum(n not in binding for n in named), None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PATCHED.split(", ")]).astype({"skipped": "Int32"})

    return rows.mapInPandas(run, PATCHED)


def variable_renames(pattern: Node, target: Node, binding: dict[int, int]) -> dict[str, str]:
    """The target's names for the pattern's local variables, from bound declarations and names."""
    return _renames([n for n, _ in preorder(pattern)], [n for n, _ in preorder(target)], binding)


def _renames(pattern: list[Node], target: list[Node], binding: dict[int, int]) -> dict[str, str]:
    """variable_renames of nodes in pre-order."""
    out: dict[str, str] = {}
    for a, b in sorted(binding.items()):
        if a < 0 or b < 0:  # the artificial roots
            continue
        x, y = pattern[a], target[b]
        if x.node_type == y.node_type and x.node_type in NAMING and x.label and y.label:
            out.setdefault(x.label, y.label)
    return out
