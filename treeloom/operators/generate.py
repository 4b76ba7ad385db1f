"""Patterns as queries of the tree language.

A considered node is asked for by the path from the method down to it. Steps into bodies and collections open a nested query,
steps to a single child lengthen the role path, unaddressable steps end the path there. Longer paths come first; a path's
shared beginning is one query.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from treeloom.dsl.ast import And, Compare, Condition, Literal, Not, Path, Query, Relate, join, quote
from treeloom.dsl.printer import show
from treeloom.dsl.vocabulary import JAVA, Vocabulary
from treeloom.tree.nodes import Node, preorder

# How an alias begins for types whose stem isn't their keyword.
STEMS = {
    "functionDeclaration": "fundecl", "functionCall": "funcall", "binaryOperation": "binaryoper", "unaryOperation": "unaryoper", "valueDeclaration": "valdecl",
    "returnStatement": "return", "throwStatement": "throw", "fieldAccess": "fieldacc", "arrayAccess": "arrayacc", "castExpression": "castexp", "ifBlock": "ifblk",
    "whileBlock": "whileblk", "forBlock": "forblk", "forEachBlock": "foreachblk", "catchBlock": "catchblk", "exceptionBlock": "exceptblk", "lambdaExpression": "lambdaexpr",
    "nullLiteral": "nulllit", "objectCreationExpression": "objcreaexpr", "ternaryOperation": "ternoper", "thisExpression": "thisexpr",
}


@dataclass
class _Names:
    """Aliases are numbered within a query, so equal patterns give equal texts."""

    seen: dict[str, int] = field(default_factory=dict)

    def fresh(self, kind: str | None) -> str:
        stem = STEMS.get(kind or "", (kind or "alias").lower())
        self.seen[stem] = self.seen.get(stem, 0) + 1
        return f"{stem}_{self.seen[stem]}"


@dataclass
class _Step:
    """A query under construction: conditions on itself and queries nested in it by the path that leads there."""

    node: Node
    query: Query
    conditions: list[Condition] = field(default_factory=list)
    nested: dict[tuple[tuple[str, ...], int], _Step] = field(default_factory=dict)

    def finished(self) -> Query:
        parts = list(self.conditions)
        for (roles, _), step in self.nested.items():
            parts.append(Relate(Path(self.query.alias, roles), "contain", step.finished()))
        return replace(self.query, where=join(And, parts))


def literal_condition(path: Path, node: Node, regex: str | None = None) -> Condition | None:
    """The name, value or operator that a considered node asks for; null if it has none."""
    if regex is not None:
        return Compare(Path(path.alias, (*path.steps, "name")) if node.name else path, "match", Literal("string", quote(regex)))
    if node.node_type.endswith("Type") and node.name:
        return Compare(Path(path.alias, (*path.steps, "name")), "match", Literal("string", quote(".*" + node.name)))
    if node.node_type in ("StringLiteral", "CharacterLiteral", "NumberLiteral", "BooleanLiteral"):
        text = node.value or ""
        lit = Literal("string", quote(text)) if text[:1] in "\"'" else Literal("boolean" if text in ("true", "false") else "number", text.rstrip("lLfFdD") if text[:1].isdigit() else text)
        return Compare(Path(path.alias, (*path.steps, "value")), "==", lit)
    if node.name:
        return Compare(Path(path.alias, (*path.steps, "name")), "==", Literal("string", quote(node.name)))
    if "operator" in node.props:
        return Compare(Path(path.alias, (*path.steps, "operator")), "==", Literal("string", quote(node.props["operator"])))
    return None


def generate(method: Node, considered: set[int], *, attrs: dict[int, set[str]] | None = None, regexes: dict[int, str] | None = None, inserted: list[tuple[int, Node]] = (), moved: list[tuple[int, int]] = (), vocabulary: Vocabulary = JAVA) -> Query:
    """The query of a pattern's before tree. considered: pre-order numbers; attrs: what counts of each (all if not given).

    inserted: (parent number, node): nothing of the kind may stand there yet. moved: (node number, new parent's number): the
    node isn't there yet.
    """
    order = list(preorder(method))
    number = {id(n): i for i, (n, _) in enumerate(order)}
    parent = {number[id(n)]: number[id(p)] for n, p in order if p is not None}
    names = _Names()
    root_name = names.fresh("functionDeclaration")
    root = _Step(method, Query("functionDeclaration", root_name))
    for flag in sorted(f for f, on in method.flags.items() if on and f in vocabulary.flags):
        if 0 in considered:
            root.conditions.append(Compare(Path(root_name, (flag,)), "==", Literal("boolean", "true")))
    steps: dict[int, _Step] = {0: root}

    def reach(i: int) -> tuple[_Step, tuple[str, ...]] | None:
        """The query that is to hold node i and the roles from it to i; None if i can't be addressed."""
        if i == 0:
            return root, ()
        node, found = order[i][0], reach(parent[i])
        if found is None:
            return None
        step, roles = found
        role = node.role
        if roles and vocabulary.action(roles[-1]) in ("Body", "Collection"):  # among many: any of its kind
            return (step, roles) if node.dsl_type is None else (opened(i, step, roles), ())
        if not role or not vocabulary.knows(role):
            return step, roles  # a transparent step
        if vocabulary.action(role) in ("Body", "Collection"):
            return (step, (*roles, role)) if node.dsl_type is None else (opened(i, step, (*roles, role)), ())
        if not roles and step.node is not order[parent[i]][0] and order[parent[i]][0].dsl_type:
            step = opened(parent[i], step, ())
        return step, (*roles, role)

    def opened(i: int, step: _Step, roles: tuple[str, ...]) -> _Step:
        if i not in steps:
            node = order[i][0]
            steps[i] = step.nested.setdefault((roles, i), _Step(node, Query(node.dsl_type, names.fresh(node.dsl_type))))
        return steps[i]

    def depth(i: int) -> int:
        return 0 if i == 0 else 1 + depth(parent[i])

    for i in sorted(considered - {0}, key=lambda i: (-depth(i), i)):
        found = reach(i)
        if found is None:
            continue
        step, roles = found
        node = order[i][0]
        counts = attrs is None or "name" in attrs.get(i, set())
        if node.dsl_type is not None and step.node is not node and not (roles and vocabulary.action(roles[-1]) == "Child"):
            step, roles = opened(i, step, roles), ()
        if node.dsl_type is not None and roles:
            step.conditions.append(Compare(Path(step.query.alias, roles), "is", Literal("name", node.dsl_type)))
        if counts or (regexes and i in regexes):
            made = literal_condition(Path(step.query.alias, roles), node, (regexes or {}).get(i))
            if made is not None and made not in step.conditions:
                step.conditions.append(made)
    for at, node in inserted:
        found = reach(at)
        if found is None or node.dsl_type is None:
            continue
        step, roles = found
        inner = Query(node.dsl_type, names.fresh(node.dsl_type))
        made = literal_condition(Path(inner.alias), node)
        step.conditions.append(Not(Relate(Path(step.query.alias, roles), "contain", replace(inner, where=made))))
    for i, to in moved:
        target, up = order[to][0], parent.get(i)
        while up is not None and up != to:
            up = parent.get(up)
        found = reach(i)
        if up == to or target.dsl_type is None or found is None:
            continue  # moved outward: it is below its new parent already
        step, roles = found
        step.conditions.append(Relate(Path(step.query.alias, roles), "notIn", Query(target.dsl_type, names.fresh(target.dsl_type))))
    q = root.finished()
    if q.where is None:
        q = replace(q, where=Compare(Path(root_name, ("name",)), "==", Literal("string", quote(method.name or ""))))
    return q


def generate_text(method: Node, considered: set[int], **kw) -> str:
    return show(generate(method, considered, **kw))
