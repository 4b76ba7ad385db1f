from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.dsl.ast import And, Compare, Literal, Not, Or, Path, Query, Relate, quote, unquote
from treeloom.dsl.parser import parse, parse_condition
from treeloom.dsl.printer import show, show_condition
from treeloom.functions.sequences import common_substring, lcs_length, lcs_pairs
from treeloom.operators.treediff import apply_script, diff, items, simplify
from treeloom.tree.nodes import Node

names = st.sampled_from(["a_1", "b", "node", "x9"])
steps = st.lists(st.sampled_from(["body", "name", "lhs", "value"]), max_size=3).map(tuple)
paths = st.builds(Path, names, steps)
literals = st.one_of(
    st.text(st.characters(blacklist_characters="\\", blacklist_categories=["Cs"]), max_size=8).map(lambda s: Literal("string", quote(s))),
    st.integers(-99, 99).map(lambda n: Literal("number", str(n))),
    st.booleans().map(lambda b: Literal("boolean", str(b).lower())),
    names.map(lambda n: Literal("name", n)),
)
compares = st.builds(Compare, paths, st.sampled_from(["match", "is", "==", "!="]), literals)
leaf = compares


def bigger(inner):
    queries = st.builds(Query, st.sampled_from(["ifBlock", "literal"]), st.one_of(st.none(), names), st.one_of(st.none(), inner))
    many = st.lists(inner, min_size=2, max_size=3).map(tuple)
    return st.one_of(st.builds(Not, inner), st.builds(And, many), st.builds(Or, many), st.builds(Relate, paths, st.sampled_from(["contain", "in", "notIn"]), queries))


conditions = st.recursive(leaf, bigger, max_leaves=8)


def bare(c):
    """Without the places in the source."""
    if isinstance(c, Not):
        return Not(bare(c.part))
    if isinstance(c, (And, Or)):
        return type(c)(tuple(map(bare, c.parts)))
    if isinstance(c, Relate):
        q = c.query
        return Relate(c.path, c.op, Query(q.node_type, q.alias, bare(q.where) if q.where else None))
    return c


@settings(max_examples=200, deadline=None)
@given(conditions)
def test_what_is_printed_reads_back(c):
    assert bare(parse_condition(show_condition(c))) == bare(c)
    q = Query("ifBlock", "top", c)
    assert show(parse(show(q))) == show(q)


@given(st.text(st.characters(blacklist_characters="\\", blacklist_categories=["Cs"])))
def test_quoting(s):
    assert unquote(quote(s)) == s


trees = st.recursive(
    st.builds(lambda t, label, r: Node(t, r, label=label), st.sampled_from("AB"), st.sampled_from("pq"), st.sampled_from(["", "x"])),
    lambda kids: st.builds(lambda t, label, r, cs: Node(t, r, label=label, children=cs), st.sampled_from("AB"), st.sampled_from("pq"), st.sampled_from(["", "x"]), st.lists(kids, max_size=4)),
    max_leaves=14,
)


@settings(max_examples=200, deadline=None)
@given(trees, trees, st.booleans())
def test_scripts_lead_from_tree_to_tree(a, b, moves):
    edits, pairs = diff(a, b, moves)
    assert apply_script(a, edits).shape() == items(b)[0].shape()
    assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
    assert len(simplify(edits, a)) <= len(edits)


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_sequences(a, b):
    pairs = lcs_pairs(a, b)
    assert len(pairs) == lcs_length(a, b) >= common_substring(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
