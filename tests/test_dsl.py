import pytest

from treeloom.dsl import ast, rewrite
from treeloom.dsl.analyzer import report, suggest, validate, validity_rate
from treeloom.dsl.parser import ParseError, parse, parse_condition, try_parse
from treeloom.dsl.printer import show, show_condition
from treeloom.dsl.vocabulary import JAVA, JAVA_STRICT, JAVA_TYPES

GOOD = [
    "ifBlock i where i.condition is binaryOperation;",
    'functionDeclaration f where not(f.body contain functionCall c where c.name == "x");',
    "functionDeclaration f where and(f.isPublic, f.isStatic, f.name match 'a''b.*');",
    "ifBlock where or(ifBlock.condition is literal, not(ifBlock.thenBlock contain returnStatement));",
    "literal l where l.value == -1.5e3;",
    "literal l where l.value != true; // trailing",
    "ifBlock i where /* why */ i in whileBlock;",
    "ifBlock i where i notIn functionDeclaration f where f.name == \"say \"\"hi\"\" \\\" \\d\";",
    "catchBlock c where c.parameters contain alias_1 where alias_1 is valueDeclaration;",
    "binaryOperation b where and(b.lhs is literal, and(b.rhs is literal, b.operator == \"+\"));",
]
BAD = {
    "ifBlock i where i.condition": "';'",
    "ifBlock i;": "'where'",
    "ifBlock i where and(i.a);": "','",
    "ifBlock i where i.name == ;": "a value",
    "ifBlock i where i.name ~ 3;": "unexpected '~'",
    "where i;": "a node type",
    "ifBlock i where not(i.a;": "')'",
}


@pytest.mark.parametrize("text", GOOD)
def test_round_trip(text):
    q = parse(text)
    again = parse(show(q))
    assert show(again) == show(q)
    assert [x.name for x in ast.queries(again)] == [x.name for x in ast.queries(q)]


@pytest.mark.parametrize("text", BAD)
def test_errors_say_where(text):
    q, error = try_parse(text)
    assert q is None and BAD[text] in error.message and error.line == 1 and error.column == error.at + 1


def test_error_place_in_lines():
    with pytest.raises(ParseError) as e:
        parse("ifBlock i where\n  and(i.a,\n  );")
    assert (e.value.line, e.value.column, e.value.token) == (3, 3, ")")


def test_literals():
    assert ast.unquote('"a""b\\d"') == 'a"b\\d'
    assert ast.unquote(ast.quote('x"y')) == 'x"y'
    c = parse_condition("l.value == 12")
    assert c.literal.value == 12 and parse_condition("l.flag").literal.value is True


def test_validation_cases():
    kinds = lambda t, v=JAVA_STRICT: [f.kind for f in validate(parse(t), v)]
    assert "unsupported_property_path" in kinds("binaryOperation b_1 where b_1.operator is instanceof ;")
    assert kinds('invalidNodeType n where n.name == "t";') == ["invalid_node_type"]
    assert kinds("binaryOperation b_1 where b_1 is instanceofExpression;") == []
    assert kinds('ifBlock i where j.name == "x";') == ["missing_alias"]
    assert kinds("ifBlock i where i contain ifBlock i where i.condition is literal;") == ["duplicate_alias"]
    assert kinds('ifBlock i where i.colour == "red";') == ["invalid_property"]
    assert "invalid_value_for_property" in kinds("binaryOperation b where b.operator == instanceof;", JAVA)
    found = validate(parse('ifBlok i where i.conditon == "x";'), JAVA)
    assert [suggest(f, JAVA).split(" or ")[0] for f in found] == ["use ifBlock", "use condition"]
    assert len(JAVA_TYPES) == 42


def test_report_and_rate():
    rows = report({"a": GOOD[0], "b": "nonsense"}, JAVA)
    assert [(r[0], r[1]) for r in rows] == [("a", True), ("b", False)]
    assert validity_rate([*GOOD, "x"]) == len(GOOD) / (len(GOOD) + 1) and validity_rate([]) is None


def test_conditions_flatten_and_collapse():
    c = parse_condition("and(a.x, and(a.y, a.x), or(a.z, a.z))")
    assert show_condition(ast.join(ast.And, list(c.parts))).count("a.x") == 1
    assert rewrite.remove(parse_condition("and(a.x, not(a.y))"), "a.y", "==") == parse_condition("a.x")
    assert rewrite.remove(parse_condition("not(a.y)"), "a.y", "==") is None


def test_merge_applies_each_constraint_once():
    q = parse('ifBlock i_1 where i_1 contain functionCall c_1 where and(c_1.name == "a", c_1.base is literal);')
    make = rewrite.Constraint
    out = rewrite.merge(q, [make("c_1.name", "==", "b", "edit"), make("c_1.base", "is", "", "del"), make("c_1.arguments", "is", "literal", "add", True), make("zz.name", "==", "x")])
    inner = list(ast.queries(out))[1]
    assert show_condition(inner.where).split() == 'and( c_1.name == "b", not( c_1.arguments is literal ) )'.split()
    gone = rewrite.merge(parse('ifBlock i where i.name == "a";'), [make("i.name", "==", "", "del")])
    assert show(gone).split() == "ifBlock i where i is ifBlock;".split()
    assert rewrite.merge(out, []) == out


def test_constraint_checks_and_repair():
    q = parse('ifBlock i_1 where i_1.condition is literal;')
    make = rewrite.Constraint
    rule = lambda c: rewrite.check(c, q, JAVA)[:2]
    assert rule(make("i_1.name", "==", "x")) == ("valid", "")
    assert rule(make("i 1", "==", "x")) == ("invalid", "path")
    assert rule(make("j.name", "==", "x")) == ("invalid", "alias")
    assert rule(make("i_1", "contain", "literal")) == ("invalid", "subquery")
    assert rule(make("i_1.name", "~", "x")) == ("invalid", "conversion")
    assert rule(make("i_1.nam", "==", "x")) == ("fixable", "invalid_property")
    assert rule(make("i_1.zzz", "==", "x", "del")) == ("invalid", "target")
    fixed = rewrite.classify([make("i_1.nam", "==", "x")], q, JAVA, repair=lambda c, m: make("i_1.name", "==", "x"))
    assert fixed["valid"] == [make("i_1.name", "==", "x")] and not fixed["fixable"]


@pytest.mark.parametrize(
    "text",
    [
        "Constraint 1:\n- Type: add\n- Path: a.name\n- Operator: ==\n- Value: \"x\"\n- Is Negative: true\n\nConstraint 2:\nType: del\nPath: b.name\nOperator: match",
        "- Type - add\n- Path - a.name\n- Operator - ==\n- Value - \"x\"\n- Is Negative - yes\n- Type - remove\n- Path - b.name\n- Operator - match",
        "Type: add\nPath: a.name\nOperator: not ==\nValue: \"x\"\n\nPath: b.name\nType: delete\nOperator: match\nsome prose",
    ],
)
def test_extraction_layouts(text):
    a, b = rewrite.extract(text)
    assert (a.path, a.op, a.value, a.action, a.negative) == ("a.name", "==", '"x"', "add", True)
    assert (b.path, b.op, b.action, b.negative) == ("b.name", "match", "del", False)


def test_dialogue_repairs_stores_and_resumes():
    from treeloom.dsl.dialogue import STEPS, Dialogue

    answers = {
        "analyse_query": "a", "analyse_false_positive": "b", "repair": "- Type: add\n- Path: i_1.name\n- Operator: ==\n- Value: \"x\"",
        "extract": "- Type: add\n- Path: i_1.nam\n- Operator: ==\n- Value: \"x\"\n\n- Type: add\n- Path: zz.name\n- Operator: ==\n- Value: \"y\"",
    }
    stored = []
    d = Dialogue("ifBlock i_1 where i_1.condition is literal;", lambda step, context: answers[step], JAVA, lambda step, context: stored.append((step, dict(context))))
    refined = d.run()
    assert refined.split() == 'ifBlock i_1 where and( i_1.condition is literal, i_1.name == "x" );'.split()
    assert tuple(s for s, _ in stored) == STEPS
    again = Dialogue(d.query, None, JAVA, context={"valid": stored[3][1]["valid"]})
    assert again.run("construct") == refined
    with pytest.raises(ValueError):
        again.run("extract")


def test_one_shot_refinement(spark):
    from treeloom.dsl.oneshot import proposed, refined_once
    from treeloom.dsl.vocabulary import JAVA_STRICT

    assert proposed(None) is None and proposed("no query") is None
    assert proposed('```\na x where x.name == "1";\n``` or\n```dsl\nb y where y.name == "2";\n```') == 'b y where y.name == "2";'
    good = 'ifBlock i where i contain returnStatement r;'
    rows = [(1, "q;", f"use {good} instead"), (2, "q;", None), (3, "q;", "```\nnoSuch n where n contain ifBlock i;\n```"), (4, None, "```\nifBlock where;\n```")]
    got = {r.query_id: (r.refined, r.status) for r in refined_once(spark.createDataFrame(rows, "query_id long, query string, answer string"), JAVA_STRICT).collect()}
    assert got == {1: (good, "refined"), 2: ("q;", "unchanged"), 3: ("q;", "invalid"), 4: ("", "invalid")}
