"""Registered queries over code trees: Java methods written from the columns of a table, so that SQL over the columns says what to find.

Every customer has a class with one method, `check`, whose parts depend on the customer's segment, nation, balance and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.dsl.vocabulary import JAVA
from treeloom.functions import columns as C
from treeloom.operators import generate, patch, patterns, scopes, treediff
from treeloom.plans.compiler import NodePlanner, run
from treeloom.sources import sinks
from treeloom.sources.files import method_by_signature, parsed
from treeloom.sources.work import dealt, shuffled, written
from treeloom.tree.java import parse_unit
from treeloom.tree.nodes import Node, methods, neighbourhood, preorder

Queries = dict[str, object]
QUERIES: Queries = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


# Which parts a customer's method has.
_IF = "c_acctbal >= 0"
_LOOP = "c_nationkey % 3 = 0"
_TRY = "c_custkey % 2 = 0"
_LOG = "c_custkey % 5 <> 0"
_STATIC = "c_nationkey > 12"


def _when(condition: str, text: Column | str) -> Column:
    return F.when(F.expr(condition), F.lit(text) if isinstance(text, str) else text).otherwise(F.lit(""))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(tree_id, text) of every customer's class."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    text = F.concat(
        F.lit("class C"), "c_custkey", F.lit(" {\n  private int limit = "), "c_nationkey", F.lit(";\n  public "), _when(_STATIC, "static "),
        F.lit("int check(int balance, String segment) {\n    int base = balance + limit;\n"),
        _when(_IF, F.concat(F.lit("    if (balance > "), "c_nationkey", F.lit(") { return base; }\n"))),
        _when(_LOOP, "    for (int i = 0; i < base; i++) { use(i, base); }\n"),
        _when(_LOG, F.concat(F.lit('    log(segment, "'), "c_mktsegment", F.lit('");\n'))),
        _when(_TRY, "    try { send(base); } catch (Exception e) { throw new RuntimeException(e); }\n"),
        F.lit("    return base * 2;\n  }\n}\n"),
    )
    return c.select(F.col("c_custkey").cast("string").alias("tree_id"), text.alias("text"), *c.columns)


#: Columns of the node table that the query language, candidates and ranges read.
ASKED = ("node_id", "parent_id", "role", "node_type", "dsl_type", "depth", "pre", "post", "name", "value", "props", "flags")
PAIRED = ("node_id", "parent_id", "role", "node_type", "name", "expr_type", "tokens")
RANGED = ("node_id", "node_type", "depth", "pre", "post")


def nodes_of(spark: SparkSession, d: str, columns: tuple[str, ...] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The node table of all classes, or some columns and types of node of it, written: queries over it read it several times."""
    return written(parsed(dealt(sources(spark, d).select("tree_id", "text"), "tree_id"), "java", "tree_id", "text", columns, kinds).drop("parse_error"), "java-nodes")


def ask(spark: SparkSession, d: str, text: str) -> DataFrame:
    return run(text, NodePlanner(nodes_of(spark, d, ASKED), JAVA), JAVA).select("tree_id", "name")


@query(f"""SELECT c_custkey::VARCHAR AS tree_id, ({_IF})::INT AS ifs, ({_LOOP})::INT AS loops, ({_TRY})::INT AS tries, ({_LOOP})::INT + ({_LOG})::INT + ({_TRY})::INT AS calls,
  1 + ({_IF})::INT AS returns, 1 AS methods, 0 AS opaque FROM customer""")
def java_parse_counts(spark, d):
    """What the front end makes of each class: statements, calls, methods, nothing it doesn't know."""
    n = lambda kind, name: F.count_if(F.col("node_type") == kind).cast("int").alias(name)
    kinds = (("IfStatement", "ifs"), ("ForStatement", "loops"), ("TryStatement", "tries"), ("MethodInvocation", "calls"), ("ReturnStatement", "returns"), ("MethodDeclaration", "methods"), ("Opaque", "opaque"))
    return nodes_of(spark, d).groupBy("tree_id").agg(*[n(*k) for k in kinds])


@query(f"""SELECT c_custkey::VARCHAR AS tree_id, 'check' AS name, 'int?check?int,String' AS signature, 3 AS first_line,
  6 + ({_IF})::INT + ({_LOOP})::INT + ({_LOG})::INT + ({_TRY})::INT AS last_line FROM customer""")
def java_methods(spark, d):
    """Methods by their signature, with their lines; every class has the wanted one."""
    own = methods(nodes_of(spark, d))
    wanted = sources(spark, d).select("tree_id", F.lit("int?check?int,String").alias("signature"))
    out = method_by_signature(own, wanted)
    signature = F.try_element_at("props", F.lit("signature"))
    return out.select("tree_id", "name", signature.alias("signature"), F.col("start_line").alias("first_line"), F.col("end_line").alias("last_line"))


@query(f"SELECT c_custkey::VARCHAR AS tree_id, 'check' AS name FROM customer WHERE {_IF} AND c_nationkey > 9 AND NOT ({_TRY})")
def java_dsl_roles(spark, d):
    """Role paths: methods with a guard that compares with two digits, and no try."""
    return ask(spark, d, 'functionDeclaration f where and(f.name == "check", f.body contain ifBlock i where and(i.condition.operator == ">", i.condition.rhs.value match "[0-9][0-9]"), not(f.body contain exceptionBlock e));')


@query(f"SELECT c_custkey::VARCHAR AS tree_id, 'check' AS name FROM customer WHERE {_STATIC} AND {_LOG} AND c_mktsegment = 'BUILDING'")
def java_dsl_flags(spark, d):
    """Modifier flags and collections: static methods that log a segment."""
    return ask(spark, d, """functionDeclaration f where and(f.isStatic, f.isPublic, f contain functionCall c where and(c.name == "log", c.arguments contain literal l where l.value match ".BUILDING."));""")


@query(f"SELECT c_custkey::VARCHAR AS tree_id, 'use' AS name FROM customer WHERE {_LOOP} UNION ALL SELECT c_custkey::VARCHAR, 'send' FROM customer WHERE {_TRY}")
def java_dsl_in(spark, d):
    """Calls inside a loop or a try."""
    return ask(spark, d, "functionCall c where or(c in forBlock b, c in exceptionBlock t);")


@query(f"SELECT c_custkey::VARCHAR AS tree_id, 'log' AS name FROM customer WHERE {_LOG}")
def java_dsl_not_in(spark, d):
    """Calls that stand in neither; the bare form names a type only."""
    return ask(spark, d, "functionCall c where and(c notIn forBlock, c notIn exceptionBlock);")


@query(f"SELECT c_custkey::VARCHAR AS tree_id, 'check' AS name FROM customer WHERE {_TRY} OR NOT ({_IF})")
def java_dsl_alias(spark, d):
    """An alias-only query under a collection, and a negated relation below or."""
    return ask(spark, d, 'functionDeclaration f where or(f.body contain alias_1 where and(alias_1 is throwStatement, alias_1.operand is objectCreationExpression), not(f contain binaryOperation b where b.operator == ">"));')


# scopes


@query(f"""SELECT c_custkey::VARCHAR AS tree_id, 'balance' AS name, 1 + ({_IF})::INT AS n, 'SingleVariableDeclaration' AS defined_by FROM customer
  UNION ALL SELECT c_custkey::VARCHAR, 'limit', 1, 'FieldDeclaration' FROM customer
  UNION ALL SELECT c_custkey::VARCHAR, 'base', 1 + ({_IF})::INT + 2 * ({_LOOP})::INT + ({_TRY})::INT, 'VariableDeclarationStatement' FROM customer
  UNION ALL SELECT c_custkey::VARCHAR, 'i', 3, 'VariableDeclarationExpression' FROM customer WHERE {_LOOP}
  UNION ALL SELECT c_custkey::VARCHAR, 'segment', 1, 'SingleVariableDeclaration' FROM customer WHERE {_LOG}
  UNION ALL SELECT c_custkey::VARCHAR, 'e', 1, 'SingleVariableDeclaration' FROM customer WHERE {_TRY}""")
def java_scopes(spark, d):
    """Uses of each name by the kind of definition that it means."""
    nodes = nodes_of(spark, d)
    kinds = nodes.select("tree_id", F.col("node_id").alias("def_id"), F.col("node_type").alias("defined_by"))
    found = scopes.resolved(nodes).join(shuffled(kinds), ["tree_id", "def_id"])
    return found.groupBy("tree_id", "name", "defined_by").agg(F.count("*").cast("int").alias("n"))


@query(f"SELECT c_custkey::VARCHAR AS tree_id, count(*) AS n FROM customer, (VALUES (1), (2), (3)) t(k) WHERE {_LOOP} GROUP BY 1")
def java_data_deps(spark, d):
    """Nodes that depend on a loop's counter: one step along data dependency edges from its declaration, without tree edges."""
    nodes = scopes.with_data_deps(nodes_of(spark, d))
    seeds = nodes.where("node_type = 'VariableDeclarationExpression'").select("tree_id", "node_id")
    bare = nodes.withColumn("parent_id", F.lit(None).cast("long"))
    return neighbourhood(bare, seeds, 1).where("hops = 1").groupBy("tree_id").agg(F.count("*").alias("n"))


@query(f"""SELECT c_custkey::VARCHAR AS tree_id, 'ForStatement' AS statement_type, 10 AS n FROM customer WHERE {_LOOP}
  UNION ALL SELECT c_custkey::VARCHAR, 'IfStatement', 5 FROM customer WHERE {_IF}""")
def java_by_statement(spark, d):
    """Nodes by the innermost statement around them: those of a loop's head and block, and of a guard's."""
    found = scopes.by_statement(nodes_of(spark, d, RANGED)).where("statement_type IN ('ForStatement', 'IfStatement')")
    return found.select("tree_id", "statement_type", F.size("node_ids").alias("n"))


# edits

_UPDATE = "c_nationkey > 12"
_INSERT = "c_mktsegment = 'BUILDING'"
_DELETE = f"({_LOG}) AND c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING'"
_WRAP = f"({_LOOP}) AND c_custkey % 7 = 0"


def changes(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, before, after): the factor of the last line grows, an audit is added before it, the log goes, the loop is guarded."""
    s = sources(spark, d)
    after = F.when(F.expr(_UPDATE), F.replace(F.col("text"), F.lit("base * 2"), F.lit("base * 3"))).otherwise(F.col("text"))
    after = F.when(F.expr(_INSERT), F.replace(after, F.lit("    return base *"), F.lit("    audit(base, 1);\n    return base *"))).otherwise(after)
    after = F.when(F.expr(_DELETE), F.regexp_replace(after, r"    log\([^\n]*\n", "")).otherwise(after)
    after = F.when(F.expr(_WRAP), F.regexp_replace(after, r"(    for [^\n]*)\n", "    while (ready) {\n$1\n    }\n")).otherwise(after)
    return s.select(F.col("tree_id").alias("case_id"), F.col("text").alias("before"), after.alias("after"), *[c for c in s.columns if c.startswith("c_")])


@query(f"""SELECT c_custkey::VARCHAR AS case_id, ({_INSERT})::INT + ({_WRAP})::INT * 3 AS "insert", ({_DELETE})::INT AS "delete", ({_UPDATE})::INT AS "update", ({_WRAP})::INT AS "move",
  ({_INSERT})::INT + ({_WRAP})::INT * 4 + ({_DELETE})::INT + ({_UPDATE})::INT AS total_edits FROM customer WHERE {_INSERT} OR {_WRAP} OR {_DELETE} OR {_UPDATE}""")
def java_edit_counts(spark, d):
    """Edits between the two versions of each class; whole subtrees count once, a wrapped loop moves."""
    found = treediff.edit_counts(treediff.edit_scripts(dealt(changes(spark, d), "case_id"), parse_unit, whole=True))
    return found.select("case_id", *[F.col(c).cast("int").alias(c) for c in ("insert", "delete", "update", "move", "total_edits")])


@query(f"""SELECT c_custkey::VARCHAR AS case_id, 'update' AS kind, 'NumberLiteral' AS node_type, '3' AS value, NULL::INT AS pos FROM customer WHERE {_UPDATE}
  UNION ALL SELECT c_custkey::VARCHAR, 'tree-insert', 'ExpressionStatement', '', 1 + ({_IF})::INT + ({_LOOP})::INT + ({_LOG})::INT + ({_TRY})::INT + ({_WRAP})::INT FROM customer WHERE {_INSERT}""")
def java_edit_places(spark, d):
    """Where statements are inserted and what literals become: positions count among the statements as they are by then (a wrapped loop moves later)."""
    pairs = dealt(changes(spark, d), "case_id")
    found = treediff.edit_scripts(pairs, parse_unit, whole=True).where("kind = 'update' OR (kind = 'tree-insert' AND node_type = 'ExpressionStatement')")
    return found.select("case_id", "kind", "node_type", "value", F.when(F.col("kind") != "update", F.col("pos")).alias("pos"))


@query(f"""SELECT m AS mode, sum(CASE WHEN m = 'moves' THEN 1 ELSE 0 END)::BIGINT AS moved, sum(CASE WHEN m = 'moves' THEN 0 ELSE 1 END)::BIGINT AS deleted
  FROM customer, (VALUES ('moves'), ('no moves')) t(m) WHERE {_WRAP} AND NOT ({_DELETE}) GROUP BY 1""")
def java_edit_modes(spark, d):
    """A wrapped loop in either mode: one move, or a deleted loop and one inserted."""
    pairs = dealt(changes(spark, d).where(f"({_WRAP}) AND NOT ({_DELETE})").select("case_id", "before", "after"), "case_id")
    out = None
    for mode in ("moves", "no moves"):
        edits = treediff.edit_scripts(pairs, parse_unit, moves=mode == "moves", whole=True)
        n = edits.agg(F.count_if(F.col("kind") == "move").alias("moved"), F.count_if(F.col("kind").endswith("delete")).alias("deleted"))
        n = n.select(F.lit(mode).alias("mode"), "moved", "deleted")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"""SELECT c_custkey::VARCHAR AS case_id, 'insert' AS kind, 'MethodInvocation' AS node_type FROM customer WHERE {_INSERT}""")
def java_not_logic(spark, d):
    """What an inserted audit asks not to be there yet: the call, not the statement around it; a while that a loop moves into is left out."""
    pairs = dealt(changes(spark, d).select("case_id", "before", "after"), "case_id")
    edits = treediff.edit_scripts(pairs, parse_unit).withColumnRenamed("case_id", "tree_id")
    found = patterns.not_logic(edits, nodes_of(spark, d)).where("node_type = 'MethodInvocation'")
    return found.select(F.col("tree_id").alias("case_id"), "kind", "node_type")


# Nodes of a log statement and of a class, as the front end makes them.
_LOG_NODES = 4
_CLASS_NODES = f"21 + ({_IF})::INT * 7 + ({_LOOP})::INT * 14 + ({_LOG})::INT * {_LOG_NODES} + ({_TRY})::INT * 13"


@query(f"""SELECT c_custkey::VARCHAR AS case_id, ({_CLASS_NODES}) - ({_DELETE})::INT * {_LOG_NODES} AS kept, ({_DELETE})::INT * {_LOG_NODES} AS gone,
  ({_INSERT})::INT * 4 + ({_WRAP})::INT * 3 AS made FROM customer""")
def java_mapping(spark, d):
    """The bijection between the two versions of each class as a table: nodes that stay, that go, and that the script makes."""
    edits, mapping = treediff.edits_and_mapping(dealt(changes(spark, d), "case_id"), parse_unit)
    n = lambda df, what, name: df.groupBy("case_id").agg(F.count_if(what).cast("int").alias(name))
    pairs = mapping.groupBy("case_id").agg(F.count_if(F.col("before_id") >= 0).cast("int").alias("kept"), F.count_if(F.col("before_id") < 0).cast("int").alias("made"))
    out = pairs.join(shuffled(n(edits, F.col("kind") == "delete", "gone")), "case_id", "left")
    return out.select("case_id", "kept", F.coalesce("gone", F.lit(0)).alias("gone"), "made")


@query(f"""SELECT c_custkey::VARCHAR AS case_id, named, place_type, n FROM customer, (VALUES ('before', 1, 1), ('before', 3, 3), ('after', 2, 1), ('after', 3, 3)) t(named, place_type, n)
  WHERE ({_INSERT}) <> ({_WRAP})""")
def java_place_types(spark, d):
    """Where inserts and moves go in a target (here the class itself): at a node of the before tree (1), by the after tree's node over the mapping (2), below a new node (3)."""
    pairs = changes(spark, d).where(f"(({_INSERT}) <> ({_WRAP}))").select("case_id", "before", "after")
    edits, mapping = treediff.edits_and_mapping(dealt(pairs, "case_id"), parse_unit)
    edits = edits.where("kind IN ('insert', 'move')").withColumnRenamed("case_id", "tree_id")
    mapping = mapping.withColumnRenamed("case_id", "tree_id")
    same = nodes_of(spark, d).select("tree_id", F.col("node_id").alias("p_node"), F.col("node_id").alias("t_node"))
    out = None
    for named, parent in (("before", "parent_id"), ("after", "after_parent_id")):
        ops = edits.select("tree_id", "kind", F.col(parent).alias("parent_id"))
        # keys of the two trees are numbers alike, so operations named by after nodes bind through the mapping only
        placed = patterns.edit_places(ops, mapping, same, named=named)
        n = placed.groupBy(F.col("tree_id").alias("case_id"), F.lit(named).alias("named"), "place_type").agg(F.count("*").cast("int").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query(f"""SELECT c_custkey::VARCHAR AS case_id, ({_UPDATE})::INT + ({_DELETE})::INT * {_LOG_NODES} + (({_INSERT}) OR ({_WRAP}))::INT + ({_WRAP})::INT AS n FROM customer
  WHERE {_UPDATE} OR {_DELETE} OR {_INSERT} OR {_WRAP}""")
def java_action_related(spark, d):
    """Nodes of the before tree that edits touch: what is updated, deleted or moved, and where inserts and moves go."""
    edits, mapping = treediff.edits_and_mapping(dealt(changes(spark, d), "case_id"), parse_unit)
    ops = edits.select(F.col("case_id").alias("tree_id"), "kind", "node_id", F.col("after_parent_id").alias("parent_id"))
    found = patterns.action_related(ops, mapping.withColumnRenamed("case_id", "tree_id"))
    return found.groupBy(F.col("tree_id").alias("case_id")).agg(F.count("*").cast("int").alias("n"))


# Names in expressions: of `base = balance + limit` and `base * 2`, and of the parts.
_NAMES = f"(3 + ({_IF})::INT * 2 + ({_LOOP})::INT * 5 + ({_LOG})::INT + ({_TRY})::INT * 2)"


# patterns

_BEFORE = 'class P { private int limit = 1; public int check(int balance, String segment) { int base = balance + limit; log(segment, "BUILDING"); return base * 2; } }'
_AFTER = 'class P { private int limit = 1; public int check(int balance, String segment) { int base = balance + limit; log(segment, "BUILDING"); audit(base); return base * 2; } }'


def pattern_table(spark: SparkSession, text: str, wanted, counts: tuple[str, ...]) -> DataFrame:
    """Considered nodes of a pattern with the attributes that count."""
    order = list(preorder(parse_unit(text)))
    number = {id(n): i for i, (n, _) in enumerate(order)}
    rows = [("p", i, number.get(id(p)), n.node_type, n.name, n.expr_type, list(n.own_tokens), n.role) for i, (n, p) in enumerate(order) if wanted(n, p)]
    made = spark.createDataFrame(rows, "pattern_id string, node_id long, parent_id long, node_type string, name string, expr_type string, tokens array<string>, role string")
    flags = [x for a in patterns.REGISTRY for x in (F.lit(a), F.lit(a in counts))]
    return made.withColumn("considered_attrs", F.create_map(*flags))


def _calls(n: Node, _) -> bool:
    return n.node_type == "MethodInvocation"


def _method_and_call(n: Node, p: Node | None) -> bool:
    return n.node_type in ("MethodInvocation", "ExpressionStatement", "Block") and (n.node_type != "Block" or p.node_type == "MethodDeclaration")


@query(f"SELECT 'p' AS pattern_id, c_custkey::VARCHAR AS tree_id, round(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.5 + 0.5 * 5 / 6 END, 9)::DOUBLE AS score FROM customer WHERE {_LOG}")
def java_candidates(spark, d):
    """Calls by the pattern's name, scored by type and by the tokens they have in common."""
    pairs = patterns.candidates(pattern_table(spark, _BEFORE, _calls, ("location", "name", "type", "token")), nodes_of(spark, d, PAIRED))
    return pairs.select("pattern_id", "tree_id", F.round("score", 9).alias("score"))


@query(f"""SELECT c_custkey::VARCHAR AS tree_id, 2 * ({_LOOP})::INT + ({_LOG})::INT + 2 * ({_TRY})::INT AS by_slot, {_NAMES} AS by_root FROM customer WHERE {_LOOP} OR {_LOG} OR {_TRY}""")
def java_slots(spark, d):
    """Names that may stand where the pattern's argument stands: those that are arguments; the location that only knows roots takes every name."""
    made = pattern_table(spark, _BEFORE, lambda n, p: n.node_type == "SimpleName" and n.role == "arguments" and n.name == "segment", ("location", "type"))
    names = nodes_of(spark, d, PAIRED).where("node_type = 'SimpleName'")
    n = lambda registry, name: patterns.candidates(made, names, registry=registry).groupBy("tree_id").agg(F.count("*").cast("int").alias(name))
    return n(patterns.by_slot(), "by_slot").join(shuffled(n(None, "by_root")), "tree_id")


@query(f"SELECT 'p' AS pattern_id, c_custkey::VARCHAR AS tree_id FROM customer WHERE {_LOG}")
def java_detect(spark, d):
    """Classes in which the pattern's block, statement and call are found together, each under its own parent."""
    made = pattern_table(spark, _BEFORE, _method_and_call, ("location", "name", "type"))
    nodes = nodes_of(spark, d, PAIRED)
    pairs = patterns.candidates(made, nodes.where("node_type IN ('Block', 'ExpressionStatement', 'MethodInvocation')"))
    return patterns.detect(patterns.match_instances(pairs, made))


@query(f"SELECT c_custkey::VARCHAR AS tree_id, 1 + ({_TRY})::INT + ({_LOOP})::INT AS n_options, 1 AS ranked FROM customer WHERE {_LOG}")
def java_candidate_order(spark, d):
    """Candidates of the pattern's statement: the log's own statement is the best of all statements with a call."""
    made = pattern_table(spark, _BEFORE, lambda n, p: n.node_type == "ExpressionStatement", ("type", "token"))
    nodes = nodes_of(spark, d, PAIRED).where("node_type = 'ExpressionStatement'")
    ranked = patterns.ordered_candidates(patterns.candidates(made, nodes))
    logs = nodes.where("tokens[0] = 'log'").select("tree_id", F.col("node_id").alias("t_node"))
    return ranked.join(shuffled(logs), ["tree_id", "t_node"]).select("tree_id", F.col("n").cast("int").alias("n_options"), F.col("rank").cast("int").alias("ranked"))


_PATCHED = """'class C' || c_custkey || ' { private int limit = ' || c_nationkey || ' ; public ' || CASE WHEN c_nationkey > 12 THEN 'static ' ELSE '' END ||
  'int check ( int balance , String segment ) { int base = balance + limit ; ' || CASE WHEN c_acctbal >= 0 THEN 'if ( balance > ' || c_nationkey || ' ) { return base ; } ' ELSE '' END ||
  CASE WHEN c_nationkey % 3 = 0 THEN 'for ( int i = 0 ; i < base ; i ++ ) { use ( i , base ) ; } ' ELSE '' END || 'log ( segment , "' || c_mktsegment || '" ) ; audit ( base ) ; ' ||
  CASE WHEN c_custkey % 2 = 0 THEN 'try { send ( base ) ; } catch ( Exception e ) { throw new RuntimeException ( e ) ; } ' ELSE '' END || 'return base * 2 ; } }'"""


@query(f"SELECT c_custkey::VARCHAR AS tree_id, {_PATCHED} AS patched, 0 AS skipped FROM customer WHERE {_LOG}")
def java_patch(spark, d):
    """The pattern's change applied to every class it matches, printed: an audit right after the log, wherever that stands."""
    texts = sources(spark, d).select("tree_id", "text")
    made = pattern_table(spark, _BEFORE, _method_and_call, ("location", "name", "type", "token"))
    found = patterns.candidates(made, nodes_of(spark, d, PAIRED, ("Block", "ExpressionStatement", "MethodInvocation")))
    first = patterns.match_instances(found, made, cap=1)  # the first instance is the one that is patched
    out = patch.patched(texts, first, {"p": (_BEFORE, _AFTER)}, parse_unit, strategy="sibling")
    return out.select("tree_id", "patched", "skipped")


# Where the log goes into the loop before it.
_MOVE = f"({_LOOP}) AND ({_LOG}) AND c_custkey % 4 = 0"


def moved_logs(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, before, after): classes whose log moves to the end of the loop before it."""
    s = sources(spark, d)
    after = F.when(F.expr(_MOVE), F.regexp_replace("text", r"(\{ use\(i, base\);) \}\n    (log\([^\n]*\);)\n", "$1 $2 }\n")).otherwise(F.col("text"))
    return s.select(F.col("tree_id").alias("case_id"), F.col("text").alias("before"), after.alias("after"))


@query(f"SELECT c_custkey::VARCHAR AS case_id, 'move' AS kind, 'ExpressionStatement' AS node_type, 'ForStatement' AS into_type FROM customer WHERE {_MOVE}")
def java_not_logic_moves(spark, d):
    """What a move into a structure node asks not to be there yet: the statement, below the loop whose block it goes to."""
    edits = treediff.edit_scripts(dealt(moved_logs(spark, d), "case_id"), parse_unit).withColumnRenamed("case_id", "tree_id")
    nodes = nodes_of(spark, d)
    found = patterns.not_logic(edits, nodes)
    into = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("into_type"))
    return found.join(shuffled(into), ["tree_id", "parent_id"]).select(F.col("tree_id").alias("case_id"), "kind", "node_type", "into_type")


@query(f"SELECT c_custkey::VARCHAR AS tree_id, 'check' AS name FROM customer WHERE {_LOG} AND NOT ({_MOVE})")
def java_generated_not_in(spark, d):
    """The query generated from a pattern that moves a call into a loop finds the classes where it hasn't been moved yet."""
    unit = parse_unit('class P { int check(int balance, String segment) { for (int i = 0; i < 3; i++) { use(i, 3); } log(segment, "BUILDING"); return 1; } }')
    method = next(n for n, _ in preorder(unit) if n.node_type == "MethodDeclaration")
    order = [n for n, _ in preorder(method)]
    call = next(i for i, n in enumerate(order) if n.node_type == "MethodInvocation" and n.name == "log")
    loop = next(i for i, n in enumerate(order) if n.node_type == "ForStatement")
    texts = moved_logs(spark, d).select(F.col("case_id").alias("tree_id"), F.col("after").alias("text"))
    nodes = written(parsed(dealt(texts, "tree_id"), "java", "tree_id", "text", ASKED).drop("parse_error"), "java-nodes")
    return run(generate.generate_text(method, {call}, moved=[(call, loop)]), NodePlanner(nodes, JAVA), JAVA).select("tree_id", "name")


@query(f"""WITH n AS (SELECT c_custkey::VARCHAR AS tree_id, {_NAMES} AS n FROM customer)
  SELECT tree_id, least({patterns.MAX_INSTANCES}, n * (n - 1) * (n - 2))::INT AS instances, least({patterns.USED_INSTANCES}, n * (n - 1) * (n - 2))::INT AS used, n AS options FROM n""")
def java_instances(spark, d):
    """Three names of a pattern fit any names of a class, each once: all assignments up to the cap, of which the first few are used."""
    picked = [i for i, (n, _) in enumerate(preorder(parse_unit(_BEFORE))) if n.node_type == "SimpleName"][:3]
    made = pattern_table(spark, _BEFORE, lambda n, p: n.node_type == "SimpleName", ("type",)).where(F.col("node_id").isin(picked))
    names = nodes_of(spark, d, PAIRED).where("node_type = 'SimpleName'")
    found = patterns.match_instances(patterns.candidates(made, names), made)
    each = found.select("tree_id", "instance").distinct().groupBy("tree_id").agg(
        F.count("*").cast("int").alias("instances"), F.count_if(F.col("instance") < patterns.USED_INSTANCES).cast("int").alias("used")
    )
    return each.join(shuffled(names.groupBy("tree_id").agg(F.count("*").cast("int").alias("options"))), "tree_id")


def _text_sql(log: str, factor: str = "2", early: str = "''") -> str:
    """A class as the printer writes it, with something else for the log, and early behind the declaration."""
    return f"""'class C' || c_custkey || ' {{ private int limit = ' || c_nationkey || ' ; public ' || CASE WHEN {_STATIC} THEN 'static ' ELSE '' END ||
  'int check ( int balance , String segment ) {{ int base = balance + limit ; ' || {early} || CASE WHEN {_IF} THEN 'if ( balance > ' || c_nationkey || ' ) {{ return base ; }} ' ELSE '' END ||
  CASE WHEN {_LOOP} THEN 'for ( int i = 0 ; i < base ; i ++ ) {{ use ( i , base ) ; }} ' ELSE '' END || {log} ||
  CASE WHEN {_TRY} THEN 'try {{ send ( base ) ; }} catch ( Exception e ) {{ throw new RuntimeException ( e ) ; }} ' ELSE '' END || 'return base * {factor} ; }} }}'"""


_LOG_TEXT = "'log ( segment , \"' || c_mktsegment || '\" ) ; '"
_P_HEAD = "class P { private int limit = 1; public int check(int balance, String segment) { int "
# of equal candidates the first one counts: where the limit is the same literal, that is the limit's
_UPDATED = f"CASE WHEN c_nationkey = 2 THEN replace({_text_sql(_LOG_TEXT)}, 'limit = 2 ;', 'limit = 3 ;') ELSE {_text_sql(_LOG_TEXT, '3')} END"
#: Changes by name: before, after, and the printed class.
_CHANGES = {
    "delete": (_P_HEAD + 'base = balance + limit; log(segment, "BUILDING"); return base * 2; } }', _P_HEAD + "base = balance + limit; return base * 2; } }", _text_sql("''")),
    "update": (_P_HEAD + 'base = balance + limit; log(segment, "BUILDING"); return base * 2; } }', _P_HEAD + 'base = balance + limit; log(segment, "BUILDING"); return base * 3; } }', _UPDATED),
    "move": (
        _P_HEAD + 'base = balance + limit; log(segment, "BUILDING"); return base * 2; } }', _P_HEAD + 'base = balance + limit; while (ready) { log(segment, "BUILDING"); } return base * 2; } }',
        _text_sql("''", early=f"'while ( ready ) {{ ' || {_LOG_TEXT} || '}} '"),  # the new statement goes behind what stands before it in the pattern
    ),
    "rename": (
        _P_HEAD + 'sum = balance + limit; log(segment, "BUILDING"); return sum * 2; } }', _P_HEAD + 'sum = balance + limit; log(segment, "BUILDING"); audit(sum, 1); return sum * 2; } }',
        _text_sql(f"{_LOG_TEXT} || 'audit ( base , 1 ) ; '"),
    ),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS pattern_id, c_custkey::VARCHAR AS tree_id, {text} AS patched FROM customer WHERE {_LOG}" for name, (_, _, text) in _CHANGES.items()))
def java_patch_kinds(spark, d):
    """Patterns that delete, update, move and use another variable's name, applied to every class with their log, and printed."""
    texts = sources(spark, d).select("tree_id", "text")
    block = lambda n, p: n.node_type == "Block" and _method_and_call(n, p)
    call = lambda n, p: n.node_type != "Block" and _method_and_call(n, p)
    sums = lambda n, p: n.node_type in ("ReturnStatement", "InfixExpression", "NumberLiteral") and n.label != "1"
    declared = lambda n, p: n.node_type == "VariableDeclarationStatement"
    made = None
    for name, (before, _, _) in _CHANGES.items():
        # a short block may hold more of the pattern's tokens than the method's own, so tokens don't count there
        part = pattern_table(spark, before, block, ("location", "type")).unionByName(pattern_table(spark, before, call, ("location", "name", "type", "token")))
        if name == "update":
            part = part.unionByName(pattern_table(spark, before, sums, ("location", "type", "token")))
        if name == "rename":
            part = part.unionByName(pattern_table(spark, before, declared, ("location", "type")))
        part = part.withColumn("pattern_id", F.lit(name))
        made = part if made is None else made.unionByName(part)
    kinds = ("Block", "ExpressionStatement", "MethodInvocation", "ReturnStatement", "InfixExpression", "NumberLiteral", "VariableDeclarationStatement")
    made = written(made, "patterns")
    found = patterns.candidates(made, nodes_of(spark, d, PAIRED, kinds))
    first = patterns.match_instances(found, made, cap=1)  # the first instance is the one that is patched
    return patch.patched(texts, first, {k: v[:2] for k, v in _CHANGES.items()}, parse_unit, strategy="sibling").select("pattern_id", "tree_id", "patched")


@query(f"SELECT c_custkey::VARCHAR AS tree_id, '{{\"detected\":' || CASE WHEN {_LOG} THEN 'true' ELSE 'false' END || ',\"results\":[' || CASE WHEN {_LOG} THEN '{{\"file\":\"C' || c_custkey || '.java\",\"signature\":\"int?check?int,String\"}}' ELSE '' END || ']}}' AS json FROM customer")
def java_detection_json(spark, d):
    """Parse, match, detect, and what is written of it: one JSON object a class."""
    made = pattern_table(spark, _BEFORE, _method_and_call, ("location", "name", "type"))
    nodes = nodes_of(spark, d)
    pairs = patterns.candidates(made, nodes.where("node_type IN ('Block', 'ExpressionStatement', 'MethodInvocation')"))
    found = patterns.detect(patterns.match_instances(pairs, made)).select("tree_id", F.lit(True).alias("hit"))
    signature = methods(nodes).select("tree_id", F.try_element_at("props", F.lit("signature")).alias("signature"))
    rows = signature.join(shuffled(found), "tree_id", "left")
    file = F.when(F.col("hit"), F.concat(F.lit("C"), "tree_id", F.lit(".java")))
    return sinks.detection_json(rows.select("tree_id", file.alias("file"), F.when(F.col("hit"), F.col("signature")).alias("signature")), ["tree_id"])


@query(f"SELECT c_custkey::VARCHAR AS tree_id, {_CLASS_NODES} AS n, 1 AS roots FROM customer")
def java_node_json(spark, d):
    """A class's nodes as a JSON list, read back."""
    lists = sinks.node_json(nodes_of(spark, d))
    back = lists.select("tree_id", F.explode(F.from_json("json", "array<struct<id:long,parent_id:long,type:string,leaf:boolean>>")).alias("x"))
    return back.groupBy("tree_id").agg(F.count_if(F.col("x.type").isNotNull()).cast("int").alias("n"), F.count_if(F.col("x.parent_id").isNull()).cast("int").alias("roots"))


@query(f"SELECT c_custkey::VARCHAR AS tree_id, 'check' AS name FROM customer WHERE {_LOG} AND c_mktsegment = 'BUILDING' AND NOT ({_TRY})")
def java_generated_query(spark, d):
    """The query generated from a pattern (a call with its literal, and no call of `send` yet) finds the classes it describes."""
    unit = parse_unit(_BEFORE)
    method = next(n for n, _ in preorder(unit) if n.node_type == "MethodDeclaration")
    order = [n for n, _ in preorder(method)]
    considered = {i for i, n in enumerate(order) if n.node_type in ("MethodInvocation", "StringLiteral")}
    body = next(i for i, n in enumerate(order) if n.node_type == "Block")
    send = Node("MethodInvocation", dsl_type="functionCall", name="send")
    return ask(spark, d, generate.generate_text(method, considered, inserted=[(body, send)]))


@query(f"""SELECT c_custkey::VARCHAR AS tree_id, ({_LOG})::INT + ({_TRY})::INT AS rare_calls, ({_LOOP})::INT AS usual_calls FROM customer WHERE {_LOG} OR {_TRY} OR {_LOOP}""")
def java_consider(spark, d):
    """Called names that a frequency table calls rare, by class; `use` is known to be usual."""
    nodes = nodes_of(spark, d, ("node_id", "node_type", "name", "expr_type"))
    frequencies = written(spark.createDataFrame([("api", "use", 1_000_000), ("api", "log", 5)], "kind string, token string, cnt int"), "frequencies")  # so that its size is known
    near = nodes.select("tree_id", "node_id").limit(0)
    calls = patterns.abstracted("frequency", nodes, frequencies=frequencies, near=near).where("node_type = 'MethodInvocation'")
    is_rare = F.element_at("considered_attrs", F.lit("name"))
    return calls.groupBy("tree_id").agg(F.count_if(is_rare).cast("int").alias("rare_calls"), F.count_if(~is_rare).cast("int").alias("usual_calls"))


@query(f"SELECT c_custkey::VARCHAR AS tree_id, 'VariableDeclarationStatement' AS node_type FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'IfStatement' FROM customer WHERE {_IF}")
def java_important_lines(spark, d):
    """Statements that an important line touches or lies next to."""
    nodes = nodes_of(spark, d).where("role = 'statements' AND depth = 4")
    near = patterns.in_important_lines(nodes.where("start_line <= 5"), F.array(F.lit(4)))
    return near.where("node_type IN ('VariableDeclarationStatement', 'IfStatement')").select("tree_id", "node_type")


@query("SELECT c_custkey::VARCHAR AS tree_id, 'int' AS ret, 'check' AS name, 'int,Map<String,List<Integer>>' AS args FROM customer")
def java_signatures(spark, d):
    """Headers taken apart: return type, name and argument types, generics whole."""
    header = F.concat(F.lit("public int check(final int a"), F.col("tree_id"), F.lit(", Map<String,List<Integer>> b)"))
    s = sources(spark, d).select("tree_id", C.signature_struct(header).alias("s"))
    return s.select("tree_id", "s.ret", "s.name", F.array_join("s.args", ",").alias("args"))
