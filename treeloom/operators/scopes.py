"""Identifiers of code trees: what is defined where, what a name means, which nodes depend on which definition.

All are joins and column expressions over the node table. A subtree's last node has the pre-order rank post + depth, so that a scope is
a range of ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators.patterns import identifier_definitions
from treeloom.plans.structural import innermost, last_below
from treeloom.sources.work import shuffled

# Nodes that define a variable.
LOCAL = ("SingleVariableDeclaration", "VariableDeclarationFragment", "VariableDeclarationStatement", "VariableDeclarationExpression")
GLOBAL = ("FieldDeclaration",)
USES = ("SimpleName",)


def definitions(nodes: DataFrame) -> DataFrame:
    """(tree_id, name, def_id, scope_start, scope_end, is_global, type) of variables, parameters and fields.

    A local one holds from its declaration to the end of the node around it, a parameter in all of it, a field in the whole tree.
    """
    own = nodes.where(F.col("node_type").isin(*LOCAL, *GLOBAL) & F.col("name").isNotNull())
    # a fragment belongs to a declaration, whose scope and type it has
    own = own.withColumn("_of", F.when(F.col("node_type") == "VariableDeclarationFragment", F.col("parent_id")).otherwise(F.col("node_id")))
    above = nodes.select("tree_id", F.col("node_id").alias("_of"), F.col("parent_id").alias("_above"))
    around = F.when(F.col("node_type") == "VariableDeclarationFragment", F.col("_above")).otherwise(F.col("parent_id"))
    own = own.join(shuffled(above), ["tree_id", "_of"], "left").withColumn("parent_id", around)
    up = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("pre").alias("_from"), last_below().alias("_to"))
    kind = nodes.where("role = 'type'").select("tree_id", F.col("parent_id").alias("_of"), F.col("label").alias("type")).groupBy("tree_id", "_of").agg(F.first("type").alias("type"))
    is_global, is_parameter = F.col("node_type").isin(*GLOBAL), F.col("node_type") == "SingleVariableDeclaration"
    found = own.join(shuffled(up), ["tree_id", "parent_id"]).join(shuffled(kind), ["tree_id", "_of"], "left")
    return found.select(
        "tree_id", "name", F.col("node_id").alias("def_id"),
        F.when(is_global, F.lit(0).cast("long")).when(is_parameter, F.col("_from")).otherwise(F.col("pre")).alias("scope_start"),
        F.when(is_global, F.lit((1 << 62))).otherwise(F.col("_to")).alias("scope_end"), is_global.alias("is_global"), "type",
    )


def uses(nodes: DataFrame) -> DataFrame:
    """(tree_id, name, use_id, start, end) of names in expressions."""
    return nodes.where(F.col("node_type").isin(*USES)).select("tree_id", "name", F.col("node_id").alias("use_id"), F.col("pre").alias("start"), F.col("pre").alias("end"))


def resolved(nodes: DataFrame) -> DataFrame:
    """Each use with the definition (def_id) it means, or null."""
    return identifier_definitions(uses(nodes), definitions(nodes).drop("type"))


def with_data_deps(nodes: DataFrame) -> DataFrame:
    """nodes with data_dep_id: the definition that a name means."""
    found = resolved(nodes).where("def_id IS NOT NULL").select("tree_id", F.col("use_id").alias("node_id"), F.col("def_id").alias("_dep"))
    return nodes.join(shuffled(found), ["tree_id", "node_id"], "left").withColumn("data_dep_id", F.col("_dep")).select(*nodes.columns)


def renames(pattern: DataFrame, target: DataFrame, binding: DataFrame) -> DataFrame:
    """(pattern_id, tree_id, name, new_name, scope_start, scope_end): the target's names for a pattern's local variables.

    pattern: nodes whose tree_id is the pattern's; binding: (pattern_id, tree_id, p_node, t_node). Where a name is used it has the
    new one only if the target's scope holds the place.
    """
    own = definitions(pattern).where("NOT is_global").select(F.col("tree_id").alias("pattern_id"), F.col("def_id").alias("p_node"), "name")
    other = definitions(target).where("NOT is_global").select("tree_id", F.col("def_id").alias("t_node"), F.col("name").alias("new_name"), "scope_start", "scope_end")
    found = binding.join(own, ["pattern_id", "p_node"]).join(other, ["tree_id", "t_node"])
    return found.select("pattern_id", "tree_id", "name", "new_name", "scope_start", "scope_end").distinct()


def by_statement(nodes: DataFrame) -> DataFrame:
    """(tree_id, statement_id, statement_type, node_ids): the nodes below each statement or method, by the innermost one around them."""
    is_statement = F.col("node_type").endswith("Statement") | F.col("node_type").isin("MethodDeclaration", "CatchClause", "SwitchCase", "ConstructorInvocation", "SuperConstructorInvocation")
    heads = nodes.where(is_statement).select("tree_id", F.col("node_id").alias("statement_id"), F.col("node_type").alias("statement_type"))
    ranges = nodes.where(is_statement).select("tree_id", F.col("node_id").alias("range_id"), F.col("pre").alias("start"), last_below().alias("end"))
    inner = innermost(nodes.select("tree_id", F.col("node_id").alias("point_id"), F.col("pre").alias("at")), ranges, ["tree_id"])
    inner = inner.select("tree_id", F.col("point_id").alias("node_id"), F.col("range_id").alias("statement_id")).join(shuffled(heads), ["tree_id", "statement_id"])
    return inner.groupBy("tree_id", "statement_id", "statement_type").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids"))
