"""Patterns: attributes of nodes, which of them count, similarity candidates, assignment search, detection.

Hard attributes (name, expression type, slot) are conditions of an equi-join wherever they name a value; soft ones (type, tokens)
make a weighted score. The search for one-to-one assignments is exponential in the worst case and capped by contract.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from treeloom.functions.columns import UNKNOWN_TYPE, class_equal, name_equal, slot_fits, type_equal
from treeloom.functions.sequences import lcs_dice_udf, substring_dice_udf
from treeloom.plans.structural import innermost, inside
from treeloom.sources.work import shuffled, written

# Fixed values of the matcher and of the frequency abstraction.
SCORE_THRESHOLD = 0.2
MAX_INSTANCES = 101
USED_INSTANCES = 5
CORPUS_FILES = 1_217_392
RARE_SHARE = 0.005
MAX_NOT_LOGIC = 10
STRUCTURE_TYPES = (
    "IfStatement", "ForStatement", "EnhancedForStatement", "WhileStatement", "DoStatement", "SwitchStatement", "SynchronizedStatement", "TryStatement", "CatchClause",
    "LambdaExpression",
)


@dataclass(frozen=True)
class Attribute:
    """similarity(pattern column prefix, target column prefix) -> Column; hard: a zero rules the pair out."""

    name: str
    weight: float
    hard: bool
    similarity: Callable[[str, str], Column]


REGISTRY: dict[str, Attribute] = {}


def _counts(attribute: str) -> Column:
    """Whether an attribute of a pattern node counts."""
    return F.coalesce(F.try_element_at("considered_attrs", F.lit(attribute)), F.lit(False))


def register(name: str, weight: float, hard: bool, similarity: Callable[[str, str], Column]) -> None:
    REGISTRY[name] = Attribute(name, weight, hard, similarity)


register("location", 1.0, True, lambda p, t: (F.col(f"{p}parent_id").isNull() == F.col(f"{t}parent_id").isNull()).cast("double"))
register("name", 1.0, True, lambda p, t: F.coalesce(name_equal(F.col(f"{p}name"), F.col(f"{t}name")), F.lit(1.0)))
register("exprType", 1.0, True, lambda p, t: type_equal(F.coalesce(f"{p}expr_type", F.lit(UNKNOWN_TYPE)), F.coalesce(f"{t}expr_type", F.lit(UNKNOWN_TYPE))))
register("type", 0.5, False, lambda p, t: class_equal(F.col(f"{p}node_type"), F.col(f"{t}node_type")).cast("double"))
register("token", 0.5, False, lambda p, t: lcs_dice_udf(*(F.when(_counts("token"), F.col(f"{x}tokens")) for x in (p, t))))  # Spark asks Python for all rows


def by_slot() -> dict[str, Attribute]:
    """The attributes with the location that is meant: a node may stand where its role is, or both are roots. The registered one only tells roots from others."""
    fits = lambda p, t: slot_fits(F.col(f"{p}role"), F.col(f"{t}role"), F.col(f"{p}parent_id"), F.col(f"{t}parent_id")).cast("double")
    return REGISTRY | {"location": Attribute("location", REGISTRY["location"].weight, True, fits)}


def attributes(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, location, type, name, expr_type, tokens): the five values of every node."""
    return nodes.select("tree_id", "node_id", F.col("role").alias("location"), F.col("node_type").alias("type"), "name", "expr_type", "tokens")


def is_rare(cnt: Column, files: int, share: float = RARE_SHARE) -> Column:
    """Whether a token that is in cnt of the files is in under a share of them; an unknown one counts once."""
    return F.coalesce(cnt, F.lit(1)) / F.lit(files) < share


def rare(tokens: DataFrame, frequencies: DataFrame, files: int = CORPUS_FILES, share: float = RARE_SHARE) -> DataFrame:
    """tokens (kind, token, ...) with `considered`: whether a token is in under a share of the files; unknown ones count once."""
    known = frequencies.groupBy("kind", "token").agg(F.max("cnt").alias("_cnt"))
    return tokens.join(known, ["kind", "token"], "left").withColumn("considered", is_rare(F.col("_cnt"), files, share)).drop("_cnt")


def consider(nodes: DataFrame, frequencies: DataFrame, near: DataFrame, by_choice: DataFrame | None = None) -> DataFrame:
    """nodes with considered (in the neighbourhood `near`) and a flag per attribute.

    Location, type and token always count. A name counts if it is rare among names of its kind (api: called methods, type:
    types, var: the rest) or its node is near; an expression type if it is rare or chosen (tree_id, node_id).
    """
    kind = F.when(F.col("node_type") == "MethodInvocation", "api").when(F.col("node_type").endswith("Type"), "type").otherwise("var")
    named = nodes.withColumn("kind", kind).withColumn("token", F.coalesce("name", F.lit("")))
    named = rare(named, frequencies).withColumnRenamed("considered", "_rare_name").drop("kind", "token")
    typed = named.withColumn("kind", F.lit("type")).withColumn("token", F.coalesce("expr_type", F.lit("")))
    typed = rare(typed, frequencies).withColumnRenamed("considered", "_rare_type").drop("kind", "token")
    typed = typed.join(near.select("tree_id", "node_id").distinct().withColumn("_near", F.lit(True)), ["tree_id", "node_id"], "left")
    if by_choice is not None:
        typed = typed.join(by_choice.select("tree_id", "node_id").distinct().withColumn("_chosen", F.lit(True)), ["tree_id", "node_id"], "left")
    else:
        typed = typed.withColumn("_chosen", F.lit(None).cast("boolean"))
    is_near, chosen = F.coalesce("_near", F.lit(False)), F.coalesce("_chosen", F.lit(False))
    always = F.lit(True)
    return typed.select(
        *nodes.columns,
        is_near.alias("considered"),
        F.create_map(
            F.lit("location"), always, F.lit("type"), always, F.lit("token"), always,
            F.lit("name"), F.col("name").isNotNull() & (F.col("_rare_name") | is_near),
            F.lit("exprType"), F.col("expr_type").isNotNull() & (F.col("_rare_type") | chosen),
        ).alias("considered_attrs"),
    )


def consider_edits(operations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Inserts and moves (tree_id, kind, node_id, ...) with considered and considered_attrs from verdicts.

    verdicts: (tree_id, kind, node_id, attrs array<string>); what none names isn't considered, and none of its attributes is.
    """
    given = verdicts.groupBy("tree_id", "kind", "node_id").agg(F.array_distinct(F.flatten(F.collect_list("attrs"))).alias("_attrs"))
    found = operations.where(F.col("kind").isin("insert", "tree-insert", "move")).withColumn("_kind", F.regexp_replace("kind", "^tree-", ""))
    found = found.join(given.withColumnRenamed("kind", "_kind"), ["tree_id", "_kind", "node_id"], "left")
    flags = F.create_map(*[x for a in REGISTRY for x in (F.lit(a), F.coalesce(F.array_contains("_attrs", a), F.lit(False)))])
    return found.select(*operations.columns, F.col("_attrs").isNotNull().alias("considered"), flags.alias("considered_attrs"))


#: Policies by name: each gives nodes with considered and considered_attrs. A policy takes (nodes, **what it needs).
POLICIES: dict[str, Callable[..., DataFrame]] = {}


def policy(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        POLICIES[name] = f
        return f

    return put


def abstracted(name: str, nodes: DataFrame, **needs) -> DataFrame:
    """nodes as the named policy considers them."""
    if name not in POLICIES:
        raise ValueError(f"no policy {name!r}; there are {', '.join(sorted(POLICIES))}")
    return POLICIES[name](nodes, **needs)


def _all_attributes(on: Column) -> Column:
    return F.create_map(*[x for a in REGISTRY for x in (F.lit(a), on)])


@policy("frequency")
def _by_frequency(nodes: DataFrame, frequencies: DataFrame, near: DataFrame) -> DataFrame:
    return consider(nodes, frequencies, near)


@policy("random")
def _by_chance(nodes: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    return random_consider(nodes, share, seed)


@policy("verdicts")
def _by_verdicts(nodes: DataFrame, verdicts: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes that the walk keeps, with all their attributes."""
    kept = walk_verdicts(nodes, verdicts, depth).withColumn("considered", F.lit(True))
    out = nodes.join(kept, ["tree_id", "node_id"], "left").withColumn("considered", F.coalesce("considered", F.lit(False)))
    return out.select(*nodes.columns, "considered", _all_attributes(F.col("considered")).alias("considered_attrs"))


@policy("rounds")
def _by_rounds(nodes: DataFrame, lines: DataFrame, named: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Four rounds: important lines (tree_id, lines), key elements (tree_id, text) among their nodes, the most similar nodes, all attributes."""
    inside = in_important_lines(nodes.join(lines, "tree_id"), F.col("lines"))
    elements = inside.select(F.col("tree_id").alias("key"), "node_id", F.array_join("tokens", " ").alias("element"))
    kept = similar_elements(named.select(F.col("tree_id").alias("key"), "text"), elements, threshold).select(F.col("key").alias("tree_id"), "node_id").distinct()
    out = nodes.join(kept.withColumn("considered", F.lit(True)), ["tree_id", "node_id"], "left").withColumn("considered", F.coalesce("considered", F.lit(False)))
    return out.select(*nodes.columns, "considered", _all_attributes(F.col("considered")).alias("considered_attrs"))


def random_consider(nodes: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    """The baseline: a share of each tree's nodes counts, none of their attributes does."""
    order = Window.partitionBy("tree_id").orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id")
    size = Window.partitionBy("tree_id")
    rank, n = F.row_number().over(order), F.count("*").over(size)
    off = F.create_map(*[x for a in REGISTRY for x in (F.lit(a), F.lit(False))])
    return nodes.withColumn("_r", rank).withColumn("_n", n).withColumn("considered", F.col("_r") <= F.floor(F.col("_n") * share)).withColumn("considered_attrs", off).drop("_r", "_n")


def _least_dice(type_counts: Column, threshold: float, registry: dict[str, Attribute]) -> Column:
    """What the token similarity of nodes of different types has to exceed; 0 where other soft attributes may give a score."""
    soft = {a.name: a.weight for a in registry.values() if not a.hard}
    if set(soft) != {"type", "token"}:
        return F.lit(0.0)
    both = threshold * (soft["type"] + soft["token"]) / soft["token"]
    return F.when(type_counts, both).otherwise(threshold)


def _rarest_tokens(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """nodes with _k, a row for each token by which a pattern node has to meet its targets, and _keys, all of these tokens.

    A dice over d of n tokens and m others asks for more than d (n + m) / 2 common ones, so for more than n d / (2 - d). Of any n less
    that many tokens one at least is common then; the ones that fewest targets hold are taken.
    """
    every = nodes.select("*", F.posexplode("p_tokens").alias("_at", "_k"))
    held = targets.select(F.explode(F.array_distinct("t_tokens")).alias("_k")).join(every.select("_k").distinct(), "_k", "left_semi").groupBy("_k").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("pattern_id", "p_node_id").orderBy(F.coalesce("_n", F.lit(0)), "_k", "_at")
    n, d = F.size("p_tokens"), F.col("_d")
    kept = every.join(held, "_k", "left").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n - F.floor(n * d / (2 - d) + 1e-9))
    rest = [F.first(c).alias(c) for c in nodes.columns if c not in ("pattern_id", "p_node_id")]
    return kept.groupBy("pattern_id", "p_node_id").agg(*rest, F.array_sort(F.collect_set("_k")).alias("_keys")).withColumn("_k", F.explode("_keys"))


def candidates(patterns: DataFrame, targets: DataFrame, threshold: float = SCORE_THRESHOLD, registry: dict[str, Attribute] | None = None) -> DataFrame:
    """(pattern_id, p_node, p_parent, tree_id, t_node, t_parent, score) of pairs whose hard attributes agree and whose score is over the threshold.

    patterns: considered nodes with pattern_id and considered_attrs. Pairs meet by equi-joins: on the name where it counts, else
    on the node type; pairs of different types need common tokens for a score, so they meet on tokens, the most frequent of which
    (brackets, commas) aren't needed as keys; each pair counts at the first key that it has in common. Nodes none of whose attributes count fit every node and score 1: they meet all
    nodes, as the contract has it, from the pattern's few nodes. The patterns are written first: of a table made in the driver Spark
    doesn't know that it is small, and would shuffle the targets by their few types or broadcast them.
    """
    registry = registry or REGISTRY
    patterns = written(patterns, "patterns")
    own = ["node_id", "parent_id", "name", "expr_type", "node_type", "tokens", *(["role"] if "role" in patterns.columns and "role" in targets.columns else [])]
    p = patterns.select(F.col("pattern_id"), "considered_attrs", *[F.col(c).alias(f"p_{c}") for c in own])
    t = targets.select(F.col("tree_id").alias("t_tree_id"), *[F.col(c).alias(f"t_{c}") for c in own])
    counts = _counts
    by_name = p.where(counts("name") & F.col("p_name").isNotNull()).join(t, F.col("p_name") == F.col("t_name"))
    rest = p.where(~(counts("name") & F.col("p_name").isNotNull()))
    scored = counts("type") | counts("token")
    kind = lambda c: F.coalesce(c, F.lit(UNKNOWN_TYPE))
    typed = counts("exprType") & (kind("p_expr_type") != UNKNOWN_TYPE)
    by_type = rest.where(scored).join(t, F.col("p_node_type") == F.col("t_node_type"))
    # no score, but an expression type: it meets its own and unknown ones
    by_expr = rest.where(~scored & typed).withColumn("_k", F.explode(F.array("p_expr_type", F.lit(UNKNOWN_TYPE))))
    by_expr = by_expr.join(t, F.col("_k") == kind("t_expr_type")).drop("_k")
    least = _least_dice(counts("type"), threshold, registry)
    token = written(_rarest_tokens(rest.where(counts("token")).withColumn("_d", least), t), "pattern-tokens")  # so that its size is known
    n, m, d = F.size("p_tokens"), F.size("t_tokens"), F.col("_d")
    longest = token.agg(F.max(F.when(d > 0, n * (2 - d) / d).otherwise(float("inf"))).alias("_most"))  # a dice of d needs lengths not too far apart
    other = t.join(longest, m < F.col("_most") + 1e-6).withColumn("_k", F.explode(F.array_distinct("t_tokens"))).drop("_most")
    alike = (F.col("p_node_type") != F.col("t_node_type")) & (2 * F.least(n, m) > d * (n + m) - 1e-9)
    ok = F.lit(True)
    for a in registry.values():
        if a.hard:
            ok = ok & (F.coalesce(F.when(counts(a.name), a.similarity("p_", "t_")), F.lit(1.0)) > 0)
    once = F.array_intersect("_keys", "t_tokens")[0] == F.col("_k")
    by_token = token.join(other, "_k").where(alike & ok).where(once).drop("_k", "_keys", "_d")
    any_node = rest.where(~scored & ~typed).join(t)
    pairs = by_name.unionByName(by_type).unionByName(by_expr).unionByName(by_token).unionByName(any_node)
    top = bottom = F.lit(0.0)
    for a in registry.values():
        if not a.hard:
            sim = F.when(counts(a.name), a.similarity("p_", "t_"))
            top = top + F.coalesce(sim * a.weight, F.lit(0.0))
            bottom = bottom + F.when(counts(a.name), a.weight).otherwise(0.0)
    score = F.when(bottom == 0, 1.0).otherwise(F.nanvl(top / bottom, F.lit(0.0)))
    out = pairs.where(ok).withColumn("score", score).where(F.col("score") > threshold)
    return out.select("pattern_id", F.col("p_node_id").alias("p_node"), F.col("p_parent_id").alias("p_parent"), F.col("t_tree_id").alias("tree_id"), F.col("t_node_id").alias("t_node"), F.col("t_parent_id").alias("t_parent"), "score")


def ordered_candidates(pairs: DataFrame) -> DataFrame:
    """pairs with rank (best first per pattern node) and n (candidates of the pattern node; the fewest are tried first)."""
    of = ["pattern_id", "tree_id", "p_node"]
    best = Window.partitionBy(of).orderBy(F.desc("score"), "t_node")
    return pairs.withColumn("rank", F.row_number().over(best)).withColumn("n", F.count("*").over(Window.partitionBy(of)))


def assignments(options: dict[int, list[int]], p_parent: dict[int, int | None], t_parent: dict[int, int | None], cap: int = MAX_INSTANCES) -> list[dict[int, int]]:
    """One-to-one assignments of pattern nodes to their options, the pattern nodes with the fewest options first; at most cap.

    A pair is refused only if both parents are bound already and not to each other.
    """
    order = sorted(options, key=lambda p: (len(options[p]), p))
    found: list[dict[int, int]] = []
    bound: dict[int, int] = {}
    used: dict[int, int] = {}
    place = [0] * (len(order) + 1)
    depth = 0
    while depth >= 0 and len(found) < cap:
        if depth == len(order):
            found.append(dict(bound))
            depth -= 1
            if depth >= 0:
                used.pop(bound.pop(order[depth]))
            continue
        p = order[depth]
        moved = False
        while place[depth] < len(options[p]):
            t = options[p][place[depth]]
            place[depth] += 1
            pp, tp = p_parent.get(p), t_parent.get(t)
            if t in used or (pp in bound and tp in used and bound[pp] != tp):
                continue
            bound[p], used[t] = t, p
            depth += 1
            place[depth] = 0
            moved = True
            break
        if not moved:
            place[depth] = 0
            depth -= 1
            if depth >= 0:
                used.pop(bound.pop(order[depth]))
    return found if options else []


def match_instances(pairs: DataFrame, patterns: DataFrame, lenient: bool = False, cap: int = MAX_INSTANCES) -> DataFrame:
    """(pattern_id, tree_id, instance, p_node, t_node, score). A considered node without candidates fails the match unless lenient.

    Pairs are dealt by pattern and tree and sorted, so that a task meets the options of a pattern node best first and holds one tree's pairs at a time.
    """
    sizes = written(patterns.groupBy("pattern_id").agg(F.count("*").alias("n_nodes")), "pattern-sizes")
    seen = pairs.select("pattern_id", "tree_id", "p_node", "p_parent", "t_node", "t_parent", "score").join(sizes, "pattern_id")
    seen = seen.repartition("pattern_id", "tree_id").sortWithinPartitions("pattern_id", "tree_id", "p_node", F.desc("score"), "t_node")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    fields = f"pattern_id {kinds['pattern_id']}, tree_id {kinds['tree_id']}, instance int, p_node long, t_node long, score double"
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def search(key: tuple, rows: list[tuple], out: list[tuple]) -> None:
        options: dict[int, list[int]] = defaultdict(list)
        score, pp, tp = {}, {}, {}
        for p, p_up, t, t_up, s, _ in rows:
            options[p].append(t)
            score[p, t], pp[p], tp[t] = s, p_up, t_up
        if lenient or len(options) >= rows[0][-1]:
            out += [(*key, k, p, t, score[p, t]) for k, a in enumerate(assignments(options, pp, tp, cap)) for p, t in sorted(a.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        key, rows, out = None, [], []
        for batch in batches:
            for pattern, tree, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (pattern, tree) != key:
                    if rows:
                        search(key, rows, out)
                    key, rows = (pattern, tree), []
                    if len(out) >= 10_000:
                        yield made(out)
                        out = []
                rows.append(row)
        if rows:
            search(key, rows, out)
        if out:
            yield made(out)

    return seen.select("pattern_id", "tree_id", "p_node", "p_parent", "t_node", "t_parent", "score", "n_nodes").mapInArrow(run, fields)


def expected_found(results: DataFrame, expected: DataFrame, on: tuple[str, ...] = ("file", "signature")) -> DataFrame:
    """The results that are expected ones; nulls are equal, as a file without a signature is."""
    wanted = expected.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return results.join(wanted, same, "left_semi")


def edit_places(operations: DataFrame, mapping: DataFrame, binding: DataFrame, named: str = "either") -> DataFrame:
    """operations (tree_id, parent_id, ...) with place: the target's node for the parent an edit names, and place_type.

    mapping: (tree_id, after_id, before_id) of the pattern; binding: (tree_id, p_node, t_node) of pattern and target. A parent that is
    a node of the before tree leads to its target (type 1), one of the after tree to that of its before node (type 2); one that an
    earlier edit inserts has none (type 3). named: operations name parents by nodes of the `before` tree, of the `after` tree, or, where the two
    have different ids, of either.
    """
    own = binding.select("tree_id", F.col("p_node").alias("parent_id"), F.col("t_node").alias("_direct"))
    via = mapping.join(shuffled(binding), (mapping.tree_id == binding.tree_id) & (mapping.before_id == binding.p_node)).select(
        mapping.tree_id, F.col("after_id").alias("parent_id"), F.col("t_node").alias("_mapped")
    )
    own, via = (own.limit(0), via) if named == "after" else (own, via.limit(0)) if named == "before" else (own, via)
    out = operations.join(shuffled(own), ["tree_id", "parent_id"], "left").join(shuffled(via), ["tree_id", "parent_id"], "left")
    kind = F.when(F.col("_direct").isNotNull(), 1).when(F.col("_mapped").isNotNull(), 2).otherwise(3)
    return out.select(*operations.columns, F.coalesce("_direct", "_mapped").alias("place"), kind.alias("place_type"))


def detect(instances: DataFrame, used: int = USED_INSTANCES) -> DataFrame:
    """(pattern_id, tree_id) with a legal instance among the first few; every instance is legal."""
    return instances.where(F.col("instance") < used).select("pattern_id", "tree_id").distinct()


def action_related(operations: DataFrame, mapping: DataFrame) -> DataFrame:
    """(tree_id, node_id) that edits touch: deleted, moved and updated nodes, and the parents that inserts and moves go to.

    mapping: (tree_id, after_id, before_id), for parents that are named by their place in the after tree.
    """
    own = operations.where(F.col("kind").isin("delete", "tree-delete", "move", "update")).select("tree_id", "node_id")
    to = operations.where(F.col("kind").isin("insert", "tree-insert", "move")).select("tree_id", F.col("parent_id").alias("after_id"))
    to = to.join(shuffled(mapping), ["tree_id", "after_id"], "left").select("tree_id", F.coalesce("before_id", "after_id").alias("node_id"))
    return own.unionByName(to).where("node_id >= 0").distinct()


def not_logic(operations: DataFrame, nodes: DataFrame, most: int = MAX_NOT_LOGIC) -> DataFrame:
    """(tree_id, kind, node_id, parent_id, node_type) of inserts and of moves into structure nodes; more than a few say nothing.

    operations: an edit script that isn't simplified, so that what inserted blocks and expression statements hold is in it: it stands
    for them, at the first parent above that isn't one. What goes into a moved parent is left out.
    """
    operations = written(operations, "operations")  # read several times; a script costs the comparison of two trees
    moved = operations.where("kind = 'move'").select("tree_id", F.col("node_id").alias("parent_id"))
    every = operations.where(F.col("kind").isin("insert", "tree-insert")).select("tree_id", "node_id", "parent_id", "node_type")
    wrapper = F.col("node_type").isin("Block", "ExpressionStatement")
    wrappers = every.where(wrapper).select("tree_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_above"))
    ins = every.where(~wrapper)
    for _ in range(2):  # a block around expression statements
        ins = ins.join(shuffled(wrappers), ["tree_id", "parent_id"], "left").select("tree_id", "node_id", F.coalesce("_above", "parent_id").alias("parent_id"), "node_type")
    # a node below another inserted one comes with it
    above = every.where(~wrapper).select("tree_id", F.col("node_id").alias("parent_id"))
    ins = ins.join(shuffled(above), ["tree_id", "parent_id"], "left_anti").join(shuffled(moved), ["tree_id", "parent_id"], "left_anti")
    ins = ins.select("tree_id", F.lit("insert").alias("kind"), "node_id", "parent_id", "node_type")
    kinds = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("parent_type"), F.col("parent_id").alias("_up"))
    into = operations.where("kind = 'move'").select("tree_id", "node_id", "parent_id").join(shuffled(kinds), ["tree_id", "parent_id"])
    above = nodes.select("tree_id", F.col("node_id").alias("_up"), F.col("node_type").alias("up_type"))
    into = into.join(shuffled(above), ["tree_id", "_up"], "left")
    lifted = (F.col("parent_type") == "Block") & (F.coalesce("up_type", F.lit("")) != "TryStatement")
    into = into.select("tree_id", "node_id", F.when(lifted, F.col("_up")).otherwise(F.col("parent_id")).alias("parent_id"), F.when(lifted, F.col("up_type")).otherwise(F.col("parent_type")).alias("to_type"))
    own = nodes.select("tree_id", "node_id", "node_type")
    into = into.where(F.col("to_type").isin(*STRUCTURE_TYPES)).join(shuffled(own), ["tree_id", "node_id"]).select("tree_id", F.lit("move").alias("kind"), "node_id", "parent_id", "node_type")
    found = ins.unionByName(into)
    few = found.groupBy("tree_id", "kind").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("tree_id", "kind")
    return found.join(shuffled(few), ["tree_id", "kind"], "left_semi")


def walk_verdicts(nodes: DataFrame, verdicts: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes kept by a top-down walk: class 1 keeps a node and goes on, class 2 only goes on, anything else ends there. Trees of any depth.

    verdicts: (tree_id, node_id, verdict) as given by whoever judged the nodes; depth: how far below a root the walk goes at most. A walk gets
    to a node if no node above it ends it. With ranks (pre, post, depth) one sorted pass tells; with parents alone each round asks twice as
    many nodes above, so rounds grow with the logarithm of the depth.
    """
    key = ["tree_id", "node_id"]
    judged = nodes.join(verdicts.select(*key, "verdict"), key, "left")
    passes = F.coalesce(F.col("verdict").isin(1, 2), F.lit(False))
    near = F.lit(True) if depth is None else F.col("depth") <= depth
    if {"pre", "post", "depth"} <= set(nodes.columns):
        return judged.where((F.col("verdict") == 1) & near).join(inside(nodes, judged.where(~passes)), key, "left_anti").select(*key)
    # up: a node above, null at the root; depth: the steps to it; open: whether all nodes below that one pass, this one included
    steps = F.when(F.col("parent_id").isNull(), 0).otherwise(1)
    now = written(judged.select(*key, F.col("parent_id").alias("up"), steps.alias("depth"), passes.alias("open"), "verdict"), "walk")
    while now.where("open AND up IS NOT NULL").limit(1).count():
        above = now.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("open").alias("_open"))
        stepped = now.join(above, ["tree_id", "up"], "left")
        goes = F.coalesce(F.col("up").isNull() | F.col("_open"), F.lit(False))
        depths = (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")
        now = written(stepped.select(*key, F.col("_up").alias("up"), depths, (F.col("open") & goes).alias("open"), "verdict"), "walk")
    return now.where(F.col("open") & (F.col("verdict") == 1) & near).select(*key)


def identifier_definitions(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """Each use (tree_id, use_id, name, start, end) with the definition (def_id, scope_start, scope_end, is_global) it means.

    The scope has to hold the use; local ones come before global ones, the innermost first, then the earliest. One sweep over the
    sorted places of a name finds the local ones; global ones are few and meet only what is left.
    """
    key = ["tree_id", "name"]
    local = defs.where(~F.col("is_global")).select(*key, F.col("def_id").alias("range_id"), F.col("scope_start").alias("start"), F.col("scope_end").alias("end"))
    points = uses.select(*key, F.col("use_id").alias("point_id"), F.col("start").alias("at"), F.col("end").alias("until"))
    found = innermost(points, local, key).select(*key, F.col("point_id").alias("use_id"), F.col("range_id").alias("def_id"))
    left = uses.select(*key, "use_id", "start", "end").join(shuffled(found.select(*key, "use_id")), [*key, "use_id"], "left_anti")
    wide = left.join(shuffled(defs.where("is_global").select(*key, "def_id", "scope_start", "scope_end")), key).where((F.col("scope_start") <= F.col("start")) & (F.col("scope_end") >= F.col("end")))
    first = wide.groupBy(*key, "use_id").agg(F.min(F.struct((F.col("scope_end") - F.col("scope_start")).alias("size"), "scope_start", "def_id")).alias("first"))
    found = found.unionByName(first.select(*key, "use_id", F.col("first.def_id").alias("def_id")))
    return uses.join(shuffled(found), [*key, "use_id"], "left")


def use_index(uses: DataFrame) -> DataFrame:
    """name -> its uses in order."""
    return uses.groupBy("tree_id", "name").agg(F.array_sort(F.collect_list("use_id")).alias("uses"))


#: Texts longer than this many letters stand for lengths of six digits in base two, rounded down.
EXACT_LENGTH = 63
#: Window hashes that a task holds before it hands them on.
HELD_WINDOWS = 1 << 17


def _length_class(n: Column) -> Column:
    """n letters rounded down to six digits in base two, so that texts of any length have few classes; up to EXACT_LENGTH it is n."""
    step = F.pow(F.lit(2), F.greatest(F.lit(0), F.floor(F.log2(n.cast("double")) + 1e-12).cast("int") - 5))
    return (F.floor(n / step) * step).cast("int")


def _window_hashes(rows: DataFrame) -> DataFrame:
    """(key, id, own, other, window) of rows (key, id, text, own, sizes of other and size): the distinct hashes of a text's windows of each size, letters in either case."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = f"key {kinds['key']}, id bigint, own int, other int, window bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, wrap = 0x5851F42D4C957F2D, 1 << 64  # odd, so that it can be divided by
        powers = inverse = np.ones(1, np.uint64)
        for batch in batches:
            key, ids, own = (batch.column(i) for i in range(3))
            at, other, found, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                rows = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))  # noqa: B023
                columns = [c.take(rows) for c in (key, ids, own)]  # noqa: B023
                more = [np.concatenate(x) if x else np.zeros(0, d) for x, d in ((other, np.int32), (found, np.int64))]  # noqa: B023
                return pa.RecordBatch.from_arrays([*columns, *map(pa.array, more)], names=["key", "id", "own", "other", "window"])

            for i, (text, sizes) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                n = len(codes)
                if n >= len(powers):
                    steps = lambda f: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, f, np.uint64)]))  # noqa: E731, B023
                    powers, inverse = steps(factor), steps(pow(factor, -1, wrap))
                before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:n])])
                for x in sizes:
                    size = x["size"]
                    if size > n:
                        continue
                    windows = np.unique((before[size:] - before[: n + 1 - size]) * inverse[: n + 1 - size]).view(np.int64)
                    at.append(np.full(len(windows), i))
                    other.append(np.full(len(windows), x["other"], np.int32))
                    found.append(windows)
                    held += len(windows)
                if held >= HELD_WINDOWS:
                    yield out()
                    at, other, found, held = [], [], [], 0
            yield out()

    return rows.select("key", "id", "own", "text", "sizes").mapInArrow(run, fields)


def similar_texts(named: DataFrame, elements: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs of rows with equal keys whose `text` and `element` have a common-substring dice of threshold (over 0) or more; without all pairs.

    Texts of n and m letters need a common substring of t (n + m) / 2 letters. Lengths are put into classes, and for each two classes of a
    key that can be similar both sides give the hashes of all their windows of just that length (of the classes' least lengths): texts up to
    EXACT_LENGTH letters meet only where they are similar, whatever shorter parts they share. Each text of a key counts once: the pairs of
    different texts are verified by a suffix automaton, and then their rows are joined.
    """
    t = threshold
    own = written(named.where(F.col("key").isNotNull() & (F.char_length("text") > 0)), "similar-texts")
    other = written(elements.where(F.col("key").isNotNull() & (F.char_length("element") > 0)), "similar-elements")

    def distinct(rows: DataFrame, text: str) -> DataFrame:
        made = rows.select("key", F.col(text).alias("text")).distinct()
        return written(made.withColumn("id", F.monotonically_increasing_id()).withColumn("own", _length_class(F.char_length("text"))), "similar-distinct")

    a, b = distinct(own, "text"), distinct(other, "element")
    longest = lambda df, name: df.groupBy("key", F.col("own").alias(name)).agg(F.max(F.char_length(F.lower("text"))).alias(f"{name}_most"))
    size = F.ceil(t * (F.col("n") + F.col("m")) / 2 - 1e-9)
    classes = longest(a, "n").join(longest(b, "m"), "key").withColumn("size", F.greatest(size, F.lit(1)).cast("int"))
    classes = written(classes.where(F.col("size") <= F.least("n_most", "m_most")).select("key", "n", "m", "size"), "similar-lengths")
    sizes = lambda x, y: classes.groupBy("key", F.col(x).alias("own")).agg(F.collect_list(F.struct(F.col(y).alias("other"), "size")).alias("sizes"))
    left = _window_hashes(a.join(sizes("n", "m"), ["key", "own"])).select("key", F.col("id").alias("a_id"), F.col("own").alias("n"), F.col("other").alias("m"), "window")
    right = _window_hashes(b.join(sizes("m", "n"), ["key", "own"])).select("key", F.col("id").alias("b_id"), F.col("other").alias("n"), F.col("own").alias("m"), "window")
    met = left.join(shuffled(right), ["key", "n", "m", "window"]).select("a_id", "b_id").distinct()
    met = met.join(shuffled(a.select(F.col("id").alias("a_id"), "key", "text")), "a_id").join(shuffled(b.select(F.col("id").alias("b_id"), F.col("text").alias("element"))), "b_id")
    alike = met.select("key", "text", "element").withColumn("similarity", substring_dice_udf("text", "element")).where(F.col("similarity") >= t)
    pairs = own.join(shuffled(written(alike, "similar-pairs")), ["key", "text"]).join(shuffled(other), ["key", "element"])
    return pairs.select(*named.columns, *[c for c in elements.columns if c != "key"], "similarity")


def similar_elements(named: DataFrame, elements: DataFrame, threshold: float = 0.85, similarity: Callable[[str, str], Column] = substring_dice_udf) -> DataFrame:
    """Pairs of a named element (key, text) and a tree element (key, element) whose similarity (common substring dice) reaches the threshold.

    The common substring has a filter of its own (similar_texts); another similarity is asked for every pair of a key.
    """
    if similarity is substring_dice_udf and threshold > 0:
        return similar_texts(named, elements, threshold)
    return named.join(elements, "key").withColumn("similarity", similarity("text", "element")).where(F.col("similarity") >= threshold)


def in_important_lines(nodes: DataFrame, lines: Column) -> DataFrame:
    """Nodes that one of the lines touches, or lies next to."""
    return nodes.where(F.exists(lines, lambda x: (x >= F.col("start_line") - 1) & (x <= F.col("end_line") + 1)))

