"""Tables that refer to each other as a forest: each entity type is a table, its parent a foreign key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.dsl.vocabulary import SIMPLE, Vocabulary


@dataclass(frozen=True)
class Entity:
    """key: columns that make a row's id (null: a row of its own); parent: (entity, foreign key columns)."""

    table: str
    prefix: str
    key: str | None
    parent: tuple[str, str] | None = None
    columns: tuple[str, ...] = ()
    flags: dict[str, str] = field(default_factory=dict)  # name -> SQL condition


#: The containment chains of the sample star schema.
STAR = {
    "region": Entity("region", "r_", "r_regionkey", None, ("regionkey", "name")),
    "nation": Entity("nation", "n_", "n_nationkey", ("region", "n_regionkey"), ("nationkey", "name")),
    "customer": Entity("customer", "c_", "c_custkey", ("nation", "c_nationkey"), ("custkey", "name", "acctbal", "mktsegment"), {"inDebt": "c_acctbal < 0"}),
    "supplier": Entity("supplier", "s_", "s_suppkey", ("nation", "s_nationkey"), ("suppkey", "name", "acctbal")),
    "orders": Entity("orders", "o_", "o_orderkey", ("customer", "o_custkey"), ("orderkey", "orderstatus", "totalprice", "orderpriority"), {"isUrgent": "o_orderpriority = '1-URGENT'"}),
    "lineitem": Entity("lineitem", "l_", None, ("orders", "l_orderkey"), ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "discount", "returnflag", "linestatus")),
    "part": Entity("part", "p_", "p_partkey", None, ("partkey", "name", "brand", "type", "size", "retailprice")),
}


class RelationalForest:
    """Rows of entity types; containment is a join on foreign keys, never a closure of the whole forest."""

    def __init__(self, tables: dict[str, DataFrame], entities: dict[str, Entity] = STAR):
        self.tables, self.entities = tables, entities
        self.vocabulary = Vocabulary(
            name="relational",
            types=frozenset(entities),
            properties=frozenset(c for e in entities.values() for c in e.columns) | frozenset(entities),
            actions={c: SIMPLE for e in entities.values() for c in e.columns},
            type_properties={t: frozenset(e.columns) | ({e.parent[0]} if e.parent else frozenset()) for t, e in entities.items()},
            flags=frozenset(f for e in entities.values() for f in e.flags),
        )

    def nodes(self, kind: str) -> DataFrame:
        """The rows of a type with their `_id`."""
        e = self.entities[kind]
        df = self.tables[e.table]
        return df.withColumn("_id", F.col(e.key)) if e.key else df.withColumn("_id", F.lit(None).cast("long"))

    def column(self, kind: str, prop: str):
        e = self.entities[kind]
        if prop in e.flags:
            return F.coalesce(F.expr(e.flags[prop]), F.lit(False))
        return F.col(e.prefix + prop) if prop in e.columns else None

    def key_column(self, kind: str):
        """The column that names a row of the type as an ancestor."""
        return F.col(self.entities[kind].key)

    def chain(self, above: str, below: str) -> list[str] | None:
        """Entity types from below up to above, both included; None if above doesn't contain below."""
        path = [below]
        while path[-1] != above:
            parent = self.entities[path[-1]].parent
            if parent is None:
                return None
            path.append(parent[0])
        return path if len(path) > 1 else None

    def path_end(self, kind: str, steps: tuple[str, ...]) -> str | None:
        """The type that a path of parents leads to from a type; None if a step isn't the parent of the one before."""
        for step in steps:
            parent = self.entities[kind].parent
            if parent is None or parent[0] != step:
                return None
            kind = step
        return kind

    def owner_ids(self, df: DataFrame, above: str, below: str) -> DataFrame:
        """df (rows of below) with `_up`: the id of the row of above that contains each."""
        path = self.chain(above, below)
        df = df.withColumn("_up", F.col(self.entities[below].parent[1]))
        for kind in path[1:-1]:
            e = self.entities[kind]
            step = self.tables[e.table].select(F.col(e.key).alias("_k"), F.col(e.parent[1]).alias("_next"))
            df = df.join(step, F.col("_up") == F.col("_k")).drop("_up", "_k").withColumnRenamed("_next", "_up")
        return df

    def node_table(self) -> DataFrame:
        """The forest of customers and below as one node table (tree = customer); for generic tree operators."""
        c, o, li = (self.tables[t] for t in ("customer", "orders", "lineitem"))
        top = c.select(F.col("c_custkey").cast("string").alias("tree_id"), F.array().cast("array<string>").alias("path"), F.concat(F.lit("c"), "c_custkey").alias("key"), F.lit("customer").alias("node_type"), F.col("c_name").alias("name"))
        mid = o.select(F.col("o_custkey").cast("string").alias("tree_id"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("path"), F.concat(F.lit("o"), "o_orderkey").alias("key"), F.lit("orders").alias("node_type"), F.col("o_orderstatus").alias("name"))
        owners = o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        low = li.join(owners, "l_orderkey").select(
            F.col("o_custkey").cast("string").alias("tree_id"),
            F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "l_orderkey")).alias("path"),
            F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("key"),
            F.lit("lineitem").alias("node_type"),
            F.col("l_returnflag").alias("name"),
        )
        return top.unionByName(mid).unionByName(low).withColumn("depth", F.size("path"))
