"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_TYPE = "<UNKNOWN>"


def name_equal(a: Column, b: Column) -> Column:
    """1 if both names are there and equal, 0 if not, null without names on either side."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a == b, F.lit(False)).cast("double"))


def type_equal(a: Column, b: Column) -> Column:
    """1 if the expression types agree or either is unknown."""
    wild = (a == UNKNOWN_TYPE) | (b == UNKNOWN_TYPE)
    return F.when(wild, 1.0).otherwise(F.coalesce(a.eqNullSafe(b), F.lit(False)).cast("double"))


def class_equal(a: Column, b: Column) -> Column:
    return (a == b).cast("int")


def slot_fits(own_role: Column, other_role: Column, own_parent: Column, other_parent: Column) -> Column:
    """Whether a node may stand where another stands: both are roots, or their slots have one role."""
    return (own_parent.isNull() & other_parent.isNull()) | F.coalesce(own_role == other_role, F.lit(False))


def strip_number(text: Column) -> Column:
    """A number literal without its radix prefix, underscores and type suffix."""
    plain = F.regexp_replace(text, "_", "")
    hexa = F.regexp_extract(plain, r"^0[xX]([0-9a-fA-F]+)[lL]?$", 1)
    binary = F.regexp_extract(plain, r"^0[bB]([01]+)[lL]?$", 1)
    return F.when(hexa != "", hexa).when(binary != "", binary).otherwise(F.regexp_replace(plain, r"[lLfFdD]$", ""))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def split_once(text: Column, mark: str) -> tuple[Column, Column]:
    """What is before and after the first mark; null after it where there is none."""
    parts = F.split(text, mark, 2)
    return parts[0], F.try_element_at(parts, F.lit(2))


def mapped(key: Column, values: dict[str, str]) -> Column:
    """The value of a key, or the key itself."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map()
    return F.coalesce(F.try_element_at(table, key), key) if values else key


def safe_div(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b, 0 where b is 0."""
    made = F.when(b == 0, 0.0).otherwise(a.cast("double") / b)
    return made if digits is None else F.round(made, digits)


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def _outer_commas(text: Column) -> Column:
    """text with a mark for each comma that is in no angle brackets."""
    marks = F.transform(F.split(text, ""), lambda c: F.struct(c.alias("c"), F.when(c == "<", 1).when(c == ">", -1).otherwise(0).alias("d")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))
    step = lambda s, x: F.struct(
        F.concat(s["out"], F.when((x["c"] == ",") & (s["depth"] == 0), "\u0001").otherwise(x["c"])).alias("out"), (s["depth"] + x["d"]).alias("depth")
    )
    return F.aggregate(marks, start, step, lambda s: s["out"])


def signature_struct(text: Column) -> Column:
    """struct<ret, name, args> of "ret name(type arg, ...)" text; commas inside generics don't part arguments."""
    ret = F.nullif(F.regexp_extract(text, r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*([\w.<>\[\], ]+?)\s+\w+\s*\(", 1), F.lit(""))
    name = F.regexp_extract(text, r"(\w+)\s*\(", 1)
    inner = F.trim(F.regexp_extract(text, r"\((.*)\)", 1))
    args = F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(_outer_commas(inner), "\u0001"), lambda a: F.regexp_replace(F.regexp_replace(F.trim(a), r"^final\s+", ""), r"\s+\w+$", ""))
    )
    return F.struct(ret.alias("ret"), name.alias("name"), args.alias("args"))


def yes_no(answer: Column) -> Column:
    """True or false of an answer that starts so, else null."""
    word = F.lower(F.regexp_extract(F.trim(answer), r"^\W*(\w+)", 1))
    return F.when(word == "yes", True).when(word == "no", False)


def type_class(answer: Column) -> Column:
    """n of the first "[Type n]", "[Category n]" or "[n]" in an answer, whatever its case."""
    return F.nullif(F.regexp_extract(answer, r"(?i)\[\s*(?:type|category)?\s*(\d+)\s*\]", 1), F.lit("")).cast("int")


def critical_lines(answer: Column) -> Column:
    """The parts of a "[critical lines]" section that ||| separates."""
    section = F.regexp_extract(answer, r"(?is)\[critical lines\]\s*:?\s*(.*?)(?:\n\s*\n|$)", 1)
    return F.filter(F.transform(F.split(section, r"\|\|\|"), lambda x: F.trim(x)), lambda x: x != "")


def element_parts(text: Column) -> Column:
    """struct<type, value, line> of "@@type@@value@@line"."""
    part = lambda k: F.regexp_extract(text, r"@@(.*?)@@(.*)@@(\d+)\s*$", k)
    return F.struct(part(1).alias("type"), part(2).alias("value"), part(3).cast("int").alias("line"))


def decode_text(data: Column, charsets: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> Column:
    """Bytes as text in the first charset that they are valid in."""
    first, *rest = charsets
    made = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")) if first == "UTF-8" else F.decode(data, first)
    return F.coalesce(made, *[F.decode(data, c) for c in rest])
