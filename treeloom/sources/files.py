"""Sources: code trees, reports, metadata and tables as DataFrames. All listing and reading is Spark's, so any store will do."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from treeloom.functions.columns import decode_text
from treeloom.sources.work import written
from treeloom.tree.nodes import NODE_FIELDS

# Accepted names of a pair's files, in order of preference.
PAIR_NAMES = (("before", "after"), ("error", "correct"), ("left", "right"), ("buggy", "fixed"))
CHANGE_INFO = (
    "before_commit_id string, after_commit_id string, file_path string, signature_before string, signature_after string, before_start string, before_end string, "
    "after_start string, after_end string"
)
VERDICT = (
    "considered_elements array<string>, considered_attrs map<string,array<string>>, regex map<string,string>, insert_elements map<string,array<string>>, "
    "move_elements map<string,array<string>>, roughly_line array<int>, histories map<string,array<struct<role:string,content:string>>>"
)
CHANGED_METHOD = "file_name string, begin_line int, end_line int, method_signature string, method_source string"
GROUND_TRUTH = "file string, begin_line int, end_line int"
PATTERN = "FileName string, ErrorInfo string, BeforeCode array<string>, AfterCode array<string>, Before0Tree string, insertNodes string, moveParentNodes string, Attrs string"


def source_files(spark: SparkSession, path: str, glob: str = "*.java") -> DataFrame:
    """(path, text) of every file below path; text in the first charset that fits. Spark passes over empty and hidden files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", decode_text(F.col("content")).alias("text"))


#: Rows and tokens of trees that a task makes one batch of; a larger tree is one by itself.
HELD_TOKENS = 1 << 16


def _maps(values: list[dict | None], kind: pa.MapType) -> pa.Array:
    ends, keys, items = [], [], []
    for x in values:
        ends.append(None if x is None else len(keys))
        if x:
            keys += x
            items += x.values()
    return pa.MapArray.from_arrays(pa.array([*ends, len(keys)], pa.int32()), pa.array(keys, kind.key_type), pa.array(items, kind.item_type)).cast(kind)


def parsed(texts: DataFrame, kind: str, id_col: str = "path", text_col: str = "text", columns: Collection[str] | None = None, node_types: Collection[str] | None = None) -> DataFrame:
    """NODE_FIELDS rows and parse_error of each text; one that can't be read gives a row with its error only. kind: java or html.

    columns: those of NODE_FIELDS that the rows have, tree_id among them; a mapping in Python isn't pruned by Spark, so who reads few names them.
    node_types: those that rows are wanted of.
    """
    fields = StructType([f for f in StructType.fromDDL(f"{NODE_FIELDS}, parse_error string") if columns is None or f.name in {*columns, "tree_id", "parse_error"}])
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treeloom.tree.html import parse_html
        from treeloom.tree.java import parse_unit
        from treeloom.tree.nodes import allow_depth, rows_of

        allow_depth()
        parse = {"java": parse_unit, "html": parse_html}[kind]
        held: list[dict] = []
        size = 0

        def out() -> pa.RecordBatch:
            columns = []
            for f in schema:
                values = [r.get(f.name) for r in held]  # noqa: B023
                columns.append(_maps(values, f.type) if f.name in ("props", "flags") else pa.array(values, f.type))
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if not text:
                        raise ValueError("empty")
                    rows = rows_of(str(key), parse(text), columns)
                    if node_types is not None:
                        rows = [r for r in rows if r["node_type"] in node_types]
                except ValueError as e:
                    rows = [{"tree_id": str(key), "parse_error": str(e)}]
                held += rows
                size += sum(1 + len(r.get("tokens", ())) for r in rows)
                if size >= HELD_TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts.select(id_col, text_col).mapInArrow(run, fields)


def code_pairs(files: DataFrame) -> DataFrame:
    """(case_id, before, after): per folder the pair with the most preferred names."""
    folder, stem = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lower(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    named = files.select(folder.alias("case_id"), stem.alias("stem"), "text")
    names = [(k, side, n) for k, pair in enumerate(PAIR_NAMES) for side, n in zip(("before", "after"), pair, strict=True)]
    rank = F.lit(None).cast("int")
    side = F.lit(None).cast("string")
    for k, s, n in names:
        rank, side = F.when(F.col("stem") == n, k).otherwise(rank), F.when(F.col("stem") == n, s).otherwise(side)
    sided = named.withColumn("rank", rank).withColumn("side", side).where("rank IS NOT NULL")
    pairs = sided.groupBy("case_id", "rank").agg(F.max(F.when(F.col("side") == "before", F.col("text"))).alias("before"), F.max(F.when(F.col("side") == "after", F.col("text"))).alias("after"))
    whole = pairs.where("before IS NOT NULL AND after IS NOT NULL")
    return whole.groupBy("case_id").agg(F.min_by(F.struct("before", "after"), "rank").alias("p")).select("case_id", "p.before", "p.after")


def method_by_signature(methods: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Of each tree the method whose signature is wanted (tree_id, signature), or its first method where none is named.

    Signatures are return type, name and ordered argument types; a constructor has no return type, which equals none.
    """
    first = methods.withColumn("_r", F.row_number().over(Window.partitionBy("tree_id").orderBy("pre"))).where("_r = 1").drop("_r")
    if wanted is None:
        return first
    own = methods.withColumn("signature", F.try_element_at("props", F.lit("signature"))).join(wanted, ["tree_id", "signature"]).drop("signature")
    return own.unionByName(first.join(wanted.select("tree_id"), "tree_id", "left_anti"))


def json_table(spark: SparkSession, path: str, schema: str | None = None, strict: bool = False) -> DataFrame:
    """Whole-file JSON objects or lists; strict fails on files that don't fit the schema."""
    reader = spark.read.option("multiLine", "true").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def change_info(spark: SparkSession, path: str) -> DataFrame:
    return json_table(spark, path, CHANGE_INFO)


def changed_methods(spark: SparkSession, path: str) -> DataFrame:
    return json_table(spark, path, CHANGED_METHOD)


def ground_truths(spark: SparkSession, path: str) -> DataFrame:
    """Ranges by file; file names are written with # for /."""
    return json_table(spark, path, GROUND_TRUTH).withColumn("file", F.regexp_replace("file", "#", "/"))


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    return json_table(spark, path, VERDICT)


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """Pattern files; their recursive parts stay JSON text, to be taken apart by `pattern_nodes`."""
    return json_table(spark, path, PATTERN, strict=True)


def pattern_nodes(df: DataFrame, column: str = "Before0Tree", key: str = "FileName") -> DataFrame:
    """(key, id, parent_id, type, isExpr, value, leaf, startLine, endLine) of a recursive node in JSON text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        names = ["id", "type", "isExpr", "value", "leaf", "startLine", "endLine"]
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[column], strict=True):
                stack = [(json.loads(text), None)] if text else []
                while stack:
                    n, parent = stack.pop()
                    rows.append((k, parent, *(n.get(c) for c in names)))
                    stack += [(c, n.get("id")) for c in reversed(n.get("children") or [])]
            frame = pd.DataFrame(rows, columns=[key, "parent_id", *names])
            for c in ("parent_id", "id", "startLine", "endLine"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return df.select(key, column).mapInPandas(run, f"{key} string, parent_id long, id long, type string, isExpr boolean, value string, leaf boolean, startLine int, endLine int")


def frequency_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(kind, token, cnt) of files that alternate token and count lines; pairs without a number go, a later repeat wins."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    pairs = lines.groupBy("file", F.floor(F.col("n") / 2).alias("pair")).agg(
        F.max(F.when(F.col("n") % 2 == 0, F.col("line"))).alias("token"), F.max(F.when(F.col("n") % 2 == 1, F.col("line"))).alias("count")
    )
    good = pairs.where(F.trim("count").rlike(r"^\d+$"))
    return good.groupBy("token").agg(F.max_by(F.trim("count").cast("int"), F.struct("file", "pair")).alias("cnt")).select(F.lit(kind).alias("kind"), "token", "cnt")


def dataset_cases(files: DataFrame, root: str, grouped: bool = True, only: list[str] | None = None) -> DataFrame:
    """(dataset, group, case, path): the levels below root; ungrouped datasets have no group."""
    rest = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    parts = F.split(rest, "/")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    out = files.select(at(1).alias("dataset"), (at(2) if grouped else F.lit(None).cast("string")).alias("group"), at(3 if grouped else 2).alias("case"), "path")
    return out.where(F.col("dataset").isin(only)) if only else out


def errors_of(report: bytes, charset: str | None = None) -> list[tuple[str | None, str | None, int | None]]:
    """(function, fileName, reportLine) of a report's errors, none unless the report is well formed to its end.

    Markup is read as XML has it, CDATA included; charset stands above what the report says of itself. Reports that declare entities are refused.
    """
    from xml.parsers import expat

    found: list[tuple] = []
    path: list[str] = []
    now: dict[str, list[str]] = {}

    def begin(name: str, _) -> None:
        path.append(name)
        if name == "error":
            now.clear()

    def text(data: str) -> None:
        if path[-3:-1] == ["error", "defectInfo"]:
            now.setdefault(path[-1], []).append(data)

    def end(name: str) -> None:
        path.pop()
        if name == "defectInfo" and path[-1:] == ["error"]:
            function, file, line = ("".join(now[k]).strip() if k in now else None for k in ("function", "fileName", "reportLine"))
            found.append((function, file, int(line) if line and line.lstrip("+-").isdecimal() else None))

    def refuse(*_) -> None:
        raise ValueError("an entity")

    parser = expat.ParserCreate(charset)
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = begin, end, text, refuse
    try:
        parser.Parse(report, True)
    except (expat.ExpatError, ValueError):
        return []
    return found


def report_errors(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """(function, fileName, reportLine, report) of an engine's XML reports; report is the file's name. Broken reports have none: each is read whole before it counts."""
    fields = "function string, fileName string, reportLine int, report string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = errors_of(content.as_buffer().to_pybytes(), charset)
                columns = list(zip(*rows, strict=True)) if rows else [()] * 3
                types = (pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array([name] * len(rows), pa.string())], names=["function", "fileName", "reportLine", "report"])

    raw = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", r"^file:/+", "/").alias("report"), "content")
    return raw.mapInArrow(run, fields)


def report_counts(errors: DataFrame, by: list[str], reports: DataFrame | None = None) -> DataFrame:
    """(by, n, has_error): errors by report; reports (by) names those that may have none, see report_files."""
    n = errors.groupBy(by).agg(F.count("*").alias("n"))
    if reports is not None:
        n = reports.select(by).distinct().join(n, by, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return n.withColumn("has_error", F.col("n") > 0)


def report_files(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(report): the names of all reports, those without errors included; nothing of them is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_replace("path", r"^file:/+", "/").alias("report"))


def tabbed_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, signature, begin, end) of tab-separated matcher results; "Empty Pattern" files have none."""
    rows = spark.read.option("sep", "\t").schema("_c0 string, file string, signature string, span string").csv(path)
    span = F.split("span", "#")
    return rows.where("_c0 <> 'Empty Pattern' AND file IS NOT NULL").select("file", "signature", span[0].cast("int").alias("begin"), span[1].cast("int").alias("end"))


def baseline_warnings(spark: SparkSession, path: str) -> DataFrame:
    """(hash, file, begin, end, signature) of hash#file#begin#end#signature lines."""
    parts = F.split("value", "#", 5)
    rows = spark.read.text(path).where(F.size(F.split("value", "#")) >= 5)
    return rows.select(parts[0].alias("hash"), parts[1].alias("file"), parts[2].cast("int").alias("begin"), parts[3].cast("int").alias("end"), parts[4].alias("signature"))


def sectioned(spark: SparkSession, path: str, header: str = r"^hash#") -> DataFrame:
    """(file, section, line_no, line); lines before a file's first header are section 0, line numbers count from 0.

    A file is read by as many tasks as it has splits: each numbers its own lines and headers, and what stands before a split comes from the
    splits' totals, a row each. A section may go on over any number of splits.
    """
    fields = "file string, block long, at long, headers long, line string"
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.rlike("value", F.lit(header)).alias("is_header"), "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, headers = None, 0, 0
        for batch in batches:  # the lines of a split come in their order, split after split
            places, counts = [], []
            for split in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if split[:2] != now:
                    now, at, headers = split[:2], 0, 0
                headers += bool(split[2])
                places.append(at)
                counts.append(headers)
                at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.int64()), pa.array(counts, pa.int64()), batch.column(3)], names=["file", "block", "at", "headers", "line"])

    numbered = written(lines.mapInArrow(number, fields), "sections")
    totals = numbered.groupBy("file", "block").agg(F.count("*").alias("lines"), F.max("headers").alias("_headers"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = totals.select("file", "block", so_far("lines").alias("first_line"), so_far("_headers").alias("first_section"))
    placed = numbered.join(starts, ["file", "block"])
    return placed.select("file", (F.col("first_section") + F.col("headers")).alias("section"), (F.col("first_line") + F.col("at")).alias("line_no"), "line")


def scan_units(files: DataFrame) -> DataFrame:
    """(unit, files): folders that hold .java files and nothing else are a unit; of others each .java file is one.

    Folders inside a folder are something else, so its own files are single units then. Hidden folders are passed over.
    """
    parent = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    seen = files.where(~F.col("path").rlike(r"/\.[^/]+/")).select("path", parent(F.col("path")).alias("dir"))
    parents = seen.select(parent(F.col("dir")).alias("dir")).where("dir <> ''").distinct().withColumn("inner", F.lit(True))
    folders = seen.groupBy("dir").agg(F.every(F.col("path").endswith(".java")).alias("only"), F.count("*").alias("files"))
    folders = folders.join(parents, "dir", "left").withColumn("pure", F.col("only") & F.col("inner").isNull())
    single = seen.where(F.col("path").endswith(".java")).join(folders.where("NOT pure").select("dir"), "dir", "left_semi")
    return folders.where("pure").select(F.col("dir").alias("unit"), "files").unionByName(single.select(F.col("path").alias("unit"), F.lit(1).cast("long").alias("files")))


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def repositories(df: DataFrame, least_bytes: int = 20_000) -> DataFrame:
    """Repositories (languages, isArchived) with enough Java that are still kept up."""
    return df.where((F.try_element_at("languages", F.lit("Java")) > least_bytes) & ~F.col("isArchived"))


def refine_inputs(dsl: DataFrame, pairs: DataFrame, causes: DataFrame, false_positives: DataFrame, index: int) -> DataFrame:
    """All that refining a case's query takes; the index-th false positive, or the first where there are fewer."""
    order = Window.partitionBy("case_id").orderBy("fp_no")
    ranked = false_positives.withColumn("_r", F.row_number().over(order) - 1)
    chosen = ranked.groupBy("case_id").agg(F.coalesce(F.max(F.when(F.col("_r") == index, F.col("code"))), F.max(F.when(F.col("_r") == 0, F.col("code")))).alias("fp_code"))
    return dsl.join(pairs, "case_id").join(causes, "case_id", "left").join(chosen, "case_id", "left")


def labelled_codes(df: DataFrame, label: str, column: Column, most: int) -> DataFrame:
    """The first rows of a label, by their code."""
    return df.where(F.col("label") == label).select(column.alias("code")).orderBy("code").limit(most)


def without_denied(df: DataFrame, deny: list[str], column: str = "checker") -> DataFrame:
    """Rows whose checker isn't on the deny-list; rows without one stay."""
    return df.where(~F.coalesce(F.col(column).isin(deny), F.lit(False)))


def dashboard(df: DataFrame, text: str | None = None, **equal: str) -> DataFrame:
    """Rows with the given label, dataset, checker, group, case, and text in signature or file whatever its case."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    if text:
        inside = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
        df = df.where(inside("signature") | inside("file"))
    return df


def labelled_results(spark: SparkSession, path: str) -> DataFrame:
    """(checker, group, case, file, signature, label) rows of labelled results; label is tp, fp, fn or none yet."""
    return json_table(spark, path, "checker string, group string, case string, file string, signature string, label string")


def _uncommented(line: str) -> str:
    """The line without its comment; a # within quotes, or right after a letter, is none."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[k - 1] == "\\") else quote
        elif c in "'\"" and (k == 0 or line[k - 1] in " \t:,[{-'"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1] in " \t"):
            return line[:k].rstrip()
    return line.rstrip()


def _unquoted(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    return text


def _flow_parts(text: str) -> list[str]:
    """What commas part within [...] or {...}, which may hold further ones and quoted texts."""
    parts, depth, quote, begin = [], 0, "", 1
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote and not (quote == '"' and text[k - 1] == "\\") else quote
        elif c in "'\"":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}" or (c == "," and depth == 1):
            depth -= c != ","
            if depth == (1 if c == "," else 0):
                parts.append(text[begin:k].strip())
                begin = k + 1
    return [p for p in parts if p]


def _flow(key: str, text: str) -> dict[str, str]:
    """The settings that a flow list or map writes in one line."""
    if not (text[:1] + text[-1:] in ("[]", "{}")):
        return {key: _unquoted(text)}
    out: dict[str, str] = {}
    for k, part in enumerate(_flow_parts(text)):
        name, mark, value = part.partition(":") if text[0] == "{" else (str(k), ":", part)
        if mark:
            out |= _flow(f"{key}.{_unquoted(name)}", value.strip())
    return out


def settings(path: str) -> dict[str, str]:
    """`key: value` settings; nested keys are joined by dots, list items are numbered from 0.

    Lists and maps in one line ([a, b], {k: v}) are named alike. Quoted texts may hold anything. Texts behind | keep their lines, those behind > become one line. A value or a whole block may have an anchor (&name), which
    *name repeats elsewhere; `<<: *name` takes a block's keys over.
    """
    out: dict[str, str] = {}
    stack: list[tuple[int, str]] = []  # (indent, key) of the blocks around a line
    items: dict[str, int] = {}
    anchors: dict[str, str] = {}

    def put(key: str, value: str) -> None:
        if value.startswith("&"):
            name, _, value = value[1:].partition(" ")
            anchors[name] = key
        if value.startswith("*") and value[1:] in anchors:
            source = anchors[value[1:]]
            to = key.removesuffix(".<<")
            out.update({to + k[len(source) :]: v for k, v in list(out.items()) if k == source or k.startswith(source + ".")})
        elif value:
            out.update(_flow(key, value.strip()))

    with open(path, encoding="utf-8") as f:
        lines = f.read().splitlines()
    k = 0
    while k < len(lines):
        text = _uncommented(lines[k])
        k += 1
        if not text.strip() or text.lstrip().startswith("#"):
            continue
        depth, body = len(text) - len(text.lstrip()), text.strip()
        while stack and (stack[-1][0] > depth or (stack[-1][0] == depth and not (body.startswith("- ") and not stack[-1][1].isdigit()))):
            stack.pop()
        if body.startswith("- "):
            around = ".".join(name for _, name in stack)
            number = items.get(around, 0)
            items[around] = number + 1
            body = body[2:].strip()
            if ":" not in body or body[0] in "'\"[{":
                put(f"{around}.{number}", body)
                continue
            stack.append((depth, str(number)))
            depth += 2
        key, mark, value = body.partition(":")
        if not mark:
            continue
        name, value = ".".join([*(x for _, x in stack), key]), value.strip()
        if value in ("|", ">"):
            block = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > depth):
                block.append(lines[k].strip())
                k += 1
            out[name] = ("\n" if value == "|" else " ").join(block).strip()
        elif value and not (value.startswith("&") and " " not in value):
            put(name, value)
        else:
            put(name, value)
            stack.append((depth, key))
    return out
