"""One-shot refinement: a whole new query in one recorded answer, taken if the grammar and the vocabulary accept it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from treeloom.dsl.analyzer import validate
from treeloom.dsl.parser import try_parse
from treeloom.dsl.printer import show
from treeloom.dsl.vocabulary import Vocabulary

REFINED, UNCHANGED, INVALID = "refined", "unchanged", "invalid"
_FENCED = re.compile(r"```[a-z]*[ \t]*\n(.*?)```", re.DOTALL)
_BARE = re.compile(r"[a-zA-Z_]\w*(?:[ \t]+\w+)?\s+where\s.*?;", re.DOTALL)


def proposed(answer: str | None) -> str | None:
    """The query that an answer proposes: its last fenced block, else its first `type alias where ...;`."""
    fenced = _FENCED.findall(answer or "")
    if fenced:
        return fenced[-1].strip()
    bare = _BARE.search(answer or "")
    return bare[0] if bare else None


def refine_once(query: str, answer: str | None, v: Vocabulary) -> tuple[str, str, str]:
    """(query, status, message): the proposed query in one line, or the given one and why it stays."""
    text = proposed(answer)
    if text is None:
        return query, UNCHANGED, "the answer has no query"
    q, error = try_parse(text)
    if q is None:
        return query, INVALID, error.message
    bad = [f.message for f in validate(q, v) if f.severity == "error"]
    return (query, INVALID, "; ".join(bad)) if bad else (" ".join(show(q).split()), REFINED, "")


def refined_once(answers: DataFrame, v: Vocabulary) -> DataFrame:
    """(query_id, refined, status, message) of (query_id, query, answer) rows; a null answer changes nothing."""
    kind = answers.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *refine_once(query or "", answer, v)) for key, query, answer in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["query_id", "refined", "status", "message"])

    return answers.select("query_id", "query", "answer").mapInPandas(run, f"query_id {kind}, refined string, status string, message string")
