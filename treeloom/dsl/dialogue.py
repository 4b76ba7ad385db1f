"""Refining a query as a dialogue: analyse the query, analyse a false positive, extract constraints, validate them, construct.

Who answers is a function of the caller's (a model, a person, a table of recorded answers); what is asked is named by its step.
The context after each step can be stored, and a stored one taken up again where constructing starts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from treeloom.dsl import rewrite
from treeloom.dsl.parser import parse
from treeloom.dsl.printer import show
from treeloom.dsl.vocabulary import Vocabulary

STEPS = ("analyse_query", "analyse_false_positive", "extract", "validate", "construct")


@dataclass
class Dialogue:
    query: str
    answer: Callable[[str, dict[str, str]], str]
    vocabulary: Vocabulary
    save: Callable[[str, dict[str, str]], None] = lambda step, context: None
    context: dict[str, str] = field(default_factory=dict)
    rounds: int = 3

    def run(self, start: str = STEPS[0]) -> str:
        """The refined query. start: the first step, or construct with a stored context."""
        if start not in (STEPS[0], STEPS[-1]):
            raise ValueError(f"a dialogue starts at {STEPS[0]} or {STEPS[-1]}")
        for step in STEPS[STEPS.index(start) :]:
            getattr(self, step)()
            self.save(step, self.context)
        return self.context["refined"]

    def analyse_query(self) -> None:
        self.context["query_analysis"] = self.answer("analyse_query", self.context | {"query": self.query})

    def analyse_false_positive(self) -> None:
        self.context["false_positive_analysis"] = self.answer("analyse_false_positive", self.context)

    def extract(self) -> None:
        self.context["constraints"] = self.answer("extract", self.context)

    def validate(self) -> None:
        def repair(c: rewrite.Constraint, message: str) -> rewrite.Constraint | None:
            found = rewrite.extract(self.answer("repair", self.context | {"constraint": as_text([c]), "message": message}))
            return found[0] if found else None

        found = rewrite.classify(rewrite.extract(self.context["constraints"]), parse(self.query), self.vocabulary, repair, self.rounds)
        self.context["valid"] = as_text(found[rewrite.VALID])

    def construct(self) -> None:
        self.context["refined"] = show(rewrite.merge(parse(self.query), rewrite.extract(self.context["valid"])))


def as_text(constraints: list[rewrite.Constraint]) -> str:
    """Constraints in the layout that rewrite.extract() reads."""
    parts = []
    for c in constraints:
        lines = [f"- Type: {c.action}", f"- Path: {c.path}", f"- Operator: {c.op}", f"- Value: {c.value}", f"- Is Negative: {str(c.negative).lower()}"]
        parts.append("\n".join(lines + ([f"- Original Value: {c.original}"] if c.original else [])))
    return "\n\n".join(parts)
