"""What a query may name: node types, properties, how properties are walked, flags."""

from __future__ import annotations

from dataclasses import dataclass, field

CHILD, SIMPLE, BODY, COLLECTION = "Child", "Simple", "Body", "Collection"


@dataclass(frozen=True)
class Vocabulary:
    """actions: how a property is walked (properties without one count as Child); type_properties: what a type is known to
    have; unsupported: (type, property) that can't be asked; hints: (property, value) to the node type meant by it."""

    name: str
    types: frozenset[str]
    properties: frozenset[str]
    actions: dict[str, str] = field(default_factory=dict)
    type_properties: dict[str, frozenset[str]] = field(default_factory=dict)
    flags: frozenset[str] = frozenset()
    synonyms: dict[str, str] = field(default_factory=dict)
    unsupported: frozenset[tuple[str, str]] = frozenset()
    hints: dict[tuple[str, str], str] = field(default_factory=dict)

    def canonical(self, prop: str) -> str:
        return self.synonyms.get(prop, prop)

    def action(self, prop: str) -> str:
        return self.actions.get(self.canonical(prop), CHILD)

    def knows(self, prop: str) -> bool:
        return prop in self.properties or prop in self.flags or prop in self.synonyms

    def rows(self) -> list[tuple[str, str, str]]:
        """(kind, name, detail) rows, for a lookup table."""
        out = [("type", t, "") for t in sorted(self.types)]
        out += [("property", p, self.action(p)) for p in sorted(self.properties)]
        return out + [("flag", f, "") for f in sorted(self.flags)]


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Fixed values of the query language for Java methods.
JAVA_TYPES = _words(
    "annoMember annotation anonymousInnerClassExpression arrayAccess arrayCreationExpression assertStatement binaryOperation "
    "breakStatement caseStatement castExpression catchBlock continueStatement defaultStatement doWhileBlock exceptionBlock "
    "fieldAccess finallyBlock forBlock forEachBlock functionCall functionDeclaration ifBlock initArrayExpression "
    "instanceofExpression lambdaExpression literal methodReferenceExpression nullLiteral objectCreationExpression "
    "returnStatement superCall switchBlock synchronizedBlock ternaryOperation thisCall thisExpression throwStatement tryBlock "
    "tryWithResources unaryOperation valueDeclaration whileBlock"
)
JAVA_COLLECTIONS = _words("arguments dimensions elements exceptionTypes generics parameters")
JAVA_BODIES = _words("annoMembers annotations anonymousClassBody body catchBlocks elseBlock finallyBlock resources thenBlock tryBlock")
JAVA_SIMPLES = _words("name primitiveTypeCode value")
JAVA_CHILDREN = _words(
    "annoValue arrayIndex base baseType caseExpression castType condition elseExpression initArray initialization initializer "
    "iterable iteration lhs lock message operand operator returnValue rhs selector thenExpression type variable"
)
JAVA_SYNONYMS = {
    "assertMessage": "message",
    "forEachIterable": "iterable",
    "forEachVariable": "variable",
    "forInit": "initialization",
    "forIter": "iteration",
    "returnType": "type",
    "switchSelector": "selector",
    "throwExceptionTypes": "exceptionTypes",
    "tryResources": "resources",
    "variableInit": "initializer",
}
JAVA_FLAGS = _words("isAbstract isDefault isFinal isNative isPrivate isProtected isPublic isStatic isSynchronized isTransient isVolatile")
JAVA_TYPE_PROPERTIES = {
    "annotation": "annoMembers annoValue",
    "arrayAccess": "arrayIndex base",
    "arrayCreationExpression": "dimensions initArray",
    "binaryOperation": "lhs operator rhs",
    "caseStatement": "caseExpression",
    "castExpression": "castType operand",
    "catchBlock": "body parameters",
    "exceptionBlock": "catchBlocks finallyBlock tryBlock",
    "fieldAccess": "base name",
    "forBlock": "body condition initialization iteration",
    "forEachBlock": "body iterable variable",
    "functionCall": "arguments base name",
    "functionDeclaration": "annotations body exceptionTypes name parameters type",
    "ifBlock": "condition elseBlock thenBlock",
    "initArrayExpression": "elements",
    "instanceofExpression": "lhs rhs",
    "lambdaExpression": "body parameters",
    "literal": "value",
    "objectCreationExpression": "arguments type",
    "returnStatement": "returnValue",
    "switchBlock": "body selector",
    "ternaryOperation": "condition elseExpression thenExpression",
    "throwStatement": "operand",
    "tryBlock": "catchBlocks finallyBlock tryBlock",
    "tryWithResources": "catchBlocks finallyBlock resources tryBlock",
    "unaryOperation": "operand operator",
    "valueDeclaration": "initializer name type",
    "whileBlock": "body condition",
}

JAVA = Vocabulary(
    name="java",
    types=JAVA_TYPES,
    properties=JAVA_COLLECTIONS | JAVA_BODIES | JAVA_SIMPLES | JAVA_CHILDREN,
    actions={p: a for words, a in ((JAVA_COLLECTIONS, COLLECTION), (JAVA_BODIES, BODY), (JAVA_SIMPLES, SIMPLE), (JAVA_CHILDREN, CHILD)) for p in words},
    type_properties={t: _words(p) for t, p in JAVA_TYPE_PROPERTIES.items()},
    flags=JAVA_FLAGS,
    synonyms=JAVA_SYNONYMS,
    hints={("operator", "instanceof"): "instanceofExpression"},
)
#: The stricter rule under which operators can't be asked for.
JAVA_STRICT = Vocabulary(
    **{**vars(JAVA), "name": "java-strict", "unsupported": frozenset((t, "operator") for t in ("binaryOperation", "postfixOperation", "prefixOperation", "unaryOperation"))}
)
