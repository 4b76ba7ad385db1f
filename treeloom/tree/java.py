"""A front end for a subset of Java: classes, methods, statements and expressions as trees with roles.

What the subset doesn't know becomes an Opaque node that spans it, so one odd statement doesn't lose the rest of a file. There
are no type bindings: expression types are known for literals, casts, creations and local names only, else "<UNKNOWN>".
"""

from __future__ import annotations

import re
from typing import NamedTuple

from treeloom.tree.nodes import Node

UNKNOWN_TYPE = "<UNKNOWN>"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<word>[A-Za-z_$][\w$]*)
      | (?P<string>"(?:\\.|[^"\\\n])*") | (?P<char>'(?:\\.|[^'\\\n])+')
      | (?P<number>0[xX][\da-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)
      | (?P<mark>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+\-*/&|^%]=|[-+*/%&|^!~?:;,.(){}\[\]<>=@])""",
    re.X | re.S,
)
PRIMITIVES = {"boolean", "byte", "char", "double", "float", "int", "long", "short", "void"}
MODIFIERS = {"abstract", "default", "final", "native", "private", "protected", "public", "static", "strictfp", "synchronized", "transient", "volatile"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}
LEVELS: tuple[set[str], ...] = ({"||"}, {"&&"}, {"|"}, {"^"}, {"&"}, {"==", "!="}, {"<", ">", "<=", ">="}, {"<<", ">>", ">>>"}, {"+", "-"}, {"*", "/", "%"})
_BINARY = frozenset().union(*LEVELS, {"instanceof"})
# The query language's keyword of each node type that has one.
DSL_TYPES = {
    "AnonymousClassDeclaration": "anonymousInnerClassExpression", "ArrayAccess": "arrayAccess", "ArrayCreation": "arrayCreationExpression",
    "ArrayInitializer": "initArrayExpression", "AssertStatement": "assertStatement", "Assignment": "binaryOperation", "BooleanLiteral": "literal",
    "BreakStatement": "breakStatement", "CastExpression": "castExpression", "CatchClause": "catchBlock", "CharacterLiteral": "literal",
    "ClassInstanceCreation": "objectCreationExpression", "ConditionalExpression": "ternaryOperation", "ConstructorInvocation": "thisCall",
    "ContinueStatement": "continueStatement", "CreationReference": "methodReferenceExpression", "DoStatement": "doWhileBlock",
    "EnhancedForStatement": "forEachBlock", "ExpressionMethodReference": "methodReferenceExpression", "FieldAccess": "fieldAccess",
    "ForStatement": "forBlock", "IfStatement": "ifBlock", "InfixExpression": "binaryOperation", "InstanceofExpression": "instanceofExpression",
    "LambdaExpression": "lambdaExpression", "MarkerAnnotation": "annotation", "MemberValuePair": "annoMember", "MethodDeclaration": "functionDeclaration",
    "MethodInvocation": "functionCall", "NormalAnnotation": "annotation", "NullLiteral": "nullLiteral", "NumberLiteral": "literal",
    "PostfixExpression": "unaryOperation", "PrefixExpression": "unaryOperation", "ReturnStatement": "returnStatement",
    "SingleMemberAnnotation": "annotation", "SingleVariableDeclaration": "valueDeclaration", "StringLiteral": "literal",
    "SuperConstructorInvocation": "superCall", "SuperFieldAccess": "fieldAccess", "SuperMethodInvocation": "functionCall", "SwitchCase": "caseStatement",
    "SwitchStatement": "switchBlock", "SynchronizedStatement": "synchronizedBlock", "ThisExpression": "thisExpression", "ThrowStatement": "throwStatement",
    "TryStatement": "exceptionBlock", "TypeMethodReference": "methodReferenceExpression", "VariableDeclarationExpression": "valueDeclaration",
    "VariableDeclarationStatement": "valueDeclaration", "WhileStatement": "whileBlock",
}
# Node types that are attributes of the node they belong to (its label, operator or flags), not nodes of their own.
ATTRIBUTE_ONLY = ("AssignmentOperator", "InfixOperator", "Modifier", "PostfixOperator", "PrefixOperator")
# Node types of comments, which the tokens leave out, and of groups that no tree holds.
LEFT_OUT = ("BlockComment", "Javadoc", "LineComment", "MethodInvocationArguments", "MethodInvocationTarget", "TagElement", "TextElement")


class Tok(NamedTuple):
    kind: str
    text: str
    line: int


class JavaError(ValueError):
    """A text that can't be read even as opaque parts."""


def _cut(source: str) -> tuple[list[str], list[str], list[int]]:
    """Kinds, texts and lines of the tokens."""
    kinds, texts, lines, at, line = [], [], [], 0, 1
    for m in _TOKEN.finditer(source):
        begin, end = m.span()
        if begin != at:
            break
        kind, text, at = m.lastgroup, source[begin:end], end
        if kind != "skip":
            kinds.append(kind)
            texts.append(text)
            lines.append(line)
        if kind in ("skip", "string", "char"):
            line += text.count("\n")
    if at < len(source):
        raise JavaError(f"line {line}: unexpected {source[at]!r}")
    return kinds, texts, lines


def java_tokens(source: str) -> list[Tok]:
    return list(map(Tok, *_cut(source)))


class _Stop(Exception):
    pass


class JavaParser:
    def __init__(self, source: str):
        self.kinds, self.texts, self.lines = _cut(source)
        self.n, self.i = len(self.texts), 0
        # they go on behind the last token, as far as anything looks ahead
        self.texts += [""] * 4
        self.kinds += ["end"] * 4
        self.scopes: list[dict[str, str]] = [{}]

    # tokens

    def text(self, ahead: int = 0) -> str:
        return self.texts[self.i + ahead]

    def kind(self, ahead: int = 0) -> str:
        return self.kinds[self.i + ahead]

    def line(self) -> int:
        return self.lines[min(self.i, self.n - 1)] if self.n else 1

    def take(self, text: str) -> bool:
        if self.texts[self.i] == text and self.kinds[self.i] in ("mark", "word"):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise _Stop(f"expected {text!r}, found {self.text()!r}")

    def ident(self) -> str:
        if self.kinds[self.i] != "word":
            raise _Stop(f"expected a name, found {self.text()!r}")
        self.i += 1
        return self.texts[self.i - 1]

    def node(self, kind: str, start: int, **kw) -> Node:
        return Node(kind, dsl_type=DSL_TYPES.get(kind), start_line=self.lines[start] if start < self.n else None, **kw)

    def done(self, n: Node, start: int) -> Node:
        n.end_line = self.lines[self.i - 1] if self.i else n.start_line
        n.own_tokens = self.texts[start : self.i]
        n.at = start
        return n

    def trying(self, f):
        at, scopes = self.i, [s.copy() for s in self.scopes]
        try:
            return f()
        except _Stop:
            self.i, self.scopes = at, scopes
            return None

    # declarations

    def unit(self) -> Node:
        root = self.node("CompilationUnit", 0)
        while self.kind() != "end":
            start = self.i
            if self.text() in ("package", "import"):
                kind = "PackageDeclaration" if self.text() == "package" else "ImportDeclaration"
                root.add(self.until(kind, {";"}), "declarations")
                continue
            made = self.trying(self.type_declaration) or self.trying(self.member)
            root.add(made or self.opaque(start), "types")
        return self.done(root, 0)

    def modifiers(self, owner: Node) -> None:
        while True:
            start = self.i
            if self.text() == "@" and self.text(1) != "interface":
                self.i += 1
                name = self.ident()
                while self.take("."):
                    name += "." + self.ident()
                kind = "MarkerAnnotation"
                if self.text() == "(":
                    kind = "NormalAnnotation" if self.kind(1) == "word" and self.text(2) == "=" else "SingleMemberAnnotation"
                    self.balanced("(", ")")
                n = self.node(kind, start, label=name, name=name.rpartition(".")[2])
                owner.add(self.done(n, start), "annotations", "Body")
            elif self.text() in MODIFIERS and not (self.text() == "synchronized" and self.text(1) == "(") and not (self.text() == "default" and self.text(1) in (":", "->")):
                word = self.ident()
                owner.flags["is" + word.capitalize()] = True
            else:
                return

    def balanced(self, left: str, right: str) -> None:
        depth = 0
        while self.kind() != "end":
            t = self.text()
            self.i += 1
            depth += (t == left) - (t == right)
            if depth == 0:
                return
        raise _Stop(f"no {right!r}")

    def until(self, kind: str, ends: set[str]) -> Node:
        start = self.i
        while self.kind() != "end" and self.text() not in ends:
            self.i += 1
        self.i = min(self.i + 1, self.n)
        text = " ".join(self.texts[start : self.i])
        return self.done(self.node(kind, start, label=text), start)

    def opaque(self, start: int) -> Node:
        """One statement or member that the subset doesn't know: up to its semicolon or closing brace."""
        self.i = start
        while self.kind() != "end":
            t = self.text()
            if t == "{":
                self.trying(lambda: self.balanced("{", "}")) or None
                if self.text(-1) != "}":
                    self.i = self.n
                break
            if t == "}" and self.i > start:
                break
            self.i += 1
            if t in (";", "}"):
                break
        n = self.node("Opaque", start, label=" ".join(self.texts[start : self.i]))
        return self.done(n, start)

    def type_declaration(self) -> Node:
        start = self.i
        n = self.node("TypeDeclaration", start)
        self.modifiers(n)
        word = self.text()
        if word not in ("class", "interface", "enum"):
            raise _Stop(word)
        self.i += 1
        n.node_type = "EnumDeclaration" if word == "enum" else "TypeDeclaration"
        n.name = self.ident()
        n.label = n.name
        if self.text() == "<":
            self.type_parameters(n)
        while self.kind() != "end" and self.text() != "{":
            self.i += 1
        self.need("{")
        self.scopes.append({})
        if word == "enum":
            while self.kind() == "word" or self.text() == "@":
                n.add(self.constant(), "enumConstants")
                self.take(",")
            while self.kind() != "end" and self.text() not in (";", "}"):
                self.i += 1
            self.take(";")
        self.members(n)
        self.scopes.pop()
        return self.done(n, start)

    def constant(self) -> Node:
        start = self.i
        n = self.node("EnumConstantDeclaration", start)
        self.modifiers(n)
        n.name = n.label = self.ident()
        if self.text() == "(":
            self.arguments(n)
        if self.text() == "{":
            n.add(self.anonymous(), "anonymousClassBody", "Body")
        return self.done(n, start)

    def anonymous(self) -> Node:
        at = self.i
        self.need("{")
        body = self.node("AnonymousClassDeclaration", at)
        self.scopes.append({})
        self.members(body)
        self.scopes.pop()
        return self.done(body, at)

    def type_parameters(self, owner: Node) -> None:
        """<T extends A & B, U> as TypeParameter nodes, or as plain tokens where they are something else."""

        def read() -> list[Node]:
            found = []
            self.need("<")
            while not self.take(">"):
                start = self.i
                p = self.node("TypeParameter", start)
                self.modifiers(p)
                p.name = p.label = self.ident()
                if self.take("extends"):
                    p.add(self.type(), "typeBounds")
                    while self.take("&"):
                        p.add(self.type(), "typeBounds")
                found.append(self.done(p, start))
                if not self.take(",") and self.text() != ">":
                    raise _Stop("not a type parameter")
            return found

        found = self.trying(read)
        if found is None:
            self.angles()
        for p in found or []:
            owner.add(p, "typeParameters")

    def members(self, owner: Node) -> None:
        while not self.take("}"):
            if self.kind() == "end":
                return
            if self.take(";"):
                continue
            start = self.i
            owner.add(self.trying(self.type_declaration) or self.trying(self.member) or self.opaque(start), "bodyDeclarations", "Body")

    def member(self) -> Node:
        start = self.i
        n = self.node("MethodDeclaration", start)
        self.modifiers(n)
        if self.text() == "{":
            n.node_type, n.dsl_type = "Initializer", None
            n.add(self.block(), "body", "Body")
            return self.done(n, start)
        if self.text() == "<":
            self.type_parameters(n)
        if not (self.kind() == "word" and self.text(1) == "("):
            n.add(self.type(), "type")
        n.name = self.ident()
        n.label = n.name
        if self.text() != "(":
            n.node_type, n.dsl_type = "FieldDeclaration", None
            self.scopes[0][n.name] = n.children[0].label if n.children else UNKNOWN_TYPE
            if self.take("="):
                n.add(self.initializer(), "initializer")
            while self.take(","):
                self.ident()
                if self.take("="):
                    n.add(self.initializer(), "initializer")
            self.need(";")
            return self.done(n, start)
        self.scopes.append({})
        self.parameters(n)
        while self.take("["):
            self.need("]")
        if self.take("throws"):
            n.add(self.type(), "exceptionTypes", "Collection")
            while self.take(","):
                n.add(self.type(), "exceptionTypes", "Collection")
        if not self.take(";"):
            n.add(self.block(), "body", "Body")
        self.scopes.pop()
        args = ",".join(p.props.get("type", UNKNOWN_TYPE) for p in n.children if p.role == "parameters")
        ret = next((c.label for c in n.children if c.role == "type"), "")
        n.props["signature"] = f"{ret}?{n.name}?{args}"
        return self.done(n, start)

    def parameters(self, owner: Node) -> None:
        self.need("(")
        while not self.take(")"):
            owner.add(self.parameter(), "parameters", "Collection")
            self.take(",")

    def parameter(self) -> Node:
        start = self.i
        p = self.node("SingleVariableDeclaration", start)
        self.modifiers(p)
        first = self.i
        kind = self.type()
        if self.text() == "|":
            union = self.node("UnionType", first, label=kind.label)
            union.add(kind, "types")
            while self.take("|"):
                union.label += "|" + union.add(self.type(), "types").label
            kind = self.done(union, first)
        p.add(kind, "type")
        if self.take("..."):
            kind.label += "..."
        p.name = self.ident()
        p.label = p.name
        while self.take("["):
            self.need("]")
            kind.label += "[]"
        p.props["type"] = kind.label
        self.scopes[-1][p.name] = kind.label
        return self.done(p, start)

    def angles(self) -> str:
        depth, out = 0, ""
        while True:
            t = self.text()
            if t not in ("<", ">", ",", "?", ".", "&", "[", "]", "extends", "super") and self.kind() != "word":
                raise _Stop("not a type")
            self.i += 1
            out += t
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return out

    def type(self) -> Node:
        start = self.i
        if self.text() in PRIMITIVES:
            n = self.node("PrimitiveType", start, label=self.ident())
        else:
            label = self.ident()
            generic = self.angles() if self.text() == "<" else ""
            while self.text() == "." and self.kind(1) == "word":
                self.i += 1
                label += "." + self.ident()
                generic += self.angles() if self.text() == "<" else ""
            n = self.node("ParameterizedType" if generic else "SimpleType", start, label=label + generic)
            if generic and self.texts[self.i - 1] != ">":
                n.node_type = "QualifiedType"
            elif generic:
                self.generics(n, start)
        while self.text() == "[" and self.text(1) == "]":
            self.i += 2
            n.node_type = "ArrayType"
            n.label += "[]"
        n.name = re.sub(r"<.*", "", n.label).rpartition(".")[2]
        return self.done(n, start)

    def generics(self, owner: Node, start: int) -> None:
        """The arguments of a parameterized type that has just been read, as types of their own."""
        end, self.i = self.i, start

        def read() -> list[Node]:
            found = []
            while self.text() != "<":
                self.i += 1
            self.need("<")
            while not self.take(">"):
                at = self.i
                if self.take("?"):
                    w = self.node("WildcardType", at, label="?")
                    if self.text() in ("extends", "super"):
                        w.label += " " + self.ident()
                        w.add(self.type(), "bound")
                    found.append(self.done(w, at))
                else:
                    found.append(self.type())
                if not self.take(",") and self.text() != ">":
                    raise _Stop("not a type argument")
            return found

        found = self.trying(read)
        whole = self.i == end
        self.i = end
        for n in found if found and whole else []:
            owner.add(n, "generics", "Collection")

    # statements

    def block(self) -> Node:
        start = self.i
        n = self.node("Block", start)
        self.need("{")
        self.scopes.append({})
        while not self.take("}"):
            if self.kind() == "end":
                raise _Stop("no '}'")
            at = self.i
            n.add(self.trying(self.statement) or self.opaque(at), "statements", "Body")
        self.scopes.pop()
        return self.done(n, start)

    def paren(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def statement(self) -> Node:
        start, word = self.i, self.text()
        if word == "{":
            return self.block()
        if word in ("class", "interface", "enum") or (word in ("abstract", "final") and self.text(1) == "class"):
            n = self.node("TypeDeclarationStatement", start)
            n.add(self.type_declaration(), "declaration")
            return self.done(n, start)
        if word == ";":
            self.i += 1
            return self.done(self.node("EmptyStatement", start), start)
        simple = {"if": self.if_, "while": self.while_, "do": self.do_, "for": self.for_, "switch": self.switch_, "try": self.try_, "synchronized": self.synchronized_}
        if self.kind() == "word" and word in simple:
            self.i += 1
            return self.done(simple[word](start), start)
        if word in ("return", "throw"):
            self.i += 1
            n = self.node("ReturnStatement" if word == "return" else "ThrowStatement", start)
            if self.text() != ";":
                n.add(self.expression(), "returnValue" if word == "return" else "operand")
            self.need(";")
            return self.done(n, start)
        if word in ("break", "continue"):
            self.i += 1
            n = self.node(word.capitalize() + "Statement", start, label=self.ident() if self.kind() == "word" else "")
            self.need(";")
            return self.done(n, start)
        if word == "assert":
            self.i += 1
            n = self.node("AssertStatement", start)
            n.add(self.expression(), "condition")
            if self.take(":"):
                n.add(self.expression(), "message")
            self.need(";")
            return self.done(n, start)
        if word in ("this", "super") and self.text(1) == "(":
            self.i += 1
            n = self.node("ConstructorInvocation" if word == "this" else "SuperConstructorInvocation", start)
            self.arguments(n)
            self.need(";")
            return self.done(n, start)
        if self.kind() == "word" and self.text(1) == ":" and word not in ("default", "case"):
            self.i += 2
            n = self.node("LabeledStatement", start, label=word)
            n.add(self.statement(), "body", "Body")
            return self.done(n, start)
        made = self.trying(lambda: self.variables("VariableDeclarationStatement", True)) if self.may_declare() else None
        if made:
            return made
        n = self.node("ExpressionStatement", start)
        n.add(self.expression(), "expression")
        self.need(";")
        return self.done(n, start)

    def may_declare(self) -> bool:
        """Whether what stands here can be a modifier, an annotation or a type with a name behind it."""
        if self.kind() != "word":
            return self.text() == "@"
        return self.text() in MODIFIERS or self.kind(1) == "word" or self.text(1) in ("<", ".", "[")

    def variables(self, kind: str, ends: bool) -> Node:
        start = self.i
        n = self.node(kind, start)
        self.modifiers(n)
        t = n.add(self.type(), "type")
        n.name = n.label = self.declared(n, t)
        while self.take(","):  # the first variable is the declaration's own, others are fragments of it
            at = self.i
            part = self.node("VariableDeclarationFragment", at)
            part.name = part.label = self.declared(part, t)
            n.add(self.done(part, at), "fragments")
        if ends:
            self.need(";")
        return self.done(n, start)

    def declared(self, owner: Node, kind: Node) -> str:
        """A variable's name; its dimensions and its initializer go to owner."""
        name = self.ident()
        while self.text() == "[" and self.text(1) == "]":
            at = self.i
            self.i += 2
            owner.add(self.done(self.node("Dimension", at, label="[]"), at), "extraDimensions")
        self.scopes[-1][name] = kind.label
        if self.take("="):
            owner.add(self.initializer(), "initializer")
        return name

    def initializer(self) -> Node:
        return self.array_values() if self.text() == "{" else self.expression()

    def array_values(self) -> Node:
        start = self.i
        n = self.node("ArrayInitializer", start, is_expr=True)
        self.need("{")
        while not self.take("}"):
            n.add(self.initializer(), "elements", "Collection")
            self.take(",")
        return self.done(n, start)

    def if_(self, start: int) -> Node:
        n = self.node("IfStatement", start)
        n.add(self.paren(), "condition")
        n.add(self.statement(), "thenBlock", "Body")
        if self.take("else"):
            n.add(self.statement(), "elseBlock", "Body")
        return n

    def while_(self, start: int) -> Node:
        n = self.node("WhileStatement", start)
        n.add(self.paren(), "condition")
        n.add(self.statement(), "body", "Body")
        return n

    def do_(self, start: int) -> Node:
        n = self.node("DoStatement", start)
        n.add(self.statement(), "body", "Body")
        self.need("while")
        n.add(self.paren(), "condition")
        self.need(";")
        return n

    def for_(self, start: int) -> Node:
        self.need("(")
        self.scopes.append({})

        def each():
            n = self.node("EnhancedForStatement", start)
            n.add(self.parameter(), "variable")
            self.need(":")
            n.add(self.expression(), "iterable")
            self.need(")")
            return n

        n = self.trying(each)
        if n is None:
            n = self.node("ForStatement", start)
            if not self.take(";"):
                made = self.trying(lambda: self.variables("VariableDeclarationExpression", False))
                n.add(made or self.expression(), "initialization")
                while self.take(","):
                    n.add(self.expression(), "initialization")
                self.need(";")
            if not self.take(";"):
                n.add(self.expression(), "condition")
                self.need(";")
            while not self.take(")"):
                n.add(self.expression(), "iteration")
                self.take(",")
        n.add(self.statement(), "body", "Body")
        self.scopes.pop()
        return n

    def switch_(self, start: int) -> Node:
        n = self.node("SwitchStatement", start)
        n.add(self.paren(), "selector")
        self.need("{")
        while not self.take("}"):
            at = self.i
            if self.text() in ("case", "default"):
                c = self.node("SwitchCase", at)
                if self.ident() == "case":
                    c.add(self.ternary(), "caseExpression")
                else:
                    c.dsl_type = "defaultStatement"
                self.need(":")
                n.add(self.done(c, at), "body", "Body")
            else:
                n.add(self.trying(self.statement) or self.opaque(at), "body", "Body")
        return n

    def try_(self, start: int) -> Node:
        n = self.node("TryStatement", start)
        self.scopes.append({})
        if self.take("("):
            n.dsl_type = "tryWithResources"
            while not self.take(")"):
                made = self.trying(lambda: self.variables("VariableDeclarationExpression", False))
                n.add(made or self.expression(), "resources", "Body")
                self.take(";")
        n.add(self.block(), "tryBlock", "Body")
        self.scopes.pop()
        while self.text() == "catch":
            at = self.i
            self.i += 1
            c = self.node("CatchClause", at)
            self.scopes.append({})
            self.parameters(c)
            c.add(self.block(), "body", "Body")
            self.scopes.pop()
            n.add(self.done(c, at), "catchBlocks", "Body")
        if self.take("finally"):
            n.add(self.block(), "finallyBlock", "Body")
        return n

    def synchronized_(self, start: int) -> Node:
        n = self.node("SynchronizedStatement", start)
        n.add(self.paren(), "lock")
        n.add(self.block(), "body", "Body")
        return n

    # expressions

    def made(self, kind: str, start: int, parts: list[tuple[str, Node]], **kw) -> Node:
        n = self.node(kind, start, is_expr=True, **kw)
        n.expr_type = n.expr_type or UNKNOWN_TYPE
        for role, part in parts:
            n.add(part, role, "Collection" if role in ("arguments", "dimensions", "parameters") else "Child")
        return self.done(n, start)

    def expression(self) -> Node:
        start = self.i
        if self.texts[start] == "(" or self.texts[start + 1] == "->":
            made = self.trying(self.lambda_)
            if made:
                return made
        left = self.ternary()
        if self.text() in ASSIGN:
            op = self.text()
            self.i += 1
            return self.made("Assignment", start, [("lhs", left), ("rhs", self.initializer())], label=op, props={"operator": op}, expr_type=left.expr_type)
        return left

    def lambda_(self) -> Node:
        start = self.i
        params: list[Node] = []
        self.scopes.append({})
        try:
            if self.take("("):
                while not self.take(")"):
                    p = self.trying(self.parameter) or self.done(self.node("SimpleName", self.i, label=self.text(), name=self.ident()), self.i - 1)
                    params.append(p)
                    self.take(",")
            else:
                at = self.i
                name = self.ident()
                params.append(self.done(self.node("SimpleName", at, label=name, name=name), at))
            self.need("->")
            body = self.block() if self.text() == "{" else self.expression()
        finally:
            self.scopes.pop()
        return self.made("LambdaExpression", start, [*(("parameters", p) for p in params), ("body", body)])

    def ternary(self) -> Node:
        start = self.i
        c = self.binary(0)
        if not self.take("?"):
            return c
        yes = self.expression()
        self.need(":")
        return self.made("ConditionalExpression", start, [("condition", c), ("thenExpression", yes), ("elseExpression", self.expression())])

    def operator(self, level: int) -> str | None:
        t = self.text()
        if self.kind() != "mark":
            return None
        if t == ">" and self.text(1) == ">" and level == 7:
            return ">>>" if self.text(2) == ">" else ">>"
        if t == "<" and self.text(1) == "<" and level == 7:
            return "<<"
        if t in "<>" and self.text(1) == t:
            return None
        return t if t in LEVELS[level] else None

    def binary(self, level: int) -> Node:
        """Operators of a level and those that bind closer, the closest first."""
        start = self.i
        left = self.unary()
        if self.texts[self.i] not in _BINARY:
            return left
        for k in range(len(LEVELS) - 1, level - 1, -1):
            left = self.operations(k, start, left)
        return left

    def operations(self, level: int, start: int, left: Node) -> Node:
        while True:
            if level == 6 and self.text() == "instanceof":
                self.i += 1
                left = self.made("InstanceofExpression", start, [("lhs", left), ("rhs", self.type())], label="instanceof", expr_type="boolean")
                continue
            op = self.operator(level)
            if op is None:
                return left
            self.i += len(op) if level == 7 else 1
            right = self.binary(level + 1)
            kind = "boolean" if level in (0, 1, 5, 6) else "String" if op == "+" and "String" in (left.expr_type, right.expr_type) else left.expr_type
            left = self.made("InfixExpression", start, [("lhs", left), ("rhs", right)], label=op, props={"operator": op}, expr_type=kind)

    def unary(self) -> Node:
        start, t = self.i, self.text()
        if self.kind() == "mark" and t in ("+", "-", "++", "--", "!", "~"):
            self.i += 1
            part = self.unary()
            return self.made("PrefixExpression", start, [("operand", part)], label=t, props={"operator": t}, expr_type="boolean" if t == "!" else part.expr_type)
        if t == "(":
            made = self.trying(self.cast)
            if made:
                return made
        return self.postfix(self.primary(), start)

    def cast(self) -> Node:
        start = self.i
        self.need("(")
        first = self.i
        kind = self.type()
        if self.text() == "&":
            both = self.node("IntersectionType", first, label=kind.label)
            both.add(kind, "types")
            while self.take("&"):
                both.label += "&" + both.add(self.type(), "types").label
            kind = self.done(both, first)
        self.need(")")
        if kind.node_type != "PrimitiveType" and not (self.kind() in ("word", "string", "char", "number") or self.text() in ("(", "!", "~")):
            raise _Stop("not a cast")
        if self.text() == "instanceof":
            raise _Stop("not a cast")
        return self.made("CastExpression", start, [("castType", kind), ("operand", self.unary())], expr_type=kind.label)

    def arguments(self, owner: Node) -> None:
        self.need("(")
        while not self.take(")"):
            owner.add(self.expression(), "arguments", "Collection")
            self.take(",")

    def literal(self, kind: str, expr_type: str) -> Node:
        start = self.i
        t = self.text()
        self.i += 1
        return self.made(kind, start, [], label=t, value=t, props={"value": t}, expr_type=expr_type)

    def primary(self) -> Node:
        start, t, kind = self.i, self.text(), self.kind()
        if kind == "number":
            return self.literal("NumberLiteral", "double" if re.search(r"[.dDfF]|[eE]", t) and not t.lower().startswith("0x") else "long" if t[-1] in "lL" else "int")
        if kind == "string":
            return self.literal("StringLiteral", "String")
        if kind == "char":
            return self.literal("CharacterLiteral", "char")
        if t in ("true", "false"):
            return self.literal("BooleanLiteral", "boolean")
        if t == "null":
            self.i += 1
            return self.made("NullLiteral", start, [], label="null", value="null")
        if t == "(":
            return self.made("ParenthesizedExpression", start, [("expression", self.paren())])
        if t == "this":
            self.i += 1
            return self.made("ThisExpression", start, [], label="this")
        if t == "super":
            self.i += 1
            if self.take("::"):
                name = self.ident()
                return self.made("SuperMethodReference", start, [], label=name, name=name)
            self.need(".")
            name = self.ident()
            n = self.node("SuperMethodInvocation" if self.text() == "(" else "SuperFieldAccess", start, label=name, name=name, is_expr=True, expr_type=UNKNOWN_TYPE)
            if self.text() == "(":
                self.arguments(n)
            return self.done(n, start)
        if t == "new":
            return self.creation()
        if kind != "word" or t in ("if", "else", "for", "while", "return", "case", "default", "instanceof"):
            raise _Stop(f"expected an expression, found {t!r}")
        if t in PRIMITIVES:
            n = self.type()
            if self.take("::"):
                name = self.ident()
                return self.made("CreationReference" if name == "new" else "TypeMethodReference", start, [("type", n)], label=name, name=name)
            self.need(".")
            self.need("class")
            return self.made("TypeLiteral", start, [("type", n)], label=n.label + ".class", expr_type="Class")
        name = self.ident()
        if self.text() == "(":
            n = self.node("MethodInvocation", start, label=name, name=name, is_expr=True, expr_type=UNKNOWN_TYPE)
            self.arguments(n)
            return self.done(n, start)
        known = next((s[name] for s in reversed(self.scopes) if name in s), UNKNOWN_TYPE)
        return self.made("SimpleName", start, [], label=name, name=name, expr_type=known)

    def creation(self) -> Node:
        start = self.i
        self.need("new")
        base = self.i
        label = self.ident()
        while self.text() == "." and self.kind(1) == "word":
            self.i += 1
            label += "." + self.ident()
        if self.text() == "<":
            self.angles()
        kind = self.done(self.node("PrimitiveType" if label in PRIMITIVES else "SimpleType", base, label=label, name=label.rpartition(".")[2]), base)
        if self.text() == "[":
            n = self.node("ArrayCreation", start, is_expr=True, expr_type=label + "[]")
            n.add(kind, "type")
            while self.take("["):
                if not self.take("]"):
                    n.add(self.expression(), "dimensions", "Collection")
                    self.need("]")
            if self.text() == "{":
                n.add(self.array_values(), "initArray")
            return self.done(n, start)
        n = self.node("ClassInstanceCreation", start, label=label, is_expr=True, expr_type=label)
        n.add(kind, "type")
        self.arguments(n)
        if self.text() == "{":
            n.add(self.anonymous(), "anonymousClassBody", "Body")
        return self.done(n, start)

    def postfix(self, left: Node, start: int) -> Node:
        while True:
            if self.text() == "." and self.kind(1) == "word":
                self.i += 1
                if self.text() == "new":
                    raise _Stop("inner creation")
                name = self.ident()
                if self.text() == "(":
                    n = self.node("MethodInvocation", start, label=name, name=name, is_expr=True, expr_type=UNKNOWN_TYPE)
                    n.add(left, "base")
                    self.arguments(n)
                    left = self.done(n, start)
                elif name == "this":
                    left = self.made("ThisExpression", start, [], label="this")
                elif name == "class":
                    left = self.made("TypeLiteral", start, [("type", left)], label=f"{left.label}.class", expr_type="Class")
                else:
                    kind = "QualifiedName" if left.node_type in ("SimpleName", "QualifiedName") else "FieldAccess"
                    label = f"{left.label}.{name}" if kind == "QualifiedName" else name
                    left = self.made(kind, start, [("base", left)] if kind == "FieldAccess" else [], label=label, name=name)
            elif self.text() == "[" and self.text(1) != "]":
                self.i += 1
                index = self.expression()
                self.need("]")
                left = self.made("ArrayAccess", start, [("base", left), ("arrayIndex", index)], expr_type=(left.expr_type or "").removesuffix("[]") or UNKNOWN_TYPE)
            elif self.text() in ("++", "--"):
                op = self.text()
                self.i += 1
                left = self.made("PostfixExpression", start, [("operand", left)], label=op, props={"operator": op}, expr_type=left.expr_type)
            elif self.text() == "::":
                self.i += 1
                name = self.ident()
                kind = "CreationReference" if name == "new" else "ExpressionMethodReference"
                left = self.made(kind, start, [("base", left)], label=name, name=name)
            else:
                return left


def parse_unit(source: str) -> Node:
    """The tree of a compilation unit; raises JavaError for texts that have no tokens or can't be cut into tokens."""
    p = JavaParser(source)
    if not p.n:
        raise JavaError("empty")
    return p.unit()


def parse_method(source: str) -> Node:
    """The first method of a text: a class, or a method that stands alone."""
    stack = [parse_unit(source)]
    while stack:
        n = stack.pop(0)
        if n.node_type == "MethodDeclaration":
            return n
        stack = n.children + stack
    raise JavaError("no method")


def signature(text: str) -> tuple[str | None, str, list[str]]:
    """(return type, name, argument types) of a method's header as text."""
    m = parse_method(text.rstrip().rstrip(";{").rstrip() + " {}")
    ret = next((c.label for c in m.children if c.role == "type"), None)
    return ret, m.name, [p.props["type"] for p in m.children if p.role == "parameters"]


def text_of(node: Node) -> str:
    """A subtree's source text, one space between tokens."""
    return " ".join(node.own_tokens)
