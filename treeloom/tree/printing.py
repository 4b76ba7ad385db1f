"""Source text of trees that were edited.

A node that came from a source knows its tokens and where among them its children's stand. Its text is printed from what is left
between them: a head before the children of a role, what stands between two of them, and a tail. Children that came or went
are printed or left out within their role; commas come and go with them.
"""

from __future__ import annotations

from treeloom.tree.nodes import Node

CLOSERS = {")", "}", ";", "]"}
# Roles whose children are separated by commas, and words that go with a child.
LISTED = {"arguments", "parameters", "elements", "exceptionTypes", "iteration"}
LEADS = {"elseBlock": ["else"], "exceptionTypes": ["throws"], "finallyBlock": ["finally"], "initializer": ["="]}


def gaps(node: Node) -> list[list[str]]:
    """The node's own tokens before its first child, between its children and after the last one."""
    out, at = [], 0
    for c in node.children:
        begin = c.at - node.at
        out.append(node.own_tokens[at:begin])
        at = begin + len(c.own_tokens)
    return [*out, node.own_tokens[at:]]


def _renamed(between: list[list[str]], old: str, new: str) -> list[list[str]]:
    """The tokens with the first one that is the old label as the new one."""
    out, done = [], False
    for part in between:
        fresh = []
        for t in part:
            fresh.append(new if t == old and not done else t)
            done = done or t == old
        out.append(fresh)
    return out


def _runs(node: Node) -> tuple[list[tuple[str, list[str], list]], list[str]]:
    """(role, head, [(child, what stands before it within the run)]) of children next to each other in one role, and the tail."""
    between = gaps(node)
    runs: list[tuple[str, list[str], list]] = []
    for c, lead in zip(node.children, between, strict=False):
        if runs and runs[-1][0] == c.role:
            runs[-1][2].append((c, lead))
        else:
            runs.append((c.role, list(lead), [(c, None)]))
    return runs, list(between[-1])


def _with_new_roles(out: list, tail: list[str], kids: list) -> list:
    """out and tail (tokens, and Items for children) with children in roles that the node had none of."""
    parts = [*out, *tail]
    for role in dict.fromkeys(k.role for k in kids):
        own: list = []
        for k in (k for k in kids if k.role == role):
            own += [",", k] if own and role in LISTED else [k]
        pair = [i for i in range(1, len(parts)) if parts[i - 1] == "(" and parts[i] == ")"]
        body = [i for i, x in enumerate(parts) if not isinstance(x, str) and x.role == "body"]
        if role == "base":
            parts = [*own, ".", *parts]
        elif role in ("arguments", "parameters") and pair:
            parts[pair[-1 if role == "arguments" else 0] : pair[-1 if role == "arguments" else 0]] = own
        elif role == "exceptionTypes" and body:
            parts[body[0] : body[0]] = [*LEADS[role], *own]
        else:
            at = len(parts)
            while at and isinstance(parts[at - 1], str) and parts[at - 1] in CLOSERS:
                at -= 1
                if role not in LISTED and parts[at] == ";":
                    break
            parts[at:at] = [*LEADS.get(role, []), *own]
    return parts


def tokens_of(item) -> list[str]:
    """The tokens of an edited item (treediff.Item) by the node it came from; without one only its label is known."""
    node = item.origin
    if node is None:
        return [*([item.label] if item.label else []), *(t for k in item.kids for t in tokens_of(k))]
    if item.whole and node.own_tokens:
        return node.own_tokens
    changed = item.label != (node.label or "")
    if not node.children and not item.kids:
        new = _renamed([node.own_tokens], node.label, item.label)[0] if changed else list(node.own_tokens)
        return new if new != node.own_tokens or not changed else [item.label]
    runs, tail = _runs(node)
    if changed:
        *heads, tail = _renamed([*(head for _, head, _ in runs), tail], node.label, item.label)
        runs = [(role, head, members) for (role, _, members), head in zip(runs, heads, strict=True)]
    run_of = {id(c): j for j, (_, _, members) in enumerate(runs) for c, _ in members}
    lead_of = {id(c): lead for _, _, members in runs for c, lead in members}
    dealt: list[list] = [[] for _ in runs]
    loose, last = [], 0
    for kid in item.kids:  # a child goes to its own run, else to the next one of its role
        j = run_of.get(id(kid.origin))
        if j is None or runs[j][0] != kid.role:
            j = min((j for j, r in enumerate(runs) if r[0] == kid.role), key=lambda j: (j < last, abs(j - last)), default=None)
        if j is None:
            loose.append(kid)
        else:
            dealt[j].append(kid)
            last = j
    out: list = []
    left_out = False  # the object of a call or field went: its dot goes, too
    for (role, head, _), kids in zip(runs, dealt, strict=True):
        head = head[1:] if left_out and head[:1] == ["."] else head
        left_out = role == "base" and not kids
        if not kids and head[-1:] == LEADS.get(role):
            head = head[:-1]  # the word goes with its child
        out += head
        for k, kid in enumerate(kids):
            if k:
                lead = lead_of.get(id(kid.origin))
                out += lead if lead is not None else [","] if role in LISTED else []
            out.append(kid)
    tail = tail[1:] if left_out and tail[:1] == ["."] else tail
    parts = _with_new_roles(out, tail, loose) if loose else [*out, *tail]
    return [t for x in parts for t in ([x] if isinstance(x, str) else tokens_of(x))]


def source_of(top) -> str:
    """The source text below an artificial root, one space between tokens."""
    return " ".join(t for k in top.kids for t in tokens_of(k))
