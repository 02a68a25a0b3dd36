"""Trees of Python files, as its own parser makes them."""

from __future__ import annotations

import ast

#: Operators, and how a value is used: no extractor asks for them.
_USES = (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)
#: Nodes that hold no others, more than half of all.
_LEAVES = {ast.Name, ast.Constant, ast.alias, ast.Pass}


def nodes_of(tree: ast.AST) -> list[ast.AST]:
    """The nodes of a tree in the order of ``ast.walk``, without operators and contexts."""
    out = [tree]
    for node in out:
        if type(node) in _LEAVES:
            continue
        held = node.__dict__
        for name in node._fields:
            value = held.get(name)
            if type(value) is list:
                out += [x for x in value if isinstance(x, ast.AST) and not isinstance(x, _USES)]
            elif isinstance(value, ast.AST) and not isinstance(value, _USES):
                out.append(value)
    return out


def source_of(node: ast.AST) -> str:
    """``ast.unparse``; dotted names, which are nearly all that is asked, are put together at once."""
    if type(node) is ast.Name:
        return node.id
    if type(node) is ast.Attribute and type(node.value) in (ast.Name, ast.Attribute):
        return f"{source_of(node.value)}.{node.attr}"
    return ast.unparse(node)
