"""Python functions of a specification's `python:` blocks. They run as they stand: load trusted specifications only."""

from __future__ import annotations

import inspect
from dataclasses import dataclass

_SORTS = {str: "String", int: "Int", float: "Real", bool: "Bool"}


@dataclass(frozen=True)
class PyFunction:
    name: str
    args: tuple[str, ...]
    result: str
    source: str

    def callable(self):
        space: dict = {}
        exec(self.source, space)  # noqa: S102
        return space[self.name]


def load_functions(blocks: list[str]) -> dict[str, PyFunction]:
    """The functions that the blocks define; each argument and result needs an annotation str, int, float or bool."""
    import ast
    import textwrap

    source = "\n".join(textwrap.dedent(b) for b in blocks)
    if not source.strip():
        return {}
    space: dict = {}
    exec(compile(source, "<python block>", "exec"), space)  # noqa: S102
    out = {}
    for node in ast.parse(source).body:
        if not isinstance(node, ast.FunctionDef):
            continue
        signature = inspect.signature(space[node.name], eval_str=True)
        args = []
        for p in signature.parameters.values():
            if p.kind not in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) or p.annotation not in _SORTS:
                raise ValueError(f"function {node.name}: argument {p.name} needs an annotation str, int, float or bool")
            args.append(_SORTS[p.annotation])
        if signature.return_annotation not in _SORTS:
            raise ValueError(f"function {node.name}: the result needs an annotation str, int, float or bool")
        out[node.name] = PyFunction(node.name, tuple(args), _SORTS[signature.return_annotation], source)
    return out
