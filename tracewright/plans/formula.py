"""Terms, formulas and specifications as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

PAST, FUTURE = {"@", "P", "H", "S", "Z", "I"}, {"X", "F", "G", "U"}


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: object
    sort: str


@dataclass(frozen=True)
class Arith:
    """left op right with op one of + - *; unary minus is 0 - right."""

    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    """A Python function of the specification on terms."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Bound:
    """A time bound; each end is an int, a name or (high only) None for no end. text is as written."""

    low: object
    high: object
    text: str = ""


@dataclass(frozen=True)
class Truth:
    value: bool


@dataclass(frozen=True)
class Pred:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Compare:
    """left op right with op one of = < <= > >= contains."""

    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Matches:
    """subject matches pattern; slashed patterns are regular expressions with holes. holes maps a hole to a term."""

    subject: object
    pattern: str
    slashed: bool
    holes: tuple = ()  # (hole name, term) pairs, in order of first occurrence


@dataclass(frozen=True)
class Not:
    body: object


@dataclass(frozen=True)
class Logic:
    """left op right with op one of & | -> <->."""

    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Quant:
    kind: str  # Exists or Forall
    var: str
    body: object


@dataclass(frozen=True)
class Temporal:
    """op one of @ X P H F G (right only), S Z U, and I for the interval [left, right)."""

    op: str
    left: object
    right: object
    bound: Bound | None = None


@dataclass
class Property:
    name: str
    formula: object
    anchored: bool = False


@dataclass
class Macro:
    name: str
    params: tuple[str, ...]
    body: object


@dataclass
class Spec:
    preds: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)
    macros: dict[str, Macro] = field(default_factory=dict)
    properties: dict[str, Property] = field(default_factory=dict)
    python: list[str] = field(default_factory=list)


def children(f) -> tuple:
    """Direct subformulas."""
    if isinstance(f, (Not, Quant)):
        return (f.body,)
    if isinstance(f, Logic):
        return (f.left, f.right)
    if isinstance(f, Temporal):
        return (f.right,) if f.left is None else (f.left, f.right)
    return ()


def rebuilt(f, parts: tuple):
    """f with other direct subformulas."""
    if isinstance(f, (Not, Quant)):
        return replace(f, body=parts[0])
    if isinstance(f, Logic):
        return replace(f, left=parts[0], right=parts[1])
    if isinstance(f, Temporal):
        return replace(f, right=parts[0]) if f.left is None else replace(f, left=parts[0], right=parts[1])
    return f


def term_vars(t) -> set[str]:
    if isinstance(t, Var):
        return {t.name}
    if isinstance(t, Arith):
        return term_vars(t.left) | term_vars(t.right)
    if isinstance(t, Call):
        return set().union(*(term_vars(a) for a in t.args)) if t.args else set()
    return set()


def terms(f) -> tuple:
    """Terms that stand in the formula itself, not in its subformulas."""
    if isinstance(f, Pred):
        return f.args
    if isinstance(f, Compare):
        return (f.left, f.right)
    if isinstance(f, Matches):
        return (f.subject, *(t for _, t in f.holes))
    return ()


def walk(f):
    yield f
    for part in children(f):
        yield from walk(part)


def free_vars(f) -> set[str]:
    """Free data variables; names in bounds count."""
    if isinstance(f, Quant):
        return free_vars(f.body) - {f.var}
    out = set().union(*(term_vars(t) for t in terms(f))) if terms(f) else set()
    if isinstance(f, Temporal) and f.bound:
        out |= {x for x in (f.bound.low, f.bound.high) if isinstance(x, str)}
    for part in children(f):
        out |= free_vars(part)
    return out


def show_term(t) -> str:
    if isinstance(t, Const):
        return f'"{t.value}"' if t.sort == "String" else str(t.value)
    if isinstance(t, Var):
        return t.name
    if isinstance(t, Call):
        return f"{t.name}({', '.join(map(show_term, t.args))})"
    return f"({show_term(t.left)} {t.op} {show_term(t.right)})"


def show(f) -> str:
    """The formula as text, fully bracketed."""
    if isinstance(f, Truth):
        return "true" if f.value else "false"
    if isinstance(f, Pred):
        return f.name + (f"({', '.join(map(show_term, f.args))})" if f.args else "")
    if isinstance(f, Compare):
        return f"{show_term(f.left)} {f.op} {show_term(f.right)}"
    if isinstance(f, Matches):
        mark = "/" if f.slashed else '"'
        return f"{show_term(f.subject)} matches {mark}{f.pattern}{mark}"
    if isinstance(f, Not):
        return f"!{show(f.body)}"
    if isinstance(f, Logic):
        return f"({show(f.left)} {f.op} {show(f.right)})"
    if isinstance(f, Quant):
        return f"({f.kind} {f.var} . {show(f.body)})"
    if f.op == "I":
        return f"[{show(f.left)}, {show(f.right)})"
    bound = f.bound.text if f.bound else ""
    return f"{f.op}{bound} {show(f.right)}" if f.left is None else f"({show(f.left)} {f.op}{bound} {show(f.right)})"
