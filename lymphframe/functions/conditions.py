"""User conditions: linear conditions over variables, cell predicates, variable definitions.

Each parser turns text into a Column; names are checked against the columns that exist, before
anything runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {">": ">", "<": "<", ">=": ">=", "<=": "<=", "≥": ">=", "⩾": ">=", "≤": "<=", "⩽": "<="}


def parse_linear(text: str) -> tuple[list[tuple[float, str]], str, float]:
    """([(coefficient, variable)], comparison, bound) of 'c1*v1 + ... - cn*vn > d'.

    Blanks are ignored; a name in parentheses may hold signs, as in (IGHV3-7_g) >= 1.
    """
    m = re.fullmatch(r"(.*?)(>=|<=|>|<|≥|⩾|≤|⩽)(.*)", text.replace(" ", ""))
    if not m:
        raise ValueError(f"not a linear condition: {text}")
    left, sign, bound = m.groups()
    terms, at = [], 0
    pattern = re.compile(r"([+-]?)(?:([0-9.]+(?:e-?[0-9]+)?)\*)?(?:\(([^()]+)\)|([^\s()*+-]+))")
    while at < len(left):
        t = pattern.match(left, at)
        if not t or (at and not t.group(1)):
            raise ValueError(f"not a linear condition: {text}")
        terms.append(((-1 if t.group(1) == "-" else 1) * float(t.group(2) or 1), t.group(3) or t.group(4)))
        at = t.end()
    if not terms:
        raise ValueError(f"not a linear condition: {text}")
    try:
        return terms, _COMPARE[sign], float(bound)
    except ValueError:
        raise ValueError(f"not a linear condition: {text}") from None


def check_names(names: Iterable[str], known: Iterable[str]) -> None:
    missing = sorted(set(names) - set(known))
    if missing:
        raise ValueError(f"unknown variables: {', '.join(missing)}")


def sequence_pattern(text: str, column: Column) -> Column:
    """'a|b' of regular expressions that match the whole, and of 'SEQ~k' for k edits at most; a missing sequence matches nothing.

    Bars within brackets belong to a regular expression.
    """
    near, whole = [], []
    for part in re.findall(r"(?:\\.|\([^()]*\)|\[[^\]]*\]|[^|])+", text):
        m = re.fullmatch(r"([A-Za-z ]+)~([0-9]+)", part)
        if m:
            near.append(F.levenshtein(column, F.lit(m.group(1)), int(m.group(2))) >= 0)
        elif "~" in part:
            raise ValueError(f"not a pattern: {part}")
        else:
            re.compile(part)
            whole.append(part)
    if not near and not whole:
        raise ValueError("an empty pattern")
    if whole:
        near.insert(0, column.rlike(f"^(?:{'|'.join(whole)})$"))
    out = near[0]
    for c in near[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def linear(text: str, known: Iterable[str], aggregate: Callable[[Column], Column] | None = None) -> Column:
    """The condition as a Column; with an aggregate, over a group's finite values, false where a variable has none."""
    terms, sign, bound = parse_linear(text)
    check_names((v for _, v in terms), known)
    total = F.lit(0.0)
    for c, v in terms:
        x = F.expr(f"try_cast(`{v}` AS double)")
        if aggregate:
            x = aggregate(F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))
        total = total + F.lit(c) * x
    out = {">": total > bound, "<": total < bound, ">=": total >= bound, "<=": total <= bound}[sign]
    return F.coalesce(out, F.lit(False))


_TOKEN = re.compile(r"\s*(?:('[^']*')|([0-9]+(?:\.[0-9]+)?)|(&&|\|\||==|!=|>=|<=|[()<>!+*/%-])|([^\s()&|=!<>+*/'-]+))")


def predicate(text: str, known: Iterable[str]) -> Column:
    """Boolean and arithmetic condition on a cell's fields: && || ! == != < <= > >= + - * / and 'quoted' strings.

    A missing string equals ''. Functions are rejected, as are unknown names.
    """
    known = set(known)
    out, names, at, previous = [], set(), 0, ""
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a condition: {text}")
        at = m.end()
        quoted, number, sign, name = m.groups()
        if sign == "(" and previous == "name":
            raise ValueError("functions are not allowed")
        if quoted:
            # a missing value equals the empty string
            if len(out) >= 2 and out[-1] in ("=", "<>") and out[-2].startswith("`"):
                out[-2] = f"coalesce({out[-2]}, '')"
            out.append(quoted)
        elif number:
            out.append(number)
        elif sign:
            out.append({"&&": "AND", "||": "OR", "==": "=", "!=": "<>", "!": "NOT"}.get(sign, sign))
        else:
            names.add(name)
            out.append(f"`{name}`")
        previous = "name" if name else ""
    check_names(names, known)
    return F.coalesce(F.expr(" ".join(out)), F.lit(False))


def define(text: str, known: Iterable[str]) -> tuple[str, Column]:
    """(name, Column) of 'name:expression': arithmetic over variables, names and signs set apart by blanks; null for non-numbers."""
    name, _, body = text.partition(":")
    if not name or not body:
        raise ValueError(f"not a definition: {text}")
    out, names = [], []
    for token in body.replace("(", " ( ").replace(")", " ) ").split():
        if re.fullmatch(r"[0-9]+(\.[0-9]+)?", token):
            out.append(f"{token}D")
        elif token in ("+", "-", "*", "(", ")"):
            out.append(token)
        elif token == "/":
            out.append(token)
        else:
            names.append(token)
            out.append(f"try_cast(`{token}` AS double)")
    check_names(names, known)
    # a division by zero gives null, not an error
    sql = re.sub(r"/ (\S+\([^()]*\)|\S+)", r"/ nullif(\1, 0D)", " ".join(out))
    return name, F.expr(sql)
