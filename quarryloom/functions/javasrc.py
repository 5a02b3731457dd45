"""Java method text: a lexer and what follows from it, as vectorised UDFs.

A text is valid here if its brackets close in order, its literals and comments end, and its
last statement ends; the repair closes open brackets and adds the missing semicolon. It is the
quick check. Errors and repairs by grammar are in ``javagrammar`` and ``operators/trees``.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<block>/\*.*?\*/)|(?P<line>//[^\n]*)|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<char>'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<annotation>@\s*[A-Za-z_$][\w$.]*)|(?P<mark>.)""",
    re.DOTALL,
)
_CLOSES = {"(": ")", "{": "}", "[": "]"}
# The language's modifiers.
MODIFIERS = ("public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default")


@lru_cache(maxsize=4)
def tokens(code: str) -> tuple[tuple[str, str, int], ...]:
    """(kind, text, place) of every token, spaces and comments included. The functions below ask for one text several times, one after another."""
    return tuple((m.lastgroup, m.group(), m.start()) for m in _TOKEN.finditer(code))


def missing(code: str) -> list[tuple[int, str]] | None:
    """Tokens to add, with their places; None where adding can't mend the text."""
    out, stack, last = [], [], None
    for kind, text, at in tokens(code):
        if kind in ("space", "block", "line"):
            continue
        if kind == "mark" and text in "\"'":
            return None  # a literal without an end
        if kind == "mark" and text in _CLOSES:
            stack.append(text)
        elif kind == "mark" and text in ")}]":
            closed = len(out)
            while stack and _CLOSES[stack[-1]] != text and text == "}" and stack[-1] != "{":
                out.append((at, _CLOSES[stack.pop()]))
            if not stack or _CLOSES[stack.pop()] != text:
                return None
            if text == "}" and last and last[0] not in (";", "{", "}") and (last[2] or closed < len(out)):
                out.append((at if closed < len(out) else last[1], ";"))
        last = (text, at + len(text), "(" not in stack and "[" not in stack)
    end = len(code.rstrip())
    if stack and last and last[0] not in (";", "{", "}"):
        while stack and stack[-1] != "{":
            out.append((end, _CLOSES[stack.pop()]))
        out.append((end, ";"))
    out += [(end, _CLOSES[x]) for x in reversed(stack)]
    return out


def has_errors(code: str) -> bool:
    found = missing(code)
    return found is None or bool(found)


def repaired(code: str) -> tuple[bool, str]:
    """Whether the text had errors, and the text with missing tokens added, by character."""
    found = missing(code)
    if not found:
        return found is None, code
    shift = 0
    for at, token in sorted(found, key=lambda x: x[0]):
        code = code[: at + shift] + token + code[at + shift :]
        shift += len(token)
    return True, code


def without_comments(code: str) -> str:
    """Every comment becomes one space; literals that look like comments stay."""
    return "".join(" " if kind in ("block", "line") else text for kind, text, _ in tokens(code))


def _header(code: str) -> tuple[int, int, str, str, list[tuple[int, int]]] | None:
    """Places of the return type's start and the name's end, both texts, and the spans of annotations, of the first method."""
    real = [t for t in tokens(code) if t[0] not in ("space", "block", "line")]
    marks, k, notes = [], 0, []
    while k < len(real):
        kind, text, at = real[k]
        if kind == "annotation":
            end, j = at + len(text), k + 1
            if j < len(real) and real[j][1] == "(":
                depth = 0
                while j < len(real):
                    depth += (real[j][1] == "(") - (real[j][1] == ")")
                    j += 1
                    if not depth:
                        break
                end = real[j - 1][2] + len(real[j - 1][1])
            notes.append((at, end))
            k = j
            continue
        if text in MODIFIERS:
            k += 1
            continue
        if text == "<" and not marks:  # type parameters
            depth = 0
            while k < len(real):
                depth += (real[k][1] == "<") - (real[k][1] == ">")
                k += 1
                if not depth:
                    break
            continue
        if text == "(":
            break
        marks.append((kind, text, at))
        k += 1
    if k == len(real) or not marks or marks[-1][0] != "word":
        return None
    name = marks[-1]
    kind = code[marks[0][2] : name[2]].strip() if len(marks) > 1 else "void"
    return marks[0][2], name[2] + len(name[1]), kind, name[1], notes


def adapted(code: str) -> str:
    """The method as ``@Test public <type> test<Name>...``; a text without a method header stays."""
    found = _header(code)
    if not found:
        return code
    _, end, kind, name, _ = found
    if not name.startswith("test"):
        name = "test" + name[0].upper() + name[1:]
    return f"@Test public {kind} {name}{code[end:].lstrip()}"


def without_annotations(code: str) -> str:
    """Each annotation of the method becomes one space."""
    found = _header(code)
    for a, b in reversed(found[4]) if found else []:
        code = code[:a] + " " + code[b:]
    return code


def method_name(code: str) -> str | None:
    found = _header(code)
    return found[3] if found else None


def _udf(kind, function):
    @F.pandas_udf(kind)
    def run(code: pd.Series) -> pd.Series:
        return code.map(lambda x: None if x is None else function(x))

    return run


code_has_errors = _udf(BooleanType(), has_errors)
clean_comments = _udf(StringType(), without_comments)
adapt_name = _udf(StringType(), adapted)
remove_annotations = _udf(StringType(), without_annotations)
get_method_name = _udf(StringType(), method_name)


@F.pandas_udf(
    StructType().add("had_errors", BooleanType()).add("code", StringType()).add("has_errors", BooleanType()).add("method", StringType())
    .add("adapted", StringType()).add("bare", StringType())
)
def mended(code: pd.Series) -> pd.DataFrame:
    """All at once: the repaired text, whether it still has errors, its method's name, and the text adapted without comments, and without annotations."""
    rows = []
    for x in code:
        if x is None:
            rows.append((None,) * 6)
            continue
        had, whole = repaired(x)
        rows.append((had, whole, has_errors(whole), method_name(whole), adapted(without_comments(whole)), without_annotations(whole)))
    return pd.DataFrame(rows, columns=["had_errors", "code", "has_errors", "method", "adapted", "bare"])


@F.pandas_udf(StructType().add("had_errors", BooleanType()).add("code", StringType()))
def repair(code: pd.Series) -> pd.DataFrame:
    found = [(None, None) if x is None else repaired(x) for x in code]
    return pd.DataFrame(found, columns=["had_errors", "code"])
