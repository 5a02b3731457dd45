"""Editing of Java sources held as arrays of lines without line ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryloom.functions import text

# The marker and the text that takes its place.
MARKER = "// Test Method generated"
TIMEOUT = "@Rule\n    public Timeout globalTimeout = new Timeout(10000);\n\n"


def _last_place(lines: Column, pattern: str) -> Column:
    """Place from 0 of the last line with the pattern, null if there is none."""
    return F.array_max(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i)))


def with_imports(lines: Column, wanted: Column, package: Column) -> Column:
    """lines with the wanted imports that aren't there yet.

    They follow the package line after an empty line; without one, the given package
    stands first. All other lines stay, also those before the first import.
    """
    new = text.missing_imports(wanted, lines)
    at = _last_place(lines, r"^\s*package\s+")
    head = F.when(F.coalesce(package, F.lit("")) != "", F.array(package, F.lit(""))).otherwise(F.array().cast("array<string>"))
    after = F.concat(F.slice(lines, F.lit(1), F.coalesce(at, F.lit(0)) + 1), F.array(F.lit("")), new, F.slice(lines, F.coalesce(at, F.lit(0)) + 2, F.greatest(F.size(lines), F.lit(1))))
    bare = F.when(F.size(new) > 0, F.concat(head, new, F.array(F.lit("")), lines)).otherwise(F.concat(head, lines))
    return F.when(at.isNotNull() & (F.size(new) > 0), after).when(at.isNotNull(), lines).otherwise(bare)


def inject(lines: Column, test_id: Column, method: Column) -> Column:
    """The first marker of each line gives way to a timeout rule and the commented method."""
    block = F.concat(F.lit(TIMEOUT + "    // Starting generated-test "), test_id, F.lit("\n    "), method, F.lit("\n    // Ending generated-test "), test_id)

    def one(line: Column) -> Column:
        at = F.instr(line, MARKER)
        return F.when(at > 0, F.concat(F.left(line, at - 1), block, F.substring(line, at + len(MARKER), F.length(line)))).otherwise(line)

    return F.transform(lines, one)


def truncated(lines: Column, class_name: Column) -> Column:
    """Lines up to the class's declaration, then the marker and a closing brace; all lines if it isn't declared."""
    at = F.array_min(F.transform(lines, lambda x, i: F.when(F.contains(x, F.concat(F.lit("public class "), class_name)), i + 1)))
    tail = F.array(F.lit(""), F.lit("    " + MARKER), F.lit(""), F.lit("}"))
    return F.when(at.isNull(), lines).otherwise(F.concat(F.slice(lines, F.lit(1), F.coalesce(at, F.lit(0))), tail))
