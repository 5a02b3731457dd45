"""Code-text functions as Column expressions: all stay in the JVM.

A null text gives null, an empty one the function's value for no text; method_id leaves null parts out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of replacements defines the formatted text.
TIGHTEN = [
    (" ++ ", "++"), (" -- ", "--"), (" ** ", "**"), (" . ", "."), (" :: ", "::"), ("( ", "("), (" (", "("), (" )", ")"),
    (" ;", ";"), (" ,", ","), ("[ ", "["), (" [", "["), (" ]", "]"),
]
KEYWORDS = [
    ("catch(", "catch ("), ("try(", "try ("), ("if(", "if ("), ("for(", "for ("), ("while(", "while ("),
    (" < ? > ", "<?> "), (" @ ", " @"),
]
OPERATORS = [
    ("}(", "} ("), (")(", ") ("), ("=(", "= ("), ("+(", "+ ("), ("-(", "- ("), ("*(", "* ("), ("/(", "/ ("), (";(", "; ("),
    (":(", ": ("), ("?(", "? ("), (">(", "> ("), ("<(", "< ("), ("&&(", "&& ("), ("||(", "|| ("),
]
PLACEHOLDER = '"<AssertPlaceHolder>"'
PRUNED_WHITE = r"^\s+|\s+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, PRUNED_WHITE, "")


def format_code(code: Column) -> Column:
    for old, new in [*TIGHTEN, *KEYWORDS, *OPERATORS]:
        code = F.replace(code, F.lit(old), F.lit(new))
    return code


def fill_placeholder(method: Column, statement: Column) -> Column:
    """Every placeholder becomes the stripped statement."""
    return F.replace(method, F.lit(PLACEHOLDER), strip(statement))


def remove_padding(text: Column, pad: str = "<pad>") -> Column:
    return F.replace(text, F.lit(pad), F.lit(""))


def bracket_stack(text: Column) -> Column:
    """The brackets of text still open at its end; from the first wrong closing one on, X."""
    only = F.regexp_replace(text, r"[^(){}\[\]]", "")

    def step(open_: Column, c: Column) -> Column:
        opener = F.translate(c, ")}]", "({[")
        return (
            F.when(open_ == "X", open_)
            .when(c.isin("(", "{", "["), F.concat(open_, c))
            .when(c == "", open_)
            .when(F.right(open_, F.lit(1)) == opener, F.left(open_, F.length(open_) - 1))
            .otherwise(F.lit("X"))
        )

    return F.aggregate(F.split(only, ""), F.lit(""), step)


def is_balanced(text: Column) -> Column:
    """Whether (), {} and [] close in order; null for null."""
    return bracket_stack(text) == ""


def postprocess_test(line: Column) -> Column:
    """A test method's line mended by words.

    ``@Test`` comes first; the word after the first ``void`` gets the prefix ``test``. A
    line with unbalanced brackets ends after its last word ending in ``;`` with one ``}``
    more, or stays as it was if there is no such word.
    """
    return let(line, _postprocessed)


def _postprocessed(line: Column) -> Column:
    first = F.split(line, " ")
    words = F.when(F.get(first, F.lit(0)) == "@Test", first).otherwise(F.concat(F.array(F.lit("@Test")), first))
    return let(words, lambda w: let(F.array_position(w, "void").cast("int"), lambda void: let(_prefixed(w, void), lambda fixed: _closed(line, fixed))))


def _prefixed(words: Column, void: Column) -> Column:
    """words with the prefix test on the one after the place void, if there is one."""
    word = F.get(words, void)
    new = F.when(F.startswith(word, F.lit("test")), word).otherwise(F.concat(F.lit("test"), word))
    rest = F.slice(words, void + 2, F.size(words))
    return F.when((void > 0) & (void < F.size(words)), F.concat(F.slice(words, F.lit(1), void), F.array(new), rest)).otherwise(words)


def _closed(line: Column, words: Column) -> Column:
    last = F.array_max(F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit(";")), i + 1)))
    cut = let(last, lambda n: F.when(n.isNull(), line).otherwise(F.concat_ws(" ", F.slice(words, F.lit(1), F.coalesce(n, F.lit(0))), F.array(F.lit("}")))))
    return F.when(is_balanced(line), F.array_join(words, " ")).otherwise(cut)


def simple_name(class_name: Column) -> Column:
    return F.substring_index(class_name, ".", -1)


def source_path(class_name: Column) -> Column:
    return F.concat(F.translate(class_name, ".", "/"), F.lit(".java"))


def test_class(class_name: Column) -> Column:
    return F.concat(class_name, F.lit("_ESTest"))


def base_name(path: Column) -> Column:
    """The last part of a path up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def method_id(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def method_id_parts(key: Column) -> list[Column]:
    """project, version, number and class of an id; the class ends at the next underscore."""
    parts = F.split(key, "_")
    return [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(("project", "version", "number", "class"))]


def parsed_boolean(value: Column) -> Column:
    """true for y, yes, t, true, on and 1, false for n, no, f, false, off and 0, in any case; null for null. Any other text raises."""
    low = F.lower(value)
    unknown = F.raise_error(F.concat(F.lit("not a boolean: "), value)).cast("boolean")
    return F.when(low.isin("y", "yes", "t", "true", "on", "1"), F.lit(True)).when(low.isin("n", "no", "f", "false", "off", "0"), F.lit(False)).when(value.isNotNull(), unknown)


def version_digits(label: Column) -> Column:
    return F.regexp_replace(label, "[^0-9]", "")


def split_imports(joined: Column) -> Column:
    """The imports of a pipe-joined string, without empty ones."""
    return F.filter(F.split(joined, r"\|"), lambda x: x != "")


def missing_imports(wanted: Column, lines: Column) -> Column:
    """Imports that are no line yet, in order, doubles kept."""
    return let(lines, lambda known: F.filter(wanted, lambda x: ~F.array_contains(known, x)))


def canonical_test(class_name: Column, method: Column) -> Column:
    return F.concat(class_name, F.lit("::"), method)


def prefixed_test_name(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("test")), name).otherwise(F.concat(F.lit("test"), F.upper(F.left(name, F.lit(1))), F.substring(name, 2, 1_000_000)))


def _two_decimals(x: Column) -> Column:
    return F.format_string("%.2f", x.cast("double"))


def human_count(n: Column) -> Column:
    """K, M or B of parameters."""
    return F.when(n < 1_000_000, F.concat(_two_decimals(n / 1e3), F.lit(" K"))).when(n < 1_000_000_000, F.concat(_two_decimals(n / 1e6), F.lit(" M"))).when(n.isNotNull(), F.concat(_two_decimals(n / 1e9), F.lit(" B")))


def human_bytes(n: Column) -> Column:
    return F.when(n < 1_000_000, F.concat(_two_decimals(n / 1e3), F.lit(" KB"))).when(n < 1_000_000_000, F.concat(_two_decimals(n / 1e6), F.lit(" MB"))).when(n.isNotNull(), F.concat(_two_decimals(n / 1e9), F.lit(" GB")))


def elapsed(seconds: Column, days: bool = True) -> Column:
    """h:mm:ss of whole seconds; with days, ``n day(s), `` before from 24 hours on."""
    s = F.floor(seconds).cast("long")
    hours = F.floor(s / 3600)
    rest = F.concat(F.lpad(F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))
    if not days:  # hours have two digits at least, and as many as they need
        return F.concat(F.when(hours < 10, F.lit("0")).otherwise(F.lit("")), hours.cast("string"), F.lit(":"), rest)
    n = F.floor(s / 86400)
    head = F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")))).otherwise(F.lit(""))
    return F.concat(head, F.pmod(hours, F.lit(24)).cast("string"), F.lit(":"), rest)


def seconds_text(seconds: Column) -> Column:
    """elapsed with two digits of the fraction, cut, not rounded."""
    part = F.floor((seconds - F.floor(seconds)) * 100).cast("string")
    return F.concat(elapsed(seconds), F.lit("."), F.lpad(part, 2, "0"))


def longest_first(strings: Column) -> Column:
    """Strings by falling length; of equal lengths the later comes first."""
    numbered = F.transform(strings, lambda x, i: F.struct((-F.length(x)).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.transform(F.array_sort(numbered), lambda r: r["x"])


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("Yes")).otherwise(F.lit("No"))
