"""Java methods, statements and classes by a grammar: errors, the fewest insertions that mend them, and the syntax tree."""

from __future__ import annotations

import hashlib
import re
from functools import cache, lru_cache
from itertools import accumulate

from quarryloom.functions.grammar import Grammar, Part

# The language's keywords, literals and operators.
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import "
    "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws "
    "transient try void volatile while true false null const goto".split()
)
# What repeats in a literal is possessive, else the search keeps each of its characters as a place to return to, in over 100 bytes.
_TOKEN = re.compile(
    r"""(?P<skip>\s+|/\*.*?\*/|//[^\n]*)|(?P<string>"(?:[^"\\\n]++|\\.)*+")|(?P<character>'(?:[^'\\\n]++|\\.)++')|(?P<number>\d[\w.]*|\.\d\w*)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)"""
    r"""|(?P<mark>>>>=|>>=|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|<<|.)""",
    re.DOTALL,
)
GRAMMAR = r"""
program: _element*
_element: method | constructor | statement | import_declaration | package_declaration | static_block
package_declaration: 'package' name ';'
import_declaration: 'import' 'static'? name _star? ';'
_star: '.' '*'
name: 'identifier' | name '.' 'identifier'

type_declaration: _modifiers _class_word 'identifier' type_parameters? extends_clause? implements_clause? class_body
_class_word: 'class' | 'interface' | 'enum' | '@' 'interface'
extends_clause: 'extends' _type%,
implements_clause: 'implements' _type%,
class_body: '{' _constants? _member* '}'
_constants: enum_constant%, ','? ';'?
enum_constant: annotation* 'identifier' arguments? class_body?
_member: method | constructor | type_declaration | field | static_block | block | ';'
static_block: 'static' block
field: _modifiers _type _declarator%, ';'
method: _modifiers type_parameters? _type 'identifier' parameters dims? throws_clause? _body
constructor: _modifiers type_parameters? 'identifier' parameters throws_clause? block
_body: block | ';' | 'default' _element_value ';'
throws_clause: 'throws' _type%,
parameters: '(' ')' | '(' _parameter%, ')'
_parameter: parameter | spread
parameter: _modifiers _type 'identifier' dims?
spread: _modifiers _type '...' 'identifier'
_modifiers: modifiers?
modifiers: _modifier+
_modifier: annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default'
annotation: '@' name | '@' name '(' ')' | '@' name '(' _element_value ')' | '@' name '(' element_pair%, ')'
element_pair: 'identifier' '=' _element_value
_element_value: _expression | annotation | element_values
element_values: '{' '}' | '{' _element_value%, ','? '}'

_type: _plain_type | array_type
_plain_type: primitive_type | class_type
array_type: _plain_type dims
dims: _dim+
_dim: '[' ']'
primitive_type: _primitive
_primitive: 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' | 'void'
class_type: 'identifier' type_arguments? | class_type '.' 'identifier' type_arguments?
type_arguments: '<' '>' | '<' _type_argument%, '>'
_type_argument: _type | wildcard
wildcard: '?' | '?' 'extends' _type | '?' 'super' _type
type_parameters: '<' type_parameter%, '>'
type_parameter: 'identifier' | 'identifier' 'extends' _bound
_bound: _type | _bound '&' _type

block: '{' statement* '}'
statement: block | local_declaration | type_declaration | expression_statement | if_statement | while_statement | do_statement | for_statement | for_each
  | switch_statement | return_statement | throw_statement | break_statement | continue_statement | try_statement | synchronized_statement | assert_statement | labeled | ';'
local_declaration: _local ';'
_local: _modifiers _type _declarator%,
_declarator: declarator
declarator: 'identifier' dims? | 'identifier' dims? '=' _value
_value: _expression | array_initializer
array_initializer: '{' '}' | '{' _value%, ','? '}'
expression_statement: _expression ';'
if_statement: 'if' condition statement | 'if' condition statement 'else' statement
condition: '(' _expression ')'
while_statement: 'while' condition statement
do_statement: 'do' statement 'while' condition ';'
for_statement: 'for' '(' for_init? ';' _expression? ';' for_update? ')' statement
for_init: _local | _expression%,
for_update: _expression%,
for_each: 'for' '(' _modifiers _type 'identifier' ':' _expression ')' statement
switch_statement: 'switch' condition '{' _switch_item* '}'
_switch_item: switch_label | statement
switch_label: 'case' _expression%, ':' | 'default' ':' | 'case' _expression%, '->' | 'default' '->'
return_statement: 'return' _expression? ';'
throw_statement: 'throw' _expression ';'
break_statement: 'break' 'identifier'? ';'
continue_statement: 'continue' 'identifier'? ';'
assert_statement: 'assert' _expression ';' | 'assert' _expression ':' _expression ';'
labeled: 'identifier' ':' statement
synchronized_statement: 'synchronized' condition block
try_statement: 'try' block catch_clause+ | 'try' block catch_clause* finally_clause | 'try' resources block catch_clause* finally_clause?
resources: '(' _resource ')' | '(' _resource ';' ')'
_resource: _one_resource | _resource ';' _one_resource
_one_resource: resource | name
resource: _modifiers _type 'identifier' '=' _expression
catch_clause: 'catch' '(' _modifiers _union 'identifier' ')' block
_union: _type | _union '|' _type
finally_clause: 'finally' block

_expression: assignment | conditional | binary | instance_of | lambda | _operand
assignment: _expression _assign _expression
_assign: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>='
conditional: _expression '?' _expression ':' _expression
binary: _expression '||' _expression | _expression '&&' _expression | _expression '|' _expression | _expression '^' _expression | _expression '&' _expression
  | _expression '==' _expression | _expression '!=' _expression | _expression '<' _expression | _expression '>' _expression | _expression '<=' _expression | _expression '>=' _expression
  | _expression '<<' _expression | _expression '+' _expression | _expression '-' _expression | _expression '*' _expression | _expression '/' _expression | _expression '%' _expression
  | _expression '>' '>' _expression | _expression '>' '>' '>' _expression
instance_of: _expression 'instanceof' _type | _expression 'instanceof' _type 'identifier'
lambda: lambda_parameters '->' _lambda_body
lambda_parameters: 'identifier' | '(' ')' | '(' 'identifier'%, ')' | '(' parameter%, ')'
_lambda_body: _expression | block
_operand: unary | prefix_update | _plain
unary: '+' _operand | '-' _operand
prefix_update: '++' _operand | '--' _operand
_plain: not | cast | postfix_update | _primary
not: '!' _operand | '~' _operand
cast: '(' primitive_type dims? ')' _operand | '(' class_type dims? ')' _plain | '(' class_type ')' lambda
postfix_update: _primary '++' | _primary '--'
_primary: 'identifier' | literal | 'this' | 'super' | parenthesized | new_object | new_array | field_access | array_access | call | method_reference | class_literal
literal: 'number' | 'string' | 'character' | 'true' | 'false' | 'null'
parenthesized: '(' _expression ')'
field_access: _primary '.' 'identifier' | _primary '.' 'this'
array_access: _primary '[' _expression ']'
call: 'identifier' arguments | 'this' arguments | 'super' arguments | _primary '.' type_arguments? 'identifier' arguments
arguments: '(' ')' | '(' _expression%, ')'
new_object: 'new' class_type arguments class_body? | _primary '.' 'new' class_type arguments class_body?
new_array: 'new' _plain_type _size+ dims? | 'new' _plain_type dims array_initializer
_size: '[' _expression ']'
method_reference: _primary '::' _referred | array_type '::' 'new' | primitive_type '::' 'new'
_referred: 'identifier' | 'new'
class_literal: _type '.' 'class'
"""
#: Weakest first.
PRECEDENCE = [
    {"->"}, {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}, {"?"}, {"||"}, {"&&"}, {"|"}, {"^"}, {"&"}, {"==", "!="}, {"<", ">", "<=", ">=", "instanceof"},
    {"<<", ">>", ">>>"}, {"+", "-"}, {"*", "/", "%"},
]
#: What a repair may insert, likeliest first.
INSERTED = {t: n for n, t in enumerate([";", ")", "}", "]", "(", "{", ",", "=", ".", ":", "identifier", "[", "<", ">", "+", "==", "@", "->", "?", "while", "catch"], 1)}
_OPEN = {"(": ")", "{": "}", "[": "]"}
#: Leaves that are nodes of the tree.
LEAVES = {"identifier", "number", "string", "character", "true", "false", "null", "this", "super"}


@cache
def grammar() -> Grammar:
    return Grammar(GRAMMAR, "program", PRECEDENCE, frozenset(PRECEDENCE[1] | PRECEDENCE[2] | {"->"}), frozenset(";{}"))


def lexed(code: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the tokens. The signs of a shift to the right stay apart, as they may end types; a mark that no token has is of its own kind."""
    return [*zip(*_tokens(code), strict=True)]


#: Up to the end of a run without a quote or a slash, so outside of strings and comments; none of its tokens can go on behind it.
_RUN = re.compile(r"""[^"'/;{}]{0,80}[;{}]""")


def _tokens(code: str) -> tuple[list[str], list[int], list[int]]:
    """Kinds, starts and ends of the tokens, run by run; short runs are remembered."""
    kinds, starts, stops, at = [], [], [], 0
    while at < len(code):
        if m := _RUN.match(code, at):
            some, a, b = _run_tokens(m.group())
            kinds += some
            starts += [x + at for x in a]
            stops += [x + at for x in b]
            at = m.end()
            continue
        for m in _TOKEN.finditer(code, at):
            at = m.end()
            if kind := _kind(m):
                kinds.append(kind)
                starts.append(m.start())
                stops.append(at)
                if kind in ";{}":
                    break
    return kinds, starts, stops


@lru_cache(1 << 13)
def _run_tokens(text: str) -> tuple[tuple[str, ...], tuple[int, ...], tuple[int, ...]]:
    found = [(kind, m.start(), m.end()) for m in _TOKEN.finditer(text) if (kind := _kind(m))]
    return tuple(zip(*found, strict=True))


def _kind(m: re.Match) -> str | None:
    """The kind of a token; None for what is skipped."""
    kind = m.lastgroup
    if kind == "word":
        return m.group() if m.group() in KEYWORDS else "identifier"
    return None if kind == "skip" else m.group() if kind == "mark" else kind


def bracket_bound(kinds: list[str]):
    """How many brackets must at least be inserted from a place on, given those inserted before it."""
    n = len(kinds)
    sums, rest = {}, {}
    for open_, close in _OPEN.items():
        steps = [(k == open_) - (k == close) for k in kinds]
        sums[open_] = list(accumulate(steps, initial=0))
        low = [0] * (n + 1)  # the least balance of a part of what follows, and its whole
        for i in range(n - 1, -1, -1):
            low[i] = min(0, steps[i] + low[i + 1])
        rest[open_] = low

    def least(at: int, added: tuple) -> int:
        total = 0
        for open_, close in _OPEN.items():
            held = sums[open_][at] + sum((k == open_) - (k == close) for _, k in added)
            opened = max(0, -held - rest[open_][at])
            total += opened + max(0, held + opened + sums[open_][n] - sums[open_][at])
        return total

    return least


def mending(code: str, found: list[tuple[str, int, int]]) -> list[tuple[int, str]] | None:
    """(place in the text, token) to insert; each goes behind the token before it."""
    kinds = [k for k, _, _ in found]
    added = grammar().mended(kinds, INSERTED, bracket_bound(kinds))
    if added is None:
        return None
    return [(found[at - 1][2] if at else (found[0][1] if found else len(code)), kind) for at, kind in added]


def inserted(code: str, added: list[tuple[int, str]]) -> str:
    """The text with tokens at places; a word is kept apart from its neighbours."""
    parts, last = [], 0
    for at, token in added:
        parts.append(code[last:at])
        before = parts[-1][-1:] or (parts[-2][-1:] if len(parts) > 1 else "")
        word = token[0].isalnum()
        parts.append((" " if word and (before.isalnum() or before in "_$") and before else "") + token + (" " if word and (code[at : at + 1].isalnum() or code[at : at + 1] in tuple("_$")) else ""))
        last = at
    return "".join([*parts, code[last:]])


def repaired(code: str) -> tuple[bool, str, int | None]:
    """Whether the text had errors, the text with the fewest tokens that mend it, and their number: null where insertions don't, 0 without errors."""
    found = lexed(code)
    if grammar().tree([k for k, _, _ in found]) is not None:
        return False, code, 0
    added = mending(code, found)
    if not added:
        return True, code, None
    return True, inserted(code, added), len(added)


#: Kinds whose variables end with them.
SCOPES = {"program", "class_body", "method", "constructor", "block", "for_statement", "for_each", "lambda", "catch_clause", "try_statement"}
#: Where an identifier's parent says what it is: the first identifier below declares, or the last one is no variable.
_DECLARES = {"declarator", "parameter", "spread", "for_each", "resource", "catch_clause"}
_HEADS = {"element_pair", "enum_constant", "labeled", "method", "constructor", "type_declaration", "type_parameter"}


def _role(kind: str, index: int, n: int, head: bool) -> str | None:
    """What the index-th of n identifiers right below a node of a kind is: declared, assigned, updated, used, or no variable. head: it begins the node."""
    if kind == "lambda_parameters" or kind in _DECLARES and index == 0:
        return "declared"
    if kind == "assignment" and head:
        return "assigned"
    if kind in ("prefix_update", "postfix_update"):
        return "updated"
    if kind in ("name", "class_type", "annotation", "break_statement", "continue_statement", "method_reference") and not (kind == "method_reference" and head):
        return None
    if kind in _HEADS and index == 0 or kind in ("call", "field_access") and index == n - 1:
        return None
    return "used"


#: What is known of a node.
FIELDS = ("kind", "parent", "last", "depth", "start", "stop", "shape", "ends", "setter", "name", "role", "node", "variable", "target")
#: Those that a node has from the tree alone.
_OWN = FIELDS[:12]
#: Nodes that may be asked for alone.
KEPT = {
    "all": lambda row, at: True, "inner": lambda row, at: row[2] > at, "variables": lambda row, at: row[10] is not None, "uses": lambda row, at: row[10] in ("used", "updated"),
}


def nodes(code: str) -> list[list] | None:
    """The syntax tree in preorder: (kind, parent, last, depth, start, stop, shape, ends, setter, name, role); null for a text with errors.

    parent: number of the parent, -1 for the root; last: number of the last descendant, so
    that a node's descendants are those numbered from its own on up to last. start and stop:
    its characters in the text. shape: a 64-bit digest of the kinds of its subtree. ends:
    the last node of the nearest scope around it. setter: the nearest assignment or
    declarator around it, -1 without one. name: an identifier's text, and role what it is
    to the variable of that name.
    """
    out = {x: [] for x in FIELDS[:11]}
    return None if add_nodes(code, out) is None else [*map(list, zip(*out.values(), strict=True))]


def add_nodes(code: str, out: dict[str, list], kept: str = "all") -> int | None:
    """Adds to the lists of out, named by FIELDS, those of the text's nodes that are kept. How many they are; None for a text with errors.

    node: the number among all nodes. variable: the number of an identifier's variable, by first places in the text. A name means the last declaration of it
    before, if its scope hasn't ended, or else the same undeclared variable throughout the text. target: the variable that the setter around it assigns to.
    """
    kinds, starts, stops = _tokens(code)
    tree = grammar().tree(kinds)
    if tree is None:
        return None
    order = _outline(tree, kinds, starts, stops, len(code), 0)
    own = {field: to for field, to in out.items() if field in _OWN}
    if len(own) == len(out):
        return _add(order, code, starts, stops, own, kept)
    names = {x: [] for x in ("node", "name", "role", "ends", "parent", "setter")}
    _add(order, code, starts, stops, names, "variables")
    known = _variables(*names.values())
    numbers = own.get("node", [])
    before = len(numbers)
    added = _add(order, code, starts, stops, {**own, "node": numbers}, kept)
    found = [known.get(at, (None, None)) for at in numbers[before:]]
    for i, field in enumerate(("variable", "target")):
        if field in out:
            out[field] += [x[i] for x in found]
    return added


def _variables(numbers: list[int], names: list[str], roles: list[str], ends: list[int], parents: list[int], setters: list[int]) -> dict[int, tuple[int, int | None]]:
    """(variable, target) of a text's identifiers, given in its order, by their numbers."""
    declared: dict[str, tuple[int, int]] = {}
    variables: dict[tuple[str, int], int] = {}
    set_by: dict[int, int] = {}  # of an assignment or a declarator, whose first identifier is the one that it sets
    found = {}
    for at, name, role, end, parent, setter in zip(numbers, names, roles, ends, parents, setters, strict=True):
        if role == "declared":
            declared[name] = at, end
        since, until = declared.get(name, (-1, -1))
        variable = variables.setdefault((name, since if at <= until else -1), len(variables))
        if role in ("declared", "assigned"):
            set_by[parent] = variable
        found[at] = variable, set_by.get(setter)
    return found


def _add(order: list[tuple], code: str, starts: list[int], stops: list[int], out: dict[str, list], kept: str) -> int:
    """Adds to the lists of out, named by fields of _OWN, the kept nodes of an outline. How many they are."""
    keep, added = KEPT[kept], 0
    rows = {at: x for at, x in order if type(x) is list}
    same, moved = ([(to, field) for field, to in out.items() if field in some] for some in (("kind", "shape", "role"), ("node", "last")))
    others = [(to, field) for field, to in out.items() if field in ("parent", "depth", "start", "stop", "ends", "setter", "name")]
    for at, x in order:
        if type(x) is list:
            if keep(x, at):
                added += 1
                whole = dict(zip(_OWN, (*x[:7], rows[x[7]][2], x[8], code[x[4] : x[5]] if x[0] == "identifier" else None, x[10], at), strict=True))
                for field, to in out.items():
                    to.append(whole[field])
            continue
        part, first, parent, depth, scope, setter = x
        known = part.rows.get(kept)
        if known is None:
            known = part.rows[kept] = _part_columns(part.rows[None], keep)
        if not (n := len(known["node"])):
            continue
        added += n
        for to, field in same:
            to += known[field]
        for to, field in moved:
            to += [v + at for v in known[field]]
        for to, field in others:
            values = known[field]
            if field == "name":
                to += [None if v is None else code[starts[v + first] : stops[v + first]] for v in values]
            elif field == "start":
                to += [starts[v + first] for v in values]
            elif field == "stop":
                to += [stops[v + first - 1] for v in values]
            elif field == "depth":
                to += [v + depth for v in values]
            else:
                outer = parent if field == "parent" else setter if field == "setter" else rows[scope][2]
                to += [v + at if v >= 0 else outer for v in values]
    return added


def _part_columns(rows: list[list], keep) -> dict[str, list]:
    """The kept ones of a part's rows as lists, with the last node of the scope, -1 if that is outside, and with an identifier's place as its name."""
    whole = [(*row[:7], rows[row[7]][2] if row[7] >= 0 else -1, row[8], row[4] if row[0] == "identifier" else None, row[10], at) for at, row in enumerate(rows) if keep(row, at)]
    return {field: [row[i] for row in whole] for i, field in enumerate(_OWN)}


def _outline(tree, kinds: list[str], starts: list[int], stops: list[int], length: int, scope: int) -> list[tuple]:
    """(number, row) of the nodes in preorder: rows as of nodes(), but with the number of the nearest scope in place of its last node, and without names.

    In place of all rows of a Part stand (Part, place of its first terminal, parent, depth, scope, setter); its own rows are kept in it, with places
    counted from it. scope: that of the tree's root.
    """
    order: list[tuple] = []
    rows: dict[int, list] = {}
    below: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    todo: list[tuple] = [(tree, -1, 0, scope, -1)]
    n = 0
    while todo:
        node, parent, depth, scope, setter = todo.pop()
        if isinstance(node, int):
            kind, start, stop = kinds[node], starts[node], stops[node]
            if parent >= 0:
                known = ends[parent]
                known[0], known[1] = min(known[0], start), max(known[1], stop)
            if kind not in LEAVES:
                continue
            row = [kind, parent, n, depth, start, stop, _digest_of(kind, ()), scope, setter, None, None]
            if parent >= 0:
                below[parent].append(n)
            rows[n] = row
            order.append((n, row))
            n += 1
            continue
        name = node[0]
        if isinstance(name, Part):
            first = node[1]
            if name.rows is None:
                held = [*range(_size(name.tree))]
                name.rows = {None: [row for _, row in _outline(name.tree, kinds[first : first + len(held)], held, [i + 1 for i in held], len(held), -1)]}
            root = name.rows[None][0]
            below[parent].append(n)
            rows[n] = [root[0], parent, n + root[2], depth, starts[root[4] + first], stops[root[5] + first - 1], root[6]]
            order.append((n, (name, first, parent, depth, scope, setter)))
            n += len(name.rows[None])
            continue
        if name[0] == "_":
            todo += [(child, parent, depth, scope, setter) for child in reversed(node[1])]
            continue
        if parent >= 0:
            below[parent].append(n)
        below[n], ends[n] = [], [length, 0]
        row = [name, parent, n, depth, 0, 0, 0, scope, setter, None, None]
        rows[n] = row
        order.append((n, row))
        within, sets = n if name in SCOPES else scope, n if name in ("assignment", "declarator") else setter
        todo += [(child, n, depth + 1, within, sets) for child in reversed(node[1])]
        n += 1
    for at in reversed(below):
        row, children = rows[at], [rows[c] for c in below[at]]
        start, stop = ends[at]
        for child in children:
            if child[4] < child[5]:
                start, stop = min(start, child[4]), max(stop, child[5])
        row[4], row[5] = min(start, stop), stop
        if children:
            row[2] = children[-1][2]
        row[6] = _digest(row[0], [child[6] for child in children])
        named = [child for child in children if child[0] == "identifier"]
        for i, child in enumerate(named):
            child[10] = _role(row[0], i, len(named), child[4] == row[4])
    return order


def _size(tree) -> int:
    """One more than the last terminal's place in a tree."""
    if isinstance(tree, int):
        return tree + 1
    return max((_size(c) for c in tree[1]), default=0)


def _digest(kind: str, children: list[int]) -> int:
    return _digest_of(kind, tuple(children))


@lru_cache(1 << 14)
def _digest_of(kind: str, children: tuple[int, ...]) -> int:
    data = kind.encode() + b"".join(c.to_bytes(8, "big", signed=True) for c in children)
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)
