"""Grammars as tables: parsing with every reading of a text at once, and the fewest insertions that mend it.

A grammar is text: ``name: symbols | symbols``, terminals in quotes, and behind a symbol ``?``
(may be missing), ``*`` and ``+`` (repeated) or ``%,`` (repeated with commas between). Names
that begin with ``_`` leave no node in the tree. Binary operators come with a precedence.

The automaton is that of SLR(1); where it leaves a choice, both are followed. Readings that
come to the same states are one, so a text takes linear time unless it stays ambiguous. What a
run of terminals, such as a statement, does to the top of a stack is remembered.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict

END = "$"
#: Most terminals of a run that is remembered, and most runs remembered.
RUN, REMEMBERED = 64, 20_000


class Cell:
    """A state on a stack, with the tree of the symbol that led to it. Cells below are shared."""

    __slots__ = ("state", "below", "tree", "key")

    def __init__(self, state: int, below: Cell | None, tree):
        self.state, self.below, self.tree = state, below, tree
        self.key = hash((state, below.key if below else 0))


class Old(int):
    """In the tree of a run: what the stack held before, counted from its top."""


class Part:
    """A tree of terminals of one run alone, counted from the run's first one. rows: for the caller, who may keep there what follows from the tree."""

    __slots__ = ("tree", "rows")

    def __init__(self, tree):
        self.tree, self.rows = tree, None


class Grammar:
    def __init__(self, text: str, start: str, precedence: list[set[str]] = (), right: frozenset[str] = frozenset(), ends: frozenset[str] = frozenset()):
        """ends: terminals behind which a run ends."""
        self.ends, self._known, self._size = ends, defaultdict(list), 0
        self.rules: list[tuple[str, tuple[str, ...]]] = []
        self.names = set(re.findall(r"^(\w+):", text, re.M))
        self.terminals: set[str] = {END}
        self.level = {t: n for n, some in enumerate(precedence) for t in some}
        self.right = right
        for name, body in re.findall(r"^(\w+):((?:.|\n(?!\w+:))*)", text, re.M):
            for choice in re.split(r"\s\|(?=\s|$)", body):
                self._add(name, tuple(self._symbol(s) for s in choice.split()))
        if both := self.names & self.terminals:
            raise ValueError(f"rules and terminals share the names {both}")
        self._tables(start)

    def _add(self, name: str, body: tuple[str, ...]) -> None:
        if (name, body) not in self.rules:
            self.rules.append((name, body))

    def _symbol(self, s: str) -> str:
        """The name of a symbol; one with a suffix becomes a rule of its own."""
        if m := re.fullmatch(r"('[^']+'|\w+)(\?|\*|\+|%,)", s):
            base, kind = self._symbol(m[1]), m[2]
            name = f"_{base}{kind}"
            if name not in self.names:
                self.names.add(name)
                between = ("'" + kind[1] + "'",) if kind == "%," else ()
                self.terminals |= {x.strip("'") for x in between}
                more = tuple(x.strip("'") for x in between)
                bodies = {"?": [(), (base,)], "*": [(), (name, base)], "+": [(base,), (name, base)], "%,": [(base,), (name, *more, base)]}[kind]
                for body in bodies:
                    self._add(name, body)
            return name
        if s[0] == "'":
            self.terminals.add(s[1:-1])
            return s[1:-1]
        if s not in self.names:
            raise ValueError(f"no rule for {s}")
        return s

    def _tables(self, start: str) -> None:
        self.rules.insert(0, ("_start", (start,)))
        by_name = defaultdict(list)
        for i, (name, _) in enumerate(self.rules):
            by_name[name].append(i)
        empty, first, follow = set(), defaultdict(set), defaultdict(set)
        for t in self.terminals:
            first[t] = {t}
        follow["_start"] = {END}
        size = -1
        while size != (size := sum(map(len, first.values())) + sum(map(len, follow.values())) + len(empty)):
            for name, body in self.rules:
                after = set(follow[name])
                for s in reversed(body):
                    if s not in self.terminals:
                        follow[s] |= after
                    after = after | first[s] if s in empty else set(first[s])
                if all(s in empty for s in body):
                    empty.add(name)
                for s in body:
                    first[name] |= first[s]
                    if s not in empty:
                        break

        def closed(items: frozenset) -> frozenset:
            found, todo = set(items), list(items)
            while todo:
                rule, dot = todo.pop()
                body = self.rules[rule][1]
                if dot < len(body):
                    for r in by_name.get(body[dot], ()):
                        if (r, 0) not in found:
                            found.add((r, 0))
                            todo.append((r, 0))
            return frozenset(found)

        begin = frozenset([(0, 0)])
        kernels, order = {begin: 0}, [begin]
        self.go: list[dict[str, int]] = []
        self.reduces: list[dict[str, list[int]]] = []
        for kernel in order:
            moves, done = defaultdict(set), defaultdict(list)
            for rule, dot in closed(kernel):
                name, body = self.rules[rule]
                if dot < len(body):
                    moves[body[dot]].add((rule, dot + 1))
                else:
                    for t in follow[name]:
                        done[t].append(rule)
            go = {}
            for s in sorted(moves):
                target = frozenset(moves[s])
                if target not in kernels:
                    kernels[target] = len(order)
                    order.append(target)
                go[s] = kernels[target]
            self._settle(go, done)
            self.go.append(go)
            self.reduces.append({t: sorted(r) for t, r in done.items() if r})

    def _settle(self, go: dict[str, int], done: dict[str, list[int]]) -> None:
        """Precedence decides between reading on and reducing an operator's rule."""
        for t in list(done):
            if t not in self.level or t not in go:
                continue
            for rule in list(done[t]):
                ops = [s for s in self.rules[rule][1] if s in self.level]
                if not ops:
                    continue
                mine, other = self.level[ops[-1]], self.level[t]
                if mine > other or mine == other and t not in self.right:
                    go.pop(t, None)
                else:
                    done[t].remove(rule)

    def read(self, cells: list[Cell], kind: str, leaf, seen_below=None) -> list[Cell]:
        """All stacks after one more terminal. seen_below is told which cells decided."""
        out, seen, todo = {}, set(), list(reversed(cells))
        while todo:  # readings keep their order: of two that become one, the earlier stays
            cell = todo.pop()
            target = self.go[cell.state].get(kind)
            if target is not None:
                new = Cell(target, cell, leaf)
                out.setdefault(new.key, new)
            for rule in reversed(self.reduces[cell.state].get(kind, ())):
                new = self._reduced(cell, rule, seen_below)
                if new is not None and new.key not in seen:
                    seen.add(new.key)
                    todo.append(new)
        return list(out.values())

    def _reduced(self, cell: Cell, rule: int, seen_below=None) -> Cell | None:
        name, body = self.rules[rule]
        children = []
        for _ in body:
            if cell.tree is not None:
                children.append(cell.tree)
            cell = cell.below
        if seen_below:
            seen_below(cell)
        target = self.go[cell.state].get(name)
        return None if target is None else Cell(target, cell, (name, children[::-1]))

    def accepted(self, cells: list[Cell]) -> Cell | None:
        """A stack of the start symbol alone, if the text may end here."""
        seen, todo = set(), list(reversed(cells))
        while todo:
            cell = todo.pop()
            for rule in self.reduces[cell.state].get(END, ()):
                if rule == 0:
                    return cell
                new = self._reduced(cell, rule)
                if new is not None and new.key not in seen:
                    seen.add(new.key)
                    todo.append(new)
        return None

    def begin(self) -> list[Cell]:
        return [Cell(0, None, None)]

    def parse(self, kinds: list[str]):
        """The tree over the terminals' places, or the place of the first one that can't follow."""
        cells = self.begin()
        for i, kind in enumerate(kinds):
            cells = self.read(cells, kind, i)
            if not cells:
                return None, i
        end = self.accepted(cells)
        return (end.tree, None) if end else (None, len(kinds))

    # --- trees by runs ---

    def tree(self, kinds: list[str]):
        """The tree of parse(), None for a text with errors. A tree of one run's terminals is (Part, place of the run)."""
        states, trees, at, n = [0], [None], 0, len(kinds)
        while at < n:
            end = at + 1
            while kinds[end - 1] not in self.ends and end < n:
                end += 1
            step = self._step(states, tuple(kinds[at:end])) if end - at <= RUN else None
            if step is not None:
                drop, pushed, built = step
                new = [self._placed(x, trees, at) for x in built]
                if drop:
                    del states[-drop:], trees[-drop:]
                states += pushed
                trees += new
                at = end
                continue
            cells = [self._stack(states, trees)]
            while at < n:  # several readings: all of them, until one is left at the end of a run
                cells = self.read(cells, kinds[at], at)
                at += 1
                if not cells:
                    return None
                if len(cells) == 1 and kinds[at - 1] in self.ends:
                    break
            if len(cells) > 1:
                end = self.accepted(cells)
                return end and end.tree
            states, trees = self._unstacked(cells[0])
        end = self.accepted([self._stack(states, trees)])
        return end and end.tree

    @staticmethod
    def _stack(states: list[int], trees: list) -> Cell:
        cell = None
        for state, tree in zip(states, trees, strict=True):
            cell = Cell(state, cell, tree)
        return cell

    @staticmethod
    def _unstacked(cell: Cell) -> tuple[list[int], list]:
        states, trees = [], []
        while cell is not None:
            states.append(cell.state)
            trees.append(cell.tree)
            cell = cell.below
        return states[::-1], trees[::-1]

    def _step(self, states: list[int], run: tuple[str, ...]):
        """(cells to drop, states to push, their trees) of a run from a stack; None if not exactly one reading is left."""
        known = self._known[run]
        for depth, steps in known:
            found = steps.get(tuple(states[-depth:]), self)
            if found is not self:
                return found
        if self._size >= REMEMBERED:
            self._known.clear()
            self._size, known = 0, self._known[run]
        n = len(states)
        bottom = self._stack(states, [None, *(Old(n - 1 - i) for i in range(1, n))])
        places, cell = {}, bottom
        for i in range(n - 1, -1, -1):
            places[id(cell)] = i
            cell = cell.below
        low = [n - 1]
        cells = [bottom]
        for i, kind in enumerate(run):
            cells = self.read(cells, kind, i, lambda cell: low.append(places.get(id(cell), n)))
        found = None
        if len(cells) == 1:
            top = cells[0]
            while (rule := self._only(top.state)) is not None:
                top = self._reduced(top, rule, lambda cell: low.append(places.get(id(cell), n)))
            pushed, built = [], []
            while id(top) not in places:
                pushed.append(top.state)
                built.append(self._closed(top.tree))
                top = top.below
            found = n - 1 - places[id(top)], pushed[::-1], built[::-1]
        depth = n - min(low)
        steps = next((s for d, s in known if d == depth), None)
        if steps is None:
            known.append((depth, steps := {}))
        steps[tuple(states[-depth:])] = found
        self._size += 1
        return found

    def _only(self, state: int) -> int | None:
        """The rule that is reduced in a state whatever follows. A terminal that can't follow is found then, too, before it is read."""
        if self.go[state]:
            return None
        rules = {r for found in self.reduces[state].values() for r in found}
        return rules.pop() if len(rules) == 1 and 0 not in rules else None

    def _closed(self, tree):
        """The tree, with Parts where nothing is of the stack before."""
        if isinstance(tree, int):
            return tree
        name, children = tree
        while name[0] == "_" and len(children) == 1 and not isinstance(children[0], int):
            name, children = children[0]
        below = []
        for c in map(self._closed, children):
            below += c[1] if type(c) is tuple and c[0][0] == "_" else [c]
        if name[0] != "_" and all(type(c) is int or isinstance(c, Part) for c in below):
            return Part((name, [c.tree if isinstance(c, Part) else c for c in below]))
        if name[0] == "_" and len(below) == 1:
            return below[0]
        return name, below

    def _placed(self, tree, trees: list, at: int):
        kind = type(tree)
        if kind is int:
            return tree + at
        if kind is Part:
            return tree, at
        if kind is Old:
            return trees[-1 - tree]
        return tree[0], [self._placed(c, trees, at) for c in tree[1]]

    def next_kinds(self, cells: list[Cell]) -> set[str]:
        return {t for c in cells for t in (*self.go[c.state], *self.reduces[c.state]) if t in self.terminals and t != END}

    def mended(self, kinds: list[str], rank: dict[str, int], least=None, most: int = 4000) -> list[tuple[int, str]] | None:
        """The fewest terminals to insert, as (place, kind), so that the text parses; None if none were found.

        Searched by rising number of insertions plus least(place, inserted), a bound from below on those that
        must follow. Of equally many, those of low rank and as late as possible come first. rank names the
        kinds that may be inserted. First only the places are tried where a reading is
        stuck; if more is needed there than the bound says, all places up to them are, as
        far as most stacks go.
        """
        if not self.terminals.issuperset(kinds):
            return None
        least = least or (lambda at, added: 0)
        floor = least(0, ())
        stuck = self._search(kinds, rank, least, most, False, None)
        if stuck is not None and len(stuck) <= max(1, floor):
            return stuck
        anywhere = self._search(kinds, rank, least, most, True, len(stuck) if stuck is not None else None)
        return stuck if anywhere is None else anywhere

    def _search(self, kinds, rank, least, most, anywhere, below):
        n, seen, tried = len(kinds), set(), 0
        # entries: insertions and bound, ranks, -place; then the stacks at the place and what was inserted
        heap = [(least(0, ()), 0, 0, 0, self.begin(), ())]
        count = 0
        while heap:
            total, price, _, _, cells, added = heapq.heappop(heap)
            if below is not None and total >= below:
                return None
            at = added[-1][0] if added else 0
            trail = []
            while True:  # read on as far as the text goes
                trail.append((at, cells))
                if at == n:
                    if self.accepted(cells):
                        return list(added)
                    break
                following = self.read(cells, kinds[at], at)
                if not following:
                    break
                at, cells = at + 1, following
            for at, cells in trail if anywhere else trail[-1:]:
                for kind in self.next_kinds(cells) & rank.keys():
                    key = (at, len(added), kind, frozenset(c.key for c in cells))
                    if key in seen:
                        continue
                    seen.add(key)
                    tried += 1
                    if tried > most:
                        return None
                    after = self.read(cells, kind, -1 - len(added))
                    if after:
                        count += 1
                        more = (*added, (at, kind))
                        heapq.heappush(heap, (len(more) + least(at, more), price + rank[kind], -at, count, after, more))
        return None
