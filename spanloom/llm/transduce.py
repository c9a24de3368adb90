"""Small weighted finite-state transducers over lattices of word symbols, and their composition.

A lattice holds, for every place of a clause, edges ``(end, symbols, weight)``: the words from that place to
``end`` read as any of ``symbols`` (a bit mask).  A transducer reads paths of edges and adds an edge with the
symbol it writes; transducers are composed by running each on the lattice the ones before it have written.
"""

from __future__ import annotations

#: Weight lost for each word that a gap skips.
SKIP = 0.02


class Symbols:
    """Numbers of symbols; a set of symbols is a bit mask."""

    def __init__(self) -> None:
        self.bit: dict[str, int] = {}

    def __getitem__(self, name: str) -> int:
        return self.bit.setdefault(name, 1 << len(self.bit))

    def mask(self, names: str) -> int:
        """Mask of names parted by ``|``."""
        out = 0
        for n in names.split("|"):
            out |= self[n]
        return out


class Rule:
    """A path of a transducer: elements to read, the symbol written and the weight.

    Elements are ``A|B`` (any of these symbols), with ``?`` (may be absent), ``*`` or ``+`` (may come repeatedly);
    ``-n`` allows up to n other words before the next element, none of which may be a negation.
    """

    def __init__(self, symbols: Symbols, text: str, out: str, weight: float):
        self.text, self.out, self.out_mask, self.weight = text, out, symbols[out], weight
        self.items: list[tuple[int, int, bool, bool]] = []  # symbols, gap before, may be absent, may repeat
        gap = 0
        for part in text.split():
            if part[0] == "-" and part[1:].isdigit():
                gap = int(part[1:])
                continue
            mark = part[-1] if part[-1] in "?*+" else ""
            self.items.append((symbols.mask(part.rstrip("?*+")), gap, mark in ("?", "*") and mark != "", mark in ("*", "+") and mark != ""))
            gap = 0
        self.needs = [m for m, _, absent, _ in self.items if not absent]

    def possible(self, present: int) -> bool:
        return all(m & present for m in self.needs)


class Transducer:
    """Rules that read the same lattice; what they write is added to it."""

    def __init__(self, symbols: Symbols, rules: list[tuple[str, float, str]], blocks: str = "NEG"):
        self.rules = [Rule(symbols, text, out, weight) for out, weight, text in rules]
        self.block = symbols[blocks]
        self.memo: dict[int, list[Rule]] = {}

    def candidates(self, present: int) -> list[Rule]:
        """Rules all of whose needed symbols are among those present."""
        found = self.memo.get(present)
        if found is None:
            found = [r for r in self.rules if r.possible(present)]
            if len(self.memo) < 50_000:
                self.memo[present] = found
        return found

    def matches(self, lattice: list[list[tuple[int, int, float]]], present: int) -> list[tuple[Rule, int, int, float]]:
        """Rule, start, end and weight of the best match of every rule at every place."""
        out = []
        for rule in self.candidates(present):
            for start in range(len(lattice)):
                best = self._read(rule, lattice, 0, start, start)
                if best is not None:
                    out.append((rule, start, best[0], rule.weight + best[1]))
        return out

    def _read(self, rule: Rule, lattice: list, at: int, pos: int, start: int, room: int = 0) -> tuple[int, float] | None:
        """End and weight of the best reading of the rest of the rule from ``pos``, or None; ``room``: a gap not yet used."""
        if at == len(rule.items):
            return pos, 0.0
        mask, gap, absent, repeats = rule.items[at]
        gap = max(gap, room)
        best = None
        lost = 0.0
        for p in range(pos, min(len(lattice), pos + gap + 1)):
            for end, symbols, weight in lattice[p]:
                if symbols & mask:
                    rest = self._read(rule, lattice, at + 1, end, start)
                    if repeats:
                        again = self._again(rule, lattice, at, end, start)
                        rest = again if rest is None or (again is not None and again[1] > rest[1]) else rest
                    if rest is not None and (best is None or rest[1] + weight - lost > best[1]):
                        best = rest[0], rest[1] + weight - lost
            if lattice[p][0][1] & self.block:
                break
            lost += SKIP
        if absent:
            rest = self._read(rule, lattice, at + 1, pos, start, gap)
            if rest is not None and (best is None or rest[1] > best[1]):
                best = rest
        return best

    def _again(self, rule: Rule, lattice: list, at: int, pos: int, start: int) -> tuple[int, float] | None:
        """The element once more, directly after itself."""
        if pos >= len(lattice):
            return None
        best = None
        for end, symbols, weight in lattice[pos]:
            if symbols & rule.items[at][0]:
                for rest in (self._read(rule, lattice, at + 1, end, start), self._again(rule, lattice, at, end, start)):
                    if rest is not None and (best is None or rest[1] + weight > best[1]):
                        best = rest[0], rest[1] + weight
        return best

    def write(self, lattice: list[list[tuple[int, int, float]]], present: int) -> int:
        """Adds the edges of all matches; the symbols now present."""
        for rule, start, end, weight in self.matches(lattice, present):
            lattice[start].append((end, rule.out_mask, weight))
            present |= rule.out_mask
        return present
