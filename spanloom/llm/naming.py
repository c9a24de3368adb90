"""Canonical names for freely spelt verbs and objects."""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Generator
from hashlib import blake2b

#: Tokens that stand for a missing value, after reduction to letters, and leading articles.
NULL_NAMES = {"", "none", "n a", "na", "null", "unknown", "nan"}
ARTICLES = {"the", "a", "an"}

VOWELS = set("aeiouy")


def letters(raw: str | None) -> str:
    """Lower-case words of letters only; invisible marks inside a word vanish, others part words."""
    if raw is None:
        return ""
    text = unicodedata.normalize("NFKD", raw).casefold()
    out = []
    for ch in text:
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            out.append(ch)
        elif kind not in ("Cf", "Mn"):
            out.append(" ")
    return " ".join("".join(out).split())


def stem(word: str) -> str:
    """The part of an English word that its tenses, -ing form and plural share."""
    w = word
    if w.endswith("ies") and len(w) > 4:
        w = w[:-3] + "y"
    elif w.endswith(("shes", "ches", "xes", "sses", "zzes")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith(("ss", "us", "is")) and len(w) > 3:
        w = w[:-1]
    for end in ("ing", "ed"):
        if w.endswith(end) and len(w) - len(end) >= 3 and VOWELS & set(w[: -len(end)]):
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiou":
        w = w[:-1]
    if len(w) > 3 and w.endswith("e"):
        w = w[:-1]
    if len(w) > 2 and w.endswith("i"):
        w = w[:-1] + "y"
    return w


def forms(base: str) -> set[str]:
    """Spellings that ``stem`` leads back to ``base``, regular ones and their doubled or e- variants."""
    out = {base, base + "e", base + "s", base + "es", base + "ing", base + "ings", base + "ed"}
    if base[-1] not in VOWELS:
        out |= {base + base[-1], base + base[-1] + "s", base + base[-1] + "ing", base + base[-1] + "ed"}
    if base.endswith("y"):
        out |= {base[:-1] + "ies", base[:-1] + "ied"}
    return {f for f in out if stem(f) == base}


def drops(word: str) -> set[str]:
    return {word[:i] + word[i + 1:] for i in range(len(word))}


def one_slip(a: str, b: str) -> bool:
    """Whether one letter replaced, dropped, added or swapped with its neighbour separates the words."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1:] == b[i + 1:] or (a[i:i + 2] == b[i:i + 2][::-1] and a[i + 2:] == b[i + 2:])
    return a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


#: Stems, and names, that a column may have for a ``Namer`` in memory, and stems of these that slips may be traced back to.
#: Columns with more are named by joins (``runs.name_table``), with the same result.
KEPT = 20_000
INDEXED = 4_000
#: A spelling is a slip only if the right one is at least TIMES as frequent and it makes up at most this share of that one:
#: short words have many real neighbours, so they need more evidence, or another word beside them that both share.
TIMES, SHARE, SHORT, SHORT_SHARE = 5, 0.05, 4, 0.01


def may_be_slip(rare: int, frequent: int, share: float = SHARE) -> bool:
    """Whether counts allow that one spelling is a slip for another; a single occurrence may be one for a word of five."""
    return frequent >= TIMES * rare and rare - 1 <= share * frequent


#: What is known of a word: how often its stem occurs, and the stems other than its own that it may be a slip for with
#: their counts, the most frequent first.
Info = tuple[int, list[tuple[str, int]]]


def options(w: str, info: Info) -> list[str]:
    """Stems that a word may stand for on its own, the likeliest first."""
    n, near = info
    return [t for t, m in near if len(w) > SHORT or may_be_slip(n, m, SHORT_SHARE)] or [stem(w)]


def halves(w: str) -> list[tuple[str, str]]:
    """Stems of the two words that a longer word is made of when the space between them was lost or mistyped."""
    return [(stem(w[:i]), stem(w[j:])) for i in range(2, len(w) - 1) for j in (i, i + 1)] if len(w) > 5 else []


def start(before: str, word: str) -> str:
    """Key of the beginning of a name, from the key of the beginning before its last word."""
    return "\n" + blake2b((before + word).encode(), digest_size=16).hexdigest()


def starts(name: str) -> list[str]:
    """Keys of all beginnings of a name."""
    out = [""]
    for w in name.split()[:-1]:
        out.append(start(out[-1], w))
    return out[1:]


def steps(words: list[str], infos: dict[str, Info]) -> Generator[list[str], dict[str, int], str]:
    """Finds the canonical name of words: yields the names and beginnings of names whose counts it needs, and is sent them."""
    own = [options(w, infos[w]) for w in words]
    made = [halves(w) if o == [stem(w)] else [] for w, o in zip(words, own)]
    n = yield [f"{a} {b}" for m in made for a, b in m]
    parts: list[list[str]] = []
    for w, o, m in zip(words, own, made):
        both = next(([[a], [b]] for a, b in m if (k := n.get(f"{a} {b}", 0)) and may_be_slip(infos[w][0], k)), None)
        parts += both or [o]
    if len(parts) > 1 and any(one_slip(words[0], a) for a in ARTICLES):
        rest, whole = " ".join(o[0] for o in parts[1:]), " ".join(o[0] for o in parts)
        n = yield [rest, whole]
        if may_be_slip(n.get(whole, 0) or 1, n.get(rest, 0)):
            parts = parts[1:]  # a slip in the article
    plain = " ".join(o[0] for o in parts)
    if len(parts) == len(words) > 1:  # short words that the other words of the name vouch for
        loose = [" ".join([*(o[0] for o in parts[:i]), t, *(o[0] for o in parts[i + 1:])]) for i, w in enumerate(words) if parts[i] == [stem(w)] for t, _ in infos[w][1]]
        n = yield [plain, *loose] if loose else []
        vouched = [c for c in loose if may_be_slip(n.get(plain, 0) or 1, n.get(c, 0))]
        if vouched:
            return max(vouched, key=lambda c: (n[c], c))
    if any(len(o) > 1 for o in parts):
        n = yield [plain]
        if not n.get(plain, 0):  # all known names that the options can make, word by word
            live = {"": ""}
            for o in parts[:-1]:
                grown = {start(k, t): f"{text}{t} " for k, text in live.items() for t in o}
                n = yield list(grown)
                live = {k: text for k, text in grown.items() if n.get(k, 0)}
            ends = [text + t for text in live.values() for t in parts[-1]]
            n = yield ends
            known = [c for c in ends if n.get(c, 0)]
            if known:
                return max(known, key=lambda c: (n[c], c))
    return plain


def slip_share(s: str) -> float:
    return SHORT_SHARE if len(s) <= SHORT else SHARE


class TooMany(ValueError):
    """More stems than may be indexed in memory."""


class Namer:
    """Maps a spelling to its canonical name, given how often each stem, and each name of stems, occurs in the whole data.

    A word counts as another stem if it is one slip away from one of its forms and so much rarer that a slip explains it
    (``may_be_slip``); of several stems, as the one that makes the whole a known name, else the most frequent.  In a name of several
    words the counts of the whole names decide too.  Two words that are both frequent, or both rare, are different words
    however alike they look.  With more than ``most`` stems to trace slips back to it raises ``TooMany``.
    """

    def __init__(self, stems: dict[str, int], names: dict[str, int] | None = None, most: int | None = None):
        self.stems = {s: n for s, n in stems.items() if s}
        self.known = {k: 1 for name in names or {} for k in starts(name)} | (names or {})
        self.near: dict[str, set[str]] = defaultdict(set)
        self.form_stem: dict[str, str] = {}
        self.memo: dict[str, Info] = {}
        made = 0
        for s, n in sorted(self.stems.items(), key=lambda x: (-x[1], x[0])):  # what is a slip itself explains no other
            if n < TIMES:
                break
            if any(may_be_slip(n, self.stems[t], slip_share(s)) for t in self.beside(s)):
                continue
            made += 1
            if most is not None and made > most:
                raise TooMany(f"more than {most} stems")
            for f in forms(s):
                self.form_stem[f] = s
                for d in {f, *drops(f)}:
                    self.near[d].add(f)

    def beside(self, w: str) -> set[str]:
        """Stems with a form that is one slip away."""
        return {self.form_stem[f] for d in {w, *drops(w)} for f in self.near.get(d, ()) if one_slip(w, f)} if len(w) > 2 else set()

    def info(self, w: str) -> Info:
        found = self.memo.get(w)
        if found is None:
            s = stem(w)
            n = self.stems.get(s, 1)
            near = [(t, self.stems[t]) for t in self.beside(w) if t != s and may_be_slip(n, self.stems[t])]
            found = n, sorted(near, key=lambda x: (-x[1], x[0]))
            if len(self.memo) < 100_000:
                self.memo[w] = found
        return found

    def name(self, raw: str | None) -> str | None:
        """Canonical name, or None for a missing one."""
        words = name_words(raw)
        if words is None:
            return None
        way = steps(words, {w: self.info(w) for w in words})
        next(way)
        while True:
            try:
                way.send(self.known)
            except StopIteration as end:
                return end.value


def name_words(raw: str | None) -> list[str] | None:
    """Words of a name without a leading article; None for a missing name."""
    plain = letters(raw)
    if plain in NULL_NAMES:
        return None
    words = plain.split()
    return words[1:] if len(words) > 1 and words[0] in ARTICLES else words


def count_stems(values: dict[str, int]) -> Counter:
    """Stems of the words of raw spellings, each spelling with its number of rows."""
    out: Counter = Counter()
    for raw, n in values.items():
        for w in name_words(raw) or ():
            out[stem(w)] += n
    return out


def count_names(values: dict[str, int]) -> Counter:
    """Names as sequences of stems, each spelling with its number of rows."""
    out: Counter = Counter()
    for raw, n in values.items():
        if words := name_words(raw):
            out[" ".join(stem(w) for w in words)] += n
    return out
