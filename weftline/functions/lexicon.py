"""What words, kinds and attributes a catalogue uses, learnt from counts over all of it.

Nothing here knows an item.  From the records' features (words, attributes by the technical grammar of
`catalogue`) aggregates are taken: which attributes a word stands beside, which sets of words
stand for one listing's item.  From these follow

* idle words (makes, selling words): they stand beside every attribute as often as any record does;
* kinds: sets of the other words ("names") are put together when listings that were delivered again call
  their item by both, by average linkage over those votes, so that a name that is used for several
  items ties them to nothing;
* an item's own attributes: those that half or more of a kind's records state;
* whether a kind is sold by mass, volume or length: what half or more of its records state an amount of.

The tables this works on hold only words and names that stand in a given share of all records, so
their size is bounded by the inverse of the share, however large the catalogue.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from weftline.functions import catalogue

#: A word or name is known if it stands in this share of the records, and in as many records at least.
KNOWN_SHARE, KNOWN_LEAST = 2e-4, 5
#: A word is idle if its distance from the average record's attributes is below this, and what chance adds to it.
IDLE, CHANCE, LEAST_SEEN = 0.7, 8.0, 20
#: In a catalogue of few kinds a word of so many records names one, though it stands beside everything.
MOST_IDLE = 0.2
#: Two kinds are one if this share of the votes of the lesser goes to the other.
LINKED = 0.06
LEAST_VOTES = 2
#: An attribute belongs to a kind if this share of its records states it.
OWN = 0.5
#: A name is rare beside a kind that has as many times its records.
SMALL = 0.1
#: A kind is sold by content if this share of its records state an amount of one dimension.
SOLD = 0.4
#: Sold by content, but most records leave its unit to the unit of issue.
ANY = "any"


def idle_words(words: dict[str, int], beside: dict[tuple[str, str], int], attributes: dict[str, int], records: int) -> set[str]:
    """The words whose records state each attribute about as often as all records do, but for those that stand nearly everywhere."""
    far: dict[str, float] = defaultdict(float)
    base = {a: n / records for a, n in attributes.items()}
    for w, n in words.items():
        far[w] = sum(abs(beside.get((w, a), 0) / n - p) for a, p in base.items())
    return {w for w, n in words.items() if LEAST_SEEN <= n <= MOST_IDLE * records and far[w] < IDLE + CHANCE / math.sqrt(n)}


def linked_names(votes: dict[tuple[str, str], int]) -> dict[str, str]:
    """name -> the least name of its kind.  votes: in how many listings two names (or one twice) stand for one item."""
    volume: Counter = Counter()
    ties: dict[str, dict[str, int]] = defaultdict(dict)
    for (a, b), n in votes.items():
        volume[a] += n
        if a != b:
            volume[b] += n
            ties[a][b] = ties[a].get(b, 0) + n
            ties[b][a] = ties[b].get(a, 0) + n
    owner = {n: n for n in volume}
    share = lambda a, b: ties[a][b] / min(volume[a], volume[b])
    heap = [(-share(a, b), a, b) for a in sorted(ties) for b in sorted(ties[a]) if a < b and ties[a][b] >= LEAST_VOTES]
    heapq.heapify(heap)
    while heap:
        s, a, b = heapq.heappop(heap)
        if -s < LINKED:
            break
        if a not in ties or b not in ties.get(a, ()) or -s != share(a, b):
            continue
        for c, n in list(ties.pop(b).items()):
            ties[c].pop(b, None)
            if c != a:
                ties[a][c] = ties[c][a] = ties[a].get(c, 0) + n
        volume[a] += volume[b]
        for n, o in owner.items():
            if o == b:
                owner[n] = a
        for c in ties[a]:
            if ties[a][c] >= LEAST_VOTES:
                heapq.heappush(heap, (-share(a, c), *sorted((a, c))))
    least: dict[str, str] = {}
    for n in sorted(owner):
        least.setdefault(owner[n], n)
    return {n: least[o] for n, o in owner.items()}


def settle(kinds: dict[str, str], counts: dict[str, int], own: dict[str, tuple], content: dict[str, str]) -> dict[str, str | None]:
    """The names' kinds, rare ones put to the frequent ones that they say more or less than.

    A name that nothing linked goes to the kind of the same attributes that is named within it (if what it says
    besides is said of that kind or of several) or that alone says it and more; None if several say it and more.
    """
    size: Counter = Counter()
    for n, k in kinds.items():
        size[k] += counts.get(n, 0)
    said: dict[str, set] = defaultdict(set)
    for n, k in kinds.items():
        for w in n.split(" "):
            said[w].add(k)
    sets = {n: frozenset(n.split(" ")) for n in kinds}
    out: dict[str, str | None] = dict(kinds)
    for n, k in kinds.items():
        if any(m != n and k == o for m, o in kinds.items()):
            continue
        alike = [(m, o) for m, o in kinds.items() if o != k and size[o] * SMALL >= size[k] and own.get(o) == own.get(k) and content.get(o) == content.get(k)]
        less = [(len(sets[m]), o) for m, o in alike if sets[m] < sets[n] and all(len(said[w]) > 2 or o in said[w] for w in sets[n] - sets[m])]
        more = {o for m, o in alike if sets[n] < sets[m]}
        if less:
            most = max(x for x, _ in less)
            near = {o for x, o in less if x == most}
            if len(near) == 1:
                out[n] = near.pop()
        elif more:
            out[n] = more.pop() if len(more) == 1 else None
    return out


@dataclass
class Lexicon:
    """Reads features into a profile."""

    words: dict[str, int] = field(default_factory=dict)
    idle: frozenset = frozenset()
    #: known name -> its kind
    kinds: dict[str, str | None] = field(default_factory=dict)
    #: kind -> its attributes, in order
    own: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: kind -> mass, volume or length, if it is sold by content
    content: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.sorted_words = sorted(self.words)
        self.cache: dict[frozenset, str | None] = {}
        self.saying: dict[str, set[str]] = defaultdict(set)
        self.by_word: dict[str, list[tuple[frozenset, str]]] = defaultdict(list)
        for n in self.kinds:
            s = frozenset(n.split(" "))
            self.by_word[min(s)].append((s, n))
            for w in s:
                self.saying[w].add(n)

    def cut_short(self, w: str) -> bool:
        """Is it no known word, but the beginning of one?"""
        if w in self.words:
            return False
        k = bisect_left(self.sorted_words, w)
        return len(w) < 3 or k < len(self.sorted_words) and self.sorted_words[k].startswith(w)

    def name(self, words) -> str:
        return " ".join(sorted(w for w in words if w not in self.idle))

    def kind(self, words) -> str | None:
        """The kind of item that the words name: by its name, by the name without words cut short, by the longest name among them, by the names that say more."""
        key = frozenset(words)
        got = self.cache.get(key, "")
        if got == "":
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[key] = self._kind(key)
        return got

    def _kind(self, words: frozenset) -> str | None:
        bare = frozenset(w for w in words if w not in self.idle)
        for s in (bare, frozenset(w for w in bare if not self.cut_short(w))):
            n = " ".join(sorted(s))
            if n in self.kinds:
                return self.kinds[n]
        if not s:
            return None
        if all(w in self.words for w in s):
            inside = [(len(q), n) for w in s for q, n in self.by_word.get(w, ()) if q <= s]
            if inside:
                most = max(x for x, _ in inside)
                found = {self.kinds[n] for x, n in inside if x == most}
                if len(found) == 1:
                    return found.pop()
            elif s:
                more = {self.kinds[n] for n in set.intersection(*(self.saying.get(w, set()) for w in s))}
                if more:  # of several kinds' names it says too little
                    return more.pop() if len(more) == 1 else None
        return " ".join(sorted(s))

    def profile(self, kind: str | None, words: str, found: dict[str, str], types: list[str], amounts: list[tuple], numbers: str) -> tuple:
        """Of a record whose words name that kind: (kind, type number, {attribute: value} of the kind's own, whole, (times, number, unit) or None, what it is sold by).

        Of an item met too seldom to know its attributes, all that is stated counts, numbers of no known notation too.
        """
        own = self.own.get(kind) if kind else ()
        content = self.content.get(kind) if kind else None
        unseen = own is None
        if unseen:
            bare = [a for a in amounts if a[3] == 1 and a[2] in catalogue._MM]
            amounts = [a for a in amounts if a not in bare]
            rest = [*numbers.split(), *(catalogue._scaled(a[1], catalogue._MM[a[2]]) + "mm" for a in bare)]
            if rest:
                found["numbers"] = " ".join(sorted(set(rest)))
            own = tuple(sorted(found))
        if "designation" in own and "designation" not in found and len(types) > 1:
            series = next((i for i, t in enumerate(types) if t[:3] == "222"), None)
            if series is not None:
                found["designation"] = types.pop(series)
        for want, instead, value in INSTEAD:
            if want in own and want not in found and instead not in own and found.get(instead) in value:
                found[want] = value[found[instead]]
        for key in ("diameter", "length"):
            # a bare measure is the attribute that is wanting
            if key in own and key not in found:
                for a in amounts:
                    if a[3] == 1 and a[2] in (("mm", "cm") if content == "length" else catalogue._MM):
                        found[key] = catalogue._scaled(a[1], catalogue._MM[a[2]])
                        amounts.remove(a)
                        break
        # a container or "net" states a content of whatever item; a bare measure only of what is sold by it, or an unknown item's mass or volume
        said = sorted((a for a in amounts if self._states(a, content, unseen)), key=lambda a: -a[3]) if amounts else ()
        attrs = {a: found[a] for a in own if a in found}
        whole = kind is not None and len(attrs) == len(own) and (bool(types) or (unseen and "numbers" in found and len(words.split()) + len(attrs) >= 3))
        return kind, types[0] if types else None, attrs, whole, said[0][:3] if said else None, content

    @staticmethod
    def _states(a: tuple, content: str | None, unseen: bool) -> bool:
        if content == ANY:
            return not a[2] or a[3] >= 2
        if content:
            return not a[2] or catalogue.dimension(a[2]) == content
        if not a[2]:
            return unseen
        return a[3] >= 2 or (unseen and catalogue.dimension(a[2]) != "length")


#: (attribute, another that is read for it, what the other's values mean): spellings that two attributes share.
INSTEAD = (("filling", "finish", {"ft": "gp"}),)
