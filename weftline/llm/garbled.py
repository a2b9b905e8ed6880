"""Text decoded with the wrong character encoding: found, and restored where its bytes survive.

Method: near-twins.  Texts are cut into pieces at ASCII sentence ends; a piece's key is what is
left without its non-ASCII characters (numbers as one digit), which wrong decoding does not
change.  Under one key the shortest form is the clean twin, since wrong decoding turns each
character into two or more; the others are aligned with it run by run, the ASCII
characters between the runs being equal.

The misreadings are inferred from the aligned runs alone.  Where a run has as many characters as its twin has UTF-8
bytes, each byte is aligned with the character it was read as; bytes met under one first byte, and
first bytes met in one form, make a table, which is a misreading.  No encoding is presumed: what the
twins do not show of a table is taken from the standard codec that agrees with all they do show, and left open
if there is none.  A run that a table, or tables in a row as the twins show them, turn wholly into the
alphabet of the clean twins is restored.

One single-byte encoding read as another leaves as many characters as it met, so there the
most frequent of the shortest forms is the twin, and characters are aligned with characters; those met together without
contradiction make a substitution.  The ASCII frame alone cannot say which of two runs is wrong; such a
substitution is applied to a clause only where the clause's runs are by far likelier after it than
before it under the character pairs of the clean twins.

Bytes are lost where a text holds U+FFFD, or where a run is made of a table's
sequences but for some that do not decode: such a text is reported with an empty digest.

Defined cases: null and empty texts are not affected; ASCII texts neither; repeated texts
are judged alike; very long texts are read whole; an empty table, or one without twins,
gives only the texts with U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import codecs
import encodings.aliases
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import Store

#: A misreading is learnt from the twins of as many different keys.
LEAST_VOTES = 3
#: A substitution is learnt from as many different characters at least, in runs of as many.
LEAST_LETTERS, LEAST_RUN = 8, 4
#: Two of its characters belong together if they are neighbours in the twins of as many keys.
LEAST_MET = 2
#: First bytes belong to one table if they meet in this share of the lesser's forms.
MET = 0.05
#: A standard codec completes a table if this share of what the twins show agrees with it.
AGREES = 0.9
CHANCE = 0.2
#: Without such a codec a misreading has to show as many characters, each standing for one byte or letter in this share of the votes.
LEAST_UNKNOWN, ALIKE = 16, 0.9
LEAST_SHOWN = 3
#: More rows than learning can bring forth: bytes times the characters of some hundred encodings.
MOST_ITEMS = 500_000
#: A character belongs to the alphabet if it stands in the clean twins of as many keys.
LEAST_KEYS = 2
#: By how many nats a clause must gain, at least and by character, for a single-byte chain to be applied.
LEAST_GAIN, LEAST_GAIN_EACH = 6.0, 1.0
_RUN = re.compile(r"[^\x00-\x7f]+")
_END = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
_CLAUSE = re.compile(r"(?<=[.!?:;])\s+|[\r\n]+")
_NUMBER = re.compile(r"\d+")
LOST = "�"


@cache
def _codecs() -> dict[str, dict[int, str]]:
    """The upper halves of Python's single-byte codecs that hold ASCII; bytes that one leaves undefined stand for themselves."""
    out: dict[str, dict[int, str]] = {}
    ascii_ = bytes(range(128))
    for e in sorted(set(encodings.aliases.aliases.values())):
        try:
            if not codecs.lookup(e)._is_text_encoding or ascii_.decode(e) != ascii_.decode("ascii"):
                continue
            # a codec of several bytes to a character leaves some pair of bytes fewer than two characters
            if any(len(bytes([b, 0x40 + b % 64]).decode(e, "replace")) != 2 for b in range(128, 256)):
                continue
        except (LookupError, UnicodeError):
            continue
        table = {}
        for b in range(128, 256):
            try:
                table[b] = bytes([b]).decode(e)
            except UnicodeDecodeError:
                table[b] = chr(b)
        if any(c != chr(b) for b, c in table.items()) and table not in out.values() or e == "latin_1":
            out[e] = table
    return out


class Table:
    """A misreading: what each byte was read as.  chars: {character: {byte: votes}}; a character may stand for several bytes."""

    def __init__(self, chars: dict[str, dict[int, float]]):
        self.chars = {c: sorted(b, key=lambda x: -b[x]) for c, b in chars.items()}
        self.votes = chars
        self.read: dict[int, list[str]] = {}
        for c, bs in chars.items():
            for b in bs:
                self.read.setdefault(b, []).append(c)

    def undo(self, run: str) -> str | None:
        """The text whose UTF-8 bytes were read as the run; None if there is none."""
        out, i, n = [], 0, len(run)
        while i < n:
            for lead in self.chars.get(run[i], ()):
                size = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
                if not size or i + size > n:
                    continue
                rest = [[b for b in self.chars.get(c, ()) if 0x80 <= b < 0xC0] for c in run[i + 1 : i + size]]
                if all(rest):
                    got = next((t for t in (_decoded(bytes([lead, *x])) for x in product(*rest)) if t), None)
                    if got:
                        out.append(got)
                        i += size
                        break
            else:
                return None
        return "".join(out)

    def misread(self, text: str) -> list[str]:
        """How the text would look, in every way the bytes were read."""
        ways = [""]
        for b in text.encode("utf-8"):
            ways = [w + c for w in ways for c in self.read.get(b, ())][:16]
        return ways


def _decoded(b: bytes) -> str | None:
    try:
        return b.decode("utf-8")
    except UnicodeDecodeError:
        return None


def undo_chain(run: str, chain: tuple[Table, ...]) -> str | None:
    for t in chain:
        run = t.undo(run)
        if run is None or run.isascii():
            return None
    return run


def pieces(text: str) -> Iterator[str]:
    for p in _END.split(text):
        if p and not p.isascii():
            yield _NUMBER.sub("0", p)


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        c = Counter(p for t in b["text"] if t and not t.isascii() and LOST not in t for p in pieces(t))
        yield pd.DataFrame([(_RUN.sub("", p), p, n) for p, n in c.items()], columns=["key", "form", "n"])


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the aligned runs of each form and its twin show: (what, a, b, key).

    what 0: under first byte a, byte b (each written as the byte and what it was read as); 1: first bytes a and b of one form;
    2: characters a and b, neighbours of one run (each written as what is read and what it was).
    """
    for batch in batches:
        rows = set()
        for key, form, twin in zip(batch["key"], batch["form"], batch["twin"]):
            leads = set()
            for g, c in zip(_align(form), _align(twin)):
                if g == c or not c or not g:
                    continue
                raw = c.encode("utf-8")
                if len(g) > len(c) and len(g) == len(raw):
                    lead = ""
                    for b, x in zip(raw, g):
                        if b >= 0xC0:
                            lead = f"{b:02x}{x}"
                            leads.add(lead)
                        rows.add((0, lead, f"{b:02x}{x}", key))
                elif len(g) == len(c) >= LEAST_RUN:
                    pair = [x + y for x, y in zip(g, c)]
                    rows.update((2, x, y, key) for x, y in zip(pair, pair[1:]))
            some = sorted(leads)
            rows.update((1, x, y, key) for i, x in enumerate(some) for y in some[i + 1 :])
        yield pd.DataFrame(sorted(rows), columns=["what", "a", "b", "key"])


def tables(under: dict[tuple[str, str], int], together: dict[tuple[str, str], int]) -> list[Table]:
    """The misreadings that bytes under first bytes, and first bytes of one form, make up."""
    size = {a: n for (a, b), n in under.items() if a == b}
    up = {a: a for a, n in size.items() if n >= LEAST_VOTES}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in sorted(together.items(), key=lambda x: (-x[1], x[0])):
        if a in up and b in up and a[:2] != b[:2] and n >= max(2, MET * min(size[a], size[b])):
            x, y = find(a), find(b)
            # one byte read in two ways by one table's first bytes: two misreadings in one form
            if x != y and not ({k[:2]: k for k in up if find(k) == x}.keys() & {k[:2] for k in up if find(k) == y}):
                up[max(x, y)] = min(x, y)
    out: dict[str, dict[str, dict[int, float]]] = {}
    for (a, b), n in sorted(under.items()):
        if a in up:
            own = out.setdefault(find(a), {}).setdefault(b[2:], {})
            own[int(b[:2], 16)] = own.get(int(b[:2], 16), 0) + n
    each = [x for _, t in sorted(out.items()) for x in _completed(t)]
    each.sort(key=lambda x: -x[0])
    # clusters of different scripts can show the same misreading
    return [Table(t) for k, (_, t) in enumerate(each) if all(t != o for _, o in each[:k])]


def _completed(chars: dict[str, dict[int, float]]) -> list[tuple[float, dict[str, dict[int, float]]]]:
    """(votes, table) of each misreading shown; none if it is chance (texts can differ in more than their encoding).  With the entries of the standard codecs that what is shown agrees with.

    Codecs that differ in a few bytes can have been used side by side: the one that explains most comes first, another
    joins if it explains what is left, and most of the whole.  Of codecs that explain as much, the one nearest Latin-1.
    """
    # a character's bytes that are few beside its most frequent one align by chance
    chars = {c: {b: n for b, n in bs.items() if n >= CHANCE * max(bs.values())} for c, bs in chars.items()}
    shown = {(b, c): n for c, bs in chars.items() for b, n in bs.items()}
    whole, left = sum(shown.values()), dict(shown)
    chosen: list[str] = []
    known = _codecs()
    while left:
        best = max(known, key=lambda e: (sum(n for (b, c), n in left.items() if known[e][b] == c), sum(n for (b, c), n in shown.items() if known[e][b] == c), sum(c == chr(b) for b, c in known[e].items())))
        gain = sum(n for (b, c), n in left.items() if known[best][b] == c)
        if gain < LEAST_VOTES or sum(n for (b, c), n in shown.items() if known[best][b] == c) < whole / 2:
            break
        chosen.append(best)
        left = {(b, c): n for (b, c), n in left.items() if known[best][b] != c}
    if sum(left.values()) > (1 - AGREES) * whole or len(shown) < LEAST_SHOWN:
        # of no standard codec: believed if enough is shown, and shows one byte for each character
        alike = sum(max(bs.values()) for bs in chars.values())
        return [(whole, chars)] if len(chars) >= LEAST_UNKNOWN and alike >= ALIKE * whole else []
    # each on its own: a run is read by one of them
    votes = {e: sum(n for (b, c), n in shown.items() if known[e][b] == c) for e in chosen}
    return [(votes[e], {c: {b: 1.0} for b, c in known[e].items()}) for e in chosen]


def substitutions(neighbours: dict[tuple[str, str], int]) -> list[dict[str, str]]:
    """Characters and what they were, put together from neighbours that were met together, as long as none stands for two."""
    maps: dict[str, dict[str, str]] = {}
    of: dict[str, str] = {}
    for (a, b), n in sorted(neighbours.items(), key=lambda x: (-x[1], x[0])):
        if n < LEAST_MET:
            break
        for x in (a, b):
            if x not in of:
                of[x] = x
                maps[x] = {x[0]: x[1]}
        p, q = of[a], of[b]
        if p != q and all(maps[p].get(k, v) == v for k, v in maps[q].items()):
            maps[p] |= maps.pop(q)
            for x, o in of.items():
                if o == q:
                    of[x] = p
    found = [m for m in maps.values() if sum(k != v for k, v in m.items()) >= LEAST_LETTERS]
    out = []
    for m in sorted(found, key=lambda m: sorted(m.items())):
        full = _completed_map(m)
        if full and full not in out:
            out.append(full)
    return out


def _completed_map(m: dict[str, str]) -> dict[str, str]:
    """With the letters of the one encoding read as another that all of it agrees with, if there is one."""
    known = _codecs()
    best = None
    for e, true in sorted(known.items()):
        back = {c: b for b, c in true.items()}
        for f, read in sorted(known.items()):
            if e != f:
                whole = {read[b]: c for c, b in back.items()}
                hits = sum(whole.get(k) == v for k, v in m.items())
                if best is None or hits > best[0]:
                    best = (hits, whole)
    if best and best[0] >= AGREES * len(m):
        return m | best[1]
    # letters that only change places among themselves are two sentences of one frame, not a misreading
    return m if len(m) >= LEAST_UNKNOWN and len(m.keys() & set(m.values())) < len(m) / 2 else {}


def unswap(run: str, swap: dict[str, str]) -> str | None:
    try:
        return "".join([swap[c] for c in run])
    except KeyError:
        return None


def _chain_votes(found: list[Table]):
    """For runs that take two misreadings in a row to explain, which two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str]] = set()
        for b in batches:
            rows = []
            for form, twin in zip(b["form"], b["twin"]):
                for g, c in zip(_align(form), _align(twin)):
                    if not c or len(g) <= len(c.encode("utf-8")) or (g, c) in seen:
                        continue
                    seen.add((g, c))
                    rows += [(i * len(found) + j, g, c) for i, x in enumerate(found) for j, y in enumerate(found) if undo_chain(g, (x, y)) == c]
            yield pd.DataFrame(rows, columns=["chain", "garbled", "clean"])

    return run


def _align(form: str) -> list[str]:
    """The non-ASCII runs before, between and after the ASCII characters."""
    out, at = [], 0
    for m in _RUN.finditer(form):
        out += [""] * (m.start() - at) + [m[0]]
        at = m.end() + 1
    return out + [""] * (len(form) - at + 1)


class Restorer:
    """Applies learnt misreadings to texts; remembers runs, which repeat."""

    def __init__(self, found: list[Table], chains: list[tuple[int, ...]], alphabet: str, swaps: list[dict[str, str]] = (), pairs: dict[str, int] | None = None):
        self.swaps = list(swaps)
        pairs = pairs or {}
        total = sum(pairs.values()) + 1
        self.logs = {k: math.log(n / total) for k, n in pairs.items()}
        self.rare = math.log(0.1 / total)
        self.chains = [tuple(found[k] for k in c) for c in sorted(chains, key=lambda c: (-len(c), c))]
        self.alphabet = set(alphabet)
        self.runs: dict[str, str | None] = {}
        self.gains: dict[str, list[tuple[float, str]]] = {}
        # the garbled sequences of the alphabet, to know a run whose bytes were lost in part
        seqs = set()
        for c in self.alphabet:
            for chain in self.chains:
                ways = [c]
                for t in reversed(chain):
                    ways = [m for w in ways for m in t.misread(w)]
                seqs.update(w for w in ways if not w.isascii() and len(w) > 1)
        self.sequences = re.compile("|".join(map(re.escape, sorted(seqs, key=lambda s: (-len(s), s))))) if seqs else None

    def run(self, r: str) -> str | None:
        """The restored run; the run itself if it is clean; None if bytes were lost."""
        got = self.runs.get(r, "")
        if got != "":
            return got
        got = r
        for chain in self.chains:
            t = undo_chain(r, chain)
            if t is not None and self.alphabet.issuperset(t):
                got = t
                break
        else:
            if self.sequences and len(r) > 1:
                covered = sum(len(m[0]) for m in self.sequences.finditer(r))
                got = None if covered * 2 > len(r) and covered >= 4 else r
        if len(self.runs) > 500_000:
            self.runs.clear()
        self.runs[r] = got
        return got

    def likelihood(self, r: str) -> float:
        get, rare = self.logs.get, self.rare
        return sum(get(a + b, rare) for a, b in zip(" " + r, r + " "))

    def gain(self, r: str) -> list[tuple[float, str] | None]:
        """For each substitution how much likelier the run is after it, and the run then; None where it does not apply."""
        got = self.gains.get(r)
        if got is None:
            if len(self.gains) > 200_000:
                self.gains.clear()
            own, got = self.likelihood(r), []
            for swap in self.swaps:
                new = unswap(r, swap)
                got.append(None if new is None else (self.likelihood(new) - own, new))
            self.gains[r] = got
        return got

    def unswapped(self, t: str) -> tuple[str, bool]:
        """The text with the clauses that a substitution makes far likelier put right.

        A substitution that some clause of the text leaves no doubt about is applied to its short
        clauses too, as far as they gain by it.
        """
        clauses, at = [], 0
        for end in [m.start() for m in _CLAUSE.finditer(t)] + [len(t)]:
            clauses.append((t[at:end], _RUN.findall(t, at, end)))
            at = end
        sure: set[int] = set()
        gains = []
        for k, (_, runs) in enumerate(clauses):
            if not runs:
                continue
            size = sum(map(len, runs))
            each = [self.gain(r) for r in runs]
            for s in range(len(self.swaps)):
                own = [g[s] for g in each]
                if None not in own:
                    gain = sum(g for g, _ in own)
                    new = [n for _, n in own]
                    if gain > 1 and new != runs:
                        gains.append((gain, k, s, new))
                        if gain > max(LEAST_GAIN, LEAST_GAIN_EACH * size):
                            sure.add(s)
        if not sure:
            return t, False
        best: dict[int, tuple] = {}
        for gain, k, s, new in gains:
            if s in sure and (k not in best or gain > best[k][0]):
                best[k] = (gain, new)
        out = []
        for k, (clause, _) in enumerate(clauses):
            if k in best:
                it = iter(best[k][1])
                clause = _RUN.sub(lambda _, it=it: next(it), clause)
            out.append(clause)
        return "".join(out), True

    def text(self, t: str) -> tuple[bool, str | None]:
        """(affected, original text or None if it cannot be restored)."""
        if LOST in t:
            return True, None
        if t.isascii():
            return False, t
        out, at, touched, lost = [], 0, False, False
        for m in _RUN.finditer(t):
            r = self.run(m[0])
            if r is None:
                lost = True
            elif r != m[0]:
                touched = True
                out += [t[at : m.start()], r]
                at = m.end()
        if lost:
            return True, None
        if touched:
            t = "".join([*out, t[at:]])
        if self.swaps:
            t, swapped = self.unswapped(t)
            touched |= swapped
        return touched, t


def _few(df: DataFrame) -> list:
    rows = df.limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError("more misreadings than there are encodings")
    return rows


def learn(docs: DataFrame, store: Store) -> tuple[list[Table], list[tuple[int, ...]], str, list[dict[str, str]], dict[str, int]]:
    """(tables, chains of them, alphabet, substitutions, character pairs of the clean twins).

    All are bounded: by the bytes, by the encodings met, by the characters of Unicode, by the pairs of the substitutions' characters.
    """
    forms = store.keep(docs.select("text").mapInPandas(_forms, "key string, form string, n long").groupBy("key", "form").agg(F.sum("n").alias("n")))
    # the shortest form, then the most frequent
    twin = forms.groupBy("key").agg(F.min_by("form", F.struct(F.length("form"), -F.col("n"), "form")).alias("twin"))
    twin = store.keep(twin)
    pairs = store.keep(forms.join(twin, "key").filter("form <> twin").select("key", "form", "twin"))
    shown = pairs.withColumn("key", F.hash("key")).mapInPandas(_items, "what int, a string, b string, key int").distinct().groupBy("what", "a", "b").agg(F.count("*").alias("n"))
    rows = _few(shown.filter(F.col("n") >= F.when(F.col("what") == 2, LEAST_MET).otherwise(1)))
    shows = [{(r.a, r.b): r.n for r in rows if r.what == w} for w in range(3)]
    found = tables(shows[0], shows[1])
    swaps = substitutions(shows[2])
    chains: list[tuple[int, ...]] = [(k,) for k in range(len(found))]
    if found:
        votes = pairs.mapInPandas(_chain_votes(found), "chain int, garbled string, clean string").distinct().groupBy("chain").agg(F.count("*").alias("votes"))
        chains += [divmod(r.chain, len(found)) for r in votes.filter(F.col("votes") >= LEAST_VOTES).collect()]

    def common(column, table):
        letters = table.select("key", F.explode(F.array_distinct(F.split(F.regexp_replace(column, r"[\x00-\x7f]", ""), ""))).alias("c")).filter("c <> ''")
        return {r.c for r in letters.groupBy("c").agg(F.count_distinct("key").alias("n")).filter(F.col("n") >= LEAST_KEYS).collect()}

    clean = common("twin", twin)
    # a script in use brings its other letters along, so far as any text has them
    scripts = Counter(ord(c) >> 7 for c in clean if unicodedata.category(c)[0] in "LM")
    alphabet = clean | {c for c in common("form", forms) if unicodedata.category(c)[0] in "LM" and scripts[ord(c) >> 7] >= 8}
    counts = {}
    if swaps:
        met = {c for s in swaps for kv in s.items() for c in kv} | {" "}
        seen = twin.select("twin").mapInPandas(_pairs(met), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        counts = {r.pair: r.n for r in _few(seen)}
    return found, chains, "".join(sorted(alphabet)), swaps, counts


def _pairs(met: set[str]):
    """Neighbouring characters of those that substitutions know."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = Counter(x + y for t in b["twin"] for r in _RUN.findall(t) for x, y in zip(" " + r, r + " ") if x in met and y in met)
            yield pd.DataFrame(list(c.items()), columns=["pair", "n"])

    return run


def _apply(*model):
    def run(batches):
        restorer = Restorer(*model)
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"]):
                if not t:
                    continue
                hit, whole = restorer.text(t)
                if hit:
                    rows.append((i, whole))
            yield pd.DataFrame(rows, columns=["doc_id", "restored"])

    return run


def restored(docs: DataFrame) -> DataFrame:
    """(doc_id, restored) of the affected documents; restored is null where bytes were lost."""
    model = learn(docs, Store(docs.sparkSession))
    return docs.select("doc_id", "text").filter(r"text rlike '[^\\x00-\\x7f]'").mapInPandas(_apply(*model), "doc_id long, restored string")


def garbled_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, restored_md5): lower-case hex MD5 of the restored text's UTF-8 bytes, or an empty string."""
    return restored(docs).select("doc_id", F.coalesce(F.md5(F.encode("restored", "UTF-8")), F.lit("")).alias("restored_md5"))
