"""Profiles of catalogue records: kind of item, type number, attributes, amount, with a lexicon learnt from the records.

Two passes over the descriptions: one counts words, for the speller; one reads each description into
features, which are kept.  What the lexicon learns from is aggregated from the features in the engine; only words and
names known in a given share of all records reach the driver (`functions.lexicon`).

Defined cases: null, blank and very long descriptions have the features they state, if any; without
a listing a record casts no vote; an empty input gives an empty lexicon and no profiles; other columns
are ignored unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import catalogue, lexicon
from weftline.session import Store

#: Known words that may reach the driver: far more than a share of 2e-4 leaves of texts of a few hundred words.
MOST_KNOWN = 1_000_000

_FEATURES = "words string, attrs string, types string, amounts string, numbers string, keys string, times string, number string, unit string"
_PROFILE = "kind string, type string, attrs string, whole boolean, parts int, times string, number string, unit string, stated boolean, content string"


def _known(counted: DataFrame, least: float) -> list:
    """The rows of at least that count; a table bounded by the share that `least` stands for."""
    rows = counted.filter(F.col("n") >= least).limit(MOST_KNOWN + 1).collect()
    if len(rows) > MOST_KNOWN:
        raise ValueError("more words are known than a catalogue's")
    return rows


def word_counts(texts: DataFrame, least: float) -> dict[str, int]:
    """How many records hold each word of three letters or more that at least that many hold."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("d"), F.lit(r"(\p{L}{3,29})"), 1))
    return {r.w: r.n for r in _known(texts.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")), least)}


_PARSERS: dict[int, catalogue.Parser] = {}


def _parser(counts: dict[str, int]) -> catalogue.Parser:
    """One parser for a worker and its words, which keeps what it has read from task to task."""
    key = hash(frozenset(counts.items()))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = catalogue.Parser(counts)
    return _PARSERS[key]


def _reader(keep: list[str], counts: dict[str, int]):
    units: dict[str | None, tuple] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = _parser(counts).features
        for b in batches:
            rows = []
            for text, uom in zip(b["__description"], b["__uom"]):
                words, found, types, amounts, numbers = features(text)
                if uom not in units:
                    if len(units) > 100_000:
                        units.clear()
                    units[uom] = catalogue.unit_of_issue(uom)
                n, unit = units[uom]
                keys = sorted(found) + sorted({f"{catalogue.dimension(a[2])}_" for a in amounts if a[2]} or ({"amount"} if amounts else ()))
                rows.append((
                    " ".join(sorted(words)), ";".join(f"{k}={v}" for k, v in found.items()), " ".join(types),
                    ";".join(f"{a[0]}|{a[1]}|{a[2]}|{a[3]}" for a in amounts), " ".join(numbers), " ".join([*keys, "type"] if types else keys), "1" if n else None, n, unit,
                ))
            out = pd.DataFrame(rows, columns=["words", "attrs", "types", "amounts", "numbers", "keys", "times", "number", "unit"])
            yield pd.concat([b[keep].reset_index(drop=True), out], axis=1)

    return run


def _head(df: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[: len(keep)])


def features(df: DataFrame, keep: list[str], store: Store, description: str = "description", uom: str = "uom") -> tuple[DataFrame, dict[str, int], int]:
    """(kept features of each record, with `keep`; the known words; how many records there are)."""
    src = df.select(*keep, F.col(description).cast("string").alias("__description"), F.col(uom).cast("string").alias("__uom"))
    n = src.count()
    counts = word_counts(src.select(F.col("__description").alias("d")), least_count(n))
    return store.keep(src.mapInPandas(_reader(keep, counts), f"{_head(src, keep)}, {_FEATURES}")), counts, n


def least_count(records: int) -> float:
    return max(lexicon.KNOWN_LEAST, lexicon.KNOWN_SHARE * records)


def learn(read: DataFrame, counts: dict[str, int], records: int, store: Store, listing: str | None) -> lexicon.Lexicon:
    """The lexicon of kept features; listing: a column that is alike for deliveries of one item."""
    least = least_count(records)
    # each word beside each set of attributes of its records; "" stands for any record
    ws = F.concat(F.array(F.lit("")), F.filter(F.split("words", " "), lambda w: w != ""))
    met = store.keep(read.select(F.explode(ws).alias("w"), "keys").groupBy("w", "keys").agg(F.count("*").alias("n")))
    seen = {r.w: r.n for r in _known(met.filter("w <> ''").groupBy("w").agg(F.sum("n").alias("n")), least)}
    known = F.broadcast(read.sparkSession.createDataFrame([(w,) for w in ["", *seen]], "w string"))
    each = met.join(known, "w").select("w", F.explode(F.split("keys", " ")).alias("k"), "n").filter("k <> '' and k <> 'type'")
    beside = {(r.w, r.k): r.n for r in each.groupBy("w", "k").agg(F.sum("n").alias("n")).collect()}
    attributes = {k: n for (w, k), n in beside.items() if not w}
    idle = lexicon.idle_words(seen, beside, attributes, max(records, 1))
    # a record's name: its words but for the idle ones
    name = F.array_join(F.filter(F.split("words", " "), lambda w: ~w.isin(sorted(idle))), " ") if idle else F.col("words")
    named = store.keep(read.select(name.alias("name"), "keys").filter("name <> ''").groupBy("name", "keys").agg(F.count("*").alias("n")))
    names = {r.name: r.n for r in _known(named.groupBy("name").agg(F.sum("n").alias("n")), least)}
    if not names:
        return lexicon.Lexicon(counts, frozenset(idle))
    spark = read.sparkSession
    order = sorted(names)
    table = F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(order)], "name string, i int"))  # at most 1 / KNOWN_SHARE rows
    # "" counts the records that state anything
    each = F.explode(F.concat(F.array(F.lit("")), F.split("keys", " "))).alias("k")
    counted = named.filter("keys <> ''").join(table, "name").select("i", each, "n").groupBy("i", "k").agg(F.sum("n").alias("n")).collect()
    stated, some = [r for r in counted if r.k], [r for r in counted if not r.k]
    kinds = {n: n for n in order}
    if listing is not None:
        kinds.update(lexicon.linked_names(_votes(read, name, listing, table, order)))
    own, content = _own(kinds, order, stated, some)
    settled = lexicon.settle(kinds, names, own, content)
    own, content = _own({n: k for n, k in settled.items() if k}, order, stated, some)
    return lexicon.Lexicon(counts, frozenset(idle), settled, own, content)


def _votes(read: DataFrame, name, listing: str, table: DataFrame, order: list[str]) -> dict[tuple[str, str], int]:
    """In how many listings two known names, or one twice, stand for one item."""
    said = read.filter(F.col(listing).isNotNull()).select(F.xxhash64(listing).alias("l"), name.alias("name")).join(table, "name")
    said = said.groupBy("l", "i").agg((F.count("*") > 1).alias("more"))
    # a row has known names only, which their share bounds; listings of the same names vote together
    group = said.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("i", "more"))).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    # one name's pairs at a time: a listing may have any number of names
    each = group.select("n", "s", F.explode("s").alias("x"))
    others = F.filter("s", lambda y: (F.col("x.i") < y["i"]) | ((F.col("x.i") == y["i"]) & F.col("x.more")))
    got = each.select("n", "x", F.explode(others).alias("y")).groupBy(F.col("x.i").alias("a"), F.col("y.i").alias("b")).agg(F.sum("n").alias("n"))
    return {(order[r.a], order[r.b]): r.n for r in got.collect()}


def _own(kinds: dict[str, str], order: list[str], stated: list, some: list) -> tuple[dict, dict]:
    """(attributes of each kind, what it is sold by)."""
    total: dict[str, int] = {}
    for r in some:
        k = kinds.get(order[r.i])
        total[k] = total.get(k, 0) + r.n
    count: dict[tuple[str, str], int] = {}
    for r in stated:
        k = kinds.get(order[r.i])
        count[k, r.k] = count.get((k, r.k), 0) + r.n
    dims = ("mass_", "volume_", "length_")  # what an amount measures, not to be taken for an attribute
    own: dict[str, list[str]] = {k: [] for k in total if k}
    content: dict[str, str] = {}
    for (k, a), n in sorted(count.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        if not k or not a or k not in total:
            continue
        if a in dims:
            if n >= lexicon.SOLD * total[k] and n >= count.get((k, content.get(k)), 0):
                content[k] = a
        elif a not in ("type", "amount") and n >= lexicon.OWN * total[k]:
            own[k].append(a)
    for k, n in total.items():
        if k and k not in content and sum(count.get((k, a), 0) for a in (*dims, "amount")) >= lexicon.SOLD * n:
            content[k] = lexicon.ANY
    return {k: tuple(v) for k, v in own.items()}, {k: d.rstrip("_") for k, d in content.items()}


def _profiler(keep: list[str], lex: lexicon.Lexicon):
    kinds: dict[str, str | None] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for words, attrs, types, amounts, numbers, times, n, unit in zip(b["words"], b["attrs"], b["types"], b["amounts"], b["numbers"], b["times"], b["number"], b["unit"]):
                found = dict(x.split("=", 1) for x in attrs.split(";")) if attrs else {}
                said = [(t, x, u, int(r)) for t, x, u, r in (a.split("|") for a in amounts.split(";"))] if amounts else []
                kind = kinds.get(words, "")
                if kind == "":
                    if len(kinds) > 200_000:
                        kinds.clear()
                    kind = kinds[words] = lex.kind(words.split())
                kind, number, own, whole, amount, content = lex.profile(kind, words, found, types.split(), said, numbers)
                if amount is not None:
                    times, n, unit = amount[0], amount[1], amount[2] or unit
                rows.append((kind, number, ";".join(f"{k}={v}" for k, v in own.items()), whole, len(own), times, n, unit if n else None, amount is not None, content))
            out = pd.DataFrame(rows, columns=["kind", "type", "attrs", "whole", "parts", "times", "number", "unit", "stated", "content"])
            yield pd.concat([b[keep].reset_index(drop=True), out], axis=1)

    return run


def profiles(materials: DataFrame, keep: list[str], store: Store, listing: str | None, only: str | None = None, description: str = "description", uom: str = "uom") -> tuple[DataFrame, lexicon.Lexicon]:
    """(`keep` and the profile of each record, kept: kind, type, attrs, whole, parts, times, number, unit, stated, content; what was learnt).

    only: a condition on the features (words, attrs, types, amounts, numbers, keys, times, number, unit) of the records
    that are to have a profile; all are learnt from.
    """
    read, counts, n = features(materials, keep, store, description, uom)
    lex = learn(read, counts, n, store, listing)
    wanted = read if only is None else read.filter(only)
    got = store.keep(wanted.mapInPandas(_profiler(keep, lex), f"{_head(read, keep)}, {_PROFILE}"))
    store.drop(read)
    return got, lex
