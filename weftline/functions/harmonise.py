"""Text normalisation, classification, attributes, identity and codes as SQL expressions.

Every function takes a dialect and the text of its input expressions, so that the engine and
its check are built from the same dictionary.
"""

from __future__ import annotations

from weftline.functions.dialect import Dialect
from weftline.functions.rules import CLEANUP, FAMILY, IDENTITY, LABELS, ORDER, PATTERNS, PRETTY, TOKENS, TYPES, UOMS, WORD_RULES

#: Letters beyond ASCII count as word characters in Spark; the checking engine sees words in their place.
FOREIGN = {"ø": "qzoslashq", "μ": "qzmuq", "µ": "qzmicroq"}
_DECIMALS = r"(8\.8|10\.9|12\.9|4\.6|5\.6|6\.8)"


def normal_steps(d: Dialect, x: str) -> str:
    """The normalised text of a lower-case one."""
    if not d.spark:
        for a, b in FOREIGN.items():
            x = f"replace({x}, '{a}', '{b}')"
    for pattern, put in [*CLEANUP, *WORD_RULES]:
        if not d.spark and "(?<!" in pattern:
            # no look-behind there: what it spares is tied together for the moment
            x = d.sub(x, rf"grade {_DECIMALS}\b", r"grade_\1")
            x = d.sub(x, rf"\b{_DECIMALS}\b", r"grade \1")
            x = f"replace({x}, 'grade_', 'grade ')"
        elif not d.spark and "(?!" in pattern:
            x = d.sub(x, pattern.replace("(?![a-z0-9])", "([^a-z0-9]|$)"), put + r"\2")
        else:
            x = d.sub(x, pattern, put)
    if not d.spark:
        for a, b in FOREIGN.items():
            x = f"replace({x}, '{b}', '{a}')"
    return f"trim({d.sub(x, ' +', ' ')})"


def fine_type(d: Dialect, t: str) -> str:
    return d.cases([(d.holds(t, w), f"'{w}'") for w in TYPES], "'unknown'")


def category(d: Dialect, fine: str) -> str:
    return d.cases([(f"{fine} = '{w}'", f"'{c}'") for w, c in TYPES.items()], "'unknown'")


def uom(d: Dialect, u: str) -> str:
    x = d.sub(f"upper(trim(coalesce({u}, '')))", r"\.+$", "")
    return d.cases([(f"{x} IN ({', '.join(repr(a) for a in names)})", f"'{k}'") for k, names in UOMS.items()] + [(f"{x} = ''", "'NOS'")], x)


def rate(d: Dialect, v: str) -> str:
    """A double, or null where the text without commas is no number."""
    x = f"replace(trim({v}), ',', '')"
    return f"CASE WHEN {d.has(x, r'^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$')} THEN TRY_CAST({x} AS DOUBLE) END"


def attributes(d: Dialect, t: str, fine: str) -> dict[str, str]:
    """Attribute -> expression, null where the text has none."""
    a: dict[str, str] = {}
    for key, pattern, form in PATTERNS:
        before, after = form.split("{}")
        x = d.get(t, pattern)
        parts = ([f"'{before}'"] if before else []) + [x] + ([f"'{after}'"] if after else [])
        a[key] = " || ".join(parts)
    for key, whole, table in TOKENS:
        test = d.word if whole else d.holds
        a[key] = d.cases([(test(t, w), f"'{v}'") for w, v in table.items()])
    # head only where the text speaks of one
    a["head"] = f"CASE WHEN {d.holds(t, 'pump')} OR {d.holds(t, 'head')} THEN {d.get(t, chr(92) + 'b([0-9]+) m' + chr(92) + 'b')} || ' m' END"
    fastener = " OR ".join([d.has(t, r"\bhex (head )?bolt"), *(d.holds(t, w) for w in ("stud", "socket head cap screw", "nut", "washer"))])
    both = d.get(t, r"\bm(\d{1,2}x\d{1,3})\b")
    one = d.get(t, r"\bm(\d{1,2})\b")
    a["thread"] = f"coalesce('M' || {both}, CASE WHEN {fastener} THEN 'M' || {one} END)"
    # bearings: cylindrical ones by their letters, others by the first long number that is no standard
    near = " OR ".join(d.holds(t, w) for w in ("bearing", "groove", "roller", "nu ", "nu3"))
    bare = d.sub(t, r"\b(?:din|iso|is|astm|asme)\s?\d{3,5}\b", " ")
    nu = r"\bnu ?(\d{3,4})( e)?\b"
    lettered = f"'NU' || {d.get(t, nu)} || upper(regexp_extract({t}, {d.text(nu)}, 2))"
    number = d.get(bare, r"\b([1-9]\d{3,4})\b")
    long_ = r"\b([1-9]\d{3,4})(?:\s*(2rs|zz|cc w33|w33))?\b"
    follows = d.get(bare, long_, 2)
    e = f"CASE WHEN {follows} IS NULL AND regexp_extract({bare}, {d.text(chr(92) + 'b([1-9][0-9]{3,4}) e' + chr(92) + 'b')}, 1) = {number} THEN ' E' ELSE '' END"
    a["designation"] = f"CASE WHEN {near} THEN CASE WHEN {d.has(t, nu)} THEN {lettered} ELSE {number} || {e} END END"
    words = d.cases([(d.holds(t, w), f"'{w}'") for w in ("2rs", "zz", "cc w33", "w33")])
    open_ = f"CASE WHEN {d.holds(t, 'open')} AND ({' OR '.join(d.holds(t, w) for w in ('bearing', 'groove', 'roller'))}) THEN 'open' END"
    a["seal"] = f"coalesce(CASE WHEN ({near}) AND NOT {d.has(t, nu)} THEN {follows} END, {words}, {open_})"
    plain = d.get(t, r"\bgrade (\d{1,2}(?:\.\d)?)\b")
    eight = f"CASE WHEN {fine} IN ('hex nut', 'nut', 'flat washer', 'washer') AND {d.word(t, '8')} THEN '8' END"
    a["grade"] = d.cases([(d.word(t, "b7"), "'B7'"), (d.word(t, "b16"), "'B16'")], f"coalesce({plain}, {eight})")
    cable = r"\b(\d(?:\.\d)?)c x (\d+(?:\.\d+)?) sqmm\b"
    a["cable_size"] = f"{d.get(t, cable, 1)} || 'Cx' || {d.get(t, cable, 2)}"
    pack = d.get(t, r"\b(\d+(?:\.\d+)?) (?:kg|l)\b")
    a["pack"] = f"{pack} || CASE WHEN {d.has(t, chr(92) + 'b[0-9]+([.][0-9]+)? kg' + chr(92) + 'b')} THEN ' kg' ELSE ' L' END"
    number_of = (lambda v: f"cast({v} AS INT)")
    mm = d.each(d.all(t, r"\b(\d{2,4}) mm\b"), number_of)
    most = f"array_max({mm})" if d.spark else f"list_max({mm})"
    a["length"] = f"CASE WHEN {fine} IN ('thermowell', 'level indicator') THEN cast({most} AS STRING) || ' mm' END"
    inches = d.sorted_distinct(d.each(d.all(t, r"(\d+(?:\.\d+)?) inch"), lambda v: f"cast({v} AS DOUBLE)"))
    a["inch"] = f"nullif({d.join(d.each(inches, lambda v: f'cast({v} AS STRING)'), ',')}, '')"
    stds = d.sorted_distinct(d.all(t, r"\b((?:din|iso|is|astm|asme)\s?(?:a\d{3}|\d{3,5}))\b"))
    a["std"] = f"nullif({d.join(stds, ',')}, '')"
    return a


def pairs_text(d: Dialect, a: dict[str, str]) -> str:
    """`key=value` of the attributes present, sorted by key, joined by ';'."""
    parts = ", ".join(f"'{k}=' || {a[k]}" for k in sorted(a))
    return f"concat_ws(';', {parts})"


def missing(d: Dialect, fine: str, a) -> str:
    """The identity attributes a record lacks, joined by ','; `identity` where its type has no identity."""
    rows = []
    for kind, keys in IDENTITY.items():
        lacks = ", ".join(f"CASE WHEN {a(k)} IS NULL THEN '{k}' END" for k in keys)
        rows.append((f"{fine} = '{kind}'", f"concat_ws(',', {lacks})"))
    return d.cases(rows, "'identity'")


def complete(d: Dialect, fine: str, a) -> str:
    """Is every identity attribute there?  Bolts, nuts and cap screws not of stainless steel also need their grade."""
    graded = f"{fine} IN ('hex bolt', 'hex nut', 'socket head cap screw') AND coalesce({a('material')}, '') NOT IN ('SS316', 'SS304')"
    return f"({missing(d, fine, a)} = '' AND NOT ({graded} AND {a('grade')} IS NULL))"


def shown(d: Dialect, key: str, v: str) -> str:
    """An attribute's value as codes and descriptions show it."""
    if key == "inch":
        many = f"split({v}, ',')" if d.spark else f"string_split({v}, ',')"
        return f"({d.join(d.each(many, lambda x: x + chr(32) + '|| ' + repr('IN')), '-')})"
    if key == "std":
        return f"upper(replace({v}, ',', '/'))"
    return d.cases([(f"{v} = '{k}'", f"'{p}'") for k, p in PRETTY.items()], f"upper(replace({v}, ' ', ''))")


def canonical(d: Dialect, fine: str, unit: str, a) -> str:
    """FAMILY|UNIT|LABEL=VALUE|... in the fixed order."""
    family = d.cases([(f"{fine} = '{k}'", f"'{f}'") for k, f in FAMILY.items()], "'GEN'")
    parts = ", ".join(f"'{LABELS[k]}=' || {shown(d, k, a(k))}" for k in ORDER)
    return f"concat_ws('|', {family}, {unit}, {parts})"


def code(d: Dialect, canon: str) -> str:
    family = f"split_part({canon}, '|', 1)"
    return f"'NMC-' || {family} || '-' || upper(substr(sha1({canon}), 1, 8))"


def description(d: Dialect, fine: str, unit: str, a) -> str:
    """TYPE | value | ... | UNIT; a material that repeats the finish is left out."""
    parts = []
    for k in ORDER:
        v = shown(d, k, a(k))
        if k == "material":
            v = f"CASE WHEN {a('finish')} IS NULL OR {a('finish')} <> {a('material')} THEN {v} END"
        parts.append(v)
    return f"concat_ws(' | ', upper({fine}), {', '.join(parts)}, {unit})"
