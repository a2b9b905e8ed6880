"""Reads a material description into features: words, technical attributes, type numbers, amounts.

The grammar below is that of technical notation (threads, bores, ratings, materials, quantities with
their units) in its many spellings; no item, make or selling word is known to it, which ones there
are is learnt from the data (`functions.lexicon`).  `Parser` splits a description at its
separators and remembers each distinct piece, since pieces repeat across millions of
rows while whole descriptions do not.
"""

from __future__ import annotations

import re
from fractions import Fraction

# --- fixed values: conversions ---
#: Nominal bore in inches and its DN; rated power in HP and its kW.
BORES = {"0.5": 15, "0.75": 20, "1": 25, "1.25": 32, "1.5": 40, "2": 50, "2.5": 65, "3": 80, "4": 100, "5": 125, "6": 150, "8": 200, "10": 250, "12": 300, "14": 350, "16": 400, "18": 450, "20": 500, "24": 600}
_DN = frozenset(BORES.values())
POWERS = {"0.5": "0.37", "1": "0.75", "1.5": "1.1", "2": "1.5", "3": "2.2", "5": "3.7", "7.5": "5.5", "10": "7.5", "15": "11", "20": "15", "25": "18.5", "30": "22", "40": "30", "50": "37", "60": "45", "75": "55", "100": "75", "120": "90", "125": "90", "150": "110"}
# --- the unit spellings met in amounts; what each means is learnt or known (see operators.units) ---
UNIT = (
    r"millilitres?|milliliters?|kilolitres?|kilograms?|kilogramme?s?|kilometres?|kilometers?|centimetres?|centimeters?|millimetres?|millimeters?|"
    r"us gallons?|us gal|us quarts?|us qts?|us qt|gallons?|gals?|quarts?|qts?|metric tonn?e?s?|metric tons?|m tons?|tonnes?|tons?|mt|quintals?|qtls?|"
    r"pounds?|lbs?|ounces?|ozs?|grams?|gms?|kgs?|kgm|kilos?|litres?|liters?|ltrs?|lits?|cms?|kms?|mtrs?|metres?|meters?|yards?|yds?|feet|foot|fts?|"
    r"cu ?m|cum|m3|m³|cu ?cm|cu ?ft|mls?|mm|cc|kl|kg|gm|lt|l|g|m"
)
_N = r"\d+[ -]\d/\d|\d/\d|\d+(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
_HOLD = r"pack of|pack|net|qty|content|roll of|coil of|drum of|pail of|can of|bag of|tube of|bottle of|roll|coil|drum|pail|can|bag|tube|bottle|btl|box|carton|reel"
_PER = r"(?:per )?(?:coil|drum|roll|pail|can|bag|tube|bottle|reel|box)s?"
_PATTERNS = [
    ("stainless", r"(?P<y4>(?:ss|aisi|stainless steel) ?-?304)(?!\d)|(?P<y6>(?:ss|aisi|stainless steel) ?-?316)(?!\d)"),
    ("drop", r"(?:ref po|ref p o|po|indent|old code|old mat code|ref|your ref)(?: no)?[ :#-]*[a-z]{0,3}[ -]?\d[\do]{3,}"),
    ("make", r"(?:make|mfr|brand)[ :]+[^\W\d_]{3,}"),
    ("std", r"(?:asme|astm|api|aws|din|iso|iec|en)(?: ptc)?[ -]?[a-z]?[ -]?\d+(?:\.\d+)?[a-z]?|is[ -]\d{3,4}(?!\d)|bs[ -]\d{3,4}(?!\d)|iso[ -]?\d{4,5}"),
    ("amount", rf"(?:(?P<hold>{_HOLD})[ :]*)?(?P<times>\d+) ?(?:nos|no|pcs|ea)? ?x ?(?P<n1>{_N})[ -]?(?P<u1>{UNIT})(?![a-z0-9/³²])(?: {_PER})?"),
    ("thread", r"(?:dia )?m ?(?P<td>\d{1,2})(?: ?x ?| length )(?P<tl>\d+(?:\.\d+)?) ?(?P<tu>mm|cm|m)?(?![a-z0-9.])"),
    ("cores", r"(?P<co1>\d{1,2}) ?(?:c|cores?)[ -]?x?[ -]?(?P<sq1>\d+(?:\.\d+)?)(?: ?(?:sq ?mm|mm2|mm²))?(?![0-9.])|(?P<sq2>\d+(?:\.\d+)?) ?(?:sq ?mm|mm2|mm²)[ -]?x?[ -]?(?P<co2>\d+) ?(?:cores?|c)(?![a-z])"),
    ("flow", r"(?P<fn>\d+(?:\.\d+)?) ?(?P<fu>lit/min|l/min|lpm|m³/hr?|m3/hr?|cum/hr?|cum/hour)"),
    ("head", r"(?:h=|head:? )(?P<hn1>\d+(?:\.\d+)?) ?(?P<hu1>mm|cm|m)(?![a-z0-9])|(?P<hn2>\d+(?:\.\d+)?) ?(?P<hu2>mm|cm|m) head"),
    ("range", r"(?:range )?0 ?(?:-|to) ?(?P<rn>\d+(?:\.\d+)?) ?(?P<ru>bar|mpa|kpa)"),
    ("press", r"(?:wp )?(?P<pn>\d+(?:\.\d+)?) ?(?P<pu>bar|mpa|kpa)(?: (?:wp|working))?"),
    ("length", r"(?:l=|length:? )(?P<ln1>\d+(?:\.\d+)?) ?(?P<lu1>mm|cm|m)(?![a-z])|(?P<ln2>\d+(?:\.\d+)?) ?(?P<lu2>mm|cm|m) (?:lg|long)(?![a-z])"),
    ("dial", r"dial(?: size)?:? (?P<dn1>\d+(?:\.\d+)?) ?(?P<du1>mm|cm)|(?P<dn2>\d+(?:\.\d+)?) ?(?P<du2>mm|cm) dial"),
    ("bore", r"(?P<b1>\d{1,3}) ?(?:mm )?nb(?![a-z\d])|dn ?(?P<b2>15|20|25|32|40|50|65|80|100|125|150|200|250|[3-6]00|350|450)(?![\do]|[./-]\d| \d{3}(?![\d #]|lb))|nps ?(?P<b3>\d+-\d/\d|\d+/\d+|\d+(?:\.\d+)?)|(?P<b4>\d+-\d/\d|\d+/\d+|\d+(?:\.\d+)?) ?(?:\"|inch(?:es)?(?![a-z])|in(?![a-z]))"),
    ("nutthread", r"(?P<nt>\d{1,2}) ?mm thread"),
    ("dia", r"(?:ø ?|dia:? )(?P<di1>\d+(?:\.\d+)?)(?: ?(?P<iu1>mm|cm)(?![a-z]))?|(?P<di2>\d+(?:\.\d+)?) ?(?P<iu2>mm|cm) dia(?![a-z])"),
    ("strands", r"(?P<st>[68] ?[x/] ?\d\d)(?: constr)?(?![0-9])"),
    ("rating", r"(?:class|cl|ansi) ?(?P<ra1>\d{2,4})(?!\d)|(?P<ra2>150|300|600|800|900|1500|2500) ?(?:lb(?!s)|#)|# ?(?P<ra3>\d{3,4})"),
    ("schedule", r"sch(?:edule)? ?(?P<sc>\d{1,3})(?!\d)"),
    ("angle", r"(?P<an>45|90|180) ?(?:°|degrees?|deg|d(?![a-z]))|(?P<rb>return bend)"),
    ("power", r"(?P<kw>\d+(?:\.\d+)?) ?(?P<ku>kw|hp|w)(?![a-z])"),
    ("voltage", r"(?P<vn>\d+(?:\.\d+)?) ?(?P<vu>kv|volts?|v)(?: ac)?(?![a-z])"),
    ("current", r"(?P<cn>\d+(?:\.\d+)?) ?(?P<cu>ma|amps?|a)(?![a-z])"),
    ("poles", r"(?:poles?[ :]*)(?P<p1>\d+)|(?P<p2>\d+)[ -]?(?:poles?|p)(?![a-z])"),
    ("mounting", r"(?:(?P<m3>foot)|(?P<m5>flange)) (?:mounted|mtd)(?: b ?-?[35])?|b ?-?(?P<mb>[35])(?![0-9a-z])|(?P<mv>vertical(?: v ?-?1)?|v ?-?1(?![0-9a-z]))"),
    ("viscosity", r"(?:viscosity:? )?(?:grade |iso )?vg ?-?(?P<vg1>\d{2,3})(?!\d)|viscosity:? grade (?P<vg2>\d{2,3})|viscosity:? (?P<vg3>\d{2,3})(?!\d)"),
    ("nlgi", r"nlgi(?: grade)?[ -]?(?P<nl>0{1,3}|\d)(?!\d)"),
    ("purity", r"(?P<pu1>\d+(?:\.\d+)?) ?(?:%|pct|percent)(?: (?:min|pure))?"),
    ("micron", r"(?P<mi>\d+(?:\.\d+)?) ?(?:microns?|mic(?![a-z])|um(?![a-z])|μm|µm)"),
    ("designation", r"(?:no|desig|designation|brg)[ :]*(?P<de>\d{4,5})(?!\d)|(?P<de2>6[0234]\d\d)(?![\d.,])(?![ -]?(?:(?:ma|v|w|kw|mm|cms?|m|kpa|bar|oz|ozs|gms?|g|kgs?|lbs?|mls?|cc|ltrs?|l|yds?|ft|kms?)(?![a-z])|ounces|grams|us |pounds|yards|feet|lit|mil|x))"),
    ("clearance", r"(?:clearance |clr )?c ?-?(?P<cl>[2345n])(?: clr)?(?![a-z0-9])|(?P<cln>normal clearance)"),
    ("seal", r"(?P<se2>2 ?-?rs1?(?![a-z0-9])|sealed both sides|rubber sealed)|(?P<sez>z ?-?z(?![a-z0-9])|metal shielded|2z(?![a-z0-9]))|(?P<seo>unsealed|no seal|open(?: type)?)"),
    ("amount2", rf"(?:(?P<hold2>{_HOLD})[ :]*)(?P<n2>{_N})(?:[ -]?(?P<u2>{UNIT})(?![a-z0-9/³²]))?(?![\d.])"),
    ("amount3", rf"(?P<n3>{_N})[ -]?(?P<u3>{UNIT})(?![a-z0-9/³²])(?P<per> {_PER}(?![a-z]))?"),
    ("grade", r"(?:grade:? ?|gr ?|pc ?|grade:? gr ?|grade:? pc ?)(?P<gr1>\d{1,2}\.\d)(?!\d)|(?P<gr2>\d{1,2}\.\d)(?: gr(?![a-z]))?(?![\d.])"),
    ("typ", r"(?:(?:drg|type|model|drawing|dwg)(?: no)?[ :]*)?(?:(?!(?:cs|ci|fs|ss|sw|bw|zp|rf|ff|nb|in|cm|mm|lg|kg|gr|cl) )[a-z]{2}[ -]?)?(?P<ty>[\do]{2}[ ./-]?[\do]{3})(?![\da-z])"),
    ("thread1", r"(?:dia )?m ?(?P<t1>\d{1,2})(?![\d.,a-z/³²])"),
    ("face", r"(?P<fr>rtj|ring type joint|ring joint)|(?P<fa>raised fa?ce?|rf(?![a-z]))|(?P<ff>flat faced?|flat fc|ff(?![a-z]))|(?P<fm>full face)"),
    ("finish", r"(?P<fh>hdg|hot[ -]?[a-z]{0,3}[ -]?galv[a-z]*)|(?P<fz>zinc ?plat?t?e?d?|zinc ?plt|zn ?pltd|zn ?plated|zp(?![a-z]))|(?P<fb>blk ?oxide|blk ?ox|black ?oxide|blackened)|(?P<ft>(?:ptfe|teflon|pfe|pte|ptf) ?(?:coated|coat|ctd))|(?P<fp>self ?colour|plain ?finish|plain|pln(?![a-z]))"),
    ("material", r"(?P<xd>uns duplex|duplex stainless(?: steel)?|duplex ss|duplex|dss)|(?P<xc>carbon steel|carb steel|cs(?![a-z]))|(?P<xi>grey cast iron|cast iron|ci(?![a-z]))|(?P<xf>forged steel|frgd steel|fs(?![a-z]))|(?P<xb>gun metal bronze|bronze body|bronze|brz(?![a-z]))"),
    ("filling", r"(?P<gp>ptfe|teflon)|(?P<gn>nitrile rubber|nbr)|(?P<ge>epdm|ethylene propylene)|(?P<gc>(?:compressed )?non asbestos fibre|compressed fibre|cnaf)|(?P<gg>graphite filler|graphite filled|graph filled|graphite)"),
    ("ends", r"(?P<ef>flanged ends?|flgd ends?|flanged|flgd|flg(?![a-z]))|(?P<es>(?:socket|skt) (?!head|hd|cap|screw)[a-z]{3,6}(?![a-z])|sw(?![a-z]))|(?P<eb>butt [a-z]{3,6}(?![a-z])|bw(?![a-z]))|(?P<ew>wafer(?: patt(?:ern)?| type)?|wfr(?![a-z]))|(?P<ec>screwed|threaded npt|scrd|scr(?![a-z])|threaded(?! stud))"),
    ("insulation", r"(?P<ip>pvc|poly ?-?vinyl(?: chloride)?)|(?P<ix>xlpe|cross linked pe|cross linked)|(?P<ie>epr|ethylene pr[a-z]*|ethylene)"),
    ("base", r"(?P<bl>(?:lithium|lith|li)[ -]?(?:ep|complex)|lithium|lith(?![a-z])|li (?:base|soap|thickener|content)|li(?![a-z]))|(?P<bc>calcium|calc(?![a-z])|ca(?![a-z]))|(?P<bp>polyurea|urea|pu (?:base|soap|thickener)|pu(?![a-z]))"),
    ("colour", r"(?P<cw>golden yellow|oxide brown|signal red|sky blue|white|green|grey|gray|black)"),
    ("word", r"[^\W\d_]{2,}"),
    ("num", r"\d[\d.,/-]*(?:[a-z]\w*)?"),
]


def _first(tree) -> tuple[set | None, bool]:
    """Characters a parsed pattern may start with (None: any), and whether it may match nothing."""
    got: set = set()
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            return got | {chr(arg)}, False
        if op == "IN":
            for o, a in arg:
                if str(o) == "LITERAL":
                    got.add(chr(a))
                elif str(o) == "RANGE":
                    got |= {chr(x) for x in range(a[0], a[1] + 1)}
                elif str(o) == "CATEGORY" and str(a) == "CATEGORY_DIGIT":
                    got |= set("0123456789")
                else:
                    return None, False
            return got, False
        if op == "BRANCH":
            empty = False
            for b in arg[1]:
                f, e = _first(b)
                if f is None:
                    return None, False
                got |= f
                empty |= e
            if not empty:
                return got, False
        elif op == "SUBPATTERN":
            f, e = _first(arg[-1])
            if f is None:
                return None, False
            got |= f
            if not e:
                return got, False
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            f, e = _first(arg[2])
            if f is None:
                return None, False
            got |= f
            if arg[0] and not e:
                return got, False
        elif op not in ("ASSERT", "ASSERT_NOT", "AT"):
            return None, False
    return got, True


_STARTS = [(name, pat, _first(re._parser.parse(pat))[0]) for name, pat in _PATTERNS]
_AT: dict[str, re.Pattern | None] = {}


def _at(c: str) -> re.Pattern | None:
    """The alternatives that may start with this character, in order."""
    if c not in _AT:
        own = [f"(?P<k_{name}>{pat})" for name, pat, first in _STARTS if first is None or c in first]
        _AT[c] = re.compile("|".join(own)) if own else None
    return _AT[c]
_DOTTED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]\.)+(?:[^\W\d_](?![^\W_]))?\.?")
_DOT = re.compile(r"(?<=[^\W\d_])\.(?!\d)|(?<=[^\W\d_])\.(?=\d)")
#: A word is read as another if that stands in as many times more records.
OFTENER = 20
CLEARLY = 5
#: A word after "make" is one if it stands in fewer records; more frequent ones are judged by the lexicon.
SELDOM = 20
_WORD = re.compile(r"[^\W\d_]{3,}")
_LABEL = re.compile(r"([^\W\d_]{2,}) ?:")
_SPACE = re.compile(r"\s+")
_MM = {"mm": 1, "cm": 10, "m": 1000}


def within_one(a: str, b: str) -> bool:
    """Are the words one slip apart: a letter added, lost, changed, or two neighbours swapped?"""
    if a == b:
        return True
    m, n = len(a), len(b)
    if abs(m - n) > 1:
        return False
    i = 0
    while i < m and i < n and a[i] == b[i]:
        i += 1
    if m == n:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < m and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if m > n else a[i:] == b[i + 1 :]


def _num(x: str) -> str:
    """A number without thousands separators, trailing zeros or needless point."""
    x = x.replace(",", "")
    if "/" not in x and x.isascii():  # most numbers, without the cost of fractions
        whole, _, rest = x.partition(".")
        return f"{float(x):.10g}" if rest.strip("0") else str(int(whole))
    f = sum(map(Fraction, re.split("[ -]", x))) if "/" in x else Fraction(x)
    return str(f.numerator) if f.denominator == 1 else f"{float(f):.10g}"


def _inches(x: str) -> str:
    if "-" in x:
        a, b = x.split("-")
        return _num(str(float(a) + float(Fraction(b))))
    return _num(str(float(Fraction(x))) if "/" in x else x)


def _scaled(n: str, factor: float) -> str:
    return f"{float(n.replace(',', '')) * factor:.10g}"


#: Separators of the house styles; a description is cut at the first that it has.
_CUTS = (" | ", " – ", "; ", " / ", ",  ", " - ", ", ")


def pieces(description: str) -> list[str]:
    for cut in _CUTS:
        if cut in description:
            return description.split(cut)
    return [description]


_LENGTHS = re.compile(r"(?:centi|kilo|milli)?met(?:re|er)s?$|[ck]?m(?:trs?)?s?$|mm$|mtrs?$|yards?$|yds?$|feet$|foot$|fts?$")
_VOLUMES = re.compile(r"(?:milli|kilo)?lit(?:re|er)s?$|.*(?:gal|gals|gallons?|quarts?|qts?)$|mls?$|cc$|kl$|l$|lt$|ltrs?$|lits?$|cu|m[3³]$")


def dimension(unit: str) -> str:
    """What a unit spelling of `UNIT` measures."""
    return "length" if _LENGTHS.match(unit) else "volume" if _VOLUMES.match(unit) else "mass"


class Speller:
    """Reads a word as the far more frequent one that it is a slip away from; one per Python worker.

    counts: the records that hold each frequent word.
    """

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.read: dict[str, str] = {}
        self.near: dict[str, list[str]] = {}
        for w in counts:
            if len(w) >= 4:
                for r in self._rests(w):
                    self.near.setdefault(r, []).append(w)

    @staticmethod
    def _rests(w: str) -> set[str]:
        return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}

    def word(self, w: str) -> str:
        got = self.read.get(w)
        if got is None:
            if len(self.read) > 200_000:
                self.read.clear()
            got = self.read[w] = self._look(w) if len(w) < 30 else w
        return got

    def _look(self, w: str) -> str:
        if len(w) < 3:
            return w
        own = self.counts.get(w, 0)
        met = {v for r in self._rests(w) for v in self.near.get(r, ()) if v != w and within_one(w, v)}
        if len(w) == 3:  # only a longer word that lost a letter, if there is one that far outweighs the others
            longer = sorted((v for v in self.near.get(w, ()) if len(v) == 4), key=lambda v: -self.counts[v])
            if not longer or self.counts[longer[0]] < OFTENER * max(own, 1) or len(longer) > 1 and self.counts[longer[0]] < CLEARLY * self.counts[longer[1]]:
                return w
            return longer[0]
        met = [v for v in met if self.counts[v] >= OFTENER * max(own, 1)]
        # neighbours swapped or a letter doubled before other slips
        return min(met, key=lambda v: (sorted(v) != sorted(w) and set(v) != set(w), -self.counts[v], v), default=w)


class Parser:
    """Turns descriptions into features, remembering pieces; one per Python worker."""

    def __init__(self, counts: dict[str, int] | None = None, remember: int = 300_000):
        self.pieces: dict[str, tuple] = {}
        self.speller = Speller(counts or {})
        self.remember = remember

    def piece(self, text: str) -> tuple:
        """(words, attributes, type numbers, amounts, other numbers) of one piece, in lower case."""
        got = self.pieces.get(text)
        if got is None:
            if len(self.pieces) > self.remember:
                self.pieces.clear()
            words, attributes, types, amounts, numbers = [], [], [], [], []
            for k, v in self.scan(text):
                if k == "w":
                    words.append(v)
                elif k == "amount":
                    amounts.append(v)
                elif k == "type":
                    types.append(v)
                elif k == "number":
                    numbers.append(v)
                else:
                    attributes.append((k, v))
            got = self.pieces[text] = (tuple(words), tuple(attributes), tuple(types), tuple(amounts), tuple(numbers))
        return got

    def scan(self, text: str) -> tuple:
        """The features of one piece: (name, value) in order."""
        s = text.lower().replace("″", '"')
        if "." in s:
            s = _DOTTED.sub(lambda m: m[0].replace(".", "") + " ", s)
            s = _DOT.sub(" ", s)
        s = s.replace("–", " ").replace(",  ", " ").replace(":", ": ").replace(" . ", " ")
        read, word = self.speller.read, self.speller.word
        s = _WORD.sub(lambda m: read.get(m[0]) or word(m[0]), s)
        # a word before a colon names an attribute, not an item
        named = set(_LABEL.findall(s)) if ":" in s else ()
        s = _SPACE.sub(" ", s).strip().replace(": ", " ")
        out = []
        at, end = 0, len(s)
        while at < end:
            c = s[at]
            if c == " ":
                at += 1
                continue
            p = _AT[c] if c in _AT else _at(c)
            m = p.match(s, at) if p else None
            if m is None or m.end() == at:
                at += 1
                continue
            if not (named and m.lastgroup == "k_word" and m[0] in named):
                self.take(m.lastgroup[2:], m, out)  # lastgroup is the outer group, which closes last
            at = m.end()
            while at < end and s[at].isalnum() and s[at - 1].isalnum() and s[at].isdigit() == s[at - 1].isdigit():
                at += 1
        return tuple(out)

    def take(self, k: str, m: re.Match, out: list) -> None:
        g = m.group
        if k == "word":
            out.append(("w", m[0]))
        elif k == "make":
            w = m[0].split()[-1].strip(":")
            if self.speller.counts.get(w, 0) >= SELDOM:
                out.append(("w", w))
        elif k == "drop" or k == "std":
            return
        elif k == "num":
            out.append(("number", m[0].rstrip(".,/-")))
        elif k == "stainless":
            out.append(("material", "x4" if g("y4") else "x6"))
        elif k == "amount":
            out.append(("amount", (g("times"), _num(g("n1")), g("u1"), 2)))
        elif k == "amount2":
            if g("hold2") and g("u2") is None and g("hold2").split()[0] not in ("pack", "net", "qty", "content", "roll", "coil", "drum", "pail", "can", "bag", "tube", "bottle", "btl", "reel", "box", "carton"):
                return
            out.append(("amount", ("1", _num(g("n2")), g("u2") or "", 2)))
        elif k == "amount3":
            out.append(("amount", ("1", _num(g("n3")), g("u3"), 2 if g("per") else 1)))
        elif k == "thread":
            out.append(("thread", f"{int(g('td'))}x{_scaled(g('tl'), _MM[g('tu') or 'mm'])}"))
        elif k == "thread1":
            out.append(("thread1", str(int(g("t1")))))
        elif k == "nutthread":
            out.append(("thread1", str(int(g("nt")))))
        elif k == "cores":
            out.append(("cores", f"{int(g('co1') or g('co2'))}x{_num(g('sq1') or g('sq2'))}"))
        elif k == "flow":
            out.append(("flow", _scaled(g("fn"), 0.06 if g("fu") in ("lit/min", "l/min", "lpm") else 1)))
        elif k == "head":
            out.append(("head", _scaled(g("hn1") or g("hn2"), _MM[g("hu1") or g("hu2")] / 1000)))
        elif k == "range" or k == "press":
            n, u = (g("rn"), g("ru")) if k == "range" else (g("pn"), g("pu"))
            out.append((k, _scaled(n, {"bar": 1, "mpa": 10, "kpa": 0.01}[u])))
        elif k == "length":
            out.append(("length", _scaled(g("ln1") or g("ln2"), _MM[g("lu1") or g("lu2")])))
        elif k == "dial":
            out.append(("dial", _scaled(g("dn1") or g("dn2"), _MM[g("du1") or g("du2")])))
        elif k == "bore":
            b = g("b1") or g("b2")
            dn = int(b) if b else BORES.get(_inches(g("b3") or g("b4")))
            if dn in _DN:
                out.append(("bore", str(dn)))
        elif k == "dia":
            out.append(("diameter", _scaled(g("di1") or g("di2"), _MM[g("iu1") or g("iu2") or "mm"])))
        elif k == "strands":
            out.append(("strands", re.sub(r" ?[x/] ?", "x", g("st"))))
        elif k == "rating":
            out.append(("rating", g("ra1") or g("ra2") or g("ra3")))
        elif k == "schedule":
            out.append(("schedule", g("sc")))
        elif k == "angle":
            out.append(("angle", g("an") or "180"))
        elif k == "power":
            n = _num(g("kw"))
            out.append(("power", n if g("ku") == "kw" else POWERS.get(n, f"{n}hp") if g("ku") == "hp" else _scaled(n, 0.001)))
        elif k == "voltage":
            out.append(("voltage", _scaled(g("vn"), 1000 if g("vu") == "kv" else 1)))
        elif k == "current":
            out.append(("current", _scaled(g("cn"), 0.001 if g("cu") == "ma" else 1)))
        elif k == "poles":
            out.append(("poles", g("p1") or g("p2")))
        elif k == "mounting":
            out.append(("mounting", "B3" if g("m3") or g("mb") == "3" else "B5" if g("m5") or g("mb") == "5" else "V1"))
        elif k == "viscosity":
            out.append(("viscosity", g("vg1") or g("vg2") or g("vg3")))
        elif k == "purity":
            out.append(("purity", _num(g("pu1"))))
        elif k == "micron":
            out.append(("micron", _num(g("mi"))))
        elif k == "designation":
            out.append(("designation", g("de") or g("de2")))
        elif k == "clearance":
            out.append(("clearance", "n" if g("cln") else g("cl")))
        elif k == "seal":
            out.append(("seal", "2rs" if g("se2") else "zz" if g("sez") else "open"))
        elif k == "grade":
            out.append(("grade", g("gr1") or g("gr2")))
        elif k == "typ":
            out.append(("type", re.sub(r"[ ./-]", "", g("ty")).replace("o", "0")))
        elif k == "nlgi":
            out.append(("nlgi", g("nl")))
        elif k == "colour":
            out.append(("colour", g("cw").replace("gray", "grey")))
        else:  # face, finish, material, filling, ends, insulation, base: the inner group's name is the value
            out.append((k, next(n for n in _INNER[k] if g(n))))

    def features(self, description: str | None) -> tuple:
        """(words, {attribute: value}, type numbers, amounts, other numbers) of a description; of an attribute named twice, the first."""
        found: dict[str, str] = {}
        words: set[str] = set()
        types: list[str] = []
        amounts: list[tuple] = []
        numbers: list[str] = []
        # pieces that differ in case only are read once
        for part in pieces(description.lower() if description else ""):
            w, attributes, t, a, n = self.piece(part)
            words.update(w)
            for k, v in attributes:
                if k not in found:
                    found[k] = v
            types += t
            amounts += a
            numbers += n
        if "thread1" in found:
            found.setdefault("thread", found.pop("thread1"))
        return words, found, types, amounts, numbers


_INNER = {
    name: [n for n in re.findall(r"\?P<(\w+)>", pat)]
    for name, pat in _PATTERNS
    if name in ("face", "finish", "material", "filling", "ends", "insulation", "base")
}
_UOM = re.compile(r"^[^\w]*(?:(?:in|per)\s+)?(?:(\d[\d,]*(?:\.\d+)?)[\s-]*)?([^\W\d_][^\d]*?)?[\s-]*(\d[\d,]*(?:\.\d+)?)?[^\w]*$")


def unit_of_issue(uom: str | None) -> tuple[str | None, str]:
    """(amount written into it or None, spelling of the unit) of a unit of issue."""
    if not uom:
        return None, ""
    m = _UOM.match(_DOTTED.sub(lambda m: m[0].replace(".", ""), uom.strip().lower()))
    if not m:
        return None, ""
    n = m[1] or m[3]
    return (_num(n) if n else None), " ".join(re.findall(r"[^\W\d_]+", m[2] or ""))
