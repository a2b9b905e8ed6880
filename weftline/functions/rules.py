"""The dictionary of the rule-based harmonisation: patterns, word lists, tables.

All of it is data.  Patterns are in the common subset of Java's and RE2's syntax but for the two
marked ones, which use look-around.
"""

# --- fixed values: text rules, applied once each, in this order --------------
CLEANUP = [
    (r"[–—-]+", " "),
    (r"°", " deg "),
    (r"\s+", " "),
]
WORD_RULES = [
    (r"\bhot dip galvanis(?:ed|ation)\b", "hot dip galvanized"),
    (r"\bh\.?d\.?g\.?\b", "hot dip galvanized"),
    (r"\bhdg\b", "hot dip galvanized"),
    (r"\bgalvanised\b", "galvanized"),
    (r"\bzinc pltd\b", "zinc plated"),
    (r"\bzinc plated\b", "zinc plated"),
    (r"\bzn\b", "zinc plated"),
    (r"\bzp\b", "zinc plated"),
    (r"\bblk ox(?:ide)?\b", "black oxide"),
    (r"\bblack\b", "black oxide"),
    (r"\bplain finish\b", "plain"),
    (r"\bpln\b", "plain"),
    (r"\bstainless steel 316\b", "ss316"),
    (r"\bs\.?s\.? ?316\b", "ss316"),
    (r"\bss-?316\b", "ss316"),
    (r"\ba4-?70\b", "ss316"),
    (r"\bgr\.?a4-?70\b", "ss316"),
    (r"\bstainless steel 304\b", "ss304"),
    (r"\bs\.?s\.? ?304\b", "ss304"),
    (r"\bss-?304\b", "ss304"),
    (r"\ba2-?70\b", "ss304"),
    (r"\bgr\.?a2-?70\b", "ss304"),
    (r"\btp316\b", "a312 tp316"),
    (r"\btp304\b", "a312 tp304"),
    (r"\bcast steel\b", "caststeel"),
    (r"\bc\.?s\.?\b", "caststeel"),
    (r"\bforged steel\b", "forgedsteel"),
    (r"\bf\.?s\.?\b", "forgedsteel"),
    (r"\bcast iron\b", "castiron"),
    (r"\bc\.?i\.?\b", "castiron"),
    (r"\bbrz\b", "bronze"),
    (r"\ba106 gr ?b\b", "a106grb"),
    (r"\ba106-?gr-?b\b", "a106grb"),
    (r"\ba234 ?wpb\b", "a234wpb"),
    (r"\ba234-?wpb\b", "a234wpb"),
    (r"\bflg\b", "flanged"),
    (r"\bscr\b", "screwed"),
    (r"\bs\.?w\.?\b", "socket weld"),
    (r"\bwn\b", "weld neck"),
    (r"\bw-n\b", "weld neck"),
    (r"\bs-?o\b", "slip on"),
    (r"\bslip-?on\b", "slip on"),
    (r"\bwafer type\b", "wafer"),
    (r"\braised face\b", "rf"),
    (r"\br\.?f\.?\b", "rf"),
    (r"\bd\.?g\.?\b", "deep groove"),
    (r"\bsph\b", "spherical"),
    (r"\bcyl\b", "cylindrical"),
    (r"\bccw33\b", "cc w33"),
    (r"\bcc-?w33\b", "cc w33"),
    (r"\bopen type\b", "open"),
    (r"\b3-?ph(?:ase)?\b", "3 phase"),
    (r"\bmag(?:netic)? float\b", "magnetic float"),
    (r"\bmagnetic\b", "magnetic float"),
    (r"\bbourdon tube\b", "bourdon"),
    (r"\blithium ep\b", "lithiumep"),
    (r"\bli-?ep\b", "lithiumep"),
    (r"\bli\b", "lithium"),
    (r"\bmin\b", "mineral"),
    (r"\be\.?p\.?\b", "ep"),
    (r"\bsmls\b", "seamless"),
    (r"\be\.?r\.?w\.?\b", "erw"),
    (r"\bfoot mounted b3\b", "b3"),
    (r"\bflange mounted b5\b", "b5"),
    (r"\bb-3\b", "b3"),
    (r"\bb-5\b", "b5"),
    (r"\bgr\.?(\d{1,2}(?:\.\d)?)\b", r"grade \1"),
    (r"\b(\d{1,2}(?:\.\d)?) gr\b", r"grade \1"),
    (r"\bb-?7\b", "b7"),
    (r"\bb-?16\b", "b16"),
    (r"(?<!grade )\b(8\.8|10\.9|12\.9|4\.6|5\.6|6\.8)\b", r"grade \1"),  # look-behind
    (r"\b(?:cl|class) ?(\d{2,4})\b", r"class \1"),
    (r"\b(\d{3}) ?#", r"class \1"),
    (r"\bsch(?:edule)?[. -]?(\d{2,3})\b", r"sch \1"),
    (r"\b(is):?(\d{3,5})\b", r"\1 \2"),
    (r"\b(is)-(\d{3,5})\b", r"\1 \2"),
    (r"\b(din)-(\d{3,5})\b", r"\1 \2"),
    (r"\b(astm)-? ?(a\d{3})\b", r"\1 \2"),
    (r"\biso-vg-?(\d{2,3})\b", r"vg \1"),
    (r"\biso vg (\d{2,3})\b", r"vg \1"),
    (r"\bvg-?(\d{2,3})\b", r"vg \1"),
    (r"\bnlgi-?(\d)\b", r"nlgi \1"),
    (r"\bp\.?v\.?c\.?\b", "pvc"),
    (r"\b(\d+) ?kgs?\b", r"\1 kg"),
    (r"\b(\d+) ?ltr\b", r"\1 l"),
    (r"\b(\d+(?:\.\d+)?) ?hp\b", r"\1 hp"),
    (r"\b(\d+) ?rpm\b", r"\1 rpm"),
    (r"\b(\d+(?:\.\d+)?) ?kv\b", r"\1 kv"),
    (r"\b(\d+) ?m3/hr\b", r"\1 m3hr"),
    (r"\b(\d+) ?lpm\b", r"\1 lpm"),
    (r"\bksc\b", "kg cm2"),
    (r"\bkg/cm2\b", "kg cm2"),
    (r"\b0-(\d+) kg cm2\b", r"range 0-\1"),
    (r"\b(\d(?:\.\d)?)c ?x ?(\d+(?:\.\d+)?) ?sq ?mm\b", r"\1c x \2 sqmm"),
    (r"\b(\d(?:\.\d)?)c ?x ?(\d+(?:\.\d+)?)\b", r"\1c x \2 sqmm"),
    (r"\bsq ?mm\b", "sqmm"),
    (r"\b([234])p\b", r"\1 pole"),
    (r"\bsocket screw\b", "socket head cap screw"),
    (r"\bmotor\b", "induction motor"),
    (r"\bsteel pipe\b", "pipe"),
    (r"\bm ?(\d{1,2}) ?x ?(\d{1,3}) ?mm\b", r"m\1x\2"),
    (r"\bm ?(\d{1,2}) ?x ?(\d{1,3})\b", r"m\1x\2"),
    (r"\b(\d+(?:\.\d+)?)\"(?: ?n(?:b|ps))?(?![a-z0-9])", r"\1 inch"),  # look-ahead
    (r"\b(\d+(?:\.\d+)?) inch(?: ?n(?:b|ps))?\b", r"\1 inch"),
]

# --- fixed values: type words in order of precedence, and their categories ---
TYPES = {
    "hex bolt": "fastener", "stud bolt": "fastener", "socket head cap screw": "fastener", "hex nut": "fastener",
    "nut": "fastener", "flat washer": "fastener", "washer": "fastener", "ball bearing": "bearing",
    "roller bearing": "bearing", "bearing": "bearing", "gate valve": "valve", "ball valve": "valve",
    "globe valve": "valve", "check valve": "valve", "butterfly valve": "valve", "safety valve": "valve",
    "elbow": "fitting", "tee": "fitting", "reducer": "fitting", "flange": "fitting", "pipe": "pipe",
    "cable": "electrical", "induction motor": "electrical", "contactor": "electrical", "mcb": "electrical",
    "grease": "lubricant", "hydraulic oil": "lubricant", "turbine oil": "lubricant", "gear oil": "lubricant",
    "oil": "lubricant", "centrifugal pump": "pump", "gear pump": "pump", "pressure gauge": "instrument",
    "thermowell": "instrument", "level indicator": "instrument", "valve": "valve", "pump": "pump",
    "bolt": "fastener", "gauge": "instrument",
}

# --- fixed values: attributes read by one pattern each: (key, pattern, format) ---
PATTERNS = [
    ("class", r"\bclass (\d{2,4})\b", "{}"),
    ("schedule", r"\bsch (\d{2,3})\b", "SCH {}"),
    ("voltage", r"\b(\d+(?:\.\d+)?) kv\b", "{} kV"),
    ("hp", r"\b(\d+(?:\.\d+)?) hp\b", "{} HP"),
    ("rpm", r"\b(\d{3,4}) rpm\b", "{} RPM"),
    ("amps", r"\b(\d{2,3}) a\b", "{} A"),
    ("coil", r"\b(\d{2,4}) v ac\b", "{} VAC"),
    ("poles", r"\b([234]) pole\b", "{}P"),
    ("nlgi", r"\bnlgi (\d)\b", "NLGI {}"),
    ("viscosity", r"\bvg (\d{2,3})\b", "VG {}"),
    ("flow", r"\b(\d+) m3hr\b", "{} m3/hr"),
    ("drive", r"\b(\d+(?:\.\d+)?) kw\b", "{} kW"),
    ("pressure", r"\b(\d+) bar\b", "{} bar"),
    ("flow_lpm", r"\b(\d+(?:\.\d+)?) lpm\b", "{} LPM"),
    ("range", r"\brange 0-(\d+)\b", "0-{} kg/cm2"),
    ("angle", r"\b(90|45) deg\b", "{} deg"),
]
# --- fixed values: attributes read by the first of several words: (key, whole words, {word: value}) ---
TOKENS = [
    ("material", True, {
        "ss316": "SS316", "ss304": "SS304", "a312 tp316": "TP316", "a312 tp304": "TP304", "a106grb": "A106B", "a234wpb": "WPB",
        "a105": "A105", "a193": "A193", "is 1239": "IS1239", "caststeel": "caststeel", "forgedsteel": "forgedsteel",
        "castiron": "castiron", "bronze": "bronze", "lithiumep": "lithiumep", "lithium": "lithium", "mineral": "mineral",
        "ep": "ep", "hot dip galvanized": "HDG", "zinc plated": "ZN", "black oxide": "BLK", "plain": "PLN"}),
    ("finish", False, {"hot dip galvanized": "HDG", "zinc plated": "ZN", "black oxide": "BLK", "plain": "PLN"}),
    ("flange_type", False, {"weld neck": "WN", "slip on": "SO"}),
    ("end", False, {"flanged": "FLG", "screwed": "SCR", "socket weld": "SW", "wafer": "WAFER"}),
    ("curve", True, {"c curve": "C"}),
    ("insulation", True, {"xlpe": "XLPE", "pvc": "PVC"}),
    ("mount", True, {"b3": "B3", "b5": "B5"}),
    ("phase", True, {"3 phase": "3PH"}),
    ("seal_type", False, {"mechanical": "MECH", "gland": "GLAND"}),
    ("gauge_type", False, {"bourdon": "BOURDON", "magnetic float": "MAGFLOAT"}),
    ("connection", False, {"bsp": "BSP", "npt": "NPT"}),
]

# --- fixed values: what identifies each type; families; labels; order ---
IDENTITY = {
    "hex bolt": ["thread"], "stud bolt": ["thread", "grade"], "socket head cap screw": ["thread", "grade"], "hex nut": ["thread"],
    "flat washer": ["thread", "std"], "ball bearing": ["designation", "seal"], "roller bearing": ["designation"],
    "pipe": ["inch", "schedule", "material"], "elbow": ["inch", "schedule", "angle"], "tee": ["inch", "schedule"],
    "reducer": ["inch", "schedule"], "flange": ["inch", "class", "flange_type"], "gate valve": ["inch", "class", "material"],
    "ball valve": ["inch", "class", "material"], "globe valve": ["inch", "class", "material"], "check valve": ["inch", "class", "material"],
    "butterfly valve": ["inch", "class", "material"], "safety valve": ["inch", "class", "material"],
    "cable": ["cable_size", "voltage", "insulation"], "induction motor": ["hp", "rpm", "mount"], "contactor": ["amps", "poles", "coil"],
    "mcb": ["amps", "poles"], "grease": ["nlgi", "pack", "material"], "hydraulic oil": ["viscosity", "pack"],
    "turbine oil": ["viscosity", "pack"], "gear oil": ["viscosity", "pack"], "centrifugal pump": ["flow", "drive"],
    "gear pump": ["flow_lpm", "drive"], "pressure gauge": ["range", "connection", "inch"], "thermowell": ["inch", "length", "material"],
    "level indicator": ["length", "connection"],
}
FAMILY = {
    "hex bolt": "FAST-BOLT", "stud bolt": "FAST-STUD", "socket head cap screw": "FAST-SHCS", "hex nut": "FAST-NUT",
    "flat washer": "FAST-WSHR", "ball bearing": "BRG-BALL", "roller bearing": "BRG-ROLL", "gate valve": "VLV-GATE",
    "ball valve": "VLV-BALL", "globe valve": "VLV-GLOBE", "check valve": "VLV-CHECK", "butterfly valve": "VLV-BFLY",
    "safety valve": "VLV-SAFETY", "pipe": "PIPE", "cable": "ELEC-CABLE", "induction motor": "ELEC-MOTOR", "contactor": "ELEC-CONTR",
    "mcb": "ELEC-MCB", "grease": "LUB-GREASE", "hydraulic oil": "LUB-HYDOIL", "turbine oil": "LUB-TURBOIL", "gear oil": "LUB-GEAROIL",
    "centrifugal pump": "PMP-CENT", "gear pump": "PMP-GEAR", "pressure gauge": "INS-PGAUGE", "thermowell": "INS-THRMW",
    "level indicator": "INS-LEVEL", "elbow": "FIT-ELBOW", "tee": "FIT-TEE", "reducer": "FIT-REDUCER", "flange": "FIT-FLANGE",
}
LABELS = {
    "thread": "THRD", "inch": "SIZE", "designation": "DSG", "grade": "GRD", "material": "MAT", "finish": "FIN", "class": "CLS",
    "schedule": "SCH", "end": "END", "flange_type": "FTYP", "seal": "SEAL", "voltage": "VLT", "insulation": "INSUL", "cable_size": "CABL",
    "amps": "AMP", "poles": "POL", "curve": "CRV", "hp": "HP", "rpm": "RPM", "mount": "MNT", "phase": "PH", "nlgi": "NLGI",
    "viscosity": "VSC", "pack": "PACK", "flow": "FLOW", "flow_lpm": "FLPM", "head": "HEAD", "pressure": "PRES", "drive": "DRV",
    "seal_type": "SELT", "range": "RNG", "gauge_type": "GTYP", "connection": "CONN", "angle": "ANG", "length": "LEN", "std": "std",
}
#: The order of attributes in codes and descriptions; "coil" has no place in it.
ORDER = list(LABELS)
PRETTY = {"caststeel": "CAST STEEL", "forgedsteel": "FORGED STEEL", "castiron": "CAST IRON", "lithiumep": "LITHIUM EP", "lithium": "LITHIUM", "mineral": "MINERAL", "ep": "EP"}
UOMS = {
    "NOS": ["NOS", "EA", "NUM", "N"],
    "MTR": ["MTR", "MTRS", "METER", "M"],
    "PKT": ["PKT", "PACK", "PKTS", "PKT-5", "PKGS"],
    "KG": ["KG", "KGS", "KG5", "5KG"],
    "L": ["L", "LTR", "LTR20", "20L"],
}
# --- fixed values: cut-offs of the match rules ---
FLOOR, TOP_K = 0.40, 128
WEIGHT_SIM, WEIGHT_ATTR, WEIGHT_TEXT = 0.55, 0.30, 0.15
HIGH_SIM, GOOD_SCORE, GOOD_SIM, SHARED_SIM = 0.85, 0.62, 0.45, 0.78
LOW_CONFIDENCE, REPAIR_ROUNDS, UPLOAD_ROWS = 0.70, 25, 5000
