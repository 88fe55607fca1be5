"""Fixed reference values used by the rules, and helpers that turn them into DataFrames.

Everything in the upper part is data that decides results (word lists, lookup
tables, patterns). Order matters where a list is documented as "ordered".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: identifiers -------------------------------------------------------
PN_PREFIXES = ["PWRL", "BBLE", "HLTA", "FTLS", "FTL", "MMA", "BG", "BN", "BO", "BP", "BB", "RF", "IAI", "EL"]
PN_BLACKLIST = ["CAGE", "DWG", "DRAW", "DATE", "NOTES", "QTY", "SIZE", "REV", "SHEET", "SCALE", "TOLERANCE", "FINISH"]
PN_NARROW = r"\b([A-Z]{2,4}[A-Z0-9]{0,3}\d{2,}[A-Z0-9]*)\b"
# ordered: the first pattern that matches wins
PN_GENERIC = [
    r"^(\d{3,}-[A-Z0-9]+(?:-[A-Z0-9]+){1,5})(?:[-_\.](\d+|REV|\w{3,8}))?$",
    r"^([A-Z]{2,4}-\d{1,4}-\d{2,6})$",
    r"^([A-Z]{2,4}-\d{2,5}-\d{3,6}-\d{2,4})$",
    r"^([A-Z]{1,4}\d{2,5}-\d{4,6})$",
    r"^([A-Z]{1,4}\d{3,10}[A-Z]{0,2})$",
    r"^(\d{5,12}[A-Z]{0,2})$",
    r"^([A-Z]{2,4}-[A-Z]?\d{3,6}-[A-Z]?\d{1,3})$",
    r"^([A-Z]{2,4}_[A-Z]{2,6}\d{2,5}_\d{3,8})$",
    r"^([A-Z]{1,4}\d{2,6}[A-Z]?(?:-[A-Z0-9]{1,6}){1,5})$",
]
PN_CORE = r"(?i)^([A-Z]?\d{2,}[-_][A-Z0-9\-_]{3,30})[-_]?(?:PDM|PD|REV|EDIT|DRAFT)[-_]"
PN_TAIL = r"(?i)[-_]?(?:PDM|PD|REV|EDIT|DRAFT|SHEET\d*)[-_].*$"
# ordered: narrow extraction strips each in turn, generic extraction only the first hit
NARROW_DECORATIONS = ["B2BDRAW_", "DRAW_", "TEMP_", "_"]
GENERIC_DECORATIONS = ["_ASM_TEMP_", "B2BDRAW_", "DRAW_", "_TEMP_", "TEMP_"]
PN_HEADER_WORDS = [
    "PART NUMBER", "PART NO", "PART NO.", "P.N.", "P/N",
    "CATALOG NO", "CATALOG NUMBER", "DRAWING NO", "DWG NO",
]
PN_ITEM_CELL = r"^(?:ITEM|PART|NO\.?|NUM(?:BER)?|#)\s+\d+$"
EMPTY_MARKERS = ["", "-", "—", "N/A", "NA", "NONE", "NULL"]
# characters that are read for one another (each pair holds in both directions; not transitive)
LOOKALIKE_PAIRS = ["B8", "O0", "I1", "S5", "Z2", "G6", "T7", "D0", "Q0", "L1", "JU", "B3", "EF", "LI", "P0"]
REV_IN_FILENAME = r"(?i)(?:^|[_#\-\s])Rev\.?[\s_\-]?([A-Z0-9]{1,3})(?=[_#\-\s\.]|$)"

# --- fixed values: colours, brands, coatings -----------------------------------------
RAL_CODES = [
    "1000", "1001", "1002", "1003", "1004", "1005", "1006", "1007", "1011", "1012", "1013", "1014", "1015", "1016", "1017", "1018", "1019", "1020", "1021", "1023", "1024", "1026", "1027", "1028",
    "2000", "2001", "2002", "2003", "2004", "2005", "2008", "2009", "2010", "2011", "2012", "2013",
    "3000", "3001", "3002", "3003", "3004", "3005", "3007", "3009", "3011", "3012", "3013", "3014", "3015", "3016", "3017", "3018", "3020", "3022", "3024", "3026", "3027", "3028", "3031", "3032", "3033",
    "5000", "5001", "5002", "5003", "5004", "5005", "5007", "5008", "5009", "5010", "5011", "5012", "5013", "5014", "5015", "5017", "5018", "5019", "5020", "5021", "5022", "5023", "5024",
    "6000", "6001", "6002", "6003", "6004", "6005", "6006", "6007", "6008", "6009", "6010", "6011", "6012", "6013", "6014", "6015", "6016", "6017", "6018", "6019", "6020", "6021", "6022", "6024", "6025", "6026", "6027", "6028", "6029", "6032", "6033", "6034",
    "7000", "7001", "7002", "7003", "7004", "7005", "7006", "7008", "7009", "7010", "7011", "7012", "7013", "7015", "7016", "7021", "7022", "7023", "7024", "7026", "7030", "7031", "7032", "7033", "7034", "7035", "7036", "7037", "7038", "7039", "7040", "7042", "7043", "7044", "7045", "7046", "7047", "7048",
    "8000", "8001", "8002", "8003", "8004", "8007", "8008", "8011", "8012", "8014", "8015", "8016", "8017", "8019", "8022", "8023", "8024", "8025", "8028", "8029",
    "9001", "9002", "9003", "9004", "9005", "9006", "9007", "9010", "9011", "9016", "9017", "9018",
]
PAINT_BRANDS = [
    "TAMBOUR", "TAMAGLAS", "TAMGLAS", "NIRLAT", "TIKKURILA",
    "SHERWIN-WILLIAMS", "SHERWIN WILLIAMS", "SHERWINWILLIAMS",
    "AKZONOBEL", "JOTUN", "HEMPEL", "PPG", "INTERNATIONAL",
    "SIGMA", "CARBOLINE", "DUPONT", "AXALTA", "BASF",
    "NIPPON", "KANSAI", "SIKKENS", "RUST-OLEUM",
]
BRAND_BY = r"\b(\w[\w\s]{1,20})\s+BY\s+(\w+)\b"
PAINT_WORDS = ["PRIMER", "PAINT", "TOP COAT", "TOPCOAT", "POLYURETHANE", "EPOXY"]
MASKING_WORDS = ["MASK", "MASKING"]
PLATING_WORDS = [
    "PLATING", "ANODIZE", "ANODIC", "PASSIVAT", "BLACK OXIDE",
    "CONVERSION COAT", "MIL-DTL-16232", "QQ-Z-325",
    "MIL-PRF-46010", "AMS-C-26074", "ELECTROLESS",
]
PACKING_TEMPLATES = [
    "PACKING SHALL PREVENT CORROSION AND PHYSICAL DAMAGE DURING PROCESS, STORAGE AND SHIPMENT",
    "EACH PART SHALL BE INDIVIDUALLY PACKED",
    "PACKING SHALL PREVENT CORROSION AND PHYSICAL DAMAGE DURING PROCESS, STORAGE AND SUPPLY",
    "PREVENT CORROSION",
    "PHYSICAL DAMAGE",
]
SURFACE_PREP = (
    r"(?i)\b(PICKLING|PICKLE|NITRIC\s*ACID|HYDROFLUORIC|HNO3|\bHF\b|REMOVE\s+TINT|TINT\s+REMOVAL|"
    r"GLASS\s+BEAD\s+BLAST|ALKALINE\s+CLEAN|DEGREASE|ETCHING)\b"
)
POST_PROCESS = (
    r"(?i)\b(HYDROGEN\s+EMBRITTLEMENT|EMBRITTLEMENT\s+RELIEF|HYDROGEN\s+DEGASSING|DEHYDROGENATION|"
    r"STRESS\s+RELIEF(?:\s+BAKE)?|POST[-\s]?PLATE\s+BAKE|BAKING\s+AFTER\s+PLAT)"
)

# --- fixed values: standards ---------------------------------------------------------
STANDARD_BODIES = [
    r"MIL[\s\-]", r"AMS[\s\-]?[A-Z0-9]", r"ASTM[\s\-]?[A-Z0-9]", r"ASME[\s\-]?[A-Z0-9]", r"QQ[\s\-]",
    r"FED[\s\-]?STD", r"PS[\s\-]?\d", r"RAFDOCS", r"TILDOCS", r"AWS[\s\-]?[A-Z0-9]", r"ANSI[\s\-]?[A-Z0-9]",
    r"ISO[\s\-]?\d", r"EN[\s\-]?\d", r"DIN[\s\-]?\d", r"BS[\s\-]?(EN[\s\-]?)?\d", r"SAE[\s\-]?[A-Z0-9]",
    r"NAS[MT]?[\s\-]?\d", r"IPC[\s\-]?[A-Z0-9]", r"JEDEC", r"UL[\s\-]?\d", r"CSA[\s\-]", r"MS[\s\-]?\d{4,}",
    r"AN[\s\-]?\d{3,}", r"NASA[\s\-]", r"DO[\s\-]?\d{3,}", r"FAR[\s\-]?\d", r"RTCA[\s\-]", r"JIS[\s\-]?[A-Z0-9]",
    r"GB[\s\-]?\d", r"BOEING", r"BAC[\s\-]?\d", r"AIRBUS", r"ABS[\s\-]?\d", r"SSPC[\s\-]", r"NACE[\s\-]",
    r"EN[\s\-]?ISO[\s\-]?\d", r"BS[\s\-]?EN[\s\-]?ISO[\s\-]?\d", r"TT[\s\-]?[A-Z]", r"AISI[\s\-]?\d",
    r"UNS[\s\-]?[A-Z]?\d", r"RAFAEL\s+PROCEDURE", r"P[\.\s]*S[\.\s]*\d", r"RAFDOCS[\s\-]?\d", r"TILDOCS[\s\-]?#?\d",
    r"PS[\s\-]?TILDOCS[\s\-]?#?\d", r"PS[\s\-]?DOC[\s\-]?\d", r"PS[\s\-]?\d+\.?\d*", r"SM[\s\-]?\d+\.?\d*",
    r"FED\.?\s*STD\.?\s*\-?\d", r"A\-A[\s\-]?\d", r"ANSI/ASQ", r"ANSI/ASME", r"ANSI/IEEE", r"GEN[\s\._]\s*\d",
]
STANDARD_IGNORE = [
    "ISO STANDARDS", "ISO STANDARD", "MIL STANDARDS", "MIL STANDARD",
    "ASME STANDARDS", "SAE STANDARDS", "ASTM STANDARDS",
    "APPLICABLE STANDARDS", "SAFETY STANDARDS", "INDUSTRY STANDARDS",
    "VT", "PT", "MT", "UT", "RT", "PT TYPE I", "PT TYPE L", "VT TYPE I",
    "GTAW", "GMAW", "SMAW", "FCAW", "SAW", "TIG", "MIG", "WPS",
    "ROHS", "ROHS COMPLIANT", "ROHS COMPLIANCE", "ROHS DIRECTIVE",
    "ROHS II", "ROHS III", "REACH", "REACH COMPLIANCE", "SQUEGLIA",
]
STANDARD_IGNORE_PATTERN = r"(?i)^(?:ROHS\b.*|REACH\b.*|IPC\s+STANDARDS?$)"
RAL_AS_STANDARD = r"(?i)^RAL[\s\-]?\d{3,4}"
LOWERCASE_SPEC = r"^(sm|ps|rafdocs|gen)[\s.-]?\d"
TEST_METHODS = ["GTAW", "GMAW", "TIG", "MIG", "WPS", "VT", "PT", "MT", "UT", "RT", "PAINTING", "MARKING", "WELDING"]
CUSTOMER_CLUES_DEFAULT = ["SUPPLIER", "WORKS"]

# --- fixed values: free text ---------------------------------------------------------
# ordered (pattern, replacement, label); "$100" is group 1 followed by "00"
PHRASE_FIXES = [
    (r"(?i)\bZQSQLAND\s+NQE\b", "Z0 SQUEGLIA INDEX", "ZQSQLAND NQE→Z0 SQUEGLIA INDEX"),
    (r"(?i)\bZQSQLAND\b", "Z0 SQUEGLIA", "ZQSQLAND→Z0 SQUEGLIA"),
    (r"(?i)\bZ[OQ]\s+SQUEG?L?I?A\b", "Z0 SQUEGLIA", "ZO/ZQ SQUEGLIA→Z0 SQUEGLIA"),
    (r"(?i)\b(?:SUGELIA|SUQEILA|SUQGLIA|SUGEILA|SUEGLIA|SQUEGLA|SUQELIA)\b", "SQUEGLIA", "SUGELIA/SUQEILA→SQUEGLIA"),
    (r"(?i)\bNQE\s+VALUE\b", "INDEX VALUE", "NQE VALUE→INDEX VALUE"),
    (r"(?i)\bV?[Z2][S5]\.?4?\s+AMS-?C-?26074\b", "SAE-AMS-C-26074", "V25.4→SAE-AMS-C-26074"),
    (r"(?i)\bTO[-\s]+(PS-DOC)", "$1", "TO-PS-DOC→PS-DOC"),
    (r"(?i)\bTO[-\s]+(PS-?111)", "$1", "TO-PS-111→PS-111"),
    (r"(?i)\bTO[-\s]+(SM-?111)", "$1", "TO-SM-111→SM-111"),
    (r"(?i)\bTO[-\s]+(RAFDOCS)", "$1", "TO-RAFDOCS→RAFDOCS"),
    (r"\bPSS([OQD]{2,3})(\d+)\b", "PS5$1$2", "PSS_prefix→PS5 + letters_to_digits_below"),
    (r"(PS\d{1,3})OO(\d*)", "$100$2", "PS_OO→PS_00"),
    (r"(PS\d{1,3})QQ(\d*)", "$100$2", "PS_QQ→PS_00"),
    (r"(PS\d{1,3})DD(\d*)", "$100$2", "PS_DD→PS_00"),
    (r"(PS\d{1,3})O(\d+)", "$10$2", "PS_O_digit→PS_0_digit"),
]
# ordered
RELATION_FIXES = [(r"\b1SO(\d)", "ISO$1"), (r"\bMIR-", "M1R-"), (r"\bBBO\b", "BB0"), (r"\b1SO11833\b", "ISO11833")]
MATERIAL_NOISE = [
    "OTHER SIZE", "SIMILAR MATERIAL", "RAW MATERIAL IDENTIFICATION", "SAME MATERIAL",
    "MATERIAL AND THERMAL", "MATERIAL ACC", "MATERIAL IS OPTIONAL",
]
MATERIAL_LABELS = ["MATERIAL", "MATERIAL:", "MATL", "MATL:", "MAT'L", "MAT'L:"]
MATERIAL_SKIP_LABELS = [
    "MATERIAL", "MATL", "QTY", "DATE", "REV", "SIZE", "SCALE", "SHEET", "TITLE", "DRAWING", "DWG",
]
# "Ti-6" never matches because the text is upper-cased first; kept for the record
MATERIAL_WORDS = [
    "ALUMIN", "ALLOY", "STEEL", "STAINLESS", "BRASS", "BRONZE", "TITANIUM", "COPPER", "PLATE", "BAR", "ROD",
    "TUBE", "SHEET", "AL ", "SS ", "CRES", "INCONEL", "MONEL", "PLASTIC", "NYLON", "DELRIN", "PEEK", "ABS ",
    "POLYCARBONATE", "POM", "PTFE", "6061", "7075", "2024", "5052", "303", "304", "316", "321",
    "17-4", "17-7", "15-5", "C36", "Ti-6",
]
MATERIAL_INSTRUCTIONS = [
    "USE ", "PER ", "ACC ", "ACC. ", "ACCORDING ", "AS PER ", "SEE ", "REFER TO ", "REFERENCE ", "AS REQUIRED",
]
MATERIAL_LINE = r"(?i)^\s*(?:MATERIAL|MATL|MAT'L)\s*[:\-]?\s*(.+)$"
# ordered
MATERIAL_DIRECT = [
    r"(?i)\b(?:ALUMIN[IU]M(?:\s+ALLOY)?|AL\.?\s*AL\.?|AL)\s+[0-9]{4}(?:[-\s][A-Z0-9]+)?(?:[-\s][A-Z][0-9]*)?"
    r"(?:[\s,\w\-\.]{0,120}?(?:PER|ACC\.?\s*TO|IAW|SPEC)\s+[A-Z0-9\-\./]+)?",
    r"(?i)\b(?:STAINLESS\s+STEEL|LOW\s+CARBON\s+STEEL|STEEL)\s+(?:SAE\s+)?[0-9]{2,4}[A-Z0-9\-/]*"
    r"(?:[\s,\w\-\.]{0,120}?(?:PER|ACC\.?\s*TO|IAW|SPEC)\s+[A-Z0-9\-\./]+)?",
    r"(?i)\bSTAINLESS\s+STEEL\s+\d{2}-\dPH\b(?:[\s,\w\-\.]{0,100})?",
    r"(?i)\bTITANIUM\s+Ti-\d[A-Z]+-\d[A-Z]+(?:[\s,\w\-\.]{0,80})?",
    r"(?i)\b(?:PVC|DELRIN|PEEK|NYLON|ABS|POLYCARBONATE|PTFE|POM)(?:\s+(?:PLATE|ROD|BAR|SHEET|TUBE))?"
    r"(?:\s+THICK\.?\s*[\d\.]+\s*(?:MM|IN)?)?(?:[\s,\w\-\.]{0,100}?(?:PER|ACC\.?\s*TO|IAW)\s+[A-Z0-9\-\./!]+)?",
]
MATERIAL_PHRASES = (
    r"(?i)\b(?:AL|ALUMINUM|ALUMINIUM)[\s\-]?(?:6061|7075|2024|5052|5083|6063)(?:[\s\-]?T\d{1,4})?\b"
    r"|\b(?:6061|7075|2024|5052|5083|6063)[\s\-]?T\d{1,4}\b"
    r"|\b(?:17[\s\-]?4|17[\s\-]?7|15[\s\-]?5)\s?PH\b(?:\s?H?\d{3,4})?"
    r"|\b(?:303|304|316|321|410|416|420|440)\s?(?:STAINLESS|SS|CRES|L)?\b"
    r"|\bC36000\b|\bC360\b"
    r"|\bTi[\s\-]?6Al[\s\-]?4V\b"
    r"|\b(?:STEEL|STAINLESS|CRES|BRASS|BRONZE|TITANIUM|COPPER|INCONEL|MONEL|NYLON|DELRIN|PEEK|ABS|POLYCARBONATE"
    r"|POM|PTFE|TEFLON)(?:\s+GRADE\s+[A-Z0-9]+)?\b"
    r"|\b(?:ALUMINUM|ALUMINIUM|ALLOY|ALUM)\b"
    r"|\bZINC\s+PLATED(?:\s+(?:YELLOW|BLUE|WHITE|CLEAR|BLACK))?(?:\s+CHROMATE)?\b"
    r"|\b(?:YELLOW|BLUE|WHITE|CLEAR|BLACK)\s+CHROMATE\b"
    r"|\b(?:HARD\s+)?ANODIZ(?:E|ED|ING)(?:\s+TYPE\s+[IVX]+)?\b"
    r"|\bELECTROLESS\s+NICKEL\b|\bCAD(?:MIUM)?\s+PLATED\b|\bPASSIVATE[D]?\b|\bBLACK\s+OXIDE\b"
)
FORMERLY = r"(?is)\(\s*FORM(?:ERLY|ALY)[:\s]+(.+?)\)"
MARK_PN = [
    r"(?i)MARK\s+(?:PART\s+NUMBER|P/N|PN|PART\s*NO\.?)\s*[:\-]?\s*([A-Z0-9]+[A-Z0-9\-/\.]{3,})",
    r"(?i)MARKING\s+(?:PART\s+NUMBER|P/N|PN)\s*[:\-]?\s*([A-Z0-9]+[A-Z0-9\-/\.]{3,})",
]
RAL_ANY = r"(?i)RAL\s*\d{3,4}"
BRAND_STRICT = r"\b[A-Z]{3,}\s+BY\s+[A-Z]{3,}\b"

# --- fixed values: catalog scoring ---------------------------------------------------
SCORE = {
    "code": 30.0, "code_extra": -12.0, "type_class": 20.0, "kind": 50.0, "kind_related": 25.0, "kind_other": -30.0,
    "kind_missing": -5.0, "color": 8.0, "thickness": 15.0, "rohs": 12.0, "rohs_missing": -10.0,
    "phosphorus": 15.0, "phosphorus_other": -10.0, "minimum": 15.0,
}
# ordered
COATING_KINDS = [
    ("electroless_nickel", ["ELECTROLESS"]),
    ("hard_anodize", ["HARD ANODIZE", "TYPE III ANOD"]),
    ("zinc", ["ZINC", "ZINK", "אבץ"]),
    ("nickel", ["NICKEL", "ניקל"]),
    ("anodize", ["ANODIZE", "ANODIC", "אנודייז"]),
    ("conversion", ["CONVERSION", "ALODINE", "CHEM FILM", "IRIDITE", "CHROMATE CONV", "תמורה"]),
    ("passivation", ["PASSIVAT", "פסיבציה"]),
    ("cadmium", ["CADMIUM"]),
    ("chrome", ["CHROME", "CHROMIUM", "כרום"]),
    ("tin", ["TIN PLAT"]),
    ("silver", ["SILVER"]),
    ("gold", ["GOLD"]),
    ("copper", ["COPPER"]),
    ("black_oxide", ["BLACK OXIDE", "BLACKENING"]),
    ("phosphate", ["PHOSPHATE"]),
]
RELATED_KINDS = [("nickel", "electroless_nickel"), ("anodize", "hard_anodize")]
# ordered
COATING_COLORS = [
    ("blue_white", ["BLUE/WHITE", "BLUE\\WHITE", "BLUE WHITE", "כחלבן", "NATURAL", "CLEAR"]),
    ("yellow", ["YELLOW", "צהוב"]),
    ("blue", ["BLUE", "כחול"]),
    ("black", ["BLACK", "שחור"]),
    ("olive", ["OLIVE"]),
    ("green", ["GREEN", "ירוק"]),
]
STD_CODE = (
    r"(?i)\b(?:MIL[- ][A-Z]+[- ]?\d+[A-Z]?|AMS[- ]?[A-Z]?[- ]?\d+[A-Z]?|ASTM[- ]?[A-Z]?[- ]?\d+[A-Z]?|"
    r"QQ[- ]?[A-Z][- ]?\d+[A-Z]?|FED[- ]STD[- ]?\d+|PS[- ]?\d+(?:\.\d+)?|RAFDOCS[- ]?\d+|TILDOCS[- ]?#?\d+)\b"
)
TYPE_TOKENS = [r"(?i)\bTYPE\s*[IVX0-9]+\b", r"(?i)\bCLASS\s*[A-Z0-9]+\b", r"(?i)\bGRADE\s*[A-Z0-9-]+\b"]
THICKNESS = r"(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)|(\d+(?:\.\d+)?)"
# strict reading (ours): an inch is a word of its own, and a number in free text needs a unit
INCH_WORD = r'\d\s*(?:in\b|inch|")|\bin\b|inch'
_UNIT = r'\s*(?:mic|µ|um\b|mm|in\b|inch|")'
THICKNESS_WITH_UNIT = (
    r"(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)" + _UNIT + r"|(\d+(?:\.\d+)?)" + _UNIT
)

# --- fixed values: money -------------------------------------------------------------
# USD per million tokens (input, output); tested in this order, "" is the base family
PRICES = [("mini", "0.15", "0.60"), ("5.4|gpt-5", "2.50", "15.00"), ("", "2.50", "10.00")]
SURCHARGE = "1.20"
ILS_PER_USD = "3.7"

# --- fixed values: comparison and display --------------------------------------------
# ordered category -> fields
DIFF_CATEGORIES = {
    "identity": ["part_number", "drawing_number", "revision", "customer", "cage_code", "title", "catalog_number"],
    "material": ["material", "alternative_material", "material_formerly"],
    "weights": ["raw_weight", "part_weight"],
    "role": ["assembly_role", "quantity"],
    "machining": ["machining_processes"],
    "welding": ["welding_processes"],
    "heat_treatment": ["heat_treatment_processes"],
    "coating": ["coating_processes"],
    "painting": ["painting_processes"],
    "ndt": ["ndt_processes"],
    "inspection": ["inspection_processes"],
    "final_approval": ["final_approval"],
    "additional": ["additional_processes"],
    "standards": ["standards"],
    "packaging": ["packaging_notes"],
    "notes": ["notes", "general_instructions", "environment_requirements"],
    "bom": ["bom_items"],
}
DIFF_KEYS = ["step_no", "name_en", "type", "part_number", "item_no"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
SEVERITY_LABELS = [
    ("CRITICAL", "critical: check before export"),
    ("HIGH", "high: should be checked"),
    ("MEDIUM", "medium: worth a look"),
    ("LOW", "for information"),
]
# ordered: exact type first, then the first key contained in the type
ACTION_HINTS = [
    ("RAL_INVALID", "compare with the official RAL table"),
    ("RAL_NONSTANDARD", "the code may be misread, compare with the notes"),
    ("BRAND_INVALID", "check the spelling of the brand"),
    ("COATING_TYPE", "check the coating class against the standard"),
    ("PACKING_NOTE", "check that packing knows the requirement"),
    ("MISSING_PACKING", "check the packing section by hand"),
    ("POSSIBLE_OBSOLETE_SPEC", "the specification may be replaced, ask the customer"),
    ("STANDARD_HALLUCINATION", "the standard is not in the text, check by hand"),
    ("STANDARD_MISMATCH", "compare the standard with the source text"),
    ("DWG_PREFIX", "check the drawing number against the customer's prefix"),
    ("PN_MISMATCH", "compare the part number with drawing and file name"),
    ("NO_PACKING_REQUIREMENT_IN_DRAWING", "marked as having no packing requirement, confirm"),
]
DEFAULT_HINT = "check the field by hand in the source"
QUALITY_PROCESS_POINTS = [
    ("machining_processes", 4), ("welding_processes", 2), ("heat_treatment_processes", 2), ("coating_processes", 4),
    ("painting_processes", 3), ("inspection_processes", 3), ("final_approval", 3), ("additional_processes", 4),
]
OVERVIEW_ROLE = "Assembly Overview Image"


def lookalike_string() -> str:
    """Both directions of every look-alike pair as one searchable string: ``|B8|8B|…|``."""
    return "|" + "|".join(f"{p}|{p[::-1]}" for p in LOOKALIKE_PAIRS) + "|"


def lookalike_classes() -> tuple[str, str]:
    """(from, to) arguments for ``translate``: every character of a connected group maps to one representative."""
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for a, b in LOOKALIKE_PAIRS:
        parent[root(b)] = root(a)
    chars = sorted(parent)
    return "".join(chars), "".join(root(c) for c in chars)


def ral_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in RAL_CODES], "code string")


def hint_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(ACTION_HINTS)], "ordinal int, hint_key string, hint string")
