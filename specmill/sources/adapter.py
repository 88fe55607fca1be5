"""Record tables derived from the star-schema test tables.

Each derived table is written once as scalar SQL and rendered for Spark or for
a checking engine; only array and struct literals differ between dialects. The
derivation covers whole input tables: every part, order, line item, event and
document takes part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specmill import schemas
from specmill.sources import store


class Dialect:
    """Array and struct literals of one SQL dialect."""

    def __init__(self, spark: bool):
        self.spark = spark

    def struct(self, **fields: str) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def array(self, *items: tuple[str, str]) -> str:
        """Array of the elements whose condition holds: items are (condition, element)."""
        cases = ", ".join(f"CASE WHEN {c} THEN {e} END" for c, e in items)
        if self.spark:
            return f"filter(array({cases}), x -> x IS NOT NULL)"
        return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def pick(expr: str, *values: str) -> str:
    """``CASE`` over ``expr`` modulo the number of values."""
    n = len(values)
    return f"CASE {expr} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def q(*texts: str | None) -> list[str]:
    """SQL string literals."""
    return ["CAST(NULL AS STRING)" if t is None else "'" + t.replace("'", "''") + "'" for t in texts]


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


# ----------------------------------------------------------------------------- parties
SUPPLIER_NAME = "'Supplier Works ' || lpad(CAST({k} AS STRING), 6, '0') || ' Ltd.'"
SUPPLIER_CAGE = "'C' || lpad(CAST({k} AS STRING), 5, '0')"


def _name(k: str) -> str:
    return SUPPLIER_NAME.format(k=k)


def _cage(k: str) -> str:
    return SUPPLIER_CAGE.format(k=k)


# ----------------------------------------------------------------------------- parts -> records
def _identity(d: Dialect) -> list[tuple[str, str]]:
    k = "p_partkey"
    return [
        ("k", k),
        ("p_name", "p_name"), ("p_type", "p_type"), ("p_brand", "p_brand"), ("p_size", "p_size"),
        ("p_retailprice", "p_retailprice"),
        ("cpn", f"'BP' || {_s(f'10000 + {k}')} || 'A'"),
        ("fkind", f"{k} % 12"),
        ("ckind", f"{k} % 11"),
        ("sup", f"{k} % 10"),
    ]


def _true_pn(d: Dialect) -> list[tuple[str, str]]:
    return [
        ("*", "*"),
        ("true_pn", "CASE fkind WHEN 3 THEN " + _s("300 + k % 600") + " || '-' || " + _s("10 + k % 90")
         + " || '-J' || " + _s("1000 + k") + " || '-201'"
         + " WHEN 4 THEN 'UCP-' || " + _s("200 + k % 700") + " || '-' || lpad(" + _s("k % 99999") + ", 5, '0')"
         + " WHEN 5 THEN " + _s("10000000 + k") + " || 'A'"
         + " WHEN 6 THEN '30-' || " + _s("168217 + k") + " || '-E'"
         + " WHEN 7 THEN 'EO-G' || " + _s("2000 + k % 7000") + " || '-H1' ELSE cpn END"),
    ]


def _file_and_pn(d: Dialect) -> list[tuple[str, str]]:
    return [
        ("*", "*"),
        ("source_filename", pick("k", "'B2BDraw_' || cpn || '-A-PD.pdf'", "'_asm_temp_' || cpn || '-RevB.pdf'",
                                 "cpn || '-(157529).PDF'", "true_pn || '_DRILL.pdf'", "true_pn || '.pdf'",
                                 "true_pn || '.pdf'", "true_pn || '-PDM-' || true_pn || '.pdf'", "true_pn || '.pdf'",
                                 "'Draw_' || cpn || '#RevX#A0#S2_30.pdf'", "cpn || '_Rev_C.pdf'",
                                 "'scan ' || " + _s("k") + " || '.pdf'", "cpn || '.tif'")),
        ("part_number", pick("k", "true_pn", "true_pn", "true_pn", "true_pn", "replace(true_pn, '8', 'B')",
                             "substr(true_pn, 1, 4) || substr(true_pn, 6)",
                             "substr(true_pn, 1, 3) || substr(true_pn, 5, 1) || substr(true_pn, 4, 1) || substr(true_pn, 6)",
                             "'ITEM ' || " + _s("k % 90"), "''", "substr(true_pn, 1, length(true_pn) - 1)",
                             "CASE WHEN k % 2 = 0 THEN 'AZO-34008-DD' ELSE substr(true_pn, 1, 4) || "
                             + _s("k % 10") + " || substr(true_pn, 6) END")),
    ]


def _record(d: Dialect) -> list[tuple[str, str]]:
    step = lambda no, en, he, de: d.struct(step_no=no, name_en=en, name_he=he, details=de)
    kinds = q("ZINC PLATING", "ELECTROLESS NICKEL", "ANODIZE", "CHEM FILM", "PASSIVATION", "EPOXY PRIMER",
              "MASKING", "HARD ANODIZE")
    stds = q("ASTM B633 TYPE II", "AMS-C-26074 CLASS 4 GRADE B", "MIL-A-8625 TYPE II CLASS 2", "MIL-DTL-5541 CLASS 1A",
             "AMS 2700 TYPE 2", "MIL-PRF-23377", "", "MIL-A-8625 TYPE III")
    thick = q("5-10 mic", "0.5-1.0 mm", "15 microns", "", "0.0002-0.0004 in", "8 - 12 mic", "25 mic", "")
    names = q("ZINC PLATING YELLOW CHROMATE", "HIGH PHOSPHORUS ELECTROLESS NICKEL", "BLACK ANODIZE", "ALODINE CLEAR",
              "PASSIVATE PER AMS 2700", "EPOXY PRIMER COAT", "MASK THREADS BEFORE PLATING", "HARD ANODIZE BLUE")
    paints = q("POLYURETHANE RAL 7035 BY TAMBOUR", "TOP COAT RAL 999 BY ACMEPAINT", "EPOXY BY UNKNOWNCO", "RAL 9005",
               "JOTUN PENGUARD", "PAINT RAL 1234 RAL 5010")
    coat = lambda i, off: d.struct(
        step_no=f"'20.{i}'", type=pick(f"(k + {off})", *kinds), type_he="''",
        name=pick(f"(k + {off})", *names),
        thickness=pick(f"(k + {off} + CAST(floor(k / 8) AS BIGINT))", *thick),
        standard=pick(f"(k + {off} + CAST(floor(k / 64) AS BIGINT))", *stds),
        rohs=f"(k + {off}) % 3 = 0", color="''",
    )
    bom = lambda no, pn, desc, qty: d.struct(item_no=no, part_number=pn, description=desc, qty=qty)
    rev = lambda r: d.struct(rev=r, date="'2024-01-01'", description="'ISSUE'", approved_by="'QA'")
    warn = lambda t, s, v: d.struct(type=t, severity=s, source="'standards'", value=v, message=f"'check ' || {v}")
    usd = "CAST(CAST((k % 500) * 7 AS DOUBLE) / 100000 AS DECIMAL(18,6))"
    return [
        ("record_id", "'R' || lpad(" + _s("k") + ", 10, '0')"),
        ("batch_id", "'B' || lpad(" + _s("CAST(floor(k / 40) AS BIGINT)") + ", 8, '0')"),
        ("fingerprint", "md5('part-' || " + _s("CASE WHEN k % 29 = 0 THEN k + 1 ELSE k END") + ")"),
        ("source_filename", "source_filename"),
        ("part_number", "part_number"),
        ("drawing_number", pick("k", "true_pn", "''", "'N/A'", "part_number", "replace(true_pn, '7', 'T')")),
        ("revision", pick("k", *q("RC", "REV B", "Rev.C", "A", "", "-", "B1", "REV D2", "LONGREVISION"))),
        ("customer", pick("k", _name("sup"),
                          "upper('Supplier-Works, ' || lpad(" + _s("sup") + ", 6, '0') || '. Ltd')",
                          "'supplier works ' || lpad(" + _s("sup") + ", 6, '0') || ' Ltd. Plant 7'",
                          "''", "''", _name("sup"), "'acme'")),
        ("cage_code", pick("k", _cage("sup"), "'C!1'", "''", "lower(" + _cage("sup") + ")", "'C!1'", "''", "'Z9999'")),
        ("title", pick("k", "upper(p_name)", "upper(p_name) || ' ASSY'", "''")),
        ("catalog_number", "CASE WHEN k % 4 = 0 THEN 'CAT-' || " + _s("k") + " ELSE '' END"),
        ("material", pick("k", *q(
            "AL 6061-T651 PER AMS-QQ-A-250/11", "USE EXTRUSION MCM-MC-08028-01.", "USE STAINLESS STEEL 304", "",
            "AL 5052-H32 PER SAE-AMS-4016 (FORMERLY AMS QQ-A-250/8 OR AMS QQ-A-225/7)", "STEEL 4140 QQ-S-624",
            "PVC", "—", "TITANIUM Ti-6AL-4V  ( FORMALY: MIL-T-9046. ) PLATE,", "SEE NOTE 3", "PER DRAWING", "AL"))),
        ("alternative_material", pick("k", *q("", "BRASS C360", ""))),
        ("material_formerly", "CASE WHEN k % 24 = 4 THEN 'MIL-A-1' ELSE '' END"),
        ("quantity", _s("1 + k % 4")),
        ("os_level", pick("k", *q("OS1", "", "OS2"))),
        ("assembly_role", pick("k", *q("PART", "", "ASSEMBLY", "PART", ""))),
        ("notes", pick("k", *q(
            "PICKLING PER PROCESS. MARK PART NUMBER BP99999X-1.", "HYDROGEN EMBRITTLEMENT RELIEF REQUIRED", "",
            "INSPECT PER ZO SQUEGLIA, NQE VALUE 2.5 ACC. TO-PS-DOC0002945", "GLASS BEAD BLAST ALL OVER",
            "COAT PER V25.4 AMS-C-26074 AND PSSOO100", "BREAK SHARP EDGES"))),
        ("raw_weight", d.struct(qty=pick("k", "'1.5'", "''", "'2'"), unit=pick("k", "'kg'", "''", "''"))),
        ("part_weight", d.struct(qty=pick("k", "'0.5'", "''"), unit=pick("k", "'kg'", "''"))),
        ("general_instructions", d.array(("k % 4 <> 0", "'DIMENSIONAL LIMITS APPLY'"), ("k % 6 = 1", "'USE WITH ' || cpn"))),
        ("environment_requirements", d.array(("k % 3 = 0", "'SALT FOG'"), ("k % 5 = 0", "''"), ("k % 6 = 0", "'HUMIDITY'"))),
        ("standards", d.array(
            ("k % 13 <> 0", pick("k", *q("MIL-DTL-5541", "AMS 2700", "ASTM B633 TYPE II", "PS- 111.21", "AWI-STD-1916",
                                         "ISO STANDARDS", "RoHS DIRECTIVE 2011/65", "RAL 7035", "sm111.10"))),
            ("k % 3 <> 0", pick("k", "'Y14. 6'", "'SW' || lpad(" + _s("sup") + ", 6, '0') || '-' || " + _s("k"),
                                "'FED. STD. 595A'", "'QQ-P-416'", "'XYZ, 99'", "'gen 1111'", "'VT'",
                                "'ZQSQLAND NQE'")),
            ("k % 7 = 2", "'RAL 123'"),
            ("k % 10 = 4", "'PS  231 X'"))),
        ("revisions_history", d.array(("k % 4 <> 0", rev("'A'")), ("k % 4 >= 2", rev(pick("k", "'B'", "''", "'-'", "'C'"))))),
        ("bom_items", d.array(
            ("k % 6 = 1", bom("'1'", "part_number", "'SELF'", "'1'")),
            ("k % 6 IN (2, 3)", bom("'1'", "'BP' || " + _s("20000 + k") + " || 'A'",
                                    "'SCREW 0.250 NOM. SIZE 0.218 NOM. SIZE 0.218 NOM. SIZE 0.218'", "'2'")),
            ("k % 6 = 3", bom("'2'", "'50370634'", "'HEAD  HEAD HEAD HEAD BOLT '", "'4'")),
            ("k % 6 = 4", bom("'3'", "''", "'PLATE  AL 6061-T6 ZINC PLATED'", "'1'")),
            ("k % 6 = 5", bom("'4'", "upper(part_number)", "'A A A B A A A B A A A B'", "'—'")))),
        ("machining_processes", d.array(("k % 3 <> 0", step("'10.1'", "'TURNING'", "'חריטה'", "'LATHE'")),
                                        ("k % 10 = 1", step("'10.2'", "'MARK PART NUMBER ' || cpn", "''", "'LASER'")))),
        ("welding_processes", d.array(("k % 7 = 0", step("'11.1'", "'GTAW'", "'ריתוך'", "'PER AWS D17.1'")))),
        ("heat_treatment_processes", d.array(("k % 6 = 0", step("'12.1'", "'AGING'", "''", "'T6'")))),
        ("ndt_processes", d.array(("k % 8 = 0", step("'13.1'", "'PT TYPE I'", "''", "''")))),
        ("inspection_processes", d.array(("k % 2 = 0", step("'60.1'", "'VISUAL'", "''", "'100%'")),
                                         ("k % 14 = 0", step("'60.2'", "'MARKING P/N: BP10000A'", "''", "''")))),
        ("additional_processes", d.array(("k % 4 = 0", step("'30.1'", "'PICKLING'", "''", "'NITRIC ACID'")),
                                         ("k % 4 = 1", step("'30.2'", "'DEBURR'", "''", "'ALL EDGES'")),
                                         ("k % 12 = 5", step("'30.3'", "'STRESS RELIEF BAKE'", "''", "''")))),
        ("final_approval", d.array(("k % 5 <> 0", step("'70.1'", "'VISUAL INSPECTION'", "''", "''")),
                                   ("k % 5 = 1", step("'70.2'", "'SERVICEABILITY TAG'", "'תג'", "''")))),
        ("coating_processes", d.array(("k % 4 <> 3", coat(1, 0)), ("k % 5 = 0", coat(2, 3)))),
        ("painting_processes", d.array(("k % 3 = 1", d.struct(
            step_no="'25.1'", type="'PAINT'", type_he="''", name=pick("k", *paints), thickness="''",
            standard=pick("k", *q("MIL-PRF-85285 RAL 7035", "", "RAL 0000", "")), rohs="k % 2 = 0", color="''")))),
        ("packaging_notes", d.struct(step_no="'80.1'", en=pick("k", *q(
            "EACH PART SHALL BE INDIVIDUALLY PACKED.", "", "[NO_PACKING_REQUIREMENT_IN_DRAWING]",
            "qwzx 12345 vvv kkk jj", "BAG", "EACH PART SHALL BE PACKED INDIVIDUALLY")), he="''")),
        ("_ocr_used", "k % 3 = 0"),
        ("_is_overview_image", "k % 40 = 39"),
        ("_pn_warnings", d.array(
            ("k % 5 = 4", "'[HIGH][SUSPICIOUS_STANDARD] standard ''AWI-STD-' || " + _s("k % 17") + " || ''' has no known body'"),
            ("k % 6 = 1", "'[WARN][POSSIBLE_HALLUCINATION] standard ''XYZ 99'' is not in the text'"),
            ("k % 7 = 3", "'[INFO][MISSING_PACKING] packing was not extracted'"),
            ("k % 8 = 3", "'[INFO][NO_PACKING_REQUIREMENT_IN_DRAWING] none required'"),
            ("k % 9 = 2", "'[INFO][MISSING_SERVICEABILITY_TAG] no tag'"),
            ("k % 10 = 1", "'[HIGH][CUSTOMER_PREFIX_MISMATCH] other customer'"))),
        ("_validation_warnings", d.array(
            ("k % 4 = 1", warn("'SUSPICIOUS_STANDARD'", "'HIGH'", "'XYZ 99'")),
            ("k % 6 = 2", warn("'INVALID_RAL'", "'CRITICAL'", "'RAL 0999'")),
            ("k % 9 = 5", warn("'MISSING_PACKING'", "'MEDIUM'", "'(empty)'")),
            ("k % 11 = 3", warn("'FILENAME_PN_MISMATCH'", "'WARN'", "part_number")),
            ("k % 13 = 7", warn("'DWG_PREFIX_MISSING'", "CAST(NULL AS STRING)", "part_number")))),
        ("_cost_info", d.struct(
            filename="source_filename", timestamp="'2024-01-01T00:00:00'",
            total_cost_usd=usd, total_cost_ils=f"CAST({usd} * CAST(3.7 AS DECIMAL(4,1)) AS DECIMAL(18,4))",
            input_tokens="CAST(4000 + k % 900 AS BIGINT)", output_tokens="CAST(1000 + k % 700 AS BIGINT)")),
        ("_review_status", pick("k", *q("pending", "reviewed", "edited", None))),
    ]


# Second run of the same files: the same record with deterministic differences per field.
def _second_run(d: Dialect) -> list[tuple[str, str]]:
    keep = ["record_id", "batch_id", "fingerprint", "source_filename", "revision", "title", "notes", "assembly_role",
            "alternative_material", "material_formerly", "catalog_number", "quantity", "raw_weight",
            "general_instructions", "environment_requirements", "machining_processes", "welding_processes",
            "heat_treatment_processes", "ndt_processes", "inspection_processes", "additional_processes",
            "final_approval", "painting_processes", "bom_items", "_pn_warnings", "_cost_info"]
    num = "CAST(substr(record_id, 2) AS BIGINT)"
    sub = lambda col, n, m: (
        f"CASE WHEN {num} % {n} = {m} THEN {d.array(('1 = 0', _element(d, col)))} ELSE {col} END"
    )
    out = [(c, c) for c in keep]
    out += [
        ("part_number", f"CASE WHEN {num} % 9 = 2 THEN '' WHEN {num} % 9 = 4 THEN part_number || 'X' ELSE part_number END"),
        ("drawing_number", f"CASE WHEN {num} % 8 = 3 THEN '' ELSE drawing_number END"),
        ("customer", f"CASE WHEN {num} % 5 = 1 THEN 'Acme Ltd.' ELSE customer END"),
        ("cage_code", f"CASE WHEN {num} % 6 = 2 THEN '' WHEN {num} % 6 = 3 THEN 'Q1234' ELSE cage_code END"),
        ("material", f"CASE WHEN {num} % 7 = 3 THEN 'BRASS' ELSE material END"),
        ("part_weight", d.struct(qty=f"CASE WHEN {num} % 4 = 0 THEN '9' ELSE part_weight.qty END", unit="part_weight.unit")),
        ("standards", sub("standards", 10, 7)),
        ("revisions_history", sub("revisions_history", 12, 5)),
        ("coating_processes", sub("coating_processes", 9, 1)),
        ("packaging_notes", d.struct(step_no="packaging_notes.step_no",
                                     en=f"CASE WHEN {num} % 10 = 3 THEN 'BAG' ELSE packaging_notes.en END",
                                     he="packaging_notes.he")),
    ]
    return out


def _element(d: Dialect, col: str) -> str:
    return f"element_at({col}, 1)" if d.spark else f"{col}[1]"


# ----------------------------------------------------------------------------- orders + lineitem -> batches
def _assemblies(d: Dialect) -> list[tuple[str, str]]:
    o = "o_orderkey"
    pn = f"'BN' || {_s(f'100000 + {o}')} || 'B'"
    return [
        ("batch_id", f"'O' || lpad({_s(o)}, 10, '0')"),
        ("pos", "CAST(0 AS BIGINT)"),
        ("record_id", f"'A' || {_s(o)}"),
        ("source_filename", f"'asm_' || {_s(o)} || '.pdf'"),
        ("part_number", pn),
        ("drawing_number", f"CASE WHEN {o} % 9 = 4 THEN '' ELSE {pn} END"),
        ("assembly_role", "'ASSEMBLY'"),
        ("title", f"'ORDER ASSEMBLY ' || o_orderpriority"),
        ("material", "CASE WHEN o_orderkey % 5 = 0 THEN 'AL 6061-T6' ELSE '' END"),
        ("quantity", "'1'"),
        ("notes", f"CASE WHEN {o} % 4 = 1 THEN 'MARK PART NUMBER ' || {pn} || ' AND MARKING PN: BP77777Z.' ELSE '' END"),
        ("cost_usd", "CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(o_totalprice / 1000000 AS DECIMAL(18,6)) END AS DECIMAL(18,6))"),
        ("warning_count", f"CAST({o} % 3 AS BIGINT)"),
        ("review_status", pick(o, *q("pending", "reviewed", "edited"))),
        ("failed", "o_orderstatus = 'P' AND o_orderkey % 5 = 2"),
    ]


def _overviews(d: Dialect) -> list[tuple[str, str]]:
    o = "o_orderkey"
    return [
        ("batch_id", f"'O' || lpad({_s(o)}, 10, '0')"),
        ("pos", "CAST(-1 AS BIGINT)"),
        ("record_id", f"'I' || {_s(o)}"),
        ("source_filename", f"'overview_' || {_s(o)} || '.png'"),
        ("part_number", f"CASE WHEN {o} % 2 = 0 THEN 'overview_' || {_s(o)} ELSE 'IMAGE-' || {_s(o)} END"),
        ("drawing_number", "''"),
        ("assembly_role", "'Assembly Overview Image'"),
        ("title", "''"),
        ("material", "''"),
        ("quantity", "''"),
        ("notes", "''"),
        ("cost_usd", "CAST(0.01 AS DECIMAL(18,6))"),
        ("warning_count", "CAST(0 AS BIGINT)"),
        ("review_status", "'reviewed'"),
        ("failed", "1 = 0"),
    ]


def _child_pn(k: str) -> str:
    return f"'BP' || {_s(f'10000 + {k}')} || 'A'"


def _parts(d: Dialect) -> list[tuple[str, str]]:
    """Part drawings of a batch: one per distinct (order, part) whose drawing was uploaded."""
    k = "l_partkey"
    pn = f"CASE WHEN {k} % 13 = 1 THEN replace({_child_pn(k)}, '1', 'I') ELSE {_child_pn(k)} END"
    return [
        ("batch_id", f"'O' || lpad({_s('l_orderkey')}, 10, '0')"),
        ("pos", f"CAST(1 + {k} AS BIGINT)"),
        ("record_id", f"'P' || {_s('l_orderkey')} || '-' || {_s(k)}"),
        ("source_filename", f"{_child_pn(k)} || '.pdf'"),
        ("part_number", f"CASE WHEN {k} % 31 = 5 THEN '' ELSE {pn} END"),
        ("drawing_number", f"CASE WHEN {k} % 6 = 1 THEN '' ELSE {pn} END"),
        ("assembly_role", f"CASE WHEN {k} % 17 = 3 THEN 'ASSEMBLY' ELSE 'PART' END"),
        ("title", f"'PART ' || {_s(f'{k} % 100')}"),
        ("material", pick(k, *q("AL 7075-T6", "", "STEEL 4140"))),
        ("quantity", _s(f"1 + {k} % 3")),
        ("notes", f"CASE WHEN {k} % 5 = 2 THEN 'MARK P/N ' || {_child_pn(k)} || '; MARK PART NUMBER BN' || {_s('100000 + l_orderkey')} || 'B.' ELSE '' END"),
        ("cost_usd", f"CAST(CAST({k} % 50 AS DOUBLE) / 1000 AS DECIMAL(18,6))"),
        ("warning_count", f"CAST({k} % 4 AS BIGINT)"),
        ("review_status", pick(k, *q("reviewed", "pending"))),
        ("failed", f"{k} % 41 = 0"),
    ]


_BOM_DESC = pick("l_partkey", *q("SCREW STAINLESS 304", "", "PLATE AL 6061-T6 ZINC PLATED YELLOW CHROMATE",
                                 "WASHER BRASS BRASS", "BRACKET"))
_BOM_QTY = "CASE WHEN l_partkey % 10 = 1 THEN '' ELSE " + _s("CAST(l_quantity AS INT)") + " END"


_BOM_ORDER = {"o1": "l_linenumber", "o2": "l_partkey", "o3": "l_suppkey", "o4": "l_extendedprice", "o5": "l_quantity", "o6": "l_discount",
              "o7": "l_shipdate"}


def _bom(d: Dialect) -> list[tuple[str, str]]:
    return [
        ("batch_id", f"'O' || lpad({_s('l_orderkey')}, 10, '0')"),
        ("parent_record_id", f"'A' || {_s('l_orderkey')}"),
        ("parent_pos", "CAST(0 AS BIGINT)"),
        ("item_no", _s("l_linenumber")),
        ("part_number", f"CASE WHEN l_partkey % 7 = 2 THEN '80' || {_s('10000 + l_partkey')} "
                        f"WHEN l_partkey % 37 = 6 THEN '' ELSE {_child_pn('l_partkey')} END"),
        ("description", _BOM_DESC),
        ("qty", _BOM_QTY),
        *_BOM_ORDER.items(),
    ]


def _sub_bom(d: Dialect) -> list[tuple[str, str]]:
    """Raw-material lines of the part drawings that are small assemblies themselves."""
    return [
        ("batch_id", "batch_id"),
        ("parent_record_id", "record_id"),
        ("parent_pos", "pos"),
        ("pos", "CAST(1 AS BIGINT)"),
        ("item_no", "'1'"),
        ("part_number", "'50370634'"),
        ("description", "'RAW BAR STEEL'"),
        ("qty", "'1'"),
    ]


def _balloons(d: Dialect) -> list[tuple[str, str]]:
    """Item balloons read from the overview image: by item number, by part number, or neither."""
    return [
        ("batch_id", f"'O' || lpad({_s('l_orderkey')}, 10, '0')"),
        ("parent_record_id", f"'I' || {_s('l_orderkey')}"),
        ("item_no", "CASE WHEN l_partkey % 3 = 0 THEN '' ELSE " + _s("l_linenumber") + " END"),
        ("part_number", f"CASE WHEN l_partkey % 4 = 1 THEN '' ELSE {_child_pn('l_partkey')} END"),
        ("description", "'BALLOON ' || " + _s("l_partkey")),
        ("qty", _s("CAST(l_quantity AS INT)")),
    ]


# ----------------------------------------------------------------------------- ledgers, dimensions, catalog
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


def _history(d: Dialect) -> list[tuple[str, str]]:
    return [
        ("event_id", "event_id"),
        ("timestamp", "ts"),
        ("filename", f"'f' || {_s('user_id')} || '.pdf'"),
        ("mode", "CASE event_type WHEN 'click' THEN 'assembly' WHEN 'signup' THEN 'assembly' WHEN 'error' THEN CAST(NULL AS STRING) ELSE 'single' END"),
        ("part_number", f"'BP' || {_s('10000 + user_id')} || 'A'"),
        ("drawing_count", "CAST(1 + event_id % 5 AS INT)"),
        ("warning_count", "CAST(event_id % 3 AS INT)"),
        ("review_status", pick("event_id", *q("pending", "reviewed", "edited", None))),
        ("cost_usd", "CAST(value AS DECIMAL(18,6))"),
        ("cache_hit", f"{_K} % 3 = 0"),
        ("json_path", "CASE WHEN event_id % 2 = 0 THEN '' ELSE 'out/' || " + _s("event_id") + " || '.json' END"),
    ]


def _audit(d: Dialect) -> list[tuple[str, str]]:
    return [
        ("event_id", "event_id"),
        ("timestamp", "ts"),
        ("action", pick("event_id", "event_type", "'cache_hit'", "'export'")),
        ("user", f"CASE WHEN event_id % 20 = 0 THEN '' ELSE 'u' || {_s('user_id % 100')} END"),
        ("subject", f"'BP' || {_s('10000 + user_id')} || 'A'"),
        ("details", "CASE WHEN event_id % 4 = 0 THEN CAST(NULL AS STRING) ELSE props END"),
        ("model", pick("event_id", *q("gpt-4o", "", "gpt-5.4"))),
        ("cost_usd", "CAST(CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END AS DECIMAL(18,6))"),
    ]


def _calls(d: Dialect) -> list[tuple[str, str]]:
    return [
        ("call_id", "event_id"),
        ("record_id", f"'u' || {_s('user_id')}"),
        ("stage", "event_type"),
        ("model", pick("event_id", *q("gpt-4o", "gpt-4o-mini", "GPT-5.4", "gpt-5-mini", "other"))),
        ("input_tokens", f"CAST({_K} * 101 + event_id % 97 AS BIGINT)"),
        ("output_tokens", f"CAST({_K} * 37 + event_id % 89 AS BIGINT)"),
    ]


def _dim_cage(d: Dialect) -> list[tuple[str, str]]:
    return [("cage", _cage("s_suppkey")), ("customer", _name("s_suppkey"))]


def _dim_default_cage(d: Dialect) -> list[tuple[str, str]]:
    return [("customer", _name("s_suppkey")), ("cage", _cage("s_suppkey"))]


def _dim_alias(d: Dialect) -> list[tuple[str, str]]:
    return [
        ("ordinal", "s_suppkey"),
        ("alias", "'SUPPLIER WORKS ' || lpad(" + _s("s_suppkey") + ", 6, '0') || ' LTD'"),
        ("customer", _name("s_suppkey")),
    ]


def _dim_prefix(d: Dialect) -> list[tuple[str, str]]:
    return [
        ("ordinal", "s_suppkey"),
        ("prefix", "CASE s_suppkey WHEN 1 THEN 'UCP' WHEN 2 THEN 'EO-' WHEN 3 THEN '30-' WHEN 4 THEN 'BP' ELSE 'BP' || "
         + _s("100 + s_suppkey") + " END"),
        ("customer", _name("s_suppkey")),
    ]


def _dim_spec(d: Dialect) -> list[tuple[str, str]]:
    return [("customer", _name("s_suppkey")), ("pattern", "'^SW' || lpad(" + _s("s_suppkey") + ", 6, '0') || '-[0-9]+'")]


def _catalog(d: Dialect) -> list[tuple[str, str]]:
    """Catalog of coating masters: one per supplier, so its size follows the smallest business table."""
    k = "s_suppkey"
    return [
        ("ordinal", k),
        ("master_id", f"'ms.' || {_s(k)}"),
        ("desc", pick(k, *q("BLUE/WHITE ZINC-RoHS", "ELECTROLESS NICKEL HIGH PHOSPHORUS", "BLACK ANODIZE", "CHEM FILM CLEAR RoHS",
                            "PASSIVATION", "YELLOW ZINC PLATING", "HARD ANODIZE", "NICKEL PLATING", "CADMIUM PLATING",
                            "LOW PHOSPHORUS ELECTROLESS NICKEL RoHS", "BLACK OXIDE"))),
        ("standard", pick(f"({k} + CAST(floor({k} / 11) AS BIGINT))", *q(
            "ASTM-B633 TYPE II CLASS 1", "AMS-C-26074D CLASS 4 GRADE B", "MIL-A-8625 TYPE II CLASS 2",
            "MIL-DTL-5541F CLASS 1A", "AMS 2700 TYPE 2", "ASTM B633 AND QQ-Z-325", "MIL-A-8625F TYPE III"))),
        ("thickness", pick(f"({k} + CAST(floor({k} / 7) AS BIGINT))", *q("5-10 mic", "", "15 mic", "0.5-1.0 mm", "8-12 mic"))),
        ("color", "''"), ("col5", "''"), ("rohs", pick(k, *q("Y", ""))),
        ("full_name", f"'coat\\\\' || {_s(k)}" if d.spark else f"'coat\\' || {_s(k)}"),
    ]


def _texts(d: Dialect) -> list[tuple[str, str]]:
    """Source text of a record: the whole document, with title-block lines added after it."""
    nl = "chr(10)"
    return [
        ("record_id", "'R' || lpad(" + _s("doc_id") + ", 10, '0')"),
        ("text", f"text || {nl} || " + pick(
            "doc_id",
            f"'MATERIAL:' || {nl} || {nl} || 'SAME MATERIAL' || {nl} || '  AL 6061-T6 PLATE '",
            f"'Matl - STEEL 4140' || {nl} || 'MIL-DTL-5541 AND AMS2700'",
            f"'made of STAINLESS STEEL 303 COND A PER AMS-5640 bar' || {nl} || 'ASTM B633'",
            f"'MATERIAL' || {nl} || 'QTY' || {nl} || 'DATE' || {nl} || 'SCALE' || {nl} || 'BRASS' ",
            f"'PS-111.21 and MIL DTL 5541'",
            f"'MATERIAL ACC TO NOTE' || {nl} || 'DELRIN ROD THICK 5 MM PER ASTM D4181'",
            "'no data'")),
    ]


# table name -> (source, stages); each stage is a projection over the previous one
FLAT: dict[str, tuple[str, list[Callable[[Dialect], list[tuple[str, str]]]], str]] = {
    "records": ("part", [_identity, _true_pn, _file_and_pn, _record], ""),
    "asm": ("orders", [_assemblies], ""),
    "overview": ("orders", [_overviews], "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "balloons": ("lineitem", [_balloons], ""),
    "history": ("events", [_history], ""),
    "audit": ("events", [_audit], ""),
    "calls": ("events", [_calls], ""),
    "dim_cage": ("supplier", [_dim_cage], ""),
    "dim_default_cage": ("supplier", [_dim_default_cage], ""),
    "dim_alias": ("supplier", [_dim_alias], ""),
    "dim_pn_prefix": ("supplier", [_dim_prefix], ""),
    "dim_internal_spec": ("supplier", [_dim_spec], ""),
    "catalog": ("supplier", [_catalog], ""),
    "texts": ("documents", [_texts], ""),
    "bom_lines": ("lineitem", [_bom], ""),
}
# Each of these narrow rows becomes a hundred texts. Spark cuts a file by its bytes, so a few MB would be one task: the rows are
# dealt out by key into files of their own before they grow. (A shuffle alone does not help: filters on the texts move below it.)
DEALT_OUT = {"records": "p_partkey"}
UPLOADED = "l_returnflag <> 'R'"
BOM_ORDER = "o1, o2, o3, o4, o5, o6, o7"
DRAWING_COLUMNS = [c for c, _ in _assemblies(Dialect(True))]
BOM_COLUMNS = [c for c, _ in _sub_bom(Dialect(True))]


class Tables:
    """Derived tables as Spark DataFrames over a folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.d = spark, folder, Dialect(True)
        # logical plans (no data) of this session, so that a table is analysed once
        self._plans = spark.__dict__.setdefault("_specmill_plans", {})

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.folder, name)
        if key not in self._plans:
            self._plans[key] = make()
        return self._plans[key]

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def project(self, df: DataFrame, stages) -> DataFrame:
        for stage in stages:
            df = df.selectExpr(*["*" if c == "*" else f"{e} AS `{c}`" for c, e in stage(self.d)])
        return df

    def flat(self, name: str) -> DataFrame:
        return self._once(self._plan_name(name), lambda: self._flat(name))

    def _rows(self, name: str) -> DataFrame:
        """The source rows of a derived table."""
        src = FLAT[name][0]
        if name not in DEALT_OUT:
            return self.source(src)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.written(f"rows_of_{name}", lambda: self.source(src).repartition(n, DEALT_OUT[name]), spread=False)

    def _plan_name(self, name: str, source: str | None = None) -> str:
        """Plans over written rows are kept for these files only."""
        source = source or name
        if source not in DEALT_OUT:
            return name
        self._rows(source)
        return f"{name} of {self.path_of(f'rows_of_{source}')}"

    def _flat(self, name: str) -> DataFrame:
        _, stages, where = FLAT[name]
        df = self._rows(name)
        if where:
            df = df.where(where.removeprefix("WHERE "))
        return self.project(df, stages)

    def records(self) -> DataFrame:
        return self._once(self._plan_name("typed records", "records"), self._records)

    def _records(self) -> DataFrame:
        return self.typed_records(self.flat("records"))

    def typed_records(self, df: DataFrame) -> DataFrame:
        return df.selectExpr(*[
            f"CAST(`{c}` AS {schemas.RECORD_TYPES[c]}) AS `{c}`" if not c.startswith("_cost") else f"`{c}`"
            for c in df.columns
        ])

    def second_run(self) -> DataFrame:
        return self._once(self._plan_name("records2", "records"), lambda: self.project(self.records(), [_second_run]))

    def written(self, name: str, make: Callable[[], DataFrame], spread: bool = True) -> DataFrame:
        """A table several jobs of the session read: written once, read back from then on."""
        key = (self.folder, "written " + name)
        path, df = self._plans.get(key, (None, None))
        if path is None or not store.exists(self.spark, path):
            path = store.new_path(self.spark, name)
            made = make()
            # spread by row identity, not by batch: one large batch must not become one file
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            store.write(made.repartition(n, "batch_id", "pos") if spread else made, path)
            df = self.spark.read.schema(made.schema).parquet(path)
            self._plans[key] = (path, df)
        return df

    def path_of(self, name: str) -> str:
        return self._plans[(self.folder, "written " + name)][0]

    def part_drawings(self) -> DataFrame:
        """One row per (order, part): the projection is a function of the two keys."""
        src = self.source("lineitem").where(UPLOADED).select("l_orderkey", "l_partkey").distinct()
        return self.project(src, [_parts])

    def drawings(self) -> DataFrame:
        """Derived where it is read: what is dealt out are the two keys of a part drawing, and a job reads only the columns it needs."""
        return self._once("drawings", lambda: self.flat("asm").unionByName(self.part_drawings()).unionByName(self.flat("overview")))

    def written_drawings(self) -> DataFrame:
        """The drawings as files, for jobs that need files (``path_of``)."""
        return self.written("drawings", self.drawings)

    def bom(self) -> DataFrame:
        return self._once("bom", self._bom)

    def _bom(self) -> DataFrame:
        # numbered before the texts are made: one batch per order, so the numbers alone are dealt out and sorted
        order = ", ".join(_BOM_ORDER.values())
        lines = self.source("lineitem").selectExpr(
            "l_orderkey", *_BOM_ORDER.values(), f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS BIGINT) AS pos")
        lines = self.project(lines, [lambda d: [*_bom(d), ("pos", "pos")]]).select(*BOM_COLUMNS)
        subs = self.project(self.part_drawings().where("assembly_role = 'ASSEMBLY'"), [_sub_bom])
        return lines.unionByName(subs)


def checking_sql() -> dict[str, str]:
    """The same tables as SELECT statements for the checking engine, in dependency order."""
    d = Dialect(False)
    quote = lambda c: f'"{c}"'

    def project(src: str, stages, where: str = "") -> str:
        sql = src
        for i, stage in enumerate(stages):
            cols = ", ".join("*" if c == "*" else f"{e} AS {quote(c)}" for c, e in stage(d))
            sql = f"SELECT {cols} FROM {sql if i == 0 else '(' + sql + ')'}" + (f" {where}" if i == 0 else "")
        return sql

    out = {name: project(src, stages, where) for name, (src, stages, where) in FLAT.items()}
    out["records2"] = project("records", [_second_run])
    out["part_drawings"] = project(f"(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE {UPLOADED})", [_parts])
    cols = ", ".join(quote(c) for c in DRAWING_COLUMNS)
    out["drawings"] = (
        f"SELECT {cols} FROM asm UNION ALL SELECT {cols} FROM part_drawings UNION ALL SELECT {cols} FROM overview"
    )
    bom_cols = ", ".join(quote(c) for c in BOM_COLUMNS)
    out["bom"] = (
        f"SELECT {bom_cols} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY {BOM_ORDER}) "
        f"AS BIGINT) AS pos FROM bom_lines) UNION ALL "
        + project("(SELECT * FROM part_drawings WHERE assembly_role = 'ASSEMBLY')", [_sub_bom])
    )
    return out
