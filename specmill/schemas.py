"""Schemas of the record and ledger tables. Records are read with these, never with inference."""

from __future__ import annotations

STEP = "struct<step_no:string,name_en:string,name_he:string,details:string>"
COATING = (
    "struct<step_no:string,type:string,type_he:string,name:string,thickness:string,standard:string,"
    "rohs:boolean,color:string>"
)
WEIGHT = "struct<qty:string,unit:string>"
FINDING = "struct<type:string,severity:string,source:string,value:string,message:string>"
STAGE = (
    "struct<stage:string,model:string,input_tokens:bigint,output_tokens:bigint,"
    "input_cost_usd:decimal(18,6),output_cost_usd:decimal(18,6),total_cost_usd:decimal(18,6)>"
)

STEP_LISTS = [
    "machining_processes", "welding_processes", "heat_treatment_processes", "ndt_processes",
    "inspection_processes", "additional_processes", "final_approval",
]
COATING_LISTS = ["coating_processes", "painting_processes"]

_RECORD_FIELDS = [
    *[(n, "string") for n in (
        "batch_id", "record_id", "fingerprint", "source_filename", "part_number", "drawing_number", "revision",
        "customer", "cage_code", "title", "catalog_number", "material", "alternative_material", "material_formerly",
        "quantity", "os_level", "assembly_role", "notes",
    )],
    ("raw_weight", WEIGHT),
    ("part_weight", WEIGHT),
    ("general_instructions", "array<string>"),
    ("environment_requirements", "array<string>"),
    ("standards", "array<string>"),
    ("revisions_history", "array<struct<rev:string,date:string,description:string,approved_by:string>>"),
    ("bom_items", "array<struct<item_no:string,part_number:string,description:string,qty:string>>"),
    *[(n, f"array<{STEP}>") for n in STEP_LISTS],
    *[(n, f"array<{COATING}>") for n in COATING_LISTS],
    ("packaging_notes", "struct<step_no:string,en:string,he:string>"),
    ("_ocr_used", "boolean"),
    ("_is_overview_image", "boolean"),
    ("_pn_warnings", "array<string>"),
    ("_validation_warnings", f"array<{FINDING}>"),
    ("_cost_info", "struct<filename:string,timestamp:string,total_cost_usd:decimal(18,6),"
                   f"total_cost_ils:decimal(18,4),input_tokens:bigint,output_tokens:bigint,stages:array<{STAGE}>>"),
    ("_review_status", "string"),
    ("_review_timestamp", "string"),
    ("_user_edits", "map<string,string>"),
]
RECORD_DDL = ", ".join(f"`{n}` {t}" for n, t in _RECORD_FIELDS)

HISTORY_DDL = (
    "timestamp timestamp, filename string, mode string, part_number string, drawing_count int, warning_count int, "
    "review_status string, cost_usd decimal(18,6), cache_hit boolean, json_path string"
)
AUDIT_DDL = (
    "timestamp timestamp, action string, user string, subject string, details string, model string, "
    "cost_usd decimal(18,6)"
)
COSTS_DDL = (
    "filename string, timestamp timestamp, total_cost_usd decimal(18,6), total_cost_ils decimal(18,4), "
    f"input_tokens bigint, output_tokens bigint, stages array<{STAGE}>"
)
DIMENSION_DDL = (
    "cage_to_customer map<string,string>, customer_to_default_cage map<string,string>, "
    "customer_aliases map<string,string>, pn_prefix_to_customer map<string,string>, "
    "customer_internal_spec_patterns map<string,array<string>>"
)
RECORD_COLUMNS = [n for n, _ in _RECORD_FIELDS]
RECORD_TYPES = dict(_RECORD_FIELDS)
