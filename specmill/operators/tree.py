"""Product structure: relationships between drawings, the flattened tree, and its checks.

Tables: ``drawings`` (batch_id, pos, record_id, part_number, ...), ``bom``
(batch_id, parent_record_id, parent_pos, pos, item_no, part_number, description,
qty) and ``edges`` (batch_id, root_pos, parent_pn, parent_dwg, pos, child_pn,
child_dwg, description, qty, found). Identifiers are compared trimmed and
upper-cased within a batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmill import refdata as R
from specmill.functions import exprs as E

_S = lambda c: E.strip_id(F.col(c))
_K = lambda c: E.strip_kept(F.col(c))
Keep = Callable[[DataFrame, str], DataFrame]
#: Rewrites the texts of the named columns row by row.
Fix = Callable[[DataFrame, list[str]], DataFrame]


def _as_is(df: DataFrame, columns: list[str]) -> DataFrame:
    return df


def _blank() -> Column:
    return F.lit("")



def keyed(df: DataFrame, column: str = "part_number", name: str = "k") -> DataFrame:
    return df.withColumn(name, E.key(F.col(column)))


def _keyed(df: DataFrame, column: str = "part_number") -> DataFrame:
    """``keyed`` for written tables."""
    return df.withColumn("k", E.key_kept(F.col(column)))


# ------------------------------------------------------------------ W5, J4
def drawing_index(drawings: DataFrame) -> DataFrame:
    """Last drawing per (batch, identifier): title, material and drawing number."""
    d = keyed(drawings).where("k <> ''")
    return d.groupBy("batch_id", "k").agg(
        F.max_by(F.struct(F.col("title").alias("i_title"), F.col("material").alias("i_material"),
                          F.col("drawing_number").alias("i_dwg")), F.struct("pos", "record_id")).alias("i")
    ).select("batch_id", "k", "i.*")


def material_phrases(description: Column) -> Column:
    """Distinct material phrases of a description in order of appearance, comma separated."""
    found = F.regexp_extract_all(F.coalesce(description, _blank()), F.lit(R.MATERIAL_PHRASES), 0)
    return F.concat_ws(", ", F.array_distinct(F.transform(found, lambda m: F.upper(E.squeeze(m)))))


def bom_lookup(rows: DataFrame, drawings: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Rows with a part number get material, description and presence from the uploaded drawings."""
    df = keyed(rows).join(drawing_index(drawings) if index is None else index, ["batch_id", "k"], "left")
    mat = E.strip_id(F.col("i_material"))
    return df.withColumns({
        "uploaded": F.col("i_title").isNotNull() | F.col("i_material").isNotNull() | F.col("i_dwg").isNotNull(),
        "material": F.when(mat != "", mat).otherwise(material_phrases(F.col("description"))),
        "description": F.when(_S("description") != "", _S("description")).otherwise(E.strip_id(F.col("i_title"))),
    }).select(*rows.columns, "material", "uploaded")


# ------------------------------------------------------------------ J13, J7, J8
def is_assembly(c: Column) -> Column:
    return E.key(c) == "ASSEMBLY"


def is_overview(c: Column) -> Column:
    return F.lower(E.strip_id(c)) == R.OVERVIEW_ROLE.lower()


def edge_parents(drawings: DataFrame) -> DataFrame:
    """The drawings whose BOMs make edges: ASSEMBLY drawings. Overview images are never parents."""
    return drawings.where(is_assembly(F.col("assembly_role"))).select(
        "batch_id", F.col("record_id").alias("parent_record_id"), F.col("pos").alias("root_pos"),
        _S("part_number").alias("parent_pn"), _S("drawing_number").alias("parent_dwg"))


def edges_of(parents: DataFrame, drawings: DataFrame, bom: DataFrame) -> DataFrame:
    """The edges of the given parents (see ``edge_parents``); ``found`` if the child was uploaded."""
    rows = keyed(bom.where(_S("part_number") != "")).select(
        "batch_id", "parent_record_id", "pos", "item_no", _S("part_number").alias("child_pn"), "description", "qty", "k")
    index = drawing_index(drawings).select("batch_id", "k", _S("i_dwg").alias("child_dwg"), F.lit(True).alias("found"))
    # children first, while the rows are narrow: so the texts of a parent are dealt out once, not once a row
    out = rows.join(index, ["batch_id", "k"], "left").drop("k").join(parents, ["batch_id", "parent_record_id"])
    return out.select(
        "batch_id", "root_pos", "parent_record_id", "parent_pn", "parent_dwg", "pos", "item_no", "child_pn",
        F.coalesce("child_dwg", _blank()).alias("child_dwg"), "description", "qty", F.coalesce("found", F.lit(False)).alias("found"))


def derive_edges(drawings: DataFrame, bom: DataFrame) -> DataFrame:
    """Parent-child edges from the BOMs of ASSEMBLY drawings."""
    return edges_of(edge_parents(drawings), drawings, bom)


def demote_nested_roots(edges: DataFrame) -> DataFrame:
    """A parent that is a child in its batch is no root; its edges are dropped.

    A batch with a single parent keeps it, whatever its children.
    """
    return keyed(edges, "parent_pn").join(nested_parents(edges), ["batch_id", "k"], "left_anti").select(*edges.columns)


def _with_several(parents: DataFrame) -> DataFrame:
    """The batches with several parents: smallest and largest differ, which takes one shuffle."""
    return parents.groupBy("batch_id").agg(F.min("parent_record_id").alias("_a"), F.max("parent_record_id").alias("_z")).where(
        "_a <> _z").select("batch_id")


def nested_parents(edges: DataFrame) -> DataFrame:
    """(batch_id, k) of the parents that are children in a batch with several parents."""
    parents = edges.select("batch_id", "parent_record_id", E.key(F.col("parent_pn")).alias("k")).distinct()
    several = _with_several(parents)
    kids = keyed(edges, "child_pn").where("k <> ''").select("batch_id", "k")
    return parents.select("batch_id", "k").distinct().join(several, "batch_id", "left_semi").join(kids, ["batch_id", "k"], "left_semi")


def overview_ids(drawings: DataFrame) -> DataFrame:
    """Lower-cased identifiers, and their stems, of the overview images of each batch."""
    low = F.transform(F.array("part_number", "drawing_number", "source_filename"), lambda c: F.lower(E.strip_id(c)))
    return (
        drawings.where(is_overview(F.col("assembly_role")))
        .select("batch_id", F.explode(low).alias("v")).where("v <> ''")
        .select("batch_id", F.explode(F.array(F.col("v"), E.stem(F.col("v")))).alias("v")).distinct()
    )


def overview_label(c: Column) -> Column:
    """Texts that name an overview image whatever the batch."""
    v = F.lower(E.strip_id(c))
    return v.contains("asm_temp_image") | v.contains("overview image") | v.startswith("image")


def overview_names(df: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (batch_id, columns) of ``df`` any column of which names an overview image, by label, identifier or stem.

    All forms of a row meet the identifiers in one join; the columns come back as ``_n0``, ``_n1``, ...
    """
    names = [f"_n{i}" for i in range(len(columns))]
    named = df.select("batch_id", *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]).distinct()
    label = reduce(or_, [overview_label(F.col(n)) for n in names])
    forms = F.array_distinct(F.flatten(F.array(*[F.array(F.lower(_S(n)), E.stem(F.lower(_S(n)))) for n in names])))
    known = named.where(~label).withColumn("v", F.explode_outer(forms)).join(ids, ["batch_id", "v"], "left_semi")
    return named.where(label).unionByName(known.select("batch_id", *names).distinct())


def without_overview(df: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Rows none of whose columns names an overview image."""
    return without_names(df, overview_names(df, ids, columns), columns)


def without_names(df: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are not among ``names`` (see ``overview_names``). Nulls are compared as values."""
    hits = names.withColumnRenamed("batch_id", "_nb")
    same = [F.col("batch_id") == F.col("_nb")] + [F.col(c).eqNullSafe(F.col(f"_n{i}")) for i, c in enumerate(columns)]
    return df.join(hits, reduce(and_, same), "left_anti")


def filter_overview_roots(edges: DataFrame, drawings: DataFrame) -> DataFrame:
    """Drop the edges of parents that are overview images."""
    return without_overview(edges, overview_ids(drawings), ["parent_pn", "parent_dwg"])


def root_parents(drawings: DataFrame, bom: DataFrame, keep: Keep = lambda df, name: df, fix: Fix = _as_is) -> DataFrame:
    """J8 and J7 on the parents alone: those whose edges stay. ``keep`` may write the rows of batches with several parents.

    Only in such a batch can a parent be nested, so only their BOM rows are looked into. ``fix`` rewrites the identifiers
    before they are compared.
    """
    parents = filter_overview_roots(fix(edge_parents(drawings), ["parent_pn", "parent_dwg"]), drawings)
    several = _with_several(parents)
    some = parents.join(several, "batch_id", "left_semi").select("batch_id", "parent_record_id", "parent_pn")
    children = bom.select("batch_id", "parent_record_id", _S("part_number").alias("child_pn")).where("child_pn <> ''")
    nested = nested_parents(keep(fix(children, ["child_pn"]).join(some, ["batch_id", "parent_record_id"]), "children_of_several"))
    return keyed(parents, "parent_pn").join(nested, ["batch_id", "k"], "left_anti").drop("k")


def tree_edges(drawings: DataFrame, bom: DataFrame, keep: Keep = lambda df, name: df, fix: Fix = _as_is) -> DataFrame:
    """The edges the tree is built from. Parents are judged before they meet their BOM rows, so edges are made once.

    ``fix`` (N13) rewrites the texts of the edges; parents are judged by the rewritten ones, children found by the original ones.
    """
    return fix(edges_of(root_parents(drawings, bom, keep, fix), drawings, bom), ["child_pn", "child_dwg", "description"])


def orphans(drawings: DataFrame, edges: DataFrame) -> DataFrame:
    """PART drawings that are nobody's child."""
    kids = edges.select("batch_id", E.key(F.col("child_pn")).alias("k")).distinct()
    parts = keyed(drawings.where(E.key(F.col("assembly_role")) == "PART")).where("k <> ''")
    return parts.join(kids, ["batch_id", "k"], "left_anti").select("batch_id", "record_id", "part_number", "drawing_number")


def missing_children(edges: DataFrame) -> DataFrame:
    """Children without an uploaded drawing."""
    return edges.where("NOT found").select("batch_id", F.col("parent_pn").alias("needed_by"), F.col("child_pn").alias("part_number"),
                                           "description", "qty")


# ------------------------------------------------------------------ T1
TREE_COLUMNS = ["batch_id", "level", "part_number", "drawing_number", "description", "qty", "material",
                "parent_part_number", "root_part_number", "hierarchy_path"]


#: The columns of ``drawings`` that edges, tree and integrity need.
DRAWING_INPUT = ["batch_id", "pos", "record_id", "source_filename", "part_number", "drawing_number", "assembly_role", "title",
                 "material", "quantity"]


def _or(c: Column, default: str) -> Column:
    return F.when(c != "", c).otherwise(F.lit(default))


def _row(level: int, pn: Column, dwg: Column, desc: Column, qty: Column, mat: Column, parent: Column | None) -> list[Column]:
    return [
        F.col("batch_id"), F.lit(level).cast("bigint").alias("level"), pn.alias("part_number"),
        F.coalesce(dwg, _blank()).alias("drawing_number"), F.coalesce(desc, _blank()).alias("description"), qty.alias("qty"),
        F.coalesce(mat, _blank()).alias("material"), (_blank() if parent is None else parent).alias("parent_part_number"),
        (pn if parent is None else parent).alias("root_part_number"),
        (pn if parent is None else F.concat_ws(" > ", parent, pn)).alias("hierarchy_path"),
    ]


def _identifier_facts(drawings: DataFrame, bom: DataFrame, roots: DataFrame, edges: DataFrame, ids: DataFrame, keep: Keep) -> DataFrame:
    """All that the tree needs to know of an identifier, one row per (batch_id, k), from one aggregation.

    ``i`` is its last drawing, ``d`` its first one, ``first_ord`` that drawing's place and ``n_drawn`` their number; ``f`` the first
    BOM row that names it, over the assemblies of the batch in order; ``is_kid``, ``is_root`` and ``is_image`` tell whether it is a
    child, a root or an overview image. Every table contributes tagged rows, so nothing is joined or anti-joined per property.
    ``keep`` may write the BOM rows with their assemblies, so that the shuffles of this join are gone when the next one begins.
    """
    # each struct begins with its place, so that first and last are plain minima and maxima and the place travels once
    drawn = _keyed(drawings).select("batch_id", "k", F.struct(
        "pos", "record_id", F.col("title").alias("i_title"), F.col("material").alias("i_material"), F.col("drawing_number").alias("i_dwg")).alias("i"), F.struct(
        "pos", "record_id", _K("part_number").alias("pn"), _K("drawing_number").alias("dwg"), _K("quantity").alias("quantity"),
        _K("material").alias("mat")).alias("d"),
        overview_label(F.col("part_number")).alias("is_image"))
    asm = without_overview(drawings.where(is_assembly(F.col("assembly_role")) & (E.key_kept(F.col("part_number")) != "")), ids, ["part_number"])
    asm = asm.select("batch_id", F.col("record_id").alias("parent_record_id"), F.col("pos").alias("asm_pos"), _K("part_number").alias("parent"))
    items = _keyed(bom).where("k <> ''").join(asm, ["batch_id", "parent_record_id"]).select(
        "batch_id", "k", F.struct(
            "asm_pos", "parent_record_id", F.col("pos").alias("item_pos"), "parent", _K("part_number").alias("item_pn"), _K("qty").alias("item_qty"), _K("description").alias("item_desc")).alias("f"))
    items = keep(items, "assembly_items")
    kids = _keyed(edges, "child_pn").select("batch_id", "k", F.lit(True).alias("is_kid"))
    tops = _keyed(roots, "parent_pn").select("batch_id", "k", F.lit(True).alias("is_root"))
    images = ids.select("batch_id", F.upper("v").alias("k"), F.lit(True).alias("is_image"))
    # identifiers with a suffix are images by their stem too; hardly any has one
    k = F.col("k")
    suffixed = _keyed(drawings).where(k.contains(".")).select("batch_id", "k", F.lower(E.stem(k)).alias("v"))
    suffixed = suffixed.join(ids, ["batch_id", "v"], "left_semi").select("batch_id", "k", F.lit(True).alias("is_image"))
    rows = drawn
    for part in (items, kids, tops, images, suffixed):
        rows = rows.unionByName(part, allowMissingColumns=True)
    flag = lambda c: F.coalesce(F.max(c), F.lit(False)).alias(c)
    facts = rows.where("k <> ''").groupBy("batch_id", "k").agg(
        F.max("i").alias("i"), F.min("d").alias("d"), F.count("d").alias("n_drawn"), F.min("f").alias("f"),
        flag("is_kid"), flag("is_root"), flag("is_image"))
    return facts.select(
        "batch_id", "k", F.col("i").dropFields("pos", "record_id").alias("i"), F.col("d").dropFields("pos", "record_id").alias("d"),
        F.when(F.col("d").isNotNull(), F.struct("d.pos", "d.record_id")).alias("first_ord"), "n_drawn",
        F.col("f").dropFields("asm_pos", "parent_record_id", "item_pos").alias("f"), "is_kid", "is_root", "is_image")


def product_tree(
    drawings: DataFrame, bom: DataFrame, roots: DataFrame | None, edges: DataFrame, keep: Keep = lambda df, name: df,
) -> DataFrame:
    """The flat two-level tree of every batch.

    ``keep(df, name)`` writes the intermediate tables that several branches
    read, so that each is computed once (``store.materialise``); without it
    every branch plans and computes them anew, which suits only a few rows.

    ``roots`` is (batch_id, root_pos, parent_pn, parent_dwg), one row per root
    assembly, and edges of other parents do not count; None takes the parents of
    ``edges``, so that no edge has to meet its root. The tree is the union of roots and
    their children, uploaded drawings outside them (under the parent their BOM
    row names, or stand-alone), and purchased parts without a drawing.

    One aggregation gathers the facts of every identifier. Roots and children meet them in one join; a drawing that stands
    alone is told by them, and drawings are read again only for identifiers that several of them share.
    """
    ids = keep(overview_ids(drawings), "overview_ids")
    parent = ["parent_pn", "parent_dwg"]
    given = roots is not None
    tops = keep(roots if given else roots_of(edges), "roots")
    # few parents are images: what is dropped is written, and small enough to be sent to the edges
    images = keep(overview_names(tops, ids, parent), "overview_roots")
    roots = without_names(tops, images, parent)
    if given:
        edges = edges.join(roots.select("batch_id", *parent).distinct(), ["batch_id", *parent], "left_semi")
    else:
        edges = without_names(edges, images, parent).where("batch_id IS NOT NULL AND parent_pn IS NOT NULL AND parent_dwg IS NOT NULL")
    facts = keep(_identifier_facts(drawings, bom, roots, edges, ids, keep), "facts")
    free = "NOT is_image AND NOT is_kid AND NOT is_root"  # neither child nor root nor image
    alone = f"({free} AND f IS NULL)"

    # 1 roots and children: one row each
    tops = _keyed(roots, "parent_pn").select(
        F.lit(0).alias("kind"), "batch_id", "k", F.col("parent_pn").alias("pn"), F.col("parent_dwg").alias("dwg"))
    kids = _keyed(edges, "child_pn").select(
        F.lit(1).alias("kind"), "batch_id", "k", F.col("child_pn").alias("pn"), F.col("child_dwg").alias("dwg"),
        F.col("description").alias("desc"), _K("qty").alias("quantity"), F.col("parent_pn").alias("parent"))
    rows = tops.unionByName(kids, allowMissingColumns=True)
    rows = rows.join(facts.where("(is_kid OR is_root) AND i IS NOT NULL").select("batch_id", "k", "i"), ["batch_id", "k"], "left")
    kind, pn, dwg, last = F.col("kind"), F.col("pn"), F.col("dwg"), F.col("i")
    known, said = E.strip_kept(last["i_material"]), _K("desc")
    parent, name = _or(F.col("parent"), "—"), _or(pn, "—")
    placed = rows.select(
        "batch_id", kind.cast("bigint").alias("level"), name.alias("part_number"),
        F.coalesce(F.when((kind == 1) | (dwg != ""), dwg).otherwise(last["i_dwg"]), _blank()).alias("drawing_number"),
        F.coalesce(F.when(kind == 1, F.when(said != "", said).otherwise(E.strip_kept(last["i_title"]))), _blank()).alias("description"),
        F.when(kind == 0, "1").otherwise(_or(F.col("quantity"), "1")).alias("qty"),
        F.coalesce(F.when(kind == 0, last["i_material"]).otherwise(
            F.when(known != "", known).otherwise(material_phrases(F.col("desc")))), _blank()).alias("material"),
        F.when(kind == 1, parent).otherwise("").alias("parent_part_number"),
        F.when(kind == 1, parent).otherwise(name).alias("root_part_number"),
        F.when(kind == 1, F.concat_ws(" > ", parent, name)).otherwise(name).alias("hierarchy_path"))

    # stand-alone drawings: one row each
    shared = keep(facts.where(alone).where("n_drawn > 1").select("batch_id", "k"), "shared_identifiers")
    own = _keyed(drawings).join(shared, ["batch_id", "k"], "left_semi").select(
        "batch_id", _K("part_number").alias("pn"), _K("drawing_number").alias("dwg"), _K("quantity").alias("quantity"), _K("material").alias("mat"))
    own = facts.where(alone).where("n_drawn = 1").select("batch_id", "d.pn", "d.dwg", "d.quantity", "d.mat").unionByName(own)
    placed = placed.unionByName(own.select(*_row(0, pn, dwg, _blank(), _or(F.col("quantity"), "1"), F.col("mat"), None)))

    # 2 under a known parent: the first drawing of an identifier
    under = facts.where(free).where("d IS NOT NULL AND f IS NOT NULL").select("batch_id", "first_ord", "d.*", "f.*")
    level1 = under.select(*_row(
        1, F.col("pn"), F.col("dwg"), F.when(F.col("item_desc") != "", F.col("item_desc")),
        F.when(F.col("item_qty") != "", F.col("item_qty")).otherwise(_or(F.col("quantity"), "1")), F.col("mat"), F.col("parent")))
    # a parent is added before its first such child unless it is a root or already stands alone
    first_child = under.groupBy("batch_id", E.key_kept(F.col("parent")).alias("k")).agg(
        F.min_by("parent", "first_ord").alias("parent"), F.min("first_ord").alias("child_ord"))
    added = (
        first_child.join(facts.select("batch_id", "k", "i", "is_root", "first_ord", F.expr(alone).alias("alone")), ["batch_id", "k"])
        .where("NOT is_root AND (NOT alone OR first_ord > child_ord)")
        .select(*_row(0, F.col("parent"), E.strip_kept(last["i_dwg"]), _blank(), F.lit("1"), E.strip_kept(last["i_material"]), None))
    )

    # 3 purchased parts: BOM rows nothing else shows; batches without roots have none
    blank = (F.col("item_desc") == "") & (F.col("item_qty") == "")
    bought = (
        facts.where("f IS NOT NULL AND NOT is_kid AND NOT is_root AND (d IS NULL OR is_image)").select("batch_id", "f.*")
        .join(roots.select("batch_id").distinct(), "batch_id", "left_semi")
        .select(*_row(
            1, F.col("item_pn"), _blank(),
            F.when(blank, "[OCR_UNREADABLE]").otherwise(_or(F.col("item_desc"), "[PURCHASED PART / NO DRAWING]")),
            _or(F.col("item_qty"), "—"), _blank(), F.col("parent")))
    )
    out = placed
    for part in (level1, added, bought):
        out = out.unionByName(part)
    return out.select(*TREE_COLUMNS)


def roots_of(edges: DataFrame) -> DataFrame:
    return edges.select("batch_id", "root_pos", "parent_pn", "parent_dwg").distinct()


# ------------------------------------------------------------------ J6
def main_assembly(drawings: DataFrame, bom: DataFrame, edges: DataFrame) -> DataFrame:
    """The assembly of each batch whose BOM explains its overview image: the first root's drawing, else the first with a BOM."""
    root = edges.groupBy("batch_id").agg(F.upper(F.min_by("parent_pn", F.struct("root_pos", "parent_record_id"))).alias("root_pn"))
    has_bom = bom.select("batch_id", F.col("parent_record_id").alias("record_id")).distinct().withColumn("_has", F.lit(True))
    cand = (
        keyed(drawings.where(is_assembly(F.col("assembly_role")))).join(root, "batch_id", "left")
        .join(has_bom, ["batch_id", "record_id"], "left")
        .withColumn("_rank", F.when(F.col("k") == F.col("root_pn"), 0).when(F.col("_has"), 1))
        .where("_rank IS NOT NULL")
    )
    return cand.groupBy("batch_id").agg(F.min_by("record_id", F.struct("_rank", "pos", "record_id")).alias("parent_record_id"))


def link_overview_items(
    balloons: DataFrame, drawings: DataFrame, bom: DataFrame, edges: DataFrame, keep: Keep = lambda df, name: df,
) -> DataFrame:
    """Overview balloons linked to the main assembly's BOM by item number, else part number, then to drawings.

    ``keep`` may write the rows of the main assemblies and the linked balloons, before these meet the drawings.
    """
    rows = keep(bom.join(main_assembly(drawings, bom, edges), ["batch_id", "parent_record_id"]).select(
        "batch_id", "item_no", "pos", "part_number", "qty", "description"), "main_rows")
    first = lambda key_col, tag: rows.withColumn(tag, key_col).where(F.col(tag) != "").groupBy("batch_id", tag).agg(
        F.min_by(F.struct("part_number", "qty", "description"), "pos").alias(f"m_{tag}"))
    by_item = first(_S("item_no"), "item")
    by_pn = first(E.key(F.col("part_number")), "pnk")
    images = drawings.where(is_overview(F.col("assembly_role"))).select(
        "batch_id", F.col("record_id").alias("parent_record_id"), F.col("source_filename").alias("image_file"), F.col("part_number").alias("image_pn"))
    df = balloons.join(images, ["batch_id", "parent_record_id"]).withColumns({"item": _S("item_no"), "pnk": E.key(F.col("part_number"))})
    df = df.join(by_item, ["batch_id", "item"], "left").join(by_pn, ["batch_id", "pnk"], "left")
    m = F.coalesce("m_item", "m_pnk")
    method = F.when(F.col("m_item").isNotNull(), "item_no").when(F.col("m_pnk").isNotNull(), "part_number").otherwise("")
    df = keep(df.withColumns({"m": m, "method": method}).withColumn("k", E.key(F.col("m")["part_number"])).drop(
        "item", "pnk", "m_item", "m_pnk", "parent_record_id"), "linked_balloons")
    df = df.join(drawing_index(drawings), ["batch_id", "k"], "left")
    mpn = F.coalesce(F.col("m")["part_number"], _blank())
    found = F.col("i_title").isNotNull() | F.col("i_dwg").isNotNull()
    shown = F.when((mpn != "") & ((_S("part_number") == "") | (F.col("method") == "item_no")), mpn).otherwise(_S("part_number"))
    return df.select(
        "batch_id", "image_file", "image_pn", "item_no", shown.alias("part_number"), "description", "qty",
        F.when(found, mpn).otherwise("").alias("linked_pn"), F.coalesce("i_dwg", _blank()).alias("linked_dwg"),
        F.coalesce(F.col("m")["qty"], _blank()).alias("bom_qty"), F.coalesce("i_material", _blank()).alias("linked_material"),
        F.coalesce(F.col("m")["description"], _blank()).alias("bom_description"), "method", found.alias("uploaded"))


# ------------------------------------------------------------------ V14, V15
#: Step lists that may hold marking instructions.
MARKING_STEPS = ["machining_processes", "additional_processes", "inspection_processes", "final_approval"]


def marking_xref(drawings: DataFrame, edges: DataFrame, steps: list[str] | None = None) -> DataFrame:
    """V14 MARKING_PN_CROSS_REF: a marking instruction names neither the drawing's own number nor its parent's.

    Scans the notes and the step lists ``steps``, by default those of ``MARKING_STEPS`` that ``drawings`` has. A null list
    or step has no text; a text that names one number twice gives two rows.
    """
    if steps is None:
        steps = [c for c in MARKING_STEPS if c in drawings.columns]
    texts = [F.array(F.struct(F.lit("notes").alias("source"), _S("notes").alias("text")))]
    for c in steps:
        found = F.transform(c, lambda s: F.struct(
            F.coalesce(E.strip(s["step_no"]), _blank()).alias("source"),
            F.concat_ws(" ", *[F.coalesce(s[x], _blank()) for x in ("name_en", "name_he", "details")]).alias("text")))
        texts.append(F.coalesce(found, F.array().cast("array<struct<source:string,text:string>>")))
    marks = lambda t: F.concat(*[F.regexp_extract_all(t, F.lit(p), 1) for p in R.MARK_PN])
    df = keyed(drawings).where("k <> ''").select(
        "batch_id", "record_id", "k", F.explode(F.concat(*texts)).alias("t"))
    df = df.where(F.upper("t.text").contains("MARK")).select(
        "batch_id", "record_id", "k", F.col("t.source").alias("source"), F.explode(marks(F.col("t.text"))).alias("raw"))
    df = df.withColumn("value", F.rtrim(F.upper(F.trim("raw")), F.lit(".,;:"))).where((F.length("value") >= 5) & (F.col("value") != F.col("k")))
    parent = edges.select("batch_id", E.key(F.col("child_pn")).alias("k"), E.key(F.col("parent_pn")).alias("parent"), "root_pos", "pos").where(
        "k <> '' AND parent <> ''").groupBy("batch_id", "k").agg(F.max_by("parent", F.struct("root_pos", "pos")).alias("parent"))
    return df.join(parent, ["batch_id", "k"], "left").where("parent IS NULL OR parent <> value").select(
        "batch_id", "record_id", F.lit("MARKING_PN_CROSS_REF").alias("type"), F.lit("INFO").alias("severity"), "source", "value")


def tree_integrity(drawings: DataFrame, bom: DataFrame, edges: DataFrame, batches: DataFrame, keep: Keep = lambda df, name: df) -> DataFrame:
    """Exactly one root; BOM within the tree; equal quantities; equal prefixed part and drawing numbers.

    ``batches`` is (batch_id), every batch to check. Batches without exactly one
    root report only that. One row per batch holds its state, one aggregation per
    identifier what the tree and the BOM say of it; ``keep`` may write both.
    """
    n_roots = edges.groupBy("batch_id").agg(F.count_distinct(F.struct("root_pos", "parent_record_id", "parent_pn")).alias("n"))
    state = batches.join(n_roots, "batch_id", "left").join(main_assembly(drawings, bom, edges), "batch_id", "left")
    state = keep(state.select("batch_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "parent_record_id"), "states")
    issue = lambda t, sev, value: F.struct(F.lit(t).alias("type"), F.lit(sev).alias("severity"), value.alias("value"))
    found = lambda df, f: df.select("batch_id", f.alias("f")).select("batch_id", "f.*")
    out = found(state.where("n <> 1"), issue("TREE_STRUCTURE", "CRITICAL", F.col("n").cast("string")))
    out = out.unionByName(found(state.where("n = 1 AND parent_record_id IS NULL"), issue("TREE_BOM_SOURCE", "HIGH", _blank())))

    main = state.where("n = 1 AND parent_record_id IS NOT NULL").select("batch_id", "parent_record_id")
    kids = keyed(edges, "child_pn").where("k <> ''").join(main.select("batch_id"), "batch_id", "left_semi").select(
        "batch_id", "k", _S("qty").alias("tree_qty"), E.key(F.col("child_dwg")).alias("dwg"))
    rows = keyed(bom).where("k <> ''").join(main, ["batch_id", "parent_record_id"]).select(
        "batch_id", "k", F.lit(True).alias("in_bom"), _S("qty").alias("bom_qty"), "pos")
    # the last BOM row of an identifier gives its quantity
    both = rows.unionByName(kids.select("batch_id", "k"), allowMissingColumns=True).groupBy("batch_id", "k").agg(
        F.max("in_bom").alias("in_bom"), F.count_if(F.col("in_bom").isNull()).alias("n_kids"), F.max_by("bom_qty", "pos").alias("bom_qty"))
    both = keep(both.where("in_bom"), "bom_items")
    out = out.unionByName(found(both.where("n_kids = 0"), issue("MISSING_BOM_ITEMS", "CRITICAL", F.col("k"))))
    odd = (F.col("dwg") != "") & (F.col("k") != F.col("dwg")) & F.col("k").startswith("BP") & F.col("dwg").startswith("BP")
    out = out.unionByName(found(kids.where(odd), issue("PN_DWG_MISMATCH", "HIGH", F.concat("k", F.lit(" / "), "dwg"))))
    diff = kids.where("tree_qty <> ''").join(both.where("n_kids > 0 AND bom_qty <> ''"), ["batch_id", "k"]).where("tree_qty <> bom_qty")
    return out.unionByName(found(diff, issue(
        "QTY_MISMATCH", "CRITICAL", F.concat("k", F.lit(": tree="), "tree_qty", F.lit(", bom="), "bom_qty"))))
