"""Integrity rules over the parts and elements of document packages, each a query over the same parsed table.

``parts``: doc_id, part, content. ``elements``: schema.ELEMENTS, one row an XML element, ``pos`` its order in the part,
``ancestors`` the local names of those around it, ``attrs`` keyed ``ns-prefix:name`` (r:, w:, w14:, xml: ...) or plain.
Each rule returns violations (doc_id, rule, part, pos, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.staging import staged

VIOLATION = ["doc_id", "rule", "part", "pos", "detail"]

#: Elements whose identifier must be unique, the attribute's local name, and where.
UNIQUE_IDS = {
    "comment": ("id", "file"),
    "commentrangestart": ("id", "file"),
    "commentrangeend": ("id", "file"),
    "bookmarkstart": ("id", "file"),
    "bookmarkend": ("id", "file"),
    "sldid": ("id", "file"),
    "sldmasterid": ("id", "global"),
    "sldlayoutid": ("id", "global"),
    "cm": ("authorid", "file"),
    "sheet": ("sheetid", "file"),
    "definedname": ("id", "file"),
    "cxnsp": ("id", "file"),
    "sp": ("id", "file"),
    "pic": ("id", "file"),
    "grpsp": ("id", "file"),
}
ID_FREE_CONTAINERS = ("sectionlst",)
#: Roots of parts that must be declared, and media that need a default content type.
DECLARED_ROOTS = ("sld", "sldLayout", "sldMaster", "presentation", "document", "workbook", "worksheet", "theme")
MEDIA = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "wmf", "emf")
EDGE_SPACE = r"^[ \t\n\r]|[ \t\n\r]$"


def _file(part: str = "part") -> Column:
    return F.element_at(F.split(part, "/"), -1)


def _violations(rows: DataFrame, rule: str, detail: Column, part: str = "part", pos: str | None = "pos") -> DataFrame:
    at = F.col(pos).cast("bigint") if pos else F.lit(None).cast("bigint")
    return rows.select("doc_id", F.lit(rule).alias("rule"), F.col(part).alias("part"), at.alias("pos"), detail.alias("detail"))


def duplicates(rows: DataFrame, keys: list[str], order: list[str], spark: SparkSession | None = None) -> DataFrame:
    """Rows of each key that come after its first in ``order``, with ``first_<order>`` of the first; null keys have none.

    The firsts are a pre-aggregated minimum that the rows join, so no group meets in one sort. With ``spark`` they are
    staged: both sides of the join are then plain shuffles, which adaptive execution splits where a key is hot.
    """
    firsts = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first_row"), F.count("*").alias("first_n")).where("first_n > 1").select(*keys, "first_row")
    if spark is not None:
        firsts = staged(spark, firsts, "firsts")
    later = rows.join(firsts, keys).where(F.struct(*order) != F.col("first_row"))
    return later.select(*rows.columns, *[F.col(f"first_row.{c}").alias(f"first_{c}") for c in order])


def not_well_formed(parsed: DataFrame) -> DataFrame:
    """parsed: doc_id, part, error (NULL where the part could be read)."""
    return _violations(parsed.where("error is not null"), "well_formed", F.col("error"), pos=None)


def undeclared_prefixes(roots: DataFrame) -> DataFrame:
    """roots: doc_id, part, ignorable (prefixes, blank-separated), declared (array of prefixes)."""
    gone = F.array_except(F.filter(F.split(F.coalesce("ignorable", F.lit("")), r"\s+"), lambda p: p != ""), F.coalesce("declared", F.array().cast("array<string>")))
    return _violations(roots.select("doc_id", "part", F.explode(gone).alias("prefix")), "namespaces", F.col("prefix"), pos=None)


def duplicate_ids(elements: DataFrame) -> DataFrame:
    """A file-wide id is taken for each part and tag, a global one over all parts and tags; repeats name the first."""
    names = F.create_map(*[F.lit(x) for t, (a, _) in UNIQUE_IDS.items() for x in (t, a)])
    scopes = F.create_map(*[F.lit(x) for t, (_, s) in UNIQUE_IDS.items() for x in (t, s)])
    low = F.lower("tag")
    around = F.transform("ancestors", F.lower)
    known = elements.where(low.isin(*UNIQUE_IDS) & ~F.arrays_overlap(around, F.array(*map(F.lit, [*ID_FREE_CONTAINERS, "alternatecontent"]))))
    name = names[low]
    entries = F.filter(F.map_entries("attrs"), lambda e: F.lower(F.element_at(F.split(e["key"], ":"), -1)) == name)
    ids = known.select("doc_id", "part", "pos", low.alias("tag"), scopes[low].alias("scope"), F.get(entries, F.lit(0))["value"].alias("id")).where("id is not null")
    inside = duplicates(ids.where("scope = 'file'"), ["doc_id", "part", "tag", "id"], ["pos"])
    across = duplicates(ids.where("scope = 'global'"), ["doc_id", "id"], ["part", "pos"])
    said = lambda *more: F.concat_ws(" ", "tag", "id", F.lit("first at"), *more)
    return _violations(inside, "unique_ids", said(F.col("first_pos").cast("string"))).unionByName(
        _violations(across, "unique_ids", said("first_part", F.col("first_pos").cast("string")))
    )


def relationships(elements: DataFrame) -> DataFrame:
    """(doc_id, rels_part, pos, id, type, target, source_part): source_part is the part that the .rels file serves."""
    rels = elements.where((F.col("tag") == "Relationship") & F.endswith(F.col("part"), F.lit(".rels")))
    owner = F.regexp_replace(F.regexp_replace("part", r"(^|/)_rels/([^/]*)$", "$1$2"), r"\.rels$", "")
    return rels.select("doc_id", F.col("part").alias("rels_part"), "pos", F.col("attrs")["Id"].alias("id"), F.col("attrs")["Type"].alias("type"), F.col("attrs")["Target"].alias("target"), owner.alias("source_part"))


def resolved_target() -> Column:
    """The part that a relationship's target names: from the package root with a leading slash or in the root's own
    relationships, else from the folder of the part served; ``.`` and ``..`` are worked out."""
    base = F.when(F.startswith("target", F.lit("/")) | (F.col("rels_part") == "_rels/.rels"), F.lit("")).otherwise(F.regexp_replace("rels_part", "(^|/)_rels/[^/]*$", "$1"))
    steps = F.filter(F.split(F.concat(base, F.col("target")), "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.array_join(walked, "/")


def broken_references(parts: DataFrame, elements: DataFrame) -> DataFrame:
    """Targets inside the package that name no part, and parts that no relationship names."""
    local = relationships(elements).where("target is not null and target != ''").where(~F.startswith("target", F.lit("http")) & ~F.startswith("target", F.lit("mailto:")))
    local = local.withColumn("named", resolved_target())
    files = parts.select("doc_id", F.col("part").alias("named"))
    broken = local.join(files, ["doc_id", "named"], "left_anti")
    has_rels = local.select("doc_id").unionByName(parts.where(F.endswith("part", F.lit(".rels"))).select("doc_id")).distinct()
    named = local.select("doc_id", "named").distinct()
    loose = (
        files.where((F.col("named") != "[Content_Types].xml") & ~F.endswith("named", F.lit(".rels")))
        .join(has_rels, "doc_id", "left_semi")
        .join(named, ["doc_id", "named"], "left_anti")
    )
    return _violations(broken, "file_references", F.concat(F.lit("broken "), "target"), "rels_part").unionByName(
        _violations(loose, "file_references", F.lit("unreferenced"), "named", None)
    )


def undeclared_content(parts: DataFrame, elements: DataFrame) -> DataFrame:
    """Parts with a root that must be declared and is not, and media whose extension has no default."""
    types = elements.where("part = '[Content_Types].xml'")
    overrides = types.where("tag = 'Override'").select("doc_id", F.regexp_replace(F.col("attrs")["PartName"], "^/+", "").alias("part")).distinct()
    defaults = types.where("tag = 'Default'").select("doc_id", F.lower(F.col("attrs")["Extension"]).alias("ext")).distinct()
    skipped = F.col("part").rlike(r"\.rels|\[Content_Types\]|docProps/|_rels/")
    roots = elements.where("parent_id is null").where(F.col("tag").isin(*DECLARED_ROOTS) & ~skipped)
    ext = F.lower(F.regexp_extract("part", r"\.([^./]+)$", 1))
    media = parts.select("doc_id", "part", ext.alias("ext")).where(F.col("ext").isin(*MEDIA) & ~F.col("part").rlike("(^|/)(_rels|docProps)/"))
    missing = parts.select("doc_id").distinct().join(types.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("part", F.lit("[Content_Types].xml"))
    return (
        _violations(roots.join(overrides, ["doc_id", "part"], "left_anti"), "content_types", F.concat(F.lit("undeclared root "), "tag"))
        .unionByName(_violations(media.join(defaults, ["doc_id", "ext"], "left_anti"), "content_types", F.concat(F.lit("undeclared extension "), "ext"), pos=None))
        .unionByName(_violations(missing, "content_types", F.lit("no content types"), pos=None))
    )


def relationship_ids(elements: DataFrame, listed: int = 5) -> DataFrame:
    """r:id, r:embed and r:link that no relationship of the part has, with some that exist; and repeated Ids.

    Only parts that have a .rels file are looked at.
    """
    rels = relationships(elements)
    known = rels.where("id is not null and id != ''").select("doc_id", F.col("source_part").alias("part"), "id").distinct()
    valid = known.groupBy("doc_id", "part").agg(F.slice(F.array_sort(F.collect_set("id")), 1, listed).alias("valid"))
    served = elements.where(F.endswith("part", F.lit(".rels"))).select("doc_id", F.regexp_replace(F.regexp_replace("part", r"(^|/)_rels/([^/]*)$", "$1$2"), r"\.rels$", "").alias("part")).distinct()
    attrs = F.array(*[F.struct(F.lit(a).alias("name"), F.col("attrs")[f"r:{a}"].alias("id")) for a in ("id", "embed", "link")])
    uses = elements.where(~F.endswith("part", F.lit(".rels"))).select("doc_id", "part", "pos", "tag", F.explode(attrs).alias("a")).select("doc_id", "part", "pos", "tag", "a.name", "a.id").where("id is not null and id != ''")
    lost = uses.join(served, ["doc_id", "part"], "left_semi").join(known, ["doc_id", "part", "id"], "left_anti").join(valid, ["doc_id", "part"], "left")
    twice = duplicates(rels.where("id is not null and id != ''"), ["doc_id", "rels_part", "id"], ["pos"])
    detail = F.concat_ws(" ", "tag", F.concat(F.lit("r:"), "name"), "id", F.concat(F.lit("valid: "), F.array_join(F.coalesce("valid", F.array().cast("array<string>")), ",")))
    return _violations(lost, "relationship_ids", detail).unionByName(_violations(twice, "relationship_ids", F.concat(F.lit("repeated "), "id"), "rels_part"))


def lost_whitespace(elements: DataFrame) -> DataFrame:
    """Text elements with white space at an edge that do not preserve it."""
    bad = elements.where((_file() == "document.xml") & (F.col("tag") == "t") & (F.col("ns") == "w") & F.col("text").rlike(EDGE_SPACE))
    return _violations(bad.where(~F.coalesce(F.col("attrs")["xml:space"] == "preserve", F.lit(False))), "whitespace", F.substring("text", 1, 50))


def deletions(elements: DataFrame) -> DataFrame:
    """Plain text and field instructions inside deletions."""
    inside = elements.where((_file() == "document.xml") & (F.col("ns") == "w") & F.array_contains("ancestors", "del"))
    bad = inside.where("(tag = 't' and coalesce(text, '') != '') or tag = 'instrText'")
    return _violations(bad, "deletions", F.concat_ws(" ", "tag", F.substring(F.coalesce("text", F.lit("")), 1, 50)))


def insertions(elements: DataFrame) -> DataFrame:
    """Deleted text inside insertions, unless a deletion is around it."""
    bad = elements.where((_file() == "document.xml") & (F.col("ns") == "w") & (F.col("tag") == "delText") & F.array_contains("ancestors", "ins") & ~F.array_contains("ancestors", "del"))
    return _violations(bad, "insertions", F.substring(F.coalesce("text", F.lit("")), 1, 50))


def id_constraints(elements: DataFrame) -> DataFrame:
    """w14:paraId under 0x80000000; w16cid:durableId under 0x7FFFFFFF, decimal in numbering.xml and hexadecimal elsewhere."""
    from factloom.functions.text import bounded_id

    para, durable = F.col("attrs")["w14:paraId"], F.col("attrs")["w16cid:durableId"]
    numbering = _file() == "numbering.xml"
    rows = elements.select(
        "doc_id", "part", "pos",
        F.when(para.isNotNull() & ~F.coalesce(bounded_id(para, 16, 0x80000000), F.lit(False)), F.concat(F.lit("paraId "), para)).alias("p"),
        F.when(
            durable.isNotNull() & ~F.coalesce(F.when(numbering, bounded_id(durable, 10, 0x7FFFFFFF)).otherwise(bounded_id(durable, 16, 0x7FFFFFFF)), F.lit(False)),
            F.concat(F.lit("durableId "), durable),
        ).alias("d"),
    )
    found = rows.select("doc_id", "part", "pos", F.explode(F.array_compact(F.array("p", "d"))).alias("detail"))
    return _violations(found, "id_constraints", F.col("detail"))


def comment_markers(elements: DataFrame) -> DataFrame:
    """Comment ranges that are not closed or not opened, and markers of comments that do not exist, in numeric order."""
    kinds = {"commentRangeStart": "start", "commentRangeEnd": "end", "commentReference": "reference", "comment": "comment"}
    where = ((_file() == "document.xml") & (F.col("tag") != "comment")) | ((_file() == "comments.xml") & (F.col("tag") == "comment"))
    marks = elements.where(where & F.col("tag").isin(*kinds) & (F.col("ns") == "w")).select("doc_id", "tag", F.col("attrs")["w:id"].alias("id"))
    seen = marks.groupBy("doc_id", "id").agg(*[F.count_if(F.col("tag") == t).alias(k) for t, k in kinds.items()])
    has_comments = elements.where(_file() == "comments.xml").select("doc_id", F.lit(True).alias("has")).distinct()
    told = F.array_compact(F.array(
        F.when((F.col("end") > 0) & (F.col("start") == 0), F.lit("end without start")),
        F.when((F.col("start") > 0) & (F.col("end") == 0), F.lit("start without end")),
        F.when(F.col("has") & (F.col("comment") == 0) & (F.coalesce("id", F.lit("")) != ""), F.lit("no such comment")),
    ))
    rows = seen.join(has_comments, "doc_id", "left").select("doc_id", F.lit("word/document.xml").alias("part"), F.coalesce(F.col("id").try_cast("bigint"), F.lit(0)).alias("pos"), "id", F.explode(told).alias("what"))
    return _violations(rows, "comment_markers", F.concat_ws(" ", "what", "id"))


def new_errors(current: DataFrame, baseline: DataFrame, keys: list[str], shown: int = 3, length: int = 250) -> DataFrame:
    """Errors that the baseline does not have: (keys, total, first): the first few of each part by text, cut."""
    fresh = current.select(*keys, "error").distinct().join(baseline.select(*keys, "error").distinct(), [*keys, "error"], "left_anti")
    return fresh.groupBy(*keys).agg(F.count("*").alias("total"), F.transform(F.slice(F.array_sort(F.collect_set("error")), 1, shown), lambda e: F.substring(e, 1, length)).alias("first"))


#: The schema of a part, by the first rule that applies to its file name or folder.
SCHEMAS = (
    (r"\[Content_Types\]\.xml$", "opc-contentTypes.xsd"),
    (r"(^|/)app\.xml$", "shared-documentPropertiesExtended.xsd"),
    (r"(^|/)core\.xml$", "opc-coreProperties.xsd"),
    (r"(^|/)custom\.xml$", "shared-documentPropertiesCustom.xsd"),
    (r"\.rels$", "opc-relationships.xsd"),
    (r"(^|/)people\.xml$", "wml-2012.xsd"),
    (r"(^|/)commentsIds\.xml$", "wml-cid-2016.xsd"),
    (r"(^|/)commentsExtensible\.xml$", "wml-cex-2018.xsd"),
    (r"(^|/)commentsExtended\.xml$", "wml-2012.xsd"),
    (r"(^|/)charts/chart", "dml-chart.xsd"),
    (r"(^|/)theme/theme", "dml-main.xsd"),
    (r"(^|/)drawings/drawing", "dml-main.xsd"),
    (r"^word/", "wml.xsd"),
    (r"^ppt/", "pml.xsd"),
    (r"^xl/", "sml.xsd"),
)


def schema_of(part: str = "part") -> Column:
    out = F.lit(None).cast("string")
    for regex, name in reversed(SCHEMAS):
        out = F.when(F.col(part).rlike(regex), F.lit(name)).otherwise(out)
    return out


def strip_template_tags(value: Column) -> Column:
    """The text without {{placeholders}}."""
    return F.regexp_replace(value, r"\{\{[^}]*\}\}", "")


def schema_errors(parts: DataFrame, schemas: str) -> DataFrame:
    """(doc_id, part, error): parts that their schema in the folder ``schemas`` refuses, placeholders left out, in one pass.

    Parts without a schema, or whose schema file the folder lacks, are not looked at. The folder must be there on all
    machines. ``new_errors`` against those of an original package tells which a change has brought.
    """
    spark = parts.sparkSession
    there = {n for n in dict.fromkeys(n for _, n in SCHEMAS) if _exists(spark, f"{schemas.rstrip('/')}/{n}")}
    name = schema_of()
    text = strip_template_tags(F.col("content").cast("string"))
    refused = F.lit(None).cast("string")
    for n in sorted(there):
        read = F.from_xml(text, "refused string", {"rowValidationXSDPath": f"{schemas.rstrip('/')}/{n}", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "refused"})
        refused = F.when(name == n, read["refused"]).otherwise(refused)
    rows = parts.where(name.isin(*there) if there else F.lit(False)).select("doc_id", "part", name.alias("schema"), refused.alias("refused"))
    return rows.where("refused is not null").select("doc_id", "part", F.concat(F.lit("not valid by "), "schema").alias("error"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def schema_violations(parts: DataFrame, schemas: str, original: DataFrame | None = None) -> DataFrame:
    """Violations of the schema rule; with ``original`` (the parts before a change) only those that it did not have."""
    found = schema_errors(parts, schemas)
    if original is not None:
        found = new_errors(found, schema_errors(original, schemas), ["doc_id", "part"]).select("doc_id", "part", F.explode("first").alias("error"))
    return _violations(found, "schema", F.col("error"), pos=None)


def paragraph_counts(elements: DataFrame) -> DataFrame:
    return elements.where((F.col("part") == "word/document.xml") & (F.col("tag") == "p") & (F.col("ns") == "w")).groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


def compare_paragraph_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = (paragraph_counts(x).withColumnRenamed("paragraphs", n) for x, n in ((before, "before"), (after, "after")))
    zero = F.lit(0).cast("bigint")
    return a.join(b, "doc_id", "full").select("doc_id", F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after")).withColumn("diff", F.col("after") - F.col("before"))


def repair_whitespace(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, repairs a document): text elements with a blank or tab at an edge get xml:space=preserve."""
    bad = (F.col("tag") == "t") & F.col("text").rlike(r"^[ \t]|[ \t]$") & ~F.coalesce(F.col("attrs")["xml:space"] == "preserve", F.lit(False))
    bad = F.coalesce(bad, F.lit(False))
    rest = F.map_filter("attrs", lambda k, _: k != "xml:space")
    fixed = elements.withColumn("attrs", F.when(bad, F.map_concat(rest, F.create_map(F.lit("xml:space"), F.lit("preserve")))).otherwise(F.col("attrs")))
    return fixed, elements.groupBy("doc_id").agg(F.count_if(bad).alias("repairs"))


def repair_durable_ids(elements: DataFrame) -> DataFrame:
    """Ids that break the rule get a new one from a hash of their place, the same in every run."""
    from factloom.functions.text import bounded_id

    value = F.col("attrs")["w16cid:durableId"]
    numbering = _file() == "numbering.xml"
    good = F.coalesce(F.when(numbering, bounded_id(value, 10, 0x7FFFFFFF)).otherwise(bounded_id(value, 16, 0x7FFFFFFF)), F.lit(False))
    fresh = F.pmod(F.xxhash64("doc_id", "part", "pos"), F.lit(0x7FFFFFFE)) + 1
    new = F.when(numbering, fresh.cast("string")).otherwise(F.lpad(F.hex(fresh), 8, "0"))
    rest = F.map_filter("attrs", lambda k, _: k != "w16cid:durableId")
    return elements.withColumn("attrs", F.when(value.isNotNull() & ~good, F.map_concat(rest, F.create_map(F.lit("w16cid:durableId"), new))).otherwise(F.col("attrs")))


def validate_package(parts: DataFrame, elements: DataFrame, parsed: DataFrame, roots: DataFrame) -> DataFrame:
    """Violations of all rules; a package with a part that cannot be read reports only that."""
    broken = not_well_formed(parsed)
    sound = lambda rows: rows.join(broken.select("doc_id").distinct(), "doc_id", "left_anti")
    parts, elements, roots = sound(parts), sound(elements), sound(roots)
    out = broken
    for found in (
        undeclared_prefixes(roots), duplicate_ids(elements), broken_references(parts, elements), undeclared_content(parts, elements), lost_whitespace(elements),
        deletions(elements), insertions(elements), relationship_ids(elements), id_constraints(elements), comment_markers(elements),
    ):
        out = out.unionByName(found)
    return out
