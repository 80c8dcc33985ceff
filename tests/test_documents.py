"""Word packages, from bytes to facts and rules, and the API, CLI, store and streams over files."""

import json

import pytest

from factloom.api import Api
from factloom.cli import main
from factloom.operators import package
from factloom.plans.samples import SECTION, broken_packages, package as make, paragraph
from factloom.sources import docx, packages
from factloom.streaming import ingest


def _elements(spark, *bodies, **more):
    rows = [(f"d{n}", make(b, **more)) for n, b in enumerate(bodies)]
    return packages.elements(packages.unpack(spark.createDataFrame(rows, "doc_id string, content binary")))


def test_paragraphs_resolve_runs_and_styles(spark):
    body = paragraph(" Title ", "H1") + paragraph("plain", "Normal", '<w:sz w:val="21"/><w:i/>') + paragraph("", None) + paragraph("list", None, extra='<w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr>') + SECTION
    got = docx.paragraphs(spark, _elements(spark, body)).orderBy("index").collect()
    assert [r.id for r in got] == ["p-1", "p-2", "p-3", "p-4"] and got[0].text == "Title"
    p = got[0].properties
    assert (p.alignment, p.font_size_pt, p.bold, p.line_spacing_mode, p.line_spacing_value, p.font_family_ascii) == ("center", 16.0, True, "multiple", 1.5, "SimSun")  # no Latin font of its own: the generic one
    assert got[1].properties.font_size_pt == 10.5 and got[1].properties.italic and got[1].property_sources["font_size_pt"] == "direct"
    assert got[0].property_sources["font_size_pt"] == "style"
    assert (got[3].numbering.ilvl, got[3].numbering.num_id) == (1, 7) and got[2].numbering is None


def test_layout_and_tables(spark):
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    rows = _elements(spark, paragraph("x") + table + SECTION)
    layout = docx.layouts(rows).first().layout
    assert (layout.page_size.width_cm, layout.page_size.height_cm, layout.section_count, layout.other_sections) == (21.0, 29.7, 1, [])
    t = docx.tables(rows).first()
    assert (t.rows, t["columns"], t["data"][0][1].text, t["data"][0][1].paragraphs) == (1, 2, "b", 2)


def test_headers_skip_field_codes(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    header = f'<w:hdr {w}><w:p><w:r><w:t>Page </w:t></w:r><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:t>PAGE</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:hdr>'
    body = paragraph("x", extra='<w:sectPr><w:headerReference w:type="default" r:id="rId5"/></w:sectPr>') + SECTION
    rows = _elements(spark, body, extra={"word/header1.xml": header}, rels='<Relationship Id="rId5" Type="t" Target="header1.xml"/>')
    got = {(r.type, r.section_index): (r.text, r.linked_to_previous) for r in docx.headers_footers(rows).collect()}
    assert got["header", 0] == ("Page | two", False) and got["header", 1] == ("", True)


def test_rules_and_repairs(spark):
    parts = packages.unpack(spark.createDataFrame(broken_packages(), "doc_id string, content binary"))
    rows, outcome = packages.elements(parts), packages.outcomes(parts)
    found = package.validate_package(parts, rows, outcome.select("doc_id", "part", "error"), outcome).collect()
    assert {r.doc_id for r in found} == {n for n, _ in broken_packages()} - {"sound"}
    assert all(r["rule"] == r.doc_id or r.doc_id == "malformed" for r in found)
    fixed, repairs = package.repair_whitespace(rows)
    assert package.lost_whitespace(fixed).count() == 0 and repairs.where("repairs > 0").count() == 1
    counts = package.compare_paragraph_counts(rows.where("doc_id = 'sound'"), rows.where("doc_id = 'whitespace'")).collect()
    assert {r.doc_id: r["diff"] for r in counts} == {"sound": -1, "whitespace": 1}


def test_files_that_are_no_packages_give_nothing(spark):
    rows = spark.createDataFrame([("x", b"not a zip"), ("y", None)], "doc_id string, content binary")
    assert packages.unpack(rows).count() == 0


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "one.docx").write_bytes(make(paragraph("Title", "H1") + paragraph("some text", "Normal") + SECTION))
    (tmp_path / "two.docx").write_bytes(make(paragraph("Title", "H1") + SECTION.replace("11906", "12240")))
    (tmp_path / "spec.md").write_text("# 正文\n行距 20pt\n", encoding="utf-8")
    return tmp_path


def test_cli(spark, folder, tmp_path):
    out = str(tmp_path / "out" / "x.json")

    def run(*argv):
        code = main([*argv, "--output", out], spark)
        return code, json.loads(open(out, encoding="utf-8").read())

    one = str(folder / "one.docx")
    assert run("query-style", one, "--style", "HEADING")[0] == 0 and run("query-style", one, "--style", "nope")[0] == 1
    assert [r["text"] for r in run("query-text", one, "--keyword", "some")[1]] == ["some text"]
    (folder / "c.json").write_text(json.dumps({"checks": [{"type": "page_size", "selector": "document:layout", "expected": "A4"}, {"type": "font_size", "selector": "style:heading 1", "expected": 16}]}))
    code, checked = run("check", one, str(folder / "c.json"))
    assert code == 0 and sorted(r["status"] for r in checked["results"]) == ["pass", "pass"]
    assert run("validate", one)[0] == 0 and run("validate", str(folder / "gone.docx"))[0] == 1
    assert any(d["type"] == "layout" for d in run("compare", one, str(folder / "two.docx"))[1])
    code, found = run("spec-check", str(folder / "spec.md"), "--mode", "conflicts")
    assert code == 1 and found["rows"][0]["type"] == "line_spacing_mode_missing"
    assert run("read-text", str(folder / "spec.md"))[1][0]["line_count"] == 2
    assert len(run("inspect", one)[1]) == 5 and len(run("check", "--schema")[1]) == 11
    code, told = run("stats", one, "--min-length", "5", "--sample-limit", "1")
    assert told["filters"]["min_length"] == 5 and told["summary"][0]["candidate_count"] == 2 and [x["text_preview"] for x in told["summary"][0]["candidate_examples"]] == ["Title"]
    assert run("stats", one, "--min-length", "500")[1]["summary"][0]["candidate_count"] == 0
    parsed = run("parse", one)[1]
    assert parsed["metadata"][0]["paragraph_count"] == 2 and {x["name"]: x.get("base_style") for x in parsed["styles"]} == {"Normal": None, "heading 1": "Normal"}
    assert next(x for x in parsed["styles"] if x["name"] == "heading 1")["properties"]["line_spacing_value"] == 1.5


def test_cli_evidence_and_profiles(spark, folder, tmp_path):
    out = str(tmp_path / "o.json")
    main(["stats", str(folder / "one.docx"), "--output", str(tmp_path / "e.json")], spark)
    (tmp_path / "c.json").write_text(json.dumps([{"type": "font_size", "selector": "s", "expected": 16, "section": "body"}, {"type": "font_size", "selector": "s", "expected": 99, "section": "x"}]))
    for evidence in (str(tmp_path / "e.json"), str(folder / "one.docx")):
        assert main(["spec-check", "--mode", "body-consistency", "--evidence", evidence, "--checks", str(tmp_path / "c.json"), "--body-keyword", "body", "--output", out], spark) == 0
        assert main(["spec-check", "--mode", "body-consistency", "--evidence", evidence, "--checks", str(tmp_path / "c.json"), "--output", out], spark) == 1
    (tmp_path / "p.json").write_text(json.dumps({"evaluate_spec": {"section_rules": {"a": ["正文"]}}}))
    main(["spec-check", str(folder / "spec.md"), "--mode", "structure", "--profile", str(tmp_path / "p.json"), "--output", out], spark)
    rows = json.loads((tmp_path / "o.json").read_text())["rows"]
    assert {r["section"]: r["status"] for r in rows}["a"] == "covered" and len(rows) == 7


def test_profiles():
    from factloom.plans import profiles

    assert profiles.section_rules(profiles.load())["图表"] == ("图", "表") and "封面" not in profiles.required_sections(profiles.load())
    own = profiles.load(override={"evaluate_spec": {"section_rules": {"x": ["y"]}}})
    assert own["evaluate_spec"]["section_rules"]["x"] == ["y"] and "x" not in profiles.BASE["evaluate_spec"]["section_rules"]
    assert profiles.section_rules({"spec_schema": {"sections": {"a": {"required": True}, "b": {}}}}) == {"a": ("a",)}
    assert profiles.body_filter(profiles.load()).heading_keywords[0] == "附录"


def test_large_results_go_to_folders(spark, folder, tmp_path, monkeypatch):
    from factloom import cli

    monkeypatch.setattr(cli, "MOST_ROWS", 1)
    with pytest.raises(SystemExit):
        main(["query-text", str(folder), "--keyword", "t"], spark)
    assert main(["query-text", str(folder), "--keyword", "t", "--output-dir", str(tmp_path / "rows")], spark) == 0
    assert spark.read.json(str(tmp_path / "rows" / "query-text")).count() == 3


def test_errors_for_what_cannot_be_read(spark, folder):
    api = Api(spark)
    with pytest.raises(ValueError, match="suffix"):
        api.word.parse(str(folder / "spec.md"))
    with pytest.raises(ValueError, match="text source"):
        api.text.read(str(folder / "x.pdf"))
    with pytest.raises(ValueError, match="PDF"):
        api.pdf.extract(str(folder / "spec.md"))


def test_inspect_merges_runs(spark, tmp_path):
    body = '<w:p><w:r w:rsidR="1"><w:t xml:space="preserve">a </w:t></w:r><w:proofErr w:type="x"/><w:r w:rsidR="2"><w:t>b</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>c</w:t></w:r></w:p>' + SECTION
    (tmp_path / "x.docx").write_bytes(make(body))
    told = Api(spark).word.inspect(str(tmp_path / "x.docx"), output_dir=str(tmp_path / "out"), merge_runs=True).first()
    assert (told.xml_parts, told.merged_runs) == (5, 1)
    xml = spark.read.parquet(str(tmp_path / "out")).where("part = 'word/document.xml'").first().xml
    assert "a b</w:t>" in xml.replace("\n", "") and "rsid" not in xml and "proofErr" not in xml


def test_repaired_packages_are_written(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(make('<w:p><w:r><w:t> edge</w:t></w:r></w:p>' + SECTION))
    api, path = Api(spark), str(tmp_path / "x.docx")
    assert [r["rule"] for r in api.word.validate(path).collect()] == ["whitespace"]
    assert api.word.validate(path, auto_repair=True, output=str(tmp_path / "fixed")).count() == 0
    again = packages.unpack(spark.read.parquet(str(tmp_path / "fixed")))
    assert packages.elements(again).where("tag = 't' and text = ' edge' and attrs['xml:space'] = 'preserve'").count() == 1 and again.count() == 5


def test_the_last_runs_font_stands_in(spark):
    runs = '<w:p><w:r><w:rPr><w:rFonts w:ascii="First"/></w:rPr><w:t>a</w:t></w:r><w:r><w:rPr><w:rFonts w:ascii="Last"/></w:rPr><w:t>b</w:t></w:r></w:p>'
    p = docx.paragraphs(spark, _elements(spark, runs + SECTION)).first().properties
    assert (p.font_family_ascii, p.font_family_east_asia) == ("First", "Last")


XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="{n}" elementFormDefault="qualified"><xs:element name="styles"><xs:complexType><xs:sequence>
  <xs:element name="count" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""


def test_parts_are_validated_by_their_schemas(spark, tmp_path):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    (tmp_path / "wml.xsd").write_text(XSD.format(n=space))
    rows = [("good", "word/a.xml", f'<styles xmlns="{space}"><count>3{{{{later}}}}</count></styles>'), ("bad", "word/a.xml", f'<styles xmlns="{space}"><count>x</count></styles>'), ("bad", "other/a.xml", "<a/>"), ("bad", "xl/b.xml", "<a/>")]
    parts = spark.createDataFrame([(i, p, x.encode()) for i, p, x in rows], "doc_id string, part string, content binary")
    assert [(r.doc_id, r.part, r.detail) for r in package.schema_violations(parts, str(tmp_path)).collect()] == [("bad", "word/a.xml", "not valid by wml.xsd")]
    assert package.schema_violations(parts, str(tmp_path), parts).count() == 0
    assert package.schema_violations(parts, str(tmp_path), parts.where("doc_id = 'good'")).count() == 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from factloom import staging

    context = SimpleNamespace(master="spark://x:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_store_parses_files_once(spark, folder, tmp_path):
    api = Api(spark)
    store = api.store(str(tmp_path / "store"))
    parse = lambda files: docx.paragraphs(spark, packages.elements(packages.unpack(files)))
    for _ in range(2):
        assert store.paragraphs(packages.read_files(spark, str(folder)), parse).count() == 3
    assert store.stats() == {"hits": 2, "misses": 2, "size": 2}
    store.clear()
    assert store.stats() == {"hits": 0, "misses": 0, "size": 0}


def test_inputs_are_parsed_once_and_let_go(spark, folder):
    import os

    from factloom.api import DocumentService

    service = DocumentService(spark, cached=1)
    one, two = str(folder / "one.docx"), str(folder / "two.docx")
    assert service.query_text(one, "some").count() == 1 and service.parse(one) is service.parse(one)
    assert service.cache_stats() == {"hits": 2, "misses": 1, "size": 1, "max_size": 1}
    assert service.stats(two).first().candidate_count == 1 and service.cache_stats()["size"] == 1
    before = service.parse(one)
    os.utime(one, (1, 1))
    assert service.parse(one) is not before
    service.clear_cache()
    assert service.cache_stats() == {"hits": 0, "misses": 0, "size": 0, "max_size": 1}


def test_streamed_files_give_the_same_elements(spark, folder, tmp_path):
    done = ingest.to_parquet(ingest.stream_elements(spark, str(folder)), str(tmp_path / "s"), str(tmp_path / "c"))
    done.awaitTermination()
    files = packages.read_files(spark, str(folder))
    assert spark.read.parquet(str(tmp_path / "s")).count() == packages.elements(packages.unpack(files)).count()


def test_streamed_counts(spark, tmp_path):
    from factloom import schema

    kind = "at timestamp, kind string"
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-02 01:00:00", "b"), ("2024-01-05 00:00:00", "c")], "at string, kind string")
    rows.selectExpr("cast(at as timestamp) at", "kind").write.parquet(str(tmp_path / "in"))
    out = ingest.windowed_counts(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "at", "kind")
    ingest.to_parquet(out, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert {(r.kind, r.cnt) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("b", 1)}  # the last day is still open
    facts = docx.paragraphs(spark, _elements(spark, paragraph("x", "H1") + paragraph("y", "H1") + SECTION))
    facts.write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(schema.PARAGRAPHS).parquet(str(tmp_path / "p"))
    query = ingest.running_distributions(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.metric, r.value, r.cnt) for r in spark.table("running").collect()} >= {("style", "heading 1", 2), ("font_size", "16.0", 2)}


def test_references_of_pages_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from factloom.plans import registry

    texts = ["cut &amp;&amp", "&am", "&quot;q&quot", "&copy;&copy &middot;", "&amp;amp; &amp;lt; &lt;", "&#39;", "a &amp; b & c"]
    pages = [(n, "u", f"<body><h1>{t}</h1><p>x <b>{t}</b> y<p>z</body>") for n, t in enumerate(texts)]
    spark.createDataFrame([*pages, (99, "u", None)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(registry.oracles()["docx_roundtrip"])
    names = [d[0] for d in found.description]
    got = registry.queries()["docx_roundtrip"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))
