"""Schemas of the fact tables. A missing property and a null one are the same."""

from __future__ import annotations

PROPERTIES = (
    "struct<alignment:string, line_spacing_mode:string, line_spacing_value:double, space_before_pt:double, space_after_pt:double,"
    " first_line_indent_pt:double, font_family_east_asia:string, font_family_ascii:string, font_family:string, font_size_pt:double,"
    " bold:boolean, italic:boolean, underline:boolean>"
)
NUMBERING = "struct<ilvl:int, num_id:int, outline_level:int>"
PARAGRAPHS = f"doc_id string, id string, index int, text string, style_name string, style_id string, properties {PROPERTIES}, property_sources map<string,string>, numbering {NUMBERING}"
STYLES = f"doc_id string, style_id string, name string, style_type string, base_style_id string, properties {PROPERTIES}"
RUNS = "doc_id string, para_index int, pos int, text string, fmt string, size_pt double, east_asia string, ascii string, bold boolean, italic boolean, underline boolean"
PAGE = "struct<width_cm:double, height_cm:double>"
MARGINS = "struct<top_cm:double, bottom_cm:double, left_cm:double, right_cm:double>"
LAYOUT = (
    f"struct<page_size:{PAGE}, page_margins:{MARGINS}, header_distance_cm:double, footer_distance_cm:double, section_count:int,"
    f" other_sections:array<struct<section_index:int, page_size:{PAGE}, page_margins:{MARGINS}>>>"
)
CHECKS = (
    "idx int, type string, selector string, expected_num double, expected_str string, expected_bool boolean, expected_mode string, expected_value double,"
    " scope string, side string, style_name string, style_aliases array<string>, caption_prefix_patterns array<string>,"
    " id string, section string, rule_text string, expected_display string"
)
PARTS = "doc_id string, part string, content binary"
ELEMENTS = "doc_id string, part string, elem_id bigint, parent_id bigint, tag string, ns string, ancestors array<string>, attrs map<string,string>, text string, pos bigint"
SPEC_LINES = "spec_id string, line_number int, text string"
