"""Profiles: nested settings for structure checks and sampling, merged on the driver."""

from __future__ import annotations

import json

from factloom.operators.stats import ParagraphFilter

#: The default settings of a thesis, section by section, then the rules and the sampling hints.
BASE = {
    "spec_schema": {
        "sections": {
            "页面设置": {"required": True, "extractor": "layout", "properties": ["paper_size", "margins", "header_distance", "footer_distance"]},
            "正文": {
                "required": True, "extractor": "font", "target_styles": ["Normal"], "validation": "cross_source",
                "properties": ["east_asia_font", "ascii_font", "font_size", "line_spacing", "alignment", "first_line_indent"],
            },
            "标题": {
                "required": True, "extractor": "heading", "levels": [1, 2, 3, 4], "validation": "cross_source",
                "properties": ["font", "font_size", "line_spacing", "alignment", "space_before", "space_after"],
            },
            "摘要": {"required": True, "extractor": "abstract", "properties": ["title_format", "body_format", "word_count"]},
            "关键词": {"required": True, "extractor": "keyword", "properties": ["label_format", "content_format", "count_requirement"]},
            "图表Caption": {"required": True, "extractor": "caption", "target_styles": ["Caption"], "properties": ["figure_caption", "table_caption", "numbering_style"]},
            "参考文献": {"required": True, "extractor": "reference", "properties": ["font", "font_size", "line_spacing", "citation_style"]},
            "页眉页脚": {"required": True, "extractor": "header_footer", "properties": ["header_format", "footer_format", "page_numbering"]},
            "目录": {"required": True, "extractor": "toc", "properties": ["toc_format", "heading_levels_included"]},
            "封面": {"required": False, "extractor": "cover", "properties": ["title_page_layout"]},
            "附录": {"required": False, "extractor": "appendix", "properties": ["appendix_format", "appendix_numbering"]},
            "致谢": {"required": False, "extractor": "acknowledgment", "properties": ["acknowledgment_format"]},
        }
    },
    "evaluate_spec": {
        "section_rules": {"页面设置": ["页面设置"], "正文": ["正文"], "标题": ["标题"], "摘要": ["摘要"], "图表": ["图", "表"], "参考文献": ["参考文献"]},
        "body_section_keywords": ["正文"],
    },
    "extract_spec": {
        "body_sampling": {
            "body_style_hints": ["normal", "body text", "body text indent", "body", "normal indent"],
            "heading_prefix_patterns": ["^第.+章"],
            "heading_keywords": ["附录", "摘要", "目录", "参考文献", "致谢"],
            "instruction_hints": ["打印", "适用于", "选填"],
        }
    },
}


def merged(base: dict, override: dict) -> dict:
    """``base`` with ``override`` on top; only mappings are merged, all else is replaced."""
    out = dict(base)
    for key, value in override.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load(path: str | None = None, override: dict | None = None) -> dict:
    """The default settings, those of a JSON file over them, and ``override`` over both."""
    out = BASE
    if path:
        with open(path, encoding="utf-8") as f:
            out = merged(out, json.load(f))
    return merged(out, override or {})


def sections(profile: dict) -> dict:
    return profile.get("spec_schema", {}).get("sections", {})


def required_sections(profile: dict) -> list[str]:
    return [name for name, settings in sections(profile).items() if settings.get("required")]


def section_rules(profile: dict) -> dict[str, tuple[str, ...]]:
    """The rules that ``spec.structure`` takes: the given ones, else each required section by its name."""
    given = profile.get("evaluate_spec", {}).get("section_rules")
    return {n: tuple(w) for n, w in given.items()} if given is not None else {n: (n,) for n in required_sections(profile)}


def body_filter(profile: dict) -> ParagraphFilter:
    """The filter for body text that the sampling settings describe."""
    s = profile.get("extract_spec", {}).get("body_sampling", {})
    return ParagraphFilter(
        style_hints=tuple(s.get("body_style_hints", ())), heading_prefixes=tuple(s.get("heading_prefix_patterns", ())),
        heading_keywords=tuple(s.get("heading_keywords", ())), instruction_hints=tuple(s.get("instruction_hints", ())),
    )
