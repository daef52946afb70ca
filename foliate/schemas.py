"""Explicit schemas of the records that pass between operators."""

from __future__ import annotations

BLOCK = """doc_id long, block_idx long, page_idx long, type string, text string, text_level int, img_path string,
    image_caption array<string>, image_footnote array<string>, table_body string, table_caption array<string>,
    table_footnote array<string>, latex string, text_format string, content string"""
CONTENT_LIST = """array<struct<type: string, page_idx: long, text: string, text_level: int, img_path: string,
    image_caption: array<string>, img_caption: array<string>, image_footnote: array<string>, img_footnote: array<string>,
    table_body: string, table_caption: array<string>, table_footnote: array<string>, latex: string, text_format: string, content: string>>"""
JUDGE = "overall_score double, dimension_scores map<string, double>, verdict string, feedback string, critical_issues array<string>, improvement_suggestions array<string>"
MODAL_REPLY = "detailed_description string, entity_info struct<entity_name: string, entity_type: string, summary: string>"
#: The states a document passes through, in order.
STATES = ("ready", "handling", "pending", "processing", "processed", "failed")
