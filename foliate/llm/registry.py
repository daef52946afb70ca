"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from foliate.llm import bpe, decontam, html_text, license_scan, line_dedup, prefix_trie, quality_cnn, quality_rules, search, secrets, simhash, token_file, warc


def queries() -> dict:
    return {
        "op1_decontaminate": decontam.op1_decontaminate,
        "op2_html_text": html_text.op2_html_text,
        "op3_simhash": simhash.op3_simhash,
        "op4_bpe": bpe.op4_bpe,
        "op5_secrets": secrets.op5_secrets,
        "op6_quality_cnn": quality_cnn.op6_quality_cnn,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_token_file": token_file.op8_token_file,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_warc": warc.op11_warc,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_search": search.op13_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": line_dedup.ORACLE_SQL, "op11_warc": warc.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_search": search.ORACLE_SQL}
