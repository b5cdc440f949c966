"""The numbered corpus queries and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from gneiss.llm import audit, chat, divergence, language, leaks, lengths, licenses, lines, mixing, pieces, quality, simhash, syncmers


def queries() -> dict:
    return {
        q.__name__: q
        for q in (
            simhash.op1_simhash,
            syncmers.op2_syncmers,
            quality.op3_quality,
            language.op4_language_id,
            chat.op5_chat_format,
            leaks.op6_decontaminate,
            lines.op7_line_dedup,
            licenses.op8_license_scan,
            lengths.op9_token_counts,
            pieces.op10_sentencepiece,
            divergence.op11_divergence,
            mixing.op12_mix,
            audit.op13_filter_audit,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat.op5_sql(), "op7_line_dedup": lines.OP7_SQL, "op11_divergence": divergence.OP11_SQL, "op13_filter_audit": audit.op13_sql()}
