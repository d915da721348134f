"""The queries and SQL oracles that this subpackage adds to ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_bpe
from .decontaminate import op3_decontaminate
from .html_text import op10_html
from .language import op5_language
from .line_dedup import ORACLE as LINE_DEDUP
from .line_dedup import op6_line_dedup
from .line_quality import op9_line_quality
from .packing import op4_packing
from .quality_rules import op1_quality_rules
from .simhash import op2_simhash
from .toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash": op2_simhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_packing": op4_packing,
    "op5_language": op5_language,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_line_quality": op9_line_quality,
    "op10_html": op10_html,
}

#: DuckDB's forms of what SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": LINE_DEDUP,
    "op3_decontaminate": r"""
WITH low AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT kind, id, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
item_windows AS (
  SELECT DISTINCT id AS item, least(10, len(w)) AS n, array_to_string(w[o : o + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS o FROM words WHERE kind = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, o, n, array_to_string(w[o : o + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS o FROM words, sizes WHERE kind = 'd' AND len(w) >= n)),
found AS (SELECT doc_id, o, n, item FROM doc_windows JOIN item_windows USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(o, o + n)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id) WHERE w.kind = 'd'
""",
}
