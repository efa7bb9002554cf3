"""SQL of the training-data queries that SQL can express over whole tables."""

from tessella.functions.text import SPACE
from tessella.llm.linked_splits import PLACEHOLDERS

_PH = ", ".join("'" + p + "'" for p in PLACEHOLDERS)
_N1 = "regexp_replace(regexp_replace(lower(img_name), '%(25)*2f', '/', 'g'), '%(25)*5c', '/', 'g')"
_N2 = f"regexp_replace(regexp_replace({_N1}, '[\\\\/]+', '/', 'g'), '^({SPACE}|/)+|({SPACE}|/)+$', '', 'g')"
_N3 = f"regexp_replace(regexp_replace({_N2}, '{SPACE}*/{SPACE}*(\\.{SPACE}*/{SPACE}*)*', '/', 'g'), '^\\./', '')"

_GROUPS = f"""WITH RECURSIVE k AS (SELECT rec_id, img_id, img_name, CASE WHEN img_id > 0 THEN 'i' || img_id END AS ik,
  CASE WHEN {_N3} NOT IN ({_PH}) THEN 'n' || regexp_extract({_N3}, '([^/]+/)?[^/]+$', 0) END AS nk FROM qa_record),
e AS (SELECT DISTINCT ik AS a, nk AS b FROM k WHERE ik IS NOT NULL AND nk IS NOT NULL),
pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT coalesce(ik, nk), coalesce(ik, nk) FROM k WHERE ik IS NOT NULL OR nk IS NOT NULL),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, t.b FROM reach r JOIN pairs t ON r.b = t.a),
root AS (SELECT a, min(b) AS r FROM reach GROUP BY a),
g AS (SELECT k.rec_id, k.img_id, k.img_name, root.r FROM k LEFT JOIN root ON coalesce(k.ik, k.nk) = root.a),
s AS (SELECT r, min(rec_id) AS group_id, count(DISTINCT coalesce(CAST(img_id AS VARCHAR), 'null') || '|' || coalesce('=' || img_name, 'null')) AS kinds FROM g WHERE r IS NOT NULL GROUP BY r)
"""


def _canon(field: str) -> str:
    x = f"regexp_replace(regexp_replace(replace(lower({field}), 'ß', 'ss'), '{SPACE}+', ' ', 'g'), '([0-9])，([0-9])', '\\1,\\2', 'g')"
    for _ in range(2):
        x = f"regexp_replace(regexp_replace({x}, '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9]),([0-9])', '\\1' || chr(2) || '\\2', 'g')"
    x = f"regexp_replace({x}, '[\\p{{P}}`´~^|]', '', 'g')"
    return f"coalesce(replace({x}, ' ', ''), chr(3))"


_FIELDS = ["img_id", "img_name", "q_lang", "answer_type", "modality", "base_type", "triple"]
_KEY = " || chr(4) || ".join([f"coalesce(json_extract(payload, '$.{f}')::VARCHAR, chr(3))" for f in _FIELDS] + [_canon(f"json_extract_string(payload, '$.{f}')") for f in ("question", "answer")])
_COPIES = f"WITH c AS (SELECT raw_id, {_KEY} AS k FROM raw_record), g AS (SELECT k, min(raw_id) AS a, count(*) AS n FROM c GROUP BY k)"

ORACLE = {
    "p1_found": f"{_GROUPS} SELECT g.rec_id, s.group_id FROM g JOIN s USING (r) WHERE s.kinds > 1",
    "p5_found": f"{_COPIES} SELECT g.a AS raw_id_a, c.raw_id AS raw_id_b FROM c JOIN g USING (k) WHERE c.raw_id <> g.a",
    "p5_collapsed": f"{_COPIES} SELECT a AS raw_id, n AS copies FROM g",
}
