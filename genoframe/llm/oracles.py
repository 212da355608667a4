"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import chat, licenses
from ._common import ALNUM_WORD, LOWER, SPACE_GAP, SPACE_WORD, UPPER

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_DOCS = f"d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '{ALNUM_WORD}') AS w FROM documents)"

DECONTAMINATE = f"""WITH {_DOCS},
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, '{ALNUM_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
pos AS (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d), (SELECT DISTINCT n FROM win) WHERE p + n - 1 <= len(w)),
hit AS (SELECT rid, p, pos.n, item FROM pos JOIN win USING (n, t)),
cov AS (SELECT rid, count(DISTINCT q) AS h FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
it AS (SELECT rid, string_agg(DISTINCT item, ',' ORDER BY item) AS items, count(DISTINCT item) AS k FROM hit GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(h, 0) AS n_hit, coalesce(k, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)"""


def _pattern(template: licenses.Template) -> str:
    """The template as a pattern over words joined by spaces: its phrases with so many words between them."""
    out, at = " ", 0
    for offset, phrase in template.phrases:
        if offset > at and at:
            out += f"(?:[^ ]+ ){{{offset - at}}}"
        out += " ".join(phrase) + " "
        at = offset + len(phrase)
    return out


def license_scan() -> str:
    """Base places word by word; labels by patterns over the joined words."""
    index = licenses.index()
    # A template that begins before its first phrase needs so many words there.
    lead = lambda t: f"(?: [^ ]+){{{t.phrases[0][0]}}}" if t.phrases[0][0] else ""
    met = {k: f"regexp_matches(j, '{lead(t)}{_pattern(t)}')" for k, t in enumerate(index)}
    listed = lambda ks: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {met[k]} THEN '{index[k].label}' END" for k in ks) + "], lambda x: x IS NOT NULL))), ',')"
    base = [k for k, t in enumerate(index) if t.base]
    body = " OR ".join(met[k] for k, t in enumerate(index) if not t.base)
    at = " OR ".join("(" + " AND ".join(f"w[p + {k + 1}] = '{x}'" for k, x in enumerate(index[b].phrases[0][1])) + ")" for b in base)
    return f"""WITH {_DOCS}, j AS (SELECT rid, doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j FROM d),
    b AS (SELECT rid, count(*) AS n, min(p) AS f, max(p) AS l FROM (SELECT rid, w, unnest(range(0, len(w))) AS p FROM d) WHERE {at} GROUP BY rid)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, f AS first_word, l AS last_word, {listed(base)} AS base_labels, {listed(list(met))} AS labels,
      CASE WHEN {body} THEN 1.0::DOUBLE WHEN coalesce(n, 0) > 0 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS score FROM j LEFT JOIN b USING (rid)"""


QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{SPACE_WORD}') AS w FROM d),
g AS (SELECT rid, p, array_to_string(w[p:p + 4], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM w WHERE len(w) >= 5)),
r AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, x) AS c FROM g) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, source, t, p, raw, lower(regexp_replace(trim(regexp_replace(raw, '{SPACE_GAP}', ' ', 'g'), ' '), '[0-9]+', '0', 'g')) AS line FROM (SELECT rid, source, t, unnest(range(len(string_split(t, chr(10))))) AS p, unnest(string_split(t, chr(10))) AS raw FROM d)),
dup AS (SELECT rid, count(*) - count(DISTINCT raw) AS n FROM l WHERE line <> '' GROUP BY rid),
h AS (SELECT source, count(DISTINCT t) AS total FROM d GROUP BY source),
f AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT t) AS n FROM l WHERE line <> '' GROUP BY source, line) x WHERE n >= 5 AND 100 * n > 2 * (SELECT total FROM h WHERE h.source IS NOT DISTINCT FROM x.source)),
m AS (SELECT l.*, f.line IS NOT NULL AS frequent FROM l LEFT JOIN f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source),
c AS (SELECT rid, sum(CASE WHEN frequent THEN len(line) - len(replace(line, ' ', '')) + 1 ELSE 0 END) AS n, string_agg(raw, chr(10) ORDER BY p) FILTER (NOT frequent) AS clean FROM m GROUP BY rid),
s AS (SELECT doc_id, len(w) AS n_words, length(t) - length(regexp_extract_all(t, '[\\x20\\x09-\\x0D]').array_to_string('')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(c.n, 0)::BIGINT AS removed, md5(coalesce(c.clean, '')) AS clean_md5
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN r USING (rid) LEFT JOIN c USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - removed < 0.2 * n_words) AS kept FROM s"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan(), "op3_quality": QUALITY, "op8_decontaminate": DECONTAMINATE, "op9_chat_rotation": chat.SQL}
