"""SQL for the operators that SQL can express."""

from __future__ import annotations

from moodtide.llm.queries import URL_RULES
from moodtide.llm.url_filter import LONG_SUFFIXES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
WITH lines AS (
    SELECT doc_id, pos, line, trim(translate(line, '{UPPER}', '{UPPER.lower()}'), {SPACES}) AS key
    FROM (
        SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    )
),
shared AS (
    SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
),
marked AS (
    SELECT lines.*, shared.key IS NOT NULL AS dropped FROM lines LEFT JOIN shared ON lines.key = shared.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

COPIES = """
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
        sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM texts WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""

ARCHIVED = """
WITH sized AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
),
placed AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes)
        ELSE page_id END AS last FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last THEN last END AS refers_to
FROM placed
"""


def judged() -> str:
    """Rules as a table; the three levels of counts, each shrunk to the one above."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    long = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)

    def shrunk(name: str, children: str, above: str, parent: str) -> str:
        return f"""
{name}_known AS (SELECT c.*, p.mean AS m FROM {children} c JOIN {above} p USING ({parent})),
{name}_weight AS (
    SELECT 1 / greatest(0.001, least(0.9, round(CASE
        WHEN sum(n * (n - 1) * m * (1 - m)) > 0
        THEN sum(pow(k - n * m, 2) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) ELSE 1.0 END, 9))) - 1 AS s
    FROM {name}_known
),
{name}_mean AS (
    SELECT t.*, s * m + k AS a, s * (1 - m) + n - k AS b, (s * m + k) / ((s * m + k) + (s * (1 - m) + n - k)) AS mean
    FROM {name}_known t, {name}_weight
)"""

    return f"""
WITH urls AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
),
rules(verdict, rule_host, rule_path) AS (VALUES {rules}),
ruled AS (
    SELECT page_id, rule_host || rule_path AS rule, rules.verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
    FROM urls JOIN rules ON ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path)
),
outcomes AS (
    SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS k
    FROM labels GROUP BY doc_id
),
parts AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM urls),
named AS (
    SELECT host, labels, CASE WHEN array_to_string(labels[-2:], '.') IN ({long}) THEN 2 ELSE 1 END AS size FROM parts
),
places AS (
    SELECT host, array_to_string(labels[-size:], '.') AS suffix, array_to_string(labels[-(size + 1):], '.') AS domain
    FROM named
),
hosts AS (
    SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, 1 AS whole,
        CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(k), 0) AS DOUBLE) AS k
    FROM urls LEFT JOIN outcomes USING (page_id) JOIN places USING (host) GROUP BY host
),
domains AS (SELECT whole, suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT whole, suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
top AS (SELECT whole, (sum(k) + 0.5) / (sum(n) + 1) AS mean FROM suffixes GROUP BY whole),
{shrunk('suffix', 'suffixes', 'top', 'whole')},
{shrunk('domain', 'domains', 'suffix_mean', 'suffix')},
{shrunk('host', 'hosts', 'domain_mean', 'domain')},
bounds AS (
    SELECT host, greatest(0.0, round(mean - 1.645 * sqrt(mean * (1 - mean) / (a + b + 1)), 9)) AS lower FROM host_mean
)
SELECT urls.page_id, urls.host, urls.path, ruled.rule,
    coalesce(ruled.verdict, CASE WHEN lower > 0.25 THEN 'block' ELSE 'allow' END) AS verdict
FROM urls JOIN bounds USING (host) LEFT JOIN ruled ON urls.page_id = ruled.page_id AND ruled.place = 1
"""

RANKED = f"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}') AS terms
    FROM documents
),
totals AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms)) AS n_words FROM docs),
tfs AS (
    SELECT doc_id, len(terms) AS n, term, count(*) AS tf
    FROM (SELECT doc_id, terms, unnest(terms) AS term FROM docs) GROUP BY ALL
),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
wanted AS (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term
    FROM benchmark
),
items AS (SELECT item_id, term, count(*) AS times FROM wanted GROUP BY ALL),
scores AS (
    SELECT item_id, doc_id, CAST(sum(times
        * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
        * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_words)))) AS BIGINT) AS score
    FROM items JOIN dfs USING (term) JOIN tfs USING (term), totals GROUP BY ALL
),
places AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM places WHERE rank <= 20
"""

COLLOCATED = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM split GROUP BY lang),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split),
grams AS (
    SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
    FROM places, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE i + size - 1 <= len(words)
),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS words, f AS a FROM counts WHERE size > 1),
cuts AS (
    SELECT lang, size, phrase, a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
),
scores AS (
    SELECT c.lang, c.size, c.phrase, c.a, k, l.f AS l, r.f AS r,
        CAST((CAST(2000000 AS HUGEINT) * a) // (l.f + r.f) AS BIGINT) AS score
    FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.head JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest
),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (
    SELECT lang, array_to_string(words[i : i + n - 1], ' ') AS phrase, max(a) AS held
    FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM candidates WHERE size > 2))
    GROUP BY ALL
),
kept AS (
    SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM lowest LEFT JOIN spans USING (lang, phrase) WHERE held IS NULL OR 100 * held < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang) WHERE rank <= 2000
"""


ORACLE: dict[str, str] = {
    "op1_line_dedup": LINES,
    "op5_exact_dedup": COPIES,
    "op6_warc": ARCHIVED,
    "op8_url_filter": judged(),
    "op11_lexical_search": RANKED,
    "op13_collocations": COLLOCATED,
}
