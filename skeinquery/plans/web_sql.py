"""DuckDB SQL for the queries of plans.web that SQL can express."""

from __future__ import annotations

from skeinquery.functions.text import STOP_WORDS

SPACES = r"'[ \t\n\x0B\f\r]+'"


def counted(docs: str) -> str:
    """CTEs tok and tf over a relation with docid and contents."""
    return rf"""tok AS (SELECT docid, unnest(regexp_split_to_array(lower(contents), {SPACES})) AS word FROM {docs}),
tf AS (SELECT word, docid, count(*) AS tf FROM tok WHERE word <> '' GROUP BY ALL)"""


WEIGHTS = """weights AS (
  SELECT word, docid, tf, max_tf, corpus_freq, idf_count, normalized_tf, idf, idf * normalized_tf AS tfidf FROM (
    SELECT tf.word, tf.docid, tf, max_tf, corpus_freq, idf_count, 0.5e0 + 0.5e0 * tf / max_tf AS normalized_tf,
      log2((SELECT count(DISTINCT docid) FROM tf)::DOUBLE) - log2(idf_count::DOUBLE) AS idf
    FROM tf JOIN (SELECT docid, max(tf) AS max_tf FROM tf GROUP BY docid) USING (docid)
    JOIN (SELECT word, sum(tf)::BIGINT AS corpus_freq, count(*) AS idf_count FROM tf GROUP BY word) USING (word)))"""
CORPUS = "corpus AS (SELECT doc_id::VARCHAR AS docid, text AS contents FROM documents)"
TF = f"WITH {CORPUS}, {counted('corpus')}"
INDEX = f"{TF}, {WEIGHTS}"
VISIBLE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'),
  '(?is)<head[^>]*>.*?</head>', ' ', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"""
PAGES = f"corpus AS (SELECT md5(url) AS docid, {VISIBLE} AS contents FROM pages)"
HREFS = r"""regexp_extract_all(html, '(?is)<[a-z][^>]*\shref\s*=\s*"([^"]*)"', 1)"""
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
BASE = r"regexp_extract(url, '^\s*(https?://[^/:]*)', 1)"
LINKS = rf"""links AS (SELECT url, {ORIGIN} || h AS link, regexp_extract({ORIGIN} || h, '^(https?://[^/:]*)', 1) AS domain
  FROM (SELECT url, unnest({HREFS}) AS h FROM pages))"""
TRADE = "edges AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL)"
REPAIRED = """repaired AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE dst NOT IN (SELECT src FROM edges))"""


def ranked(rounds: int, epsilon: str = "1e-9", loops: bool = False) -> str:
    """CTEs from edges to ranks(node, rank), one for each round."""
    where = "" if loops else " WHERE src <> dst"
    out = [REPAIRED, f"flat AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM repaired{where})", "r0 AS (SELECT DISTINCT src AS node, 1.0e0 AS rank FROM flat)"]
    for i in range(1, rounds + 1):
        out.append(f"r{i} AS MATERIALIZED (SELECT dst AS node, sum(rank / degree + {epsilon}) * 0.85e0 + (1 - 0.85e0) AS rank FROM flat JOIN r{i - 1} ON node = src GROUP BY dst)")
    return ",\n".join([*out, f"ranks AS (SELECT node, rank FROM r{rounds})"])


PAGE_EDGES = f"{LINKS}, edges AS (SELECT DISTINCT md5(url) AS src, md5(domain) AS dst FROM links)"
FOUND = """placed AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY tfidf DESC, docid DESC) AS place FROM weights WHERE word IN ('the', 'of')),
found AS (SELECT docid, sum(tfidf * idf) AS score FROM placed WHERE place <= 2500 GROUP BY docid HAVING count(*) = 2)"""
SEARCH = f"WITH {PAGES}, {counted('corpus')}, {WEIGHTS}, {FOUND}"
TITLE = "substring(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), 1, 100)"
STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
LAST = "last AS (SELECT user_id AS domain, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY user_id)"
SITES = f"sites AS (SELECT DISTINCT {BASE} AS domain, length({BASE}) % 2 = 0 AS even FROM pages)"
PUNCT = r"""[!"#$%&''()*+,./:;<=>?@\[\]^_`{|}~]"""
STRIPPED = rf"regexp_replace(regexp_replace(node, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', '')"
JAVA = "CASE WHEN url = '' THEN '0' ELSE (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::VARCHAR END"

def frontier_times(delay_ms: int) -> str:
    """Each event as a request of its user, handed out at most every delay_ms."""
    return f"""WITH e AS (SELECT user_id::VARCHAR AS domain, event_id::VARCHAR AS url, epoch_us(ts) // 1000 AS t FROM events),
n AS (SELECT *, {delay_ms} * row_number() OVER (PARTITION BY domain ORDER BY t, url) AS waited FROM e),
times AS (SELECT domain, url, waited + max(t - waited) OVER (PARTITION BY domain ORDER BY t, url ROWS UNBOUNDED PRECEDING) AS at_ms FROM n)
SELECT domain, url, at_ms FROM times"""


SQL: dict[str, str] = {
    "scan_csv_quoted": "SELECT doc_id::VARCHAR AS id, length(text)::BIGINT AS chars, md5(text) AS md5 FROM documents",
    "scan_edges": f"WITH {TRADE} SELECT src, dst FROM edges",
    "scan_parquet": f"{INDEX} SELECT word, round(max(idf), 6) AS idf, (place - 1) // 2500 + 1 AS rank, count(*) AS docs FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY tfidf DESC, docid DESC) AS place FROM weights) GROUP BY word, (place - 1) // 2500 + 1",
    "scan_rank_text": f"WITH {TRADE}, {ranked(2, '0.0e0', True)} SELECT node, round(rank, 6) AS rank FROM ranks",
    "unpack_blob": r"SELECT md5(doc_id::VARCHAR) AS id, md5(regexp_replace(text, '\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]', ' ', 'g')) AS md5 FROM documents",
    "blob_offsets": """WITH d AS (SELECT md5(doc_id::VARCHAR) AS id, (length(text) + 51)::BIGINT AS length FROM documents),
b AS (SELECT *, ('0x' || substr(md5(id), 1, 8))::BIGINT % 64 AS bucket FROM d),
r AS (SELECT *, (sum(length) OVER (PARTITION BY bucket ORDER BY id) - length)::BIGINT AS s FROM b),
v AS (SELECT *, s // 100000000 AS volume, s - min(s) OVER (PARTITION BY bucket, s // 100000000) AS start_idx FROM r)
SELECT id, volume * 64 + bucket AS pack, start_idx, start_idx + length AS end_idx, length FROM v""",
    "scan_csv_trimmed": "SELECT page_id::VARCHAR AS docid, url FROM pages",
    "scan_seeds": "SELECT trim(url) AS url FROM pages WHERE trim(url) <> ''",
    "append_words": "SELECT DISTINCT lang AS word FROM documents UNION ALL SELECT DISTINCT source FROM documents",
    "json_answers": "SELECT page_id, url, length(html)::BIGINT AS chars FROM pages",
    "content_types": "SELECT 'text/' || lang AS type, count(*) AS n FROM documents GROUP BY lang",
    "request_times": "SELECT o_orderkey, o_orderkey::DOUBLE / 1000e0 AS seconds FROM orders",
    "worker_lists": "SELECT doc_id, 2::BIGINT AS n, 'http://' || lang || ' http://' || source AS workers FROM documents",
    "blob_slice": r"SELECT md5(doc_id::VARCHAR) AS id, md5('*startid' || md5(doc_id::VARCHAR) || '*' || chr(10) || text || chr(10) || '*endid*' || chr(10)) AS md5 FROM documents",
    "distinct_docnames": "SELECT DISTINCT source AS docname FROM documents",
    "row_counts": "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'lineitem', count(*) FROM lineitem",
    "kv_get": "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42",
    "batch_get": "SELECT doc_id, lang, source FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)",
    "fetch_pages": "SELECT url, md5(html) AS md5 FROM pages",
    "kv_items": """SELECT '{"doc_id":{"N":"' || doc_id || '"},"lang":{"S":"' || lang || '"},"source":{"S":"' || source || '"}}' AS item FROM documents""",
    "put_new": "SELECT DISTINCT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "html_visible_text": rf"SELECT page_id, word, count(*) AS n FROM (SELECT page_id, unnest(regexp_split_to_array(lower({VISIBLE}), {SPACES})) AS word FROM pages) WHERE word <> '' GROUP BY ALL",
    "normalize_text": rf"""WITH n AS (SELECT doc_id, unnest(parts) AS node, unnest(range(len(parts))) AS pos FROM (SELECT doc_id, string_split(text, ' ') AS parts FROM documents)),
s AS (SELECT doc_id, pos, {STRIPPED} AS a FROM n),
c AS (SELECT doc_id, pos, a, regexp_replace(regexp_replace(a, '\p{{Nd}}', '', 'g'), '{PUNCT}', '', 'g') AS b FROM s)
SELECT doc_id, pos::INTEGER AS pos, CASE WHEN length(b) < 2 AND length(a) > 2 THEN '' ELSE b END AS text FROM c""",
    "stopword_filter": rf"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), {SPACES})) AS word FROM documents) WHERE word <> '' AND word NOT IN ({STOPS}) GROUP BY doc_id",
    "text_hashes": f"""WITH h AS (SELECT page_id, url, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM pages)
SELECT page_id, md5(url) AS md5, sha256(url) AS sha256, {JAVA} AS java_hash FROM h""",
    "small_functions": r"SELECT doc_id, (ceil(n_chars / 5.0e0) * 5)::BIGINT AS up5, n_chars // 3600 AS hours, n_chars % 3600 // 60 AS minutes, n_chars % 60 AS seconds, md5(regexp_replace(text, '\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]', ' ', 'g')) AS line_md5 FROM documents",
    "term_freq": f"{TF} SELECT word, docid, tf FROM tf",
    "corpus_freq": f"{TF} SELECT word, sum(tf)::BIGINT AS corpus_freq FROM tf GROUP BY word",
    "max_tf": f"{TF} SELECT docid, max(tf) AS max_tf FROM tf GROUP BY docid",
    "doc_freq": f"{TF} SELECT word, count(*) AS idf_count FROM tf GROUP BY word",
    "num_docs": f"{TF} SELECT count(DISTINCT docid) AS n FROM tf",
    "term_map": f"{TF} SELECT word, (sum(tf) OVER (PARTITION BY word))::BIGINT AS corpus_freq, docid, tf FROM tf",
    "tf_normalized": f"{INDEX} SELECT word, docid, tf, max_tf, round(normalized_tf, 6) AS normalized_tf FROM weights",
    "tfidf": f"{INDEX} SELECT word, docid, round(normalized_tf, 6) AS normalized_tf, tf, corpus_freq, idf_count, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf FROM weights",
    "top_tfidf": f"{INDEX} SELECT word, docid, round(tfidf, 6) AS tfidf FROM weights ORDER BY 3 DESC, word, docid LIMIT 30",
    "postings": f"{INDEX} SELECT word, round(idf, 6) AS idf, (row_number() OVER (PARTITION BY word ORDER BY tfidf DESC, docid DESC) - 1)::INTEGER AS pos, docid, round(tfidf, 6) AS tfidf FROM weights",
    "postings_chunked": f"{INDEX}, placed AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY tfidf DESC, docid DESC) - 1 AS place FROM weights) SELECT word, round(idf, 6) AS idf, place // 50 + 1 AS rank, (place % 50)::INTEGER AS pos, docid FROM placed",
    "edges_clean": f"WITH {TRADE} SELECT src, dst FROM edges",
    "reverse_edges": f"WITH {TRADE} SELECT dst AS src, src AS dst FROM edges",
    "sink_nodes": f"WITH {TRADE} SELECT DISTINCT dst AS node FROM edges WHERE dst NOT IN (SELECT src FROM edges)",
    "sink_repair": f"WITH {TRADE}, {REPAIRED} SELECT src, dst FROM repaired",
    "drop_self_loops": "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey",
    "out_degree": f"WITH {TRADE}, {REPAIRED} SELECT src, count(*) AS degree FROM repaired GROUP BY src",
    "adjacency": f"WITH {TRADE} SELECT src, string_agg(dst, ',' ORDER BY dst) AS dsts FROM edges GROUP BY src",
    "link_graph": f"WITH {PAGE_EDGES} SELECT src, dst FROM edges",
    "pagerank": f"WITH {TRADE}, {ranked(10)} SELECT node, round(rank, 6) AS rank FROM ranks",
    "pagerank_basic": f"WITH {TRADE}, {ranked(2, '0.0e0', True)} SELECT node, round(rank, 6) AS rank FROM ranks",
    "top_pagerank": f"WITH {TRADE}, {ranked(10)} SELECT node, round(rank, 6) AS rank FROM ranks ORDER BY 2 DESC, 1 LIMIT 5",
    "search_and": f"{SEARCH} SELECT docid, round(score, 6) AS score FROM found",
    "search_ranked": f"{SEARCH}, {PAGE_EDGES}, {ranked(10)} SELECT docid, round(score + rank, 6) AS score FROM found JOIN ranks ON node = docid ORDER BY 2 DESC, 1 LIMIT 9",
    "search_results": f"""{SEARCH}, {PAGE_EDGES}, {ranked(10)}, best AS (SELECT docid AS id, round(score + rank, 6) AS score FROM found JOIN ranks ON node = docid ORDER BY 2 DESC, 1 LIMIT 10)
SELECT id, url, {BASE} AS domain, {TITLE} AS title, length(html)::BIGINT AS length, len({HREFS})::BIGINT AS num_links, score FROM pages JOIN best ON id = md5(url)""",
    "pagerank_lookup": f"WITH {PAGE_EDGES}, {ranked(10)} SELECT id, round(coalesce(rank, 0.0e0), 6) AS rank FROM (SELECT md5(url) AS id FROM pages UNION ALL SELECT 'unknown') LEFT JOIN ranks ON node = id",
    "url_parse": rf"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^(https?)://([^/:]*)(?::([^/]*))?(/.*)?$', ['scheme', 'host', 'port', 'path']) AS u FROM pages)
SELECT page_id, u.scheme AS scheme, u.host AS host, coalesce(try_cast(nullif(u.port, '') AS INTEGER), CASE WHEN u.scheme = 'https' THEN 443 ELSE 80 END) AS port,
  CASE WHEN u.path = '' THEN '/' ELSE u.path END AS path, u.scheme || '://' || u.host AS base FROM u""",
    "url_filter": "SELECT page_id, url FROM pages WHERE url <> '' AND NOT (contains(url, 'wiki') AND NOT contains(url, 'en.wikipedia')) AND NOT contains(url, 'wordpress') AND NOT contains(url, 'stackexchange') AND NOT contains(url, 'tumblr')",
    "num_links": f"SELECT url, len({HREFS})::BIGINT AS num_links FROM pages",
    "extract_links": f"WITH {LINKS} SELECT url, link, domain FROM links",
    "doc_quality": f"SELECT page_id FROM pages WHERE length(html) >= 200 AND len({HREFS}) > 0",
    "doc_meta": rf"""SELECT md5(url) AS id, url, {BASE} AS domain, {TITLE} AS title, substring(trim(regexp_replace({VISIBLE}, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 300) AS doc_excerpt,
  length(html)::BIGINT AS length, len({HREFS})::BIGINT AS num_links, md5(html) AS content_hash FROM pages""",
    "content_dedup": "SELECT min(doc_id) AS doc_id, md5(text) AS md5 FROM documents GROUP BY md5(text)",
    "url_unseen": f"WITH {LINKS} SELECT DISTINCT link AS url FROM links WHERE link NOT IN (SELECT url FROM pages) AND NOT (contains(link, 'wiki') AND NOT contains(link, 'en.wikipedia')) AND NOT contains(link, 'wordpress') AND NOT contains(link, 'stackexchange') AND NOT contains(link, 'tumblr')",
    "robots_rules": f"WITH {SITES} SELECT domain, CASE WHEN even THEN '/en' ELSE '/de/' END AS disallowed, CASE WHEN even THEN 5 END::INTEGER AS delay FROM sites",
    "robots_allowed": rf"""WITH p AS (SELECT url, {BASE} AS domain, regexp_extract(url, '^https?://[^/]*(/.*)$', 1) AS path FROM pages)
SELECT url, domain FROM p WHERE NOT starts_with(path, CASE WHEN length(domain) % 2 = 0 THEN '/en' ELSE '/de/' END)""",
    "crawl_delay": f"WITH {LAST} SELECT domain, last_ms, (domain % 3 * 432000)::INTEGER AS delay_s FROM last WHERE domain % 3 = 0 OR ((SELECT max(last_ms) FROM last) - last_ms) // 1000 >= domain % 3 * 432000",
    "crawl_stats": f"""WITH {LINKS} SELECT (SELECT count(*) FROM pages) AS documents, (SELECT count(DISTINCT html) FROM pages) AS contents, (SELECT count(DISTINCT url) FROM pages) AS urls,
  (SELECT count(DISTINCT {BASE}) FROM pages) AS robots, count(DISTINCT domain) AS domains, (SELECT count(*) FROM (SELECT DISTINCT domain, link FROM links)) AS queued FROM links""",
    "crawl_rate": "SELECT coalesce(sum(s_suppkey), 0)::BIGINT AS total, (coalesce(sum(s_suppkey), 0) // 91)::BIGINT AS rate FROM supplier WHERE s_suppkey * 1000 <= 30000",
    "crawl_fixpoint": f"""WITH RECURSIVE {TRADE}, {REPAIRED},
reach AS (SELECT 'p1' AS url, 0::INTEGER AS depth UNION SELECT dst, depth + 1 FROM reach JOIN repaired ON src = url WHERE depth < 40)
SELECT url, min(depth)::INTEGER AS depth FROM reach GROUP BY url""",
    "stream_content_dedup": "SELECT DISTINCT md5(html) AS md5 FROM pages",
    "stream_link_filter": f"WITH {LINKS} SELECT DISTINCT link AS url FROM links WHERE NOT (contains(link, 'wiki') AND NOT contains(link, 'en.wikipedia')) AND NOT contains(link, 'wordpress') AND NOT contains(link, 'stackexchange') AND NOT contains(link, 'tumblr')",
    "stream_crawl_step": f"WITH {PAGE_EDGES} SELECT src, dst FROM edges",
    "stream_frontier": frontier_times(60_000),
    "stream_queue": frontier_times(3_600_000) + " WHERE at_ms < (SELECT max(t) FROM e)",
    "route_fields": rf"SELECT page_id, domain, domain AS route_key, ('0x' || substr(md5(domain), 1, 8))::BIGINT % 8 AS route FROM (SELECT page_id, {BASE} AS domain FROM pages)",
}
