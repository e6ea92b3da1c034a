"""DuckDB SQL that answers what plans.queries answers, on the same tables."""

from __future__ import annotations

import re

from tidemill.plans import cluster_sql

#: The SQL has values of its own: it takes none from the engine, so that an error in those shows.
TRACKING_FIRST = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "mc_cid", "mc_eid"]
TRACKING = [*TRACKING_FIRST, "ref", "source", "fb_action_ids", "fb_action_types", "fb_ref", "fb_source"]
NAMES = ["model", "agent", "multimodal", "coding", "infrastructure", "data_eval", "safety_governance", "applications", "business_ecosystem"]
ALIASES = {"multi": "multimodal", "infra": "infrastructure", "eval": "data_eval", "data": "data_eval", "security": "safety_governance"}
CAPPED = {"model": 12, "agent": 12, "multimodal": 12, "coding": 12, "infrastructure": 12, "data_eval": 10, "safety_governance": 10, "applications": 10, "business_ecosystem": 10}
WEIGHTS = {
    "model": {"entity": 1.5, "capability": 2, "availability": 1, "performance": 1.5, "cost": 1, "ecosystem": 1, "adoption": 1},
    "agent": {"task_boundary": 1.5, "tool_call": 1.5, "protocol": 1, "orchestration": 1.5, "observability": 0.75, "production": 1.5, "benchmark": 0.75, "workflow": 1.5},
    "multimodal": {"modality_coverage": 1.5, "io_capability": 1.5, "quality": 1, "realtime": 1, "editing": 0.75, "3d_world": 1, "safety_copyright": 0.75, "product": 1},
    "coding": {"code_gen": 1.5, "repo_understanding": 1.25, "engineering": 1.5, "ide_integration": 1, "delivery": 1, "benchmark": 0.75, "cost_speed": 0.75, "security": 0.75},
    "infrastructure": {"hardware": 1.5, "training": 1, "performance": 1.5, "cost": 1, "software_stack": 1.25, "cloud": 1.25, "edge": 0.75, "ops": 0.75},
    "data_eval": {"data_asset": 1.5, "coverage": 1, "methodology": 1.5, "reproducibility": 1.25, "performance": 1.25, "quality": 1, "governance": 1, "decision_value": 0.75},
    "safety_governance": {"risk_type": 1.25, "controls": 1.5, "verification": 1.5, "privacy": 1, "copyright": 1, "regulation": 1.25, "framework": 1.25, "deployment_impact": 1},
    "applications": {"industry": 1.25, "business_problem": 1.5, "launch_status": 1.5, "scale": 1, "roi": 1.25, "workflow_change": 1.25, "replicability": 0.75, "risk_responsibility": 1},
    "business_ecosystem": {"business_fact": 1.5, "entity_market": 1.25, "strategy": 1.25, "business_model": 1.5, "market_landscape": 1.25, "open_source": 0.75, "talent": 0.75, "signal": 1},
}
STORIES = {
    "model": "entity AND capability",
    "agent": "task_boundary AND (tool_call OR orchestration)",
    "multimodal": "modality_coverage AND io_capability",
    "coding": "(code_gen AND (repo_understanding OR engineering)) OR (code_gen AND ide_integration AND (half_engineering OR half_delivery OR half_benchmark)) OR (engineering AND (delivery OR security))",
    "infrastructure": "(hardware OR training OR cloud OR edge) AND (performance OR cost OR software_stack OR ops)",
    "data_eval": "(data_asset AND (coverage OR quality OR governance)) OR (methodology AND (performance OR reproducibility OR quality))",
    "safety_governance": "risk_type AND (controls OR verification OR regulation)",
    "applications": "industry AND business_problem AND launch_status",
    "business_ecosystem": "(business_fact AND (entity_market OR strategy OR business_model)) OR (entity_market AND open_source) OR (talent AND strategy)",
}

DAY0, NOW = 1704067200, 1704067200 + 20 * 86400


def texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def at(seconds: str) -> str:
    return f"make_timestamp(CAST(({seconds}) AS BIGINT) * 1000000)"


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


SP = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trimmed(c: str) -> str:
    return rf"regexp_replace({c}, '^{SP}+|{SP}+\z', '', 'g')"


def collapsed(c: str) -> str:
    return trimmed(f"regexp_replace({c}, '{SP}+', ' ', 'g')")


def decoded(c: str) -> str:
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&#x2F;", "/"), ("&nbsp;", " "), ("&apos;", "''")):
        c = f"replace({c}, '{name}', '{sign}')"
    for pattern, value in (("&#([0-9]+);", "CAST(x[2] AS INT)"), ("&#x([0-9a-fA-F]+);", "CAST('0x' || x[2] AS INT)")):
        bare = pattern.replace("(", "").replace(")", "")
        c = f"array_to_string(list_transform(list_zip(regexp_split_to_array({c}, '{bare}'), regexp_extract_all({c}, '{pattern}', 1)), lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' ELSE chr({value}) END), '')"
    return c


def composed(c: str) -> str:
    """As far as the given tables go: DuckDB has NFC, and they hold no compatibility characters."""
    return f"regexp_replace(nfc_normalize({c}), '[\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"


def title(c: str) -> str:
    return collapsed(decoded(f"regexp_extract({c}, '(?is)<title[^>]*>(.*?)</title>', 1)"))


def plain_html(c: str) -> str:
    c = f"regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "template"):
        c = rf"regexp_replace({c}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    return collapsed(decoded(f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')"))


def piece(c: str, name: str) -> str:
    got = {"scheme": r"^([A-Za-z][A-Za-z0-9+.\-]*)://", "host": r"^[^:]+://([^/?#:]*)", "port": r"^[^:]+://[^/?#]*:([0-9]+)", "path": r"^[^:]+://[^/?#]*([^?#]*)", "query": r"\?([^#]*)"}[name]
    out = f"regexp_extract({c}, '{got}', 1)"
    return f"lower({out})" if name in ("scheme", "host") else out


def url(c: str, dropped: list[str], fold: bool, order: bool) -> str:
    name = "lower(split_part(p, '=', 1))" if fold else "split_part(p, '=', 1)"
    kept = f"list_filter(string_split({piece(c, 'query')}, '&'), lambda p: p <> '' AND NOT list_contains({texts(dropped)}, {name}))"
    kept = f"list_transform(list_sort(list_transform({kept}, lambda p: {{'a': split_part(p, '=', 1), 'b': p}})), lambda q: q.b)" if order else kept
    scheme, port = piece(c, "scheme"), piece(c, "port")
    shown = f"CASE WHEN {port} = '' OR {port} = CASE {scheme} WHEN 'http' THEN '80' ELSE '443' END THEN '' ELSE ':' || {port} END"
    path = f"CASE WHEN {piece(c, 'path')} = '' THEN '/' ELSE {piece(c, 'path')} END"
    query = f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
    return f"CASE WHEN {scheme} IN ('http', 'https') AND {piece(c, 'host')} <> '' THEN {scheme} || '://' || {piece(c, 'host')} || {shown} || {path} || {query} END"


def canonical(c: str) -> str:
    return f"coalesce({url(c, TRACKING, True, True)}, '')"


def host(c: str) -> str:
    return rf"regexp_replace({piece(c, 'host')}, '^www\.', '')"


def title_key(c: str) -> str:
    return rf"regexp_replace(lower({collapsed(c)}), '^[\p{{P}}\p{{S}}\s]+|[\p{{P}}\p{{S}}\s]+\z', '', 'g')"


def sentences(c: str, marks: str = r"[。！？!?\n]+") -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '{marks}'), lambda s: {trimmed('s')}), lambda s: s <> '')"


def plain(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[\s\p{{P}}\p{{S}}]', '', 'g')"


ARTICLES = f"""articles AS (
  SELECT d.doc_id AS article_id, left(split_part(d.text, chr(10), 1), 80) AS title, d.text, d.source AS source_name, CAST(substr(d.source, 4) AS INT) AS source_no,
    {at(f'{DAY0} + d.doc_id * 977 % 2592000')} AS published_at, {at(f'{DAY0} + d.doc_id * 1511 % 2592000')} AS collected_at,
    CASE WHEN d.doc_id % 10 < 6 THEN 'published' WHEN d.doc_id % 10 < 8 THEN 'draft' WHEN d.doc_id % 10 = 8 THEN 'pending_review' ELSE 'blocked' END AS status,
    CASE WHEN d.doc_id % 11 <> 0 THEN {texts(NAMES)}[d.doc_id % 9 + 1] END AS direction, CAST(d.doc_id * 37 % 101 AS INT) AS score,
    CASE WHEN d.doc_id % 3 <> 0 THEN 'c' || (d.doc_id // 6) END AS cluster_id, d.doc_id % 5 <> 0 AS ai_processed, l.quality
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
SOURCES = f"""sources AS (
  SELECT source_name, n AS source_no, ['authoritative', 'validation', 'signal'][n % 3 + 1] AS tier, ['first_party', 'editorial', 'aggregator'][n % 4 + 1] AS origin_policy,
    n % 7 <> 0 AS enabled, CASE WHEN n % 3 <> 0 THEN {at(f'{DAY0} + n * 86400')} END AS next_fetch_at, ['media_analysis', 'lab', 'community'][n % 3 + 1] AS category
  FROM (SELECT DISTINCT source AS source_name, CAST(substr(source, 4) AS INT) AS n FROM documents))"""
ITEMS = f"""items AS (
  SELECT page_id AS item_id, CASE WHEN page_id % 41 <> 0 THEN {title('html')} END AS title,
    CASE WHEN page_id % 53 = 0 THEN '' WHEN page_id % 59 = 0 THEN 'ftp://x/y' ELSE 'HTTPS://' || {host('url')} || ':443/a/' || (page_id % 97) || '?utm_source=x&b=' || (page_id % 3) || '&a=1#top' END AS url,
    CASE WHEN page_id % 61 <> 0 THEN {plain_html('html')} END AS content, 'src' || (page_id % 20) AS source_name,
    page_id % 20 % 3 AS tier, page_id % 20 % 4 AS origin
  FROM pages), reasons AS (
  SELECT item_id, CASE WHEN coalesce({collapsed('title')}, '') = '' THEN 'title' WHEN coalesce(trim(url), '') = '' THEN 'url_missing' WHEN {canonical('url')} = '' THEN 'url_invalid' WHEN coalesce({collapsed('content')}, '') = '' THEN 'content' END AS drop_reason,
    {collapsed(composed(decoded('coalesce(title, chr(32))')))} AS title, url, content, source_name, tier, origin, {canonical('url')} AS dedup_url FROM items), normal AS (
  SELECT *, md5(title || chr(10) || dedup_url) AS content_hash FROM reasons WHERE drop_reason IS NULL)"""
HEALTH = """attempts AS (
  SELECT 'src' || (user_id % 20) AS source_name, ts, event_id, event_type <> 'error' AS ok, event_type = 'error' AND value > 200 AS gone FROM events), runs AS (
  SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY ts DESC, event_id DESC) AS back, sum(ok::INT) OVER (PARTITION BY source_name ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS since FROM attempts), health AS (
  SELECT *, CASE WHEN consecutive_failures < 3 THEN NULL WHEN gone THEN 604800 ELSE least(604800, 7200 * pow(2, least(consecutive_failures - 3, 12)))::INT END AS cooldown_seconds FROM (
    SELECT source_name, count(*) AS fetches, count(*) FILTER (ok) AS successes, count(*) FILTER (since = 0) AS consecutive_failures, bool_or(gone) FILTER (back = 1) AS gone,
      floor(count(*) FILTER (ok) / count(*) * 10000 + 0.5) / 100 AS success_rate FROM runs GROUP BY source_name))"""
LADDER = f"""ladder AS (
  SELECT a.article_id, a.direction, a.title, CASE WHEN a.article_id % 4 = 0 AND floor(({NOW} - epoch(a.published_at)) / 86400) > 7 THEN 'stale' WHEN h.fetches >= 3 AND h.consecutive_failures >= 2 THEN 'source_unreliable'
    WHEN a.article_id % 13 = 0 THEN 'link_dead' WHEN a.article_id % 17 = 0 THEN 'link_probe_review' END AS reason
  FROM articles a LEFT JOIN health h USING (source_name) WHERE a.status = 'published')"""
DIMENSIONS = "dimensions(direction, direction_no, dimension, dimension_no, weight) AS (VALUES " + ", ".join(f"('{d}', {i}, '{x}', {j}, CAST({w} AS DOUBLE))" for i, (d, of) in enumerate(WEIGHTS.items(), 1) for j, (x, w) in enumerate(of.items(), 1)) + ")"
EVIDENCE = rf"""{DIMENSIONS}, words AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([a-z0-9][a-z0-9_+#.\-]*[a-z0-9])', 1)) AS term FROM benchmark), dealt AS (
  SELECT term, row_number() OVER (ORDER BY md5(term), term) - 1 AS no FROM words WHERE length(term) >= 4), lexicon AS (
  SELECT s.direction, s.dimension, CASE WHEN (no // 71) % 3 = 0 THEN 'strong' ELSE 'weak' END AS kind, term FROM dealt JOIN (SELECT *, row_number() OVER (ORDER BY direction_no, dimension_no) - 1 AS slot FROM dimensions) s ON no % 71 = slot), cut AS (
  SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS no FROM (SELECT doc_id, {sentences('text')} AS ss FROM documents)), tokens AS (
  SELECT doc_id, no, sentence, list_distinct(regexp_extract_all(lower(sentence), '([a-z0-9][a-z0-9_+#.\-]*[a-z0-9])', 1)) AS t FROM cut), hits AS (
  SELECT doc_id, no, sentence, unnest(t) AS term FROM tokens WHERE NOT list_has_any(t, ['not', 'no', 'nicht', 'pas', 'never'])), evidence AS (
  SELECT *, CASE WHEN strong > 0 THEN 5.0 WHEN weak >= 2 THEN 2.5 END AS score FROM (
    SELECT doc_id, direction, dimension, count(*) FILTER (kind = 'strong') AS strong, count(DISTINCT term) FILTER (kind = 'weak') AS weak, arg_min(sentence, no) FILTER (kind = 'strong') AS quote
    FROM hits JOIN lexicon USING (term) GROUP BY ALL))"""


def story(direction: str, rule: str) -> str:
    """The rule with each name put as a test of the greatest score of its dimension."""
    one = lambda m: m[0] if m[0] in ("AND", "OR") else f"coalesce(max(score) FILTER (dimension = '{m[0].removeprefix('half_')}'), 0) >= {2.5 if m[0].startswith('half_') else 5}"
    return f"(direction = '{direction}' AND (" + re.sub(r"\w+", one, rule) + "))"


SCORES = f"""{EVIDENCE}, totals AS (
  SELECT doc_id, direction, CAST(floor(sum(score * weight) / any_value(all_weight) * 40 + 0.5) AS INT) AS raw, count(*) AS n,
    count(*) FILTER (score >= 5) >= 3 AND ({' OR '.join(story(d, w) for d, w in STORIES.items())}) AS eligible
  FROM evidence JOIN dimensions USING (direction, dimension) JOIN (SELECT direction, sum(weight * 5) AS all_weight FROM dimensions GROUP BY 1) USING (direction) WHERE score IS NOT NULL GROUP BY doc_id, direction), scores AS (
  SELECT doc_id, direction, eligible, CASE WHEN eligible AND n >= 2 THEN raw ELSE least(raw, CASE direction {' '.join(f"WHEN '{d}' THEN {m}" for d, m in CAPPED.items())} END) END AS total_score FROM totals)"""
SIGNALS, SPAM = r"\b(?:tion|thing|inter|moron|idiot)", r"\b(?:password|token)\b"


def first_with(c: str, pattern: str) -> str:
    return f"left(list_filter({sentences(c)}, lambda s: regexp_matches(s, '{pattern}'))[1], 280)"


LINKS = rf"""linked AS (
  SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '<link rel="canonical" href="https://first' || page_id % 7 || '.example.org/a?utm_source=x&b=1">' WHEN 1 THEN '<meta property="og:url" content="http://10.0.0.1/x">' ELSE '' END || html
    || '<a href="https://other' || page_id % 5 || '.example.net/p/' || page_id || '?fbclid=1#s).">x</a><a href="https://cdn.example.net/x.css">y</a>' AS html FROM pages), raw AS (
  SELECT page_id, url AS own, x.kind, x.weight, regexp_replace(x.u, '[.,;:!?)\]}}>]+\z', '') AS bare, x.pos AS pos FROM (
    SELECT page_id, url, unnest(list_concat(
      list_transform(regexp_extract_all(html, '(?i)<link[^>]+rel="canonical"[^>]+href="([^"]+)"', 1), lambda u, i: {{'kind': 'canonical', 'weight': 100, 'u': u, 'pos': i}}),
      list_transform(regexp_extract_all(html, '(?i)<meta[^>]+property="og:url"[^>]+content="([^"]+)"', 1), lambda u, i: {{'kind': 'og_url', 'weight': 90, 'u': u, 'pos': 1000 + i}}),
      list_transform(regexp_extract_all(html, '(?i)<a[^>]+href="(https?://[^"]+)"', 1), lambda u, i: {{'kind': 'body_link', 'weight': 10, 'u': u, 'pos': 2000 + i}}))) AS x FROM linked)), links AS (
  SELECT page_id, own, kind, weight, pos, {url('bare', TRACKING_FIRST, False, False)} || CASE WHEN contains(bare, '#') THEN '#' || split_part(bare, '#', -1) ELSE '' END AS url FROM raw), firsts AS (
  SELECT page_id, own, url, arg_min(kind, pos) AS kind, arg_min(weight, pos) AS weight, min(pos) AS pos FROM links GROUP BY ALL)"""

ORACLE = {
    "page_winners": f"WITH {ITEMS}, won AS (SELECT * FROM normal QUALIFY row_number() OVER (PARTITION BY dedup_url ORDER BY origin, tier, length(content) DESC, source_name, title, content_hash, url) = 1) SELECT {host('url')} AS host, count(*) AS n, max(length(title)) AS longest FROM won GROUP BY 1",
    "canonical_url": f"SELECT page_id, {canonical('url')} AS dedup_url, coalesce({url('url', TRACKING_FIRST, False, False)}, url) AS cleaned, {host('url')} AS host FROM pages",
    "url_safety": "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'local_host' WHEN 1 THEN 'private_address' WHEN 2 THEN 'private_address' WHEN 3 THEN 'local_host' WHEN 4 THEN 'userinfo' WHEN 5 THEN 'port' END AS reason FROM pages",
    "redirect_target": "SELECT page_id, url AS target FROM pages",
    "content_hash": f"WITH {ARTICLES} SELECT article_id, md5(title || chr(10) || source_name) AS content_hash, {title_key('title')} AS title_key FROM articles",
    "html_to_text": f"SELECT page_id, {title('html')} AS title, md5({plain_html('html')}) AS text_md5, length({plain_html('html')}) AS n_chars FROM pages",
    "sentence_stats": f"WITH s AS (SELECT doc_id, unnest({sentences('text')}) AS s FROM documents) SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest, min(s) AS least FROM s GROUP BY doc_id",
    "rule_summary": f"WITH {ARTICLES}, l AS (SELECT article_id, title, list_filter({sentences('text', '[。！？.!?]+')}, lambda s: length(s) > 10) AS l FROM articles), j AS (SELECT *, array_to_string(l[1:2], '。') AS j FROM l) SELECT article_id, CASE WHEN len(l) = 0 THEN title WHEN length(j) > 200 THEN left(j, 200) || '...' ELSE j END AS summary FROM j",
    "language_tag": r"""WITH t AS (SELECT lang, CASE doc_id % 4 WHEN 0 THEN '模型训练' || text WHEN 1 THEN '㐂模型' || regexp_replace(text, '[A-Za-z]', '', 'g') ELSE text END AS t FROM documents), c AS (SELECT lang, regexp_matches(t, '[\x{3400}-\x{9FFF}]') AS han, regexp_matches(t, '[A-Za-z]') AS latin FROM t)
        SELECT CASE WHEN han AND latin THEN 'mixed' WHEN han THEN 'zh' ELSE 'non_zh' END AS tag, lang, count(*) AS n FROM c GROUP BY ALL""",
    "shanghai_day": "SELECT CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "age_days": f"WITH {ARTICLES} SELECT article_id, CAST(greatest(0, floor(({NOW} - epoch(published_at)) / 86400)) AS INT) AS age_days FROM articles",
    "source_health": f"WITH {HEALTH} SELECT source_name, fetches, successes, consecutive_failures, success_rate, cooldown_seconds FROM health",
    "direction_normalize": f"WITH r AS (SELECT {texts([*ALIASES, *NAMES, 'other'])}[user_id % 15 + 1] AS raw FROM events), n AS (SELECT CASE raw {' '.join(f'''WHEN '{a}' THEN '{b}' ''' for a, b in ALIASES.items())} ELSE raw END AS d FROM r) SELECT CASE WHEN d IN ({', '.join(f'''{n!r}''' for n in NAMES)}) THEN d END AS direction, count(*) AS n FROM n GROUP BY 1",
    "drop_reasons": f"WITH {ITEMS} SELECT drop_reason, count(*) AS n FROM reasons GROUP BY 1",
    "dedup_batch": f"WITH {ITEMS} SELECT item_id, dedup_url, content_hash FROM normal QUALIFY row_number() OVER (PARTITION BY dedup_url ORDER BY origin, tier, length(content) DESC, source_name, title, content_hash, url) = 1",
    "dedup_vs_history": f"WITH {ITEMS} SELECT item_id, dedup_url FROM normal n WHERE item_id % 6 <> 1 AND NOT EXISTS (SELECT 1 FROM normal h WHERE h.item_id % 6 = 1 AND (h.dedup_url = n.dedup_url OR h.content_hash = n.content_hash))",
    "snapshot_upsert": f"WITH {ARTICLES} SELECT article_id, CAST(CASE WHEN article_id % 3 = 0 THEN score + 1000 ELSE score END AS INT) AS score, status FROM articles",
    "duplicate_gate": f"""WITH {ITEMS}, k AS (SELECT item_id AS a, dedup_url AS u, {title_key('title')} AS t, item_id * 613 % 86400 AS c, CASE WHEN item_id % 5 = 1 THEN 1 ELSE 0 END AS g FROM normal), o AS (
        SELECT a, g, (SELECT arg_min(b.a, (b.c, b.a)) FROM k b WHERE b.g = 1 AND b.u = k.u) AS ou, (SELECT arg_min(b.a, (b.c, b.a)) FROM k b WHERE b.g = 1 AND b.t = k.t AND k.t <> '') AS ot, (SELECT arg_min(b.a, (b.c, b.a)) FROM k b WHERE b.g = 0 AND b.u = k.u) AS nu, (SELECT arg_min(b.a, (b.c, b.a)) FROM k b WHERE b.g = 0 AND b.t = k.t AND k.t <> '') AS nt FROM k)
        SELECT a AS article_id, CASE WHEN ou <> a THEN 'same_url' WHEN ot <> a THEN 'same_title' WHEN nu <> a THEN 'same_batch_url' WHEN nt <> a THEN 'same_batch_title' END AS reason FROM o WHERE g = 0 AND (ou <> a OR ot <> a OR nu <> a OR nt <> a)""",
    "eligible_sources": f"WITH {SOURCES} SELECT source_name, tier, {stamp('next_fetch_at')} AS next_fetch_at FROM sources WHERE enabled AND (next_fetch_at IS NULL OR next_fetch_at <= {at(str(DAY0 + 9 * 86400))})",
    "hot_articles_page": f"WITH {ARTICLES}, {SOURCES}, page AS (SELECT * FROM articles WHERE status = 'published' AND score >= 75 AND direction IS NOT NULL ORDER BY score DESC, published_at DESC, article_id LIMIT 20 OFFSET 20) SELECT article_id, title, score, direction, tier, CASE WHEN cluster_id IS NULL THEN 1 ELSE (SELECT count(*) FROM articles b WHERE b.cluster_id = page.cluster_id) END AS cluster_size FROM page LEFT JOIN sources USING (source_name)",
    "workbench_overview": f"WITH {ARTICLES} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("published", "draft", "pending_review", "blocked")) + ", count(*) FILTER (ai_processed) AS ai_processed FROM articles",
    "workbench_articles": f"WITH {ARTICLES} SELECT article_id, title, score, {stamp('published_at')} AS published_at FROM (SELECT * FROM articles WHERE status = 'draft' AND direction = 'coding' ORDER BY published_at DESC, article_id LIMIT 50)",
    "score_merge": f"""WITH {ARTICLES}, r AS (SELECT article_id, direction, score, run FROM articles, (VALUES (0), (1)) v(run) WHERE direction IS NOT NULL), t AS (SELECT article_id, direction, CAST(max(score + run * (article_id % 7)) AS INT) AS total_score FROM r GROUP BY ALL), e AS (
        SELECT article_id, direction, 'first' AS k, score % 3 * 2.5 AS v FROM r UNION ALL SELECT article_id, direction, 'second', (score + run) % 3 * 2.5 FROM r UNION ALL SELECT article_id, direction, 'own' || run, 5.0 FROM r), m AS (SELECT article_id, direction, k, max(v) AS v FROM e GROUP BY ALL)
        SELECT article_id, direction, total_score, string_agg(k || '=' || CAST(CAST(v AS DECIMAL(3,1)) AS VARCHAR), ',' ORDER BY k) AS dimensions FROM m JOIN t USING (article_id, direction) GROUP BY ALL""",
    "quality_ladder": f"WITH {ARTICLES}, {HEALTH}, {LADDER} SELECT article_id, reason FROM ladder",
    "quality_gate_list": f"WITH {ARTICLES}, {HEALTH}, {LADDER} SELECT reason, direction, count(*) AS n, min(title) AS first_title FROM ladder WHERE reason IS NOT NULL GROUP BY ALL",
    "review_list": f"WITH {ARTICLES}, r AS (SELECT doc_id + CASE WHEN doc_id % 19 = 0 THEN 1000000000 ELSE 0 END AS article_id FROM labels WHERE quality = 0) SELECT article_id, coalesce(title, '') AS title, coalesce(status, '') AS status FROM r LEFT JOIN articles USING (article_id)",
    "auto_approve": f"WITH {ARTICLES} SELECT article_id, score FROM articles WHERE status = 'pending_review' AND score >= 60 AND collected_at < {at(str(NOW - 86400))} AND article_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id % 2 = 0)",
    "revalidation": f"WITH {ARTICLES} SELECT article_id, {stamp('collected_at')} AS collected_at FROM (SELECT * FROM articles WHERE status = 'published' ORDER BY collected_at, article_id LIMIT 200)",
    "digest_day": f"WITH {ARTICLES}, d AS (SELECT *, CAST(CAST(coalesce(published_at, collected_at) + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day FROM articles WHERE status = 'published' AND direction IS NOT NULL AND score IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY article_id) AS n FROM d) SELECT day, count(*) AS article_count, '今日共 ' || count(*) || ' 条 AI 热点：' || string_agg(n || '. ' || title || ' (' || score || '分)', '；' ORDER BY n) AS summary, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY n) AS article_ids FROM n GROUP BY day",
    "ai_admission": f"""WITH {ARTICLES}, {SOURCES}, a AS (SELECT article_id, source_name, source_no % 3 AS tier, ai_processed, status FROM articles), used AS (SELECT source_name, count(*) AS n FROM a WHERE ai_processed AND status = 'blocked' GROUP BY 1), c AS (
        SELECT article_id, tier, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY source_name ORDER BY tier, article_id) AS turn FROM a LEFT JOIN used USING (source_name) WHERE NOT ai_processed), o AS (SELECT *, row_number() OVER (ORDER BY tier, n, article_id) AS seat FROM c WHERE turn + n <= 30)
        SELECT article_id, CAST(turn AS INT) AS turn, CAST(seat AS INT) AS seat FROM o WHERE seat + coalesce((SELECT sum(n) FROM used), 0) <= 500""",
    "publish_gate": f"""WITH {ARTICLES} SELECT article_id, direction IS NOT NULL AND status NOT IN ('pending_review', 'blocked') AND (article_id % 3 < 2 OR article_id % 10 = 2) AND (article_id % 4 = 0 OR ai_processed) AND score >= 50 AND NOT (article_id % 3 = 2 AND article_id % 2 = 1) AS publish FROM articles""",
    "cluster_representatives": f"WITH {ARTICLES} SELECT coalesce(cluster_id, 'article:' || article_id) AS cluster_key, article_id, score FROM articles WHERE status = 'published' QUALIFY row_number() OVER (PARTITION BY coalesce(cluster_id, 'article:' || article_id) ORDER BY score DESC, published_at DESC, article_id) = 1",
    "content_filter": f"""WITH {ARTICLES}, x AS (SELECT article_id, published_at, CASE WHEN article_id % 29 <> 0 THEN title ELSE '' END AS t, CASE WHEN article_id % 31 <> 0 THEN text ELSE '<p>&nbsp;</p>' END AS c FROM articles), b AS (SELECT *, t || chr(10) || c AS both_ FROM x), d AS (
        SELECT *, CASE WHEN t = '' THEN 'missing_title' WHEN trim(regexp_replace(c, '(?i)<[^>]*>|&nbsp;', '', 'g')) = '' THEN 'empty_body' WHEN regexp_matches(both_, '{SPAM}') THEN 'spam' WHEN NOT regexp_matches(both_, '{SIGNALS}') THEN 'non_topic' WHEN floor(({NOW} - epoch(published_at)) / 86400) > 12 THEN 'stale_content' WHEN length(c) < 40 THEN 'too_short' ELSE 'eligible_content' END AS reason_code FROM b)
        SELECT article_id, CASE WHEN reason_code IN ('stale_content', 'too_short') THEN 'review' WHEN reason_code = 'eligible_content' THEN 'candidate' ELSE 'reject' END AS decision, reason_code,
          md5(coalesce(CASE reason_code WHEN 'missing_title' THEN left(trim(c), 280) WHEN 'empty_body' THEN left(trim(t), 280) WHEN 'spam' THEN {first_with('both_', SPAM)} WHEN 'non_topic' THEN left(({sentences('c')})[1], 280) WHEN 'too_short' THEN left(trim(c), 280) ELSE {first_with('both_', SIGNALS)} END, '')) AS quote_md5 FROM d""",
    "evidence_by_dimension": f"WITH {EVIDENCE} SELECT direction, dimension, CAST(score AS DOUBLE) AS score, count(*) AS n, count(*) FILTER (score = 5) AS n_quotes, sum(length(quote)) FILTER (score = 5) AS quote_chars FROM evidence WHERE score IS NOT NULL GROUP BY direction, dimension, score",
    "direction_scores": f"WITH {SCORES} SELECT doc_id, direction, total_score, eligible FROM scores",
    "classify": f"""WITH {SCORES}, r AS (SELECT doc_id, direction, total_score, row_number() OVER (PARTITION BY doc_id ORDER BY total_score DESC, direction_no) AS r FROM scores JOIN (SELECT DISTINCT direction, direction_no FROM dimensions) USING (direction) WHERE eligible AND total_score > 0), t AS (
        SELECT doc_id, max(direction) FILTER (r = 1) AS first, max(total_score) FILTER (r = 1) AS best, max(total_score) FILTER (r = 2) AS next FROM r GROUP BY doc_id)
        SELECT doc_id, CASE WHEN best IS NULL THEN 'no_match' WHEN next IS NOT NULL AND best - next <= 3 THEN 'ambiguous' ELSE 'classified' END AS status, CASE WHEN NOT (next IS NOT NULL AND best - coalesce(next, 0) <= 3) THEN first END AS direction, best, best - coalesce(next, 0) AS margin FROM (SELECT DISTINCT doc_id FROM scores) LEFT JOIN t USING (doc_id)""",
    "link_candidates": f"WITH {LINKS} SELECT page_id, kind, count(*) AS n, min(url) AS first_url FROM firsts GROUP BY ALL",
    "origin_trace": rf"""WITH {LINKS}, o AS (SELECT * FROM firsts WHERE {host('url')} <> {host('own')} AND NOT regexp_matches({piece('url', 'path')}, '(?i)\.(?:css|js|png|jpe?g|gif|svg|ico|woff2?|pdf|zip|xml|rss|atom|json)$')) SELECT page_id, arg_min(url, (-weight, pos)) AS origin, arg_min(kind, (-weight, pos)) AS kind, arg_min(kind, (-weight, pos)) = 'body_link' AS needs_review FROM o WHERE {piece('url', 'host')} <> '10.0.0.1' GROUP BY page_id""",
    "api_items": f"SELECT event_id // 10 AS source_id, event_type AS title, 'https://x.example/' || event_id AS url, props AS content, {stamp('date_trunc(''second'', ts)').replace(chr(39)*4, chr(39)*2)} AS published_at FROM events",
    "hotlist_rank": "SELECT * FROM (SELECT event_type AS kind, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INT) AS rank, 'a b ' || user_id AS title, 'https://search.example/?q=a%20b%20' || user_id AS url FROM events WHERE event_id % 9 <> 0 AND event_id % 7 <> 0) WHERE rank <= 50",
    "source_categories": f"WITH {SOURCES} SELECT category, tier, count(*) AS n, count(*) FILTER (enabled) AS enabled FROM sources GROUP BY ALL",
}
ORACLE["api_items"] = "SELECT event_id // 10 AS source_id, event_type AS title, 'https://x.example/' || event_id AS url, props AS content, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS published_at FROM events"
KINDS = [
    ("release", "release|launch|上线|发布|推出|开源"), ("funding", r"funding|series\s*[a-f]|融资|估值|投资"), ("acquisition", "acqui(?:re|sition)|并购|收购"), ("benchmark", "benchmark|leaderboard|mmlu|swe[-_ ]?bench|评测|基准"),
    ("policy", "policy|regulation|governance|政策|监管|治理"), ("partnership", "partnership|partner|contract|合作|签约|合同"), ("research", "paper|study|研究|论文|报告"),
]
KIND = "CASE " + " ".join(f"WHEN regexp_matches(title || chr(10) || text, '(?i){p}') THEN '{k}'" for k, p in KINDS) + " ELSE 'other' END"
PART = lambda x: f"CAST(greatest(0, least(20, floor({x} + 0.5))) AS INT)"
ORACLE |= {
    "role_envelopes": f"""WITH {ARTICLES}, f AS (SELECT *, CASE WHEN article_id % 7 = 0 OR article_id % 5 = 0 OR len({sentences('text')}) = 0 THEN 'rejected' ELSE 'accepted' END AS filter, {KIND} AS kind FROM articles)
        SELECT article_id, filter, CASE filter WHEN 'rejected' THEN 'skipped' ELSE 'accepted' END AS event, kind, CASE filter WHEN 'rejected' THEN 'skipped' ELSE 'accepted' END AS summary, left(sha256('filter' || chr(10) || article_id || chr(10) || title || chr(10) || text), 32) AS key FROM f""",
    "review_actions": f"WITH {ARTICLES} SELECT article_id, CASE WHEN status = 'pending_review' AND quality = 1 THEN 'draft' WHEN status = 'pending_review' AND quality = 0 THEN 'blocked' ELSE status END AS status, article_id % 10 = 2 OR coalesce(status = 'pending_review' AND quality = 1, false) AS override FROM articles",
    "event_kinds": f"WITH {ARTICLES} SELECT {KIND} AS kind, status, count(*) AS n FROM articles GROUP BY ALL",
}
ORACLE |= {
    "display_title": f"WITH {ARTICLES}, c AS (SELECT article_id, {collapsed('title')} AS c FROM articles) SELECT article_id, CASE WHEN length(c) > 46 THEN rtrim(left(c, 45)) || '…' ELSE c END AS shown FROM c",
    "rescore_pending": f"WITH {ARTICLES} SELECT article_id, length(coalesce({collapsed('title')}, '') || coalesce({collapsed('text')}, '')) >= 12 AS ready FROM articles WHERE status = 'draft' AND NOT (article_id % 4 = 0) AND CAST(collected_at + INTERVAL 8 HOUR AS DATE) = CAST({at(str(DAY0 + 10 * 86400))} + INTERVAL 8 HOUR AS DATE)",
    "source_validation": rf"""SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'name' WHEN page_id % 4 = 3 THEN 'feed_type' WHEN page_id % 5 = 3 THEN 'tier' WHEN page_id % 6 = 0 THEN 'url' WHEN page_id % 7 = 2 THEN 'policy' WHEN page_id % 7 = 0 AND page_id % 5 = 0 THEN 'policy_tier' END AS problem,
        regexp_replace(regexp_replace({canonical('url')}, '/+\?', '?'), '/+$', '') AS feed_url FROM pages""",
}

FOUND = r"regexp_extract_all(title || chr(10) || text, '(OpenAI|Anthropic|Google|Microsoft|Meta|NVIDIA|Amazon|阿里|腾讯|百度|字节|英伟达|谷歌|微软|苹果|[A-Z][A-Za-z0-9_-]{2,})', 1)"
EVENT = rf"""named AS (
  SELECT article_id, x, min(i) AS i FROM (SELECT article_id, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM (SELECT article_id, {FOUND} AS f FROM articles)) GROUP BY ALL), entities AS (
  SELECT article_id, list(x ORDER BY x) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY i) AS n FROM named) WHERE n <= 12 GROUP BY article_id), event AS (
  SELECT article_id, title, {KIND} AS kind, coalesce(entities, []) AS entities FROM articles LEFT JOIN entities USING (article_id)), terms AS (
  SELECT *, left(sha256(kind || chr(10) || array_to_string(entities, '|') || chr(10) || title), 24) AS event_key, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || array_to_string(entities, ' ')), '([\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_-]*)', 1), lambda w: length(w) >= 2)))[1:12] AS terms FROM event)"""
ORGANISATIONS = ["apache", "creative commons", "mozilla"]
IMPACT = ["impact", "significant", "breakthrough", "revolutionary", "game-changer", "first", "record", "重大", "突破", "首次", "里程碑", "milestone", "industry-first"]
QUALITY = rf"""rated AS (
  SELECT article_id AS doc_id, least(10, CASE source_no % 3 WHEN 0 THEN 10 WHEN 1 THEN 8 ELSE 5 END) + least(6, CASE WHEN regexp_matches(t, '[0-9][0-9,.]*%|\$[0-9,.]+[BMKbmk]?|[0-9]{{2,}}') THEN 4 ELSE 0 END + CASE WHEN {' OR '.join(f"contains(lower(t), '{o}')" for o in ORGANISATIONS)} THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, 'https?://[^\s)]+') THEN 3 ELSE 0 END)
    + least(4, length(t) // 1200) + least(4, {' + '.join(f"CASE WHEN contains(lower(t), '{w}') THEN 2 ELSE 0 END" for w in IMPACT)}) AS quality FROM (SELECT article_id, source_no, title || chr(10) || text AS t FROM articles))"""
ORACLE |= {
    "event_recognition": f"WITH {ARTICLES}, {EVENT} SELECT article_id, kind, array_to_string(entities, ',') AS entities, event_key, 'evt_' || left(sha256(kind || chr(10) || array_to_string(terms, '|')), 24) AS cluster_key, CASE WHEN kind = 'other' OR len(terms) < 2 THEN 'review' ELSE 'approve' END AS decision, CASE WHEN kind = 'other' THEN 'missing_event' WHEN len(terms) < 2 THEN 'weak_signal' ELSE 'consistent' END AS reason FROM terms",
    "publish_score": f"WITH {SCORES}, {ARTICLES}, {QUALITY}, best AS (SELECT doc_id, direction AS d, total_score AS s FROM scores JOIN (SELECT DISTINCT direction, direction_no FROM dimensions) USING (direction) WHERE eligible QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total_score DESC, direction_no) = 1) SELECT doc_id, CASE WHEN s >= 10 THEN d END AS primary_direction, CASE WHEN s >= 10 THEN s ELSE 0 END AS primary_score, CAST(quality AS INT) AS quality, CAST(least(100, CASE WHEN s >= 10 THEN s ELSE 0 END * 2 + quality) AS INT) AS publish_score FROM rated LEFT JOIN best USING (doc_id)",
    "insert_if_absent": f"WITH {ITEMS}, won AS (SELECT * FROM normal WHERE item_id % 6 <> 1 QUALIFY row_number() OVER (PARTITION BY dedup_url ORDER BY origin, tier, length(content) DESC, source_name, title, content_hash, url) = 1), old AS (SELECT * FROM normal WHERE item_id % 6 = 1), ins AS (SELECT * FROM won w WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.dedup_url = w.dedup_url)) SELECT (SELECT count(*) FROM won) AS given, (SELECT count(*) FROM ins) AS inserted, (SELECT count(*) FROM won) - (SELECT count(*) FROM ins) AS conflicts",
    "dedup_given_hashes": f"""WITH RECURSIVE {ITEMS}, o AS (SELECT item_id, dedup_url AS u, 'h' || item_id % 120 AS h, row_number() OVER (ORDER BY origin, tier, length(content) DESC, source_name, title, 'h' || item_id % 120, url, item_id) AS n FROM normal), walk AS (
        SELECT 0::BIGINT AS n, []::VARCHAR[] AS us, []::VARCHAR[] AS hs, NULL::BIGINT AS item_id, false AS stays UNION ALL
        SELECT o.n, CASE WHEN NOT list_contains(us, u) AND NOT list_contains(hs, h) THEN list_append(us, u) ELSE us END, CASE WHEN NOT list_contains(us, u) AND NOT list_contains(hs, h) THEN list_append(hs, h) ELSE hs END, o.item_id, NOT list_contains(us, u) AND NOT list_contains(hs, h) FROM walk JOIN o ON o.n = walk.n + 1)
        SELECT item_id FROM walk WHERE stays""",
    "stage_counters": f"WITH {ITEMS}, won AS (SELECT * FROM normal QUALIFY row_number() OVER (PARTITION BY dedup_url ORDER BY origin, tier, length(content) DESC, source_name, title, content_hash, url) = 1) SELECT 'normalize' AS stage, coalesce(drop_reason, 'ok') AS reason, count(*) AS n FROM reasons GROUP BY ALL UNION ALL SELECT 'dedup', CASE WHEN item_id IN (SELECT item_id FROM won) THEN 'ok' ELSE 'duplicate' END, count(*) FROM normal GROUP BY ALL",
    "article_search": f"WITH {ARTICLES} SELECT article_id, title FROM articles WHERE contains(lower(title), 'the') AND direction IN ('model', 'coding', 'agent') AND score >= 20",
    "published_ids": f"WITH {ARTICLES} SELECT DISTINCT article_id FROM articles WHERE collected_at >= {at(str(NOW - 86400))} OR (status = 'draft' AND article_id % 4 <> 0) OR (status = 'pending_review' AND score >= 60) OR status = 'published'",
    "direction_rewrite": f"WITH {ARTICLES}, r AS (SELECT article_id, d AS direction, CASE WHEN article_id % 5 = 0 THEN 1 ELSE 0 END AS run FROM articles, (SELECT unnest({texts(NAMES)}) AS d)) SELECT a.direction, r.run, count(*) AS n FROM r JOIN articles a ON a.article_id = r.article_id AND a.direction = r.direction WHERE a.status <> 'blocked' GROUP BY ALL",
    "article_trace": f"WITH {ARTICLES}, {LINKS}, o AS (SELECT page_id, arg_min(url, (-weight, pos)) AS origin FROM firsts WHERE {host('url')} <> {host('own')} AND {piece('url', 'host')} <> '10.0.0.1' AND NOT regexp_matches({piece('url', 'path')}, '(?i)\\.css$') GROUP BY page_id) SELECT article_id, status, coalesce(origin, '') AS origin, CASE WHEN origin IS NULL THEN 'untraced' ELSE 'traced' END AS trace_status FROM articles LEFT JOIN o ON page_id = article_id",
}

SURE = r"(?i)\b(?:not|no|without|never|failed|unavailable|rumored|rumour|pending|intent(?:s|ion)?|intend(?:s|ed)?|plans?\s+to|will|shall|may|might|could|preview|demo)\b|未|没有|待|计划|拟|预计|(?:^|[^已])将|意图|打算|传闻|据称|可能|预览|演示"
RULES = [
    ("model", "entity", "(?i)(?:apache|mozilla)|(?i)(?:public licen[sc]e)", ["version", "license"]), ("agent", "tool_call", r"\btoken\b", ["password", "secret", "key"]),
    ("coding", "code_gen", r"[a-z]+tion [a-z]+ing\b", ["thing", "inter", "ouea"]), ("multimodal", "quality", "", ["des", "les", "der"]), ("data_eval", "coverage", "模型.{0,9}上线", ["训练"]),
]


def tested(direction: str, dimension: str, strong: str, weak: list[str]) -> str:
    first = f"list_filter(sure, lambda s: regexp_matches(s, '{strong}'))[1]" if strong else "NULL::VARCHAR"
    held = " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in weak)
    return f"SELECT doc_id, '{direction}' AS direction, '{dimension}' AS dimension, {first} AS quote, {held} AS weak FROM s"


ORACLE |= {
    "evidence_patterns": f"WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '模型训练后上线。' WHEN 1 THEN '模型计划上线。' ELSE '' END || text AS text FROM documents), s AS (SELECT doc_id, sure, lower(array_to_string(sure, chr(10))) AS low FROM (SELECT doc_id, list_filter({sentences('text')}, lambda s: NOT regexp_matches(s, '{SURE}')) AS sure FROM d)), e AS ({' UNION ALL '.join(tested(*r) for r in RULES)}) SELECT doc_id, direction, dimension, CAST(CASE WHEN quote IS NOT NULL THEN 5 ELSE 2.5 END AS DOUBLE) AS score, md5(coalesce(quote, '')) AS quote_md5 FROM e WHERE quote IS NOT NULL OR weak >= 2",
    "score_combine": f"WITH {EVIDENCE}, c AS (SELECT direction, dimension, CAST(CASE WHEN doc_id % 3 <> 0 THEN score ELSE least(score, 2.5) END AS DOUBLE) AS score FROM evidence WHERE score IS NOT NULL) SELECT direction, dimension, score, count(*) AS n FROM c GROUP BY ALL",
    "parse_dispatch": f"SELECT page_id AS source_id, ['web', 'api', 'rss', 'ftp', 'api'][page_id % 5 + 1] AS feed_type, CASE WHEN page_id % 5 = 0 THEN coalesce({title('html')}, '') WHEN page_id % 5 IN (1, 2) THEN 't' || page_id ELSE '' END AS title, CASE WHEN page_id % 5 < 2 THEN url WHEN page_id % 5 = 2 THEN 'g' || page_id ELSE '' END AS url, CASE page_id % 5 WHEN 3 THEN 'unknown_type' WHEN 4 THEN 'no_items' END AS error FROM pages",
}


def inside(c: str, tag: str) -> str:
    return rf"nullif(regexp_extract({c}, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1), '')"


def bare(c: str) -> str:
    for tag in ("nav", "header", "footer", "aside", "form"):
        c = rf"regexp_replace({c}, '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')"
    return c


BARE = "regexp_replace(regexp_replace(title, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')"
ORACLE |= {
    "page_items": f"""WITH p AS (SELECT page_id, html, {title('html')} AS title, coalesce({inside('html', 'article')}, {inside('html', 'main')}, {inside('html', 'body')}, '') AS body, nullif(regexp_extract(html, '(?i)<meta[^>]+name="description"[^>]+content="([^"]*)"', 1), '') AS told, lower(left(html, 20000)) AS head FROM pages),
        b AS (SELECT *, {bare('body')} AS cut FROM p), t AS (SELECT *, {plain_html('cut')} AS text FROM b)
        SELECT page_id, title, md5(coalesce(CASE WHEN length(text) >= 40 THEN left(text, 10000) ELSE told END, '')) AS content_md5, CASE WHEN length(text) >= 40 THEN 'full' WHEN told IS NOT NULL THEN 'summary' ELSE 'missing' END AS content_kind,
          regexp_matches(head, 'captcha|verify you are human') OR (regexp_matches(head, 'log ?in|sign ?in') AND contains(head, 'type="password"')) OR regexp_matches(head, '<title>[^<]*(?:404|not found)') AS blocked FROM t""",
    "feed_items": rf"""WITH {ARTICLES}, f AS (SELECT article_id AS source_id, nullif(trim({BARE} || 'x'), '') AS title, 'https://f.example/' || article_id AS url, nullif(trim(regexp_replace(text, '[^\p{{L}}\p{{N}} .,]', ' ', 'g')), '') AS body FROM articles)
        SELECT source_id, title, url, body AS content, CASE WHEN body IS NULL THEN 'missing' ELSE 'summary' END AS content_kind, '2024-01-02 10:00:00' AS published_at FROM f WHERE source_id % 2 = 0
        UNION ALL SELECT source_id, 'y', 'g', NULL, 'missing', NULL FROM f WHERE source_id % 2 = 0 UNION ALL SELECT source_id, title, url, 's', 'summary', '2024-01-02 10:00:00' FROM f WHERE source_id % 2 = 1""",
    "evidence_validate": rf"""WITH {ARTICLES}, i AS (SELECT article_id AS i, title, regexp_replace(lower(split_part(title, ' ', 1)), '[\s\p{{P}}\p{{S}}]', '', 'g') AS word FROM articles WHERE title <> ''), s AS (
        SELECT CASE WHEN i % 2 = 0 THEN 'model' ELSE 'agent' END AS direction, CASE WHEN i % 5 = 0 OR {trimmed('title')} = '' THEN 0.0 WHEN i % 3 <> 0 AND NOT (i % 2 = 0 AND word <> '' AND i % 4 = 0) THEN 2.5 WHEN i % 3 = 0 THEN 2.5 ELSE 5.0 END AS score FROM i)
        SELECT direction, CAST(score AS DOUBLE) AS score, count(*) AS n, count(*) FILTER (score > 0) AS quoted FROM s GROUP BY ALL""",
}

ORACLE |= {
    "fetch_checks": f"SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'unknown_type' WHEN ['web', 'web', 'api'][page_id % 3 + 1] <> ['rss', 'web', 'api'][page_id % 4 + 1] THEN 'format_mismatch' END AS problem, CASE page_id % 3 WHEN 0 THEN page_id * 7000 WHEN 2 THEN (1705968000 - {NOW}) * 1000 END AS wait_ms FROM pages",
    "nine_scores": f"WITH {ARTICLES}, d AS (SELECT unnest({texts(NAMES)}) AS name), a AS (SELECT * FROM articles WHERE direction IS NOT NULL), t AS (SELECT article_id, direction, max(score + run * (article_id % 7)) AS total FROM a, (VALUES (0), (1)) v(run) GROUP BY ALL) SELECT d.name AS direction, count(*) AS n, CAST(coalesce(sum(total), 0) AS BIGINT) AS total, CAST(count(total) * 4 AS BIGINT) AS dimensions FROM a CROSS JOIN d LEFT JOIN t ON t.article_id = a.article_id AND t.direction = d.name GROUP BY d.name",
    "cluster_history": f"WITH {ARTICLES} SELECT article_id, {stamp('collected_at')} AS collected_at FROM (SELECT * FROM articles WHERE collected_at >= {at(str(NOW - 72 * 3600))} AND collected_at < {at(str(NOW))} ORDER BY collected_at DESC, article_id LIMIT 1200)",
}

ORACLE["trending_rows"] = f"SELECT page_id, CAST(k AS INT) AS rank, 'own' || page_id || '/repo' AS name, {trimmed(f"regexp_replace({title('html')}, '[<>&]', '', 'g') || ' & more'")} AS description, 'Lang' || page_id % 4 AS language, k * 1000 + page_id % 1000 AS stars, page_id % 50 AS stars_new FROM pages, (VALUES (1), (3)) v(k)"

ORACLE |= cluster_sql.queries(ARTICLES, lambda c: collapsed(composed(c)))

ORACLE |= {
    "evidence_phrases": rf"""WITH {DIMENSIONS}, slots AS (SELECT direction, dimension, row_number() OVER (ORDER BY direction_no, dimension_no) - 1 AS slot FROM dimensions),
        w AS (SELECT list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
        p AS (SELECT phrase, min(i) - 1 AS place FROM (SELECT unnest(range(1, len(w))) AS i, w[i] || ' ' || w[i + 1] AS phrase FROM w) GROUP BY phrase),
        rules AS (SELECT direction, dimension, phrase, place % 3 = 0 AS strong FROM p JOIN slots ON slot = CAST('0x' || left(md5(phrase), 6) AS BIGINT) % 71),
        s AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS no FROM (SELECT doc_id, list_filter({sentences('text')}, lambda s: NOT regexp_matches(s, '{SURE}')) AS ss FROM documents)),
        h AS (SELECT * FROM s JOIN rules ON contains(lower(sentence), phrase) AND (NOT strong OR contains(sentence, phrase || ' ') OR contains(sentence, phrase || ',') OR contains(sentence, phrase || '.')))
        SELECT doc_id, direction, dimension, CAST(CASE WHEN count(*) FILTER (strong) > 0 THEN 5 ELSE 2.5 END AS DOUBLE) AS score, md5(coalesce(arg_min(sentence, no) FILTER (strong), '')) AS quote_md5
        FROM h GROUP BY ALL HAVING count(*) FILTER (strong) > 0 OR count(DISTINCT phrase) FILTER (NOT strong) >= 2""",
}


def attribute(c: str, name: str) -> str:
    return rf"""trim(regexp_extract({c}, '(?i){name}\s*=\s*["\x27]([^"\x27]*)["\x27]', 1))"""


ORACLE |= {
    "api_nested": rf"""WITH p AS (SELECT page_id AS i, {title('html')} AS t, md5(html) AS h, 'https://' || {host('url')} || '/p/' || page_id AS link FROM pages),
        n AS (SELECT *, CASE WHEN regexp_matches(t, '[<&]') THEN {plain_html('t')} ELSE {collapsed('t')} END AS clean FROM p)
        SELECT i AS source_id, 1 AS no, CASE WHEN clean <> '' THEN clean END AS title, CASE WHEN clean <> '' THEN link END AS url, CASE WHEN clean <> '' THEN h END AS content, CASE WHEN clean <> '' THEN 'summary' END AS content_kind, CASE WHEN clean = '' THEN 'no_title_or_link' END AS skipped, NULL AS error FROM n WHERE i % 7 < 4
        UNION ALL SELECT i, 2, 'R & S', 'https://g.example/' || i, 't', 'full', NULL, NULL FROM n WHERE i % 7 < 4
        UNION ALL SELECT i, 3, NULL, NULL, NULL, NULL, 'no_title_or_link', NULL FROM n WHERE i % 7 < 4 UNION ALL SELECT i, 4, NULL, NULL, NULL, NULL, 'not_an_object', NULL FROM n WHERE i % 7 < 4
        UNION ALL SELECT i, unnest([1, 2]), NULL, NULL, NULL, NULL, 'not_an_object', NULL FROM n WHERE i % 7 = 6
        UNION ALL SELECT i, NULL, NULL, NULL, NULL, NULL, NULL, CASE i % 7 WHEN 4 THEN 'unrecognized' WHEN 5 THEN 'invalid_json' ELSE 'no_items' END FROM n WHERE i % 7 >= 4""",
    "page_metadata": rf"""WITH p AS (SELECT page_id AS i, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '(?i)</?title', '<x', 'g') ELSE html END AS html FROM pages),
        q AS (SELECT i, html, list_transform(regexp_extract_all(html, '(?i)<meta\s+([^>]+)>', 1), lambda m: struct_pack(n := lower(coalesce(nullif({attribute('m', 'property')}, ''), {attribute('m', 'name')})), c := {attribute('m', 'content')})) AS own,
            list_transform(list_filter(regexp_extract_all(html, '(?i)<link\s+([^>]+)>', 1), lambda m: regexp_matches(m, '(?i)\brel\s*=\s*["\x27][^"\x27]*canonical')), lambda m: {attribute('m', 'href')}) AS links FROM p),
        r AS (SELECT *, list_filter(CASE WHEN i % 4 = 0 THEN [] ELSE [struct_pack(n := 'og:url', c := 'https://og.example/' || i), struct_pack(n := 'description', c := 'told ' || (i % 5))] END || own, lambda m: m.n <> '' AND m.c <> '') AS m, CASE WHEN i % 4 = 0 THEN [] ELSE ['/c/' || i] END || links AS l FROM q)
        SELECT i AS page_id, coalesce(nullif({title('html')}, ''), list_filter(m, lambda x: x.n = 'og:title')[1].c, CASE WHEN i % 5 <> 0 THEN 'H' || i ELSE '' END) AS title, coalesce(l[-1], '') AS canonical, coalesce(list_filter(m, lambda x: x.n = 'og:url')[-1].c, '') AS og_url,
          coalesce(list_filter(m, lambda x: x.n IN ('description', 'og:description'))[1].c, CASE WHEN i % 5 <> 0 THEN 'D' || i ELSE '' END) AS description,
          coalesce(list_filter(m, lambda x: x.n IN ('article:published_time', 'datepublished', 'date'))[1].c, CASE WHEN i % 5 <> 0 THEN '2024-01-0' || (i % 9 + 1) ELSE '' END) AS published,
          coalesce(list_filter(m, lambda x: x.n IN ('article:modified_time', 'datemodified'))[1].c, CASE WHEN i % 5 <> 0 THEN '2024-02-01' ELSE '' END) AS updated FROM r""",
}


def v4_private(n: str) -> str:
    """Whether 32 bits are a private IPv4 address."""
    a, b = f"({n} // 16777216)", f"({n} // 65536 % 256)"
    return f"({a} IN (0, 10, 127) OR {a} >= 224 OR ({a} = 169 AND {b} = 254) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} IN (0, 168)) OR ({a} = 198 AND {b} IN (18, 19, 51)) OR ({a} = 203 AND {b} = 0) OR ({a} = 100 AND {b} BETWEEN 64 AND 127))"


GROUP = "ltrim(substr(h, {}, 4), '0')"
SIX_PRIVATE = "(left({g}, 2) IN ('fc', 'fd', 'ff') OR left({g}, 3) IN ('fe8', 'fe9', 'fea', 'feb'))"
ORACLE |= {
    "address_forms": f"""WITH h AS (SELECT page_id, md5(url) AS h FROM pages), n AS (SELECT *, CAST('0x' || left(h, 8) AS BIGINT) AS n FROM h)
        SELECT page_id, CAST(form AS INT) AS form, CASE WHEN form IN (0, 1, 2, 3, 5, 6) THEN CASE WHEN {v4_private('n')} THEN 'private_address' END WHEN form = 4 THEN CASE WHEN {SIX_PRIVATE.format(g=GROUP.format(1))} THEN 'private_address' END
          WHEN form = 7 THEN CASE WHEN {SIX_PRIVATE.format(g="('f' || left(h, 3))")} THEN 'private_address' END ELSE CASE WHEN CAST('0x' || substr(h, 7, 3) AS INT) > 255 THEN 'invalid' WHEN {v4_private("(n // 256 * 256)")} THEN 'private_address' END END AS reason
        FROM n, (SELECT unnest(range(9)) AS form)""",
    "link_probe": """WITH RECURSIVE r AS (SELECT page_id AS i, 'https://site.example/p/' || page_id AS url, page_id % 10 AS k,
          CASE WHEN page_id % 10 <= 3 THEN 'https://site.example/p/' || (page_id + 1 + CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id % 4 END) WHEN page_id % 20 = 7 THEN 'https://site.example/p/' || page_id WHEN page_id % 10 = 7 THEN 'http://127.1/x' END AS target FROM pages),
        s AS (SELECT url FROM r WHERE k <> 8 UNION SELECT url FROM pages),
        w(url, here, hop, state, detail, final_url, status) AS (SELECT url, url, 0, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::INT FROM s
          UNION ALL SELECT w.url, CASE WHEN k <= 3 OR k = 7 THEN target ELSE here END, hop + 1,
            CASE WHEN k IS NULL OR k = 8 THEN 'needs_review' WHEN k <= 3 OR i % 20 = 7 THEN CASE WHEN hop = 3 THEN 'needs_review' END WHEN k = 7 THEN 'needs_review' WHEN k = 6 AND hop = 0 THEN NULL WHEN k = 4 THEN 'dead' WHEN k = 5 THEN 'needs_review' ELSE 'alive' END,
            CASE WHEN k IS NULL OR k = 8 THEN 'probe_error:no response' WHEN k <= 3 OR i % 20 = 7 THEN 'redirect_limit' WHEN k = 7 THEN 'unsafe_redirect:private_address' WHEN k = 4 THEN 'HTTP 404 for ' || here WHEN k = 5 THEN 'probe_status:503' ELSE '' END,
            CASE WHEN k IN (4, 5, 6, 9) THEN here END, CASE WHEN k = 4 THEN 404 WHEN k = 5 THEN 503 WHEN k = 7 AND i % 20 <> 7 THEN 301 WHEN k IN (6, 9) THEN 200 END
          FROM w LEFT JOIN r ON r.url = w.here WHERE state IS NULL AND hop < 4)
        SELECT url, state, detail, final_url, CAST(status AS INT) AS status, CAST(hop AS INT) AS hops FROM w WHERE state IS NOT NULL""",
}

CLAIMS = ["", "The lab launched a new api with 12% lower latency in its report.", "传闻称该模型即将发布。", "It will be the most powerful product!' || chr(10) || 'No results yet", "用户可用，论文结果公开。", "An unconfirmed release without users?", "GPT users deployed 3 billion tokens."]
TELLS = {
    "topic": r"\b(?:artificial intelligence|generative ai|machine learning|large language model|language model|foundation model|LLM|GPT|Claude|Gemini|Llama|Qwen|DeepSeek|Mistral|Gemma|Kimi|AI agents?|multimodal|model training|model inference|transformer)\b|人工智能|生成式\s*AI|机器学习|深度学习|大模型|语言模型|基础模型|智能体|多智能体|多模态|模型训练|模型推理|神经网络",
    "novelty": r"\b(?:launch(?:es|ed)?|release[ds]?|introduc(?:e[ds]?|ing)|debut(?:s|ed)?|open[- ]?source[ds]?|new|novel|first)\b|发布|推出|上线|开源|首次|首个|新型|新方法",
    "impact": r"\b(?:available|deploy(?:ed|ment)?|adopt(?:ed|ion)?|production|users?|customers?|developers?|api|benchmark|accuracy|performance|latency|throughput|funding|acquisition|regulation|policy)\b|可用|部署|落地|采用|用户|开发者|接口|基准|性能|准确率|延迟|吞吐|融资|收购|政策|监管",
    "detail": r"\b\d+(?:\.\d+)?\s*(?:%|x|ms|s|seconds?|minutes?|hours?|days?|users?|tokens?|parameters?|billion|million|GB|TB)?\b|\b(?:benchmark|dataset|methodology|evaluation|results?|study|paper|report|api)\b|数据集|方法|评测|基准|结果|论文|报告|接口",
    "negation": r"\b(?:not|no|never|cannot|can''t|failed to|fails? to|did not|does not|won''t|without)\b|并未|未能|没有|不会|无法|否认|失败|未达到",
    "rumour": r"\b(?:rumou?r|alleged(?:ly)?|unconfirmed|sources? say|people familiar|may have|could have)\b|传闻|据传|传言|消息人士|尚未证实|未经证实|或已|可能已",
    "future": r"\b(?:will|plans? to|aims? to|intends? to|expected to|upcoming|roadmap|would|could|may)\b|将于|将在|计划|拟于|预计划|有望|未来|将会|拟将",
    "marketing": r"\b(?:revolutionary|groundbreaking|game[- ]changing|world[- ]class|industry[- ]leading|best[- ]in[- ]class|unmatched|unparalleled|ultimate|most powerful)\b|革命性|颠覆性|全球领先|行业领先|遥遥领先|最强|震撼|重磅|划时代",
}
TELL = lambda name, c="both_": f"regexp_matches({c}, '(?i){TELLS[name]}')"
EXCERPTS = lambda c: rf"list_filter(list_transform(regexp_extract_all({c}, '[^。！？!?\n]+(?:[。！？!?]+|\z)'), lambda r: left({trimmed('r')}, 320)), lambda r: r <> '')"
PICK = lambda *names: "coalesce(" + ", ".join(f"list_filter(heads || bodies, lambda e: {TELL(n, 'e')})[1]" for n in names) + ", bodies[1], heads[1], '')"
IF = lambda test, n, other=0: f"CASE WHEN {test} THEN {n} ELSE {other} END"
CLAMP = lambda c: f"CAST(greatest(0, least(20, {c})) AS INT)"
ORACLE |= {
    "content_evaluation": rf"""WITH {ARTICLES}, x AS (SELECT article_id, title AS t, [{', '.join(f"'{c}'" for c in CLAIMS)}][length(text) % 7 + 1] || ' ' || text AS c, source_no % 2 = 0 AS secure, source_no % 3 AS tier, source_no % 5 = 0 AS known, quality IS NOT NULL AS dated, CASE WHEN quality IS NOT NULL THEN epoch(published_at) ELSE {NOW} END AS secs FROM articles),
      b AS (SELECT *, t || chr(10) || c AS both_ FROM x),
      r AS (SELECT *, CASE WHEN t = '' THEN 'missing_title' WHEN trim(regexp_replace(c, '(?i)<[^>]*>|&nbsp;', '', 'g')) = '' THEN 'empty_body' WHEN regexp_matches(both_, '{SPAM}') THEN 'spam' WHEN NOT regexp_matches(both_, '{SIGNALS}') THEN 'non_topic' WHEN floor(({NOW} - secs) / 86400) > 12 THEN 'stale_content' WHEN length(c) < 40 THEN 'too_short' ELSE 'eligible_content' END AS code FROM b),
      f AS (SELECT *, CASE WHEN article_id % 41 <> 0 THEN CASE WHEN code IN ('stale_content', 'too_short') THEN 'review' WHEN code = 'eligible_content' THEN 'candidate' ELSE 'reject' END END AS d, article_id % 41 <> 0 AND length(t) % 13 <> 0 AS matches, len(regexp_extract_all(c, 'tion')) % 4 AS signals,
        {', '.join(f"{TELL(n)} AS {n}" for n in TELLS)}, {EXCERPTS('t')} AS heads, {EXCERPTS('c')} AS bodies FROM r),
      g AS (SELECT *, d IS NOT NULL AND d = 'candidate' AS cand, length(c) < 80 OR NOT detail AS thin, least(20, {IF('tier = 0', 17, IF('tier = 1', 6, 10))} + {IF('known', 1)} + 1 + {IF('secure', 1)} + {IF('dated', 1)}) AS cred FROM f),
      e AS (SELECT *, {CLAMP(IF('cand AND matches', 14, IF("d = 'review'", 9, 2)) + " + least(6, 2 * " + IF('signals > 0', 'signals', IF('topic', 1)) + ")")} AS relevance,
        {CLAMP("least(" + IF('novelty', 17, IF('cand', 9, 4)) + ", " + IF("code = 'stale_content'", 5, 99) + f") - {IF('negation', 3)} - {IF('rumour', 4)} - {IF('future', 4)} - {IF('marketing', 2)}")} AS nov, {CLAMP(f"cred - {IF('rumour', 7)} - {IF('marketing', 3)}")} AS credibility,
        {CLAMP(f"{IF('impact', 13, 6)} + {IF('detail', 3)} - {IF('negation', 5)} - {IF('rumour', 4)} - {IF('future', 5)} - {IF('marketing', 3)}")} AS imp,
        {CLAMP(f"least({IF('thin', 8, 99)}, 6 + {IF('secure', 2)} + {IF('dated', 2)} + {IF('detail', 4)} + {IF('novelty OR impact', 3)} + {IF('len(bodies) >= 2', 2)} + {IF('tier = 0', 2)} - {IF('negation', 2)} - {IF('rumour', 7)} - {IF('future', 3)} - {IF('marketing', 3)})")} AS verifiability FROM g),
      o AS (SELECT *, relevance + nov + credibility + imp + verifiability AS overall FROM e),
      p AS (SELECT *, cand AND matches AND NOT thin AND NOT (negation OR rumour OR future OR marketing) AND overall >= 70 AND relevance >= 12 AND credibility >= 10 AND verifiability >= 12 AS publish_eligible FROM o)
      SELECT article_id, relevance, nov AS novelty, credibility, imp AS impact, verifiability, overall, CASE WHEN publish_eligible THEN 'pass' WHEN d = 'reject' THEN 'reject' ELSE 'review' END AS decision, publish_eligible,
        concat_ws(',', CASE WHEN d IS NULL THEN 'missing_filter_result' WHEN NOT matches THEN 'filter_snapshot_mismatch' END, CASE WHEN d = 'reject' THEN 'filter_rejected' END, CASE WHEN d = 'review' THEN 'filter_requires_review' END, CASE WHEN code = 'stale_content' THEN 'stale_content' END, CASE WHEN negation THEN 'negated_claim' END, CASE WHEN rumour THEN 'rumor_or_hearsay' END, CASE WHEN future THEN 'future_or_planned' END,
          CASE WHEN marketing THEN 'marketing_language' END, CASE WHEN thin THEN 'insufficient_evidence' END, CASE WHEN relevance < 12 THEN 'low_relevance' END, CASE WHEN credibility < 10 THEN 'low_credibility' END, CASE WHEN verifiability < 12 THEN 'low_verifiability' END, CASE WHEN overall < 70 THEN 'low_overall' END) AS reasons,
        md5(concat_ws('|', {PICK('topic')}, {PICK('novelty')}, {PICK('detail', 'novelty')}, {PICK('impact', 'detail')}, {PICK('detail', 'impact')})) AS quotes_md5 FROM p""",
}

FEED = f"""{SOURCES}, c AS (SELECT 'src' || (user_id % 24) AS k, event_id AS seq, CASE WHEN event_type = 'error' THEN 'patch' WHEN event_id % 97 = 0 THEN 'delete' WHEN event_id % 53 = 0 THEN 'create' WHEN event_id % 7 = 0 THEN 'toggle' WHEN event_id % 1009 = 1 THEN 'drop' ELSE 'patch' END AS op,
    CASE WHEN event_id % 3 = 0 THEN 'n' || event_id END AS name, CASE WHEN event_id % 5 = 0 THEN event_type END AS category, event_id % 2 = 0 AS flag FROM events),
  l AS (SELECT *, last_value(CASE WHEN op IN ('create', 'delete') THEN op END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life FROM c),
  a AS (SELECT l.*, CASE WHEN op = 'drop' THEN NULL WHEN life IS NULL THEN s.source_name IS NOT NULL ELSE life = 'create' END AS there FROM l LEFT JOIN sources s ON s.source_name = k)"""
ORACLE |= {
    "source_change_outcomes": f"WITH {FEED} SELECT CASE WHEN op = 'drop' THEN 'unknown_op' WHEN op = 'create' THEN CASE WHEN there THEN 'conflict' ELSE 'applied' END WHEN there THEN 'applied' ELSE 'not_found' END AS outcome, op, count(*) AS n FROM a GROUP BY ALL",
    "source_changes": f"""WITH RECURSIVE {FEED}, steps AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS n FROM a WHERE (op = 'create' AND NOT there) OR (op <> 'create' AND there)),
      w(k, n, alive, name, category, enabled, next_fetch_at) AS (SELECT k, 0::BIGINT, s.source_name IS NOT NULL, 'old' || source_no, s.category, s.enabled, s.next_fetch_at FROM (SELECT DISTINCT k FROM c UNION SELECT source_name FROM sources) x LEFT JOIN sources s ON s.source_name = x.k
        UNION ALL SELECT w.k, s.n, s.op <> 'delete', CASE WHEN s.op = 'create' THEN s.name WHEN s.op = 'patch' THEN coalesce(s.name, w.name) ELSE w.name END, CASE WHEN s.op = 'create' THEN s.category WHEN s.op = 'patch' THEN coalesce(s.category, w.category) ELSE w.category END,
          CASE s.op WHEN 'create' THEN true WHEN 'toggle' THEN s.flag ELSE w.enabled END, CASE WHEN s.op = 'create' OR (s.op = 'toggle' AND s.flag) THEN NULL ELSE w.next_fetch_at END FROM w JOIN steps s ON s.k = w.k AND s.n = w.n + 1)
      SELECT k AS source_name, name, category, enabled, {stamp('next_fetch_at')} AS next_fetch_at FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1) WHERE alive""",
}

ORACLE |= {
    "hotlist_ladder": """WITH r AS (SELECT event_type AS kind, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INT) AS rank, 't ' || user_id AS title FROM events), k AS (SELECT kind FROM r UNION SELECT kind || '_new' FROM r)
        SELECT kind, CASE WHEN length(kind) % 2 = 0 THEN 'live' ELSE 'snapshot' END AS origin, true AS ok, rank, title, 'https://search.example/?q=' || replace(title, ' ', '%20') AS url FROM r WHERE length(kind) % 2 = 0 OR kind <> 'click'
        UNION ALL SELECT kind, 'none', false, NULL, NULL, NULL FROM k WHERE kind NOT IN (SELECT kind FROM r WHERE length(kind) % 2 = 0 OR kind <> 'click')""",
}

NAMED = ["https://github.com/o/r/releases/tag/", "https://sub.nature.com/a/", "https://techcrunch.com/news/", "https://plain.example.info/p/", "https://blog.google/x.pdf?q=", "http://10.0.0.1/blog/", "https://r.example.info/?url=https%3A%2F%2Farxiv.org%2Fabs%2F"]
POINTS = [26, 10, -19, 5, 0, 0, 5]  # what each of these is worth; the fifth is a file, the sixth unsafe
ORACLE |= {
    "origin_heuristic": f"""WITH p AS (SELECT page_id, html, length(html) AS n, {host('url')} AS own FROM pages),
        c AS (SELECT page_id, own, unnest(regexp_extract_all(html, '(?i)(https?://[^\\s<>"\\x27`]+)')) AS url, unnest(range(len(regexp_extract_all(html, '(?i)(https?://[^\\s<>"\\x27`]+)')))) AS no FROM p),
        o AS (SELECT page_id, url, no, 5 + CASE WHEN contains(url, '/blog/') OR contains(url, '/news/') THEN 6 ELSE 0 END AS points FROM c WHERE {host('url')} <> own AND NOT ends_with({host('url')}, '.' || own) AND NOT ends_with(own, '.' || {host('url')}) AND NOT regexp_matches(lower(split_part(url, '?', 1)), '[.](css|js|png|jpg|svg|ico|pdf|json|xml)$')),
        a AS (SELECT page_id, {texts(NAMED)}[(n + k) % 7 + 1] || page_id AS url, 100000 + k AS no, {POINTS}[(n + k) % 7 + 1] AS points, (n + k) % 7 AS kind FROM p, (SELECT unnest([0, 3]) AS k) WHERE n % 3 > 0 AND (k = 0 OR n % 3 > 1)),
        e AS (SELECT page_id, url, no, points FROM o UNION ALL SELECT page_id, url, no, points FROM a WHERE kind NOT IN (4, 5))
        SELECT page_id, url AS origin, CAST(points AS INT) AS points FROM e WHERE points > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY points DESC, no) = 1""",
}

GIVEN = rf"""{ARTICLES}, a AS (SELECT article_id, text, title, {trimmed('title')} AS q, split_part(trim(title), ' ', 1) AS word, length(text) % 8 AS k FROM articles WHERE trim(title) <> ''),
  b AS (SELECT *, strpos(text, q) AS p, {plain('word')} AS pw, {plain('q')} AS pq FROM a),
  c AS (SELECT *, substr(text, greatest(p - 24, 1), least(p - 1, 24) + length(q) + 24) AS around FROM b),
  e AS (SELECT *, CASE WHEN k = 4 THEN 'direction' WHEN k = 5 THEN 'dimension' WHEN k = 3 THEN 'score' WHEN k = 2 THEN 'not_in_text' WHEN article_id % 11 = 0 THEN 'subject' WHEN k = 6 THEN 'fields' END AS refused,
    CASE WHEN pw = '' OR NOT contains(pq, pw) THEN 'tuple' WHEN k = 7 THEN 'required' WHEN k = 1 OR regexp_matches(around, '{SURE}') THEN 'uncertain' END AS capped FROM c),
  f AS (SELECT *, CASE WHEN refused IS NULL THEN CASE WHEN capped IS NULL THEN 5.0::DOUBLE ELSE 2.5::DOUBLE END END AS score FROM e)"""
ORACLE |= {
    "given_evidence": f"""WITH {GIVEN} SELECT article_id, 0 AS at, CASE WHEN k <> 4 THEN 'model' END AS direction, CASE WHEN k = 5 THEN 'nope' ELSE 'entity' END AS dimension, score, md5(CASE WHEN refused IS NULL THEN q ELSE '' END) AS quote_md5, CASE WHEN k = 1 THEN 'rumor' ELSE 'fact' END AS certainty, coalesce(refused, capped) AS reason FROM f
        UNION ALL SELECT article_id, 1, NULL, NULL, NULL, md5(''), NULL, 'not_object' FROM f""",
    "given_chains": f"WITH {GIVEN} SELECT article_id, CASE WHEN k = 2 THEN 0 ELSE 1 END AS n_claims, k = 2 OR coalesce(score, 0) >= CASE WHEN k = 1 THEN 2.5 ELSE 5 END AS complete FROM f",
}

ORACLE |= {
    "origin_policy": rf"""WITH h AS (SELECT page_id, CASE WHEN length(html) % 17 <> 0 THEN {host('url')} END AS h, ['feeds.example.com', 'rsshub.app', 'mp.weixin.qq.com', 'plain.info', 'sub.huxiu.com', ''][length(html) % 6 + 1] AS s, length(html) % 3 = 1 AS named FROM pages),
        f AS (SELECT *, regexp_matches(h, '(^|\.)example\.com$') OR regexp_matches(s, '(^|\.)example\.com$') AS a, page_id % 5 = 0 OR regexp_matches(h, '(^|\.)example\.org$') OR s = 'sub.huxiu.com' AS e FROM h)
        SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'editorial' WHEN h IS NULL OR named OR s IN ('rsshub.app', 'mp.weixin.qq.com') THEN 'aggregator' WHEN a THEN 'first_party' WHEN e THEN 'editorial' ELSE 'aggregator' END AS policy FROM f""",
}
