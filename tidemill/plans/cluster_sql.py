"""DuckDB SQL of event clusters; the sequential grouping runs record by record in a recursive query."""

from __future__ import annotations

CJK = r"\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
EVENTS = ["OpenAI GPT-5.2", "谷歌 Gemini 3 正式发布 大语言模型", "Anthropic claude-4 2025-03-01", "", "英伟达 2025年3月 12.5亿 订单", "Kimi K2 40%up 300m", "meta llama_3.1 カタカナ"]
GENERIC = "发布 正式 宣布 推出 上线 更新 模型 人工智能 大模型 新闻 报告 研究 测试 公司 产品 版本 latest release launch announces announced update model models new the".split()
NAMED = "openai:openai anthropic:anthropic google:google 谷歌:google deepmind:google microsoft:microsoft 微软:microsoft meta:meta amazon:amazon 亚马逊:amazon nvidia:nvidia 英伟达:nvidia alibaba:alibaba 阿里:alibaba baidu:baidu 百度:baidu tencent:tencent 腾讯:tencent bytedance:bytedance 字节:bytedance xai:xai mistral:mistral".split()


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def queries(articles: str, clean) -> dict[str, str]:
    """articles: the CTE of that name; clean: what makes a title NFKC with single spaces."""
    entities = ", ".join("CASE WHEN contains(t, '{}') THEN '{}' END".format(*x.split(":")) for x in NAMED)
    grams = lambda n: f"flatten(list_transform(regexp_extract_all(t, '[{CJK}]{{2,}}'), lambda r: list_transform(range(1, length(r) - {n - 2}), lambda i: substr(r, i, {n}))))"
    features = rf"""{articles}, e AS (SELECT article_id, article_id % 3 <> 0 AS is_new, CASE WHEN article_id % 6 = 0 THEN 'k' || (article_id // 24) WHEN article_id % 30 = 3 THEN 's' || article_id END AS cluster_id,
        lower({clean(f"{listed(EVENTS)}[length(title) % 7 + 1] || ' ' || title")}) AS t, 'url:' || source_name || '.example/e/' || (length(text) % 50) AS url FROM articles),
    s AS (SELECT *, list_distinct(list_transform(regexp_extract_all(t, '\b(?:gpt|claude|gemini|llama|qwen|deepseek|kimi|longcat|mistral|grok|phi|copilot|codex)[\s_-]*v?[0-9]+(?:\.[0-9]+)*\b'), lambda m: regexp_replace(m, '[\s_-]+', '-', 'g'))) AS models,
        list_distinct(list_filter([{entities}], lambda x: x IS NOT NULL)) AS entities, list_distinct(regexp_extract_all(t, '\b20[0-9]{{2}}[-/.][0-9]{{1,2}}(?:[-/.][0-9]{{1,2}})?\b|20[0-9]{{2}}年[0-9]{{1,2}}月(?:[0-9]{{1,2}}日)?')) AS dates,
        list_distinct(regexp_extract_all(t, '\b[0-9]+(?:\.[0-9]+)?(?:%|k|m|b|t)\b|[0-9]+(?:\.[0-9]+)?(?:万|亿|兆)')) AS numbers FROM e),
    w AS (SELECT *, list_distinct(list_filter(list_concat({grams(2)}, {grams(3)}, list_filter(regexp_extract_all(t, '[a-z][a-z0-9]*(?:[._-][a-z0-9]+)*'), lambda x: length(x) >= 2)), lambda x: NOT list_contains({listed(GENERIC)}, x)) || models || entities) AS terms FROM s),
    l AS (SELECT *, list_filter(terms, lambda x: length(x) >= CASE WHEN regexp_matches(x, '[{CJK}]') THEN 3 ELSE 4 END) AS long, list_transform(list_sort(models), lambda x: 'model:' || x) || list_transform(list_sort(entities), lambda x: 'entity:' || x) AS named FROM w),
    f AS (SELECT article_id, is_new, CASE WHEN NOT is_new THEN cluster_id END AS cluster_id, t, models, entities, dates, numbers, terms, long || named AS anchors,
        [url] || CASE WHEN length(t) >= 6 THEN ['title:' || t] ELSE [] END || named || list_transform(list_sort(numbers), lambda x: 'number:' || x) || list_sort(long) AS keys FROM l)"""
    jaccard = lambda c: f"(CASE WHEN list_has_any(a.{c}, b.{c}) THEN len(list_intersect(a.{c}, b.{c})) / CAST(len(a.{c}) + len(b.{c}) - len(list_intersect(a.{c}, b.{c})) AS DOUBLE) ELSE 0.0 END)"
    clash = " OR ".join(f"(len(a.{k}) > 0 AND len(b.{k}) > 0 AND NOT list_has_any(a.{k}, b.{k}))" for k in ("models", "entities", "dates", "numbers"))
    scores = rf"""{features}, k AS (SELECT article_id, is_new, unnest(keys) AS key, unnest(range(1, len(keys) + 1)) AS place FROM f),
    bucket AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY is_new, article_id) <= 50),
    met AS (SELECT k.article_id AS later, b.article_id AS earlier, min(struct_pack(p := k.place, n := b.is_new, i := b.article_id)) AS best FROM k JOIN bucket b USING (key) WHERE (b.is_new, b.article_id) < (k.is_new, k.article_id) GROUP BY 1, 2),
    c AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY later ORDER BY best) <= 80),
    sc AS (SELECT later, earlier, 0.72::DOUBLE * {jaccard('terms')} + 0.28::DOUBLE * {jaccard('anchors')} AS score, list_has_any(a.models, b.models) OR list_has_any(a.entities, b.entities) AS core, len(list_intersect(a.anchors, b.anchors)) AS shared, {clash} AS clash
        FROM c JOIN f a ON a.article_id = later JOIN f b ON b.article_id = earlier),
    pairs AS (SELECT later, earlier, score FROM sc WHERE NOT clash AND (core OR shared >= 2) AND score >= CASE WHEN core THEN 0.30 ELSE 0.42 END)"""
    assign = rf"""{scores}, near AS (SELECT r, map(list(o), list(score)) AS of FROM (SELECT later AS r, earlier AS o, score FROM pairs UNION ALL SELECT earlier, later, score FROM pairs) GROUP BY r),
    todo AS (SELECT article_id, of, row_number() OVER (ORDER BY is_new, article_id) AS k FROM f JOIN near ON r = article_id WHERE cluster_id IS NULL),
    seeds AS (SELECT cluster_id AS c, list(article_id ORDER BY article_id) AS m, min(article_id) AS first FROM f WHERE cluster_id IS NOT NULL GROUP BY 1),
    rec(k, groups) AS (SELECT 0::BIGINT, coalesce((SELECT list(struct_pack(c := c, m := m) ORDER BY first) FROM seeds), [])
      UNION ALL SELECT k + 1, CASE WHEN best IS NULL THEN list_append(groups, struct_pack(c := NULL::VARCHAR, m := [article_id])) ELSE list_transform(groups, lambda g, i: CASE WHEN i = best.i THEN struct_pack(c := g.c, m := list_append(g.m, article_id)) ELSE g END) END
      FROM (SELECT rec.k, groups, article_id, list_min(list_filter(list_transform(groups, lambda g, i: CASE WHEN len(list_filter(g.m, lambda x: of[x] IS NULL)) = 0 THEN struct_pack(s := -round(list_avg(list_transform(g.m, lambda x: of[x])), 9), i := i) END), lambda x: x IS NOT NULL)) AS best
        FROM rec JOIN todo ON todo.k = rec.k + 1)),
    g AS (SELECT c, m, row_number() OVER () AS g FROM (SELECT unnest(groups, recursive := true) FROM (SELECT groups FROM rec ORDER BY k DESC LIMIT 1))),
    big AS (SELECT * FROM g WHERE c IS NOT NULL OR len(m) > 1), x AS (SELECT c, g, len(m) AS n, unnest(m) AS article_id FROM big),
    vals AS (SELECT g, kind, value, n, count(*) AS have FROM (SELECT g, n, 0 AS kind, unnest(models) AS value FROM x JOIN f USING (article_id) UNION ALL SELECT g, n, 1, unnest(anchors) FROM x JOIN f USING (article_id)) GROUP BY ALL HAVING have = n),
    best AS (SELECT g, min(kind) AS kind FROM vals GROUP BY 1),
    sig AS (SELECT g, string_agg(value, '|' ORDER BY value) AS s FROM (SELECT v.g, value FROM vals v JOIN best USING (g, kind) WHERE NOT starts_with(value, 'entity:') QUALIFY row_number() OVER (PARTITION BY v.g ORDER BY value) <= 6) GROUP BY 1),
    ttl AS (SELECT g, min(t) AS t FROM x JOIN f USING (article_id) GROUP BY 1)
    SELECT article_id, coalesce(c, 'evt_' || left(sha256('cluster-v2:' || coalesce(s, t)), 24)) AS cluster_id, c IS NOT NULL AS is_known FROM x JOIN ttl USING (g) LEFT JOIN sig USING (g)"""
    joined = lambda c: f"coalesce(array_to_string(list_sort({c}), ','), '') AS {c}"
    return {
        "cluster_features": f"WITH {features} SELECT article_id, cluster_id, {joined('models')}, {joined('entities')}, {joined('dates')}, {joined('numbers')}, CAST(len(terms) AS INT) AS n_terms, CAST(len(anchors) AS INT) AS n_anchors, md5(array_to_string(keys, '|')) AS keys_md5 FROM f",
        "cluster_pair_scores": f"WITH {scores} SELECT later, earlier, round(score, 6) AS score FROM pairs",
        "cluster_assign": f"WITH RECURSIVE {assign}",
    }
