"""DuckDB SQL of operator 11: the same draws, and the greedy end of each source by recursion."""

from .mixing import MOST, SEED, SPAN, TRIED, WEIGHTS

OP11 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row_id, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('{SEED}' || chr(10) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS draw FROM documents),
m AS (SELECT *, CAST(floor(sqrt(sqrt(CAST(size AS DOUBLE))) * 1000) AS BIGINT) AS w FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}) + 1] AS weight FROM m GROUP BY source),
o AS (SELECT *, CAST(sum({MOST} * source_size) OVER before - {MOST} * source_size AS BIGINT) AS held, CAST(sum(weight) OVER after AS BIGINT) AS free, CAST(sum(source_size) OVER () AS BIGINT) AS total, row_number() OVER before AS no FROM s
    WINDOW before AS (ORDER BY source_size / CAST(weight AS DOUBLE), weight, source), after AS (ORDER BY source_size / CAST(weight AS DOUBLE), weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT min(no) AS no FROM o WHERE (total - held) * weight / CAST(free AS DOUBLE) < {MOST} * source_size),
t AS (SELECT source, source_size, CASE WHEN o.no >= f.no THEN (k.total - k.held) * weight / CAST(k.free AS DOUBLE) ELSE CAST({MOST} * source_size AS DOUBLE) END AS target
    FROM o, f LEFT JOIN (SELECT no AS first, total, held, free FROM o) k ON k.first = f.no),
bars AS (SELECT source, w, sum(size) AS words FROM m GROUP BY ALL HAVING sum(size) > 0),
c AS (SELECT source, arg_max(c, w) AS c FROM (SELECT b.source, w, (target - {MOST} * coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / CAST(sum(words * w) OVER (PARTITION BY b.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS c FROM bars b JOIN t ON b.source IS NOT DISTINCT FROM t.source) WHERE c * w < {MOST} GROUP BY source),
e AS (SELECT m.*, source_size, target, coalesce(least({MOST}.0::DOUBLE, c * w), CASE WHEN size > 0 THEN {MOST}.0 ELSE 0.0 END::DOUBLE) AS copies FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON m.source IS NOT DISTINCT FROM c.source),
p AS (SELECT *, CAST(floor(copies) AS BIGINT) AS base, copies - floor(copies) AS p, (draw + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM e),
r AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN CAST(floor(u * (1 - p) / (u * (1 - p) + (1 - u) * p) * {SPAN}::DOUBLE) AS BIGINT) END AS rank FROM p),
need AS (SELECT source, target - CAST(sum(base * size) AS BIGINT) AS gap FROM r GROUP BY source, target),
cls AS (SELECT source, rank, CAST(sum(size) AS BIGINT) AS words FROM r WHERE rank IS NOT NULL GROUP BY ALL),
run AS (SELECT cls.*, gap, sum(words) OVER (PARTITION BY cls.source ORDER BY rank) AS upto FROM cls JOIN need ON cls.source IS NOT DISTINCT FROM need.source),
far AS (SELECT *, sum(CASE WHEN upto > gap THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY rank) AS no FROM run),
step(source, no, gap, taken) AS (
    SELECT source, 0, max(gap) - coalesce(max(upto) FILTER (no = 0), 0)::DOUBLE, CAST([] AS BIGINT[]) FROM far GROUP BY source
    UNION ALL SELECT s.source, f.no::INT, CASE WHEN words <= s.gap THEN s.gap - words ELSE s.gap END, CASE WHEN words <= s.gap THEN list_append(taken, rank) ELSE taken END
    FROM step s JOIN far f ON f.source IS NOT DISTINCT FROM s.source AND f.no = s.no + 1 AND f.no <= {TRIED}),
ends AS (SELECT source, arg_max(gap, no) AS gap, arg_max(taken, no) AS taken FROM step GROUP BY source),
least_left AS (SELECT f.source, min(struct_pack(words := words, rank := rank)) AS x FROM far f JOIN ends ON f.source IS NOT DISTINCT FROM ends.source WHERE no BETWEEN 1 AND {TRIED} AND NOT list_contains(taken, rank) GROUP BY f.source),
won AS (SELECT source, rank FROM far WHERE no = 0 UNION ALL SELECT source, unnest(taken) FROM ends
    UNION ALL SELECT l.source, x.rank FROM least_left l JOIN ends ON l.source IS NOT DISTINCT FROM ends.source WHERE x.words < 2 * gap)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((base + CASE WHEN won.rank IS NULL THEN 0 ELSE 1 END) * size AS BIGINT) AS taken
FROM r LEFT JOIN won ON r.source IS NOT DISTINCT FROM won.source AND r.rank = won.rank"""
