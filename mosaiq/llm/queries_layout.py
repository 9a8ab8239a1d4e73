"""Registered queries of sharding, fill-in-middle and phrase mining, over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaiq.llm import frames, phrases, shards
from mosaiq.llm.common import read
from mosaiq.llm.registry import query


@query("op11_shards", r"""
WITH b AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::INT) AS bytes FROM documents),
bit AS (SELECT doc_id, size, flatten(list_transform(bytes, lambda v: [v & 1, (v >> 1) & 1, (v >> 2) & 1, (v >> 3) & 1, (v >> 4) & 1, (v >> 5) & 1, (v >> 6) & 1, v >> 7]))::BIGINT[] AS bits FROM b),
k AS (SELECT doc_id, size::BIGINT AS size, coalesce(doc_id::VARCHAR, 'null') AS id,
        xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, v: xor(c >> 1, 3988292384::BIGINT * (xor(c, v) & 1))), 4294967295::BIGINT) AS text_crc32 FROM bit),
c AS (SELECT *, list_transform(range(0, 17), lambda s: -ln((('0x' || substr(md5(id || ':' || s::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)) AS cost FROM k),
s AS (SELECT *, (list_position(cost[1:16], list_min(cost[1:16])) - 1)::INT AS shard FROM c),
g AS (SELECT *, CASE WHEN cost[17] < cost[shard + 1] THEN 16 ELSE shard END AS grown_shard,
        ((row_number() OVER (PARTITION BY doc_id, size, text_crc32 ORDER BY 1) - 1) // 10000)::BIGINT AS run FROM s),
p AS (SELECT *, ('0x' || substr(md5(id || ':' || text_crc32::VARCHAR || ':' || run::VARCHAR), 1, 12))::BIGINT AS place FROM g)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, size, text_crc32, run) - 1 AS slot, grown_shard::INT AS grown_shard
FROM p
""")
def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(read(spark, sf_dir, "documents"))


@query("op12_fill_in_middle", r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
                        ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
""")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.with_digests(frames.fill_in_middle(read(spark, sf_dir, "documents")))


@query("op13_phrases", r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(flatten([[w[i:i + k] FOR i IN range(1, len(w) - k + 1)] FOR k IN range(0, 5)])) AS g FROM w),
f AS (SELECT lang, g, count(*)::BIGINT AS f FROM g GROUP BY lang, g HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE len(g) > 1),
kept AS (SELECT * FROM c WHERE NOT EXISTS (
  SELECT 1 FROM c AS o WHERE o.lang = c.lang AND len(o.g) = len(c.g) + 1 AND o.f >= c.f AND (o.g[1:len(c.g)] = c.g OR o.g[2:] = c.g))),
cut AS (SELECT kept.lang, kept.g, kept.f AS a, n.n, k, l.f AS l, r.f AS r, (1000::HUGEINT * kept.f * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM kept JOIN n USING (lang), range(1, 5) AS t(k), f AS l, f AS r
  WHERE k < len(kept.g) AND l.lang = kept.lang AND r.lang = kept.lang AND l.g = kept.g[1:k] AND r.g = kept.g[k + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
""")
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(read(spark, sf_dir, "documents"))
