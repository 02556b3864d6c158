"""The registered queries of this subpackage and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    decontaminate, hadamard, language_id, line_dedup, merkle, mixture, nearest, norm_search, quality, sharding, simhash, token_count,
    url_filter,
)
from tablewright.llm.common import table

TOKEN_LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
LEVELS = ("domain", "lang", "source")
#: shares of the domains, and of English inside each; what no key names has weight 1
WEIGHTS = {("d0",): 4.0, ("d1",): 2.0, ("*", "en"): 3.0, ("d0", "en", "src0"): 0.5}
MIX_FRACTION = 1.5


def op1_token_count(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = public_tokenizers.path(VOCABULARY)
    return token_count.token_counts(docs, path, limit=TOKEN_LIMIT).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs)
    held = language_id.held_out(F.col("doc_id")).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score", F.size("languages").alias("n_languages"))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicate_groups(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.contamination(decontaminate.find_hits(docs, spark.read.parquet(f"{sf}/benchmark.parquet")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def domain() -> Column:
    """Four domains, by the number at the end of the source; sources without one are in the first."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("bigint")
    return F.concat(F.lit("d"), F.coalesce(F.pmod(number, F.lit(4)), F.lit(0)).cast("string"))


def op5_mixture(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    slim = docs.select(
        "doc_id", domain().alias("domain"), "lang", "source", mixture.token_length(F.col("text")).alias("n_tokens"),
        F.xxhash64("text").alias("hash"),
    )
    chosen = mixture.mix(mixture.stored(slim), LEVELS, WEIGHTS, F.col("n_tokens"), tie=F.col("hash"), fraction=MIX_FRACTION)
    return chosen.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf, "documents"))


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = line_dedup.drop_common_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "most_docs")


def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(quality.rated_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    graded = quality.grade(docs, model)
    return graded.select("doc_id", "expected_grade", "tail_prob", (F.col("tail_prob") >= 0.5).alias("keep"))


def op10_nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return nearest.search(rows, F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op11_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return norm_search.search(rows, F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    assigned, centroids = hadamard.cluster(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    digest = F.lit(None).cast("string")
    for number, centroid in enumerate(centroids):
        digest = F.when(F.col("cluster") == number, F.lit(hadamard.centroid_digest(centroid))).otherwise(digest)
    return hadamard.with_inertia(assigned).withColumn("centroid_sha256", digest).withColumnRenamed("id", "vec_id")


def op13_merkle(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf, spoilt = (merkle.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [t]) for t in (F.col("text"), F.translate("text", "\n", "")))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.unhex(spoilt))
    proved = merkle.prove(docs, leaf, F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "tampered": tampered})
    folded = merkle.with_folded_root(proved, F.coalesce(F.lower(F.hex("tampered")), F.col("leaf")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {f.__name__: f for f in (
    op1_token_count, op2_language_id, op3_simhash, op4_decontaminate, op5_mixture, op6_sharding, op7_line_dedup,
    op8_url_filter, op9_quality, op10_nearest, op11_exact_topk, op12_centroids, op13_merkle,
)}


_LOWER = f"'{url_filter.CAPITALS}', '{url_filter.SMALL}'"

_LINES = rf"""
WITH lines AS (
    SELECT doc_id, i, ls[i] AS line,
        translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), {_LOWER}) AS key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(i)),
common AS (
    SELECT key, count(DISTINCT doc_id) AS n FROM lines WHERE length(key) >= {line_dedup.MIN_CHARS}
    GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(n) AS n_dropped, coalesce(max(n), 0) AS most_docs,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE n IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key) GROUP BY doc_id"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_HITS = f"""
WITH items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, size, list_aggregate(ws[i:i + size - 1], 'string_agg', ' ') AS w
    FROM (SELECT *, least({decontaminate.WINDOW}, len(ws)) AS size FROM items WHERE len(ws) > 0), unnest(range(1, len(ws) - size + 2)) t(i)),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
places AS (
    SELECT doc_id, size, i, list_aggregate(ws[i:i + size - 1], 'string_agg', ' ') AS w
    FROM docs, (SELECT DISTINCT size FROM windows), unnest(range(1, len(ws) - size + 2)) t(i)),
hits AS (SELECT doc_id, item_id, size, i FROM places JOIN windows USING (size, w)),
found AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
    FROM hits GROUP BY doc_id),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + size)) t(j) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {decontaminate.ONE_IN} * n_hit >= len(ws) AS contaminated
FROM docs LEFT JOIN found USING (doc_id) LEFT JOIN hit USING (doc_id)"""


def _budget_sql() -> str:
    """The tree level by level: rooms, the common rate of siblings, shares."""
    parts, above = [], "SELECT domain, lang, source, supply, (SELECT sum(supply) FROM leaf) * %s AS b FROM leaf" % MIX_FRACTION
    parts.append(f"t0 AS ({above})")
    for i in range(len(LEVELS)):
        path, parent = LEVELS[: i + 1], LEVELS[:i]
        cases = []
        for key in sorted((k for k in WEIGHTS if len(k) == i + 1), key=lambda k: (sum(x == "*" for x in k), k)):
            test = " AND ".join(f"{c} = '{x}'" for c, x in zip(path, key) if x != "*") or "true"
            cases.append(f"WHEN {test} THEN {WEIGHTS[key]}")
        weight = f"CASE {' '.join(cases)} ELSE 1.0 END" if cases else "1.0"
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        order = f"{by} ORDER BY room / w, {', '.join(path)}"
        parts.append(
            f"n{i} AS (SELECT {', '.join(path)}, b, ({weight})::DOUBLE AS w, sum(supply) * {mixture.MOST_EPOCHS} AS room "
            f"FROM t{i} GROUP BY {', '.join(path)}, b)"
        )
        parts.append(
            f"r{i} AS (SELECT *, (b - coalesce(sum(room) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) "
            f"/ sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate, sum(room) OVER ({by}) AS rooms FROM n{i})"
        )
        parts.append(
            f"g{i} AS (SELECT {', '.join(path)}, CASE WHEN b >= rooms THEN room "
            f"ELSE least(room, w * greatest(max(rate) OVER ({by}), 0)) END AS given FROM r{i})"
        )
        parts.append(f"t{i + 1} AS (SELECT t.{', t.'.join(LEVELS)}, supply, given AS b FROM t{i} t JOIN g{i} USING ({', '.join(path)}))")
    return ",\n".join(parts)


_MIX = rf"""
WITH docs AS (
    SELECT doc_id, 'd' || coalesce(TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) % 4, 0) AS domain, lang, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS supply FROM docs GROUP BY ALL),
{_budget_sql()},
plan AS (SELECT *, floor(round(b, 6) / supply)::BIGINT AS full_epochs FROM t{len(LEVELS)}),
placed AS (
    SELECT docs.*, full_epochs, floor(round(b - full_epochs * supply, 6)) AS rest, sum(n_tokens) OVER (
        PARTITION BY domain, lang, source ORDER BY md5('{mixture.SEED}:' || full_epochs || ':' || doc_id), doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
    FROM docs JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, full_epochs + (reached <= rest)::BIGINT AS copies FROM placed
WHERE full_epochs + (reached <= rest)::BIGINT > 0"""

_JUMP = f"""
jumps AS (
    SELECT doc_id, n, -1::BIGINT AS b, 0::BIGINT AS j, (doc_id::HUGEINT & 18446744073709551615::HUGEINT) AS k
    FROM documents, (VALUES ({sharding.SHARDS}), ({sharding.SHARDS + 1})) v(n)
    UNION ALL
    SELECT doc_id, n, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((x >> 33) + 1)::DOUBLE))::BIGINT, x
    FROM (SELECT *, (k * {sharding.MULTIPLIER}::HUGEINT + 1) & 18446744073709551615::HUGEINT AS x FROM jumps WHERE j < n))"""

#: bytes the checksum is read in at once
_BLOCK = 512

_SHARDS = f"""
WITH RECURSIVE {_JUMP},
bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) t(i)),
rule AS (SELECT list(v ORDER BY i) AS t FROM bits),
-- a register goes over a block of zeros as the sum of its bytes does; so blocks are read apart and put together
zero AS (SELECT list(v ORDER BY i) AS z FROM (
    SELECT i, list_reduce(list_prepend((i & 255) << (8 * (i >> 8)), range({_BLOCK})), lambda c, x: xor(c >> 8, rule.t[(c & 255) + 1])) AS v
    FROM range(1024) r(i), rule)),
texts AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (
    SELECT doc_id, k, CASE WHEN k = 0 THEN h[1:2 * (n % {_BLOCK})]
        ELSE h[2 * (n % {_BLOCK} + (k - 1) * {_BLOCK}) + 1:2 * (n % {_BLOCK} + k * {_BLOCK})] END AS h
    FROM texts, unnest(range(n // {_BLOCK} + 1)) t(k)),
registers AS (
    SELECT doc_id, k, list_reduce(list_prepend(CASE WHEN k = 0 THEN 4294967295 ELSE 0 END::BIGINT,
        list_transform(range(len(h) // 2), lambda p: ('0x' || h[2 * p + 1:2 * p + 2])::BIGINT)),
        lambda c, x: xor(c >> 8, rule.t[(xor(c, x) & 255) + 1])) AS v
    FROM parts, rule),
sums AS (
    SELECT doc_id, n + 1 AS size, xor(4294967295, list_reduce(vs, lambda c, x: xor(x, xor(
        xor(z[(c & 255) + 1], z[((c >> 8) & 255) + 257]), xor(z[((c >> 16) & 255) + 513], z[((c >> 24) & 255) + 769]))))) AS text_crc32
    FROM texts JOIN (SELECT doc_id, list(v ORDER BY k) AS vs FROM registers GROUP BY doc_id) USING (doc_id), zero)
SELECT doc_id, size, text_crc32, 'key' AS law, s.b AS shard, g.b AS grown_shard,
    row_number() OVER (PARTITION BY s.b ORDER BY md5(doc_id || ':' || size || ':' || text_crc32), doc_id) - 1 AS slot
FROM sums JOIN (SELECT doc_id, max(b) AS b FROM jumps WHERE n = {sharding.SHARDS} GROUP BY doc_id) s USING (doc_id)
JOIN (SELECT doc_id, max(b) AS b FROM jumps WHERE n = {sharding.SHARDS + 1} GROUP BY doc_id) g USING (doc_id)"""

_TOPK = f"""
WITH vectors AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({norm_search.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, max(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0))::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""


def _kmeans_sql() -> str:
    """Every round by its own tables: assignments, then the floors of the means."""
    near = (
        "SELECT rn, c AS cluster, d AS distance FROM (SELECT rn, c, list_sum(list_transform(list_zip(x.v, m.v), lambda z: "
        "(z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept x, m{i} m) QUALIFY row_number() OVER (PARTITION BY rn ORDER BY d, c) = 1"
    )
    parts = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor({hadamard.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {hadamard.SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept "
        f"QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), v) <= {hadamard.CLUSTERS})",
    ]
    for i in range(hadamard.ROUNDS):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        parts.append(
            f"s{i} AS (SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN kept USING (rn), "
            f"unnest(range(1, {hadamard.SIZE + 1})) t(i) GROUP BY cluster, i)"
        )
        parts.append(
            f"m{i + 1} AS MATERIALIZED (SELECT c, coalesce(w, v) AS v FROM m{i} LEFT JOIN (SELECT cluster AS c, "
            f"list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM s{i} GROUP BY cluster) USING (c))"
        )
    parts.append(f"last AS MATERIALIZED ({near.format(i=hadamard.ROUNDS)})")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, "
        "(sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM last JOIN kept USING (rn) JOIN m{hadamard.ROUNDS} m ON m.c = cluster"
    )


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    fields = [_field(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars")]
    return f"sha256({' || '.join([*fields, _field(text)])})"


#: nodes of a forest level by level
_GROW = (
    "SELECT tree, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM {t} WHERE n > 1 "
    "GROUP BY tree, level, place // 3, n"
)
_SIBLINGS = (
    "SELECT rn, {stage} AS stage, s.level, string_agg(s.digest, '' ORDER BY s.place) AS siblings FROM docs d JOIN {t} s ON {on} "
    "AND s.place // 3 = ({place} // (3 ** s.level)::BIGINT) // 3 AND s.place <> {place} // (3 ** s.level)::BIGINT GROUP BY ALL"
)
_FOLD = (
    "SELECT f.rn, f.level + 1, f.place // 3, (f.n + 2) // 3, f.tree, sha256(coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER "
    "(WHERE s.place < f.place), '') || f.digest || coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (WHERE s.place > f.place), '')) "
    "FROM {f} f LEFT JOIN {t} s ON s.tree = f.tree AND s.level = f.level AND s.place // 3 = f.place // 3 AND s.place <> f.place WHERE f.n > 1 "
    "GROUP BY f.rn, f.level, f.place, f.n, f.tree, f.digest"
)

_MERKLE = rf"""
WITH RECURSIVE bits AS (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) t(i)),
rule AS (SELECT list(v ORDER BY i) AS t FROM bits),
named AS MATERIALIZED (
    SELECT *, {_leaf('text')} AS leaf, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS crc
    FROM documents, rule),
docs AS MATERIALIZED (
    SELECT row_number() OVER () AS rn, doc_id, leaf, CASE WHEN crc % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE leaf END AS shown,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
    FROM named),
nodes AS (SELECT tree, 0 AS level, place, n, leaf AS digest FROM docs UNION ALL {_GROW.format(t='nodes')}),
low AS MATERIALIZED (SELECT * FROM nodes),
tops AS (
    SELECT -1 AS tree, 0 AS level, tree AS place, count(*) OVER () AS n, digest FROM low WHERE n = 1
    UNION ALL {_GROW.format(t='tops')}),
high AS MATERIALIZED (SELECT * FROM tops),
proofs AS (
    SELECT rn, string_agg(siblings, '' ORDER BY stage, level) AS proof FROM (
        {_SIBLINGS.format(stage=0, t='low', on='s.tree = d.tree', place='d.place')}
        UNION ALL {_SIBLINGS.format(stage=1, t='high', on='true', place='d.tree')}) GROUP BY rn),
up AS (SELECT rn, 0 AS level, place, n, tree, shown AS digest FROM docs UNION ALL {_FOLD.format(f='up', t='low')}),
over AS (
    SELECT rn, 0 AS level, tree AS place, (SELECT count(*) FROM low WHERE n = 1) AS n, -1 AS tree, digest FROM up WHERE n = 1
    UNION ALL {_FOLD.format(f='over', t='high')}),
folded AS (SELECT rn, digest AS folded_root FROM over WHERE n = 1)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM docs JOIN low s ON s.tree = docs.tree AND s.n = 1 JOIN high r ON r.n = 1 LEFT JOIN proofs USING (rn) JOIN folded USING (rn)"""

ORACLES: dict[str, str] = {
    "op4_decontaminate": _HITS, "op5_mixture": _MIX, "op6_sharding": _SHARDS, "op7_line_dedup": _LINES,
    "op11_exact_topk": _TOPK, "op12_centroids": _kmeans_sql(), "op13_merkle": _MERKLE,
}
