"""The registered queries of the operators in this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, exact_dedup, html_text, langid, line_dedup, minhash, packing, piece_codec, pii, prefix_trie, quality, url_filter, vector_codes
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("op2_sentencepiece_codec")
def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"))


@query(
    "op3_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_spans(table(spark, sf_dir, "documents")))


@query("op1_quality_importance")
def op1_quality_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _op7_sql() -> str:
    fits = lambda r: (lambda h, p: f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{p}'))")(*r.partition("/")[::2])
    longest = sorted(RULES, key=lambda x: (-len(x[1]), x[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest) + " END"
    c = url_filter

    def level(rows: str, keys: str, s: str, t: str) -> str:
        on = lambda a, b, extra="": " AND ".join(f"{a}.{k} = {b}.{k}" for k in (keys + extra).split(", "))
        return f"""
        c{t} AS (SELECT {keys}, {s}, sum(n) n, sum(labels) labels, sum(blocked) blocked FROM {rows} GROUP BY ALL),
        p{t} AS (SELECT {keys}, count(*) children, sum(n) pn, sum(labels) pl, sum(blocked) pb FROM c{t} GROUP BY ALL),
        j{t} AS (SELECT c.*, children, pn, pb / nullif(pl, 0) AS share, blocked / nullif(labels, 0) AS own,
                 regexp_matches({s}, '^[0-9]') OR (children >= {c.MANY} AND pn <= {c.PAGES_PER_CHILD} * children) AS variable
                 FROM c{t} c JOIN p{t} p ON {on("c", "p")}),
        n{t} AS (SELECT {keys}, {s}, CASE WHEN {s} = '' THEN ''
                 WHEN coalesce(abs(own - share) > {c.Z} * sqrt(share * (1 - share) / nullif(labels, 0)), false)
                 THEN CASE WHEN variable THEN '*' ELSE {s} END WHEN variable THEN '*' ELSE '~' END AS {t} FROM j{t}),
        r{t} AS (SELECT r.*, {t} FROM {rows} r JOIN n{t} m ON {on("r", "m", ", " + s)}),"""

    part = lambda i: f"coalesce(parts[{i}], '')"
    digit = lambda x: f"CASE WHEN regexp_matches({x}, '^[0-9]') THEN '0' ELSE {x} END"
    return f"""
    WITH a AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{c.UPPER}', '{c.LOWER}') AS host,
               coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    b AS (SELECT *, {rule} AS rule, {ruled} AS ruled, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM a),
    d AS (SELECT *, {digit(part(1))} AS s0, {digit(part(2))} AS s1, CASE WHEN len(parts) > 2 THEN '**' ELSE '' END AS s2 FROM b),
    k AS (SELECT host, s0, s1, s2, count(*) n, count(ruled) labels, count(*) FILTER (WHERE ruled = 'block') blocked FROM d GROUP BY ALL),
    {level("k", "host", "s0", "t0")} {level("rt0", "host, t0", "s1", "t1")}
    g AS (SELECT (coalesce(sum(blocked), 0) + 1) / (coalesce(sum(labels), 0) + 2) AS g FROM k),
    h AS (SELECT host, (sum(blocked) + {c.SMOOTH} * any_value(g)) / (sum(labels) + {c.SMOOTH}) AS h FROM k, g GROUP BY host),
    l AS (SELECT host, t0, t1, s2, (sum(blocked) + {c.SMOOTH} * any_value(h)) / (sum(labels) + {c.SMOOTH}) AS purity
          FROM rt1 JOIN h USING (host) GROUP BY host, t0, t1, s2)
    SELECT page_id, d.host AS host, path, rule, coalesce(ruled, CASE WHEN purity >= {c.PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
           regexp_replace('' || CASE WHEN r.t0 = '' THEN '' ELSE '/' || r.t0 END || CASE WHEN r.t1 = '' THEN '' ELSE '/' || r.t1 END
                          || CASE WHEN d.s2 = '' THEN '' ELSE '/' || d.s2 END, '^$', '/') AS template
    FROM d JOIN rt1 r ON d.host = r.host AND d.s0 = r.s0 AND d.s1 = r.s1 AND d.s2 = r.s2 JOIN l ON l.host = r.host AND l.t0 = r.t0 AND l.t1 = r.t1 AND l.s2 = r.s2
    """


@query("op7_url_filter", _op7_sql())
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


@query("op8_embedding_near_dedup")
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op10_fuzzy_line_dedup")
def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.groups(table(spark, sf_dir, "documents"), whole=True).drop("row")


def _crc32(number: str) -> str:
    """CRC-32 of a decimal number, bit by bit."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: {step}), 4294967295)"


@query(
    "op13_prefix_trie",
    f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    l AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS ts FROM t GROUP BY conv_id),
    h AS (SELECT *, conv_id - conv_id % 20 AS base, {_crc32("conv_id")} % 4 AS h FROM l),
    b AS (SELECT h.conv_id, list_concat(coalesce(l.ts, [])[1:h], h.ts[h + 1:]) AS ts FROM h LEFT JOIN l ON l.conv_id = h.base),
    p AS (SELECT conv_id, d, ts[1:d] AS pre, d = len(ts) AS last FROM b, LATERAL (SELECT unnest(range(0, len(ts) + 1)) AS d)),
    n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends,
          CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(pre[d].x, '[^\x20\x09-\x0D]+')) END AS words FROM p GROUP BY pre, d),
    c AS (SELECT pre[1:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (pre)),
    u AS (SELECT pre[1:e] AS pre, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
          FROM m, LATERAL (SELECT unnest(range(0, d + 1)) AS e) GROUP BY 1)
    SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
    FROM m JOIN u USING (pre) LEFT JOIN n q ON m.d > 0 AND q.d = m.d - 1 AND q.pre = m.pre[1:m.d - 1]
    """,
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def _op12_sql() -> str:
    c = vector_codes
    far = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"
    nearest = lambda r: f"SELECT row, part, any_value(x) AS x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT row, p.part, x, entry, {far} AS d FROM p JOIN b{r} USING (part)) GROUP BY row, part"
    rounds = "".join(
        f"""
        a{r} AS ({nearest(r)}),
        m{r} AS (SELECT part, entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS v FROM a{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL),
        b{r + 1} AS (SELECT part, entry, coalesce(list(v ORDER BY i) FILTER (WHERE v IS NOT NULL), any_value(y)) AS y FROM b{r} LEFT JOIN m{r} USING (part, entry) GROUP BY part, entry),"""
        for r in range(c.ROUNDS)
    )
    return f"""
    WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row,
               list_transform(embedding, lambda x: CAST(floor({c.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
               FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
    p AS (SELECT row, part, w[part * (len(w) // {c.PARTS}) + 1:(part + 1) * (len(w) // {c.PARTS})] AS x FROM v, range({c.PARTS}) t(part)),
    b0 AS (SELECT part, row AS entry, x AS y FROM p WHERE row < {c.ENTRIES}), {rounds}
    a AS ({nearest(c.ROUNDS)}),
    e AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY row)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM b{c.ROUNDS}) AS codebooks_sha256
    FROM v JOIN e USING (row)
    """


@query("op12_vector_codes", _op12_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))
