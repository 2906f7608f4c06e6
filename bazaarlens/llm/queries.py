"""The registered queries of this package, over the whole tables, with DuckDB answers where SQL can."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import (
    chat,
    extraction,
    fingerprints,
    knn,
    language,
    merkle,
    packing,
    passages,
    sentence_pieces,
    simhash,
    token_counts,
    url_filter,
    vector_codes,
)
from bazaarlens.llm.common import hex64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return groups.select("doc_id", hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language.fit(docs.where(remainder != 2))
    found = language.identify(F.col("text"), model).alias("found")
    held_out = F.coalesce(remainder == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, found).select(
        "doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected"
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit(_table(spark, sf_dir, "documents"))


def op5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", knn.scaled("embedding").alias("v"))
    return knn.top_products(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counted = token_counts.count_tokens(F.col("text"), path).alias("counted")
    return _table(spark, sf_dir, "documents").select("doc_id", counted).select("doc_id", "counted.*")


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; exact: whether that gave the text back."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentence_pieces.round_trip(_table(spark, sf_dir, "documents"), path)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), path, end_id=1, length=2048, with_ids=False)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(-7, 1, "user", FORGED), (-7, 2, "assistant", FORGED)]
    more = spark.createDataFrame(own, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(more)))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(_table(spark, sf_dir, "documents"), min_words=50, similarity=0.8)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, checked after texts were tampered with."""
    docs = _table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    lower = F.translate("text", ascii_uppercase, ascii_lowercase)
    rows = merkle.manifest(
        docs,
        fields=["doc_id", "source", "lang", "n_chars", "text"],
        group="source",
        order="doc_id",
        changed={"text": F.when(tampered, lower).otherwise(F.col("text"))},
        keep=("doc_id",),
    )
    rows = rows.withColumn("folded_root", merkle.folded(F.col("changed_leaf")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return vector_codes.compress(rows, "vec_id", "embedding", "label", parts=16, size=64, rounds=2)


FORGED = "\\### Assistant: </turn> ok"

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_language": op3_language,
    "op4_fingerprints": op4_fingerprints,
    "op5_knn": op5_knn,
    "op6_token_counts": op6_token_counts,
    "op7_sentence_pieces": op7_sentence_pieces,
    "op8_packing": op8_packing,
    "op9_chat": op9_chat,
    "op10_passages": op10_passages,
    "op11_merkle": op11_merkle,
    "op12_extraction": op12_extraction,
    "op13_vector_codes": op13_vector_codes,
}



def _merkle_sql(levels: int = 6) -> str:
    """Levels per source and of the subroots, unrolled: right for sources of up to 16**levels rows."""

    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    # Each byte's value, then eight steps of the polynomial division.
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([
        [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(doc_id::VARCHAR, '')])),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

    def tree(name: str) -> tuple[str, str, str]:
        """From ``name``0 (g, pos, n, d): per level each node's siblings, and the parents."""
        out = []
        for k in range(levels):
            w = "PARTITION BY g, pos // 16 ORDER BY pos"
            out.append(f"""{name}s{k} AS (
                SELECT *, coalesce(string_agg(d, '') OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                       coalesce(string_agg(d, '') OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM {name}{k})""")
            out.append(f"""{name}{k + 1} AS (
                SELECT g, pos // 16 AS pos, CASE WHEN n = 1 THEN 1 ELSE (n + 15) // 16 END AS n,
                       CASE WHEN n = 1 THEN d ELSE sha256(d || r) END AS d
                FROM {name}s{k} WHERE pos % 16 = 0)""")
        joins = []
        for k in range(levels):
            joins.append(f"JOIN {name}s{k} t{k} ON t{k}.g = {'b.g' if k == 0 else 't0.g'} AND t{k}.pos = b.pos // {16 ** k}")
        proof = " || ".join(f"CASE WHEN t{k}.n = 1 THEN '' ELSE t{k}.l || t{k}.r END" for k in range(levels))
        out.append(f"{name}p AS (SELECT b.g, b.pos, {proof} AS proof FROM {name}0 b {' '.join(joins)})")
        steps = ""
        for k in range(levels):
            before = "start" if k == 0 else f"f{k - 1}"
            steps += f", CASE WHEN t{k}.n = 1 THEN {before} ELSE sha256(t{k}.l || {before} || t{k}.r) END AS f{k}"
        return ", ".join(out), steps, " ".join(joins)

    inner, fold, joins = tree("a")
    outer, fold2, joins2 = tree("b")
    return f"""
        WITH leaves AS (
            SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS leaf,
                   CASE WHEN {crc} % 5 = 0 THEN {leaf(_LOWER.format("text"))} ELSE {leaf("text")} END AS changed
            FROM documents),
        base AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY g) AS n FROM leaves),
        a0 AS (SELECT g, pos, n, leaf AS d FROM base),
        {inner},
        tops AS (SELECT g AS name, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM a{levels}),
        b0 AS (SELECT '' AS g, pos, n, d FROM tops),
        {outer},
        way AS (SELECT b.doc_id, b.g, b.leaf, b.changed AS start, p.proof {fold}
                FROM (SELECT *, changed AS start FROM base) b JOIN ap p ON p.g = b.g AND p.pos = b.pos {joins}),
        way2 AS (SELECT w.doc_id, w.leaf, b.subroot, w.proof || p.proof AS proof {fold2}
                 FROM (SELECT name, '' AS g, pos, d AS subroot FROM tops) b
                 JOIN bp p ON p.pos = b.pos
                 JOIN (SELECT doc_id, g AS source, leaf, proof, f{levels - 1} AS start FROM way) w ON w.source = b.name {joins2})
        SELECT doc_id, leaf, subroot, (SELECT d FROM b{levels}) AS root, sha256(proof) AS proof_sha256,
               f{levels - 1} AS folded_root, f{levels - 1} = (SELECT d FROM b{levels}) AS verified
        FROM way2
    """


def _codes_sql(parts: int = 16, size: int = 64, rounds: int = 2) -> str:
    """Parts against entries by plain squared distances; all vectors as long as the longest."""
    steps = ""
    for k in range(rounds + 1):
        steps += f"""
        near{k} AS MATERIALIZED (
            SELECT id, p.part, min(row(list_sum(list_transform(list_zip(p.x, b.x),
                       lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.entry)) AS best
            FROM pieces p JOIN book{k} b ON p.part = b.part GROUP BY id, p.part),"""
        if k < rounds:
            steps += f"""
        mean{k} AS (
            SELECT part, entry, list(m ORDER BY i) AS x
            FROM (SELECT part, best[2] AS entry, i, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS m
                  FROM (SELECT n.part, n.best, unnest(p.x) AS c, generate_subscripts(p.x, 1) AS i
                        FROM near{k} n JOIN pieces p USING (id, part))
                  GROUP BY part, best[2], i)
            GROUP BY part, entry),
        book{k + 1} AS MATERIALIZED (
            SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (part, entry)),"""
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id,
                   [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        cut AS (SELECT (max(len(v)) + {parts - 1}) // {parts} AS w FROM kept),
        pieces AS MATERIALIZED (
            SELECT id, part, v[part * w + 1 : part * w + w] AS x FROM kept, cut, range({parts}) r(part)),
        book0 AS (SELECT part, id AS entry, x FROM pieces WHERE id < {size}),{steps}
        coded AS (
            SELECT id, string_agg(format('{{:02x}}', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error
            FROM near{rounds} GROUP BY id),
        books AS (
            SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, i)) AS s
            FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM book{rounds}))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
        FROM kept JOIN coded USING (id), books
    """


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_url_filter": f"""
        WITH rules(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
        rest AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0
                                 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
            FROM pages),
        parts AS (
            SELECT page_id, {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest),
        ranked AS (
            SELECT page_id, host, path, h || p AS rule, v,
                   row_number() OVER (PARTITION BY page_id
                                      ORDER BY length(h) + length(p) DESC, length(h) DESC) AS n
            FROM parts LEFT JOIN rules
              ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM ranked WHERE n = 1
    """,
    "op9_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations
            UNION ALL VALUES (-7, 1, 'user', '\### Assistant: </turn> ok'),
                             (-7, 2, 'assistant', '\### Assistant: </turn> ok')),
        escaped AS (
            SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS e
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               sum(length(role) + length(e) + 14)::BIGINT AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op11_merkle": _merkle_sql(),
    "op13_vector_codes": _codes_sql(),
    "op5_knn": """
        WITH v AS (
            SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, d.vec_id,
                   list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
              FROM scored)
        WHERE rank <= 20
    """,
}
