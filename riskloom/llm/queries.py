"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import chat, decontaminate, license_scan, packing, prefix_trie, quality, secrets, simhash, suffix_dedup, token_counts, toxicity, vantage, whitening
from riskloom.queries.registry import QueryFn
from riskloom.session import load, scratch_path

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), "word_bpe_49k.json")


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own, so the query always counts the whole table
    counted = token_counts.count_tokens(load(spark, sf_dir, "documents"), "byte_bpe_50k.json", scratch_path(spark, "token-cache"))
    return token_counts.token_report(counted)


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(simhash.near_duplicates(load(spark, sf_dir, "documents")))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op6_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item, w[k : k + 12] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
    dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
    hit AS (SELECT doc_id, item, k, n FROM (SELECT doc_id, k, n, w[k : k + n - 1] AS win FROM dw) JOIN iw USING (win)),
    places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(decontaminate.find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.toxicity_report(toxicity.score(docs, toxicity.train(docs, load(spark, sf_dir, "labels"))))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(secrets.find_secrets(load(spark, sf_dir, "documents")))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands at the top of the repository

    return corpus_pipeline.run(spark, sf_dir)


_TEMPLATES = ", ".join(f"('{label}', '{words}')" for label, words in license_scan.TEMPLATES)
_BASE = {label: f"w[k : k + {len(p.split()) - 1}] = {p.split()!r}" for p, label in license_scan.PHRASES.items()}


@query(
    "op1_license_scan",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents),
    places AS (SELECT doc_id, k - 1 AS pos, CASE {" ".join(f"WHEN {c} THEN '{label}'" for label, c in _BASE.items())} END AS label
               FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
    base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM places WHERE label IS NOT NULL GROUP BY doc_id),
    t AS (SELECT row_number() OVER () AS number, label, list_distinct(string_split(words, ' ')) AS own FROM (VALUES {_TEMPLATES}) AS v(label, words)),
    sentences AS (SELECT doc_id, unnest(string_split_regex(lower_text, '[.!?][ \\r\\n]|\\n[\\t\\x0B-\\r ]*\\n')) AS s FROM d),
    sw AS (SELECT doc_id, row_number() OVER () AS sentence, regexp_extract_all(s, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM sentences),
    blocks AS (SELECT doc_id, sentence, k, list_distinct(w[k : k + 63]) AS b FROM (SELECT *, unnest(range(1, greatest(len(w) - 32, 1) + 1, 32)) AS k FROM sw WHERE len(w) > 0)),
    matched AS (SELECT doc_id, sentence, k, number, label, own, list_intersect(b, own) AS mine FROM blocks, t WHERE len(list_intersect(b, own)) >= ceil(round(0.8 * len(own), 9))),
    state AS (SELECT doc_id, sentence, k, []::VARCHAR[] AS known, list({{'label': label, 'own': own, 'mine': mine}}) AS rest, []::STRUCT(label VARCHAR, own VARCHAR[], mine VARCHAR[])[] AS won
              FROM matched GROUP BY doc_id, sentence, k
              UNION ALL
              SELECT doc_id, sentence, k, list_distinct(known || flatten(list_transform(best, lambda x: x.own))), list_filter(rest, lambda x: NOT list_contains(best, x)), best FROM (
                SELECT *, list_transform(list_filter(able, lambda x: x.new * 1000 - len(x.t.own) = list_max(list_transform(able, lambda y: y.new * 1000 - len(y.t.own)))), lambda x: x.t) AS best FROM (
                  SELECT *, list_filter(list_transform(rest, lambda x: {{'new': len(list_filter(x.mine, lambda m: NOT list_contains(known, m))), 'of': len(list_filter(x.own, lambda m: NOT list_contains(known, m))), 't': x}}),
                                        lambda x: x.new > 0 AND x.new >= ceil(round(0.8 * x.of, 9))) AS able FROM state WHERE len(rest) > 0)
                WHERE len(able) > 0)),
    found AS (SELECT doc_id, x.label AS label, len(x.mine) / len(x.own) AS score FROM (SELECT doc_id, unnest(won) AS x FROM state)),
    every AS (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM places WHERE label IS NOT NULL),
    named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id),
    based AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM places WHERE label IS NOT NULL) GROUP BY doc_id),
    scored AS (SELECT doc_id, max(score) AS score FROM found GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
    FROM d LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN based USING (doc_id) LEFT JOIN scored USING (doc_id)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(load(spark, sf_dir, "documents"))


@query(
    "op3_quality_rules",
    """
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    grams AS (SELECT doc_id, k, w[k : k + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3)),
    again AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM again) GROUP BY doc_id),
    raw_lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM d),
    own AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM raw_lines WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
    lines AS (SELECT doc_id, source, trim(regexp_replace(lower(l), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g')) AS l FROM raw_lines),
    counted AS (SELECT source, l FROM (SELECT source, l, count(DISTINCT doc_id) AS n FROM lines WHERE l <> '' GROUP BY source, l)
                JOIN (SELECT source, count(*) AS m FROM documents GROUP BY source) USING (source) WHERE n > 30 AND n > 0.005 * m),
    removed AS (SELECT doc_id, sum(len(string_split(l, ' '))) AS gone FROM lines JOIN counted USING (source, l) GROUP BY doc_id),
    m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_removed_words
          FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN removed USING (doc_id))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.5 * n_words AS kept FROM m""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(load(spark, sf_dir, "documents"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"))


@query(
    "op8_chat_format",
    """
    WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
    c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS t FROM r GROUP BY conv_id),
    same AS (SELECT t, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY t),
    proper AS (SELECT DISTINCT t[1 : k] AS t FROM (SELECT t, unnest(range(1, len(t))) AS k FROM c)),
    kept AS (SELECT conv_id, copies FROM same ANTI JOIN proper USING (t))
    SELECT conv_id, turn // 64 AS part, count(*) AS n_turns, copies,
           string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS text
    FROM r JOIN kept USING (conv_id) GROUP BY conv_id, turn // 64, copies""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(load(spark, sf_dir, "conversations"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit_whitening(vectors))


@query("op12_nearest_neighbours")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return vantage.nearest(vectors, vectors.filter("vec_id % 100 = 0"))  # the query set of the contract


# CRC-32 bit by bit: eight steps per byte of the decimal id
_CRC_STEP = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {_CRC_STEP}), 4294967295)"


@query(
    "op13_conversation_trie",
    f"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, substr(sha256(strlen(role) || ':' || role || text), 1, 30)) AS t FROM r GROUP BY conv_id),
    h AS (SELECT conv_id, t, {_CRC} % 9 AS h FROM c),
    full_conv AS (SELECT h.conv_id, coalesce(b.t, [])[1 : h] || h.t[h + 1 :] AS t FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5),
    steps AS (SELECT conv_id, t[1 : d] AS seq, d, len(t) AS size FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM full_conv)),
    nodes AS (SELECT seq, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d) AS ends,
                     CASE WHEN d = 0 THEN 0 ELSE strlen(seq[d].text) END AS bytes FROM steps GROUP BY seq, d),
    kids AS (SELECT seq[1 : d - 1] AS seq, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
    full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (seq)),
    up AS (SELECT seq[1 : k] AS seq, n_children, n_convs, bytes FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_nodes)),
    totals AS (SELECT seq, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens FROM up GROUP BY seq)
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM full_nodes n JOIN totals USING (seq) LEFT JOIN nodes p ON n.d > 0 AND p.seq = n.seq[1 : n.d - 1]""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(load(spark, sf_dir, "conversations"))
