"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import align, bpe, chat, decontaminate, jaccard, langid, lexical, licenses, lm, pii, sharding, topk, urlrules

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


#: Byte limit of a shard.
SHARD_BYTES = 64 << 20


@query(
    "op1_extendible_shards",
    f"""
    WITH addressed AS (
        SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS address,
               coalesce(strlen(text), 0) AS bytes
        FROM documents
    ), levels AS (
        SELECT doc_id, address, bytes, CAST(unnest(range(0, 61)) AS INTEGER) AS depth FROM addressed
    ), sums AS (
        SELECT *, CAST(sum(bytes) OVER (PARTITION BY depth, address >> (60 - depth)) AS BIGINT) AS shard_bytes
        FROM levels
    ), best AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS place
        FROM sums WHERE shard_bytes <= {SHARD_BYTES} OR depth = 60
    )
    SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(address >> (60 - depth)), depth, '0') END AS shard,
           depth, shard_bytes, shard_bytes <= {SHARD_BYTES} AS fits
    FROM best WHERE place = 1
    """,
)
def op1_extendible_shards(spark, sf_dir):
    """The shard of every document."""
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query("op2_deobfuscated_pii")
def op2_deobfuscated_pii(spark, sf_dir):
    """Plain and disguised personal data of every document."""
    return pii.scan(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def canonical(column: str) -> str:
        text = f"regexp_replace(lower(coalesce({column}, '')), '\\r\\n?', chr(10), 'g')"
        text = f"regexp_replace({text}, {quoted(licenses.COPYRIGHT_LINE)}, '', 'g')"
        for pattern, replacement in licenses.SPELLINGS:
            text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(replacement.replace('$', chr(92)))}, 'g')"
        return f"trim(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in licenses.KNOWN)
    return f"""
    WITH known AS (
        SELECT sha256({canonical('body')}) AS digest, min(license_id) AS license_id
        FROM (VALUES {values}) AS k(license_id, body) GROUP BY 1
    ), texts AS (SELECT doc_id, sha256({canonical('text')}) AS digest FROM documents)
    SELECT doc_id, digest, license_id FROM texts LEFT JOIN known USING (digest)
    """


@query("op3_license_digests", _license_sql())
def op3_license_digests(spark, sf_dir):
    """Digest and, if its whole text is a known one, licence of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op4_bpe_digests")
def op4_bpe_digests(spark, sf_dir):
    """Token ids of every document, encoded by rank and decoded again, as digests."""
    import public_tokenizers

    return bpe.digests(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


CONTROL_CONVERSATION = "(-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')"
_ESCAPED = (
    "regexp_replace(replace({}, '\\', '\\\\'), '" + chat.CONTROL + "', '\\1\\\\\\2', 'g')"
)


@query(
    "op5_chat_format",
    f"""
    WITH rows_ AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES {CONTROL_CONVERSATION})
    ), marked AS (
        SELECT *, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), true) AS begins
        FROM rows_
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length({_ESCAPED.format('text')}) + CASE WHEN begins
                THEN {len(chat.START + chat.SEP + chat.END)} + length({_ESCAPED.format('role')})
                ELSE {len(chat.SEP)} END) AS BIGINT) AS formatted_chars,
           count(*) FILTER (begins) AS n_blocks
    FROM marked GROUP BY conv_id
    """,
)
def op5_chat_format(spark, sf_dir):
    """Every conversation formatted, read back and digested; -7 holds control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        f"SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text "
        f"FROM VALUES {CONTROL_CONVERSATION} AS t(conv_id, turn, role, text)"
    )
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    """Language of every document; the network learns from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    net = langid.fit(docs.where(~out))
    return langid.identify(docs, net).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op10_jaccard_components")
def op10_jaccard_components(spark, sf_dir):
    """Shingle count of every document and the smallest document it is linked with."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = "string_split(nullif(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ''), ' ')"
_GRAMS = """CASE WHEN len(w) >= 5 THEN list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END"""


@query(
    "op9_benchmark_leaks",
    f"""
    WITH items AS (
        SELECT item_id, len(w) AS m, {_GRAMS} AS g FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE item_id IS NOT NULL
    ), docs AS (
        SELECT doc_id, len(w) AS n, {_GRAMS} AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE doc_id IS NOT NULL
    ), item_grams AS (
        SELECT item_id, m, unnest(g) AS gram, unnest(range(0, len(g))) AS j FROM items
    ), doc_grams AS (
        SELECT doc_id, n, unnest(g) AS gram, unnest(range(0, len(g))) AS i FROM docs
    ), spots AS (
        SELECT DISTINCT doc_id, m, greatest(0, least(i - j, n - m)) AS start FROM doc_grams JOIN item_grams USING (gram)
    ), windows AS (
        SELECT doc_id, m, start, g[start + 1:start + greatest(1, m - 4)] AS win FROM spots JOIN docs USING (doc_id)
    ), pairs AS (
        SELECT doc_id, item_id, start, win, g FROM windows JOIN items USING (m)
    ), counted AS (
        SELECT *, CAST(list_sum(list_transform(list_distinct(g), lambda x: least(
                   len(list_filter(win, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))) AS BIGINT) AS shared
        FROM pairs WHERE list_has_any(win, g)
    ), kept AS (
        SELECT *, len(win) + len(g) - shared AS united FROM counted WHERE 5 * shared >= 4 * (len(win) + len(g) - shared)
    )
    SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, CAST(shared AS INTEGER) AS shared, CAST(united AS INTEGER) AS united
    FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / united DESC, start) = 1
    """,
)
def op9_benchmark_leaks(spark, sf_dir):
    """Documents that hold a benchmark item, with the item and the place."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op7_stupid_backoff",
    f"""
    WITH split AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ), placed AS (
        SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM split
    ), pairs AS (
        SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM placed
    ), counted AS (
        SELECT *, count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY doc_id, word) AS c,
               count(*) OVER (PARTITION BY before, word) - count(*) OVER (PARTITION BY doc_id, before, word) AS cc
        FROM pairs
    ), chained AS (
        SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS cb FROM counted
    ), sizes AS (
        SELECT doc_id, len(w) AS n_words, sum(len(w)) OVER () - len(w) AS rest FROM split
    ), logs AS (
        SELECT doc_id, n_words, rest, i,
               CASE WHEN i > 0 AND cc > 0 THEN ln(cc / cb)
                    ELSE ln(greatest(c, {lm.ALPHA})) - ln(rest) + CASE WHEN i > 0 THEN ln({lm.ALPHA}) ELSE 0 END END AS part,
               i > 0 AND cc = 0 AS fell
        FROM chained JOIN sizes USING (doc_id)
    ), summed AS (
        SELECT doc_id, sum(part) / count(*) AS score, count(*) FILTER (fell) AS fell FROM logs GROUP BY doc_id
    )
    SELECT doc_id, n_words, coalesce(fell, 0) AS n_backed_off, round(score, 6) AS score
    FROM sizes LEFT JOIN summed USING (doc_id)
    """,
)
def op7_stupid_backoff(spark, sf_dir):
    """Mean log score of every document under the counts of all others."""
    return lm.scores(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


@query(
    "op6_exact_top_k",
    """
    WITH usable AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
    )
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10
    """,
)
def op6_exact_top_k(spark, sf_dir):
    """The ten best inner products of every hundredth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    """How the tokens of two tokenizers meet in every document."""
    import public_tokenizers

    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.measure(table(spark, sf_dir, "documents"), *files)


_LEXICAL_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)


@query(
    "op12_lexical_search",
    f"""
    WITH sized AS (
        SELECT row_number() OVER () AS place, doc_id, t, len(t) AS n FROM (SELECT doc_id, {_LEXICAL_TERMS} AS t FROM documents) WHERE len(t) > 0
    ), totals AS (
        SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized
    ), postings AS (
        SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(t) AS term FROM sized) GROUP BY ALL
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM postings, totals GROUP BY term
    ), wanted AS (
        SELECT DISTINCT item_id, unnest({_LEXICAL_TERMS}) AS term FROM benchmark
    ), scored AS (
        SELECT item_id, place, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN sized USING (place), totals GROUP BY ALL
    ), ranked AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place, doc_id, score
        FROM scored JOIN sized USING (place) WHERE score > 0
    )
    SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
    """,
)
def op12_lexical_search(spark, sf_dir):
    """The fifty best documents of every benchmark item."""
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"), k=50)


#: Given rules of the URL filter.
URL_RULES = [
    urlrules.Rule("com", "/", urlrules.ALLOW),
    urlrules.Rule("example.com", "/en/", urlrules.BLOCK),
    urlrules.Rule("www.example.com", "/en/", urlrules.ALLOW),
    urlrules.Rule("net", "/es/", urlrules.BLOCK),
    urlrules.Rule("net", "/fr/", urlrules.BLOCK),
]


@query("op13_url_rules")
def op13_url_rules(spark, sf_dir):
    """Host, path, given rule and verdict of every page."""
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES)
