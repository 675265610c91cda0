"""The operators bound to their tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.session import importable

from . import conversation_repair, conversation_trie, embedding_join, jaccard_join, licenses, lm_scoring, mixing, quality, secrets, sentencepiece_codec, suffix_dedup, token_counts, toxicity

LM = {"order": 3, "min_count": 2, "alpha": 0.4, "block_bytes": 8 << 20}
NEAR = {"cosine": 0.9, "cell_size": 4096, "tile_size": 4096}
JACCARD = {"width": 4, "percent": 85, "block_bytes": 8 << 20}
#: What the pipeline calls near duplicates.
NEAR_STAGE = {"width": 5, "percent": 80, "block_bytes": 8 << 20}
QUALITY = {"buckets": 30_000, "prior": 100_000, "threshold": -0.11}
MIX = {"weights": [5, 2, 1], "share": 1.5, "cap": 2, "seed": 20240229}
PIECE_MODEL, PIECE_THREADS = "piece_bpe_32k.model", 2
LICENSE_DICE = 0.8
TOXICITY = {"max_docs": 10_000, "max_features": 300, "toxic_at": 0.2, "seed": 20240229}
PASSAGES = {"width": 100, "gram": 32, "block_bytes": 4 << 20, "files_bytes": 16 << 20, "bucket_bytes": 2 << 20}
COUNT_TOKENIZER, TOKEN_LIMIT = "word_bpe_49k.json", 2048


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, and keeps their batches small."""
    importable(spark)
    # Whole texts travel in these batches: ten thousand of them are tens of megabytes.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.score_documents(_read(spark, sf_dir, "documents"), **LM)
    return out.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(_read(spark, sf_dir, "embeddings"), **NEAR)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode_documents(_read(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL), threads=PIECE_THREADS)
    return out.drop("ids")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(_read(spark, sf_dir, "documents"), trusted(spark, sf_dir), **QUALITY)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_read(spark, sf_dir, "documents"), **JACCARD)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(_read(spark, sf_dir, "documents"), least=LICENSE_DICE)
    best = F.try_element_at(F.array_sort(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["start"].alias("s"), m["license"].alias("l")))), F.lit(1))
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), best["l"].alias("license"), (-best["d"]).alias("dice"), spans.alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = toxicity.training_rows(docs, _read(spark, sf_dir, "labels"), TOXICITY["max_docs"], TOXICITY["seed"], "doc_id", "text", "toxic")
    model = toxicity.train(rows["text"], rows["y"].to_numpy() == 1, max_features=TOXICITY["max_features"])
    return toxicity.score_toxicity(docs, model, toxic_at=TOXICITY["toxic_at"])


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"), **MIX).drop("source")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = token_counts.TokenCountCache(spark)
    out = token_counts.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path(COUNT_TOKENIZER), cache)
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(_read(spark, sf_dir, "documents"))
    n = lambda c: F.size(c).cast("long")
    base = secrets.span_list("assign", "access", "hex")
    return out.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), secrets.span_list("assign", "access", "hex", "random").alias("spans"), n("random").alias("n_random"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(_read(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), **PASSAGES)
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(_read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents"
#: The least id reachable over the links (a, b), each in one direction, of all ids in (id).
_COMPONENTS = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    walk(id, c) AS (SELECT id, id FROM ids UNION SELECT l.b, w.c FROM walk w JOIN both_ways l ON l.a = w.id),
    parts AS (SELECT id, min(c) AS component_id FROM walk GROUP BY 1)"""


def _secrets_sql() -> str:
    """The base patterns, and the battery with its procedure, over whole texts."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    patterns = [(secrets.ASSIGN, 2, secrets.MIN_ASSIGN), (secrets.ACCESS, 0, secrets.MIN_ACCESS), (secrets.HEX, 0, secrets.MIN_HEX), (secrets.RUN, 0, secrets.MIN_RUN)]
    pieces = ", ".join(f"regexp_extract_all(t, {quoted(p)}) AS m{i}, regexp_extract_all(t, {quoted(p)}, {g}) AS v{i}, string_split_regex(t, {quoted(p)}) AS g{i}" for i, (p, g, _) in enumerate(patterns))
    chars = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
    found = " UNION ALL ".join(
        f"SELECT doc, {i} AS rank, s, s + length(m{i}[k]) AS e, m{i}[k] AS run FROM (SELECT doc, m{i}, v{i}, k, {chars(f'g{i}[1:k]')} + {chars(f'm{i}[1:k - 1]')} AS s FROM (SELECT *, unnest(range(1, len(m{i}) + 1)) AS k FROM p)) WHERE length(v{i}[k]) >= {least}"
        for i, (_, _, least) in enumerate(patterns)
    )
    near = "(t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))"
    density = "(exp(-x * x / 2) / 2.5066282746310002)"
    tail = lambda z: f"(SELECT least(1.0, greatest(1e-39, 2 * CASE WHEN x < 5 THEN {density} * {near} ELSE {density} / x * (1 - 1 / (x * x)) END)) FROM (SELECT x, 1 / (1 + 0.2316419 * x) AS t FROM (SELECT abs({z}) AS x)))"
    rank = lambda alphabet, c: f"strpos('{alphabet}', {c}) - 1"
    bands = " + ".join(f"(e - s >= {b})::INT" for b in secrets.BANDS[1:])
    text = lambda ranks: f"coalesce(string_agg(concat_ws(':', ['assign', 'access', 'hex', 'random'][rank + 1], s, e), ',' ORDER BY s, rank, e) FILTER (WHERE rank < {ranks}), '')"
    many = lambda i: f"CAST(count(*) FILTER (WHERE rank = {i}) AS BIGINT)"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents), p AS MATERIALIZED (SELECT doc, {pieces} FROM d), f AS MATERIALIZED ({found}),
        r AS (SELECT doc, s, e, CASE WHEN regexp_matches(run, '{secrets.UUID}') THEN lower(replace(run, '-', '')) ELSE run END AS c FROM f WHERE rank = 3),
        k AS (SELECT *, CASE WHEN regexp_matches(c, '^([0-9a-f]+|[0-9A-F]+)$') THEN 16 WHEN regexp_matches(c, '^([A-Z2-7]+|[a-z2-7]+)$') THEN 32 WHEN regexp_matches(c, '^([0-9A-Z]+|[0-9a-z]+)$') THEN 36 ELSE 64 END AS k, length(c)::DOUBLE AS n FROM r),
        x AS (SELECT *, list_transform(string_split(c, ''), lambda y: CASE k WHEN 16 THEN {rank("0123456789abcdef", "lower(y)")} WHEN 32 THEN {rank(secrets.BASE32, "upper(y)")} WHEN 36 THEN {rank(secrets.BASE36, "upper(y)")} ELSE {rank(secrets.BASE64, "translate(y, '-_', '+/')")} END) AS x,
            least(16, k, CASE WHEN n >= 96 THEN CASE WHEN k = 36 THEN 12 ELSE 16 END WHEN n >= 48 THEN CASE WHEN k = 36 THEN 6 ELSE 8 END ELSE 4 END) AS cells FROM k),
        z AS (SELECT *, list_sum(list_transform(range(0, cells), lambda j: pow(len(list_filter(x, lambda y: y * cells // k = j)), 2))) * cells / n - n AS chi,
            (list_sum(list_transform(range(1, len(x)), lambda i: ((x[i] * 2 >= k) <> (x[i + 1] * 2 >= k))::INT)) - (n - 1) / 2) / sqrt((n - 1) / 4) AS z_runs,
            list_sum(list_transform(range(1, len(x)), lambda i: (x[i] - (k - 1) / 2.0) * (x[i + 1] - (k - 1) / 2.0))) / (sqrt(n - 1) * (k * k - 1) / 12.0) AS z_serial,
            n - length(translate(lower(c), '{secrets.COMMON}', '')) AS common, {float(len(secrets.COMMON))} / k * CASE WHEN k = 64 THEN 2 ELSE 1 END AS share FROM x),
        y AS (SELECT *, (len(list_filter(x, lambda v: v >= 62)) - 0.5 - n / 32) / sqrt(n / 32 * (1 - 1.0 / 32)) AS z_marks, (greatest(len(list_filter(x, lambda v: v < 26)), len(list_filter(x, lambda v: v >= 26 AND v < 52))) - 0.5 - n * 26 / 64) / sqrt(n * 26 / 64 * 38 / 64) AS z_case, (cbrt(greatest(chi, 0.0) / (cells - 1)) - (1 - 2 / (9.0 * (cells - 1)))) / sqrt(2 / (9.0 * (cells - 1))) AS z_chi, (common - 0.5 - n * share) / sqrt(n * share * (1 - share)) AS z_common FROM z),
        q AS (SELECT *, least(1.0, 6 * least(CASE WHEN k = 64 AND z_case > 0 THEN {tail("z_case")} ELSE 1.0 END, CASE WHEN k = 64 AND z_marks > 0 THEN {tail("z_marks")} / 2 ELSE 1.0 END, CASE WHEN z_chi > 0 THEN {tail("z_chi")} / 2 ELSE 1 - {tail("z_chi")} / 2 END, {tail("z_runs")}, {tail("z_serial")}, CASE WHEN k > 16 AND z_common > 0 THEN {tail("z_common")} / 2 ELSE 1.0 END)) AS p FROM y),
        b AS (SELECT doc, s, e, {bands} AS band, least({secrets.MAX_BIN}, floor(-log10(p) / {secrets.BIN}))::INT AS bin FROM q),
        h AS (SELECT band, bin, sum(count(*)) OVER (PARTITION BY band ORDER BY bin DESC) AS seen, sum(count(*)) OVER (PARTITION BY band) AS total FROM b GROUP BY 1, 2),
        cut AS (SELECT band, min(bin) FILTER (WHERE pow(10.0, -bin * {secrets.BIN}) <= {secrets.FDR} * seen / total) AS cut FROM h GROUP BY 1),
        a AS (SELECT doc, rank, s, e FROM f WHERE rank < 3 UNION ALL SELECT doc, 3, s, e FROM b JOIN cut USING (band) WHERE (cut IS NULL OR bin < cut)
            AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc = b.doc AND f.rank < 3 AND f.s <= b.s AND f.e >= b.e))
        SELECT any_value(doc_id) AS doc_id, {many(0)} AS n_assign, {many(1)} AS n_access, {many(2)} AS n_hex, sha256({text(3)}) AS base_sha256, {text(4)} AS spans, {many(3)} AS n_random FROM d LEFT JOIN a USING (doc) GROUP BY doc"""


def _crc32_sql(s: str) -> str:
    """Unsigned CRC-32 of an ASCII string, a bit at a time."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda x: unicode(x)::BIGINT)), lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295::BIGINT)"


def _trie_sql() -> str:
    """Every prefix of every rebuilt conversation as a list of digests, and each node under all of its ancestors."""
    return f"""WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS MATERIALIZED (SELECT conv_id, k, length(text) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM (SELECT *, sha256(length(role) || ':' || role || text) AS k FROM o)),
    c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT c.conv_id, 0 AS part, t.pos, t.k, t.tokens FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h UNION ALL SELECT c.conv_id, 1, t.pos, t.k, t.tokens FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
    q AS (SELECT c.conv_id, coalesce(list(r.k ORDER BY part, pos) FILTER (WHERE r.k IS NOT NULL), []) AS ks, coalesce(list(r.tokens ORDER BY part, pos) FILTER (WHERE r.k IS NOT NULL), []) AS ls FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY 1),
    p AS (SELECT conv_id, d, ks[1:d] AS key, CASE WHEN d > 0 THEN ls[d] ELSE 0 END AS tokens, d = len(ks) AS ended FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM q)),
    nodes AS MATERIALIZED (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(tokens) AS tokens, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '') AS ends FROM p GROUP BY 1, 2),
    kids AS MATERIALIZED (SELECT d - 1 AS d, key[1:d - 1] AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
    full_nodes AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM nodes n LEFT JOIN kids ON kids.d = n.d AND kids.key = n.key),
    up AS (SELECT a AS d, key[1:a] AS key, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * tokens) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY 1, 2)
    SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM full_nodes n JOIN up u ON u.d = n.d AND u.key = n.key LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = n.key[1:n.d - 1]"""


def _passages_sql() -> str:
    """Every window of every text, by MD5; the first of each stays."""
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n FROM d),
    w AS (SELECT doc, doc_id, p, md5(array_slice(b, p + 1, p + {PASSAGES["width"]})) AS s FROM (SELECT *, unnest(range(0, n - {PASSAGES["width"]} + 1)) AS p FROM n WHERE n >= {PASSAGES["width"]})),
    a AS MATERIALIZED (SELECT doc, p FROM (SELECT doc, p, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, doc, p) AS k FROM w) WHERE k > 1),
    g AS (SELECT doc, p, sum(new) OVER (PARTITION BY doc ORDER BY p) AS run FROM (SELECT doc, p, coalesce((p > lag(p) OVER (PARTITION BY doc ORDER BY p) + {PASSAGES["width"]})::INT, 1) AS new FROM a)),
    r AS (SELECT doc, min(p) AS s, max(p) + {PASSAGES["width"]} AS e FROM g GROUP BY doc, run),
    k AS (SELECT doc, s, e, lag(e, 1, 0) OVER (PARTITION BY doc ORDER BY s) AS after FROM r),
    x AS (SELECT n.doc, doc_id, n, coalesce(sum(e - s), 0) AS gone, count(s) AS spans, coalesce(string_agg(hex(array_slice(b, after + 1, s)), '' ORDER BY s), '') || hex(array_slice(b, coalesce(max(e), 0) + 1, n)) AS kept FROM n LEFT JOIN k ON k.doc = n.doc GROUP BY n.doc, doc_id, n, b)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM x"""


def _repair_sql() -> str:
    """The costs left to pay from the last row back, then the least letter on a cheapest way from the first row on."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit FROM conversations),
    d AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS tie, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS again, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
        CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM o WHERE hit <> 0),
    n AS (SELECT *, row_number() OVER c AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, tie, again) AS seen, right(rtrim(text, {space}), 1) AS last FROM d WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie, again)),
    r AS MATERIALIZED (SELECT *, CASE WHEN last = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS ini, count(*) OVER (PARTITION BY conv_id) AS m, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM n),
    stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
        count(*) FILTER (WHERE i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
    -- What is left to pay before row i in each state: start, after s, after u, after a pair.
    pay(conv_id, i, a, b, c, e) AS (SELECT conv_id, max(i) + 1, 0, 6, 3, 0 FROM r GROUP BY 1
        UNION ALL SELECT conv_id, i, least(a, c + 3, e + 6), least(b, c + 3, e + 6), least(c, e + 3), least(e, c + 3) FROM (SELECT p.conv_id, r.i,
            least(4 + p.a, CASE WHEN r.fault IN ('b', 'd') THEN 999999999 ELSE least(3 + p.c, CASE r.ini WHEN 's' THEN p.b WHEN 'u' THEN p.c ELSE 999999999 END) + CASE r.fault WHEN 't' THEN 3 ELSE 0 END END) AS a,
            least(4 + p.b, CASE WHEN r.fault IN ('b', 'd') THEN 999999999 ELSE least(3 + p.c, CASE r.ini WHEN 'u' THEN p.c ELSE 999999999 END) + CASE r.fault WHEN 't' THEN 3 ELSE 0 END END) AS b,
            least(4 + p.c, CASE WHEN r.fault IN ('b', 'd') THEN 999999999 ELSE least(3 + p.e, CASE r.ini WHEN 'a' THEN p.e ELSE 999999999 END) + CASE r.fault WHEN 't' THEN 3 ELSE 0 END END) AS c,
            least(4 + p.e, CASE WHEN r.fault IN ('b', 'd') THEN 999999999 ELSE least(3 + p.c, CASE r.ini WHEN 'u' THEN p.c ELSE 999999999 END) + CASE r.fault WHEN 't' THEN 3 ELSE 0 END END) AS e
            FROM pay p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i - 1)),
    owed AS (SELECT conv_id, i, unnest([0, 1, 2, 3]) AS state, unnest([a, b, c, e]) AS pay FROM pay),
    -- The edits in order: the least letter that keeps to a cheapest way.
    walk(conv_id, i, state, pay, audit, done, made) AS (SELECT conv_id, 1::BIGINT, 0, pay, '', false, CAST('' AS VARCHAR) FROM owed WHERE i = 1 AND state = 0
        UNION ALL SELECT conv_id, i2, state2, pay2, audit || letter, false, made || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE state WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || CASE letter WHEN 'R' THEN text ELSE '' END END FROM (
            SELECT w.*, o.i AS i2, o.state AS state2, o.pay AS pay2, s.letter, r.role, r.text, row_number() OVER (PARTITION BY w.conv_id ORDER BY s.letter) AS k
            FROM walk w CROSS JOIN (VALUES ('D'), ('I'), ('K'), ('R')) s(letter) LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i
            JOIN owed o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + CASE s.letter WHEN 'I' THEN 0 ELSE 1 END
                AND o.state = CASE s.letter WHEN 'D' THEN w.state WHEN 'K' THEN CASE r.ini WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 END ELSE CASE w.state WHEN 2 THEN 3 ELSE 2 END END
                AND (s.letter <> 'K' OR CASE r.ini WHEN 's' THEN w.state = 0 WHEN 'u' THEN w.state <> 2 WHEN 'a' THEN w.state = 2 ELSE false END)
                AND (s.letter NOT IN ('K', 'R') OR r.fault NOT IN ('b', 'd'))
                AND w.pay = o.pay + CASE s.letter WHEN 'D' THEN 4 WHEN 'I' THEN 3 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN s.letter IN ('K', 'R') AND r.fault = 't' THEN 3 ELSE 0 END) WHERE k = 1),
    ends AS (SELECT conv_id, arg_max(audit, (i, length(audit))) AS audit, sha256(substr(arg_max(made, (i, length(audit))), 2)) AS sha FROM walk GROUP BY 1)
    SELECT c.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(s.blank, 0) AS BIGINT) AS blank, CAST(coalesce(s.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(s.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(s.illegal, 0) AS BIGINT) AS illegal,
        CAST(coalesce(p.pay, 0) AS BIGINT) AS cost, coalesce(e.audit, '') AS audit, coalesce(e.sha, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN owed p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = 1 AND p.state = 0 LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express: the others rest on seeded or 64-bit hashes,
    dynamic programming, a tokenizer library or a trained model, and are tested by brute force."""
    often = f">= {LM['min_count']}"
    lm = f"""WITH d AS ({_WORDS}), w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
        p AS (SELECT doc_id, w, lag(w) OVER doc AS v, lag(w, 2) OVER doc AS u FROM w WINDOW doc AS (PARTITION BY doc_id ORDER BY i)),
        c1 AS (SELECT w, count(*) AS n FROM w GROUP BY 1), t AS (SELECT count(*) AS n FROM w),
        c2 AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY 1, 2), c3 AS (SELECT u, v, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY 1, 2, 3),
        s AS (SELECT p.doc_id, CASE WHEN p.u IS NOT NULL THEN coalesce(c3.n, 0) ELSE coalesce(c2.n, 2) END < {LM["min_count"]} AS backoff,
            CASE WHEN c3.n {often} THEN ln(c3.n::DOUBLE / h2.n)
            WHEN c2.n {often} THEN ln(c2.n::DOUBLE / h1.n) + CASE WHEN p.u IS NULL THEN 0 ELSE ln({LM["alpha"]}) END
            ELSE ln(c1.n::DOUBLE / t.n) + (CASE WHEN p.u IS NOT NULL THEN 2 WHEN p.v IS NOT NULL THEN 1 ELSE 0 END) * ln({LM["alpha"]}) END AS score
            FROM p JOIN c1 ON c1.w = p.w LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w LEFT JOIN c3 ON c3.u = p.u AND c3.v = p.v AND c3.w = p.w
            LEFT JOIN c1 h1 ON h1.w = p.v LEFT JOIN c2 h2 ON h2.v = p.u AND h2.w = p.v CROSS JOIN t)
        SELECT d.doc_id, CAST(count(s.score) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE s.backoff) AS BIGINT) AS n_backoff,
        round(coalesce(sum(s.score), 0), 6) AS log_score, round(sum(s.score) / count(s.score), 6) AS mean_log_score FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1"""
    near = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), ids AS (SELECT id FROM v),
        links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= {NEAR["cosine"]}),
        {_COMPONENTS}, n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY 1)
        SELECT parts.id AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, parts.component_id, parts.id = parts.component_id AS kept FROM parts LEFT JOIN n ON n.id = parts.id"""
    k = JACCARD["width"]
    jaccard = f"""WITH RECURSIVE d AS ({_WORDS}), ids AS (SELECT doc_id AS id FROM d),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {k} THEN list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {JACCARD["percent"]} * (x.n + y.n - k)), {_COMPONENTS}
        SELECT parts.id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, parts.component_id FROM parts LEFT JOIN n ON n.doc_id = parts.id"""
    return {"op1_lm_scoring": lm, "op2_embedding_near_dedup": near, "op5_jaccard_join": jaccard, "op10_secret_scan": _secrets_sql(), "op11_conversation_trie": _trie_sql(), "op12_suffix_dedup": _passages_sql(), "op13_conversation_repair": _repair_sql()}
