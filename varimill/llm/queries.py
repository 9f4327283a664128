"""The registered queries of the subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varimill.llm import (
    centroids,
    decontaminate,
    jaccard_join,
    packing,
    pieces,
    quality_model,
    quality_rules,
    secrets,
    spelling,
    substring_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from varimill.llm.frames import small_batches
from varimill.sources.tables import read_table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")
    small_batches(spark)
    return quality_model.classify(docs, trusted)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = jaccard_join.join_classes(read_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "n_shingles", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, keep=["doc_id"]).select(
        "doc_id", *quality_rules.STATS[:5], "base_failed", "kept", "broken_rules"
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("text")
    path = tokenizer("byte_bpe_50k.tiktoken")
    lengths = token_counts.token_lengths(docs, path, public_tokenizers.PATTERN)
    return token_counts.limit_report(token_counts.length_histogram(lengths))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode_decode(docs, tokenizer("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("piece_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        "predicted",
        "n_marks",
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("leaked"),
        F.col("leaks.item_id").alias("item_ids"),
        F.array_min("leaks.edits").alias("least_edits"),
    )


SLIP_EVERY = 199  # one letter goes from a run whose hash this divides


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    words = spelling.vocabulary(spelling.with_slips(spelling.runs(docs), SLIP_EVERY))
    return spelling.group_variants(words)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, tokenizer("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_quality_classifier, op3_jaccard_join, op4_quality_rules, op5_secret_scan, op6_substring_dedup, op7_token_counts, op8_sentencepiece, op9_toxicity, op10_decontamination, op11_spelling_variants, op12_centroids, op13_packing)}


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """Matches and the pieces between them, with running sums for places; then the
    parts of a document are joined on their distance."""
    found = []
    for kind, group in (("assign", 2), ("access", 0), ("hex", 0), ("user", 3), ("endpoint", 0)):
        pattern = _sql_text(secrets._PATTERNS[kind])
        found.append(
            f"SELECT doc_id, '{kind}' AS pattern, unnest(range(len(w))) AS i, unnest(w) AS whole,"
            f" unnest(v) AS val, unnest(b[:len(w)]) AS before FROM (SELECT doc_id,"
            f" regexp_extract_all(text, {pattern}, 0) AS w,"
            f" regexp_extract_all(text, {pattern}, {group}) AS v,"
            f" regexp_split_to_array(text, {pattern}) AS b FROM docs)"
        )
    scope = secrets.SCOPE
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(secrets.KINDS)) + " END"
    role = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, (r, _) in secrets.KINDS.items()) + " END"
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)}),
placed AS (
  SELECT doc_id, CASE WHEN pattern <> 'assign' THEN pattern
                      WHEN length(val) >= {secrets.ASSIGN_CHARS} THEN 'assign'
                      WHEN length(val) >= {secrets.SHORT_CHARS} THEN 'short' END AS kind,
         length(whole) AS size,
         CAST(sum(length(before) + length(whole)) OVER
              (PARTITION BY doc_id, pattern ORDER BY i) AS BIGINT) AS e
  FROM found),
parts AS (SELECT doc_id, kind, {role} AS part, {order} AS o, e - size AS s, e
          FROM placed WHERE kind IS NOT NULL),
kept AS (
  SELECT doc_id, kind, o, s, e FROM parts WHERE kind IN ({base})
  UNION ALL
  SELECT doc_id, kind, o, s, e FROM parts w WHERE kind NOT IN ({base}) AND EXISTS (
    SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND (p.part = 'secret') <> (w.part = 'secret')
      AND p.s <= w.e + {scope} AND p.e >= w.s - {scope})),
agg AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
         count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         {listed} FILTER (kind IN ({base})) AS base, {listed} AS spans
  FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM docs LEFT JOIN agg USING (doc_id)"""


def _crc32_sql(codes: str) -> str:
    """The unsigned crc32 of a list of bytes."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        table.append(str(c))
    step = f"xor(c >> 8, [{', '.join(table)}][(xor(c, x) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, x: {step}), 4294967295)"


def _spelling_sql() -> str:
    """The slips by a crc32 in SQL; neighbours by equal rests without one letter."""
    least, count, times = spelling.LEAST_LETTERS, spelling.LEAST_COUNT, spelling.TIMES
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # All letters have one byte or two.
    codes = """flatten(list_transform(string_split(key, ''), lambda c:
        CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
             ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END))"""
    return f"""
WITH RECURSIVE found AS (
  SELECT doc_id, translate(run, '{upper}', '{upper.lower()}') AS run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{{least},}}')) AS run FROM documents)
  GROUP BY ALL),
hashed AS (
  SELECT run, n, {_crc32_sql(codes)} AS h
  FROM (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM found)),
slipped AS (
  SELECT n, CASE WHEN h % {SLIP_EVERY} = 0
                 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {least}
  GROUP BY word HAVING sum(n) >= {count}),
gaps AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS gap
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gaps g JOIN words w ON g.gap = w.word
  UNION SELECT w.word, g.word FROM gaps g JOIN words w ON g.gap = w.word),
ranked AS (
  SELECT p.word, count(*) OVER (PARTITION BY p.word) AS n_near, p.near, w.n AS near_n,
         row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place
  FROM pairs p JOIN words w ON w.word = p.near),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.near_n >= {times} * w.n THEN r.near END AS form,
         CASE WHEN r.near_n >= {times} * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
walk AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL),
roots AS (SELECT walk.word, walk.at FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(r.at, f.word) AS root, f.n, f.n_near, f.form_n
FROM forms f LEFT JOIN roots r ON r.word = f.word"""


def _centroids_sql() -> str:
    """The rounds one after the other, with all distances."""
    size, k = centroids.DIMENSIONS, centroids.CENTROIDS
    places = f"range(1, {size} + 1)"
    square = "(p.v[i] - c.v[i]) * (p.v[i] - c.v[i])"
    steps = []
    for turn in range(centroids.ROUNDS + 1):
        steps.append(f"""a{turn} AS MATERIALIZED (
  SELECT p.r, min(struct_pack(d := CAST(list_sum(list_transform({places}, lambda i: {square})) AS BIGINT), c := c.c)) AS b
  FROM points p, c{turn} c GROUP BY p.r)""")
        if turn < centroids.ROUNDS:
            steps.append(f"""s{turn} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (
    SELECT a.b.c AS c, unnest({places}) AS i, unnest(p.v) AS x FROM a{turn} a JOIN points p USING (r))
  GROUP BY c, i),
c{turn + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{turn} c LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{turn} GROUP BY c) m USING (c))""")
    last = centroids.ROUNDS
    return f"""
WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor({centroids.GRID} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
    SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM points ORDER BY h, v LIMIT {k})),
{", ".join(steps)}
SELECT p.vec_id, CAST(a.b.c AS INTEGER) AS cluster, a.b.d AS distance,
       CAST(sum(a.b.d) OVER (PARTITION BY a.b.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{last} a JOIN points p USING (r) JOIN c{last} c ON c.c = a.b.c"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_secret_scan": _secrets_sql(),
        "op11_spelling_variants": _spelling_sql(),
        "op12_centroids": _centroids_sql(),
    }
