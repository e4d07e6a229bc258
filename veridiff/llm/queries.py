"""The registered queries of the corpus operators: thin calls with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_components

    return similar_components(table(spark, sf_dir, "documents"))


#: Shingle sets, links by counting shared shingles, and the smallest id reachable.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n_shingles + q.n_shingles - k)),
r(node, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.reach)
SELECT n.doc_id, n.n_shingles, min(reach) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "id % 100 = 0", k=10)


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotations import link_quotations

    return link_quotations(table(spark, sf_dir, "conversations"))


OP5_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id AS conv, turn, role, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS lines FROM conversations),
l AS (SELECT conv, turn, unnest(lines) AS line FROM m WHERE conv IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT conv, turn, len(translate(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), ' ' || chr(9), '')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', '')), '[\s\x{A0}]+', ' ', 'g')) AS body FROM l),
q AS (SELECT conv, turn, body, min(level) AS level, count(*) AS n FROM p WHERE level > 0 AND body <> '' GROUP BY ALL),
o AS (SELECT DISTINCT conv, turn AS parent, body FROM p WHERE level = 0 AND body <> ''),
e AS (SELECT q.conv, q.turn, q.level, q.n, max(o.parent) AS parent FROM q JOIN o ON q.conv = o.conv AND q.body = o.body AND o.parent < q.turn GROUP BY q.conv, q.turn, q.body, q.level, q.n),
v AS (SELECT conv, turn, parent, sum(CASE WHEN level = 1 THEN n ELSE 0 END) AS direct, sum(n) AS linked FROM e GROUP BY ALL),
b AS (SELECT conv, turn, parent, linked FROM v QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY direct DESC, linked DESC, parent DESC) = 1),
t(conv, turn, root, depth) AS (SELECT conv, turn, parent, 1 FROM b UNION ALL SELECT t.conv, t.turn, b.parent, t.depth + 1 FROM t JOIN b ON b.conv = t.conv AND b.turn = t.root),
d AS (SELECT conv, turn, root, depth FROM t QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY depth DESC) = 1),
k AS (SELECT conv, turn, role, lines, list_transform(lines, lambda x: regexp_matches(x, '^[ \t]*(?:>[ \t]*)+')) AS quoted FROM m)
SELECT k.conv AS conv_id, k.turn, k.role, b.parent AS parent_turn, coalesce(d.root, k.turn) AS root_turn, coalesce(d.depth, 0)::INTEGER AS depth,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*(?:>[ \t]*)+') AND trim(regexp_replace(x, '^[ \t]*(?:>[ \t]*)+', '')) <> ''))::INTEGER AS n_quoted,
  coalesce(b.linked, 0)::BIGINT AS n_linked,
  lpad(coalesce(d.root, k.turn)::VARCHAR, 19, '0') || '/' || lpad(k.turn::VARCHAR, 19, '0') AS order_key,
  regexp_replace(regexp_replace(array_to_string(list_filter(lines, lambda x, i: NOT (quoted[i] OR (regexp_matches(x, '(?i)^.{0,200}\b(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$') AND coalesce(quoted[i + 1], false)))), chr(10)),
    '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text
FROM k LEFT JOIN b ON b.conv = k.conv AND b.turn = k.turn LEFT JOIN d ON d.conv = k.conv AND d.turn = k.turn
"""


def quoting_conversations(conversations: DataFrame) -> DataFrame:
    """``conversations`` as mail programs would have made them: every odd turn quotes the turn before it, every third turn also
    the one before that at a second level, and every fourth conversation opens with the same line in each turn."""
    talk = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    talk = talk.withColumn("text", F.expr("if(conv_id % 4 = 0, concat('Dear all,\n', text), text)"))

    def earlier(by: int, name: str) -> DataFrame:
        first = talk.groupBy("conv_id", "turn").agg(F.min("text").alias(name))
        return first.select("conv_id", (F.col("turn") + by).alias("turn"), name)

    out = talk.join(earlier(1, "t1"), ["conv_id", "turn"], "left").join(earlier(2, "t2"), ["conv_id", "turn"], "left")
    once = F.expr("if(turn % 2 = 1 and t1 is not null, concat('They wrote:\n> ', replace(t1, '\n', '\n> '), '\n'), '')")
    twice = F.expr("if(turn % 3 = 0 and t2 is not null, concat('> > ', replace(t2, '\n', '\n> > '), '\n'), '')")
    return out.select("conv_id", "turn", "role", F.concat(once, twice, "text").alias("text"))


def quotation_linking_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking where messages do quote: the given conversations hold no quotes."""
    from .quotations import link_quotations

    return link_quotations(quoting_conversations(table(spark, sf_dir, "conversations")))


QUOTING_SQL = r"""
talk AS (SELECT conv_id, turn::BIGINT AS turn, role, CASE WHEN conv_id % 4 = 0 THEN 'Dear all,' || chr(10) ELSE '' END || coalesce(text, '') AS text FROM conversations),
first_text AS (SELECT conv_id, turn, min(text) AS t FROM talk GROUP BY ALL),
quoting AS (SELECT c.conv_id, c.turn, c.role,
    CASE WHEN c.turn % 2 = 1 AND a.t IS NOT NULL THEN 'They wrote:' || chr(10) || '> ' || replace(a.t, chr(10), chr(10) || '> ') || chr(10) ELSE '' END ||
    CASE WHEN c.turn % 3 = 0 AND b.t IS NOT NULL THEN '> > ' || replace(b.t, chr(10), chr(10) || '> > ') || chr(10) ELSE '' END || c.text AS text
  FROM talk c LEFT JOIN first_text a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN first_text b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
"""
REPLIES_SQL = OP5_SQL.replace("WITH RECURSIVE ", "WITH RECURSIVE" + QUOTING_SQL).replace("FROM conversations),\nl AS", "FROM quoting),\nl AS")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import encode

    return encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), ids=False, check=True)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("locator")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures of the day page_id names, against a dated list made from their own hosts.

    No public list is at hand and pages carry no fetch time, so both follow from the rows by plain rules: a capture is
    fetched on day page_id mod 365 of 2024; hosts whose length leaves 0 by 3 are listed from day 7 x length mod 200 on, those
    of even length for 60 days only; gambling hosts are listed by parent domain for the first half of the year."""
    from .url_filters import host_of, judge

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 365 as int))").alias("fetched"))
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key <> ''").distinct()
    listed = hosts.where("length(key) % 3 = 0").withColumn("day", F.expr("date_add(date'2024-01-01', (7 * length(key)) % 200)"))
    added = listed.select("key", F.lit("dated").alias("category"), "day", F.lit("add").alias("action"))
    gone = listed.where("length(key) % 2 = 0").select("key", F.lit("dated").alias("category"), F.date_add("day", 60).alias("day"), F.lit("remove").alias("action"))
    bets = hosts.where("key like '%bets%'").select(F.expr("regexp_extract(key, '([^.]+[.][^.]+[.][^.]+)$', 1)").alias("key")).where("key <> ''").distinct()
    bets = bets.select("key", F.lit("gambling").alias("category"), F.explode(F.expr("array(named_struct('d', date'2024-01-01', 'a', 'add'), named_struct('d', date'2024-07-01', 'a', 'remove'))")).alias("e")).select("key", "category", "e.d", "e.a").toDF("key", "category", "day", "action")
    out = judge(pages, added.unionByName(gone).unionByName(bets))
    return out.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "blocked", "n_entries", F.array_join("categories", ",").alias("categories"))


OP9_SQL = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 365)::INTEGER AS fetched,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*[^/:?#.])', 1) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS seg FROM pages),
h AS (SELECT DISTINCT host AS key FROM c WHERE host <> ''),
b AS (SELECT DISTINCT regexp_extract(key, '([^.]+[.][^.]+[.][^.]+)$', 1) AS key FROM h WHERE key LIKE '%bets%'),
i AS (SELECT key, 'dated' AS category, DATE '2024-01-01' + ((7 * length(key)) % 200)::INTEGER AS f,
    CASE WHEN length(key) % 2 = 0 THEN DATE '2024-01-01' + ((7 * length(key)) % 200 + 60)::INTEGER END AS t FROM h WHERE length(key) % 3 = 0
  UNION ALL SELECT key, 'gambling', DATE '2024-01-01', DATE '2024-07-01' FROM b WHERE key <> ''),
k AS (SELECT page_id, fetched, unnest(list_distinct(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda j: array_to_string(string_split(host, '.')[j:], '.')),
    list_transform(range(1, len(seg) + 1), lambda j: host || '/' || array_to_string(seg[1:j], '/'))))) AS key FROM c WHERE host <> ''),
m AS (SELECT page_id, count(*) AS n_entries, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories
  FROM k JOIN i USING (key) WHERE f <= fetched AND (t IS NULL OR fetched < t) GROUP BY page_id)
SELECT page_id, url, fetched::DATE::VARCHAR AS fetched, n_entries IS NOT NULL AS blocked, coalesce(n_entries, 0) AS n_entries, coalesce(categories, '') AS categories
FROM c LEFT JOIN m USING (page_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc32_utf8
    from .toxicity import learn_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(crc32_utf8(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_best_fit_packing,
        op3_token_counts,
        op4_nearest_neighbours,
        op5_quotation_linking,
        quotation_linking_replies,
        op6_html_extraction,
        op7_sentencepiece,
        op8_exact_dedup,
        op9_url_filters,
        op10_toxicity,
    )
}
ORACLE_SQL = {"op1_ngram_jaccard_join": OP1_SQL, "op5_quotation_linking": OP5_SQL, "quotation_linking_replies": REPLIES_SQL, "op8_exact_dedup": OP8_SQL, "op9_url_filters": OP9_SQL}
