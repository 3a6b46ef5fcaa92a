"""Queries over documents and chunks: statistics, cleaning, splitting, packing, chunking, annotation, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.functions import ranges, text
from lorewright.operators import annotate, chunks, tiers
from lorewright.plans.registry import query, table
from lorewright.sources import files

# shared pieces of SQL
_TOKEN = text.TOKEN.replace("'", "''")
_B = r"[ \t\n\r\f\x0B]"
_TOK = f"regexp_extract_all({{0}}, '{_TOKEN}')"


def _toks(e: str) -> str:
    return _TOK.format(e)


_PARAS = rf"string_split_regex({{0}}, '{_B}*\n{_B}*\n{_B}*')"
_SENTS = rf"string_split(regexp_replace({{0}}, '([.!?]){_B}+', '\1' || chr(1), 'g'), chr(1))"
_TRIM = rf"regexp_replace(regexp_replace({{0}}, '^{_B}+', ''), '{_B}+$', '')"
_LINE_SENTS = (
    "list_filter(flatten(list_transform(string_split({0}, chr(10)), lambda x: "
    + rf"string_split(regexp_replace({_TRIM.format('x')}, '([.!?])(?:{_B}+|$)', '\1' || chr(1), 'g'), chr(1)))), lambda x: x <> '')"
)


@query("SELECT source, count(*) AS n_docs FROM documents WHERE rel_path LIKE '%.md' AND rel_path NOT LIKE '%valid_document_index%' GROUP BY source")
def corpus_file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("rel_path").endswith(".md") & ~F.col("rel_path").contains("valid_document_index"))
    return d.groupBy("source").agg(F.count("*").alias("n_docs"))


@query(
    f"""
WITH t AS (SELECT source, rel_path, len({_toks("coalesce(text, '')")}) AS n FROM documents)
SELECT source, count(*) AS n_docs, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS mean_tokens, max(n)::BIGINT AS max_tokens,
       arg_min(rel_path, (-n, rel_path)) AS longest
FROM t GROUP BY source"""
)
def corpus_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "rel_path", text.token_count(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    return d.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.sum("n").alias("tokens"),
        F.round(F.avg("n"), 6).alias("mean_tokens"),
        F.max("n").alias("max_tokens"),
        F.min_by("rel_path", F.struct(-F.col("n"), F.col("rel_path"))).alias("longest"),
    )


@query("SELECT doc_id, regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL")
def newline_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.collapse_newlines(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '(?:[0-9]+\\n)+', '', 'g') AS text FROM documents WHERE text IS NOT NULL")
def number_line_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.strip_number_lines(F.col("text")).alias("text"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\[([^\]\n]*)\]\(([^)\n]*)\)', 2)) AS target FROM documents WHERE text IS NOT NULL")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.link_targets(F.col("text"))).alias("target"))


def _rewritten(t: str, images: bool) -> str:
    """One call of rewrite_links in SQL, which has no look-around: absolute targets are marked by chr(2), the brackets of images by
    chr(3), and backslashes are mended in what stands between a bracket and its end."""
    head = r"!\[[^\]\n]*\]\(" if images else r"\[[^\]\n]*\]\("
    x = t if images else f"replace({t}, '![', chr(3))"
    x = f"regexp_replace({x}, '({head})(https?:|#|mailto:)', '\\1' || chr(2) || '\\2', 'g')"
    x = f"regexp_replace({x}, '({head})[/\\\\]*((?:[^\x02)/\\\\\n][^)\n]*)?)\\)', '\\1' || chr(1) || '/\\2)', 'g')"
    if not images:
        x = f"regexp_replace({x}, '(\x01/[^)\n]*\\.(?:pdf|html|htm))\\)', '\\1.md)', 'g')"
    x = f"list_transform(string_split(replace(replace({x}, chr(2), ''), chr(3), '!['), ')'), lambda p, i: struct_pack(p := p, i := i))"
    return x


def _mended(parts: str) -> str:
    tail = r"regexp_extract(y.p, '[^()\n]*$')"
    return f"replace(list_aggregate(list_transform({parts}, lambda y: CASE WHEN y.i = len({parts}) THEN y.p ELSE left(y.p, length(y.p) - length({tail})) || replace({tail}, '\\', '/') END), 'string_agg', ')'), chr(1), base)"


@query(
    f"""WITH d AS (SELECT doc_id, text AS t, regexp_replace(regexp_extract(url, '^(https?://[^/]+)', 1), '/+$', '') AS base FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, base, {_rewritten("t", True)} AS p FROM d), b AS (SELECT doc_id, base, {_mended("p")} AS t FROM a),
c AS (SELECT doc_id, base, {_rewritten("t", False)} AS p FROM b) SELECT doc_id, {_mended("p")} AS text FROM c"""
)
def link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    base = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    return d.select("doc_id", text.rewrite_links(text.rewrite_links(F.col("text"), base, images=True), base).alias("text"))


@query(f"SELECT doc_id, i - 1 AS pos, p[i] AS paragraph FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {_PARAS.format('text')} AS p FROM documents WHERE text IS NOT NULL))")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@query(f"SELECT doc_id, i - 1 AS pos, p[i] AS sentence FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {_SENTS.format('text')} AS p FROM documents WHERE text IS NOT NULL))")
def sentence_split_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences_at_blank(F.col("text"))).alias("pos", "sentence"))


@query(f"SELECT doc_id, i - 1 AS pos, p[i] AS sentence FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {_LINE_SENTS.format('text')} AS p FROM documents WHERE text IS NOT NULL))")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.line_sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"SELECT source, sum(len({_LINE_SENTS.format('text')}))::BIGINT AS sentences FROM documents WHERE text IS NOT NULL GROUP BY source")
def sentence_count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy("source").agg(F.sum(F.size(text.line_sentences(F.col("text"))).cast("bigint")).alias("sentences"))


@query(f"SELECT doc_id, list_aggregate({_toks('text')}[1:100], 'string_agg', '') AS head FROM documents WHERE text IS NOT NULL AND text <> ''")
def token_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null and text <> ''").select("doc_id", text.truncate(F.col("text"), 100).alias("head"))


_CHUNKS = f"""
t AS (SELECT doc_id, source, rel_path, {_toks('text')} AS tok FROM documents WHERE text IS NOT NULL AND text <> ''),
s AS (SELECT doc_id, source, rel_path, tok, unnest(range(0, len(tok), 1100)) AS p FROM t),
c AS (SELECT doc_id, source, replace(rel_path, '/', '_') || '_chunk_' || (p // 1100) AS chunk_id, p,
             coalesce(list_aggregate(list_transform(tok[1:p], lambda x: length(x)), 'sum'), 0)::BIGINT AS start_char_pos,
             list_aggregate(tok[p + 1:p + 1200], 'string_agg', '') AS chunk, len(tok[p + 1:p + 1200]) AS n_tokens FROM s)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_id, start_char_pos, start_char_pos + length(chunk) AS end_char_pos, n_tokens, md5(chunk) AS digest FROM c")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks.token_chunks(table(spark, sf_dir, "documents"), "text", "rel_path")
    return c.select("doc_id", "chunk_id", "start_char_pos", "end_char_pos", "n_tokens", F.md5("chunk").alias("digest"))


@query(
    f"""WITH {_CHUNKS}, f AS (SELECT *, length(chunk) AS n_chars, len({_LINE_SENTS.format('chunk')}) AS n_sentences FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_tokens DESC, n_chars DESC, chunk_id) AS place FROM f)
SELECT source, place, chunk_id, n_tokens, n_chars, n_sentences FROM r WHERE place <= 5"""
)
def longest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest chunks per source with their sentence and token counts."""
    c = chunks.token_chunks(table(spark, sf_dir, "documents"), "text", "rel_path")
    c = c.select("source", "chunk_id", "n_tokens", F.length("chunk").alias("n_chars"), F.size(text.line_sentences(F.col("chunk"))).alias("n_sentences"))
    w = Window.partitionBy("source").orderBy(F.desc("n_tokens"), F.desc("n_chars"), "chunk_id")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 5").select("source", "place", "chunk_id", "n_tokens", "n_chars", "n_sentences")


@query("SELECT doc_id, replace(source || '/' || rel_path, '/', '_') || '_chunk_0' AS chunk_id, 0 AS start_char_pos, length(text) AS end_char_pos FROM documents WHERE text IS NOT NULL")
def whole_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.whole_chunks(table(spark, sf_dir, "documents"), "text", F.concat_ws("/", "source", "rel_path")).select("doc_id", "chunk_id", "start_char_pos", "end_char_pos")


_N = f"len({_toks('{0}')})"
_UNITS = (
    "flatten(list_transform(" + _PARAS.format("text") + ", lambda p: CASE WHEN " + _N.format("p") + " > 200 THEN list_transform(" + _SENTS.format("p")
    + ", lambda s: {'t': s, 'n': " + _N.format("s") + ", 'sep': '. '}) ELSE [{'t': p, 'n': " + _N.format("p") + ", 'sep': chr(10)}] END))"
)


@query(
    f"""
WITH u AS (SELECT doc_id, {_UNITS} AS units FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, list_reduce(units, lambda a, u: CASE WHEN a.n + u.n > 200
        THEN {{'done': list_append(a.done, CASE WHEN u.sep = '. ' THEN array_to_string(a.now, '. ') ELSE array_to_string(a.now, chr(10)) END), 'now': [u.t], 'n': u.n}}
        ELSE {{'done': a.done, 'now': list_append(a.now, u.t), 'n': a.n + u.n}} END,
      {{'done': []::VARCHAR[], 'now': []::VARCHAR[], 'n': 0::BIGINT}}) AS x FROM u),
d AS (SELECT doc_id, CASE WHEN len(x.now) > 0 THEN list_append(x.done, list_aggregate(x.now, 'string_agg', ' ')) ELSE x.done END AS p FROM r)
SELECT doc_id, i - 1 AS pos, p[i] AS chunk FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM d)"""
)
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.packed(F.col("text"), 200)).alias("pos", "chunk"))


@query("SELECT DISTINCT chunk_key, context FROM corpus WHERE context IS NOT NULL")
def sentence_annotate_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation of the chunks' original text without the grammar of tables; the table holds the same, made elsewhere."""
    c = table(spark, sf_dir, "corpus").where("context is not null")
    return c.select("chunk_key", annotate.annotate_plain(F.col("origin_context")).alias("context")).distinct()


_MARK = rf"regexp_replace(regexp_replace(q, '{_B}+$', '') || ' ' || chr(3), '([.!?]) \x03$', ' ' || chr(3) || '\1')"
_PROSE = f"array_to_string(list_transform(string_split({{0}}, chr(10)), lambda ln: array_to_string(list_transform({_LINE_SENTS.format('ln').replace('{', '{{').replace('}', '}}')}, lambda q: {_MARK}), ' ')), chr(10))"
_CELLS = rf"list_filter(list_transform(string_split(replace({_TRIM.format('r')}, '\|', chr(4)), '|'), lambda c: replace({_TRIM.format('c')}, chr(4), '\|')), lambda c: c <> '')"
_ROWS = f"array_to_string(list_transform(string_split({_TRIM.format('s[1]')}, chr(10)), lambda r: '| ' || array_to_string(list_transform({_CELLS}, lambda k: replace({_PROSE.format('k')}, chr(10), ' ')), ' | ') || ' |'), chr(10))"


@query(
    rf"""WITH c AS (SELECT DISTINCT chunk_key, translate(origin_context, chr(1) || chr(2) || chr(3) || chr(4), '    ') AS t FROM corpus),
p AS (SELECT chunk_key, string_split(regexp_replace(t, '(?m)((?:^\|.*\|(?:\n|$))+)|(!\[.*?\]\(.*?\))', chr(1) || '\1' || chr(2) || '\2' || chr(1), 'g'), chr(1)) AS p FROM c WHERE t IS NOT NULL),
e AS (SELECT chunk_key, string_split(unnest(p), chr(2)) AS s, unnest(range(1, len(p) + 1)) AS i FROM p),
g AS (SELECT chunk_key, i, CASE WHEN i % 2 = 0 THEN CASE WHEN s[1] <> '' THEN {_ROWS} ELSE s[2] || ' ' || chr(3) END WHEN s[1] <> '' THEN {_PROSE.format('s[1]')} END AS g FROM e),
j AS (SELECT chunk_key, string_split(coalesce(string_agg(g, chr(10) ORDER BY i), ''), chr(3)) AS q FROM g GROUP BY chunk_key)
SELECT chunk_key, array_to_string(list_transform(range(1, len(q) + 1), lambda k: CASE WHEN k = 1 THEN q[k] ELSE '[Sen ' || (k - 1) || ']' || q[k] END), '') AS context FROM j
UNION ALL SELECT chunk_key, NULL FROM c WHERE t IS NULL"""
)
def sentence_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.annotated(table(spark, sf_dir, "corpus"), "chunk_key", "origin_context").distinct()


_SPANS = r"""
WITH c AS (SELECT DISTINCT chunk_key, context FROM corpus WHERE context IS NOT NULL),
m AS (SELECT chunk_key, regexp_extract_all(context, '\[Sen (\d+)\]', 1) AS ids, string_split_regex(context, '\[Sen \d+\]') AS parts FROM c),
e AS (SELECT chunk_key, ids, parts, unnest(range(1, len(ids) + 1)) AS i FROM m)
SELECT chunk_key, ids[i]::BIGINT AS sen_id,
       coalesce(list_aggregate(list_transform(parts[1:i - 1], lambda x: length(x)), 'sum'), 0)::BIGINT
         + coalesce(list_aggregate(list_transform(ids[1:i - 1], lambda x: length(x) + 6), 'sum'), 0)::BIGINT AS start_pos,
       coalesce(list_aggregate(list_transform(parts[1:i], lambda x: length(x)), 'sum'), 0)::BIGINT
         + coalesce(list_aggregate(list_transform(ids[1:i - 1], lambda x: length(x) + 6), 'sum'), 0)::BIGINT AS end_pos
FROM e"""


@query(_SPANS)
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "corpus").where("context is not null").select("chunk_key", "context").distinct()
    return annotate.sentence_spans(c, "chunk_key", "context")


@query("SELECT DISTINCT chunk_key, unnest(regexp_extract_all(context, '[^\\n]*?\\[Sen (\\d+)\\]', 1))::BIGINT AS sen_id FROM corpus WHERE context IS NOT NULL")
def sentence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "corpus").where("context is not null")
    return c.select("chunk_key", F.explode(annotate.marker_ids(F.col("context"))).alias("sen_id")).distinct()


@query(
    r"""
SELECT doc_id, line_no, list_filter(list_transform(string_split_regex(replace(line, '\|', chr(1)), '\|'), lambda c: trim(c)), lambda c: c <> '')[1] AS first_cell,
       len(list_filter(list_transform(string_split_regex(replace(line, '\|', chr(1)), '\|'), lambda c: trim(c)), lambda c: c <> '')) AS cells
FROM (SELECT doc_id, l AS lines, unnest(range(1, len(l) + 1)) AS i, i - 1 AS line_no, l[i] AS line
      FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL))
WHERE line LIKE '|%|'"""
)
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)).alias("line_no", "line"))
    cells = annotate.table_cells(F.col("line"))
    return d.where(F.col("line").like("|%|")).select("doc_id", "line_no", F.get(cells, 0).alias("first_cell"), F.size(cells).alias("cells"))


# ---------------------------------------------------------------- tiers

_RANK = "md5('42:' || doc_id)"
_TIERS = f"""
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_RANK}, doc_id) AS rnd,
             row_number() OVER (PARTITION BY source ORDER BY len({_toks("coalesce(text, '')")}) DESC, doc_id) AS longest FROM documents),
f AS (SELECT doc_id, source, CASE WHEN rnd <= 3 THEN 1 WHEN longest <= 5 THEN 2 WHEN rnd <= 12 THEN 3 ELSE 4 END AS first_tier FROM r)"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "rel_path", text.token_count(F.coalesce("text", F.lit(""))).alias("n_tokens"))
    spec = [tiers.Rule(1, "random", 3), tiers.Rule(2, "length", 5), tiers.Rule(3, "random", 12), tiers.Rule(4, "all")]
    return tiers.first_tiers(d, spec, seed=42)


@query(f"WITH {_TIERS} SELECT source, doc_id, first_tier FROM f")
def tier_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir).select("source", "doc_id", "first_tier")


@query(f"WITH {_TIERS} SELECT tier, source, doc_id FROM f, (SELECT unnest([1, 2, 3, 4]) AS tier) WHERE tier >= first_tier")
def tier_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.members(_manifest(spark, sf_dir), 4)


@query(f"WITH {_TIERS} SELECT tier, source, doc_id FROM f, (SELECT unnest([2, 3, 4]) AS tier) WHERE tier >= first_tier AND first_tier > 1")
def tier_minus_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.minus(_manifest(spark, sf_dir), 4, 1)


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents) SELECT source, doc_id FROM r WHERE k <= 10")
def sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.keyed_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 10, 7)


@query("SELECT doc_id, source FROM documents ORDER BY fetched_at, doc_id LIMIT 100")
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "fetched_at").orderBy("fetched_at", "doc_id").limit(100).select("doc_id", "source")


# ---------------------------------------------------------------- files, indexes, incremental work

_VALID = "coalesce(length(text) >= 200, false)"


@query(f"SELECT source, count(*) FILTER ({_VALID}) AS valid, count(*) FILTER (NOT {_VALID}) AS invalid, round(count(*) FILTER (NOT {_VALID}) / count(*)::DOUBLE, 6) AS exclusion_rate FROM documents GROUP BY source")
def exclusion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.coalesce(F.length("text") >= 200, F.lit(False))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.round(F.count_if(~ok) / F.count("*"), 6).alias("exclusion_rate"))


@query(f"SELECT doc_id, CASE WHEN {_VALID} THEN '[' || coalesce(title, '') || '](' || rel_path || ')' ELSE rel_path END AS line, {_VALID} AS valid FROM documents")
def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.coalesce(F.length("text") >= 200, F.lit(False))
    line = F.when(ok, F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("]("), F.col("rel_path"), F.lit(")"))).otherwise(F.col("rel_path"))
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("line"), ok.alias("valid"))


@query("SELECT DISTINCT q.question_id FROM proposed_questions q WHERE NOT EXISTS (SELECT 1 FROM preference_pairs p WHERE p.question_id = q.question_id)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "proposed_questions").select("question_id").distinct()
    return files.remaining(q, table(spark, sf_dir, "preference_pairs"), ["question_id"])


@query(
    r"""
WITH p AS (SELECT DISTINCT string_split(file_path, '/') AS s FROM corpus),
n AS (SELECT DISTINCT list_aggregate(s[1:i], 'string_agg', '/') AS path, i AS depth, s[i] AS name, i = len(s) AS is_file FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM p))
SELECT path, depth, repeat('    ', depth - 1) || name AS line, is_file FROM n"""
)
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.tree(table(spark, sf_dir, "corpus"), "file_path")


@query(
    r"""
WITH f AS (SELECT file_path, sum(length(origin_context))::BIGINT AS chars, count(*) AS chunks FROM (SELECT DISTINCT chunk_key, file_path, origin_context FROM corpus) GROUP BY file_path),
n AS (SELECT list_aggregate(s[1:i], 'string_agg', '/') AS path, i AS depth, chars, chunks FROM (SELECT string_split(file_path, '/') AS s, chars, chunks, unnest(range(1, len(s) + 1)) AS i FROM f))
SELECT path, depth, count(*) AS files, sum(chunks)::BIGINT AS chunks, sum(chars)::BIGINT AS chars FROM n GROUP BY path, depth"""
)
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "corpus").select("chunk_key", "file_path", "origin_context").distinct()
    f = c.groupBy("file_path").agg(F.sum(F.length("origin_context")).cast("bigint").alias("chars"), F.count("*").alias("chunks"))
    return files.rollup(f, "file_path")


_FACT_IDS = r"""
WITH f AS (SELECT DISTINCT question_id, objective_facts FROM proposed_questions),
t AS (SELECT question_id, unnest(regexp_extract_all(objective_facts, '\d+(?:\s*-\s*\d+)?')) AS tok FROM f),
b AS (SELECT question_id, regexp_extract(tok, '^(\d+)', 1)::BIGINT AS x, coalesce(nullif(regexp_extract(tok, '-\s*(\d+)$', 1), '')::BIGINT, regexp_extract(tok, '^(\d+)', 1)::BIGINT) AS y FROM t),
e AS (SELECT DISTINCT question_id, unnest(generate_series(least(x, y), greatest(x, y))) AS fact FROM b)"""


@query(f"{_FACT_IDS} SELECT question_id, fact FROM e")
def range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "proposed_questions").select("question_id", "objective_facts").distinct()
    return q.select("question_id", F.explode(ranges.expand(F.col("objective_facts"))).alias("fact"))


def _compressed(run: int, sep: str) -> str:
    return f"""{_FACT_IDS},
g AS (SELECT question_id, fact, fact - row_number() OVER (PARTITION BY question_id ORDER BY fact) AS island FROM e),
r AS (SELECT question_id, min(fact) AS a, max(fact) AS z FROM g GROUP BY question_id, island)
SELECT question_id, string_agg(CASE WHEN z - a + 1 >= {run} THEN a || '-' || z ELSE array_to_string(generate_series(a, z), '{sep}') END, '{sep}' ORDER BY a) AS ids FROM r GROUP BY question_id"""


@query(_compressed(2, ","))
def range_compress_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "proposed_questions").select("question_id", "objective_facts").distinct()
    return q.select("question_id", ranges.compress_facts(ranges.expand(F.col("objective_facts"))).alias("ids")).where("ids <> ''")


@query(_compressed(3, ", "))
def range_compress_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "proposed_questions").select("question_id", "objective_facts").distinct()
    return q.select("question_id", ranges.compress_citations(ranges.expand(F.col("objective_facts"))).alias("ids")).where("ids <> ''")


@query(f"{_FACT_IDS}, n AS (SELECT question_id, sum(y - x + 1)::BIGINT AS clues FROM b GROUP BY question_id) SELECT question_id, clues FROM n WHERE clues > 1")
def multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "proposed_questions").select("question_id", "objective_facts").distinct()
    return q.select("question_id", ranges.expanded_count(F.col("objective_facts")).alias("clues")).where("clues > 1")
