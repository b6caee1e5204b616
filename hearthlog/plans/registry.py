"""Registered queries of the search and recall operators over the driver's tables, with DuckDB SQL for each.

Conversations, lines of documents and events stand for session logs (see ``sources.adapters``); search
queries are made from the benchmark items' words, hashes are those that documents hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthlog.functions.text import parse_time
from hearthlog.operators import clean, index_store, ingest, mentions, search, summarise, windows
from hearthlog.plans import recall as plans
from hearthlog.sources import adapters, logs, ranges
from hearthlog.sources.store import Store
from hearthlog.sources.written import fresh_path, materialise
from hearthlog.streaming import grown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# DuckDB definitions that the oracles share
_PROVIDER = "['codex', 'claude', 'gemini'][({}) % 3 + 1]"
_TURNS = f"turns AS (SELECT {_PROVIDER.format('conv_id')} AS provider, conv_id::VARCHAR AS file, (turn + 1)::BIGINT AS msg_index, role, conv_id * 1000 + turn AS sec, text FROM conversations)"
_LINES = f"lines AS (SELECT {_PROVIDER.format('doc_id')} AS provider, doc_id::VARCHAR AS file, unnest(range(1, len(t) + 1))::BIGINT AS msg_index, unnest(list_transform(range(len(t)), lambda i: CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END)) AS role, unnest(t) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))"
_EVENTS = f"evs AS (SELECT {_PROVIDER.format('user_id')} AS provider, user_id::VARCHAR AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS msg_index, event_type AS role, ts, coalesce(props, '') AS text FROM events)"
_ONE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_TOK = r"list_filter(regexp_split_to_array(lower(strip_accents({})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_STRIP = r"regexp_replace({}, '^[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{2028}}\x{{2029}}]+|[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{2028}}\x{{2029}}]+$', '', 'g')"
#: The queries of a batch by the item's number modulo six, as words w1 to w4 of the item.
_KINDS = ("{0} {1}", "{0} OR {1}", "{0} NOT {2}", "{0} NOT {1} {2}", "{0} NOT {2} AND {1}", '"{0} {1}" OR {2} {3}')
_RAW_QUERIES = "rq AS (SELECT item_id AS query_id, CASE item_id % 6 " + " ".join(f"WHEN {i} THEN '" + k.format(*(f"' || w[{j}] || '" for j in range(1, 5))) + "'" for i, k in enumerate(_KINDS)) + r""" END AS query
 FROM (SELECT item_id, regexp_extract_all(text, '[^ \n]+') AS w FROM benchmark))"""
_QUERIES = rf"""{_RAW_QUERIES},
qp AS (SELECT query_id, unnest(p) AS p, unnest(range(len(p))) AS ix FROM (SELECT query_id, regexp_extract_all(query, '("[^"]*"|[^ "]+)') AS p FROM rq)),
qc AS (SELECT *, sum((p = 'OR')::INT) OVER w AS alt, arg_max(p, ix) FILTER (p IN ('AND', 'OR', 'NOT')) OVER w AS op FROM qp WINDOW w AS (PARTITION BY query_id ORDER BY ix)),
qa AS (SELECT query_id, alt, ix AS atom_id, terms, lower(p) NOT IN ('and', 'or', 'not') AS is_prefix, coalesce(op = 'NOT', false) AS negated FROM (SELECT *, {_TOK.format('p')} AS terms FROM qc WHERE p NOT IN ('AND', 'OR', 'NOT')) WHERE len(terms) > 0),
qn AS (SELECT query_id, alt, coalesce(list(atom_id ORDER BY atom_id) FILTER (negated), [NULL]) AS nots FROM qa GROUP BY ALL),
ql AS (SELECT query_id, alt, bar, row_number() OVER (PARTITION BY query_id ORDER BY alt, bar) - 1 AS clause_id FROM (SELECT query_id, alt, unnest(nots) AS bar FROM qn)),
atoms AS (SELECT query_id, clause_id::INT AS clause_id, atom_id, terms, is_prefix, negated FROM qa JOIN ql USING (query_id, alt) WHERE NOT negated OR atom_id = bar)"""
_INDEX = rf"""{_TURNS}, toks AS (SELECT provider, file, msg_index, role, sec, text, {_TOK.format('text')} AS tk FROM turns),
post AS (SELECT provider, file, msg_index, unnest(tk) AS term, unnest(range(len(tk))) AS pos FROM toks)"""
_MATCH = rf"""{_INDEX}, {_QUERIES},
parts AS (SELECT query_id, atom_id, is_prefix, len(terms) AS n, unnest(terms) AS part, unnest(range(len(terms))) AS ord FROM (SELECT DISTINCT query_id, atom_id, is_prefix, terms FROM atoms)),
dict AS (SELECT DISTINCT term FROM post),
exp AS (SELECT query_id, atom_id, n, ord, term FROM parts JOIN dict ON term = part OR (is_prefix AND ord = n - 1 AND starts_with(term, part))),
m AS (SELECT query_id, atom_id, provider, file, msg_index, count(*)::BIGINT AS tf FROM (SELECT query_id, atom_id, n, provider, file, msg_index, pos - ord AS start FROM exp JOIN post USING (term) GROUP BY ALL HAVING count(DISTINCT ord) = n) GROUP BY ALL),
need AS (SELECT query_id, clause_id, count(*) AS needed FROM atoms WHERE NOT negated GROUP BY ALL),
ok AS (SELECT DISTINCT query_id, provider, file, msg_index FROM (
  SELECT query_id, clause_id, provider, file, msg_index, count(*) FILTER (NOT negated) AS held, count(*) FILTER (negated) AS barred FROM m JOIN atoms USING (query_id, atom_id) GROUP BY ALL) JOIN need USING (query_id, clause_id) WHERE held = needed AND barred = 0)"""
_BM25 = f"""{_MATCH}, tot AS (SELECT count(*) AS n_docs, sum(len(tk)) AS total FROM toks),
pos AS (SELECT m.* FROM m JOIN (SELECT DISTINCT query_id, atom_id FROM atoms WHERE NOT negated) USING (query_id, atom_id)),
df AS (SELECT query_id, atom_id, greatest(ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)), 0) AS raw, total / n_docs AS mean FROM pos, tot GROUP BY query_id, atom_id, n_docs, total),
scored AS (SELECT query_id, provider, file, msg_index, sum(CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tk) / mean))) AS score
  FROM pos JOIN ok USING (query_id, provider, file, msg_index) JOIN toks USING (provider, file, msg_index) JOIN df USING (query_id, atom_id) GROUP BY ALL)"""


def _ranked(k: int, by: str = "query_id", source: str = "scored") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, file, msg_index) AS rank FROM {source} QUALIFY rank <= {k})"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def raw_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.regexp_extract_all("text", F.lit(r"[^ \n]+"), 0)
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", w.alias("w"))
    marked = [k.format(*(f"%{j}$s" for j in range(1, 5))) for k in _KINDS]
    text = F.format_string
    kinds = F.array(*[text(k, *(F.get("w", F.lit(i)) for i in range(4))) for k in marked])
    return b.select(F.col("item_id").alias("query_id"), F.get(kinds, (F.col("item_id") % len(_KINDS)).cast("int")).alias("query"))


def _setup(spark: SparkSession, sf_dir: str, turns: Callable[[SparkSession, str], DataFrame] = adapters.conversation_turns) -> tuple[search.Index, DataFrame]:
    return search.written_index(turns(spark, sf_dir)), search.normalise_queries(raw_queries(spark, sf_dir))


def _score() -> Column:
    return F.round("score", 4).alias("score")


# --- inventory and ingest


@query(f"WITH {_TURNS}, f AS (SELECT provider, file AS path, max(sec) AS mtime, sum(length(text))::BIGINT AS size FROM turns GROUP BY ALL) SELECT provider, path, size FROM f QUALIFY row_number() OVER (PARTITION BY provider ORDER BY mtime DESC, path) <= 5")
def latest_sessions(spark, sf_dir):
    return logs.latest_sessions(adapters.conversation_files(spark, sf_dir), 5).select("provider", "path", "size")


@query(f"WITH {_EVENTS}, l AS (SELECT provider, file, max(ts) AS ts FROM evs GROUP BY ALL) SELECT provider, epoch_us(ts)::BIGINT AS last_us FROM l ORDER BY ts DESC, provider LIMIT 1")
def latest_active_provider(spark, sf_dir):
    turns = adapters.event_turns(spark, sf_dir)
    files = turns.groupBy(F.col("file").alias("path"), "provider").agg(F.max("ts").alias("mtime"))
    return logs.latest_active_provider(turns, files).select("provider", F.unix_micros("last_active").alias("last_us"))


@query("""WITH f AS (SELECT doc_id::VARCHAR AS path, doc_id % 5 AS m, n_chars::BIGINT AS size FROM documents)
SELECT path, CASE m WHEN 0 THEN 'new' WHEN 1 THEN 'grown' WHEN 2 THEN 'rewritten' WHEN 3 THEN 'same' ELSE 'vanished' END AS change FROM f""")
def file_changes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 5).alias("m"), F.col("n_chars").cast("long").alias("size"))
    now = d.where("m <> 4").select("path", F.timestamp_seconds(F.lit(2000)).alias("mtime"), "size")
    old = F.when(F.col("m") == 1, F.col("size") - 1).when(F.col("m") == 2, F.col("size") + 1).otherwise(F.col("size"))
    state = d.where("m <> 0").select(F.col("path").alias("file"), F.timestamp_seconds(F.when(F.col("m") == 3, 2000).otherwise(1000)).alias("mtime"), old.alias("size"), F.lit(1).alias("msg_index"))
    return ingest.file_changes(now, state)


@query(f"WITH {_TURNS} SELECT provider, file, max(msg_index) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM turns GROUP BY ALL")
def incremental_ingest(spark, sf_dir):
    """Half of the conversations are known, some in an older state; after the run all stand as in the source."""
    turns, files = adapters.conversation_turns(spark, sf_dir), adapters.conversation_files(spark, sf_dir)
    half = F.col("path").cast("long") % 2 == 0
    state = files.where(half).select(F.col("path").alias("file"), F.when(F.col("path").cast("long") % 4 == 0, F.col("mtime")).otherwise(F.timestamp_seconds(F.lit(0))).alias("mtime"), "size", F.lit(0).cast("long").alias("msg_index"))
    old = turns.where(F.col("file").cast("long") % 2 == 0).withColumn("text", F.when(F.col("file").cast("long") % 4 == 0, F.col("text")).otherwise("old"))
    after, _ = ingest.incremental_ingest(files, state, old, lambda changed: turns.join(changed.select(F.col("path").alias("file")), "file", "left_semi"))
    return after.groupBy("provider", "file").agg(F.max("msg_index").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


# --- cleaning and rendering


@query(rf"""WITH l AS (SELECT {_PROVIDER.format('doc_id')} AS provider, doc_id::VARCHAR AS file, text FROM documents),
c AS (SELECT provider, file, trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x)), chr(10)), '^\n+|\n+$', '', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM l)
SELECT provider, file, 1::BIGINT AS msg_index, text FROM c WHERE text <> ''""")
def clean_turns(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    turns = d.select(adapters.provider_of(F.col("doc_id")).alias("provider"), F.col("doc_id").cast("string").alias("file"), F.lit(1).cast("long").alias("msg_index"), F.lit("user").alias("role"), "text")
    return clean.clean_turns(turns).select("provider", "file", "msg_index", "text")


@query(rf"""WITH {_LINES}, k AS (SELECT *, role || '|' || {_ONE.format('text')} AS key FROM (SELECT * REPLACE ('user' AS role) FROM lines))
SELECT provider, file, msg_index FROM k QUALIFY coalesce(lag(key) OVER (PARTITION BY provider, file ORDER BY msg_index) <> key, true)""")
def collapse_repeats(spark, sf_dir):
    turns = adapters.document_line_turns(spark, sf_dir).withColumn("role", F.lit("user"))
    return clean.collapse_repeats(turns).select("provider", "file", "msg_index")


@query(f"WITH {_LINES} SELECT provider, file, msg_index, text FROM lines WHERE contains(lower(text), 'licensed under')")
def contains_filter(spark, sf_dir):
    return clean.contains_filter(adapters.document_line_turns(spark, sf_dir), "Licensed Under").select("provider", "file", "msg_index", "text")


_SPLIT = r"regexp_split_to_array({}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
_COMMANDS = f"""commands AS (SELECT {_PROVIDER.format('doc_id')} AS provider, doc_id::VARCHAR AS file, n AS msg_index, CASE n WHEN 1 THEN 'user' ELSE 'assistant' END AS role,
  CASE n WHEN 1 THEN 'intro' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '$ ' WHEN 1 THEN ' Command: ' ELSE 'cmd:' END || text WHEN 2 THEN '```sh' || chr(10) || text || chr(10) || '```' || chr(10) || '> ' || text ELSE '$ ' || replace(text, chr(10), chr(10) || '> ') END AS text
  FROM documents, (SELECT unnest([1, 2, 3])::BIGINT AS n) WHERE text IS NOT NULL)"""
_RESULT = f"list_filter(list_transform({_SPLIT.format('text')}, lambda x: {_STRIP.format('x')}), lambda x: x[1:2] IN ('$ ', '> ') OR starts_with(lower(x), 'command:') OR starts_with(lower(x), 'cmd:'))[1]"
_INLINE = rf"""found AS (SELECT provider, file, msg_index, list_concat(
  list_transform(list_filter(flatten(list_transform(regexp_extract_all(text, '(?s)```(?:bash|sh|zsh|shell)?\n(.*?)```', 1), lambda f: list_transform({_SPLIT.format('f')}, lambda x: {_STRIP.format('x')}))), lambda x: x <> ''), lambda x: CASE WHEN x[1:2] IN ('$ ', '> ') THEN {_STRIP.format('x[3:]')} ELSE x END),
  list_transform(list_filter(list_transform({_SPLIT.format('text')}, lambda x: {_STRIP.format('x')}), lambda x: x[1:2] IN ('$ ', '> ')), lambda x: {_STRIP.format('x[3:]')})) AS cs FROM SOURCE),
each AS (SELECT provider, file, msg_index, unnest(cs) AS command, unnest(range(len(cs))) AS ix FROM found),
inl AS (SELECT provider, file, msg_index, command, row_number() OVER (PARTITION BY provider, file, msg_index ORDER BY ix) AS ordinal FROM (SELECT provider, file, msg_index, command, min(ix) AS ix FROM each WHERE command <> '' GROUP BY ALL))"""


@query(f"WITH {_COMMANDS}, c AS (SELECT provider, file, msg_index, {_RESULT} AS t FROM commands) SELECT provider, file, msg_index, {_STRIP.format("CASE WHEN t[1:2] IN ('$ ', '> ') THEN t[3:] ELSE regexp_replace(t, '^[^:]*:', '') END")} AS command FROM c WHERE t IS NOT NULL")
def result_commands(spark, sf_dir):
    return clean.extract_result_commands(adapters.command_turns(spark, sf_dir))


@query(f"WITH {_COMMANDS}, {_INLINE.replace('SOURCE', 'commands')} SELECT provider, file, msg_index, ordinal::INT AS ordinal, command FROM inl")
def inline_commands(spark, sf_dir):
    return clean.extract_inline_commands(adapters.command_turns(spark, sf_dir))


_RENDER = "CASE WHEN role = 'assistant' THEN provider ELSE role END || ':' || chr(10) || {} || chr(10)"
_CUT = "CASE WHEN length(text) > 100 THEN text[1:100] || '…' ELSE text END"


@query(f"WITH {_TURNS} SELECT provider, file, string_agg({_RENDER.format(_CUT)}, chr(10) ORDER BY msg_index) AS text FROM turns GROUP BY ALL")
def render_transcript(spark, sf_dir):
    return clean.render_transcript(adapters.conversation_turns(spark, sf_dir), 100)


_TIDY = r"regexp_replace(array_to_string(list_transform({}, lambda x: regexp_replace(x, '[\s\x1f\x{{a0}}]+$', '')), chr(10)), '^\n+|\n+$', '', 'g')"


@query(rf"""WITH {_COMMANDS}, tidy AS (SELECT provider, file, msg_index, role, {_TIDY.format(_SPLIT.format('text'))} AS full_text FROM commands),
shown AS (SELECT provider, file, row_number() OVER (PARTITION BY provider, file ORDER BY msg_index) AS msg_index, role, full_text, CASE WHEN length(full_text) > 300 THEN full_text[1:300] || '…' ELSE full_text END AS text FROM tidy WHERE full_text <> ''),
c AS (SELECT *, role || '|' || {_ONE.format('text')} AS key FROM shown WHERE contains(lower(full_text), 'th')),
u AS (SELECT * FROM c QUALIFY coalesce(lag(key) OVER (PARTITION BY provider, file ORDER BY msg_index) <> key, true)), {_INLINE.replace('SOURCE', 'shown')},
o AS (SELECT provider, file, msg_index, 0 AS place, {_RENDER.format('text')} AS t FROM u UNION ALL SELECT provider, file, msg_index, ordinal, 'cmd: ' || {_ONE.format('command')} FROM inl WHERE contains(lower(command), 'th'))
SELECT provider, file, string_agg(t, chr(10) ORDER BY msg_index, place) AS text FROM o GROUP BY ALL""")
def clean_report(spark, sf_dir):
    return plans.clean_report(adapters.command_turns(spark, sf_dir), "TH", 300, include_inline=True)


# --- index and search


@query(f"WITH {_INDEX} SELECT term, provider, file, msg_index, count(*)::INT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM post GROUP BY ALL")
def index_postings(spark, sf_dir):
    p = search.build_index(adapters.conversation_turns(spark, sf_dir)).postings
    return p.select("term", "provider", "file", "msg_index", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


_COLUMNS = ("text", "role", "file", "ts")
_WIDE = "cols AS (" + " UNION ALL ".join(f"SELECT provider, file, msg_index, '{c}' AS col, {_TOK.format(x)} AS tk FROM turns" for c, x in zip(_COLUMNS, ("text", "role", "file", "strftime(make_timestamp(sec * 1000000), '%Y-%m-%d %H:%M:%S')"), strict=True)) + ")"


@query(f"WITH {_TURNS}, {_WIDE}, each AS (SELECT provider, file, msg_index, col, unnest(tk) AS term, unnest(range(len(tk))) AS pos FROM cols) SELECT term, provider, file, msg_index, col, count(*)::INT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM each GROUP BY ALL")
def index_postings_columns(spark, sf_dir):
    """The index over text, role, file and time."""
    p = search.build_index(adapters.conversation_turns(spark, sf_dir), _COLUMNS).postings
    return p.select("term", "provider", "file", "msg_index", "col", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"WITH {_BM25.replace(_TURNS, _TURNS + ', ' + _WIDE).replace('toks AS (SELECT provider, file, msg_index, role, sec, text, ' + _TOK.format('text') + ' AS tk FROM turns)', 'toks AS (SELECT provider, file, msg_index, flatten(list(tk)) AS tk FROM cols GROUP BY ALL)').replace('post AS (SELECT provider, file, msg_index, unnest(tk) AS term, unnest(range(len(tk))) AS pos FROM toks)', 'post AS (SELECT provider, file, msg_index, col, unnest(tk) AS term, unnest(range(len(tk))) AS pos FROM cols)').replace('provider, file, msg_index, pos - ord AS start', 'provider, file, msg_index, col, pos - ord AS start')} SELECT query_id, rank::INT AS rank, provider, file, msg_index, round(score, 4) AS score FROM {_ranked(10)}")
def bm25_topk_columns(spark, sf_dir):
    """Search over text, role, file and time, as logs are searched by default."""
    index = search.written_index(adapters.conversation_turns(spark, sf_dir), _COLUMNS)
    hits = search.bm25_topk(index, search.normalise_queries(raw_queries(spark, sf_dir)), 10)
    return hits.select("query_id", "rank", "provider", "file", "msg_index", _score())


@query(f"WITH {_BM25} SELECT query_id, rank::INT AS rank, provider, file, msg_index, round(score, 4) AS score FROM {_ranked(10)}")
def index_generations(spark, sf_dir):
    """An index of older turns, then two generations that replace files: search is that of a full index."""
    turns = adapters.conversation_turns(spark, sf_dir)
    number, store = F.col("file").cast("long") % 5, index_store.IndexStore(spark, fresh_path(spark, "index"))
    store.update(turns.where("msg_index <= 2").unionByName(turns.where(number == 2).withColumns({"file": F.concat(F.lit("gone"), "file")})))
    store.update(turns.where(number < 3), turns.where(number < 3).select("file").unionByName(turns.where(number == 2).select(F.concat(F.lit("gone"), "file").alias("file"))))
    store.update(turns.where(number >= 3))
    hits = search.bm25_topk(store.read(), search.normalise_queries(raw_queries(spark, sf_dir)), 10)
    return hits.select("query_id", "rank", "provider", "file", "msg_index", _score())


@query(f"WITH {_INDEX} SELECT provider, file, msg_index, len(tk)::INT AS n_tokens FROM toks")
def index_turn_stats(spark, sf_dir):
    return search.build_index(adapters.conversation_turns(spark, sf_dir)).turn_stats


@query(rf"""WITH q AS (SELECT doc_id, regexp_extract_all(text, '("[^"]*"|[^\s"]+|")') AS p FROM documents)
SELECT doc_id AS query_id, array_to_string(list_filter(list_transform(p, lambda x: CASE WHEN length(x) >= 2 AND starts_with(x, '"') AND ends_with(x, '"') THEN CASE WHEN trim(x[2:-2]) <> '' THEN '"' || trim(x[2:-2]) || '"*' ELSE '' END
 WHEN upper(x) IN ('AND', 'OR', 'NOT') THEN x WHEN regexp_matches(x, '[*()]') THEN x WHEN regexp_matches(x, '^[A-Za-z0-9_]+$') THEN x || '*' WHEN NOT regexp_matches(x, '[\p{{L}}\p{{N}}]') THEN '' ELSE '"' || replace(x, '"', '""') || '"*' END), lambda x: x <> ''), ' ') AS cooked FROM q""")
def cook_queries(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("query_id"), search.cook_query(F.col("text")).alias("cooked"))


@query(f"WITH {_QUERIES} SELECT query_id, clause_id, atom_id::INT AS atom_id, array_to_string(terms, ' ') AS terms, is_prefix, negated FROM atoms")
def normalise_queries(spark, sf_dir):
    return search.normalise_queries(raw_queries(spark, sf_dir)).withColumn("terms", F.array_join("terms", " "))


@query(f"WITH {_MATCH} SELECT query_id, provider, file, msg_index FROM ok")
def match_boolean(spark, sf_dir):
    return search.match_boolean(*search.matched(*_setup(spark, sf_dir)))


@query(f"WITH {_INDEX}, {_QUERIES}, dict AS (SELECT term, count(DISTINCT (file, msg_index))::BIGINT AS n FROM post GROUP BY term), each AS (SELECT query_id, atom_id, unnest(terms) AS t, unnest(range(len(terms))) AS i FROM atoms) SELECT DISTINCT query_id, (atom_id * 100 + i)::INT AS atom_id, term, n FROM each JOIN dict ON starts_with(term, t)")
def prefix_terms(spark, sf_dir):
    """All words of all atoms as prefixes."""
    index, q = _setup(spark, sf_dir)
    words = q.select("query_id", "atom_id", F.posexplode("terms").alias("i", "prefix"))
    return search.prefix_terms(index.dictionary(), words.select("query_id", (F.col("atom_id") * 100 + F.col("i")).alias("atom_id"), "prefix").distinct())


_PHRASES = rf"""{_INDEX}, ph AS (SELECT query_id, i AS atom_id, t[i + 1] AS a, t[i + 2] AS b FROM (SELECT item_id AS query_id, {_TOK.format('text')} AS t, unnest(range(len(t) - 1)) AS i FROM benchmark))"""


@query(f"WITH {_PHRASES} SELECT query_id, atom_id::INT AS atom_id, p.provider, p.file, p.msg_index, count(*)::BIGINT AS tf FROM ph JOIN post p ON p.term = a JOIN post n ON n.provider = p.provider AND n.file = p.file AND n.msg_index = p.msg_index AND n.pos = p.pos + 1 AND starts_with(n.term, b) GROUP BY ALL")
def match_phrase(spark, sf_dir):
    """All pairs of neighbouring words of all benchmark items, as phrases with a prefix at the end."""
    index = search.written_index(adapters.conversation_turns(spark, sf_dir))
    t = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), search.tokens(F.col("text")).alias("t"))
    pairs = F.transform(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), lambda a, i: F.array(a, F.get("t", i + 1)))
    q = t.select("query_id", F.lit(0).alias("clause_id"), F.posexplode(pairs).alias("atom_id", "terms")).withColumns({"is_prefix": F.lit(True), "negated": F.lit(False)})
    return search.match_phrase(index, q).select("query_id", "atom_id", "provider", "file", "msg_index", "tf")


@query(f"WITH {_BM25} SELECT query_id, rank::INT AS rank, provider, file, msg_index, round(score, 4) AS score FROM {_ranked(10)}")
def bm25_topk(spark, sf_dir):
    index, q = _setup(spark, sf_dir)
    return search.bm25_topk(index, q, 10).select("query_id", "rank", "provider", "file", "msg_index", _score())


@query(f"WITH {_BM25} SELECT query_id, rank::INT AS rank, provider, file, msg_index, round(score, 4) AS score FROM {_ranked(5, 'query_id, provider')}")
def search_per_provider(spark, sf_dir):
    index, q = _setup(spark, sf_dir)
    return search.search_per_provider(index, q, 5).select("query_id", "rank", "provider", "file", "msg_index", _score())


@query(f"WITH {_BM25}, s AS (SELECT scored.* FROM scored JOIN turns USING (provider, file, msg_index) WHERE role = 'user' AND provider IN ('codex', 'gemini') AND file::INT % 2 = 0) SELECT query_id, rank::INT AS rank, provider, file, msg_index, round(score, 4) AS score FROM {_ranked(10, source='s')}")
def filter_hits(spark, sf_dir):
    index, q = _setup(spark, sf_dir)
    files = index.turns.select("file").where(F.col("file").cast("int") % 2 == 0)
    return search.bm25_topk(index, q, 10, role="user", providers=("codex", "gemini"), files=files).select("query_id", "rank", "provider", "file", "msg_index", _score())


_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}\p{{Co}}]+')"


@query(rf"""WITH {_BM25}, h AS (SELECT r.query_id, r.rank, r.provider, r.file, r.msg_index, tk, {_WORDS.format('text')} AS wd, regexp_split_to_array(text, '[\p{{L}}\p{{N}}\p{{Co}}]+') AS bt FROM {_ranked(3)} r JOIN toks USING (provider, file, msg_index)),
w AS (SELECT DISTINCT query_id, atom_id, terms, len(terms) AS n, is_prefix AS pre FROM atoms WHERE NOT negated),
st AS (SELECT query_id, rank, atom_id, n, unnest(list_filter(range(1, len(tk) - n + 2), lambda i: list_aggregate(list_transform(range(1, n + 1), lambda o: CASE WHEN pre AND o = n THEN starts_with(tk[i + o - 1], terms[o]) ELSE tk[i + o - 1] = terms[o] END), 'bool_and'))) AS pl FROM h JOIN w USING (query_id)),
hd AS (SELECT query_id, rank, x.pl, count(DISTINCT y.atom_id) AS k FROM (SELECT DISTINCT query_id, rank, pl FROM st) x JOIN st y USING (query_id, rank) WHERE y.pl >= x.pl AND y.pl + y.n <= x.pl + 12 GROUP BY ALL),
b AS (SELECT query_id, rank, arg_max(pl, k * 1000000 - pl) AS f FROM (SELECT query_id, rank, pl, k FROM hd UNION ALL SELECT query_id, rank, pl, 0 FROM st) GROUP BY ALL),
j AS (SELECT h.*, f, least(f + 11, len(tk)) AS l, unnest(range(f, least(f + 11, len(tk)) + 1)) AS i FROM h JOIN b USING (query_id, rank)),
mk AS (SELECT j.*, (SELECT count(*) FROM st WHERE st.query_id = j.query_id AND st.rank = j.rank AND pl <= i AND i < pl + n) > 0 AS here,
  (SELECT count(*) FROM st WHERE st.query_id = j.query_id AND st.rank = j.rank AND pl <= i AND i + 1 < pl + n) > 0 AS on_, (SELECT count(*) FROM st WHERE st.query_id = j.query_id AND st.rank = j.rank AND pl <= i - 1 AND i < pl + n) > 0 AS off FROM j)
SELECT query_id, rank::INT AS rank, provider, file, msg_index, CASE WHEN f > 1 THEN '…' ELSE '' END || string_agg(CASE WHEN here AND (i = f OR NOT off) THEN '[' ELSE '' END || wd[i] || CASE WHEN here AND (i = l OR NOT on_) THEN ']' ELSE '' END || CASE WHEN i < l THEN bt[i + 1] ELSE '' END, '' ORDER BY i) || CASE WHEN l < len(tk) THEN '…' ELSE '' END AS snip
FROM mk GROUP BY query_id, rank, provider, file, msg_index, f, l, tk""")
def snippets(spark, sf_dir):
    index, q = _setup(spark, sf_dir)
    return search.snippets(search.bm25_topk(index, q, 3), index, q, 12).select("query_id", "rank", "provider", "file", "msg_index", "snip")


@query(rf"""WITH {_BM25}, h AS (SELECT r.*, role, sec, text FROM {_ranked(20)} r JOIN turns USING (provider, file, msg_index)),
u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, provider, role, lower({_ONE.format('text')}) ORDER BY rank, file, msg_index) = 1)
SELECT query_id, rank::INT AS rank, provider, file, msg_index, role, sec FROM u""")
def dedupe_hits(spark, sf_dir):
    index, q = _setup(spark, sf_dir)
    hits = search.dedupe_hits(search.with_turns(search.bm25_topk(index, q, 20), index.turns))
    return search.order_hits(hits, "time-desc").select("query_id", "rank", "provider", "file", "msg_index", "role", F.unix_seconds("ts").alias("sec"))


@query(f"WITH {_EVENTS} SELECT file, msg_index, role, epoch_us(ts)::BIGINT AS us FROM evs WHERE role = 'purchase' AND provider IN ('codex', 'gemini') AND file::INT % 2 = 0 ORDER BY ts DESC, file DESC, msg_index DESC LIMIT 50")
def tail_turns(spark, sf_dir):
    turns = adapters.event_turns(spark, sf_dir)
    return search.tail_turns(turns, 50, "purchase", ("codex", "gemini"), turns.where(F.col("file").cast("int") % 2 == 0)).select("file", "msg_index", "role", F.unix_micros("ts").alias("us"))


@query(f"WITH {_EVENTS} SELECT provider, file, msg_index, epoch_us(ts)::BIGINT AS us FROM evs WHERE provider <> 'claude' QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ts DESC, file DESC, msg_index DESC) <= 20")
def tail_turns_per_provider(spark, sf_dir):
    return search.tail_turns_per_provider(adapters.event_turns(spark, sf_dir), 20, providers=("codex", "gemini")).select("provider", "file", "msg_index", F.unix_micros("ts").alias("us"))


@query(rf"WITH {_TURNS} SELECT provider, file, msg_index, role, {_ONE.format('text')} AS text FROM turns WHERE file::INT % 3 = 0 AND role = 'assistant'")
def catch_up(spark, sf_dir):
    turns = adapters.conversation_turns(spark, sf_dir)
    return search.catch_up(turns, turns.select("file").where(F.col("file").cast("int") % 3 == 0), "assistant").select("provider", "file", "msg_index", "role", "text")


# --- windows


_SPANS = """sp AS (SELECT query_id, provider, file, greatest(1, msg_index - 2) AS s, msg_index + 2 AS e FROM h),
isl AS (SELECT *, sum(new) OVER (PARTITION BY query_id, provider, file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, (coalesce(s > max(e) OVER (PARTITION BY query_id, provider, file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true))::INT AS new FROM sp)),
spans AS (SELECT query_id, provider, file, min(s)::BIGINT AS start, max(e)::BIGINT AS "end" FROM isl GROUP BY query_id, provider, file, g)"""
_HITS = f"{_BM25}, h AS {_ranked(10, 'query_id, provider')}, {_SPANS}"


@query(f'WITH {_HITS} SELECT query_id, provider, file, start, "end" FROM spans')
def window_spans(spark, sf_dir):
    index, q = _setup(spark, sf_dir)
    return windows.window_spans(search.search_per_provider(index, q, 10), 2)


@query(f'WITH {_HITS} SELECT query_id, provider, file, start, msg_index, role, text FROM spans JOIN turns USING (provider, file) WHERE msg_index BETWEEN start AND "end"')
def recall_windows(spark, sf_dir):
    index, q = _setup(spark, sf_dir)
    return plans.recall(index, q, k=10, window=2).turns


@query(f"WITH {_HITS} SELECT query_id, provider, file, count(*)::BIGINT AS n_hits, min(rank)::INT AS first_rank, sum(count(*)) OVER (PARTITION BY query_id)::BIGINT AS n_total, '' AS project FROM h GROUP BY query_id, provider, file")
def conversation_hits(spark, sf_dir):
    index, q = _setup(spark, sf_dir)
    return plans.recall(index, q, k=10).conversations


@query(f"WITH {_HITS} SELECT query_id, rank::INT AS rank, concat_ws(' ', provider, file, msg_index::VARCHAR, role, replace(text[1:200], chr(10), ' ')) AS line FROM h JOIN turns USING (provider, file, msg_index)")
def compact_hits(spark, sf_dir):
    index, q = _setup(spark, sf_dir)
    return windows.compact_hits(search.with_turns(search.search_per_provider(index, q, 10), index.turns), "text")


@query(rf"""WITH {_HITS}, w AS (SELECT query_id, provider, file, string_agg({_RENDER.format('text')}, chr(10) ORDER BY msg_index) AS body FROM spans JOIN turns USING (provider, file) WHERE msg_index BETWEEN start AND "end" GROUP BY ALL),
f AS (SELECT provider, file, max(sec) AS mtime FROM turns GROUP BY ALL)
SELECT query_id, provider, file, '[Session: ' || strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M') || ' | ' || provider || ' | ' || file || ']' || chr(10) || rtrim(body, ' ' || chr(10)) AS text FROM w JOIN f USING (provider, file)""")
def conversation_digests(spark, sf_dir):
    index, q = _setup(spark, sf_dir)
    spans = windows.window_spans(search.search_per_provider(index, q, 10), 2)
    return summarise.conversation_digests(index.turns, spans, adapters.conversation_files(spark, sf_dir))


@query(rf"""WITH {_HITS}, w AS (SELECT query_id, provider, file, string_agg({_RENDER.format('text')}, chr(10) ORDER BY msg_index) AS body FROM spans JOIN turns USING (provider, file) WHERE msg_index BETWEEN start AND "end" GROUP BY ALL),
f AS (SELECT provider, file, max(sec) AS mtime FROM turns GROUP BY ALL)
SELECT query_id, string_agg('[Session: ' || strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M') || ' | ' || provider || ' | ' || file || ']' || chr(10) || rtrim(body, ' ' || chr(10)), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY provider, file) AS text FROM w JOIN f USING (provider, file) GROUP BY query_id""")
def joined_digests(spark, sf_dir):
    return summarise.joined_digests(conversation_digests(spark, sf_dir))


# --- mentions


_HASHES = r"list_distinct(regexp_extract_all(text, '\b[0-9a-f]{7,40}\b'))"
_CONTEXT = r"regexp_matches(text, '(?i)\b(commit|pushed|merge|sha|hash)\b')"
_MENTIONS = rf"{_LINES}, men AS (SELECT provider, file, msg_index, role, text, regexp_extract_all(text, '\b[0-9a-f]{{7,40}}\b') AS hs FROM lines WHERE regexp_matches(text, '\b[0-9a-f]{{7,40}}\b'))"


@query(rf"WITH d AS (SELECT {_PROVIDER.format('doc_id')} AS provider, doc_id::VARCHAR AS file, regexp_extract_all(text, '\b[0-9a-f]{{7,40}}\b') AS hs, text FROM documents) SELECT provider, file, len(list_distinct(hs))::INT AS n, hs[1] AS first FROM d WHERE len(hs) > 0 AND {_CONTEXT}")
def commit_mentions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    turns = d.select(adapters.provider_of(F.col("doc_id")).alias("provider"), F.col("doc_id").cast("string").alias("file"), F.lit(1).cast("long").alias("msg_index"), F.lit("user").alias("role"), "text")
    return mentions.commit_mentions(turns).select("provider", "file", F.size("hashes").alias("n"), F.get("hashes", F.lit(0)).alias("first"))


@query(f"WITH {_MENTIONS}, top AS (SELECT provider, file, max(msg_index) AS top FROM lines GROUP BY ALL) SELECT provider, file, msg_index, hs[1] AS first FROM men JOIN top USING (provider, file) WHERE msg_index > top - 4")
def scan_commits(spark, sf_dir):
    found = mentions.scan_commits(adapters.document_line_turns(spark, sf_dir), last=4, need_context=False)
    return found.select("provider", "file", "msg_index", F.get("hashes", F.lit(0)).alias("first"))


def _event_pair(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = adapters.event_turns(spark, sf_dir)
    return e.where("role = 'error'").select("provider", "file", "msg_index"), e.where("role = 'purchase'").select("provider", "file", "msg_index")


def _nearest(how: str) -> str:
    near = {"forward": "min(p.msg_index) FILTER (p.msg_index BETWEEN h.msg_index AND h.msg_index + 20)", "backward": "max(p.msg_index) FILTER (p.msg_index BETWEEN h.msg_index - 20 AND h.msg_index)"}[how]
    return f"WITH {_EVENTS} SELECT h.provider, h.file, h.msg_index, {near} AS mention_index FROM evs h LEFT JOIN evs p ON p.provider = h.provider AND p.file = h.file AND p.role = 'purchase' WHERE h.role = 'error' GROUP BY h.provider, h.file, h.msg_index"


@query(_nearest("forward"))
def nearest_mention_forward(spark, sf_dir):
    return mentions.nearest_mention(*_event_pair(spark, sf_dir), "forward", 20)


@query(_nearest("backward"))
def nearest_mention_backward(spark, sf_dir):
    return mentions.nearest_mention(*_event_pair(spark, sf_dir), "backward", 20)


@query(f"""WITH {_EVENTS}, p AS (SELECT provider, file, msg_index AS m FROM evs WHERE role = 'purchase'), h AS (SELECT provider, file, msg_index FROM evs WHERE role = 'error'),
a AS (SELECT h.*, max(m) FILTER (m BETWEEN msg_index - 20 AND msg_index - 1) AS previous_index FROM h LEFT JOIN p USING (provider, file) GROUP BY ALL)
SELECT a.provider, a.file, a.msg_index, previous_index, min(m) FILTER (CASE WHEN previous_index IS NULL THEN m <= 21 ELSE m > previous_index AND m - previous_index - 1 <= 20 END) AS next_index FROM a LEFT JOIN p USING (provider, file) GROUP BY ALL""")
def between_mention(spark, sf_dir):
    return mentions.between_mention(*_event_pair(spark, sf_dir), 20)


@query(f"WITH {_MENTIONS} SELECT provider, file, msg_index, hs[1] AS first, len(list_distinct(hs))::INT AS n FROM men WHERE role = 'user'")
def direct_mention(spark, sf_dir):
    hits = adapters.document_line_turns(spark, sf_dir).where("role = 'user'")
    return mentions.direct_mention(hits).select("provider", "file", "msg_index", F.get("hashes", F.lit(0)).alias("first"), F.size("hashes").alias("n"))


_COMMITS = f"""{_MENTIONS}, each AS (SELECT provider, file, msg_index, unnest(hs) AS hash, unnest(range(len(hs))) AS ix FROM men),
fst AS (SELECT provider, file, hash, min(msg_index * 100000 + ix) AS seen FROM each GROUP BY ALL),
com AS (SELECT DISTINCT CASE WHEN length(hash) % 2 = 0 THEN 'even' ELSE 'odd' END AS repo, rpad(hash, 40, '0') AS sha, 'about ' || hash AS summary FROM each),
res AS (SELECT f.provider, f.file, f.hash, f.seen, c.repo, c.sha, c.summary FROM fst f JOIN (
  SELECT hash, arg_min(repo, repo) AS repo, arg_min(sha, repo) AS sha, arg_min(summary, repo) AS summary FROM (
    SELECT w.hash, com.repo, min(sha) AS sha, min(summary) AS summary FROM (SELECT DISTINCT hash FROM fst) w JOIN com ON starts_with(sha, w.hash) GROUP BY ALL HAVING count(DISTINCT sha) = 1) GROUP BY hash) c USING (hash)),
rnk AS (SELECT provider, file, row_number() OVER (PARTITION BY provider, file ORDER BY min(seen)) AS ordinal, arg_min(hash, seen) AS hash, repo, sha, summary FROM res GROUP BY provider, file, repo, sha, summary QUALIFY ordinal <= 3)"""


def _commit_table(turns: DataFrame) -> DataFrame:
    h = turns.select(F.explode("hashes").alias("hash")).distinct()
    repo = F.when(F.length("hash") % 2 == 0, "even").otherwise("odd")
    return h.select(repo.alias("repo"), F.rpad("hash", 40, "0").alias("sha"), F.lit(True).alias("on_branch"), F.concat(F.lit("about "), F.col("hash")).alias("summary"))


def _resolved(spark, sf_dir) -> DataFrame:
    found = mentions.scan_commits(adapters.document_line_turns(spark, sf_dir), need_context=False)
    return mentions.resolve_commits(found, _commit_table(found))


@query(f"WITH {_COMMITS} SELECT provider, file, ordinal::INT AS ordinal, hash, repo, sha, summary FROM rnk")
def resolve_commits(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query(f"WITH {_COMMITS} SELECT provider, file, 'git:' || chr(10) || string_agg(repo || ' ' || sha || chr(10) || summary, chr(10) ORDER BY ordinal) AS section FROM rnk GROUP BY ALL")
def commit_section(spark, sf_dir):
    return mentions.commit_section(_resolved(spark, sf_dir))


#: Conversations in which every third turn tells of a commit.
_COMMITTED = _TURNS.replace("sec, text FROM", "sec, text || CASE WHEN (turn + 1) % 3 = 0 THEN ' pushed commit ' || left(md5(conv_id::VARCHAR || ':' || (turn + 1)::VARCHAR), 8) ELSE '' END AS text FROM")
_FOUND = rf"""{_BM25.replace(_TURNS, _COMMITTED)}, h AS (SELECT r.*, role, text FROM {_ranked(20)} r JOIN turns USING (provider, file, msg_index)),
u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, provider, role, lower({_ONE.format('text')}) ORDER BY rank, file, msg_index) = 1),
c AS (SELECT provider, file, msg_index AS m FROM turns WHERE regexp_matches(text, '\b[0-9a-f]{{7,40}}\b') AND {_CONTEXT})"""
_KEYS = "query_id, rank::INT AS rank, provider, file, u.msg_index"


def _by_mode(spark: SparkSession, sf_dir: str, mode: str, *columns: str | Column) -> DataFrame:
    index, q = _setup(spark, sf_dir, adapters.committed_turns)
    return plans.search_with_commits(index, q, mode, span=2).select("query_id", "rank", "provider", "file", "msg_index", *columns)


@query(f"WITH {_FOUND} SELECT {_KEYS}, min(m) FILTER (m BETWEEN u.msg_index AND u.msg_index + 2) AS mention_index FROM u LEFT JOIN c USING (provider, file) GROUP BY query_id, rank, provider, file, u.msg_index")
def search_with_commits(spark, sf_dir):
    return _by_mode(spark, sf_dir, "forward", "mention_index")


@query(f"WITH {_FOUND} SELECT {_KEYS}, max(m) FILTER (m BETWEEN u.msg_index - 2 AND u.msg_index) AS mention_index FROM u LEFT JOIN c USING (provider, file) GROUP BY query_id, rank, provider, file, u.msg_index")
def search_with_commits_backward(spark, sf_dir):
    return _by_mode(spark, sf_dir, "backward", "mention_index")


@query(rf"WITH {_FOUND} SELECT {_KEYS}, regexp_extract(text, '\b[0-9a-f]{{7,40}}\b') AS first FROM u WHERE regexp_matches(text, '\b[0-9a-f]{{7,40}}\b')")
def search_with_commits_direct(spark, sf_dir):
    return _by_mode(spark, sf_dir, "direct", F.get("hashes", F.lit(0)).alias("first"))


def _between(span: int) -> str:
    return f"""WITH {_FOUND}, p AS (SELECT query_id, rank, provider, file, u.msg_index, max(m) FILTER (m BETWEEN u.msg_index - {span} AND u.msg_index - 1) AS previous_index FROM u LEFT JOIN c USING (provider, file) GROUP BY ALL)
SELECT query_id, rank::INT AS rank, provider, file, p.msg_index, previous_index, min(m) FILTER (CASE WHEN previous_index IS NULL THEN m <= 1 + {span} ELSE m > previous_index AND m - previous_index - 1 <= {span} END) AS next_index FROM p LEFT JOIN c USING (provider, file) GROUP BY query_id, rank, provider, file, p.msg_index, previous_index"""


@query(_between(2))
def search_with_commits_between(spark, sf_dir):
    return _by_mode(spark, sf_dir, "between", "previous_index", "next_index")


@query(_between(1 << 40))
def search_with_commits_auto(spark, sf_dir):
    return _by_mode(spark, sf_dir, "auto", "previous_index", "next_index")


# --- summaries


@query(f"""WITH {_TURNS}, t AS (SELECT provider, file, length(string_agg({_RENDER.format('text')}, chr(10) ORDER BY msg_index)) AS n FROM turns GROUP BY ALL),
mo AS (SELECT * FROM (VALUES ('gemma3:4b-q4', 128000), ('granite4', 128000), ('other', 32768)) v(model, lim))
SELECT provider, file, model, CASE WHEN n = 0 THEN 0 ELSE greatest(1, n // 4) END::BIGINT AS n_tokens, lim::BIGINT AS context_limit, (4 * greatest(1024, floor(lim * 0.7) - 1024))::BIGINT AS char_budget, ceil(n / (4 * greatest(1024, floor(lim * 0.7) - 1024)))::BIGINT AS n_chunks FROM t, mo""")
def token_budget(spark, sf_dir):
    t = clean.render_transcript(adapters.conversation_turns(spark, sf_dir))
    return summarise.token_budget(t, ["gemma3:4b-q4", "granite4", "other"])


def _chunks_sql(name: str, source: str, most: int) -> str:
    """name AS chunks (provider, file, i, total, text) of source (provider, file, text): a line joins the open chunk or starts
    one; the recursion goes over the lines of all texts at once. c: chunks up to this line, u: what the open one has used."""
    return f"""{name}_l AS (SELECT provider, file, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT provider, file, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT provider, file, {_SPLIT.format('text')} AS ls FROM {source}))),
{name}_n AS (SELECT *, length(line) + 1 AS cost, greatest(1, ceil(length(line) / {most}))::BIGINT AS pieces FROM {name}_l),
{name}_r AS (SELECT provider, file, 0::BIGINT AS i, 0::BIGINT AS c, 0::BIGINT AS u, 0::BIGINT AS start FROM {source}
 UNION ALL SELECT n.provider, n.file, n.i, CASE WHEN cost > {most} THEN r.c + pieces WHEN u > 0 AND u + cost <= {most} THEN r.c ELSE r.c + 1 END, CASE WHEN cost > {most} THEN 0 WHEN u > 0 AND u + cost <= {most} THEN u + cost ELSE cost END, CASE WHEN u > 0 AND u + cost <= {most} AND cost <= {most} THEN r.c ELSE r.c + 1 END
 FROM {name}_r r JOIN {name}_n n ON n.provider = r.provider AND n.file = r.file AND n.i = r.i + 1),
{name}_p AS (SELECT n.provider, n.file, n.i, r.start + k AS chunk, CASE WHEN cost > {most} THEN line[k * {most} + 1 : (k + 1) * {most}] ELSE line END AS part FROM (SELECT *, unnest(range(CASE WHEN cost > {most} THEN pieces ELSE 1 END)) AS k FROM {name}_n) n JOIN {name}_r r ON n.provider = r.provider AND n.file = r.file AND n.i = r.i),
{name} AS (SELECT provider, file, chunk AS i, max(chunk) OVER (PARTITION BY provider, file) AS total, string_agg(part, chr(10) ORDER BY i) AS text FROM {name}_p GROUP BY provider, file, chunk)"""


_RENDERED = f"tr AS (SELECT provider, file, string_agg({_RENDER.format('text')}, chr(10) ORDER BY msg_index) AS text FROM turns GROUP BY ALL)"
#: What the summariser of the queries makes of a prompt: its length, its start and its end.
_SAYS = "(length({0})::VARCHAR || ':' || ({0})[1:40] || '~' || right({0}, 20))"
_TEMPLATE = "[{{chunk_index}}/{{chunk_total}}] {{transcript}} .md"
_PROMPT = "('[' || i::VARCHAR || '/' || total::VARCHAR || '] ' || text || ' .md')"


def _summaries_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT provider, file, string_agg('Chunk ' || i::VARCHAR || '/' || total::VARCHAR || ' summary:' || chr(10) || {_SAYS.format(_PROMPT)}, chr(10) || chr(10) ORDER BY i) AS text FROM {source} GROUP BY ALL)"


def says(prompts):
    return prompts.str.len().astype(str) + ":" + prompts.str[:40] + "~" + prompts.str[-20:]


@query(f"WITH RECURSIVE {_TURNS}, {_RENDERED}, {_chunks_sql('ck', 'tr', 500)} SELECT provider, file, i::INT AS chunk_index, total::INT AS chunk_total, text FROM ck")
def chunk_transcripts(spark, sf_dir):
    return summarise.chunk_transcripts(clean.render_transcript(adapters.conversation_turns(spark, sf_dir)), 500)


@query(f"WITH RECURSIVE {_TURNS}, {_RENDERED}, {_chunks_sql('ck', 'tr', 400)}, {_summaries_sql('sm', 'ck')} SELECT provider, file, text AS summary FROM sm")
def summarise_chrono(spark, sf_dir):
    """Transcripts in chunks of 400 characters, with a summariser that depends on the whole prompt."""
    t = clean.render_transcript(adapters.conversation_turns(spark, sf_dir))
    return summarise.map_reduce_summarise(t, says, 400, template=_TEMPLATE)


def _reduced_sql(most: int) -> str:
    steps, source = [], "tr"
    for k in range(summarise.MAX_PASSES + 1):
        over = f"o{k} AS (SELECT * FROM {source} WHERE length(text) > {most})"
        steps += [over, _chunks_sql(f"c{k}", f"o{k}", most), _summaries_sql(f"s{k}", f"c{k}")]
        source = f"s{k}"
    last = summarise.MAX_PASSES
    done = " UNION ALL ".join(f"SELECT * FROM {t} WHERE length(text) <= {most}" for t in ["tr", *(f"s{k}" for k in range(last))]) + f" UNION ALL SELECT * FROM s{last}"
    whole = "('[/] ' || text || ' .md')"
    return f"WITH RECURSIVE {_TURNS}, {_RENDERED}, {', '.join(steps)}, done AS ({done}) SELECT provider, file, {_SAYS.format(whole)} AS summary FROM done"


@query(_reduced_sql(600))
def summarise_reduce(spark, sf_dir):
    """The same with 600 characters, reduced in passes until the joined summaries fit."""
    t = clean.render_transcript(adapters.conversation_turns(spark, sf_dir))
    return summarise.map_reduce_summarise(t, says, 600, "reduce", _TEMPLATE)


@query(rf"""WITH {_LINES}, f AS (SELECT file FROM (SELECT DISTINCT provider, file FROM lines) QUALIFY row_number() OVER (PARTITION BY provider ORDER BY file::INT DESC) <= 150),
k AS (SELECT provider, file, row_number() OVER (PARTITION BY provider, file ORDER BY msg_index) AS msg_index, role, {_STRIP.format("'pushed ' || text")} AS text FROM lines JOIN f USING (file)),
each AS (SELECT provider, file, msg_index, unnest(hs) AS hash, unnest(range(len(hs))) AS ix FROM (SELECT provider, file, msg_index, regexp_extract_all(text, '\b[0-9a-f]{{7,40}}\b') AS hs FROM k)),
fst AS (SELECT provider, file, hash, min(msg_index * 100000 + ix) AS seen FROM each GROUP BY ALL),
com AS (SELECT DISTINCT CASE WHEN length(hash) % 2 = 0 THEN 'even' ELSE 'odd' END AS repo, rpad(hash, 40, '0') AS sha, 'about ' || hash AS summary FROM (SELECT unnest(regexp_extract_all(text, '\b[0-9a-f]{{7,40}}\b')) AS hash FROM lines)),
res AS (SELECT f.provider, f.file, f.hash, f.seen, c.repo, c.sha, c.summary FROM fst f JOIN (
  SELECT hash, arg_min(repo, repo) AS repo, arg_min(sha, repo) AS sha, arg_min(summary, repo) AS summary FROM (
    SELECT w.hash, com.repo, min(sha) AS sha, min(summary) AS summary FROM (SELECT DISTINCT hash FROM fst) w JOIN com ON starts_with(sha, w.hash) GROUP BY ALL HAVING count(DISTINCT sha) = 1) GROUP BY hash) c USING (hash)),
rnk AS (SELECT provider, file, row_number() OVER (PARTITION BY provider, file ORDER BY min(seen)) AS ordinal, repo, sha, summary FROM res GROUP BY provider, file, repo, sha, summary QUALIFY ordinal <= 3),
sec AS (SELECT provider, file, 'git:' || chr(10) || string_agg(repo || ' ' || sha || chr(10) || summary, chr(10) ORDER BY ordinal) AS section FROM rnk GROUP BY ALL)
SELECT k.provider, k.file, string_agg({_RENDER.replace('provider', 'k.provider').format('text')}, chr(10) ORDER BY msg_index) AS text, any_value(section) AS section FROM k LEFT JOIN sec USING (provider, file) GROUP BY k.provider, k.file""")
def transcript_report(spark, sf_dir):
    """The newest documents as conversations whose lines tell of commits, with the commits that they name."""
    lines = adapters.document_line_turns(spark, sf_dir)
    files = lines.groupBy("provider", F.col("file").alias("path")).agg(F.timestamp_seconds(F.max(F.col("file").cast("long"))).alias("mtime"))
    known = _commit_table(mentions.scan_commits(lines, need_context=False))
    return plans.transcript_report(lines.withColumn("text", F.concat(F.lit("pushed "), "text")), files, known, 150)


# --- log files: conversations written as logs of each provider, and read back


def _log_query(provider: str, raw: bool = False):
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = adapters.write_logs(spark, sf_dir, provider)
        if raw:
            turns = logs.read_raw_turns(spark, path, provider, glob="*.txt")
        else:
            turns = {"codex": logs.read_codex_turns, "claude": logs.read_claude_turns, "gemini": logs.read_gemini_turns}[provider](spark, path, glob="*.txt")
        return turns.select("provider", F.regexp_extract("file", "conv_id=([0-9]+)", 1).alias("file"), "msg_index", "role", F.unix_seconds("ts").alias("sec"), "text")

    read.__name__ = f"read_{'raw_' * raw}{provider}"
    return read


def _logged(provider: str, raw: bool) -> str:
    """Every turn; with a command before or after it (clean flavour) where the turn's number is even."""
    text = _STRIP.format("text")
    command = "" if raw else " UNION ALL SELECT conv_id, turn, " + ("1" if provider == "gemini" else "-1") + " AS place, 'cmd', sec, 'run ' || turn::VARCHAR FROM c WHERE turn % 2 = 0"
    role = "role" if raw and provider != "gemini" else "CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'assistant' ELSE role END"
    kept = "role IN ('user', 'assistant')"
    return f"""WITH c AS (SELECT conv_id, turn, role, conv_id * 1000 + turn AS sec, {text} AS text FROM conversations WHERE {kept}),
r AS (SELECT conv_id, turn, 0 AS place, {role} AS role, sec, text FROM c WHERE text <> ''{command})
SELECT '{provider}' AS provider, conv_id::VARCHAR AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) AS msg_index, role, sec, text FROM r"""


for _p in adapters.PROVIDERS:
    query(_logged(_p, False))(_log_query(_p))
    query(_logged(_p, True))(_log_query(_p, True))


@query(f"""WITH d AS (SELECT doc_id, doc_id // 20 AS file, {_STRIP.format("concat_ws(chr(10), nullif(source, ''), 'shown ' || doc_id, nullif(text, ''), nullif(lang, ''))")} AS text FROM documents)
SELECT 'gemini' AS provider, file::BIGINT::VARCHAR AS file, row_number() OVER (PARTITION BY file ORDER BY doc_id) AS msg_index, ['user', 'assistant', 'info'][doc_id % 3 + 1] AS role, text FROM d""")
def raw_tool_results(spark, sf_dir):
    """Documents as results of tool calls, deep inside them and with keys in no order, read back as turns of any role."""
    path = adapters.write_tool_results(spark, sf_dir)
    turns = logs.read_raw_turns(spark, path, "gemini", glob="*.txt")
    return turns.select("provider", F.regexp_extract("file", "part=([0-9]+)", 1).alias("file"), "msg_index", "role", "text")


def _codex_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written inventory of conversations as codex logs, which runs read several times."""
    found = logs.session_inventory(spark, {"codex": adapters.write_logs(spark, sf_dir, "codex")}, {"codex": "*.txt"})
    return materialise(found.select("path", "mtime", "size"), "inventory")


@query(_logged("codex", True))
def append_ingest(spark, sf_dir):
    """Logs of which the state knows the first half of the lines (even conversations) or nothing: after the run all turns stand as in the logs."""
    files = _codex_inventory(spark, sf_dir)
    number = F.regexp_extract("file", "conv_id=([0-9]+)", 1)
    whole = files.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("offset"), "size")
    lines = ranges.range_lines(ranges.plan_ranges(whole)).where(number.cast("long") % 2 == 0)
    order = Window.partitionBy("file")
    half = lines.withColumn("at", F.row_number().over(order.orderBy("end"))).withColumn("n", F.count("*").over(order)).where(F.col("at") * 2 <= F.col("n"))
    told = F.expr("try_variant_get(try_parse_json(value), '$.payload.type', 'string') <> 'function_call'")
    known = materialise(half.groupBy("file").agg(F.max("end").alias("offset"), F.count_if(told).alias("msg_index")), "known")
    state = known.select("file", F.timestamp_seconds(F.lit(0)).alias("mtime"), F.col("offset").alias("size"), "offset", "msg_index")
    zero = F.lit(0).cast("long")
    all_, _ = logs.resumed_turns(spark, known.select("file", zero.alias("offset"), F.col("offset").alias("size"), zero.alias("msg_index")), "codex")
    old = all_.join(known.select("file", F.col("msg_index").alias("top")), "file").where(F.col("msg_index") <= F.col("top")).drop("top")
    after, _ = ingest.append_ingest(files, state, materialise(old, "old-turns"), lambda todo: logs.resumed_turns(spark, todo, "codex"))
    return after.select("provider", number.alias("file"), "msg_index", "role", F.unix_seconds("ts").alias("sec"), "text")


def _in_two_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The inventory of codex logs when they were half as long (ends of lines apart), and as they are."""
    now = _codex_inventory(spark, sf_dir)
    return now.withColumns({"mtime": F.timestamp_seconds(F.lit(0)), "size": F.floor(F.col("size") / 2)}), now


@query(_logged("codex", True))
def ingest_logs(spark, sf_dir):
    """Logs ingested into a store when they were half as long, and again when they had grown."""
    store = Store(spark, fresh_path(spark, "store"), buckets=8)
    for files in _in_two_steps(spark, sf_dir):
        ingest.ingest_logs(store, files, lambda todo: logs.resumed_turns(spark, todo, "codex", range_bytes=5000))
    return store.read("turns", ingest.TURNS).select("provider", F.regexp_extract("file", "conv_id=([0-9]+)", 1).alias("file"), "msg_index", "role", F.unix_seconds("ts").alias("sec"), "text")


@query(_logged("codex", True))
def stream_grown_logs(spark, sf_dir):
    """The same logs as a stream of what is new in them, in two steps."""
    home, out, checkpoint = (fresh_path(spark, x) for x in ("steps", "streamed", "stream"))
    for files in _in_two_steps(spark, sf_dir):
        grown.discover(spark, files, home, range_bytes=5000)
        grown.stream_grown_logs(spark, home, out, checkpoint, "codex").awaitTermination()
    turns = grown.last_epochs(spark.read.parquet(out)).withColumn("ts", parse_time(F.col("ts_raw")))
    return turns.select("provider", F.regexp_extract("file", "conv_id=([0-9]+)", 1).alias("file"), "msg_index", "role", F.unix_seconds("ts").alias("sec"), "text")


@query("SELECT 'gemini' AS provider, conv_id::VARCHAR AS file, true AS filled FROM (SELECT DISTINCT conv_id FROM conversations WHERE role IN ('user', 'assistant'))")
def session_inventory(spark, sf_dir):
    files = logs.session_inventory(spark, {"gemini": adapters.write_logs(spark, sf_dir, "gemini"), "codex": f"{sf_dir}/none"}, {"gemini": "*.txt", "codex": "*"})
    return files.select("provider", F.regexp_extract("path", "conv_id=([0-9]+)", 1).alias("file"), (F.col("size") > 0).alias("filled"))


@query(f"WITH {_TURNS} SELECT provider, file, msg_index, role, text FROM turns WHERE provider <> 'gemini' OR msg_index <= 2")
def write_turns(spark, sf_dir):
    """All turns written by provider, then one provider's again with fewer turns, and read back."""
    path, turns = fresh_path(spark, "turns"), adapters.conversation_turns(spark, sf_dir)
    logs.write_turns(turns, path)
    logs.write_turns(turns.where("provider = 'gemini' AND msg_index <= 2"), path)
    return spark.read.parquet(path).select("provider", F.col("file").cast("string").alias("file"), "msg_index", "role", "text")
