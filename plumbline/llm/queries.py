"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, jaccard, language, line_dedup, metric_join, mixing, negatives, packing, token_counts, token_files, tool_calls, trie, warc
from .registry import QUERIES, SQL, query, table, vocabulary  # noqa: F401


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"list_filter(string_split_regex({LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def shingle_sql(name: str, key: str, source: str, width: int) -> str:
    """Distinct shingles (key, s) of every text with words."""
    return f"""
    {name}_w as (select {key}, {WORDS} as w from {source}),
    {name} as (select distinct {key}, unnest(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) as s
      from {name}_w where len(w) > 0)"""


#: Smallest id reachable over the pairs ``links`` (a, b), both directions, with every id reaching itself.
REACH = """
    reach as (select id as a, id as b from ids union select r.a, l.b from reach r join links l on r.b = l.a)"""

OP3_SQL = f"""
with recursive ids as (select doc_id as id from documents), {shingle_sql("sh", "doc_id", "documents", 3)},
    size as (select doc_id, count(*) as n from sh group by 1),
    common as (select x.doc_id as a, y.doc_id as b, count(*) as c from sh x join sh y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
    links as (select a, b from common join size p on p.doc_id = a join size q on q.doc_id = b where 100 * c >= 90 * (p.n + q.n - c)), {REACH}
select i.id as doc_id, coalesce(n, 0)::bigint as n_shingles, (select min(b) from reach where a = i.id) as component_id
from ids i left join size on size.doc_id = i.id
"""

OP4_SQL = f"""
with recursive ids as (select vec_id as id from embeddings),
    v as (select vec_id, embedding::double[] as e from embeddings),
    links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.95), {REACH}
select id as vec_id, (select count(*) from links where a = id)::bigint as n_links, (select min(b) from reach where a = id) as component_id,
    id = (select min(b) from reach where a = id) as kept
from ids
"""

OP5_SQL = f"""
with {shingle_sql("d", "doc_id", "documents", 5)}, {shingle_sql("q", "item_id", "benchmark", 5)},
    size as (select item_id, count(*) as n from q group by 1)
select doc_id, item_id, n::bigint as n_shingles, count(*)::bigint as n_found, count(*)::double / n as containment
from d join q using (s) join size using (item_id) group by doc_id, item_id, n having count(*) >= 0.8 * n - 1e-9
"""


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    train_on = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    scored = mixing.score_texts(table(spark, sf_dir, "documents"), train_on, group=F.col("lang"))
    return scored.withColumn("held_out", ~F.col("train")).drop("train")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "kept", end_id=0)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query("op3_ngram_jaccard_join", OP3_SQL)
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), width=3, similarity=(90, 100))


@query("op4_embedding_near_dedup", OP4_SQL)
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query("op5_decontamination", OP5_SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Schemas of the three tools that assistant turns are read as.
TOOLS = [
    ("search", "query", "string", True), ("search", "limit", "integer", True), ("search", "after", "string", False),
    ("fetch", "query", "string", True), ("fetch", "limit", "string", True), ("fetch", "after", "string", False), ("fetch", "url", "string", True),
    ("store", "query", "string", True),
]

OP6_SQL = """
with recursive calls as (
  select conv_id, turn, 'c' || conv_id || '-' || turn as call_id, (['search', 'fetch', 'store'])[turn % 3 + 1] as name, text,
    case when turn >= 2 then 'c' || conv_id || '-' || ((turn - 1) // 2) end as dep
  from conversations where role = 'assistant'),
results as (
  select conv_id, turn, 'c' || conv_id || '-' || (turn - 1) as call_id, text as content,
    row_number() over (partition by conv_id, turn order by text) as k
  from conversations where role = 'user'),
lv as (
  select conv_id, call_id, 0 as level from calls where dep is null
  union all
  select c.conv_id, c.call_id, l.level + 1 from calls c join lv l on c.conv_id = l.conv_id and c.dep = l.call_id),
ordered as (
  select l.conv_id, l.call_id, l.level, row_number() over (partition by l.conv_id order by l.level, c.turn, l.call_id) as position
  from lv l join calls c on c.conv_id = l.conv_id and c.call_id = l.call_id)
select c.conv_id, 'call' as kind, c.turn, c.call_id,
  case when c.dep is not null and d.call_id is null then 'missing_reference' when o.level is null then 'unresolved'
    when r.call_id is null then 'no_result' else 'linked' end as status,
  o.level::int as level, o.position::bigint as position,
  case c.name when 'search' then '' when 'fetch' then 'missing:url,type:limit'
    else case when c.dep is null then 'unexpected:limit' else 'unexpected:after,unexpected:limit' end end as errors,
  '{"arguments":{' || case when c.dep is null then '' else '"after":"$ref:' || c.dep || '",' end || '"limit":' || length(c.text) || ',"query":' || to_json(c.text)::varchar
    || '},"id":"' || c.call_id || '","name":"' || c.name || '","result":' || coalesce(to_json(r.content)::varchar, 'null') || '}' as message
from calls c left join calls d on d.conv_id = c.conv_id and d.call_id = c.dep
left join ordered o on o.conv_id = c.conv_id and o.call_id = c.call_id
left join results r on r.conv_id = c.conv_id and r.call_id = c.call_id and r.k = 1
union all
select r.conv_id, 'result', r.turn, r.call_id, case when c.call_id is null then 'orphan' when r.k > 1 then 'duplicate_result' else 'linked' end,
  null, case when r.k = 1 then o.position::bigint end, null, null
from results r left join calls c on c.conv_id = r.conv_id and c.call_id = r.call_id
left join ordered o on o.conv_id = r.conv_id and o.call_id = r.call_id
"""


@query("op6_tool_calls", OP6_SQL)
def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns read as tool calls, user turns as the result of the turn before."""
    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("c"), "conv_id", F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    earlier = F.when(turn >= 2, F.concat(F.lit("$ref:"), name(F.floor((turn - 1) / 2))))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), F.length("text").alias("limit"), earlier.alias("after")))
    tool = F.when(turn % 3 == 0, "search").when(turn % 3 == 1, "fetch").otherwise("store")
    calls = turns.where("role = 'assistant'").select("conv_id", "turn", name(turn).alias("call_id"), tool.alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'user'").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame(TOOLS, "name string, field string, type string, required boolean")
    return tool_calls.link_tool_calls(calls, results, schemas)


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), "dropped", end_id=2)
    back = token_files.read_token_files(manifest)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    return language.predict_language(docs.withColumn("held_out", held), ~held, keep=("held_out",))


OP9_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, sha256(body) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first_id from d)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from f
"""


@query("op9_warc_chunks", OP9_SQL)
def op9_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.record_types(table(spark, sf_dir, "pages"))
    chunks = warc.read_chunks(warc.write_archives(records))
    return chunks.where("last").select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


OP11_SQL = """
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from t),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, min(doc_id) as first_id from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
m as (select k.doc_id, line, pos, f.first_id is not null and k.doc_id <> f.first_id as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""


@query("op11_line_dedup", OP11_SQL)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come as two batches that together are the whole table, so the second meets the filters of the first."""
    docs = table(spark, sf_dir, "documents")
    second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    index = line_dedup.insert(line_dedup.new_index(docs.where(~second)), docs.where(second))
    return line_dedup.kept_texts(index, docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
  from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.other_id as positive_id, row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id)::int as rank,
  n.other_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id) <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.prepare(table(spark, sf_dir, "embeddings"), label)
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


#: Unsigned CRC-32 of the decimal digits of conv_id, bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP13_SQL = f"""
with numbered as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as k
  from conversations where conv_id is not null),
whole as (select conv_id, list({{'role': role, 'text': text}} order by k) as turns, {CRC_SQL} % 4 as h from numbered group by conv_id),
rebuilt as (
  select w.conv_id, list_concat(coalesce(b.turns, [])[1:w.h], w.turns[w.h + 1:]) as turns
  from whole w left join whole b on b.conv_id = w.conv_id - w.conv_id % 20),
paths as (select conv_id, turns, unnest(range(len(turns) + 1)) as depth from rebuilt),
named as (select conv_id, depth, turns[:depth] as prefix, depth = len(turns) as ends from paths),
nodes as (
  select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from named group by prefix, depth),
valued as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes c where c.depth = n.depth + 1 and c.prefix[:n.depth] = n.prefix) as n_children,
    case when n.depth = 0 then 0 else (n.n_convs - 1) * len(list_filter(string_split_regex(n.prefix[n.depth].text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) end as saved
  from nodes n left join nodes p on p.depth = n.depth - 1 and p.prefix = n.prefix[:n.depth - 1]),
up as (select unnest(range(depth + 1)) as d, prefix, n_children, saved from valued),
totals as (select d, prefix[:d] as prefix, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens from up group by 1, 2)
select conv_id, depth::bigint as depth, parent_conv_id, n_convs, n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256
from valued join totals on d = depth and totals.prefix = valued.prefix
"""


@query("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("node")
