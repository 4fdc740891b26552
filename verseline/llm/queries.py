"""The registered queries of the corpus operators, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseline.llm import collocations, decontaminate, katz, multi_index, packing, secrets, simhash, structure, suffix_dedup, tokenbin, toolcalls, topk, toxicity
from verseline.llm.common import held_out, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op6_toxicity(spark, sf_dir):
    """Toxicity score of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


@query()
def op8_secrets(spark, sf_dir):
    """Secret spans of every document."""
    return secrets.scan(table(spark, sf_dir, "documents")).drop("span_list")


@query()
def op2_token_ids(spark, sf_dir):
    """Ids of every document, written as packed segments into the shared folder and read back."""
    import public_tokenizers

    folder = shared_folder(spark)
    tokenbin.save(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=1)
    return tokenbin.read(spark, folder)


@query("""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score from s qualify rank <= 5
""")
def op10_top_k(spark, sf_dir):
    """The five best inner products of every vector whose id is divisible by 50, over all vectors."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query()
def op4_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    rows = simhash.near_components(simhash.fingerprints(table(spark, sf_dir, "documents"), shingle=3), tau=2)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op3_decontamination(spark, sf_dir):
    """Every document that holds at least 0.8 of a benchmark item's five-word shingles."""
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)


@query()
def op5_packing(spark, sf_dir):
    """Every document's pieces in sequences of 512 to 8,192 words."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op1_suffix_dedup(spark, sf_dir):
    """Bytes of every document inside strings of 200 bytes that occur again."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("starts", "ends")


@query()
def op9_katz(spark, sf_dir):
    """log10 probability of every document under a Katz backoff model of the documents outside the held-out fold."""
    return katz.score(table(spark, sf_dir, "documents"))


#: Schema of the one tool that ``op7_tool_calls`` sees in plain conversations.
ANSWER = {"type": "object", "required": ["question", "turn"], "properties": {"question": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False}


def conversation_events(messages):
    """Events of plain conversations: a user's message is a call of ``answer`` that depends on the one two turns before, the assistant's next
    message is its result; all other messages stay messages. Texts that hold tool calls themselves keep those."""
    events = toolcalls.extract(messages)
    at = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    plain = F.col("part") == "message"
    user, reply = plain & (F.col("name") == "user"), plain & (F.col("name") == "assistant")
    before = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    earlier = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 2).cast("string"))
    return events.select(
        "conv_id", "turn",
        F.when(user, F.lit("call")).when(reply, F.lit("result")).otherwise(F.col("part")).alias("part"),
        F.when(user, at).when(reply, before).otherwise(F.col("call_id")).alias("call_id"),
        F.when(user, F.lit("answer")).otherwise(F.col("name")).alias("name"),
        F.when(user, F.to_json(F.struct(F.col("content").alias("question"), "turn"))).otherwise(F.col("arguments")).alias("arguments"),
        F.when(user, F.lit(None).cast("string")).otherwise(F.col("content")).alias("content"),
        F.when(user, F.array(earlier)).otherwise(F.col("depends_on")).alias("depends_on"),
        "seq",
    )


@query()
def op7_tool_calls(spark, sf_dir):
    """Linked, ordered, validated and serialised events of every conversation."""
    return toolcalls.link(conversation_events(table(spark, sf_dir, "conversations")), {"answer": ANSWER})


@query("""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, string_split_regex(piece, '[ \\t]+') as ws
  from (select lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)
), words as (
  select lang, list_filter(ws, lambda w: w <> '') as ws from pieces
), grams as (
  select lang, k as size, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
  from words, (select unnest([1, 2, 3, 4]) as k) where len(ws) >= k
), counts as (
  select lang, size, phrase, count(*) as n from grams group by all
), totals as (
  select lang, sum(n)::bigint as total from counts where size = 1 group by lang
), cand as (
  select lang, size, phrase, n as a, string_split(phrase, ' ') as w from counts where size > 1 and n >= 30
), cuts as (
  select lang, phrase, size, a, k, array_to_string(w[1:k], ' ') as lp, array_to_string(w[k + 1:size], ' ') as rp
  from (select *, unnest(range(1, size)) as k from cand)
), scored as (
  select c.lang, c.phrase, c.a, c.k, l.n as l, r.n as r, ((2000000::hugeint * c.a) // (l.n + r.n))::bigint as score
  from cuts c join counts l on l.lang = c.lang and l.phrase = c.lp join counts r on r.lang = c.lang and r.phrase = c.rp
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inside as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as outer_a
  from (select lang, a, w, size, m, unnest(range(1, size - m + 2)) as i from (select *, unnest(range(2, size)) as m from cand where size > 2)) group by all
), ranked as (
  select b.lang, b.phrase, b.a, b.l, b.r, b.score, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank
  from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase
  where i.outer_a is null or 100::hugeint * i.outer_a < 80::hugeint * b.a
)
select lang, rank::bigint as rank, phrase, a, l, r, total as n, score from ranked join totals using (lang) where rank <= 2000
""")
def op12_collocations(spark, sf_dir):
    """The 2,000 best phrases of two to four words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=4, threshold=30, keep=2000)


@query()
def op13_structure_repair(spark, sf_dir):
    """Every conversation after the contract's damage: its faults, and the cheapest edits that repair its turns."""
    conversations = table(spark, sf_dir, "conversations")
    return structure.digests(structure.repair(structure.damaged(conversations)), conversations)


@query()
def op11_nearest(spark, sf_dir):
    """About the five nearest vectors of every vector whose id is divisible by 50, by cosine."""
    vectors = multi_index.vectors_of(table(spark, sf_dir, "embeddings"))
    return multi_index.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)
