"""The registered queries of these operators, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.llm import embeddings, lexical, mixing, packing, pieces, pitman_yor, preferences, quality, secrets, token_files, topk, turn_trie, vectors
from slotledger.llm.minhash import MinHashParams, near_duplicates
from slotledger.llm.shared import new_path, ship, written


PIECE_MODEL, WORD_MODEL = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    """Where the box keeps a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where(vectors.finite("embedding"))
    whole = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("long"))
    rows = rows.select(F.col("vec_id").alias("id"), whole.alias("vector"))
    return topk.top_k(rows.where("id % 20 = 0"), rows)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), MinHashParams(shingle=2))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path(PIECE_MODEL)
    decoded = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents"), model), model)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_MODEL), path)
    rows = token_files.read_tokens(spark, path)
    found = token_files.with_starts(rows, token_files.checksums(rows))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and the rejected one of pair k."""
    turns = _table(spark, sf_dir, "conversations").select(
        F.expr("conv_id div 2").alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), "turn", "role", "text"
    )
    pairs = preferences.preference_pairs(turns)

    def as_text(mask: str):
        return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")

    return pairs.withColumns({m: as_text(m) for m in ("chosen_mask", "rejected_mask")})


def op6_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    model = pitman_yor.train(documents, remainder != 0)
    return pitman_yor.score(documents, model).select(
        "doc_id", (remainder == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op7_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = secrets.scan(documents, secrets.train(documents))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(secrets.KINDS[:3]))
    return found.select(
        "doc_id", *map(count, secrets.KINDS[:3]),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op8_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = quality.train(documents, _table(spark, sf_dir, "labels"), remainder != 2)
    return quality.score(documents, model).select("doc_id", (remainder == 2).alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_MODEL))


def op10_quantised_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c with the first crc32(c) % 4 turns of conversation c - c % 20 in place of its own."""
    turns = written(turn_trie.sequences(_table(spark, sf_dir, "conversations")), "turn-sequences")
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return turn_trie.prefix_trie(turn_trie.with_heads(turns, heads, 3, F.expr("conv_id - conv_id % 20")))


def op12_automaton_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", taken)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_segment_top_k": op1_segment_top_k,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_files": op4_token_files,
    "op5_preference_chat": op5_preference_chat,
    "op6_pitman_yor_scores": op6_pitman_yor_scores,
    "op7_secret_formats": op7_secret_formats,
    "op8_additive_quality": op8_additive_quality,
    "op9_packing": op9_packing,
    "op10_quantised_cosine": op10_quantised_cosine,
    "op11_turn_trie": op11_turn_trie,
    "op12_automaton_search": op12_automaton_search,
    "op13_systematic_mix": op13_systematic_mix,
}

#: Merges, files, models and packing are not SQL. Links and searches are, as comparisons of all pairs, which the samples allow.
ORACLE_SQL: dict[str, str] = {
    "op1_segment_top_k": """
with v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as w
  from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len(embedding) > 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum([q.w[i] * c.w[i] for i in range(1, len(q.w) + 1)]) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.w) = len(c.w)
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 20""",
    "op2_minhash_near_dedup": r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) end as s
  from w
), each as (
  select doc_id, len(s) as n, unnest(s) as g from s
), shared as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as common
  from each a join each b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
), link as (
  select a, b from shared where 100 * common >= 80 * (n + m - common)
), least as (
  with recursive reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a)
  select a as doc_id, min(b) as b from reach group by a
)
select s.doc_id, cast(len(s) as bigint) as n_shingles, least(s.doc_id, coalesce(least.b, s.doc_id)) as component_id,
  s.doc_id <= coalesce(least.b, s.doc_id) as kept
from s left join least on least.doc_id = s.doc_id""",
    "op10_quantised_cosine": """
with v as (
  select vec_id, [cast(x as double) for x in embedding] as e from embeddings
), u as (
  select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v
  where e is not null and len(e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0 and list_dot_product(e, e) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), linked as (
  select a as vec_id, count(*) as n from link group by a
), least as (
  with recursive reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a)
  select a as vec_id, min(b) as b from reach group by a
)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(b, vec_id)) as component_id, vec_id <= coalesce(b, vec_id) as kept
from embeddings left join linked using (vec_id) left join least using (vec_id)""",
    "op5_preference_chat": r"""
with t as (
  select conv_id // 2 as pair_id, conv_id % 2 as side, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null
), same as (
  select a.pair_id, a.i from t a join t b on a.pair_id = b.pair_id and a.side = 0 and b.side = 1
    and a.i = b.i and a.role = b.role and a.text = b.text
), common as (
  select pair_id, count(*) as n from (
    select pair_id, i, row_number() over (partition by pair_id order by i) as k from same
  ) where i = k group by pair_id
), r as (
  select t.*, coalesce(n, 0) as n, '<|im_start|>' || role || chr(10) as head,
    '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as whole
  from t left join common using (pair_id)
), placed as (
  select *, coalesce(sum(length(whole)) filter (where i > n)
    over (partition by pair_id, side order by i rows between unbounded preceding and 1 preceding), 0) as shift
  from r
)
select pair_id, max(n) as prompt_turns,
  coalesce(string_agg(whole, '' order by i) filter (where side = 0 and i <= n), '') as prompt,
  case when count(*) filter (where side = 0) > 0
    then coalesce(string_agg(whole, '' order by i) filter (where side = 0 and i > n), '') end as chosen,
  case when count(*) filter (where side = 0) > 0 then coalesce(string_agg(
    cast(shift + length(head) as bigint) || ':' || cast(shift + length(whole) as bigint), ',' order by i)
    filter (where side = 0 and i > n and role = 'assistant'), '') end as chosen_mask,
  case when count(*) filter (where side = 1) > 0
    then coalesce(string_agg(whole, '' order by i) filter (where side = 1 and i > n), '') end as rejected,
  case when count(*) filter (where side = 1) > 0 then coalesce(string_agg(
    cast(shift + length(head) as bigint) || ':' || cast(shift + length(whole) as bigint), ',' order by i)
    filter (where side = 1 and i > n and role = 'assistant'), '') end as rejected_mask
from placed group by pair_id""",
    "op11_turn_trie": r"""
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null
), ids as (
  select distinct conv_id, cast(conv_id as varchar) as t from own
), h as (
  select conv_id, xor(4294967295, list_reduce(
    list_prepend(cast(4294967295 as bigint), flatten(list_transform(range(1, length(t) + 1),
      lambda k: [cast(ascii(substr(t, k, 1)) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: case when b >= 0 then xor(c, b) when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end)) % 4 as h
  from ids
), built as (
  select h.conv_id, o.role, o.text, o.i from h join own o on o.conv_id = h.conv_id - h.conv_id % 20 and o.i <= h.h
  union all
  select h.conv_id, o.role, o.text, o.i + 1000000 from h join own o on o.conv_id = h.conv_id and o.i > h.h
), placed as (
  select conv_id, row_number() over (partition by conv_id order by i) as d,
    md5(length(role) || ':' || role || text) as f,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
  from built
), path as (
  select conv_id, d, words, string_agg(f, '') over (partition by conv_id order by d) as p from placed
  union all select conv_id, 0, 0, '' from ids
), size as (
  select conv_id, max(d) as n from path group by conv_id
), node as (
  select p, any_value(d) as d, any_value(words) as words, min(conv_id) as least, count(*) as n,
    string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where d = n_own) as ends
  from (select path.*, size.n as n_own from path join size using (conv_id)) group by p
), child as (
  select substr(p, 1, length(p) - 32) as p, count(*) as children from node where p <> '' group by 1
), flat as (
  select node.*, coalesce(children, 0) as children, coalesce(ends, '') as e from node left join child using (p)
), below as (
  select u.p, sum(case when v.children = 0 then 1 else 0 end) as leaves, sum((v.n - 1) * v.words) as saved
  from flat v join path u on u.conv_id = v.least and u.d <= v.d group by u.p
)
select f.least as conv_id, f.d as depth, up.least as parent_conv_id, f.n as n_convs, f.children as n_children,
  cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(f.e) as ends_sha256
from flat f join below using (p) left join node up on f.p <> '' and up.p = substr(f.p, 1, length(f.p) - 32)""",
    "op12_automaton_search": r"""
with d as (
  select row_number() over () as row, doc_id, [translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    for t in regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')] as terms
  from documents
), whole as (
  select count(*) filter (where len(terms) > 0) as n, cast(sum(len(terms)) as bigint) as l from d
), tf as (
  select row, any_value(doc_id) as doc_id, any_value(size) as size, term, count(*) as tf
  from (select row, doc_id, len(terms) as size, unnest(terms) as term from d) group by row, term
), q as (
  select item_id, term, count(*) as repeats from (
    select item_id, unnest([translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      for t in regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')]) as term
    from benchmark where item_id is not null
  ) group by item_id, term
), w as (
  select term, cast(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) as bigint) as weight
  from (select term, count(*) as df from tf group by term), whole
), s as (
  select item_id, row, any_value(doc_id) as doc_id,
    cast(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // l)))) as bigint) as score
  from q join tf using (term) join w using (term), whole group by item_id, row
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as int) as rank, doc_id, score
from s where score > 0 qualify rank <= 10""",
    "op13_systematic_mix": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as key
  from documents
), s as (
  select source, cast(sum(size) as bigint) as z, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w
  from d group by source
), stops as (
  select a.source, any_value(a.z) as z, any_value(a.w) as w,
    sum(least(3 * b.z * a.w, 3 * a.z * b.w)) <= sum(b.z) * any_value(a.w) as stops
  from s a join s b on true group by a.source
), rest as (
  select sum(z) - coalesce(sum(3 * z) filter (where stops), 0) as words, greatest(coalesce(sum(w) filter (where not stops), 0), 1) as weights
  from stops
), t as (
  select source, z, case when stops then cast(3 * z as double) else cast(w as double) * cast(words as double) / cast(weights as double) end as target,
    cast('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 3) as int) / 4096e0 as u
  from stops, rest
), r as (
  select d.*, z, target, u, case when z > 0 then target / z else 0 end as rate,
    row_number() over (partition by d.source order by size desc, key, doc_id) as i
  from d join t on d.source is not distinct from t.source
)
select doc_id, source, size, z as source_size, target,
  cast(floor(i * rate + u) - floor((i - 1) * rate + u) as bigint) * size as taken
from r""",
}
