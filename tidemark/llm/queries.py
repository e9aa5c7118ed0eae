"""The registered queries of this subpackage, one an operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.counts import token_counts
from tidemark.llm.divergence import source_divergence
from tidemark.llm.langid import remainder, with_language
from tidemark.llm.lattice import cosine_links
from tidemark.llm.maxscore import top_k
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pii import with_spans
from tidemark.llm.quality import scored
from tidemark.llm.sharding import shard_bytes
from tidemark.llm.spelling import spelling_variants
from tidemark.llm.tokens import with_digests
from tidemark.llm.warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_links(table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = read_warc(spark, write_warc(pages), payload=False)
    kind = dict(pages.dtypes)["page_id"]
    return records.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(table(spark, sf_dir, "documents"), piece_model())


def op5_maxscore_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    found = with_language(docs.select("doc_id", "text"), docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    return scored(docs, labels, ~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_spans(table(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_bytes(table(spark, sf_dir, "documents"))


def op10_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), word_vocabulary())


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lattice_links, op2_mix_sources, op3_warc, op4_sentencepiece, op5_maxscore_top5, op6_language_codes, op7_pairwise_quality, op8_personal_data, op9_shards,
        op10_minmax_near_duplicates, op11_source_divergence, op12_token_counts, op13_spelling_variants,
    )
}

#: Brute force: all pairs of usable vectors by cosine in double precision; components by following links.
LINKS_SQL = """
    with recursive good as (select vec_id, embedding::double[] as e from embeddings
                            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
         pairs as (select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
                   where list_cosine_similarity(a.e, b.e) >= 0.9),
         reach as (select vec_id, vec_id as c from embeddings union select pairs.b, reach.c from reach join pairs on reach.vec_id = pairs.a),
         least as (select vec_id, min(c) as component_id from reach group by 1),
         degree as (select a as vec_id, count(*) as n from pairs group by 1)
    select l.vec_id, coalesce(d.n, 0)::bigint as n_links, l.component_id, l.vec_id = l.component_id as kept
    from least l left join degree d on l.vec_id = d.vec_id"""

#: The mix with all quotients listed and ranked, as apportionment is defined, and all blocks listed.
MIX_SQL = r"""
    with d as (select doc_id, source, coalesce(doc_id::varchar, md5(coalesce(text, ''))) as key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
         h as (select *, ('0x' || substr(md5(key), 1, 8))::bigint as spot, ('0x' || substr(md5(key), 9, 8))::bigint as turn from d),
         s0 as (select source, sum(size)::bigint as source_size from h group by 1),
         s1 as (select *, row_number() over (order by source is null, source) - 1 as rank from s0),
         s2 as (select *, [5.0::double, 2.0, 1.0][(rank % 3 + 1)::int] as weight, 2.0::double * source_size as cap from s1),
         s3 as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
                          / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level from s2),
         s4 as (select *, (select arg_min(level, (cap / weight, rank)) from s3 where cap >= level * weight) as water from s3),
         s as (select source, rank, source_size, least(cap, coalesce(water * weight, cap)) as target, greatest(1, (source_size + 65535) // 65536) as shards from s4),
         q1 as (select rank, target / (2 * k + 1) as quotient, (select floor(sum(target) / 512) from s) as seats
                from (select *, unnest(range(0, (target / 512)::bigint + 50)) as k from s where target > 0)),
         q2 as (select rank, row_number() over (order by quotient desc, rank) <= seats as won from q1),
         quota as (select rank, count(*) filter (won) as quota from q2 group by 1),
         p as (select h.*, s.rank, h.spot % s.shards as shard from h join s on h.source is not distinct from s.source),
         c as (select rank, shard, sum(size)::bigint as cell_size from p group by 1, 2),
         c1 as (select c.*, s.source_size, s.target, coalesce(quota.quota, 0) as quota, greatest(1, round_even(c.cell_size / 512, 0))::bigint as blocks from c join s on c.rank = s.rank left join quota on c.rank = quota.rank),
         q3 as (select rank, shard, quota, cell_size / (2 * k + 1) as quotient
                from (select *, unnest(range(0, (quota * cell_size / greatest(source_size, 1))::bigint + 50)) as k from c1 where cell_size > 0)),
         q4 as (select rank, shard, row_number() over (partition by rank order by quotient desc, shard) <= quota as won from q3),
         w as (select rank, shard, count(*) filter (won) as won from q4 group by 1, 2),
         c2 as (select c1.*, (least(coalesce(w.won, 0), 2 * blocks) * cell_size) // blocks as rough from c1 left join w on c1.rank = w.rank and c1.shard = w.shard),
         c3 as (select *, floor(target)::bigint - (sum(rough) over (partition by rank))::bigint as gap, count(*) over (partition by rank) as n, row_number() over (partition by rank order by shard) as i from c2),
         c4 as (select *, greatest(0, least(rough + trunc(gap * i / n)::bigint - trunc(gap * (i - 1) / n)::bigint, 2 * cell_size)) as wanted from c3),
         c5 as (select *, wanted // greatest(cell_size, 1) as times, wanted % greatest(cell_size, 1) as rest from c4),
         b0 as (select *, unnest(range(0, blocks)) as j from c5),
         b1 as (select *, (j * cell_size) // blocks as begins, ((j + 1) * cell_size) // blocks - (j * cell_size) // blocks as length, ('0x' || substr(md5('0:' || rank || ':' || shard || ':' || j), 1, 8))::bigint as draw from b0),
         b2 as (select *, greatest(0, least(length, rest - coalesce(sum(length) over (partition by rank, shard order by draw, j rows between unbounded preceding and 1 preceding), 0)))::bigint as more from b1),
         e as (select *, (sum(size) over (partition by rank, shard order by turn, doc_id nulls first, size rows unbounded preceding))::bigint as upto, row_number() over () as r from p),
         m as (select e.r, sum(greatest(0, least(e.upto, b2.begins + b2.more) - greatest(e.upto - e.size, b2.begins)))::bigint as more
               from e join b2 on e.rank = b2.rank and e.shard = b2.shard and b2.begins < e.upto and b2.begins + b2.length > e.upto - e.size group by 1)
    select e.doc_id, e.size, c5.source_size, c5.target, (c5.times * e.size + coalesce(m.more, 0))::bigint as taken
    from e join c5 on e.rank = c5.rank and e.shard = c5.shard left join m on e.r = m.r"""

WARC_SQL = """
    with d as (select page_id, encode(coalesce(html, '')) as body from pages),
         p as (select page_id, octet_length(body)::bigint as payload_bytes, sha256(body) as payload_digest from d),
         f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from p)
    select page_id, payload_bytes, payload_digest, case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
           case when page_id is distinct from first then first end as refers_to from f"""

SEARCH_SQL = """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
               where vec_id is not null and embedding is not null
                 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
         s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
               from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
         r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 5"""

#: Brute force: all pairs of documents that share a shingle.
NEAR_SQL = r"""
    with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
         g as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                                   when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end as s from t),
         e as (select doc_id, len(s) as n, unnest(s) as x from g),
         pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
         links as (select a, b from pairs where 100 * k >= 75 * (na + nb - k)),
         sides as (select a, b from links union all select b, a from links),
         reach as (select doc_id, doc_id as c from g union select sides.b, reach.c from reach join sides on reach.doc_id = sides.a),
         least as (select doc_id, min(c) as component_id from reach group by 1)
    select g.doc_id, len(g.s)::bigint as n_shingles, l.component_id, g.doc_id = l.component_id as kept from g join least l on g.doc_id = l.doc_id"""

#: Divergences from counts of all terms in all groups.
DIVERGENCE_SQL = r"""
    with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
         t as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
         kept as (select lang, term, count(*) as n from t group by 1, 2 having count(distinct r) >= 30),
         langs as (select lang, count(*) as v, sum(n) as total from kept group by 1),
         g0 as (select distinct lang, source from d),
         c as (select g0.lang, g0.source, kept.term, kept.n as n_lang, count(t.r) as n from g0 join kept on g0.lang = kept.lang
               left join t on t.lang = g0.lang and t.source = g0.source and t.term = kept.term group by 1, 2, 3, 4),
         s as (select lang, source, sum(n) as total from c group by 1, 2),
         p as (select c.*, (1 + (1000000000::hugeint * (c.n + 5)) // (s.total + 5 * langs.v))::bigint as p, (1 + (1000000000::hugeint * (c.n_lang + 5)) // (langs.total + 5 * langs.v))::bigint as q
               from c join s on c.lang = s.lang and c.source = s.source join langs on c.lang = langs.lang),
         sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
         pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sums.value, 0)::bigint as value
                   from g0 a join g0 b on a.lang = b.lang and a.source <> b.source left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source),
         own as (select lang, source, 'term' as part, term as item, p - q as value from p where n > 0 and p > q),
         ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pairs union all select * from own))
    select * from ranked where part = 'pair' or rank <= 50"""

#: crc32 by its table of 256 values (made by its rule), byte by byte; near words by the code points they lose.
SPELLING_SQL = r"""
    with recursive step as (select i, i::bigint as v, 0 as k from range(256) t(i)
                            union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from step where k < 8),
         crc as (select list(v order by i) as c from step where k = 8),
         t as (select doc_id::varchar as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents),
         u as (select id, run, count(*) as n, hex(encode(id || ':' || run)) as x from t where length(run) >= 6 group by 1, 2),
         h as (select id, run, n, xor(list_reduce(list_transform(range(1, length(x)::bigint, 2), lambda i: ('0x' || substr(x, i, 2))::bigint),
                                                   lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1]), 4294967295::bigint), 4294967295) as h from u, crc),
         w as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run) + 2)::int) else run end as word, n from h),
         words as (select word, sum(n)::bigint as n from w where length(word) >= 6 group by 1 having sum(n) >= 5),
         less as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
         cut as (select word, n, i, length(word) as size, substr(word, 1, (i - 1)::int) || substr(word, (i + 1)::int) as rest from less),
         near as (select a.word, b.word as other, b.n as n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.size = b.size and a.word <> b.word
                  union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
                  union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
         best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as form, max(n) as form_n from near group by 1),
         forms as (select words.word, words.n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 5 * words.n then form end as form, case when form_n >= 5 * words.n then form_n end as form_n
                   from words left join best on words.word = best.word),
         chain as (select word, word as at, form as next from forms union all select chain.word, forms.word, forms.form from chain join forms on chain.next = forms.word)
    select forms.word, forms.form, chain.at as root, forms.n, forms.n_near, forms.form_n from forms join chain on forms.word = chain.word where chain.next is null"""

ORACLE_SQL: dict[str, str] = {
    "op1_lattice_links": LINKS_SQL,
    "op2_mix_sources": MIX_SQL,
    "op3_warc": WARC_SQL,
    "op5_maxscore_top5": SEARCH_SQL,
    "op10_minmax_near_duplicates": NEAR_SQL,
    "op11_source_divergence": DIVERGENCE_SQL,
    "op13_spelling_variants": SPELLING_SQL,
}
