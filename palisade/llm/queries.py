"""The queries of the subpackage, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import table


def tokenizer(name: str) -> str:
    """Where the public vocabulary file ``name`` is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.jaccard_join import similar

    out = similar(table(spark, sf_dir, "documents"), bare_scan=True)
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.shards import shard

    out = shard(table(spark, sf_dir, "documents"), n_shards=40, bare_scan=True)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.token_files import token_files

    out = token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.quality import FEATURES, judge

    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), *FEATURES)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"), bare_scan=True)
    return out.select("row.doc_id", "n_lines", "n_removed", F.col("kept_text").alias("text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.warc import warc_round_trip

    out = warc_round_trip(table(spark, sf_dir, "pages"), bare_scan=True)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4 that SQL can express: the base columns of every document."""
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return op4_quality(spark, sf_dir).select("doc_id", *columns)


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The laws of op2 that SQL can express: rows, slots and bytes of every shard."""
    out = op2_sharding(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("slot").alias("n_slots"), F.max("slot").alias("last_slot"), F.sum("size").alias("bytes"))
    whole = out.agg(F.sum("bytes").alias("all_bytes"))
    return out.select("shard", "n_rows", "n_slots", "last_slot", whole.scalar().alias("all_bytes"))


QUERIES = {f.__name__: f for f in (quality_base, shard_laws, op1_jaccard_join, op2_sharding, op3_token_files, op4_quality, op5_decontamination, op6_line_dedup, op7_warc, op8_html, op9_token_counts, op10_bpe)}

ORACLES: dict[str, str] = {
    "quality_base": """
        with d as (select doc_id, coalesce(text, '') as t from documents),
        w as (select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from d),
        g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from w, unnest(range(1, len(w) - 1)) as u(i)),
        c as (select *, count(*) over (partition by doc_id, g) as n from g),
        r as (select doc_id, count(distinct j) as n from c, unnest(range(i, i + 3)) as u(j) where n > 1 group by doc_id),
        f as (select w.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l, coalesce(r.n, 0)::bigint as n_repeat_words from w left join r using (doc_id))
        select doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, n_repeat_words,
               n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f""",
    "shard_laws": """
        with d as (select count(*) as n, sum(coalesce(strlen(text), 0) + 16)::bigint as all_bytes from documents),
        s as (select s::int as shard, (n // 40 + (s < n % 40)::int)::bigint as n_rows, all_bytes from d, range(40) as u(s))
        select shard, n_rows, n_rows as n_slots, n_rows - 1 as last_slot, all_bytes from s where n_rows > 0""",
    "op5_decontamination": """
        with dw as (select doc_id, list_filter(regexp_split_to_array(lower_az, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
                    from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_az from documents)),
        bw as (select item_id, list_filter(regexp_split_to_array(lower_az, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
               from (select cast(item_id as varchar) as item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_az from benchmark)),
        windows as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
                    from bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as u(i) where len(w) > 0),
        places as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
                   from dw, (select distinct n from windows) as sizes, unnest(range(1, len(w) - n + 2)) as u(i)),
        occ as (select doc_id, i, n, item_id from places join windows using (n, g)),
        hits as (select doc_id, count(distinct j) as n_hit from occ, unnest(range(i, i + n)) as u(j) group by doc_id),
        names as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as s from (select distinct doc_id, item_id from occ) group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from dw left join hits using (doc_id) left join names using (doc_id)""",
    # DuckDB has no base32: each 5 bits of the digest, taken from its hex digits, give a letter.
    "op7_warc": """
        with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
        f as (select d, min(page_id) as first from p group by d),
        bits as (select distinct d, list_aggregate(list_transform(string_split(d, ''), lambda x: right('000' || bin(position(x in '0123456789abcdef') - 1), 4)), 'string_agg', '') as b from p),
        b32 as (select d, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (1 + 16 * substr(b, (5 * i + 1)::int, 1)::int + 8 * substr(b, (5 * i + 2)::int, 1)::int + 4 * substr(b, (5 * i + 3)::int, 1)::int
              + 2 * substr(b, (5 * i + 4)::int, 1)::int + substr(b, (5 * i + 5)::int, 1)::int)::int, 1)), 'string_agg', '') as digest from bits)
        select page_id, strlen(h)::bigint as payload_bytes, digest as payload_digest,
               case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id <> first then first end as refers_to
        from p join f using (d) join b32 using (d)""",
}
