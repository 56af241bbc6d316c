"""The training-data queries: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.ngram_jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.substring_dedup import strip_repeats

    return strip_repeats(_table(spark, sf_dir, "documents"), width=13, text=False)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.ann_forest import neighbours

    return neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.language_mixture import fit, held_out, identify

    docs = _table(spark, sf_dir, "documents")
    models = fit(docs.where(~held_out()))
    return identify(docs, models).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.source_mixing import mix, taken

    return taken(*mix(_table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.byte_bpe import digests

    return digests(_table(spark, sf_dir, "documents"), ranks_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.quality_rules import score

    return score(_table(spark, sf_dir, "documents")).drop("rejected_by")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_html_text, op3_ann_forest, op4_ngram_jaccard, op5_language_mixture, op6_source_mixing, op7_line_dedup, op8_byte_bpe, op9_quality_rules, op10_substring_dedup)
}
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

#: The others have no SQL form (trained models, hashes, merges, HTML); tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
             g as (select h, max(page_id) as keep from p where octet_length(encode(h)) >= 1000 group by h)
        select p.page_id, cast(octet_length(encode(p.h)) as bigint) as payload_bytes, sha1(p.h) as payload_digest,
               case when g.keep is null or g.keep = p.page_id then 'response' else 'revisit' end as record_type,
               case when g.keep <> p.page_id then g.keep end as refers_to
        from p left join g on p.h = g.h""",
    "op4_ngram_jaccard": f"""
        with recursive w as (select doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
             x as (select doc_id, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
             g as (select doc_id, n, pos, list(word) over (partition by doc_id order by pos rows between current row and 3 following) as s from x),
             d as (select distinct doc_id, hash(s) as s from g where pos <= greatest(n - 3, 1)),
             c as (select doc_id, count(*) as k from d group by doc_id),
             i as (select a.doc_id as a, b.doc_id as b, count(*) as k from d a join d b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
             l as (select i.a, i.b from i join c x on i.a = x.doc_id join c y on i.b = y.doc_id where 100 * i.k >= 85 * (x.k + y.k - i.k)),
             e as (select a, b from l union all select b, a from l),
             r(doc_id, seen) as (select doc_id, doc_id from documents union select e.b, r.seen from r join e on e.a = r.doc_id),
             m as (select doc_id, min(seen) as component_id from r group by doc_id)
        select m.doc_id, coalesce(c.k, 0) as n_shingles, component_id from m left join c on m.doc_id = c.doc_id""",
    "op10_substring_dedup": f"""
        with w as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as ws from documents),
             x as (select doc_id, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
             g as (select doc_id, n, pos, word, array_to_string(list(word) over (partition by doc_id order by pos rows between current row and 12 following), ' ') as s from x),
             f as (select s, min(doc_id) as first_id from g where pos <= n - 12 group by s),
             h as (select g.doc_id, g.pos, g.word, f.first_id < g.doc_id as again from g left join f on g.s = f.s and g.pos <= g.n - 12),
             k as (select doc_id, pos, word, coalesce(bool_or(coalesce(again, false)) over (partition by doc_id order by pos rows between 12 preceding and current row), false) as gone from h),
             o as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by pos) filter (where not gone) as kept from k group by doc_id)
        select w.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join o on w.doc_id = o.doc_id""",
}
