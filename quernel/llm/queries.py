"""The queries of the ten operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table
from .decontaminate import contaminated
from .language_id import identify
from .ngram_join import jaccard_join
from .pii import find_pii
from .ppm import code_lengths
from .quality_knn import classify
from .quality_rules import judge
from .secrets import scan_secrets
from .sharding import lookup_table, shard, shard_names
from .source_mix import MODULUS, STEP, source_schedule

SHARDS = 64


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(small_batches(spark), sf_dir, "documents")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_documents(spark, sf_dir))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_schedule(_documents(spark, sf_dir))


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_documents(spark, sf_dir), SHARDS)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_documents(spark, sf_dir))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_lengths(_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_source_mix": op5_source_mix,
    "op6_quality_knn": op6_quality_knn,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_lm_score": op9_lm_score,
    "op10_language_id": op10_language_id,
}

_WORDS = r"string_split(trim(regexp_replace(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+', ' ', 'g')), ' ')"


def _gram(n: int) -> str:
    return " || ' ' || ".join(f"w[i + {k}]" for k in range(n))


def _windows(table_name: str, key: str, n: int) -> str:
    """(key, i, g) of all windows of n words, and of the whole of shorter texts."""
    return (
        f"select {key}, i, {_gram(n)} as g from (select {key}, w, unnest(range(1, len(w) - {n - 2})) as i from (select {key}, {_WORDS} as w from {table_name})) "
        f"union all select {key}, 1 as i, array_to_string(w, ' ') as g from (select {key}, {_WORDS} as w from {table_name}) where len(w) < {n} and w[1] <> ''"
    )


SQL: dict[str, str] = {
    "op2_decontaminate": f"""
        with b as (select distinct item_id, g from ({_windows("benchmark", "item_id", 8)})),
        d as (select doc_id, {_WORDS} as w from documents),
        hits as (
            select d.doc_id, b.item_id, b.g from (select doc_id, {_gram(8)} as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)) d
            join b using (g)
            union all
            select d.doc_id, b.item_id, b.g from (select item_id, g from b where len(string_split(g, ' ')) < 8) b
            join (select doc_id, ' ' || array_to_string(w, ' ') || ' ' as t from d) d on contains(d.t, ' ' || b.g || ' ')
        )
        select doc_id, item_id, count(*)::bigint as n_windows from hits group by 1, 2""",
    "op3_ngram_jaccard_join": f"""
        with recursive g as (select distinct doc_id, g from ({_windows("documents", "doc_id", 5)})),
        s as (select doc_id, count(*) as n from g group by 1),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        m as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where c::double / (x.n + y.n - c)::double >= 0.4),
        r as (select doc_id as a, doc_id as b from documents union select r.a, m.b from r join m on m.a = r.b),
        c as (select a, min(b) as class_id from r group by 1),
        k as (select a, count(*) as n_links from m group by 1)
        select c.a as doc_id, class_id, coalesce(n_links, 0)::bigint as n_links from c left join k using (a)""",
    "op4_quality_rules": r"""
        with t as (select doc_id, coalesce(text, '') as t from documents),
        m as (
            select doc_id, t, len(t) as n, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w,
                string_split(t, chr(10)) as lines from t
        ),
        c as (
            select *, len(w) as words, n - len(regexp_replace(t, '[#%&*$<>{}=~^\\]+', '', 'g')) as symbols, n - len(replace(t, '|', '')) as bars,
                n - len(replace(t, '!', '')) as shouts, n - len(regexp_replace(t, '[A-Z]+', '', 'g')) as capitals, n - len(regexp_replace(t, '[0-9]+', '', 'g')) as digits,
                len(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) as ink,
                len(list_filter(list_zip(w[:-2], w[2:]), lambda p: p[1] = p[2])) as repeats
            from m
        )
        select doc_id, words >= 3 and ink * 2 >= words * 5 and ink <= words * 12 and symbols * 10 <= greatest(words, 10) and bars * 5 <= greatest(words, 5)
            and shouts * 5 <= greatest(words, 5) and capitals * 3 <= greatest(n, 100) and digits * 5 <= n * 3
            and (len(lines) - len(list_distinct(lines))) * 2 <= len(lines) and repeats * 5 <= greatest(words, 10) as keep
        from c""",
    "op5_source_mix": rf"""
        with recursive units as (select doc_id, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) as tokens, md5(doc_id::varchar) as digest from documents),
        s as (select source, greatest(1, ceil(sum(tokens) / 2048.0))::bigint as blocks, pow(greatest(sum(tokens), 1)::double, 0.8) as w from units group by 1),
        share as (select source, blocks, greatest(1, round(w / sum(w) over () * 1000000000))::hugeint as n from s),
        part as (select source, blocks, n, sum(n) over (order by source)::hugeint as up_to, sum(n) over ()::hugeint as total from share),
        cut as (select source, blocks, (up_to - n) * {MODULUS}::hugeint // total as low, up_to * {MODULUS}::hugeint // total as high from part),
        size as (select max((blocks + 64) * total // n + 1)::bigint as most from part),
        points as (select i as slot, (i::hugeint * {STEP}::hugeint) % {MODULUS}::hugeint as point from size, generate_series(0, most) t(i)),
        every as (select slot, source, blocks, row_number() over (partition by source order by slot) - 1 as turn from points join cut on point >= low and point < high),
        turns as (select * from every where slot <= (select max(slot) from every where turn = blocks - 1)),
        placed as (select source, doc_id, tokens, (sum(tokens) over (partition by source order by digest, doc_id) - tokens)::bigint as start from units),
        pieces as (
            select source, doc_id, start, tokens, unnest(range(least(start // 2048, blocks - 1), least(greatest((start + tokens - 1) // 2048, start // 2048), blocks - 1) + 1)) as block
            from placed join s using (source)
        )
        select slot, source, block, (turn // blocks)::bigint as epoch, doc_id, greatest(start - block * 2048, 0)::bigint as first_token,
            (least(start + tokens - block * 2048, 2048) - greatest(start - block * 2048, 0))::bigint as n_tokens
        from (select slot, source, blocks, turn, turn % blocks as block from turns) join pieces using (source, block)""",
    # the table's shard at each slot as a character
    "op7_sharding": f"""
        with t as (select '{"".join(chr(48 + s) for s in lookup_table(shard_names(SHARDS)))}' as held)
        select documents.*, (ascii(substr(held, coalesce(('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint % 65537, 0)::int + 1, 1)) - 48)::int as shard from documents, t""",
}
