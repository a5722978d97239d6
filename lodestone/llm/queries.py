"""The queries of the training-data operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json")).drop("text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.piece_sampling import sample_pieces

    return sample_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model")).drop("text")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("place", "place2", "group")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm._common import cut
    from lodestone.llm.quality_rules import features, judge

    featured = features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return judge(cut(featured))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language_id import fit, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.filter(~held_out).select(F.col("doc_id").alias("key"), "text", "lang"))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.fill_middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm._common import stash
    from lodestone.llm.quality_classifier import document_statistics, fit, score

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    rows = stash(document_statistics(table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))), "statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    learn = stash(rows.filter(~F.col("held_out")).join(labels, "doc_id").select(F.col("doc_id").alias("key"), "x", "y"), "labelled")
    return score(rows, fit(learn))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_token_counts, op3_license_scan, op4_substring_dedup, op5_piece_sampling, op6_packing, op7_jaccard_join, op8_quality_rules, op9_fingerprints, op10_language_id, op11_spelling_variants, op12_fill_in_middle, op13_quality_classifier)}

# Whole tables in SQL: words with their 35-word windows, 5-word sets with their links and components, spelling variants, cut texts.
WORDS = r"[^\x20\x09-\x0D]+"
PASSAGES_SQL = rf"""with words as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as w from (select doc_id, regexp_extract_all(text, '{WORDS}') as ws from documents where text is not null)),
 starts as (select doc_id, i, w, count(*) over span = 35 as whole, string_agg(w, ' ') over span as passage from words window span as (partition by doc_id order by i rows between current row and 34 following)),
 copied as (select passage from starts where whole group by passage having count(*) > 1),
 marked as (select s.doc_id, s.i, s.w, c.passage is not null as starts_copy from starts s left join copied c on s.whole and s.passage = c.passage),
 covered as (select doc_id, i, w, bool_or(starts_copy) over (partition by doc_id order by i rows between 34 preceding and current row) as gone from marked),
 kept as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, string_agg(w, ' ' order by i) filter (where not gone) as rest from covered group by doc_id)
select d.doc_id, coalesce(k.n_words, 0) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.rest, '')) as kept_sha256 from documents d left join kept k on k.doc_id = d.doc_id"""
NEAR_SQL = rf"""with recursive words as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as ws from documents where text is not null),
 listed as (select doc_id, len(ws) as n, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as w from words),
 spans as (select doc_id, n, i, string_agg(w, ' ') over (partition by doc_id order by i rows between current row and 4 following) as shingle from listed),
 sets as (select distinct doc_id, shingle from spans where i <= greatest(n - 4, 1)),
 sizes as (select doc_id, count(*) as size, md5(string_agg(md5(shingle), '' order by shingle)) as class from sets group by doc_id),
 heads as (select class, min(doc_id) as head, any_value(size) as size from sizes group by class),
 posted as (select s.doc_id as head, h.size, s.shingle from sets s join heads h on s.doc_id = h.head),
 links as (select a.head as a, b.head as b from posted a join posted b on a.shingle = b.shingle and a.head < b.head and 100 * a.size >= 75 * b.size and 100 * b.size >= 75 * a.size
  group by a.head, b.head, a.size, b.size having 100 * count(*) >= 75 * (a.size + b.size - count(*))),
 ways as (select a, b from links union all select b, a from links),
 reach(node, other) as (select head, head from heads union select r.node, w.b from reach r join ways w on r.other = w.a),
 least as (select node, min(other) as component_id from reach group by node)
select d.doc_id, coalesce(s.size, 0) as n_shingles, coalesce(l.component_id, d.doc_id) as component_id from documents d left join sizes s on s.doc_id = d.doc_id left join heads h on h.class = s.class left join least l on l.node = h.head"""

# The checksum is summed byte by byte from a table of 256 steps; near words meet under one letter left out.
VARIANTS_SQL = r"""with recursive bits(i, k, v) as (select i, 0, i::bigint from range(256) t(i) union all select i, k + 1, xor(v >> 1, case when v % 2 = 1 then 3988292384 else 0 end) from bits where k < 8),
 steps as (select list(v order by i) as step from bits where k = 8),
 runs as (select coalesce(cast(doc_id as varchar), '') as doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents where text is not null),
 once as (select doc, run, count(*) as c, hex(encode(doc || ':' || run)) as x from runs where length(run) >= 7 group by doc, run),
 summed as (select run, c, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::bigint)), lambda s, b: xor(s >> 8, step[(xor(s, b) & 255) + 1]))) as h from once, steps),
 words as (select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(c) as n from summed group by 1),
 kept as (select word, n::bigint as n from words where length(word) >= 7 and n >= 2),
 holes as (select word, n, unnest(range(0, length(word))) as i from kept),
 masked as (select word, n, i, left(word, i::int) as a, substr(word, i::int + 2) as b from holes),
 replaced as (select x.word, y.word as near, y.n as near_n from masked x join masked y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word),
 dropped as (select distinct m.word, m.n, k.word as near, k.n as near_n from masked m join kept k on m.a || m.b = k.word),
 pairs as (select * from replaced union all select word, near, near_n from dropped union all select near, word, n from dropped),
 best as (select word, count(*) as n_near, min(struct_pack(a := -near_n, b := near)) as top from pairs group by word),
 formed as (select k.word, k.n, coalesce(b.n_near, 0) as n_near, case when -b.top.a >= 10 * k.n then b.top.b end as form, case when -b.top.a >= 10 * k.n then -b.top.a end as form_n from kept k left join best b on b.word = k.word),
 walk(word, stop, k) as (select word, word, 0 from formed union all select w.word, f.form, w.k + 1 from walk w join formed f on f.word = w.stop where f.form is not null),
 ends as (select word, arg_max(stop, k) as root from walk group by word)
select f.word, f.n, f.n_near, f.form, f.form_n, e.root from formed f join ends e on e.word = f.word"""
MIDDLE_SQL = r"""with drawn as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as ws, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
 picked as (select doc_id, t, ws, len(ws) as n, ('0x' || substr(d, 1, 8))::bigint % (len(ws) + 1) as c1, ('0x' || substr(d, 9, 8))::bigint % (len(ws) + 1) as c2, ('0x' || substr(d, 17, 8))::bigint % 100 as h3, ('0x' || substr(d, 25, 8))::bigint % 100 as h4 from drawn),
 formed as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 50 then 'plain' when h4 < 80 then 'spm' else 'psm' end as form,
  array_to_string(ws[1:least(c1, c2)], '') as p, array_to_string(ws[least(c1, c2) + 1:greatest(c1, c2)], '') as m, array_to_string(ws[greatest(c1, c2) + 1:n], '') as s from picked)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from formed"""

#: The other operators' methods (merges, models, samples, plans) have no SQL; tests hold them against brute force.
SQL: dict[str, str] = {"op4_substring_dedup": PASSAGES_SQL, "op7_jaccard_join": NEAR_SQL, "op11_spelling_variants": VARIANTS_SQL, "op12_fill_in_middle": MIDDLE_SQL}
