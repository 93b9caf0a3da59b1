"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bytebpe, collocate, cut_bpe, embed_dedup, html_text, linededup, lm_score, ngram_join, packing, resample, toxicity, winnow, wordbpe
from lodestone.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_groups(table(spark, sf_dir, "documents"), ngram_join.Similarity(words=4, percent=85))
    return found.select("doc_id", "n_shingles", "component_id")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.neighbours(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_recurring_lines(table(spark, sf_dir, "documents"))


def op11_cut_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocate.collocations(table(spark, sf_dir, "documents"), collocate.Settings(most=5, least=100, share=100, top=2000))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = resample.Settings(words=1, buckets=10_000, seed=2024, least_words=20, percent=10)
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), settings)


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_html_text": op7_html_text,
    "op8_fingerprints": op8_fingerprints,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_cut_bpe": op11_cut_bpe,
    "op12_collocations": op12_collocations,
    "op13_resample": op13_resample,
}
#: The same templates with words joined by spaces in place of hashes.
LINE_DEDUP_SQL = r"""
with total as (select count(*) as documents from documents where text is not null),
lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
plain as (select doc_id, pos, line, regexp_replace(trim(regexp_replace(line, '[ \t\r\f\x0B]+', ' ', 'g'), ' '), '[0-9]+', '<*>', 'g') as p from lines),
parts as (
  select doc_id, pos, line, p, string_split(p, ' ') as w, length(replace(replace(p, '<*>', ''), ' ', '')) as chars,
    concat_ws(' ', len(string_split(p, ' ')), array_to_string(string_split(p, ' ')[1:3], ' ')) as leaf from plain),
own as (
  select leaf, p, any_value(w) as w, any_value(chars) as chars, count(distinct doc_id) as docs, min(doc_id) as low, max(doc_id) as high
  from parts where chars > 0 group by 1, 2),
shared as (select leaf from own group by 1 having count(*) > 1 and min(low) <> max(high)),
words as (select leaf, p, low, high, unnest(w) as word, generate_subscripts(w, 1) as i from own join shared using (leaf)),
agreed as (select leaf, i, word, true as fixed from words group by 1, 2, 3 having min(low) <> max(high)),
told as (
  select leaf, p, string_agg(case when fixed then word else chr(10) end, ' ' order by i) as template, count(*) as size, count(fixed) as kept,
    coalesce(sum(case when fixed then length(replace(word, '<*>', '')) end), 0) as chars
  from words left join agreed using (leaf, i, word) group by 1, 2),
grown as (select t.leaf, t.p, t.template, t.chars, o.docs, o.low, o.high from told t join own o using (leaf, p) where t.kept >= 0.75 * t.size),
templates as (
  select leaf, template, min(low) as low from grown group by 1, 2
  having min(low) <> max(high) and sum(docs) >= greatest(2.0, 0.001 * (select documents from total) * pow(2.0, -max(chars) / 8.0))),
recurring as (
  select leaf, p, min(low) as low from (
    select g.leaf, g.p, t.low from grown g join templates t using (leaf, template)
    union all select leaf, p, low from own where low <> high and docs >= greatest(2.0, 0.001 * (select documents from total) * pow(2.0, -chars / 8.0))) group by 1, 2),
gone as (select doc_id, pos from parts join recurring using (leaf, p) where chars > 0 and doc_id <> low),
counts as (select doc_id, count(*) as n from gone group by 1),
kept as (select doc_id, string_agg(line, chr(10) order by pos) as t from lines anti join gone using (doc_id, pos) group by 1),
joined as (select d.*, coalesce(c.n, 0) as n_gone, case when c.n is null then d.text else coalesce(k.t, '') end as new_text
  from documents d left join counts c using (doc_id) left join kept k using (doc_id))
select doc_id, new_text as text, lang, source, case when n_gone > 0 then length(new_text) else n_chars end as n_chars, n_gone as n_dropped from joined"""

#: The same with every phrase of 1 to 5 words spelled out.
COLLOCATIONS_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
spans as (select lang, k, ws, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest(range(1, 6)) as k)),
f as (select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase, count(*) as f from spans group by 1, 2, 3 having count(*) >= 100),
totals as (select lang, sum(len(ws))::bigint as n from w group by 1),
parts as (select lang, k, phrase, f, string_split(phrase, ' ') as ws from f where k > 1),
inner_spans as (
  select lang, k, ws, f, m, unnest(range(1, k - m + 2)) as i from parts, (select unnest(range(2, 5)) as m) where m < k),
held as (select lang, array_to_string(ws[i : i + m - 1], ' ') as phrase, max(f) as holder from inner_spans group by 1, 2),
own as (select p.* from parts p left join held h using (lang, phrase) where h.holder is null or 100 * h.holder < 100 * p.f),
cuts as (select lang, phrase, f as a, k, ws, unnest(range(1, k)) as cut from own),
scored as (
  select c.lang, c.phrase, c.a, c.cut, x.f as l, y.f as r, t.n, (1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f) as score
  from cuts c join totals t using (lang)
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1 : c.cut], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.ws[c.cut + 1 : c.k], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from best qualify rank <= 2000"""

#: The same with a CRC-32 of each distinct word, byte by byte.
RESAMPLE_SQL = r"""
with bits as (
  select i, list_reduce(range(8), lambda c, _: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from range(256) r(i)),
crc_table as (select list(c order by i) as t from bits),
own as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents),
aim as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
words as (select w from own union select w from aim),
spelled as (
  select w, list_transform(range(octet_length(encode(w))), lambda i: 16 * (instr('0123456789ABCDEF', hex(w)[2 * i + 1]) - 1) + instr('0123456789ABCDEF', hex(w)[2 * i + 2]) - 1) as bytes from words),
bucketed as (
  select w, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295::bigint), 4294967295::bigint) % 10000 as bucket from spelled, crc_table),
s as (select bucket, count(*) as s from own join bucketed using (w) group by 1),
t as (select bucket, count(*) as t from aim join bucketed using (w) group by 1),
totals as (select (select count(*) from own)::double as ss, (select count(*) from aim)::double as tt),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * (ss + 10000) / ((coalesce(s, 0) + 1.0::double) * (tt + 10000))))::bigint as gain
  from (select distinct bucket from bucketed) left join s using (bucket) left join t using (bucket), totals),
sums as (select doc_id, count(*) as n, floor(sum(gain) / count(*)::double)::bigint as weight from own join bucketed using (w) join gains using (bucket) group by 1),
scored as (
  select d.doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::ubigint + 0.5) / 4294967296.0::double)))::bigint as score
  from documents d left join sums using (doc_id)),
ordered as (
  select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as place,
    count(*) filter (where n_features >= 20) over () as able from scored)
select doc_id, n_features, weight, score, case when place <= 10 * able // 100 then place end as rank from ordered"""

ORACLE_SQL: dict[str, str] = {"op10_line_dedup": LINE_DEDUP_SQL, "op12_collocations": COLLOCATIONS_SQL, "op13_resample": RESAMPLE_SQL}
