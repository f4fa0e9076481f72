"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import decontaminate, filter_audit, html_text, language, mixing, neighbours, packing, repeats, row_patterns, simhash, toxicity, url_filter, wordpieces
from webloom.llm.common import table


def word_tokenizer() -> str:
    """Path of the tokenizer that packing uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.seed_labels(pages))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.texts(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.counts(table(spark, sf_dir, "documents"), word_tokenizer())


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.hundredth(table(spark, sf_dir, "embeddings"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), word_tokenizer()))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digests(table(spark, sf_dir, "documents"))


def op12_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_patterns.digests(row_patterns.matches(table(spark, sf_dir, "clicks")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontamination, op3_url_filter, op4_toxicity, op5_html_text, op6_token_counts, op7_language, op8_neighbours, op9_suffix_array, op10_packing, op11_mixing, op12_row_patterns, op13_filter_audit)}
#: What SQL can express. op5's is for pages as the tables hold them: one article of headings and paragraphs; op9's for ids that don't repeat.
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": r"""
    with lines as (select item_id, line, i from (select item_id, unnest(string_split(lower(text), chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from benchmark) where regexp_matches(line, '[\p{L}\p{N}_]')),
    ends as (select item_id, min(i) as lo, max(i) as hi from lines group by item_id),
    part as (select item_id, i = hi and hi > lo as answer, list_sort(list(struct_pack(i := i, w := regexp_extract_all(line, '[\p{L}\p{N}_]+')))) as ws from lines join ends using (item_id) group by item_id, answer),
    words as (select item_id, answer, flatten(list_transform(ws, lambda x: x.w)) as w from part),
    grams as (select distinct item_id, answer, n, array_to_string(w[k:k + 4], ' ') as g, least(n, 5) as len from (select *, len(w) as n, unnest(range(1, greatest(2, len(w) - 3))) as k from words)),
    whole as (select item_id, count(distinct (g, len)) as n_whole, count(distinct g) filter (where not answer and n >= 10) as n_question from grams group by item_id),
    big as (select item_id from words group by item_id having sum(len(w)) >= 5),
    doc as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents where text is not null),
    seen as (select distinct doc_id, array_to_string(w[k:k + len - 1], ' ') as g, len from (select doc_id, w, len, unnest(range(1, len(w) - len + 2)) as k from doc, (select distinct len from grams))),
    hit as (select doc_id, item_id, count(distinct (g, len)) as n, count(distinct g) filter (where not answer and grams.n >= 10) as q from seen join grams using (g, len) group by doc_id, item_id),
    found as (select doc_id, item_id, greatest(n::double / n_whole, case when n_question > 0 then q::double / n_question else 0 end) as o from hit join whole using (item_id) join big using (item_id))
    select doc_id, count(item_id) > 0 as contaminated, coalesce(list(item_id order by item_id) filter (where item_id is not null), []::bigint[]) as item_ids, coalesce(max(o), 0.0::double) as overlap
    from documents left join (select * from found where o >= 0.8 - 1e-9) using (doc_id) group by doc_id""",
    "op5_html_text": r"""
    with a as (select page_id, url, regexp_extract(html, '<article>(.*?)</article>', 1, 's') as h from pages),
    b as (select page_id, url, list_transform(string_split_regex(h, '</?(p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as blocks from a),
    t as (select page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) as text from b)
    select page_id, url, text, length(text) as n_chars from t""",
    "op9_suffix_array": r"""
    with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    pieces as (select doc_id, base, substr(h, 2 * base + 1, 800) as piece from (select *, unnest(range(0, length(h) // 2 - 99, 300)) as base from d where length(h) >= 200)),
    strings as materialized (select doc_id, base + i as pos, substr(piece, 2 * i + 1, 200) as s from (select *, unnest(range(0, least(300, length(piece) // 2 - 99))) as i from pieces)),
    firsts as (select s, min((doc_id, pos)) as earliest from strings group by s having count(*) > 1),
    again as (select doc_id, pos from strings join firsts using (s) where (doc_id, pos) > earliest),
    ordered as (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from again),
    runs as (select doc_id, pos, sum(case when before is null or pos > before + 100 then 1 else 0 end) over (partition by doc_id order by pos) as run from ordered),
    spans as (select doc_id, min(pos) as lo, max(pos) + 100 as hi from runs group by doc_id, run),
    edges as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as kept_from from spans),
    kept as (select doc_id, string_agg(substr(h, 2 * kept_from + 1, 2 * (lo - kept_from)), '' order by lo) as head, max(hi) as last, sum(hi - lo) as n_removed, count(*) as n_spans from edges join d using (doc_id) group by doc_id)
    select doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
    from d left join kept using (doc_id)""",
    "op12_row_patterns": r"""
    with r as (select distinct * from clicks where client_id is not null and ts is not null),
    o as (select client_id, click_id, ts, kind, floor(100 * value + 0.5)::bigint as cents, row_number() over (partition by client_id order by ts, click_id) as i from r),
    p as (select *, lag(cents) over w as before, ts - lag(ts) over w <= interval 5 minute as near from o window w as (partition by client_id order by i)),
    l as (select *, case when near and kind <> 'error' and cents < before then 'D' when near and kind <> 'error' and cents > before then 'U' else 'N' end as label from p),
    n as (select *, coalesce(min(case when label <> 'D' then i end) over w, 9000000000000000) as d_end, coalesce(min(case when label <> 'U' then i end) over w, 9000000000000000) as u_end,
          sum(coalesce(cents, 0)) over (partition by client_id order by i rows unbounded preceding) as upto from l window w as (partition by client_id order by i rows between current row and unbounded following)),
    a as (select client_id, i, click_id, cents, upto - cents as upto, d_end from (select client_id, i, click_id, cents, upto, lead(label) over w as next, lead(d_end) over w as d_end from n window w as (partition by client_id order by i)) where cents is not null and next = 'D'),
    u as (select a.*, n.u_end from a join n on n.client_id = a.client_id and n.i = a.d_end where n.label = 'U'),
    m as (select u.client_id, u.i, u.click_id as first_id, max_by(n.click_id, n.i) as last_id, max(n.i) - u.i + 1 as n_rows, (max_by(n.upto, n.i) - any_value(u.upto))::bigint as sum_cents, any_value(u.d_end) - u.i - 1 as d, max(n.i) - any_value(u.d_end) as ups
          from u join n on n.client_id = u.client_id and n.i > u.d_end and n.i <= u.u_end where n.kind = 'click' and n.cents >= u.cents and n.near group by u.client_id, u.i, u.click_id)
    select client_id, row_number() over (partition by client_id order by i) as match_no, first_id, last_id, n_rows, sum_cents, sha256('A' || repeat('D', d) || repeat('U', ups) || 'P') as labels_sha256 from m""",
    "op13_filter_audit": r"""
    with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
    w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first from t),
    f as (select doc_id, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] as fails from w),
    l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by doc_id),
    g as (select part, fails, coalesce(good, 0) as good, coalesce(bad, 0) as bad, count(*) as n from f left join l using (doc_id) group by all),
    k(x) as (values (1), (2), (3), (4), (5)),
    p as (select [a.x, b.x, c.x, d.x, e.x] as o from k a, k b, k c, k d, k e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s as (select o, i, o[i] as own from p, range(1, 6) r(i)),
    z as (select part, o, i, own, n, good, bad, fails[own] as bad_own, len(list_filter(o[1:i - 1], lambda x: fails[x])) > 0 as gone, len(list_filter([1, 2, 3, 4, 5], lambda x: fails[x])) as failed from g, s),
    c as (select part, o, i, own, sum(case when gone or bad_own then 0 else n end)::bigint as kept, sum(case when bad_own and not gone then n else 0 end)::bigint as removed, sum(case when bad_own and gone then n else 0 end)::bigint as redundant,
          sum(case when bad_own and failed = 1 then n else 0 end)::bigint as unique_fails, sum(case when bad_own and not gone then n * good else 0 end)::bigint as good_lost, sum(case when bad_own and not gone then n * bad else 0 end)::bigint as toxic_lost from z group by all)
    select part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') as filter_order, i::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from c""",
}


def _mixing_sql() -> str:
    """op11's SQL; its arithmetic draws are the operator's."""
    b, rounds = mixing.BLOCK, mixing.ROUNDS
    permuted = lambda x, keys: f"list_reduce({keys}, lambda y, k: {mixing.turn('n')}, ({x})::bigint)"
    keys = ", ".join(f"list_transform(range(1, {rounds + 1}), lambda r: {mixing.key('nr', str(p), 'n')})" for p in range(mixing.MOST + 1))
    length = f"case when index = n - 1 then last else {b} end"
    return rf"""
    with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
    s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as nr from d group by source),
    s1 as (select *, [5, 2, 1][(nr % 3 + 1)::int] as w, source_size * 2 as cap from s0),
    s2 as (select *, (sum(source_size) over ())::double * 1.5::double as share, coalesce(sum(cap) over (order by cap / w, nr rows between unbounded preceding and 1 preceding), 0)::double as gone, (sum(w) over (order by cap / w, nr rows between current row and unbounded following))::double as rest from s1),
    s3 as (select *, (share - gone) / rest * w >= cap as capped from s2),
    s4 as (select source, nr, source_size, case when capped then cap::double else (share - (sum(case when capped then cap else 0 end) over ())::double) / (sum(case when capped then 0 else w end) over ())::double * w end as target from s3),
    s5 as (select *, (source_size + {b - 1}) // {b} as n, floor(target)::bigint // source_size as whole from s4 where source_size > 0),
    s6 as (select *, source_size - {b} * (n - 1) as last, floor(target)::bigint - whole * source_size as over_, [{keys}] as keys from s5),
    s7 as (select *, {permuted("n - 1", "list_reverse(keys[(whole + 1)::int])")} as place from s6),
    ranks as (select *, unnest(range(0, n)) as rank from s7),
    passes as (select *, unnest(range(0, whole + 1)) as pass from ranks),
    uses as (select *, {permuted("rank", "keys[(pass + 1)::int]")} as index from passes),
    takes as (select nr, index, case when pass < whole then {length} else greatest(0, least({length}, over_ - (case when rank <= place then {b} * rank else {b} * (rank - 1) + last end))) end as take from uses),
    seats as (select d.*, nr, s4.source_size, s4.target, sum(size) over (partition by nr order by (doc_id % 1000003 * 31 + size) % {mixing.BUCKETS}, doc_id, size rows unbounded preceding) - size as start, row_number() over () as row from d join s4 on d.source is not distinct from s4.source),
    cut as (select *, unnest(range(start::bigint // {b}, (start + size - 1)::bigint // {b} + 1)) as index from seats where size > 0),
    part as (select row, nr, index, greatest(start, index * {b}) - index * {b} as pos, least(start + size, (index + 1) * {b}) - greatest(start, index * {b}) as length from cut),
    got as (select row, sum(greatest(0, least(length, take - pos)))::bigint as taken from part join takes using (nr, index) group by row)
    select doc_id, size, source_size, target, coalesce(taken, 0) as taken from seats left join got using (row)"""


ORACLE_SQL["op11_mixing"] = _mixing_sql()
