"""SQL for DuckDB that must give the rows of the queries."""

from __future__ import annotations

from tramsu.functions.normalize import LEVEL_PHRASES, WH_PHRASES
from tramsu.operators import spans
from tramsu.operators.decide import COMPARISON, CRITERIA
from tramsu.operators.items import OTHER_VERB, VERBS, WH_LEVELS
from tramsu.operators.survey import CONDITIONAL, GO, HISTORY_KEYWORDS
from tramsu.operators.verify import PASSES, PRONOUNS, WEIGHTS

_C = "c as (select * from (select *, row_number() over (partition by context_id order by loaded_at, title) as rn from corpus) where rn = 1)"
_Q = "q as (select * from (select *, row_number() over (partition by qa_id order by loaded_at) as rn from qa_pairs) where rn = 1)"
_B = "b as (select * from (select *, row_number() over (partition by item_id order by created_at) as rn from exam_dashboard) where rn = 1)"
_SPLIT = "case when lower(trim({0})) in ('train','training') then 'train' when lower(trim({0})) in ('dev','val','validation') then 'dev' else nullif(lower(trim({0})), '') end"
_INDEXED = _C.replace("c as (", "c0 as (", 1) + f", c as (select * from c0 where {_SPLIT.format('split')} in ('train', 'dev'))"
_WORDS = r"list_filter(regexp_split_to_array(replace({0}, chr(160), ' '), '\s+'), lambda x: x <> '')"
_YEARS = r"regexp_extract_all(context, '\b(9\d\d|1\d{3}|20[0-2]\d)\b', 1)"
_BLANKS = r"[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]"


def _any(col: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains({col}, '{p}')" for p in phrases) + ")"


def _wh(q: str, a: str) -> str:
    return (
        rf"case when regexp_full_match(trim(coalesce({a}, '')), '\d{{3,4}}') then 'thoi_gian' "
        + " ".join(f"when {_any(f'lower(coalesce({q}, chr(32)))', p)} then '{k}'" for k, p in WH_PHRASES.items())
        + " else 'su_kien' end"
    )


def _level(q: str) -> str:
    return "case " + " ".join(f"when {_any(f'lower(coalesce({q}, chr(32)))', p)} then '{k}'" for k, p in LEVEL_PHRASES.items()) + " else 'nhan_biet' end"


def _clarity(q: str) -> str:
    n, low, marks = f"len({_WORDS.format(q)})", f"lower({q})", f"(length({q}) - length(replace({q}, '?', '')))"
    pro = "|".join(PRONOUNS)
    return (
        f"round(least(1.0, greatest(0.0, 1.0 - case when {n} < 4 then 0.7 when {n} < 6 then 0.4 when {n} > 50 then 0.2 else 0.0 end"
        f" - case when {marks} = 0 then 0.3 when {marks} > 1 then 0.2 else 0.0 end"
        f" - case when regexp_matches({low}, '^({pro}) ') or regexp_matches({low}, ' ({pro}) ') then 0.15 else 0.0 end"
        rf" - case when regexp_matches({low}, '(^| )(không|chưa)( [^ ]+){{0,4}} (không|chưa)( |\?|$)') then 0.2 else 0.0 end))::double, 4)"
    )


_FACTS = "facts as (select context_id, list(distinct surface) as f from entities where surface is not null group by 1)"
_KNOWN = """case when f is null then 0.7 when list_contains(list_transform(f, lambda s: lower(trim(s))), lower(trim(coalesce(answer_text, '')))) then 1.0
 when trim(coalesce(answer_text, '')) <> '' and len(list_filter(f, lambda s: trim(s) <> '' and (contains(lower(trim(s)), lower(trim(coalesce(answer_text, '')))) or contains(lower(trim(coalesce(answer_text, ''))), lower(trim(s)))))) > 0
 then 0.85 else 0.5 end"""
_TYPES = """round((0.6 * case when list_filter(options, lambda o: o.is_correct)[1].entity_type is null then 0.7 else
 len(list_filter(options, lambda o: not o.is_correct and (o.entity_type is null or o.entity_type = list_filter(options, lambda p: p.is_correct)[1].entity_type))) / greatest(len(list_filter(options, lambda o: not o.is_correct)), 1) end + 0.4 * 0.8)::double, 4)"""
_POSITION = """pos as (select item_id, round(greatest(0.0, 1 - 4 * greatest(abs(a / n - 0.25), abs(bb / n - 0.25), abs(cc / n - 0.25), abs(dd / n - 0.25)))::double, 3) as answer_position_ok from (
 select item_id, count(*) over w as n, sum((answer_key = 'A')::int) over w as a, sum((answer_key = 'B')::int) over w as bb, sum((answer_key = 'C')::int) over w as cc, sum((answer_key = 'D')::int) over w as dd
 from b where answer_key in ('A','B','C','D') window w as (order by item_id rows unbounded preceding)))"""
_USABLE = """u as (select item_id, min(bloom) as bloom, min(context_id) as context_id, min(title) as title, max(verifier_score) as score from b
 where bloom in ('nhan_biet','thong_hieu','van_dung','van_dung_cao') and verifier_score between 0 and 1 and not isnan(verifier_score) group by 1)"""


def _matrix() -> str:
    rows = [f"('{c}','{c}',1.0::double)" for c in CRITERIA]
    for a, line in enumerate(COMPARISON):
        for k, v in enumerate(line):
            rows += [f"('{CRITERIA[a]}','{CRITERIA[a + 1 + k]}',{v}::double)", f"('{CRITERIA[a + 1 + k]}','{CRITERIA[a]}',1.0::double/{v})"]
    return "m(i, j, v) as (values " + ", ".join(rows) + ")"


_AHP = _matrix() + """, s as (select j, sum(v) as s from m group by j), w as (select i, avg(v / s.s) as w from m join s using (j) group by i),
 aw as (select m.i, sum(v * w.w) as aw from m join w on m.j = w.i group by m.i), l as (select avg(aw / w) as l, count(*) as n from aw join w using (i))"""
_CRITERIA = f"""per as (select method as alternative, round(avg((status = 'accepted')::int), 6) as vqr, round(avg(evidence_match), 6) as evidence_match, round(avg(bloom_fidelity), 6) as bloom_fidelity,
 round(avg(duplicate_check), 6) as duplicate_check, round(avg({_clarity("coalesce(question, '')")}), 6) as question_clarity from b group by 1),
 long as (select alternative, criterion, value from (unpivot per on vqr, evidence_match, bloom_fidelity, duplicate_check, question_clarity into name criterion value value))"""


def _bm25(name: str, text: str, top: int) -> str:
    """Common table expressions that end in name(q, doc, score, rank)."""
    words = r"unnest(list_filter(regexp_split_to_array(lower(replace({0}, chr(160), ' ')), '\s+'), lambda x: x <> '')) as term"
    return f"""{name}_t as (select context_id as doc, {words.format(text)} from c),
 {name}_p as (select doc, term, count(*) as tf from {name}_t group by 1, 2), {name}_l as (select doc, count(*) as dl from {name}_t group by 1),
 {name}_a as (select count(*) as n, avg(dl) as avgdl from {name}_l),
 {name}_r as (select term, avgdl, ln((n - count(*) + 0.5) / (count(*) + 0.5)) as raw from {name}_p, {name}_a group by term, n, avgdl),
 {name}_i as (select term, avgdl, case when raw < 0 then 0.25 * (select avg(raw) from {name}_r) else raw end as idf from {name}_r),
 {name}_s as (select q, doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from ask join {name}_i using (term) join {name}_p using (term) join {name}_l using (doc) group by 1, 2),
 {name} as (select q, doc, score, rank from (select *, row_number() over (partition by q order by score desc, doc) as rank from {name}_s where score > 0) where rank <= {top})"""


_ASK = r"""ask as (select q, term, count(*) as times from (select id as q, unnest(list_filter(regexp_split_to_array(lower(replace(
 trim(regexp_extract(regexp_replace(question, '^\s*câu\s*\d+\s*[:.]\s*', '', 'i'), '^((?s:.*?))(\n\s*[A-D][.: ]|$)', 1)), chr(160), ' ')), '\s+'), lambda x: x <> '')) as term from exam_items) group by 1, 2)"""


def _clean() -> str:
    """The cleaning of spans, step by step."""
    quote = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    front = lambda xs: "(?i)^(?:" + "|".join(sorted(xs, key=len, reverse=True)) + rf"){_BLANKS}+"
    edge = r"""[\s\x{a0},.\"''();:\-–]+"""
    strip = lambda c: f"regexp_replace({c}, '^{edge}|{edge}$', '', 'g')"
    year = spans.YEAR_ONLY
    return f"""r as (select surface, type, count(*) as n from entities where surface is not null group by 1, 2),
 a as (select *, {strip('surface')} as s, type in ('YEAR','DATE','CENTURY') as tm from r),
 b1 as (select *, regexp_matches(s, '{year}') or regexp_matches(s, '{spans.SUBWORD}') or lower(s) in ({quote(spans.STOPWORDS)}) or (length(s) <= 3 and lower(s) not in ({quote(spans.SHORT_NAMES)}))
  or {_any('lower(s)', spans.VERB_MARKERS)} or (type = 'ORG' and {_any('lower(s)', spans.RELIGION_MARKERS)}) as bad, regexp_matches(s, '{front(spans.TITLE_PREFIXES)}') as titled,
  {strip(f"regexp_replace(regexp_replace(s, '{front(spans.TITLE_PREFIXES)}', ''), '{front(spans.COMMON_PREFIXES)}', '')")} as t from a),
 b2 as (select *, bad or length(t) < 2 or regexp_matches(t, '{year}') or lower(t) in ({quote(spans.STOPWORDS)}) or regexp_matches(t, '^\\d+$') as out_ from b1)
 select surface, type, n, case when tm then surface when not out_ then t end as clean_surface, case when tm then type when not out_ then case when titled then 'PER' else type end end as clean_type,
 case when tm then surface when not out_ then replace(lower(t), ' ', '_') end as clean_normalized from b2"""


_LIVE = [("vqr", 3.0), ("evidence_match", 2.0), ("bloom_fidelity", 1.0), ("duplicate_check", 0.5), ("question_clarity", 0.0)]
_VERB = r"regexp_extract({0}, '(?:^|[^\p{{L}}\p{{N}}_])(" + "|".join(VERBS) + r")(?:[^\p{{L}}\p{{N}}_]|$)', 1)"


def sql() -> dict[str, str]:
    score = " + ".join(f"{w} * coalesce({n}, 0)" for n, w in WEIGHTS.items())
    topsis = """t as (select *, w * value / nullif(sqrt(sum(value * value) over (partition by {p} criterion)), 0) as v from vals),
 t2 as (select *, max(v) over (partition by {p} criterion) as best, min(v) over (partition by {p} criterion) as worst from t),
 d as (select {p} alternative, sqrt(sum((v - best) * (v - best))) as dp, sqrt(sum((v - worst) * (v - worst))) as dn from t2 group by {p} alternative)"""
    sens_of = lambda vary, by="method": f"""with {_B}, {_AHP}, {_CRITERIA.replace("method as", by + " as")}, g as (select range as step, 0.01 + range * 0.49 / 19 as x from range(20)),
 wr as (select i as criterion, round(w, 4) as w0 from w), wv as (select step, x, criterion, case when criterion = '{vary}' then x else w0 * (1 - x) / (1 - (select w0 from wr where criterion = '{vary}')) end as raw from wr, g),
 wn as (select step, x, criterion, raw / sum(raw) over (partition by step) as w from wv), vals as (select step, x, alternative, criterion, value, w from long join wn using (criterion)),
 {topsis.format(p="step, x,")}, sc as (select step, round(x, 3) as weight_varied, alternative, round(dn / (dp + dn + 1e-10), 4) as topsis_score from d)"""  # noqa: E731
    near = """g as (select item_id, list_distinct(list_transform(range(1, length(question) - 1), lambda i: lower(question)[i:i+2])) as g from b where length(question) >= 3),
 p as (select x.item_id as item, y.item_id as earlier, len(list_intersect(x.g, y.g)) as n, len(x.g) as a, len(y.g) as z from g x join g y on y.item_id < x.item_id and len(y.g) >= 0.84 * len(x.g) and len(x.g) >= 0.84 * len(y.g)),
 near as (select item as item_id, max(round(n::double / (a + z - n), 6)) as similarity from p where round(n::double / (a + z - n), 6) >= 0.85 group by 1)"""
    level = f"""lv as (select item_id, list_position(['nhan_biet','thong_hieu','van_dung','van_dung_cao'], {_level('question')}) as p, list_position(['nhan_biet','thong_hieu','van_dung','van_dung_cao'], bloom) as w from b),
 fid as (select item_id, case when p > 0 and w > 0 then [1.0, 0.6, 0.2, 0.0][abs(p - w) + 1]::double end as bloom_fidelity from lv)"""
    right = "len(list_filter(options, lambda o: o.is_correct))"
    fails = ", ".join(f"case when not coalesce({n} {'>' if n == 'duplicate_check' else '>='} {least}, false) then '{n}' end" for n, least in PASSES.items())
    return {
        "entity_clean": f"with {_clean()}",
        "survey_decision": f"""with {_C}, h as (select count(distinct title) as n_titles, count(*) as n_passages, count(*) filter ({_any("lower(coalesce(title, ''))", HISTORY_KEYWORDS)}) as n_history from c)
 select *, case when n_history >= {GO} then 'go' when n_history >= {CONDITIONAL} then 'conditional' else 'no_go' end as decision from h""",
        "question_parts": rf"""with {_C}, {_Q}, s as (select qa_id, answer_text, c.title as t, context, string_split(regexp_replace(context, '([.!?]){_BLANKS}+', '\1' || chr(1), 'g'), chr(1)) as ss
 from q join c using (context_id) where answer_text <> ''), e as (select *, coalesce(list_filter(ss, lambda x: contains(x, answer_text))[1], ss[1]) as sentence from s)
 select qa_id, case when t <> '' then t else trim(string_split(substr(coalesce(context, ''), 1, 40), ',')[1]) end as subject, coalesce(nullif({_VERB.format("coalesce(sentence, '')")}, ''), '{OTHER_VERB}') as verb from e""",
        "person_passages": f"""with {_C} select context_id, coalesce(bool_or(contains(lower(title), lower(surface))), false) as about_person from entities join (select context_id, title from c) using (context_id)
 where type = 'PER' and surface is not null group by 1""",
        "wh_levels": f"""with {_Q}, w as (select {_wh('question', 'answer_text')} as wh_type from q) select wh_type, case {' '.join(f"when wh_type = '{k}' then '{v}'" for k, v in WH_LEVELS.items())} end as level, count(*) as n from w group by 1, 2""",
        "exam_methods": f"""with {_B}, {_USABLE}, r as (select item_id, title from u order by md5('42|' || item_id), item_id limit 40), m as (select item_id, min(method) as method from b group by 1)
 select method, count(*) as n, count(distinct title) as titles from r join m using (item_id) group by 1""",
        "live_ranking": f"""with {_B}, {_CRITERIA}, lw(criterion, w0) as (values {', '.join(f"('{c}', {w}::double)" for c, w in _LIVE)}), vals as (select alternative, criterion, value, w0 / (select sum(w0) from lw) as w from long join lw using (criterion)), {topsis.format(p='')}
 select alternative, round(dn / (dp + dn + 1e-10), 4) as topsis_score, round(dp, 4) as d_pis, round(dn, 4) as d_nis, row_number() over (order by round(dn / (dp + dn + 1e-10), 4) desc, alternative)::int as rank from d""",
        "bank_verification": f"""with {_B}, {_FACTS}, {_POSITION}, {near}, {level}, ch as (select b.item_id, case when coalesce(len(options), 0) = 0 then 0.0 when evidence_match >= 0.9 then 1.0 when evidence_match >= 0.4 then 0.4 else 0.0 end as evidence_match,
 case when {right} = 1 then 1.0 when {right} = 2 then 0.0 else 0.0 end as single_correct, {_TYPES} as distractor_type_match, ({_KNOWN})::double as historical_correctness,
 {_clarity('coalesce(question, chr(32))')} as question_clarity, round(1 - coalesce(similarity, 0.0), 6)::double as duplicate_check, fid.bloom_fidelity, answer_position_ok
 from b left join facts using (context_id) left join pos on b.item_id = pos.item_id left join near on b.item_id = near.item_id left join fid on b.item_id = fid.item_id),
 s as (select *, round(({score})::double, 4) as score from ch) select item_id, score, case when score >= 0.75 then 'accepted' when score >= 0.55 then 'needs_review' else 'rejected' end as verdict,
 concat_ws(',', {fails}) as violations from s""",
        "corpus_dedup_first": f"with {_C} select context_id, title, md5(context) as text_md5 from c",
        "text_stats": f"""with {_C}, y as (select context_id, len({_WORDS.format('context')}) as n_tokens, {_YEARS} as ys from c)
 select context_id, n_tokens::int as n_tokens, len(ys)::int as n_years, case when n_tokens > 0 then round(100.0::double * len(ys) / n_tokens, 2) else 0.0 end as year_density,
 (select y::int from (select unnest(ys) as y) group by y order by count(*) desc, y::int limit 1) as primary_year from y""",
        "passage_ids": f"with {_C} select context_id, 'ctx_' || md5(context)[1:12] as own_id, 'itm_' || md5(concat_ws('|', context_id, title, 'x'))[1:12] as item_id from c",
        "title_inventory": f"""with {_Q} select title, count(distinct context_id) as n_passages, count(*) filter (not is_impossible) as n_answerable_q,
 count(*) filter (is_impossible) as n_unanswerable_q from q group by title""",
        "leak_check": f"""with {_C}, {_Q}, a as (select context_id, {_SPLIT.format('split')} as s from c union all select context_id, {_SPLIT.format('split')} from q)
 select context_id, count(distinct s) as n_splits from a where s is not null group by 1 having count(distinct s) > 1""",
        "split_report": f"""with {_C}, a as (select *, {_SPLIT.format('split')} as s from c where {_SPLIT.format('split')} is not null)
 select s as split, count(distinct title) as titles, count(*) as passages, count(*) filter (is_vietnam) as vn, count(*) filter (not is_vietnam) as world,
 round(100.0::double * count(*) / (select count(*) from a), 2) as pct from a group by s""",
        "qa_span_check": f"""with {_C}, {_Q} select coalesce(not is_impossible and length(answer_text) > 0 and (coalesce(substr(context, answer_start + 1, length(answer_text)) = answer_text, false)
 or contains(context, answer_text)), false) as span_ok, answer_span_ok as said_ok, count(*) as n from q join c using (context_id) group by 1, 2""",
        "wh_types": f"with {_Q} select qa_id, {_wh('question', 'answer_text')} as wh_type from q",
        "keyword_levels": f"with {_B} select {_level('question')} as level, wh_type, count(*) as n from b group by 1, 2",
        "evidence_sentence": rf"""with {_C}, {_Q}, s as (select qa_id, answer_text, string_split(regexp_replace(context, '([.!?]){_BLANKS}+', '\1' || chr(1), 'g'), chr(1)) as ss
 from q join c using (context_id) where answer_text <> '') select qa_id, coalesce(list_filter(ss, lambda x: contains(x, answer_text))[1], ss[1]) as sentence,
 len(list_filter(ss, lambda x: contains(x, answer_text))) > 0 as found from s""",
        "training_pairs": f"""with {_C}, {_Q}, o as (select context_id, list_sort(list(distinct o)) as l from (select context_id, answer_text as o from q union all select context_id, plausible_answer from q)
 where o is not null and o <> '' group by 1) select qa_id, {_wh('question', 'answer_text')} as wh_type, question as qg_target,
 array_to_string(list_filter(l, lambda x: x <> answer_text)[1:3], '|') as gold from q join (select context_id from c) using (context_id) left join o using (context_id) where answer_span_ok and not is_impossible""",
        "value_counts": "select type, bucket, count(*) as n from entities group by 1, 2",
        "token_quantiles": f"""with {_C}, t as (select is_vietnam, len({_WORDS.format('context')}) as n_tokens from c) select is_vietnam, count(*) as n, min(n_tokens)::double as least,
 round(quantile_cont(n_tokens, 0.25), 4) as q25, round(quantile_cont(n_tokens, 0.5), 4) as median, round(quantile_cont(n_tokens, 0.75), 4) as q75, max(n_tokens)::double as most, round(avg(n_tokens), 4) as mean from t group by 1""",
        "token_histogram": f"""with {_C}, t as (select len({_WORDS.format('context')})::double as x from c), l as (select min(x) as a, max(x) as z from t)
 select case when z > a then least(19, floor((x - a) / (z - a) * 20)) else 0 end::int as bin, count(*) as n from t, l group by 1""",
        "question_rates": f"""with {_Q} select is_vietnam, count(*) as n, round(avg(is_impossible::int), 6) as impossible, round(avg(answer_span_ok::int), 6) as span_ok,
 round(avg(coalesce(answer_text <> '', false)::int), 6) as answered from q group by 1""",
        "distractor_pool": """with r as (select distinct type, bucket, case when type in ('YEAR','DATE') then regexp_replace(surface, '^năm\\s+', '', 'i') else surface end as s from entities
 where surface is not null and bucket is not null) select type, bucket, count(*) as size, min(s) as least, max(s) as greatest from r group by 1, 2""",
        "item_violations": f"""with {_B}, r as (select *, list_filter(options, lambda o: o.is_correct) as right_, list_transform(options, lambda o: trim(o.text)) as tx from b)
 select item_id, concat_ws(',', case when not coalesce(len(options) = 4, false) then 'options_4' end,
 case when not coalesce(array_to_string(list_sort(list_transform(options, lambda o: o.label)), '') = 'ABCD', false) then 'labels' end,
 case when not coalesce(len(list_distinct(tx)) + (list_count(tx) < len(tx))::int = len(tx), false) then 'texts_distinct' end, case when not coalesce(len(right_) = 1, false) then 'one_correct' end,
 case when not coalesce(right_[1].label = answer_key and right_[1].text = answer_text, false) then 'key_text' end) as broken from r""",
        "bm25_topk": f"with {_INDEXED}, {_ASK}, {_bm25('k', 'context', 10)} select * from k",
        "rrf_fusion": f"""with {_INDEXED}, {_ASK}, {_bm25('k', 'context', 15)}, {_bm25('z', 'title', 15)}, f as (select q, doc, round(sum(1.0::double / (60 + rank)), 6) as score
 from (select q, doc, rank from k union all select q, doc, rank from z) group by 1, 2)
 select q, doc, score, rank from (select *, row_number() over (partition by q order by score desc, doc) as rank from f) where rank <= 5""",
        "dense_topk": """select q, doc, rank from (select a.vec_id as q, v.vec_id as doc, row_number() over (partition by a.vec_id order by round(list_inner_product(a.embedding::double[], v.embedding::double[]), 4) desc, v.vec_id) as rank
 from embeddings a, embeddings v where a.vec_id % 50 = 0) where rank <= 5""",
        "near_questions": f"""with {_B}, g as (select item_id, list_distinct(list_transform(range(1, length(question) - 1), lambda i: lower(question)[i:i+2])) as g from b where length(question) >= 3),
 p as (select x.item_id as item, y.item_id as earlier, len(list_intersect(x.g, y.g)) as n, len(x.g) as a, len(y.g) as z from g x join g y on y.item_id < x.item_id and len(y.g) >= 0.84 * len(x.g) and len(x.g) >= 0.84 * len(y.g)),
 s as (select item, earlier, round(n::double / (a + z - n), 6) as similarity from p), t as (select * from s where similarity >= 0.85)
 select item, similarity, min(earlier) as earlier from t where (item, similarity) in (select (item, max(similarity)) from t group by item) group by 1, 2""",
        "question_clarity": f"with {_B} select item_id, {_clarity('coalesce(question, chr(32))')} as question_clarity from b",
        "known_answers": f"with {_B}, {_FACTS} select item_id, ({_KNOWN})::double as historical_correctness from b left join facts using (context_id)",
        "distractor_types": f"with {_B} select item_id, {_TYPES} as distractor_type_match from b",
        "position_balance": f"with {_B}, {_POSITION} select item_id, answer_key, answer_position_ok from b left join pos using (item_id)",
        "level_fidelity": f"""with {_B}, x as (select item_id, list_position(['nhan_biet','thong_hieu','van_dung','van_dung_cao'], {_level('question')}) as p,
 list_position(['nhan_biet','thong_hieu','van_dung','van_dung_cao'], bloom) as w from b) select item_id, case when p > 0 and w > 0 then [1.0, 0.6, 0.2, 0.0][abs(p - w) + 1]::double end as fidelity from x""",
        "verify_verdict": f"""with {_B}, {_FACTS}, {_POSITION}, ch as (select item_id, evidence_match, duplicate_check, bloom_fidelity,
 case when len(list_filter(options, lambda o: o.is_correct)) = 1 then 1.0 else 0.0 end as single_correct, {_TYPES} as distractor_type_match, {_KNOWN} as historical_correctness,
 {_clarity('coalesce(question, chr(32))')} as question_clarity, answer_position_ok from b left join facts using (context_id) left join pos using (item_id)),
 s as (select item_id, round(({score})::double, 4) as score from ch) select item_id, score, case when score >= 0.75 then 'accepted' when score >= 0.55 then 'needs_review' else 'rejected' end as verdict from s""",
        "method_summary": f"""with {_B} select method, count(*) as n_items, round(avg((status = 'accepted')::int), 6) as vqr, count(*) filter (status = 'needs_review') as n_review,
 count(*) filter (status = 'rejected') as n_rejected, round(avg(verifier_score) filter (not isnan(verifier_score)), 6) as avg_score from b group by 1""",
        "level_agreement": f"""with {_B}, p as (select {_level('question')} as a, case when bloom_fidelity = 1 then bloom end as bb, bloom as wanted from b)
 select count(*) as n, round(avg((a = wanted)::int), 6) as a_match, round(avg((bb = wanted)::int), 6) as b_match, round(avg((a = bb)::int), 6) as agree from p where bb is not null""",
        "ahp_weights": f"with {_AHP} select i as criterion, round(w, 4) as weight, round(l, 4) as lambda_max, round((l - n) / (n - 1) / 1.41, 4) as cr from w, l",
        "bank_scorecard": f"""with {_B}, {_AHP}, {_CRITERIA}, vals as (select alternative, criterion, value, round(w.w, 4) as w from long join w on criterion = i), {topsis.format(p='')}
 select alternative, round(dn / (dp + dn + 1e-10), 4) as topsis_score, round(dp, 4) as d_pis, round(dn, 4) as d_nis, row_number() over (order by round(dn / (dp + dn + 1e-10), 4) desc, alternative)::int as rank from d""",
        "topsis_sensitivity": f"{sens_of('vqr')} select * from sc",
        "sensitivity_crossover": " union all ".join(
            f"""select * from ({sens_of(c, "wh_type")}, z as (select a.step, a.weight_varied as w, a.alternative as a, y.alternative as b, a.topsis_score > y.topsis_score as now from sc a join sc y on a.step = y.step and a.alternative < y.alternative),
 z2 as (select *, lag(now) over (partition by a, b order by step) as was, lag(w) over (partition by a, b order by step) as w_was from z)
 select a, b, step, round((w + w_was) / 2, 4) as weight, '{c}' as varied from z2 where was is not null and now <> was)"""
            for c in ("vqr", "evidence_match", "bloom_fidelity", "duplicate_check", "question_clarity")
        ),
        "method_strengths": f"""with {_B}, {_CRITERIA}, t as (select *, value = max(value) over (partition by criterion) as lead_ from long), t2 as (select *, lead_ and sum(lead_::int) over (partition by criterion) = 1 as alone from t)
 select alternative, coalesce(nullif(array_to_string(list_sort(list(criterion) filter (alone)), ','), ''), arg_max(criterion, (value, criterion))) as best_at from t2 group by 1""",
        "bloom_targets": """with r(i, level, r) as (values (0,'nhan_biet',0.4::double),(1,'thong_hieu',0.35::double),(2,'van_dung',0.2::double),(3,'van_dung_cao',0.05::double)),
 t as (select *, round_even(40 * r / sum(r) over (), 0)::bigint as raw from r) select level, case when i = 3 then 40 - (select sum(raw) from t where i < 3)::bigint else raw end as target from t""",
        "exam_random": f"with {_B}, {_USABLE} select item_id, bloom, score from u order by md5('42|' || item_id), item_id limit 40",
        "bank_kpis": f"""with {_B} select count(*) as total, round(100 * avg((status = 'accepted')::int), 2) as accepted_pct, count(distinct method) as methods,
 round(avg(verifier_score) filter (not isnan(verifier_score)), 4) as mean_score from b""",
        "level_report": f"""with {_B}, p as (select bloom, {_level('question')} as said from b where bloom in ('nhan_biet','thong_hieu','van_dung','van_dung_cao')),
 t as (select bloom as class, count(*) as n, count(*) filter (bloom = said) as hit from p group by 1), s as (select said as class, count(*) as said from p group by 1)
 select class, n, round(coalesce(hit::double / nullif(said, 0), 0.0), 6) as precision, round(hit::double / n, 6) as recall,
 round(coalesce(2 * coalesce(hit::double / nullif(said, 0), 0.0) * (hit::double / n) / nullif(coalesce(hit::double / nullif(said, 0), 0.0) + hit::double / n, 0), 0.0), 6) as f1 from t left join s using (class)""",
        "filtered_bank": f"""with {_B} select item_id, method, bloom, verifier_score from b where method in ('vit5','rag_llm') and status = 'accepted' and bloom in ('nhan_biet','thong_hieu')
 and verifier_score >= 0.8 and not isnan(verifier_score)""",
    }
