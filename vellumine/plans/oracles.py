"""SQL of the named queries, for comparison with another engine (which has no lookarounds in patterns and keeps no order in
distinct lists; both are spelled out here)."""

from __future__ import annotations

from vellumine.plans import oracle_values as X
from vellumine.plans.oracle_values import ARITHMETIC, COMPARATIVE, TABLE_LABELS

SP = f"[{X.SPACES}]".replace("\x85", "\\x{85}")
TOKEN = X.TOKEN.replace("'", "''")
_NUM = f"(?:₹{SP}*)?\\p{{Nd}}[\\p{{Nd}},]*(?:\\.\\p{{Nd}}+)?(?:{SP}*%|(?:{SP}*(?:lakhs?|crores?|million|billion)))?"
_SEP = "(?i)(?:^|[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}.])"


def lst(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{SP}+', ' ', 'g')"


def retrieval(x: str) -> str:
    return strip(collapse(f"translate(lower({x}), '₹`', '')"))


def citation(x: str) -> str:
    return strip(f"lower({collapse(f'coalesce({x}, chr(32))')})")


def evaluation(x: str) -> str:
    t = f"replace(replace(replace(lower(coalesce({x}, '')), '₹', ''), 'rs.', ''), 'rs ', '')"
    return strip(collapse(f"regexp_replace(regexp_replace({t}, '\\blakhs\\b', 'lakh', 'g'), '\\bcrores\\b', 'crore', 'g')"))


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{TOKEN}'), lambda t: lower(t))"


def bare(t: str) -> str:
    return f"regexp_replace(lower({t}), '\\p{{Nd}}+$', '')"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def topic(x: str, without) -> str:
    kept = f"list_filter({tokens(x)}, lambda t: regexp_matches(t, '^\\p{{L}}+$') and length(t) >= 3 and not list_contains({lst(without)}, t))"
    return f"list_transform({kept}, lambda t: {bare('t')})"


def terms_sql(table: str, keys: str, x: str) -> str:
    """Distinct query terms as column terms, computed step by step."""
    more = " || ".join(f"case when list_contains(base, '{k}') then {lst(v)} else [] end" for k, v in X.EXPANSIONS.items())
    return f"""select {keys}, {ordered_distinct("whole")} as terms from (select *, base || {more} as whole from (
        select *, {ordered_distinct("raw")} as base from (select *, {topic(x, X.STOPWORDS)} as raw from {table})))"""


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def ascii_words(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-zA-Z]{{3,}}$'))"


def scan_clean(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace(replace(coalesce({x}, ''), chr(12), ''), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', '\n\n', 'g')")


def quality(x: str) -> str:
    t = scan_clean(x)
    words = count(t, "[A-Za-z\\x{900}-\\x{97F}]{2,}")
    alpha, bad = count(t, "\\p{L}"), count(t, "[\\x{FFFD}\\x{FFFE}]")
    return f"""case when length({t}) = 0 then 0.0 else greatest(0.0, 0.35 * {alpha} / length({t}) + 0.35 * least(1.0, {words} / greatest(1.0, length({t}) / 6))
        + case when {words} > 0 then 0.30 else 0.0 end - 0.70 * {bad} / length({t})) end"""


def corruption(x: str) -> str:
    t = f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{SP}+'), lambda t: t != '')"
    weight = "(case when regexp_matches(t, '[A-Za-z]\\p{Nd}[A-Za-z]|\\p{Nd}[A-Za-z]\\p{Nd}') then 1.0 else 0.0 end + case when regexp_matches(t, '[|_=~^]{2,}') then 1.0 else 0.0 end + case when regexp_matches(t, '[\\x00-\\x1f\\x7f]') then 0.5 else 0.0 end + case when length(t) = 1 and not regexp_matches(t, '^[aAiI\\p{Nd}]$') then 0.5 else 0.0 end)"
    return f"case when len({t}) = 0 then 0.0 else least(1.0, list_sum(list_transform({t}, lambda t: {weight})) / len({t})) end"


def disagreement(a: str, b: str) -> str:
    x, y = (f"list_distinct(list_transform(list_filter(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9\\x{{80}}-\\x{{FFFF}}]+'), lambda t: length(t) > 1), lambda t: lower(t)))" for c in (a, b))
    return f"(select case when len(x) = 0 or len(y) = 0 then 0.0 else round(1 - len(list_intersect(x, y))::double / len(list_distinct(x || y)), 3) end from (select {x} as x, {y} as y))"


def once(table: str, key: str) -> str:
    return f"(select * from {table} qualify row_number() over (partition by {key}) = 1)"


PAGES, CHUNKS, REQUESTS, RESPONSES = once("pages", "page_id"), once("chunks", "chunk_id"), once("chat_requests", "request_id"), once("chat_responses", "request_id")
ANSWERED = f"(select a.request_id, a.answer, r.query from {RESPONSES} a join {REQUESTS} r using (request_id))"
_V = "(select q.vec_id as query_id, e.vec_id as id, q.label as ql, e.label as el, list_distance(q.embedding::double[], e.embedding::double[]) ** 2 as distance from embeddings q, embeddings e where q.vec_id % 20 = 0)"


def _ranked(k: int, where: str = "true") -> str:
    return f"(select query_id, id, distance, row_number() over (partition by query_id order by distance, id) as rank from {_V} where {where} qualify row_number() over (partition by query_id order by distance, id) <= {k})"


_LINES = f"(select document_id, page_number, unnest(l) as x, generate_subscripts(l, 1) as line_no from (select document_id, page_number, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as l from {PAGES}))"
_DOCS = "(select regexp_replace(lower(coalesce(section, 'Unknown') || ' ' || coalesce(source, 'Unknown') || ' ' || coalesce(text, '')), '', '') as t, chunk_id from " + CHUNKS + ")"
_TF = f"(select chunk_id, token, count(*) as f from (select chunk_id, unnest(regexp_extract_all(t, '{TOKEN}')) as token from {_DOCS}) group by all)"
_WORDS = f"""(with df as (select token, count(*) as df from {_TF} group by 1), n as (select count(*) as n from {CHUNKS}),
    raw as (select token, df, ln(n - df + 0.5) - ln(df + 0.5) as idf from df, n)
    select token, df, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end as idf from raw)"""


def sql() -> dict[str, str]:
    from vellumine.plans import oracle_steps

    return _sql() | oracle_steps.sql()


def _sql() -> dict[str, str]:
    dev, lat, letters = (count("t", p) for p in ("[\\x{900}-\\x{97F}]", "\\p{Latin}", "\\p{L}"))
    dtokens = "list_distinct(regexp_extract_all(t, '[\\x{900}-\\x{97F}]+'))"
    mar, hin = (f"len(list_intersect({dtokens}, {lst(h)}))" for h in (X.MARATHI_HINTS, X.HINDI_HINTS))
    label = f"(lower(x) in ({', '.join(repr(t) for t in TABLE_LABELS)}) or regexp_matches(lower(x), '^fy{SP}+\\p{{Nd}}{{4}}[-–]\\p{{Nd}}{{2}}$|^march{SP}+31,?{SP}+\\p{{Nd}}{{4}}$'))"
    tlabel = label.replace("lower(x)", "lower(title)")
    latest = "(select * from document_status where document_id is not null qualify row_number() over (partition by document_id order by regexp_replace(updated_at, '(Z|\\+00:00)$', '')::timestamp desc nulls last, status desc) = 1)"
    scanq, rq = quality("ocr_text"), quality("raw_text")
    flat = strip(collapse("coalesce(raw_text, '')"))
    text = strip("coalesce(text, '')")
    sources = f"(select distinct request_id, unnest(sources, recursive := true) from {RESPONSES})"
    asked = f"(select request_id as query_id, {tokens('query')} as toks from {REQUESTS} where request_id % 20 = 0)"
    return {
        "tokenize_counts": f"select doc_id, coalesce({count('text', TOKEN)}, 0) as tokens from documents",
        "token_vocabulary": f"select token, count(*) as uses from (select unnest({tokens('text')}) as token from documents) group by 1",
        "normalized_forms": f"select request_id, {retrieval('answer')} as retrieval, {citation('answer')} as citation, {strip(collapse('lower(answer)'))} as rerank, {evaluation('answer')} as evaluation from {RESPONSES} where answer is not null",
        "normalized_tokens": f"select chunk_id, len(b) as tokens, len(list_distinct(b)) as distinct_tokens from (select chunk_id, list_filter(list_transform({tokens('text')}, lambda t: {bare('t')}), lambda t: t != '') as b from {CHUNKS})",
        "query_terms": f"select request_id, array_to_string(terms, ' ') as terms from ({terms_sql(REQUESTS, 'request_id', 'query')})",
        "answer_terms": f"select request_id, array_to_string({topic('answer', [*X.STOPWORDS, *X.UNITS])}, ' ') as terms from {RESPONSES} where answer is not null",
        "query_overlap": f"""select request_id, round(case when len(q) = 0 then 0.0 else len(list_intersect(q, a)) / len(q) end, 6) as overlap from (select request_id,
            list_distinct({ascii_words(citation('query'))}) as q, list_distinct({ascii_words(citation('answer'))}) as a from {ANSWERED} where answer is not null)""",
        "phrase_overlap": f"""select request_id, round(case when len(terms) = 0 then 0.0 else len(list_filter(terms, lambda x: length(x) >= 5 and contains(t, x))) / len(terms) end, 6) as overlap
            from (select request_id, terms, {retrieval('answer')} as t from ({terms_sql(ANSWERED, 'request_id, answer', 'query')}) where answer is not null)""",
        "token_disagreement": f"select page_id, {disagreement('text', 'ocr_text')} as disagreement from {PAGES}",
        "text_quality": f"select page_id, round({quality('text')}, 6) as quality from {PAGES}",
        "corruption_ratio": f"select page_id, round({corruption('text')}, 6) as ratio from {PAGES}",
        "detect_language": f"""select page_id, case when {strip('t')} = '' then 'unknown' when {dev} / greatest(1, {letters}) < 0.15 and {lat} / greatest(1, {letters}) >= 0.5 then 'eng'
            when {dev} / greatest(1, {letters}) >= 0.5 then case when {mar} > {hin} then 'mar' when {hin} > {mar} then 'hin' when regexp_matches(t, '[{X.MARATHI_LETTERS}]') then 'mar' else 'hin' end
            when {dev} > 0 and {lat} > 0 then 'mixed' else 'unknown' end as detected from (select page_id, translate(coalesce(text, ''), '{X.ZERO_WIDTH}', '') as t from {PAGES})""",
        "should_scan": f"select page_id, length({flat}) < 80 or (coalesce(image_count, 0) > 0 and (length({flat}) < 900 or {rq} < 0.42)) as scan from {PAGES}",
        "choose_text": f"""select page_id, method, round(case when method = 'native' then r else s end, 6) as score from (select page_id, r, s, case when coalesce(raw_text, '') = '' then 'scan' when coalesce(ocr_text, '') = '' then 'native'
            when s >= r + 0.06 then 'native+scan' when length({strip("raw_text")}) < 80 and length({strip("ocr_text")}) > length({strip("raw_text")}) then 'native+scan' else 'native' end as method
            from (select *, {rq} as r, {scanq} as s from {PAGES}))""",
        "should_denoise": f"""select page_id, long and (ratio >= 0.08 or coalesce(c >= 0 and c < 55, false) or coalesce(ocr_used and apart >= 0.45 and c < 65, false)) as needs, round(case when long then ratio else 0.0 end, 6) as ratio,
            case when long then apart else 0.0 end as disagreement from (select page_id, ocr_used, ocr_confidence as c, length({text}) >= 80 as long, {corruption(text)} as ratio, {disagreement(text, 'ocr_text')} as apart from {PAGES})""",
        "without_headers": f"select page_id, md5(array_to_string(list_filter(string_split(text, '\n'), lambda x: not list_contains(['For and on behalf of the Board', 'This page is left blank on purpose.'], {strip('x')})), '\n')) as digest from {PAGES} where text is not null",
        "sanitize_filename": f"""select distinct filename, left(case when lower(s) like '%.pdf' then s else s || '.pdf' end, 180) as safe from (select filename, case when s = '' then 'document.pdf' else s end as s from (
            select filename, regexp_replace(regexp_replace({strip("list_extract(string_split(replace(coalesce(filename, ''), chr(92), '/'), '/'), -1)")}, '[^A-Za-z0-9._()\\- ]+', '_', 'g'), ' +', ' ', 'g') as s from document_status))""",
        "content_hash": "select sha256(text) as sha256, min(doc_id) as kept_id, count(*) as copies from documents where text is not null group by 1",
        "number_strings": f"select request_id, array_to_string(list_transform(regexp_extract_all(answer, '{_SEP}({_NUM})', 1), lambda n: trim(n)), '|') as numbers from {RESPONSES} where answer is not null",
        "page_lines": f"select document_id, page_number, count(*) as lines, sum((regexp_replace(x, '{SP}+', '', 'g') != '')::int)::bigint as filled from {_LINES} group by all",
        "heading_lines": f"""select document_id, page_number, line_no, x as line from (select *, {strip(f"regexp_extract(x, '^\\p{{Nd}}+[.)]?{SP}+(.+)$', 1)")} as title from (select document_id, page_number, line_no, {strip(collapse('x'))} as x from {_LINES}))
            where x != '' and not {label} and case when regexp_matches(x, '^\\p{{Nd}}+[.)]?{SP}+.+$') then length(title) >= 3 and not {tlabel} and not regexp_matches(title, '^[\\p{{Nd}},.\\-()₹`]+$')
            else regexp_matches(x, '^[A-Z]\\.{SP}+[A-Za-z]') or (regexp_matches(x, '[\\p{{Lu}}\\p{{Lt}}]') and not regexp_matches(x, '\\p{{Ll}}') and len(string_split(x, ' ')) <= 10 and length(x) >= 4) end""",
        "chunk_statistics": f"select language, count(*) as chunks, count(distinct document_id) as documents, max(length(text)) as longest, round(avg(length(text)), 4) as average from {CHUNKS} group by 1",
        "vector_topk": f"select query_id, id, round(distance, 6) as distance, rank from {_ranked(15)}",
        "vector_topk_filtered": f"select query_id, id, round(distance, 6) as distance, rank from {_ranked(5, 'ql = el')}",
        "bm25_words": f"select lower(token) as token, df, round(idf, 6) as idf from {_WORDS}",
        "bm25_topk": f"""with q as (select query_id, token, count(*) as times from (select query_id, unnest(toks) as token from {asked}) group by all), dl as (select chunk_id, coalesce({count('t', TOKEN)}, 0) as dl from {_DOCS}),
            s as (select query_id, chunk_id as id, round(sum(times * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / (select avg(dl) from dl)))), 9) as s from q join {_WORDS} using (token) join {_TF} using (token) join dl using (chunk_id) group by all)
            select query_id, id, round(s, 4) as score, row_number() over (partition by query_id order by s desc, id) as rank from s qualify rank <= 15""",
        "rank_fusion": f"""select query_id, id, round(score, 9) as score, vector_rank, bm25_rank, row_number() over (partition by query_id order by score desc, id) as rank from (
            select query_id, id, coalesce(1.0 / (60 + a.rank), 0)::double + coalesce(1.0 / (60 + b.rank), 0)::double as score, a.rank as vector_rank, b.rank as bm25_rank
            from {_ranked(15)} a full join {_ranked(15, 'ql = el')} b using (query_id, id)) qualify rank <= 15""",
        "merged_records": f"select query_id, id, round(greatest(a.distance, b.distance), 6) as distance, a.rank as vector_rank, b.rank as bm25_rank from {_ranked(15)} a full join {_ranked(5, 'ql = el')} b using (query_id, id)",
        "lexical_scores": f"""with p as (select s.request_id as query_id, s.chunk_id, {topic('r.query', X.STOPWORDS)} as terms, list_distinct({tokens(retrieval("coalesce(c.section, '')"))}) as st, list_distinct({tokens(retrieval("coalesce(c.text, '')"))}) as tt
            from {sources} s join {REQUESTS} r using (request_id) join {CHUNKS} c on c.chunk_id = s.chunk_id),
            s as (select query_id, chunk_id, coalesce(list_sum(list_transform(terms, lambda t: case when list_contains(st, t) then 3.0 when list_contains(tt, t) then 1.0 else 0.0 end)), 0.0)::double as score from p)
            select query_id, chunk_id, score, round(case when hi > lo then (score - lo) / (hi - lo) when hi > 0 then 1.0 else 0.0 end, 6) as norm from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from s)""",
        "citation_errors": f"""select cite_id, array_to_string(list_filter([case when coalesce(chunk_id, '') = '' then 'missing chunk_id' when chunk_id not in (select chunk_id from {CHUNKS}) then 'chunk_id not found in retrieved results' end,
            case when page_number is null then 'missing page number' end, case when {strip("coalesce(evidence, '')")} = '' then 'missing evidence' end], lambda e: e is not null), '; ') as errors from {once('citations', 'cite_id')} where errors != ''""",
        "routes": f"select request_id, case when {' or '.join(f"regexp_matches(lower(coalesce(query, '')), '{p}')" for p in ARITHMETIC)} then 'calculator' else 'retrieval' end as route, coalesce(regexp_matches(lower(query), '{'|'.join(COMPARATIVE)}'), false) as comparative from {REQUESTS}",
        "chat_history": f"select conversation_id, count(*) + count(answer) as messages, arg_min(query, row(requested_at, request_id)) as first from {REQUESTS} left join (select request_id, answer from {RESPONSES}) using (request_id) where conversation_id is not null group by 1",
        "latest_status": f"select document_id, status, page_count, chunk_count from {latest}",
        "document_listing": f"""select document_id, coalesce(nullif(filename, ''), storage_filename) as filename, coalesce(nullif(status, ''), case when coalesce(c, 0) > 0 then 'ready' else 'processing' end) as status,
            coalesce(nullif(page_count, 0), p, 0)::int as page_count, coalesce(nullif(chunk_count, 0), c, 0)::int as chunk_count from {latest}
            left join (select document_id, count(distinct page_number) as p from pages group by 1) using (document_id) left join (select document_id, count(distinct chunk_id) as c from chunks group by 1) using (document_id)""",
        "first_by_hash": "select sha256, arg_min(document_id, row(created_at, document_id)) as document_id from document_status where sha256 is not null and sha256 != '' group by 1",
        "incremental_index": f"select chunk_id, coalesce(nullif(source, ''), 'Unknown') as source, coalesce(nullif(section, ''), 'Unknown') as section, coalesce(page_number, 0) as page_number, coalesce(nullif(language, ''), 'unknown') as language from {CHUNKS} where chunk_id not in (select chunk_id from citations where chunk_id is not null)",
        "deleted_documents": f"select chunk_id, document_id from {CHUNKS} where document_id not in (select document_id from {latest} where status = 'failed')",
        "language_histogram": f"select language, count(*) as pages from {PAGES} group by 1",
        "scan_summary": f"select document_id, count(*) as pages, sum(coalesce(ocr_used, false)::int)::bigint as ocr_used, sum(coalesce(denoised, false)::int)::bigint as denoised, round(coalesce(avg(ocr_confidence) filter (ocr_confidence >= 0), -1.0), 4) as confidence from {PAGES} group by 1",
        "rate_limit_bound": f"select request_id, count(*) over (partition by client order by floor(epoch(requested_at))::bigint range between 3599 preceding and current row) as recent from {REQUESTS}",
        "page_match": f"""select request_id, coalesce(list_has_any(list_transform(sources, lambda x: x.page_number), pages), false) as match from {RESPONSES} join (select document_id, list(distinct page_number) as pages from {PAGES} where ocr_used group by 1) using (document_id)""",
        "stream_event_windows": "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by all",
        "stream_sessions": """select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as session_start, count(*) as events from (select user_id, ts, sum(new) over (partition by user_id order by ts) as n from (
            select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hours, true)::int as new from events)) group by user_id, n""",
    }
