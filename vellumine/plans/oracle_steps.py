"""SQL of the steps that need more than one expression: chunking, retrieval with rescue, grounding, the limiter, evaluation."""

from __future__ import annotations

from vellumine.plans import oracle_values as V
from vellumine.plans.oracles import _DOCS, _LINES, _NUM, _SEP, _TF, _WORDS, ANSWERED, CHUNKS, PAGES, REQUESTS, RESPONSES, SP, TOKEN, bare, citation, collapse, corruption, count, disagreement, evaluation, lst, ordered_distinct, quality, retrieval, strip, terms_sql, tokens, topic

LATEST = "(select * from document_status where document_id is not null qualify row_number() over (partition by document_id order by regexp_replace(updated_at, '(Z|\\+00:00)$', '')::timestamp desc nulls last, status desc) = 1)"


def _label(x: str) -> str:
    return f"(lower({x}) in ({', '.join(repr(t) for t in V.TABLE_LABELS)}) or regexp_matches(lower({x}), '^fy{SP}+\\p{{Nd}}{{4}}[-–]\\p{{Nd}}{{2}}$|^march{SP}+31,?{SP}+\\p{{Nd}}{{4}}$'))"


def _heading(x: str) -> str:
    title = strip(f"regexp_extract({x}, '^\\p{{Nd}}+[.)]?{SP}+(.+)$', 1)")
    return f"""({x} != '' and not {_label(x)} and case when regexp_matches({x}, '^\\p{{Nd}}+[.)]?{SP}+.+$') then length({title}) >= 3 and not {_label(title)} and not regexp_matches({title}, '^[\\p{{Nd}},.\\-()₹`]+$')
        else regexp_matches({x}, '^[A-Z]\\.{SP}+[A-Za-z]') or (regexp_matches({x}, '[\\p{{Lu}}\\p{{Lt}}]') and not regexp_matches({x}, '\\p{{Ll}}') and len(string_split({x}, ' ')) <= 10 and length({x}) >= 4) end)"""


# lines, two-line headings, running section, body lines by section
_SECTIONS = f"""
    li as (select document_id, page_number, line_no, {strip(collapse('x'))} as x from {_LINES}),
    pa as (select *, lead(x) over w as after, coalesce(regexp_matches(x, '^\\p{{Nd}}+$') and regexp_matches(lead(x) over w, '^[A-Z]') and not {_label('lead(x) over w')} and len(string_split(lead(x) over w, ' ')) <= 12, false) as pair
           from li window w as (partition by document_id, page_number order by line_no)),
    ta as (select *, coalesce(lag(pair) over (partition by document_id, page_number order by line_no), false) as taken from pa),
    he as (select *, case when taken then null when pair then x || ' ' || after when {_heading('x')} then x end as heading from ta),
    se as (select *, sum((heading is not null)::int) over w as part, coalesce(last_value(heading ignore nulls) over w, 'General') as section from he
           window w as (partition by document_id, page_number order by line_no rows between unbounded preceding and current row)),
    sections as (select document_id, page_number, row_number() over (partition by document_id, page_number order by part) as section_index, section, list(x order by line_no) as paras
           from se where heading is null and not taken and x != '' group by document_id, page_number, part, section)"""
# paragraphs one by one: what is held, its size, the chunks that are done
_CHUNKED = f"""with recursive {_SECTIONS},
    r as (select document_id, page_number, section, section_index, paras, 0 as k, []::varchar[] as held, 0 as size, []::varchar[] as done from sections
      union all
      select document_id, page_number, section, section_index, paras, k + 1,
        case when length(p) > 1800 then [] when len(held) = 0 then [p] when size + 1 + length(p) <= 1800 then held || [p] else carry || [p] end,
        case when length(p) > 1800 then 0 when len(held) = 0 then length(p) when size + 1 + length(p) <= 1800 then size + 1 + length(p) else list_sum(list_transform(carry || [p], lambda v: length(v) + 1))::int end,
        case when length(p) > 1800 then done || (case when len(held) > 0 then [array_to_string(held, chr(10))] else [] end) || list_filter(list_transform(range(0, length(p), 1800), lambda a: {strip('substr(p, a::int + 1, 1800)')}), lambda v: v != '')
             when len(held) = 0 or size + 1 + length(p) <= 1800 then done else done || [array_to_string(held, chr(10))] end
      from (select *, paras[k + 1] as p, list_filter(held, lambda v, i: list_sum(list_transform(held[i:], lambda u: length(u) + 1)) <= 300) as carry from r where k < len(paras))),
    chunked as (select document_id, page_number, section, section_index, unnest(texts) as text, generate_subscripts(texts, 1) as chunk_index
      from (select *, done || (case when len(held) > 0 then [array_to_string(held, chr(10))] else [] end) as texts from r where k = len(paras)))"""
_CHUNK_ID = "document_id || '_p' || page_number || '_s' || section_index || '_c' || chunk_index"


def _numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{_SEP}({_NUM})', 1), lambda n: trim(n))"


def _bare(n: str) -> str:
    return f"regexp_replace(regexp_replace({n}, '[₹,%]|{SP}', '', 'g'), '(?i)(lakhs?|crores?|million|billion)$', '')"


def _counts(n: str) -> str:
    d = f"try_cast({_bare(n)} as double)"
    return f"({d} is not null and not ({d} = floor({d}) and ({d} between 1 and 31 or {d} between 1900 and 2100)))"


def _answer_numbers(x: str) -> str:
    return f"list_filter({_numbers(x)}, lambda n: {_counts('n')})"


def _names(x: str) -> str:
    phrases = f"list_filter(regexp_extract_all(coalesce({x}, ''), '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])([A-Z][A-Za-z]*(?:\\s+[A-Z][A-Za-z]*){{1,7}})(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 1), lambda p: length(p) >= 4)"
    both = f"(list_filter({lst(V.KNOWN_NAMES)}, lambda n: contains({citation(x)}, n)) || list_transform({phrases}, lambda p: {citation('p')}))"
    return ordered_distinct(both)


# the answers' stored sources with their chunks
_EVIDENCE = f"""(select request_id as query_id, chunk_id as id, query, answer, c.document_id, c.source, c.page_number, c.section, c.text from (
    select distinct a.request_id, r.query, a.answer, a.chunk_id from (select request_id, answer, unnest(list_transform(sources, lambda x: x.chunk_id)) as chunk_id from {RESPONSES} where answer is not null) a join {REQUESTS} r using (request_id))
    join {CHUNKS} c using (chunk_id))"""


def _exact(term: str, token: str) -> str:
    """Score of a word by equality and containment."""
    a, b = f"length({term})", f"length({token})"
    return f"case when {a} = 0 or {b} = 0 then 0.0 when {term} = {token} then 1.0 when contains({token}, {term}) or contains({term}, {token}) then least({a}, {b}) / greatest({a}, {b}) else 0.0 end"


def _grounded(least: float, threshold: float) -> str:
    """(query_id, numbers_known, term_support, grounded) of the answers in their sources, by equal and contained words."""
    return f"""(with e as (select query_id, answer, {retrieval("coalesce(text, '')")} as t from {_EVIDENCE}),
        a as (select distinct query_id, answer from e where {strip('answer')} != ''),
        cn as (select distinct query_id, {_bare('b')} as b from (select query_id, unnest({_numbers('t')}) as b from e where t != '')),
        miss as (select distinct query_id from (select query_id, {_bare('b')} as b from (select query_id, unnest({_answer_numbers('answer')}) as b from a)) where (query_id, b) not in (select (query_id, b) from cn)),
        terms as (select distinct query_id, term from (select query_id, unnest({topic('answer', [*V.STOPWORDS, *V.UNITS])}) as term from a) where term != ''),
        toks as (select distinct query_id, {bare('k')} as token from (select query_id, unnest({tokens('t')}) as k from e where t != '')),
        hits as (select distinct query_id, term from terms join toks using (query_id) where token != '' and {_exact('term', 'token')} >= {threshold}),
        sup as (select query_id, count(h.term) / count(*) as s from terms left join hits h using (query_id, term) group by 1)
        select a.query_id, miss.query_id is null as numbers_known, round(coalesce(s, 1.0), 6) as term_support,
            a.query_id in (select query_id from e where t != '') and miss.query_id is null and coalesce(s, 1.0) >= {least} as grounded
        from a left join miss using (query_id) left join sup using (query_id))"""


_ROUTE = "case when " + " or ".join(f"regexp_matches(lower(coalesce(query, '')), '{p}')" for p in V.ARITHMETIC) + " then 'calculator' else 'retrieval' end"
_VALIDATOR = "regexp_replace(translate(lower({}), '₹%,', ''), 'lakhs|lakh|crores|crore|million|billion', '', 'g')"


_SOME = f"(select * from {REQUESTS} where request_id % 20 = 0)"  # what some queries ask with, where others ask with all


def _rescue(by: str = "") -> str:
    """Evidence rescue by equal and contained words; with `by`, within each query's own document."""
    asked = f"(select request_id, query, document_id from {REQUESTS} where request_id % 20 = 0 and document_id is not null)" if by else REQUESTS
    own = "and q.document_id = f.document_id" if by else ""
    return f"""(with q as (select request_id as query_id, document_id, terms from ({terms_sql(asked, 'request_id, document_id', 'query')}) where len(terms) > 0),
        qt as (select query_id, document_id, unnest(terms) as term, len(terms) as n from q),
        f as (select distinct chunk_id as id, document_id, field, {bare('k')} as token from (
            select chunk_id, document_id, 'doc' as field, unnest({tokens(retrieval("coalesce(text, '')"))}) as k from {CHUNKS}
            union all select chunk_id, document_id, 'section', unnest({tokens(retrieval("coalesce(section, '')"))}) from {CHUNKS})),
        voc as (select distinct token from f where token != ''),
        m as (select term, token, {_exact('term', 'token')} as s, length(term) >= 5 and contains(token, term) as held from (select distinct term from qt), voc),
        h as (select distinct q.query_id, f.id, f.field, q.term, q.n from qt q join m on m.term = q.term and (m.s >= 0.70) join f on f.token = m.token {own}
              union select distinct q.query_id, f.id, 'phrase', q.term, q.n from qt q join m on m.term = q.term and m.held join f on f.token = m.token and f.field = 'doc' {own}),
        o as (select query_id, id, any_value(n) as n, coalesce(sum(1.0::double / n) filter (field = 'doc'), 0) as d, coalesce(sum(1.0::double / n) filter (field = 'section'), 0) as s, coalesce(sum(1.0::double / n) filter (field = 'phrase'), 0) as p from h group by 1, 2),
        sc as (select *, round(greatest(d, s, p) * 100 + s * 20 + p * 15, 9) as score from o where greatest(d, s, p) >= case when n >= 2 then 0.55 else 0.70 end - 1e-12)
        select query_id, id, score, array_to_string(list_filter(['term_overlap:' || printf('%.2f', d), case when s > 0 then 'section_overlap:' || printf('%.2f', s) end, case when p > 0 then 'phrase_overlap:' || printf('%.2f', p) end], lambda v: v is not null), '; ') as matches,
            row_number() over (partition by query_id order by score desc, id) as rank from sc qualify rank <= 10)"""


def _asked(some: bool) -> str:
    return f"(select request_id as query_id, {tokens('query')} as toks from {REQUESTS}{' where request_id % 20 = 0' if some else ''})"


def _bm25(some: bool = False) -> str:
    return f"""(with q as (select query_id, token, count(*) as times from (select query_id, unnest(toks) as token from {_asked(some)}) group by all), dl as (select chunk_id, coalesce({count('t', TOKEN)}, 0) as dl from {_DOCS}),
    s as (select query_id, chunk_id as id, round(sum(times * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / (select avg(dl) from dl)))), 9) as s from q join {_WORDS} using (token) join {_TF} using (token) join dl using (chunk_id) group by all)
    select query_id, id, s, row_number() over (partition by query_id order by s desc, id) as rank from s qualify rank <= 15)"""


# the same within each document, by its own counts
_BM25_BY = f"""(with q as (select query_id, document_id, token, count(*) as times from (select request_id as query_id, document_id, unnest({tokens('query')}) as token from {REQUESTS} where request_id % 20 = 0 and document_id is not null) group by all),
    c as (select d.chunk_id, document_id, t from {_DOCS} d join {CHUNKS} using (chunk_id)),
    dl as (select chunk_id, document_id, coalesce({count('t', TOKEN)}, 0) as dl from c), w as (select document_id, count(*) as n, avg(dl) as avgdl from dl group by 1),
    tf as (select chunk_id, document_id, token, count(*) as f from (select chunk_id, document_id, unnest(regexp_extract_all(t, '{TOKEN}')) as token from c) group by all),
    raw as (select document_id, token, ln(n - df + 0.5) - ln(df + 0.5) as idf from (select document_id, token, count(*) as df from tf group by all) join w using (document_id)),
    idf as (select document_id, token, case when idf < 0 then 0.25 * avg(idf) over (partition by document_id) else idf end as idf from raw),
    s as (select query_id, chunk_id as id, round(sum(times * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as s from q join idf using (document_id, token) join tf using (document_id, token) join dl using (document_id, chunk_id) join w using (document_id) group by all)
    select query_id, id, s, row_number() over (partition by query_id order by s desc, id) as rank from s qualify rank <= 15)"""


def _hashed(x: str, keys: str, table: str) -> str:
    """(keys, b, v): the stand-in encoder's vector, its filled places only."""
    return f"""(select {keys}, b, n / sqrt(sum(n * n) over (partition by {keys})) as v from (select {keys}, ('0x' || substr(md5(k), 1, 4))::int % 64 as b, count(*)::double as n from (select {keys}, unnest({tokens(x)}) as k from {table}) group by all))"""


# both vectors have length 1, so the distance is 2 - 2 x their product; texts without a token have none
def _vectors(some: bool = False) -> str:
    return f"""(with q as {_hashed('query', 'request_id', _SOME if some else REQUESTS)}, c as {_hashed('text', 'chunk_id', CHUNKS)},
    p as (select request_id as query_id, chunk_id as id, sum(q.v * c.v) as dot from q join c using (b) group by all),
    a as (select query_id, id, 2 - 2 * coalesce(dot, 0) as distance from (select distinct request_id as query_id from q) cross join (select distinct chunk_id as id from c) left join p using (query_id, id))
    select query_id, id, distance, row_number() over (partition by query_id order by round(distance, 12), id) as rank from a qualify rank <= 15)"""


_FUSED = f"""(select query_id, id, (coalesce(1.0 / (60 + max(vr)), 0)::double + coalesce(1.0 / (60 + max(br)), 0)::double) as rrf, max(vr) as vector_rank, max(br) as bm25_rank
    from (select query_id, id, rank as vr, null as br from {_vectors()} union all select query_id, id, null, rank from {_bm25()}) group by query_id, id qualify row_number() over (partition by query_id order by rrf desc, id) <= 15)"""


def _merged(first: str, value: str, rescue: str, ranks: tuple[str, ...] = ()) -> str:
    """(query_id, id, rescue, other, matches, rank, and the first list's ranks) of a list with its value and the rescued chunks."""
    kept, none, most = (", ".join(["", *[x.format(r) for r in ranks]]) for x in ("{}", "null", "max({0}) as {0}"))
    return f"""(select query_id, id, max(score) as rescue, max(other) as other, coalesce(max(matches), '') as matches{most}, row_number() over (partition by query_id order by coalesce(max(score), 0) desc, coalesce(max(other), 0) desc, id) as rank
        from (select query_id, id, {value} as other, null as score, null as matches{kept} from {first} union all select query_id, id, null, score, matches{none} from {rescue}) group by query_id, id qualify rank <= 15)"""


_HYBRID = f"(select *, other as rrf from {_merged(_FUSED, 'rrf', _rescue(), ('vector_rank', 'bm25_rank'))})"


def _expected(some: bool) -> str:
    return f"(select request_id as query_id, list(distinct page_number) as pages from (select request_id, unnest(list_transform(sources, lambda x: x.page_number)) as page_number from {RESPONSES} where request_id in (select query_id from {_asked(some)})) where page_number is not null group by 1)"


_LIGHT = _merged(_bm25(), "s", _rescue())
# the candidates with their evidence, reranked (rank 1 to 12) or not (null)
_RERANKED = f"""cand as (select l.query_id, l.id, coalesce(l.rescue, 0) as rescue, coalesce(l.other, 0) as score, r.query, c.section, c.text from {_LIGHT} l join {REQUESTS} r on r.request_id = l.query_id join {CHUNKS} c on c.chunk_id = l.id),
    ct as (select query_id, id, unnest(terms) as term, len(terms) as n from ({terms_sql('cand', 'query_id, id', 'query')})),
    ck as (select distinct query_id, id, field, {bare('k')} as token from (select query_id, id, 'doc' as field, unnest({tokens(retrieval("coalesce(text, '')"))}) as k from cand union all select query_id, id, 'section', unnest({tokens(retrieval("coalesce(section, '')"))}) from cand)),
    hit as (select distinct query_id, id, field, term, n from ct join ck using (query_id, id) where token != '' and {_exact('term', 'token')} >= 0.65),
    ov as (select query_id, id, coalesce(sum(1.0::double / n) filter (field = 'doc'), 0) as d, coalesce(sum(1.0::double / n) filter (field = 'section'), 0) as s from hit group by 1, 2),
    ph as (select query_id, id, sum(case when length(term) >= 5 and contains({retrieval("coalesce(text, '')")}, term) then 1.0::double / n else 0 end) as p from ct join cand using (query_id, id) group by 1, 2),
    feat as (select *, round(least(1.0, greatest(d, s, p)), 9) as evidence, coalesce(list_sum(list_transform({topic('query', V.STOPWORDS)}, lambda t: case when list_contains({tokens(retrieval("coalesce(section, '')"))}, t) then 3.0 when list_contains({tokens(retrieval("coalesce(text, '')"))}, t) then 1.0 else 0.0 end)), 0.0)::double as lexical
      from (select cand.*, coalesce(d, 0)::double as d, coalesce(s, 0)::double as s, coalesce(p, 0)::double as p from cand left join ov using (query_id, id) left join ph using (query_id, id))),
    norm as (select *, evidence >= 0.65 as exact, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) when max(score) over w > 0 then 1.0 else 0.0 end as rn,
      case when max(lexical) over w > min(lexical) over w then (lexical - min(lexical) over w) / (max(lexical) over w - min(lexical) over w) when max(lexical) over w > 0 then 1.0 else 0.0 end as ln from feat window w as (partition by query_id)),
    fin as (select *, round(0.35 * rn + 0.20 * ln + 0.30 * evidence + 0.10 * least(rescue / 200, 1.0) + case when exact then 0.5 else 0.0 end, 9) as final from norm),
    rer as (select *, row_number() over (partition by query_id order by exact desc, final desc, evidence desc, score desc, id) as rank from fin)"""
# the reranked first, and the others with no final score and no norms of their own; exact ones count 0.90 at least
_CONTEXT = f"""{_RERANKED}, pro as (select query_id, id, d, s, p, evidence, exact, rescue, case when rank <= 12 then score else 0 end as score, case when rank <= 12 then rn else 0 end as rn, case when rank <= 12 then ln else 0 end as ln, case when rank <= 12 then final else 0 end as final from rer),
    pr2 as (select *, case when exact then greatest(final, 0.90) else final end as f2 from pro), pr3 as (select *, row_number() over (partition by query_id order by exact desc, f2 desc, evidence desc, score desc, id) as k from pr2),
    rel as (select *, round(0.55 * evidence + 0.10 * s + 0.10 * p + 0.08 * ln + 0.10 * rn + 0.05 * least(rescue / 100, 1.0), 9) as relevance from pr3 where k <= 12 and (evidence >= 0.30 or rescue > 0 or exact)),
    bst as (select *, max(relevance) over (partition by query_id) as best from rel),
    con as (select *, row_number() over (partition by query_id order by relevance desc, evidence desc, exact desc, rn desc, ln desc, id) as rank from bst where relevance >= greatest(0.18, 0.35 * best))"""


def _recall(found: str, some: bool = False) -> str:
    return f"""(select count(*) as questions, sum(hit)::bigint as hits, round(avg(hit), 6) as recall from (select coalesce(list_has_any(pages, found), false)::int as hit from {_expected(some)}
        left join (select query_id, list(distinct page_number) as found from {found} f join {CHUNKS} c on c.chunk_id = f.id where rank <= 10 group by 1) using (query_id)))"""


def _floats(x: str) -> str:
    return f"list_transform(regexp_extract_all(replace(coalesce({x}, ''), ',', ''), '\\p{{Nd}}+\\.\\p{{Nd}}+|\\p{{Nd}}+'), lambda v: v::double)"


# each expected number uses up the first answer number within the tolerance
_MATCHED = f"""with recursive n as (select request_id, {_floats('query')} as wanted, {_floats('answer')} as given from {ANSWERED}),
    r as (select request_id, wanted, given as spare, 0 as k, true as ok from n
      union all select request_id, wanted, case when pos > 0 then spare[:pos - 1] || spare[pos + 1:] else spare end, k + 1, ok and pos > 0
      from (select *, coalesce(list_position(list_transform(spare, lambda v: abs(v - wanted[k + 1]) <= 0.01), true), 0) as pos from r where k < len(wanted))),
    m as (select r.request_id, case when len(r.wanted) = 0 then null when len(given) = 0 then false else ok end as "match" from r join n using (request_id) where k = len(r.wanted))"""
_TEXT_MATCH = f"""(case when {evaluation('query')} = '' then null else contains({evaluation('answer')}, {evaluation('query')}) or (len(parts) > 0 and len(list_filter(parts, lambda p: not contains({evaluation('answer')}, p))) = 0) end)"""
_PARTS = f"list_filter(list_transform(regexp_split_to_array({evaluation('query')}, '[;|]'), lambda p: {strip('p')}), lambda p: p != '')"
# calls of a client one by one, with the times admitted so far
_LIMITED = f"""with recursive c as (select request_id, coalesce(nullif(client, ''), 'unknown') as client, epoch(requested_at) as s, row_number() over (partition by coalesce(nullif(client, ''), 'unknown') order by requested_at, request_id) as n from {REQUESTS}),
    r as (select client, 0::bigint as n, []::double[] as held, null::bigint as request_id, false as allowed from (select distinct client from c)
      union all select client, n, case when len(kept) < 3 then kept || [s] else kept end, request_id, len(kept) < 3
      from (select c.client, c.n, c.s, c.request_id, list_filter(r.held, lambda h: h > c.s - 3600) as kept from r join c on c.client = r.client and c.n = r.n + 1))"""


def _cleaned(x: str) -> str:
    """A parsed page's text; of the composed characters only the fixed blank is spelled out, the only one the tables hold."""
    return strip(f"regexp_replace(regexp_replace(translate(replace(coalesce({x}, ''), chr(160), ' '), '{V.ZERO_WIDTH}', ''), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', '\n\n', 'g')")


def _detected(t: str) -> str:
    t = f"translate({t}, '{V.ZERO_WIDTH}', '')"
    dev, lat, letters = (f"{count(t, p)}" for p in ("[\\x{900}-\\x{97F}]", "\\p{Latin}", "\\p{L}"))
    mar, hin = (f"len(list_intersect(list_distinct(regexp_extract_all({t}, '[\\x{{900}}-\\x{{97F}}]+')), {lst(h)}))" for h in (V.MARATHI_HINTS, V.HINDI_HINTS))
    devanagari = f"case when {mar} > {hin} then 'mar' when {hin} > {mar} then 'hin' when regexp_matches({t}, '[{V.MARATHI_LETTERS}]') then 'mar' else 'hin' end"
    return f"""case when {strip(t)} = '' then 'unknown' when {dev} / greatest(1, {letters}) < 0.15 and {lat} / greatest(1, {letters}) >= 0.5 then 'eng'
        when {dev} / greatest(1, {letters}) >= 0.5 then {devanagari} when {dev} > 0 and {lat} > 0 then 'mixed' else 'unknown' end"""


def _extracted(raw: str, scan: str) -> str:
    """(keys, method, used, chosen) of pages: whether a scan is needed, which text is better, what is adopted."""
    flat = strip(collapse("raw"))
    return f"""(select *, case when used and raw = '' then 'scan' when used then 'native+scan' when raw != '' then 'native' else 'none' end as method, case when used then better else raw end as chosen from (
        select *, needs and scan != '' and better != raw as used from (select *, length({flat}) < 80 or (coalesce(image_count, 0) > 0 and (length({flat}) < 900 or rq < 0.42)) as needs,
          case when raw = '' then scan when scan = '' then raw when sq >= rq + 0.06 then scan when length({strip('raw')}) < 80 and length({strip('scan')}) > length({strip('raw')}) then scan else raw end as better
          from (select *, {quality('raw')} as rq, {quality('scan')} as sq from (select page_id, document_id, page_number, image_count, {raw} as raw, {scan} as scan from {PAGES})))))"""


def sql() -> dict[str, str]:
    clean = strip(f"regexp_replace(regexp_replace(translate(replace(coalesce(text, ''), chr(160), ' '), '{V.ZERO_WIDTH}', ''), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', '\n\n', 'g')")
    flat = strip(collapse("coalesce(text, '')"))
    ends = f"len(regexp_extract_all({flat}, '[.!?]{SP}+'))"
    text, other = strip("coalesce(text, '')"), strip("coalesce(ocr_text, '')")
    expr = r"(?:^|[^A-Za-z0-9_.])(-?\p{Nd}+(?:\.\p{Nd}+)?(?:\s*[+\-*/^]\s*-?\p{Nd}+(?:\.\p{Nd}+)?)+)(?:$|[^A-Za-z0-9_.])"
    turns = f"(select request_id as query_id, conversation_id, request_id as turn, query, {strip('query')} as content from {REQUESTS} where conversation_id is not null)"
    year = "coalesce(nullif(regexp_extract(topic, '(?i)\\bFY\\s*(\\d{4})[-/]\\d{2}\\b', 1), ''), nullif(regexp_extract(topic, '\\b(\\d{4})[-/]\\d{2}\\b', 1), ''))::int"
    fy = f"('FY ' || ({year} - 1) || '-' || right(({year})::varchar, 2))"

    def of(subject: str, value: str) -> str:
        return f"when contains(lower(topic), 'total {subject}') then {value}"

    flat_number = f"regexp_replace({citation('text')}, '[₹,%]|{SP}', '', 'g')"
    words3 = "list_distinct(list_filter(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-zA-Z]{{3,}}$')))"
    return {
        "clean_text": f"select page_id, md5({clean}) as digest from {PAGES} where text is not null",
        "clean_unicode": f"select page_id, length({clean}) as characters from {PAGES}",
        "clean_scan": f"select page_id, md5({strip('''regexp_replace(regexp_replace(replace(text, chr(12), ''), '[ \\t]+', ' ', 'g'), '\\n{3,}', '\n\n', 'g')''')}) as digest from {PAGES} where text is not null",
        "number_lines": f"""select document_id, page_number, count(*) as "numeric", sum(regexp_matches(x, '^(?:19|20)\\p{{Nd}}{{2}}$')::int)::bigint as years, sum((regexp_matches(lower(x), '\\b\\p{{Nd}}{{1,2}}(?:{SP}|[/-])+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*(?:{SP}|[,/-])+\\p{{Nd}}{{4}}\\b')
            or regexp_matches(lower(x), '\\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*(?:{SP}|-)+\\p{{Nd}}{{1,2}}(?:{SP}|[,/-])+\\p{{Nd}}{{4}}\\b'))::int)::bigint as dates
            from (select document_id, page_number, {strip(collapse('x'))} as x from {_LINES}) where regexp_matches(x, '\\p{{Nd}}') group by all""",
        "page_summary": f"""select document_id, count(*) as pages, sum(coalesce(ocr_used, false)::int)::bigint as ocr_used, sum(coalesce(denoised, false)::int)::bigint as denoised, round(coalesce(avg(ocr_confidence) filter (ocr_confidence >= 0), -1.0), 4) as confidence,
            sum(length(text))::bigint as characters, coalesce(string_agg(distinct language, ',' order by language), '') as languages from {PAGES} group by 1""",
        "denoised_pages": f"""select page_id, false as denoised, round(case when long then ratio else short_ratio end, 6) as ratio, case when long then apart else 0.0 end as disagreement,
            case when long and (ratio >= 0.08 or coalesce(c >= 0 and c < 55, false) or coalesce(ocr_used and apart >= 0.45 and c < 65, false)) then 'no restorer is configured' end as error, md5(cur) as digest
            from (select page_id, cur, ocr_used, ocr_confidence as c, length(cur) >= 80 as long, {corruption('cur')} as ratio, {corruption('cur')} as short_ratio, {disagreement('cur', 'alt')} as apart from (
              select page_id, ocr_used, ocr_confidence, case when {text} != '' then {text} else {other} end as cur, {other} as alt from {PAGES}))""",
        "extracted": f"select page_id, method, used, {_detected('chosen')} as detected, length(chosen) as characters from {_extracted("coalesce(raw_text, '')", "coalesce(ocr_text, '')")}",
        "parsed_pages": f"""select document_id, page_number, {_detected('final')} as language, method as extraction_method, used as ocr_used, length(final) as text_length, length(raw) as raw_text_length, false as denoised from (
            select *, array_to_string(list_filter(string_split(kept, chr(10)), lambda x: not list_contains(['For and on behalf of the Board', 'This page is left blank on purpose.'], {strip('x')})), chr(10)) as final
            from (select *, case when {strip('chosen')} != '' then {strip('chosen')} else {strip('scan')} end as kept from {_extracted(_cleaned('raw_text'), _cleaned('ocr_text'))}))""",
        "answer_numbers": f"select request_id, array_to_string(list_transform({_answer_numbers('answer')}, lambda n: {_bare('n')}), '|') as numbers from {RESPONSES} where answer is not null",
        "answer_names": f"select request_id, array_to_string({_names('answer')}, '|') as names from {RESPONSES} where answer is not null",
        "sections": f"with {_SECTIONS} select document_id, page_number, section_index, section, length(array_to_string(paras, chr(10))) as characters from sections",
        "chunk_rows": f"{_CHUNKED} select {_CHUNK_ID} as chunk_id, document_id, page_number, section, section_index, chunk_index, length(text) as characters from chunked",
        "stream_ingest": f"{_CHUNKED} select {_CHUNK_ID} as chunk_id, document_id, section, length(text) as characters from chunked",
        "sentence_windows": f"select chunk_id, case when {flat} = '' then 0 when {ends} = 0 and length({flat}) > 320 then (len(string_split({flat}, ' ')) - 1) // 22 + 1 else {ends} + 1 end as parts from {CHUNKS}",
        "answer_support": f"""select query_id, id, n as numbers, m as names, round(n * 1000.0 + m * 100.0 + case when n + m > 0 then 500.0 else 0.0 end + 0.001 * case when len(qw) = 0 then 0.0 else len(list_intersect(qw, tw)) / len(qw) end, 6) as score
            from (select query_id, id, len(list_distinct(list_filter({_answer_numbers('answer')}, lambda v: {_bare('v')} != '' and contains({flat_number}, {_bare('v')})))) as n, len(list_filter({_names('answer')}, lambda v: contains({citation('text')}, v))) as m,
            {words3.format(citation('query'))} as qw, {words3.format(citation('text'))} as tw from {_EVIDENCE})""",
        "evidence_rescue_exact": f"select query_id, id, round(score, 4) as score, matches, rank from {_rescue()}",
        "text_vectors": f"select query_id, id, round(distance, 6) as distance, rank from {_vectors(some=True)}",
        "hybrid_full": f"select query_id, id, round(rescue, 4) as rescue, round(rrf, 9) as rrf, vector_rank, bm25_rank, matches, rank from {_HYBRID}",
        "hybrid_by_document": f"select query_id, id, round(rescue, 4) as rescue, round(other, 4) as bm25, rank from {_merged(_BM25_BY, 's', _rescue('document_id'))}",
        "reranked_exact": f"with {_RERANKED} select query_id, id, round(final, 4) as score, exact, rank from rer where rank <= 12",
        "context_rows_exact": f"with {_CONTEXT} select query_id, id, round(relevance, 6) as relevance, rank from con where rank <= 5",
        "dedupe_results": f"""select request_id as query_id, (i - 1)::int as rank, x.chunk_id as id from (select request_id, unnest(sources) as x, generate_subscripts(sources, 1) as i from {RESPONSES})
            qualify row_number() over (partition by request_id, coalesce(x.document_id, ''), x.chunk_id, case when coalesce(x.chunk_id, '') = '' then (x.page_number, x.section) end order by i) = 1""",
        "reranker_order": f"""select query_id, id, round(w, 6) as score, shown, row_number() over (partition by query_id order by w desc, id) as rank from (select query_id, id, least(0.35 * list_sum(list_transform({lst(V.PHRASES)}, lambda p: case when contains({strip(collapse("lower(coalesce(query, ''))"))}, p)
              and contains({strip(collapse("lower(coalesce(section, ''))"))} || ' ' || {strip(collapse("lower(coalesce(text, ''))"))}, p) then map({lst(V.PHRASES)}, {list(V.PHRASES.values())})[p] else 0.0 end)), 5.0) as w,
            md5('Section: ' || coalesce(section, '') || chr(10) || 'Source: ' || coalesce(source, '') || chr(10) || 'Page: ' || coalesce(page_number::varchar, '') || chr(10) || 'Content: ' || {strip("coalesce(text, '')")}) as shown from {_EVIDENCE}) qualify rank <= 10""",
        "grounded_answers_exact": f"select * from {_grounded(0.25, 0.65)}",
        "validated_answers_exact": f"""with g as (select query_id, grounded from {_grounded(0.40, 0.82)}), e as (select query_id, answer, text from {_EVIDENCE}), res as (select query_id, count(*) as n from e group by 1),
            a as (select request_id as query_id, answer, {_ROUTE} as route from {ANSWERED}), wn as (select query_id, {strip(_VALIDATOR.format('v'))} as v from (select query_id, unnest({_answer_numbers('answer')}) as v from a)),
            cn as (select distinct query_id, {strip(_VALIDATOR.format('v'))} as v from (select query_id, unnest({_numbers("coalesce(text, '')")}) as v from e)), miss as (select distinct query_id from wn where (query_id, v) not in (select (query_id, v) from cn)),
            x as (select query_id, case when {strip("coalesce(answer, '')")} = '' then 'Missing answer.' when coalesce(n, 0) = 0 then 'Missing grounding evidence.' when route = 'calculator' and not regexp_matches({strip("coalesce(answer, '')")}, '^-?\\p{{Nd}}+(\\.\\p{{Nd}}+)?$') then 'Calculator answer is not numeric.'
              when route != 'calculator' and not (coalesce(grounded, false) or (query_id in (select query_id from wn) and query_id not in (select query_id from miss))) then 'Answer grounding validation failed.' else '' end as errors from a left join res using (query_id) left join g using (query_id))
            select query_id, errors = '' as validated, errors from x""",
        "calculations": f"""select request_id as query_id, case when e = '' or v is null then '' else format('{{:.10g}}', v) end as answer, case when e = '' then 'No supported arithmetic expression found.' when v is null then 'Unable to evaluate the calculation.' end as error
            from (select request_id, e, case op when '+' then a + b when '-' then a - b when '*' then a * b when '/' then case when b != 0 then a / b end when '^' then a ** b end as v
              from (select request_id, e, nullif(regexp_extract(e, '^(-?[\\d.]+)', 1), '')::double as a, regexp_extract(e, '^-?[\\d.]+\\s*([+*/^-])', 1) as op, nullif(regexp_extract(e, '^-?[\\d.]+\\s*[+*/^-]\\s*(-?[\\d.]+)$', 1), '')::double as b
                from (select request_id, regexp_extract(coalesce(query, ''), '{expr}', 1) as e from {REQUESTS})))""",
        "resolved_queries": f"""with t as {turns}, w as (select *, coalesce(last_value(case when regexp_matches(lower(content), 'total income|total expenditure') then content end ignore nulls) over o, last_value(nullif(content, '') ignore nulls) over o) as topic from t
              window o as (partition by conversation_id order by turn rows between unbounded preceding and 1 preceding))
            select query_id, coalesce(case when {year} is not null and regexp_matches(lower(content), '\\b(previous year|prior year|last year)\\b') then case {of('income', f"'What was the total income for ' || {fy} || '?'")} {of('expenditure', f"'What was the total expenditure for ' || {fy} || '?'")} else topic || ' for ' || {fy} end end,
              case when regexp_matches(lower(content), 'how much did it (increase|decrease)') then case {of('income', "'What was the change in total income between FY 2023-24 and FY 2024-25?'")} {of('expenditure', "'What was the change in total expenditure between FY 2023-24 and FY 2024-25?'")} end end,
              case when regexp_matches(lower(content), '\\b(and|also|what about)\\b') and contains(lower(content), 'consolidated') then case {of('income', "'What was the consolidated total income for FY 2024-25?'")} {of('expenditure', "'What was the consolidated total expenditure for FY 2024-25?'")} end end, query) as resolved from w""",
        "upload_outcomes": f"""with f as (select doc_id as upload_id, concat_ws(' ', source, section) as name, case when coalesce(text, '') != '' then '%PDF-' || text else text end as c from documents),
            g as (select *, case when name = '' then 'no filename' when coalesce(octet_length(encode(c)), 0) = 0 then 'empty' when octet_length(encode(c)) > 26214400 then 'too large' end as error, sha256(c) as h from f),
            n as (select *, {strip("list_extract(string_split(replace(name, chr(92), '/'), '/'), -1)")} as base from g), s as (select *, regexp_replace(regexp_replace(base, '[^A-Za-z0-9._()\\- ]+', '_', 'g'), ' +', ' ', 'g') as safe from n)
            select upload_id, left(case when safe = '' then 'document.pdf' when lower(safe) like '%.pdf' then safe else safe || '.pdf' end, 180) as filename, h as sha256, octet_length(encode(c)) as size_bytes, case when error is null then 'processing' end as status,
            error is null and upload_id != min(upload_id) filter (error is null) over (partition by h) as duplicate, error from s""",
        "status_updates": f"""select coalesce(l.document_id, p.document_id) as document_id, case when l.document_id is null then '' else filename end as filename, case when p.document_id is not null then 'ready' else status end as status, coalesce(p.n, page_count, 0)::int as page_count, coalesce(chunk_count, 0)::int as chunk_count,
            case when p.document_id is null then error end as error from {LATEST} l full join (select document_id, count(*) as n from {PAGES} group by 1) p on p.document_id = l.document_id""",
        "retry_outcomes": f"""select document_id, case when status is null then 'not found' when status != 'failed' then 'not failed' when coalesce(storage_filename, '') = '' or storage_filename not in (select storage_filename from {LATEST} where document_id in (select document_id from chunks where document_id is not null) and storage_filename is not null)
            then 'file missing' else 'processing' end as outcome from (select document_id from pages union select document_id from {LATEST}) left join {LATEST} using (document_id)""",
        "retrieval_recall": f"select * from {_recall(_bm25(some=True), some=True)}",
        "retrieval_comparison": " union all ".join(f"select '{n}' as method, * from {_recall(t)}" for n, t in (("vector", _vectors()), ("bm25", _bm25()), ("hybrid", _HYBRID))),
        "numbers_match": f'{_MATCHED} select request_id, "match"::varchar as "match" from m',
        "answer_match": f"""{_MATCHED}, p as (select *, {_PARTS} as parts from {ANSWERED} where query is not null), t as (select request_id, query, {_TEXT_MATCH} as text from p)
            select request_id, text, case when coalesce(query, '') = '' then null else coalesce("match", false) or coalesce(text, false) end as "match" from t join m using (request_id)""",
        "rate_limit_log": f"{_LIMITED} select request_id, allowed from r where request_id is not null",
        "stream_rate_limit": f"{_LIMITED} select client, request_id as ident, allowed from r where request_id is not null",
    }
