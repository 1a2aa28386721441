"""SQL of the training-data queries, where SQL can express them."""

from __future__ import annotations

from vellumine.plans.oracles import TOKEN

_COUNTED = f"select doc_id, source, len(regexp_extract_all(text, '{TOKEN}')) as n from documents where text is not null"


def _canonical(x: str) -> str:
    """A text without what only formats it.  Signs between two digits are kept by marking them first (twice, as they may share digits)."""
    t = f"replace(lower(regexp_replace({x}, '[\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{115F}}\\x{{1160}}\\x{{17B4}}\\x{{17B5}}\\x{{180B}}-\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]+', '', 'g')), 'ß', 'ss')"
    # each kept sign becomes \x01code\x02, so that the marks that are left can go
    kept = f"regexp_replace(regexp_replace({t}, '(\\p{{Nd}})(\\p{{P}})(\\p{{Nd}})', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), '(\\p{{Nd}})(\\p{{P}})(\\p{{Nd}})', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
    return f"regexp_replace(regexp_replace({kept}, '(' || chr(1) || '\\p{{P}}' || chr(2) || ')|[\\p{{P}}\\p{{Z}}\\s\\x{{85}}]+', '\\1', 'g'), '[' || chr(1) || chr(2) || ']', '', 'g')"


# A list of fields, by the statement of problem 7: parts between | or ;, each a label, a colon and a value; invisible characters are set aside before.
_SHOWN = "regexp_replace(text, '[\\x{AD}\\x{34F}\\x{61C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}]+', '', 'g')"
_PARTS = f"list_filter(regexp_split_to_array({_SHOWN}, '[|;]'), lambda p: regexp_matches(p, '[\\p{{L}}\\p{{N}}]'))"
_IS_LIST = f"len({_PARTS}) >= 2 and len(list_filter({_PARTS}, lambda p: not (contains(p, chr(58)) and regexp_matches(split_part(p, chr(58), 1), '\\p{{L}}') and regexp_matches(substr(p, instr(p, chr(58)) + 1), '[^\\s\\p{{Z}}\\p{{P}}]')))) = 0"
_FORM = f"case when {_IS_LIST} then '{{' || array_to_string(list_sort(list_transform({_PARTS}, lambda p: {_canonical('split_part(p, chr(58), 1)')} || chr(1) || {_canonical('substr(p, instr(p, chr(58)) + 1)')})), chr(2)) else {_canonical('text')} end"


# each page's site lines, as problem 3 states them
_SITE_LINES = """
    docs as (select source, count(distinct document_id) as n from pages where source is not null group by 1),
    lines as (select distinct document_id, page_number, source, unnest(l) as t, generate_subscripts(l, 1) as line_no
              from (select *, string_split(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\n]+', ' ', 'g'), chr(10)) as l from pages where source is not null)),
    site as (select distinct document_id, page_number, line_no from lines join (
              select source, trim(t) as t, count(distinct document_id) as c from lines where regexp_matches(t, '\\p{L}') group by all) k on k.source = lines.source and k.t = trim(lines.t)
              join docs on docs.source = lines.source where c >= 4 and c >= 0.2 * n)"""


def sql() -> dict[str, str]:
    return {
        "p1_found": "select distinct chunk_id from chunks where length(text) > 1800",
        "p2_found": """
            select document_id, cite_id from (
              select document_id, cite_id, row_number() over (partition by document_id order by support_score desc, cite_id) as place
              from (select distinct document_id, cite_id, support_score from citations)
              where document_id is not null and support_score is not null and not isnan(support_score))
            where place <= 3""",
        "p3_found": f"with {_SITE_LINES} select document_id, page_number, line_no from site",
        "p3_pages": f"""
            with {_SITE_LINES}, p as (select * from pages qualify row_number() over (partition by document_id, page_number) = 1),
            gone as (select document_id, page_number, list(line_no) as g from site group by all)
            select document_id, page_number, source, case when g is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(g, i)), chr(10)) end as text
            from p left join gone using (document_id, page_number)""",
        "p7_copies": f"""
            with c as (select distinct chunk_id as i, {_FORM} as f from chunks where text is not null) select min(i) as chunk_id, count(*) as copies from c group by f""",
        "p7_found": f"""
            with c as (select distinct chunk_id as i, {_FORM} as f from chunks where text is not null),
            s as (select distinct document_id as i, regexp_replace(lower(sha256), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as f from document_status where sha256 is not null)
            select 'chunks' as record_table, kept_id, i as copy_id from (select i, min(i) over (partition by f) as kept_id from c) where i != kept_id
            union all
            select 'document_status', kept_id, i from (select i, min(i) over (partition by f) as kept_id from s where f != '') where i != kept_id""",
        "p8_found": f"select profile, doc_id from ({_COUNTED}), pack_profiles where n > capacity_tokens",
        "p9_found": f"""
            with own as (select m.source, m.target_share, m.max_repeats, coalesce(sum(n), 0) as tokens
                         from mix_targets m left join ({_COUNTED}) d on d.source = m.source group by all)
            select source from own where max_repeats * tokens < target_share * (select sum(tokens) from own)""",
    }
