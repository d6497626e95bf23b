"""The SQL of the queries that SQL can express."""

_TERMS = r"""
with once as (select frame_id, any_value(evaluation.keywords) words from frames where frame_id is not null group by frame_id),
uses as (select frame_id, unnest(words) word from once),
cleaned as (select frame_id, lower(trim(regexp_replace(nfc_normalize(word), '\s+', ' ', 'g'))) term from uses),
terms as (
  select frame_id, term from cleaned
  where term <> '' and strlen(term) <= 30 and len(string_split(term, ' ')) <= 3 and not contains(term, '|') and not starts_with(term, 'cull:')),
counts as (select term, count(*) uses, count(distinct frame_id) frames from terms group by term),
total as (select count(distinct frame_id) n from terms),
marked as (
  select term, uses, frames, case when frames < 4 or uses < 6 then 'rare' when frames > 0.15 * n then 'common' end mark from counts, total)
"""

SQL = {
    "p1_found": _TERMS + "select term, mark from marked where mark is not null",
    "p1_terms": _TERMS + "select term, uses, frames, mark from marked",
}
