"""The SQL of the queries in shoots.py."""

from fotarium.plans.triage_sql import _BASE, _EFFECTIVE, _FOLD, _KEYWORDS, _ONCE, _PLANE, _RANKED, _round

_DIGEST = r"regexp_replace(lower(regexp_replace({x}, '[\s\x{{00A0}}]+', '', 'g')), '^sha-?256[:=]', '')"


def _digest(x: str) -> str:
    return f"case when regexp_matches({_DIGEST.format(x=x)}, '^[0-9a-f]{{64}}$') then {_DIGEST.format(x=x)} end"


def _once_each(items: str) -> str:
    """A list with each element once, in order."""
    return f"list_reduce(list_prepend(cast([] as varchar[]), list_transform({items}, lambda w: [w])), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end)"


_NOT_NULL = "list_filter({x}, lambda m: m is not null)"
_CAMERA = rf"""cam as (select *, string_split(file, '/')[-1] base, string_split(file, '/')[-2] folder from once where dir is not null and file is not null),
cam2 as (select *, coalesce(try_cast(regexp_extract(folder, '^([1-9]\d\d)[A-Za-z0-9_]{{5}}$', 1) as int), 0) fo,
  coalesce(try_cast(regexp_extract(regexp_replace(base, '\.[^.]*$', ''), '^[A-Za-z0-9_]{{4}}(\d{{4}})$', 1) as int), -1) co from cam),
cam3 as (select *, min(case when co >= 0 then fo end) over (partition by dir) least_fo from cam2),
camera as (select *, case when co >= 0 then 0 else 1 end k1, case when co >= 0 and least_fo > 0 then fo else 0 end k2, greatest(co, 0) k3, lower(base) k4 from cam3)"""
_ALL = (
    _EFFECTIVE
    + f""", shoot as (select dir d, min(project) project from shoots where dir is not null group by dir),
side0 as (select e.*, s.project, m2.ev hand_ev, case when evaluation.keywords is null then cast([] as varchar[]) else {_KEYWORDS} end k
  from effective e left join shoot s on e.dir = s.d left join marks m2 on e.dir = m2.dir and string_split(e.file, '/')[-1] = m2.file),
side1 as (select *, case when stars > 0 then stars end rating, case verdict when 'keep' then 'Green' when 'review' then 'Yellow' when 'cull' then 'Red' end color,
  {_once_each("list_concat(list_filter(['cull:' || verdict, case when by_hand then 'cull:labeled' end], lambda m: m is not null), list_concat(k, case when project <> '' then [project] else cast([] as varchar[]) end))")} subjects,
  {_once_each("list_concat(list_transform(k, lambda w: 'content|' || w), case when project <> '' then ['project|' || project] else cast([] as varchar[]) end)")} hierarchy,
  case when regexp_matches(exif.date_time_original, '^[0-9]{{4}}:[0-9]{{2}}:[0-9]{{2}} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$') and try_cast(replace(left(exif.date_time_original, 10), ':', '-') as date) is not null
    then replace(left(exif.date_time_original, 10), ':', '-') || 'T' || substr(exif.date_time_original, 12, 8) end taken,
  coalesce(hand_ev, case when evaluation is not null and verdict is distinct from 'cull' and evaluation.exposure.status = 'fixable' then evaluation.exposure.ev_adjust end) exposure from side0)"""
)
_ESC = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_HEAD = (
    '<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="fotarium">\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n<rdf:Description rdf:about=""'
    ' xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/" xmlns:lr="http://ns.adobe.com/lightroom/1.0/" xmlns:exif="http://ns.adobe.com/exif/1.0/" xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/"'
)


def _bag(tag: str, items: str) -> str:
    return f"case when len({items}) > 0 then '<{tag}><rdf:Bag>' || array_to_string(list_transform({items}, lambda s: '<rdf:li>' || {_ESC.format(x='s')} || '</rdf:li>'), '') || '</rdf:Bag></{tag}>' else '' end"


def _script(x: str) -> str:
    return f"""'"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"'"""


_PLAIN = r"regexp_replace(cast({x} as varchar), '\.0$', '')"
_HELD = "held as (select distinct lower(orig) o, size s from manifest where orig is not null and size is not null)"
_CARDS = "cards as (select * exclude (r) from (select *, row_number() over (partition by file_id order by loaded_at desc) r from card_files where file_id is not null) where r = 1)"
_FOLDED = """lines as (select distinct on (entry_id) * from manifest),
last as (select * from (select *, row_number() over (partition by lower(orig), size order by entry_id desc) back from lines) where back = 1)"""
_LINE = f"""{_FOLDED}, line as (select * from (select *, row_number() over (partition by dir, lower(orig) order by entry_id desc) b from last where orig is not null and dir is not null) where b = 1),
framed as (select o.*, l.entry_id, nullif(trim(l.dates_set), '') dates_set, l.src, l.orig, coalesce(nullif(trim(l.file_sha256), ''), l.sha256) h
  from once o left join line l on o.dir = l.dir and lower(string_split(o.file, '/')[-1]) = lower(l.orig) where o.file is not null)"""
_MOVED = "'/' || array_to_string(string_split(file, '/')[2:-2], '/') || '/{place}/' || string_split(file, '/')[-1]"
_WALL = rf"""{_CAMERA},
wp as (select *, regexp_extract(trim(exif.date_time_original), '^(\d{{4}})[-:/](\d\d)[-:/](\d\d)[T ](\d\d:\d\d:\d\d)(?:\.(\d+))?(?:Z|[+-]\d\d:?\d\d)?$', ['y', 'm', 'd', 't', 'own']) p from camera),
timed as (select * from (select *, case when p.y <> '' and p.y not in ('0000', '0001') then epoch_us(try_cast(p.y || '-' || p.m || '-' || p.d || ' ' || p.t as timestamp)) + cast(rpad(substr(case when regexp_matches(p.own, '^[0-9]+$') then p.own
  when regexp_matches(trim(exif.subsec), '^[0-9]+$') then trim(exif.subsec) else '' end, 1, 6), 6, '0') as bigint) end wall from wp) where wall is not null)"""
_FRAME_SETS = f"""with {_ONCE}, {_WALL}, o as (select *, lag(wall) over (partition by dir order by wall, frame_id) pw, row_number() over (partition by dir order by wall, frame_id) rn from timed),
l as (select *, case when wall - pw between 0 and 60000000 then 0 else 1 end brk from o), i as (select *, sum(brk) over (partition by dir order by rn rows unbounded preceding) isl from l),
ct as (select *, (row_number() over (partition by dir, isl order by rn) - 1) // 40 cut from i), sz as (select *, count(*) over (partition by dir, isl, cut) set_size from ct),
fsets as (select *, dense_rank() over (partition by dir order by isl, cut) set_id from sz where set_size > 1)"""
_LABELS = "case e.event_type when 'purchase' then 'keep' when 'click' then 'review' when 'view' then 'cull' end"
_LABELLED = _RANKED + f""", labelled as (select r.*, e.value, {_LABELS} as "label" from ranked r join events e on r.user_id = e.user_id and r.event_id = e.event_id)"""
_GRID = ", ".join(f"coalesce(sum(case when \"label\" = '{a}' and d = {i} then 1 end), 0) {a}_{b}" for a in ("keep", "review", "cull") for i, b in enumerate(("keep", "review", "cull")))

SQL = {
    "sidecar_rows": _ALL + " select frame_id, rating, color, array_to_string(subjects, '|') subjects, array_to_string(hierarchy, '|') hierarchy, taken, exposure from side1",
    "sidecar_texts": _ALL
    + f""" select frame_id, '{_HEAD}' || coalesce(' ' || nullif(concat_ws(' ', 'xmp:Rating="' || rating || '"', 'xmp:Label="' || color || '"', 'exif:DateTimeOriginal="' || taken || '"',
  'xmp:CreateDate="' || taken || '"', 'photoshop:DateCreated="' || taken || '"', case when exposure is not null then 'crs:HasSettings="True"' end, 'crs:Exposure2012="' || printf('%+.2f', exposure) || '"'), ''), '') || '>'
  || {_bag("dc:subject", "subjects")} || {_bag("lr:hierarchicalSubject", "hierarchy")} || '</rdf:Description>
</rdf:RDF>
</x:xmpmeta>
<?xpacket end="w"?>
' xmp from side1""",
    "script_rows": _ALL
    + f""" select frame_id, '-- ' || {_BASE} || ': ' || coalesce(verdict, '') || case when by_hand then ' (yours)' else ' (model)' end || chr(10)
  || 'repeat with v in matching images (' || {_script("coalesce(nullif(moved_to, ''), file)")} || ', ' || {_script(_BASE)} || ', ' || {_script(f"regexp_replace({_BASE}, '[.][^.]*$', '')")} || ')' || chr(10)
  || coalesce('set rating of v to ' || rating || chr(10), '') || coalesce('set color tag of v to ' || case verdict when 'keep' then 4 when 'review' then 3 when 'cull' then 1 end || chr(10), '')
  || array_to_string(list_transform(subjects, lambda s: 'apply keyword ' || {_script("s")} || ' to v' || chr(10)), '')
  || coalesce('set exposure of v to ' || {_PLAIN.format(x="hand_ev")} || chr(10), '')
  || coalesce(case when evaluation.exposure.status = 'fixable' and hand_ev is null then 'if exposure of v is 0 then set exposure of v to ' || {_PLAIN.format(x="evaluation.exposure.ev_adjust")} || chr(10) end, '')
  || 'end repeat' || chr(10) script from side1 where coalesce(error, '') = '' and (verdict is not null or rating is not null)""",
    "contact_sheet": _ALL
    + f""" select frame_id, '{{"id":' || frame_id || coalesce(',"name":' || to_json({_BASE}), '') || coalesce(',"path":' || to_json(file), '') || coalesce(',"verdict":' || to_json(verdict), '')
  || ',"by_hand":' || by_hand || ',"stars":' || stars || coalesce(',"error":' || to_json(nullif(error, '')), '') || coalesce(',"moved_to":' || to_json(nullif(moved_to, '')), '') || '}}' card from side1""",
    "move_plan": _EFFECTIVE
    + f""", m as (select frame_id, coalesce(nullif(moved_to, ''), file) source, case when verdict in ('keep', 'review', 'cull') then regexp_extract(file, '^(.*/)?([^/]*)$', 1) || verdict || '/' || {_BASE} else file end target from effective where coalesce(error, '') = '')
select * from m where target is not null and source is distinct from target""",
    "cull_moves": _EFFECTIVE
    + f""", m as (select frame_id, coalesce(nullif(moved_to, ''), file) source, case when verdict = 'cull' then regexp_extract(file, '^(.*/)?([^/]*)$', 1) || verdict || '/' || {_BASE} else file end target from effective where coalesce(error, '') = '')
select * from m where target is not null and source is distinct from target""",
    "restore_plan": f"with {_ONCE} select frame_id, moved_to source, file target from once where nullif(moved_to, '') is not null and file is not null",
    "manifest_frames": f"""with {_ONCE}, {_LINE} select frame_id, dates_set,
  case when entry_id is not null then concat_ws('/', case when len(string_split(src, '/')) > 1 then nullif(string_split(src, '/')[-2], '') end, coalesce(nullif(string_split(src, '/')[-1], ''), lower(orig))) end card_name, {_digest("h")} digest from framed""",
    "capture_days": rf"""with {_ONCE}, {_LINE}, d as (select frame_id, nullif(regexp_extract(replace(dates_set, '-', ''), '^(\d{{8}})', 1), '') own, nullif(regexp_extract(replace(exif.date_time_original, ':', ''), '^(\d{{8}})', 1), '') cam,
  nullif(replace(regexp_extract(dir, '(?:^|/)(\d{{4}}-\d{{2}}-\d{{2}})[^/]*$', 1), '-', ''), '') fold from framed)
select frame_id, coalesce(own, case when cam <> '00000000' then cam end, fold) as "day" from d""",
    "capture_order_timed": f"""with {_ONCE}, {_WALL}, t as (select c.*, w.wall at_us, bool_and(w.wall is not null) over (partition by c.dir) timed from camera c left join timed w on c.frame_id = w.frame_id)
select dir, frame_id, row_number() over (partition by dir order by case when timed then at_us else 0 end, k1, k2, k3, k4, file) - 1 pos from t""",
    "calibration_summary": f"""with {_ONCE}, {_FOLD}, l as (select dir, file, label from marks where coalesce(label, '') <> ''),
f as (select dir, {_BASE} name, moved_to is not null and decision = 'cull' junk from once where ((evaluation is not null and moved_to is null) or (moved_to is not null and decision = 'cull')) and coalesce(error, '') = '' and coalesce(decision, '') <> ''),
j as (select l.dir, l.file, l.label, f.name, coalesce(f.junk, false) junk from l left join f on l.dir = f.dir and l.file = f.name)
select count(name) n, count(*) filter (name is null) missing, count(*) filter (name is not null and junk) junk, count(*) filter (name is not null and junk and label = 'keep') junk_keeps,
  coalesce(string_agg(dir || '/' || file, ', ' order by dir || '/' || file) filter (name is not null and junk and label = 'keep'), '') junk_keep_names from j""",
    "set_statistics": _LABELLED
    + """ select count(*) filter ("label" = 'keep') kept, count(*) filter ("label" = 'keep' and rank > 2) kept_ranked_out, count(*) filter ("label" in ('cull', 'review')) culled,
  count(*) filter ("label" in ('cull', 'review') and rank <= 2) culled_in_best, count(distinct (user_id, set_id)) filter ("label" is not null) sets from labelled where set_size >= 2""",
    "policy_grid": _LABELLED
    + f""", j as (select "label", case when value > 60 then 0 when value > 20 then 1 else 2 end base, rank, value from labelled where "label" is not null),
g as (select *, greatest(base, case when rank > keep_best then case outranked when 'cull' then 2 else 1 end else 0 end, case when value > 95 then case clipped when 'cull' then 2 else 1 end else 0 end) d
  from j, (values (1), (2), (3), (4), (5)) a(keep_best), (values ('review'), ('cull')) b(outranked), (values ('review'), ('cull')) c(clipped)),
m as (select keep_best, outranked, clipped, {_GRID}, count(*) n from g group by all)
select m.*, coalesce(keep_cull / nullif(keep_keep + keep_review + keep_cull, 0), 0.0) false_cull, coalesce(cull_keep / nullif(cull_keep + cull_review + cull_cull, 0), 0.0) missed_cull,
  coalesce((keep_review + review_review + cull_review) / nullif(n, 0), 0.0) review_share, coalesce(keep_cull / nullif(keep_keep + keep_review + keep_cull, 0), 0.0) < 0.01 good,
  keep_best = 3 and outranked = 'review' and clipped = 'review' as "current" from m""",
    "status_counts": _EFFECTIVE
    + """, s as (select *, coalesce(error, '') <> '' bad, evaluation is not null done, coalesce(error, '') = '' and evaluation is null and moved_to is not null and nullif(decision, '') is not null junked, case when by_hand then verdict end mark from effective)
select count(*) filter (bad) errors, count(*) filter (not bad and done) assessed, count(*) filter (junked) junk, count(*) filter (((not bad and done) or junked) and decision = 'keep') keep,
  count(*) filter (((not bad and done) or junked) and decision = 'review') review, count(*) filter (((not bad and done) or junked) and decision = 'cull') cull, count(mark) labelled, count(*) filter (stars > 0) rated,
  count(*) filter (nullif(decision, '') is not null and mark <> decision) disagree, count(nullif(moved_to, '')) moved from s""",
    "frame_sets": _FRAME_SETS + " select dir, set_id, frame_id, set_size from fsets",
    "score_ranks": _FRAME_SETS
    + """, r as (select *, row_number() over (partition by dir, set_id order by evaluation is null, evaluation.sharpness.score desc nulls last, not coalesce(evaluation.people.eyes = 'open', false),
  evaluation.composition.score desc nulls last, evaluation.exposure.score desc nulls last, wall, frame_id) rank from fsets) select dir, set_id, frame_id, rank, rank <= 2 best from r""",
    "event_orders": f"""with {_ONCE}, {_WALL}, o as (select *, lag(wall) over (partition by dir order by wall, frame_id) pw from timed),
n as (select *, sum(case when pw is null or wall - pw > 7200000000 or wall // 86400000000 <> pw // 86400000000 then 1 else 0 end) over (partition by dir order by wall, frame_id rows unbounded preceding) ev from o),
e as (select *, min(case when co >= 0 then fo end) over (partition by dir) lf from n)
select frame_id, cast(ev as bigint) event_no, row_number() over (partition by dir, ev order by k1, case when co >= 0 and lf > 0 then fo else 0 end, k3, k4, file) - 1 event_pos from e""",
    "edge_summary": "select p_brand, count(p_size) n, min(p_size) least, list_sort(list(p_size))[count(p_size) // 2 + 1] median, max(p_size) most from part where p_size is not null group by p_brand",
    "name_keys": f"""with {_ONCE} select frame_id, left(sha256(file || chr(0) || dir), 16) as "key", {_BASE} || '.subject.' || left(sha256('v1|' || size || '|' || epoch_us(mod_time) * 1000 || '|0.1000,0.2500,0.5000,0.7500'), 8) "cache",
  string_split(file, '/')[-2] || '/' || {_BASE} card from once where file is not null and dir is not null""",
    "matched_contents": f"""with {_CARDS}, {_FOLDED}, m as (select c.file_id, l.entry_id, l.size is distinct from c.size diff, {_digest("coalesce(nullif(trim(l.file_sha256), ''), l.sha256)")} a, {_digest("c.sha256")} b from cards c join last l on lower(c.orig) = lower(l.orig))
select file_id, entry_id, case when diff then 'other' when a is null or b is null then 'unverified' when a = b then 'same' else 'other' end content from m""",
    "paid_work": f"with {_ONCE} select count(evaluation) evaluated, count(nullif(moved_to, '')) moved from once",
    "run_safety": f"""with {_CARDS}, s as (select case when {_digest("sha256")} is null then 'failed' when file_id % 5 = 0 then 'skipped' else 'copied' end st, coalesce(not unverified, false) ok from cards),
c as (select count(*) planned, count(*) filter (st = 'copied') copied, count(*) filter (st = 'skipped') skipped, count(*) filter (st = 'failed') failed, count(*) filter (st = 'copied' and not ok) unverified from s)
select *, failed = 0 and unverified = 0 and copied + skipped = planned safe from c""",
    "junk_kinds": f"""with p as (select label, {_PLANE} v from embeddings), s as (select label, 100.0 * len(list_filter(v, lambda x: x < 140)) / len(v) dark, 100.0 * len(list_filter(v, lambda x: x >= 90)) / len(v) bright, sqrt(list_var_pop(v)) c from p),
k as (select label, case when dark >= 98 then 'black' when bright >= 95 then 'white' when c < 3 then 'uniform' end kind from s)
select label, count(kind) junk, count(*) filter (kind = 'black') black, count(*) filter (kind = 'white') white, count(*) filter (kind = 'uniform') uniform from k group by label""",
    "landed_cells": f"""with p as (select vec_id, {_PLANE} plane from embeddings),
l as (select vec_id // 40 frame, vec_id, plane, list_var_pop(list_transform(list_filter(range(64), lambda i: i // 8 between 1 and 6 and i % 8 between 1 and 6), lambda i: 4 * plane[i + 1] - plane[i] - plane[i + 2] - plane[i - 7] - plane[i + 9])) fine,
  sqrt(list_var_pop(plane)) coarse, list_avg(plane) mean, vec_id % 7 = 0 excluded from p),
g as (select frame, list_sort(list(fine)) f, list_sort(list(coarse)) c, list_sort(list(fine) filter (fine > 0 and mean between 16 and 239)) m from l group by frame),
n as (select frame, case when len(m) > 0 then m[len(m) // 10 + 1] else f[len(f) // 10 + 1] end noise, greatest(f[len(f) // 2 + 1] / 4, c[len(c) - greatest(1, len(c) // 4) + 1]) floor_ from g),
r as (select l.frame, vec_id, greatest(fine - noise, 0) / (coarse + 1e-6) ratio from l join n on l.frame = n.frame where coarse > 0 and coarse >= floor_ and not excluded),
k as (select *, row_number() over (partition by frame order by ratio desc, vec_id) rank from r) select frame, vec_id, {_round("ratio", 4)} ratio, rank from k where rank <= 3""",
    "next_numbers": rf"""with {_CARDS}, {_HELD}, f as (select c.*, string_split(src, '/')[3] volume, h.o is not null skip from cards c left join held h on lower(c.orig) = h.o and c.size = h.s where src is not null),
t as (select string_split(src, '/')[3] volume, coalesce(max(try_cast(regexp_extract(name, '^(\d+)-.+?\.[A-Za-z0-9]+$', 1) as bigint)), 0) last_n from manifest where src is not null group by 1),
n as (select f.file_id, f.orig, case when not skip then row_number() over (partition by f.volume, skip order by src, file_id) + coalesce(last_n, 0) end n from f left join t on f.volume = t.volume)
select file_id, n, case when n is not null then printf('%05d', n) || '-' || regexp_replace(orig, '\.[^.]*$', '') end new_name from n""",
    "events_at_names": rf"""with {_ONCE}, {_CAMERA}, s as (select distinct dir d, lower(regexp_replace(string_split(file, '/')[-1], '\.[^.]*$', '')) st from label_log where label = 'cull' and dir is not null and file is not null),
f as (select c.*, s.st is not null new_one, row_number() over (partition by dir order by k1, k2, k3, k4, file, frame_id) rn from camera c left join s on c.dir = s.d and lower(regexp_replace(c.base, '\.[^.]*$', '')) = s.st)
select frame_id, cast(sum(case when new_one or rn = 1 then 1 else 0 end) over (partition by dir order by rn rows unbounded preceding) as bigint) event_no from f""",
    "order_changes": f"""with {_ONCE}, r as (select dir, row_number() over (partition by dir order by file, frame_id) a, row_number() over (partition by dir order by mod_time, frame_id) b from once where dir is not null and file is not null and mod_time is not null)
select dir, count(*) filter (a <> b) moved from r group by dir""",
    "earliest_captures": f"""with {_ONCE}, {_CAMERA}, r as (select *, row_number() over (partition by dir order by mod_time, k1, k2, k3, k4, file) rn from camera where mod_time is not null)
select dir, strftime(mod_time, '%Y-%m-%d') as "day", file first_file from r where rn = 1""",
    "space_needed": """with f as (select distinct file_id, src, size from card_files where file_id is not null), s as (select string_split(src, '/')[3] volume, count(*) files, cast(coalesce(sum(size), 0) as bigint) bytes from f group by 1)
select *, bytes + cast(floor(bytes * 0.01::double) as bigint) + 536870912 needed from s""",
    "copy_summary": f"""with {_CARDS}, {_HELD}, f as (select c.*, case when h.o is not null then 'in manifest' when sha256 is null then 'already copied' end skip from cards c left join held h on lower(c.orig) = h.o and c.size = h.s)
select batch_no, count(*) files, count(*) filter (skip is null) copies, cast(coalesce(sum(size) filter (skip is null), 0) as bigint) bytes, count(*) filter (skip = 'already copied') already_copied, count(*) filter (skip = 'in manifest') in_manifest,
  arg_min(orig, file_id) filter (skip is null) first_name, arg_max(orig, file_id) filter (skip is null) last_name from f group by batch_no""",
    "moved_files": f"""with {_ONCE} select file, file as "at", {_MOVED.format(place="review")} as "to" from once where file is not null and frame_id % 3 = 0 and frame_id % 4 <> 0""",
    "found_paths": f"""with {_ONCE} select file path, case when frame_id % 3 <> 0 then file when frame_id % 4 = 0 then {_MOVED.format(place="keep")} else {_MOVED.format(place="review")} end found from once where file is not null""",
    "renamed_paths": f"""with {_ONCE}, f as (select dir, frame_id, file from once where dir is not null and file is not null)
select a.dir, a.frame_id // 8 block, string_agg(coalesce(b.file, a.file), '|' order by a.file) members from f a left join f b on xor(a.frame_id, 1) = b.frame_id group by 1, 2""",
    "request_batches": """with recursive s as (select doc_id, 2048 + 5 + coalesce(octet_length(encode(text)), 0) + cast(floor(coalesce(n_chars % 5000, 0) * 4 / 3) as bigint) size from documents where doc_id is not null),
t as (select doc_id, size, row_number() over (order by doc_id) pos, cast(sum(size) over (order by doc_id) as bigint) upto from s),
cuts(pos, base) as (select cast(1 as bigint), cast(0 as bigint) union all
  select n.pos, n.base from (select min(t.pos) pos, min(t.upto - t.size) base from cuts c join t on t.pos > c.pos and (t.upto - c.base > 100000 or t.pos - c.pos >= 25) group by c.pos) n where n.pos is not null)
select doc_id, (select count(*) from cuts c where c.pos <= t.pos) batch_no from t""",
    "rank_calls": _RANKED
    + """, zz as (select user_id, set_id, max(set_size) as "of", min(event_id) % 3 = 0 model from ranked group by 1, 2)
select "of", cast(sum(ceil("of" / 8.0) + case when "of" > 8 then 1 else 0 end) as bigint) calls, cast(sum(ceil("of" / 8.0) + 1) as bigint) calls_twice from zz where not model group by "of" """,
    "final_positions": _RANKED
    + """, c as (select user_id, set_id, event_id, rank, set_size, cast(ceil(set_size / 3.0) as bigint) chunks from ranked), d as (select *, cast(floor((rank * chunks - 1) / set_size) as bigint) chunk from c),
e as (select *, row_number() over (partition by user_id, set_id, chunk order by event_id) cr from d)
select user_id, set_id, string_agg(cast(rank as varchar), ',' order by rank) positions from e where cr <= greatest(4 // chunks, cast(ceil(3.0 / chunks) as bigint), 1) group by 1, 2""",
    "uncharged_answers": f"""with {_ONCE} select count(*) n, cast(coalesce(sum(usage.input_tokens), 0) as bigint) tokens_in, cast(coalesce(sum(usage.output_tokens), 0) as bigint) tokens_out from once where frame_id % 5 <> 0 and error is null""",
    "clamped_scores": f"""with {_ONCE} select frame_id, {", ".join(f"case when evaluation.{c}.score is not null then greatest(0.0::double, least(10.0::double, evaluation.{c}.score * 1.5::double - 2)) end {c}" for c in ("sharpness", "exposure", "composition"))},
  case when evaluation.exposure.ev_adjust is not null then greatest(-4.0::double, least(4.0::double, evaluation.exposure.ev_adjust * 3)) end ev from once where evaluation is not null""",
    "frame_predicates": f"""with {_ONCE} select frame_id, evaluation is not null and decision is distinct from 'cull' rankable, coalesce(evaluation.sharpness.status in ('soft', 'missed_focus', 'motion_blur'), false) doubtful,
  coalesce(evaluation.sharpness.status = 'soft', false) or coalesce(evaluation.people.eyes = 'closed', false) escalates, coalesce(error, '') = '' and (evaluation is not null or moved_to is not null) kept,
  array_to_string(list_filter([evaluation.sharpness.status, evaluation.exposure.status], lambda s: s is not null), '|') others from once""",
    "pixel_boxes": f"""with b as (select l_orderkey, l_linenumber, cast(floor(l_quantity * 30) as bigint) x, cast(floor(l_discount * 9000) as bigint) y, cast(l_discount as double) d, least(greatest(l_linenumber * 300, 768), 1536, 1600, 1067) s from lineitem),
q as (select *, least(greatest(x - s // 2, 0), 1600 - s) sl, least(greatest(y - s // 2, 0), 1067 - s) st from b)
select l_orderkey, l_linenumber, cast(floor(d * 1600) as bigint) p_left, 1200 p_right, 961 p_bottom, {_round("x / 1600", 4)} f_left, {_round("y / 1067", 4)} f_top, sl s_left, st s_top, sl + s s_right, st + s s_bottom from q""",
    "camera_texts": rf"""with {_ONCE}, c as (select *, coalesce(trim(exif.make), '') mk, coalesce(trim(exif.model), '') md, rtrim(regexp_extract(coalesce(trim(exif.make), ''), '^\s*(\S*)', 1), ',.') w1, rtrim(regexp_extract(coalesce(trim(exif.model), ''), '^\s*(\S*)', 1), ',.') w2 from once),
n as (select *, case when md = '' then w1 || ' camera' when mk = '' or lower(w1) = lower(w2) then md else w1 || ' ' || md end nm from c),
t as (select *, case when regexp_matches(nm, '(?i)^leica m(\d|[\s-]|$)') then nm || ' rangefinder (manual focus, often fast lenses shot wide open)' else nm end full_ from n)
select frame_id, case when mk = '' and md = '' then 'a digital camera' when regexp_matches(full_, '^[AEIOUaeiou]') then 'an ' || full_ else 'a ' || full_ end camera,
  concat_ws(', ', case when exif.exposure_time <= 0 then null when exif.exposure_time < 1 then '1/' || cast(floor(1 / exif.exposure_time + 0.5) as bigint) || ' s' else {_PLAIN.format(x="floor(exif.exposure_time * 100 + 0.5) / 100")} || ' s' end,
    case when exif.iso > 0 then 'ISO ' || exif.iso end, nullif(exif.lens, '')) exposure from t""",
    "tag_rows": """with t as (select shoot_id, coalesce(case when shoot_id % 3 = 0 then 'new' end, nullif(project, '')) p, case when shoot_id % 4 = 0 then 'fair' end e, nullif(time_zone, '') l, case when shoot_id % 5 = 0 then ['c'] else ['a', 'b'] end k, project from shoots)
select shoot_id, array_to_string(list_concat(list_filter([p, e, l], lambda v: v is not null), k), '|') words, array_to_string(list_filter(['project|' || p, 'event|' || e, 'location|' || l], lambda v: v is not null), '|') paths,
  case when contains(project, '|') then 'level' when starts_with(lower(project), 'cull:') then 'marker' end problem from t""",
    "answers": _RANKED
    + """ select user_id, set_id, list_sort(list(rank)) = range(1, count(*) + 1) whole, array_to_string(list_reverse(list(cast(rank as varchar) order by event_id)), ',') backwards from ranked group by 1, 2""",
    "look_codes": f"with {_ONCE} select frame_id, to_base64(encode(file)) code, cast(octet_length(encode(file)) as int) n, cast(list_sum(list_transform(string_split(file, ''), lambda c: ord(c))) as double) as \"sum\" from once where file is not null",
    "fixed_dates": rf"""with {_ONCE} select frame_id, regexp_replace(regexp_replace(exif.date_time_original, '(^|[^0-9])2025:09:14([^0-9]|$)', '\12025:10:01\2', 'g'), '(^|[^0-9])2025-09-14([^0-9]|$)', '\12025-10-01\2', 'g') redated,
  case when regexp_matches(file, '^[A-Za-z0-9_./:@%+=,-]+$') then file else '''' || replace(file, '''', '''\''''') || '''' end word, {_script("file")} quoted from once where exif.date_time_original is not null""",
}
