"""The SQL of the queries in triage.py."""

_ONCE = "once as (select * exclude (loaded_at) from (select *, row_number() over (partition by frame_id order by loaded_at) delivery from frames) where delivery = 1)"
_FOLD = """marks as (
  select dir, file, log_id, label, stars, ev from (select *, row_number() over (partition by dir, file order by log_id desc) back from label_log)
  where back = 1 and not (coalesce(label, '') = '' and coalesce(stars, 0) = 0 and ev is null))"""
_BASE = "string_split(file, '/')[-1]"
_EFFECTIVE = f"""with {_ONCE}, {_FOLD},
effective as (
  select o.*, coalesce(nullif(m.label, ''), nullif(o.decision, '')) verdict, nullif(m.label, '') is not null by_hand, coalesce(m.stars, 0) stars
  from once o left join marks m on o.dir = m.dir and string_split(o.file, '/')[-1] = m.file)"""
_JUDGED = f"""with {_ONCE}, {_FOLD},
judged as (
  select m.label, o.decision from once o join marks m on o.dir = m.dir and string_split(o.file, '/')[-1] = m.file
  where o.error is null and m.label in ('keep', 'review', 'cull') and o.decision in ('keep', 'review', 'cull')),
matrix as (
  select c.label, count(*) filter (decision = 'keep') keep, count(*) filter (decision = 'review') review, count(*) filter (decision = 'cull') cull, count(decision) total
  from (values ('keep'), ('review'), ('cull')) c(label) left join judged j on c.label = j.label group by c.label)"""


def _sets(group: str, gap_us: int, look: int) -> str:
    step = f"epoch_us(ts) - epoch_us(pts) between 0 and {gap_us} and" if gap_us else ""
    return f"""with o as (select {group}, event_id, ts, value, lag(ts) over w pts, lag(value) over w pv, row_number() over w rn from events window w as (partition by {group} order by ts, event_id)),
l as (select *, case when pts is not null and {step} abs(value - pv) <= {look} then 0 else 1 end brk from o),
i as (select *, sum(brk) over (partition by {group} order by rn rows unbounded preceding) isl from l),
k as (select *, cast(floor((row_number() over (partition by {group}, isl order by rn) - 1) / 40.0) as bigint) cut from i),
z as (select *, count(*) over (partition by {group}, isl, cut) sz from k),
sets as (select {group}, dense_rank() over (partition by {group} order by isl, cut) set_id, event_id, sz set_size from z where sz > 1)"""


_RANKED = (
    _sets("user_id", 43_200_000_000, 40)
    + """, ranked as (
  select s.*, row_number() over (partition by s.user_id, set_id order by e.value desc, s.event_id) rank from sets s join events e on s.user_id = e.user_id and s.event_id = e.event_id)"""
)
_KEYWORDS = r"""list_slice(list_reduce(list_prepend(cast([] as varchar[]), list_transform(
  list_filter(list_transform(list_filter(evaluation.keywords, lambda w: w is not null), lambda w: lower(trim(regexp_replace(w, '[\s\x{00A0}\x{3000}]+', ' ', 'g')))),
    lambda w: w <> '' and strlen(w) <= 30 and len(string_split(w, ' ')) <= 3 and not contains(w, '|') and not starts_with(w, 'cull:')),
  lambda w: [w])), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end), 1, 8)"""
_ROUND = "sign({x}) * floor(abs({x}) * 1e{p} + 0.5) / 1e{p}"


def _round(x: str, places: int) -> str:
    return _ROUND.format(x=f"({x})", p=places)


_BARE = r"regexp_replace(lower(regexp_replace({x}, '[\s\x{{00A0}}]+', '', 'g')), '^sha-?256[:=]', '')"
_CARD = "card as (select * from (select *, row_number() over (partition by file_id order by loaded_at desc) r from card_files where file_id is not null) where r = 1)"


def _clean(x: str) -> str:
    return f"case when regexp_matches({_BARE.format(x=x)}, '^[0-9a-f]{{64}}$') then {_BARE.format(x=x)} end"


def _shift(dx: int, dy: int) -> str:
    """The mean of the largest quarter of cell differences of lists a and b, b shifted by a cell."""
    cells = f"list_transform(list_filter(range(64), lambda i: i % 8 + {dx} between 0 and 7 and i // 8 + {dy} between 0 and 7), lambda i: abs(a[i + 1] - b[i + 1 + {dx + 8 * dy}]))"
    most = -(-(8 - abs(dx)) * (8 - abs(dy)) // 4)
    return f"list_avg(list_slice(list_reverse_sort({cells}), 1, {most}))"


_PLANE = "list_transform(embedding, lambda x: floor((cast(x as double) + 1) * 128))"
_IOU_W = "greatest(0.0, least(l_quantity / 50, 0.5) - greatest(l_discount, 0.05))"
_IOU_H = "greatest(0.0, least(0.9, 0.5) - greatest(l_tax, 0.02))"
_IOU_U = f"((l_quantity / 50 - l_discount) * (0.9 - l_tax) + (0.5 - 0.05) * (0.5 - 0.02) - {_IOU_W} * {_IOU_H})"
_REPORTS = "docs as (select report_id, any_value(dir) dir, cast(any_value(raw) as json) doc from report_files where json_valid(raw) group by report_id), known as (select * from docs where cast(doc->>'$.schema_version' as int) <= 4)"

SQL = {
    "label_fold": f"with {_FOLD} select dir, file, log_id, label, stars, ev from marks",
    "label_entries_ok": r"""select coalesce(file <> '' and not regexp_matches(file, '[/\\]') and file not in ('.', '..'), false) and coalesce(label, '') in ('', 'keep', 'review', 'cull')
  and coalesce(stars, 0) between 0 and 5 and (ev is null or (ev between -5 and 5 and not isnan(ev))) ok, count(*) n from label_log group by 1""",
    "manifest_fold": """with lines as (select distinct on (entry_id) * from manifest),
keyed as (select *, lower(orig) orig_key, row_number() over (partition by lower(orig), size order by entry_id desc) back, min(entry_id) over (partition by lower(orig), size) first_id from lines)
select orig_key, size, entry_id, dir, name, first_id, coalesce(nullif(trim(file_sha256), ''), sha256) current_sha256 from keyed where back = 1""",
    "effective_verdicts": _EFFECTIVE + " select frame_id, verdict, by_hand, stars from effective",
    "confusion_matrix": _JUDGED + " select * from matrix",
    "confusion_rates": _JUDGED
    + """ select cast(sum(total) as bigint) n, coalesce(sum(cull) filter (label = 'keep') / nullif(sum(total) filter (label = 'keep'), 0), 0.0) false_cull,
  coalesce(sum(keep) filter (label = 'cull') / nullif(sum(total) filter (label = 'cull'), 0), 0.0) missed_cull, coalesce(sum(review) / nullif(sum(total), 0), 0.0) review_share from matrix""",
    "run_difference": _EFFECTIVE
    + """, a as (select frame_id, decision d1, evaluation.sharpness.status s1, evaluation.sharpness.score v1 from once where evaluation is not null),
b as (select frame_id, verdict d2, evaluation.exposure.status s2, evaluation.exposure.score v2 from effective where by_hand),
f as (select a.frame_id x, b.frame_id y, * exclude (frame_id) from a full join b on a.frame_id = b.frame_id)
select count(*) filter (x = y) n, count(*) filter (x = y and d1 is not distinct from d2) same, count(*) filter (x = y and ((d1 = 'keep' and d2 = 'cull') or (d1 = 'cull' and d2 = 'keep'))) crossed,
  count(*) filter (x = y and s1 is distinct from s2) status_changes, avg(abs(v1 - v2)) filter (x = y) mean_delta, count(*) filter (x is null or y is null) missing from f""",
    "change_summary": _EFFECTIVE + " select coalesce(decision, 'none') || '→' || coalesce(verdict, 'none') change, count(*) n from effective where decision is distinct from verdict group by 1",
    "repeated_names": """select dir, lower(orig) as name, count(*) n, min(file) first_file from (select distinct entry_id, dir, orig, name as file from manifest)
group by 1, 2 having count(*) > 1""",
    "pending_files": """select distinct file_id, lower(orig) orig, size from card_files c
where not exists (select 1 from manifest m where lower(m.orig) = lower(c.orig) and m.size = c.size)""",
    "resume_states": f"""with {_CARD}, l as (select src, arg_max(size, file_id) size from card where src is not null group by src),
r0 as (select *, row_number() over (partition by src order by entry_id desc) b from manifest where src is not null and entry_id is not null), r as (select src, size, {_clean("sha256")} digest from r0 where b = 1)
select case when l.src is null then 'gone' when r.src is null then 'new' when l.size is not distinct from r.size and digest is not null then 'carried' else 'redo' end state, count(*) n
from l full join r on l.src = r.src group by 1""",
    "verify_files": f"""with {_CARD}, r0 as (select *, row_number() over (partition by lower(orig), size order by entry_id desc) b from manifest), r as (select lower(orig) orig, size, {_clean("coalesce(nullif(trim(file_sha256), ''), sha256)")} digest from r0 where b = 1),
l0 as (select *, row_number() over (partition by lower(orig), size order by file_id desc) b from card), l as (select lower(orig) orig, size, {_clean("sha256")} digest from l0 where b = 1)
select coalesce(r.orig, l.orig) orig, coalesce(r.size, l.size) size, case when r.orig is null then 'unrecorded' when l.orig is null then 'missing' when r.digest is distinct from l.digest then 'digest' else 'same' end state
from r full join l on r.orig = l.orig and r.size = l.size""",
    "near_matches": """select distinct m.entry_id, l.log_id from (select distinct entry_id, dir, recorded_at from manifest) m join label_log l on m.dir = l.dir
where abs(epoch_us(m.recorded_at) - epoch_us(l.logged_at)) <= 600000000""",
    "capture_order": rf"""with {_ONCE},
f as (select dir, frame_id, file, case when evaluation is not null then epoch_us(mod_time) end at_us, string_split(file, '/')[-1] base, string_split(file, '/')[-2] folder from once where dir is not null and file is not null),
p as (select *, coalesce(try_cast(regexp_extract(folder, '^([1-9]\d\d)[A-Za-z0-9_]{{5}}$', 1) as int), 0) fo,
  coalesce(try_cast(regexp_extract(regexp_replace(base, '\.[^.]*$', ''), '^[A-Za-z0-9_]{{4}}(\d{{4}})$', 1) as int), -1) co from f),
q as (select *, bool_and(at_us is not null) over (partition by dir) timed, min(case when co >= 0 then fo end) over (partition by dir) least_fo from p)
select dir, frame_id, row_number() over (partition by dir order by case when timed then at_us else 0 end, case when co >= 0 then 0 else 1 end, case when co >= 0 and least_fo > 0 then fo else 0 end,
  greatest(co, 0), lower(base), file) - 1 pos from q""",
    "sequence_sets": _sets("user_id", 43_200_000_000, 40) + " select user_id, set_id, event_id, set_size from sets",
    "sequence_cut": _sets("event_type", 0, 100) + " select event_type, set_id, event_id, set_size from sets",
    "event_split": """with o as (select user_id, event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) p from events),
n as (select *, case when p is null or epoch_us(ts) - epoch_us(p) > 7200000000 or cast(ts as date) <> cast(p as date) then 1 else 0 end new_one from o)
select user_id, event_id, cast(sum(new_one) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) event_no from n""",
    "broken_clocks": f"""with {_ONCE}, o as (select dir, mod_time t, lag(mod_time) over (partition by dir order by mod_time, frame_id) p from once where dir is not null and mod_time is not null),
c as (select dir, count(p) pairs, count(*) filter (date_trunc('second', t) = date_trunc('second', p)) same from o group by dir)
select dir, pairs, same, pairs >= 10 and same * 10 >= pairs * 9 broken from c""",
    "best_of_sets": _RANKED + " select user_id, set_id, event_id, rank, rank <= 3 best from ranked",
    "keep_grid": _RANKED + " select k keep_best, count(*) filter (rank <= k) kept, count(*) filter (rank > k) outranked from ranked, (values (1), (2), (3), (4), (5)) g(k) group by k",
    "chunk_plan": _RANKED
    + """, c as (select *, cast(ceil(set_size / 8.0) as bigint) chunks from ranked)
select user_id, set_id, event_id, cast(floor((rank * chunks - 1) / set_size) as bigint) chunk, greatest(8 // chunks, cast(ceil(3.0 / chunks) as bigint), 1) finalists from c""",
    "upper_medians": f"with {_ONCE}, s as (select dir, list_sort(list(size)) l from once where size is not null group by dir) select dir, len(l) n, l[len(l) // 2 + 1] median from s",
    "frame_numbers": rf"""with {_ONCE}, f as (select *, string_split(file, '/')[-1] base, string_split(file, '/')[-2] folder from once where dir is not null and file is not null),
p as (select *, coalesce(try_cast(regexp_extract(folder, '^([1-9]\d\d)[A-Za-z0-9_]{{5}}$', 1) as int), 0) fo, coalesce(try_cast(regexp_extract(regexp_replace(base, '\.[^.]*$', ''), '^[A-Za-z0-9_]{{4}}(\d{{4}})$', 1) as int), -1) co from f),
q as (select *, min(case when co >= 0 then fo end) over (partition by dir) least_fo from p),
n as (select dir, frame_id, row_number() over (partition by dir order by case when co >= 0 then 0 else 1 end, case when co >= 0 and least_fo > 0 then fo else 0 end, greatest(co, 0), lower(base), file, frame_id) n from q)
select frame_id, n, substr(dir, 9, 10) || '-set-' || printf('%04d', n) || '.dng' new_name, printf('%04d', n) back from n""",
    "name_collisions": f"with {_ONCE} select dir, 'x' || (size % 97) || '.dng' as name, count(*) n from once where dir is not null and size is not null group by 1, 2 having count(*) > 1",
    "ghost_names": f"""with {_ONCE} select distinct dir, lower(orig) orig, name from manifest m
where not exists (select 1 from once o where o.moved_to is null and o.dir = m.dir and lower(string_split(o.file, '/')[-1]) = lower(m.orig))""",
    "stem_conflicts": rf"""with {_ONCE}, s as (select distinct dir, lower(regexp_replace(string_split(file, '/')[-1], '\.[^.]*$', '')) stem from once)
select distinct s.dir, s.stem, l.file as name from s join label_log l on s.dir = l.dir and starts_with(lower(l.file), s.stem || '.')""",
    "name_problems": """select case when strlen(orig) > 255 then 'long' when regexp_matches(orig, '[/:]') then 'characters' when starts_with(orig, '.') then 'hidden' end problem,
  count(distinct file_id) n from card_files group by 1""",
    "clean_keywords": f"with {_ONCE} select frame_id, array_to_string({_KEYWORDS}, '|') keywords from once where evaluation.keywords is not null",
    "path_parts": rf"""with {_ONCE}, p as (select frame_id, file, string_split(file, '/')[-1] base from once where file is not null)
select frame_id, base, lower(regexp_extract(base, '(\.[^.]*)$', 1)) ext, lower(regexp_replace(base, '\.[^.]*$', '')) stem, 'f' || left(sha1(file), 16) id,
  coalesce(try_cast(regexp_extract(regexp_replace(base, '\.[^.]*$', ''), '^[A-Za-z0-9_]{{4}}(\d{{4}})$', 1) as int), -1) counter,
  case when file = '/shoots' then '/archive' when starts_with(file, '/shoots/') then '/archive' || substr(file, 8) else file end moved from p""",
    "card_folders": r"""select coalesce(try_cast(regexp_extract(string_split(src, '/')[-2], '^([1-9]\d\d)[A-Za-z0-9_]{5}$', 1) as int), 0) folder, count(distinct entry_id) n
from manifest where src is not null group by 1""",
    "boxes": f"""select l_orderkey, l_linenumber, l_discount < l_quantity / 50 and l_tax < 0.9 and l_discount between 0 and 1 and l_tax between 0 and 1 and l_quantity / 50 between 0 and 1 valid,
  {_round(f"coalesce(case when {_IOU_U} = 0 then null else {_IOU_W} * {_IOU_H} / {_IOU_U} end, 0.0)", 6)} iou,
  {_round("case l_linenumber when 3 then 1 - l_quantity / 50 when 6 then l_tax when 8 then 1 - 0.9 else l_discount end", 6)} "left",
  {_round("case l_linenumber when 3 then 1 - l_tax when 6 then 1 - l_discount when 8 then l_quantity / 50 else 0.9 end", 6)} bottom from lineitem""",
    "luma_statistics": f"""select l_returnflag, count(l_quantity) n, {_round("avg(l_quantity)", 1)} mean, quantile_disc(l_quantity, 0.01) p1, quantile_disc(l_quantity, 0.5) p50, quantile_disc(l_quantity, 0.99) p99,
  {_round("100.0 * count(*) filter (l_quantity <= 3) / count(l_quantity)", 4)} dark_pct, {_round("100.0 * count(*) filter (l_quantity < 16) / count(l_quantity)", 4)} shadow_pct,
  {_round("100.0 * count(*) filter (l_quantity >= 48) / count(l_quantity)", 4)} bright_pct from lineitem group by 1""",
    "usage_by_camera": f"""with {_ONCE} select lower(trim(exif.make)) make, count(*) frames, count(evaluation) evaluated, cast(sum(usage.input_tokens) as bigint) tokens_in,
  cast(sum(usage.output_tokens) as bigint) tokens_out, count(error) errors from once group by 1""",
    "result_counts": f"with {_ONCE} select case when error is not null then 'error' when nullif(decision, '') is null then 'measured' else decision end state, count(*) n from once group by 1",
    "plane_statistics": f"""with p as (select vec_id, {_PLANE} plane from embeddings),
l as (select vec_id, plane, list_transform(list_filter(range(64), lambda i: i // 8 between 1 and 6 and i % 8 between 1 and 6),
  lambda i: 4 * plane[i + 1] - plane[i] - plane[i + 2] - plane[i - 7] - plane[i + 9]) lap from p)
select vec_id, {_round("sqrt(list_var_pop(plane))", 4)} deviation, {_round("list_var_pop(lap)", 6)} laplacian, {", ".join(_round(f"list_avg(list_transform(list_filter(range(64), lambda i: i // 32 = {b // 2} and (i % 8) // 4 = {b % 2}), lambda i: plane[i + 1]))", 4) + f" block{b}" for b in range(4))} from l""",
    "look_distances": f"""with p as (select label, vec_id, {_PLANE} v from embeddings), q as (select label, vec_id, list_transform(v, lambda x: least(1.0, x / greatest(1.0, list_avg(v)) / 4)) a from p),
w as (select label, vec_id, a, lag(vec_id) over (partition by label order by vec_id) before_id, lag(a) over (partition by label order by vec_id) b from q)
select label, vec_id, before_id, {_round("least(1.0, " + ", ".join(_shift(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)) + ")", 9)} distance from w where before_id is not null""",
    "clip_shares": f"select l_linestatus channel, count(l_quantity) samples, {_round('100.0 * count(*) filter (l_quantity >= 49) / count(l_quantity)', 4)} clipped_pct from lineitem group by 1",
    "report_runs": f"""with {_REPORTS} select report_id, dir, cast(doc->>'$.schema_version' as int) schema_version, doc->>'$.backend' backend, doc->>'$.model' model,
  cast(coalesce(json_array_length(doc, '$.results'), 0) as int) n_results from known""",
    "report_frames": f"""with {_REPORTS}, r as (select report_id, cast(doc->>'$.schema_version' as int) v, unnest(cast(doc->'$.results' as json[])) r from known)
select report_id, r->>'$.file' file, r->>'$.decision' decision, case when v >= 4 then cast(r->>'$.group.rank' as bigint) end rank,
  case when v >= 4 and json_type(r, '$.group') = 'OBJECT' then coalesce(r->>'$.group.best' = 'true', false) end best from r""",
}
