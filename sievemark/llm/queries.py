"""The subpackage's queries and, where SQL can state them on whole tables, their SQL."""

from __future__ import annotations

from . import byte_bpe, consolidate, group_splits, mixture, near_images, proportions, split_overlap, visual_form

QUERIES = {
    "p1_found": proportions.p1_found,
    "p1_sample": proportions.p1_sample,
    "p1_report": proportions.p1_report,
    "p2_found": split_overlap.p2_found,
    "p2_coverage": split_overlap.p2_coverage,
    "p2_report": split_overlap.p2_report,
    "p3_found": group_splits.p3_found,
    "p3_assignment": group_splits.p3_assignment,
    "p3_forest": group_splits.p3_forest,
    "p3_report": group_splits.p3_report,
    "p4_found": near_images.p4_found,
    "p4_groups": near_images.p4_groups,
    "p6_found": consolidate.p6_found,
    "p6_group_sizes": consolidate.p6_group_sizes,
    "p7_ids": byte_bpe.p7_ids,
    "p7_roundtrip": byte_bpe.p7_roundtrip,
    "p8_mixture": mixture.p8_mixture,
    "p8_report": mixture.p8_report,
    "p9_found": visual_form.p9_found,
    "p9_forms": visual_form.p9_forms,
}


def _key(column: str) -> str:
    return f"upper(regexp_replace({column}, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g'))"


def _level(column: str) -> str:
    return f"coalesce(nullif(lower(regexp_replace({column}, '^\\s+|\\s+$', '', 'g')), ''), 'unknown')"


def _number(column: str) -> str:
    digits = f"regexp_replace(regexp_replace(lower({column}), '[\\s:_-]', '', 'g'), '^0x', '')"
    return f"case when regexp_full_match({digits}, '[0-9a-f]{{1,16}}') then ('0x' || {digits})::ubigint end"


def _digest(column: str) -> str:
    digits = f"regexp_replace(regexp_replace(lower({column}), '[\\s:_-]', '', 'g'), '^(md5|0x)', '')"
    return f"case when regexp_full_match({digits}, '[0-9a-f]{{32}}') then {digits} end"


_SPLIT = "case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('val', 'valid', 'validation') then 'val' when lower(trim(split)) = 'test' then 'test' end"
_IMAGES = f"images as (select distinct image_id, {_key('image_id')} as k, {_number('phash')} as p, {_number('dhash')} as d, {_digest('pixel_md5')} as m from image_record where image_id is not null)"
_NEAR = "bit_count(xor(a.p, b.p)::bit) <= 4 and bit_count(xor(a.d, b.d)::bit) <= 6"

_LISTED = f"""{_IMAGES},
        src as (select image_id, max({_level("source")}) as source from image_record where image_id is not null group by 1),
        listed as (select distinct i.*, s.split from images i join (select {_key("image_id")} as k, {_SPLIT} as split from official_split) s using (k) where s.split is not null),
        e as (select distinct image_id, p, d, m from listed where split in ('val', 'test')),
        t as (select distinct image_id, p, d, m from listed where split = 'train'),
        met as (select a.image_id, b.image_id as other, case when a.image_id = b.image_id or a.m = b.m then 1.0 else 1 - (bit_count(xor(a.p, b.p)::bit) + bit_count(xor(a.d, b.d)::bit)) / 128.0 end::double as coverage
            from e a, t b where a.image_id = b.image_id or a.m = b.m or ({_NEAR})),
        found as (select image_id, count(distinct other) as counterparts, max(coverage) as coverage from met group by 1)"""
_GROUPS = """both_ways as (select a, b from e union select b, a from e),
        reach(a, b) as (select a, b from both_ways union select r.a, w.b from reach r join both_ways w on r.b = w.a)"""
_P6 = f"""
        with recursive ids as (select {_key("image_id")} as k, min(image_id) as image_id from image_record where image_id is not null group by 1),
        lab as (
            select 'x' || upper(trim(exact_group)) as l, {_key("image_id")} as k from exclusions where trim(exact_group) <> ''
            union select 'n' || upper(trim(near_group)), {_key("image_id")} from exclusions where trim(near_group) <> ''
            union select 'p' || ({_number("phash")}), {_key("image_id")} from image_record where image_id is not null and ({_number("phash")}) is not null),
        star as (select image_id as a, min(image_id) over (partition by l) as b from lab join ids using (k)),
        e as (
            select a, b from star where a <> b
            union select l.image_id, r.image_id from near_pair n join ids l on l.k = {_key("left_image_id")} join ids r on r.k = {_key("right_image_id")} where l.k <> r.k),
        {_GROUPS}, grouped as (select a as image_id, least(a, min(b)) as group_id from reach group by a)"""

SQL = {
    "p1_report": f"""
        with n as (select count(distinct image_id) // 10 as n from image_record),
        have as (select fractured, {_level("anatomy")} as anatomy, {_level("view")} as view, count(distinct image_id) as c from image_record group by 1, 2, 3),
        goal as (select stratum_id, coalesce(c, 0) as available, greatest(min_rows, (n * target_ppm + 999999) // 1000000)::bigint as needed, target_ppm, min_rows
            from sample_target t left join have h on h.fractured = t.fractured and h.anatomy = t.anatomy and h.view = t.view, n),
        ranked as (select stratum_id, unnest(range(1, available + 1)) as r, target_ppm, min_rows from goal),
        placed as (select stratum_id, row_number() over (order by r > min_rows, (r - 0.5) / target_ppm, stratum_id) as place from ranked where r <= min_rows or target_ppm > 0),
        got as (select stratum_id, count(*) as seats from placed, n, (select sum(least(available, min_rows)) as kept from goal) where place <= greatest(n, kept) group by 1)
        select stratum_id, available, needed, coalesce(seats, 0) as seats, greatest(0, needed - available)::bigint as shortfall, (target_ppm / 1e6)::double as target_share, (coalesce(seats, 0) / sum(seats) over ())::double as actual_share from goal left join got using (stratum_id)""",
    "p2_coverage": f"with {_LISTED} select * from found",
    "p2_report": f"""
        with {_LISTED}
        select split, source, count(*) as images, count(counterparts) as overlapping, coalesce(sum(counterparts), 0)::bigint as pairs, count(counterparts) / count(*) as share, avg(coverage) as coverage
        from (select distinct image_id, split from listed where split <> 'train') join src using (image_id) left join found using (image_id) group by 1, 2""",
    "p4_groups": f"""
        with recursive {_IMAGES}, e as (select a.image_id as a, b.image_id as b from images a join images b on a.image_id < b.image_id where {_NEAR} and (a.m is null or b.m is null or a.m <> b.m)),
        {_GROUPS}
        select image_id, group_id, links from (select a as image_id, least(a, min(b)) as group_id from reach group by a) join (select a as image_id, count(*) as links from both_ways group by 1) using (image_id)""",
    "p6_group_sizes": f"{_P6} select size, count(*) as groups from (select count(*) as size from grouped group by group_id) group by 1",
    "p1_found": f"""
        with n as (select count(distinct image_id) // 10 as n from image_record),
        have as (select fractured, {_level("anatomy")} as anatomy, {_level("view")} as view, count(distinct image_id) as c from image_record group by 1, 2, 3)
        select stratum_id from sample_target t left join have h on h.fractured = t.fractured and h.anatomy = t.anatomy and h.view = t.view, n
        where coalesce(c, 0) < greatest(min_rows, (n * target_ppm + 999999) // 1000000)""",
    "p2_found": f"""
        with {_IMAGES},
        listed as (select distinct i.*, s.split from images i join (select {_key("image_id")} as k, {_SPLIT} as split from official_split) s using (k) where s.split is not null),
        e as (select distinct image_id, p, d, m from listed where split in ('val', 'test')),
        t as (select distinct image_id, p, d, m from listed where split = 'train')
        select distinct least(a.image_id, b.image_id) as image_id_a, greatest(a.image_id, b.image_id) as image_id_b
        from e a, t b where a.image_id = b.image_id or a.m = b.m or ({_NEAR})""",
    "p3_found": f"""
        with ids as (select distinct {_key("image_id")} as k from image_record where image_id is not null),
        labels as (select distinct upper(trim(near_group)) as near_group, {_key("image_id")} as k from exclusions where trim(near_group) <> ''),
        lists as (select distinct {_key("image_id")} as k, {_SPLIT} as split from official_split)
        select near_group from labels join lists using (k) join ids using (k) where split is not null group by 1 having count(distinct split) > 1""",
    "p4_found": f"""
        with {_IMAGES}
        select a.image_id as image_id_a, b.image_id as image_id_b from images a join images b on a.image_id < b.image_id
        where {_NEAR} and (a.m is null or b.m is null or a.m <> b.m)""",
    "p6_found": f"{_P6} select * from grouped",
}
