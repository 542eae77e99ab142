"""Queries on references between tables."""

from __future__ import annotations

from ..operators import orphans
from .catalogue import query

_KEY = "upper(regexp_replace(image_id, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g'))"
_JUDGED = f"""
    with life as (select {_KEY} as k, min(ingested_at) as born, max(withdrawn_at) as gone, max(fracture_count) as n, true as known from image_record where image_id is not null group by 1),
    refs as (
        select 'official_split' as ref_table, split_row_id as ref_id, {_KEY} as k, recorded_at, instance_count as c from official_split
        union all select 'annotation', annotation_id, {_KEY}, recorded_at, null from annotation
        union all select 'classifier_prediction', prediction_id, {_KEY}, recorded_at, null from classifier_prediction),
    judged as (select ref_table, ref_id, k, recorded_at, coalesce(known is null or recorded_at < born or recorded_at > gone or c > n, false) as direct from refs left join life using (k) where k is not null)"""
# A listing has no parent; an annotation falls with all listings of its image, a prediction with all annotations.
_CASCADE = f"""{_JUDGED},
    listing as (select k, bool_and(direct) as dead from judged where ref_table = 'official_split' group by 1),
    marked as (select j.*, coalesce(dead, false) as fallen from judged j left join listing using (k) where ref_table = 'annotation'),
    noted as (select k, bool_and(direct or fallen) as dead from marked group by 1),
    every as (
        select ref_table, recorded_at, direct, false as fallen from judged where ref_table = 'official_split'
        union all select ref_table, recorded_at, direct, fallen from marked
        union all select ref_table, recorded_at, direct, coalesce(dead, false) from judged left join noted using (k) where ref_table = 'classifier_prediction')
    select ref_table, strftime(recorded_at, '%Y-%m') as month, case when direct then 'direct' else 'inherited' end as kind, count(*) as orphans from every where direct or fallen group by 1, 2, 3"""

query("p5_found", f"{_JUDGED} select ref_table, ref_id from judged where direct")(orphans.p5_found)
query("p5_report", _CASCADE)(orphans.p5_report)
