"""Observation and manifest views derived from the given star-schema tables.

Each view is a plain projection of whole tables, stated once and rendered for Spark SQL or for the
checking dialect: ``#[e]#`` is the hex SHA-256 of e, ``@us[e]@`` the microseconds of a timestamp,
``@iso[e]@`` the ISO text of epoch microseconds, ``@chars[e]@`` the characters of a text.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.session import ready

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_MARKS = {
    "spark": {
        "#": "sha2({}, 256)",
        "us": "unix_micros(cast({} as timestamp))",
        "iso": "date_format(timestamp_micros(cast({} as bigint)), 'yyyy-MM-dd''T''HH:mm:ss.SSSSSS')",
    },
    "check": {
        "#": "sha256({})",
        "us": "epoch_us({})",
        "iso": "strftime(make_timestamp(cast({} as bigint)), '%Y-%m-%dT%H:%M:%S.%f')",
    },
}


def _uid(letter: str, number: str) -> str:
    return f"'{letter}0000000-0000-4000-8000-' || lpad(cast({number} as string), 12, '0')"


_MANIFEST_FIELDS = """
  'ds' as dataset_id,
  'img-' || lpad(cast(v as string), 10, '0') as image_id,
  'field survey' as source,
  'ref-' || cast(v % 7 as string) as source_reference,
  'CC-BY-4.0' as license_or_permission,
  'ind-' || cast(individual as string) as individual_label,
  case when half = 0 then 'left' else 'right' end as side,
  case when individual % 5 = 0 then 's0'
       else 's' || cast(cast(floor(k / 3) as bigint) as string) end as capture_session_id,
  case when v % 11 = 0 then ''
       when v % 13 = 0 then @iso[1704067200000000 + v * 37000000]@ || '+00:00'
       else @iso[1704067200000000 + v * 37000000]@ end as capture_timestamp_if_known,
  #['file-' || cast(v as string)]# as original_filename_hash,
  #[cast(v as string)]# as file_sha256,
  cast(64 + (v % 5) * 32 as int) as width,
  cast(64 + (v % 7) * 32 as int) as height,
  'unassigned' as split,
  '' as notes,
  case v % 3 when 0 then 'sun' when 1 then 'shade' else '' end as attr_lighting,
  case when v % 4 < 2 then 'f' || cast(cast(floor(v / 2) as bigint) as string)
       else '' end as attr_source_frame,
  case when v % 2 = 0 then '0,0,' || cast(16 + v % 60 as string) || ',32'
       else '' end as attr_head_bbox
"""

_SCORES = """select 'q-' || lpad(cast(l_orderkey as string), 10, '0') as query_id,
  'g-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' ||
    cast(l_suppkey as string) as gallery_id,
  'side-' || lpad(cast(l_suppkey % 50 as string), 2, '0') as side_id,
  l_orderkey % 4 = 0 as is_unknown,
  {} as score from lineitem"""

VIEWS: dict[str, str | dict[str, str]] = {
    "manifest_v": f"""select v, {_MANIFEST_FIELDS} from (
  select vec_id as v, cast(floor(vec_id / 20) as bigint) as individual,
         cast(floor(vec_id / 10) as bigint) % 2 as half, vec_id % 10 as k from embeddings)""",
    # the same images, labelled so that near pairs and shared frames cross identities
    "clash_v": f"""select v, {_MANIFEST_FIELDS} from (
  select vec_id as v, vec_id % 7 as individual,
         cast(floor(vec_id / 10) as bigint) % 2 as half, vec_id % 10 as k from embeddings)""",
    # one planted fault per row, all text, as a header-checked file would deliver it
    "rough_manifest_v": """select
  case when v % 17 = 0 then ' ' else dataset_id end as dataset_id,
  case when v % 47 = 5 then 'img-0000000001' else image_id end as image_id,
  case when v % 53 = 0 then '' else source end as source,
  source_reference, license_or_permission,
  case when v % 19 = 0 then 'a:b' else individual_label end as individual_label,
  case when v % 23 = 0 then 'up' else side end as side,
  case when v % 59 = 0 then '' else capture_session_id end as capture_session_id,
  case when v % 43 = 0 then 'yesterday' else capture_timestamp_if_known end
    as capture_timestamp_if_known,
  case when v % 61 = 0 then upper(original_filename_hash) else original_filename_hash end
    as original_filename_hash,
  case when v % 29 = 0 then 'xyz' when v % 67 = 3 then #['1']# else file_sha256 end as file_sha256,
  case when v % 31 = 0 then '0' else cast(width as string) end as width,
  case when v % 37 = 0 then 'tall' else cast(height as string) end as height,
  case when v % 41 = 0 then 'dev' else split end as split,
  notes, attr_lighting, attr_source_frame,
  case when v % 5 = 0 then '0,0,9999,9' when v % 7 = 0 then '1,2,3' when v % 9 = 0 then '5,5,5,9'
       else attr_head_bbox end as attr_head_bbox
 from manifest_v""",
    # in each ten ids, classes of 1, 2, 3 and 4 or of 5 and 5 equal hashes; some last ones differ by a bit
    "phash_v": {
        "spark": """select image_id, case when v % 10 = 9 and (v div 10) % 3 = 1
       then base ^ shiftleft(1L, cast(v % 60 as int)) else base end as dhash from (
  select 'img-' || lpad(cast(vec_id as string), 10, '0') as image_id, vec_id as v,
    cast(conv(substr(sha2('b' || cast(vec_id div 10 as string) || '.' || cast(case
      when (vec_id div 10) % 2 = 1 then (vec_id % 10) div 5 when vec_id % 10 = 0 then 0
      when vec_id % 10 < 3 then 1 when vec_id % 10 < 6 then 2 else 3 end as string), 256), 1, 16), 16, -10)
      as bigint) as base from embeddings)""",
        "check": """select image_id, case when v % 10 = 9 and (v // 10) % 3 = 1
       then xor(base, cast(1 as ubigint) << cast(v % 60 as ubigint)) else base end as bits from (
  select 'img-' || lpad(cast(vec_id as string), 10, '0') as image_id, vec_id as v,
    cast('0x' || substr(sha256('b' || cast(vec_id // 10 as string) || '.' || cast(case
      when (vec_id // 10) % 2 = 1 then (vec_id % 10) // 5 when vec_id % 10 = 0 then 0
      when vec_id % 10 < 3 then 1 when vec_id % 10 < 6 then 2 else 3 end as string)), 1, 16)
      as ubigint) as base from embeddings)""",
    },
    "features_v": {
        # the norm is bound by the finishing lambda; as a column it would be redone per element
        "spark": """select image_id, side_id, k, aggregate(raised, 0D, (s, x) -> s + x * x,
    s -> transform(raised, x -> x / sqrt(s))) as vector from (
    select 'img-' || lpad(cast(vec_id as string), 10, '0') as image_id, vec_id % 10 as k,
      'ds:ind-' || cast(vec_id div 20 as string) || ':' ||
        case when (vec_id div 10) % 2 = 0 then 'left' else 'right' end as side_id,
      transform(embedding, (x, i) -> cast(x as double) +
        case when i = (vec_id div 10) % 64 then 0.4D else 0D end) as raised
    from embeddings)""",
        "check": """select image_id, side_id, k,
    list_transform(raised, lambda x: x / sqrt(list_dot_product(raised, raised))) as vector from (
    select 'img-' || lpad(cast(vec_id as string), 10, '0') as image_id, vec_id % 10 as k,
      'ds:ind-' || cast(vec_id // 20 as string) || ':' ||
        case when (vec_id // 10) % 2 = 0 then 'left' else 'right' end as side_id,
      list_transform(embedding, lambda x, i: cast(x as double) +
        case when i - 1 = (vec_id // 10) % 64 then cast(0.4 as double) else 0 end) as raised
    from embeddings)""",
    },
    "captures_v": """select 'ev' as dataset_id,
  'ev-' || lpad(cast(event_id as string), 10, '0') as image_id,
  'u' || cast(user_id as string) as individual_label, 'left' as side,
  'e' || cast(event_id as string) as capture_session_id,
  @us[ts]@ as us,
  case when event_id % 17 = 0 then '' when event_id % 5 = 0 then @iso[@us[ts]@]@ || '+00:00'
       else @iso[@us[ts]@]@ end as capture_timestamp_if_known,
  event_type as attr_event from events""",
    "files_v": """select
  'set/' || cast(doc_id % 7 as string) || '/' || lpad(cast(doc_id as string), 9, '0') || '.jpg'
    as relative_path,
  sha as file_sha256,
  case when doc_id % 10 = 3 then 'other' else 'L' || substr(sha, 1, 2) end as individual_label,
  'left' as side, 's' || substr(sha, 3, 1) as capture_session_id,
  case when doc_id % 6 = 0 then '2024-05-01T08:00:00' else '' end as capture_timestamp_if_known,
  lang as attr_lang, n_chars,
  cast(40 + n_chars % 300 as int) as width, cast(40 + n_chars % 200 as int) as height
 from (select doc_id, lang, n_chars, #[text]# as sha from documents)""",
    "label_rows_v": """select
  case when doc_id % 31 = 1 then '../escape/' || base when doc_id % 31 = 2 then '/abs/' || base
       when doc_id % 31 = 3 then 'c:' || base when doc_id % 31 = 4 then 'a' || chr(92) || '..' || chr(92) || base
       when doc_id % 31 = 5 then 'set/' || base || '.gif' when doc_id % 31 = 6 then 'gone/' || base || '.png'
       when doc_id % 31 = 7 then 'set' || chr(92) || cast(doc_id % 7 as string) || chr(92) || base || '.jpg'
       else 'set/' || cast(doc_id % 7 as string) || '/' || base || '.jpg' end as relative_path
 from (select doc_id, lpad(cast(doc_id as string), 9, '0') as base from documents)""",
    "provenance_v": """select 'src-' || cast(p_partkey as string) as dataset_id,
  case when p_partkey % 11 = 0 then 'C' when p_partkey % 3 = 0 then 'A' else 'B' end as tier,
  p_name as species, 'field' as source, p_brand as source_reference,
  case p_partkey % 12 when 1 then 'N/A' when 2 then ' Pending review' when 3 then 'unknown'
       when 4 then '' when 5 then 'TBD' else 'CC-BY-4.0' end as license_or_permission,
  case p_partkey % 13 when 1 then '2024-2-3' when 2 then '2024-02-30' when 3 then ''
       else '2024-02-29' end as license_verified_on,
  p_partkey % 4 = 1 as proxy, '' as notes from part""",
    "configs_v": """select 'cfg-' || cast(p_partkey as string) as config_id, family as algorithm_family,
  case when p_partkey % 17 = 0 then '' else 'hf-hub:org/' || p_type end as model_identifier,
  'v' || cast(p_size % 3 as string) as model_version,
  case p_partkey % 5 when 4 then 'mirror' when 3 then 'head_crop' else 'original' end
    as preprocessing,
  cast(case when p_partkey % 19 = 0 then 16 else 512 end as int) as max_side,
  cast(p_partkey % 2 as int) as seed,
  family = 'C' and p_partkey % 3 > 0 as has_training,
  case when family in ('B', 'C') and p_partkey % 7 > 0 then
    case when p_partkey % 23 = 0 then 'other/repo' else 'org/' || p_type end end as pin_repo,
  #[family || p_type || cast(p_size % 3 as string)]# as config_sha256
 from (select *, substr('ABCD', cast(cast(replace(p_brand, 'Brand#', '') as int) % 4 + 1 as int), 1)
         as family from part)""",
    "pins_v": """select 'pin-' || cast(p_partkey as string) as pin_id,
  case when p_partkey % 11 = 0 then 'mirror' else 'huggingface' end as source,
  case when p_partkey % 13 = 0 then ' ' else 'org/' || p_type end as repo_id,
  case when p_partkey % 7 = 0 then 'main' else substr(#[p_name]#, 1, 40) end as revision,
  'config.json' as config_file,
  case when p_partkey % 17 = 0 then 'absent.bin' else 'model.bin' end as weights_file,
  'mit' as license, 'research' as licence_scope,
  #['c' || cast(p_partkey as string)]# as config_digest,
  case when p_partkey % 19 = 0 then 'short' else #['w' || cast(p_partkey as string)]# end
    as weights_digest from part""",
    "users_v": f"""select k, {_uid("a", "k")} as id,
  case when k % 10 = 0 then null when k % 37 = 1 then 'x!'
       when k % 100 = 3 then 'Twin_' || cast(cast(floor(k / 100) as bigint) as string)
       when k % 100 = 4 then 'twin_' || cast(cast(floor(k / 100) as bigint) as string)
       else 'user_' || cast(k as string) end as username,
  case when k % 13 = 0 then '  ' when k % 17 = 0 then null else c_name end as display_name,
  case when k % 29 = 0 then 'english' else 'th' end as locale,
  case when k % 20 = 5 then 'BANNED' when c_mktsegment = 'FURNITURE' then 'SUSPENDED'
       when c_mktsegment = 'MACHINERY' then 'DELETED' else 'ACTIVE' end as status,
  1600000000000000 + k * 1000000 as created_us
 from (select c_custkey as k, c_name, c_mktsegment from customer)""",
    "identities_v": f"""select 'auth-' || lpad(cast(k as string), 9, '0') as id,
  {_uid("a", "case when k % 41 = 7 then k + 900000000 else k end")} as user_id,
  case when k % 43 = 2 then '  ' when cast(floor(k / 2) as bigint) % 2 = 0 then 'google'
       else 'apple' end as provider,
  'sub-' || cast(case when k % 61 = 9 then k - 1 else k end as string) as provider_subject
 from (select c_custkey as k from customer)""",
    "roles_v": f"""select {_uid("a", "c_custkey")} as user_id, 'USER' as role from customer
 union all select {_uid("a", "c_custkey")}, 'ADMIN' from customer where c_custkey % 20 = 0
 union all select {_uid("a", "c_custkey")}, 'KING' from customer where c_custkey % 33 = 0
 union all select {_uid("a", "c_custkey")}, 'USER' from customer where c_custkey % 71 = 0
 union all select {_uid("a", "c_custkey + 900000000")}, 'VERIFIER' from customer
   where c_custkey % 73 = 0""",
    "parks_v": f"""select {_uid("b", "r_regionkey")} as id,
  lower(replace(r_name, ' ', '-')) as slug, r_name as name, 'City ' || r_name as city,
  'TH' as country_code, 'Asia/Bangkok' as timezone,
  case when r_regionkey = 3 then 'INACTIVE' else 'ACTIVE' end as status from region""",
    "zones_v": f"""select {_uid("c", "n_nationkey")} as id, {_uid("b", "n_regionkey")} as park_id,
  'zone-' || cast(n_nationkey as string) as slug, n_name as name,
  case when n_nationkey % 7 = 6 then 'INACTIVE' else 'ACTIVE' end as status from nation""",
    "park_rows_v": f"""select {_uid("b", "k")} as id,
  case when k % 11 = 0 then 'Bad Slug'
       when k % 13 = 1 then 'same-' || cast(cast(floor(k / 26) as bigint) as string)
       when k % 53 = 2 then '  UPPER-' || cast(k as string) || ' '
       else 'park-' || cast(k as string) end as slug,
  case when k % 17 = 0 then '' else c_name end as name,
  case when k % 59 = 0 then repeat('c', 121) else 'City' end as city,
  case when k % 19 = 0 then 'th' else 'TH' end as country_code,
  case k % 7 when 0 then 'Local' when 1 then '' when 2 then 'Mars/Base' when 3 then 'Europe/Rome'
       when 4 then ' UTC' else 'Asia/Bangkok' end as timezone,
  case when k % 23 = 0 then 'OPEN' else 'ACTIVE' end as status
 from (select c_custkey as k, c_name from customer)""",
    "zone_rows_v": f"""select {_uid("c", "k")} as id,
  case when k % 37 = 3 then 'nowhere'
       else {_uid("b", "case when k % 31 = 5 then k + 900000000 else k % 5 end")} end as park_id,
  case when k % 11 = 0 then 'no_good' when k % 50 = 7 then 'east-' || cast(k % 100 as string)
       else 'zone-' || cast(k as string) end as slug,
  case when k % 17 = 0 then '' else c_name end as name,
  case when k % 23 = 0 then 'OPEN' else 'ACTIVE' end as status
 from (select c_custkey as k, c_name from customer)""",
    "hias_v": f"""select {_uid("f", "k")} as id,
  case when k % 9 = 4 then 1000000 + k else k + 1 end as public_number,
  case when k % 5 = 0 then null when k % 17 = 3 then '' else s_name end as nickname,
  case when k % 29 = 3 then 'GHOST' when k % 6 = 1 then 'MERGED' when k % 6 = 2 then 'CONFIRMED'
       else 'PROVISIONAL' end as status,
  case when k % 4 = 0 then null
       else {_uid("b", "case when k % 23 = 7 then k + 900000000 else s_nationkey % 5 end")} end
    as home_park_id,
  case when k % 19 = 1 then {_uid("f", "k")} when k % 31 = 7 then {_uid("f", "k + 900000000")}
       when k % 6 = 1 and k % 7 > 0 then {_uid("f", "k - 1")}
       when k % 13 = 0 then {_uid("f", "k + 1")} end as merged_into_hia_id
 from (select s_suppkey as k, s_name, s_nationkey from supplier)""",
    "encounters_v": f"""select k, {_uid("d", "k")} as id,
  case when k % 103 = 9 then 'bad'
       else {_uid("a", "case when k % 101 = 7 then k + 900000000 else o_custkey end")} end
    as observer_user_id,
  us + (k % 86400) * 1000000 as captured_us,
  case when k % 109 = 3 then null when o_orderstatus = 'O' then null
       else us + (k % 86400) * 1000000 + 3600000000 end as submitted_us,
  case when k % 11 = 0 then null
       else {_uid("b", "case when k % 13 = 0 then 77 when k % 17 = 0 then (c_nationkey + 1) % 5 else c_nationkey % 5 end")}
    end as park_id,
  case when k % 7 = 0 then null
       else {_uid("c", "case when k % 19 = 0 then 77 else c_nationkey end")} end as zone_id,
  case when k % 107 = 5 then 'LOST' when o_orderstatus = 'F' then 'SUBMITTED'
       when o_orderstatus = 'O' then 'DRAFT' else 'NEEDS_REVIEW' end as status,
  case when k % 113 = 11 then 'FLYING' else case k % 8 when 0 then 'BASKING' when 1 then 'SWIMMING'
       when 2 then 'WALKING' when 3 then 'RESTING' when 4 then 'EATING' when 5 then 'CLIMBING'
       when 6 then 'OTHER' end end as behavior,
  case when k % 127 = 4 then repeat('n', 2001) when k % 5 = 0 then '  ' when k % 5 = 1 then null
       else ' seen ' || o_orderpriority || ' ' end as notes
 from (select o_orderkey as k, o_custkey, o_orderstatus, o_orderpriority, c_nationkey,
         @us[o_orderdate]@ as us from orders join customer on o_custkey = c_custkey)""",
    "locations_v": f"""select
  {_uid("d", "case when k % 251 = 7 then k + 900000000 else k end")} as encounter_id,
  case when k % 211 = 0 then cast(95 as double) when k % 227 = 2 then cast('NaN' as double)
       else cast(13.7307 as double) + (k % 1000) * cast(0.00001 as double) end as lat,
  case when k % 223 = 1 then cast(-181 as double)
       else cast(100.5418 as double) + (k % 777) * cast(0.00001 as double) end as lon,
  case when k % 3 = 0 then null when k % 229 = 3 then cast(-1 as double)
       when k % 233 = 4 then cast('Infinity' as double)
       else cast(k % 50 as double) end as accuracy_meters,
  case when k % 239 = 5 then 'WIFI' else case k % 4 when 0 then 'GPS' when 1 then 'MANUAL'
       when 2 then 'IMPORT' else 'UNKNOWN' end end as source
 from (select o_orderkey as k from orders union all
       select o_orderkey from orders where o_orderkey % 241 = 6)""",
    "media_v": f"""select
  'm-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' ||
    cast(l_partkey as string) || '-' || cast(l_suppkey as string) as id,
  {_uid("d", "l_orderkey")} as encounter_id,
  l_linenumber * 100000000000000000 + l_partkey * 100000000 + l_suppkey as seq,
  case when l_partkey % 101 = 3 then 'VIDEO' else 'PHOTO' end as kind,
  case l_returnflag when 'R' then 'REJECTED' else 'READY' end as status,
  case when l_suppkey % 29 = 3 then 'image/gif' when l_suppkey % 2 = 0 then 'image/jpeg'
       else 'image/png' end as content_type,
  case l_partkey % 97 when 1 then 0 when 2 then 15728641
       else cast(floor(l_extendedprice) as bigint) end as byte_size,
  cast(case l_partkey % 89 when 5 then 12001 when 6 then 9000 else 100 + l_suppkey % 900 end as int)
    as width,
  cast(case l_partkey % 89 when 6 then 9000 else 200 + l_partkey % 900 end as int) as height,
  case when l_partkey % 83 = 1 then 'zz' else #['p' || cast(l_partkey % 9 as string)]# end as sha256,
  case when l_partkey % 79 = 1 then '../up' else 'photos/' ||
    lpad(cast(l_orderkey % 100000000 as string), 8, '0') || '-' ||
    lpad(cast(l_linenumber as string), 4, '0') || '-0000-0000-' ||
    lpad(cast(l_partkey % 1000 as string), 12, '0') ||
    case when l_suppkey % 2 = 0 then '.jpg' else '.png' end end as storage_key,
  @us[l_shipdate]@ as created_us
 from lineitem""",
    "uploads_v": f"""select
  'm-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' ||
    cast(l_partkey as string) || '-' || cast(l_suppkey as string) as upload_id,
  case when l_suppkey % 31 = 1 then 'nope'
       else {_uid("d", "case when l_suppkey % 31 = 2 then l_orderkey + 900000000 else l_orderkey end")}
    end as encounter_id,
  {_uid("a", "case when l_suppkey % 10 = 7 then o_custkey + 1 else o_custkey end")} as user_id,
  case l_suppkey % 5 when 0 then 'image/png' when 1 then 'IMAGE/JPEG; q=1' when 2 then 'text/plain'
       else 'image/jpeg' end as declared_type,
  case when l_partkey % 97 = 2 then 15728641 else cast(floor(l_extendedprice) as bigint) end
    as declared_size,
  case l_partkey % 97 when 1 then 0 when 2 then 15728641 when 3 then 15728642
       else cast(floor(l_extendedprice) as bigint) end as byte_size,
  case l_partkey % 7 when 0 then '89504E470D0A1A0A' when 1 then '474946383961' when 2 then 'FFD8'
       else 'FFD8FFE000104A46' end as head_hex,
  cast(case l_partkey % 89 when 5 then 12001 when 6 then 9000 when 7 then 0
       else 100 + l_suppkey % 900 end as int) as width,
  cast(case l_partkey % 89 when 6 then 9000 else 200 + l_partkey % 900 end as int) as height
 from lineitem join orders on l_orderkey = o_orderkey""",
    "edit_log_v": f"""select
  'u' || cast(user_id as string) || '-w' ||
    cast(cast(floor(@us[ts]@ / 604800000000) as bigint) as string) as encounter_id,
  event_id as seq,
  case event_type when 'signup' then 'create' when 'purchase' then 'submit'
       when 'error' then 'note' else 'patch' end as op,
  @us[ts]@ as at_us,
  event_id % 6 = 0 as captured_set, @us[ts]@ - 60000000 as captured_us,
  event_id % 3 = 0 as park_set,
  case when event_id % 5 = 4 then null when event_id % 29 = 1 then {_uid("b", "77")}
       when event_id % 31 = 1 then 'here' else {_uid("b", "event_id % 4")} end as park_id,
  event_id % 4 < 2 as zone_set,
  case when event_id % 7 = 6 then null when event_id % 23 = 1 then {_uid("c", "77")}
       else {_uid("c", "event_id % 25")} end as zone_id,
  event_id % 2 = 0 as behavior_set,
  case event_id % 9 when 0 then 'BASKING' when 1 then 'FLYING' when 2 then null when 3 then 'EATING'
       when 4 then 'WALKING' else 'OTHER' end as behavior,
  event_id % 5 < 2 as notes_set,
  case when event_id % 10 = 0 then '  ' when event_id % 83 = 1 then repeat('n', 2001)
       else ' note ' || cast(event_id as string) || ' ' end as notes
 from events""",
    "location_log_v": f"""select {_uid("d", "user_id")} as encounter_id, event_id as seq,
  event_id % 9 = 4 as cleared, @us[ts]@ as at_us,
  cast(13 as double) + value / 1000 as lat, cast(100 as double) + value / 500 as lon,
  case when event_id % 3 = 0 then null else cast(event_id % 50 as double) end as accuracy_meters,
  case event_id % 2 when 0 then 'GPS' else 'MANUAL' end as source from events""",
    "seal_log_v": """select event_id as seq, 'split-' || cast(user_id % 10 as string) as split_sha256,
  'c' || cast(event_id % 4 as string) as config_sha256,
  'k' || cast(cast(floor(event_id / 7) as bigint) % 3 as string) as calibration_sha256,
  'c' || cast((event_id + 1) % 4 as string) as also_registered from events""",
    "login_log_v": """select event_id as seq,
  case when event_id % 211 = 3 then ' ' when user_id % 2 = 0 then 'google' else 'apple' end
    as provider,
  'sub-' || cast(user_id as string) as provider_subject, @us[ts]@ as at_us from events""",
    "profile_log_v": f"""select event_id as seq, {_uid("a", "user_id")} as user_id, @us[ts]@ as at_us,
  case event_id % 6 when 0 then 'Name_' || cast(event_id % 900 as string) when 1 then 'a!'
       when 2 then 'user_' || cast(event_id % 3000 as string) end as username,
  case event_id % 5 when 0 then '   ' when 1 then ' Finder ' || cast(event_id as string) end
    as display_name,
  case event_id % 7 when 0 then 'en-GB' when 1 then 'EN' end as locale from events""",
    "patches_v": {
        "spark": "select 'p-' || cast(event_id as string) as patch_id, event_id as n from events",
        "check": "select 'p-' || cast(event_id as string) as patch_id, event_id as n from events",
    },
    # image-level scores: one order is one query photo, each line one gallery photo
    "scores_v": {
        # rounded as binary numbers; Spark's round(x, 2) would round the decimal digits that x is shown with
        "spark": _SCORES.format("round(l_extendedprice / 110000 * 100, 0) / 100"),
        "check": _SCORES.format("round(l_extendedprice / 110000, 2)"),
    },
    "truth_v": """select 'q-' || lpad(cast(l_orderkey as string), 10, '0') as query_id,
  'side-' || lpad(cast(max(l_linenumber * 1000 + l_suppkey % 50) % 1000 as string), 2, '0')
    as side_id,
  case l_orderkey % 7 when 0 then '' when 1 then 'rain' when 2 then 'shade' else 'sun' end as light
 from lineitem where l_orderkey % 4 <> 0 group by l_orderkey""",
}


def _fill(text: str, dialect: str) -> str:
    """Render markers, innermost first."""
    marks = _MARKS[dialect]
    pattern = re.compile(r"@(us|iso)\[((?:(?!@us\[|@iso\[|\]@).)*)\]@", re.S)
    while pattern.search(text):
        text = pattern.sub(lambda m: marks[m[1]].format(m[2]), text)
    return re.sub(r"#\[(.*?)\]#", lambda m: marks["#"].format(m[1]), text, flags=re.S)


def view_sql(name: str, dialect: str) -> str:
    body = VIEWS[name]
    return _fill(body[dialect] if isinstance(body, dict) else body, dialect)


def _needs(text: str, names: list[str]) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", text)]


def check_sql(body: str) -> str:
    """A self-contained checking statement: the views the body uses, then the body."""
    body = _fill(body, "check")
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text, list(VIEWS)):
            if name not in wanted:
                visit(view_sql(name, "check"))
                wanted.append(name)

    visit(body)
    ctes = ",\n".join(f"{n} as ({view_sql(n, 'check')})" for n in wanted)
    stripped = body.lstrip()
    if not wanted:
        return stripped
    if stripped.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{stripped[len('with recursive'):]}"
    if stripped.lower().startswith("with"):
        return f"with {ctes},\n{stripped[len('with'):]}"
    return f"with {ctes}\n{stripped}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view(
    spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None
) -> DataFrame:
    """One view; ``given`` replaces base tables, for instance by a stream."""
    given = given or {}
    text = view_sql(name, "spark")
    for other in _needs(text, list(VIEWS)):
        text = re.sub(rf"\b{other}\b", "{" + other + "}", text)
    tables = _needs(text, TABLES)
    for used in tables:
        text = re.sub(rf"(from|join) {used}\b", r"\1 {" + used + "}", text)
    sources = {
        n: given[n] if n in given else table(spark, sf_dir, n)
        for n in tables
        if "{" + n + "}" in text
    }
    sources |= {n: view(spark, sf_dir, n, given) for n in VIEWS if "{" + n + "}" in text}
    return ready(spark).sql(text, **sources)


def manifest(spark: SparkSession, sf_dir: str, name: str = "manifest_v") -> DataFrame:
    """A manifest view with its ``attr_`` columns folded into one map."""
    from spoorline.operators.keys import fold_attributes

    return fold_attributes(view(spark, sf_dir, name)).drop("v")


def micros_to_time(df: DataFrame) -> DataFrame:
    """Every ``*_us`` column as a timestamp ``*_at`` (``at_us`` as ``at``)."""
    for c in [c for c in df.columns if c.endswith("_us")]:
        name = "at" if c == "at_us" else c[:-3] + "_at"
        df = df.withColumn(name, F.timestamp_micros(c)).drop(c)
    return df
