"""The core queries as SQL for DuckDB, written from the definitions and not from the Spark plans."""

from __future__ import annotations

_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim_all(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def null_if_blank(x: str) -> str:
    return f"nullif({trim_all(x)}, '')"


def match_name(normal: str, raw: str) -> str:
    return f"coalesce(nullif(upper({collapse(normal)}), ''), nullif(upper({collapse(raw)}), ''), '')"


def location_key(x: str) -> str:
    return f"lower(trim(regexp_replace(translate(coalesce({x}, ''), 'ñÑ', 'nn'), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')))"


def one_byte(x: str) -> str:
    """Other letters as unused ASCII signs, since DuckDB's edit distance counts bytes."""
    return f"translate({x}, 'ÑÉÍÓÁÚÜÏÖÄËÈÀÇñéíóáúü', '!#$%&*+=<>?@[]^_{{|}}~;')"


def edges(a: str, b: str, otherwise: str) -> str:
    return f"case when {a} = '' and {b} = '' then 100.0::double when {a} = '' or {b} = '' then 0.0::double when {a} = {b} then 100.0::double else {otherwise} end"


def lev(a: str, b: str) -> str:
    return edges(a, b, f"round(100.0::double * (1 - levenshtein({one_byte(a)}, {one_byte(b)})::double / greatest(length({a}), length({b}))), 6)")


def ham(a: str, b: str) -> str:
    off = f"len(list_filter(range(1, length({a}) + 1), lambda k: substr({a}, k, 1) <> substr({b}, k, 1)))"
    return edges(a, b, f"case when length({a}) <> length({b}) then 0.0::double else round(100.0::double * (1 - {off}::double / length({a})), 6) end")


def jaro_ctes(pairs: str, name: str = "jw") -> str:
    """CTEs that end in name(a, b, j, w): Jaro and its Winkler form of the distinct non-empty pairs (a, b) of a relation."""
    return f"""
      {name}_p as (select distinct a, b, string_split(a, '') x, string_split(b, '') y from {pairs} where a <> '' and b <> '' and a <> b),
      {name}_q as (select *, greatest(greatest(len(x), len(y)) // 2 - 1, 0) win from {name}_p),
      {name}_r(a, b, x, y, win, i, used, mine) as (
        select a, b, x, y, win, 1, []::bigint[], []::varchar[] from {name}_q
        union all
        select a, b, x, y, win, i + 1, case when j is null then used else list_append(used, j) end, case when j is null then mine else list_append(mine, x[i]) end
        from (select *, list_filter(range(greatest(i - win, 1), least(i + win, len(y)) + 1), lambda k: y[k] = x[i] and not list_contains(used, k))[1] j from {name}_r where i <= len(x))),
      {name}_m as (select a, b, x, y, mine, list_transform(list_sort(used), lambda k: y[k]) other, len(used)::double m from {name}_r where i = len(x) + 1),
      {name}_j as (select a, b, case when m = 0 then 0.0::double else (m / len(x) + m / len(y) + (m - len(list_filter(range(1, m::bigint + 1), lambda k: mine[k] <> other[k])) / 2.0::double) / m) / 3.0::double end j,
        case when x[1:4] = y[1:4] and len(x) >= 4 and len(y) >= 4 then 4 when x[1:3] = y[1:3] and len(x) >= 3 and len(y) >= 3 then 3 when x[1:2] = y[1:2] and len(x) >= 2 and len(y) >= 2 then 2 when x[1] = y[1] then 1 else 0 end l from {name}_m),
      {name} as (select a, b, j, j + l * 0.1::double * (1.0::double - j) w from {name}_j)"""


def jw_score(a: str, b: str, w: str = "w") -> str:
    return edges(a, b, f"round(100.0::double * {w}, 6)")


def birth(prefix: str = "") -> str:
    p = prefix
    return f"coalesce({null_if_blank(p + 'birthdate_iso')}, case when {p}birth_month is not null and {p}birth_day is not null and {p}birth_year is not null then printf('%04d-%02d-%02d', {p}birth_year, {p}birth_month, {p}birth_day) end, '')"


def comparable(where: str = "coalesce(record_status, '') <> 'DELETED'") -> str:
    name = lambda part, col: f"{match_name('norm_' + col, col)} as {part}"
    return f"""(select internal_uuid, {name("last", "last_name")}, {name("first", "first_name")}, {name("middle", "middle_name")}, {name("extension", "extension_name")},
        coalesce({null_if_blank("city_code")}, '') city, coalesce({null_if_blank("barangay_code")}, '') barangay, {birth()} birth, coalesce(printf('%04d', birth_year), '') as year
        from beneficiaries where {where})"""


_KEYS = f"""
    r as {comparable()},
    keyed as (select distinct internal_uuid, unnest([case when city <> '' then 'C|' || city || '|' || left("last", 1) end, case when city <> '' then 'C|' || city || '|' || left("first", 1) end,
      case when barangay <> '' and year <> '' then 'B|' || barangay || '|' || year end, 'N|' || left("last", 3) || '|' || left("first", 3)]) block_key from r),
    keys as (select * from keyed where block_key is not null),
    pairs as (select distinct a.internal_uuid uuid_a, b.internal_uuid uuid_b from keys a join keys b using (block_key) where a.internal_uuid < b.internal_uuid)"""


def _tri(a: str, b: str) -> str:
    return f"(case when {a} = '' or {b} = '' then null when {a} = {b} then 1 else 2 end)::int"


def _scored(two: str) -> str:
    """Component scores of a relation with the fields of both sides; needs jw over its first names."""
    return f"""select uuid_a, uuid_b, {jw_score("first_a", "first_b")} first_name_score, {lev("middle_a", "middle_b")} middle_name_score, {lev("last_a", "last_b")} last_name_score,
        {ham("extension_a", "extension_b")} extension_name_score, {_tri("birth_a", "birth_b")} birthdate_compare, {_tri("barangay_a", "barangay_b")} barangay_compare
        from {two} left join jw on jw.a = first_a and jw.b = first_b"""


_FIELDS = ", ".join(f'{x}."{c}" as {c}_{x}' for x in "ab" for c in ("last", "first", "middle", "extension", "birth", "barangay"))
_TOTAL = "round(0.49::double * first_name_score + 0.05::double * middle_name_score + 0.45::double * last_name_score + 0.01::double * extension_name_score, 6)"
_MATCHES = f"""{_KEYS},
    two0 as (select uuid_a, uuid_b, {_FIELDS} from pairs join r a on a.internal_uuid = uuid_a join r b on b.internal_uuid = uuid_b),
    two as (select * from two0 where {lev("last_a", "last_b")} >= 77),
    names as (select first_a a, first_b b from two), {jaro_ctes("names")},
    parts as ({_scored("two")}),
    matches as (select *, {_TOTAL} total_score, uuid_a || '|' || uuid_b pair_key from parts where {_TOTAL} >= 90)"""

_EIGHT = [f"{x}_{y}" for x in ("region", "province", "city", "barangay") for y in ("code", "name")]


def _edge(x: str) -> str:
    return f"coalesce({trim_all(x)}, '')"


def squeezed(x: str) -> str:
    """Trimmed, with single spaces, null being empty."""
    return collapse(f"coalesce({x}, '')")


def _lower(x: str) -> str:
    """Lower case with single spaces."""
    return f"lower({squeezed(x)})"


_CHAINS = f"""(select r.region_code, {_edge("r.region_name")} region_name, p.province_code, {_edge("p.province_name")} province_name, c.city_code, {_edge("c.city_name")} city_name, b.barangay_code, {_edge("b.barangay_name")} barangay_name,
      p.region_code = r.region_code and c.region_code = r.region_code and b.region_code = r.region_code and coalesce({trim_all("c.province_code")} = p.province_code, true) and coalesce({trim_all("b.province_code")} = p.province_code, true) as consistent
    from barangays b join cities c on c.city_code = b.city_code
    join provinces p on p.province_code = coalesce({null_if_blank("b.province_code")}, {null_if_blank("c.province_code")})
    join regions r on r.region_code = case when b.region_code in (select region_code from regions) then b.region_code else p.region_code end)"""

# What follows 'region' up to the next 'region', two words at most.
_ALIASES = f"""(select alias, arg_min(region_name, region_code) region_name from (
    select region_code, region_name, unnest([{_lower("region_code")}, k, joined, replace(joined, ' ', ''), 'region ' || joined,
      case k when 'national capital region' then 'ncr' when 'cordillera administrative region' then 'car' when 'autonomous region in muslim mindanao' then 'armm' when 'bangsamoro autonomous region in muslim mindanao' then 'barmm' end]) alias
    from (select *, nullif(case when w[1] = 'region' then array_to_string(list_slice(case when list_position(w[2:], 'region') > 0 then w[2:list_position(w[2:], 'region')] else w[2:] end, 1, 2), ' ') end, '') joined
      from (select region_code, {_edge("region_name")} region_name, {_lower("region_name")} k, string_split({_lower("region_name")}, ' ') w from regions) where region_name <> '')) where alias <> '' group by alias)"""

_TYPED = "select distinct " + ", ".join(f"{squeezed(c)} as {x}" for c, x in (("region", "region"), ("province", "province"), ("city_municipality", "city"), ("barangay", "barangay"))) + " from import_rows"


def _normalize(typed: str = _TYPED) -> str:
    """CTEs that end in normalized: each level narrows the chains left by the levels above to its exact matches, if there are any."""
    levels = ("region", "province", "city", "barangay")
    asked = lambda x: "asked" if x == "region" else x
    match = lambda x: f"{asked(x)} <> '' and (lower({asked(x)}) = lower({x}_code) or lower({asked(x)}) = {_lower(x + '_name')})"
    by = ", ".join(levels)
    steps = [f"n0 as (select *, {', '.join(f'({match(x)}) as m_{x}' for x in levels)} from keyed, {_CHAINS})"]
    for i, x in enumerate(levels, 1):
        steps.append(f"n{i} as (select * from (select *, bool_or(m_{x}) over (partition by {by}) as some_{x} from n{i - 1}) where not some_{x} or m_{x})")
    whole = " and ".join(f"({asked(x)} = '' or m_{x})" for x in levels)
    keys = {x: location_key(asked(x)) for x in levels}
    filled = " + ".join(f"(k_{x} <> '')::int" for x in levels)
    score = lambda x: f"case when k_{x} = '' or l_{x} = '' then 0.0::double when k_{x} = l_{x} then 1.0::double else least(greatest(coalesce(s_{x}.w, 0.0::double), 0.0::double), 1.0::double) end"
    pairs = " union ".join(f"select k_{x} a, l_{x} b from toscore where k_{x} <> ''" for x in levels)
    joins = " ".join(f"left join jw s_{x} on s_{x}.a = k_{x} and s_{x}.b = l_{x}" for x in levels)
    eight, nulls = ", ".join(_EIGHT), ", ".join(f"null::varchar as {c}" for c in _EIGHT)
    code = " || '|' || ".join(f"{x}_code" for x in levels)
    return f"""
      typed as ({typed}),
      keyed as (select coalesce(al.region_name, t.region) asked, t.* from typed t left join {_ALIASES} al on al.alias = lower(t.region)),
      {", ".join(steps)},
      counted as (select *, count(*) over (partition by {by}) = 1 and {whole} as alone, {", ".join(f"{keys[x]} as k_{x}" for x in levels)}, {", ".join(f"{location_key(x + '_name')} as l_{x}" for x in levels)} from n4),
      toscore as (select * from counted where not alone and {filled} > 0),
      pairs_n as ({pairs}), {jaro_ctes("pairs_n")},
      ranked as (select *, row_number() over w place, lead(score) over w as runner_up from (select toscore.*, ({" + ".join(score(x) for x in levels)}) / ({filled}) score from toscore {joins}) window w as (partition by {by} order by score desc, {code})),
      decided as (
        select {by}, {eight}, consistent, 'EXACT' source, 1.0::double confidence, null::varchar said from counted where alone
        union all
        select {by}, {eight}, consistent, null, score, case when abs(score - runner_up) < 0.01 then 'ambiguous location candidates' when score < 0.95 then 'confidence below threshold' end from ranked where place = 1
        union all
        select {by}, {nulls}, false, 'NONE', 0.0::double, 'no location candidate matched' from counted where not alone and {filled} = 0 group by {by}),
      normalized as (select {by}, {eight}, case when said is null and consistent then 'AUTO_APPLIED' else 'REVIEW_NEEDED' end status, coalesce(source, case when said is null and confidence = 1 then 'EXACT' else 'FUZZY' end) match_source, confidence,
        coalesce(said, case when not consistent then 'could not resolve a unique full hierarchy chain' end) reason from decided)"""


def _legacy() -> str:
    fit = lambda x, code, name: f"({trim_all(x)} <> '' and (lower({trim_all(x)}) = lower({code}) or {location_key(x)} = {location_key(name)}))"
    return f"""
      typed as ({_TYPED}), cat as {_CHAINS},
      l1 as (select t.*, count(distinct c.region_code) n1, min(c.region_code) r1 from typed t left join (select distinct region_code, region_name from cat) c on {fit("t.region", "c.region_code", "c.region_name")} group by all),
      l2 as (select t.*, count(distinct c.province_code) n2, min(c.province_code) r2 from l1 t left join (select distinct region_code, province_code, province_name from cat) c on n1 = 1 and c.region_code = r1 and {fit("t.province", "c.province_code", "c.province_name")} group by all),
      l3 as (select t.*, count(distinct c.city_code) n3, min(c.city_code) r3 from l2 t left join (select distinct region_code, province_code, city_code, city_name from cat) c
        on n1 = 1 and (n2 = 1 or province = '') and c.region_code = r1 and (province = '' or c.province_code = r2) and {fit("t.city", "c.city_code", "c.city_name")} group by all),
      l4 as (select t.*, count(distinct c.barangay_code) n4, min(c.barangay_code) r4 from l3 t left join (select distinct region_code, city_code, barangay_code, barangay_name from cat) c
        on n1 = 1 and (n2 = 1 or province = '') and n3 = 1 and c.city_code = r3 and {fit("t.barangay", "c.barangay_code", "c.barangay_name")} group by all),
      legacy as (select region, province, city, barangay,
        case when n1 = 0 then 'no region found' when n1 > 1 then 'region is ambiguous' when province <> '' and n2 = 0 then 'no province found' when province <> '' and n2 > 1 then 'province is ambiguous'
          when n3 = 0 then 'no city found' when n3 > 1 then 'city is ambiguous' when n4 = 0 then 'no barangay found' when n4 > 1 then 'barangay is ambiguous' end error,
        c.region_code, c.region_name, c.province_code, c.province_name, c.city_code, c.city_name, c.barangay_code, c.barangay_name
        from l4 left join cat c on c.barangay_code = case when n1 = 1 and (province = '' or n2 = 1) and n3 = 1 and n4 = 1 then r4 end)"""


def birth_error_sql(iso: str, m: str, d: str, y: str) -> str:
    day = lambda s: f"try_strptime(case when regexp_full_match({s}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then {s} end, '%Y-%m-%d')"
    i = null_if_blank(iso)
    given = f"(({m} is not null)::int + ({d} is not null)::int + ({y} is not null)::int)"
    return f"""case when {i} is not null then
          case when {day(i)} is null then 'birthdate_iso must be YYYY-MM-DD' when year({day(i)}) not between 1800 and 3000 then 'birth_year must be between 1800 and 3000'
            when {m} <> month({day(i)}) or {d} <> day({day(i)}) or {y} <> year({day(i)}) then 'birthdate_iso and birth parts disagree' end
        when {given} between 1 and 2 then 'birth month, day and year must be given together' when {m} not between 1 and 12 then 'birth_month must be between 1 and 12' when {d} not between 1 and 31 then 'birth_day must be between 1 and 31'
        when {y} not between 1800 and 3000 then 'birth_year must be between 1800 and 3000'
        when {given} = 3 and {day(f"printf('%04d-%02d-%02d', {y}, {m}, {d})")} is null then 'birth date is not a valid calendar date' end"""


def _is_blank(x: str) -> str:
    return f"coalesce({trim_all(x)}, '') = ''"


_REQUIRED = ("last_name", "first_name", "region_code", "region_name", "province_code", "province_name", "city_code", "city_name", "barangay_code", "barangay_name", "sex")
_ERROR = f"""coalesce({", ".join(f"case when {_is_blank(c)} then '{c} is required' end" for c in _REQUIRED)}, {birth_error_sql("birthdate_iso", "birth_month", "birth_day", "birth_year")})"""
_EXACT = "concat_ws(chr(31), " + ", ".join(f"coalesce(trim({c}), '')" for c in ("norm_last_name", "norm_first_name", "norm_middle_name", "norm_extension_name", "region_code", "province_code", "city_code", "barangay_code", "birthdate_iso", "contact_no_norm", "sex")) + ")"

_BACKFILL_RAW = ", ".join(f"{squeezed(f'coalesce({null_if_blank(x + "_name")}, {null_if_blank(x + "_code")})')} as raw_{x}" for x in ("region", "province", "city", "barangay"))
_BACKFILL_TYPED = f"select distinct raw_region region, raw_province province, raw_city city, raw_barangay barangay from (select {_BACKFILL_RAW} from beneficiaries)"
_BACKFILLED = f"""
      raw as (select *, {_BACKFILL_RAW} from beneficiaries),
      resolved as (select raw.*, {", ".join(f"n.{c} resolved_{c}" for c in _EIGHT)}, n.match_source, n.confidence, n.status said_status, n.reason said_reason, n.status = 'AUTO_APPLIED' and (raw_region = '' or raw_province = '' or raw_city = '' or raw_barangay = '') forced
        from raw join normalized n on n.region = raw_region and n.province = raw_province and n.city = raw_city and n.barangay = raw_barangay),
      backfilled as (select *, case when forced then 'REVIEW_NEEDED' else said_status end status, case when forced then 'raw location chain incomplete' else said_reason end reason,
        said_status = 'AUTO_APPLIED' and not forced and ({" or ".join(f"coalesce({trim_all(c)}, '') <> coalesce({trim_all('resolved_' + c)}, '')" for c in _EIGHT)}) updated from resolved)"""
_OF = {"region": "regions", "province": "provinces", "city": "cities", "barangay": "barangays"}


def _parents() -> str:
    levels, out = list(_OF), []
    for i, x in enumerate(levels[1:], 1):
        for j, y in enumerate(levels[:i]):
            faults = [f"case when p.{y}_code is null then '{x} ' || c.{x}_code || ' references unknown {y} ' || c.{y}_code end"]
            faults += [f"case when p.{z}_code is distinct from c.{z}_code then '{x} ' || c.{x}_code || ' names another {z} than {y} ' || c.{y}_code end" for z in levels[:j]]
            out.append(f"select '{x}' as level, c.{x}_code code, coalesce({', '.join(faults)}) fault from {_OF[x]} c left join {_OF[y]} p using ({y}_code)")
    return f"select * from ({' union all '.join(out)}) where fault is not null"


_PARENTS = _parents()

_DISPOSED = f"""
      live as (select * from beneficiaries where record_status <> 'DELETED'),
      d as (select *, batch_no * 10000000 + row_no n, {_ERROR} err, {_EXACT} k, {null_if_blank("source_reference")} ref from new_beneficiaries),
      e as (select *, ref in (select {null_if_blank("source_reference")} from live where {null_if_blank("source_reference")} is not null) known, k in (select {_EXACT} from live) same from d),
      f as (select *, err is null and not coalesce(known, false) and not same cand from e),
      g as (select *, cand and (ref is null or row_number() over (partition by ref, cand order by n) = 1) opened from f),
      disposed as (select *, opened and row_number() over (partition by k, opened order by n) = 1 ins from g),
      outcome as (select *, case when err is not null then 'failed' when ins then 'inserted' else 'skipped' end disposition,
        case when err is not null then err when known then 'source_reference exists' when ins then null when not opened and not same then 'source_reference exists' else 'exact duplicate' end message from disposed)"""


_OPTIONAL = ("norm_middle_name", "norm_extension_name", "birthdate_iso", "contact_no_norm", "region_code", "province_code", "city_code", "barangay_code", "sex")


def entry(x: str) -> str:
    return f"regexp_replace({trim_all(x)}, '[\\t\\n\\f\\r ]+', ' ', 'g')"


def guard(x: str) -> str:
    return f"case when regexp_matches({x}, '^[ \\t\\r\\n]*[=+\\-@]') then '''' || {x} else {x} end"


def _export() -> str:
    named = lambda p: f"coalesce({null_if_blank(p + '_name')}, {null_if_blank(p + '_code')}, '')"
    padded = lambda c, n: f"coalesce(lpad({c}::varchar, {n}, '0'), '')"
    columns = {"id": "generated_id", "last_name": "last_name", "first_name": "first_name", "middle_name": "middle_name", "extension_name": "extension_name", "region": named("region"), "province": named("province"), "city_municipality": named("city"), "barangay": named("barangay"),
               "contact_no": "contact_no", "month_mm": padded("birth_month", 2), "day_dd": padded("birth_day", 2), "year_yyyy": padded("birth_year", 4), "sex": "sex"}
    inner = ", ".join(f"coalesce({v}, '') as {k}" for k, v in columns.items())
    return f"select {', '.join(f'{guard(k)} as {k}' for k in columns)} from (select {inner} from beneficiaries where record_status in ('ACTIVE', 'RETAINED') and coalesce(duplicate_status, '') <> 'POSSIBLE_DUPLICATE')"


_PUBLIC = f"""
      src as (select *, {", ".join(f"{squeezed(c)} as raw_{x}" for c, x in (("region", "region"), ("province", "province"), ("city_municipality", "city"), ("barangay", "barangay")))} from import_rows),
      pub as (select s.row_id, s.source_reference, s.last_name, s.first_name, s.middle_name, s.extension_name, s.contact_no, s.sex, s.month_mm, s.day_dd, s.year_yyyy, s.raw_barangay, n.region_code, n.province_code, n.city_code, n.barangay_code, n.region_name, n.province_name, n.city_name, n.barangay_name, n.status, n.confidence, n.match_source,
        raw_region = '' or raw_province = '' or raw_city = '' or raw_barangay = '' missing from src s join normalized n on n.region = raw_region and n.province = raw_province and n.city = raw_city and n.barangay = raw_barangay),
      nums as (select *, not missing and (barangay_code is null or status <> 'AUTO_APPLIED' and confidence < 0.9) review, {", ".join(f"case when regexp_full_match({trim_all(c)}, '[+-]?[0-9]{{1,18}}') then {trim_all(c)}::bigint end as {x}" for c, x in (("month_mm", "m"), ("day_dd", "dd"), ("year_yyyy", "y")))} from pub),
      faults as (select *, case when review then null else coalesce(case when missing then 'region, province, city_municipality, and barangay are required' end, {", ".join(f"case when not {_is_blank(c)} and {x} is null then '{c} must be a whole number' end" for c, x in (("month_mm", "m"), ("day_dd", "dd"), ("year_yyyy", "y")))},
        {", ".join(f"case when {_is_blank(c)} then '{c} is required' end" for c in ("last_name", "first_name", "sex"))}, {birth_error_sql("null::varchar", "m", "dd", "y")}) end err from nums),
      d as (select *, upper({entry("last_name")}) norm_last_name, upper({entry("first_name")}) norm_first_name, upper({null_if_blank(entry("middle_name"))}) norm_middle_name, upper({null_if_blank(entry("extension_name"))}) norm_extension_name,
        nullif(regexp_replace({null_if_blank(entry("contact_no"))}, '[^0-9]', '', 'g'), '') contact_no_norm, case when m is not null and dd is not null and y is not null then printf('%04d-%02d-%02d', y, m, dd) end birthdate_iso, {null_if_blank("source_reference")} ref from (select * exclude (sex), upper(coalesce({entry("sex")}, '')) sex from faults)),
      live as (select * from beneficiaries where record_status <> 'DELETED'),
      e as (select *, {_EXACT} k from d), e2 as (select *, coalesce(ref in (select {null_if_blank("source_reference")} from live where {null_if_blank("source_reference")} is not null), false) known, k in (select {_EXACT} from live) same from e),
      f as (select *, not review and err is null and not known and not same may from e2),
      g as (select *, may and (ref is null or row_number() over (partition by ref, may order by row_id) = 1) opened from f),
      h as (select *, opened and row_number() over (partition by k, opened order by row_id) = 1 ins from g),
      outcome as (select *, case when review then 'skipped' when err is not null then 'failed' when ins then 'inserted' else 'skipped' end disposition,
        case when review then 'location needs review' when err is not null then err when known then 'source_reference exists' when ins then null when not opened and not same then 'source_reference exists' else 'exact duplicate' end message from h)"""

_REQUESTS = """with sides as (select match_id, min(pair_key) pair_key, min(record_a_uuid) a, min(record_b_uuid) b from scored_pairs where pair_key is not null and decision_status = 'RESOLVED' and match_id is not null group by match_id),
            asked as (select *, case when match_id like '%1' or match_id like '%5' then 'DELETE_A_SOFT' when match_id like '%2' then 'DELETE_B_SOFT' else 'RETAIN_BOTH' end decision from sides)"""


def oracle_sql() -> dict[str, str]:
    whole = lambda x: f"regexp_full_match({trim_all(x)}, '[+-]?[0-9]{{1,18}}')"
    number = lambda x: f"case when regexp_full_match(trim({x}), '[0-9]{{1,9}}') then trim({x})::bigint end"
    return {
        "er_blocking_keys": f"with {_KEYS} select internal_uuid, block_key from keys",
        "er_candidate_pairs": f"with {_KEYS} select uuid_a, uuid_b from pairs",
        "er_scored_matches": f"with recursive {_MATCHES} select * from matches",
        "er_run_totals": f"with recursive {_MATCHES} select (select count(*) from pairs) total_candidates, (select count(*) from matches) total_matches",
        "er_run_rows": f"with recursive {_MATCHES} select 'run-1-' || case when n < 100000 then lpad(n::varchar, 5, '0') else n::varchar end match_id, 'run-1' run_id, pair_key, total_score, 'PENDING' decision_status from (select *, row_number() over (order by total_score desc, pair_key) n from matches)",
        "er_hide_decided": "select match_id, run_id, pair_key from scored_pairs s where decision_status = 'PENDING' and not exists (select 1 from scored_pairs r where r.decision_status = 'RESOLVED' and r.pair_key = s.pair_key)",
        "er_group_scores": f"""with recursive g as (select distinct group_id, internal_uuid from reviewed_groups), r as {comparable("true")},
            pairs as (select distinct a.internal_uuid uuid_a, b.internal_uuid uuid_b from g a join g b using (group_id) where a.internal_uuid < b.internal_uuid),
            two as (select uuid_a, uuid_b, {_FIELDS} from pairs join r a on a.internal_uuid = uuid_a join r b on b.internal_uuid = uuid_b),
            names as (select first_a a, first_b b from two), {jaro_ctes("names")}, parts as ({_scored("two")})
            select *, {_TOTAL} total_score, uuid_a || '|' || uuid_b pair_key from parts""",
        "sim_names": f"""with recursive n as (select distinct upper(last_name) a, upper(first_name) b from partner_register where last_name is not null and first_name is not null), {jaro_ctes("n")}
            select n.a, n.b, {lev("n.a", "n.b")} levenshtein, {ham("n.a", "n.b")} hamming, {jw_score("n.a", "n.b")} jaro_winkler from n left join jw on jw.a = n.a and jw.b = n.b""",
        "geo_chains": f"select * from {_CHAINS}",
        "geo_candidates": f"with recursive {_normalize()} select region, province, city, barangay, place::int place, round(score, 9) score, barangay_code from ranked where place <= 10",
        "geo_shadow_totals": f"""with recursive {_normalize()}, {_legacy().replace(f"typed as ({_TYPED}), ", "")},
            both_ as (select status = 'AUTO_APPLIED' ap, error is null old, {" or ".join(f"n.{c} is distinct from l.{c}" for c in _EIGHT)} other from normalized n join legacy l using (region, province, city, barangay))
            select count(*) total_rows, count(*) filter (ap) auto_apply_rows, count(*) filter (not ap) review_rows, count(*) filter (ap <> old or ap and old and other) drift_rows from both_""",
        "geo_backfill": f"""with recursive {_normalize(_BACKFILL_TYPED)}, {_BACKFILLED}
            select internal_uuid, status, match_source, round(confidence, 9) confidence, reason, resolved_barangay_code, updated from backfilled""",
        "geo_backfill_counts": f"""with recursive {_normalize(_BACKFILL_TYPED)}, {_BACKFILLED}
            select count(*) total_rows, count(*) filter (status = 'AUTO_APPLIED') auto_applied_rows, count(*) filter (status <> 'AUTO_APPLIED') review_rows, count(*) filter (updated) updated_rows from backfilled""",
        "geo_lineage": f"""with recursive {_normalize(_BACKFILL_TYPED)}, {_BACKFILLED}
            select row_number() over (order by last_name nulls first, first_name nulls first, middle_name nulls first, extension_name nulls first, generated_id nulls first, internal_uuid) row_number,
              coalesce({null_if_blank("source_reference")}, {null_if_blank("generated_id")}, {null_if_blank("internal_uuid")}) item_reference, raw_barangay, resolved_barangay_code, status, status <> 'AUTO_APPLIED' needs_review from backfilled""",
        "geo_parent_faults": _PARENTS,
        "geo_chain_fault": f"""select partner_row, coalesce(case when {" or ".join(_is_blank("n." + x + "_code") for x in ("region", "province", "city", "barangay"))} then 'location codes are required' end,
            {", ".join(f"case when {x[0]}.{x}_code is null then 'unknown {x} ' || {trim_all(f'n.{x}_code')} end" for x in ("region", "province", "city", "barangay"))},
            case when p.region_code <> {trim_all("n.region_code")} then 'province ' || {trim_all("n.province_code")} || ' does not belong to region ' || {trim_all("n.region_code")} end,
            {", ".join(f"case when {'coalesce(' if y != 'province' else ''}{x[0]}.{y}_code <> {trim_all(f'n.{y}_code')}{', true)' if y != 'province' else ''} then '{x} ' || {trim_all(f'n.{x}_code')} || ' does not belong to {y} ' || {trim_all(f'n.{y}_code')} end" for x, ys in (("city", ("region", "province")), ("barangay", ("region", "province", "city"))) for y in ys)}) fault
            from partner_register n left join regions r on r.region_code = {trim_all("n.region_code")} left join provinces p on p.province_code = {trim_all("n.province_code")} left join cities c on c.city_code = {trim_all("n.city_code")} left join barangays b on b.barangay_code = {trim_all("n.barangay_code")}""",
        "geo_path": "select r.region_code, region_name, p.province_code, province_name, c.city_code, city_name, b.barangay_code, barangay_name from barangays b join cities c using (city_code) join provinces p on p.province_code = c.province_code join regions r on r.region_code = p.region_code",
        "geo_children": "select city_code, city_name, province_code from cities order by city_name, city_code",
        "geo_aliases": f"select * from {_ALIASES}",
        "geo_normalize": f"with recursive {_normalize()} select region, province, city, barangay, barangay_code, status, match_source, round(confidence, 9) confidence, reason from normalized",
        "geo_exact_resolver": f"with {_legacy()} select region, province, city, barangay, region_code, province_code, city_code, barangay_code, error from legacy",
        "geo_shadow": f"""with recursive {_normalize()}, {_legacy().replace(f"typed as ({_TYPED}), ", "")},
            both_ as (select n.status = 'AUTO_APPLIED' ap, l.error is null old, {", ".join(f"n.{c} n_{c}, l.{c} l_{c}" for c in _EIGHT)} from normalized n join legacy l using (region, province, city, barangay))
            select drift, count(*) chains from (select concat_ws(',', case when ap <> old then 'apply_state' end, {", ".join(f"case when ap and old and n_{c} is distinct from l_{c} then '{c}' end" for c in _EIGHT)}) drift from both_) group by drift""",
        "geo_ingest_counts": "select count(*) rows_read, " + ", ".join(f"count(distinct {null_if_blank(x + '_code')}) {y}" for x, y in (("region", "regions"), ("province", "provinces"), ("city", "cities"), ("barangay", "barangays"))) + f", count(*) - count(distinct {null_if_blank('barangay_code')}) rows_skipped from beneficiaries",
        "geo_ingest_conflicts": f"select barangay_code, m.city_code, m.barangay_name, variants from (select barangay_code, min({{'city_code': city_code, 'barangay_name': barangay_name}}) m, count(distinct {{'city_code': city_code, 'barangay_name': barangay_name}}) variants from beneficiaries where not {_is_blank('barangay_code')} group by barangay_code)",
        "rec_text_keys": f"""select row_id, {location_key("barangay")} barangay_key, lower({collapse("coalesce(province, '')")}) province_key, regexp_replace(coalesce(contact_no, ''), '[^0-9]', '', 'g') contact_digits,
            nullif(nullif(string_split(regexp_replace(replace({trim_all("source_reference")}, chr(92), '/'), '/+$', ''), '/')[-1], ''), '.') as file,
            coalesce(nullif(concat_ws(', ', {null_if_blank("last_name")}, nullif(concat_ws(' ', {null_if_blank("first_name")}, {null_if_blank("middle_name")}, {null_if_blank("extension_name")}), '')), ''), 'n/a') full_name,
            'G-' || case when row_id < 1000000 then lpad(row_id::varchar, 6, '0') else row_id::varchar end made_id,
            case when {null_if_blank("id")} is null or contains(coalesce({trim_all("source_reference")}, ''), 'source_generated_id=' || {null_if_blank("id")}) then {null_if_blank("source_reference")}
              when {_is_blank("source_reference")} then 'source_generated_id=' || {null_if_blank("id")} else {trim_all("source_reference")} || ';source_generated_id=' || {null_if_blank("id")} end provenance,
            case when {whole("year_yyyy")} then {trim_all("year_yyyy")}::bigint end as year, coalesce({trim_all("year_yyyy")} <> '', false) and not coalesce({whole("year_yyyy")}, false) year_bad from import_rows""",
        "rec_birth": f"select internal_uuid, {birth()} birth, {birth_error_sql('birthdate_iso', 'birth_month', 'birth_day', 'birth_year')} error from new_beneficiaries",
        "rec_validate": f"select internal_uuid, error from (select internal_uuid, {_ERROR} error from new_beneficiaries union all select internal_uuid, {_ERROR} error from beneficiaries) where error is not null",
        "rec_normalize": f"""select internal_uuid, {entry("last_name")} last_name, {entry("first_name")} first_name, {null_if_blank(entry("middle_name"))} middle_name, upper({entry("last_name")}) norm_last_name, upper({entry("first_name")}) norm_first_name,
            nullif(regexp_replace({null_if_blank("contact_no")}, '[^0-9]', '', 'g'), '') contact_no_norm, nullif({birth()}, '') birthdate_iso, upper(coalesce({entry("sex")}, '')) sex, {null_if_blank(entry("contact_no"))} contact_no,
            coalesce(year(try_strptime(case when regexp_full_match({birth()}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then {birth()} end, '%Y-%m-%d')), birth_year) birth_year from beneficiaries""",
        "rec_exact_duplicates": f"select n.internal_uuid, min(b.internal_uuid) duplicate_of from (select internal_uuid, {_EXACT} k from new_beneficiaries) n join (select internal_uuid, {_EXACT} k from beneficiaries where record_status <> 'DELETED') b using (k) group by n.internal_uuid",
        "rec_candidates": "select d.internal_uuid, s.internal_uuid candidate, (row_number() over (partition by d.internal_uuid order by s.norm_last_name, s.norm_first_name, s.norm_middle_name nulls first, s.norm_extension_name nulls first, s.generated_id, s.internal_uuid))::int as position from new_beneficiaries d join beneficiaries s on d.norm_last_name = s.norm_last_name and d.norm_first_name = s.norm_first_name and d.internal_uuid <> s.internal_uuid and s.record_status <> 'DELETED' "
        + " ".join(f"and ({_is_blank('d.' + c)} or d.{c} = s.{c})" for c in _OPTIONAL) + f" where not {_is_blank('d.norm_last_name')} and not {_is_blank('d.norm_first_name')} qualify position <= 25",
        "rec_list_page": "select internal_uuid, last_name, first_name from beneficiaries where record_status = 'ACTIVE' and source_type = 'IMPORT' order by last_name nulls first, first_name nulls first, middle_name nulls first, extension_name nulls first, generated_id nulls first, internal_uuid limit 50 offset 100",
        "rec_search": "select internal_uuid, last_name, first_name, city_name from beneficiaries where " + " or ".join(f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%rosar%o%'" for c in ("generated_id", "last_name", "first_name", "middle_name", "extension_name", "contact_no_norm", "source_reference")),
        "imp_dispositions": f"with {_DISPOSED} select internal_uuid, disposition, message from outcome",
        "imp_counters": f"with {_DISPOSED} select batch_no, count(*) rows_read, count(*) filter (disposition = 'inserted') rows_inserted, count(*) filter (disposition = 'skipped') rows_skipped, count(*) filter (disposition = 'failed') rows_failed from outcome group by batch_no",
        "imp_preview": f"""with r as (select *, regexp_replace(source_reference, '#row=.*$', '') as file, coalesce(case when {_is_blank("last_name")} then 'last_name is required' end, case when {_is_blank("first_name")} then 'first_name is required' end,
              {", ".join(f"case when not {_is_blank(c)} and ({number(c)}) is null then '{n} must be a whole number' end" for c, n in (("month_mm", "month"), ("day_dd", "day"), ("year_yyyy", "year")))},
              {birth_error_sql("null::varchar", f"({number('month_mm')})", f"({number('day_dd')})", f"({number('year_yyyy')})")}, case when {_is_blank("sex")} then 'sex is required' end) err from import_rows),
            s as (select file, string_agg('row ' || row_id || ': ' || err, '; ' order by row_id) said from (select *, row_number() over (partition by file order by row_id) k from r where err is not null) where k <= 10 group by file)
            select t.*, coalesce(said, '') sample_errors from (select file, count(*) row_count_total, count(*) filter (err is null) row_count_valid, count(err) row_count_invalid from r group by file) t left join s on s.file is not distinct from t.file""",
        "imp_public": f"with recursive {_normalize()}, {_PUBLIC} select row_id, disposition, message, barangay_code from outcome",
        "imp_ledger": f"""with recursive {_normalize()}, {_PUBLIC} select row_id row_number, raw_barangay, barangay_code resolved_barangay_code, match_source, case when review then 'REVIEW_NEEDED' else status end status, round(confidence, 9) confidence from outcome where not missing""",
        "imp_run_counts": f"""with recursive {_normalize()}, {_PUBLIC} select count(*) total_rows, count(*) filter (not missing and not review and status = 'AUTO_APPLIED') auto_applied_rows, count(*) filter (not missing and (review or status <> 'AUTO_APPLIED')) review_rows,
            count(*) filter (disposition = 'failed') failed_rows from outcome""",
        "imp_idempotent": "select import_id, status from (select * from import_logs order by started_at desc nulls last, import_id limit 500) l where exists (select 1 from import_logs w where w.status = 'SUCCEEDED' and w.file_hash = l.file_hash and w.idempotency_key = l.idempotency_key)",
        "imp_ids": f"""with d as (select internal_uuid, source_reference, batch_no * 10000000 + row_no n, case when row_no % 3 = 0 then {null_if_blank("generated_id")} end want from new_beneficiaries),
            f as (select *, want is not null and row_number() over (partition by want order by n) = 1 and want not in (select generated_id from beneficiaries where generated_id is not null) own from d),
            used as (select distinct try_cast(regexp_extract(g, '^G-0*([1-9][0-9]*)$', 1) as bigint) u from (select generated_id g from beneficiaries union all select want from f where own)),
            free as (select g, row_number() over (order by g) k from (select unnest(range(1, (select count(*) from d) + (select count(*) from beneficiaries) + 2)) g) where g not in (select u from used where u is not null)),
            rest as (select *, row_number() over (order by n) k from f where not own)
            select internal_uuid, want generated_id, source_reference from f where own union all
            select internal_uuid, 'G-' || case when g < 1000000 then lpad(g::varchar, 6, '0') else g::varchar end, case when want is null or contains(coalesce({trim_all("source_reference")}, ''), 'source_generated_id=' || want) then {null_if_blank("source_reference")}
              when {_is_blank("source_reference")} then 'source_generated_id=' || want else {trim_all("source_reference")} || ';source_generated_id=' || want end from rest join free using (k)""",
        "rec_precheck": f"""with c as (select d.internal_uuid id, d.k = s.k same, row_number() over (partition by d.internal_uuid order by s.norm_last_name, s.norm_first_name, s.norm_middle_name nulls first, s.norm_extension_name nulls first, s.generated_id, s.internal_uuid) place
              from (select *, {_EXACT} k from new_beneficiaries) d join (select *, {_EXACT} k from beneficiaries where record_status <> 'DELETED') s on d.norm_last_name = s.norm_last_name and d.norm_first_name = s.norm_first_name and d.internal_uuid <> s.internal_uuid """
        + " ".join(f"and ({_is_blank('d.' + c)} or d.{c} = s.{c})" for c in _OPTIONAL) + f""" where not {_is_blank("d.norm_last_name")} and not {_is_blank("d.norm_first_name")}),
            n as (select id, count(*) candidates, count(*) filter (same) exact from c where place <= 25 group by id)
            select internal_uuid, coalesce(candidates, 0) candidates, coalesce(exact, 0) exact, case when exact > 0 then 'exact duplicate' when candidates > 0 then 'possible duplicates' else 'no duplicates' end message from new_beneficiaries left join n on n.id = internal_uuid""",
        "rec_page_total": "select count(*) total from beneficiaries where record_status = 'ACTIVE' and source_type = 'IMPORT'",
        "rec_created": f"""select internal_uuid, {entry("last_name")} last_name, upper({entry("first_name")}) norm_first_name, upper({entry("sex")}) sex, 'ACTIVE' record_status, 'CLEAR' duplicate_status, 'LOCAL' source_type, '2026-07-01T00:00:00Z' created_at from new_beneficiaries where {_ERROR} is null""",
        "er_decided_records": f"""{_REQUESTS}, touched as (select uuid, max(gone) gone from (select a uuid, decision = 'DELETE_A_SOFT' gone from asked union all select b, decision = 'DELETE_B_SOFT' from asked) group by uuid)
            select internal_uuid, case when gone then 'DELETED' else record_status end record_status, case when uuid is not null then 'RESOLVED' else duplicate_status end duplicate_status, case when gone and coalesce(record_status, '') <> 'DELETED' then '2026-07-01T00:00:00Z' else deleted_at end deleted_at
            from beneficiaries left join touched on uuid = internal_uuid""",
        "er_decided_audit": f"""{_REQUESTS} select match_id entity_id, case when previous is null then 'DEDUP_DECISION_APPLIED' else 'DEDUP_DECISION_RECOMPUTED' end as action, previous from (select *, lag(decision) over (partition by pair_key order by match_id) previous from asked)""",
        "er_reset_records": f"""{_REQUESTS}, last as (select pair_key, arg_max(decision, match_id) final from asked group by pair_key),
            gone as (select uuid, max(g) gone from (select a uuid, decision = 'DELETE_A_SOFT' g from asked union all select b, decision = 'DELETE_B_SOFT' from asked) group by uuid),
            back as (select uuid, max(g) back from (select a uuid, final = 'DELETE_A_SOFT' g from asked join last using (pair_key) union all select b, final = 'DELETE_B_SOFT' from asked join last using (pair_key)) group by uuid)
            select internal_uuid, case when gone or record_status = 'DELETED' then case when back then 'ACTIVE' else 'DELETED' end else record_status end record_status, case when b.uuid is not null then 'POSSIBLE_DUPLICATE' else duplicate_status end duplicate_status
            from beneficiaries left join gone g on g.uuid = internal_uuid left join back b on b.uuid = internal_uuid""",
        "st_jobs": """select import_id job_id, case when step in ('queued>running', 'running>succeeded', 'running>failed', 'recoverable>running') then split_part(step, '>', 2) else split_part(step, '>', 1) end state,
            case when step in ('queued>running', 'recoverable>running') then 2 else 1 end attempt, case when step = 'queued>running' then 0.0 when step = 'running>succeeded' then 100.0 else 40.0 end::double progress
            from (select import_id, case status when 'PARTIAL' then 'running' when 'FAILED' then 'recoverable' when 'RESUMED' then 'queued' else 'succeeded' end || '>' || case status when 'PARTIAL' then 'succeeded' else 'running' end step from import_logs)""",
        "st_recovered": "select import_id job_id, case when status = 'PARTIAL' then 'recoverable' when status = 'FAILED' then 'recoverable' when status = 'RESUMED' then 'queued' else 'succeeded' end state from import_logs",
        "st_overlay": "select pair_key, coalesce(max(run_id) filter (decision_status = 'RESOLVED'), max(run_id) filter (decision_status = 'PENDING')) run_id from scored_pairs where pair_key is not null group by pair_key",
        "exp_log": "select 'exp-1' export_id, 'people.csv' file_name, 'BENEFICIARIES' export_type, count(*) rows_exported from beneficiaries where record_status in ('ACTIVE', 'RETAINED') and coalesce(duplicate_status, '') <> 'POSSIBLE_DUPLICATE'",
        "hist_pages": "select import_id, ((row_number() over (order by started_at desc nulls last, import_id) - 1) // 20 + 1)::int page from import_logs",
        "imp_repeated": f"select file_hash, idempotency_key, first_import, imports from (select file_hash, idempotency_key, arg_min(import_id, (coalesce(started_at, ''), import_id)) first_import, count(*) imports from import_logs where not {_is_blank('file_hash')} group by all) where imports > 1",
        "imp_location_outcome": f"with recursive {_normalize()} select case when barangay_code is null then 'review' when status = 'AUTO_APPLIED' then 'apply' when confidence >= 0.9 then 'accept_reviewed' else 'review' end outcome, count(*) chains from normalized group by 1",
        "exp_rows": _export(),
        "st_upsert": "select pair_key, match_id, run_id, total_score, decision_status, created_at from (select *, row_number() over (partition by pair_key order by created_at desc, match_id desc) k from (select distinct pair_key, match_id, run_id, total_score, decision_status, created_at from scored_pairs where pair_key is not null)) where k = 1",
        "st_soft_delete": "select s record_status, count(*) n, max(t) last_deleted from (select case when hit then 'DELETED' else record_status end s, case when hit and coalesce(record_status, '') <> 'DELETED' then '2026-07-01T00:00:00Z' else deleted_at end t from (select *, internal_uuid in (select internal_uuid from reviewed_groups where internal_uuid is not null) hit from beneficiaries)) group by s",
        "st_transitions": "select previous, event_type, previous is null or (previous, event_type) in (('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('signup', 'view'), ('login', 'view')) allowed, count(*) n from (select *, lag(event_type) over (partition by user_id order by ts, event_id) previous from events) group by all",
        "dash_counts": "select count(*) total, count(*) filter (coalesce(record_status, '') <> 'DELETED') active, count(*) filter (coalesce(record_status, '') = 'DELETED') deleted from beneficiaries",
        "hist_latest": "select operator_name, place, import_id from (select *, (row_number() over (partition by operator_name order by started_at desc nulls last, import_id))::int place from import_logs) where place <= 10",
        "audit_filter": "select import_id, operator_name, status from (select * from import_logs order by started_at desc nulls last, import_id limit 500) where contains(lower(coalesce(operator_name, '')), 'encoder 1') or contains(lower(coalesce(status, '')), 'encoder 1') or contains(lower(coalesce(import_id, '')), 'encoder 1')",
    }
