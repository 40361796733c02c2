"""The catalogue's queries as plain SQL, written independently of the Spark expressions."""

from __future__ import annotations

from rowscrub.functions.names import CYRILLIC_TO_LATIN
from rowscrub.functions.patterns import ESCAPE_TOKENS, LABELS, PATTERNS
from rowscrub.plans.catalogue import CYRILLIC, KEPT, LATIN

WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MARKERS = "('', ' ', 'nan', 'NaN', 'none', 'None', 'null', 'NULL', '0')"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(name: str) -> str:
    """A catalogue regex in the other engine's spelling of code points."""
    regex = PATTERNS[name]
    if name in ESCAPE_TOKENS:
        return regex
    out, rest = "", regex
    while rest:
        if rest.startswith("\\u"):
            out, rest = out + "\\x{" + rest[2:6] + "}", rest[6:]
        else:
            out, rest = out + rest[0], rest[1:]
    return out


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def special(x: str) -> str:
    x = sub(x, r"&nbsp;|\\n|\\t|\\r|\x{a0}|\x{feff}", " ")
    x = sub(x, r"[\n\r\t]", " ")
    x = sub(x, r"[\x{a0}\x{202f}\x{2007}\x{1680}\x{180e}\x{205f}]", " ")
    x = sub(x, r"[\x{200b}\x{200c}\x{200d}\x{2060}\x{ad}\x{200e}\x{200f}\x{61c}]")
    return sub(x, r"[\x00-\x1f\x7f]")


def trim_ws(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$")


def spaces(x: str) -> str:
    return trim_ws(sub(x, WS + "{2,}", " "))


def clean(x: str) -> str:
    return spaces(special(sub(x, "[\"']")))


def nullify(x: str) -> str:
    return f"case when {trim_ws(x)} in {MARKERS} then null else {x} end"


def keep(x: str, names: list[str]) -> str:
    alternation = "|".join(re2(n) for n in names)
    return f"array_to_string(regexp_extract_all(coalesce({x}, ''), {lit(alternation)}), '')"


def dirt(text: str = "text") -> str:
    return f"""case doc_id % 8
      when 0 then '  "' || {text} || '"  '
      when 1 then replace({text}, ' ', chr(160))
      when 2 then {text} || '&nbsp;\\n'
      when 3 then 'NULL' when 4 then '0' when 5 then null
      when 6 then replace({text}, ' ', chr(9) || chr(13) || chr(10))
      else replace({text}, 'e', chr(8203) || 'e') end"""


DIRTY = f"dirty as (select doc_id, {dirt()} as v from documents)"
LINES = """lines as (select event_id, case event_id % 10
      when 1 then event_id || ',' || user_id
      when 2 then event_id || ',' || user_id || ',' || event_type || ',x'
      when 3 then ''
      else event_id || ',' || user_id || ',' || event_type end as value from events)"""
CHECKED = f"""{LINES}, checked as (select *, case when value = '' then 0
      else length(value) - length(replace(value, ',', '')) + 1 end as n from lines)"""
WRONG = "'Неверное количество столбцов: ' || n || ' вместо 3'"
TO_CYRILLIC = f"translate(text, {lit(LATIN)}, {lit(CYRILLIC)})"
MIXED = f"""mixed_scripts as (select doc_id, {TO_CYRILLIC} || extra as mixed,
      case when doc_id % 4 = 0 then extra end as shared, null::varchar as none
      from (select *, case doc_id % 4 when 0 then chr(1201) when 1 then chr(1198)
            when 2 then '\\u0020' else chr(700) || '#' end as extra from documents))"""


QUOTED = ", ".join(f'"{n}"' for n in PATTERNS)


def over_dirty(expression: str, where: str = "") -> str:
    return f"with {DIRTY} select doc_id, {expression} as v from dirty {where}"


def long_profile(tables: dict[str, list[str]]) -> str:
    parts = []
    for name, columns in tables.items():
        for c in columns:
            flags = ", ".join(f"(coalesce(bool_or(regexp_matches({c}::varchar, {lit(re2(n))})), false)) as \"{n}\"" for n in PATTERNS)
            parts.append(
                f"select {lit(name)} as table_name, {lit(c)} as \"column\", pattern, found from "
                f"(select {flags} from {name}) unpivot (found for pattern in ({QUOTED}))"
            )
    return " union all ".join(parts)


DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def detected(table: str, columns: list[str]) -> str:
    """One row per column with its sorted classes and labels, joined by bars."""
    labels = " ".join(f"when {lit(n)} then {lit(label)}" for n, label in LABELS.items())
    return f"""select "column", coalesce(string_agg(pattern, '|' order by pattern) filter (found), '') as patterns,
      coalesce(string_agg(case pattern {labels} end, '|' order by pattern) filter (found), '') as labels
      from ({long_profile({table: columns})}) group by 1"""


def translit(x: str) -> str:
    for letter, latin in CYRILLIC_TO_LATIN.items():
        x = f"replace(replace({x}, {lit(letter)}, {lit(latin)}), {lit(letter.upper())}, {lit(latin)})"
    return x


def sanitize(x: str) -> str:
    x = sub(sub(f"lower({translit(x)})", r"[., ]", "_"), "[^a-z0-9_-]+", "_")
    x = sub(sub(x, "_+", "_"), "^[_-]+|[_-]+$")
    return f"coalesce(nullif({x}, ''), 'data')"


NAMED = f"""named as (select page_id, case when country <> 'zz' then
      'clean-' || lower(country) || '-' || case when stem = '' then 'csv' else {sanitize('stem')} || '_csv' end || '-2023-v1.parquet' end as name
      from (select page_id, ['ru', 'KG', 'zz'][page_id % 3 + 1] as country,
            regexp_replace(url, '^.*/', '') as stem from pages))"""
INPUT = f"""input as (select doc_id, {dirt()} as v, case when doc_id % 3 <> 0 then upper(lang) end as lang,
      source, n_chars from documents)"""
ANY_UNCOVERED = "[^" + "".join(
    (re2(n)[1:-1] if re2(n).startswith("[") else re2(n).replace("-", r"\-")) for n in PATTERNS if n not in ESCAPE_TOKENS
) + "]"


def default_rules_sql() -> str:
    """Every detected class of a column is kept: decided inside the query, class by class."""
    cells = []
    for c in ("v", "lang", "source"):
        singles = [n for n in PATTERNS if n not in ESCAPE_TOKENS]
        flags = ", ".join(f"coalesce(bool_or(regexp_matches({c}, {lit(re2(n))})), false) as \"{n}\"" for n in singles)
        body = " || ".join(
            f"case when \"{n}\" then {lit(re2(n)[1:-1] if re2(n).startswith('[') else re2(n).replace('-', chr(92) + '-'))} else '' end"
            for n in singles
        )
        cells.append(f"{c}_rule as (select '[^' || {body} || ']' as drop from (select {flags} from input))")
    kept = ", ".join(f"regexp_replace(coalesce({c}, ''), (select drop from {c}_rule), '', 'g') as {c}" for c in ("v", "lang", "source"))
    cleaned = ", ".join(f"{clean('lower(' + c + ')')} as {c}" for c in ("v", "lang", "source"))
    nulled = ", ".join(f"{nullify(c)} as {c}" for c in ("v", "lang", "source"))
    return f"""with {INPUT}, {', '.join(cells)}, kept as (select {kept} from input),
      cleaned as (select {cleaned} from kept)
      select distinct {nulled}, 2024 as "year", 'ru' as country_code from cleaned"""


def oracle_sql() -> dict[str, str]:
    first_flags = {n: f"regexp_matches(rest, {lit(re2(n))})" for n in PATTERNS}
    for n, token in ESCAPE_TOKENS.items():
        first_flags[n] = f"contains(value, {lit(token)})"
    first_flags["cyrillic_extended"] = f"regexp_matches(rest, {lit(re2('cyrillic_extended').replace(chr(92) + 'x{04B1}', ''))})"
    rest = "replace(replace(value, '\\u0020', chr(1)), '\\u000A', chr(1))"
    first = ", ".join(f"coalesce(bool_or({f}), false) as \"{n}\"" for n, f in first_flags.items())
    flags = ", ".join(f"regexp_matches(v, {lit(re2(n))}) as {n}" for n in PATTERNS)
    info = """to_json({'label': label, 'origin': {'source': source, 'lang': lang}})::varchar as additional_info"""
    customer_json = """to_json({'c_name': c_name, 'place': {'c_nationkey': c_nationkey, 'c_mktsegment': c_mktsegment}})::varchar"""
    nested = f"select c_custkey, c_acctbal, {customer_json} as additional_info from customer"
    cleaned = {c: clean(f"lower({c})") for c in ("body", "label", "lang", "source")}

    return {
        "csv_scan_plain": "select doc_id, text, lang, source, n_chars from documents",
        "csv_scan_late_types": """select l_orderkey, l_linenumber,
            case when l_orderkey >= 900 then 'k' || l_orderkey else l_orderkey::varchar end as code from lineitem""",
        "csv_scan_mixed_headers": """select event_id, user_id, case when event_id % 3 <> 2 then event_type end as event_type,
            case when event_id % 3 = 1 then value end as value, multi_line from events, (values (true), (false), (null)) as m(multi_line)""",
        "csv_scan_wide_numbers": """select o_orderkey, case when o_orderkey % 100 = 7 then '99999999999999' else '1' end || lpad(o_orderkey::varchar, 6, '0') as code,
            case when o_orderkey % 2 = 0 then 9223372036854775807 else o_orderkey end as fits, multi_line
            from orders, (values (true), (false)) as m(multi_line)""",
        "csv_scan_header_row": """select case when c_custkey % 10 = 3 then 'c_custkey' else c_custkey::varchar end as c_custkey,
            case when c_custkey % 10 = 3 then 'c_name' else c_name end as c_name, multi_line from customer, (values (true), (false)) as m(multi_line)""",
        "csv_scan_raw": """select event_id, user_id,
            case when event_id % 7 = 0 then null else event_type end as event_type,
            case when event_id % 5 = 1 then null when event_id % 11 = 0 then ' NULL'
                 else replace(props, '"', '') end as props from events""",
        "null_tokens": """select doc_id, case when doc_id % 12 = 9 then ' NULL'
            when doc_id % 12 <= 10 then null else text end as v from documents""",
        "header_clean": 'select n_nationkey as "nation key", n_name as name, n_regionkey as region from nation',
        "strip_dquotes": over_dirty("replace(v, '\"', '')"),
        "utf8_repair": "select doc_id, chr(65533) || text || chr(65533) as replaced, text as dropped from documents",
        "parquet_scan": "select * from conversations",
        "ingest_reuse": "select *, true as reused from part",
        "ingest_failed": """select *, 'old' as part from part union all select *, 'new' as part from part where p_partkey % 2 = 0""",
        "ingest_reuse_options": "select *, false as reused from part",
        "file_profiles": """with whole as (select source, string_split(string_agg(text, chr(10) order by doc_id), chr(10)) as lines
              from documents group by source),
            line as (select source, unnest(lines[1:30]) as line from whole),
            n as (select source, sum(length(line) - length(replace(line, ',', ''))) as a, sum(length(line) - length(replace(line, ';', ''))) as b,
              sum(length(line) - length(replace(line, chr(9), ''))) as c, sum(length(line) - length(replace(line, '|', ''))) as d
              from line group by source),
            quoted as (select source, bool_or(contains(l, '"') or contains(l, chr(39))) as q from (select source, unnest(lines[1:21]) as l from whole) group by source)
            select source, 'utf8' as encoding, case greatest(a, b, c, d) when a then ',' when b then ';' when c then chr(9) else '|' end as delimiter,
              q as has_quotes from n join quoted using (source)
            union all select 'empty', 'utf8', ',', false union all select 'single', 'utf8', '|', false""",
        "file_hashes": """select source, sha256(string_agg(text || chr(10), '' order by doc_id)) as content_hash from documents group by source
            union all select 'empty', sha256('') union all select 'single', sha256('a|b|c;')""",
        "encoding_profile": """select doc_id as file,
            case when doc_id % 5 = 0 then 'utf8-lossy' else 'utf8' end as encoding from documents""",
        "delimiter_profile": """with heads as (select doc_id as file, unnest(string_split(text, chr(10))[1:30]) as line from documents),
            counts as (select file, sum(length(line) - length(replace(line, ',', ''))) as a,
              sum(length(line) - length(replace(line, ';', ''))) as b,
              sum(length(line) - length(replace(line, chr(9), ''))) as c,
              sum(length(line) - length(replace(line, '|', ''))) as d from heads group by 1)
            select file, case greatest(a, b, c, d) when a then ',' when b then ';' when c then chr(9) else '|' end as delimiter
            from counts""",
        "delimiter_consistency": """with d as (select unnest([0, 1, 2, 3]) as i, unnest([',', ';', chr(9), '|']) as c),
            e as (select event_id, event_type, event_id // 40 as file, c, case when c = ',' then '; ' else ', ' end as other
              from events join d on d.i = (event_id // 40) % 4),
            l as (select file, event_id % 40 + 1 as line_no, '"' || event_type || c || c || other || '"' as q,
              event_id::varchar || c || case when event_id % 40 > 0 then repeat(other, event_id % 7) else 'title' end || c as front from e),
            lines as (select file, case when file % 9 = 0 then q else front || q end as line from l where line_no <= 30),
            n as (select file, i, length(line) - length(replace(line, c, '')) as every,
              length(o) - length(replace(o, c, '')) + 1 as fields
              from (select file, line, regexp_replace(line, '"[^"]*("|\\z)', '', 'g') as o from lines), d),
            votes as (select file, i, fields, count(*) as k from n where fields > 1 group by all),
            voted as (select file, i from votes qualify row_number() over (partition by file order by k desc, fields desc, i) = 1),
            frequent as (select file, i from (select file, i, sum(every) as k from n group by all)
              qualify row_number() over (partition by file order by k desc, i) = 1)
            select f.file, d.c as delimiter from frequent f left join voted v using (file) join d on d.i = coalesce(v.i, f.i)""",
        "has_quotes": """with t as (select doc_id, case when doc_id % 9 = 0 then text || chr(10) || 'it''s' else text end as text from documents),
            heads as (select doc_id as file, unnest(string_split(text, chr(10))[1:21]) as line from t)
            select file, bool_or(contains(line, '"') or contains(line, '''')) as has_quotes from heads group by 1""",
        "strip_quotes_raw": """with t as (select case when doc_id % 4 = 0 then '"' || text || '''' || chr(10) || '''''' else text end as text from documents)
            select translate(unnest(string_split(text, chr(10))), '"''', '') as line from t""",
        "supported_files": """select page_id, url || ['.csv', '.TXT', '.Csv', '.parquet', ''][page_id % 5 + 1] as name
            from pages where page_id % 5 < 3""",
        "csv_arity_valid": f"""with {CHECKED} select event_id::varchar as event_id, split_part(value, ',', 2) as user_id,
            split_part(value, ',', 3) as event_type from checked where n = 3""",
        "csv_arity_bad": f"""with {CHECKED} select event_id, 'structure' as error_type, {WRONG} as description,
            value as content from checked where n <> 3""",
        "csv_bad_row_numbers": f"""with {CHECKED}, numbered as (select *, row_number() over (order by event_id) + 1 as row_number from checked)
            select row_number, 'structure' as error_type, {WRONG} as description, value as content from numbered where n <> 3""",
        "csv_quoted_fields": "select doc_id::varchar as doc_id, text, lang from documents",
        "csv_type_errors": """select event_id, 'processing' as error_type, 'Ошибка обработки: user_id is not bigint' as description,
            event_id || ',x' as content from events where event_id % 6 = 0""",
        "csv_repair_counts": f"""with {CHECKED} select case when n = 3 then 'valid' else 'structure' end as error_type,
            count(*) as records from checked group by 1""",
        "csv_repair_files": f"""with {CHECKED} select event_id, split_part(value, ',', 2)::bigint as user_id,
            split_part(value, ',', 3) as event_type from checked where n = 3""",
        "csv_multi_line": "select doc_id::varchar as doc_id, text, lang, source, n_chars::varchar as n_chars from documents",
        "csv_repair_mixed_headers": "select event_id::varchar as event_id, user_id::varchar as user_id, event_type from events",
        "write_parquet_roundtrip": nested,
        "write_parquet_codecs": """select s_suppkey, s_name, unnest(['zstd', 'snappy', 'gzip', 'none']) as codec from supplier""",
        "write_split": "select * from orders",
        "write_sized": "select *, true as fits from lineitem",
        "write_csv_minimal": "select * from conversations",
        "write_csv_quoted": f"""with {DIRTY} select '"' || doc_id || '"|"' ||
            coalesce(replace({sub('v', r'\r\n|\n|\r', ' ')}, '"', '""'), '') || '"' as line from dirty""",
        "write_bad_rows": f"""with {CHECKED} select event_id::varchar as event_id, 'structure' as error_type, {WRONG} as description,
            value as content from checked where n <> 3""",
        "exclude_columns": "select * exclude (c_acctbal) from customer",
        "rename_columns": "select n_nationkey, n_name as name, n_regionkey from nation",
        "export_projection": "select c_custkey as id, c_name as name, c_nationkey, c_mktsegment as name_2 from customer",
        "concat_columns": """select o_orderkey, case when o_orderstatus <> 'F' then o_orderstatus end as status, o_orderpriority,
            status || '-' || o_orderkey || '-' || o_orderpriority as label from orders""",
        "concat_trimmed": f"""select conv_id, turn, role, turn || ': ' || role || ': ' ||
            {trim_ws("('  ' || text || chr(9) || chr(10))")} as said from conversations""",
        "concat_cleaned": f"""with k as (select * exclude (p_name, p_brand), lower({keep('p_name', ['latin_basic', 'digits'])}) as p_name,
            lower({keep('p_brand', ['latin_basic', 'digits'])}) as p_brand, (p_size % 5)::varchar as size from part),
            n as (select * exclude (p_name, p_brand, size), {nullify('p_name')} as p_name, {nullify('p_brand')} as p_brand,
              {nullify('size')} as size from k)
            select *, p_name || '/' || p_brand || '/' || size as label from n""",
        "nest_fields": nested,
        "add_metadata": "select *, 2024 as year, 'kg' as country_code from nation",
        "cast_to_text": "select doc_id::varchar as doc_id, quality::varchar as quality, toxic::varchar as toxic from labels",
        "visible_projection": "select s_suppkey, s_name as supplier from supplier",
        "nest_auto": """select c_custkey, c_name,
            to_json({'c_nationkey': c_nationkey, 'c_acctbal': printf('%.2f', c_acctbal), 'c_mktsegment': c_mktsegment})::varchar
            as additional_info from customer""",
        "nest_auto_exact": """select n_nationkey, to_json({'n_name': n_name, 'n_regionkey': n_regionkey})::varchar as additional_info
            from nation""",
        "require_not_null": over_dirty("v", "where v is not null"),
        "require_not_empty": over_dirty("v", f"where v is not null and {trim_ws('v')} not in {MARKERS}"),
        "dedup_subset": "select distinct user_id, nullif(event_type, 'error') as event_type from events",
        "dedup_ordered": """select event_id, user_id, event_type, props from events
            qualify row_number() over (partition by user_id, event_type order by event_id) = 1""",
        "dedup_all": "select distinct * from lineitem",
        "dedup_fallback": "select distinct * from orders",
        "head_rows": "select doc_id, lang from documents order by n_chars nulls first, doc_id limit 5000",
        "slice_by_position": "select * from orders order by o_orderkey limit 600 offset 700",
        "slice_rows": "select conv_id, turn, text from conversations order by conv_id, turn limit 50 offset 100",
        "vstack": """select doc_id as id, text from documents union all select item_id, text from benchmark
            union all select item_id, text from benchmark""",
        "keep_patterns": over_dirty(keep("v", KEPT)),
        "keep_patterns_nullsafe": over_dirty(f"case when v is not null then {keep('v', KEPT)} end"),
        "concat_with_target_rules": f"""with d as (select doc_id, {keep('source', ['latin_basic'])} as source,
            {keep('case when doc_id % 4 <> 0 then lang end', ['latin_basic'])} as lang, n_chars::varchar as n_chars from documents)
            select *, source || '-' || lang as label from d""",
        "replace_pattern": r"""select p_partkey, replace(p_brand, '#', '$') as brand,
            regexp_replace(p_brand, '[0-9]', '\\1$0', 'g') as digits_gone,
            regexp_replace(coalesce(nullif(p_type, 'SMALL'), ''), '[A-Za-z]', '', 'g') as kind from part""",
        "strip_quotes": over_dirty(sub("v", "[\"']")),
        "clean_special_chars": over_dirty(special("v")),
        "normalize_whitespace": over_dirty(spaces("v")),
        "clean_strings": f"with {DIRTY}, c as (select doc_id, {clean('v')} as v from dirty) select doc_id, {nullify('v')} as v from c",
        "lowercase_all": "select doc_id, lower(text) as text, lower(lang) as lang, lower(source) as source, n_chars from documents",
        "nullify_empty": f"""with {DIRTY} select nullif(doc_id, 0) as doc_id, {nullify('v')} as v from dirty""",
        "replace_empty": over_dirty(f"coalesce({nullify('v')}, 'n/a')"),
        "flatten_newlines": over_dirty(sub("v", r"\r\n|\n|\r", " ")),
        "short_hash": "select doc_id, substr(md5(text), 1, 20) as h from documents",
        "content_hash": "select doc_id, sha256(text) as h from documents",
        "transliterate": f"""select doc_id, {translit(f"({TO_CYRILLIC} || ' ЖжХхЦцЧчШшЩщЪъЫыЬьЭэЮюЯяЁё')")} as v from documents""",
        "sanitize_name": f"""select page_id, {sanitize("(case when page_id % 10 = 0 then '!?-' else url || ' Щи,Я.' end)")} as v from pages""",
        "valid_country": """select doc_id, coalesce(nullif(substr(lang, 1, 2), 'fr') in ('en', 'nl'), false) as ok from documents""",
        "output_name": f"with {NAMED} select page_id, name from named",
        "valid_output_name": f"""with {NAMED}, t as (select page_id,
            case when page_id % 4 = 0 then replace(name, '-ru-', '-xx-') else name end as name from named)
            select page_id, coalesce(regexp_full_match(name, 'clean-[a-z][a-z]-[a-z0-9_-]+-\\d\\d\\d\\d-v\\d+\\.parquet')
              and split_part(name, '-', 2) in ('ru','kg','uz','tm','ua','by','nl','az'), false) as ok from t""",
        "pattern_flags": f"with {DIRTY} select doc_id, {flags} from dirty",
        "array_nonempty": f"""with {DIRTY}, w as (select doc_id, [x for x in string_split_regex(v, '[ e]') if length(x) > 0] as ws from dirty)
            select doc_id, len(ws) as n, array_to_string(ws, '|') as words from w""",
        "pattern_profile": long_profile(
            {
                "documents": DOC_COLUMNS,
                "pages": ["page_id", "url", "html"],
                "part": PART_COLUMNS,
                "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                "events": EVENT_COLUMNS,
            }
        ),
        "column_metadata": f"""with d as ({detected('documents', DOC_COLUMNS)}),
            u as ({' union all '.join(f"select {lit(c)} as c, coalesce(bool_or(regexp_matches({c}::varchar, {lit(ANY_UNCOVERED)})), false) as u from documents" for c in DOC_COLUMNS)})
            select substr(md5("column"), 1, 20) as hash, "column", "column" as origin_name, "column" as display_name,
              patterns as detected_patterns, patterns as prev_selected_patterns, patterns as selected_patterns,
              labels as detected_display_patterns, labels as display_patterns, 'standalone' as mode, u as uncovered_chars
            from d join u on c = "column" """,
        "pattern_set_first": " union all ".join(
            f"""select * from (with {MIXED}, t as (select value, {rest} as rest from (select {c} as value from mixed_scripts))
            select {lit(c)} as "column", pattern from (select {first} from t)
            unpivot (found for pattern in ({QUOTED})) where found)"""
            for c in ("mixed", "shared", "none")
        ),
        "pattern_set_column": f"""with {MIXED} select pattern from ({long_profile({'mixed_scripts': ['mixed']})}) where found""",
        "table_info": """select (select count(*) from lineitem) as row_count, count(*) as column_count,
            string_agg(column_name, ',') as column_names from (describe lineitem)""",
        "concat_metadata": f"""with d as ({detected('part', PART_COLUMNS)}),
            p as (select distinct unnest(string_split(patterns, '|')) as p from d where "column" in ('p_name', 'p_brand')),
            l as (select distinct unnest(string_split(labels, '|')) as l from d where "column" in ('p_name', 'p_brand'))
            select substr(md5('label'), 1, 20) as hash, 'label' as "column",
              (select string_agg(p, '|' order by p) from p) as detected_patterns,
              (select string_agg(l, '|' order by l) from l) as detected_display_patterns, 'p_name|p_brand' as sources""",
        "profile_reuse": f"""select "column", patterns as detected_patterns, true as reused from ({detected('part', PART_COLUMNS)})""",
        "profile_reuse_moved_nulls": f"""with moved as (select p_partkey, p_brand as p_name, null::varchar as p_type from part)
            select "column", patterns as detected_patterns, false as reused from ({detected('moved', ['p_partkey', 'p_name', 'p_type'])})""",
        "workflow_case_names": """select doc_id, n_chars as given_year, source as given_label, lang, source || '-' || lang as label,
            2024 as "year", 'ru' as country_code from documents""",
        **dict.fromkeys(("workflow_csv", "workflow_many_files", "workflow_cli"), f"""with {INPUT},
            ruled as (select doc_id, {keep('v', KEPT)} as body, {keep('source', ['latin_basic', 'digits'])} as source,
              {keep('lang', ['latin_basic', 'digits'])} as lang from input),
            joined as (select *, source || ' ' || lang as label from ruled),
            cleaned as (select doc_id, {', '.join(f'{x} as {c}' for c, x in cleaned.items())} from joined),
            nulled as (select doc_id, {', '.join(f'{nullify(c)} as {c}' for c in cleaned)} from cleaned),
            firsts as (select * from nulled where body is not null qualify row_number() over (partition by body order by doc_id) = 1)
            select doc_id, body, {info}, 2024 as "year", 'ru' as country_code from firsts"""),
        "workflow_lib": f"""with t as (select event_id, user_id % 50 as k,
              {keep("case when event_id % 3 <> 0 then event_type end", ['latin_basic'])} as kind from events),
            n as (select event_id, k, {nullify(clean('kind'))} as kind from t),
            d as (select * from n qualify row_number() over (partition by k order by event_id) = 1)
            select * from d where kind is not null""",
        "workflow_full": f"""with {INPUT},
            base as (select doc_id::varchar as doc_id, {', '.join(f'{spaces(special(c))} as {c}' for c in ('v', 'lang', 'source'))} from input),
            ruled as (select doc_id, lower({keep('v', KEPT)}) as v, lower({keep('lang', ['latin_basic', 'digits'])}) as lang,
              lower({keep('source', ['latin_basic', 'digits'])}) as source from base),
            nulled as (select {', '.join(f'{nullify(c)} as {c}' for c in ('doc_id', 'v', 'lang', 'source'))} from ruled),
            labelled as (select distinct on (v, doc_id) *, {nullify("(source || '-' || lang)")} as "Label" from nulled)
            select * from labelled where v is not null and "Label" is not null""",
        "workflow_default_rules": default_rules_sql(),
        "workflow_stream": f"""with k as (select {keep('text', KEPT)} as body, lang from documents),
            c as (select {clean('lower(body)')} as body, {clean('lower(lang)')} as lang from k),
            n as (select {nullify('body')} as body, {nullify('lang')} as lang from c)
            select distinct body, lang, 2024 as "year", 'ru' as country_code from n where body is not null""",
        "workflow_stream_csv": f"""with k as (select text as body, {keep('lang', KEPT)} as lang, doc_id % 5 as zeros from documents),
            c as (select {clean('lower(body)')} as body, {clean('lower(lang)')} as lang, zeros from k),
            n as (select {nullify('body')} as body, {nullify('lang')} as lang, zeros from c)
            select distinct body, lang, zeros, 2024 as "year", 'ru' as country_code from n where body is not null""",
    }
