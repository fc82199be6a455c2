"""DuckDB texts of the catalog operators, written apart from the Spark expressions."""

from __future__ import annotations

from siftlode.functions import vocab
from siftlode.plans.testdata import AS_OF, CATALOG_SQL, CONNECTIVITY_SQL, SEARCH_SQL

W = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
CJK = r"\x{4e00}-\x{9fff}"


def re_all(c: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({c}, '{pattern}', '{to}', '{flags}')"


def trim(c: str) -> str:
    return re_all(c, f"^[{W}]+|[{W}]+\\z")


def chain(c: str, *steps: tuple[str, str] | str) -> str:
    for s in steps:
        c = trim(c) if s == "trim" else re_all(c, *s) if len(s) == 2 else re_all(c, s[0], s[1], "gi")
    return c


def one_of(words: tuple[str, ...]) -> str:
    return "|".join(w.lower() for w in words)


def _name_steps() -> list[tuple[str, str]]:
    q = vocab.QUALITY_WORDS
    labels = [(f"[{W}]*{w}[{W}]*", " ") for w in vocab.QUALITY_LABELS]
    return [
        ("removedEmoji", chain("s0", (f"[{vocab.PICTOGRAPHIC}{vocab.LEGACY_EMOJI}{vocab.INVISIBLE}]", ""))),
        ("removedQualityBrackets", chain("s1", (f"[（(][{W}]*{q}[{W}]*[）)]", " ", "i"), (f"【[{W}]*{q}[{W}]*】", " ", "i"), (rf"\[[{W}]*{q}[{W}]*\]", " ", "i"))),
        ("removedMaintainerSuffix", chain("s2", (f"@[^{W}]+", " "), (f"[{W}]+[Bb][Yy][{W}]+[^{W}]+", " "), (f"[{W}]*[┃|｜][{W}]*[^{W}]+", " "))),
        ("removedHashComment", chain("s3", (f"#[^0-9{W}][^{W}]*[{W}]*\\z", " "), "trim")),
        ("removedVersionMarker", chain("s4", (f"#[0-9]+[{W}]*\\z", " "), "trim")),
        ("removedAnnotationBrackets", chain("s5", (f"[{W}]*[（(]{vocab.ANNOTATIONS}[）)][{W}]*", " ", "i"))),
        ("removedQualityLabels", chain("s6", *labels)),
        ("removedFancySymbols", chain("s7", (f"[{vocab.FANCY_SYMBOLS}]", " "))),
    ]


def names_cte(mode: str = "loose") -> str:
    """cat (the catalog) and nm (idx, s0 .. s8, cleaned, warning)."""
    out, at = f"cat as ({CATALOG_SQL}), n0 as (select *, {trim('coalesce(name, ' + chr(39) * 2 + ')')} as s0 from cat)", "n0"
    for i, (_, expr) in enumerate(_name_steps(), 1):
        out += f", n{i} as (select *, {expr} as s{i} from n{i - 1})"
        at = f"n{i}"
    last = chain("s8", (f"[{W}]+", " "), "trim")
    if mode == "zh-only":
        last = chain(last, (rf"[^{CJK}\x{{3400}}-\x{{4dbf}}\x{{f900}}-\x{{faff}}0-9\-—·• \x{{3000}}]", ""), (f"[{W}]+", " "), "trim")
    bare = trim(re_all(re_all("coalesce(name, '')", f"[{vocab.LEGACY_EMOJI}]"), f"[^A-Za-z0-9_{CJK}{W}\\-]"))
    return out + f""", nf as (select *, {last} as last, {bare} as bare from {at}),
nm as (select * exclude (last, bare), case when s0 = '' then '' when last <> '' then last when bare <> '' then bare when url <> '' then url else '未命名源-' || cast(idx as varchar) end as cleaned_name,
  case when s0 = '' then 'EMPTY_NAME' when last <> '' then null when bare <> '' then 'CLEAN_NAME_EMPTY_FALLBACK' when url <> '' then 'CLEAN_NAME_EMPTY_FALLBACK_URL' else 'CLEAN_NAME_EMPTY_FALLBACK_INDEX' end as warning from nf)"""


def name_steps_sql() -> str:
    parts = [f"select idx, {i} as step, '{r}' as reason, s{i - 1} as before, s{i} as after from nm where s0 <> '' and s{i - 1} <> s{i}" for i, (r, _) in enumerate(_name_steps(), 1)]
    return f"with {names_cte()} " + " union all ".join(parts)


def strip_url(c: str) -> str:
    first = chain(trim(c), (f"[{CJK}]+\\z", ""), "trim")
    rest = chain(first, (f"#[^{W}]*\\z", ""), "trim", (f"@[^{W}]*\\z", ""), "trim", (r"[,，。；;！!？?、]+\z", ""), "trim", (r"[;；]+\z", ""), "trim")
    return f"case when coalesce({trim(c)}, '') = '' then null when {first} = '' or {rest} = '' then {trim(c)} else {rest} end"


DOMAIN = r"^[a-zA-Z0-9][-a-zA-Z0-9.]*\.[a-zA-Z]{2,}(:[0-9]+)?(/.*)?\z"


def urls_cte(source: str, keep: str = "*") -> str:
    """u0 .. u3: candidate, is_http, is_domain, host, and nu with the normalised columns."""
    return f"""u0 as (select {keep}, {strip_url('url')} as candidate from {source}),
u1 as (select *, coalesce(regexp_matches(candidate, '^https?://.+', 'i'), false) as is_http, coalesce(regexp_matches(candidate, '{DOMAIN}'), false) as is_domain from u0),
u2 as (select *, case when is_http then candidate else 'https://' || candidate end as full_url from u1),
u3 as (select *, nullif(lower(regexp_extract(full_url, '^https?://(?:[^/?#@]*@)?([^/:?#\\\\]+)', 1, 'i')), '') as site from u2),
nu as (select *, case when candidate is null or (is_http and site is null) then 'INVALID_URL' when is_http then 'VALID_HTTP' when is_domain then 'NON_HTTP_LOOKS_LIKE_DOMAIN' else 'NON_HTTP_SOURCE' end as url_status,
  case when candidate is null or (is_http and site is null) then null when is_http or is_domain then {re_all('full_url', '/+\\z')} else candidate end as norm_url,
  case when candidate is null then null when is_http or is_domain then site else {re_all('lower(candidate)', f'[{W}]+', '_')} end as host,
  case when candidate is null then null when is_http or is_domain then regexp_replace(regexp_replace(site, ':.*\\z', ''), '^(www\\.|m\\.|wap\\.|mobile\\.|read\\.|api\\.|app\\.|h5\\.)', '') else {re_all('lower(candidate)', f'[{W}]+', '_')} end as host_key,
  case when candidate is null then null when regexp_matches(candidate, '^https?://', 'i') then {re_all('candidate', '/+\\z')} when is_domain then {re_all("'https://' || candidate", '/+\\z')} else {trim('lower(candidate)')} end as url_key from u3)"""


def kw(c: str, category: str) -> str:
    return f"regexp_matches(lower({c}), '{one_of(vocab.KEYWORDS[category])}')"


ORDER = ("漫画", "小说", "有声", "影视", "下载")


def class_cte() -> str:
    shown, text = "coalesce(nullif(cleaned_name, ''), name, '')", "coalesce(nullif(cleaned_name, ''), name, '') || ' ' || coalesce(grp, '')"
    flags = ", ".join(f"{kw(text, c)} as k{i}, {kw(shown, c)} as n{i}, {kw(chr(39) * 2 + ' || coalesce(grp, ' + chr(39) * 2 + ')', c)} as g{i}" for i, c in enumerate(ORDER))
    media = "lower(coalesce(ct_regex, '') || ' ' || coalesce(search_url, '') || ' ' || coalesce(explore_url, ''))"
    flags += ", " + ", ".join(f"regexp_matches({media}, '{m[3]}') as m{i}" for i, m in enumerate(vocab.MEDIA_MARKS))
    tc = "case type when 0 then '小说' when 1 then '有声' when 2 then '漫画' when 3 then '下载' end"
    top = "case " + " ".join(f"when k{i} then '{c}'" for i, c in enumerate(ORDER)) + " end"
    grp = "case " + " ".join(f"when g{i} then '{c}'" for i, c in enumerate(ORDER)) + " end"
    votes = ["select idx, case when tc is null then '其他' else tc end as c, case when tc is null then 2 else 18 end as w, 0 as r from c1"]
    votes += [f"select idx, '{c}', 18, {1 + i} from c1 where k{i}" for i, c in enumerate(ORDER)]
    votes += [f"select idx, '{m[0]}', {m[1]}, {6 + i} from c1 where m{i}" for i, m in enumerate(vocab.MEDIA_MARKS)]
    votes += ["select idx, gc, 10, 10 from c1 where gc is not null", "select idx, '有声', 20, 11 from c1 where type = 1 and n2", "select idx, '漫画', 20, 11 from c1 where type = 2 and n0"]
    return f"""c0 as (select *, {flags} from nm), c1 as (select *, {tc} as tc, {top} as top, {grp} as gc from c0),
votes as ({' union all '.join(votes)}), sums as (select idx, c, sum(w) as s, min(r) as r from votes group by idx, c),
ranked as (select *, row_number() over (partition by idx order by s desc, r) as rn from sums),
best as (select idx, max(case when rn = 1 then c end) as bc, max(case when rn = 1 then s end) as bs, coalesce(max(case when rn = 2 then s end), 0) as ss from ranked group by idx),
c2 as (select c1.*, bc, bs, ss, tc is not null and top is not null and tc <> top as clash, regexp_matches(coalesce(name, '') || ' ' || coalesce(grp, ''), '{vocab.DEAD_MARKS}') as dead from c1 join best using (idx)),
cl as (select *, case when dead then '失效' else bc end as category, case when dead then 'high' when bs >= 20 then case when ss > 0 and bs - ss <= 10 and clash then 'conflict' when clash then 'medium' else 'high' end
  when bs >= 10 then case when clash then 'low' else 'medium' end else 'low' end as confidence, case when clash then 'type-vs-keyword:' || tc || '-vs-' || top end as conflict from c2)"""


def blank(c: str) -> str:
    return f"coalesce({trim(c)}, '') = ''"


def struct_cte(source: str = "cl", category: str = "category") -> str:
    has, cat = "coalesce(ct_keys, 0) > 0", category
    rules = [
        (blank("name"), "'Missing bookSourceName'", "true"), (blank("url"), "'Missing bookSourceUrl'", "true"), ("type is null", "'Missing bookSourceType'", "false"), (blank("search_url"), "'Missing searchUrl'", "false"),
        ("coalesce(rs_keys, 0) = 0", "'Missing ruleSearch'", "true"), (f"coalesce(rs_keys, 0) > 0 and {blank('rs_list')}", "'Missing ruleSearch.bookList'", "false"),
        (f"coalesce(rs_keys, 0) > 0 and {blank('rs_name')}", "'Missing ruleSearch.name'", "false"), (f"coalesce(rs_keys, 0) > 0 and {blank('rs_url')}", "'Missing ruleSearch.bookUrl'", "false"),
        ("coalesce(bi_keys, 0) = 0", "'Missing ruleBookInfo'", "false"), (f"coalesce(bi_keys, 0) > 0 and {blank('bi_name')}", "'Missing ruleBookInfo.name'", "false"),
        ("coalesce(toc_keys, 0) = 0", "'Missing ruleToc'", "false"), (f"coalesce(toc_keys, 0) > 0 and {blank('toc_list')}", "'Missing ruleToc.chapterList'", "false"),
        (f"not ({has})", "'Missing ruleContent'", f"coalesce({cat} = '小说', false)"),
        (f"{has} and {blank('ct_content')} and (coalesce({cat} in ('小说', '有声', '下载'), false) or {blank('ct_image')})", f"case when {cat} = '漫画' then 'Missing ruleContent.content (novel) or imageStyle (comic)' when {cat} = '下载' then 'Missing ruleContent.content (download link)' else 'Missing ruleContent.content' end", f"coalesce({cat} = '小说', false)"),
    ]
    reasons = "concat_ws('; ', " + ", ".join(f"case when {c} then {r} end" for c, r, _ in rules) + ")"
    critical = " or ".join(f"({c} and {k})" for c, _, k in rules)
    return f"st as (select *, {reasons} as reasons, case when {critical} then 'STRUCTURE_INVALID' when {reasons} <> '' then 'STRUCTURE_WARN' else 'STRUCTURE_OK' end as structure_status from {source})"


AVAILABILITY = """case when structure_status = 'STRUCTURE_INVALID' then 'invalid' when login = 'needsLogin' then 'needs_login' when login = 'loginRelated' then 'login_related'
  when connectivity = 'NOT_CHECKED' then case when structure_status = 'STRUCTURE_WARN' then 'probably_usable' else 'unknown' end
  when connectivity = 'NON_HTTP_SOURCE' then case when regexp_matches(coalesce(search_url, ''), '^https?://', 'i') then 'probably_usable' else 'complex_unverified' end
  when connectivity = 'CONNECT_OK' then case when search_status in ('SEARCH_HTTP_OK', 'SEARCH_RULE_LIKELY_OK', 'SEARCH_PARSE_OK') then 'usable' when search_status in ('SEARCH_COMPLEX_JS_SKIPPED', 'SEARCH_SKIPPED_JS', 'SEARCH_TEMPLATE_COMPLEX') then 'complex_unverified' else 'probably_usable' end
  when connectivity = 'CONNECT_FORBIDDEN' then 'forbidden' when connectivity = 'CONNECT_DEAD' then case when search_status in ('SEARCH_HTTP_OK', 'SEARCH_RULE_LIKELY_OK') then 'probably_usable' else 'dead' end
  when connectivity = 'CONNECT_TIMEOUT' then 'timeout' else 'unknown' end"""
LOGIN = "case when coalesce(login_url, '') <> '' or coalesce(login_ui, '') <> '' or coalesce(login_check_js, '') <> '' then case when regexp_matches(coalesce(login_check_js, ''), 'cookie|token|session', 'i') then 'needsLogin' else 'loginRelated' end end"


def avail_cte(online: bool = True) -> str:
    found = f"{CONNECTIVITY_SQL} as connectivity, {SEARCH_SQL} as search_status" if online else "'NOT_CHECKED' as connectivity, 'NOT_CHECKED' as search_status"
    return f"a0 as (select *, {LOGIN} as login, {found} from st), av as (select *, {AVAILABILITY} as availability from a0)"


def bracket(c: str, brackets: tuple) -> str:
    return "case " + " ".join(f"when {c} <= {m} then {b}" for m, b in brackets) + " else 0 end"


def score_parts() -> list[tuple[str, str, str]]:
    js = "concat_ws(chr(10), search_url, explore_url, login_url, login_check_js, js_lib)"
    ev, dy, stc = (f"regexp_matches({js}, '{p}', 'i')" for p in (r"\beval\b", r"java\.ajax|\bcookie\b|\bcache\b|WebView|Reload|source\.getKey|source\.login", "<js>|@js:"))
    days = f"({AS_OF} - last_update_time) / 86400000.0"
    some = lambda c: f"coalesce({c}, '') <> ''"
    parts = [(f"availability_{k}", f"availability = '{k}'", str(v)) for k, v in (("usable", 100), ("probably_usable", 70), ("complex_unverified", 40), ("dead", -100), ("invalid", -100), ("timeout", -30), ("forbidden", -10))]
    return parts + [
        ("connect_ok", "connectivity = 'CONNECT_OK'", "30"), ("search_http_ok", "search_status in ('SEARCH_HTTP_OK', 'SEARCH_PARSE_OK')", "30"), ("search_rule_likely_ok", "search_status = 'SEARCH_RULE_LIKELY_OK'", "20"),
        ("enabled", "enabled", "10"), ("enabled_explore", "enabled_explore", "5"), ("has_search_url", some("search_url"), "10"), ("has_rule_search_booklist", some("rs_list"), "10"), ("has_rule_search_name", some("rs_name"), "8"),
        ("has_rule_search_bookurl", some("rs_url"), "8"), ("has_rule_bookinfo_name", some("bi_name"), "8"), ("has_rule_toc_chapterlist", some("toc_list"), "8"), ("has_rule_content_content", some("ct_content"), "8"),
        ("respond_time", "respond_time >= 0", bracket("respond_time", vocab.RESPOND_BONUS)), ("respond_time_high", "respond_time > 30000", "-20"),
        ("last_update", f"last_update_time > 0 and last_update_time <= {AS_OF} + 86400000", bracket(days, vocab.UPDATE_BONUS)), ("last_update_old", f"last_update_time is null or last_update_time <= 0 or {AS_OF} - last_update_time > 31536000000", "-10"),
        ("weight", "weight is not null", "case when weight >= 10000 then 10 when weight >= 5000 then 8 when weight >= 1000 then 5 when weight >= 100 then 2 else 0 end"), ("classification_high", "confidence = 'high'", "5"),
        ("name_contains_dead", "coalesce(name, '') like '%失效%'", "-40"), ("group_contains_dead", "regexp_matches(coalesce(grp, ''), '失效|校验超时')", "-40"), ("missing_search_url", "coalesce(search_url, '') = ''", "-20"),
        ("missing_rule_search", "rs_keys is null", "-20"), ("missing_rule_content", "coalesce(ct_keys, 0) = 0", "-20"), ("needs_login", "availability in ('needs_login', 'login_related')", "-10"),
        ("complex_js_eval", ev, "-20"), ("complex_js_dynamic", f"{dy} and not {ev}", "-10"), ("complex_js_static", f"{stc} and not {dy} and not {ev}", "-5"),
    ]


def score_cte() -> str:
    total = " + ".join(f"case when {c} then {v} else 0 end" for _, c, v in score_parts())
    return f"sc as (select *, cast({total} as int) as score from av)"


def upto_score(online: bool = True) -> str:
    return f"with {names_cte()}, {class_cte()}, {struct_cte()}, {avail_cte(online)}, {score_cte()}"


def dedupe_key(level: str) -> str:
    low = trim("lower(coalesce(nullif(cleaned_name, ''), nullif(name, ''), url, ''))")
    web = "coalesce(regexp_matches(url, '^https?://', 'i'), false)"
    kind = "coalesce(cast(type as varchar), '{}')"
    return "nullif(" + {
        "exact": f"lower({trim('url')})", "url": "url_key",
        "conservative": f"case when url_key is not null then url_key || ':' || category || ':' || {kind.format('x')} else 'conservative-nonhttp:' || {kind.format('-1')} || ':' || category || ':' || {low} end",
        "host": f"case when {web} then host_key else 'non-http:' || {kind.format('-1')} || ':' || {low} end",
        "aggressive": f"case when {web} then concat_ws('::', host_key, lower(coalesce(nullif(cleaned_name, ''), nullif(name, '')))) else 'non-http-aggressive:' || {kind.format('-1')} || ':' || {low} end",
    }[level] + ", '')"


RULE_FIELDS = " + ".join(f"cast(coalesce({c}, '') <> '' as int)" for c in ("rs_list", "rs_name", "rs_author", "rs_url", "bi_name", "bi_author", "toc_list", "toc_name", "ct_content"))
SURVIVOR = "score desc, case availability " + " ".join(f"when '{k}' then {v}" for k, v in vocab.AVAILABILITY_RANK.items()) + f" else 99 end, respond_time asc nulls last, coalesce(last_update_time, 0) desc, coalesce(weight, 0) desc, {RULE_FIELDS} desc, idx"


def upto_dedupe(level: str, online: bool = True, where: str = "true") -> str:
    risk = "bool_or(category is distinct from kcat or type is distinct from ktype) over (partition by part)" if level in ("host", "aggressive") else "false"
    return f"""{upto_score(online)}, sf as (select * from sc where {where}), {urls_cte('sf')}, dk as (select *, {dedupe_key(level)} as dedupe_key from nu), dp as (select *, coalesce(dedupe_key, chr(1) || idx) as part from dk),
d1 as (select *, row_number() over w as dup_rank, count(*) over (partition by part) as dup_size, min(idx) over (partition by part) as dup_first_idx, first_value(idx) over w as kidx, first_value(name) over w as kname, first_value(score) over w as kscore,
  first_value(category) over w as kcat, first_value(type) over w as ktype, first_value(availability) over w as kavail, first_value(rs_list) over w as krs_list, first_value(rs_name) over w as krs_name, first_value(rs_url) over w as krs_url, first_value(bi_name) over w as kbi_name,
  first_value(toc_list) over w as ktoc_list, first_value(ct_content) over w as kct_content, first_value(last_update_time) over w as klast, first_value(respond_time) over w as krt from dp window w as (partition by part order by {SURVIVOR} rows between unbounded preceding and unbounded following)),
dd as (select *, dup_size > 1 and {risk} as dup_risk from d1), de as (select *, dup_rank = 1 or dup_risk as dup_kept from dd)"""


def reason(k: str = "k") -> str:
    same = lambda a, b: f"case when {a} is not distinct from {b} then 'yes' else 'no' end"
    return f"""case when not dup_kept then 'Duplicate of "' || kname || '" (score diff: ' || (kscore - score) || ', same category: ' || {same('category', 'kcat')} || ', same type: ' || {same('type', 'ktype')} || ')' end"""


KEPT_TAGS = "list_filter(list_transform(string_split(coalesce(grp, ''), ','), lambda x: trim(x)), lambda x: x <> '' and x <> category and x not in ('小说', '漫画', '有声', '影视', '下载'))"
CATEGORY_FIRST = f"case when len({KEPT_TAGS}) > 0 then category || ', ' || array_to_string({KEPT_TAGS}, ', ') else category end"
EXCLUDED = "availability in ('dead', 'timeout', 'forbidden', 'invalid', 'unknown', 'complex_unverified')"


def reviewed() -> str:
    """rv: every record of an offline run with default switches, with its outcome."""
    return f"""{upto_dedupe('conservative', False, 'coalesce(enabled, true)')}, rv0 as (
select idx, name, url, grp, type, cleaned_name, category, availability, structure_status, respond_time, score, dup_kept as after_dedupe, {reason()} as why from de
union all select idx, name, url, grp, type, cleaned_name, category, availability, structure_status, respond_time, score, false, 'Filtered: disabled source excluded' from sc where not coalesce(enabled, true)),
rv as (select *, {CATEGORY_FIRST} as final_group, after_dedupe and not {EXCLUDED} as kept, coalesce(why, case when {EXCLUDED} then 'Excluded: availability=' || availability end) as removed_reason from rv0)"""


def unescaped(c: str) -> str:
    for coded, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = f"replace({c}, '{coded}', '{plain}')"
    return c
