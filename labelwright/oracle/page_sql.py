"""Page reading as SQL."""

from __future__ import annotations

from ..functions import html as H
from ..functions import urls as U
from ..operators import marketplaces as M
from ..functions.text import any_of
from .sqlx import case, extract, has, nz, q, re2, replace_all, strip


def decode(e: str) -> str:
    for ref, ch in H.REFERENCES:
        e = f"replace({e}, {q(ref)}, {q(ch)})"
    return e


def extract_all(e: str, pattern: str, group: int = 1, flags: str = "is") -> str:
    return f"regexp_extract_all({e}, {q(re2(pattern, flags))}, {group})"


def node_text(e: str, sep: str = "' '") -> str:
    bare = replace_all(replace_all(e, H.UNSEEN, "\u0001", "is"), H.TAG, "\u0001", "")
    pieces = f"list_transform(string_split({decode(bare)}, chr(1)), lambda p: {strip('p')})"
    return f"array_to_string(list_filter({pieces}, lambda p: p <> ''), {sep})"


def rows(e: str) -> str:
    """List of {key, value} structs of table rows."""
    cells = f"list_transform({extract_all(e, H.ROW)}, lambda r: {extract_all('r', H.CELL)})"
    pairs = (
        f"list_transform({cells}, lambda c: {{'key': trim({node_text('c[1]')}, ':'), 'value': {node_text('c[2]')}}})"
    )
    return f"list_filter({pairs}, lambda s: s.key <> '' AND s.value <> '')"


def row_value(key: str, rows_col: str = "rows") -> str:
    return f"list_filter({rows_col}, lambda s: s.key = {q(key)})[-1].value"


def visible(e: str) -> str:
    return replace_all(e, H.UNSEEN, "", "is")


def _apart(e: str, kind: str) -> str:
    """Pieces that start at the tags of a kind; the first starts with none."""
    return f"string_split(regexp_replace({e}, '(</?' || {kind} || '[\\s/>])', chr(2) || '\\1', 'gi'), chr(2))"


def _steps(parts: str) -> str:
    """Change of depth at each piece but the first."""
    return (
        f"list_transform(list_zip({parts}, range(1, len({parts}) + 1)), lambda z: CASE WHEN z[2] = 1 THEN 0 WHEN starts_with(z[1], '</') THEN -1 "
        "WHEN regexp_matches(z[1], '^<[^>]*/>') THEN 0 ELSE 1 END)"
    )


def element(e: str, opening: str) -> str:
    """Inner HTML of the first element with this opening tag: to the piece at which the steps sum to -1."""
    tag, kind = extract("v", opening, 0, "is"), f"lower({extract('v', opening, 1, 'is')})"
    rest = f"v[instr(v, {tag}) + length({tag}):]"
    end = "list_filter(range(2, len(x.p) + 1), lambda i: list_sum(x.s[2:i]) = -1)[1]"
    parts = f"list_transform([{_apart(rest, kind)}], lambda p: {{'p': p, 's': {_steps('p')}}})"
    inner = f"list_transform({parts}, lambda x: array_to_string(x.p[1:coalesce({end} - 1, len(x.p))], ''))[1]"
    return f"list_transform([{visible(e)}], lambda v: CASE WHEN {tag} <> '' THEN {nz(inner)} END)[1]"


def elements(e: str, kinds: list[str], attributes: str = "") -> str:
    """Inner HTML of all elements with this opening tag, by place."""
    each = []
    for k in kinds:
        parts = f"list_transform([{_apart('v', q(k))}], lambda p: {{'p': p, 's': {_steps('p')}}})"
        depth = "list_sum(x.s[1:{0}])"
        end = f"list_filter(range(i + 1, len(x.p) + 1), lambda j: {depth.format('j')} = {depth.format('i')} - 1)[1]"
        wanted = has("x.p[i]", rf"^<{k}\b[^>]*{attributes}[^>]*>", "is")
        inner = f"regexp_replace(x.p[i], '^<[^>]*>', '') || array_to_string(x.p[i + 1:coalesce({end} - 1, len(x.p))], '')"
        place = "length(array_to_string(x.p[1:i], ''))"
        each.append(
            f"list_transform({parts}, lambda x: list_transform(list_filter(range(2, len(x.p) + 1), lambda i: x.s[i] = 1 AND {wanted}), "
            f"lambda i: {{'at': {place}, 'h': {inner}}}))[1]"
        )
    found = each[0] if len(each) == 1 else "list_concat(" + ", ".join(each) + ")"
    return f"list_transform([{visible(e)}], lambda v: list_transform(list_sort({found}), lambda f: f.h))[1]"


def section(e: str, element_id: str) -> str:
    return element(e, H.by_id(element_id))


def items(e: str) -> str:
    return f"list_transform({extract_all(e, H.ITEM)}, lambda i: {node_text('i')})"


def key_value_items(e: str) -> str:
    p = r"^([^:]*):(.*)$"
    pairs = f"list_transform({items(e)}, lambda t: {{'key': {strip(extract('t', p, 1, 's'))}, 'value': {strip(extract('t', p, 2, 's'))}}})"
    return f"list_filter({pairs}, lambda s: s.key <> '' AND s.value <> '')"


def attribute(tag: str, name: str) -> str:
    p = rf"\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return decode(f"({extract(tag, p, 1, 'is')} || {extract(tag, p, 2, 'is')})")


def metas(e: str) -> str:
    tag = f"list_transform({extract_all(e, H.META, 0)}, lambda g: {{'prop': coalesce({nz(attribute('g', 'property'))}, {attribute('g', 'name')}), 'content': {attribute('g', 'content')}}})"
    return f"list_filter({tag}, lambda s: s.content <> '')"


def first_contained(e: str, pairs, default: str) -> str:
    return case([(f"contains({e}, {q(k)})", q(v) if isinstance(v, str) else str(v).lower()) for k, v in pairs], default)


def platform(e: str = "lower(url)") -> str:
    return first_contained(e, [(k, n) for k, n, _ in U.PLATFORMS], "'Generic'")


def adapter(e: str = "lower(url)") -> str:
    key = first_contained(e, [(k, k) for k, _, _ in U.PLATFORMS], "'generic'")
    return f"CASE WHEN {key} IN ({', '.join(q(a) for a in M.ADAPTERS)}) THEN {key} ELSE 'generic' END"


def host() -> str:
    u = f"lower({strip('url')})"
    return f"({extract(u, U.URL_HOST, 1)} || {extract(u, U.URL_HOST, 2)})"


def url_status() -> str:
    u = f"lower({strip('url')})"
    h = host()
    return case(
        [
            (f"{u} = ''", "'EMPTY'"),
            (f"{extract(u, U.URL_SCHEME, 1)} NOT IN ('http', 'https')", "'BAD_SCHEME'"),
            (f"{h} = ''", "'NO_HOST'"),
            (f"{h} IN ('localhost', 'localhost.')", "'LOCALHOST'"),
            (f"{has(h, U.PRIVATE_V4)} OR {has(h, U.PRIVATE_V6)}", "'PRIVATE_ADDRESS'"),
            (has(h, U.DOTTED_QUAD), "'DIRECT_ADDRESS'"),
        ],
        "'OK'",
    )


def canonical_url(by_region: bool) -> str:
    asin = extract("url", U.ASIN, 1, "")
    site = (
        "CASE WHEN contains(url, 'amazon.in') OR contains(url, '.in/') THEN 'www.amazon.in' ELSE 'www.amazon.com' END"
        if by_region
        else "'www.amazon.in'"
    )
    return f"CASE WHEN {asin} <> '' THEN 'https://' || {site} || '/dp/' || {asin} || '?th=1&psc=1' ELSE url END"


def category(text: str) -> str:
    hint = first_contained("lower(url)", U.CATEGORY_HINTS, "NULL")
    word = case([(has(f"lower({text})", p), q(v)) for p, v in U.CATEGORY_WORDS])
    return f"coalesce({hint}, {word})"


def relevant(adapter_name: str, key: str) -> str:
    cond = f"regexp_matches(lower({key}), {q(any_of(M.COMPLIANCE_KEYS[adapter_name]))})"
    skipped = M.SKIPPED_KEYS.get(adapter_name)
    return f"({cond} AND NOT regexp_matches(lower({key}), {q(any_of(skipped))}))" if skipped else cond


def source(step: tuple, named: dict[str, str]) -> str:
    kind = step[0]
    if kind == "rows":
        return nz(strip('coalesce(' + ', '.join(row_value(k) for k in step[1]) + ')'))
    if kind == "licence_rows":
        return "coalesce(" + ", ".join(nz(extract(replace_all(row_value(k), r"\s", "", ""), r"[1-9]\d{13}", 0, "")) for k in step[1]) + ")"
    if kind == "number_rows":
        return "coalesce(" + ", ".join(f"replace({nz(extract(row_value(k), r'[0-9,]+[.]?[0-9]{0,2}', 0, ''))}, ',', '')" for k in step[1]) + ")"
    if kind in ("text", "html"):
        return nz(strip(extract("corpus" if kind == "text" else "html", step[1], 1, step[2])))
    if kind == "plain":
        return nz(strip(f"replace({extract('corpus', step[1], 1, step[2])}, ',', '')"))
    if kind == "whole":
        return nz(strip(extract("corpus", step[1], 0, step[2])))
    if kind == "sane_price":
        p = f"replace({extract('corpus', step[1], 1, '')}, ',', '')"
        return f"CASE WHEN try_cast({p} AS DOUBLE) BETWEEN 1 AND 100000 THEN {p} END"
    return named[step[1]]


def next_script() -> str:
    return strip(extract("html", r"<script\b[^>]*\bid\s*=\s*[\"']__(?:NEXT|NUXT)_DATA__[\"'][^>]*>(.*?)</script\s*>", 1, "is"))


def title(adapter_name: str) -> str:
    patterns = M.TITLE.get(adapter_name, M.TITLE["generic"])
    return "coalesce(" + ", ".join(nz(node_text(f"coalesce({element('html', p)}, '')")) for p in patterns) + ")"


def record(pages: str, adapter_name: str, fields: list[str], named: dict[str, str], extra: str = "", corpus: str | None = None, base_rows: str | None = None) -> str:
    """Record fields of one marketplace's pages; ``named`` gives the prepared columns used by the spec."""
    spec = M.FIELDS[adapter_name]
    cols = ", ".join(f"coalesce({', '.join(source(s, named) for s in spec[f] if s != ('column', 'party_phone'))}) AS {f}" for f in fields)
    base_rows = base_rows or (rows("html") if adapter_name not in M.NO_ROWS else "[]")
    if adapter_name == "amazon":
        details = "flatten([" + ", ".join(key_value_items(f"coalesce({section('html', i)}, '')") for i in M.DETAIL_IDS) + "])"
        base_rows = (
            f"list_concat({base_rows}, list_reverse(list_filter({details}, lambda d: NOT list_contains(list_transform({rows('html')}, lambda r: r.key), d.key))))"
        )
    return f"""SELECT page_id, {cols}{extra} FROM (
  SELECT page_id, url, html, {corpus or node_text('html')} AS corpus, {base_rows} AS rows
  FROM ({pages}) p0 WHERE {adapter()} = {q(adapter_name)}) p1"""
