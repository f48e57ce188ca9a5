"""DuckDB SQL for the queries: the same results from the same tables by other means."""

from __future__ import annotations

from workload.adapters import CODE, ENTRY, GRAPH, PAGES, TALKS

BUDGET = 3000
_BLANK = (r"\t\v\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}")
_WS = r"[\n" + _BLANK + "]"
_EXT = r"lower(regexp_extract({}, '(?:^|/)[^/]+?(\.[^/.]*)$', 1))"
_C = f"code as ({CODE})"
_G = f"graph as ({GRAPH})"
_T = f"talks as ({TALKS})"


def _with(*ctes: str, recursive: bool = False) -> str:
    *named, final = ctes
    return ("with recursive " if recursive else "with ") + ",\n".join(named) + "\n" + final


def _ext(col: str = "path") -> str:
    return _EXT.format(col)


def _strip_c(x: str) -> str:
    return (rf"regexp_replace(regexp_replace({x}, '/\*[\s\S]*?\*/', '', 'g'), "
            r"'(^|[^:])//[^\n]*', '\1', 'g')")


def _strip_hash(x: str) -> str:
    return rf"regexp_replace({x}, '(^|{_WS})#[^\n]*', '\1', 'g')"


def _strip_html(x: str) -> str:
    return rf"regexp_replace({x}, '<!--[\s\S]*?-->', '', 'g')"


def _strip_imports(x: str) -> str:
    quoted = "[''\"][^''\"]+[''\"]"
    x = rf"regexp_replace({x}, '(?m)^import{_WS}+[\s\S]*?from{_WS}+{quoted};?', '', 'g')"
    x = rf"regexp_replace({x}, '(?m)^import{_WS}+{quoted};?', '', 'g')"
    return rf"regexp_replace({x}, '(?m)^(const|let|var){_WS}+[^\n\r]*={_WS}*require\({quoted}\);?', '', 'g')"


def _license(x: str) -> str:
    lead = rf"regexp_extract({x}, '^(/\*[\s\S]*?\*/|//[^\n]*\n+)')"
    return f"case when contains(lower({lead}), 'license') then {lead} || chr(10) else '' end"


def _collapse(x: str) -> str:
    return rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def _trim(x: str) -> str:
    lines = rf"regexp_replace({x}, '[{_BLANK}]+(\n|$)', '\1', 'g')"
    return rf"regexp_replace({lines}, '^{_WS}+|{_WS}+$', '', 'g')"


def _units(x: str) -> str:
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def _tokens(x: str) -> str:
    return f"cast(ceil({_units(x)} / 4.0) as bigint)"


_LANGUAGE = f"""case when {_ext()} in ('.ts', '.tsx') then 'typescript'
  when {_ext()} in ('.js', '.jsx', '.cjs', '.mjs') then 'javascript'
  when {_ext()} in ('.html', '.htm') then 'html' when {_ext()} in ('.css', '.scss', '.less') then 'css'
  when {_ext()} = '.py' then 'python' when {_ext()} = '.json' then 'json' when {_ext()} = '.md' then 'markdown'
  when {_ext()} in ('.sh', '.bash') then 'shell' else 'plaintext' end"""

# The ignore file of the code corpus, spelled out.
_IGNORED = """(path like 'src/es/%' or (regexp_matches(path, '^src/[^/]+/d[^/]*[05][.]md$')
  and (path not like 'src/en/%' or right(project, 1) in ('0', '2', '4'))))"""
_MIN = "path like '%.min.js'"
_WEB = f"(regexp_matches(path, '^src/(en|fr)/') and {_ext()} in ('.ts', '.js', '.css') and not {_MIN})"
_DOCS = f"({_ext()} in ('.md', '.json'))"
_REST = f"(not {_MIN} and not {_IGNORED})"

_CHOSEN = f"""chosen as (
  select *, case strategy_idx when 0 then 'web' when 1 then 'docs' else 'rest' end as strategy,
    case strategy_idx when 0 then 'Folder files: web' when 1 then 'Pattern match: docs' else 'Full strategy: rest' end as reason
  from (select *, case when {_WEB} then 0 when {_DOCS} then 1 when {_REST} then 2 end as strategy_idx from code) picked
  where strategy_idx is not null)"""

_WRAPPED = f"""spoken as (select *, {_LANGUAGE} as language, {_license('content')} as head from chosen),
bare as (select *, case when language in ('typescript', 'javascript', 'css') then {_strip_c('content')}
    when language in ('python', 'shell') then {_strip_hash('content')}
    when language = 'html' then {_strip_html('content')} else content end as stripped from spoken),
headed as (select *, case when head <> '' and not starts_with(stripped, head) then head || stripped else stripped end as body from bare),
cleaned as (select *, {_trim(_collapse(f"case when language in ('typescript', 'javascript') then {_strip_imports('body')} else body end"))} as clean
  from headed),
wrapped as (select project, path, strategy_idx, strategy, reason, language, strlen(content) as original_size,
  '// ===== FILE: ' || path || ' =====' || chr(10) || '// Reason: ' || reason || chr(10) || clean || chr(10) ||
  '// ===== END: ' || path || ' =====' as text from cleaned),
ordered as (select *, {_tokens('text')} as tokens, strlen(text) as processed_size,
  row_number() over (partition by project order by strategy_idx, path) as ord from wrapped)"""

_STAMP = "2024-01-02T03:04:05.678Z"


def _manifest(files: str, keys: str, title: str, names: str, heads_from: str) -> str:
    """CTE manifest(keys, seq, text)."""
    on = " and ".join(f"h.{k} = f.{k}" for k in keys.split(", "))
    listed = (f"chr(10) || '    \"' || " + " || '\",' || chr(10) || '    \"' || ".join(f"'{n}'" for n in names.split(","))
              + " || '\"' || chr(10) || '  '")
    hk = ", ".join(f"h.{k}" for k in keys.split(", "))
    return f"""heads as (select {hk}, {title} as title, count(f.path) as n, coalesce(sum(f.tokens), 0) as t,
    coalesce(max(f.ord), 0) as last_ord from {heads_from} h left join {files} f on {on} group by all),
manifest as (
  select {keys}, 0 as seq, '/* MANIFEST:' || chr(10) || '{{' || chr(10) || '  "generatedAt": "{_STAMP}",' || chr(10) ||
    '  "projectName": "' || title || '",' || chr(10) || '  "strategies": [' || {listed} || '],' || chr(10) ||
    '  "files": [' || case when n = 0 then '],' else '' end as text from heads
  union all
  select {hk}, ord as seq, '    {{' || chr(10) || '      "path": "' || path || '",' || chr(10) || '      "tokens": ' || tokens ||
    ',' || chr(10) || '      "reason": "' || reason || '"' || chr(10) || '    }}' || case when ord = last_ord then '' else ',' end as text
  from heads h join {files} f on {on}
  union all
  select {keys}, last_ord + 1 as seq, case when n = 0 then '' else '  ],' || chr(10) end || '  "totalFiles": ' || n || ',' || chr(10) ||
    '  "totalTokens": ' || t || chr(10) || '}}' || chr(10) || '*/' as text from heads)"""


def _tree(files: str, keys: str) -> str:
    """CTE tree(keys, node, line) by flags of every prefix."""
    return f"""steps as (select distinct {keys}, list_slice(p, 1, n) as parts
    from (select {keys}, string_split(path, '/') as p, unnest(generate_series(1, len(string_split(path, '/')))) as n from {files}) x),
flagged as (select *, row_number() over (partition by {keys}, parts[:-2] order by parts[-1] desc) = 1 as is_last from steps),
levels as (select {keys}, parts, unnest(generate_series(1, len(parts) - 1)) as lv from steps),
bars as (select {', '.join('l.' + k for k in keys.split(', '))}, l.parts,
    string_agg(case when f.is_last then '    ' else '│   ' end, '' order by l.lv) as indent
  from levels l join flagged f on {' and '.join(f'l.{k} = f.{k}' for k in keys.split(', '))} and f.parts = l.parts[1:l.lv] group by all),
tree as (select {', '.join('f.' + k for k in keys.split(', '))}, array_to_string(f.parts, '/') as node, f.parts,
    coalesce(b.indent, '') || case when f.is_last then '└── ' else '├── ' end || f.parts[-1] as line
  from flagged f left join bars b on {' and '.join(f'b.{k} = f.{k}' for k in keys.split(', '))} and b.parts = f.parts)"""


def _packed(source: str, start: str) -> str:
    """CTE packed(project, path, ord, tokens, part): one file after the other."""
    return f"""starts as ({start}),
run(project, path, ord, tokens, part, fill) as (
  select f.project, f.path, f.ord, f.tokens,
    case when s.fill < 0 then 1 when s.fill + f.tokens > {BUDGET} then 2 else 1 end,
    case when s.fill < 0 or s.fill + f.tokens > {BUDGET} then f.tokens else s.fill + f.tokens end
  from {source} f join starts s on s.project = f.project where f.ord = 1
  union all
  select f.project, f.path, f.ord, f.tokens, r.part + case when r.fill + f.tokens > {BUDGET} then 1 else 0 end,
    case when r.fill + f.tokens > {BUDGET} then f.tokens else r.fill + f.tokens end
  from run r join {source} f on f.project = r.project and f.ord = r.ord + 1),
packed as (select project, path, ord, tokens, cast(part as bigint) as part from run)"""


_CODE_HEADS = "(select distinct project from code)"
_CODE_MANIFEST = _manifest("ordered", "project", "h.project", "web,docs,rest", _CODE_HEADS)
_CODE_TREE = _tree("ordered", "project")
_TREE_HEAD = "'/* FILE TREE:' || chr(10) || 'Project Tree Structure:' || chr(10) || '.'"
_PREAMBLE = f"""preamble as (
  select project, 0 as section, seq, '' as step, text from manifest
  union all select project, 1, 1, node, line from tree
  union all select project, 1, 0, '', {_TREE_HEAD} from heads
  union all select project, 1, 2, '', chr(10) || '*/' from heads)"""
_START = f"""select project, cast(ceil(length(
    max(case when section = 0 then body end) || chr(10) || chr(10) || max(case when section = 1 then body end)) / 4.0) as bigint) as fill
  from (select project, section, string_agg(text, chr(10) order by seq, string_split(step, '/')) as body from preamble group by all) b
  group by project"""
_STAGES = [_C, _CHOSEN, _WRAPPED, _CODE_MANIFEST, _CODE_TREE, _PREAMBLE]
_BASE = "'corpus-2024-01-02T03-04-05-678Z.txt'"
_PART = f"case when part = 1 then {_BASE} else replace({_BASE}, '.txt', '-part' || part || '.txt') end"


def _code(expr: str, extra: str = "") -> str:
    return _with(_C, f"select project, path, {expr} from code{extra}")


def _digest(expr: str, cte: str = _C, table: str = "code") -> str:
    return _with(cte, f"select project, path, md5(changed) as digest, length(changed) as chars "
                      f"from (select project, path, {expr} as changed from {table}) x")


def _bytes(code: str) -> str:
    """A character for every byte n of the content."""
    numbers = "list_transform(regexp_extract_all(hex(content), '..'), lambda h: cast('0x' || h as int))"
    return f"coalesce(list_aggregate(list_transform({numbers}, lambda n: chr({code})), 'string_agg', ''), '')"


# --- graph -----------------------------------------------------------------------------------

_Q = """(?:"[^"\\n]*"|''[^''\\n]*'')"""
_LEXER = "|".join([
    r"//[^\n]*", r"/\*[\s\S]*?\*/", r"\bimport\s*\(\s*" + _Q,
    r"\bimport\b\s*(?:[\w$\s{},*]*?\bfrom\s*)?" + _Q, r"\brequire\s*\(\s*" + _Q, _Q])
_RAW = rf"""found as (select project, path as src, regexp_extract_all(content, '{_LEXER}') as all_tokens
    from graph where {_ext()} in ('.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.mts', '.cts')),
kept as (select project, src, list_filter(all_tokens, lambda t: regexp_matches(t, '^(import|require)\b')) as tokens from found),
tokens as (select project, src, unnest(tokens) as token, unnest(range(len(tokens))) as ord from kept),
raw as (select project, src, ord, token,
    case when token like 'require%' then 'require' when regexp_matches(token, '^import\s*\(') then 'dynamic' else 'import' end as form,
    regexp_extract(token, '[''"]([^\n]*)[''"]$', 1) as spec,
    regexp_matches(token, '^import\s+type\s*[{{*]') or regexp_matches(token, '^import\s+type\s+[\w$]+\s+from') as type_only
  from tokens)"""
# Where a target may be, for the three ways of naming one that the corpus has.
_RESOLVED = """targets as (select *, case
    when spec like '@lib/%' then 'src/m0/' || spec[6:]
    when spec = 'dep' then 'node_modules/dep'
    else 'src/' || regexp_replace(spec, '^[./]+', '') end as stem from raw),
resolved as (select t.project, t.src, g.path as dst, case when form = 'import' then 0 else 1 end as kind, t.ord, t.spec, t.type_only, t.form,
    case form when 'require' then 'Required by ' when 'dynamic' then 'Dynamic imported by ' else 'Imported by ' end
      || t.src || ' ("' || t.spec || '")' as reason
  from targets t join graph g on g.project = t.project and g.path in
    (t.stem || '.ts', t.stem || '.tsx', t.stem || '.js', t.stem || '/index.ts'))"""
_NEST = """nest as (select project from graph where path = 'package.json' and coalesce(nullif(coalesce(
    json_extract_string(content, '$.devDependencies."@nestjs/core"'), json_extract_string(content, '$.dependencies."@nestjs/core"')), ''), '') <> '')"""
_MODULES = """modules as (
  select r.project, r.src, r.dst, 2 as kind, p.turn_no as ord, p.ident as spec, false as type_only, '' as form,
    'NestJS @Module imports in ' || r.src || ' (' || p.ident || ')' as reason
  from resolved r join nest using (project) cross join (values ('C', 0), ('y', 1)) p(ident, turn_no)
  where r.form = 'import' and not r.type_only and r.ord = 0
  union all
  select s.project, s.src, s.src, 2, 2, 'Loader', false, '', 'NestJS @Module providers in ' || s.src || ' (Loader)'
  from found s join nest using (project) where regexp_matches(s.src, '^src/'))"""
_EDGES = """edges as (select * from (select * from resolved union all select * from modules) e
  where dst not like 'node_modules/%')"""
_GRAPH = [_G, _RAW, _RESOLVED, _NEST, _MODULES, _EDGES]


def _closure(name: str, entry: str, depth: int, end: str = "", edges: str = "edges") -> str:
    return f"""walks{end}(project, path, depth, trail, reason) as (
  select project, path, 0, []::struct(kind int, ord bigint)[], 'Entry file: ' || path from graph where path = '{entry}'
  union all
  select w.project, e.dst, w.depth + 1, list_append(w.trail, {{'kind': e.kind, 'ord': e.ord}}), e.reason
  from walks{end} w join {edges} e on e.project = w.project and e.src = w.path where w.depth < {depth}),
closure{end} as (select project, '{name}' as strategy, path, min(depth) as depth,
    arg_min(reason, {{'depth': depth, 'trail': trail}}) as reason from walks{end} group by project, path)"""


_CLOSURE = _closure("feature", ENTRY, 3)
_TOPO = f"""turns as (select e.project, e.src, e.dst, min({{'kind': e.kind, 'ord': e.ord}}) as turn
    from edges e join closure c on c.project = e.project and c.path = e.src where c.depth < 3 group by all),
adjacent as (select project, src, list(dst order by turn) as outs from turns group by all),
dfs(project, stack, met, done) as (
  select project, [path], [path], []::varchar[] from graph where path = '{ENTRY}'
  union all
  select project, case when nxt is null then stack[:-2] else list_append(stack, nxt) end,
    case when nxt is null then met else list_append(met, nxt) end,
    case when nxt is null then list_append(done, stack[-1]) else done end
  from (select d.*, list_filter(coalesce(a.outs, []), lambda x: not list_contains(d.met, x))[1] as nxt
        from dfs d left join adjacent a on a.project = d.project and a.src = d.stack[-1] where len(d.stack) > 0) step),
topo as (select project, 'feature' as strategy, unnest(done) as path, unnest(range(len(done))) as topo_pos
  from dfs where len(stack) = 0)"""
_FULL_GRAPH = [*_GRAPH, _CLOSURE, _TOPO]

_RULES = "regexp_matches(path, '{}')"


def oracle_sql() -> dict[str, str]:
    listing = "select project, path, '{}' as strategy, '{}' as reason from code where {}"
    sql = {
        "scan_full": _with(_C, listing.format("everything", "Full strategy: everything", _REST)),
        "scan_folder": _with(_C, listing.format("web", "Folder files: web", _WEB)),
        "scan_folder_file": _with(_C, f"""select project, path, 'one' as strategy,
            case when path = '.gitignore' then 'Folder file: one' else 'Folder files: one' end as reason
            from code where path = '.gitignore' or (path like 'src/en/%.ts')"""),
        "scan_pattern": _with(_C, listing.format("docs", "Pattern match: docs", f"""(path = '.gitignore' or
            ({_ext()} in ('.md', '.json') and path not like 'src/fr/%' and path not like '%5.md'))""")),
        "scan_dependency": _with(*_FULL_GRAPH, """select c.project, c.path, c.strategy, c.reason, t.topo_pos
            from closure c join topo t using (project, path)""", recursive=True),
        "scan_dependency_many": _with(
            *_GRAPH, _closure("all", ENTRY, 3, "_1"),
            _closure("values", "src/m1/f01.ts", 1, "_2", "(select * from edges where not type_only)"),
            _closure("packages", "src/m2/f02.ts", 2, "_3", "(select * from resolved union all select * from modules)"),
            """select project, strategy, path, depth, reason from closure_1 union all select project, strategy, path, depth, reason
            from closure_2 union all select project, strategy, path, depth, reason from closure_3""", recursive=True),
        "read_text": _digest("chr(65533) || content"),
        "read_latin1": _digest(_bytes("n")),
        "read_ascii": _digest(_bytes("n & 127")),
        "read_utf16": _digest("chr(65533) || content || chr(128512) || chr(65533)"),
        "detect_framework": _with(_G, """
            deps as (select project, coalesce(json_extract_string(content, '$.devDependencies."@nestjs/core"'),
                json_extract_string(content, '$.dependencies."@nestjs/core"'), '') as nest,
                coalesce(json_extract_string(content, '$.devDependencies.react'), '') as react
              from graph where path = 'package.json')""", """select project,
            case when nest <> '' then 'nestjs' when react <> '' then 'react' else 'generic' end as framework from deps"""),
        "ingest": _code("strlen(content) as size, md5(content) as digest"),
        "select_strategies": _with(_C, f"""select project, path, case when {_DOCS} then 'docs' else 'rest' end as strategy,
            case when {_DOCS} then 1 else 2 end as strategy_idx,
            case when {_DOCS} then 'Pattern match: docs' else 'Full strategy: rest' end as reason
            from code where {_DOCS} or {_REST}"""),
        "filter_exclude": _code(f"""(path like '%/fr/%' or {_MIN} or regexp_matches(path, '^src/[^/]+/d[^/]*7[.]json$')) as excluded,
            (path like 'src/en/%' and regexp_matches(path, '(^src/en/[^/]*5[.]ts|/d[^/]*7[.]json)$')) as excluded_below"""),
        "filter_gitignore": _code(f"{_IGNORED} as ignored"),
        "filter_extension": _with(_C, f"select project, path from code where {_ext()} in ('.ts', '.js')"),
        "filter_binary": _code("strlen(content) < 8192 as is_binary"),
        "filter_size": _code("strlen(content) as size", " where strlen(content) <= 2048"),
        "filter_depth": _with(_C, """select project, 'c/' || repeat('d/', folders) || regexp_extract(path, '[^/]+$') as path,
            folders <= 2 as within_3, folders <= 1 as within_2, folders = 0 as direct
            from (select project, path, cast(strlen(content) % 5 as int) as folders from code) sized"""),
        "norm_path": _code("path as normal"),
        "resolve_path": _code("""path as same, case when path = '.gitignore' then null else regexp_extract(path, '[^/]+$') end as up,
            'lib/' || regexp_extract(path, '[^/]+$') as rooted"""),
        "ext": _code("""case when path = '.gitignore' then '' else '.' || split_part(path, '.', -1) end as ext"""),
        "language": _code(f"{_LANGUAGE} as language"),
        "wrap": _digest("""'<<' || path || '|' || path || '>>' || case when project = 'src0' then '' else chr(10) || '// Reason: because' end
            || chr(10) || content || chr(10) || '<</' || path || '>>'"""),
        "group_key": _with(_C, _CHOSEN, r"""select project, path, reason as by_reason, strategy as by_strategy,
            case when contains(path, '/') then split_part(path, '/', 1) else 'root' end as by_folder, 'custom' as by_custom,
            regexp_replace(reason, '[^a-zA-Z0-9_-]', '_', 'g') as safe from chosen"""),
        "strip_c": _digest(_strip_c("content")),
        "strip_hash": _digest(_strip_hash("content")),
        "strip_html": _digest(_strip_html("content"), f"pages_files as ({PAGES})", "pages_files"),
        "license_header": _code(f"{_license('content')} as header"),
        "strip_imports": _digest(_strip_imports("content")),
        "collapse_blank": _digest(_collapse("content")),
        "trim_lines": _digest(_trim("chr(65279) || ' ' || chr(10) || content || chr(160) || chr(9) || chr(10)")),
        "line_numbers": _digest("""array_to_string(list_transform(range(1, len(string_split(content, chr(10))) + 1),
            lambda i: lpad(cast(i as varchar), cast(length(cast(len(string_split(content, chr(10))) as varchar)) as int), ' ') || ' | ' ||
              string_split(content, chr(10))[i]), chr(10))"""),
        "tokens": _code(f"""{_tokens('content')} as tokens, cast(ceil(({_units('content')} + 2) / 4.0) as bigint) as tokens_wide,
            cast(0 as bigint) as tokens_empty"""),
        "sizes": _with(_C, _CHOSEN, _WRAPPED, """select project, path, language, original_size, processed_size, tokens,
            md5(text) as digest from ordered"""),
        "sort_paths": _with(_C, """select project, path, row_number() over (partition by project order by lower(path)) as pos
            from (select project, case when path like '%s' then upper(path) else path end as path from code) capital"""),
        "dedup_first": _with(_C, _CHOSEN, "select project, path, strategy_idx, reason from chosen"),
        "output_order": _with(_C, _CHOSEN, """select project, path,
            row_number() over (partition by project order by strategy_idx, path) as ord from chosen"""),
        "export_totals": _with(_C, _CHOSEN, _WRAPPED, """select project, count(*) as total_files,
            cast(sum(tokens) as bigint) as total_tokens, cast(sum(processed_size) as bigint) as total_size from ordered group by project"""),
        "pack_parts": _with(_C, f"""sized as (select project, path, row_number() over (partition by project order by path) as ord,
              {_tokens("'// ===== FILE: ' || path || ' =====' || chr(10) || content || chr(10) || '// ===== END: ' || path || ' ====='")} as tokens
              from code)""", _packed("sized", "select distinct project, -1 as fill from sized"),
            "select project, path, ord, tokens, part from packed", recursive=True),
        "part_names": _with(*_STAGES, _packed("ordered", _START),
                            f"select project, path, ord, part, {_PART} as file_name from packed", recursive=True),
        "tree": _with(_T, _tree("talks", "project"), """select project,
            row_number() over (partition by project order by parts) as line_no, line from tree"""),
        "manifest": _with(_C, _CHOSEN, _WRAPPED, _CODE_MANIFEST, "select project, seq, text from manifest"),
        "export_split": _with(*_STAGES, _packed("ordered", _START), f"""
            select project, {_BASE} as file_name, section, seq, step, text from preamble union all
            select p.project, {_PART}, 2, p.ord, '', o.text from packed p join ordered o using (project, path)""", recursive=True),
        "edges_raw": _with(_G, _RAW, """select project, src, case when form = 'import' then 0 else 1 end as kind, ord, form, spec,
            type_only from raw"""),
        "edges": _with(_G, _RAW, _RESOLVED, "select project, src, dst, kind, ord, reason from resolved"),
        "edges_no_types": _with(_G, _RAW, _RESOLVED, """select project, src, dst, kind, ord, reason from resolved
            where not type_only and dst not like 'node_modules/%'"""),
        "edges_modules": _with(*_GRAPH, "select project, src, dst, spec, reason from modules"),
        "closure_bfs": _with(*_GRAPH, _CLOSURE, "select project, strategy, path, depth, reason from closure", recursive=True),
        "topo_order": _with(*_FULL_GRAPH, "select project, strategy, path, topo_pos from topo", recursive=True),
        "slice_lines": _digest("""(with l as (select string_split(content, chr(10)) as v)
            select array_to_string(list_concat(
                case when len(v) > 2 then ['// ... [2 lines omitted] ...'] else []::varchar[] end, v[3:7],
                case when len(v) > 19 then ['// ... [12 lines omitted] ...'] else []::varchar[] end, v[20:22],
                case when len(v) <= 2 then ['// ... [' || len(v) || ' lines omitted] ...']
                     when len(v) > 7 and len(v) <= 19 then ['// ... [' || (len(v) - 7) || ' lines omitted] ...']
                     when len(v) > 22 then ['// ... [' || (len(v) - 22) || ' lines omitted] ...'] else []::varchar[] end), chr(10)) from l)"""),
        "slice_symbols": _with(_G, """cut as (select project, path, string_split(content, chr(10)) as v from graph where path like 'src/%')""",
            """select project, path, array_to_string(list_concat(v[1:4], ['// ... [6 lines omitted] ...'], v[11:13],
                ['// ... [2 lines omitted] ...'], v[16:18], ['// ... [' || (len(v) - 18) || ' lines omitted] ...']), chr(10)) as sliced
            from cut"""),
    }
    sql["topo_order_joins"] = sql["topo_order"]
    single = f"""select project, {{}}section, seq, step, text from preamble union all
        select project, {{}}2, ord, '', text from ordered"""
    sql["export_single"] = _with(*_STAGES, single.format(f"{_BASE} as file_name, ", f"{_BASE}, "))
    sql["preview"] = _with(*_STAGES, single.format("", ""))

    def multi(stages, key, names, title, clean):
        files = f"""keyed as (select *, {key} as group_key, {clean} || '.txt' as file_name from ordered)"""
        groups = "(select distinct project, file_name, group_key from keyed)"
        return _with(*stages, files, _manifest("keyed", "project, file_name", title, names, groups),
                     _tree("keyed", "project, file_name"), f"""
            select project, file_name, 0 as section, seq, '' as step, text from manifest
            union all select project, file_name, 1, 1, node, line from tree
            union all select project, file_name, 1, 0, '', {_TREE_HEAD} from heads
            union all select project, file_name, 1, 2, '', chr(10) || '*/' from heads
            union all select project, file_name, 2, ord, '', text from keyed""")

    sql["export_multi"] = multi([_C, _CHOSEN, _WRAPPED], "reason", "web,docs,rest", "h.project || '-' || h.group_key",
                                "regexp_replace(reason, '[^a-zA-Z0-9_-]', '_', 'g')")
    talks = _CHOSEN.split("from (")[0].replace("case strategy_idx when 0 then 'web' when 1 then 'docs' else 'rest' end", "'talks'").replace(
        "case strategy_idx when 0 then 'Folder files: web' when 1 then 'Pattern match: docs' else 'Full strategy: rest' end",
        "'Full strategy: talks'") + "from (select *, 0 as strategy_idx from talks) t)"
    sql["export_multi_folder"] = multi([_T, talks, _WRAPPED], "split_part(path, '/', 1)", "talks", "h.project || '-' || h.group_key",
                                       "split_part(path, '/', 1)")
    return sql
