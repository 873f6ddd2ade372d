"""The registered queries as DuckDB SQL."""

from quirefold.functions.bib import GENERIC_AUTHORS, TEXT_WINDOW
from quirefold.functions.patterns import COPYRIGHT, EDGES, EXTENSION, HEADING, NOT_NAME, RUNS, SPACE, WORD, YEAR_SIGN
from quirefold.operators.decisions import IGNORED_NAMES, IGNORED_PREFIXES
from quirefold.plans import inline


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x):
    return f"regexp_replace({x}, {q(EDGES)}, '', 'g')"


def sanitize(x):
    inner = f"regexp_replace(coalesce({x}, ''), {q(NOT_NAME)}, '', 'g')"
    return f"regexp_replace({strip(inner)}, {q(RUNS)}, '_', 'g')"


def stem(x):
    base = f"regexp_extract(coalesce({x}, ''), '([^/]*)$', 1)"
    return f"regexp_replace({base}, {q(EXTENSION)}, '\\1')"


def input_key(x):
    return f"coalesce(nullif({sanitize(stem(x))}, ''), 'untitled_input')"


def heading(x):
    pattern = HEADING.replace("(?md)", "(?m)")
    raw = f"regexp_extract(substring(coalesce({x}, ''), 1, {TEXT_WINDOW}), {q(pattern)}, 1)"
    return strip(f"regexp_replace(regexp_replace({raw}, '<[^>]+>', '', 'g'), '[*_`]', '', 'g')")


#: Either notation of a bare year; whichever stands first counts.
BARE = rf"©[{SPACE}]*(\p{{Nd}}{{4}})|(?:^|[^{WORD}])Copyright(?:$|[^{WORD}].{{0,9}}?|)(\p{{Nd}}{{4}})"


def year(x):
    t = f"substring(coalesce({x}, ''), 1, {TEXT_WINDOW})"
    bare = f"coalesce(nullif(regexp_extract({t}, {q(BARE)}, 1), ''), regexp_extract({t}, {q(BARE)}, 2))"
    return f"coalesce(nullif(regexp_extract({t}, {q(COPYRIGHT)}, 1), ''), {bare})"


def author(x):
    t = f"substring(coalesce({x}, ''), 1, {TEXT_WINDOW})"
    return strip(f"split_part(regexp_extract({t}, {q(COPYRIGHT)}, 2), chr(10), 1)")


def descriptive(t, a):
    generic = ", ".join(map(q, GENERIC_AUTHORS))
    return f"({strip(f'coalesce({t}, {q("")})')} <> '' OR lower({strip(f'coalesce({a}, {q("")})')}) NOT IN ({generic}))"


def last_word(x):
    return f"coalesce(regexp_extract({strip(x)}, '([^ \\t-\\r]*)$', 1), '')"


def last_name(x, legacy=False):
    head = f"split_part({x}, ',', -1)" if legacy else f"split_part(split_part({x}, ',', 1), ' and ', 1)"
    return f"CASE WHEN {strip(x if legacy else head)} = '' THEN 'UnknownAuthor' ELSE {sanitize(last_word(head))} END"


PAGES = """pages_ AS (SELECT doc_id, unnest(range(0, len(l)))::INT AS page_no, unnest(l) AS body
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
BOOKS = "books AS (SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_pages FROM documents)"
PLAN = BOOKS + """, plan AS (SELECT doc_id, s::INT AS start_page, least(s + 5, n_pages)::INT AS end_page,
  printf('%05d_%05d', s, least(s + 5, n_pages)) AS chunk_tag
  FROM (SELECT doc_id, n_pages, unnest(range(0, n_pages, 5)) AS s FROM books))"""
DONE = "done AS (SELECT plan.* FROM plan SEMI JOIN labels USING (doc_id) WHERE start_page % 10 = 0)"
TIERS = PAGES + """, att AS (SELECT *, (page_no - page_no % 5)::INT AS start_page FROM pages_),
  failed AS (SELECT doc_id, start_page, bool_or(length(body) > 400) AS hit FROM att GROUP BY ALL),
  tiers AS (SELECT att.*, hit, CASE WHEN NOT hit THEN 'chunk' WHEN length(body) <= 900 THEN 'page' ELSE 'raw' END AS tier
    FROM att JOIN failed USING (doc_id, start_page))"""
CONVERTED = TIERS + """, conv AS (SELECT doc_id, start_page, hit, count(*) AS n,
  CASE WHEN hit THEN string_agg(b, '\n\n' ORDER BY page_no) ELSE string_agg(b, chr(10) ORDER BY page_no) END AS text
  FROM (SELECT *, CASE WHEN tier = 'raw' THEN chr(10) || chr(10) || '<!-- PyPDF Fallback: Page ' || (page_no + 1) || ' -->' || chr(10) || chr(10) || body
    ELSE body END AS b FROM tiers) GROUP BY doc_id, start_page, hit)"""
H1 = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
LINKS = """links AS (SELECT page_id, unnest(range(0, len(l))) AS pos, unnest(l) AS link
  FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))"""
BATCH = """batch AS (SELECT page_id + 1 AS input_ord, url AS raw_input, CASE WHEN l.doc_id IS NULL THEN 'FAILED' ELSE 'OK' END AS status,
  CASE WHEN l.doc_id IS NULL THEN 'no result for ' || page_id ELSE '' END AS detail,
  (page_id + 1) || '/' || count(*) OVER () AS position
  FROM pages LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON page_id = l.doc_id)"""
CASCADE = f"""rows_ AS (SELECT *, {heading('md')} AS tt, {author('md')} AS ta, {year('md')} AS ty,
    CASE WHEN json_valid(reply) THEN reply END AS j FROM {inline.dealt_sql(inline.BOOKS)}),
  r AS (SELECT *, {", ".join(f"CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' THEN {strip(f"json_extract_string(j, '$.{k}')")} ELSE '' END AS r{k[0]}" for k in ("title", "author", "year"))} FROM rows_),
  c AS (SELECT *, {descriptive('title', 'author')} AS own, {descriptive('rt', 'ra')} AS by_reply FROM r),
  bib AS (SELECT id, file, CASE WHEN own THEN 'info' WHEN by_reply THEN 'reply' WHEN {descriptive('tt', 'ta')} THEN 'text' ELSE 'file' END AS tier,
    {", ".join(f"CASE WHEN own OR {strip(k)} <> '' THEN {k} WHEN by_reply THEN r{k[0]} ELSE t{k[0]} END AS {k}" for k in ("title", "author", "year"))} FROM c)"""
TREE = " UNION ALL ".join(
    ["SELECT unnest([" + ", ".join(map(q, inline.SINGLE_DIRS)) + "]) AS path", f"SELECT {q(inline.PROJECTS + '/')} || source FROM (SELECT DISTINCT source FROM documents)"]
    + [f"SELECT {q(base + '/')} || source || '/' || unnest([{', '.join(map(q, kinds))}]) FROM (SELECT DISTINCT source FROM documents)" for base, kinds in inline.COURSE_DIRS]
)

INPUTS = f"""files AS (SELECT doc_id AS input_ord, path, {input_key("path")} AS input_key, sha256(coalesce(text, '')) AS digest
  FROM (SELECT *, source || '/book ' || doc_id % 50 || '.txt' AS path FROM documents))"""
BAD = """bad AS (SELECT DISTINCT doc_id, (page_no - page_no % 5)::INT AS start_page FROM pages_ WHERE length(body) > 400)"""
LOG = """log AS (SELECT doc_id, start_page, unnest(range(0, (doc_id + start_page // 5) % 5 + 1)) AS i FROM bad),
  fails AS (SELECT doc_id, start_page, count(*) FILTER (i <> 2 OR doc_id % 3 <> 0) AS n_failed, max(i) AS i
    FROM log SEMI JOIN (SELECT doc_id, start_page, max(i) FILTER (i = 2 AND doc_id % 3 = 0) AS good FROM log GROUP BY ALL) g
      ON g.doc_id = log.doc_id AND g.start_page = log.start_page AND (good IS NULL OR i > good) GROUP BY ALL)"""
BEFORE = BOOKS + """, b AS (SELECT * FROM books SEMI JOIN labels USING (doc_id)),
  threes AS (SELECT doc_id, s::INT AS start_page, least(s + 3, n_pages)::INT AS end_page FROM (SELECT *, unnest(range(3, n_pages, 6)) AS s FROM b)),
  seven AS (SELECT doc_id, 0 AS start_page, least(7, n_pages)::INT AS end_page FROM b WHERE doc_id % 2 = 0 AND n_pages > 0),
  kept AS (SELECT * FROM seven UNION ALL SELECT * FROM threes ANTI JOIN seven ON threes.doc_id = seven.doc_id AND threes.start_page < seven.end_page)"""


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists, by the rows of its table."""
    hits = f"list_transform({a}, lambda x: list_prepend(0, list_transform({b}, lambda y: (y = x)::INT)))"
    best = "list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN e[i] = 1 THEN old[i - 1] + 1 ELSE 0 END))"
    row = f"list_transform(range(1, len(old) + 1), lambda j: greatest(old[j], {best}))"
    return f"list_reduce(list_prepend(list_transform(range(0, len({b}) + 1), lambda z: 0), {hits}), lambda old, e: {row})[-1]"


#: What ``alignment.entry_title`` does.
ENTRY = r"trim(regexp_replace(lower(regexp_replace({}, '^[ \t]*[#*>-]*[ \t]*|[ .\t]*[0-9]*[ \t]*$', '', 'g')), '[ \t]+', ' ', 'g'))"

ORACLES = {
    "chunk_plan": f"WITH {PLAN} SELECT * FROM plan",
    "chunk_size_pinning": "SELECT d.doc_id, (CASE WHEN l.doc_id IS NULL THEN 5 ELSE 3 END)::INT AS chunk_size, l.doc_id IS NOT NULL AS pinned FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "pending_documents": f"WITH {BOOKS} SELECT books.* FROM books ANTI JOIN labels USING (doc_id)",
    "pending_chunks": f"WITH {PLAN}, {DONE} SELECT plan.* FROM plan ANTI JOIN done USING (doc_id, chunk_tag)",
    "resume_equivalence": f"""WITH {PLAN}, {DONE}, both_ AS (SELECT *, 1 AS w FROM plan UNION ALL SELECT *, -1 FROM done
        UNION ALL SELECT plan.*, -1 FROM plan ANTI JOIN done USING (doc_id, chunk_tag)),
        off AS (SELECT doc_id, start_page, end_page, chunk_tag, sum(w) AS w FROM both_ GROUP BY ALL)
        SELECT count(*) AS n_chunks, count(*) FILTER (w <> 0) AS n_different FROM off""",
    "convert_tiers": f"WITH {TIERS} SELECT tier, count(*) AS n_pages, count(DISTINCT doc_id) AS n_books FROM tiers GROUP BY tier",
    "fallback_text": f"WITH {CONVERTED} SELECT doc_id, start_page, text FROM conv WHERE hit",
    "drop_mode": f"""WITH {CONVERTED}, {BOOKS}, k AS (SELECT doc_id, count(*) AS n_chunks, sum(n) AS n_kept FROM conv WHERE NOT hit GROUP BY doc_id)
        SELECT doc_id, coalesce(n_chunks, 0)::BIGINT AS n_chunks, (n_pages - coalesce(n_kept, 0))::BIGINT AS n_lost_pages FROM books LEFT JOIN k USING (doc_id)""",
    "assemble_documents": f"""WITH {CONVERTED} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY start_page) AS md,
        count(*) AS n_chunks, count(*) FILTER (hit) AS n_failed FROM conv GROUP BY doc_id""",
    "assemble_conversations": "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS md, count(*) AS n_turns FROM conversations GROUP BY conv_id",
    "flatten_break_join": "SELECT conv_id, string_agg(text, chr(10) || chr(10) || '<!-- CHUNK BREAK -->' || chr(10) || chr(10) ORDER BY turn) AS md FROM conversations GROUP BY conv_id",
    "first_metadata": "SELECT source, arg_min('{\"quality\":' || quality || '}', doc_id) FILTER (doc_id % 2 = 0) AS meta FROM documents JOIN labels USING (doc_id) GROUP BY source",
    "sanitize_titles": f"SELECT page_id, {sanitize(H1)} AS name FROM pages",
    "input_keys": f"SELECT page_id, {input_key('p')} AS input_key, starts_with(url, 'gs://') AS is_object FROM (SELECT *, regexp_replace(url, '[?#].*$', '') AS p FROM pages)",
    "heading_title": f"""SELECT page_id, {heading("'intro' || chr(10) || chr(10) || '# <a id=''x''></a>*' || " + H1 + " || '*' || chr(10) || chr(10) || 'body'")} AS title FROM pages""",
    "copyright_fields": f"SELECT id, {year('md')} AS year, {author('md')} AS author FROM {inline.dealt_sql(inline.COPYRIGHT_LINES)}",
    "descriptive_info": f"SELECT id, {descriptive('title', 'author')} AS descriptive FROM {inline.dealt_sql(inline.INFOS)}",
    "bib_cascade": f"WITH {CASCADE} SELECT id, tier, title, author, year FROM bib",
    "output_names": f"""WITH {CASCADE} SELECT id, CASE WHEN {descriptive('title', 'author')}
        THEN {last_name('author')} || '_' || coalesce(nullif({sanitize('title')}, ''), {sanitize(stem('file'))}) || '_' || coalesce(nullif(year, ''), '0000')
        ELSE coalesce(nullif({sanitize(stem('file'))}, ''), 'converted_textbook') END AS folder, {last_name('author', True)} AS legacy_last FROM bib""",
    "overwrite_last_wins": f"SELECT {sanitize(H1)} AS folder, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM pages GROUP BY 1",
    "batch_results": f"WITH {BATCH} SELECT input_ord, raw_input, status, detail, position FROM batch",
    "batch_summary": f"WITH {BATCH} SELECT count(*) AS n_inputs, count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status = 'FAILED') AS n_failed, bool_or(status = 'FAILED') AS any_failed FROM batch",
    "natural_order": """SELECT 'chunk_' || page_id AS folder, row_number() OVER (ORDER BY 'chunk_' || page_id COLLATE "C") - 1 AS lexicographic_rank,
        row_number() OVER (ORDER BY page_id) - 1 AS numeric_rank FROM pages""".replace(' COLLATE "C"', ""),
    "link_numbers": f"WITH {LINKS} SELECT page_id, pos, link, row_number() OVER (ORDER BY page_id, pos) - 1 AS n FROM links",
    "link_rewrite": f"""WITH {LINKS}, found AS (SELECT page_id, link, min(pos) AS pos FROM links WHERE length(link) % 2 = 0 GROUP BY ALL),
        num AS (SELECT *, row_number() OVER (ORDER BY page_id, pos) - 1 AS n FROM found),
        pairs AS (SELECT page_id, list({{'o': link, 'w': printf('all_graphs/graph_%04d.png', n)}} ORDER BY n) AS p FROM num GROUP BY page_id),
        md AS (SELECT page_id, string_agg('(' || link || ')', chr(10) ORDER BY pos) AS md FROM links GROUP BY page_id)
        SELECT page_id, CASE WHEN p IS NULL THEN md ELSE list_reduce(list_prepend({{'o': '', 'w': md}}, p), lambda x, y: {{'o': '', 'w': replace(x.w, y.o, y.w)}}).w END AS md FROM md LEFT JOIN pairs USING (page_id)""",
    "image_names": f"WITH {PLAN} SELECT doc_id, 'pg_' || (start_page + 1) || '_fig.png' AS image FROM plan",
    "workspace_tree": TREE,
    "repo_staleness": f"SELECT repo_path, local_hash <> remote_hash AND remote_hash <> '' AS stale FROM {inline.dealt_sql(inline.REPOS)}",
    "write_if_absent": f"SELECT path, policy, CASE WHEN NOT there THEN 'create' WHEN policy = 'always' THEN 'overwrite' ELSE 'keep' END AS action FROM {inline.dealt_sql(inline.FILES)}",
    "setup_decision": f"""SELECT id, CASE WHEN marker IS NULL THEN 'full' WHEN regexp_extract(marker, '(?m)^setup_version=(.*)$', 1) <> '7' THEN 'rebuild'
        WHEN contains(checks, '0') THEN 'fatal' ELSE 'skip' END AS decision FROM {inline.dealt_sql(inline.SETUPS)}""",
    "sync_diff": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'only_left' WHEN d.doc_id IS NULL THEN 'only_right' ELSE 'both' END AS state
        FROM documents d FULL JOIN (SELECT DISTINCT doc_id + 500 AS doc_id FROM labels) l ON d.doc_id = l.doc_id""",
    "ignored_paths": f"""SELECT path, suffix(path, '.log') OR {" OR ".join(f"starts_with(path, {q(inline.BASE + '/' + p)})" for p in IGNORED_PREFIXES)}
        OR list_has_any(string_split(path, '/'), [{", ".join(map(q, IGNORED_NAMES))}]) AS ignored, regexp_replace(path, '/[^/]+$', '') AS parent FROM {inline.dealt_sql(inline.PATHS)}""",
    "long_document_router": f"WITH {BOOKS} SELECT doc_id, n_pages, CASE WHEN n_pages <= 30 THEN 'direct' WHEN doc_id % 2 = 0 THEN 'chapter_file' ELSE 'page_blocks' END AS route FROM books",
    "first_n_pages": f"WITH {PAGES} SELECT doc_id, page_no::BIGINT AS page_no, body FROM pages_ WHERE page_no < 3",
    "toc_scan": f"WITH {PAGES} SELECT doc_id, page_no::BIGINT AS page_no FROM pages_ WHERE page_no < 30 AND regexp_matches(body, '(?i)the the|of the|und der')",
    "text_layer": f"""WITH {PAGES}, s AS (SELECT doc_id, page_no, {strip('body')} AS t FROM pages_) SELECT doc_id, bool_or(t <> '') AS searchable,
        (min(page_no) FILTER (t <> ''))::BIGINT AS first_text_page, arg_min(substring(t, 1, 200), page_no) FILTER (t <> '') AS sample FROM s GROUP BY doc_id""",
    "outline": f"SELECT page_id, unnest([0, 1])::BIGINT AS pos, unnest([1, 3])::BIGINT AS level, unnest([{H1}, 'Part ' || page_id]) AS title FROM pages",
    "chapters": f"""WITH {PAGES}, c AS (SELECT doc_id, sum(starts_with(body, 'T')::INT) OVER (PARTITION BY doc_id ORDER BY page_no) AS chapter_no FROM pages_)
        SELECT doc_id, chapter_no::BIGINT AS chapter_no, count(*) AS n_pages FROM c GROUP BY ALL""",
    "mounts": f"SELECT spec, split_part(spec, ':', 1) AS host, split_part(spec, ':', 2) AS container, split_part(spec, ':', 3) AS mode FROM {inline.dealt_sql(inline.MOUNTS)}",
    "small_texts": f"""SELECT id, {input_key('t')} AS input_key, {stem('t')} || '_extracted_cache' AS cache_dir,
        regexp_matches(lower(t), 'not found|no urls matched|no matches') AS nothing_to_replace, regexp_extract(t, 'session ''([a-f0-9]+)''', 1) AS session,
        regexp_extract(t, '([a-f0-9]{{6,8}})', 1) AS first_session, regexp_replace(t, '-[^-]*$', '') AS region, regexp_replace(t, '/+$', '') || '/f' AS destination
        FROM {inline.dealt_sql(inline.TEXTS)}""",
    "manifest_metadata": f"SELECT id, CASE WHEN json_valid(meta) AND json_type(CASE WHEN json_valid(meta) THEN meta END) = 'OBJECT' THEN meta ELSE '{{}}' END AS meta FROM {inline.dealt_sql(inline.METAS)}",
    "image_rows": f"""WITH {PLAN}, n AS (SELECT *, unnest(range(1, start_page // 5 % 3 + 1)) AS i FROM plan)
        SELECT doc_id, start_page, 'pg_' || (start_page + 1) || '_f' || i AS name, 11::INT AS n_bytes FROM n""",
    "document_heads": "SELECT doc_id, substring(text, 1, 6000) AS head FROM documents",
    "run_configs": f"""SELECT id, coalesce(TRY_CAST(CASE WHEN json_valid(config) THEN json_extract_string(CASE WHEN json_valid(config) THEN config END, '$.chunk_size') END AS INT), -1) AS chunk_size
        FROM {inline.dealt_sql(inline.CONFIGS)}""",
    "doc_infos": f"""SELECT id, {strip("coalesce(title, '')")} AS title, {strip("coalesce(author, '')")} AS author,
        coalesce(year(TRY_CAST(created AS DATE))::VARCHAR, '') AS year FROM {inline.dealt_sql(inline.CREATED)}""",
    "duration_texts": "SELECT doc_id, printf('%dm %ds', n_chars // 60, n_chars % 60) AS took FROM documents",
    "book_metadata": "SELECT doc_id, to_json({'doc_id': doc_id, 'source': source, 'n_pages': len(string_split(text, chr(10)))})::VARCHAR AS meta FROM documents",
    "scopes": f"SELECT id, contains(coalesce(scopes, ''), 'cloud-platform') AS allowed FROM {inline.dealt_sql(inline.SCOPES)}",
    "chapter_manifest": f"""WITH {PAGES}, c AS (SELECT *, sum(starts_with(body, 'T')::INT) OVER (PARTITION BY doc_id ORDER BY page_no) AS chapter_no FROM pages_)
        SELECT doc_id, chapter_no::BIGINT AS chapter_no, min(page_no)::BIGINT AS first_page, max(page_no)::BIGINT AS last_page,
        regexp_replace(arg_min(body, page_no), '^#+ ', '') AS title, string_agg(body, chr(10) ORDER BY page_no) AS text FROM c GROUP BY doc_id, chapter_no""",
    "chapter_requests": f"""WITH h AS (SELECT page_id, unnest([1, 2])::BIGINT AS chapter_no, unnest([{H1}, 'Part ' || page_id]) AS title FROM pages),
        a AS (SELECT page_id AS request, (CASE WHEN page_id % 7 = 6 THEN -page_id - 1 ELSE page_id END)::INT AS page_id,
          replace({inline.REQUESTS}[page_id % 7 + 1], '{{i}}', page_id::VARCHAR) AS wanted FROM pages),
        r AS (SELECT *, lower(trim(wanted)) AS w FROM a)
        SELECT request, r.page_id, wanted, coalesce(chapter_no, -1)::BIGINT AS chapter_no, title FROM r LEFT JOIN h ON r.page_id = h.page_id AND (chapter_no::VARCHAR = w OR (w <> '' AND contains(lower(title), w)))""",
    "extractors": f"""WITH {PAGES}, b AS (SELECT doc_id, page_no, CASE WHEN length(body) > 900 THEN substring(body, 2) ELSE body END AS body FROM pages_ WHERE body <> '')
        SELECT a.doc_id, a.page_no::BIGINT AS page_no, a.body IS NOT DISTINCT FROM b.body AS same FROM pages_ a LEFT JOIN b USING (doc_id, page_no)""",
    "content_identity": f"""WITH {INPUTS}, r AS (SELECT digest, min(input_ord) AS read_as FROM files GROUP BY digest),
        f AS (SELECT *, row_number() OVER (PARTITION BY input_key ORDER BY o) AS k FROM (SELECT input_key, digest, min(input_ord) AS o FROM files GROUP BY ALL))
        SELECT input_ord, path, files.digest, read_as, files.input_key || CASE WHEN k > 1 THEN '_' || files.digest[1:8] ELSE '' END AS folder
        FROM files JOIN r USING (digest) JOIN f ON f.input_key = files.input_key AND f.digest = files.digest""",
    "attempts_left": f"""WITH {PAGES}, {PLAN}, {BAD}, {LOG} SELECT plan.doc_id, plan.start_page, end_page, coalesce(n_failed, 0)::INT AS n_failed, 'ValueError: try ' || i AS cause
        FROM plan LEFT JOIN fails USING (doc_id, start_page) WHERE coalesce(n_failed, 0) < 3""",
    "uncovered_ranges": f"""WITH {BEFORE}, page AS (SELECT doc_id, unnest(range(0, n_pages))::INT AS p FROM books),
        free AS (SELECT page.doc_id, p FROM page ANTI JOIN kept ON page.doc_id = kept.doc_id AND p >= start_page AND p < end_page),
        stretch AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM free),
        cut AS (SELECT doc_id, p, (p - min(p) OVER (PARTITION BY doc_id, g)) // 5 AS k, g FROM stretch)
        SELECT doc_id, min(p)::INT AS start_page, (max(p) + 1)::INT AS end_page, printf('%05d_%05d', min(p), max(p) + 1) AS chunk_tag FROM cut GROUP BY doc_id, g, k""",
    "covered_ranges": f"WITH {BEFORE} SELECT doc_id, start_page::INT AS start_page, end_page FROM kept",
    "segment_offsets": f"""WITH {CONVERTED}, s AS (SELECT doc_id, start_page, strlen(text) AS n_bytes, row_number() OVER w AS k FROM conv WINDOW w AS (PARTITION BY doc_id ORDER BY start_page))
        SELECT doc_id, start_page, n_bytes::BIGINT AS n_bytes, (coalesce(sum(n_bytes + CASE WHEN k > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS at_byte, k = 1 AS opens FROM s""",
    "sync_three_way": """WITH s AS (SELECT doc_id, doc_id % 3 AS b, doc_id // 3 % 3 AS l, doc_id // 9 % 3 AS r, quality = 1 AS good, sha256(coalesce(text, '')) AS o,
          sha256(coalesce(text, '') || 'l') AS x, sha256(coalesce(text, '') || CASE WHEN quality = 1 THEN 'l' ELSE 'r' END) AS y FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 27 <> 0),
        t AS (SELECT *, CASE l WHEN 0 THEN CASE r WHEN 0 THEN CASE WHEN b = 1 THEN 'record' ELSE 'none' END
              WHEN 1 THEN CASE WHEN b = 0 THEN 'copy_left' ELSE 'delete_right' END ELSE CASE WHEN b = 1 THEN 'conflict' ELSE 'copy_left' END END
            WHEN 1 THEN CASE r WHEN 0 THEN CASE WHEN b = 0 THEN 'copy_right' ELSE 'delete_left' END WHEN 1 THEN CASE WHEN b = 1 THEN 'none' ELSE 'record' END
              ELSE CASE WHEN b = 0 THEN 'conflict' ELSE 'copy_left' END END
            ELSE CASE r WHEN 0 THEN CASE WHEN b = 1 THEN 'conflict' ELSE 'copy_right' END WHEN 1 THEN CASE WHEN b = 0 THEN 'conflict' ELSE 'copy_right' END
              ELSE CASE WHEN good THEN 'record' ELSE 'conflict' END END END AS action FROM s)
        SELECT doc_id, action, CASE WHEN action IN ('none', 'conflict', 'delete_left', 'delete_right') THEN CASE WHEN b > 0 THEN o END
          WHEN action = 'copy_left' THEN CASE r WHEN 1 THEN o ELSE y END WHEN l = 0 THEN o WHEN l = 1 THEN o ELSE x END AS digest,
          CASE WHEN action IN ('none', 'conflict') THEN b = 2 ELSE action IN ('delete_left', 'delete_right') OR (l = 0 AND r = 0) END AS deleted FROM t""",
    "title_lookup": f"""WITH p AS (SELECT page_id, {H1} AS h FROM pages), t AS (SELECT DISTINCT lower({strip('h')}) AS title FROM p),
        a AS (SELECT page_id, upper(CASE page_id // 20 % 3 WHEN 0 THEN h[1:2] || h[4:] WHEN 1 THEN h[1:3] || h[3:] ELSE h[1:1] || '#' || h[3:] END) AS wanted FROM p WHERE page_id % 20 = 0),
        w AS (SELECT *, lower({strip('wanted')}) AS w FROM a),
        d AS (SELECT page_id, wanted, title, levenshtein(w, title)::INT AS distance FROM w JOIN t ON title <> '' AND levenshtein(w, title) <= least(length(w) // 4, 3))
        SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY distance, title))::INT AS rank FROM d QUALIFY rank <= 3""",
    "extractor_alignment": f"""WITH {PAGES}, l AS (SELECT doc_id, list(body ORDER BY page_no) AS a, coalesce(list(CASE WHEN length(body) > 900 THEN substring(body, 2) ELSE body END ORDER BY page_no)
          FILTER (body <> '' AND page_no % 7 <> 3), []) AS b FROM pages_ GROUP BY doc_id),
        s AS (SELECT doc_id, len(a)::BIGINT AS n_a, len(b)::BIGINT AS n_b, {common("a", "b")}::BIGINT AS n_same FROM l)
        SELECT *, 2 * n_same / (n_a + n_b) AS similarity FROM s""",
    "contents_pages": f"""WITH {PAGES}, h AS (SELECT doc_id, page_no, {ENTRY.format("body")} AS t, {ENTRY.format("'## ' || translate(body, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' ..... ' || page_no")} AS e FROM pages_),
        l AS (SELECT doc_id, count(*) FILTER (page_no % 3 = 1) AS n_entries, coalesce(list(t ORDER BY page_no) FILTER (t <> ''), []) AS b, coalesce(list(e ORDER BY page_no) FILTER (page_no % 3 = 1 AND e <> ''), []) AS a FROM h GROUP BY doc_id)
        SELECT doc_id, n_entries, {common("a", "b")}::BIGINT AS n_placed FROM l WHERE n_entries > 0""",
    "outline_parents": f"""WITH {PAGES}, h AS (SELECT doc_id, page_no::BIGINT AS pos, (length(body) * 7 % 6 + 1)::BIGINT AS level FROM pages_)
        SELECT h.doc_id, h.pos, h.level, coalesce(max(o.pos), -1) AS parent FROM h LEFT JOIN h AS o ON o.doc_id = h.doc_id AND o.pos < h.pos AND o.level < h.level GROUP BY ALL""",
    "formula_links": "SELECT doc_id, unnest([0, 1])::BIGINT AS pos, './formulas/math_page_' || (doc_id + unnest([0, 1])) || '.png' AS link FROM documents",
}
