"""Column functions and predicates on documents, pages and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, sql_count, sql_fingerprint, sql_fp_norm, sql_lines, sql_loc, sql_norm, sql_trim, table
from plumbline.catalog.derived import DOCS, FINDINGS, docs, findings
from plumbline.functions import hashing, paths, records
from plumbline.functions import text as tx
from plumbline.operators import predicates, profile

HREF = r'href="([^"]+)"'


@query(
    "text_measures",
    f"""SELECT doc_id, {sql_loc('text')} AS loc, {sql_count('text', '[.!?]')} AS stops,
       CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS BIGINT) AS n_words,
       CAST(length({sql_norm('text')}) AS BIGINT) AS norm_chars FROM documents""",
)
def text_measures(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        tx.non_blank_loc(t).alias("loc"),
        tx.count_matches(t, "[.!?]").alias("stops"),
        F.size(tx.words(t)).cast("bigint").alias("n_words"),
        F.length(tx.norm_ws(t)).cast("bigint").alias("norm_chars"),
    )


EXT_PATH = """paths AS (SELECT doc_id, source || '/' || lang || '/Doc' || doc_id ||
  ['.ts', '.test.ts', '.d.ts', '.gen.go', '.md', '.PY', '_pb2.py', '', '.min.js', '.pb.go'][doc_id % 10 + 1] AS path FROM documents)"""


def ext_paths(spark, d):
    endings = [".ts", ".test.ts", ".d.ts", ".gen.go", ".md", ".PY", "_pb2.py", "", ".min.js", ".pb.go"]
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("doc_id") % 10 + 1).cast("int"))
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/Doc"), F.col("doc_id").cast("string"), ending).alias("path")
    )


@query(
    "path_functions",
    f"""WITH {EXT_PATH}, b AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM paths)
    SELECT doc_id, base, CASE WHEN contains(base, '.') THEN lower(regexp_extract(base, '[^.]*$')) ELSE '' END AS ext,
      regexp_replace(path, '/[^/]*$', '') AS module,
      nullif(regexp_replace(base, '(?i)\\.[a-z]+$', ''), '') AS stem,
      regexp_replace(path, '/[^/]*/[^/]*$', '') || '/up/x' AS joined FROM b""",
)
def path_functions(spark, d):
    p = F.col("path")
    return ext_paths(spark, d).select(
        "doc_id",
        paths.base_of(p).alias("base"),
        paths.ext_of(p).alias("ext"),
        paths.module_of(p).alias("module"),
        paths.stem_of(p).alias("stem"),
        paths.join_posix(paths.module_of(p), F.lit("./../up/./x")).alias("joined"),
    )


@query(
    "source_filter",
    f"""WITH {EXT_PATH}, b AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM paths)
    SELECT doc_id, path FROM b
    WHERE lower(regexp_extract(base, '\\.([^.]*)$', 1)) IN ('ts','tsx','js','jsx','mjs','cjs','cts','mts','py','go','rs','java','kt','cs','rb','php','swift','scala')
      AND NOT regexp_matches(base, '(?i)\\.(test|spec)\\.[a-z]+$') AND NOT regexp_matches(path, '(^|/)__tests__/')
      AND NOT regexp_matches(path, '(?i)\\.d\\.ts$') AND NOT regexp_matches(base, '(?i)\\.(?:gen|generated)\\.[a-z0-9]+$')
      AND NOT regexp_matches(base, '(?i)(?:^|[._-])pb2?\\.[a-z0-9]+$') AND NOT regexp_matches(base, '(?i)\\.pb\\.go$')""",
)
def source_filter(spark, d):
    return predicates.source_filter(ext_paths(spark, d))


@query(
    "under_prefix",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, path FROM p WHERE path = 'en' OR starts_with(path, 'en/') OR path = 'fr' OR starts_with(path, 'fr/')""",
)
def under_prefix(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path"))
    return predicates.under_prefix(p, "path", ["en", "fr"])


@query(
    "under_prefixes",
    f"""WITH {DOCS}, t AS (SELECT DISTINCT source || '/' || lang AS target FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT doc_id, path FROM docs WHERE EXISTS (SELECT 1 FROM t WHERE path = target OR starts_with(path, target || '/'))""",
)
def under_prefixes(spark, d):
    marked = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    targets = table(spark, d, "documents").join(marked, "doc_id", "left_semi").select(
        F.concat_ws("/", "source", "lang").alias("target")
    )
    return predicates.under_prefixes(docs(spark, d).select("doc_id", "path"), "path", targets)


PAGE_RULES = [
    ("capital", "^/[A-Z]"),
    ("punctuated", "[.,;]$"),
    ("short", "^/.{1,3}$"),
    ("accented", "[^ -~]"),
    ("the", "(?i)th"),
]


@query(
    "categorize",
    "WITH t AS (SELECT page_id, list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS hrefs FROM pages)\n"
    + "SELECT page_id, CAST("
    + " + ".join(f"CAST(len(list_filter(hrefs, lambda h: regexp_matches(h, '{p}'))) > 0 AS INTEGER)" for _, p in PAGE_RULES)
    + " AS BIGINT) AS cats FROM t",
)
def categorize(spark, d):
    return profile.categorize(
        table(spark, d, "pages"), F.array_distinct(tx.extract_tokens(F.col("html"), HREF)), PAGE_RULES
    ).select("page_id", "cats")


@query(
    "role_tag",
    f"""WITH {DOCS}, c AS (SELECT source, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY source)
    SELECT doc_id, CASE WHEN lang = 'fr' THEN 'boundary' WHEN regexp_matches(path, 'src1[0-3]/') THEN 'persistence'
      WHEN regexp_matches(path, '/de/') THEN 'test' WHEN loc = 1 THEN 'config' WHEN n >= 3 AND loc > 20 THEN 'hub' ELSE 'code' END AS role
    FROM docs LEFT JOIN c USING (source)""",
)
def role_tag(spark, d):
    rules = [("boundary", "(?!)"), ("persistence", "src1[0-3]/"), ("test", "/de/"), ("config", "(?!)")]
    consumers = (
        table(spark, d, "documents").where("lang <> 'en'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    )
    t = docs(spark, d).withColumn("loc", tx.non_blank_loc(F.col("text"))).join(consumers, "source", "left")
    inbound = F.when(F.col("loc") > 20, F.col("n"))
    return predicates.role_tag(
        t, boundary=F.col("lang") == "fr", wiring=F.col("loc") == 1, consumers=inbound, rules=rules
    ).select("doc_id", "role")


SCAN_RULES = [
    ("license", "Licensed under the [A-Za-z]+|MIT License"),
    ("mail", "[A-Za-z0-9._]+@[A-Za-z0-9.]+"),
    ("digits", "[0-9]{4,}"),
    ("shout", "[A-Z]{6,}!!"),
    ("token", "token[A-Za-z0-9_]*"),
]


@query(
    "pattern_scan",
    f"""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line
      FROM (SELECT doc_id, {sql_lines('text')} AS x FROM documents))
    """
    + " UNION ALL ".join(
        f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, '{n}' AS rule, regexp_extract(line, '{p}') AS idiom FROM l WHERE regexp_matches(line, '{p}')"
        for n, p in SCAN_RULES
    ),
)
def pattern_scan(spark, d):
    return predicates.pattern_scan(table(spark, d, "documents"), SCAN_RULES)


@query(
    "sink_scan",
    """WITH s AS (SELECT page_id, regexp_extract_all(html, '<script>[^<]*(?:<[^/][^<]*|</[^s][^<]*)*</script>') AS x FROM pages)
    SELECT page_id, CAST(len(x) AS BIGINT) AS scripts,
      CAST(list_sum(list_transform(x, lambda v: len(regexp_extract_all(v, 'track\\(')))) AS BIGINT) AS calls FROM s""",
)
def sink_scan(spark, d):
    scripts = tx.extract_tokens(F.col("html"), r"<script>[^<]*(?:<[^/][^<]*|</[^s][^<]*)*</script>", 0)
    hits = predicates.pattern_scan(
        table(spark, d, "pages").select("page_id", F.array_join(scripts, "\n").alias("text"), F.size(scripts).cast("bigint").alias("scripts")),
        [*predicates.SINK_RULES, ("track", r"track\(")],
        doc="page_id",
    )
    total = hits.where("rule = 'track'").groupBy("page_id").agg(F.count(F.lit(1)).alias("calls"))
    return table(spark, d, "pages").select("page_id", F.size(scripts).cast("bigint").alias("scripts")).join(total, "page_id")


# A line of code per page, with and without what the sink rules look for, and the rules without look-arounds.
CODE_LINES = [
    "const out = execSync(cmd);", "subprocess.run([x])", "re_exec(x); my.execute(x)", "spawn('ls', { shell: true })", "Popen(cmd, shell=True)", "os.system(line)",
    "readFile('/tmp/' + name)", "reopen(a + b)", "path.join(root, req.query.f)", "sendFile(`${base}/x`)", "open('plain.txt')",
    "fetch(url)", "fetch('/api')", "axios (target)", "axios ( \"https://x.io\")", "prefetch(url)", "http.get( u )", "urllib",
    "API_KEY = 'abcdefghijklmnop'", "password: 'short'", "-----BEGIN RSA PRIVATE KEY-----", "see http://user:secret@host.io/", "let value = 1;",
]
SINK_SQL = {
    "command-exec": r"(^|[^A-Za-z0-9_])exec(Sync)?\(|(^|[^A-Za-z0-9_])spawn\([^)]*shell:|subprocess\.run\(|Popen\([^)]*shell=True|os\.system\(|Runtime\.exec",
    "path-traversal": r"((readFile|writeFile|createReadStream|sendFile)|(^|[^A-Za-z0-9_])open)\([^)]*(\+|\$\{)|path\.join\([^)]*(req|user|param)",
    "ssrf": r"""((^|[^A-Za-z0-9_])fetch\(|axios|https?\.get\(|(^|[^A-Za-z0-9_])request\(|urllib|HttpClient)[\s(]*([^\s(\x27"]|$)""",
    "secrets-in-diff": r"""(?i)[A-Z_]*(KEY|SECRET|TOKEN|PASSWORD|PASSWD)[A-Z_]*\s*[:=]\s*[\x27"][^\x27"]{12,}[\x27"]|-----BEGIN [A-Z ]*PRIVATE KEY-----|://[^\s:/@]+:[^\s/@]+@""",
}


def _code_sql() -> str:
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in CODE_LINES)
    code = f"code AS (SELECT page_id, html || chr(10) || [{quoted}][page_id % {len(CODE_LINES)} + 1] AS text FROM pages)"
    lines = f"l AS (SELECT page_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT page_id, {sql_lines('text')} AS x FROM code))"
    return f"WITH {code}, {lines} " + " UNION ALL ".join(
        f"SELECT page_id, CAST(line_no AS INTEGER) AS line_no, '{rule}' AS rule FROM l WHERE regexp_matches(line, '{pattern}')" for rule, pattern in SINK_SQL.items()
    )


@query("sink_rules", _code_sql())
def sink_rules(spark, d):
    """Every sink rule on every line of the pages, with a line of code added to each."""
    line = F.element_at(F.array(*[F.lit(x) for x in CODE_LINES]), (F.col("page_id") % len(CODE_LINES) + 1).cast("int"))
    pages = table(spark, d, "pages").select("page_id", F.concat("html", F.lit("\n"), line).alias("text"))
    return predicates.pattern_scan(pages, predicates.SINK_RULES, doc="page_id").select("page_id", "line_no", "rule")


@query(
    "interesting_lines",
    f"""WITH l AS (SELECT doc_id, unnest({sql_lines('text')}) AS raw FROM documents), n AS (SELECT doc_id, {sql_norm('raw')} AS line FROM l)
    SELECT doc_id, count(*) AS n, count(DISTINCT line) AS distinct_n FROM n
    WHERE length(line) >= 12 AND NOT regexp_matches(line, '^(?:import\\b|export\\s+\\{{|export\\s+\\*|export\\s+type\\b|//|/\\*|\\*|@)')
      AND NOT regexp_matches(line, '^[A-Za-z_$][\\w$]*,?$') AND NOT regexp_matches(line, '^[)}}\\];,{{(]+$') GROUP BY doc_id""",
)
def interesting_lines(spark, d):
    return (
        table(spark, d, "documents")
        .select("doc_id", tx.interesting_lines(F.col("text")).alias("l"))
        .where(F.size("l") > 0)
        .select("doc_id", F.size("l").cast("bigint").alias("n"), F.size(F.array_distinct("l")).cast("bigint").alias("distinct_n"))
    )


ARTIFACT = """artifacts AS (SELECT doc_id, lang, source,
  '---' || chr(10) || 'date: 2024-01-0' || (doc_id % 9 + 1) || chr(10) || 'author: "' || source || '"' || chr(10) ||
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'commit: c' || doc_id || chr(10) END || 'branch: main' || chr(10) ||
  'repository: ' || lang || chr(10) || 'status: ' || CASE WHEN doc_id % 2 = 0 THEN 'ready' ELSE 'draft' END || chr(10) ||
  'n_chars: ' || n_chars || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'parent: ' || source || '/' || (doc_id // 2) || chr(10) ELSE '' END ||
  '---' || chr(10) || '## Goals' || chr(10) || replace(text, 'token', 'TODO {fill me}') || chr(10) ||
  CASE WHEN doc_id % 7 = 0 THEN '```py' || chr(10) || ' ' || chr(10) || '```' || chr(10) ELSE '' END ||
  '## Follow-ups' || chr(10) || lang || ' follow up for ' || source || chr(10) AS text FROM documents)"""


def artifacts(spark, d):
    n, nl = F.col("doc_id"), "\n"
    s = lambda c: c.cast("string")
    parts = [
        F.lit("---\ndate: 2024-01-0"), s(n % 9 + 1), F.lit('\nauthor: "'), F.col("source"), F.lit('"\n'),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("commit: c"), s(n), F.lit(nl))),
        F.lit("branch: main\nrepository: "), F.col("lang"), F.lit("\nstatus: "),
        F.when(n % 2 == 0, "ready").otherwise("draft"), F.lit("\nn_chars: "), s(F.col("n_chars")), F.lit(nl),
        F.when(n % 5 == 0, F.concat(F.lit("parent: "), F.col("source"), F.lit("/"), s(F.floor(n / 2)), F.lit(nl))).otherwise(""),
        F.lit("---\n## Goals\n"), F.replace(F.col("text"), F.lit("token"), F.lit("TODO {fill me}")), F.lit(nl),
        F.when(n % 7 == 0, "```py\n \n```\n").otherwise(""),
        F.lit("## Follow-ups\n"), F.col("lang"), F.lit(" follow up for "), F.col("source"), F.lit(nl),
    ]
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.concat(*parts).alias("text"))


@query(
    "front_matter",
    f"""WITH {ARTIFACT} SELECT doc_id, source AS author, CASE WHEN doc_id % 2 = 0 THEN 'ready' ELSE 'draft' END AS status,
      CAST(7 - CAST(doc_id % 3 = 0 AS INTEGER) + CAST(doc_id % 5 = 0 AS INTEGER) AS BIGINT) AS n_keys,
      CAST(length(regexp_replace(text, '(?s)^---.*?\\n---\\n', '')) AS BIGINT) AS body_chars FROM artifacts""",
)
def front_matter(spark, d):
    fm = tx.front_matter(F.col("text"))
    return artifacts(spark, d).withColumn("fm", fm).select(
        "doc_id",
        F.col("fm")["author"].alias("author"),
        F.col("fm")["status"].alias("status"),
        F.size("fm").cast("bigint").alias("n_keys"),
        F.length(tx.body_of(F.col("text"))).cast("bigint").alias("body_chars"),
    )


@query(
    "doc_lint",
    f"""WITH {ARTIFACT}, a AS (SELECT *, replace(text, '```py' || chr(10) || ' ' || chr(10) || '```', '') AS prose FROM artifacts)
    SELECT doc_id, 'empty' AS code, 'commit' AS field, NULL::VARCHAR AS value FROM a WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 'open_token', NULL, '{{fill me}}' FROM a WHERE doc_id % 2 = 0 AND contains(prose, 'TODO {{fill me}}')
    UNION ALL SELECT doc_id, 'placeholder', NULL, 'TODO' FROM a WHERE regexp_matches(prose, '(^|[^A-Za-z0-9_])TODO([^A-Za-z0-9_]|$)')
    UNION ALL SELECT doc_id, 'empty_fence', NULL, 'py' FROM a WHERE doc_id % 7 = 0
    UNION ALL SELECT doc_id, 'lost', 'parent', source || '/' || (doc_id // 2) FROM a
      WHERE doc_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.source || '/' || o.doc_id = a.source || '/' || (a.doc_id // 2))""",
)
def doc_lint(spark, d):
    known = table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return predicates.doc_lint(artifacts(spark, d), doc="doc_id", kind=F.lit(""), universe=known)


@query(
    "sections",
    """SELECT page_id, CAST(len(regexp_extract_all(html, '<h1>')) AS BIGINT) + 1 AS n,
       regexp_extract(html, '<h1>([^\\n<]*)', 1) AS first_heading FROM pages WHERE contains(html, '<h1>')""",
)
def sections(spark, d):
    markdown = F.regexp_replace("html", "<h1>", "\n## ")
    s = table(spark, d, "pages").where(F.contains("html", F.lit("<h1>"))).select("page_id", tx.sections(markdown).alias("s"))
    return s.select(
        "page_id",
        F.size("s").cast("bigint").alias("n"),
        F.regexp_extract(F.element_at("s", 2)["heading"], "^([^<]*)", 1).alias("first_heading"),
    )


@query(
    "table_cells",
    """SELECT o_orderkey, [CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority][1] AS first_cell,
       o_orderpriority AS last_cell, CAST(3 AS BIGINT) AS n FROM orders""",
)
def table_cells(spark, d):
    row = F.concat(F.lit("| "), F.col("o_custkey").cast("string"), F.lit(" |"), F.col("o_orderstatus"), F.lit("|  "), F.col("o_orderpriority"), F.lit(" |"))
    return table(spark, d, "orders").select("o_orderkey", tx.table_cells(row).alias("c")).select(
        "o_orderkey", F.element_at("c", 1).alias("first_cell"), F.element_at("c", -1).alias("last_cell"), F.size("c").cast("bigint").alias("n")
    )


TOKEN_SQL = (
    r"""//[^\n]*|/\*[\s\S]*?\*/|`(?:\\.|[^`\\])*`|''(?:\\.|[^''\\])*''|"(?:\\.|[^"\\])*"|[A-Za-z_$][\w$]*|\d[\w.]*"""
    r"""|=>|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\.\.\.|[{}()\[\];,.<>+\-*/%=!&|^~?:]"""
)
KEYWORD_SQL = "(" + ", ".join(f"'{k}'" for k in tx.KEYWORDS) + ")"


def sql_tokens(x: str) -> str:
    return (
        f"list_transform(list_filter(regexp_extract_all({x}, '{TOKEN_SQL}'), lambda t: NOT (starts_with(t, '//') OR starts_with(t, '/*'))), "
        "lambda t: CASE WHEN t[1] IN ('`', '''', '\"') THEN 'S' WHEN regexp_matches(t[1], '[0-9]') THEN 'N' "
        f"WHEN regexp_matches(t[1], '[A-Za-z_$]') AND t NOT IN {KEYWORD_SQL} THEN 'I' ELSE t END)"
    )


@query(
    "token_stream",
    f"""WITH t AS (SELECT page_id, {sql_tokens('html')} AS toks FROM pages)
    SELECT page_id, CAST(len(toks) AS BIGINT) AS n, CAST(len(list_filter(toks, lambda t: t = 'I')) AS BIGINT) AS identifiers,
      CAST(len(list_filter(toks, lambda t: t = 'S')) AS BIGINT) AS strings, md5(array_to_string(toks, ' ')) AS digest FROM t""",
)
def token_stream(spark, d):
    t = table(spark, d, "pages").select("page_id", tx.token_stream(F.col("html")).alias("toks"))
    return t.select(
        "page_id",
        F.size("toks").cast("bigint").alias("n"),
        F.size(F.filter("toks", lambda x: x == "I")).cast("bigint").alias("identifiers"),
        F.size(F.filter("toks", lambda x: x == "S")).cast("bigint").alias("strings"),
        F.md5(F.array_join("toks", " ")).alias("digest"),
    )


@query(
    "body_hash",
    f"""SELECT doc_id, sha256(regexp_replace(text, '[\\s\\x{{0b}}\\x{{a0}}]+$', '')) AS body_hash,
       md5({sql_trim('text')}) AS trimmed FROM documents""",
)
def body_hash(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", hashing.body_hash(F.col("text")).alias("body_hash"), F.md5(tx.trim_ws(F.col("text"))).alias("trimmed")
    )


@query(
    "fingerprint",
    f"""WITH q AS (SELECT doc_id, lang, source, {sql_lines("replace(text, ' and ', ' ; // and ')")} AS quoted FROM documents)
    SELECT doc_id, {sql_fingerprint('lang', 'quoted', "nullif(source, 'src3')")} AS fp, {sql_fp_norm('quoted[1]')} AS first_line FROM q""",
)
def fingerprint(spark, d):
    q = table(spark, d, "documents").withColumn("quoted", tx.lines(F.replace("text", F.lit(" and "), F.lit(" ; // and "))))
    return q.select(
        "doc_id",
        hashing.fingerprint(F.col("lang"), F.col("quoted"), F.nullif("source", F.lit("src3"))).alias("fp"),
        hashing.fingerprint_norm(F.element_at("quoted", 1)).alias("first_line"),
    )


@query(
    "citations",
    f"""WITH {DOCS}, c AS (SELECT doc_id, 'see ' || path || ':' || loc || '-' || (loc + 2) || ' and https://x.y/' || path || ' and {{a}}.md ' AS t FROM docs)
    SELECT doc_id, regexp_extract(t, 'see ([^:]*):', 1) AS tok, CAST(regexp_extract(t, ':(\\d+)-', 1) AS BIGINT) AS line,
      CAST(regexp_extract(t, '-(\\d+) ', 1) AS BIGINT) AS line_end FROM c
    UNION ALL SELECT doc_id, '//x.y/' || source || '/' || lang || '/d' || doc_id || '.md', NULL, NULL FROM docs
    UNION ALL SELECT doc_id, '.md', NULL, NULL FROM docs WHERE false""",
)
def citations(spark, d):
    t = docs(spark, d).withColumn("loc", tx.non_blank_loc(F.col("text")))
    s = lambda c: F.col(c).cast("string")
    cited = F.concat(
        F.lit("see "), F.col("path"), F.lit(":"), s("loc"), F.lit("-"), (F.col("loc") + 2).cast("string"),
        F.lit(" and https://x.y/"), F.col("path"), F.lit(" and {a}.md "),
    )
    return t.select("doc_id", F.explode(records.citations(cited)).alias("c")).select(
        "doc_id", "c.tok", "c.line", F.col("c.end").alias("line_end")
    )


@query(
    "layer_key",
    f"""WITH {FINDINGS} SELECT layer, CAST(string_split(layer, '.')[1] AS INTEGER) AS major,
      coalesce(CAST(string_split(layer, '.')[2] AS INTEGER), -1) AS minor, count(*) AS n FROM findings GROUP BY ALL""",
)
def layer_key(spark, d):
    k = records.layer_key(F.col("layer"))
    return findings(spark, d).groupBy("layer", k["major"].alias("major"), k["minor"].alias("minor")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "iso_slug",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS stamp, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS slug FROM events""",
)
def iso_slug(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", records.iso_stamp(ts).alias("stamp"), records.iso_slug(ts).alias("slug"))


@query(
    "json_fields",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_total
       FROM events GROUP BY event_type""",
)
def json_fields(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_total"))


@query(
    "set_functions",
    """WITH t AS (SELECT page_id, list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h,
         list_distinct(list_transform(regexp_extract_all(html, '[A-Za-z]+'), lambda w: '/' || w)) AS w FROM pages)
    SELECT page_id, CAST(len(list_intersect(h, w)) AS BIGINT) AS both_n, CAST(len(list_distinct(list_concat(h, w))) AS BIGINT) AS any_n,
      CAST(len(list_filter(h, lambda x: NOT list_contains(w, x))) AS BIGINT) AS left_n,
      least(10, greatest(2, CAST(len(h) AS BIGINT))) AS clamped FROM t""",
)
def set_functions(spark, d):
    h = F.array_distinct(tx.extract_tokens(F.col("html"), HREF))
    w = F.array_distinct(F.transform(tx.extract_tokens(F.col("html"), "[A-Za-z]+", 0), lambda x: F.concat(F.lit("/"), x)))
    t = table(spark, d, "pages").select("page_id", h.alias("h"), w.alias("w"))
    n = lambda c: F.size(c).cast("bigint")
    return t.select(
        "page_id",
        n(F.array_intersect("h", "w")).alias("both_n"),
        n(F.array_union("h", "w")).alias("any_n"),
        n(F.array_except("h", "w")).alias("left_n"),
        records.clamp(n("h"), 2, 10).cast("bigint").alias("clamped"),
    )


COMMITS = """commits AS (SELECT doc_id,
  ['feat', 'fix', 'perf', 'docs', 'test', 'wip', 'chore', 'revert'][doc_id % 8 + 1] ||
  CASE WHEN doc_id % 3 = 0 THEN '(' || source || ')' ELSE '' END || CASE WHEN doc_id % 10 = 1 THEN '!' ELSE '' END || ': ' || lang AS subject,
  CASE WHEN doc_id % 12 = 2 THEN 'text' || chr(10) || 'BREAKING CHANGE: gone' ELSE lang END AS body FROM documents)"""


@query(
    "conventional_commit",
    f"""WITH {COMMITS}, p AS (SELECT *, regexp_extract(subject, '^([a-z]+)', 1) AS type FROM commits),
    s AS (SELECT *, CASE type WHEN 'feat' THEN 'Added' WHEN 'fix' THEN 'Fixed' WHEN 'perf' THEN 'Performance' WHEN 'docs' THEN 'Changed'
      WHEN 'chore' THEN 'Changed' WHEN 'revert' THEN 'Changed' END AS section, (doc_id % 10 = 1 OR doc_id % 12 = 2) AS breaking FROM p)
    SELECT doc_id, type, section, breaking FROM s WHERE section IS NOT NULL
    UNION ALL SELECT doc_id, type, 'Breaking / Upgrade Notes', breaking FROM s WHERE section IS NOT NULL AND breaking""",
)
def conventional_commit(spark, d):
    n = F.col("doc_id")
    kinds = ["feat", "fix", "perf", "docs", "test", "wip", "chore", "revert"]
    subject = F.concat(
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (n % 8 + 1).cast("int")),
        F.when(n % 3 == 0, F.concat(F.lit("("), F.col("source"), F.lit(")"))).otherwise(""),
        F.when(n % 10 == 1, "!").otherwise(""),
        F.lit(": "),
        F.col("lang"),
    )
    body = F.when(n % 12 == 2, "text\nBREAKING CHANGE: gone").otherwise(F.col("lang"))
    commits = table(spark, d, "documents").select("doc_id", subject.alias("subject"), body.alias("body"))
    return predicates.conventional_commit(commits, body="body").select("doc_id", "type", "section", "breaking")
