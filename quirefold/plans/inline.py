"""Patterns of texts, dealt to the documents: row k of a list goes to the documents whose id leaves k, filled with their values.

``{i}`` is the document's id, ``{s}`` its source, ``{l}`` its language, ``{y}`` a year by its id, ``{w}`` the first word of three or more
ASCII letters in its text, capitalised (Nn if there is none).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPYRIGHT_LINES = ("md string", [
    ("© {y} by {w} María Lopez\nnext",), ("©{y} by {w} B C D E",), ("© {y} by Émile {w}",),
    ("Copyright {y}",), ("copyright {y}",), ("Copyright (c) {y} {s}",), ("no year {w}",),
    ("© 20 by {w}",), ("x © {y}\nCopyright 1970",), ("© {y} by Tom\n{w} Jones",), ("",),
])
INFOS = ("title string, author string", [
    ("{w}", ""), ("", "LaTeX"), (" ", " Writer "), ("", "Jane {w}"), ("", ""), ("{s}", "unknown"),
    ("\t", "pdfTeX"), ("", "texlive {l}"),
])
BOOKS = ("file string, title string, author string, year string, md string, reply string", [
    ("dir/{s} b.pdf", "Real {w}", "", "{y}", "# Other\n", '{"title":"{w}","author":"S","year":"1"}'),
    ("{s}.pdf", "", "LaTeX", "{y}", "# From *{w}*\n© 1990 by Ann {w}", "{}"),
    ("c{i}.pdf", "", "", "", "# Text {w}\n", '{"title":"Reply {s}","author":"{w}, Ann","year":"{y}"}'),
    ("d.{s}.pdf", "", "", "", "nothing {w}", "not json"),
    ("e{i}.pdf", "", "", "", "## Only <b>{w}</b>\n", '{"title":5,"author":"unknown","year":"{y}"}'),
    ("f.pdf", "", "Ann {w} and Bo Ray", "", "", ""),
    ("(-).pdf", "", "tex", "{y}", "", "[1]"), ("g{i}.pdf", "{w}", ", Ann", "", "", ""), ("h.pdf", "{s}", " and {w}", "", "", ""),
])
REPOS = ("repo_path string, local_hash string, remote_hash string", [
    ("{s}/{i}", "{y}", "{y}"), ("{s}/{i}", "{y}", "{w}"), ("{s}/{i}", "{w}", ""), ("{s}/{i}", "{l}", "{s}"),
])
FILES = ("path string, policy string, there boolean", [
    ("{s}/{i}/.gitignore", "absent", True), ("{s}/{i}/.env", "absent", False), ("{s}/{i}/readme.md", "always", True), ("{s}/{i}/docs.md", "always", False),
])
SETUPS = ("marker string, checks string", [
    (None, "1111111"), ("setup_version=6\nat={s}", "1111111"), ("setup_version=7\nat={s}", "1111111"),
    ("setup_version=7", "1101111"), ("at={y}", "1111111"), ("", "1111111"), ("setup_version={y}", "1111111"),
])
PATHS = ("path string", [
    ("base/personal-website/{s}.html",), ("base/{s}/readme.md",), ("{l}/{s}.log",), (".env",), ("{s}/.DS_Store",),
    ("base/research/scripts/{w}.py",), ("base/research/journal-articles/{i}.pdf",), ("src/.envrc{i}",),
])
MOUNTS = ("spec string", [
    ("./{s}:/workspace/{l}:rw",), ("./research:/workspace/research/{i}:ro",), ("{s}:{w}",),
])
TEXTS = ("t string", [
    ("gs://b/My File ({i}).v2.pdf",), ("dir/.{s}",), ("---",), ("Server says: No URLs Matched {w}",),
    ("created session '{i}' now",), ("id {y}{y} and 123abc",), ("us-{s}-a",), ("{l}//",), ("",),
    ("{w} b\tc- d.txt",), ("/{l}/Café – Übung {i}.pdf",),
])
METAS = ("meta string", [
    ('{"a":{i}}',), ("[{i}]",), ('"{w}"',), ("oops {s}",), ("{}",), (None,),
])

CONFIGS = ("config string", [
    ('{"chunk_size": {y}}',), ("[{i}]",), ("oops {w}",), (None,), ('{"chunk_size": "{i}", "x": 1}',), ("{}",), ('{"chunk_size": "{w}"}',),
])
CREATED = ("title string, author string, created string", [
    ("\t{w} ", None, "{y}-02-03"), (None, " {s}\n", "not a date"), ("{w}", "{s}", None), ("", "", "{y}-12-31"),
])
SCOPES = ("scopes string", [
    ("https://{s}/auth/cloud-platform",), ("devstorage.read_only,logging.{w}",), (None,), ("",), ("{s};cloud-platform.read-only",),
])
#: What a page is asked for, by its id; the last of these asks a page that isn't there.
REQUESTS = ["2", "PART {i}", "no such thing", "part", "", "1", "1"]

#: The folder that the ignored prefixes stand below.
BASE = "base"

#: Folders of a workspace, and those below a folder for each course.
SINGLE_DIRS = [
    "academic-hub/02-academic-notes-code/scripts", "research/journal-articles", "research/scripts",
    "research/independent-research/notes",
]
COURSE_DIRS = [
    ("academic-hub/01-resources", ["briefings", "google-docs", "nebo-exports", "lecture-recordings", "lecture-slides", "textbooks-and-papers"]),
    ("academic-hub/02-academic-notes-code", ["latex", "markdown"]),
]
PROJECTS = "research/independent-research/projects"

KINDS = {"int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _columns(schema: str) -> list[list[str]]:
    return [c.split() for c in schema.split(", ")]


def dealt(docs: DataFrame, table: tuple) -> DataFrame:
    """documents (doc_id, text, lang, source) → id and the columns of a pattern table."""
    schema, rows = table
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]{3,}", 0)
    word = F.when(word == "", "Nn").otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.expr("substring(_word, 2)"))))
    base = docs.withColumn("_word", F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]{3,}", 0)).withColumn("_word", word)
    fill = {"{i}": F.col("doc_id").cast("string"), "{s}": F.col("source"), "{l}": F.col("lang"), "{y}": (1950 + F.col("doc_id") % 70).cast("string"), "{w}": F.col("_word")}
    place = (F.col("doc_id") % len(rows) + 1).cast("int")

    def column(k: int, name: str, kind: str):
        out = F.element_at(F.array(*[F.lit(r[k]).cast(kind) for r in rows]), place)
        if kind == "string":
            for mark, value in fill.items():
                out = F.replace(out, F.lit(mark), F.coalesce(value, F.lit("")))
        return out.alias(name)

    return base.select(F.col("doc_id").alias("id"), *[column(k, n, t) for k, (n, t) in enumerate(_columns(schema))])


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool | int):
        return str(v).upper()
    text = "'" + v.replace("'", "''") + "'"
    return text.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")


def dealt_sql(table: tuple) -> str:
    """The same as a derived table in SQL."""
    schema, rows = table
    fill = {"{i}": "doc_id::VARCHAR", "{s}": "source", "{l}": "lang", "{y}": "(1950 + doc_id % 70)::VARCHAR", "{w}": "_word"}

    def column(k: int, name: str, kind: str) -> str:
        out = f"([{', '.join(literal(r[k]) for r in rows)}]::{KINDS[kind]}[])[doc_id % {len(rows)} + 1]"
        if kind == "string":
            for mark, value in fill.items():
                out = f"replace({out}, '{mark}', coalesce({value}, ''))"
        return f"{out} AS {name}"

    word = "(SELECT *, CASE WHEN _w = '' THEN 'Nn' ELSE upper(_w[1:1]) || lower(_w[2:]) END AS _word FROM (SELECT *, regexp_extract(coalesce(text, ''), '[A-Za-z]{3,}') AS _w FROM documents))"
    return f"(SELECT doc_id AS id, {', '.join(column(k, n, t) for k, (n, t) in enumerate(_columns(schema)))} FROM {word})"
