from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.functions import hashing, paths, records
from plumbline.functions import text as tx


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "path, ext, base, module, stem",
    [
        ("a/b/File.TS", "ts", "File.TS", "a/b", "File"),
        ("noext", "", "noext", ".", "noext"),
        ("x/index.ts", "ts", "index.ts", "x", None),
        ("x/a.b.go", "go", "a.b.go", "x", "a.b"),
    ],
)
def test_path_parts(spark, path, ext, base, module, stem):
    assert one(spark, path, paths.ext_of) == ext
    assert one(spark, path, paths.base_of) == base
    assert one(spark, path, paths.module_of) == module
    assert one(spark, path, paths.stem_of) == stem


@pytest.mark.parametrize(
    "folder, rel, want", [("a/b", "./c", "a/b/c"), ("a/b", "../c", "a/c"), ("a", "../../c", "c"), ("a/./b", "x/../y", "a/b/y")]
)
def test_join_posix(spark, folder, rel, want):
    assert one(spark, folder, lambda c: paths.join_posix(c, F.lit(rel))) == want


@pytest.mark.parametrize(
    "path, kept",
    [
        ("lib/a.ts", True),
        ("lib/a.test.ts", False),
        ("lib/__tests__/a.ts", False),
        ("lib/a.d.ts", False),
        ("lib/models.generated.ts", False),
        ("lib/x_pb2.py", False),
        ("lib/x.pb.go", False),
        ("lib/readme.md", False),
    ],
)
def test_is_source(spark, path, kept):
    assert one(spark, path, paths.is_source) is kept


def test_ancestors_and_suffixes(spark):
    assert one(spark, "a/b/c", paths.ancestors) == ["a/b/c", "a/b", "a"]
    assert one(spark, "a/b/c", paths.suffixes) == ["a/b/c", "b/c", "c"]
    assert one(spark, "x.y.z", paths.dotted_chain) == ["x.y.z", "x.y", "x"]


@pytest.mark.parametrize("text, want", [("a\n\n  \nb\r\n\tc", 3), ("", 0), (" \n \nx", 1)])
def test_non_blank_loc(spark, text, want):
    assert one(spark, text, tx.non_blank_loc) == want


def test_norm_ws(spark):
    assert one(spark, " a \t b c  d e ", tx.norm_ws) == "a b c d e"
    assert one(spark, "  x\n", tx.trim_ws) == "x"


def test_interesting_lines(spark):
    text = "\n".join(
        ["import something from 'x'", "short", "longIdentifierOnly,", "});};){};){};}", "// a comment line here", "const total = compute(a,  b);", "@decorator('something')", "export * from './other-file'"]
    )
    assert one(spark, text, tx.interesting_lines) == ["const total = compute(a, b);"]


def test_token_stream(spark):
    text = "const a1 = 'x' + 12; // note\nreturn foo(`t`) /* c */ => \"s\""
    assert one(spark, text, tx.token_stream) == ["const", "I", "=", "S", "+", "N", ";", "return", "I", "(", "S", ")", "=>", "S"]


def test_shingles(spark):
    got = one(spark, "a b c d b c", lambda c: tx.shingles(F.split(c, " "), 2))
    assert got == ["a b", "b c", "c d", "d b"]
    assert one(spark, "a", lambda c: tx.shingles(F.split(c, " "), 2)) == []


def test_front_matter(spark):
    text = "---\ndate: 2024\ntitle: \"a: b\"\nbad line\ntitle: 'last'\n---\nbody\n---\nmore"
    assert one(spark, text, tx.front_matter) == {"date": "2024", "title": "last"}
    assert one(spark, text, tx.body_of) == "body\n---\nmore"
    assert one(spark, "plain", tx.front_matter) == {}
    assert one(spark, "plain", tx.body_of) == "plain"


def test_sections(spark):
    got = one(spark, "intro\n## One\na\nb\n### sub\n## Two\n", tx.sections)
    assert [(s["heading"], s["body"]) for s in got] == [("(preamble)", "intro\n"), ("One", "a\nb\n### sub\n"), ("Two", "")]


def test_table_cells(spark):
    assert one(spark, "| a |  b|c |", tx.table_cells) == ["a", "b", "c"]
    assert one(spark, "| --- | --- |", tx.is_table_row) is False
    assert one(spark, "| x | y |", tx.is_table_row) is True


def test_fnv1a_known_values(spark):
    assert one(spark, "a", hashing.fnv1a) == 0xE40C292C
    assert one(spark, "foobar", hashing.fnv1a) == 0xBF9CF968
    assert one(spark, "", hashing.fnv1a) == 2166136261
    assert one(spark, "\U0001f600", hashing.fnv1a) == 3409036472


@pytest.mark.parametrize(
    "line, want",
    [
        ("  foo( a,b ) ; // note", "foo(a, b);"),
        ("const u = 'http://x.y' ;", "const u='http: //x.y';"),
        ("if ( x ) { y : 1 }", "if(x){y: 1}"),
        ("a  .  b", "a . b"),
    ],
)
def test_fingerprint_norm(spark, line, want):
    assert one(spark, line, hashing.fingerprint_norm) == want


def test_fingerprint_value_and_metamorphic(spark):
    df = spark.createDataFrame(
        [
            ("base", "D", ["foo(a, b);"], "validate"),
            ("moved", "D", ["   foo(a,b) ;  // moved here"], "validate"),
            ("code", "D", ["foo(a, c);"], "validate"),
            ("lens", "C", ["foo(a, b);"], "validate"),
            ("symbol", "D", ["foo(a, b);"], None),
        ],
        "id string, lens string, quoted array<string>, symbol string",
    )
    got = {r[0]: r[1] for r in df.select("id", hashing.fingerprint(F.col("lens"), F.col("quoted"), F.col("symbol"))).collect()}
    assert got["base"] == hashlib.sha256(b"D\0foo(a, b);\0validate").hexdigest()[:16]
    assert got["symbol"] == hashlib.sha256(b"D\0foo(a, b);\0<no-symbol>").hexdigest()[:16]
    assert got["base"] == got["moved"]
    assert len(set(got.values())) == 4


def test_body_hash_ignores_line_ends(spark):
    assert one(spark, "a\r\nb  \n\n", hashing.body_hash) == hashlib.sha256(b"a\nb").hexdigest()


def test_citations(spark):
    text = "see lib/a.ts:12-20 and `b/c.sql`, not https://x.y/z.js nor {t}.md but d.yaml:7"
    got = [(c["tok"], c["line"], c["end"]) for c in one(spark, text, records.citations)]
    assert ("lib/a.ts", 12, 20) in got and ("b/c.sql", None, None) in got and ("d.yaml", 7, None) in got


def test_pct_and_layer_key(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (1, 2), (5, 1000)], "c int, t int")
    assert [r[0] for r in df.select(records.pct(F.col("c"), F.col("t"))).collect()] == [33, 100, 50, 1]
    layers = spark.createDataFrame([("10",), ("2",), ("0.1",), ("1",), ("1.2",)], "l string")
    assert [r[0] for r in layers.orderBy(records.layer_key(F.col("l"))).collect()] == ["0.1", "1", "1.2", "2", "10"]
