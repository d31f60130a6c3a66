import base64
import json
import math
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from threadloom.functions import images, kinds, stems, vectors, words


def rows(spark, values, schema="s string"):
    return spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)


def test_kinds_follow_their_order(spark):
    code = 'public static void main(String[] args) { return; } if (a == b) { x[0] = "1"; } for (;;) {}'
    cases = [
        ("", "assistant", "THOUGHT"),
        (None, "assistant", "THOUGHT"),
        ("  <system-reminder> x", "user", "HARNESS"),
        ("see <system-reminder>", "user", "THOUGHT"),
        ("short", "system", "HARNESS"),
        ("x" * 201, "system", "THOUGHT"),
        (code, "assistant", "TOOL_RESULT_EMBEDDED"),
        (code, "user", "THOUGHT"),
        ("Let me look", "assistant", "PROCEDURAL"),
        ("Let me look", "user", "THOUGHT"),
        ("Now Parser:", "assistant", "PROCEDURAL"),
        ("the latest news", "assistant", "PROCEDURAL"),
        ("y" * 201 + " test", "assistant", "THOUGHT"),
        ("A quiet day.", "Assistant", "THOUGHT"),
        ("let's go", None, "THOUGHT"),
    ]
    df = rows(spark, [c[:2] for c in cases], "content string, role string")
    got = [r[0] for r in df.select(kinds.kind_of(F.col("content"), F.col("role"))).collect()]
    assert got == [c[2] for c in cases]


def test_keywords():
    assert words.keywords('show me the "Blue Whale" and the blue whale crew-list, x Crew-List') == ["Blue Whale", "blue", "whale", "crew-list"]
    assert words.keywords("") == [] and words.keywords("the of") == []
    assert words.any_of(["a b", "c"]) == '"a b" OR c'
    assert words.sanitized("foo-bar's (x") == '"foo" OR "bar" OR "s" OR "x"'


def test_keywords_of_column(spark):
    assert rows(spark, ["Please Check the Snake_case and snake_case"]).select(words.keywords_of(F.col("s"))).first()[0] == ["check", "snake_case"]


def test_preview_and_slugs(spark):
    df = rows(spark, ["  a\nb ", "x" * 199 + "  yz", r"C:\Work\a/b", "e--dev-x", "short", "a/b.jsonl"])
    got = df.select(words.preview(F.col("s")), words.slug_of(F.col("s")), words.path_of(F.col("s")), words.session_id_of(F.col("s"))).collect()
    assert got[0][0] == "a b" and got[1][0] == "x" * 199 + "..."
    assert got[2][1] == "c--Work-a-b" and got[3][2] == "e:/dev/x" and got[4][2] is None and got[5][3] == "a--b"


def test_terms_are_those_of_fts5():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, instance)")
    text = "Caresses ponies ties cats agreed plastered motoring sized hopping falling hissing fizzed failing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll snake_case don't Café ÄÖÜ straße patterns fragile service today 42nd"
    db.execute("insert into t values (?)", (text,))
    want = [r[0] for r in db.execute("select term from v order by offset")]
    assert stems.terms(text) == want


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [0.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [1.0, 0.0, 0.0] and got[3] is None


def test_codec(spark):
    df = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>")
    got = df.select(vectors.pack_vector("v").alias("b")).withColumn("v", vectors.unpack_vector("b", F.lit(2))).collect()
    assert bytes(got[0].b) == struct.pack("<2f", 1, -2.5) and got[0].v == [1.0, -2.5] and got[1].v is None
    assert math.isclose(df.select(vectors.norm(F.col("v"))).first()[0], math.sqrt(7.25))


def png(w, h):
    return images.PNG + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\0" * 9


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", h, w) + b"\0" * 8


def test_image_sizes(spark):
    assert images.image_size(png(3, 4)) == (3, 4) and images.image_size(jpeg(5, 6)) == (5, 6) and images.image_size(b"x") is None
    df = spark.createDataFrame([(bytearray(png(3000, 4)),), (bytearray(b"zz"),)], "b binary")
    got = df.select(images.png_size(F.col("b")), images.any_image_size("b").width).collect()
    assert got[0][0] == (3000, 4) and got[0][1] == 3000 and got[1][0] is None and got[1][1] is None


def test_scrub_is_idempotent():
    def block(data):
        return {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": base64.b64encode(data).decode()}}

    line = json.dumps({"message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [block(png(3000, 10)), block(png(10, 10))]}]}, "toolUseResult": {"file": {"base64": "x" * 2000}}})
    new, found = images.scrub_line(line, 2000, 1 << 20)
    assert found == [(3000, 10, len(png(1, 1)), "dimension")]
    value = json.loads(new)
    assert value["message"]["content"][0]["tool_use_id"] == "t1" and value["toolUseResult"]["file"]["base64"] == ""
    assert images.scrub_line(new, 2000, 1 << 20) == (new, [])
    assert images.scrub_line("not json", 1, 1) == ("not json", [])


@pytest.mark.parametrize(("w", "h", "n", "why"), [(10, 10, 10, None), (3000, 1, 10, "dimension"), (None, None, 99, "byte_size"), (3000, 1, 99, "both")])
def test_excess(w, h, n, why):
    assert images.excess(w, h, n, 2000, 50) == why
