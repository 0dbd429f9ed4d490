"""String semantics against plain Python."""

import base64
import hashlib
import os.path
import uuid
import zlib
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.functions.codec import compress_code, decompress_code
from strandline.functions.vectors import cosine, unit

ODD = ["", " ", "\ta\r\n b\x1c", "\xa0x\xa0", "a\n\n", "\x1c\x1d", "a\rb\x0bc\x0cd\x1ee\x85f g h", "é　", "@a\n@b", "  @x\ndef f():\n", "a\r\n"]


def one(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_strip_and_hash(spark):
    got = one(spark, ODD, T.strip(F.col("c")), T.normalize_content(F.col("c")), T.file_hash(F.col("c")), T.line_count(F.col("c")), T.point_id(F.lit("f"), F.col("c")))
    for v, (strip, norm, digest, lines, point) in zip(ODD, got, strict=True):
        n = v.replace("\r\n", "\n").strip()
        assert (strip, norm, digest, lines) == (v.strip(), n, hashlib.sha256(n.encode()).hexdigest(), len(v.splitlines()))
        assert point == str(uuid.UUID(hashlib.md5(f"f:{n}".encode()).hexdigest()))


def test_strip_takes_what_python_takes(spark):
    points = [c for c in range(1, 0x3100)]
    got = one(spark, [chr(c) + "x" for c in points], T.strip(F.col("c")))
    assert [c for c, (g,) in zip(points, got, strict=True) if g == "x"] == [c for c in points if chr(c).isspace()]


def test_signature(spark):
    got = one(spark, ODD, T.signature(F.col("c")))
    for v, (g,) in zip(ODD, got, strict=True):
        plain = [x.strip() for x in v.strip().splitlines() if not x.strip().startswith("@")]
        assert g == (plain[0] if plain else "None")


def test_suffix(spark):
    paths = ["a.py", ".py", "..py", "a.b/c", "a.b/.py", "x.tar.gz", "a.", "a.PY", "..a.js", "a.py/", ".a.py", "a..py", "...", "d/e.go", ""]
    got = one(spark, paths, T.suffix(F.col("c")), T.language(F.col("c")))
    for p, (suffix, language) in zip(paths, got, strict=True):
        assert suffix == os.path.splitext(p)[1]
        assert language == T.LANGUAGES.get(suffix)


def test_urls(spark):
    urls = ["https://github.com/o/r", "ftp://github.com/x", "not-a-url", "https://evilgithub.com.attacker.io/x", "HTTPS://GITHUB.com/x", "https://user@github.com:443/o/r", "https://github.com/a b", ""]
    got = one(spark, urls, T.is_repo_url(F.col("c")))
    assert [g for (g,) in got] == [urlsplit(u).scheme in ("http", "https") and "github.com" in urlsplit(u).netloc for u in urls]


def test_repo_name(spark):
    owner, name = T.repo_name(F.col("c"))
    assert one(spark, ["https://h/o/r", "https://h/o/r.git//", "x"], owner, name) == [("o", "r"), ("o", "r.git"), (None, "x")]


def test_embed_text(spark):
    cols = [F.lit(x) for x in ("f.py", "n", "t", "1", "2", "s")]
    (got,) = one(spark, ["code\n"], T.embed_text(*cols, F.col("c")))
    assert got[0] == "File: f.py\n    Name: n\n    Type: t\n    Lines: 1-2\n    Parent_Scope: s\n    code"


@pytest.mark.parametrize(("f", "p", "s", "t", "want"), [(0, 0, 0, 0, 0), (1, 1, 1, 3, 33), (3, 3, 3, 3, 100), (2, 1, 0, 3, 33), (9, 9, 9, 3, 300)])
def test_progress(spark, f, p, s, t, want):
    assert spark.range(1).select(T.progress(*(F.lit(x) for x in (f, p, s, t)))).first()[0] == want


def test_replies(spark):
    js = '{"answer": "a", "sources": [{"file": "f", "start_line": 3}]}'
    got = one(spark, ["plain", js, f"```json\n{js}\n```", f"```\n{js}```", '{"answer": ', "[1]"], T.parse_reply(F.col("c")))
    assert [(g.answer, len(g.sources)) for (g,) in got] == [("plain", 0), ("a", 1), ("a", 1), ("a", 1), ('{"answer": ', 0), ("[1]", 0)]


def test_codec(spark):
    got = one(spark, ["", "abc é", "x" * 9999], compress_code("c"), decompress_code(compress_code("c")))
    for v, (packed, back) in zip(["", "abc é", "x" * 9999], got, strict=True):
        assert zlib.decompress(base64.b64decode(packed)).decode() == v == back
    assert one(spark, ["no code!"], decompress_code("c")) == [("no code!",)]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1:] == [None, None]
    assert df.select(unit(F.col("b"))).first()[0] == pytest.approx([0.5**0.5] * 2)
    assert T.retry_delay(1, 5, 30) == 5 and T.retry_delay(5, 5, 30) == 30
