"""Secret spans against plain patterns and windows counted anew; places, ties, nulls and long texts."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossgraph.llm import queries, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
CANDIDATE = re.compile("[A-Za-z0-9+/_=-]+")


def entropic(word: str) -> bool:
    if len(word) < secrets.WINDOW or not re.search("[0-9]", word) or any(re.search(p, word) for p in secrets.ALLOWED):
        return False
    for kind in secrets.CLASSES:
        for i in range(len(word) - secrets.WINDOW + 1):
            window = word[i : i + secrets.WINDOW]
            if set(window) <= set(kind.characters):
                entropy = -sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in Counter(window).values())
                if entropy >= kind.bits - 1e-6:
                    return True
    return False


def expected(text: str | None) -> list[tuple[int, int, str]]:
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m.group()) >= 16]
    out += [(m.start(), 3, m.end(), "entropy") for m in CANDIDATE.finditer(text) if entropic(m.group())]
    return [(start, end, kind) for start, _, end, kind in sorted(out)]


def texts() -> list[str | None]:
    rng = random.Random(5)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    parts = ["token", "Secret", "API_KEY", "apikey", "passwd", "PASSWORD", " ", "  ", "=", ":", '"', "'", "é", "ß", "\n", ".", "AKIA", "abc", "0123456789abcdef", "x1"]
    out: list[str | None] = [
        None,
        "",
        "token=password: abcdefghijklmnop",
        "token = \"secret='abcdefghijkl'\"",
        "ıtoken=abcdefghijkl TOKEN:abcdefghijk Token : 'abc.def-ghi=jk/+_'",
        "é AKIAABCDEFGHIJKLMN AKIAAKIAABCDEFGHIJK AKIA1234567890123",
        "0123456789abcdef0123456789abcde 0123456789ABCDEF 0123456789abcde",
        "123e4567-e89b-12d3-a456-426614174000 example_q8Zr1xVb7NwPcL0sKdTf q8Zr1xVb7NwPcL0sKdTfAAAA",
        "aaaaaaaaaaaaaaaaaaaa1aaaaaaaaaaaaaaaaaaaa " + "q8Zr1xVb7NwPcL0sKdTf" * 2,
        "secretsecretsecret=tokentokentoken=passwordpassword",
    ]
    for _ in range(150):
        word = "".join(rng.choice(base64[: rng.choice([16, 36, 62, 67])]) for _ in range(rng.randrange(5, 60)))
        out.append("".join(rng.choice([*parts, word, word[:21], "ü"]) for _ in range(rng.randrange(1, 25))))
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, t, "kept") for k, t in enumerate(texts())]
    return secrets.find(spark.createDataFrame([*rows, rows[3]], "id int, text string, start string")).collect()


def test_spans_are_those_of_plain_patterns_and_windows(found):
    got = {r.id: [(s.start, s.end, s.kind) for s in r.secrets] for r in found}
    assert got == {k: expected(t) for k, t in enumerate(texts())}
    assert {kind for spans in got.values() for *_, kind in spans} == {"assign", "access", "hex", "entropy"}


def test_spans_hold_their_text_and_repeated_rows_and_columns_stay(found):
    assert len(found) == len(texts()) + 1 and all(r.start == "kept" for r in found)
    assert all(r.text[s.start : s.end] == s.text for r in found for s in r.secrets)


def test_incremental_sums_are_those_of_windows_counted_anew(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("0123456789abcdefXYZ") for _ in range(rng.randrange(1, 70))) for _ in range(60)] + ["7" * 25, "0123456789abcdef0123"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    kinds = secrets.CLASSES
    rows = df.select("w", *(secrets.least_sum(F.split("w", ""), k).alias(f"c{n}") for n, k in enumerate(kinds))).collect()
    for r in rows:
        for n, kind in enumerate(kinds):
            windows = [r.w[i : i + secrets.WINDOW] for i in range(len(r.w) - secrets.WINDOW + 1)]
            sums = [sum(secrets.SURPRISE[c] for c in Counter(x).values()) for x in windows if set(x) <= set(kind.characters)]
            assert r[f"c{n}"] == min(sums, default=None)


def test_allow_list_suppresses_entropy_alone(spark):
    df = spark.createDataFrame([("token = q8Zr1xVb7NwPcL0sKdTf",)], "text string")
    kinds = lambda **more: [s.kind for s in secrets.find(df, **more).first().secrets]
    assert kinds() == ["assign", "entropy"]
    assert kinds(allowed=("^q8Zr",)) == ["assign"]
    assert kinds(allowed=()) == ["assign", "entropy"]


def test_very_long_texts_are_read_whole(spark):
    secret = "q8Zr1xVb7NwPcL0sKdTf"
    text = "word " * 200_000 + secret + " " + "ab1" * 30_000
    spans = secrets.find(spark.createDataFrame([(text,)], "text string")).first().secrets
    assert [(s.start, s.kind) for s in spans if s.text == secret] == [(1_000_000, "entropy")]


def test_query_columns_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token=abcdefghijkl"), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op12_secret_scan(spark, str(tmp_path)).collect()}
    assert rows[1].spans == "assign:0:18" and rows[1].n_assign == 1
    assert rows[1].base_sha256 == hashlib.sha256(b"assign:0:18").hexdigest() and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.find(docs.limit(0)).count() == 0
