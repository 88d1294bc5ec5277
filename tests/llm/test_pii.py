import hashlib
import re

import pytest

from glossgraph.llm import pii
from glossgraph.llm.queries import op10_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            s = m.group()
            digits = re.sub("[^0-9]", "", s)
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


TEXTS = [
    None,
    "",
    "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255",
    "😀é mail äö.x@foo-bar.example.com, +1 (743) 555-3824 and 4111 1111 1111 1111 or 4111-1111-1111-1112",
    "+49 30 123456 +1-2 +123456789012345678 ++49 (0) 170/55 12345678901234",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 4.4.4.4",
    "user%+x@a.b.c.d-e..f@g.h",
    "GB82 WEST 1234 5698 7654 32 bank account; DE89370400440532013000; XX00 0000 0000 0000",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907f1" ssn 123-45-6789 and 123-45-6789',
    "9.9.9.9 " * 700,
    "x" * 2000 + "@" + "1" * 2000,
    "a@b" + ".c" * 5000,
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in pii.find(df).select("doc_id", "pii", pii.digest(pii.F.col("pii"), pii.BASE_KINDS).alias("base"), pii.masked(pii.F.col("text"), pii.F.col("pii")).alias("masked")).collect()}


def test_base_spans_match_plain_patterns(found):
    for i, text in enumerate(TEXTS):
        assert found[i].base == base_spans(text), i


def test_spans_lie_at_their_text(found):
    for i, text in enumerate(TEXTS):
        for s in found[i].pii:
            assert text[s.start : s.end] == s.text


def test_more_kinds_need_checksum_or_context(found):
    kinds = [(s.kind, s.text) for s in found[7].pii if s.kind not in PATTERNS]
    assert ("iban", "DE89370400440532013000") in kinds
    assert all("XX00" not in text for _, text in kinds)
    kinds = [s.kind for s in found[8].pii if s.kind not in PATTERNS]
    assert kinds.count("secret") == 1 and kinds.count("ssn") >= 1


def test_masking(found):
    assert found[0].masked is None and found[1].masked == ""
    assert "[EMAIL]" in found[3].masked and "foo-bar" not in found[3].masked and "[CARD]" in found[3].masked


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op10_pii(spark, folder).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in PATTERNS]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, pii string, kind int")
    assert pii.find(df).count() == 0
    df = spark.createDataFrame([(1, "a@b.c", 7)], "doc_id long, text string, start int")
    assert pii.find(df).first().pii[0].kind == "email"
