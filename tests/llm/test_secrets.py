import re

from riskstream.llm import secrets as S

from .conftest import edge_rows, rows


def brute(text):
    out = []
    for kind, pattern, ok in (("assign", S.ASSIGN, lambda m: len(m[2]) >= 6), ("access", S.ACCESS, lambda m: len(m[0]) >= 20),
                              ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        out += [(m.start(), S.KINDS.index(kind), m.end()) for m in pattern.finditer(text) if ok(m)]
    return sorted(out)


CASES = ["", "token=abcdef", "TOKEN : 'abc'", "password=secret=abcdef123 secret: x", "api-key=1234567 apikey=1234567 API_KEY\"=\"1234567",
         "AKIA" + "A" * 15 + " AKIA" + "A" * 16 + "AKIA9", "é" * 5 + "0123456789abcdef01234567" + "日" + "f" * 30 + "x" * 40,
         "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "0123456789ABCDEF0123456789ABCDEF", "toKenſ=abcdefg Key paſſword=abcdefg",
         "tokentoken=abcdef passwdpasswd:abcdefg", "secret  =   'abcdef.-=/+'", "token=" + "a" * 5000]


def test_base_spans_equal_plain_search():
    for text in CASES:
        assert [s for s in S.find(text) if s[1] < 3] == brute(text), text


def test_checksums_decide():
    body = "A" * 30
    good = f"ghp_{body}{S.checksum(body)}"
    bad = f"ghp_{body}{S.checksum('B' + body[1:])}"
    assert [S.KINDS[k] for _, k, _ in S.find(f"x {good} y")] == ["github"]
    assert S.find(f"x {bad} y") == [] and S.find(good + "Z") == []
    assert S.find("npm_" + body + S.checksum(body)) == [(0, S.KINDS.index("npm"), 40)]


def test_scan_and_redact(spark, make, edges, clashing, nothing):
    got = S.scan(make(CASES)).collect()
    for r, text in zip(got, CASES):
        base = ",".join(f"{S.KINDS[k]}:{a}:{z}" for a, k, z in brute(text))
        import hashlib
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in brute(text)) for i in range(3))
        assert r.spans == base
    clean = S.redacted(make(["keep this", "my token=abcdefgh, and 0123456789abcdef01234567"])).orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["keep this", "my [SECRET], and [SECRET]"]
    assert clean[1].n_chars == len(clean[1].text)
    assert S.scan(edges).count() == len(edge_rows()) and S.scan(nothing).count() == 0
    equal = rows(S.redacted(clashing)) == rows(clashing) and S.redacted(nothing).columns == nothing.columns
    assert equal


def test_workers_give_memory_back_after_a_task():
    from pyspark.util import PythonEvalType

    assert S._on_series(S._spans).evalType == PythonEvalType.SQL_SCALAR_PANDAS_ITER_UDF  # the others have no end of a task
