import hashlib
import re

from wardflow.llm import secrets

from .util import EMPTY, SMALL, docs, rows, table

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def spelled(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check_base(found, texts):
    for doc_id, text in texts.items():
        spans = base_spans(text)
        kinds = [k for _, k, _ in spans]
        want = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spelled(spans).encode()).hexdigest())
        got = found[doc_id]
        assert (got.n_assign, got.n_access, got.n_hex, got.base_sha256) == want, (doc_id, text[:200], got.spans)


def found(df):
    return {r.doc_id: r for r in secrets.find_secrets(df).collect()}


def test_base_on_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in table(SMALL, "documents")}
    check_base(found(spark.read.parquet(f"{SMALL}/documents.parquet")), texts)


def test_base_corner_cases(spark):
    h = "0123456789abcdef"
    texts = dict(enumerate([
        "token: token=abcdefgh12", "secret = 'api_key: abcdefghij'", "PASSWORD='é' Passwd=\"12345678\"",
        "x" * 50_000 + "password=longenough" + "y z" * 20_000, "AKIA" + "A" * 11, "AKIA" + "AKIA" * 3, h * 2 + "g" + h,
        "😀token = abcdefgh😀" + h * 3, "api_key : \"a.b-c/d+e=f\"", "apikey=short apikey=longer_one", "secret=\ntoken=12345678",
        "pass\npassword  =  \"abcdefgh", " ".join(f"token=abcdefgh{i}" for i in range(400)),
    ]))
    check_base(found(docs(spark, texts.items())), texts)


def test_weak_parts_need_a_complement(spark):
    weak = "Zk3" * 8  # 24 mixed characters
    got = found(docs(spark, [
        (1, f"value {weak} alone"),
        (2, f"user: alice and {weak}"),
        (3, "user: alice" + " " * 500 + weak),
        (4, f"https://db.example.com/x then {weak}"),
        (5, "user: alice at https://db.example.com"),  # no secret
        (6, "client_id=abc42 password=hunter2"),  # a short value is a weak secret
        (7, "AKIA" + "B" * 16 + f" {weak}"),
        (8, f"user: alice and {weak}"),  # a copy gets the same
    ]))
    assert [got[i].spans for i in (1, 3, 5)] == ["", "", ""]
    assert got[2].spans == got[8].spans == "ident:0:11,weak:16:40"
    assert got[4].spans == "endpoint:0:22,weak:30:54"
    assert got[6].spans == "ident:0:15,weak:16:32"
    assert got[7].spans == "access:0:20,weak:21:45"


def test_reach_is_exact_across_blocks(spark):
    weak, texts = "Zk3" * 8, {}
    for gap in (1, 198, 199, 200, 201, 202, 399, 400, 401):
        for lead in (0, 57, 199, 200):
            texts[gap * 1000 + lead] = "." * lead + "user:alice" + " " * gap + weak
    for doc_id, r in found(docs(spark, texts.items())).items():
        assert (r.spans != "") == (doc_id // 1000 <= secrets.REACH), doc_id


def test_hard_cases(spark):
    got = rows(secrets.find_secrets(docs(spark, EMPTY, clash=True)), "doc_id", "n_assign", "spans")
    assert got == rows(docs(spark, EMPTY).selectExpr("doc_id", "0L", "''"))
    assert secrets.find_secrets(docs(spark, [])).count() == 0


def test_redaction(spark):
    h = "0123456789abcdef" * 2
    out = secrets.redact(docs(spark, [
        (1, f'a token = "{h}" b'), (2, "clean text"), (3, None), (4, "user: bob, " + "Zk3" * 8 + "!"), (4, "user: bob, " + "Zk3" * 8 + "!"),
    ]))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert rows(out, "doc_id", "text", "n_chars") == [
        (1, 'a [secret]" b', 13), (2, "clean text", 10), (3, None, None), (4, "[secret], [secret]!", 19), (4, "[secret], [secret]!", 19),
    ]
