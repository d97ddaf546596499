import hashlib
import re

from tideframe.llm import secrets

KEY = "AKIA" + "Q7" * 8
HEXES = "0123456789abcdef" * 2
BLOB = "xY9/kQ2+mZ7pLw4RtB8n"
ROWS = [
    (1, None, "a", "x"), (2, "", "a", "x"), (3, f'é token = "{HEXES}" and {KEY}', "a", "x"), (4, f"PassWord:abc Api_KEY='{HEXES}'", "b", "x"),
    (5, f"the blob {BLOB} here", "c", "y"), (6, f"the common {BLOB}q here", "a", "x"), (7, f"the common {BLOB}q here", "b", "x"),
    (8, "ſecret = abcdefgh, paſſword = abcdefgh, toKen = abcdefgh", "d", None), (9, "secret=token:abcdefgh", None, None), (9, "secret=token:abcdefgh", None, None),
    (10, f"x{HEXES}" * 3000, "a", "x"), (None, f"secret = {HEXES}", "c", "z"), (11, "AKIA" + "A" * 15, "a", "x"), (12, "f" * 23 + "g" + "f" * 24, "a", "x"),
    (13, "secret: wide_example_1", "a", "x"), (14, "secret: wide_example_1 ", "b", "x"), (15, "secret: wide_example_1  ", "c", "x"),
]


def brute(text):
    """The contract's base, read plainly."""
    text = text or ""
    kinds = [
        (0, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    return sorted((m.start(), k, m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m))


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def same(out, rows):
    got = {}
    for r in out.collect():
        base = brute(dict((i, t) for i, t, *_ in rows)[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("owned")] == [s for s in listed(base).split(",") if s]
        got[r.doc_id] = r
    return got


def test_query_against_plain_reading(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = secrets.op2_secrets(spark, str(tmp_path))
    got = same(out, ROWS)
    assert out.count() == len(ROWS)
    assert got[5].spans == f"owned:9:{9 + len(BLOB)}" and got[5].n_live == 1
    # Two owners are no more than one: a blob they share stays a finding.
    assert got[6].spans == got[7].spans == f"owned:11:{12 + len(BLOB)}" and got[6].n_live == got[7].n_live == 1
    assert got[13].n_example == 1 and (got[3].n_example, got[3].n_weak) == (2, 1)  # HEXES is held by a, b and c
    assert got[8].n_assign == 1 and got[9].n_assign == 0


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(same(secrets.op2_secrets(spark, sf), rows)) == len(rows)


def test_ownership_and_redaction(spark):
    docs = spark.createDataFrame([(*r, 7) for r in ROWS], "doc_id long, text string, source string, lang string, _key int")
    n = {r.hash: (r.n_rows, r.n_repos, r.n_owners) for r in secrets.ownership(secrets.mark(docs, "doc_id", "text", "source", "lang")).collect()}
    assert n[hashlib.sha256(b"wide_example_1").hexdigest()] == (3, 3, 3)
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] is None and text[2] == "" and text[11] == "AKIA" + "A" * 15
    assert text[3].startswith("é <") and HEXES not in text[3] and KEY not in text[3]
    assert text[13] == "<example-secret>" and text[5] == "the blob <secret> here"
    assert all(HEXES not in (t or "") for t in text.values())
    empty = spark.createDataFrame([], docs.schema)
    assert secrets.redact(empty).count() == 0 and secrets.scan(empty).count() == 0


def test_blobs_of_several_owners(spark):
    held = {1: "a", 2: "bc", 3: "def"}
    blob = {n: f"{BLOB}{'Abc'[n - 1] * 3}" for n in held}
    rows = [(f"{n}{o}", f"the {blob[n]} here", o, "x") for n, owners in held.items() for o in owners]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, lang string")
    verdict = {r.id: [s.verdict for s in r.spans] for r in secrets.scan(docs).collect()}
    assert verdict == {i: ["example" if i[0] == "3" else "live"] for i, *_ in rows}
    text = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert text == {i: "the <example-secret> here" if i[0] == "3" else "the <secret> here" for i, *_ in rows}
