"""Secret scan with corpus-wide ownership of every candidate."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import col, query, saved, table, unused

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are whole: a match starts where its run does
BLOB = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

FOUND = "array<struct<kind:int,start:int,end:int,hash:string,strong:boolean>>"


def _entropy(value: str) -> float:
    """Shannon bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of one text in code points, by start and kind."""
    out = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in out)
    for m in BLOB.finditer(text):
        if _mixed(m[0]) and _entropy(m[0]) >= 3.5 and not any(s < m.end() and m.start() < e for s, e in base):
            out.append((3, m.start(), m.end(), m[0]))
    return sorted(out, key=lambda x: (x[1], x[0]))


def find(text: Column) -> Column:
    """Candidates of a text: kind (place in KINDS), code point span, sha256 of the value and whether it looks random."""

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            rows.append([
                {"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest(), "strong": len(v) >= 12 and _entropy(v) >= 2.8}
                for k, s, e, v in candidates(t.as_py() or "")
            ])
        shape = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("strong", pa.bool_())])
        return pa.array(rows, pa.list_(shape))

    return scan(text)


def mark(docs: DataFrame, id: str, text: str, owner: str, repo: str) -> DataFrame:
    """``(id, key, owner, repo, found)`` per row, written to the shared folder; ``key`` is the md5 of the text."""
    body = F.coalesce(col(text), F.lit(""))
    name = [F.coalesce(col(c).cast("string"), F.lit("")).alias(a) for c, a in ((owner, "owner"), (repo, "repo"))]
    return saved(docs.select(col(id).alias("id"), F.md5(F.encode(body, "UTF-8")).alias("key"), *name, find(body).alias("found")))


def ownership(marked: DataFrame) -> DataFrame:
    """``(hash, n_rows, n_repos, n_owners)`` of every candidate over the whole corpus.

    Rows are counted per candidate, owner and repository first, so a widely copied candidate
    reaches the last sum as one row per owner.
    """
    seen = marked.where(F.size("found") > 0).select("owner", "repo", F.explode("found").alias("f"))
    per_repo = seen.groupBy(F.col("f.hash").alias("hash"), "owner", "repo").agg(F.count("*").alias("n"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return per_owner.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def spans(marked: DataFrame, widely: int = 3) -> DataFrame:
    """``(key, spans)`` of every distinct text with findings: structs (start, kind, end, verdict) in order.

    A candidate that ``widely`` or more owners hold is a copied ``example``; one that fewer
    hold is ``live`` if it looks random, else ``weak``. The one limit holds for every kind,
    also for blobs without a keyword, an access key or hex form (kind ``owned``): a credential
    that was copied along with its text stays a finding.
    """
    parts = marked.where(F.size("found") > 0).select("key", F.explode("found").alias("f")).select("key", "f.*").distinct()
    known = parts.join(ownership(marked), "hash")
    verdict = F.when(F.col("n_owners") >= widely, "example").when(F.col("strong"), "live").otherwise("weak")
    return known.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", verdict.alias("verdict")))).alias("spans"))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "lang", widely: int = 3) -> DataFrame:
    """``(id, found, spans)`` for every row: what the patterns match and the findings with their verdicts.

    Null texts are empty texts; null owners are one unknown owner. Ties (equal starts) come
    in the order of KINDS. Repeated rows stay repeated; equal texts get equal findings.
    """
    marked = mark(docs, id, text, owner, repo)
    plain = marked.where(F.size("found") == 0).select("id", "found", F.expr("array()").cast("array<struct<start:int,kind:int,end:int,verdict:string>>").alias("spans"))
    hit = marked.where(F.size("found") > 0).join(spans(marked, widely), "key", "left").select("id", "found", "spans")
    return plain.unionByName(hit.withColumn("spans", F.coalesce("spans", F.expr("array()").cast("array<struct<start:int,kind:int,end:int,verdict:string>>"))))


def _masked(text: str, spans: list[dict]) -> str:
    out, at, runs = [], 0, []
    for s in spans:  # overlapping findings become one run
        if runs and s["start"] < runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], s["end"]), runs[-1][2] and s["verdict"] == "example")
        else:
            runs.append((s["start"], s["end"], s["verdict"] == "example"))
    for start, end, example in runs:
        out += [text[at:start], "<example-secret>" if example else "<secret>"]
        at = end
    return "".join([*out, text[at:]])


#: Bytes of findings up to which they are sent to every executor.
SMALL = 16 << 20


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "lang", widely: int = 3) -> DataFrame:
    """``docs`` with every finding replaced: ``<secret>``, or ``<example-secret>`` where it is widely copied.

    Texts without findings, null texts and all other columns stay as they are. Findings are
    joined by the md5 of the text, broadcast only if their counted size is below ``SMALL``.
    """
    found = saved(spans(mark(docs, id, text, owner, repo), widely))
    key, cuts = unused(docs, "_key", "_cuts")
    found = found.select(F.col("key").alias(key), F.col("spans").alias(cuts))
    size = found.agg(F.sum(F.size(cuts) * 40 + 64)).first()[0] or 0

    @F.arrow_udf("string")
    def mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t.as_py() if not s.is_valid else _masked(t.as_py(), s.as_py()) for t, s in zip(texts, spans)], pa.string())

    keyed = docs.withColumn(key, F.md5(F.encode(col(text), "UTF-8")))
    joined = keyed.join(F.broadcast(found) if size <= SMALL else found, key, "left")
    return joined.withColumn(text, F.when(col(cuts).isNull(), col(text)).otherwise(mask(col(text), col(cuts)))).select(*map(col, docs.columns))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


@query("op2_secrets")
def op2_secrets(spark, sf):
    """Base findings and all findings of every document, with the verdicts by ownership.

    The owner is the document's source, its repository the source's part in one language.
    """
    out = scan(table(spark, sf, "documents"))
    base = F.filter("found", lambda f: f["kind"] < 3)

    def count(of: str, field: str, value) -> Column:
        return F.size(F.filter(of, lambda x: x[field] == value)).cast("long")

    kinds = [count("found", "kind", k).alias(f"n_{KINDS[k]}") for k in range(3)]
    verdicts = [count("spans", "verdict", v).alias(f"n_{v}") for v in ("live", "weak", "example")]
    return out.select(F.col("id").alias("doc_id"), *kinds, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), *verdicts)
