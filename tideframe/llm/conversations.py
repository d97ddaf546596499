"""Repair of conversation structure by weighted interval parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import CHUNK_ROWS, join_on, longest, row_index
from .base import col, query, saved, table

#: What may follow what, by role initials: ``(s?(ua)+)?`` as moves between the states start, s, u, a.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: A conversation may end as it began (empty) or after an answer.
ENDS = (0, 3)
#: Initials that may stand side by side.
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of one block, whose top cells are combined like rows of the next level.
BLOCK_ROWS = 4_096
#: Cells that one chart takes.
SPAN = 4
BLANKS = "\\x20\\x09-\\x0D"

Cell = tuple  # (cost, audit) or None by nonterminal

#: The nonterminals: [p, q] derives what leads from state p to state q. Binary rules: [p, q] -> [p, r] [r, q].
NONTERMINALS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
INDEX = {pq: i for i, pq in enumerate(NONTERMINALS)}
RULES = [[(INDEX[p, r], INDEX[r, q]) for r in range(4) if (p, r) in INDEX and (r, q) in INDEX] for p, q in NONTERMINALS]


def _join(left: Cell, right: Cell) -> Cell:
    """The cell of a span from those of its two parts."""
    out = []
    for rules in RULES:
        best = None
        for b, c in rules:
            if (x := left[b]) and (y := right[c]):
                cost = x[0] + y[0]
                if best is None or cost < best[0] or cost == best[0] and x[1] + y[1] < best[1]:
                    best = cost, x[1] + y[1]
        out.append(best)
    return tuple(out)


def _best(a: Cell, b: Cell) -> Cell:
    return tuple(min(x, y) if x and y else x or y for x, y in zip(a, b))


def _closure() -> Cell:
    """Insertions alone: the cheapest way from state to state without a row."""
    one = [None] * len(NONTERMINALS)
    for (p, letter), q in MOVES.items():
        if letter in "ua":
            one[INDEX[p, q]] = (INSERT, "I")
    none = tuple((0, "") if p == q else None for p, q in NONTERMINALS)
    out = _best(none, tuple(one))
    while (more := _best(out, _join(out, out))) != out:
        out = more
    return out


CLOSURE = _closure()


@lru_cache(maxsize=None)
def leaf(symbol: str) -> Cell:
    """The cell of one row, insertions before and after it included.

    ``symbol``: the role's initial (``x``: any other) and the row's fault: ``d`` must go,
    ``t`` truncated, ``k`` none.
    """
    out: list = [None] * len(NONTERMINALS)
    for i, (p, q) in enumerate(NONTERMINALS):
        ways = [(DELETE, "D")] if p == q else []
        if symbol[1] != "d":
            more = TRUNCATED * (symbol[1] == "t")
            ways += [(KEEP + more, "K")] if MOVES.get((p, symbol[0])) == q else []
            ways += [(REROLE + more, "R")] if q in (MOVES.get((p, "u")), MOVES.get((p, "a"))) else []
        out[i] = min(ways) if ways else None
    return _join(_join(CLOSURE, tuple(out)), CLOSURE)


def chart(cells: Sequence[Cell]) -> Cell:
    """The top cell over ``cells``: every span from the shortest up, every split of it.

    Cheapest derivations of one span never are a prefix of one another (a longer one has more
    insertions and so costs more), so the least (cost, audit) of a span is made of the least of
    its parts.
    """
    n = len(cells)
    spans = {(i, i + 1): cell for i, cell in enumerate(cells)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            spans[i, i + size] = reduce(_best, [_join(spans[i, k], spans[k, i + size]) for k in range(i + 1, i + size)])
    return spans[0, n]


def tower(cells: Sequence[Cell]) -> Cell:
    """The top cell over any number of cells: charts of ``SPAN`` cells, then charts of those."""
    while len(cells) > 1:
        cells = [chart(cells[i : i + SPAN]) for i in range(0, len(cells), SPAN)]
    return cells[0] if cells else CLOSURE


@lru_cache(maxsize=20_000)
def _short(symbols: str) -> Cell:
    return tower([leaf(symbols[i : i + 2]) for i in range(0, len(symbols), 2)])


def block(symbols: str) -> Cell:
    """The top cell of a block of rows; short ones are remembered."""
    return _short(symbols) if len(symbols) <= 64 else _short.__wrapped__(symbols)


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return min(cell[INDEX[0, q]] for q in ENDS if cell[INDEX[0, q]])


def _illegal(symbols: str) -> int:
    initials = symbols[::2]
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


_CELL = "id {id}, block long, costs array<long>, audits array<string>, first string, last string, illegal long, blank long, duplicate long, truncated long, turns long, least long, most long"
_SUMS = ("blank", "duplicate", "truncated", "turns")


def _cells(batches: Iterator[pa.RecordBatch], schema: pa.Schema, top) -> Iterator[pa.RecordBatch]:
    """A row of ``_CELL`` for every row; ``top`` gives (cell, first, last, illegal)."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            cell, row["first"], row["last"], row["illegal"] = top(row)
            row["costs"], row["audits"] = [x and x[0] for x in cell], [x and x[1] for x in cell]
        yield pa.RecordBatch.from_pylist([{f.name: row[f.name] for f in schema} for row in rows], schema)


def _of_rows(row: dict) -> tuple:
    return block(row["symbols"]), row["symbols"][0], row["symbols"][-2], _illegal(row["symbols"])


def _of_cells(row: dict) -> tuple:
    parts = sorted(row["parts"], key=lambda p: p["block"])
    cell = tower([tuple((c, a) if a is not None else None for c, a in zip(p["costs"], p["audits"])) for p in parts])
    borders = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
    return cell, parts[0]["first"], parts[-1]["last"], borders + sum(p["illegal"] for p in parts)


def _arrow(kind: pa.DataType) -> pa.Schema:
    long, text = pa.int64(), pa.string()
    names = ["first", "last", "illegal", "blank", "duplicate", "truncated", "turns", "least", "most"]
    return pa.schema([("id", kind), ("block", long), ("costs", pa.list_(long)), ("audits", pa.list_(text)), *((n, text if n in ("first", "last") else long) for n in names)])


def _parsed(df: DataFrame, top, ddl: str) -> DataFrame:
    def run(batches):
        first = next(batches, None)
        if first is not None:
            yield from _cells((b for bs in ([first], batches) for b in bs), _arrow(first.schema.field("id").type), top)

    return df.mapInArrow(run, ddl)


def clean(turns: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns as ``id, turn, role, text, digest``; null roles and texts are one blank, as in a damaged row."""
    space = F.lit(" ")
    out = turns.select(col(id).alias("id"), col(turn).cast("long").alias("turn"), F.coalesce(col(role), space).alias("role"), F.coalesce(col(text), space).alias("text"))
    return out.withColumn("digest", F.md5(F.encode("text", "UTF-8")))


def report(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Faults and cheapest repair of every conversation: ``id, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    Rows stand in the order of turn (nulls first), then role and the text's md5. A row is blank
    (no character but ASCII blanks), else a duplicate (role and text seen earlier in the
    conversation), else truncated (last character not ``.!?``). The repair is the cheapest parse
    of the rows' roles by a grammar in Chomsky normal form over state intervals: cells hold the
    least (cost, audit) of a span, closed under insertions, and are combined from short spans to
    long ones; a conversation longer than a block is parsed block by block and its blocks' top
    cells are parsed like rows, so no task holds a long conversation's rows.

    Null ids form one conversation; null roles and texts are one blank; empty texts are blank;
    very long texts enter by their digest alone. Equal rows of a turn are duplicates of its
    first. Empty tables give no rows. Other columns are ignored, whatever their names. An audit
    has a letter per edit and is one value of the result.
    """
    bare = clean(turns, id, turn, role, text)
    tail = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    initial = F.substring("role", 1, 1)
    bare = bare.select(
        "id", "turn", "role", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (tail == "").alias("is_blank"), (~tail.isin(".", "!", "?")).alias("is_open"),
    )
    most = longest(bare, ["id"])
    bounded = most <= rows
    ranked = row_index(bare, ["id"], ["turn", "role", "digest"], "pos", rows, bounded)
    ranked = row_index(ranked, ["id", "role", "digest"], ["pos"], "seen", rows, bounded)
    ranked = row_index(ranked, ["id", "turn"], ["pos"], "same", rows, bounded)
    blank, again = F.col("is_blank"), ~F.col("is_blank") & (F.col("seen") > 0)
    cut = ~F.col("is_blank") & (F.col("seen") == 0) & F.col("is_open")
    symbol = F.concat("initial", F.when(blank | again, "d").when(cut, "t").otherwise("k"))
    blocks = ranked.groupBy("id", F.floor(F.col("pos") / block_rows).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", symbol.alias("s")))), lambda x: x["s"]), "").alias("symbols"),
        F.count_if(blank).alias("blank"), F.count_if(again).alias("duplicate"), F.count_if(cut).alias("truncated"),
        F.count_if(F.col("turn").isNotNull() & (F.col("same") == 0)).alias("turns"), F.min("turn").alias("least"), F.max("turn").alias("most"),
    )
    ddl = _CELL.format(id=turns.schema[id].dataType.simpleString())
    cells, blocks_left = _parsed(blocks, _of_rows, ddl), -(-most // block_rows)
    while blocks_left > 1:
        part = F.struct("block", "costs", "audits", "first", "last", "illegal")
        up = saved(cells).groupBy("id", F.floor(F.col("block") / SPAN).alias("block")).agg(
            F.collect_list(part).alias("parts"), *[F.sum(c).alias(c) for c in _SUMS], F.min("least").alias("least"), F.max("most").alias("most")
        )
        cells, blocks_left = _parsed(up, _of_cells, ddl), -(-blocks_left // SPAN)
    # The cheaper of the empty conversation and one that ends after an answer.
    ends = F.array_sort(F.array(*[F.struct(F.col("costs")[INDEX[0, q]].alias("c"), F.col("audits")[INDEX[0, q]].alias("a")) for q in ENDS]))
    best = F.filter(ends, lambda x: x["c"].isNotNull())[0]
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    return cells.select("id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best["c"].alias("cost"), best["a"].alias("audit"))


def _edits(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns."""
    state = 0
    for edit in audit:
        said, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            said = "assistant" if state == 2 else "user"
        state = MOVES[state, said[0]]
        yield edit, said, text


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """The report row of every conversation and its rows in order; one row of the stream at a time is held."""
    rows = (row for batch in batches for row in batch.to_pylist())
    head = next(rows, None)
    while head is not None:
        after: list = []

        def own(after=after):
            for row in rows:
                if row["kind"] == 0:
                    after.append(row)
                    return
                yield row["role"], row["text"]

        texts = own()
        yield head, texts
        for _ in texts:
            pass
        head = after[0] if after else None


def _stream(turns: DataFrame, found: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """Reports and rows dealt out by conversation, each report before its rows, these in order."""
    body = clean(turns, id, turn, role, text).withColumn("kind", F.lit(1))
    both = found.withColumn("kind", F.lit(0)).unionByName(body, allowMissingColumns=True)
    return both.repartition("id").sortWithinPartitions("id", "kind", "turn", "role", "digest").drop("turn", "digest")


def repaired(turns: DataFrame, found: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns: ``id, position, edit, role, text``, by the audits of ``report`` (edits K, R and I; deleted rows are absent).

    Rows run through one sorted stream per partition beside their audits; a task holds one audit
    and one batch of rows, however long a conversation or text is. Nulls, ties, repeated rows,
    empty tables and further columns as in ``report``.
    """

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        text = pa.string()
        schema = pa.schema([first.schema.field("id"), ("position", pa.int64()), ("edit", text), ("role", text), ("text", text)])
        for head, rows in _conversations(b for bs in ([first], batches) for b in bs):
            out = []
            for n, (edit, said, what) in enumerate(_edits(head["audit"] or "", rows)):
                out.append({"id": head["id"], "position": n, "edit": edit, "role": said, "text": what})
                if len(out) == 1_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    ddl = f"id {turns.schema[id].dataType.simpleString()}, position long, edit string, role string, text string"
    return _stream(turns, found, id, turn, role, text).mapInArrow(run, ddl)


def digests(turns: DataFrame, found: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``found`` with ``repaired_sha256``: sha256 over the repaired ``role:text``, newline-joined, fed row by row."""
    names = [c for c in found.columns if c != "id"]

    def run(batches):
        out, first = [], next(batches, None)
        if first is None:
            return
        schema = pa.schema([*(first.schema.field(c) for c in ["id", *names]), ("repaired_sha256", pa.string())])
        for head, rows in _conversations(b for bs in ([first], batches) for b in bs):
            sha, sep = hashlib.sha256(), b""
            for _, said, what in _edits(head["audit"] or "", rows):
                sha.update(sep + f"{said}:{what}".encode())
                sep = b"\n"
            out.append({c: head[c] for c in ["id", *names]} | {"repaired_sha256": sha.hexdigest()})
            if len(out) == 1_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in ["id", *names])
    return _stream(turns, found, id, turn, role, text).mapInArrow(run, f"{kinds}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats the row, 4 makes the role
    ``user``; nulls are one blank.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    out = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(F.encode(name, "UTF-8")) % 20).alias("_d"))
    d: Column = F.col("_d")
    out = out.where(d != 0).select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_c"),
    )
    return out.drop("_c")


# crc32 of short texts bit by bit over the bytes, by its reversed polynomial; then the cheapest
# edits by walking the rows with the best (cost, audit) of every state.
_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' '))) AS h FROM conversations),
coded AS (
  SELECT raw.*, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INTEGER, 2))::BIGINT)),
    lambda c, x: xor(c // 256, t[(xor(c, x) % 256 + 1)::INTEGER]))) % 20 AS d FROM raw, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM hurt),
marked AS (
  SELECT *, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS tail,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen, left(role, 1) AS i,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS p, lag(pos) OVER (PARTITION BY conv_id ORDER BY pos) AS had FROM placed),
judged AS (
  SELECT *, tail = '' AS blank, tail <> '' AND seen AS dup, tail <> '' AND NOT seen AND tail NOT IN ('.', '!', '?') AS cut FROM marked),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
    count(*) FILTER (WHERE had IS NOT NULL AND (p || i) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
-- state to state without a row (insertions), in states start 0, s 1, u 2, a 3
hops(f, g, c, e) AS (VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')),
moves(f, l, g) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ways AS (
  SELECT conv_id, pos, f, g, min({'c': c, 'e': e}) AS w FROM (
    SELECT conv_id, pos, s AS f, s AS g, 3 AS c, 'D' AS e FROM judged, (SELECT unnest([0, 1, 2, 3]) AS s)
    UNION ALL SELECT conv_id, pos, f, g, cut::INTEGER, 'K' FROM judged JOIN moves ON l = i WHERE NOT blank AND NOT dup
    UNION ALL SELECT conv_id, pos, f, g, 2 + cut::INTEGER, 'R' FROM judged, moves WHERE l <> 's' AND NOT blank AND NOT dup) GROUP BY ALL),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS s, {'c': 0, 'e': ''} AS w FROM judged
  UNION ALL
  SELECT walk.conv_id, ways.pos, ways.g, min({'c': walk.w.c + hops.c + ways.w.c, 'e': walk.w.e || hops.e || ways.w.e})
  FROM walk JOIN hops ON hops.f = walk.s JOIN ways ON ways.conv_id IS NOT DISTINCT FROM walk.conv_id AND ways.pos = walk.pos + 1 AND ways.f = hops.g
  GROUP BY walk.conv_id, ways.pos, ways.g),
ends AS (
  SELECT walk.conv_id, min({'c': w.c + hops.c, 'e': w.e || hops.e}) AS w
  FROM walk JOIN facts ON facts.conv_id IS NOT DISTINCT FROM walk.conv_id AND n = pos JOIN hops ON hops.f = s AND hops.g IN (0, 3) GROUP BY walk.conv_id),
letters AS (SELECT conv_id, unnest(range(1, length(w.e) + 1)) AS nth, w.e AS e FROM ends),
edits AS (
  SELECT conv_id, nth, substr(e, nth::INTEGER, 1) AS edit, length(replace(left(e, nth::INTEGER), 'I', '')) AS pos FROM letters),
shown AS (
  SELECT edits.conv_id, nth, edit, role, text, row_number() OVER (PARTITION BY edits.conv_id ORDER BY nth) AS k
  FROM edits LEFT JOIN judged ON judged.conv_id IS NOT DISTINCT FROM edits.conv_id AND judged.pos = edits.pos AND edit <> 'I' WHERE edit <> 'D'),
opened AS (SELECT conv_id, bool_or(k = 1 AND edit = 'K' AND left(role, 1) = 's') AS s FROM shown GROUP BY conv_id),
lines AS (
  SELECT shown.conv_id, string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (k - s::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END,
    chr(10) ORDER BY nth) AS t FROM shown JOIN opened ON opened.conv_id IS NOT DISTINCT FROM shown.conv_id GROUP BY shown.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.e, '') AS audit,
  sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op13_conversations", _SQL)
def op13_conversations(spark, sf):
    """Damage and cheapest repair of all conversations."""
    turns = table(spark, sf, "conversations")
    hurt = damaged(turns)
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    found = join_on(ids, report(hurt), ["id"], "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = found.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"))
    return digests(hurt, found).withColumnRenamed("id", "conv_id")
