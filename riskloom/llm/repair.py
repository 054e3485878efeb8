"""Conversation structure repair (operator 13): a DuckDB recursive query inside hash-partitioned batches.

A repaired conversation is empty, or an optional system turn and then pairs of a
user and an assistant turn.  Edits lead there: keep a row, rerole it to user or
assistant, delete it (blank rows and duplicates have to go), insert an empty
turn; rows that stay though they are truncated cost extra.  The cheapest edits
win, of equally cheap ones the least in ASCII order, written as initials.

The grammar has four states: 0 nothing yet, 1 after system, 2 after user, 3 after
assistant; 0 and 3 may end.  In a batch, each step of the recursion advances one
turn for all conversations of the batch and keeps, for each state, the least
cost and its edits (``using key`` holds just those, not all steps before).

All rows are put in one global order first and cut every ``block`` rows, so a
very long conversation is many blocks in many batches.  A block that begins
within a conversation is solved from each of the four states; a second recursion
then advances one block for all conversations.  Batches hold a letter a row, no
texts; texts are joined to the edits of their block afterwards.

Cases: null role or text counts as one space; null turns come first; rows of one
turn are ordered by role, then by a digest of the text, and equal rows are
duplicates of the first; a null conv_id is one conversation of its own; a role
counts by its first character, and one that isn't s, u or a can't be kept; texts
are read whole; a repaired conversation is one row, so at most 2 GB; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import ranged
from ._spark import durable

SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
USER, ASSISTANT = 2, 3
#: state -> state after an inserted or reroled turn
_NEXT = {0: USER, 1: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEEP = {"s": (0,), "u": (0, 1, ASSISTANT), "a": (USER,)}
#: letters of rows: kept as they are, truncated, to be deleted
_PLAIN, _CUT, _GONE = "sua?", "SUA!", "-"


def _ahead(state: int) -> list[tuple[int, str]]:
    """States that insertions lead to, none twice."""
    found = {state: ""}
    while (following := _NEXT[state]) not in found:
        found[following] = found[state] + "I"
        state = following
    return list(found.items())


def moves() -> list[tuple[int, str, int, int, str]]:
    """before, letter, after, cost, edits: all ways over one row, insertions before it included."""
    out = []
    for before, letter in itertools.product(range(4), _PLAIN + _CUT + _GONE):
        cut = letter in _CUT
        initial = _PLAIN[_CUT.index(letter)] if cut else letter
        for state, edits in _ahead(before):
            paid = INSERT * len(edits)
            out.append((before, letter, state, paid + DELETE, edits + "D"))
            if letter == _GONE:
                continue
            out.append((before, letter, _NEXT[state], paid + REROLE + TRUNCATED * cut, edits + "R"))
            if state in _KEEP.get(initial, ()):
                out.append((before, letter, 1 if initial == "s" else _NEXT[state], paid + TRUNCATED * cut, edits + "K"))
    return out


def ends() -> list[tuple[int, int, str]]:
    """state, cost, edits: the ways to an accepting state after the last row."""
    return [(before, INSERT * len(edits), edits) for before in range(4) for state, edits in _ahead(before) if state in (0, ASSISTANT)]


_OVER_ROWS = """
with recursive letters as (
    select g, unnest(string_split(letters, '')) as letter, unnest(range(1, length(letters) + 1)) as i from blocks
), best(g, entry, state, i, cost, edits) using key (g, entry, state) as (
    select g, e, e, 0::bigint, 0::bigint, '' from blocks, range(4) t(e) where e = 0 or within
    union
    select g, entry, state, i, x.cost, x.edits from (
        select b.g, b.entry, m.after as state, l.i, min({'cost': b.cost + m.cost, 'edits': b.edits || m.edits}) as x
        from best b join letters l on l.g = b.g and l.i = b.i + 1 join moves m on m.before = b.state and m.letter = l.letter
        group by b.g, b.entry, m.after, l.i
    )
)
select b.conv, b.block, b.initials, r.entry, r.state, r.cost, r.edits from best r join blocks b on b.g = r.g and length(b.letters) = r.i"""

_OVER_BLOCKS = """
with recursive solved as (
    select *, dense_rank() over (partition by conv order by block) as j from blocks
), best(conv, state, j, cost, edits, way) using key (conv, state) as (
    select distinct conv, 0, 0::bigint, 0::bigint, '', '0' from solved
    union
    select conv, state, j, x.cost, x.edits, x.way from (
        select b.conv, s.state, s.j, min({'cost': b.cost + s.cost, 'edits': b.edits || s.edits, 'way': b.way || s.state}) as x
        from best b join solved s on s.conv = b.conv and s.j = b.j + 1 and s.entry = b.state
        group by b.conv, s.state, s.j
    )
), whole as (
    select conv, min({'cost': b.cost + e.cost, 'edits': b.edits || e.edits, 'way': b.way, 'last': e.edits, 'n': b.j}) as x
    from best b join ends e on e.state = b.state where b.j = (select max(j) from solved s where s.conv = b.conv) group by conv
)
select s.conv, s.block, s.entry, s.edits || case when s.j = x.n then x.last else '' end as edits, x.cost as cost,
       (lag(right(s.initials, 1)) over w || left(s.initials, 1) not in ('su', 'ua', 'au'))::bigint as seam
from solved s join whole on whole.conv = s.conv and s.entry = substr(x.way, s.j, 1)::int and s.state = substr(x.way, s.j + 1, 1)::int
window w as (partition by s.conv order by s.block)"""


def _ask(sql: str, **tables: pa.Table) -> pa.Table:
    """The rows of a query over Arrow tables, in one thread, without files."""
    with duckdb.connect(config={"threads": "1", "temp_directory": ""}) as con:
        for name, x in tables.items():
            con.register(name, x)
        return con.sql(sql).to_arrow_table()


def _batches(df: DataFrame, rows: int, per_batch: int, *key: str) -> DataFrame:
    """``df`` with ``_batch``, a hash of ``key``, so that a batch has about ``per_batch`` of ``rows``."""
    return df.withColumn("_batch", F.pmod(F.xxhash64(*key), F.lit(max(1, math.ceil(rows / per_batch)))))


def damage(turns: DataFrame) -> DataFrame:
    """Planted faults by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties it, 2 takes its ``[.!?]``, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), case.alias("_case")).where("_case <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_again"),
    ).drop("_again")


def _walked(rows: Column, edits: Column, entry: Column) -> Column:
    """The turns that ``edits`` make of ``rows`` from the state ``entry`` on."""
    start = F.struct(entry.cast("int").alias("state"), F.lit(1).alias("at"), F.array().cast("array<struct<role:string,text:string>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        edit = F.substr(edits, i, F.lit(1))
        row = F.get(rows, acc["at"] - 1)
        made = F.when(acc["state"] == USER, "assistant").otherwise("user")
        turn = F.struct(F.when(edit == "K", row["role"]).otherwise(made).alias("role"), F.when(edit == "I", "").otherwise(row["text"]).alias("text"))
        after = F.when(edit == "D", acc["state"]).when((edit == "K") & (F.substr(row["role"], F.lit(1), F.lit(1)) == "s"), 1).when(acc["state"] == USER, ASSISTANT).otherwise(USER)
        return F.struct(
            after.cast("int").alias("state"), F.when(edit == "I", acc["at"]).otherwise(acc["at"] + 1).cast("int").alias("at"),
            F.when(edit == "D", acc["out"]).otherwise(F.concat(acc["out"], F.array(turn))).alias("out"),
        )

    return F.when(F.length(edits) > 0, F.aggregate(F.sequence(F.lit(1), F.length(edits)), start, step, lambda acc: acc["out"])).otherwise(start["out"])


def repair(turns: DataFrame, block: int = 256, per_batch: int = 50_000) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of role, text): one row a conversation.

    ``turns`` has conv_id, turn (an integer), role, text.  ``gaps`` counts the turns that are missing between the first and the
    last; each row counts once, as blank, else duplicate, else truncated; ``illegal`` counts neighbours, before any edit, other
    than system and user, user and assistant, assistant and user.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), value("role").alias("role"), value("text").alias("text"))
    rows = rows.withColumn("conv", F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit(""))).withColumn("_sha", F.sha2("text", 256))
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    laid = ranged(rows, "conv", F.asc_nulls_first("turn"), "role", "_sha").select(
        "conv_id", "conv", "turn", "role", "text", "_sha", F.shiftleft("_part", 33).bitwiseOR(F.col("_row")).alias("at"),
        F.when(said == "", "blank").when(~F.substr(said, F.lit(-1)).isin(*".!?"), "truncated").alias("fault"),
        (F.shiftleft("_part", 33) + F.floor(F.col("_row") / block)).alias("block"), (F.col("_row") % block == 0).alias("_cut"),
    )

    # the first row of each text, counted before it is sent, so that a row that is repeated for ever stays one
    first = laid.groupBy("conv", "role", "_sha").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("_first").isNull(), "duplicate").otherwise(F.col("fault"))
    skinny = laid.select("conv", "block", "at", "_cut", "fault", F.substr("role", F.lit(1), F.lit(1)).alias("_initial")).join(first, "at", "left")
    marked = skinny.select("conv", "block", "at", "_cut", fault.alias("fault"), F.when(F.col("_initial").isin(*"sua"), F.col("_initial")).otherwise("?").alias("initial"))
    letter = F.when(F.col("fault").isin("blank", "duplicate"), _GONE).when(F.col("fault") == "truncated", F.translate("initial", _PLAIN, _CUT)).otherwise(F.col("initial"))
    count = lambda kind: F.sum(F.when(F.col("fault") == kind, 1).otherwise(0)).cast("long").alias(kind)
    joined = lambda c: F.concat_ws("", F.transform("_rows", lambda r: r[c]))
    made = marked.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("at", "_cut", "initial", letter.alias("letter")))).alias("_rows"), count("blank"), count("duplicate"), count("truncated"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("initials")), lambda i: F.substr("initials", i, F.lit(2)))
    blocks = durable(
        made.select("conv", "block", "blank", "duplicate", "truncated", joined("initial").alias("initials"), joined("letter").alias("letters"), F.get("_rows", F.lit(0))["_cut"].alias("within"))
        .withColumn("illegal", F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au"))).cast("long"))
    )
    n = laid.count()
    table = lambda names, values: pa.table(dict(zip(names, map(list, zip(*values, strict=True)), strict=True)))
    all_moves, all_ends = table(("before", "letter", "after", "cost", "edits"), moves()), table(("state", "cost", "edits"), ends())

    def over_rows(batch: pa.Table) -> pa.Table:
        return _ask(_OVER_ROWS, blocks=batch.append_column("g", pa.array(range(batch.num_rows))), moves=all_moves).cast(solved_as)

    def over_blocks(batch: pa.Table) -> pa.Table:
        return _ask(_OVER_BLOCKS, blocks=batch, ends=all_ends).cast(chosen_as)

    solved_as = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("initials", pa.string()), ("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    chosen_as = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("entry", pa.int32()), ("edits", pa.string()), ("cost", pa.int64()), ("seam", pa.int64())])
    solved = (
        _batches(blocks.select("conv", "block", "letters", "initials", "within"), n, per_batch, "conv", "block").groupBy("_batch")
        .applyInArrow(over_rows, "conv string, block long, initials string, entry int, state int, cost long, edits string")
    )
    chosen = durable(
        _batches(solved, n, per_batch, "conv").groupBy("_batch").applyInArrow(over_blocks, "conv string, block long, entry int, edits string, cost long, seam long")
    )

    texts = laid.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("_rows"), F.first("conv_id").alias("conv_id"))
    parts = texts.join(chosen, ["conv", "block"]).select("conv", "block", "conv_id", _walked(F.col("_rows"), F.col("edits"), F.col("entry")).alias("made"))
    counted = blocks.join(chosen, ["conv", "block"]).groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + F.coalesce("seam", F.lit(0))).alias("illegal"), F.max("cost").alias("cost"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"])).alias("audit"),
    )
    span = laid.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("_one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    whole = parts.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "made"))), lambda x: x["made"])).alias("repaired"))
    return whole.join(counted, "conv").join(span, "conv", "left").select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"
    )
