"""Least-cost repair of conversations, with one table of costs for all that begin alike.

What a repair may do depends only on a conversation's signature: a letter for each
row, by the row's role and fault.  Distinct signatures are sorted and read as a
prefix trie: a stack holds the layer of costs of every prefix on the way to the
present signature, so a layer is computed once for all that share it.  An answer is
read off the stack at the signature's end, its terminal node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .skew import join_hot
from .storage import materialize

#: What is not part of a word, and the marks that end a sentence.
_SPACE, _MARKS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: States of the roles so far: none, after s, after a u that waits for its a, after a whole pair.
_START, _SYSTEM, _USER, _PAIR = range(4)
_NEXT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _PAIR, (_PAIR, "u"): _USER}
#: The role that a rerole or an insertion makes in each state, and where it leads.
_MADE = {_START: "u", _SYSTEM: "u", _USER: "a", _PAIR: "u"}
_ROLES = {"u": "user", "a": "assistant"}
_FAR = 1 << 60
#: Ways on from a row in a state, in the order of their letters: (letter, next state, cost) for each symbol.
_STEPS: dict[str, list[list[tuple[str, int, int]]]] = {}
for _symbol in "dsuaxSUAX":
    _STEPS[_symbol] = []
    for _state in range(4):
        _ways = [("D", _state, DELETE)]
        if _symbol != "d":
            _more, _to = TRUNCATED if _symbol.isupper() else 0, _NEXT[(_state, _MADE[_state])]
            if (_state, _symbol.lower()) in _NEXT:
                _ways.append(("K", _NEXT[(_state, _symbol.lower())], KEEP + _more))
            _ways.append(("R", _to, REROLE + _more))
        _STEPS[_symbol].append(_ways)
_INSERTED = [_NEXT[(s, _MADE[s])] for s in range(4)]


def _with_inserts(layer: list[int]) -> list[int]:
    """The layer when rows may be inserted too: two in turn lead back to where one began."""
    out = list(layer)
    for _ in range(2):
        for state in range(4):
            to = _INSERTED[state]
            if out[state] + INSERT < out[to]:
                out[to] = out[state] + INSERT
    return out


#: Costs before the first row.
ROOT = _with_inserts([0, _FAR, _FAR, _FAR])


def next_layer(layer: list[int], symbol: str) -> list[int]:
    """Least cost of each state after one more row."""
    out = [_FAR] * 4
    for state, ways in enumerate(_STEPS[symbol]):
        for _, to, cost in ways:
            out[to] = min(out[to], layer[state] + cost)
    return _with_inserts(out)


def read_off(signature: str, layers: list[list[int]]) -> tuple[int, str]:
    """Least cost and the least string of edits that has it, from the layers of all prefixes.

    Backwards, the states on a cheapest way are marked with what is left to pay from them; forwards,
    the least letter that keeps to such a way is taken.  A letter and a state lead to one place only,
    so taking the least at each step gives the least string.
    """
    n, last = len(signature), layers[len(signature)]
    best = min(last[_START], last[_PAIR])
    left = [[_FAR] * 4 for _ in range(n + 1)]

    def settle(i: int) -> None:
        for _ in range(2):
            for state in range(4):
                if left[i][_INSERTED[state]] + INSERT < left[i][state]:
                    left[i][state] = left[i][_INSERTED[state]] + INSERT

    left[n][_START] = left[n][_PAIR] = 0
    settle(n)
    for i in range(n - 1, -1, -1):
        for state in range(4):
            if layers[i][state] < _FAR:
                left[i][state] = min(left[i + 1][to] + cost for _, to, cost in _STEPS[signature[i]][state])
        settle(i)
    edits, i, state, owed = [], 0, _START, best
    while i < n or state not in (_START, _PAIR) or owed:
        ways = [(letter, i + 1, to, cost) for letter, to, cost in (_STEPS[signature[i]][state] if i < n else [])]
        ways.append(("I", i, _INSERTED[state], INSERT))
        letter, i, state, owed = min((letter, j, to, owed - cost) for letter, j, to, cost in ways if left[j][to] == owed - cost)
        edits.append(letter)
    return best, "".join(edits)


def repair_sorted(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """``(signature, cost, audit)`` of sorted signatures, a layer for each node of their trie."""
    before, layers = "", [ROOT]
    for signature in signatures:
        shared = 0
        for a, b in zip(before, signature, strict=False):
            if a != b:
                break
            shared += 1
        del layers[shared + 1 :]
        for symbol in signature[shared:]:
            layers.append(next_layer(layers[-1], symbol))
        before = signature
        yield signature, *read_off(signature, layers)


def repairs(signatures: DataFrame) -> DataFrame:
    """``(signature, cost, audit)`` of the distinct signatures: sorted by range, each range a trie of its own."""

    def run(batches):
        def values():
            for b in batches:
                yield from b.column(0).to_pylist()

        rows: list[tuple[str, int, str]] = []
        for row in repair_sorted(values()):
            rows.append(row)
            if len(rows) >= 4096:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["signature", "cost", "audit"])

    return signatures.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, "signature string, cost bigint, audit string")


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after the planned damage: ``(conv_id, turn, role, text, at, again, lost)``.

    ``at`` tells rows of one turn apart; a row's second copy has ``again`` 1; a dropped row has ``lost`` true.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn"))) % 20
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), hit.alias("_hit"))
    rows = rows.withColumn("at", F.sha2(F.concat(F.char_length("role"), F.lit(":"), "role", "text"), 256))
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", _MARKS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "at", again.alias("again"), (F.col("_hit") == 0).alias("lost"))


def signatures(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, signature)`` of every conversation.

    Equal rows are met by a window over the row's own digest, so a long conversation's rows are
    spread; a conversation then comes together as a few bytes a row, without its texts.
    """
    end = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    small = rows.select(
        "conv_id", "turn", "at", "again", "lost", F.left("role", F.lit(1)).alias("initial"), end.alias("end"),
        F.when(end != "", F.sha2(F.concat(F.char_length("role"), F.lit(":"), "role", "text"), 256)).alias("said"),
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "lost", "said").orderBy("turn", "at", "again"))
    fault = F.when(F.col("end") == "", "b").when(F.col("seen") > 1, "d").when(~F.col("end").isin(*_MARKS), "t").otherwise("")
    small = small.withColumn("seen", seen).withColumn("fault", fault)
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    symbol = F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper(kind)).otherwise(kind)
    row = F.when(~F.col("lost"), F.struct("turn", "at", "again", "seen", kind.alias("kind"), symbol.alias("symbol")))
    turn = F.when(~F.col("lost"), F.col("turn"))
    many = lambda f: F.count_if(~F.col("lost") & (F.col("fault") == f))
    out = small.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.coalesce(F.max(turn) - F.min(turn) + 1, F.lit(0)).alias("span"),
        many("b").alias("blank"), many("d").alias("duplicate"), many("t").alias("truncated"),
    )
    kinds = F.transform("rows", lambda r: r["kind"])
    legal = lambda k: (k == "su") | (k == "ua") | (k == "au")
    pairs = F.zip_with(F.slice("kinds", 1, F.greatest(F.size("kinds") - 1, F.lit(0))), F.slice("kinds", 2, F.greatest(F.size("kinds") - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    turns = F.size(F.array_distinct(F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())))
    out = out.withColumn("kinds", kinds)
    return out.select(
        "conv_id", (F.col("span") - turns).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated",
        F.size(F.filter(pairs, lambda p: ~legal(p))).cast("bigint").alias("illegal"), F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("signature"),
    )


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, edit, n)``: the repaired conversations, row by row.

    ``n`` counts from 1 in a conversation; ``edit`` is K, R or I, and an inserted row has no turn.
    Rows come by sorted streams, a conversation's audit before its rows, so no conversation is held whole.
    """
    return _streamed(rows, audits.select("conv_id", "audit"), _emit_rows, "conv_id bigint, turn bigint, role string, text string, edit string, n bigint")


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)``: of each repaired conversation's ``role:text`` lines."""
    return _streamed(rows, audits.select("conv_id", "audit"), _emit_digests, "conv_id bigint, repaired_sha256 string")


def _streamed(rows: DataFrame, audits: DataFrame, emit, schema: str) -> DataFrame:
    heads = audits.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("at"), F.lit(0).alias("again"), F.lit("").alias("role"), F.col("audit").alias("text"))
    body = rows.where("not lost").select("conv_id", F.lit(1).alias("part"), F.col("turn").cast("bigint"), "at", "again", "role", "text")
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "at", "again")

    def run(batches):
        yield from emit(_edited(batches))

    return both.select("conv_id", "part", "turn", "role", "text").mapInArrow(run, schema)


def _edited(batches) -> Iterator[tuple]:
    """``(conv_id, turn, role, text, edit)`` of every row left or made, and ``(conv_id, None, None, None, None)`` at each end."""
    conv, audit, i, state, open_ = None, "", 0, _START, False

    def made():
        nonlocal i, state
        while i < len(audit) and audit[i] == "I":
            role = _MADE[state]
            yield conv, None, _ROLES[role], "", "I"
            state, i = _INSERTED[state], i + 1

    for batch in batches:
        for conv_id, part, turn, role, text in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if part == 0:
                if open_:
                    yield from made()
                    yield conv, None, None, None, None
                conv, audit, i, state, open_ = conv_id, text, 0, _START, True
                continue
            yield from made()
            edit, i = audit[i], i + 1
            if edit == "K":
                state = _NEXT[(state, role[:1])]
                yield conv, turn, role, text, "K"
            elif edit == "R":
                yield conv, turn, _ROLES[_MADE[state]], text, "R"
                state = _INSERTED[state]
    if open_:
        yield from made()
        yield conv, None, None, None, None


def _emit_digests(edited):
    ids, shas, sha, first = [], [], hashlib.sha256(), True
    for conv, _, role, text, _ in edited:
        if role is None:
            ids.append(conv)
            shas.append(sha.hexdigest())
            sha, first = hashlib.sha256(), True
            if len(ids) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], names=["conv_id", "repaired_sha256"])
                ids, shas = [], []
        else:
            sha.update((("" if first else "\n") + f"{role}:{text}").encode())
            first = False
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], names=["conv_id", "repaired_sha256"])


def _emit_rows(edited):
    names, kinds = ["conv_id", "turn", "role", "text", "edit", "n"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    rows, size, n = [], 0, 0
    for conv, turn, role, text, edit in edited:
        if role is None:
            n = 0
            continue
        n += 1
        rows.append((conv, turn, role, text, edit, n))
        size += len(text)
        if len(rows) >= 1000 or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def audit_conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation of ``damaged`` rows,
    or of rows with the same columns.  A signature that many conversations have is dealt over slices."""
    convs = materialize(signatures(rows), "signatures")
    counts = materialize(convs.groupBy("signature").agg(F.count(F.lit(1)).alias("n")), "distinct")
    return materialize(join_hot(convs, repairs(counts.select("signature")), "signature", counts).drop("signature"), "audits")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Damages, judges and repairs ``conversations``: one row for each original ``conv_id``.

    Nulls: a null id is a conversation of its own; a null role, text, or id or turn in the damage's key,
    counts as one space; rows of no turn come first.  Rows of one turn are ordered by the SHA-256 of their role and text,
    and a repeated row follows its first.  A conversation without rows after damage, an empty text and a row of
    spaces are blank or zero as defined; very long conversations are streamed; no rows give no rows;
    other columns are not looked at.
    """
    rows = damaged(turns)
    audits = audit_conversations(rows)
    digests = repaired_digests(rows, audits)
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    return audits.alias("a").join(digests.alias("b"), same).select("a.*", "b.repaired_sha256")
