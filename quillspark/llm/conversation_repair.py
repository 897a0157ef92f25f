"""Repair of conversation structure: the cheapest edits that make speakers alternate, by dynamic programming over turns.

Conversations are cut into segments of bounded length. Segments of like length form a tensor with time first; one step of
NumPy updates the costs of all states of all its conversations, costs are stored for every turn, and the edits are traced
forward, again a turn of all conversations at a time. A conversation of many segments is solved by the costs from state
to state of each of them (min-plus matrices), which are chained backward and forward one segment after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, short_batches
from quillspark.operators.stages import numbered

SPACES = " \t\n\x0b\x0c\r"
# states: nothing yet, after the system's row, after a user's, after an assistant's; a conversation ends in the first or last
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ENDS = np.array([0, 1 << 40, 1 << 40, 0], np.int64)
_NEVER = 1 << 40
# symbols: 3 * initial (other, s, u, a) + fault (none, truncated, blank or duplicate); then padding
_PAD = 12
_INSERT = np.array([_USER, _USER, _ASSISTANT, _USER])  # state after an inserted row, or after one with a new role
_KEEP = np.array([[-1, -1, -1, -1], [_SYSTEM, -1, -1, -1], [_USER, _USER, -1, _USER], [-1, -1, _ASSISTANT, -1]])
_keep_to = np.vstack([np.repeat(np.maximum(_KEEP, 0), 3, axis=0), np.arange(4)])
_keep_cost = np.vstack([np.where((_KEEP[:, None] < 0) | (np.arange(3) == 2)[:, None], _NEVER, (np.arange(3) == 1)[:, None]).reshape(12, 4), np.zeros((1, 4), int)])
_role_cost = np.array([2, 3, _NEVER] * 4 + [_NEVER])
_LEGAL = {(1, 2), (2, 3), (3, 2)}
_legal = np.array([[(a, b) in _LEGAL for b in range(4)] for a in range(4)])


def _inserted(costs: np.ndarray) -> np.ndarray:
    """Costs if up to two rows may be inserted first; more lead back to where one was."""
    for _ in range(2):
        costs = np.minimum(costs, costs[:, _INSERT] + 2)
    return costs


def backward_costs(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """costs[t, lane, state] of the cheapest way on from turn t. codes: symbols, turns by lanes; ends: lanes by states."""
    turns, lanes = codes.shape
    costs = np.empty((turns + 1, lanes, 4), np.int64)
    costs[turns] = ends
    for t in range(turns - 1, -1, -1):
        code, after = codes[t], costs[t + 1]
        keep = np.take_along_axis(after, _keep_to[code], 1) + _keep_cost[code]
        here = np.minimum(np.minimum(after + 3, keep), after[:, _INSERT] + _role_cost[code][:, None])
        costs[t] = np.where((code == _PAD)[:, None], after, _inserted(here))
    return np.minimum(costs, _NEVER)


def trace(codes: np.ndarray, costs: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits of least cost, of equal ones the ASCII-least, as slots (lanes by 3 * turns + 2), and the state at the end.

    Three slots a turn: two rows inserted before it, then what becomes of it; two slots for rows after a `last` segment.
    D, I, K, R are edits, i and r stand for an assistant's row, and a dot for none.
    """
    turns, lanes = codes.shape
    slots = np.full((lanes, 3 * turns + 2), ord("."), np.uint8)
    state, lane = start.copy(), np.arange(lanes)
    for t in range(turns):
        open_ = codes[t] < _PAD
        for k in range(3):
            if not open_.any():
                break
            who = lane[open_]
            code, s = codes[t, who], state[who]
            here, after = costs[t, who, s], costs[t + 1, who]
            to = _INSERT[s]
            delete = np.take_along_axis(after, s[:, None], 1)[:, 0] + 3 == here
            insert = ~delete & (costs[t, who, to] + 2 == here) & (k < 2)
            kept = _keep_to[code, s]
            keep = ~delete & ~insert & (np.take_along_axis(after, kept[:, None], 1)[:, 0] + _keep_cost[code, s] == here)
            role = ~delete & ~insert & ~keep
            slots[who[delete], 3 * t + 2] = ord("D")
            slots[who[insert], 3 * t + k] = np.where(to[insert] == _USER, ord("I"), ord("i"))
            slots[who[keep], 3 * t + 2] = ord("K")
            slots[who[role], 3 * t + 2] = np.where(to[role] == _USER, ord("R"), ord("r"))
            state[who] = np.where(delete, s, np.where(keep, kept, to))
            open_ = np.zeros(lanes, bool)
            open_[who[insert]] = True
    for k in range(2):
        who = lane[last & (costs[turns, lane, state] > 0)]
        to = _INSERT[state[who]]
        slots[who, 3 * turns + k] = np.where(to == _USER, ord("I"), ord("i"))
        state[who] = to
    return slots, state


def _tensors(symbols: list[np.ndarray], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the segments of one tensor, and their symbols with time first: lengths within a power of two of each other."""
    lengths = np.array([len(s) for s in symbols], np.int64)
    order = np.argsort(lengths, kind="stable")
    first = 0
    while first < len(order):
        turns = 1 << int(max(lengths[order[first]], 1) - 1).bit_length()
        lanes = min(int(np.searchsorted(lengths[order], turns, "right")) - first, max(1, most // turns))
        at = order[first : first + lanes]
        codes = np.full((lengths[at[-1]], lanes), _PAD, np.uint8)
        for k, i in enumerate(at.tolist()):
            codes[: lengths[i], k] = symbols[i]
        yield at, codes
        first += lanes


def _texts(slots: np.ndarray, lengths: list[int]) -> list[str]:
    """Slots of each lane without those of padding."""
    return [(row[: 3 * n].tobytes() + row[-2:].tobytes()).decode("ascii") for row, n in zip(slots, lengths, strict=True)]


def solve(symbols: list[np.ndarray], ends: np.ndarray, starts: np.ndarray, last: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each segment: its slots, its cost, and the state at its end."""
    texts, cost, final = [""] * len(symbols), np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    for at, codes in _tensors(symbols):
        costs = backward_costs(codes, ends[at])
        cost[at] = costs[0, np.arange(len(at)), starts[at]]
        slots, final[at] = trace(codes, costs, starts[at], last[at])
        for i, text in zip(at.tolist(), _texts(slots, [len(symbols[i]) for i in at.tolist()]), strict=True):
            texts[i] = text
    return texts, cost, final


def transfers(symbols: list[np.ndarray]) -> np.ndarray:
    """Cost from each state before a segment to each state after it, segments by states by states."""
    out = np.empty((len(symbols), 4, 4), np.int64)
    for at, codes in _tensors(symbols, 1 << 16):
        for end in range(4):
            unit = np.full((len(at), 4), _NEVER, np.int64)
            unit[:, end] = 0
            out[at, :, end] = backward_costs(codes, unit)[0]
    return out


def _gathered(batches: Iterator[pd.DataFrame], most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Batches put together until they hold some `most` symbols."""
    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += int(batch["symbols"].str.len().sum())
        if n >= most:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


_SEGMENT = "c string, block long, o0 int, symbols string, blank long, duplicate long, truncated long, illegal long"


def _judged(batches: Iterator[pd.DataFrame], segment: int) -> Iterator[pd.DataFrame]:
    """Symbols with their faults, counts, the matrix of segments at the edge of a block, and the edits of all others."""
    for batch in _gathered(batches):
        symbols, counts = [], []
        for o0, text, firsts in zip(batch["o0"].tolist(), batch["symbols"], batch["firsts"], strict=True):
            raw = np.frombuffer(text.encode("ascii"), np.uint8) - 65
            initial, fault = raw // 3, raw % 3
            blank, early = fault == 2, np.zeros(len(raw), bool)
            early[np.asarray(firsts, np.int64) - o0] = True
            again = ~blank & ~early
            counts.append((int(blank.sum()), int(again.sum()), int((~again & (fault == 1)).sum()), int((~_legal[initial[:-1], initial[1:]]).sum())))
            symbols.append(3 * initial + np.where(again, 2, fault))
        lengths = np.array([len(s) for s in symbols])
        edge = ((batch["o0"] == 0) | (batch["o0"] + lengths == segment)).to_numpy(bool)
        out = pd.DataFrame(counts, columns=["blank", "duplicate", "truncated", "illegal"])
        out.insert(0, "symbols", [(s + 65).astype(np.uint8).tobytes().decode("ascii") for s in symbols])
        for k, name in enumerate(("c", "block", "o0")):
            out.insert(k, name, batch[name])
        slots, cost, matrices = [None] * len(out), np.zeros(len(out), np.int64), [None] * len(out)
        whole = np.flatnonzero(~edge).tolist()
        own = [symbols[i] for i in whole]
        found = solve(own, np.tile(_inserted(_ENDS[None]), (len(own), 1)), np.zeros(len(own), np.int64), np.ones(len(own), bool))
        for i, text, price in zip(whole, *found[:2], strict=True):
            slots[i], cost[i] = text, price
        part = np.flatnonzero(edge).tolist()
        for i, m in zip(part, transfers([symbols[i] for i in part]), strict=True):
            matrices[i] = m.ravel().tolist()
        yield out.assign(slots=slots, cost=cost, matrix=matrices)


def _codes(symbols: str) -> np.ndarray:
    return np.frombuffer(symbols.encode("ascii"), np.uint8) - 65


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a conversation's segments, last first) with the costs at their ends; the cost of all stands at the first one."""
    held, price = None, _inserted(_ENDS[None])[0]
    for batch in batches:
        ends, last = [], []
        for c, matrix in zip(batch["c"], batch["matrix"], strict=True):
            last.append(c != held)
            if c != held:
                held, price = c, _inserted(_ENDS[None])[0]
            ends.append(price.tolist())
            price = np.minimum((np.asarray(matrix, np.int64).reshape(4, 4) + price).min(1), _NEVER)
        yield batch.assign(ends=ends, last=last).drop(columns="matrix")


def _traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with the edits, the cost and the end of the segment for each state before it."""
    for batch in _gathered(batches):
        symbols, ends = [_codes(s) for s in batch["symbols"]], np.array([list(e) for e in batch["ends"]], np.int64)
        found = [solve(symbols, ends, np.full(len(symbols), s), batch["last"].to_numpy(bool)) for s in range(4)]
        yield batch.drop(columns="ends").assign(slots=[list(x) for x in zip(*(f[0] for f in found), strict=True)], costs=[list(x) for x in zip(*(f[1].tolist() for f in found), strict=True)], finals=[list(x) for x in zip(*(f[2].tolist() for f in found), strict=True)])


def _picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a conversation's segments, in order) with the edits for the state in which they really start."""
    held, state, before = None, _START, 0
    for batch in batches:
        slots, costs, more = [], [], []
        for c, symbols, own, price, finals in zip(batch["c"], batch["symbols"], batch["slots"], batch["costs"], batch["finals"], strict=True):
            initials = _codes(symbols) // 3
            new = c != held
            more.append(int(not new and not _legal[before, initials[0]]))
            if new:
                held, state = c, _START
            slots.append(own[state])
            costs.append(price[state] if new else 0)
            state, before = finals[state], initials[-1]
        yield batch.drop(columns=["slots", "costs", "finals", "last"]).assign(illegal=batch["illegal"] + more, slots=slots, cost=costs)


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One hash a conversation, of its lines in order; a line at a time is held."""
    held, digest = None, None
    for batch in batches:
        out = []
        for c, line in zip(batch["c"], batch["line"], strict=True):
            if c != held:
                if held is not None:
                    out.append((held, digest.hexdigest()))
                held, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out, columns=["c", "repaired_sha256"])
    if held is not None:
        yield pd.DataFrame([(held, digest.hexdigest())], columns=["c", "repaired_sha256"])


def repair_conversations(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = 4096) -> tuple[DataFrame, DataFrame]:
    """A report with one row per conversation, and the repaired rows: conversation, row (order), sub, edit, role, text.

    Rows of a conversation are taken by turn, nulls first, ties by role and text (their first 32 characters before the
    rest); a null role or text counts as one blank, a null conversation is one of its own, other columns are ignored.
    A row is blank, or a duplicate of an earlier one with its role and text, or truncated: its last character that is
    no white space is none of `.!?`. Edits give role initials `(s?(ua)+)?`: keep 0, new role 2, delete 3, insert a row
    without text 2; truncated rows that stay add 1, blank and duplicate ones go. Of equal costs the edits with the least
    initials (D, I, K, R) count. The report has gaps, blank, duplicate, truncated, illegal, cost (long) and audit. No rows give no rows.

    Rows are sorted by range and numbered, so that a conversation that holds most rows lies in many tasks; `segment`
    consecutive numbers are one block, and a conversation's rows of a block one segment. Only segments at the edge of a
    block can have neighbours; their matrices (128 bytes for up to `segment` rows) pass through one task per conversation.
    """
    short_batches(table.sparkSession)
    rows = table.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    rows = rows.withColumn("c", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("")))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 32)]
    rows = numbered(rows, order, "g", within=[F.col("role"), F.col("text")]).withColumn("g", F.col("g") - 1)
    rows = rows.withColumns({"block": F.expr(f"g div {segment}"), "o": (F.col("g") % segment).cast("int")})
    core, initial = F.rtrim("text", F.lit(SPACES)), F.substring("role", 1, 1)
    fault = F.when(core == "", 2).when(F.substring(core, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    light = rows.select("c", "block", "o", "g", (fault + 3 * F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)).alias("symbol"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"))
    firsts = light.groupBy("c", "h1", "h2").agg(F.min("g").alias("g")).select("c", F.expr(f"g div {segment}").alias("block"), (F.col("g") % segment).cast("int").alias("o"), F.lit(None).cast("int").alias("symbol"))
    both = light.select("c", "block", "o", "symbol").unionByName(firsts)
    own = F.array_sort(F.collect_list(F.when(F.col("symbol").isNotNull(), F.struct("o", "symbol"))))
    segments = both.groupBy("c", "block").agg(own.alias("own"), F.collect_list(F.when(F.col("symbol").isNull(), F.col("o"))).alias("firsts"))
    segments = segments.select("c", "block", F.get("own", F.lit(0))["o"].alias("o0"), F.array_join(F.transform("own", lambda x: F.char(x["symbol"] + 65)), "").alias("symbols"), "firsts")
    solved = cut(segments.mapInPandas(lambda b: _judged(b, segment), f"{_SEGMENT}, slots string, cost long, matrix array<long>"))
    edge = solved.filter("matrix is not null").drop("slots", "cost")
    chained = edge.repartition("c").sortWithinPartitions("c", F.desc("block")).mapInPandas(_chained, f"{_SEGMENT}, ends array<long>, last boolean")
    traced = chained.repartition("c", "block").mapInPandas(_traced, f"{_SEGMENT}, last boolean, slots array<string>, costs array<long>, finals array<int>")
    picked = traced.repartition("c").sortWithinPartitions("c", "block").mapInPandas(_picked, f"{_SEGMENT}, slots string, cost long")
    solved = cut(solved.filter("matrix is null").drop("matrix").unionByName(picked))

    pieces = F.array_sort(F.collect_list(F.struct("block", F.upper(F.replace("slots", F.lit("."), F.lit(""))).alias("audit"))))
    sums = [F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
    found = solved.groupBy("c").agg(*sums, F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"))
    turns = rows.groupBy("c", "turn").agg(F.first("conv").alias("conv")).groupBy("c").agg(F.first("conv").alias("conv"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("n"))
    wide = [F.col(x).cast("decimal(20,0)") for x in ("low", "high")]
    gaps = F.coalesce(F.least(wide[1] - wide[0] + 1 - F.col("n"), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long"), F.lit(0))
    report = turns.join(found, "c").select(F.col("conv").alias(conv_col), "c", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = solved.select("c", (F.col("block") * segment + F.col("o0")).alias("g"), F.length("symbols").alias("n"), F.posexplode(F.split("slots", "")).alias("at", "edit")).filter("edit not in ('.', '')")
    after = F.greatest(F.col("at") - 3 * F.col("n"), F.lit(0)) + F.when(F.col("at") >= 3 * F.col("n"), 3).otherwise(F.col("at") % 3)
    edits = edits.select("c", (F.col("g") + F.least(F.expr("at div 3"), F.col("n") - 1)).alias("g"), after.alias("sub"), "edit").filter("edit <> 'D'")
    new = F.when(F.col("edit").isin("I", "R"), "user").when(F.col("edit").isin("i", "r"), "assistant")
    kept = edits.filter("sub = 2").drop("c").join(rows.select("g", "c", "conv", "role", "text"), "g").select("c", "conv", "g", "sub", F.upper("edit").alias("edit"), F.coalesce(new, "role").alias("role"), "text")
    added = edits.filter("sub <> 2").join(rows.select("g", "conv"), "g").select("c", "conv", "g", "sub", F.upper("edit").alias("edit"), new.alias("role"), F.lit("").alias("text"))
    repaired = kept.unionByName(added).select("c", F.col("conv").alias(conv_col), F.col("g").alias("row"), "sub", "edit", "role", "text")
    return report, repaired


def repaired_hashes(repaired: DataFrame) -> DataFrame:
    """c, repaired_sha256: hash of a conversation's repaired rows as `role:text`, joined by newlines.

    A hash needs its lines one after another, so they stream through one task per conversation, a line at a time.
    """
    lines = repaired.select("c", "row", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("c").sortWithinPartitions("c", "row", "sub").mapInPandas(_hashes, "c string, repaired_sha256 string")
