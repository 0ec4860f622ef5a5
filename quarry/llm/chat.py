"""op5, chat formatting: a hidden Markov model recovers the roles of a transcript's lines, and turns are rendered canonically.

States are (role, B or I): the first line of a turn, or a later one. A line shows its speaker marker (a known name before a colon or
bracket, or none), its length on a log scale, whether it has a question mark, and what is above it (nothing, a blank line or text).
Start, transition and emission probabilities are counted with DataFrame functions over all labelled conversations that are not held
out (crc32(conv_id as text) mod 3 is not 1), with add-one smoothing; the tables have as many rows as states times feature values. The Viterbi path of
each transcript gives role and turn of every line that is not blank; a marker is cut off, and the turns are rendered as

    <|role|>
    text
    <|end|>

one after the other, turns of one role in a row being kept apart where the path begins a new one.

Scale: conversations are cut between turns into parts of TURNS turn numbers, a row each; the shuffle is by (conv_id, part). The chain goes on across cuts:
where a conversation has several parts, each gives the best score from every first to every last state, one small matrix, and these are
chained by conversation; each part's path is then taken between the states that the best path of the whole conversation has at its ends. So roles and
turns don't depend on TURNS (but for paths of equal probability), and the parts of a conversation, one after the other, are one rendering: `continues` and `goes_on` say that a turn
is cut, which is rendered open. TURNS = 2048 is a parameter of the table's rows alone. Learning sorts the lines of a conversation for one window over neighbours, which spills.

Edge cases: a null text is an empty turn and gives no line; a transcript without lines renders to the empty string with no turns; a null role is not learned from;
very long texts are read whole, in the part of their turn; rows of null turns are all of the first part; turns that repeat a number follow each other in order of their texts; a null conv_id is one conversation, a null turn comes first; with
nothing to learn from, every line is of role `user` unless its marker says otherwise; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURNS = 2048
MARKERS = {"user": "user", "human": "user", "customer": "user", "q": "user", "assistant": "assistant", "bot": "assistant", "ai": "assistant", "a": "assistant", "system": "system"}
MARKER = re.compile(r"^[ \t]*[\[<#*]*\s*(" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r")\s*[\]>*]*\s*[:>\]]\s*", re.IGNORECASE | re.ASCII)
#: The same pattern for Spark's own functions.
MARKER_SQL = r"(?i)^[ \t]*[\[<#*]*\s*(" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r")\s*[\]>*]*\s*[:>\]]\s*"
LENGTHS, FLAGS, ABOVE = 14, 2, 3


@dataclass
class Model:
    roles: list[str]
    markers: list[str]
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: list[np.ndarray]  # per feature (states, values)

    def path(self, features: np.ndarray, first: int | None = None, last: int | None = None) -> np.ndarray:
        """The most probable states of lines (n, features), from state `first` and to state `last` where they are given. Ties: the first state."""
        score = sum(e[:, features[:, k]] for k, e in enumerate(self.emit)).T
        best = self.start + score[0]
        if first is not None:
            best = np.where(np.arange(len(best)) == first, score[0], -np.inf)
        back = np.zeros((len(score), len(best)), np.int64)
        for t in range(1, len(score)):
            via = best[:, None] + self.move
            back[t] = via.argmax(axis=0)
            best = via[back[t], np.arange(len(best))] + score[t]
        out = np.zeros(len(score), np.int64)
        out[-1] = best.argmax() if last is None else last
        for t in range(len(score) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def spans(self, features: np.ndarray) -> np.ndarray:
        """The best score of lines (n, features) from each first state (rows) to each last state, but for what is above the first line."""
        score = sum(e[:, features[:, k]] for k, e in enumerate(self.emit)).T
        best = np.full(self.move.shape, -np.inf)
        np.fill_diagonal(best, score[0] - self.emit[-1][:, features[0, -1]])
        for row in score[1:]:
            best = (best[:, :, None] + self.move).max(axis=1) + row
        return best

    def chain(self, parts: list[np.ndarray]) -> list[tuple[int, int]]:
        """The first and last state of each part on the best path through all of them, from the parts' spans."""
        best, back = None, []
        for spans in parts:
            enter = self.start if best is None else (best[:, None] + self.move).max(axis=0)
            via = None if best is None else (best[:, None] + self.move).argmax(axis=0)
            through = (enter + self.emit[-1][:, 0 if best is None else 1])[:, None] + spans
            back.append((via, through.argmax(axis=0)))
            best = through.max(axis=0)
        out, last = [], None if best is None else int(best.argmax())
        for via, first in reversed(back):
            out.append((int(first[last]), last))
            last = None if via is None else int(via[first[last]])
        return out[::-1]


def held_out(conv_id: Column) -> Column:
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _lines(conversations: DataFrame) -> DataFrame:
    """Non-blank lines of labelled turns: conv, turn, at, role, and their features."""
    turns = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("at", "line"), held_out(F.col("conv_id")).alias("held")).where("role is not null and not held")
    line = F.col("line")
    blank = F.trim(F.regexp_replace(line, r"[\t\r\x0b\f]", " ")) == ""
    order = Window.partitionBy("conv", "turn").orderBy("at")
    mark = F.lower(F.regexp_extract(line, MARKER_SQL, 1))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv]), mark)
    above = F.when(F.col("n") == 1, 1).when(F.col("at") - F.col("before") > 1, 1).otherwise(2)
    return (
        turns.where(~blank)
        .select("*", F.row_number().over(order).alias("n"), F.lag("at").over(order).alias("before"))
        .select("conv", "turn", "at", "role", "n", F.when(mark == "", "").otherwise(known).alias("marker"), F.least(F.floor(F.log2(F.length("line") + 1)), F.lit(LENGTHS - 1)).cast("int").alias("size"), F.contains(line, F.lit("?")).cast("int").alias("asks"), above.alias("above"))
    )


def fit(conversations: DataFrame) -> Model:
    lines = _lines(conversations).withColumn("state", F.concat("role", F.when(F.col("n") == 1, "/B").otherwise("/I")))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "at")
    moves = lines.select("state", "marker", "size", "asks", F.lag("state").over(order).alias("before"), F.when(F.lag("state").over(order).isNull(), 0).otherwise(F.col("above")).alias("above"))
    counted = moves.groupBy("before", "state", "marker", "size", "asks", "above").agg(F.count(F.lit(1)).alias("n")).collect()  # states and features bound it
    roles = sorted({r["state"][:-2] for r in counted} | {"user"})
    markers = ["", *sorted(set(MARKERS.values()))]
    n = 2 * len(roles)
    state = lambda s: 2 * roles.index(s[:-2]) + (s[-1] == "I")
    start, move = np.ones(n), np.ones((n, n))
    emit = [np.ones((n, len(markers))), np.ones((n, LENGTHS)), np.ones((n, FLAGS)), np.ones((n, ABOVE))]
    # a marker speaks for its role: that many lines, as it were, have been seen with it
    for i, role in enumerate(roles):
        if role in markers:
            emit[0][2 * i, markers.index(role)] += 0.05 * sum(r["n"] for r in counted) + 50
    for r in counted:
        s, k = state(r["state"]), r["n"]
        if r["before"] is None:
            start[s] += k
        else:
            move[state(r["before"]), s] += k
        for e, v in zip(emit, (markers.index(r["marker"] or ""), r["size"], r["asks"], r["above"]), strict=True):
            e[s, v] += k
    return Model(roles, markers, np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit])


def read(transcript: str, model: Model) -> tuple[list[str], np.ndarray]:
    """The lines that are not blank, without their markers, and their features."""
    rows, features, gap, first = [], [], False, True
    for line in transcript.split("\n"):
        if not line.strip(" \t\r\x0b\f"):
            gap = True
            continue
        m = MARKER.match(line)
        marker = MARKERS[m[1].lower()] if m else ""
        features.append((model.markers.index(marker), min(int(np.log2(len(line) + 1)), LENGTHS - 1), int("?" in line), 0 if first else 1 if gap else 2))
        rows.append(line[m.end() :] if m else line)
        gap = first = False
    return rows, np.array(features)


def parse(transcript: str, model: Model, first: int | None = None, last: int | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn; `first` and `last` as in Model.path."""
    rows, features = read(transcript, model)
    if not rows:
        return []
    out: list[tuple[str, list[str]]] = []
    for s, line in zip(model.path(features, first, last).tolist(), rows, strict=True):
        role = model.roles[s // 2]
        if not out or s % 2 == 0 or out[-1][0] != role:
            out.append((role, []))
        out[-1][1].append(line)
    return [(role, "\n".join(lines)) for role, lines in out]


def render(turns: list[tuple[str, str]], continues: bool = False, goes_on: bool = False) -> str:
    """The turns as text. A part whose first turn is the rest of the one before begins with that text alone, and one whose last turn goes on leaves it open, so
    that the parts of a conversation, one after the other, are its whole rendering."""
    out = "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)
    if continues:
        out = out[len(f"<|{turns[0][0]}|>") :]
    return out.removesuffix("\n<|end|>\n") if goes_on else out


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, part, transcript (turns in order, a blank line between), and true_roles of the turns, with no text lost."""
    turn = F.col("turn").cast("long")
    rows = conversations.select("conv_id", F.coalesce(F.floor(turn / TURNS), F.lit(0)).cast("long").alias("part"), F.struct(turn.alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role")).alias("t"))
    grouped = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    spoken = F.filter("ts", lambda t: F.length(F.trim(F.regexp_replace(t["text"], r"[\t\r\n\x0b\f]", " "))) > 0)
    return grouped.select("conv_id", "part", F.array_join(F.transform("ts", lambda t: t["text"]), "\n\n").alias("transcript"), F.transform(spoken, lambda t: t["role"]).alias("true_roles"))


def part_ends(found: DataFrame, model: Model) -> DataFrame:
    """conv_id, part, first, last, continues, goes_on: the states at the ends of each part that has lines, on the best path of its whole conversation, and whether
    its first turn began in the part before, and its last one ends in the next."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    key = found.schema["conv_id"].dataType.simpleString()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("transcript").to_pylist():
                rows, features = read(text or "", shared.value)
                out.append(shared.value.spans(features).ravel().tolist() if rows else None)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(out, pa.list_(pa.float64()))], names=["conv_id", "part", "spans"])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        n = len(shared.value.start)
        ends = shared.value.chain([np.array(x).reshape(n, n) for x in table.column("spans").to_pylist()])
        continues = [i > 0 and a % 2 == 1 and a // 2 == ends[i - 1][1] // 2 for i, (a, _) in enumerate(ends)]
        goes_on = [*continues[1:], False][: len(ends)]
        columns = [pa.array([a for a, _ in ends], pa.int32()), pa.array([b for _, b in ends], pa.int32()), pa.array(continues, pa.bool_()), pa.array(goes_on, pa.bool_())]
        return pa.Table.from_arrays([table.column("conv_id"), table.column("part"), *columns], names=["conv_id", "part", "first", "last", "continues", "goes_on"])

    scored = found.mapInArrow(spans, f"conv_id {key}, part long, spans array<double>").where("spans is not null")
    return scored.groupBy("conv_id").applyInArrow(chain, f"conv_id {key}, part long, first int, last int, continues boolean, goes_on boolean")


def format_transcripts(found: DataFrame, model: Model) -> DataFrame:
    """From (conv_id, part, transcript, true_roles): n_turns (that begin here), roles, turns, rendered, rendered_sha256, whether the roles are those the table has,
    whether the first turn continues the last one of the part before, and whether the last goes on in the next. Parts are chained by conversation where one has
    several; a conversation's rendering is that of its parts, one after the other, whatever TURNS is."""
    several = found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_parts")).where("_parts > 1").select(F.col("conv_id").alias("_conv"))
    if several.isEmpty():
        found = found.withColumns({"first": F.lit(None).cast("int"), "last": F.lit(None).cast("int"), "continues": F.lit(False), "goes_on": F.lit(False)})
    else:
        ends = part_ends(found.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi"), model).select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "first", "last", "continues", "goes_on")
        found = found.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left").drop("_conv", "_part")
        found = found.fillna(False, ["continues", "goes_on"])
    shared = found.sparkSession.sparkContext.broadcast(model)
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, firsts, lasts, ons, opens, true = (batch.column(c).to_pylist() for c in ("transcript", "first", "last", "continues", "goes_on", "true_roles"))
            parsed = [parse(t or "", shared.value, first, last) for t, first, last in zip(texts, firsts, lasts, strict=True)]
            roles = [",".join(r for r, _ in x) for x in parsed]
            text = [render(x, *ends) for x, *ends in zip(parsed, ons, opens, strict=True)]
            columns = {
                "conv_id": batch.column("conv_id"),
                "part": batch.column("part"),
                "n_turns": pa.array([len(x) - on for x, on in zip(parsed, ons, strict=True)], pa.int64()),
                "roles": pa.array(roles, pa.string()),
                "turns": pa.array([[{"role": r, "text": t} for r, t in x] for x in parsed], pa.list_(turn)),
                "rendered": pa.array(text, pa.string()),
                "rendered_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text], pa.string()),
                "roles_match": pa.array([r == ",".join(t or []) for r, t in zip(roles, true, strict=True)], pa.bool_()),
                "continues": batch.column("continues"),
                "goes_on": batch.column("goes_on"),
            }
            yield pa.RecordBatch.from_pydict(columns)

    key = found.schema["conv_id"].dataType.simpleString()
    return found.mapInArrow(rows, f"conv_id {key}, part long, n_turns long, roles string, turns array<struct<role:string,text:string>>, rendered string, rendered_sha256 string, roles_match boolean, continues boolean, goes_on boolean")


def format_chats(conversations: DataFrame) -> DataFrame:
    found = format_transcripts(transcripts(conversations), fit(conversations))
    return found.withColumn("held_out", held_out(F.col("conv_id")))
