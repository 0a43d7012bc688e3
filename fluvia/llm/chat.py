"""Transcript parsing by a hidden Markov model, and canonical chat rendering.

A transcript is plain text: lines, some with speaker markers of one of many styles, some turns without any. The states
are the roles, each as the first line of a turn or a later one; a line shows its marker, whether a blank line or the
transcript's start precedes it, its length and its last character. Viterbi finds the likeliest states, which give the
turns; those are rendered in one canonical form. The model's counts come from transcripts whose turns are known.

Conversations have any length: rows are sorted and numbered over the cluster, and a conversation's lines lie in segments
of bounded size. Viterbi runs over the whole conversation all the same: each segment first gives its best scores from
each state before it to each of its last states (a product in the max-plus algebra), those small matrices are chained by
conversation, and each segment then knows the states at both its ends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.session import materialize

ROLES = ("system", "user", "assistant", "tool")
#: A state is 2 * role + (0 on the first line of a turn, 1 on a later one).
STATES = 2 * len(ROLES)
WORDS = {"system": ("system", "instructions", "sys"), "user": ("user", "human", "customer", "q", "question", "prompter"), "assistant": ("assistant", "ai", "bot", "agent", "a", "answer", "model", "gpt"), "tool": ("tool", "function", "observation")}
_SPEAKER = {w: r for r, words in WORDS.items() for w in words}
_NAMES = "|".join(sorted(_SPEAKER, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:(?:\#{{1,4}}|[>*\-])?\s*\**\s*(?P<colon>{_NAMES})\s*(?:\(\d+\))?\s*\**\s*[:>：]\**|[\[<(]\s*\|?(?P<bracket>{_NAMES})\|?\s*[\])>]\s*:?|\#{{2,4}}\s*(?P<head>{_NAMES})\s*$)\s*", re.IGNORECASE)
STYLES = ("{}: ", "### {}:\n", "[{}] ", "**{}:** ", "<{}> ", "{} > ")
SEGMENT_TURNS = 4096
#: No state, before the first line of a conversation.
BEGIN = -1


def marker(line: str) -> tuple[int | None, str]:
    """(role that a speaker marker names, the rest of the line)."""
    found = MARKER.match(line)
    if not found:
        return None, line
    return ROLES.index(_SPEAKER[next(x for x in found.groups() if x).lower()]), line[found.end() :]


def observations(lines: list[str], first: bool = True) -> np.ndarray:
    """For each line: marker (0 none, else role + 1), gap (0 none, 1 blank line before, 2 start), length, ending.

    Not ``first`` are the lines of a later segment, which begins within a conversation.
    """
    out = np.zeros((len(lines), len(SIZES)), dtype=np.int64)
    gap = 2 if first else 1
    for i, line in enumerate(lines):
        role, rest = marker(line)
        text = rest.strip()
        out[i] = (0 if role is None else role + 1, gap, min(6, len(text).bit_length() // 2), 3 if not text else 1 if text[-1] == "?" else 2 if text[-1] in ".!:;" else 0)
        gap = 1 if not line.strip() else 0
    return out


SIZES = (len(ROLES) + 1, 3, 7, 4)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    shown: list[np.ndarray]

    def emit(self, seen: np.ndarray) -> np.ndarray:
        return sum(table[:, seen[:, i]].T for i, table in enumerate(self.shown))


def from_counts(counts: dict[tuple[str, int, int], int], smooth: float = 0.5) -> Model:
    """Log-probabilities from the counts of starts, moves and observations, each smoothed."""

    def table(name: str, rows: int, columns: int) -> np.ndarray:
        out = np.full((rows, columns), smooth)
        for (kind, a, b), n in counts.items():
            if kind == name:
                out[a, b] += n
        return np.log(out / out.sum(axis=1, keepdims=True))

    return Model(table("start", 1, STATES)[0], table("move", STATES, STATES), [table(f"show{i}", STATES, n) for i, n in enumerate(SIZES)])


def count(lines: list[str], states: list[int], first: bool = True) -> Counter:
    """Starts (not those of a later segment), moves and observations."""
    seen = observations(lines, first)
    out: Counter = Counter({("start", 0, states[0]): 1}) if states and first else Counter()
    out.update(("move", a, b) for a, b in zip(states, states[1:], strict=False))
    for i in range(len(SIZES)):
        out.update((f"show{i}", s, int(o)) for s, o in zip(states, seen[:, i], strict=True))
    return out


def entering(model: Model, before: int) -> np.ndarray:
    """Scores of each state after the given one."""
    return model.start if before == BEGIN else model.move[before]


def viterbi(model: Model, seen: np.ndarray, before: int = BEGIN, last: int | None = None) -> list[int]:
    """The likeliest states after ``before`` that end in ``last`` (any, if None); of equal ones the lowest, from the last line back."""
    if not len(seen):
        return []
    emit = model.emit(seen)
    best = entering(model, before) + emit[0]
    back = np.zeros((len(seen), STATES), dtype=np.int64)
    for i in range(1, len(seen)):
        paths = best[:, None] + model.move
        back[i] = paths.argmax(axis=0)
        best = paths.max(axis=0) + emit[i]
    states = [int(best.argmax()) if last is None else last]
    for i in range(len(seen) - 1, 0, -1):
        states.append(int(back[i][states[-1]]))
    return states[::-1]


def bridge(model: Model, seen: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """The best score from each state before the lines (one row, where they begin a conversation) to each last state, and the first state on that path."""
    emit = model.emit(seen)
    best = (model.start[None, :] if first else model.move) + emit[0]
    begun = np.broadcast_to(np.arange(STATES), best.shape)
    for line in emit[1:]:
        paths = best[:, :, None] + model.move[None]
        begun = np.take_along_axis(begun, paths.argmax(axis=1), axis=1)
        best = paths.max(axis=1) + line
    return best, begun


def ends_of(bridges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """The last and the first state of each segment on the likeliest path through all of a conversation's segments."""
    best = bridges[0][0][0]
    back = []
    for table, _ in bridges[1:]:
        paths = best[:, None] + table
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0)
    out = [int(best.argmax())]
    for choice in reversed(back):
        out.append(int(choice[out[-1]]))
    out.reverse()
    return out, [int(begun[0 if i == 0 else out[i - 1], out[i]]) for i, (_, begun) in enumerate(bridges)]


def lines_of(text: str, last: bool = True) -> list[str]:
    """The lines of a transcript; blank ones at its very end are left out if it is the last part."""
    lines = text.split("\n")
    while last and lines and not lines[-1].strip():
        lines.pop()
    return lines


def turns_of(lines: list[str], states: list[int], before: int = BEGIN, after: int | None = None) -> tuple[list[tuple[str, str]], bool, bool]:
    """The turns (role, text) of lines with states; whether the first goes on from the line before, and the last after them.

    A later-line state of another role than the line before starts a turn too, as does the first line.
    """
    turns: list[tuple[str, list[str]]] = []
    role = None if before == BEGIN else before // 2
    begins = False
    for line, state in zip(lines, states, strict=True):
        new = state % 2 == 0 or state // 2 != role
        if new or not turns:
            begins = begins or not turns and not new
            role = state // 2
            turns.append((ROLES[role], []))
        named, rest = marker(line)
        turns[-1][1].append(rest if named == role and new else line)
    goes_on = bool(turns) and after is not None and after % 2 == 1 and after // 2 == role
    texts = ["\n".join(part) for _, part in turns]
    out = []
    for i, (r, _) in enumerate(turns):
        text = texts[i]
        text = text if begins and i == 0 else text.lstrip()
        out.append((r, text if goes_on and i + 1 == len(turns) else text.rstrip()))
    return out, begins, goes_on


def parse(model: Model, text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a whole transcript; blank text has none."""
    states = viterbi(model, observations(text.split("\n")))
    lines = lines_of(text)
    return turns_of(lines, states[: len(lines)])[0]


def render(turns: list[tuple[str, str]], begins: bool = False, goes_on: bool = False) -> str:
    """Canonical turns; control words within a text are broken up, so that a turn cannot pose as another.

    A first turn that goes on from the segment before has no head (but the line break that parts the segments), a last
    one that goes on in the next has no end: the segments of a conversation, one behind another, read as a whole.
    """
    out = []
    for i, (r, t) in enumerate(turns):
        head = "\n" if begins and i == 0 else f"<|im_start|>{r}\n"
        end = "" if goes_on and i + 1 == len(turns) else "<|im_end|>\n"
        out.append(head + t.replace("<|im_", "<|​im_") + end)
    return "".join(out)


def transcribe(turns: list[tuple[str | None, str | None]], style: int, bare: list[bool]) -> tuple[list[str], list[int]]:
    """Lines and true states of turns as a transcript: a blank line after each turn, no marker where ``bare``.

    Roles that are not in ROLES are written without a marker, as users.
    """
    lines: list[str] = []
    states: list[int] = []
    for i, (role, text) in enumerate(turns):
        at = ROLES.index(role) if role in ROLES else 1
        words = WORDS[ROLES[at]]
        mark = "" if bare[i] or role not in ROLES else STYLES[style % len(STYLES)].format(words[style // len(STYLES) % len(words)].capitalize())
        part = [*(mark + (text or "")).split("\n"), ""]
        lines += part
        states += [2 * at] + [2 * at + 1] * (len(part) - 1)
    return lines, states


def conversations_to_lists(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """(conv, segment, seed, turns): each conversation's turns in order, ``segment_turns`` in each segment.

    Rows go by turn, role, text, nulls first; null conversation ids are one conversation. The sort deals out one long
    conversation, or one row repeated without end, over many tasks. Numbers run over its partitions: only conversations
    that span a border have an offset, at most two for each partition, so those are few enough to broadcast.
    """
    row = [F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")]
    ordered = conversations.select(*row, F.monotonically_increasing_id().alias("salt")).orderBy("conv", "turn", "role", "text", "salt").select("conv", "role", "text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, n = BEGIN, 0  # BEGIN is no conversation: lists hold each id
        for batch in batches:
            numbers = []
            for conv in batch.column(0).to_pylist():
                if held == [conv]:
                    n += 1
                else:
                    held, n = [conv], 0
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())], names=["conv", "role", "text", "part", "number"])

    schema = T.StructType([*ordered.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType())])
    numbered = materialize(ordered.mapInArrow(number, schema), "turns")
    parts = numbered.groupBy("conv", "part").agg((F.max("number") + 1).alias("n"))
    spanning = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts")).where(F.size("parts") > 1)
    before = F.transform("parts", lambda p: F.struct(p["part"].alias("part"), F.aggregate(F.filter("parts", lambda q: q["part"] < p["part"]), F.lit(0).cast("long"), lambda a, q: a + q["n"]).alias("off")))
    offsets = spanning.select(F.col("conv").alias("o_conv"), F.inline(before)).withColumnRenamed("part", "o_part")
    placed = numbered.join(F.broadcast(offsets), F.expr("conv <=> o_conv and part = o_part"), "left").withColumn("place", F.col("number") + F.coalesce("off", F.lit(0)))
    segment = F.expr(f"place div {segment_turns}").alias("segment")
    grouped = placed.groupBy("conv", segment).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    return grouped.select("conv", "segment", F.pmod(F.xxhash64("conv"), F.lit(1 << 30)).cast("long").alias("seed"), "turns")


def _bare(seed: int, n: int) -> list[bool]:
    """About every fourth turn has no marker; which ones depends on the seed alone."""
    return [bool((seed * 2654435761 + i * 40503) >> 7 & 3 == 0) for i in range(n)]


def _written(seed: int, segment: int, turns: list[dict]) -> tuple[list[str], list[int]]:
    return transcribe([(t["role"], t["text"]) for t in turns], seed, _bare(seed + segment, len(turns)))


def transcripts(listed: DataFrame) -> DataFrame:
    """(conv, segment, seed, transcript): conversations as transcripts of mixed styles, some turns without marker.

    The segments of a conversation, joined by line breaks, are its transcript. Null roles have no marker, null texts are
    empty; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(_written(seed, segment, turns)[0]) for segment, seed, turns in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["conv", "segment", "seed", "transcript"])

    schema = T.StructType([*(listed.schema[c] for c in ("conv", "segment", "seed")), T.StructField("transcript", T.StringType())])
    return listed.select("conv", "segment", "seed", "turns").mapInArrow(run, schema)


def train(listed: DataFrame) -> Model:
    """Counts over all known conversations but those held out (seed mod 4 is 2); tasks send sums, a few hundred rows in all.

    Without any conversation all states are equally likely.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for segment, seed, turns in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if turns:
                    found.update(count(*_written(seed, segment, turns), segment == 0))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))] + [pa.array(list(found.values()), pa.int64())], names=["kind", "a", "b", "n"])

    counted = listed.where("seed % 4 <> 2").select("segment", "seed", "turns").mapInArrow(run, "kind string, a int, b int, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return from_counts({(r["kind"], r["a"], r["b"]): r["n"] for r in counted.collect()})


def segment_ends(written: DataFrame, model: Model) -> DataFrame:
    """(e_conv, ends): of conversations of several segments, each segment's last and first state on the path through all.

    A segment's scores are two matrices of STATES x STATES numbers, so a conversation of 10^9 turns has some 10^5 of them.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [np.concatenate(bridge(model, observations(t.split("\n"), s == 0), s == 0)).ravel() for s, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tables, pa.list_(pa.float64()))], names=["conv", "segment", "scores"])

    kind = written.schema["conv"]
    long_ones = written.where("segment > 0").select(F.col("conv").alias("l_conv")).distinct()
    several = written.join(long_ones, F.expr("conv <=> l_conv"), "left_semi").select("conv", "segment", "transcript")
    scored = several.mapInArrow(score, T.StructType([kind, written.schema["segment"], T.StructField("scores", T.ArrayType(T.DoubleType()))]))
    chained = scored.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "scores"))), lambda x: x["scores"]).alias("tables"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for tables in batch.column(1).to_pylist():
                halves = [np.split(np.array(x).reshape(-1, STATES), 2) for x in tables]
                last, first = ends_of([(best, begun.astype(int)) for best, begun in halves])
                found.append([{"last": a, "first": b} for a, b in zip(last, first, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("last", pa.int32()), ("first", pa.int32())])))], names=["e_conv", "ends"])

    ends = T.ArrayType(T.StructType([T.StructField("last", T.IntegerType()), T.StructField("first", T.IntegerType())]))
    return chained.mapInArrow(chain, T.StructType([T.StructField("e_conv", kind.dataType), T.StructField("ends", ends)]))


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_TURNS_SPARK = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def parse_transcripts(df: DataFrame, model: Model, *, text_col: str = "transcript") -> DataFrame:
    """The other columns, turns (array of role and text) and ``rendered``, the canonical form; each row is a whole transcript.

    Null or blank transcripts have no turns and render empty. Input columns named like an output are replaced.
    """
    keep = [c for c in df.columns if c not in (text_col, "turns", "rendered")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(model, t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([[{"role": r, "text": t} for r, t in turns] for turns in found], _TURNS), pa.array([render(turns) for turns in found], pa.string())], names=[*keep, "turns", "rendered"])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("turns", _TURNS_SPARK), T.StructField("rendered", T.StringType())])
    return df.select(df[text_col].cast("string").alias("__text"), *keep).mapInArrow(run, schema)


def parse_segments(written: DataFrame, model: Model) -> DataFrame:
    """(conv, segment, begins, turns, rendered) of transcripts in segments, each parsed as a part of its whole conversation.

    ``begins``: the first turn goes on from the segment before; its text is in both rows' turns, a part in each, white
    space at its own ends kept where it spans segments.
    """
    joined = written.join(segment_ends(written, model), F.expr("conv <=> e_conv"), "left").select("conv", "segment", "transcript", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for segment, text, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                ends = ends or [{"last": None, "first": None}]
                final = segment + 1 == len(ends)
                before = BEGIN if segment == 0 else ends[segment - 1]["last"]
                lines = text.split("\n")
                states = viterbi(model, observations(lines, segment == 0), before, ends[segment]["last"])
                lines = lines_of(text, final) or lines * (segment > 0)
                rows.append(turns_of(lines, states[: len(lines)], before, None if final else ends[segment + 1]["first"]))
            turns = pa.array([[{"role": r, "text": t} for r, t in x[0]] for x in rows], _TURNS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x[1] for x in rows]), turns, pa.array([render(*x) for x in rows], pa.string())], names=["conv", "segment", "begins", "turns", "rendered"])

    schema = T.StructType([written.schema["conv"], written.schema["segment"], T.StructField("begins", T.BooleanType()), T.StructField("turns", _TURNS_SPARK), T.StructField("rendered", T.StringType())])
    return joined.mapInArrow(run, schema)


def format_conversations(conversations: DataFrame, **columns: str) -> DataFrame:
    """Writes every conversation as a plain transcript, recovers its turns from that alone, and renders them.

    Returns conv, segment, n_turns (that begin in the segment), roles (comma-joined, of those), rendered. A conversation
    of at most SEGMENT_TURNS rows is one segment; a longer one is parsed as a whole, but returned in segments of so many
    rows, whose rendered texts, one behind another, are the whole. Rows go by turn, role and text, nulls first; null roles
    and ones that are not in ROLES are written without a marker, and null texts as empty. Rows with a null conversation id
    form one conversation. Repeated rows are repeated turns; an empty table gives an empty result.
    """
    listed = materialize(conversations_to_lists(conversations, **columns), "conversations")
    parsed = parse_segments(transcripts(listed), train(listed))
    begun = F.expr("CASE WHEN begins THEN slice(turns, 2, size(turns)) ELSE turns END")
    return parsed.select("conv", "segment", F.size(begun).cast("long").alias("n_turns"), F.array_join(F.transform(begun, lambda t: t["role"]), ",").alias("roles"), "rendered")
