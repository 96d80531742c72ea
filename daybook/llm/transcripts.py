"""Operator 9: roles of transcript lines by a hidden Markov model, and canonical turns.

A transcript is a table of lines in order. A hidden state is a role and whether the line begins a turn. Each line shows a
speaker marker (or none, or one of an unknown speaker) and features: a blank line before it, a question at its end, its
length. Viterbi decoding gives the most likely states, and with them turns, which are rendered in one form.

Lines lie in order in the partitions of a range sort, which may cut a transcript anywhere. A stretch of lines acts on
scores as a matrix (max, plus), and matrices of stretches can be combined in order: the first pass sends one matrix for each
transcript that a partition's edge cuts, the driver combines these (two for each partition at most) and finds the states at
the cuts, and the second pass decodes every stretch between known ends. Turns are numbered in the same way: within a
stretch, then by what the stretches before it hold. So no transcript has to fit one task, and a partition has about
`LINES_A_PART` lines whatever the input's size.

Cases: null and empty texts are lines without letters; a null conversation id is a conversation of its own; lines that tie
in their order are put by text; repeated rows are repeated lines; lines of any length are taken whole; an empty table gives
an empty one; other columns are left out, so that their names can't clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import discard, written

ROLES = ("system", "user", "assistant")
#: States: 2 * role + (0: first line of a turn, 1: a later one).
STATES = 2 * len(ROLES)

# Speakers by the words that name them.
SPEAKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "client", "q", "question", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "a", "answer", "gpt", "chatbot", "support"),
}
NAMES = {name: role for role, names in SPEAKERS.items() for name in names}
MARKER = re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*|\[|\*\*|#{1,4}\s*|>\s*)?(?P<name>[^\W\d_][\w .'-]{0,30}?)\s*(?:\|>|\]\s*:?|(?::\s*\*\*)|(?:\*\*\s*:?)|:)\s*", re.UNICODE)
BARE = re.compile(r"^\s*(?:<\|im_start\|>\s*|#{1,4}\s+)(?P<name>\w+)\s*:?\s*$")
CLOSING = re.compile(r"\s*<\|(?:im_end|end|endoftext|eot_id)\|>\s*$")
NONE, UNKNOWN = 0, len(ROLES) + 1
#: Lines that a partition has at about; more partitions are made for more lines.
LINES_A_PART = 100_000


def read_marker(line: str) -> tuple[int, str]:
    """0 without a marker, 1 + role, or UNKNOWN for a speaker of another name; and the line without it."""
    for pattern in (BARE, MARKER):
        if m := pattern.match(line):
            name = m["name"].strip().lower()
            if name in NAMES:
                return 1 + ROLES.index(NAMES[name]), line[m.end() :]
            if pattern is MARKER and len(name.split()) <= 2 and line[m.start("name")].isupper() and line.lstrip()[0] not in "#>*":
                return UNKNOWN, line[m.end() :]
    return NONE, line


@dataclass(frozen=True)
class Hmm:
    """Log probabilities of starts, of steps between states, and of what lines show in each state."""

    start: np.ndarray
    step: np.ndarray
    marker: np.ndarray
    blank: np.ndarray
    question: np.ndarray
    short: np.ndarray

    @staticmethod
    def usual() -> Hmm:
        """Probabilities of a plain conversation."""
        start = np.full(STATES, 1e-6)
        start[[0, 2, 4]] = (0.3, 0.6, 0.1)
        turn = {0: (0.05, 0.8, 0.15), 1: (0.02, 0.08, 0.9), 2: (0.02, 0.9, 0.08)}
        step = np.full((STATES, STATES), 1e-6)
        for role in range(3):
            for s in (2 * role, 2 * role + 1):
                step[s, 2 * role + 1] = 0.7
                for after, p in enumerate(turn[role]):
                    step[s, 2 * after] = 0.3 * p
        marker = np.full((STATES, len(ROLES) + 2), 1e-4)
        for role in range(3):
            marker[2 * role, 0] = 0.1
            marker[2 * role, 1 + role] = 0.85
            marker[2 * role, UNKNOWN] = 0.04
            marker[2 * role + 1, 0] = 0.985
            marker[2 * role + 1, UNKNOWN] = 0.01
        blank = np.array([[0.2, 0.8] if s % 2 == 0 else [0.97, 0.03] for s in range(STATES)])
        question = np.array([[0.9, 0.1], [0.95, 0.05], [0.6, 0.4], [0.75, 0.25], [0.93, 0.07], [0.93, 0.07]])
        short = np.array([[0.6, 0.4], [0.6, 0.4], [0.5, 0.5], [0.6, 0.4], [0.65, 0.35], [0.7, 0.3]])
        return Hmm(*(np.log(x / x.sum(-1, keepdims=True)) for x in (start, step, marker, blank, question, short)))

    def shown(self, markers: np.ndarray, blanks: np.ndarray, lines: list[str]) -> np.ndarray:
        question = np.array([x.rstrip().endswith("?") for x in lines], np.int64)
        short = np.array([len(x) < 60 for x in lines], np.int64)
        return (self.marker[:, markers] + self.blank[:, blanks] + self.question[:, question] + self.short[:, short]).T


@dataclass
class Stretch:
    """Lines of one conversation that lie in one partition."""

    conv: object
    texts: list[str]
    order: list[tuple]
    marks: list[int] = field(default_factory=list)

    def scores(self, hmm: Hmm, blank_before: bool) -> np.ndarray:
        read = [read_marker(x) for x in self.texts]
        blanks = [blank_before, *(not x.strip() for x in self.texts[:-1])]
        return hmm.shown(np.array([m for m, _ in read]), np.array(blanks, np.int64), [x for _, x in read])


def matrix(hmm: Hmm, shown: np.ndarray) -> np.ndarray:
    """What a stretch adds from the state before it to the state of its last line."""
    out = hmm.step + shown[0][None, :]
    for row in shown[1:]:
        out = (out[:, :, None] + hmm.step[None, :, :]).max(axis=1) + row[None, :]
    return out


def viterbi(hmm: Hmm, shown: np.ndarray, before: int | None, last: int | None) -> list[int]:
    """The best states of a stretch, given the state before it (None: it begins here) and that of its last line, if known."""
    score = (hmm.start if before is None else hmm.step[before]) + shown[0]
    back = np.zeros((len(shown), STATES), np.int8)
    for t in range(1, len(shown)):
        ways = score[:, None] + hmm.step
        back[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + shown[t]
    state = int(score.argmax()) if last is None else last
    out = [state]
    for t in range(len(shown) - 1, 0, -1):
        state = int(back[t][state])
        out.append(state)
    return out[::-1]


def _stretches(part: pd.DataFrame) -> list[Stretch]:
    part = part.sort_values("position")
    out: list[Stretch] = []
    for conv, text, turn, line in zip(part["conv"], part["text"], part["turn"], part["line"], strict=True):
        key = None if pd.isna(conv) else conv
        if not out or out[-1].conv != key:
            out.append(Stretch(key, [], []))
        out[-1].texts.append(text or "")
        out[-1].order.append((turn, line))
    return out


def parse_transcripts(lines: DataFrame, conv: str = "conv_id", order: tuple[str, str] = ("turn", "line"), text: str = "text", hmm: Hmm | None = None) -> DataFrame:
    """conv_id, position, turn and line (as given), role, first (begins a turn), turn_no (from 0 in the conversation), content
    (the line without its marker)."""
    hmm = hmm or Hmm.usual()
    spark = lines.sparkSession
    rows = lines.select(F.col(f"`{conv}`").alias("conv"), *(F.col(f"`{c}`").cast("long").alias(n) for c, n in zip(order, ("turn", "line"), strict=True)), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["conv"].dataType.simpleString()
    keys = ["conv", "turn", "line", F.xxhash64("text")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // LINES_A_PART))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions("conv", "turn", "line", "text")
    placed = written(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("position")), "transcript-lines")

    def edges(part: pd.DataFrame) -> pd.DataFrame:
        found = _stretches(part)
        first, last = found[0], found[-1]
        out = [{"part": int(part["part"].iloc[0]), "edge": 0, "whole": len(found) == 1, "conv": first.conv, "blank": not first.texts[-1].strip(), "head": first.texts[0]}]
        out.append({**out[0], "edge": 1, "conv": last.conv, "blank": not last.texts[-1].strip(), "head": last.texts[0]})
        for row, stretch in zip(out, (first, last), strict=True):
            for b in (0, 1):
                row[f"m{b}"] = matrix(hmm, stretch.scores(hmm, bool(b))).reshape(-1).tolist()
            row["b0"] = (hmm.start + stretch.scores(hmm, True)[0]).tolist()
            row["n"] = len(stretch.texts)
            row["rest"] = begin(stretch).tolist()
        return pd.DataFrame(out)[["part", "edge", "whole", "conv", "blank", "m0", "m1", "rest"]]

    def begin(stretch: Stretch) -> np.ndarray:
        """Scores of the last line's states if the conversation begins with this stretch."""
        shown = stretch.scores(hmm, True)
        score = hmm.start + shown[0]
        for row in shown[1:]:
            score = (score[:, None] + hmm.step).max(axis=0) + row
        return score

    found = placed.groupBy("part").applyInPandas(edges, f"part int, edge int, whole boolean, conv {kind}, blank boolean, m0 array<double>, m1 array<double>, rest array<double>").collect()
    cuts = _cuts(sorted(found, key=lambda r: (r.part, r.edge)))
    shared = spark.sparkContext.broadcast(cuts)

    def decode(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        stretches = _stretches(part)
        number = int(part["part"].iloc[0])
        given = shared.value.get(number, {})
        for k, s in enumerate(stretches):
            before, blank, last = None, True, None
            if k == 0:
                before, blank = given.get("before", (None, True))
            if k == len(stretches) - 1:
                last = given.get("last")
            states = viterbi(hmm, s.scores(hmm, blank), before, last)
            begun = -1
            edge = 0 if before is not None else 2 if k < len(stretches) - 1 else 1  # goes on from the part before, may go on, neither
            for (turn, line), text, state in zip(s.order, s.texts, states, strict=True):
                begun += state % 2 == 0
                out.append((s.conv, turn, line, ROLES[state // 2], state % 2 == 0, begun, number, edge, CLOSING.sub("", read_marker(text)[1])))
        frame = pd.DataFrame(out, columns=["conv_id", "turn", "line", "role", "first", "begun", "part", "edge", "content"])
        frame["position"] = np.sort(part["position"].to_numpy())
        return frame[["conv_id", "position", "turn", "line", "role", "first", "begun", "part", "edge", "content"]]

    decoded = written(placed.groupBy("part").applyInPandas(decode, f"conv_id {kind}, position long, turn long, line long, role string, first boolean, begun long, part int, edge int, content string"), "transcript-states")
    discard(placed)
    # two rows at most for each partition: how many turns begin in the stretch that goes on from the part before, and in the last
    held = decoded.where("edge < 2").groupBy("part", "edge").agg(F.sum(F.col("first").cast("long")).alias("n")).collect()
    heads = spark.createDataFrame(_heads({(r.part, r.edge): r.n for r in held}), "part int, edge int, head long")
    numbered = decoded.join(F.broadcast(heads), ["part", "edge"], "left").withColumn("turn_no", F.col("begun") + F.coalesce("head", F.lit(0)))
    return numbered.select("conv_id", "position", "turn", "line", "role", "first", "turn_no", "content")


def _heads(held: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """(part, 0, turns before it in the same conversation) for parts whose first lines go on from the part before."""
    out, total = [], 0
    for part in sorted({p for p, _ in held}):
        if (part, 0) in held:
            out.append((part, 0, total))
            total += held[(part, 0)]
        if (part, 1) in held:
            total = held[(part, 1)]
    return out


def _cuts(rows: list) -> dict[int, dict]:
    """States on both sides of each partition's edge that cuts a conversation."""
    out: dict[int, dict] = {}
    parts: dict[int, list] = {}
    for r in rows:
        parts.setdefault(r.part, []).append(r)
    order = sorted(parts)
    i = 0
    while i < len(order):
        chain = [order[i]]  # partitions that one conversation runs through
        for after in order[i + 1 :]:
            if parts[chain[-1]][1].conv != parts[after][0].conv or (len(chain) > 1 and not parts[chain[-1]][0].whole):
                break
            chain.append(after)
        if len(chain) > 1:
            score = np.array(parts[chain[0]][1].rest)
            blank, backs, steps = parts[chain[0]][1].blank, [], []
            for p in chain[1:]:
                r = parts[p][0]
                ways = score[:, None] + np.array(r.m1 if blank else r.m0).reshape(STATES, STATES)
                backs.append(ways.argmax(axis=0))
                steps.append(blank)
                score, blank = ways.max(axis=0), r.blank
            state = int(score.argmax())
            for p, back, was in zip(chain[:0:-1], backs[::-1], steps[::-1], strict=True):
                if parts[p][0].whole:
                    out.setdefault(p, {})["last"] = state
                state = int(back[state])
                out.setdefault(p, {})["before"] = (state, was)
            out.setdefault(chain[0], {})["last"] = state
            i += len(chain) - 1 if not parts[chain[-1]][0].whole else len(chain)
        else:
            i += 1
    return out


def turns(parsed: DataFrame) -> DataFrame:
    """conv_id, turn_no (from 0), role, n_lines and content of each turn of parsed lines."""
    grouped = parsed.groupBy("conv_id", "turn_no").agg(F.min_by("role", "position").alias("role"), F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("position", "content"))).alias("parts"))
    return grouped.select("conv_id", "turn_no", "role", "n_lines", F.trim(F.array_join(F.transform("parts", lambda p: p["content"]), "\n")).alias("content"))


def render(parsed_turns: DataFrame, form: str = "<|{role}|>\n{content}\n<|end|>") -> DataFrame:
    """conv_id, turn_no, role and the turn's canonical text."""
    a, rest = form.split("{role}")
    b, c = rest.split("{content}")
    return parsed_turns.withColumn("rendered", F.concat(F.lit(a), "role", F.lit(b), "content", F.lit(c)))


def as_transcript(conversations: DataFrame) -> DataFrame:
    """Lines of plain transcripts from a table of turns, as people write them down: the form of the markers varies by
    conversation, an eighth of the turns after the first has a blank line instead, and half of the forms end turns with one."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    name = lambda s, u, a: F.when(F.col("role") == "system", s).when(F.col("role") == "assistant", a).otherwise(u)
    markers = [
        F.concat(name("System", "User", "Assistant"), F.lit(": ")),
        F.concat(name("System", "Human", "AI"), F.lit(": ")),
        F.concat(F.lit("["), name("system", "user", "assistant"), F.lit("] ")),
        F.concat(F.lit("**"), name("System", "Customer", "Agent"), F.lit("**: ")),
        F.concat(F.lit("<|"), name("system", "user", "assistant"), F.lit("|>")),
        F.concat(name("Context", "Q", "A"), F.lit(": ")),
    ]
    marker = F.coalesce(*(F.when(style == k, m) for k, m in enumerate(markers)), markers[0])
    dropped = (F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0)
    parted = style % 2 == 0
    body = F.concat(F.when(dropped, "\n").otherwise(marker), F.coalesce("text", F.lit("")), F.when(parted, "\n").otherwise(""))
    return conversations.select("conv_id", F.col("role").alias("true_role"), "turn", F.posexplode(F.split(body, "\n", -1)).alias("line", "text"))
