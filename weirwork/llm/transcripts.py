"""Chat transcripts: roles recovered by a hidden Markov model, then canonical rendering.

A transcript is a sequence of lines. Each line begins or continues a turn of a role; those six
states emit what is seen of the line: the kind of speaker marker at its head, whether a blank line
stands before it, its length class, and whether it ends with a question mark. Transition and
emission counts come from labelled transcripts (TRAIN_CONVERSATIONS of at most TRAIN_BYTES, none of
them held out); Viterbi decoding gives the most
likely states, consecutive lines of one turn are joined without their marker, and turns are
rendered in one fixed form.

Rows of a transcript are streamed in order; decoding passes lines on as soon as all surviving
paths agree on them, so what is held does not grow with the transcript where markers occur.

Defined cases: null lines, empty ones and those of white space only count as blank lines; each
stays an empty line within a turn, and those at the ends of a turn go. A null conversation id is a
conversation of its own. Ties between paths go to the earlier state in STATES. Repeated rows are
lines of their own, in any order among themselves. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_CONVERSATIONS = 2000
TRAIN_BYTES = 16 << 20
ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in ROLES for b in (True, False)]  # (role, begins a turn)
#: Speaker words and the role that they name.
SPEAKERS = {
    "system": "system", "sys": "system", "instructions": "system", "user": "user", "human": "user", "me": "user", "q": "user", "question": "user", "customer": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "answer": "assistant", "agent": "assistant",
}
MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|[\[<(]\|?)?(" + "|".join(sorted(SPEAKERS, key=len, reverse=True)) + r")(?:\*\*)?\s*(?:\|?[\]>)]:?|:(?:\*\*)?|\s-)\s*", re.IGNORECASE)
KINDS = ("none", *ROLES)
LENGTHS = (40, 120, 400, 1200)
N_LENGTH = len(LENGTHS) + 1
FLUSH_LINES = 256


def observe(line: str, blank_before: bool) -> tuple[int, int, str]:
    """Marker kind and line class, and the line without its marker."""
    m = MARKER.match(line)
    kind = KINDS.index(SPEAKERS[m.group(1).lower()]) if m else 0
    rest = line[m.end() :] if m else line
    size = int(np.searchsorted(LENGTHS, len(rest)))
    return kind, (size * 2 + rest.rstrip().endswith("?")) * 2 + blank_before, rest


@dataclass
class Model:
    start: np.ndarray
    trans: np.ndarray
    kind: np.ndarray
    shape: np.ndarray


def fit(conversations: Iterable[list[tuple[str, bool, str, bool]]]) -> Model:
    """From lines with known states: (role, begins, line, blank before)."""
    n = len(STATES)
    start, trans = np.ones(n), np.full((n, n), 0.1)
    kind, shape = np.full((n, len(KINDS)), 0.01), np.full((n, N_LENGTH * 4), 0.5)  # a marker is rarely another role's
    for s, (role, begins) in enumerate(STATES):
        kind[s, KINDS.index(role) if begins else 0] += 1
    for lines in conversations:
        last = None
        for role, begins, line, blank in lines:
            s = STATES.index((role, begins))
            k, f, _ = observe(line, blank)
            kind[s, k] += 1
            shape[s, f] += 1
            if last is None:
                start[s] += 1
            else:
                trans[last, s] += 1
            last = s
    for s, (role, begins) in enumerate(STATES):
        if not begins:
            start[s] = 1e-9
            for t, (other, _) in enumerate(STATES):
                if other != role:
                    trans[t, s] = 1e-9  # a turn goes on only where it has begun
    logs = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Model(logs(start), logs(trans), logs(kind), logs(shape))


class Decoder:
    """Viterbi over a stream of lines of one transcript; gives each line's state once it is settled."""

    def __init__(self, model: Model):
        self.model, self.score, self.back, self.held = model, None, [], []

    def push(self, kind: int, shape: int, payload) -> list[tuple[int, object]]:
        emit = self.model.kind[:, kind] + self.model.shape[:, shape]
        if self.score is None:
            self.score = self.model.start + emit
            self.back.append(None)
        else:
            paths = self.score[:, None] + self.model.trans
            best = paths.argmax(axis=0)
            self.score = paths[best, np.arange(len(STATES))] + emit
            self.back.append(best)
        self.held.append(payload)
        return self._settled() if len(self.held) % FLUSH_LINES == 0 else []

    def _settled(self) -> list[tuple[int, object]]:
        """Lines on which all surviving paths agree."""
        here = np.arange(len(STATES))
        agreed = 0
        for i in range(len(self.back) - 1, 0, -1):
            here = self.back[i][here]
            if (here == here[0]).all():
                agreed = i
                break
        if not agreed:
            return []
        states = self._trace(agreed - 1, int(here[0]))
        out = list(zip(states, self.held[:agreed], strict=True))
        self.back, self.held = self.back[agreed:], self.held[agreed:]
        return out

    def _trace(self, last: int, state: int) -> list[int]:
        states = [state]
        for i in range(last, 0, -1):
            state = int(self.back[i][state])
            states.append(state)
        return states[::-1]

    def finish(self) -> list[tuple[int, object]]:
        if not self.held:
            return []
        out = list(zip(self._trace(len(self.back) - 1, int(self.score.argmax())), self.held, strict=True))
        self.score, self.back, self.held = None, [], []
        return out


def turns_of(states: Iterable[tuple[int, str]], open_turn: list | None = None) -> Iterator[list]:
    """[role, lines] of each turn; the last one is given too."""
    for state, line in states:
        role, begins = STATES[state]
        if open_turn is None or begins or open_turn[0] != role:
            if open_turn is not None:
                yield open_turn
            open_turn = [role, [line]]
        else:
            open_turn[1].append(line)
    if open_turn is not None:
        yield open_turn


def canonical(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def parse_transcripts(lines: DataFrame, model: Model, id_col: str = "conv_id", order_col: str = "line_no", line_col: str = "line") -> DataFrame:
    """conv_id, turn (from 0), role, text and the canonical form of every turn recovered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        decoder, now, blanks, turn, open_turn = Decoder(model), (), 0, 0, None

        def take(settled: list, last: bool) -> None:
            nonlocal open_turn, turn
            done = list(turns_of(settled, open_turn))
            open_turn = None if last or not done else done.pop()
            for role, text in done:
                text = "\n".join(text).strip("\n")
                out.append((now[0], turn, role, text, canonical(role, text)))
                turn += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], ["conv_id", "turn", "role", "text", "canonical"])

        for b in batches:
            for conv, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist(), strict=True):
                if now != (conv,):
                    if now:
                        take(decoder.finish(), True)
                    now, blanks, turn, open_turn = (conv,), 0, 0, None
                if not line or not line.strip():
                    blanks += 1
                    continue
                kind, shape, rest = observe(line, blanks > 0)
                settled = decoder.push(kind, shape, "\n" * blanks + rest)  # where a turn begins they are stripped
                blanks = 0
                if settled:
                    take(settled, False)
            yield batch()
        if now:
            take(decoder.finish(), True)
            yield batch()

    narrow = lines.select(lines[id_col].cast("long").alias("conv_id"), lines[order_col].alias("line_no"), lines[line_col].alias("line"))
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "line_no").select("conv_id", "line")
    return ordered.mapInArrow(run, "conv_id long, turn int, role string, text string, canonical string")


#: How a transcript may mark its speakers: (system, user, assistant) heads; the last marks no answers.
STYLES = (("System: ", "User: ", "Assistant: "), ("[system] ", "[user] ", "[assistant] "), ("### Instructions:\n", "### Human:\n", "### AI:\n"), ("SYSTEM - ", "Q: ", "A: "), ("System: ", "Human: ", "\n"))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, line_no (struct), line, role and begins: each conversation written in a style chosen by its id."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    head = F.lit("")
    for k, heads in enumerate(STYLES):
        for role, text in zip(ROLES, heads, strict=True):
            head = F.when((style == k) & (F.col("role") == role), F.lit(text)).otherwise(head)
    texts = conversations.select("conv_id", "turn", "role", F.concat(head, F.coalesce("text", F.lit(""))).alias("raw"))
    lines = texts.select("conv_id", "turn", "role", F.posexplode(F.split("raw", "\n")).alias("pos", "line"))
    return lines.select("conv_id", F.struct("turn", "pos").alias("line_no"), "line", "role")


def held_out(conv: Column) -> Column:
    """Conversations that `train` leaves out: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(lines: DataFrame, limit: int = TRAIN_CONVERSATIONS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most `limit` conversations that are not held out (those with the smallest hash of their
    id), as many as have at most `most_bytes` of text together."""
    known = lines.filter(F.col("conv_id").isNotNull() & ~held_out(F.col("conv_id")) & F.col("role").isin(*ROLES))
    sizes = known.groupBy("conv_id").agg(F.sum(F.octet_length(F.coalesce("line", F.lit(""))) + 1).alias("size")).orderBy(F.xxhash64("conv_id"), "conv_id").limit(limit)
    taken, size = [], 0
    for r in sizes.collect():
        if size + r["size"] <= most_bytes:  # one that is too long leaves room for the others
            size += r["size"]
            taken.append((r["conv_id"],))
    chosen = lines.sparkSession.createDataFrame(taken, "conv_id long")
    rows = known.join(F.broadcast(chosen), "conv_id").select("conv_id", "line_no", "line", "role").orderBy("conv_id", "line_no").collect()  # at most most_bytes
    found: list[list] = []
    last = turn = None
    begins = blank = False
    for r in rows:
        if r["conv_id"] != last:
            found.append([])
            last, turn, blank = r["conv_id"], None, False
        if r["line_no"]["turn"] != turn:
            turn, begins = r["line_no"]["turn"], True
        if not (r["line"] or "").strip():
            blank = True
            continue
        found[-1].append((r["role"], begins, r["line"], blank))
        begins = blank = False
    return fit(found)
