"""Chat transcripts: roles recovered by a hidden Markov model, turns rendered in one form.

A transcript is lines of text.  The hidden states are a role and whether a line begins a turn or goes on with it;
the observations of a line are its speaker marker, its length, how it ends and whether a blank line is before it.
Probabilities are counted over conversations whose roles are known, Viterbi finds the most probable states, and turns are
rendered without their markers as ``<|role|>`` blocks.

``transcribe`` writes conversations as such transcripts, in styles and with markers left out as the MD5 of their ids and of a
word says, for training and for tests.  What a model learns from and what the registered query scores are different transcripts: each
conversation is written anew, in another style and with other markers left out.

A marker is taken away only where Viterbi says that a turn begins; a line that goes on with a turn stays as it is, and so do blank lines
within a turn.

Defined cases: null turns sort first and equal ones by role and text; null texts are empty; null or unknown roles count as
user; a conversation without a line that isn't blank gives no turns and an empty rendering; null conv_ids are one
conversation; repeated rows are repeated turns; extra columns are ignored; empty tables give none; transcripts of many lines
are decoded whole, in slices of bounded text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm import vec

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in range(3) for begins in (1, 0)]
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("System: ", "Human: ", "AI: "),
    ("### System:\n", "### Instruction:\n", "### Response:\n"),
    ("<|system|>", "<|user|>", "<|assistant|>"),
    ("[System] ", "[User] ", "[Bot] "),
    ("**System**: ", "**You**: ", "**Assistant**: "),
    ("> system\n", "Q: ", "A: "),
)
#: One turn in so many has no marker, but for the first of a transcript.
UNMARKED = 10
_NAMES = {
    "system": 0, "sys": 0, "context": 0, "user": 1, "human": 1, "you": 1, "me": 1, "q": 1, "question": 1, "customer": 1, "prompter": 1, "instruction": 1, "input": 1, "prompt": 1, "client": 1,
    "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "gpt": 2, "model": 2, "agent": 2, "response": 2, "output": 2, "chatbot": 2,
}
_MARKER = re.compile(r"\s*(?:#{1,6}\s*(?P<a>[A-Za-z]+)\s*:?\s*$|<\|(?:im_start\|>)?\s*(?P<b>[A-Za-z]+)\s*(?:\|>)?|\[(?P<c>[A-Za-z]+)\]\s*:?|\*\*(?P<d>[A-Za-z]+)\*\*\s*:|>\s*(?P<e>[A-Za-z]+)\s*$|(?P<f>[A-Za-z]+)\s*:(?!//))\s*", re.M)
N_FEATURES = (4, 6, 4, 2)


def marker(line: str) -> tuple[int, int]:
    """(1 + role, length) of the speaker marker that a line begins with, or (0, 0)."""
    m = _MARKER.match(line)
    role = _NAMES.get(m[m.lastgroup].lower()) if m else None
    return (0, 0) if role is None else (role + 1, m.end())


def features(line: str, after_blank: bool) -> tuple[int, int, int, int]:
    kind, cut = marker(line)
    text = line[cut:].strip()
    end = 0 if not text else 1 if text[-1] == "?" else 2 if text[-1] in ".!:;" else 3
    return kind, min(5, len(text).bit_length() // 2), end, int(after_blank)


def lines(transcript: str) -> list[tuple[str, tuple]]:
    """The lines that aren't blank with their features."""
    out, blank = [], False
    for line in transcript.split("\n"):
        if line.strip():
            out.append((line, features(line, blank)))
            blank = False
        else:
            blank = True
    return out


def _pick(key: str, n: int) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % n


def transcribe(conv_id, turns: list[tuple[str | None, str | None]], styles: tuple = STYLES, word: str = "") -> tuple[str, list[int]]:
    """(transcript, the state of each line that isn't blank) of a conversation's (role, text) turns."""
    style = styles[_pick(f"style {conv_id}{word}", len(styles))]
    apart = "\n\n" if _pick(f"apart {conv_id}{word}", 2) else "\n"
    parts, states = [], []
    for k, (role, text) in enumerate(turns):
        r = ROLES.index(role) if role in ROLES else 1
        head = "" if k and not _pick(f"mark {conv_id} {k}{word}", UNMARKED) else style[r]
        part = head + (text or "")
        n = sum(bool(x.strip()) for x in part.split("\n"))
        states += [2 * r, *[2 * r + 1] * (n - 1)][:n]
        parts.append(part)
    return apart.join(parts), states


class Model:
    """Log probabilities of first states, of transitions and of each feature in each state, smoothed."""

    def __init__(self, counts: Counter):
        n = len(STATES)
        first, move = np.full(n, 0.5), np.full((n, n), 0.5)
        # A marker says nearly all about a role; of what a line is like otherwise, less is known from few lines.
        seen = [np.full((n, k), 0.5 if i else 0.02) for i, k in enumerate(N_FEATURES)]
        for (kind, a, b), c in counts.items():
            if kind == "first":
                first[b] += c
            elif kind == "move":
                move[a, b] += c
            else:
                seen[int(kind)][a, b] += c
        # A line can only go on with the turn that it is in.
        for a in range(n):
            for b in range(1, n, 2):
                if b // 2 != a // 2:
                    move[a, b] = 0
        first[1::2] = 0
        with np.errstate(divide="ignore"):
            self.first = np.log(first / first.sum())
            self.move = np.log(move / move.sum(1, keepdims=True))
        self.seen = [np.log(x / x.sum(1, keepdims=True)) for x in seen]

    def emission(self, f: tuple) -> np.ndarray:
        return sum(table[:, v] for table, v in zip(self.seen, f))

    def viterbi(self, observed: list[tuple]) -> list[int]:
        """The most probable states; of equally probable ones the first."""
        if not observed:
            return []
        p = self.first + self.emission(observed[0])
        back = []
        for f in observed[1:]:
            ways = p[:, None] + self.move
            best = np.argmax(ways, 0)
            back.append(best)
            p = ways[best, np.arange(len(STATES))] + self.emission(f)
        path = [int(np.argmax(p))]
        for best in reversed(back):
            path.append(int(best[path[-1]]))
        return path[::-1]

    def parse(self, transcript: str) -> list[tuple[str, str]]:
        """(role, text) of the turns of a transcript."""
        states = iter(self.viterbi([f for _, f in lines(transcript)]))
        turns: list[tuple[str, list[str]]] = []
        for line in transcript.split("\n"):
            if not line.strip():
                if turns:
                    turns[-1][1].append("")
                continue
            s = next(states)
            if s % 2 == 0 or not turns:
                turns.append((ROLES[s // 2], []))
                line = line[marker(line)[1] :]
            turns[-1][1].append(line)
        return [(r, "\n".join(t).strip("\n")) for r, t in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def count(transcript: str, states: list[int]) -> Counter:
    """What a transcript with known states adds to the counts of a model."""
    out: Counter = Counter()
    before = None
    for (_, f), s in zip(lines(transcript), states, strict=True):
        out["first" if before is None else "move", -1 if before is None else before, s] += 1
        for k, v in enumerate(f):
            out[str(k), s, v] += 1
        before = s
    return out


def _conversations(df: DataFrame) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _each(batches, styles: tuple, word: str):
    for batch in batches:
        for a in range(0, batch.num_rows, 100):
            part = batch.slice(a, 100)
            yield [(c, *transcribe(c, [(t["role"], t["text"]) for t in turns], styles, word)) for c, turns in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]


def learn(conversations: DataFrame, styles: tuple = STYLES, word: str = " learn") -> Model:
    """The model counted over all conversations, by partial counts of each partition."""

    def run(batches):
        total: Counter = Counter()
        for rows in _each(batches, styles, word):
            for _, text, states in rows:
                total.update(count(text, states))
        keys = list(total)
        yield pa.record_batch([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))] + [pa.array([total[k] for k in keys], pa.int64())], names=["kind", "a", "b", "n"])

    rows = _conversations(conversations).mapInArrow(run, "kind string, a int, b int, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model(Counter({(r.kind, r.a, r.b): r.n for r in rows}))


def parse_transcripts(transcripts: DataFrame, model: Model) -> DataFrame:
    """(conv_id, n_turns, roles, rendered) of every row of (conv_id, transcript)."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in (batch.slice(a, b - a) for batch in batches for a, b in vec.slices(batch.column(1))):
            parsed = [shared.value.parse(t or "") for t in part.column(1).to_pylist()]
            columns = [[len(p) for p in parsed], [[r for r, _ in p] for p in parsed], [render(p) for p in parsed]]
            yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.list_(pa.string()), pa.string())))], names=["conv_id", "n_turns", "roles", "rendered"])

    return transcripts.select("conv_id", "transcript").mapInArrow(run, "conv_id bigint, n_turns int, roles array<string>, rendered string")


def transcripts_of(conversations: DataFrame, styles: tuple = STYLES, word: str = "") -> DataFrame:
    """(conv_id, transcript) of every conversation."""

    def run(batches):
        for rows in _each(batches, styles, word):
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "transcript"])

    return _conversations(conversations).mapInArrow(run, "conv_id bigint, transcript string")
