"""Token counts by a deterministic transducer compiled from the merges of a sentencepiece BPE model.

A cutting of a text into pieces is the tokenizer's exactly if each two neighbouring pieces are what the merges make of
those two pieces' own text. So the piece that ends at a place follows from the pieces that end at the few places before
it, as far back as a piece can begin. A state is what is still open of that: for each suffix of the text read that begins
some longer piece, the piece that ends before the suffix and the tokens since. A step reads one character, and is annotated
with the tokens that it adds (fewer than none where a longer piece takes the place of several). Steps are compiled from
the vocabulary when first taken, and the same suffixes lead to the same state.

Between two characters that stand together in no piece the transducer is synchronised: what follows doesn't depend on the
state before. So the effect of a chunk of text, whatever the state that it is entered in, is a small map: its head up to
the first such place, the tokens behind it and the state at its end. Maps compose associatively, and a prefix scan over the
chunks of a whole batch of texts, by an up-sweep and a down-sweep, gives the state and the tokens at every chunk's end."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import appended, strings

SPACE = "▁"
#: Characters of a chunk.
CHUNK = 1 << 14
#: States and pairs of pieces that a worker keeps, about 600 bytes each with their steps; beyond it they are compiled anew.
MOST_STATES = 400_000
#: Characters that are scanned together: of several texts, or of one stretch of a longer text.
AT_ONCE = 1 << 21


class State(dict):
    """By character: (next state, tokens that the step adds)."""

    __slots__ = ("machine", "open", "before")

    def __missing__(self, c: str) -> tuple[State, int]:
        step = self[c] = self.machine.compile(self, c)
        return step


class Text:
    """The effect of a stretch of text on a state, remembered for each state that it was entered in."""

    __slots__ = ("text", "known")

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def apply(self, state: State) -> tuple[State, int]:
        found = self.known.get(id(state))
        if found is None:
            found = self.known[id(state)] = run(state, self.text)
        return found


class Both:
    """One effect after another."""

    __slots__ = ("first", "second")

    def __init__(self, first: Text | Both, second: Text | Both):
        self.first, self.second = first, second

    def apply(self, state: State) -> tuple[State, int]:
        state, a = self.first.apply(state)
        state, b = self.second.apply(state)
        return state, a + b


class Map:
    """The effect of whole chunks: that of their head on the state before them, then `tokens` and `state`; state is None
    where no synchronised place lies inside, and the head is all."""

    __slots__ = ("head", "tokens", "state")

    def __init__(self, head: Text | Both, tokens: int, state: State | None):
        self.head, self.tokens, self.state = head, tokens, state

    def apply(self, state: State) -> tuple[State, int]:
        after, n = self.head.apply(state)
        return (after if self.state is None else self.state), n + self.tokens

    def then(self, other: Map) -> Map:
        if self.state is None:
            return Map(Both(self.head, other.head), other.tokens, other.state)
        state, n = other.apply(self.state)
        return Map(self.head, self.tokens + n, state)


def run(state: State, text: str) -> tuple[State, int]:
    total = 0
    for c in text:
        state, n = state[c]
        total += n
    return state, total


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only BPE models without normalisation rules can be compiled")
        if not spec.trainer_spec.byte_fallback or any(p.type not in (1, 2, 3, 6) for p in spec.pieces):
            raise ValueError("only models with byte fallback and without pieces of the user can be compiled")
        self.prefix = SPACE if n.add_dummy_prefix else ""
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.characters = {c for p in self.scores for c in p}
        if self.characters - self.scores.keys():
            raise ValueError("a character of a piece is no piece")
        self.together = {a + b for p in self.scores for a, b in zip(p, p[1:])}
        self.beginnings = {p[:k] for p in self.scores for k in range(1, len(p))}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.start = self.state((("", None, 0),), "")

    def state(self, open_: tuple, before: str) -> State:
        found = self.states.get((open_, before))
        if found is None:
            found = self.states[open_, before] = State()
            found.machine, found.open, found.before = self, open_, before
        return found

    def neighbours(self, a: str | None, b: str) -> bool:
        """Whether piece b can follow piece a (None: a synchronised place): whether the merges of their joint text, those
        neighbours first whose joint piece has the best score, the leftmost of equal ones, never cross from a to b."""
        found = self.pairs.get((a, b))
        if found is None:
            parts, cut, score = [*(a or ""), *b], len(a or ""), self.scores.get
            found = True
            while found:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    s = score(parts[k] + parts[k + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, k
                if at < 0:
                    break
                found = at != cut - 1
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                cut -= at < cut
            found = self.pairs[a, b] = found and len(parts) == (2 if a else 1)
        return found

    def compile(self, state: State, c: str) -> tuple[State, int]:
        if c not in self.characters:  # its bytes, one token each
            return self.start, len(c.encode())
        open_ = state.open if state.before + c in self.together else self.start.open
        ending = [(u + c, last, n + 1) for u, last, n in open_ if u + c in self.scores]
        # Exactly one of them is the tokenizer's, so the last needs no test.
        piece, _, tokens = next((e for e in ending[:-1] if self.neighbours(e[1], e[0])), ending[-1])
        left = tuple((u + c, last, n - tokens) for u, last, n in open_ if u + c in self.beginnings)
        return self.state((*left, ("", piece, 0)), c), tokens

    def map(self, chunk: str) -> Map:
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in self.together:
                state, n = run(self.start, chunk[k:])
                return Map(Text(chunk[:k]), n, state)
        return Map(Text(chunk), 0, None)

    def scan(self, maps: list[Map], start: State | None = None) -> list[tuple[State, int]]:
        """The state and the tokens so far after each map, from the start on, in a logarithmic number of rounds; what a round does to its maps doesn't depend on each other."""
        rounds = [maps]
        while len(rounds[-1]) > 1:
            now = rounds[-1]
            rounds.append([now[i].then(now[i + 1]) if i + 1 < len(now) else now[i] for i in range(0, len(now), 2)])
        entered = [(start or self.start, 0)]
        for now in reversed(rounds[:-1]):
            below = []
            for i, (state, n) in enumerate(entered):
                below.append((state, n))
                if 2 * i + 1 < len(now):
                    after, more = now[2 * i].apply(state)
                    below.append((after, n + more))
            entered = below
        out = []
        for m, (state, n) in zip(maps, entered):
            after, more = m.apply(state)
            out.append((after, n + more))
        return out

    def counts(self, texts: list[str], chunk: int = CHUNK) -> list[int]:
        """Tokens of each whole text, as the library counts them; the empty text has none."""
        self.forget()
        maps, ends, long = [], [], {}
        for i, text in enumerate(texts):
            if len(text) > AT_ONCE:
                long[i] = self.count_long(self.prefix + text.replace(" ", SPACE), chunk)
            elif text:
                text = self.prefix + text.replace(" ", SPACE)
                # The first chunk of a text is entered in no other state than the start.
                state, n = run(self.start, text[:chunk])
                maps.append(Map(Text(""), n, state))
                maps += [self.map(text[i : i + chunk]) for i in range(chunk, len(text), chunk)]
            ends.append(len(maps))
        so_far = [0, *(n for _, n in self.scan(maps))]
        return [long.get(i, so_far[b] - so_far[a]) for i, (a, b) in enumerate(zip([0, *ends], ends))]

    def forget(self, state: State | None = None) -> State | None:
        """Begin anew where too much is kept; only the given state is kept then."""
        if len(self.states) + len(self.pairs) > MOST_STATES:
            self.reset()
            return state and self.state(state.open, state.before)
        return state

    def count_long(self, text: str, chunk: int) -> int:
        """A text beyond AT_ONCE by stretches, each scanned from the state that the one before ends in, in bounded memory."""
        state, total = self.start, 0
        for at in range(0, len(text), AT_ONCE):
            part = text[at : at + AT_ONCE]
            state, n = self.scan([self.map(part[i : i + chunk]) for i in range(0, len(part), chunk)], state)[-1]
            state, total = self.forget(state), total + n
        return total


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def groups(texts: list[str]) -> Iterator[list[str]]:
    """texts in order, AT_ONCE characters together."""
    held: list[str] = []
    size = 0
    for t in texts:
        if held and size + len(t) > AT_ONCE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def with_token_counts(df: DataFrame, model_path: str, limit: int, text: str = "text") -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each whole text.

    Null counts as empty: 0, 0, false. A text of any length is scanned in chunks, whether or not it has synchronised
    places. Repeated rows are counted each, own columns of these three names give way, and an empty table gives no rows."""

    names = ["n_bytes", "n_tokens", "over_limit"]

    @F.pandas_udf("n_bytes long, n_tokens long, over_limit boolean")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = transducer(model_path).counts
        for batch in batches:
            texts = strings(batch)
            n = [k for group in groups(texts) for k in counts(group)]
            yield pd.DataFrame({"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]})

    return appended(df, count(F.col(text)), names)
