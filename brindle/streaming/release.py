"""How much of a text that is still growing may go out: redacted text, and whole sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.operators import scan

# Characters that are held at most, characters that a dear check waits for, and what ends a sentence.
MAX_HOLD = 16_000
SEGMENT = 400
SENTENCE_END = r"[.!?\n](?=\s|$)"

_UP_TO_LAST_END = re.compile(f"(?s:.*){SENTENCE_END}")
_SPACE = re.compile(r"\s")


def check_digit_holds(number: str) -> bool:
    """The check digit of a card number, other characters left out."""
    digits = np.array([int(d) for d in number if d.isdigit()][::-1])
    digits[1::2] *= 2
    return int((digits // 10 + digits % 10).sum()) % 10 == 0


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that overlap as one, under the label that begins first."""
    out: list[tuple[int, int, str]] = []
    for begin, end, label in sorted(spans):
        if out and begin < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2])
        else:
            out.append((begin, end, label))
    return out


def last_cut(places: np.ndarray, spans: list[tuple[int, int, str]]) -> int | None:
    """The last of ascending places that lies within no span (these apart from each other, in order)."""
    begins, ends = (np.array([s[i] for s in spans], np.int64) for i in (0, 1))
    before = np.searchsorted(begins, places)  # spans that begin before each place
    free = (before == 0) | (np.append(ends, 0)[before - 1] <= places)
    return int(places[free][-1]) if free.any() else None


class Redactor:
    """What is held of one text: the character before it, for context, and the rest that may still become part of a match."""

    def __init__(self, patterns: dict[str, re.Pattern], hold: int, context: str = "", held: str = ""):
        self.patterns, self.hold, self.context, self.held = patterns, hold, context, held

    def spans(self, text: str, begin: int) -> list[tuple[int, int, str]]:
        """Matches behind ``begin``, those that overlap as one; a pattern's group is its span, if there is one."""
        found = []
        for label, pattern in self.patterns.items():
            for m in pattern.finditer(text, begin):
                if label != "CREDIT_CARD" or check_digit_holds(m[0]):
                    found.append((*m.span(1 if pattern.groups and m[1] else 0), label))
        return merged(found)

    def push(self, more: str, last: bool) -> str:
        """The redacted text that may go out now."""
        text, begin = self.context + self.held + more, len(self.context)
        spans = self.spans(text, begin)
        end = len(text) if last else self._end(text, begin, spans)
        out, at = [], begin
        for a, b, label in spans:
            if b <= end:
                out += [text[at:a], f"[{label}]"]
                at = b
        out.append(text[at:end])
        self.context, self.held = text[:end][-1:], text[end:]
        return "".join(out)

    def _end(self, text: str, begin: int, spans: list[tuple[int, int, str]]) -> int:
        """Where to cut: behind the last white space that is far enough from the end and in no match.

        A text that has none may be cut anywhere outside of a match, once it is too long to be held.
        """
        limit = len(text) - self.hold
        places = np.array([m.end() for m in _SPACE.finditer(text, begin, max(limit, begin))], np.int64)
        end = last_cut(places, spans)
        if end is None and limit - begin > MAX_HOLD:
            edges = [s[0] for s in spans if begin < s[0] <= limit]
            end = last_cut(np.array(sorted({*edges, limit}), np.int64), spans)
        return begin if end is None else end


def redact_stream(chunks: DataFrame, patterns: dict[str, str] | None = None, hold: int = scan.LONGEST["pii"]) -> DataFrame:
    """message_id, sequence_no, text: redacted text as it may be released, for a stream of chunks.

    The tail of a message, ``hold`` characters (as long as the longest match) and back to a white space outside of a match, waits for
    the next chunk, so that a match across chunks is caught; a chunk marked last releases all. Where more than ``MAX_HOLD``
    characters have no white space, the tail alone waits, and of a match that is longer than it the end may be released.
    Chunks of a message come in order.
    """
    compiled = {k: re.compile(p, re.ASCII) for k, p in (patterns or scan.PII).items()}

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text = Redactor(compiled, hold, *(state.get if state.exists else ()))
        rows = pd.concat(list(parts)).sort_values("sequence_no")
        out = [(key[0], seq, text.push(more or "", bool(last))) for seq, more, last in zip(rows["sequence_no"], rows["text"], rows["last"])]
        state.update((text.context, text.held))
        yield pd.DataFrame(out, columns=["message_id", "sequence_no", "text"])

    return chunks.groupBy("message_id").applyInPandasWithState(step, "message_id long, sequence_no long, text string", "context string, held string", "append", GroupStateTimeout.NoTimeout)


def sentences(held: str, least: int) -> int:
    """How much of a text may go to a check that reads whole sentences: up to the last end of one, once ``least`` characters are there."""
    if len(held) > MAX_HOLD:
        return len(held)
    found = _UP_TO_LAST_END.match(held) if len(held) >= least else None
    return found.end() if found else 0


def segment_stream(chunks: DataFrame, least: int = SEGMENT) -> DataFrame:
    """message_id, sequence_no, text: whole sentences for checks that are dear, at least ``least`` characters at a time.

    Text is held until an end of a sentence (or line) is among at least ``least`` characters; a chunk marked last releases all, and
    so does more than ``MAX_HOLD`` characters without one.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = state.get[0] if state.exists else "", []
        rows = pd.concat(list(parts)).sort_values("sequence_no")
        for seq, more, last in zip(rows["sequence_no"], rows["text"], rows["last"]):
            held += more or ""
            end = len(held) if last else sentences(held, least)
            if end:
                out.append((key[0], seq, held[:end]))
            held = held[end:]
        state.update((held,))
        yield pd.DataFrame(out, columns=["message_id", "sequence_no", "text"])

    return chunks.groupBy("message_id").applyInPandasWithState(step, "message_id long, sequence_no long, text string", "held string", "append", GroupStateTimeout.NoTimeout)
