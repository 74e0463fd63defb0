"""Chat formatting by incremental black-box rendering.

A template is a function from a list of turns to one string, about which nothing is assumed. Every successive prefix of a
conversation is rendered, whatever its length, and consecutive outputs are compared: what the longer output adds is the new turn's span, and an output
that changes what stood before reveals a template that rewrites history (``rewrites``; its spans are null from there on, as no
place of the final text can be told from them). So a conversation costs the square of its turns, which is what it takes to see every rewrite
of a black box. The text's place within a span is found by rendering the turn once more with another text, one that begins and ends with
other characters: what both outputs begin and end with is the template's.

Conversations are streamed in order through sorted partitions, one at a time held whole.

Defined results: null text and role are empty; texts of any length are rendered whole; turns are ordered by turn, role and text, nulls
first, so ties and repeated rows are turns that follow one another; turns with a null conv_id form one conversation; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = dict[str, str]
Template = Callable[[list[Turn]], str]

_CONTROL = re.compile(r"[\\#<]")
_ROLE_CONTROL = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn]) -> str:
    """``### role: text</turn>`` and a line end a turn; a backslash before each control character of role or text."""
    return "".join(f"### {_ROLE_CONTROL.sub(lambda m: chr(92) + m[0], t['role'])}: {escaped(t['text'])}</turn>\n" for t in turns)


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Incremental:
    """Locates the spans of one conversation's turns, one turn at a time."""

    def __init__(self, template: Template):
        self.template = template
        self.turns: list[Turn] = []
        self.before: str = template([]) if self._takes_none(template) else ""
        self.rewrites = False

    @staticmethod
    def _takes_none(template: Template) -> bool:
        try:
            template([])
        except Exception:  # noqa: BLE001 - a black box may refuse an empty conversation in any way
            return False
        return True

    def add(self, turn: Turn) -> tuple[str, int, int, int] | None:
        """(formatted span, its start in the output, start and end of the text in the span), or None after a rewrite."""
        if self.rewrites:
            return None
        after = self.template([*self.turns, turn])
        if not after.startswith(self.before):
            self.rewrites = True
            return None
        at = len(self.before)
        span = after[at:]
        placed = (span, at, *self._text_place(turn, span))
        self.turns.append(turn)
        self.before = after
        return placed

    def _span_of(self, turn: Turn, text: str) -> str | None:
        out = self.template([*self.turns, {**turn, "text": text}])
        return out[len(self.before) :] if out.startswith(self.before) else None

    def _text_place(self, turn: Turn, span: str) -> tuple[int, int]:
        """Where the text begins and ends in its span: behind and before what another text's span has too."""
        text = turn["text"]
        other = self._span_of(turn, stand_in(text))
        # an empty text leaves nothing to differ from, so two others show what is the template's
        mine = span if text else self._span_of(turn, stand_in(stand_in("")))
        if mine is None or other is None:
            return 0, len(span)
        start = _common(mine, other)
        end = _common(mine[::-1], other[::-1])
        return start, max(start, len(span) - end)


def stand_in(text: str) -> str:
    """A text of letters whose first and last characters differ from those of ``text``, also where case or white space changes."""
    bare = text.strip().casefold()
    near = lambda x: {x[:1].casefold(), bare[:1], bare[-1:], x[-1:].casefold()}
    first, last = (next(c for c in pool if c not in near(text)) for pool in ("qxjzk", "vwyug"))
    return f"{first}{last}"


Placed = tuple[str, int, int, int]


def located(turns: list[Turn], template: Template) -> list[Placed | None]:
    """The place of every turn of one conversation as :meth:`Incremental.add` gives it, None from a rewrite on."""
    state = Incremental(template)
    return [state.add(t) for t in turns]


SPANS = "conv_id long, turn_no long, role string, formatted string, span_start long, text_start long, text_end long, rewrites boolean"
_SPANS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("span_start", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("rewrites", pa.bool_())])
_BATCH = 2000
_START = object()


def turn_spans(conversations: DataFrame, template: Template = turn_template) -> DataFrame:
    """One row per turn, in order within sorted partitions: its formatted text and where it and its text lie."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns = _START, []

        def placed() -> Iterator[pa.RecordBatch]:
            rows = [(now, k, t["role"], *(p or (None,) * 4), p is None) for k, (t, p) in enumerate(zip(turns, located(turns, template)))]
            for at in range(0, len(rows), _BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + _BATCH]), _SPANS)], schema=_SPANS)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if now is _START or conv != now:
                    yield from placed()
                    now, turns = conv, []
                turns.append({"role": role or "", "text": text or ""})
        yield from placed()

    d = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return d.mapInArrow(run, SPANS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])


def digests(spans: DataFrame, learns: str = "assistant") -> DataFrame:
    """One row per conversation, read back from the formatted spans of :func:`turn_template`; the loss lies on ``learns`` turns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, out = _START, 0, []
        whole = loss = hashlib.sha256()
        chars = formatted_chars = 0
        rewrites = False

        def row() -> tuple:
            return (now, n, whole.hexdigest(), chars, loss.hexdigest(), formatted_chars, rewrites)

        for batch in batches:
            for conv, formatted, lo, hi, rewritten in zip(*(batch.column(i).to_pylist() for i in (0, 3, 5, 6, 7))):
                if now is _START or conv != now:
                    if now is not _START:
                        out.append(row())
                    now, n, chars, formatted_chars, rewrites = conv, 0, 0, 0, False
                    whole, loss = hashlib.sha256(), hashlib.sha256()
                n += 1
                rewrites = rewrites or rewritten
                if formatted is None:
                    continue
                read = _TURN.fullmatch(formatted)
                if read is None:
                    raise ValueError(f"a span of conversation {conv} does not read back as one turn")
                role, text = unescaped(read[1]), unescaped(read[2])
                whole.update(f"{role}\n{text}\n".encode())
                formatted_chars += len(formatted)
                if role == learns:
                    masked = unescaped(formatted[lo:hi])
                    loss.update(masked.encode())
                    chars += len(masked)
            if len(out) >= _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DIGESTS)], schema=_DIGESTS)
                out = []
        if now is not _START:
            out.append(row())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DIGESTS)], schema=_DIGESTS)

    return spans.mapInArrow(run, DIGESTS)


#: The conversation that the query contract adds.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"


def with_added(conversations: DataFrame) -> DataFrame:
    rows = [(ADDED_ID, 0, "user", ADDED_TEXT), (ADDED_ID, 1, "assistant", ADDED_TEXT)]
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return c.unionByName(conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(regexp_replace(role, '([\\#<:])', '_\1', 'g')) + length(regexp_replace(text, '([\\#<])', '_\1', 'g')))::BIGINT AS formatted_chars,
  FALSE AS rewrites
FROM c GROUP BY conv_id
"""
