"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. Successive
prefixes of a conversation are rendered; what the k-th output adds to the one before is the
span of turn k, and an output that doesn't begin with the one before shows a template that
rewrites history. Inside a span the text of the turn is found by rendering the same prefix
with the text replaced by a probe: what both outputs share at either end is the template's.

Rows stream through tasks sorted by (conversation, turn). A template is rendered on true
prefixes, from the first turn on, so a task holds one conversation and its output, and the
work grows with the square of its turns. A template that declares itself a concatenation of
turns (``concatenated``) needs bounded memory for a conversation of any length: only the last
``span`` turns are rendered again for each new turn, and each time the window moves on, the
turns it shares with the last one are rendered in both and compared.

Defined results: null role or text is empty; turns of one conversation with equal numbers
go by role, then text; a null turn number comes first; a null conv_id is a conversation;
repeated rows are turns of their own; an empty table gives an empty result; other columns of
the input are not returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
WINDOW = 32
PROBES = ("\ue000", "\ue001")  # two letters no template treats apart

# ---------------------------------------------------------------- a template with reversible escapes

#: Strings that must not stand in a text as they are.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(\\|n)?", re.S)


def escape(text: str, lines: bool = False) -> str:
    """Backslashes doubled, one put after the first character of each control string; with ``lines`` a newline is \\n."""
    out = _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))
    return out.replace("\n", "\\n") if lines else out


def unescape(text: str, lines: bool = False) -> str:
    """The text that was escaped; no control string has ``n`` second, so \\n is a newline only."""
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else ("\n" if lines else "n") if m[1] else "", text)


def concatenated(template: Template) -> Template:
    """Declares that ``template`` shows every turn alone, whatever stands before or after it, and adds nothing."""
    template.concatenated = True
    return template


@concatenated
def chatml(turns: list[Turn]) -> str:
    return "".join(f"{OPEN}{escape(role, True)}\n{escape(text)}{CLOSE}" for role, text in turns)


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def read_back(formatted: str) -> list[Turn]:
    return [(unescape(m[1], True), unescape(m[2])) for m in _TURN.finditer(formatted)]


# ---------------------------------------------------------------- spans from outputs alone


def common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


@dataclass
class Rendered:
    """One turn as the template shows it: its piece of the output and where its text stands in that piece."""

    role: str
    piece: str
    start: int
    end: int


@dataclass
class Renderer:
    """Feeds turns one by one; of a concatenation keeps the last ``span`` turns and their output only."""

    template: Template
    span: int = WINDOW
    turns: list[Turn] = field(default_factory=list)
    shown: str = ""
    rewrites: int = 0

    def add(self, role: str, text: str) -> Rendered:
        if getattr(self.template, "concatenated", False) and len(self.turns) >= 2 * self.span:
            kept = self.turns[-self.span :]
            again = self.template(kept)
            if not self.shown.endswith(again):
                self.rewrites += 1
            self.turns, self.shown = kept, again
        whole = self.template([*self.turns, (role, text)])
        if not whole.startswith(self.shown):  # history was rewritten: the span is what differs from the first change on
            self.rewrites += 1
        at = len(self.shown) if whole.startswith(self.shown) else common(whole, self.shown)
        start, end = self._text_at(whole, role, text)
        self.turns.append((role, text))
        self.shown = whole
        return Rendered(role, whole[at:], max(start - at, 0), max(end - at, 0))

    def _text_at(self, whole: str, role: str, text: str) -> tuple[int, int]:
        """Where the last turn's text stands: two probes of other letters show what comes before and after it."""
        a, b = (self.template([*self.turns, (role, p)]) for p in PROBES)
        lead = common(a, b)
        tail = len(a) - lead - 1
        return lead, max(lead, len(whole) - tail)


def formatted_turns(rows: Iterator[tuple[object, str, str]], template: Template) -> Iterator[tuple[object, list | None]]:
    """Yields (conversation, Rendered) for each turn and (conversation, None, rewrites) at its end."""
    now: object = object()
    r: Renderer | None = None
    for conv, role, text in rows:
        if r is None or conv != now:
            if r is not None:
                yield now, None, r.rewrites
            now, r = conv, Renderer(template)
        yield conv, r.add(role, text), 0
    if r is not None:
        yield now, None, r.rewrites


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text) with each conversation whole and in order in one partition."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


SPANS = "conv_id long, turn_no long, role string, piece string, text_start int, text_end int, loss boolean, rewrites int"


def turn_spans(conversations: DataFrame, template: Template = chatml, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each turn: its piece of the output, the text's place in it, and whether it is under the loss
    mask; after a conversation's turns one row with a null turn_no and its number of rewrites."""

    def run(batches):
        out: list[tuple] = []
        no, last = 0, object()
        for conv, r, rewrites in formatted_turns(_stream(batches), template):
            no = no + 1 if conv == last else 0
            last = conv
            out.append((conv, no, r.role, r.piece, r.start, r.end, r.role in loss_roles, 0) if r else (conv, None, None, "", 0, 0, False, rewrites))
            if len(out) >= 1000:
                yield _batch(out, SPANS)
                out = []
        if out:
            yield _batch(out, SPANS)

    return sorted_turns(conversations).mapInArrow(run, SPANS)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], spec: str) -> pa.RecordBatch:
    fields = [c.split() for c in spec.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], ARROW[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites int"


def digests(
    conversations: DataFrame, template: Template = chatml, loss_roles: tuple[str, ...] = ("assistant",),
    read: Callable[[str], list[Turn]] = read_back, plain: Callable[[str], str] = unescape,
) -> DataFrame:
    """Per conversation, from the output alone: what reads back, and what the mask covers.

    ``read`` and ``plain`` belong to the template: the turns in a piece of its output, and a text without its escapes.
    """

    def run(batches):
        out: list[tuple] = []
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = masked = chars = 0
        for conv, r, rewrites in formatted_turns(_stream(batches), template):
            if r is None:
                out.append((conv, n, turns.hexdigest(), masked, loss.hexdigest(), chars, rewrites))
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = masked = chars = 0
                if len(out) >= 1000:
                    yield _batch(out, DIGESTS)
                    out = []
                continue
            chars += len(r.piece)
            for role, text in read(r.piece):
                n += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if r.role in loss_roles:
                text = plain(r.piece[r.start : r.end])
                masked += len(text)
                loss.update(text.encode("utf-8", "surrogatepass"))
        if out:
            yield _batch(out, DIGESTS)

    return sorted_turns(conversations).mapInArrow(run, DIGESTS)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    return digests(rows.union(extra))


QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES: dict[str, str] = {}
