"""Chat formatting in budgeted windows.

Spark counts the tokens of each rendered turn once and keeps their prefix sums along the whole conversation.  The sums choose the spans of
target turns: with a stride of `budget` less the system turn and the history, the turns that begin between two multiples of the stride are
a span.  So a span is known from its turns' sums alone, wherever in a conversation of any length it lies, and no task follows a whole
conversation.  What the last turn of a span holds beyond the stride takes its room from the history; where even that is not enough, the
span is cut before the turn that does not fit.

A window is a span and its context: the conversation's first system turn, retained in all later windows, and as much of the turns just
before the span as `history` tokens and the budget's rest hold, repeated.  Loss is taken on the texts of the span's assistant turns only:
what is repeated is masked, so each assistant text counts once over all windows.

Template: <turn role="ROLE">TEXT</turn> and a line feed.  Inside roles and texts a backslash is doubled and `<turn`, `</turn` and `"` (in
roles) get one in front; undoing that gives the text back exactly.

Defined results: null texts and roles are empty; rows with a null conv_id are one conversation; null turns come first, and turns of one
number are ordered by role and text; a turn larger than the budget gets a window to itself, whole; empty tables give empty results;
extra columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Fixed value: how byte_bpe_50k splits texts.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TURN = re.compile(r'<turn role="((?:[^"\\]++|\\.)*+)">((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n', re.DOTALL)
#: The code points with the property White_Space, which is what the tokenizer splits at.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_SPACE = re.compile(SPACE + "{500,}")
WINDOWS = "conv_id {kind}, span long, window_no int, formatted string, context_turns int, loss_starts array<int>, loss_ends array<int>, tokens long"


# --- template ---------------------------------------------------------------------------------------------------------------------


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("</turn", "\\</turn").replace("<turn", "\\<turn")
    return text.replace('"', '\\"') if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, str]:
    """What stands before a turn's text, and the rest."""
    return f'<turn role="{escape(role, role=True)}">', f"{escape(text)}</turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not in the template from character {at} on")
    return turns


# --- tokens -----------------------------------------------------------------------------------------------------------------------

_loaded: dict[int, object] = {}


def bpe_counter(path: str = TOKENIZER) -> Callable[[str], int]:
    """Counts tokens with a tiktoken vocabulary; its bytes (under 1 MB) travel with the function, so only the driver needs the file."""
    with open(path, "rb") as f:
        raw = f.read()

    def count(text: str) -> int:
        if (own := _loaded.get(len(raw))) is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
            own = _loaded[len(raw)] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        n, at = 0, 0
        # the tokenizer's own matcher overflows on very long white space: all of a run but its last character is one piece by SPLIT
        for m in LONG_SPACE.finditer(text):
            end = m.end() - (m.end() < len(text))
            n += len(own.encode_ordinary(text[at : m.start()])) + len(own._encode_single_piece(text[m.start() : end]))
            at = end
        return n + len(own.encode_ordinary(text[at:] if at else text))

    return count


def with_tokens(turns: DataFrame, count: Callable[[str], int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count("".join(render(r, t))) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "tokens"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(run, f"conv_id {kind}, turn long, role string, text string, tokens long")


# --- windows ----------------------------------------------------------------------------------------------------------------------

CONTEXT, TARGET = 1, 2


def with_prefix_sums(turns: DataFrame, block_turns: int = 4096) -> DataFrame:
    """Adds `begin`: the tokens before a turn in its conversation.

    Blocks of turn numbers are summed first, so a long conversation is not ordered in one task; the sums run through them.
    """
    order = ["turn", "role", "text"]
    block = F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(2**40)))
    own = turns.withColumn("block", block)
    sums = own.groupBy("conv_id", "block").agg(F.sum("tokens").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(sums.select(F.col("conv_id").alias("o_conv"), F.col("block").alias("o_block"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumn("upto", F.sum("tokens").over(inside))
    both = run.join(offsets, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("block") == F.col("o_block")))
    return both.withColumn("begin", F.col("offset") + F.col("upto") - F.col("tokens")).drop("block", "o_conv", "o_block", "offset", "upto")


class _Span:
    """The turns of one span, in order, made into windows."""

    def __init__(self, key: tuple, budget: int, history: int):
        self.key, self.budget, self.history = key, budget, history
        self.system: tuple[str, str, int] | None = None
        self.before: list[tuple[str, str, int, int]] = []  # role, text, tokens, begin of turns that may be repeated
        self.targets: list[tuple[str, str, int, int, bool]] = []
        self.number = 0

    def add(self, role: str, text: str, tokens: int, begin: int, is_system: bool) -> list[tuple]:
        held = (self.system[2] if self.system else 0) + sum(t[2] for t in self.targets)
        made = self.close() if self.targets and held + tokens > self.budget else []
        self.targets.append((role, text, tokens, begin, is_system))
        return made

    def close(self) -> list[tuple]:
        if not self.targets:
            return []
        used = sum(t[2] for t in self.targets) + (self.system[2] if self.system else 0)
        start, room = self.targets[0][3], min(self.history, self.budget - used)
        repeated = [x[:3] for x in self.before if start - x[3] <= room]
        context = ([self.system] if self.system else []) + repeated
        parts, n, starts, ends = [], 0, [], []
        for k, (role, text, *_) in enumerate([*context, *self.targets]):
            head, rest = render(role, text)
            if k >= len(context) and role == "assistant":
                starts.append(n + len(head))
                ends.append(n + len(head) + len(rest) - len("</turn>\n"))
            parts += [head, rest]
            n += len(head) + len(rest)
        made = (*self.key, self.number, "".join(parts), len(context), starts, ends, used + sum(x[2] for x in repeated))
        self.number += 1
        for *turn, is_system in self.targets:
            if is_system:  # from the next window on it is context
                self.system = tuple(turn[:3])
            else:
                self.before.append(tuple(turn))
        self.targets = []
        return [made]


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, count: Callable[[str], int] | None = None, block_turns: int = 4096) -> DataFrame:
    """A row for each window: conv_id, span, window_no (within the span), formatted, context_turns, loss_starts, loss_ends (in code points), tokens."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = materialise(with_tokens(turns, count or bpe_counter()))
    summed = materialise(with_prefix_sums(turns, block_turns))
    least = F.min(F.struct("begin", "text", "tokens"))
    system = materialise(summed.where("role = 'system'").groupBy("conv_id").agg(least.alias("s")).select(F.col("conv_id").alias("s_conv"), F.col("s.begin").alias("s_begin"), F.col("s.text").alias("s_text"), F.col("s.tokens").alias("s_tokens")))
    beside = F.col("conv_id").eqNullSafe(F.col("s_conv"))
    known = summed.join(system.drop("s_text"), beside, "left").drop("s_conv")

    stride = F.greatest(F.lit(budget - history) - F.coalesce("s_tokens", F.lit(0)), F.lit(max(budget // 4, 1)))
    known = known.withColumns({"stride": stride, "is_system": F.coalesce(F.col("begin") == F.col("s_begin"), F.lit(False)) & (F.col("role") == "system")})
    known = known.withColumn("span", F.floor(F.col("begin") / F.col("stride")))
    # a turn is also a candidate for the history of the spans that may begin soon enough after it
    last = F.when((F.col("tokens") <= history) & ~F.col("is_system"), F.floor((F.col("begin") + history) / F.col("stride"))).otherwise(F.col("span"))
    dealt = known.withColumn("to", F.explode(F.sequence("span", F.greatest("span", last))))
    rows = dealt.select("conv_id", F.col("to").alias("span"), F.when(F.col("to") == F.col("span"), TARGET).otherwise(CONTEXT).alias("part"), "turn", "role", "text", "tokens", "begin", "is_system")
    # the system turn goes to the spans after its own
    spans = materialise(known.where("s_begin is not null").select("conv_id", "span", "stride").distinct())
    told = spans.join(system, beside).where("span > floor(s_begin / stride)")
    told = told.select("conv_id", "span", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("system").alias("role"), F.col("s_text").alias("text"), F.col("s_tokens").alias("tokens"), F.col("s_begin").alias("begin"), F.lit(True).alias("is_system"))
    # spans without a turn of their own (only candidates reach them) make no window
    ordered = rows.unionByName(told).repartition("conv_id", "span").sortWithinPartitions("conv_id", "span", "part", "begin", "turn", "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Span | None = None
        schema = None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("conv_id"), ("span", pa.int64()), ("window_no", pa.int32()), ("formatted", pa.string()), ("context_turns", pa.int32()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32())), ("tokens", pa.int64())])
            out: list[tuple] = []
            for conv, span, part, role, text, tokens, begin, is_system in zip(*[b.column(c).to_pylist() for c in ("conv_id", "span", "part", "role", "text", "tokens", "begin", "is_system")]):
                if own is None or own.key != (conv, span):
                    out += own.close() if own else []
                    own = _Span((conv, span), budget, history)
                if part == TARGET:
                    out += own.add(role, text, tokens, begin, is_system)
                elif part == CONTEXT:
                    own.before.append((role, text, tokens, begin))
                else:
                    own.system = (role, text, tokens)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)
        if own and (out := own.close()):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return ordered.mapInArrow(run, WINDOWS.format(kind=kind))


def digests(windows: DataFrame) -> DataFrame:
    """What the windows hold, read back from them: a row for each conversation.

    Windows are parsed and unescaped where they are.  Only the bytes of their own turns go on, in order, to the digests: these run along a
    conversation, so each one's bytes stream through one task.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for formatted, context, starts, ends in zip(*[b.column(c).to_pylist() for c in ("formatted", "context_turns", "loss_starts", "loss_ends")]):
                turns = parse(formatted)[context:]
                lost = "".join(unescape(formatted[s:e]) for s, e in zip(starts, ends))
                out.append((len(turns), "".join(f"{role}\n{text}\n" for role, text in turns).encode(), len(lost), lost.encode(), len(formatted)))
            types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*b.select(["conv_id", "span", "window_no"]).columns, *[pa.array([x[k] for x in out], t) for k, t in enumerate(types)]], names=["conv_id", "span", "window_no", "n_turns", "turns", "loss_chars", "loss", "formatted_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, id_type = None, None, None

        def row() -> tuple:
            return (own[0], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"], state["windows"])

        for b in batches:
            id_type, out = b.schema.field("conv_id").type, []
            for conv, n, turns, chars, lost, formatted in zip(*[b.column(c).to_pylist() for c in ("conv_id", "n_turns", "turns", "loss_chars", "loss", "formatted_chars")]):
                if own != (conv,):
                    if own:
                        out.append(row())
                    own, state = (conv,), {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "windows": 0}
                state["turns"].update(turns)
                state["loss"].update(lost)
                for k, v in (("n", n), ("chars", chars), ("formatted", formatted), ("windows", 1)):
                    state[k] += v
            yield _digest_batch(out, id_type)
        if own:
            yield _digest_batch([row()], id_type)

    parsed = windows.mapInArrow(read, f"conv_id {kind}, span long, window_no int, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long")
    ordered = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "span", "window_no")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def _digest_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
