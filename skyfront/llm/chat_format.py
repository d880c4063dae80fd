"""Chat formatting: heterogeneous records to canonical turns, chosen by schema fingerprint, then to text.

**Fingerprints.**  The nested field paths of a table's schema (arrays as ``[]``) that any known layout
uses are sorted and hashed; the hash selects a declarative mapping.  Paths that no layout knows (extra
columns) do not change the fingerprint.

**Template.**  A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  In a text, every control string of
this template, and those of other templates that :data:`CONTROL` lists, are broken by an escape character after its first character, and an
escape character that the text already holds is doubled; both are undone by :func:`unescape`.  Roles are
percent-encoded where they hold a character of the template.  Loss spans cover assistant texts.

Defined results: a null text or role is empty; turns of equal number keep the order role, text; null turn
numbers come first; rows of a null conversation id make one conversation; empty tables give empty results.
A conversation becomes one text, so its turns meet in one row, and nothing else does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESCAPE = "⁠"
START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common templates by their shapes (``<|...|>``, ``[UPPER_CASE]`` and ``<tool_...>`` among them); each is broken after its first character.
CONTROL = re.compile(r"<\|[A-Za-z0-9_]+\|>|</?s>|\[/?[A-Z][A-Z_]*\]|<</?SYS>>|<(?:start|end)_of_turn>|<(?:bos|eos|pad|unk)>|</?tool_[a-z]+>")
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    while (broken := CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)) != text:  # strings that a broken one overlapped
        text = broken
    return text


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}({ESCAPE}?)", r"\1", text)


def _role_out(role: str) -> str:
    return re.sub(r"[%<>|\[\]\n\r⁠]", lambda m: f"%{ord(m[0]):04X}", role)


def _role_in(role: str) -> str:
    return re.sub(r"%([0-9A-F]{4})", lambda m: chr(int(m[1], 16)), role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans, in code points, that training takes a loss on."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role_out(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, read back."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        turns.append((_role_in(role), unescape(text.removesuffix(END))))
    return turns


def masked_text(formatted: str, spans: list[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped, nothing between."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns. ``rows``: one row per turn; ``list``: an array of structs; ``fields``: a column per turn."""

    name: str
    kind: str
    id: str
    turns: tuple[tuple[str, str], ...]
    order: str = ""

    def paths(self) -> frozenset[str]:
        own = {p for _, path in self.turns for p in path.split(" + ")} if self.kind == "fields" else {p for t in self.turns for p in t}
        return frozenset(own | {self.id} | ({self.order} if self.order else set()))


#: Known layouts. "a + b" joins two fields of a turn by a blank line.
LAYOUTS = (
    Mapping("turn rows", "rows", "conv_id", (("role", "text"),), "turn"),
    Mapping("messages", "list", "id", (("messages[].role", "messages[].content"),)),
    Mapping("from-value", "list", "id", (("conversations[].from", "conversations[].value"),)),
    Mapping("prompt-response", "fields", "id", (("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", "fields", "id", (("user", "instruction + input"), ("assistant", "output"))),
    Mapping("question-answer", "fields", "id", (("system", "system_prompt"), ("user", "question"), ("assistant", "response"))),
)
#: Role names of other layouts; rows of turns keep their own.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested paths of a type; elements of arrays are under ``[]``."""
    if isinstance(kind, T.StructType):
        return set().union(*(field_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind), set())
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def select_mapping(schema: T.StructType, layouts: tuple[Mapping, ...] = LAYOUTS) -> Mapping:
    """The mapping whose fingerprint the schema has; with extra columns of other layouts, the largest layout it holds whole."""
    have = field_paths(schema)
    by_print = {fingerprint(m.paths()): m for m in layouts}
    known = have & frozenset().union(*(m.paths() for m in layouts))
    if (found := by_print.get(fingerprint(known))) is not None:
        return found
    held = [m for m in layouts if m.paths() <= have]
    if not held:
        raise ValueError(f"no layout has the field paths {sorted(have)}")
    return max(held, key=lambda m: len(m.paths()))


def _role(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.coalesce(names[c], c, F.lit(""))


def canonical_turns(df: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) from any known layout."""
    m = select_mapping(df.schema, layouts)
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if m.kind == "rows":
        role, text = m.turns[0]
        turn = F.struct(F.col(m.order).alias("turn"), blank(F.col(role)).alias("role"), blank(F.col(text)).alias("text"))
        grouped = df.groupBy(F.col(m.id).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    if m.kind == "list":
        (role, text), array = (p.split("[].")[1] for p in m.turns[0]), m.turns[0][0].split("[]")[0]
        turns = F.transform(F.coalesce(F.col(array), F.array().cast(df.schema[array].dataType)), lambda t: F.struct(_role(t[role]).alias("role"), blank(t[text]).alias("text")))
    else:
        cells = []
        for role, path in m.turns:
            fields = [F.when(F.col(p) != "", F.col(p)) for p in path.split(" + ")]
            cells.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *fields).alias("text")))
        turns = F.filter(F.array(*cells), lambda t: (t["role"] != "system") | (t["text"] != ""))
    return df.select(F.col(m.id).alias("conv_id"), turns.cast(TURNS).alias("turns"))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Runs of a few rows; ids stay Arrow columns, as pandas would turn longs beside a null into doubles."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def format_chats(df: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, formatted string, loss_spans array<struct<start, end>>), spans in code points."""
    turns = canonical_turns(df, layouts)
    kind = turns.schema["conv_id"].dataType.simpleString()

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            made = [render([(t["role"], t["text"]) for t in row]) for row in part.column("turns").to_pylist()]
            loss = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], spans)
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([x for x, _ in made], pa.string()), loss], ["conv_id", "formatted", "loss_spans"])

    return turns.mapInArrow(run, f"conv_id {kind}, formatted string, loss_spans array<struct<start:long,end:long>>")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when they are read back: counts and hashes of turns and of masked text."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            rows = []
            for text, spans in zip(part.column("formatted").to_pylist(), part.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                loss = masked_text(text, [(s["start"], s["end"]) for s in spans])
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), *map(pa.array, zip(*rows, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
