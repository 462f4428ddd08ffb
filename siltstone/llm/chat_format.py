"""Chat formatting with loss masks from token offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of the turns that count for the
loss are intersected with the sorted token spans by binary search. The template's markers are single tokens of their
own, so that no token reaches from a marker into a text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from .common import lean, prepared

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@dataclass(frozen=True)
class Template:
    """<begin> then, for each turn, <open> role <middle> text <close>. reserved: further control strings to escape.

    A control string inside a text gets the escape character behind its first character, one more if it has some there
    already; taking one away reads it back. That is one-to-one as long as no control string starts inside another.
    """

    begin: str = "<s>"
    open: str = "[INST]"
    middle: str = "[/INST]"
    close: str = "</s>"
    reserved: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "<unk>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        every = self.controls
        for x in every:
            if len(x) < 2 or self.escape in x or len(self.escape) != 1:
                raise ValueError(f"{x!r}: a control string has two characters or more, and none is the escape character")
            for y in every:
                if any(y.startswith(x[k : k + len(y)]) for k in range(1, len(x))):
                    raise ValueError(f"{y!r} can start inside {x!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.begin, self.open, self.middle, self.close, *self.reserved)))

    def _pattern(self, escapes: str) -> re.Pattern:
        by: dict[str, list[str]] = {}
        for x in self.controls:
            by.setdefault(x[0], []).append(re.escape(x[1:]))
        e = re.escape(self.escape)
        return re.compile("|".join(f"({re.escape(c)}){escapes.replace('E', e)}(?={e}*(?:{'|'.join(rest)}))" for c, rest in by.items()))

    def escaped(self, text: str) -> str:
        return self._cached("")(lambda m: m[0] + self.escape, text)

    def unescaped(self, text: str) -> str:
        return self._cached("E")(lambda m: m[0][:1], text)

    def _cached(self, escapes: str):
        key = f"_sub{escapes}"
        if key not in self.__dict__:
            self.__dict__[key] = self._pattern(escapes).sub
        return self.__dict__[key]

    def guarded(self, json_text: str) -> Template:
        """The template that also escapes the special tokens of a tokenizer file, so that no text can spell one."""
        own = [t["content"] for t in json.loads(json_text).get("added_tokens") or [] if t.get("special")]
        return replace(self, reserved=tuple(dict.fromkeys((*self.reserved, *(x for x in own if x not in self.controls)))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_sub")}

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The conversation, and the sorted spans of the texts that count for the loss."""
        out, at, spans = [self.begin], len(self.begin), []
        for role, text in turns:
            head, body = f"{self.open}{self.escaped(role)}{self.middle}", self.escaped(text)
            at += len(head)
            if role in self.loss_roles and body:
                spans.append((at, at + len(body)))
            at += len(body) + len(self.close)
            out += [head, body, self.close]
        return "".join(out), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns, read back from a rendered conversation."""
        turn = re.compile(f"{re.escape(self.open)}(.*?){re.escape(self.middle)}(.*?){re.escape(self.close)}", re.S)
        at, turns = len(self.begin), []
        while at < len(formatted):
            m = turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            turns.append((self.unescaped(m[1]), self.unescaped(m[2])))
            at = m.end()
        return turns


def load(json_text: str, template: Template) -> Tokenizer:
    """The tokenizer with the template's markers as tokens, and with offsets that keep white space."""
    spec = json.loads(json_text)
    for part in ("pre_tokenizer", "post_processor"):
        if spec.get(part) and spec[part].get("type") == "ByteLevel":
            spec[part] |= {"add_prefix_space": False, "trim_offsets": False}
    spec["truncation"] = spec["padding"] = None
    tokenizer = Tokenizer.from_str(json.dumps(spec))
    tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in dict.fromkeys((template.begin, template.open, template.middle, template.close))])
    return tokenizer


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def mask_of(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that lie in one of the spans; both are sorted, and each span is found by binary search."""
    mask = np.zeros(len(offsets), bool)
    if len(offsets) and spans:
        s = np.array(spans)
        first, last = np.searchsorted(offsets[:, 1], s[:, 0], "right"), np.searchsorted(offsets[:, 0], s[:, 1], "left")
        edge = np.zeros(len(offsets) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, last, -1)
        mask = np.cumsum(edge[:-1]) > 0
    return mask


def masked_spans(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Spans of text under the mask, touching ones put together."""
    out: list[list[int]] = []
    for a, b in offsets[mask].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


FORMATTED = "conv_id long, formatted string, input_ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"


def format_conversations(conversations: DataFrame, template: Template = Template(), tokenizer: str = DEFAULT_TOKENIZER, then=None, schema: str = FORMATTED) -> DataFrame:  # noqa: B008
    """A row for each conversation of (conv_id, turn, role, text): FORMATTED, or what `then` makes of it.

    Turns go by turn (null first), ties by role and text; a null role or text is empty; repeated rows are repeated
    turns. Rows without conv_id belong to no conversation and are left out; other columns are ignored; no rows give
    none. The tokenizer file is read by the driver and sent to the executors; its special tokens are escaped in texts like the
    template's own strings (Template.guarded). Rows are sorted by conversation in the
    shuffle, and a task holds one conversation and a batch of finished ones at a time.
    """
    spark = prepared(conversations.sparkSession)
    given = read_file(tokenizer)
    sent, template = spark.sparkContext.broadcast(given), template.guarded(given)
    rows = (
        conversations.where("conv_id is not null")
        .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(sent.value, template)

        def made(convs: list[tuple[int, list[tuple[str, str]]]]) -> pa.RecordBatch:
            rendered = [template.render(turns) for _, turns in convs]
            columns: dict[str, list] = {c: [] for c in ("conv_id", "formatted", "input_ids", "starts", "ends", "loss_mask")}
            for (conv, _), (text, spans), e in zip(convs, rendered, model.encode_batch([t for t, _ in rendered], add_special_tokens=False), strict=True):
                offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                for c, v in zip(columns, (conv, text, np.array(e.ids, np.int32), offsets[:, 0], offsets[:, 1], mask_of(offsets, spans)), strict=True):
                    columns[c].append(v)
            if then:
                return then(columns)
            kinds = (pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], list(columns))

        done: list[tuple[int, list[tuple[str, str]]]] = []
        size = 0
        for batch in batches:
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                if not done or done[-1][0] != conv:
                    if size > 1 << 18:
                        yield made(done)
                        done, size = [], 0
                    done.append((conv, []))
                done[-1][1].append((role, text))
                size += len(text)
        if done:
            yield made(done)

    return rows.select("conv_id", "role", "text").mapInArrow(lean(run), schema)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def digests(template: Template):
    """From FORMATTED columns alone: turns parsed from the string, loss text from the mask and the offsets."""

    def then(columns: dict[str, list]) -> pa.RecordBatch:
        rows = []
        for conv, text, ids, starts, ends, mask in zip(*columns.values(), strict=True):
            turns = template.parse(text)
            loss = "".join(template.unescaped(text[a:b]) for a, b in masked_spans(np.stack((starts, ends), 1), mask))
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), loss)]
            rows.append((conv, len(turns), sha[0], len(loss), sha[1], len(text), len(ids), int(mask.sum())))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3)
        names = [x.split()[0] for x in DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return then


def conversation_digests(conversations: DataFrame, template: Template = Template(), tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:  # noqa: B008
    """DIGEST for each conversation, read back from the formatted output; see format_conversations for odd rows."""
    return format_conversations(conversations, template, tokenizer, digests(template.guarded(read_file(tokenizer))), DIGEST)
